"""FASTQ and FASTA text: scans and sinks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

#: Names of the levels 0 to 9.
GZIP_LEVELS = ("NO_COMPRESSION", "BEST_SPEED", "TWO", "THREE", "FOUR", "FIVE", "SIX", "SEVEN", "EIGHT", "BEST_COMPRESSION")
READ_SCHEMA = "read_idx bigint, pair_idx bigint, mate int, id string, seq string, qual string"


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """Lines of a text file, or of a folder of files in the order of their names, with ``line`` from 0.

    Lines are numbered within the block they were read in; one row per block then gives each block its first number.
    Blocks of a file are tasks of their own, so the scan stays parallel. A gzip file is one block.
    """
    raw = spark.read.option("lineSep", "\n").text(path).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"), F.monotonically_increasing_id().alias("m"))
    size = raw.groupBy("file", "start").agg(F.count("*").alias("n"), F.min("m").alias("low"))
    before = F.coalesce(F.sum("n").over(W.orderBy("file", "start").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))  # one row per block
    base = size.select("file", "start", "low", before.alias("base"))
    return raw.join(base, ["file", "start"]).select((F.col("base") + F.col("m") - F.col("low")).alias("line"), "value")


def scan(spark: SparkSession, path: str, fasta: bool = False, mate: int = 1, first_idx: int = 0) -> DataFrame:
    """Records of a file of 4 lines each (2 for FASTA): ``read_idx``, ``pair_idx``, ``mate``, ``id``, ``seq``, ``qual``.

    The third line is dropped, and one carriage return at the end of each line. Empty ids, sequences and qualities are
    legal. A file whose lines don't fill the last record raises when it is read.
    """
    per = 2 if fasta else 4
    lines = numbered_lines(spark, path).withColumn("value", F.regexp_replace("value", "\r\\z", ""))
    at = F.col("line") % per
    field = lambda i: F.max(F.when(at == i, F.col("value")))
    records = lines.groupBy(F.expr(f"line div {per}").alias("rec")).agg(field(0).alias("id"), field(1).alias("seq"), field(3 if not fasta else 9).alias("qual"), F.count("*").alias("n"))
    whole = F.when(F.col("n") == per, F.col("seq")).otherwise(F.raise_error(F.lit("Number of lines not multiple of 4(2)")))
    return records.select((F.col("rec") + first_idx).alias("read_idx"), F.col("rec").alias("pair_idx"), F.lit(mate).alias("mate"), "id", whole.alias("seq"), "qual")


def scan_paired(spark: SparkSession, first: str, second: str, fasta: bool = False) -> DataFrame:
    """Both files; mate 2 is numbered from the number of pairs. Files of unequal length raise."""
    from helixmill.operators.validate import check_paired

    one, two = scan(spark, first, fasta, 1), scan(spark, second, fasta, 2)
    n, m = one.count(), two.count()
    check_paired(n, m)
    return one.unionByName(two.withColumn("read_idx", F.col("read_idx") + n))


def record_text(quality: bool = True):
    parts = [F.coalesce("id", F.lit("")), F.coalesce("seq", F.lit(""))]
    if quality:
        parts += [F.lit("+"), F.coalesce("qual", F.lit(""))]
    return F.concat_ws("\n", *parts)


def write(reads: DataFrame, path: str, quality: bool = True, gzip: bool = False, level: int = 6, order: str = "pair_idx") -> None:
    """Records in the order of ``order``, one file per range of it; names sort in the same order.

    With ``gzip`` each file is a gzip member, so the files put end to end are a gzip file too.
    """
    rows = reads.repartitionByRange(F.col(order)).sortWithinPartitions(order).select(record_text(quality).alias("value"))
    writer = rows.write.mode("overwrite").option("lineSep", "\n")
    if gzip:
        writer = writer.option("compression", "gzip").option("zlib.compress.level", GZIP_LEVELS[level])
    writer.text(path)


def write_columns(reads: DataFrame, path: str, order: str = "read_idx") -> None:
    """The columns of the reads as three texts of one line a record: ``id``, ``seq`` and ``qual`` folders of ``path``.

    Line n of all three belongs to record n; nulls are empty lines.
    """
    rows = reads.repartitionByRange(F.col(order)).sortWithinPartitions(order)
    for name in ("id", "seq", "qual"):
        rows.select(F.coalesce(name, F.lit("")).alias("value")).write.mode("overwrite").option("lineSep", "\n").text(f"{path}/{name}")


def scan_columns(spark: SparkSession, path: str) -> DataFrame:
    """The records of ``write_columns``: ``read_idx`` from 0, ``id``, ``seq``, ``qual``."""
    parts = None
    for name in ("id", "seq", "qual"):
        own = numbered_lines(spark, f"{path}/{name}").select(F.col("line").alias("read_idx"), *[F.col("value").alias(c) if c == name else F.lit(None).cast("string").alias(c) for c in ("id", "seq", "qual")])
        parts = own if parts is None else parts.unionByName(own)
    return parts.groupBy("read_idx").agg(*[F.max(c).alias(c) for c in ("id", "seq", "qual")])
