"""The archive: a folder of Parquet streams in blocks of reads, with the job's parameters beside them.

    contigs/              consensus strings (short mode)
    read/ quality/ id/    one row per read each, partitioned by block_num, so that a range of reads prunes to its blocks
    params/               one JSON row
"""

from __future__ import annotations

from dataclasses import asdict, dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from helixmill.functions.quality import illumina_bin, threshold
from helixmill.functions.seq import fake_id, mate_id, mate_pattern
from helixmill.operators.contigs import decode, encode
from helixmill.operators.identifiers import file_pattern
from helixmill.operators.numbering import range_numbers
from helixmill.operators.pairs import join_mates, renumber_pairs
from helixmill.operators.qvz import quantise
from helixmill.operators.validate import check_count, require_valid
from helixmill.session import cut

SHORT_BLOCK, LONG_BLOCK = 256_000, 10_000


@dataclass
class Params:
    paired: bool = False
    long_mode: bool = False
    keep_order: bool = True
    quality: bool = True
    ids: bool = True
    num_reads: int = 0
    num_pairs: int = 0
    max_len: int = 0
    id_pattern: int = 0
    quality_mode: str = "lossless"
    block: int = SHORT_BLOCK


def lossy(reads: DataFrame, mode: tuple) -> DataFrame:
    """Quality modes: ("lossless",), ("ill_bin",), ("binary", at, high, low), ("qvz", ratio[, (option, value) ...])
    with the options of ``quantise``."""
    if mode[0] == "lossless":
        return reads
    if mode[0] == "ill_bin":
        return reads.withColumn("qual", illumina_bin("qual"))
    if mode[0] == "binary":
        return reads.withColumn("qual", threshold("qual", *mode[1:]))
    if mode[0] == "qvz":
        return quantise(reads, mode[1], **dict(mode[2:]))
    raise ValueError(f"unknown quality mode {mode[0]}")


def reordered(reads: DataFrame, rows: DataFrame, paired: bool, pairs: int) -> DataFrame:
    """New number of each read when reads of a contig stand together: ``old_idx``, ``new_idx``."""
    key = F.coalesce(F.xxhash64("contig_id"), F.xxhash64("read_idx"))
    spot = rows.select(F.col("read_idx").alias("old_idx"), key.alias("h"), F.coalesce("pos", F.lit(0)).alias("pos"))
    order = range_numbers(spot, ["h", "pos", "old_idx"], "new_idx").select("old_idx", "new_idx")
    if paired:
        order = renumber_pairs(order, pairs).select("old_idx", F.col("pair_new_idx").alias("new_idx"))
    return order


def write_archive(reads: DataFrame, path: str, paired: bool = False, long_mode: bool = False, keep_order: bool = True, quality: bool = True, ids: bool = True, mode: tuple = ("lossless",)) -> Params:
    """Store reads (``read_idx``, ``pair_idx``, ``mate``, ``id``, ``seq``, ``qual``). Long mode always keeps the order."""
    spark = reads.sparkSession
    keep_order = keep_order or long_mode
    reads = cut(require_valid(reads.select("read_idx", "pair_idx", "mate", "id", "seq", "qual"), long_mode, quality))
    facts = reads.agg(F.count("*").alias("n"), F.max(F.length("seq")).alias("longest")).first()
    n = check_count(facts["n"])
    p = Params(paired, long_mode, keep_order, quality, ids, n, n // 2 if paired else n, int(facts["longest"] or 0), 0, " ".join(map(str, mode)), LONG_BLOCK if long_mode else SHORT_BLOCK)
    if long_mode:
        rows = reads.select("read_idx", "seq")
        numbered = reads
    else:
        contigs, rows = encode(reads.select("read_idx", "seq"), p.max_len)
        contigs.write.mode("overwrite").parquet(f"{path}/contigs")
        numbered = reads
        if not keep_order:
            rows = cut(rows)
            order = cut(reordered(reads, rows, paired, p.num_pairs))
            new = order.withColumnRenamed("old_idx", "read_idx")
            rows = rows.join(new, "read_idx").withColumn("read_idx", F.col("new_idx")).drop("new_idx")
            numbered = reads.join(new, "read_idx").withColumn("read_idx", F.col("new_idx")).drop("new_idx")
            numbered = numbered.withColumn("pair_idx", F.col("read_idx") - F.when(F.lit(paired) & (F.col("mate") == 2), p.num_pairs).otherwise(0))
    pair = F.col("read_idx") - (F.when(F.col("read_idx") >= p.num_pairs, p.num_pairs).otherwise(0) if paired else 0)
    place = lambda df: df.withColumn("pair_idx", pair).withColumn("block_num", F.floor(F.col("pair_idx") / p.block))

    def store(df: DataFrame, name: str) -> None:
        df.repartition("block_num").sortWithinPartitions("block_num", "read_idx").write.mode("overwrite").option("compression", "zstd").partitionBy("block_num").parquet(f"{path}/{name}")

    store(place(rows), "read")
    if quality:
        store(place(lossy(numbered.select("read_idx", "qual"), mode)), "quality")
    if ids:
        if paired:
            mates = join_mates(numbered, ["id"])
            p.id_pattern = int(file_pattern(mates, mate_pattern("id_1", "id_2")).first()[0] or 0)
        kept = numbered.where("mate = 1") if p.id_pattern else numbered
        store(place(kept.select("read_idx", "id")), "id")
    spark.createDataFrame([tuple(asdict(p).values())], list(asdict(p))).coalesce(1).write.mode("overwrite").json(f"{path}/params")
    return p


def read_params(spark: SparkSession, path: str) -> Params:
    return Params(**spark.read.json(f"{path}/params").first().asDict())


def check_range(first: int, last: int, n: int) -> None:
    if not 1 <= first <= last <= n:
        raise ValueError(f"a range lies between 1 and {n}, and its start isn't after its end")


def read_archive(spark: SparkSession, path: str, first: int | None = None, last: int | None = None) -> DataFrame:
    """Reads of the archive, or of pairs ``first`` to ``last`` (from 1, inclusive) only: then other blocks aren't read."""
    p = read_params(spark, path)

    def stream(name: str) -> DataFrame:
        df = spark.read.parquet(f"{path}/{name}")
        if first is not None:
            check_range(first, last, p.num_pairs)
            df = df.where(F.col("block_num").between((first - 1) // p.block, (last - 1) // p.block) & F.col("pair_idx").between(first - 1, last - 1))
        return df

    rows = stream("read")
    seqs = rows.select("read_idx", "pair_idx", "seq") if p.long_mode else decode(spark.read.parquet(f"{path}/contigs"), rows, ("pair_idx",))
    mate = F.when(F.lit(p.paired) & (F.col("read_idx") >= p.num_pairs), 2).otherwise(1)
    out = seqs.withColumn("mate", mate)
    if p.ids:
        known = stream("id")
        if p.id_pattern:
            known = known.select("pair_idx", F.col("id").alias("_id"))
            out = out.join(known, "pair_idx").withColumn("id", F.when(F.col("mate") == 2, mate_id("_id", p.id_pattern)).otherwise(F.col("_id"))).drop("_id")
        else:
            out = out.join(known.select("read_idx", "id"), "read_idx")
    else:
        out = out.withColumn("id", fake_id("pair_idx", "mate"))
    if p.quality:
        out = out.join(stream("quality").select("read_idx", "qual"), "read_idx")
    else:
        out = out.withColumn("qual", F.lit(None).cast("string"))
    return out.select("read_idx", "pair_idx", "mate", "id", "seq", "qual")


def archive_sizes(spark: SparkSession, path: str) -> DataFrame:
    """Bytes of each stream on disk, from the files' metadata."""
    import builtins

    fs_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = fs_path.getFileSystem(spark._jsc.hadoopConfiguration())
    names = [s for s in ("contigs", "read", "quality", "id") if fs.exists(spark._jvm.org.apache.hadoop.fs.Path(f"{path}/{s}"))]
    sizes = [(s, builtins.int(fs.getContentSummary(spark._jvm.org.apache.hadoop.fs.Path(f"{path}/{s}")).getLength())) for s in names]
    return spark.createDataFrame(sizes, "stream string, bytes bigint")


def archive_counts(spark: SparkSession, path: str) -> DataFrame:
    """What a short-mode archive holds (one row): ``reads``, ``clean_reads``, ``n_reads``; ``placed`` on contigs, of these
    ``n_aligned`` with N; clean ``singletons`` and ``n_stored`` reads with N kept as they are; ``contigs``, their bases, ``bases`` of all reads and ``stored_bases`` of those kept as they are,
    and ``bits_per_base`` of contigs, differences and stored reads on disk."""
    rows = spark.read.parquet(f"{path}/read")
    sizes = {r["stream"]: r["bytes"] for r in archive_sizes(spark, path).collect()}
    on = F.col("contig_id").isNotNull()
    has_n = F.when(on, F.exists("noise", lambda d: d["code"] == "3")).otherwise(F.contains("seq", F.lit("N")))
    total = rows.select(on.alias("on"), has_n.alias("n"), "read_len").agg(
        F.count("*").alias("reads"), F.count_if(~F.col("n")).alias("clean_reads"), F.count_if("n").alias("n_reads"), F.count_if("on").alias("placed"), F.count_if(F.col("on") & F.col("n")).alias("n_aligned"),
        F.count_if(~F.col("on") & ~F.col("n")).alias("singletons"), F.count_if(~F.col("on") & F.col("n")).alias("n_stored"), F.sum("read_len").alias("bases"), F.coalesce(F.sum(F.when(~F.col("on"), F.col("read_len"))), F.lit(0)).alias("stored_bases"),
    )
    contigs = spark.read.parquet(f"{path}/contigs").agg(F.count("*").alias("contigs"), F.sum(F.length("seq")).alias("contig_bases")).first()
    bits = F.lit(8.0 * (sizes["contigs"] + sizes["read"])) / F.col("bases")
    return total.select("*", F.lit(contigs["contigs"]).alias("contigs"), F.lit(contigs["contig_bases"]).alias("contig_bases"), bits.alias("bits_per_base"))
