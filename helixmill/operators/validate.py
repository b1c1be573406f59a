"""What the engine accepts as a read, as predicates and as checks that raise."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MAX_SHORT, MAX_LONG, MAX_READS = 511, 4294967290, 4294967290


def problem(seq: str = "seq", qual: str = "qual", long_mode: bool = False, quality: bool = True) -> Column:
    """Name of the first rule a read breaks, null if none. A null sequence breaks ``no sequence``."""
    limit = MAX_LONG if long_mode else MAX_SHORT
    rules = F.when(F.col(seq).isNull(), "no sequence").when(F.length(seq) > limit, "too long")
    if quality:
        rules = rules.when(F.col(qual).isNull(), "no quality").when(F.length(seq) != F.length(qual), "length mismatch")
    if not long_mode:
        rules = rules.when(F.regexp_like(F.col(seq), F.lit("[^ACGTN]")), "illegal base")
    return rules


def require_valid(reads: DataFrame, long_mode: bool = False, quality: bool = True) -> DataFrame:
    """The same rows; a row that breaks a rule raises when it is read, so no separate pass is needed."""
    broken = problem("seq", "qual", long_mode, quality)
    guarded = F.when(broken.isNull(), F.col("seq")).otherwise(F.raise_error(F.concat(F.lit("Invalid read "), F.col("read_idx").cast("string"), F.lit(": "), broken)))
    return reads.withColumn("seq", guarded)


def count_reads(reads: DataFrame) -> int:
    return check_count(reads.count())


def check_count(n: int) -> int:
    if n == 0:
        raise ValueError("No reads found.")
    if n > MAX_READS:
        raise ValueError(f"Too many reads: at most {MAX_READS}.")
    return n


def check_paired(first: int, second: int) -> None:
    if first != second:
        raise ValueError("Number of reads in paired files do not match.")
