"""Shape utilities: splitting long reads, transposing qualities, run lengths of one symbol."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def split_long(reads: DataFrame, longest: int) -> DataFrame:
    """Cut reads into pieces of at most ``longest`` bases with the same id; an empty read is one empty piece."""
    last = F.greatest(F.ceil(F.length("seq") / longest) - 1, F.lit(0)).cast("int")
    pieces = reads.withColumn("piece", F.explode(F.sequence(F.lit(0), last)))
    at = F.col("piece") * longest + 1
    return pieces.withColumn("seq", F.substr("seq", at, F.lit(longest))).withColumn("qual", F.substr("qual", at, F.lit(longest)))


def transpose(reads: DataFrame, part: int = 1 << 16) -> DataFrame:
    """Column-wise qualities: for each column and part of the reads, the symbols in the order of the reads.

    A column of all reads has no bound, so it comes in parts of ``part`` read numbers; ``part_no`` puts them in order.
    """
    cells = reads.where("qual is not null").select("read_idx", F.posexplode(F.filter(F.split("qual", ""), lambda x: x != "")).alias("col", "s"))
    parts = cells.groupBy("col", F.floor(F.col("read_idx") / part).alias("part_no"))
    in_order = F.array_sort(F.collect_list(F.struct("read_idx", "s")))
    return parts.agg(F.array_join(F.transform(in_order, lambda x: x["s"]), "").alias("symbols"))


def run_lengths(reads: DataFrame, symbol: str = "F", text: str = "qual") -> DataFrame:
    """For each other symbol of a text the run of ``symbol`` before it (0 if none), and the run at the end if any.

    Columns ``read_idx``, ``n`` (from 0), ``run``, ``next`` ('' at the end).
    """
    pieces = F.regexp_extract_all(F.col(text), F.lit(f"(?s){symbol}*[^{symbol}]|{symbol}+$"), F.lit(0))
    rows = reads.where(F.col(text).isNotNull()).select("read_idx", F.posexplode(pieces).alias("n", "piece"))
    last = F.substr("piece", F.length("piece"), F.lit(1))
    at_end = last == symbol
    return rows.select("read_idx", "n", F.when(at_end, F.length("piece")).otherwise(F.length("piece") - 1).alias("run"), F.when(at_end, "").otherwise(last).alias("next"))
