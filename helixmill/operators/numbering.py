"""Positions over a whole dataset without sorting it into one task: block totals, prefix sums of those, join back."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W


def running_total(df: DataFrame, order: str, value: Column, name: str, block: int = 1 << 16) -> DataFrame:
    """Sum of ``value`` over all rows with a smaller ``order`` (a unique whole number): rows before, not the row itself.

    Rows are grouped into blocks of ``block`` consecutive orders. Only one row per block meets in a single window, and
    each block is summed in a task of its own.
    """
    rows = df.withColumn("_b", F.floor(F.col(order) / block)).withColumn("_v", value.cast("bigint"))
    totals = rows.groupBy("_b").agg(F.sum("_v").alias("_t"))
    base = totals.select("_b", F.coalesce(F.sum("_t").over(W.orderBy("_b").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("_base"))
    inner = W.partitionBy("_b").orderBy(order).rowsBetween(W.unboundedPreceding, -1)
    local = rows.withColumn("_in", F.coalesce(F.sum("_v").over(inner), F.lit(0)))
    return local.join(base, "_b").withColumn(name, F.col("_base") + F.col("_in")).drop("_b", "_v", "_in", "_base")


def blocks(df: DataFrame, order: str, size: int) -> DataFrame:
    """Columns ``block_num`` and ``row_in_block``."""
    return df.withColumn("block_num", F.floor(F.col(order) / size)).withColumn("row_in_block", F.col(order) % size)


def delta(df: DataFrame, block: str, order: str, pos: str, escape: int = 65535) -> DataFrame:
    """Steps between consecutive positions of a block: column ``step``, and ``absolute`` where the step doesn't fit.

    The first row of a block is absolute; a step of ``escape`` or more, or a negative one, is escaped likewise.
    """
    prev = F.lag(pos).over(W.partitionBy(block).orderBy(order))
    step = F.col(pos) - prev
    far = prev.isNotNull() & ((step >= escape) | (step < 0))
    return df.withColumn("step", F.when(prev.isNull(), F.lit(0)).when(far, F.lit(escape)).otherwise(step).cast("bigint")).withColumn("absolute", F.when(prev.isNull() | far, F.col(pos)))


def undelta(df: DataFrame, block: str, order: str) -> DataFrame:
    """Positions from ``step`` and ``absolute``: sums that start anew at every absolute row."""
    per = W.partitionBy(block).orderBy(order)
    run = df.withColumn("_run", F.count("absolute").over(per))
    within = W.partitionBy(block, "_run").orderBy(order)
    start = F.first("absolute").over(within)
    moved = F.sum(F.when(F.col("absolute").isNull(), F.col("step")).otherwise(0)).over(within)
    return run.withColumn("pos", start + moved).drop("_run")


def range_numbers(df: DataFrame, by: list[str], name: str) -> DataFrame:
    """Consecutive numbers from 0 in the order of ``by`` (unique together), by a range sort: no group is one task's work."""
    from helixmill.session import cut

    rows = cut(df.repartitionByRange(*by).sortWithinPartitions(*by).withColumn("_m", F.monotonically_increasing_id()))
    part = F.shiftright("_m", 33)
    size = rows.groupBy(part.alias("_p")).agg(F.count("*").alias("_n"))
    base = size.select("_p", F.coalesce(F.sum("_n").over(W.orderBy("_p").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("_base"))  # one row per partition
    numbered = rows.withColumn("_p", part).join(F.broadcast(base), "_p")  # one row per partition
    return numbered.withColumn(name, F.col("_base") + F.col("_m").bitwiseAND((1 << 33) - 1)).drop("_m", "_p", "_base")
