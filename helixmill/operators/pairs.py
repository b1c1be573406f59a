"""Mates: joining them, coding one by the other, renumbering reordered reads so that mates stay together."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from helixmill.operators.numbering import running_total

NEAR = 32767


def join_mates(reads: DataFrame, columns: list[str]) -> DataFrame:
    """One row per pair with both mates: ``pair_idx`` and each column as ``<name>_1`` and ``<name>_2``.

    An aggregate instead of a self-join: one shuffle of the table, not two. A missing mate leaves nulls.
    """
    side = lambda c, m: F.max(F.when(F.col("mate") == m, F.col(c))).alias(f"{c}_{m}")
    return reads.groupBy("pair_idx").agg(*[side(c, m) for c in columns for m in (1, 2)])


def pair_flag(pos_1: Column, pos_2: Column) -> Column:
    """0 both placed and near, 1 both placed, 2 neither, 3 only the first, 4 only the second; null is not placed."""
    return F.when(pos_1.isNull() & pos_2.isNull(), 2).when(pos_2.isNull(), 3).when(pos_1.isNull(), 4).when(F.abs(pos_2 - pos_1) < NEAR, 0).otherwise(1)


def relative_mate(flag: Column, pos_1: Column, pos_2: Column, rc_1: Column, rc_2: Column) -> list[Column]:
    """For flag 0 the distance of mate 2 and whether orientations agree (1) or differ (0); else null."""
    near = flag == 0
    return [F.when(near, pos_2 - pos_1).cast("int").alias("pos_pair"), F.when(near, F.when(rc_1 == rc_2, 1).otherwise(0)).alias("rc_pair")]


def renumber_pairs(order: DataFrame, half: int) -> DataFrame:
    """Give reordered reads numbers that keep mates half the reads apart.

    ``order`` has ``new_idx`` and ``old_idx`` of a paired set of 2 * ``half`` reads; mate 1 is below ``half``. Mate 1
    reads are numbered as they appear, and mate 2 gets its partner's number plus ``half``: column ``pair_new_idx``.
    """
    rank = running_total(order.withColumn("_one", (F.col("old_idx") < half).cast("int")), "new_idx", F.col("_one"), "rank").where("_one = 1").select("old_idx", "rank")
    both = rank.select("old_idx", F.col("rank").alias("pair_new_idx")).unionByName(rank.select((F.col("old_idx") + half).alias("old_idx"), (F.col("rank") + half).alias("pair_new_idx")))
    return order.join(both, "old_idx")
