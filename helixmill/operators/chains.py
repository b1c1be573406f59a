"""Chains of overlapping reads: contigs of any length, without an order of work."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from helixmill.operators.contigs import votes
from helixmill.operators.overlap import READ_LIMIT, RESCUE_LIMIT, best_overlap, overlaps
from helixmill.session import cut


def mutual(best: DataFrame) -> DataFrame:
    """Links ``read_idx`` to ``other`` at ``shift`` of which a read begins one and ends one: of the links to one read the
    smallest shift stays, then the smallest read."""
    first = F.min_by(F.struct("read_idx", "shift"), F.struct("shift", "read_idx"))
    return best.groupBy("other").agg(first.alias("m")).select("m.read_idx", "other", "m.shift")


def chain_places(links: DataFrame) -> DataFrame:
    """``read_idx``, ``chain`` (its first read), ``place`` from 0 and ``pos`` (the sum of shifts) of all linked reads.

    Every round doubles the distance looked back, so a chain of n reads takes log2(n) rounds. Reads of closed rings have
    no first read; their rounds end when all others are placed, and they aren't listed.
    """
    back = cut(links.select(F.col("other").alias("read_idx"), F.col("read_idx").alias("to"), F.lit(1).cast("bigint").alias("steps"), F.col("shift").cast("bigint").alias("way")))
    heads = links.select("read_idx").join(back.select("read_idx"), "read_idx", "left_anti").distinct()
    placed = cut(heads.select("read_idx", F.col("read_idx").alias("chain"), F.lit(0).cast("bigint").alias("place"), F.lit(0).cast("bigint").alias("pos")))
    while True:
        reach = placed.select(F.col("read_idx").alias("to"), "chain", "place", "pos")
        new = cut(back.join(reach, "to").select("read_idx", "chain", (F.col("place") + F.col("steps")).alias("place"), (F.col("pos") + F.col("way")).alias("pos")))
        if new.isEmpty():
            return placed
        placed = placed.unionByName(new)
        left = back.join(new.select("read_idx"), "read_idx", "left_anti")
        hop = back.select(F.col("read_idx").alias("to"), F.col("to").alias("to2"), F.col("steps").alias("steps2"), F.col("way").alias("way2"))
        back = cut(left.join(hop, "to").select("read_idx", F.col("to2").alias("to"), (F.col("steps") + F.col("steps2")).alias("steps"), (F.col("way") + F.col("way2")).alias("way")))


def chain_consensus(places: DataFrame, reads: DataFrame) -> DataFrame:
    """Consensus base and depth along each chain: ``contig_id`` (the chain), ``site``, ``base``, ``depth``."""
    rows = places.join(reads.select("read_idx", F.col("seq").alias("text")), "read_idx")
    return votes(rows.select(F.col("chain").alias("contig_id"), "pos", "text"))


def splice(reads: DataFrame, max_len: int, max_shift: int, near: int = READ_LIMIT, loose: int = RESCUE_LIMIT) -> DataFrame:
    """For each read that neither overlaps another within ``near`` code bits nor is overlapped, the read it goes before
    within ``loose``: ``read_idx``, ``before``, ``shift``, ``strand``, ``cost``; reads that fit nowhere are absent."""
    found = cut(overlaps(reads, max_len, max_shift, loose))
    close = found.where(F.col("cost") <= near)
    settled = close.select("read_idx").unionByName(close.select(F.col("other").alias("read_idx"))).distinct()
    alone = found.join(settled, "read_idx", "left_anti")
    return best_overlap(alone).withColumnRenamed("other", "before")
