"""Mixing sources to target weights by hash-threshold histograms.

Each record has a hash of its id. A source's budget is spent on its records in the order of their hashes: a record is
taken if it still fits, else passed over. Sizes are summed by hash bucket, the bucket in which the sum exceeds the
budget is summed again by finer buckets, and so on down to one record; that record is passed over, and the search goes
on behind it with what is left and with records no larger than that, until nothing fits. The result is one threshold
per source and a few short intervals behind it: records inside are taken once more than the others, so a filter on the
hash does the selection, without a sort. A larger budget only raises the threshold, so selections are nested but for
records passed over.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

#: bits a histogram divides, bits of the hash
BITS, HASH, MAX_SOURCES = 12, 60, 10_000


def canonical(source: Column) -> Column:
    """Source names without blanks and case."""
    return F.lower(F.trim(source))


@dataclass
class Search:
    """Where the search for a source stands: buckets of ``1 << width`` hashes from ``at`` on, ``rest`` of the budget there.

    Since ``start`` only records of at most ``most`` count.
    """

    rest: float
    density: float  # of tokens per hash
    start: int = 0
    at: int = 0
    width: int = HASH - BITS
    most: float = 0.0
    taken: list[tuple[int, int, float]] = field(default_factory=list)
    done: bool = False

    def __post_init__(self) -> None:
        self.most = self.rest

    def take(self, end: int) -> None:
        if end > self.start:
            self.taken.append((self.start, end, self.most))

    def step(self, cell: int | None, before: float, records: int) -> None:
        """Go on from a histogram: the first bucket over the rest and what lies before it, or no such bucket."""
        self.rest -= before
        if cell is None:
            self.at += 1 << (self.width + BITS)
            self.width = min(HASH - BITS, self.width + BITS // 2)
            if self.at >= 1 << HASH:
                self.take(1 << HASH)
                self.done = True
            return
        self.at += cell << self.width
        if records > 1 and self.width:
            self.width = max(0, self.width - BITS)
            return
        self.take(self.at)
        self.at += 1 << self.width
        self.start, self.most = self.at, self.rest
        # buckets that together should hold some times the rest
        self.width = min(HASH - BITS, max(0, round(math.log2(max(16 * self.rest / self.density, 1))) - BITS))
        self.done = self.rest < 1 or self.at >= 1 << HASH


def thresholds(sized: DataFrame, budgets: dict[str, float], totals: dict[str, int]) -> dict[str, list[tuple[int, int, float]]]:
    """Per source the hash intervals [from, to) of the records taken, each with the largest size taken in it.

    ``sized`` has ``source``, ``h`` (not negative) and ``tokens``. A round sums one histogram of 2^``BITS`` buckets a
    source; one row a source reaches the driver. Records of equal hash are taken or passed over together.
    """
    spark = sized.sparkSession
    state = {s: Search(b, max(totals[s], 1) / 2.0**HASH) for s, b in budgets.items()}
    while open_ := {s: x for s, x in state.items() if not x.done}:
        now = spark.createDataFrame([(s, x.at, x.width, float(x.rest), float(x.most)) for s, x in open_.items()], "source string, at bigint, width int, rest double, most double")
        cell = F.expr("shiftright(h - at, width)")
        here = sized.join(F.broadcast(now), "source").where((F.col("h") >= F.col("at")) & (F.col("tokens") <= F.col("most")))  # at most MAX_SOURCES rows
        cells = here.withColumn("cell", cell).where(F.col("cell") < (1 << BITS)).groupBy("source", "cell").agg(F.sum("tokens").alias("t"), F.count("*").alias("n"), F.first("rest").alias("rest"))
        upto = F.sum("t").over(W.partitionBy("source").orderBy("cell"))
        over = F.min(F.when(F.col("upto") > F.col("rest"), F.struct("cell", "t", "n", "upto"))).alias("over")
        got = {r["source"]: r for r in cells.withColumn("upto", upto).groupBy("source").agg(over, F.max("upto").alias("all")).collect()}
        for s, x in open_.items():
            r = got.get(s)
            if r is None or r["over"] is None:
                x.step(None, r["all"] if r else 0, 0)
            else:
                x.step(r["over"]["cell"], r["over"]["upto"] - r["over"]["t"], r["over"]["n"])
    return {s: x.taken for s, x in state.items()}


def mix_sources(sizes: DataFrame, rid: str, source: str, tokens: str, targets: list[tuple[str, float, int]], total: float | None = None) -> tuple[DataFrame, DataFrame]:
    """Chosen records (``rid``, ``source``, ``tokens``, ``repeats``) and a report per source.

    ``targets`` are (source, share, cap on repeats). Targets without a positive share or without a cap of 1 or more
    take nothing. Shares are relative to each other among the sources that have records; the report also shows those
    that have none. ``total`` is the size of the mix; by default the largest at which every such source can still give
    its share within its cap, and never more than that. ``sizes`` is read several times, so it should be a written
    table. Records without id, size or a source among the targets are never chosen.
    """
    wanted = {}
    for name, share, cap in targets:
        if name is not None and share is not None and not math.isnan(share) and share > 0 and cap is not None and cap >= 1:
            wanted[name.strip().lower()] = (float(share), int(cap))
    if len(wanted) > MAX_SOURCES:
        raise ValueError(f"more than {MAX_SOURCES} target sources")
    spark = sizes.sparkSession
    sized = sizes.where(F.col(rid).isNotNull() & (F.col(tokens) > 0)).select(F.col(rid).alias("rid"), canonical(F.col(source)).alias("source"), F.col(tokens).alias("tokens"), F.shiftrightunsigned(F.xxhash64(rid), 64 - HASH).alias("h"))
    sized = sized.where(F.col("source").isin(list(wanted)) if wanted else F.lit(False))
    have = {r["source"]: (r["t"], r["n"]) for r in sized.groupBy("source").agg(F.sum("tokens").alias("t"), F.count("*").alias("n")).collect()}
    weight = sum(wanted[s][0] for s in have)
    most = min((have[s][0] * wanted[s][1] * weight / wanted[s][0] for s in have), default=0.0)
    total = most if total is None else min(float(total), most)
    whole, budget = {}, {}
    for s in have:
        need = total * wanted[s][0] / weight
        whole[s] = min(wanted[s][1], int(need / have[s][0] + 1e-12))
        budget[s] = need - whole[s] * have[s][0] if whole[s] < wanted[s][1] else 0.0
    limit = thresholds(sized, {s: b for s, b in budget.items() if b >= 1}, {s: have[s][0] for s in have})
    plan = [(s, whole[s], [(a, b, float(most)) for a, b, most in limit.get(s, [])]) for s in have]
    goals = spark.createDataFrame(plan, "source string, whole int, more array<struct<a: bigint, b: bigint, most: double>>")
    taken = F.expr("exists(more, x -> h >= x.a and h < x.b and tokens <= x.most)")
    chosen = sized.join(F.broadcast(goals), "source").withColumn("repeats", (F.col("whole") + taken.cast("int")).cast("int"))  # at most MAX_SOURCES rows
    chosen = chosen.where("repeats > 0").select("rid", "source", "tokens", "repeats")
    used = chosen.groupBy("source").agg(F.count("*").alias("records"), F.sum(F.col("tokens") * F.col("repeats")).alias("used"), F.max("repeats").alias("most_repeats"))
    goal = spark.createDataFrame([(s, share, cap, share / weight if s in have else 0.0) for s, (share, cap) in wanted.items()], "source string, target_share double, max_repeats int, reachable_share double")
    all_used = used.agg(F.sum("used")).first()[0] or 0
    report = goal.join(used, "source", "left").na.fill(0, ["records", "used", "most_repeats"])
    report = report.select("source", "target_share", "reachable_share", "max_repeats", "records", "most_repeats", F.col("used").alias("tokens_used"), (F.col("used") / max(all_used, 1)).alias("actual_share"))
    return chosen, report
