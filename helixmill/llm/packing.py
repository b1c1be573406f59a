"""Filling containers of fixed capacity: bulk-synchronous best fit.

Items larger than the capacity are cut into full containers and a remainder. Then items and gaps meet in sweeps: both
stand sorted by size, the largest items go first, and each takes its successor among the gaps (the smallest gap that
holds it). All items of one size and all gaps of one size are matched at once; who gets which is settled by rank within
the size, the gaps shrink, and the sweep goes on until all items are placed.

Sizes are whole numbers up to the capacity, so the sweeps only need the number of items of each size: at most
``capacity`` numbers, however many items there are. Those go to the driver, the sweeps turn them into intervals of
ranks, and every item finds its container from its size and rank. Ranks are dealt out in buckets of bounded size, so a
size shared by most items is no hot group.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from helixmill.session import cut

MAX_CLASSES, BUCKET = 1 << 21, 50_000


def best_fit(counts: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int, int, int]]:
    """Intervals (size, first rank, ranks, first container, place, offset, unused) of best fit in decreasing size.

    Item ``first rank + i`` of the size lies in container ``first container + i``, as its ``place``-th item, after
    ``offset`` tokens; ``unused`` is what the container has left in the end.
    """
    gaps: dict[int, list[tuple[int, int, tuple]]] = {}  # gap -> ranges (first container, containers, slots)
    order: list[int] = []
    opened = 0

    def put(gap: int, group: tuple[int, int, tuple]) -> None:
        if gap not in gaps:
            gaps[gap] = []
            insort(order, gap)
        gaps[gap].append(group)

    for size in sorted((s for s, n in counts.items() if n), reverse=True):
        left, rank = counts[size], 0
        while left:
            at = bisect_left(order, size)
            if at < len(order):  # the successor of this size among the gaps
                gap = order[at]
                first, n, slots = gaps[gap].pop()
                if not gaps[gap]:
                    del gaps[gap], order[at]
                m = min(n, left)
                put(gap - size, (first, m, (*slots, (size, rank, capacity - gap))))
                if m < n:
                    put(gap, (first + m, n - m, tuple((s, r + m, o) for s, r, o in slots)))
                left, rank = left - m, rank + m
            else:
                per = min(capacity // size, left)
                m = left // per
                put(capacity - per * size, (opened, m, tuple((size, rank + j * m, j * size) for j in range(per))))
                opened, left, rank = opened + m, left - per * m, rank + per * m
    return [(size, rank, n, first, place, offset, gap) for gap, groups in gaps.items() for first, n, slots in groups for place, (size, rank, offset) in enumerate(slots, 1)]


def place_batches(batches: Iterable[pa.RecordBatch], plan) -> Iterator[pa.RecordBatch]:
    """Container of each (kind, size, rank): a search in the sorted intervals."""
    key, rank0, first, place, offset, unused = plan.value
    for batch in batches:
        k = (batch.column("kind_no").to_numpy().astype(np.int64) << 32) | batch.column("size").to_numpy()
        rank = batch.column("rank").to_numpy()
        # intervals are sorted by (key, first rank); search in two steps keeps whole numbers whole
        low, high = np.searchsorted(key, k, "left"), np.searchsorted(key, k, "right")
        while True:
            open_ = high - low > 1
            if not open_.any():
                break
            mid = (low + high) // 2
            right = rank0[np.minimum(mid, len(rank0) - 1)] <= rank
            low, high = np.where(open_ & right, mid, low), np.where(open_ & ~right, mid, high)
        names = [n for n in batch.schema.names if n not in ("kind_no", "rank")]
        out = [batch.column(n) for n in names]
        out += [batch.column("kind_no"), pa.array(first[low] + rank - rank0[low]), pa.array(place[low].astype(np.int32)), pa.array(offset[low]), pa.array(unused[low])]
        yield pa.RecordBatch.from_arrays(out, [*names, "kind_no", "container", "place", "from_token", "unused"])


def pack(sizes: DataFrame, rid: str, tokens: str, kinds: list[tuple[str, int]]) -> DataFrame:
    """Place every item into containers of each kind.

    ``sizes`` has an id and a size per item; it is read several times, so it should be a written table. Result:
    ``kind``, ``container`` (from 0), ``place`` (from 1), ``from_token`` (offset in the container), ``rid``, ``piece``
    (from 0; an item has several only if it exceeds the capacity), ``tokens`` and ``unused`` of the container. Items
    of no tokens, null ids or null sizes take no room and aren't placed; repeated rows are separate items.
    """
    kinds = sorted((k, int(c)) for k, c in kinds if k is not None and c is not None and c > 0)
    if sum(c for _, c in kinds) > MAX_CLASSES:
        raise ValueError(f"capacities add up to more than {MAX_CLASSES}: that many size classes aren't sent to the driver")
    spark = sizes.sparkSession
    result = "rid bigint, piece bigint, size bigint, kind_no int, container bigint, place int, from_token bigint, unused bigint"
    named = "rid bigint, kind string, container bigint, place int, from_token bigint, piece bigint, tokens bigint, unused bigint"
    if not kinds:
        return spark.createDataFrame([], named)
    rows = sizes.where(F.col(rid).isNotNull() & (F.col(tokens) > 0)).select(F.col(rid).cast("bigint").alias("rid"), F.col(tokens).cast("bigint").alias("t"))
    each = F.explode(F.array(*[F.struct(F.lit(i).alias("no"), F.lit(c).cast("bigint").alias("c")) for i, (_, c) in enumerate(kinds)]))
    pieces = rows.withColumn("k", each).select("rid", "t", "k.*").withColumn("piece", F.explode(F.expr("sequence(0L, (t - 1) div c)")))
    pieces = pieces.select("rid", "piece", F.least(F.col("c"), F.col("t") - F.col("piece") * F.col("c")).alias("size"), F.col("no").alias("kind_no"))
    total = rows.agg(F.sum(F.lit(0) + sum((F.floor((F.col("t") - 1) / c) + 1 for _, c in kinds), F.lit(0))).alias("n")).first()["n"] or 0
    buckets = max(1, int(total) // BUCKET)
    pieces = pieces.withColumn("bucket", F.pmod(F.xxhash64("rid", "piece"), F.lit(buckets)).cast("int"))
    by_bucket = cut(pieces.groupBy("kind_no", "size", "bucket").agg(F.count("*").alias("n")))
    counts: dict[int, dict[int, int]] = {i: {} for i in range(len(kinds))}
    for r in by_bucket.groupBy("kind_no", "size").agg(F.sum("n").alias("n")).collect():  # at most the sum of the capacities
        counts[r["kind_no"]][r["size"]] = r["n"]
    plan = sorted((no << 32 | s, r, f, p, o, u) for no, (_, c) in enumerate(kinds) for s, r, n, f, p, o, u in best_fit(counts[no], c))
    columns = [np.array(x, np.int64) for x in zip(*plan)] if plan else [np.zeros(0, np.int64)] * 6
    shared = spark.sparkContext.broadcast(columns)
    before = W.partitionBy("kind_no", "size").orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)
    base = by_bucket.withColumn("base", F.coalesce(F.sum("n").over(before), F.lit(0))).drop("n")
    inner = W.partitionBy("kind_no", "size", "bucket").orderBy("rid", "piece")
    ranked = pieces.withColumn("rn", F.row_number().over(inner)).join(base, ["kind_no", "size", "bucket"])
    ranked = ranked.select("rid", "piece", "size", "kind_no", (F.col("base") + F.col("rn") - 1).alias("rank"))
    placed = ranked.mapInArrow(lambda it: place_batches(it, shared), result)
    kind = F.element_at(F.array(*[F.lit(k) for k, _ in kinds]), F.col("kind_no") + 1)
    return placed.select("rid", kind.alias("kind"), "container", "place", "from_token", "piece", F.col("size").alias("tokens"), "unused")
