"""Grouping symbol lines into similarity clusters by parallel pivot correlation clustering.

Two lines are neighbours if the mean squared difference of their symbols is at most ``radius``. Pivots absorb their
neighbours: first the standing pivots (profiles known beforehand, which come before every line in the order), then the
lines still free in a hash order, until none is left. Members are then reassigned to the closest pivot, each group's mean
profile is recomputed, and the lines nearest to it are its most typical members: with squared differences the member
nearest to the mean is the one of the smallest total distance to all members, the medoid. A pivot that absorbs nothing
is no group; its line stays outside.

The pivots are those of the sequential method, whatever the partitions. Rounds begin with a bounded number of lines
(``FIRST``, or ``LETTERS`` letters), whose pivots go to all tasks; once such a round takes in less than half of the lines
it meets, those left have few neighbours each, and growing shares of them are settled by the local minima of their
neighbourhoods. Neighbours are found through a grid of segment means that loses none. Equal lines are one vertex with
many ids.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from itertools import product

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from helixmill.llm.arrays import flat_text, mix, slices
from helixmill.session import cut

MAX_PIVOTS = 20_000
SEGMENTS, BLOCK, FIRST, LETTERS, GROWTH = 4, 1024, 4096, 1 << 22, 4


def by_length(text: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Rows of one length and their symbols as a matrix, for each length but 0."""
    if pc.all(pc.equal(pc.binary_length(text), pc.utf8_length(text))).as_py() is False:
        flat = np.frombuffer("".join(text.to_pylist()).encode("utf-32-le"), np.uint32)
        offsets = np.append(0, np.cumsum(pc.utf8_length(text).to_numpy(zero_copy_only=False)))
    else:
        flat, offsets = flat_text(text)
    size = np.diff(offsets)
    for n in np.unique(size[size > 0]).tolist():
        row = np.flatnonzero(size == n)
        yield row, flat[offsets[row][:, None] + np.arange(n)]


def nearest_batches(batches: Iterable[pa.RecordBatch], ids: list[int], means: list[list[int]], radius: float, zero: int) -> Iterator[pa.RecordBatch]:
    """Closest standing pivot of each line within the radius; equal distances go to the earlier pivot."""
    for batch in slices(batches, "text", 1 << 20):
        rows, chosen, gaps = [], [], []
        for row, symbols in by_length(batch.column("text")):
            n = symbols.shape[1]
            fit = [i for i, m in enumerate(means) if len(m) >= n]
            if not fit:
                continue
            q = symbols.astype(np.float64) - zero
            m = np.array([means[i][:n] for i in fit], np.float64)
            gap = (q * q).sum(1)[:, None] - 2 * (q @ m.T) + (m * m).sum(1)  # whole numbers, exact in doubles
            best = gap.argmin(1)
            least = gap[np.arange(len(row)), best]
            near = least <= radius * n
            rows.append(row[near])
            chosen.append(np.array([ids[i] for i in fit], np.int64)[best[near]])
            gaps.append(least[near] / n)
        if rows:
            row = np.concatenate(rows)
            taken = batch.take(pa.array(row))
            yield pa.RecordBatch.from_arrays([taken.column("rid"), taken.column("text"), pa.array(np.concatenate(chosen)), pa.array(np.concatenate(gaps))], ["rid", "text", "pivot", "distance"])


def cell_batches(batches: Iterable[pa.RecordBatch], radius: float, zero: int, probe: bool) -> Iterator[pa.RecordBatch]:
    """Cell of each line: its length and the means of its segments on a grid; with ``probe`` all cells a neighbour can be in.

    The mean squared difference of two lines is at least that of their segments' means, so this loses no neighbour.
    """
    for batch in slices(batches, "text", 1 << 20):
        for row, symbols in by_length(batch.column("text")):
            n = symbols.shape[1]
            edges = np.linspace(0, n, min(SEGMENTS, n) + 1).astype(int)
            size = np.diff(edges)
            width = max(1.0, (radius * n / size.min()) ** 0.5) * (1 + 1e-9)
            level = np.add.reduceat(symbols.astype(np.float64) - zero, edges[:-1], axis=1) / size
            home = np.floor(level / width)
            steps = np.array(list(product((-1, 0, 1), repeat=len(size)))) if probe else np.zeros((1, len(size)))
            rows, keys = [], []
            for step in steps:
                apart = np.where(step > 0, (home + 1) * width - level, np.where(step < 0, level - home * width, 0))
                near = np.flatnonzero(apart**2 @ size <= radius * n * (1 + 1e-9) + 1e-9)
                cell = (home[near] + step).astype(np.int64).astype(np.uint64)
                key = np.full(len(near), n, np.uint64)
                for k in range(len(size)):
                    key = mix(key * np.uint64(31) + cell[:, k])
                rows.append(row[near])
                keys.append(key)
            taken = batch.take(pa.array(np.concatenate(rows)))
            key = np.concatenate(keys).view(np.int64)
            yield pa.RecordBatch.from_arrays([taken.column("rid"), taken.column("h"), taken.column("text"), pa.array(np.full(len(key), n, np.int32)), pa.array(key)], ["rid", "h", "text", "n", "cell"])


def near_batches(batches: Iterable[pa.RecordBatch], radius: float, zero: int, every: bool) -> Iterator[pa.RecordBatch]:
    """Neighbours between the two blocks of a row: the closest head of each line, or every pair whose head comes first."""
    for batch in batches:
        for i in range(batch.num_rows):
            lines, heads = (batch.column(c).slice(i, 1).flatten() for c in ("lines", "heads"))
            x, y = (next(by_length(b.field("text")))[1].astype(np.float64) - zero for b in (lines, heads))
            gap = (x * x).sum(1)[:, None] - 2 * (x @ y.T) + (y * y).sum(1)  # whole numbers, exact in doubles
            rid, pivot = lines.field("rid").to_numpy(), heads.field("rid").to_numpy()
            if every:
                h, first = lines.field("h").to_numpy()[:, None], heads.field("h").to_numpy()
                a, b = np.nonzero((gap <= radius * x.shape[1]) & ((first < h) | (first == h) & (pivot < rid[:, None])))
            else:
                order = np.argsort(pivot)
                b = order[gap[:, order].argmin(1)]
                a = np.flatnonzero(gap[np.arange(len(b)), b] <= radius * x.shape[1])
                b = b[a]
            yield pa.RecordBatch.from_arrays([pa.array(rid[a]), pa.array(pivot[b]), pa.array(gap[a, b] / x.shape[1])], ["rid", "pivot", "distance"])


_MEMBER = "rid bigint, text string, pivot bigint, distance double"


def absorb(lines: DataFrame, pivots: list[tuple[int, list[int]]], radius: float, zero: int) -> DataFrame:
    """Members of the standing pivots: ``rid``, ``text``, ``pivot``, ``distance``. The pivots are a bounded list."""
    if len(pivots) > MAX_PIVOTS:
        raise ValueError(f"{len(pivots)} standing pivots; at most {MAX_PIVOTS} are sent to all tasks")
    pivots = sorted(pivots)
    ids, means = [p[0] for p in pivots], [list(p[1]) for p in pivots]
    return lines.mapInArrow(lambda it: nearest_batches(it, ids, means, radius, zero), _MEMBER)


def neighbours(lines: DataFrame, heads: DataFrame, radius: float, zero: int, every: bool = False) -> DataFrame:
    """``rid``, ``pivot``, ``distance`` of lines and heads within the radius; both have ``rid``, ``h``, ``text``.

    Lines and heads of one cell meet in blocks of about ``BLOCK``, each block of lines under a key of its own.
    """
    form = "rid bigint, h bigint, text string, n int, cell bigint"

    def blocks(df: DataFrame, probe: bool, name: str) -> tuple[DataFrame, DataFrame]:
        cells = cut(df.select("rid", "h", "text").mapInArrow(lambda it: cell_batches(it, radius, zero, probe), form))
        parts = cells.groupBy("n", "cell").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("parts"))
        part = F.pmod(F.xxhash64("rid"), F.col("parts")).cast("int").alias("part")
        rows = cells.join(parts, ["n", "cell"]).select("n", "cell", part, F.struct("rid", "h", "text").alias("item"))
        return rows.groupBy("n", "cell", "part").agg(F.collect_list("item").alias(name)), parts

    own, parts = blocks(lines, False, "lines")
    others, _ = blocks(heads, True, "heads")
    others = others.drop("part").join(parts, ["n", "cell"]).withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    met = own.join(others, ["n", "cell", "part"]).select("lines", "heads")
    return met.mapInArrow(lambda it: near_batches(it, radius, zero, every), "rid bigint, pivot bigint, distance double")


def later(edges: DataFrame) -> DataFrame | None:
    """Lines that a pivot absorbs when all go in order; ``edges`` has ``rid`` and its earlier neighbour ``pivot``."""
    gone, edges = None, cut(edges.select("rid", "pivot"))
    while not edges.isEmpty():
        risen = edges.select("pivot").distinct().join(edges.select(F.col("rid").alias("pivot")).distinct(), "pivot", "left_anti")
        out = cut(edges.join(risen, "pivot", "left_semi").select("rid").distinct())
        gone = out if gone is None else gone.unionByName(out)
        edges = cut(edges.join(out, "rid", "left_anti").join(out.withColumnRenamed("rid", "pivot"), "pivot", "left_anti"))
    return gone


def rising(texts: list[str], radius: float, zero: int) -> np.ndarray:
    """Which of these lines are pivots when they go in the order given."""
    up = np.ones(len(texts), bool)
    for row, symbols in by_length(pa.array(texts, pa.string())):
        x = symbols.astype(np.float64) - zero
        square = (x * x).sum(1)
        for i in range(len(row)):
            if up[row[i]]:
                gap = square[i] - 2 * (x[i + 1 :] @ x[i]) + square[i + 1 :]  # whole numbers, exact in doubles
                up[row[i + 1 :][gap <= radius * x.shape[1]]] = False
    return up


def far_batches(batches: Iterable[pa.RecordBatch], pivots: list[str], radius: float, zero: int) -> Iterator[pa.RecordBatch]:
    """The lines that none of the pivots absorbs."""
    heads = {symbols.shape[1]: symbols.astype(np.float64) - zero for _, symbols in by_length(pa.array(pivots, pa.string()))}
    for batch in slices(batches, "text", 1 << 18):
        far = np.ones(batch.num_rows, bool)
        for row, symbols in by_length(batch.column("text")):
            y = heads.get(symbols.shape[1])
            if y is not None:
                x = symbols.astype(np.float64) - zero
                gap = (x * x).sum(1)[:, None] - 2 * (x @ y.T) + (y * y).sum(1)
                far[row[gap.min(1) <= radius * x.shape[1]]] = False
        yield batch.filter(pa.array(far))


def free_groups(free: DataFrame, radius: float, zero: int) -> DataFrame:
    """Closest pivot of each free line, of pivots that rise among these lines; ``free`` has distinct texts.

    Taken in hash order, a line that no earlier pivot has absorbed is a pivot.
    """
    form = "rid bigint, text string, h bigint"
    free = cut(free.select("rid", "text", F.xxhash64("rid", "text").alias("h")))
    left, pivots, total = free, None, free.count()
    size, lowest = total, -(1 << 63)
    while size:
        head, letters = [], 0
        for r in left.orderBy("h", "rid").limit(FIRST).collect():  # bounded by FIRST
            letters += len(r["text"])
            if head and letters > LETTERS:
                break
            head.append(r)
        up = rising([r["text"] for r in head], radius, zero)
        risen = [tuple(r) for r, u in zip(head, up) if u]
        new = free.sparkSession.createDataFrame(risen, form)
        pivots = new if pivots is None else pivots.unionByName(new)
        texts, (last, at) = [r[1] for r in risen], (head[-1]["h"], head[-1]["rid"])
        rest = left.where((F.col("h") > last) | ((F.col("h") == last) & (F.col("rid") > at)))
        left = cut(rest.mapInArrow(lambda it, texts=texts: far_batches(it, texts, radius, zero), form))
        before, size, lowest = size - len(head), left.count(), last
        if size > before / 2:
            break
    taken = GROWTH * (((lowest + (1 << 63)) * total >> 64) + FIRST)  # lines expected up to there in the order
    while size:
        last = taken >= total
        edge = -(1 << 63) + (taken << 64) // total
        share = left if last else left.where(F.col("h") < edge)
        gone = later(neighbours(share, share, radius, zero, every=True))
        risen = cut(share if gone is None else share.join(gone, "rid", "left_anti"))
        pivots = risen if pivots is None else pivots.unionByName(risen)
        if last:
            break
        rest = left.where(F.col("h") >= edge)
        left = cut(rest.join(neighbours(rest, risen, radius, zero).select("rid").distinct(), "rid", "left_anti"))
        taken *= GROWTH
    if pivots is None:
        return free.select("rid", "text", F.col("rid").alias("pivot"), F.lit(0.0).alias("distance"))
    near = neighbours(free, cut(pivots), radius, zero)
    best = near.groupBy("rid").agg(F.min(F.struct("distance", "pivot")).alias("m")).select("rid", "m.*")
    return free.select("rid", "text").join(best, "rid")


def sum_batches(batches: Iterable[pa.RecordBatch], zero: int) -> Iterator[pa.RecordBatch]:
    """Per batch and group the symbol sums and counts of each column, so that few rows leave the task."""
    for batch in slices(batches, "text", 1 << 20):
        group = np.asarray(batch.column("grp"))
        for row, symbols in by_length(batch.column("text")):
            g = group[row]
            names, code = np.unique(g, return_inverse=True)
            order = np.argsort(code, kind="stable")
            total = np.add.reduceat(symbols[order].astype(np.int64) - zero, np.searchsorted(code[order], np.arange(len(names))), axis=0)
            n = symbols.shape[1]
            weight = np.repeat(np.bincount(code), n)
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(names, n)), pa.array(np.tile(np.arange(n, dtype=np.int32), len(names))), pa.array(total.ravel()), pa.array(weight)], ["grp", "col", "total", "lines"])


def spread_batches(batches: Iterable[pa.RecordBatch], zero: int) -> Iterator[pa.RecordBatch]:
    """Distance of each line to the mean profile beside it."""
    for batch in slices(batches, "text", 1 << 20):
        profile = batch.column("profile")
        for row, symbols in by_length(batch.column("text")):
            n = symbols.shape[1]
            lists = profile.take(pa.array(row))
            start = np.asarray(lists.offsets)[:-1] - np.asarray(lists.offsets)[0]
            mean = lists.flatten().to_numpy()[start[:, None] + np.arange(n)]
            gap = ((symbols.astype(np.float64) - zero - mean) ** 2).mean(1)
            yield pa.RecordBatch.from_arrays([batch.column("rid").take(pa.array(row)), batch.column("grp").take(pa.array(row)), pa.array(gap)], ["rid", "grp", "distance"])


def describe(members: DataFrame, top: int, zero: int) -> DataFrame:
    """Size and most typical members of each group ``grp``: the ``top`` lines closest to its recomputed mean profile.

    ``members`` has ``rid``, ``text``, ``grp``; ties go to the smaller id.
    """
    size = members.groupBy("grp").agg(F.count("*").alias("members"))
    sums = members.select("grp", "text").mapInArrow(lambda it: sum_batches(it, zero), "grp bigint, col int, total bigint, lines bigint")
    mean = sums.groupBy("grp", "col").agg((F.sum("total") / F.sum("lines")).alias("m"))
    profile = mean.groupBy("grp").agg(F.expr("transform(array_sort(collect_list(struct(col, m))), x -> x.m)").alias("profile"))
    gaps = members.join(profile, "grp").select("rid", "text", "grp", "profile").mapInArrow(lambda it: spread_batches(it, zero), "rid bigint, grp bigint, distance double")
    place = W.partitionBy("grp").orderBy("distance", "rid")
    best = gaps.withColumn("place", F.row_number().over(place)).where(F.col("place") <= top)
    return best.join(size, "grp").select("grp", "members", "place", "rid", "distance")


def similarity_clusters(df: DataFrame, rid: str, text: str, pivots: list[tuple[int, list[int]]], radius: float, zero: int = 33) -> DataFrame:
    """Group of each line: ``rid``, ``text``, ``pivot``, ``distance`` to it, ``standing`` (whether the pivot was given).

    ``pivots`` are pairs of id and profile (symbol code less ``zero`` per column); a profile shorter than the line does
    not compare. A line within ``radius`` of a standing pivot belongs to the closest one. The other lines form groups
    around pivots of their own (the smallest id of the pivot's equal lines) until none is left to absorb, and a line
    that stays alone isn't listed. Null ids, null and empty texts are left out; equal lines share their group.
    """
    rows = df.where(F.col(rid).isNotNull() & (F.length(text) > 0)).select(F.col(rid).cast("bigint").alias("rid"), F.col(text).alias("text"))
    standing = cut(absorb(rows, pivots, radius, zero).withColumn("standing", F.lit(True)))
    free = rows.join(standing.select("rid"), "rid", "left_anti")
    vertices = free.groupBy("text").agg(F.min("rid").alias("rid")).select("rid", "text")
    found = cut(free_groups(vertices, radius, zero))
    lines = free.join(found.select("text", "pivot", "distance"), "text")
    crowd = lines.groupBy("pivot").agg(F.count("*").alias("n")).where("n > 1").select("pivot")
    lines = lines.join(crowd, "pivot").select("rid", "text", "pivot", "distance").withColumn("standing", F.lit(False))
    return standing.unionByName(lines)
