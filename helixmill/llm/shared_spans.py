"""Long exact spans shared between records, by recompression.

Rounds of recompression name runs of equal symbols and then pairs of neighbouring symbols. A name is a hash of what it
stands for, so every task gives equal substrings equal names without a shared dictionary, and a round needs no exchange.
Symbols grow until they have a ``GROWN``-th of the window (with what they depend on, more than a third) or the rounds end. With each symbol of each round goes the
interval of letters its existence depends on; if that lies inside a window, every equal window elsewhere holds the same
symbol at the same place. A window's anchor is its visible symbol of the highest round (the smallest hash among equals),
named together with the letters it depends on. Consecutive windows with one anchor travel as one chunk of text:

1. anchors of a single record are dropped by an aggregate over (anchor, record) alone: shared high-level symbols reveal
   the repeats, and only their chunks are shipped; equal (anchor, text) chunks combine;
2. the windows of the remaining chunks are compared letter by letter, as whole numbers that hold all their letters
   (verification): inside one list per anchor where an anchor has at most ``GROUP`` different texts, by a shuffle of the
   windows' 128-bit hashes for the others, so no list grows with the data and no anchor is left out;
3. the shared windows of a chunk go back to all its occurrences and join into maximal stretches per record.

Each step is an aggregate with map-side combine or an equi-join of reduced sides.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from helixmill.llm.arrays import flat_text, mix, mix2, ranges, slices
from helixmill.session import cut

GROWN, ROUNDS, GROUP = 6, 10, 64


def recompress(flat: np.ndarray, seg_start: np.ndarray, seg_end: np.ndarray, freeze: int, rounds: int = ROUNDS):
    """Per round the symbols of the segments of ``flat``: name and the interval [ds, de) of letters each depends on.

    Segments are parsed independently. A symbol that depends on a segment's edge gets ds = start - 1 or de = end + 1,
    so no window inside the segment holds it.
    """
    beg, seg = ranges(seg_start, seg_end - seg_start)
    name = mix(flat[beg].astype(np.uint64) + np.uint64(257))
    end, ds, de = beg + 1, beg.copy(), beg + 1
    low, high = seg_start - 1, seg_end + 1
    out = [(name, ds, de)]

    def beside(values: np.ndarray, step: int, edge: np.ndarray) -> np.ndarray:
        out = edge[seg].copy()
        if step < 0:
            near = seg[1:] == seg[:-1]
            out[1:][near] = values[:-1][near]
        else:
            near = seg[1:] == seg[:-1]
            out[:-1][near] = values[1:][near]
        return out

    for turn in range(rounds):
        if not len(name):
            break
        free = end - beg < freeze
        if turn < 2:  # runs of one symbol
            joins = (name[1:] == name[:-1]) & (seg[1:] == seg[:-1]) & free[1:]
            head = np.flatnonzero(np.concatenate([[True], ~joins]))
            count = np.diff(np.append(head, len(name)))
            last = head + count - 1
            lds, rde = beside(ds, -1, low), beside(de, 1, high)
            run, fixed = count > 1, ~free[head]
            new_ds = np.where(fixed, ds[head], np.minimum(ds[head], lds[head]))
            new_de = np.where(fixed, de[last], np.maximum(de[last], rde[last]))
            inner = np.minimum.reduceat(ds, head), np.maximum.reduceat(de, head)
            ds, de = np.where(fixed, new_ds, np.minimum(new_ds, inner[0])), np.where(fixed, new_de, np.maximum(new_de, inner[1]))
            name = np.where(run, mix2(name[head], count.astype(np.uint64) + np.uint64(7919)), name[head])
            beg, end, seg = beg[head], end[last], seg[head]
            free = end - beg < freeze
        kind = (mix(name + np.uint64(turn * 2 + 1)) & np.uint64(1)).astype(bool)
        same = seg[1:] == seg[:-1]
        pair = ~kind[:-1] & kind[1:] & same & free[:-1] & free[1:]
        first, second = np.append(pair, False), np.concatenate([[False], pair])
        lone = free & ~first & ~second
        lds, rde = beside(ds, -1, low), beside(de, 1, high)
        lde, rds = beside(de, -1, low), beside(ds, 1, high)
        need_left, need_right = lone & kind, lone & ~kind
        ds2 = np.where(need_left, np.minimum(ds, lds), np.where(need_right, np.minimum(ds, rds), ds))
        de2 = np.where(need_right, np.maximum(de, rde), np.where(need_left, np.maximum(de, lde), de))
        i = np.flatnonzero(pair)
        ds2[i], de2[i] = np.minimum(ds[i], ds[i + 1]), np.maximum(de[i], de[i + 1])
        name2, end2 = name.copy(), end.copy()
        name2[i], end2[i] = mix2(name[i], name[i + 1]), end[i + 1]
        keep = ~second
        name, beg, end, ds, de, seg = name2[keep], beg[keep], end2[keep], ds2[keep], de2[keep], seg[keep]
        out.append((name, ds, de))
    return out


def interval_prints(flat: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Polynomial fingerprints of the letters in [start, end), equal wherever they lie."""
    base = mix(np.array([77], np.uint64))[0] | np.uint64(1)
    inverse = np.uint64(pow(int(base), -1, 1 << 64))
    power, back = (np.cumprod(np.concatenate([[np.uint64(1)], np.full(len(flat), b, np.uint64)])) for b in (base, inverse))
    total = np.concatenate([[np.uint64(0)], np.cumsum(mix(np.arange(256, dtype=np.uint64) + np.uint64(9 << 20))[flat] * power[:-1])])
    inside = (start >= 0) & (end <= len(flat))
    s, e = np.where(inside, start, 0), np.where(inside, end, 0)
    return (total[e] - total[s]) * back[s]


def anchors(flat: np.ndarray, seg_start: np.ndarray, seg_end: np.ndarray, width: int):
    """Chunks of consecutive windows with one anchor: anchor name, first letter, letter after the last, segment.

    A window in which no symbol is visible (long periodic stretches) is a chunk of its own, named by its letters.
    """
    long = seg_end - seg_start >= width
    seg_start, seg_end = seg_start[long], seg_end[long]
    at, seg = ranges(seg_start, seg_end - seg_start - width + 1)
    best, names, known = np.full(len(at), -1), [], 0
    todo = np.arange(len(at))
    for name, ds, de in reversed(recompress(flat, seg_start, seg_end, max(2, width // GROWN))):
        if not len(todo):
            break
        fits = de - ds <= width
        order = np.flatnonzero(fits)[np.lexsort((-de[fits], ds[fits]))]
        name, ds, de = name[order], ds[order], de[order]
        if not len(de):
            continue
        # a symbol whose interval holds that of another of its round is never needed
        after = np.append(np.minimum.accumulate(de[::-1])[::-1][1:], np.iinfo(np.int64).max)
        keep = after > de
        name, ds, de = name[keep], ds[keep], de[keep]
        # a symbol is named together with the letters it depends on: they are in the window too, and tell far more
        name = mix2(name, interval_prints(flat, ds, de))
        lo, hi = np.searchsorted(ds, at[todo], "left"), np.searchsorted(de, at[todo] + width, "right") - 1
        rank = mix(name)
        own = np.where(lo <= hi, lo, -1)
        for step in range(1, int((hi - lo).max(initial=0)) + 1):
            more = np.flatnonzero(lo + step <= hi)
            other, mine = lo[more] + step, own[more]
            own[more] = np.where(rank[other] < rank[mine], other, mine)
        best[todo] = np.where(own >= 0, own + known, -1)
        names.append(name)
        known += len(name)
        todo = todo[own < 0]
    name = np.concatenate(names) if names else np.zeros(0, np.uint64)
    new = np.ones(len(at), bool)
    new[1:] = (seg[1:] != seg[:-1]) | (best[1:] != best[:-1]) | (best[1:] < 0)
    head = np.flatnonzero(new)
    last = np.append(head[1:], len(at)) - 1 if len(at) else head
    return best[head], name, at[head], at[last] + width, np.flatnonzero(long)[seg[head]]


def chunk_batches(batches: Iterable[pa.RecordBatch], width: int, alphabet: bytes) -> Iterator[pa.RecordBatch]:
    legal = np.zeros(256, bool)
    legal[list(alphabet)] = True
    for batch in slices(batches, "text"):
        batch = batch.filter(pc.is_valid(batch.column("text")))
        flat, offsets = flat_text(batch.column("text"))
        ok = legal[flat]
        edge = np.zeros(len(flat) + 1, bool)
        edge[offsets] = True
        start = np.flatnonzero(ok & (edge[:-1] | ~np.concatenate([[False], ok[:-1]]))) if len(flat) else np.zeros(0, np.int64)
        stop = np.flatnonzero(ok & (edge[1:] | ~np.append(ok[1:], False))) + 1 if len(flat) else start
        # two idle letters between segments keep the sentinels of neighbours apart
        gap = 3 * np.arange(1, len(start) + 1)
        room = np.zeros(len(flat) + 3 * len(start) + 3, np.uint8)
        where, owner = ranges(start, stop - start)
        room[where + gap[owner]] = flat[where]
        best, name, first, past, seg = anchors(room, start + gap, stop + gap, width)
        first, past = first - gap[seg], past - gap[seg]
        row = np.searchsorted(offsets, first, "right") - 1
        raw = flat.tobytes()
        texts = [raw[a:b].decode("latin-1") for a, b in zip(first.tolist(), past.tolist())]
        anchor = np.where(best >= 0, name[best] if len(name) else 0, 0).astype(np.uint64)
        for i in np.flatnonzero(best < 0).tolist():
            anchor[i] = np.uint64(hash_text(texts[i]))
        yield pa.RecordBatch.from_arrays(
            [batch.column("rid").take(pa.array(row)), pa.array(first - offsets[row] + batch.column("origin").to_numpy()[row]), pa.array(anchor.view(np.int64)), pa.array(texts, pa.string())],
            ["rid", "at", "anchor", "chunk"],
        )


def hash_text(text: str) -> int:
    import hashlib

    return int.from_bytes(hashlib.blake2b(text.encode(), digest_size=8).digest(), "little")


def window_words(flat: np.ndarray, starts: np.ndarray, width: int, alphabet: bytes) -> list[np.ndarray]:
    """The windows that begin at ``starts`` as whole numbers which together hold every letter."""
    bits = max(1, (len(alphabet) - 1).bit_length())
    code = np.zeros(256, np.uint64)
    code[list(alphabet)] = np.arange(len(alphabet))
    words, size = code[flat], 1
    while 2 * size <= min(width, 64 // bits):
        words = words[:-size] << np.uint64(bits * size) | words[size:]
        size *= 2
    return [words[starts + at] for at in [*range(0, width - size, size), width - size]]


def verify_batches(batches: Iterable[pa.RecordBatch], width: int, alphabet: bytes) -> Iterator[pa.RecordBatch]:
    """Ranges of windows of each chunk that another record of the same anchor has too: (anchor, c, f, t)."""
    for batch in slices(batches, "weight"):
        anchor, lists = batch.column("anchor"), batch.column("m")
        count = pc.list_value_length(lists).to_numpy(zero_copy_only=False)
        items = lists.flatten()
        flat, offsets = flat_text(items.field("chunk"))
        lo, hi, c = (items.field(n).to_numpy() for n in ("lo", "hi", "c"))
        group = np.repeat(np.arange(len(count)), count)
        start, chunk = ranges(offsets[:-1], np.diff(offsets) - width + 1)
        if not len(start):
            continue
        keys = [group[chunk], *window_words(flat, start, width, alphabet)]
        order = np.lexsort(keys[::-1])
        new = np.zeros(len(order), bool)
        new[0] = True
        for key in keys:
            new[1:] |= key[order][1:] != key[order][:-1]
        head = np.flatnonzero(new)
        low, high = np.minimum.reduceat(lo[chunk][order], head), np.maximum.reduceat(hi[chunk][order], head)
        shared = np.zeros(len(start), bool)
        shared[order] = np.repeat(low < high, np.diff(np.append(head, len(order))))
        at, own = start[shared] - offsets[chunk[shared]], chunk[shared]
        if not len(at):
            continue
        first = np.concatenate([[True], (own[1:] != own[:-1]) | (at[1:] != at[:-1] + 1)])
        head = np.flatnonzero(first)
        last = np.append(head[1:], len(at)) - 1
        yield pa.RecordBatch.from_arrays([anchor.take(pa.array(group[own[head]])), pa.array(c[own[head]]), pa.array(at[head]), pa.array(at[last])], ["anchor", "c", "f", "t"])


def crowded_spans(chunks: DataFrame, width: int) -> DataFrame:
    """The same ranges for anchors with any number of texts: windows meet by shuffle, with map-side combine."""
    windows = chunks.select("anchor", "c", "lo", "hi", F.posexplode(F.expr(f"transform(sequence(1, length(chunk) - {width - 1}), i -> substring(chunk, i, {width}))")).alias("i", "w"))
    windows = windows.select("anchor", "c", "lo", "hi", "i", F.xxhash64("w").alias("k1"), F.xxhash64(F.lit(1), "w").alias("k2"))
    common = windows.groupBy("k1", "k2").agg(F.min("lo").alias("a"), F.max("hi").alias("b")).where("a < b").select("k1", "k2")
    hits = windows.join(common, ["k1", "k2"], "left_semi").groupBy("anchor", "c").agg(F.array_sort(F.collect_list("i")).alias("hits"))
    edges = "filter(hits, (h, j) -> j = 0 or h <> hits[j - 1] + 1)", "filter(hits, (h, j) -> j = size(hits) - 1 or h <> hits[j + 1] - 1)"
    spans = hits.select("anchor", "c", F.explode(F.expr(f"zip_with({edges[0]}, {edges[1]}, (f, t) -> struct(f, t))")).alias("s"))
    return spans.select("anchor", "c", F.col("s.f").cast("bigint").alias("f"), F.col("s.t").cast("bigint").alias("t"))


def shared_spans(df: DataFrame, rid: str, text: str, width: int = 60, alphabet: str = "ACGT", origin: str | None = None) -> DataFrame:
    """Maximal stretches of each record's text covered by windows that also occur in another record.

    Columns ``rid`` (bigint), ``span_from`` (of the first letter; the text begins at ``origin``, 0 by default) and
    ``span_to`` (after the last letter). Only letters of ``alphabet`` count, others divide the text. One row per record
    is expected; repeated rows of a record don't share with each other. Rows with a null id, text or origin, and texts
    shorter than ``width``, give no span.
    """
    begin = F.lit(0) if origin is None else F.col(origin)
    rows = df.where(F.col(rid).isNotNull() & (F.length(text) >= width) & begin.isNotNull()).select(F.col(rid).cast("bigint").alias("rid"), begin.cast("bigint").alias("origin"), F.col(text).alias("text"))
    letters = alphabet.encode()
    found = cut(rows.mapInArrow(lambda it: chunk_batches(it, width, letters), "rid bigint, at bigint, anchor bigint, chunk string"))
    twice = found.groupBy("anchor").agg(F.min("rid").alias("a"), F.max("rid").alias("b")).where("a < b").select("anchor")
    found = cut(found.join(twice, "anchor", "left_semi").withColumn("c", F.xxhash64("chunk")))
    chunks = found.groupBy("anchor", "c", "chunk").agg(F.min("rid").alias("lo"), F.max("rid").alias("hi"))
    many = chunks.groupBy("anchor").agg(F.count("*").alias("n")).where(F.col("n") > GROUP).select("anchor")
    spans = "anchor bigint, c bigint, f bigint, t bigint"
    lists = chunks.join(many, "anchor", "left_anti").groupBy("anchor").agg(F.collect_list(F.struct("chunk", "c", "lo", "hi")).alias("m"))
    lists = lists.withColumn("weight", F.array_join("m.chunk", ""))
    ranges_small = lists.mapInArrow(lambda it: verify_batches(it, width, letters), spans)
    ranges_large = crowded_spans(chunks.join(many, "anchor", "left_semi"), width)
    placed = found.select("rid", "at", "anchor", "c").join(ranges_small.unionByName(ranges_large), ["anchor", "c"])
    placed = placed.select("rid", (F.col("at") + F.col("f")).alias("f"), (F.col("at") + F.col("t") + width).alias("t"))
    per = W.partitionBy("rid").orderBy("f", "t")
    opened = placed.withColumn("open", F.coalesce((F.col("f") > F.max("t").over(per.rowsBetween(W.unboundedPreceding, -1))).cast("int"), F.lit(1)))
    return opened.withColumn("g", F.sum("open").over(per)).groupBy("rid", "g").agg(F.min("f").alias("span_from"), F.max("t").alias("span_to")).drop("g")
