"""Reads that overlap: index windows, banded equi-joins, and a check of the distance in code bits."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from helixmill.functions.aligned import cost2, prices, rolling_codes
from helixmill.functions.flat import flat_text, mix, ranges, slices, turned_letters
from helixmill.functions.seq import dictionary_windows, revcomp, window_key
from helixmill.session import PACKED, cut, pack, small, spread, sweep, unpack

READ_LIMIT, RESCUE_LIMIT, BIN_LIMIT, PART = 4, 24, 1000, 2048
#: places of a key in the contigs from which its reads go to all windows, and letters of such reads that go at once
CROWDED, CROWD_LETTERS = 1024, 1 << 22
_FOUND = "read_idx bigint, contig_id bigint, pos bigint, rc string, dict int, cost int"


def dictionary(reads: DataFrame, windows: list[tuple[int, int]], idx: str = "read_idx", seq: str = "seq", keep: tuple[str, ...] = ()) -> DataFrame:
    """Index entries ``dict``, ``key``, ``read_idx`` of reads longer than each window's end, and columns to keep."""
    entries = [F.when(F.length(seq) > e, F.struct(F.lit(i).alias("dict"), window_key(seq, s, e).alias("key"))) for i, (s, e) in enumerate(windows)]
    rows = reads.select(F.col(idx).alias("read_idx"), F.explode(F.array_compact(F.array(*entries))).alias("e"), *keep)
    return rows.select("e.dict", "e.key", "read_idx", *keep)


def dictionary_bins(reads: DataFrame, windows: list[tuple[int, int]]) -> DataFrame:
    """Number of reads and smallest read of each index bin."""
    return dictionary(reads, windows).groupBy("dict", "key").agg(F.count("*").alias("reads"), F.min("read_idx").alias("first_read"))


def _window_rows(batches: Iterable[pa.RecordBatch], windows: list[tuple[int, int]], shifts: range, both: bool):
    """For each batch, window, strand and shift: reads (as row numbers) and the code of their window moved by the shift.

    Strand 'd' takes letters [s + shift, e + shift], strand 'r' [s - shift, e - shift] of the read as it is.
    """
    for batch in slices(batches, "seq", 1 << 19):
        flat, offsets = flat_text(batch.column("seq"))
        size, start = np.diff(offsets), offsets[:-1]
        for d, (s, e) in enumerate(windows):
            ahead, _, legal = rolling_codes(flat, e - s + 1)
            for shift in shifts:
                for strand, fits, at in (("d", size > e + shift, start + s + shift), ("r", (size + shift > e) & (shift < s), start + s - shift)):
                    if strand == "r" and not both:
                        continue
                    row = np.flatnonzero(fits)
                    row = row[legal[at[row]]]
                    yield batch, strand, d, shift, row, ahead[at[row]]


def probe_batches(batches: Iterable[pa.RecordBatch], windows: list[tuple[int, int]], max_shift: int, same_strand_only: bool) -> Iterator[pa.RecordBatch]:
    for batch, strand, d, shift, row, key in _window_rows(batches, windows, range(max_shift + 1), not same_strand_only):
        n = len(row)
        yield pa.RecordBatch.from_arrays([pa.array([strand] * n, pa.string()), pa.array(np.full(n, d, np.int32)), pa.array(key), pa.array(np.full(n, shift, np.int32)), batch.column("read_idx").take(pa.array(row))], ["strand", "dict", "key", "shift", "read_idx"])


def index_batches(batches: Iterable[pa.RecordBatch], windows: list[tuple[int, int]], same_strand_only: bool) -> Iterator[pa.RecordBatch]:
    """Windows of the reads, and of the reads turned, as index keys."""
    for batch in slices(batches, "seq", 1 << 19):
        flat, offsets = flat_text(batch.column("seq"))
        size, start = np.diff(offsets), offsets[:-1]
        for d, (s, e) in enumerate(windows):
            ahead, back, legal = rolling_codes(flat, e - s + 1)
            long = np.flatnonzero(size > e)
            for strand, codes, at in (("d", ahead, start + s), ("r", back, start + size - 1 - e)):
                if strand == "r" and same_strand_only:
                    continue
                row = long[legal[at[long]]]
                yield pa.RecordBatch.from_arrays([pa.array([strand] * len(row), pa.string()), pa.array(np.full(len(row), d, np.int32)), pa.array(codes[at[row]]), batch.column("read_idx").take(pa.array(row))], ["strand", "dict", "key", "read_idx"])


def overlaps(reads: DataFrame, max_len: int, max_shift: int, limit: int = READ_LIMIT, same_strand_only: bool = False) -> DataFrame:
    """Candidate successors of each read, with the read itself as reference.

    A read probes the index with the windows of its own text moved by ``shift``: a match at shift s begins s bases
    after the read on the forward strand, or (strand 'r', other read turned) s bases before it. Kept if the overlap
    differs in at most ``limit`` code bits. Clean reads only (A, C, G, T). Columns ``read_idx``, ``other``, ``shift``,
    ``strand``, ``dict``, ``cost``.
    """
    windows, reads = dictionary_windows(max_len), spread(cut(reads.select("read_idx", "seq")))
    form = "strand string, dict int, key bigint, shift int, read_idx bigint"
    probe = reads.select("read_idx", "seq").mapInArrow(lambda it: probe_batches(it, windows, max_shift, same_strand_only), form)
    keys = reads.select("read_idx", "seq").mapInArrow(lambda it: index_batches(it, windows, same_strand_only), "strand string, dict int, key bigint, read_idx bigint")
    newest = W.partitionBy("strand", "dict", "key").orderBy(F.desc("read_idx"))
    index = keys.withColumn("_n", F.row_number().over(newest)).where(F.col("_n") <= BIN_LIMIT).select("strand", "dict", "key", F.col("read_idx").alias("other"))
    near = probe.join(small(cut(index)), ["strand", "dict", "key"]).where("read_idx <> other")
    texts = reads.select("read_idx", F.col("seq").alias("a"))
    both = near.join(texts, "read_idx").join(texts.select(F.col("read_idx").alias("other"), F.col("a").alias("o")), "other")
    b = F.when(F.col("strand") == "r", revcomp("o")).otherwise(F.col("o"))
    both = both.withColumn("b", b)
    back = F.col("strand") == "r"
    size = F.when(back, F.least(F.length("a"), F.length("b") - F.col("shift"))).otherwise(F.least(F.length("a") - F.col("shift"), F.length("b")))
    own = F.when(back, F.substr("a", F.lit(1), size)).otherwise(F.substr("a", F.col("shift") + 1, size))
    their = F.when(back, F.substr("b", F.col("shift") + 1, size)).otherwise(F.substr("b", F.lit(1), size))
    return both.where(size > 0).withColumn("cost", cost2(own, their)).where(F.col("cost") <= limit).select("read_idx", "other", "shift", "strand", "dict", "cost")


def best_overlap(found: DataFrame) -> DataFrame:
    """The first of each read's overlaps in the order shift, strand, index, newest read."""
    first = F.min_by(F.struct("other", "shift", "strand", "dict", "cost"), F.struct("shift", "strand", "dict", -F.col("other")))
    return found.groupBy("read_idx").agg(first.alias("m")).select("read_idx", "m.*")


def contig_windows(contigs: DataFrame, part: int, beyond: int) -> DataFrame:
    """Whole contigs as the packed windows that ``rescue_in_windows`` takes."""

    def batches_of(batches):
        for batch in slices(batches, "seq"):
            flat, offsets = flat_text(batch.column("seq"))
            start, row = ranges(np.zeros(batch.num_rows, np.int64), -(-np.diff(offsets) // part))
            start *= part
            size = np.minimum(np.diff(offsets)[row] - start, part + beyond)
            edges = [0, *(np.flatnonzero(np.diff(np.cumsum(size) >> 18)) + 1).tolist(), len(row)]
            for a, b in zip(edges, edges[1:]):
                text = flat[ranges(offsets[row[a:b]] + start[a:b], size[a:b])[0]]
                texts = pa.StringArray.from_buffers(b - a, pa.py_buffer(np.append(0, np.cumsum(size[a:b])).astype(np.int32).tobytes()), pa.py_buffer(text.tobytes()))
                yield pa.RecordBatch.from_arrays([batch.column("contig_id").take(pa.array(row[a:b])), pa.array(start[a:b]), texts], ["contig_id", "from", "seq"])

    return contigs.select("contig_id", "seq").mapInArrow(lambda it: pack(batches_of(it)), PACKED)


def window_shape(max_len: int, longest: int) -> tuple[int, int]:
    """Steps between windows of contigs, and letters a window has more than that, so that a read of up to ``longest`` letters fits in one."""
    return max(PART, max_len, longest), max(max_len, longest)


def _entries(batch: pa.RecordBatch, windows: list[tuple[int, int]], widths: list[int]) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """Index entries of reads: number of the window, rows, keys, and whether the keys are turned.

    A key is the smaller code of a window and of the window turned.
    """
    flat, offsets = flat_text(batch.column("seq"))
    digit = np.full(256, -1, np.int64)
    digit[list(b"ACGT")] = range(4)
    for d, (s, e) in enumerate(windows):
        row = np.flatnonzero(np.diff(offsets) > e)
        at, width = offsets[row] + s, e - s + 1
        ahead, back, legal = np.zeros(len(row), np.int64), np.zeros(len(row), np.int64), np.ones(len(row), bool)
        for i in range(width):
            part = digit[flat[at + i]]
            ahead = ahead << 2 | (part & 3)
            back |= (3 - (part & 3)) << (2 * i)
            legal &= part >= 0
        yield d, row[legal], np.minimum(ahead, back)[legal] | widths.index(width) << 58, (back < ahead)[legal]


def firsts(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of packed reads the first of each text."""
    for batch in unpack(batches):
        yield batch.filter(pc.equal(batch.column("read_idx"), batch.column("first_read")))


_LETTERS = np.frombuffer(b"ACGTN", np.uint8)
_THREE = np.stack([_LETTERS[np.arange(125) // 25], _LETTERS[np.arange(125) // 5 % 5], _LETTERS[np.arange(125) % 5]], axis=1)


def _squeezed(values: pa.Array) -> pa.Array:
    """Texts over A, C, G, T, N, three letters a byte."""
    flat, offsets = flat_text(values)
    digit = np.zeros(256, np.uint8)
    digit[_LETTERS] = range(5)
    size = -(-np.diff(offsets) // 3)
    ends = np.append(0, np.cumsum(size))
    digits = np.zeros(int(ends[-1]) * 3, np.uint8)
    digits[ranges(ends[:-1] * 3, np.diff(offsets))[0]] = digit[flat]
    out = digits[0::3] * 25 + digits[1::3] * 5 + digits[2::3]
    return pa.Array.from_buffers(pa.binary(), len(values), [None, pa.py_buffer(ends.astype(np.int32).tobytes()), pa.py_buffer(out.tobytes())])


def _letters(values: pa.Array, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Letters of squeezed texts of the given lengths end to end, and their offsets."""
    flat, offsets = flat_text(values)
    return _THREE[flat].reshape(-1)[ranges(offsets[:-1] * 3, size)[0]], np.append(0, np.cumsum(size))


def entry_batches(batches: Iterable[pa.RecordBatch], windows: list[tuple[int, int]], widths: list[int]) -> Iterator[pa.RecordBatch]:
    """Index entries with squeezed texts; ``mark`` is 4 times the length, 2 times the number of the window, and whether the key is turned."""
    for batch in slices(batches, "seq", 1 << 20):
        size = pc.binary_length(batch.column("seq")).to_numpy()
        texts = _squeezed(batch.column("seq"))
        for d, row, key, turned in _entries(batch, windows, widths):
            take = pa.array(row)
            yield pa.RecordBatch.from_arrays([pa.array(key), pa.array((size[row] * 4 + 2 * d + turned).astype(np.int32)), batch.column("read_idx").take(take), texts.take(take)], ["key", "mark", "read_idx", "text"])


def window_batches(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Windows of contigs as rows beside candidates; ``mark`` is minus the length."""
    for batch in slices(batches, "seq", 1 << 20):
        size = pc.binary_length(batch.column("seq")).to_numpy()
        yield pa.RecordBatch.from_arrays([batch.column("contig_id"), batch.column("from"), pa.array((-size).astype(np.int32)), pa.array(np.full(len(size), -1)), _squeezed(batch.column("seq"))], ["contig_id", "pos", "mark", "read_idx", "text"])


def _keys_at(flat: np.ndarray, width: int, number: int, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places among ``at`` with a key, the keys, and whether they are turned; a window that is its own complement counts as both."""
    ahead, back, legal = rolling_codes(flat, width)
    at = at[legal[at]]
    a, b = ahead[at], back[at]
    both = np.flatnonzero(a == b)
    key = np.minimum(a, b) | number << 58
    return np.append(at, at[both]), np.append(key, key[both]), np.append(b < a, np.ones(len(both), bool)).astype(np.int64)


def sieve(reads: DataFrame, count: int, windows: list[tuple[int, int]], widths: list[int]) -> tuple[np.ndarray, int]:
    """A table of bits with one set for each key of the reads, of at most 2^28 bits, and the logarithm of its size."""
    log = min(28, max(16, (32 * len(windows) * count).bit_length()))

    def places(batches):
        for batch in slices(firsts(batches), "seq", 1 << 20):
            for _, _, key, _ in _entries(batch, windows, widths):
                spot = np.unique(mix(key) >> np.uint64(64 - log)).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(spot >> 16), pa.array(spot & 0xFFFF)], ["block", "bit"])

    def blocks(batches):
        held = {}
        for batch in batches:
            block, bit = batch.column("block").to_numpy(), batch.column("bit").to_numpy()
            for k in np.unique(block).tolist():
                held.setdefault(k, np.zeros(1 << 16, bool))[bit[block == k]] = True
        for k, bits in held.items():
            yield pa.RecordBatch.from_arrays([pa.array([k], pa.int64()), pa.array([np.packbits(bits, bitorder="little").tobytes()], pa.binary())], ["block", "bits"])

    table = np.zeros(1 << (log - 3), np.uint8)
    rows = reads.mapInArrow(places, "block bigint, bit bigint").repartition("block")
    for r in rows.mapInArrow(blocks, "block bigint, bits binary").toLocalIterator():
        table[r.block << 13 : (r.block + 1) << 13] = np.frombuffer(r.bits, np.uint8)
    return table, log


def contig_key_batches(batches: Iterable[pa.RecordBatch], widths: list[int], part: int, table: np.ndarray, log: int) -> Iterator[pa.RecordBatch]:
    """Keys of the contigs that pass the sieve; ``spot`` is twice the position, and one more if the key is turned."""
    for batch in slices(batches, "seq"):
        flat, offsets = flat_text(batch.column("seq"))
        size, base = np.diff(offsets), batch.column("from").to_numpy()
        for number, width in enumerate(widths):
            at = ranges(offsets[:-1], np.clip(size - width + 1, 0, part))[0]
            at, key, turned = _keys_at(flat, width, number, at)
            place = (mix(key) >> np.uint64(64 - log)).astype(np.int64)
            keep = np.flatnonzero(table[place >> 3] >> (place & 7).astype(np.uint8) & 1)
            at, key, turned = at[keep], key[keep], turned[keep]
            row = np.searchsorted(offsets, at, "right") - 1
            yield pa.RecordBatch.from_arrays([batch.column("contig_id").take(pa.array(row)), pa.array(key), pa.array((base[row] + at - offsets[row]) * 2 + turned)], ["contig_id", "key", "spot"])


def _costs(a: np.ndarray, at: np.ndarray, b: np.ndarray, there: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Differing code bits of ``size`` letters of ``a`` from ``at`` and of ``b`` from ``there``, a bounded number of letters at a time."""
    out = np.zeros(len(size), np.int64)
    edges = [0, *(np.flatnonzero(np.diff(np.cumsum(size) >> 19)) + 1).tolist(), len(size)]
    for i, j in zip(edges, edges[1:]):
        if j > i:
            step, row = ranges(np.zeros(j - i, np.int64), size[i:j])
            total = np.append(0, np.cumsum(prices(a[at[i:j][row] + step], b[there[i:j][row] + step]), dtype=np.int64))
            ends = np.cumsum(size[i:j])
            out[i:j] = total[ends] - total[ends - size[i:j]]
    return out


def _placed(read, contig, pos, back, which, cost) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(read), pa.array(contig), pa.array(pos), pa.array(np.where(back, "r", "d").tolist(), pa.string()), pa.array(which.astype(np.int32)), pa.array(cost.astype(np.int32))], ["read_idx", "contig_id", "pos", "rc", "dict", "cost"])


def check_batches(batches: Iterable[pa.RecordBatch], max_len: int, limit: int) -> Iterator[pa.RecordBatch]:
    """Rows sorted by contig and window, each window before its candidates, in; candidates within the limit out."""
    held = None
    for batch in slices(batches, "text", 1 << 17):
        rows = pa.Table.from_batches([batch] if held is None else [held, batch]).combine_chunks()
        mark, pos = rows.column("mark").to_numpy(), rows.column("pos").to_numpy()
        window = np.maximum.accumulate(np.where(mark < 0, np.arange(len(mark)), 0))
        held = rows.slice(window[-1], 1).to_batches()[0]
        size, back = np.where(mark < 0, -mark, mark >> 2).astype(np.int64), (mark >= 0) & (mark & 1 > 0)
        flat, offsets = _letters(rows.column("text").combine_chunks(), size)
        shift = pos - pos[window]
        keep = np.flatnonzero((mark >= 0) & (shift + np.maximum(size, np.where(back, 0, max_len)) <= size[window]))
        if not len(keep):
            continue
        there = offsets[window[keep]] + shift[keep]
        cost = _costs(turned_letters(flat, offsets, back), offsets[keep], flat, there, size[keep])
        near = cost <= limit
        keep = keep[near]
        yield _placed(rows.column("read_idx").to_numpy()[keep], rows.column("contig_id").to_numpy()[keep], pos[keep], back[keep], mark[keep] >> 1 & 1, cost[near])


def crowd_batches(batches: Iterable[pa.RecordBatch], entries: pa.Table, windows: list[tuple[int, int]], widths: list[int], max_len: int, part: int, limit: int) -> Iterator[pa.RecordBatch]:
    """Windows of contigs in; the first place of each of the given reads in some windows out. All places are tried.

    The codes of whole stretches of ``width`` letters come first: their differing bits are a part of the cost.
    """
    entries = entries.sort_by("key").combine_chunks()
    ekey, mark, eread = (entries.column(c).to_numpy() for c in ("key", "mark", "read_idx"))
    esize, ewhich, eturned = (mark >> 2).astype(np.int64), mark >> 1 & 1, mark & 1
    text, starts = _letters(entries.column("text").combine_chunks(), esize)
    starts = starts[:-1]
    n, width = len(text), widths[0]
    # the reads as they are, then turned
    text = np.append(text, turned_letters(text, np.append(starts, n), np.ones(len(esize), bool)))
    rcode, _, rlegal = rolling_codes(text, width)
    first, last = (np.array([w[i] for w in windows]) for i in (0, 1))
    names = np.unique(ekey)
    for batch in slices(batches, "seq"):
        flat, offsets = flat_text(batch.column("seq"))
        size, base, contig = np.diff(offsets), batch.column("from").to_numpy(), batch.column("contig_id").to_numpy()
        ccode, _, clegal = rolling_codes(flat, width)
        found = []
        for number, w in enumerate(widths):
            at, key, turned = _keys_at(flat, w, number, ranges(offsets[:-1], np.maximum(size - w + 1, 0))[0])
            hit = np.flatnonzero(names[np.minimum(np.searchsorted(names, key), len(names) - 1)] == key)
            hit = hit[np.argsort(key[hit], kind="stable")]
            at, key, turned = at[hit], key[hit], turned[hit]
            low, high = np.searchsorted(key, ekey, "left"), np.searchsorted(key, ekey, "right")
            edges = [0, *(np.flatnonzero(np.diff(np.cumsum(high - low) >> 18)) + 1).tolist(), len(low)]
            for a, b in zip(edges, edges[1:]):
                i, e = ranges(low[a:b], (high - low)[a:b])
                e += a
                back = turned[i] != eturned[e]
                row = np.searchsorted(offsets, at[i], "right") - 1
                spot = base[row] + at[i] - offsets[row]
                spot -= np.where(back, max_len - 1 - last[ewhich[e]], first[ewhich[e]])
                pos = np.where(back, spot + max_len - esize[e], spot)
                inside = pos - base[row]
                # another window has the places beyond the steps between windows
                ok = np.flatnonzero((spot >= 0) & (inside >= 0) & (inside < part) & (inside + np.maximum(esize[e], np.where(back, 0, max_len)) <= size[row]))
                e, back, row, pos, inside = e[ok], back[ok], row[ok], pos[ok], inside[ok]
                here, own, least = offsets[row] + inside, starts[e] + n * back, np.zeros(len(e), np.int64)
                for k in range(0, int(esize.max()) - width + 1, width):
                    go = np.flatnonzero(k + width <= esize[e])
                    x, y = here[go] + k, own[go] + k
                    least[go] += np.where(clegal[x] & rlegal[y], np.bitwise_count(ccode[x] ^ rcode[y]), 0)
                    go = np.flatnonzero(least <= limit)
                    e, back, row, pos, here, own, least = e[go], back[go], row[go], pos[go], here[go], own[go], least[go]
                cost = _costs(text, own, flat, here, esize[e])
                go = np.flatnonzero(cost <= limit)
                found.append(np.stack([eread[e[go]], contig[row[go]], pos[go], back[go], ewhich[e[go]], cost[go]]))
        found = np.concatenate(found, axis=1)
        found = found[:, np.lexsort(found[4::-1])]
        yield _placed(*found[:, np.unique(found[0], return_index=True)[1]])


def rescue(contigs: DataFrame, reads: DataFrame, max_len: int, limit: int = RESCUE_LIMIT) -> DataFrame:
    """``rescue_in_windows`` of whole contigs (``contig_id``, ``seq``)."""
    part, beyond = window_shape(max_len, reads.agg(F.max(F.length("seq"))).first()[0] or 0)
    return rescue_in_windows(cut(contig_windows(contigs, part, beyond)), reads, max_len, part, limit)


def rescue_in_windows(contigs: DataFrame, reads: DataFrame, max_len: int, part: int, limit: int = RESCUE_LIMIT) -> DataFrame:
    """Place reads on contigs: earliest contig and position whose window agrees within ``limit`` code bits.

    ``contigs`` (``contig_id``, ``from``, ``seq``) is a written, packed table of windows of the shape that ``window_shape`` gives. Only contigs
    of at least ``max_len`` bases are searched. Columns ``read_idx``, ``contig_id``, ``pos``, ``rc``, ``cost``; reads that fit nowhere are absent.
    Every read of an index bin is tried; equal reads are tried once. Contigs and reads meet by key; candidates go to their window. A key
    with more than ``CROWDED`` places would give too many of them; the reads with such keys are few and go to all windows instead.
    """
    context = reads.sparkSession.sparkContext
    every = reads.select("read_idx", F.min("read_idx").over(W.partitionBy("seq")).alias("first_read"), "seq")
    reads = cut(every.mapInArrow(pack, PACKED))
    sweep(reads.sparkSession)
    alike = reads.mapInArrow(lambda it: (b.select(["read_idx", "first_read"]) for b in unpack(it)), "read_idx bigint, first_read bigint")
    windows = [(0, 20), (21, 41)] if max_len > 50 else [(0, 20 * max_len // 50), (20 * max_len // 50 + 1, 41 * max_len // 50)]
    windows = [(s, min(e, max_len - 1)) for s, e in windows]
    widths = sorted({e - s + 1 for s, e in windows})
    index = reads.mapInArrow(lambda it: entry_batches(firsts(it), windows, widths), "key bigint, mark int, read_idx bigint, text binary")
    shared = context.broadcast(sieve(reads, alike.count(), windows, widths))
    keys = cut(spread(contigs).mapInArrow(lambda it: pack(contig_key_batches(unpack(it), widths, part, *shared.value)), PACKED))
    keys = keys.mapInArrow(unpack, "contig_id bigint, key bigint, spot bigint")
    shared.unpersist()
    crowd = cut(keys.groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") > CROWDED).select("key"))
    crowds = crowd.count()
    few = keys.join(small(crowd, crowds), "key", "left_anti") if crowds else keys
    turned, which, size = F.col("mark").bitwiseAND(F.lit(1)), F.shiftright("mark", 1).bitwiseAND(F.lit(1)), F.shiftright("mark", 2)
    back = F.col("spot").bitwiseAND(F.lit(1)) != turned
    ahead = F.element_at(F.array(*[F.lit(s) for s, _ in windows]), which + 1)
    behind = F.element_at(F.array(*[F.lit(max_len - 1 - e) for _, e in windows]), which + 1)
    near = few.join(index, "key").withColumn("back", back).withColumn("at", F.shiftright("spot", 1) - F.when(F.col("back"), behind).otherwise(ahead))
    near = near.withColumn("pos", F.when(F.col("back"), F.col("at") + max_len - size).otherwise(F.col("at"))).where("at >= 0 and pos >= 0")
    near = near.select("contig_id", "pos", (F.col("mark") - turned + F.col("back").cast("int")).alias("mark"), "read_idx", "text")
    texts = contigs.mapInArrow(lambda it: window_batches(unpack(it)), "contig_id bigint, pos bigint, mark int, read_idx bigint, text binary")
    # by a hash: see the note on equal partitionings in ``helixmill.functions.flat.whole_groups``
    number = F.floor(F.col("pos") / part)
    rows = texts.unionByName(near).repartition(F.xxhash64("contig_id", number)).sortWithinPartitions("contig_id", number, "mark")
    checked = rows.mapInArrow(lambda it: check_batches(it, max_len, limit), _FOUND)
    if crowds:
        entries = cut(index.join(small(crowd, crowds), "key"))
        passes = -(-(entries.agg(F.sum(size + 64)).first()[0] or 0) // CROWD_LETTERS)
        for k in range(passes):
            share = entries.where(F.pmod(F.xxhash64("read_idx"), F.lit(passes)) == k).toArrow()
            if not share.num_rows:
                continue
            some = context.broadcast(share)
            here = spread(contigs).mapInArrow(lambda it, some=some: crowd_batches(unpack(it), some.value, windows, widths, max_len, part, limit), _FOUND)
            checked = checked.unionByName(cut(here))
            some.unpersist()
    best = F.min_by(F.struct("contig_id", "pos", "rc", "cost"), F.struct("contig_id", "pos", "rc", "dict"))
    found = checked.groupBy("read_idx").agg(best.alias("m")).select("read_idx", "m.*")
    return alike.join(found.withColumnRenamed("read_idx", "first_read"), "first_read").select("read_idx", "contig_id", "pos", "rc", "cost")
