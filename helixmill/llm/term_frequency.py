"""Occurrences and record frequency of every term, in a vertical layout.

Records are divided into blocks of 2^16 ids. For every (term, block) there is one container: the low 16 bits of the ids
that hold the term, in the shortest of three forms, with a counter beside each id. Tasks build containers of the records
they read, a bounded number of letters at a time; these are what travels. Containers of one (term, block) are then
united by id (an id in several keeps its larger counter), and the record frequency of a term is the sum of the
cardinalities of its united containers, its occurrences that of their counters.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from helixmill.llm.arrays import flat_text, slices

#: ids of a block; ids that lie side by side in a task; letters after which a task lets its containers go
BLOCK, NEAR, FLUSH = 16, 14, 1 << 21
GAPS, BITS, PLAIN = 0, 1, 2
LAYOUT = "term string, block bigint, ids binary, counters binary"
LOW = (1 << BLOCK) - 1


def heads(key: np.ndarray) -> np.ndarray:
    return np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)


def pieces(flat: np.ndarray, size: np.ndarray) -> pa.Array:
    """Consecutive parts of ``flat`` of the given sizes in bytes."""
    offsets = np.append(0, np.cumsum(size)).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(size), [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(flat.tobytes())])


def pack_ids(low: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, list[pa.Array]]:
    """Containers of ``size`` sorted distinct 16-bit ids each; the order in which they come, and their bytes.

    The first byte tells the form: gaps (a byte each, 255 standing for 255 more), 8 KB of bits, or ids of two bytes.
    """
    if not len(size):
        return np.zeros(0, np.int64), []
    low, head = low.astype(np.uint16, copy=False), np.cumsum(size) - size
    gap = np.empty_like(low)
    gap[1:] = low[1:] - low[:-1] - np.uint16(1)
    gap[head] = low[head]
    more = gap // np.uint16(255)
    length = np.add.reduceat(more, head, dtype=np.int64) + size
    form = np.argmin(np.stack([length, np.full(len(size), 1 << (BLOCK - 3)), 2 * size]), axis=0)
    order, out = [], []
    for kind in (GAPS, BITS, PLAIN):
        own = np.flatnonzero(form == kind)
        if not len(own):
            continue
        order.append(own)
        inside = slice(None) if len(own) == len(size) else np.repeat(form == kind, size)
        ids, first = low[inside], np.cumsum(size[own]) - size[own]
        if kind == BITS:
            bits = np.zeros((len(own), 1 << BLOCK), np.uint8)
            bits[np.repeat(np.arange(len(own)), size[own]), ids] = 1
            body = np.packbits(bits, axis=1, bitorder="little")
            out.append(pieces(np.concatenate([np.full((len(own), 1), BITS, np.uint8), body], 1).ravel(), np.full(len(own), body.shape[1] + 1)))
            continue
        width = more[inside] + np.int64(1) if kind == GAPS else np.full(len(ids), 2)
        width[first] += 1  # the form
        end = np.cumsum(width)
        flat = np.full(int(end[-1]), 255, np.uint8)
        flat[end[first] - width[first]] = kind
        if kind == GAPS:
            flat[end - 1] = gap[inside] - more[inside] * np.uint16(255)
        else:
            flat[end - 2], flat[end - 1] = ids & 255, ids >> 8
        out.append(pieces(flat, length[own] + 1 if kind == GAPS else 2 * size[own] + 1))
    return np.concatenate(order), out


def unpack_sized(containers: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All ids of the containers in order, and the number in each."""
    flat, offsets = flat_text(containers)
    kind, length = flat[offsets[:-1]], np.diff(offsets)
    number, found = np.zeros(len(kind), np.int64), []
    for form in (GAPS, BITS, PLAIN):
        own = kind == form
        if not own.any():
            continue
        body = flat if own.all() else flat[np.repeat(own, length)]
        size = length[own]
        head = np.cumsum(size) - size
        if form == GAPS:
            ends = body != 255
            ends[head] = False
            total = np.cumsum(body + ends, dtype=np.uint16)  # ids are differences of sums below 2^16, so these may overflow
            at = np.flatnonzero(ends)
            count = np.diff(np.searchsorted(at, np.append(head, len(body))))
            low = total[at] - np.repeat(total[head] + np.uint16(1), count)
        elif form == PLAIN:
            rest = np.ones(len(body), bool)
            rest[head] = False
            low, count = body[rest].view("<u2"), (size - 1) // 2
        else:
            each = [np.flatnonzero(np.unpackbits(body[h + 1 : h + s], bitorder="little")) for h, s in zip(head.tolist(), size.tolist())]
            low, count = np.concatenate(each).astype(np.uint16), np.array([len(x) for x in each])
        number[own] = count
        found.append((own, low))
    if len(found) == 1:
        return found[0][1], number
    out = np.zeros(int(number.sum()), np.uint16)
    for own, low in found:
        out[np.repeat(own, number)] = low
    return out, number


def unpack_ids(containers: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All ids of the containers and the container of each, in order."""
    low, number = unpack_sized(containers)
    return low, np.repeat(np.arange(len(number)), number)


def places(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The numbers start[i] .. start[i] + size[i] - 1, end to end."""
    return np.repeat(start - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))


def pack_counters(count: np.ndarray, size: np.ndarray) -> pa.Array:
    """Counters in the order of the ids: bytes of a counter above 1, a bit an id that has such a one, and these counters.

    Empty if all are 1.
    """
    if not len(size):
        return pa.array([], pa.binary())
    head = np.cumsum(size) - size
    at = np.flatnonzero(count > 1)
    values = count[at]
    edge = np.searchsorted(at, np.append(head, len(count)))
    number = np.diff(edge)
    has = number > 0
    width = np.ones(len(size), np.int64)
    if len(at):
        width[has] = np.where(np.maximum.reduceat(values, edge[:-1][has]) < 256, 1, 4)
    room = (size + 7) // 8
    bits = np.where(has, room, 0)
    length = np.where(has, 1 + bits + number * width, 0)
    start = np.cumsum(length) - length
    flat = np.zeros(int(length.sum()), np.uint8)
    flat[start[has]] = width[has]
    bit = np.zeros(int(bits.sum()) * 8, np.uint8)
    bit[at + np.repeat((np.cumsum(bits) - bits) * 8 - head, number)] = 1
    flat[places(start[has] + 1, bits[has])] = np.packbits(bit, bitorder="little")
    spot = places(start + 1 + bits, number * width)
    if width.max() == 1:
        flat[spot] = values
    else:
        flat[spot] = values.astype("<u4").view(np.uint8).reshape(-1, 4)[np.arange(4) < np.repeat(width, number)[:, None]]
    return pieces(flat, length)


def unpack_counters(counters: pa.Array, size: np.ndarray) -> np.ndarray:
    flat, offsets = flat_text(counters)
    has = np.flatnonzero(np.diff(offsets) > 0)
    out = np.ones(int(size.sum()), np.int64)
    if not len(has):
        return out
    start, bits = offsets[:-1][has], (size[has] + 7) // 8
    edge = np.append(0, np.cumsum(bits * 8))
    at = np.flatnonzero(np.unpackbits(flat[places(start + 1, bits)], bitorder="little"))
    width, number = flat[start].astype(np.int64), np.diff(np.searchsorted(at, edge))
    spot = np.repeat(start + 1 + bits, number) + places(np.zeros(len(has), np.int64), number) * np.repeat(width, number)
    value = flat[spot].astype(np.int64)
    if width.max() > 1:
        wide = np.repeat(width == 4, number)
        for k in (1, 2, 3):
            value[wide] |= flat[spot[wide] + k].astype(np.int64) << (8 * k)
    out[at + np.repeat((np.cumsum(size) - size)[has] - edge[:-1], number)] = value
    return out


def united(key: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Keys in order, each once with its larger counter."""
    if len(key) and (key[1:] < key[:-1]).any():
        order = np.argsort(key, kind="stable")
        key, count = key[order], count[order]
    first = heads(key)
    return (key, count) if len(first) == len(key) else (key[first], np.maximum.reduceat(count, first))


def containers(key: np.ndarray, count: np.ndarray, names: pa.Array, blocks: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Containers of (term, block) out of entries of any order; an entry that comes several times keeps its larger counter.

    The key of an entry is (term * number of blocks + place of the block) << BLOCK | low bits of the id.
    """
    key, count = united(key, count)
    if not len(key):
        return
    box = key >> BLOCK
    start = heads(box)
    size = np.diff(np.append(start, len(key)))
    turn, ids = pack_ids(key.astype(np.uint16), size)
    counters = pack_counters(count, size).take(pa.array(turn))
    box = box[start][turn]
    ids = pa.concat_arrays(ids)
    for a in range(0, len(box), 4096):
        b = box[a : a + 4096]
        yield pa.RecordBatch.from_arrays([names.take(pa.array(b // len(blocks))), pa.array(blocks[b % len(blocks)]), ids.slice(a, 4096), counters.slice(a, 4096)], ["term", "block", "ids", "counters"])


def window_codes(flat: np.ndarray, n: int, room: int) -> tuple[np.ndarray, Callable[[np.ndarray], np.ndarray]]:
    """A number for the window of ``n`` symbols at each place, equal for equal windows, and what spells such numbers.

    Numbers leave ``room`` bits free: windows are numbers in the base of the symbols that occur, or else ranks.
    """
    count = len(flat) - n + 1
    letters = np.flatnonzero(np.bincount(flat, minlength=256)) if flat.dtype == np.uint8 else np.unique(flat)
    if flat.dtype == np.uint8:
        digit = np.zeros(256, np.uint8)
        digit[letters] = np.arange(len(letters))
        digit = digit[flat]
    else:
        digit = np.searchsorted(letters, flat).astype(np.uint32)
    bits = (len(letters) ** n - 1).bit_length() + room
    if bits < 64:
        kind = np.uint32 if bits <= 32 else np.int64
        code = digit[:count].astype(kind)
        for k in range(1, n):
            code *= kind(len(letters))
            code += digit[k : k + count]

        def spell(codes: np.ndarray) -> np.ndarray:
            codes = codes.astype(np.int64)
            return letters[np.stack([codes // len(letters) ** (n - 1 - k) % len(letters) for k in range(n)], axis=1)].astype(flat.dtype)

        return code, spell
    rank, size = digit.astype(np.int64), 1
    while size < n:  # windows of twice the size, as pairs of smaller ones; the last step overlaps
        step = min(size, n - size)
        pair = rank[: len(rank) - step] * (int(rank.max(initial=0)) + 1) + rank[step:]
        rank, size = np.unique(pair, return_inverse=True)[1].astype(np.int64), size + step
    where = np.zeros(int(rank.max()) + 1, np.int64)
    where[rank] = np.arange(count)
    return rank, lambda codes: flat[where[codes][:, None] + np.arange(n)]


def term_entries(ids: np.ndarray, text: pa.Array, n: int) -> Iterator[pa.RecordBatch]:
    """Containers of a bounded number of texts."""
    plain = pc.all(pc.equal(pc.binary_length(text), pc.utf8_length(text))).as_py() is not False
    if plain:
        flat, offsets = flat_text(text)
    else:
        flat = np.frombuffer("".join(text.to_pylist()).encode("utf-32-le"), np.uint32)
        offsets = np.append(0, np.cumsum(pc.utf8_length(text).to_numpy(zero_copy_only=False)))
    ends = len(flat) - n + 1
    if ends <= 0:
        return
    inside = np.ones(len(flat), bool)
    for k in range(1, n):  # a window that begins here ends in another text
        inside[np.maximum(offsets[1:] - k, 0)[offsets[1:] >= k]] = False
    inside = inside[:ends]
    room = len(ids).bit_length()
    code, spell = window_codes(flat, n, room)
    turn = np.argsort(ids, kind="stable")
    rank = np.empty(len(ids), code.dtype)
    rank[turn] = np.arange(len(ids))
    key = code << code.dtype.type(room)
    key |= np.repeat(rank, np.diff(offsets))[:ends]
    key = np.sort(key[inside])  # a row of the texts is a record once
    head = heads(key)
    if not len(head):
        return
    key, count = key[head], np.diff(np.append(head, len(key)))
    code, ids = key >> code.dtype.type(room), ids[turn]
    new = np.concatenate([[True], code[1:] != code[:-1]])
    symbols = spell(code[new])
    if plain:
        names = pieces(symbols, np.full(len(symbols), n)).cast(pa.string())
    else:
        letters = symbols.tobytes().decode("utf-32-le")
        names = pa.array([letters[i : i + n] for i in range(0, len(letters), n)], pa.string())
    blocks, spot = np.unique(ids >> BLOCK, return_inverse=True)
    entry = spot << BLOCK | ids & LOW
    row = (key & key.dtype.type((1 << room) - 1)).astype(np.int64)
    yield from containers((np.cumsum(new) - 1) * (len(blocks) << BLOCK) + entry[row], count, names, blocks)


def layout_batches(batches: Iterable[pa.RecordBatch], n: int) -> Iterator[pa.RecordBatch]:
    """Records in, containers out; texts of ``FLUSH`` letters (one at least) are held at a time."""
    held, letters = [], 0

    def out() -> Iterator[pa.RecordBatch]:
        rows = pa.Table.from_batches(held).combine_chunks()
        text = rows.column("text").cast(pa.large_string()).combine_chunks()
        yield from term_entries(rows.column("rid").to_numpy(), text.chunk(0) if isinstance(text, pa.ChunkedArray) else text, n)

    for batch in slices(batches, "text", 1 << 19):
        size = pc.sum(pc.binary_length(batch.column("text"))).as_py() or 0
        if held and letters + size > FLUSH:
            yield from out()
            held, letters = [], 0
        held.append(batch.select(["rid", "text"]))
        letters += size
    if held:
        yield from out()


def whole_boxes(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Rows sorted by term and block, cut so that no (term, block) is divided; the one at hand is held."""
    held: pa.Table | None = None
    for batch in batches:
        if not batch.num_rows:
            continue
        rows = pa.Table.from_batches([batch] if held is None else [*held.to_batches(), batch])
        block = rows.column("block").to_numpy()
        last = (block == block[-1]) & pc.equal(rows.column("term"), rows.column("term")[-1]).to_numpy()
        cut_at = int(np.flatnonzero(~last)[-1]) + 1 if not last.all() else 0
        if cut_at:
            yield rows.slice(0, cut_at).combine_chunks()
        held = rows.slice(cut_at)
    if held is not None:
        yield held.combine_chunks()


def unite_batches(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by term and block in, one container of each out."""
    for rows in whole_boxes(batches):
        column = lambda c: rows.column(c).chunk(0)  # noqa: B023, E731
        names = pc.dictionary_encode(column("term"))
        low, size = unpack_sized(column("ids"))
        blocks, spot = np.unique(column("block").to_numpy(), return_inverse=True)
        box = names.indices.to_numpy().astype(np.int64) * len(blocks) + spot
        yield from containers(np.repeat(box << BLOCK, size) | low, unpack_counters(column("counters"), size), names.dictionary, blocks)


def count_batches(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by term and block in, cardinality and counter sum of each united container out.

    Containers whose ids lie behind one another unite by addition; only where they overlap are their ids merged.
    """
    for rows in whole_boxes(batches):
        term, block, packed, counters = (rows.column(c).chunk(0) for c in ("term", "block", "ids", "counters"))
        low, size = unpack_sized(packed)
        count, head = unpack_counters(counters, size), np.cumsum(size) - size
        number, block = pc.dictionary_encode(term).indices.to_numpy(), block.to_numpy()
        start = np.flatnonzero(np.concatenate([[True], (number[1:] != number[:-1]) | (block[1:] != block[:-1])]))
        box = np.repeat(np.arange(len(start)), np.diff(np.append(start, len(block))))
        records, times = np.add.reduceat(size, start), np.add.reduceat(np.add.reduceat(count, head), start)
        first, last = box << BLOCK | low[head], box << BLOCK | low[head + size - 1]
        turn = np.argsort(first, kind="stable")
        torn = np.zeros(len(start), bool)
        torn[box[turn[1:]][first[turn[1:]] <= last[turn[:-1]]]] = True
        if torn.any():
            own = np.repeat(torn[box], size)
            key, count = united((np.repeat(box << BLOCK, size) | low)[own], count[own])
            begin = heads(key >> BLOCK)
            records[torn], times[torn] = np.diff(np.append(begin, len(key))), np.add.reduceat(count, begin)
        yield pa.RecordBatch.from_arrays([term.take(pa.array(start)), pa.array(records), pa.array(times)], ["term", "records", "occurrences"])


def task_containers(df: DataFrame, rid: str, text: str, n: int) -> DataFrame:
    """Containers as tasks build them, those of a term and block side by side.

    Records of neighbouring ids are brought together first, so that the containers of a task are well filled.
    """
    rows = df.where(F.col(rid).isNotNull() & F.col(text).isNotNull()).select(F.col(rid).cast("bigint").alias("rid"), F.col(text).alias("text"))
    near = rows.repartition(F.shiftright("rid", NEAR)).sortWithinPartitions("rid")
    parts = near.mapInArrow(lambda it: layout_batches(it, n), LAYOUT)
    return parts.repartition("term", "block").sortWithinPartitions("term", "block")


def vertical_layout(df: DataFrame, rid: str, text: str, n: int) -> DataFrame:
    """One container per term of ``n`` consecutive letters and block of 2^16 record ids: ``term``, ``block``, ``ids``, ``counters``."""
    return task_containers(df, rid, text, n).mapInArrow(unite_batches, LAYOUT)


def term_frequency(df: DataFrame, rid: str, text: str, n: int) -> DataFrame:
    """Every window of ``n`` letters of the text with ``records`` that hold it and its ``occurrences``.

    Null ids and null texts are no records; an empty text is a record without terms. A record delivered repeatedly
    counts once. Texts are taken whole, in any alphabet.
    """
    counted = task_containers(df, rid, text, n).mapInArrow(count_batches, "term string, records bigint, occurrences bigint")
    return counted.groupBy("term").agg(F.sum("records").alias("records"), F.sum("occurrences").alias("occurrences"))


def mark(records: Column, total: Column, rare: int, common: float) -> Column:
    """``rare`` up to ``rare`` records, ``common`` above the share ``common`` of all, null between; rare wins."""
    return F.when(records <= rare, "rare").when(records > total * common, "common")
