"""Numpy helpers for Arrow batches of strings laid end to end."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: equal inputs give equal outputs on every machine."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def slices(batches: Iterable[pa.RecordBatch], column: str, letters: int = 1 << 18) -> Iterator[pa.RecordBatch]:
    """Cut Arrow batches so that ``column`` has about ``letters`` bytes a piece; one value is never cut."""
    for batch in batches:
        if not batch.num_rows:
            continue
        size = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        group = np.cumsum(size, dtype=np.int64) // letters
        edges = [0, *(np.flatnonzero(np.diff(group)) + 1).tolist(), batch.num_rows]
        for a, b in zip(edges, edges[1:]):
            if b > a:
                yield batch.slice(a, b - a)


def flat_text(values: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string array without nulls, and the n + 1 offsets of its values."""
    values = values.cast(pa.large_binary())
    offsets = np.frombuffer(values.buffers()[1], np.int64)[values.offset : values.offset + len(values) + 1]
    data = values.buffers()[2]
    flat = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None else np.zeros(0, np.uint8)
    return flat, offsets - offsets[0]


def ranges(start: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each i the numbers start[i] .. start[i] + count[i] - 1, end to end, and the i of each."""
    owner = np.repeat(np.arange(len(start)), count)
    first = np.cumsum(count) - count
    return np.arange(len(owner)) - first[owner] + start[owner], owner


def turned_letters(flat: np.ndarray, offsets: np.ndarray, back: np.ndarray) -> np.ndarray:
    """Texts end to end, those of ``back`` as reverse complements."""
    size = np.diff(offsets)
    at, row = ranges(offsets[:-1], size)
    mirror = offsets[row] + offsets[row + 1] - 1 - at
    other = np.arange(256, dtype=np.uint8)
    other[list(b"ACGT")] = list(b"TGCA")
    return np.where(back[row], other[flat[mirror]], flat)


def whole_groups(batches: Iterable[pa.RecordBatch], names: list[str]) -> Iterator[pa.Table]:
    """Rows sorted by ``names`` (whole numbers), cut so that no group of equal ``names`` is divided.

    The rows of a group must lie in one partition. A ``repartition`` by the very columns of a join or aggregate below it
    is optimised away, and plan changes made at run time (joins turned into broadcasts, split partitions) then don't keep
    the groups whole for a map; partition by a hash of the columns instead.
    """
    held: pa.Table | None = None
    for batch in batches:
        if not batch.num_rows:
            continue
        rows = pa.Table.from_batches([batch] if held is None else [*held.to_batches(), batch])
        last = np.ones(rows.num_rows, bool)
        for name in names:
            column = rows.column(name).to_numpy()
            last &= column == column[-1]
        at = rows.num_rows - int(last[::-1].argmin()) if not last.all() else 0
        if at:
            yield rows.slice(0, at).combine_chunks()
        held = rows.slice(at)
    if held is not None:
        yield held.combine_chunks()
