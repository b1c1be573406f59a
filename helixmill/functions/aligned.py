"""Vectorised comparison of reads with their reference: Arrow functions, where built-in ones work letter by letter.

Each takes string columns of equal length per row; nulls give null.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import types as T
from pyspark.sql.functions import arrow_udf

from helixmill.functions.flat import flat_text
from helixmill.functions.seq import SUBSTITUTES

NOISE = T.ArrayType(T.StructType([T.StructField("dpos", T.IntegerType()), T.StructField("code", T.StringType())]))


def _table(entries: dict[tuple[str, str], int]) -> np.ndarray:
    out = np.zeros((256, 256), np.int16)
    for (a, b), v in entries.items():
        out[ord(a), ord(b)] = v
    return out


_NARROW = {"A": 0, "C": 1, "G": 2, "T": 3}
_WIDE = _NARROW | {"N": 4}
_PRICE = {wide: _table({(a, b): (i ^ j).bit_count() for a, i in code.items() for b, j in code.items()}) for wide, code in ((False, _NARROW), (True, _WIDE))}
_CODE = _table({(r, s): i for r, subs in SUBSTITUTES.items() for i, s in enumerate(subs)})
_BASE = _table({(r, str(i)): ord(s) for r, subs in SUBSTITUTES.items() for i, s in enumerate(subs)})


def _both(a: pa.Array, b: pa.Array):
    """Letters of both columns where neither is null, offsets, and the mask of those rows."""
    ok = pc.and_(pc.is_valid(a), pc.is_valid(b))
    fa, oa = flat_text(a.filter(ok))
    fb, ob = flat_text(b.filter(ok))
    if not np.array_equal(oa, ob):
        raise ValueError("strings to compare differ in length")
    return fa, fb, oa, ok


def _spread(values: pa.Array, ok: pa.Array) -> pa.Array:
    """Values at the rows of the mask, null elsewhere."""
    at = np.cumsum(ok.to_numpy(zero_copy_only=False)) - 1
    return values.take(pa.array(at, mask=~ok.to_numpy(zero_copy_only=False)))


def _cost(a: pa.Array, b: pa.Array, wide: bool) -> pa.Array:
    fa, fb, offsets, ok = _both(a, b)
    total = np.concatenate([[0], np.cumsum(_PRICE[wide][fa, fb], dtype=np.int64)])
    return _spread(pa.array((total[offsets[1:]] - total[offsets[:-1]]).astype(np.int32)), ok)


def prices(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Differing bits of the 3-bit codes of each two letters."""
    return _PRICE[True][a, b]


def noise_lists(fr: np.ndarray, ff: np.ndarray, offsets: np.ndarray) -> pa.ListArray:
    """Differences of reads laid end to end from their references: steps between their places, and substitution codes."""
    at = np.flatnonzero(fr != ff)
    row = np.searchsorted(offsets, at, "right") - 1
    place = at - offsets[row]
    new = np.concatenate([[True], row[1:] != row[:-1]]) if len(at) else np.zeros(0, bool)
    step = np.where(new, place, place - np.concatenate([[0], place[:-1]])) if len(at) else place
    codes = pa.array(np.array(["0", "1", "2", "3"])[_CODE[ff[at], fr[at]]].tolist(), pa.string())
    items = pa.StructArray.from_arrays([pa.array(step.astype(np.int32)), codes], ["dpos", "code"])
    return pa.ListArray.from_arrays(pa.array(np.searchsorted(at, offsets).astype(np.int32)), items)


@arrow_udf(T.IntegerType())
def cost2(a: pa.Array, b: pa.Array) -> pa.Array:
    """Differing bits of 2-bit codes (A, C, G, T)."""
    return _cost(a, b, False)


@arrow_udf(T.IntegerType())
def cost3(a: pa.Array, b: pa.Array) -> pa.Array:
    """Differing bits of 3-bit codes (with N)."""
    return _cost(a, b, True)


@arrow_udf(NOISE)
def noise(read: pa.Array, ref: pa.Array) -> pa.Array:
    """Differences of a read from its reference: steps between their places, and substitution codes."""
    fr, ff, offsets, ok = _both(read, ref)
    return _spread(noise_lists(fr, ff, offsets), ok)


@arrow_udf(T.StringType())
def apply_noise(ref: pa.Array, diffs: pa.Array) -> pa.Array:
    """The read that ``noise`` was taken from."""
    ok = pc.and_(pc.is_valid(ref), pc.is_valid(diffs))
    flat, offsets = flat_text(ref.filter(ok))
    flat, lists = flat.copy(), diffs.filter(ok)
    size = pc.list_value_length(lists).to_numpy(zero_copy_only=False)
    items = lists.flatten()
    step = items.field("dpos").to_numpy(zero_copy_only=False).astype(np.int64)
    if len(step):
        total = np.cumsum(step)
        first = np.cumsum(size) - size
        has = size > 0
        before = np.zeros(len(size), np.int64)
        before[has] = total[first[has]] - step[first[has]]
        owner = np.repeat(np.arange(len(size)), size)
        at = offsets[owner] + total - before[owner]
        codes, _ = flat_text(items.field("code"))
        flat[at] = _BASE[flat[at], codes]
    made = pa.StringArray.from_buffers(len(offsets) - 1, pa.py_buffer(offsets.astype(np.int32).tobytes()), pa.py_buffer(flat.tobytes()))
    return _spread(made, ok)


@arrow_udf(T.StringType())
def lay_bases(cells: pa.Array) -> pa.Array:
    """A string from a list of (site, base) in any order, from the smallest site to the largest; A between them."""
    items, size = cells.flatten(), pc.list_value_length(cells).to_numpy(zero_copy_only=False)
    site = items.field("site").to_numpy(zero_copy_only=False)
    base, _ = flat_text(items.field("base"))
    start = np.cumsum(size) - size
    low, high = np.minimum.reduceat(site, start), np.maximum.reduceat(site, start)
    offsets = np.append(0, np.cumsum(high - low + 1))
    out = np.full(offsets[-1], ord("A"), np.uint8)
    out[np.repeat(offsets[:-1] - low, size) + site] = base
    return pa.StringArray.from_buffers(len(size), pa.py_buffer(offsets.astype(np.int32).tobytes()), pa.py_buffer(out.tobytes()))


def rolling_codes(flat: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """2-bit codes of all windows of ``k`` <= 32 bases, those of their reverse complements, and which are all A, C, G, T."""
    n = max(0, len(flat) - k + 1)
    table = np.full(256, -1, np.int64)
    table[list(b"ACGT")] = range(4)
    c = table[flat]
    ahead, back, legal = np.zeros(n, np.int64), np.zeros(n, np.int64), np.ones(n, bool)
    for i in range(k):
        part = c[i : i + n]
        ahead = ahead << 2 | (part & 3)
        back |= (3 - (part & 3)) << (2 * i)
        legal &= part >= 0
    return ahead, back, legal


__all__ = ["apply_noise", "cost2", "cost3", "lay_bases", "noise", "noise_lists", "prices", "rolling_codes"]
