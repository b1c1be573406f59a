"""Lossy qualities at a target rate: quantisers trained per column and previous output, then applied along each read.

A block of reads (256,000 at most) is one group: its task counts a Markov chain of first order over columns, trains the
codebook on the counts and applies it, so nothing but the qualities is moved and nothing reaches the driver. The random
choice between the two quantisers of a state comes from a hash of read, column and seed, so a repeated task gives the
same symbols.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from helixmill.functions.flat import flat_text, mix
from helixmill.functions.quality import ALPHABET, ZERO, phred
from helixmill.functions.seq import xlog2x

ROUNDS = 100


def distortion(kind: str | np.ndarray = "mse") -> np.ndarray:
    """Cost of writing y for x: ``l1``, ``mse``, ``lorentz`` or a matrix of one's own."""
    if isinstance(kind, np.ndarray):
        if kind.shape != (ALPHABET, ALPHABET):
            raise ValueError(f"a distortion matrix has {ALPHABET} rows and columns")
        return kind.astype(float)
    d = np.abs(np.arange(ALPHABET)[:, None] - np.arange(ALPHABET)[None, :]).astype(float)
    forms = {"l1": d, "mse": d * d, "lorentz": np.log2(1 + d)}
    if kind not in forms:
        raise ValueError(f"unknown distortion {kind}")
    return forms[kind]


def entropy(p: np.ndarray) -> float:
    p = p[p > 0]
    return float(-(p * np.log2(p)).sum())


def train(pmf: np.ndarray, states: int, cost: np.ndarray) -> np.ndarray:
    """Alternately best outputs and best bounds for ``states`` intervals, for each row of ``pmf`` at once.

    Returns the output of each symbol, one row per distribution.
    """
    m = len(pmf)
    edge = np.arange(states + 1) * ALPHABET // states
    which = np.tile(np.searchsorted(edge[1:-1], np.arange(ALPHABET), "right"), (m, 1))
    out = np.tile((edge[:-1] + edge[1:] - 1) // 2, (m, 1))
    busy = np.arange(m)
    number = np.arange(states)
    for _ in range(ROUNDS):
        member = (which[busy, None, :] == number[None, :, None]) * pmf[busy, None, :]
        held = (which[busy, None, :] == number[None, :, None]).any(2)
        better = np.where(held, (member @ cost).argmin(2), out[busy])  # the lowest of equal outputs
        # a symbol moves to the next interval when that output is strictly closer; intervals stay in order
        moved = np.maximum.accumulate(cost[:, better].argmin(2).T, axis=1)
        same = (better == out[busy]).all(1) & (moved == which[busy]).all(1)
        out[busy], which[busy] = better, moved
        busy = busy[~same]
        if not len(busy):
            break
    return np.take_along_axis(out, which, 1)


def entropies(p: np.ndarray) -> np.ndarray:
    return -(p * np.log2(np.where(p > 0, p, 1))).sum(1)


def spread(pmf: np.ndarray, quantiser: np.ndarray) -> np.ndarray:
    """Distribution of the outputs, row by row."""
    out = np.zeros_like(pmf)
    np.add.at(out, (np.arange(len(pmf))[:, None], quantiser), pmf)
    return out


def pairs_for(pmf: np.ndarray, target: float, cost: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Per distribution two quantisers whose output entropies enclose the target, and the share of the lower one."""
    m = len(pmf)
    low = train(pmf, 1, cost)
    high = low.copy()
    bits = entropies(spread(pmf, low))
    low_bits, high_bits = bits.copy(), bits.copy()
    plain = np.arange(ALPHABET)
    lossless = entropies(pmf) < target  # out of reach: such symbols stay as they are
    low[lossless], high[lossless] = plain, plain
    left = np.flatnonzero((bits < target) & ~lossless)
    for states in range(2, ALPHABET + 1):
        if not len(left):
            break
        low[left], low_bits[left] = high[left], high_bits[left]
        high[left] = train(pmf[left], states, cost)
        high_bits[left] = entropies(spread(pmf[left], high[left]))
        left = left[high_bits[left] < target]
    share = np.ones(m)
    search = low_bits < target
    reached = search & (high_bits >= target)
    share[search & ~reached] = 0.0
    gap = np.where(reached, low_bits - high_bits, 1)
    share[reached] = np.where(gap[reached] == 0, 1.0, (target - high_bits[reached]) / gap[reached])
    return low, high, share


@dataclass
class Codebook:
    """``low`` and ``high`` [column, previous output, symbol] and ``ratio`` [column, previous output] of one block."""

    low: np.ndarray
    high: np.ndarray
    ratio: np.ndarray
    target: np.ndarray = field(default_factory=lambda: np.zeros(0))

    def to_dict(self) -> dict:
        return {k: getattr(self, k).tolist() for k in ("low", "high", "ratio", "target")}

    @classmethod
    def from_dict(cls, d: dict) -> Codebook:
        return cls(np.array(d["low"], np.uint8), np.array(d["high"], np.uint8), np.array(d["ratio"]), np.array(d["target"]))


def codebook(counts: np.ndarray, bits_ratio: float, cost: np.ndarray, fixed: bool = False) -> Codebook:
    """Train all columns in order. ``counts`` is [column, previous, current]; the target of a column is ``bits_ratio``
    times the entropy of its symbols given the symbol before, or ``bits_ratio`` bits if ``fixed``."""
    columns = len(counts)
    low = np.zeros((columns, ALPHABET, ALPHABET), np.uint8)
    high, ratio, targets = low.copy(), np.ones((columns, ALPHABET)), np.zeros(columns)
    joint = None  # probability of (output of the column before, symbol of the column before)
    p = counts[0].sum(0) / max(counts[0].sum(), 1)
    for c in range(columns):
        n = counts[c].astype(float)
        if c == 0:
            given = {0: p}
            weight = {0: 1.0}
            targets[0] = bits_ratio if fixed else bits_ratio * entropy(p)
        else:
            step = n / np.maximum(n.sum(1, keepdims=True), 1)
            share = n.sum(1) / max(n.sum(), 1)
            targets[c] = bits_ratio if fixed else bits_ratio * sum(s * entropy(r) for s, r in zip(share, step) if s > 0)
            flow = joint @ step
            weight = {o: float(flow[o].sum()) for o in range(ALPHABET) if flow[o].sum() > 0}
            given = {o: flow[o] / w for o, w in weight.items()}
        after = np.zeros((ALPHABET, ALPHABET))
        known = np.array(list(given))
        pmf = np.array([given[o] for o in given])
        a, b, r = pairs_for(pmf, targets[c], cost)
        low[c, known], high[c, known], ratio[c, known] = a, b, r
        x = np.broadcast_to(np.arange(ALPHABET), a.shape)
        mass = np.array([weight[o] for o in given])[:, None] * pmf
        np.add.at(after, (a, x), mass * r[:, None])
        np.add.at(after, (b, x), mass * (1 - r)[:, None])
        # outputs no training read led to take the symbols as they are
        for o in range(ALPHABET):
            if o not in given:
                low[c, o] = high[c, o] = np.arange(ALPHABET)
        joint = after
    return Codebook(low, high, ratio, targets)


def symbols(values: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Phred values end to end, held to the alphabet, and the offsets of the reads."""
    flat, offsets = flat_text(values)
    return np.clip(flat.astype(np.int16) - ZERO, 0, ALPHABET - 1).astype(np.uint8), offsets


def count_chain(flat: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Counts [column, previous, current]; the previous symbol of column 0 is 0."""
    size = np.diff(offsets)
    col = np.arange(len(flat)) - np.repeat(offsets[:-1], size)
    prev = np.where(col > 0, np.concatenate([[0], flat[:-1]]), 0) if len(flat) else col
    columns = int(size.max(initial=0))
    return np.bincount((col * ALPHABET + prev) * ALPHABET + flat, minlength=columns * ALPHABET**2).reshape(columns, ALPHABET, ALPHABET)


def apply_book(book: Codebook, flat: np.ndarray, offsets: np.ndarray, idx: np.ndarray, seed: int) -> np.ndarray:
    """Quantise reads laid end to end, one column of all reads at a time."""
    size, out = np.diff(offsets), flat.copy()
    order = np.argsort(-size, kind="stable")
    start, size, idx = offsets[:-1][order], size[order], idx[order].astype(np.uint64)
    prev = np.zeros(len(size), np.int64)
    for c in range(int(size.max(initial=0))):
        n = int(np.searchsorted(-size, -c, "left"))  # reads longer than c stand first
        x, p, k = flat[start[:n] + c], prev[:n], min(c, len(book.low) - 1)
        draw = (mix(idx[:n] * np.uint64(0x9E3779B97F4A7C15) + np.uint64(c * 2 + 1) + np.uint64(seed) * np.uint64(7919)) >> np.uint64(57)).astype(np.int64)
        high = draw >= (book.ratio[k, p] * 128).astype(np.int64)
        y = np.where(high, book.high[k, p, x], book.low[k, p, x])
        out[start[:n] + c] = y
        prev[:n] = y
    return out


def quantise_block(block: pa.Table, bits_ratio: float, cost: np.ndarray, seed: int, fixed: bool = False, step: int = 8192) -> pa.Table:
    """All reads of one block; counted and quantised in steps, so that numpy copies stay small."""
    block = block.combine_chunks()
    column = block.column("qual").combine_chunks()
    filled = pc.and_(pc.is_valid(column), pc.greater(pc.binary_length(column), 0)).fill_null(False)
    row = np.flatnonzero(filled.to_numpy(zero_copy_only=False))
    if not len(row):
        return block
    quals, idx = column.filter(filled), block.column("read_idx").fill_null(0).to_numpy()[row]
    counts = np.zeros((int(pc.max(pc.binary_length(quals)).as_py()), ALPHABET, ALPHABET), np.int64)
    for a in range(0, len(quals), step):
        c = count_chain(*symbols(quals.slice(a, step)))
        counts[: len(c)] += c
    book = codebook(counts, bits_ratio, cost, fixed)
    out: list[str | None] = column.to_pylist()
    for a in range(0, len(quals), step):
        flat, offsets = symbols(quals.slice(a, step))
        text = (apply_book(book, flat, offsets, idx[a : a + step], seed) + ZERO).astype(np.uint8).tobytes().decode("latin-1")
        for k, i in enumerate(row[a : a + step].tolist()):
            out[i] = text[offsets[k] : offsets[k + 1]]
    return block.set_column(block.schema.get_field_index("qual"), "qual", pa.array(out, pa.string()))


def read_matrix(path: str) -> np.ndarray:
    """A distortion matrix from a text of comma-separated rows, one for each symbol written as a column."""
    with open(path, encoding="ascii") as f:
        rows = [[float(x) for x in line.replace(";", ",").split(",") if x.strip()] for line in f if line.strip()]
    if len(rows) != ALPHABET or any(len(r) != ALPHABET for r in rows):
        raise ValueError(f"a distortion matrix has {ALPHABET} rows and columns")
    return np.array(rows)


def quantise(reads: DataFrame, bits_ratio: float, block: int = 256_000, kind: str | np.ndarray = "mse", seed: int = 1, fixed: bool = False, clusters: tuple[float, ...] = ()) -> DataFrame:
    """Replace ``qual`` by symbols of about ``bits_ratio`` times the entropy, with one codebook per block of reads.

    With ``fixed`` the rate is ``bits_ratio`` bits a symbol. ``clusters`` are rising bounds of the mean quality: reads
    between two bounds share a codebook of their own in each block. A block is ``block`` consecutive ``read_idx``.
    Symbols beyond Phred 71 count as 71. Null and empty qualities stay as they are; rows with a null ``read_idx`` form a
    block of their own.
    """
    if not bits_ratio > 0:
        raise ValueError("the ratio must be above 0")
    cost = distortion(kind)
    mean = F.aggregate(phred("qual"), F.lit(0), lambda a, q: a + q) / F.greatest(F.length("qual"), F.lit(1))
    group = sum((F.when(mean >= b, 1).otherwise(0) for b in clusters), F.lit(0))
    numbered = reads.withColumn("_block", F.floor(F.col("read_idx") / block)).withColumn("_cluster", group)
    return numbered.groupBy("_block", "_cluster").applyInArrow(lambda t: quantise_block(t, bits_ratio, cost, seed, fixed), numbered.schema).drop("_block", "_cluster")


def report(before: DataFrame, after: DataFrame, kind: str | np.ndarray = "mse") -> DataFrame:
    """Mean distortion, and bits a symbol of both sides given column and symbol before (one row)."""
    cost = distortion(kind)
    values = lambda df, name: df.where("qual <> ''").select("read_idx", phred("qual").alias(name))
    both = values(before, "x").join(values(after, "y"), "read_idx")
    held = lambda c: F.least(F.greatest(c, F.lit(0)), F.lit(ALPHABET - 1))
    cells = both.select("x", "y", F.posexplode("x").alias("col", "a"))
    last = lambda n: F.when(F.col("col") > 0, held(F.get(n, F.col("col") - 1))).otherwise(0)
    counts = cells.groupBy("col", held(F.col("a")).alias("a"), held(F.get("y", F.col("col"))).alias("b"), last("x").alias("pa"), last("y").alias("pb")).agg(F.count("*").alias("c"))
    price = F.lit(cost.ravel().tolist())
    loss = F.sum(F.col("c") * F.get(price, (F.col("a") * ALPHABET + F.col("b")).cast("int"))) / F.sum("c")
    out = counts.agg(F.sum("c").alias("symbols"), loss.alias("distortion"))

    def bits(now: str, before: str) -> DataFrame:
        joint = counts.groupBy("col", before, now).agg(F.sum("c").alias("c"))
        state = joint.groupBy("col", before).agg(F.sum("c").alias("n"), F.sum(xlog2x(F.col("c").cast("double"))).alias("s"))
        return state.agg(((F.sum(xlog2x(F.col("n").cast("double"))) - F.sum("s")) / F.sum("n")).alias(f"bits_{now}"))

    return out.crossJoin(bits("a", "pa")).crossJoin(bits("b", "pb")).select("symbols", "distortion", F.col("bits_a").alias("bits_before"), F.col("bits_b").alias("bits_after"))  # one row each
