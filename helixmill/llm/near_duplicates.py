"""Near-duplicate records by a chosen-path set similarity join.

Every record is a set of tokens. In each of several independent trees a record walks from the root: a node picks a few
minwise coordinates by its own hash, and the record branches to one child per coordinate, named by the node, the
coordinate and the record's minwise token there. Which coordinates a node picks depends on the node alone, so records
choose their paths without talking to each other, and a pair of similarity s stays together on a branch with
probability s. Nodes of at most ``LEAF`` records are compared exhaustively by sketch; larger nodes branch further, with
so many branches (``shape``) that a pair at the threshold still meets somewhere however deep the trees get: the share
of such pairs that part in all trees is at most ``MISS`` at any depth. The sketch comparison drops a pair at the
threshold with a chance of about 0.0001 a meeting.

A node that keeps much of its parent's records holds mostly similar ones: branching on would cost more rows than it
parts, so it is compared in blocks, on the sets themselves. Every other node is smaller than its parent by that share, so the walk ends. No
pair is lost to a cap, no group is collected, and a node with many records is never the work of one task. Sets that
are equal walk once. Candidates of sketches are verified on the sets themselves.

The first two coordinates on a branch are taken in one step to save a round.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from helixmill.functions.flat import whole_groups
from helixmill.llm.arrays import flat_text, mix, slices
from helixmill.session import cut, small

COORDINATES, FIRST, LEAF, BLOCK, MEMBERS, FEW = 128, (3, 1), 250, 1024, 1024, 48
MISS = 0.001
#: two bits a coordinate, in two planes
SKETCH_WORDS = 2 * COORDINATES // 64


def gram_sets(text: pa.Array, width: int, alphabet: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Distinct windows of ``width`` letters of ``alphabet`` per value, as 32-bit tokens, and the value of each."""
    flat, offsets = flat_text(text)
    code = np.full(256, -1, np.int64)
    code[list(alphabet)] = np.arange(len(alphabet))
    symbol = code[flat]
    if len(flat) < width:
        return np.zeros(0, np.uint32), np.zeros(0, np.int64)
    n = len(flat) - width + 1
    token, legal = np.zeros(n, np.uint64), np.ones(n, bool)
    for k in range(width):
        part = symbol[k : k + n]
        token = token * np.uint64(len(alphabet)) + part.astype(np.uint64)
        legal &= part >= 0
    row = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))[:n]
    legal &= np.arange(n) + width <= offsets[row + 1]
    token, row = token[legal], row[legal]
    if len(alphabet) ** width > 1 << 32:
        token = mix(token) & np.uint64(0xFFFFFFFF)
    key = np.sort(row.astype(np.uint64) << np.uint64(32) | token)
    key = key[np.concatenate([[True], key[1:] != key[:-1]])] if len(key) else key
    return (key & np.uint64(0xFFFFFFFF)).astype(np.uint32), (key >> np.uint64(32)).astype(np.int64)


def set_batches(batches: Iterable[pa.RecordBatch], width: int, alphabet: bytes, least: int) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches, "text"):
        token, row = gram_sets(batch.column("text"), width, alphabet)
        count = np.bincount(row, minlength=batch.num_rows)
        end = np.cumsum(count)
        keep = np.flatnonzero(count >= least)
        raw = token.tobytes()
        sets = [raw[4 * (end[i] - count[i]) : 4 * end[i]] for i in keep.tolist()]
        yield pa.RecordBatch.from_arrays([batch.column("rid").take(pa.array(keep)), pa.array(sets, pa.binary())], ["rid", "tokens"])


def minwise(token: np.ndarray, start: np.ndarray) -> np.ndarray:
    """Minwise hashes of the sets that begin at ``start``, one row per set and one column per coordinate."""
    seeds = mix(np.arange(1, 2 * COORDINATES + 1, dtype=np.uint64))
    low = mix(token.astype(np.uint64)).astype(np.uint32)
    out = np.empty((len(start), COORDINATES), np.uint32)
    for k in range(COORDINATES):
        a, b = np.uint32(seeds[2 * k] & np.uint64(0xFFFFFFFF)) | np.uint32(1), np.uint32(seeds[2 * k + 1] & np.uint64(0xFFFFFFFF))
        h = low * a
        h ^= h >> np.uint32(15)
        h *= np.uint32(0x2C1B3C6D)
        h += b
        out[:, k] = np.minimum.reduceat(h, start)
    return out


def sketches(low: np.ndarray) -> np.ndarray:
    """Two bits per coordinate, packed into 64-bit words: the first bits of all, then the second ones."""
    top = low * np.uint32(0x9E3779B1)
    planes = [np.packbits((top >> np.uint32(at) & np.uint32(1)).astype(np.uint8), axis=1) for at in (31, 30)]
    return np.concatenate(planes, axis=1).view(np.uint64)


def shape(threshold: float) -> tuple[int, int]:
    """Trees, and branches of a node below the first step.

    With two meetings expected below a node, a pair at the threshold lives on there for ever with a fixed chance; the
    trees are as many as it takes to bring the chance that it dies in all of them down to ``MISS``.
    """
    deep = max(2, int(np.ceil(2 / threshold)))
    alive = 1.0
    for _ in range(200):
        alive = 1 - (1 - threshold * alive) ** deep
    for count in reversed(FIRST):  # the two coordinates of the first step
        alive = 1 - (1 - threshold * alive) ** count
    return max(1, int(np.ceil(np.log(MISS) / np.log(1 - alive)))), deep


def branches(node: np.ndarray, low: np.ndarray, row: np.ndarray, count: int) -> np.ndarray:
    """The ``count`` children of each (node, record): columns of a matrix."""
    out = np.empty((len(node), count), np.uint64)
    for b in range(count):
        pick = mix(node + np.uint64(b * 2 + 1))
        c = (pick % np.uint64(COORDINATES)).astype(np.int64)
        out[:, b] = mix(pick ^ low[row, c].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    return out


def decode_sets(tokens: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All tokens end to end, and where each set begins; sets aren't empty."""
    flat, offsets = flat_text(tokens)
    return np.frombuffer(flat.tobytes(), np.uint32), offsets[:-1] // 4


def signature_batches(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The set with its minwise tokens beside it, so that they are made once."""
    for batch in slices(batches, "tokens", 1 << 20):
        low = minwise(*decode_sets(batch.column("tokens")))
        yield pa.RecordBatch.from_arrays([batch.column("rid"), batch.column("tokens"), pa.array([r.tobytes() for r in low], pa.binary())], ["rid", "tokens", "low"])


def signatures(column: pa.Array) -> np.ndarray:
    return np.frombuffer(flat_text(column)[0].tobytes(), np.uint32).reshape(-1, COORDINATES)


def root_batches(batches: Iterable[pa.RecordBatch], trees: int, names_only: bool) -> Iterator[pa.RecordBatch]:
    """First nodes of each record, two coordinates deep: (node) or (node, rid, sketch words)."""
    for batch in slices(batches, "low", 1 << 20):
        low = signatures(batch.column("low"))
        row = np.repeat(np.arange(len(low)), trees)
        node = np.tile(mix(np.arange(101, 101 + trees, dtype=np.uint64)), len(low))
        for count in FIRST:
            node, row = branches(node, low, row, count).ravel(), np.repeat(row, count)
        columns = {"node": node.view(np.int64)}
        if not names_only:
            words = sketches(low)
            columns |= {"rid": batch.column("rid").to_numpy()[row], **{f"s{k}": words[row, k].view(np.int64) for k in range(SKETCH_WORDS)}}
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in columns.values()], list(columns))


def deeper_batches(batches: Iterable[pa.RecordBatch], deep: int) -> Iterator[pa.RecordBatch]:
    """Children of the nodes of each record, one coordinate deeper: (node, rid, sketch words, size of the parent)."""
    for batch in slices(batches, "low", 1 << 18):
        low, nodes = signatures(batch.column("low")), batch.column("nodes")
        words, rid = sketches(low), batch.column("rid").to_numpy()
        row = np.repeat(np.arange(len(low)), pc.list_value_length(nodes).to_numpy(zero_copy_only=False))
        node, parent = nodes.flatten().field("node").to_numpy().view(np.uint64), nodes.flatten().field("count").to_numpy()
        step = max(1, (1 << 18) // deep)
        for a in range(0, len(node), step):
            kids = branches(node[a : a + step], low, row[a : a + step], deep)
            r = np.repeat(row[a : a + step], deep)
            columns = {"node": kids.ravel().view(np.int64), "rid": rid[r], **{f"s{k}": words[r, k].view(np.int64) for k in range(SKETCH_WORDS)}, "parent": np.repeat(parent[a : a + step], deep)}
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in columns.values()], list(columns))


def least_agreement(threshold: float) -> int:
    """Coordinates that must agree in both bits: the expectation at the threshold less 3.7 standard deviations."""
    p = threshold + (1 - threshold) / 4
    return int(COORDINATES * p - 3.7 * (COORDINATES * p * (1 - p)) ** 0.5)


def agreeing(rid: np.ndarray, words: np.ndarray, i: np.ndarray, j: np.ndarray, most: int) -> Iterator[pa.RecordBatch]:
    apart, half = words[i] ^ words[j], SKETCH_WORDS // 2
    near = np.bitwise_count(apart[:, :half] | apart[:, half:]).sum(1) <= most
    a, b = rid[i[near]], rid[j[near]]
    if near.any():
        yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], ["a", "b"])


def group_pairs(group: np.ndarray, rid: np.ndarray, words: np.ndarray, most: int) -> Iterator[pa.RecordBatch]:
    """Agreeing pairs of each run of equal ``group``."""
    head = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]]))
    size = np.diff(np.append(head, len(group)))
    end = np.repeat(head + size, size)
    i = np.flatnonzero(np.repeat(size <= FEW, size))
    for d in range(1, int(size[size <= FEW].max(initial=0))):  # pairs at distance d, of all small groups at once
        i = i[i + d < end[i]]
        yield from agreeing(rid, words, i, i + d, most)
    for h, n in zip(head[size > FEW].tolist(), size[size > FEW].tolist()):
        i, j = np.triu_indices(n, 1)
        yield from agreeing(rid, words, h + i, h + j, most)


def group_number(rows: pa.Table, names: list[str]) -> np.ndarray:
    new = np.zeros(rows.num_rows, bool)
    for name in names:
        column = rows.column(name).to_numpy()
        new[1:] |= column[1:] != column[:-1]
    return np.cumsum(new)


def pair_batches(batches: Iterable[pa.RecordBatch], threshold: float) -> Iterator[pa.RecordBatch]:
    """Pairs with agreeing sketches out of rows sorted by node; the rows of a batch and one node are held."""
    most = COORDINATES - least_agreement(threshold)
    for rows in whole_groups(batches, ["node"]):
        words = np.stack([rows.column(w).to_numpy().view(np.uint64) for w in _WORDS], 1)
        yield from group_pairs(group_number(rows, ["node"]), rows.column("rid").to_numpy(), words, most)


def common_tokens(token: np.ndarray, row: np.ndarray, n: int) -> np.ndarray:
    """How many tokens each two of ``n`` sets share, as a matrix (twice on the diagonal's sides, nothing on it)."""
    number, count = np.unique(token, return_inverse=True, return_counts=True)[1:]
    often = count > max(8, n // 32)
    dense = np.zeros((n, int(often.sum())), np.float32)
    wide = often[number]
    dense[row[wide], (np.cumsum(often) - 1)[number[wide]]] = 1
    out = dense @ dense.T
    order = np.argsort(number[~wide], kind="stable")
    number, row = number[~wide][order], row[~wide][order]
    i, cells = np.arange(len(row)), []
    for d in range(1, int(count[~often].max(initial=0))):  # a rare token is held by few sets
        i = i[i + d < len(row)]
        i = i[number[i] == number[i + d]]
        cells.append(row[i] * n + row[i + d])
    rest = np.bincount(np.concatenate(cells), minlength=n * n).reshape(n, n) if cells else np.zeros((n, n), np.int64)
    return out.astype(np.int64) + rest + rest.T


def block_batches(batches: Iterable[pa.RecordBatch], threshold: float) -> Iterator[pa.RecordBatch]:
    """Similar pairs of groups (node, x, y) of bounded size, by their sets: across the two sides, or within the only one."""
    names = ["node", "x", "y"]
    for rows in whole_groups(batches, names):
        edge = np.append(np.unique(group_number(rows, names), return_index=True)[1], rows.num_rows)
        for a, b in zip(edge.tolist(), edge[1:].tolist()):
            own = rows.slice(a, b - a)
            side, rid = own.column("side").to_numpy(), own.column("rid").to_numpy()
            token, start = decode_sets(own.column("tokens").combine_chunks())
            size = np.diff(np.append(start, len(token)))
            common = common_tokens(token, np.repeat(np.arange(len(rid)), size), len(rid))
            union = size[:, None] + size - common
            meet = np.triu(common >= threshold * union - 1e-9, 1)
            if side.any():
                meet &= side[:, None] != side
            i, j = np.nonzero(meet)
            yield pa.RecordBatch.from_arrays([pa.array(np.minimum(rid[i], rid[j])), pa.array(np.maximum(rid[i], rid[j])), pa.array(common[i, j] / union[i, j])], ["a", "b", "similarity"])


def similarity(batches: Iterable[pa.RecordBatch], threshold: float) -> Iterator[pa.RecordBatch]:
    """Exact check of candidate pairs carrying both sets."""
    for batch in slices(batches, "ta", 1 << 20):
        ta, sa = decode_sets(batch.column("ta"))
        tb, sb = decode_sets(batch.column("tb"))
        na, nb = np.diff(np.append(sa, len(ta))), np.diff(np.append(sb, len(tb)))
        pair = np.arange(len(sa), dtype=np.uint64)
        key = np.sort(np.concatenate([np.repeat(pair, na) << np.uint64(32) | ta, np.repeat(pair, nb) << np.uint64(32) | tb]))
        common = np.bincount((key[1:][key[1:] == key[:-1]] >> np.uint64(32)).astype(np.int64), minlength=len(sa))
        union = na + nb - common
        keep = np.flatnonzero(common >= threshold * union - 1e-9)
        yield pa.RecordBatch.from_arrays([batch.column("a").take(pa.array(keep)), batch.column("b").take(pa.array(keep)), pa.array(common[keep] / union[keep])], ["a", "b", "similarity"])


_WORDS = [f"s{k}" for k in range(SKETCH_WORDS)]
_NODE = "node bigint, rid bigint, " + ", ".join(f"{w} bigint" for w in _WORDS)


_PAIR = "a bigint, b bigint, similarity double"


def compared(rows: DataFrame, threshold: float) -> DataFrame:
    """Pairs inside small nodes that agree in their sketches.

    Partitioned by a hash of the node, see ``whole_groups``.
    """
    near = rows.select("node", "rid", *_WORDS).repartition(F.xxhash64("node")).sortWithinPartitions("node")
    return near.mapInArrow(lambda it: pair_batches(it, threshold), "a bigint, b bigint")


def blocked(dense: DataFrame, sets: DataFrame, threshold: float) -> DataFrame:
    """Similar pairs inside dense nodes (``node``, ``rid``, ``count``), in blocks of about ``BLOCK`` records or 512 KB.

    Each two blocks of a node meet under a key of their own.
    """
    rows = sets.select("rid", "tokens").join(small(dense), "rid")
    weight = rows.groupBy("node").agg(F.sum(F.length("tokens")).alias("weight"))
    n = F.ceil(F.greatest(F.col("count") / BLOCK, F.col("weight") / (1 << 19))).cast("int")
    block = rows.join(weight, "node").withColumn("n", n).withColumn("block", F.pmod(F.xxhash64("rid"), F.col("n")).cast("int"))
    meet = block.withColumn("j", F.explode(F.expr("sequence(0, n - 1)")))
    x, y = F.least("block", "j"), F.greatest("block", "j")
    meet = meet.select("node", x.alias("x"), y.alias("y"), (F.col("block") > F.col("j")).cast("int").alias("side"), "rid", "tokens")
    return meet.repartition("node", "x", "y").sortWithinPartitions("node", "x", "y").mapInArrow(lambda it: block_batches(it, threshold), _PAIR)


def verified(pairs: DataFrame, sets: DataFrame, threshold: float) -> DataFrame:
    """Those of the pairs (``a``, ``b``) whose sets are similar."""
    ids = cut(pairs.select(F.explode(F.array("a", "b")).alias("rid")).distinct())
    sets = cut(sets.select("rid", "tokens").join(small(ids), "rid", "left_semi"))
    a, b = (sets.select(F.col("rid").alias(k), F.col("tokens").alias(f"t{k}")) for k in "ab")
    return pairs.join(a, "a").join(b, "b").select("a", "b", "ta", "tb").mapInArrow(lambda it: similarity(it, threshold), _PAIR)


def candidate_pairs(sets: DataFrame, threshold: float) -> DataFrame:
    """Pairs of distinct sets (``a``, ``b``, ``similarity``) that meet in some tree and are similar.

    ``sets`` (``rid``, ``tokens``, ``low``) is a written table: nodes are made from it again where they are needed.
    """
    trees, deep = shape(threshold)
    dense = deep**-0.5  # above it the rows of further branches outgrow those of blocks
    names = sets.select("low").mapInArrow(lambda it: root_batches(it, trees, True), "node bigint")
    rows = sets.select("rid", "low").mapInArrow(lambda it: root_batches(it, trees, False), _NODE)
    crowded = cut(names.groupBy("node").agg(F.count("*").alias("count")).where(F.col("count") > LEAF).select("node", "count", F.lit(False).alias("dense")))
    found = done = None
    while True:
        n = crowded.count()
        pairs = cut(compared(rows.join(small(crowded, n), "node", "left_anti"), threshold).distinct())
        found = pairs if found is None else found.unionByName(pairs)
        if not n:
            break
        large = cut(rows.join(small(crowded, n), "node").select("node", "rid", "count", "dense"))
        near, again = cut(large.where("dense").drop("dense")), large.where("not dense")
        if not near.isEmpty():
            pairs = cut(blocked(near, sets, threshold).distinct())
            done = pairs if done is None else done.unionByName(pairs)
        if again.isEmpty():
            break
        lists = cut(again.groupBy("rid").agg(F.collect_list(F.struct("node", "count")).alias("nodes")))
        deeper = sets.select("rid", "low").join(small(lists, again.count()), "rid")
        rows = cut(deeper.select("rid", "low", "nodes").mapInArrow(lambda it: deeper_batches(it, deep), f"{_NODE}, parent bigint"))
        of = rows.groupBy("node").agg(F.count("*").alias("count"), F.max("parent").alias("of")).where(F.col("count") > LEAF)
        crowded = cut(of.select("node", "count", (F.col("count") >= dense * F.col("of")).alias("dense")))
        rows = rows.drop("parent")
    out = verified(cut(found.distinct()), sets, threshold)
    return cut(out if done is None else out.unionByName(done).distinct())


def similar_pairs(df: DataFrame, rid: str, text: str, width: int, alphabet: str, threshold: float, least: int = 1) -> tuple[DataFrame, DataFrame]:
    """Pairs of similar classes (``a``, ``b``, ``similarity``) and the class of each record (``rid``, ``cls``).

    A record's set is its distinct windows of ``width`` letters of ``alphabet``; records with fewer than ``least``
    windows take part in nothing. Records with equal sets form a class named by its smallest id. Two classes pair if
    the Jaccard similarity of their sets reaches ``threshold``. Null ids and texts are left out; texts are whole.
    """
    rows = df.where(F.col(rid).isNotNull() & F.col(text).isNotNull()).select(F.col(rid).cast("bigint").alias("rid"), F.col(text).alias("text"))
    letters, least = alphabet.encode(), max(1, least)
    sets = cut(rows.mapInArrow(lambda it: set_batches(it, width, letters, least), "rid bigint, tokens binary"))
    keyed = sets.select("rid", F.md5("tokens").alias("print"))
    classes = keyed.groupBy("print").agg(F.min("rid").alias("cls"))
    members = keyed.join(classes, "print").select("rid", "cls")
    own = cut(sets.join(members.where("rid = cls").select("rid"), "rid", "left_semi").mapInArrow(signature_batches, "rid bigint, tokens binary, low binary"))
    return candidate_pairs(own, threshold), members


def expand_pairs(pairs: DataFrame, members: DataFrame) -> DataFrame:
    """All pairs of records: between members of paired classes and within classes, smaller id first.

    The members of a class are dealt into blocks of about ``MEMBERS``, and each pair of blocks meets under a key of its
    own, so a class with many records is the work of many tasks.
    """
    size = members.groupBy("cls").agg(F.ceil(F.count("*") / MEMBERS).cast("int").alias("n")).where("n > 1")
    rows = members.join(size, "cls", "left").withColumn("n", F.coalesce("n", F.lit(1))).withColumn("block", F.pmod(F.xxhash64("rid"), F.col("n")).cast("int"))
    x, y = (rows.select(F.col("rid").alias(f"read_{k}"), F.col("cls").alias(k), F.col("n").alias(f"n_{k}"), F.col("block").alias(f"block_{k}")) for k in "ab")
    meet = pairs.select("a", "b").unionByName(members.groupBy("cls").agg(F.count("*").alias("k")).where("k > 1").select(F.col("cls").alias("a"), F.col("cls").alias("b")))
    parts = [meet]
    for k in "ab":
        wide = parts[-1].join(size.select(F.col("cls").alias(k), F.col("n").alias("n")), k, "left").withColumn("n", F.coalesce("n", F.lit(1)))
        parts.append(wide.withColumn(f"block_{k}", F.explode(F.expr("sequence(0, n - 1)"))).drop("n"))
    both = parts[-1].join(x.drop("n_a"), ["a", "block_a"]).join(y.drop("n_b"), ["b", "block_b"])
    both = both.where((F.col("a") != F.col("b")) | (F.col("read_a") < F.col("read_b")))
    return both.select(F.least("read_a", "read_b").alias("read_a"), F.greatest("read_a", "read_b").alias("read_b"))
