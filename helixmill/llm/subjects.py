"""Subject areas of documents: bisecting k-means over document vectors, labelled leaves, leaf mixtures.

1. Words: message and diff of each document (paths and lines), identifiers divided at case and underscores, plural s
   off. Tokens with digits (ids, hashes) and parts of less than ``SHORTEST`` or more than ``LONGEST`` letters aren't
   words. Whole texts; the header isn't read.
2. Vocabulary: terms held by at least ``LEAST`` of all documents; those held by more than ``MOST`` must tell subjects
   apart, by the hand labels of the documents that hold them. Its size is bounded by the words of an average document
   over ``LEAST``, whatever the number of documents.
3. Tree: all documents with a term, as unit vectors of (1 + log count) * idf, are bisected level by level. A node's
   first centres are the documents with the term of largest variance, and those with the strongest term that keeps
   away from it; then spherical 2-means refines them. Short documents weigh less in the sums. A pass adds up one row
   per (node, term) in the tasks and then by shuffle; documents stay where they are. Nodes below ``LEAF_SHARE`` of the
   documents are split on where they hold labels of a subject that has most of its labels in leaves of others. After
   ``LEVELS`` levels larger nodes are split on by that rule too, so a tree that sheds one subject a level goes as deep
   as it must; ``LEAVES`` bounds what is held in a task.
4. Labels: the discriminative terms of a leaf are those far more frequent in it than in all documents. Each is worth
   its share of that difference, and points to subjects as the hand labels of the documents that hold it do (those for
   no area among them). The leaf takes the subject to which most of its discriminative weight points, if that is the
   larger part.
5. Mixtures: the leaves in which a term's documents lie give its share in each subject; a term whose share is high is
   evidence for that subject. A document gets the (at most two) subjects with enough evidence, which a word in passing
   isn't. As a document of two subjects lies in one leaf only, the terms' shares are then taken once more, from the
   subjects that the documents got.
"""

from __future__ import annotations

import itertools
import re
from collections import Counter
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from helixmill.session import cut, spread

LEAST, MOST = 0.0005, 0.08
LEVELS, LEAVES, LEAF_SHARE, REFINE, FULL = 10, 1024, 0.03, 2, 10
VOTES, LEAF_MIX, TERM_SHARE, MENTIONS, TERMS, AREAS = 2, 0.5, 0.6, 3, 2, 2
SHORTEST, LONGEST, TELLING = 3, 40, 20
APART = 0.4  # of the way from a subject's share of all labels to 1

_TOKEN = re.compile(r"[^\W_]+")
_PART = re.compile(r"[^\W\d_][^\W\d_A-ZÀ-Þ]*|[A-ZÀ-Þ]+(?![^\W\d_A-ZÀ-Þ])")
_DIFF = re.compile(r"^(?:diff --git |index [0-9a-f]{5,}\.\.[0-9a-f]{5,}|@@ .*? @@)", re.M)


def term_of(word: str) -> str:
    word = word.lower()
    if len(word) > 3 and word.endswith("s") and not word.endswith("ss"):
        word = word[:-1]
    return word


class Words:
    """Terms of a text with their counts; what a token holds is remembered per worker, up to a bound."""

    def __init__(self, keep: int = 200_000) -> None:
        self.known: dict[str, tuple[str, ...]] = {}
        self.keep = keep

    def parts(self, token: str) -> tuple[str, ...]:
        found = self.known.get(token)
        if found is None:
            # tokens with digits are ids and hashes, not words
            found = () if any(c.isdigit() for c in token) else tuple(p for p in _PART.findall(token) if SHORTEST <= len(p) <= LONGEST)
            found = tuple(term_of(p) for p in found)
            if len(self.known) < self.keep:
                self.known[token] = found
        return found

    def count(self, text: str) -> Counter:
        at = text.find("\n\n")
        crlf = text.find("\r\n\r\n")
        at = crlf if at < 0 or 0 <= crlf < at else at
        body = _DIFF.sub(" ", text[at:] if at >= 0 else text)
        out: Counter = Counter()
        for token, n in Counter(_TOKEN.findall(body)).items():
            for part in self.parts(token):
                out[part] += n
        return out


def word_batches(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    words = Words()
    for batch in batches:
        for a in range(0, batch.num_rows, 1024):
            piece = batch.slice(a, 1024)
            counted = [words.count(t) for t in piece.column("text").to_pylist()]
            counts = [np.fromiter(c.values(), np.uint32, len(c)).tobytes() for c in counted]
            yield pa.RecordBatch.from_arrays([piece.column("doc"), pa.array([" ".join(c) for c in counted]), pa.array(counts, pa.binary())], ["doc", "terms", "counts"])


def df_batches(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        seen: Counter = Counter()
        for t in batch.column("terms").to_pylist():
            seen.update(t.split(" ") if t else ())
        yield pa.RecordBatch.from_arrays([pa.array(list(seen), pa.string()), pa.array(list(seen.values()), pa.int64())], ["term", "n"])


_BLOCK = "docs binary, ptr binary, term binary, count binary"


def block_batches(batches: Iterable[pa.RecordBatch], vocabulary) -> Iterator[pa.RecordBatch]:
    """Documents with their vocabulary terms, many to a row."""
    number = vocabulary.value
    for batch in batches:
        docs, size, terms, counts = [], [], [], []
        for doc, text, raw in zip(batch.column("doc").to_pylist(), batch.column("terms").to_pylist(), batch.column("counts").to_pylist()):
            n = np.frombuffer(raw, np.uint32)
            own = [(number[t], i) for i, t in enumerate(text.split(" ")) if t in number] if text else []
            if own:
                own.sort()
                docs.append(doc)
                size.append(len(own))
                terms += [t for t, _ in own]
                counts.append(n[[i for _, i in own]])
        if docs:
            ptr = np.append(0, np.cumsum(size)).astype(np.int32)
            yield pa.RecordBatch.from_arrays([pa.array([x.tobytes()], pa.binary()) for x in (np.array(docs, np.int64), ptr, np.array(terms, np.int32), np.concatenate(counts))], ["docs", "ptr", "term", "count"])


def open_blocks(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Document ids, and per entry the document's number, the term and the count."""
    for batch in batches:
        for docs, ptr, term, count in zip(*[batch.column(i).to_pylist() for i in range(4)]):
            docs, ptr = np.frombuffer(docs, np.int64), np.frombuffer(ptr, np.int32)
            yield docs, np.repeat(np.arange(len(docs)), np.diff(ptr)), np.frombuffer(term, np.int32), np.frombuffer(count, np.uint32)


def weights(row: np.ndarray, term: np.ndarray, count: np.ndarray, idf: np.ndarray, n: int) -> np.ndarray:
    w = (1 + np.log(count)) * idf[term]
    return w / np.sqrt(np.bincount(row, w * w, n))[row]


class Tree:
    """Binary tree; a split node has a slot, the difference of its two unit centres there, and children numbered by it."""

    def __init__(self, terms: int) -> None:
        self.slot = np.full(1, -1, np.int64)
        self.cuts = np.zeros((0, terms), np.float32)

    def split(self, nodes: dict[int, np.ndarray]) -> Tree:
        out = Tree(self.cuts.shape[1])
        out.slot = np.concatenate([self.slot, np.full(2 * len(nodes), -1)])
        out.cuts = np.concatenate([self.cuts, np.array(list(nodes.values()), np.float32).reshape(len(nodes), -1)])
        out.slot[list(nodes)] = np.arange(len(nodes)) + len(self.cuts)
        return out

    def children(self, node: int) -> tuple[int, int]:
        return 2 * int(self.slot[node]) + 1, 2 * int(self.slot[node]) + 2

    def descend(self, row: np.ndarray, term: np.ndarray, w: np.ndarray, n: int) -> np.ndarray:
        node = np.zeros(n, np.int64)
        while (self.slot[node] >= 0).any():
            slot = self.slot[node]
            here = slot[row] >= 0
            score = np.bincount(row[here], self.cuts[slot[row[here]], term[here]] * w[here], n)
            node = np.where(slot >= 0, 2 * slot + 1 + (score > 0), node)
        return node


def sum_batches(batches: Iterable[pa.RecordBatch], shared, seeds: dict[int, tuple[int, int]] | None) -> Iterator[pa.RecordBatch]:
    """Sums and square sums of the weights per (node, term); term -1 counts documents.

    With ``seeds`` a document of node n goes to 2 n + 2 if it holds the node's first seed term, else to 2 n + 1 if it
    holds the other, else to 0.
    """
    tree, idf = shared.value
    terms = len(idf)
    total: dict[str, np.ndarray] = {}
    size = (2 * len(tree.slot) + 1) * (terms + 1)
    total = {k: np.zeros(0) for k in ("s", "q")}
    keys = np.zeros(0, np.int64)
    for docs, row, term, count in open_blocks(batches):
        n = len(docs)
        w = weights(row, term, count, idf, n)
        node = tree.descend(row, term, w, n)
        if seeds is not None:
            seed = np.full((2, len(tree.slot)), -2)
            seed[:, list(seeds)] = np.array(list(seeds.values())).T
            one, two = (np.bincount(row, term == seed[i][node][row], n) > 0 for i in (0, 1))
            node = np.where(one, 2 * node + 2, np.where(two, 2 * node + 1, 0))
        heavy = np.minimum(1, np.bincount(row, minlength=n) / FULL)
        key = np.concatenate([node[row] * (terms + 1) + term + 1, node * (terms + 1)])
        value = np.concatenate([w * heavy[row], heavy])
        square = np.concatenate([w * w * heavy[row], np.ones(n)])
        own, code = np.unique(key, return_inverse=True)
        s, q = np.bincount(code, value), np.bincount(code, square)
        merged, at = np.unique(np.concatenate([keys, own]), return_inverse=True)
        total = {k: np.bincount(at, np.concatenate([total[k], x]), len(merged)) for k, x in (("s", s), ("q", q))}
        keys = merged
    if len(keys):
        assert keys[-1] < size
        yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(total["s"]), pa.array(total["q"])], ["k", "s", "q"])


def majorities(votes: dict[int, Counter]) -> dict[int, str]:
    """The subject of each leaf whose hand labels name one most often, by majority."""
    out = {}
    for leaf, v in votes.items():
        name, n = min(v.items(), key=lambda x: (-x[1], x[0]))
        if name and n >= VOTES and n > 0.5 * sum(v.values()):
            out[leaf] = name
    return out


def unsettled(votes: dict[int, Counter]) -> set[int]:
    """Leaves that hold labels of a subject of which less than ``LEAF_MIX`` of the labels lie in leaves of its own."""
    top, whole, own = majorities(votes), Counter(), Counter()
    for leaf, v in votes.items():
        whole.update(v)
        if leaf in top:
            own[top[leaf]] += v[top[leaf]]
    lost = {name for name, n in whole.items() if name and n >= VOTES and own[name] < LEAF_MIX * n}
    return {leaf for leaf, v in votes.items() if any(n >= VOTES and name in lost and top.get(leaf) != name for name, n in v.items())}


def telling(held: dict[str, Counter], base: Counter) -> set[str]:
    """Terms whose labelled documents are of one subject far more often than all labelled documents, beyond chance."""
    out, whole = set(), max(1, sum(base.values()))
    for term, v in held.items():
        n = sum(v.values())
        for name, hits in v.items():
            share, usual = hits / n, base[name] / whole
            if name and hits >= VOTES and share - (share * (1 - share) / n) ** 0.5 >= usual + APART * (1 - usual):
                out.add(term)
    return out


def leaf_names(sums: dict[int, tuple[float, np.ndarray]], pointing: np.ndarray) -> dict[int, int]:
    """The subject of each leaf to which most weight of its ``TELLING`` most discriminative terms points.

    ``sums`` has weight and term sums per leaf; ``pointing`` [term, subject] is the share of the labelled documents with
    a term that are of a subject, "no area" in the last column.
    """
    whole = sum((s for _, s in sums.values()), np.zeros(len(pointing)))
    weight, out = sum(w for w, _ in sums.values()), {}
    for leaf, (own, s) in sums.items():
        here, usual = s / max(own, 1e-12), whole / max(weight, 1e-12)
        score = np.where(here > 0, here * np.log(np.maximum(here, 1e-300) / np.maximum(usual, 1e-300)), 0)
        best = np.argsort(-score, kind="stable")[:TELLING]
        best = best[(score[best] > 0) & (pointing[best].sum(1) > 0)]
        if not len(best):
            continue
        points = score[best] @ pointing[best]
        name = int(points.argmax())
        if name < pointing.shape[1] - 1 and points[name] >= 0.5 * score[best].sum():
            out[leaf] = name
    return out


def grow_tree(blocks: DataFrame, idf: np.ndarray, total: int, votes_of: Callable[[Tree], dict[int, Counter]]) -> tuple[Tree, dict[int, tuple[float, np.ndarray]]]:
    """The tree, and weight and term sums of each leaf."""
    spark, terms = blocks.sparkSession, len(idf)

    def sums(tree: Tree, seeds: dict[int, tuple[int, int]] | None = None) -> dict[int, tuple[float, np.ndarray, np.ndarray]]:
        """Per node: weight of its documents, sums, square sums. At most nodes * terms numbers reach the driver."""
        shared = spark.sparkContext.broadcast((tree, idf))
        got = blocks.mapInArrow(lambda it: sum_batches(it, shared, seeds), "k bigint, s double, q double").groupBy("k").agg(F.sum("s").alias("s"), F.sum("q").alias("q")).toArrow()
        shared.unpersist()
        k, s, q = (got.column(c).to_numpy() for c in ("k", "s", "q"))
        out = {}
        for node in np.unique(k // (terms + 1)).tolist():
            mine = k // (terms + 1) == node
            t, a, b = k[mine] % (terms + 1), np.zeros(terms + 1), np.zeros(terms + 1)
            a[t], b[t] = s[mine], q[mine]
            out[node] = (a[0], a[1:], b[1:])
        return out

    def cuts(found: dict, sides: dict[int, tuple[int, int]]) -> dict[int, np.ndarray]:
        unit: Callable = lambda v: v / max(np.linalg.norm(v), 1e-12)
        return {n: unit(found[b][1]) - unit(found[a][1]) for n, (a, b) in sides.items() if a in found and b in found}

    tree = Tree(terms)
    fresh = sums(tree)  # the nodes of the last level
    leaves = {n: f[:2] for n, f in fresh.items()}
    for level in itertools.count():
        large = {n for n, (weight, _, _) in fresh.items() if weight >= max(2, LEAF_SHARE * total)} if level < LEVELS else set()
        asked = {n for n, (weight, _, _) in fresh.items() if weight >= 2} - large
        opened = large | (asked & unsettled(votes_of(tree)) if asked else set())
        opened = sorted(opened, key=lambda n: (-fresh[n][0], n))[: LEAVES - len(leaves)]
        seeds = {n: (int(np.argmax(q - s * s / weight)), -2) for n in opened for weight, s, q in [fresh[n]]}
        if not seeds:
            break
        near = sums(tree, seeds)
        for n in list(seeds):
            weight, s, q = fresh[n]
            # documents alike in all terms have no variance but rounding, so no one may hold the seed; such a node stays a leaf
            close, own, _ = near.get(2 * n + 2, fresh[n])
            apart = own / close < 0.5 * s / weight
            if apart.any():
                seeds[n] = (seeds[n][0], int(np.argmax(np.where(apart, q - s * s / weight, -1))))
            else:
                del seeds[n]
        if not seeds:
            break
        found, sides = sums(tree, seeds), {n: (2 * n + 1, 2 * n + 2) for n in seeds}
        for _ in range(REFINE):
            centres = cuts(found, sides)
            if not centres:
                return tree, leaves
            tried = tree.split(centres)
            found, sides = sums(tried), {n: tried.children(n) for n in centres}
        tree = tried
        leaves = {n: f for n, f in leaves.items() if n not in centres} | {c: found[c][:2] for n in centres for c in sides[n] if c in found}
        # a node that ends up whole in one child would be split the same way again
        fresh = {c: found[c] for n in centres for c in sides[n] if all(x in found for x in sides[n])}
    return tree, leaves


def leaf_batches(batches: Iterable[pa.RecordBatch], shared) -> Iterator[pa.RecordBatch]:
    tree, idf = shared.value
    for docs, row, term, count in open_blocks(batches):
        node = tree.descend(row, term, weights(row, term, count, idf, len(docs)), len(docs))
        yield pa.RecordBatch.from_arrays([pa.array(docs), pa.array(node)], ["doc", "leaf"])


def lean_batches(batches: Iterable[pa.RecordBatch], shared, leaf_subject: np.ndarray, subjects: int) -> Iterator[pa.RecordBatch]:
    """Documents per (term, subject of the leaf they lie in); subject -1 is none."""
    tree, idf = shared.value
    total = np.zeros((len(idf), subjects + 1), np.int64)
    for docs, row, term, count in open_blocks(batches):
        node = tree.descend(row, term, weights(row, term, count, idf, len(docs)), len(docs))
        np.add.at(total, (term, leaf_subject[node][row] + 1), 1)
    t, s = np.nonzero(total)
    if len(t):
        yield pa.RecordBatch.from_arrays([pa.array(t), pa.array(s - 1), pa.array(total[t, s])], ["term", "subject", "n"])


def evidence(n: int, row: np.ndarray, term: np.ndarray, count: np.ndarray, term_subject: np.ndarray, share: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Weight of each subject in each of ``n`` documents, 0 where there isn't enough, and the best subjects in order."""
    s = term_subject[term]
    on = s >= 0
    cell = row[on] * k + s[on]
    mentions = np.bincount(cell, count[on], n * k).reshape(-1, k)
    terms = np.bincount(cell, minlength=n * k).reshape(-1, k)
    weight = np.bincount(cell, count[on] * share[term[on]], n * k).reshape(-1, k)
    weight = np.where((mentions >= MENTIONS) & (terms >= TERMS), weight, 0)
    return weight, np.argsort(-weight, axis=1, kind="stable")[:, :AREAS]


def again_batches(batches: Iterable[pa.RecordBatch], shared, terms: int, k: int) -> Iterator[pa.RecordBatch]:
    """Documents per (term, subject they got); subject -1 counts all documents with the term."""
    total = np.zeros((terms, k + 1), np.int64)
    for docs, row, term, count in open_blocks(batches):
        weight, best = evidence(len(docs), row, term, count, *shared.value, k)
        got = np.zeros((len(docs), k + 1), np.int64)
        got[:, 0] = 1
        np.put_along_axis(got[:, 1:], best, np.take_along_axis(weight, best, 1) > 0, 1)
        d, s = np.nonzero(got[row])
        np.add.at(total, (term[d], s), 1)
    t, s = np.nonzero(total)
    if len(t):
        yield pa.RecordBatch.from_arrays([pa.array(t), pa.array(s - 1), pa.array(total[t, s])], ["term", "subject", "n"])


def subject_batches(batches: Iterable[pa.RecordBatch], shared, names: list[str]) -> Iterator[pa.RecordBatch]:
    """Subjects of each document by the evidence of its terms."""
    for docs, row, term, count in open_blocks(batches):
        weight, best = evidence(len(docs), row, term, count, *shared.value, len(names))
        doc = np.repeat(np.arange(len(docs)), best.shape[1])
        pick = best.ravel()
        keep = weight[doc, pick] > 0
        doc, pick = doc[keep], pick[keep]
        yield pa.RecordBatch.from_arrays([pa.array(docs[doc]), pa.array([names[i] for i in pick.tolist()], pa.string()), pa.array(weight[doc, pick] / np.maximum(weight.sum(1)[doc], 1e-12))], ["doc", "subject", "share"])


def match_label(label: str, names: list[str]) -> str | None:
    """The subject a hand-written label means: equal, else a common beginning of five letters, else the only subject
    that has the label's letters in this order from the same first letter."""
    label = label.strip().lower()
    if label in names:
        return label
    alike = [n for n in names if len(label) >= 5 and n[:5] == label[:5]]
    if not alike and label:
        alike = [n for n in names if n[0] == label[0] and all(c in it for it in [iter(n)] for c in label)]
    return alike[0] if len(alike) == 1 else None


class Model:
    """What the passes leave on the driver: bounded by vocabulary and tree, not by documents."""

    def __init__(self, blocks, names, vocabulary, tree, idf, leaf_subject, term_subject, share):
        self.blocks, self.names, self.vocabulary, self.tree, self.idf = blocks, names, vocabulary, tree, idf
        self.leaf_subject, self.term_subject, self.share = leaf_subject, term_subject, share


def fit(docs: DataFrame, doc: str, text: str, labels: DataFrame, label: str, names: list[str]) -> Model:
    """Vectors, tree, leaf labels and term shares from all documents and all labels.

    ``labels`` has ``doc`` and ``label``; null labels mean no area. Null ids and texts are left out, and documents
    without a vocabulary term (empty ones too) have no subject. ``names`` is a fixed list of subjects.
    """
    spark, names = docs.sparkSession, sorted(names)
    rows = docs.where(F.col(doc).isNotNull() & F.col(text).isNotNull()).select(F.col(doc).cast("bigint").alias("doc"), F.col(text).alias("text"))
    worded = cut(spread(rows).mapInArrow(word_batches, "doc bigint, terms string, counts binary"))
    total = worded.count()
    df = worded.mapInArrow(df_batches, "term string, n bigint").groupBy("term").agg(F.sum("n").alias("n"))
    given = labels.select(F.col(doc).cast("bigint").alias("doc"), F.coalesce(F.lower(F.trim(label)), F.lit("")).alias("label")).distinct()

    def by_name(counted: DataFrame, key: str) -> dict:
        """Label counts per key and subject ('' for no area); keys * spellings reach the driver."""
        out: dict = {}
        for r in counted.groupBy(key, "label").count().collect():
            name = match_label(r["label"], names)
            if name or not r["label"]:
                out.setdefault(r[key], Counter())[name or ""] += r["count"]
        return out

    marked = cut(worded.join(given.select("doc").distinct(), "doc", "left_semi"))
    # at most the words of an average document over MOST
    common = df.where(F.col("n") > max(2, MOST * total)).select("term")
    labelled = marked.join(given, "doc").select("label", F.explode(F.split("terms", " ")).alias("term"))
    base = by_name(marked.join(given, "doc").select("label", F.lit(0).alias("all")), "all").get(0, Counter())
    told = telling(by_name(labelled.join(common, "term", "left_semi"), "term"), base)
    kept_terms = cut(df.where((F.col("n") >= max(2, LEAST * total)) & ((F.col("n") <= max(2, MOST * total)) | F.col("term").isin(list(told)))))
    kept = kept_terms.toArrow()
    order = np.argsort(kept.column("term").to_numpy(zero_copy_only=False))
    terms = kept.column("term").to_numpy(zero_copy_only=False)[order]
    held = kept.column("n").to_numpy()[order]
    idf = np.log((1 + total) / (1 + held)).astype(np.float64)
    vocabulary = {t: i for i, t in enumerate(terms.tolist())}
    shared = spark.sparkContext.broadcast(vocabulary)
    blocks = cut(worded.mapInArrow(lambda it: block_batches(it, shared), _BLOCK))
    known = cut(marked.mapInArrow(lambda it: block_batches(it, shared), _BLOCK))

    def votes_of(tree: Tree) -> dict[int, Counter]:
        now = spark.sparkContext.broadcast((tree, idf))
        leaves = known.mapInArrow(lambda it: leaf_batches(it, now), "doc bigint, leaf bigint")
        out = by_name(leaves.join(given, "doc"), "leaf")
        now.unpersist()
        return out

    tree, sums = grow_tree(blocks, idf, total, votes_of)
    grown = spark.sparkContext.broadcast((tree, idf))
    # at most vocabulary * spellings numbers
    pointing = np.zeros((len(terms), len(names) + 1))
    for term, v in by_name(labelled.join(kept_terms, "term", "left_semi"), "term").items():
        pointing[vocabulary[term]] = np.array([v[n] for n in [*names, ""]]) / max(1, sum(v.values()))
    leaf_subject = np.full(len(tree.slot), -1, np.int64)
    for leaf, name in leaf_names(sums, pointing).items():
        leaf_subject[leaf] = name

    def counts(counted: DataFrame) -> np.ndarray:
        """Documents per term and subject, subject -1 first; at most terms * subjects numbers arrive."""
        got = counted.groupBy("term", "subject").agg(F.sum("n").alias("n")).toArrow()
        table = np.zeros((len(terms), max(1, len(names)) + 1))
        table[got.column("term").to_numpy(), got.column("subject").to_numpy() + 1] = got.column("n").to_numpy()
        return table

    def best_of(table: np.ndarray, whole: np.ndarray, least: float) -> tuple[np.ndarray, np.ndarray]:
        part = table[:, 1:] / np.maximum(whole, 1)[:, None]
        best = part.argmax(1)
        share = part[np.arange(len(part)), best]
        return np.where(share >= least, best, -1), share

    form = "term bigint, subject bigint, n bigint"
    table = counts(blocks.mapInArrow(lambda it: lean_batches(it, grown, leaf_subject, len(names)), form))
    term_subject, share = best_of(table, table.sum(1), LEAF_MIX)
    first = spark.sparkContext.broadcast((term_subject, share))
    table = counts(blocks.mapInArrow(lambda it: again_batches(it, first, len(terms), max(1, len(names))), form))
    term_subject, share = best_of(table, table[:, 0], TERM_SHARE)
    return Model(blocks, names, terms, tree, idf, leaf_subject, term_subject, share)


def assign(model: Model) -> DataFrame:
    """``doc``, ``subject`` and the subject's ``share`` of the document's evidence."""
    names = model.names
    shared = model.blocks.sparkSession.sparkContext.broadcast((model.term_subject, model.share))
    return model.blocks.mapInArrow(lambda it: subject_batches(it, shared, names), "doc bigint, subject string, share double")
