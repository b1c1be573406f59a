"""Contigs: placing reads by canonical minimizers, consensus by votes, reads as differences from the consensus.

Reads that share their minimizer (the window with the smallest hash on either strand) are laid over each other at that
window, turned so that it reads forward. That is the whole grouping: no read waits for another, so it needs no order of
work and no bound on a group. A contig of up to ``CROWD`` reads is one stretch of sorted rows: consensus and differences
come out of one pass over it. The consensus of a larger one is a count per position with map-side combine, by as many
tasks as it takes. A read that differs from the consensus too much is left for the rescue join, and what that can't
place is stored as it is.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from helixmill.functions.aligned import apply_noise, cost3, lay_bases, noise, noise_lists, prices
from helixmill.functions.flat import flat_text, mix, ranges, slices, turned_letters, whole_groups
from helixmill.functions.seq import letters, revcomp
from helixmill.operators.numbering import running_total
from helixmill.operators.overlap import RESCUE_LIMIT, rescue
from helixmill.session import PACKED, cut, pack, small, spread

ANCHOR, CROWD = 24, 1 << 14
_ANCHORED = "read_idx bigint, seq string, contig_id bigint, rc string, place bigint"
_LAID = "contig_id bigint, ref string, read_idx bigint, pos bigint, rc string, noise array<struct<dpos: int, code: string>>, read_len int"


def anchor_batches(batches: Iterable[pa.RecordBatch], k: int) -> Iterator[pa.RecordBatch]:
    """Minimizer, its strand and its place in the turned read; reads shorter than ``k`` give no row."""
    code = np.zeros(256, np.uint64)
    code[list(b"ACGT")] = range(4)
    for batch in slices(batches, "seq"):
        flat, offsets = flat_text(batch.column("seq"))
        n = len(flat) - k + 1
        if n < 1:
            continue
        c = code[flat]
        ahead, back = np.zeros(n, np.uint64), np.zeros(n, np.uint64)
        for i in range(k):
            part = c[i : i + n]
            ahead = ahead << np.uint64(2) | part
            back |= (np.uint64(3) - part) << np.uint64(2 * i)
        size = np.diff(offsets)
        row = np.flatnonzero(size >= k)
        if not len(row):
            continue
        low = np.minimum(ahead, back)
        rank = mix(low)
        at = np.arange(n)
        owner = np.searchsorted(offsets, at, "right") - 1
        inside = at + k <= offsets[owner + 1]
        rank = np.where(inside, rank, np.iinfo(np.uint64).max)
        # windows that cross the end of a read never win; the first smallest one does
        best = np.minimum.reduceat(rank, offsets[row])
        hit = np.flatnonzero(inside)
        slot = np.full(len(size), -1)
        slot[row] = np.arange(len(row))
        hit = hit[rank[hit] == best[slot[owner[hit]]]]
        hit = hit[np.unique(owner[hit], return_index=True)[1]]
        place = hit - offsets[row]
        turned = back[hit] < ahead[hit]
        place = np.where(turned, size[row] - k - place, place)
        yield pa.RecordBatch.from_arrays(
            [batch.column("read_idx").take(pa.array(row)), batch.column("seq").take(pa.array(row)), pa.array(low[hit].view(np.int64)), pa.array(np.where(turned, "r", "d")), pa.array(place)], ["read_idx", "seq", "contig_id", "rc", "place"]
        )


def lay_out(reads: DataFrame, k: int = ANCHOR) -> DataFrame:
    """Contig, strand and position (from 0 in the contig) of clean reads of at least ``k`` bases, and their turned text.

    ``members`` is the number of reads of the contig.
    """
    return spread_out(reads.select("read_idx", "seq").mapInArrow(lambda it: anchor_batches(it, k), _ANCHORED))


def spread_out(rows: DataFrame) -> DataFrame:
    """``lay_out`` of anchored reads."""
    deepest = rows.groupBy("contig_id").agg(F.max("place").alias("deepest"), F.count("*").alias("members"))
    placed = rows.join(deepest, "contig_id")
    text = F.when(F.col("rc") == "r", revcomp("seq")).otherwise(F.col("seq"))
    return placed.select("read_idx", "contig_id", "rc", (F.col("deepest") - F.col("place")).alias("pos"), text.alias("text"), "members")


def votes(placed: DataFrame, contig: str = "contig_id", pos: str = "pos", text: str = "text") -> DataFrame:
    """Consensus base and depth of each covered position: most votes, equal votes in the order A, C, G, T.

    Letters other than A, C, G, T don't vote; a position without votes is A.
    """
    cells = placed.select(contig, pos, F.posexplode(letters(text)).alias("i", "b")).select(contig, (F.col(pos) + F.col("i")).alias("site"), "b")
    count = [F.count_if(F.col("b") == x).alias(x) for x in "ACGT"]
    n = cells.groupBy(contig, "site").agg(*count, F.count("*").alias("depth"))
    top = F.greatest(*[F.col(x) for x in "ACGT"])
    base = F.when(top == 0, "A")
    for x in "ACGT":
        base = base.when(F.col(x) == top, x)
    return n.select(contig, "site", base.alias("base"), "depth")


def consensus(placed: DataFrame, part: int = 1 << 16) -> DataFrame:
    """Consensus strings in parts of ``part`` positions: ``contig_id``, ``part_no``, ``first``, ``seq``.

    A part begins at its first covered position; gaps inside it are A.
    """
    v = votes(placed)
    grouped = v.groupBy("contig_id", F.floor(F.col("site") / part).alias("part_no")).agg(F.min("site").alias("first"), F.collect_list(F.struct("site", "base")).alias("cells"))
    return grouped.select("contig_id", "part_no", "first", lay_bases("cells").alias("seq"))


def vote_batches(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pieces of reads sorted by contig and window in, the consensus of each window out.

    ``size`` is the length of the window; a piece lies at ``off`` in it. Votes are added up piece by piece, so a window of
    any depth takes the memory of its own length.
    """
    code = np.full(256, -1, np.int64)
    code[list(b"ACGT")] = range(4)

    def made(contig, start, size, vote):
        best = np.frombuffer(b"ACGT", np.uint8)[vote.argmax(1)]  # the first of equals, A where nothing is laid
        texts = pa.StringArray.from_buffers(len(size), pa.py_buffer(np.append(0, np.cumsum(size)).astype(np.int32).tobytes()), pa.py_buffer(best.tobytes()))
        return pa.RecordBatch.from_arrays([pa.array(contig), pa.array(start), texts], ["contig_id", "from", "seq"])

    held = None
    for whole in batches:
        contig, start, size = (whole.column(c).to_numpy() for c in ("contig_id", "from", "size"))
        new = np.concatenate([[True], (contig[1:] != contig[:-1]) | (start[1:] != start[:-1])]) if len(contig) else np.zeros(0, bool)
        weight = np.where(new, size, 0) + pc.binary_length(whole.column("text")).to_numpy()
        edges = [0, *(np.flatnonzero(np.diff(np.cumsum(weight) >> 18)) + 1).tolist(), len(contig)]
        for a, b in zip(edges, edges[1:]):
            if b == a:
                continue
            head = np.union1d(np.flatnonzero(new[a:b]), [0]) + a
            group = np.repeat(np.arange(len(head)), np.diff(np.append(head, b)))
            names, at, width = contig[head], start[head], size[head]
            base = np.cumsum(width) - width
            flat, offsets = flat_text(whole.column("text").slice(a, b - a))
            site, letter = ranges(base[group] + whole.column("off").to_numpy()[a:b], np.diff(offsets))[0], code[flat]
            voting = letter >= 0
            vote = np.bincount(site[voting] * 4 + letter[voting], minlength=int(width.sum()) * 4).reshape(-1, 4)
            if held and (held[0][0], held[1][0]) == (names[0], at[0]):
                vote[: width[0]] += held[3]
            elif held:
                yield made(*held)
            if len(head) > 1:
                yield made(names[:-1], at[:-1], width[:-1], vote[: base[-1]])
            held = names[-1:], at[-1:], width[-1:], vote[base[-1] :].copy()
    if held:
        yield made(*held)


def consensus_windows(placed: DataFrame, part: int, beyond: int) -> DataFrame:
    """The whole consensus of each contig in windows, packed: ``contig_id``, ``from``, ``seq``.

    A window begins every ``part`` positions, counted from the first covered one, and has up to ``beyond`` letters more
    than that. Gaps are A. No contig is put together in one row, however long it is.
    """
    text = F.regexp_replace("text", "[^ACGT]", "N")
    rows = placed.where("pos is not null and text <> ''").select("contig_id", "pos", text.alias("text"))
    ends = rows.groupBy("contig_id").agg(F.min("pos").alias("low"), F.max(F.col("pos") + F.length("text")).alias("high"))
    at, n, start = F.col("pos") - F.col("low"), F.col("high") - F.col("low"), F.col("k") * part
    first, last = F.greatest(F.lit(0), F.floor((at - beyond) / part)), F.floor((at + F.length("text") - 1) / part)
    size = F.least(n - start, F.lit(part + beyond)).alias("size")
    pieces = rows.join(ends, "contig_id").withColumn("k", F.explode(F.sequence(first, last)))
    off = F.greatest(at - start, F.lit(0))
    piece = F.substr("text", F.greatest(start - at, F.lit(0)).cast("int") + 1, (F.lit(part + beyond) - off).cast("int"))
    pieces = pieces.select("contig_id", start.alias("from"), size, off.alias("off"), piece.alias("text")).where("text <> ''")
    # one row without letters a window, for those in gaps
    every = ends.withColumn("k", F.explode(F.sequence(F.lit(0).cast("bigint"), F.floor((n - 1) / part)))).where("contig_id is not null")
    every = every.select("contig_id", start.alias("from"), size, F.lit(0).cast("bigint").alias("off"), F.lit("").alias("text"))
    rows = every.unionByName(pieces).repartition(F.xxhash64("contig_id", "from")).sortWithinPartitions("contig_id", "from")
    return rows.mapInArrow(lambda it: pack(vote_batches(it)), PACKED)


def rebase(placed: DataFrame) -> DataFrame:
    """Positions counted from the smallest of the contig."""
    low = placed.groupBy("contig_id").agg(F.min("pos").alias("_low"))
    return placed.join(low, "contig_id").withColumn("pos", F.col("pos") - F.col("_low")).drop("_low")


def absolute_starts(contigs: DataFrame) -> DataFrame:
    """Start of each contig when all are put end to end in the order of ``contig_no``."""
    return running_total(contigs, "contig_no", F.col("len"), "abs_start")


def lay_batches(batches: Iterable[pa.RecordBatch], limit: int) -> Iterator[pa.RecordBatch]:
    """Rows sorted by contig in, consensus and laid reads out: a row with ``ref`` per contig of two reads or more, and
    one with the differences per read within ``limit`` code bits of it."""
    code = np.zeros(256, np.int64)
    code[list(b"ACGT")] = range(4)
    for rows in whole_groups(batches, ["contig_id"]):
        contig = rows.column("contig_id").to_numpy()
        head = np.flatnonzero(np.concatenate([[True], contig[1:] != contig[:-1]]))
        count = np.diff(np.append(head, len(contig)))
        rows = rows.filter(pa.array(np.repeat(count > 1, count))).combine_chunks()
        if not rows.num_rows:
            continue
        names, count = contig[head[count > 1]], count[count > 1]
        head, group = np.cumsum(count) - count, np.repeat(np.arange(len(count)), count)
        flat, offsets = flat_text(rows.column("seq").combine_chunks())
        size, place = np.diff(offsets), rows.column("place").to_numpy()
        text = turned_letters(flat, offsets, np.asarray(rows.column("rc").to_numpy(zero_copy_only=False) == "r"))
        pos = np.maximum.reduceat(place, head)[group] - place
        length = np.maximum.reduceat(pos + size, head)
        base = np.cumsum(length) - length
        site = ranges(base[group] + pos, size)[0]
        vote = np.bincount(site * 4 + code[text], minlength=int(length.sum()) * 4).reshape(-1, 4)
        best = np.frombuffer(b"ACGT", np.uint8)[vote.argmax(1)]  # the first of equals, A where nothing is laid
        ref = best[site]
        price = np.append(0, np.cumsum(prices(text, ref)))
        near = np.flatnonzero(price[offsets[1:]] - price[offsets[:-1]] <= limit)
        refs = pa.StringArray.from_buffers(len(names), pa.py_buffer(np.append(0, np.cumsum(length)).astype(np.int32).tobytes()), pa.py_buffer(best.tobytes()))
        blank = lambda n, kind: pa.nulls(n, kind)
        diffs = noise_lists(text, ref, offsets)
        n = len(names)
        yield pa.RecordBatch.from_arrays([pa.array(names), refs, blank(n, pa.int64()), blank(n, pa.int64()), blank(n, pa.string()), blank(n, diffs.type), blank(n, pa.int32())], ["contig_id", "ref", "read_idx", "pos", "rc", "noise", "read_len"])
        at = pa.array(near)
        columns = [pa.array(names[group[near]]), blank(len(near), pa.string()), rows.column("read_idx").combine_chunks().take(at), pa.array(pos[near]), rows.column("rc").combine_chunks().take(at), diffs.take(at), pa.array(size[near].astype(np.int32))]
        yield pa.RecordBatch.from_arrays(columns, ["contig_id", "ref", "read_idx", "pos", "rc", "noise", "read_len"])


def crowded_contigs(rows: DataFrame, limit: int) -> DataFrame:
    """The same for contigs with any number of reads."""
    placed = cut(spread_out(rows))
    refs = cut(consensus(placed, 1 << 30).select("contig_id", F.col("seq").alias("ref")))
    both = placed.join(refs, "contig_id")
    near = both.withColumn("there", F.substr("ref", (F.col("pos") + 1).cast("int"), F.length("text"))).where(cost3("text", "there") <= limit)
    laid = near.select("contig_id", F.lit(None).cast("string").alias("ref"), "read_idx", "pos", "rc", noise("text", "there").alias("noise"), F.length("text").alias("read_len"))
    empty = [F.lit(None).cast(kind).alias(c) for c, kind in (("read_idx", "bigint"), ("pos", "bigint"), ("rc", "string"), ("noise", "array<struct<dpos: int, code: string>>"), ("read_len", "int"))]
    return refs.select("contig_id", "ref", *empty).unionByName(laid)


def encode(reads: DataFrame, max_len: int, limit: int = RESCUE_LIMIT) -> tuple[DataFrame, DataFrame]:
    """Contigs (``contig_id``, ``seq``) and one row per read: ``read_idx``, ``contig_id``, ``pos``, ``rc``, ``noise``,
    ``read_len`` and ``seq``, which is null for placed reads and the read itself for the others.

    ``reads`` (a written table) have ``read_idx`` and ``seq`` over A, C, G, T, N. A read alone in its contig
    makes none; it may be placed on another contig like the reads with N and those that differ too much.
    """
    clean = reads.where(~F.contains("seq", F.lit("N")))
    rows = cut(spread(clean.select("read_idx", "seq")).mapInArrow(lambda it: anchor_batches(it, ANCHOR), _ANCHORED))
    crowd = cut(rows.groupBy("contig_id").agg(F.count("*").alias("n")).where(F.col("n") > CROWD).select("contig_id"))
    n = crowd.count()
    few = rows if not n else rows.join(small(crowd, n), "contig_id", "left_anti")
    # by a hash of the contig: see the note on equal partitionings in ``helixmill.functions.flat.whole_groups``
    sorted_rows = few.repartition(F.xxhash64("contig_id")).sortWithinPartitions("contig_id", "read_idx")
    laid = sorted_rows.mapInArrow(lambda it: lay_batches(it, limit), _LAID)
    laid = cut(laid if not n else laid.unionByName(crowded_contigs(rows.join(small(crowd, n), "contig_id", "left_semi"), limit)))
    refs = laid.where("read_idx is null").select("contig_id", F.col("ref").alias("seq"))
    members = laid.where("read_idx is not null").select("read_idx", "contig_id", "pos", "rc", "noise", "read_len")
    left = cut(reads.select("read_idx", "seq").join(members.select("read_idx"), "read_idx", "left_anti"))
    found = rescue(refs, left, min(max_len, 2 * ANCHOR), limit)
    saved = left.join(found, "read_idx", "left").join(refs.select("contig_id", F.col("seq").alias("ref")), "contig_id", "left")
    turned = F.when(F.col("rc") == "r", revcomp("seq")).otherwise(F.col("seq"))
    there = F.substr("ref", (F.col("pos") + 1).cast("int"), F.length("seq"))
    off = F.col("contig_id").isNull()
    saved = saved.withColumn("turned", turned).withColumn("there", there).select("read_idx", "contig_id", "pos", "rc", noise("turned", "there").alias("noise"), F.length("seq").alias("read_len"), F.when(off, F.col("seq")).alias("seq"))
    return refs, members.withColumn("seq", F.lit(None).cast("string")).unionByName(saved)


def decode(contigs: DataFrame, rows: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """``read_idx`` and ``seq`` from what ``encode`` gave, and further columns of the rows."""
    both = rows.join(contigs.select("contig_id", F.col("seq").alias("ref")), "contig_id", "left")
    there = F.substr("ref", (F.col("pos") + 1).cast("int"), F.col("read_len"))
    text = apply_noise(there, "noise")
    turned = F.when(F.col("rc") == "r", revcomp(text)).otherwise(text)
    return both.select("read_idx", *keep, F.coalesce(F.col("seq"), turned).alias("seq"))
