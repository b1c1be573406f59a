import random

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from helixmill.functions.flat import flat_text
from helixmill.operators import contigs, identifiers, numbering, overlap, pairs, qvz, reshaping, validate
from helixmill.operators.packed_fields import Grammar, split_packed
from helixmill.operators.records import first_delivery
from helixmill.session import unpack


def test_first_delivery(spark):
    rows = [(1, "b", 2), (1, "a", 1), (2, None, 1), (None, "x", 1), (3, "late", None), (3, "early", 5)]
    df = spark.createDataFrame(rows, "k long, v string, t int")
    assert sorted(map(tuple, first_delivery(df, "k", ["v"], "t").collect())) == [(1, "a"), (2, None), (3, "early")]
    assert first_delivery(df.limit(0), "k", ["v"], "t").count() == 0


def test_validation_rules(spark):
    rows = [("ACGTN", "IIIII"), (None, "I"), ("A" * 512, "I" * 512), ("AC", None), ("AC", "I"), ("ACX", "III"), ("", "")]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "read_idx long, seq string, qual string")
    got = [r[0] for r in df.orderBy("read_idx").select(validate.problem()).collect()]
    assert got == [None, "no sequence", "too long", "no quality", "length mismatch", "illegal base", None]
    with pytest.raises(Exception, match="illegal base"):
        validate.require_valid(df.where("read_idx = 5")).collect()
    with pytest.raises(ValueError, match="No reads"):
        validate.count_reads(df.limit(0))


def test_running_total_over_blocks(spark):
    n = 300
    df = spark.range(n).select(F.col("id").alias("i"), (F.col("id") % 7).alias("v"))
    got = {r.i: r.t for r in numbering.running_total(df, "i", F.col("v"), "t", 16).collect()}
    assert got == {i: sum(j % 7 for j in range(i)) for i in range(n)}


def test_delta_and_back(spark):
    random.seed(3)
    rows = [(i // 10, i, random.choice([i * 3, i * 100_000, 5])) for i in range(80)]
    df = spark.createDataFrame(rows, "b long, i long, p long")
    back = numbering.undelta(numbering.delta(df, "b", "i", "p"), "b", "i")
    assert sorted((r.i, r.pos) for r in back.collect()) == [(i, p) for _, i, p in rows]


def test_pair_flags(spark):
    rows = [(1, 5, 0), (1, 40000, 1), (None, None, 2), (3, None, 3), (None, 3, 4), (0, 32766, 0), (0, 32767, 1)]
    df = spark.createDataFrame(rows, "a long, b long, want int")
    assert all(r.want == r.got for r in df.withColumn("got", pairs.pair_flag(F.col("a"), F.col("b"))).collect())


def test_renumbering_keeps_mates_half_apart(spark):
    n = 50
    perm = list(range(2 * n))
    random.Random(1).shuffle(perm)
    order = spark.createDataFrame(list(enumerate(perm)), "new_idx long, old_idx long")
    got = {r.old_idx: r.pair_new_idx for r in pairs.renumber_pairs(order, n).collect()}
    assert sorted(got.values()) == list(range(2 * n))
    assert all(got[i + n] == got[i] + n for i in range(n))


def test_overlap_against_brute_force(spark):
    rng = random.Random(7)
    genome = "".join(rng.choice("ACGT") for _ in range(600))
    turn = str.maketrans("ACGT", "TGCA")
    rows = []
    for i in range(120):
        at = rng.randrange(0, 540)
        s = list(genome[at : at + 60])
        if rng.random() < 0.3:
            s[rng.randrange(60)] = rng.choice("ACGT")
        s = "".join(s)
        rows.append((i, s.translate(turn)[::-1] if rng.random() < 0.5 else s))
    df = spark.createDataFrame(rows, "read_idx long, seq string")
    code = {"A": 0, "C": 1, "G": 2, "T": 3}
    cost = lambda a, b: sum((code[x] ^ code[y]).bit_count() for x, y in zip(a, b))
    windows = overlap.dictionary_windows(60)
    want = set()
    for i, a in rows:
        for j, o in rows:
            if i == j:
                continue
            for shift in range(20):
                for strand, b in (("d", o), ("r", o.translate(turn)[::-1])):
                    for d, (s, e) in enumerate(windows):
                        if e >= len(b):
                            continue
                        if strand == "d" and e + shift < len(a) and b[s : e + 1] == a[s + shift : e + 1 + shift]:
                            c = cost(a[shift:], b)
                        elif strand == "r" and shift < s and e < len(a) + shift and b[s : e + 1] == a[s - shift : e + 1 - shift]:
                            c = cost(a, b[shift:])
                        else:
                            continue
                        if c <= 4:
                            want.add((i, j, shift, strand, d, c))
    got = {(r.read_idx, r.other, r.shift, r.strand, r.dict, r.cost) for r in overlap.overlaps(df, 60, 19).collect()}
    assert got == want and len(got) > 50


def test_contigs_round_trip_and_save_space(spark):
    rng = random.Random(2)
    genome = "".join(rng.choice("ACGT") for _ in range(1500))
    turn = str.maketrans("ACGT", "TGCA")
    rows = []
    for i in range(300):
        at, n = rng.randrange(0, 1400), rng.choice([80, 100, 99, 30, 10])
        s = list(genome[at : at + n])
        for _ in range(rng.choice([0, 0, 1, 2])):
            s[rng.randrange(len(s))] = rng.choice("ACGTN")
        s = "".join(s)
        rows.append((i, s.translate(turn)[::-1] if rng.random() < 0.5 else s))
    rows += [(300, ""), (301, "N" * 50), (302, "ACGT" * 20)]
    df = spark.createDataFrame(rows, "read_idx long, seq string")
    refs, coded = contigs.encode(df, 100)
    assert sorted(map(tuple, contigs.decode(refs, coded).select("read_idx", "seq").collect())) == rows
    stored = sum(len(r.seq) for r in refs.collect()) + sum(len(r.seq) for r in coded.where("contig_id is null").collect())
    assert stored < 0.5 * sum(len(s) for _, s in rows)


def test_votes_break_ties_in_base_order(spark):
    df = spark.createDataFrame([(1, 0, "AN"), (1, 0, "CN"), (1, 0, "GN"), (1, 3, "T")], "contig_id long, pos long, text string")
    assert sorted(map(tuple, contigs.votes(df).collect())) == [(1, 0, "A", 3), (1, 1, "A", 3), (1, 3, "T", 1)]
    assert [r.seq for r in contigs.consensus(df).collect()] == ["AAAT"]


def test_rescue_finds_both_strands(spark):
    rng = random.Random(5)
    genome = "".join(rng.choice("ACGT") for _ in range(3000))
    turn = str.maketrans("ACGT", "TGCA")
    refs = spark.createDataFrame([(7, genome)], "contig_id long, seq string")
    reads = [(1, genome[1500:1560]), (2, genome[100:160].translate(turn)[::-1]), (3, genome[2000:2045].translate(turn)[::-1]), (4, "ACGT" * 15), (5, genome[0:30] + "N" + genome[31:60])]
    got = {r.read_idx: (r.contig_id, r.pos, r.rc, r.cost) for r in overlap.rescue(refs, spark.createDataFrame(reads, "read_idx long, seq string"), 60).collect()}
    assert got.pop(5)[:3] == (7, 0, "d")
    assert got == {1: (7, 1500, "d", 0), 2: (7, 100, "r", 0), 3: (7, 2000, "r", 0)}


def test_rescue_tries_every_read_of_a_bin(spark):
    """A window held by 1300 equal and 1300 different reads, all of which lie on the contig."""
    rng = random.Random(25)
    genome = "".join(rng.choice("ACGT") for _ in range(400))
    text = genome[200:260]
    changed = set()
    while len(changed) < 1300:
        a, b = sorted(rng.sample(range(42, 60), 2))
        changed.add(text[:a] + rng.choice("ACGT") + text[a + 1 : b] + rng.choice("ACGT") + text[b + 1 :])
    reads = list(enumerate([text] * 1300 + sorted(changed)))
    refs = spark.createDataFrame([(7, genome)], "contig_id long, seq string")
    got = overlap.rescue(refs, spark.createDataFrame(reads, "read_idx long, seq string"), 60)
    assert sorted((r.read_idx, r.contig_id, r.pos, r.rc) for r in got.collect()) == [(k, 7, 200, "d") for k, _ in reads]


def test_rescue_reads_across_part_edges(spark, monkeypatch):
    from helixmill.plans import catalog

    rng = random.Random(15)
    genome = "".join(rng.choice("ACGT") for _ in range(9000))
    tiles = spark.createDataFrame([(3, i, genome[i : i + 100]) for i in range(0, 8901, 50)], "contig_id long, pos long, text string")
    reads = spark.createDataFrame([(k, genome[p : p + 80]) for k, p in enumerate((4050, 4095, 8150, 500))], "read_idx long, seq string")
    monkeypatch.setattr(catalog, "contig_reads", lambda *a: tiles)
    monkeypatch.setattr(catalog, "short_reads", lambda *a: reads)
    assert sorted((r.read_idx, r.contig_id, r.pos) for r in catalog.rescue_reads(spark, "").collect()) == [(0, 3, 4050), (1, 3, 4095), (2, 3, 8150), (3, 3, 500)]


def test_rescue_reads_writes_no_contig_as_a_whole(spark, monkeypatch):
    """A contig with a third of all reads is written, as all others, in pieces of bounded length."""
    from helixmill.plans import catalog

    rng = random.Random(35)
    genome = "".join(rng.choice("ACGT") for _ in range(20000))
    tiles = spark.createDataFrame([(3, i, genome[i : i + 100]) for i in range(0, 19901, 50)], "contig_id long, pos long, text string")
    reads = spark.createDataFrame([(k, genome[p : p + 80]) for k, p in enumerate((10, 9000, 19920))], "read_idx long, seq string")
    longest, written = [0], overlap.cut

    def watched(df):
        done = written(df)
        if done.columns == ["packed"]:
            longest.extend(len(x) for r in done.collect() for b in pa.ipc.open_stream(r.packed) for c in b.columns if c.type == pa.string() for x in c.to_pylist())
        for c, kind in done.dtypes:
            if kind == "string":
                longest.append(done.agg(F.max(F.length(c))).first()[0] or 0)
        return done

    monkeypatch.setattr(catalog, "cut", watched)
    monkeypatch.setattr(overlap, "cut", watched)
    monkeypatch.setattr(catalog, "contig_reads", lambda *a: tiles)
    monkeypatch.setattr(catalog, "short_reads", lambda *a: reads)
    assert sorted((r.read_idx, r.pos) for r in catalog.rescue_reads(spark, "").collect()) == [(0, 10), (1, 9000), (2, 19920)]
    assert max(longest) < 4096


def _rescued(contigs, reads, max_len):
    """``rescue`` by trying every place."""
    turn, out = str.maketrans("ACGT", "TGCA"), []
    code = {"A": 0, "C": 1, "G": 2, "T": 3, "N": 4}
    windows = [(0, 20), (21, 41)] if max_len > 50 else [(0, 20 * max_len // 50), (20 * max_len // 50 + 1, 41 * max_len // 50)]
    for k, s in reads:
        best = None
        for c, text in contigs:
            for at in range(len(text) - max_len + 1):
                for rc in "dr":
                    t, pos = (s.translate(turn)[::-1], at + max_len - len(s)) if rc == "r" else (s, at)
                    there, keyed = text[max(pos, 0) : pos + len(s)], text[at : at + max_len]
                    keyed = keyed.translate(turn)[::-1] if rc == "r" else keyed
                    same = any(len(s) > e and keyed[a : e + 1] == s[a : e + 1] for a, e in windows)
                    if pos < 0 or len(there) < len(s) or not same or "N" in keyed:
                        continue
                    cost = sum((code[x] ^ code[y]).bit_count() for x, y in zip(t, there))
                    if cost <= 24 and (best is None or (c, pos, rc) < best[1:4]):
                        best = (k, c, pos, rc, cost)
        if best:
            out.append(best)
    return sorted(out)


@pytest.mark.parametrize("crowded", [1024, 1])
@pytest.mark.parametrize("max_len", [60, 48, 30])
def test_rescue_equals_every_place(spark, monkeypatch, crowded, max_len):
    """Gaps, reads of one letter, reads across windows, repeats; keys with few places and with many take different paths."""
    rng = random.Random(45)
    turn = str.maketrans("ACGT", "TGCA")
    monkeypatch.setattr(overlap, "PART", 64)
    monkeypatch.setattr(overlap, "CROWDED", crowded)
    monkeypatch.setattr(overlap, "CROWD_LETTERS", 2000)
    unique = lambda n: "".join(rng.choice("ACGT") for _ in range(n))
    twice = unique(150)
    contigs = [(5, unique(200) + "A" * 90 + twice + unique(30)), (2, unique(70) + "ACGT" * 30 + twice), (9, unique(40)), (1, "A" * 45 + unique(20))]
    reads = ["A" * n for n in (21, 45, 60, 100)] + ["T" * 60, "A" * 30 + "N" + "A" * 50, "ACGT" * 20, "CGTA" * 14, "A" * 25 + unique(50), "", "ACGT"]
    for c, text in contigs * 12:
        at, n = rng.randrange(len(text)), rng.choice([25, 43, 60, 61, 100])
        s = list(text[at : at + n])
        for _ in range(rng.choice([0, 1, 3])):
            s[rng.randrange(len(s))] = rng.choice("ACGTN")
        s = "".join(s)
        reads.append(s.translate(turn)[::-1] if rng.random() < 0.5 else s)
    reads = list(enumerate(reads + reads[:3]))
    got = overlap.rescue(spark.createDataFrame(contigs, "contig_id long, seq string"), spark.createDataFrame(reads, "read_idx long, seq string"), max_len)
    want = _rescued(contigs, reads, max_len)
    assert sorted((r.read_idx, r.contig_id, r.pos, r.rc, r.cost) for r in got.collect()) == want and len(want) > 25


@pytest.mark.parametrize("part, beyond", [(16, 9), (7, 30), (1000, 10)])
def test_consensus_windows(spark, part, beyond):
    """Windows of a contig equal the stretches of its whole consensus, with gaps, other letters and deep windows."""
    rng = random.Random(55)
    rows = [(c, rng.randrange(0, 300), "".join(rng.choice("ACGTN") for _ in range(rng.choice([0, 1, 12, 40])))) for c in (1, 2) for _ in range(25)]
    rows += [(3, 500, "ACG"), (3, 0, ""), (4, 2, "CC"), (4, 2, "CCTé"), (4, None, "A"), (2, 90, "GATTACA")] + [(2, 90, "GATTACA")] * 3000
    df = spark.createDataFrame(rows, "contig_id long, pos long, text string")
    whole = {r.contig_id: r.seq for r in contigs.consensus(df.where("pos is not null"), 1 << 30).collect()}
    want = sorted((c, k, s[k : k + part + beyond]) for c, s in whole.items() for k in range(0, len(s), part))
    assert sorted(map(tuple, contigs.consensus_windows(df, part, beyond).mapInArrow(unpack, "contig_id long, `from` long, seq string").collect())) == want


def test_qvz_keeps_lengths_and_gets_coarser(spark):
    rng = random.Random(4)
    rows = []
    for i in range(600):
        q, s = 38, ""
        for _ in range(40):
            q = max(2, min(41, q + rng.choice([-3, -1, 0, 0, 1])))
            s += chr(33 + q)
        rows.append((i, s))
    rows += [(600, ""), (601, None)]
    df = spark.createDataFrame(rows, "read_idx long, qual string")
    errors = []
    for ratio in (0.2, 0.5, 1.0):
        out = {r.read_idx: r.qual for r in qvz.quantise(df, ratio).collect()}
        assert all(len(out[i] or "") == len(s or "") and (out[i] is None) == (s is None) for i, s in rows)
        errors.append(sum((ord(a) - ord(b)) ** 2 for i, s in rows if s for a, b in zip(s, out[i])))
    assert errors[0] > errors[1] > errors[2]
    assert out == {r.read_idx: r.qual for r in qvz.quantise(df, 1.0).collect()}
    with pytest.raises(ValueError):
        qvz.quantise(df, 0)


def test_codebook_survives_serialisation():
    import numpy as np

    counts = np.zeros((2, 72, 72), np.int64)
    counts[0, 0, 10:20] = 5
    counts[1, 10:20, 12:22] = 3
    book = qvz.codebook(counts, 0.5, qvz.distortion())
    again = qvz.Codebook.from_dict(book.to_dict())
    assert (again.low == book.low).all() and (again.ratio == book.ratio).all()
    for kind in ("l1", "lorentz"):
        assert qvz.distortion(kind)[3, 3] == 0
    with pytest.raises(ValueError):
        qvz.distortion("other")


def test_split_and_runs(spark):
    df = spark.createDataFrame([(0, "A" * 101, "F" * 100 + "#"), (1, "", ""), (2, "AC", None)], "read_idx long, seq string, qual string")
    pieces = [(r.read_idx, r.piece, len(r.seq)) for r in reshaping.split_long(df, 50).orderBy("read_idx", "piece").collect()]
    assert pieces == [(0, 0, 50), (0, 1, 50), (0, 2, 1), (1, 0, 0), (2, 0, 2)]
    runs = spark.createDataFrame([(0, "FF#F"), (1, "#"), (2, ""), (3, "FFF"), (4, None)], "read_idx long, qual string")
    got = [tuple(r) for r in reshaping.run_lengths(runs).orderBy("read_idx", "n").collect()]
    assert got == [(0, 0, 2, "#"), (0, 1, 1, ""), (1, 0, 0, "#"), (3, 0, 3, "")]


def test_tokens_against_previous(spark):
    df = spark.createDataFrame([(0, "R1.5"), (1, "R1.9"), (2, "R2.9"), (4, "R2.9")], "read_idx long, id string")
    got = {(r.read_idx, r.pos): r.coded for r in identifiers.against_previous(identifiers.tokens(df), 100).collect()}
    assert got[(1, 3)] == "delta" and got[(1, 0)] == "match" and got[(2, 1)] == "delta" and got[(4, 0)] == "alpha"


# --- packed fields ---

CASES = {
    "": [],
    "   ": [],
    "@a": ["@a"],
    "@a,@b": ["@a", "@b"],
    "@a 1/1  @b 2/1": ["@a 1/1", "@b 2/1"],
    "[@a; @b]": ["@a", "@b"],
    " { @a | @b } ": ["@a", "@b"],
    "[@a": ["[@a"],
    '"@a, x";@b': ["@a, x", "@b"],
    '"@a ""1"" b" | "@c \\"2\\" d"': ['@a "1" b', '@c "2" d'],
    "'@a''s', \"it's\"": ["@a's", "it's"],
    ",,@a,": ["", "", "@a", ""],
    '"", "@a"': ["", "@a"],
    "@a\r\n@b\n\r@c": ["@a", "@b", "", "@c"],
    '"@a, @b': ['"@a', "@b"],
    '"@a"x, @b': ['"@a"x', "@b"],
    "@a\t\t@b": ["@a", "", "@b"],
    "  @a": ["@a"],
}


def test_packed_fields(spark):
    g = Grammar()
    for text, want in CASES.items():
        assert [v for v, _ in g.slots(text)] == want, text
    assert [e for _, e in g.slots('"@a, @b')] == ["unclosed quote", ""]
    rows = [(i, t) for i, t in enumerate(CASES)] + [(90, None), (None, "@x")]
    df = spark.createDataFrame(rows, "k long, f string").withColumn("value", F.lit("clash"))
    got = {}
    for r in split_packed(df, "k", "f").orderBy("rid", "slot").collect():
        got.setdefault(r.rid, []).append(r.value)
    assert got == {i: w for i, w in enumerate(CASES.values()) if w}
    assert split_packed(df.limit(0), "k", "f").count() == 0


def test_packed_fields_of_great_length(spark):
    n = 200_000
    values = [v for v, _ in Grammar().slots(",".join(f'"@r{i} ""x"""' for i in range(n)))]
    assert len(values) == n and values[-1] == f'@r{n - 1} "x"'
    assert len([*Grammar().slots('"' + "a" * 500_000)]) == 1


def test_flat_text_of_a_slice():
    import pyarrow as pa

    flat, offsets = flat_text(pa.array(["ab", "", "c", "dé"]).slice(1, 3))
    assert flat.tobytes() == "cdé".encode() and offsets.tolist() == [0, 0, 1, 4]


def test_chains_of_any_length_and_rings(spark):
    from helixmill.operators import chains

    links = [(i, i + 1, i % 5 + 1) for i in range(100, 137)] + [(1, 2, 4), (7, 8, 1), (8, 9, 1), (9, 7, 1)]
    df = spark.createDataFrame(links, "read_idx long, other long, shift int")
    got = {r.read_idx: (r.chain, r.place, r.pos) for r in chains.chain_places(df).collect()}
    want, pos = {1: (1, 0, 0), 2: (1, 1, 4), 100: (100, 0, 0)}, 0
    for i in range(100, 137):
        pos += i % 5 + 1
        want[i + 1] = (100, i - 99, pos)
    assert got == want
    assert chains.chain_places(df.limit(0)).count() == 0
    best = spark.createDataFrame([(1, 9, 3), (2, 9, 2), (4, 9, 2), (5, 6, 1)], "read_idx long, other long, shift int")
    assert {tuple(r) for r in chains.mutual(best).collect()} == {(2, 9, 2), (5, 6, 1)}


def test_chain_consensus(spark):
    from helixmill.operators import chains

    places = spark.createDataFrame([(1, 1, 0, 0), (2, 1, 1, 2), (3, 1, 2, 3)], "read_idx long, chain long, place long, pos long")
    reads = spark.createDataFrame([(1, "ACGT"), (2, "GTAA"), (3, "TACC")], "read_idx long, seq string")
    rows = sorted(chains.chain_consensus(places, reads).collect(), key=lambda r: r.site)
    assert "".join(r.base for r in rows) == "ACGTAAC" and [r.depth for r in rows] == [1, 1, 2, 3, 2, 2, 1]


def test_multisets_differ(spark):
    from helixmill.operators.records import differing_rows

    a = spark.createDataFrame([(1, None), (1, None), (2, "x")], "k int, v string")
    b = spark.createDataFrame([(2, "x"), (1, None), (3, "y")], "k int, v string")
    assert tuple(differing_rows(a, b).first()) == (1, 1)
    assert tuple(differing_rows(a, a).first()) == (0, 0) == tuple(differing_rows(a.limit(0), a.limit(0)).first())


def test_working_folder_is_removed(spark):
    import os

    from helixmill.session import working_folder

    with pytest.raises(ZeroDivisionError):
        with working_folder(spark) as path:
            spark.range(3).write.parquet(f"{path}/x")
            assert os.path.isdir(path.removeprefix("file:"))
            1 / 0
    assert not os.path.exists(path.removeprefix("file:"))


@pytest.mark.parametrize("level", range(10))
def test_every_gzip_level(spark, tmp_path, level):
    from helixmill.sources import fastq

    rows = spark.createDataFrame([(i, i, f"@r{i}", "ACGT" * 50, "I" * 200) for i in range(50)], "read_idx long, pair_idx long, id string, seq string, qual string")
    fastq.write(rows, str(tmp_path / "x"), gzip=True, level=level)
    assert fastq.scan(spark, str(tmp_path / "x")).count() == 50
    size = sum(f.stat().st_size for f in (tmp_path / "x").glob("*.gz"))
    assert size > 20_000 if level == 0 else size < 5_000


def test_bracketed_values():
    g = Grammar(brackets=True)
    cases = {"a,[b,c],d": ["a", "[b,c]", "d"], "(x;(y,z));w": ["(x;(y,z))", "w"], "[a,b": ["[a", "b"], "{a,[b},c]": ["{a,[b}", "c]"], "[[a,b],c]": ["[a,b]", "c"], "a,[b]c,d": ["a", "[b]c", "d"], '"[a,b",c': ["[a,b", "c"]}
    for text, want in cases.items():
        assert [v for v, _ in g.slots(text)] == want, text
    assert [e for _, e in g.slots("x,[a,b")] == ["", "unclosed bracket", ""]
    assert [v for v, _ in Grammar().slots("a,[b,c],d")] == ["a", "[b", "c]", "d"]
    assert len([*g.slots("x," + "[" * 50_000 + ",y" * 1000)]) == 1002
    assert len([*g.slots("x," + "[(" * 20_000 + "]" * 20_000)]) == 2


def test_quantiser_options(spark, tmp_path):
    import numpy as np

    from helixmill.plans import api

    assert api.quality_mode(["qvz", "0.5", "fixed", "d=A", "c=30,20", "seed=3"]) == ("qvz", 0.5, ("fixed", True), ("kind", "l1"), ("clusters", (20.0, 30.0)), ("seed", 3))
    for bad in (["qvz", "0"], ["qvz", "1", "d=X"], ["qvz"], ["qvz", "1", "x"]):
        with pytest.raises(ValueError):
            api.quality_mode(bad)
    own = np.abs(np.arange(72)[:, None] - np.arange(72)) ** 0.5
    (tmp_path / "m.csv").write_text("\n".join(",".join(map(str, r)) for r in own))
    assert np.allclose(qvz.read_matrix(str(tmp_path / "m.csv")), own)
    (tmp_path / "bad.csv").write_text("1,2\n3,4\n")
    with pytest.raises(ValueError):
        qvz.read_matrix(str(tmp_path / "bad.csv"))
    rng = random.Random(4)
    rows = [(i, "".join(chr(33 + rng.randrange(2, 12) + (25 if i % 2 else 0)) for _ in range(30))) for i in range(400)] + [(500, None), (501, "")]
    df = spark.createDataFrame(rows, "read_idx long, qual string")
    plain, split = (qvz.report(df, qvz.quantise(df, 0.3, **o)).first() for o in ({}, {"clusters": (20.0,)}))
    assert plain.symbols == split.symbols == 400 * 30
    assert split.bits_after <= plain.bits_before and split.distortion > 0
    fixed = qvz.report(df, qvz.quantise(df, 1.0, fixed=True)).first()
    assert fixed.bits_after <= 1.1
