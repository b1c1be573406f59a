import gzip
import random

import pytest

from helixmill.plans import api
from helixmill.sources import archive, fastq, packed


def records(n, seed=1, paired=False):
    rng = random.Random(seed)
    genome = "".join(rng.choice("ACGT") for _ in range(800))
    out = []
    for i in range(n):
        at = rng.randrange(0, 700)
        s = genome[at : at + rng.choice([100, 100, 99, 38, 0, 4])]
        if s and rng.random() < 0.3:
            k = rng.randrange(len(s))
            s = s[:k] + rng.choice("ACGTN") + s[k + 1 :]
        out.append((f"@run.{i + 1} {i + 1}/1", s, "".join(chr(33 + rng.randrange(2, 41)) for _ in s)))
    return out


def put(path, rows, fasta=False, end="\n", zipped=False):
    text = "".join(f"{i}{end}{s}{end}" + ("" if fasta else f"+{end}{q}{end}") for i, s, q in rows)
    data = gzip.compress(text.encode()) if zipped else text.encode()
    path.write_bytes(data)
    return str(path)


def as_rows(df, mate=None):
    rows = df.where(df["mate"] == mate) if mate else df
    return [(r.id, r.seq, r.qual) for r in rows.orderBy("read_idx").collect()]


def read_back(folder):
    out = []
    for f in sorted(folder.glob("part-*")):
        out += (gzip.decompress(f.read_bytes()) if f.suffix == ".gz" else f.read_bytes()).decode().split("\n")[:-1]
    return out


@pytest.mark.parametrize("end", ["\n", "\r\n"])
def test_scan(spark, tmp_path, end):
    rows = records(30) + [("", "", ""), ("@x", "ACGT", "IIII")]
    assert as_rows(fastq.scan(spark, put(tmp_path / "a.fastq", rows, end=end))) == rows
    fasta = put(tmp_path / "a.fasta", rows, fasta=True, end=end)
    assert as_rows(fastq.scan(spark, fasta, fasta=True)) == [(i, s, None) for i, s, _ in rows]


def test_scan_in_many_blocks(spark, tmp_path):
    rows = records(3000, 5)
    path = put(tmp_path / "big.fastq", rows)
    spark.conf.set("spark.sql.files.maxPartitionBytes", "65536")
    try:
        df = fastq.scan(spark, path)
        assert fastq.numbered_lines(spark, path).rdd.getNumPartitions() >= 1
        assert as_rows(df) == rows
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_truncated_file_raises(spark, tmp_path):
    p = tmp_path / "t.fastq"
    p.write_text("@a\nACGT\n+\n")
    with pytest.raises(Exception, match="not multiple of 4"):
        fastq.scan(spark, str(p)).collect()


@pytest.mark.parametrize("case", ["short", "long", "fasta", "gz", "no_ids", "no_quality"])
def test_single_end(spark, tmp_path, case):
    rows = records(60)
    if case == "long":
        rows.append(("@long", "ACGTX" * 300, "I" * 1500))
    src = put(tmp_path / ("in.fastq.gz" if case == "gz" else "in.fastq"), rows, fasta=case == "fasta", zipped=case == "gz")
    out = str(tmp_path / "arc")
    p = api.compress(spark, [src], out, long_mode=case == "long", fasta=case == "fasta", no_ids=case == "no_ids", no_quality=case == "no_quality")
    assert p.num_reads == len(rows)
    want = [(f"@{i + 1}/1" if case == "no_ids" else a, s, None if case in ("fasta", "no_quality") else q) for i, (a, s, q) in enumerate(rows)]
    target = tmp_path / "out"
    assert as_rows(api.decompress(spark, out, [str(target)], gzip=case == "gz")) == want
    lines = [x for i, s, q in want for x in ((i, s) if q is None else (i, s, "+", q))]
    assert read_back(target) == lines


@pytest.mark.parametrize("pattern,reorder", [("slash", True), ("blank", False), ("none", False), ("none", True)])
def test_paired_end(spark, tmp_path, pattern, reorder):
    one = records(40, 1)
    two = records(40, 2)
    if pattern == "slash":
        two = [(i[:-1] + "2", s, q) for (i, _, _), (_, s, q) in zip(one, two)]
    elif pattern == "blank":
        one = [(f"@r{k} 1:N:0", s, q) for k, (_, s, q) in enumerate(one)]
        two = [(f"@r{k} 2:N:0", s, q) for k, (_, s, q) in enumerate(two)]
    else:
        two = [("" if k == 3 else i, s, q) for k, (i, s, q) in enumerate(two)]
    a, b = put(tmp_path / "1.fastq", one), put(tmp_path / "2.fastq", two)
    out = str(tmp_path / "arc")
    p = api.compress(spark, [a, b], out, allow_reorder=reorder)
    assert p.id_pattern == {"slash": 1, "blank": 3, "none": 0}[pattern]
    got = api.decompress(spark, out, [str(tmp_path / "o")])
    first, second = as_rows(got, 1), as_rows(got, 2)
    if reorder:
        assert sorted(zip(first, second)) == sorted(zip(one, two))
    else:
        assert first == one and second == two
    assert len(read_back(tmp_path / "o.1")) == len(read_back(tmp_path / "o.2")) == 160


def test_unequal_mates_raise(spark, tmp_path):
    a, b = put(tmp_path / "1.fastq", records(3)), put(tmp_path / "2.fastq", records(4))
    with pytest.raises(ValueError, match="do not match"):
        api.compress(spark, [a, b], str(tmp_path / "x"))


def test_ranges(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(archive, "LONG_BLOCK", 10)
    rows = records(35)
    out = str(tmp_path / "arc")
    api.compress(spark, [put(tmp_path / "in.fastq", rows)], out, long_mode=True)
    for first, last in [(1, 1), (35, 35), (10, 11), (1, 35), (20, 20)]:
        assert as_rows(api.decompress(spark, out, first=first, last=last)) == rows[first - 1 : last]
    for first, last in [(0, 1), (2, 1), (1, 36)]:
        with pytest.raises(ValueError):
            api.decompress(spark, out, first=first, last=last)
    assert {r["stream"] for r in archive.archive_sizes(spark, out).collect()} == {"read", "quality", "id"}


def test_lossy_modes(spark, tmp_path):
    rows = records(40)
    src = put(tmp_path / "in.fastq", rows)
    level = lambda q: max(v for f, v in zip((0, 2, 10, 20, 25, 30, 35, 40), (0, 6, 15, 22, 27, 33, 37, 40)) if q >= f)
    forms = {("ill_bin",): level, ("binary", 20, 37, 6): lambda q: 37 if q >= 20 else 6}
    for mode, f in forms.items():
        out = str(tmp_path / mode[0])
        api.compress(spark, [src], out, quality=mode, long_mode=True)
        assert as_rows(api.decompress(spark, out)) == [(i, s, "".join(chr(33 + f(ord(c) - 33)) for c in q)) for i, s, q in rows]
    api.compress(spark, [src], str(tmp_path / "qvz"), quality=("qvz", 0.5), long_mode=True)
    assert [(i, s, len(q)) for i, s, q in as_rows(api.decompress(spark, str(tmp_path / "qvz")))] == [(i, s, len(q)) for i, s, q in rows]


def test_options():
    assert api.quality_mode(["binary", "20", "37", "6"]) == ("binary", 20, 37, 6)
    for bad in (["binary", "20", "10", "6"], ["qvz", "0"], ["qvz"], ["other"]):
        with pytest.raises(ValueError):
            api.quality_mode(bad)
    with pytest.raises(SystemExit):
        api.parser().parse_args(["-c", "-d", "-i", "a", "-o", "b"])
    a = api.parser().parse_args(["-d", "-i", "a", "-o", "b", "--decompress-range", "1", "5"])
    assert a.decompress_range == [1, 5]


def test_packed_format():
    rng = random.Random(3)
    for n in (0, 1, 3, 4, 5, 101, 511):
        s = "".join(rng.choice("ACGT") for _ in range(n))
        assert [*packed.unpack_reads(packed.pack_read(s) * 2)] == [s, s]
        t = s + "N"
        assert [*packed.unpack_reads(packed.pack_read(t, True), True)] == [t]
    assert packed.pack_read("AGCT") == b"\x04\x00\xe4"
    with pytest.raises(ValueError):
        packed.pack_read("ACGX")
