"""Whole paths through files and archives, each against the rows that went in, and counts of what an archive holds."""

from __future__ import annotations

from pyspark.sql import functions as F

from helixmill.functions import quality, seq
from helixmill.operators import chains, overlap, pairs, qvz, stats
from helixmill.operators.records import differing_rows
from helixmill.plans import api
from helixmill.plans.catalog import _BOUNDS, QUERIES, SQL, _CELLS, _CLEAN_PLACED, _KEYS, _KIND, _L, _P, _PLACED, _READS, _clean_placed, _folder, _recode_sql, query, reads, short_reads, sql
from helixmill.sources import archive, fastq

__all__ = ["QUERIES", "SQL"]

# --- more distributions ---------------------------------------------------------------------------------------------

_GROUPED = """
gm as (select read_idx, avg(q) as m from cells group by read_idx),
gr as (select read_idx, case when m < 35 then 3 when m < 30 then 2 when m < 25 then 1 when m < 20 then 0 else 4 end as grp from gm)"""


@query
def quality_pair_counts(spark, sf):
    """Counts of two neighbouring values per group by mean quality and column."""
    return stats.order_counts(stats.quality_clusters(reads(spark, sf), _BOUNDS), "grp", 1)


sql("quality_pair_counts", "select grp, col, q, q1, count(*) as cnt from cells join gr using (read_idx) where q1 is not null group by 1, 2, 3, 4", _READS, _CELLS, _GROUPED)


@query
def quality_triple_counts(spark, sf):
    """Counts of three neighbouring values per group by mean quality and column."""
    return stats.order_counts(stats.quality_clusters(reads(spark, sf), _BOUNDS), "grp", 2)


sql("quality_triple_counts", "select grp, col, q, q1, q2, count(*) as cnt from cells join gr using (read_idx) where q2 is not null group by 1, 2, 3, 4, 5", _READS, _CELLS, _GROUPED)


def _noise_sql(by: str) -> str:
    """Bits of one, two and three neighbours per column (and group), then the sums of the orders."""
    own, on = (f"{by}, ", f"({by}, col)") if by else ("", "(col)")
    joint = []
    for k in range(3):
        kinds = [[(w >> (k - i)) & 1 for i in range(k + 1)] for w in range(2 ** (k + 1))]
        terms = ", ".join("avg(" + " * ".join(f"e{i}" if w else f"(1 - e{i})" for i, w in enumerate(ws)) + f") as p{n}" for n, ws in enumerate(kinds))
        bits = " + ".join(f"(case when p{n} > 0 then -p{n} * log2(p{n}) else 0 end) + {sum(ws)} * p{n} * {_KIND}" for n, ws in enumerate(kinds))
        joint.append(f"j{k} as (select {own}col, {bits} as h{k} from (select {own}col, {terms} from e where e{k} is not null group by {own}col))")
    return ", ".join(joint) + f""", o as (select {own}sum(h0) as order0, max(h0) filter (where col = 0) + coalesce(sum(h1 - h0), 0) as order1, max(h1) filter (where col = 0) + coalesce(sum(h2 - h1), 0) as order2
        from j0 left join j1 using {on} left join j2 using {on} {"group by " + by if by else ""})"""


_E = "e as (select *, pow(10.0, -q / 10.0) as e0, pow(10.0, -q1 / 10.0) as e1, pow(10.0, -q2 / 10.0) as e2 from cells)"


@query
def noise_orders(spark, sf):
    """Bits per read of substitution noise at order 0, 1 and 2."""
    return stats.joint_noise_entropy(reads(spark, sf)).select(*[F.round(c, 4).alias(c) for c in ("order0", "order1", "order2")])


sql("noise_orders", "!" + _E + ", " + _noise_sql("") + " select round(order0, 4) as order0, round(order1, 4) as order1, round(order2, 4) as order2 from o", _READS, _CELLS)


@query
def noise_mixture(spark, sf):
    """The same when each group by mean quality has its own noise, and the bits of the group."""
    grouped = stats.quality_clusters(reads(spark, sf), _BOUNDS)
    return stats.noise_of_mixture(grouped, "grp").select(*[F.round(c, 4).alias(c) for c in ("label_bits", "order0", "order1", "order2")])


sql("noise_mixture", """!
e as (select *, pow(10.0, -q / 10.0) as e0, pow(10.0, -q1 / 10.0) as e1, pow(10.0, -q2 / 10.0) as e2 from cells join gr using (read_idx)), """ + _noise_sql("grp") + """,
n as (select grp, count(*) * 1.0 as n from gr group by grp), t as (select sum(n) as t from n)
select round(-sum(n / t * log2(n / t)), 4) as label_bits, round(sum(n * order0) / any_value(t), 4) as order0, round(sum(n * order1) / any_value(t), 4) as order1, round(sum(n * order2) / any_value(t), 4) as order2 from o join n using (grp), t""", _READS, _CELLS, _GROUPED)


@query
def quality_mix(spark, sf):
    """Value distributions of both mates mixed three to one."""
    values = reads(spark, sf).where("qual is not null").select("mate", F.explode(quality.phred("qual")).alias("q")).groupBy("mate", "q").agg(F.count("*").cast("double").alias("p"))
    one, two = (stats.renormalise(values.where(F.col("mate") == m).select("q", "p"), "q", "p") for m in (1, 2))
    return stats.mix_distributions(one, two, 3.0, 1.0, "q", "p").select("q", F.round("p", 9).alias("p"))


sql("quality_mix", """!
v as (select mate, q, count(*) * 1.0 as c from cells join reads using (read_idx) group by 1, 2), n as (select mate, sum(c) as n from v group by mate)
select q, round(sum(case mate when 1 then 0.75 else 0.25 end * c / n), 9) as p from v join n using (mate) group by q""", _READS, _CELLS)


# --- files ----------------------------------------------------------------------------------------------------------


def _pairs(spark, sf):
    """Reads of pairs both of whose mates short mode takes, numbered from 0 without gaps."""
    both = short_reads(spark, sf).select("pair_idx").groupBy("pair_idx").agg(F.count("*").alias("n")).where("n = 2").select("pair_idx")
    from helixmill.operators.numbering import running_total

    return short_reads(spark, sf).join(running_total(both, "pair_idx", F.lit(1), "no"), "pair_idx").select(F.col("no").alias("pair_idx"), "mate", "id", "seq", "qual")


_PAIRED = "two as (select pair_idx from short group by pair_idx having count(*) = 2), pd as (select s.* from short s join two using (pair_idx))"


@query
def paired_gzip_round_trip(spark, sf):
    """Both mates through gzip FASTQ files at level 4, a paired archive, and FASTQ files under one output name."""
    path = _folder(spark)
    for m in (1, 2):
        fastq.write(_pairs(spark, sf).where(F.col("mate") == m), f"{path}/in{m}", gzip=True, level=4)
    api.compress(spark, [f"{path}/in1", f"{path}/in2"], f"{path}/archive")
    api.decompress(spark, f"{path}/archive", [f"{path}/out"])
    return fastq.scan_paired(spark, f"{path}/out.1", f"{path}/out.2").select("mate", "id", "seq", "qual")


sql("paired_gzip_round_trip", "select mate, id, seq, qual from pd", _READS, _PAIRED)


@query
def fasta_round_trip(spark, sf):
    """Ids and bases through a FASTA file, an archive without qualities, and FASTA again."""
    path = _folder(spark)
    fastq.write(short_reads(spark, sf), f"{path}/in", quality=False, order="read_idx")
    api.compress(spark, [f"{path}/in"], f"{path}/archive", fasta=True)
    api.decompress(spark, f"{path}/archive", [f"{path}/out"])
    return fastq.scan(spark, f"{path}/out", fasta=True).select("id", "seq")


sql("fasta_round_trip", "select id, seq from short", _READS)


@query
def column_split(spark, sf):
    """Ids, bases and qualities as three texts, put together again by line."""
    path = _folder(spark)
    fastq.write_columns(short_reads(spark, sf), path)
    return fastq.scan_columns(spark, path).select("id", "seq", "qual")


sql("column_split", "select id, seq, qual from short", _READS)


# --- archives -------------------------------------------------------------------------------------------------------


@query
def reorder_round_trip(spark, sf):
    """All reads short mode takes through an archive that may reorder them."""
    path = _folder(spark)
    archive.write_archive(short_reads(spark, sf), path, keep_order=False)
    return archive.read_archive(spark, path).select("id", "seq", "qual")


sql("reorder_round_trip", "select id, seq, qual from short", _READS)


@query
def reorder_difference(spark, sf):
    """The same as a comparison of multisets: rows missing and rows too many."""
    return differing_rows(short_reads(spark, sf).select("id", "seq", "qual"), reorder_round_trip(spark, sf))


sql("reorder_difference", "select cast(0 as bigint) as missing, cast(0 as bigint) as extra", _READS)


@query
def paired_reorder_round_trip(spark, sf):
    """Pairs through a reordering archive: mates stay together."""
    path = _folder(spark)
    rows = _pairs(spark, sf)
    half = rows.where("mate = 1").count()
    numbered = rows.withColumn("read_idx", F.col("pair_idx") + F.when(F.col("mate") == 2, half).otherwise(0))
    archive.write_archive(numbered, path, paired=True, keep_order=False)
    return pairs.join_mates(archive.read_archive(spark, path), ["id", "seq", "qual"]).drop("pair_idx")


sql("paired_reorder_round_trip", "select " + ", ".join(f"max({c}) filter (where mate = {m}) as {c}_{m}" for c in ("id", "seq", "qual") for m in (1, 2)) + " from pd group by pair_idx", _READS, _PAIRED)


@query
def dropped_ids(spark, sf):
    """Ids given to reads whose own weren't kept, in an archive of short mode with qualities of two levels."""
    path = _folder(spark)
    archive.write_archive(short_reads(spark, sf), path, ids=False, mode=("binary", 20, 37, 6))
    return archive.read_archive(spark, path).select("read_idx", "id", "seq", "qual")


sql("dropped_ids", "select read_idx, '@' || (read_idx + 1) || '/1' as id, seq, " + _recode_sql(lambda q: 37 if q >= 20 else 6) + " as qual from short", _READS)


@query
def quantised_archive(spark, sf):
    """An archive with trained quality levels: bases as they were, qualities of equal length."""
    path = _folder(spark)
    archive.write_archive(short_reads(spark, sf), path, mode=("qvz", 0.5))
    return archive.read_archive(spark, path).select("read_idx", "id", "seq", F.length("qual").alias("symbols"))


sql("quantised_archive", "select read_idx, id, seq, length(qual) as symbols from short", _READS)


@query
def quantiser_report(spark, sf):
    """What the quantiser does at two rates: all symbols kept in number, fewer bits, and a distortion that is lower
    at the higher one."""
    rows = reads(spark, sf).where("qual is not null").select("read_idx", "qual")
    out, before = None, None
    for no, (rate, options) in enumerate([(0.2, {}), (0.8, {})]):
        r = qvz.report(rows, qvz.quantise(rows, rate, **options), options.get("kind", "mse")).first()
        falls = no != 1 or r["distortion"] < before
        before = r["distortion"]
        one = spark.createDataFrame([(no, r["symbols"], r["bits_after"] < r["bits_before"], r["distortion"] > 0 and falls)], "setting int, symbols bigint, fewer_bits boolean, falls boolean")
        out = one if out is None else out.unionByName(one)
    return out


sql("quantiser_report", "select cast(setting as integer) as setting, symbols, true as fewer_bits, true as falls from range(0, 2) t(setting), (select count(*) as symbols from cells)", _READS, _CELLS)


@query
def archive_counts(spark, sf):
    """Reads, clean reads, reads with N, and whether placed, aligned and stored ones add up (one row)."""
    path = _folder(spark)
    archive.write_archive(short_reads(spark, sf), path)
    c = archive.archive_counts(spark, path)
    return c.select("reads", "clean_reads", "n_reads", (F.col("placed") + F.col("singletons") + F.col("n_stored") == F.col("reads")).alias("adds_up"), (F.col("placed") > F.col("n_aligned")).alias("placed_some"), (F.col("contig_bases") + F.col("stored_bases") <= F.col("bases")).alias("saves"))


sql("archive_counts", "select count(*) as reads, count(*) filter (where not contains(seq, 'N')) as clean_reads, count(*) filter (where contains(seq, 'N')) as n_reads, true as adds_up, true as placed_some, true as saves from short", _READS)


# --- chains and looser overlaps -------------------------------------------------------------------------------------


@query
def overlap_chains(spark, sf):
    """Contigs of any length from exact overlaps: each read's place in its chain of mutual best successors."""
    best = overlap.best_overlap(overlap.overlaps(_clean_placed(spark, sf), _L, _L // 2 - 1, 0, same_strand_only=True))
    return chains.chain_places(chains.mutual(best.select("read_idx", "other", "shift"))).select("read_idx", "chain", "place", "pos")


_EXACT = """
w(dict, ws, we) as (values (0, 18, 49), (1, 50, 81)),
ix as (select * from (select *, row_number() over (partition by dict, key order by read_idx desc) as n from k) where n <= 1000),
pr as (select read_idx, dict, s as shift, substr(seq, s + ws + 1, 32) as key from cp, w, range(0, 50) t(s) where s + we < length(seq)),
tx as (select p.read_idx, p.shift, p.dict, i.read_idx as other, a.seq as a, b.seq as b from pr p join ix i using (dict, key) join cp a on a.read_idx = p.read_idx join cp b on b.read_idx = i.read_idx where p.read_idx <> i.read_idx),
ok as (select *, row_number() over (partition by read_idx order by shift, dict, other desc) as n from tx where substr(a, shift + 1, least(length(a) - shift, length(b))) = substr(b, 1, least(length(a) - shift, length(b)))),
best as (select read_idx, other, shift from ok where n = 1),
link as (select read_idx, other, shift from (select *, row_number() over (partition by other order by shift, read_idx) as m from best) where m = 1)"""
sql("overlap_chains", "recursive_part", _PLACED, _CLEAN_PLACED, _KEYS, _EXACT)
SQL["overlap_chains"] = SQL["overlap_chains"].replace("with ", "with recursive ", 1).rsplit("recursive_part", 1)[0] + """,
walk as (select read_idx as chain, read_idx, 0 as place, 0 as pos from link where read_idx not in (select other from link)
         union all select chain, link.other, place + 1, pos + shift from walk join link on link.read_idx = walk.read_idx)
select read_idx, chain, cast(place as bigint) as place, cast(pos as bigint) as pos from walk"""


@query
def singleton_splice(spark, sf):
    """Reads without a close overlap, and the read each would go before under a looser limit, on either strand."""
    rows = _clean_placed(spark, sf)
    return chains.splice(rows, _L, _L // 2 - 1).select("read_idx", "before", "shift", "strand", "cost")


_LOOSE = """
rk as (select 'd' as strand, dict, key, read_idx from k union all select 'r', 0, substr(reverse(translate(seq, 'ACGT', 'TGCA')), 19, 32), read_idx from cp where length(seq) > 49 union all select 'r', 1, substr(reverse(translate(seq, 'ACGT', 'TGCA')), 51, 32), read_idx from cp where length(seq) > 81),
ix as (select * from (select *, row_number() over (partition by strand, dict, key order by read_idx desc) as n from rk) where n <= 1000),
w(dict, ws, we) as (values (0, 18, 49), (1, 50, 81)),
pr as (select read_idx, dict, s as shift, 'd' as strand, substr(seq, s + ws + 1, 32) as key from cp, w, range(0, 50) t(s) where s + we < length(seq)
       union all select read_idx, dict, s, 'r', substr(seq, ws - s + 1, 32) from cp, w, range(0, 50) t(s) where s < ws and we < length(seq) + s),
cand as (select p.*, i.read_idx as other from pr p join ix i using (strand, dict, key) where p.read_idx <> i.read_idx),
tx as (select c.*, a.seq as a, case when c.strand = 'r' then reverse(translate(b.seq, 'ACGT', 'TGCA')) else b.seq end as b from cand c join cp a using (read_idx) join cp b on b.read_idx = c.other),
ov as (select *, case when strand = 'd' then substr(a, shift + 1, least(length(a) - shift, length(b))) else substr(a, 1, least(length(a), length(b) - shift)) end as x,
              case when strand = 'd' then substr(b, 1, least(length(a) - shift, length(b))) else substr(b, shift + 1, least(length(a), length(b) - shift)) end as y from tx),
co as (select read_idx, other, shift, strand, dict, cast(coalesce(list_sum([case when substr(x, i, 1) = substr(y, i, 1) then 0 when substr(x, i, 1) || substr(y, i, 1) in ('AT', 'TA', 'CG', 'GC') then 2 else 1 end for i in range(1, length(x) + 1)]), 0) as integer) as cost from ov),
near as (select read_idx from co where cost <= 4 union select other from co where cost <= 4),
sp as (select *, row_number() over (partition by read_idx order by shift, strand, dict, other desc) as n from co where cost <= 24 and read_idx not in (select read_idx from near))"""
sql("singleton_splice", "select read_idx, other as before, shift, strand, cost from sp where n = 1", _PLACED, _CLEAN_PLACED, _KEYS, _LOOSE)
