"""Queries of the core over the test tables, and the SQL of those that SQL can express."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from helixmill.functions import aligned, quality, seq
from helixmill.operators import identifiers, numbering, overlap, pairs, qvz, reshaping, stats
from helixmill.operators.contigs import absolute_starts, consensus, consensus_windows, lay_out, rebase, votes
from helixmill.operators.records import first_delivery, strip_cr
from helixmill.operators.validate import MAX_SHORT, problem
from helixmill.session import cut, ensure_checkpoint_dir, sweep
from helixmill.sources import archive, fastq, packed
from helixmill.sources.tables import table

QUERIES, SQL = {}, {}


def query(f):
    QUERIES[f.__name__] = f
    return f


# --- several values packed in one field -----------------------------------------------------------------------------


@query
def p6_found(spark: SparkSession, sf: str) -> DataFrame:
    from helixmill.operators.packed_fields import split_packed

    fields = first_delivery(table(spark, sf, "sam_block_t").where("id_array is not null"), "sam_row_id", ["id_array"])
    slots = split_packed(fields, "sam_row_id", "id_array").where("value <> ''")
    return slots.select(F.col("rid").alias("sam_row_id"), F.col("slot").alias("id_no"), F.col("value").alias("id_value"))


SQL["p6_found"] = r"""
with f as (select sam_row_id, any_value(id_array) as s from sam_block_t where id_array is not null and sam_row_id is not null group by sam_row_id),
u as (select sam_row_id, case when regexp_full_match(trim(s), '(?s)\[.*\]|\(.*\)|\{.*\}|<.*>') then substr(trim(s), 2, length(trim(s)) - 2) else s end as s from f),
l as (select sam_row_id, regexp_extract_all(s, '"(?:[^"\\]|""|\\.)*"|''(?:[^''\\]|''''|\\.)*''|\r\n| +@|[,;|\t\r\n]|[^,;|\t\r\n"'' ]+| +') as k from u),
t as (select sam_row_id, unnest(k) as k, generate_subscripts(k, 1) as i from l),
d as (select *, regexp_full_match(k, '\r\n|[,;|\t\r\n]') as hard, lag(k) over (partition by sam_row_id order by i) as prev from t),
e as (select *, k like ' %@' and prev is not null and not regexp_full_match(prev, '\r\n|[,;|\t\r\n]') as soft from d),
n as (select *, 1 + sum(case when hard or soft then 1 else 0 end) over (partition by sam_row_id order by i) as id_no from e),
a as (select sam_row_id, id_no, trim(string_agg(case when hard then '' when soft then '@' else k end, '' order by i)) as v from n group by sam_row_id, id_no),
q as (select sam_row_id, id_no, case when v like '"%"' then regexp_replace(substr(v, 2, length(v) - 2), '"(")|\\(.)', '\1\2', 'g')
                                     when v like '''%''' then regexp_replace(substr(v, 2, length(v) - 2), '''('')|\\(.)', '\1\2', 'g') else v end as id_value from a)
select sam_row_id, cast(id_no as integer) as id_no, id_value from q where id_value <> ''
"""


# --- the read relation ----------------------------------------------------------------------------------------------


def reads(spark: SparkSession, sf: str) -> DataFrame:
    """One row per read of the sequencing table, carriage returns off."""
    rows = first_delivery(table(spark, sf, "fastq_reads"), "read_idx", ["pair_idx", "mate", "id", "seq", "qual", "run_id"])
    return rows.withColumns({c: strip_cr(c) for c in ("id", "seq", "qual")})


def short_reads(spark: SparkSession, sf: str) -> DataFrame:
    """The reads that short mode takes."""
    return reads(spark, sf).where(problem().isNull())


def contig_reads(spark: SparkSession, sf: str) -> DataFrame:
    """Placed reads: text in contig orientation, positions from the start of their contig."""
    rows = first_delivery(table(spark, sf, "contig_reads").where("read is not null"), "read_order", ["contig_id", "read", "pos", "rc"])
    rows = rows.select(F.col("read_order").alias("read_idx"), "contig_id", "pos", F.upper(strip_cr("read")).alias("text"), F.when(F.lower(F.trim("rc")) == "r", "r").otherwise("d").alias("rc"))
    return rebase(rows)


_READS = r"""
reads as (select read_idx, any_value(pair_idx) as pair_idx, any_value(mate) as mate, any_value(regexp_replace(id, '\r$', '')) as id, any_value(regexp_replace(seq, '\r$', '')) as seq,
                 any_value(regexp_replace(qual, '\r$', '')) as qual, any_value(run_id) as run_id from fastq_reads where read_idx is not null group by read_idx),
short as (select * from reads where seq is not null and length(seq) <= 511 and qual is not null and length(seq) = length(qual) and not regexp_matches(seq, '[^ACGTN]')),
clean as (select * from short where not contains(seq, 'N'))"""
_PLACED = r"""
p0 as (select read_order as read_idx, any_value(contig_id) as contig_id, any_value(pos) as pos, any_value(upper(regexp_replace(read, '\r$', ''))) as text, case when any_value(lower(trim(rc))) = 'r' then 'r' else 'd' end as rc
       from contig_reads where read is not null and read_order is not null group by read_order),
placed as (select read_idx, contig_id, pos - min(pos) over (partition by contig_id) as pos, text, rc from p0)"""
#: one row per quality symbol: read_idx, col from 0, q and the next two
_CELLS = r"""
cells as (select read_idx, i - 1 as col, ord(substr(qual, i, 1)) - 33 as q, case when i < n then ord(substr(qual, i + 1, 1)) - 33 end as q1, case when i + 1 < n then ord(substr(qual, i + 2, 1)) - 33 end as q2
          from (select read_idx, qual, length(qual) as n, unnest(range(1, length(qual) + 1)) as i from reads where qual is not null))"""


def sql(name: str, text: str, *parts: str) -> None:
    """Register the SQL of a query: shared table expressions, then the text."""
    SQL[name] = "with " + ",".join(parts) + ("," if text.lstrip().startswith("!") else "") + text.lstrip().lstrip("!")


@query
def read_stats(spark, sf):
    return stats.read_stats(reads(spark, sf))


sql("read_stats", "select mate, count(*) as reads, min(length(seq)) as min_len, max(length(seq)) as max_len, cast(sum(length(seq)) as bigint) as bases, count(*) filter (where contains(seq, 'N')) as n_reads, count(*) filter (where not contains(seq, 'N')) as clean_reads from reads group by mate", _READS)


@query
def read_length_hist(spark, sf):
    return stats.length_histogram(reads(spark, sf))


sql("read_length_hist", "select length(seq) as len, count(*) as reads from reads where length(seq) <= 511 group by 1", _READS)


@query
def read_problems(spark, sf):
    """Every read that short mode refuses, with the first rule it breaks."""
    return reads(spark, sf).select("read_idx", problem().alias("problem")).where("problem is not null")


sql("read_problems", """select * from (select read_idx, case when seq is null then 'no sequence' when length(seq) > 511 then 'too long' when qual is null then 'no quality' when length(seq) <> length(qual) then 'length mismatch'
    when regexp_matches(seq, '[^ACGTN]') then 'illegal base' end as problem from reads) where problem is not null""", _READS)


@query
def n_split(spark, sf):
    """Clean reads and reads with N, by run."""
    return short_reads(spark, sf).groupBy("run_id", seq.has_n("seq").alias("has_n")).agg(F.count("*").alias("reads"), F.min("read_idx").alias("first_read"))


sql("n_split", "select run_id, contains(seq, 'N') as has_n, count(*) as reads, min(read_idx) as first_read from short group by 1, 2", _READS)


@query
def reverse_complement(spark, sf):
    return short_reads(spark, sf).select("read_idx", seq.revcomp("seq").alias("rc"))


sql("reverse_complement", "select read_idx, reverse(translate(seq, 'ACGT', 'TGCA')) as rc from short", _READS)


@query
def canonical_kmer_spectrum(spark, sf):
    """How many canonical 12-letter windows of clean reads occur how often."""
    k = short_reads(spark, sf).where(~seq.has_n("seq")).select(F.explode(seq.kmers("seq", 12)).alias("k"))
    return k.groupBy(seq.canonical("k").alias("k")).agg(F.count("*").alias("times")).groupBy("times").agg(F.count("*").alias("kmers"))


sql("canonical_kmer_spectrum", "select times, count(*) as kmers from (select least(k, reverse(translate(k, 'ACGT', 'TGCA'))) as c, count(*) as times from (select substr(seq, i, 12) as k from (select seq, unnest(range(1, length(seq) - 10)) as i from clean)) group by 1) group by times", _READS)


@query
def base_codes(spark, sf):
    """Two-bit codes of the first twelve bases, in both orders of the bases."""
    first = seq.window_key("seq", 0, 11)
    return short_reads(spark, sf).where(~seq.has_n("seq") & (F.length("seq") >= 12)).select("read_idx", seq.base_code(first, "AGCT").alias("read_code"), seq.base_code(first, "ACGT").alias("pack_code"))


sql("base_codes", """select read_idx, cast(list_sum([cast(strpos('AGCT', substr(seq, i, 1)) - 1 as bigint) * cast(pow(4, 12 - i) as bigint) for i in range(1, 13)]) as bigint) as read_code,
    cast(list_sum([cast(strpos('ACGT', substr(seq, i, 1)) - 1 as bigint) * cast(pow(4, 12 - i) as bigint) for i in range(1, 13)]) as bigint) as pack_code from clean where length(seq) >= 12""", _READS)


# --- qualities ------------------------------------------------------------------------------------------------------


def _recode_sql(to) -> str:
    text = lambda s: s.replace("'", "''")
    return f"translate(qual, '{text(''.join(chr(q + 33) for q in range(95)))}', '{text(''.join(chr(to(q) + 33) for q in range(95)))}')"


@query
def illumina_bin(spark, sf):
    return reads(spark, sf).where("qual is not null").select("read_idx", quality.illumina_bin("qual").alias("binned"))


sql("illumina_bin", "select read_idx, " + _recode_sql(lambda q: 0 if q <= 1 else 6 if q <= 9 else 15 if q <= 19 else 22 if q <= 24 else 27 if q <= 29 else 33 if q <= 34 else 37 if q <= 39 else 40) + " as binned from reads where qual is not null", _READS)


@query
def illumina_bin_hist(spark, sf):
    return reads(spark, sf).where("qual is not null").select(F.explode(quality.phred(quality.illumina_bin("qual"))).alias("level")).groupBy("level").agg(F.count("*").alias("symbols"))


sql("illumina_bin_hist", "select case when q <= 1 then 0 when q <= 9 then 6 when q <= 19 then 15 when q <= 24 then 22 when q <= 29 then 27 when q <= 34 then 33 when q <= 39 then 37 else 40 end as level, count(*) as symbols from cells group by 1", _READS, _CELLS)


@query
def binary_threshold(spark, sf):
    return reads(spark, sf).where("qual is not null").select("read_idx", quality.threshold("qual", 20, 37, 6).alias("binned"))


sql("binary_threshold", "select read_idx, " + _recode_sql(lambda q: 37 if q >= 20 else 6) + " as binned from reads where qual is not null", _READS)


@query
def phred_error_by_pos(spark, sf):
    return stats.error_by_position(reads(spark, sf)).select("col", F.round("p", 9).alias("p"))


sql("phred_error_by_pos", "select col, round(avg(pow(10.0, -q / 10.0)), 9) as p from cells group by col", _READS, _CELLS)


@query
def qual_markov_counts(spark, sf):
    return stats.markov_counts(reads(spark, sf))


sql("qual_markov_counts", "select col, coalesce(prev, 0) as prev, cur, count(*) as cnt from (select col, q as cur, lag(q) over (partition by read_idx order by col) as prev from cells) group by 1, 2, 3", _READS, _CELLS)


@query
def qual_marginal_entropy(spark, sf):
    return stats.marginal_entropy(stats.markov_counts(reads(spark, sf))).select("col", F.round("entropy", 6).alias("entropy"))


sql("qual_marginal_entropy", "select col, round(abs(-sum(c / n * log2(c / n))), 6) as entropy from (select col, count(*) * 1.0 as c, sum(count(*)) over (partition by col) as n from cells group by col, q) group by col", _READS, _CELLS)


@query
def qual_entropy_012(spark, sf):
    return stats.order_entropies(reads(spark, sf)).select(*[F.round(c, 5).alias(c) for c in ("order0", "order1", "order2")])


_ENTROPY = """
n0 as (select col, -sum(c / n * log2(c / n)) as l0 from (select col, count(*) * 1.0 as c, sum(count(*)) over (partition by col) as n from cells group by col, q) group by col),
n1 as (select col, -sum(c / n * log2(c / n)) as l1 from (select col, count(*) * 1.0 as c, sum(count(*)) over (partition by col) as n from cells where q1 is not null group by col, q, q1) group by col),
n2 as (select col, -sum(c / n * log2(c / n)) as l2 from (select col, count(*) * 1.0 as c, sum(count(*)) over (partition by col) as n from cells where q2 is not null group by col, q, q1, q2) group by col)"""
sql("qual_entropy_012", """select round(sum(l0), 5) as order0, round(sum(l1 - l0) + max(l0) filter (where col = 0), 5) as order1, round(sum(l2 - l1) + max(l1) filter (where col = 0), 5) as order2
    from n0 left join n1 using (col) left join n2 using (col)""", _READS, _CELLS, _ENTROPY)


@query
def noise_entropy(spark, sf):
    return stats.noise_entropy(stats.error_by_position(reads(spark, sf))).select("col", *[F.round(c, 6).alias(c) for c in ("uniform", "skewed", "subtracted")])


_P = "p as (select col, avg(pow(10.0, -q / 10.0)) as p from cells group by col), h as (select col, p, -(case when p > 0 then p * log2(p) else 0 end) - (case when p < 1 then (1 - p) * log2(1 - p) else 0 end) as h from p)"
_KIND = "(-(0.3 * log2(0.15) + 0.7 * log2(0.7)))"
sql("noise_entropy", f"select col, round(h + p * log2(3.0), 6) as uniform, round(h + p * {_KIND}, 6) as skewed, round(h - p * log2(3.0), 6) as subtracted from h", _READS, _CELLS, _P)


@query
def joint_noise_entropy(spark, sf):
    return stats.joint_noise_entropy(reads(spark, sf)).select(F.round("order0", 5).alias("order0"), F.round("order1", 5).alias("order1"))


sql("joint_noise_entropy", f"""!
e as (select col, pow(10.0, -q / 10.0) as e0, pow(10.0, -q1 / 10.0) as e1 from cells),
j as (select col, avg(e0 * e1) as a, avg(e0 * (1 - e1)) as b, avg((1 - e0) * e1) as c, avg((1 - e0) * (1 - e1)) as d from e where e1 is not null group by col),
k as (select col, -(case when a > 0 then a * log2(a) else 0 end) - (case when b > 0 then b * log2(b) else 0 end) - (case when c > 0 then c * log2(c) else 0 end) - (case when d > 0 then d * log2(d) else 0 end) + (2 * a + b + c) * {_KIND} as h1 from j),
z as (select col, h + p * {_KIND} as h0 from h)
select round(sum(h0), 5) as order0, round(max(h0) filter (where col = 0) + sum(h1 - h0), 5) as order1 from z left join k using (col)""", _READS, _CELLS, _P)


@query
def read_lower_bound(spark, sf):
    """Genome size here: bases covered by placed reads."""
    size = votes(contig_reads(spark, sf)).agg(F.count("*").alias("n")).first()["n"]
    out = stats.read_lower_bound(reads(spark, sf), size)
    return out.select(F.col("m").cast("bigint").alias("m"), F.col("n").cast("bigint").alias("n"), F.round("noise_bits_per_read", 5).alias("noise_bits_per_read"), F.round(F.col("genome_bits") / 1e6, 5).alias("genome_mbit"), F.round(F.col("position_bits") / 1e6, 5).alias("position_mbit"))


sql("read_lower_bound", """!
g as (select count(*) as n from (select distinct contig_id, pos + i as site from (select contig_id, pos, unnest(range(0, length(text))) as i from placed))),
m as (select count(*) as m from reads), b as (select sum(h - p * log2(3.0)) as bits from h)
select m, n, round(bits, 5) as noise_bits_per_read, round(n * 2.0 / 1e6, 5) as genome_mbit, round(((m + n) * log2(m + n) - m * log2(m) - n * log2(n)) / 1e6, 5) as position_mbit from m, g, b""", _READS, _CELLS, _P, _PLACED)

_BOUNDS = [20.0, 25.0, 30.0, 35.0]


@query
def quality_cluster_counts(spark, sf):
    """Counts of (group by mean quality, column, value)."""
    grouped = stats.quality_clusters(reads(spark, sf), _BOUNDS)
    return grouped.select("grp", F.posexplode(quality.phred("qual")).alias("col", "q")).groupBy("grp", "col", "q").agg(F.count("*").alias("cnt"))


sql("quality_cluster_counts", """!
a as (select read_idx, avg(q) as m from cells group by read_idx),
g as (select read_idx, case when m < 35 then 3 when m < 30 then 2 when m < 25 then 1 when m < 20 then 0 else 4 end as grp from a)
select grp, col, q, count(*) as cnt from cells join g using (read_idx) group by 1, 2, 3""", _READS, _CELLS)


@query
def split_long_reads(spark, sf):
    return reshaping.split_long(reads(spark, sf), 50).select("read_idx", "piece", "seq", "qual")


sql("split_long_reads", "select read_idx, cast(piece as integer) as piece, substr(seq, piece * 50 + 1, 50) as seq, substr(qual, piece * 50 + 1, 50) as qual from (select *, unnest(range(0, greatest(1, (length(seq) + 49) // 50))) as piece from reads)", _READS)


@query
def transpose_quality(spark, sf):
    return reshaping.transpose(reads(spark, sf))


sql("transpose_quality", "select col, read_idx // 65536 as part_no, string_agg(chr(q + 33), '' order by read_idx) as symbols from (select read_idx, col, cast(q as integer) as q from cells) group by 1, 2", _READS, _CELLS)


@query
def run_lengths(spark, sf):
    return reshaping.run_lengths(reads(spark, sf), "J")


sql("run_lengths", """!
b as (select read_idx, col, q, lag(col) over (partition by read_idx order by col) as before, max(col) over (partition by read_idx) as last from cells where q <> 41),
e as (select read_idx, max(col) as last from cells group by read_idx),
n as (select read_idx, col, col - coalesce(before, -1) - 1 as run, chr(cast(q + 33 as integer)) as next from b),
t as (select e.read_idx, e.last + 1 as col, e.last - coalesce(m.at, -1) as run, '' as next from e left join (select read_idx, max(col) as at from b group by read_idx) m using (read_idx) where e.last > coalesce(m.at, -1)),
u as (select * from n union all select * from t)
select read_idx, row_number() over (partition by read_idx order by col) - 1 as n, run, next from u""", _READS, _CELLS)


def _four(q: int) -> int:
    return 37 if q >= 30 else 25 if q >= 20 else 11 if q >= 10 else 2


@query
def pack4(spark, sf):
    """Qualities reduced to four symbols, packed, and unpacked again."""
    four = quality.recode("qual", _four)
    rows = reads(spark, sf).where("qual is not null").select("read_idx", four.alias("four")).withColumn("p", quality.pack4("four"))
    return rows.select("read_idx", "p.packed", "p.tail", quality.unpack4("p.packed", "p.tail").alias("again"))


sql("pack4", """!
f as (select read_idx, """ + _recode_sql(_four) + """ as four from reads where qual is not null),
t as (select read_idx, four, length(four) - length(four) % 4 as n from f)
select read_idx, coalesce(list_aggregate([upper(to_hex(cast(list_sum([(strpos('F:,#', substr(four, cast(i * 2 + k as integer), 1)) - 1) * (case k when 1 then 4 else 1 end) for k in [1, 2]]) as bigint))) for i in range(0, n // 2)], 'string_agg', ''), '') as packed,
       substr(four, n + 1) as tail, four as again from t""", _READS)


# --- identifiers and mates ------------------------------------------------------------------------------------------


@query
def id_tokens(spark, sf):
    return identifiers.tokens(reads(spark, sf))


sql("id_tokens", """select read_idx, cast(pos - 1 as integer) as pos, tok, case when regexp_matches(tok, '^[A-Za-z]') then 'alpha' when tok like '0%' then 'zeros' when regexp_matches(tok, '^[1-9]') then 'digit' else 'char' end as type
    from (select read_idx, unnest(k) as tok, generate_subscripts(k, 1) as pos from (select read_idx, regexp_extract_all(id, '(?s)""" + seq.ID_TOKEN + """') as k from reads))""", _READS)


@query
def id_token_coding(spark, sf):
    """How often each place of an id repeats, steps on, or is new."""
    return identifiers.against_previous(identifiers.tokens(reads(spark, sf)), 256_000).groupBy("pos", "coded").agg(F.count("*").alias("tokens"), F.sum("delta").alias("steps"))


sql("id_token_coding", """!
t as (""" + SQL["id_tokens"].split("with", 1)[1].split("clean as", 1)[1].split("'N'))", 1)[1] + """),
l as (select *, lag(tok) over w as ptok, lag(type) over w as ptype, lag(read_idx) over w as pidx from t window w as (partition by read_idx // 256000, pos order by read_idx)),
d as (select *, case when type = 'digit' and ptype = 'digit' then cast(tok as bigint) - cast(ptok as bigint) end as diff from l),
c as (select pos, case when pidx = read_idx - 1 and ptok = tok then 'match' when pidx = read_idx - 1 and diff > 0 and diff < 256 then 'delta' else type end as coded, diff from d)
select pos, coded, count(*) as tokens, cast(sum(case when coded = 'delta' then diff end) as bigint) as steps from c group by 1, 2""", _READS)


@query
def id_round_trip(spark, sf):
    """Ids put together again from their tokens (an empty id has none)."""
    return identifiers.untokenise(identifiers.tokens(reads(spark, sf)))


sql("id_round_trip", "select read_idx, id from reads where id <> ''", _READS)

_MATES = """
mates as (select pair_idx, max(case when mate = 1 then id end) as id_1, max(case when mate = 2 then id end) as id_2, max(case when mate = 1 then seq end) as seq_1, max(case when mate = 2 then seq end) as seq_2 from reads group by pair_idx),
pattern as (select pair_idx, id_1, id_2, case when length(id_1) <> length(id_2) then 0 when id_1 = id_2 then 2 when id_1 like '%1' and id_2 like '%2' and left(id_1, length(id_1) - 1) = left(id_2, length(id_2) - 1) then 1
    when replace(id_1, ' 1', ' 2') = id_2 and not regexp_matches(id_1, ' ([^1]|$)') then 3 else 0 end as code from mates where id_1 is not null and id_2 is not null)"""


@query
def mate_patterns(spark, sf):
    """Pattern of the two ids of each pair, and the id of mate 2 made from mate 1 under it."""
    m = pairs.join_mates(reads(spark, sf), ["id"]).where("id_1 is not null and id_2 is not null").withColumn("code", seq.mate_pattern("id_1", "id_2"))
    return m.select("pair_idx", "code", seq.mate_id("id_1", F.col("code")).alias("made"), seq.fits_pattern("id_1", "id_2", 3).alias("fits_3"))


sql("mate_patterns", """select pair_idx, code, case code when 1 then left(id_1, length(id_1) - 1) || '2' when 3 then regexp_replace(id_1, ' .', ' 2') else id_1 end as made,
    length(id_1) = length(id_2) and (replace(id_1, ' 1', ' 2') = id_2 and not regexp_matches(id_1, ' ([^1]|$)') or id_1 = id_2 and not contains(id_1, ' ')) as fits_3 from pattern""", _READS, _MATES)


@query
def file_patterns(spark, sf):
    """The one pattern that all pairs of the table obey, 0 if there is none."""
    m = pairs.join_mates(reads(spark, sf), ["id"])
    return identifiers.file_pattern(m, seq.mate_pattern("id_1", "id_2"))


sql("file_patterns", """!
f as (select arg_min(code, pair_idx) as code from pattern),
k as (select f.code, bool_and(case f.code when 0 then false when 3 then p.code = 3 or (p.id_1 = p.id_2 and not contains(p.id_1, ' ')) else p.code = f.code end) as good, count(*) as n from pattern p, f group by 1)
select cast(case when good and n = (select count(*) from mates) then code else 0 end as integer) as pattern from k""", _READS, _MATES)


@query
def fake_ids(spark, sf):
    return reads(spark, sf).select("read_idx", seq.fake_id("pair_idx", "mate").alias("id"))


sql("fake_ids", "select read_idx, '@' || (pair_idx + 1) || '/' || mate as id from reads", _READS)


@query
def mate_join(spark, sf):
    return pairs.join_mates(reads(spark, sf), ["read_idx", "seq"]).select("pair_idx", "read_idx_1", "read_idx_2", F.length("seq_1").alias("len_1"), F.length("seq_2").alias("len_2"))


sql("mate_join", "select pair_idx, max(case when mate = 1 then read_idx end) as read_idx_1, max(case when mate = 2 then read_idx end) as read_idx_2, max(case when mate = 1 then length(seq) end) as len_1, max(case when mate = 2 then length(seq) end) as len_2 from reads group by pair_idx", _READS)


def _lengths(spark, sf):
    return contig_reads(spark, sf).groupBy("contig_id").agg(F.max(F.col("pos") + F.length("text")).alias("len"), F.count("*").alias("reads"))


_LENGTHS = "lengths as (select contig_id, max(pos + length(text)) as len, count(*) as reads from placed group by contig_id), starts as (select contig_id, len, coalesce(sum(len) over (order by contig_id rows between unbounded preceding and 1 preceding), 0) as abs_start from lengths)"


@query
def abs_positions(spark, sf):
    """Start of each contig and absolute position of each placed read, with contigs end to end."""
    starts = absolute_starts(_lengths(spark, sf).withColumn("contig_no", F.col("contig_id"))).select("contig_id", "abs_start")
    return contig_reads(spark, sf).join(starts, "contig_id").select("read_idx", "contig_id", "abs_start", (F.col("abs_start") + F.col("pos")).alias("abs_pos"))


sql("abs_positions", "select read_idx, contig_id, cast(abs_start as bigint) as abs_start, cast(abs_start + pos as bigint) as abs_pos from placed join starts using (contig_id)", _PLACED, _LENGTHS)


@query
def mate_flags(spark, sf):
    """Pair flags, and distance and orientation of near mates, from absolute positions."""
    place = abs_positions(spark, sf).select("read_idx", "abs_pos").join(contig_reads(spark, sf).select("read_idx", "rc"), "read_idx")
    both = reads(spark, sf).select("read_idx", "pair_idx", "mate").join(place, "read_idx", "left")
    m = pairs.join_mates(both, ["abs_pos", "rc"]).withColumn("flag", pairs.pair_flag(F.col("abs_pos_1"), F.col("abs_pos_2")))
    return m.select("pair_idx", "flag", *pairs.relative_mate(F.col("flag"), F.col("abs_pos_1"), F.col("abs_pos_2"), F.col("rc_1"), F.col("rc_2")))


sql("mate_flags", """!
a as (select r.pair_idx, r.mate, s.abs_start + p.pos as spot, p.rc from reads r left join placed p using (read_idx) left join starts s using (contig_id)),
m as (select pair_idx, max(spot) filter (where mate = 1) as a1, max(spot) filter (where mate = 2) as a2, max(rc) filter (where mate = 1) as r1, max(rc) filter (where mate = 2) as r2 from a group by pair_idx),
f as (select *, case when a1 is null and a2 is null then 2 when a2 is null then 3 when a1 is null then 4 when abs(a2 - a1) < 32767 then 0 else 1 end as flag from m)
select pair_idx, flag, cast(case when flag = 0 then a2 - a1 end as integer) as pos_pair, case when flag = 0 then case when r1 = r2 then 1 else 0 end end as rc_pair from f""", _READS, _PLACED, _LENGTHS)


@query
def delta_positions(spark, sf):
    rows = numbering.blocks(abs_positions(spark, sf), "read_idx", 1000)
    return numbering.delta(rows, "block_num", "read_idx", "abs_pos").select("read_idx", "block_num", "step", "absolute")


_DELTA = """
d0 as (select read_idx, read_idx // 1000 as block_num, cast(abs_start + pos as bigint) as abs_pos from placed join starts using (contig_id)),
d1 as (select *, lag(abs_pos) over (partition by block_num order by read_idx) as prev from d0)"""
sql("delta_positions", "select read_idx, block_num, case when prev is null then 0 when abs_pos - prev >= 65535 or abs_pos < prev then 65535 else abs_pos - prev end as step, case when prev is null or abs_pos - prev >= 65535 or abs_pos < prev then abs_pos end as absolute from d1", _PLACED, _LENGTHS, _DELTA)


@query
def undelta_positions(spark, sf):
    return numbering.undelta(delta_positions(spark, sf), "block_num", "read_idx").select("read_idx", "pos")


sql("undelta_positions", "select read_idx, abs_pos as pos from d0", _PLACED, _LENGTHS, _DELTA)


@query
def order_correction(spark, sf):
    """Place of each clean read among the clean ones, and the number of reads with N before it."""
    rows = numbering.running_total(short_reads(spark, sf).select("read_idx", "seq"), "read_idx", seq.has_n("seq").cast("int"), "n_before")
    rows = numbering.running_total(rows, "read_idx", (~seq.has_n("seq")).cast("int"), "clean_before")
    return rows.where(~seq.has_n("seq")).select("read_idx", "n_before", "clean_before")


sql("order_correction", """select read_idx, n_before, clean_before from (select read_idx, seq, cast(coalesce(sum(case when contains(seq, 'N') then 1 else 0 end) over w, 0) as bigint) as n_before, cast(coalesce(sum(case when contains(seq, 'N') then 0 else 1 end) over w, 0) as bigint) as clean_before
    from short window w as (order by read_idx rows between unbounded preceding and 1 preceding)) where not contains(seq, 'N')""", _READS)


@query
def block_rows(spark, sf):
    b = numbering.blocks(reads(spark, sf).select("read_idx"), "read_idx", 1000)
    return b.groupBy("block_num").agg(F.count("*").alias("reads"), F.max("row_in_block").alias("last_row"))


sql("block_rows", "select read_idx // 1000 as block_num, count(*) as reads, max(read_idx % 1000) as last_row from reads group by 1", _READS)


def _permuted(spark, sf):
    """A fixed permutation of the read numbers."""
    r = reads(spark, sf).select("read_idx")
    n = r.count()
    return r.select(F.col("read_idx").alias("old_idx"), ((F.col("read_idx") * 7919 + 13) % n).alias("new_idx")), n


_PERMUTED = "n as (select count(*) as n from reads), o as (select read_idx as old_idx, (read_idx * 7919 + 13) % n as new_idx from reads, n)"


@query
def permute_quality(spark, sf):
    order, _ = _permuted(spark, sf)
    return reads(spark, sf).select(F.col("read_idx").alias("old_idx"), "id", "qual").join(order, "old_idx").select("new_idx", "id", "qual")


sql("permute_quality", "select new_idx, id, qual from reads join o on old_idx = read_idx", _READS, _PERMUTED)


@query
def pair_renumber(spark, sf):
    order, n = _permuted(spark, sf)
    return pairs.renumber_pairs(order, n // 2).select("old_idx", "new_idx", "pair_new_idx")


sql("pair_renumber", """!
r as (select old_idx, row_number() over (order by new_idx) - 1 as rank from o, n where old_idx < n // 2)
select o.old_idx, o.new_idx, case when o.old_idx < n // 2 then rank else rank + n // 2 end as pair_new_idx from o, n, r where r.old_idx = o.old_idx % (n // 2)""", _READS, _PERMUTED)


@query
def pair_distance(spark, sf):
    """Distance of mates in the permuted order, and which comes first."""
    order, n = _permuted(spark, sf)
    m = order.withColumn("pair_idx", F.col("old_idx") % (n // 2)).withColumn("mate", F.when(F.col("old_idx") < n // 2, 1).otherwise(2))
    return pairs.join_mates(m, ["new_idx"]).select("pair_idx", F.abs(F.col("new_idx_2") - F.col("new_idx_1")).alias("distance"), (F.col("new_idx_1") < F.col("new_idx_2")).alias("first_leads"))


sql("pair_distance", "select a.old_idx as pair_idx, abs(b.new_idx - a.new_idx) as distance, a.new_idx < b.new_idx as first_leads from o a, o b, n where a.old_idx < n // 2 and b.old_idx = a.old_idx + n // 2", _READS, _PERMUTED)


@query
def ordered_merge(spark, sf):
    """Clean reads and reads with N, stored apart, put together by their ordinals."""
    rows = short_reads(spark, sf).select("read_idx", "seq")
    return rows.where(~seq.has_n("seq")).unionByName(rows.where(seq.has_n("seq")))


sql("ordered_merge", "select read_idx, seq from short", _READS)


@query
def alphabet_union(spark, sf):
    """Symbols of the qualities of both mates, as one sorted list per run."""
    symbols = reads(spark, sf).where("qual <> ''").select("run_id", "mate", F.explode(seq.letters("qual")).alias("s")).groupBy("run_id").agg(*[F.collect_set(F.when(F.col("mate") == m, F.col("s"))).alias(f"m{m}") for m in (1, 2)])
    return symbols.select("run_id", F.array_join(F.array_sort(F.array_union("m1", "m2")), "").alias("alphabet"))


sql("alphabet_union", "select run_id, string_agg(s, '' order by ord(s)) as alphabet from (select distinct run_id, chr(cast(q + 33 as integer)) as s from cells join reads using (read_idx)) group by run_id", _READS, _CELLS)


@query
def number_coding(spark, sf):
    """Zigzag codes, their varint bytes and decimal digits of the positions of placed reads."""
    rows = contig_reads(spark, sf).select("read_idx", (F.col("pos") - 1000).alias("v"))
    return rows.select("read_idx", seq.zigzag("v").alias("code"), seq.unzigzag(seq.zigzag("v")).alias("again"), seq.varint_bytes("v").alias("bytes"), seq.digits("v").alias("digits"))


sql("number_coding", "!v as (select read_idx, pos - 1000 as v, case when pos >= 1000 then 2 * (pos - 1000) else -2 * (pos - 1000) - 1 end as z from placed) select read_idx, z as code, v as again, case when z < 128 then 1 when z < 16384 then 2 when z < 2097152 then 3 else 4 end as bytes, length(cast(abs(v) as varchar)) as digits from v", _PLACED)


# --- overlaps and contigs -------------------------------------------------------------------------------------------


def _clean_placed(spark, sf):
    return contig_reads(spark, sf).where(F.regexp_like("text", F.lit("^[ACGT]*$"))).select("read_idx", F.col("text").alias("seq"))


_CLEAN_PLACED = "cp as (select read_idx, text as seq from placed where regexp_full_match(text, '[ACGT]*'))"
_L = 100


@query
def dictionary_bins(spark, sf):
    return overlap.dictionary_bins(_clean_placed(spark, sf), seq.dictionary_windows(_L))


_KEYS = "k as (select 0 as dict, substr(seq, 19, 32) as key, read_idx from cp where length(seq) > 49 union all select 1, substr(seq, 51, 32), read_idx from cp where length(seq) > 81)"
sql("dictionary_bins", "select dict, key, count(*) as reads, min(read_idx) as first_read from k group by 1, 2", _PLACED, _CLEAN_PLACED, _KEYS)


@query
def overlap_best(spark, sf):
    """Best successor of each clean read: smallest shift, then strand, index, newest read."""
    return overlap.best_overlap(overlap.overlaps(_clean_placed(spark, sf), _L, _L // 2 - 1))


sql("overlap_best", """!
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
ok as (select *, row_number() over (partition by read_idx order by shift, strand, dict, other desc) as n from co where cost <= 4)
select read_idx, other, shift, strand, dict, cost from ok where n = 1""", _PLACED, _CLEAN_PLACED, _KEYS)


@query
def consensus_votes(spark, sf):
    """Consensus base and depth of every covered contig position."""
    return votes(contig_reads(spark, sf))


_VOTES = """
vc as (select contig_id, pos + i - 1 as site, substr(text, i, 1) as b from (select contig_id, pos, text, unnest(range(1, length(text) + 1)) as i from placed)),
vn as (select contig_id, site, count(*) filter (where b = 'A') as a, count(*) filter (where b = 'C') as c, count(*) filter (where b = 'G') as g, count(*) filter (where b = 'T') as t, count(*) as depth from vc group by 1, 2),
votes as (select contig_id, site, case when greatest(a, c, g, t) = a then 'A' when greatest(a, c, g, t) = c then 'C' when greatest(a, c, g, t) = g then 'G' else 'T' end as base, depth from vn)"""
sql("consensus_votes", "select * from votes", _PLACED, _VOTES)


def _against_consensus(spark, sf):
    """Each placed read over A, C, G, T, N beside its stretch of the consensus, put together from parts of it."""
    part = 1024
    placed = contig_reads(spark, sf)
    rows = placed.where(F.regexp_like("text", F.lit("^[ACGTN]+$"))).select("read_idx", "contig_id", "pos", "text")
    last = F.col("pos") + F.length("text") - 1
    touched = rows.withColumn("part_no", F.explode(F.sequence(F.floor(F.col("pos") / part), F.floor(last / part))))
    beside = touched.join(consensus(placed, part), ["contig_id", "part_no"])
    begin = F.greatest(F.col("pos") - F.col("first"), F.lit(0))
    piece = F.substr("seq", (begin + 1).cast("int"), F.least(last, (F.col("part_no") + 1) * part - 1).cast("int") - F.greatest(F.col("pos"), F.col("first")).cast("int") + 1)
    pieces = F.array_sort(F.collect_list(F.struct("part_no", "piece")))
    return beside.withColumn("piece", piece).groupBy("read_idx").agg(F.first("text").alias("text"), F.array_join(F.transform(pieces, lambda x: x["piece"]), "").alias("ref"))


@query
def noise_codes(spark, sf):
    """Differences of each placed read from the consensus, and their price in code bits."""
    rows = _against_consensus(spark, sf)
    return rows.select("read_idx", F.array_join(F.transform(aligned.noise("text", "ref"), lambda d: F.concat(d["dpos"].cast("string"), d["code"])), " ").alias("noise"), aligned.cost3("text", "ref").alias("cost"))


sql("noise_codes", """!
c as (select read_idx, contig_id, i - 1 as i, pos + i - 1 as site, substr(text, i, 1) as b from (select *, unnest(range(1, length(text) + 1)) as i from placed where regexp_full_match(text, '[ACGTN]+'))),
m as (select read_idx, i, base as r, b from c join votes using (contig_id, site) where b <> base),
d as (select *, i - coalesce(lag(i) over (partition by read_idx order by i), 0) as dpos, strpos(case r when 'A' then 'CGTN' when 'C' then 'AGTN' when 'G' then 'TACN' else 'GCAN' end, b) - 1 as code,
      case r || b when 'AT' then 2 when 'TA' then 2 when 'CG' then 2 when 'GC' then 2 when 'CN' then 2 when 'GN' then 2 when 'TN' then 3 else 1 end as price from m),
s as (select read_idx, string_agg(dpos || '' || code, ' ' order by i) as noise, sum(price) as cost from d group by read_idx)
select read_idx, coalesce(noise, '') as noise, cast(coalesce(cost, 0) as integer) as cost from (select distinct read_idx from c) left join s using (read_idx)""", _PLACED, _VOTES)


@query
def noise_round_trip(spark, sf):
    """Reads made again from consensus and differences."""
    return _against_consensus(spark, sf).select("read_idx", aligned.apply_noise("ref", aligned.noise("text", "ref")).alias("text"))


sql("noise_round_trip", "select read_idx, text from placed where regexp_full_match(text, '[ACGTN]+')", _PLACED)


# --- whole paths ----------------------------------------------------------------------------------------------------


def _folder(spark) -> str:
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/helixmill-{uuid.uuid4().hex}"


@query
def fastq_round_trip(spark, sf):
    """All reads of mate 1 with qualities, written as FASTQ and scanned again."""
    rows = reads(spark, sf).where("mate = 1 and qual is not null and not contains(id, '\\n')")
    path = _folder(spark)
    fastq.write(rows, path)
    return fastq.scan(spark, path).select("id", "seq", "qual")


sql("fastq_round_trip", "select id, seq, qual from reads where mate = 1 and qual is not null", _READS)


@query
def short_round_trip(spark, sf):
    """All reads short mode takes, archived against consensus contigs and decoded."""
    path = _folder(spark)
    archive.write_archive(short_reads(spark, sf), path)
    return archive.read_archive(spark, path).select("read_idx", "id", "seq", "qual")


sql("short_round_trip", "select read_idx, id, seq, qual from short", _READS)


@query
def long_round_trip(spark, sf):
    """All reads with a sequence, archived in long mode without qualities and with binned ones for those that fit."""
    path = _folder(spark)
    archive.write_archive(reads(spark, sf).where("seq is not null"), path, long_mode=True, quality=False)
    return archive.read_archive(spark, path).select("read_idx", "id", "seq")


sql("long_round_trip", "select read_idx, id, seq from reads where seq is not null", _READS)


@query
def range_scan(spark, sf):
    """Reads 101 to 1100 of a long-mode archive: only the blocks that hold them are read."""
    path = _folder(spark)
    archive.write_archive(reads(spark, sf).where("qual is not null and length(seq) = length(qual)"), path, long_mode=True, mode=("ill_bin",))
    last = archive.read_params(spark, path).num_pairs
    return archive.read_archive(spark, path, min(101, last), min(1100, last)).select("read_idx", "seq", "qual")


sql("range_scan", "select read_idx, seq, " + _recode_sql(quality.illumina_level) + " as qual from reads where qual is not null and length(seq) = length(qual) and read_idx between least(100, (select count(*) - 1 from reads where length(seq) = length(qual))) and least(1099, (select count(*) - 1 from reads where length(seq) = length(qual)))", _READS)


@query
def qvz_quantise(spark, sf):
    """Qualities at half their rate, one codebook per block."""
    rows = reads(spark, sf).where("qual is not null").select("read_idx", "qual")
    return qvz.quantise(rows, 0.5)


@query
def stream_sizes(spark, sf):
    return stats.stream_sizes(reads(spark, sf))


sql("stream_sizes", "select 'id' as stream, cast(sum(strlen(id)) as bigint) as bytes from reads union all select 'read', cast(sum(strlen(seq)) as bigint) from reads union all select 'quality', cast(sum(strlen(qual)) as bigint) from reads", _READS)


@query
def rescue_reads(spark, sf):
    """Short reads placed on the consensus of the contigs they weren't laid on before; contigs are whole, as a read may
    lie across any edge. A read needs 21 bases for the index."""
    part, beyond = overlap.window_shape(60, MAX_SHORT)
    contigs = cut(consensus_windows(contig_reads(spark, sf), part, beyond))
    sweep(spark)
    return overlap.rescue_in_windows(contigs, short_reads(spark, sf).select("read_idx", "seq"), 60, part)


sql("rescue_reads", """!
sp as (select contig_id, min(site) as lo, max(site) as hi from votes group by contig_id),
cs as (select contig_id, string_agg(coalesce(base, 'A'), '' order by site) as s from (select contig_id, unnest(range(lo, hi + 1)) as site from sp) left join votes using (contig_id, site) group by contig_id),
w(dict, ws, we) as (values (0, 0, 20), (1, 21, 41)),
st as (select contig_id, s, unnest(range(0, length(s) - 59)) as spot from cs where length(s) >= 60),
pr as (select contig_id, spot, 'd' as rc, dict, substr(s, cast(spot + ws + 1 as integer), 21) as key from st, w
       union all select contig_id, spot, 'r', dict, reverse(translate(substr(s, cast(spot + 60 - we as integer), 21), 'ACGT', 'TGCA')) from st, w),
rd as (select seq, min(read_idx) as first_read from short group by seq),
ix as (select dict, substr(seq, ws + 1, 21) as key, seq from rd, w where length(seq) > we),
ca as (select seq, contig_id, case rc when 'r' then spot + 60 - length(seq) else spot end as pos, rc, min(dict) as dict from pr join ix using (dict, key) where regexp_full_match(key, '[ACGT]+') group by 1, 2, 3, 4),
th as (select ca.*, substr(s, cast(pos + 1 as integer), length(seq)) as there, case rc when 'r' then reverse(translate(seq, 'ACGT', 'TGCA')) else seq end as t from ca join cs using (contig_id) where pos >= 0),
co as (select *, cast(coalesce(list_sum([case when substr(t, i, 1) = substr(there, i, 1) then 0 else case substr(there, i, 1) || substr(t, i, 1) when 'AT' then 2 when 'TA' then 2 when 'CG' then 2 when 'GC' then 2 when 'CN' then 2 when 'GN' then 2 when 'TN' then 3 else 1 end end
       for i in range(1, length(t) + 1)]), 0) as integer) as cost from th where length(there) = length(t)),
ok as (select *, row_number() over (partition by seq order by contig_id, pos, rc, dict) as n from co where cost <= 24)
select read_idx, contig_id, cast(pos as bigint) as pos, rc, cost from short join ok using (seq) where n = 1""", _READS, _PLACED, _VOTES)


@query
def packed_round_trip(spark, sf):
    """Short reads through a file of the 2-bit format, and those with N through one of the 4-bit format."""
    rows, path, out = short_reads(spark, sf).select("read_idx", "seq"), _folder(spark), None
    for with_n in (False, True):
        packed.write(rows.where(seq.has_n("seq") == with_n), f"{path}/{int(with_n)}", with_n)
        back = packed.scan(spark, f"{path}/{int(with_n)}", with_n)
        out = back if out is None else out.unionByName(back)
    return out


sql("packed_round_trip", "select read_idx, seq from short", _READS)


@query
def read_layout(spark, sf):
    """Reordered reads: strand, whether a read begins a contig, place in the contig, original number and length."""
    rows = lay_out(short_reads(spark, sf).where(~seq.has_n("seq")))
    first = rows.groupBy("contig_id").agg(F.min(F.struct("pos", "read_idx")).alias("first"))
    begins = F.col("first.read_idx") == F.col("read_idx")
    return rows.join(first, "contig_id").select("contig_id", "read_idx", "rc", F.when(begins, 0).otherwise(1).alias("flag"), "pos", F.length("text").alias("len"))


@query
def exact_overlap_suffix(spark, sf):
    """Best successor of each clean read without any difference, and the bases it adds."""
    rows = _clean_placed(spark, sf)
    best = overlap.best_overlap(overlap.overlaps(rows, _L, _L // 2 - 1, 0, same_strand_only=True))
    both = best.join(rows.select("read_idx", F.length("seq").alias("n")), "read_idx").join(rows.select(F.col("read_idx").alias("other"), "seq"), "other")
    return both.select("read_idx", "other", "shift", F.right("seq", F.greatest(F.col("shift") + F.length("seq") - F.col("n"), F.lit(0))).alias("suffix"))


sql("exact_overlap_suffix", """!
w(dict, ws, we) as (values (0, 18, 49), (1, 50, 81)),
ix as (select * from (select *, row_number() over (partition by dict, key order by read_idx desc) as n from k) where n <= 1000),
pr as (select read_idx, dict, s as shift, substr(seq, s + ws + 1, 32) as key from cp, w, range(0, 50) t(s) where s + we < length(seq)),
tx as (select p.read_idx, p.shift, p.dict, i.read_idx as other, a.seq as a, b.seq as b from pr p join ix i using (dict, key) join cp a on a.read_idx = p.read_idx join cp b on b.read_idx = i.read_idx where p.read_idx <> i.read_idx),
ok as (select *, row_number() over (partition by read_idx order by shift, dict, other desc) as n from tx where substr(a, shift + 1, least(length(a) - shift, length(b))) = substr(b, 1, least(length(a) - shift, length(b))))
select read_idx, other, shift, case when shift + length(b) > length(a) then right(b, shift + length(b) - length(a)) else '' end as suffix from ok where n = 1""", _PLACED, _CLEAN_PLACED, _KEYS)


@query
def quality_divergence(spark, sf):
    """Divergence in bits of the quality distribution of mate 1 from that of all reads."""
    values = reads(spark, sf).where("qual is not null").select("mate", F.explode(quality.phred("qual")).alias("q")).groupBy("q").agg(F.count_if(F.col("mate") == 1).alias("a"), F.count("*").alias("b"))
    total = values.agg(F.sum("a").alias("a"), F.sum("b").alias("b")).first()
    p, q = values.select("q", (F.col("a") / (total["a"] or 1)).alias("p")), values.select("q", (F.col("b") / (total["b"] or 1)).alias("p"))
    return stats.kl_divergence(p, q, "q", "p").select(F.round("bits", 6).alias("bits"))


sql("quality_divergence", """!
v as (select q, count(*) filter (where mate = 1) * 1.0 as a, count(*) * 1.0 as b from cells join reads using (read_idx) group by q),
n as (select sum(a) as sa, sum(b) as sb from v)
select round(sum(a / sa * log2((a / sa) / (b / sb))), 6) as bits from v, n where a > 0""", _READS, _CELLS)


@query
def archive_stream_sizes(spark, sf):
    """Bytes of each stream of a short-mode archive on disk."""
    path = _folder(spark)
    archive.write_archive(short_reads(spark, sf), path)
    return archive.archive_sizes(spark, path)
