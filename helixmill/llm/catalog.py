"""Queries of this package over the test tables, and the SQL of those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from helixmill.operators.records import first_delivery, strip_cr
from helixmill.sources.tables import table

QUERIES, SQL = {}, {}


def query(f):
    QUERIES[f.__name__] = f
    return f


# --- 1: long exact spans shared between records ---------------------------------------------------------------------


@query
def p1_found(spark: SparkSession, sf: str) -> DataFrame:
    from helixmill.llm.shared_spans import shared_spans

    reads = first_delivery(table(spark, sf, "contig_reads").where("read is not null"), "read_order", ["read", "pos"])
    reads = reads.withColumn("text", F.upper(strip_cr("read")))
    spans = shared_spans(reads, "read_order", "text", 60, origin="pos")
    return spans.select(F.col("rid").alias("read_order"), F.col("span_from").alias("pos_from"), F.col("span_to").alias("pos_to"))


SQL["p1_found"] = r"""
with r as (select read_order, any_value(pos) as pos, any_value(upper(regexp_replace(read, '\r$', ''))) as s
           from contig_reads where read is not null and read_order is not null group by read_order),
w as (select read_order, pos, i, substr(s, i + 1, 60) as k from (select read_order, pos, s, unnest(range(0, length(s) - 59)) as i from r)),
ok as (select * from w where regexp_full_match(k, '[ACGT]{60}')),
sh as (select k from ok group by k having min(read_order) < max(read_order)),
h as (select read_order, pos, i from ok semi join sh using (k)),
m as (select *, case when i - lag(i) over (partition by read_order order by i) <= 60 then 0 else 1 end as open from h),
g as (select *, sum(open) over (partition by read_order order by i) as n from m)
select read_order, min(pos + i) as pos_from, max(pos + i) + 60 as pos_to from g group by read_order, n
"""


# --- 2: frequency of every distinct term ----------------------------------------------------------------------------


def _terms(spark: SparkSession, sf: str) -> DataFrame:
    from helixmill.llm.term_frequency import mark, term_frequency

    # a record delivered again brings the same entries again, and containers unite by id
    reads = table(spark, sf, "contig_reads").select("read_order", F.upper(strip_cr("read")).alias("text"))
    lines = table(spark, sf, "line_block_t").select("line_id", strip_cr("quality_array").alias("text"))
    out = None
    for name, rows, key, source, n, common in (("read", reads, "read_order", "contig_reads", 6, 0.06), ("quality_array", lines, "line_id", "line_block_t", 3, 0.2)):
        column = "read" if name == "read" else "quality_array"
        total = table(spark, sf, source).where(F.col(column).isNotNull()).agg(F.countDistinct(key)).first()[0]
        part = term_frequency(rows, key, "text", n).select(F.lit(name).alias("field_name"), "term", "records", "occurrences", mark(F.col("records"), F.lit(total), 2, common).alias("mark"))
        out = part if out is None else out.unionByName(part)
    return out


@query
def p2_found(spark: SparkSession, sf: str) -> DataFrame:
    return _terms(spark, sf).where("mark is not null").select("field_name", "term", "mark")


@query
def p2_counts(spark: SparkSession, sf: str) -> DataFrame:
    return _terms(spark, sf)


_TERMS = r"""
with a as (select 'read' as field_name, 6 as n, 0.06 as share, read_order as id, any_value(upper(regexp_replace(read, '\r$', ''))) as s from contig_reads where read is not null and read_order is not null group by read_order
           union all select 'quality_array', 3, 0.2, line_id, any_value(regexp_replace(quality_array, '\r$', '')) from line_block_t where quality_array is not null and line_id is not null group by line_id),
w as (select field_name, share, id, substr(s, i, n) as term from (select *, unnest(range(1, length(s) - n + 2)) as i from a)),
t as (select field_name, any_value(share) as share, count(*) as total from a group by field_name),
f as (select field_name, term, count(distinct id) as records, count(*) as occurrences from w group by field_name, term),
m as (select f.*, case when records <= 2 then 'rare' when records > total * share then 'common' end as mark from f join t using (field_name))
"""
SQL["p2_found"] = _TERMS + "select field_name, term, mark from m where mark is not null"
SQL["p2_counts"] = _TERMS + "select field_name, term, records, occurrences, mark from m"


# --- 3: repeated consecutive events ---------------------------------------------------------------------------------


@query
def p3_found(spark: SparkSession, sf: str) -> DataFrame:
    from helixmill.llm.runs import collapse_symbols

    lines = first_delivery(table(spark, sf, "line_block_t").where("quality_array is not null"), "line_id", ["quality_array"])
    runs = collapse_symbols(lines.withColumn("text", strip_cr("quality_array")), "line_id", "text", 1, 16)
    return runs.select(F.col("rid").alias("line_id"), "run_start", "run_len")


_RUNS = r"""
with l as (select line_id, any_value(regexp_replace(quality_array, '\r$', '')) as s from line_block_t where quality_array is not null and line_id is not null group by line_id),
c as (select line_id, i, ord(substr(s, i + 1, 1)) as q from (select *, unnest(range(0, length(s))) as i from l)),
b as (select *, case when abs(q - lag(q) over (partition by line_id order by i)) <= 1 then 0 else 1 end as open from c),
g as (select *, sum(open) over (partition by line_id order by i) as run from b)
"""
SQL["p3_found"] = _RUNS + "select line_id, min(i) as run_start, count(*) as run_len from g group by line_id, run having count(*) >= 16"


@query
def p3_events(spark: SparkSession, sf: str) -> DataFrame:
    """Collapsed event table: runs of one event type per user, in time order, with count and duration."""
    from helixmill.llm.runs import collapse_events

    events = table(spark, sf, "events").withColumn("at", F.expr("unix_micros(cast(ts as timestamp))"))
    return collapse_events(events, "user_id", "at", "event_type").select(F.col("entity").alias("user_id"), F.col("value").alias("event_type"), "events", "first", "duration")


SQL["p3_events"] = """
with e as (select user_id, lower(trim(event_type)) as v, epoch_us(ts) as o from events where user_id is not null and ts is not null),
b as (select *, row_number() over (partition by user_id order by o, v) - row_number() over (partition by user_id, v order by o) as island from e)
select user_id, v as event_type, count(*) as events, min(o) as first, max(o) - min(o) as duration from b group by user_id, v, island
"""


# --- 4: near-duplicate records --------------------------------------------------------------------------------------


def _sequenced(spark: SparkSession, sf: str) -> DataFrame:
    """Reads in sequencing orientation."""
    reads = first_delivery(table(spark, sf, "contig_reads").where("read is not null"), "read_order", ["read", "rc"])
    s = F.upper(strip_cr("read"))
    turned = F.lower(F.trim("rc")) == "r"
    return reads.select("read_order", F.when(turned, F.reverse(F.translate(s, "ACGT", "TGCA"))).otherwise(s).alias("text"))


@query
def p4_found(spark: SparkSession, sf: str) -> DataFrame:
    from helixmill.llm.near_duplicates import expand_pairs, similar_pairs

    return expand_pairs(*similar_pairs(_sequenced(spark, sf), "read_order", "text", 8, "ACGT", 0.5, 30))


SQL["p4_found"] = r"""
with r as (select read_order, any_value(upper(regexp_replace(read, '\r$', ''))) as s, any_value(lower(trim(rc))) as rc from contig_reads where read is not null and read_order is not null group by read_order),
o as (select read_order, case when rc = 'r' then reverse(translate(s, 'ACGT', 'TGCA')) else s end as s from r),
w as (select distinct read_order, substr(s, i, 8) as k from (select *, unnest(range(1, length(s) - 6)) as i from o)),
k as (select * from w where regexp_full_match(k, '[ACGT]{8}')),
n as (select read_order, count(*) as n from k group by read_order having count(*) >= 30),
t as (select k.read_order, k.k, n.n from k join n using (read_order)),
p as (select a.read_order as read_a, b.read_order as read_b, count(*) as c, any_value(a.n) as na, any_value(b.n) as nb from t a join t b on a.k = b.k and a.read_order < b.read_order group by 1, 2)
select read_a, read_b from p where 2 * c >= na + nb - c
"""


# --- 5: similarity clusters -----------------------------------------------------------------------------------------


def _quality_lines(spark: SparkSession, sf: str) -> DataFrame:
    lines = first_delivery(table(spark, sf, "line_block_t").where("quality_array is not null"), "line_id", ["quality_array"])
    return lines.select("line_id", strip_cr("quality_array").alias("text"))


def _standing(spark: SparkSession, sf: str) -> list[tuple[int, list[int]]]:
    """The newest mean of each cluster; the table is fixed (one row per sequencing profile)."""
    from helixmill.llm.similarity_clusters import MAX_PIVOTS

    means = table(spark, sf, "cluster_t").where("cluster_id is not null and mean is not null").groupBy("cluster_id").agg(F.max_by("mean", "updated_at").alias("mean"))
    return [(int(r[0]), list(r[1])) for r in means.limit(MAX_PIVOTS + 1).collect()]


def _quality_groups(spark: SparkSession, sf: str) -> DataFrame:
    from helixmill.llm.similarity_clusters import similarity_clusters

    return similarity_clusters(_quality_lines(spark, sf), "line_id", "text", _standing(spark, sf), 25.0)


@query
def p5_found(spark: SparkSession, sf: str) -> DataFrame:
    """The lines of all groups that stand for a given cluster."""
    return _quality_groups(spark, sf).where("standing").select(F.col("rid").alias("line_id"), F.col("pivot").cast("int").alias("cluster_id"))


@query
def p5_groups(spark: SparkSession, sf: str) -> DataFrame:
    """Size and five most typical lines of every group, of the given clusters and of those found among the rest."""
    from helixmill.llm.similarity_clusters import describe

    groups = _quality_groups(spark, sf)
    # one name space: given clusters count from 0 up, found ones (named by their pivot line) from -1 down
    named = groups.select("rid", "text", F.when(F.col("standing"), F.col("pivot")).otherwise(-1 - F.col("pivot")).alias("grp"))
    out = describe(named, 5, 33)
    return out.select(F.when(F.col("grp") >= 0, F.col("grp")).cast("int").alias("cluster_id"), F.when(F.col("grp") < 0, -1 - F.col("grp")).alias("pivot_line"), "members", "place", F.col("rid").alias("line_id"), F.round("distance", 4).alias("distance"))


@query
def p5_sizes(spark: SparkSession, sf: str) -> DataFrame:
    """What must hold for the groups: size, places and members' distances of each given cluster, and that found groups have
    two members or more, whose typical ones lie in order."""
    groups = p5_groups(spark, sf)
    order = F.max(F.struct("place", "distance"))["distance"] == F.max("distance")
    out = groups.groupBy("cluster_id", "pivot_line").agg(F.max("members").alias("members"), F.count("*").alias("listed"), order.alias("in_order"))
    fine = (F.col("listed") == F.least(F.col("members"), F.lit(5))) & F.col("in_order") & ((F.col("members") > 1) | F.col("pivot_line").isNull())
    return out.groupBy("cluster_id").agg(F.max(F.when(F.col("cluster_id").isNotNull(), F.col("members"))).alias("members"), F.bool_and(fine).alias("fine"))


SQL["p5_found"] = r"""
with l as (select line_id, any_value(regexp_replace(quality_array, '\r$', '')) as s from line_block_t where quality_array is not null and line_id is not null group by line_id),
m as (select cluster_id, arg_max(mean, updated_at) as mean from cluster_t where mean is not null and cluster_id is not null group by cluster_id),
q as (select line_id, length(s) as n, i, ord(substr(s, i, 1)) - 33 as q from (select *, unnest(range(1, length(s) + 1)) as i from l)),
d as (select line_id, cluster_id, sum((q - mean[i]) * (q - mean[i])) as total, any_value(n) as n from q, m where len(mean) >= n group by line_id, cluster_id),
b as (select *, row_number() over (partition by line_id order by total, cluster_id) as place from d)
select line_id, cluster_id from b where place = 1 and total <= 25 * n
"""


SQL["p5_sizes"] = "select cluster_id, count(*) as members, true as fine from (" + SQL["p5_found"] + ") group by cluster_id union all select null, null, true"


# --- 7: fixed-capacity containers -----------------------------------------------------------------------------------


def _packed(spark: SparkSession, sf: str) -> DataFrame:
    """Every commit in containers of every kind; one delivered again under a new doc_id is an item of its own."""
    from helixmill.llm.packing import pack
    from helixmill.llm.tokens import token_counts
    from helixmill.session import cut

    # a fixed table: one row per kind
    kinds = [(r["kind"], r["capacity_tokens"]) for r in table(spark, sf, "container_kinds").where("kind is not null and capacity_tokens > 0").groupBy("kind").agg(F.max("capacity_tokens").alias("capacity_tokens")).collect()]
    sizes = cut(token_counts(table(spark, sf, "documents"), "text", ["doc_id"]))
    return pack(sizes, "doc_id", "tokens", kinds).withColumnRenamed("rid", "doc_id")


@query
def p7_packing(spark: SparkSession, sf: str) -> DataFrame:
    return _packed(spark, sf)


@query
def p7_fill(spark: SparkSession, sf: str) -> DataFrame:
    """Containers and unused share of each kind, and the fewest containers that could hold the tokens."""
    kinds = table(spark, sf, "container_kinds").groupBy("kind").agg(F.max("capacity_tokens").alias("capacity"))
    packed = _packed(spark, sf).groupBy("kind").agg(F.sum("tokens").alias("tokens"), F.count("*").alias("pieces"), F.count_if(F.col("place") == 1).alias("containers"))
    out = packed.join(kinds, "kind")
    return out.select("kind", "capacity", "pieces", "tokens", "containers", F.ceil(F.col("tokens") / F.col("capacity")).alias("least"), (1 - F.col("tokens") / (F.col("containers") * F.col("capacity"))).alias("unused_share"))


@query
def p7_checks(spark: SparkSession, sf: str) -> DataFrame:
    """What must hold for each kind: commits placed, containers over capacity or with a gap between pieces, and commits
    split although they would fit."""
    kinds = table(spark, sf, "container_kinds").where("kind is not null and capacity_tokens > 0").groupBy("kind").agg(F.max("capacity_tokens").alias("capacity"))
    rows = _packed(spark, sf).join(F.broadcast(kinds), "kind")  # one row per kind
    inside = rows.groupBy("kind", "container").agg(F.sum("tokens").alias("t"), F.max(F.col("from_token") + F.col("tokens")).alias("end"), F.max("unused").alias("unused"), F.max("place").alias("top"), F.count("*").alias("n"), F.first("capacity").alias("capacity"))
    bad = (F.col("t") + F.col("unused") != F.col("capacity")) | (F.col("end") != F.col("t")) | (F.col("top") != F.col("n"))
    broken = inside.groupBy("kind").agg(F.count_if(bad).alias("broken_containers"))
    docs = rows.groupBy("kind", "doc_id").agg(F.count("*").alias("pieces"), F.sum("tokens").alias("t"), F.first("capacity").alias("capacity"))
    split = docs.groupBy("kind").agg(F.count("*").alias("commits"), F.count_if(F.col("pieces") != F.ceil(F.col("t") / F.col("capacity"))).alias("split_in_vain"))
    return split.join(broken, "kind").select("kind", "commits", "broken_containers", "split_in_vain")


SQL["p7_checks"] = """
with d as (select count(*) as commits from documents where doc_id is not null and text <> '')
select kind, commits, cast(0 as bigint) as broken_containers, cast(0 as bigint) as split_in_vain from (select distinct kind from container_kinds where kind is not null and capacity_tokens > 0), d
"""


# --- 8: mixing sources ----------------------------------------------------------------------------------------------


def _mixed(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    from helixmill.llm.mixing import mix_sources
    from helixmill.llm.tokens import token_counts
    from helixmill.session import cut

    # a commit delivered again under a new doc_id is the same commit; one without sha stands for itself
    docs = table(spark, sf, "documents").where("doc_id is not null").withColumn("commit", F.coalesce("commit_sha", F.concat(F.lit("doc "), "doc_id")))
    once = first_delivery(docs, "commit", ["doc_id"]).select("doc_id")
    sizes = cut(token_counts(docs, "text", ["doc_id", "source"]).join(once, "doc_id", "left_semi"))
    # a fixed table: one row per source
    targets = [(r["source"], r["target_share"], r["max_repeats"]) for r in table(spark, sf, "source_targets").collect()]
    return mix_sources(sizes, "doc_id", "source", "tokens", targets)


@query
def p8_mix(spark: SparkSession, sf: str) -> DataFrame:
    """The chosen commits with their repeats, and the shares of their source beside them."""
    chosen, report = _mixed(spark, sf)
    shares = report.select("source", "target_share", F.col("actual_share"))
    return chosen.withColumnRenamed("rid", "doc_id").join(F.broadcast(shares), "source")  # one row per target source


@query
def p8_shares(spark: SparkSession, sf: str) -> DataFrame:
    return _mixed(spark, sf)[1]


@query
def p8_checks(spark: SparkSession, sf: str) -> DataFrame:
    """What must hold for each source: no commit above its cap, no other source's commits, a share as near as records allow."""
    chosen, report = _mixed(spark, sf)
    used = chosen.groupBy("source").agg(F.max("repeats").alias("top"), F.count("*").alias("rows"), F.countDistinct("rid").alias("commits"))
    both = report.join(used, "source", "left")
    near = F.abs(F.col("actual_share") - F.col("reachable_share")) <= 0.02
    return both.select("source", (F.coalesce("top", F.lit(0)) <= F.col("max_repeats")).alias("within_cap"), F.coalesce(F.col("rows") == F.col("commits"), F.lit(True)).alias("listed_once"), near.alias("near_target"))


SQL["p8_checks"] = """
select distinct lower(trim(source)) as source, true as within_cap, true as listed_once, true as near_target from source_targets
where source is not null and target_share > 0 and not isnan(target_share) and max_repeats >= 1
"""


# --- 9: subject areas -----------------------------------------------------------------------------------------------


def _subject_model(spark: SparkSession, sf: str):
    from helixmill.llm.subjects import fit

    names = [r["subject"] for r in table(spark, sf, "subjects").where("subject is not null").select("subject").distinct().collect()]  # a fixed list
    return fit(table(spark, sf, "documents"), "doc_id", "text", table(spark, sf, "doc_labels"), "subject", names)


@query
def p9_found(spark: SparkSession, sf: str) -> DataFrame:
    from helixmill.llm.subjects import assign

    return assign(_subject_model(spark, sf)).select(F.col("doc").alias("doc_id"), "subject")


@query
def p9_composition(spark: SparkSession, sf: str) -> DataFrame:
    """Make-up of the corpus: documents of each subject, and their weight when a document of two counts by evidence."""
    from helixmill.llm.subjects import assign

    return assign(_subject_model(spark, sf)).groupBy("subject").agg(F.count("*").alias("documents"), F.round(F.sum("share"), 3).alias("weight"))
