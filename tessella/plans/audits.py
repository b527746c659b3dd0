"""Queries on audits, evaluation, event logs, and on sources and sinks (families A, B, Q, R, S)."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import quality, summaries
from ..scratch import fresh
from ..sources import io
from .registry import query
from .tables import table


def _path(spark, name: str) -> str:
    return fresh(spark, "io", name)


@query("select c_custkey, c_name, c_mktsegment from customer")
def json_document_scan(spark, d):
    """A1: a JSON document with a list of records, written and read back."""
    path, c = _path(spark, "documents"), table(spark, d, "customer").select("c_custkey", "c_name", "c_mktsegment")
    c.groupBy("c_mktsegment").agg(F.collect_list(F.struct("c_custkey", "c_name", "c_mktsegment")).alias("records")).select("records").write.option("maxRecordsPerFile", 1).json(path)
    return io.read_documents(spark, path, "records", "c_custkey long, c_name string, c_mktsegment string")


@query("select o_orderkey, o_orderstatus from orders where o_orderstatus in ('F', 'P')")
def partition_scan(spark, d):
    """A3, A4, B2: a projection written by partition, of which only some are read; an unknown one gives no rows."""
    path = _path(spark, "partitions")
    io.write_partitioned(table(spark, d, "orders").select("o_orderkey", "o_orderstatus"), path, "o_orderstatus")
    return io.read_partitions(spark, path, "o_orderstatus", ["F", "P", "X"]).select("o_orderkey", "o_orderstatus")


@query("select event_id, event_type, cast(json_extract(props, '$.k') as bigint) as k from events where event_id % 5 <> 0")
def json_lines_scan(spark, d):
    """JSON lines with blank and malformed ones among them, and a path that isn't there."""
    path, e = _path(spark, "lines"), table(spark, d, "events")
    line = F.when(F.col("event_id") % 5 == 0, F.when(F.col("event_id") % 2 == 0, "").otherwise('{"event_id": ')).otherwise(F.to_json(F.struct("event_id", "event_type", F.get_json_object("props", "$.k").cast("long").alias("k"))))
    e.select(line.alias("value")).write.text(path)
    schema = "event_id long, event_type string, k long"
    return io.read_lines(spark, path, schema, strict=False).unionByName(io.read_or_empty(spark, f"{path}-none", schema))


@query("select c.c_custkey, case when n.n_regionkey <> 2 and c.c_nationkey % 5 <> 1 then n.n_name end as sidecar from customer c left join nation n on n.n_nationkey = c.c_nationkey")
def sidecar_lookup(spark, d):
    """A5: a sidecar record by key, refused where a version field differs."""
    c = table(spark, d, "customer").withColumn("version", F.when(F.col("c_nationkey") % 5 == 1, 2).otherwise(1))
    n = table(spark, d, "nation").select(F.col("n_nationkey").alias("c_nationkey"), "n_name", F.when(F.col("n_regionkey") == 2, 2).otherwise(1).alias("its_version"))
    same = (F.col("version") == 1) & (F.col("its_version") == 1)
    return c.join(n, "c_nationkey", "left").select("c_custkey", F.when(same, F.col("n_name")).alias("sidecar"))


@query(
    "select page_id, 'lrs_' || substr(sha256(regexp_extract(url, '^https?://([^/?#]+)', 1) || chr(31) || page_id), 1, 16) as snapshot_id, 'lr_' || substr(sha256(regexp_extract(url, '^https?://([^/?#]+)', 1) || chr(31) || url), 1, 16) as resource_id, cast(greatest(1, (length(html) + 999) // 1000) as bigint) as fragments from pages"
)
def connector_candidates(spark, d):
    """Candidates of a connector as snapshot and resource with stable ids, and how many fragments they have."""
    host = F.parse_url(F.col("url"), F.lit("HOST"))
    fragments = F.greatest(F.lit(1), F.floor((F.length("html") + 999) / 1000)).cast("long")
    return table(spark, d, "pages").select("page_id", summaries.typed_id("lrs", [host, F.col("page_id")]).alias("snapshot_id"), summaries.typed_id("lr", [host, F.col("url")]).alias("resource_id"), fragments.alias("fragments"))


@query("select n_nationkey as key, n_name as name, (select count(*) from customer where c_nationkey = n_nationkey) as n from nation")
def csv_report(spark, d):
    """A report as CSV with a header, written and read back."""
    path = _path(spark, "report")
    n = table(spark, d, "customer").groupBy(F.col("c_nationkey").alias("key")).agg(F.count("*").alias("n"))
    r = table(spark, d, "nation").select(F.col("n_nationkey").alias("key"), F.col("n_name").alias("name")).join(n, "key", "left").fillna(0, ["n"])
    r.write.option("header", True).csv(path)
    return spark.read.option("header", True).schema("key int, name string, n long").csv(path)


@query("select o_custkey as collection, list_sort(list(distinct o_orderkey)) as items from orders group by 1")
def collection_roundtrip(spark, d):
    """Collections exported as JSON and imported again."""
    path = _path(spark, "collections")
    table(spark, d, "orders").groupBy(F.col("o_custkey").alias("collection")).agg(F.sort_array(F.collect_set("o_orderkey")).alias("items")).write.json(path)
    return spark.read.schema("collection long, items array<long>").json(path)


LISTS = {
    "missing_skill": "o_orderpriority = '5-LOW'", "late": "o_orderdate < timestamp '1993-01-01'", "large": "o_totalprice > 400000", "open": "o_orderstatus = 'O'",
    "partial": "o_orderstatus = 'P'", "orphan": "o_custkey not in (select c_custkey from customer)", "format": "o_totalprice < 1000",
}


@query(" union all ".join(f"select '{n}' as list, count(*) as n, min(o_orderkey) as first from orders where {c}" for n, c in LISTS.items()))
def review_lists(spark, d):
    """Q4: seven review lists with their sizes and first items, in one pass."""
    o = table(spark, d, "orders").join(table(spark, d, "customer").select(F.col("c_custkey").alias("o_custkey"), F.lit(True).alias("known")), "o_custkey", "left")
    rules = {n: F.expr(c) if n != "orphan" else F.col("known").isNull() for n, c in LISTS.items()}
    one = o.agg(*[F.struct(F.count_if(c).alias("n"), F.min(F.when(c, F.col("o_orderkey"))).alias("first")).alias(n) for n, c in rules.items()])
    return one.select(F.explode(F.array(*[F.struct(F.lit(n).alias("list"), F.col(f"{n}.n").alias("n"), F.col(f"{n}.first").alias("first")) for n in rules])).alias("r")).select("r.*")


AUDIT = "lineitem left join orders on o_orderkey = l_orderkey left join part on p_partkey = l_partkey left join supplier on s_suppkey = l_suppkey"
FINDINGS = {
    "no_node": "p_partkey is null", "no_standard": "o_orderkey is null", "no_source": "s_suppkey is null", "page_out_of_range": "l_linenumber not between 1 and 7", "before_start": "l_shipdate < o_orderdate",
    "confidence_out_of_range": "l_discount < 0 or l_discount > 0.1", "approved_without_evidence": "l_returnflag = 'R' and l_quantity < 2", "weak_published": "l_linestatus = 'F' and l_tax = 0", "wide_range": "l_quantity > 49",
}


@query(" union all ".join(f"select '{n}' as rule, count(*) filter ({c}) as n from {AUDIT}" for n, c in FINDINGS.items()))
def alignment_audit(spark, d):
    """Q6, Q7: an audit of alignments against their nodes, standards and sources: foreign keys, ranges, evidence."""
    li = table(spark, d, "lineitem")
    for name, key in (("orders", "o_orderkey"), ("part", "p_partkey"), ("supplier", "s_suppkey")):
        t = table(spark, d, name)
        li = li.join(t, F.col(f"l_{key[2:]}") == t[key], "left")
    return summaries.counted(li, {n: F.expr(c) for n, c in FINDINGS.items()})


@query(
    "with g as (select p_brand, p_type, count(*) as n, count(distinct p_name) as names, count(distinct p_size) as sizes, max(p_size) - min(p_size) as spread from part group by 1, 2) select p_brand, p_type, n, names, list_filter([case when names < n then 'not_distinct' end, case when sizes < 3 then 'narrow' end, case when spread > 40 then 'wide' end], lambda x: x is not null) as gaps,"
    " case when names = n and sizes >= 3 then 'ready' when n >= 3 then 'partial' else 'blocked' end as readiness from g"
)
def readiness_matrix(spark, d):
    """Q9: distinctness, structure and readiness by subject and domain."""
    g = table(spark, d, "part").groupBy("p_brand", "p_type").agg(F.count("*").alias("n"), F.count_distinct("p_name").alias("names"), F.count_distinct("p_size").alias("sizes"), (F.max("p_size") - F.min("p_size")).alias("spread"))
    gaps = F.array_compact(F.array(F.when(F.col("names") < F.col("n"), F.lit("not_distinct")), F.when(F.col("sizes") < 3, F.lit("narrow")), F.when(F.col("spread") > 40, F.lit("wide"))))
    ready = F.when((F.col("names") == F.col("n")) & (F.col("sizes") >= 3), "ready").when(F.col("n") >= 3, "partial").otherwise("blocked")
    return g.select("p_brand", "p_type", "n", "names", gaps.alias("gaps"), ready.alias("readiness"))


@query(
    "with h as (select conv_id, turn, lead(turn) over (partition by conv_id order by turn, role) as next_start, role from conversations where role = 'user'), b as (select conv_id, max(turn) as last from conversations group by 1) select conv_id, turn as start, coalesce(next_start - 1, last) as stop, case when next_start is null then 'open_end' when next_start <= turn then 'conflict' else 'bounded' end as evidence from h join b using (conv_id)"
)
def unit_ranges(spark, d):
    """Ranges from the turns that begin them: each ends before the next one, the last at the end (Q10 itself: unit_boundaries)."""
    c = table(spark, d, "conversations")
    heads = c.where("role = 'user'").withColumn("next_start", F.lead("turn").over(Window.partitionBy("conv_id").orderBy("turn", "role")))
    last = c.groupBy("conv_id").agg(F.max("turn").alias("last"))
    evidence = F.when(F.col("next_start").isNull(), "open_end").when(F.col("next_start") <= F.col("turn"), "conflict").otherwise("bounded")
    return heads.join(last, "conv_id").select("conv_id", F.col("turn").alias("start"), F.coalesce(F.col("next_start") - 1, "last").alias("stop"), evidence.alias("evidence"))


COUNTERS = {
    "wrong_subject": "l_returnflag = 'R' and o_orderstatus = 'F'", "excluded_subject": "l_linestatus = 'O' and o_orderpriority = '1-URGENT'", "wrong_band": "l_linenumber > 5 and o_totalprice < 100000", "below_min_score": "l_discount < 0.02",
    "forbidden_code": "l_suppkey = 7", "missing_expected": "l_quantity = 50", "no_evidence": "l_tax = 0", "above_limit": "l_linenumber > 6",
    "wrong_domain": "l_returnflag = 'A' and o_orderstatus = 'P'", "wrong_skill": "l_tax > 0.07", "no_review": "l_linestatus = 'F' and l_returnflag = 'N'", "fake_code": "l_partkey = 0", "expected_only": "l_quantity < 2",
    "should_be_empty": "o_totalprice < 2000", "no_rationale": "l_shipdate < o_orderdate",
}


@query(" union all ".join(f"select '{n}' as rule, count(*) filter ({c}) as n from lineitem join orders on o_orderkey = l_orderkey" for n, c in COUNTERS.items()))
def contract_counters(spark, d):
    """Counters of a search contract's violations over all results, in one pass: fifteen rules."""
    o = table(spark, d, "orders").withColumnRenamed("o_orderkey", "l_orderkey")
    return summaries.counted(table(spark, d, "lineitem").join(o, "l_orderkey"), {n: F.expr(c) for n, c in COUNTERS.items()})


@query(
    "with r as (select l_orderkey as q, l_linenumber as k, l_returnflag = 'R' as good, l_linestatus = 'F' as meta, l_discount > 0 as explained, l_suppkey = 7 as forbidden, row_number() over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_returnflag) as rank from lineitem), f as (select q, min(rank) filter (good) as first from r group by 1)"
    " select count(*) as queries, count(*) filter (first = 1) as top1, count(*) filter (first <= 3) as recall3, cast(coalesce(sum(1000000 // first), 0) as bigint) as mrr_millionths, (select count(*) filter (meta) from r) as metadata_hits, (select count(*) filter (explained) from r) as explained, (select count(*) filter (forbidden and rank = 1) from r) as forbidden_top from f"
)
def ranking_evaluation(spark, d):
    """Top-1, recall at 3, reciprocal rank, metadata accuracy, explained results, forbidden tops."""
    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_returnflag")
    r = table(spark, d, "lineitem").withColumn("rank", F.row_number().over(w))
    q = r.groupBy("l_orderkey").agg(F.min(F.when(F.col("l_returnflag") == "R", F.col("rank"))).alias("first"), F.count_if(F.col("l_linestatus") == "F").alias("meta"), F.count_if(F.col("l_discount") > 0).alias("explained"), F.count_if((F.col("l_suppkey") == 7) & (F.col("rank") == 1)).alias("forbidden"))
    return q.agg(F.count("*").alias("queries"), F.count_if(F.col("first") == 1).alias("top1"), F.count_if(F.col("first") <= 3).alias("recall3"), F.coalesce(F.sum(F.floor(F.lit(1000000) / F.col("first"))), F.lit(0)).cast("long").alias("mrr_millionths"), F.sum("meta").alias("metadata_hits"), F.sum("explained").alias("explained"), F.sum("forbidden").alias("forbidden_top"))


@query("with g as (select o_custkey as source, o_orderkey as generation, o_orderdate as at_time, o_orderstatus = 'F' as committed from orders) select source, arg_max(generation, (at_time, generation)) filter (committed) as current_generation, count(*) as generations, count(*) filter (not committed) as unfinished from g group by 1")
def current_generation(spark, d):
    """The generation that each source points at: the latest that is complete."""
    o = table(spark, d, "orders")
    done = F.col("o_orderstatus") == "F"
    return o.groupBy(F.col("o_custkey").alias("source")).agg(F.max(F.when(done, F.struct("o_orderdate", "o_orderkey")))["o_orderkey"].alias("current_generation"), F.count("*").alias("generations"), F.count_if(~done).alias("unfinished"))


@query("with s as (select user_id, arg_max(event_type, (ts, event_id)) as state, max(ts) as since from events group by 1) select state, count(*) as n from s group by 1")
def asset_states(spark, d):
    """A snapshot of coverage from a log: the last state of each asset."""
    s = table(spark, d, "events").groupBy("user_id").agg(F.max_by("event_type", F.struct("ts", "event_id")).alias("state"))
    return s.groupBy("state").agg(F.count("*").alias("n"))


@query("select key, decision, by_rule from (select o_custkey as key, max_by(o_orderstatus, o_orderkey) as decision, 'latest' as by_rule from orders group by 1) where decision <> 'P'")
def decided_items(spark, d):
    """V: items whose latest decision is final, against those that wait."""
    items = table(spark, d, "orders").select(F.col("o_custkey").alias("key")).distinct()
    decisions = table(spark, d, "orders").select(F.col("o_custkey").alias("key"), F.col("o_orderstatus").alias("decision"), "o_orderkey")
    return quality.overlay(items, decisions, ["key"], "o_orderkey").where("decision not in ('P', 'pending')").select("key", "decision", F.lit("latest").alias("by_rule"))


@query("select event_id, day from (select event_id, strftime(ts, '%Y-%m-%d') as day, row_number() over (partition by strftime(ts, '%Y-%m-%d') order by ts desc, event_id desc) as r from events where ts >= (select max(ts) from events) - interval 10 days) where r <= 5")
def retention_ttl(spark, d):
    """The newest events of each day, none older than its time to live of ten days before the latest."""
    e = table(spark, d, "events")
    live = e.join(F.broadcast(e.agg(F.max("ts").alias("latest")))).where(F.col("ts") >= F.col("latest") - F.expr("interval 10 days"))  # one row
    w = Window.partitionBy("day").orderBy(F.desc("ts"), F.desc("event_id"))
    return live.withColumn("day", F.date_format("ts", "yyyy-MM-dd")).withColumn("r", F.row_number().over(w)).where("r <= 5").select("event_id", "day")


@query("select l_returnflag as kind, count(*) as n, count(*) filter (l_tax = 0) as no_provenance, count(distinct l_partkey) as sources, count(distinct l_suppkey) as targets from lineitem group by 1")
def graph_audit(spark, d):
    """counts by relation type, missing provenance and linked nodes."""
    return table(spark, d, "lineitem").groupBy(F.col("l_returnflag").alias("kind")).agg(F.count("*").alias("n"), F.count_if(F.col("l_tax") == 0).alias("no_provenance"), F.count_distinct("l_partkey").alias("sources"), F.count_distinct("l_suppkey").alias("targets"))


@query(
    "with e as (select l_partkey as a, l_suppkey as b, list_sort(list(distinct l_returnflag)) as evidence from lineitem group by 1, 2), j as (select e.*, r.a is not null as both_ways, p_size % 5 <> s_nationkey % 5 as crosses from e left join e r on r.a = e.b and r.b = e.a join part on p_partkey = e.a join supplier on s_suppkey = e.b)"
    " select a, b, evidence, case when both_ways then 72 else 52 end as confidence from j where not crosses"
)
def relation_trust(spark, d):
    """Edges merged with their evidence; 0.72 where both directions stand, else 0.52; cross-subject ones are rejected."""
    e = table(spark, d, "lineitem").groupBy(F.col("l_partkey").alias("a"), F.col("l_suppkey").alias("b")).agg(F.sort_array(F.collect_set("l_returnflag")).alias("evidence"))
    back = e.select(F.col("b").alias("a"), F.col("a").alias("b"), F.lit(True).alias("back"))
    p, s = table(spark, d, "part").select(F.col("p_partkey").alias("a"), "p_size"), table(spark, d, "supplier").select(F.col("s_suppkey").alias("b"), "s_nationkey")
    kept = e.join(back, ["a", "b"], "left").join(p, "a").join(s, "b").where(F.col("p_size") % 5 == F.col("s_nationkey") % 5)
    return kept.select("a", "b", "evidence", F.when(F.col("back"), 72).otherwise(52).alias("confidence"))
