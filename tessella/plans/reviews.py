"""Queries on quality rules, evaluation and metrics (families Q, R, S, V)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import evaluate, quality
from ..streaming import limits, metrics
from .registry import query
from .tables import table

RULES = {"bad_quantity": "l_quantity <= 0", "high_discount": "l_discount > 0.09", "late_tax": "l_tax > 0.07 and l_returnflag = 'N'"}


@query(" union all ".join(f"select '{n}' as rule, count(*) filter ({c}) as n from lineitem" for n, c in RULES.items()))
def contract_rules(spark, d):
    """Q1, Q3, Q6 to Q9: counts of broken rules in one pass."""
    return quality.rule_counts(table(spark, d, "lineitem"), {n: F.expr(c) for n, c in RULES.items()})


@query(" union all ".join(f"select l_orderkey || '-' || l_linenumber as key, '{n}' as rule from lineitem where {c}" for n, c in RULES.items()))
def contract_violations(spark, d):
    """Q1, Q8: rows that break rules."""
    return quality.violations(table(spark, d, "lineitem"), F.concat_ws("-", F.col("l_orderkey").cast("string"), F.col("l_linenumber").cast("string")), {n: F.expr(c) for n, c in RULES.items()})


@query("select c_mktsegment, count(*) as n from customer group by 1 having count(*) > 1")
def repeated_keys(spark, d):
    """Q1: keys that repeat."""
    return quality.repeated(table(spark, d, "customer"), "c_mktsegment")


@query("with a as (select l_suppkey, count(*) as n from lineitem group by 1), b as (select l_suppkey, count(*) as n from lineitem join orders on o_orderkey = l_orderkey group by 1) select 'missing' as side, count(*) as n from (select * from a except all select * from b) union all select 'unexpected', count(*) from (select * from b except all select * from a)")
def index_consistency(spark, d):
    """Q2: an index recomputed and compared both ways with one built by way of the orders (which lacks lines without one)."""
    li = table(spark, d, "lineitem")
    built = li.join(table(spark, d, "orders").select(F.col("o_orderkey").alias("l_orderkey")), "l_orderkey")
    count = lambda t: t.groupBy("l_suppkey").agg(F.count("*").alias("n"))
    return quality.same_rows(count(li), count(built))


@query("select o_orderkey, list_filter(['open', 'large', 'old'], lambda r: (r = 'open' and o_orderstatus = 'O') or (r = 'large' and o_totalprice > 300000) or (r = 'old' and o_orderdate < timestamp '1993-01-01')) as risks, case when o_orderpriority = '1-URGENT' then 'P0' when o_totalprice > 300000 then 'P1' else 'P3' end as priority from orders where o_orderstatus = 'O' or o_totalprice > 300000 or o_orderdate < timestamp '1993-01-01'")
def worklist(spark, d):
    """Q4, G13, V: risks and priorities of what needs review."""
    return quality.worklist(table(spark, d, "orders"), "o_orderkey", {"open": F.col("o_orderstatus") == "O", "large": F.col("o_totalprice") > 300000, "old": F.col("o_orderdate") < F.lit("1993-01-01").cast("timestamp")}, [("P0", F.col("o_orderpriority") == "1-URGENT"), ("P1", F.col("o_totalprice") > 300000)])


@query("with dec as (select o_custkey, max_by(o_orderstatus, o_orderkey) as decision from orders group by 1) select c_custkey, coalesce(decision, 'pending') as decision from customer left join dec on o_custkey = c_custkey")
def decision_overlay(spark, d):
    """E22, V: items with their latest decision."""
    dec = table(spark, d, "orders").select(F.col("o_custkey").alias("c_custkey"), F.col("o_orderstatus").alias("decision"), "o_orderkey")
    return quality.overlay(table(spark, d, "customer").select("c_custkey"), dec, ["c_custkey"], "o_orderkey")


@query("with per as (select o_custkey, count(*) as r, count(distinct o_orderstatus) as k from orders group by 1) select 'repeated' as finding, count(*) as n from per where r > 1 union all select 'conflicting', count(*) from per where k > 1 union all select 'unknown', count(*) from per where o_custkey not in (select c_custkey from customer where c_acctbal > 0) union all select 'undecided', count(*) from customer where c_acctbal > 0 and c_custkey not in (select o_custkey from per)")
def decision_audit(spark, d):
    """P5, V: findings about decisions."""
    dec = table(spark, d, "orders").select(F.col("o_custkey").alias("k"), F.col("o_orderstatus").alias("decision"))
    return quality.audit(table(spark, d, "customer").where("c_acctbal > 0").select(F.col("c_custkey").alias("k")), dec, ["k"])


@query("with t as (select doc_id, quality, toxic from documents left join labels using (doc_id)) select doc_id as key, f as field, case when quality is null then 'missing_provenance' when toxic = 1 then 'ai_feedback_loop' when quality = 0 then 'quality_flagged' when f = 'lang' then 'official' else 'structured' end as bucket from t, (values ('lang'), ('source')) v(f)")
def grounded_context(spark, d):
    """Fields that may be grounded on, and why others may not."""
    t = table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id", "left")
    one = lambda f: F.struct(F.when(F.col("quality").isNotNull(), F.lit("official" if f == "lang" else "structured")).alias("provenance"), (F.coalesce("toxic", F.lit(0)) == 1).alias("feedback"), F.when(F.col("quality") == 0, F.array(F.lit("low"))).otherwise(F.array().cast("array<string>")).alias("flags"))
    return quality.grounded(t.withColumn("trust", F.create_map(F.lit("lang"), one("lang"), F.lit("source"), one("source"))), "doc_id", ["lang", "source"], "trust")


@query("with t as (select quality = 1 as e, case when n_chars < 100 then null when n_chars < 200 then 'abstain' when contains(text, '!!') or contains(text, '%%%') then 'reject' else 'accept' end as p from labels join documents using (doc_id)) select count(*) filter (e and coalesce(p, '') = 'accept') as tp, count(*) filter (not e and p = 'accept') as fp, count(*) filter (e and coalesce(p, '') <> 'accept') as fn, count(*) filter (not e and coalesce(p, '') <> 'accept') as tn, count(*) filter (p = 'abstain') as abstained from t")
def precision_recall(spark, d):
    """Confusion counts of a rule."""
    t = table(spark, d, "labels").join(table(spark, d, "documents"), "doc_id")
    p = F.when(F.col("n_chars") < 100, F.lit(None)).when(F.col("n_chars") < 200, "abstain").when(F.contains("text", F.lit("!!")) | F.contains("text", F.lit("%%%")), "reject").otherwise("accept")
    return evaluate.confusion(t.select((F.col("quality") == 1).alias("e"), p.alias("p")), "e", "p")


@query("with r as (select p_brand, p_retailprice > 1500 as good, row_number() over (partition by p_brand order by p_size desc, p_partkey) as k from part), f as (select p_brand, min(k) filter (good) as k from r group by 1) select count(*) as queries, count(*) filter (k = 1) as top1, count(*) filter (k <= 3) as recalled, cast(coalesce(sum(floor(1000000 / k)), 0) as bigint) as mrr_millionths from f")
def mrr_recall_at_k(spark, d):
    """Top-1, recall at k, reciprocal ranks."""
    from pyspark.sql import Window

    r = table(spark, d, "part").select("p_brand", (F.col("p_retailprice") > 1500).alias("good"), F.row_number().over(Window.partitionBy("p_brand").orderBy(F.desc("p_size"), "p_partkey")).alias("k"))
    return evaluate.ranking(r, "p_brand", "k", "good", 3)


@query(
    "with m as (select user_id as stage, quantile_disc(value, 0.75) * 60 as lcp, count(*) filter (event_type = 'error')::double / count(*) as cls from events group by 1), r as (select stage, greatest(case when lcp is null then 1 when lcp > 3000 then 2 when lcp <= 2500 then 0 else 1 end, case when cls > 0.15 then 2 when cls <= 0.1 then 0 else 1 end) as s from m)"
    " select stage::varchar as stage, ['advance', 'hold', 'rollback'][s + 1] as decision from r"
)
def rollout_gate(spark, d):
    """Staged rollout decisions from each stage's latency percentile and share of errors."""
    m = table(spark, d, "events").groupBy(F.col("user_id").cast("string").alias("stage")).agg((F.expr("percentile_disc(0.75) within group (order by value)") * 60).alias("p75_lcp_ms"), (F.count_if(F.col("event_type") == "error") / F.count("*")).alias("cls"))
    return evaluate.rollout(m.unpivot(["stage"], ["p75_lcp_ms", "cls"], "metric", "value"))


@query("select event_id, place, place <= 2 as allowed, greatest(0, 2 - place) as remaining from (select event_id, row_number() over (partition by user_id, date_trunc('hour', ts) order by ts, event_id) as place from events)")
def rate_limit(spark, d):
    """Fixed-window limit; rejected requests count, too."""
    return metrics.limited(table(spark, d, "events"), ["user_id"], "ts", "event_id", 2, "1 hour").select("event_id", "place", "allowed", "remaining")


@query("with e as (select event_type, user_id % 7 as tier, value as v from events), u as (select 'all' as dim, 'all' as key, v from e union all select 'event_type', event_type, v from e union all select 'tier', tier::varchar, v from e) select dim, key, count(*) as n, cast(sum(v::decimal(18, 4)) as double) as total, max(v) as most from u group by 1, 2")
def metrics_rollup(spark, d):
    """Counts, sums and maxima by dimension."""
    return metrics.rollup(table(spark, d, "events").withColumn("tier", F.col("user_id") % 7), ["event_type", "tier"], "value")


@query("select event_id, day from (select event_id, strftime(ts, '%Y-%m-%d') as day, row_number() over (partition by strftime(ts, '%Y-%m-%d') order by ts desc, event_id desc) as r from events) where r <= 5")
def retention_last_n(spark, d):
    """The newest events of each day."""
    return metrics.keep_last(table(spark, d, "events"), F.date_format("ts", "yyyy-MM-dd"), [F.desc("ts"), F.desc("event_id")], 5).select("event_id", "day")


@query("select event_id, cast(json_extract(props, '$.k') as bigint) as k from events where json_extract(props, '$.k') is not null")
def json_event_guard(spark, d):
    """M5, S3: events whose JSON has the shape."""
    return metrics.guarded(table(spark, d, "events"), "props", "k bigint").select("event_id", F.col("parsed.k").alias("k"))


@query("select event_type, quantile_disc(value, 0.95) as p95, max(value) as most from events where value is not null group by 1")
def p95_latency(spark, d):
    """Nearest-rank percentile."""
    return table(spark, d, "events").where("value is not null").groupBy("event_type").agg(F.expr("percentile_disc(0.95) within group (order by value)").alias("p95"), F.max("value").alias("most"))


@query("select time_bucket(interval '6 hours', ts) as start, event_type, count(*) as n, cast(sum(value::decimal(18, 4)) as double) as total from events group by 1, 2")
def tumbling_windows(spark, d):
    """Extension: tumbling windows."""
    return metrics.windowed(table(spark, d, "events"), "ts", "event_type", "value", "6 hours")


@query("with o as (select user_id, ts, case when ts - lag(ts) over (partition by user_id order by ts) < interval '30 minutes' then 0 else 1 end as new from events), s as (select *, sum(new) over (partition by user_id order by ts rows unbounded preceding) as k from o) select user_id, min(ts) as start, count(*) as n from s group by user_id, k")
def session_windows(spark, d):
    """Extension: session windows."""
    return metrics.sessions(table(spark, d, "events"), "ts", "user_id", "30 minutes")


@query("select time_bucket(interval '6 hours', ts) as start, event_type, count(*) as n, cast(sum(value::decimal(18, 4)) as double) as total from events group by 1, 2")
def streaming_windows(spark, d):
    """S2 as a stream: the same windows by Structured Streaming, run to its end."""
    schema = table(spark, d, "events").schema
    stream = spark.readStream.schema(schema).option("pathGlobFilter", "*.parquet").parquet(f"{d}/events.parquet*")
    return metrics.run_stream(metrics.windowed(stream, "ts", "event_type", "value", "6 hours"), "windows")


def _events(spark, d):
    return spark.readStream.schema(table(spark, d, "events").schema).option("pathGlobFilter", "*.parquet").parquet(f"{d}/events.parquet*")


@query("select event_id, user_id::varchar as key, place, place <= 2 as allowed, greatest(0, 2 - place) as remaining from (select event_id, user_id, row_number() over (partition by user_id, date_trunc('hour', ts) order by ts, event_id) as place from events)")
def rate_limit_stream(spark, d):
    """S1 as a stream: a count per client and hour in state, with a timer that drops it."""
    return limits.appended(limits.limited(_events(spark, d), "user_id", "ts", 2, "3600 seconds"), "limits")


@query("select cast(epoch_us(day) // 86400000000 as bigint) as day, epoch_us(ts) as us, event_id from (select event_id, ts, date_trunc('day', ts) as day, row_number() over (partition by date_trunc('day', ts) order by ts desc, event_id desc) as r from events) where r <= 5 and day + interval 1 day <= (select max(ts) from events)")
def retention_stream(spark, d):
    """S4, B6 as a stream: the newest events of each day, given when the watermark has passed it."""
    return limits.newest(limits.appended(limits.retained(_events(spark, d), "ts", 5), "kept"), 5)
