"""Queries on selections, mappings and small parsers (families C, E, F, G, I, J, L)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import understanding as U
from ..operators import selections
from .registry import query
from .tables import table
from .understanding import REQUEST, requests, sql_first, sql_gone


@query("with v as (select event_id, case event_id % 5 when 0 then 'public, evidence' when 1 then ' admin ,x,' || event_type || ',admin' when 2 then '' when 3 then null else 'Textbook,source' end as v from events), f as (select event_id, list_filter(list_transform(string_split(coalesce(v, ''), ','), lambda x: trim(x)), lambda x: x in ('public', 'source', 'evidence', 'textbook', 'admin')) as f from v) select event_id, case when len(f) > 0 then f else ['public'] end as fieldsets from f")
def fieldset_parse(spark, d):
    """C4: field sets of a comma list; unknown ones go, and none is public."""
    n = F.col("event_id") % 5
    v = F.when(n == 0, "public, evidence").when(n == 1, F.concat(F.lit(" admin ,x,"), "event_type", F.lit(",admin"))).when(n == 2, "").when(n == 3, F.lit(None)).otherwise("Textbook,source")
    return table(spark, d, "events").select("event_id", selections.fieldsets(v).alias("fieldsets"))


@query("select event_id, user_id from (select event_id, user_id, row_number() over (partition by user_id order by ts, event_id) as r from events) where r <= 3")
def source_quota(spark, d):
    """The first three of each source by arrival."""
    return selections.quota(table(spark, d, "events"), "user_id", ["ts", "event_id"], 3).select("event_id", "user_id")


@query("with k as (select *, row_number() over (partition by l_suppkey, l_returnflag order by l_extendedprice desc, l_orderkey, l_linenumber, l_partkey, l_quantity) as r from lineitem) select l_suppkey, l_returnflag, l_orderkey, l_linenumber, row_number() over (order by l_extendedprice desc, l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity) as number from k where r <= 3")
def edition_limit(spark, d):
    """At most three of each group, and those in one order."""
    order = F.struct((-F.col("l_extendedprice")).alias("minus"), "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity")
    return selections.limited_by_group(table(spark, d, "lineitem"), ["l_suppkey", "l_returnflag"], order, 3).select("l_suppkey", "l_returnflag", "l_orderkey", "l_linenumber", "number")


_TOLD = "case when p_size % 3 = 0 then ['arts', 'math', 'arts'] else [] end"
_MODEL = "case when p_size % 4 = 1 then ['science', 'pe'] else [] end"
_ASKED = "case when p_size % 5 = 0 then ['math', 'pe'] else [] end"


@query(f"with x as (select id, {sql_gone('q')} as gone, {_TOLD} as told, {_MODEL} as model, {_ASKED} as own from {REQUEST}), u as (select id, own, told || model || gone as a from x) select id, list_filter({sql_first('a')}, lambda s: not list_contains(own, s)) as excluded from u")
def exclusion_union(spark, d):
    """Exclusions of the request, the model and the text, without subjects that are asked for."""
    size = F.col("p_size")
    told, model, own = F.when(size % 3 == 0, U.strings(["arts", "math", "arts"])), F.when(size % 4 == 1, U.strings(["science", "pe"])), F.when(size % 5 == 0, U.strings(["math", "pe"]))
    return requests(spark, d).select("id", selections.exclusions([told, model, U.subjects_of(F.col("q"))[1]], own).alias("excluded"))


@query(f"with t as (select id, lower(q || ' ' || p_type || ' ab c-3_x') as t from {REQUEST}), r as (select id, regexp_extract_all(t, '[a-z][a-z0-9_-]{{2,}}') as latin, regexp_extract_all(t, '\\p{{Han}}{{2,}}') as runs from t) select id, list_sort(list_distinct(latin || flatten(list_transform(runs, lambda r: list_transform(generate_series(1, length(r) - 1), lambda k: substr(r, k, 2)))))) as terms from r")
def term_sets(spark, d):
    """Latin words and pairs of Han characters."""
    return requests(spark, d).select("id", F.sort_array(selections.terms(F.concat_ws(" ", "q", "p_type", F.lit("ab c-3_x")))).alias("terms"))


@query("with g as (select o_orderkey as candidate, o_custkey as c, o_orderstatus = 'P' as multi from orders), p as (select case when event_id % 3 = 0 then event_id end as candidate, case when event_id % 2 = 0 then user_id end as c, event_type as decision, event_id as at_id from events), a as (select candidate, arg_max(decision, at_id) as x from p where candidate is not null group by 1), b as (select c, arg_max(decision, at_id) as y from p where c is not null group by 1) select g.candidate, g.c as case_id, case when a.candidate is not null then x when b.c is not null and not multi then y else 'missing' end as decision, case when a.candidate is not null then 'candidate' when b.c is not null and not multi then 'case' else 'missing' end as matched_by from g left join a on a.candidate = g.candidate left join b on b.c = g.c")
def evaluation_join(spark, d):
    """Predictions by candidate, else by case, else missing."""
    golden = table(spark, d, "orders").select(F.col("o_orderkey").alias("candidate"), F.col("o_custkey").alias("case"), (F.col("o_orderstatus") == "P").alias("multi"))
    i = F.col("event_id")
    predictions = table(spark, d, "events").select(F.when(i % 3 == 0, i).alias("candidate"), F.when(i % 2 == 0, F.col("user_id")).alias("case"), F.col("event_type").alias("decision"), i.alias("at"))
    return selections.evaluated(golden, predictions, "at").select("candidate", F.col("case").alias("case_id"), "decision", "matched_by")


@query(
    "with u as (select p_brand as grp, p_partkey as unit, lower(p_name) as title from part where p_size > 25), s as (select p_brand as grp, p_partkey as section, lower(p_name) as title from part where p_size <= 25), d as (select p_brand as grp, p_partkey as unit, p_partkey + 25 as section from part where p_partkey % 10 = 0),"
    " t as (select d.*, u.unit is not null as has_u, s.section is not null as has_s from d left join u on u.grp = d.grp and u.unit = d.unit left join s on s.grp = d.grp and s.section = d.section),"
    " o as (select u.*, row_number() over (partition by u.grp, u.title order by u.unit) as k from u where not exists (select 1 from t where t.unit = u.unit and t.grp = u.grp and has_u and has_s)),"
    " f as (select grp, title, count(*) as n, min(section) as section from s where not exists (select 1 from t where t.section = s.section and t.grp = s.grp and has_u and has_s) group by 1, 2)"
    " select grp, unit, section, 'explicit_manifest' as method, 0.9::double as confidence from t where has_u and has_s union all select grp, case when has_u then unit end, null, 'missing_reference', null from t where not (has_u and has_s)"
    " union all select o.grp, o.unit, case when n = 1 and k = 1 then section end, case when n > 1 then 'ambiguous' when n = 1 and k = 1 then 'exact_normalized_title' else 'no_section' end, case when n = 1 and k = 1 then 0.96::double end from o left join f on f.grp = o.grp and f.title = o.title"
)
def declared_mappings(spark, d):
    """Declared mappings, then equal titles, each section once; what is ambiguous or has none is a gap."""
    p = table(spark, d, "part")
    units = p.where("p_size > 25").select(F.col("p_brand").alias("grp"), F.col("p_partkey").alias("unit"), F.col("p_partkey").alias("ord"), F.col("p_name").alias("title"))
    sections = p.where("p_size <= 25").select(F.col("p_brand").alias("grp"), F.col("p_partkey").alias("section"), F.col("p_name").alias("title"))
    declared = p.where("p_partkey % 10 = 0").select(F.col("p_brand").alias("grp"), F.col("p_partkey").alias("unit"), (F.col("p_partkey") + 25).alias("section"), F.lit(0.9).alias("confidence"))
    return selections.unit_mappings(units, sections, declared)


@query("with s as (select l_discount * 10 as x, cast(l_discount * 10 as decimal(18, 4)) as y from lineitem), a as (select count(*) as pairs, cast(floor(min(y) * 10000 + 0.5) as bigint) as least, cast(floor(max(y) * 10000 + 0.5) as bigint) as most, cast(floor(sum(y)::double / count(*) * 10000 + 0.5) as bigint) as mean, count(*) filter (x >= 0.75) as high, count(*) filter (x >= 0.25 and x < 0.75) as medium, count(*) filter (x < 0.25) as low from s) select measure, value from (unpivot a on pairs, least, most, mean, high, medium, low into name measure value value)")
def similarity_summary(spark, d):
    """least, most and mean score, and pairs by band."""
    return selections.similarity_summary(table(spark, d, "lineitem").select((F.col("l_discount") * 10).alias("score")), "score", {"high": 0.75, "medium": 0.25})


@query("with a as (select distinct l_orderkey as unit, l_partkey as code, p_type as domain, [p_brand, substr(p_type, 1, 3)] as skills from lineitem join part on p_partkey = l_partkey where l_returnflag = 'R'), k as (select code, unnest(skills) as skill from a) select 'domain' as kind, domain as key, count(distinct code) as n from a group by 2 union all select 'skill', skill, count(distinct code) from k group by 2 union all select 'duplicate', code::varchar, count(*) from a group by 2 having count(*) > 1 union all select 'unmatched_units', 'all', count(*) from (select distinct l_orderkey from lineitem where l_orderkey not in (select unit from a))")
def coverage_counters(spark, d):
    """accepted codes by domain and skill, codes covered twice, units without any."""
    li = table(spark, d, "lineitem")
    p = table(spark, d, "part").select(F.col("p_partkey").alias("code"), F.col("p_type").alias("domain"), F.array("p_brand", F.substring("p_type", 1, 3)).alias("skills"))
    accepted = li.where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("unit"), F.col("l_partkey").alias("code")).join(p, "code")
    return selections.coverage_counters(accepted, li.select(F.col("l_orderkey").alias("unit")))
