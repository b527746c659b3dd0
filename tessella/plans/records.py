"""Queries on scans, filters, joins, aggregations and merges (families A to F, H, I, K)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import facets, merge, resolve, stats
from ..sources import io
from .registry import query
from .tables import BAND_ORDER, STD, std, table

ORDERED = "subject_slug, case grade_band when 'H1' then 1 when 'H2' then 2 when 'H3' then 3 when 'H4' then 4 else 999 end, code"


def sorted_std(df):
    return [F.col("subject_slug"), facets.order_of("grade_band", BAND_ORDER), F.col("code")]


@query(f"select code, subject_slug, domain, grade_band from {STD} where subject_slug in ('en','fr') and grade_band in ('H1','H2') and domain in ('src1','src2','src3') order by {ORDERED} limit 20")
def facet_search(spark, d):
    """Conjunctive facets, canonical order, first page."""
    df = facets.facet_filter(std(spark, d), {"subject_slug": ["en", "fr"], "grade_band": ["H1", "H2"], "domain": ["src1", "src2", "src3"]})
    return facets.page(facets.project(df, ["code", "subject_slug", "domain", "grade_band"]), sorted_std(df), None)


@query(f"select code, subject_slug, grade_band from {STD} where subject_slug = 'de' order by {ORDERED} limit 10 offset 10")
def facet_search_page2(spark, d):
    """H2, H3: a later page by offset cursor."""
    df = facets.facet_filter(std(spark, d), {"subject_slug": ["de"]})
    return facets.page(df.select("code", "subject_slug", "grade_band"), sorted_std(df), 10, 10)


@query(f"select count(*) as total, case when count(*) > 20 then '20' end as next_cursor from {STD} where subject_slug = 'es'")
def page_info(spark, d):
    """H2: total and next cursor."""
    return facets.page_info(facets.facet_filter(std(spark, d), {"subject_slug": ["es"]}), 0)


@query(f"select code, domain from {STD} where contains(lower(standard), 'license') or contains(lower(domain), 'license')")
def keyword_filter(spark, d):
    """D3: keyword in any of the fields."""
    return facets.facet_filter(std(spark, d), {}, ["standard", "domain"], " LICENSE ").select("code", "domain")


@query(f"select code, subject_slug from {STD} where subject_slug <> 'en' and grade_band = 'H4'")
def exclude_filter(spark, d):
    """Hard filter with exclusions."""
    return facets.facet_filter(std(spark, d), {"grade_band": ["H4"]}, exclude={"subject_slug": ["en"]}).select("code", "subject_slug")


@query("select p_partkey, p_brand, p_size from part where p_brand = (select min(p_brand) from part) and p_size between 1 and 20 and contains(lower(p_name || ' ' || p_type), 'e')")
def catalog_filter(spark, d):
    """Catalog filter with a range and free text over several fields."""
    p = table(spark, d, "part")
    brand = p.agg(F.min("p_brand").alias("p_brand"))
    return p.where(F.col("p_size").between(1, 20) & F.contains(F.lower(F.concat_ws(" ", "p_name", "p_type")), F.lit("e"))).join(F.broadcast(brand), "p_brand").select("p_partkey", "p_brand", "p_size")


@query("select l_orderkey, l_linenumber from lineitem where l_returnflag like 'R%' or 'R' like l_returnflag || '%'")
def skill_prefix_filter(spark, d):
    """Tags match by prefix in either direction."""
    df = table(spark, d, "lineitem").withColumn("tags", F.array("l_returnflag"))
    return df.where(facets.skill_prefix(F.col("tags"), ["R.1"])).select("l_orderkey", "l_linenumber")


@query(f"select subject_slug as grp, facet, value, count(*) as n from (select subject_slug, 'domain' as facet, domain as value from {STD} union all select subject_slug, 'grade_band', grade_band from {STD}) group by all")
def facet_counts(spark, d):
    """several histograms per subject in one pass."""
    return stats.histograms(std(spark, d), "subject_slug", ["domain", "grade_band"])


@query(f"select subject_slug, count(*) as total, count(distinct domain) as domains, cast(sum(n_chars) as bigint) as chars from {STD} group by 1")
def subject_stats(spark, d):
    """Totals per subject."""
    return std(spark, d).groupBy("subject_slug").agg(F.count("*").alias("total"), F.count_distinct("domain").alias("domains"), F.sum("n_chars").alias("chars"))


@query("select distinct 'R' || l_returnflag as key, l_suppkey as member from lineitem")
def skill_index(spark, d):
    """inverted index, a row per key and member."""
    return stats.inverted_index(table(spark, d, "lineitem"), F.concat(F.lit("R"), "l_returnflag"), F.col("l_suppkey"))


@query("select tag, count(*) as n from (select unnest([l_returnflag, l_linestatus, l_returnflag]) as tag from lineitem) group by 1")
def skill_coverage(spark, d):
    """exploded tags, repeats counted."""
    li = table(spark, d, "lineitem")
    return stats.counted(li.select(F.explode(F.array("l_returnflag", "l_linestatus", "l_returnflag")).alias("tag")), ["tag"])


@query("select outer_ as outer, cast(sum(n) as bigint) as total, list(inner_ || ':' || n order by n desc, inner_) as inners from (select coalesce(p_brand,'other') as outer_, coalesce(p_type,'other') as inner_, count(*) as n from part group by 1, 2) group by 1")
def domain_tree(spark, d):
    """nested histogram, sorted by count."""
    return stats.nested_histogram(table(spark, d, "part"), "p_brand", "p_type")


@query("select coalesce(nullif(lang, ''), 'missing') as value, count(*) as n from documents d left join labels l using (doc_id) group by 1")
def countinto_missing(spark, d):
    """Counts with a bucket for missing values."""
    return stats.count_into(table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id", "left"), "lang")


@query("select 'all' as grp, facet, coalesce(value, 'unknown') as value, count(*) as n from (select 'quality' as facet, quality::varchar as value from documents left join labels using (doc_id) union all select 'lang', lang from documents) group by all")
def collection_stats(spark, d):
    """histograms with an unknown bucket."""
    df = table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id", "left").withColumn("grp", F.lit("all"))
    return stats.histograms(df, "grp", ["quality", "lang"], "unknown")


@query("select 'lang' as field, count(distinct lang) = 1 as is_common from documents union all select 'source', count(distinct source) = 1 from documents union all select 'has_text', count(distinct n_chars > 0) = 1 from documents")
def common_fields(spark, d):
    """fields whose values agree over all records."""
    return stats.common_fields(table(spark, d, "documents").withColumn("has_text", F.col("n_chars") > 0), ["lang", "source", "has_text"])


@query("select upper(trim(c_name)) as alias, c_custkey as code from customer where trim(c_name) <> '' union select upper(trim(c_mktsegment)), c_custkey from customer where trim(c_mktsegment) <> ''")
def alias_index(spark, d):
    """upper-case alias index, a row per alias and code, so that no alias is one task's work."""
    return stats.alias_index(table(spark, d, "customer"), "c_custkey", F.array("c_name", "c_mktsegment"))


@query("select distinct c_mktsegment as value from customer where c_mktsegment not in ('BUILDING', 'MACHINERY')")
def filter_validation(spark, d):
    """Values that a dimension doesn't know."""
    known = spark.createDataFrame([("BUILDING",), ("MACHINERY",)], "segment string")
    return facets.validate_filter(table(spark, d, "customer").select(F.col("c_mktsegment").alias("value")).distinct(), "value", known, "segment")


@query("select c_custkey from customer where c_custkey in (select o_custkey from orders where o_totalprice > 200000)")
def index_semijoin(spark, d):
    """Semi-join."""
    o = table(spark, d, "orders").where("o_totalprice > 200000").select(F.col("o_custkey").alias("c_custkey"))
    return table(spark, d, "customer").join(o, "c_custkey", "left_semi").select("c_custkey")


@query("select n_name, r_name, c.n as customers from nation left join region on n_regionkey = r_regionkey left join (select c_nationkey, count(*) as n from customer group by 1) c on c_nationkey = n_nationkey")
def manifest_left_join(spark, d):
    """Left joins to metadata and statistics, null where absent."""
    n, r = table(spark, d, "nation"), table(spark, d, "region")
    c = table(spark, d, "customer").groupBy("c_nationkey").agg(F.count("*").alias("customers"))
    return n.join(r, n.n_regionkey == r.r_regionkey, "left").join(c, n.n_nationkey == c.c_nationkey, "left").select("n_name", "r_name", "customers")


KEYS = "keys as (select upper(p_partkey::varchar) as key, p_partkey as code, 0 as prio from part union all select distinct upper(trim(p_name)), p_partkey, 1 from part where trim(p_name) <> '' and upper(trim(p_name)) not in (select p_partkey::varchar from part))"
ASKED = "asked as (select distinct request, upper(trim(request)) as key from (select p_name as request from part union all select p_partkey::varchar from part union all select 'no such part'))"


def _requests(spark, d):
    p = table(spark, d, "part")
    return p.select(F.col("p_name").alias("request")).unionByName(p.select(F.col("p_partkey").cast("string").alias("request"))).unionByName(spark.createDataFrame([("no such part",)], "request string"))


@query(f"with {KEYS}, {ASKED} select request, case count(distinct code) when 0 then 'missing' when 1 then 'found' else 'ambiguous' end as status, case when count(distinct code) = 1 then min(code) end as code, min(prio) = 1 as by_alias from asked left join keys using (key) group by 1")
def ref_resolution(spark, d):
    """Canonical code, then alias; found, ambiguous or missing."""
    keys = resolve.reference_keys(table(spark, d, "part"), "p_partkey", [F.col("p_name")])
    return resolve.resolve(_requests(spark, d), "request", keys)


@query(f"with {KEYS}, ordered as (select p_name as request, 2 * p_partkey as place from part union all select p_partkey::varchar, 2 * p_partkey + 1 from part union all select 'no such part', -1), first as (select request, upper(trim(request)) as key, min(place) as place, count(*) as times from ordered group by 1) select row_number() over (order by place) as ordinal, request, times, status from (select request, place, times, case count(distinct code) when 0 then 'missing' when 1 then 'found' else 'ambiguous' end as status from first left join keys using (key) group by 1, 2, 3)")
def batch_lookup(spark, d):
    """Requests with repeats, each resolved once, in the order in which they first came."""
    p = table(spark, d, "part")
    keys = resolve.reference_keys(p, "p_partkey", [F.col("p_name")])
    asked = p.select(F.explode(F.array(F.struct(F.col("p_name").alias("request"), (2 * F.col("p_partkey")).alias("place")), F.struct(F.col("p_partkey").cast("string").alias("request"), (2 * F.col("p_partkey") + 1).alias("place")))).alias("r")).select("r.*")
    asked = asked.unionByName(spark.createDataFrame([("no such part", -1)], "request string, place long"))
    found = resolve.batch_lookup(asked, "place", "request", keys)
    return resolve.numbered(found, "ordinal").select(F.col("number").alias("ordinal"), "request", "times", "status")


@query("with r as (select o_orderkey, trim(x) as request from (select o_orderkey, unnest(string_split(replace(o_orderpriority || '|' || o_orderstatus, '-', '|'), '|')) as x from orders) where trim(x) <> '') select request, count(distinct o_orderkey) as n from r group by 1")
def reference_lists(spark, d):
    """Reference lists split, trimmed, without repeats, then counted."""
    parts = F.array_distinct(F.transform(F.split(F.concat_ws("|", "o_orderpriority", "o_orderstatus"), r"[|\-\n]+"), lambda x: F.trim(x)))
    return table(spark, d, "orders").select("o_orderkey", F.explode(parts).alias("request")).where("request <> ''").groupBy("request").agg(F.count("*").alias("n"))


@query("select a.p_partkey as focus, b.p_partkey as neighbour from part a join part b on a.p_brand = b.p_brand and a.p_size = b.p_size and a.p_partkey <> b.p_partkey")
def neighbors_same_group(spark, d):
    """Others of the same group."""
    p = table(spark, d, "part")
    return resolve.same_group(p, ["p_brand", "p_size"], "p_partkey", p)


@query("with t as (select distinct l_orderkey as code, l_partkey || '-' || l_suppkey as tag from lineitem) select a.code as focus, b.code as neighbour, count(*) as shared from t a join t b on a.tag = b.tag and a.code <> b.code group by 1, 2")
def neighbors_overlap(spark, d):
    """Records that share a tag."""
    t = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("code")).agg(F.collect_set(F.concat_ws("-", F.col("l_partkey").cast("string"), F.col("l_suppkey").cast("string"))).alias("tags"))
    return resolve.overlapping(t, "code", "tags", t)


@query("with e as (select distinct l_partkey as a, l_suppkey as b from lineitem) select a, b from e where not exists (select 1 from e r where r.a = e.b and r.b = e.a)")
def reverse_edge_check(spark, d):
    """Edges without their opposite; parts and suppliers are nodes of one numbering."""
    return resolve.missing_reverse(table(spark, d, "lineitem").select(F.col("l_partkey").alias("a"), F.col("l_suppkey").alias("b")).distinct())


@query("select o_custkey, o_orderkey, s, coalesce((select min(p.s) from (select o_custkey, date_diff('day', date '1990-01-01', o_orderdate::date) as s from orders) p where p.o_custkey = o.o_custkey and p.s > o.s) - 1, 9999) as e from (select o_custkey, o_orderkey, date_diff('day', date '1990-01-01', o_orderdate::date) as s from orders) o")
def lead_intervals(spark, d):
    """An interval ends before the next strictly greater start."""
    o = table(spark, d, "orders").select("o_custkey", "o_orderkey", F.datediff(F.to_date("o_orderdate"), F.lit("1990-01-01")).alias("s"))
    return resolve.lead_intervals(o, ["o_custkey"], "s", 9999, "e")


@query("with i as (select p_partkey, p_size as s, p_size + p_partkey % 7 as e from part), q as (select event_id, cast(floor(value) as bigint) % 60 as spot from events where value is not null) select p_partkey, count(*) as n, min(event_id) as first_event from i join q on spot between s and e group by 1")
def interval_join(spark, d):
    """Points within intervals, by buckets."""
    i = table(spark, d, "part").select("p_partkey", F.col("p_size").cast("long").alias("s"), (F.col("p_size") + F.col("p_partkey") % 7).alias("e"))
    q = table(spark, d, "events").where("value is not null").select("event_id", (F.floor("value") % 60).alias("at")).groupBy("at").agg(F.count("*").alias("k"), F.min("event_id").alias("ev"))
    return resolve.interval_join(i, q, [], "s", "e", "at", 8).groupBy("p_partkey").agg(F.sum("k").alias("n"), F.min("ev").alias("first_event"))


@query("select event_id, user_id, (select max(p.event_id) from events p where p.user_id = e.user_id and p.event_type = 'purchase' and (p.ts < e.ts or p.ts = e.ts) and p.ts = (select max(x.ts) from events x where x.user_id = e.user_id and x.event_type = 'purchase' and x.ts <= e.ts)) as last_purchase from events e where event_type = 'error'")
def as_of_join(spark, d):
    """E11 (extension): the latest row at or before a time."""
    e = table(spark, d, "events")
    bought = e.where("event_type = 'purchase'").groupBy("user_id", "ts").agg(F.max("event_id").alias("last_purchase"))
    return resolve.as_of(e.where("event_type = 'error'").select("event_id", "user_id", "ts"), bought, ["user_id"], "ts", "ts", "last_purchase").select("event_id", "user_id", "last_purchase")


@query("with s as (select o_custkey as k, o_orderkey as v from orders where o_orderstatus = 'F'), g as (select c_custkey as k, -1 as v from customer) select k, v from s union all select k, v from g where k not in (select k from s)")
def scope_antijoin(spark, d):
    """Specific rows, and general ones where there is no specific one."""
    s = table(spark, d, "orders").where("o_orderstatus = 'F'").select(F.col("o_custkey").alias("k"), F.col("o_orderkey").alias("v"))
    g = table(spark, d, "customer").select(F.col("c_custkey").alias("k"), F.lit(-1).cast("long").alias("v"))
    return resolve.prefer_specific(s, g, ["k"])


@query("with r as (select p_brand, unnest(generate_series(p_size, p_size + 2)) as page, p_partkey as m, p_partkey % 2 as k from part) select p_brand, page, coalesce(list_sort(list(distinct m) filter (k = 0)), []) as even, coalesce(list_sort(list(distinct m) filter (k = 1)), []) as odd from r group by 1, 2")
def page_index(spark, d):
    """Members of each page of ranges, by kind."""
    p = table(spark, d, "part").withColumn("e", F.col("p_size") + 2)
    return resolve.page_index({"even": p.where("p_partkey % 2 = 0"), "odd": p.where("p_partkey % 2 = 1")}, ["p_brand"], "p_size", "e", "p_partkey")


@query("select code, key, concat_ws(chr(10), code, key) as doc from (select doc_id::varchar as code, substr(sha256(text), 1, 12) as key from documents)")
def search_documents(spark, d):
    """Search documents with short ids."""
    t = table(spark, d, "documents").select(F.col("doc_id").cast("string").alias("code"), F.substring(F.sha2("text", 256), 1, 12).alias("key"))
    return t.select("code", "key", F.concat_ws("\n", F.nullif("code", F.lit("")), F.nullif("key", F.lit(""))).alias("doc"))


@query("select sha256(text) as hash, count(*) as n, min(doc_id) as first_id from documents group by 1 having count(*) > 1")
def dup_exact_hash(spark, d):
    """Groups of equal texts by content hash."""
    return table(spark, d, "documents").groupBy(F.sha2("text", 256).alias("hash")).agg(F.count("*").alias("n"), F.min("doc_id").alias("first_id")).where("n > 1")


@query("select finding, cast(n as bigint) as n from (select 'orphan' as finding, count(*) as n from orders where o_custkey not in (select c_custkey from customer where c_mktsegment <> 'BUILDING') union all select 'stale', count(*) from orders join customer on o_custkey = c_custkey and c_mktsegment <> 'BUILDING' where c_nationkey <> o_orderkey % 25 union all select 'childless', count(*) from customer where c_mktsegment <> 'BUILDING' and c_custkey not in (select o_custkey from orders))")
def generation_audit(spark, d):
    """Orphans, stale children, childless parents."""
    c = table(spark, d, "customer").where("c_mktsegment <> 'BUILDING'")
    o = table(spark, d, "orders").withColumn("h", F.col("o_orderkey") % 25)
    return merge.audit_generation(c, o, "c_custkey", "o_custkey", "c_nationkey", "h")


@query("with g as (select o_orderkey, o_custkey, o_totalprice, 0 as gen from orders where o_orderpriority <> '5-LOW' union all select o_orderkey, o_custkey + 1, o_totalprice, 1 from orders where o_orderstatus <> 'O') select o_orderkey, o_custkey, o_totalprice from (select *, row_number() over (partition by o_orderkey order by gen desc) as r from g) where r = 1 and o_orderkey not in (select o_orderkey from orders where o_orderstatus = 'P')")
def generation_merge(spark, d):
    """Later generations override, finished keys go."""
    o = table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_totalprice", "o_orderstatus", "o_orderpriority")
    g0, g1 = o.where("o_orderpriority <> '5-LOW'").drop("o_orderstatus", "o_orderpriority"), o.where("o_orderstatus <> 'O'").withColumn("o_custkey", F.col("o_custkey") + 1).drop("o_orderstatus", "o_orderpriority")
    return merge.merge_generations([g0, g1], ["o_orderkey"], o.where("o_orderstatus = 'P'"))


@query("with cur as (select c_custkey as id, c_nationkey as src, 'old' as v from customer), new as (select c_custkey as id, c_nationkey as src, 'new' as v from customer where c_nationkey < 5 and c_acctbal > 0), out as (select * from cur where src not in (select src from new) union all select * from new) select o_orderkey, v from orders join out on o_custkey = id")
def source_replace(spark, d):
    """A source's rows are replaced, children of rows that are gone go."""
    all_c = table(spark, d, "customer")
    c = all_c.select(F.col("c_custkey").alias("id"), F.col("c_nationkey").alias("src"), F.lit("old").alias("v"))
    new = all_c.where("c_nationkey < 5 and c_acctbal > 0").select(F.col("c_custkey").alias("id"), F.col("c_nationkey").alias("src"), F.lit("new").alias("v"))
    out, kids = merge.replace_source(c, new, "src", {"orders": (table(spark, d, "orders"), "o_custkey")})
    return kids["orders"].join(out, F.col("o_custkey") == F.col("id")).select("o_orderkey", "v")


@query("select p_brand, p_type, p_partkey as first_part from (select *, row_number() over (partition by p_brand, p_type order by p_size, p_partkey) as r from part) where r = 1")
def first_wins(spark, d):
    """The first row of a key by arrival."""
    return merge.first(table(spark, d, "part").select("p_brand", "p_type", "p_size", F.col("p_partkey").alias("first_part")), ["p_brand", "p_type"], ["p_size", "first_part"]).select("p_brand", "p_type", "first_part")


@query("select l_orderkey, list_sort(list(distinct l_suppkey)) as suppliers, max(l_quantity) as l_quantity, bool_or(l_returnflag = 'R') as approved, min(l_linenumber) as first_claim from lineitem group by 1")
def merge_claims(spark, d):
    """claims united into a card per key."""
    li = table(spark, d, "lineitem").withColumn("suppliers", F.array("l_suppkey"))
    return stats.merge_claims(li, ["l_orderkey"], F.col("l_linenumber"), ["suppliers"], ["l_quantity"], F.col("l_returnflag") == "R")


@query("select page_id, length(html) as n_html, contains(html, '<article>') as has_article, cast(len(regexp_extract_all(html, '<li>')) as integer) as n_items from pages")
def page_scan(spark, d):
    """Raw pages."""
    p = table(spark, d, "pages")
    return p.select("page_id", F.length("html").alias("n_html"), F.contains("html", F.lit("<article>")).alias("has_article"), F.regexp_count("html", F.lit("<li>")).alias("n_items"))


PAGE_TEXT = "trim(regexp_replace(replace(replace(replace(replace(replace(regexp_replace(html, '(?is)<script\\b.*?</script>|<style\\b.*?</style>|<!--.*?-->|<[^>]+>', ' ', 'g'), '&lt;', '<'), '&gt;', '>'), '&quot;', chr(34)), '&#39;', chr(39)), '&amp;', '&'), '\\s+', ' ', 'g'))"


#: Lines of a page: what a block begins or ends is a line break, headings, items and quotes get their marks.
_MARKED = "regexp_replace(regexp_replace(html, '(?is)<script\\b.*?</script>|<style\\b.*?</style>|<!--.*?-->', ' ', 'g'), '\\s+', ' ', 'g')"
for _tag, _mark in (("<h[1-6]\\b[^>]*>", "# "), ("<li\\b[^>]*>", "- "), ("<blockquote\\b[^>]*>", "> ")):
    _MARKED = f"regexp_replace({_MARKED}, '(?i){_tag}', chr(10) || '{_mark}', 'g')"
_MARKED = f"regexp_replace(regexp_replace({_MARKED}, '(?i)</?(?:p|div|br|ul|ol|table|tr|article|section|header|footer|nav|main|title|h[1-6]|li|blockquote)\\b[^>]*>', chr(10), 'g'), '<[^>]+>', ' ', 'g')"
_ENTITIES = f"replace(replace(replace(replace(replace({_MARKED}, '&lt;', '<'), '&gt;', '>'), '&quot;', chr(34)), '&#39;', chr(39)), '&amp;', '&')"


@query(
    f"with l as (select page_id, list_filter(list_transform(string_split({_ENTITIES}, chr(10)), lambda x: trim(regexp_replace(x, ' +', ' ', 'g'))), lambda x: x <> '') as lines from pages), b as (select page_id, unnest(lines) as x, unnest(range(len(lines))) as block from l)"
    " select page_id, cast(block as integer) as block, case when regexp_matches(x, '^#{1,6}\\s') then 'heading' when regexp_matches(x, '^([-*+]|[0-9]+\\.)\\s') then 'list' when starts_with(x, '>') then 'quote' else 'paragraph' end as kind, trim(regexp_replace(x, '^(#{1,6}\\s+|[-*+]\\s+|[0-9]+\\.\\s+|>\\s*)', '')) as text from b"
)
def page_text(spark, d):
    """Pages as typed blocks, split before white space is collapsed."""
    p = table(spark, d, "pages").select("page_id", io.html_lines(F.col("html")).alias("text"))
    return p.select("page_id", F.posexplode(io.markdown_blocks(F.col("text"))).alias("block", "b")).select("page_id", "block", "b.kind", "b.text")


@query("select page_id, regexp_extract(url, '^(https?)://', 1) as scheme, regexp_extract(url, '^https?://([^/?#]+)', 1) as host, nullif(regexp_extract(url, '[?&]page=([^&#]*)', 1), '') as page from pages")
def url_state(spark, d):
    """Filter state in a URL."""
    u = F.col("url")
    return table(spark, d, "pages").select("page_id", F.parse_url(u, F.lit("PROTOCOL")).alias("scheme"), F.parse_url(u, F.lit("HOST")).alias("host"), F.nullif(F.parse_url(u, F.lit("QUERY"), F.lit("page")), F.lit("")).alias("page"))


@query("select code, label, subdomain from (select p_partkey as code, coalesce(nullif(trim(p_brand), ''), p_type) as label, coalesce(nullif(trim(p_type), ''), p_brand) as subdomain from part)")
def normalize_records(spark, d):
    """Defaults and backfills."""
    return table(spark, d, "part").select(F.col("p_partkey").alias("code"), F.coalesce(F.nullif(T.compact(F.col("p_brand")), F.lit("")), "p_type").alias("label"), F.coalesce(F.nullif(T.compact(F.col("p_type")), F.lit("")), "p_brand").alias("subdomain"))


@query("select '{\"n_name\":\"' || n_name || '\",\"n_nationkey\":' || n_nationkey || ',\"n_regionkey\":' || n_regionkey || '}' as json from nation")
def stable_json(spark, d):
    """B1, M4, K2: rows as JSON with keys in order."""
    return io.stable_json(table(spark, d, "nation"))


#: Columns of all tables, by how their values become text.
MANIFEST = {
    "benchmark": "item_id text",
    "conversations": "conv_id role text turn",
    "customer": "c_acctbal:number c_custkey c_mktsegment c_name c_nationkey",
    "documents": "doc_id lang n_chars source text",
    "embeddings": "embedding:vector label vec_id",
    "events": "event_id event_type props ts:time user_id value:number",
    "labels": "doc_id quality toxic",
    "lineitem": "l_discount:number l_extendedprice:number l_linenumber l_linestatus l_orderkey l_partkey l_quantity:number l_returnflag l_shipdate:time l_suppkey l_tax:number",
    "nation": "n_name n_nationkey n_regionkey",
    "orders": "o_custkey o_orderdate:time o_orderkey o_orderpriority o_orderstatus o_totalprice:number",
    "pages": "html page_id url",
    "part": "p_brand p_name p_partkey p_retailprice:number p_size p_type",
    "region": "r_name r_regionkey",
    "supplier": "s_acctbal:number s_name s_nationkey s_suppkey",
}
_SQL_TEXT = {"": "{c}::varchar", "number": "floor({c} * 1000000)::bigint::varchar", "time": "strftime({c}, '%Y-%m-%d %H:%M:%S.%f')", "vector": "array_to_string(list_transform({c}, lambda x: floor(x::double * 1000000)::bigint::varchar), ',')"}


def _manifest_sql(name: str) -> str:
    cells = [c.partition(":") for c in MANIFEST[name].split()]
    text = " || chr(31) || ".join(f"coalesce({_SQL_TEXT[kind].format(c=c)}, '')" for c, _, kind in cells)
    return f"select '{name}' as name, count(*) as n_rows, sha256(coalesce(sum(('0x' || substr(md5({text}), 1, 15))::bigint::decimal(38,0)), 0)::varchar) as digest from {name}"


def _cell(c: str, kind: str):
    as_text = {"": lambda x: x.cast("string"), "number": lambda x: F.floor(x * 1000000).cast("string"), "time": lambda x: F.date_format(x, "yyyy-MM-dd HH:mm:ss.SSSSSS"), "vector": lambda x: F.array_join(F.transform(x, lambda v: F.floor(v.cast("double") * 1000000).cast("string")), ",")}
    return as_text[kind](F.col(c)).alias(c)


@query(" union all ".join(map(_manifest_sql, MANIFEST)))
def generation_manifest(spark, d):
    """Row counts and digests of all tables, whole, that don't depend on the order of rows."""
    return io.manifest({n: table(spark, d, n).select(*[_cell(*c.partition(":")[::2]) for c in cols.split()]) for n, cols in MANIFEST.items()})


