"""Queries on resources, trust summaries, projections and small helpers (families C, D, E, F, H, I, K, L, M)."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import summaries as S
from .registry import query
from .tables import table

RESOURCE = "(select p_partkey, p_name, p_type, p_brand, p_size, [p_brand, 'Brand#' || (p_size % 7)] as subjects, [p_size % 9 + 1, (p_size + 1) % 9 + 1] as grades from part)"


@query(f"select p_partkey, p_name from {RESOURCE} where list_contains(subjects, 'Brand#3') and list_contains(grades, 4) and (p_type = 'ECONOMY' or p_type = 'PROMO') and contains(lower(p_name || ' ' || p_type), 'e')")
def resource_search(spark, d):
    """Learning resources by subject, grade, type and a keyword over all their texts."""
    size = F.col("p_size")
    r = table(spark, d, "part").withColumns({"subjects": F.array("p_brand", F.concat(F.lit("Brand#"), (size % 7).cast("string"))), "grades": F.array(size % 9 + 1, (size + 1) % 9 + 1)})
    word = F.contains(F.lower(F.concat_ws(" ", "p_name", "p_type")), F.lit("e"))
    return r.where(F.array_contains("subjects", "Brand#3") & F.array_contains("grades", 4) & F.col("p_type").isin("ECONOMY", "PROMO") & word).select("p_partkey", "p_name")


@query(
    "select o_orderkey, case when o_orderstatus = 'F' or (o_orderstatus = 'P' and o_totalprice > 200000) then 'visible' else 'hidden' end as visibility, (case o_orderpriority when '1-URGENT' then 4 when '2-HIGH' then 3 when '3-MEDIUM' then 2 else 1 end) >= 3 as has_access,"
    " o_orderstatus = 'F' or (o_orderstatus = 'O' and o_totalprice > 100000 and o_orderpriority = '1-URGENT') as publishable from orders"
)
def visibility(spark, d):
    """Approved or previewed records, access by tier, and what may be published."""
    status, price, rank = F.col("o_orderstatus"), F.col("o_totalprice"), F.col("o_orderpriority")
    tier = F.when(rank == "1-URGENT", 4).when(rank == "2-HIGH", 3).when(rank == "3-MEDIUM", 2).otherwise(1)
    seen = F.when((status == "F") | ((status == "P") & (price > 200000)), "visible").otherwise("hidden")
    return table(spark, d, "orders").select("o_orderkey", seen.alias("visibility"), (tier >= 3).alias("has_access"), ((status == "F") | ((status == "O") & (price > 100000) & (rank == "1-URGENT"))).alias("publishable"))


@query("with s as (select o_custkey, count(distinct o_orderstatus) as subjects, count(distinct o_orderpriority) as bands from orders group by 1) select o_custkey, subjects, bands, case when subjects between 1 and 3 and bands = 1 then 'subjects' when subjects = 1 and bands between 1 and 6 then 'bands' else 'invalid' end as mode from s")
def compare_selection(spark, d):
    """Whether a selection may be compared: up to three subjects in one band, or one subject over bands."""
    s = table(spark, d, "orders").groupBy("o_custkey").agg(F.count_distinct("o_orderstatus").alias("subjects"), F.count_distinct("o_orderpriority").alias("bands"))
    mode = F.when(F.col("subjects").between(1, 3) & (F.col("bands") == 1), "subjects").when((F.col("subjects") == 1) & F.col("bands").between(1, 6), "bands").otherwise("invalid")
    return s.select("o_custkey", "subjects", "bands", mode.alias("mode"))


FLAGS = "list_filter([case when n_chars < 200 then 'content_too_short' end, case when contains(text, '!!') then 'noise' end, case when toxic = 1 then 'toxic' end, case when quality is null then 'no_evidence' end], lambda x: x is not null)"


def _flagged(spark, d):
    t = table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id", "left")
    flags = [(F.col("n_chars") < 200, "content_too_short"), (F.contains("text", F.lit("!!")), "noise"), (F.col("toxic") == 1, "toxic"), (F.col("quality").isNull(), "no_evidence")]
    return t.withColumn("flags", F.array_compact(F.array(*[F.when(c, F.lit(n)) for c, n in flags])))


@query(f"with t as (select lang, unnest({FLAGS}) as flag from documents left join labels using (doc_id)) select lang, flag, count(*) as n from t group by 1, 2")
def trust_summary(spark, d):
    """counts of quality flags by subject."""
    return _flagged(spark, d).select("lang", F.explode("flags").alias("flag")).groupBy("lang", "flag").agg(F.count("*").alias("n"))


@query("with t as (select source, count(*) filter (quality = 1) as good, count(*) filter (quality = 0) as weak, count(*) as n, max(case when quality = 1 then 3 when quality = 0 then 2 else 1 end) as top from documents left join labels using (doc_id) group by 1) select source, n, good, weak, case top when 3 then 'content' when 2 then 'page' else 'none' end as highest, case when good > 0 then 'publish' when weak > 0 then 'review' else 'missing' end as disposition from t")
def alignment_summary(spark, d):
    """F16: alignments by level of evidence: the highest level and what to do."""
    t = table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id", "left")
    level = F.when(F.col("quality") == 1, 3).when(F.col("quality") == 0, 2).otherwise(1)
    g = t.groupBy("source").agg(F.count("*").alias("n"), F.count_if(F.col("quality") == 1).alias("good"), F.count_if(F.col("quality") == 0).alias("weak"), F.max(level).alias("top"))
    highest = F.when(F.col("top") == 3, "content").when(F.col("top") == 2, "page").otherwise("none")
    return g.select("source", "n", "good", "weak", highest.alias("highest"), F.when(F.col("good") > 0, "publish").when(F.col("weak") > 0, "review").otherwise("missing").alias("disposition"))


@query("with g as (select l_suppkey, l_linenumber, max(case l_returnflag when 'R' then 3 when 'A' then 2 else 1 end) as role from lineitem group by 1, 2) select l_suppkey, count(*) as grades, count(*) = 7 as complete, min(role) as least_role from g group by 1")
def edition_coverage(spark, d):
    """grades that an edition covers, and the least of the best roles over them."""
    role = F.when(F.col("l_returnflag") == "R", 3).when(F.col("l_returnflag") == "A", 2).otherwise(1)
    g = table(spark, d, "lineitem").groupBy("l_suppkey", "l_linenumber").agg(F.max(role).alias("role"))
    return g.groupBy("l_suppkey").agg(F.count("*").alias("grades"), (F.count("*") == 7).alias("complete"), F.min("role").alias("least_role"))


@query("select 'l_returnflag' as side, l_returnflag as status, count(*) as n from lineitem group by 2 union all select 'l_linestatus', l_linestatus, count(*) from lineitem group by 2")
def coverage_tallies(spark, d):
    """statuses on the incoming and the outgoing side."""
    return S.tallies(table(spark, d, "lineitem"), ["l_returnflag", "l_linestatus"])


@query("with e as (select l_orderkey, count(*) filter (l_returnflag = 'R') > 0 as first, count(*) filter (l_returnflag = 'A') > 0 as second from lineitem group by 1) select case when first and second then 'complete' when first or second then 'partial' else 'empty' end as state, count(*) as n from e group by 1")
def group_completeness(spark, d):
    """groups with the first edge, the second, or both."""
    has = lambda x: F.max((F.col("l_returnflag") == x).cast("int"))
    e = table(spark, d, "lineitem").groupBy("l_orderkey").agg((has("R") + has("A")).alias("k"))
    return e.groupBy(F.when(F.col("k") == 2, "complete").when(F.col("k") == 1, "partial").otherwise("empty").alias("state")).agg(F.count("*").alias("n"))


@query("with t as (select * from documents left join labels using (doc_id)) select * from (select 'doc_id' as \"column\", count(doc_id) as n from t union all select 'text', count(text) from t union all select 'quality', count(quality) from t union all select 'toxic', count(toxic) from t union all select 'n_chars', count(n_chars) from t) where n > 0")
def column_union(spark, d):
    """the columns that any record has, with how many have them."""
    t = table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id", "left")
    return S.columns_present(t, ["doc_id", "text", "quality", "toxic", "n_chars"])


@query("select o_orderpriority as relation, count(*) as n, count(distinct o_custkey) = (select count(distinct o_custkey) from orders where o_custkey % 10 in (1, 4)) as common from orders where o_custkey % 10 in (1, 4) group by 1".replace("where o_custkey % 10 in (1, 4)", "where o_custkey in (select c_custkey from customer where c_nationkey = 7)"))
def compare_summary(spark, d):
    """relation types of compared nodes: their counts, and whether all nodes have them."""
    nodes = table(spark, d, "customer").where("c_nationkey = 7").select(F.col("c_custkey").alias("o_custkey"))
    rows = table(spark, d, "orders").join(nodes, "o_custkey", "left_semi").select("o_custkey", F.col("o_orderpriority").alias("relation"))
    return S.compare_relations(rows, "o_custkey", "relation", rows.select("o_custkey").distinct().count())


@query("select source, count(*) as n, min(doc_id) as first_id, max(n_chars) as longest from documents group by 1")
def source_counts(spark, d):
    """rows per source."""
    return table(spark, d, "documents").groupBy("source").agg(F.count("*").alias("n"), F.min("doc_id").alias("first_id"), F.max("n_chars").alias("longest"))


@query("with c as (select source, count(distinct lang) as n, count(*) filter (lang = 'en') as en, count(*) filter (lang = 'de') as de from documents group by 1) select count(*) as domains, count(*) filter (n < 4) as differing, count(*) filter ((en > 0) <> (de > 0)) as only_one from c")
def domain_differences(spark, d):
    """domains that not all compared columns have."""
    c = table(spark, d, "documents").groupBy("source").agg(F.count_distinct("lang").alias("n"), F.count_if(F.col("lang") == "en").alias("en"), F.count_if(F.col("lang") == "de").alias("de"))
    return c.agg(F.count("*").alias("domains"), F.count_if(F.col("n") < 4).alias("differing"), F.count_if((F.col("en") > 0) != (F.col("de") > 0)).alias("only_one"))


@query("select o_custkey, list_sort(list(distinct o_orderkey))[1:8] as first_eight, cast(count(*) filter (o_orderstatus = 'P') as bigint) as warnings, coalesce(min(nullif(o_orderpriority, '5-LOW')), 'none') as progression from orders group by 1")
def evidence_summary(spark, d):
    """Ids of the evidence (the first eight in order), counts, and a value with a default."""
    first = F.slice(F.sort_array(F.collect_set("o_orderkey")), 1, 8)
    return table(spark, d, "orders").groupBy("o_custkey").agg(first.alias("first_eight"), F.count_if(F.col("o_orderstatus") == "P").alias("warnings"), F.coalesce(F.min(F.nullif("o_orderpriority", F.lit("5-LOW"))), F.lit("none")).alias("progression"))


PATHS = "case page_id % 3 when 0 then '/Users/a/' || url when 1 then 'C:\\Users\\b\\' || url else url end"


@query(f"with p as (select page_id, {PATHS} as path from pages) select page_id, case when regexp_matches(path, '^(?:/|[A-Za-z]:)') then null else regexp_replace(path, '[?#].*$', '') end as reference from p")
def portable_registry(spark, d):
    """C14: references without local paths and query strings."""
    n = F.col("page_id") % 3
    path = F.when(n == 0, F.concat(F.lit("/Users/a/"), "url")).when(n == 1, F.concat(F.lit("C:\\Users\\b\\"), "url")).otherwise(F.col("url"))
    kept = F.when(~path.rlike("^(?:/|[A-Za-z]:)"), F.regexp_replace(path, "[?#].*$", ""))
    return table(spark, d, "pages").select("page_id", kept.alias("reference"))


@query("select p_partkey, lower(replace(trim(p_brand), '#', '_')) as slug, coalesce(nullif(trim(p_name), ''), 'untitled') as title, list_transform([p_type, p_name], lambda s, i: i || ':' || upper(s)) as subskills from part")
def subject_meta(spark, d):
    """Subject and skill records brought to one form."""
    subs = F.transform(F.array("p_type", "p_name"), lambda s, i: F.concat((i + 1).cast("string"), F.lit(":"), F.upper(s)))
    return table(spark, d, "part").select("p_partkey", F.lower(F.replace(F.trim("p_brand"), F.lit("#"), F.lit("_"))).alias("slug"), F.coalesce(F.nullif(F.trim("p_name"), F.lit("")), F.lit("untitled")).alias("title"), subs.alias("subskills"))


@query("with g as (select p_partkey, p_name, p_type, unnest(case when p_size % 3 = 0 then [7, 8, 9] when p_size % 3 = 1 then [7] else [8, 9] end) as grade from part), n as (select *, row_number() over (partition by p_type, grade order by p_partkey) as k from g) select p_partkey, grade, upper(substr(p_type, 1, 3)) || '-H4G' || grade || '-' || case when contains(p_name, 'red') then 'RED' else 'GEN' end || '-' || case when k < 1000 then lpad(k::varchar, 3, '0') else k::varchar end as code from n")
def raw_standards(spark, d):
    """Raw items per grade, with a code of subject, stage, inferred domain and number."""
    size = F.col("p_size")
    grades = F.when(size % 3 == 0, F.array(F.lit(7), F.lit(8), F.lit(9))).when(size % 3 == 1, F.array(F.lit(7))).otherwise(F.array(F.lit(8), F.lit(9)))
    g = table(spark, d, "part").select("p_partkey", "p_name", "p_type", F.explode(grades).alias("grade"))
    k = F.row_number().over(Window.partitionBy("p_type", "grade").orderBy("p_partkey"))
    domain = F.when(F.contains("p_name", F.lit("red")), "RED").otherwise("GEN")
    number = F.when(k < 1000, F.lpad(k.cast("string"), 3, "0")).otherwise(k.cast("string"))
    return g.select("p_partkey", "grade", F.concat(F.upper(F.substring("p_type", 1, 3)), F.lit("-H4G"), F.col("grade").cast("string"), F.lit("-"), domain, F.lit("-"), number).alias("code"))


@query("select l_orderkey, l_linenumber, l_partkey, l_suppkey, case l_returnflag when 'R' then 'content_match' when 'A' then 'page_match' else 'unknown' end as evidence_level, least(1.0, greatest(0.0, l_discount * 10)) as confidence from lineitem where l_quantity between 1 and 50")
def textbook_detail(spark, d):
    """Alignments with their level of evidence and a confidence within 0 and 1."""
    level = F.when(F.col("l_returnflag") == "R", "content_match").when(F.col("l_returnflag") == "A", "page_match").otherwise("unknown")
    return table(spark, d, "lineitem").where(F.col("l_quantity").between(1, 50)).select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", level.alias("evidence_level"), T.clamp(F.col("l_discount") * 10, 0.0, 1.0).alias("confidence"))


@query("with e as (select l_partkey as a, l_suppkey as b, count(*) filter (l_returnflag = 'R') > 0 as approved from lineitem group by 1, 2) select a, b, list_sort(list_distinct(string_split(p_name, ' ')))[1] as code from e join part on p_partkey = a where approved")
def approved_edges(spark, d):
    """Approved edges with the first code of their node."""
    e = table(spark, d, "lineitem").groupBy(F.col("l_partkey").alias("a"), F.col("l_suppkey").alias("b")).agg(F.bool_or(F.col("l_returnflag") == "R").alias("approved")).where("approved")
    p = table(spark, d, "part").select(F.col("p_partkey").alias("a"), F.element_at(F.sort_array(F.array_distinct(F.split("p_name", " "))), 1).alias("code"))
    return e.join(p, "a").select("a", "b", "code")


@query("with n as (select distinct l_partkey as unit, l_suppkey as code from lineitem where l_shipdate >= timestamp '1998-01-01'), o as (select distinct l_partkey as unit, l_suppkey as code from lineitem where l_shipdate < timestamp '1998-01-01' and l_returnflag = 'R') select unit, code, case when o.unit is not null then 'kept' else 'new' end as status from n left join o using (unit, code) union all select unit, code, 'carried_over' from o anti join n using (unit, code)")
def legacy_carry_over(spark, d):
    """Approvals of an earlier generation are never lost."""
    li = table(spark, d, "lineitem").select(F.col("l_partkey").alias("unit"), F.col("l_suppkey").alias("code"), "l_returnflag", "l_shipdate")
    day = F.lit("1998-01-01").cast("timestamp")
    new = li.where(F.col("l_shipdate") >= day).select("unit", "code")
    return S.carry_over(new, li.where((F.col("l_shipdate") < day) & (F.col("l_returnflag") == "R")).select("unit", "code"), ["unit", "code"])


@query("select l_orderkey, l_linenumber, l_partkey from lineitem where (l_suppkey, l_returnflag) in (select s_suppkey, case when s_acctbal > 5000 then 'R' else 'A' end from supplier)")
def composite_semijoin(spark, d):
    """Resources by a composite key of surviving alignments."""
    keys = table(spark, d, "supplier").select(F.col("s_suppkey").alias("l_suppkey"), F.when(F.col("s_acctbal") > 5000, "R").otherwise("A").alias("l_returnflag"))
    return table(spark, d, "lineitem").join(keys, ["l_suppkey", "l_returnflag"], "left_semi").select("l_orderkey", "l_linenumber", "l_partkey")


@query("select conv_id, list_filter(l, lambda v, i: list_position(l, v) = i) as roles from (select conv_id, list(role order by turn, role) as l from conversations group by 1)")
def ordered_distinct(spark, d):
    """Distinct values in the order of first appearance."""
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("turn", "role"))), lambda x: x["role"])
    return table(spark, d, "conversations").groupBy("conv_id").agg(S.first_distinct(ordered).alias("roles"))


@query("with a as (select distinct l_suppkey as k from lineitem where l_returnflag = 'R'), b as (select distinct l_suppkey as k from lineitem where l_discount > 0.09), u as (select k, max(l) as l, max(r) as r from (select k, 1 as l, 0 as r from a union all select k, 0, 1 from b) group by 1) select k, case when l + r = 2 then 'both' when l = 1 then 'left' else 'right' end as side from u")
def set_comparison(spark, d):
    """I8: intersection and differences of two sets."""
    li = table(spark, d, "lineitem")
    return S.set_compare(li.where("l_returnflag = 'R'").select(F.col("l_suppkey").alias("k")), li.where("l_discount > 0.09").select(F.col("l_suppkey").alias("k")), "k")


@query("with r as (select p_brand, p_type, p_partkey, case when p_size < 20 then 0 when p_size < 35 then 1 else 2 end as source from part), k as (select *, row_number() over (partition by p_brand, p_type order by source, p_partkey) as place from r), n as (select p_brand, p_type, count(distinct source) as editions from r group by 1, 2) select p_brand, p_type, p_partkey, cast(editions as integer) as editions from k join n using (p_brand, p_type) where place = 1")
def edition_merge(spark, d):
    """Candidates of several editions merged by unit."""
    p = table(spark, d, "part").select("p_brand", "p_type", "p_partkey", "p_size")
    parts = [p.where(c).drop("p_size") for c in ("p_size < 20", "p_size >= 20 and p_size < 35", "p_size >= 35")]
    return S.merge_editions(parts, ["p_brand", "p_type"], ["p_partkey"])


@query("with c as (select o_custkey as k, max(o_orderkey) as v from orders where o_orderstatus <> 'F' group by 1), x as (select o_custkey as k, max(o_orderkey) as v from orders where o_orderstatus = 'F' group by 1) select k, v, 'current' as origin from c union all select k, v, 'restored' from x anti join c using (k)")
def soft_delete_restore(spark, d):
    """Deleted rows come back unless one of their key exists."""
    o = table(spark, d, "orders")
    last = lambda c: o.where(c).groupBy(F.col("o_custkey").alias("k")).agg(F.max("o_orderkey").alias("v"))
    return S.restored(last("o_orderstatus <> 'F'"), last("o_orderstatus = 'F'"), "k")


@query("select c_mktsegment, c_custkey, place from (select c_mktsegment, c_custkey, row_number() over (partition by c_mktsegment order by case when c_nationkey = 7 then 0 else 1 end, c_acctbal desc, c_custkey) as place from customer) where place <= 4")
def default_first(spark, d):
    """H6, H8: the default first, then the newest; fixed orders before unknown ones."""
    w = Window.partitionBy("c_mktsegment").orderBy(F.when(F.col("c_nationkey") == 7, 0).otherwise(1), F.desc("c_acctbal"), "c_custkey")
    return table(spark, d, "customer").withColumn("place", F.row_number().over(w)).where("place <= 4").select("c_mktsegment", "c_custkey", "place")


@query("select o_orderkey, 'lr_' || substr(sha256(o_custkey || chr(31) || o_orderkey), 1, 16) as resource_id, 'lra_' || substr(sha256(o_orderpriority || chr(31) || array_to_string(list_sort(['c' || o_custkey, 'a' || (o_orderkey % 5), 'b']), ',') || chr(31) || o_orderstatus), 1, 16) as alignment_id from orders")
def typed_ids(spark, d):
    """K3: stable ids by type; component ids are sorted before they are hashed."""
    parts = F.sort_array(F.array(F.concat(F.lit("c"), F.col("o_custkey").cast("string")), F.concat(F.lit("a"), (F.col("o_orderkey") % 5).cast("string")), F.lit("b")))
    return table(spark, d, "orders").select("o_orderkey", S.typed_id("lr", [F.col("o_custkey"), F.col("o_orderkey")]).alias("resource_id"), S.typed_id("lra", [F.col("o_orderpriority"), F.array_join(parts, ","), F.col("o_orderstatus")]).alias("alignment_id"))


@query("with a as (select o_custkey, sha256(string_agg(o_orderkey::varchar, ',' order by o_orderkey)) as h from orders group by 1), b as (select o_custkey, sha256(string_agg(o_orderkey::varchar, ',' order by o_orderkey)) as h from orders where o_orderdate < timestamp '1998-06-01' group by 1) select o_custkey, case when b.h is null then 'missing' when a.h <> b.h then 'stale' else 'fresh' end as state from a left join b using (o_custkey)")
def stale_by_hash(spark, d):
    """K5: derived rows whose input has another hash now."""
    o = table(spark, d, "orders")
    mark = lambda t, name: t.groupBy("o_custkey").agg(F.sha2(F.array_join(F.transform(F.sort_array(F.collect_list("o_orderkey")), lambda x: x.cast("string")), ","), 256).alias(name))
    both = mark(o, "a").join(mark(o.where(F.col("o_orderdate") < F.lit("1998-06-01").cast("timestamp")), "b"), "o_custkey", "left")
    return both.select("o_custkey", F.when(F.col("b").isNull(), "missing").when(F.col("a") != F.col("b"), "stale").otherwise("fresh").alias("state"))


@query("with g as (select l_suppkey, count(*) filter (l_returnflag = 'R') as top, count(*) filter (l_linestatus = 'O' and l_returnflag <> 'N') as bottom, epoch_ms(max(l_shipdate)) - epoch_ms(min(l_shipdate)) as ms from lineitem group by 1) select l_suppkey, least(greatest(top, 10), 60) as clamped, case when bottom = 0 then 1.0::double else top::double / bottom end as ratio, cast(floor(ms / 3600000.0) as bigint) as hours, cast(floor((case when bottom = 0 then 1.0 else top::double / bottom end) * 100 + 0.5) as bigint) as hundredths from g")
def numeric_helpers(spark, d):
    """Clamp, guarded ratio, rounding and hours between two times."""
    g = table(spark, d, "lineitem").groupBy("l_suppkey").agg(F.count_if(F.col("l_returnflag") == "R").alias("top"), F.count_if((F.col("l_linestatus") == "O") & (F.col("l_returnflag") != "N")).alias("bottom"), F.timestamp_diff("MILLISECOND", F.min("l_shipdate"), F.max("l_shipdate")).alias("ms"))
    r = T.ratio(F.col("top"), F.col("bottom"), 1.0)
    return g.select("l_suppkey", T.clamp(F.col("top"), 10, 60).alias("clamped"), r.alias("ratio"), F.floor(F.col("ms") / 3600000).alias("hours"), F.floor(r * 100 + F.lit(0.5)).alias("hundredths"))


@query(
    "with l as (select conv_id, turn, role, row_number() over (partition by conv_id order by turn, role, text) as k, text from conversations), p as (select *, coalesce(sum(length(text)) over (partition by conv_id order by k rows between unbounded preceding and 1 preceding), 0) as start from l), w as (select conv_id, string_agg(text, '' order by k) as whole from l group by 1),"
    " q as (select conv_id, k, substr(text, 2, 12) as quote from l where length(text) >= 14), f as (select distinct q.conv_id, quote, instr(whole, quote) - 1 as at_pos from q join w using (conv_id) where instr(substr(whole, instr(whole, quote) + 1), quote) = 0)"
    " select conv_id, quote, cast(min(k) as integer) as y0, cast(max(k) as integer) as y1, cast(min(turn % 7) as bigint) as x0, cast(max(turn % 7 + length(text)) as bigint) as x1 from f join p using (conv_id) where start < at_pos + length(quote) and start + length(text) > at_pos group by 1, 2"
)
def quote_boxes(spark, d):
    """The box of a quote: the union of the lines it touches, where it stands once."""
    c = table(spark, d, "conversations")
    lines = c.withColumn("k", F.row_number().over(Window.partitionBy("conv_id").orderBy("turn", "role", "text"))).withColumns({"x0": F.col("turn") % 7, "x1": F.col("turn") % 7 + F.length("text"), "y0": F.col("k"), "y1": F.col("k")})
    quotes = lines.where("length(text) >= 14").select("conv_id", F.substring("text", 2, 12).alias("quote")).distinct()
    return S.quote_box(lines, "conv_id", "k", "text", ["x0", "y0", "x1", "y1"], quotes, "quote")


@query("with j as (select event_id, case when event_id % 3 = 0 then '{\"meta\": {\"local_path\": 1}, \"p\": ' || props || '}' when event_id % 3 = 1 then '{\"api_key\" : \"x\"}' else props end as j from events), f as (select unnest(['local_path', 'api_key', 'prompt']) as name) select event_id, name from j, f where regexp_matches(j, '\"' || name || '\"\\s*:')")
def forbidden_key_scan(spark, d):
    """M6: forbidden names that are keys of a JSON text, at any depth."""
    n = F.col("event_id") % 3
    j = F.when(n == 0, F.concat(F.lit('{"meta": {"local_path": 1}, "p": '), "props", F.lit("}"))).when(n == 1, F.lit('{"api_key" : "x"}')).otherwise(F.col("props"))
    return S.forbidden_keys(table(spark, d, "events").select("event_id", j.alias("j")), "event_id", "j", ["local_path", "api_key", "prompt"])


@query("with s as (select o_custkey, list(distinct {'k': o_orderpriority, 'n': o_orderstatus}) as l from orders group by 1) select o_custkey, cast(len(l) as integer) as n, list_transform(list_sort(l), lambda x: x.k || '=' || x.n) as entries, list_bool_or(list_transform(l, lambda x: x.n = 'F')) as some, list_bool_and(list_transform(l, lambda x: x.n = 'F')) as every from s")
def nested_arrays(spark, d):
    """M1, M2, M3: arrays of structs: distinct, sorted, mapped, some and every."""
    s = table(spark, d, "orders").groupBy("o_custkey").agg(F.sort_array(F.collect_set(F.struct(F.col("o_orderpriority").alias("k"), F.col("o_orderstatus").alias("n")))).alias("l"))
    done = lambda x: x["n"] == "F"
    return s.select("o_custkey", F.size("l").alias("n"), F.transform("l", lambda x: F.concat(x["k"], F.lit("="), x["n"])).alias("entries"), F.exists("l", done).alias("some"), F.forall("l", done).alias("every"))
