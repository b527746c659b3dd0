"""Queries on ranking, text functions and scores (families G, J, L, N)."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import classes, facets, matching, score, sequential, stats
from .registry import query
from .tables import STD, std, table
from .understanding import tokens_sql

TOK = "list_distinct(regexp_extract_all(lower(coalesce({c}, '')), '[a-z]{{3,}}'))"


def _tokens(df, key, text, name):
    return df.select(F.col(key).alias(name), F.explode(T.words_of(F.col(text))).alias("token"))


@query("select p_brand, p_partkey, rank from (select p_brand, p_partkey, row_number() over (partition by p_brand order by p_retailprice desc, p_partkey) as rank from part) where rank <= 3")
def topk_per_group(spark, d):
    """The first rows of each group."""
    return facets.top_per_group(table(spark, d, "part"), ["p_brand"], [F.desc("p_retailprice"), F.col("p_partkey")], 3).select("p_brand", "p_partkey", "rank")


@query("select p_brand, p_size, p_partkey from (select *, count(*) over (partition by p_brand, p_size) as n, max(p_size) over (partition by p_brand) as top from part) where p_size = top and n = 1")
def unique_best(spark, d):
    """The best of a group, unless others tie."""
    return score.unique_best(table(spark, d, "part").select("p_brand", "p_size", "p_partkey"), ["p_brand"], "p_size")


@query("select o_custkey, cast(sum(case when o_totalprice < prev then 1 else 0 end) as bigint) as decreases from (select o_custkey, o_totalprice, lag(o_totalprice) over (partition by o_custkey order by o_orderdate, o_orderkey) as prev from orders) group by 1")
def monotonicity(spark, d):
    """How often a sequence falls."""
    w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    return table(spark, d, "orders").withColumn("prev", F.lag("o_totalprice").over(w)).groupBy("o_custkey").agg(F.sum(F.when(F.col("o_totalprice") < F.col("prev"), 1).otherwise(0)).alias("decreases"))


@query("with f as (select p_type, min(p_partkey) as seen from part group by 1) select p_type, row_number() over (order by seen) as ordinal from f")
def first_seen_ordinals(spark, d):
    """Numbers in order of first appearance (a group per value, so few rows are numbered)."""
    f = table(spark, d, "part").groupBy("p_type").agg(F.min("p_partkey").alias("seen"))
    return f.select("p_type", F.row_number().over(Window.orderBy("seen")).alias("ordinal"))


@query(
    "with recursive r as (select p_brand, p_partkey, p_retailprice, [p_type, p_size::varchar] as tags, row_number() over (partition by p_brand order by p_retailprice desc, p_partkey) as k from part),"
    " s as (select distinct p_brand, 0::bigint as k, []::bigint[] as kept, []::varchar[] as used from part union all select s.p_brand, r.k, case when len(kept) < 3 and not list_has_any(used, tags) then list_append(kept, p_partkey) else kept end, case when len(kept) < 3 and not list_has_any(used, tags) then used || tags else used end from s join r on r.p_brand = s.p_brand and r.k = s.k + 1),"
    " e as (select p_brand, arg_max(kept, k) as kept from s group by 1) select p_brand, p_partkey, p_retailprice, tags from r join e using (p_brand) where list_contains(kept, p_partkey)"
)
def diverse_topk(spark, d):
    """Greedy choice of rows that share no tag with those before."""
    li = table(spark, d, "part").select("p_brand", "p_partkey", "p_retailprice", F.array("p_type", F.col("p_size").cast("string")).alias("tags"))
    return sequential.diverse_top(li, "p_brand", ["p_retailprice", "p_partkey"], [False, True], "tags", 3)


@query(
    "with recursive t as (select p_brand as book, p_size as ordinal, p_partkey as page from part), s as (select book, 1 as o, min(page) as page from t where ordinal = 1 group by 1 union all select s.book, s.o + 1, (select min(t.page) from t where t.book = s.book and t.ordinal = s.o + 1 and t.page > s.page) from s where s.page is not null and s.o < 100)"
    " select book, cast(max(o) as bigint) as length, arg_max(page, o) as last_page from s where page is not null group by 1 having max(o) >= 2"
)
def ordinal_chains(spark, d):
    """The longest chain of ordinals 1, 2, 3 ... on rising pages."""
    li = table(spark, d, "part").select(F.col("p_brand").alias("book"), F.col("p_size").alias("ordinal"), F.col("p_partkey").alias("page"))
    return sequential.longest_chain(li, "book", "ordinal", "page", 2)


@query(
    "with recursive r as (select p_brand, p_partkey, p_size, row_number() over (partition by p_brand order by p_partkey) as k from part), s as (select distinct p_brand, 0::bigint as k, []::integer[] as used from part union all select s.p_brand, r.k, list_append(used, case when p_size >= 1 and not list_contains(used, p_size) then p_size else list_filter(generate_series(1, (len(used) + 1)::integer), lambda x: not list_contains(used, x::integer))[1]::integer end) from s join r on r.p_brand = s.p_brand and r.k = s.k + 1)"
    " select r.p_brand, p_partkey, p_size, used[-1] as seq from s join r on r.p_brand = s.p_brand and r.k = s.k"
)
def sequence_allocation(spark, d):
    """Preferred numbers where they are free, else the lowest free one."""
    return sequential.allocate(table(spark, d, "part").select("p_brand", "p_partkey", "p_size"), "p_brand", "p_partkey", "p_size")


PAIRS = f"""t as (select p_brand, p_size, p_partkey as b, unnest({TOK.format(c="p_name || ' ' || p_type")}) as token from part), l2 as (select p_brand, p_size, b as a, token from t), na as (select a, count(*) as na from l2 group by 1), nb as (select b, count(*) as nb from t group by 1),
s as (select a, b, count(*) as shared from l2 join t using (p_brand, p_size, token) group by 1, 2), pairs as (select a, b, shared, na, nb from s join na using (a) join nb using (b))"""


def _pairs(spark, d):
    """(pairs, members): pairs that share a token, of parts that stand for all with their brand, size, name and type."""
    p, members = classes.grouped(table(spark, d, "part"), "p_partkey", ["p_brand", "p_size", "p_name", "p_type"])
    rows = lambda name: p.select("p_brand", "p_size", F.col("p_partkey").alias(name), F.explode(T.words_of(F.concat_ws(" ", "p_name", "p_type"))).alias("token"))
    return score.token_overlap(rows("a"), rows("b"), ["p_brand", "p_size"]), members


@query(f"with {PAIRS} select a, b, shared, na, nb from pairs where a <> b and shared * 10 >= 6 * (na + nb - shared)")
def jaccard_pairs(spark, d):
    """Pairs by Jaccard, by prefix filtering."""
    p, members = classes.grouped(table(spark, d, "part"), "p_partkey", ["p_brand", "p_size", "p_name", "p_type"])
    side = lambda name: p.select("p_brand", "p_size", F.col("p_partkey").alias(name), T.words_of(F.concat_ws(" ", "p_name", "p_type")).alias("tokens"))
    return classes.expanded(matching.jaccard_join(side("a"), side("b"), ["p_brand", "p_size"], 3, 5), members, "p_partkey")


@query(f"with {PAIRS} select a, b, shared / least(na, nb) as overlap from pairs where a <> b and shared * 2 >= least(na, nb)")
def overlap_coeff(spark, d):
    """Overlap coefficient."""
    pairs, members = _pairs(spark, d)
    return classes.expanded(pairs.where("shared * 2 >= least(na, nb)").select("a", "b", score.overlap_coefficient().alias("overlap")), members, "p_partkey")


@query(f"with {PAIRS}, x as (select a, b, shared / sqrt(na * nb) as score from pairs where a <> b), r as (select *, row_number() over (partition by a order by score desc, b) as k from x) select a, b, score, k from r where k <= 3")
def block_similarity_topk(spark, d):
    """The most similar records of each."""
    x, members = _pairs(spark, d)
    top = classes.best(x.select("a", "b", score.cosine_overlap().alias("score")), members, members, "p_partkey", 3)
    return top.select("a", F.posexplode("best").alias("at", "x")).select("a", "x.b", "x.score", (F.col("at") + 1).alias("k"))


@query(f"with {PAIRS}, x as (select a, b, shared / sqrt(na * nb) as score from pairs where a <> b), r as (select *, row_number() over (partition by a order by score desc, b) as k, score - lead(score, 1, 0.0) over (partition by a order by score desc, b) as margin from x) select a, b, score, margin, case when score >= 0.24 and margin >= 0.04 then 'high' when score >= 0.12 then 'medium' else 'low' end as confidence from r where k = 1")
def bridge_margin(spark, d):
    """Best match, margin and confidence band."""
    x, members = _pairs(spark, d)
    top = classes.best(x.select("a", "b", score.cosine_overlap().alias("score")), members, members, "p_partkey", 2)
    # Of each part its best two, so that windows are of two rows.
    return score.best_with_margin(top.select("a", F.explode("best").alias("x")).select("a", "x.b", "x.score"), ["a"], "score", "b")


@query(f"with t as (select distinct doc_id, unnest({TOK.format(c='text')}) as token from documents) select token, count(*) as df from t group by 1")
def document_frequency(spark, d):
    """Document frequencies of words."""
    return stats.document_frequency(_tokens(table(spark, d, "documents"), "doc_id", "text", "doc"), "doc", "token")


@query(f"with t as (select doc_id, unnest({TOK.format(c='text')}) as token from documents), f as (select token, count(*) as df from t group by 1), n as (select count(*) as n from documents), b as (select item_id, unnest({TOK.format(c='text')}) as token from benchmark) select item_id, cast(floor(sum(cast(ln(1 + (n + 1) / (coalesce(df, 0) + 1)) as decimal(18, 6))) * 1000 + 0.5) as bigint) as idf_thousandths from b left join f using (token), n group by 1")
def idf_score(spark, d):
    """IDF weight of texts."""
    docs = table(spark, d, "documents")
    f = stats.document_frequency(_tokens(docs, "doc_id", "text", "doc"), "doc", "token")
    n = docs.agg(F.count("*").alias("n"))
    b = _tokens(table(spark, d, "benchmark"), "item_id", "text", "item_id").join(f, "token", "left").join(F.broadcast(n))
    w = stats.idf(F.col("n"), F.coalesce("df", F.lit(0))).cast("decimal(18,6)")
    return b.groupBy("item_id").agg(F.floor(F.sum(w) * 1000 + F.lit(0.5).cast("decimal(2,1)")).cast("long").alias("idf_thousandths"))


CORE, MORE = ["the", "license", "tion"], ["apache", "und", "que"]


def _n(words, col):
    return " + ".join(f"(case when contains({col}, '{w}') then 1 else 0 end)" for w in words)


_C, _E, _CD = _n(CORE, "t"), _n(MORE, "t"), _n(CORE, "dom")
TOPIC = f"""with b as (select code, lower(standard) as t, lower(domain) as dom from {STD}), x as (select code, t, dom, ({_C}) as c, ({_E}) as e, ({_CD}) as cd, (case when t <> '' then 1.0::double else 0.0::double end) as wt, (case when dom <> '' then 0.78::double else 0.0::double end) as wd from b),
y as (select *, least(1.0::double, (c + e * 0.45::double) / 4.35::double) * wt + least(1.0::double, cd / 4.35::double) * wd as ov, wt + wd as av, case when c > 0 then 'direct' when e > 0 then 'supporting' else 'irrelevant' end as match_strength from x),
z as (select *, case when av = 0 then 0.0::double else least(1.0::double, ov / least(2.4::double, av)) end as lexical, case when c > 0 then least(1.0::double, c / 3.0::double + e / 3.0::double * 0.15::double) else e / 3.0::double * 0.35::double end as concept from y),
s as (select code, match_strength, concept * 0.45::double + lexical * 0.3::double + (case match_strength when 'direct' then 1.0::double when 'supporting' then 0.55::double else 0.0::double end) * 0.18::double + 0.0::double * 0.04::double + 0.5::double * 0.03::double as score from z)"""


def _topic(spark, d):
    return score.relevance(std(spark, d), ["standard", "domain"], CORE, MORE)


@query(f"{TOPIC} select code, match_strength, cast(floor(score * 10000 + 0.5) as bigint) as score_1e4 from s where match_strength <> 'irrelevant' and score >= 0.12 order by cast(floor(score * 10000 + 0.5) as bigint) desc, code limit 50")
def smart_search_topic(spark, d):
    """Explained topic search."""
    x = _topic(spark, d).where("match_strength <> 'irrelevant' and score >= 0.12").select("code", "match_strength", F.floor(F.col("score") * 10000 + 0.5).alias("score_1e4"))
    return x.orderBy(F.desc("score_1e4"), "code").limit(50)


@query(f"{TOPIC} select match_strength, count(*) as n from s group by 1")
def smart_search_summary(spark, d):
    """How many records match how strongly."""
    return _topic(spark, d).groupBy("match_strength").agg(F.count("*").alias("n"))


@query(f"with b as (select code, subject_slug, lower(standard) as t from {STD}), x as (select code, least(1.0::double, ({_C} + {_E}) / 6.0::double) as cov, (case when subject_slug = 'en' then 1.0::double else 0.0::double end) as st from b where t <> '') select code, cast(floor((least(1.0::double, cov * 1.0::double / 1.0::double) * 0.62::double + st / 1 * 0.16::double + 0.0::double * 0.12::double + 0.5::double * 0.1::double) * 10000 + 0.5) as bigint) as score_1e4 from x")
def smart_search_plan(spark, d):
    """Alignment profile with a structural signal."""
    x = score.relevance(std(spark, d), ["standard"], CORE, MORE, [F.col("subject_slug") == "en"], profile="plan")
    return x.where("standard <> ''").select("code", F.floor(F.col("score") * 10000 + 0.5).alias("score_1e4"))


@query(f"with k as (select unnest(['the','license','idiot','token']) as w), h as (select code, count(*) filter (contains(lower(standard), w)) as a, count(*) filter (contains(lower(domain), w)) as b from {STD}, k group by 1) select code, cast(a as bigint) as hits, a / 4.0::double * 0.7::double + least(0.3::double, ((case when a > 0 then 1 else 0 end) + (case when b > 0 then 1 else 0 end)) * 0.06::double) as score from h where a + b > 0")
def keyword_score(spark, d):
    """Share of keywords, with a bonus for fields."""
    words = F.array(*map(F.lit, ["the", "license", "idiot", "token"]))
    hits = lambda c: F.size(F.filter(words, lambda w: F.contains(F.lower(F.col(c)), w)))
    x = std(spark, d).select("code", hits("standard").cast("long").alias("hits"), hits("domain").alias("b"))
    return x.where("hits + b > 0").select("code", "hits", (F.col("hits") / 4.0 * 0.7 + F.least(F.lit(0.3), ((F.col("hits") > 0).cast("int") + (F.col("b") > 0).cast("int")) * F.lit(0.06))).alias("score"))


GRAMS = "list_distinct([substr(s, i, 2) for i in generate_series(1, greatest(length(s) - 1, 0))])"


@query(f"with g as (select p_partkey, regexp_replace(lower(p_name), '[^\\p{{L}}\\p{{N}}]', '', 'g') as s from part) select p_partkey, cast(len({GRAMS}) as integer) as n, list_sort({GRAMS}) as grams from g where length(s) >= 2")
def bigram_sets(spark, d):
    """N-gram sets."""
    g = T.gram_set(F.col("p_name"))
    return table(spark, d, "part").select("p_partkey", F.size(g).alias("n"), F.sort_array(g).alias("grams")).where("n > 0")


@query(tokens_sql("(select conv_id, turn, text as q from conversations)", "conv_id, turn"))
def topic_tokens(spark, d):
    """Terms and pairs of longer texts."""
    return table(spark, d, "conversations").select("conv_id", "turn", T.topic_tokens(F.col("text")).alias("topic"), T.plan_tokens(F.col("text")).alias("plan"))


@query("select doc_id, cast(len(regexp_extract_all(text, '[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\\.[A-Za-z]{2,}')) as integer) as emails from documents where regexp_matches(text, '[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\\.[A-Za-z]{2,}')")
def email_counts(spark, d):
    """One of the personal data rules, where SQL can state it."""
    n = F.regexp_count("text", F.lit(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}"))
    return table(spark, d, "documents").select("doc_id", n.alias("emails")).where("emails > 0")


@query()
def redact_pii(spark, d):
    """Ordered personal data rules with counts (rows only: RE2 has no look-around)."""
    text, n, kinds = T.redact(F.col("text"))
    return table(spark, d, "documents").select("doc_id", text.alias("text"), n.alias("redactions"), kinds.alias("categories"))


FLAGS = {
    "unbalanced_quote": "len(regexp_extract_all(t, '[“‘]')) <> len(regexp_extract_all(t, '[”’]'))",
    "possible_truncation": "regexp_matches(regexp_replace(t, '[”’」』\\])]*$', ''), '([，,；;：:]|(结合|例如|比如|以及|通过|并且|其中|包括))$')",
    "possible_ocr_fragment": "regexp_matches(t, '[；;]\\s*(特点|要求|教师|学生|内容)[，,；;]')",
    "broken_delimiter": "regexp_matches(t, '\\|{2,}|；\\s*；|，，|。。')",
    "placeholder_or_fragment": "field = 'practice' and (length(t) < 8 or regexp_matches(t, '^（[^）]{0,24}｜相关）[；;]?[^，。；;]{0,10}$'))",
    "content_too_short": "field <> 'standard' and length(t) < 5",
}


#: Texts, and the first pieces of them between commas, which are short and end in the middle.
FIELDS = "(select doc_id, 'context' as field, trim(coalesce(text, ''), ' ') as t from documents union all select doc_id, 'practice', trim(split_part(coalesce(text, ''), ',', 1) || ',', ' ') from documents union all select doc_id, 'standard', trim(string_split(coalesce(text, ''), ' ')[1], ' ') from documents)"


@query("select doc_id, field, case when t = '' then [] else list_filter([" + ", ".join(f"case when {c} then '{n}' end" for n, c in FLAGS.items()) + f"], lambda f: f is not null) end as flags from {FIELDS}")
def quality_flags(spark, d):
    """All flags of three kinds of fields: whole texts, pieces that end in a comma, first words."""
    text = F.coalesce("text", F.lit(""))
    fields = {"context": text, "practice": F.concat(F.split_part(text, F.lit(","), F.lit(1)), F.lit(",")), "standard": F.get(F.split(text, " "), 0)}
    rows = [F.struct(F.lit(n).alias("field"), T.quality_flags(n, c).alias("flags")) for n, c in fields.items()]
    return table(spark, d, "documents").select("doc_id", F.explode(F.array(*rows)).alias("r")).select("doc_id", "r.*")


@query("select doc_id, list_filter(list_filter(list_transform(string_split_regex(text, '[。！？；;\\n.!?]'), lambda s: trim(s)), lambda s: s <> ''), lambda s: contains(s, 'license') or contains(s, 'License'))[1:2] as evidence from documents where contains(text, 'icense')")
def sentence_evidence(spark, d):
    """The first sentences that hold a keyword."""
    e = T.evidence_sentences(F.col("text"), F.array(F.lit("license"), F.lit("License")))
    return table(spark, d, "documents").where(F.contains("text", F.lit("icense"))).select("doc_id", e.alias("evidence"))


@query("select case when n_chars >= 2400 then 'high' when n_chars >= 1000 then 'medium' else 'low' end as band, count(*) as n, cast(min(n_chars) as bigint) as low, max(n_chars) as high from documents group by 1")
def confidence_bands(spark, d):
    """Bands with their ranges."""
    c = F.col("n_chars")
    return table(spark, d, "documents").groupBy(F.when(c >= 2400, "high").when(c >= 1000, "medium").otherwise("low").alias("band")).agg(F.count("*").alias("n"), F.min(c).alias("low"), F.max(c).alias("high"))


@query("select p_brand, count(distinct p_type || '|' || p_size) as signatures, count(*) as n, bool_and(p_retailprice > 0) as complete from part group by 1")
def signature_distinctness(spark, d):
    """distinct signatures per group."""
    return table(spark, d, "part").groupBy("p_brand").agg(F.count_distinct(F.concat_ws("|", "p_type", F.col("p_size").cast("string"))).alias("signatures"), F.count("*").alias("n"), F.bool_and(F.col("p_retailprice") > 0).alias("complete"))


@query("with r as (select * from (values ('license', 'legal'), ('token', 'secret'), ('idiot', 'toxic')) v(word, skill)), h as (select doc_id, skill, (length(lower(text)) - length(replace(lower(text), word, ''))) // length(word) as n from documents, r where contains(lower(text), word)) select doc_id, skill, n from (select *, row_number() over (partition by doc_id order by n desc, skill) as k from h) where k = 1")
def skill_tagging(spark, d):
    """Rules tag texts, the most frequent wins."""
    rules = F.array(*[F.struct(F.lit(w).alias("word"), F.lit(s).alias("skill")) for w, s in (("license", "legal"), ("token", "secret"), ("idiot", "toxic"))])
    t = F.lower(F.col("text"))
    hits = F.filter(F.transform(rules, lambda r: F.struct(F.floor((F.length(t) - F.length(F.replace(t, r["word"], F.lit("")))) / F.length(r["word"])).alias("n"), r["skill"].alias("skill"))), lambda h: h["n"] > 0)
    best = F.array_sort(F.transform(hits, lambda h: F.struct((-h["n"]).alias("minus"), h["skill"].alias("skill"))))[0]
    return table(spark, d, "documents").where(F.size(hits) > 0).select("doc_id", best["skill"].alias("skill"), (-best["minus"]).alias("n"))
