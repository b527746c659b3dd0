"""Queries on what a request asks for, tokenizers and codes (families C, D, J, N)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from ..functions import text as T
from ..functions import tokens as K
from ..functions import understanding as U
from ..operators.classes import once as _once
from .registry import query
from .tables import table

# Requests made of the columns of part: a band, a subject, an exclusion, a topic and filler.
BAND = ["", "三年级", "第一学段", "五六年级", "初二", "G1-2 ", "九年级", "小学二年级"]
SUBJECT = ["", "数学", "科学", "语文和英语", "信息技术 ", "history ", "道法"]
EXCEPT = ["", "，除了科学以外", "，不要英语", "，数学之外", "，非历史内容", " ma-h1-alg-001 "]
TOPIC = ["的分数运算", "，查找批判性思维相关的内容", " 协作与表达", "光合作用实验设计", "，请帮我寻找古诗词鉴赏", " data ", ""]


def sql_list(values) -> str:
    return "[" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + "]"


REQUEST = (
    f"(select p_partkey as id, {sql_list(BAND)}[1 + p_size % 8] || {sql_list(SUBJECT)}[1 + p_partkey % 7] || {sql_list(EXCEPT)}[1 + (p_partkey * 3 + p_size) % 6]"
    f" || {sql_list(TOPIC)}[1 + (p_partkey // 7) % 7] || ' ' || p_name as q, p_size, p_type from part)"
)


def requests(spark, d):
    pick = lambda values, n: F.element_at(U.strings(values), (n % len(values) + 1).cast("int"))
    key, size = F.col("p_partkey"), F.col("p_size")
    q = F.concat(pick(BAND, size), pick(SUBJECT, key), pick(EXCEPT, key * 3 + size), pick(TOPIC, F.floor(key / 7)), F.lit(" "), "p_name")
    return table(spark, d, "part").select(key.alias("id"), q.alias("q"), "p_size", "p_type")


# The same functions in SQL.
def sql_mentions(t, words):
    return "(" + " or ".join(f"contains(lower({t}), '{w.lower()}')" for w in words) + ")"


def sql_excluded(t, words):
    return "(" + " or ".join(f"(contains(lower({t}), '{w.lower()}') and regexp_matches({t}, '{U.excluding(w)}'))" for w in words) + ")"


def sql_named(found):
    return "list_filter([" + ", ".join(f"case when {c} then '{n}' end" for n, c in found.items()) + "], lambda z: z is not null)"


def sql_subjects(t):
    return sql_named({s: f"{sql_mentions(t, w)} and not {sql_excluded(t, w)}" for s, w in U.SUBJECT_ALIASES.items()})


def sql_gone(t):
    return sql_named({s: sql_excluded(t, w) for s, w in U.SUBJECT_ALIASES.items()})


def sql_bands(t):
    return sql_named({b: f"regexp_matches({t}, '{p}')" for p, b in U.GRADE_PATTERNS})


def sql_skills(t):
    return sql_named({s: sql_mentions(t, w) for s, w in U.SKILL_ALIASES.items()})


def sql_strip(t):
    out = f"regexp_replace(lower({t}), '\\b[a-z]{{2,8}}(?:-[a-z0-9]{{1,12}}){{2,}}\\b', ' ', 'g')"
    for p, _ in U.GRADE_PATTERNS:
        out = f"regexp_replace({out}, '{p}', ' ', 'g')"
    for a in U.longest_first([a for w in U.SUBJECT_ALIASES.values() for a in w]):
        out = f"regexp_replace({out}, '\\b{a}\\b', ' ', 'g')" if a.isascii() else f"replace({out}, '{a}', ' ')"
    out = f"list_reduce(list_prepend({out}, {sql_list(U.longest_first(U.SCAFFOLDING))}), lambda acc, w: replace(acc, w, ' '))"
    return f"trim(regexp_replace({out}, '\\s+', ' ', 'g'))"


SEP = T.SEPARATORS.replace("'", "''")


def sql_first(values):
    """Each value once, where it stands first."""
    return f"list_filter({values}, lambda v, i: list_position({values}, v) = i)"


def sql_terms(t, stop):
    return f"list_filter(string_split_regex(trim(lower({t})), '{SEP}'), lambda w: length(w) >= 2 and not list_contains({sql_list(stop)}, w))"


def sql_topic(t):
    pairs = "list_filter(list_transform(generate_series(1, length(w) - 1, 2), lambda i: substr(w, i, 2)), lambda p: length(p) >= 2 and not list_contains({s}, p))".format(s=sql_list(T.TOPIC_STOP_WORDS))
    return f"flatten(list_transform({sql_terms(t, T.TOPIC_STOP_WORDS)}, lambda w: [w] || case when regexp_full_match(w, '[一-鿿]{{4,}}') then {pairs} else [] end))"


@query(f"select id, {sql_subjects('q')} as subjects, {sql_gone('q')} as excluded, {sql_bands('q')} as bands, {sql_skills('q')} as skills from {REQUEST}")
def query_intent(spark, d):
    """Subjects asked for and excluded, bands and skills of a request."""
    q = F.col("q")
    asked, gone = U.subjects_of(q)
    return requests(spark, d).select("id", asked.alias("subjects"), gone.alias("excluded"), U.bands_of(q).alias("bands"), U.skills_of(q).alias("skills"))


@query(f"with s as (select id, {sql_strip('q')} as topic from {REQUEST}), t as (select id, topic, {sql_topic('topic')} as w from s) select id, topic, {sql_first('w')}[1:24] as core from t")
def query_core_terms(spark, d):
    """What is left of a request without scaffolding, and its terms."""
    return _once(requests(spark, d).select("id", "q"), ["q"], lambda t: t.select("q", U.topic_of(F.col("q")).alias("topic")).select("q", "topic", T.topic_tokens(F.col("topic"), 24).alias("core"))).select("id", "topic", "core")


PLAN_PAIRS = "list_transform(generate_series(1, length(h) - 1), lambda i: substr(h, i, 2))"


def tokens_sql(rows: str, key: str) -> str:
    """Both token lists of rows(key, q)."""
    return (
        f"with t as (select {key}, {sql_topic('q')} as w, {sql_terms('q', T.PLAN_STOP_WORDS)} as p, regexp_replace(lower(q), '[^一-鿿]', '', 'g') as h from {rows}), u as (select *, p || {PLAN_PAIRS} as a from t)"
        f" select {key}, {sql_first('w')}[1:80] as topic, {sql_first('a')}[1:160] as plan from u"
    )


@query(tokens_sql(REQUEST, "id"))
def request_tokens(spark, d):
    """Terms with disjoint pairs, and terms with all pairs of the Han characters."""
    return _once(requests(spark, d).select("id", "q"), ["q"], lambda t: t.select("q", T.topic_tokens(F.col("q")).alias("topic"), T.plan_tokens(F.col("q")).alias("plan"))).select("id", "topic", "plan")


KEY_PAIRS = "list_transform(generate_series(1, length(regexp_replace(w, '[^一-鿿]', '', 'g')) - 1), lambda i: substr(regexp_replace(w, '[^一-鿿]', '', 'g'), i, 2))"


@query(
    f"with t as (select id, flatten(list_transform({sql_terms('q', [])}, lambda w: [w] || case when length(regexp_replace(w, '[^一-鿿]', '', 'g')) >= 4 then {KEY_PAIRS} else [] end)) as w from {REQUEST.replace('as q', 'as q')})"
    f" select id, list_filter({sql_first('w')}, lambda v: not list_contains({sql_list(T.PLAN_STOP_WORDS)}, v))[1:80] as keywords from t".replace("list_contains([], w)", "false")
)
def plan_keywords(spark, d):
    """Keywords of a plan line."""
    return requests(spark, d).select("id", U.keywords_of(F.col("q"), T.PLAN_STOP_WORDS).alias("keywords"))


EXPLICIT = "case when p_size % 5 = 0 then ['math'] when p_size % 5 = 1 then ['science', 'math', 'science'] else [] end"
MODEL = "case when p_size % 3 = 0 then ['english'] when p_size % 3 = 1 then ['math', 'history'] else [] end"


def _constrained(spark, d):
    q, none = F.col("q"), F.array().cast("array<string>")
    asked, gone = U.subjects_of(q)
    size = F.col("p_size")
    explicit = F.when(size % 5 == 0, U.strings(["math"])).when(size % 5 == 1, U.strings(["science", "math", "science"])).otherwise(none)
    model = F.when(size % 3 == 0, U.strings(["english"])).when(size % 3 == 1, U.strings(["math", "history"])).otherwise(none)
    return requests(spark, d).select("id", explicit.alias("explicit"), asked.alias("asked"), gone.alias("gone"), model.alias("model"), U.bands_of(q).alias("bands"), U.core_terms(q).alias("core"))


CONSTRAINED = f"(select id, {EXPLICIT} as explicit, {sql_subjects('q')} as asked, {sql_gone('q')} as gone, {MODEL} as model, {sql_bands('q')} as bands from {REQUEST})"


@query(
    f"with m as (select *, case when len(explicit) > 0 then explicit when len(asked) > 0 then asked else model end as vals, len(asked) > 0 and len(model) > 0 and not list_has_any(asked, model) as conflict from {CONSTRAINED})"
    f" select id, {sql_first('vals')} as value, conflict, case when conflict then case when len(explicit) > 0 then 'explicit_request_wins' else 'explicit_query_wins' end end as resolution from m"
)
def constraint_merge(spark, d):
    """An explicit request holds before the text, the text before the model; conflicts are recorded."""
    m = U.merge_constraint(F.col("explicit"), F.col("asked"), F.col("model"))
    return _constrained(spark, d).select("id", m.alias("m")).select("id", "m.value", "m.conflict", "m.resolution")


def sql_labels(c, names):
    return f"array_to_string(list_transform({c}, lambda x: coalesce(map {{{', '.join(f'{chr(39)}{k}{chr(39)}: {chr(39)}{v}{chr(39)}' for k, v in names.items())}}}[x], x)), '、')"


HUMAN = (
    f"list_filter([case when len(bands) > 0 then {sql_labels('bands', U.BAND_LABELS)} end, case when len(asked) > 0 then '学科为' || {sql_labels('asked', U.SUBJECT_LABELS)} end,"
    f" case when len(gone) > 0 then '排除' || {sql_labels('gone', U.SUBJECT_LABELS)} end], lambda z: z is not null)"
)


@query(f"select id, case when len({HUMAN}) > 0 then '我理解你要查找' || array_to_string({HUMAN}, '，') || '的课程标准。' else '我会根据你的自然语言描述查找课程标准。' end as sentence from {CONSTRAINED}")
def constraint_sentence(spark, d):
    """The constraints of a request as a sentence."""
    none = F.array().cast("array<string>")
    return _constrained(spark, d).select("id", U.humanized(F.col("bands"), F.col("asked"), F.col("gone"), none).alias("sentence"))


TERMS = "string_split(lower(p_type), ' ') || [substr(lower(p_type), 1, 4)] || case when p_size % 2 = 0 then ['数据分析'] else ['合作'] end || case when p_size % 7 = 0 then ['责任'] else [] end"
OWN = "case p_size % 4 when 0 then ['TS1', 'TS6'] when 1 then ['TS4'] when 2 then [] else ['TS7', 'TS2'] end"
SQL_INFERRED = sql_named({s: f"list_bool_or(list_transform({sql_list(w)}, lambda a: list_bool_or(list_transform(terms, lambda t: contains(a, t) or contains(t, a)))))" for s, w in U.SKILL_ALIASES.items()})


def _terms(spark, d):
    size, none = F.col("p_size"), F.array().cast("array<string>")
    kind = F.lower("p_type")
    found = F.concat(F.split(kind, " "), F.array(F.substring(kind, 1, 4)), F.when(size % 2 == 0, U.strings(["数据分析"])).otherwise(U.strings(["合作"])), F.when(size % 7 == 0, U.strings(["责任"])).otherwise(none))
    own = F.when(size % 4 == 0, U.strings(["TS1", "TS6"])).when(size % 4 == 1, U.strings(["TS4"])).when(size % 4 == 2, none).otherwise(U.strings(["TS7", "TS2"]))
    return table(spark, d, "part").select(F.col("p_partkey").alias("id"), found.alias("terms"), own.alias("own"), F.split(F.lower("p_name"), " ").alias("core"))


@query(f"with t as (select p_partkey as id, {TERMS} as terms, {OWN} as own from part), i as (select *, {SQL_INFERRED} as skills from t) select id, skills, case when len(own) = 0 or len(skills) = 0 then 0.0::double else len(list_filter(skills, lambda s: list_contains(own, s)))::double / len(skills) end as overlap from i")
def skill_inference(spark, d):
    """Skills that the terms hint at, and the share of them that a record has."""
    return _terms(spark, d).select("id", U.inferred_skills(F.col("terms")).alias("skills"), U.skill_overlap(F.col("terms"), F.col("own")).alias("overlap"))


@query(
    f"with t as (select p_partkey as id, {TERMS} || string_split(lower(p_name), ' ') || [lower(p_name)] as terms, string_split(lower(p_name), ' ') as core from part)"
    f" select id, list_filter({sql_first('terms')}, lambda t: not list_contains(core, t) and list_bool_or(list_transform(core, lambda c: contains(t, c) or contains(c, t))))[1:60] as kept from t"
)
def expansion_anchor(spark, d):
    """Expansion terms that hold on to a core term."""
    more = F.concat("terms", "core", F.array(F.array_join("core", " ")))
    return _terms(spark, d).select("id", U.anchored(more, F.col("core")).alias("kept"))


LABEL = ["七年级上册", "第3单元", "三年级", "十二", "Grade 6", "二十一", "H2", "八", "10", "十"]


def _labels(spark, d):
    return table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.element_at(U.strings(LABEL), (F.col("p_partkey") % len(LABEL) + 1).cast("int")).alias("label"), "p_brand", "p_size", "p_type")


SQL_LABEL = f"(select p_partkey as id, {sql_list(LABEL)}[1 + p_partkey % {len(LABEL)}] as label, p_brand, p_size, p_type from part)"
SQL_NUMBER = "case when regexp_matches(label, '[0-9]') then cast(regexp_extract(label, '[0-9]+') as bigint) " + " ".join(f"when contains(label, '{c}') then {n}" for n, c in enumerate(U.DIGITS, 1)) + " end"
SQL_ORDINAL = (
    f"case when regexp_full_match(label, '[0-9]{{1,9}}') then cast(label as integer) when regexp_full_match(label, '[{U.DIGITS}]?十[{U.DIGITS}]?')"
    f" then (case when label[1] = '十' then 1 else instr('{U.DIGITS}', label[1]) end) * 10 + (case when label[-1] = '十' then 0 else instr('{U.DIGITS}', label[-1]) end)"
    f" when regexp_full_match(label, '[{U.DIGITS}]') then instr('{U.DIGITS}', label) end"
)


@query(f"with n as (select id, {SQL_NUMBER} as number, cast({SQL_ORDINAL} as integer) as ordinal from {SQL_LABEL}) select id, cast(number as bigint) as number, ordinal, case when number = 0 then null when number <= 2 then 'H1' when number <= 4 then 'H2' when number <= 6 then 'H3' when number <= 9 then 'H4G' || number end as band from n")
def number_and_band(spark, d):
    """The first number of a label, its band, and Chinese ordinals."""
    c = F.col("label")
    return _labels(spark, d).select("id", U.first_number(c).alias("number"), U.ordinal_of(c).cast("int").alias("ordinal"), U.band_of(c).alias("band"))


CODE = "substr(p_brand, 1, 2) || '-H' || (p_size % 4) || '-' || upper(substr(p_type, 1, 3)) || '-' || case when p_size % 3 = 0 then 'x' else '' end || lpad((p_partkey % 1000)::varchar, 3, '0') || case when p_size % 11 = 0 then '-9' else '' end"


@query(f"with c as (select p_partkey as id, string_split({CODE}, '-') as p from part) select id, p[1] as subject, p[2] as stage, p[3] as domain, case when regexp_full_match(p[-1], '[0-9]{{3}}') then p[-1] end as sequence, len(p) = 4 and regexp_full_match(p[-1], '[0-9]{{3}}') as canonical from c")
def code_parse(spark, d):
    """The parts of a code."""
    size = F.col("p_size")
    code = F.concat(F.substring("p_brand", 1, 2), F.lit("-H"), (size % 4).cast("string"), F.lit("-"), F.upper(F.substring("p_type", 1, 3)), F.lit("-"), F.when(size % 3 == 0, "x").otherwise(""), F.lpad((F.col("p_partkey") % 1000).cast("string"), 3, "0"), F.when(size % 11 == 0, "-9").otherwise(""))
    return table(spark, d, "part").select(F.col("p_partkey").alias("id"), U.code_parts(code).alias("c")).select("id", "c.*")


@query(
    "with r as (select o_orderkey, string_agg(case when l_linenumber % 2 = 0 then ' ' else '' end || 'c' || l_suppkey, '|' order by l_linenumber, 'c' || l_suppkey) as refs from orders join lineitem on l_orderkey = o_orderkey group by 1),"
    " t as (select o_orderkey, unnest(string_split(refs, '|')) as tok, generate_subscripts(string_split(refs, '|'), 1) as pos from r), m as (select 'c' || s_suppkey as old, 's' || s_nationkey || '-' || s_suppkey as new from supplier where s_acctbal > 0)"
    " select o_orderkey, string_agg(case when new is null then tok else replace(tok, trim(tok), new) end, '|' order by pos) as refs from t left join m on trim(tok) = old group by 1"
)
def rewrite_references(spark, d):
    """The codes in a list rewritten through a map of codes, delimiters and spaces kept."""
    line = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), "l_linenumber", F.concat(F.when(F.col("l_linenumber") % 2 == 0, " ").otherwise(""), F.lit("c"), F.col("l_suppkey").cast("string")).alias("tok"))
    refs = line.groupBy("o_orderkey").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("l_linenumber", "tok"))), lambda x: x["tok"]), "|").alias("refs"))
    codes = table(spark, d, "supplier").where("s_acctbal > 0").select(F.concat(F.lit("c"), F.col("s_suppkey").cast("string")).alias("old"), F.concat(F.lit("s"), F.col("s_nationkey").cast("string"), F.lit("-"), F.col("s_suppkey").cast("string")).alias("new"))
    return K.rewrite_codes(refs, "o_orderkey", "refs", codes, "old", "new")


PHRASE = ["二元一次方程与学习", "第三章 光合作用", "Unit 5 Reading and writing", "活动：古诗词鉴赏的方法", "1.2 三角形（全等）", "自己的身体 body-part", "三维图形", "目录"]


def _phrases(spark, d):
    at = lambda n: F.element_at(U.strings(PHRASE), (n % len(PHRASE) + 1).cast("int"))
    return table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.concat(at(F.col("p_partkey")), F.lit(" "), F.lower("p_type")).alias("phrase"), F.concat(at(F.col("p_size")), F.lit(" "), "p_name").alias("other"))


SQL_PHRASE = f"(select p_partkey as id, {sql_list(PHRASE)}[1 + p_partkey % {len(PHRASE)}] || ' ' || lower(p_type) as phrase, {sql_list(PHRASE)}[1 + p_size % {len(PHRASE)}] || ' ' || p_name as other from part)"
NORMAL = "trim(regexp_replace(regexp_replace(regexp_replace(lower({t}), '[，。！？；：、“”‘’（）《》【】]', ' ', 'g'), '[^\\p{{L}}\\p{{N}}]+', ' ', 'g'), '\\s+', ' ', 'g'))"


def sql_grams(w, low, high):
    return "flatten([" + ", ".join(f"list_transform(generate_series(1, length({w}) - {n - 1}), lambda i: substr({w}, i, {n}))" for n in range(low, high + 1)) + "])"


def sql_match_tokens(t):
    keep = f"length(v) >= 2 and not list_contains({sql_list(K.MATCH_STOP)}, v) and not list_contains({sql_list(K.WEAK_EDGES)}, v[1]) and not list_contains({sql_list(K.WEAK_EDGES)}, v[-1])"
    return f"list_sort(list_distinct(list_filter(flatten(list_transform(list_filter(string_split({NORMAL.format(t=t)}, ' '), lambda w: not regexp_full_match(w, '[0-9]*')), lambda w: [w] || case when regexp_matches(w, '\\p{{Han}}') then {sql_grams('w', 2, 4)} else [] end)), lambda v: {keep})))"


HEAD = "regexp_replace(lower({t}), '^(?:第[一二三四五六七八九十百0-9]+[章节课单元]|(?:starter\\s+)?unit\\s+[a-z]?[0-9]+|module\\s+[a-z]?[0-9]+|[0-9]+(?:\\.[0-9]+)*)\\s*', '')"


def sql_align_tokens(t):
    body = f"trim(regexp_replace(regexp_replace({HEAD.format(t=t)}, '[^\\p{{L}}\\p{{N}}]+', ' ', 'g'), '\\s+', ' ', 'g'))"
    return f"list_sort(list_distinct(flatten(list_transform(list_filter(string_split({body}, ' '), lambda w: not regexp_full_match(w, '[0-9]*')), lambda w: case when regexp_matches(w, '\\p{{Han}}') then list_filter({sql_grams('w', 2, 6)}, lambda g: not list_contains({sql_list(K.ALIGN_STOP)}, g)) when length(w) >= 3 and not list_contains({sql_list(K.ALIGN_STOP)}, w) then [w] else [] end))))"


def sql_content_grams(t):
    body = f"replace({NORMAL.format(t=t)}, ' ', '')"
    return f"list_sort(list_distinct(list_filter(regexp_extract_all({NORMAL.format(t=t)}, '[a-z][a-z0-9-]{{2,}}') || list_filter({sql_grams(body, 2, 5)}, lambda g: not regexp_full_match(g, '[0-9]+')), lambda g: not list_contains({sql_list(K.GRAM_STOP)}, g))))"


@query(f"select id, {sql_match_tokens('phrase')} as match_tokens from {SQL_PHRASE}")
def match_tokens(spark, d):
    """Parts and their 2- to 4-grams, without stop tokens and weak edges, of a normalised text."""
    return _phrases(spark, d).select("id", F.sort_array(K.match_tokens(F.col("phrase"))).alias("match_tokens"))


@query(f"select id, {sql_align_tokens('phrase')} as align_tokens from {SQL_PHRASE}")
def align_tokens(spark, d):
    """2- to 6-grams of Han parts and longer words, after a heading's number is gone."""
    return _phrases(spark, d).select("id", F.sort_array(K.align_tokens(F.col("phrase"))).alias("align_tokens"))


@query(f"select id, {sql_content_grams('phrase')} as grams from {SQL_PHRASE}")
def content_grams(spark, d):
    """Latin words and 2- to 5-grams without stop grams."""
    return _once(_phrases(spark, d), ["phrase"], lambda t: t.select("phrase", F.sort_array(K.content_grams(F.col("phrase"))).alias("grams"))).select("id", "grams")


STOP_PHRASES = "|".join(K.STOP_PHRASES)


@query(f"with s as (select id, regexp_replace(regexp_replace(phrase, '{STOP_PHRASES}', '', 'g'), '[^\\p{{L}}\\p{{N}}]', '', 'g') as s from {SQL_PHRASE}) select id, list_sort(list_distinct(list_transform(generate_series(1, length(s) - 1), lambda i: substr(s, i, 2)))) as pairs from s")
def stop_phrase_bigrams(spark, d):
    """Pairs of a text without stop phrases."""
    return _phrases(spark, d).select("id", F.sort_array(K.stop_phrase_pairs(F.col("phrase"))).alias("pairs"))


@query(f"select id, regexp_extract_all(lower(phrase), '[一-鿿]{{2,}}|[a-z0-9_.-]+') as tokens, cast(len(regexp_extract_all(phrase, '\\p{{Han}}')) as integer) as han, replace(url_encode(lower(trim(phrase))), '%20', '+') as part, case when length(phrase) > 12 then substr(phrase, 1, 12) || '…' else phrase end as excerpt from {SQL_PHRASE}")
def simple_text(spark, d):
    """Plain tokens, number of Han characters, a part of an id, an excerpt."""
    c = F.col("phrase")
    return _phrases(spark, d).select("id", K.plain_tokens(c).alias("tokens"), F.regexp_count(c, F.lit(r"\p{IsHan}")).alias("han"), F.url_encode(F.lower(F.trim(c))).alias("part"), K.excerpt(c, 12).alias("excerpt"))


@query(
    f"select id, case when trim(phrase) = '' or contains(phrase, '目录') then 'noise' when regexp_matches(phrase, '^(?:第[一二三四五六七八九十百0-9]+[章节课单元]|Unit\\s+[0-9]+|[0-9]+(?:\\.[0-9]+)+)') then 'heading' when regexp_matches(phrase, '^(?:学习目标|目标|活动|练习|习题)') then 'task' else 'body' end as kind,"
    f" list_filter(list_transform(string_split_regex(replace(phrase, ' ', ''), '[与和及、，,/（）()的]'), lambda x: trim(x)), lambda x: length(x) >= 2) as anchors from {SQL_PHRASE}"
)
def headings_and_anchors(spark, d):
    """Noise, headings and tasks; the parts of a label that anchor it."""
    c = F.col("phrase")
    return _phrases(spark, d).select("id", K.line_kind(c).alias("kind"), K.anchors(c).alias("anchors"))


FAMILIES = " or ".join(f"(len({a}) > 0 and len({b}) > 0 and not list_has_any({a}, {b}))" for a, b in ((f"regexp_extract_all(phrase, '[一二三]{x}')", f"regexp_extract_all(other, '[一二三]{x}')") for x in "元次维"))


@query(f"select id, {FAMILIES} as conflict, contains(lower(replace(other, '—', '-')), lower(substr(phrase, 1, 4))) as evident from {SQL_PHRASE}")
def modifier_conflicts(spark, d):
    """Numeric modifiers of which two texts share none; whether a span stands in its source."""
    return _phrases(spark, d).select("id", K.modifiers_conflict(F.col("phrase"), F.col("other")).alias("conflict"), K.evident(F.substring("phrase", 1, 4), F.col("other")).alias("evident"))


@query(
    f"with c as (select id, unnest(list_filter(list_transform(string_split_regex(phrase, '[，。；;：:]|与|并'), lambda x: trim(x)), lambda x: x <> '')) as clause, generate_subscripts(list_filter(list_transform(string_split_regex(phrase, '[，。；;：:]|与|并'), lambda x: trim(x)), lambda x: x <> ''), 1) as no from {SQL_PHRASE})"
    " select id, cast(no as integer) as no, clause, case when regexp_matches(clause, '方程|图形|三角形') then 'concept' when regexp_matches(clause, '实验|鉴赏|reading|writing|Reading') then 'practice' else 'knowledge' end as kind from c"
)
def clauses(spark, d):
    """Plain clauses of a text and the kind of component each is (J25 with borrowed objects: borrowed_objects)."""
    return K.clauses(_phrases(spark, d), "id", "phrase")


@query(f"select id, '(' || array_to_string(list_transform({sql_subjects('q')}, lambda s: 'subject_slug = \"' || s || '\"'), ' OR ') || ')' as filter from {REQUEST} where len({sql_subjects('q')}) > 0")
def filter_string(spark, d):
    """A group of alternatives as a quoted filter string."""
    asked, _ = U.subjects_of(F.col("q"))
    return _once(requests(spark, d).select("id", "q"), ["q"], lambda t: t.withColumn("asked", asked).where(F.size("asked") > 0).select("q", K.filter_group("subject_slug", F.col("asked")).alias("filter"))).select("id", "filter")


TOC = "phrase || ' …… ' || translate(((id % 90) + 1)::varchar, '0123456789', '０１２３４５６７８９')"


@query(f"with l as (select id, translate({TOC}, '０１２３４５６７８９', '0123456789') as line from {SQL_PHRASE}) select id, trim(regexp_replace(line, '[.…·]{{2,}}\\s*[0-9]+$', '')) as title, cast(regexp_extract(line, '[.…·]{{2,}}\\s*([0-9]+)$', 1) as integer) as page from l")
def toc_lines(spark, d):
    """Lines of a table of contents: full-width digits, leader dots and page tails."""
    wide = F.translate(((F.col("id") % 90) + 1).cast("string"), "0123456789", "０１２３４５６７８９")
    return K.toc_line(_phrases(spark, d).select("id", F.concat("phrase", F.lit(" …… "), wide).alias("line")), "id", "line")


SKILL_RULES = {"TS1": ["the", "and"], "TS2": ["new", "ung"], "TS3": ["self", "ich"], "TS4": ["with", "ensemble"], "TS5": ["que", "wort"], "TS6": ["data", "tion"], "TS7": ["world", "ment"]}
SKILL_HITS = "[" + ", ".join("{'minus': -(" + " + ".join(f"(length(t) - length(replace(t, '{w}', ''))) // {len(w)}" for w in words) + f"), 'skill': '{k}'}}" for k, words in SKILL_RULES.items()) + "]"


@query(f"with d as (select doc_id, lower(coalesce(text, '')) as t from documents), h as (select doc_id, list_transform(list_sort(list_filter({SKILL_HITS}, lambda x: x.minus < 0)), lambda x: x.skill) as s from d) select doc_id, coalesce(s[1], 'TS1') as primary_skill, s[2:3] as secondary from h")
def skill_ranks(spark, d):
    """The skill with the most keywords, the next two as secondary, TS1 where there is none."""
    docs = table(spark, d, "documents").select("doc_id", F.lower(F.coalesce("text", F.lit(""))).alias("t"))
    found = K.ranked_rules(F.col("t"), SKILL_RULES)
    return docs.select("doc_id", found.alias("s")).select("doc_id", F.coalesce(F.get("s", F.lit(0)), F.lit("TS1")).alias("primary_skill"), F.slice("s", 2, 2).alias("secondary"))


CASES = {"units": "方程|次|元", "reading": "(?i)reading|诗词", "body": "身体|body", "space": "三角形|图形", "process": "光合作用|过程", "long": "^.{24,}$", "numbered": "^[0-9]", "chapter": "^第", "activity": "活动", "mixed": "[a-z].*[一-鿿]|[一-鿿].*[a-z]"}


@query(f"with c as (select id, list_filter([{', '.join(f'case when regexp_matches(phrase, {chr(39)}{p}{chr(39)}) then {chr(39)}{n}{chr(39)} end' for n, p in CASES.items())}], lambda x: x is not null) as cases from {SQL_PHRASE}) select id, case when len(cases) = 0 then ['default'] else cases end as cases, len(cases) >= 4 as hardest from c")
def difficulty_cases(spark, d):
    """Patterns to named cases, with a default (N21 itself: hard_cases, learner_difficulties; N13: cue_matches)."""
    found = U.named({n: F.col("phrase").rlike(p) for n, p in CASES.items()})
    return _phrases(spark, d).select("id", found.alias("f")).select("id", F.when(F.size("f") == 0, U.strings(["default"])).otherwise(F.col("f")).alias("cases"), (F.size("f") >= 4).alias("hardest"))
