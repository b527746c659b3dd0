"""Queries on the clauses of statements and on the rules that they meet (families J and N)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import understanding as U
from ..operators import clauses as C
from ..operators import demands as D
from .registry import query
from .tables import table
from .understanding import sql_list

# Statements made of the columns of part.
OPENING = ["能够", "学生能初步", "学习要求：能", "在真实情境中，能", "通过实验，", "围绕主题", "", "（选学）。", "结合生活"]
FIRST = ["理解并掌握", "比较", "观察，并记录", "独立完成", "阅读", "说明书以及", "认识", "先分析再判断"]
THEN = ["，并能说明理由", "，解释；判断", "并且写出不少于300字的短文", "。感知", "；在活动中，合理设计", "，用于生活", "", "，能以及掌握", "，每周至少练习3—5次", "，运用模型。理解"]


def _statements(spark, d):
    at = lambda values, n: F.element_at(U.strings(values), (n % len(values) + 1).cast("int"))
    key, size = F.col("p_partkey"), F.col("p_size")
    return table(spark, d, "part").select(key.alias("id"), F.concat(at(OPENING, key), at(FIRST, size), "p_name", at(THEN, key * 3 + size), F.lit("，"), at(FIRST, F.floor(key / 5)), at(THEN, F.floor(key / 7))).alias("text"))


VERB, ABLE = C.VERB, C.ABLE
NL = "' || chr(10) || '"
HEADS = f"^(?:(?:[，,；;。\\s]+)?(?:{C.LEARNER}\\s*)?(?:(?:{ABLE})\\s*)?(?:(?:{C.JOINED})\\s*)?){{3}}"


def compact(t):
    return f"trim(regexp_replace({t}, '\\s+', ' ', 'g'))"


def label(t):
    return f"trim(regexp_replace(regexp_replace({compact(t)}, '[，,；;。\\s]+$', ''), '{HEADS}', ''))"


def thing(t):
    return f"trim(regexp_replace(regexp_extract(regexp_replace(regexp_replace({compact(t)}, '^(?:{C.OBJECT_ADVERBS})\\s*', ''), '^(?:{VERB})', ''), '^[^，,；;]*'), '{C.PURPOSE}', ''))"


def acts(t):
    return f"regexp_matches(regexp_replace({label(t)}, '^(?:{C.ACTION_ADVERBS})\\s*', ''), '^(?:{VERB})')"


NOTE = "'^[（(].*[）)]$'"
KIND = " ".join(f"when regexp_matches(label, '{p}') then '{k}'" for k, p in C.KINDS.items())
TEXT = f"(select p_partkey as id, {sql_list(OPENING)}[1 + p_partkey % {len(OPENING)}] || {sql_list(FIRST)}[1 + p_size % {len(FIRST)}] || p_name || {sql_list(THEN)}[1 + (p_partkey * 3 + p_size) % {len(THEN)}] || '，' || {sql_list(FIRST)}[1 + (p_partkey // 5) % {len(FIRST)}] || {sql_list(THEN)}[1 + (p_partkey // 7) % {len(THEN)}] as text from part)"
SQL = (
    f" t0 as (select id, {compact('text')} as body from {TEXT}),"
    f" t1 as (select id, case when regexp_matches(regexp_extract(body, '^[^：:]{{2,18}}[：:]\\s*(.+)$', 1), '{VERB}') then regexp_extract(body, '^[^：:]{{2,18}}[：:]\\s*(.+)$', 1) else body end as whole, body from t0),"
    " s0 as (select id, whole, trim(unnest(string_split_regex(whole, '[；;。]+'))) as sentence, generate_subscripts(string_split_regex(whole, '[；;。]+'), 1) as s from t1),"
    f" s1 as (select id, whole, s, string_split(regexp_replace(regexp_replace(sentence, '，((?:并|且|同时|还要)?(?:{ABLE}|{VERB}))', chr(1) || '\\1', 'g'), '(?:并且|并|且|以及)((?:{ABLE})?(?:{VERB}))', chr(1) || '\\1', 'g'), chr(1)) as list from s0 where sentence <> '' and not regexp_matches(sentence, {NOTE})),"
    " p0 as (select id, whole, s, unnest(list) as piece, generate_subscripts(list, 1) as p from s1),"
    f" p1 as (select *, {label('piece')} as raw from p0 where not regexp_matches({compact('piece')}, '^(?:{ABLE})\\s*以及')),"
    f" p2 as (select *, regexp_extract(raw, '{C.SETTING}', 1) as setting, regexp_extract(raw, '{C.SETTING}', 2) as behind from p1),"
    f" p3 as (select *, setting <> '' and {acts('behind')} as led from p2),"
    f" p4 as (select *, case when led then {label('behind')} else raw end as part from p3),"
    f" p5 as (select *, (regexp_matches(part, '{C.CONDITION_END}') and not {acts('part')}) or (regexp_matches(part, '^(?:{C.METHOD})') and not regexp_matches(part, '{VERB}')) as stands from p4),"
    " p6 as (select *, coalesce(last_value(case when stands then part when led then setting end ignore nulls) over (partition by id, s order by p rows between unbounded preceding and current row), '') as condition from p5),"
    f" p7 as (select id, any_value(whole) as whole, part, condition, min((s, p)) as place from p6 where not stands and not regexp_matches(part, '{C.LEFTOVER}') and not regexp_matches(part, {NOTE}) and length(part) >= 2 group by id, part, condition),"
    " p8 as (select *, row_number() over (partition by id order by place) as no, lead(part) over (partition by id order by place) as following from p7),"
    f" p9 as (select *, regexp_matches(part, '{C.BARE}') and length({thing('following')}) >= 2 as takes, case when condition <> '' then condition || '，' else '' end as before from p8),"
    f" q0 as (select *, case when takes then part || {thing('following')} else part end as first_label, {compact('''before || case when takes then part || '并' || following else part end''')} as src from p9),"
    f" q1 as (select *, {thing('first_label')} as object from q0),"
    f" q2 as (select *, regexp_matches(first_label, '{C.BARE}') as needs, (select y.object from q1 y where y.id = q1.id and y.no < q1.no and length(y.object) >= 3 and not regexp_matches(y.object, '{C.BARE}') order by y.no desc limit 1) as kept from q1),"
    " q3 as (select id, no, case when needs and kept is not null then first_label || kept else first_label end as label, condition, case when needs and kept is not null then whole else src end as source from q2"
    f" union all select id, 1, {label('whole')}, '', {label('whole')} from t1 where id not in (select id from q2)),"
    f" c as (select id, no::integer as no, label, condition, source, case {KIND} else 'conceptual' end as kind from q3)"
)


@query("with" + SQL + " select * from c")
def borrowed_objects(spark, d):
    """Clauses of statements with their conditions, the objects that verbs alone borrow from their neighbours, and the kind of each."""
    return C.components(_statements(spark, d), "id", "text")


def plain(pattern):
    """The pattern without look-ahead."""
    return pattern.replace("说明(?!书|文|性)", "说明(?:[^书文性]|$)")


def sql_rules(t, rules):
    return "list_filter([" + ", ".join(f"case when regexp_matches({t}, '{plain(p)}') then '{r}' end" for r, p in rules.items()) + "], lambda x: x is not null)"


def sql_map(values):
    return "map {" + ", ".join(f"'{k}': {v}" for k, v in values.items()) + "}"


DEMANDS = {r: v[0] for r, v in D.DEMANDS.items()}
TITLES = sql_map({r: f"'{v[1]}'" for r, v in D.DEMANDS.items()} | {r: f"'{v[0]}'" for r, v in D.WHOLE.items()})
DIMENSIONS = sql_map({r: f"'{v[2]}'" for r, v in D.DEMANDS.items()} | {r: f"'{v[1]}'" for r, v in D.WHOLE.items()})
RULES = "[" + ", ".join(f"{{'n': {n}, 'rule': '{r}', 'p': '{plain(p)}'}}" for n, (r, p) in enumerate(DEMANDS.items())) + "]"
CATEGORIES = "[" + ", ".join(f"{{'n': {n}, 'rule': '{r}', 'p': '{plain(p)}'}}" for n, (r, p) in enumerate(D.DIFFICULTIES.items())) + "]"
CASES = (
    SQL + f", k as (select unnest({RULES}, recursive := true)), n as (select id, count(*) as clauses from c group by 1),"
    " k1 as (select t0.id, body, k.n, k.rule, p from t0 join k on regexp_matches(body, p)),"
    " k2 as (select id, body, rule, p, true as met, row_number() over (partition by id order by n) as no from k1 union all select t0.id, body, case when clauses > 1 then 'combined_performance' else 'independent_core_performance' end, null, false, 1 from t0 join n using (id) where id not in (select id from k1)),"
    " k3 as (select k2.id, k2.no, any_value(k2.rule) as rule, any_value(k2.p) as p, any_value(body) as body, any_value(met) as met, coalesce(list(c.no order by c.no) filter (regexp_matches(c.label, p)), list(c.no order by c.no) filter (c.no <= 3)) as components, string_agg(c.label, '；' order by c.no) filter (c.no <= 3) as heads from k2 join c on c.id = k2.id group by k2.id, k2.no),"
    f" k4 as (select *, coalesce(list_filter({sql_list(D.LIMITS)}, lambda w: contains(body, w) and regexp_matches(w, p)), []) || case when rule = 'quantitative_threshold' then list_filter(regexp_extract_all(body, '{D.QUANTITY}'), lambda x, i: list_position(regexp_extract_all(body, '{D.QUANTITY}'), x) = i) else [] end as limits from k3),"
    f" h as (select id, no::integer as no, rule, {TITLES}[rule] as title, {DIMENSIONS}[rule] as dimension, components, limits, case when len(limits) > 0 then {TITLES}[rule] || '（' || array_to_string(limits, '、') || '）' else heads end as structure, case when met then 0.7::double else 0.58::double end as confidence, 'hc_' || substr(sha256(id || '␟' || rule || '␟' || no), 1, 16) as case_id from k4)"
)


@query("with" + CASES + " select * from h")
def hard_cases(spark, d):
    """What is hard in statements, by ten rules and a default, with the clauses and the limiting words of each case."""
    s = _statements(spark, d)
    return D.cases(s, C.components(s, "id", "text"), "id", "text")


@query(
    "with" + CASES + f", g as (select unnest({CATEGORIES}, recursive := true)),"
    " g1 as (select t0.id, g.n, g.rule, p from t0 join g on regexp_matches(body, p)),"
    " g2 as (select id, rule as category, p, true as met, row_number() over (partition by id order by n) as no from g1 union all select id, 'performance_stability', null, false, 1 from t0 where id not in (select id from g1)),"
    " g3 as (select g2.id, g2.no, any_value(category) as category, any_value(met) as met, coalesce(list(c.no order by c.no) filter (regexp_matches(c.label, p)), list(c.no) filter (c.no = least(g2.no, n.clauses))) as components from g2 join c on c.id = g2.id join n on n.id = g2.id group by g2.id, g2.no),"
    " g4 as (select g3.id, g3.no, list(h.case_id order by h.no) filter (list_has_any(h.components, g3.components)) as cases from g3 join h on h.id = g3.id group by 1, 2)"
    " select g3.id, g3.no::integer as no, category, components, label as target, coalesce(cases, []) as cases, case when met then 0.66::double else 0.54::double end as confidence, 'cd_' || substr(sha256(g3.id || '␟' || category || '␟' || g3.no), 1, 16) as difficulty_id from g3 join g4 on g4.id = g3.id and g4.no = g3.no join c on c.id = g3.id and c.no = g3.components[1]"
)
def learner_difficulties(spark, d):
    """Where learners may fail, by eight rules and a default, tied to clauses and hard cases."""
    s = _statements(spark, d)
    return D.difficulties(s, C.components(s, "id", "text"), "id", "text")
