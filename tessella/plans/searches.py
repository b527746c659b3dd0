"""Search from request to answer (family N)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import understanding as U
from ..operators import search
from .registry import query
from .tables import STD, std, table
from .understanding import BAND, EXCEPT, HUMAN, SUBJECT, sql_bands, sql_first, sql_gone, sql_list, sql_strip, sql_subjects, sql_topic

SLUGS = {"de": "math", "en": "english", "es": "science", "fr": "history"}
#: Requests made of the benchmark: a band, a subject, an exclusion, and the item's first words.
_ASKED = f"(select item_id as id, {sql_list(BAND)}[1 + item_id % 8] || {sql_list(SUBJECT)}[1 + item_id % 7] || {sql_list(EXCEPT)}[1 + (item_id * 3) % 6] || ' ' || array_to_string(string_split(text, ' ')[1:4], ' ') as q, list_transform(string_split(lower(text), ' ')[1:4], lambda w: substr(w, 1, 4)) as more, case when item_id % 4 = 0 then ['english', 'math', 'english'] else [] end as own, case when item_id % 5 = 0 then 3 else 12 end as lim from benchmark)"


def _answers() -> str:
    rows = f"select code, case subject_slug when 'de' then 'math' when 'en' then 'english' when 'es' then 'science' when 'fr' then 'history' else '' end as subject, grade_band as band, lower(standard) as standard_text, lower(domain) as domain_text from {STD}"
    parsed = f"select id, lim, own, more, {sql_subjects('q')} as said, {sql_gone('q')} as gone, {sql_bands('q')} as bands, {sql_strip('q')} as topic from {_ASKED}"
    size = lambda a, b: f"(len({a}) + len({b}) * 0.45::double)"
    return (
        f"with rec as ({rows}), p as ({parsed}), t as (select *, {sql_topic('topic')} as w from p), u as (select *, {sql_first('w')}[1:24] as core from t),"
        f" req as (select id, lim, gone, bands, core, case when len(own) > 0 then {sql_first('own')} else said end as asked, (list_filter({sql_first('more')}, lambda t: not list_contains(core, t) and list_bool_or(list_transform(core, lambda c: contains(t, c) or contains(c, t)))))[1:60] as more from u),"
        " cand as (select req.id, req.lim, req.core, req.more, rec.* from rec join req on (len(asked) = 0 or list_contains(asked, subject)) and not list_contains(gone, subject) and (len(bands) = 0 or list_contains(bands, band))),"
        " h as (select *, list_filter(core, lambda t: contains(standard_text, t)) as cs, list_filter(core, lambda t: contains(domain_text, t)) as cd, list_filter(more, lambda t: contains(standard_text, t)) as ms, list_filter(more, lambda t: contains(domain_text, t)) as md from cand),"
        " g as (select *, greatest(1.0::double, least(6.0::double, len(core) + 0.45::double * len(more))) as whole, list_distinct(cs[1:8] || cd[1:8]) as ac, list_distinct(ms[1:8] || md[1:8]) as am0 from h),"
        " k as (select *, list_filter(am0, lambda t: not list_contains(ac, t)) as am, (case when standard_text <> '' then 1.0::double else 0.0::double end) as w1, (case when domain_text <> '' then 0.78::double else 0.0::double end) as w2 from g),"
        f" l as (select *, least(1.0::double, {size('cs[1:8]', 'ms[1:8]')} / whole) * w1 + least(1.0::double, {size('cd[1:8]', 'md[1:8]')} / whole) * w2 as ov, w1 + w2 as av, case when len(core) > 0 then len(ac)::double / len(core) else 0.0::double end as cc, case when len(more) > 0 then len(am)::double / len(more) else 0.0::double end as mc, case when len(cs) + len(cd) > 0 then 'direct' when len(am) > 0 then 'supporting' else 'irrelevant' end as strength from k),"
        " s as (select id, lim, code, strength, (case when cc > 0 then least(1.0::double, cc + mc * 0.15::double) else mc * 0.35::double end) * 0.45::double + (case when av = 0 then 0.0::double else least(1.0::double, ov / least(2.4::double, av)) end) * 0.3::double + (case strength when 'direct' then 1.0::double when 'supporting' then 0.55::double else 0.0::double end) * 0.18::double + 0.0::double * 0.04::double + 0.5::double * 0.03::double as score from l),"
        " r as (select *, row_number() over (partition by id order by floor(score * 10000 + 0.5) desc, code) as rank from s where strength <> 'irrelevant' and score >= 0.12),"
        " a as (select id, count(*) as relevant, count(*) filter (strength = 'direct') as direct, count(*) filter (strength = 'supporting') as supporting, list(code order by rank) filter (rank <= lim) as codes from r group by 1), n as (select id, count(*) as total from cand group by 1)"
        f" select req.id, asked as subjects, gone as excluded, bands, core, case when len({HUMAN}) > 0 then '我理解你要查找' || array_to_string({HUMAN}, '，') || '的课程标准。' else '我会根据你的自然语言描述查找课程标准。' end as sentence, coalesce(total, 0) as total_candidates, coalesce(relevant, 0) as relevant, coalesce(direct, 0) as direct, coalesce(supporting, 0) as supporting, coalesce(total, 0) - coalesce(relevant, 0) as omitted,"
        " case when coalesce(relevant, 0) = 0 then 'none' when relevant < lim then 'fewer' when relevant > lim then 'first' else 'all' end as note, coalesce(codes, []) as codes from req left join n on n.id = req.id left join a on a.id = req.id"
    )


@query(_answers())
def smart_search_answers(spark, d):
    """Every request from its text to its ranked, explained answer."""
    slug = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in SLUGS.items() for x in kv]), F.col("subject_slug")), F.lit(""))
    records = std(spark, d).select("code", slug.alias("subject"), F.col("grade_band").alias("band"), "standard", "domain")
    key, words = F.col("item_id"), F.slice(F.split("text", " "), 1, 4)
    pick = lambda values, n: F.element_at(U.strings(values), (n % len(values) + 1).cast("int"))
    q = F.concat(pick(BAND, key), pick(SUBJECT, key), pick(EXCEPT, key * 3), F.lit(" "), F.array_join(words, " "))
    more = F.transform(words, lambda w: F.substring(F.lower(w), 1, 4))
    own = F.when(key % 4 == 0, U.strings(["english", "math", "english"]))
    asked = table(spark, d, "benchmark").select(key.alias("id"), q.alias("query"), own.alias("subjects"), F.lit(None).cast("array<string>").alias("bands"), more.alias("expansion"), F.when(key % 5 == 0, 3).alias("limit"))
    return search.smart_search(records, asked, ["standard", "domain"])
