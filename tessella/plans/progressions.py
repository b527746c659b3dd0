"""Queries on progressions between records (family O)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import progression
from .registry import query
from .tables import table

_BAND = "case when p_size <= 12 then 'H1' when p_size <= 22 then 'H2' when p_size <= 32 then 'H3' when p_size <= 40 then 'H4G7' when p_size <= 45 then 'H4G8' else 'H4G9' end"
#: Parts as records: five subjects, references to neighbours of the subject, some of them unknown or to themselves.
_REC = f"(select p_partkey as code, p_partkey % 5 as subject, {_BAND} as band, p_partkey as ord, case when p_size % 3 = 0 then [(p_partkey + 5)::varchar] when p_size % 7 = 0 then ['none', ' ' || (p_partkey + 10), (p_partkey + 1)::varchar] when p_size % 11 = 0 then [p_partkey::varchar] else [] end as nxt, case when p_size % 4 = 0 then [(p_partkey - 5)::varchar] else [] end as prv from part)"
_BRIDGES = "(select p_partkey as code, 0 as pos, (p_partkey - 5)::varchar as ref, case when p_type like '%S%' then 'high' when p_size % 2 = 0 then null else 'low' end as confidence from part where p_size % 3 <> 1 union all select p_partkey, 1, (p_partkey + 15)::varchar, 'medium' from part where p_size % 5 = 0)"
_EDGES = (
    f"rec as {_REC}, br as {_BRIDGES}, refs as (select code, subject, band, ord, 0 as kind, unnest(range(len(nxt))) as pos, unnest(nxt) as ref, 'declared' as confidence from rec union all select code, subject, band, ord, 1, unnest(range(len(prv))), unnest(prv), 'declared' from rec union all select rec.code, subject, band, ord, 2, br.pos, br.ref, coalesce(br.confidence, 'low') from rec join br on br.code = rec.code where band = 'H4G7'),"
    " hit as (select refs.*, t.code as target, t.band as target_band from refs join rec t on t.subject = refs.subject and t.code::varchar = trim(refs.ref)),"
    " put as (select case when kind = 0 then code else target end as a, case when kind = 0 then target else code end as b, case when kind = 2 then 'inferred_stage_bridge' when band like 'H4%' and target_band like 'H4%' then 'grade_progression' else 'stage_progression' end as relation, confidence, (ord, kind, pos) as at_put from hit),"
    " e as (select a, b, arg_max(relation, at_put) as relation, arg_max(confidence, at_put) as confidence from put where a <> b group by 1, 2)"
)


def _records(spark, d):
    k, size, none = F.col("p_partkey"), F.col("p_size"), F.array().cast("array<string>")
    text = lambda c: c.cast("string")
    band = F.when(size <= 12, "H1").when(size <= 22, "H2").when(size <= 32, "H3").when(size <= 40, "H4G7").when(size <= 45, "H4G8").otherwise("H4G9")
    onward = F.when(size % 3 == 0, F.array(text(k + 5))).when(size % 7 == 0, F.array(F.lit("none"), F.concat(F.lit(" "), text(k + 10)), text(k + 1))).when(size % 11 == 0, F.array(text(k))).otherwise(none)
    back = F.when(size % 4 == 0, F.array(text(k - 5))).otherwise(none)
    p = table(spark, d, "part")
    records = p.select(k.alias("code"), (k % 5).alias("subject"), band.alias("band"), k.alias("ord"), onward.alias("next_refs"), back.alias("previous_refs"))
    sure = F.when(F.contains("p_type", F.lit("S")), "high").when(size % 2 == 0, F.lit(None)).otherwise("low")
    first = p.where("p_size % 3 <> 1").select(k.alias("code"), F.lit(0).alias("pos"), text(k - 5).alias("ref"), sure.alias("confidence"))
    second = p.where("p_size % 5 = 0").select(k.alias("code"), F.lit(1).alias("pos"), text(k + 15).alias("ref"), F.lit("medium").alias("confidence"))
    return records, first.unionByName(second)


@query(f"with {_EDGES} select a, b, relation, confidence from e")
def progression_edges(spark, d):
    """Edges from references to successors and predecessors and from bridges; the last put of a pair counts."""
    return progression.edges(*_records(spark, d))


@query(
    f"with recursive {_EDGES}, ways as (select a, b from e union select b, a from e), r(s, x) as (select a, b from ways union select r.s, ways.b from r join ways on ways.a = r.x), c as (select rec.code, rec.subject, rec.band, least(rec.code, coalesce(m.x, rec.code)) as component from rec left join (select s, min(x) as x from r group by 1) m on m.s = rec.code),"
    " n as (select component, min(subject) as subject, count(*) as nodes, count(*) filter (band = 'H1') as H1, count(*) filter (band = 'H2') as H2, count(*) filter (band = 'H3') as H3, count(*) filter (band = 'H4G7') as H4G7, count(*) filter (band = 'H4G8') as H4G8, count(*) filter (band = 'H4G9') as H4G9 from c group by 1),"
    " k as (select component, count(*) as edges, count(*) filter (relation = 'inferred_stage_bridge') as bridges, count(*) filter (relation = 'inferred_stage_bridge' and confidence = 'low') as bridges_low from e join c on c.code = e.a group by 1),"
    " w as (select n.*, coalesce(edges, 0) as edges, coalesce(bridges, 0) as bridges, coalesce(bridges_low, 0) as bridges_low, (select bool_or(band like 'H4%') from rec where rec.subject = n.subject) as any_h4 from n left join k using (component))"
    " select c.code, c.component, case when edges = 0 then 'not_available' when bridges > 0 then 'partial' else 'available' end as status, nodes, edges, H1, H2, H3, H4G7, H4G8, H4G9, bridges, bridges_low, list_filter([case when edges = 0 then 'no_relations' end, case when bridges_low > 0 then 'low_bridges' when bridges > 0 then 'bridges' end, case when H3 > 0 and H4G7 + H4G8 + H4G9 = 0 and any_h4 then 'no_bridge_to_h4' end], lambda x: x is not null) as warnings from c join w using (component)"
)
def progression_components(spark, d):
    """For every record the component of its progression: edges, bands, bridges, status and warnings."""
    records, bridges = _records(spark, d)
    return progression.components(records, progression.edges(records, bridges))
