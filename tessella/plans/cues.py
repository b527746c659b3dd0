"""Queries on cues that passages and targets share (family N)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import understanding as U
from ..operators import cues as C
from .registry import query
from .tables import table
from .understanding import sql_list

# Passages and targets made of the columns of part, in blocks by brand.
PASSAGE = ["分角色朗读课文并复述", "写一篇读后感，介绍人物的经历", "认真听并讨论，发表意见", "听同学汇报后发言", "用计算机计算面积", "列式计算速度和路程", "概括主要内容", "Read the email and discuss", "比较二者，解释原因", "运用说明方法把事物介绍清楚"]
TARGET = ["朗读，注意语气", "写作：人物与感受", "倾听并发表意见，学会讨论", "讲述与发言，语言得体", "计算面积和周长", "估算速度", "概括要点，提取关键信息", "Reading for information, letter writing", "比较异同，说明道理", "体会情感"]
CODE = ["CN-D3-CM-001", "CN-D3-CM-002", "CN-D3-CM-003", "CN-D3-CM-004", "CN-D3-CM-005", "CN-D3-RE-001", "CN-D3-RE-007", "MA-D3-NU-001"]


def plain(pattern):
    """The pattern without look-ahead."""
    return pattern.replace("计算(?!机)", "计算(?:[^机]|$)")


def both(s, t, pair):
    return f"regexp_matches({s}, '{plain(pair[0])}') and regexp_matches({t}, '{plain(pair[1])}')"


HOLDS = "case " + " ".join(
    f"when cue = '{cue}' then ({(' and ' if cue in C.EACH else ' or ').join(f'({both(chr(115), chr(116), p)})' for p in ps)})" + (f" and not regexp_matches(s, '{C.OUT[cue]}')" if cue in C.OUT else "") + (f" and list_has_any(regexp_extract_all(s, '{C.AMOUNTS}'), regexp_extract_all(t, '{C.AMOUNTS}'))" if cue == "calculate" else "") for cue, ps in C.PAIRS.items()
) + " else false end"
GATE = " and ".join(f"(code <> '{k}' or regexp_matches(s, '{p}'))" for k, p in C.CONTEXTS.items())
MATCHES = " union all ".join(
    f"select x.block, source, target, code, s, t, '{cue}' as cue, {n} as n, {str(r[3]).lower()} as alone, least(0.98, {r[2]}::double + {f'''case when regexp_matches(code, '{r[4]}') then 0.035::double else 0.0::double end''' if r[4] else '0.0::double'} + least(0.045::double, 0.45::double / greatest(1, length(regexp_replace(t, '[^\\p{{L}}\\p{{N}}]+', '', 'g'))))) as score from x join y on y.block = x.block and regexp_matches(s, '{plain(r[0])}') and regexp_matches(t, '{plain(r[1])}')"
    for n, (cue, r) in enumerate(C.RULES.items())
)


@query(
    f"with x as (select p_brand as block, p_partkey as source, {sql_list(PASSAGE)}[1 + p_partkey % {len(PASSAGE)}] || ' ' || {sql_list(PASSAGE)}[1 + p_size % {len(PASSAGE)}] || ' ' || p_type as s from part),"
    f" y as (select p_brand as block, p_partkey as target, {sql_list(CODE)}[1 + p_partkey % {len(CODE)}] as code, {sql_list(TARGET)}[1 + p_size % {len(TARGET)}] || ' ' || p_name || case when p_partkey % 3 = 0 then {sql_list(TARGET)}[1 + p_partkey // 3 % {len(TARGET)}] else '' end as t from part),"
    f" m as ({MATCHES}),"
    f" b as (select distinct on (block, source, target) * from m where {GATE} order by block, source, target, score desc, n),"
    f" r as (select *, row_number() over (partition by source order by score desc, code, target) as rank from b)"
    f" select block, source, rank::integer as rank, target, code, cue, round(score, 9) as score, alone, {HOLDS} as compatible from r where rank <= 3"
)
def cue_matches(spark, d):
    """For each passage the three targets of its block with the best cue, scored by fifteen rules on both texts, with code contexts and predicate pairs."""
    at = lambda values, n: F.element_at(U.strings(values), (n % len(values) + 1).cast("int"))
    key, size = F.col("p_partkey"), F.col("p_size")
    part = table(spark, d, "part").withColumnRenamed("p_brand", "block")
    sources = part.select("block", key.alias("source"), F.concat_ws(" ", at(PASSAGE, key), at(PASSAGE, size), "p_type").alias("text"))
    targets = part.select("block", key.alias("target"), at(CODE, key).alias("code"), F.concat(at(TARGET, size), F.lit(" "), "p_name", F.when(key % 3 == 0, at(TARGET, F.floor(key / 3))).otherwise("")).alias("text"))
    return C.best_targets(sources, targets).withColumn("score", F.round("score", 9))
