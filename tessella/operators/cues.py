"""Cues that a passage and a target share, scored by rules on both texts, and predicates that must hold on both."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import canonical
from ..functions.understanding import named
from . import classes

# Rules (pattern of the passage, pattern of the target, score, whether the cue may stand without shared words, preferred codes).
RULES = {
    "main_content": (r"(?:围绕.{0,16}写了哪些内容|主要内容|概括.{0,10}内容|提取.{0,8}(?:信息|要点))", r"(?:获取|概括|提取).{0,12}(?:主要内容|主要信息|关键信息|要点)|主要内容", 0.9, True, "-RE-"),
    "read_aloud": (r"(?:有感情地|分角色)?朗读|背诵|复述", r"朗读|背诵|复述|语气|重音|节奏", 0.84, True, None),
    "emotion": (r"(?:体会|表达|蕴含|感受|喜爱|抒发).{0,12}(?:感情|情感|感受|情意)|感情的方法", r"感情|情感|感受|审美|表达独特感受", 0.86, False, None),
    "meaning": (r"(?:句子|词语|这句话).{0,14}(?:含义|意思)|理解.{0,8}(?:词句|句子)", r"(?:理解|体会).{0,10}(?:词句|句子|含义|意思)|语境", 0.85, False, None),
    "evidence": (r"(?:联系|结合|根据).{0,16}(?:课文|材料|具体事例|文本)|找出.{0,10}(?:语句|依据)", r"文本.{0,8}(?:依据|证据)|结合.{0,10}(?:材料|具体事例)|有理有据", 0.8, False, None),
    "writing": (r"(?:习作|写一种|写一篇|写一段|用文字|小练笔|写出自己的)", r"(?:习作|写作|书面表达|用文字.{0,30}表达|写.{0,8}(?:事物|文章|人物|感受|经历|想象))", 0.84, True, "-CM-005$"),
    "oral_discussion": (r"(?:口语交际|倾听|讨论|表决|发表意见)", r"(?:口语|倾听|讨论|交流|表达观点|沟通|发表意见)", 0.84, True, "-CM-001$"),
    "oral_speaking": (r"(?:发言|汇报|讲述)", r"(?:发言|讲述|语言得体)", 0.84, True, "-CM-002$"),
    "compare": (r"(?:比较|相同|不同|异同|对比)", r"(?:比较|相同|不同|异同|对比)", 0.82, False, None),
    "explain": (r"(?:说明|解释|为什么|道理|原因)", r"(?:说明|解释|推理|道理|原因)", 0.78, False, None),
    "calculate": (r"(?:计算(?!机)|列式|解答|估算)", r"(?:计算|运算|列式|估算|解答)", 0.86, True, None),
    "experiment": (r"(?:实验|观察|探究|记录|猜想|验证)", r"(?:实验|观察|探究|记录|猜想|验证)", 0.85, False, None),
    "english_interaction": (r"(?i)(?:listen|speak|talk|conversation|role.?play|discuss)", r"(?i)(?:listen|speak|talk|conversation|interaction|communicat)", 0.83, True, None),
    "english_reading": (r"(?i)(?:read|reading|main idea|information)", r"(?i)(?:read|reading|main idea|information)", 0.81, True, None),
    "english_writing": (r"(?i)(?:write|writing|paragraph|email|letter)", r"(?i)(?:write|writing|paragraph|email|letter)", 0.83, True, None),
}
# Pairs of which one (of oral_discussion: each) must hold on both texts, passages that are out, amounts of which both need one, and codes that ask for a context.
PAIRS = {
    "main_content": [(r"(?:主要内容|概括.{0,10}内容|提取.{0,8}(?:信息|要点)|围绕.{0,16}写了哪些内容)", r"(?:主要内容|主要信息|关键信息|要点|概括|提取)")],
    "read_aloud": [("朗读", "朗读"), ("背诵", "背诵"), ("复述", "复述")],
    "writing": [
        ("(?:感受|感想|读后感|情感)", "(?:感受|感想|情感)"), ("(?:介绍|说明方法|说明事物|写清楚)", "(?:介绍|说明方法|说明事物|清楚说明)"), ("(?:人物|一件事|经历)", "(?:人物|事情|经历|叙事)"),
        ("(?:想象|故事)", "(?:想象|故事)"), ("(?:观点|理由|议论)", "(?:观点|理由|议论)"),
    ],
    "oral_discussion": [("(?:发表意见|表达观点|说出看法|交流想法)", "(?:发表意见|表达观点|说出看法|交流想法)"), ("(?:倾听|认真听|听取|边听边)", "(?:倾听|认真听|听取)")],
    "oral_speaking": [("发言", "发言"), ("汇报", "汇报"), ("讲述", "讲述")],
    "calculate": [("计算(?!机)", "计算(?!机)"), ("列式", "列式"), ("解答", "解答"), ("估算", "估算")],
}
EACH = ["oral_discussion"]
OUT = {"oral_speaking": "(?:别人|他人|同学).{0,8}(?:发言|汇报|讲述)", "calculate": "计算机"}
AMOUNTS = "(?:化学方程式|百分比|百分数|比例|比值|方程|函数|分数|小数|整数|速度|路程|时间|质量|密度|体积|面积|周长|角度|概率|平均数|电流|电压|电阻|电功率|功率|热值|热量|温度|压强|浮力|机械效率)"
CONTEXTS = {
    "CN-D3-CM-003": "(?:概括|提取).{0,12}(?:说明性|非连续性|主要内容|关键信息)|判断.{0,12}合理",
    "CN-D3-RE-007": "(?:阅读|了解|发现|辨析|体会|感受).{0,20}(?:说明方法|结构方式|文本结构|语言特点|内容与形式|表达方法)|(?:说明方法|结构方式|文本结构|语言特点|内容与形式|表达方法).{0,20}(?:阅读|了解|发现|辨析|体会|感受)",
    "CN-D3-CM-004": "(?:用|运用|选择).{0,16}(?:说明方法|准确语言)|(?:把|将).{0,16}(?:介绍|说明).{0,8}(?:清楚|明白)|(?:介绍|说明)(?:事物|程序)",
    "CN-D3-CM-005": "(?:表达|写出|记录).{0,12}(?:独特感受|感受|感想|情感)|(?:读后感|观察所得)",
}
PREFERRED, SHORT, SHORTEST, MOST = 0.035, 0.45, 0.045, 0.98


def _amounts(c: Column, cues: Column) -> Column:
    found = F.sort_array(F.array_distinct(F.regexp_extract_all(c, F.lit(AMOUNTS), F.lit(0))))
    return F.when(F.array_contains(cues, "calculate"), found).otherwise(F.array().cast("array<string>"))


def _traits(rows: DataFrame, side: int) -> DataFrame:
    """rows(..., text) with cues, pairs ('cue/number') and amounts that their text meets on its side (0 passage, 1 target)."""
    c = F.coalesce(F.col("text"), F.lit(""))
    out = lambda cue: c.rlike(OUT[cue]) if side == 0 and cue in OUT else F.lit(False)
    pairs = {f"{cue}/{n}": c.rlike(p[side]) & ~out(cue) for cue, ps in PAIRS.items() for n, p in enumerate(ps)}
    rows = rows.withColumns({"cues": named({cue: c.rlike(r[side]) for cue, r in RULES.items()}), "pairs": named(pairs)})
    return rows.withColumn("amounts", _amounts(c, F.col("cues")))


def _classed(rows: DataFrame, traits: list[str]) -> DataFrame:
    return rows.withColumn("class", F.sha2(F.to_json(F.struct("block", *traits)), 256))


def passages(sources: DataFrame) -> DataFrame:
    """sources(block, source, text) that show a cue, with their class: passages of a class score alike with every target."""
    c = F.coalesce(F.col("text"), F.lit(""))
    met = lambda t: _traits(t, 0).withColumn("contexts", named({k: c.rlike(p) for k, p in CONTEXTS.items()})).where(F.size("cues") > 0)
    rows = classes.once(sources.select("block", "source", "text"), ["text"], met)
    return _classed(rows, ["cues", "pairs", "amounts", "contexts"]).drop("text")


def aims(targets: DataFrame) -> DataFrame:
    """targets(block, target, code, text) that show a cue, with their class; texts of up to ten letters and digits count as ten."""
    letters = F.length(F.regexp_replace(canonical.nfkc(F.coalesce("text", F.lit(""))), r"[^\p{L}\p{N}]+", ""))
    prefers = named({cue: F.col("code").rlike(r[4]) for cue, r in RULES.items() if r[4]})
    gate = F.when(F.col("code").isin(list(CONTEXTS)), F.col("code"))
    met = lambda t: _traits(t, 1).where(F.size("cues") > 0).withColumn("letters", F.greatest(F.lit(int(SHORT / SHORTEST)), letters))
    rows = classes.once(targets.select("block", "target", "code", "text"), ["text"], met).withColumns({"prefers": prefers, "gate": gate})
    return _classed(rows, ["cues", "pairs", "amounts", "letters", "prefers", "gate"]).drop("text")


def class_scores(sources: DataFrame, targets: DataFrame) -> DataFrame:
    """(block, source_class, target_class, cue, score, alone, compatible) of classes that share a cue; the earlier rule wins a tie.

    alone: the cue may stand without shared words; compatible: its predicate holds on both texts (a cue
    without predicates is never compatible). Only classes are paired, so cues that many rows show cost no more."""
    s = sources.groupBy("class").agg(*[F.first(c).alias(c) for c in ("block", "cues", "pairs", "amounts", "contexts")])
    t = targets.groupBy("class").agg(*[F.first(c).alias(c) for c in ("block", "cues", "pairs", "amounts", "letters", "prefers", "gate")])
    rule = F.create_map(*[v for n, (cue, r) in enumerate(RULES.items()) for v in (F.lit(cue), F.struct(F.lit(n).alias("n"), F.lit(r[2]).alias("score"), F.lit(r[3]).alias("alone")))])
    s = s.select("block", F.col("class").alias("source_class"), "contexts", F.explode("cues").alias("cue"), F.col("pairs").alias("s_pairs"), F.col("amounts").alias("s_amounts"))
    t = t.select("block", F.col("class").alias("target_class"), "gate", "letters", "prefers", F.explode("cues").alias("cue"), F.col("pairs").alias("t_pairs"), F.col("amounts").alias("t_amounts"))
    j = s.join(t, ["block", "cue"]).where(F.col("gate").isNull() | F.array_contains("contexts", F.col("gate"))).withColumn("rule", F.element_at(rule, F.col("cue")))
    bonus = F.when(F.array_contains("prefers", F.col("cue")), PREFERRED).otherwise(0.0)
    score = F.least(F.lit(MOST), F.col("rule.score") + bonus + F.least(F.lit(SHORTEST), F.lit(SHORT) / F.col("letters")))
    both = F.size(F.filter(F.array_intersect("s_pairs", "t_pairs"), lambda p: F.startswith(p, F.concat("cue", F.lit("/")))))
    holds = F.when(F.col("cue").isin(EACH), both == 2).otherwise(both > 0) & ((F.col("cue") != "calculate") | F.arrays_overlap("s_amounts", "t_amounts"))
    best = F.max(F.struct(score.alias("score"), (-F.col("rule.n")).alias("n"), "cue", F.col("rule.alone").alias("alone"), holds.alias("compatible"))).alias("best")
    return j.groupBy("block", "source_class", "target_class").agg(best).select("block", "source_class", "target_class", "best.cue", "best.score", "best.alone", "best.compatible")


def best_targets(sources: DataFrame, targets: DataFrame, most: int = 3) -> DataFrame:
    """(block, source, rank, target, code, cue, score, alone, compatible): for each passage the targets of its block with the best cue scores.

    Ties go by code, then by target, both unique together. Only the first `most` targets of a class can be among a passage's best, and
    passages of a class have the same ones. Null texts are empty and show no cue; a null block matches nothing."""
    s, t = passages(sources), aims(targets)
    first = t.withColumn("_n", F.row_number().over(Window.partitionBy("class").orderBy("code", "target"))).where(F.col("_n") <= most).select(F.col("class").alias("target_class"), "code", "target")
    ranked = class_scores(s, t).join(first, "target_class").withColumn("rank", F.row_number().over(Window.partitionBy("source_class").orderBy(F.desc("score"), "code", "target"))).where(F.col("rank") <= most)
    return s.select("block", "source", F.col("class").alias("source_class")).join(ranked.drop("block"), "source_class").select("block", "source", "rank", "target", "code", "cue", "score", "alone", "compatible")
