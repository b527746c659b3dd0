"""What is hard in a statement and where learners fail: rules on its words, tied to its clauses, with defaults where none holds."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.understanding import named, strings
from .clauses import compact

# Rules of demands (pattern, title, dimension), rules of difficulties (pattern), words that limit a demand, and quantities.
DEMANDS = {
    "evidence_argument": ("依据|理由|证据|论证|解释|说明(?!书|文|性)|阐释|推理", "用证据或依据完成解释", "argument_evidence"),
    "transfer_context": ("真实|实际|生活|情境|陌生|迁移|综合|开放", "在真实或变化情境中迁移", "transfer"),
    "multi_step": ("多步|步骤|顺序|先.*(?:再|然后)|连续|综合运用|完整流程|全过程", "保持多步骤或完整结构", "multi_step"),
    "compare_distinguish": ("比较|区分|辨析|异同|分类|判断", "按一致维度比较或辨析", "comparison"),
    "representation": ("图表|图象|图像|模型|符号|表示|表征|转换|示意图|地图", "在多种表征之间转换", "representation"),
    "creation_constraints": ("设计|创作|方案|改进|优化|制作", "在约束下设计、创作或改进", "creation_constraints"),
    "independent_precision": ("独立|自主|准确|规范|熟练|正确|安全", "独立且规范地完成表现", "independence_precision"),
    "multiple_conditions": ("同时|分别|至少|不超过|不同|多种|多个|各种|既.*又", "同时满足多个条件或范围限定", "multiple_conditions"),
    "quality_criteria": ("恰当|合理|清楚|清晰|连贯|稳定|得体|有效|灵活|协调|一致|完整", "达到标准中的质量准则", "quality_criteria"),
    "quantitative_threshold": (r"不少于|不低于|至少|不超过|每学年|每周|每分钟|\d+\s*[—–~-]\s*\d+\s*(?:字|词|首|件|分钟|次|个)|\d+(?:字|词|首|件|分钟|次|个)(?:以上|左右)?", "满足数量、时长或频率阈值", "quantitative_threshold"),
}
WHOLE = {"combined_performance": ("整合多个小能力完成完整表现", "integration"), "independent_core_performance": ("独立完成核心表现", "independent_performance")}
DIFFICULTIES = {
    "argument_evidence": "依据|理由|证据|论证|解释|说明(?!书|文|性)|阐释|推理",
    "comparison": "比较|区分|辨析|异同|分类|判断",
    "multi_step_procedure": "多步|步骤|顺序|先.*(?:再|然后)|连续|完整流程|全过程",
    "transfer": "真实|实际|生活|情境|陌生|迁移|应用|运用|解决",
    "representation": "图表|图象|图像|模型|符号|表示|表征|转换|示意图|地图",
    "creation_design": "设计|创作|方案|改进|优化|制作",
    "language_expression": "描述|说出|表达|交流|阅读|朗读|写|概括|复述",
    "concept_discrimination": "认识|理解|识别|辨认|观察|发现|概念|特征",
}
UNSTABLE = "performance_stability"
LIMITS = [
    "真实", "实际", "生活", "情境", "陌生", "迁移", "综合", "开放", "依据", "理由", "证据",
    "论证", "解释", "说明", "阐释", "推理", "多步", "步骤", "顺序", "过程", "连续", "完整", "比较", "区分",
    "辨析", "异同", "分类", "判断", "图表", "图象", "图像", "模型", "符号", "表示", "表征", "转换", "设计",
    "创作", "方案", "作品", "改进", "优化", "制作", "独立", "自主", "准确", "规范", "熟练", "正确", "安全",
    "同时", "分别", "至少", "不超过", "不少于", "不低于", "每学年", "每周", "每分钟", "不同", "多种",
    "多个", "各种", "恰当", "合理", "清楚", "清晰", "连贯", "稳定", "得体", "有效", "灵活", "协调", "一致", "完整",
]
QUANTITY = r"\d+\s*[—–~-]\s*\d+\s*(?:字|词|首|件|分钟|次|个)|\d+(?:字|词|首|件|分钟|次|个)(?:以上|左右)?"
SURE, DEFAULT, DIFFICULTY_SURE, DIFFICULTY_DEFAULT = 0.7, 0.58, 0.66, 0.54
JOINER = "␟"

#: The words that limit each demand.
LIMITS_OF = {rule: [t for t in LIMITS if re.search(pattern, t)] for rule, (pattern, _, _) in DEMANDS.items()}


def _short_id(prefix: str, *parts: Column) -> Column:
    return F.concat(F.lit(f"{prefix}_"), F.left(F.sha2(F.concat_ws(JOINER, *[p.cast("string") for p in parts]), 256), F.lit(16)))


def _pick(values: dict[str, str], c: Column) -> Column:
    return F.element_at(F.create_map(*[F.lit(v) for kv in values.items() for v in kv]), c)


def _parts(comps: DataFrame, key: str) -> DataFrame:
    """(key, parts): the clauses of each text in order, each with the rules that its label meets, which are tried once a clause."""
    demands = named({r: F.col("label").rlike(p) for r, (p, _, _) in DEMANDS.items()})
    difficult = named({r: F.col("label").rlike(p) for r, p in DIFFICULTIES.items()})
    return comps.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("no", "label", demands.alias("demands"), difficult.alias("difficulties")))).alias("parts"))


def _statements(texts: DataFrame, comps: DataFrame, key: str, text: str) -> DataFrame:
    """Texts with their clauses. Neither is broadcast: a small file makes many texts, which would all go through the driver."""
    return texts.select(key, compact(F.col(text)).alias("_t")).join(_parts(comps, key).hint("merge"), key)


def _limits(c: Column, rule: Column) -> Column:
    """Words of the rule in a text, in fixed order; quantities, which only the rule of thresholds knows, behind them."""
    known = F.element_at(F.create_map(*[v for r, words in LIMITS_OF.items() for v in (F.lit(r), strings(words))]), rule)
    words = F.filter(F.coalesce(known, F.array().cast("array<string>")), lambda w: F.contains(c, w))
    amounts = F.array_distinct(F.regexp_extract_all(c, F.lit(QUANTITY), F.lit(0)))
    return F.concat(words, F.when(rule == "quantitative_threshold", amounts).otherwise(F.array().cast("array<string>")))


def _met(s: DataFrame) -> DataFrame:
    """s with the demands that each text meets, or the one by default, and whether it meets any."""
    found = named({r: F.col("_t").rlike(p) for r, (p, _, _) in DEMANDS.items()})
    several = F.when(F.size("parts") > 1, "combined_performance").otherwise("independent_core_performance")
    s = s.withColumn("found", found).withColumn("met", F.size("found") > 0)
    return s.withColumn("rules", F.when(F.col("met"), F.col("found")).otherwise(F.array(several))).drop("found")


def _tied(rule: Column) -> Column:
    """Numbers of the clauses that meet a demand, else of the first three."""
    related = F.filter("parts", lambda p: F.array_contains(p["demands"], rule))
    return F.transform(F.when(F.exists("parts", lambda p: F.array_contains(p["demands"], rule)), related).otherwise(F.slice("parts", 1, 3)), lambda p: p["no"])


def cases(texts: DataFrame, comps: DataFrame, key: str, text: str) -> DataFrame:
    """(key, no, rule, title, dimension, components, limits, structure, confidence, case_id): the hard cases of each text.

    comps: the clauses (key, no, label) of the texts; a text without any has no case. Every rule that a text
    meets is a case, in the order of the table, tied to the clauses that meet it too, else to the first
    three. A text that meets no rule has one case by default, by whether it has several clauses.
    """
    s = _met(_statements(texts, comps, key, text)).select(key, "_t", "parts", "met", F.posexplode("rules").alias("at", "rule"))
    title = _pick({r: v[1] for r, v in DEMANDS.items()} | {r: v[0] for r, v in WHOLE.items()}, F.col("rule"))
    dimension = _pick({r: v[2] for r, v in DEMANDS.items()} | {r: v[1] for r, v in WHOLE.items()}, F.col("rule"))
    s = s.withColumns({"limits": _limits(F.col("_t"), F.col("rule")), "title": title, "no": F.col("at") + 1})
    heads = F.array_join(F.transform(F.slice("parts", 1, 3), lambda p: p["label"]), "；")
    structure = F.when(F.size("limits") > 0, F.concat("title", F.lit("（"), F.array_join("limits", "、"), F.lit("）"))).otherwise(heads)
    return s.select(key, "no", "rule", "title", dimension.alias("dimension"), _tied(F.col("rule")).alias("components"), "limits", structure.alias("structure"), F.when(F.col("met"), SURE).otherwise(DEFAULT).alias("confidence"), _short_id("hc", F.col(key), F.col("rule"), F.col("no")).alias("case_id"))


def difficulties(texts: DataFrame, comps: DataFrame, key: str, text: str) -> DataFrame:
    """(key, no, category, components, target, cases, confidence, difficulty_id): where learners of each text may fail.

    Every category that a text meets, in the order of the table, tied to the clauses that meet it, else to
    the clause of its own place (or the last one); `target` is the first of these, `cases` the hard cases
    that share a clause. A text that meets none may fail in stability. comps is read once.
    """
    s = _met(_statements(texts, comps, key, text))
    hard = F.transform("rules", lambda r, i: F.struct(_tied(r).alias("components"), _short_id("hc", F.col(key), r, i + 1).alias("case_id")))
    found = named({r: F.col("_t").rlike(p) for r, p in DIFFICULTIES.items()})
    s = s.select(key, "parts", hard.alias("hard"), found.alias("found"))
    s = s.select(key, "parts", "hard", (F.size("found") > 0).alias("met"), F.posexplode(F.when(F.size("found") > 0, F.col("found")).otherwise(strings([UNSTABLE]))).alias("at", "category"))
    related = F.filter("parts", lambda p: F.array_contains(p["difficulties"], F.col("category")))
    s = s.withColumn("related", related)
    own = F.slice("parts", F.least(F.col("at") + 1, F.size("parts")), F.lit(1))
    s = s.withColumn("tied", F.when(F.size("related") > 0, F.col("related")).otherwise(own))
    s = s.withColumns({"components": F.transform("tied", lambda p: p["no"]), "no": F.col("at") + 1})
    shared = F.transform(F.filter("hard", lambda h: F.arrays_overlap(h["components"], F.col("components"))), lambda h: h["case_id"])
    return s.select(key, "no", "category", "components", F.get("tied", F.lit(0))["label"].alias("target"), shared.alias("cases"), F.when(F.col("met"), DIFFICULTY_SURE).otherwise(DIFFICULTY_DEFAULT).alias("confidence"), _short_id("cd", F.col(key), F.col("category"), F.col("no")).alias("difficulty_id"))
