"""Clauses of a statement, each with its condition and the object that it shares with a neighbour, and the rules that such statements meet."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .classes import once

# Verbs that begin a clause, adverbs before them, verbs that lack an object where they stand alone, and the words around clauses.
VERBS = [
    "描述", "说出", "写出", "写作", "表达", "交流", "阅读", "朗读", "识别", "辨认", "观察", "比较",
    "区分", "判断", "分析", "解释", "说明", "阐释", "论证", "推理", "概括", "归纳", "总结", "理解",
    "认识", "了解", "掌握", "运用", "应用", "解决", "计算", "测量", "操作", "制作", "设计", "创作",
    "探究", "调查", "实验", "建模", "评价", "反思", "选择", "制定", "完成", "参与", "表现", "形成",
    "发展", "体验", "感知", "遵守", "维护", "使用", "利用", "提出", "发现", "记录", "展示",
    "聆听", "听赏", "听辨", "辨别", "分类", "列举", "举例", "读懂", "识读", "提取", "获取", "梳理",
    "整合", "搜索", "查找", "收集", "搜集", "整理", "撰写", "仿写", "改写", "修改", "改进", "调整",
    "策划", "组织", "规划", "编创", "演唱", "演奏", "表演", "模仿", "绘制", "呈现", "构建", "构思",
    "建立", "实施", "开展", "承担", "合作", "倾听", "欣赏", "评析", "质疑", "验证", "检查", "识字",
    "书写", "练习", "锻炼", "保护", "保持", "控制", "应对", "拒绝", "尊重", "关注", "领悟", "复述", "思考",
]
BARE_ADVERBS = "初步|独立|主动|积极|定期|准确|正确|尝试|共同|继续|熟练|基本|逐步"
BARE_VERBS = "理解|掌握|认识|了解|知道|体会|感知|体验|形成|发展|读懂|列举|发现|识别|编创|判断|分析|搜索|运用|使用|选择|评价|说明|解释|描述|观察|比较|区分|提出|记录|展示|反思|设计|制作|完成|参与|归纳|概括"
OBJECT_ADVERBS = "初步|独立|主动|积极|定期|准确|正确|尝试|共同|继续|熟练|基本|逐步|较好地"
ACTION_ADVERBS = "初步|独立|主动|积极|认真|定期|准确|正确|共同|继续|熟练|基本|逐步|较好地"
ABLE = "能够|能|可以|会|尝试"
LEARNER = "学生(?:能够|能|会)"
JOINED = "并且|并|且|同时|以及|还要"
METHOD = "围绕|根据|通过|借助|结合|面对|基于|按照|依照"
SETTING = "^((?:在|通过|借助|结合|面对).{1,80}(?:过程中|基础上|时|中|下|内))[，,]?(.+)$"
CONDITION_END = "(?:时|中|下|内|过程中|基础上)$"
LEFTOVER = "^(?:以及|并且|并|且|还要|的|间内)"
PURPOSE = "(?:进行|用于|以便|从而).+$"
KINDS = {
    "metacognitive": "反思|评价|监控|策略|调整|规划",
    "disposition": "责任|态度|意识|习惯|品德|尊重|合作|参与|价值",
    "representational": "图表|图象|图像|模型|符号|表示|表征|转换|示意图|地图",
    "language": "表达|交流|阅读|朗读|写|说|描述|语言|词|句|文本|概括|复述",
    "procedural": "计算|运算|操作|步骤|制作|实验|测量|使用|绘制|完成|练习|解决",
}

VERB = "|".join(VERBS)
HEADS = rf"^(?:(?:[，,；;。\s]++)?(?:{LEARNER}\s*)?(?:(?:{ABLE})\s*)?(?:(?:{JOINED})\s*)?){{3}}"
BARE = f"^(?:{BARE_ADVERBS})?(?:{BARE_VERBS})$"
TASKS = 64  # that texts are dealt over


def compact(c: Column) -> Column:
    return F.trim(F.regexp_replace(F.coalesce(c, F.lit("")), r"\s+", " "))


def label_of(c: Column) -> Column:
    """Without final marks, and without what introduces the clause, up to three times over."""
    return F.trim(F.regexp_replace(F.regexp_replace(compact(c), r"[，,；;。\s]+$", ""), HEADS, ""))


def object_of(label: Column) -> Column:
    """What the verb of a clause acts on: up to the next mark and without its purpose."""
    rest = F.regexp_replace(F.regexp_replace(compact(label), rf"^(?:{OBJECT_ADVERBS})\s*", ""), f"^(?:{VERB})", "")
    return F.trim(F.regexp_replace(F.regexp_extract(rest, r"^[^，,；;]*", 0), PURPOSE, ""))


def acts(c: Column) -> Column:
    return F.regexp_replace(label_of(c), rf"^(?:{ACTION_ADVERBS})\s*", "").rlike(f"^(?:{VERB})")


def is_note(c: Column) -> Column:
    return c.rlike("^[（(].*[）)]$")


def kind_of(c: Column) -> Column:
    out = F.lit("conceptual")
    for name, pattern in reversed(KINDS.items()):
        out = F.when(c.rlike(pattern), name).otherwise(out)
    return out


def pieces(texts: DataFrame, key: str, text: str) -> DataFrame:
    """(key, whole, at, piece) of every text: sentences, cut before a verb that follows a comma or a conjunction.

    An introduction of 2 to 18 characters before a colon goes if a verb comes after it. A text has one piece at
    least, a null if there is nothing in it; the whole text stands at its first piece and is null at others."""
    body = compact(F.col(text))
    tail = F.regexp_extract(body, r"^[^：:]{2,18}[：:]\s*(.+)$", 1)
    whole = F.when(tail.rlike(VERB), tail).otherwise(body)
    cut = f"，(?=(?:并|且|同时|还要)?(?:{ABLE}|{VERB}))|(?:并且|并|且|以及)(?=(?:{ABLE})?(?:{VERB}))"
    out = texts.select(key, whole.alias("whole")).select(key, "whole", F.posexplode_outer(F.split("whole", "[；;。\n]+")).alias("s", "sentence"))
    out = out.withColumn("sentence", F.trim("sentence"))
    out = out.withColumn("sentence", F.when((F.col("sentence") != "") & ~is_note(F.col("sentence")), F.col("sentence")))
    first = (F.col("s") == 0) & (F.coalesce("p", F.lit(0)) == 0)
    return out.select(key, "whole", "s", F.posexplode_outer(F.split("sentence", cut)).alias("p", "piece")).select(key, F.when(first, F.col("whole")).alias("whole"), F.struct("s", "p").alias("at"), "piece")


def read(found: DataFrame) -> DataFrame:
    """pieces with all that depends on the piece alone: the part that may be a clause, its setting, whether it
    is only a condition, whether it may be a clause, its object, whether it is a verb alone, and its kind.

    They are never broadcast: there may be many, and all would go through the driver."""
    raw = label_of(F.col("piece"))
    p = found.withColumns({"raw": raw, "loose": compact(F.col("piece")).rlike(rf"^(?:{ABLE})\s*以及")})
    p = p.withColumns({"setting": F.regexp_extract("raw", SETTING, 1), "rest": F.regexp_extract("raw", SETTING, 2)})
    p = p.withColumn("led", (F.col("setting") != "") & acts(F.col("rest")))
    p = p.withColumns({"part": F.when(F.col("led"), label_of(F.col("rest"))).otherwise(F.col("raw")), "setting": F.when(F.col("led") & ~F.col("loose"), F.col("setting"))})
    part = F.col("part")
    only = (part.rlike(CONDITION_END) & ~acts(part)) | (part.rlike(f"^(?:{METHOD})") & ~part.rlike(VERB))
    clause = ~part.rlike(LEFTOVER) & ~is_note(part) & (F.length("part") >= 2)
    return p.select("piece", "part", "setting", (~F.col("loose") & only).alias("only"), (~F.col("loose") & ~only & clause).alias("clause"), object_of(part).alias("object"), part.rlike(BARE).alias("bare"), kind_of(part).alias("kind")).hint("merge")


def components(texts: DataFrame, key: str, text: str) -> DataFrame:
    """(key, no, label, condition, source, kind): the clauses of each text, at least one a text.

    A setting ('在…中') or method ('通过…') without a verb is no clause but the condition of those after it in
    its sentence. Of clauses equal in label and condition the first stays. A verb alone takes the object of
    the clause after it; if that has none of two characters or more, the object of the nearest clause before
    with one of three or more that is no verb alone. A text without clauses is one by itself; a null text is
    empty and has an empty one. `key` must be unique. Clauses of a text meet in one sorted partition and are
    never held as an array, so texts may be of any length.
    """
    # Texts are dealt anew, as a small file of them is one task. What has no clause stays as one row a text, behind its clauses.
    p = once(pieces(texts.select(key, text).repartition(TASKS, key), key, text), ["piece"], read).repartition(key)
    part = F.col("part")
    told = Window.partitionBy(key, "at.s").orderBy("at.p").rowsBetween(Window.unboundedPreceding, 0)
    p = p.withColumn("condition", F.coalesce(F.last(F.when(F.col("only"), part).otherwise(F.col("setting")), ignorenulls=True).over(told), F.lit("")))
    clause = lambda c: F.when(F.col("clause"), F.col(c))
    p = p.groupBy(key, clause("part").alias("label"), clause("condition").alias("condition")).agg(F.min("at").alias("at"), F.max("whole").alias("whole"), *[F.first(clause(c)).alias(c) for c in ("object", "bare", "kind")])

    order = Window.partitionBy(key).orderBy(F.col("label").isNull(), "at")
    bare = lambda c: c.rlike(BARE)
    p = p.withColumns({"next_label": F.lead("label").over(order), "lent": F.lead("object").over(order), "no": F.row_number().over(order)})
    p = p.withColumn("takes", F.col("bare") & (F.length(F.coalesce("lent", F.lit(""))) >= 2))
    takes = F.col("takes")
    p = p.withColumn("first_label", F.when(takes, F.concat("label", "lent")).otherwise(F.col("label")))
    said = lambda c: compact(F.concat(F.when(F.col("condition") != "", F.concat("condition", F.lit("，"))).otherwise(""), c))
    p = p.withColumn("source", F.when(takes, said(F.concat("label", F.lit("并"), "next_label"))).otherwise(said(F.col("label"))))
    thing = F.col("thing")
    p = p.withColumn("thing", F.when(takes, object_of(F.col("first_label"))).otherwise(F.col("object")))
    p = p.withColumn("own", F.when((F.length(thing) >= 3) & ~bare(thing), thing))
    p = p.withColumns({"kept": F.last("own", ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, -1)), "whole": F.max("whole").over(Window.partitionBy(key))})
    p = p.where("label is not null or no = 1").withColumn("alone", F.when(F.col("label").isNull(), label_of(F.col("whole"))))
    late = F.when(takes, bare(F.col("first_label"))).otherwise(F.col("bare")) & F.col("kept").isNotNull()
    p = p.withColumn("late", late)
    late, alone = F.col("late"), F.col("alone")
    found = p.withColumn("kind", F.when(~takes & ~late, F.col("kind"))).select(key, "no", F.coalesce(alone, F.when(late, F.concat("first_label", "kept")).otherwise(F.col("first_label"))).alias("label"), F.coalesce("condition", F.lit("")).alias("condition"), F.coalesce(alone, F.when(late, compact(F.col("whole"))).otherwise(F.col("source"))).alias("source"), "kind")
    return found.withColumn("kind", F.coalesce("kind", kind_of(F.col("label"))))
