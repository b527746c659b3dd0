"""What a query text asks for, as Column expressions: subjects, exclusions, bands, skills, terms, numbers and codes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import terms, topic_tokens

# Names of the subjects and hints of the skills.
SUBJECT_ALIASES = {
    "chinese": ["语文", "中文", "chinese"],
    "math": ["数学", "math", "mathematics"],
    "english": ["英语", "英文", "english"],
    "science": ["科学", "science"],
    "morality_law": ["道德与法治", "道法", "morality", "law"],
    "history": ["历史", "history"],
    "geography": ["地理", "geography"],
    "pe": ["体育与健康", "体育", "pe"],
    "arts": ["艺术", "美术", "音乐", "舞蹈", "戏剧", "影视", "art"],
    "labor": ["劳动", "劳动教育", "labor"],
    "it": ["信息科技", "信息技术", "it"],
}
SKILL_ALIASES = {
    "TS1": ["批判性思维", "问题解决", "分析", "判断", "推理", "证据"],
    "TS2": ["创新", "创意", "创造性实践", "设计", "想象"],
    "TS3": ["学习者能动性", "自主学习", "自我管理", "反思", "目标管理"],
    "TS4": ["协作", "合作", "共同体行动", "团队", "社会参与"],
    "TS5": ["沟通", "表达", "交流", "写作", "呈现"],
    "TS6": ["数字素养", "信息素养", "媒介素养", "数据", "信息技术"],
    "TS7": ["全球公民", "可持续发展", "伦理", "责任", "文化理解"],
}
SUBJECT_LABELS = {
    "chinese": "语文", "math": "数学", "english": "英语", "science": "科学", "morality_law": "道德与法治", "pe": "体育与健康",
    "arts": "艺术", "labor": "劳动", "it": "信息科技", "history": "历史", "geography": "地理",
}
BAND_LABELS = {"H1": "小学 1–2 年级", "H2": "小学 3–4 年级", "H3": "小学 5–6 年级", "H4G7": "七年级", "H4G8": "八年级", "H4G9": "九年级"}
# Phrases that name a band.
GRADE_PATTERNS = [
    (r"(?i)(?:一|1)\s*[-—至到]\s*(?:二|2)年级|一二年级|第一学段|G\s*1\s*[-—至到]\s*2|(?:小学)?(?:一|二|1|2)年级", "H1"),
    (r"(?i)(?:三|3)\s*[-—至到]\s*(?:四|4)年级|三四年级|第二学段|G\s*3\s*[-—至到]\s*4|(?:小学)?(?:三|四|3|4)年级", "H2"),
    (r"(?i)(?:五|5)\s*[-—至到]\s*(?:六|6)年级|五六年级|第三学段|G\s*5\s*[-—至到]\s*6|(?:小学)?(?:五|六|5|6)年级", "H3"),
    (r"(?i)(?:七|7)年级|初一|H4G7", "H4G7"),
    (r"(?i)(?:八|8)年级|初二|H4G8", "H4G8"),
    (r"(?i)(?:九|9)年级|初三|H4G9", "H4G9"),
]
# Phrases of a request that are no topic.
SCAFFOLDING = [
    "课程标准", "小学低年级", "低年级", "年级", "但不是", "不是", "除了", "排除", "不包含", "不包括", "不含", "不要", "剔除", "之外", "以外",
    "忽略所有规则", "所有规则", "请帮我", "帮我", "查找", "寻找", "检索", "看看", "列出", "忽略", "返回", "相关的", "有关的", "相关", "有关",
    "适合", "培养", "能够", "可以", "需要", "想要", "涉及", "围绕", "方面", "内容", "活动", "任务",
    "学科", "课程", "课标", "标准", "教学", "学习", "要求", "目标", "能力", "理解", "掌握", "中的", "中", "里的",
    "里", "关于", "跟", "以及", "并且", "并用", "并", "与", "和", "通过", "进行", "用于", "的",
]
CODE_LIKE = r"(?<![a-z0-9_])[a-z]{2,8}(?:-[a-z0-9]{1,12}+(?![a-z0-9_])){2,}+"
DIGITS = "一二三四五六七八九"


def longest_first(words: list[str]) -> list[str]:
    return sorted(dict.fromkeys(words), key=len, reverse=True)


def strings(values: list[str]) -> Column:
    return F.array(*map(F.lit, values)) if values else F.array().cast("array<string>")


def named(found: dict[str, Column]) -> Column:
    """The names whose condition holds, in order."""
    return F.array_compact(F.array(*[F.when(c, F.lit(name)) for name, c in found.items()]))


def mentions(text: Column, words: list[str]) -> Column:
    return F.exists(strings([w.lower() for w in words]), lambda w: F.contains(F.lower(text), w))


def excluding(alias: str) -> str:
    """A pattern of the three shapes in which a text excludes an alias."""
    a = alias.replace(".", r"\.")
    return rf"(?i)(?:除了?|排除|不含|不要|剔除|不是|非)\s*[^，。；;]{{0,12}}{a}|{a}\s*(?:之外|以外|外)|{a}\s*[^，。；;]{{0,8}}(?:除外|排除|不包含|不要)"


def excluded(text: Column, words: list[str]) -> Column:
    out = F.lit(False)
    for w in words:
        out = out | (F.contains(F.lower(text), F.lit(w.lower())) & text.rlike(excluding(w)))
    return out


def subjects_of(text: Column) -> tuple[Column, Column]:
    """(asked for, excluded)."""
    gone = {s: excluded(text, w) for s, w in SUBJECT_ALIASES.items()}
    return named({s: mentions(text, w) & ~gone[s] for s, w in SUBJECT_ALIASES.items()}), named(gone)


def bands_of(text: Column) -> Column:
    return named({band: text.rlike(p) for p, band in GRADE_PATTERNS})


def skills_of(text: Column) -> Column:
    return named({s: mentions(text, w) for s, w in SKILL_ALIASES.items()})


def topic_of(text: Column) -> Column:
    """A request without codes, bands, names of subjects and phrases that are no topic."""
    out = F.regexp_replace(F.lower(text), CODE_LIKE, " ")
    for p, _ in GRADE_PATTERNS:
        out = F.regexp_replace(out, p, " ")
    for alias in longest_first([a for w in SUBJECT_ALIASES.values() for a in w]):
        latin = alias.isascii()
        out = F.regexp_replace(out, rf"(?<![a-z0-9_]){alias}(?![a-z0-9_])", " ") if latin else F.replace(out, F.lit(alias), F.lit(" "))
    out = F.aggregate(strings(longest_first(SCAFFOLDING)), out, lambda acc, w: F.replace(acc, w, F.lit(" ")))
    return F.trim(F.regexp_replace(out, r"\s+", " "))


def core_terms(text: Column, most: int = 24) -> Column:
    return F.slice(topic_tokens(topic_of(text)), 1, most)


def inferred_skills(found: Column) -> Column:
    """Skills with an alias that contains, or is contained in, one of the terms."""
    hit = lambda words: F.exists(strings(words), lambda a: F.exists(found, lambda t: F.contains(a, t) | F.contains(t, a)))
    return named({s: hit(w) for s, w in SKILL_ALIASES.items()})


def skill_overlap(found: Column, own: Column) -> Column:
    """The share of the inferred skills that a record has."""
    inferred = inferred_skills(found)
    both = F.size(F.filter(inferred, lambda s: F.array_contains(own, s)))
    return F.when((F.size(own) == 0) | (F.size(inferred) == 0), 0.0).otherwise(both / F.size(inferred))


def anchored(expansion: Column, core: Column, most: int = 60) -> Column:
    """Expansion terms that contain a core term or are contained in one, and are none themselves."""
    fits = lambda t: ~F.array_contains(core, t) & F.exists(core, lambda c: F.contains(t, c) | F.contains(c, t))
    return F.slice(F.filter(F.array_distinct(expansion), fits), 1, most)


def first_number(text: Column) -> Column:
    """The first run of Arabic digits, else the smallest Chinese digit in the text."""
    arabic = F.regexp_extract(text, "[0-9]+", 0)
    chinese = F.coalesce(*[F.when(F.contains(text, F.lit(d)), F.lit(n)) for n, d in enumerate(DIGITS, 1)])
    return F.when(arabic != "", arabic.try_cast("long")).otherwise(chinese.cast("long"))


def band_of(text: Column) -> Column:
    n = first_number(text)
    return F.when(n == 0, None).when(n <= 2, "H1").when(n <= 4, "H2").when(n <= 6, "H3").when(n <= 9, F.concat(F.lit("H4G"), n.cast("string")))


def ordinal_of(text: Column) -> Column:
    """The number of a Chinese ordinal up to 99 (十 is ten), or of Arabic digits; null for anything else."""
    one = lambda c: F.instr(F.lit(DIGITS), c)
    tens, units = F.regexp_extract(text, f"^([{DIGITS}]?)十", 1), F.regexp_extract(text, f"十([{DIGITS}]?)$", 1)
    value = F.when(tens == "", 1).otherwise(one(tens)) * 10 + F.when(units == "", 0).otherwise(one(units))
    return F.when(text.rlike("^[0-9]{1,9}$"), text.try_cast("int")).when(text.rlike(f"^[{DIGITS}]?十[{DIGITS}]?$"), value).when(text.rlike(f"^[{DIGITS}]$"), one(text))


def code_parts(code: Column) -> Column:
    """subject, stage, domain, sequence (null unless three digits) and whether the code has the four parts."""
    part = F.split(code, "-")
    seq = F.element_at(part, -1)
    get = lambda i: F.get(part, F.lit(i))
    return F.struct(get(0).alias("subject"), get(1).alias("stage"), get(2).alias("domain"), F.when(seq.rlike("^[0-9]{3}$"), seq).alias("sequence"), ((F.size(part) == 4) & seq.rlike("^[0-9]{3}$")).alias("canonical"))


def keywords_of(text: Column, stop: list[str], most: int = 80) -> Column:
    """Terms, each followed by the overlapping pairs of its Han characters where these are four or more; stop words go last."""
    def each(t):
        han = F.regexp_replace(t, "[^一-鿿]", "")
        pairs = F.transform(F.sequence(F.lit(1), F.length(han) - 1), lambda i: F.substr(han, i, F.lit(2)))
        return F.concat(F.array(t), F.when(F.length(han) >= 4, pairs).otherwise(F.array().cast("array<string>")))

    all_ = F.array_distinct(F.flatten(F.transform(terms(text, []), each)))
    return F.slice(F.filter(all_, lambda t: ~F.array_contains(strings(stop), t)) if stop else all_, 1, most)


def merge_constraint(explicit: Column, from_text: Column, from_model: Column) -> Column:
    """The values that hold (an explicit request before the text before the model) and whether text and model disagree."""
    inferred = F.when(F.size(from_text) > 0, from_text).otherwise(from_model)
    value = F.when(F.size(explicit) > 0, F.array_distinct(explicit)).otherwise(F.array_distinct(inferred))
    conflict = (F.size(from_text) > 0) & (F.size(from_model) > 0) & ~F.arrays_overlap(from_text, from_model)
    return F.struct(value.alias("value"), F.coalesce(conflict, F.lit(False)).alias("conflict"), F.when(conflict, F.when(F.size(explicit) > 0, "explicit_request_wins").otherwise("explicit_query_wins")).alias("resolution"))


def humanized(bands: Column, subjects: Column, gone: Column, topics: Column) -> Column:
    """A sentence that says what is looked for."""
    label = lambda names: lambda x: F.coalesce(F.element_at(F.create_map(*[F.lit(v) for kv in names.items() for v in kv]), x), x)
    join = lambda c, names: F.array_join(F.transform(c, label(names)), "、")
    parts = F.array_compact(F.array(
        F.when(F.size(bands) > 0, join(bands, BAND_LABELS)),
        F.when(F.size(subjects) > 0, F.concat(F.lit("学科为"), join(subjects, SUBJECT_LABELS))),
        F.when(F.size(gone) > 0, F.concat(F.lit("排除"), join(gone, SUBJECT_LABELS))),
        F.when(F.size(topics) > 0, F.concat(F.lit("主题为"), F.array_join(F.slice(topics, 1, 4), "、"))),
    ))
    return F.when(F.size(parts) > 0, F.concat(F.lit("我理解你要查找"), F.array_join(parts, "，"), F.lit("的课程标准。"))).otherwise(F.lit("我会根据你的自然语言描述查找课程标准。"))
