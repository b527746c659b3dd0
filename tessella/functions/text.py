"""Text functions as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words that are no topic.
TOPIC_STOP_WORDS = ["学生", "学习", "课程", "标准", "课标", "教学", "相关", "有关", "要求", "目标", "能力", "能够", "通过", "进行", "一个", "一些", "如何", "需要", "适合", "内容", "活动", "任务", "学科", "学段", "年级", "理解", "掌握", "培养", "查找", "寻找", "检索"]
PLAN_STOP_WORDS = ["学生", "学习", "课程", "标准", "课标", "教学", "相关", "能够", "通过", "进行", "一个", "一些", "如何", "需要", "适合", "内容", "活动"]
# Fixed value: what separates terms.
SEPARATORS = r"""[\s,，.。;；:：、/|()\[\]{}"'“”‘’<>《》!?！？—-]+"""
# Personal data rules, in order, with their replacement.
PII_RULES = [
    ("email", r"(?i)\b[A-Z0-9._%+-]+@[A-Z0-9.-]+\.[A-Z]{2,}\b", "[邮箱已移除]"),
    ("phone", r"(?<!\d)(?:\+?86[-\s]?)?1[3-9]\d{9}(?!\d)", "[手机号已移除]"),
    ("national_id", r"(?<!\d)\d{17}[\dXx](?!\d)", "[身份证号已移除]"),
    ("named_identifier", r"(学生姓名|教师姓名|老师姓名|姓名|学校|班级)\s*[:：]\s*[^,，;；。\s]{1,48}", "$1：[已移除]"),
]

PII_HINTS = {
    "email": lambda t: F.contains(t, F.lit("@")),
    "phone": lambda t: t.rlike(r"1[3-9]\d{9}"),
    "national_id": lambda t: t.rlike(r"\d{17}"),
    "named_identifier": lambda t: F.contains(t, F.lit("姓名")) | F.contains(t, F.lit("学校")) | F.contains(t, F.lit("班级")),
}


def compact(c: Column) -> Column:
    return F.trim(F.coalesce(c.cast("string"), F.lit("")))


def pairs(part: Column, step: int) -> Column:
    """Two-character pieces of a text, every `step` characters; none for texts shorter than two."""
    return F.when(F.length(part) >= 2, F.transform(F.sequence(F.lit(1), F.length(part) - 1, F.lit(step)), lambda i: F.substr(part, i, F.lit(2)))).otherwise(F.array().cast("array<string>"))


def terms(c: Column, stop: list[str]) -> Column:
    words = F.array(*map(F.lit, stop))
    return F.filter(F.split(F.trim(F.lower(F.coalesce(c, F.lit("")))), SEPARATORS), lambda t: (F.length(t) >= 2) & ~F.array_contains(words, t))


def topic_tokens(c: Column, most: int = 80) -> Column:
    """Terms without stop words, each all-Han term of 4 or more followed by its disjoint pairs; first-seen order."""
    words = F.array(*map(F.lit, TOPIC_STOP_WORDS))
    each = F.transform(terms(c, TOPIC_STOP_WORDS), lambda t: F.concat(F.array(t), F.when(t.rlike("^[一-鿿]{4,}$"), F.filter(pairs(t, 2), lambda p: (F.length(p) >= 2) & ~F.array_contains(words, p))).otherwise(F.array().cast("array<string>"))))
    return F.slice(F.array_distinct(F.flatten(each)), 1, most)


def plan_tokens(c: Column, most: int = 160) -> Column:
    """Terms without stop words, then all overlapping pairs of the text's Han characters."""
    han = F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), "[^一-鿿]", "")
    return F.slice(F.array_distinct(F.concat(terms(c, PLAN_STOP_WORDS), pairs(han, 1))), 1, most)


def gram_set(c: Column, n: int = 2) -> Column:
    """Distinct n-grams of the letters and digits of a lower-cased text."""
    s = F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), r"[^\p{L}\p{N}]", "")
    return F.when(F.length(s) >= n, F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(s) - (n - 1)), lambda i: F.substr(s, i, F.lit(n))))).otherwise(F.array().cast("array<string>"))


def main_skill(c: Column) -> Column:
    return F.upper(F.split_part(c, F.lit("."), F.lit(1)))


def words_of(c: Column) -> Column:
    """Distinct lower-case ASCII words of 3 letters or more."""
    return F.array_distinct(F.regexp_extract_all(F.lower(F.coalesce(c, F.lit(""))), F.lit("[a-z]{3,}"), F.lit(0)))


def redact(c: Column) -> tuple[Column, Column, Column]:
    """(text, count, categories) after the personal data rules, each on what those before it left."""
    text, count, found = F.coalesce(c, F.lit("")), F.lit(0), []
    for name, pattern, to in PII_RULES:
        # A rule is tried where the text has what each of its matches holds.
        maybe = PII_HINTS[name](text)
        hits = F.when(maybe, F.regexp_count(text, F.lit(pattern))).otherwise(0)
        count = count + hits
        found.append(F.when(hits > 0, F.lit(name)))
        text = F.when(maybe, F.regexp_replace(text, pattern, to)).otherwise(text)
    return text, count, F.array_compact(F.array(*found))


def quality_flags(field: str, c: Column) -> Column:
    """Flags of a field's text, in a fixed order; none for an empty one."""
    t = compact(c)
    end = F.regexp_replace(t, r"[”’」』\])]*$", "")
    short = F.lit(field != "standard") & (F.length(t) < 5)
    stub = F.lit(field == "practice") & (t.rlike("^（[^）]{0,24}｜相关）[；;]?[^，。；;]{0,10}$") | (F.length(t) < 8))
    flags = [
        (F.regexp_count(t, F.lit("[“‘]")) != F.regexp_count(t, F.lit("[”’]")), "unbalanced_quote"),
        (end.rlike("[，,；;：:]$|(结合|例如|比如|以及|通过|并且|其中|包括)$"), "possible_truncation"),
        (t.rlike(r"[；;]\s*(特点|要求|教师|学生|内容)[，,；;]"), "possible_ocr_fragment"),
        (t.rlike(r"\|{2,}|；\s*；|，，|。。"), "broken_delimiter"),
        (stub, "placeholder_or_fragment"),
        (short, "content_too_short"),
    ]
    return F.when(t == "", F.array().cast("array<string>")).otherwise(F.array_compact(F.array(*[F.when(x, F.lit(name)) for x, name in flags])))


def evidence_sentences(c: Column, keywords: Column, most: int = 2) -> Column:
    """The first sentences that hold any keyword."""
    parts = F.filter(F.transform(F.split(F.coalesce(c, F.lit("")), r"[。！？；;\n.!?]"), lambda s: F.trim(s)), lambda s: s != "")
    return F.slice(F.filter(parts, lambda s: F.exists(keywords, lambda k: F.contains(s, k))), 1, most)


def short_id(prefix: str, *cols: Column, size: int = 16) -> Column:
    """prefix_ and the first digits of the SHA-256 of the columns, joined by a unit separator."""
    return F.concat(F.lit(prefix + "_"), F.substring(F.sha2(F.concat_ws("\x1f", *cols), 256), 1, size))


def clamp(c: Column, low, high) -> Column:
    return F.least(F.greatest(c, F.lit(low)), F.lit(high))


def ratio(top: Column, bottom: Column, empty: float = 0.0) -> Column:
    return F.when(bottom == 0, F.lit(empty)).otherwise(top / bottom)
