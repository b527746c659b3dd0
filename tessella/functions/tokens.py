"""Tokenizers and small text rules of matching, as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Tokens that match nothing, characters that no token begins or ends with, and broad labels.
MATCH_STOP = [
    "义务", "教育", "教科", "教科书", "教材", "课程", "标准", "年级", "上册", "下册", "全一册", "学生", "学习", "活动", "能够", "通过",
    "理解", "认识", "了解", "掌握", "运用", "形成", "发展", "进行", "目录", "语文", "英语", "数学", "科学", "化学", "物理", "生物",
    "地理", "历史", "艺术", "音乐", "美术", "体育", "劳动", "七年级", "八年级", "九年级",
]
WEAK_EDGES = ["与", "的", "和", "中", "及", "或", "并", "在", "为", "对", "到", "从"]
BROAD_LABELS = ["第四学段目标", "课程目标", "水平四内容结构"]
ALIGN_STOP = [
    "义务", "教育", "教科", "教科书", "教材", "课程", "标准", "年级", "上册", "下册", "全一册", "学生", "学习", "活动", "能够", "能在", "通过",
    "理解", "认识", "了解", "掌握", "运用", "形成", "发展", "进行", "尝试", "体验", "知道", "可以", "相关", "基本", "初步", "要求", "内容", "任务",
    "目录", "语文", "英语", "数学", "科学", "化学", "物理", "生物", "地理", "历史", "艺术", "音乐", "美术", "体育", "劳动", "健康", "单元", "章节", "部分",
]
GRAM_STOP = [
    "学生", "能够", "学习", "课程", "教材", "内容", "活动", "进行", "通过", "基本", "初步", "相关", "要求", "可以", "课文", "单元", "年级", "本的",
    "自己的", "出自己的", "提出自己", "提出自己的", "表达自己的", "中有", "the", "and", "with", "from", "that", "this",
]
STOP_PHRASES = [
    "学生", "能够", "能用", "能在", "能对", "能从", "能通过", "理解", "认识", "掌握", "学习", "进行", "形成", "初步", "相关", "运用", "知道", "了解", "说明",
    "基本", "要求", "年级", "学段",
]
# Numbers of headings, and what kind of line or clause a text is.
HEADING_NUMBER = r"(?i)^(?:第[一二三四五六七八九十百0-9]+[章节课单元]|(?:starter\s+)?unit\s+[a-z]?[0-9]+|module\s+[a-z]?[0-9]+|[0-9]++(?:\.[0-9]++)*+)\s*"
HEADING = r"^(?:第[一二三四五六七八九十百0-9]+[章节课单元]|Unit\s+[0-9]+|[0-9]++(?:\.[0-9]++)++)"
TASK = r"^(?:学习目标|目标|活动|练习|习题)"
CLAUSE = r"[，。；;：:]|与|并"


def strings(values: list[str]) -> Column:
    return F.array(*map(F.lit, values))


def normalized(c: Column) -> Column:
    out = F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), "[，。！？；：、“”‘’（）《》【】]", " ")
    return F.trim(F.regexp_replace(F.regexp_replace(out, r"[^\p{L}\p{N}]+", " "), r"\s+", " "))


def grams(word: Column, low: int, high: int) -> Column:
    def of(n):
        at = F.sequence(F.lit(1), F.length(word) - (n - 1))
        return F.when(F.length(word) >= n, F.transform(at, lambda i: F.substr(word, i, F.lit(n)))).otherwise(F.array().cast("array<string>"))

    return F.concat(*map(of, range(low, high + 1)))


def parts(c: Column) -> Column:
    return F.filter(F.split(c, " "), lambda w: ~w.rlike("^[0-9]*$"))


def match_tokens(c: Column) -> Column:
    stop, weak = strings(MATCH_STOP), strings(WEAK_EDGES)
    each = F.transform(parts(normalized(c)), lambda w: F.concat(F.array(w), F.when(w.rlike(r"\p{IsHan}"), grams(w, 2, 4)).otherwise(F.array().cast("array<string>"))))
    keep = lambda t: (F.length(t) >= 2) & ~F.array_contains(stop, t) & ~F.array_contains(weak, F.left(t, F.lit(1))) & ~F.array_contains(weak, F.right(t, F.lit(1)))
    return F.array_distinct(F.filter(F.flatten(each), keep))


def align_tokens(c: Column) -> Column:
    stop, none = strings(ALIGN_STOP), F.array().cast("array<string>")
    body = F.trim(F.regexp_replace(F.regexp_replace(F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), HEADING_NUMBER, ""), r"[^\p{L}\p{N}]+", " "), r"\s+", " "))
    word = lambda w: F.when((F.length(w) >= 3) & ~F.array_contains(stop, w), F.array(w)).otherwise(none)
    return F.array_distinct(F.flatten(F.transform(parts(body), lambda w: F.when(w.rlike(r"\p{IsHan}"), F.filter(grams(w, 2, 6), lambda g: ~F.array_contains(stop, g))).otherwise(word(w)))))


def content_grams(c: Column) -> Column:
    stop = strings(GRAM_STOP)
    compact = F.replace(normalized(c), F.lit(" "), F.lit(""))
    return F.array_distinct(F.filter(F.concat(F.regexp_extract_all(normalized(c), F.lit("[a-z][a-z0-9-]{2,}"), F.lit(0)), F.filter(grams(compact, 2, 5), lambda g: ~g.rlike("^[0-9]+$"))), lambda g: ~F.array_contains(stop, g)))


def stop_phrase_pairs(c: Column) -> Column:
    s = F.regexp_replace(F.regexp_replace(F.coalesce(c, F.lit("")), "|".join(STOP_PHRASES), ""), r"[^\p{L}\p{N}]", "")
    return F.array_distinct(grams(s, 2, 2))


def plain_tokens(c: Column) -> Column:
    return F.regexp_extract_all(F.lower(F.coalesce(c, F.lit(""))), F.lit("[一-鿿]{2,}|[a-z0-9_.-]+"), F.lit(0))


def excerpt(c: Column, most: int = 180) -> Column:
    return F.when(F.length(c) > most, F.concat(F.substring(c, 1, most), F.lit("…"))).otherwise(c)


def line_kind(c: Column) -> Column:
    return F.when((F.trim(c) == "") | F.contains(c, F.lit("目录")), "noise").when(c.rlike(HEADING), "heading").when(c.rlike(TASK), "task").otherwise("body")


def anchors(c: Column) -> Column:
    """The parts of a label of two characters or more between connectives; none of a broad label."""
    broad = strings(BROAD_LABELS)
    out = F.filter(F.transform(F.split(F.replace(c, F.lit(" "), F.lit("")), "[与和及、，,/（）()的]"), lambda x: F.trim(x)), lambda x: (F.length(x) >= 2) & ~F.array_contains(broad, x))
    return F.when(F.array_contains(broad, c), F.array().cast("array<string>")).otherwise(out)


def modifiers_conflict(a: Column, b: Column) -> Column:
    """Both texts have modifiers of one family (unknowns, degree, dimension) and none in common."""
    out = F.lit(False)
    for x in "元次维":
        p, q = (F.regexp_extract_all(c, F.lit(f"[一二三]{x}"), F.lit(0)) for c in (a, b))
        out = out | ((F.size(p) > 0) & (F.size(q) > 0) & ~F.arrays_overlap(p, q))
    return out


def evident(span: Column, source: Column) -> Column:
    """Whether a span stands in its source, dashes and case aside."""
    same = lambda c: F.lower(F.replace(c, F.lit("—"), F.lit("-")))
    return F.contains(same(source), same(span))


def clauses(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, no, clause, kind)."""
    split = F.filter(F.transform(F.split(text, CLAUSE), lambda x: F.trim(x)), lambda x: x != "")
    kind = F.when(F.col("clause").rlike("方程|图形|三角形"), "concept").when(F.col("clause").rlike("实验|鉴赏|reading|writing|Reading"), "practice").otherwise("knowledge")
    return df.select(key, F.posexplode(split).alias("at", "clause")).select(key, (F.col("at") + 1).alias("no"), "clause", kind.alias("kind"))


def filter_group(field: str, values: Column) -> Column:
    """(field = "a" OR field = "b"), quotes and backslashes escaped."""
    quoted = lambda v: F.regexp_replace(v, r'(["\\])', r"\\$1")
    return F.concat(F.lit("("), F.array_join(F.transform(values, lambda v: F.concat(F.lit(f'{field} = "'), quoted(v), F.lit('"'))), " OR "), F.lit(")"))


def rewrite_codes(df: DataFrame, key: str, refs: str, codes: DataFrame, old: str, new: str) -> DataFrame:
    """(key, refs): each token between | or line breaks replaced through codes(old, new), spaces and delimiters kept."""
    token = df.select(key, F.posexplode(F.regexp_extract_all(refs, F.lit(r"[^\n|]+|[\n|]"), F.lit(0))).alias("pos", "tok"))
    known = token.join(codes.select(F.col(old).alias("_old"), F.col(new).alias("_new")), F.trim("tok") == F.col("_old"), "left")
    put = F.when(F.col("_new").isNull(), F.col("tok")).otherwise(F.replace(F.col("tok"), F.trim("tok"), F.col("_new")))
    return known.groupBy(key).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", put.alias("t")))), lambda x: x["t"]), "").alias(refs))


def toc_line(lines: DataFrame, key: str, line: str) -> DataFrame:
    """(key, title, page) of lines of a table of contents."""
    plain = F.translate(line, "０１２３４５６７８９", "0123456789")
    tail = r"[.…·]{2,}\s*([0-9]+)$"
    return lines.select(key, F.trim(F.regexp_replace(plain, tail, "")).alias("title"), F.regexp_extract(plain, tail, 1).try_cast("int").alias("page"))


def ranked_rules(c: Column, rules: dict[str, list[str]]) -> Column:
    """The names whose words occur in a text, by number of occurrences, then by name."""
    times = lambda w: F.floor((F.length(c) - F.length(F.replace(c, F.lit(w), F.lit("")))) / len(w))
    hits = F.array(*[F.struct((-sum((times(w) for w in words), F.lit(0))).alias("minus"), F.lit(name).alias("name")) for name, words in rules.items()])
    return F.transform(F.array_sort(F.filter(hits, lambda h: h["minus"] < 0)), lambda h: h["name"])
