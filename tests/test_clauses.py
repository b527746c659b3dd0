"""Clauses with borrowed objects against a plain loop."""

import random
import re

import pytest

from tessella.operators import clauses as C

VERB = "|".join(C.VERBS)


def compact(t):
    return re.sub(r"\s+", " ", t or "").strip(" ")


def label(t):
    t = re.sub(r"[，,；;。\s]+$", "", compact(t))
    for _ in range(3):
        for head in (r"[，,；;。\s]+", r"学生(?:能够|能|会)\s*", rf"(?:{C.ABLE})\s*", rf"(?:{C.JOINED})\s*"):
            t = re.sub(f"^{head}", "", t)
    return t.strip(" ")


def thing(t):
    t = re.sub(rf"^(?:{C.OBJECT_ADVERBS})\s*", "", compact(t))
    verb = next((v for v in C.VERBS if t.startswith(v)), "")
    return re.sub(C.PURPOSE, "", re.split("[，,；;]", t[len(verb) :])[0]).strip(" ")


def acts(t):
    t = re.sub(rf"^(?:{C.ACTION_ADVERBS})\s*", "", label(t))
    return any(t.startswith(v) for v in C.VERBS)


def plain(text):
    whole = compact(text)
    intro = re.match(r"^[^：:]{2,18}[：:]\s*(.+)$", whole)
    if intro and re.search(VERB, intro[1]):
        whole = intro[1]
    found = []
    for sentence in re.split("[；;。\n]+", whole):
        sentence, condition = sentence.strip(" "), ""
        if not sentence or re.match("^[（(].*[）)]$", sentence):
            continue
        for piece in re.split(f"，(?=(?:并|且|同时|还要)?(?:{C.ABLE}|{VERB}))|(?:并且|并|且|以及)(?=(?:{C.ABLE})?(?:{VERB}))", sentence):
            if re.match(rf"^(?:{C.ABLE})\s*以及", compact(piece)):
                continue
            part = label(piece)
            lead = re.match(C.SETTING, part)
            if lead and acts(lead[2]):
                condition, part = lead[1], label(lead[2])
            if (re.search(C.CONDITION_END, part) and not acts(part)) or (re.match(f"^(?:{C.METHOD})", part) and not re.search(VERB, part)):
                condition = part
            elif len(part) >= 2 and not re.match(C.LEFTOVER, part) and not re.match("^[（(].*[）)]$", part) and (part, condition) not in [f[:2] for f in found]:
                found.append((part, condition, compact((condition + "，" if condition else "") + part)))
    out = []
    for k, (part, condition, source) in enumerate(found):
        after = found[k + 1][0] if k + 1 < len(found) else None
        if re.match(C.BARE, part) and after and len(thing(after)) >= 2:
            source, part = compact((condition + "，" if condition else "") + part + "并" + after), part + thing(after)
        out.append([part, condition, source])
    first = [o[0] for o in out]
    for k, o in enumerate(out):
        if re.match(C.BARE, o[0]):
            for before in reversed(first[:k]):
                if len(thing(before)) >= 3 and not re.match(C.BARE, thing(before)):
                    o[0], o[2] = o[0] + thing(before), whole
                    break
    return [tuple(o) for o in out] or [(label(whole), "", label(whole))]


def got(spark, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    out = {}
    for r in C.components(df, "id", "text").orderBy("id", "no").collect():
        out.setdefault(r.id, []).append((r.label, r.condition, r.source))
    return [out[k] for k in range(len(texts))]


CASES = {
    "能够理解并掌握分数的意义。": [("理解分数的意义", "", "理解并掌握分数的意义"), ("掌握分数的意义", "", "掌握分数的意义")],
    "在解决实际问题的过程中，能计算面积，并说明理由": [("计算面积", "在解决实际问题的过程中", "在解决实际问题的过程中，计算面积"), ("说明理由", "在解决实际问题的过程中", "在解决实际问题的过程中，说明理由")],
    "阅读文学作品；理解": [("阅读文学作品", "", "阅读文学作品"), ("理解文学作品", "", "阅读文学作品；理解")],
    "学习要求：学生能够观察植物的生长，记录": [("观察植物的生长", "", "观察植物的生长"), ("记录植物的生长", "", "学生能够观察植物的生长，记录")],
    "（选学）": [("（选学）", "", "（选学）")],
    "的": [("的", "", "的")],
}


@pytest.mark.parametrize("text", CASES)
def test_plain_loop_gives_what_is_expected(text):
    assert plain(text) == CASES[text]


def test_clauses_equal_a_plain_loop(spark):
    rng = random.Random(7)
    words = [*C.VERBS[:70:3], *"理解 掌握 分析 比较 并 并且 且 以及 能 能够 会 尝试 初步 认真 学生能 ， ， ， 。 ； , 在活动中 在学习过程中 通过实验 根据材料 围绕主题 结合生活 数量关系 植物的生长 文本 词 的 时 进行交流 用于生活 （选学） 要求： x ".split(" "), "\n", "  "]
    texts = [*CASES, None, "", " ", "。；", *["".join(rng.choice(words) for _ in range(rng.randrange(1, 30))) for _ in range(600)]]
    texts += ["理解，" * 3000 + "分析数量关系", "并" * 100000, "在" + "x" * 100000 + "中，说明"]
    assert got(spark, texts) == [plain(t) for t in texts]
    empty = spark.createDataFrame([], "id int, text string")
    assert C.components(empty, "id", "text").collect() == []


@pytest.mark.parametrize("name", ["borrowed_objects", "hard_cases", "learner_difficulties"])
def test_statements_are_not_sent_through_the_driver(spark, name):
    """However small the file, no join broadcasts its side: texts and pieces are many more bytes than their file. Clauses are found once."""
    from tessella.plans.registry import QUERIES

    plan = QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "Join" in plan and "Broadcast" not in plan
    assert plan.count("FileScan") <= (2 if name == "borrowed_objects" else 3)


def test_texts_without_clauses_among_others(spark):
    """A text whose pieces are no clauses is one by itself, with its own words; pieces that are dropped have no condition."""
    rows = [(1, "以及。在活动中。"), (2, "能以及描述花；，"), (3, None), (4, "比较花。以及"), (5, "能以及在实验中，观察花，比较叶")]
    got = sorted((r.id, r.no, r.label, r.condition, r.source) for r in C.components(spark.createDataFrame(rows, "id int, text string"), "id", "text").collect())
    whole = [(1, 1, "在活动中"), (2, 1, "描述花"), (3, 1, ""), (4, 1, "比较花"), (5, 1, "观察花"), (5, 2, "比较叶")]
    assert got == [(*w, "", w[2]) for w in whole]
