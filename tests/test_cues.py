"""Cue rules and predicates against a plain loop over all pairs."""

import random
import re
import unicodedata

from tessella.operators import cues as C


def holds(cue, s, t):
    if cue not in C.PAIRS or (cue in C.OUT and re.search(C.OUT[cue], s)):
        return False
    met = [bool(re.search(a, s) and re.search(b, t)) for a, b in C.PAIRS[cue]]
    if not (all(met) if cue in C.EACH else any(met)):
        return False
    return cue != "calculate" or bool(set(re.findall(C.AMOUNTS, s)) & set(re.findall(C.AMOUNTS, t)))


def plain(sources, targets, most=3):
    out = {}
    for block, source, s in sources:
        scored = []
        for b, target, code, t in targets:
            if b is None or b != block or (code in C.CONTEXTS and not re.search(C.CONTEXTS[code], s or "")):
                continue
            letters = [c for c in unicodedata.normalize("NFKC", t or "") if unicodedata.category(c)[0] in "LN"]
            best = (0, None)
            for cue, (a, z, score, alone, preferred) in C.RULES.items():
                if re.search(a, s or "") and re.search(z, t or ""):
                    got = min(0.98, score + (0.035 if preferred and re.search(preferred, code or "") else 0) + min(0.045, 0.45 / max(1, len(letters))))
                    if got > best[0]:
                        best = (got, cue, alone, holds(cue, s, t))
            if best[1]:
                scored.append((-round(best[0], 9), code is not None, code, target, *best[1:]))
        for rank, (score, _, code, target, cue, alone, ok) in enumerate(sorted(scored, key=lambda x: (x[0], x[1], x[2] or "", x[3]))[:most], 1):
            out[source, rank] = (target, code, cue, -score, alone, ok)
    return out


def words():
    text = "".join(r[0] + "|" + r[1] + "|" for r in C.RULES.values()) + "".join(p for ps in C.PAIRS.values() for pair in ps for p in pair)
    return sorted(set(re.findall(r"[一-鿿]{2,}|[a-z]{4,}", text))) + ["计算机", "计算", "速度", "路程", "同学发言", "听同学汇报", "说明方法", "选择准确语言", "介绍事物", "ＲＥＡＤ", "①", " ", "花", "。"]


def test_best_targets_equal_all_pairs(spark):
    rng = random.Random(11)
    bag, codes = words(), [*C.CONTEXTS, "CN-D3-CM-001", "CN-D3-CM-002", "CN-D3-RE-001", "X", None]
    text = lambda: "".join(rng.choice(bag) for _ in range(rng.randrange(6)))
    sources = [(rng.choice("ab"), k, text()) for k in range(150)] + [("a", 900, None), (None, 901, "朗读"), ("c", 902, "朗读"), ("a", 903, "花" * 100000 + "朗读课文")]
    targets = [(rng.choice("ab"), k, rng.choice(codes), text()) for k in range(150)] + [("a", 900, "X", None), (None, 901, "X", "朗读"), ("a", 902, "X", "朗读" + "花" * 100000)]
    s = spark.createDataFrame([(*r, "class") for r in sources], "block string, source int, text string, class string")
    t = spark.createDataFrame([(*r, "cue") for r in targets], "block string, target int, code string, text string, cue string")
    got = {(r.source, r["rank"]): (r.target, r.code, r.cue, round(r.score, 9), r.alone, r.compatible) for r in C.best_targets(s, t).collect()}
    want = plain(sources, targets)
    assert got == want and len({v[2] for v in want.values()}) > 10 and {v[5] for v in want.values()} == {True, False}
    assert C.best_targets(s.where("false"), t).collect() == [] and C.best_targets(s, t.where("false")).collect() == []


def test_scores_are_of_classes(spark):
    s = spark.createDataFrame([("a", k, "朗读课文") for k in range(50)], "block string, source int, text string")
    t = spark.createDataFrame([("a", k, "X", "朗读") for k in range(50)], "block string, target int, code string, text string")
    assert C.class_scores(C.passages(s), C.aims(t)).count() == 1
    got = C.best_targets(s, t, 2).collect()
    assert len(got) == 100 and {(r["rank"], r.target) for r in got} == {(1, 0), (2, 1)}
