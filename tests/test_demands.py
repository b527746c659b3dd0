"""Hard cases and difficulties against a plain loop over rules and clauses."""

import hashlib
import random
import re

from tessella.operators import demands as D


def short(*parts):
    return hashlib.sha256("␟".join(map(str, parts)).encode()).hexdigest()[:16]


def plain_cases(key, text, parts):
    text = re.sub(r"\s+", " ", text or "").strip(" ")
    met = [r for r, (p, _, _) in D.DEMANDS.items() if re.search(p, text)]
    out = []
    for no, rule in enumerate(met or ["combined_performance" if len(parts) > 1 else "independent_core_performance"], 1):
        pattern, title = (D.DEMANDS[rule][0], D.DEMANDS[rule][1]) if met else ("$^", D.WHOLE[rule][0])
        tied = [n for n, label in parts if re.search(pattern, label)] or [n for n, _ in parts[:3]]
        words = [t for t in D.LIMITS if t in text and re.search(pattern, t)]
        words += [a for a in dict.fromkeys(re.findall(D.QUANTITY, text)) if re.search(pattern, a) and a not in words]
        out.append((no, rule, tied, words, f"{title}（{'、'.join(words)}）" if words else "；".join(label for _, label in parts[:3]), 0.7 if met else 0.58, "hc_" + short(key, rule, no)))
    return out


def plain_difficulties(key, text, parts):
    text = re.sub(r"\s+", " ", text or "").strip(" ")
    met = [r for r, p in D.DIFFICULTIES.items() if re.search(p, text)]
    hard, out = plain_cases(key, text, parts), []
    for no, rule in enumerate(met or [D.UNSTABLE], 1):
        tied = [n for n, label in parts if met and re.search(D.DIFFICULTIES[rule], label)] or [parts[min(no, len(parts)) - 1][0]]
        out.append((no, rule, tied, dict(parts)[tied[0]], [h[6] for h in hard if set(h[2]) & set(tied)], 0.66 if met else 0.54, "cd_" + short(key, rule, no)))
    return out


def test_rules_equal_a_plain_loop(spark):
    rng = random.Random(3)
    words = [*D.LIMITS, "说明书", "说明文", "说明", "先看", "再做", "然后", "既快", "又好", "300字", "3 — 5次", "12件以上", "运用", "写", "概念", "x", " ", "的", "花"]
    texts, parts = {}, {}
    for key in range(300):
        parts[key] = [(n, "".join(rng.choice(words) for _ in range(rng.randrange(1, 4)))) for n in range(1, rng.randrange(2, 7))]
        texts[key] = "，".join(label for _, label in parts[key]) if rng.random() < 0.8 else rng.choice(["", None, "花", "x\n x"])
    texts[900], parts[900] = "说明书说明文", [(1, "花")]
    texts[901], parts[901] = "12件以上12件以上，先" + "花" * 100000 + "再", [(1, "花"), (2, "花")]
    t = spark.createDataFrame([*texts.items(), (902, "没有从句")], "id int, text string")
    c = spark.createDataFrame([(k, n, label) for k, v in parts.items() for n, label in v], "id int, no int, label string")
    got = {k: [] for k in texts}
    for r in D.cases(t, c, "id", "text").orderBy("id", "no").collect():
        got[r.id].append((r.no, r.rule, r.components, r.limits, r.structure, r.confidence, r.case_id))
    assert got == {k: plain_cases(k, texts[k], parts[k]) for k in texts}
    assert [g[1] for g in got[900]] == ["independent_core_performance"] and [g[1] for g in got[901]] == ["multi_step", "quantitative_threshold"]
    found = {k: [] for k in texts}
    for r in D.difficulties(t, c, "id", "text").orderBy("id", "no").collect():
        found[r.id].append((r.no, r.category, r.components, r.target, r.cases, r.confidence, r.difficulty_id))
    assert found == {k: plain_difficulties(k, texts[k], parts[k]) for k in texts}
    assert D.difficulties(t.where("false"), c, "id", "text").collect() == []
