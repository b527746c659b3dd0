"""Progression graphs against a plain loop over records."""

from collections import deque

from tessella.operators import progression

BANDS = progression.BANDS


def plain(records, bridges):
    by = {(s, str(c).upper()): (c, b) for c, s, b, *_ in records}
    edges = {}

    def put(a, b, *edge):
        if a != b:
            edges[a, b] = edge

    grade = lambda x, y: "grade_progression" if (x or "").startswith("H4") and (y or "").startswith("H4") else "stage_progression"
    for c, s, b, _, onward, back in sorted(records, key=lambda r: r[3]):
        for ref in onward or []:
            if t := by.get((s, (ref or "").strip().upper())):
                put(c, t[0], grade(b, t[1]), "declared")
        for ref in back or []:
            if t := by.get((s, (ref or "").strip().upper())):
                put(t[0], c, grade(t[1], b), "declared")
        if b == "H4G7":
            for _, _, ref, sure in sorted(x for x in bridges if x[0] == c):
                if t := by.get((s, ref.strip().upper())):
                    put(t[0], c, "inferred_stage_bridge", sure or "low")
    out = {}
    for c, s, *_ in records:
        seen, todo = {c}, deque([c])
        while todo:
            x = todo.popleft()
            for a, b in edges:
                for y in ([b] if a == x else []) + ([a] if b == x else []):
                    if y not in seen:
                        seen.add(y)
                        todo.append(y)
        own = [e for (a, b), e in edges.items() if a in seen]
        bridge = [e for e in own if e[0] == "inferred_stage_bridge"]
        low = sum(e[1] == "low" for e in bridge)
        bands = [r[2] for r in records if r[0] in seen]
        counts = [bands.count(b) for b in BANDS]
        alone = counts[2] and not any(counts[3:]) and any((r[2] or "").startswith("H4") for r in records if r[1] == s)
        warnings = ["no_relations"] * (not own) + (["low_bridges"] if low else ["bridges"] if bridge else []) + ["no_bridge_to_h4"] * bool(alone)
        out[c] = (min(seen), "not_available" if not own else "partial" if bridge else "available", len(seen), len(own), *counts, len(bridge), low, warnings)
    return edges, out


def test_progressions_of_all_records_equal_a_plain_loop(spark):
    records = [("a1", "m", "H1", 1, ["A2 ", "zz", None, "a1"], None), ("a2", "m", "H2", 2, [], ["a1"]), ("a3", "m", "H3", 3, ["a7"], []), ("a7", "m", "H4G7", 4, ["a8"], []), ("a8", "m", "H4G8", 5, [], ["a7", "a3"]), ("a9", "m", "H4G9", 6, [], []), ("b3", "m", "H3", 7, ["b2"], []), ("b2", "m", "H2", 8, [], []), ("c1", "n", "H3", 9, ["a1"], []), ("c2", "n", None, 10, [], ["c1"]), ("a2x", "m", "H4G7", 11, [], [])]
    bridges = [("a7", 0, "a3", "high"), ("a2x", 0, "a9", None), ("a2x", 1, "a8", "medium"), ("a8", 0, "a1", "high"), ("a2x", 2, "nobody", "low")]
    df = spark.createDataFrame(records, "code string, subject string, band string, ord long, next_refs array<string>, previous_refs array<string>")
    links = progression.edges(df, spark.createDataFrame(bridges, "code string, pos int, ref string, confidence string"))
    edges, want = plain(records, bridges)
    assert {(r.a, r.b): (r.relation, r.confidence) for r in links.collect()} == edges
    got = {r.code: tuple(r)[1:] for r in progression.components(df, links).collect()}
    assert got == {c: (*w[:-1], w[-1]) for c, w in want.items()}
    assert progression.components(df.where("false"), links.where("false")).collect() == []
