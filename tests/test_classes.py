"""Pairs by classes against all pairs, and on copies so many that pairs of rows would never end."""

import itertools
import random
import re

import pytest
from pyspark.sql import functions as F

from tessella.operators import classes, matching, resolve


def test_expanded_and_best_equal_all_pairs(spark, monkeypatch):
    monkeypatch.setattr(classes, "CHUNK", 3)
    rng = random.Random(3)
    rows = [(k, rng.choice(["x", "y", None]), rng.randrange(4)) for k in rng.sample(range(100), 40)]
    one, members = classes.grouped(spark.createDataFrame(rows, "id int, g string, v int"), "id", ["g", "v"])
    assert {r.id: r.size for r in one.collect()} == {min(c): len(c) for c in ([i for i, *x in rows if x == [g, v]] for _, g, v in rows)}
    pairs = one.select(F.col("id").alias("a"), "g", F.col("v").alias("va")).join(one.select(F.col("id").alias("b"), "g", F.col("v").alias("vb")), "g").where("(va + vb) % 3 <> 2").select("a", "b", ((F.col("va") * F.col("vb")) % 3).alias("score"))
    want = {(a, b, va * vb % 3) for (a, g, va), (b, h, vb) in itertools.permutations(rows, 2) if g == h and g is not None and (va + vb) % 3 != 2}
    assert sorted(tuple(r) for r in classes.expanded(pairs, members, "id").collect()) == sorted(want)
    for most in (1, 2, 3):
        got = {r.a: [tuple(x) for x in r.best] for r in classes.best(pairs, members, members, "id", most).collect()}
        assert got == {i: [(b, s) for s, b in sorted(((s, b) for a, b, s in want if a == i), key=lambda x: (-x[0], x[1]))[:most]] for i, *_ in rows}


def test_soft_pairs_of_many_copies(spark):
    p = spark.range(300_000).select(F.col("id").alias("a"), F.lit("x").alias("g"), F.when(F.col("id") < 2, "rare").otherwise("often").alias("t"))
    out = matching.soft_pairs(p, p.withColumnRenamed("a", "b"), ["g"], {"t": 1}, "a", "b")
    assert sorted(tuple(r) for r in out.where("status = 'matched'").collect()) == [(0, 1, 2, "matched"), (1, 0, 2, "matched")]
    assert out.where("status = 'ambiguous' and b is null and score = 2").count() == 299_998


def test_soft_pairs_equal_all_pairs(spark):
    rng = random.Random(8)
    rows = [(k, rng.choice("xy"), rng.choice(["s", "t", None]), rng.choice(["u", "v", "w", None])) for k in range(40)] + [(99, "z", "s", "u")]
    p = spark.createDataFrame(rows, "a int, g string, t string, u string")
    points = lambda x, y, w: w if x is None or y is None else 2 * w * (x == y)
    want = {}
    for k, g, t, u in rows:
        scores = [(points(t, t2, 2) + points(u, u2, 1), b) for b, h, t2, u2 in rows if h == g and b != k]
        top = [b for s, b in scores if s == max(scores)[0]]
        want[k] = (top[0] if len(top) == 1 else None, max(scores)[0] if scores else None, "unmatched" if not top else "matched" if len(top) == 1 else "ambiguous")
    got = {r.a: (r.b, r.score, r.status) for r in matching.soft_pairs(p, p.withColumnRenamed("a", "b"), ["g"], {"t": 2, "u": 1}, "a", "b").collect()}
    assert got == want


def test_contents_of_many_copies_are_matched_once(spark):
    ids = spark.range(300_000)
    e = ids.select(F.col("id").alias("a"), F.lit("x").alias("g"), F.when(F.col("id") == 7, "1.1 rare title").otherwise("1.1 common title").alias("title"), F.lit(1).alias("page"))
    c = ids.select(F.col("id").alias("b"), F.lit("x").alias("g"), F.when(F.col("id") == 9, "1.1 rare title").otherwise("1.1 common title").alias("entry"), F.lit(1).alias("at"))
    assert [tuple(r) for r in matching.toc_match(e, c, ["g"], "a", "b").collect()] == [(7, 9, 120)]


def test_queries_on_a_part_that_has_many_copies(spark, tmp_path):
    """Two kinds of parts in one block, 100,000 rows: 10**10 pairs of rows."""
    from tessella.plans.registry import QUERIES

    p = spark.range(100_000).select(F.col("id").alias("p_partkey"), F.when(F.col("id") % 2 == 0, "blue bolt").otherwise("blue ring").alias("p_name"), F.lit("Brand#1").alias("p_brand"), F.lit("SMALL").alias("p_type"), F.lit(5).alias("p_size"))
    p.write.parquet(f"{tmp_path}/part.parquet")
    run = lambda name: QUERIES[name](spark, str(tmp_path))
    assert [tuple(r) for r in run("bridge_score").where("a in (0, 1, 2)").orderBy("a").select("a", "b", "margin_1e4").collect()] == [(0, 2, 0), (1, 3, 0), (2, 0, 0)]
    assert [tuple(r) for r in run("component_alignment").where("a = 2").orderBy("k").select("b", "k").collect()] == [(0, 1), (4, 2), (6, 3)]
    assert [tuple(r) for r in run("block_similarity_topk").where("a = 3").orderBy("k").select("b", "k").collect()] == [(1, 1), (5, 2), (7, 3)]
    assert [tuple(r) for r in run("bridge_margin").where("a = 1").select("b", "margin", "confidence").collect()] == [(3, 0.0, "medium")]
    assert [tuple(r) for r in run("differentiation").collect()] == [("Brand#1", 0, 100_000, 2, "needs_differentiation")]


@pytest.mark.parametrize("name", ["weighted_token_score", "idf_unit_score", "overlap_coeff", "jaccard_pairs", "neighbors_same_group"])
def test_pairs_of_rows_are_spread_out_last(spark, name):
    """Above the first exchange of the plan stands the step that makes pairs of rows of lists: pairs are never shuffled."""
    from tessella.plans.registry import QUERIES

    plan = QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().sparkPlan().toString()
    top = plan[: plan.index("Join")]
    assert top.count("Generate explode") == (1 if name == "neighbors_same_group" else 2) and "Aggregate" not in top


def test_rows_meet_a_list_of_neighbours_at_a_time(spark, monkeypatch):
    """All rows of a group meet a list before the next one: neither a task nor a stretch of a file has a whole group."""
    monkeypatch.setattr(resolve, "LIST", 5)
    rows = [(k, "x" if k < 60 else None if k < 70 else "y") for k in range(80)]
    df = spark.createDataFrame(rows, "id long, g string")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        got = [tuple(r) for r in resolve.same_group(df, ["g"], "id", df.where("id % 2 = 0")).collect()]
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert sorted(got) == sorted((a, b) for (a, g), (b, h) in itertools.product(rows, rows) if g == h and g and a != b and a % 2 == 0)
    runs = [{b for _, b in run} for a, run in itertools.groupby(got, key=lambda r: r[0])]
    assert len(runs) > 3 * 35 and max(map(len, runs)) < 20


def test_jaccard_pairs_are_not_made_distinct(spark):
    """A pair comes out of the join once, so that no task holds the pairs it has met."""
    rows = [(k, "g", sorted({f"t{(k * j) % 7}" for j in range(1, 6)})) for k in range(30)]
    left = spark.createDataFrame(rows, "a int, g string, tokens array<string>")
    out = matching.jaccard_join(left, left.withColumnRenamed("a", "b"), ["g"], 3, 5)
    want = [(a, b, len({*x} & {*y}), len(x), len(y)) for (a, _, x), (b, _, y) in itertools.product(rows, rows) if len({*x} & {*y}) * 5 >= 3 * len({*x} | {*y})]
    assert sorted(tuple(r) for r in out.collect()) == sorted(want)
    plan = out._jdf.queryExecution().sparkPlan().toString()
    assert "Aggregate" not in plan[: plan.index("Join")] and not re.search(r"Aggregate\(keys=\[a#\d+, b#\d+\]", plan)


@pytest.mark.parametrize("name", ["lexical_component", "content_grams"])
def test_equal_texts_are_worked_on_once(spark, name):
    """The texts are made distinct below the expensive step and joined to the rows above it."""
    from tessella.plans.registry import QUERIES

    plan = QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Join") < plan.index("Aggregate") and "regexp" not in plan[: plan.index("Join")]


def test_texts_are_worked_on_once(spark):
    seen = spark.sparkContext.accumulator(0)

    def count(it):
        for b in it:
            seen.add(b.num_rows)
            yield b

    rows = spark.createDataFrame([(i, [None, "a", "b"][i % 3]) for i in range(90)], "id long, t string")
    got = classes.once(rows, ["t"], lambda t: t.mapInArrow(count, "t string").selectExpr("t", "coalesce(t, 'none') as u"), 4).collect()
    assert sorted((r.id, r.t, r.u) for r in got) == [(i, [None, "a", "b"][i % 3], ["none", "a", "b"][i % 3]) for i in range(90)] and seen.value == 3
