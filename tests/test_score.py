"""Explained scores and best matches on made tables."""

import random

import pytest
from pyspark.sql import functions as F

from tessella.operators import score, search


def test_best_shared_equals_a_plain_loop(spark, monkeypatch):
    monkeypatch.setattr(score, "STEP", 2)
    rng = random.Random(3)
    words = [f"w{k}" for k in range(40)]
    pick = lambda n: sorted(set(rng.choices(words, weights=[1 / (k + 1) for k in range(40)], k=n)))
    left = [(k, "xy"[k % 2], pick(1 + k % 14), 2 + k % 7) for k in range(60)]
    right = [(k, "xyz"[k % 3], pick(1 + k % 9)) for k in range(200)] + [(7, "y", pick(5)), (None, "x", pick(3)), (500, None, pick(3)), (501, "x", None)]
    want = set()
    for a, block, mine, cap in left:
        hits = {}
        for b, other, theirs in right:
            n = len(set(mine) & set(theirs or ()))
            if other == block and b is not None and n:
                hits[b] = hits.get(b, 0) + n
        want |= {(a, b, cap, -h) for h, b in sorted((-min(cap, h), b) for b, h in hits.items())[:3]}
    lt = spark.createDataFrame(left, "a long, block string, tokens array<string>, cap long")
    rt = spark.createDataFrame(right, "b long, block string, tokens array<string>")
    for first in (10, 1000):
        assert {tuple(r) for r in score.best_shared(lt, rt, ["a"], "block", 3, first).select("a", "b", "cap", "hit").collect()} == want
    assert score.best_shared(lt, rt.where("false"), ["a"], "block", 3).collect() == []


def test_far_ranges_meet_only_rare_tokens(spark, monkeypatch):
    """A word that all rows hold joins the first range alone: the pairs of later ranges are those of the rare word."""
    write = score.materialize
    lt = spark.range(100).select(F.col("id").alias("a"), F.lit("x").alias("block"), F.array(F.lit("the"), F.concat(F.lit("r"), F.col("id").cast("string"))).alias("tokens"), F.lit(2).alias("cap"))
    rt = spark.range(2000).select(F.col("id").alias("b"), F.lit("x").alias("block"), F.when(F.col("id") == 1999, F.array(F.lit("the"), F.lit("r5"))).otherwise(F.array(F.lit("the"))).alias("tokens"))
    counts = []
    monkeypatch.setattr(score, "materialize", lambda df, name: (lambda t: counts.append(t.count()) or t if name == "shared-led" else t)(write(df, name)))
    got = {(r.a, r.b): r.hit for r in score.best_shared(lt, rt, ["a"], "block", 2, 20).collect()}
    assert got[5, 1999] == 2 and got[4, 1] == 1 and len(got) == 200 and sum(counts) <= 1


@pytest.mark.parametrize("terms", [["ab", "c"], None])
def test_a_text_is_looked_through_once_for_each_term(spark, terms):
    """A filter on the score isn't pushed below the search for terms."""
    df = spark.createDataFrame([(1, "ab cd", "x", ["ab", "zz"], ["c"]), (2, None, "", [], [])], "id long, standard string, domain string, core array<string>, more array<string>")
    core, more = (terms[:1], terms[1:]) if terms else (F.col("core"), F.col("more"))
    out = score.relevance(df, ["standard", "domain"], core, more).where("match_strength <> 'irrelevant' and score >= 0.12")
    assert [r.id for r in out.collect()] == [1]
    assert out._jdf.queryExecution().optimizedPlan().toString().lower().count("contains(") <= 4


def test_search_keeps_texts_with_capitals(spark):
    records = spark.createDataFrame([(1, None, None, "DECIMALS", None)], "code long, subject string, band string, standard string, domain string")
    asked = spark.createDataFrame([("a", "decimals")], "id string, query string").select("id", "query", *[F.lit(None).cast(t).alias(c) for c, t in (("subjects", "array<string>"), ("bands", "array<string>"), ("expansion", "array<string>"), ("limit", "int"))])
    assert [r.codes for r in search.smart_search(records, asked, ["standard", "domain"]).collect()] == [[1]]
