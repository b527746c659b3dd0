"""Selections and mappings on small tables; search against a plain loop over requests."""

from pyspark.sql import functions as F

from tessella.operators import search, selections


def test_field_sets_and_terms(spark):
    df = spark.createDataFrame([("public, admin,x",), ("",), (None,), ("ADMIN",), ("source,source",)], "v string")
    assert [r.f for r in df.select(selections.fieldsets(F.col("v")).alias("f")).collect()] == [["public", "admin"], ["public"], ["public"], ["public"], ["source", "source"]]
    df = spark.createDataFrame([("The 光合作用 of 水 ab a-1 光合",), (None,)], "v string")
    assert [sorted(r.t) for r in df.select(selections.terms(F.col("v")).alias("t")).collect()] == [sorted(["the", "a-1", "光合", "合作", "作用"]), []]


def test_declared_mappings_come_first_and_sections_are_used_once(spark):
    units = spark.createDataFrame([("g", k, k, t) for k, t in ((1, "A"), (2, " a "), (3, "B"), (4, "C"), (5, "D"), (6, None))], "grp string, unit long, ord long, title string")
    sections = spark.createDataFrame([("g", 10, "a"), ("g", 11, "b"), ("g", 12, "B"), ("g", 13, "c"), ("h", 14, "d")], "grp string, section long, title string")
    declared = spark.createDataFrame([("g", 4, 11, 0.5), ("g", 5, 99, 0.5), ("g", 77, 10, 0.5)], "grp string, unit long, section long, confidence double")
    got = {(r.unit, r.section, r.method) for r in selections.unit_mappings(units, sections, declared).collect()}
    assert got == {(4, 11, "explicit_manifest"), (5, None, "missing_reference"), (None, None, "missing_reference"), (1, 10, "exact_normalized_title"), (2, None, "no_section"), (3, 12, "exact_normalized_title"), (5, None, "no_section"), (6, None, "no_section")}


def test_evaluation_goes_by_candidate_then_case(spark):
    golden = spark.createDataFrame([(1, 1, False), (2, 1, False), (3, 2, True), (4, 9, None), (None, 1, False)], "candidate long, case long, multi boolean")
    predictions = spark.createDataFrame([(1, 5, "x", 1), (1, 5, "accept", 2), (None, 1, "reject", 3), (8, 2, "accept", 4)], "candidate long, case long, decision string, at long")
    got = [(r.candidate, r.decision, r.matched_by) for r in selections.evaluated(golden, predictions, "at").collect()]
    assert sorted(got, key=repr) == sorted([(1, "accept", "candidate"), (2, "reject", "case"), (3, "missing", "missing"), (4, "missing", "missing"), (None, "reject", "case")], key=repr)


def test_quota_and_order_over_groups(spark):
    rows = spark.createDataFrame([(k % 3, k, 100 - k) for k in range(20)], "g long, at long, price long")
    assert sorted(r.at for r in selections.quota(rows, "g", ["at"], 2).collect()) == [0, 1, 2, 3, 4, 5]
    kept = selections.limited_by_group(rows, ["g"], F.struct("price"), 2).collect()
    assert sorted((r.number, r.at) for r in kept) == [(k, 20 - k) for k in range(1, 7)]


def test_search_answers_filter_and_are_not_filled_up(spark):
    texts = ["fractions and decimals", "a lab on cells", "decimals", "history of fractions", None, "fraction lab", "deci"]
    records = spark.createDataFrame([(k, s, b, t, "number") for k, (t, s, b) in enumerate(zip(texts, ["math", "science", "math", "history", "math", "math", None], ["H1", "H1", "H2", None, "H1", "H4", "H1"]))], "code long, subject string, band string, standard string, domain string")
    asked = [("a", "数学 decimals", None, None, None, None), ("b", "decimals", ["math"], ["H2", "H2"], None, 1), ("c", "fractions 不要 history", None, None, ["fract", "lab"], 100), ("d", None, None, None, None, 0), ("e", "decimals", None, None, ["deci"], None)]
    requests = spark.createDataFrame(asked, "id string, query string, subjects array<string>, bands array<string>, expansion array<string>, limit int")
    got = {r.id: r for r in search.smart_search(records, requests, ["standard", "domain"]).collect()}
    assert (got["a"].subjects, got["a"].codes, got["a"].total_candidates, got["a"].note) == (["math"], [0, 2], 4, "fewer")
    assert (got["b"].codes, got["b"].total_candidates, got["b"].relevant, got["b"].note) == ([2], 1, 1, "all")
    assert got["c"].excluded == ["history"] and 3 not in got["c"].codes and got["c"].supporting == 1 and got["c"].total_candidates == 6
    assert (got["d"].codes, got["d"].relevant, got["d"].note, got["d"].total_candidates) == ([], 0, "none", 7)
    assert got["e"].direct == 2 and got["e"].supporting == 1 and got["e"].omitted == 4
    assert search.smart_search(records, requests.where("false"), ["standard", "domain"]).collect() == []
