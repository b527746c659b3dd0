"""Operators on small literal tables, with the values that they must give."""

from pyspark.sql import functions as F

from tessella.functions import text as T
from tessella.functions import tokens, understanding
from tessella.operators import evaluate, facets, graph, merge, planning, quality, resolve, score, sequential
from tessella.sources import io


def one(spark, c, **cols):
    return spark.createDataFrame([tuple(cols.values())], list(cols)).select(c.alias("x")).first().x


def test_topic_tokens_take_disjoint_pairs(spark):
    assert one(spark, T.topic_tokens(F.col("t")), t="光合作用 的 学习, Plants") == ["光合作用", "光合", "作用", "plants"]


def test_plan_tokens_take_overlapping_pairs(spark):
    assert one(spark, T.plan_tokens(F.col("t")), t="水循环") == ["水循环", "水循", "循环"]
    assert one(spark, T.plan_tokens(F.col("t")), t="") == []


def test_redaction_rules_follow_their_order(spark):
    text, n, kinds = T.redact(F.col("t"))
    row = spark.createDataFrame([("a@b.cn 13812345678 姓名：张三，11010519491231002X",)], ["t"]).select(text.alias("x"), n.alias("n"), kinds.alias("k")).first()
    assert row.x == "[邮箱已移除] [手机号已移除] 姓名：[已移除]，[身份证号已移除]" and row.n == 4 and row.k == ["email", "phone", "national_id", "named_identifier"]


def test_quality_flags(spark):
    assert one(spark, T.quality_flags("context", F.col("t")), t="“一二，") == ["unbalanced_quote", "possible_truncation", "content_too_short"]
    assert one(spark, T.quality_flags("standard", F.col("t")), t="  ") == []


def test_facets_let_all_pass_when_empty(spark):
    df = spark.createDataFrame([("a", 1), (None, 2)], "k string, v int")
    assert facets.facet_filter(df, {"k": []}).count() == 2
    assert [r.v for r in facets.facet_filter(df, {"k": [""]}).collect()] == [2]
    assert facets.page(df, [F.col("v")], 0, 1).collect()[0].v == 2
    assert facets.project(df, ["v"], "x", {"x": ["k", "none"]}).columns == ["v", "k"]


def test_alias_never_shadows_a_code(spark):
    r = spark.createDataFrame([("A", "B"), ("B", "c"), ("D", "c")], "code string, alias string")
    keys = resolve.reference_keys(r, "code", [F.col("alias")])
    got = {x.request: (x.status, x.code) for x in resolve.resolve(spark.createDataFrame([("b",), ("C",), ("z",)], "q string"), "q", keys).collect()}
    assert got == {"b": ("found", "B"), "C": ("ambiguous", None), "z": ("missing", None)}


def test_ties_share_an_interval_end(spark):
    df = spark.createDataFrame([("x", 1), ("x", 1), ("x", 5)], "k string, s int")
    assert sorted((r.s, r.e) for r in resolve.lead_intervals(df, ["k"], "s", 9, "e").collect()) == [(1, 4), (1, 4), (5, 9)]


def test_as_of_takes_the_row_at_the_same_time(spark):
    a = spark.createDataFrame([("u", 5), ("u", 1), ("v", 5)], "k string, t int")
    b = spark.createDataFrame([("u", 5, 50), ("u", 2, 20)], "k string, t int, v int")
    assert {(r.k, r.t): r.v for r in resolve.as_of(a, b, ["k"], "t", "t", "v").collect()} == {("u", 5): 50, ("u", 1): None, ("v", 5): None}


def test_shortest_path_of_a_diamond_is_the_first_by_order(spark):
    e = spark.createDataFrame([("a", "c"), ("a", "b"), ("b", "d"), ("c", "d")], "a string, b string")
    assert graph.shortest_path(e, "a", "d").first().path == ["a", "b", "d"]
    assert {r.id: r.depth for r in graph.layers(e, spark.createDataFrame([("a",)], "id string")).collect()} == {"a": 0, "b": 1, "c": 1, "d": 2}
    assert graph.on_cycles(e).count() == 0


def test_cycle_is_found(spark):
    e = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("c", "d")], "a string, b string")
    assert sorted((r.a, r.b) for r in graph.on_cycles(e).collect()) == [("a", "b"), ("b", "c"), ("c", "a")]
    assert {r.label for r in graph.components(e).collect()} == {"a"}


def test_multi_parent_takes_shortest_then_first_path(spark):
    e = spark.createDataFrame([("r", "x"), ("r", "y"), ("x", "k"), ("y", "k")], "a string, b string")
    assert {r.id: r.path for r in graph.root_paths(e).collect()}["k"] == ["r", "x", "k"]


def test_later_generation_wins_and_done_goes(spark):
    g = [spark.createDataFrame(x, "id int, v string") for x in ([(1, "a"), (2, "a"), (3, "a")], [(2, "b")])]
    assert sorted(map(tuple, merge.merge_generations(g, ["id"], spark.createDataFrame([(3,)], "id int")).collect())) == [(1, "a"), (2, "b")]


def test_exam_comes_before_review(spark):
    s = planning.schedule(spark.createDataFrame([("p", 4)], "plan string, weeks int"), spark.createDataFrame([("p",), ("p",)], "plan string"), "plan", "weeks", [2, 4], [4])
    assert [(r.week, r.type, r.unit_no) for r in s.orderBy("week").collect()] == [(1, "teaching", 1), (2, "review", None), (3, "teaching", 2), (4, "exam", None)]


def test_goals_belong_to_the_unit_before(spark):
    rows = [("p", 1, "课程"), ("p", 2, "单元1：水"), ("p", 3, "目标：观察"), ("p", 4, "Unit 2: Air"), ("p", 5, "学习目标：记录")]
    got = planning.parse_units(spark.createDataFrame(rows, "plan string, n int, line string"), "plan", "n", "line").orderBy("unit_no").collect()
    assert [(r.title, r.goals) for r in got] == [("水", ["观察"]), ("Air", ["记录"])]


def test_missing_prediction_is_no_abstention(spark):
    df = spark.createDataFrame([(True, None), (True, "abstain"), (False, "accept"), (True, "accept")], "e boolean, p string")
    assert tuple(evaluate.confusion(df, "e", "p").first()) == (1, 1, 2, 0, 1)


def test_worklist_takes_the_first_priority(spark):
    df = spark.createDataFrame([(1, 5), (2, 1)], "id int, n int")
    assert [tuple(r) for r in quality.worklist(df, "id", {"big": F.col("n") > 3}, [("P0", F.col("n") > 4), ("P1", F.lit(True))]).collect()] == [(1, ["big"], "P0")]


def test_margin_without_a_second_is_the_score(spark):
    df = spark.createDataFrame([("a", "x", 0.3), ("b", "x", 0.3), ("b", "y", 0.28)], "g string, c string, s double")
    got = {r.g: (r.c, r.confidence) for r in score.best_with_margin(df, ["g"], "s", "c").collect()}
    assert got == {"a": ("x", "high"), "b": ("x", "medium")}


def test_relevance_is_direct_by_a_primary_field(spark):
    df = spark.createDataFrame([("Water cycle", "x"), ("air", "water"), ("air", None)], "standard string, practice string")
    got = [(r.match_strength, round(r.score, 4)) for r in score.relevance(df, ["standard", "practice"], ["water"]).collect()]
    assert got == [("direct", round(0.45 + 0.3 * 1 / 1.54 + 0.18 + 0.015, 4)), ("supporting", round(0.45 + 0.3 * 0.54 / 1.54 + 0.099 + 0.015, 4)), ("irrelevant", 0.015)]


def test_greedy_choices(spark):
    df = spark.createDataFrame([("g", 3, ["a"]), ("g", 2, ["a", "b"]), ("g", 1, ["b"])], "g string, s int, tags array<string>")
    assert sorted(r.s for r in sequential.diverse_top(df, "g", ["s"], [False], "tags", 2).collect()) == [1, 3]
    df = spark.createDataFrame([("g", 1, 2), ("g", 2, 2), ("g", 3, None)], "g string, k int, p int")
    assert [r.seq for r in sequential.allocate(df, "g", "k", "p").orderBy("k").collect()] == [2, 1, 3]
    df = spark.createDataFrame([("b", 1, 3), ("b", 2, 5), ("b", 3, 4), ("b", 3, 9)], "b string, o int, p int")
    assert sequential.longest_chain(df, "b", "o", "p", 3).first().last_page == 9


def test_sources_and_sinks(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"id":1}\n\n{"id":2}\n')
    assert io.read_lines(spark, str(tmp_path / "a.jsonl"), "id int").count() == 2
    assert io.read_or_empty(spark, str(tmp_path / "none.jsonl"), "id int").count() == 0
    (tmp_path / "d.json").write_text('{"standards":[{"code":"x"},{"code":"y"}]}')
    df = io.read_documents(spark, str(tmp_path / "d.json"), "standards", "code string")
    io.write_partitioned(df.withColumn("s", F.lit("m")), str(tmp_path / "out"), "s")
    assert io.read_partitions(spark, str(tmp_path / "out"), "s", ["m", "?"]).count() == 2
    m = io.write_generation({"t": df}, str(tmp_path / "gen")).first()
    assert (m.name, m.n_rows) == ("t", 2) and spark.read.json(str(tmp_path / "gen/manifest")).first().digest == m.digest
    assert one(spark, io.markdown_blocks(F.col("t")), t="# A\n- b\n\n> c\nd")[1].text == "b"


def test_long_runs_of_repeated_groups_do_not_end_the_process(spark):
    n = 10**6
    df = spark.createDataFrame([("ab" + "-ab" * n,), ("1" + ".1" * n,), ("unit " * n,), ("x ab-cd-ef-gh_ y",), ("ab-cd-efghijklmnopqrs z",)], "t string")
    got = df.select(F.length(F.regexp_replace("t", understanding.CODE_LIKE, " ")), F.length(F.regexp_replace("t", tokens.HEADING_NUMBER, "")), F.col("t").rlike(tokens.HEADING)).collect()
    assert [tuple(r) for r in got] == [(1, 3 * n + 2, False), (2 * n + 1, 0, True), (5 * n, 5 * n, False), (9, 16, False), (23, 23, False)]
