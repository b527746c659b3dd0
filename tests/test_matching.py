"""Query understanding and matching on small rows with values worked out by hand."""

from pyspark.sql import functions as F

from tessella import scratch
from tessella.functions import tokens as K
from tessella.functions import understanding as U
from tessella.operators import graph, matching, summaries


def one(spark, *columns, **values):
    row = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} string" for k in values))
    return row.select(*columns).first()


def test_a_request_is_understood(spark):
    q = F.col("q")
    asked, gone = U.subjects_of(q)
    read = lambda text: one(spark, asked.alias("asked"), gone.alias("gone"), U.bands_of(q).alias("bands"), U.topic_of(q).alias("topic"), q=text)
    assert tuple(read("查找三年级数学的分数运算")) == (["math"], [], ["H2"], "分数运算")
    assert tuple(read("除了科学以外，五六年级的光合作用"))[:3] == ([], ["science"], ["H3"])
    assert tuple(read("math-h1-alg-001 初二 植物"))[2:] == (["H4G8"], "植物")
    assert tuple(read(""))[:3] == ([], [], [])
    skills = one(spark, U.skills_of(q).alias("s"), U.inferred_skills(F.array(F.lit("数据"))).alias("i"), q="协作与表达")
    assert skills.s == ["TS4", "TS5"] and skills.i == ["TS6"]


def test_numbers_bands_and_codes(spark):
    q = F.col("q")
    read = lambda text: tuple(one(spark, U.first_number(q), U.ordinal_of(q), U.band_of(q), q=text))
    assert [read(x) for x in ("二十一", "十", "九年级", "第12课", "无")] == [(1, 21, "H1"), (None, 10, None), (9, None, "H4G9"), (12, None, None), (None, None, None)]
    part = one(spark, U.code_parts(q).alias("c"), q="MA-H1-ALG-007").c
    assert tuple(part) == ("MA", "H1", "ALG", "007", True) and not one(spark, U.code_parts(q).alias("c"), q="MA-7").c.canonical


def test_constraints_by_precedence(spark):
    arrays = spark.createDataFrame([(["a"], ["b"], ["c"]), ([], ["b"], ["c"]), ([], [], ["c"]), ([], ["b", "c"], ["c"])], "e array<string>, t array<string>, m array<string>")
    got = [tuple(r.m) for r in arrays.select(U.merge_constraint(F.col("e"), F.col("t"), F.col("m")).alias("m")).collect()]
    assert got == [(["a"], True, "explicit_request_wins"), (["b"], True, "explicit_query_wins"), (["c"], False, None), (["b", "c"], False, None)]


def test_lexical_scores_and_keywords(spark):
    s, t = F.col("s"), F.col("t")
    read = lambda a, b: round(one(spark, matching.lexical_score(s, t, K.content_grams(s), K.content_grams(t)).alias("v"), s=a, t=b).v, 4)
    assert read("光合作用的实验", "光合作用") == 0.98 and read("", "光合") == 0 and read("春天", "海洋") == 0
    assert read("植物光合作用过程", "描述光合作用") >= 0.76
    assert one(spark, matching.pruned(F.array(*map(F.lit, ["作用", "光合作用", "植物"]))).alias("w"), s="").w == ["光合作用", "植物"]
    assert one(spark, K.modifiers_conflict(s, t).alias("c"), s="二元一次方程", t="一元一次方程").c
    assert not one(spark, K.modifiers_conflict(s, t).alias("c"), s="二元方程", t="三维图形").c


def test_titles_are_linked_once(spark):
    units = spark.createDataFrame([(1, "a"), (2, "a"), (3, "b"), (4, "c")], "unit int, t string")
    sections = spark.createDataFrame([(10, "a"), (11, "b"), (12, "b")], "section int, t string")
    got = sorted((r.unit, r.section, r.status) for r in matching.title_links(units, sections, ["t"], "unit", "section").collect())
    assert got == [(1, 10, "exact_normalized_title"), (2, None, "no_compatible_section"), (3, None, "ambiguous_section"), (4, None, "no_compatible_section")]


def test_prefix_filtering_loses_no_pair(spark):
    import itertools
    import random

    rng = random.Random(5)
    sets = [(k, "x", sorted(set(rng.choices("abcdefghij", k=rng.randrange(1, 9))))) for k in range(60)]
    left = spark.createDataFrame(sets, "a int, g string, tokens array<string>")
    got = {(r.a, r.b) for r in matching.jaccard_join(left, left.withColumnRenamed("a", "b"), ["g"], 3, 5).collect()}
    want = {(i, j) for (i, _, x), (j, _, y) in itertools.product(sets, sets) if 5 * len(set(x) & set(y)) >= 3 * len(set(x) | set(y))}
    assert got == want


def test_quotes_have_boxes_where_they_stand_once(spark):
    lines = spark.createDataFrame([(1, 1, "abcd", 0, 0, 4, 1), (1, 2, "efab", 1, 1, 5, 2), (2, 1, "xyzxy", 0, 0, 5, 1)], "page int, k int, text string, x0 int, y0 int, x1 int, y1 int")
    quotes = spark.createDataFrame([(1, "cdef"), (1, "ab"), (1, "zz"), (2, "xy"), (2, "yz")], "page int, quote string")
    got = sorted(tuple(r) for r in summaries.quote_box(lines, "page", "k", "text", ["x0", "y0", "x1", "y1"], quotes, "quote").collect())
    assert got == [(1, "cdef", 0, 0, 5, 2), (2, "yz", 0, 0, 5, 1)]


def test_long_chains_and_cycles_are_walked_to_their_end(spark):
    chain = spark.createDataFrame([(k, k + 1) for k in range(40)], "a int, b int")
    assert graph.layers(chain, spark.createDataFrame([(0,)], "id int")).count() == 41
    assert {r.label for r in graph.components(chain).collect()} == {0}
    assert graph.on_cycles(chain.limit(12)).count() == 0
    loop = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (3, 4), (0, 1), (None, 1)], "a int, b int")
    assert sorted(tuple(r) for r in graph.on_cycles(loop).collect()) == [(1, 2), (2, 3), (3, 1)]
    assert graph.shortest_path(chain, 3, 20).first().path == list(range(3, 21))


def test_scratch_tables_are_deleted(spark, tmp_path):
    t = scratch.materialize(spark.range(5).toDF("id"), "five")
    path = scratch._paths[t]
    assert t.count() == 5
    scratch.discard(t)
    jpath = spark._jvm.org.apache.hadoop.fs.Path(path)
    assert not jpath.getFileSystem(spark._jsc.hadoopConfiguration()).exists(jpath)
