"""Graphs as two tables: nodes(id, ...) and edges(a, b, ...). Loops run on the driver, rows never come to it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..scratch import discard, materialize
from . import cycles

FOLD = 8  # rounds after which a union of their tables is written as one


def both_ways(edges: DataFrame) -> DataFrame:
    return edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct()


def validate(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(rule, n): repeated ids, self edges, edges without an end, repeated edges."""
    repeated = nodes.groupBy("id").count().where("count > 1").select(F.lit("repeated_node").alias("rule"))
    selfs = edges.where("a = b").select(F.lit("self_edge").alias("rule"))
    ends = edges.select(F.col("a").alias("id")).unionByName(edges.select(F.col("b").alias("id")))
    dangling = ends.join(nodes.select("id"), "id", "left_anti").distinct().select(F.lit("unknown_end").alias("rule"))
    twice = edges.groupBy("a", "b").count().where("count > 1").select(F.lit("repeated_edge").alias("rule"))
    return repeated.unionByName(selfs).unionByName(dangling).unionByName(twice).groupBy("rule").agg(F.count("*").alias("n"))


def degrees(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("a").alias("id"), F.lit(1).alias("o"), F.lit(0).alias("i")).unionByName(edges.select(F.col("b").alias("id"), F.lit(0).alias("o"), F.lit(1).alias("i"))).groupBy("id").agg(F.sum("o").alias("out_degree"), F.sum("i").alias("in_degree"))


def neighbours(edges: DataFrame, focus: DataFrame) -> DataFrame:
    """(id, neighbour, direction) one step from each focus id."""
    out = focus.select("id").join(edges.select(F.col("a").alias("id"), F.col("b").alias("neighbour")), "id").withColumn("direction", F.lit("out"))
    return out.unionByName(focus.select("id").join(edges.select(F.col("b").alias("id"), F.col("a").alias("neighbour")), "id").withColumn("direction", F.lit("in")))


def grown(seen: DataFrame, new: DataFrame, rounds: int) -> DataFrame:
    """seen and new; written as one table every few rounds, so that a long search has a short plan."""
    both = seen.unionByName(new)
    return materialize(both, "seen") if rounds % FOLD == 0 else both


def layers(edges: DataFrame, start: DataFrame, most: int | None = None) -> DataFrame:
    """(id, depth) of all that is reached along the edges from start(id), in at most `most` steps where that is given."""
    seen, depth = materialize(start.select("id").distinct().withColumn("depth", F.lit(0)), "layers"), 0
    while most is None or depth < most:
        depth += 1
        edge = seen.where(F.col("depth") == depth - 1).select(F.col("id").alias("a")).join(edges, "a").select(F.col("b").alias("id")).distinct()
        new = materialize(edge.join(seen.select("id"), "id", "left_anti").withColumn("depth", F.lit(depth)), "layer")
        if new.isEmpty():
            break
        seen = grown(seen, new, depth)
    return seen


def shortest_path(edges: DataFrame, source, target, most: int | None = None) -> DataFrame:
    """(id, path) of the target: of the shortest undirected paths the first by order of its nodes; no row where none has at most `most` edges."""
    both = both_ways(edges)
    spark = edges.sparkSession
    kind = both.schema["a"].dataType
    front = spark.createDataFrame([(source,)], "id string").select(F.col("id").cast(kind)).withColumn("path", F.array("id"))
    seen, depth = front, 0
    while seen.where(F.col("id") == F.lit(target)).isEmpty() and (most is None or depth < most):
        depth += 1
        step = front.select(F.col("id").alias("a"), "path").join(both, "a").groupBy(F.col("b").alias("id")).agg(F.min("path").alias("path"))
        front = materialize(step.join(seen.select("id"), "id", "left_anti").withColumn("path", F.concat("path", F.array("id"))), "paths")
        if front.isEmpty():
            break
        seen = grown(seen, front, depth)
    return seen.where(F.col("id") == F.lit(target))


def components(edges: DataFrame) -> DataFrame:
    """edges(a, b) -> (id, label), the smallest id of its component.

    Each round takes the smallest label among the neighbours, then the label of that label (pointer
    jumping), until nothing changes. A hub's label is joined to many rows, which adaptive execution
    splits, as the other side has one row. Edges with a null end are left out; self edges and
    repeated edges do no harm; no edges give no rows. Labels are never broadcast: a small file of them
    is many rows, which would all go through the driver. Tables of earlier rounds are deleted.
    """
    both = materialize(both_ways(edges.where("a is not null and b is not null")), "edges")
    labels = materialize(both.groupBy(F.col("a").alias("id")).agg(F.least(F.min("a"), F.min("b")).alias("label")), "labels")
    while True:
        near = both.join(labels.select(F.col("id").alias("b"), "label").hint("merge"), "b").groupBy(F.col("a").alias("id")).agg(F.min("label").alias("near"))
        mid = labels.join(near.hint("merge"), "id").select("id", F.col("label").alias("old"), F.least("label", "near").alias("mid"))
        new = materialize(mid.join(labels.select(F.col("id").alias("mid"), F.col("label").alias("far")).hint("merge"), "mid").select("id", "old", F.least("mid", "far").alias("label")), "labels")
        settled = new.where("old <> label").isEmpty()
        discard(labels)
        labels = new
        if settled:
            discard(both)
            return labels.select("id", "label")


def on_cycles(edges: DataFrame) -> DataFrame:
    """(a, b): distinct edges that lie on a cycle; no rows: no cycle."""
    return cycles.cycle_edges(edges).select("a", "b")


def within_budget(seen: DataFrame, labels: DataFrame, budget: int) -> DataFrame:
    """The first `budget` nodes by (depth, label, id), with the number of those left out."""
    ranked = seen.join(labels, "id").orderBy("depth", "label", "id").limit(budget)
    hidden = seen.agg(F.greatest(F.count("*") - budget, F.lit(0)).alias("hidden"))
    return ranked.join(F.broadcast(hidden))  # one row


def root_paths(edges: DataFrame) -> DataFrame:
    """(id, path): of all paths from a root to a node the shortest, then the first by order. edges lead from parent to child."""
    roots = edges.join(edges.select(F.col("b").alias("a")), "a", "left_anti").select(F.col("a").alias("id")).distinct()
    front = seen = materialize(roots.withColumn("path", F.array("id")), "roots")
    rounds = 0
    while True:
        rounds += 1
        step = front.select(F.col("id").alias("a"), "path").join(edges, "a").groupBy(F.col("b").alias("id")).agg(F.min("path").alias("path"))
        front = materialize(step.join(seen.select("id"), "id", "left_anti").withColumn("path", F.concat("path", F.array("id"))), "roots")
        if front.isEmpty():
            return seen
        seen = grown(seen, front, rounds)


def chain_edges(df: DataFrame, group: str, order: list[str], code: str) -> DataFrame:
    """(grp, a, b): adjacent records of each group."""
    w = Window.partitionBy(group).orderBy(*order)
    return df.select(F.col(group).alias("grp"), F.col(code).alias("a"), F.lead(code).over(w).alias("b")).where("b is not null")


def budgeted(seen: DataFrame, sides: list[str], edges: DataFrame, focus: DataFrame, budget: int) -> DataFrame:
    """(side, id, depth, hidden, edges): of seen(side, id, depth) the first by side, depth and id, `budget`
    with the focus(id), the number of those left out, and of edges between what is shown and the focus."""
    place = F.coalesce(*[F.when(F.col("side") == s, F.lit(k)) for k, s in enumerate(sides)])
    seen = materialize(seen, "seen")
    shown = materialize(seen.orderBy(place, "depth", "id").limit(budget - 1), "shown")
    known = F.broadcast(shown.select("id").unionByName(focus).distinct())  # `budget` rows at most
    inside = edges.select("a", "b").join(known.withColumnRenamed("id", "a"), "a", "left_semi").join(known.withColumnRenamed("id", "b"), "b", "left_semi")
    counts = seen.agg(F.count("*").alias("all")).join(F.broadcast(inside.agg(F.count("*").alias("edges"))))  # one row each
    return shown.join(F.broadcast(counts)).select("side", "id", "depth", F.greatest(F.col("all") - (budget - 1), F.lit(0)).alias("hidden"), "edges")


def context(edges: DataFrame, focus: str, kinds: dict[str, Column]) -> DataFrame:
    """(role, n, first): parents, siblings, and children by kind of a node, each counted."""
    parents = edges.where(F.col("b") == focus).select(F.col("a").alias("p")).distinct()
    siblings = edges.join(parents.withColumnRenamed("p", "a"), "a", "left_semi").where(F.col("b") != focus).select(F.lit("sibling").alias("role"), F.col("b").alias("id"))
    rows = parents.select(F.lit("parent").alias("role"), F.col("p").alias("id")).unionByName(siblings)
    for name, condition in kinds.items():
        rows = rows.unionByName(edges.where((F.col("a") == focus) & condition).select(F.lit(name).alias("role"), F.col("b").alias("id")))
    return rows.groupBy("role").agg(F.count("*").alias("n"), F.min("id").alias("first"))


def taxonomy(rows: DataFrame, levels: dict[str, str], leaf: str, key: str) -> DataFrame:
    """(kind, id, parent): a node for each distinct path of the levels, and one for each row."""
    out, path, parent = None, [], F.lit(None).cast("string")
    for kind, column in levels.items():
        path = [*path, F.col(column).cast("string")]
        node = rows.select(F.lit(kind).alias("kind"), F.concat_ws("/", *path).alias("id"), parent.alias("parent")).distinct()
        out, parent = node if out is None else out.unionByName(node), F.concat_ws("/", *path)
    return out.unionByName(rows.select(F.lit(leaf).alias("kind"), F.col(key).cast("string").alias("id"), parent.alias("parent")))


def sample(edges: DataFrame, kind: Column, most: int) -> DataFrame:
    """(id, layer): `most` nodes by layer and id of a search from the node with the most edges of each kind (a column of id)."""
    both = materialize(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))), "both")
    degree = both.groupBy(F.col("a").alias("id")).agg(F.count("*").alias("degree")).withColumn("kind", kind)
    best = degree.groupBy("kind").agg(F.min(F.struct((-F.col("degree")).alias("minus"), "id")).alias("best"))
    seen = front = materialize(best.select(F.col("best.id").alias("id"), F.lit(0).alias("layer")), "sample")
    layer = 0
    while seen.count() < most:
        layer += 1
        new = front.select(F.col("id").alias("a")).join(both, "a").select(F.col("b").alias("id")).distinct().join(seen.select("id"), "id", "left_anti")
        front = materialize(new.withColumn("layer", F.lit(layer)), "sample")
        if front.isEmpty():
            break
        seen = seen.unionByName(front)
    return seen.orderBy("layer", "id").limit(most)


def cloned(edges: DataFrame, times: int) -> DataFrame:
    """The edges `times` times over, each copy with nodes of its own."""
    copy = F.explode(F.sequence(F.lit(0), F.lit(times - 1))).alias("k")
    named = lambda c: F.concat(F.col(c), F.lit("#"), F.col("k").cast("string")).alias(c)
    return edges.select("a", "b", copy).select(named("a"), named("b"))
