"""Progression graphs of records: edges from references and bridges, and what the component of each record holds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..scratch import materialize
from . import graph

# The bands in order, and the one that bridges lead to.
BANDS = ["H1", "H2", "H3", "H4G7", "H4G8", "H4G9"]
BRIDGED = "H4G7"
NEXT, PREVIOUS, BRIDGE = 0, 1, 2


def _resolved(refs: DataFrame, records: DataFrame) -> DataFrame:
    """refs(subject, ref, ...) with target and target_band: the one record of the subject that has that code, in any case."""
    key = lambda c: F.upper(F.trim(F.col(c).cast("string")))
    keys = records.groupBy("subject", key("code").alias("_key")).agg(F.count_distinct("code").alias("_n"), F.min("code").alias("target"), F.min("band").alias("target_band")).where("_n = 1").drop("_n")
    return refs.withColumn("_key", key("ref")).where("_key <> ''").join(keys, ["subject", "_key"]).drop("_key")


def edges(records: DataFrame, bridges: DataFrame) -> DataFrame:
    """(a, b, relation, confidence): one edge per pair; of several the one that was put last.

    records(code, subject, band, ord, next_refs, previous_refs), the references as arrays;
    bridges(code, pos, ref, confidence) lead from the record referred to into a record of the band
    H4G7. Edges are put record by record in the order of ord: successors, predecessors, bridges. A
    reference counts within its subject and where it is the code of one record; nothing leads to itself.
    """
    grade = lambda x, y: F.when(F.coalesce(x.startswith("H4") & y.startswith("H4"), F.lit(False)), "grade_progression").otherwise("stage_progression")
    own = ["code", "subject", "band", "ord"]

    def told(column: str, kind: int) -> DataFrame:
        refs = records.select(*own, F.posexplode(column).alias("pos", "ref")).withColumns({"kind": F.lit(kind), "confidence": F.lit("declared")})
        return _resolved(refs, records)

    onward, back = told("next_refs", NEXT), told("previous_refs", PREVIOUS)
    into = records.where(F.col("band") == BRIDGED).select(*own).join(bridges.select("code", "pos", "ref", F.coalesce("confidence", F.lit("low")).alias("confidence")), "code").withColumn("kind", F.lit(BRIDGE))
    across = _resolved(into, records)
    row = lambda a, b, relation: [F.col(a).alias("a"), F.col(b).alias("b"), relation.alias("relation"), "confidence", F.struct("ord", "kind", "pos", "code").alias("put")]
    every = onward.select(*row("code", "target", grade(F.col("band"), F.col("target_band"))))
    every = every.unionByName(back.select(*row("target", "code", grade(F.col("target_band"), F.col("band")))))
    every = every.unionByName(across.select(*row("target", "code", F.lit("inferred_stage_bridge"))))
    return every.where("a <> b").groupBy("a", "b").agg(F.max_by(F.struct("relation", "confidence"), "put").alias("e")).select("a", "b", "e.*")


def coverage(band: Column) -> list[Column]:
    return [F.count_if(band == b).alias(b) for b in BANDS]


def components(records: DataFrame, links: DataFrame) -> DataFrame:
    """A row per record: code, component, status, nodes, edges, H1 to H4G9, bridges, bridges_low, warnings.

    links(a, b, relation, confidence) join records whichever way they point; a component is named by
    its smallest code, and a record without an edge is one of its own. It is summed up once and not for
    each of its records. status: not_available without edges, partial with bridges, else available.
    warnings, in this order: no_relations, low_bridges or bridges, no_bridge_to_h4.
    """
    links = materialize(links, "progression-edges")
    labels = graph.components(links.select("a", "b"))
    rows = records.select("code", "subject", "band").join(labels.select(F.col("id").alias("code"), "label"), "code", "left").withColumn("component", F.coalesce("label", "code")).drop("label")
    rows = materialize(rows, "progression-rows")
    band = F.coalesce("band", F.lit(""))
    sums = rows.groupBy("component").agg(F.count(F.lit(1)).alias("nodes"), F.min("subject").alias("subject"), *coverage(band), F.max(band.startswith("H4")).alias("_h4"))
    bridge = F.col("relation") == "inferred_stage_bridge"
    of = links.join(labels.select(F.col("id").alias("a"), F.col("label").alias("component")), "a").groupBy("component").agg(F.count(F.lit(1)).alias("edges"), F.count_if(bridge).alias("bridges"), F.count_if(bridge & (F.col("confidence") == "low")).alias("bridges_low"))
    subjects = rows.groupBy("subject").agg(F.max(band.startswith("H4")).alias("_any_h4"))
    n = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long")
    whole = sums.join(of, "component", "left").withColumns({c: n(c) for c in ("edges", "bridges", "bridges_low")}).join(subjects.withColumnRenamed("subject", "_s"), F.col("subject").eqNullSafe(F.col("_s")), "left")
    status = F.when(F.col("edges") == 0, "not_available").when(F.col("bridges") > 0, "partial").otherwise("available")
    alone = (F.col("H3") > 0) & ~F.col("_h4") & F.coalesce("_any_h4", F.lit(False))
    warnings = F.array_compact(F.array(F.when(F.col("edges") == 0, "no_relations"), F.when(F.col("bridges_low") > 0, "low_bridges").when(F.col("bridges") > 0, "bridges"), F.when(alone, "no_bridge_to_h4")))
    whole = whole.select("component", status.alias("status"), "nodes", "edges", *BANDS, "bridges", "bridges_low", warnings.alias("warnings"))
    return rows.select("code", "component").join(whole, "component").select("code", "component", "status", "nodes", "edges", *BANDS, "bridges", "bridges_low", "warnings")
