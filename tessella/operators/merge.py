"""Generations of records: upsert, replacement, audit."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def latest(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The last row of each key by order: one aggregation, no sort of the whole."""
    cols = [c for c in df.columns if c not in keys]
    return df.groupBy(*keys).agg(F.max_by(F.struct(*cols), F.struct(*order)).alias("r")).select(*keys, "r.*")


def first(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    cols = [c for c in df.columns if c not in keys]
    return df.groupBy(*keys).agg(F.min_by(F.struct(*cols), F.struct(*order)).alias("r")).select(*keys, "r.*")


def merge_generations(generations: list[DataFrame], keys: list[str], done: DataFrame | None = None) -> DataFrame:
    """Later generations override earlier ones; keys that are done go."""
    rows = None
    for k, g in enumerate(generations):
        g = g.withColumn("_gen", F.lit(k))
        rows = g if rows is None else rows.unionByName(g, allowMissingColumns=True)
    out = latest(rows, keys, ["_gen"]).drop("_gen")
    return out.join(done.select(*keys), keys, "left_anti") if done is not None else out


def replace_source(current: DataFrame, new: DataFrame, source: str, children: dict[str, tuple[DataFrame, str]] | None = None, key: str = "id") -> tuple[DataFrame, dict[str, DataFrame]]:
    """All rows of the sources in `new` are replaced; children of rows that are gone go too."""
    out = current.join(new.select(source).distinct(), source, "left_anti").unionByName(new)
    return out, {n: df.join(out.select(F.col(key).alias(fk)), fk, "left_semi") for n, (df, fk) in (children or {}).items()}


def audit_generation(parents: DataFrame, children: DataFrame, key: str, foreign: str, parent_hash: str, child_hash: str) -> DataFrame:
    """(finding, n): children without a parent, children made from another version of it, parents without children."""
    joined = children.join(parents.select(F.col(key).alias(foreign), F.col(parent_hash).alias("_h")), foreign, "left")
    one = joined.agg(F.count_if(F.col("_h").isNull()).alias("orphan"), F.count_if(F.col("_h") != F.col(child_hash)).alias("stale"))
    childless = parents.join(children.select(F.col(foreign).alias(key)), key, "left_anti").agg(F.count("*").alias("n")).withColumn("finding", F.lit("childless"))
    return one.select(F.explode(F.array(F.struct(F.lit("orphan").alias("finding"), F.col("orphan").alias("n")), F.struct(F.lit("stale").alias("finding"), F.col("stale").alias("n")))).alias("r")).select("r.*").unionByName(childless.select("finding", "n"))
