"""Rules, worklists, decisions and index audits, each as rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def violations(df: DataFrame, key: Column, rules: dict[str, Column]) -> DataFrame:
    """(rule, key) of every broken rule, in one pass; a rule is a condition that holds where it is broken."""
    found = F.array_compact(F.array(*[F.when(c, F.lit(n)) for n, c in rules.items()]))
    return df.select(key.cast("string").alias("key"), F.explode(found).alias("rule"))


def rule_counts(df: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """(rule, n), zeros too."""
    one = df.agg(*[F.coalesce(F.sum(F.when(c, 1).otherwise(0)), F.lit(0)).alias(n) for n, c in rules.items()])
    return one.select(F.explode(F.array(*[F.struct(F.lit(n).alias("rule"), F.col(n).cast("long").alias("n")) for n in rules])).alias("r")).select("r.*")


def repeated(df: DataFrame, key: str) -> DataFrame:
    return df.groupBy(key).agg(F.count("*").alias("n")).where("n > 1")


def same_rows(expected: DataFrame, actual: DataFrame) -> DataFrame:
    """(side, n): rows that only one of them has."""
    a = expected.exceptAll(actual).agg(F.count("*").alias("n")).withColumn("side", F.lit("missing"))
    return a.unionByName(actual.exceptAll(expected).agg(F.count("*").alias("n")).withColumn("side", F.lit("unexpected")))


def worklist(df: DataFrame, key: str, risks: dict[str, Column], priorities: list[tuple[str, Column]], default: str = "P3") -> DataFrame:
    """(key, risks, priority) of rows with any risk; the first priority that holds."""
    found = F.array_compact(F.array(*[F.when(c, F.lit(n)) for n, c in risks.items()]))
    p = None
    for name, c in priorities:
        p = F.when(c, name) if p is None else p.when(c, name)
    return df.select(F.col(key), found.alias("risks"), (p.otherwise(default) if p is not None else F.lit(default)).alias("priority")).where(F.size("risks") > 0)


def overlay(items: DataFrame, decisions: DataFrame, keys: list[str], order: str, default: str = "pending") -> DataFrame:
    """Items with their latest decision, or the default."""
    last = decisions.groupBy(*keys).agg(F.max_by("decision", order).alias("decision"))
    return items.join(last, keys, "left").withColumn("decision", F.coalesce("decision", F.lit(default)))


def audit(items: DataFrame, decisions: DataFrame, keys: list[str]) -> DataFrame:
    """(finding, n): repeated keys, conflicting decisions, unknown keys, undecided items."""
    per = decisions.groupBy(*keys).agg(F.count("*").alias("rows"), F.count_distinct("decision").alias("kinds"))
    counts = [("repeated", per.where("rows > 1")), ("conflicting", per.where("kinds > 1")), ("unknown", per.join(items, keys, "left_anti")), ("undecided", items.select(*keys).distinct().join(per, keys, "left_anti"))]
    out = None
    for name, df in counts:
        row = df.agg(F.count("*").alias("n")).withColumn("finding", F.lit(name))
        out = row if out is None else out.unionByName(row)
    return out


def grounded(df: DataFrame, key: str, fields: list[str], trust: str) -> DataFrame:
    """(key, field, bucket): each content field is official, structured or excluded with the first reason that holds.

    trust is a map column field -> struct(provenance, feedback, flags).
    """
    cells = df.select(F.col(key).alias("key"), F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).cast("string").alias("value"), F.col(trust)[f].alias("t")) for f in fields])).alias("c")).select("key", "c.*").where("value is not null and value <> ''")
    bucket = F.when(F.col("t.provenance").isNull(), "missing_provenance").when(F.col("t.feedback"), "ai_feedback_loop").when(F.size("t.flags") > 0, "quality_flagged").when(F.col("t.provenance") == "official", "official").otherwise("structured")
    return cells.select("key", "field", bucket.alias("bucket"))
