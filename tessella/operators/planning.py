"""Plans: parsing, coverage by decisions, schedules."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

# The lines of a plan that open a unit (its title is the second group) and that state a goal.
UNIT_LINE = r"(?i)^(?:单元|Unit)\s*([0-9一二三四五六七八九十]*)\s*[.、:：-]?\s*(.+)$"
GOAL_LINE = r"(?:学习目标|目标|goal)\s*[:：]\s*(.+)$"


def parse_units(lines: DataFrame, plan: str, ordinal: str, line: str) -> DataFrame:
    """(plan, unit_no, title, goals): unit lines open a unit, goal lines belong to the latest one before them."""
    w = Window.partitionBy(plan).orderBy(ordinal)
    unit = F.regexp_extract(F.trim(line), UNIT_LINE, 2)
    goal = F.regexp_extract(F.trim(line), GOAL_LINE, 1)
    rows = lines.select(plan, ordinal, F.nullif(F.trim(unit), F.lit("")).alias("title"), F.nullif(F.trim(goal), F.lit("")).alias("goal"))
    rows = rows.withColumn("unit_no", F.sum(F.when(F.col("title").isNotNull(), 1).otherwise(0)).over(w)).where("unit_no > 0")
    return rows.groupBy(plan, "unit_no").agg(F.max("title").alias("title"), F.transform(F.array_sort(F.collect_list(F.when(F.col("goal").isNotNull() & F.col("title").isNull(), F.struct(ordinal, "goal")))), lambda g: g["goal"]).alias("goals"))


def latest_decisions(decisions: DataFrame, keys: list[str], order: str, value: str) -> DataFrame:
    """The last decision of each key."""
    return decisions.groupBy(*keys).agg(F.max_by(value, order).alias(value))


def coverage(candidates: DataFrame, decisions: DataFrame, keys: list[str], code: str, value: str = "decision", accepted: str = "accepted") -> DataFrame:
    """(code, n_accepted, is_duplicate): codes with the number of units that accept them; no decision covers nothing."""
    kept = candidates.select(*keys).distinct().join(decisions.where(F.col(value) == accepted), keys, "left_semi")
    return kept.groupBy(code).agg(F.count("*").alias("n_accepted"), (F.count("*") > 1).alias("is_duplicate"))


def gaps(scope: DataFrame, covered: DataFrame, code: str) -> DataFrame:
    return scope.select(code).distinct().join(covered.select(code), code, "left_anti")


def schedule(plans: DataFrame, units: DataFrame, plan: str, weeks: str, review: list[int], exam: list[int]) -> DataFrame:
    """(plan, week, type, unit_no): exam before review before teaching; week w has unit floor((w - 1) / W * U)."""
    n = units.groupBy(plan).agg(F.count("*").alias("n_units"))
    rows = plans.join(n, plan).select(plan, F.explode(F.sequence(F.lit(1), F.greatest(F.col(weeks), F.lit(1)))).alias("week"), F.greatest(F.col(weeks), F.lit(1)).alias("total"), "n_units")
    kind = F.when(F.col("week").isin(exam), "exam").when(F.col("week").isin(review), "review").otherwise("teaching")
    unit = F.least(F.col("n_units") - 1, F.floor((F.col("week") - 1) * F.col("n_units") / F.col("total"))).cast("int") + 1
    return rows.withColumn("type", kind).select(plan, "week", "type", F.when(F.col("type") == "teaching", unit).alias("unit_no"))


def timetable(lessons: DataFrame, group: str, order: list[str], days: int) -> DataFrame:
    """Lessons dealt over days in turn: each goes to the least loaded day, the first of them."""
    w = Window.partitionBy(group).orderBy(*order)
    return lessons.withColumn("day", F.pmod(F.row_number().over(w) - 1, F.lit(days)) + 1)
