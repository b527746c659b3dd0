"""Summaries, set operations and record projections that several queries share."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import canonical


def counted(rows: DataFrame, conditions: dict[str, Column]) -> DataFrame:
    """(rule, n) of each condition, in one pass."""
    one = rows.agg(*[F.count_if(c).alias(n) for n, c in conditions.items()])
    return one.unpivot([], list(conditions), "rule", "n")


def tallies(rows: DataFrame, columns: list[str]) -> DataFrame:
    """(side, status, n) for each column of statuses."""
    cells = F.array(*[F.struct(F.lit(c).alias("side"), F.col(c).alias("status")) for c in columns])
    return rows.select(F.explode(cells).alias("c")).select("c.*").groupBy("side", "status").agg(F.count("*").alias("n"))


def columns_present(rows: DataFrame, columns: list[str]) -> DataFrame:
    """(column, n): how many rows have a value in each column; those that none has are left out."""
    cells = F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).isNotNull().alias("has")) for c in columns])
    return rows.select(F.explode(cells).alias("c")).where("c.has").groupBy(F.col("c.column").alias("column")).agg(F.count("*").alias("n"))


def first_distinct(values: Column) -> Column:
    """Each value once, in the order of first appearance."""
    return F.array_distinct(values)


def set_compare(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """(key, side): both, left or right."""
    rows = a.select(key, F.lit(1).alias("l"), F.lit(0).alias("r")).unionByName(b.select(key, F.lit(0).alias("l"), F.lit(1).alias("r")))
    sides = rows.groupBy(key).agg(F.max("l").alias("l"), F.max("r").alias("r"))
    return sides.select(key, F.when(F.col("l") + F.col("r") == 2, "both").when(F.col("l") == 1, "left").otherwise("right").alias("side"))


def merge_editions(sources: list[DataFrame], keys: list[str], order: list[str]) -> DataFrame:
    """Candidates of several editions: of equal keys the first source's first row stays, with the number of sources that have it."""
    rows = reduce(DataFrame.unionByName, [s.withColumn("_source", F.lit(k)) for k, s in enumerate(sources)])
    w = Window.partitionBy(*keys)
    ranked = rows.withColumn("_place", F.row_number().over(w.orderBy("_source", *order))).withColumn("editions", F.size(F.collect_set("_source").over(w)))
    return ranked.where("_place = 1").drop("_place", "_source")


def restored(current: DataFrame, deleted: DataFrame, key: str) -> DataFrame:
    """Rows after deleted ones come back: an existing row wins over a restored one of its key."""
    return current.withColumn("origin", F.lit("current")).unionByName(deleted.join(current.select(key), key, "left_anti").withColumn("origin", F.lit("restored")))


def carry_over(new: DataFrame, legacy: DataFrame, keys: list[str]) -> DataFrame:
    """New rows, and the approved legacy rows that no new row has: an approval is never lost."""
    if set(new.columns) == set(keys):  # both sides in one shuffle
        both = new.select(*keys, F.lit(True).alias("_new"), F.lit(False).alias("_old")).unionByName(legacy.select(*keys, F.lit(False).alias("_new"), F.lit(True).alias("_old")))
        met = both.groupBy(*keys).agg(F.max("_new").alias("_new"), F.max("_old").alias("_old"))
        return met.select(*new.columns, F.when(~F.col("_new"), "carried_over").when(F.col("_old"), "kept").otherwise("new").alias("status"))
    known = new.join(legacy.select(*keys).withColumn("_old", F.lit(True)), keys, "left")
    kept = known.withColumn("status", F.when(F.col("_old"), "kept").otherwise("new")).drop("_old")
    return kept.unionByName(legacy.select(*new.columns).join(new.select(*keys), keys, "left_anti").withColumn("status", F.lit("carried_over")))


def compare_relations(rows: DataFrame, node: str, relation: str, nodes: int) -> DataFrame:
    """(relation, n, common): relation types of the compared nodes; common where all `nodes` of them have it."""
    return rows.groupBy(relation).agg(F.count("*").alias("n"), (F.count_distinct(node) == nodes).alias("common"))


def typed_id(prefix: str, parts: list[Column], size: int = 16) -> Column:
    """prefix_ and the first digits of the SHA-256 of the parts, joined by a unit separator; a null part is empty."""
    return F.concat(F.lit(prefix + "_"), F.substring(F.sha2(F.concat_ws("\x1f", *[F.coalesce(p.cast("string"), F.lit("")) for p in parts]), 256), 1, size))


def forbidden_keys(rows: DataFrame, key: str, json: str, names: list[str]) -> DataFrame:
    """(key, name) of the forbidden names that are keys of a JSON text, at any depth; malformed texts have none."""
    return canonical.forbidden(rows, key, json, names).select(key, "name").distinct()


def quote_box(lines: DataFrame, page: str, order: str, text: str, boxes: list[str], quotes: DataFrame, quote: str) -> DataFrame:
    """(page, quote, x0, y0, x1, y1) of quotes that stand exactly once in a page's joined lines: the union
    of the boxes of the lines they touch. lines(page, order, text, x0, y0, x1, y1), quotes(page, quote)."""
    w = Window.partitionBy(page).orderBy(order)
    placed = lines.withColumn("_end", F.sum(F.length(text)).over(w)).withColumn("_start", F.col("_end") - F.length(text))
    whole = lines.groupBy(page).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order, text))), lambda x: x[text]), "").alias("_whole"))
    at = F.instr(F.col("_whole"), F.col(quote))
    again = F.instr(F.substr(F.col("_whole"), at + 1), F.col(quote))
    found = quotes.join(whole, page).withColumn("_at", at - 1).where((F.col("_at") >= 0) & (again == 0)).select(page, quote, "_at", (F.col("_at") + F.length(quote)).alias("_to"))
    touched = found.join(placed, page).where((F.col("_start") < F.col("_to")) & (F.col("_end") > F.col("_at")))
    x0, y0, x1, y1 = boxes
    return touched.groupBy(page, quote).agg(F.min(x0).alias("x0"), F.min(y0).alias("y0"), F.max(x1).alias("x1"), F.max(y1).alias("y1"))
