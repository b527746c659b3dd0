"""Histograms, inverted indexes, and comparisons of records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def counted(df: DataFrame, by: list[str], name: str = "n") -> DataFrame:
    return df.groupBy(*by).agg(F.count("*").alias(name))


def histograms(df: DataFrame, group: str, facets: list[str], missing: str | None = None) -> DataFrame:
    """(group, facet, value, n) for several facets in one pass: GROUPING SETS, not one job a facet.

    Empty values are left out, or counted as `missing` where that is given.
    """
    rows = df.select(F.col(group).alias("grp"), F.explode(F.array(*[F.struct(F.lit(f).alias("facet"), F.nullif(F.trim(F.col(f).cast("string")), F.lit("")).alias("value")) for f in facets])).alias("f")).select("grp", "f.facet", "f.value")
    rows = rows.fillna({"value": missing}) if missing else rows.where("value is not null")
    return counted(rows, ["grp", "facet", "value"])


def count_into(df: DataFrame, col: str, missing: str = "missing") -> DataFrame:
    return df.groupBy(F.coalesce(F.nullif(F.col(col).cast("string"), F.lit("")), F.lit(missing)).alias("value")).agg(F.count("*").alias("n"))


def inverted_index(df: DataFrame, key: Column, value: Column) -> DataFrame:
    """(key, member) once each, so that no key is one task's work; list columns are exploded by the caller."""
    return df.select(key.alias("key"), value.alias("member")).where("key is not null").distinct()


def alias_index(df: DataFrame, code: str, aliases: Column) -> DataFrame:
    """(alias, code) once each: upper-case aliases of codes; a code is no alias of itself."""
    rows = df.select(F.col(code).alias("code"), F.explode(aliases).alias("alias")).select("code", F.upper(F.trim("alias")).alias("alias")).where("alias <> '' and alias <> upper(code)")
    return rows.select("alias", "code").distinct()


def nested_histogram(df: DataFrame, outer: str, inner: str, fallback: str = "other") -> DataFrame:
    """(outer, total, inner list by count descending, then name)."""
    rows = counted(df.select(F.coalesce(outer, F.lit(fallback)).alias("outer"), F.coalesce(inner, F.lit(fallback)).alias("inner")), ["outer", "inner"])
    lists = F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("minus"), "inner")))
    return rows.groupBy("outer").agg(F.sum("n").alias("total"), F.transform(lists, lambda x: F.concat(x["inner"], F.lit(":"), (-x["minus"]).cast("string"))).alias("inners"))


def common_fields(df: DataFrame, fields: list[str]) -> DataFrame:
    """(field, is_common): whether a field's serialised value is equal in all rows, null included."""
    cells = df.select(F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.coalesce(F.col(f).cast("string"), F.lit("␀")).alias("value")) for f in fields])).alias("c")).select("c.*")
    return cells.groupBy("field").agg((F.min("value") == F.max("value")).alias("is_common"))


def document_frequency(tokens: DataFrame, doc: str, token: str) -> DataFrame:
    """(token, df) over distinct (document, token) rows."""
    return tokens.select(doc, token).distinct().groupBy(token).agg(F.count("*").alias("df"))


def idf(n: Column, df: Column) -> Column:
    return F.log(1 + (n + 1) / (df + 1))


def merge_claims(df: DataFrame, key: list[str], order: Column, lists: list[str], best: list[str], approved: Column) -> DataFrame:
    """One card per key: lists united and sorted, best values, any approval, and the first claim by order."""
    return df.groupBy(*key).agg(*[F.sort_array(F.array_distinct(F.flatten(F.collect_list(c)))).alias(c) for c in lists], *[F.max(c).alias(c) for c in best], F.bool_or(approved).alias("approved"), F.min(order).alias("first_claim"))
