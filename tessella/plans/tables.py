"""Views of the driver's tables as the records that the operators work on."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

BANDS = [(853, "H1"), (1475, "H2"), (2676, "H3")]
BAND_ORDER = {"H1": 1, "H2": 2, "H3": 3, "H4": 4}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def band():
    c = F.lit("H4")
    for top, name in reversed(BANDS):
        c = F.when(F.col("n_chars") <= top, name).otherwise(c)
    return c


def std(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents as standard records."""
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("code"), F.col("lang").alias("subject_slug"), F.col("source").alias("domain"), F.col("text").alias("standard"), "n_chars", band().alias("grade_band"))


#: The same in SQL.
STD = "(select doc_id as code, lang as subject_slug, source as domain, text as standard, n_chars, case when n_chars <= 853 then 'H1' when n_chars <= 1475 then 'H2' when n_chars <= 2676 then 'H3' else 'H4' end as grade_band from documents)"


def tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """edges(a, b): region, nation, customer and supplier, from the outer to the inner."""
    n, c, s = table(spark, sf_dir, "nation"), table(spark, sf_dir, "customer"), table(spark, sf_dir, "supplier")
    key = lambda p, col: F.concat(F.lit(p), F.col(col).cast("string"))
    out = n.select(key("r", "n_regionkey").alias("a"), key("n", "n_nationkey").alias("b"))
    out = out.unionByName(c.select(key("n", "c_nationkey").alias("a"), key("c", "c_custkey").alias("b")))
    return out.unionByName(s.select(key("n", "s_nationkey").alias("a"), key("s", "s_suppkey").alias("b")))


TREE = "(select 'r'||n_regionkey as a, 'n'||n_nationkey as b from nation union all select 'n'||c_nationkey, 'c'||c_custkey from customer union all select 'n'||s_nationkey, 's'||s_suppkey from supplier)"
