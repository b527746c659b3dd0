"""Readers and writers of record collections."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException


def read_documents(spark: SparkSession, path: str, rows: str, schema: str) -> DataFrame:
    """One JSON document per file, its list `rows` exploded."""
    return spark.read.schema(f"{rows} array<struct<{schema}>>").json(path, multiLine=True).select(F.explode(rows).alias("r")).select("r.*")


def read_lines(spark: SparkSession, path: str, schema: str, strict: bool = True) -> DataFrame:
    """JSON lines, blank ones left out; malformed ones fail, or are dropped when not strict."""
    return spark.read.schema(schema).json(path, mode="FAILFAST" if strict else "DROPMALFORMED")


def read_or_empty(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON lines, or an empty table of the schema where there is no such path."""
    try:
        return spark.read.schema(schema).json(path)
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return spark.createDataFrame([], schema)


def read_partitions(spark: SparkSession, path: str, column: str, values: list[str] | None = None) -> DataFrame:
    """A table partitioned by column, only the partitions asked for; an unknown value gives no rows."""
    df = spark.read.parquet(path)
    return df.where(F.col(column).isin(values)) if values is not None else df


def markdown_blocks(text: Column) -> Column:
    """array<struct<kind, text>> of the lines of a text: heading, list, quote, or paragraph, without their marks."""
    lines = F.filter(F.transform(F.split(F.coalesce(text, F.lit("")), "\r?\n"), lambda x: F.trim(x)), lambda x: x != "")
    kind = lambda x: F.when(x.rlike(r"^#{1,6}\s"), "heading").when(x.rlike(r"^([-*+]|\d+\.)\s"), "list").when(x.rlike("^>"), "quote").otherwise("paragraph")
    return F.transform(lines, lambda x: F.struct(kind(x).alias("kind"), F.trim(F.regexp_replace(x, r"^(#{1,6}\s+|[-*+]\s+|\d+\.\s+|>\s*)", "")).alias("text")))


ENTITIES = (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&"))
BLOCK_TAGS = r"(?i)</?(?:p|div|br|ul|ol|table|tr|article|section|header|footer|nav|main|title|h[1-6]|li|blockquote)\b[^>]*>"


def html_lines(html: Column) -> Column:
    """A page as lines: where a block begins or ends there is a line break; headings, list items and quotes get the marks that markdown_blocks reads."""
    t = F.regexp_replace(F.regexp_replace(html, r"(?is)<(script|style)\b.*?</\1>|<!--.*?-->", " "), r"\s+", " ")
    for tag, mark in ((r"(?i)<h[1-6]\b[^>]*>", "# "), (r"(?i)<li\b[^>]*>", "- "), (r"(?i)<blockquote\b[^>]*>", "> ")):
        t = F.regexp_replace(t, tag, "\n" + mark)
    t = F.regexp_replace(F.regexp_replace(t, BLOCK_TAGS, "\n"), "<[^>]+>", " ")
    for name, to in ENTITIES:
        t = F.replace(t, F.lit(name), F.lit(to))
    return F.regexp_replace(t, " +", " ")


def html_text(html: Column) -> Column:
    """The text of a page: scripts, styles, comments and tags go, the five named entities are read."""
    t = F.regexp_replace(html, r"(?is)<(script|style)\b.*?</\1>|<!--.*?-->|<[^>]+>", " ")
    for name, to in ENTITIES:
        t = F.replace(t, F.lit(name), F.lit(to))
    return F.trim(F.regexp_replace(t, r"\s+", " "))


def stable_json(df: DataFrame) -> DataFrame:
    """(json): each row with its keys in order."""
    return df.select(F.to_json(F.struct(*sorted(df.columns))).alias("json"))


def write_partitioned(df: DataFrame, path: str, column: str) -> None:
    """A folder per value of column; rows of a value are dealt over tasks by a hash, so a large one isn't one file's work."""
    df.repartition(F.col(column), F.pmod(F.xxhash64(*df.columns), F.lit(8))).write.mode("overwrite").partitionBy(column).parquet(path)


def manifest(tables: dict[str, DataFrame]) -> DataFrame:
    """(name, n_rows, digest) of tables; the digest is of a sum of row hashes, so it doesn't depend on the order of rows."""
    out = None
    for name, df in tables.items():
        text = F.concat_ws("\x1f", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in sorted(df.columns)])
        number = F.conv(F.substring(F.md5(text.cast("binary")), 1, 15), 16, 10).cast("decimal(38,0)")
        row = df.agg(F.count("*").alias("n_rows"), F.sha2(F.coalesce(F.sum(number), F.lit(0)).cast("decimal(38,0)").cast("string"), 256).alias("digest")).withColumn("name", F.lit(name))
        out = row if out is None else out.unionByName(row)
    return out.select("name", "n_rows", "digest")


def write_generation(tables: dict[str, DataFrame], path: str) -> DataFrame:
    """Writes each table and then the manifest; a generation without a manifest isn't complete."""
    for name, df in tables.items():
        df.write.parquet(f"{path}/{name}")
    m = manifest(tables)
    m.coalesce(1).write.json(f"{path}/manifest")
    return m


def append_events(stream: DataFrame, path: str, checkpoint: str):
    """A stream's events as JSON lines."""
    return stream.writeStream.format("json").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
