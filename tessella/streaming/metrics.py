"""Request metrics, over batches and streams alike."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..scratch import fresh


def rollup(events: DataFrame, dims: list[str], value: str) -> DataFrame:
    """(dim, key, n, total, most): counts, sums and maxima by each dimension and over all, in one pass. Sums are of cents."""
    cells = F.array(F.struct(F.lit("all").alias("dim"), F.lit("all").alias("key")), *[F.struct(F.lit(d).alias("dim"), F.col(d).cast("string").alias("key")) for d in dims])
    rows = events.select(F.explode(cells).alias("c"), F.col(value).alias("v")).select("c.*", "v")
    return rows.groupBy("dim", "key").agg(F.count("*").alias("n"), F.sum(F.col("v").cast("decimal(18,4)")).cast("double").alias("total"), F.max("v").alias("most"))


def limited(events: DataFrame, key: list[str], ts: str, order: str, limit: int, every: str = "1 minute") -> DataFrame:
    """Adds bucket, place, allowed, remaining: requests beyond the limit of their minute count, too, but aren't allowed."""
    b = events.withColumn("bucket", F.window(ts, every)["start"])
    place = F.row_number().over(Window.partitionBy(*key, "bucket").orderBy(ts, order))
    return b.withColumn("place", place).withColumn("allowed", F.col("place") <= limit).withColumn("remaining", F.greatest(F.lit(0), F.lit(limit) - F.col("place")))


def keep_last(events: DataFrame, day: Column, order: list[Column], n: int) -> DataFrame:
    """The newest n events of each day."""
    return events.withColumn("day", day).withColumn("_r", F.row_number().over(Window.partitionBy("day").orderBy(*order))).where(F.col("_r") <= n).drop("_r")


def guarded(events: DataFrame, col: str, schema: str) -> DataFrame:
    """Events whose JSON parses to the schema with no null field, with it as `parsed`."""
    p = events.withColumn("parsed", F.from_json(col, schema))
    ok = F.col("parsed").isNotNull()
    for part in schema.split(","):
        ok = ok & F.col(f"parsed.{part.split()[0]}").isNotNull()
    return p.where(ok)


def windowed(events: DataFrame, ts: str, key: str, value: str, size: str, slide: str | None = None, late: str | None = None) -> DataFrame:
    """Counts and sums by window and key; works on a stream with a watermark of `late`."""
    if late:
        events = events.withWatermark(ts, late)
    w = F.window(ts, size, slide) if slide else F.window(ts, size)
    return events.groupBy(w.alias("w"), key).agg(F.count("*").alias("n"), F.sum(F.col(value).cast("decimal(18,4)")).cast("double").alias("total")).select(F.col("w.start").alias("start"), key, "n", "total")


def sessions(events: DataFrame, ts: str, key: str, gap: str) -> DataFrame:
    return events.groupBy(F.session_window(ts, gap).alias("w"), key).agg(F.count("*").alias("n")).select(key, F.col("w.start").alias("start"), "n")


def run_stream(stream: DataFrame, name: str) -> DataFrame:
    """Runs a bounded stream to its end and returns what it then holds: each batch is written as Parquet, the last one read."""
    base, last = fresh(stream.sparkSession, "streams", name), []

    def put(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{base}/batch-{number}")
        last[:] = [number]

    stream.writeStream.outputMode("complete").option("checkpointLocation", f"{base}/state").foreachBatch(put).trigger(availableNow=True).start().awaitTermination()
    if not last:
        return stream.sparkSession.createDataFrame([], stream.schema)
    return stream.sparkSession.read.schema(stream.schema).parquet(f"{base}/batch-{last[0]}")
