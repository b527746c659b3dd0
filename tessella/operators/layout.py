"""Rows of a page from its items: first-fit clustering by baseline, where each item has a tolerance of its own."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Shares of an item's height, and bounds in points.
TOLERANCE_SHARE, LEAST_TOLERANCE, MOST_TOLERANCE = 0.34, 2.5, 8.0
SPACE_SHARE, LEAST_SPACE = 0.18, 1.8


def tolerance(height: Column) -> Column:
    return F.greatest(F.lit(LEAST_TOLERANCE), F.least(F.lit(MOST_TOLERANCE), height * TOLERANCE_SHARE))


def runs(items: DataFrame) -> DataFrame:
    """items with `run`: items of different runs of a page are further apart than any tolerance.

    A page is cut into cells as high as the largest tolerance; between items on either side of an empty
    cell no row can reach. Only distinct cells are put in order, so a page with very many items is no
    group of its own."""
    cell = F.floor(F.col("baseline") / MOST_TOLERANCE).cast("long")
    cells = items.select("page", cell.alias("cell")).distinct()
    order = Window.partitionBy("page").orderBy("cell")
    fresh = F.when(F.col("cell") - F.lag("cell").over(order) == 1, 0).otherwise(1)
    islands = cells.withColumn("fresh", fresh).withColumn("run", F.sum("fresh").over(order)).select("page", "cell", "run")
    return items.withColumn("cell", cell).join(islands, ["page", "cell"]).drop("cell")


def assign(items: DataFrame) -> DataFrame:
    """items(page, item, text, x, baseline, width, height) with row_baseline, that of the first item of their row.

    Items are taken from the top, then from the left, then by item; one joins the first row whose
    baseline is within its own tolerance, or begins a row. Items without text, baseline or x are left
    out; a null page is a page. Rows are followed within a run only.
    """
    usable = items.where((F.trim(F.coalesce("text", F.lit(""))) != "") & F.col("baseline").isNotNull() & F.col("x").isNotNull())
    usable = usable.withColumns({"page": F.col("page").cast("string"), "height": F.greatest(F.lit(1.0), F.coalesce(F.col("height").cast("double"), F.lit(0.0))), "width": F.coalesce(F.col("width").cast("double"), F.lit(0.0))}).withColumn("tolerance", tolerance(F.col("height")))
    named = usable.withColumn("page", F.coalesce("page", F.lit("")))
    placed = runs(named)

    def follow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, rows = None, []
        for batch in batches:
            at = [batch.column(batch.schema.names.index(c)) for c in ("page", "run", "baseline", "tolerance")]
            new = np.ones(len(batch), dtype=bool)
            for c in at[:2]:  # where page or run is another than that of the item before
                same = pc.equal(c[1:], c[:-1]).to_numpy(zero_copy_only=False)
                new[1:] = same if c is at[0] else new[1:] & same
            new[1:] = ~new[1:]
            if len(batch):
                new[0] = (at[0][0].as_py(), at[1][0].as_py()) != key
                key = (at[0][-1].as_py(), at[1][-1].as_py())
            out = []
            for fresh, b, t in zip(new.tolist(), at[2].to_pylist(), at[3].to_pylist()):
                if fresh:
                    rows = []
                for r in rows:
                    if abs(r - b) <= t:
                        out.append(r)
                        break
                else:
                    # Rows further up than the largest tolerance are out of reach for good.
                    rows = [*(r for r in rows if r - b <= MOST_TOLERANCE), b]
                    out.append(b)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.float64())], [*batch.schema.names, "row_baseline"])

    # A task takes the items of its runs one behind the other and keeps the rows within reach only.
    placed = placed.withColumn("baseline", F.col("baseline").cast("double"))
    ordered = placed.repartition("page", "run").sortWithinPartitions("page", "run", F.desc("baseline"), "x", "item")
    schema = T.StructType([*ordered.schema.fields, T.StructField("row_baseline", T.DoubleType())])
    return ordered.mapInArrow(follow, schema).drop("tolerance", "run")


def rows(items: DataFrame) -> DataFrame:
    """(page, row, text, x0, y0, x1, y1): the rows of each page from the top, their texts from left to right, with a space where the gap is wide, and their boxes.

    Boxes reach from baseline - height to baseline, as far as 0."""
    placed = assign(items).withColumn("base", F.col("baseline").cast("double"))
    cells = F.array_sort(F.collect_list(F.struct(F.col("x").cast("double").alias("x"), (-F.col("base")).alias("minus"), "item", "text", "width", "height")))
    top = F.greatest(F.lit(0.0), F.col("base") - F.col("height"))
    lines = placed.groupBy("page", "row_baseline").agg(cells.alias("cells"), F.min(F.col("x").cast("double")).alias("x0"), F.min(top).alias("y0"), F.max(F.col("x").cast("double") + F.col("width")).alias("x1"), F.max(top + F.col("height")).alias("y1"))
    gap = lambda c, i: c["x"] - (F.get("cells", i - 1)["x"] + F.get("cells", i - 1)["width"])
    wide = lambda c, i: (i > 0) & (gap(c, i) > F.greatest(F.lit(LEAST_SPACE), c["height"] * SPACE_SHARE))
    text = F.array_join(F.transform("cells", lambda c, i: F.concat(F.when(wide(c, i), " ").otherwise(""), F.trim(c["text"]))), "")
    number = F.row_number().over(Window.partitionBy("page").orderBy(F.desc("row_baseline")))
    return lines.select("page", number.alias("row"), text.alias("text"), "x0", "y0", "x1", "y1")
