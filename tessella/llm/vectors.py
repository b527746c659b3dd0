"""Rows of vectors as whole numbers: what operators 12 and 13 share."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def usable(df: DataFrame, vector_col: str, carry: dict[str, str]) -> tuple[DataFrame, int]:
    """(rows, dimension): the columns in carry under their new names, and the vector as `vector`.

    Vectors that are null, empty or hold null or non-finite entries are dropped, and so are those of
    another length than the commonest (of two as common, the longer): they lie in another space.
    """
    v = F.col(vector_col)
    finite = F.forall(v, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf")))
    rows = df.select(*[F.col(c).alias(n) for n, c in carry.items()], v.alias("vector")).where(F.coalesce((F.size(v) > 0) & finite, F.lit(False)))
    top = rows.groupBy(F.size("vector").alias("size")).count().orderBy(F.desc("count"), F.desc("size")).head()
    return (rows.where(F.size("vector") == top["size"]), top["size"]) if top else (rows, 0)


def matrix(column: pa.Array, dimension: int) -> np.ndarray:
    """A list column without nulls as an array of rows."""
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dimension)
