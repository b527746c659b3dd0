"""Operator 12, embedding whitening by MLlib's computeSVD on centred distributed rows.

Vectors become whole numbers, so sums and deviations are exact. The components are fitted on each
distinct vector once. computeSVD gives the singular values of the centred rows, whose squares over n
are the eigenvalues of the covariance; all singular values are asked for, since MLlib then uses LAPACK
on the Gram matrix and not an iteration that ends at a tolerance. The total variance doesn't come from
the decomposition but from the exact deviations. What meets on the driver is sums by dimension and the
decomposition of a matrix of dimension x dimension, whatever the number of rows.
"""

from __future__ import annotations


import numpy as np
import pyarrow as pa
from pyspark.ml.functions import array_to_vector
from pyspark.mllib.linalg.distributed import RowMatrix
from pyspark.mllib.util import MLUtils
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .runtime import discard, materialize, ship
from .vectors import matrix, usable

SAFE = 1 << 62
TINY = 1e-12  # an eigenvalue below so many of the first is 0 but for rounding


def exact_sums(values: np.ndarray) -> list[int]:
    """The sums by column, in Python's numbers where 64 bits might not hold them."""
    most = max(abs(int(values.max())), abs(int(values.min()))) if values.size else 0
    return [int(t) for t in (values if most * len(values) < SAFE else values.astype(object)).sum(axis=0)]


def deviations(values: np.ndarray, n: int, sums: list[int]) -> list[int]:
    """Of each row the sum over dimensions of (n * x - S) ** 2, exact."""
    most = n * max(abs(int(values.max())), abs(int(values.min()))) + max(map(abs, sums))
    kind = np.int64 if most * most * values.shape[1] < SAFE else object
    gap = n * values.astype(kind) - np.array(sums, dtype=kind)
    return [int(t) for t in (gap * gap).sum(axis=1)]


LIMB = 60  # bits of a large number that travel as one long


def totals(rows: DataFrame, dimension: int, of, width: int, kind) -> list:
    """Sums by column of what `of` makes of each batch of rows(x): `width` numbers a task, then merged by column.

    kind: int for exact sums, which travel in limbs of 60 bits and so have no bound, or float."""

    def run(batches):
        total = [kind(0)] * width
        for b in batches:
            if b.num_rows:
                total = [s + t for s, t in zip(total, of(matrix(b.column("x"), dimension)))]
        limbs = [(at, 0, t) for at, t in enumerate(total)]
        if kind is int:
            split = lambda t: [(abs(t) >> LIMB * k & (1 << LIMB) - 1) * (1 if t > 0 else -1) for k in range(-(-abs(t).bit_length() // LIMB))]
            limbs = [(at, k, v) for at, t in enumerate(total) for k, v in enumerate(split(t))]
        at, limb, value = zip(*limbs) if limbs else ((), (), ())
        yield pa.RecordBatch.from_pydict({"at": pa.array(at, pa.int32()), "limb": pa.array(limb, pa.int32()), "value": pa.array(value, pa.int64() if kind is int else pa.float64())})

    out = rows.select("x").mapInArrow(run, f"at int, limb int, value {'long' if kind is int else 'double'}")
    value = F.col("value").cast("decimal(38,0)") if kind is int else F.col("value")
    found = [kind(0)] * width
    for at, limb, value in out.groupBy("at", "limb").agg(F.sum(value)).collect():
        found[at] += kind(value) << LIMB * limb if kind is int else value
    return found


def fit(fit_rows: DataFrame, dimension: int, components: int) -> dict | None:
    """fit_rows(x): n, sums, axes (components x dimension), eigenvalues, total variance and identity error; None without rows."""
    n = fit_rows.count()
    if not n:
        return None
    sums = totals(fit_rows, dimension, exact_sums, dimension, int)
    mean = [s / n for s in sums]
    centred = F.zip_with("x", F.lit(mean).cast("array<double>"), lambda a, b: a.cast("double") - b)
    vectors = MLUtils.convertVectorColumnsFromML(fit_rows.select(array_to_vector(centred).alias("v")), "v")
    svd = RowMatrix(vectors, n, dimension).computeSVD(dimension, computeU=False, rCond=1e-9)
    values = np.square(svd.s.toArray()) / n
    axes = svd.V.toArray().T
    some = min(components, int((values > max(values[0], 0) * TINY).sum())) if len(values) and values[0] > 0 else 0
    axes, values = axes[:some], values[:some]
    variance = sum(totals(fit_rows, dimension, lambda x: [sum(deviations(x, n, sums))], 1, int)) / n**3
    whiten = lambda x: (x - np.array(mean)) @ axes.T / np.sqrt(values)
    error = 0.0
    if some:
        middle = np.array(totals(fit_rows, dimension, lambda x: whiten(x).sum(axis=0).tolist(), some, float)) / n
        product = lambda w: (w.T @ w).ravel().tolist()
        covariance = np.array(totals(fit_rows, dimension, lambda x: product(whiten(x) - middle), some * some, float)) / n
        error = float(np.abs(covariance.reshape(some, some) - np.eye(some)).max())
    return {"n": n, "sums": sums, "mean": mean, "axes": axes, "values": values, "variance": variance, "identity_error": error}


def whitened(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", scale: int = 256, components: int = 4) -> DataFrame:
    """Per usable row of df and component: vec_id, component, n, deviation, whitened, explained, identity_error.

    An entry c becomes floor(scale * c) as a long, so beyond 2**63 / scale it stays at the bound. The
    components are fitted on each distinct vector once, so repeated rows weigh no more, and each gets
    its own rows of results; a null id stays null. Components without variance don't exist: one
    distinct vector alone has none, and so no rows. Equal eigenvalues have axes that are one choice of
    many. A deviation that no long holds is null. Rows whose vector is null, empty, of an uncommon
    length or with null or non-finite entries are dropped; a table without others gives no rows. Other
    columns are ignored, whatever their names.
    """
    spark = df.sparkSession
    ship(spark)
    rows, dimension = usable(df, vector_col, {"vec_id": id_col})
    rows = rows.select("vec_id", F.transform("vector", lambda c: F.floor(c.cast("double") * scale).cast("long")).alias("x"))
    schema = T.StructType([rows.schema["vec_id"], *T._parse_datatype_string("component int, n long, deviation long, whitened double, explained double, identity_error double").fields])
    if not dimension:
        return spark.createDataFrame([], schema)
    distinct = materialize(rows.select("x").distinct(), "whitening-fit")
    model = fit(distinct, dimension, components)
    discard(distinct)
    n, sums, mean, axes, values = (model[k] for k in ("n", "sums", "mean", "axes", "values"))
    some, share = len(values), [float(v) / model["variance"] for v in values]

    def run(batches):
        for b in batches:
            x = matrix(b.column("x"), dimension)
            if not len(x) or not some:
                continue
            out = (x - np.array(mean)) @ axes.T / np.sqrt(values)
            exact = [d if d < 1 << 63 else None for d in deviations(x, n, sums)]
            each = np.repeat(np.arange(len(x)), some)
            tile = lambda v, kind: pa.array(list(v) * len(x), kind)
            yield pa.RecordBatch.from_arrays(
                [b.column("vec_id").take(pa.array(each)), tile(range(1, some + 1), pa.int32()), tile([n] * some, pa.int64()), pa.array(exact, pa.int64()).take(pa.array(each)), pa.array(out.ravel(), pa.float64()), tile(share, pa.float64()), tile([model["identity_error"]] * some, pa.float64())],
                schema.names,
            )

    return rows.mapInArrow(run, schema)


__all__ = ["deviations", "exact_sums", "fit", "whitened"]
