"""Operator 13, vector code compression by product quantisation in whole numbers.

Vectors become NumPy blocks once: one block holds some thousand vectors as columns, dimension by
dimension, so that a part is a run of rows of the block. Each round is one RDD treeAggregate over the
blocks: distances of all vectors of a block to the entries of a part accumulate dimension by
dimension, np.add.at adds the vectors to the sums of their entries, and the int64 tensors of sums and
counts (parts x entries x dimensions, whatever the number of rows) merge through a tree of reductions.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .runtime import discard, materialize, ship
from .vectors import matrix, usable

LARGEST = 1 << 28  # of a whole number: squares of differences then fit in 64 bits, 32 dimensions a part
SMALL = 100_000  # rows of a table of label sums that may be broadcast


def whole(vectors: np.ndarray, scale: int) -> np.ndarray:
    return np.clip(np.floor(vectors.astype(np.float64) * scale), -LARGEST, LARGEST).astype(np.int32)


def nearest(block: np.ndarray, codebook: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of a part's block (dimensions x vectors): the index of the nearest entry of each vector, ties to the lower, and the squared distance."""
    far = np.zeros((len(codebook), block.shape[1]), dtype=np.int64)
    for d, values in enumerate(block):
        gap = values[None, :].astype(np.int64) - codebook[:, d, None]
        far += gap * gap
    codes = far.argmin(axis=0)
    return codes, far[codes, np.arange(block.shape[1])]


def gather(tally: tuple, block: np.ndarray, codebooks: np.ndarray) -> tuple:
    """Adds a block (dimensions x vectors) to the sums and counts of the entries that are nearest to it."""
    sums, counts = tally
    width = codebooks.shape[2]
    for p, codebook in enumerate(codebooks):
        part = block[p * width : (p + 1) * width]
        codes, _ = nearest(part, codebook)
        np.add.at(sums[p], codes, part.T)
        np.add.at(counts[p], codes, 1)
    return sums, counts


def blocks(rows: DataFrame, dimension: int, scale: int) -> DataFrame:
    """rows(vector) -> (n, cells): the whole numbers of n vectors, dimension by dimension."""

    def run(batches):
        for b in batches:
            if b.num_rows:
                cells = np.ascontiguousarray(whole(matrix(b.column("vector"), dimension), scale).T)
                yield pa.RecordBatch.from_pydict({"n": pa.array([b.num_rows], pa.int32()), "cells": pa.array([cells.tobytes()], pa.binary())})

    return rows.select("vector").mapInArrow(run, "n int, cells binary")


def train(rows: DataFrame, codebooks: np.ndarray, scale: int, rounds: int, depth: int = 3) -> np.ndarray:
    """The codebooks (parts x entries x width) after as many rounds over rows(vector)."""
    parts, entries, width = codebooks.shape
    table = materialize(blocks(rows, parts * width, scale), "vector-blocks")
    cells = table.rdd.map(lambda r: np.frombuffer(bytes(r["cells"]), dtype=np.int32).reshape(-1, r["n"]))
    for _ in range(rounds):
        zero = (np.zeros((parts, entries, width), np.int64), np.zeros((parts, entries), np.int64))
        now = codebooks
        sums, counts = cells.treeAggregate(zero, lambda t, b, now=now: gather(t, b, now), lambda a, b: (a[0] + b[0], a[1] + b[1]), depth)
        used = counts > 0
        codebooks = np.where(used[:, :, None], sums // np.maximum(counts, 1)[:, :, None], now)
    discard(table)
    return codebooks


def digest(codebooks: np.ndarray) -> str:
    return hashlib.sha256(",".join(map(str, codebooks.ravel().tolist())).encode()).hexdigest()


def encode(rows: DataFrame, codebooks: np.ndarray, scale: int) -> DataFrame:
    """rows(vec_id, label, vector) -> (vec_id, label, code, error)."""
    parts, _, width = codebooks.shape

    def run(batches):
        for b in batches:
            x = whole(matrix(b.column("vector"), parts * width), scale).T
            found = [nearest(x[p * width : (p + 1) * width], codebooks[p]) for p in range(parts)]
            text = np.stack([c for c, _ in found], axis=1).astype(np.uint8).tobytes().hex() if parts else ""
            code = [text[2 * parts * i : 2 * parts * (i + 1)] for i in range(b.num_rows)]
            yield pa.RecordBatch.from_arrays([b.column("vec_id"), b.column("label"), pa.array(code, pa.string()), pa.array(sum(e for _, e in found), pa.int64())], ["vec_id", "label", "code", "error"])

    schema = T.StructType([rows.schema["vec_id"], rows.schema["label"], T.StructField("code", T.StringType()), T.StructField("error", T.LongType())])
    return rows.select("vec_id", "label", "vector").mapInArrow(run, schema)


def vector_codes(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", scale: int = 4096, parts: int = 8, entries: int = 16, rounds: int = 6) -> DataFrame:
    """Per usable row of df: vec_id, code, error, label_error, codebooks_sha256.

    A component x becomes floor(scale * x), held within 2**28 on either side. A codebook starts as the
    rows with the smallest ids (null ids last; rows that share an id by their vectors); with fewer rows
    than entries it has as many entries as there are rows. Unused entries stay. Repeated rows are
    coded each and count each; null labels are one label. Rows whose vector is null, empty, of an
    uncommon length or with null or non-finite entries are dropped; a table without others gives no
    rows. The commonest length must be a multiple of parts, entries at most 256. Other columns are
    ignored, whatever their names.
    """
    spark = df.sparkSession
    ship(spark)
    rows, dimension = usable(df, vector_col, {"vec_id": id_col, "label": label_col})
    if dimension % parts:
        raise ValueError(f"vectors of {dimension} entries can't be cut into {parts} equal parts")
    if not 1 <= entries <= 256:
        raise ValueError("a code is one byte: entries must be 1 to 256")
    first = rows.orderBy(F.asc_nulls_last("vec_id"), "vector").limit(entries).select("vector").collect()
    start = whole(np.array([r[0] for r in first], dtype=np.float64).reshape(len(first), dimension), scale).astype(np.int64)
    codebooks = start.reshape(len(first), parts, dimension // parts).transpose(1, 0, 2)
    if not first:
        empty = T.StructType([rows.schema["vec_id"], *T._parse_datatype_string("code string, error long, label_error long, codebooks_sha256 string").fields])
        return spark.createDataFrame([], empty)
    codebooks = train(rows, codebooks, scale, rounds)
    coded = materialize(encode(rows, codebooks, scale), "vector-codes")
    sums = materialize(coded.groupBy(F.col("label").alias("of_label")).agg(F.sum("error").alias("label_error")), "label-errors")
    sums = F.broadcast(sums) if sums.count() <= SMALL else sums
    return coded.join(sums, F.col("label").eqNullSafe(F.col("of_label"))).select("vec_id", "code", "error", "label_error", F.lit(digest(codebooks)).alias("codebooks_sha256"))
