"""Operator 4, language identification by nearest centroid.

Texts become TF-IDF vectors of hashed byte n-grams (1 + ln tf, corpus IDF, unit length). Each language
has several centroids, clustered by spherical k-means from a bounded sample of its labelled texts;
a text takes the language of the centroid with the largest cosine. A text that is farther from its
centroid than nearly all texts of that centroid's own sample is marked as rejected.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .kernel import U, blocks_of, bounded, collect_vector, lowered, slices
from .runtime import hash_fraction, ship

DIM = 4096
BLOCK = 1024
SPACE = 32
LETTER = np.full(256, SPACE, dtype=np.uint8)
LETTER[[*range(97, 123), *range(128, 256)]] = [*range(97, 123), *range(128, 256)]


def gram_counts(text: pa.Array):
    """(first row, end row, documents x DIM counts): byte 2- to 4-grams of letters, other bytes as one space."""
    for lo, hi, data, offs in slices(text, 1 << 18, 512):
        at = LETTER[data].astype(U)
        n = len(at)
        out = np.zeros((hi - lo) * DIM, dtype=np.float32)
        doc = np.repeat(np.arange(hi - lo), np.diff(offs))
        if n:
            left = offs[1:][doc] - np.arange(n)  # bytes of the document from here on
            key = np.zeros(n, dtype=U)
            solid = np.zeros(n, dtype=bool)
            for size in range(1, 5):
                m = n - size + 1
                if m < 1:
                    break
                key[:m] = key[:m] * U(257) + at[size - 1 :] + U(1)
                solid[:m] |= at[size - 1 :] != SPACE
                if size > 1:
                    ok = np.flatnonzero((left[:m] >= size) & solid[:m])
                    slot = ((key[ok] * U(0x9E3779B97F4A7C15)) >> U(52)).astype(np.int64)
                    out += np.bincount(doc[ok] * DIM + slot, minlength=len(out)).astype(np.float32)
        yield lo, hi, out.reshape(hi - lo, DIM)


def weighted(counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    x = np.log1p(counts) * idf
    size = np.sqrt((x * x).sum(1, keepdims=True))
    return x / np.where(size > 0, size, 1)


def document_frequency(docs: DataFrame, text_col: str) -> tuple[np.ndarray, int]:
    """Texts in which each hashed n-gram occurs, over all rows, and the number of texts with any."""

    def run(it):
        total, texts = np.zeros(DIM, dtype=np.int64), 0
        for batch in bounded(it, 0):
            for _, _, counts in gram_counts(lowered(batch.column(0))):
                total += (counts > 0).sum(0)
                texts += int((counts.any(1)).sum())
        yield blocks_of(np.concatenate([total, np.full(BLOCK, texts, dtype=np.int64)]), BLOCK, "block", "counts")

    found = collect_vector(docs.select(text_col).mapInArrow(run, "block int, counts binary"), "counts", "block", BLOCK, DIM // BLOCK + 1)
    return found[:DIM], int(found[DIM])


def spherical_kmeans(x: np.ndarray, k: int, rounds: int = 12) -> np.ndarray:
    """Unit centroids; the first is the row nearest the mean, each next one the row farthest from those before."""
    mean = x.mean(0)
    start = [int((x @ mean).argmax())]
    near = x @ x[start[0]]
    while len(start) < min(k, len(x)):
        start.append(int(near.argmin()))
        near = np.maximum(near, x @ x[start[-1]])
    c = x[start]
    for _ in range(rounds):
        own = (x @ c.T).argmax(1)
        new = np.stack([x[own == j].sum(0) if (own == j).any() else c[j] for j in range(len(c))])
        new /= np.maximum(np.linalg.norm(new, axis=1, keepdims=True), 1e-12)
        if np.allclose(new, c, atol=1e-6):
            break
        c = new
    return c


def fit(train: DataFrame, id_col: str, text_col: str, label_col: str, centroids: int, sample_per_label: int, reject_share: float) -> dict:
    """Centroids by language from at most about sample_per_label texts each; IDF from all rows of train."""
    ship(train.sparkSession)
    train = train.where(F.col(label_col).isNotNull() & F.col(text_col).isNotNull())
    df, n = document_frequency(train, text_col)
    idf = (np.log((1 + n) / (1 + df)) + 1).astype(np.float32)
    sizes = train.groupBy(label_col).count().collect()
    chosen = None
    for name, size in sizes:
        own = (F.col(label_col) == F.lit(name)) & hash_fraction(id_col, sample_per_label, size)
        chosen = own if chosen is None else chosen | own
    if chosen is None:
        return {"labels": [], "centroids": np.zeros((0, DIM), np.float32), "idf": idf, "radius": np.zeros(0)}

    def vectors(it):
        for batch in bounded(it, 1):
            for lo, hi, counts in gram_counts(lowered(batch.column(1))):
                x = weighted(counts, idf).astype(np.float16)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), pa.array([v.tobytes() for v in x], pa.binary()), batch.column(2).slice(lo, hi - lo)], ["label", "x", "id"])

    def cluster(key, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("id")
        x = np.stack([np.frombuffer(v, dtype=np.float16) for v in pdf.x]).astype(np.float32)
        x = x[x.any(1)]
        if not len(x):
            return pd.DataFrame({"label": [], "c": [], "radius": []})
        c = spherical_kmeans(x, centroids)
        own = x @ c.T
        best = own.argmax(1)
        radius = [float(np.quantile(own[best == j, j], reject_share)) if (best == j).any() else 0.0 for j in range(len(c))]
        return pd.DataFrame({"label": key[0], "c": [v.astype(np.float32).tobytes() for v in c], "radius": radius})

    sample = train.where(chosen).select(F.col(label_col).cast("string").alias("label"), text_col, F.col(id_col).cast("long").alias("id"))
    fitted = sample.mapInArrow(vectors, "label string, x binary, id long").groupBy("label").applyInPandas(cluster, "label string, c binary, radius double").collect()
    fitted.sort(key=lambda r: (r.label, r.c))
    return {"labels": [r.label for r in fitted], "centroids": np.stack([np.frombuffer(r.c, dtype=np.float32) for r in fitted]) if fitted else np.zeros((0, DIM), np.float32), "idf": idf, "radius": np.array([r.radius for r in fitted])}


def identify(docs: DataFrame, model: dict, id_col: str = "doc_id", text_col: str = "text", unknown: str = "und") -> DataFrame:
    """(doc_id, lang_pred, score, rejected) of every whole text.

    score is the cosine to the nearest centroid. Null texts and texts without a letter get `unknown`
    and 0, as do all texts where the model has learned no language. rejected: farther from the
    centroid than its own sample is, but for a small share. Ties go to the first label by name.
    """
    labels, c, idf, radius = model["labels"], model["centroids"], model["idf"], model["radius"]

    def run(it):
        for batch in bounded(it, 1):
            ids, raw = batch.column(0), batch.column(1)
            text = lowered(raw)
            for lo, hi, counts in gram_counts(text):
                lang, score, far = [unknown] * (hi - lo), np.zeros(hi - lo), np.zeros(hi - lo, dtype=bool)
                letters = [any(map(str.isalpha, x)) for x in text.slice(lo, hi - lo).to_pylist()]
                if len(labels):
                    near = weighted(counts, idf) @ c.T
                    best = near.argmax(1)
                    for d in np.flatnonzero(letters):
                        lang[d], score[d] = labels[best[d]], min(1.0, max(0.0, float(near[d, best[d]])))
                        far[d] = near[d, best[d]] < radius[best[d]]
                yield pa.RecordBatch.from_arrays([ids.slice(lo, hi - lo), pa.array(lang, pa.string()), pa.array(score), pa.array(far)], ["doc_id", "lang_pred", "score", "rejected"])

    ship(docs.sparkSession)
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, "doc_id long, lang_pred string, score double, rejected boolean")


def language_id(docs: DataFrame, train, id_col: str = "doc_id", text_col: str = "text", label_col: str = "lang", centroids: int = 4, sample_per_label: int = 1000, reject_share: float = 0.005) -> DataFrame:
    """Fits on the rows of docs where `train` (a column) holds, then identifies every row of docs."""
    return identify(docs, fit(docs.where(train), id_col, text_col, label_col, centroids, sample_per_label, reject_share), id_col, text_col)


__all__ = ["fit", "identify", "language_id"]
