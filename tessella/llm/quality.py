"""Operator 10, quality by attention-based multiple-instance learning.

A document is a bag of passages of 48 words (the last one may be shorter). Each passage is encoded
from its bytes and words; gated attention weights the encodings, and the weighted mean is scored.
All parts are learned together from document labels alone, on a bounded sample of labelled rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .kernel import Words, bounded, plain, slices
from .runtime import hash_fraction, materialize, ship

PASSAGE = 48
HIDDEN = 16
# Classes of bytes of which a passage's shares are features.
GROUPS = ["abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789", " ", "\n\r", "\t", ".", ",", "!", "?", "#", "$", "%", "&", "*", "|", "<>", "()[]{}", "\"'", "+/=_-", ":;", "@"]
CLASS = np.full(256, len(GROUPS), dtype=np.int64)  # other ASCII
for _i, _g in enumerate(GROUPS):
    CLASS[[ord(c) for c in _g]] = _i
CLASS[128:] = len(GROUPS) + 1
N_CLASS = len(GROUPS) + 2
WIDTH = N_CLASS + 6
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def passages(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(passages x WIDTH features, bounds by document); a document without words is one passage."""
    w = Words(LOWER[data], offs)
    count = np.maximum(1, -(-w.n // PASSAGE))
    bounds = np.concatenate([[0], np.cumsum(count)])
    total = bounds[-1]
    doc_of = w.docs()
    own = np.arange(len(w.hash)) - w.bounds[:-1][doc_of]
    passage = bounds[:-1][doc_of] + own // PASSAGE
    # A byte belongs to the passage of the last word that began, or to the document's first passage.
    byte_passage = np.zeros(len(data), dtype=np.int64)
    first = np.searchsorted(w.starts, np.arange(len(data)), side="right") - 1 if len(data) else np.empty(0, np.int64)
    byte_doc = np.repeat(np.arange(len(offs) - 1), np.diff(offs))
    inside = (first >= 0) & (first >= w.bounds[:-1][byte_doc]) if len(data) else np.empty(0, bool)
    byte_passage[inside] = passage[first[inside]]
    byte_passage[~inside] = bounds[:-1][byte_doc[~inside]]
    x = np.zeros((total, WIDTH), dtype=np.float32)
    counts = np.bincount(byte_passage * N_CLASS + CLASS[data], minlength=total * N_CLASS).reshape(total, N_CLASS)
    size = counts.sum(1)
    x[:, :N_CLASS] = np.sqrt(counts / np.maximum(size, 1)[:, None])
    words = np.bincount(passage, minlength=total)
    some = np.maximum(words, 1)
    order = np.lexsort((w.hash, passage))
    h, p = w.hash[order], passage[order]
    new = np.ones(len(h), dtype=bool)
    new[1:] = (h[1:] != h[:-1]) | (p[1:] != p[:-1])
    kinds = np.bincount(p[new], minlength=total)
    runs = np.diff(np.r_[np.flatnonzero(new), len(h)])
    most = np.zeros(total)
    np.maximum.at(most, p[new], runs)
    again = np.zeros(len(w.hash), dtype=bool)
    again[1:] = (w.hash[1:] == w.hash[:-1]) & (passage[1:] == passage[:-1])
    lengths = np.bincount(passage, weights=w.ends - w.starts, minlength=total)
    x[:, N_CLASS:] = np.stack([kinds / some, most / some, np.bincount(passage, weights=again, minlength=total) / some, lengths / some / 8, np.log1p(words) / 4, np.log1p(count.repeat(count)) / 5], axis=1)
    return x, bounds


def forward(x: np.ndarray, bounds: np.ndarray, m: dict):
    """Scores of the bags, with what the gradient needs."""
    h = np.tanh(x @ m["w"] + m["wb"])
    v, u = np.tanh(h @ m["v"]), 1 / (1 + np.exp(-(h @ m["u"])))
    a = (v * u) @ m["a"]
    at = bounds[:-1]
    bag = np.repeat(np.arange(len(at)), np.diff(bounds))
    e = np.exp(a - np.maximum.reduceat(a, at)[bag])
    weight = e / np.add.reduceat(e, at)[bag]
    z = np.add.reduceat(h * weight[:, None], at)
    p = 1 / (1 + np.exp(-np.clip(z @ m["c"] + m["cb"], -30, 30)))
    return p, (h, v, u, weight, z, bag, at)


def gradient(x: np.ndarray, bounds: np.ndarray, y: np.ndarray, m: dict) -> dict:
    """Of the mean logistic loss of the bags, for each part of the model."""
    p, (h, v, u, weight, z, bag, at) = forward(x, bounds, m)
    d = (p - y) / len(y)
    dz = d[:, None] * m["c"]
    dw = (h * dz[bag]).sum(1)
    da = weight * (dw - np.add.reduceat(weight * dw, at)[bag])
    dv, du = da[:, None] * m["a"] * u * (1 - v * v), da[:, None] * m["a"] * v * u * (1 - u)
    dh = (weight[:, None] * dz[bag] + dv @ m["v"].T + du @ m["u"].T) * (1 - h * h)
    return {"w": x.T @ dh, "wb": dh.sum(0), "v": h.T @ dv, "u": h.T @ du, "a": (v * u).T @ da, "c": z.T @ d, "cb": d.sum(keepdims=True)}


def train(x: np.ndarray, bounds: np.ndarray, y: np.ndarray, epochs: int = 40, batch: int = 256, rate: float = 0.01, seed: int = 7) -> dict:
    """Adam on the logistic loss of the bags."""
    r = np.random.default_rng(seed)
    mean, std = x.mean(0), x.std(0) + 1e-3
    x = ((x - mean) / std).astype(np.float64)
    m = {"w": r.normal(0, x.shape[1] ** -0.5, (x.shape[1], HIDDEN)), "wb": np.zeros(HIDDEN), "v": r.normal(0, HIDDEN**-0.5, (HIDDEN, HIDDEN)), "u": r.normal(0, HIDDEN**-0.5, (HIDDEN, HIDDEN)), "a": r.normal(0, HIDDEN**-0.5, HIDDEN), "c": r.normal(0, HIDDEN**-0.5, HIDDEN), "cb": np.zeros(1)}
    first, second, step = {k: np.zeros_like(v) for k, v in m.items()}, {k: np.zeros_like(v) for k, v in m.items()}, 0
    for epoch in range(epochs):
        for part in np.array_split(r.permutation(len(y)), max(1, len(y) // batch)):
            rows = np.concatenate([np.arange(bounds[d], bounds[d + 1]) for d in part])
            xb, bb = x[rows], np.concatenate([[0], np.cumsum(np.diff(bounds)[part])])
            grad = gradient(xb, bb, y[part], m)
            step += 1
            lr = rate * (1 - epoch / epochs)
            for k, g in grad.items():
                g = g + 1e-5 * m[k]
                first[k] = 0.9 * first[k] + 0.1 * g
                second[k] = 0.999 * second[k] + 0.001 * g * g
                m[k] -= lr * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.999**step)) + 1e-8)
    return m | {"mean": mean, "std": std}


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", max_labels: int = 8000) -> dict:
    """The model from about max_labels labelled rows (nulls left out, of repeated ids one counts).

    Further columns are ignored; null and empty texts are one empty passage; an empty table, or labels
    of one kind only, give a model with one answer.
    """
    ship(docs.sparkSession)
    labels = labels.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("int").alias("label")).where("id is not null and label is not null").groupBy("id").agg(F.max("label").alias("label"))
    sample = labels.where(hash_fraction("id", max_labels, labels.count()))

    def run(it):
        for batch in bounded(it, 1):
            ids, label = batch.column(0), batch.column(2)
            for lo, hi, data, offs in slices(plain(batch.column(1))):
                x, bounds = passages(data, offs)
                yield pa.RecordBatch.from_arrays([ids.slice(lo, hi - lo), label.slice(lo, hi - lo), pa.array([x[bounds[d] : bounds[d + 1]].tobytes() for d in range(hi - lo)], pa.binary())], ["id", "label", "x"])

    joined = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).join(F.broadcast(sample), "id")
    rows = materialize(joined.select("id", "text", "label").mapInArrow(run, "id long, label int, x binary"), "bags").toPandas().sort_values("id", kind="stable", ignore_index=True)
    if rows.label.nunique() < 2:
        return {"constant": float(rows.label.iloc[0]) if len(rows) else 1.0}
    bags = [np.frombuffer(x, dtype=np.float32).reshape(-1, WIDTH) for x in rows.x]
    return train(np.concatenate(bags), np.concatenate([[0], np.cumsum([len(b) for b in bags])]), rows.label.to_numpy().astype(float))


def score(docs: DataFrame, model: dict, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, score) of every whole text; null and empty texts are one empty passage.

    Repeated ids give a row each and a null id stays null; further columns are ignored; an empty table
    gives no rows.

    A model that has seen one label only, or none, gives that label (1 for none) to all.
    """

    def run(it):
        for batch in bounded(it, 1):
            ids = batch.column(0)
            for lo, hi, data, offs in slices(plain(batch.column(1))):
                if "constant" in model:
                    p = np.full(hi - lo, model["constant"])
                else:
                    x, bounds = passages(data, offs)
                    p = forward((x - model["mean"]) / model["std"], bounds, model)[0]
                yield pa.RecordBatch.from_arrays([ids.slice(lo, hi - lo), pa.array(p, pa.float64())], ["doc_id", "score"])

    ship(docs.sparkSession)
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, "doc_id long, score double")
