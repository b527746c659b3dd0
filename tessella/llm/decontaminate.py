"""Operator 1, benchmark decontamination by latent semantic retrieval.

1. Document frequencies of hashed words over the whole corpus give IDF weights.
2. A randomised SVD (range finder with power iterations, all products distributed) of the TF-IDF
   passages of all items of a block gives a latent space. No sample of the corpus is in it: what it
   must tell apart are the items, and where they have no more passages than it has dimensions, no
   cosine to them is approximate.
3. Every window of every text (8 to 128 words, starts 8 words apart) is projected, and its cosine to
   the benchmark passages picks candidates. A word adds at most a known number to the product with
   any passage; where the sum of these rules the cosine out, the projection is saved.
4. Around each candidate, the longest common subsequence with the whole item decides: a long share of
   the item, or a smaller one together with the item's answer (its last sentence), is a leak.

Benchmark items are taken in blocks of a stated size, so what is broadcast is bounded.
"""

from __future__ import annotations

import itertools
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .kernel import U, Words, blocks_of, bounded, collect_vector, lowered, slices
from .runtime import discard, materialize, ship

BITS = 18
DIM = 1 << BITS
BLOCK = 4096
STEP = 8  # words between starts of windows
SIZES = (1, 2, 4, 8, 16)  # lengths of windows, in steps
LONGEST = STEP * SIZES[-1]


def slot(h: np.ndarray) -> np.ndarray:
    return (h >> U(64 - BITS)).astype(np.int64)


def document_frequency(docs: DataFrame, text_col: str) -> tuple[np.ndarray, int]:
    """Texts in which each hashed word occurs, over all rows, and the number of rows."""

    def run(it):
        total, rows = np.zeros(DIM, dtype=np.int32), 0
        for batch in bounded(it, 0):
            rows += len(batch)
            for lo, hi, data, offs in slices(lowered(batch.column(0))):
                w = Words(data, offs)
                key = np.sort(w.docs() * DIM + slot(w.hash))
                new = np.ones(len(key), dtype=bool)
                new[1:] = key[1:] != key[:-1]
                total += np.bincount(key[new] % DIM, minlength=DIM).astype(np.int32)
        yield blocks_of(np.concatenate([total, np.full(BLOCK, rows, dtype=np.int32)]), BLOCK, "block", "counts")

    ship(docs.sparkSession)
    found = collect_vector(docs.select(text_col).mapInArrow(run, "block int, counts binary"), "counts", "block", BLOCK, DIM // BLOCK + 1, "int32")
    return found[:DIM], int(found[DIM])


def passage_list(text: str) -> list[np.ndarray]:
    """The word hashes of a text in passages of at most LONGEST words."""
    raw = np.frombuffer(text.lower().encode("utf-8", "replace"), dtype=np.uint8)
    h = Words(raw, np.array([0, len(raw)])).hash
    return [h[i : i + LONGEST] for i in range(0, len(h), LONGEST)]


def answer_start(text: str) -> int:
    """How many words of a text stand before its last sentence (0, where it has one sentence)."""
    body = text.rstrip().rstrip(".!?")
    cut = max(body.rfind(c) for c in ".!?\n")
    return len(re.findall(r"(?:[0-9a-z_]|[^\x00-\x7f])+", body[: cut + 1].lower())) if cut >= 0 else 0


def tfidf_row(h: np.ndarray, idf: np.ndarray, feature: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(features, weights) of a passage as a unit vector; the weights of words that are no feature are left out."""
    at, n = np.unique(slot(h), return_counts=True)
    x = n * idf[at]
    x = x / max(np.linalg.norm(x), 1e-12)
    known = feature[at] >= 0
    return feature[at[known]], x[known].astype(np.float32)


def latent_space(texts: DataFrame, idf: np.ndarray, feature: np.ndarray, rank: int, rounds: int = 1, seed: int = 5) -> np.ndarray:
    """features x rank basis: randomised SVD of the TF-IDF rows of the passages of texts(text).

    Each product A'(A q) is made in one pass: tasks add their own rows' share and the shares are
    summed, so the driver gets features x rank numbers, however many rows there are.
    """
    dim = int(feature.max()) + 1
    q = np.random.default_rng(seed).normal(size=(dim, rank)).astype(np.float32)

    def product(rows, q):
        out = np.zeros((dim, rank), dtype=np.float32)
        for at, x in rows:
            out[at] += x[:, None] * (x @ q[at])
        return out

    spark = texts.sparkSession
    tables = spark.sparkContext.broadcast((idf, feature))
    for _ in range(rounds + 1):
        shared = spark.sparkContext.broadcast(q)

        def run(it, shared=shared):
            out = np.zeros((dim, rank), dtype=np.float32)
            for batch in it:
                for text in batch.column(0).to_pylist():
                    out += product([tfidf_row(h, *tables.value) for h in passage_list(text)], shared.value)
            yield blocks_of(out.ravel(), dim * rank, "block", "part")

        found = collect_vector(texts.mapInArrow(run, "block int, part binary"), "part", "block", dim * rank, 1, "float32").reshape(dim, rank)
        q = np.linalg.qr(found)[0].astype(np.float32)
    return q


def lcs(item: list[int], window: list[int]) -> int:
    """Length of the longest common subsequence, bit-parallel."""
    where: dict[int, int] = {}
    for i, h in enumerate(item):
        where[h] = where.get(h, 0) | (1 << i)
    full = (1 << len(item)) - 1
    v = full
    for h in window:
        m = where.get(h, 0)
        if m:
            u = v & m
            v = ((v + u) | (v - u)) & full
    return len(item) - v.bit_count()


def searcher(spark: SparkSession, block: list[tuple[int, str]], idf: np.ndarray, rank: int, cosine: float, share: float, share_with_answer: float, answer_share: float):
    """A function that finds the leaks of one block of items in lower-case texts: [(row, item_id, cosine, lcs_share, answer_share)]."""
    words, owner, parts = [], [], []
    for k, (_, text) in enumerate(block):
        own = passage_list(text)
        words.append(np.concatenate(own) if own else np.empty(0, U))
        parts += own
        owner += [k] * len(own)
    feature = np.full(DIM, -1, dtype=np.int32)
    slots = np.unique(slot(np.concatenate(parts))) if parts else np.zeros(1, np.int64)
    feature[slots] = np.arange(len(slots))
    rows = [tfidf_row(h, idf, feature) for h in parts]
    rank = min(rank, len(slots))
    texts = materialize(spark.createDataFrame([(text,) for _, text in block], "text string"), "latent-items")
    basis = latent_space(texts, idf, feature, rank)
    discard(texts)
    latent = np.stack([x @ basis[at] for at, x in rows]) if rows else np.zeros((0, rank), np.float32)
    # Unit items: a window that is an item has cosine 1, whatever share of the item the space keeps.
    latent /= np.maximum((latent * latent).sum(1, keepdims=True), 1e-6)
    weights = np.vstack([basis, np.zeros((1, rank), np.float32)])  # the last row: words that are no feature
    most = np.maximum(0, (weights @ latent.T).max(1)) if len(latent) else np.zeros(len(weights))
    answers = [min(answer_start(t), max(0, len(w) - 1)) for (_, t), w in zip(block, words)]
    owner = np.array(owner, dtype=np.int64)
    # A passage is looked for in windows of the size that holds it and of the one below.
    fit = np.array([next(i for i, s in enumerate(SIZES) if STEP * s >= len(h)) for h in parts], dtype=np.int64)
    shared = spark.sparkContext.broadcast((weights, latent, feature, idf, [x.tolist() for x in words], answers, [set(x.tolist()) for x in words], owner, fit, most))
    names = [i for i, _ in block]

    def judge(h: list[int], lo: int, hi: int, k: int) -> tuple[float, float]:
        words, answers, kinds = shared.value[4:7]
        item = words[k]
        reach = max(STEP, len(item) // 4)
        if len(item) > hi - lo:
            reach += len(item) - (hi - lo)
        window = h[max(0, lo - reach) : hi + reach]
        # Words in common, with all repeats of the item, bound the subsequence.
        if len(kinds[k].intersection(window)) + len(item) - len(kinds[k]) < min(share, share_with_answer) * len(item):
            return 0.0, 0.0
        tail = item[answers[k] :]
        return lcs(item, window) / len(item), lcs(tail, window) / len(tail)

    def search(text: pa.Array) -> list[tuple]:
        weights, latent, feature, idf, _, _, _, owner, fit, most = shared.value
        out = []
        for lo, hi, data, offs in slices(text):
            w = Words(data, offs)
            if not len(w.hash) or not len(latent):
                continue
            raw = slot(w.hash)
            tf = idf[raw]
            mass = tf.astype(np.float64) ** 2
            f = feature[raw]
            part = np.concatenate([[0], np.cumsum(mass)])
            top = np.concatenate([[0], np.cumsum(tf * most[f])])
            counts = -(-w.n // STEP)
            begin = np.repeat(w.bounds[:-1], counts) + STEP * (np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts))
            limit = np.repeat(w.bounds[1:], counts)
            doc = np.repeat(np.arange(hi - lo), counts)
            best: dict = {}
            for i, s in enumerate(SIZES):
                mine = np.flatnonzero((fit == i) | (fit == i + 1))
                if not len(mine):
                    continue
                end = np.minimum(begin + STEP * s, limit)
                size = np.sqrt(part[end] - part[begin])
                kept = np.flatnonzero(top[end] - top[begin] >= cosine * size)
                for at in range(0, len(kept), 2048):
                    some = kept[at : at + 2048]
                    a, n = begin[some], end[some] - begin[some]
                    flat = np.repeat(a - (np.cumsum(n) - n), n) + np.arange(n.sum())
                    # The true length: a repeated word weighs as often as it occurs.
                    key, times = np.unique(np.repeat(np.arange(len(some)), n) * DIM + raw[flat], return_counts=True)
                    norm = np.sqrt(np.bincount(key // DIM, weights=(times * idf[key % DIM]) ** 2, minlength=len(some)))
                    ok = top[end[some]] - top[begin[some]] >= cosine * norm
                    if not ok.any():
                        continue
                    some, a, n, norm = some[ok], a[ok], n[ok], norm[ok]
                    flat = np.repeat(a - (np.cumsum(n) - n), n) + np.arange(n.sum())
                    g = f[flat]
                    z = np.add.reduceat(weights[g] * tf[flat][:, None], np.cumsum(n) - n)
                    near = (z @ latent[mine].T) / np.maximum(norm, 1e-6)[:, None]
                    for r, c in zip(*np.nonzero(near >= cosine)):
                        key = (int(doc[some[r]]), int(owner[mine[c]]))
                        best.setdefault(key, []).append((float(near[r, c]), int(a[r]), int(a[r] + n[r])))
            lists: dict = {}
            for (d, k), spans in best.items():
                if d not in lists:
                    lists[d] = w.hash[w.bounds[d] : w.bounds[d + 1]].tolist()
                base = int(w.bounds[d])
                found = None
                for c, a, b in sorted(spans, key=lambda x: (-x[0], x[1:])):
                    new = (*judge(lists[d], a - base, b - base, k), c)
                    found = max(found or new, new)
                    if found[0] == 1:
                        break
                if found and (found[0] >= share or (found[0] >= share_with_answer and found[1] >= answer_share)):
                    out.append((lo + d, names[k], found[2], found[0], found[1]))
        return out

    return search


def searchers(docs: DataFrame, benchmark: DataFrame, id_col: str, text_col: str, item_col: str = "item_id", item_text_col: str = "text", rank: int = 256, cosine: float = 0.5, share: float = 0.8, share_with_answer: float = 0.6, answer_share: float = 0.8, items_per_block: int = 2048) -> Iterator:
    """A searcher for each block of items. Document frequencies cover all of docs, the latent space all items of the block."""
    df, n = document_frequency(docs, text_col)
    idf = np.log((1 + n) / (1 + df)).astype(np.float32)
    items = benchmark.where(F.col(item_text_col).isNotNull() & F.col(item_col).isNotNull()).select(F.col(item_col).cast("long").alias("item_id"), F.col(item_text_col).alias("text")).orderBy("item_id", "text")
    rows, some = items.toLocalIterator(), False
    while block := [(r.item_id, r.text) for r in itertools.islice(rows, items_per_block)]:
        some = True
        yield searcher(docs.sparkSession, block, idf, rank, cosine, share, share_with_answer, answer_share)
    if not some:
        yield lambda text: []


LEAK = "doc_id long, item_id long, cosine double, lcs_share double, answer_share double"


def decontaminate(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """Leaks of benchmark items in documents: a row per (row of docs, item) with doc_id, item_id, cosine, lcs_share, answer_share.

    A leak shares `share` of the item's words in order, or `share_with_answer` of them and
    `answer_share` of its answer's (options: see searchers). Every whole text is searched. Null and
    empty texts and items hold no leak; an item repeated under several ids leaks under each; repeated
    document rows give a row each, and a null id stays null; further columns are ignored; an empty
    table gives no rows.
    """
    ship(docs.sparkSession)
    columns = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    out = None
    for search in searchers(docs, benchmark, id_col, text_col, **options):

        def run(it, search=search):
            for batch in bounded(it, 1):
                rows = search(lowered(batch.column(1)))
                if rows:
                    at, *rest = zip(*rows)
                    yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at)), *(pa.array(c, t) for c, t in zip(rest, (pa.int64(), pa.float64(), pa.float64(), pa.float64())))], ["doc_id", "item_id", "cosine", "lcs_share", "answer_share"])

        found = columns.mapInArrow(run, LEAK)
        out = found if out is None else out.unionByName(found)
    return out


def clean_documents(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The rows of docs that hold no leak, columns as given: passes without a shuffle, one for each block of items.

    Rows are judged each by its own text, so null and repeated ids do no harm.
    """
    ship(docs.sparkSession)
    out, at = docs, docs.columns.index(text_col)
    for search in searchers(docs, benchmark, id_col, text_col, **options):

        def run(it, search=search):
            for batch in bounded(it, at):
                keep = np.ones(len(batch), dtype=bool)
                keep[[r[0] for r in search(lowered(batch.column(at)))]] = False
                yield batch.filter(pa.array(keep))

        out = out.mapInArrow(run, docs.schema)
    return out


__all__ = ["clean_documents", "decontaminate", "latent_space", "lcs"]
