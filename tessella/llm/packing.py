"""Operator 8, best-fit packing by sums of squares.

Documents become token ids in one pass (a task keeps the ids of each distinct white-space-free chunk,
so a chunk is tokenised once); only documents longer than a sequence are cut. A piece goes where the
sum over gaps of (open bins with that gap)^2 becomes smallest. Pieces are dealt over shards by a
hash, each shard packs on its own, and the bins that stay open are packed again as items by the same
rule, in rounds, until a round is one shard: what a shard leaves open does not add up.
"""

from __future__ import annotations

import re
import sys
import zlib
from array import array

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .kernel import bounded, chunks_of, one_byte_spaces, plain, set_apart
from .memory import Memory
from .runtime import materialize, ship

# White space to Python and Arrow, but not to the tokenizer, and what may be a special token.
ODD = "[\\x1c-\\x1f]|<\\|"
BEYOND = "[^\\x{00}-\\x{ff}]"  # beyond Latin-1
PUNCTUATION = np.isin(np.arange(256), list(b".,;:!?#$%&*|"))
ALPHANUMERIC = np.isin(np.arange(256), list(b"0123456789abcdefghijklmnopqrstuvwxyz"))
SHARP_S, LAST, DIVISION = 0x9F, 0xBF, 0xB7  # second bytes of the letters from sharp s on, and of the sign among them
KEPT = 1_000_000
TAKEN = 2 << 20  # bytes of text at a time: chunks, ids and their places take many times that
assert sys.byteorder == "little" and array("I").itemsize == 4
_models: dict = {}
_words: dict[str, Memory] = {}


def tokenizer(path: str):
    """The tokenizer, and for each id whether it ends a pre-token."""
    if path not in _models:
        from tokenizers import Tokenizer

        model = Tokenizer.from_file(path)
        ends = np.zeros(model.get_vocab_size(), dtype=bool)
        for piece, i in model.get_vocab().items():
            ends[i] = piece.endswith("</w>")
        _models[path], _words[path] = (model, ends), Memory(KEPT, "<u4")
    return _models[path]


def encode_words(words: list[str], path: str) -> list[bytes]:
    """The ids of each word: plain words in rows of 256, which the tokenizer splits again, others one by one."""
    model, ends = tokenizer(path)
    plain = [w for w in words if w.isalpha() and w.isascii()]  # one pre-token each
    out = {}
    rows = [plain[at : at + 256] for at in range(0, len(plain), 256)]
    for row, e in zip(rows, model.encode_batch_fast([" ".join(r) for r in rows], add_special_tokens=False)):
        ids = array("I", e.ids)
        raw = ids.tobytes()
        stops = ((np.flatnonzero(ends[np.frombuffer(ids, dtype=np.uint32)]) + 1) * 4).tolist()
        at = 0
        for w, stop in zip(row, stops, strict=True):
            out[w] = raw[at:stop]
            at = stop
    rest = [w for w in words if w not in out]
    for at in range(0, len(rest), 4096):
        part = rest[at : at + 4096]
        for w, e in zip(part, model.encode_batch_fast(part, add_special_tokens=False)):
            out[w] = array("I", e.ids).tobytes()
    return [out[w] for w in words]


def after_letter(before: np.ndarray, second: np.ndarray) -> np.ndarray:
    return ALPHANUMERIC[before] | ((second == 0xC3) & (before >= SHARP_S) & (before <= LAST) & (before != DIVISION))


def encode_documents(texts: pa.Array, path: str) -> tuple[np.ndarray, np.ndarray]:
    """(ids of all texts, one after the other; bounds by text).

    The tokenizer lower-cases, drops white space and takes a run of punctuation after a letter as a
    pre-token, so a text is the sum of its lower-case chunks between white space and of such runs;
    each distinct one is encoded once. Texts with other than Latin-1 characters are split at white
    space alone, and those with what may be a special token or with separators that aren't white
    space to the tokenizer are encoded whole.
    """
    model, _ = tokenizer(path)
    odd, wide = (pc.match_substring_regex(texts, p) for p in (ODD, BEYOND))
    whole = np.flatnonzero(odd.to_numpy(zero_copy_only=False))
    if len(whole):
        texts_read, texts = texts, pc.if_else(odd, "", texts)
    lower = one_byte_spaces(pc.utf8_lower(texts))
    apart = set_apart(pc.if_else(wide, "", lower) if pc.any(wide).as_py() else lower, PUNCTUATION, b" ", after_letter)
    chunks = chunks_of(pc.if_else(wide, one_byte_spaces(texts), apart) if pc.any(wide).as_py() else apart)
    coded = chunks.flatten().dictionary_encode()
    memory = _words[path]
    at = memory.places(coded.dictionary, lambda new: encode_words(new, path))[coded.indices.to_numpy(zero_copy_only=False)]
    n = memory.sizes[at]
    ends = np.cumsum(n)
    ids = memory.flat[np.repeat(memory.starts[at] - ends + n, n) + np.arange(ends[-1] if len(ends) else 0)]
    bounds = np.concatenate([[0], ends])[chunks.offsets.to_numpy() - chunks.offsets[0].as_py()]
    if len(whole):
        parts = np.split(ids, bounds[1:-1])
        for d in whole.tolist():
            parts[d] = np.array(model.encode(texts_read[d].as_py(), add_special_tokens=False).ids, dtype="<u4")
        ids, bounds = np.concatenate(parts), np.concatenate([[0], np.cumsum([len(p) for p in parts])])
    return ids, bounds


def pieces(docs: DataFrame, id_col: str, text_col: str, path: str, size: int, end_id: int) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32): documents with their end id, cut only where longer than size."""
    tail = np.array([end_id], dtype="<u4").tobytes()

    def run(it):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        for batch in bounded(it, 1, TAKEN):
            ids, bounds = encode_documents(plain(batch.column(1)), path)
            length = np.diff(bounds) + 1
            count = -(-length // size)
            doc = np.repeat(np.arange(len(batch)), count)
            piece = np.arange(len(doc)) - np.repeat(np.cumsum(count) - count, count)
            start = piece * size
            long = np.minimum(size, length[doc] - start)
            raw = memoryview(ids.tobytes())
            low, last = ((bounds[:-1][doc] + start) * 4).tolist(), (start + long == length[doc]).tolist()
            high = ((bounds[:-1][doc] + start + long) * 4).tolist()
            crc = [zlib.crc32(tail, zlib.crc32(raw[a : b - 4])) if end else zlib.crc32(raw[a:b]) for a, b, end in zip(low, high, last)]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(doc)), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(long, pa.int64()), pa.array(crc, pa.int64())], ["doc_id", "piece", "start", "length", "ids_crc32"])

    ship(docs.sparkSession)
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long")


def sum_of_squares(lengths: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Bin and offset of each item, in order. A full bin isn't open; ties go to the smallest gap, a new bin last."""
    count = np.zeros(size + 1, dtype=np.int64)  # of open bins by gap
    open_bins: list[list[int]] = [[] for _ in range(size + 1)]
    bins, offsets, fill = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64), []
    big = np.iinfo(np.int64).max // 4
    for k, n in enumerate(lengths.tolist()):
        if n == size:
            best, gap = 0, -1
        else:
            # From gap g to g - n: the sum changes by 2 * (count[g - n] - count[g] + 1), for g = n by 1 - 2 * count[n].
            cost = np.where(count[n:] > 0, 2 * (count[: size + 1 - n] - count[n:] + 1), big)
            if count[n]:
                cost[0] = 1 - 2 * count[n]
            gap = int(cost.argmin())
            best, gap = int(cost[gap]), gap + n
            if best > 2 * count[size - n] + 1:
                gap = -1
        if gap < 0:
            at = len(fill)
            fill.append(0)
        else:
            at = open_bins[gap].pop()
            count[gap] -= 1
        bins[k], offsets[k] = at, fill[at]
        fill[at] += n
        if fill[at] < size:
            open_bins[size - fill[at]].append(at)
            count[size - fill[at]] += 1
    return bins, offsets


def pack_shards(items: DataFrame, size: int, shards: int) -> DataFrame:
    """items(item, length) -> (item, bin, offset, filled): bins of `size`, made in as many shards."""
    def run(key, pdf: pd.DataFrame) -> pd.DataFrame:
        # Long items first leave few gaps, short ones then fill them.
        pdf = pdf.sort_values(["length", "item"], ascending=[False, True])
        bins, offsets = sum_of_squares(pdf.length.to_numpy(), size)
        fill = np.bincount(bins, weights=pdf.length).astype(np.int64)
        return pd.DataFrame({"item": pdf.item, "bin": bins * shards + key[0], "offset": offsets, "filled": fill[bins]})

    return items.withColumn("shard", F.pmod(F.xxhash64("item"), F.lit(shards)).cast("int")).groupBy("shard").applyInPandas(run, "item long, bin long, offset long, filled long")


LEVEL = 58  # bits of a number within a round


def pack(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", size: int = 2048, end_id: int = 0, shard_items: int = 4000) -> DataFrame:
    """Packs all documents into sequences of at most `size` tokens.

    Returns a row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset. A null or
    empty text has its end id alone; a null id stays null. Repeated rows of an id are packed each;
    further columns are ignored, whatever their names; an empty table gives no rows. A sequence_id is
    the round that closed the sequence and its number there, so no two share one.
    """
    cut = pieces(docs, id_col, text_col, path, size, end_id)
    cut = materialize(cut.withColumn("item", F.monotonically_increasing_id()), "pieces")
    named = lambda level, number: F.lit(level << LEVEL) + F.col(number)
    full = cut.where(F.col("length") == size).select("item", named(0, "item").alias("seq"), F.lit(0).cast("long").alias("base"))
    items, place, level, n = cut.where(F.col("length") < size).select("item", "length"), None, 0, None
    n = items.count()
    # place: of every item so far its sequence and offset. The bins that stay open are the next round's items.
    while n > 1 or place is None:
        level, shards = level + 1, max(1, -(-n // shard_items))
        packed = materialize(pack_shards(items, size, shards), f"packed-{level}")
        if place is None:
            place = packed.select("item", named(1, "bin").alias("seq"), F.col("offset").alias("base"))
        else:
            moved = packed.select(named(level - 1, "item").alias("seq"), named(level, "bin").alias("new"), F.col("offset").alias("more"))
            place = place.join(moved, "seq", "left").select("item", F.coalesce("new", "seq").alias("seq"), (F.col("base") + F.coalesce("more", F.lit(0))).alias("base"))
        items = packed.where(F.col("filled") < size).groupBy("bin").agg(F.max("filled").alias("length")).select(F.col("bin").alias("item"), "length")
        before, n = n, items.count()
        if shards == 1 or n >= before:
            break
    place = place.unionByName(full)
    return cut.join(place, "item").select("doc_id", "piece", "start", "length", "ids_crc32", F.col("seq").alias("sequence_id"), F.col("base").alias("offset"))
