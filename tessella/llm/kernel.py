"""Vectorised text primitives for Arrow batches: words, hashes, shingles, and sums of count vectors.

A word is a maximal run of ASCII letters, digits, underscores and non-ASCII characters of the
lower-cased text. Hashes are 64-bit polynomial hashes with a final mix; nothing here keeps more
than about a megabyte of text (or one document, if that is longer) in expanded form.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U = np.uint64
BASE = 0x9E3779B97F4A7C15
INVERSE = pow(BASE, -1, 1 << 64)
WORD = np.zeros(256, dtype=bool)
WORD[[*range(48, 58), *range(97, 123), 95, *range(128, 256)]] = True
SLICE = 1 << 18
LIMIT = 4 << 20  # bytes of text that a worker takes at a time
_powers: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        have = np.full(max(n, SLICE + 1), base, dtype=U)
        have[0] = 1
        _powers[base] = have = np.cumprod(have, dtype=U)
        if n > 4 * SLICE:  # of one very long text: not kept
            _powers.pop(base)
    return have[:n]


def mix(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> U(30))
    h = h * U(0xBF58476D1CE4E5B9)
    h = h ^ (h >> U(27))
    h = h * U(0x94D049BB133111EB)
    return h ^ (h >> U(31))


def lowered(column) -> pa.Array:
    """Lower-cased text; null becomes empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return pc.utf8_lower(pc.fill_null(column, ""))


def plain(column) -> pa.Array:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return pc.fill_null(column, "")


WIDE_SPACE = "[\\x{85}\\x{a0}\\x{1680}\\x{2000}-\\x{200a}\\x{2028}\\x{2029}\\x{202f}\\x{205f}\\x{3000}]"
SPACE = np.isin(np.arange(256), [*range(9, 14), *range(28, 33)])


def one_byte_spaces(texts: pa.Array) -> pa.Array:
    """Texts whose white space is ASCII."""
    return pc.replace_substring_regex(texts, WIDE_SPACE, " ") if pc.any(pc.match_substring_regex(texts, WIDE_SPACE)).as_py() else texts


def set_apart(texts: pa.Array, runs: np.ndarray, mark: bytes, fits=None) -> pa.Array:
    """Texts with `mark` before each run of bytes of `runs` that ends a chunk between white space and
    does not begin it; fits(last byte before the run, the one before that) may leave out some."""
    _, where, data = texts.buffers()
    offs = np.frombuffer(where, dtype=np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    raw = np.frombuffer(data, dtype=np.uint8)[offs[0] : offs[-1]] if data is not None else np.empty(0, np.uint8)
    offs = offs - offs[0]
    inside = runs[raw]
    begins, stops = inside.copy(), inside.copy()
    begins[1:] &= ~inside[:-1]
    stops[:-1] &= ~inside[1:]
    cuts = offs[(offs > 0) & (offs < len(raw))]
    begins[cuts], stops[cuts - 1] = inside[cuts], inside[cuts - 1]
    begins, stops = np.flatnonzero(begins), np.flatnonzero(stops) + 1
    edge = np.zeros(len(raw) + 1, dtype=bool)
    edge[offs] = True
    before, second = raw[np.maximum(begins - 1, 0)], raw[np.maximum(begins - 2, 0)]
    ok = ~edge[begins] & ~SPACE[before] & (edge[stops] | SPACE[np.append(raw, np.uint8(32))[stops]])
    at = begins[ok & fits(before, second)] if fits is not None else begins[ok]
    new = np.insert(raw, np.repeat(at, len(mark)), np.tile(np.frombuffer(mark, dtype=np.uint8), len(at)))
    offs = offs + len(mark) * np.searchsorted(at, offs, side="left")
    return pa.StringArray.from_buffers(len(texts), pa.py_buffer(offs.astype(np.int32)), pa.py_buffer(new))


BLANK = np.where(SPACE, 32, np.arange(256)).astype(np.uint8)


def chunks_of(texts: pa.Array) -> pa.ListArray:
    """The chunks between ASCII white space of each text, empty ones between neighbouring spaces and at the ends.

    (Arrow's own split at white space now and then returns the white space at the end of a text.)
    """
    _, where, data = texts.buffers()
    offs = np.frombuffer(where, dtype=np.int32)[texts.offset : texts.offset + len(texts) + 1]
    raw = np.frombuffer(data, dtype=np.uint8)[offs[0] : offs[-1]] if data is not None else np.empty(0, np.uint8)
    return pc.split_pattern(pa.StringArray.from_buffers(len(texts), pa.py_buffer(offs - offs[0]), pa.py_buffer(BLANK[raw])), " ")


try:
    _trim = ctypes.CDLL(None).malloc_trim
except (OSError, AttributeError):  # not glibc
    _trim = None


def release() -> None:
    """Gives freed memory back to the system: workers live on from task to task, and what they keep adds up."""
    pa.default_memory_pool().release_unused()
    if _trim is not None:
        _trim(0)


def bounded(batches: Iterator[pa.RecordBatch], column: int, limit: int = LIMIT) -> Iterator[pa.RecordBatch]:
    """The rows of batches in parts of at most about `limit` bytes of a text column, so that what a worker makes of them stays small."""
    for batch in batches:
        sizes = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        at = 0
        while at < len(batch):
            end = int(np.searchsorted(sizes, (sizes[at - 1] if at else 0) + limit, side="right"))
            end = max(end, at + 1)
            yield batch.slice(at, end - at)
            at = end
        release()


def slices(text: pa.Array, limit: int = SLICE, rows: int = 1 << 31) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets of the rows in them), about `limit` bytes and at most `rows` rows at a time."""
    kind = np.int64 if pa.types.is_large_string(text.type) else np.int32
    n = len(text)
    if not n:
        return
    _, where, data = text.buffers()
    offs = np.frombuffer(where, dtype=kind)[text.offset : text.offset + n + 1].astype(np.int64)
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.empty(0, np.uint8)
    at = 0
    while at < n:
        end = int(np.searchsorted(offs, offs[at] + limit, side="right")) - 1
        end = min(max(end, at + 1), at + rows, n)
        yield at, end, raw[offs[at] : offs[end]], offs[at : end + 1] - offs[at]
        at = end


class Words:
    """The words of a slice: starts, ends, hash, and bounds (document d has words bounds[d]:bounds[d+1])."""

    def __init__(self, data: np.ndarray, offs: np.ndarray):
        n = len(data)
        self.data, self.offs = data, offs
        mask = WORD[data]
        before = np.zeros(n, dtype=bool)
        before[1:] = mask[:-1]
        after = np.zeros(n, dtype=bool)
        after[:-1] = mask[1:]
        inner = offs[(offs > 0) & (offs < n)]
        before[inner] = False
        after[inner - 1] = False
        self.starts = np.flatnonzero(mask & ~before)
        self.ends = np.flatnonzero(mask & ~after) + 1
        self.sums = np.zeros(n + 1, dtype=U)
        np.cumsum((data.astype(U) + U(1)) * powers(BASE, n), out=self.sums[1:])
        self.back = powers(INVERSE, n)
        self.hash = self.part(self.starts, self.ends)
        self.bounds = np.searchsorted(self.starts, offs)
        self.n = np.diff(self.bounds)

    def part(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        if not len(starts):
            return np.empty(0, dtype=U)
        return mix((self.sums[ends] - self.sums[starts]) * self.back[starts])

    def docs(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.n)), self.n)


def shingles(w: Words, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of k words (of all words, where a text has fewer) and their bounds by document."""
    count = np.where(w.n >= k, w.n - k + 1, (w.n > 0).astype(np.int64))
    bounds = np.concatenate([[0], np.cumsum(count)])
    out = np.empty(bounds[-1], dtype=U)
    full = np.repeat(w.n >= k, count)
    h, total = w.hash, len(w.hash)
    if full.any():
        acc = np.zeros(total - k + 1, dtype=U)
        for i in range(k):
            acc = acc * U(BASE) + h[i : total - k + 1 + i]
        ok = np.arange(total - k + 1) + k <= np.repeat(w.bounds[1:], w.n)[: total - k + 1]
        out[full] = mix(acc[ok])
    for d in np.flatnonzero((w.n > 0) & (w.n < k)):
        x = 0
        for v in h[w.bounds[d] : w.bounds[d + 1]]:
            x = (x * BASE + int(v) + 1) % (1 << 64)
        out[bounds[d]] = mix(np.array([x ^ 0x5851F42D4C957F2D], dtype=U))[0]
    return out, bounds


def word_hash(word: str) -> int:
    """The hash that Words gives a word."""
    raw = np.frombuffer(word.lower().encode(), dtype=np.uint8)
    return int(Words(raw, np.array([0, len(raw)])).hash[0])


def vector_sum(df, column: str, key: str, dtype: str = "int64"):
    """Sums equally long count vectors (binary column) of each key: one row of (key, column) per key."""

    def add(it):
        total: dict = {}
        for batch in it:
            for k, v in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                x = np.frombuffer(v, dtype=dtype)
                total[k] = total[k] + x if k in total else x
        yield pa.RecordBatch.from_pydict({key: pa.array(list(total), pa.int32()), column: pa.array([v.tobytes() for v in total.values()], pa.binary())})

    schema = f"{key} int, {column} binary"
    return df.select(key, column).mapInArrow(add, schema).repartition(key).mapInArrow(add, schema)


def collect_vector(df, column: str, key: str, size: int, blocks: int, dtype: str = "int64") -> np.ndarray:
    """The summed vectors of all keys, joined: size * blocks numbers, however many rows were counted."""
    out = np.zeros(size * blocks, dtype=dtype)
    for row in vector_sum(df, column, key, dtype).collect():
        out[row[0] * size : (row[0] + 1) * size] = np.frombuffer(row[1], dtype=dtype)
    return out


def blocks_of(counts: np.ndarray, size: int, key: str, column: str) -> pa.RecordBatch:
    """A count vector as rows (key: block number, column: its bytes), blocks of zeros left out."""
    at = [i for i in range(len(counts) // size) if counts[i * size : (i + 1) * size].any()]
    return pa.RecordBatch.from_pydict({key: pa.array(at, pa.int32()), column: pa.array([counts[i * size : (i + 1) * size].tobytes() for i in at], pa.binary())})
