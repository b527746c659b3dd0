"""A bounded memory for what a Python worker has computed of distinct words; it outlives a task."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc


class Memory:
    """Words and a list of numbers for each, as Arrow and NumPy arrays: about 30 bytes a word.

    It holds at most `limit` words, or those of the batch that it was last asked for: beyond the limit
    it starts anew.
    """

    def __init__(self, limit: int, dtype):
        self.limit, self.dtype = limit, np.dtype(dtype)
        self.clear()

    def clear(self) -> None:
        self.words = pa.array([], pa.string())
        self.sizes, self.starts, self.flat = np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, self.dtype)

    def places(self, distinct: pa.StringArray, compute: Callable[[list[str]], list[bytes]]) -> np.ndarray:
        """For each of the words its place in sizes and starts (of its numbers in flat); compute gives the numbers of new words as bytes."""
        if len(self.words) + len(distinct) > self.limit and len(self.words):
            if pc.index_in(distinct, value_set=self.words).null_count:
                self.clear()
        at = pc.index_in(distinct, value_set=self.words)
        if at.null_count:
            missing, had = at.is_null(), len(self.words)
            new = distinct.filter(missing)
            raws = compute(new.to_pylist())
            sizes = np.fromiter(map(len, raws), np.int64, len(raws)) // self.dtype.itemsize
            self.starts = np.concatenate([self.starts, len(self.flat) + np.cumsum(sizes) - sizes])
            self.sizes = np.concatenate([self.sizes, sizes])
            self.flat = np.concatenate([self.flat, np.frombuffer(b"".join(raws), self.dtype)])
            self.words = pa.concat_arrays([self.words, new])
            places = np.nan_to_num(at.to_numpy(zero_copy_only=False)).astype(np.int64)
            places[missing.to_numpy(zero_copy_only=False)] = np.arange(had, len(self.words))
            return places
        return at.to_numpy(zero_copy_only=False)
