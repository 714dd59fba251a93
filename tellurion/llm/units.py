"""Token ids of distinct pieces of text, kept by a Python worker between batches and tasks."""

from __future__ import annotations

from collections.abc import Callable
from itertools import repeat

import numpy as np
import pyarrow as pa


class Pool:
    """Lists of ids, numbered in the order in which they came."""

    def __init__(self):
        self.n = 0
        self.offsets, self.ids = np.zeros(1 << 12, np.int32), np.empty(1 << 14, np.int32)

    def add(self, sizes: np.ndarray, ids: np.ndarray) -> None:
        used, n = int(self.offsets[self.n]), self.n + len(sizes)
        while n + 1 > len(self.offsets):
            self.offsets = np.concatenate([self.offsets, np.zeros_like(self.offsets)])
        while used + len(ids) > len(self.ids):
            self.ids = np.concatenate([self.ids, np.empty_like(self.ids)])
        self.offsets[self.n + 1 : n + 1] = used + np.cumsum(sizes)
        self.ids[used : used + len(ids)] = ids
        self.n = n

    def take(self, numbers: np.ndarray) -> pa.ListArray:
        return pa.ListArray.from_arrays(pa.array(self.offsets[: self.n + 1]), pa.array(self.ids[: self.offsets[self.n]])).take(pa.array(numbers))


class Units:
    """Ids of units of text in two generations of at most `most` units each; the older one is forgotten when the newer is full.

    encode: distinct units to the sizes of their lists of ids, and the ids.
    """

    def __init__(self, encode: Callable[[list[str]], tuple[np.ndarray, np.ndarray]], most: int):
        self.encode, self.most = encode, most
        self.cache: dict[str, int] = {}
        self.pool = Pool()
        self.older, self.older_pool = self.cache, self.pool

    def numbers(self, units: list[str]) -> np.ndarray:
        """Numbers of distinct units in the pool; those that are not there are encoded."""
        if len(self.cache) > self.most:
            self.older, self.older_pool, self.cache, self.pool = self.cache, self.pool, {}, Pool()
        out = np.fromiter(map(self.cache.get, units, repeat(-1)), np.int64, len(units))
        at = np.flatnonzero(out < 0)
        if len(at):
            missing = [units[k] for k in at.tolist()]
            first = self.pool.n
            if self.older is not self.cache:
                before = np.fromiter(map(self.older.get, missing, repeat(-1)), np.int64, len(missing))
                order = np.argsort(before < 0, kind="stable")  # those of the older generation first
                at, missing = at[order], [missing[k] for k in order.tolist()]
                before = before[before >= 0]
                kept = self.older_pool.take(before)
                self.pool.add(np.diff(kept.offsets.to_numpy()), kept.values.to_numpy())
                fresh = missing[len(before) :]
            else:
                fresh = missing
            self.pool.add(*self.encode(fresh))
            out[at] = np.arange(first, first + len(missing))
            self.cache.update(zip(missing, range(first, first + len(missing))))
        return out

    def ids(self, coded: pa.DictionaryArray) -> pa.ListArray:
        """The ids of each of the coded units."""
        numbers = self.numbers(coded.dictionary.to_numpy(zero_copy_only=False).tolist())
        return self.pool.take(numbers[coded.indices.to_numpy()])
