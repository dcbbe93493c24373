"""A fixed table from pairs of small integers to an integer, looked up for whole arrays."""

from __future__ import annotations

import numpy as np

_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)


class PairTable:
    """Open addressing with linear probing; slots are four times the entries, so most lookups end at the first probe."""

    def __init__(self, first: np.ndarray, second: np.ndarray, value: np.ndarray):
        keys = (first.astype(np.int64) << 32) | second.astype(np.int64)
        self.bits = max(4, int(4 * max(1, len(keys)) - 1).bit_length())
        self.keys = np.full(1 << self.bits, -1, dtype=np.int64)
        self.values = np.full(1 << self.bits, -1, dtype=np.int32)
        at, left = self._home(keys), np.arange(len(keys))
        while len(left):
            free = self.keys[at[left]] == -1
            candidates = left[free]
            slots, chosen = np.unique(at[candidates], return_index=True)
            placed = candidates[chosen]
            self.keys[slots], self.values[slots] = keys[placed], value[placed]
            left = left[~np.isin(left, placed)]
            taken = self.keys[at[left]] != -1
            at[left[taken]] = (at[left[taken]] + 1) & (len(self.keys) - 1)

    def _home(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * _MULTIPLIER) >> np.uint64(64 - self.bits)).astype(np.int64)

    def find(self, first: np.ndarray, second: np.ndarray) -> np.ndarray:
        """Values by pair, -1 where there is none. Pairs with a negative member have none."""
        keys = (first.astype(np.int64) << 32) | second
        at = self._home(keys)
        seen = self.keys[at]
        out = np.where(seen == keys, self.values[at], -1)
        open_ = np.flatnonzero((seen != keys) & (seen != -1))
        while len(open_):
            at[open_] = (at[open_] + 1) & (len(self.keys) - 1)
            seen = self.keys[at[open_]]
            hit = seen == keys[open_]
            out[open_[hit]] = self.values[at[open_[hit]]]
            open_ = open_[~hit & (seen != -1)]
        out[(first < 0) | (second < 0)] = -1
        return out
