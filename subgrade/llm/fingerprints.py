"""SimHash fingerprints of hashes."""

from __future__ import annotations

import numpy as np

_BYTES = np.uint64(0x0101010101010101)


def _lanes(hashes: np.ndarray, lanes: int) -> np.ndarray:
    """lanes x hashes: the hash itself, then mixes of it."""
    out = np.empty((lanes, len(hashes)), dtype=np.uint64)
    out[0] = hashes
    for k in range(1, lanes):
        x = (hashes + np.uint64(k * 0x9E3779B97F4A7C15 % 2**64)) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(31))) * np.uint64(0x94D049BB133111EB)
        out[k] = x ^ (x >> np.uint64(29))
    return out


def fingerprint(hashes: np.ndarray, lanes: int = 1) -> np.ndarray:
    """`lanes` words of 64 bits: a bit is 1 if it is set in over half the hashes; zero for no hashes."""
    n = len(hashes)
    if not n:
        return np.zeros(lanes, dtype=np.uint64)
    h = _lanes(hashes, lanes)
    pad = -n % 255
    if pad:
        h = np.concatenate([h, np.zeros((lanes, pad), dtype=np.uint64)], axis=1)
    h = h.reshape(lanes, -1, 255)
    out = np.zeros(lanes, dtype=np.uint64)
    for k in range(8):
        # eight byte-wide counters in each word, over 255 hashes at a time
        sums = ((h >> np.uint64(k)) & _BYTES).sum(axis=2, dtype=np.uint64)
        counts = sums.view(np.uint8).reshape(lanes, -1, 8).sum(axis=1, dtype=np.int64)
        bits = (2 * counts > n).astype(np.uint64) << np.arange(k, 64, 8, dtype=np.uint64)
        out |= bits.sum(axis=1, dtype=np.uint64)
    return out
