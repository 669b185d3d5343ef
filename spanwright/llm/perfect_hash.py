"""A small minimal perfect hash: n distinct 64-bit keys to slots 0 .. n - 1, by hash and displace."""

from __future__ import annotations

import numpy as np

_KEYS_PER_BUCKET = 4
_PILOTS = 65_536


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64."""
    x = np.asarray(x, dtype=np.uint64).copy()
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def hashed(keys: np.ndarray, seed: int) -> np.ndarray:
    return mix(np.asarray(keys, dtype=np.uint64) + np.uint64(0x9E3779B97F4A7C15) * np.uint64(seed + 1))


def _slots(h: np.ndarray, pilots: np.ndarray, n: int) -> np.ndarray:
    return (mix(h + (pilots.astype(np.uint64) + np.uint64(1)) * np.uint64(0xD1B54A32D192ED03)) % np.uint64(n)).astype(np.int64)


def build(keys: np.ndarray) -> tuple[int, np.ndarray]:
    """(seed, pilots) for distinct keys. Large buckets are placed first; a bucket takes the first pilot that hits free slots."""
    n = len(keys)
    buckets = max(1, -(-n // _KEYS_PER_BUCKET))
    tries = np.arange(64, dtype=np.uint64)
    for seed in range(1000):
        h = hashed(keys, seed)
        home = (h % np.uint64(buckets)).astype(np.int64)
        order = np.argsort(home, kind="stable")
        edges = np.searchsorted(home[order], np.arange(buckets + 1))
        pilots, free, placed = np.zeros(buckets, np.uint16), np.ones(n, bool), True
        for b in np.argsort(-(edges[1:] - edges[:-1]), kind="stable"):
            own = h[order[edges[b] : edges[b + 1]]]
            if not len(own):
                break
            for first in range(0, _PILOTS, len(tries)):
                at = _slots(own[None, :], (tries + np.uint64(first))[:, None], n)
                good = free[at].all(axis=1)
                if len(own) > 1:
                    at_sorted = np.sort(at, axis=1)
                    good &= (at_sorted[:, 1:] != at_sorted[:, :-1]).all(axis=1)
                if good.any():
                    k = int(good.argmax())
                    free[at[k]] = False
                    pilots[b] = first + k
                    break
            else:
                placed = False
                break
        if placed:
            return seed, pilots
    raise ValueError("keys repeat")


def slots(keys: np.ndarray, seed: int, pilots: np.ndarray, n: int) -> np.ndarray:
    h = hashed(keys, seed)
    return _slots(h, pilots[(h % np.uint64(len(pilots))).astype(np.int64)], n)


def fingerprints(keys: np.ndarray) -> np.ndarray:
    return (mix(np.asarray(keys, dtype=np.uint64) ^ np.uint64(0xA0761D6478BD642F)) >> np.uint64(32)).astype(np.uint32)
