"""Periodic run detection: maximal pairs from a bottom-up LCP-interval tree over the words of each document.

A run is a stretch of words with smallest period q, at least LEAST_WORDS and LEAST_PERIODS * q long, that no neighbouring word
extends. If it begins at i, the suffixes at i and i + q agree on its length less q words, d, and no more; the words before i and
before i + q differ. So it is a maximal pair at depth d of the suffix tree with a distance of at most d / (LEAST_PERIODS - 1),
and each such pair is a run as it stands. Intervals of the suffix array are visited bottom-up on a stack; each holds its
positions with the word to their left (their class), in one order over the classes, and takes a child's positions smaller into
larger. Pairs are reported between different classes only. Occurrences closer together than a third of what they share lie at
multiples of the smallest period, and all but the first of them have the same class, so only the nearest position on either
side can end a smallest period, and an insertion looks at two. A multiple of a run's period finds the same stretch; the least
period stays.

A pair's depth is at least LEAST_WORDS - 1, so suffixes whose first LEAST_WORDS - 1 words do not recur within a quarter of the
document are left out of the tree; most documents have none, which one sort of hashes tells. Suffixes are sorted by prefix
doubling with numpy, time n log^2 n; the tree takes n log n insertions into chunked lists. A document is one task's work,
with memory for about 20 words of bookkeeping a word; documents are independent, so nothing is shuffled.

Defined cases: null and empty texts, and those of fewer than LEAST_WORDS words, have no run, null fields and the hash of what
words they have; rows that repeat a doc_id are documents of their own; rows without a doc_id are not altered; empty tables give
no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import zlib
from bisect import bisect_right, insort
from collections.abc import Iterator
from operator import itemgetter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_map

#: Words of a run at least, and how often it repeats its period at least.
LEAST_WORDS, LEAST_PERIODS = 6, 4
#: Words that both suffixes of a pair share at least.
SHARED = LEAST_WORDS - 1
#: A chunk of a node's positions is split above this length.
CHUNK = 1_024

_WEIGHTS = [pow(0x9E3779B97F4A7C15, k + 1, 1 << 64) | 1 for k in range(SHARED)]
_first = itemgetter(0)


def recurring(hashes: np.ndarray) -> np.ndarray:
    """Places whose SHARED words (by their hashes) stand again within a quarter of the document, in order."""
    n = len(hashes) - SHARED + 1
    if len(hashes) < LEAST_WORDS:
        return np.empty(0, np.int64)
    own = np.zeros(n, np.uint64)
    for k, w in enumerate(_WEIGHTS):
        own = own * np.uint64(0xD1342543DE82EF95) + hashes[k : k + n].astype(np.uint64) * np.uint64(w)
    order = np.argsort(own, kind="stable")
    ranked = own[order]
    same = (ranked[1:] == ranked[:-1]) & (order[1:] - order[:-1] <= len(hashes) // LEAST_PERIODS)
    return np.unique(np.concatenate([order[1:][same], order[:-1][same]]))


def suffix_order(ids: np.ndarray, places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """places in the order of their suffixes, and the words that each shares with the one before (0 for the first)."""
    n = len(ids)
    rank = np.zeros(n + 1, np.int64)
    rank[:n] = np.unique(ids, return_inverse=True)[1] + 1
    levels, step = [rank], 1
    while step < n and len(np.unique(rank[places])) < len(places):
        ahead = np.zeros(n + 1, np.int64)
        ahead[: n - step] = rank[step:n]
        key = rank * (n + 2) + ahead
        rank = np.zeros(n + 1, np.int64)
        rank[:n] = np.unique(key[:n], return_inverse=True)[1] + 1
        levels.append(rank.astype(np.int32))
        step *= 2
    own = places[np.argsort(rank[places], kind="stable")]
    a, b = own[:-1].copy(), own[1:].copy()
    shared = np.zeros(len(own), np.int64)
    for k in range(len(levels) - 1, -1, -1):
        same = levels[k][a] == levels[k][b]
        for x in (a, b, shared[1:]):
            x[same] += 1 << k
    return own, shared


def _around(chunks: list[list[int]], p: int) -> tuple[int, int]:
    """The positions before and after p, -1 where there is none."""
    c = 0 if len(chunks) == 1 else max(0, bisect_right(chunks, p, key=_first) - 1)
    own = chunks[c]
    k = bisect_right(own, p)
    before = own[k - 1] if k else -1
    after = own[k] if k < len(own) else chunks[c + 1][0] if c + 1 < len(chunks) else -1
    return before, after


def _add(chunks: list[list[int]], p: int) -> None:
    c = 0 if len(chunks) == 1 else max(0, bisect_right(chunks, p, key=_first) - 1)
    own = chunks[c]
    insort(own, p)
    if len(own) > CHUNK:
        chunks[c : c + 1] = [own[: CHUNK // 2], own[CHUNK // 2 :]]


def maximal_pairs(ids: np.ndarray, places: np.ndarray) -> Iterator[tuple[int, int, int]]:
    """(start, distance, depth) of the maximal pairs among suffixes at `places` that are long enough for their distance."""
    own, shared = suffix_order(ids, places)
    order, depths = own.tolist(), [*shared[1:].tolist(), 0]
    left = np.concatenate([[-1], ids])[own]
    klass = dict(zip(order, left.tolist(), strict=True))
    stack: list[tuple[int, list[list[int]], int]] = []
    for place, below in zip(order, depths, strict=True):
        node, size = [[place]], 1
        while stack and stack[-1][0] >= below:
            depth, large, n = stack[-1]
            stack.pop()
            small, far = node, depth // (LEAST_PERIODS - 1)
            if n < size:
                large, small = node, large
            added = [p for chunk in small for p in chunk]
            for p in added:
                before, after = _around(large, p)
                if before >= 0 and p - before <= far and klass[before] != klass[p]:
                    yield before, p - before, depth
                if after >= 0 and after - p <= far and klass[after] != klass[p]:
                    yield p, after - p, depth
            for p in added:
                _add(large, p)
            node, size = large, n + size
            if depth == below:
                break
        if below >= SHARED:
            stack.append((below, node, size))


def word_runs(words: list[bytes]) -> list[tuple[int, int, int]]:
    """(start, length, period) of all runs, by start, then period."""
    if len(words) < LEAST_WORDS:
        return []
    places = recurring(np.array(list(map(hash, words)), np.int64).view(np.uint64))
    if not len(places):
        return []
    numbers: dict[bytes, int] = {}
    ids = np.array([numbers.setdefault(w, len(numbers)) for w in words], np.int64)
    found: dict[tuple[int, int], int] = {}
    for start, period, depth in maximal_pairs(ids, places):
        at = (start, period + depth)
        if at[1] >= max(LEAST_WORDS, LEAST_PERIODS * period):
            found[at] = min(period, found.get(at, period))
    return sorted(((s, n, q) for (s, n), q in found.items()), key=lambda r: (r[0], r[2]))


def altered(words: list[bytes], doc_id: int | None) -> list[bytes]:
    """The words of every tenth document, by a hash of its id, repeat from some word on."""
    h = zlib.crc32(b"%d" % doc_id) if doc_id is not None else 1
    g, n = h // 10, len(words)
    if h % 10 or not n:
        return words
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    unit = words[a : a + p]
    return words[:a] + (unit * (-(-(n - a) // p)))[: n - a]


def collapsed(words: list[bytes], runs: list[tuple[int, int, int]]) -> list[bytes]:
    """words without those that stand in some run after its first period."""
    if not runs:
        return words
    edge = np.zeros(len(words) + 1, np.int64)
    for start, length, period in runs:
        edge[start + period] += 1
        edge[start + length] -= 1
    return [words[k] for k in np.flatnonzero(np.cumsum(edge[:-1]) == 0).tolist()]


RUN_SCHEMA = "doc_id long, n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, collapsed_sha256 string"


def periodic_runs(docs: DataFrame, alter: bool = False) -> DataFrame:
    """doc_id, n_runs, the longest run (start, length, period, exponent_milli; nulls without runs), hashes of all runs and of the
    words that are left. alter: every tenth document's words are made to repeat before."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1).cast(pa.binary())
            rows: list[tuple] = []
            for k, doc_id in enumerate(batch.column(0).to_pylist()):
                words = texts[k].as_py().split()  # bytes split at exactly the six signs of white space
                words = altered(words, doc_id) if alter else words
                runs = word_runs(words)
                start, length, period = min(runs, key=lambda r: (-r[1], r[0], r[2])) if runs else (None, None, None)
                told = hashlib.sha256(b"".join(b"%d,%d,%d\n" % r for r in runs)).hexdigest()
                left = hashlib.sha256(b" ".join(collapsed(words, runs))).hexdigest()
                rows.append((doc_id, len(runs), start, length, period, 1000 * length // period if runs else None, told, left))
            kinds = [pa.int64()] * 6 + [pa.string()] * 2
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=[x.split()[0] for x in RUN_SCHEMA.split(", ")])

    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return arrow_map(docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text")), scan, RUN_SCHEMA)
