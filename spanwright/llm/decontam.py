"""Benchmark decontamination by the q-gram lemma.

Texts and benchmark passages are lower-cased, stripped of ASCII punctuation, and their white space
becomes single spaces; they are compared as UTF-8 code units. A passage of m units may differ from a
region by e = 5 % of m edits. An edit destroys at most one of the passage's floor(m / q) q-grams that do
not overlap, so by the q-gram lemma such a region shares at least floor(m / q) - e of them with the
passage, and all of them lie on diagonals within e of each other. Shared q-grams are counted in diagonal
bands of e + 1, two neighbours at a time, so that bands overlap; regions meeting the bound are verified
by an alignment over the band's diagonals, which carries each path's start along.

The passages are the stated query set: they go to the tasks in blocks of BLOCK_BYTES, whose postings take
about twice their bytes, and each block is held against all documents in one pass. A benchmark within one
block, the usual case, takes one pass; a larger one takes a pass a block.

Defined cases: null and empty texts match nothing; passages under q units after normalising cannot
be told from chance and match nothing; for short passages e is lowered until the bound is positive;
of several regions the one with the fewest edits, then the first start, then the first end, is reported;
rows that repeat a doc_id are reported each, and so are passages that repeat an item_id or a text (rows
of the benchmark alike in both are one passage); empty tables give no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_map, bound_batches

Q, EDIT_RATE = 12, 0.05
#: Bytes of passages in one block.
BLOCK_BYTES = 64 << 20
_BITS = 22
_PUNCTUATION = bytes(c for c in range(33, 127) if not chr(c).isalnum())
_TO_SPACE = bytes.maketrans(b"\t\n\x0b\x0c\r", b"     ")
_C1, _C2, _C3 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0xD6E8FEB86659FD93)


def normalised(text: str) -> bytes:
    return b" ".join(text.lower().encode("utf-8", "surrogatepass").translate(_TO_SPACE, _PUNCTUATION).split())


def gram_hashes(data: bytes) -> np.ndarray:
    """A 64-bit value for each of the Q-grams of data; equal grams have equal values and, with twelve bytes in two words, different grams almost never."""
    n = len(data) - Q + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    head = np.ndarray((n,), "<u8", data, 0, (1,))
    tail = np.ndarray((n,), "<u4", data, 8, (1,))
    h = head * _C1
    h ^= h >> np.uint64(29)
    h += tail.astype(np.uint64) * _C2
    h *= _C3
    return h


def edit_budget(m: int) -> int:
    return min(int(m * EDIT_RATE), max(0, (m - Q) // Q))


def banded_alignment(item: bytes, region: bytes, most: int) -> tuple[int, int, int] | None:
    """(edits, start, end) of the best match of the whole item inside region, starting anywhere; None beyond `most` edits.

    The region is a band's width longer than the item, and a path stays within `most` of the diagonal it
    starts on, so only diagonals -most .. len(region) - len(item) + most are filled, one row a unit of the
    item. A cell holds edits and the path's start in one number, so the least has the first start too.
    """
    m, n = len(item), len(region)
    width = n - m + 2 * most + 1  # diagonals k - most, for k in 0 .. width - 1
    if width <= 0:
        return None
    one, far = np.int64(1) << 32, np.int64(1) << 62
    padded = np.full(width + m + most + 1, -1, np.int16)
    padded[most : most + n] = np.frombuffer(region, np.uint8)
    steps = np.arange(width, dtype=np.int64) << 32
    start = np.arange(width, dtype=np.int64) - most
    row = np.where((start >= 0) & (start <= n), start, far)
    limit = (most + 1) * one
    for i, c in enumerate(item, 1):
        new = row + one * (padded[i - 1 : i - 1 + width] != c)
        np.minimum(new[:-1], row[1:] + one, out=new[:-1])
        new = np.minimum.accumulate(new - steps) + steps
        end = i - most  # the place in the region of the first diagonal
        if end < 0:
            new[:-end] = far
        if end + width - 1 > n:
            new[n - end + 1 :] = far
        row = new
        if row.min() >= limit:
            return None
    k = int(row.argmin())
    best = int(row[k])
    return (best >> 32, best & 0xFFFFFFFF, k - most + m) if best < limit else None


def aligned_alike(item: bytes, regions: list[bytes], most: int) -> list[tuple[int, int, int] | None]:
    """banded_alignment() of regions of one length, all filled row by row at once."""
    m, n = len(item), len(regions[0])
    width = n - m + 2 * most + 1
    if width <= 0:
        return [None] * len(regions)
    one, far = np.int64(1) << 32, np.int64(1) << 62
    padded = np.full((len(regions), width + m + most + 1), -1, np.int16)
    padded[:, most : most + n] = np.frombuffer(b"".join(regions), np.uint8).reshape(len(regions), n)
    steps = np.arange(width, dtype=np.int64) << 32
    start = np.arange(width, dtype=np.int64) - most
    row = np.repeat(np.where((start >= 0) & (start <= n), start, far)[None, :], len(regions), axis=0)
    limit = (most + 1) * one
    for i, c in enumerate(item, 1):
        new = row + one * (padded[:, i - 1 : i - 1 + width] != c)
        np.minimum(new[:, :-1], row[:, 1:] + one, out=new[:, :-1])
        new = np.minimum.accumulate(new - steps, axis=1) + steps
        end = i - most
        if end < 0:
            new[:, :-end] = far
        if end + width - 1 > n:
            new[:, n - end + 1 :] = far
        row = new
        if not i % 64 and row.min() >= limit:
            return [None] * len(regions)
    k = row.argmin(axis=1)
    best = row[np.arange(len(regions)), k]
    return [(int(b) >> 32, int(b) & 0xFFFFFFFF, int(e) - most + m) if b < limit else None for b, e in zip(best, k, strict=True)]


class PassageIndex:
    """Q-gram postings of a block of passages."""

    def __init__(self, items: list[tuple[int, str]]):
        named = [(i, normalised(t or "")) for i, t in items]
        named = [(i, t) for i, t in named if len(t) >= Q]
        self.ids = [i for i, _ in named]
        self.texts = [t for _, t in named]
        self.size = np.array([len(t) for t in self.texts], np.int64)
        self.edits = np.array([edit_budget(len(t)) for t in self.texts], np.int64)
        self.least = self.size // Q - self.edits
        grams = [gram_hashes(t)[::Q] for t in self.texts]
        h = np.concatenate([*grams, np.empty(0, np.uint64)])
        item = np.repeat(np.arange(len(grams)), [len(g) for g in grams])
        at = np.concatenate([*[np.arange(len(g)) * Q for g in grams], np.empty(0, np.int64)]).astype(np.int64)
        order = np.argsort(h, kind="stable")
        self.grams, self.first = np.unique(h[order], return_index=True)
        self.last = np.append(self.first[1:], len(h))
        self.item, self.at = item[order], at[order]
        self.bits = np.zeros(1 << _BITS, bool)
        self.bits[(self.grams >> np.uint64(64 - _BITS)).astype(np.int64)] = True

    def hits(self, text: str) -> list[tuple[int, int, int, int]]:
        """(item id, edits, start, end) of each passage found in text; places are in the normalised text.

        Memory is linear in the text and the postings of the grams that it shares; time is linear in the places of those grams in
        the text times the passages that share them, and in the regions verified, alike ones once.
        """
        if not self.ids or not text:
            return []
        data = normalised(text)
        h = gram_hashes(data)
        where = np.flatnonzero(self.bits[(h >> np.uint64(64 - _BITS)).astype(np.int64)])
        if not len(where):
            return []
        slot = np.searchsorted(self.grams, h[where])
        slot[slot == len(self.grams)] = 0
        same = self.grams[slot] == h[where]
        where, slot = where[same], slot[same]
        if not len(where):
            return []
        order = np.argsort(slot, kind="stable")  # the places of each shared gram, in order
        where, slot = where[order], slot[order]
        shared, begin, count = np.unique(slot, return_index=True, return_counts=True)
        n = self.last[shared] - self.first[shared]
        place = np.repeat(self.first[shared] - np.cumsum(n) + n, n) + np.arange(n.sum())
        begin, count = np.repeat(begin, n), np.repeat(count, n)
        by_item = np.argsort(self.item[place], kind="stable")
        place, begin, count = place[by_item], begin[by_item], count[by_item]
        items, first, postings = np.unique(self.item[place], return_index=True, return_counts=True)
        found = []
        for i, k, own in zip(items.tolist(), first.tolist(), postings.tolist(), strict=True):
            if own >= self.least[i] and (hit := self._best(i, data, where, self.at[place[k : k + own]], begin[k : k + own], count[k : k + own])):
                found.append((self.ids[i], *hit))
        return found

    def _best(self, i: int, data: bytes, where: np.ndarray, at: np.ndarray, begin: np.ndarray, count: np.ndarray) -> tuple[int, int, int] | None:
        """The best match of passage i: at, begin and count are its shared grams' places in it and their runs in `where`."""
        item, e, least = self.texts[i], int(self.edits[i]), int(self.least[i])
        if (exact := data.find(item)) >= 0:
            return 0, exact, exact + len(item)
        if not e:
            return None
        low = -(len(item) // (e + 1)) - 1
        bands = np.zeros(len(data) // (e + 1) - low + 3, np.int64)
        step, k = 0, 0
        while k < len(at):  # as many postings at once as have about a million places
            step = max(1, int(np.searchsorted(np.cumsum(count[k:]), 1 << 20)))
            runs = count[k : k + step]
            places = np.repeat(begin[k : k + step] - np.cumsum(runs) + runs, runs) + np.arange(runs.sum())
            diagonal = where[places] - np.repeat(at[k : k + step], runs)
            bands += np.bincount(diagonal // (e + 1) - low, minlength=len(bands))  # floors below zero too
            k += step
        both = np.maximum(bands + np.append(bands[1:], 0), bands + np.append(0, bands[:-1]))
        regions: dict[bytes, int] = {}
        best: tuple[int, int, int] | None = None
        hot = np.flatnonzero((both >= least) & (bands > 0))
        # A region takes in the bands on either side, so of a run of hot bands every other one will do.
        run = np.concatenate([[0], np.flatnonzero(np.diff(hot) > 1) + 1]) if len(hot) else hot
        from_run = np.arange(len(hot)) - np.repeat(run, np.diff(np.append(run, len(hot)))) if len(hot) else hot
        for b in (hot[from_run % 2 == 0] + low).tolist():
            at_ = max(0, (b - 1) * (e + 1) - e)
            regions.setdefault(data[at_ : (b + 2) * (e + 1) + len(item) + e], at_)
        by_length: dict[int, list[bytes]] = {}
        for region in regions:
            by_length.setdefault(len(region), []).append(region)
        for alike in by_length.values():
            for k in range(0, len(alike), 64):
                for region, told in zip(alike[k : k + 64], aligned_alike(item, alike[k : k + 64], e), strict=True):
                    if told is not None:
                        here = (told[0], regions[region] + told[1], regions[region] + told[2])
                        best = here if best is None or here < best else best
        return best


def passage_blocks(benchmark: DataFrame) -> Iterator[list[tuple[int, str]]]:
    """The passages (item_id and text, each pair once) in blocks of bounded bytes; one block is held at a time."""
    total = benchmark.agg(F.sum(F.octet_length("text")).alias("n")).first()["n"] or 0
    blocks = max(1, -(-total // BLOCK_BYTES))
    dealt = benchmark.select("item_id", "text").where("text IS NOT NULL").distinct()
    for b in range(blocks):
        part = dealt if blocks == 1 else dealt.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == b)
        yield [(r["item_id"], r["text"]) for r in part.collect()]


HIT_SCHEMA = "doc_id long, item_id long, edits int, start long, end long"


def contamination(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, item_id, edits, start, end: one row for each passage in each document."""
    spark, found = docs.sparkSession, None
    for items in passage_blocks(benchmark):
        index = spark.sparkContext.broadcast(PassageIndex(items))

        def scan(batches: Iterator[pa.RecordBatch], index=index) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                rows = []
                for at in range(0, batch.num_rows, 256):
                    part = batch.slice(at, 256).to_pydict()
                    for doc, text in zip(part["doc_id"], part["text"], strict=True):
                        rows += [(doc, *hit) for hit in index.value.hits(text or "")]
                if rows:
                    columns = list(zip(*rows, strict=True))
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64()), strict=True)], names=["doc_id", "item_id", "edits", "start", "end"])

        part = arrow_map(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")), scan, HIT_SCHEMA)
        found = part if found is None else found.unionByName(part)
    return found


def clean_text(index):
    """A column function: whether a text holds none of the passages of a broadcast index."""

    @F.pandas_udf("boolean")
    def clean(texts: pd.Series) -> pd.Series:
        return pd.Series([not index.value.hits(t or "") for t in texts], dtype="bool")

    return clean


def decontaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of docs that hold no benchmark passage."""
    spark = docs.sparkSession
    bound_batches(spark)
    for items in passage_blocks(benchmark):
        docs = docs.where(clean_text(spark.sparkContext.broadcast(PassageIndex(items)))(F.col("text").cast("string")))
    return docs
