"""Suffix-array dedup: repeated strings of LENGTH bytes, found by LCP-interval trees over a sampled suffix array.

Every LENGTH-byte string holds, at the same place in each of its copies, the same minimiser: the
GRAM-byte gram with the least hash among its grams. So the suffixes that begin at minimisers are
enough, and suffixes of one gram form a bucket of the suffix array of their own. Of a bucket, suffixes with
the same context (all bytes that a LENGTH-byte string around the gram can reach) are one entry; if
there are two of them, all strings around them are repeated. The entries are sorted by what follows,
longest common prefixes of neighbours are taken, and a stack scan lists the LCP intervals. Within an
interval of depth d, members sorted by what precedes them are scanned in the same way: where left
extensions stop being shared (left-extension diversity) stands a maximal repeat, with all its
occurrences, and each member's longest shared left extension l says that its strings reaching from
LENGTH - d to l bytes to the left are repeated.

A bucket of more than BUCKET entries is not brought into one task: the range of reaches is halved,
each half's bucket being told apart by the longer string that all its reaches share; entries that
agree on the whole half are settled by a count. A single reach always is, so every bucket ends.

Strings are judged on the input, within documents only, and each byte covered by a repeated one goes.

Defined cases: null and empty texts have 0 bytes; equal texts of at least LENGTH bytes go entirely;
rows that repeat a doc_id with different texts are documents of their own; empty tables give no rows;
other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import arrow_map, cut, cut_counted, cut_dealt, heavy_join, hot_key, text_of
from .minhash import _power
from .perfect_hash import mix

LENGTH, GRAM = 200, 32
#: Minimiser window in grams, and the farthest reach to the left of a gram.
WINDOW = LENGTH - GRAM + 1
REACH = WINDOW - 1
#: Most entries of a bucket in one task.
BUCKET = 1_000
#: Bits of the bitmap of repeated grams, a power of two of at least 32,768, the bits of one of Spark's bitmaps.
GRAM_BITS = 1 << 26

_BYTE = np.random.default_rng(7_654_321).integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_STEP = 0xD1342543DE82EF95
_BACK = pow(_STEP, -1, 1 << 64)
_KEYS = ("d", "x")


def anchors(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places of the minimisers of all windows, their grams' hashes and their contexts' hashes."""
    n = len(data)
    if n < LENGTH:
        none = np.empty(0, np.int64)
        return none, none, none
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(_BYTE[np.frombuffer(data, np.uint8)] * _power(_STEP, n), out=sums[1:])
    back = _power(_BACK, n)
    grams = n - GRAM + 1
    h = mix((sums[GRAM:] - sums[:grams]) * back[:grams])
    packed = (h & np.uint64(0xFFFFFFFF00000000)) | np.arange(grams, dtype=np.uint64)
    blocks = -(-grams // WINDOW)
    full = np.full(blocks * WINDOW, np.iinfo(np.uint64).max, np.uint64)
    full[:grams] = packed
    full = full.reshape(blocks, WINDOW)
    ahead = np.minimum.accumulate(full, axis=1).ravel()
    behind = np.minimum.accumulate(full[:, ::-1], axis=1)[:, ::-1].ravel()
    count = grams - WINDOW + 1
    least = np.minimum(behind[:count], ahead[WINDOW - 1 : WINDOW - 1 + count])
    at = np.unique(least & np.uint64(0xFFFFFFFF)).astype(np.int64)
    lo, hi = np.maximum(at - REACH, 0), np.minimum(at + LENGTH, n)
    around = mix((sums[hi] - sums[lo]) * back[lo] + (at - lo).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + (hi - at).astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F))
    return at, h[at].view(np.int64), around.view(np.int64)


def common_prefix(a: bytes, b: bytes) -> int:
    n = min(len(a), len(b))
    differ = int.from_bytes(a[:n], "big") ^ int.from_bytes(b[:n], "big")
    return n - (differ.bit_length() + 7) // 8


def lcp_intervals(lcp: list[int]) -> Iterator[tuple[int, int, int]]:
    """(depth, first, last) of every LCP interval, children before parents. lcp[i] is between entries i - 1 and i; lcp[0] unused."""
    stack: list[tuple[int, int]] = []
    for i in range(1, len(lcp) + 1):
        depth = lcp[i] if i < len(lcp) else -1
        first = i - 1
        while stack and stack[-1][0] > depth:
            held, first = stack.pop()
            yield held, first, i - 1
        if depth >= 0 and (not stack or stack[-1][0] < depth):
            stack.append((depth, first))


def maximal_repeats(entries: list[tuple[bytes, bytes]], lo: int = 0, hi: int = REACH) -> Iterator[tuple[int, int, list[int]]]:
    """(left, right, members) of the maximal repeats of a bucket that are long enough.

    entries: (left bytes reversed, right bytes), in the order of right. A repeat reaches `left` bytes
    before the gram and `right` bytes from it; members are all entries having it.
    """
    rights = [r for _, r in entries]
    depths = [0] + [common_prefix(rights[i - 1], rights[i]) for i in range(1, len(rights))]
    for depth, first, last in lcp_intervals(depths):
        least = max(lo, LENGTH - depth)
        if least > hi:
            continue
        own = sorted(range(first, last + 1), key=lambda i: entries[i][0])
        shared = [0] + [common_prefix(entries[own[i - 1]][0], entries[own[i]][0]) for i in range(1, len(own))]
        for left, a, b in lcp_intervals(shared):
            if left >= least:
                yield left, depth, own[a : b + 1]


def repeated_reaches(entries: list[tuple[bytes, bytes]], lo: int, hi: int) -> list[list[tuple[int, int]]]:
    """For each entry the ranges of reaches within [lo, hi] whose strings are repeated in the bucket."""
    out: list[list[tuple[int, int]]] = [[] for _ in entries]
    if len(entries) == 2:  # one interval, one group
        (left_a, right_a), (left_b, right_b) = entries
        span = (max(lo, LENGTH - common_prefix(right_a, right_b)), min(hi, common_prefix(left_a, left_b)))
        return [[span], [span]] if span[0] <= span[1] else out
    for left, right, members in maximal_repeats(entries, lo, hi):
        span = (max(lo, LENGTH - right), min(hi, left))
        for i in members:
            out[i].append(span)
    return [_merged(x) for x in out]


def _merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1] + 1:
            out[-1] = (out[-1][0], max(out[-1][1], b))
        else:
            out.append((a, b))
    return out


def keyed(docs: DataFrame) -> DataFrame:
    """d and x (together a document: its id and its text's hash), y (a second hash) and text, not null."""
    text = text_of()
    return docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63))).alias("d"), F.xxhash64(text).alias("x"), F.xxhash64(F.lit(1), text).alias("y"), "doc_id", text.alias("text"))


def gram_bitmap(grams: DataFrame) -> np.ndarray:
    """A packed bitmap with a bit of each gram (_kh); GRAM_BITS bits at most reach the driver, whatever the input."""
    bits, bit = np.zeros(GRAM_BITS // 8, np.uint8), F.col("_kh").bitwiseAND(F.lit(GRAM_BITS - 1)) + 1
    parts = grams.groupBy(F.bitmap_bucket_number(bit).alias("at")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(bit)).alias("bits"))
    for r in parts.toLocalIterator():
        part = np.frombuffer(r["bits"], np.uint8)
        bits[(r["at"] - 1) * len(part) : r["at"] * len(part)] = part
    return bits


def anchor_rows(texts: DataFrame, known: np.ndarray | None = None) -> DataFrame:
    """d, x, pos, kh (gram), u (context) of every minimiser; given a bitmap, of those whose grams have a bit in it (others may)."""
    sent = None if known is None else texts.sparkSession.sparkContext.broadcast(known.tobytes())

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = None if sent is None else np.frombuffer(sent.value, np.uint8)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                found = [anchors(t.encode("utf-8", "surrogatepass")) for t in part.column(2).to_pylist()]
                n = [len(f[0]) for f in found]
                if sum(n):
                    d, x = (np.repeat(part.column(k).to_numpy(), n) for k in (0, 1))
                    pos, kh, u = (np.concatenate([f[k] for f in found]) for k in range(3))
                    if bits is not None:
                        bit = kh & (8 * len(bits) - 1)
                        has = (bits[bit >> 3] >> (bit & 7).astype(np.uint8)) & 1 == 1
                        d, x, pos, kh, u = (c[has] for c in (d, x, pos, kh, u))
                    yield pa.RecordBatch.from_arrays([pa.array(d), pa.array(x), pa.array(pos.astype(np.int64)), pa.array(kh), pa.array(u)], names=["d", "x", "pos", "kh", "u"])

    return arrow_map(texts.select("d", "x", "text").where(F.octet_length("text") >= LENGTH), scan, "d long, x long, pos long, kh long, u long")


CONTEXT_SCHEMA = "kh long, u long, left binary, right binary"


def contexts(texts: DataFrame, crowded: bool) -> DataFrame:
    """kh, u, left (reversed) and right of the entries asked for, in buckets over BUCKET entries or in the others.

    texts has d, x, text and asked, an array of (pos, kh, u, entries).
    """
    over = F.lit(BUCKET)
    asked = F.filter("asked", lambda a: a["entries"] > over if crowded else a["entries"] <= over)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1).to_pylist()[0]
                data = row["text"].encode("utf-8", "surrogatepass")
                kh, u, left, right = [], [], [], []
                for a in row["asked"]:
                    p = a["pos"]
                    kh.append(a["kh"]), u.append(a["u"])
                    left.append(data[max(0, p - REACH) : p][::-1]), right.append(data[p : p + LENGTH])
                yield pa.RecordBatch.from_arrays([pa.array(kh, pa.int64()), pa.array(u, pa.int64()), pa.array(left, pa.binary()), pa.array(right, pa.binary())], names=["kh", "u", "left", "right"])

    return arrow_map(texts.select("text", asked.alias("asked")).where(F.size("asked") > 0), scan, CONTEXT_SCHEMA)


MARK_SCHEMA = "kh long, u long, lo int, hi int"


def bucket_marks(items: DataFrame) -> DataFrame:
    """Ranges of repeated reaches of the entries of small buckets: items has key, kh, u, left, right, lo, hi."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held = None, []

        def told() -> pa.RecordBatch | None:
            if len(held) < 2:
                return None
            found = repeated_reaches([(r["left"], r["right"]) for r in held], held[0]["lo"], held[0]["hi"])
            rows = [(r["kh"], r["u"], a, b) for r, spans in zip(held, found, strict=True) for a, b in spans]
            if not rows:
                return None
            kh, u, lo, hi = zip(*rows, strict=True)
            return pa.RecordBatch.from_arrays([pa.array(kh, pa.int64()), pa.array(u, pa.int64()), pa.array(lo, pa.int32()), pa.array(hi, pa.int32())], names=["kh", "u", "lo", "hi"])

        for batch in batches:
            for row in batch.to_pylist():
                if row["key"] != key:
                    if (out := told()) is not None:
                        yield out
                    key, held = row["key"], []
                held.append(row)
        if (out := told()) is not None:
            yield out

    n = int(items.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return arrow_map(items.repartition(n, "key").sortWithinPartitions("key", "right", "left"), scan, MARK_SCHEMA)


ITEM_SCHEMA = "key long, whole long, kh long, u long, left binary, right binary, lo int, hi int"


def halved(items: DataFrame) -> DataFrame:
    """Each item's two half ranges of reaches: key hashes what all strings of the half share, whole what any of them touches."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def digest(data: bytes, lo: int, hi: int) -> int:
            return int.from_bytes(hashlib.blake2b(data, digest_size=8, key=b"%d:%d" % (lo, hi)).digest(), "big", signed=True)

        for batch in batches:
            rows = []
            for r in batch.to_pylist():
                middle = (r["lo"] + r["hi"]) // 2
                for lo, hi in ((r["lo"], middle), (middle + 1, r["hi"])):
                    left, right = r["left"], r["right"]
                    # The half keeps its bounds, shared by its bucket; what the document's ends cut off is part of `whole`.
                    if lo > hi or len(left) < lo or len(right) < LENGTH - hi:
                        continue
                    both = left[lo - 1 :: -1] if lo else b""
                    key = digest(both[-lo:] + right[: LENGTH - hi] if lo else right[: LENGTH - hi], lo, hi)
                    whole = digest(b"%d:%d:" % (len(left[:hi]), len(right[: LENGTH - lo])) + left[:hi] + right[: LENGTH - lo], lo, hi)
                    rows.append((key, whole, r["kh"], r["u"], left, right, lo, hi))
            if rows:
                kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.int32(), pa.int32())
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=["key", "whole", "kh", "u", "left", "right", "lo", "hi"])

    return arrow_map(items.select("kh", "u", "left", "right", "lo", "hi"), scan, ITEM_SCHEMA)


def crowd_marks(items: DataFrame) -> list[DataFrame]:
    """Marks of entries of buckets over BUCKET entries, by halving the range of reaches until buckets are small or settled."""
    marks: list[DataFrame] = []
    for _ in range(REACH.bit_length() + 1):
        items, n_items = cut_counted(halved(items))
        groups, n_groups = cut_counted(items.groupBy("key", "whole").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("kh", "u")).alias("first")))
        sizes = cut(groups.groupBy("key").agg(F.count(F.lit(1)).alias("entries")).withColumn("_n", F.col("entries")))
        groups = cut(heavy_join(groups, sizes, ["key"], "_n", n_groups).where("n > 1 OR entries > 1").withColumn("_n", F.col("n")))
        # Entries that agree on the whole half stand in for each other; the first takes part in the bucket.
        goes_on = (F.col("entries") > 1) & (F.struct("kh", "u") == F.col("first"))
        placed = heavy_join(items, groups, ["key", "whole"], "_n", n_items).withColumn("open", goes_on)
        # Written out, as marks, small buckets and the next halves all read it; only entries that go on keep their bytes.
        placed = cut(placed.select("key", "kh", "u", "lo", "hi", "n", "entries", "open", *[F.when(F.col("open"), F.col(c)).alias(c) for c in ("left", "right")]))
        marks.append(placed.where("n > 1").select("kh", "u", "lo", "hi"))
        open_ = placed.where("open").select("key", "kh", "u", "left", "right", "lo", "hi", "entries")
        marks.append(bucket_marks(open_.where(F.col("entries") <= BUCKET)))
        items = open_.where(F.col("entries") > BUCKET).select("kh", "u", "left", "right", "lo", "hi")
        if not items.limit(1).count():
            break
    return marks


def within(pos: Column) -> tuple[Column, Column]:
    """First and last start of the strings of a mark."""
    return pos - F.col("hi"), pos - F.col("lo")


REMOVED_SCHEMA = "d long, x long, n_removed long, n_spans long, kept_sha256 string"


def _removed(rows: DataFrame) -> DataFrame:
    """rows: d, x, text, spans (array of from, to: starts of repeated strings)."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for i in range(batch.num_rows):
                row = batch.slice(i, 1).to_pylist()[0]
                data = row["text"].encode("utf-8", "surrogatepass")
                last = len(data) - LENGTH
                runs: list[list[int]] = []
                for a, b in sorted((max(0, s["from"]), min(last, s["to"])) for s in row["spans"]):
                    if a > b:
                        continue
                    if runs and a <= runs[-1][1]:
                        runs[-1][1] = max(runs[-1][1], b + LENGTH)
                    else:
                        runs.append([a, b + LENGTH])
                sha, done = hashlib.sha256(), 0
                for a, b in runs:
                    sha.update(data[done:a])
                    done = b
                sha.update(data[done:])
                out.append((row["d"], row["x"], sum(b - a for a, b in runs), len(runs), sha.hexdigest()))
            d, x, n, k, s = zip(*out, strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(d, pa.int64()), pa.array(x, pa.int64()), pa.array(n, pa.int64()), pa.array(k, pa.int64()), pa.array(s, pa.string())], names=["d", "x", "n_removed", "n_spans", "kept_sha256"])

    return arrow_map(rows, scan, REMOVED_SCHEMA)


def repeats_removed(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256."""
    texts = keyed(docs)
    told = cut(texts.select("doc_id", "d", "x", "y", F.octet_length("text").cast("long").alias("n_bytes"), F.sha2("text", 256).alias("sha")))
    classes = cut(told.groupBy("x", "y", "n_bytes").agg(F.min("d").alias("d"), F.count(F.lit(1)).alias("copies")))
    firsts = classes.where(F.col("n_bytes") >= LENGTH).select(F.col("d").alias("_d"), F.col("x").alias("_x"))

    # Grams found at two places of different texts, or of one text.
    # Written out, so that the join below can split the rows of a hot gram over tasks.
    grams = cut(anchor_rows(texts).select("kh", F.xxhash64("x", "pos").alias("p")).groupBy("kh").agg(F.min("p").alias("_a"), F.max("p").alias("_b")).where("_a <> _b").select(F.col("kh").alias("_kh")))
    met = anchor_rows(texts, gram_bitmap(grams)).join(grams, F.col("kh") == F.col("_kh"), "left_semi")
    met = cut(met.join(firsts, (F.col("d") == F.col("_d")) & (F.col("x") == F.col("_x")), "left_semi"))

    entries = cut(met.groupBy("kh", "u").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("d", "x", "pos")).alias("first")))
    # A bucket of settled entries only needs no tree.
    sizes = entries.groupBy(F.col("kh").alias("_kh")).agg(F.count(F.lit(1)).alias("entries"), F.count_if(F.col("n") == 1).alias("_open")).where("entries > 1 AND _open > 0").drop("_open")
    sizes = cut(sizes)
    sized = entries.join(sizes, F.col("kh") == F.col("_kh")).select("kh", "u", "first.*", "entries")
    asked = sized.groupBy("d", "x").agg(F.collect_list(F.struct("pos", "kh", "u", "entries")).alias("asked"))
    touched = cut(met.select("d", "x").distinct().join(asked, ["d", "x"], "left").withColumnsRenamed({"d": "_d", "x": "_x"}))
    none = F.array().cast("array<struct<pos:bigint,kh:bigint,u:bigint,entries:bigint>>")
    long = texts.select("d", "x", "text").where(F.octet_length("text") >= LENGTH)
    # Repeated rows go within their tasks, ahead of the shuffle, so that one document's do not meet.
    long = long.dropDuplicates(["d", "x"]) if docs_repeat(told) else long
    held = long.join(touched, (F.col("d") == F.col("_d")) & (F.col("x") == F.col("_x"))).select("d", "x", "text", F.coalesce("asked", none).alias("asked"))
    # Texts are shuffled here only: contexts are read where they lie, and the spans come to them.
    held = cut_dealt(held)

    whole_range = {"lo": F.lit(0), "hi": F.lit(REACH)}
    marks = [entries.where("n > 1").select("kh", "u", F.lit(0).alias("lo"), F.lit(REACH).alias("hi"))]
    marks.append(bucket_marks(contexts(held, crowded=False).withColumns(whole_range | {"key": F.col("kh")})))
    if sizes.where(F.col("entries") > BUCKET).limit(1).count():
        marks += crowd_marks(contexts(held, crowded=True).withColumns(whole_range))
    every = marks[0]
    for more in marks[1:]:
        every = every.union(more)
    a, b = within(F.col("pos"))
    # Hot entries are few; every string around them is repeated.
    hot = F.broadcast(entries.where((F.col("n") > 1) & hot_key(F.col("n"), met.count())).select("kh", "u"))
    whole = met.join(hot, ["kh", "u"]).select("d", "x", "pos", F.lit(0).alias("lo"), F.lit(REACH).alias("hi"))
    others = met.join(hot, ["kh", "u"], "left_anti").join(every.join(hot, ["kh", "u"], "left_anti"), ["kh", "u"]).select("d", "x", "pos", "lo", "hi")
    spans = whole.union(others).groupBy("d", "x").agg(F.collect_list(F.struct(a.alias("from"), b.alias("to"))).alias("spans"))
    found = _removed(held.select("d", "x", "text").join(spans, ["d", "x"]).select("d", "x", "text", "spans")).withColumnsRenamed({"d": "_d", "x": "_x"})
    copies = classes.where((F.col("copies") > 1) & (F.col("n_bytes") >= LENGTH)).select(F.col("x").alias("cx"), F.col("y").alias("cy"), F.col("n_bytes").alias("cn"))
    empty = hashlib.sha256().hexdigest()
    out = told.join(copies, (F.col("x") == F.col("cx")) & (F.col("y") == F.col("cy")) & (F.col("n_bytes") == F.col("cn")), "left").join(found, (F.col("d") == F.col("_d")) & (F.col("x") == F.col("_x")), "left")
    gone = F.col("cx").isNotNull()
    return out.select(
        "doc_id",
        "n_bytes",
        F.when(gone, F.col("n_bytes")).otherwise(F.coalesce("n_removed", F.lit(0))).cast("long").alias("n_removed"),
        F.when(gone, F.lit(1)).otherwise(F.coalesce("n_spans", F.lit(0))).cast("long").alias("n_spans"),
        F.when(gone, F.lit(empty)).otherwise(F.coalesce("kept_sha256", "sha")).alias("kept_sha256"),
    )


def docs_repeat(told: DataFrame) -> bool:
    return bool(told.groupBy("d", "x").count().where("count > 1").limit(1).count())
