"""MinHash near-dedup with min-max hashing.

A document is the set of its word shingles, hashed in 64 bits. Under each permutation both the least
and the greatest hash are kept, so 32 evaluations give 64 signature values; 21 bands of 3 of them make
candidates (a pair at similarity 0.8 shares no band about three times in ten million). Links are
confirmed on full sets.

Equal sets are one class, and only a class's least doc_id goes on, so large groups of exact copies
cost one row each. A band's bucket is not paired out. First, each document is held against one hub (the
least member of most of its buckets) and against the other documents of that hub, in chunks of bounded
rows and shingles; that takes each set once, however large a group is, and ties nearly all that is
linked. What is tied is a component. Then only buckets are open that hold several components and members
of several chunks. What open buckets tie together is a family; a document most of whose shingles are in
no other component of its family cannot reach the similarity with any, and leaves (this undoes families
that only a common passage ties). What is left of a family is cut into blocks, and a task takes a pair of
blocks. A task counts shared shingles for all its documents at once, and returns a spanning set of the
links. Components come from large-star and small-star rounds. Keys that a large share of rows have (hubs,
buckets, shingles, classes) are joined by broadcast, as they are few, so no task gathers them.

Defined cases: texts without words, null or empty, have empty sets and are linked with nothing; texts
with fewer words than a shingle have one shingle of all of them; a null doc_id is its own class with a
null component and is kept; of rows repeating a doc_id, one (the least by set) stands for it; empty
tables give no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import arrow_map, cut, cut_counted, cut_packed, fresh, gapless, heavy_join
from .perfect_hash import mix

PERMUTATIONS, BAND_ROWS = 32, 3
BANDS = 2 * PERMUTATIONS // BAND_ROWS
PERCENT = 80
#: A chunk or block has at most so many documents, and so many shingles beside its last document's.
BLOCK_DOCS, BLOCK_SHINGLES = 1024, 1 << 20

_random = np.random.default_rng(20_240_501)
_BYTE = _random.integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_A = _random.integers(0, 1 << 63, PERMUTATIONS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_B = _random.integers(0, 1 << 63, PERMUTATIONS, dtype=np.uint64)
_STEP = 0x5851F42D4C957F2D
_BACK = pow(_STEP, -1, 1 << 64)
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 9, 10, 11, 12, 13]] = True
_powers: dict[int, np.ndarray] = {}


def _power(base: int, n: int) -> np.ndarray:
    """base ** 0 .. base ** (n - 1) modulo 2 ** 64; kept for later calls."""
    held = _powers.get(base)
    if held is None or len(held) < n:
        held = np.full(max(n, 1 << 16), base, np.uint64)
        held[0] = 1
        held = np.multiply.accumulate(held)
        if len(held) <= 1 << 20:
            _powers[base] = held
    return held[:n]


def shingle_set(text: str | None, words: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the shingles of a text."""
    if not text:
        return np.empty(0, np.uint64)
    data = np.frombuffer(text.encode("utf-8", "surrogatepass").lower(), np.uint8)
    space = _SPACE[data]
    edge = np.flatnonzero(np.diff(np.concatenate([[True], space, [True]]).view(np.int8)))
    first, last = edge[::2], edge[1::2]
    if not len(first):
        return np.empty(0, np.uint64)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_BYTE[data] * _power(_STEP, len(data)), out=sums[1:])
    h = mix((sums[last] - sums[first]) * _power(_BACK, len(data))[first])
    if len(h) >= words:
        n = len(h) - words + 1
        own = np.zeros(n, np.uint64)
        for k in range(words):
            own = own * np.uint64(0x9E3779B97F4A7C15) + h[k : k + n]
    else:
        own = np.zeros(1, np.uint64)
        for x in h:
            own = own * np.uint64(0xC2B2AE3D27D4EB4F) + x
        own += np.uint64(len(h))
    return np.unique(mix(own))


def signature(hashes: np.ndarray) -> np.ndarray:
    """Least values under each permutation, then greatest."""
    lo = np.full(PERMUTATIONS, np.iinfo(np.uint64).max, np.uint64)
    hi = np.zeros(PERMUTATIONS, np.uint64)
    for at in range(0, len(hashes), 4096):
        under = (hashes[None, at : at + 4096] ^ _B[:, None]) * _A[:, None]
        np.minimum(lo, under.min(1), out=lo)
        np.maximum(hi, under.max(1), out=hi)
    return np.concatenate([lo, hi])


def band_keys(hashes: np.ndarray) -> np.ndarray:
    rows = signature(hashes)[: BANDS * BAND_ROWS].reshape(BANDS, BAND_ROWS)
    key = np.arange(1, BANDS + 1, dtype=np.uint64)
    for k in range(BAND_ROWS):
        key = mix(key * np.uint64(0x9E3779B97F4A7C15) + rows[:, k])
    return key.view(np.int64)


def class_key(hashes: np.ndarray) -> tuple[int, int]:
    """128 bits of a set."""
    with np.errstate(over="ignore"):
        return int(hashes.sum(dtype=np.uint64).view(np.int64)), int(np.bitwise_xor.reduce(mix(hashes)).view(np.int64)) if len(hashes) else 0


SCAN_SCHEMA = "doc_id long, n_shingles long, s1 long, s2 long, bands array<bigint>"
SET_SCHEMA = "id long, s1 long, s2 long, hashes array<bigint>"


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


def scanned(docs: DataFrame, words: int) -> DataFrame:
    """doc_id, n_shingles, s1, s2 (class) and band keys (none for empty sets)."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                n, s1, s2, bands = [], [], [], []
                for text in part.column(1).to_pylist():
                    own = shingle_set(text, words)
                    a, b = class_key(own)
                    n.append(len(own)), s1.append(a), s2.append(b)
                    bands.append(band_keys(own) if len(own) else [])
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(n, pa.int64()), pa.array(s1, pa.int64()), pa.array(s2, pa.int64()), pa.array(bands, pa.list_(pa.int64()))], names=["doc_id", "n_shingles", "s1", "s2", "bands"])

    return arrow_map(_texts(docs), scan, SCAN_SCHEMA)


def sets_of(docs: DataFrame, ids: DataFrame, words: int) -> DataFrame:
    """id, s1, s2 and hashes of the documents of ids (id)."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                own = [shingle_set(t, words) for t in part.column(1).to_pylist()]
                keys = [class_key(x) for x in own]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([k[0] for k in keys], pa.int64()), pa.array([k[1] for k in keys], pa.int64()), pa.array([x.view(np.int64) for x in own], pa.list_(pa.int64()))], names=["id", "s1", "s2", "hashes"])

    return arrow_map(_texts(docs).join(ids, F.col("doc_id") == F.col("id"), "left_semi"), scan, SET_SCHEMA)


def shared_counts(sets: list[np.ndarray]) -> np.ndarray:
    """Sizes of the intersections of all pairs of sets. Frequent shingles are counted by a product of matrices, rare ones pair by pair."""
    n = len(sets)
    who = np.repeat(np.arange(n), [len(x) for x in sets])
    _, token, count = np.unique(np.concatenate([*sets, np.empty(0, np.int64)]), return_inverse=True, return_counts=True)
    out = np.zeros((n, n), np.float32)
    order = np.argsort(token, kind="stable")
    who, first = who[order], np.cumsum(count) - count
    frequent = np.flatnonzero(count >= 48)
    for at in range(0, len(frequent), 2048):
        part = frequent[at : at + 2048]
        held = np.zeros((n, len(part)), np.float32)
        for k, t in enumerate(part):
            held[who[first[t] : first[t] + count[t]], k] = 1
        out += held @ held.T
    flat = out.ravel()
    for d in np.unique(count[(count > 1) & (count < 48)]).tolist():
        starts = first[count == d]
        left, right = np.triu_indices(d, 1)
        step = max(1, (1 << 21) // len(left))
        for at in range(0, len(starts), step):
            docs = who[starts[at : at + step, None] + np.arange(d)]
            pairs = (docs[:, left].astype(np.int64) * n + docs[:, right]).ravel()
            key, k = np.unique(pairs, return_counts=True)
            flat[key] += k
            flat[key % n * n + key // n] += k
    return out


def spanning_links(ids: list[int], sets: list[np.ndarray], percent: int) -> list[tuple[int, int]]:
    """Links of pairs that reach the similarity, enough of them to tie what is tied."""
    size = np.array([len(x) for x in sets], np.float64)
    shared = shared_counts(sets)
    near = 100 * shared >= percent * (size[:, None] + size[None, :] - shared)
    free = np.ones(len(ids), bool)
    out = []
    for i in range(len(ids)):
        if not free[i]:
            continue
        free[i] = False
        open_ = [i]
        while open_:
            u = open_.pop()
            found = np.flatnonzero(near[u] & free)
            free[found] = False
            out += [(ids[u], ids[v]) for v in found.tolist()]
            open_ += found.tolist()
    return out


def hubs_of(banded: DataFrame, n_banded: int) -> DataFrame:
    """key, id and hub (the key's least id) of the keys with several ids."""
    least = cut_packed(banded.groupBy("key").agg(F.min("id").alias("hub"), F.count(F.lit(1)).alias("_n")).where("_n > 1"))
    return heavy_join(banded, least, ["key"], "_n", n_banded)


def families_of(hubbed: DataFrame) -> DataFrame:
    """id and family (component of the graph that ties each bucket's members to its hub)."""
    return components(hubbed.where("id <> hub").select(F.col("id").alias("a"), F.col("hub").alias("b"))).withColumnRenamed("component", "family")


def chunks_of(hubbed: DataFrame, sizes: DataFrame) -> DataFrame:
    """id, group (the hub of most of its buckets) and chunk of each id that is not the hub of all its buckets. sizes: id, n_shingles."""
    votes = hubbed.where("id <> hub").groupBy("id", "hub").agg(F.count(F.lit(1)).alias("_n"))
    own = votes.groupBy("id").agg((-F.max(F.struct(F.col("_n"), (-F.col("hub")).alias("h")))["h"]).alias("group"))
    weight = F.greatest("n_shingles", F.lit(BLOCK_SHINGLES // BLOCK_DOCS)).cast("long")
    weighed = cut_packed(own.join(sizes, "id").select("id", "group", weight.alias("_w")))
    return gapless(weighed, ["group"], ["id"], "_place", weight="_w").select("id", "group", F.floor(F.col("_place") / BLOCK_SHINGLES).alias("chunk"))


def grouped_links(rows: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) inside groups (rows: id, g, i, j; a group has a bounded number of ids), confirmed on full sets."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, ids, sets = None, [], []

        def told() -> pa.RecordBatch:
            links = spanning_links(ids, sets, percent) if len(ids) > 1 else []
            return pa.RecordBatch.from_arrays([pa.array([x[k] for x in links], pa.int64()) for k in (0, 1)], names=["a", "b"])

        for batch in batches:
            own = batch.select(["g", "i", "j", "id"]).to_pylist()
            hashes = batch.column(batch.schema.get_field_index("hashes"))
            for k, row in enumerate(own):
                now = (row["g"], row["i"], row["j"])
                if now != key:
                    yield told()
                    key, ids, sets = now, [], []
                ids.append(row["id"])
                sets.append(hashes[k].values.to_numpy())
        yield told()

    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    keyed = rows.join(sets.select("id", "hashes"), "id").select(F.xxhash64("g", "i", "j").alias("key"), "g", "i", "j", "id", "hashes")
    return arrow_map(keyed.repartition(n, "key").sortWithinPartitions("key", "g", "i", "j", "id"), scan, "a long, b long")


def open_buckets(hubbed: DataFrame, labels: DataFrame, n_hubbed: int) -> DataFrame:
    """key, id, hub and component of the buckets whose members are not all tied and did not all meet in one chunk. labels: id, component, group, chunk."""
    told = cut(hubbed.join(labels, "id", "left").withColumn("component", F.coalesce("component", "id")))
    other = F.col("id") != F.col("hub")
    apart = F.count_if(other & ~F.col("group").eqNullSafe(F.col("hub"))).alias("_apart")
    sums = told.groupBy("key").agg(F.min("component").alias("_c0"), F.max("component").alias("_c1"), F.min(F.when(other, F.col("chunk"))).alias("_k0"), F.max(F.when(other, F.col("chunk"))).alias("_k1"), apart, F.count(F.lit(1)).alias("_n"))
    found = cut_packed(sums.where("_c0 <> _c1 AND (_apart > 0 OR _k0 <> _k1)").select("key", "_n"))
    return heavy_join(told.select("key", "id", "hub", "component"), found, ["key"], "_n", n_hubbed)


def thinned(members: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Ids that may be linked with another component of their family: members (id, family, component) with enough shingles there.

    Shared shingles are at most those that several components of the family have, and a link needs `percent` of the whole set.
    """
    rows, n = cut_counted(members.join(sets.select("id", F.explode("hashes").alias("h")), "id"))
    several = rows.groupBy("family", "h").agg(F.min("component").alias("_c0"), F.max("component").alias("_c1"), F.count(F.lit(1)).alias("_n")).where("_c0 <> _c1").select("family", "h", "_n")
    seen = heavy_join(rows, cut_packed(several), ["family", "h"], "_n", n).groupBy("id").agg(F.count(F.lit(1)).alias("_k"))
    return sets.join(seen, "id").where(100 * F.col("_k") >= percent * F.size("hashes")).select("id")


def block_links(families: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) inside families, by pairs of blocks."""
    weight = F.greatest(F.size("hashes"), F.lit(BLOCK_SHINGLES // BLOCK_DOCS)).cast("long")
    members = cut_packed(families.join(sets.select("id", weight.alias("_w")), "id"))
    placed = cut_packed(gapless(members, ["family"], ["id"], "_place", weight="_w").withColumn("block", F.floor(F.col("_place") / BLOCK_SHINGLES)).select("id", "family", "block"))
    blocks = placed.groupBy(F.col("family").alias("_f")).agg(F.max("block").alias("_last"))
    met = placed.join(blocks, F.col("family") == F.col("_f")).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_last"))))
    return grouped_links(met.select("id", F.col("family").alias("g"), F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j")), sets, percent)


def components(links: DataFrame, most_rounds: int = 60) -> DataFrame:
    """id and component (its least id) of every id in links (a, b), by alternating large-star and small-star.

    Done when each id has one edge and every edge leads to a root, an id that no edge leads from.
    """
    edges, n = cut_counted(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct())

    def star(edges: DataFrame, n: int, large: bool) -> tuple[DataFrame, int]:
        sides = edges.union(edges.select("v", "u")).toDF("u", "v") if large else edges
        least = sides.groupBy("u").agg(F.least("u", F.min("v")).alias("m"), F.count(F.lit(1)).alias("_n"))
        met = heavy_join(sides, least, ["u"], "_n", 2 * n if large else n)
        if large:
            moved = met.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        else:
            moved = met.select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))).alias("e")).select("e.u", "e.v")
        return cut_counted(moved.where("u <> v").distinct())

    for _ in range(most_rounds):
        edges, n = star(*star(edges, n, True), False)
        onward = edges.join(edges.select(F.col("u").alias("_r")), F.col("v") == F.col("_r"), "left_semi").select("u")
        forked = edges.groupBy("u").agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").select("u")
        if not onward.union(forked).limit(1).count():
            break
    else:
        raise RuntimeError("components did not settle")
    return edges.select(F.col("u").alias("id"), F.col("v").alias("component")).union(edges.select("v", F.col("v").alias("c")).distinct()).toDF("id", "component")


def linked_classes(docs: DataFrame, words: int = 4, percent: int = PERCENT) -> tuple[DataFrame, DataFrame]:
    """scan (one row a document: doc_id, n_shingles, rep) and component of each rep that has links (id, component)."""
    scan = cut(scanned(docs, words))
    if scan.where("doc_id IS NOT NULL").groupBy("doc_id").count().where("count > 1").limit(1).count():
        first = Window.partitionBy("doc_id").orderBy("s1", "s2")
        scan = cut(scan.withColumn("_n", F.row_number().over(first)).where("_n = 1 OR doc_id IS NULL").drop("_n"))
    same = ["s1", "s2", "n_shingles"]
    full = scan.where("n_shingles > 0 AND doc_id IS NOT NULL")
    classes = cut_packed(full.groupBy(*same).agg(F.min("doc_id").alias("rep"), F.count(F.lit(1)).alias("_n")))
    reps, n_reps = cut_counted(full.join(classes.select("rep"), F.col("doc_id") == F.col("rep"), "left_semi").select(F.col("doc_id").alias("id"), "n_shingles", "bands"))
    banded = reps.select("id", F.explode("bands").alias("key"))
    hubbed, n_hubbed = cut_counted(hubs_of(banded, n_reps * BANDS))
    sets = sets_of(docs, hubbed.select("id").distinct(), words)
    told = classes.select(F.col("rep").alias("_id"), F.col("s1").alias("_s1"), F.col("s2").alias("_s2"))
    sets = cut(sets.join(told, (F.col("id") == F.col("_id")) & (F.col("s1") == F.col("_s1")) & (F.col("s2") == F.col("_s2")), "left_semi").select("id", "hashes"))

    chunks = cut_packed(chunks_of(hubbed, reps.select("id", "n_shingles")))
    j = F.lit(0).cast("long").alias("j")
    rows = chunks.select("id", F.col("group").alias("g"), F.col("chunk").alias("i"), j)
    rows = rows.union(chunks.select("group", "chunk").distinct().select(F.col("group").alias("id"), F.col("group").alias("g"), F.col("chunk").alias("i"), j))
    links = cut_packed(grouped_links(rows, sets, percent))
    found = cut_packed(components(links))
    left, n_left = cut_counted(open_buckets(hubbed, chunks.join(found, "id", "full"), n_hubbed))
    if n_left:
        members = families_of(left).join(left.select("id", "component").distinct(), "id")
        kept = cut_packed(thinned(members, sets, percent))
        again, n_again = cut_counted(left.select("key", "id").join(kept, "id", "left_semi"))
        families = cut_packed(families_of(hubs_of(again, n_again)))
        found = cut_packed(components(links.union(cut_packed(block_links(families, sets, percent)))))
    n_full = scan.count()
    reps_of = heavy_join(scan.where("doc_id IS NOT NULL").select("doc_id", *same), classes, same, "_n", n_full, "left").select("doc_id", "n_shingles", F.coalesce("rep", "doc_id").alias("rep"))
    return reps_of.union(scan.where("doc_id IS NULL").select("doc_id", "n_shingles", F.lit(None).cast("long"))), found


def near_duplicates(docs: DataFrame, words: int = 4, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles, component_id, kept."""
    members, found = linked_classes(docs, words, percent)
    joined = members.join(found, F.col("rep") == F.col("id"), "left")
    return joined.select("doc_id", "n_shingles", F.coalesce("component", "rep").alias("component_id")).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def deduplicated(docs: DataFrame, words: int = 5, percent: int = PERCENT) -> DataFrame:
    """The rows of docs that stay: one document of each component; of rows repeating a doc_id, one."""
    name, number = fresh(docs, "_id"), fresh(docs, "_n")
    gone = near_duplicates(docs, words, percent).where(~F.col("kept")).select(F.col("doc_id").alias(name))
    left = docs.join(gone, F.col("doc_id") == F.col(name), "left_anti")
    if not docs.where("doc_id IS NOT NULL").groupBy("doc_id").count().where("count > 1").limit(1).count():
        return left
    first = Window.partitionBy("doc_id").orderBy(*[F.col(c).cast("string") for c in docs.columns if c != "doc_id"])
    return left.withColumn(number, F.row_number().over(first)).where((F.col(number) == 1) | F.col("doc_id").isNull()).drop(number)
