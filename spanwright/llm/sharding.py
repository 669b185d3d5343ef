"""Sharding by k-d tree partitioning over document metadata.

Every text is a point (size, length, language, source), each dimension on the scale of weighted quantile
ranks: a value's place is the share of all bytes below it, so dimensions are compared by the bytes that
they tell apart. Size and length are ranked by logarithmic bins, language and source by their order; of
equal texts, the least language and source count, so that they are one point. A node that is to become k
shards is cut along its widest dimension, at the weighted quantile that leaves floor(k / 2) / k of its
bytes on the left; cutting stops at one shard, so every leaf comes to the target bytes. The quantile is
found over the cluster: histograms of byte weights over the digits of an order key narrow it down, one
digit a pass for all nodes of a level at once, and only nodes x bins sums reach the driver.

The order key is the cut dimension, then the text's checksum, so that equal texts are neighbours. A run of
equal keys that the cut falls into goes to one side as a whole, and the cut moves so far among the other
rows that the sides keep their bytes. Only a run that is larger than a shard is cut, at a doc_id.

Law ``bytes``: sizes of shards are near equal. Slots number a shard's documents without gaps.

Defined cases: a null text weighs 8 bytes and has the checksum of the empty text; a null language, source
or doc_id sorts first; rows that repeat a doc_id are documents of their own; fewer rows than shards
leave shards empty; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import cut, fresh, gapless, heavy_join, running, small_side, text_of

SHARDS, OVERHEAD = 24, 8
DIGIT_BITS = 12
#: Order keys have 48 bits (16 of the dimension, 32 of the checksum), doc_ids 64.
KEY_BITS, ID_BITS = 48, 60
RANKS = (1 << 16) - 1
#: Bins of a doubling of size or length.
BINS = 64
#: A run of a smaller share of a shard goes to its nearer side and the cut stays where it is.
LIGHT_RUN = 0.001
DIMENSIONS = 4


def ranked(rows: DataFrame, column: str, total: int) -> DataFrame:
    """_v and _r: each value of a column and its weighted quantile rank, of 16 bits."""
    sums = cut(rows.groupBy(F.col(column).alias("_v")).agg(F.sum("size").alias("_w")))
    below = running(sums, [F.col("_v").asc_nulls_first()], F.col("_w"), "_before")
    return cut(below.select("_v", F.floor(F.col("_before") * F.lit(RANKS / max(total, 1))).cast("long").alias("_r")))


def points(docs: DataFrame) -> DataFrame:
    """doc_id, size, text_crc32 and the dimensions as quantile ranks d0 (size), d1 (length), d2 (language), d3 (source)."""
    text = text_of()
    size = (F.octet_length(text) + OVERHEAD).cast("long")
    binned = lambda n: F.floor(F.log2(n.cast("double") + 1) * BINS).cast("int")
    rows = cut(docs.select("doc_id", size.alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), binned(size).alias("d0"), binned(F.length(text)).alias("d1"), F.col("lang").cast("string").alias("d2"), F.col("source").cast("string").alias("d3")))
    # Equal texts in several languages or sources; rows of one text may be very many, so its least values come as a small table.
    least = rows.groupBy("size", "text_crc32").agg(F.count(F.lit(1)).alias("_n"), F.min("d2").alias("_d2"), F.min("d3").alias("_d3"), F.count_if(F.col("d2").isNull()).alias("_z2"), F.count_if(F.col("d3").isNull()).alias("_z3"), F.max("d2").alias("_m2"), F.max("d3").alias("_m3"))
    spread = (F.col("_d2") != F.col("_m2")) | (F.col("_d3") != F.col("_m3")) | F.col("_z2").between(1, F.col("_n") - 1) | F.col("_z3").between(1, F.col("_n") - 1)
    several = cut(least.where(F.coalesce(spread, F.lit(False))).select("size", "text_crc32", F.when(F.col("_z2") == 0, F.col("_d2")).alias("_d2"), F.when(F.col("_z3") == 0, F.col("_d3")).alias("_d3"), F.lit(1).alias("_one"), F.col("_n").alias("_w")))
    total_rows, total = rows.agg(F.count(F.lit(1)), F.sum("size")).first()
    if several.limit(1).count():
        merged = heavy_join(rows, several, ["size", "text_crc32"], "_w", total_rows, "left")
        one = F.col("_one").isNotNull()
        rows = cut(merged.withColumns({"d2": F.when(one, F.col("_d2")).otherwise(F.col("d2")), "d3": F.when(one, F.col("_d3")).otherwise(F.col("d3"))}).drop("_d2", "_d3", "_one"))
    for k in range(DIMENSIONS):
        ranks = small_side(ranked(rows, f"d{k}", total or 0))
        rows = rows.join(ranks, F.col(f"d{k}").eqNullSafe(F.col("_v")), "left").withColumn(f"d{k}", F.col("_r")).drop("_v", "_r")
    return rows


def order_key(dimension: Column) -> Column:
    return F.shiftleft(dimension, 32) + F.col("text_crc32")


def id_key() -> Column:
    """doc_id as a non-negative number of ID_BITS bits in the same order (exact for ids within +- 2 ** 59)."""
    return F.greatest(F.lit(0), F.least(F.lit((1 << ID_BITS) - 1), F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 59))) + (1 << 59)))


def _quantiles(rows: DataFrame, key: Column, bits: int, goal: dict[int, float]) -> dict[int, tuple[int, int, int]]:
    """For each node: the least key at which the running weight exceeds goal, the weight before it, and the weight of it.

    rows: node, size. One pass for each digit of the key.
    """
    found = {n: (0, 0, 0) for n in goal}  # prefix, weight before, weight at
    keyed = rows.where(F.col("node").isin(list(goal))).withColumn("_key", key)
    for shift in range(bits - DIGIT_BITS, -1, -DIGIT_BITS):
        at = None
        for n, (prefix, _, _) in found.items():
            hit = (F.col("node") == n) & (F.shiftright("_key", shift + DIGIT_BITS) == prefix)
            at = hit if at is None else at | hit
        sums: dict[int, list[tuple[int, int]]] = {n: [] for n in goal}
        for r in keyed.where(at).groupBy("node", F.shiftright("_key", shift).alias("p")).agg(F.sum("size").alias("w")).collect():
            sums[r["node"]].append((r["p"], r["w"]))
        for n, own in sums.items():
            before = found[n][1]
            for p, w in sorted(own):
                if before + w > goal[n] or (p, w) == max(own):
                    found[n] = (p, before, w)
                    break
                before += w
    return found


Cut = tuple[int, int, int, int, int, int, int]
#: No run of equal keys goes another way than its key says.
NO_RUN = -1


def kd_cuts(rows: DataFrame, shards: int = SHARDS, dimensions: int = DIMENSIONS) -> tuple[list[Cut], DataFrame]:
    """Cuts (node, dimension, key, doc key, run, left node, right node), parents first: a row of the node goes left if its
    (key, doc key) is below the cut's; the rows of the run (a key; NO_RUN for none) go to the other side than that.
    Nodes are numbered by the shards below them: node = first shard * 4096 + number. Also returns rows with the node of their leaf."""
    # Each level's nodes and keys are written out: an expression that nests all levels outgrows the compiler.
    cuts: list[Cut] = []
    number = lambda first, n: first * 4096 + n
    level, everything = [(0, shards)], rows.withColumn("node", F.lit(number(0, shards)))
    total = rows.agg(F.sum("size")).first()[0] or 0
    while any(n > 1 for _, n in level):
        open_ = {number(f, n): (f, n) for f, n in level if n > 1}
        stats = everything.where(F.col("node").isin(list(open_))).groupBy("node").agg(F.sum("size").alias("w"), *[F.min(f"d{i}").alias(f"lo{i}") for i in range(dimensions)], *[F.max(f"d{i}").alias(f"hi{i}") for i in range(dimensions)]).collect()
        widest = {r["node"]: max(range(dimensions), key=lambda i, r=r: (r[f"hi{i}"] - r[f"lo{i}"], -i)) for r in stats}
        goal = {r["node"]: r["w"] * (open_[r["node"]][1] // 2) / open_[r["node"]][1] for r in stats}
        if goal:
            chosen = None
            for n, d in widest.items():
                chosen = F.when(F.col("node") == n, F.col(f"d{d}")) if chosen is None else chosen.when(F.col("node") == n, F.col(f"d{d}"))
            placed = cut(everything.withColumn("_order", order_key(chosen)))
            at = _quantiles(placed, F.col("_order"), KEY_BITS, goal)
            split = {n: (k + 1 if goal[n] - before > w / 2 else k, 0, NO_RUN) for n, (k, before, w) in at.items()}
            too_large = {n: goal[n] - before for n, (_, before, w) in at.items() if w > total / shards}
            if too_large:
                for n, (i, before, w) in _quantiles(placed.where(_in_run(at, too_large)), id_key(), ID_BITS, too_large).items():
                    split[n] = (at[n][0], i + 1 if too_large[n] - before > w / 2 else i, NO_RUN)
            # The run is out of the way at its nearer side; the cut is found again among the others.
            moved = {n: goal[n] - w * (goal[n] - before > w / 2) for n, (_, before, w) in at.items() if LIGHT_RUN * total / shards < w <= total / shards}
            moved = {n: g for n, g in moved.items() if g >= 0}
            if moved:
                others = placed.where(~_in_run(at, moved) & F.col("node").isin(list(moved)))
                for n, (k, before, w) in _quantiles(others, F.col("_order"), KEY_BITS, moved).items():
                    run, left = at[n][0], goal[n] > moved[n]
                    k = k + 1 if moved[n] - before > w / 2 else k
                    split[n] = (k, 0, run if (run < k) != left else NO_RUN)
            for n, (k, i, run) in split.items():
                f, m = open_[n]
                cuts.append((n, widest[n], k, i, run, number(f, m // 2), number(f + m // 2, m - m // 2)))
            everything = placed.drop("_order").withColumn("node", _sent(cuts[-len(split) :]))
        level = [x for f, n in level for x in ([(f, n // 2), (f + n // 2, n - n // 2)] if n > 1 and number(f, n) in goal else [(f, n)] if n == 1 else [])]
    return cuts, everything


def _in_run(at: dict[int, tuple[int, int, int]], nodes) -> Column:
    held = F.lit(False)
    for n in nodes:
        held = held | ((F.col("node") == n) & (F.col("_order") == at[n][0]))
    return held


def _sent(cuts: list[Cut]) -> Column:
    """The node that a row goes to from its present one."""
    out = F
    for n, d, k, i, run, left, right in cuts:
        key = order_key(F.col(f"d{d}"))
        below = ((key < k) | ((key == k) & (id_key() < i))) != (key == run)
        out = out.when(F.col("node") == n, F.when(below, F.lit(left)).otherwise(F.lit(right)))
    return out.otherwise(F.col("node"))


def sharded(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """doc_id, size, text_crc32, shard, slot: one row for each row of docs."""
    _, leaves = kd_cuts(cut(points(docs)), shards)
    placed = cut(leaves.select("doc_id", "size", "text_crc32", F.floor(F.col("node") / 4096).cast("int").alias("shard")))
    return gapless(placed, ["shard"], ["doc_id", "text_crc32", "size"], "slot")


def sharded_documents(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """The rows of docs with copy (0, 1, 2, ... among rows alike in doc_id and text), size, text_crc32, shard and slot.

    Rows meet their places by doc_id, size and checksum, by which shard and slots were dealt.
    """
    keys = ["doc_id", "size", "text_crc32"]
    own = [c for c in docs.columns if c not in ("copy", "size", "text_crc32", "shard", "slot")]
    names, slots = [fresh(docs, f"_{c}") for c in keys], fresh(docs, "_slots")
    places = sharded(docs, shards).groupBy(*[F.col(c).alias(n) for c, n in zip(keys, names, strict=True)]).agg(F.min("shard").alias("shard"), F.sort_array(F.collect_list("slot")).alias(slots))
    rows = docs.select(*own, (F.octet_length(text_of()) + OVERHEAD).cast("long").alias("size"), F.crc32(text_of().cast("binary")).alias("text_crc32"))
    rows = rows.withColumn("copy", F.row_number().over(Window.partitionBy(*keys).orderBy(F.xxhash64(*[c for c in own if c != "doc_id"]))) - 1)
    met = rows.join(places, F.col("doc_id").eqNullSafe(F.col(names[0])) & (F.col("size") == F.col(names[1])) & (F.col("text_crc32") == F.col(names[2])))
    return met.select(*own, "copy", "size", "text_crc32", "shard", F.get(slots, F.col("copy")).alias("slot"))
