"""Mixing sources to target weights by a multivariate-hypergeometric splitting tree.

Sources take weights in code-point order and share the total size; a source's target stops at
MOST_EPOCHS times its size and the excess is shared again by weight (a water level, raised until no
further source is above it). The words of a source, laid end to end, are cut into up to BLOCKS equal
blocks; a target is a quota of whole blocks, drawn epoch after epoch, each epoch in a random order of
its own: a Feistel network keyed by seed, source and epoch permutes the block numbers, so an order is
computed for a block on its own and nothing is sorted. A binary tree over the output shards splits the
vector of quotas: at every node the left half draws its blocks from the node's pool without replacement,
so each source's share is a multivariate-hypergeometric draw and quotas add up exactly. A shard's part of
a source is a run of the permuted order, so shards are disjoint within an epoch; each shard shuffles
locally.

Only DataFrame functions are used. Sources are ranked over tasks; a node's draw goes through the sources
in chunks of CHUNK, whose totals are drawn first and in the same way, so no task holds all sources.
Documents meet the source table in a join, and word offsets come from block sums, so a source with a
third of all rows is spread over many tasks.

Defined cases: null and empty texts have size 0 and are never drawn; a null source comes last; rows
that repeat a doc_id are documents of their own; empty tables give no rows; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import cut, fresh, gapless, let, n_words_of, running, small_side, text_of

BLOCKS, MOST_EPOCHS, SHARDS = 16_384, 3, 16
WEIGHTS = (1, 2, 3)
#: Sources that a task draws for at once, and rounds of the Feistel network.
CHUNK, ROUNDS = 256, 4


def targets(sized: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST_EPOCHS) -> DataFrame:
    """One row a source: source, rank, source_size, weight, target."""
    sums = cut(sized.groupBy("source").agg(F.sum("size").alias("source_size")))
    ranked = running(sums, [F.col("source").asc_nulls_last()], F.lit(1), "_rank")
    rows = cut(ranked.select("source", F.col("_rank_n").alias("rank"), "source_size", F.element_at(F.array(*[F.lit(w) for w in weights]), (F.pmod("_rank_n", F.lit(len(weights))) + 1).cast("int")).alias("weight")))
    cap, level, known = most * F.col("source_size"), 0.0, -1
    while True:  # the sources above the level grow until they stay the same
        over = cap < F.lit(level) * F.col("weight")
        now = rows.agg(F.count_if(over).alias("n"), F.sum(F.when(over, cap)).alias("held"), F.sum(F.when(~over, F.col("weight"))).alias("left"), F.sum("source_size").alias("size")).first()
        if now["n"] == known or not now["left"]:
            break
        known, level = now["n"], ((now["size"] or 0) - (now["held"] or 0)) / now["left"]
    return rows.withColumn("target", F.least(cap.cast("double"), F.lit(level) * F.col("weight")))


def quotas(by_source: DataFrame, blocks: int = BLOCKS) -> DataFrame:
    """Adds blocks (of the source in one epoch) and quota (blocks to draw, over all epochs)."""
    n = F.least(F.lit(blocks).cast("long"), F.col("source_size"))
    return by_source.withColumn("blocks", n).withColumn("quota", F.when(F.col("source_size") > 0, F.round(F.col("target") / F.col("source_size") * n)).otherwise(0).cast("long"))


def hypergeometric(total: Column, marked: Column, draws: Column, u: Column) -> Column:
    """A draw: how many of `draws` balls out of `total` are among the `marked`, from a uniform u.

    Terms relative to the mode's are summed outwards over ten standard deviations, then again up to
    the u-th part of their sum; only two running terms are held.
    """
    k, n, big = marked.cast("double"), draws.cast("double"), total.cast("double")
    mode = F.least(marked, draws, F.floor((n + 1) * (k + 1) / (big + 2)))
    mode = F.greatest(mode, draws + marked - total, F.lit(0)).cast("long")
    spread = F.sqrt(n * k / F.greatest(big, F.lit(1.0)) * (1 - n / F.greatest(big, F.lit(1.0))))
    far = F.least(F.ceil(10 * spread) + 10, marked + 1).cast("int")

    def walk(m: Column) -> Column:
        def terms(a: Column, j: Column) -> tuple[Column, Column]:
            hi, lo = (m + j - 1).cast("double"), (m - j).cast("double")
            up = a["up"] * (k - hi) * (n - hi) / ((hi + 1) * (big - k - n + hi + 1))
            down = F.when(a["down"] == 0, 0.0).otherwise(a["down"] * (lo + 1) * (big - k - n + lo + 1) / ((k - lo) * (n - lo)))
            return F.greatest(up, F.lit(0.0)), F.greatest(down, F.lit(0.0))

        start = F.struct(F.lit(1.0).alias("up"), F.lit(1.0).alias("down"), F.lit(1.0).alias("sum"))

        def add(a: Column, j: Column) -> Column:
            up, down = terms(a, j)
            return F.struct(up.alias("up"), down.alias("down"), (a["sum"] + up + down).alias("sum"))

        whole = F.aggregate(F.sequence(F.lit(1), far), start, add)["sum"]

        def find(most: Column) -> Column:
            begin = F.struct(F.lit(1.0).alias("up"), F.lit(1.0).alias("down"), F.lit(1.0).alias("sum"), F.when(most <= 1, m).alias("pick"))

            def step(a: Column, j: Column) -> Column:
                up, down = terms(a, j)
                here = F.when(a["sum"] + up >= most, m + j).when(a["sum"] + up + down >= most, m - j)
                return F.struct(up.alias("up"), down.alias("down"), (a["sum"] + up + down).alias("sum"), F.coalesce(a["pick"], here).cast("long").alias("pick"))

            return F.coalesce(F.aggregate(F.sequence(F.lit(1), far), begin, step)["pick"], m)

        return let(u * whole, find)

    return F.when((marked <= 0) | (draws <= 0), F.lit(0).cast("long")).when(draws >= total, marked).otherwise(let(mode, walk))


def chunk_draws(seed: int, floor: int) -> Column:
    """How many of each quota of q the left half draws, source after source: of first, n, chunk, q, _sum and _draws."""
    begin = F.struct(F.col("_sum").alias("total"), F.col("_draws").alias("draws"), F.array().cast("array<bigint>").alias("left"))

    def split(a: Column, i: Column) -> Column:
        q = F.get(F.col("q"), i)
        u = F.pmod(F.xxhash64(F.lit(seed), F.lit(floor), F.col("first"), F.col("n"), F.col("chunk"), i), F.lit(1 << 53)) / float(1 << 53)
        return let(hypergeometric(a["total"], q, a["draws"], u), lambda x: F.struct((a["total"] - q).alias("total"), (a["draws"] - x).alias("draws"), F.concat(a["left"], F.array(x)).alias("left")))

    return F.aggregate(F.sequence(F.lit(0), F.size("q") - 1), begin, split)["left"]


def left_draws(nodes: DataFrame, chunks: int, by_floor: list[Column], floor: int = 0) -> DataFrame:
    """nodes (first, n, chunk, q: quotas of a chunk's sources) and `left`: how many of them the left half of a node draws.

    by_floor: chunk_draws() of sources, of chunks of them, and so on.
    """
    half = F.floor(F.col("n") / 2)
    nodes = nodes.withColumn("_sum", F.aggregate("q", F.lit(0).cast("long"), lambda a, x: a + x))
    if chunks > 1:
        above = nodes.groupBy("first", "n", F.floor(F.col("chunk") / CHUNK).alias("chunk")).agg(F.sort_array(F.collect_list(F.struct(F.col("chunk").alias("c"), F.col("_sum").alias("s")))).alias("q"))
        above = above.select("first", "n", "chunk", F.transform("q", lambda x: x["s"]).alias("q"))
        parts = left_draws(above, -(-chunks // CHUNK), by_floor, floor + 1).select("first", F.col("chunk").alias("_up"), F.posexplode("left").alias("_i", "_draws"))
        nodes = cut(nodes.join(parts.select("first", (F.col("_up") * CHUNK + F.col("_i")).alias("chunk"), "_draws"), ["first", "chunk"]))
    else:
        nodes = nodes.withColumn("_draws", F.floor(F.col("_sum") * half / F.col("n")))
    return nodes.withColumn("left", by_floor[floor]).drop("_sum", "_draws")


def splitting_tree(by_source: DataFrame, shards: int = SHARDS, seed: int = 0) -> DataFrame:
    """by_source (with rank and quota) and `bounds`: where each shard's run of the source's drawn blocks begins, and its end."""
    by_source = cut(by_source)
    chunks = -(-by_source.count() // CHUNK)
    floors = 1
    while CHUNK**floors < chunks:
        floors += 1
    by_floor = [chunk_draws(seed, floor) for floor in range(floors + (chunks > 1))]
    node = by_source.groupBy(F.floor(F.col("rank") / CHUNK).alias("chunk")).agg(F.sort_array(F.collect_list(F.struct("rank", "quota"))).alias("q"))
    node = node.select(F.lit(0).alias("first"), F.lit(shards).alias("n"), "chunk", F.transform("q", lambda x: x["quota"]).alias("q"))
    for _ in range(max(0, shards - 1).bit_length()):
        half = F.floor(F.col("n") / 2).cast("int")
        split = cut(left_draws(node.where("n > 1"), chunks, by_floor))
        right = F.zip_with("q", "left", lambda a, b: a - b)
        parts = F.array(F.struct(F.col("first"), half.alias("n"), F.col("left").alias("q")), F.struct((F.col("first") + half).alias("first"), (F.col("n") - half).alias("n"), right.alias("q")))
        whole = split.select("chunk", F.explode(parts).alias("p")).select("p.first", "p.n", "chunk", "p.q")
        node = whole if shards & (shards - 1) == 0 else whole.unionByName(node.where("n = 1"))
    leaves = node.groupBy("chunk").agg(F.sort_array(F.collect_list(F.struct("first", "q"))).alias("r"))
    own = F.transform("r", lambda x: F.get(x["q"], F.col("_i")))
    runs = leaves.select("chunk", "r", F.explode(F.sequence(F.lit(0), F.size(F.col("r")[0]["q"]) - 1)).alias("_i"))
    runs = runs.select((F.col("chunk") * CHUNK + F.col("_i")).alias("rank"), F.aggregate(own, F.array(F.lit(0).cast("long")), lambda a, q: F.concat(a, F.array(F.element_at(a, -1) + q))).alias("bounds"))
    return by_source.join(runs, "rank")


def permuted(b: Column, m: Column, side: Column, key: Column) -> Column:
    """Where block b of m stands in the order of `key`: a Feistel network over side * side >= m numbers, walked until it is below m."""

    def once(x: Column) -> Column:
        half = F.struct(int_div(x, side).alias("l"), F.pmod(x, side).alias("r"))
        mixed = F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), half, lambda a, i: F.struct(a["r"].alias("l"), F.pmod(a["l"] + F.pmod(F.xxhash64(key, i, a["r"]), side), side).alias("r")))
        return let(mixed, lambda a: a["l"] * side + a["r"])

    # A walk that leaves the numbers below m passes through the others of the square, at most all of them, before it is back.
    return F.aggregate(F.sequence(F.lit(0).cast("long"), side * side - m), b, lambda x, i: F.when((i > 0) & (x < m), x).otherwise(once(x)))


def draws(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, shards: int = SHARDS, whole: bool = False, seed: int = 0, key: Column | None = None) -> DataFrame:
    """row (a number of the row), doc_id, source, size, source_size, target and draws: an array of (shard, epoch, at, from, to),
    the words [from, to) of the document taken at place `at` of its source's drawn blocks.

    whole: a document goes, entire, with the block that its first word is in. key: a further column `key` of the result.
    """
    own = ["row"] if key is None else ["row", "key"]
    sized = cut(docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", "source", n_words_of(text_of()).alias("size"), *([] if key is None else [key.alias("key")])))
    by_source = splitting_tree(quotas(targets(sized, weights)), shards, seed).withColumns({"side": F.ceil(F.sqrt(F.col("blocks").cast("double"))), "orders": F.array(*[F.xxhash64(F.lit(seed), F.lit(e), "source") for e in range(MOST_EPOCHS)])})
    by_source = small_side(cut(by_source.drop("rank", "weight")).withColumnRenamed("source", "_source"), 10_000)
    placed = gapless(sized, ["source"], ["doc_id", "size", *own[1:], "row"], "_start", weight="size")
    placed = placed.join(by_source, F.col("source").eqNullSafe(F.col("_source")), "left")
    s, m = F.col("source_size"), F.col("blocks")
    first = F.expr("(( _start + 1) * blocks - 1) div source_size")
    last = first if whole else F.expr("((_start + greatest(size, 1)) * blocks - 1) div source_size")
    placed = placed.withColumns({"_b0": F.when(s > 0, F.least(first, m - 1)), "_b1": F.when(s > 0, F.least(last, m - 1))})

    def taken(b: Column, epoch: int) -> Column:
        def drawn(at: Column) -> Column:
            lo = F.greatest(F.lit(0).cast("long"), int_div(b * s, m) - F.col("_start"))
            hi = F.least(F.col("size"), int_div((b + 1) * s, m) - F.col("_start"))
            lo, hi = (F.lit(0).cast("long"), F.col("size")) if whole else (lo, hi)
            shard = F.size(F.filter("bounds", lambda x: x <= at)) - 1
            return F.when((at < F.col("quota")) & (hi > lo), F.struct(F.least(shard, F.lit(shards - 1)).cast("int").alias("shard"), F.lit(epoch).alias("epoch"), at.alias("at"), lo.alias("from"), hi.alias("to")))

        # An epoch that the quota does not reach is not permuted.
        return F.when(epoch * m < F.col("quota"), let(epoch * m + permuted(b, m, F.col("side"), F.get("orders", F.lit(epoch))), drawn))

    every = F.flatten(F.transform(F.sequence(F.col("_b0"), F.col("_b1")), lambda b: F.array_compact(F.array(*[taken(b, e) for e in range(MOST_EPOCHS)]))))
    none = F.array().cast("array<struct<shard:int,epoch:int,at:bigint,from:bigint,to:bigint>>")
    return placed.select(*own, "doc_id", "source", "size", "source_size", "target", F.when((F.col("size") > 0) & (s > 0), every).otherwise(none).alias("draws"))


def int_div(a: Column, b: Column) -> Column:
    """Whole-number division of non-negative longs."""
    return ((a - F.pmod(a, b)) / b).cast("long")


def mixture(drawn: DataFrame, seed: int = 0) -> DataFrame:
    """The mix of draws(), which should be cut(): shard, slot (gapless in the shard, in its shuffled order), row, doc_id, epoch, word_from, word_to."""
    rows = drawn.select("row", "doc_id", F.explode("draws").alias("d")).select("row", "doc_id", "d.shard", "d.epoch", F.col("d.from").alias("word_from"), F.col("d.to").alias("word_to"))
    rows = rows.withColumn("_key", F.xxhash64(F.lit(seed), "doc_id", "row", "epoch", "word_from"))
    return gapless(rows, ["shard"], ["_key", "row", "epoch", "word_from"], "slot").drop("_key")


def mixed_words(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, shards: int = SHARDS, seed: int = 0) -> DataFrame:
    """row, doc_id, size, source_size, target and taken: the words of each document that the mix holds, repeats counted; and of
    each output shard, as the splitting tree deals them and its local shuffle lays them: shard_words (how many of the document's
    words it holds) and shard_slots (the first slot with one of its pieces, null for none).
    """
    drawn = cut(draws(docs, weights, shards, seed=seed))
    pieces = mixture(drawn, seed).groupBy("row", "shard").agg(F.sum(F.col("word_to") - F.col("word_from")).alias("words"), F.min("slot").alias("slot"))
    by_shard = pieces.groupBy(F.col("row").alias("_row")).agg(F.map_from_entries(F.collect_list(F.struct("shard", F.struct("words", "slot")))).alias("_held"), F.sum("words").alias("taken"))  # an entry a shard at most
    told, none, every = drawn.join(by_shard, F.col("row") == F.col("_row"), "left"), F.lit(0).cast("long"), F.sequence(F.lit(0), F.lit(shards - 1))
    held = lambda name: lambda s: F.try_element_at("_held", s)[name]
    return told.select(
        "row",
        "doc_id",
        "size",
        F.coalesce("source_size", none).alias("source_size"),
        "target",
        F.coalesce("taken", none).alias("taken"),
        F.transform(every, lambda s: F.coalesce(held("words")(s), none)).alias("shard_words"),
        F.transform(every, held("slot")).alias("shard_slots"),
    )


def mixed_documents(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS) -> DataFrame:
    """The rows of docs, each as often as its own whole-document draws say.

    Rows meet their draws by a hash of doc_id, source and text; rows alike in these are told apart by
    a copy number, and meet in one task.
    """
    hashed, copy, n, drawn_n = (fresh(docs, x) for x in ("_key", "_copy", "_n", "_ns"))
    key = F.xxhash64("doc_id", "source", text_of())
    drawn = draws(docs, weights, whole=True, key=key).select(F.col("key").alias(hashed), F.size("draws").alias(n))
    counts = drawn.groupBy(hashed).agg(F.sort_array(F.collect_list(n), asc=False).alias(drawn_n)).where(F.element_at(drawn_n, 1) > 0)
    copies = Window.partitionBy(hashed).orderBy(F.xxhash64(*docs.columns))
    kept = docs.where(n_words_of(text_of()) > 0).withColumn(hashed, key).withColumn(copy, F.row_number().over(copies))
    kept = kept.join(counts, hashed).withColumn(n, F.get(drawn_n, F.col(copy) - 1)).where(F.col(n) > 0)
    return kept.withColumn(copy, F.explode(F.sequence(F.lit(1), F.col(n)))).select(*docs.columns)
