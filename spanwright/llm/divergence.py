"""Source divergence audit by three-dimensional cube partitioning.

Every (lang, source) group has a smoothed share of each term that its language keeps. The divergence of two groups is the sum
of the shares' absolute differences over all kept terms, and each group also lists the terms in which it lies most above its
language. Groups of a language are numbered and cut into blocks of GROUP_BLOCK, its kept terms into blocks of TERM_BLOCK.
A slice holds the counts of one group block in one term block. Slices are replicated to the cells (group block, group block,
term block) that need them; a task takes cells, each of at most two slices, and sums differences over its terms for all pairs
of its groups; the partial sums are added up along the term axis. Terms that a group lacks need no row: their share is one
number a group, which the cell fills in.

Words are counted inside Arrow batches, so a hot source is pre-aggregated before any shuffle; all later tables have one row a
group and term. Shares are integers, made with decimals of 38 digits, so results are exact at any size.

Defined cases: null text, lang and source count as ''; rows that repeat a doc_id, or have none, are documents of their own; a
group without terms has shares like any other; a language that keeps no term has divergences of 0 and no term rows; a group
alone in its language has no pair rows; empty tables give no rows; other columns are ignored.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import arrow_map, bound_batches, cut, cut_counted, gapless, heavy_join, text_of

#: Documents of a language that a kept term is in at least; shares are counted in units of 1 / SCALE; added to every count.
LEAST_DOCS, SCALE, SMOOTH = 30, 1_000_000_000, 5
TOP_TERMS = 50
GROUP_BLOCK, TERM_BLOCK = 16, 1_024
#: A task hands its counts on after so many different terms or bytes of text.
HELD_TERMS, HELD_BYTES = 200_000, 32 << 20

#: Bytes of terms, A-Z lower-cased; all other bytes part terms.
_TERM_BYTES = bytes(b | 0x20 if 0x41 <= b <= 0x5A else b if 0x61 <= b <= 0x7A or b >= 0x80 else 0x20 for b in range(256))
COUNT_SCHEMA = "lang string, source string, term string, n long, docs long"


def terms_of(text: bytes) -> list[bytes]:
    return text.translate(_TERM_BYTES).split(b" ") if text else []


def counted_terms(docs: DataFrame) -> DataFrame:
    """lang, source, term, n (occurrences), docs (documents with it); a group's term may come in several rows."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[str, str], tuple[Counter, Counter]] = {}
        read = terms = 0

        def told() -> pa.RecordBatch:
            cols: list[list] = [[], [], [], [], []]
            for (lang, source), (n, d) in held.items():
                n.pop(b"", None)
                cols[0] += [lang] * len(n)
                cols[1] += [source] * len(n)
                cols[2] += n.keys()
                cols[3] += n.values()
                cols[4] += [d[t] for t in n]
            kinds = (pa.string(), pa.string(), pa.binary(), pa.int64(), pa.int64())
            out = [pa.array(c, k) for c, k in zip(cols, kinds, strict=True)]
            return pa.RecordBatch.from_arrays([*out[:2], out[2].cast(pa.string()), *out[3:]], names=["lang", "source", "term", "n", "docs"])

        for batch in batches:
            texts = batch.column(2).cast(pa.binary())
            for k, (lang, source) in enumerate(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)):
                text = texts[k].as_py()
                n, d = held.setdefault((lang, source), (Counter(), Counter()))
                found, before = terms_of(text), len(n)
                n.update(found)
                d.update(set(found))
                read, terms = read + len(text), terms + len(n) - before
                if read >= HELD_BYTES or terms >= HELD_TERMS:
                    yield told()
                    held.clear()
                    read = terms = 0
        yield told()

    return arrow_map(docs.select(text_of("lang").alias("lang"), text_of("source").alias("source"), text_of("text").alias("text")), scan, COUNT_SCHEMA)


def share(count: Column, total: Column, kept: Column) -> Column:
    """1 + floor(SCALE * (count + SMOOTH) / (total + SMOOTH * kept)), exactly; null if the language keeps no term."""
    above = (count + SMOOTH).cast("decimal(20,0)") * F.lit(SCALE).cast("decimal(10,0)")
    below = (total + kept * SMOOTH).cast("decimal(20,0)")
    return F.when(kept > 0, F.call_function("div", above, below) + 1)


def cell_sums(slices: DataFrame) -> DataFrame:
    """lang, g, h (g < h) and f, a partial divergence. slices: lang, gb, tb, width, n_blocks, groups (g, p0), entries (g, t, p)."""
    bound_batches(slices.sparkSession)
    met = slices.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("n_blocks") - 1))).withColumns({"i": F.least("gb", "other"), "j": F.greatest("gb", "other")})

    def filled(cell: pa.Table, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Numbers of a slice's groups and their shares, a row a group and a column a term."""
        own = cell.column("groups")[k].values
        g, p0 = (np.asarray(own.field(x)) for x in ("g", "p0"))
        order = np.argsort(g)
        g, p0 = g[order], p0[order]
        shares = np.repeat(p0[:, None], cell.column("width")[k].as_py(), axis=1)
        entries = cell.column("entries")[k].values
        if entries is not None and len(entries):
            shares[np.searchsorted(g, np.asarray(entries.field("g"))), np.asarray(entries.field("t"))] = np.asarray(entries.field("p"))
        return g, shares

    def cell(key: tuple, rows: pa.Table) -> pa.Table:
        sides = [filled(rows, int(k)) for k in np.argsort(rows.column("gb").to_numpy())]
        (g, a), (h, b) = sides[0], sides[-1]
        sums = np.stack([np.abs(b - one).sum(axis=1) for one in a])
        at = np.nonzero(g[:, None] < h[None, :])
        n = len(at[0])
        return pa.table([pa.array([key[0].as_py()] * n, pa.string()), pa.array(g[at[0]], pa.int64()), pa.array(h[at[1]], pa.int64()), pa.array(sums[at], pa.int64())], names=["lang", "g", "h", "f"])

    return met.select("lang", "i", "j", "tb", "gb", "width", "groups", "entries").groupBy("lang", "i", "j", "tb").applyInArrow(cell, "lang string, g long, h long, f long")


def divergence(docs: DataFrame, least_docs: int = LEAST_DOCS, group_block: int = GROUP_BLOCK, term_block: int = TERM_BLOCK, top: int = TOP_TERMS) -> DataFrame:
    """lang, source, part (pair or term), item (a source or a term), value, rank."""
    counts, n_counts = cut_counted(counted_terms(docs).groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs")))
    kept = counts.groupBy("lang", "term").agg(F.sum("docs").alias("docs"), F.sum("n").alias("lang_n"), F.count(F.lit(1)).alias("_n")).where(F.col("docs") >= least_docs).drop("docs")
    kept = cut(gapless(kept, ["lang"], ["term"], "t"))
    langs = kept.groupBy("lang").agg(F.count(F.lit(1)).alias("kept"), F.sum("lang_n").alias("lang_total"))
    held, n_held = cut_counted(heavy_join(counts.select("lang", "source", "term", "n"), kept, ["lang", "term"], "_n", n_counts))

    named = docs.select(text_of("lang").alias("lang"), text_of("source").alias("source")).distinct()
    totals = held.groupBy("lang", "source").agg(F.sum("n").alias("total"), F.count(F.lit(1)).alias("_n"))
    groups = gapless(named, ["lang"], ["source"], "g").join(totals, ["lang", "source"], "left").join(langs, "lang", "left")
    none = F.lit(0).cast("long")
    groups = groups.withColumns({c: F.coalesce(c, none) for c in ("total", "_n", "kept", "lang_total")})
    groups = cut(groups.withColumns({"p0": F.coalesce(share(none, F.col("total"), F.col("kept")), none), "gb": F.floor(F.col("g") / group_block).cast("int")}))

    # A group has at most as many rows as its language keeps terms; the groups with most rows are joined by broadcast.
    known = heavy_join(held, groups.select("lang", "source", "g", "gb", "total", "kept", "lang_total", "_n"), ["lang", "source"], "_n", n_held)
    p, q = share(F.col("n"), F.col("total"), F.col("kept")), share(F.col("lang_n"), F.col("lang_total"), F.col("kept"))
    known = cut(known.select("lang", "source", "g", "gb", "term", "t", p.alias("p"), q.alias("q")))

    blocks = groups.groupBy("lang", "gb").agg(F.collect_list(F.struct("g", "p0")).alias("groups"), F.max("kept").alias("kept"))  # group_block groups at most
    blocks = blocks.join(groups.groupBy("lang").agg((F.max("gb") + 1).alias("n_blocks")), "lang")
    tb = F.floor(F.col("t") / term_block).cast("int")
    last = F.greatest(F.ceil(F.col("kept") / term_block).cast("int"), F.lit(1)) - 1
    skeleton = blocks.withColumn("tb", F.explode(F.sequence(F.lit(0), last))).withColumn("width", F.least(F.lit(term_block), F.col("kept") - F.col("tb") * term_block).cast("int"))
    local = F.struct("g", (F.col("t") - F.col("tb") * term_block).cast("int").alias("t"), "p")
    entries = known.withColumn("tb", tb).groupBy("lang", "gb", "tb").agg(F.collect_list(local).alias("entries"))  # group_block x term_block at most
    empty = F.array().cast("array<struct<g:bigint,t:int,p:bigint>>")
    slices = cut(skeleton.join(entries, ["lang", "gb", "tb"], "left").withColumn("entries", F.coalesce("entries", empty)))

    sums = cut(cell_sums(slices).groupBy("lang", "g", "h").agg(F.sum("f").alias("value")))
    sides = sums.union(sums.select("lang", "h", "g", "value"))
    names = groups.select("lang", "g", "source")
    pairs = sides.join(names, ["lang", "g"]).join(names.select("lang", F.col("g").alias("h"), F.col("source").alias("item")), ["lang", "h"])
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    columns = ["lang", "source", "part", "item", "value", "rank"]
    pairs = pairs.withColumns({"part": F.lit("pair"), "rank": F.row_number().over(order)}).select(*columns)
    terms = known.where("p > q").select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), (F.col("p") - F.col("q")).alias("value"))
    return pairs.union(terms.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top).select(*columns))
