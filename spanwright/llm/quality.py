"""Quality rules with risk-controlled thresholds.

Base rules count words, repeated lines and repeated 3-word windows of a whole text inside its own
row. The further rules are cutoffs on rates of those counts, chosen per stratum (language) from
labelled documents, of which one half proposes and the other certifies. The proposing half puts
cells (a rule and a cutoff) that reject a larger share of its bad documents than of its good ones in
order, those that reject the fewest good ones first. The certifying half tests, one after another,
whether all cells up to this one together reject at most ``risk`` of the good documents of the
stratum: an exact binomial bound at level ``level`` divided by the number of strata and one. Testing
stops at the first that fails, so by fixed-sequence testing inside a stratum and Bonferroni's
correction between strata all claims hold at once at ``level``. The cells before it hold.

A stratum in which no cell is certified takes the cells that all strata together certify, by the same
tests over all labelled documents; for it the bound holds over all strata, not over it alone. With
fewer than about log(level / (strata + 1)) / log(1 - risk) good documents in the certifying half (90 at
four strata) nothing can be certified, and with fewer than that in all strata nothing is rejected.

Only DataFrame functions are used. Defined cases: null and empty texts have no words and fail the
base rule; a null stratum is a stratum of its own; labels repeated for a document count once, the
lowest quality holding; rows that repeat a doc_id count each; without labels nothing is rejected; empty
tables give no rows; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import SPACES, cut, let, small_side, text_of, words_of

SYMBOLS = "#*$%&|<>"
#: Cutoffs tried, in thousandths.
CUTOFFS = (5, 10, 20, 50, 100, 200, 300, 500)
#: Rates, in thousandths of word characters or words.
RULES = {
    "symbols": ("n_symbols", "word_chars"),
    "shouts": ("n_shouts", "word_chars"),
    "dup_lines": ("n_dup_lines", "n_words"),
    "repeats": ("n_repeat_words", "n_words"),
}
RISK, LEVEL = 0.05, 0.05


def repeat_words(words: Column) -> Column:
    """Words in 3-word windows found twice or more in the same text.

    The windows are hashed in 64 bits. Texts whose windows all differ are done after a set test;
    in others the windows are sorted by hash, equal neighbours are kept, and their positions,
    sorted again, cover up to three words each.
    """

    def covered(at: Column) -> Column:
        """at: sorted positions."""
        return F.aggregate(F.transform(at, lambda p, i: F.least(F.lit(3), F.coalesce(F.get(at, i + 1) - p, F.lit(3)))), F.lit(0), lambda a, b: a + b)

    def sorted_at(sorted_: Column) -> Column:
        same = F.filter(sorted_, lambda x, i: (x["h"] == F.get(sorted_, i - 1)["h"]) | (x["h"] == F.get(sorted_, i + 1)["h"]))
        return let(F.sort_array(F.transform(same, lambda x: x["p"])), covered)

    def counted(hashes: Column) -> Column:
        pairs = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("p"))))
        return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), F.lit(0)).otherwise(let(pairs, sorted_at))

    def windows(w: Column) -> Column:
        hashes = F.transform(F.sequence(F.lit(0), F.size(w) - 3), lambda i: F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)))
        return F.when(F.size(w) < 3, F.lit(0)).otherwise(let(hashes, counted))

    return let(words, windows)


def base_counts(docs: DataFrame, keep: tuple[str, ...] = ("doc_id", "lang")) -> DataFrame:
    """keep columns and n_words, word_chars, n_symbols, n_shouts, n_dup_lines, n_repeat_words (long), base_failed."""
    text = text_of()
    lines = F.filter(F.split(F.col("_t"), "\n"), lambda x: F.translate(x, SPACES, "") != "")
    counted = docs.select(*keep, text.alias("_t")).select(
        *keep,
        F.length(F.translate("_t", SPACES, "")).alias("word_chars"),
        (F.length("_t") - F.length(F.translate("_t", SYMBOLS, ""))).alias("n_symbols"),
        (F.length("_t") - F.length(F.translate("_t", "!", ""))).alias("n_shouts"),
        let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).alias("n_dup_lines"),
        let(words_of(F.col("_t")), lambda w: F.struct(F.size(w).alias("n"), repeat_words(w).alias("r"))).alias("_w"),
    )
    whole = counted.select(*keep, *[F.col(c).cast("long").alias(c) for c in ("word_chars", "n_symbols", "n_shouts", "n_dup_lines")], F.col("_w.n").cast("long").alias("n_words"), F.col("_w.r").cast("long").alias("n_repeat_words"))
    return whole.withColumn("base_failed", (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words")))


def rate(rule: str) -> Column:
    part, whole = RULES[rule]
    return F.floor(1000 * F.col(part) / F.greatest(F.col(whole), F.lit(1)))


def binomial_tail(k: Column, n: Column, p: float) -> Column:
    """P(Binomial(n, p) <= k), summed term by term in logarithms; 1 for k above n * p, where no test passes."""
    step = F.struct(F.lit(0.0).alias("log"), F.lit(0.0).alias("sum"))
    logs = F.aggregate(
        F.sequence(F.lit(0), F.greatest(k, F.lit(0)).cast("int")),
        step,
        lambda a, i: let(
            F.when(i == 0, n * F.log(F.lit(1 - p))).otherwise(a["log"] + F.log((n - i + 1) / i) + F.log(F.lit(p / (1 - p)))),
            lambda g: F.struct(g.alias("log"), (a["sum"] + F.exp(g)).alias("sum")),
        ),
    )
    return F.when(k > n * p, F.lit(1.0)).otherwise(F.least(F.lit(1.0), logs["sum"]))


def rates() -> Column:
    """The rates of all rules, in their order."""
    return F.array(*[rate(rule) for rule in RULES])


def exceeded(cells: Column, own: Column) -> Column:
    """Numbers of the cells (rule, at) that a document's rates exceed, in order."""
    return F.array_compact(F.transform(cells, lambda c, i: F.when(F.get(own, c["rule"]) > c["at"], i)))


def proposed(held: DataFrame) -> DataFrame:
    """stratum and cells, in the order in which they are to be tested. held: stratum, rates, good, proposing."""
    tried = [(k, at) for k in range(len(RULES)) for at in CUTOFFS]
    over = lambda k, at: F.get("rates", F.lit(k)) > at
    counts = [F.count_if(F.col("proposing") & F.col("good")).alias("n_good"), F.count_if(F.col("proposing") & ~F.col("good")).alias("n_bad")]
    counts += [F.count_if(F.col("proposing") & (F.col("good") if good else ~F.col("good")) & over(k, at)).alias(f"{'good' if good else 'bad'}_{k}_{at}") for k, at in tried for good in (True, False)]
    sums = held.groupBy("stratum").agg(*counts)
    cell = [F.struct(F.col(f"good_{k}_{at}").alias("good"), (-F.col(f"bad_{k}_{at}")).alias("bad"), F.lit(k).alias("rule"), F.lit(-at).alias("at")) for k, at in tried]
    useful = F.filter(F.array(*cell), lambda c: -c["bad"] * F.col("n_good") > c["good"] * F.col("n_bad"))
    return sums.select("stratum", F.transform(F.sort_array(useful), lambda c: F.struct(c["rule"].alias("rule"), (-c["at"]).alias("at"))).alias("cells"))


def certified(held: DataFrame, cells: DataFrame, risk: float, level: Column | float) -> DataFrame:
    """stratum and cells, only those before the first test that fails. cells: one row a stratum."""
    named = small_side(cut(cells).withColumnRenamed("stratum", "_stratum"))
    good = held.where("good AND NOT proposing").join(named, F.col("stratum").eqNullSafe(F.col("_stratum")))
    first = good.select("stratum", F.get(exceeded(F.col("cells"), F.col("rates")), F.lit(0)).alias("step")).groupBy("stratum", "step").agg(F.count(F.lit(1)).alias("c"))
    steps = first.groupBy(F.col("stratum").alias("_s")).agg(F.sum("c").alias("n"), F.collect_list(F.struct("step", "c")).alias("steps"))
    rejected = lambda i: F.aggregate(F.filter("steps", lambda s: s["step"] <= i), F.lit(0).cast("long"), lambda a, s: a + s["c"])
    passed = F.transform("cells", lambda c, i: binomial_tail(rejected(i), F.col("n"), risk) <= level)
    told = cells.join(steps, F.col("stratum").eqNullSafe(F.col("_s"))).withColumn("_passed", passed)
    last = F.when(F.array_position("_passed", F.lit(False)) > 0, F.array_position("_passed", F.lit(False)) - 1).otherwise(F.size("cells"))
    return told.select("stratum", F.slice("cells", F.lit(1), last.cast("int")).alias("cells"))


CELLS = "array<struct<rule:int,at:int>>"


def thresholds(counts: DataFrame, labels: DataFrame, stratum: str = "lang", risk: float = RISK, level: float = LEVEL) -> tuple[DataFrame, Column]:
    """(stratum and cells of the strata that certify some; cells that all strata together certify)."""
    told = labels.groupBy(F.col("doc_id").alias("_id")).agg(F.min("quality").alias("_quality")).where("_quality IS NOT NULL")
    proposing = F.substring(F.md5(F.col("doc_id").cast("string").cast("binary")), 1, 1) < "8"
    held = cut(counts.where(~F.col("base_failed")).join(told, F.col("doc_id") == F.col("_id")).select(F.col(stratum).alias("stratum"), rates().alias("rates"), (F.col("_quality") == 1).alias("good"), proposing.alias("proposing")))
    cells = cut(proposed(held))
    tests = cells.count() + 1
    own = certified(held, cells, risk, level / tests).where(F.size("cells") > 0)
    pooled = held.withColumn("stratum", F.lit(None).cast("string"))
    found = certified(pooled, proposed(pooled), risk, level / tests).first()  # at most a cell for each rule and cutoff
    pool = F.array(*[F.struct(F.lit(c["rule"]).alias("rule"), F.lit(c["at"]).alias("at")) for c in (found["cells"] if found else [])]).cast(CELLS)
    return own, pool


def quality_verdicts(docs: DataFrame, labels: DataFrame, risk: float = RISK, level: float = LEVEL) -> DataFrame:
    """doc_id, the base counts, base_failed, rejected_by (rules whose certified cutoffs the document exceeds), kept."""
    counts = cut(base_counts(docs))
    own, pool = thresholds(counts, labels, "lang", risk, level)
    own = small_side(cut(own.withColumnsRenamed({"stratum": "_stratum", "cells": "_cells"})))
    judged = counts.join(own, F.col("lang").eqNullSafe(F.col("_stratum")), "left").withColumn("_cells", F.coalesce("_cells", pool))
    names = F.array(*[F.lit(rule) for rule in RULES])
    by = F.array_distinct(F.transform(exceeded(F.col("_cells"), rates()), lambda i: F.get(names, F.get(F.col("_cells"), i)["rule"])))
    return judged.withColumn("rejected_by", by).withColumn("kept", ~F.col("base_failed") & (F.size("rejected_by") == 0)).drop("_stratum", "_cells")
