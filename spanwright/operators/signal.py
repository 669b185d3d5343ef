"""Change signals and the moments of greatest change."""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Callable
from functools import partial

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.intervals import rounded
from .folds import fold_column


def change_signal(frames: DataFrame, noise: float, keys: list[str] | None = None) -> DataFrame:
    """keys, t, moved_pct: share of pixels that differ by more than noise from the sample before, told at the later one."""
    keys = keys or ["video"]
    order = Window.partitionBy(*keys).orderBy("t")
    pairs = frames.withColumn("_before", F.lag("arr").over(order)).where(F.col("_before").isNotNull())
    moved = F.aggregate(F.zip_with("_before", "arr", lambda a, b: F.when(F.abs(b - a) > noise, 1).otherwise(0)), F.lit(0), lambda a, x: a + x)
    return pairs.select(*keys, rounded("t", 3).alias("t"), rounded(moved / F.size("arr") * 100, 4).alias("moved_pct"))


def apart(min_gap_s: float) -> Callable[[float], bool]:
    """Whether a time is picked, of times strongest first: none of those picked before is nearer than the gap."""
    picked: list[float] = []

    def step(t: float) -> bool:
        k = bisect_left(picked, t)
        if (k and abs(picked[k - 1] - t) < min_gap_s) or (k < len(picked) and abs(picked[k] - t) < min_gap_s):
            return False
        picked.insert(k, t)
        return True

    return step


def peaks(signal: DataFrame, top_k: int | None, min_pct: float = 0.0, min_gap_s: float = 2.0, keys: list[str] | None = None) -> DataFrame:
    """keys, t: greedy non-maximum suppression, strongest first (earlier on ties), nothing within min_gap_s of a pick.

    Where no strong sample lies within the gap the signal is cut into blocks, which cannot suppress each other's samples. A block
    is a fold over its samples by strength that holds its picks; the top_k strongest picks of all blocks are those of the whole.
    """
    keys = keys or ["video"]
    strong = signal.where((F.col("moved_pct") >= min_pct) & F.col("t").isNotNull()).select(*keys, "t", "moved_pct")
    order = Window.partitionBy(*keys).orderBy("t")
    begins = F.when(F.col("t") - F.lag("t").over(order) < min_gap_s, 0).otherwise(1)
    blocks = strong.withColumn("_new", begins).withColumn("_block", F.sum("_new").over(order.rowsBetween(Window.unboundedPreceding, 0))).drop("_new")
    picks = fold_column(blocks, [*keys, "_block"], [F.desc("moved_pct"), F.col("t")], ["t"], "_picked", "boolean", partial(apart, min_gap_s)).where("_picked")
    if top_k:
        strongest = Window.partitionBy(*keys).orderBy(F.desc("moved_pct"), "t")
        picks = picks.withColumn("_r", F.row_number().over(strongest)).where(F.col("_r") <= top_k)
    return picks.select(*keys, "t")


def clip_activity(signal: DataFrame, active_pct: float, keys: list[str] | None = None) -> DataFrame:
    """keys, peak, mean, active share."""
    keys = keys or ["video"]
    return signal.groupBy(*keys).agg(F.max("moved_pct").alias("peak"), rounded(F.avg("moved_pct"), 4).alias("mean"), rounded(F.avg((F.col("moved_pct") > active_pct).cast("double")), 4).alias("active_share"))


def upper_median(rows: DataFrame, value: str, keys: list[str]) -> DataFrame:
    """keys, median: the upper of the middle pair."""
    ranked = rows.where(F.col(value).isNotNull()).select(*keys, F.col(value).alias("median"), F.row_number().over(Window.partitionBy(*keys).orderBy(value)).alias("_r"), F.count(F.lit(1)).over(Window.partitionBy(*keys)).alias("_n"))
    return ranked.where(F.col("_r") == F.floor(F.col("_n") / 2) + 1).select(*keys, "median")


def peak_of_series(series: DataFrame, keys: list[str], value: str = "moved_pct") -> DataFrame:
    """keys, t of the greatest value (first on ties), its value, and the range of values; NaN is left out."""
    clean = series.where(~F.isnan(value) & F.col(value).isNotNull())
    return clean.groupBy(*keys).agg(F.max_by("t", F.struct(F.col(value), -F.col("t"))).alias("t"), F.max(value).alias("peak"), (F.max(value) - F.min(value)).alias("spread"))
