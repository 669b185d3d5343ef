"""Interval arithmetic as column expressions. Times are doubles in seconds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Highest score that agreeing detections reach together.
CEILING = 0.97


def col(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def rounded(x: Column | str, digits: int) -> Column:
    """Half up, by binary arithmetic alone, so that other engines can repeat it exactly."""
    scale = float(10**digits)
    return F.floor(col(x) * scale + 0.5) / scale


def tiou(a_start: Column | str, a_end: Column | str, b_start: Column | str, b_end: Column | str) -> Column:
    """Overlap over hull; 0 if the hull is empty."""
    a_start, a_end, b_start, b_end = map(col, (a_start, a_end, b_start, b_end))
    inter = F.greatest(F.lit(0.0), F.least(a_end, b_end) - F.greatest(a_start, b_start))
    hull = F.greatest(a_end, b_end) - F.least(a_start, b_start)
    return F.when(hull > 0, inter / hull).otherwise(F.lit(0.0))


def relative_error(p_start: Column | str, p_end: Column | str, t_start: Column | str, t_end: Column | str) -> Column:
    """Mean boundary error over the true duration."""
    p_start, p_end, t_start, t_end = map(col, (p_start, p_end, t_start, t_end))
    return (F.abs(p_start - t_start) + F.abs(p_end - t_end)) / (2 * F.greatest(F.lit(1e-6), t_end - t_start))


def clamp(t: Column | str, lo: Column | str, hi: Column | str) -> Column:
    return F.greatest(col(lo), F.least(col(t), col(hi)))


def noisy_or(score: Column | str, ceiling: float = CEILING) -> Column:
    """Aggregate: agreement of scores, under a ceiling; 0 for no scores."""
    miss = F.product(1 - F.least(F.greatest(col(score), F.lit(0.0)), F.lit(1.0)))
    return F.coalesce(rounded(ceiling * (1 - miss), 4), F.lit(0.0))


def edge_of(at: Column, lo: Column, hi: Column, opening: bool, max_bracket: float, span: float) -> tuple[Column, Column]:
    """(time, guessed) of a state change observed between polls lo and hi: the middle of a narrow bracket, else what was seen."""
    narrow = (hi - lo) <= max_bracket
    seen = rounded(hi if opening else lo + span, 3)
    return F.when(narrow, at).otherwise(seen), ~narrow


def times_by_second(rows: DataFrame, at: str, tolerance: float) -> DataFrame:
    """video, _cell (a whole second) and _times: the distinct times of rows (video, at) that are within the tolerance of a time in it."""
    wide = tolerance + 1e-6
    spread = rows.select("video", F.col(at).alias("_at"), F.explode_outer(F.sequence(F.floor(F.col(at) - wide), F.floor(F.col(at) + wide))).alias("_cell"))
    return spread.where(F.col("_cell").isNotNull()).groupBy("video", "_cell").agg(F.collect_set("_at").alias("_times"))
