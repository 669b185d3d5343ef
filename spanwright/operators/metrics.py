"""Scoring predictions against truths. All matching is inside the keys; denominators are global."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.intervals import relative_error, rounded, tiou
from .folds import fold_column
from .joins import spread

KEYS = ["video", "description"]
CONTROL_AXES = ("positive_control",)
THRESHOLDS = (0.3, 0.5, 0.7)


def matched(preds: DataFrame, truths: DataFrame, keys: list[str] = KEYS, bucket: int = 16) -> DataFrame:
    """One row a truth: keys, t_start, t_end, best tiou (0 if none) and the first prediction that has it (b_start, b_end; of
    those that share a bucket of time with the truth, as no other can overlap it)."""
    t = truths.select(*keys, F.col("start_s").alias("t_start"), F.col("end_s").alias("t_end"), F.col("event_id").alias("t_id"))
    p = preds.select(*keys, F.col("start_s").alias("p_start"), F.col("end_s").alias("p_end"), F.col("event_id").alias("p_id"))
    t, p = spread(t, F.col("t_start"), F.col("t_end"), bucket), spread(p, F.col("p_start"), F.col("p_end"), bucket)
    both = t.join(p, [*keys, "_b"], "left").withColumn("iou", F.coalesce(tiou("p_start", "p_end", "t_start", "t_end"), F.lit(0.0)))
    best = F.max(F.when(F.col("p_id").isNotNull(), F.struct(F.col("iou"), (-F.col("p_start")).alias("a"), (-F.col("p_end")).alias("b"), (-F.col("p_id")).alias("c"))))
    return both.groupBy(*keys, "t_id", "t_start", "t_end").agg(best.alias("m")).select(*keys, "t_id", "t_start", "t_end", F.coalesce("m.iou", F.lit(0.0)).alias("iou"), (-F.col("m.a")).alias("b_start"), (-F.col("m.b")).alias("b_end"))


def mean_best_iou(preds: DataFrame, truths: DataFrame, keys: list[str] = KEYS) -> DataFrame:
    return matched(preds, truths, keys).agg(F.coalesce(rounded(F.avg("iou"), 4), F.lit(0.0)).alias("mean_tiou"))


def mean_relative_error(preds: DataFrame, truths: DataFrame, keys: list[str] = KEYS) -> DataFrame:
    """Over matched pairs only; null if there is none."""
    error = F.when(F.col("iou") > 0, relative_error("b_start", "b_end", "t_start", "t_end"))
    return matched(preds, truths, keys).agg(rounded(F.avg(error), 4).alias("mean_relative_error"))


def top_prediction(preds: DataFrame, keys: list[str] = KEYS) -> DataFrame:
    first = Window.partitionBy(*keys).orderBy(F.desc("confidence"), "start_s", "end_s", "event_id")
    return preds.withColumn("_n", F.row_number().over(first)).where("_n = 1").drop("_n")


def recall_at_1(preds: DataFrame, truths: DataFrame, thresholds: tuple[float, ...] = THRESHOLDS, keys: list[str] = KEYS) -> DataFrame:
    """threshold, recall: share of truths that their key's most confident prediction overlaps enough."""
    top = top_prediction(preds, keys).select(*keys, F.col("start_s").alias("p_start"), F.col("end_s").alias("p_end"))
    iou = truths.join(top, keys, "left").select(F.coalesce(tiou("p_start", "p_end", "start_s", "end_s"), F.lit(-1.0)).alias("iou"))
    sums = iou.agg(F.count(F.lit(1)).alias("n"), *[F.count_if(F.col("iou") >= t).alias(f"k{i}") for i, t in enumerate(thresholds)])
    rows = F.explode(F.array(*[F.struct(F.lit(t).alias("threshold"), F.col(f"k{i}").alias("k")) for i, t in enumerate(thresholds)]))
    return sums.select("n", rows.alias("r")).select("r.threshold", F.when(F.col("n") > 0, rounded(F.col("r.k") / F.col("n"), 4)).otherwise(0.0).alias("recall"))


def first_free() -> Callable[[int, int], bool]:
    """Whether a pair is matched, of pairs by falling confidence, then falling overlap: both its sides are free."""
    taken: set[int] = set()
    last: int | None = None

    def step(pred: int, truth: int) -> bool:
        nonlocal last
        if pred == last or truth in taken:
            return False
        taken.add(truth)
        last = pred
        return True

    return step


def greedy_matches(preds: DataFrame, truths: DataFrame, threshold: float, keys: list[str] = KEYS, bucket: int = 16) -> DataFrame:
    """keys and tp: one-to-one matches, predictions by falling confidence, each taking its best truth left.

    A prediction's best free truth counts if it overlaps enough, so only pairs that do are made, by buckets of time; they are
    folded in order, with the truths taken so far as a key's state.
    """
    p = preds.select(*keys, F.col("start_s").alias("p_start"), F.col("end_s").alias("p_end"), (-F.col("confidence")).alias("_c"), F.col("event_id").alias("_p"))
    t = truths.select(*keys, F.col("start_s").alias("t_start"), F.col("end_s").alias("t_end"), F.col("event_id").alias("_t"))
    both = spread(p, F.col("p_start"), F.col("p_end"), bucket).join(spread(t, F.col("t_start"), F.col("t_end"), bucket), [*keys, "_b"])
    # Of the buckets that two spans share, the first has the pair.
    here = F.col("_b") == F.floor(F.greatest("p_start", "t_start") / bucket)
    iou = tiou("p_start", "p_end", "t_start", "t_end")
    pairs = both.where(here).withColumn("_iou", iou).where((F.col("_iou") > 0) & (F.col("_iou") >= threshold))
    order = [F.col(c) for c in ("_c", "p_start", "p_end", "_p")] + [F.desc("_iou"), *[F.col(c) for c in ("t_start", "t_end", "_t")]]
    told = fold_column(pairs.select(*keys, "_c", "p_start", "p_end", "_p", "_iou", "t_start", "t_end", "_t"), keys, order, ["_p", "_t"], "_match", "boolean", first_free)
    return told.groupBy(*keys).agg(F.count_if("_match").alias("tp"))


def detection_pr(preds: DataFrame, truths: DataFrame, threshold: float = 0.5, keys: list[str] = KEYS) -> DataFrame:
    """precision, recall over all predictions and all truths; 0 where there are none."""
    counts = greedy_matches(preds, truths, threshold, keys).agg(F.coalesce(F.sum("tp"), F.lit(0)).alias("tp"))
    n_p, n_t = preds.agg(F.count(F.lit(1)).alias("np")), truths.agg(F.count(F.lit(1)).alias("nt"))
    one = counts.crossJoin(n_p).crossJoin(n_t)  # three single rows
    share = lambda n: F.when(F.col(n) > 0, rounded(F.col("tp") / F.col(n), 4)).otherwise(0.0)
    return one.select("tp", share("np").alias("precision"), share("nt").alias("recall"))


def false_positive_rate(preds: DataFrame, truths: DataFrame, keys: list[str] = KEYS) -> DataFrame:
    """Share of predictions on keys without any truth."""
    known = truths.select(*keys).distinct().withColumn("_known", F.lit(True))
    spurious = preds.join(known, keys, "left").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("_known").isNull()).alias("k"))
    return spurious.select(F.when(F.col("n") > 0, rounded(F.col("k") / F.col("n"), 4)).otherwise(0.0).alias("false_positive_rate"))


def without_controls(rows: DataFrame, axes: DataFrame) -> DataFrame:
    return rows.join(axes.where(F.col("axis").isin(*CONTROL_AXES)).select("video"), "video", "left_anti")


def mixed_controls(axes: DataFrame) -> DataFrame:
    """One row if control clips stand beside ordinary ones, which a scored set must not have."""
    return axes.agg(F.count_if(F.col("axis").isin(*CONTROL_AXES)).alias("n_control"), F.count_if(~F.col("axis").isin(*CONTROL_AXES)).alias("n_ordinary")).where("n_control > 0 AND n_ordinary > 0")


def metric_bundle(preds: DataFrame, truths: DataFrame, by: list[str] | None = None) -> DataFrame:
    """All metrics, one row for each value of `by` (columns of both inputs), or one row over everything.

    by is added to the match keys, so each group is scored by itself.
    """
    by = by or []
    keys = [*by, *KEYS]
    one = [F.lit(1).alias("_g")] if not by else []
    g = by or ["_g"]
    m = matched(preds, truths, keys).select("*", *one)
    error = F.when(F.col("iou") > 0, relative_error("b_start", "b_end", "t_start", "t_end"))
    top = top_prediction(preds, keys).select(*keys, F.col("start_s").alias("p_start"), F.col("end_s").alias("p_end"))
    first = truths.join(top, keys, "left").select(*by, *one, F.coalesce(tiou("p_start", "p_end", "start_s", "end_s"), F.lit(-1.0)).alias("iou"))
    known = truths.select(*keys).distinct().withColumn("_known", F.lit(True))
    spurious = preds.join(known, keys, "left").select(*by, *one, "_known")
    parts = [
        m.groupBy(*g).agg(F.count(F.lit(1)).alias("n_truths"), rounded(F.avg("iou"), 4).alias("mean_tiou"), rounded(F.avg(error), 4).alias("mean_relative_error")),
        first.groupBy(*g).agg(*[rounded(F.avg((F.col("iou") >= t).cast("double")), 4).alias(f"r_at_1_{int(t * 10)}") for t in THRESHOLDS]),
        greedy_matches(preds, truths, 0.5, keys).select("*", *one).groupBy(*g).agg(F.sum("tp").alias("tp")),
        spurious.groupBy(*g).agg(F.count(F.lit(1)).alias("n_predictions"), F.count_if(F.col("_known").isNull()).alias("n_spurious")),
    ]
    out = parts[0]
    for part in parts[1:]:
        out = out.join(part, g, "left")
    none = F.coalesce("n_predictions", F.lit(0))
    share = lambda k, n: F.when(F.col(n) > 0, rounded(F.coalesce(k, F.lit(0)) / F.col(n), 4)).otherwise(0.0)
    return out.select(*by, none.alias("n_predictions"), "n_truths", "mean_tiou", share("tp", "n_predictions").alias("precision_5"), share("tp", "n_truths").alias("recall_5"), share("n_spurious", "n_predictions").alias("false_positive_rate"), "mean_relative_error", *[f"r_at_1_{int(t * 10)}" for t in THRESHOLDS])


def by_axis(preds: DataFrame, truths: DataFrame, axes: DataFrame) -> DataFrame:
    """The bundle for each axis that has truths; predictions count if their clip has a truth."""
    named = truths.join(axes, "video", "left").withColumn("axis", F.coalesce("axis", F.lit("unknown")))
    clips = named.select("video", "axis").distinct()
    return metric_bundle(preds.join(clips, "video"), named, ["axis"])


def routing_coverage(truths: DataFrame, states_map: DataFrame) -> DataFrame:
    """How many descriptions and events a states map can answer."""
    routed = truths.join(states_map.select("description").distinct().withColumn("_r", F.lit(True)), "description", "left")
    return routed.agg(F.countDistinct("description").alias("descriptions"), F.countDistinct(F.when(F.col("_r"), F.col("description"))).alias("descriptions_routed"), F.count(F.lit(1)).alias("events"), F.count_if(F.col("_r")).alias("events_routed"))


def declined(truths: DataFrame, states_map: DataFrame) -> DataFrame:
    return truths.join(states_map, "description", "left_anti").select("description").distinct()


def threshold_sweep(preds: DataFrame, truths: DataFrame, thresholds: tuple[float, ...] = (0.0, 0.6, 0.8, 0.9)) -> DataFrame:
    """Predictions left and greedy matches at each confidence threshold."""
    levels = F.explode(F.array(*[F.lit(t) for t in thresholds]))
    kept = preds.withColumn("level", levels).where(F.col("confidence") >= F.col("level"))
    wanted = truths.withColumn("level", levels)
    tp = greedy_matches(kept, wanted, 0.5, ["level", *KEYS]).groupBy("level").agg(F.sum("tp").alias("tp"))
    n = kept.groupBy("level").agg(F.count(F.lit(1)).alias("n_predictions"))
    return n.join(tp, "level", "left").select("level", "n_predictions", F.coalesce("tp", F.lit(0)).alias("tp"), rounded(F.coalesce("tp", F.lit(0)) / F.col("n_predictions"), 4).alias("precision"))


def run_cost(per_video: DataFrame, usd_per_hour: float | None) -> DataFrame:
    """per_video: duration_s, elapsed_s. Wall seconds a video minute; dollars a video minute, null without a rate."""
    wall = F.sum("elapsed_s") / (F.sum("duration_s") / 60)
    return per_video.agg(rounded(wall, 2).alias("wall_s_per_video_min"), (rounded(wall / 3600 * usd_per_hour, 4) if usd_per_hour is not None else F.lit(None).cast("double")).alias("usd_per_video_min"))
