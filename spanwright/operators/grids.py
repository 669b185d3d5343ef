"""Time grids: windows, polls, sampling, frame assignment, cost."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.intervals import rounded
from .joins import short_list
from .states import by_time

WINDOW_S, STRIDE_S, STEP_S, SPAN_S, SLACK = 12.0, 9.0, 1.0, 2.0, 1e-6


def n_windows(duration: Column, window_s: float, stride_s: float) -> Column:
    return F.when(duration > 0, 1 + F.greatest(F.lit(0), F.ceil((duration - window_s) / stride_s))).otherwise(0).cast("int")


def spread_clips(media: DataFrame) -> DataFrame:
    """media over as many tasks as a shuffle has: few bytes of clips, which Spark would leave to one task, become many rows."""
    return media.repartition(int(media.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def plan_windows(media: DataFrame, window_s: float = WINDOW_S, stride_s: float = STRIDE_S) -> DataFrame:
    """video, index, start_s, end_s: overlapping windows from 0, the last ending at the duration; none for an empty clip."""
    if window_s <= 0 or stride_s <= 0:
        raise ValueError("window and stride must be positive")
    counted = spread_clips(media).withColumn("_n", n_windows(F.col("duration_s"), window_s, stride_s)).where("_n > 0")
    rows = counted.withColumn("index", F.explode(F.sequence(F.lit(0), F.col("_n") - 1)))
    start = F.col("index") * stride_s
    return rows.select("video", "index", rounded(start, 3).alias("start_s"), rounded(F.least(start + window_s, F.col("duration_s")), 3).alias("end_s"))


def window_edges(windows: DataFrame) -> DataFrame:
    """video, edge: distinct starts and ends."""
    return windows.select("video", F.col("start_s").alias("edge")).union(windows.select("video", "end_s")).distinct()


def planned_edges(media: DataFrame, window_s: float = WINDOW_S, stride_s: float = STRIDE_S) -> DataFrame:
    """window_edges() of the windows that plan_windows() plans, told by each clip's own row: no table of edges is held.

    media: one row a clip.
    """
    if window_s <= 0 or stride_s <= 0:
        raise ValueError("window and stride must be positive")
    counted = spread_clips(media).withColumn("_n", n_windows(F.col("duration_s"), window_s, stride_s)).where("_n > 0")
    ends = lambda i: F.array(rounded(i * stride_s, 3), rounded(F.least(i * stride_s + window_s, F.col("duration_s")), 3))
    return counted.select("video", F.explode_outer(F.array_distinct(F.flatten(F.transform(F.sequence(F.lit(0), F.col("_n") - 1), ends)))).alias("edge"))


def near_planned_edge(at: Column, duration: Column, tolerance: float, window_s: float = WINDOW_S, stride_s: float = STRIDE_S) -> Column:
    """Whether a time is nearer than the tolerance to an edge of its clip's windows, those of plan_windows().

    Starts and ends rise with the window's number, so the windows numbered around the time's own place have the nearest edges and
    no table of edges is joined.
    """
    if window_s <= 0 or stride_s <= 0:
        raise ValueError("window and stride must be positive")
    n = n_windows(duration, window_s, stride_s)
    reach = 1 + math.ceil(1e-3 / stride_s)  # how many windows off the rounding of edges may put the place

    def near(place: Column, edge: Callable[[Column], Column]) -> Column:
        k = F.floor(F.least(F.greatest(place / stride_s, F.lit(0.0)), n.cast("double")))
        around = F.sequence(F.greatest(k - reach, F.lit(0)), F.least(k + reach, n - 1))
        return F.exists(around, lambda i: F.abs(at - rounded(edge(i), 3)) < tolerance)

    return (n > 0) & (near(at, lambda i: i * stride_s) | near(at - window_s, lambda i: F.least(i * stride_s + window_s, duration)))


def plan_cost(media: DataFrame, n_queries: int, fps: float, window_s: float = WINDOW_S, stride_s: float = STRIDE_S) -> DataFrame:
    n = n_windows(F.col("duration_s"), window_s, stride_s)
    return media.select("video", F.floor(F.col("duration_s") * fps).cast("int").alias("frames"), n.alias("windows"), F.lit(n_queries).alias("queries"), (n * n_queries).alias("model_calls"))


def over_budget(cost: DataFrame, limit: int) -> DataFrame:
    """Plans that would make more calls than the limit allows."""
    return cost.where(F.col("model_calls") > limit)


def check_budget(cost: DataFrame, limit: int) -> DataFrame:
    """cost, failing at run time on a plan over the limit."""
    refused = F.raise_error(F.concat(F.lit("over budget: "), F.col("model_calls").cast("string"))).cast("int")
    return cost.withColumn("model_calls", F.when(F.col("model_calls") <= limit, F.col("model_calls")).otherwise(refused))


def poll_grid(media: DataFrame, step_s: float = STEP_S, span_s: float = SPAN_S) -> DataFrame:
    """video, t: a uniform grid from 0 to duration - span, both included; none for shorter clips."""
    last = F.floor((F.col("duration_s") - span_s) / step_s + 1e-9)
    numbered = spread_clips(media).where(F.col("duration_s") >= span_s).select("video", F.explode(F.sequence(F.lit(0), last.cast("int"))).alias("_i"))
    return numbered.select("video", rounded(F.col("_i") * step_s, 3).alias("t"))


def downsample(frames: DataFrame, step_s: float, start_s: float = 0.0, end_s: float | None = None) -> DataFrame:
    """The first frame at or after each grid point, at most one a step; of frames of one time, that with the least event_id, if they have one."""
    kept = frames.where(F.col("t") + SLACK >= start_s)
    if end_s is not None:
        kept = kept.where(F.col("t") <= end_s)
    cell = F.floor((F.col("t") - start_s + SLACK) / step_s)
    first = Window.partitionBy("video", "_cell").orderBy(*by_time(frames))
    return kept.withColumn("_cell", cell).withColumn("_n", F.row_number().over(first)).where("_n = 1").drop("_n", "_cell")


def assign_frames(frames: DataFrame, media: DataFrame, max_frames: int, window_s: float = WINDOW_S, stride_s: float = STRIDE_S) -> DataFrame:
    """video, index, t and the frames' other columns: frames of every window, thinned evenly over a cap.

    Window numbers come from arithmetic on t and the clip's own duration (media: video, duration_s), so no join with the windows
    is needed; frames of clips that media lacks, and frames after a clip's end, are in no window.
    """
    if max_frames <= 0:
        raise ValueError("the cap on frames must be positive")
    own = ["_n", "_d"]
    clips = media.select("video", n_windows(F.col("duration_s"), window_s, stride_s).alias("_n"), F.col("duration_s").alias("_d"))
    lo = F.greatest(F.lit(0), F.ceil((F.col("t") - window_s - SLACK) / stride_s)).cast("int")
    hi = F.least(F.col("_n") - 1, F.floor((F.col("t") + SLACK) / stride_s)).cast("int")
    held = frames.join(clips, "video").where((F.col("_n") > 0) & (F.col("t") >= -SLACK) & (F.col("t") <= rounded(F.col("_d"), 3) + SLACK) & (hi >= lo))
    return subsample(held.withColumn("index", F.explode(F.sequence(lo, hi))).drop(*own), ["video", "index"], max_frames)


def with_frames(windows: DataFrame, frames: DataFrame, media: DataFrame, max_frames: int, window_s: float = WINDOW_S, stride_s: float = STRIDE_S) -> DataFrame:
    """windows with frame_times: the times of the frames that a model is shown for the window, in order, at most max_frames."""
    shown = assign_frames(frames.select("video", "t"), media, max_frames, window_s, stride_s).groupBy("video", "index").agg(F.array_sort(F.collect_list("t")).alias("frame_times"))
    return windows.join(shown, ["video", "index"], "left").withColumn("frame_times", F.coalesce("frame_times", F.array().cast("array<double>")))


def subsample(rows: DataFrame, keys: list[str], most: int, order: str = "t") -> DataFrame:
    """Rows whose rank is int(i * (n / most)) for some i: an even sample of at most `most` rows of each key."""
    own = Window.partitionBy(*keys)
    ranked = rows.withColumns({"_r": F.row_number().over(own.orderBy(*(by_time(rows) if order == "t" else [order]))) - 1, "_n": F.count(F.lit(1)).over(own)})
    step = F.col("_n") / float(most)
    # Some i has int(i * step) = r exactly if the first i with i * step >= r stays below r + 1; its neighbours cover rounding.
    guess = F.floor(F.col("_r") / step)
    hit = None
    for d in (-1, 0, 1, 2):
        i = guess + d
        own_hit = (i >= 0) & (i < most) & (F.least(F.floor(i * step), F.col("_n") - 1) == F.col("_r"))
        hit = own_hit if hit is None else hit | own_hit
    return ranked.where((F.col("_n") <= most) | hit).drop("_r", "_n")


def expand_requests(windows: DataFrame, queries: DataFrame, variant: str) -> DataFrame:
    """windows x queries: the request relation of a run. queries is the list that the user typed."""
    return windows.crossJoin(short_list(queries)).withColumn("prompt_variant", F.lit(variant))


def triggered_grid(signal: DataFrame, media: DataFrame, top_k: int, min_pct: float, min_gap_s: float, span_s: float = SPAN_S) -> DataFrame:
    """video, t: polls at the greatest changes of a signal (video, t, moved_pct), those whose span ends inside the clip."""
    from .signal import peaks

    return peaks(signal, top_k, min_pct, min_gap_s).join(media.select("video", "duration_s"), "video").where(F.col("t") + span_s <= F.col("duration_s")).select("video", "t")


def states_cost(media: DataFrame, n_groups: int, step_s: float = STEP_S, span_s: float = SPAN_S) -> DataFrame:
    """video, polls, model_calls of a states run: every group of states is polled at every time of the grid."""
    polls = F.when(F.col("duration_s") >= span_s, F.floor((F.col("duration_s") - span_s) / step_s + 1e-9) + 1).otherwise(0).cast("long")
    return media.select("video", polls.alias("polls"), (polls * n_groups).alias("model_calls"))
