"""Bounded merging of interval candidates."""

from __future__ import annotations

import math
from collections.abc import Callable
from functools import partial

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.intervals import noisy_or, rounded
from .folds import fold_column
from .grids import STRIDE_S, WINDOW_S, near_planned_edge

GAP_S, MAX_SPAN_S, IOU, EDGE_S = 0.5, 60.0, 0.3, 0.25


def islands(cands: DataFrame, keys: list[str], gap_s: float = GAP_S, order: str = "event_id", iou: float = IOU) -> DataFrame:
    """cands with ``island``: runs that no gap over gap_s breaks. Merged groups never cross islands.

    With iou = 0 any two candidates may merge, so a key is one island.
    """
    if iou <= 0:
        return cands.withColumn("island", F.lit(0).cast("long"))
    ordered = Window.partitionBy(*keys).orderBy("start_s", "end_s", order)
    before = F.max("end_s").over(ordered.rowsBetween(Window.unboundedPreceding, -1))
    breaks = F.when(F.col("start_s") > before + gap_s, 1).otherwise(0)
    return cands.withColumn("_break", breaks).withColumn("island", F.sum("_break").over(ordered.rowsBetween(Window.unboundedPreceding, 0))).drop("_break")


def group_numbers(gap_s: float, max_span_s: float, iou: float) -> Callable[[float, float], int]:
    """The number of each candidate's group, of candidates in order: a group ends at a gap, or where it would become too long."""
    lo = hi = math.nan
    n = -1

    def step(start: float, end: float) -> int:
        nonlocal lo, hi, n
        if n >= 0 and (iou <= 0 or start - hi <= gap_s) and max(hi, end) - lo <= max_span_s:
            hi = max(hi, end)
        else:
            lo, hi, n = start, end, n + 1
        return n

    return step


def merge_groups(cands: DataFrame, keys: list[str], gap_s: float = GAP_S, max_span_s: float = MAX_SPAN_S, order: str = "event_id", iou: float = IOU) -> DataFrame:
    """cands with ``grp``, the number of the merged group inside its key. With iou = 0 any gap may be merged over.

    The span cap resets a group at a place that depends on where the group began, so it is a fold over the key's candidates in
    order; its state is one group's bounds.
    """
    ordered = [F.col(c) for c in ("start_s", "end_s", order)]
    return fold_column(cands, keys, ordered, ["start_s", "end_s"], "grp", "int", partial(group_numbers, gap_s, max_span_s, iou))


def merge(cands: DataFrame, keys: list[str], gap_s: float = GAP_S, max_span_s: float = MAX_SPAN_S, order: str = "event_id", iou: float = IOU) -> DataFrame:
    """Merged events: keys, start_s, end_s, confidence, evidence (of the most confident, first in order), source_windows, n_merged."""
    groups = merge_groups(cands, keys, gap_s, max_span_s, order, iou)
    best = F.struct(F.col("confidence"), -F.col("start_s"), -F.col("end_s"), -F.col(order))
    return groups.groupBy(*keys, "grp").agg(
        rounded(F.min("start_s"), 3).alias("start_s"),
        rounded(F.max("end_s"), 3).alias("end_s"),
        noisy_or("confidence").alias("confidence"),
        F.max_by("evidence", best).alias("evidence"),
        F.sort_array(F.collect_set("window_index")).alias("source_windows"),
        F.count(F.lit(1)).alias("n_merged"),
    ).drop("grp")


def partial_flag(events: DataFrame, media: DataFrame, tolerance: float = EDGE_S, window_s: float = WINDOW_S, stride_s: float = STRIDE_S) -> DataFrame:
    """events with ``partial``: at the clip's own ends, or seen by one window only and at an observed edge.

    media: one row a clip. The edges are those of the windows that grids.plan_windows() plans for it, told by arithmetic: a table of
    them has hundreds of rows a clip, which Spark takes for the clips' few bytes and hands to the driver.
    """
    flagged = events.join(media.select("video", "duration_s"), "video", "left")
    at_edge = [near_planned_edge(F.col(side), F.col("duration_s"), tolerance, window_s, stride_s) for side in ("start_s", "end_s")]
    partial = F.when((F.col("start_s") <= tolerance) | (F.col("end_s") >= F.col("duration_s") - tolerance), True).when(F.size("source_windows") > 1, False).otherwise(at_edge[0] | at_edge[1])
    return flagged.withColumn("partial", F.coalesce(partial, F.lit(False))).select(*events.columns, "partial")


def in_order(events: DataFrame) -> DataFrame:
    """events by video, start and end, then description."""
    return events.orderBy("video", "start_s", "end_s", "description")


def placed(events: DataFrame, folder: str) -> DataFrame:
    """events with place, 0, 1, ... in the order of in_order(), and the rows of folder, a new one, in that order.

    The sorted rows are written once; a file's rows are numbered from where the files before it end, one number a file.
    """
    spark = events.sparkSession
    in_order(events).withColumns({"_file": F.spark_partition_id(), "_row": F.monotonically_increasing_id()}).write.parquet(folder)
    held = spark.read.parquet(folder)
    sizes = held.groupBy("_file").agg(F.count(F.lit(1)).alias("_n"), F.min("_row").alias("_first"))
    ahead = F.coalesce(F.sum("_n").over(Window.orderBy("_file").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))  # one row a file
    return held.join(F.broadcast(sizes.select("_file", "_first", ahead.alias("_ahead"))), "_file").withColumn("place", F.col("_ahead") + F.col("_row") - F.col("_first")).select(*events.columns, "place")
