"""Range, containment and nearest joins on an equi key, with a bucket of time where a key may be large."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.intervals import rounded


def short_list(df: DataFrame, most_rows: int = 10_000) -> DataFrame:
    """df for the small side of a join: broadcast if it is counted to be short, else left to Spark."""
    return F.broadcast(df) if df.limit(most_rows + 1).count() <= most_rows else df


def spread(spans: DataFrame, lo: Column, hi: Column, bucket: float) -> DataFrame:
    """spans once for each bucket of time (`_b`) that they touch."""
    return spans.withColumn("_b", F.explode(F.sequence(F.floor(lo / bucket), F.floor(F.greatest(lo, hi) / bucket))))


def points_in_spans(points: DataFrame, spans: DataFrame, key: str, at: str, lo: str, hi: str, bucket: int) -> DataFrame:
    """points inner-joined to the spans that hold them, ends included: an equi join on the key and the buckets a span touches."""
    p = points.withColumn("_b", F.floor(F.col(at) / bucket))
    s = spread(spans, F.col(lo), F.col(hi), bucket)
    return p.join(s, [key, "_b"]).where((F.col(at) >= F.col(lo)) & (F.col(at) <= F.col(hi))).drop("_b")


def screen_actors(boxes: DataFrame, activities: DataFrame, bucket: int = 32) -> DataFrame:
    """activity_id, clip, activity, median_height, max_height, n of the boxes inside each activity's frames."""
    held = points_in_spans(boxes, activities, "clip", "frame", "f0", "f1", bucket)
    return held.groupBy("activity_id", "clip", "activity").agg(F.median("height").alias("median_height"), F.max("height").alias("max_height"), F.count(F.lit(1)).alias("n"))


def screen_clips(screened: DataFrame) -> DataFrame:
    """clip, median of the activities' medians, best, their names and number."""
    return screened.groupBy("clip").agg(F.median("median_height").alias("median_height"), F.max("max_height").alias("best"), F.array_join(F.sort_array(F.collect_set("activity")), ",").alias("activities"), F.count(F.lit(1)).alias("n"))


def best_window(events: DataFrame, media: DataFrame, key: str, length: float, lead: float = 3.0, order: str = "event_id") -> DataFrame:
    """key, start_s, contained: of windows beginning `lead` before an event, the first that wholly holds most events.

    media: key and duration_s; a window ends inside its clip where the clip is long enough. Events longer than the window are in
    none; of the others those that end inside a window less those that begin before it are held, so one order of starts, ends and
    windows tells all counts.
    """
    room = F.greatest(F.lit(0.0), F.col("duration_s") - length)
    own = events.join(media.select(key, "duration_s"), key).withColumn("w", F.greatest(F.lit(0.0), F.least(F.col("start_s") - lead, room)))
    point = lambda at, side, n: F.struct(at.alias("at"), F.lit(side).alias("side"), F.lit(n).alias("n"))
    fits = F.col("end_s") - F.col("start_s") <= length
    points = F.concat(
        F.array(point(F.col("w"), 0, 0), point(F.col("w") + length, 3, 0)),
        F.when(fits, F.array(point(F.col("start_s"), 1, 1), point(F.col("end_s"), 2, 1))).otherwise(F.array().cast("array<struct<at:double,side:int,n:int>>")),
    )
    laid = own.select(key, F.col(order).alias("_ord"), "w", F.explode(points).alias("p")).select(key, "_ord", "w", "p.*")
    sweep = Window.partitionBy(key).orderBy("at", "side").rowsBetween(Window.unboundedPreceding, 0)
    count = lambda side: F.sum(F.when(F.col("side") == side, F.col("n")).otherwise(0)).over(sweep)
    told = laid.withColumns({"_begun": count(1), "_ended": count(2)}).where("side IN (0, 3)")
    sums = told.groupBy(key, "_ord", "w").agg((F.max(F.when(F.col("side") == 3, F.col("_ended"))) - F.max(F.when(F.col("side") == 0, F.col("_begun")))).alias("n"))
    first = Window.partitionBy(key).orderBy(F.desc("n"), "w", "_ord")
    return sums.withColumn("_r", F.row_number().over(first)).where("_r = 1").select(key, F.col("w").alias("start_s"), F.col("n").alias("contained"))


def excerpt(events: DataFrame, media: DataFrame, key: str, groups: list[str], length: float) -> DataFrame:
    """groups, start_s, end_s: an excerpt centred on a group's events, pushed inside its clip from the right, then the left.

    media: key (one of groups) and duration_s.
    """
    ends = events.groupBy(*groups).agg(F.min("start_s").alias("_lo"), F.max("end_s").alias("_hi")).join(media.select(key, "duration_s"), key)
    wide = F.greatest(F.lit(length), F.col("_hi") - F.col("_lo"))
    start = F.greatest(F.lit(0.0), F.least((F.col("_lo") + F.col("_hi")) / 2 - wide / 2, F.col("duration_s") - wide))
    return ends.select(*groups, rounded(start, 3).alias("start_s"), rounded(F.least(F.col("duration_s"), start + wide), 3).alias("end_s"))


def nearest_start(truths: DataFrame, preds: DataFrame, keys: list[str]) -> DataFrame:
    """keys, t_id, start_error, end_error to the prediction whose start is nearest (first in order on ties).

    Both sides are laid in one order of starts, where the nearest is the last prediction before or the first after.
    """
    p = preds.groupBy(*keys, F.col("start_s").alias("at")).agg(F.min(F.struct("start_s", "end_s", "event_id")).alias("p"))
    t = truths.select(*keys, F.col("start_s").alias("at"), F.struct(F.col("event_id").alias("t_id"), "start_s", "end_s").alias("t"))
    laid = p.withColumn("t", F.lit(None).cast(t.schema["t"].dataType)).unionByName(t.withColumn("p", F.lit(None).cast(p.schema["p"].dataType)))
    order = Window.partitionBy(*keys).orderBy("at", F.col("t").isNotNull())
    before = F.last("p", ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, 0))
    after = F.first("p", ignorenulls=True).over(order.rowsBetween(0, Window.unboundedFollowing))
    near = F.array_min(F.transform(F.array_compact(F.array("_before", "_after")), lambda x: F.struct(F.abs(x["start_s"] - F.col("t.start_s")).alias("d"), x["start_s"].alias("s"), x["end_s"].alias("e"), x["event_id"].alias("i"))))
    m = laid.withColumns({"_before": before, "_after": after}).where(F.col("t").isNotNull() & (F.col("_before").isNotNull() | F.col("_after").isNotNull())).select(*keys, "t", near.alias("m"))
    return m.select(*keys, "t.t_id", rounded(F.abs(F.col("m.s") - F.col("t.start_s")), 3).alias("start_error"), rounded(F.abs(F.col("m.e") - F.col("t.end_s")), 3).alias("end_error"))


def transition_hits(labels: DataFrame, changes: DataFrame, tolerance_s: float) -> DataFrame:
    """video, event_id, n_within (changes inside the label widened by the tolerance), n_strict, nearest (negative: inside).

    Each label asks at four times how many changes lie before, in one order of a video's changes and questions.
    """
    s, e = F.col("start_s"), F.col("end_s")
    asked = F.array(*[F.struct(F.lit(k).alias("k"), at.alias("at"), F.lit(side).alias("side")) for k, (at, side) in enumerate(((s - tolerance_s, 0), (e + tolerance_s, 2), (s, 0), (e, 2)))])
    probes = labels.select("video", "event_id", s, e, F.explode(asked).alias("q")).select("video", "event_id", "start_s", "end_s", "q.*")
    laid = probes.unionByName(changes.select("video", "at", F.lit(1).alias("side")), allowMissingColumns=True)
    order = Window.partitionBy("video").orderBy("at", "side")
    change, ahead = F.when(F.col("side") == 1, F.col("at")), order.rowsBetween(Window.unboundedPreceding, 0)
    told = laid.withColumns({"_n": F.count(change).over(ahead), "_last": F.last(change, ignorenulls=True).over(ahead), "_next": F.first(change, ignorenulls=True).over(order.rowsBetween(0, Window.unboundedFollowing))})
    at = lambda k, name: F.max(F.when(F.col("k") == k, F.col(name)))
    sums = told.where("k IS NOT NULL").groupBy("video", "event_id", "start_s", "end_s").agg((at(1, "_n") - at(0, "_n")).alias("n_within"), (at(3, "_n") - at(2, "_n")).alias("n_strict"), at(2, "_last").alias("_last"), at(2, "_next").alias("_next"))
    return sums.select("video", "event_id", F.greatest("n_within", F.lit(0)).alias("n_within"), F.greatest("n_strict", F.lit(0)).alias("n_strict"), rounded(F.least(s - F.col("_last"), F.col("_next") - e), 3).alias("nearest"))


def run_diff(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """Counts of polls whose text and state agree or differ between two runs."""
    x = a.select(*keys, F.col("text").alias("text_a"), F.col("state").alias("state_a"))
    y = b.select(*keys, F.col("text").alias("text_b"), F.col("state").alias("state_b"))
    text, state = F.col("text_a").eqNullSafe(F.col("text_b")), F.col("state_a").eqNullSafe(F.col("state_b"))
    return x.join(y, keys).agg(F.count_if(text & state).alias("both_same"), F.count_if(text & ~state).alias("text_same_state_differs"), F.count_if(~text & state).alias("text_differs_state_same"), F.count_if(~text & ~state).alias("both_differ"))


def lookup_recordings(requests: DataFrame, recordings: DataFrame, keys: list[str], fallback: list[str]) -> DataFrame:
    """requests with ``raw`` of the first recording of their key, else of the shorter fallback key."""
    def first(on: list[str], name: str) -> DataFrame:
        return recordings.groupBy(*on).agg(F.min_by("raw", "filename").alias(name))

    exact = requests.join(first(keys, "_exact"), keys, "left")
    return exact.join(first(fallback, "_other"), fallback, "left").withColumn("raw", F.coalesce("_exact", "_other")).drop("_exact", "_other")


def last_of(rows: DataFrame, keys: list[str], order: list[str], value: str) -> DataFrame:
    """keys and value of the last row of each key: of duplicates, the last wins."""
    return rows.groupBy(*keys).agg(F.max_by(value, F.struct(*order)).alias(value))


def transition_tally(hits: DataFrame, labels: DataFrame, boundaries: DataFrame) -> DataFrame:
    """One row: scored, hits, strict_hits, partial_before, partial_after, skipped.

    hits: transition_hits() of the labels; labels (video, event_id, routed): those without a state pair are skipped, not scored;
    boundaries (video, partial_before, partial_after) of the polled timelines.
    """
    both = labels.join(hits, ["video", "event_id"], "left").join(boundaries.select("video", "partial_before", "partial_after"), "video", "left")
    routed = F.col("routed")
    return both.agg(
        F.count_if(routed).alias("scored"),
        F.count_if(routed & (F.col("n_within") > 0)).alias("hits"),
        F.count_if(routed & (F.col("n_strict") > 0)).alias("strict_hits"),
        F.count_if(routed & F.col("partial_before")).alias("partial_before"),
        F.count_if(routed & F.col("partial_after")).alias("partial_after"),
        F.count_if(~routed).alias("skipped"),
    )
