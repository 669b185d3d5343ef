"""Label checks, merges of judged labels, probe statistics, screening."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.intervals import rounded
from .joins import spread


def label_problems(labels: DataFrame, durations: DataFrame) -> DataFrame:
    """event_id, problem: one row for each rule that a label breaks."""
    rows = labels.join(durations, "video", "left")
    blank = F.coalesce(F.trim("description"), F.lit("")) == ""
    rules = (
        (F.col("duration_s").isNull(), "missing clip"),
        (blank, "blank text"),
        (F.col("description").rlike("^[a-z]+(_[a-z]+)+$"), "class name"),
        (F.col("end_s") <= F.col("start_s"), "end before start"),
        (F.col("start_s") < 0, "negative start"),
        (F.col("end_s") > F.col("duration_s"), "end after clip"),
        (F.col("end_s") - F.col("start_s") > 20, "suspect span"),
    )
    return rows.select("event_id", F.explode(F.array_compact(F.array(*[F.when(test, name) for test, name in rules]))).alias("problem"))


def upsert_labels(plan: DataFrame, judged: DataFrame) -> DataFrame:
    """Merge of a plan (video, event_id, start_s, end_s) into judged labels (with status): judged rows are carried as they
    are, rows still pending are refreshed from the plan, new ones are appended as pending."""
    p = plan.select("video", "event_id", F.col("start_s").alias("_s"), F.col("end_s").alias("_e"))
    both = judged.join(p, ["video", "event_id"], "full_outer")
    keep = F.col("status").isNotNull() & (F.col("status") != "pending")
    return both.select(
        "video",
        "event_id",
        F.when(keep, F.col("start_s")).otherwise(F.coalesce("_s", "start_s")).alias("start_s"),
        F.when(keep, F.col("end_s")).otherwise(F.coalesce("_e", "end_s")).alias("end_s"),
        F.coalesce("status", F.lit("pending")).alias("status"),
    )


def moved_judged(plan: DataFrame, judged: DataFrame) -> DataFrame:
    """Judged labels whose plan has moved: an upsert of these is refused."""
    p = plan.select("video", "event_id", F.col("start_s").alias("_s"), F.col("end_s").alias("_e"))
    return judged.where("status <> 'pending'").join(p, ["video", "event_id"]).where((F.col("start_s") != F.col("_s")) | (F.col("end_s") != F.col("_e"))).select("video", "event_id")


def zone(t: Column, start: Column, end: Column, margin: float = 0.35) -> Column:
    """in, edge or out of one event; inside keeps off the ends by the margin, or a quarter of a short event."""
    m = F.least(F.lit(margin), (end - start) / 4)
    return F.when((t >= start + m) & (t <= end - m), "in").when((t >= start - margin) & (t <= end + margin), "edge").otherwise("out")


def zones(points: DataFrame, events: DataFrame, keys: list[str], margin: float = 0.35, bucket: int = 16) -> DataFrame:
    """keys, point_id, zone: by the first event, in order, that the point is in or at the edge of."""
    e = events.select(*keys, F.col("start_s").alias("_s"), F.col("end_s").alias("_e"), F.col("event_id").alias("_i"))
    e = spread(e, F.col("_s") - margin, F.col("_e") + margin, bucket)
    z = zone(F.col("t"), F.col("_s"), F.col("_e"), margin)
    first = F.min(F.when(z != "out", F.struct("_s", "_e", "_i", z.alias("z"))))
    near = points.withColumn("_b", F.floor(F.col("t") / bucket)).join(e, [*keys, "_b"], "left")
    return near.groupBy(*keys, "point_id", "t").agg(F.coalesce(first["z"], F.lit("out")).alias("zone"))


def sample_rates(events: DataFrame, keys: list[str]) -> DataFrame:
    """keys, fps: enough samples for the shortest event, from 4 to 30."""
    shortest = F.min(F.col("end_s") - F.col("start_s"))
    return events.groupBy(*keys).agg(F.least(F.lit(30.0), F.greatest(F.lit(4.0), 4.0 / F.greatest(shortest, F.lit(0.05)))).alias("fps"))


def probe_summary(errors: DataFrame, by: list[str]) -> DataFrame:
    """by, n, median, mean and p90 (from ten errors on) of boundary errors."""
    own = Window.partitionBy(*by)
    ranked = errors.withColumns({"_r": F.row_number().over(own.orderBy("error")) - 1, "_n": F.count(F.lit(1)).over(own)})
    p90 = F.max(F.when((F.col("_n") >= 10) & (F.col("_r") == F.floor(F.col("_n") * 0.9)), F.col("error")))
    return ranked.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), rounded(F.median("error"), 4).alias("median_error"), rounded(F.avg("error"), 4).alias("mean_error"), p90.alias("p90_error"))


def best_combination(summary: DataFrame, by: list[str], error: str = "median_error") -> DataFrame:
    """The row with the least error, first in order on ties."""
    return summary.where(F.col(error).isNotNull()).agg(F.min_by(F.struct(*by, error), F.struct(error, *by)).alias("b")).select("b.*")


def leaderboard(registry: DataFrame, evals: DataFrame, probes: DataFrame) -> DataFrame:
    """Registered models with their evaluation and probe where present."""
    return registry.join(evals, "model", "left").join(probes, "model", "left")


def status_tally(labels: DataFrame) -> DataFrame:
    return labels.groupBy("status").agg(F.count(F.lit(1)).alias("n"))


def duplicates(queries: DataFrame, column: str) -> DataFrame:
    """Requests asked more than once, which are refused and not merged."""
    named = queries.select(F.trim(column).alias(column)).where(F.length(column) > 0)
    return named.groupBy(column).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def output_violations(events: DataFrame, media: DataFrame) -> DataFrame:
    """event_id, violation of the output contract."""
    rows = events.join(media, "video", "left")
    rules = ((F.col("start_s") < 0, "starts before 0"), (F.col("end_s") > F.col("duration_s") + 1e-6, "ends after the clip"), (F.col("end_s") < F.col("start_s"), "ends before it starts"), (~F.col("confidence").between(0, 1), "confidence outside 0 to 1"))
    return rows.select("event_id", F.explode(F.array_compact(F.array(*[F.when(test, name) for test, name in rules]))).alias("violation"))


def offset_sweep(events: DataFrame, offsets: tuple[float, ...], window_s: float, key: str = "event_id") -> DataFrame:
    """key, offset_s, contains, position: windows at listed offsets before each event."""
    at = F.explode(F.array(*[F.lit(x) for x in offsets]))
    rows = events.withColumn("offset_s", at).withColumn("_w", F.col("start_s") - F.col("offset_s"))
    return rows.select(key, "offset_s", ((F.col("start_s") >= F.col("_w")) & (F.col("end_s") <= F.col("_w") + window_s)).alias("contains"), rounded((F.col("start_s") - F.col("_w")) / window_s, 4).alias("position"))


def offset_windows(cases: DataFrame, offsets: tuple[float, ...], window_s: float) -> DataFrame:
    """cases (start_s, end_s of the truth, ...) x windows that begin at the listed offsets: lo, hi, and whether the truth overlaps it."""
    rows = cases.withColumn("lo", F.explode(F.array(*[F.lit(float(x)) for x in offsets]))).withColumn("hi", F.col("lo") + window_s)
    return rows.withColumn("contains", (F.col("start_s") < F.col("hi")) & (F.col("end_s") > F.col("lo")))


#: A reported start is near the end of its window from this part of it on; slides above and below these follow the window or the event.
NEAR_END, FOLLOWS_WINDOW, FOLLOWS_EVENT = 0.75, 0.7, 0.3


def slides(answers: DataFrame, keys: list[str]) -> DataFrame:
    """keys, n_answered, n_near_end, slide, verdict: how far the reported start moves with the window that a model is shown.

    answers: keys, lo, hi, reported (start of the first event, null: none); one row a window. The slide is the movement of the
    starts over that of the windows, and null for fewer than two answers at different offsets, which show nothing.
    """
    told = F.col("reported").isNotNull()
    near = told & ((F.col("reported") - F.col("lo")) / F.greatest(F.lit(1e-6), F.col("hi") - F.col("lo")) >= NEAR_END)
    at, start = F.when(told, F.col("lo")), F.col("reported")
    sums = answers.groupBy(*keys).agg(F.count_if(told).alias("n_answered"), F.count_if(near).alias("n_near_end"), (F.max(at) - F.min(at)).alias("_moved"), (F.max(start) - F.min(start)).alias("_went"))
    slide = F.when((F.col("n_answered") >= 2) & (F.col("_moved") >= 1e-6), rounded(F.col("_went") / F.col("_moved"), 4))
    judged = F.when(F.col("slide") > FOLLOWS_WINDOW, "window").when(F.col("slide") < FOLLOWS_EVENT, "event").otherwise("mixed")
    verdict = F.when(F.col("n_answered") == 0, "no answer").when(F.col("slide").isNull(), "one offset").otherwise(judged)
    return sums.withColumn("slide", slide).select(*keys, "n_answered", "n_near_end", "slide", verdict.alias("verdict"))


QUIET_PCT, ACTIVE_PCT = 0.5, 1.5


def motion_agreement(trace: DataFrame, events: DataFrame, axes: DataFrame, quiet: float = QUIET_PCT, active: float = ACTIVE_PCT) -> DataFrame:
    """video, axis, inside, outside, verdict: whether motion (video, point_id, t, moved_pct) agrees with the labels.

    An absence of motion is still inside and moves outside; other events move inside, and at least as much as outside.
    """
    placed = zones(trace, events, ["video"]).join(trace.select("video", "point_id", "moved_pct"), ["video", "point_id"])
    sums = placed.groupBy("video").agg(
        F.coalesce(F.max(F.when(F.col("zone") == "in", F.col("moved_pct"))), F.lit(0.0)).alias("inside"),
        F.coalesce(F.max(F.when(F.col("zone") == "out", F.col("moved_pct"))), F.lit(0.0)).alias("outside"),
        F.count_if(F.col("zone") == "in").alias("_n"),
    )
    named = sums.join(axes, "video", "left").withColumn("axis", F.coalesce("axis", F.lit("unknown"))).join(events.groupBy("video").agg(F.count(F.lit(1)).alias("_events")), "video", "left")
    has, i, o = F.coalesce("_events", F.lit(0)) > 0, F.col("inside"), F.col("outside")
    verdict = (
        F.when((F.col("_n") == 0) & has & (F.col("axis") != "negative"), "nothing sampled inside")
        .when((F.col("axis") == "absence_of_motion") & (i > quiet), "moves while stopped")
        .when((F.col("axis") == "absence_of_motion") & (o < active), "never moves outside")
        .when(F.col("axis").isin("absence_of_motion", "negative"), "ok")
        .when(~has, "no event labelled")
        .when(i < active, "nothing moves inside")
        .when(i < o, "moves more outside")
        .otherwise("ok")
    )
    return named.select("video", "axis", "inside", "outside", verdict.alias("verdict"))


def probe_sweep(cases: DataFrame, fps: tuple[float, ...], variants: tuple[str, ...]) -> DataFrame:
    """cases at every rate under every prompt variant."""
    return cases.withColumn("fps", F.explode(F.array(*[F.lit(x) for x in fps]))).withColumn("prompt_variant", F.explode(F.array(*[F.lit(x) for x in variants])))


def replay_recovery(parsed: DataFrame, failed_before: Column) -> DataFrame:
    """One row: parsed cleanly, failed before, of these recovered and still failing. parsed: events, error."""
    clean = F.col("error").isNull()
    back = failed_before & clean & (F.size("events") > 0)
    return parsed.agg(F.count_if(clean).alias("parsed"), F.count_if(failed_before).alias("failed_before"), F.count_if(back).alias("recovered"), F.count_if(failed_before & ~back).alias("still_failing"))


def control_spans(clips: DataFrame, margin: float = 0.5) -> DataFrame:
    """clips (duration_s, ...) with start_s, end_s: nearly the whole clip, for clips cut around their activity."""
    start = F.least(F.lit(margin), F.col("duration_s") / 4)
    return clips.withColumn("start_s", rounded(start, 3)).withColumn("end_s", rounded(F.greatest(F.col("start_s") + 0.1, F.col("duration_s") - margin), 3))


def first_of_each(rows: DataFrame, by: str, order: str) -> DataFrame:
    """The first row of each value, such as one clip for each activity."""
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy(by).orderBy(order))).where("_n = 1").drop("_n")


def phrased(activities: DataFrame, phrasing: DataFrame) -> DataFrame:
    """activities (activity) with description: the phrasing, else the name in words; and whether it was mapped."""
    named = activities.join(phrasing.select("activity", F.col("description").alias("_d")), "activity", "left")
    return named.withColumn("description", F.coalesce("_d", F.lower(F.translate("activity", "_-", "  ")))).withColumn("phrasing_mapped", F.col("_d").isNotNull()).drop("_d")


def progress(calls: Column, per_clip: int, per_poll: int, step_s: float) -> tuple[Column, Column]:
    """(clip number from 1, second of its video) that a count of calls has come to."""
    within = calls % per_clip
    return F.floor(calls / per_clip) + 1, F.floor(within / per_poll) * step_s


def averaged_probabilities(asked: DataFrame, keys: list[str]) -> DataFrame:
    """keys, option, p: mean over option orders, NaN where no order gave one."""
    return asked.groupBy(*keys, "option").agg(F.coalesce(F.avg("p"), F.lit(float("nan"))).alias("p"))


def refuse_stubs(runs: DataFrame) -> DataFrame:
    """runs (stub, ...), failing at run time on a stub's: its scores would mean nothing."""
    return runs.withColumn("stub", F.when(~F.col("stub"), F.col("stub")).otherwise(F.raise_error(F.lit("a stub run is not scored")).cast("boolean")))


def clip_problems(clips: DataFrame) -> DataFrame:
    """video, problem of clips (video, axis): a clip listed twice, a clip without an axis."""
    listed = clips.groupBy("video").agg(F.count(F.lit(1)).alias("_n"), F.count_if(F.coalesce(F.trim("axis"), F.lit("")) == "").alias("_blank"))
    found = F.array_compact(F.array(F.when(F.col("_n") > 1, F.lit("duplicate clip")), F.when(F.col("_blank") > 0, F.lit("no axis"))))
    return listed.select("video", F.explode(found).alias("problem"))


def assigned_axis(width: Column | str, axis: Column | str, least_width: int = 640) -> Column:
    """The axis of a clip: small pictures are an axis of their own."""
    return F.when((F.col(width) if isinstance(width, str) else width) < least_width, "low_resolution").otherwise(F.col(axis) if isinstance(axis, str) else axis)


def synthetic_labels(clips: DataFrame, scenes: list[tuple[str, str, float, float]]) -> DataFrame:
    """video, description, axis, start_s, end_s: the scenes' exact truths in every clip (video, scale), its scale multiplying all times."""
    told = F.array(*[F.struct(F.lit(d).alias("description"), F.lit(a).alias("axis"), F.lit(s).alias("s"), F.lit(e).alias("e")) for d, a, s, e in scenes])
    rows = clips.select("video", "scale", F.explode(told).alias("x"))
    return rows.select("video", "x.description", "x.axis", rounded(F.col("x.s") * F.col("scale"), 3).alias("start_s"), rounded(F.col("x.e") * F.col("scale"), 3).alias("end_s"))


def probe_report(observations: DataFrame, errors: DataFrame, by: list[str]) -> DataFrame:
    """by, cases, emit_share, parse_failures, rejected, clamped, mean_latency_s, mean_frames, and the statistics of probe_summary().

    observations: by, n_reported, failed, rejected, clamped, latency_s, frames; one row a case.
    """
    told = observations.groupBy(*by).agg(
        F.count(F.lit(1)).alias("cases"),
        rounded(F.avg((F.col("n_reported") > 0).cast("double")), 4).alias("emit_share"),
        F.count_if("failed").alias("parse_failures"),
        F.sum("rejected").alias("rejected"),
        F.sum("clamped").alias("clamped"),
        rounded(F.avg("latency_s"), 4).alias("mean_latency_s"),
        rounded(F.avg("frames"), 4).alias("mean_frames"),
    )
    return told.join(probe_summary(errors, by), by, "left")


def observed(reconciled: DataFrame, keys: list[str]) -> DataFrame:
    """keys, rejected, clamped: what reconciling did to each case's reported events (reason, clamped)."""
    return reconciled.groupBy(*keys).agg(F.count_if(F.col("reason").isNotNull()).alias("rejected"), F.count_if("clamped").alias("clamped"))


def finding(summary: DataFrame, by: list[str], error: str = "median_error") -> DataFrame:
    """One row, text: the best combination and its error, or that no combination reported anything."""
    best = best_combination(summary, by, error)
    named = F.concat_ws(" ", *[F.concat(F.lit(f"{c}="), F.col(c).cast("string")) for c in by])
    told = F.concat(F.lit("best: "), named, F.lit(" with an error of "), F.format_string("%.2f", F.col(error)), F.lit(" s"))
    return best.select(F.when(F.col(error).isNotNull(), told).otherwise("no combination reported an event").alias("text"))


def first_rows(rows: DataFrame, order: list[str], n: int) -> DataFrame:
    """The first n rows in order, with n_left: how many are cut off (a warning where it is not 0)."""
    left = rows.agg(F.greatest(F.count(F.lit(1)) - n, F.lit(0)).alias("n_left"))
    return rows.orderBy(*order).limit(n).crossJoin(F.broadcast(left))  # one row
