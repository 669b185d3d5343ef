"""find_events: windows asked when, or polls asked what state; and the evaluation of a labelled set."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import Config
from ..errors import BudgetExceeded, InvalidInput, UnprocessableMedia
from ..functions.text import clean, parse_state, subject
from ..operators import grids, merge, metrics, quality, responses, states
from .backends import Backend
from .prompts import with_prompts


def checked_queries(queries: DataFrame, config: Config) -> DataFrame:
    """query: trimmed, blanks dropped. Repeated, too many or too long ones are refused."""
    named = queries.select(F.trim("query").alias("query")).where(F.length("query") > 0)
    n = named.agg(F.count(F.lit(1)).alias("n"), F.max(F.length("query")).alias("m")).first()
    if not n["n"]:
        raise InvalidInput("no query")
    if n["n"] > config.limits.max_queries or n["m"] > config.limits.max_query_chars:
        raise InvalidInput("too many queries, or one too long")
    if quality.duplicates(named, "query").limit(1).count():
        raise InvalidInput("a query is asked twice")
    return named


def media_violations(media: DataFrame, config: Config) -> DataFrame:
    """video, reason of the clips (video, duration_s, and size_bytes where it is known) that a run refuses."""
    d, limits = F.col("duration_s"), config.limits
    size = F.col("size_bytes") if "size_bytes" in media.columns else F.lit(None).cast("long")
    reason = F.when(d.isNull(), "unreadable").when(d < limits.min_duration_s, "too short").when(d > limits.max_duration_s, "too long").when(size > limits.max_bytes, "too large")
    return media.select("video", reason.alias("reason")).where("reason IS NOT NULL")


def media_in_bounds(media: DataFrame, config: Config) -> DataFrame:
    """media, refused if any clip is out of bounds."""
    found = media_violations(media, config).limit(5).collect()
    if found:
        raise UnprocessableMedia(f"clips out of bounds: {[(r['video'], r['reason']) for r in found]}")
    return media


def find_by_windows(media: DataFrame, frames: DataFrame | None, queries: DataFrame, config: Config, backend: Backend, variant: str = "overlay") -> DataFrame:
    """Events of every clip and query: windows x queries, asked, parsed, reconciled, merged.

    frames (video, t): each request carries frame_times, the times of the frames that its window shows, thinned to the config's
    cap; an answer is reconciled with the same frames.
    """
    asked = checked_queries(queries, config)
    w = config.windows
    windows = grids.plan_windows(media_in_bounds(media, config), w.window_s, w.stride_s)
    if windows.count() * asked.count() > config.limits.max_calls:
        raise BudgetExceeded("the plan makes more calls than the limit")
    shown = windows if frames is None else grids.with_frames(windows, frames, media, w.max_frames, w.window_s, w.stride_s)
    carried = ["frame_times"] if frames is not None else []
    requests = with_prompts(grids.expand_requests(shown, asked, variant))
    parsed = responses.parse_responses(backend(requests).select("video", "query", "index", "start_s", "end_s", "raw", *carried))
    rows = parsed.select("video", "query", "index", F.col("start_s").alias("w_start"), F.col("end_s").alias("w_end"), *carried, F.posexplode_outer("events").alias("k", "e")).where(F.col("e").isNotNull())
    rows = rows.select("video", "query", "index", "w_start", "w_end", "k", *carried, F.col("e.start_s").alias("e_start"), F.col("e.end_s").alias("e_end"), "e.confidence", "e.evidence")
    kept = responses.reconcile(rows).where("reason IS NULL")
    cands = kept.select("video", F.col("query").alias("description"), (F.col("index") * 1000 + F.col("k")).cast("long").alias("event_id"), "start_s", "end_s", "confidence", "evidence", F.col("index").alias("window_index"))
    events = merge.merge(cands, ["video", "description"], config.merge.gap_s, config.merge.max_span_s, iou=config.merge.iou)
    return merge.partial_flag(events, media, window_s=w.window_s, stride_s=w.stride_s)


def poll_requests(media: DataFrame, groups: DataFrame, config: Config) -> DataFrame:
    """video, subject, t, span_s: a poll of every group's subject at every time of the grid; a plan over the limit is refused."""
    grid = grids.poll_grid(media, config.states.step_s, config.states.span_s)
    subjects = groups.select("subject").distinct()
    n = grid.count() * subjects.count()
    if n > config.limits.max_calls:
        raise BudgetExceeded(f"the plan makes {n} calls, the limit is {config.limits.max_calls}")
    return grid.crossJoin(F.broadcast(subjects)).withColumn("span_s", F.lit(config.states.span_s))  # at most max_queries subjects


def find_by_states(media: DataFrame, captions: DataFrame | None, queries: DataFrame, states_map: DataFrame, config: Config, backend: Backend | None = None) -> tuple[DataFrame, DataFrame]:
    """(events, declined). captions: video, subject, t, text; without them the backend is asked for them. Queries without a
    state pair are declined, not empty. Descriptions of the same two states share one sweep of polls."""
    caption = None if captions is not None or backend is None else backend.able("caption")
    named = checked_queries(queries, config).withColumnRenamed("query", "description").withColumn("ord", F.monotonically_increasing_id())
    routed = states.route(named, states_map)
    declined = routed.where("state_a IS NULL").select("description")
    groups = states.state_groups(routed).withColumn("subject", subject("state_a"))
    pairs = groups.select("group_key", "state_a", "state_b").collect()  # at most max_queries rows
    media = media_in_bounds(media, config)
    if not pairs:
        raise InvalidInput("no query can be answered by the states map")
    if captions is None:
        if caption is None:
            raise InvalidInput("neither captions nor a backend that makes them")
        captions = caption(poll_requests(media, groups, config))
    said, state = clean("text"), F.lit(None).cast("string")
    for row in pairs:
        state = F.when(F.col("group_key") == row["group_key"], parse_state(said, row["state_a"], row["state_b"])).otherwise(state)
    polls = captions.join(F.broadcast(groups.select("group_key", "subject")), "subject").select("video", "group_key", "t", "text", state.alias("state"))
    wanted = groups.select("group_key", F.explode("descriptions").alias("description")).join(routed.select("description", F.col("state_b").alias("target")), "description")
    keys = ["video", "description", "target"]
    events = states.state_events(polls.join(F.broadcast(wanted), "group_key"), media, keys, F.col("target"), config.states.max_bracket_s, config.states.span_s, config.states.step_s)
    return events.drop("target"), declined


def evaluate(preds: DataFrame, truths: DataFrame, axes: DataFrame, runs: DataFrame | None = None, limit: int | None = None) -> dict[str, DataFrame]:
    """The report's parts. runs (video, stub): the clips that were run; a stub's are not scored, and truths of other clips do not
    count. limit: the first clips in name order. Control clips leave the headline; a set that mixes them with others should be
    told by mixed_controls()."""
    if runs is not None:
        if runs.where("stub").limit(1).count():
            raise InvalidInput("a stub run is not scored")
        planned = first_clips(runs.select("video").distinct(), limit)
        preds, truths, axes = (x.join(planned, "video", "left_semi") for x in (preds, truths, axes))
    p, t = metrics.without_controls(preds, axes), metrics.without_controls(truths, axes)
    return {"overall": metrics.metric_bundle(p, t), "by_axis": metrics.by_axis(p, t, axes), "mixed_controls": metrics.mixed_controls(axes)}


def first_clips(clips: DataFrame, limit: int | None) -> DataFrame:
    """The first clips in name order; all without a limit."""
    return clips if limit is None else clips.orderBy("video").limit(limit)
