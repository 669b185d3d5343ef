"""Registered queries over the test tables, each with the SQL that another engine can answer it with."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .functions import text as X
from .functions.intervals import rounded
from .operators import grids, joins, merge, metrics, quality, responses, signal, states
from .plans import prompts
from .sources import adapters as A

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

#: The adapters in SQL; r3() and r4() round half up in binary arithmetic, as functions.intervals.rounded does.
BASE = """
base AS (SELECT user_id AS video, event_type AS description, event_id, (epoch_us(ts) - 1704067200000000) / 3.6e9 AS h, value, props FROM events),
candidates AS (
  SELECT video, description, event_id, floor(h * 1000 + 0.5) / 1000 AS start_s, floor((h + value * 0.5) * 1000 + 0.5) / 1000 AS end_s,
         (event_id % 101) / 100.0::DOUBLE AS confidence, floor(h / 9)::INT AS window_index, 'event ' || event_id AS evidence FROM base),
preds AS (SELECT * FROM candidates WHERE event_id % 3 <> 0),
truths AS (SELECT * FROM candidates WHERE event_id % 3 = 0 AND description IN ('click', 'view', 'purchase')),
axes AS (SELECT DISTINCT video, ['baseline', 'short', 'long', 'positive_control'][(video % 4)::INT + 1] AS axis FROM base),
media AS (SELECT DISTINCT video, 720.0::DOUBLE AS duration_s FROM base),
frames AS (SELECT video, event_id, floor(h * 1000 + 0.5) / 1000 AS t FROM base),
windows AS (SELECT video, i::INT AS index, (i * 9)::DOUBLE AS start_s, least(i * 9 + 12, 720)::DOUBLE AS end_s FROM media, range(0, 80) r(i)),
polls AS (SELECT video, event_id, floor(h * 1000 + 0.5) / 1000 AS t, description AS text,
         CASE WHEN description IN ('purchase', 'signup') THEN 'open' WHEN description IN ('click', 'view') THEN 'closed' END AS state FROM base)
"""
IOU = "greatest(0, least({p}.end_s, {t}.end_s) - greatest({p}.start_s, {t}.start_s)) / nullif(greatest({p}.end_s, {t}.end_s) - least({p}.start_s, {t}.start_s), 0)"
PT = IOU.format(p="p", t="t")


def r(x: str, digits: int) -> str:
    return f"floor(({x}) * {10**digits} + 0.5) / {10**digits}"


def query(sql: str | None = None, ctes: str = ""):
    """Register a query; sql is its last SELECT, ctes what stands between the adapters and it."""

    def put(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = f"WITH RECURSIVE {BASE}{', ' + ctes if ctes else ''} {sql}"
        return f

    return put


def _merged(order: str, gap: float, cap: float, source: str, keys: str) -> str:
    on = " AND ".join(f"o.{k} = m.{k}" for k in keys.split(", "))
    own = ", ".join(f"o.{k}" for k in keys.split(", "))
    join = f"(o.start_s - m.hi <= {gap} AND greatest(m.hi, o.end_s) - m.lo <= {cap})"
    return f"""o AS (SELECT *, row_number() OVER (PARTITION BY {keys} ORDER BY start_s, end_s, {order}) AS rn FROM {source}),
m AS (SELECT {keys}, rn, start_s AS lo, end_s AS hi, 1 AS g FROM o WHERE rn = 1
  UNION ALL SELECT {own}, o.rn, CASE WHEN {join} THEN m.lo ELSE o.start_s END, CASE WHEN {join} THEN greatest(m.hi, o.end_s) ELSE o.end_s END,
         CASE WHEN {join} THEN m.g ELSE m.g + 1 END FROM m JOIN o ON {on} AND o.rn = m.rn + 1)"""


# Merging.


@query(
    f"""SELECT video, description, start_s, end_s, confidence, evidence, source_windows, n_merged,
       CASE WHEN start_s <= 0.25 OR end_s >= 719.75 THEN true WHEN n_windows > 1 THEN false
            ELSE EXISTS (SELECT 1 FROM edges WHERE abs(g.start_s - edge) < 0.25 OR abs(g.end_s - edge) < 0.25) END AS partial
FROM g""",
    _merged("event_id", 0.5, 60, "candidates", "video, description")
    + f""", g AS (SELECT o.video, o.description, min(start_s) AS start_s, max(end_s) AS end_s,
         {r('0.97::DOUBLE * (1 - product(1 - least(greatest(confidence, 0), 1)))', 4)} AS confidence,
         arg_max(evidence, confidence * 1e9 - o.rn) AS evidence, array_to_string(list_sort(list_distinct(list(window_index))), ',') AS source_windows,
         count(DISTINCT window_index) AS n_windows, count(*) AS n_merged
       FROM m JOIN o ON o.video = m.video AND o.description = m.description AND o.rn = m.rn GROUP BY o.video, o.description, g),
edges AS (SELECT DISTINCT unnest([start_s, end_s]) AS edge FROM windows)""",
)
def interval_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flagship: candidates merged under a gap and a span cap, scored, and flagged where only partly seen."""
    media = A.media(spark, sf_dir)
    events = merge.merge(A.candidates(spark, sf_dir), ["video", "description"])
    flagged = merge.partial_flag(events, media)
    return flagged.withColumn("source_windows", F.array_join(F.col("source_windows").cast("array<string>"), ","))


@query(
    "SELECT video, description, island, count(*) AS n, min(start_s) AS start_s, max(end_s) AS end_s FROM i GROUP BY video, description, island",
    """b AS (SELECT *, max(end_s) OVER (PARTITION BY video, description ORDER BY start_s, end_s, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS hi FROM candidates),
i AS (SELECT *, sum(CASE WHEN start_s > hi + 0.5 THEN 1 ELSE 0 END) OVER (PARTITION BY video, description ORDER BY start_s, end_s, event_id)::BIGINT AS island FROM b)""",
)
def interval_islands(spark: SparkSession, sf_dir: str) -> DataFrame:
    runs = merge.islands(A.candidates(spark, sf_dir), ["video", "description"])
    return runs.groupBy("video", "description", "island").agg(F.count(F.lit(1)).alias("n"), F.min("start_s").alias("start_s"), F.max("end_s").alias("end_s"))


@query(
    "SELECT o.video, min(start_s) AS start_s, max(end_s) AS end_s, count(*) AS n_merged FROM m JOIN o ON o.video = m.video AND o.rn = m.rn GROUP BY o.video, g",
    """q AS (SELECT l_orderkey, sum(l_quantity) AS q FROM lineitem GROUP BY l_orderkey),
oi AS (SELECT o_custkey AS video, o_orderkey AS order_id, date_diff('day', DATE '1995-01-01', o_orderdate::DATE)::DOUBLE AS start_s,
       date_diff('day', DATE '1995-01-01', o_orderdate::DATE)::DOUBLE + q AS end_s FROM orders JOIN q ON o_orderkey = l_orderkey), """
    + _merged("order_id", 30, 365, "oi", "video"),
)
def order_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The capped merge at bench scale: order spans by customer, gap 30 days, cap 365."""
    groups = merge.merge_groups(A.order_intervals(spark, sf_dir), ["video"], 30.0, 365.0, "order_id")
    return groups.groupBy("video", "grp").agg(F.min("start_s").alias("start_s"), F.max("end_s").alias("end_s"), F.count(F.lit(1)).alias("n_merged")).drop("grp")


# Grids.


@query("SELECT video, index, start_s, end_s FROM windows")
def plan_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grids.plan_windows(A.media(spark, sf_dir))


@query("SELECT DISTINCT video, unnest([start_s, end_s]) AS edge FROM windows")
def window_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grids.planned_edges(A.media(spark, sf_dir))


@query("SELECT video, 1440 AS frames, 80 AS windows, 13 AS queries, 1040 AS model_calls FROM media")
def plan_cost(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grids.plan_cost(A.media(spark, sf_dir), 13, 2.0)


@query(
    "SELECT video, model_calls FROM (SELECT video, (1 + greatest(0, ceil((d - 12) / 9)))::INT * 13 AS model_calls FROM ends) WHERE model_calls > 1000",
    "ends AS (SELECT video, max(end_s) AS d FROM candidates GROUP BY video)",
)
def over_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    media = A.candidates(spark, sf_dir).groupBy("video").agg(F.max("end_s").alias("duration_s"))
    return grids.over_budget(grids.plan_cost(media, 13, 2.0), 1000).select("video", "model_calls")


@query("SELECT video, i::DOUBLE AS t FROM media, range(0, 719) r(i)")
def poll_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grids.poll_grid(A.media(spark, sf_dir))


@query("SELECT video, event_id, t FROM (SELECT *, row_number() OVER (PARTITION BY video, floor((t + 1e-6) / 6) ORDER BY t) AS n FROM frames) WHERE n = 1")
def downsample_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grids.downsample(A.frames(spark, sf_dir), 6.0)


@query(
    """SELECT video, index, event_id, t FROM n WHERE n <= 3 OR r IN (SELECT least(floor(i * (n / 3.0::DOUBLE)), n - 1) FROM range(0, 3) x(i))""",
    """j AS (SELECT w.video, w.index, f.event_id, f.t FROM windows w JOIN frames f ON f.video = w.video AND f.t >= w.start_s - 1e-6 AND f.t <= w.end_s + 1e-6),
n AS (SELECT *, row_number() OVER (PARTITION BY video, index ORDER BY t) - 1 AS r, count(*) OVER (PARTITION BY video, index) AS n FROM j)""",
)
def assign_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grids.assign_frames(A.frames(spark, sf_dir), A.media(spark, sf_dir), 3).select("video", "index", "event_id", "t")


@query("SELECT video, index, query FROM windows, (SELECT DISTINCT description AS query FROM truths)")
def expand_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked = A.truths(spark, sf_dir).select(F.col("description").alias("query")).distinct()
    return grids.expand_requests(grids.plan_windows(A.media(spark, sf_dir)), asked, "overlay").select("video", "index", "query")


@query("SELECT video, description FROM (SELECT DISTINCT video FROM (SELECT DISTINCT video FROM base ORDER BY video LIMIT 20)), (SELECT DISTINCT description FROM truths)")
def eval_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every description asked of the first clips in name order; the limit narrows clips, not descriptions."""
    clips = A.media(spark, sf_dir).select("video").orderBy("video").limit(20)
    return clips.crossJoin(joins.short_list(A.truths(spark, sf_dir).select("description").distinct()))


@query(f"SELECT event_id, o AS offset_s, start_s >= start_s - o AND end_s <= start_s - o + 12 AS contains, {r('(start_s - (start_s - o)) / 12', 4)} AS position FROM truths, (SELECT unnest([0.5, 3.0, 6.0, 9.0]::DOUBLE[]) AS o)")
def offset_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.offset_sweep(A.truths(spark, sf_dir), (0.5, 3.0, 6.0, 9.0), 12.0)


# Metrics.

MATCHED = f"""best AS (SELECT t.video, t.description, t.event_id AS t_id, t.start_s AS ts, t.end_s AS te, p.start_s AS ps, p.end_s AS pe, coalesce({PT}, 0) AS iou,
         row_number() OVER (PARTITION BY t.event_id ORDER BY coalesce({PT}, 0) DESC, p.start_s, p.end_s, p.event_id) AS n
  FROM truths t LEFT JOIN preds p ON p.video = t.video AND p.description = t.description),
matched AS (SELECT * FROM best WHERE n = 1)"""
ERROR = "CASE WHEN iou > 0 THEN (abs(ps - ts) + abs(pe - te)) / (2 * greatest(1e-6, te - ts)) END"
TOP = f"""tops AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY video, description ORDER BY confidence DESC, start_s, end_s, event_id) AS n FROM preds) WHERE n = 1),
firsts AS (SELECT t.video, t.description, coalesce({PT}, -1) AS iou FROM truths t LEFT JOIN tops p ON p.video = t.video AND p.description = t.description)"""


def _greedy(keys: str, preds: str = "preds", truths: str = "truths") -> str:
    own = ", ".join(f"p.{k}" for k in keys.split(", "))
    on = " AND ".join(f"{{0}}.{k} = {{1}}.{k}" for k in keys.split(", "))
    return f"""gp AS (SELECT *, row_number() OVER (PARTITION BY {keys} ORDER BY confidence DESC, start_s, end_s, event_id) AS k FROM {preds}),
gt AS (SELECT {keys}, list(struct_pack(s := start_s, e := end_s) ORDER BY start_s, end_s, event_id) AS ts FROM {truths} GROUP BY {keys}),
greedy AS (SELECT {', '.join('gt.' + k for k in keys.split(', '))}, ts, 0::BIGINT AS k, []::BIGINT[] AS used FROM gt
  UNION ALL SELECT {own}, x.ts, p.k, CASE WHEN x.best.iou >= 0.5 THEN list_append(x.used, x.best.j) ELSE x.used END
  FROM (SELECT g.*, list_reduce(list_prepend(struct_pack(iou := 0.0::DOUBLE, j := -1::BIGINT), list_transform(range(1, len(g.ts) + 1), lambda j: struct_pack(iou := CASE WHEN list_contains(g.used, j) THEN -1.0::DOUBLE ELSE
        greatest(0.0::DOUBLE, least(n.end_s, g.ts[j].e) - greatest(n.start_s, g.ts[j].s)) / nullif(greatest(n.end_s, g.ts[j].e) - least(n.start_s, g.ts[j].s), 0) END, j := j))),
        lambda a, b: CASE WHEN b.iou > a.iou THEN b ELSE a END) AS best FROM greedy g JOIN gp n ON {on.format('n', 'g')} AND n.k = g.k + 1) x
  JOIN gp p ON {on.format('p', 'x')} AND p.k = x.k + 1),
tps AS (SELECT {keys}, max(len(used))::BIGINT AS tp FROM greedy GROUP BY {keys})"""


@query(f"SELECT coalesce({r('avg(iou)', 4)}, 0) AS mean_tiou FROM matched", MATCHED)
def mean_best_iou(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.mean_best_iou(A.preds(spark, sf_dir), A.truths(spark, sf_dir))


@query(f"SELECT {r(f'avg({ERROR})', 4)} AS mean_relative_error FROM matched", MATCHED)
def mean_relative_error(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.mean_relative_error(A.preds(spark, sf_dir), A.truths(spark, sf_dir))


@query(f"SELECT h AS threshold, {r('avg((iou >= h)::INT)', 4)} AS recall FROM firsts, (SELECT unnest([0.3, 0.5, 0.7]::DOUBLE[]) AS h) GROUP BY h", TOP)
def recall_at_1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.recall_at_1(A.preds(spark, sf_dir), A.truths(spark, sf_dir))


@query(f"SELECT sum(tp)::BIGINT AS tp, {r('sum(tp) / (SELECT count(*) FROM preds)', 4)} AS precision, {r('sum(tp) / (SELECT count(*) FROM truths)', 4)} AS recall FROM tps", _greedy("video, description"))
def detection_pr(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.detection_pr(A.preds(spark, sf_dir), A.truths(spark, sf_dir))


@query(f"SELECT {r('avg((NOT EXISTS (SELECT 1 FROM truths t WHERE t.video = p.video AND t.description = p.description))::INT)', 4)} AS false_positive_rate FROM preds p")
def false_positive_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.false_positive_rate(A.preds(spark, sf_dir), A.truths(spark, sf_dir))


_BUNDLE = f"""SELECT {{by}} n_predictions, n_truths, mean_tiou, {r('tp / nullif(n_predictions, 0)', 4)} AS precision_5, {r('tp / n_truths', 4)} AS recall_5,
  {r('spurious / nullif(n_predictions, 0)', 4)} AS false_positive_rate, mean_relative_error, r_at_1_3, r_at_1_5, r_at_1_7"""


@query(
    f"""SELECT (SELECT count(*) FROM preds) AS n_predictions, (SELECT count(*) FROM truths) AS n_truths, (SELECT {r('avg(iou)', 4)} FROM matched) AS mean_tiou,
  (SELECT {r('sum(tp) / (SELECT count(*) FROM preds)', 4)} FROM tps) AS precision_5, (SELECT {r('sum(tp) / (SELECT count(*) FROM truths)', 4)} FROM tps) AS recall_5,
  (SELECT {r('avg((NOT EXISTS (SELECT 1 FROM truths t WHERE t.video = p.video AND t.description = p.description))::INT)', 4)} FROM preds p) AS false_positive_rate,
  (SELECT {r(f'avg({ERROR})', 4)} FROM matched) AS mean_relative_error,
  (SELECT {r('avg((iou >= 0.3)::INT)', 4)} FROM firsts) AS r_at_1_3, (SELECT {r('avg((iou >= 0.5)::INT)', 4)} FROM firsts) AS r_at_1_5, (SELECT {r('avg((iou >= 0.7)::INT)', 4)} FROM firsts) AS r_at_1_7""",
    f"{MATCHED}, {TOP}, {_greedy('video, description')}",
)
def metric_bundle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.metric_bundle(A.preds(spark, sf_dir), A.truths(spark, sf_dir))


@query(
    f"""SELECT axis, n_predictions, n_truths, mean_tiou, {r('tp / n_predictions', 4)} AS precision_5, {r('tp / n_truths', 4)} AS recall_5,
  {r('spurious / n_predictions', 4)} AS false_positive_rate, mean_relative_error, r_at_1_3, r_at_1_5, r_at_1_7
FROM (SELECT axis, count(*) AS n_truths, {r('avg(iou)', 4)} AS mean_tiou, {r(f'avg({ERROR})', 4)} AS mean_relative_error FROM matched JOIN axes USING (video) GROUP BY axis)
JOIN (SELECT axis, {r('avg((iou >= 0.3)::INT)', 4)} AS r_at_1_3, {r('avg((iou >= 0.5)::INT)', 4)} AS r_at_1_5, {r('avg((iou >= 0.7)::INT)', 4)} AS r_at_1_7 FROM firsts JOIN axes USING (video) GROUP BY axis) USING (axis)
JOIN (SELECT axis, sum(tp) AS tp FROM tps JOIN axes USING (video) GROUP BY axis) USING (axis)
JOIN (SELECT axis, count(*) AS n_predictions, count(*) FILTER (NOT EXISTS (SELECT 1 FROM truths t WHERE t.video = p.video AND t.description = p.description)) AS spurious
      FROM preds p JOIN axes USING (video) WHERE video IN (SELECT video FROM truths) GROUP BY axis) USING (axis)""",
    f"{MATCHED}, {TOP}, {_greedy('video, description')}",
)
def metrics_by_axis(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.by_axis(A.preds(spark, sf_dir), A.truths(spark, sf_dir), A.axes(spark, sf_dir))


@query("SELECT video, count(*) AS n FROM preds WHERE video NOT IN (SELECT video FROM axes WHERE axis = 'positive_control') GROUP BY video")
def control_exclusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.without_controls(A.preds(spark, sf_dir), A.axes(spark, sf_dir)).groupBy("video").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT count(*) FILTER (axis = 'positive_control') AS n_control, count(*) FILTER (axis <> 'positive_control') AS n_ordinary FROM axes")
def mixed_controls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.mixed_controls(A.axes(spark, sf_dir))


def _states_map(spark: SparkSession) -> DataFrame:
    return spark.sql("SELECT * FROM VALUES (1, 'click', 'door is closed', 'door is open'), (2, 'view', 'door is open', 'door is closed'), (3, 'signup', 'gate is shut', 'gate is up') AS t(ord, description, state_a, state_b)")


MAP = "states_map(ord, description, state_a, state_b) AS (VALUES (1, 'click', 'door is closed', 'door is open'), (2, 'view', 'door is open', 'door is closed'), (3, 'signup', 'gate is shut', 'gate is up'))"


@query("SELECT count(DISTINCT description) AS descriptions, count(DISTINCT description) FILTER (description IN (SELECT description FROM states_map)) AS descriptions_routed, count(*) AS events, count(*) FILTER (description IN (SELECT description FROM states_map)) AS events_routed FROM truths", MAP)
def routing_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.routing_coverage(A.truths(spark, sf_dir), _states_map(spark))


@query("SELECT DISTINCT description FROM truths WHERE description NOT IN (SELECT description FROM states_map)", MAP)
def declined_descriptions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.declined(A.truths(spark, sf_dir), _states_map(spark))


@query(
    "SELECT least(state_a, state_b) || '|' || greatest(state_a, state_b) AS group_key, arg_min(state_a, ord) AS state_a, arg_min(state_b, ord) AS state_b, array_to_string(list_sort(list(DISTINCT description)), ',') AS descriptions FROM asked JOIN states_map USING (description) GROUP BY 1",
    f"{MAP}, asked AS (SELECT DISTINCT description FROM base)",
)
def state_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked = A.candidates(spark, sf_dir).select("description").distinct()
    return states.state_groups(states.route(asked, _states_map(spark))).withColumn("descriptions", F.array_join("descriptions", ","))


@query(
    f"SELECT level, n_predictions, coalesce(tp, 0) AS tp, {r('coalesce(tp, 0) / n_predictions', 4)} AS precision FROM (SELECT level, count(*) AS n_predictions FROM kept GROUP BY level) LEFT JOIN (SELECT level, sum(tp)::BIGINT AS tp FROM tps GROUP BY level) USING (level)",
    "levels AS (SELECT unnest([0.0, 0.6, 0.8, 0.9]::DOUBLE[]) AS level), kept AS (SELECT * FROM preds, levels WHERE confidence >= level), wanted AS (SELECT * FROM truths, levels), "
    + _greedy("level, video, description", "kept", "wanted"),
)
def threshold_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.threshold_sweep(A.preds(spark, sf_dir), A.truths(spark, sf_dir))


@query(f"SELECT {r('sum(e) / (sum(d) / 60)', 2)} AS wall_s_per_video_min, {r('sum(e) / (sum(d) / 60) / 3600 * 1.2::DOUBLE', 4)} AS usd_per_video_min FROM v", "v AS (SELECT video, 720.0::DOUBLE AS d, count(*) * 4.0::DOUBLE AS e FROM base GROUP BY video)")
def run_cost(spark: SparkSession, sf_dir: str) -> DataFrame:
    per_video = A.candidates(spark, sf_dir).groupBy("video").agg((F.count(F.lit(1)) * 4.0).alias("elapsed_s")).withColumn("duration_s", F.lit(A.DURATION))
    return metrics.run_cost(per_video, 1.2)


@query("SELECT video, count(*) AS events, count(DISTINCT description) AS descriptions, max(end_s) AS last_s FROM preds GROUP BY video")
def per_video_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.preds(spark, sf_dir).groupBy("video").agg(F.count(F.lit(1)).alias("events"), F.countDistinct("description").alias("descriptions"), F.max("end_s").alias("last_s"))


# State timelines.

CHANGES = f"""known AS (SELECT video, t, text, state, lag(state) OVER w AS ps, lag(t) OVER w AS pt FROM polls WHERE state IS NOT NULL WINDOW w AS (PARTITION BY video ORDER BY t)),
changes AS (SELECT video, {r('(pt + t) / 2', 3)} AS "at", ps AS from_state, state AS to_state, pt AS lo, t AS hi FROM known WHERE ps <> state)"""
SPANS = f"""{CHANGES},
bounds AS (SELECT video, arg_min(state, t) AS first, arg_max(state, t) AS last FROM polls WHERE state IS NOT NULL GROUP BY video),
paired AS (SELECT *, lead("at") OVER w AS oat, lead(lo) OVER w AS olo, lead(hi) OVER w AS ohi FROM changes WINDOW w AS (PARTITION BY video ORDER BY hi)),
opened AS (SELECT video, CASE WHEN hi - lo <= 4 THEN "at" ELSE {r('hi', 3)} END AS start_s, hi - lo > 4 AS p, CASE WHEN hi - lo > 4 THEN 0 ELSE hi - lo END AS w, oat, olo, ohi FROM paired WHERE to_state = 'open'
  UNION ALL SELECT b.video, 0.0, true, 0.0, c."at", c.lo, c.hi FROM bounds b LEFT JOIN (SELECT *, row_number() OVER (PARTITION BY video ORDER BY hi) AS n FROM changes) c ON c.video = b.video AND c.n = 1 WHERE b.first = 'open'),
spans AS (SELECT video, start_s, CASE WHEN ohi IS NULL THEN 720.0::DOUBLE WHEN ohi - olo <= 4 THEN oat ELSE {r('olo + 2', 3)} END AS end_s,
  CASE WHEN ohi IS NULL THEN true ELSE p OR ohi - olo > 4 END AS partial, CASE WHEN ohi IS NULL THEN w ELSE greatest(w, CASE WHEN ohi - olo > 4 THEN 0 ELSE ohi - olo END) END AS widest FROM opened)"""


@query("SELECT video, \"at\", from_state, to_state, lo, hi FROM changes", CHANGES)
def state_transitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return states.transitions(A.polls(spark, sf_dir), ["video"])


@query("SELECT video, arg_min(state, t) AS first, arg_max(state, t) AS last, arg_min(state, t) = 'open' AS partial_before, arg_max(state, t) = 'open' AS partial_after FROM polls WHERE state IS NOT NULL GROUP BY video")
def state_boundaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return states.boundaries(A.polls(spark, sf_dir), ["video"], "open")


@query("SELECT video, start_s, end_s, partial, widest FROM spans", SPANS)
def state_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return states.state_spans(A.polls(spark, sf_dir), A.media(spark, sf_dir), ["video"], "open").drop("duration_s")


@query(
    f"""SELECT video, {r('start_s', 3)} AS start_s, {r('least(end_s, 720)', 3)} AS end_s, {r('agree * sharp * cover', 4)} AS confidence, evidence, partial OR end_s >= 720 - 1e-6 AS partial, {r('agree', 4)} AS agreement, cover AS coverage FROM (
  SELECT s.video, s.start_s, s.end_s, s.partial, CASE WHEN n > 0 THEN k / n ELSE 0 END AS agree, CASE WHEN widest > 0 THEN 1 / greatest(1.0::DOUBLE, widest) ELSE 1.0::DOUBLE END AS sharp,
    CASE WHEN s.end_s - s.start_s <= 0 THEN 1.0::DOUBLE ELSE least(1.0::DOUBLE, {r('coalesce(seen, 0) / (s.end_s - s.start_s)', 4)}) END AS cover, coalesce(evidence, '') AS evidence
  FROM spans s LEFT JOIN (
    SELECT video, start_s, end_s, count(*) AS n, count(*) FILTER (state = 'open') AS k, arg_min(text, t) FILTER (state = 'open') AS evidence,
      sum(greatest(0, up - greatest(t, coalesce(hi, start_s), start_s))) FILTER (state = 'open') AS seen
    FROM (SELECT s.video, s.start_s, s.end_s, p.t, p.text, p.state, least(p.t + 2, s.end_s) AS up,
        max(CASE WHEN p.state = 'open' THEN least(p.t + 2, s.end_s) END) OVER (PARTITION BY s.video, s.start_s, s.end_s ORDER BY p.t ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS hi
      FROM spans s JOIN polls p ON p.video = s.video AND p.t >= s.start_s AND p.t <= s.end_s WHERE p.state IS NOT NULL)
    GROUP BY video, start_s, end_s) q ON q.video = s.video AND q.start_s = s.start_s AND q.end_s = s.end_s)""",
    SPANS,
)
def state_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """State intervals with agreement, coverage and confidence."""
    return states.state_events(A.polls(spark, sf_dir), A.media(spark, sf_dir), ["video"], "open")


# Signals.

SIGNAL = f"""px AS (SELECT vec_id // 50 AS video, (vec_id % 50)::DOUBLE AS t, embedding AS arr, lag(embedding) OVER (PARTITION BY vec_id // 50 ORDER BY vec_id) AS old FROM embeddings),
sig AS (SELECT video, t, {r("len(list_filter(range(1, len(arr) + 1), lambda i: abs(arr[i] - old[i]) > 0.25)) / len(arr) * 100", 4)} AS moved_pct FROM px WHERE old IS NOT NULL)"""


def _signal(spark: SparkSession, sf_dir: str) -> DataFrame:
    return signal.change_signal(A.pixels(spark, sf_dir), 0.25)


@query("SELECT video, t, moved_pct FROM sig", SIGNAL)
def change_signal(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _signal(spark, sf_dir)


@query(
    "SELECT video, unnest(picks) AS t FROM nms WHERE k = (SELECT count(*) FROM ranked r WHERE r.video = nms.video)",
    SIGNAL
    + """, ranked AS (SELECT video, t, row_number() OVER (PARTITION BY video ORDER BY moved_pct DESC, t) AS k FROM sig),
nms AS (SELECT DISTINCT video, 0::BIGINT AS k, []::DOUBLE[] AS picks FROM sig
  UNION ALL SELECT r.video, r.k, CASE WHEN len(picks) >= 4 OR len(list_filter(picks, lambda p: abs(p - r.t) < 2)) > 0 THEN picks ELSE list_append(picks, r.t) END FROM nms JOIN ranked r ON r.video = nms.video AND r.k = nms.k + 1)""",
)
def change_peaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return signal.peaks(_signal(spark, sf_dir), 4)


@query(f"SELECT video, max(moved_pct) AS peak, {r('avg(moved_pct)', 4)} AS mean, {r('avg((moved_pct > 18)::INT)', 4)} AS active_share, CASE WHEN {r('avg(moved_pct)', 4)} < 0.5 THEN 'static' WHEN {r('avg(moved_pct)', 4)} > 1.5 THEN 'active' ELSE 'faint' END AS verdict FROM sig GROUP BY video", SIGNAL)
def clip_activity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return signal.clip_activity(_signal(spark, sf_dir), 18.0).withColumn("verdict", X.motion_verdict("mean"))


@query("SELECT description, list_sort(list(confidence))[(len(list(confidence)) // 2 + 1)::INT] AS median FROM preds GROUP BY description")
def upper_median(spark: SparkSession, sf_dir: str) -> DataFrame:
    return signal.upper_median(A.preds(spark, sf_dir), "confidence", ["description"])


@query(
    "SELECT video, min(t) AS start_s, max(coalesce(nxt, t + 1)) AS end_s, count(*) AS n FROM runs WHERE up GROUP BY video, run HAVING max(coalesce(nxt, t + 1)) - min(t) >= 2",
    SIGNAL
    + """, marked AS (SELECT *, moved_pct >= 17 AS up, lead(t) OVER (PARTITION BY video ORDER BY t) AS nxt, lag(moved_pct >= 17) OVER (PARTITION BY video ORDER BY t) AS was FROM sig),
runs AS (SELECT *, sum((up AND NOT coalesce(was, false))::INT) OVER (PARTITION BY video ORDER BY t) AS run FROM marked)""",
)
def threshold_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return states.threshold_runs(_signal(spark, sf_dir).withColumnRenamed("moved_pct", "p"), ["video"], 17.0, 2.0, 1.0)


@query("SELECT video, arg_min(t, (-moved_pct, t)) AS t, max(moved_pct) AS peak, max(moved_pct) - min(moved_pct) AS spread FROM sig GROUP BY video", SIGNAL)
def peak_of_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    return signal.peak_of_series(_signal(spark, sf_dir), ["video"])


# Text.

_TEXTS = ", ".join("'" + t.replace("'", "''").replace("\n", "' || chr(10) || '") + "'" for t in A.CAPTIONS)
CAPS = f"captions AS (SELECT event_id, video, [{_TEXTS}][(event_id % 7)::INT + 1] AS text FROM base)"
_CLEANED = f"""cleaned AS (SELECT event_id, video, text, trim(regexp_replace(trim(string_split(text, '</think>')[-1], ' \t\r' || chr(10)), '(?i)^(?:\\s*(?:{X.OPENERS.replace("'", "''")})\\b[^.]*[.:]\\s*)+', ''), ' ' || chr(10)) AS clean FROM captions)"""


@query("SELECT event_id, clean FROM cleaned", f"{CAPS}, {_CLEANED}")
def clean_captions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.captions(spark, sf_dir).select("event_id", X.clean("text").alias("clean"))


def _last(text: str, word: str) -> str:
    return f"(CASE WHEN contains({text}, '{word}') THEN length({text}) - strpos(reverse({text}), '{word[::-1]}') - {len(word)} + 2 ELSE 0 END)"


@query(
    f"SELECT event_id, CASE WHEN {_last('low', 'closed')} = 0 AND {_last('low', 'open')} = 0 THEN NULL WHEN {_last('low', 'closed')} > {_last('low', 'open')} THEN 'the door is closed' ELSE 'the door is open' END AS state FROM (SELECT event_id, regexp_replace(lower(clean), '[a-z]+\\s*/\\s*[a-z]+', ' ', 'g') AS low FROM cleaned)",
    f"{CAPS}, {_CLEANED}",
)
def parse_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.captions(spark, sf_dir).select("event_id", X.parse_state(X.clean("text"), "the door is closed", "the door is open").alias("state"))


@query(f"SELECT doc_id, CASE WHEN {_last('t', 'and')} = 0 AND {_last('t', 'the')} = 0 THEN NULL WHEN {_last('t', 'and')} > {_last('t', 'the')} THEN 'and' ELSE 'the' END AS state FROM (SELECT doc_id, lower(text) AS t FROM documents)")
def text_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Last-mention parsing at volume: which of two words a document names last."""
    low = F.lower("text")
    a, b = X.last_mention(low, ["and"]), X.last_mention(low, ["the"])
    return A.table(spark, sf_dir, "documents").select("doc_id", F.when((a == 0) & (b == 0), F.lit(None)).when(a > b, "and").otherwise("the").alias("state"))


@query("SELECT event_id, CASE WHEN event_id % 7 = 6 THEN 'car door: the car door is open' WHEN position(':' IN text) > 0 AND contains(lower(split_part(text, ':', 1)), 'car door') THEN text ELSE '' END AS car_door, CASE WHEN event_id % 7 = 6 THEN 'building door: closed' ELSE '' END AS building_door FROM captions", CAPS)
def split_by_subject(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = X.split_by_subject("text", ["car door", "building door"])
    return A.captions(spark, sf_dir).select("event_id", parts.alias("m")).select("event_id", F.col("m")["car door"].alias("car_door"), F.col("m")["building door"].alias("building_door"))


# Responses.

_SHAPES = ", ".join("'" + t.replace("'", "''").replace("\n", "' || chr(10) || '") + "'" for t in A.RESPONSES)
RAW = f"""raws AS (SELECT event_id, video, floor(h * 1000 + 0.5) / 1000 AS s, floor((h + value * 0.5) * 1000 + 0.5) / 1000 AS e, [{_SHAPES}][(event_id % 10)::INT + 1] AS shape FROM base),
raw_responses AS (SELECT event_id, video, s, e, s - 1 AS w_start, e + 1 AS w_end, replace(replace(shape, '%s', printf('%.3f', s)), '%e', printf('%.3f', e)) AS raw FROM raws)"""


@query("SELECT event_id, CASE WHEN event_id % 10 = 9 THEN raw WHEN event_id % 10 = 0 THEN '<think>Something moves.</think>' ELSE '' END AS reasoning, CASE event_id % 10 WHEN 9 THEN '' WHEN 0 THEN replace(raw, '<think>Something moves.</think>', '') ELSE raw END AS answer FROM raw_responses", RAW)
def split_reasoning(spark: SparkSession, sf_dir: str) -> DataFrame:
    reasoning, answer = X.split_reasoning("raw")
    return A.raw_responses(spark, sf_dir).select("event_id", reasoning.alias("reasoning"), answer.alias("answer"))


PARSED = """parsed AS (SELECT event_id, video, w_start, w_end, list_extract([0.9, 0.8, 0.7, 0.6, 0, 0.5, 0, 1.0, 0.5, 0]::DOUBLE[], (event_id % 10)::INT + 1) AS confidence,
  CASE WHEN event_id % 10 IN (0, 1, 2, 3, 5, 8) THEN s WHEN event_id % 10 = 7 THEN 9999.0::DOUBLE END AS e_start, CASE WHEN event_id % 10 IN (0, 1, 2, 3, 5, 8) THEN e WHEN event_id % 10 = 7 THEN 10001.0::DOUBLE END AS e_end,
  CASE event_id % 10 WHEN 6 THEN 'no parseable JSON in response' WHEN 9 THEN 'empty response (possibly truncated during reasoning)' END AS error FROM raw_responses)"""


@query("SELECT event_id, (e_start IS NOT NULL)::INT AS n, e_start, e_end, CASE WHEN e_start IS NOT NULL THEN confidence END AS confidence, error FROM parsed", f"{RAW}, {PARSED}")
def parse_responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events of every response shape: plain, fenced, in prose, cut off, with units, refused."""
    parsed = responses.parse_responses(A.raw_responses(spark, sf_dir))
    first = F.get("events", 0)
    return parsed.select("event_id", F.size("events").alias("n"), first["start_s"].alias("e_start"), first["end_s"].alias("e_end"), first["confidence"].alias("confidence"), "error")


@query(
    f"""SELECT event_id, reason, reason IS NULL AND (e_start < w_start - 1e-6 OR e_end > w_end + 1e-6) AS clamped, CASE WHEN reason IS NULL THEN {r('greatest(w_start, least(e_start, w_end))', 3)} END AS start_s, CASE WHEN reason IS NULL THEN {r('greatest(w_start, least(e_end, w_end))', 3)} END AS end_s
FROM (SELECT *, CASE WHEN e_end - e_start < 1e-3 THEN 'zero_length' WHEN (e_end - e_start) / greatest(1e-6, w_end - w_start) >= 0.95 THEN 'whole_window' WHEN e_start > w_end + 1 OR e_end < w_start - 1 THEN 'out_of_window'
  WHEN NOT e_start BETWEEN w_start AND w_end AND NOT EXISTS (SELECT 1 FROM frames f WHERE f.video = x.video AND abs(f.t - e_start) <= 0.5) THEN 'no_frame' END AS reason
  FROM (SELECT video, event_id, e_start, e_end, w_start + 1.25 * (event_id % 3) AS w_start, w_end FROM parsed WHERE e_start IS NOT NULL) x)""",
    f"{RAW}, {PARSED}",
)
def reconcile_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reported times against their windows, some moved so that starts fall outside, and the frames shown."""
    parsed = responses.events_of(responses.parse_responses(A.raw_responses(spark, sf_dir))).select("video", "event_id", (F.col("start_s") + 1.25 * (F.col("event_id") % 3)).alias("w_start"), F.col("end_s").alias("w_end"), "e")
    rows = parsed.select("video", "event_id", "w_start", "w_end", F.col("e.start_s").alias("e_start"), F.col("e.end_s").alias("e_end"))
    return responses.reconcile(rows, A.frames(spark, sf_dir)).select("event_id", "reason", "clamped", "start_s", "end_s")


# Joins.

ACTORS = """bx AS (SELECT l_suppkey AS clip, date_diff('day', DATE '1992-01-01', l_shipdate::DATE) AS frame, l_quantity * 16 AS height FROM lineitem),
act AS (SELECT o_orderkey AS activity_id, clip, date_diff('day', DATE '1992-01-01', o_orderdate::DATE) AS f0, o_orderpriority AS activity
  FROM orders JOIN (SELECT l_orderkey, min(l_suppkey) AS clip FROM lineitem WHERE l_linenumber = 1 GROUP BY l_orderkey) ON o_orderkey = l_orderkey),
screened AS (SELECT activity_id, act.clip, activity, median(height) AS median_height, max(height) AS max_height, count(*) AS n FROM act JOIN bx ON bx.clip = act.clip AND frame BETWEEN f0 AND f0 + 30 GROUP BY activity_id, act.clip, activity)"""


@query("SELECT activity_id, clip, activity, median_height, max_height, n, CASE WHEN median_height >= 250 THEN 'good' WHEN median_height >= 120 THEN 'marginal' ELSE 'too-small' END AS band FROM screened", ACTORS)
def screen_actors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return joins.screen_actors(A.boxes(spark, sf_dir), A.activities(spark, sf_dir)).withColumn("band", X.size_band("median_height"))


@query("SELECT clip, median(median_height) AS median_height, max(max_height) AS best, array_to_string(list_sort(list(DISTINCT activity)), ',') AS activities, count(*) AS n FROM screened GROUP BY clip", ACTORS)
def screen_clips(spark: SparkSession, sf_dir: str) -> DataFrame:
    return joins.screen_clips(joins.screen_actors(A.boxes(spark, sf_dir), A.activities(spark, sf_dir)))


@query(
    "SELECT video, w AS start_s, n AS contained FROM (SELECT *, row_number() OVER (PARTITION BY video ORDER BY n DESC, w, event_id) AS k FROM counted) WHERE k = 1",
    """tried AS (SELECT video, event_id, greatest(0.0::DOUBLE, least(start_s - 3, 600.0::DOUBLE)) AS w FROM truths),
counted AS (SELECT a.video, a.event_id, a.w, count(b.event_id) AS n FROM tried a LEFT JOIN truths b ON b.video = a.video AND b.start_s >= a.w AND b.end_s <= a.w + 120 GROUP BY a.video, a.event_id, a.w)""",
)
def best_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    return joins.best_window(A.truths(spark, sf_dir), A.media(spark, sf_dir), "video", 120.0)


@query(
    f"SELECT video, description, {r('greatest(0.0::DOUBLE, least((lo + hi) / 2 - w / 2, 800 - w))', 3)} AS start_s, {r('least(800.0::DOUBLE, greatest(0.0::DOUBLE, least((lo + hi) / 2 - w / 2, 800 - w)) + w)', 3)} AS end_s FROM (SELECT *, greatest(60.0::DOUBLE, hi - lo) AS w FROM ends)",
    "ends AS (SELECT video, description, min(start_s) AS lo, max(end_s) AS hi FROM truths GROUP BY video, description)",
)
def excerpts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return joins.excerpt(A.truths(spark, sf_dir), A.media(spark, sf_dir).withColumn("duration_s", F.col("duration_s") + 80), "video", ["video", "description"], 60.0)


NEAREST = f"""near AS (SELECT t.video, t.description, t.event_id AS t_id, {r('abs(p.start_s - t.start_s)', 3)} AS start_error, {r('abs(p.end_s - t.end_s)', 3)} AS end_error,
  row_number() OVER (PARTITION BY t.event_id ORDER BY abs(p.start_s - t.start_s), p.start_s, p.end_s, p.event_id) AS n FROM truths t JOIN preds p ON p.video = t.video AND p.description = t.description)"""


@query("SELECT video, description, t_id, start_error, end_error FROM near WHERE n = 1", NEAREST)
def boundary_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return joins.nearest_start(A.truths(spark, sf_dir), A.preds(spark, sf_dir), ["video", "description"])


PROBE = f"""{NEAREST}, errs AS (SELECT description, unnest([start_error, end_error]) AS error FROM near WHERE n = 1),
ranks AS (SELECT *, row_number() OVER (PARTITION BY description ORDER BY error) - 1 AS r, count(*) OVER (PARTITION BY description) AS m FROM errs),
summary AS (SELECT description, count(*) AS n, {r('median(error)', 4)} AS median_error, {r('avg(error)', 4)} AS mean_error, max(error) FILTER (m >= 10 AND r = floor(m * 0.9::DOUBLE)) AS p90_error FROM ranks GROUP BY description)"""


def _probe(spark: SparkSession, sf_dir: str) -> DataFrame:
    near = joins.nearest_start(A.truths(spark, sf_dir), A.preds(spark, sf_dir), ["video", "description"])
    return quality.probe_summary(near.select("description", F.explode(F.array("start_error", "end_error")).alias("error")), ["description"])


@query("SELECT description, n, median_error, mean_error, p90_error FROM summary", PROBE)
def probe_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _probe(spark, sf_dir)


@query("SELECT description, median_error FROM summary ORDER BY median_error, description LIMIT 1", PROBE)
def best_combination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.best_combination(_probe(spark, sf_dir), ["description"])


@query(f"SELECT t.video, t.event_id, count(*) FILTER (\"at\" >= start_s - 1 AND \"at\" <= end_s + 1) AS n_within, count(*) FILTER (\"at\" >= start_s AND \"at\" <= end_s) AS n_strict, {r('min(CASE WHEN \"at\" < start_s THEN start_s - \"at\" ELSE \"at\" - end_s END)', 3)} AS nearest FROM truths t LEFT JOIN changes c ON c.video = t.video GROUP BY t.video, t.event_id", CHANGES)
def transition_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return joins.transition_hits(A.truths(spark, sf_dir), states.transitions(A.polls(spark, sf_dir), ["video"]), 1.0)


@query(
    "SELECT count(*) FILTER (a.text = b.text AND a.state IS NOT DISTINCT FROM b.state) AS both_same, count(*) FILTER (a.text = b.text AND a.state IS DISTINCT FROM b.state) AS text_same_state_differs, count(*) FILTER (a.text <> b.text AND a.state IS NOT DISTINCT FROM b.state) AS text_differs_state_same, count(*) FILTER (a.text <> b.text AND a.state IS DISTINCT FROM b.state) AS both_differ FROM polls a JOIN other b USING (video, t)",
    "other AS (SELECT video, t, CASE WHEN event_id % 5 = 0 THEN text || '!' ELSE text END AS text, CASE WHEN event_id % 7 = 0 THEN NULL ELSE state END AS state FROM polls)",
)
def run_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = A.polls(spark, sf_dir)
    b = a.select("video", "t", F.when(F.col("event_id") % 5 == 0, F.concat("text", F.lit("!"))).otherwise(F.col("text")).alias("text"), F.when(F.col("event_id") % 7 != 0, F.col("state")).alias("state"))
    return joins.run_diff(a, b, ["video", "t"])


@query(
    "SELECT w.video, w.index, w.query, coalesce(x.raw, y.raw) AS raw FROM asked w LEFT JOIN ex x USING (video, query, index) LEFT JOIN fb y ON y.video = w.video AND y.query = w.query",
    """recordings AS (SELECT video, description AS query, window_index AS index, 'event ' || event_id AS raw, event_id AS filename FROM preds),
asked AS (SELECT DISTINCT video, description AS query, window_index AS index FROM truths),
ex AS (SELECT video, query, index, arg_min(raw, filename) AS raw FROM recordings GROUP BY ALL), fb AS (SELECT video, query, arg_min(raw, filename) AS raw FROM recordings GROUP BY ALL)""".replace("GROUP BY ALL), fb", "GROUP BY video, query, index), fb").replace("recordings GROUP BY ALL)", "recordings GROUP BY video, query)"),
)
def replay_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Recorded responses for requests: first by the whole key, else by the shorter one."""
    recordings = A.preds(spark, sf_dir).select("video", F.col("description").alias("query"), F.col("window_index").alias("index"), F.col("evidence").alias("raw"), F.col("event_id").alias("filename"))
    asked = A.truths(spark, sf_dir).select("video", F.col("description").alias("query"), F.col("window_index").alias("index")).distinct()
    return joins.lookup_recordings(asked, recordings, ["video", "query", "index"], ["video", "query"]).select("video", "index", "query", "raw")


# Label quality.


@query("SELECT event_id, unnest(list_filter([CASE WHEN end_s > 720 THEN 'end after clip' END, CASE WHEN end_s - start_s > 20 THEN 'suspect span' END, CASE WHEN end_s <= start_s THEN 'end before start' END], lambda x: x IS NOT NULL)) AS problem FROM candidates")
def label_problems(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.label_problems(A.candidates(spark, sf_dir), A.media(spark, sf_dir))


@query("SELECT event_id, 'ends after the clip' AS violation FROM candidates WHERE end_s > 720 + 1e-6")
def output_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.output_violations(A.candidates(spark, sf_dir), A.media(spark, sf_dir))


JUDGED = "judged AS (SELECT video, event_id, start_s + 0.5 AS start_s, end_s, ['pending', 'confirmed', 'suspect'][(event_id % 3)::INT + 1] AS status FROM candidates WHERE event_id % 4 <> 0), planned AS (SELECT * FROM candidates WHERE event_id % 5 <> 0)"


def _judged(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    cands = A.candidates(spark, sf_dir)
    status = F.get(F.array(F.lit("pending"), F.lit("confirmed"), F.lit("suspect")), (F.col("event_id") % 3).cast("int"))
    return cands.where(F.col("event_id") % 5 != 0), cands.where(F.col("event_id") % 4 != 0).select("video", "event_id", (F.col("start_s") + 0.5).alias("start_s"), "end_s", status.alias("status"))


@query("SELECT coalesce(j.video, p.video) AS video, coalesce(j.event_id, p.event_id) AS event_id, CASE WHEN status <> 'pending' THEN j.start_s ELSE coalesce(p.start_s, j.start_s) END AS start_s, CASE WHEN status <> 'pending' THEN j.end_s ELSE coalesce(p.end_s, j.end_s) END AS end_s, coalesce(status, 'pending') AS status FROM judged j FULL JOIN planned p ON p.video = j.video AND p.event_id = j.event_id", JUDGED)
def upsert_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.upsert_labels(*_judged(spark, sf_dir))


@query("SELECT status, count(*) AS n FROM judged GROUP BY status", JUDGED)
def status_tally(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.status_tally(_judged(spark, sf_dir)[1])


@query("SELECT j.video, j.event_id FROM judged j JOIN planned p ON p.video = j.video AND p.event_id = j.event_id WHERE status <> 'pending' AND (j.start_s <> p.start_s OR j.end_s <> p.end_s)", JUDGED)
def moved_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.moved_judged(*_judged(spark, sf_dir))


@query(
    "SELECT point_id, coalesce(arg_min(z, k) FILTER (z <> 'out'), 'out') AS zone FROM z GROUP BY point_id",
    """pts AS (SELECT video, event_id AS point_id, t FROM frames WHERE event_id % 3 <> 0),
z AS (SELECT point_id, CASE WHEN t >= start_s + m AND t <= end_s - m THEN 'in' WHEN t >= start_s - 0.35 AND t <= end_s + 0.35 THEN 'edge' ELSE 'out' END AS z, k
  FROM (SELECT pts.*, e.start_s, e.end_s, least(0.35::DOUBLE, (e.end_s - e.start_s) / 4) AS m, row_number() OVER (PARTITION BY point_id ORDER BY e.start_s, e.end_s, e.event_id) AS k FROM pts LEFT JOIN truths e ON e.video = pts.video))""",
)
def edge_zones(spark: SparkSession, sf_dir: str) -> DataFrame:
    points = A.frames(spark, sf_dir).where(F.col("event_id") % 3 != 0).select("video", F.col("event_id").alias("point_id"), "t")
    return quality.zones(points, A.truths(spark, sf_dir), ["video"]).select("point_id", "zone")


@query("SELECT video, description, least(30.0::DOUBLE, greatest(4.0::DOUBLE, 4 / greatest(min(end_s - start_s), 0.05::DOUBLE))) AS fps FROM truths GROUP BY video, description")
def sample_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.sample_rates(A.truths(spark, sf_dir), ["video", "description"])


@query("SELECT name AS query, n FROM (SELECT trim(' ' || description || ' ') AS name, count(*) AS n FROM base GROUP BY 1) WHERE n > 1")
def duplicate_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked = A.candidates(spark, sf_dir).select(F.concat(F.lit(" "), F.col("description"), F.lit(" ")).alias("query"))
    return quality.duplicates(asked, "query")


@query(
    "SELECT d.description AS model, n_preds, n_truths FROM (SELECT DISTINCT description FROM base) d LEFT JOIN (SELECT description, count(*) AS n_preds FROM preds GROUP BY description) USING (description) LEFT JOIN (SELECT description, count(*) AS n_truths FROM truths GROUP BY description) USING (description)"
)
def leaderboard(spark: SparkSession, sf_dir: str) -> DataFrame:
    count = lambda df, name: df.groupBy(F.col("description").alias("model")).agg(F.count(F.lit(1)).alias(name))
    return quality.leaderboard(A.candidates(spark, sf_dir).select(F.col("description").alias("model")).distinct(), count(A.preds(spark, sf_dir), "n_preds"), count(A.truths(spark, sf_dir), "n_truths"))


# Scalars and sets.


@query(f"SELECT event_id, k, {r('exp(-k / 100) / (exp(-k / 100) + exp(-1.0::DOUBLE))', 6)} AS p_yes FROM (SELECT event_id, (json_extract(props, '$.k'))::DOUBLE AS k FROM base)")
def json_softmax(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JSON access, and the share of yes in two log-probabilities."""
    k = F.from_json("props", "k DOUBLE")["k"]
    return A.table(spark, sf_dir, "events").select("event_id", k.alias("k"), rounded(X.two_way_softmax(-k / 100, F.lit(-1.0)), 6).alias("p_yes"))


@query("SELECT video, description, 'both' AS side FROM (SELECT video, description FROM preds INTERSECT SELECT video, description FROM truths) UNION ALL SELECT video, description, 'preds' FROM (SELECT video, description FROM preds EXCEPT SELECT video, description FROM truths) UNION ALL SELECT video, description, 'truths' FROM (SELECT video, description FROM truths EXCEPT SELECT video, description FROM preds)")
def key_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    p, t = (x.select("video", "description") for x in (A.preds(spark, sf_dir), A.truths(spark, sf_dir)))
    side = lambda df, name: df.withColumn("side", F.lit(name))
    return side(p.intersect(t), "both").unionByName(side(p.distinct().join(t, ["video", "description"], "left_anti"), "preds")).unionByName(side(t.distinct().join(p, ["video", "description"], "left_anti"), "truths"))


@query("SELECT event_id, CASE WHEN d < 0 THEN d + 86400 ELSE d END AS seconds FROM (SELECT event_id, ((event_id * 7 + 61) % 86400 - event_id * 7 % 86400)::INT AS d FROM base)")
def recording_lengths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lengths from names HH-MM-SS.HH-MM-SS, wrapping at midnight."""
    clock = lambda s: F.format_string("%02d-%02d-%02d", F.floor(s / 3600), F.floor(s / 60) % 60, s % 60)
    a, b = F.col("event_id") * 7 % 86_400, (F.col("event_id") * 7 + 61) % 86_400
    return A.table(spark, sf_dir, "events").select("event_id", X.seconds_of_name(F.concat(clock(a), F.lit("."), clock(b))).alias("seconds"))


_ZONED = """pts AS (SELECT video, event_id AS point_id, t, (event_id % 40) / 10.0::DOUBLE AS moved_pct FROM frames),
near AS (SELECT pts.*, e.start_s, e.end_s, least(0.35::DOUBLE, (e.end_s - e.start_s) / 4) AS m, row_number() OVER (PARTITION BY point_id ORDER BY e.start_s, e.end_s, e.event_id) AS k FROM pts LEFT JOIN truths e ON e.video = pts.video),
z AS (SELECT video, point_id, moved_pct, k, CASE WHEN t >= start_s + m AND t <= end_s - m THEN 'in' WHEN t >= start_s - 0.35 AND t <= end_s + 0.35 THEN 'edge' ELSE 'out' END AS z FROM near),
zoned AS (SELECT video, point_id, any_value(moved_pct) AS moved_pct, coalesce(arg_min(z, k) FILTER (z <> 'out'), 'out') AS zone FROM z GROUP BY video, point_id),
sides AS (SELECT video, coalesce(max(moved_pct) FILTER (zone = 'in'), 0) AS inside, coalesce(max(moved_pct) FILTER (zone = 'out'), 0) AS outside, count(*) FILTER (zone = 'in') AS n FROM zoned GROUP BY video)"""


@query(
    """SELECT video, axis, inside, outside, CASE WHEN n = 0 AND ev > 0 THEN 'nothing sampled inside' WHEN ev = 0 THEN 'no event labelled' WHEN inside < 1.5 THEN 'nothing moves inside' WHEN inside < outside THEN 'moves more outside' ELSE 'ok' END AS verdict
FROM (SELECT s.*, axis, coalesce((SELECT count(*) FROM truths t WHERE t.video = s.video), 0) AS ev FROM sides s JOIN axes USING (video))""",
    _ZONED,
)
def motion_agreement(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether motion agrees with the labels, clip by clip."""
    trace = A.frames(spark, sf_dir).select("video", F.col("event_id").alias("point_id"), "t", (F.col("event_id") % 40 / 10.0).alias("moved_pct"))
    return quality.motion_agreement(trace, A.truths(spark, sf_dir), A.axes(spark, sf_dir))


@query("SELECT video, description, n, fps, v AS prompt_variant FROM (SELECT video, description, count(*) AS n FROM truths GROUP BY video, description), (SELECT unnest([2.0, 4.0]::DOUBLE[]) AS fps), (SELECT unnest(['overlay', 'native', 'terse']) AS v)")
def probe_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    cases = A.truths(spark, sf_dir).groupBy("video", "description").agg(F.count(F.lit(1)).alias("n"))
    return quality.probe_sweep(cases, (2.0, 4.0), ("overlay", "native", "terse"))


@query("SELECT count(*) FILTER (error IS NULL) AS parsed, count(*) FILTER (event_id % 10 IN (5, 6, 8, 9)) AS failed_before, count(*) FILTER (event_id % 10 IN (5, 8)) AS recovered, count(*) FILTER (event_id % 10 IN (6, 9)) AS still_failing FROM parsed", f"{RAW}, {PARSED}")
def replay_recovery(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Recorded responses parsed again: which failures of a strict parser come back."""
    return quality.replay_recovery(responses.parse_responses(A.raw_responses(spark, sf_dir)), (F.col("event_id") % 10).isin(5, 6, 8, 9))


@query(f"SELECT event_id, description AS activity, s AS start_s, {r('greatest(s + 0.1::DOUBLE, value - 0.5)', 3)} AS end_s FROM (SELECT event_id, description, value, {r('least(0.5::DOUBLE, value / 4)', 3)} AS s FROM base)")
def control_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Positive controls: activity from the clip's name, the span nearly the whole clip."""
    clips = A.table(spark, sf_dir, "events").select("event_id", X.activity_of_stem(F.concat(F.lit("ex"), F.col("event_id"), F.lit("-"), F.col("event_type"))).alias("activity"), F.col("value").alias("duration_s"))
    return quality.control_spans(clips).drop("duration_s")


@query("SELECT description, min(event_id) AS event_id FROM base GROUP BY description")
def first_clip_of_activity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.first_of_each(A.candidates(spark, sf_dir).select("description", "event_id"), "description", "event_id")


@query("SELECT event_id, CASE activity WHEN 'signup' THEN 'a person signs up' ELSE activity END AS description, activity = 'signup' AS phrasing_mapped FROM (SELECT event_id, description AS activity FROM base)")
def phrasing_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    phrasing = spark.sql("SELECT 'signup' AS activity, 'a person signs up' AS description")
    return quality.phrased(A.candidates(spark, sf_dir).select("event_id", F.col("description").alias("activity")), phrasing).drop("activity")


@query("SELECT event_id, event_id // 476 + 1 AS clip, (event_id % 476 // 4)::DOUBLE AS second FROM base")
def progress_position(spark: SparkSession, sf_dir: str) -> DataFrame:
    clip, second = quality.progress(F.col("event_id"), 476, 4, 1.0)
    return A.table(spark, sf_dir, "events").select("event_id", clip.alias("clip"), second.cast("double").alias("second"))


@query(f"SELECT video, description AS option, {r('avg(confidence)', 6)} AS p FROM candidates GROUP BY video, description")
def averaged_probabilities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Probabilities averaged over the orders in which options were offered."""
    asked = A.candidates(spark, sf_dir).select("video", F.col("description").alias("option"), F.col("confidence").alias("p"))
    return quality.averaged_probabilities(asked, ["video"]).withColumn("p", rounded("p", 6))


_TERSE = prompts.VARIANTS[2][2].replace("'", "''")


@query(f"SELECT video, index, query, replace(replace(replace('{_TERSE}', '{{query}}', query), '{{start}}', printf('%.3f', start_s)), '{{end}}', printf('%.3f', end_s)) AS user_prompt FROM windows, (SELECT DISTINCT description AS query FROM truths)")
def request_prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The prompt of every request of a run."""
    asked = A.truths(spark, sf_dir).select(F.col("description").alias("query")).distinct()
    requests = grids.expand_requests(grids.plan_windows(A.media(spark, sf_dir)), asked, "terse")
    return prompts.with_prompts(requests).select("video", "index", "query", "user_prompt")


# What a run plans, keeps and tells.

CLIP_SQL = SIGNAL + ", clips AS (SELECT video, max(t) + 1 AS duration_s FROM px GROUP BY video)"


@query(
    "SELECT n.video, u.t FROM (SELECT video, unnest(picks) AS t FROM nms WHERE k = (SELECT count(*) FROM ranked r WHERE r.video = nms.video)) u JOIN clips n ON n.video = u.video WHERE u.t + 2 <= n.duration_s",
    CLIP_SQL
    + """, ranked AS (SELECT video, t, row_number() OVER (PARTITION BY video ORDER BY moved_pct DESC, t) AS k FROM sig WHERE moved_pct >= 5),
nms AS (SELECT DISTINCT video, 0::BIGINT AS k, []::DOUBLE[] AS picks FROM sig
  UNION ALL SELECT r.video, r.k, CASE WHEN len(picks) >= 6 OR len(list_filter(picks, lambda p: abs(p - r.t) < 3)) > 0 THEN picks ELSE list_append(picks, r.t) END FROM nms JOIN ranked r ON r.video = nms.video AND r.k = nms.k + 1)""",
)
def triggered_polls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Polls where the picture changes most."""
    clips = A.pixels(spark, sf_dir).groupBy("video").agg((F.max("t") + 1).alias("duration_s"))
    return grids.triggered_grid(_signal(spark, sf_dir), clips, 6, 5.0, 3.0)


@query("SELECT video, 719::BIGINT AS polls, 719::BIGINT * 4 AS model_calls FROM media")
def states_cost(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grids.states_cost(A.media(spark, sf_dir), 4)


@query("SELECT video, event_id FROM candidates WHERE confidence >= 0.5")
def detected_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requests that a cheap yes-or-no question keeps."""
    from .plans import backends

    asked = A.candidates(spark, sf_dir).select("video", "event_id", "confidence")
    seer = backends.Backend("told", lambda x: x, detect=lambda x: x.withColumn("p_yes", F.col("confidence")))
    return backends.detected(asked, seer).select("video", "event_id")


@query("SELECT video, problem FROM (SELECT o_custkey AS video, count(*) AS n, count(*) FILTER (o_orderpriority = '5-LOW') AS blank FROM orders GROUP BY o_custkey), LATERAL (SELECT unnest(list_filter([CASE WHEN n > 1 THEN 'duplicate clip' END, CASE WHEN blank > 0 THEN 'no axis' END], lambda x: x IS NOT NULL)) AS problem)")
def clip_problems(spark: SparkSession, sf_dir: str) -> DataFrame:
    clips = A.table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("video"), F.nullif(F.col("o_orderpriority"), F.lit("5-LOW")).alias("axis"))
    return quality.clip_problems(clips)


@query("SELECT p_partkey AS video, CASE WHEN p_size * 20 < 640 THEN 'low_resolution' ELSE p_brand END AS axis FROM part")
def assigned_axes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.table(spark, sf_dir, "part").select(F.col("p_partkey").alias("video"), quality.assigned_axis(F.col("p_size") * 20, "p_brand").alias("axis"))


#: Scenes with exact truths: description, axis, start and end in seconds.
SCENES = [("a ball rolls from left to right", "baseline", 1.0, 4.0), ("a lamp is switched on", "short", 6.5, 7.0), ("a box stays where it is", "absence_of_motion", 8.0, 14.0)]
_SCENES = ", ".join(f"('{d}', '{a}', {s}, {e})" for d, a, s, e in SCENES)


@query(f"SELECT m.video, x.description, x.axis, {r('x.s * (1 + m.video % 3)', 3)} AS start_s, {r('x.e * (1 + m.video % 3)', 3)} AS end_s FROM media m, (VALUES {_SCENES}) x(description, axis, s, e)")
def synthetic_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    clips = A.media(spark, sf_dir).select("video", (F.col("video") % 3 + 1).cast("double").alias("scale"))
    return quality.synthetic_labels(clips, SCENES)


@query("SELECT a.activity_id, a.clip, a.activity, s.median_height, CASE WHEN s.median_height IS NULL OR s.median_height = 0 THEN 720 ELSE greatest(480, least(1280, round_even(1920 * 150 / s.median_height, 0)))::INT END AS width FROM act a LEFT JOIN (SELECT clip, activity, arg_max(median_height, activity_id) AS median_height FROM screened GROUP BY clip, activity) s ON s.clip = a.clip AND s.activity = a.activity", ACTORS)
def actor_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Heights told for an activity's clip and name, the last one winning, and the width of its tile."""
    acts = A.activities(spark, sf_dir)
    told = joins.last_of(joins.screen_actors(A.boxes(spark, sf_dir), acts), ["clip", "activity"], ["activity_id"], "median_height")
    return acts.join(told, ["clip", "activity"], "left").select("activity_id", "clip", "activity", "median_height", X.tile_width("median_height").alias("width"))


@query(
    f"""SELECT count(*) FILTER (routed) AS scored, count(*) FILTER (routed AND n_within > 0) AS hits, count(*) FILTER (routed AND n_strict > 0) AS strict_hits, count(*) FILTER (routed AND pb) AS partial_before, count(*) FILTER (routed AND pa) AS partial_after, count(*) FILTER (NOT routed) AS skipped
FROM (SELECT t.video, t.event_id, t.description <> 'view' AS routed, count(*) FILTER ("at" >= start_s - 1 AND "at" <= end_s + 1) AS n_within, count(*) FILTER ("at" >= start_s AND "at" <= end_s) AS n_strict FROM truths t LEFT JOIN changes c ON c.video = t.video GROUP BY ALL) h
LEFT JOIN (SELECT video, arg_min(state, t) = 'open' AS pb, arg_max(state, t) = 'open' AS pa FROM polls WHERE state IS NOT NULL GROUP BY video) b ON b.video = h.video""",
    CHANGES,
)
def transition_tally(spark: SparkSession, sf_dir: str) -> DataFrame:
    polls, labels = A.polls(spark, sf_dir), A.truths(spark, sf_dir)
    hits = joins.transition_hits(labels, states.transitions(polls, ["video"]), 1.0)
    return joins.transition_tally(hits, labels.select("video", "event_id", (F.col("description") != "view").alias("routed")), states.boundaries(polls, ["video"], "open"))


@query(
    f"""SELECT o.prompt, cases, emit_share, parse_failures, rejected, clamped, mean_latency_s, mean_frames, n, median_error, mean_error, p90_error
FROM (SELECT event_id % 3 AS prompt, count(*) AS cases, {r('avg((e_start IS NOT NULL)::INT)', 4)} AS emit_share, count(*) FILTER (error IS NOT NULL) AS parse_failures, sum((reason IS NOT NULL)::INT)::BIGINT AS rejected, sum((e_start IS NOT NULL AND reason IS NULL AND (e_start < w_start - 1e-6 OR e_end > w_end + 1e-6))::INT)::BIGINT AS clamped, {r('avg((event_id % 7)::DOUBLE)', 4)} AS mean_latency_s, {r('avg((event_id % 12)::DOUBLE)', 4)} AS mean_frames FROM judged GROUP BY 1) o
LEFT JOIN (SELECT prompt, count(*) AS n, {r('median(error)', 4)} AS median_error, {r('avg(error)', 4)} AS mean_error, CASE WHEN count(*) >= 10 THEN list_sort(list(error))[floor(count(*) * 0.9)::INT + 1] END AS p90_error FROM (SELECT event_id % 3 AS prompt, {r(f"abs({r('greatest(w_start, least(e_start, w_end))', 3)} - s)", 3)} AS error FROM judged WHERE e_start IS NOT NULL AND reason IS NULL) GROUP BY prompt) x ON x.prompt = o.prompt""",
    f"""{RAW}, {PARSED}, moved AS (SELECT p.*, w_start + 1 AS s FROM parsed p), shifted AS (SELECT * REPLACE (w_start + 1.25 * (event_id % 3) AS w_start) FROM moved),
judged AS (SELECT *, CASE WHEN e_start IS NULL THEN NULL WHEN e_end - e_start < 1e-3 THEN 'zero_length' WHEN (e_end - e_start) / greatest(1e-6, w_end - w_start) >= 0.95 THEN 'whole_window' WHEN e_start > w_end + 1 OR e_end < w_start - 1 THEN 'out_of_window'
  WHEN NOT e_start BETWEEN w_start AND w_end AND NOT EXISTS (SELECT 1 FROM frames f WHERE f.video = shifted.video AND abs(f.t - e_start) <= 0.5) THEN 'no_frame' END AS reason FROM shifted)""",
)
def probe_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A probe's observations by prompt: how much was reported, refused and moved in reconciling, and lost, and the errors of the starts."""
    prompt = (F.col("event_id") % 3).alias("prompt")
    parsed = responses.parse_responses(A.raw_responses(spark, sf_dir)).withColumns({"truth": F.col("start_s") + 1, "w_start": F.col("start_s") + 1.25 * (F.col("event_id") % 3), "w_end": F.col("end_s")})
    rows = responses.events_of(parsed).select("video", "event_id", "truth", "w_start", "w_end", F.col("e.start_s").alias("e_start"), F.col("e.end_s").alias("e_end"))
    judged = responses.reconcile(rows, A.frames(spark, sf_dir))
    seen = parsed.select(prompt, "event_id", F.size("events").alias("n_reported"), F.col("error").isNotNull().alias("failed"), (F.col("event_id") % 7).cast("double").alias("latency_s"), (F.col("event_id") % 12).cast("double").alias("frames"))
    seen = seen.join(quality.observed(judged, ["event_id"]), "event_id", "left").fillna(0, ["rejected", "clamped"])
    errors = judged.where("reason IS NULL").select(prompt, rounded(F.abs(F.col("start_s") - F.col("truth")), 3).alias("error"))
    return quality.probe_report(seen, errors, ["prompt"])


@query("SELECT video, event_id, row_number() OVER (PARTITION BY video ORDER BY start_s, end_s, description, event_id) AS place FROM preds")
def output_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predictions in the order that a result lists them: written in it, and numbered as they stand there."""
    from .sources import files

    placed = merge.placed(A.preds(spark, sf_dir), files.scratch_folder(spark, "order"))
    return placed.select("video", "event_id", (F.col("place") - F.min("place").over(Window.partitionBy("video")) + 1).cast("int").alias("place"))


@query("SELECT t.* FROM truths t WHERE t.video IN (SELECT video FROM media ORDER BY video LIMIT 8)")
def first_clips(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Truths of the first clips in name order."""
    from .plans import find

    return A.truths(spark, sf_dir).join(find.first_clips(A.media(spark, sf_dir).select("video"), 8), "video", "left_semi")


@query("SELECT clip, best FROM (SELECT clip, max(max_height) AS best FROM screened GROUP BY clip) ORDER BY best DESC, clip LIMIT 10", ACTORS)
def top_clips(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The report's best clips."""
    ranked = joins.screen_clips(joins.screen_actors(A.boxes(spark, sf_dir), A.activities(spark, sf_dir)))
    return ranked.orderBy(F.desc("best"), "clip").limit(10).select("clip", "best")


@query("SELECT s_name AS source, (SELECT greatest(count(*) - 25, 0) FROM supplier) AS n_left FROM supplier ORDER BY s_name LIMIT 25")
def first_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first sources, and how many are cut off."""
    return quality.first_rows(A.table(spark, sf_dir, "supplier").select(F.col("s_name").alias("source")), ["source"], 25)


@query("SELECT o_orderkey AS id, replace(left(o_orderpriority || ' of ' || o_orderstatus, 34), ' ', '-') AS slug, substr(d, 6) AS day, substr(d, 6) || '_' || 'school.G' || (o_custkey % 400) AS scene, substr(d, 6) || '_school' AS tag FROM (SELECT *, strftime(o_orderdate, '%Y-%m-%d') AS d FROM orders)")
def name_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Slugs, days, scenes and tags of dotted names."""
    name = F.concat(F.date_format("o_orderdate", "yyyy-MM-dd"), F.lit(".11-05-00.11-10-00.school.G"), F.col("o_custkey") % 400, F.lit(".avi"))
    named = A.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.concat("o_orderpriority", F.lit(" of "), "o_orderstatus").alias("text"), name.alias("name"))
    return named.select("id", X.slug("text").alias("slug"), X.day_of("name").alias("day"), X.scene_of("name").alias("scene"), X.clip_tag("name").alias("tag"))


@query("SELECT video, description, start_s, end_s FROM truths")
def labels_written_and_read(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels as JSON files and back."""
    from .sources import files

    folder = files.scratch_folder(spark, "labels")
    files.write_labels(A.truths(spark, sf_dir), A.axes(spark, sf_dir), folder)
    return files.read_labels(spark, folder, lines=True)[0].select(F.col("video").cast("long").alias("video"), "description", "start_s", "end_s")


from . import source_queries  # noqa: E402, F401  registers its queries
