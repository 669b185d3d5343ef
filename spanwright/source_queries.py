"""Queries through the engine's sources: streams, recordings, documents, frames of clips of any length."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


from .config import Config, with_overrides
from .functions import text as X
from .operators import grids, quality, responses
from .plans import backends, find, prompts
from .queries import query, r
from .sources import adapters as A
from .sources import contract, files, recordings
from .streaming import timelines

#: The clips of adapters.clips() in SQL, and their windows.
CLIPS = """clips AS (SELECT DISTINCT video, CASE WHEN video % 11 = 0 THEN 0.0::DOUBLE ELSE (video % 7) * 130.0::DOUBLE + (video % 4) * 0.25::DOUBLE + 1.5::DOUBLE END AS duration_s FROM base),
parts AS (SELECT video, i::INT AS index, (i * 9)::DOUBLE AS start_s, floor(least(i * 9 + 12, duration_s) * 1000 + 0.5) / 1000 AS end_s FROM clips, range(0, 400) r(i)
          WHERE duration_s > 0 AND i <= greatest(0, ceil((duration_s - 12) / 9)))"""


@query(
    "SELECT p.video, p.index, count(t) AS n_frames, min(t) AS first_t, max(t) AS last_t FROM parts p LEFT JOIN thin USING (video, index) GROUP BY p.video, p.index",
    CLIPS
    + """, inside AS (SELECT p.video, p.index, f.t FROM parts p JOIN frames f ON f.video = p.video AND f.t >= p.start_s - 1e-6 AND f.t <= p.end_s + 1e-6),
ranked AS (SELECT *, row_number() OVER (PARTITION BY video, index ORDER BY t) - 1 AS k, count(*) OVER (PARTITION BY video, index) AS n FROM inside),
thin AS (SELECT video, index, t FROM ranked WHERE n <= 3 OR k IN (SELECT least(floor(i * (n / 3.0::DOUBLE)), n - 1) FROM range(0, 3) x(i)))""",
)
def frames_of_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each window of clips of different lengths shows: the frames that its request carries."""
    clips = A.clips(spark, sf_dir)
    shown = grids.with_frames(grids.plan_windows(clips), A.frames(spark, sf_dir), clips, 3)
    return shown.select("video", "index", F.size("frame_times").cast("long").alias("n_frames"), F.array_min("frame_times").alias("first_t"), F.array_max("frame_times").alias("last_t"))


@query(
    f"SELECT video, {r('(t0 + t) / 2', 3)} AS at, s0 AS from_state, state AS to_state, t0 AS lo, t AS hi FROM (SELECT *, lag(t) OVER o AS t0, lag(state) OVER o AS s0 FROM told WINDOW o AS (PARTITION BY video ORDER BY t)) WHERE state <> s0 AND t - t0 <= 30",
    "told AS (SELECT * FROM polls WHERE state IS NOT NULL AND floor(t * 1000) < (SELECT max(floor(t * 1000)) FROM polls WHERE state IS NOT NULL) - 20000)",
)
def streamed_transitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Transitions from a stream of polls with keyed state: all that the watermark, 20 s behind the last poll, has passed."""
    folder = files.scratch_folder(spark, "transitions")
    return timelines.run_to_end(spark, lambda: timelines.stream_transitions(A.poll_stream(spark, sf_dir), "20 seconds", 30.0), folder)


RECORDED = """recorded AS (SELECT 'v' || (video % 50) AS video, CASE WHEN event_id % 3 = 0 THEN 'terse' ELSE 'overlay' END AS prompt_variant, window_index AS index, description AS query, event_id, 'raw ' || event_id AS raw, start_s FROM candidates)"""


def _recorded(spark: SparkSession, sf_dir: str) -> DataFrame:
    variant = F.when(F.col("event_id") % 3 == 0, "terse").otherwise("overlay")
    return A.candidates(spark, sf_dir).select(F.concat(F.lit("v"), F.col("video") % 50).alias("video"), variant.alias("prompt_variant"), F.col("window_index").alias("index"), F.col("description").alias("query"), F.concat(F.lit("raw "), "event_id").alias("raw"), "start_s")


@query("SELECT video, prompt_variant, index, query, count(*) AS n, min(raw) AS first_raw, max(start_s) AS last_start FROM recorded WHERE video IN ('v3', 'v7') AND prompt_variant = 'overlay' GROUP BY video, prompt_variant, index, query", RECORDED)
def recordings_written_and_read(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exchanges written and read through the recordings source; other videos' files stay unread."""
    folder = files.scratch_folder(spark, "recordings")
    recordings.write_recordings(_recorded(spark, sf_dir), folder)
    kept = recordings.read_recordings(spark, folder, strict=True, video=["v3", "v7"], prompt_variant=["overlay"])
    return kept.groupBy(*recordings.KEY).agg(F.count(F.lit(1)).alias("n"), F.min("raw").alias("first_raw"), F.max("start_s").alias("last_start"))


#: Documents with one fault each, by the remainder of event_id by 16; {s}, {e} and {c} are the event's times and confidence.
_RUN = '{"model": "m", "backend": "vllm", "sample_fps": 2, "window_s": 12.0, "stride_s": 9.0, "windows": 3, "model_calls": 3, "elapsed_s": 1.5}'
_ONE = '{"description": "d", "start_s": {s}, "end_s": {e}, "confidence": {c}, "evidence": "", "partial": false, "source_windows": [0, 1]}'
_DOC = '{"video": "a", "duration_s": 700.5, "queries": ["d"], "events": [' + _ONE + '], "run": ' + _RUN + "}"
FAULTS = (
    (_DOC, None, None),
    (_DOC.replace("700.5", '"700.5"'), "$.duration_s", "type"),
    (_DOC.replace('"video": "a", ', ""), "$.video", "missing"),
    (_DOC.replace('"video": "a"', '"video": null'), "$.video", "null"),
    (_DOC.replace('"video": "a"', '"video": "a", "colour": 1'), "$.colour", "unknown"),
    (_DOC.replace('"confidence": {c}', '"confidence": 1.25'), "$.events[0].confidence", "value"),
    (_DOC.replace("[0, 1]", '[0, "1"]'), "$.events[0].source_windows[1]", "type"),
    (_DOC.replace("[0, 1]", "[null, 1]"), "$.events[0].source_windows[0]", "null"),
    (_DOC.replace('"windows": 3', '"windows": 3.5'), "$.run.windows", "type"),
    (_DOC.replace('"backend": "vllm"', '"backend": "none"'), "$.run.backend", "value"),
    ('{"predictions": [], "overall": {}, "x": {s}}', "$", "wrong_document"),
    (_DOC.replace('"video": "a"', '"video" "a"'), "$", "not_json"),
    ("[" + _DOC + "]", "$", "type"),
    (_DOC.replace('"events": [' + _ONE + "]", '"events": {}'), "$.events", "type"),
    (_DOC.replace(_ONE, '{"description": "d", "start_s": {s}, "end_s": {e}, "confidence": 0}, ' + _ONE.replace("{s}", "-1.0")), "$.events[1]", "order"),
    (_DOC.replace('"run": ' + _RUN, '"run": ' + _RUN + ', "polls": [1]'), "$.polls[0]", "type"),
)


@query(
    """SELECT * FROM (
  SELECT event_id, path, kind FROM candidates JOIN faults ON event_id % 16 = fault WHERE path IS NOT NULL
  UNION ALL SELECT event_id, '$.events[0]', 'bounds' FROM candidates WHERE (event_id % 16) NOT IN (1, 10, 11, 12, 13) AND end_s > 700.5 + 1e-6
  UNION ALL SELECT event_id, '$.events[1]', 'bounds' FROM candidates WHERE event_id % 16 = 14)""",
    "faults AS (SELECT * FROM (VALUES " + ", ".join(f"({k}, {repr(p) if p else 'NULL'}, {repr(kind) if kind else 'NULL'})" for k, (_, p, kind) in enumerate(FAULTS)) + ") AS t(fault, path, kind))",
)
def contract_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every violation of the output contract with its path, in a document an event, each with one fault beside those of its times."""
    shape = F.get(F.array(*[F.lit(text) for text, _, _ in FAULTS]), (F.col("event_id") % len(FAULTS)).cast("int"))
    text = shape
    for name, value in (("{s}", F.format_string("%.3f", "start_s")), ("{e}", F.format_string("%.3f", "end_s")), ("{c}", F.format_string("%.2f", "confidence"))):
        text = F.replace(text, F.lit(name), value)
    return contract.violations(A.candidates(spark, sf_dir).select("event_id", text.alias("text"))).select("event_id", "path", "kind")


# Questions of a run.


@query(
    f"""SELECT video, description, n_answered, n_near_end, slide, CASE WHEN n_answered = 0 THEN 'no answer' WHEN slide IS NULL THEN 'one offset' WHEN slide > 0.7 THEN 'window' WHEN slide < 0.3 THEN 'event' ELSE 'mixed' END AS verdict FROM (
  SELECT video, description, count(told) AS n_answered, count(*) FILTER (told IS NOT NULL AND (told - lo) / 60 >= 0.75) AS n_near_end,
         CASE WHEN count(told) >= 2 AND max(lo) FILTER (told IS NOT NULL) - min(lo) FILTER (told IS NOT NULL) >= 1e-6 THEN {r('(max(told) - min(told)) / (max(lo) FILTER (told IS NOT NULL) - min(lo) FILTER (told IS NOT NULL))', 4)} END AS slide
  FROM answered GROUP BY video, description)""",
    """cases AS (SELECT DISTINCT video, description FROM truths),
answered AS (SELECT c.video, c.description, o::DOUBLE AS lo, min(p.start_s) AS told FROM cases c CROSS JOIN (SELECT unnest([0, 30, 90, 150]) AS o)
             LEFT JOIN preds p ON p.video = c.video AND p.description = c.description AND p.start_s >= o AND p.start_s < o + 60 GROUP BY c.video, c.description, o)""",
)
def slide_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether answers follow the window that is shown: the first prediction in windows at four offsets."""
    keys = ["video", "description"]
    cases = A.truths(spark, sf_dir).groupBy(*keys).agg(F.min("start_s").alias("start_s"), F.min("end_s").alias("end_s"))
    windows = quality.offset_windows(cases, (0, 30, 90, 150), 60.0).select(*keys, "lo", "hi")
    told = A.preds(spark, sf_dir).select(*keys, "start_s")
    held = windows.join(told, keys, "left").withColumn("reported", F.when((F.col("start_s") >= F.col("lo")) & (F.col("start_s") < F.col("hi")), F.col("start_s")))
    return quality.slides(held.groupBy(*keys, "lo", "hi").agg(F.min("reported").alias("reported")), keys)


_FILLED = "replace(replace(replace(template, '{query}', description), '{start}', printf('%.3f', start_s)), '{end}', printf('%.3f', end_s))"
_VARIANTS = ", ".join("('" + "', '".join(x.replace("'", "''") for x in v) + "')" for v in prompts.VARIANTS)


@query(f"SELECT event_id, prompt_variant, system AS system_prompt, {_FILLED} AS user_prompt FROM truths, variants", f"variants(prompt_variant, system, template) AS (VALUES {_VARIANTS})")
def variant_prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both prompts of a case under each of the five variants."""
    named = F.explode(F.array(*[F.lit(v[0]) for v in prompts.VARIANTS]))
    asked = A.truths(spark, sf_dir).select("event_id", F.col("description").alias("query"), "start_s", "end_s", named.alias("prompt_variant"))
    return prompts.with_prompts(asked).select("event_id", "prompt_variant", "system_prompt", "user_prompt")


@query("SELECT video, CASE WHEN duration_s < 100 THEN 'too short' ELSE 'too long' END AS reason FROM clips WHERE duration_s < 100 OR duration_s > 700", CLIPS)
def media_refused(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clips that a run with limits of 100 and 700 seconds refuses."""
    return find.media_violations(A.clips(spark, sf_dir), with_overrides(Config(), limits__min_duration_s=100.0, limits__max_duration_s=700.0))


@query(
    f"""SELECT n_truths, n_predictions, {r('hits / n_truths', 4)} AS r_at_1_3 FROM (SELECT count(*) AS n_truths, count(*) FILTER (iou >= 0.3) AS hits FROM (
  SELECT greatest(0, least(p.end_s, t.end_s) - greatest(p.start_s, t.start_s)) / nullif(greatest(p.end_s, t.end_s) - least(p.start_s, t.start_s), 0) AS iou FROM scored_t t LEFT JOIN tops p USING (video, description))), (SELECT count(*) AS n_predictions FROM scored_p)""",
    """planned AS (SELECT video FROM media ORDER BY video LIMIT 40), scored AS (SELECT video FROM planned JOIN axes USING (video) WHERE axis <> 'positive_control'),
scored_t AS (SELECT * FROM truths WHERE video IN (SELECT video FROM scored)), scored_p AS (SELECT * FROM preds WHERE video IN (SELECT video FROM scored)),
tops AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY video, description ORDER BY confidence DESC, start_s, end_s, event_id) AS k FROM scored_p) WHERE k = 1)""",
)
def planned_evaluation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The headline of a limited run: truths of its clips only, without control clips; a stub's runs would be refused."""
    runs = A.media(spark, sf_dir).select("video", F.lit(False).alias("stub"))
    report = find.evaluate(A.preds(spark, sf_dir), A.truths(spark, sf_dir), A.axes(spark, sf_dir), runs, 40)
    return report["overall"].select("n_truths", "n_predictions", "r_at_1_3")


# Files of other tools, written from the tables as these tools write them.


@query(f"SELECT video::VARCHAR AS video, description, any_value(axis) AS axis, count(*) AS n, min(start_s) AS first, max(end_s) AS last FROM truths JOIN axes USING (video) GROUP BY video, description")
def probe_cases_read(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Probe cases from label files: a clip's description with its events and axis."""
    folder = files.scratch_folder(spark, "cases")
    files.write_labels(A.truths(spark, sf_dir), A.axes(spark, sf_dir), folder)
    return files.read_cases(spark, folder, lines=True).select("video", "description", "axis", F.size("events").cast("long").alias("n"), F.array_min(F.transform("events", lambda e: e["start_s"])).alias("first"), F.array_max(F.transform("events", lambda e: e["end_s"])).alias("last"))


@query("SELECT p_name AS description, p_brand AS state_a, p_type AS state_b FROM part WHERE p_partkey % 5 <> 0")
def states_map_read(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A states map from JSON objects, whose keys with a leading underscore are comments."""
    folder = files.scratch_folder(spark, "states")
    parts = A.table(spark, sf_dir, "part")
    name = F.when(F.col("p_partkey") % 5 == 0, F.concat(F.lit("_"), "p_name")).otherwise(F.col("p_name"))
    parts.select(F.to_json(F.create_map(name, F.array("p_brand", "p_type"))).alias("value")).write.text(folder)
    return files.read_states_map(spark, folder, lines=True)


@query("SELECT 'org/' || s_name AS model, CASE WHEN s_suppkey % 2 = 0 THEN 'yes' ELSE 'no' END AS gated, CASE WHEN s_suppkey % 7 <> 0 THEN (s_suppkey * 1024)::INT END AS max_model_len, (s_suppkey % 80)::INT AS min_vram_gib, 'n' || s_nationkey AS role FROM supplier WHERE s_suppkey % 3 <> 0")
def registry_read(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A model registry of tab-separated lines with comments, blank lines and a header."""
    folder = files.scratch_folder(spark, "registry")
    k = F.col("s_suppkey")
    line = F.concat_ws("\t", F.concat(F.lit("org/"), "s_name"), F.when(k % 2 == 0, "yes").otherwise("no"), F.when(k % 7 != 0, (k * 1024).cast("string")).otherwise("unknown"), (k % 80).cast("string"), F.concat(F.lit("n"), "s_nationkey"))
    odd = F.when(k % 2 == 0, F.concat(F.lit("# "), line)).otherwise("id\tgated\tmax_model_len\tmin_vram_gib\trole")
    A.table(spark, sf_dir, "supplier").select(F.when(k % 3 == 0, odd).otherwise(line).alias("value")).write.text(folder)
    return files.read_registry(spark, folder)


@query(
    f"SELECT o_orderpriority AS activity, count(*) AS n, sum(f0)::BIGINT AS f0, sum(f1)::BIGINT AS f1, max({r('f0 / 30.0::DOUBLE', 3)}) AS last_start FROM (SELECT translate(upper(substr(o_orderpriority, 3)), ' ', '_') AS o_orderpriority, o_custkey AS f0, o_custkey + 30 AS f1 FROM orders WHERE o_orderkey % 3 <> 0) GROUP BY o_orderpriority",
)
def activities_read(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Activities from annotation lines; other lines are skipped."""
    folder = files.scratch_folder(spark, "activities")
    name = F.translate(F.upper(F.substring("o_orderpriority", 3, 100)), " ", "_")
    line = F.format_string("- { act: {act3: { %s: 1.0}, id2: %d, timespan: [{tsr0: [%d, %d]}]}}", name, "o_orderkey", "o_custkey", F.col("o_custkey") + 30)
    A.table(spark, sf_dir, "orders").select(F.when(F.col("o_orderkey") % 3 == 0, "- { meta: no activity }").otherwise(line).alias("value")).write.text(folder)
    told = files.read_activities(spark, folder, 30.0)
    return told.groupBy("activity").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("f0").cast("long")).alias("f0"), F.sum(F.col("f1").cast("long")).alias("f1"), F.max("start_s").alias("last_start"))


@query("SELECT frame::INT AS frame, count(*) AS n, max(abs(height))::DOUBLE AS most FROM (SELECT l_partkey % 500 AS frame, (l_quantity * 7)::INT AS height FROM lineitem) GROUP BY frame")
def geometry_read(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Heights of boxes from annotation lines, upside down or not."""
    folder = files.scratch_folder(spark, "geometry")
    top = F.when(F.col("l_linenumber") % 2 == 0, F.lit(5)).otherwise(5 + (F.col("l_quantity") * 7).cast("int"))
    foot = F.when(F.col("l_linenumber") % 2 == 0, 5 + (F.col("l_quantity") * 7).cast("int")).otherwise(F.lit(5))
    line = F.format_string("- { geom: {id1: %d, ts0: %d, g0: 3 %d 40 %d}}", "l_orderkey", (F.col("l_partkey") % 500), top, foot)
    A.table(spark, sf_dir, "lineitem").select(line.alias("value")).write.text(folder)
    return files.read_geometry(spark, folder).groupBy("frame").agg(F.count(F.lit(1)).alias("n"), F.max("height").alias("most"))


@query("SELECT video, count(*) AS n, min(start_s) AS first FROM preds WHERE video % 3 <> 0 GROUP BY video")
def results_read(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Results of runs from a report's files; files that are no JSON, and folders that are missing, count as absent."""
    folder = files.scratch_folder(spark, "report")
    kept = A.preds(spark, sf_dir).where("video % 3 <> 0").select("video", "start_s")
    files.write_report(kept, None, folder)
    broken = A.preds(spark, sf_dir).where("video % 3 = 0").select(F.concat(F.lit("{video: "), "video").alias("value"))
    broken.write.text(f"{folder}/broken")
    schema = "video LONG, start_s DOUBLE"
    found = files.results_if_present(spark, [f"{folder}/events", f"{folder}/broken"], schema, lines=True).unionByName(files.results_if_present(spark, f"{folder}/missing", schema))
    return found.groupBy("video").agg(F.count(F.lit(1)).alias("n"), F.min("start_s").alias("first"))


@query("SELECT event_id, CASE WHEN lpad((event_id % 24)::VARCHAR, 2, '0') = lpad((video % 24)::VARCHAR, 2, '0') THEN 1 ELSE 2 END AS n, 'src/day/' || lpad((video % 24)::VARCHAR, 2, '0') AS first FROM candidates")
def source_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where a recording may be kept: by the hour of its end, then by that of its start."""
    clock = lambda c: F.concat(F.lpad((F.col(c) % 24).cast("string"), 2, "0"), F.lit("-05-00"))
    names = files.source_names(clock("event_id"), clock("video"), "src/day")
    return A.candidates(spark, sf_dir).select("event_id", F.size(names).alias("n"), names[0].alias("first"))


@query("SELECT event_id, count(*) AS n, min(q) AS first FROM (SELECT event_id, trim(unnest(string_split(description || ' ; ;' || evidence || ';', ';'))) AS q FROM candidates) WHERE q <> '' GROUP BY event_id")
def query_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Queries from lists with semicolons."""
    asked = X.query_list(F.concat("description", F.lit(" ; ;"), "evidence", F.lit(";")))
    return A.candidates(spark, sf_dir).select("event_id", F.explode(asked).alias("q")).groupBy("event_id").agg(F.count(F.lit(1)).alias("n"), F.min("q").alias("first"))


# Streams over windows of time, and the stub.

STREAMED = """streamed AS (SELECT event_id, video, description, floor(h * 1000 + 0.5) / 1000 AS t, ts FROM base JOIN (SELECT event_id, ts FROM events) USING (event_id)), ahead AS (SELECT max(epoch_us(ts)) - 86400000000 AS passed FROM events)"""


@query(
    """SELECT k * 32400 AS begins, description AS kind, count(*) AS n FROM (SELECT description, unnest(range((epoch_us(ts) // 1000000 - 43200) // 32400 + 1, epoch_us(ts) // 1000000 // 32400 + 1)) AS k FROM streamed)
WHERE (k * 32400 + 43200) * 1000000 <= (SELECT passed FROM ahead) GROUP BY k, description""",
    STREAMED,
)
def streamed_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts by sliding windows of 12 hours every 9 from a stream: the windows that the watermark, a day behind, has closed."""
    source = lambda: A.event_stream(spark, sf_dir).select("ts", F.col("event_type").alias("kind"))
    counted = timelines.run_to_end(spark, lambda: timelines.stream_counts(source()), files.scratch_folder(spark, "windows"))
    return counted.select(F.unix_seconds("start").alias("begins"), "kind", "n")


@query(
    """SELECT video, min(us) // 1000000 AS begins, max(us) // 1000000 AS last, count(*) AS n FROM (
  SELECT *, sum(fresh) OVER (PARTITION BY video ORDER BY us) AS s FROM (
    SELECT video, epoch_us(ts) AS us, CASE WHEN epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY video ORDER BY ts) < 43200000000 THEN 0 ELSE 1 END AS fresh FROM streamed))
GROUP BY video, s HAVING max(us) + 43200000000 <= (SELECT passed FROM ahead)""",
    STREAMED,
)
def streamed_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sessions without a gap of 12 hours from a stream, those that the watermark has closed."""
    source = lambda: A.event_stream(spark, sf_dir).select("ts", F.col("user_id").alias("video"))
    found = timelines.run_to_end(spark, lambda: timelines.sessions(source(), "12 hours"), files.scratch_folder(spark, "sessions"))
    return found.select("video", F.unix_seconds("start").alias("begins"), (F.unix_seconds("end") - 43_200).alias("last"), "n")


def _mod(dropped: int, modulus: int) -> str:
    digits = f"list_transform(range(1, {41 - dropped // 4}), lambda i: (position(substr(hex, i, 1) IN '0123456789abcdef') - 1)::BIGINT)"
    return f"list_reduce(list_concat([0::BIGINT], {digits}), lambda a, d: (a * 16 + d) % {modulus})"


@query(
    """SELECT video, index, query, printf('%.3f', s) AS start_s, printf('%.3f', least(end_s, s + (end_s - start_s) * (0.15::DOUBLE + m35 / 100.0::DOUBLE))) AS end_s, printf('%.3f', 0.4::DOUBLE + m55 / 100.0::DOUBLE) AS confidence
FROM (SELECT *, start_s + (end_s - start_s) * (0.0::DOUBLE + m40 / 100.0::DOUBLE) AS s FROM hashed) WHERE m100 >= 45""",
    f"""asked AS (SELECT w.*, d AS query FROM windows w, (SELECT DISTINCT description AS d FROM truths)),
hexed AS (SELECT index, query, sha1('vrs:' || index || ':' || query) AS hex FROM (SELECT DISTINCT index, query FROM asked)),
keyed AS MATERIALIZED (SELECT index, query, {_mod(0, 100)} AS m100, {_mod(8, 40)} AS m40, {_mod(16, 35)} AS m35, {_mod(24, 55)} AS m55 FROM hexed),
hashed AS (SELECT * FROM asked JOIN keyed USING (index, query))""",
)
def stub_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the stub answers to every request of a run, read as any answer is."""
    asked = A.truths(spark, sf_dir).select(F.col("description").alias("query")).distinct()
    requests = grids.expand_requests(grids.plan_windows(A.media(spark, sf_dir)), asked, "overlay")
    told = responses.events_of(responses.parse_responses(backends.stub()(requests))).select("video", "index", "query", "e")
    text = lambda name: F.format_string("%.3f", F.col(f"e.{name}")).alias(name)
    return told.select("video", "index", "query", text("start_s"), text("end_s"), text("confidence"))
