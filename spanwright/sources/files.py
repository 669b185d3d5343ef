"""Readers and writers of the engine's file formats."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

LABELS = "video STRING, axis STRING, duration_s DOUBLE, events ARRAY<STRUCT<description: STRING, start_s: DOUBLE, end_s: DOUBLE>>"
RESULT = "video STRING, duration_s DOUBLE, queries ARRAY<STRING>, events ARRAY<STRUCT<description: STRING, start_s: DOUBLE, end_s: DOUBLE, confidence: DOUBLE, evidence: STRING, partial: BOOLEAN, source_windows: ARRAY<INT>>>"


def contract_json() -> str:
    """The result contract as a JSON schema of Spark's."""
    return StructType.fromDDL(RESULT).json()


def media_files(spark: SparkSession, path: str) -> DataFrame:
    """path, length of recordings in a folder; their contents are not read."""
    return spark.read.format("binaryFile").load(path).select("path", "length")


def write_labels(truths: DataFrame, axes: DataFrame, path: str) -> None:
    """One document a clip, one a line: its axis and its events (description, start_s, end_s), by start."""
    event = F.struct("start_s", "end_s", "description")
    nested = truths.groupBy("video").agg(F.sort_array(F.collect_list(event)).alias("events"))
    labelled = axes.join(nested, "video", "left").select(F.col("video").cast("string").alias("video"), "axis", F.coalesce("events", F.array().cast("array<struct<start_s:double,end_s:double,description:string>>")).alias("events"))
    labelled.write.mode("overwrite").json(path)


def read_labels(spark: SparkSession, path: str, lines: bool = False) -> tuple[DataFrame, DataFrame]:
    """(truths, axes). A clip without events has an axis and no truth; keys beyond the schema are ignored. lines: one document a line."""
    clips = spark.read.schema(LABELS).json(path, multiLine=not lines)
    truths = clips.select("video", F.posexplode("events").alias("ord", "e")).select("video", "e.description", F.col("ord").cast("long").alias("event_id"), "e.start_s", "e.end_s")
    return truths, clips.select("video", "axis").where("axis IS NOT NULL").distinct()


def read_cases(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """One probe case for each clip and description, with its intervals in order."""
    truths, axes = read_labels(spark, path, lines)
    cases = truths.groupBy("video", "description").agg(F.sort_array(F.collect_list(F.struct("start_s", "end_s"))).alias("events"))
    return cases.join(axes, "video", "left")


def read_states_map(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """description, state_a, state_b of a JSON object (lines: one a line); keys that begin with _ are comments."""
    text = spark.read.text(path, wholetext=not lines)
    pairs = text.select(F.explode(F.from_json("value", "MAP<STRING, STRING>")).alias("description", "v")).where(~F.startswith("description", F.lit("_")))
    states = F.from_json("v", "ARRAY<STRING>")
    return pairs.select("description", F.get(states, 0).alias("state_a"), F.get(states, 1).alias("state_b"))


def read_registry(spark: SparkSession, path: str) -> DataFrame:
    """The model registry: tab-separated, # for comments, blank lines skipped."""
    return spark.read.csv(path, sep="\t", comment="#", schema="model STRING, gated STRING, max_model_len STRING, min_vram_gib STRING, role STRING").where("model IS NOT NULL AND model <> 'id'").select("model", "gated", F.col("max_model_len").try_cast("int").alias("max_model_len"), F.col("min_vram_gib").try_cast("int").alias("min_vram_gib"), "role")


def _number(pattern: str, group: int, line: str = "value") -> Column:
    return F.regexp_extract(line, pattern, group).cast("double")


def read_activities(spark: SparkSession, path: str, fps: float) -> DataFrame:
    """clip, activity, f0, f1, start_s, end_s from annotation lines with act3 and a tsr0 frame span."""
    name, span = r"act\d\s*:\s*\{\s*([A-Za-z_]+)", r"tsr0\s*:\s*\[\s*(\d+)\s*,\s*(\d+)\s*\]"
    lines = spark.read.text(path).withColumn("clip", F.element_at(F.split(F.input_file_name(), "/"), -1)).where(F.col("value").rlike(name) & F.col("value").rlike(span))
    f0, f1 = _number(span, 1), _number(span, 2)
    return lines.select("clip", F.regexp_extract("value", name, 1).alias("activity"), f0.cast("int").alias("f0"), f1.cast("int").alias("f1"), F.round(f0 / fps, 3).alias("start_s"), F.round(f1 / fps, 3).alias("end_s"))


def read_geometry(spark: SparkSession, path: str) -> DataFrame:
    """clip, frame, height from annotation lines with ts0 and a g0 box."""
    frame, box = r"ts0\s*:\s*(\d+)", r"g0\s*:\s*(-?\d+)\s+(-?\d+)\s+(-?\d+)\s+(-?\d+)"
    lines = spark.read.text(path).withColumn("clip", F.element_at(F.split(F.input_file_name(), "/"), -1)).where(F.col("value").rlike(frame) & F.col("value").rlike(box))
    return lines.select("clip", F.regexp_extract("value", frame, 1).cast("int").alias("frame"), F.abs(_number(box, 4) - _number(box, 2)).alias("height"))


def write_report(events: DataFrame, polls: DataFrame | None, path: str) -> None:
    """Events, and polls beside them in a folder of their own, as JSON."""
    events.write.mode("overwrite").json(f"{path}/events")
    if polls is not None:
        polls.write.mode("overwrite").json(f"{path}/polls")


def result_violations(spark: SparkSession, path: str) -> DataFrame:
    """video, violation: what breaks the output contract in result documents; an evaluation report is told as such."""
    docs = spark.read.schema(RESULT + ", by_axis STRING").json(path, multiLine=True)
    bad = F.exists("events", lambda e: (e["start_s"] < 0) | (e["end_s"] > F.col("duration_s") + 1e-6) | (e["end_s"] < e["start_s"]) | ~e["confidence"].between(0, 1))
    order = F.transform("events", lambda e: F.struct(e["start_s"].alias("s"), e["end_s"].alias("e")))
    rules = F.array_compact(
        F.array(
            F.when(F.col("by_axis").isNotNull(), "an evaluation report, not a result"),
            F.when(F.col("video").isNull(), "no video"),
            F.when(bad, "an event outside the contract"),
            F.when(order != F.sort_array(order), "events out of order"),
        )
    )
    return docs.select("video", F.explode(rules).alias("violation"))


def source_names(start: Column, stop: Column, prefix: str) -> Column:
    """Candidate names of a recording: by its end hour first, then its start hour if that differs."""
    hour = lambda x: F.substring(x, 1, 2)
    return F.array_distinct(F.array(F.concat(F.lit(prefix + "/"), hour(stop)), F.concat(F.lit(prefix + "/"), hour(start))))


def scratch_folder(spark: SparkSession, name: str) -> str:
    """A new folder that all executors share: below spark.checkpoint.dir, or, in local mode only, a temporary one."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = tempfile.mkdtemp(prefix="spanwright-")
    return f"{base.rstrip('/')}/spanwright-{name}-{uuid.uuid4().hex[:12]}"


def results_if_present(spark: SparkSession, path: str | list[str], schema: str, lines: bool = False) -> DataFrame:
    """Rows of result files (lines: one a line); none where there is no such file, and none of what is not JSON."""
    try:
        found = spark.read.schema(f"{schema}, _corrupt STRING").option("multiLine", not lines).option("columnNameOfCorruptRecord", "_corrupt").json(path)
    except AnalysisException:
        return spark.createDataFrame([], schema)
    return found.where("_corrupt IS NULL").drop("_corrupt")
