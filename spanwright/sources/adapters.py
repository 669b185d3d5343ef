"""The engine's relations, made from the test tables. One second of a recording is one hour of ``events.ts``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.intervals import rounded

DURATION = 720.0


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def hours(ts: str = "ts") -> Column:
    """Hours since 2024-01-01, unrounded."""
    return F.expr(f"timestampdiff(MICROSECOND, TIMESTAMP_NTZ'2024-01-01 00:00:00', CAST({ts} AS TIMESTAMP_NTZ))") / F.lit(3.6e9)


def days(ts: str, origin: str) -> Column:
    return F.datediff(F.col(ts).cast("date"), F.lit(origin).cast("date")).cast("double")


def candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """video, description, event_id, start_s, end_s, confidence, window_index, evidence."""
    h = hours()
    return table(spark, sf_dir, "events").select(
        F.col("user_id").alias("video"),
        F.col("event_type").alias("description"),
        "event_id",
        rounded(h, 3).alias("start_s"),
        rounded(h + F.col("value") * 0.5, 3).alias("end_s"),
        (F.col("event_id") % 101 / 100.0).alias("confidence"),
        F.floor(h / 9).cast("int").alias("window_index"),
        F.concat(F.lit("event "), F.col("event_id")).alias("evidence"),
    )


def preds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return candidates(spark, sf_dir).where(F.col("event_id") % 3 != 0)


def truths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return candidates(spark, sf_dir).where((F.col("event_id") % 3 == 0) & F.col("description").isin("click", "view", "purchase"))


def axes(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = F.array(*[F.lit(x) for x in ("baseline", "short", "long", "positive_control")])
    return table(spark, sf_dir, "events").select(F.col("user_id").alias("video")).distinct().withColumn("axis", F.get(names, (F.col("video") % 4).cast("int")))


def media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select(F.col("user_id").alias("video")).distinct().withColumn("duration_s", F.lit(DURATION))


def clips(spark: SparkSession, sf_dir: str) -> DataFrame:
    """video, duration_s: clips of different lengths, from none to longer than all their frames."""
    video = F.col("user_id")
    length = F.when(video % 11 == 0, 0.0).otherwise((video % 7) * 130.0 + (video % 4) * 0.25 + 1.5)
    return table(spark, sf_dir, "events").select(video.alias("video"), length.alias("duration_s")).distinct()


def frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select(F.col("user_id").alias("video"), "event_id", rounded(hours(), 3).alias("t"))


def polls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return polls_of(table(spark, sf_dir, "events"))


def event_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events table's files as a stream. A pattern may name a file or a folder, a plain path only a folder."""
    events = table(spark, sf_dir, "events")
    rows = spark.readStream.schema(events.schema).parquet(f"{sf_dir}/events.parque[t]")
    return rows.withColumn("ts", F.col("ts").cast("timestamp"))


def poll_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """polls as a stream of the table's files."""
    return polls_of(event_stream(spark, sf_dir))


def polls_of(events: DataFrame) -> DataFrame:
    state = F.when(F.col("event_type").isin("purchase", "signup"), "open").when(F.col("event_type").isin("click", "view"), "closed")
    return events.select(F.col("user_id").alias("video"), "event_id", rounded(hours(), 3).alias("t"), state.alias("state"), F.col("event_type").alias("text"))


#: Vectors of a clip.
CLIP_FRAMES = 50


def pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """video (a run of CLIP_FRAMES vectors), t, arr."""
    video = F.floor(F.col("vec_id") / CLIP_FRAMES)
    return table(spark, sf_dir, "embeddings").select(video.alias("video"), (F.col("vec_id") - video * CLIP_FRAMES).cast("double").alias("t"), F.col("embedding").alias("arr"))


CAPTIONS = (
    "The door is closed.",
    "<think>It might be closed at first.</think> The door is open.",
    "Okay, let me look. The door is closed.",
    "The door is closed in the first frames and then opens.",
    "Its state (open/closed) does not change; it stays closed.",
    "A person walks past a wall.",
    "car door: the car door is open\nbuilding door: closed",
)


def captions(spark: SparkSession, sf_dir: str) -> DataFrame:
    texts = F.array(*[F.lit(x) for x in CAPTIONS])
    return table(spark, sf_dir, "events").select("event_id", F.col("user_id").alias("video"), F.get(texts, (F.col("event_id") % 7).cast("int")).alias("text"))


#: Responses of a model in the shapes that occur; %s and %e stand for the row's times.
RESPONSES = (
    '<think>Something moves.</think>{"events": [{"start_s": %s, "end_s": %e, "confidence": 0.9, "evidence": "seen"}]}',
    '{"events": [{"start_s": %s, "end_s": %e, "confidence": 0.8, "evidence": "seen"}]}',
    '```json\n{"events": [{"start_s": %s, "end_s": %e, "confidence": 0.7, "evidence": "seen"}]}\n```',
    'Here it is: {"events": [{"start_s": %s, "end_s": %e, "confidence": 0.6, "evidence": "seen"}]} as asked.',
    '{"events": []}',
    '{"events": [{"start_s": %s, "end_s": %e, "confidence": 0.5',
    "I cannot see that in these frames.",
    '[{"start_s": 9999.0, "end_s": 10001.0, "confidence": 1.0, "evidence": "far away"}]',
    '{"events": [{"start_s": %ss, "end_s": %es, "confidence": 0-1, "evidence": "units"}]}',
    '<think>It was cut off while',
)


def raw_responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """event_id, video, start_s, end_s of the window, raw."""
    h = hours()
    start, end = rounded(h, 3), rounded(h + F.col("value") * 0.5, 3)
    raw = F.get(F.array(*[F.lit(x) for x in RESPONSES]), (F.col("event_id") % 10).cast("int"))
    told = lambda x: F.format_string("%.3f", x)
    return table(spark, sf_dir, "events").select("event_id", F.col("user_id").alias("video"), (start - 1).alias("start_s"), (end + 1).alias("end_s"), F.replace(F.replace(raw, F.lit("%s"), told(start)), F.lit("%e"), told(end)).alias("raw"))


def order_intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """video (customer), order_id, start_s (day of the order from 1995-01-01), end_s (start and the order's quantity)."""
    sums = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.sum("l_quantity").alias("q"))
    start = days("o_orderdate", "1995-01-01")
    return table(spark, sf_dir, "orders").join(sums, F.col("o_orderkey") == F.col("l_orderkey")).select(F.col("o_custkey").alias("video"), F.col("o_orderkey").alias("order_id"), start.alias("start_s"), (start + F.col("q")).alias("end_s"))


def boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """clip, frame, height."""
    return table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("clip"), days("l_shipdate", "1992-01-01").cast("int").alias("frame"), (F.col("l_quantity") * 16).alias("height"))


def activities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """activity_id, clip, f0, f1, activity: thirty-day spans beginning at orders' days."""
    day = days("o_orderdate", "1992-01-01").cast("int")
    clips = table(spark, sf_dir, "lineitem").where("l_linenumber = 1").select("l_orderkey", F.col("l_suppkey").alias("clip")).groupBy("l_orderkey").agg(F.min("clip").alias("clip"))
    return table(spark, sf_dir, "orders").join(clips, F.col("o_orderkey") == F.col("l_orderkey")).select(F.col("o_orderkey").alias("activity_id"), "clip", day.alias("f0"), (day + 30).alias("f1"), F.col("o_orderpriority").alias("activity"))
