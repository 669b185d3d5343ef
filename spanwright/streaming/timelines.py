"""State timelines and windows over streams."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..errors import Misconfigured
from ..shipping import ship_package

TRANSITION = "video LONG, at DOUBLE, from_state STRING, to_state STRING, lo DOUBLE, hi DOUBLE"
#: Where a stream's time 0 stands, in ms from 1970: a stream begins with a watermark of 1970, and what is not above it counts as late.
ZERO_MS = 1_000_000_000_000
#: Keyed state with timers needs this store.
STORE = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class Timeline(StatefulProcessor):
    """A clip's polls, held until the watermark passes them, then met in order with the last known state.

    State of a clip: the last known poll (ms, t, state), and the polls that the watermark has not passed. A timer stands at the
    first of those; without any, at the end of the time that the last state may be carried, where the clip's state goes.
    """

    def __init__(self, carry_s: float | None) -> None:
        self.carry_s = carry_s

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", "ms LONG, t DOUBLE, state STRING")
        self.waiting = handle.getListState("waiting", "ms LONG, t DOUBLE, nth LONG, state STRING")

    def _wake(self, ms: int) -> None:
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        self.handle.registerTimer(ms)

    def handleInputRows(self, key: tuple[Any, ...], rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        found = [(int(ms), float(t), int(n), str(s)) for part in rows for ms, t, n, s in zip(part["ms"], part["t"], part["nth"], part["state"], strict=True)]
        if found:
            self.waiting.appendList(found)
            first = min(x[0] for x in found)
            due = [int(x) for x in self.handle.listTimers()]
            # A timer for the last state's end gives way: the polls that wait are met first.
            held = len(due) == 1 and self.last.exists() and self.carry_s is not None and due[0] == self._end(self.last.get())
            self._wake(first if held or not due else min(first, *due))
        return iter([])

    def _end(self, last: tuple) -> int:
        return int(last[0] + self.carry_s * 1000) + 1

    def handleExpiredTimer(self, key: tuple[Any, ...], timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        passed = timerValues.getCurrentWatermarkInMs()
        rows = sorted((int(r[0]), float(r[1]), int(r[2]), str(r[3])) for r in self.waiting.get()) if self.waiting.exists() else []
        due, later = [r for r in rows if r[0] < passed], [r for r in rows if r[0] >= passed]
        last = tuple(self.last.get()) if self.last.exists() else None
        out = []
        for row in ((ms, t, s) for ms, t, _, s in due):
            if last is not None and row[2] != last[2] and (self.carry_s is None or row[1] - last[1] <= self.carry_s):
                out.append((key[0], math.floor((last[1] + row[1]) / 2 * 1000 + 0.5) / 1000, last[2], row[2], last[1], row[1]))
            last = row
        if later:
            self.waiting.put(later)
        elif rows:
            self.waiting.clear()
        if last is not None:
            if self.carry_s is not None and self._end(last) < passed and not later:
                self.last.clear()
            else:
                self.last.update(last)
                if not later and self.carry_s is not None:
                    self._wake(self._end(last))
        if later:
            self._wake(later[0][0])
        yield pd.DataFrame(out, columns=["video", "at", "from_state", "to_state", "lo", "hi"])

    def close(self) -> None:
        pass


def stream_transitions(polls: DataFrame, late: str = "1 minute", carry_s: float | None = None) -> DataFrame:
    """Transitions of a stream of polls (video, t in seconds, state), each told once the watermark has passed its second poll.

    Event time is t, counted from ZERO_MS, so that no poll is late by where its clip's time begins. Polls that come at most `late` behind the newest are put in their place, later ones are dropped. A state is carried over at
    most carry_s of unobserved time: a change across a longer gap is none, and the state of a clip that is silent for longer is
    removed. The same rows as operators.states.transitions() over all polls that the watermark has passed.
    """
    spark = polls.sparkSession
    if spark.conf.get(STORE, "") != ROCKSDB:
        raise Misconfigured(f"state with timers needs {STORE}={ROCKSDB}")
    ship_package(spark)
    # Polls of one time follow each other by event_id, if they have one.
    nth = F.col("event_id").cast("long") if "event_id" in polls.columns else F.lit(0).cast("long")
    known = polls.where("state IS NOT NULL AND t IS NOT NULL").select("video", "t", nth.alias("nth"), "state", (F.floor(F.col("t") * 1000).cast("long") + ZERO_MS).alias("ms"))
    known = known.withColumn("ts", F.timestamp_millis("ms")).withWatermark("ts", late)
    return known.groupBy("video").transformWithStateInPandas(Timeline(carry_s), TRANSITION, "Append", "EventTime")


def run_to_end(spark: SparkSession, stream: Callable[[], DataFrame], folder: str) -> DataFrame:
    """Run the stream that a function makes over what its sources hold now, into Parquet below folder; all rows written there."""
    before = spark.conf.get(STORE, None)
    spark.conf.set(STORE, ROCKSDB)
    try:
        rows = stream()
        rows.writeStream.format("parquet").option("path", f"{folder}/rows").option("checkpointLocation", f"{folder}/progress").trigger(availableNow=True).start().awaitTermination()
    finally:
        spark.conf.set(STORE, before) if before else spark.conf.unset(STORE)
    return spark.read.schema(rows.schema).parquet(f"{folder}/rows")


def stream_counts(events: DataFrame, late: str = "1 day", width: str = "12 hours", slide: str = "9 hours") -> DataFrame:
    """Counts by sliding window and kind (ts, kind), late rows beyond the watermark dropped."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", width, slide).alias("w"), "kind").agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), "kind", "n")


def sessions(events: DataFrame, gap: str = "30 minutes") -> DataFrame:
    """Gap sessions (ts, video), without a span cap: not the same as the capped merge."""
    return events.withWatermark("ts", "1 day").groupBy(F.session_window("ts", gap).alias("w"), "video").agg(F.count(F.lit(1)).alias("n")).select("video", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")
