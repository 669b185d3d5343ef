import json

import pandas as pd
import pytest
from pyspark.sql import functions as F

from spanwright import config as C
from spanwright import errors as E
from spanwright.errors import BudgetExceeded, InvalidInput, Misconfigured
from spanwright.operators import quality
from spanwright.plans import backends, find
from spanwright.sources import adapters as A
from spanwright.sources import files
from spanwright.streaming import timelines


def test_config_rules():
    assert C.load_config(windows__fps=4.0, strategy=None).windows.fps == 4.0
    with pytest.raises(Misconfigured):
        C.load_config(windows__stride_s=20.0)
    with pytest.raises(Misconfigured):
        C.with_overrides(C.Config(), nothing__here=1)


def test_find_by_windows_with_stub(spark):
    media = spark.createDataFrame([(1, 60.0), (2, 30.0)], "video long, duration_s double")
    queries = spark.createDataFrame([(" a door opens ",), ("",), ("a car stops",)], "query string")
    events = find.find_by_windows(media, None, queries, C.Config(), backends.stub()).collect()
    assert events and all(0 <= e.start_s <= e.end_s <= 60 and 0 <= e.confidence <= 0.97 for e in events)
    with pytest.raises(InvalidInput):
        find.checked_queries(queries.union(queries), C.Config())
    with pytest.raises(BudgetExceeded):
        find.find_by_windows(media, None, queries, C.with_overrides(C.Config(), limits__max_calls=3), backends.stub())


def test_served_backend_runs_on_executors(spark):
    requests = spark.createDataFrame([(1, 0, "q")], "video long, index int, query string")
    got = backends.make_backend("served", call=lambda part: pd.Series(['{"events": []}'] * len(part)))(requests).first()
    assert got.raw == '{"events": []}' and got.stub is False


def test_find_by_states(spark):
    media = spark.createDataFrame([(1, 20.0)], "video long, duration_s double")
    captions = spark.createDataFrame([(1, "door", float(t), "The door is open." if 4 <= t <= 8 else "The door is closed.") for t in range(15)], "video long, subject string, t double, text string")
    queries = spark.createDataFrame([("a door opens",), ("a dog barks",)], "query string")
    pairs = spark.createDataFrame([("a door opens", "the door is closed", "the door is open")], "description string, state_a string, state_b string")
    events, declined = find.find_by_states(media, captions, queries, pairs, C.Config())
    assert [(e.start_s, e.end_s) for e in events.collect()] == [(3.5, 8.5)]
    assert [r.description for r in declined.collect()] == ["a dog barks"]


def test_evaluate_parts(spark, sf_dir):
    report = find.evaluate(A.preds(spark, sf_dir), A.truths(spark, sf_dir), A.axes(spark, sf_dir))
    assert report["mixed_controls"].count() == 1
    assert "positive_control" not in {r.axis for r in report["by_axis"].collect()}


def test_readers(spark, tmp_path):
    (tmp_path / "labels.json").write_text(json.dumps([{"video": "a", "axis": "short", "duration_s": 9, "extra": 1, "events": [{"description": "x", "start_s": 1, "end_s": 2}]}, {"video": "b", "axis": "negative", "events": []}]))
    truths, axes = files.read_labels(spark, str(tmp_path / "labels.json"))
    assert truths.count() == 1 and axes.count() == 2
    (tmp_path / "states.json").write_text(json.dumps({"_note": "no", "x": ["a", "b"]}))
    assert [tuple(r) for r in files.read_states_map(spark, str(tmp_path / "states.json")).collect()] == [("x", "a", "b")]
    (tmp_path / "m.tsv").write_text("# c\nid\tgated\tmax_model_len\tmin_vram_gib\trole\n\nm1\tno\t100\t8\tmain\n")
    assert [r.model for r in files.read_registry(spark, str(tmp_path / "m.tsv")).collect()] == ["m1"]
    (tmp_path / "act.txt").write_text("- { act: {act3: { Opens_Door: 1.0}, timespan: [{tsr0: [30, 90]}]}}\n- nothing\n")
    assert [(r.activity, r.start_s, r.end_s) for r in files.read_activities(spark, str(tmp_path / "act.txt"), 30.0).collect()] == [("Opens_Door", 1.0, 3.0)]
    (tmp_path / "geom.txt").write_text("- { geom: {ts0: 12, g0: 1 20 5 80}}\n")
    assert [(r.frame, r.height) for r in files.read_geometry(spark, str(tmp_path / "geom.txt")).collect()] == [(12, 60.0)]


def stream_of(spark, folder, late, carry_s):
    schema = "video long, t double, state string"
    return lambda: timelines.stream_transitions(spark.readStream.schema(schema).option("recursiveFileLookup", "true").parquet(str(folder / "in")), late, carry_s)


def test_stream_transitions_equal_batch(spark, sf_dir, tmp_path):
    from spanwright.operators import states

    polls = A.polls(spark, sf_dir).select("video", "t", "state")
    # Each poll comes at most 100 s late; the last rows push the watermark beyond all others.
    wave = (F.floor((F.col("t") + F.pmod(F.hash("video", "t"), F.lit(100))) / 250)).cast("int")
    waves = polls.withColumn("wave", wave).cache()
    for k in range(4):
        waves.where(F.col("wave") == k).select("video", "t", "state").coalesce(1).write.parquet(str(tmp_path / "in" / f"w{k}"))
        got = timelines.run_to_end(spark, stream_of(spark, tmp_path, "100 seconds", 30.0), str(tmp_path / "out"))
    spark.createDataFrame([(-1, 5_000.0, "x")], "video long, t double, state string").coalesce(1).write.parquet(str(tmp_path / "in" / "end"))
    got = timelines.run_to_end(spark, stream_of(spark, tmp_path, "100 seconds", 30.0), str(tmp_path / "out"))
    rows = sorted((r.video, r.lo, r.hi, r.to_state) for r in got.collect())
    want = sorted((r.video, r.lo, r.hi, r.to_state) for r in states.transitions(polls, ["video"], 30.0).collect())
    assert rows == want and len(want) < states.transitions(polls, ["video"]).count()


def test_stream_transitions_place_late_polls_and_forget_silent_clips(spark, tmp_path):
    def step(*rows):
        spark.createDataFrame(rows, "video long, t double, state string").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        found = timelines.run_to_end(spark, stream_of(spark, tmp_path, "10 seconds", 20.0), str(tmp_path / "out"))
        held = spark.read.format("statestore").option("stateVarName", "last").load(str(tmp_path / "out" / "progress"))
        return {(r.video, r.lo, r.hi) for r in found.collect()}, {r.v for r in held.select(F.col("key.video").alias("v")).collect()}

    assert step((1, 1.0, "a"), (1, 3.0, "b"), (2, 1.0, "a"), (3, 5.0, "x")) == (set(), set())
    # The poll at 2 s comes after that at 3 s and before the watermark: the change is between 1 s and 2 s.
    told, held = step((1, 2.0, "b"), (1, 2.5, None), (3, 22.0, "y"))
    assert told == {(1, 1.0, 2.0)} and held == {1, 2, 3}
    # Clip 2 changes after a gap over 20 s, which is no transition; clip 1 is silent and forgotten; a poll at 5 s is too late.
    told, held = step((2, 30.0, "b"), (9, 45.0, "z"))
    assert told == {(1, 1.0, 2.0), (3, 5.0, 22.0)} and held == {2, 3}
    told, held = step((1, 5.0, "q"), (9, 200.0, "z"))
    assert told == {(1, 1.0, 2.0), (3, 5.0, 22.0)} and not held & {1, 2, 3}
    with pytest.raises(Misconfigured):
        timelines.stream_transitions(spark.readStream.schema("video long, t double, state string").parquet(str(tmp_path / "in")))


def test_stream_windows(spark, tmp_path):
    rows = spark.range(100).select(F.timestamp_seconds(F.col("id") * 3600).alias("ts"), F.lit("k").alias("kind"))
    rows.write.parquet(str(tmp_path / "in"))
    source = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    q = timelines.stream_counts(source).writeStream.format("memory").queryName("counts").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination()
    assert spark.table("counts").agg(F.max("n")).first()[0] == 12


def test_contract(spark, tmp_path):
    assert json.loads(files.contract_json())["type"] == "struct"
    event = {"description": "x", "start_s": 1.0, "end_s": 2.0, "confidence": 0.5, "evidence": "", "partial": False, "source_windows": [0]}
    (tmp_path / "good.json").write_text(json.dumps({"video": "a", "duration_s": 5.0, "queries": ["x"], "events": [event]}))
    (tmp_path / "bad.json").write_text(json.dumps({"video": "b", "duration_s": 1.5, "queries": ["x"], "events": [event | {"start_s": 1.2}, event]}))
    got = {(r.video, r.violation) for r in files.result_violations(spark, str(tmp_path / "*.json")).collect()}
    assert got == {("b", "an event outside the contract"), ("b", "events out of order")}


def test_states_run_asks_the_backend(spark):
    """Reversed pairs share one sweep, the target is each description's own, and a run that cannot be made is refused."""
    media = spark.createDataFrame([(1, 20.0)], "video long, duration_s double")
    queries = spark.createDataFrame([("a door opens",), ("a door closes",), ("a dog barks",)], "query string")
    shut, wide = "the door is closed", "the door is open"
    pairs = spark.createDataFrame([("a door opens", shut, wide), ("a door closes", wide, shut)], "description string, state_a string, state_b string")
    asked = spark.sparkContext.accumulator(0)

    def caption(part):
        asked.add(len(part))
        return pd.Series(["The door is open." if 4 <= t <= 8 else "The door is closed." for t in part["t"]])

    seer = backends.served(lambda part: pd.Series(["{}"] * len(part)), caption=caption)
    events, declined = find.find_by_states(media, None, queries, pairs, C.Config(), seer)
    got = sorted((e.description, e.start_s, e.end_s) for e in events.collect())
    assert got == [("a door closes", 0.0, 3.5), ("a door closes", 8.5, 20.0), ("a door opens", 3.5, 8.5)]
    assert [r.description for r in declined.collect()] == ["a dog barks"]
    with pytest.raises(E.BudgetExceeded):
        find.find_by_states(media, None, queries, pairs, C.with_overrides(C.Config(), limits__max_calls=3), seer)
    with pytest.raises(E.Misconfigured):
        find.find_by_states(media, None, queries, pairs, C.Config(), backends.stub())
    with pytest.raises(E.InvalidInput):
        find.find_by_states(media, None, queries, pairs, C.Config())


def test_media_bounds_are_errors(spark):
    clips = spark.createDataFrame([(1, 20.0, 10), (2, 30.0, 5 << 30)], "video long, duration_s double, size_bytes long")
    assert find.media_in_bounds(clips.where("video = 1"), C.Config()).count() == 1
    for bad in (clips, clips.select("video", (F.col("duration_s") * 1e6).alias("duration_s"))):
        with pytest.raises(E.UnprocessableMedia):
            find.media_in_bounds(bad, C.Config())


def test_evaluation_guards(spark, sf_dir):
    preds, truths, axes = A.preds(spark, sf_dir), A.truths(spark, sf_dir), A.axes(spark, sf_dir)
    runs = axes.select("video", F.lit(False).alias("stub"))
    few = find.evaluate(preds, truths, axes, runs, limit=3)["overall"].first()
    videos = [r.video for r in axes.orderBy("video").limit(3).collect()]
    own = lambda x: x.where(F.col("video").isin(videos))
    assert few == find.evaluate(own(preds), own(truths), own(axes))["overall"].first()
    with pytest.raises(E.InvalidInput):
        find.evaluate(preds, truths, axes, runs.withColumn("stub", F.col("video") == videos[0]))


def test_results_that_are_missing_or_broken(spark, tmp_path):
    schema = "model STRING, score DOUBLE"
    assert files.results_if_present(spark, str(tmp_path / "*.json"), schema).count() == 0
    (tmp_path / "a.json").write_text('{"model": "a", "score": 0.5}')
    (tmp_path / "b.json").write_text("not json")
    assert [tuple(r) for r in files.results_if_present(spark, str(tmp_path / "*.json"), schema).collect()] == [("a", 0.5)]


def test_finding(spark):
    rows = spark.createDataFrame([("a", 1, 3.0), ("b", 2, 1.25), ("c", 3, None)], "prompt string, fps int, median_error double")
    assert quality.finding(rows, ["prompt", "fps"]).first().text == "best: prompt=b fps=2 with an error of 1.25 s"
    assert quality.finding(rows.where("prompt = 'c'"), ["prompt", "fps"]).first().text == "no combination reported an event"


def test_detection_threshold(spark):
    asked = spark.createDataFrame([(k, k / 4) for k in range(5)], "k long, p double")
    seer = backends.Backend("told", lambda x: x, detect=lambda x: x.withColumn("p_yes", F.col("p")))
    assert sorted(r.k for r in backends.detected(asked, seer).collect()) == [2, 3, 4]
