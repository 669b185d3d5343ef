"""The recordings source, the contract's walk, and frames of windows."""

import json
import os

import pytest
from pyspark.sql import functions as F

from spanwright import config as C
from spanwright.operators import grids, responses
from spanwright.plans import backends, find
from spanwright.sources import contract, recordings


def exchanges(spark, n):
    i = F.col("id")
    return spark.range(n).select(F.concat(F.lit("v"), i % 20).alias("video"), F.lit("overlay").alias("prompt_variant"), (i % 5).cast("int").alias("index"), F.lit("q").alias("query"), F.concat(F.lit("raw "), "id").alias("raw"), (i / 4).alias("latency_s"))


def test_recordings_round_trip_and_loose_files(spark, tmp_path):
    folder = str(tmp_path / "rec")
    recordings.write_recordings(exchanges(spark, 200), folder, rows_per_file=3)
    recordings.write_recordings(exchanges(spark, 10), folder)
    (tmp_path / "rec" / "w0001-ab.json").write_text(json.dumps({"query": "q", "window": {"index": 3}, "raw": "old"}))
    (tmp_path / "rec" / "lines.json").write_text('{"query": "a", "video": "z", "prompt_variant": "p", "window": {"index": 0, "start_s": 1}, "raw": "1"}\n\n{"query": "a", "video": "z", "prompt_variant": "p", "window": {"index": 0}, "raw": "2"}\n')
    (tmp_path / "rec" / "bad.json").write_text("{")
    (tmp_path / "rec" / "other.json").write_text('{"query": "q"}')
    read = recordings.read_recordings(spark, folder)
    assert read.where("read_error IS NULL").count() == 213
    assert {r.filename: r.read_error.split(":")[0] for r in read.where("read_error IS NOT NULL").collect()} == {"bad.json": "JSONDecodeError", "other.json": "ValueError"}
    assert [r.raw for r in read.where("video = 'v3' AND index = 3").orderBy("latency_s").limit(1).collect()] == ["raw 3"]
    assert tuple(recordings.described(read).first()) == (213, 1, 2)
    first = {r.query: (r.raw, r.n) for r in recordings.first_recordings(read).where("video = 'z'").collect()}
    assert first == {"a": ("1", 2)}
    with pytest.raises(Exception, match="InvalidInput.*is no recording"):
        recordings.read_recordings(spark, folder, strict=True).count()
    with pytest.raises(Exception, match="BackendUnavailable"):
        recordings.read_recordings(spark, str(tmp_path / "nowhere")).count()
    # Wanted parts of the key: no file of another video is opened.
    assert recordings.read_recordings(spark, folder, video=["v3"], index=[3, 4]).count() == 11
    with pytest.raises(Exception, match="wanted by"):
        recordings.read_recordings(spark, folder, raw=["x"]).count()
    reader = recordings.RecordingsReader({"path": folder, "wanted": '{"video": ["v3"], "index": [3, 4]}'})
    names = [n for _, _, files in os.walk(folder) for n in files if n.startswith("g")]
    opened = [n for n in names if reader._may_hold(n)]
    assert 0 < len(opened) < len(names) / 4
    rows = [row for part in reader.partitions() for row in reader.read(part)]
    assert {row[0] for row in rows} == {"v3"} and len(rows) == 11
    recordings.write_recordings(exchanges(spark, 7), folder, overwrite=True)
    assert recordings.read_recordings(spark, folder, strict=True).count() == 7


def test_recordings_of_lost_tasks_do_not_count(spark, tmp_path):
    folder = str(tmp_path / "rec")
    schema = exchanges(spark, 1).schema
    rows = [tuple(r) for r in exchanges(spark, 4).collect()]
    writer = recordings.RecordingsWriter({"path": folder}, schema, False)
    kept, lost, twice = (writer.write(iter(rows)) for _ in range(3))
    writer.commit([kept, None])
    assert recordings.read_recordings(spark, folder).count() == 4
    writer.abort([lost, twice])
    assert len([x for x in os.listdir(folder) if x.startswith("task-")]) == 1
    empty = exchanges(spark, 0)
    recordings.write_recordings(empty, str(tmp_path / "none"))
    assert recordings.read_recordings(spark, str(tmp_path / "none")).count() == 0


def test_replay_from_recordings(spark, tmp_path):
    recordings.write_recordings(exchanges(spark, 40), str(tmp_path / "rec"))
    asked = spark.createDataFrame([("v3", "overlay", 3, "q"), ("v3", "overlay", 4, "q")], "video string, prompt_variant string, index int, query string")
    got = backends.replay(recordings.read_recordings(spark, str(tmp_path / "rec")))(asked).collect()
    raws = {r["index"]: r.raw for r in got}
    assert raws[3] in ("raw 3", "raw 23") and raws[4] is None


EVENT = {"description": "x", "start_s": 1.0, "end_s": 2, "confidence": 0.5, "evidence": "", "partial": False, "source_windows": [0]}
RUN = {"model": "m", "backend": "vllm", "sample_fps": 2.0, "window_s": 12, "stride_s": 9, "windows": 3, "model_calls": 3, "elapsed_s": 1.5}
GOOD = {"video": "a", "duration_s": 5.0, "queries": ["x"], "events": [EVENT], "run": RUN}


@pytest.mark.parametrize(
    "doc, wanted",
    [
        (GOOD, set()),
        (GOOD | {"polls": None}, set()),
        (GOOD | {"polls": [{"t": 1.0, "any": []}]}, set()),
        ({k: v for k, v in GOOD.items() if k != "events"}, set()),
        (GOOD | {"duration_s": "5"}, {("$.duration_s", "type")}),
        ({k: v for k, v in GOOD.items() if k != "run"}, {("$.run", "missing")}),
        (GOOD | {"extra": 1, "queries": None}, {("$.extra", "unknown"), ("$.queries", "null")}),
        (GOOD | {"events": [EVENT | {"confidence": 1.5}, {"start_s": 0, "end_s": 9.0, "description": None, "confidence": "x", "source_windows": [1, "q", None, 2.0]}]}, {("$.events[0].confidence", "value"), ("$.events[1]", "bounds"), ("$.events[1]", "order"), ("$.events[1].confidence", "type"), ("$.events[1].description", "null"), ("$.events[1].source_windows[1]", "type"), ("$.events[1].source_windows[2]", "null")}),
        (GOOD | {"run": RUN | {"backend": "z", "windows": 1.5, "stub": "no"}}, {("$.run.backend", "value"), ("$.run.windows", "type"), ("$.run.stub", "type")}),
        ({"predictions": [], "overall": {}}, {("$", "wrong_document")}),
        ([1], {("$", "type")}),
        (None, {("$", "null")}),
        (GOOD | {"events": {}}, {("$.events", "type")}),
        (GOOD | {"events": [EVENT | {"start_s": -0.5}, EVENT | {"end_s": True}]}, {("$.events[0]", "bounds"), ("$.events[1].end_s", "type")}),
    ],
)
def test_contract_walk(spark, tmp_path, doc, wanted):
    (tmp_path / "d.json").write_text(json.dumps(doc, indent=1))
    got = contract.violations(contract.read_documents(spark, str(tmp_path / "d.json"))).collect()
    assert {(r.path, r.kind) for r in got} == wanted and all(r.filename == "d.json" for r in got)


def test_contract_walk_of_no_json(spark):
    rows = spark.createDataFrame([(1, "{"), (2, None), (3, "")], "id int, text string")
    assert {(r.id, r.kind) for r in contract.violations(rows).collect()} == {(1, "not_json"), (2, "not_json"), (3, "not_json")}


def test_frames_of_clips_of_any_length(spark):
    media = spark.createDataFrame([(1, 20.0), (2, 0.0), (3, 1000.0), (4, 7.5)], "video long, duration_s double")
    frames = spark.createDataFrame([(v, t / 2) for v in (1, 2, 3, 4, 5) for t in range(60)], "video long, t double")
    windows = grids.plan_windows(media)
    got = {(r.video, r["index"]): r.frame_times for r in grids.with_frames(windows, frames, media, 100).collect()}
    times = [t / 2 for t in range(60)]
    want = {(r.video, r["index"]): [t for t in times if r.start_s - 1e-6 <= t <= r.end_s + 1e-6] for r in windows.collect()}
    assert got == want and (2, 0) not in want and len(want[3, 0]) == 25
    with pytest.raises(ValueError):
        grids.assign_frames(frames, media, 0)


def test_requests_carry_their_frames(spark):
    media = spark.createDataFrame([(1, 20.0), (2, 7.0)], "video long, duration_s double")
    frames = spark.createDataFrame([(v, float(t)) for v in (1, 2) for t in range(20)], "video long, t double")
    queries = spark.createDataFrame([("a door opens",)], "query string")
    told = lambda part: part["frame_times"].map(lambda x: json.dumps({"events": [{"start_s": min(x), "end_s": min(x) + len(x) / 4, "confidence": 0.5}]}))
    events = find.find_by_windows(media, frames, queries, C.with_overrides(C.Config(), windows__max_frames=8), backends.served(told)).collect()
    assert sorted((e.video, e.start_s, e.end_s) for e in events) == [(1, 0.0, 2.0), (1, 9.0, 11.0), (2, 0.0, 2.0)]
    rows = spark.createDataFrame([(1, -0.8, 3.0, 0.0, 12.0, [0.0, 5.0]), (2, -0.3, 3.0, 0.0, 12.0, [0.0]), (3, -0.8, 3.0, 0.0, 12.0, [])], "id int, e_start double, e_end double, w_start double, w_end double, frame_times array<double>")
    assert {r.id: r.reason for r in responses.reconcile(rows).collect()} == {1: "no_frame", 2: None, 3: None}
