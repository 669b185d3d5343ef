"""Backends' health and failing calls, slides, refusals, and places in a result."""

import json
import time

import pandas as pd
import pytest
from pyspark.sql import functions as F

from spanwright import config as C
from spanwright.errors import BackendUnavailable, UnprocessableMedia
from spanwright.operators import merge, quality, responses
from spanwright.plans import backends, find
from spanwright.sources import recordings

ASKED = "video long, index int, query string"


def test_describe_and_check(spark, tmp_path):
    assert backends.stub().describe() == {"backend": "stub", "stub": True, "model": None, "able": ["extract"]}
    backends.stub().check()
    call = lambda part: ["{}"] * len(part)
    held = backends.served(call, caption=call, model="a/b", served_models=lambda: ["a/b", "c"])
    assert held.describe()["able"] == ["extract", "caption"] and held.check() is None
    with pytest.raises(BackendUnavailable, match="serves .'c'., the model is a/b"):
        backends.served(call, model="a/b", served_models=lambda: ["c"]).check()

    def down():
        raise OSError("refused")

    with pytest.raises(BackendUnavailable, match="cannot be reached: refused"):
        backends.served(call, model="a/b", served_models=down).check()
    rows = spark.createDataFrame([("v", "", 0, "q", "x")], "video string, prompt_variant string, index int, query string, raw string")
    recordings.write_recordings(rows, str(tmp_path / "r"))
    assert backends.replay(recordings.read_recordings(spark, str(tmp_path / "r"))).describe() == {"backend": "replay", "stub": False, "model": None, "able": ["extract"], "recordings": 1, "ambiguous": 1, "unreadable": 0}


def endpoint():
    """A slow answer for query slow, a server's error for query error; made here, as tests are no package that executors know."""

    def call(part):
        if (part["query"] == "error").any():
            raise RuntimeError("500 internal error")
        if (part["query"] == "slow").any():
            time.sleep(2)
        return pd.Series(['{"events": [{"start_s": 1, "end_s": 2}]}'] * len(part))

    return call


def test_slow_and_failing_calls_cost_their_own_rows_only(spark):
    requests = spark.createDataFrame([(1, k, q) for k, q in enumerate(["a", "error", "b", "slow", "c"])], ASKED).coalesce(1)
    got = {r["query"]: r for r in responses.parse_responses(backends.served(endpoint(), timeout_s=0.5, attempts=2)(requests)).collect()}
    assert {q: r.call_error for q, r in got.items()} == {"a": None, "b": None, "c": None, "error": "RuntimeError: 500 internal error", "slow": "timeout: no answer within 0.5 s"}
    assert len(got["a"].events) == 1 and got["slow"].events == [] and got["slow"].error == responses.EMPTY
    assert backends.served(endpoint())(requests.limit(0)).count() == 0


def test_calls_are_tried_again():
    seen = []

    def call(part):
        seen.append(len(part))
        if len(seen) == 1:
            raise OSError("reset")
        return [json.dumps({})] * len(part)

    assert backends.answers(call, pd.DataFrame({"query": ["a", "b"]}), 2, None) == (["{}", "{}"], [None, None]) and seen == [2, 2]


def test_slides(spark):
    rows = [
        *[("window", o, o + 12.0, o + 5.0) for o in (0.0, 3.0, 9.0)],
        *[("event", o, o + 12.0, 10.0) for o in (0.0, 3.0, 9.0)],
        *[("mixed", o, o + 12.0, 5.0 + o / 2) for o in (0.0, 9.0)],
        ("one", 0.0, 12.0, 9.5),
        ("one", 3.0, 15.0, None),
        ("same", 3.0, 15.0, 4.0),
        ("same", 3.0, 15.0, 5.0),
        ("none", 3.0, 15.0, None),
    ]
    got = {r.k: (r.n_answered, r.n_near_end, r.slide, r.verdict) for r in quality.slides(spark.createDataFrame(rows, "k string, lo double, hi double, reported double"), ["k"]).collect()}
    assert got == {"window": (3, 0, 1.0, "window"), "event": (3, 1, 0.0, "event"), "mixed": (2, 0, 0.5, "mixed"), "one": (1, 1, None, "one offset"), "same": (2, 0, None, "one offset"), "none": (0, 0, None, "no answer")}


def test_media_violations(spark):
    media = spark.createDataFrame([(1, 10.0, 5), (2, None, 5), (3, 0.1, 5), (4, 1e6, 5), (5, 10.0, 1 << 40)], "video long, duration_s double, size_bytes long")
    assert {r.video: r.reason for r in find.media_violations(media, C.Config()).collect()} == {2: "unreadable", 3: "too short", 4: "too long", 5: "too large"}
    with pytest.raises(UnprocessableMedia):
        find.media_in_bounds(media, C.Config())
    captions = spark.createDataFrame([], "video long, subject string, t double, text string")
    pairs = spark.createDataFrame([("a door opens", "the door is closed", "the door is open")], "description string, state_a string, state_b string")
    with pytest.raises(UnprocessableMedia):
        find.find_by_states(media, captions, spark.createDataFrame([("a door opens",)], "query string"), pairs, C.Config())


def test_places_are_the_order_of_the_result(spark, tmp_path):
    i = F.col("id")
    rows = spark.range(5_000).select((i % 7).alias("video"), (i * 37 % 1009 / 4).alias("start_s"), (i * 37 % 1009 / 4 + i % 3).alias("end_s"), F.concat(F.lit("d"), i).alias("description")).repartition(9)
    got = merge.placed(rows, str(tmp_path / "order")).collect()
    want = sorted((r.video, r.start_s, r.end_s, r.description) for r in got)
    assert [(r.video, r.start_s, r.end_s, r.description) for r in sorted(got, key=lambda r: r.place)] == want and {r.place for r in got} == set(range(5_000))
    # The same merge, of candidates that come in any order, tells the same events.
    cands = rows.withColumns({"event_id": F.monotonically_increasing_id(), "confidence": F.lit(0.5), "evidence": F.lit("e"), "window_index": F.lit(0)})
    assert merge.merge(cands, ["video"]).agg(F.sum("n_merged")).first()[0] == 5_000
