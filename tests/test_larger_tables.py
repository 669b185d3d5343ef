"""Faults that show on larger tables: answers read again, one task with all rows, flags given to other events, equal times."""

import pytest
from compare import connect, same
from pyspark.sql import functions as F

from spanwright import queries as Q
from spanwright.operators import grids, states

LARGE = "/root/testdata/sf0.1"


def plan_of(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_flags_stay_with_their_events(spark):
    same(Q.QUERIES["interval_merge"](spark, LARGE).toPandas(), connect(LARGE).sql(Q.SQL["interval_merge"]).df())


def test_stub_answers_are_read_once(spark, sf_dir):
    assert plan_of(Q.QUERIES["stub_events"](spark, sf_dir)).count("from_json") == 1


@pytest.mark.parametrize(("name", "times"), [("reconcile_times", 1), ("probe_report", 3)])
def test_answers_are_read_once_a_use(spark, sf_dir, name, times):
    assert plan_of(Q.QUERIES[name](spark, sf_dir)).count("ArrowEvalPython") <= times


def test_edges_are_told_over_many_tasks(spark, sf_dir):
    assert Q.QUERIES["window_edges"](spark, sf_dir).rdd.getNumPartitions() == 4
    media = spark.createDataFrame([(1, 720.0), (2, 5.0), (3, 0.0), (4, 30.1234)], "video long, duration_s double")
    for window, stride in ((12.0, 9.0), (6.0, 3.0), (3.0, 4.5)):
        want = grids.window_edges(grids.plan_windows(media, window, stride))
        assert sorted(map(tuple, grids.planned_edges(media, window, stride).collect())) == sorted(map(tuple, want.collect()))


def test_polls_of_one_time_follow_by_event(spark):
    """Whatever the order of the rows and their tasks, equal times are met by event_id, with and without a stream's sort."""
    polls = [(1, k, 10.0 + k // 3, state, state) for k, state in enumerate(["open", "closed"] * 30)]
    schema, media = "video long, event_id long, t double, state string, text string", spark.createDataFrame([(1, 60.0)], "video long, duration_s double")
    want = sorted((p[2], q[2], q[3]) for p, q in zip(polls, polls[1:]))
    for rows in (polls, polls[::-1], polls[1::2] + polls[::2]):
        df = spark.createDataFrame(rows, schema).repartition(3)
        assert sorted((r.lo, r.hi, r.to_state) for r in states.transitions(df, ["video"]).collect()) == want
        ends = states.boundaries(df, ["video"], "open").first()
        assert (ends["first"], ends["last"]) == ("open", "closed")
        assert [r.event_id for r in grids.downsample(df, 1.0).orderBy("t").collect()] == list(range(0, 60, 3))
        spans = states.state_spans(df, media, ["video"], "open").collect()
        assert len(spans) == 30 and all(r.start_s <= r.end_s for r in spans)
        kept = grids.subsample(df, ["video"], 4).collect()
        assert sorted(r.event_id for r in kept) == [0, 15, 30, 45]


def test_half_of_a_coverage_rounds_as_in_the_sql(spark):
    """0.655 of 0.8 seconds (up) and 2 of 2.56 (down), by the times' binary differences."""
    found = Q.QUERIES["state_events"](spark, LARGE).where("(video = 740 AND start_s = 444.194) OR (video = 374 AND start_s = 376.986)")
    assert sorted((r.video, r.coverage) for r in found.collect()) == [(374, 0.7812), (740, 0.8188)]
