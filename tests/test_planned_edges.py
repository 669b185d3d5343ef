"""Flags at window edges without a table of edges, whose hundreds of rows a clip were handed to the driver."""

import random

import pytest
from pyspark.sql import functions as F

from spanwright import queries as Q
from spanwright.operators import grids, merge


def executed(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_merged_events_meet_no_table_of_edges(spark, sf_dir):
    assert "Generate" not in executed(Q.QUERIES["interval_merge"](spark, sf_dir))


def test_frames_by_second_stay_off_the_driver(spark, sf_dir):
    joins = [line for line in executed(Q.QUERIES["reconcile_times"](spark, sf_dir)).splitlines() if "Join [" in line and "_cell" in line]
    assert joins and all("SortMergeJoin" in line for line in joins)


@pytest.mark.parametrize(("window", "stride", "longest"), [(12.0, 9.0, 100.0), (6.0, 3.0, 40.0), (3.0, 4.5, 40.0), (12.0, 0.3337, 30.0), (2.0, 0.0004, 2.05), (0.4, 0.0007, 0.5)])
def test_flags_are_those_of_all_edges(spark, window, stride, longest):
    rnd = random.Random(7)
    clips = [(k, round(rnd.uniform(0, longest), 4)) for k in range(1, 7)] + [(7, 0.0), (8, window), (9, window + stride), (10, None)]
    media = spark.createDataFrame(clips, "video long, duration_s double")
    edges = {}
    for row in grids.window_edges(grids.plan_windows(media, window, stride)).collect():
        edges.setdefault(row.video, set()).add(row.edge)
    spans = []
    for video, length in [*clips, (11, 9.0)]:
        for _ in range(40):
            near = rnd.choice(sorted(edges[video])) if video in edges else 5.0
            start = max(0.0, near + rnd.choice([0.0, 0.25, -0.25, 0.2499, rnd.uniform(-0.3, 0.3), rnd.uniform(-9, 9)]))
            spans.append((video, len(spans), start, start + rnd.uniform(0, 2 * stride + 1), [1] if rnd.random() < 0.8 else [1, 2]))
    spans += [(1, -1, 1e300, 1e300, [1]), (1, -2, -5.0, -4.0, [1])]
    got = merge.partial_flag(spark.createDataFrame(spans, "video long, id long, start_s double, end_s double, source_windows array<int>"), media, window_s=window, stride_s=stride)
    lengths = dict(clips)
    for r in got.collect():
        length = lengths.get(r.video)
        if r.start_s <= 0.25 or (length is not None and r.end_s >= length - 0.25):
            want = True
        else:
            want = len(r.source_windows) == 1 and any(abs(at - e) < 0.25 for at in (r.start_s, r.end_s) for e in edges.get(r.video, ()))
        assert r.partial == want, (r, length)
    assert got.count() == len(spans) and got.where(F.col("partial")).count() > 0
