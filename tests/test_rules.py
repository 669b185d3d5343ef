"""Golden values, and folds against a plain statement of their rule."""

import random

import pytest
from pyspark.sql import functions as F

from spanwright.functions import intervals as I
from spanwright.functions import text as X
from spanwright.operators import grids, joins, merge, metrics, responses, signal, states

CANDS = "video long, description string, event_id long, start_s double, end_s double, confidence double, window_index int, evidence string"


def some_candidates(seed, n=60, keys=3):
    rnd = random.Random(seed)
    return [(rnd.randrange(keys), "d", i, float(s := rnd.randrange(0, 200)), float(s + rnd.randrange(1, 40)), rnd.randrange(0, 101) / 100, rnd.randrange(5), f"e{i}") for i in range(n)]


def plain_merge(rows, gap, cap, iou):
    out = []
    for video in sorted({r[0] for r in rows}):
        groups = []
        for r in sorted((r for r in rows if r[0] == video), key=lambda r: (r[3], r[4], r[2])):
            if groups:
                lo, hi = min(x[3] for x in groups[-1]), max(x[4] for x in groups[-1])
                if (iou <= 0 or r[3] - hi <= gap) and max(hi, r[4]) - lo <= cap:
                    groups[-1].append(r)
                    continue
            groups.append([r])
        out += [(video, min(x[3] for x in g), max(x[4] for x in g), len(g)) for g in groups]
    return sorted(out)


@pytest.mark.parametrize(("seed", "iou"), [(1, 0.3), (2, 0.3), (3, 0.0)])
def test_merge_is_the_plain_rule(spark, seed, iou):
    rows = some_candidates(seed)
    got = merge.merge(spark.createDataFrame(rows, CANDS), ["video", "description"], 0.5, 60.0, iou=iou)
    assert sorted((r.video, r.start_s, r.end_s, r.n_merged) for r in got.collect()) == plain_merge(rows, 0.5, 60.0, iou)


def test_noisy_or_golden(spark):
    rows = [(n, 0.6) for n in (1, 2, 5, 20) for _ in range(n)]
    got = spark.createDataFrame(rows, "n int, s double").groupBy("n").agg(I.noisy_or("s").alias("c")).orderBy("n").collect()
    assert [round(r.c, 3) for r in got] == [0.582, 0.815, 0.960, 0.970]


def test_windows_golden(spark):
    media = spark.createDataFrame([(1, 20.0), (2, 300.0), (3, 0.0), (4, 120.0), (5, 5.0)], "video long, duration_s double")
    got = grids.plan_windows(media)
    assert [(r.start_s, r.end_s) for r in got.where("video = 1").orderBy("index").collect()] == [(0.0, 12.0), (9.0, 20.0)]
    assert {r.video: r["count"] for r in got.groupBy("video").count().collect()} == {1: 2, 2: 33, 4: 13, 5: 1}
    assert grids.plan_cost(media.where("video = 2"), 2, 2.0).first().model_calls == 66
    assert grids.poll_grid(media.where("video = 4")).count() == 119
    assert grids.poll_grid(media.where("video = 3")).count() == 0
    with pytest.raises(Exception, match="over budget"):
        grids.check_budget(grids.plan_cost(media, 2, 2.0), 10).collect()


def test_subsample_is_the_float_form(spark):
    for n in (1, 3, 7, 10, 23, 100):
        rows = spark.createDataFrame([(1, float(i)) for i in range(n)], "video long, t double")
        got = sorted(int(r.t) for r in grids.subsample(rows, ["video"], 7).collect())
        assert got == (list(range(n)) if n <= 7 else sorted({min(int(i * (n / 7.0)), n - 1) for i in range(7)}))


def test_state_confidence_golden(spark):
    media = spark.createDataFrame([(1, 100.0)], "video long, duration_s double")
    polls = [(1, float(t), "open" if 4 <= t <= 8 else "closed", f"p{t}") for t in range(0, 20)]
    got = states.state_events(spark.createDataFrame(polls, "video long, t double, state string, text string"), media, ["video"], "open").collect()
    assert [(r.start_s, r.end_s, r.coverage, r.partial) for r in got] == [(3.5, 8.5, 0.9, False)]
    none = spark.createDataFrame([(1, 1.0, None, "x")], "video long, t double, state string, text string")
    assert states.state_events(none, media, ["video"], "open").count() == 0


def test_open_ended_states(spark):
    media = spark.createDataFrame([(1, 30.0), (2, 30.0)], "video long, duration_s double")
    rows = [(1, 0.0, None, "a"), (1, 1.0, "open", "b"), (1, 20.0, "closed", "c"), (2, 5.0, "closed", "d"), (2, 6.0, "open", "e")]
    got = states.state_spans(spark.createDataFrame(rows, "video long, t double, state string, text string"), media, ["video"], "open").orderBy("video").collect()
    assert [(r.video, r.start_s, r.end_s, r.partial, r.widest) for r in got] == [(1, 0.0, 3.0, True, 0.0), (2, 5.5, 30.0, True, 1.0)]


def plain_pr(preds, truths, threshold):
    tp = 0
    for key in {p[0] for p in preds}:
        left = sorted((t for t in truths if t[0] == key), key=lambda t: (t[3], t[4], t[2]))
        for p in sorted((p for p in preds if p[0] == key), key=lambda p: (-p[5], p[3], p[4], p[2])):
            best, at = 0.0, None
            for k, t in enumerate(left):
                hull = max(p[4], t[4]) - min(p[3], t[3])
                iou = max(0.0, min(p[4], t[4]) - max(p[3], t[3])) / hull
                if iou > best:
                    best, at = iou, k
            if at is not None and best >= threshold:
                left.pop(at)
                tp += 1
    return tp


@pytest.mark.parametrize("seed", [5, 6])
def test_greedy_matching_is_the_plain_rule(spark, seed):
    preds, truths = some_candidates(seed), some_candidates(seed + 100, 30)
    got = metrics.detection_pr(spark.createDataFrame(preds, CANDS), spark.createDataFrame(truths, CANDS), 0.3).first()
    assert got.tp == plain_pr(preds, truths, 0.3)
    empty = spark.createDataFrame([], CANDS)
    assert metrics.detection_pr(empty, empty).first().precision == 0.0


def test_peaks_is_the_plain_rule(spark):
    rnd = random.Random(3)
    rows = [(1, float(t), float(rnd.randrange(0, 10))) for t in range(60)]
    picked = []
    for _, t, m in sorted(rows, key=lambda r: (-r[2], r[1])):
        if m < 3 or len(picked) >= 8:
            break
        if all(abs(t - p) >= 2.5 for p in picked):
            picked.append(t)
    got = signal.peaks(spark.createDataFrame(rows, "video long, t double, moved_pct double"), 8, 3.0, 2.5)
    assert [r.t for r in got.orderBy("t").collect()] == sorted(picked)


def test_bracket_repair():
    close = responses.closed_brackets
    assert close('[ {"a": 1, "e": "x"\n]') == '[ {"a": 1, "e": "x"\n}]'
    assert close('{"a": [1, 2') == '{"a": [1, 2]}'
    assert close('{"a": "br}ce') == '{"a": "br}ce"}'
    assert close('}{"a": "q\\"]"}') == '{"a": "q\\"]"}'


def test_split_by_subject_longest_first(spark):
    df = spark.createDataFrame([("door: shut\ncar door: open",), ("nothing here",), ("",)], "text string")
    got = [r.m for r in df.select(X.split_by_subject("text", ["door", "car door"]).alias("m")).collect()]
    assert got == [{"car door": "car door: open", "door": "door: shut"}, {"car door": "", "door": ""}, {"car door": "", "door": ""}]


def test_last_mention_and_enumerations(spark):
    cases = [("It is open, then closed.", "the door is closed"), ("state (open/closed) unchanged", None), ("opening now", "the door is open"), ("a wall", None)]
    df = spark.createDataFrame([(t,) for t, _ in cases], "text string")
    assert [r.s for r in df.select(X.parse_state("text", "the door is closed", "the door is open").alias("s")).collect()] == [s for _, s in cases]


def test_points_in_spans_buckets(spark):
    pts = spark.createDataFrame([(1, i) for i in range(100)], "clip long, frame int")
    spans = spark.createDataFrame([(1, 5, 70, "a"), (1, 64, 64, "b")], "clip long, f0 int, f1 int, activity string")
    got = joins.points_in_spans(pts, spans, "clip", "frame", "f0", "f1", 16).groupBy("activity").agg(F.count("frame").alias("n"))
    assert {r.activity: r.n for r in got.collect()} == {"a": 66, "b": 1}


def test_moving_windows_of_names(spark):
    df = spark.createDataFrame([("23-59-30.00-00-10",), ("10-00-00.10-05-00",)], "n string")
    assert [r.s for r in df.select(X.seconds_of_name("n").alias("s")).collect()] == [40, 300]
