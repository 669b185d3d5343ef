"""Merging, matching, peaks, coverage, best windows and clean answers against plain versions, and on one busy key."""

import json
import random
import time

import pytest
from pyspark.sql import functions as F

from spanwright.operators import joins, merge, metrics, responses, signal, states

BUSY = 300_000


def plain_groups(rows, gap, cap):
    lo = hi = n = None
    out = []
    for s, e in rows:
        if n is not None and s - hi <= gap and max(hi, e) - lo <= cap:
            hi = max(hi, e)
        else:
            lo, hi, n = s, e, 0 if n is None else n + 1
        out.append(n)
    return out


def test_merge_of_one_busy_key(spark):
    """One island of all candidates: no row and no array holds them."""
    i = F.col("id")
    cands = spark.range(BUSY).select(F.lit(1).alias("video"), (i * 0.25).alias("start_s"), (i * 0.25 + (i * 7919) % 13).alias("end_s"), i.alias("event_id"))
    began = time.time()
    got = merge.merge_groups(cands, ["video"], 0.5, 60.0).groupBy("grp").agg(F.min("start_s").alias("s"), F.max("end_s").alias("e"), F.count(F.lit(1)).alias("n")).collect()
    assert time.time() - began < 60
    rows = [(k * 0.25, k * 0.25 + k * 7919 % 13) for k in range(BUSY)]
    want = {}
    for (s, e), g in zip(rows, plain_groups(rows, 0.5, 60.0), strict=True):
        a, b, n = want.get(g, (s, e, 0))
        want[g] = (a, max(b, e), n + 1)
    assert {r.grp: (r.s, r.e, r.n) for r in got} == want


def plain_greedy(preds, truths, threshold):
    used, tp = set(), 0
    for _, s, e, _ in sorted((-c, s, e, i) for i, s, e, c in preds):
        best = None
        for j, (ts, te, _) in enumerate(sorted((s, e, i) for i, s, e in truths)):
            inter, hull = max(0.0, min(e, te) - max(s, ts)), max(e, te) - min(s, ts)
            iou = inter / hull if hull > 0 else 0.0
            if j not in used and iou > 0 and (best is None or iou > best[0]):
                best = (iou, j)
        if best and best[0] >= threshold:
            used.add(best[1])
            tp += 1
    return tp


@pytest.mark.parametrize("threshold", [0.1, 0.3, 0.5])
def test_greedy_matches(spark, threshold):
    rnd = random.Random(int(threshold * 10))
    span = lambda: sorted(round(rnd.uniform(-20, 60) * 2) / 2 for _ in range(2))
    preds = [(k, g, *span(), rnd.choice([0.2, 0.5, 0.9])) for k in range(400) for g in [rnd.randrange(12)]]
    truths = [(k, g, *span()) for k in range(200) for g in [rnd.randrange(14)]]
    got = metrics.greedy_matches(spark.createDataFrame(preds, "event_id long, g int, start_s double, end_s double, confidence double"), spark.createDataFrame(truths, "event_id long, g int, start_s double, end_s double"), threshold, ["g"])
    want = {g: plain_greedy([(p[0], *p[2:]) for p in preds if p[1] == g], [(t[0], *t[2:]) for t in truths if t[1] == g], threshold) for g in range(14)}
    assert {r.g: r.tp for r in got.collect() if r.tp} == {g: n for g, n in want.items() if n}


def test_greedy_matches_of_one_busy_key(spark):
    i = F.col("id")
    preds = spark.range(BUSY).select(F.lit(1).alias("g"), i.alias("event_id"), (i * 1.0).alias("start_s"), (i * 1.0 + 3).alias("end_s"), (i % 100 / 100).alias("confidence"))
    truths = spark.range(BUSY // 2).select(F.lit(1).alias("g"), i.alias("event_id"), (i * 2.0 + 0.25).alias("start_s"), (i * 2.0 + 3.25).alias("end_s"))
    began = time.time()
    assert BUSY // 3 < metrics.greedy_matches(preds, truths, 0.5, ["g"]).first().tp <= BUSY // 2
    assert time.time() - began < 90


def plain_peaks(rows, k, least, gap):
    picked = []
    for m, t in sorted((-m, t) for t, m in rows if m >= least):
        if len(picked) < k and all(abs(t - p) >= gap for p in picked):
            picked.append(t)
    return picked


def test_peaks_in_blocks(spark):
    rnd = random.Random(4)
    rows = [(v, round(rnd.uniform(0, 200) * 4) / 4, rnd.choice([1.0, 4.0, 5.5, 7.0, 9.25])) for v in range(6) for _ in range(150)]
    rows = list({(v, t): (v, t, m) for v, t, m in rows}.values())
    for k, gap in ((3, 2.5), (40, 1.0), (1_000, 6.0)):
        got = signal.peaks(spark.createDataFrame(rows, "video int, t double, moved_pct double"), k, 3.0, gap).collect()
        for v in range(6):
            assert sorted(r.t for r in got if r.video == v) == sorted(plain_peaks([(t, m) for w, t, m in rows if w == v], k, 3.0, gap))


def test_peaks_of_one_busy_clip(spark):
    """All samples are strong and nearer than the gap: one block."""
    i = F.col("id")
    rows = spark.range(BUSY).select(F.lit(1).alias("video"), (i * 0.5).alias("t"), ((i * 7919) % 1009 / 10.0).alias("moved_pct"))
    began = time.time()
    got = [r.t for r in signal.peaks(rows, None, 0.0, 2.0).collect()]
    assert time.time() - began < 60
    got.sort()
    assert all(b - a >= 2.0 for a, b in zip(got, got[1:], strict=False)) and all(b - a < 4.0 for a, b in zip(got, got[1:], strict=False))


def plain_sums(polls, start, end, span):
    inside = sorted((t, on, text) for t, on, text in polls if start <= t <= end)
    seen, reached = 0.0, start
    for t, on, _ in inside:
        if on:
            up = min(t + span, end)
            seen += max(0.0, up - max(t, reached))
            reached = max(reached, up)
    first = next((text for _, on, text in inside if on), None)
    return len(inside), sum(on for _, on, _ in inside), round(seen, 6), first


def test_sums_in_spans(spark):
    rnd = random.Random(8)
    polls = [(v, t / 4, rnd.choice(["open", "open", "closed", None]), f"at {t}") for v in range(5) for t in range(0, 400, 1 + v) if rnd.random() < 0.8]
    spans = [(v, *sorted(rnd.randrange(0, 420) / 4 for _ in range(2)), k) for v in range(6) for k in range(40)]
    df = spark.createDataFrame(polls, "video int, t double, state string, text string").withColumn("_on", F.col("state") == "open")
    got = states.sums_in_spans(df, spark.createDataFrame(spans, "video int, start_s double, end_s double, k int"), ["video"], 2.0).collect()
    assert len(got) == len(spans)
    for r in got:
        own = [(t, s == "open", text) for v, t, s, text in polls if v == r.video and s is not None]
        assert (r["_n"], r["_k"], round(r["_seen"], 6), r["_text"]) == plain_sums(own, r.start_s, r.end_s, 2.0)


def test_best_window_by_a_sweep(spark):
    rnd = random.Random(9)
    events = [(k, v, s, s + rnd.choice([0.0, 2.0, 8.0, 20.0, 30.0])) for k in range(300) for v in [rnd.randrange(6)] for s in [rnd.randrange(0, 300) / 2]]
    media = [(v, 40.0 + 25 * v) for v in range(6)]
    got = {r.video: (r.start_s, r.contained) for r in joins.best_window(spark.createDataFrame(events, "event_id long, video int, start_s double, end_s double"), spark.createDataFrame(media, "video int, duration_s double"), "video", 20.0).collect()}
    for v, d in media:
        own = [e for e in events if e[1] == v]
        tried = [(-sum(s >= w and e <= w + 20.0 for _, _, s, e in own), w, k) for k, _, s0, _ in own for w in [max(0.0, min(s0 - 3.0, max(0.0, d - 20.0)))]]
        assert got[v] == (min(tried)[1], -min(tried)[0])


ODD = ['{"events":[]}}', '{"events":[]} ,{"a":1}', "[] []", "1],[2", '{"events":[]}}],"spanwright:end":1}', '{"events":[]},"spanwright:end":1}', '{"events":null}', '{"events":0}', '{"events":{}}', "{}", "[]", "[null]", "null", "{'events':[]}", '{"events":[{"start_s":NaN,"end_s":1}]}', '{"events":[{"start_s":"4","end_s":1}]}', '{"events":[{"start_s":1,"end_s":2,"evidence" :  true}]}', '{"events":[{"start_s":1,"end_s":2},]}', "", " "]


def test_clean_answers_are_read_alike_in_both_ways(spark):
    rnd = random.Random(5)
    row = lambda: {"start_s": rnd.choice([1, 2.5, -3, 1e400, "4.0", None, True, 0.1]), "end_s": rnd.choice([4, 5.25, "x", 7, 7]), "confidence": rnd.choice([0.5, None, 1, 2, "0.5", 0.9]), "evidence": rnd.choice(["a", "é\n", None, 5, True, {"q": 1}])}
    texts = list(ODD)
    for _ in range(1_500):
        rows = [row() if rnd.random() < 0.6 else {"start_s": 1, "end_s": 2.5} for _ in range(rnd.randrange(3))]
        t = json.dumps(rnd.choice([{"events": rows}, rows, {"events": rows, "note": "x"}]))
        if rnd.random() < 0.4:
            k = rnd.randrange(len(t))
            t = t[:k] + rnd.choice(["", "}", "]", ",", "{", '"', "'", " ", "s", "```", "<a>", "\n"]) + t[k + rnd.randrange(2) :]
        texts.append(rnd.choice([t, t, t, f"well {t} ok", f"```json\n{t}\n```"]))
    df = spark.createDataFrame(list(enumerate(texts)), "i int, raw string")
    for r in responses.parse_responses(df).collect():
        want = responses.read_answer(texts[r.i].strip())
        assert (json.dumps([e.asDict() for e in r.events]), r.error) == (json.dumps(want["events"]), want["error"]), texts[r.i]
    n = df.select(responses.read_clean(F.col("raw")).alias("c")).where("c IS NOT NULL").count()
    assert 100 < n < len(texts)
