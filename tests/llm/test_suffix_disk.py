"""What op4's shuffles write, and the filters that keep it low."""

import collections
import random

import pytest
from test_operators import brute_repeats, corpus, docs_of  # noqa: F401

from spanwright.llm import common, suffix

LETTERS = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789 ."


def shuffled_bytes(spark):
    found = spark.sparkContext._jsc.sc().statusStore().executorList(False)
    return sum(found.apply(i).totalShuffleWrite() for i in range(found.size()))


@pytest.fixture
def no_broadcast(spark):
    """Joins as on large tables."""
    name = "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(name)
    spark.conf.set(name, "-1")
    yield
    spark.conf.set(name, before)


def passages(n, seed):
    """n documents of 4,000 letters that compress badly, each sharing 400 with its neighbour."""
    rnd = random.Random(seed)
    shared = ["".join(rnd.choices(LETTERS, k=400)) for _ in range(n // 2 + 1)]
    return [(i, "".join(rnd.choices(LETTERS, k=1800)) + shared[i // 2] + "".join(rnd.choices(LETTERS, k=1800)), "en", "s", 1) for i in range(n)]


def test_texts_are_shuffled_once(spark, no_broadcast):
    rows = passages(1_500, 3)
    docs = docs_of(spark, rows)
    before = shuffled_bytes(spark)
    got = suffix.repeats_removed(docs).collect()
    written = (shuffled_bytes(spark) - before) / sum(len(r[1]) for r in rows)
    assert len(got) == 1_500 and all(r.n_removed >= 400 and r.n_spans == 1 for r in got)
    assert written < 2.4, written


def test_dealt_rows_stay_where_they_are(spark, no_broadcast):
    wide = spark.range(500).selectExpr("id AS d", "CAST(id AS STRING) AS text")
    held = common.cut_dealt(wide.join(spark.range(0, 500, 2).selectExpr("id AS d"), "d"))
    assert spark.conf.get("spark.sql.adaptive.enabled") == "true"
    later = held.join(spark.range(0, 500, 3).selectExpr("id AS d").groupBy("d").count(), "d")
    plan = later._jdf.queryExecution().executedPlan().toString()
    assert later.count() == 84 and plan.count("Exchange hashpartitioning") == 1


def test_full_bitmap_of_grams_is_exact(spark, corpus, monkeypatch):
    """With few bits nearly all are set, and grams found once pass; the result stays."""
    monkeypatch.setattr(suffix, "GRAM_BITS", 1 << 15)
    rows = [*corpus, *passages(200, 5), corpus[2], corpus[2], (70, "ab" * 400, "en", "s", 1)]
    got = collections.Counter((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffix.repeats_removed(docs_of(spark, rows)).collect())
    assert got == collections.Counter((r[0], *x) for r, x in zip(rows, brute_repeats([(r[1] or "").encode() for r in rows], 200), strict=True))


def test_bitmap_holds_every_gram(spark):
    grams = [random.Random(1).randrange(-(1 << 63), 1 << 63) for _ in range(300)] + [0, -1, suffix.GRAM_BITS - 1, suffix.GRAM_BITS]
    bits = suffix.gram_bitmap(spark.createDataFrame([(g,) for g in grams], "_kh long"))
    at = {g & (suffix.GRAM_BITS - 1) for g in grams}
    assert all(bits[i >> 3] >> (i & 7) & 1 for i in at) and int(sum(int(b).bit_count() for b in bits[bits > 0])) == len(at)
