"""Texts of a megabyte, as one chunk, as many words and as one word over and over, through the operators on runs, terms, pages and passages."""

import random
import time

import pytest
from pyspark.sql import functions as F

from spanwright.llm import decontam, divergence, runs, warc

SIZE = 1_000_000
DOC = "doc_id long, text string, lang string, source string"


def texts():
    rnd = random.Random(1)
    words = " ".join("".join(rnd.choices("abcdefghij", k=rnd.randrange(2, 9))) for _ in range(SIZE // 6))
    return {1: "".join(rnd.choices("abcdefghijklmnop0123456789+/", k=SIZE)), 2: words, 3: "a " * (SIZE // 2), 4: "line of a text\n" * (SIZE // 15), 5: "short text", 6: None}


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(k, t, "en", "s") for k, t in texts().items()], DOC).repartition(3)


def ended(f, seconds=120):
    began = time.time()
    out = f()
    assert time.time() - began < seconds
    return out


def test_runs_of_long_texts(docs):
    found = ended(lambda: {r.doc_id: r for r in runs.periodic_runs(docs).collect()})
    assert (found[3].n_runs, found[3].length, found[3].period) == (1, SIZE // 2, 1) and found[4].period == 4 and found[1].n_runs == 0


def test_terms_of_long_texts(docs):
    told = ended(lambda: divergence.divergence(docs, least_docs=1).where("part = 'term'").count())
    assert told == 0  # one group is its language


def test_passages_in_long_texts(spark, docs):
    bench = spark.createDataFrame([(1, "line of a text line of a text line of a text line of a tent"), (2, "a " * 700)], "item_id long, text string")
    hits = ended(lambda: {(r.doc_id, r.item_id) for r in decontam.contamination(docs, bench).collect()})
    assert hits == {(4, 1), (3, 2)}


def test_long_pages(docs):
    pages = docs.select(F.col("doc_id").alias("page_id"), F.concat(F.lit("http://h.example/"), F.substring("text", 1, 100_000)).alias("url"), F.col("text").alias("html"))
    folder = ended(lambda: warc.archived(pages))
    read = ended(lambda: warc.fetch(pages, folder).collect())
    assert {r.page_id: len(r.payload) for r in read} == {k: len((t or "").encode()) for k, t in texts().items()}
