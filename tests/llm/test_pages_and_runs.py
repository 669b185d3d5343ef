"""The capture index, the divergence audit and the run detection against brute-force versions."""

import base64
import collections
import gzip
import hashlib
import random
import re
import time

import pytest
from pyspark.sql import functions as F

from spanwright.llm import divergence, runs, warc
from spanwright.llm.common import new_folder

PAGE = "page_id long, url string, html string"
CLASH = {"key": 1.5, "size": "x", "file": 3, "offset": "o", "digest": True, "target": "t", "lang_n": "n", "g": "g", "n": "n", "rank": "r"}


def with_clash(df):
    return df.withColumns({k: F.lit(v) for k, v in CLASH.items()})


PAGES = [
    (5, "http://www.example.com/a?b#c", "<p>one"),
    (3, "https://www.example.com:8080/a", "<p>one"),
    (9, "http://blog.example.com/", "<p>one"),
    (None, "http://blog.example.com/", "<p>one"),
    (4, None, None),
    (2, "http://user:word@Example.COM/p q\n", ""),
    (7, "no host at all", "<p>two é 漢字 \r\n\r\n end"),
    (8, "http://example.org/x", "<p>two é 漢字 \r\n\r\n end"),
    (8, "http://example.org/x", "<p>two é 漢字 \r\n\r\n end"),
    (1, "http://example.org/x", "<p>only"),
    (1, "http://example.org/x", "<p>only"),
    (None, "http://example.org/none", "<p>no id"),
    (11, "http://example.org/" + "long/" * 2_000, "x" * 5_000_000),
]


def test_url_keys(spark):
    urls = ["http://www.example.com/a?b#c", "https://www.example.com:8080/a", "http://user:word@Example.COM/p q\n", "no host at all", "//h/", None, ""]
    got = [r.k for r in spark.createDataFrame([(i, u) for i, u in enumerate(urls)], "i int, u string").orderBy("i").select(warc.url_key(F.col("u")).alias("k")).collect()]
    assert got == ["com,example,www)/a?b", "com,example,www:8080)/a", "com,example)/p q\n", ")no host at all", "h)/", "", ")"]


def expected_records(pages, least=0):
    """(page_id, payload_bytes, digest, record_type, refers_to) of all pages."""
    groups, out = collections.defaultdict(list), []
    for page, url, html in pages:
        groups[(html or "").encode()].append((page is None, page or 0, url is None, url or "", page))
    for body, rows in groups.items():
        digest = base64.b32encode(hashlib.sha1(body).digest()).decode()
        rows.sort(key=lambda r: r[:4])
        for k, r in enumerate(rows):
            first = k == 0 or len(body) < least
            out.append((r[4], len(body), digest, "response" if first else "revisit", None if first else rows[0][4]))
    return collections.Counter(out)


def told(records):
    return collections.Counter((r.page_id, r.payload_bytes, r.digest, r.record_type, r.refers_to) for r in warc.resolved(records).collect())


@pytest.mark.parametrize("least", [0, 7])
def test_archive_round_trip_through_the_index(spark, least):
    pages = PAGES + [(100 + i, f"http://h{i % 7}.example.net/{i % 50}", f"<p>{i % 40}" if i % 3 else "<p>a very common page") for i in range(200)]
    df = with_clash(spark.createDataFrame(pages, PAGE)).repartition(3)
    folder = new_folder(spark, "warc-test")
    captures = warc.write_archive(df, folder, least, file_bytes=2_000)
    warc.build_index(captures, folder, block_lines=4, part_lines=30)
    assert spark.read.parquet(f"{folder}/manifest").count() > 3
    found = warc.lookup(df.select(warc.url_key(F.col("url")).alias("key")), folder)
    assert told(warc.read_records(found, folder, payload=False)) == expected_records(pages, least)
    # Some urls only: all captures of their keys, with whole payloads, the responses of revisits found by a second search.
    urls = [("http://www.example.com/a?b",), ("http://example.org/x",), ("http://nowhere.example/",), ("http://h3.example.net/3",), (PAGES[-1][1],), (None,)]
    own = {None: "", **{u: u for (u,) in urls}}
    keys = [r.k for r in df.select(warc.url_key(F.col("url")).alias("k")).distinct().collect()]
    assert len(keys) > 50
    wanted = {r.k for r in spark.createDataFrame(urls, "u string").select(warc.url_key(F.col("u")).alias("k")).collect()}
    by_key = df.withColumn("k", warc.url_key(F.col("url"))).collect()
    expect = collections.Counter((r.page_id, r.url, (r.html or "").encode()) for r in by_key if r.k in wanted)
    got = warc.fetch(spark.createDataFrame(urls, "url string"), folder).collect()
    assert collections.Counter((r.page_id, r.url, bytes(r.payload)) for r in got) == expect and own


def test_archive_is_plain_warc(spark):
    folder = new_folder(spark, "warc-test")
    warc.write_archive(spark.createDataFrame(PAGES[:9], PAGE).coalesce(1), folder)
    fs, base = warc.filesystem(folder)
    files = [f for f in fs.get_file_info(warc.pyarrow.fs.FileSelector(base)) if f.path.endswith(".warc.gz")]
    whole = b"".join(gzip.decompress(fs.open_input_file(f.path).read()) for f in files)
    n = 0
    while whole:
        head = whole[: whole.index(b"\r\n\r\n")].decode().split("\r\n")
        assert head[0] == "WARC/1.1"
        size = int(dict(x.split(": ", 1) for x in head[1:])["Content-Length"])
        at = whole.index(b"\r\n\r\n") + 4 + size
        assert whole[at : at + 4] == b"\r\n\r\n"
        whole, n = whole[at + 4 :], n + 1
    assert n == 9
    assert {len(x) for x in re.findall(r"urn:uuid:([0-9a-f-]+)", str([warc.record_name("ab", 1)]))} == {36}


def test_empty_archive(spark):
    folder = warc.archived(spark.createDataFrame([], PAGE))
    found = warc.lookup(spark.createDataFrame([("com,example)/",)], "key string"), folder)
    assert found.count() == 0 and warc.resolved(warc.read_records(found, folder)).count() == 0


def plain_divergence(rows, least_docs, top):
    texts = [(r[2] or "", r[3] or "", [t.lower() if t.isascii() else "".join(c.lower() if c < "\x80" else c for c in t) for t in re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", r[1] or "")]) for r in rows]
    out = []
    for lang in {t[0] for t in texts}:
        docs, total, own = collections.Counter(), collections.Counter(), collections.defaultdict(collections.Counter)
        for _, source, terms in (t for t in texts if t[0] == lang):
            docs.update(set(terms))
            total.update(terms)
            own[source].update(terms)
        kept = sorted(t for t in docs if docs[t] >= least_docs)
        share = lambda c, kept=kept: {t: 1 + 1_000_000_000 * (c[t] + 5) // (sum(c[k] for k in kept) + 5 * len(kept)) for t in kept}
        p, q = {s: share(c) for s, c in own.items()}, share(total)
        for s in own:
            pairs = sorted(((-sum(abs(p[s][t] - p[o][t]) for t in kept), o.encode()) for o in own if o != s))
            terms = sorted((q[t] - p[s][t], t.encode()) for t in kept if own[s][t] and p[s][t] > q[t])[:top]
            out += [(lang, s, part, item.decode(), -v, k + 1) for part, found in (("pair", pairs), ("term", terms)) for k, (v, item) in enumerate(found)]
    return sorted(out)


DOC = "doc_id long, text string, lang string, source string"


def test_divergence_matches_brute_force(spark):
    rnd = random.Random(3)
    vocabulary = ["The", "THE", "été", "naïve", "漢字", "a", "zebra", "x1y", "under_score", "don't", "Ünder", "q"] + [f"w{chr(97 + i)}" for i in range(20)]
    rows = [(i, " ".join(rnd.choices(vocabulary, k=rnd.randrange(0, 30))), rnd.choice(["en", "de", None]), rnd.choice(["s0", "s0", "s0", "s1", "s2", "é", "Z", None])) for i in range(150)]
    rows += [(1, None, "en", "empty"), (1, "", "fr", "alone"), (2, "123 ...", "xx", "a"), (2, "123 ...", "xx", "b"), (None, "the the", "en", "s0"), (7, "w " * 20_000, "en", "s1")]
    got = divergence.divergence(with_clash(spark.createDataFrame(rows, DOC)).repartition(3), least_docs=5, group_block=2, term_block=7, top=3)
    assert sorted(tuple(r) for r in got.select("lang", "source", "part", "item", "value", "rank").collect()) == plain_divergence(rows, 5, 3)
    assert divergence.divergence(spark.createDataFrame([], DOC)).count() == 0
    # The cut into blocks changes nothing, and numbers beyond 64 bits on the way stay exact.
    whole = divergence.divergence(spark.createDataFrame(rows, DOC), least_docs=5, top=3)
    assert sorted(tuple(r) for r in whole.collect()) == plain_divergence(rows, 5, 3)
    big = spark.createDataFrame([(9_000_000_000_000_001, 9_000_000_000_000_123, 7)], "a long, b long, c long").select(divergence.share(F.col("a"), F.col("b"), F.col("c")).alias("p"))
    assert big.first().p == 1 + 10**9 * (9_000_000_000_000_001 + 5) // (9_000_000_000_000_123 + 35)


def plain_runs(w):
    out = {}
    for q in range(1, len(w) // 4 + 1):
        i = 0
        while i < len(w) - q:
            j = i
            while j < len(w) - q and w[j] == w[j + q]:
                j += 1
            if j - i + q >= max(6, 4 * q):
                out.setdefault((i, j - i + q), q)
            i = j + 1
    return sorted(((s, n, q) for (s, n), q in out.items()), key=lambda r: (r[0], r[2]))


def repetitive(rnd):
    w = [b"%d" % rnd.randrange(rnd.choice([1, 2, 3, 9])) for _ in range(rnd.randrange(0, 90))]
    for _ in range(rnd.randrange(0, 3)):
        if len(w) > 12:
            p, a, m = rnd.randrange(1, 9), rnd.randrange(len(w) - 6), rnd.randrange(4, 40)
            w[a : a + m] = (w[a : a + p] * 60)[:m]
    return w


def test_runs_match_brute_force():
    rnd = random.Random(11)
    for _ in range(1_500):
        w = repetitive(rnd)
        assert runs.word_runs(w) == plain_runs(w), w


def test_periodic_runs_of_documents(spark):
    rnd = random.Random(12)
    rows = [(i, b" ".join(repetitive(rnd)).decode(), "en", "s") for i in range(120)]
    rows += [(None, "a a a a a a a", "en", "s"), (900, None, None, None), (901, "", "en", "s"), (902, " \n\t\x0b", "en", "s"), (903, "a\xa0b " * 9, "en", "s"), (5, "x y\n" * 8, "en", "s"), (5, "x y\n" * 8, "en", "s")]
    got = runs.periodic_runs(with_clash(spark.createDataFrame(rows, DOC)), alter=True).collect()
    expect = []
    for doc_id, text, *_ in rows:
        w = runs.altered((text or "").encode().split(), doc_id)
        found = plain_runs(w)
        best = min(found, key=lambda r: (-r[1], r[0], r[2])) if found else (None, None, None)
        gone = {i for s, n, q in found for i in range(s + q, s + n)}
        sha = lambda b: hashlib.sha256(b).hexdigest()
        expect.append((doc_id, len(found), *best, 1000 * best[1] // best[2] if found else None, sha("".join(f"{s},{n},{q}\n" for s, n, q in found).encode()), sha(b" ".join(x for i, x in enumerate(w) if i not in gone))))
    assert collections.Counter(map(tuple, got)) == collections.Counter(expect)
    assert runs.periodic_runs(spark.createDataFrame([], DOC)).count() == 0


def test_runs_of_very_long_texts():
    began = time.time()
    assert runs.word_runs([b"a"] * 600_000) == [(0, 600_000, 1)]
    assert runs.word_runs([b"%d" % (i % 50_000) for i in range(250_000)]) == [(0, 250_000, 50_000)]
    phrases = [x for i in range(20_000) for x in (b"%d" % i, b"b", b"c", b"d", b"e", b"f", b"g")]
    assert runs.word_runs(phrases) == []
    turns = [x for i in range(8_000) for x in (b"%d" % i, *[b"b", b"c"] * 4)]
    assert len(runs.word_runs(turns)) == 8_000
    assert time.time() - began < 60
