"""Each operator against a brute-force version, on small tables with nulls, empty and long texts, ties, repeats and clashing columns."""

import collections
import hashlib
import itertools
import math
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from spanwright.llm import chat, common, decontam, minhash, mixing, perfect_hash, pii, quality, sharding, suffix, tokens, toxicity

DOC = "doc_id long, text string, lang string, source string, n_chars long"
#: Columns of operators' own results, with other types.
CLASH = {"size": "x", "shard": "y", "rep": "z", "row": "w", "score": "s", "d": 1.5, "kept": "k", "block": "b", "id": "i", "key": "v"}


def prose(seed, words=80):
    rnd = random.Random(seed)
    return " ".join("".join(rnd.choice(["an", "er", "ti", "on", "hé", "sh"]) for _ in range(rnd.randrange(1, 5))) for _ in range(words))


@pytest.fixture(scope="module")
def corpus():
    base = [prose(i) for i in range(12)]
    near = base[0].split(" ")
    near[40] = "changed"
    rows = [(i, t, "en", f"s{i % 3}", len(t)) for i, t in enumerate(base)]
    rows += [(20, " ".join(near), "de", None, 1), (21, base[0], None, "s0", 1), (22, base[0].upper(), "en", "s1", 1)]
    rows += [(30, None, None, None, None), (31, "", "en", "s0", 0), (32, " \n\t ", "en", "s0", 3), (33, "one two", "en", "s9", 7), (34, "one two", "en", "s9", 7)]
    rows += [(40, "\n".join([prose(99, 30)] * 12) + "\n" + prose(77, 4000), "fr", "s2", 9), (41, prose(5, 30) + " " + base[3][:320] + " " + prose(6, 30), "en", "s1", 2)]
    return rows


def docs_of(spark, rows):
    return spark.createDataFrame(rows, DOC).withColumns({k: F.lit(v) for k, v in CLASH.items()})


def test_perfect_hash_is_minimal():
    for n in (1, 2, 7, 1000):
        keys = perfect_hash.mix(np.arange(n, dtype=np.uint64))
        seed, pilots = perfect_hash.build(keys)
        assert sorted(perfect_hash.slots(keys, seed, pilots, n).tolist()) == list(range(n))


def test_token_output_round_trip(spark, corpus):
    P = pytest.importorskip("public_tokenizers")
    from tokenizers import Tokenizer

    path = P.path("word_bpe_49k.json")
    rows = [*corpus, (None, "no key", None, None, 0), (50, "It's 12,3.. ŒUVRE<|endoftext|> ΣΑΣ. a_b é.", "en", "s", 1), (50, "again", "en", "s", 1)]
    t = Tokenizer.from_file(path)
    want = sorted(((r[0] is not None, r[0] or 0), tuple([*t.encode(r[1] or "", add_special_tokens=False).ids, 2])) for r in rows)
    folder = tokens.encoded(docs_of(spark, rows), path, 2)
    got = tokens.read_documents(spark, folder).collect()
    assert sorted((r.doc_id is not None, r.doc_id or 0, r.n_tokens, r.ids_crc32) for r in got) == sorted((*k, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())) for k, ids in want)
    at = 0
    for r in sorted(got, key=lambda r: r.start):
        assert r.start == at
        at += r.n_tokens
    ordered = [r.doc_id for r in sorted(got, key=lambda r: r.start)]
    assert ordered == sorted(ordered, key=lambda x: (x is not None, x or 0))
    keys = spark.createDataFrame([(50,), (31,), (777,), (None,)], "doc_id long")
    found = sorted((r.doc_id, tuple(r.ids)) for r in tokens.lookup(spark, folder, keys).collect())
    assert found == sorted((k[1], ids) for k, ids in want if k[0] and k[1] in (50, 31))
    assert tokens.read_documents(spark, tokens.encoded(docs_of(spark, []), path, 2)).count() == 0


def test_token_lookup_prunes_and_compares_keys(spark, monkeypatch):
    """One doc_id over several segments, null ids, buckets of few keys, and absent keys."""
    P = pytest.importorskip("public_tokenizers")
    monkeypatch.setattr(tokens, "SEGMENT_DOCS", 7)
    monkeypatch.setattr(tokens, "BUCKET_KEYS", 5)
    rows = [(7, f"text {i}", None, None, 0) for i in range(60)] + [(None, f"none {i}", None, None, 0) for i in range(30)] + [(10**15 + i, f"far {i}", None, None, 0) for i in range(20)]
    folder = tokens.encoded(docs_of(spark, rows), P.path("word_bpe_49k.json"), 2)
    found = tokens.read_documents(spark, folder).collect()
    assert collections.Counter(r.doc_id for r in found) == collections.Counter(r[0] for r in rows)
    assert sorted(r.start for r in found) == np.cumsum([0, *[r.n_tokens for r in sorted(found, key=lambda r: r.start)]])[:-1].tolist()
    keys = spark.createDataFrame([(7,), (10**15 + 3,), (8,), (None,)], "doc_id long")
    assert collections.Counter(r.doc_id for r in tokens.lookup(spark, folder, keys).collect()) == {7: 60, 10**15 + 3: 1}
    assert tokens.lookup(spark, folder, spark.range(5000).select(F.col("id").alias("doc_id")).where("doc_id <> 7")).count() == 0
    plan = tokens.lookup(spark, folder, keys)._jdf.queryExecution().toString()
    assert "In(shard" in plan and "In(segment" in plan


def test_chunk_encoder_is_the_vocabulary():
    P = pytest.importorskip("public_tokenizers")
    encoder, rnd = tokens.ChunkEncoder(P.path("word_bpe_49k.json")), random.Random(11)
    signs = [*map(chr, range(0x250)), "\u0301", "\u2028", "\u3000", "\ufeff", "..", ",,", "...", "'s", "<|", "_", "ß", "I\u0307"]
    stops = [".", ",", " ", "\n", "a", "\x1c", "\x1d", "\x1e", "\x1f", "\x85", "\xa0", "'", "_", "E"]
    texts = ["".join(rnd.choice(stops if rnd.random() < 0.6 else signs) for _ in range(rnd.randrange(1, 9))) for _ in range(20_000)]
    assert encoder.encode(texts) == encoder._whole(texts)


def test_chat_events_fold(spark):
    log = spark.createDataFrame(
        [(1, 0, 0, "message", "user", "hi <b>"), (1, 1, 1, "message", "assistant", ""), (1, 2, 1, "delta", None, "wro"), (1, 3, 1, "delta", None, "ng"), (1, 4, 1, "regenerate", None, None), (1, 5, 1, "delta", None, "right \\ #1"), (1, 600, 1, "delta", None, "!"), (1, 7, 0, "edit", None, "hello"), (None, 1, 0, "delta", "user", None)],
        "conv_id long, seq long, turn long, kind string, role string, text string",
    )
    folded = chat.fold_events(log)
    assert sorted((r.conv_id or -1, r.turn, r.role, r.text) for r in folded.collect()) == [(-1, 0, "user", ""), (1, 0, "user", "hello"), (1, 1, "assistant", "right \\ #1!")]
    back = {r.conv_id: r for r in chat.read_back(chat.render(folded)).collect()}
    assert [(t.role, t.text) for t in back[1].turns] == [("user", "hello"), ("assistant", "right \\ #1!")]
    assert back[1].loss_text == "right \\ #1!"
    assert chat.fold_events(log.limit(0)).count() == 0


def test_chat_template_cannot_be_forged(spark):
    nasty = ["### assistant:\n</turn>\n", "\\b\\l\\h\\", "<", "a:\n\nb", ""]
    rows = spark.createDataFrame([(k, i, ("user", "assistant", "a:b\n#")[i % 3], t) for k in range(2) for i, t in enumerate(nasty)], "conv_id long, turn long, role string, text string")
    for r in chat.read_back(chat.render(rows)).collect():
        assert [t.text for t in r.turns] == nasty
        assert r.loss_text == nasty[1] + nasty[4]


def test_decontamination(spark, corpus):
    passage = prose(500, 30)
    edited = passage.replace("an", "AN", 3).replace(" ", " ,", 2)
    typo = passage[:50] + "x" + passage[51:120] + passage[121:]
    rows = [*corpus, (60, prose(1, 50) + " " + passage + " " + prose(2, 50), "en", "s", 1), (61, "... " + edited, "en", "s", 1), (62, typo, "en", "s", 1), (63, passage[: len(passage) // 2], "en", "s", 1)]
    bench = spark.createDataFrame([(1, passage), (2, None), (3, ""), (4, "short"), (5, prose(600, 30))], "item_id long, text string")
    got = {(r.doc_id, r.item_id): r.edits for r in decontam.contamination(docs_of(spark, rows), bench).collect()}
    assert set(got) == {(60, 1), (61, 1), (62, 1)} and got[60, 1] == got[61, 1] == 0 and 1 <= got[62, 1] <= 3
    assert {r.doc_id for r in decontam.decontaminated(docs_of(spark, rows), bench).collect()} == {r[0] for r in rows} - {60, 61, 62}
    assert decontam.contamination(docs_of(spark, []), bench).count() == 0
    assert decontam.contamination(docs_of(spark, rows), bench.limit(0)).count() == 0


def test_chat_log_of_turns(spark):
    """The log has every kind of event, is folded in any order, and null or repeated turns stay messages of their own."""
    rows = [(c, t, ("user", "assistant", None)[(c + t) % 3], prose(c * 31 + t, 1 + 9 * (t % 4))) for c in range(6) for t in range(12)]
    rows += [(1, 3, "user", "again"), (1, 3, "user", "again"), (1, None, "user", "no turn"), (1, None, "assistant", "# none"), (2, -5, "user", "early"), (2, 300, "user", None), (3, 0, None, None), (None, 1, "user", "lost")]
    log = chat.transcript_log(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    kinds = {r.kind: r["count"] for r in log.groupBy("kind").count().collect()}
    assert set(kinds) == {"message", "delta", "edit", "regenerate"} and min(kinds.values()) > 10 and kinds["message"] == len(rows)
    folded = chat.fold_events(log.orderBy(F.rand(5)), message=("turn", "copy"))
    assert collections.Counter((r.conv_id, r.turn, r.role, r.text) for r in folded.collect()) == collections.Counter((c, t, r or "", x or "") for c, t, r, x in rows)
    by = collections.defaultdict(list)
    for c, t, r, x in sorted(rows, key=lambda x: (x[1] is not None, x[1] or 0, x[2] or "", x[3] or "")):
        by[c].append((r or "", x or ""))
    got = {r.conv_id: [(t.role, t.text) for t in r.turns] for r in chat.read_back(chat.render(folded, order=("turn", "copy"))).collect()}
    assert got == dict(by)
    wrong = chat.fold_events(log.where("kind NOT IN ('edit', 'regenerate')"), message=("turn", "copy"))
    assert {(r.conv_id, r.turn, r.role, r.text) for r in wrong.collect()} != {(c, t, r or "", x or "") for c, t, r, x in rows}


def plain_match(item, text, most):
    """(edits, start, end) of the best match by the whole table of edit distances, one start at a time."""
    best = None
    for s in range(len(text) + 1):
        row = list(range(len(item) + 1))
        for j in range(s, len(text) + 1):
            if j > s:
                new = [row[0] + 1]
                for i in range(1, len(item) + 1):
                    new.append(min(row[i] + 1, new[i - 1] + 1, row[i - 1] + (item[i - 1] != text[j - 1])))
                row = new
            if row[-1] <= most and (best is None or (row[-1], s, j) < best):
                best = (row[-1], s, j)
            if j - s > len(item) + most:
                break
    return best


def test_decontamination_finds_all_within_the_budget(spark, monkeypatch):
    """Against plain edit distance, with passages in several blocks, repeated item_ids and repeated rows."""
    monkeypatch.setattr(decontam, "BLOCK_BYTES", 150)
    rnd, items = random.Random(3), [(k % 5, prose(800 + k, 6 + 3 * k)) for k in range(6)]
    rows = []
    for i in range(20):
        passage = list(items[i % 6][1])
        for _ in range(rnd.randrange(0, 7)):
            at, kind = rnd.randrange(len(passage)), rnd.randrange(3)
            passage[at : at + (kind < 2)] = [] if kind == 0 else [rnd.choice("xyz")]
        rows.append((i // 2, prose(i, 3) + " " + "".join(passage) + " " + prose(i + 50, 3), "en", "s", 1))
    want = collections.Counter()
    for d, text, *_ in rows:
        for item, passage in items:
            own = decontam.normalised(passage)
            if len(own) >= decontam.Q and (found := plain_match(own, decontam.normalised(text), decontam.edit_budget(len(own)))):
                want[(d, item, *found)] += 1
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = collections.Counter((r.doc_id, r.item_id, r.edits, r.start, r.end) for r in decontam.contamination(docs_of(spark, rows), bench).collect())
    assert len(want) > 10 and got == want
    left = collections.Counter(r.text for r in decontam.decontaminated(docs_of(spark, rows), bench).collect())
    assert left == collections.Counter(r[1] for r in rows) - collections.Counter(r[1] for r in rows if any(plain_match(decontam.normalised(p), decontam.normalised(r[1]), decontam.edit_budget(len(decontam.normalised(p)))) for _, p in items))


def brute_repeats(texts, length):
    seen = collections.Counter(t[p : p + length] for t in texts for p in range(len(t) - length + 1))
    out = []
    for t in texts:
        gone = np.zeros(len(t), bool)
        for p in range(len(t) - length + 1):
            if seen[t[p : p + length]] > 1:
                gone[p : p + length] = True
        runs = int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum())
        out.append((len(t), int(gone.sum()), runs, hashlib.sha256(np.frombuffer(t, np.uint8)[~gone].tobytes()).hexdigest()))
    return out


@pytest.mark.parametrize("bucket", [1000, 1])
def test_repeated_strings_are_exact(spark, corpus, monkeypatch, bucket):
    monkeypatch.setattr(suffix, "BUCKET", bucket)
    rows = [*corpus, (70, "ab" * 400, "en", "s", 1), (71, prose(8, 60) + corpus[4][1][100:330] + prose(9, 40), "en", "s", 1), (21, "same id", "en", "s", 1)]
    got = collections.Counter((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffix.repeats_removed(docs_of(spark, rows)).collect())
    want = collections.Counter((r[0], *x) for r, x in zip(rows, brute_repeats([(r[1] or "").encode() for r in rows], 200), strict=True))
    assert got == want


def test_repeats_of_nothing(spark):
    assert suffix.repeats_removed(docs_of(spark, [])).count() == 0


def test_lcp_intervals_list_all_groups():
    rnd = random.Random(4)
    entries = sorted({(bytes(rnd.choices(b"ab", k=6)), bytes(rnd.choices(b"ab", k=8)) + b"x" * 192) for _ in range(30)}, key=lambda e: e[1])
    for (left, right), spans in zip(entries, suffix.repeated_reaches(entries, 0, 6), strict=True):
        want = {j for j in range(len(left) + 1) if sum(e[0][:j] == left[:j] and e[1][: 200 - j] == right[: 200 - j] for e in entries) > 1}
        assert {j for a, b in spans for j in range(a, b + 1)} == want


def plain_counts(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    grams = collections.Counter(zip(words, words[1:], words[2:]))
    held = {i + k for i in range(len(words) - 2) if grams[tuple(words[i : i + 3])] > 1 for k in range(3)}
    return (len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(held))


def test_quality_counts_and_thresholds(spark, corpus):
    rows = [*corpus, (80, "a b c a b c\nx\nx\n y #*$\n", "en", "s", 1)]
    rows += [(1000 + i, prose(i, 60), ("en", "de", None)[i % 3], "s", 1) for i in range(900)] + [(2000 + i, prose(i, 60).replace(" ", "# "), ("en", "fr")[i % 2], "s", 1) for i in range(40)]
    rows += [(3000 + i, prose(i, 60).replace(" ", "! ", 6), ("en", None)[i % 2], "s", 1) for i in range(30)]
    marks = [(1000 + i, 1, 0) for i in range(900)] + [(2000 + i, 0, 0) for i in range(40)] + [(3000 + i, int(i % 5 == 0), 0) for i in range(30)] + [(1000, 1, 1), (None, 1, 0), (1001, None, 0)]
    labels = spark.createDataFrame(marks, "doc_id long, quality int, toxic int")
    got = {r.doc_id: r for r in quality.quality_verdicts(docs_of(spark, rows), labels).collect()}
    want, cells = plain_quality(rows, marks)
    assert cells["en"] and cells[None] and not cells["fr"] and not cells["de"] and cells["*"]
    for r in rows:
        g = got[r[0]]
        assert (g.n_words, g.word_chars, g.n_symbols, g.n_dup_lines, g.n_repeat_words) == plain_counts(r[1]), r[0]
        assert g.base_failed == (g.n_words < 50 or 100 * g.n_repeat_words > 50 * g.n_words)
        assert g.kept == want[r[0]], r[0]
    assert not any(got[2000 + i].kept for i in range(40))
    assert quality.quality_verdicts(docs_of(spark, []), labels).count() == 0
    assert all(r.kept == (not r.base_failed) for r in quality.quality_verdicts(docs_of(spark, rows), labels.limit(0)).collect())


def plain_quality(rows, marks):
    """kept of each document and certified cells of each stratum ("*": all), by loops."""
    rate, lang, failed = {}, {}, {}
    for d, text, where, *_ in rows:
        n, chars, symbols, dups, repeats = plain_counts(text)
        shouts = (text or "").count("!")
        rate[d] = [1000 * symbols // max(chars, 1), 1000 * shouts // max(chars, 1), 1000 * dups // max(n, 1), 1000 * repeats // max(n, 1)]
        lang[d], failed[d] = where, n < 50 or 100 * repeats > 50 * n
    told = {}
    for d, q, _ in marks:
        if q is not None:
            told[d] = min(q, told.get(d, q))
    held = [d for d in told if d in rate and not failed[d]]
    strata = {lang[d] for d in held}
    cells = {}
    for s in [*strata, "*"]:
        own = [d for d in held if s == "*" or lang[d] == s]
        first = [d for d in own if hashlib.md5(str(d).encode()).hexdigest()[0] < "8"]
        rest = [d for d in own if d not in set(first) and told[d] == 1]
        found = []
        for rule in range(4):
            for at in quality.CUTOFFS:
                good = sum(told[d] == 1 and rate[d][rule] > at for d in first)
                bad = sum(told[d] == 0 and rate[d][rule] > at for d in first)
                if bad * sum(told[d] == 1 for d in first) > good * sum(told[d] == 0 for d in first):
                    found.append((good, -bad, rule, -at))
        cells[s] = []
        for *_, rule, at in sorted(found):
            now = [*cells[s], (rule, -at)]
            k, n = sum(any(rate[d][r] > c for r, c in now) for d in rest), len(rest)
            if k > n * 0.05 or sum(math.comb(n, j) * 0.05**j * 0.95 ** (n - j) for j in range(k + 1)) > 0.05 / (len(strata) + 1):
                break
            cells[s] = now
    use = {s: cells.get(s) or cells["*"] for s in {*lang.values()}}
    cells = collections.defaultdict(list, cells)
    return {d: not failed[d] and not any(rate[d][r] > c for r, c in use[lang[d]]) for d in rate}, cells


def test_binomial_tail(spark):
    from math import comb

    cases = [(0, 100, 0.05), (3, 200, 0.02), (9, 1000, 0.01), (7, 100, 0.05)]
    df = spark.createDataFrame([(k, n) for k, n, _ in cases], "k long, n long")
    for i, (k, n, p) in enumerate(cases):
        got = df.where((F.col("k") == k) & (F.col("n") == n)).select(quality.binomial_tail(F.col("k"), F.col("n"), p).alias("t")).first().t
        assert got == pytest.approx(1.0 if k > n * p else sum(comb(n, j) * p**j * (1 - p) ** (n - j) for j in range(k + 1)), rel=1e-9)


def test_toxicity_learns_and_restores(spark):
    bad, rows, labels = ["moronic", "scumbag", "worthless"], [], []
    for i in range(300):
        toxic = i % 3 == 0
        text = prose(i, 40) + (f" {bad[i % 9 // 3]} " if toxic else " ") + prose(i + 1, 10)
        rows.append((i, text, "en", "s", 1))
        labels.append((i, 1, int(toxic)))
    hidden = ["m0r0n1c", "w o r t h l e s s", "scuuuumbag", "$cumbag", "wor-th.less", "m\u043er\u043enic", "w\u03bfrthl\u0435ss", "\uff53\uff43\uff55\uff4d\uff42\uff41\uff47"]
    rows += [(1000 + k, prose(k, 30) + " " + w + " " + prose(k + 50, 30), "en", "s", 1) for k, w in enumerate(hidden)]
    rows += [(2000, None, None, None, None), (2001, "", "en", "s", 0), (0, prose(3), "en", "s", 1)]
    table = spark.createDataFrame([*labels, (999_999, 1, 1), (5, None, None)], "doc_id long, quality int, toxic int")
    got = [(r.doc_id, r.predicted, r.score, r.held_out) for r in toxicity.toxicity_scores(docs_of(spark, rows), table).collect()]
    assert len(got) == len(rows)
    by = {g[0]: g for g in got if g[0] != 0}
    assert all(by[i][1] == int(i % 3 == 0) for i in range(1, 300))
    assert [by[1000 + k][1] for k in range(len(hidden))] == [1] * len(hidden)
    assert by[2000][1] == by[2001][1] == 0
    assert all(h == (zlib.crc32(str(d).encode()) % 5 == 0) for d, _, _, h in got)
    assert toxicity.toxicity_scores(docs_of(spark, []), table).count() == 0
    assert all(r.score < 1e-9 for r in toxicity.toxicity_scores(docs_of(spark, rows[:3]), table.limit(0)).collect())


def test_toxicity_restores_more_disguises(spark):
    """Letters doubled, words in pieces, letters with any white space between, and signs at an edge."""
    bad, rows, labels = ["moronic", "scumbag", "worthless", "classhole"], [], []
    for i in range(400):
        toxic = i % 4 == 0
        rows.append((i, prose(i, 40) + (f" {bad[i % 16 // 4]} " if toxic else " ") + prose(i + 1, 10), "en", "s", 1))
        labels.append((i, 1, int(toxic)))
    hidden = ["moroniic", "classhoole", "worrthless", "scu mbag", "mo ro nic", "w  o\nr\tt  h l e\ns s", "$$cumbag", "(lasshole", "worthle$$"]
    rows += [(1000 + k, prose(k, 30) + " " + w + " " + prose(k + 50, 30), "en", "s", 1) for k, w in enumerate(hidden)]
    table = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    by = {r.doc_id: r.predicted for r in toxicity.toxicity_scores(docs_of(spark, rows), table).collect()}
    assert {w: by[1000 + k] for k, w in enumerate(hidden)} == dict.fromkeys(hidden, 1)
    assert all(by[i] == int(i % 4 == 0) for i in range(400))


def test_viterbi_is_the_cheapest_of_all_readings():
    rng, rnd = np.random.default_rng(2), random.Random(2)
    restorer = toxicity.Restorer(rng.uniform(0.1, 5, (64, 64, 64)))
    for _ in range(200):
        token = "".join(rnd.choice("ab01$.-!eéо") for _ in range(rnd.randrange(1, 6)))
        best = None
        for path in itertools.product(*restorer.options(token)):
            a = b = price = 0
            for sign, extra in path:
                price += extra
                if sign:
                    c = 0 if sign == " " else int(toxicity.classes(sign)[0])
                    price += restorer.costs[a][b][c]
                    a, b = b, c
            price += restorer.costs[a][b][0]
            if best is None or price < best[0]:
                best = (price, "".join(s for s, _ in path))
        assert "".join(restorer.decode(token)) == best[1].replace(" ", ""), token


def plain_spans(text):
    out = [(m.start(), 0, m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    out += [(m.start(), 1, m.end()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(x) <= 255 for x in m.group().split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        d = re.sub(r"\D", "", m.group())
        if 12 <= len(d) <= 19 and sum(sum(divmod(int(c) * (1 + k % 2), 10)) for k, c in enumerate(reversed(d))) % 10 == 0:
            out.append((m.start(), 2, m.end()))
    out += [(m.start(), 3, m.end()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 9 <= len(re.sub(r"\D", "", m.group())) <= 15]
    return sorted(out)


def test_pii_base_patterns():
    fixed = ["a@b.c@d.e.f x@y z@-.q", "1.2.3.4.5.6.7.8 300.1.1.1 0001.2.3.255 1.2.3.0000300", "4111 1111 1111 1111 4111-1111-1111-1112 +1 (663) 555-6869.", "+12 +1234567890123456 ++49 30 1234567-", "é@b.de .@x.y %+-@a.b"]
    rnd = random.Random(1)
    fixed += ["".join(rnd.choices("a1@.+- (4", k=60)) for _ in range(400)]
    for text in fixed:
        assert pii.base_spans(text) == plain_spans(text), text


def test_pii_disclosing_terms(spark, corpus):
    rows = [*corpus] + [(100 + i, f"{prose(i, 20)} contact Zanzibarius at boss@corp.example.com the {prose(i + 9, 20)}", "en", "s", 1) for i in range(5)] + [(200 + i, prose(i + 900, 4), "en", "s", 1) for i in range(400)]
    got = {r.doc_id: r for r in pii.pii_spans(docs_of(spark, rows)).collect()}
    assert len(got) == len(rows)
    for r in rows:
        assert [(s.start, s.kind, s.end) for s in got[r[0]].base] == plain_spans(r[1] or "")
    told = {next(r[1] for r in rows if r[0] == 104)[s.start : s.end] for s in got[104].terms}
    assert "Zanzibarius" in told
    clean = {r.doc_id: r.text for r in pii.sanitised(docs_of(spark, rows)).collect()}
    assert "boss@" not in clean[104] and "Zanzibarius" not in clean[104] and "[EMAIL]" in clean[104] and clean[30] is None and clean[0] == rows[0][1]
    assert pii.pii_spans(docs_of(spark, [])).count() == 0


def test_pii_terms_of_whole_documents(spark):
    """A giveaway far from its entity, one where the entity is missing, and one that goes with values that are rare each."""
    far = [(100 + i, f"Zanzibarius, {prose(i, 30)} boss@corp.example.com", "en", "s", 1) for i in range(4)]
    rare = [(200 + i, f"+1 663 555 {1000 + i} {prose(i + 40, 30)} (Quuxline)", "en", "s", 1) for i in range(4)]
    rows = [*far, (110, f"{prose(70, 10)} Zanzibarius {prose(71, 10)}", "en", "s", 1), *rare]
    rows += [(1000 + i, prose(i + 900, 20), "en", "s", 1) for i in range(600)]
    text = {r[0]: r[1] for r in rows}
    told = {r.doc_id: {text[r.doc_id][s.start : s.end] for s in r.terms} for r in pii.pii_spans(docs_of(spark, rows)).collect()}
    assert all("Zanzibarius" in told[d] for d in (100, 101, 102, 103, 110))
    assert all("Quuxline" in told[200 + i] for i in range(4))
    clean = {r.doc_id: r.text for r in pii.sanitised(docs_of(spark, rows)).collect()}
    assert clean[110] == text[110].replace("Zanzibarius", "") and clean[1000] == text[1000]


def plain_components(rows, words):
    sets = {}
    for d, text, *_ in rows:
        w = (text or "").encode().lower().split()
        sets[d] = ({tuple(w[i : i + words]) for i in range(len(w) - words + 1)} or {tuple(w)}) if w else set()
    root = {d: d for d in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[:i]:
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {d: (len(sets[d]), find(d)) for d in sets}


@pytest.mark.parametrize("small", [False, True])
def test_near_duplicates(spark, corpus, monkeypatch, small):
    """In chunks of many documents, and of so few that buckets stay open after the first round; a few keys hot."""
    if small:
        monkeypatch.setattr(minhash, "BLOCK_DOCS", 4)
        monkeypatch.setattr(minhash, "BLOCK_SHINGLES", 400)
        monkeypatch.setattr(common, "HOT_KEYS", 3)
        monkeypatch.setattr(common, "LEAST_HOT", 1)
    rows, rnd, base = list(corpus), random.Random(7), prose(4000, 120).split(" ")
    for i in range(40):
        own = list(base)
        for _ in range(rnd.randrange(0, 6)):
            own[rnd.randrange(len(own))] = f"w{rnd.randrange(1000)}"
        rows.append((300 + i, " ".join(own), "en", "s", 1))
    for i in range(40):  # a chain of groups, each near the next
        own = prose(4002, 60).split(" ")
        own[: i // 2] = [f"v{k}" for k in range(i // 2)]
        own[50] = f"u{i}"
        rows.append((500 + i, " ".join(own), "en", "s", 1))
    shared = prose(4001, 40)
    rows += [(400 + i, prose(i + 70, 60) + " " + shared, "en", "s", 1) for i in range(10)]
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in minhash.near_duplicates(docs_of(spark, rows)).collect()}
    want = plain_components(rows, 4)
    assert got == {d: (n, c, c == d) for d, (n, c) in want.items()}


def test_near_duplicates_edges(spark):
    assert minhash.near_duplicates(docs_of(spark, [])).count() == 0
    rows = [(None, "a b c d e f", "en", "s", 1), (None, "a b c d e f", "en", "s", 1), (5, "a b c d e f", "en", "s", 1), (5, "a b c d e f", "en", "s", 1), (9, "A B c d e f", "en", "s", 1)]
    got = minhash.near_duplicates(docs_of(spark, rows)).collect()
    assert {(r.doc_id, r.component_id, r.kept) for r in got} == {(None, None, True), (5, 5, True), (9, 5, False)}
    assert minhash.deduplicated(docs_of(spark, rows)).where("doc_id IS NOT NULL").count() == 1


def test_shared_counts_by_products_and_pairs():
    rng = np.random.default_rng(3)
    sets = [np.unique(rng.integers(0, 200, rng.integers(1, 120))) for _ in range(90)]
    got = minhash.shared_counts(sets)
    for i in range(90):
        for j in range(90):
            if i != j:
                assert got[i, j] == len(np.intersect1d(sets[i], sets[j]))


def water_level(sizes, weights, most):
    total, open_, out = sum(sizes.values()), dict(weights), {}
    left = total
    while open_:
        level = left / sum(open_.values())
        over = [s for s in open_ if level * open_[s] > most * sizes[s]]
        if not over:
            return out | {s: level * w for s, w in open_.items()}
        for s in over:
            out[s] = most * sizes[s]
            left -= out[s]
            del open_[s]
    return out


def test_mixing_targets_and_draws(spark, corpus):
    rows = list(corpus) + [(500 + i, prose(i, 100), "en", "big", 1) for i in range(60)] + [(900, "tiny one", "en", "aa", 1)]
    docs = docs_of(spark, rows)
    got = mixing.draws(docs).collect()
    assert len(got) == len(rows)
    sizes = collections.Counter()
    for r in rows:
        sizes[r[3]] += len(re.findall(r"[^\x20\x09-\x0D]+", r[1] or ""))
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    want = water_level(sizes, {s: (1, 2, 3)[i % 3] for i, s in enumerate(names)}, 3)
    taken = collections.Counter()
    for r in got:
        mine = sum(d["to"] - d["from"] for d in r.draws)
        assert 0 <= mine <= 3 * r.size
        taken[r.source] += mine
        assert r.target == pytest.approx(want[r.source]) and r.source_size == sizes[r.source]
    for s in names:
        assert abs(taken[s] - want[s]) <= 2
    again = {r.doc_id: r.draws for r in mixing.draws(docs.repartition(3)).collect()}
    assert again == {r.doc_id: r.draws for r in got}
    words = {r.doc_id: r.taken for r in mixing.mixed_words(docs).collect()}
    assert words == {r.doc_id: sum(d["to"] - d["from"] for d in r.draws) for r in got}
    rows_ = mixing.mixture(mixing.draws(docs)).collect()
    by = collections.defaultdict(list)
    for r in rows_:
        by[r.shard].append(r.slot)
    assert all(sorted(v) == list(range(len(v))) for v in by.values()) and sum(r.word_to - r.word_from for r in rows_) == sum(taken.values())
    assert mixing.draws(docs_of(spark, [])).count() == 0
    mixed = mixing.mixed_documents(docs)
    assert mixed.columns == docs.columns and {r.doc_id for r in mixed.collect()} <= {r[0] for r in rows}


def test_splitting_tree_keeps_quotas(spark):
    by = spark.createDataFrame([("a", 0, 500), ("b", 1, 7), (None, 3, 0), ("c", 2, 3000)], "source string, rank long, quota long")
    got = {r.source: r.bounds for r in mixing.splitting_tree(by, 12).collect()}
    assert {s: b[-1] for s, b in got.items()} == {"a": 500, "b": 7, None: 0, "c": 3000}
    assert all(len(b) == 13 and sorted(b) == b for b in got.values())
    shares = [sum(b[i + 1] - b[i] for b in got.values()) for i in range(12)]
    assert max(shares) - min(shares) <= 4


def test_splitting_tree_in_chunks(spark, monkeypatch):
    """Sources over three floors of chunks; quotas add up and a source's part of a shard is near its fair share."""
    monkeypatch.setattr(mixing, "CHUNK", 3)
    by = spark.createDataFrame([(f"s{i}", i, 40 + 10 * i) for i in range(20)], "source string, rank long, quota long")
    got = {r.rank: r.bounds for r in mixing.splitting_tree(by, 6).collect()}
    assert {k: b[-1] for k, b in got.items()} == {i: 40 + 10 * i for i in range(20)}
    parts = {k: [b[i + 1] - b[i] for i in range(6)] for k, b in got.items()}
    assert all(min(p) >= 0 for p in parts.values())
    shares = [sum(p[i] for p in parts.values()) for i in range(6)]
    assert max(shares) - min(shares) <= 3
    far = [(x - q / 6) / (q * 5 / 36) ** 0.5 for k, p in parts.items() for q in [40 + 10 * k] for x in p]
    assert max(map(abs, far)) < 5 and 0.5 < sum(x * x for x in far) / len(far) < 1.5  # random, not dealt in turn


def test_block_orders_are_permutations(spark):
    for m in (1, 2, 3, 17, 64, 200):
        at = lambda *key: [r.p for r in spark.range(m).select("id", mixing.permuted(F.col("id"), F.lit(m).cast("long"), F.lit(math.isqrt(m - 1) + 1).cast("long"), F.xxhash64(*map(F.lit, key))).alias("p")).orderBy("id").collect()]  # noqa: B023, E731
        one, two, other = at(0, 0, "a"), at(1, 0, "a"), at(0, 0, "b")
        assert sorted(one) == sorted(two) == sorted(other) == list(range(m))
        assert m < 17 or len({tuple(one), tuple(two), tuple(other)}) == 3
    steps = collections.Counter((b - a) % 200 for a, b in zip(one, one[1:]))
    assert max(steps.values()) <= 6  # no fixed stride


def test_hypergeometric_draws_follow_the_law(spark):
    df = spark.range(4000).select(mixing.hypergeometric(F.lit(50), F.lit(20), F.lit(25), (F.col("id") + 0.5) / 4000).alias("x"))
    from math import comb

    got = collections.Counter(r.x for r in df.collect())
    for k in range(5, 16):
        assert abs(got[k] / 4000 - comb(20, k) * comb(30, 25 - k) / comb(50, 25)) < 0.002


def test_sharding(spark, corpus):
    rows = [*corpus] + [(1000 + i, prose(i, 5 + i % 50), ("en", "de", None)[i % 3], "s", 1) for i in range(600)] + [(5000 + i, "copy of one text " * 9, "en", "s", 1) for i in range(300)] + [(None, "x", None, None, None), (7, prose(7), "en", "s1", 1)]
    got = sharding.sharded(docs_of(spark, rows), 24).collect()
    assert sorted((r.doc_id or -1, r.text_crc32, r.size) for r in got) == sorted((r[0] if r[0] else (-1 if r[0] is None else 0) or -1, zlib.crc32((r[1] or "").encode()), len((r[1] or "").encode()) + 8) for r in rows)
    weight, slots = collections.Counter(), collections.defaultdict(list)
    for r in got:
        weight[r.shard] += r.size
        slots[r.shard].append(r.slot)
    assert set(weight) <= set(range(24)) and all(sorted(v) == list(range(len(v))) for v in slots.values())
    longest = max(r.size for r in got)
    assert max(weight.values()) - min(weight.values()) <= longest + 0.1 * sum(weight.values()) / 24
    again = {(r.doc_id, r.text_crc32): r.shard for r in sharding.sharded(docs_of(spark, rows).repartition(3), 24).collect() if r.doc_id != 7}
    assert again == {(r.doc_id, r.text_crc32): r.shard for r in got if r.doc_id != 7}
    assert sharding.sharded(docs_of(spark, []), 24).count() == 0
    assert sharding.sharded(docs_of(spark, rows[:3]), 24).count() == 3


def plain_shards(rows, shards):
    """A k-d tree over (doc_id, size, crc, lang, source, length) in plain Python: {(doc_id, crc): shard}."""
    total = sum(r[1] for r in rows)

    def ranks(values):
        below, out = 0, {}
        for v in sorted(values, key=lambda v: (v is not None, v)):
            out[v] = math.floor(below * (65535 / total))
            below += values[v]
        return out

    least = collections.defaultdict(list)
    for r in rows:
        least[r[1], r[2]].append(r)
    first = lambda v: min(v, key=lambda x: (x is not None, x))
    points = [(r[0], r[1], r[2], (math.floor(math.log2(r[1] + 1) * 64), math.floor(math.log2(r[5] + 1) * 64), first([x[3] for x in least[r[1], r[2]]]), first([x[4] for x in least[r[1], r[2]]]))) for r in rows]
    weights = [collections.Counter() for _ in range(4)]
    for p in points:
        for k in range(4):
            weights[k][p[3][k]] += p[1]
    scale = [ranks(w) for w in weights]
    points = [(p[0], p[1], p[2], tuple(scale[k][p[3][k]] for k in range(4))) for p in points]
    out = {}

    def quantile(pairs, goal):
        before, runs = 0, sorted(collections.Counter({k: 0 for k, _ in pairs}).items())
        weight = collections.Counter()
        for k, w in pairs:
            weight[k] += w
        for k, _ in runs:
            if before + weight[k] > goal or k == runs[-1][0]:
                return k, before, weight[k]
            before += weight[k]

    def grow(own, f, n):
        if n == 1 or not own:
            out.update({(p[0], p[2]): f for p in own})
            return
        d = max(range(4), key=lambda i: (max(p[3][i] for p in own) - min(p[3][i] for p in own), -i))
        key = lambda p: (p[3][d] << 32) + p[2]
        goal = sum(p[1] for p in own) * (n // 2) / n
        k, before, w = quantile([(key(p), p[1]) for p in own], goal)
        left = goal - before > w / 2
        assert w <= total / shards  # this plain version cuts no run
        go = {id(p): key(p) < k or (left and key(p) == k) for p in own}
        others = [p for p in own if key(p) != k]
        if 0.001 * total / shards < w and others and goal - w * left >= 0:
            k2, before, w2 = quantile([(key(p), p[1]) for p in others], goal - w * left)
            more = goal - w * left - before > w2 / 2
            go = {id(p): left if key(p) == k else key(p) < k2 or (more and key(p) == k2) for p in own}
        grow([p for p in own if go[id(p)]], f, n // 2)
        grow([p for p in own if not go[id(p)]], f + n // 2, n - n // 2)

    grow(points, 0, shards)
    return out


def test_sharding_is_the_plain_tree(spark):
    rnd = random.Random(5)
    rows = [(i, prose(i % 170, 3 + i % 37), rnd.choice(["en", "de", None]), rnd.choice(["a", "b", "c", None]), 1) for i in range(240)]
    got = {(r.doc_id, r.text_crc32): r.shard for r in sharding.sharded(docs_of(spark, rows), 6).collect()}
    plain = [(r[0], len(r[1].encode()) + 8, zlib.crc32(r[1].encode()), r[2], r[3], len(r[1])) for r in rows]
    assert got == plain_shards(plain, 6)
    by_text = collections.defaultdict(set)
    for (_, crc), shard in got.items():
        by_text[crc].add(shard)
    assert all(len(v) == 1 for v in by_text.values())


def test_sharded_documents(spark, corpus):
    rows = [*corpus, corpus[0], corpus[0], (None, None, None, None, None), (7, "other", "de", "s", 1)]
    docs = docs_of(spark, rows)
    got = sharding.sharded_documents(docs, 3)
    assert set(docs.columns) - {"size", "shard"} <= set(got.columns)
    told = got.collect()
    assert collections.Counter((r.doc_id, r.text) for r in told) == collections.Counter((r[0], r[1]) for r in rows)
    assert len({(r.doc_id, r.text, r.copy) for r in told}) == len(rows) == len({(r.shard, r.slot) for r in told})
    assert sharding.sharded_documents(docs.limit(0), 3).count() == 0


def test_mixing_sources_without_words(spark):
    rows = [(1, "", "en", "empty", 0), (2, None, "en", "empty", 0), (3, "a b c", "en", "full", 5), (3, "a b c", "en", "full", 5)]
    got = sorted((r.doc_id, r.size, r.target, sum(d["to"] - d["from"] for d in r.draws)) for r in mixing.draws(docs_of(spark, rows)).collect())
    assert got == [(1, 0, 0.0, 0), (2, 0, 0.0, 0), (3, 3, 6.0, 3), (3, 3, 6.0, 3)]
    assert mixing.draws(docs_of(spark, rows[:2])).count() == 2
    assert {r.doc_id for r in mixing.mixed_documents(docs_of(spark, rows)).collect()} == {3}


def test_mixed_documents_without_ids(spark):
    """Rows that share a null or repeated doc_id are taken as often as each is drawn."""
    rows = [(None, prose(i, 5 + i % 40), "en", "aa", i) for i in range(200)] + [(None, "", "en", "aa", 0)]
    rows += [(7, "a copy of a row", "en", "bb", 1)] * 6 + [(1000 + i, prose(300 + i, 40), "en", "bb", 1) for i in range(300)]
    docs = docs_of(spark, rows)
    want = collections.Counter()
    for r in mixing.draws(docs, whole=True, key=F.xxhash64("doc_id", "source", "text")).collect():
        want[r.key] += len(r.draws)
    mixed = mixing.mixed_documents(docs)
    assert mixed.columns == docs.columns
    got = collections.Counter(r.k for r in mixed.select(F.xxhash64("doc_id", "source", "text").alias("k")).collect())
    assert got == +want and mixed.where("text = ''").count() == 0
    target = {r.source: r.target for r in mixing.draws(docs).select("source", "target").distinct().collect()}
    taken = collections.Counter()
    for r in mixed.collect():
        taken[r.source] += len(r.text.split())
    assert all(abs(taken[s] - target[s]) < 0.1 * target[s] for s in target)


def test_repeated_rows_everywhere(spark):
    long = prose(1, 90)
    rows = [(1, long, "en", "s", 1), (1, long, "en", "s", 1), (2, "short", "en", "s", 1), (2, "short", "en", "s", 1), (None, long, None, None, None)]
    got = [(r.doc_id, r.n_removed, r.n_spans) for r in suffix.repeats_removed(docs_of(spark, rows)).collect()]
    n = len(long.encode())
    assert sorted(got, key=str) == sorted([(1, n, 1), (1, n, 1), (2, 0, 0), (2, 0, 0), (None, n, 1)], key=str)
    assert len(pii.pii_spans(docs_of(spark, rows)).collect()) == 5
    assert len(sharding.sharded(docs_of(spark, rows)).collect()) == 5


def test_pipeline_stages_on_odd_rows(spark, corpus, tmp_path):
    """Nulls, repeated and empty rows, empty tables, and columns named as the stages' own."""
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    bench = spark.createDataFrame([(1, prose(500, 30)), (2, None)], "item_id long, text string")
    labels = spark.createDataFrame([(i, 1, int(i == 1)) for i in range(12)] + [(None, None, None)], "doc_id long, quality int, toxic int")
    bench.write.parquet(f"{tmp_path}/benchmark.parquet")
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    rows = [*corpus, corpus[2], corpus[2], (None, prose(77, 60), "en", "s1", 1), (None, prose(78, 60), None, None, None), (None, None, None, None, None), (61, prose(1, 20) + " " + prose(500, 30), "en", "s", 1)]
    clash = {k: F.lit(k) for k in ("_id", "_n", "_ns", "_key", "_copy", "_toxicity", "_slots", "_size", "_doc_id", "node", "row")}
    docs = spark.createDataFrame(rows, DOC).withColumns(clash)
    for table in (docs, docs.limit(0)):
        for name, stage in corpus_pipeline.STAGES:
            got = stage(spark, table, str(tmp_path))
            told = [tuple(r) for r in got.select(*docs.columns).collect()]
            known = {tuple(r) for r in table.collect()}
            assert set(told) <= known, name
            assert name == "sharding" or got.columns == docs.columns
            if name == "decontamination" and known:
                assert {r[0] for r in known} - {r[0] for r in told} == {61}
            if name in ("toxicity", "sharding"):
                assert len(told) == table.count()
            if name == "near_dedup" and known:
                assert len([r for r in told if r[0] in (0, 21)]) == 1 and len([r for r in told if r[0] is None]) == 3
