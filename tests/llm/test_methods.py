"""Results that come from the dealt methods: the mix's shards from its tree, disclosure not from copies, alignment of repetitive texts."""

import collections
import itertools
import math
import random
import re
import time

import pytest
from pyspark.sql import functions as F

from spanwright.llm import decontam, mixing, pii

DOC = "doc_id long, text string, lang string, source string"


def shard_faults(rows, shards):
    """What is wrong with the shards of a mix: of each source, draws may differ by one block's words between two halves of a node."""
    total, found = [0] * shards, []
    for r in rows:
        if sum(r.shard_words) != r.taken or [w > 0 for w in r.shard_words] != [s is not None for s in r.shard_slots]:
            found.append(r.row)
        total = [a + b for a, b in zip(total, r.shard_words, strict=True)]
    if max(total) - min(total) > 0.02 * max(total) + 200:
        found.append(total)
    return found


@pytest.fixture(scope="module")
def mixed(spark):
    rnd = random.Random(2)
    rows = [(i, " ".join(["w"] * rnd.randrange(0, 300)), "en", rnd.choice(["a", "a", "a", "b", "c", None])) for i in range(400)]
    return spark.createDataFrame(rows, DOC)


def test_mix_tells_its_shards(mixed):
    rows = mixing.mixed_words(mixed, shards=6).collect()
    assert shard_faults(rows, 6) == [] and len(rows) == 400
    again = {r.doc_id: (r.shard_words, r.shard_slots) for r in mixing.mixed_words(mixed, shards=6).collect()}
    assert again == {r.doc_id: (r.shard_words, r.shard_slots) for r in rows}
    # Pieces have slots of their own in each shard, so the first slots of two documents differ.
    slots = collections.Counter((k, s) for r in rows for k, s in enumerate(r.shard_slots) if s is not None)
    assert max(slots.values()) == 1


def test_mix_without_its_tree_is_told(mixed, monkeypatch):
    def idle(by_source, shards=6, seed=0):
        return by_source.withColumn("bounds", F.array(F.lit(0).cast("long"), *[F.col("quota")] * shards))

    monkeypatch.setattr(mixing, "splitting_tree", idle)
    assert shard_faults(mixing.mixed_words(mixed, shards=6).collect(), 6)


def shingles(text):
    w = text.lower().split()
    return {" ".join(w[i : i + 5]) for i in range(len(w) - 4)} or ({" ".join(w)} if w else set())


def plain_pairs(texts):
    """(entity, term) to bits of a list of texts, by counting."""
    spans = [pii.base_spans(t) for t in texts]
    entities = [set(pii.entities_of(t, s)) if s else set() for t, s in zip(texts, spans, strict=True)]
    words = [{t for t, _, _ in pii.words_outside(t, s)} for t, s in zip(texts, spans, strict=True)]
    held = [k for k in range(len(texts)) if entities[k]]
    root = {k: k for k in held}
    sets = {k: shingles(texts[k]) for k in held}

    def find(k):
        return k if root[k] == k else find(root[k])

    for a, b in itertools.combinations(held, 2):
        both = len(sets[a] & sets[b])
        if sets[a] and 100 * both >= 80 * (len(sets[a]) + len(sets[b]) - both):
            root[max(find(a), find(b))] = min(find(a), find(b))
    kept = [k for k in held if find(k) == k]
    rows = len(texts) - len(held) + len(kept)
    counting = [k for k in range(len(texts)) if not entities[k]] + kept
    n_term = collections.Counter(t for k in counting for t in words[k])
    n_entity = collections.Counter(e for k in kept for e in entities[k])
    n_both = collections.Counter((e, t) for k in kept for e in entities[k] for t in words[k])
    out = {}
    for (e, t), n in n_both.items():
        bits = math.log2(n * rows / (n_entity[e] * n_term[t]))
        whole = max(pii.LEAST_GROUP_BITS, math.log2(rows / n_entity[e]) - 1e-9)
        least = min(pii.DISCLOSURE_BITS, whole) if "*" in e else pii.DISCLOSURE_BITS
        if n >= pii.LEAST_SUPPORT and n_entity[e] >= pii.LEAST_SUPPORT and n >= pii.LEAST_SHARE * n_term[t] and bits >= least:
            out[e, t] = round(bits, 6)
    return out


def pii_corpus(seed):
    rnd = random.Random(seed)
    common = [f"word{chr(97 + k % 26)}{chr(97 + k // 26)}" for k in range(120)]
    texts = [" ".join(rnd.choices(common, k=rnd.randrange(20, 60))) for _ in range(900)]
    for k in range(24):  # a name that goes with a domain, in texts unlike each other
        texts.append(f"{' '.join(rnd.choices(common, k=25))} zanzibar u{k % 5}@corp.example {' '.join(rnd.choices(common, k=9))}")
    for k in range(5):  # one value, said with a nickname
        texts.append(f"{' '.join(rnd.choices(common, k=25))} quixote +49 30 1234567 {' '.join(rnd.choices(common, k=9))}")
    near = " ".join(rnd.choices(common, k=60)) + " xylophone reach me at 10.20.30.40 today"
    texts += [near + f" copy{chr(97 + k)}" for k in range(8)] + [near] * 3  # copies alone make no support
    page = " ".join(f"p{k}@directory.example" for k in range(300)) + " " + " ".join(common)
    return [*texts, page, "", None]


def test_disclosure_matches_a_plain_count(spark):
    texts = pii_corpus(5)
    want = plain_pairs([t or "" for t in texts])
    terms = {t for _, t in want}
    assert {"zanzibar", "quixote"} <= terms and "xylophone" not in terms
    docs = spark.createDataFrame([(k, t, "en", "s") for k, t in enumerate(texts)], DOC).coalesce(2)
    scan = pii.cut(pii.scanned(docs))
    got = {(r.entity, r.term): round(r.bits, 6) for r in pii.disclosing(docs, scan).collect()}
    assert got == want
    spans = {r.doc_id: {texts[r.doc_id][x["start"] : x["end"]] for x in r.terms} for r in pii.pii_spans(docs).collect()}
    assert all("zanzibar" in spans[k] for k in range(900, 924)) and not any("xylophone" in x for x in spans.values())


def test_regions_aligned_together():
    rnd = random.Random(6)
    for _ in range(120):
        item = bytes(rnd.choice(b"abc") for _ in range(rnd.randrange(12, 60)))
        most, n = rnd.randrange(1, 5), rnd.randrange(10, 90)
        regions = []
        for _ in range(5):
            body = list(item)
            for _ in range(rnd.randrange(0, 6)):
                at = rnd.randrange(len(body) + 1)
                body[at : at + rnd.randrange(2)] = [rnd.choice(b"abc")] * rnd.randrange(2)
            whole = bytes(rnd.choice(b"abc") for _ in range(rnd.randrange(0, 20))) + bytes(body) + bytes(rnd.choice(b"abc") for _ in range(90))
            regions.append(whole[:n])
        assert decontam.aligned_alike(item, regions, most) == [decontam.banded_alignment(item, r, most) for r in regions]


def test_repetitive_texts_take_linear_memory_and_time():
    began = time.time()
    assert decontam.PassageIndex([(1, "a" * 2_000)]).hits("a" * 1_000_000) == [(1, 0, 0, 2_000)]
    sentence = "the quick brown fox jumps over the lazy dog and runs away. "
    passage, text = sentence * 13, sentence * 16_900
    near = lambda k: "".join(c if (j * 7_919 + k) % 97 else "z" for j, c in enumerate(passage))
    got = decontam.PassageIndex([(k, near(k)) for k in range(20)]).hits(text)
    assert [x[0] for x in got] == list(range(20)) and all(0 < x[1] <= 39 for x in got)
    other = decontam.PassageIndex([(k, passage[:300] + "".join(random.Random(k).choices("abcdefgh ", k=500))) for k in range(100)])
    assert other.hits(text) == []
    assert time.time() - began < 60
    assert re.fullmatch("[a-z. ]+", text[:60])
