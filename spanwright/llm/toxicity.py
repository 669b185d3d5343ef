"""Toxicity with noisy-channel deobfuscation.

A character trigram model is counted over the whole corpus. Tokens whose lattice has more than one
reading (look-alike signs, digits or letters of other scripts among letters or at an edge, a repeated letter, letters spelt out
one by one) become lattices: each sign may stand for itself, for letters it resembles, or for nothing,
and a repeated letter may be dropped. A Viterbi search under the trigram model and the channel's costs
picks the restored word. Restored words are scored by a logistic model over a vocabulary learned from
a bounded sample of labelled documents. In scoring, the readings that spell a word of the vocabulary
count too, as the cheapest one may have lost a letter that is doubled by right; lattices then also run
over neighbouring pieces of up to PIECE signs with any white space between, one of them at least no
likely word. A doubled letter alone is looked at only in words that are not likely ones, and in scoring
only where the word without repeats is one of the vocabulary's: no other reading can change a score.

Defined cases: null and empty texts get the model's bias as score; a label row whose document is
missing is unused; labels repeated for a document count once, toxic holding, and
of rows that repeat a doc_id one is learned from; without labels of both
kinds every score is 0; rows that repeat a doc_id are scored each; empty tables give no rows; other
columns are ignored. Labels, lang, source and doc_id are not inputs of a score.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import arrow_map, bound_batches, cut, fresh

#: Most labelled documents that the classifier is fitted on, and the words it may use.
SAMPLE_DOCS, VOCABULARY = 20_000, 1_000
#: A word enters the vocabulary only if so many sampled documents have it.
LEAST_DOCS = 5
#: Words of at least LEAST_DOCS sampled documents that count as likely; the longest piece of a word, and the least letters of a word in pieces.
LIKELY, PIECE, LEAST_JOINED = 20_000, 4, 4
FOLDS = 5
#: Longer tokens are restored anew each time, so that the table of readings is bounded in bytes.
KEPT_LETTERS = 48

#: Signs and the letters they may stand for.
LOOKALIKES = {"0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "(": "c", "€": "e", "£": "l"}
#: Letters of other scripts and the Latin letters that they look like.
OTHER_SCRIPTS = {"а": "a", "в": "b", "е": "e", "ё": "e", "ѕ": "s", "і": "i", "ј": "j", "к": "k", "м": "m", "н": "h", "о": "o", "р": "p", "с": "c", "т": "t", "у": "y", "х": "x", "һ": "h", "α": "a", "β": "b", "ε": "e", "η": "n", "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "τ": "t", "υ": "u", "χ": "x", "ω": "w"}
SEPARATORS = ".-_*~'`^:/\\"
_EDGE = re.compile(r"^(?:([^\w\s])\1+|[.,;:?\"'()\[\]{}<>&%#*-])+|(?:([^\w\s])\2+|[.,;:?!\"'()\[\]{}<>&%#*-])+$")
_SUSPECT = re.compile(r"[^\W\d_][^\w\s]|[^\w\s][^\W\d_]|[^\W_]*[0-9_][^\W\d_]|[^\W\d_][0-9_]|([^\W\d_])\1\1|[a-zß-ÿ][\u0370-\u052f]|[\u0370-\u052f][a-zß-ÿ]")
_SPELT = re.compile(r"(?<![^\s])(?:[^\s](?:\s+|[.\-_])){2,}[^\s](?![^\s])")
_DOUBLED = re.compile(r"([^\W\d_])\1")
_REPEATS = re.compile(r"(.)\1+")
#: Look-alike signs at the edges of a token, which may be part of the word.
_LEAD, _TRAIL = re.compile(r"[@$!|+(€£]+$"), re.compile(r"^[@$|+(€£]+")
_PIECES = re.compile(r"(?<!\S)\S{1,%d}(?:\s+\S{1,%d})+(?!\S)" % (PIECE, PIECE))

CLASSES = 64
#: Costs (natural logarithms) of the channel: a sign for a letter, a sign dropped, a repeated letter dropped, a word end put in.
COSTS = {"lookalike": 0.7, "separator": 0.3, "repeat": 0.2, "drop": 3.0, "keep": 2.5, "end": 1.5}


def _class_table() -> np.ndarray:
    """Code point to character class: 0 for white space and other signs, letters of Latin each their own, 63 for other letters."""
    out = np.full(0x250, 0, np.int64)
    for k in range(26):
        out[ord("a") + k] = 1 + k
    for k, c in enumerate(c for c in range(0xDF, 0x100) if c != 0xF7):
        out[c] = 27 + k
    out[0x100:] = 63
    return out


_TABLE = _class_table()


def classes(text: str) -> np.ndarray:
    points = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), "<u4")
    return np.where(points < 0x250, _TABLE[np.minimum(points, 0x24F)], 63)


def trigram_counts(docs: DataFrame) -> DataFrame:
    """gram and n: counts of class trigrams over all texts."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(CLASSES**3, np.int64)
        for batch in batches:
            texts = [t for t in batch.column(0).to_pylist() if t]
            c = classes("  " + "  ".join(texts) + "  ")
            total += np.bincount((c[:-2] << 12) | (c[1:-1] << 6) | c[2:], minlength=CLASSES**3)
        held = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(held.astype(np.int32)), pa.array(total[held])], names=["gram", "n"])

    return arrow_map(docs.select(F.col("text").cast("string").alias("text")), count, "gram int, n long").groupBy("gram").agg(F.sum("n").alias("n"))


def language_model(docs: DataFrame) -> np.ndarray:
    """Costs -log p(c | a, b) by class, interpolated with shorter contexts. At most CLASSES ** 3 counts reach the driver."""
    counts = np.zeros(CLASSES**3)
    for row in trigram_counts(docs).collect():
        counts[row["gram"]] = row["n"]
    three = counts.reshape(CLASSES, CLASSES, CLASSES)
    two, one = three.sum(0), three.sum((0, 1))
    p1 = (one + 1) / (one.sum() + CLASSES)
    p2 = (two + 20 * p1) / (two.sum(1, keepdims=True) + 20)
    p3 = (three + 20 * p2[None]) / (three.sum(2, keepdims=True) + 20)
    return -np.log(p3)


class Restorer:
    """Words of texts, with disguised ones restored; what a token decodes to is kept in a bounded table."""

    def __init__(self, costs: np.ndarray, vocabulary: frozenset[str] = frozenset(), likely: frozenset[str] = frozenset()):
        self.costs = costs.tolist()
        self.vocabulary, self.likely = vocabulary, likely
        self.prefixes = {w[:k] for w in vocabulary for k in range(len(w) + 1)}
        self.squeezed = {_REPEATS.sub(r"\1", w) for w in vocabulary}
        self.known: dict[str, tuple[str, ...]] = {}

    def options(self, token: str) -> list[list[tuple[str, float]]]:
        """The lattice: for each sign what it may be ("" for nothing) and at what cost."""
        out = []
        for k, c in enumerate(token):
            if c.isalpha():
                own = [(c, 0.0)]
                if c in OTHER_SCRIPTS:
                    own.append((OTHER_SCRIPTS[c], COSTS["lookalike"]))
                if k and token[k - 1] == c:
                    own.append(("", COSTS["repeat"]))
            else:
                own = [(x, COSTS["lookalike"]) for x in LOOKALIKES.get(c, "")]
                own.append(("", COSTS["separator"] if c in SEPARATORS else COSTS["drop"]))
                if k and token[k - 1] == c:
                    own.append(("", COSTS["repeat"]))
                if not LOOKALIKES.get(c):
                    own.append((" ", COSTS["keep"]))
            out.append(own)
        return out

    def decode(self, token: str, ends: bool = False) -> tuple[str, ...]:
        """The cheapest reading of a token. ends: words may end anywhere inside (letters spelt out one by one)."""
        cost, table = self.costs, _TABLE
        best: dict[tuple[int, int], tuple[float, tuple | None]] = {(0, 0): (0.0, None)}
        for own in self.options(token):
            new: dict[tuple[int, int], tuple[float, tuple | None]] = {}

            def offer(state: tuple[int, int], price: float, path: tuple | None, new=new) -> None:
                if state not in new or price < new[state][0]:
                    new[state] = (price, path)

            for (a, b), (price, path) in best.items():
                for sign, extra in own:
                    if not sign:
                        offer((a, b), price + extra, path)
                        continue
                    point = ord(sign)
                    c = (int(table[point]) if point < 0x250 else 63) if sign != " " else 0
                    offer((b, c), price + extra + cost[a][b][c], (sign, path))
                    if ends and b:
                        offer((0, c), price + extra + COSTS["end"] + cost[a][b][0] + cost[b][0][c], (sign, (" ", path)))
            best = new
        price, path = min(((p + cost[a][b][0], path) for (a, b), (p, path) in best.items()), key=lambda x: x[0])
        out = []
        while path:
            out.append(path[0])
            path = path[1]
        return tuple("".join(reversed(out)).split())

    def onward(self, states: set[str], token: str) -> set[str]:
        """Where the readings of a token lead from the given beginnings of words of the vocabulary."""
        for own in self.options(token):
            states = {p + sign for p in states for sign, _ in own if p + sign in self.prefixes}
            if not states:
                break
        return states

    def spelt(self, token: str) -> set[str]:
        """The words of the vocabulary among all readings of a token."""
        return self.onward({""}, token) & self.vocabulary

    def token(self, raw: str) -> tuple[str, ...]:
        plain = raw.isalpha()  # nothing at its edges to strip or to read
        core = raw if plain else _EDGE.sub("", raw)
        if not plain and not any(c.isalpha() for c in core):
            return ()
        if plain and max(core) < "\u0370" and not _DOUBLED.search(core):
            return (core,)  # of Latin letters alone only repeated ones are suspect
        out = {core}
        if _SUSPECT.search(core):
            out = {*self.decode(core), *self.spelt(core)}
        elif core not in self.likely and _DOUBLED.search(core):
            if not self.vocabulary:
                out.update(self.decode(core))
            elif _REPEATS.sub(r"\1", core) in self.squeezed:
                out |= self.spelt(core)
        if plain:
            return tuple(out)
        at = raw.find(core)
        lead, trail = _LEAD.search(raw[:at]), _TRAIL.search(raw[at + len(core) :])
        if lead or trail:
            whole = (lead.group() if lead else "") + core + (trail.group() if trail else "")
            out |= {*self.decode(whole), *self.spelt(whole)}
        return tuple(out)

    def joined(self, run: str) -> set[str]:
        """The words of the vocabulary that neighbouring pieces of a run spell together."""
        pieces, out = run.split(), set()
        if self.likely.issuperset(pieces):  # a word in pieces has a piece that is no likely word
            return out
        for i, first in enumerate(pieces):
            if first[0].isalpha() and first[0] not in self.prefixes:
                continue
            states, odd = {first} & self.prefixes if first.isalpha() and not _DOUBLED.search(first) else self.onward({""}, first), first not in self.likely
            for piece in pieces[i + 1 :]:
                if not states:
                    break
                states, odd = self.onward(states, piece), odd or piece not in self.likely
                if odd:
                    out |= {w for w in states & self.vocabulary if len(w) >= LEAST_JOINED}
        return out

    def words(self, text: str) -> set[str]:
        """Distinct restored words of a text."""
        low = text.lower() if text.isascii() else unicodedata.normalize("NFKC", text).lower()  # letters of other widths and styles
        known = self.known
        if len(known) > 300_000:
            known.clear()
        tokens = set(low.split())
        read = {raw: self.token(raw) for raw in tokens.difference(known)}
        known.update((raw, x) for raw, x in read.items() if len(raw) <= KEPT_LETTERS)
        out = set().union(*map(known.__getitem__, tokens.difference(read)), *read.values())
        for run in _SPELT.findall(low):
            letters = re.sub(r"[\s.\-_]", "", run)
            found = known.get("\0" + letters)
            if found is None:
                found = self.decode(letters, ends=True)
                if len(letters) <= KEPT_LETTERS:
                    known["\0" + letters] = found
            out.update(found)
        if self.vocabulary:
            for run in _PIECES.findall(low):
                out |= self.joined(run)
        return out


@dataclass
class ToxicityModel:
    costs: np.ndarray
    weights: dict[str, float]
    bias: float
    likely: frozenset[str] = frozenset()

    def scores(self, texts: list[str | None], restorer: Restorer) -> list[float]:
        out = []
        for text in texts:
            z = self.bias
            if text:
                get = self.weights.get
                z += sum(get(w, 0.0) for w in restorer.words(text))
            out.append(1 / (1 + math.exp(-max(-30.0, min(30.0, z)))))
        return out


def held_out() -> Column:
    return F.crc32(F.col("doc_id").cast("string")) % FOLDS == 0


def logistic(rows: list[np.ndarray], y: np.ndarray, size: int, penalty: float = 0.03, steps: int = 400) -> tuple[np.ndarray, float]:
    """Weights and bias of a penalised logistic model over presence features, by accelerated gradient descent."""
    n = len(rows)
    who = np.repeat(np.arange(n), [len(r) for r in rows])
    what = np.concatenate([*rows, np.empty(0, np.int64)]).astype(np.int64)
    widest = max([1, *(len(r) for r in rows)])
    rate = 1.0 / (0.25 * n * min(widest + 1, 30) / 4 + penalty)
    w, b, vw, vb = np.zeros(size), math.log((y.sum() + 0.5) / (n - y.sum() + 0.5)), np.zeros(size), 0.0
    count = np.bincount(what, minlength=size)
    rate_w = 1.0 / (0.25 * np.maximum(count, 1) * min(widest, 10) + penalty)
    for _ in range(steps):
        z = b + np.bincount(who, weights=w[what], minlength=n)
        g = 1 / (1 + np.exp(-np.clip(z, -30, 30))) - y
        vw = 0.8 * vw - rate_w * (np.bincount(what, weights=g[who], minlength=size) + penalty * w)
        vb = 0.8 * vb - rate * g.sum()
        w, b = w + vw, b + vb
    return w, float(b)


def sample_words(docs: DataFrame, labels: DataFrame, costs: np.ndarray) -> DataFrame:
    """doc_id, toxic and the distinct restored words of the sampled labelled documents outside the held-out fold."""
    train = labels.where(~held_out()).groupBy("doc_id").agg(F.max("toxic").alias("_toxic")).where("_toxic IS NOT NULL")
    sample = F.broadcast(cut(train.orderBy(F.xxhash64("doc_id"), "doc_id").limit(SAMPLE_DOCS)))  # bounded by SAMPLE_DOCS

    def restore(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        restorer = Restorer(costs)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                words = [sorted(restorer.words(t or "")) for t in part.column(2).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(words, pa.list_(pa.string()))], names=["doc_id", "toxic", "words"])

    picked = docs.select("doc_id", F.col("text").cast("string").alias("text")).join(sample, "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"), F.max("_toxic").cast("int").alias("toxic")).select("doc_id", "toxic", "text")
    return arrow_map(picked, restore, "doc_id long, toxic int, words array<string>")


def fit(docs: DataFrame, labels: DataFrame) -> ToxicityModel:
    costs = language_model(docs)
    words = cut(sample_words(docs, labels, costs))
    totals = words.groupBy("toxic").count().collect()
    n = {r["toxic"]: r["count"] for r in totals}
    if not n.get(0) or not n.get(1):
        return ToxicityModel(costs, {}, -30.0)
    counts = words.select("toxic", F.explode("words").alias("word")).groupBy("word").agg(F.count_if(F.col("toxic") == 1).alias("a"), F.count_if(F.col("toxic") == 0).alias("b")).where(F.col("a") + F.col("b") >= LEAST_DOCS)
    a, b = F.col("a") + 0.5, F.col("b") + 0.5
    rate = (n[1] + 1.0) / (n[0] + n[1] + 2.0)
    gain = a * F.log(a / ((a + b) * rate)) + b * F.log(b / ((a + b) * (1 - rate)))  # log-likelihood ratio
    picked = [r["word"] for r in counts.withColumn("gain", gain).where(F.col("gain") > 3).orderBy(F.desc("gain"), "word").limit(VOCABULARY).collect()]
    number = {w: k for k, w in enumerate(picked)}
    rows, y = [], []
    if picked:
        hits = words.select("toxic", F.array_intersect("words", F.lit(picked)).alias("words")).where(F.size("words") > 0)
        for r in hits.collect():  # at most SAMPLE_DOCS rows
            rows.append(np.array(sorted(number[w] for w in r["words"]), np.int64))
            y.append(r["toxic"])
    blank = {k: v - sum(t == k for t in y) for k, v in n.items()}
    for k, more in blank.items():
        rows += [np.empty(0, np.int64)] * more
        y += [k] * more
    w, bias = logistic(rows, np.array(y, float), len(picked))
    likely = counts.orderBy(F.desc(F.col("a") + F.col("b")), "word").limit(LIKELY).collect()
    return ToxicityModel(costs, {x: float(w[k]) for x, k in number.items()}, bias, frozenset(r["word"] for r in likely))


def scorer(model: ToxicityModel, spark):
    """A column function: the score of a text column."""
    bound_batches(spark)
    held = spark.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        restorer = Restorer(held.value.costs, frozenset(held.value.weights), held.value.likely)
        for texts in batches:
            yield pd.Series(held.value.scores(list(texts), restorer), dtype="float64")

    return score


def toxicity_scores(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted."""
    score = scorer(fit(docs, labels), docs.sparkSession)
    return docs.select("doc_id", F.coalesce(held_out(), F.lit(False)).alias("held_out"), score(F.col("text").cast("string")).alias("score")).withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def not_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of docs that the model does not reject."""
    score, name = scorer(fit(docs, labels), docs.sparkSession), fresh(docs, "_toxicity")
    return docs.withColumn(name, score(F.col("text").cast("string"))).where(F.col(name) < 0.5).drop(name)
