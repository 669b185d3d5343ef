"""PII: base patterns, then information-theoretic sanitisation of the words of whole documents.

Base spans (email, ip, card, phone) come from fixed patterns. Words of a document with a protected
entity may reveal it as well. An entity is a distinct email, address, card or phone number, or a
group of them: an email's domain, an address's first three numbers, or all of a kind, so that words
count which go with values that are rare each. Over the corpus, a term t discloses an entity e by
the pointwise mutual information log2(n(e, t) * N / (n(e) * n(t))), all counted in documents and
over whole texts. Of documents with entities, one of each class of near copies counts (five words, 0.8). t is a span too (kind ``term``), wherever it stands and whether or not e is there,
if at least LEAST_SUPPORT documents hold the pair, e is in at least LEAST_SHARE of t's documents, and
the information reaches DISCLOSURE_BITS; for a group held by too many documents to carry so many
bits, all that it carries (LEAST_GROUP_BITS at least). sanitised() generalises base spans to their
kind and removes disclosing terms.

n(t) is needed only for terms with support, and places only of disclosing terms; a bitmap of fixed
size, holding a hash bit of each such term, keeps other words out. A full bitmap costs time, not
results. Pairs are made of terms that are mostly said beside entities, so a page with many entities and
many words makes few.

Defined cases: null and empty texts have no spans; words that overlap a base span are no terms; rows
that repeat a doc_id are handled row by row, and n() counts rows; empty tables give no rows; other
columns are ignored. Places are code points, ends exclusive.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import arrow_map, bound_batches, cut, small_side
from .minhash import near_duplicates

KINDS = ("email", "ip", "card", "phone")
#: The least length of a term.
LEAST_LETTERS = 3
DISCLOSURE_BITS, LEAST_SUPPORT, LEAST_SHARE = 6.0, 3, 0.5
#: A group in more than one document of 2 ** LEAST_GROUP_BITS has no disclosing terms.
LEAST_GROUP_BITS = 3.0
_BITMAP_BITS = 1 << 23
#: Longer words are looked at anew each time, so that the table of words is bounded in bytes.
KEPT_LETTERS = 48

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# A match of digits and dots can only begin where a run of digits begins, so later starts are not tried.
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")
_NOT_DIGITS = re.compile(r"[^0-9]")
_WORD = re.compile(r"[^\s]+")
_TRIM = ".,;:!?\"'()[]{}<>"


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if k % 2:
            d = d * 2 - 9 * (d > 4)
        total += d
    return total % 10 == 0


def _emails(text: str) -> Iterator[tuple[int, int]]:
    done = 0
    at = text.find("@")
    while at >= 0:
        begin = at
        while begin > done and text[begin - 1] in _LOCAL:
            begin -= 1
        found = _DOMAIN.match(text, at) if begin < at else None
        if found:
            done = found.end()
            yield begin, done
            at = text.find("@", done)
        else:
            done = at + 1
            at = text.find("@", at + 1)


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the base patterns, sorted; leftmost and non-overlapping per kind."""
    out = [(a, 0, b) for a, b in _emails(text)] if "@" in text else []
    if not _DIGIT.search(text):
        return out
    if "." in text:
        out += [(m.start(), 1, m.end()) for m in _IP.finditer(text) if all(len(x.lstrip("0")) <= 3 and int(x[-4:]) <= 255 for x in m.group().split("."))]
    for m in _CARD.finditer(text):
        digits = _NOT_DIGITS.sub("", m.group())
        if 12 <= len(digits) <= 19 and luhn(digits):
            out.append((m.start(), 2, m.end()))
    if "+" in text:
        out += [(m.start(), 3, m.end()) for m in _PHONE.finditer(text) if 9 <= len(_NOT_DIGITS.sub("", m.group())) <= 15]
    return sorted(out)


def as_term(word: str) -> str:
    return word.strip(_TRIM).lower()


def entities_of(text: str, spans: list[tuple[int, int, int]]) -> list[str]:
    """The distinct entities of a text's spans and the groups they are in; a group has a * in its name."""
    out = set()
    for start, kind, end in spans:
        name, value = KINDS[kind], text[start:end].lower()
        value = value if kind < 2 else _NOT_DIGITS.sub("", value)
        out |= {f"{name}:{value}", f"{name}:*"}
        if name == "email":
            out.add(f"{name}:*@{value.rpartition('@')[2]}")
        elif name == "ip":
            out.add(f"{name}:{value.rpartition('.')[0]}.*")
    return sorted(out)


def words_outside(text: str, spans: list[tuple[int, int, int]]) -> Iterator[tuple[str, int, int]]:
    """(term, start, end) of the words that are long enough and overlap no span. spans: sorted."""
    covered: list[list[int]] = []
    for s, _, e in spans:
        if covered and s <= covered[-1][1]:
            covered[-1][1] = max(covered[-1][1], e)
        else:
            covered.append([s, e])
    at = 0
    for m in _WORD.finditer(text):
        word = m.group()
        term = as_term(word)
        if len(term) < LEAST_LETTERS:
            continue
        a = m.start() + len(word) - len(word.lstrip(_TRIM))
        b = m.end() - (len(word) - len(word.rstrip(_TRIM)))
        while at < len(covered) and covered[at][1] <= a:
            at += 1
        if at == len(covered) or covered[at][0] >= b:
            yield term, a, b


SCAN_SCHEMA = "row long, doc_id long, base array<struct<start:int,kind:int,end:int>>, entities array<string>, words array<string>, text string"
_BASE = pa.list_(pa.struct([("start", pa.int32()), ("kind", pa.int32()), ("end", pa.int32())]))
_NAMES = pa.list_(pa.string())


def numbered(docs: DataFrame) -> DataFrame:
    """row (a number of the row), doc_id and text."""
    return docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


def scanned(docs: DataFrame) -> DataFrame:
    """row, doc_id, base (spans), entities and, where there are any, the distinct terms of the text and the text."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                base, entities, words, texts = [], [], [], []
                for text in part.column(2).to_pylist():
                    spans = base_spans(text) if text else []
                    base.append([{"start": s, "kind": k, "end": e} for s, k, e in spans])
                    entities.append(entities_of(text, spans) if spans else [])
                    words.append(sorted({t for t, _, _ in words_outside(text, spans)}) if spans else [])
                    texts.append(text if spans else None)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(base, _BASE), pa.array(entities, _NAMES), pa.array(words, _NAMES), pa.array(texts, pa.string())], names=["row", "doc_id", "base", "entities", "words", "text"])

    return arrow_map(numbered(docs), scan, SCAN_SCHEMA)


def bitmap_of(terms: DataFrame) -> np.ndarray:
    """A packed bitmap with the hash bits of the terms."""
    bits = np.zeros(_BITMAP_BITS, np.uint8)
    # At most _BITMAP_BITS numbers, whatever the corpus.
    for r in terms.select(F.pmod(F.crc32("term"), F.lit(_BITMAP_BITS)).cast("int").alias("bit")).distinct().toLocalIterator():
        bits[r["bit"]] = 1
    return np.packbits(bits)


class Wanted:
    """Which words are terms with a bit in a packed bitmap; kept in a bounded table."""

    def __init__(self, packed: bytes):
        self.bits = np.unpackbits(np.frombuffer(packed, np.uint8)).astype(bool)
        self.known: dict[str, str] = {}  # a word's term, or "" if its bit isn't wanted

    def terms(self, text: str) -> set[str]:
        known, found = self.known, set()
        if len(known) > 400_000:
            known.clear()
        for word in set(text.split()):
            term = known.get(word)
            if term is None:
                term = as_term(word)
                if len(term) < LEAST_LETTERS or not self.bits[zlib.crc32(term.encode("utf-8", "surrogatepass")) % _BITMAP_BITS]:
                    term = ""
                if len(word) <= KEPT_LETTERS:
                    known[word] = term
            if term:
                found.add(term)
        return found


def term_counts(docs: DataFrame, wanted: np.ndarray) -> DataFrame:
    """term and n_term: documents holding each term whose hash bit is wanted. wanted: a packed bitmap."""
    held = docs.sparkSession.sparkContext.broadcast(wanted.tobytes())

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Wanted(held.value)
        total: Counter[str] = Counter()

        def told() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(list(total), pa.string()), pa.array(list(total.values()), pa.int64())], names=["term", "n"])

        for batch in batches:
            for text in batch.column(0).to_pylist():
                if not text:
                    continue
                found = known.terms(text)
                spans = base_spans(text) if found else []
                total.update(found & {t for t, _, _ in words_outside(text, spans)} if spans else found)
            if len(total) > 200_000:
                yield told()
                total.clear()
        yield told()

    return arrow_map(docs.select(F.col("text").cast("string").alias("text")), count, "term string, n long").groupBy("term").agg(F.sum("n").alias("n_term"))


def term_places(docs: DataFrame, wanted: np.ndarray) -> DataFrame:
    """row, term, start and end of all terms whose hash bit is wanted, in all documents. wanted: a packed bitmap."""
    held = docs.sparkSession.sparkContext.broadcast(wanted.tobytes())

    def places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Wanted(held.value)
        for batch in batches:
            rows, terms, starts, ends = [], [], [], []
            for row, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                found = known.terms(text) if text else None
                if found:
                    for term, a, b in words_outside(text, base_spans(text)):
                        if term in found:
                            rows.append(row)
                            terms.append(term)
                            starts.append(a)
                            ends.append(b)
            yield pa.RecordBatch.from_arrays([pa.array(rows, pa.int64()), pa.array(terms, pa.string()), pa.array(starts, pa.int32()), pa.array(ends, pa.int32())], names=["row", "term", "start", "end"])

    return arrow_map(numbered(docs).select("row", "text"), places, "row long, term string, start int, end int")


def unlike(held: DataFrame) -> DataFrame:
    """The rows of held (row, text) that stand for their class: of near copies, one counts."""
    classes = near_duplicates(held.select(F.col("row").alias("doc_id"), "text"), words=5, percent=80)
    return classes.where("kept").select(F.col("doc_id").alias("row"))


def disclosing(docs: DataFrame, scan: DataFrame) -> DataFrame:
    """entity, term and bits of the pairs over the thresholds.

    Of documents with entities one of each class of near copies counts, so a pair's support is of texts unlike each other. Terms
    are settled first: one that is not in enough such documents, or mostly in documents without any entity, makes no pairs.
    """
    held, kind = scan.where(F.size("entities") > 0), F.col("entity").endswith(":*")
    kept_rows = cut(unlike(held))
    kept, copies = cut(held.join(kept_rows, "row", "left_semi").select("row", "entities", "words")), held.join(kept_rows, "row", "left_anti")
    terms = cut(kept.select(F.explode("words").alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("n_held")).where(F.col("n_held") >= LEAST_SUPPORT))
    wanted = bitmap_of(terms)
    if not wanted.any():
        return terms.select(F.lit("").alias("entity"), "term", F.lit(0.0).alias("bits")).limit(0)
    again = copies.select(F.explode("words").alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("_copies"))
    counted = terms.join(term_counts(docs, wanted), "term").join(again, "term", "left").withColumn("n_term", F.col("n_term") - F.coalesce("_copies", F.lit(0)))
    terms = cut(counted.where(F.col("n_held") >= LEAST_SHARE * F.col("n_term")).select("term", "n_term"))

    named = kept.select("row", F.explode("entities").alias("entity"))
    # An entity in fewer documents than a pair needs has no pair with support. Whole kinds have most of the rows; they
    # are few, so no shuffle gathers a kind's rows.
    entities = cut(named.groupBy("entity").agg(F.count(F.lit(1)).alias("n_entity")).where(F.col("n_entity") >= LEAST_SUPPORT))
    kinds, others = F.broadcast(entities.where(kind)), small_side(entities.where(~kind))
    able = named.where(kind).unionByName(named.where(~kind).join(others, "entity", "left_semi")).groupBy("row").agg(F.collect_list("entity").alias("able"))
    said = kept.select("row", F.explode("words").alias("term")).join(small_side(terms.select("term"), 100_000), "term", "left_semi").groupBy("row").agg(F.collect_list("term").alias("terms"))
    both = said.join(able, "row").select(F.explode("able").alias("entity"), "terms").select("entity", F.explode("terms").alias("term"))
    pairs = cut(both.groupBy("entity", "term").agg(F.count(F.lit(1)).alias("n_both")).where(F.col("n_both") >= LEAST_SUPPORT))
    rows = float(scan.count() - copies.count())
    scored = pairs.where(kind).join(kinds, "entity").unionByName(pairs.where(~kind).join(others, "entity"))
    scored = scored.join(terms, "term").withColumn("bits", F.log2(F.col("n_both") * F.lit(rows) / (F.col("n_entity") * F.col("n_term"))))
    whole = F.greatest(F.lit(LEAST_GROUP_BITS), F.log2(F.lit(rows) / F.col("n_entity")) - 1e-9)
    least = F.when(F.col("entity").contains("*"), F.least(F.lit(DISCLOSURE_BITS), whole)).otherwise(F.lit(DISCLOSURE_BITS))
    return scored.where((F.col("bits") >= least) & (F.col("n_both") >= LEAST_SHARE * F.col("n_term"))).select("entity", "term", "bits")


def pii_spans(docs: DataFrame) -> DataFrame:
    """row, doc_id, base and terms (spans: start, kind, end; kind 4 is a term), one row a document."""
    scan = cut(scanned(docs))
    terms = cut(disclosing(docs, scan).select("term").distinct())
    none = F.array().cast("array<struct<start:int,kind:int,end:int>>")
    wanted = bitmap_of(terms)
    if not wanted.any():
        return scan.select("row", "doc_id", "base", none.alias("terms"))
    found = term_places(docs, wanted).join(small_side(terms, 100_000), "term", "left_semi").groupBy(F.col("row").alias("_row")).agg(F.collect_set(F.struct("start", F.lit(len(KINDS)).alias("kind"), "end")).alias("terms"))
    return scan.join(found, F.col("row") == F.col("_row"), "left").select("row", "doc_id", "base", F.coalesce("terms", none).alias("terms"))


def joined(spans: Column) -> Column:
    """kind:start:end by start, then kind as listed, joined by commas."""
    names = F.array(*[F.lit(k) for k in (*KINDS, "term")])
    return F.array_join(F.transform(F.sort_array(spans), lambda x: F.concat_ws(":", F.get(names, x["kind"]), x["start"], x["end"])), ",")


def sanitised(docs: DataFrame) -> DataFrame:
    """doc_id and text, with base spans generalised to [KIND] and disclosing terms removed; one row for each row of docs."""
    bound_batches(docs.sparkSession)
    spans = pii_spans(docs).select("row", F.concat("base", "terms").alias("spans"))

    @F.pandas_udf("string")
    def rewritten(texts: pd.Series, spans: pd.Series) -> pd.Series:
        out = []
        for text, own in zip(texts, spans, strict=True):
            parts, done = [], 0
            for s, k, e in sorted((x["start"], x["kind"], x["end"]) for x in own):
                if s >= done:
                    parts += [text[done:s], f"[{KINDS[k].upper()}]" if k < len(KINDS) else ""]
                    done = e
            out.append("".join(parts) + text[done:] if text is not None else None)
        return pd.Series(out)

    rows = docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", "text")
    return rows.join(spans, "row").select("doc_id", rewritten("text", "spans").alias("text"))
