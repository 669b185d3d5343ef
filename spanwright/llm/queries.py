"""Registered queries of the operators, with production parameters, and their oracle SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat, decontam, divergence, minhash, mixing, pii, quality, runs, sharding, suffix, tokens, toxicity, warc
from .common import table

#: op1: the vocabulary and the end id.
TOKENIZER, END_ID = "word_bpe_49k.json", 2


def op1_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    folder = tokens.encoded(table(spark, sf_dir, "documents"), public_tokenizers.path(TOKENIZER), END_ID)
    return tokens.read_documents(spark, folder)


def op2_chat_reconstruction(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = r"\### Assistant: </turn> ok"
    probe = spark.sql("SELECT * FROM VALUES (-7L, 0L, 'user', :said), (-7L, 1L, 'assistant', :said) AS t(conv_id, turn, role, text)", {"said": said})
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(probe)
    messages = chat.fold_events(chat.transcript_log(rows), message=("turn", "copy"))
    back = chat.read_back(chat.render(messages, order=("turn", "copy")))
    told = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return back.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(told, 256).alias("turns_sha256"),
        F.length("loss_text").cast("long").alias("loss_chars"),
        F.sha2("loss_text", 256).alias("loss_sha256"),
        "formatted_chars",
    )


OP2_SQL = r"""
WITH rows AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
  UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'),
sized AS (
  SELECT *, length(text) + length(regexp_replace(text, '[^\\<#]', '', 'g')) AS body,
         length(role) + length(regexp_replace(role, '[^\\<#:]', '', 'g')) AS head FROM rows)
SELECT conv_id, count(*)::BIGINT AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
       sum(body + head + 4 + 2 + 9)::BIGINT AS formatted_chars
FROM sized GROUP BY conv_id
"""


OP5_SQL = r"""
WITH texts AS (
  SELECT doc_id, lang, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
words AS (SELECT doc_id, unnest(w) AS w, generate_subscripts(w, 1) AS i FROM texts),
threes AS (
  SELECT doc_id, i, w || ' ' || lead(w, 1) OVER o || ' ' || lead(w, 2) OVER o AS g FROM words WINDOW o AS (PARTITION BY doc_id ORDER BY i)),
windows AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS c FROM threes WHERE g IS NOT NULL),
repeated AS (
  SELECT doc_id, sum(least(3, coalesce(nxt - i, 3)))::BIGINT AS n
  FROM (SELECT doc_id, i, lead(i) OVER (PARTITION BY doc_id ORDER BY i) AS nxt FROM windows WHERE c > 1) GROUP BY doc_id),
lines AS (
  SELECT doc_id, (count(*) - count(DISTINCT l))::BIGINT AS n
  FROM (SELECT doc_id, unnest(string_split(t, chr(10))) AS l FROM texts) WHERE regexp_matches(l, '[^\x20\x09-\x0D]') GROUP BY doc_id),
counts AS (
  SELECT doc_id, lang, len(w)::BIGINT AS n_words, length(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g'))::BIGINT AS word_chars,
         length(regexp_replace(t, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols, length(regexp_replace(t, '[^!]', '', 'g'))::BIGINT AS n_shouts,
         coalesce(lines.n, 0) AS n_dup_lines, coalesce(repeated.n, 0) AS n_repeat_words
  FROM texts LEFT JOIN lines USING (doc_id) LEFT JOIN repeated USING (doc_id)),
judged AS MATERIALIZED (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM counts),
rates AS (
  SELECT doc_id, lang, base_failed, unnest([0, 1, 2, 3]) AS rule,
         unnest([1000 * n_symbols // greatest(word_chars, 1), 1000 * n_shouts // greatest(word_chars, 1),
                 1000 * n_dup_lines // greatest(n_words, 1), 1000 * n_repeat_words // greatest(n_words, 1)]) AS rate
  FROM judged),
told AS (SELECT doc_id, min(quality) AS quality FROM labels GROUP BY doc_id HAVING min(quality) IS NOT NULL),
held AS (
  SELECT doc_id, lang, rule, rate, quality = 1 AS good, substr(md5(doc_id::VARCHAR), 1, 1) < '8' AS proposing
  FROM rates JOIN told USING (doc_id) WHERE NOT base_failed),
both_ AS MATERIALIZED (SELECT *, lang AS s, FALSE AS pool FROM held UNION ALL SELECT *, NULL AS s, TRUE AS pool FROM held),
sums AS (
  SELECT pool, s, rule, cutoff, count(*) FILTER (good AND rate > cutoff) AS good, count(*) FILTER (NOT good AND rate > cutoff) AS bad,
         count(*) FILTER (good) AS n_good, count(*) FILTER (NOT good) AS n_bad
  FROM (SELECT *, unnest([5, 10, 20, 50, 100, 200, 300, 500]) AS cutoff FROM both_ WHERE proposing) GROUP BY pool, s, rule, cutoff),
cells AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY pool, s ORDER BY good, bad DESC, rule, cutoff DESC) AS i FROM sums WHERE bad * n_good > good * n_bad),
steps AS (
  SELECT b.pool, b.s, b.doc_id, min(c.i) AS step
  FROM both_ b JOIN cells c ON b.pool = c.pool AND b.s IS NOT DISTINCT FROM c.s AND b.rule = c.rule AND b.rate > c.cutoff
  WHERE b.good AND NOT b.proposing GROUP BY b.pool, b.s, b.doc_id),
sizes AS (SELECT pool, s, count(*) // 4 AS n FROM both_ WHERE good AND NOT proposing GROUP BY pool, s),
tried AS (
  SELECT c.pool, c.s, c.rule, c.cutoff, c.i, z.n,
         (SELECT count(*) FROM steps t WHERE t.pool = c.pool AND t.s IS NOT DISTINCT FROM c.s AND t.step <= c.i) AS k
  FROM cells c JOIN sizes z ON c.pool = z.pool AND c.s IS NOT DISTINCT FROM z.s),
tests AS (
  SELECT *, CASE WHEN k > n * 0.05 THEN 1.0 ELSE
    list_sum(list_transform(range(0, k + 1), lambda j: exp(lgamma(n + 1) - lgamma(j + 1) - lgamma(n - j + 1) + j * ln(0.05) + (n - j) * ln(1 - 0.05)))) END AS tail
  FROM tried),
cuts AS (
  SELECT pool, s, rule, cutoff FROM (
    SELECT *, bool_and(tail <= 0.05 / (SELECT count(*) + 1 FROM (SELECT DISTINCT lang FROM held))) OVER (PARTITION BY pool, s ORDER BY i) AS held_up FROM tests) WHERE held_up),
rejected AS (
  SELECT DISTINCT r.doc_id FROM rates r JOIN cuts c ON r.rule = c.rule AND r.rate > c.cutoff
  WHERE (NOT c.pool AND r.lang IS NOT DISTINCT FROM c.s)
     OR (c.pool AND NOT EXISTS (SELECT 1 FROM cuts o WHERE NOT o.pool AND o.s IS NOT DISTINCT FROM r.lang)))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND doc_id NOT IN (SELECT doc_id FROM rejected) AS kept
FROM judged
"""


OP4_SQL = r"""
WITH texts AS MATERIALIZED (
  SELECT doc_id, row_number() OVER () AS r, encode(coalesce(text, '')) AS b FROM documents),
sized AS MATERIALIZED (SELECT *, octet_length(b) AS n FROM texts),
starts AS MATERIALIZED (SELECT r, i, md5_number(hex(array_slice(b, i, i + 199))) AS h FROM (SELECT r, b, unnest(range(1, n - 198)) AS i FROM sized WHERE n >= 200)),
hit AS (SELECT r, i, lag(i) OVER (PARTITION BY r ORDER BY i) AS before FROM starts JOIN (SELECT h FROM starts GROUP BY h HAVING count(*) > 1) USING (h)),
runs AS (SELECT r, i, sum(CASE WHEN i <= before + 200 THEN 0 ELSE 1 END) OVER (PARTITION BY r ORDER BY i) AS k FROM hit),
spans AS (SELECT r, k, min(i) AS a, max(i) + 200 AS z FROM runs GROUP BY r, k),
kept AS (
  SELECT r, sum(z - a) AS gone, count(*) AS spans,
         string_agg(hex(array_slice(b, coalesce(last, 1), a - 1)), '' ORDER BY a) || hex(array_slice(any_value(b), max(z), any_value(n))) AS h
  FROM (SELECT *, lag(z) OVER (PARTITION BY r ORDER BY a) AS last FROM spans JOIN sized USING (r)) GROUP BY r)
SELECT doc_id, n::BIGINT AS n_bytes, coalesce(gone, 0)::BIGINT AS n_removed, coalesce(spans, 0)::BIGINT AS n_spans, sha256(coalesce(unhex(h), b)) AS kept_sha256
FROM sized LEFT JOIN kept USING (r)
"""


OP8_SQL = r"""
WITH RECURSIVE texts AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
sets AS MATERIALIZED (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')]
    ELSE list_distinct(list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i : i + 3], ' '))) END AS s
  FROM texts),
shingles AS MATERIALIZED (SELECT doc_id, len(s) AS n, md5_number(unnest(s)) AS h FROM sets),
links AS MATERIALIZED (
  SELECT a.doc_id AS x, b.doc_id AS y FROM shingles a JOIN shingles b ON a.h = b.h AND a.doc_id <> b.doc_id
  GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 80 * (a.n + b.n - count(*))),
reached AS (SELECT x AS doc_id, x AS other FROM links UNION SELECT r.doc_id, l.y FROM reached r JOIN links l ON r.other = l.x),
least AS (SELECT doc_id, min(other) AS other FROM reached GROUP BY doc_id)
SELECT doc_id, len(s)::BIGINT AS n_shingles, coalesce(other, doc_id) AS component_id, coalesce(other, doc_id) = doc_id AS kept
FROM sets LEFT JOIN least USING (doc_id)
"""


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op4_repeated_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix.repeats_removed(table(spark, sf_dir, "documents"))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality.quality_verdicts(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op7_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    spans = pii.pii_spans(table(spark, sf_dir, "documents"))
    # filter() hands a second argument, even one with a default, the place in the array.
    of_kind = lambda k: lambda x: x["kind"] == k
    counts = [F.size(F.filter("base", of_kind(k))).cast("long").alias(f"n_{name}") for k, name in enumerate(pii.KINDS)]
    return spans.select("doc_id", *counts, F.sha2(pii.joined(F.col("base")), 256).alias("base_sha256"), pii.joined(F.concat("base", "terms")).alias("spans"))


def op8_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents"))


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mixed_words(table(spark, sf_dir, "documents")).drop("row")


def op10_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = sharding.sharded(table(spark, sf_dir, "documents"))
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


OP11_SQL = r"""
WITH bodies AS (SELECT page_id, coalesce(html, '') AS body FROM pages),
hashed AS (SELECT page_id, octet_length(encode(body))::BIGINT AS n, sha1(body) AS hex FROM bodies),
firsts AS (SELECT hex, n, min(page_id) AS first FROM hashed GROUP BY hex, n)
SELECT page_id, n AS payload_bytes,
       list_aggregate(list_transform(range(0, 32), lambda i:
         substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + ((('0x' || substr(hex, 1 + 5 * (i // 4), 5))::BIGINT >> (15 - 5 * (i % 4))) & 31)::INTEGER, 1)), 'string_agg', '') AS payload_digest,
       CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id = first THEN NULL ELSE first END AS refers_to
FROM hashed JOIN firsts USING (hex, n)
"""


OP12_SQL = r"""
WITH docs AS (
  SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
         translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
words AS (SELECT r, lang, source, unnest(regexp_extract_all(t, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM docs),
kept AS MATERIALIZED (SELECT lang, term, count(*) AS lang_n FROM words GROUP BY lang, term HAVING count(DISTINCT r) >= 30),
langs AS (SELECT lang, count(*) AS v, sum(lang_n) AS lang_total FROM kept GROUP BY lang),
counts AS MATERIALIZED (SELECT lang, source, term, count(*) AS n FROM words JOIN kept USING (lang, term) GROUP BY lang, source, term),
totals AS (SELECT lang, source, sum(n) AS total FROM counts GROUP BY lang, source),
grp AS MATERIALIZED (
  SELECT lang, source, coalesce(total, 0) AS total, coalesce(v, 0) AS v, lang_total
  FROM (SELECT DISTINCT lang, source FROM docs) LEFT JOIN totals USING (lang, source) LEFT JOIN langs USING (lang)),
shares AS MATERIALIZED (
  SELECT g.lang, g.source, k.term, coalesce(n, 0) AS n, 1 + (1000000000::HUGEINT * (coalesce(n, 0) + 5)) // (g.total + 5 * g.v) AS p,
         1 + (1000000000::HUGEINT * (k.lang_n + 5)) // (g.lang_total + 5 * g.v) AS q
  FROM grp g JOIN kept k ON g.lang = k.lang LEFT JOIN counts c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
sums AS (SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p)) AS value FROM shares a JOIN shares b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY a.lang, a.source, b.source),
pairs AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(s.value, 0)::BIGINT AS value
  FROM grp a JOIN grp b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN sums s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source),
terms AS (SELECT lang, source, 'term' AS part, term AS item, (p - q)::BIGINT AS value FROM shares WHERE n > 0 AND p > q),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, encode(item))::INTEGER AS rank FROM (SELECT * FROM pairs UNION ALL SELECT * FROM terms))
SELECT * FROM ranked WHERE part = 'pair' OR rank <= 50
"""


OP13_SQL = r"""
WITH RECURSIVE crc AS MATERIALIZED (
  SELECT list(c ORDER BY b) AS t FROM (
    SELECT b, list_reduce(list_concat([b], range(0, 8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS c FROM (SELECT unnest(range(0, 256)) AS b))),
docs AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w,
         xor(list_reduce(list_concat([4294967295], list_transform(string_split(doc_id::VARCHAR, ''), lambda s: ascii(s)::BIGINT)), lambda c, x: xor(c >> 8, t[1 + (xor(c, x) & 255)])), 4294967295) AS h
  FROM documents CROSS JOIN crc),
shaped AS (SELECT r, doc_id, w, len(w) AS n, h, CASE WHEN len(w) > 0 THEN (h // 10) % len(w) END AS a FROM docs),
texts AS MATERIALIZED (
  SELECT r, doc_id, n, CASE WHEN h % 10 = 0 AND n > 0 THEN
    list_transform(range(0, n), lambda i: w[1 + CASE WHEN i >= a THEN a + (i - a) % (1 + (n - a) // (3 + (h // 10) % 8)) ELSE i END]) ELSE w END AS w FROM shaped),
words AS MATERIALIZED (SELECT r, n, unnest(w) AS word, unnest(range(0, n)) AS i FROM texts WHERE n > 0),
fives AS (
  SELECT r, n, i, word || ' ' || lead(word, 1) OVER o || ' ' || lead(word, 2) OVER o || ' ' || lead(word, 3) OVER o || ' ' || lead(word, 4) OVER o AS g
  FROM words WHERE n >= 6 WINDOW o AS (PARTITION BY r ORDER BY i)),
pairs AS (SELECT x.r, x.i, y.i - x.i AS q FROM fives x JOIN fives y ON x.r = y.r AND x.g = y.g AND y.i > x.i AND y.i - x.i <= x.n // 4),
stretches AS (SELECT r, q, min(i) AS start, max(i) + 5 - min(i) + q AS length FROM (SELECT r, q, i, i - row_number() OVER (PARTITION BY r, q ORDER BY i) AS k FROM pairs) GROUP BY r, q, k),
runs AS MATERIALIZED (SELECT r, start, length, min(q) AS period FROM stretches WHERE length >= greatest(6, 4 * q) GROUP BY r, start, length),
sums AS (
  SELECT r, count(*) AS n_runs, string_agg(start || ',' || length || ',' || period || chr(10), '' ORDER BY start, period) AS told,
         min(struct_pack(l := -length, s := start, p := period)) AS m FROM runs GROUP BY r),
gone AS (SELECT DISTINCT r, unnest(range(start + period, start + length)) AS i FROM runs),
kept AS (SELECT words.r, string_agg(word, ' ' ORDER BY words.i) AS text FROM words LEFT JOIN gone ON words.r = gone.r AND words.i = gone.i WHERE gone.i IS NULL GROUP BY words.r)
SELECT doc_id, coalesce(n_runs, 0)::BIGINT AS n_runs, m.s AS start, -m.l AS length, m.p AS period, 1000 * -m.l // m.p AS exponent_milli,
       sha256(coalesce(told, '')) AS runs_sha256, sha256(coalesce(kept.text, '')) AS collapsed_sha256
FROM texts LEFT JOIN sums USING (r) LEFT JOIN kept USING (r)
"""


def op11_warc_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    folder = warc.archived(pages)
    captures = warc.lookup(pages.select(warc.url_key(F.col("url").cast("string")).alias("key")), folder)
    told = warc.resolved(warc.read_records(captures, folder, payload=False))
    return told.select("page_id", "payload_bytes", F.col("digest").alias("payload_digest"), "record_type", "refers_to")


def op12_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.divergence(table(spark, sf_dir, "documents"))


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runs.periodic_runs(table(spark, sf_dir, "documents"), alter=True)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_token_output": op1_token_output,
        "op2_chat_reconstruction": op2_chat_reconstruction,
        "op3_decontamination": op3_decontamination,
        "op4_repeated_passages": op4_repeated_passages,
        "op5_quality_rules": op5_quality_rules,
        "op6_toxicity": op6_toxicity,
        "op7_pii": op7_pii,
        "op8_near_duplicates": op8_near_duplicates,
        "op9_mixing": op9_mixing,
        "op10_sharding": op10_sharding,
        "op11_warc_index": op11_warc_index,
        "op12_source_divergence": op12_source_divergence,
        "op13_periodic_runs": op13_periodic_runs,
    }


def oracle_sql() -> dict[str, str]:
    return {"op2_chat_reconstruction": OP2_SQL, "op4_repeated_passages": OP4_SQL, "op5_quality_rules": OP5_SQL, "op8_near_duplicates": OP8_SQL, "op11_warc_index": OP11_SQL, "op12_source_divergence": OP12_SQL, "op13_periodic_runs": OP13_SQL}
