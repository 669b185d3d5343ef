"""Token-ID output: raw id payloads with a minimal perfect hash index over document keys.

Documents are ranged and sorted by doc_id (and a hash of the text, so that one repeated id is dealt over
many tasks); each task writes one shard, a run of segments. A segment is one row of a Parquet table, so
Spark's committer makes lost executors harmless and any store works: a raw little-endian payload of ids
and a directory of its keys and lengths in order.

The index is a table of its own. A key (a doc_id and its number among equal ones) hashes to a bucket of
about BUCKET_KEYS keys; a bucket is a row with a minimal perfect hash from key to slot and, by slot, the
key's fingerprint, the key itself, its shard, its offset in the shard and its length. A keyed read hashes
once, opens one bucket, compares fingerprint and key, and slices one segment: reads of few keys push the
buckets' numbers and then the shards' and segments' into the Parquet scans, whose row groups are small, so
no other bucket or payload is read. Doc_ids that repeat are listed in a third table with their counts.

Tokenising: the vocabularies meant here normalise and split at white space, so a text's ids are its
white-space chunks' ids one after another. Chunks repeat a lot, so ids are kept per chunk in a
bounded table and only new chunks go through the tokenizer, or its model where a chunk is plainly a word.
Texts with control signs are cut at spaces and line ends only, and take the whole tokenizer.

Defined cases: null and empty texts have only the end id; a null doc_id sorts first and is keyed as
such; rows that repeat a doc_id are documents of their own (lookup() returns each; rows alike in id and
text are dealt to one task); an empty table writes an empty table; other columns are ignored.
"""

from __future__ import annotations

import functools
import os
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import perfect_hash
from .common import arrow_map, cut, gapless, new_folder, partition_number, small_side

#: A segment is closed at so many ids or documents, whichever comes first.
SEGMENT_IDS, SEGMENT_DOCS = 1 << 20, 1024
#: Keys of a bucket of the index, on average; a read of at most FEW_KEYS keys prunes its scans.
BUCKET_KEYS, FEW_KEYS = 1024, 10_000
#: Bytes of a Parquet row group of the index and of the payloads.
INDEX_GROUP, PAYLOAD_GROUP = 1 << 20, 8 << 20
#: Chunks that are kept at most, and their letters at most.
CACHED_CHUNKS, KEPT_LETTERS = 700_000, 64
SEGMENT_SCHEMA = "shard int, segment int, ids_before long, n_ids long, id_bytes int, keys binary, null_keys int, lengths binary, payload binary"
ENTRY_SCHEMA = "key long, shard int, segment int, offset long, n_tokens long"
INDEX_SCHEMA = "bucket long, n_keys int, seed int, pilots binary, prints binary, keys binary, copies binary, nulls binary, shards binary, segments binary, offsets binary, lengths binary"


def _byte_letters() -> dict[int, str]:
    """Letters of Latin-1 as the vocabularies spell their UTF-8 bytes: each byte is one printable sign."""
    signs, free = {}, 256
    for byte in range(256):
        printable = 33 <= byte <= 126 or 161 <= byte <= 172 or 174 <= byte
        signs[byte] = chr(byte) if printable else chr(free)
        free += not printable
    return {c: "".join(signs[b] for b in chr(c).encode()) for c in range(0xDF, 0x100) if c != 0xF7}


_WORD = re.compile(r"[a-zß-öø-ÿ]+")
#: A stop next to a sign that may share its pre-token. (Control signs, which classes of white space are at odds about, do not get here.)
_CROWDED_STOP = re.compile(r"[.,][^\w\s]|[^\w\s][.,]|_")
#: Control signs other than tab and line feed, and the soft hyphen: texts with one take the whole tokenizer.
_CONTROL = re.compile(r"[\x00-\x08\x0b-\x1f\x7f-\x9f\xad]")


class ChunkEncoder:
    """Ids of texts as bytes of one dtype, white-space chunk by chunk.

    A plain word of Latin letters is one pre-token whatever stands around it, so words are lower-cased,
    kept apart from their stops, and new ones go straight to the vocabulary's model. All other chunks
    take the whole tokenizer.
    """

    def __init__(self, tokenizer_path: str):
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(tokenizer_path)
        self.dtype = np.dtype("<u2") if self.tokenizer.get_vocab_size(with_added_tokens=True) <= 1 << 16 else np.dtype("<u4")
        self.plain = Tokenizer(self.tokenizer.model)
        self.plain.pre_tokenizer = pre_tokenizers.Split(" ", "removed")
        self.letters = _byte_letters()
        suffix, held = getattr(self.tokenizer.model, "end_of_word_suffix", None), self.tokenizer.get_vocab(with_added_tokens=True)
        self.ends_word = np.zeros(max(held.values()) + 1, bool)
        self.ends_word[[i for t, i in held.items() if suffix and t.endswith(suffix)]] = True
        self.known: dict[str, bytes] = {"": b""}
        probe = ["straße", "the", "élan", "zu", "ñandú"]
        self.fast = self._by_model(probe) == self._whole(probe)

    def _by_model(self, words: list[str]) -> list[bytes]:
        """Words, none empty and none with a space, as texts of many words; the vocabulary marks tokens that end a word."""
        out: list[bytes] = []
        texts = [" ".join(words[at : at + 512]) for at in range(0, len(words), 512)]
        texts = [t if t.isascii() else t.translate(self.letters) for t in texts]
        for k, found in enumerate(self.plain.encode_batch_fast(texts, add_special_tokens=False)):
            part = words[512 * k : 512 * k + 512]
            ids = np.array(found.ids, dtype=self.dtype)
            ends = ((np.flatnonzero(self.ends_word[ids]) + 1) * self.dtype.itemsize).tolist()
            if len(ends) != len(part):
                out += self._whole(part)
                continue
            data = ids.tobytes()
            out += [data[a:b] for a, b in zip([0, *ends[:-1]], ends, strict=True)]
        return out

    def _whole(self, chunks: list[str]) -> list[bytes]:
        return [self._bytes(x.ids) for x in self.tokenizer.encode_batch_fast(chunks, add_special_tokens=False)]

    def _bytes(self, ids: list[int]) -> bytes:
        return np.array(ids, dtype=self.dtype).tobytes()

    def _learn(self, chunks: list[str]) -> None:
        plain = list(filter(_WORD.fullmatch, chunks)) if self.fast else []
        rest = list(set(chunks).difference(plain))
        self.known.update(zip(plain, self._by_model(plain), strict=True))
        self.known.update(zip(rest, self._whole(rest), strict=True))

    def _chunks(self, text: str) -> list[str]:
        """White-space chunks. In texts of Latin-1, lower-cased and with lone stops as chunks of their own: the same pre-tokens.

        Only " " and "\n" split here; whatever other white space a chunk holds, the tokenizer sees.
        """
        try:
            text.encode("latin-1")
        except UnicodeEncodeError:
            return text.replace("\n", " ").split(" ")
        if "<|" not in text and not _CONTROL.search(text):
            text = text.lower()
            if not _CROWDED_STOP.search(text):
                text = text.replace(",", " , ").replace(".", " . ")
        return text.replace("\n", " ").split(" ")

    def encode(self, texts: list[str]) -> list[bytes]:
        known = self.known
        if len(known) > CACHED_CHUNKS:
            known.clear()
            known[""] = b""
        split = [self._chunks(t) for t in texts]
        new = sorted((c for c in set().union(*split) if c not in known), key=str.isascii)
        for at in range(0, len(new), 4096):
            self._learn(new[at : at + 4096])
        out = [b"".join(map(known.__getitem__, chunks)) for chunks in split]
        for c in new:  # the table is bounded in bytes: long chunks stay for this batch only
            if len(c) > KEPT_LETTERS:
                del known[c]
        return out


@functools.lru_cache(maxsize=2)
def encoder_of(tokenizer_path: str) -> ChunkEncoder:
    """One encoder a Python worker, kept from task to task."""
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    return ChunkEncoder(tokenizer_path)


def key_column(key: str = "key", copy: str = "copy") -> Column:
    """The 64-bit hash of a key that buckets and slots come from."""
    return F.xxhash64(F.lit(1), F.col(key), F.col(copy))


def _segment(shard: int, number: int, before: int, ids: list[bytes], keys: list[int | None], dtype: np.dtype) -> dict:
    lengths = np.array([len(x) // dtype.itemsize for x in ids], dtype=np.int64)
    return {
        "shard": shard, "segment": number, "ids_before": before, "n_ids": int(lengths.sum()), "id_bytes": dtype.itemsize,
        "keys": np.array([0 if x is None else x for x in keys], dtype=np.int64).tobytes(), "null_keys": sum(k is None for k in keys), "lengths": lengths.tobytes(), "payload": b"".join(ids),
    }


def _arrow_schema(ddl: str) -> pa.Schema:
    kinds = {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary(), "string": pa.string(), "boolean": pa.bool_(), "double": pa.float64()}
    return pa.schema([(name, kinds[kind]) for name, kind in (x.split() for x in ddl.split(", "))])


def write_shards(docs: DataFrame, folder: str, tokenizer_path: str, end_id: int, shards: int | None = None) -> None:
    """Encode docs (doc_id, text) and write under folder: ids (segments in ascending doc_id order), index and repeats."""
    spark = docs.sparkSession
    shards = shards or int(spark.conf.get("spark.sql.shuffle.partitions"))
    schema = _arrow_schema(SEGMENT_SCHEMA)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = encoder_of(tokenizer_path)
        end = np.array([end_id], dtype=encoder.dtype).tobytes()
        shard, number, before = partition_number(), 0, 0
        ids: list[bytes] = []
        keys: list[int | None] = []
        held = 0

        def close() -> pa.RecordBatch:
            nonlocal ids, keys, held, number, before
            row = _segment(shard, number, before, ids, keys, encoder.dtype)
            number, before, ids, keys, held = number + 1, before + row["n_ids"], [], [], 0
            return pa.RecordBatch.from_pylist([row], schema=schema)

        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                part = batch.slice(at, 64).to_pydict()
                for key, own in zip(part["doc_id"], encoder.encode([t or "" for t in part["text"]]), strict=True):
                    keys.append(key)
                    ids.append(own + end)
                    held += len(ids[-1]) // encoder.dtype.itemsize
                    if held >= SEGMENT_IDS or len(keys) >= SEGMENT_DOCS:
                        yield close()
        if keys:
            yield close()

    place = (F.col("doc_id").asc_nulls_first(), F.xxhash64("text"))
    ranged = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).repartitionByRange(shards, *place).sortWithinPartitions(*place)
    arrow_map(ranged, encode, SEGMENT_SCHEMA).write.option("parquet.block.size", PAYLOAD_GROUP).parquet(f"{folder}/ids")
    write_index(spark, folder)


def entries(spark: SparkSession, folder: str) -> DataFrame:
    """key, shard, segment, offset (in the shard) and n_tokens of every document, from the segments' directories."""
    schema = _arrow_schema(ENTRY_SCHEMA)

    def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                keys, n = np.frombuffer(row["keys"], np.int64), np.frombuffer(row["lengths"], np.int64)
                count, null = len(keys), np.arange(len(keys)) < row["null_keys"]
                at = row["ids_before"] + np.cumsum(n) - n
                yield pa.RecordBatch.from_arrays([pa.array(keys, mask=null), pa.array(np.full(count, row["shard"], np.int32)), pa.array(np.full(count, row["segment"], np.int32)), pa.array(at), pa.array(n)], schema=schema)

    return arrow_map(spark.read.parquet(f"{folder}/ids").select("shard", "segment", "ids_before", "keys", "null_keys", "lengths"), listed, ENTRY_SCHEMA)


def _bucket_row(bucket: int, rows: pa.Table) -> dict:
    h = rows["h"].to_numpy().view(np.uint64)
    seed, pilots = perfect_hash.build(h)
    order = np.empty(len(h), np.int64)
    order[perfect_hash.slots(h, seed, pilots, len(h))] = np.arange(len(h))
    null = rows["key"].is_null().to_numpy()
    by_slot = lambda name, kind: rows[name].fill_null(0).to_numpy().astype(kind)[order].tobytes()
    return {
        "bucket": bucket, "n_keys": len(h), "seed": seed, "pilots": pilots.tobytes(), "prints": perfect_hash.fingerprints(h)[order].tobytes(),
        "keys": by_slot("key", np.int64), "copies": by_slot("copy", np.int64), "nulls": null[order].tobytes(), "shards": by_slot("shard", np.int32),
        "segments": by_slot("segment", np.int32), "offsets": by_slot("offset", np.int64), "lengths": by_slot("n_tokens", np.int64),
    }


def write_index(spark: SparkSession, folder: str) -> None:
    """The index and repeats tables of the segments under folder."""
    found = cut(entries(spark, folder))
    repeats = cut(found.groupBy("key").agg(F.count(F.lit(1)).alias("copies")).where("copies > 1"))
    repeats.write.parquet(f"{folder}/repeats")
    numbered = gapless(found, ["key"], ["shard", "segment", "offset"], "copy") if repeats.limit(1).count() else found.withColumn("copy", F.lit(0).cast("long"))
    buckets = max(1, -(-found.count() // BUCKET_KEYS))
    schema = _arrow_schema(INDEX_SCHEMA)

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bucket, held = None, []

        def closed() -> pa.RecordBatch:
            return pa.RecordBatch.from_pylist([_bucket_row(bucket, pa.Table.from_batches(held))], schema=schema)

        for batch in batches:
            number = batch.column(0).to_numpy()
            edges = [0, *(np.flatnonzero(number[1:] != number[:-1]) + 1).tolist(), len(number)]
            for a, b in zip(edges, edges[1:], strict=False):
                if a < b:
                    if held and number[a] != bucket:
                        yield closed()
                        held = []
                    bucket = int(number[a])
                    held.append(batch.slice(a, b - a))
        if held:
            yield closed()

    keyed = numbered.select(F.pmod(key_column(), F.lit(buckets)).alias("bucket"), key_column().alias("h"), "key", "copy", "shard", "segment", "offset", "n_tokens")
    arrow_map(keyed.repartitionByRange("bucket").sortWithinPartitions("bucket"), build, INDEX_SCHEMA).write.option("parquet.block.size", INDEX_GROUP).parquet(f"{folder}/index")


LOCATED_SCHEMA = "key long, shard int, segment int, offset long, n_tokens long"


def located(spark: SparkSession, folder: str, keys: DataFrame) -> DataFrame:
    """Where the documents of keys (key; null for documents without a doc_id) are, by the index: key, shard, segment, offset, n_tokens.

    Keys that are not there give no row.
    """
    index, repeats = spark.read.parquet(f"{folder}/index"), spark.read.parquet(f"{folder}/repeats")
    buckets = _bucket_count(index)
    often = repeats.select(F.col("key").alias("_key"), F.col("copies").alias("_n"))
    wanted = keys.select(F.col("key").cast("long").alias("key")).distinct().join(often, F.col("key").eqNullSafe(F.col("_key")), "left")
    wanted = wanted.select("key", F.explode(F.sequence(F.lit(0).cast("long"), F.coalesce("_n", F.lit(1)) - 1)).alias("copy"))
    wanted = cut(wanted.select(F.pmod(key_column(), F.lit(buckets)).alias("_bucket"), F.struct(key_column().alias("h"), "key", "copy").alias("w")).groupBy("_bucket").agg(F.collect_list("w").alias("wanted")))
    if wanted.limit(FEW_KEYS + 1).count() <= FEW_KEYS:
        index = index.where(F.col("bucket").isin([r["_bucket"] for r in wanted.select("_bucket").collect()]))  # at most FEW_KEYS numbers
    schema = _arrow_schema(LOCATED_SCHEMA)

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            asked = batch.column(batch.schema.get_field_index("wanted"))
            for i, row in enumerate(batch.drop_columns(["wanted"]).to_pylist()):
                w = asked[i].values
                h, key, copy = (w.field(k) for k in range(3))
                null = key.is_null().to_numpy(zero_copy_only=False)
                h, key, copy = h.to_numpy().view(np.uint64), key.fill_null(0).to_numpy(), copy.to_numpy()
                slot = perfect_hash.slots(h, row["seed"], np.frombuffer(row["pilots"], np.uint16), row["n_keys"])
                held = {name: np.frombuffer(row[name], kind) for name, kind in (("prints", np.uint32), ("keys", np.int64), ("copies", np.int64), ("nulls", np.bool_), ("shards", np.int32), ("segments", np.int32), ("offsets", np.int64), ("lengths", np.int64))}
                same = (held["prints"][slot] == perfect_hash.fingerprints(h)) & (held["keys"][slot] == key) & (held["copies"][slot] == copy) & (held["nulls"][slot] == null)
                slot = slot[same]
                yield pa.RecordBatch.from_arrays([pa.array(key[same], mask=null[same]), *(pa.array(held[name][slot]) for name in ("shards", "segments", "offsets", "lengths"))], schema=schema)

    return arrow_map(index.join(wanted, F.col("bucket") == F.col("_bucket")).drop("_bucket", "bucket"), probe, LOCATED_SCHEMA)


def _bucket_count(index: DataFrame) -> int:
    """Buckets that keys were dealt to, from the number of keys, which Parquet rows add up."""
    return max(1, -(-(index.agg(F.sum("n_keys")).first()[0] or 0) // BUCKET_KEYS))


def _segments_of(spark: SparkSession, folder: str, found: DataFrame) -> DataFrame:
    """Segments (id_bytes, ids_before, payload) with `asked`, the located documents in them; few segments prune the scan."""
    asked = cut(found.groupBy(F.col("shard").alias("_shard"), F.col("segment").alias("_segment")).agg(F.collect_list(F.struct("key", "offset", "n_tokens")).alias("asked")))
    segments = spark.read.parquet(f"{folder}/ids").select("shard", "segment", "ids_before", "id_bytes", "payload")
    few = asked.select("_shard", "_segment").limit(FEW_KEYS + 1).collect()  # bounded
    if len(few) <= FEW_KEYS:
        segments = segments.where(F.col("shard").isin(sorted({r["_shard"] for r in few})) & F.col("segment").isin(sorted({r["_segment"] for r in few})))
    # The payload side is neither sorted nor built into a table; documents of a segment are at most SEGMENT_DOCS.
    return segments.join(asked.hint("shuffle_hash"), (F.col("shard") == F.col("_shard")) & (F.col("segment") == F.col("_segment")))


def shard_starts(spark: SparkSession, folder: str) -> DataFrame:
    """_shard and _base: ids in all shards before it. One row a shard."""
    sums = spark.read.parquet(f"{folder}/ids").groupBy(F.col("shard").alias("_shard")).agg(F.sum("n_ids").alias("_n"))
    before = Window.orderBy("_shard").rowsBetween(Window.unboundedPreceding, -1)
    return sums.select("_shard", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_base"))


READ_SCHEMA = "doc_id long, shard int, segment int, offset long, n_tokens long, ids_crc32 long"


def read_documents(spark: SparkSession, folder: str, keys: DataFrame | None = None) -> DataFrame:
    """Documents of keys (key; all keys of the files by default) by the index: doc_id, start, n_tokens, ids_crc32, shard, segment."""
    schema = _arrow_schema(READ_SCHEMA)
    found = located(spark, folder, entries(spark, folder).select("key") if keys is None else keys)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1)
                one = row.drop_columns(["asked"]).to_pylist()[0]
                asked = row.column(row.schema.get_field_index("asked"))[0].values
                key, offset, n = (asked.field(k) for k in range(3))
                ids = np.frombuffer(one["payload"], dtype=f"<u{one['id_bytes']}").astype("<u4")
                at = (offset.to_numpy() - one["ids_before"]).tolist()
                crc = [zlib.crc32(ids[a : a + k]) for a, k in zip(at, n.to_pylist(), strict=True)]
                yield pa.RecordBatch.from_arrays([key, pa.array([one["shard"]] * len(crc), pa.int32()), pa.array([one["segment"]] * len(crc), pa.int32()), offset, n, pa.array(crc, pa.int64())], schema=schema)

    told = arrow_map(_segments_of(spark, folder, found), read, READ_SCHEMA).join(small_side(cut(shard_starts(spark, folder))), F.col("shard") == F.col("_shard"), "left")
    return told.select("doc_id", (F.col("offset") + F.col("_base")).alias("start"), "n_tokens", "ids_crc32", "shard", "segment")


def lookup(spark: SparkSession, folder: str, keys: DataFrame) -> DataFrame:
    """Ids of the documents of keys (doc_id): doc_id, ids (array of int). Keys that are not there give no row."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                ids = np.frombuffer(row["payload"], dtype=f"<u{row['id_bytes']}")
                own = [(a["key"], a["offset"] - row["ids_before"], a["n_tokens"]) for a in row["asked"]]
                yield pa.RecordBatch.from_arrays([pa.array([k for k, _, _ in own], pa.int64()), pa.array([ids[a : a + n].astype(np.int32) for _, a, n in own], pa.list_(pa.int32()))], names=["doc_id", "ids"])

    found = located(spark, folder, keys.select(F.col("doc_id").alias("key")).where("key IS NOT NULL"))
    return arrow_map(_segments_of(spark, folder, found), read, "doc_id long, ids array<int>")


def encoded(docs: DataFrame, tokenizer_path: str, end_id: int) -> str:
    """Write docs into a new shared folder and return it."""
    folder = new_folder(docs.sparkSession, "tokens")
    write_shards(docs, folder, tokenizer_path, end_id)
    return folder
