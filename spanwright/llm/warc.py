"""WARC archives with a two-level capture index.

Archive: each task writes files of gzip members, one a record, and returns a capture (a row with file, offset and length) for
each. Of pages with equal payloads the one with the smallest page_id is a response record, the others are revisit records that
name it; the responses come from one grouped minimum, so copies are dropped before the shuffle, and revisit records never move a
payload. A task that runs twice writes two files; only the captures that Spark committed are known, so lost executors
leave at most a file that nothing names.

Index: captures are sorted by URL key (the host's labels reversed, then port, path and query) over parts of bounded number. A
part is a file of compressed blocks of about BLOCK_LINES captures, followed by its sparse directory: the first key of each
block with offset and length. The manifest, a Parquet table committed by Spark, has a row a part: its first key, cut to
PREFIX bytes, and where its directory is. At most MAX_PARTS rows of PREFIX bytes reach the driver. A lookup is dealt to the
parts that its key may be in, by binary search over the manifest; a task searches a part's directory, reads the one
block (or those that hold a key's many captures) by its byte range, and searches in it. Records are then read by their
ranges, in the order of files and offsets.

Defined cases: null html is an empty payload; null urls have the empty key; null page_ids order last among equal payloads and
are written as null; of rows alike in all three one is the response and the others revisit it; an empty table writes an
archive without records; other columns are ignored.
"""

from __future__ import annotations

import base64
import functools
import hashlib
import json
import uuid
import zlib
from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import arrow_map, cut, cut_counted, heavy_join, new_folder

#: Bytes after which a task begins another archive file; captures of an index block; bytes of a block's lines at most.
FILE_BYTES, BLOCK_LINES, BLOCK_BYTES = 1 << 30, 1_024, 1 << 20
#: Captures of an index part on average, parts at most, bytes of a part's first key in the manifest.
PART_LINES, MAX_PARTS, PREFIX = 100_000, 4_096, 512
#: Captures that a task hands on at once.
ROWS = 4_096
DATE = "1970-01-01T00:00:00Z"

CAPTURE = "key string, page_id long, url string, record_type string, digest string, target string, file string, offset long, length int"
_FIELDS = ("key", "page_id", "url", "record_type", "digest", "target", "file", "offset", "length")
MANIFEST = "first binary, file string, at long, size int, lines long"
RECORD = "page_id long, url string, record_id string, record_type string, digest string, target string, refers_to long, refers_url string, payload_bytes long, payload binary"


def url_key(url: Column) -> Column:
    """example.com's page /a?b as com,example)/a?b: sites and their hosts stand together. Schemes, users and fragments are left out."""
    host = F.lower(F.regexp_extract(url, r"^(?:[A-Za-z][A-Za-z0-9+.\-]*:)?//(?:[^/?#@]*@)?([^/?#:]*)", 1))
    port = F.regexp_extract(url, r"^(?:[A-Za-z][A-Za-z0-9+.\-]*:)?//(?:[^/?#@]*@)?[^/?#:]*(:[0-9]+)", 1)
    rest = F.regexp_replace(F.regexp_replace(url, r"^(?:[A-Za-z][A-Za-z0-9+.\-]*:)?//[^/?#]*", ""), r"(?s)#.*$", "")
    return F.coalesce(F.concat(F.array_join(F.reverse(F.split(host, r"\.")), ","), port, F.lit(")"), rest), F.lit(""))


def filesystem(folder: str) -> tuple[pyarrow.fs.FileSystem, str]:
    return pyarrow.fs.FileSystem.from_uri(folder)


def base32_digest(hexed: str) -> str:
    return base64.b32encode(bytes.fromhex(hexed)).decode()


def record_name(digest: str, size: int) -> str:
    """The id of the response that holds a payload."""
    return f"<urn:uuid:{uuid.UUID(hashlib.sha1(f'{digest}:{size}'.encode()).hexdigest()[:32])}>"


def record_bytes(page_id: int | None, url: str | None, record_id: str, record_type: str, digest: str, size: int, payload: bytes, refers: tuple | None) -> bytes:
    """A record as one gzip member. refers: (record id, page_id, url) of the response that a revisit stands for."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % size
    lines = [
        "WARC/1.1",
        f"WARC-Type: {record_type}",
        f"WARC-Record-ID: {record_id}",
        f"WARC-Date: {DATE}",
        f"WARC-Payload-Digest: sha1:{digest}",
        "Content-Type: application/http;msgtype=response",
        f"Content-Length: {len(http) + len(payload)}",
        "X-Page: " + json.dumps({"page_id": page_id, "url": url}),
    ]
    if url:
        lines.append("WARC-Target-URI: " + "".join(c if " " < c < "\x7f" else "".join(f"%{b:02X}" for b in c.encode("utf-8", "surrogatepass")) for c in url))
    if refers:
        lines += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: {refers[0]}", "X-Refers-To-Page: " + json.dumps({"page_id": refers[1], "url": refers[2]})]
    packer = zlib.compressobj(5, zlib.DEFLATED, 31)
    head = "\r\n".join(lines).encode("utf-8", "surrogatepass") + b"\r\n\r\n"
    return packer.compress(head + http) + packer.compress(payload) + packer.compress(b"\r\n\r\n") + packer.flush()


def read_record(data: bytes) -> dict:
    """A record's fields; the payload of a revisit is empty."""
    whole = zlib.decompress(data, 31)
    end = whole.index(b"\r\n\r\n")
    told = dict(line.split(": ", 1) for line in whole[:end].decode("utf-8", "surrogatepass").split("\r\n")[1:])
    block = whole[end + 4 : end + 4 + int(told["Content-Length"])]
    payload = block[block.index(b"\r\n\r\n") + 4 :]
    page, refers = json.loads(told["X-Page"]), json.loads(told.get("X-Refers-To-Page", "{}"))
    return {
        "page_id": page["page_id"],
        "url": page["url"],
        "record_id": told["WARC-Record-ID"],
        "record_type": told["WARC-Type"],
        "digest": told["WARC-Payload-Digest"].removeprefix("sha1:"),
        "target": told.get("WARC-Refers-To"),
        "refers_to": refers.get("page_id"),
        "refers_url": refers.get("url"),
        "payload_bytes": len(payload),
        "payload": payload,
    }


def batch_of(rows: list[dict], schema: str) -> pa.RecordBatch:
    kinds = {"string": pa.string(), "long": pa.int64(), "int": pa.int32(), "binary": pa.binary()}
    fields = [x.split() for x in schema.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array([r[n] for r in rows], kinds[t]) for n, t in fields], names=[n for n, _ in fields])


def to_write(pages: DataFrame, least_bytes: int) -> DataFrame:
    """page_id, url, key, hexed, size, html (binary; null for revisits), named (whether other records may name it), r_page, r_url."""
    html = F.encode(F.coalesce(F.col("html").cast("string"), F.lit("")), "utf-8")
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), html.alias("html"))
    rows = rows.withColumns({"hexed": F.sha1("html"), "size": F.octet_length("html").cast("long")})
    small, shared = rows.where(F.col("size") < least_bytes), rows.where(F.col("size") >= least_bytes)
    rank = F.struct(F.isnull("page_id"), "page_id", F.isnull("url"), "url")
    same = ["hexed", "size"]
    responses = shared.groupBy(*same).agg(F.min_by(F.struct("page_id", "url", "html"), rank).alias("r")).select("r.*", *same)
    # How often each page stands there with one payload; only payloads of several rows go on.
    alike = shared.groupBy(*same, "page_id", "url").agg(F.count(F.lit(1)).alias("m"))
    alike, n = cut_counted(alike)
    first = F.min(F.struct(F.isnull("page_id"), "page_id", F.isnull("url"), "url")).alias("f")
    groups = cut(alike.groupBy(*same).agg(first, F.sum("m").alias("_rows"), F.count(F.lit(1)).alias("_n")).where("_rows > 1").select(*same, F.col("f.page_id").alias("r_page"), F.col("f.url").alias("r_url"), "_n"))
    copies = heavy_join(alike, groups, same, "_n", n)
    is_first = F.col("page_id").eqNullSafe(F.col("r_page")) & F.col("url").eqNullSafe(F.col("r_url"))
    copies = copies.withColumn("m", F.when(is_first, F.col("m") - 1).otherwise(F.col("m"))).where("m > 0")
    copies = copies.withColumn("_copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("m"))))
    none, text, number = F.lit(None).cast("binary"), F.lit(None).cast("string"), F.lit(None).cast("long")
    columns = ["page_id", "url", "hexed", "size", "html", "record_type", "named", "r_page", "r_url"]
    parts = [
        responses.withColumns({"record_type": F.lit("response"), "named": F.lit(True), "r_page": number, "r_url": text}).select(*columns),
        copies.withColumns({"record_type": F.lit("revisit"), "named": F.lit(False), "html": none}).select(*columns),
    ]
    if least_bytes > 0:
        parts.append(small.withColumns({"record_type": F.lit("response"), "named": F.lit(False), "r_page": number, "r_url": text}).select(*columns))
    return functools.reduce(DataFrame.union, parts).withColumn("key", url_key(F.col("url")))


def write_archive(pages: DataFrame, folder: str, least_bytes: int = 0, file_bytes: int = FILE_BYTES) -> DataFrame:
    """Write pages (page_id, url, html) as WARC files below folder; their captures, read back from folder/captures."""
    spark = pages.sparkSession
    filesystem(folder)[0].create_dir(filesystem(folder)[1], recursive=True)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = filesystem(folder)
        out, name, at = None, "", 0
        for batch in batches:
            found = []
            for k in range(batch.num_rows):
                row = batch.slice(k, 1).to_pylist()[0]
                if out is None or at >= file_bytes:
                    if out is not None:
                        out.close()
                    name, at = f"pages-{uuid.uuid4().hex}.warc.gz", 0
                    out = fs.open_output_stream(f"{base}/{name}", compression=None)
                digest, target = base32_digest(row["hexed"]), record_name(row["hexed"], row["size"])
                own = target if row["named"] else f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{name}:{at}')}>"
                refers = (target, row["r_page"], row["r_url"]) if row["record_type"] == "revisit" else None
                data = record_bytes(row["page_id"], row["url"], own, row["record_type"], digest, row["size"], row["html"] or b"", refers)
                out.write(data)
                found.append({"key": row["key"], "page_id": row["page_id"], "url": row["url"], "record_type": row["record_type"], "digest": digest, "target": refers and target, "file": name, "offset": at, "length": len(data)})
                at += len(data)
            yield batch_of(found, CAPTURE)
        if out is not None:
            out.close()

    arrow_map(to_write(pages, least_bytes), write, CAPTURE).write.parquet(f"{folder}/captures")
    return spark.read.parquet(f"{folder}/captures")


def build_index(captures: DataFrame, folder: str, block_lines: int = BLOCK_LINES, part_lines: int = PART_LINES) -> None:
    """The two-level index of captures: part files below folder, and the manifest in folder/manifest."""
    n = captures.count()
    parts = max(1, min(MAX_PARTS, -(-n // part_lines)))
    # More parts than tasks are wanted only for large archives; small ones still use every task.
    parts = max(parts, min(MAX_PARTS, int(captures.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-n // block_lines) or 1))

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = filesystem(folder)
        lines: list[str] = []
        blocks: list[tuple[str, int, int]] = []
        out, name, at, n, size = None, "", 0, 0, 0

        def close_block() -> None:
            nonlocal at, lines, size
            if lines:
                data = zlib.compress("\n".join(lines).encode(), 5)
                out.write(data)
                blocks.append((json.loads(lines[0])[0], at, len(data)))
                at, lines, size = at + len(data), [], 0

        for batch in batches:
            for row in batch.to_pylist():
                if out is None:
                    name = f"index-{uuid.uuid4().hex}"
                    out = fs.open_output_stream(f"{base}/{name}", compression=None)
                line = json.dumps([row[f] for f in _FIELDS])
                lines.append(line)
                n, size = n + 1, size + len(line)
                if len(lines) >= block_lines or size >= BLOCK_BYTES:
                    close_block()
        if out is not None:
            close_block()
            directory = zlib.compress(json.dumps(blocks).encode())
            out.write(directory)
            out.close()
            yield batch_of([{"first": blocks[0][0].encode("utf-8", "surrogatepass")[:PREFIX], "file": name, "at": at, "size": len(directory), "lines": n}], MANIFEST)

    order = ["key", "page_id", "file", "offset"]
    ranged = captures.select(*_FIELDS).repartitionByRange(parts, *order).sortWithinPartitions(*order)
    arrow_map(ranged, write, MANIFEST).write.parquet(f"{folder}/manifest")


def read_range(fs: pyarrow.fs.FileSystem, path: str, at: int, size: int) -> bytes:
    with fs.open_input_file(path) as f:
        return f.read_at(size, at)


@functools.lru_cache(maxsize=4)
def _directory(folder: str, file: str, at: int, size: int) -> tuple[list[bytes], list[tuple[int, int]]]:
    fs, base = filesystem(folder)
    blocks = json.loads(zlib.decompress(read_range(fs, f"{base}/{file}", at, size)))
    return [b[0].encode("utf-8", "surrogatepass") for b in blocks], [(b[1], b[2]) for b in blocks]


@functools.lru_cache(maxsize=4)
def _block(folder: str, file: str, at: int, size: int) -> tuple[list[bytes], list[list]]:
    fs, base = filesystem(folder)
    rows = [json.loads(x) for x in zlib.decompress(read_range(fs, f"{base}/{file}", at, size)).split(b"\n")]
    return [r[0].encode("utf-8", "surrogatepass") for r in rows], rows


def captures_in_part(folder: str, part: dict, key: bytes) -> Iterator[list]:
    """The captures of a key in a part: its directory and then its blocks are searched."""
    firsts, places = _directory(folder, part["file"], part["at"], part["size"])
    for k in range(max(0, bisect_left(firsts, key) - 1), bisect_right(firsts, key)):
        keys, rows = _block(folder, part["file"], *places[k])
        yield from rows[bisect_left(keys, key) : bisect_right(keys, key)]


def lookup(keys: DataFrame, folder: str) -> DataFrame:
    """The captures of keys (key), each key once, through the index in folder."""
    spark = keys.sparkSession
    parts = [r.asDict() for r in spark.read.parquet(f"{folder}/manifest").orderBy("first", "file").collect()]  # MAX_PARTS rows at most
    firsts = [bytes(p["first"]) for p in parts]

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for key in batch.column(0).to_pylist():
                own = key.encode("utf-8", "surrogatepass")[:PREFIX]
                rows += [{"part": p, "key": key} for p in range(max(0, bisect_left(firsts, own) - 1), bisect_right(firsts, own))]
            yield batch_of(rows, "part int, key string")

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for p, key in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                for found in captures_in_part(folder, parts[p], key.encode("utf-8", "surrogatepass")):
                    rows.append(dict(zip(_FIELDS, found, strict=True)))
                    if len(rows) >= ROWS:
                        yield batch_of(rows, CAPTURE)
                        rows = []
            yield batch_of(rows, CAPTURE)

    dealt = arrow_map(keys.select("key").where("key IS NOT NULL").distinct(), deal, "part int, key string")
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    # Written out, as dealing the captures to readers by file and offset looks at them twice.
    return cut(arrow_map(cut(dealt).repartitionByRange(n, "part", "key").sortWithinPartitions("part", "key"), search, CAPTURE))


def read_records(captures: DataFrame, folder: str, payload: bool = True) -> DataFrame:
    """The records of captures, read by their ranges; digest is that of a response's payload as read, and a revisit's as it states it."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = filesystem(folder)
        name, held = "", None
        for batch in batches:
            rows: list[dict] = []
            size = 0
            for file, at, length in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                if file != name:
                    if held is not None:
                        held.close()
                    name, held = file, fs.open_input_file(f"{base}/{file}")
                row = read_record(held.read_at(length, at))
                if row["record_type"] == "response":
                    found = base64.b32encode(hashlib.sha1(row["payload"]).digest()).decode()
                    if found != row["digest"]:
                        raise ValueError(f"{file} at {at}: the payload's digest is {found}, the record says {row['digest']}")
                size += row["payload_bytes"]
                rows.append(row if payload else row | {"payload": None})
                if payload and size >= 4 << 20:
                    yield batch_of(rows, RECORD)
                    rows, size = [], 0
            yield batch_of(rows, RECORD)
        if held is not None:
            held.close()

    n = int(captures.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    order = ["file", "offset"]
    return arrow_map(captures.select(*order, "length").repartitionByRange(n, *order).sortWithinPartitions(*order), read, RECORD)


def archived(pages: DataFrame, least_bytes: int = 0) -> str:
    """Write pages as an archive with its index into a new folder below the shared one."""
    folder = new_folder(pages.sparkSession, "warc")
    build_index(write_archive(pages, folder, least_bytes), folder)
    return folder


def resolved(records: DataFrame) -> DataFrame:
    """page_id, url, payload_bytes, digest, record_type, refers_to of read records; a revisit's payload is that of the response it names."""
    records, n = cut_counted(records)
    columns = ["page_id", "url", "payload_bytes", "digest", "record_type", "refers_to"]
    revisits = records.where("record_type = 'revisit'")
    named = revisits.groupBy("target").agg(F.count(F.lit(1)).alias("_n"))
    full = records.where("record_type = 'response'").drop("target").join(named, F.col("record_id") == F.col("target")).select("target", F.col("payload_bytes").alias("full_bytes"), F.col("digest").alias("full_digest"), "_n")
    met = heavy_join(revisits.drop("payload"), cut(full), ["target"], "_n", n, how="left")
    wrong = F.raise_error(F.concat(F.lit("no response for the revisit of "), F.coalesce("url", F.lit("null")))).cast("string")
    told = F.when(F.col("full_digest") == F.col("digest"), F.col("full_digest")).otherwise(wrong)
    met = met.select("page_id", "url", F.col("full_bytes").alias("payload_bytes"), told.alias("digest"), "record_type", "refers_to")
    return records.where("record_type = 'response'").select(*columns).union(met)


def fetch(urls: DataFrame, folder: str) -> DataFrame:
    """page_id, url, record_type and payload of every capture of urls (url); revisits have the payload of their response, which
    is found through the index as well."""
    records = cut(read_records(lookup(urls.select(url_key(F.col("url")).alias("key")), folder), folder))
    revisits, columns = records.where("record_type = 'revisit'"), ["page_id", "url", "record_type", "payload"]
    aims = cut(revisits.select(url_key(F.col("refers_url")).alias("key"), F.col("refers_to").alias("_p"), F.col("refers_url").alias("_u")).distinct())
    found = lookup(aims.select("key"), folder).where("record_type = 'response'")
    found = found.join(aims.drop("key"), F.col("page_id").eqNullSafe(F.col("_p")) & F.col("url").eqNullSafe(F.col("_u")), "left_semi")
    held = read_records(found, folder).select(F.col("record_id").alias("_id"), F.col("payload").alias("full"))
    full = revisits.drop("payload").join(held, F.col("target") == F.col("_id"), "left").withColumnRenamed("full", "payload")
    return records.where("record_type = 'response'").select(*columns).union(full.select(*columns))
