"""Recorded exchanges as a Spark data source: spark.read.format("recordings") and df.write.format("recordings").

A recording is a JSON document with an exchange's key (video, prompt variant, window index, query), the raw answer and what else
was kept. The reader takes folders of such documents, one a file as other tools write them or many to a file as JSON lines. The
writer is safe against tasks that run twice or get lost: a task writes below a folder of its own, and only the commit, one file
that lists the tasks' folders, makes them part of the recording; an aborted job's folders are removed.

Wanted values of the key's parts are an option of the reader: files of the writer carry a hash of their video, so other videos'
files stay unread, and the reader hands on no other row. (Filters that Spark hands to a Python source stay with its relation in
this version, so a second query over the same DataFrame would see the first one's rows; they are not used.) A file that cannot be read gives a row with its error and no key, unless
the option mode is "strict", where it fails the query with a typed error that names it.
"""

from __future__ import annotations

import json
import posixpath
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from typing import Any

import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType

from ..errors import BackendUnavailable, InvalidInput
from ..shipping import ship_package

SCHEMA = "video STRING, prompt_variant STRING, index INT, query STRING, raw STRING, reasoning STRING, latency_s DOUBLE, model STRING, start_s DOUBLE, end_s DOUBLE, error STRING, filename STRING, line INT, read_error STRING"
KEY = ("video", "prompt_variant", "index", "query")
#: Hashed groups of videos in file names; loose files of a task.
GROUPS, FILES_A_TASK = 64, 64
_COMMIT = "_committed-"


def filesystem(path: str) -> tuple[pyarrow.fs.FileSystem, str]:
    return pyarrow.fs.FileSystem.from_uri(path)


def group_of(video: Any) -> int:
    return zlib.crc32(str(video).encode("utf-8", "surrogatepass")) % GROUPS


def _number(value: Any, kind: type) -> Any:
    if value is None or isinstance(value, bool):
        return None
    return kind(value)


def exchanges(text: str) -> Iterator[dict]:
    """The documents of a file: one, or one a line."""
    try:
        found = [json.loads(text)]
    except ValueError:
        found = [json.loads(line) for line in text.splitlines() if line.strip()]
    for doc in found:
        if not isinstance(doc, dict) or not isinstance(doc.get("window"), dict) or "index" not in doc["window"] or "query" not in doc:
            raise ValueError("not a recorded exchange: no window index or no query")
        yield doc


def row_of(doc: dict, filename: str, line: int) -> tuple:
    """A row of SCHEMA. Recordings from before the key had four parts have an empty video or prompt variant."""
    window = doc["window"]
    return (
        str(doc.get("video") or ""),
        str(doc.get("prompt_variant") or ""),
        int(window["index"]),
        str(doc["query"]),
        str(doc.get("raw") or ""),
        doc.get("reasoning"),
        _number(doc.get("latency_s"), float),
        doc.get("model"),
        _number(window.get("start_s"), float),
        _number(window.get("end_s"), float),
        doc.get("error"),
        filename,
        line,
        None,
    )


@dataclass
class Files(InputPartition):
    """Names below the recording's folder: files, or folders of one committed task each."""

    names: tuple[str, ...]


class RecordingsReader(DataSourceReader):
    def __init__(self, options: dict[str, str]) -> None:
        self.path, self.strict = options["path"], options.get("mode", "permissive") == "strict"
        self.wanted = {k: set(v) for k, v in json.loads(options.get("wanted", "{}")).items()}
        if set(self.wanted) - set(KEY):
            raise InvalidInput(f"recordings are wanted by {', '.join(KEY)} only")

    def partitions(self) -> list[InputPartition]:
        fs, base = filesystem(self.path)
        if fs.get_file_info(base).type != pyarrow.fs.FileType.Directory:
            raise BackendUnavailable(f"no recordings at {self.path}")
        names = sorted(posixpath.basename(x.path) for x in fs.get_file_info(pyarrow.fs.FileSelector(base)) if x.type == pyarrow.fs.FileType.File)
        tasks = [t for n in names if n.startswith(_COMMIT) for t in json.loads(fs.open_input_file(f"{base}/{n}").read())]
        loose = [n for n in names if n.endswith(".json") and not n.startswith("_")]
        parts: list[InputPartition] = [Files((t,)) for t in tasks]
        return parts + [Files(tuple(loose[i : i + FILES_A_TASK])) for i in range(0, len(loose), FILES_A_TASK)] or [Files(())]

    def _may_hold(self, name: str) -> bool:
        """Whether a file may have wanted rows, by the group in the name that the writer gives it."""
        stem = posixpath.basename(name)
        if "video" not in self.wanted or not stem.startswith("g") or not stem[1:3].isdigit() or stem[3:4] != "-":
            return True
        return int(stem[1:3]) in {group_of(v) for v in self.wanted["video"]}

    def read(self, partition: Files) -> Iterator[tuple]:
        fs, base = filesystem(self.path)
        for name in partition.names:
            at = f"{base}/{name}"
            folder = fs.get_file_info(at).type == pyarrow.fs.FileType.Directory
            files = sorted(x.path for x in fs.get_file_info(pyarrow.fs.FileSelector(at)) if x.type == pyarrow.fs.FileType.File) if folder else [at]
            for file in filter(self._may_hold, files):
                yield from self._rows(fs, file, posixpath.relpath(file, base))

    def _rows(self, fs: pyarrow.fs.FileSystem, file: str, name: str) -> Iterator[tuple]:
        try:
            with fs.open_input_file(file) as f:
                rows = [row_of(doc, name, k) for k, doc in enumerate(exchanges(f.read().decode()))]
        except (OSError, ValueError, TypeError) as e:
            if self.strict:
                raise InvalidInput(f"{name} is no recording: {e}") from e
            rows = [] if self.wanted else [(*[None] * 11, name, 0, f"{type(e).__name__}: {e}")]
        for row in rows:
            if all(row[KEY.index(k)] in values for k, values in self.wanted.items()):
                yield row


@dataclass
class Written(WriterCommitMessage):
    """A task's folder below the recording's, and its rows."""

    folder: str
    rows: int


class RecordingsWriter(DataSourceWriter):
    def __init__(self, options: dict[str, str], schema: StructType, overwrite: bool) -> None:
        self.path, self.names, self.overwrite = options["path"], schema.names, overwrite
        self.per_file = int(options.get("rowsPerFile", "1000"))

    def write(self, iterator: Iterator[Any]) -> WriterCommitMessage:
        fs, base = filesystem(self.path)
        folder = f"task-{uuid.uuid4().hex}"
        fs.create_dir(f"{base}/{folder}", recursive=True)
        held: dict[int, list[str]] = {}
        n = 0

        def close(group: int) -> None:
            with fs.open_output_stream(f"{base}/{folder}/g{group:02d}-{uuid.uuid4().hex[:12]}.json") as out:
                out.write("\n".join(held.pop(group)).encode())

        for row in iterator:
            own = dict(zip(self.names, row, strict=True))
            window = {"index": own.get("index"), "start_s": own.get("start_s"), "end_s": own.get("end_s")}
            doc = {k: own.get(k) for k in ("model", "video", "prompt_variant", "query", "raw", "reasoning", "latency_s", "error")} | {"window": window}
            group = group_of(own.get("video") or "")
            held.setdefault(group, []).append(json.dumps(doc))
            n += 1
            if len(held[group]) >= self.per_file:
                close(group)
        for group in list(held):
            close(group)
        return Written(folder, n)

    def commit(self, messages: list[WriterCommitMessage | None]) -> None:
        fs, base = filesystem(self.path)
        fs.create_dir(base, recursive=True)
        before = [x.path for x in fs.get_file_info(pyarrow.fs.FileSelector(base)) if x.type == pyarrow.fs.FileType.File] if self.overwrite else []
        with fs.open_output_stream(f"{base}/{_COMMIT}{uuid.uuid4().hex}") as out:
            out.write(json.dumps([m.folder for m in messages if isinstance(m, Written) and m.rows]).encode())
        for path in before:  # commits and loose files; a reader that began before keeps its list
            fs.delete_file(path)

    def abort(self, messages: list[WriterCommitMessage | None]) -> None:
        fs, base = filesystem(self.path)
        for m in messages:
            if isinstance(m, Written):
                fs.delete_dir(f"{base}/{m.folder}")


class Recordings(DataSource):
    @classmethod
    def name(cls) -> str:
        return "recordings"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> DataSourceReader:
        return RecordingsReader(dict(self.options))

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceWriter:
        return RecordingsWriter(dict(self.options), schema, overwrite)


def register(spark: SparkSession) -> None:
    """Make the source known to the session."""
    ship_package(spark)
    spark.dataSource.register(Recordings)


def read_recordings(spark: SparkSession, path: str, strict: bool = False, **wanted: list) -> DataFrame:
    """The recordings below path. wanted: for parts of the key, the values to read; other videos' files are not opened."""
    register(spark)
    return spark.read.format("recordings").option("mode", "strict" if strict else "permissive").option("wanted", json.dumps(wanted)).load(path)


def write_recordings(responses: DataFrame, path: str, overwrite: bool = False, rows_per_file: int = 1_000) -> None:
    """responses: the key's columns and raw, and of the other columns those that are there."""
    register(responses.sparkSession)
    responses.write.format("recordings").option("rowsPerFile", rows_per_file).mode("overwrite" if overwrite else "append").save(path)


def first_recordings(recordings: DataFrame) -> DataFrame:
    """The first recording of each key by file and line, with the number of the key's recordings; unreadable files are left out."""
    rows = recordings.where("read_error IS NULL")
    kept = F.struct("raw", "reasoning", "latency_s", "model", "error", "filename", "line")
    return rows.groupBy(*KEY).agg(F.min_by(kept, F.struct("filename", "line")).alias("r"), F.count(F.lit(1)).alias("n")).select(*KEY, "r.*", "n")


def described(recordings: DataFrame) -> DataFrame:
    """One row: recordings, ambiguous ones (no video or no prompt variant), unreadable files."""
    ok = F.col("read_error").isNull()
    ambiguous = ok & ((F.col("video") == "") | (F.col("prompt_variant") == ""))
    return recordings.agg(F.count_if(ok).alias("recordings"), F.count_if(ambiguous).alias("ambiguous"), F.count_if(~ok).alias("unreadable"))
