"""Metadata of recordings from their containers' headers: ISO media files (mp4, mov, m4v) and AVI. No frame is decoded.

Only headers are read, by byte ranges, however long the files are. A file that cannot be read, or has no video stream or no
duration, has a row with its error, so that a run can refuse it by name; Spark lists no empty files, so they have no row.
"""

from __future__ import annotations

import posixpath
import re
import struct
from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession

from ..shipping import ship_package

MEDIA = "video STRING, path STRING, size_bytes LONG, duration_s DOUBLE, width INT, height INT, fps DOUBLE, n_streams INT, error STRING"
Read = Callable[[int, int], bytes]


class Unreadable(Exception):
    """A file's metadata cannot be told; says why."""


def boxes(read: Read, at: int, end: int) -> Iterator[tuple[bytes, int, int]]:
    """(kind, begin, end) of the bodies of the boxes that stand from at to end."""
    while at + 8 <= end:
        head = read(at, 16)
        size, kind = struct.unpack(">I4s", head[:8])
        skip = 8
        if size == 1:
            size, skip = struct.unpack(">Q", head[8:16])[0], 16
        size = size or end - at
        if size < skip:
            raise Unreadable("a box is shorter than its head")
        yield kind, at + skip, min(at + size, end)
        at += size


def _times(read: Read, at: int) -> float | None:
    """Seconds of an mvhd or mdhd box; none where it does not know."""
    data = read(at, 32)
    scale, length = struct.unpack(">IQ", data[20:32]) if data[0] else struct.unpack(">II", data[12:20])
    unknown = (1 << 64 if data[0] else 1 << 32) - 1
    return length / scale if scale and length not in (0, unknown) else None


def iso_media(read: Read, size: int) -> dict:
    moov = next(((a, b) for kind, a, b in boxes(read, 0, size) if kind == b"moov"), None)
    if moov is None:
        raise Unreadable("no movie header")
    whole, found, n = None, None, 0
    for kind, a, b in boxes(read, *moov):
        if kind == b"mvhd":
            whole = _times(read, a)
        elif kind == b"trak":
            n += 1
            own = {k: (x, y) for k, x, y in boxes(read, a, b)}
            media = {k: (x, y) for k, x, y in boxes(read, *own[b"mdia"])} if b"mdia" in own else {}
            if found is not None or b"hdlr" not in media or read(media[b"hdlr"][0] + 8, 4) != b"vide":
                continue
            width, height = struct.unpack(">II", read(own[b"tkhd"][1] - 8, 8)) if b"tkhd" in own else (0, 0)
            seconds, samples = _times(read, media[b"mdhd"][0]) if b"mdhd" in media else None, 0
            at: tuple[int, int] | None = media.get(b"minf")
            for part in (b"stbl", b"stts"):
                at = next(((x, y) for k, x, y in boxes(read, *at) if k == part), None) if at else None
            if at:
                table = read(at[0], at[1] - at[0])
                samples = sum(struct.unpack(">I", table[8 + 8 * k : 12 + 8 * k])[0] for k in range(struct.unpack(">I", table[4:8])[0]))
            found = (seconds, width >> 16, height >> 16, samples)
    if found is None:
        raise Unreadable("no video stream")
    seconds = found[0] or whole
    return {"duration_s": seconds, "width": found[1], "height": found[2], "fps": found[3] / seconds if seconds and found[3] else None, "n_streams": n}


def avi(read: Read, size: int) -> dict:
    at = 12
    while at + 12 <= min(size, 1 << 20):
        kind, length, form = struct.unpack("<4sI4s", read(at, 12))
        if kind == b"LIST" and form == b"hdrl":
            name, _, us, _, _, _, frames, _, streams, _, width, height = struct.unpack("<4sI10I", read(at + 12, 48))
            if name != b"avih" or not streams:
                break
            return {"duration_s": frames * us / 1e6 if frames and us else None, "width": width, "height": height, "fps": 1e6 / us if us else None, "n_streams": streams}
        at += 8 + length + length % 2
    raise Unreadable("no stream header")


def probed(read: Read, size: int) -> dict:
    head = read(0, 12)
    if len(head) < 12:
        raise Unreadable("too short for a recording")
    if head[:4] == b"RIFF" and head[8:] == b"AVI ":
        found = avi(read, size)
    elif head[4:8] in (b"ftyp", b"moov", b"mdat", b"free", b"wide", b"skip"):
        found = iso_media(read, size)
    else:
        raise Unreadable("no container that is known")
    if not found["duration_s"]:
        raise Unreadable("no duration")
    return found


def read_media(spark: SparkSession, path: str) -> DataFrame:
    """video (the file's name) and its metadata, or the error, of the recordings that a path or pattern names."""
    ship_package(spark)

    def probe(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            rows = []
            for name, size in zip(part["path"], part["length"], strict=True):
                row = {"video": posixpath.basename(name), "path": name, "size_bytes": size}
                try:
                    fs, at = pyarrow.fs.FileSystem.from_uri(re.sub(r"^(\w+):/(?!/)", r"\1:///", name))
                    with fs.open_input_file(at) as f:
                        row |= probed(lambda a, n, f=f: f.read_at(n, a), size)
                except (Unreadable, OSError, struct.error, IndexError) as e:
                    row["error"] = str(e) or type(e).__name__
                rows.append(row)
            columns = [x.split()[0] for x in MEDIA.split(", ")]
            yield pd.DataFrame(rows, columns=columns).astype({"width": "Int32", "height": "Int32", "n_streams": "Int32"})

    return spark.read.format("binaryFile").load(path).select("path", "length").mapInPandas(probe, MEDIA)
