"""Containers' headers, written by hand, against what the reader tells of them."""

import struct

from spanwright import config as C
from spanwright.plans import find
from spanwright.sources import media


def box(kind, body, wide=False):
    return (struct.pack(">I4sQ", 1, kind, len(body) + 16) if wide else struct.pack(">I4s", len(body) + 8, kind)) + body


def header(scale, length, version=0):
    times = struct.pack(">QQIQ", 0, 0, scale, length) if version else struct.pack(">IIII", 0, 0, scale, length)
    return bytes([version, 0, 0, 0]) + times + bytes(80)


def track(kind, scale, length, width, height, samples, version=0):
    hdlr = box(b"hdlr", bytes(8) + kind + bytes(12))
    stts = box(b"stts", bytes(4) + struct.pack(">I", len(samples)) + b"".join(struct.pack(">II", n, 1) for n in samples))
    tkhd = box(b"tkhd", bytes(76) + struct.pack(">II", width << 16, height << 16))
    return box(b"trak", tkhd + box(b"mdia", box(b"mdhd", header(scale, length, version)) + hdlr + box(b"minf", box(b"stbl", stts))))


def movie(*tracks, scale=1000, length=9_000, late=False, wide=False):
    ftyp, mdat = box(b"ftyp", b"isom" + bytes(4)), box(b"mdat", bytes(5_000), wide)
    moov = box(b"moov", box(b"mvhd", header(scale, length)) + b"".join(tracks))
    return ftyp + (mdat + moov if late else moov + mdat)


def avi_file(us, frames, streams=1):
    avih = struct.pack("<4sI10I", b"avih", 56, us, 0, 0, 0, frames, 0, streams, 0, 320, 240) + bytes(16)
    hdrl = struct.pack("<4sI4s", b"LIST", 4 + len(avih), b"hdrl") + avih
    return struct.pack("<4sI4s", b"RIFF", 4 + len(hdrl), b"AVI ") + hdrl


def test_media_metadata(spark, tmp_path):
    video, sound = track(b"vide", 600, 6_000, 1280, 720, [200, 50]), track(b"soun", 8_000, 80_000, 0, 0, [1])
    files = {
        "a.mp4": movie(sound, video),
        "late.mov": movie(track(b"vide", 600, 12_000, 640, 480, [100], version=1), late=True, wide=True),
        "container.mp4": movie(track(b"vide", 600, 0xFFFFFFFF, 64, 48, [])),
        "b.avi": avi_file(40_000, 500),
        "sound.mp4": movie(sound),
        "endless.avi": avi_file(40_000, 0),
        "short.mp4": b"abc",
        "text.mp4": b"this is no recording at all",
        "cut.mp4": movie(video)[:60],
        "none.mp4": b"",
    }
    for name, data in files.items():
        (tmp_path / name).write_bytes(data)
    got = {r.video: r for r in media.read_media(spark, str(tmp_path)).collect()}
    told = {n: (r.duration_s, r.width, r.height, r.fps, r.n_streams) for n, r in got.items() if r.error is None}
    assert told == {"a.mp4": (10.0, 1280, 720, 25.0, 2), "late.mov": (20.0, 640, 480, 5.0, 1), "container.mp4": (9.0, 64, 48, None, 1), "b.avi": (20.0, 320, 240, 25.0, 1)}
    assert {n: r.error for n, r in got.items() if n in ("sound.mp4", "endless.avi", "short.mp4", "text.mp4")} == {"sound.mp4": "no video stream", "endless.avi": "no duration", "short.mp4": "too short for a recording", "text.mp4": "no container that is known"}
    assert all(got[n].error and got[n].size_bytes == len(files[n]) for n in ("cut.mp4",)) and "none.mp4" not in got
    refused = {r.video: r.reason for r in find.media_violations(media.read_media(spark, str(tmp_path)), C.Config()).collect()}
    assert set(refused) == {n for n, r in got.items() if r.error} and set(refused.values()) == {"unreadable"}
