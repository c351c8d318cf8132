import random
import struct
import wave

import pytest

from cuewright.operators import audio as A
from cuewright.sources import files, wav


def write(path, samples, rate=16000, channels=1, width=2):
    with wave.open(str(path), "wb") as w:
        w.setnchannels(channels)
        w.setsampwidth(width)
        w.setframerate(rate)
        w.writeframes(struct.pack(f"<{len(samples)}{'h' if width == 2 else 'B'}", *samples))
    return str(path)


@pytest.fixture()
def folder(tmp_path):
    rnd = random.Random(5)
    d = tmp_path / "some folder"
    d.mkdir()
    write(d / "long.wav", [rnd.randint(-9000, 9000) if i // 8000 % 3 == 1 else rnd.randint(-90, 90) for i in range(100_123)])
    write(d / "two.wav", [rnd.randint(-9000, 9000) for _ in range(7_000)], rate=8000, channels=2)
    write(d / "bytes.wav", [rnd.randint(0, 255) for _ in range(5_000)], width=1)
    write(d / "short.wav", [100] * 50)
    return d


def test_frames_are_equal_at_every_split(spark, folder):
    want = sorted(tuple(r) for r in A.frames(files.audio(spark, str(folder))).collect())
    for size in (1, 700, 4_096, 1 << 20):
        got = sorted(tuple(r) for r in wav.frames(wav.heads(spark, str(folder)), range_bytes=size, tasks=3).collect())
        assert got == want, size
    assert ("short.wav", float("inf")) in {(r[0].rsplit("/", 1)[1], r[2]) for r in want}


def test_turns_are_equal_at_every_split(spark, folder):
    paths = [r["path"] for r in wav.heads(spark, str(folder)).select("path").collect()]
    turns = spark.createDataFrame([(p, a, b) for p in paths for a, b in ((0, 10), (100, 300), (0, 6_000), (5_900, 9_000), (90_000, 90_100))], "path string, start_ms long, end_ms long")
    key = lambda r: (r["path"], r["start_ms"], r["end_ms"])
    want = {key(r): r for r in A.turn_features(files.audio(spark, str(folder)), turns).collect()}
    for size in (64, 5_000, 1 << 20):
        got = {key(r): r for r in wav.turn_features(wav.heads(spark, str(folder)), turns, range_bytes=size).collect()}
        assert got.keys() == want.keys()
        for k, r in want.items():
            assert got[k]["log_rms"] == pytest.approx(r["log_rms"], rel=1e-4), (size, k)
            assert got[k]["zcr"] == pytest.approx(r["zcr"], rel=1e-5), (size, k)


def test_speakers_from_ranges(spark, folder):
    whole = A.diarize(files.audio(spark, str(folder / "long.wav"))).orderBy("start_ms").collect()
    ranged = A.diarize(wav.heads(spark, str(folder / "long.wav")), frames_of=wav.frames, features_of=wav.turn_features).orderBy("start_ms").collect()
    assert [r["start_ms"] for r in whole] and ranged == whole


def test_faulty_files_are_rejected(spark, tmp_path):
    write(tmp_path / "good.wav", [0] * 640)
    write(tmp_path / "none.wav", [])
    (tmp_path / "text.wav").write_text("no audio")
    raw = bytearray((tmp_path / "good.wav").read_bytes())
    (tmp_path / "cut.wav").write_bytes(raw[:20])
    raw[34:36] = struct.pack("<H", 24)
    (tmp_path / "deep.wav").write_bytes(raw)
    found = wav.heads(spark, str(tmp_path))
    name = lambda r: r["path"].rsplit("/", 1)[1]
    assert {name(r): r["fault"] for r in wav.rejected(found).collect()} == {"none.wav": "empty", "text.wav": "unreadable", "cut.wav": "unreadable", "deep.wav": "unsupported width"}
    assert {name(r) for r in wav.frames(found).collect()} == {"good.wav"}
    assert wav.frames(found.where("false")).count() == 0


def test_a_head_behind_a_long_chunk_is_found_without_reading_it(spark, tmp_path):
    """A file of more than 2 GB, most of it a hole: one value can't hold it."""
    path = tmp_path / "huge.wav"
    plain = open(write(tmp_path / "plain.wav", [500, -500] * 1600), "rb").read()
    gap = (1 << 31) + 10
    with open(path, "wb") as f:
        f.write(plain[:12] + b"junk" + struct.pack("<I", gap))
        f.seek(gap, 1)
        f.write(plain[12:])
    got = wav.frames(wav.heads(spark, str(path))).orderBy("frame").collect()
    assert [r["frame"] for r in got] == list(range(10)) and got[0]["rms"] == pytest.approx(500 / 32768, rel=1e-4)
