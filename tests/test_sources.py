import json
import struct
import wave

import numpy as np
import pytest

from cuewright.operators import audio as A
from cuewright.operators import evaluation as E
from cuewright.schema import truthy
from cuewright.sources import files, sinks


def test_transcripts(spark, tmp_path):
    d = tmp_path / "job_1"
    d.mkdir()
    (d / "t.json").write_text(json.dumps({"text": "a b", "words": [{"word": "a", "start": 0.1, "end": 0.2, "confidence": 0.5}, {"word": "b", "start": 1}]}))
    rows = files.transcripts(spark, str(tmp_path / "*" / "t.json")).orderBy("word_idx").collect()
    assert [(r["job_id"], r["word"], r["start_ms"], r["end_ms"], r["confidence"]) for r in rows] == [("job_1", "a", 100, 200, 0.5), ("job_1", "b", 1000, 0, None)]
    out = json.loads(sinks.transcript_json(files.transcripts(spark, str(tmp_path / "*" / "t.json"))).first()["json"])
    assert out["text"] == "a b" and out["words"][1] == {"word": "b", "start": 1.0, "end": 0.0, "confidence": None}


def test_captions_nested_or_flat(spark, tmp_path):
    d = tmp_path / "job_2"
    d.mkdir()
    (d / "c.json").write_text(json.dumps({"captions": [{"index": 1, "start": 0, "end": 1, "text": "x", "reading_speed": {"cps": 3.0, "wps": 1.0, "status": "OK"}}, {"index": 2, "start": 1, "end": 2, "text": "y", "cps": 4.0, "reading_status": "too_fast"}]}))
    rows = files.captions(spark, str(d / "c.json")).orderBy("caption").collect()
    assert [(r["cps"], r["reading_status"]) for r in rows] == [(3.0, "OK"), (4.0, "too_fast")]


def test_lists(spark, tmp_path):
    p = tmp_path / "w.txt"
    p.write_text("# note\nDarn!\tmild\nvile # x\nodd\tfierce\n\n")
    assert [tuple(r) for r in files.lexicon_list(spark, str(p)).collect()] == [("darn", "mild"), ("vile", "strong"), ("odd", "strong")]
    v = tmp_path / "v.txt"
    v.write_text("Oslo\tlocations\nBingo\tnothing\n")
    assert [tuple(r) for r in files.vocabulary_list(spark, str(v), ["locations"]).collect()] == [("Oslo", "locations"), ("Bingo", "other")]


def test_corrections(spark, tmp_path):
    p = tmp_path / "c.json"
    p.write_text(json.dumps({"confusions": {"Vile": ["Vial"]}, "collocations": {"Really|Idea": ["good", "bad"]}}))
    rows = sorted(tuple(r) for r in files.corrections(spark, str(p)).collect())
    assert rows == [("collocations", "really|idea", 0, "good"), ("collocations", "really|idea", 1, "bad"), ("confusions", "vile", 0, "vial")]


def test_srt_file(spark, tmp_path):
    d = tmp_path / "job_3"
    d.mkdir()
    (d / "a.srt").write_text("1\n00:00:00,000 --> 00:00:01,000\nhi\n\nbroken\n\n00:00:02.5 --> 00:00:03,000\nno number\n")
    rows = files.srt(spark, str(d / "a.srt")).orderBy("position").collect()
    assert [(r["job_id"], r["start_ms"], r["text"]) for r in rows] == [("job_3", 0, "hi"), ("job_3", 2500, "no number")]


def test_clip_words_from_text(spark, tmp_path):
    p = tmp_path / "clip.json"
    p.write_text(json.dumps({"id": "x", "reference": {"text": "a b"}, "hypothesis": {"text": "a c"}}))
    r = files.clips(spark, str(p)).first()
    assert [(w["word"], round(w["start"], 2), w["confidence"]) for w in r["words"]] == [("a", 0.0, 0.9), ("c", 0.3, 0.9)]


def test_newest_stage(spark):
    df = spark.createDataFrame([("j", "words", "w"), ("j", "punctuated", "p"), ("k", "words", "w2")], "job_id string, stage string, path string")
    assert sorted(tuple(r) for r in files.newest_stage(df, ["annotated", "punctuated", "words"]).collect()) == [("j", "punctuated", "p"), ("k", "words", "w2")]


def test_alignment_prefers_the_diagonal():
    assert E.edit_distance(list("kitten"), list("sitting")) == 3 and E.edit_distance([], ["a"]) == 1 and E.edit_distance(["a"], []) == 1
    assert E.alignment(list("abc"), list("axc")) == [(0, 0), (1, 1), (2, 2)]
    assert E.alignment(list("ab"), list("b")) == [(1, 0)]


def test_error_rates(spark):
    df = spark.createDataFrame([(1, "The cat sat", "the bat"), (2, "", "x")], "id long, reference string, hypothesis string")
    rows = {r["id"]: r for r in E.error_rates(df).collect()}
    assert (rows[1]["distance"], rows[1]["wer"], rows[2]["wer"]) == (2, 0.6667, 1.0)


def test_artifact_folders(spark, tmp_path):
    rows = spark.createDataFrame([("j1", '{"a": 1}', "x"), ("j2", "two\nlines", "y")], "job_id string, json string, other string")
    sinks.write_artifact(rows, str(tmp_path / "out"), "json")
    back = files.payload_files(spark, str(tmp_path / "out" / "*")).collect()
    assert sorted((r["job_id"], r["json"].strip()) for r in back) == [("job_id=j1", '{"a": 1}'), ("job_id=j2", "two\nlines")]


def test_evaluation_json(spark):
    scores = spark.createDataFrame([("full", "b", 0.5), ("full", "a", None), ("raw", "a", 0.25)], "config string, clip string, wer double")
    summary = spark.createDataFrame([("full", 2, 0.5), ("raw", 1, 0.25)], "config string, clips long, wer double")
    got = {r["config"]: json.loads(r["json"]) for r in sinks.evaluation_json(scores, summary, "stub").collect()}
    assert got["full"]["model"] == "stub" and got["full"]["summary"] == {"clips": 2, "wer": 0.5}
    assert [c["id"] for c in got["full"]["clips"]] == ["a", "b"] and got["full"]["clips"][1]["metrics"] == {"wer": 0.5}
    assert got["raw"]["disclaimer"] == sinks.DISCLAIMER and got["raw"]["note"]


def test_job_files(spark, tmp_path):
    for name, text in (("job_2", json.dumps({"job_id": "named", "status": "QUEUED", "duration": 3.5})), ("job_1", json.dumps({"status": "FAILED"})), ("job_3", "no json")):
        (tmp_path / name).mkdir()
        (tmp_path / name / "job.json").write_text(text)
    rows = files.jobs(spark, str(tmp_path / "*" / "job.json"))
    assert sorted((r["job_id"], r["status"], r["duration"]) for r in rows.collect()) == [("job_1", "FAILED", None), ("job_3", None, None), ("named", "QUEUED", 3.5)]
    assert [r["job_id"] for r in files.newest_jobs(rows, 2).collect()] == ["named", "job_3"] and files.job_row(rows, "job_1").count() == 1


def test_clip_tables(spark, tmp_path):
    p = tmp_path / "clip.json"
    p.write_text(json.dumps({"id": "x", "reference": {"text": "a b", "words": [{"word": "a", "start": 0.5, "end": 0.75}]}, "words": [{"word": "a"}, {"word": "c", "start": 1.0, "end": 1.2}], "gold_clean": ["b"]}))
    words, clips, reference = files.clip_tables(files.clips(spark, str(p)))
    assert [(r["job_id"], r["word_idx"], r["word"], r["start_ms"], r["end_ms"]) for r in words.orderBy("word_idx").collect()] == [("x", 0, "a", 0, 0), ("x", 1, "c", 1000, 1200)]
    assert [(r["word"], r["start_ms"], r["end_ms"]) for r in reference.collect()] == [("a", 500, 750)]
    assert [(r["job_id"], r["reference"], r["profane"], r["clean"]) for r in clips.collect()] == [("x", "a b", [], ["b"])]


def test_booleans_of_texts():
    assert [truthy(x) for x in (" Yes ", "1", "on", "TRUE", "no", "", None, "2")] == [True] * 4 + [False] * 4
