import itertools
import json
import random
import struct
import time
import wave

import pytest
from pyspark.sql import functions as F

from cuewright import schema
from cuewright.functions import text as X
from cuewright.operators import audio as A
from cuewright.operators import captions as C
from cuewright.operators import evaluation as E
from cuewright.operators import recognition, review
from cuewright.operators import safety as S
from cuewright.operators import words as W
from cuewright.sources import files, sinks


def write_wav(path, samples, rate=16000, channels=1, width=2):
    with wave.open(str(path), "wb") as w:
        w.setnchannels(channels)
        w.setsampwidth(width)
        w.setframerate(rate)
        w.writeframes(struct.pack(f"<{len(samples)}{'h' if width == 2 else 'B'}", *samples))
    return str(path)


def tone(n, hz=220, high=12000, rate=16000):
    import math

    return [int(high * math.sin(2 * math.pi * hz * i / rate)) for i in range(n)]


def test_wav_faults(spark, tmp_path):
    d = tmp_path / "w"
    d.mkdir()
    write_wav(d / "good.wav", [0] * 16000)
    write_wav(d / "stereo.wav", [0] * 320, channels=2)
    write_wav(d / "slow.wav", [0] * 320, rate=8000)
    write_wav(d / "bytes.wav", [128] * 320, width=1)
    write_wav(d / "none.wav", [])
    (d / "text.wav").write_text("no audio")
    got = {r["path"].rsplit("/", 1)[1]: (r["fault"], r["duration_s"]) for r in A.wav_faults(files.audio(spark, str(d))).collect()}
    assert got["good.wav"] == (None, 1.0)
    assert {k: v[0] for k, v in got.items() if k != "good.wav"} == {"stereo.wav": "not mono", "slow.wav": "not 16 kHz", "bytes.wav": "not 16 bit", "none.wav": "empty", "text.wav": "unreadable"}


def test_decoding_averages_channels_and_centres_bytes(tmp_path):
    two, one = write_wav(tmp_path / "a.wav", [16384, 0, -16384, -16384], channels=2), write_wav(tmp_path / "b.wav", [0, 128, 192], width=1)
    assert A.decode_wav(open(two, "rb").read())[0].tolist() == [0.25, -0.5]
    assert A.decode_wav(open(one, "rb").read())[0].tolist() == [-1.0, 0.0, 0.5]
    with pytest.raises(ValueError):
        A.wav_header(b"RIFF....WAVEdata\0\0\0\0")


def test_speech_and_noise(spark, tmp_path):
    silent, burst = write_wav(tmp_path / "s.wav", [0] * 16000), write_wav(tmp_path / "b.wav", [0] * 9600 + tone(6400) + [0] * 8000)
    frames = A.frames(files.audio(spark, [silent, burst]))
    spoken = spark.createDataFrame([], "path string, frame int")
    noise = A.noise_events(frames, spoken).collect()
    assert [(r["path"][-5:], r["label"], r["start_ms"], r["end_ms"]) for r in noise] == [("b.wav", "[background noise]", 600, 1000)] and noise[0]["confidence"] > 0.8
    speech = A.speech_regions(frames).collect()
    assert [(r["path"][-5:], r["start_ms"], r["end_ms"]) for r in speech] == [("b.wav", 600, 1000)]
    words = frames.where("frame = 0").select("path", F.lit(500).alias("start_ms"), F.lit(1100).alias("end_ms"))
    assert A.noise_events(frames, A.frames_in_speech(frames, words)).count() == 0
    # where most of a file is loud, nothing is three times its median
    loud = write_wav(tmp_path / "l.wav", [0] * 4000 + tone(12000))
    assert A.speech_regions(A.frames(files.audio(spark, loud))).count() == 0
    tiny = write_wav(tmp_path / "t.wav", [0] * 100)
    assert A.speech_regions(A.frames(files.audio(spark, tiny))).count() == 1


def test_diarize(spark, tmp_path):
    gap = [0] * 32000
    path = write_wav(tmp_path / "d.wav", tone(4000) + gap + tone(4000, 220, 11000) + gap + tone(4000, 1800, 3000))
    got = A.diarize(files.audio(spark, path)).orderBy("start_ms").collect()
    # the second turn repeats the first's cluster after a long pause and flips, and so the third follows it
    assert [r["label"] for r in got] == ["Speaker 1", "Speaker 2", "Speaker 1"]
    turns = spark.createDataFrame([(got[0]["path"], "1", "Speaker 1", 0, 250), (got[0]["path"], "2", "Speaker 2", 2250, 2500), (got[0]["path"], "1", "Speaker 1", 4500, 4750)], "path string, speaker string, label string, start_ms long, end_ms long")
    assert [r["speaker"] for r in A.label_turns(files.audio(spark, path), turns).orderBy("start_ms").collect()] == ["1", "1", "2"]


def test_clusters_are_those_of_a_plain_loop(spark):
    rnd = random.Random(4)
    rows = [(j, 10 * i, 10 * i + 5, rnd.gauss(i % 2 * 2, 1), rnd.random()) for j in range(5) for i in range(j * 3 + 1)]
    got = {(r["job_id"], r["start_ms"]): r["label"] for r in A.cluster_turns(spark.createDataFrame(rows, "job_id long, start_ms long, end_ms long, log_rms double, zcr double")).collect()}
    for j in range(5):
        own = [r for r in rows if r[0] == j]
        x = [(r[3], r[4]) for r in own]
        centres, label = [x[0], x[-1]], []
        for _ in range(8):
            label = [2 if sum((a - b) ** 2 for a, b in zip(p, centres[1], strict=True)) < sum((a - b) ** 2 for a, b in zip(p, centres[0], strict=True)) else 1 for p in x]
            for k in (1, 2):
                mine = [p for p, v in zip(x, label, strict=True) if v == k]
                if mine:
                    centres[k - 1] = tuple(sum(c) / len(mine) for c in zip(*mine, strict=True))
        assert [got[j, r[1]] for r in own] == label


def test_recognizers(spark):
    with pytest.raises(ValueError, match="even_stub"):
        recognition.recognizer("other")
    clips = spark.createDataFrame([("j", "a b c d", 4.0)], "job_id string, text string, duration_s double")
    got = recognition.transcribe(clips).orderBy("word_idx").collect()
    assert [(r["word"], r["start_ms"], r["end_ms"], r["confidence"]) for r in got][::3] == [("a", 0, 1000, None), ("d", 3000, 4000, None)]


def test_evaluation_set(spark, tmp_path):
    (tmp_path / "one.json").write_text(json.dumps({"reference_text": "Hello there", "hypothesis": {"text": "hello bear"}, "gold_profane": ["bear"]}))
    (tmp_path / "manifest.json").write_text(json.dumps({"clips": ["one.json", {"reference": {"text": "x"}, "words": [{"word": "x", "start": 1.0, "end": 2.0}]}]}))
    got = {r["id"]: r for r in files.evaluation_set(spark, str(tmp_path)).collect()}
    assert set(got) == {"one", "clip_2"}
    assert [(w["word"], w["confidence"]) for w in got["one"]["words"]] == [("hello", 0.9), ("bear", 0.9)] and got["one"]["profane"] == ["bear"]
    assert got["clip_2"]["words"][0]["end"] == 2.0 and got["clip_2"]["corrections"] == []
    assert files.evaluation_set(spark, str(tmp_path / "one.json")).count() == 1
    (tmp_path / "manifest.json").write_text("{}")
    with pytest.raises(ValueError):
        files.evaluation_set(spark, str(tmp_path))


def test_lexicon_files(spark, tmp_path):
    for name, text in (("w.txt", "Moron\nheck\tmild # soft\n"), ("p.txt", "shut  UP\n"), ("a.txt", "Bass\n"), ("b.txt", "bass\nEssex\n"), ("c.json", json.dumps({"confusions": {"Moron": ["More", "moon"]}, "collocations": {"The|": ["Then"]}}))):
        (tmp_path / name).write_text(text)
    at = lambda n: str(tmp_path / n)
    got = files.lexicon(spark, [at("w.txt")], [at("p.txt")], [at("a.txt"), at("b.txt")], at("c.json"), ("Extra!",), ("Ann", "ann"))
    rows = lambda df: {tuple(r) for r in df.collect()}
    assert rows(got.words) == {("moron", "strong"), ("heck", "mild")} and rows(got.phrases) == {("shut up", "strong")}
    assert rows(got.allowed(spark)) == {("bass",), ("essex",), ("extra",)} and rows(got.vocabulary) == {("ann",)}
    assert rows(got.confusions) == {("moron", 0, "more"), ("moron", 1, "moon")} and rows(got.collocations) == {("the|", 0, "then")}
    assert [(r["cand"], r["allowed"]) for r in got.known(spark).orderBy("ord").collect()] == [("ann", False), ("bass", True), ("essex", True), ("extra", True)]
    again = files.lexicon(spark, [at("w.txt"), at("a.txt")], corrections_path=None)
    assert rows(again.words) == {("moron", "strong"), ("heck", "mild"), ("bass", "strong")} and not rows(again.phrases) and not rows(again.confusions)


def test_settings():
    s = schema.settings_from({"MAX_CPS": "20", "PAUSE_GAP": "0.75", "SAFETY_MODE": "review", "MAX_WPS": " "})
    assert (s.max_cps, s.pause_gap_ms, s.safety_mode, s.max_wps) == (20.0, 750, "review-only", 4.0)
    assert schema.creator_settings(None) == {"safety_mode": "strict", "unknown_profanity": "censor", "enable_sound_events": False, "enable_speaker_labels": True}


def test_alignment_is_that_of_the_whole_table():
    rnd = random.Random(7)
    for _ in range(300):
        a, b = ([rnd.choice("abc") for _ in range(rnd.randrange(9))] for _ in "ab")
        d = [[max(i, j) if not i or not j else 0 for j in range(len(b) + 1)] for i in range(len(a) + 1)]
        for i, j in itertools.product(range(1, len(a) + 1), range(1, len(b) + 1)):
            d[i][j] = min(d[i - 1][j] + 1, d[i][j - 1] + 1, d[i - 1][j - 1] + (a[i - 1] != b[j - 1]))
        i, j, pairs = len(a), len(b), []
        while i and j:
            if d[i][j] == d[i - 1][j - 1] + (a[i - 1] != b[j - 1]):
                i, j = i - 1, j - 1
                pairs.append((i, j))
            elif d[i][j] == d[i - 1][j] + 1:
                i -= 1
            else:
                j -= 1
        assert E.alignment(a, b) == pairs[::-1] and E.edit_distance(a, b) == d[-1][-1]


def test_alignment_of_long_texts_follows_the_errors():
    rnd = random.Random(9)
    a = [f"w{rnd.randrange(3000)}" for _ in range(100_000)]
    b = [x for x in a if rnd.random() > 0.004]
    for at in rnd.sample(range(len(b)), 400):
        b[at] += "x"
    began = time.time()
    pairs = E.alignment(a, b)
    assert time.time() - began < 60 and E.edit_distance(a, b) == len(a) - len(b) + 400
    assert len(pairs) == len(b) and sum(a[i] != b[j] for i, j in pairs) == 400
    assert E.alignment([], a) == E.alignment(a, []) == [] and E.edit_distance(a, []) == len(a)


def test_bands_agree_with_the_whole_table(monkeypatch):
    rnd, pairs = random.Random(10), []
    for _ in range(60):
        a = [rnd.choice("ab") for _ in range(rnd.randrange(120))]
        b = [rnd.choice("abc") for _ in range(rnd.randrange(120))] if rnd.random() < 0.5 else [x for x in a if rnd.random() > 0.2]
        pairs.append((a, b, E.alignment(a, b), E.edit_distance(a, b)))

    def whole(left, right, every=0):
        band = E._Band(left, right, max(len(left), len(right)))
        return band, *band.last(every)

    monkeypatch.setattr(E, "_proven", whole)
    assert all((E.alignment(a, b), E.edit_distance(a, b)) == (p, d) for a, b, p, d in pairs)


def test_similar_terms_are_those_of_all_pairs(spark):
    rnd = random.Random(3)
    terms = sorted({"".join(rnd.choice("abst1") for _ in range(rnd.randrange(1, 9))) for _ in range(120)})
    tokens, known = spark.createDataFrame([(t,) for t in terms[::2]], "token string"), spark.createDataFrame([(t, i, False) for i, t in enumerate(terms[1::2])], "cand string, ord int, allowed boolean")
    want = tokens.crossJoin(known).where(X.phonetic_similarity(F.col("token"), F.col("cand")) >= 0.72)
    key = lambda df: sorted((r["token"], r["cand"]) for r in df.collect())
    assert key(S.similar_terms(tokens, known)) == key(want) != []


def test_low_words_flag_their_caption(make_words):
    words = C.assign_cues(make_words([("one", 0, 900, 0.95), ("two", 1000, 1900, 0.95), ("three.", 2000, 2900, 0.95), ("Four", 5000, 5900, 0.2), ("five.", 6000, 6900, 0.4)]))
    plain = C.repair_density(words).orderBy("caption").collect()
    assert [(r["mean_confidence"], r["confidence_band"], r["flags"]) for r in plain] == [(0.95, "high", []), (0.3, "low", ["low_confidence"])]
    records = W.confidence_records(words.withColumn("confidence", F.when(F.col("word") == "two", 0.1).otherwise(F.col("confidence"))))
    noted = C.repair_density(C.annotate_confidence(words, records)).orderBy("caption").first()
    assert noted["flags"] == ["low_confidence"] and noted["mean_confidence"] == 0.6667


def test_ablation_configurations(spark, make_words):
    words = make_words([("the", 0, 300, 0.9), ("moron", 400, 900, 0.5), ("fluffernodle", 1000, 2000, 0.5)])
    clips = spark.createDataFrame([(1, "the moon fluffernoddle", ["moron"], ["the"], [("moron", "moon")])], "job_id long, reference string, profane array<string>, clean array<string>, corrections array<struct<from: string, to: string>>")
    lexicon = S.Lexicon(words={"moron": "strong"}, confusions={"moron": ["moon"]}, collocations={"the|fluffernoddle": ["moon"], "the|": ["moon"]})
    terms = spark.createDataFrame([("fluffernoddle", 0)], "term string, ord int")
    none = words.limit(0)
    got = {r["config"]: r for r in E.clip_scores(words, clips, none, lexicon, terms).collect()}
    assert {k: r["distance"] for k, r in got.items()} == {"asr_only": 2, "asr_punctuation": 2, "asr_profanity": 2, "asr_correction": 0, "asr_profanity_correction": 0, "full_pipeline": 0}
    assert {k: r["censorship_rate"] for k, r in got.items() if r["censorship_rate"]} == {"asr_profanity": 0.3333}
    assert {k: r["profanity_false_negative_rate"] for k, r in got.items() if r["profanity_false_negative_rate"]} == {"asr_only": 1.0, "asr_punctuation": 1.0}
    assert {k for k, r in got.items() if r["correction_accuracy"] == 1.0} == {"asr_correction", "asr_profanity_correction", "full_pipeline"}
    assert all(r["within_200ms"] == 1.0 and r["caption_count"] >= 1 for r in got.values())
    summary = E.rollup(E.clip_scores(words, clips, none, lexicon, terms), "config")
    text = E.report_text(summary, "m", "1").first()["report"]
    assert text.startswith(f"Caption evaluation\nModel: m\nPipeline version: 1\n{X.NOTE}\n{X.DISCLAIMER}\n\n[asr_only]") and "[full_pipeline]\nWER: 0.0000\n" in text and text.index("[asr_only]") < text.index("[full_pipeline]")


def test_reports(spark):
    jobs = spark.createDataFrame([("a", "strict", "censor"), ("b", None, None)], "job_id string, mode string, unknown_profanity string")
    made = spark.createDataFrame([("a", 3, "x|y", "_", "C", "censor", True, "r")], "job_id string, word_idx long, original string, replacement string, case string, action string, needs_review boolean, reason string")
    got = {r["job_id"]: r["report"] for r in sinks.correction_report(jobs, made).collect()}
    assert "| x/y | _ | C | censor | yes | r |" in got["a"].split("\n") and "Mode: strict" in got["a"]
    assert sinks.REPORT_NONE in got["b"] and "Mode: unknown" in got["b"]
    assert sinks.allowlist_text(spark.createDataFrame([], "term string")).first()["text"] == "Allowlist (0 words): (empty)"


def test_captions_json(spark, make_words):
    words = C.assign_cues(make_words([("One", 0, 900, 0.9), ("two.", 1000, 1900, None)])).withColumn("caption", F.col("cue"))
    data = json.loads(sinks.captions_json(C.repair_density(words), words).first()["json"])
    one = data["captions"][0]
    assert data["summary"]["caption_count"] == 1 and one["lines"] == ["One two."] and one["reading_speed"]["status"] == "OK"
    assert one["words"] == [{"word": "One", "start": 0.0, "end": 0.9, "confidence": 0.9}, {"word": "two.", "start": 1.0, "end": 1.9, "confidence": None}]


def test_frame_rate_and_aligner(spark):
    df = spark.createDataFrame([("30000/1001",), ("0/0",), ("25",), ("x/1",)], "c string").select(files.frame_rate(F.col("c")).alias("r"))
    assert [None if r["r"] is None else round(r["r"], 2) for r in df.collect()] == [29.97, None, 25.0, None]
    stamps = spark.createDataFrame([(1, "hi", None, 0.5, 1.0, None), (1, None, None, 1.0, 2.0, 0.5)], "job_id int, text string, word string, start_time double, end_time double, confidence double")
    assert [(r["word"], r["confidence"]) for r in files.aligned_words(stamps).collect()] == [("hi", 1.0)]
    stamps = spark.createDataFrame([(1, "", " ho ", 0.5, 1.0), (1, "  ", "x", 1.0, 2.0), (1, None, None, 1.0, 2.0)], "job_id int, text string, word string, start double, end double")
    assert [r["word"] for r in files.aligned_words(stamps).collect()] == ["ho"]


def test_aligner_payloads(spark):
    one = {"text": "a", "start": 0, "end": "1.5"}
    payloads = [
        json.dumps([one, {"word": " b\n", "start_time": 1, "end_time": 2, "confidence": 0.5}, {"text": "", "word": "c", "start": 2, "end": 3}]),
        json.dumps({"items": [one, {"text": "  ", "word": "x", "start": 0, "end": 1}, {"text": "y", "start_time": None, "start": 1, "end": 2}, {"text": "z", "start": 1}, {"text": "d", "start": "3", "end": 4, "confidence": None}]}),
        json.dumps(one), "[]", "null", "not json", None, "7", json.dumps({"items": []}), json.dumps([None, one]),
    ]
    got = files.aligner_payloads(spark.createDataFrame(list(enumerate(payloads)), "job_id int, json string")).orderBy("job_id", "word_idx").collect()
    a = ("a", 0.0, 1.5, 1.0)
    assert [tuple(r) for r in got] == [(0, 0, *a), (0, 1, "b", 1.0, 2.0, 0.5), (0, 2, "c", 2.0, 3.0, 1.0), (1, 0, *a), (1, 1, "d", 3.0, 4.0, 1.0), (2, 0, *a), (9, 0, *a)]


def test_maps_and_settings_of_jobs(spark, tmp_path):
    for job, name, text in (("j1", "speaker_map.json", '{"1": "Ann", "2": " ", "Speaker 3": 7}'), ("j2", "speaker_map.json", "[]"), ("j3", "speaker_map.json", "{"), ("j1", "settings.json", '{"safety_mode": "Literal", "unknown_profanity": "keep"}'), ("j2", "settings.json", "7")):
        (tmp_path / job).mkdir(exist_ok=True)
        (tmp_path / job / name).write_text(text)
    names = files.speaker_names(files.payload_files(spark, f"{tmp_path}/*/speaker_map.json"))
    assert sorted(map(tuple, names.collect())) == [("j1", "1", "Ann"), ("j1", "Speaker 3", "7")]
    chosen = files.creator_choices(files.payload_files(spark, f"{tmp_path}/*/settings.json")).orderBy("job_id").collect()
    assert [tuple(r) for r in chosen] == [("j1", "review-only", "keep", False, True), ("j2", "strict", "censor", False, True)]


def test_imported_vocabulary_keeps_removed_terms(spark):
    from cuewright.operators import vocabulary as V

    payloads = ['{"entries": ["Ann", {"term": "Bo", "category": "people"}, {"term": null}, 7], "terms": ["Cy", "Bo", null, " "], "grouped": {"toys": ["Ann"], "games": ["Di"], "x": null}, "removed": ["Cy", "zed", "CY!"]}', "broken", None, '{"terms": ["Ed"], "removed": ["abe"]}']
    table = spark.createDataFrame(list(enumerate(payloads)), "ord int, json string")
    log = V.imported(table)
    assert [r["seq"] for r in log.orderBy("seq").collect()] == list(range(1, 9)) and {r["action"] for r in log.collect()} == {"add"}
    entries = {r["key"]: (r["term"], r["category"]) for r in V.replay(log)[0].collect()}
    assert entries == {"ann": ("Ann", "toys"), "bo": ("Bo", "other"), "7": ("7", "other"), "cy": ("Cy", "other"), "di": ("Di", "games"), "ed": ("Ed", "other")}
    assert [tuple(r) for r in V.removed_terms(table).orderBy("position").collect()] == [("abe", 1), ("cy", 2), ("zed", 3)]


def test_status_kinds(spark):
    df = spark.createDataFrame([("QUEUED",), ("EXPORTED",), ("CANCELLED",), ("x",), (None,)], "s string").select(review.status_kind(F.col("s")).alias("k"))
    assert [r["k"] for r in df.collect()] == ["busy", "review", "ended", None, None]