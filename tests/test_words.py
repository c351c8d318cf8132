import random

from pyspark.sql import functions as F

from cuewright.functions import text as X
from cuewright.operators import words as W


def texts(df):
    return [r["word"] for r in df.orderBy("word_idx").collect()]


def test_greeting_stands_alone(make_words):
    out = W.punctuate(make_words("hey guys today we're going to build a castle".split()))
    assert " ".join(texts(out)) == "Hey guys! Today we're going to build a castle."


def test_pause_splits_and_questions(make_words):
    items = [("look", 0, 200), ("at", 200, 400), ("that", 400, 600), ("isn't", 1300, 1500), ("he", 1500, 1700), ("huge", 1700, 1900)]
    assert " ".join(texts(W.punctuate(make_words(items)))) == "Look at that. Isn't he huge?"


def test_bands(spark):
    df = spark.createDataFrame([(x,) for x in (1.0, 0.9, 0.89, 0.7, 0.69, 0.0)], "c double")
    assert [r[0] for r in df.select(X.band(F.col("c"))).collect()] == ["high", "high", "medium", "medium", "low", "low"]


def test_unknown_confidence(make_words):
    r = W.confidence_records(make_words([("a", 0, 1, None), ("b", 1, 2, 0.95)])).orderBy("word_idx").collect()
    assert [(x["asr_confidence"], x["band"]) for x in r] == [(0.5, "low"), (0.95, "high")]


def test_turns_alternate(make_words):
    rows = W.pause_turns(make_words([("a", 0, 300), ("b", 2500, 2800)])).orderBy("turn").collect()
    assert [r["speaker"] for r in rows] == ["1", "2"]


def test_events_strictly_above_threshold(spark):
    e = spark.createDataFrame([(1, " [Door  Slam] ", 0, 500, 0.79), (1, "bang", 600, 900, 0.81), (1, "", 0, 9, 0.99), (1, "x", 5, 5, 0.99)], "job_id long, label string, start_ms long, end_ms long, confidence double")
    assert [r["label"] for r in W.filter_events(e).collect()] == ["[bang]"]


def test_events_never_over_speech(spark, make_words):
    words = make_words([("a", 0, 500), ("b", 2000, 2500)])
    e = spark.createDataFrame([(1, "[x]", 100, 300, 0.9), (1, "[y]", 600, 900, 0.9), (1, "[z]", 650, 700, 0.9)], "job_id long, label string, start_ms long, end_ms long, confidence double")
    placed = W.place_events(W.events_in_silence(e, words)).collect()
    assert [(r["label"], r["start_ms"], r["end_ms"]) for r in placed] == [("[y]", 600, 900)]


def test_last_covering_then_nearest_segment(spark, make_words):
    words = make_words([("a", 0, 200), ("b", 900, 1100), ("c", 5000, 5200)])
    seg = spark.createDataFrame([(1, 0, "A", 0, 400), (1, 1, "B", 50, 300), (1, 2, "C", 4000, 4500)], "job_id long, seg_idx int, speaker string, start_ms long, end_ms long")
    out = W.speaker_at(words, seg).orderBy("word_idx").collect()
    assert [r["speaker"] for r in out] == ["B", "A", "C"]


def test_even_spacing_ends_at_duration(spark):
    df = spark.createDataFrame([(1, "a b c d")], "job_id long, text string")
    r = W.even_spacing(df, F.lit(4.0)).orderBy("word_idx").collect()
    assert (r[0]["start_s"], r[-1]["end_s"], len(r)) == (0.0, 4.0, 4)


def test_timecodes(spark):
    df = spark.createDataFrame([(0,), (10100,), (12900,), (3723456,), (-1,)], "t long")
    assert [r[0] for r in df.select(X.format_timecode(F.col("t"))).collect()] == ["00:00:00,000", "00:00:10,100", "00:00:12,900", "01:02:03,456", "00:00:00,000"]
    back = spark.createDataFrame([("01:02:03.4",), ("01:02:03,45",)], "c string")
    assert [r[0] for r in back.select(X.parse_timecode(F.col("c"))).collect()] == [3723400, 3723450]


def test_soundex_never_resets_at_vowels(spark):
    df = spark.createDataFrame([("jackson",), ("robert",), ("",), ("tymczak",)], "w string")
    assert [r[0] for r in df.select(X.soundex(F.col("w"))).collect()] == ["J500", "R163", "", "T520"]


def merged_by_hand(words, events, slack=1, least=200):
    """Event by event, each against the list so far (times in ms)."""
    merged = [(w, s, e, i) for i, (w, s, e) in enumerate(words)]
    for label, start, end, _ in sorted(events, key=lambda x: (x[1], x[2], x[0], x[3])):
        at, clash = len(merged), False
        for i, (_, s, e, _) in enumerate(merged):
            if e <= start + slack:
                at = i + 1
            elif s >= end - slack:
                at = i
                break
            else:
                clash = True
                break
        if not clash:
            merged.insert(at, (label, start, max(end, start + least), None))
    return merged


def test_events_become_words(spark):
    r = random.Random(4)
    jobs_w, jobs_e, want = [], [], {}
    for job in range(60):
        t, words = 0, []
        for i in range(r.randint(0, 12)):
            t += r.choice([0, 0, 150, 400, 900, -120])
            words.append((f"w{i}", t, t + r.choice([50, 300])))
            t += 300
        events = [(f"[{r.choice('abc')}]", s, s + r.choice([1, 1, 2, 60, 250, 600]), r.choice([0.9, 0.95])) for s in (r.choice([r.randint(0, 5000), 700, 1300]) for _ in range(r.randint(0, 9)))]
        jobs_w += [(job, i, w, s, e, 0.5, "A") for i, (w, s, e) in enumerate(words)]
        jobs_e += [(job, x, s, e, c) for x, s, e, c in events]
        want[job] = merged_by_hand(words, events)
    w = spark.createDataFrame(jobs_w, "job_id long, word_idx long, word string, start_ms long, end_ms long, confidence double, speaker string")
    e = spark.createDataFrame(jobs_e, "job_id long, label string, start_ms long, end_ms long, confidence double")
    got = {}
    placed = W.events_among(w, e)
    merged = W.insert_events(w, placed)
    for x in merged.orderBy("job_id", "word_idx").collect():
        assert x["word_idx"] == len(got.setdefault(x["job_id"], []))
        got[x["job_id"]].append((x["word"], x["start_ms"], x["end_ms"], x["old_idx"]))
    assert got == {k: v for k, v in want.items() if v}
    assert sum(x[3] is None for v in want.values() for x in v) > 100
    spans = spark.createDataFrame([(j, 0, len([x for x in v if x[3] is not None]), "s") for j, v in want.items() if any(x[3] is not None for x in v)], "job_id long, word_idx long, end_idx long, original string")
    for x in W.carry_indices(spans, placed).collect():
        old = [i for i, y in enumerate(want[x["job_id"]]) if y[3] is not None]
        assert (x["word_idx"], x["end_idx"]) == (old[0], old[-1] + 1)
    assert W.insert_events(w.limit(0), W.events_among(w.limit(0), e.limit(0))).collect() == []


def test_toggled_labels_and_placed_events_in_linear_time(spark):
    r = random.Random(5)
    rows = []
    for job in range(40):
        t = 0
        for _ in range(r.randint(1, 30)):
            t += r.choice([10, 900])
            rows.append((job, t, t + 50, r.choice([1, 2, 2, None] if job % 5 == 0 else [1, 2])))
            t += 50
    want, last = {}, {}
    for job, s, e, label in rows:
        end, before = last.get(job, (None, None))
        out = 3 - label if end is not None and s - end >= 800 and label == before and label is not None else label
        last[job] = (e, out)
        want[job, s] = out
    got = W.toggle_labels(spark.createDataFrame(rows, "job_id int, start_ms long, end_ms long, label int"), 800).collect()
    assert {(x["job_id"], x["start_ms"]): x["label"] for x in got} == want
    n = 200_000
    one = spark.range(n).select(F.lit(1).alias("job_id"), (F.col("id") * 150).alias("start_ms"), (F.col("id") * 150 + 100).alias("end_ms"), F.lit("[a]").alias("label"), F.lit(0.9).alias("confidence"))
    assert W.place_events(one).count() == n // 2  # each lasts 200 ms and bars the next


def test_tasks_grow_with_the_texts(spark, monkeypatch):
    from cuewright.sources import tables

    d = "/root/testdata/sf0.001"
    size = tables.table(spark, d, "documents").agg(F.sum(F.octet_length("text"))).first()[0]
    monkeypatch.setattr(tables, "TASK_TEXT", size // 50)
    # as it runs, with partitions merged where that is allowed
    assert tables.words_of_documents(spark, d).rdd.getNumPartitions() >= 50
    assert tables.words_of_documents(spark, d, tasks=17).rdd.getNumPartitions() == 17


def test_sentences_need_one_order(spark, make_words):
    plan = W.split_sentences(make_words(["a", "b"])).select("sentence")._jdf.queryExecution().executedPlan().toString()
    assert plan.count(" Sort [") == 1


def test_speakers_of_overlapping_segments_match_brute_force(spark):
    rng = random.Random(5)
    segs = [(j, i, rng.choice(["a", "ab", "b", None]), s, s + rng.choice([-5, 0, 3, 40, 300])) for j in (1, 2) for i, s in enumerate(rng.randrange(900) for _ in range(25))]
    words = [(j, i, "w", t, t + rng.randrange(9)) for j in (1, 2, 3) for i, t in enumerate(sorted(rng.randrange(1200) for _ in range(150)))]
    seg = spark.createDataFrame(segs, "job_id long, seg_idx int, speaker string, start_ms long, end_ms long")
    word = spark.createDataFrame([(*w, None, "own") for w in words], "job_id long, word_idx long, word string, start_ms long, end_ms long, confidence double, speaker string")
    rank = lambda x: (x[1], x[2] is not None, x[2] or "")

    def expected(j, mid):
        own = [x for x in segs if x[0] == j]
        over = [x for x in own if x[3] - 1 <= mid <= x[4] + 1]
        if over:
            return max(over, key=rank)[2] or "own"
        return None

    for tasks in (None, 3):
        got = {(r.job_id, r.word_idx): r.speaker for r in W.speaker_at(word, seg, tasks=tasks).collect()}
        assert len(got) == len(words)
        for j, i, _, s, e in words:
            want = expected(j, (s + e) / 2)
            assert want is None or got[j, i] == want
            assert j != 3 or got[j, i] == "own"
    assert "Join" not in W.speaker_at(word, seg)._jdf.queryExecution().executedPlan().toString()
