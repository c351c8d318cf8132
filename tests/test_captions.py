from pyspark.sql import functions as F

from cuewright.functions import text as X
from cuewright.operators import captions as C
from cuewright.operators import review as R


def wrap(spark, text, n):
    return spark.createDataFrame([(text,)], "t string").select(X.wrap_caption(F.col("t"), n)).first()[0]


def test_wrap(spark):
    text = "Look at this giant purple dinosaur!"
    for n in (20, 32):
        lines = wrap(spark, text, n).split("\n")
        assert lines[0] == "Look at this giant" and max(map(len, lines)) <= n
    assert wrap(spark, "short one", 42) == "short one"
    assert wrap(spark, "x" * 100, 42) == "x" * 42 + "\n" + "x" * 42


def test_cues_break_at_sentences_pauses_and_length(make_words):
    items = [("Hello.", 0, 300), ("again", 400, 700), ("now", 1400, 1700), *[("word" * 5, 1800 + 100 * i, 1850 + 100 * i) for i in range(6)]]
    cues = C.assemble(C.assign_cues(make_words(items))).orderBy("cue").collect()
    assert [c["n_words"] for c in cues] == [1, 1, 4, 3]
    assert all(len(c["text"]) <= 84 for c in cues)


def test_short_cue_takes_in_the_next(make_words):
    items = [("Hi.", 0, 300), ("there", 400, 900), ("you", 1000, 1400)]
    merged = C.assemble(C.merge_short(C.assign_cues(make_words(items)))).collect()
    assert [(m["text"], m["end_ms"]) for m in merged] == [("Hi. there you", 1400)]


def test_other_speaker_is_not_merged(make_words):
    items = [("Hi.", 0, 300, None, "a"), ("there", 400, 900, None, "b")]
    assert C.assemble(C.merge_short(C.assign_cues(make_words(items)))).count() == 2


def test_dense_cue_is_split_or_flagged(make_words):
    dense = C.repair_density(C.assign_cues(make_words([(w, i * 60, i * 60 + 50) for i, w in enumerate("one two three four, five six seven eight".split())])))
    rows = dense.orderBy("caption").collect()
    assert [r["text"] for r in rows] == ["one two three four,", "five six seven eight"]
    assert "timing_extended" in rows[1]["flags"] and rows[1]["reading_status"] == "OK"
    assert "needs_review" in rows[0]["flags"]


def captions(spark, rows):
    return spark.createDataFrame([(1, i + 1, s, e, t, []) for i, (s, e, t) in enumerate(rows)], "job_id long, index long, start_ms long, end_ms long, text string, flags array<string>")


def test_overlap_moves_the_start(spark):
    out = C.validate(captions(spark, [(0, 2000, "a"), (1500, 3000, "b")])).orderBy("index").collect()
    assert out[1]["start_ms"] == 2000 and [i["type"] for i in out[1]["issues"]] == ["overlap"]


def test_every_fault(spark):
    rows = [(-100, 700, "a"), (900, 800, "b"), (2000, 2000, "c"), (2520, 20000, "d"), (21000, 22000, " "), (29000, 31000, "e"), (40000, 41000, "f")]
    out = C.validate(captions(spark, rows), duration_ms=30000).orderBy("index").collect()
    types = [[i["type"] for i in r["issues"]] for r in out]
    assert types == [["negative"], ["non_increasing", "short_duration"], ["short_duration"], ["long_duration", "gap"], ["empty"], ["outside_video"], ["outside_video"]]
    assert [r["caption"] for r in out] == [1, 2, 3, 4, None, 5, None] and out[5]["end_ms"] == 30000


def test_srt_round_trip(spark):
    caps = captions(spark, [(0, 1500, "one\ntwo"), (1500, 1000, "three"), (2000, 3000, " ")]).withColumnRenamed("index", "caption")
    srt = C.render_srt(caps)
    assert srt.first()["srt"] == "1\n00:00:00,000 --> 00:00:01,500\none\ntwo\n\n2\n00:00:01,500 --> 00:00:01,500\nthree\n"
    back = C.parse_srt(srt).orderBy("position").collect()
    assert [(b["index"], b["start_ms"], b["text"]) for b in back] == [(1, 0, "one\ntwo"), (2, 1500, "three")]


def test_review(spark):
    caps = spark.createDataFrame([(1, 1, "a bad day", ["needs_review"], "bad", "a good day")], "job_id long, caption int, text string, flags array<string>, original string, suggested_text string")
    for action, text, flags in (("Accept", "a good day", []), ("keep censored", "a _ day", ["needs_review"]), ("edit", "mine", [])):
        r = R.review_action(caps, spark.createDataFrame([(1, 1, action, "mine")], "job_id long, caption int, action string, new_text string")).first()
        assert (r["text"], r["flags"]) == (text, flags)


def test_latest_status_and_busy(spark):
    log = spark.createDataFrame([(1, "f", "QUEUED", None, 1), (1, None, None, "x", 2), (2, "g", "READY", None, 3)], "job_id long, original_filename string, status string, error string, at long")
    jobs = R.latest_status(log)
    assert {r["job_id"]: (r["status"], r["error"]) for r in jobs.collect()} == {1: ("QUEUED", "x"), 2: ("READY", None)}
    assert R.busy_job(jobs, ["QUEUED"]).first()["job_id"] == 1


def test_quality_report_has_reading_speed_warnings(spark):
    from cuewright.plans import queries_captions as P

    d = "/root/testdata/sf0.001"
    whole = {r["job_id"]: r for r in P.quality_report_captions(spark, d).collect()}
    words = P.words_of_documents(spark, d)
    caps = C.caption_summary(C.repair_density(C.merge_short(C.assign_cues(words)))).collect()
    assert caps and any(r["reading_speed_warnings"] for r in caps)
    assert {r["job_id"]: r["reading_speed_warnings"] for r in caps} == {k: r["reading_speed_warnings"] for k, r in whole.items()}


def test_captions_are_separated_in_pieces(spark):
    """Pass two of the validation equals one walk over each job, whatever pieces it is cut into."""
    import random

    from cuewright.schema import Settings

    r, s, rows, want = random.Random(3), Settings(), [], {}
    for job in range(40):
        t, last = 0, None
        for i in range(r.randint(1, 40)):
            t += r.choice([-2600, -400, 0, 30, 79, 80, 100, 600, 3000])
            start, end = max(0, t), max(0, t) + r.choice([500, 501, 900, 2500])
            rows.append((job, i, start, end))
            t = end
            overlap, gap = last is not None and start < last, last is not None and start > last and start - last < s.min_caption_gap_ms
            moved = last if overlap or gap else start
            fixed = moved + s.min_cue_ms if end <= moved else end
            want[job, i] = (moved, fixed, last if overlap or gap else None, overlap, gap, end <= moved)
            last = fixed
    got = C._separated(spark.createDataFrame(rows, "job_id int, index long, start_ms long, end_ms long"), s).collect()
    assert {(x["job_id"], x["index"]): (x["s2"], x["e2"], x["moved"] if x["overlap"] or x["gap"] else None, x["overlap"], x["gap"], x["stretched"]) for x in got} == want
    assert len({x[5] for x in want.values()}) == 2 and sum(x[3] for x in want.values()) > 50


def test_cues_are_assigned_without_a_join(make_words):
    """Words travel with their island: no join back, and cues go on over islands, speakers and long stretches."""
    said = [("aaaa", i * 400, i * 400 + 300, 0.5, "A" if i < 60 else "B") for i in range(90)]
    cued = C.assign_cues(make_words([*said, ("end.", 50000, 50300, None, None), ("new", 50400, 50700, None, None)]))
    assert "Join" not in cued._jdf.queryExecution().executedPlan().toString()
    rows = sorted(cued.collect(), key=lambda r: r["word_idx"])
    assert [r["word_idx"] for r in rows] == list(range(92)) and rows[0]["cue"] == 1 and rows[-1]["word"] == "new"
    steps = {r["word_idx"] for last, r in zip(rows, rows[1:]) if r["cue"] == last["cue"] + 1}
    assert all(r["cue"] - last["cue"] in (0, 1) for last, r in zip(rows, rows[1:])) and {60, 90, 91} <= steps


def _random_words(spark, jobs=60):
    import random

    r, rows = random.Random(11), []
    pool = ["a", "the", "and", "But,", "so", "then.", "longer", "wonderful,", "ok!", 'yes?"', "said.”", "no’", "w" * 50, "y" * 95, "", "two words", "é" * 9, "of", "with,", None]
    for job in range(jobs):
        t, speaker, plain = 0, None, job % 3
        for i in range(r.choice([1, 2, 13, 40, 150])):
            t += r.choice([0, 40, 90, 200, 400, 400, 900, 7100])
            speaker = r.choice([None, "", "A", "B"]) if r.random() < 0.08 else speaker
            end = None if plain == 0 and r.random() < 0.03 else t + r.choice([0, 30, 200, 300, 700])
            rows.append((job, i, r.choice(pool[:13] if plain else pool), t, end, r.choice([None, r.random(), 0.7, 0.9]), speaker))
            t = end or t
    return spark.createDataFrame(rows, "job_id long, word_idx long, word string, start_ms long, end_ms long, confidence double, speaker string")


def _rows(df):
    return sorted(map(tuple, df.collect()), key=lambda r: (r[0], r[1]))


def test_captions_in_one_pass(spark):
    """Captions of words equal those of cues cut, merged and repaired one after another, however the words are batched, without a group or an array of words."""
    words, size = _random_words(spark), "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(size)
    want = _rows(C.repair_density(C.merge_short(C.assign_cues(words))))
    assert len({r[8] for r in want}) == 2 and any("timing_extended" in r[9] for r in want)
    try:
        for rows in ("5", "64", before):
            spark.conf.set(size, rows)
            assert _rows(C.captions(words)) == want
    finally:
        spark.conf.set(size, before)
    plan = C.captions(words)._jdf.queryExecution().executedPlan().toString()
    assert "Aggregate" not in plan and plan.count("Sort ") == 1 and "MapInArrow" in plan


def test_captions_at_any_speed_are_the_merged_cues(spark):
    """Where no cue is dense, captions are the cues of the other operators, wrapped by the column expression."""
    from cuewright.schema import Settings

    for s in (Settings(max_cps=1e9, max_wps=1e9), Settings(max_cps=1e9, max_wps=1e9, max_chars=20, max_lines=1), Settings(max_cps=1e9, max_wps=1e9, max_chars=30)):
        words = _random_words(spark)
        cues = C.assemble(C.merge_short(C.assign_cues(words, s), s))
        wrapped = X.wrap_caption(F.col("text"), s.max_chars, s.max_lines)
        want = _rows(cues.select("job_id", "cue", "start_ms", "end_ms", wrapped.alias("text"), "speaker", "n_words", "mean_confidence"))
        assert _rows(C.captions(words, s).select("job_id", "caption", "start_ms", "end_ms", "text", "speaker", "n_words", "mean_confidence")) == want
        assert max(len(r[4].split("\n")) for r in want) == s.max_lines


def test_quality_report_counts_turns_with_words(spark):
    """Turns of the report are the segments of ``pause_turns``, counted in the same pass as the words; given segments count as before."""
    from cuewright.operators import words as W
    from cuewright.plans import queries_captions as P

    d = "/root/testdata/sf0.001"
    words = P.words_of_documents(spark, d)
    turns = {r["job_id"]: r["count"] for r in W.pause_turns(words).groupBy("job_id").count().collect()}
    report = {r["job_id"]: r for r in P.quality_report_captions(spark, d).collect()}
    assert {k: r["speaker_changes"] for k, r in report.items()} == turns and len(set(turns.values())) > 5
    records = W.confidence_records(_random_words(spark).withColumn("new_", W.after_pause()))
    counted = W.confidence_summary(records, segments=F.count_if("new_") + 1)
    assert counted._jdf.queryExecution().executedPlan().toString().count("Sort ") == 1
    assert {r["job_id"]: r["segments"] for r in counted.collect()} == {r["job_id"]: r["count"] for r in W.pause_turns(_random_words(spark)).groupBy("job_id").count().collect()}
    none = spark.createDataFrame([], "job_id long, replaced long, censored long, flagged long, reading_speed_warnings long")
    whole = [_rows(R.quality_report(counted, none, none, given, none)) for given in (None, W.pause_turns(_random_words(spark)))]
    assert whole[0] == whole[1]
