import os

import pytest
from pyspark.errors import AnalysisException

from cuewright.operators import recognition as R


def said():
    """A recogniser made in a function, so that it travels to workers by value."""

    class Said(R.ClipRecognizer):
        """A word a hint, with the device, the worker and how many instances it had before."""

        made = 0

        def __init__(self, device):
            super().__init__(device)
            self.nth = type(self).made
            type(self).made += 1

        def words(self, clip, hints):
            for i, hint in enumerate(hints):
                yield f"{hint}/{self.device}/{os.getpid()}/{self.nth}", i, i + 1, 0.5, clip["text"]

    return Said


@pytest.fixture()
def clips(spark):
    rows = [(i, f"a{i} b c", 0.3) for i in range(20)] + [(90, None, 1.0), (91, "", 1.0), (92, "x y", None)]
    return spark.createDataFrame(rows, "job_id long, text string, duration_s double")


def test_the_table_function_equals_the_stub(clips):
    cols = ["job_id", "word_idx", "word", "start_ms", "end_ms", "confidence", "speaker"]
    got = sorted(tuple(r[c] for c in cols) for r in R.recognised(clips).collect())
    want = sorted(tuple(r[c] for c in cols) for r in R.transcribe(clips).collect())
    assert got == want and {r[0] for r in got} == {*range(20), 92}


def test_from_sql_with_hints_and_a_device(spark, clips):
    R.install(spark, {"said": said()}, "recognise_test")
    clips.selectExpr("*", "array('p', 'q') AS hints").createOrReplaceTempView("hinted_clips")
    rows = spark.sql("SELECT * FROM recognise_test(TABLE(hinted_clips), 'said', 'gpu:1')").collect()
    assert len(rows) == 46 and {r["word_idx"] for r in rows} == {0, 1} and {r["speaker"] for r in rows if r["job_id"] == 3} == {"a3 b c"}
    parts = [r["word"].split("/", 1)[1].rsplit("/", 1) for r in rows]
    # one instance a worker, whatever the number of its clips
    assert {p[1] for p in parts} == {"0"} and all("gpu:1" in p[0] for p in parts)
    plain = spark.sql("SELECT word FROM recognise_test(TABLE(hinted_clips), name => 'said')").collect()
    assert all("/cpu/" in r["word"] for r in plain)


def test_hints_of_a_vocabulary(spark, clips):
    terms = spark.createDataFrame([("Oslo", 3), ("Bingo", 1)], "term string, position long")
    R.CLIP_RECOGNIZERS["said"] = said()
    try:
        rows = R.recognised(clips.limit(1), "said", vocabulary=terms).orderBy("word_idx").collect()
    finally:
        del R.CLIP_RECOGNIZERS["said"]
    assert [r["word"].split("/")[0] for r in rows] == ["Bingo", "Oslo"]


def test_faults_are_found_by_analysis(spark, clips):
    with pytest.raises(AnalysisException, match="even_words"):
        R.recognised(clips, "other")
    with pytest.raises(AnalysisException, match="job_id"):
        R.recognised(clips.drop("job_id"))
    with pytest.raises(AnalysisException, match="hints"):
        R.recognised(clips.selectExpr("*", "1 AS hints"))


def test_no_clips(spark, clips):
    assert R.recognised(clips.where("false")).collect() == []
