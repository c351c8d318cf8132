import random

from cuewright.functions import text as X
from cuewright.operators import review as R


def test_mentions_are_those_of_a_loop(spark):
    rnd = random.Random(3)
    pieces = ["Ass", "class", "glass", "a", "é", "Shut", "up", "shut  up", "\tup", "x-y", "sÉance", "  ", "ss", "lass s"]
    caps = [(j, c, rnd.choice(["", " "]).join(rnd.choice(pieces) + rnd.choice(["", " ", ", ", "\n"]) for _ in range(rnd.randint(0, 5)))) for j in range(6) for c in range(20)]
    names = sorted({(j, rnd.choice([*pieces, "shut", "s s", " a", "t  u", "nowhere"]).lower()) for j in range(5) for _ in range(8)})
    got = R.mentions(spark.createDataFrame(caps, "job_id long, caption long, text string"), spark.createDataFrame(names, "job_id long, name_ string"))
    want = sorted((j, c, n) for j, c, t in caps for k, n in names if j == k and n in t.lower())
    assert sorted((r["job_id"], r["caption"], r["name_"]) for r in got.collect()) == want and len(want) > 100
    assert got.count() == len(want)


def test_flags_of_captions(spark):
    caps = spark.createDataFrame([(1, 1, 0, 1000, "A class act"), (1, 2, 1000, 2000, f"oh {X.CENSOR_MARK}"), (1, 3, 2000, 3000, "fine"), (2, 1, 0, 500, "class"), (1, 4, 61_000, 62_000, None)], "job_id long, caption long, start_ms long, end_ms long, text string")
    cols = "job_id long, word_idx long, original string, replacement string, reason string, action string, case string, needs_review boolean, start_ms long, end_ms long"
    rows = [(1, 7, "ASS", "bum", "r", "replace", "A", False, -1, -1), (1, 8, "gone", "_", "r", "censor", "B", False, 2500, 2600), (1, 9, "fine", "fine", "r", "keep", "C", False, 2500, 2600), (3, 1, "class", "x", "r", "flag", "D", True, -1, -1)]
    got = {(r["job_id"], r["caption"]): [(f["original"], f["needs_review"]) for f in r["flags"]] for r in R.caption_safety(caps, spark.createDataFrame(rows, cols)).collect()}
    assert got == {(1, 1): [("ASS", False)], (1, 2): [("gone", True)], (1, 3): [("gone", True)]}


def test_no_names_and_no_captions(spark):
    caps = spark.createDataFrame([(1, 1, "a")], "job_id long, caption long, text string")
    names = spark.createDataFrame([(1, "a")], "job_id long, name_ string")
    assert R.mentions(caps, names.where("false")).count() == 0 and R.mentions(caps.where("false"), names).count() == 0


def test_caption_at_playheads(spark):
    rnd = random.Random(8)
    caps = [(j, i, a, a + rnd.choice([-5, 0, 900, 70_000, 200_000]), f"t{i}") for j in range(3) for i in range(25) for a in [rnd.randint(-1000, 300_000)]]
    heads = [(j, h) for j in range(4) for h in (-500, 0, 59_999, 60_000, *[rnd.randint(0, 400_000) for _ in range(30)])]
    got = {(r["job_id"], r["head_ms"]): (r["caption"], r["text"]) for r in R.caption_at(spark.createDataFrame(caps, "job_id long, caption long, start_ms long, end_ms long, text string"), spark.createDataFrame(heads, "job_id long, head_ms long")).collect()}
    for j, h in heads:
        runs = [(i, t) for k, i, a, b, t in caps if k == j and a <= h < b]
        assert got[j, h] == min(runs, default=(None, None)), (j, h)
