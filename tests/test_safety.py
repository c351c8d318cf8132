import random
import re

import pytest

from pyspark.sql import functions as F

from cuewright.functions import text as X
from cuewright.operators import safety as S
from cuewright.operators import vocabulary as V
from cuewright.schema import Settings

LEX = S.Lexicon(words={"darn": "mild", "vile": "strong"}, phrases={"very vile": "strong", "very vile thing": "mild"}, allowlist=("quartz",), confusions={"vile": ["vial"], "darn": ["barn"]}, collocations={"really|idea": ["good"]}, vocabulary=("castle",))


def hits(words, lex=LEX):
    return S.detect(words, lex).orderBy("word_idx").collect()


def test_no_substring_hits(make_words):
    assert hits(make_words("revile darnel evildoer villa".split())) == []


def test_stems(make_words):
    assert [(h["word_idx"], h["matched"]) for h in hits(make_words("darned passing viles".split()))] == [(0, "darn"), (2, "vile")]


def test_longest_phrase_first(make_words):
    found = hits(make_words("a very vile thing, vile".split()))
    assert [(h["match_type"], h["matched"], h["word_idx"], h["end_idx"]) for h in found] == [("phrase", "very vile thing", 1, 4), ("word", "vile", 4, 5)]
    assert found[0]["context_before"] == ["a"] and found[0]["context_after"] == ["vile"]


@pytest.mark.parametrize(
    ("conf", "settings", "expected"),
    [
        (0.4, Settings(correction_threshold=0.5), ("B", "replace", "Good!")),
        (0.95, Settings(correction_threshold=0.5), ("D", "flag", "Darn!")),
        (0.4, Settings(correction_threshold=1.1), ("C", "censor", "_")),
        (0.4, Settings(correction_threshold=1.1, unknown_profanity="keep"), ("D", "flag", "Darn!")),
        (0.4, Settings(correction_threshold=1.1, safety_mode="review-only"), ("D", "flag", "Darn!")),
        (0.4, Settings(correction_threshold=1.1, safety_mode="balanced"), ("D", "flag", "Darn!")),
    ],
)
def test_policy(make_words, conf, settings, expected):
    words = make_words([("really", 0, 1), ("Darn!", 1, 2, conf), ("idea", 2, 3)])
    found = S.detect(words, LEX)
    d = S.decide(found, S.best_alternatives(S.alternatives(found, LEX)), settings).collect()[0]
    assert (d["case"], d["action"], d["replacement"]) == expected


def test_span_becomes_one_word(make_words):
    words = make_words("a very vile thing here".split())
    out = S.apply_decisions(words, S.censor_all(S.detect(words, LEX))).orderBy("word_idx").collect()
    assert [(r["word"], r["end_ms"]) for r in out] == [("a", 200), ("_", 800), ("here", 1000)]


def test_vocabulary_layers(spark):
    rows = [(0, 0, "Bingo", "people"), (1, 0, "bingo", "games"), (1, 1, "Oslo", "locations")]
    out = V.merge_layers(spark.createDataFrame(rows, "layer int, ord int, term string, category string"), spark.createDataFrame([("OSLO",)], "term string"))
    assert [(r["term"], r["category"], r["position"]["layer"]) for r in out.collect()] == [("bingo", "games", 0)]


def test_near_misses(spark, make_words):
    terms = spark.createDataFrame([("Fluffernoodle", 0)], "term string, ord int")
    out = V.apply_terms(make_words([("fluffernoddle", 0, 1, 0.55), ("FLUFFERNODDLE", 1, 2, 0.99), ("noodle", 2, 3, 0.1)]), terms).orderBy("word_idx")
    assert [r["word"] for r in out.collect()] == ["Fluffernoodle", "FLUFFERNODDLE", "noodle"]


def test_by_category_lists_empty_ones(spark):
    v = V.merge_layers(spark.createDataFrame([(0, 0, "Oslo", "locations")], "layer int, ord int, term string, category string"), spark.createDataFrame([], "term string"))
    rows = V.by_category(v, V.CATEGORIES).orderBy("category_position").collect()
    assert [r["category"] for r in rows] == V.CATEGORIES and [r["terms"] for r in rows if r["terms"]] == [["Oslo"]]


def test_phrase_needs_every_token(make_words):
    out = V.phrase_matches(make_words("the rainbow castel fell".split()), ["rainbow castle"], 0.6).collect()
    assert [(r["word_idx"], r["n"]) for r in out] == [(1, 2)]


def test_terms_of_several_words_go_first(spark, make_words):
    terms = spark.createDataFrame([("Castle", 0), ("rainbow castle", 1), ("old rainbow castle", 2), ("castle gate", 3)], "term string, ord int")
    words = [("Rainbow", 0, 1, 0.99, "a"), ("castel", 1, 2, 0.1, "b"), ("gate", 2, 3, 0.99), ("castel", 3, 4, 0.99), ("castel", 4, 5, 0.5), ("rainbowcastle", 5, 6, 0.1)]
    words += [("THE", 6, 7), ("OLD", 7, 8), ("RAINBOW", 8, 9), ("CASTLE", 9, 10), ("gate", 10, 11)]
    rows = V.apply_terms(make_words(words), terms, 0.6).orderBy("word_idx").collect()
    want = [(0, "Rainbow castle", 0, 2, 0.99, "a"), (2, "gate", 2, 3, 0.99, None), (3, "castel", 3, 4, 0.99, None), (4, "Castle", 4, 5, 0.5, None), (5, "rainbowcastle", 5, 6, 0.1, None)]
    want += [(6, "THE", 6, 7, None, None), (7, "OLD RAINBOW CASTLE", 7, 10, None, None), (10, "gate", 10, 11, None, None)]
    assert [tuple(r[c] for c in ("word_idx", "word", "start_ms", "end_ms", "confidence", "speaker")) for r in rows] == want


def test_term_spans_equal_phrase_matches(spark):
    from cuewright.plans import queries_safety as P

    d = "/root/testdata/sf0.001"
    spans = {(r["job_id"], r["word_idx"]): r["term"] for r in P.vocab_phrases(spark, d).collect()}
    assert spans
    rows = {(r["job_id"], r["word_idx"]): r["word"] for r in P.vocab_apply_phrases(spark, d).collect()}
    assert all(rows[k] == term for k, term in spans.items())
    assert len(rows) == P.vocab_apply(spark, d).count() - sum(len(t.split()) - 1 for t in spans.values())


def test_a_lexicon_of_a_hundred_thousand_entries(spark):
    """Hits equal those of a walk over the words, and no entry is part of the plan."""
    r = random.Random(21)
    stock = [f"w{i}" for i in range(40)] + ["runnings", "run", "wordings", "word"]
    phrases = {" ".join(r.choice(stock) for _ in range(r.choice([2, 3, 4]))): r.choice(["mild", "strong"]) for _ in range(150)}
    listed = {w: "mild" for w in ("w1", "w7", "run", "word", "runn", "in")}
    allowed = {"w3", "run"}
    jobs = {j: [r.choice([*stock, "w1ing", "W7s!", "wed", "..."]) for _ in range(r.randint(1, 60))] for j in range(30)}
    many = spark.range(100_000).select(F.concat(F.lit("zq"), F.col("id")).alias("matched"), F.lit("mild").alias("severity"))
    table = lambda d: spark.createDataFrame(list(d.items()), "matched string, severity string")
    lists = spark.createDataFrame([], "key string, ord int, cand string")
    terms = spark.createDataFrame([(t,) for t in allowed], "term string")
    lexicon = S.LexiconTables(table(listed).unionAll(many), table(phrases).unionAll(many.select(F.concat("matched", F.lit(" zz")), "severity")), terms, lists, lists, terms.limit(0))
    rows = [(j, i, w, 100 * i, 100 * i + 90, 0.5, "A") for j, ws in jobs.items() for i, w in enumerate(ws)]
    words = spark.createDataFrame(rows, "job_id long, word_idx long, word string, start_ms long, end_ms long, confidence double, speaker string")
    want = set()
    for j, ws in jobs.items():
        t = ["".join(c for c in w.lower() if c.isalnum()) for w in ws]
        used = [False] * len(t)
        for n in (4, 3, 2):
            for at in range(len(t) - n + 1):
                text = " ".join(t[at : at + n])
                if text in phrases and not any(used[at : at + n]):
                    used[at : at + n] = [True] * n
                    want.add((j, at, at + n, text, phrases[text], bool(allowed & set(t[at : at + n]))))
        for at, w in enumerate(t):
            stems = [w] + [w[: -len(x)] for x in X.SUFFIXES if w.endswith(x) and len(w) - len(x) >= 3]
            found = next((x for x in stems if x in listed), None)
            if w and not used[at] and found:
                want.add((j, at, at + 1, found, "mild", w in allowed or found in allowed))
    hits = S.detect(words, lexicon)
    assert {(x["job_id"], x["word_idx"], x["end_idx"], x["matched"], x["severity"], x["allowlisted"]) for x in hits.collect()} == want and len(want) > 100
    assert "zq7" not in hits._jdf.queryExecution().toString()


def test_decisions_are_applied_without_a_join(spark):
    words = spark.createDataFrame([(j, i, f"w{i}", i * 10, i * 10 + 5) for j in (1, 2) for i in range(8)], "job_id long, word_idx long, word string, start_ms long, end_ms long")
    rows = [(1, 0, 1, "x", 5, "replace"), (1, 2, 5, "_", 45, "censor"), (1, 6, 8, "k", 75, "keep"), (None, 1, 3, "n", 25, "censor"), (2, 7, 8, "_", 75, "censor")]
    made = spark.createDataFrame(rows, "job_id long, word_idx long, end_idx long, replacement string, end_ms long, action string")
    out = S.apply_decisions(words, made, tasks=3)
    got = {j: [(r.word_idx, r.word, r.end_ms) for r in out.where(F.col("job_id") == j).orderBy("word_idx").collect()] for j in (1, 2)}
    own = lambda i: (i, f"w{i}", i * 10 + 5)
    assert got[1] == [(0, "x", 5), own(1), (2, "_", 45), own(5), own(6), own(7)]
    assert got[2] == [*map(own, range(7)), (7, "_", 75)]
    assert "Join" not in out._jdf.queryExecution().executedPlan().toString()


def test_hits_are_moved_once(spark, make_words):
    """Words meet the allow-list before they are hits, so no exchange by job and word follows."""
    lexicon = S.Lexicon(words={"trash": "strong", "bad": "mild"}, phrases={"so bad": "mild"}, allowlist=("bad", "deal"))
    words = make_words([*"abcdefghi", "trash", *"jklmnopqrstuvwxyz", "Bads", "so", "bad", "trash"])
    hits = S.detect(words, lexicon)
    plan = hits._jdf.queryExecution().executedPlan().toString()
    assert not re.search(r"Exchange hashpartitioning\(job_id#\d+L, word_idx", plan)
    rows = {r["word_idx"]: r for r in hits.collect()}
    assert {i: (r["matched"], r["allowlisted"]) for i, r in rows.items()} == {9: ("trash", False), 27: ("bad", True), 28: ("so bad", True), 30: ("trash", False)}
    assert rows[9]["context_before"] == list("efghi") and rows[9]["context_after"] == list("jklmn")
    assert rows[28]["context_before"] == ["w", "x", "y", "z", "Bads"] and rows[28]["context_after"] == ["trash"]
    assert rows[30]["context_before"] == ["y", "z", "Bads", "so", "bad"] and rows[30]["context_after"] == []
