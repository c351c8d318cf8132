"""Near-miss lookup against all pairs, and terms of several words against a walk over the words."""

import random

import pytest
from pyspark.sql import functions as F

from cuewright.functions import text as X
from cuewright.operators import near
from cuewright.operators import vocabulary as V


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(new[-1] + 1, row[j] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def similarity(a, b):
    if not a or not b:
        return 0.0
    if a == b:
        return 1.0
    longest = max(len(a), len(b))
    return 0.0 if longest <= 2 else 1 - distance(a, b) / longest


def bent(r, word, n):
    w = list(word)
    for _ in range(n):
        i = r.randint(0, len(w))
        kind = r.choice("ids")
        if kind == "i":
            w.insert(i, r.choice("abc"))
        elif w and kind == "d":
            w.pop(min(i, len(w) - 1))
        elif w:
            w[min(i, len(w) - 1)] = r.choice("abc")
    return "".join(w)


@pytest.mark.parametrize("threshold", [0.6, 0.72, 0.84, 1.0])
def test_pairs_are_all_pairs(spark, threshold):
    r = random.Random(11)
    terms = {"".join(r.choice("abcd") for _ in range(r.choice([1, 2, 3, 5, 6, 7, 9, 12, 13, 15, 17, 18, 19, 24, 31, 45]))) for _ in range(120)} | {""}
    tokens = {bent(r, r.choice(sorted(terms)), r.choice([0, 1, 1, 2, 3, 4, 7])) for _ in range(500)} | {"é" * 9, "é" * 8}
    got = near.near_pairs(spark.createDataFrame([(t,) for t in tokens], "token string"), spark.createDataFrame([(t,) for t in terms | {"é" * 9}], "term string"), threshold).collect()
    want = {(a, b) for a in tokens for b in terms | {"é" * 9} if round(similarity(a, b), 9) >= threshold}
    assert {(x["token"], x["term"]) for x in got} == want and len(got) == len(want) > 50
    assert all(abs(x["score"] - similarity(x["token"], x["term"])) < 1e-8 for x in got)


def test_a_hundred_thousand_terms(spark):
    terms = spark.range(100_000).select(F.concat(F.lit("t"), F.substring(F.md5(F.col("id").cast("string")), 1, 9)).alias("term")).distinct()
    tokens = terms.where("hash(term) % 200 = 0").select(F.concat(F.left("term", F.lit(5)), F.lit("z"), F.substring("term", 6, 9)).alias("token"))
    pairs = near.near_pairs(tokens, terms, 0.84)
    assert tokens.join(pairs, "token", "left_anti").count() == 0  # each is one insertion from its term
    some = tokens.orderBy("token").limit(20)
    every = some.crossJoin(terms).where(F.round(X.vocabulary_similarity(F.col("token"), F.col("term")), 9) >= 0.84)
    assert {tuple(x) for x in every.collect()} == {(x[0], x[1]) for x in pairs.join(some, "token").collect()}


def applied_by_hand(words, terms, threshold=0.84):
    """(start, n, term) of terms of several words, longest first, then in their order, then leftmost."""
    used, out = [False] * len(words), []
    norm = lambda w: "".join(c for c in w.lower() if c.isascii() and (c.isalnum() or c == "'")).strip("'")
    for term in sorted(terms, key=lambda t: -len(t.split())):
        parts = [norm(p) for p in term.split()]
        for at in range(len(words) - len(parts) + 1):
            inside = range(at, at + len(parts))
            if not any(used[i] for i in inside) and all(round(similarity(norm(words[i]), p), 9) >= threshold for i, p in zip(inside, parts, strict=True)):
                out.append((at, len(parts), term))
                for i in inside:
                    used[i] = True
    return sorted(out)


def test_terms_of_several_words(spark):
    r = random.Random(12)
    stock = ["rainbow", "castle", "the", "Unicorn", "magic", "kingdom", "a", "of"]
    terms = [" ".join(r.choice(stock).lower() for _ in range(r.choice([2, 2, 3, 4]))) for _ in range(30)] + ["the ... castle", "castle  of"]
    jobs = {j: [bent(r, r.choice(stock), r.choice([0, 0, 0, 1])) or "x" for _ in range(r.randint(1, 60))] for j in range(25)}
    rows = [(j, i, w, 100 * i, 100 * i + 90, 0.5, "A") for j, ws in jobs.items() for i, w in enumerate(ws)]
    words = spark.createDataFrame(rows, "job_id long, word_idx long, word string, start_ms long, end_ms long, confidence double, speaker string")
    got = {}
    for x in V.phrase_matches(words, terms).collect():
        got.setdefault(x["job_id"], []).append((x["word_idx"], x["n"], x["term"].lower()))
    want = {j: found for j, ws in jobs.items() if (found := applied_by_hand(ws, terms))}
    assert {j: sorted(v) for j, v in got.items()} == want and len(want) > 10
    out = V.apply_terms(words, spark.createDataFrame([(t, i) for i, t in enumerate(terms)], "term string, ord int"))
    assert out.columns == words.columns
    kept = {(x["job_id"], x["word_idx"]): (x["word"].lower(), x["end_ms"]) for x in out.collect()}
    assert len(kept) == sum(len(ws) - sum(n - 1 for _, n, _ in want.get(j, [])) for j, ws in jobs.items())
    assert all(kept[j, at] == (term, 100 * (at + n - 1) + 90) for j, found in want.items() for at, n, term in found)


def test_the_words_are_never_broadcast_to_the_terms(spark, tmp_path):
    words = spark.createDataFrame([(f"w{i}ordnum{i * 7919}",) for i in range(500)], "token string")
    terms = spark.createDataFrame([("wordnumber",), ("extraordinarily",)], "term string")
    plan = near.near_pairs(words, terms, 0.84)._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "BuildLeft" not in plan


def test_many_terms_give_the_same_pairs_by_shuffled_joins(spark, monkeypatch):
    words = spark.createDataFrame([(w,) for w in ("banana", "bananna", "extraordinarily", "extraordinarely", "cat")], "token string")
    terms = spark.createDataFrame([("banana",), ("extraordinarily",), ("dog",)], "term string")
    few = sorted(map(tuple, near.near_pairs(words, terms, 0.84).collect()))
    monkeypatch.setattr("cuewright.operators.near.FEW", 0)
    many = near.near_pairs(words, terms, 0.84)
    assert "SortMergeJoin" in many._jdf.queryExecution().executedPlan().toString()
    assert len(few) == 4 and sorted(map(tuple, many.collect())) == few
