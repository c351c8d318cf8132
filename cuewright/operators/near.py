"""Near-miss lookup: pairs of distinct tokens and terms that meet on shared deletions.

Two tokens at most k edits apart become equal when at most k letters are deleted from each. So
both sides list what is left of them after up to two deletions, and meet where these agree: no
length, first letter or other key of a few values deals the pairs out. Where more than two edits
are allowed (long tokens), deletions would be too many; there a term is cut into one piece more than
edits, so one piece is untouched, and tokens list their parts of that length around its place.
Every pair that meets is then measured, so the result is exact.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cuewright.functions import text as X
from cuewright.sources.shared import written

#: Up to so many edits, deletions are listed; beyond, pieces.
DELETED = 2
#: Keys of terms with up to so many letters in all are broadcast (at most a few MB); others are shuffled.
FEW = 5_000
_EPS = 1e-9


def edits(length: Column, threshold: float) -> Column:
    """The most edits between a token of this length and another at ``threshold`` similarity."""
    longest = F.floor(length / F.lit(threshold) + F.lit(_EPS))
    return F.floor(longest * F.lit(1.0 - threshold) + F.lit(_EPS)).cast("int")


def _shorter(words: Column) -> Column:
    """All that is left of each word without one letter."""
    one = lambda w: F.transform(F.sequence(F.lit(1), F.greatest(F.length(w), F.lit(1))), lambda i: F.concat(F.left(w, i - 1), F.substring(w, i + 1, F.length(w))))
    return F.array_distinct(F.flatten(F.transform(words, one)))


def deletions(word: Column, k: Column) -> Column:
    """The word and what is left of it after up to ``k`` deletions, two at most."""
    none = F.expr("cast(array() as array<string>)")
    once = F.when(k >= 1, _shorter(F.array(word))).otherwise(none)
    twice = F.when(k >= 2, _shorter(_shorter(F.array(word)))).otherwise(none)
    return F.array_distinct(F.concat(F.array(word), once, twice))


def _by_deletions(side: DataFrame, name: str, threshold: float) -> DataFrame:
    size = F.length(name)
    few = side.where(F.floor(size * F.lit(1.0 - threshold) + F.lit(_EPS)) <= DELETED)
    keys = deletions(F.col(name), F.least(edits(size, threshold), F.lit(DELETED)))
    return few.select(name, F.explode(F.transform(keys, lambda k: F.xxhash64(k))).alias("key"))


def _piece(length: Column, pieces: Column, i: Column) -> tuple[Column, Column]:
    """Start (from 0) and size of the i-th of so many even pieces."""
    at = lambda j: F.floor(j * length / pieces).cast("int")
    return at(i), at(i + 1) - at(i)


def _pieces(terms: DataFrame, threshold: float) -> DataFrame:
    size, k = F.length("term"), edits(F.length("term"), threshold)

    def key(i: Column) -> Column:
        start, n = _piece(size, k + 1, i)
        return F.xxhash64(size, i, F.substring(F.col("term"), start + 1, n))

    return terms.where(k > DELETED).select("term", F.explode(F.transform(F.sequence(F.lit(0), k), key)).alias("key"))


def _parts(tokens: DataFrame, terms: DataFrame, threshold: float) -> DataFrame:
    size = F.length("token")
    lengths = F.broadcast(terms.select(F.length("term").alias("len")).distinct())  # a row a length
    reach = F.sequence(F.floor(size * F.lit(threshold)).cast("int"), F.ceil(size / F.lit(threshold)).cast("int"))
    met = tokens.where(edits(size, threshold) > DELETED).select("token", F.explode(reach).alias("len")).join(lengths, "len")
    k = edits(F.col("len"), threshold)

    def around(i: Column) -> Column:
        start, n = _piece(F.col("len"), k + 1, i)
        first, last = F.greatest(start - k, F.lit(0)), F.least(start + k, size - n)
        places = F.when(first <= last, F.sequence(first, last)).otherwise(F.expr("cast(array() as array<int>)"))
        return F.transform(places, lambda at: F.xxhash64(F.col("len"), i, F.substring(F.col("token"), at + 1, n)))

    return met.where(k > DELETED).select("token", F.explode(F.array_distinct(F.flatten(F.transform(F.sequence(F.lit(0), k), around)))).alias("key"))


def near_pairs(tokens: DataFrame, terms: DataFrame, threshold: float) -> DataFrame:
    """(token, term, score) of vocabulary similarity ``threshold`` or more, once for each pair.

    ``tokens``: token, ``terms``: term; both normalised. Empty and null ones have no pairs. Only
    tokens of a length that some term allows are made distinct, and they are written once for
    both ways to meet.
    """
    if not 0.5 < threshold <= 1:
        raise ValueError("the threshold must be above one half, and one at most")
    terms = terms.where("term <> ''").distinct()
    least, most, letters = terms.agg(F.min(F.length("term")), F.max(F.length("term")), F.sum(F.length("term"))).first()
    reach = F.length("token").between(math.floor((least or 1) * threshold), math.ceil((most or 0) / threshold))
    tokens = written(tokens.where("token <> ''").where(reach).distinct(), "tokens")
    # Catalyst takes an explode to be as large as its input, so neither side of these joins is left to its guess
    few = (letters or 0) <= FEW
    side = (lambda keys: F.broadcast(keys)) if few else (lambda keys: keys.hint("merge"))
    met = _by_deletions(tokens, "token", threshold).join(side(_by_deletions(terms, "term", threshold)), "key").select("token", "term")
    met = met.unionByName(_parts(tokens, terms, threshold).join(side(_pieces(terms, threshold)), "key").select("token", "term"))
    score = F.round(X.vocabulary_similarity(F.col("token"), F.col("term")), 9)
    return met.withColumn("score", score).where(F.col("score") >= threshold).distinct()
