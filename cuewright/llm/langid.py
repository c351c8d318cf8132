"""Word-first language identification with backoff to character n-grams.

A word that the model knows is scored by its log frequency in each language. An unknown
word is covered by its longest known n-grams, 4 letters down to 1, each shorter length at a
penalty. A text's language has the largest sum over its words; the score is the posterior
probability of that language under equal priors.

Fitting: the classifier is fitted on a bounded sample of labelled texts, at most about
``ROWS`` different ones a language, picked by a hash of the text and taken once each, so that
copies neither fill a language's sample nor empty it. Word and n-gram counts of the
sample are aggregated on the cluster; the model keeps the ``WORDS`` words and ``GRAMS``
n-grams that are most frequent in some language, which bounds what is broadcast. Every
language with a letter in its texts is learned; a key's counts are held for the languages in
which it occurs only.

Defined results: a null text, or one without a letter, is ``und`` with score 0; so is every
text when there is nothing to learn from. Ties go to the language that sorts first. Repeated
rows get equal results; an empty table gives an empty table.
"""

from __future__ import annotations

import math
import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cuewright.llm.common import Workspace, append_column, free_name, read

ROWS = 2000
WORDS = 150_000
GRAMS = 60_000
CACHED = 10_000_000  # numbers held for unknown words in a task
LONGEST = 4
PENALTY = math.log(0.4)
_WORD = re.compile(r"[^\W\d_]+")

Sparse = tuple[list[str], np.ndarray, np.ndarray, np.ndarray]
_NOTHING: Sparse = ([], *[np.zeros(0, np.int64)] * 3)


def words_of(text: str | None) -> list[str]:
    """Lower-cased maximal runs of letters."""
    found = _WORD.findall((text or "").lower())
    if all(map(str.isalpha, found)):
        return found
    # characters such as superscript digits count as word characters but not as letters
    return [part for w in found for part in "".join(c if c.isalpha() else " " for c in w).split()]


def grams_of(word: str, n: int) -> list[str]:
    own = f"^{word}$"
    return [own[i : i + n] for i in range(len(own) - n + 1)]


class Table:
    """Log frequencies in each language of some keys, sparse: the languages' floors, which hold
    where a key has no count, and by key the gains over them."""

    def __init__(self, keys: list[str], sizes: np.ndarray, lang: np.ndarray, counts: np.ndarray, langs: int):
        self.row = {k: i for i, k in enumerate(keys)}
        self.start = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)
        self.lang, c = lang, counts.astype(float)
        self.floor = np.log(0.5 / (np.bincount(lang, weights=c, minlength=langs) + 0.5 * max(len(keys), 1)))
        self.gain = np.log(2 * c + 1)

    def of(self, row: int) -> np.ndarray:
        """The log frequencies of one row."""
        out, own = self.floor.copy(), slice(self.start[row], self.start[row + 1])
        out[self.lang[own]] += self.gain[own]
        return out

    def total(self, rows: np.ndarray, times: np.ndarray) -> np.ndarray:
        """The sum of the rows' log frequencies, each as often as given."""
        at = self.start[rows]
        n = self.start[rows + 1] - at
        i = np.repeat(at - np.cumsum(n) + n, n) + np.arange(int(n.sum()))
        return times.sum() * self.floor + np.bincount(self.lang[i], weights=self.gain[i] * np.repeat(times, n), minlength=len(self.floor))


class Model:
    """Tables of words and of n-grams by length; both as keys, languages a key, and these with their counts."""

    def __init__(self, langs: list[str], words: Sparse, grams: Sparse):
        self.langs = langs
        self.words = Table(*words, len(langs))
        size = np.asarray([len(g) for g in grams[0]], int)
        by_entry = np.repeat(size, grams[1])
        self.grams = {
            n: Table([g for g in grams[0] if len(g) == n], grams[1][size == n], grams[2][by_entry == n], grams[3][by_entry == n], len(langs))
            for n in range(1, LONGEST + 1)
        }
        self.cache: dict[str, np.ndarray] = {}

    def unknown(self, w: str) -> np.ndarray:
        known = self.cache.get(w)
        if known is None:
            if len(self.cache) > min(50_000, CACHED // max(1, len(self.langs))):
                self.cache.clear()
            known = self.cache[w] = self._cover(f"^{w}$")
        return known

    def _cover(self, own: str) -> np.ndarray:
        total, at = np.zeros(len(self.langs)), 0
        while at < len(own):
            for n in range(LONGEST, 0, -1):
                row = self.grams[n].row.get(own[at : at + n]) if at + n <= len(own) else None
                if row is not None:
                    total = total + self.grams[n].of(row) + PENALTY * (LONGEST - n)
                    at += max(1, n - 1)
                    break
            else:
                at += 1
        return total

    def classify(self, text: str | None) -> tuple[str, float]:
        counts = Counter(words_of(text))
        if not counts or not self.langs:
            return "und", 0.0
        rows = [self.words.row.get(w, -1) for w in counts]
        at, times = np.asarray(rows), np.asarray(list(counts.values()), float)
        total = self.words.total(at[at >= 0], times[at >= 0])
        for (w, n), row in zip(counts.items(), rows, strict=True):
            if row < 0:
                total = total + n * self.unknown(w)
        best = int(np.argmax(total))
        return self.langs[best], float(1 / np.exp(total - total[best]).sum())


def fit(labelled: DataFrame, *, text: str = "text", lang: str = "lang", rows: int = ROWS, words: int = WORDS, grams: int = GRAMS) -> Model:
    """The model of the rows whose text and language are not null."""
    own = labelled.select(F.col(lang).alias("lang"), F.col(text).alias("text")).where("lang is not null and text is not null")
    spot = F.xxhash64("text")
    different = own.select("lang", spot.alias("spot")).distinct()
    sizes = sorted(different.groupBy("lang").count().collect(), key=lambda r: r["lang"])
    langs = [r["lang"] for r in sizes]
    if not langs:
        return Model([], _NOTHING, _NOTHING)
    share = own.sparkSession.createDataFrame([(k, r["lang"], min(1.0, rows / r["count"])) for k, r in enumerate(sizes)], "k int, lang string, share double")
    chosen = own.withColumn("spot", spot).join(F.broadcast(share), "lang").where(F.pmod("spot", F.lit(1 << 40)) < F.col("share") * (1 << 40))
    picked = chosen.groupBy("k", "spot").agg(F.first("text").alias("text")).select("k", "text")
    kind = "k int, key string, c long"

    def message(seen: Counter) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(
            [pa.array([k for k, _ in seen], pa.int32()), pa.array([w for _, w in seen], pa.string()), pa.array(list(seen.values()), pa.int64())],
            names=["k", "key", "c"],
        )

    def tally(batches):
        for batch in batches:
            seen: Counter = Counter()
            for k, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                seen.update((k, w) for w in words_of(t))
            yield message(seen)

    def split(batches):
        for batch in batches:
            seen: Counter = Counter()
            for k, w, c in zip(*[x.to_pylist() for x in batch.columns], strict=True):
                for n in range(1, LONGEST + 1):
                    for g in grams_of(w, n):
                        seen[k, g] += c
            yield message(seen)

    def summed(df: DataFrame) -> DataFrame:
        return df.groupBy("k", "key").agg(F.sum("c").alias("c"))

    def top(df: DataFrame, n: int) -> Sparse:
        """The ``n`` keys of the highest rates in some language."""
        rated = df.join(F.broadcast(df.groupBy("k").agg(F.sum("c").alias("all"))), "k")
        by_key = rated.groupBy("key").agg(F.max(F.col("c") / F.col("all")).alias("rate"), F.array_sort(F.collect_list(F.struct("k", "c"))).alias("p"))
        held = by_key.orderBy(F.desc("rate"), "key").limit(n).select("key", "p").toArrow()
        p = held.column("p").combine_chunks()
        p = pa.concat_arrays(p.chunks) if isinstance(p, pa.ChunkedArray) else p
        flat = p.flatten()
        sizes = p.value_lengths().to_numpy(zero_copy_only=False)
        return held.column("key").to_pylist(), sizes, flat.field("k").to_numpy().astype(np.int64), flat.field("c").to_numpy()

    # written, so that each is counted once
    work = Workspace(own.sparkSession, "langid")
    counted = work.put(summed(picked.mapInArrow(tally, kind)).select("k", "key", "c"), "words")
    letters = work.put(summed(counted.mapInArrow(split, kind)), "grams")
    # a language whose texts have no letter has no counts, and would win every unknown word
    seen = sorted(r["k"] for r in counted.select("k").distinct().collect())
    place = np.zeros(len(langs), np.int64)
    place[seen] = np.arange(len(seen))
    moved = lambda t: (t[0], t[1], place[t[2]], t[3])
    return Model([langs[k] for k in seen], moved(top(counted, words)), moved(top(letters, grams)))


def annotate(docs: DataFrame, model: Model, name: str = "language", text: str = "text") -> DataFrame:
    """``docs`` with a struct column (lang, score)."""
    held = docs.sparkSession.sparkContext.broadcast((model.langs, model))
    kind = T.StructType([T.StructField("lang", T.StringType()), T.StructField("score", T.DoubleType())])

    def factory():
        own = held.value[1]

        def run(texts: pa.Array) -> pa.Array:
            found = [own.classify(t) for t in texts.to_pylist()]
            return pa.StructArray.from_arrays(
                [pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64())], names=["lang", "score"]
            )

        return run

    return append_column(docs, name, kind, [text], factory)


def is_held_out(doc_id: Column, folds: int = 5, fold: int = 0) -> Column:
    """Whether crc32 of the id as text falls in the fold; a null id has no fold and is false."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % folds == fold, F.lit(False))


def identify(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", **kw) -> DataFrame:
    """One row per document row: doc_id, held_out, lang_pred, score; learned from the other folds."""
    model = fit(docs.where(~is_held_out(F.col(doc_id))), text=text, lang=lang, **kw)
    own = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    return annotate(own, model, "l").select(
        "doc_id", is_held_out(F.col("doc_id")).alias("held_out"), F.col("l.lang").alias("lang_pred"), F.col("l.score").alias("score")
    )


def keep_identified(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", least: float = 0.5, **kw) -> DataFrame:
    """``docs`` without those in no known language (``und``) or of a score below ``least``."""
    model = fit(docs.where(~is_held_out(F.col(doc_id))), text=text, lang=lang, **kw)
    name = free_name(docs, "language")
    found = annotate(docs, model, name, text)
    return found.where((F.col(name)["lang"] != "und") & (F.col(name)["score"] >= least)).drop(name)


def op6_langid(spark, sf_dir: str) -> DataFrame:
    """The contract's result of ``identify`` over whole documents."""
    return identify(read(spark, sf_dir, "documents", "doc_id", "text", "lang"))
