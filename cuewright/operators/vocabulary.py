"""Vocabularies: layered merges with tombstones, and near-miss replacement of words."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cuewright.functions import text as X
from cuewright.operators.folds import number
from cuewright.operators.near import near_pairs
from cuewright.operators.safety import without_overlaps
from cuewright.sources.shared import written

# categories in their listing order (fixed values)
CATEGORIES = ["character_names", "people", "locations", "games", "toys", "fictional", "brands", "phrases", "other"]


def merge_layers(layers: DataFrame, removed: DataFrame) -> DataFrame:
    """Later layers overwrite term and category, positions stay; removed terms go.

    ``layers``: layer, ord, term, category. Terms are the same if their normalised phrases are.
    """
    keyed = layers.withColumn("key", X.normalize_phrase(F.col("term"))).where("key <> ''")
    kept = keyed.groupBy("key").agg(F.max_by(F.struct("term", "category"), F.struct("layer", "ord")).alias("t"), F.min(F.struct("layer", "ord")).alias("position"))
    gone = removed.select(X.normalize_phrase(F.col("term")).alias("key")).distinct()
    return kept.join(gone, "key", "left_anti").select("key", "t.term", "t.category", "position")


def replay(log: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Entries (key, term, category, position) and tombstones (key, term, position) after a log of additions and removals.

    ``log``: seq, action (add or remove), term, category. An added term that is there changes its
    spelling and category and keeps its place; one that was removed comes back at the end.
    """
    term = X.collapse(F.coalesce("term", F.lit("")))
    known = F.when(F.col("category").isin(*CATEGORIES), F.col("category")).otherwise("other")
    rows = log.select("seq", "action", term.alias("term"), known.alias("category")).withColumn("key", X.normalize_phrase(F.col("term"))).where("key <> ''")
    by = Window.partitionBy("key").orderBy("seq").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    last = lambda a: F.coalesce(F.max(F.when(F.col("action") == a, F.col("seq"))).over(by), F.lit(-1))
    rows = rows.withColumns({"added_": last("add"), "removed_": last("remove")})
    alive = rows.where((F.col("action") == "add") & (F.col("added_") > F.col("removed_")) & (F.col("seq") > F.col("removed_")))
    gone = rows.where((F.col("action") == "remove") & (F.col("removed_") > F.col("added_")) & (F.col("seq") > F.col("added_")))
    entries = alive.groupBy("key").agg(F.max_by(F.struct("term", "category"), "seq").alias("t"), F.min("seq").alias("position")).select("key", "t.*", "position")
    return entries, gone.groupBy("key").agg(F.min_by("term", "seq").alias("term"), F.min("seq").alias("position"))


def _text(v: Column) -> Column:
    """A variant as text; other scalars as JSON writes them."""
    return F.coalesce(F.try_variant_get(v, "$", "string"), F.when(~F.is_variant_null(v), F.to_json(v)))


def _listed(payloads: DataFrame, field: str) -> DataFrame:
    held = payloads.select("ord", F.try_parse_json("json").alias("p"))
    return held.select("ord", F.posexplode(F.try_variant_get("p", f"$.{field}", "array<variant>")).alias("i", "v"))


def imported(payloads: DataFrame) -> DataFrame:
    """A log (seq, action, term, category) of vocabulary payloads, for ``replay``. ``payloads``: ord, json.

    A payload may list entries as texts or objects, terms, and terms by category, in any mixture.
    Terms without a category are ``other``, and a later mention overwrites an earlier. A payload's
    removed terms take nothing away on import (see ``removed_terms``). Payloads that are no JSON
    objects, nulls and blank terms add nothing.
    """
    entry = F.when(F.schema_of_variant("v").startswith("OBJECT"), F.struct(F.try_variant_get("v", "$.term", "string").alias("term"), F.try_variant_get("v", "$.category", "string").alias("category")))
    entry = entry.otherwise(F.struct(_text(F.col("v")).alias("term"), F.lit(None).cast("string").alias("category")))
    one = _listed(payloads, "entries").select("ord", F.lit(0).alias("k"), F.lit("").alias("j"), "i", entry.alias("e")).select("ord", "k", "j", "i", "e.term", "e.category")
    two = _listed(payloads, "terms").select("ord", F.lit(1).alias("k"), F.lit("").alias("j"), "i", _text(F.col("v")).alias("term"), F.lit(None).cast("string").alias("category"))
    held = payloads.select("ord", F.try_variant_get(F.try_parse_json("json"), "$.grouped", "map<string,variant>").alias("g"))
    groups = held.select("ord", F.explode("g").alias("j", "g")).select("ord", "j", F.posexplode(F.try_variant_get("g", "$", "array<variant>")).alias("i", "v"))
    three = groups.select("ord", F.lit(2).alias("k"), "j", "i", _text(F.col("v")).alias("term"), F.col("j").alias("category"))
    rows = one.unionByName(two).unionByName(three).where(X.collapse(F.coalesce("term", F.lit(""))) != "")
    order = [F.col(c) for c in ("ord", "k", "j", "i")]  # an object's keys have no order of their own
    return number(rows, order, "seq").select("seq", F.lit("add").alias("action"), "term", F.coalesce("category", F.lit("other")).alias("category"))


def removed_terms(payloads: DataFrame) -> DataFrame:
    """(term, position): the distinct removed terms that payloads note, normalised and in alphabetical order."""
    terms = _listed(payloads, "removed").select(X.normalize_phrase(_text(F.col("v"))).alias("term")).where("term <> ''").distinct()
    return number(terms, [F.col("term")], "position")


def by_category(vocabulary: DataFrame, categories: list[str]) -> DataFrame:
    """Terms of every category in the fixed order, empty ones included."""
    spark = vocabulary.sparkSession
    listed = spark.createDataFrame(list(enumerate(categories)), "category_position int, category string")
    terms = vocabulary.groupBy("category").agg(F.transform(F.array_sort(F.collect_list(F.struct("position", "term"))), lambda x: x["term"]).alias("terms"))
    return listed.join(terms, "category", "left").withColumn("terms", F.coalesce("terms", F.expr("cast(array() as array<string>)")))


def hints(vocabulary: DataFrame, limit: int = 40) -> DataFrame:
    """The first distinct terms, as hints to a speech recogniser."""
    return vocabulary.orderBy("position").limit(limit)


def best_terms(tokens: DataFrame, terms: DataFrame, threshold: float = 0.84) -> DataFrame:
    """(token, term, score): the best term of each token at or above the threshold, once for equal tokens.

    The first term wins ties. The result is written to the shared folder: few tokens are near a
    term, and with its size known words meet it without a shuffle on their tokens, some of which
    are very frequent, unless it is too large to broadcast.
    """
    t = terms.select(F.col("term").alias("shown_"), "ord", X.normalize_token(F.col("term")).alias("term"))
    rows = near_pairs(tokens, t.select("term"), threshold).join(t, "term")
    best = rows.groupBy("token").agg(F.max_by(F.struct(F.col("shown_").alias("term"), "score"), F.struct("score", (-F.col("ord")).alias("o"))).alias("b"))
    return written(best.select("token", "b.*"), "terms")


def apply_terms(words: DataFrame, terms: DataFrame, threshold: float = 0.84) -> DataFrame:
    """Near misses become vocabulary terms: exact ones always, others below 0.97 confidence.

    Terms of several words go first, whatever the confidence: a span becomes one word, with
    the index, start, confidence and speaker of its first word and the end of its last. Single
    words then match where no span is.
    """
    several = F.trim(F.col("term")).contains(" ")
    tok = words.withColumn("token", F.coalesce(X.normalize_token(F.col("word")), F.lit("")))
    phrases = terms.where(several)
    if not phrases.isEmpty():
        spans = without_overlaps(_span_candidates(words, _ranked(phrases), threshold), "rank")
        spans = written(spans, "spans")
        used = spans.select("job_id", F.explode(F.sequence("word_idx", F.col("word_idx") + F.col("n") - 1)).alias("word_idx"), F.col("word_idx").alias("start_"), "shown", "end_")
        tok = tok.join(used, ["job_id", "word_idx"], "left").where("start_ is null or start_ = word_idx")
        taken = F.col("start_").isNotNull()
        tok = tok.withColumns(
            {"word": F.when(taken, F.col("shown")).otherwise(F.col("word")), "end_ms": F.when(taken, F.col("end_")).otherwise(F.col("end_ms")), "token": F.when(~taken, F.col("token"))}
        ).select(*words.columns, "token")
    best = best_terms(tok.select("token"), terms.where(~several), threshold)
    sure = (F.col("score") >= 0.999) | F.col("confidence").isNull() | (F.col("confidence") < 0.97)
    out = tok.join(best, "token", "left")
    return out.withColumn("word", F.when(sure & F.col("term").isNotNull(), X.canonical(F.col("term"), F.col("word"))).otherwise(F.col("word"))).select(*words.columns)


def _ranked(terms: DataFrame) -> DataFrame:
    """(rank, term, parts): terms of several words by the order in which they match, longer ones first.

    ``terms``: term, ord. A term with a word that normalises to nothing never matches.
    """
    parts = F.transform(X.tokens(F.col("term")), X.normalize_token)
    rows = terms.select("term", "ord", parts.alias("parts")).where(~F.array_contains("parts", ""))
    # one number orders them: lengths first, then the listing order
    return rows.select((F.lit(-(1 << 40)) * F.size("parts") + F.col("ord")).alias("rank"), "term", "parts")


def _span_candidates(words: DataFrame, ranked: DataFrame, threshold: float) -> DataFrame:
    """(job_id, word_idx, n, rank, term, shown, end_) of all terms of several words that match, overlaps included.

    A term meets the words at its anchor only, its word with the fewest near occurrences; one
    window then shows each such word its neighbours, and the term's other words are compared
    there. Words are read twice (once for their counts), however many terms there are. Word
    indices are dense.
    """
    tok = words.select("job_id", "word_idx", "word", "end_ms", F.coalesce(X.normalize_token(F.col("word")), F.lit("")).alias("token"))
    counts = written(tok.groupBy("token").agg(F.count("*").alias("n_")), "tokens")
    parts = ranked.select("rank", F.size("parts").alias("n"), F.posexplode("parts").alias("i", "part"))
    near = written(near_pairs(counts.select("token"), parts.select(F.col("part").alias("term")), threshold), "near")
    weight = near.join(counts, "token").groupBy(F.col("term").alias("part")).agg(F.sum("n_").alias("w_"))
    # a term with a word that is near to none cannot match, so it has no anchor
    anchors = parts.join(weight, "part").groupBy("rank").agg(F.min(F.struct("w_", "i", "part")).alias("a"), F.count("*").alias("found_"), F.first("n").alias("n")).where("found_ = n")
    anchored = anchors.select("rank", "n", "a.i", "a.part").join(near.select("token", F.col("term").alias("part")), "part").join(ranked, "rank")
    anchored = written(anchored.select("token", "rank", "n", "i", "term", "parts"), "anchors")
    longest = anchored.agg(F.max("n")).first()[0] or 1
    frame = Window.partitionBy("job_id").orderBy("word_idx").rowsBetween(1 - longest, longest - 1)
    rows = tok.select("job_id", "word_idx", "token", F.collect_list(F.struct("word_idx", "word", "token", "end_ms")).over(frame).alias("around"))
    met = rows.join(anchored, "token").withColumn("start_", F.col("word_idx") - F.col("i"))
    met = met.withColumn("span", F.filter("around", lambda x: (x["word_idx"] >= F.col("start_")) & (x["word_idx"] < F.col("start_") + F.col("n"))))
    alike = F.zip_with("span", "parts", lambda x, p: F.round(X.vocabulary_similarity(x["token"], p), 9) >= threshold)
    hits = met.where((F.size("span") == F.col("n")) & F.forall(alike, lambda ok: ok))
    return hits.select("job_id", F.col("start_").alias("word_idx"), "n", "rank", "term", X.canonical(F.col("term"), F.col("span")[0]["word"]).alias("shown"), F.element_at("span", -1)["end_ms"].alias("end_"))


def phrase_matches(words: DataFrame, phrases: list[str] | DataFrame, threshold: float = 0.84) -> DataFrame:
    """(job_id, word_idx, n, rank, term) of phrases whose every token is similar enough, overlaps resolved.

    Longer phrases go first, then listed ones, then the leftmost. ``phrases``: texts, or a table (term, ord).
    """
    if isinstance(phrases, list):
        phrases = words.sparkSession.createDataFrame([(p, i) for i, p in enumerate(phrases)], "term string, ord int")
    kept = without_overlaps(_span_candidates(words, _ranked(phrases), threshold), "rank")
    return kept.select("job_id", "word_idx", "n", "rank", F.col("shown").alias("term"))


__all__ = ["CATEGORIES", "apply_terms", "best_terms", "by_category", "hints", "merge_layers", "phrase_matches", "without_overlaps"]
