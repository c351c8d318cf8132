"""Queries of safety and vocabulary over documents, and their SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cuewright.functions import text as X
from cuewright.operators import safety as S
from cuewright.operators import vocabulary as V
from cuewright.operators import words as W
from cuewright.plans.queries_words import _EVENTS, _INSERTED, sound_events
from cuewright.plans.sql import NORM, WORDS_CONV, WORDS_DOC, similarity_sql, vocab_similarity_sql
from cuewright.sources.shared import written
from cuewright.sources.tables import document_tasks, table, words_of_conversations, words_of_documents

Q: dict = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(f):
        Q[name] = f
        if sql is not None:
            SQL[name] = sql
        return f

    return add


#: A lexicon whose entries occur in the test tables.
LEXICON = S.Lexicon(
    words={w: "strong" for w in ("idiot", "moron", "worthless", "trash", "scum", "disgusting")} | {w: "mild" for w in ("stupid", "clown", "loser", "pathetic")},
    phrases={"the the": "mild", "the the the": "mild", "the idiot": "strong"},
    allowlist=("pathetic", "ofth"),
    confusions={"idiot": ["idol", "inlet"], "moron": ["more", "moon"], "trash": ["thrash", "track"], "clown": ["crown"], "the the": ["the"]},
    collocations={"the|the": ["then", "them"], "the|": ["their", "ship"], "|of": ["out", "ending"], "of|the": ["all"]},
    vocabulary=("Thanedble", "Cinmente", "Orantion", "Tiontion"),
)
_LEX = S.Lexicon(LEXICON.words, LEXICON.phrases, LEXICON.allowlist, LEXICON.confusions, LEXICON.collocations, tuple(v.lower() for v in LEXICON.vocabulary))


def _values(rows: list[tuple]) -> str:
    return ", ".join("(" + ", ".join(f"'{x}'" if isinstance(x, str) else str(x).lower() for x in r) + ")" for r in rows)


_KNOWN = sorted({*_LEX.allowlist, *_LEX.vocabulary})
_STEMS = "[token, " + ", ".join(f"CASE WHEN suffix(token, '{s.replace(chr(39), chr(39) * 2)}') AND length(token) - {len(s)} >= 3 THEN left(token, length(token) - {len(s)}) END" for s in X.SUFFIXES) + "]"

_TABLES = f""", lexw(matched, severity) AS (VALUES {_values(list(_LEX.words.items()))}),
 lexp(matched, severity) AS (VALUES {_values(list(_LEX.phrases.items()))}),
 allow(t) AS (VALUES {_values([(a,) for a in _LEX.allowlist])}),
 conf(key, ord, cand) AS (VALUES {_values([(k, i, v) for k, vs in _LEX.confusions.items() for i, v in enumerate(vs)])}),
 coll(key, ord, cand) AS (VALUES {_values([(k, i, v) for k, vs in _LEX.collocations.items() for i, v in enumerate(vs)])}),
 known(cand, ord) AS (VALUES {_values([(k, i) for i, k in enumerate(_KNOWN)])})
"""

_PHRASES = f""", tk0 AS (SELECT *, {NORM.format('word')} AS token FROM words),
 tk AS (SELECT *, lead(token, 1) OVER w AS t1, lead(token, 2) OVER w AS t2 FROM tk0 WINDOW w AS (PARTITION BY job_id ORDER BY word_idx)),
 cand AS (SELECT job_id, word_idx, 3 AS n, matched, severity FROM tk JOIN lexp ON token || ' ' || t1 || ' ' || t2 = matched
  UNION ALL SELECT job_id, word_idx, 2, matched, severity FROM tk JOIN lexp ON token || ' ' || t1 = matched),
 ranked AS (SELECT *, row_number() OVER (PARTITION BY job_id ORDER BY n DESC, word_idx) AS r FROM cand),
 fold AS (SELECT job_id, r, word_idx, n, matched, severity, TRUE AS ok, generate_series(word_idx, word_idx + n - 1) AS taken FROM ranked WHERE r = 1
  UNION ALL SELECT c.job_id, c.r, c.word_idx, c.n, c.matched, c.severity, NOT list_has_any(f.taken, generate_series(c.word_idx, c.word_idx + c.n - 1)),
   CASE WHEN list_has_any(f.taken, generate_series(c.word_idx, c.word_idx + c.n - 1)) THEN f.taken ELSE list_concat(f.taken, generate_series(c.word_idx, c.word_idx + c.n - 1)) END
  FROM fold f JOIN ranked c ON c.job_id = f.job_id AND c.r = f.r + 1),
 ph AS (SELECT job_id, word_idx, word_idx + n AS end_idx, matched, severity FROM fold WHERE ok)
"""

_AFTER_LEXICON = (
    _PHRASES
    + f""", st AS (SELECT token, unnest({_STEMS}) AS stem, generate_subscripts({_STEMS}, 1) AS pos FROM (SELECT DISTINCT token FROM tk WHERE token <> '')),
 kn AS (SELECT token, arg_min(matched, pos) AS matched, arg_min(severity, pos) AS severity FROM st JOIN lexw ON stem = matched GROUP BY token),
 cov AS (SELECT job_id, unnest(generate_series(word_idx, end_idx - 1)) AS word_idx FROM ph),
 h0 AS (SELECT job_id, word_idx, end_idx, 'phrase' AS match_type, matched, severity FROM ph
  UNION ALL SELECT tk.job_id, tk.word_idx, tk.word_idx + 1, 'word', kn.matched, kn.severity FROM tk JOIN kn ON tk.token = kn.token ANTI JOIN cov ON tk.job_id = cov.job_id AND tk.word_idx = cov.word_idx),
 hits AS (SELECT h0.job_id, h0.word_idx, h0.end_idx, match_type, h0.matched, h0.severity, string_agg(word, ' ' ORDER BY tk.word_idx) AS word, min(start_ms) AS start_ms, arg_max(end_ms, tk.word_idx) AS end_ms,
   avg(confidence) AS asr_confidence, bool_or(token IN (SELECT t FROM allow)) OR (match_type = 'word' AND h0.matched IN (SELECT t FROM allow)) AS allowlisted
  FROM h0 JOIN tk ON tk.job_id = h0.job_id AND tk.word_idx >= h0.word_idx AND tk.word_idx < h0.end_idx GROUP BY h0.job_id, h0.word_idx, h0.end_idx, match_type, h0.matched, h0.severity)
"""
)
_HITS = _TABLES + _AFTER_LEXICON
_HIT_COLUMNS = "SELECT job_id, word_idx, end_idx, match_type, matched, severity, word, start_ms, end_ms, round(asr_confidence, 6) AS asr_confidence, allowlisted FROM hits"


def _hits(spark, d) -> DataFrame:
    return S.detect(words_of_documents(spark, d), _LEX)


@query("ngram_phrase_hits", WORDS_DOC + _TABLES + _PHRASES + "SELECT job_id, word_idx, end_idx, matched, severity FROM ph")
def ngram_phrase_hits(spark, d) -> DataFrame:
    found = S.without_overlaps(S.phrase_candidates(words_of_documents(spark, d), _LEX))
    return found.select("job_id", "word_idx", (F.col("word_idx") + F.col("n")).alias("end_idx"), "matched", "severity")


def _shown(hits: DataFrame) -> DataFrame:
    cols = ["job_id", "word_idx", "end_idx", "match_type", "matched", "severity", "word", "start_ms", "end_ms"]
    return hits.select(*cols, F.round("asr_confidence", 6).alias("asr_confidence"), "allowlisted")


@query("word_hits", WORDS_DOC + _HITS + _HIT_COLUMNS)
def word_hits(spark, d) -> DataFrame:
    return _shown(_hits(spark, d))


_ITEM_LEXICON = f""", bt AS (SELECT item_id, list_filter(list_transform(regexp_extract_all(text, '\\S+'), lambda x: {NORM.format('x')}), lambda x: x <> '') AS t FROM benchmark),
 bp AS (SELECT item_id, t, n, unnest(generate_series(1, len(t) - n + 1)) AS p FROM bt, (SELECT unnest([2, 3]) AS n)),
 lexp AS (SELECT array_to_string(t[p:p + n - 1], ' ') AS matched, CASE WHEN min(item_id) % 2 = 0 THEN 'strong' ELSE 'mild' END AS severity FROM bp WHERE len(t) >= n GROUP BY 1),
 lexw AS (SELECT w AS matched, CASE WHEN min(item_id) % 2 = 0 THEN 'strong' ELSE 'mild' END AS severity FROM (SELECT item_id, unnest(t) AS w FROM bt) WHERE length(w) >= 9 GROUP BY 1),
 allow AS (SELECT DISTINCT w AS t FROM (SELECT unnest(t) AS w FROM bt) WHERE length(w) % 5 = 1)
"""


@query("table_lexicon_hits", WORDS_DOC + _ITEM_LEXICON + _AFTER_LEXICON + _HIT_COLUMNS)
def table_lexicon_hits(spark, d) -> DataFrame:
    """Hits of a lexicon that is itself data: runs of two and three words of the benchmark items, and their long words."""
    toks = F.filter(F.transform(X.tokens(F.col("text")), X.normalize_token), lambda x: x != "")
    items = table(spark, d, "benchmark", "item_id", toks.alias("t"))

    def runs(n: int) -> Column:
        starts = F.sequence(F.lit(1), F.greatest(F.size("t") - n + 1, F.lit(1)))
        return F.when(F.size("t") >= n, F.transform(starts, lambda p: F.array_join(F.slice("t", p, n), " "))).otherwise(F.expr("cast(array() as array<string>)"))

    severity = F.when(F.min("item_id") % 2 == 0, "strong").otherwise("mild").alias("severity")
    phrases = items.select("item_id", F.explode(F.concat(runs(2), runs(3))).alias("matched")).groupBy("matched").agg(severity)
    singles = items.select("item_id", F.explode("t").alias("matched"))
    words = singles.where(F.length("matched") >= 9).groupBy("matched").agg(severity)
    allowed = singles.where(F.length("matched") % 5 == 1).select(F.col("matched").alias("term"))
    none = spark.createDataFrame([], "key string, ord int, cand string")
    lexicon = S.LexiconTables(words, written(phrases, "phrases"), allowed, none, none, allowed.limit(0))
    return _shown(S.detect(words_of_documents(spark, d), lexicon))


_SIDES = """, sides AS (SELECT h.job_id, h.word_idx, coalesce((SELECT string_agg(w.word, ' ' ORDER BY w.word_idx) FROM words w WHERE w.job_id = h.job_id AND w.word_idx BETWEEN h.word_idx - 5 AND h.word_idx - 1), '') AS context_before,
 coalesce((SELECT string_agg(w.word, ' ' ORDER BY w.word_idx) FROM words w WHERE w.job_id = h.job_id AND w.word_idx BETWEEN h.end_idx AND h.end_idx + 4), '') AS context_after FROM hits h)
"""


@query("context_windows", WORDS_DOC + _HITS + _SIDES + "SELECT * FROM sides")
def context_windows(spark, d) -> DataFrame:
    return _hits(spark, d).select("job_id", "word_idx", F.array_join("context_before", " ").alias("context_before"), F.array_join("context_after", " ").alias("context_after"))


@query(
    "safety_summary",
    WORDS_DOC + _HITS + """SELECT job_id, count(*) AS hit_count, count(*) FILTER (match_type = 'word') AS word_hits, count(*) FILTER (match_type = 'phrase') AS phrase_hits, count(*) FILTER (allowlisted) AS allowlisted,
 count(*) FILTER (NOT allowlisted AND severity = 'strong') AS strong, count(*) FILTER (NOT allowlisted AND severity = 'mild') AS mild FROM hits GROUP BY job_id""",
)
def safety_summary(spark, d) -> DataFrame:
    return S.summary(_hits(spark, d))


_ALTS = f""", hs AS (SELECT h.*, coalesce(l.token, '') AS lft, coalesce(r.token, '') AS rgt FROM hits h LEFT JOIN tk l ON l.job_id = h.job_id AND l.word_idx = h.word_idx - 1 LEFT JOIN tk r ON r.job_id = h.job_id AND r.word_idx = h.end_idx),
 hx AS (SELECT *, trim(regexp_replace(lower(matched), '[^a-z0-9'']+', '', 'g'), '''') AS tok FROM hs),
 gen AS (SELECT job_id, word_idx, cand, CAST(ord AS BIGINT) AS rank FROM hx JOIN conf ON key = tok
  UNION ALL SELECT job_id, word_idx, cand, {1 * S.RANK} + ord FROM hx JOIN coll ON key = lft || '|' || rgt
  UNION ALL SELECT job_id, word_idx, cand, {2 * S.RANK} + ord FROM hx JOIN coll ON key = lft || '|'
  UNION ALL SELECT job_id, word_idx, cand, {3 * S.RANK} + ord FROM hx JOIN coll ON key = '|' || rgt
  UNION ALL SELECT job_id, word_idx, cand, {4 * S.RANK} + ord FROM hx JOIN known ON {similarity_sql('tok', 'cand')} >= 0.72),
 ded AS (SELECT job_id, word_idx, cand, min(rank) AS rank FROM gen WHERE cand NOT IN (SELECT matched FROM lexw) AND cand NOT IN (SELECT matched FROM lexp) GROUP BY ALL),
 sc AS (SELECT d.*, hx.tok, CASE WHEN EXISTS (SELECT 1 FROM coll c WHERE c.key = lft || '|' || rgt AND c.cand = d.cand) THEN CASE WHEN lft <> '' AND rgt <> '' THEN 0.95 ELSE 0.7 END
   WHEN EXISTS (SELECT 1 FROM coll c WHERE c.key IN (lft || '|', '|' || rgt) AND c.cand = d.cand) THEN 0.7
   WHEN d.cand IN (SELECT cand FROM known) THEN 0.55 ELSE 0.25 END::DOUBLE AS ctx, d.cand IN (SELECT cand FROM known) AS kn, asr_confidence
  FROM ded d JOIN hx ON d.job_id = hx.job_id AND d.word_idx = hx.word_idx WHERE d.cand <> hx.tok),
 alts AS (SELECT job_id, word_idx, cand, rank, round(greatest(0.0::DOUBLE, least(1.0::DOUBLE, 0.30::DOUBLE * ({similarity_sql('tok', 'cand')}) + 0.55::DOUBLE * ctx + CASE WHEN kn THEN 0.1::DOUBLE ELSE 0.0 END + (1.0 - asr_confidence) * 0.15::DOUBLE)), 9) AS score FROM sc)
"""


@query("alternatives_ranked", WORDS_DOC + _HITS + _ALTS + "SELECT job_id, word_idx, cand, rank, round(score, 6) AS score FROM alts")
def alternatives_ranked(spark, d) -> DataFrame:
    return S.alternatives(written(_hits(spark, d), "hits"), _LEX).withColumn("score", F.round("score", 6))


_SHAPE = """regexp_extract(word, '^["''“”‘’(]*') || CASE WHEN regexp_matches(regexp_replace(word, '^["''“”‘’(]+', ''), '^[A-Z]') THEN upper(left(alt, 1)) || substr(alt, 2) ELSE alt END
 || regexp_extract(regexp_replace(word, '^["''“”‘’(]+', ''), '["''“”‘’),:;!?.]*$')"""

_DECIDE = (
    _ALTS
    + f""", best AS (SELECT job_id, word_idx, arg_max(cand, struct_pack(a := score, b := -rank)) AS alt, max(score) AS sc FROM alts WHERE score > 0 GROUP BY ALL),
 dx AS (SELECT h.*, alt, sc, CASE WHEN allowlisted THEN 'a' WHEN sc >= 0.65 AND asr_confidence >= 0.9 AND sc < 0.85 THEN 'u' WHEN sc >= 0.65 THEN 'b' WHEN severity = 'strong' THEN 's' ELSE 'm' END AS k FROM hits h LEFT JOIN best USING (job_id, word_idx)),
 decisions AS (SELECT job_id, word_idx, end_idx, word AS original, start_ms, end_ms, CASE k WHEN 'b' THEN {_SHAPE} WHEN 's' THEN '_' WHEN 'm' THEN '_' ELSE word END AS replacement,
  CASE k WHEN 'a' THEN 'allowlist' WHEN 'u' THEN 'uncertain_high_asr_confidence' WHEN 'b' THEN 'contextual_correction' WHEN 's' THEN 'unresolved_profanity' ELSE 'strict_mild_censor' END AS reason,
  CASE k WHEN 'a' THEN 1.0::DOUBLE WHEN 'u' THEN sc WHEN 'b' THEN round(sc, 4) WHEN 's' THEN 0.35 ELSE 0.3 END AS decision_confidence,
  CASE k WHEN 'a' THEN 'A' WHEN 'u' THEN 'D' WHEN 'b' THEN 'B' ELSE 'C' END AS "case", CASE k WHEN 'a' THEN 'keep' WHEN 'u' THEN 'flag' WHEN 'b' THEN 'replace' ELSE 'censor' END AS action, k IN ('u', 's', 'm') AS needs_review FROM dx)
"""
)


def decisions_of(words: DataFrame) -> DataFrame:
    hits = written(S.detect(words, _LEX), "hits")  # few rows that many joins below read
    return written(S.decide(hits, S.best_alternatives(S.alternatives(hits, _LEX))), "decisions")


def decisions_of_documents(spark, d) -> DataFrame:
    return decisions_of(words_of_documents(spark, d))


@query("safety_decisions", WORDS_DOC + _HITS + _DECIDE + 'SELECT job_id, word_idx, end_idx, original, replacement, reason, round(decision_confidence, 4) AS decision_confidence, "case", action, needs_review FROM decisions')
def safety_decisions(spark, d) -> DataFrame:
    return decisions_of_documents(spark, d).drop("start_ms", "end_ms").withColumn("decision_confidence", F.round("decision_confidence", 4))


@query(
    "apply_decisions",
    WORDS_DOC + _HITS + _DECIDE + """, act AS (SELECT * FROM decisions WHERE action IN ('replace', 'censor')), inn AS (SELECT job_id, unnest(generate_series(word_idx + 1, end_idx - 1)) AS word_idx FROM act WHERE end_idx > word_idx + 1)
SELECT w.job_id, w.word_idx, coalesce(a.replacement, w.word) AS word, coalesce(a.end_ms, w.end_ms) AS end_ms FROM words w ANTI JOIN inn ON w.job_id = inn.job_id AND w.word_idx = inn.word_idx LEFT JOIN act a ON a.job_id = w.job_id AND a.word_idx = w.word_idx""",
)
def apply_decisions(spark, d) -> DataFrame:
    tasks = document_tasks(spark, d)
    words = words_of_documents(spark, d, tasks=tasks)
    return S.apply_decisions(words, decisions_of(words), tasks).select("job_id", "word_idx", "word", "end_ms")


@query(
    "decision_summary",
    WORDS_DOC + _HITS + _DECIDE + "SELECT job_id, count(*) FILTER (action = 'keep') AS kept, count(*) FILTER (action = 'replace') AS replaced, count(*) FILTER (action = 'censor') AS censored, count(*) FILTER (action = 'flag' OR needs_review) AS flagged FROM decisions GROUP BY job_id",
)
def decision_summary(spark, d) -> DataFrame:
    return S.decision_summary(decisions_of_documents(spark, d))


@query(
    "decisions_among_events",
    WORDS_DOC + _HITS + _DECIDE + ", " + _EVENTS + _INSERTED
    + """SELECT d.job_id, f.word_idx, l.word_idx + 1 AS end_idx, d.original, d.action FROM decisions d
JOIN merged f ON f.job_id = d.job_id AND f.old_idx = d.word_idx JOIN merged l ON l.job_id = d.job_id AND l.old_idx = d.end_idx - 1""",
)
def decisions_among_events(spark, d) -> DataFrame:
    """Decisions with the indices that words have once sound events stand between them."""
    tasks = document_tasks(spark, d)
    words = words_of_documents(spark, d, tasks=tasks)
    placed = W.events_among(words, W.filter_events(sound_events(spark, d)), tasks=tasks)
    return W.carry_indices(decisions_of(words), placed).select("job_id", "word_idx", "end_idx", "original", "action")


_CATEGORY = ", ".join(f"'{c}'" for c in V.CATEGORIES)


@query(
    "vocab_merge",
    f"""WITH w AS (SELECT doc_id, regexp_extract_all(text, '\\S+') AS w FROM documents), t AS (SELECT doc_id % 3 AS layer, doc_id AS ord, array_to_string(w[1:2], ' ') AS term, list_value({_CATEGORY})[doc_id % 9 + 1] AS category,
  array_to_string(list_filter(list_transform(w[1:2], lambda x: {NORM.format('x')}), lambda x: x <> ''), ' ') AS key FROM w),
 p AS (SELECT *, layer * 10000000000 + ord AS pos FROM t WHERE key <> '')
SELECT key, arg_max(term, pos) AS term, arg_max(category, pos) AS category, CAST(min(pos) AS BIGINT) AS position FROM p WHERE key NOT IN (SELECT key FROM p WHERE ord % 11 = 0) GROUP BY key""",
)
def vocab_merge(spark, d) -> DataFrame:
    """Layers of the documents' first two words; terms of every eleventh document are removed again."""
    i, cats = F.col("doc_id"), F.array(*[F.lit(c) for c in V.CATEGORIES])
    term = F.array_join(F.slice(X.tokens(F.col("text")), 1, 2), " ")
    layers = table(spark, d, "documents", (i % 3).alias("layer"), i.alias("ord"), term.alias("term"), F.get(cats, (i % 9).cast("int")).alias("category"))
    out = V.merge_layers(layers, layers.where("ord % 11 = 0"))
    return out.withColumn("position", (F.col("position.layer") * 10_000_000_000 + F.col("position.ord")).cast("long"))


_TERMS = [(t, i) for i, t in enumerate(LEXICON.vocabulary)]


@query(
    "vocab_fuzzy",
    WORDS_DOC
    + f""", terms(term, ord) AS (VALUES {_values(_TERMS)}), t AS (SELECT DISTINCT {NORM.format('word')} AS token FROM words),
 s AS (SELECT token, term, ord, round({vocab_similarity_sql('token', 'lower(term)')}, 9) AS score FROM t, terms WHERE token <> ''),
 b AS (SELECT token, arg_max(term, struct_pack(a := score, b := -ord)) AS term, max(score) AS score FROM s WHERE score >= 0.84 GROUP BY token)
SELECT job_id, word_idx, CASE WHEN word = upper(word) AND word <> lower(word) THEN upper(term) WHEN left(word, 1) = upper(left(word, 1)) AND left(word, 1) <> lower(left(word, 1)) THEN upper(left(term, 1)) || substr(term, 2) ELSE term END AS word, round(score, 6) AS score
FROM words JOIN b ON {NORM.format('word')} = b.token WHERE score >= 0.999 OR confidence < 0.97""",
)
def vocab_fuzzy(spark, d) -> DataFrame:
    words = words_of_documents(spark, d, by_job=False)
    terms = spark.createDataFrame(_TERMS, "term string, ord int")
    # a key that cannot be null is not computed a second time to test it
    tok = words.withColumn("token", F.coalesce(X.normalize_token(F.col("word")), F.lit("")))
    best = V.best_terms(tok.select("token"), terms)
    hit = tok.join(best, "token").where("score >= 0.999 or confidence < 0.97 or confidence is null")
    return hit.select("job_id", "word_idx", X.canonical(F.col("term"), F.col("word")).alias("word"), F.round("score", 6).alias("score"))


@query(
    "vocab_apply",
    WORDS_CONV
    + f""", terms(term, ord) AS (VALUES {_values(_TERMS)}), t AS (SELECT DISTINCT {NORM.format('word')} AS token FROM words),
 s AS (SELECT token, term, ord, round({vocab_similarity_sql('token', 'lower(term)')}, 9) AS score FROM t, terms WHERE token <> ''),
 b AS (SELECT token, arg_max(term, struct_pack(a := score, b := -ord)) AS term, max(score) AS score FROM s WHERE score >= 0.84 GROUP BY token)
SELECT job_id, word_idx, CASE WHEN b.term IS NULL OR NOT (score >= 0.999 OR confidence < 0.97) THEN word WHEN word = upper(word) AND word <> lower(word) THEN upper(term) WHEN left(word, 1) = upper(left(word, 1)) AND left(word, 1) <> lower(left(word, 1)) THEN upper(left(term, 1)) || substr(term, 2) ELSE term END AS word
FROM words LEFT JOIN b ON {NORM.format('word')} = b.token""",
)
def vocab_apply(spark, d) -> DataFrame:
    terms = spark.createDataFrame(_TERMS, "term string, ord int")
    return V.apply_terms(words_of_conversations(spark, d), terms).select("job_id", "word_idx", "word")


_VPHRASES = ["the inthe", "of the thing", "the the"]


def _vphrase_sql() -> str:
    ranked = sorted(enumerate(_VPHRASES), key=lambda p: (-len(p[1].split()), p[0]))
    cands = []
    for order, (_, p) in enumerate(ranked):
        parts = p.split()
        cols = ["token", "t1", "t2"]
        cond = " AND ".join(f"{vocab_similarity_sql(cols[i], chr(39) + w + chr(39))} >= 0.84" for i, w in enumerate(parts))
        cands.append(f"SELECT job_id, word_idx, {len(parts)} AS n, {order} AS ord, '{p}' AS term, word FROM vt WHERE {cond}")
    return f""", vt0 AS (SELECT *, {NORM.format('word')} AS token FROM words),
 vt AS (SELECT *, lead(token, 1) OVER w AS t1, lead(token, 2) OVER w AS t2 FROM vt0 WINDOW w AS (PARTITION BY job_id ORDER BY word_idx)),
 cand AS ({" UNION ALL ".join(cands)}), ranked AS (SELECT *, row_number() OVER (PARTITION BY job_id ORDER BY ord, word_idx) AS r FROM cand),
 fold AS (SELECT job_id, r, word_idx, n, ord, term, word, TRUE AS ok, generate_series(word_idx, word_idx + n - 1) AS taken FROM ranked WHERE r = 1
  UNION ALL SELECT c.job_id, c.r, c.word_idx, c.n, c.ord, c.term, c.word, NOT list_has_any(f.taken, generate_series(c.word_idx, c.word_idx + c.n - 1)),
   CASE WHEN list_has_any(f.taken, generate_series(c.word_idx, c.word_idx + c.n - 1)) THEN f.taken ELSE list_concat(f.taken, generate_series(c.word_idx, c.word_idx + c.n - 1)) END
  FROM fold f JOIN ranked c ON c.job_id = f.job_id AND c.r = f.r + 1),
 spans AS (SELECT job_id, word_idx, n, CASE WHEN word = upper(word) AND word <> lower(word) THEN upper(term) WHEN regexp_matches(word, '^[A-Z]') THEN upper(left(term, 1)) || substr(term, 2) ELSE term END AS term FROM fold WHERE ok)
"""


@query("vocab_phrases", WORDS_CONV + _vphrase_sql() + "SELECT * FROM spans")
def vocab_phrases(spark, d) -> DataFrame:
    return V.phrase_matches(words_of_conversations(spark, d), _VPHRASES).select("job_id", "word_idx", "n", "term")


@query(
    "vocab_apply_phrases",
    WORDS_CONV + _vphrase_sql()
    + f""", terms(term, ord) AS (VALUES {_values(_TERMS)}), t AS (SELECT DISTINCT {NORM.format('word')} AS token FROM words),
 s AS (SELECT token, term, ord, round({vocab_similarity_sql('token', 'lower(term)')}, 9) AS score FROM t, terms WHERE token <> ''),
 b AS (SELECT token, arg_max(term, struct_pack(a := score, b := -ord)) AS term, max(score) AS score FROM s WHERE score >= 0.84 GROUP BY token),
 used AS (SELECT job_id, word_idx AS first, term, n, unnest(generate_series(word_idx, word_idx + n - 1)) AS word_idx FROM spans)
SELECT w.job_id, w.word_idx, CASE WHEN u.first IS NULL THEN w.end_ms ELSE l.end_ms END AS end_ms,
 CASE WHEN u.first IS NOT NULL THEN u.term WHEN b.term IS NULL OR NOT (score >= 0.999 OR w.confidence < 0.97) THEN w.word WHEN w.word = upper(w.word) AND w.word <> lower(w.word) THEN upper(b.term)
  WHEN left(w.word, 1) = upper(left(w.word, 1)) AND left(w.word, 1) <> lower(left(w.word, 1)) THEN upper(left(b.term, 1)) || substr(b.term, 2) ELSE b.term END AS word
FROM words w LEFT JOIN used u ON u.job_id = w.job_id AND u.word_idx = w.word_idx LEFT JOIN words l ON l.job_id = u.job_id AND l.word_idx = u.first + u.n - 1 LEFT JOIN b ON {NORM.format('w.word')} = b.token
WHERE u.first IS NULL OR u.first = w.word_idx""",
)
def vocab_apply_phrases(spark, d) -> DataFrame:
    """``vocab_apply`` with terms of several words as well."""
    every = [*LEXICON.vocabulary, *_VPHRASES]
    terms = spark.createDataFrame([(t, i) for i, t in enumerate(every)], "term string, ord int")
    return V.apply_terms(words_of_conversations(spark, d), terms).select("job_id", "word_idx", "end_ms", "word")
