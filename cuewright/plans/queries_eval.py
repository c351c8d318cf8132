"""Queries of the evaluation operators, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cuewright.functions import text as X
from cuewright.operators import evaluation as E
from cuewright.operators import safety as S
from cuewright.plans.queries_safety import _HITS, _LEX, _hits, decisions_of, decisions_of_documents, _DECIDE
from cuewright.plans.sql import NORM, WORDS_DOC
from cuewright.sources.tables import document_tasks, table, words_of_documents
from cuewright.streaming.sessions import pause_sessions

Q: dict = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(f):
        Q[name] = f
        if sql is not None:
            SQL[name] = sql
        return f

    return add


def _altered(k, word):
    """Every seventh token altered, every eleventh dropped."""
    return F.when(k % 11 == 10, None).when(k % 7 == 6, F.concat(word, F.lit("x"))).otherwise(word)


def _pairs(spark, d) -> DataFrame:
    items = table(spark, d, "benchmark", "item_id", "text")
    w = F.transform(X.tokens(F.col("text")), lambda t, i: _altered(i, t))
    return items.select(F.col("item_id").alias("id"), F.col("text").alias("reference"), F.array_join(w, " ").alias("hypothesis"))


_PAIRS = """WITH RECURSIVE w AS (SELECT item_id AS id, text, regexp_extract_all(text, '\\S+') AS ws FROM benchmark),
 p AS (SELECT id, text AS reference, array_to_string(list_filter(list_transform(generate_series(0, len(ws) - 1), lambda k: CASE WHEN k % 11 = 10 THEN NULL WHEN k % 7 = 6 THEN ws[k + 1] || 'x' ELSE ws[k + 1] END), lambda x: x IS NOT NULL), ' ') AS hypothesis FROM w),
 t AS (SELECT id, regexp_extract_all(lower(reference), '[a-z0-9'']+') AS r, regexp_extract_all(lower(hypothesis), '[a-z0-9'']+') AS h FROM p),
 u AS (SELECT *, list_sort(list_distinct(list_concat(r, h))) AS v FROM t),
 c AS (SELECT *, CAST(levenshtein(array_to_string(list_transform(r, lambda x: chr(CAST(32 + list_position(v, x) AS INT))), ''), array_to_string(list_transform(h, lambda x: chr(CAST(32 + list_position(v, x) AS INT))), '')) AS BIGINT) AS distance,
  CAST(levenshtein(array_to_string(r, ''), array_to_string(h, '')) AS BIGINT) AS cd FROM u)
"""


@query(
    "wer_cer",
    _PAIRS + """SELECT id, round(distance / greatest(len(r), 1), 4) AS wer, distance, CAST(len(r) AS BIGINT) AS reference_words, CAST(len(h) AS BIGINT) AS hypothesis_words,
 round(cd / greatest(length(array_to_string(r, '')), 1), 4) AS cer, cd AS cer_distance, CAST(length(array_to_string(r, '')) AS BIGINT) AS reference_chars FROM c""",
)
def wer_cer(spark, d) -> DataFrame:
    return E.error_rates(_pairs(spark, d))


#: other scores of an item, as numerators over a hundred; each null for some items
_SCORES = {
    "low_confidence_rate": "id * 7 % 101", "profanity_false_positive_rate": "id * 3 % 41", "profanity_false_negative_rate": "id * 11 % 67", "correction_accuracy": "id * 5 % 97", "censorship_rate": "id * 13 % 31",
    "mean_cps": "id * 17 % 1900", "within_200ms": "id * 19 % 99", "mean_onset_error_s": "id * 23 % 45",
}
_MEANS = ", ".join(f"round(CAST(sum(CAST(({x}) / 100.0 AS DECIMAL(20, 4))) FILTER (id % {k + 4} > 0) AS DOUBLE) / count(*) FILTER (id % {k + 4} > 0), 4) AS {c if c.startswith('mean') else 'mean_' + c.replace('within', 'timestamp_within')}" for k, (c, x) in enumerate(_SCORES.items()))


@query(
    "evaluation_rollup",
    _PAIRS + f"""SELECT CAST(id % 3 AS BIGINT) AS config, count(*) AS clips, round(sum(distance) / greatest(sum(len(r)), 1), 4) AS wer, round(sum(cd) / greatest(sum(length(array_to_string(r, ''))), 1), 4) AS cer, CAST(sum(len(r)) AS BIGINT) AS reference_words,
 {_MEANS}, CAST(sum(id % 5) AS BIGINT) AS reading_speed_warnings FROM c GROUP BY id % 3""",
)
def evaluation_rollup(spark, d) -> DataFrame:
    """``rollup`` of the items' error rates, with other scores that are numbers of the item."""
    scores = E.error_rates(_pairs(spark, d)).withColumns({c: F.expr(f"case when id % {k + 4} > 0 then cast(({x}) / 100.0 as double) end") for k, (c, x) in enumerate(_SCORES.items())})
    return E.rollup(scores.withColumns({"reading_speed_warnings": F.col("id") % 5, "config": F.col("id") % 3}), "config")


def _clip_words(spark, d) -> tuple[DataFrame, DataFrame]:
    """Reference and altered words of benchmark items; the latter start up to 240 ms later."""
    items = table(spark, d, "benchmark", "item_id", "text")
    ref = items.select(F.col("item_id").alias("job_id"), F.posexplode(X.tokens(F.col("text"))).alias("i", "word"))
    k = F.col("i").cast("long")
    conf = ((F.col("job_id") * 31 + k * 17) % 101) / F.lit(100.0)
    ref = ref.select("job_id", k.alias("word_idx"), "word", (400 * k).alias("start_ms"), (400 * k + 300).alias("end_ms"), conf.alias("confidence"), F.lit(None).cast("string").alias("speaker"))
    late = F.col("word_idx") % 5 * 60
    hyp = ref.withColumn("word", _altered(F.col("word_idx"), F.col("word"))).where("word is not null")
    return ref, hyp.withColumn("start_ms", F.col("start_ms") + late).withColumn("end_ms", F.col("end_ms") + late)


_ALIGNED = f"""WITH RECURSIVE tw AS (SELECT item_id AS job_id, unnest(w) AS word, generate_subscripts(w, 1) - 1 AS k FROM (SELECT item_id, regexp_extract_all(text, '\\S+') AS w FROM benchmark)),
 rw AS (SELECT job_id, k, 400 * k AS s, 400 * k + 300 AS e, {NORM.format('word')} AS t FROM tw),
 hw AS (SELECT job_id, k, 400 * k + k % 5 * 60 AS s, 400 * k + 300 + k % 5 * 60 AS e, {NORM.format("CASE WHEN k % 7 = 6 THEN word || 'x' ELSE word END")} AS t FROM tw WHERE k % 11 <> 10),
 ab AS (SELECT * FROM (SELECT job_id, list(t ORDER BY k) AS a, list(s ORDER BY k) AS as_, list(e ORDER BY k) AS ae FROM rw GROUP BY job_id) JOIN (SELECT job_id, list(t ORDER BY k) AS b, list(s ORDER BY k) AS bs, list(e ORDER BY k) AS be FROM hw GROUP BY job_id) USING (job_id)),
 dp AS (SELECT job_id, 0 AS i, generate_series(0, len(b)) AS d, a, b FROM ab
  UNION ALL SELECT job_id, i + 1, list_transform(q, lambda x, j: j - 1 + list_min(list_transform(q[1:j], lambda y, m: y - (m - 1)))), a, b
  FROM (SELECT *, list_transform(d, lambda x, j: CASE WHEN j = 1 THEN CAST(i + 1 AS BIGINT) ELSE least(x + 1, d[j - 1] + CASE WHEN a[i + 1] = b[j - 1] THEN 0 ELSE 1 END) END) AS q FROM dp WHERE i < len(a))),
 path AS (SELECT job_id, CAST(len(a) AS INT) AS i, CAST(len(b) AS INT) AS j, FALSE AS met FROM ab
  UNION ALL SELECT job_id, CASE WHEN step = 'i' THEN i ELSE i - 1 END, CASE WHEN step = 'd' THEN j ELSE j - 1 END, step = 'm'
  FROM (SELECT p.*, CASE WHEN h.d[j + 1] = u.d[j] + CASE WHEN h.a[p.i] = h.b[j] THEN 0 ELSE 1 END THEN 'm' WHEN h.d[j + 1] = u.d[j + 1] + 1 THEN 'd' ELSE 'i' END AS step
   FROM path p JOIN dp h ON h.job_id = p.job_id AND h.i = p.i JOIN dp u ON u.job_id = p.job_id AND u.i = p.i - 1 WHERE p.i > 0 AND p.j > 0)),
 er AS (SELECT job_id, abs(as_[i + 1] - bs[j + 1]) AS so, abs(ae[i + 1] - be[j + 1]) AS eo FROM path JOIN ab USING (job_id) WHERE met AND a[i + 1] = b[j + 1] AND a[i + 1] <> ''),
 su AS (SELECT ab.job_id, count(so) AS n, sum(so) AS so, sum(eo) AS eo, count(*) FILTER (so <= 200 AND eo <= 200) AS near FROM ab LEFT JOIN er ON er.job_id = ab.job_id GROUP BY ab.job_id)
SELECT job_id, n AS pairs_compared, coalesce(round(CAST(so AS DOUBLE) / nullif(n, 0) / 1000, 4), 0.0::DOUBLE) AS mean_onset_error_s, coalesce(round(CAST(eo AS DOUBLE) / nullif(n, 0) / 1000, 4), 0.0::DOUBLE) AS mean_offset_error_s,
 coalesce(round(CAST(near AS DOUBLE) / nullif(n, 0), 4), 1.0::DOUBLE) AS within_200ms FROM su
"""


@query("timestamp_accuracy", _ALIGNED)
def timestamp_accuracy(spark, d) -> DataFrame:
    return E.timestamp_accuracy(*_clip_words(spark, d))


@query(
    "safety_rates",
    WORDS_DOC + _HITS + f""", fl AS (SELECT job_id, list_distinct(list(replace(matched, ' ', ''))) AS f FROM hits WHERE NOT allowlisted GROUP BY job_id),
 gold AS (SELECT ['idiot', 'moron', 'trash'] AS p, ['stupid', 'thethe'] AS c)
SELECT job_id AS id, round(len(list_intersect(f, c)) / 2, 4) AS profanity_false_positive_rate, round((3 - len(list_intersect(f, p))) / 3, 4) AS profanity_false_negative_rate, CAST(len(list_intersect(f, p)) AS BIGINT) AS true_positives,
 CAST(len(list_intersect(f, c)) AS BIGINT) AS false_positives, CAST(3 - len(list_intersect(f, p)) AS BIGINT) AS false_negatives, CAST(3 AS BIGINT) AS gold_profane, CAST(2 AS BIGINT) AS gold_clean, CAST(len(f) AS BIGINT) AS flagged FROM fl, gold""",
)
def safety_rates(spark, d) -> DataFrame:
    found = _hits(spark, d).where("not allowlisted").groupBy(F.col("job_id").alias("id")).agg(F.collect_set("matched").alias("flagged"))
    gold = found.withColumn("profane", F.expr("array('Idiot', 'moron!', 'trash')")).withColumn("clean", F.expr("array('stupid', 'the the')"))
    return E.safety_rates(gold)


@query(
    "toxic_flags",
    WORDS_DOC + _HITS + """, f AS (SELECT job_id, count(*) FILTER (NOT allowlisted) > 0 AS flagged FROM hits GROUP BY job_id)
SELECT l.toxic, count(*) AS docs, count(*) FILTER (coalesce(f.flagged, FALSE)) AS flagged FROM labels l LEFT JOIN f ON f.job_id = l.doc_id GROUP BY l.toxic""",
)
def toxic_flags(spark, d) -> DataFrame:
    """Flagged documents by gold label."""
    found = _hits(spark, d).groupBy(F.col("job_id").alias("doc_id")).agg((F.count_if(~F.col("allowlisted")) > 0).alias("f"))
    rows = table(spark, d, "labels", "doc_id", "toxic").join(found, "doc_id", "left")
    return rows.groupBy("toxic").agg(F.count("*").alias("docs"), F.count_if(F.coalesce("f", F.lit(False))).alias("flagged"))


@query(
    "correction_accuracy",
    """WITH w AS (SELECT doc_id AS id, list_transform(regexp_extract_all(text, '\\S+'), lambda x: trim(regexp_replace(replace(lower(x), '’', ''''), '[^a-z0-9'']+', '', 'g'), '''')) AS t FROM documents),
 c AS (SELECT id, CAST(list_contains(t, 'the') AS BIGINT) + CAST(NOT list_contains(t, 'idiot') AS BIGINT) + CAST(list_contains(t, 'und') AS BIGINT) AS correct FROM w)
SELECT id, round(correct / 3, 4) AS correction_accuracy, correct, CAST(3 AS BIGINT) AS total FROM c""",
)
def correction_accuracy(spark, d) -> DataFrame:
    docs = table(spark, d, "documents", "doc_id", "text")
    gold = F.expr("array(named_struct('from', 'x', 'to', 'the'), named_struct('from', 'Idiot', 'to', ''), named_struct('from', 'y', 'to', 'Und'))")
    return E.correction_accuracy(docs.select(F.col("doc_id").alias("id"), X.tokens(F.col("text")).alias("words"), gold.alias("corrections")))


@query(
    "censorship_rate",
    WORDS_DOC + _HITS + _DECIDE + """, act AS (SELECT * FROM decisions WHERE action IN ('replace', 'censor')), inn AS (SELECT job_id, unnest(generate_series(word_idx + 1, end_idx - 1)) AS word_idx FROM act WHERE end_idx > word_idx + 1),
 fin AS (SELECT w.job_id, coalesce(a.replacement, w.word) AS word FROM words w ANTI JOIN inn ON w.job_id = inn.job_id AND w.word_idx = inn.word_idx LEFT JOIN act a ON a.job_id = w.job_id AND a.word_idx = w.word_idx)
SELECT job_id, round(count(*) FILTER (trim(word) = '_') / count(*), 4) AS censorship_rate, count(*) FILTER (trim(word) = '_') AS censored, count(*) AS total FROM fin GROUP BY job_id""",
)
def censorship_rate(spark, d) -> DataFrame:
    tasks = document_tasks(spark, d)
    words = words_of_documents(spark, d, tasks=tasks)
    return E.censorship_rate(S.apply_decisions(words, decisions_of(words), tasks))


def _clips(spark, d) -> DataFrame:
    """Benchmark items as evaluation clips, with gold terms and corrections that occur in some of them."""
    gold = {"profane": "array('the', 'idiot')", "clean": "array('of', 'stupid')", "corrections": "array(named_struct('from', 'x', 'to', 'the'), named_struct('from', 'Idiot', 'to', ''))"}
    items = table(spark, d, "benchmark", F.col("item_id").alias("job_id"), F.col("text").alias("reference"))
    return items.withColumns({k: F.expr(v) for k, v in gold.items()})


def _clip_scores(spark, d) -> DataFrame:
    ref, hyp = _clip_words(spark, d)
    terms = spark.createDataFrame([("Thanedble", 0), ("Orantion", 1)], "term string, ord int")
    return E.clip_scores(hyp, _clips(spark, d), ref, _LEX, terms)


@query("ablation_rollup")
def ablation_rollup(spark, d) -> DataFrame:
    return E.rollup(_clip_scores(spark, d), "config")


@query("ablation_clips")
def ablation_clips(spark, d) -> DataFrame:
    return _clip_scores(spark, d)


@query("evaluation_report")
def evaluation_report(spark, d) -> DataFrame:
    return E.report_text(E.rollup(_clip_scores(spark, d), "config"), "stub", "1")


@query(
    "pause_sessions",
    """WITH e AS (SELECT user_id, epoch_us(ts) AS t FROM events), f AS (SELECT *, CASE WHEN t - lag(t) OVER (PARTITION BY user_id ORDER BY t) >= 21600000000 THEN 1 ELSE 0 END AS n FROM e),
g AS (SELECT *, sum(n) OVER (PARTITION BY user_id ORDER BY t ROWS UNBOUNDED PRECEDING) AS s FROM f) SELECT user_id, min(t) AS start_us, max(t) AS end_us, count(*) AS n_events FROM g GROUP BY user_id, s""",
)
def batch_pause_sessions(spark, d) -> DataFrame:
    """The streaming operator over a table."""
    return pause_sessions(table(spark, d, "events", "user_id", "ts"))
