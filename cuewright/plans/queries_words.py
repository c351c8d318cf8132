"""Queries over timed words, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cuewright.functions import text as X
from cuewright.operators import words as W
from cuewright.plans.sql import IN_LIST, NORM, WORDS_CONV, WORDS_DOC, edge_norm_sql, similarity_sql, soundex_sql
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


_BAND = "CASE WHEN {0} >= 0.9 THEN 'high' WHEN {0} >= 0.7 THEN 'medium' ELSE 'low' END"


@query("confidence_bands", WORDS_CONV + f"SELECT job_id, word_idx, word, confidence AS asr_confidence, confidence AS overall_confidence, {_BAND.format('confidence')} AS band FROM words")
def confidence_bands(spark, d) -> DataFrame:
    return W.confidence_records(words_of_conversations(spark, d)).select("job_id", "word_idx", "word", "asr_confidence", "overall_confidence", "band")


@query(
    "confidence_summary",
    WORDS_CONV
    + f""", b AS (SELECT job_id, confidence, {_BAND.format('confidence')} AS band FROM words)
SELECT job_id, count(*) AS word_count, round(avg(confidence), 4) AS mean_confidence, count(*) FILTER (band = 'high') AS high,
 count(*) FILTER (band = 'medium') AS medium, count(*) FILTER (band = 'low') AS low FROM b GROUP BY job_id""",
)
def confidence_summary(spark, d) -> DataFrame:
    return W.confidence_summary(W.confidence_records(words_of_conversations(spark, d)))


@query(
    "low_confidence_rate",
    WORDS_DOC + "SELECT job_id, round(count(*) FILTER (confidence < 0.7) / count(*), 4) AS low_confidence_rate, count(*) FILTER (confidence < 0.7) AS low, count(*) AS total FROM words GROUP BY job_id",
)
def low_confidence_rate(spark, d) -> DataFrame:
    return W.low_confidence_rate(words_of_documents(spark, d))


@query("normalize_tokens", WORDS_DOC + f"SELECT {NORM.format('word')} AS token, count(*) AS n FROM words GROUP BY 1")
def normalize_tokens(spark, d) -> DataFrame:
    return words_of_documents(spark, d, by_job=False).groupBy(X.normalize_token(F.col("word")).alias("token")).agg(F.count("*").alias("n"))


@query(
    "eval_tokenize",
    "SELECT doc_id, CAST(len(t) AS BIGINT) AS n_tokens, md5(array_to_string(t, ' ')) AS tokens_md5 FROM (SELECT doc_id, regexp_extract_all(replace(lower(text), '’', ''''), '[a-z0-9'']+') AS t FROM documents)",
)
def eval_tokenize(spark, d) -> DataFrame:
    t = X.eval_tokens(F.col("text"))
    return table(spark, d, "documents", "doc_id", "text").select("doc_id", F.size(t).cast("long").alias("n_tokens"), F.md5(F.array_join(t, " ")).alias("tokens_md5"))


@query("soundex_variant", WORDS_DOC + f"SELECT token, {soundex_sql('token')} AS code FROM (SELECT DISTINCT {NORM.format('word')} AS token FROM words)")
def soundex_variant(spark, d) -> DataFrame:
    t = words_of_documents(spark, d, by_job=False).select(X.normalize_token(F.col("word")).alias("token")).distinct()
    return t.select("token", X.soundex(F.col("token")).alias("code"))


@query(
    "phonetic_similarity",
    WORDS_CONV
    + f""", p AS (SELECT DISTINCT {NORM.format('word')} AS l, {NORM.format('lead(word) OVER (PARTITION BY job_id ORDER BY word_idx)')} AS r FROM words)
SELECT l, r, round({similarity_sql('l', 'r')}, 6) AS similarity FROM p WHERE r IS NOT NULL""",
)
def phonetic_similarity(spark, d) -> DataFrame:
    pairs = words_of_conversations(spark, d).select(X.normalize_token(F.col("word")).alias("l"), X.normalize_token(F.lead("word").over(W.in_job())).alias("r")).where("r is not null").distinct()
    return pairs.select("l", "r", F.round(X.phonetic_similarity(F.col("l"), F.col("r")), 6).alias("similarity"))


@query(
    "even_spacing",
    """WITH t AS (SELECT item_id AS job_id, greatest(length(text) * 0.07::DOUBLE, 0.01::DOUBLE) AS d, regexp_extract_all(text, '\\S+') AS w FROM benchmark),
r AS (SELECT job_id, d, len(w) AS n, unnest(w) AS word, generate_subscripts(w, 1) - 1 AS word_idx FROM t),
s AS (SELECT *, round(word_idx * (d / n), 3) AS s, round(least(d, (word_idx + 1) * (d / n)), 3) AS e FROM r)
SELECT job_id, word_idx, word, s AS start_s, CASE WHEN e <= s THEN round(s + 0.01, 3) ELSE e END AS end_s FROM s""",
)
def even_spacing(spark, d) -> DataFrame:
    items = table(spark, d, "benchmark", F.col("item_id").alias("job_id"), "text")
    return W.even_spacing(items, F.length("text") * F.lit(0.07))


@query(
    "srt_timecodes",
    """SELECT o_orderkey, printf('%02d:%02d:%02d,%03d', t // 3600000, t // 60000 % 60, t // 1000 % 60, t % 1000) AS code, t AS parsed_ms
FROM (SELECT o_orderkey, greatest(o_orderkey * 7919 - 100000, 0) AS t FROM orders)""",
)
def srt_timecodes(spark, d) -> DataFrame:
    o = table(spark, d, "orders", "o_orderkey").select("o_orderkey", X.format_timecode(F.col("o_orderkey") * 7919 - 100000).alias("code"))
    return o.withColumn("parsed_ms", X.parse_timecode(F.col("code")))


_TURNS = """, g AS (SELECT *, CASE WHEN start_ms - max(end_ms) OVER (PARTITION BY job_id ORDER BY word_idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) >= 800 THEN 1 ELSE 0 END AS f FROM words),
h AS (SELECT *, sum(f) OVER (PARTITION BY job_id ORDER BY word_idx) AS turn FROM g),
segments AS (SELECT job_id, CAST(turn AS BIGINT) AS turn, CAST(CAST(turn AS BIGINT) % 2 + 1 AS VARCHAR) AS speaker, min(start_ms) AS start_ms, max(end_ms) AS end_ms FROM h GROUP BY job_id, turn)
"""


@query("pause_turns", WORDS_DOC + _TURNS + "SELECT job_id, turn, speaker, start_ms, end_ms, 'Speaker ' || speaker AS label FROM segments")
def pause_turns(spark, d) -> DataFrame:
    return W.pause_turns(words_of_documents(spark, d))


@query(
    "speaker_map",
    WORDS_CONV + _TURNS + "SELECT job_id, turn, CASE WHEN speaker = '1' THEN 'Host' ELSE 'Guest' END AS speaker, start_ms, end_ms, CASE WHEN speaker = '1' THEN 'Host' ELSE 'Guest' END AS label FROM segments",
)
def speaker_map(spark, d) -> DataFrame:
    mapping = spark.createDataFrame([("1", "Host"), ("Speaker 2", "Guest")], "key string, value string")
    return W.rename_speakers(W.pause_turns(words_of_conversations(spark, d)), mapping).select("job_id", "turn", "speaker", "start_ms", "end_ms", "label")


@query(
    "speaker_order",
    WORDS_CONV + "SELECT job_id, speaker, first_ms, row_number() OVER (PARTITION BY job_id ORDER BY first_ms, speaker) AS position FROM (SELECT job_id, speaker, min(start_ms) AS first_ms FROM words GROUP BY job_id, speaker)",
)
def speaker_order(spark, d) -> DataFrame:
    return W.speakers_in_order(words_of_conversations(spark, d))


_SENTENCES = f""", s1 AS (SELECT *, CASE WHEN lag(word) OVER w IS NULL OR start_ms - lag(end_ms) OVER w >= 450 OR regexp_matches(lag(word) OVER w, '[.!?]["''”’]*$') THEN 1 ELSE 0 END AS nw
 FROM words WINDOW w AS (PARTITION BY job_id ORDER BY word_idx)),
s2 AS (SELECT *, sum(nw) OVER (PARTITION BY job_id ORDER BY word_idx) AS grp, {edge_norm_sql('word')} AS nrm FROM s1),
s3 AS (SELECT *, CASE WHEN row_number() OVER g = 3 AND concat_ws(' ', lag(nrm, 2) OVER g, lag(nrm, 1) OVER g) IN ({IN_LIST(X.GREETING_PAIRS)}) THEN 1 ELSE nw END AS ct
 FROM s2 WINDOW g AS (PARTITION BY job_id, grp ORDER BY word_idx)),
sent AS (SELECT *, sum(ct) OVER (PARTITION BY job_id ORDER BY word_idx) - 1 AS sentence FROM s3)
"""


@query("sentence_split", WORDS_DOC + _SENTENCES + "SELECT job_id, CAST(sentence AS BIGINT) AS sentence, count(*) AS n_words, min(word_idx) AS first_word, max(end_ms) AS end_ms FROM sent GROUP BY job_id, sentence")
def sentence_split(spark, d) -> DataFrame:
    s = W.split_sentences(words_of_documents(spark, d))
    return s.groupBy("job_id", "sentence").agg(F.count("*").alias("n_words"), F.min("word_idx").alias("first_word"), F.max("end_ms").alias("end_ms"))


_CAP = "CASE WHEN regexp_matches({0}, '\\p{{L}}') THEN regexp_extract({0}, '^(\\P{{L}}*)(\\p{{L}})(.*)$', 1) || upper(regexp_extract({0}, '^(\\P{{L}}*)(\\p{{L}})(.*)$', 2)) || regexp_extract({0}, '^(\\P{{L}}*)(\\p{{L}})(.*)$', 3) ELSE {0} END"


@query(
    "punctuate",
    WORDS_CONV
    + _SENTENCES
    + f""", p1 AS (SELECT *, count(*) OVER (PARTITION BY job_id, sentence) AS n, row_number() OVER x AS nth,
 first_value(nrm) OVER y AS f1, nth_value(nrm, 2) OVER y AS f2 FROM sent
 WINDOW x AS (PARTITION BY job_id, sentence ORDER BY word_idx), y AS (PARTITION BY job_id, sentence ORDER BY word_idx ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)),
p2 AS (SELECT *, CASE WHEN n <= 2 AND (f1 IN ({IN_LIST(X.GREETING_WORDS)}) OR (n = 2 AND f1 || ' ' || f2 IN ({IN_LIST(X.GREETING_PAIRS)}))) THEN '!' WHEN f1 IN ({IN_LIST(X.QUESTION_STARTERS)}) THEN '?' ELSE '.' END AS mark,
 CASE WHEN nth = 1 OR lower(trim(word, '"“”‘’()[]{{}}.,!?;:')) IN ({IN_LIST(X.I_FORMS)}) THEN {_CAP.format('word')} ELSE word END AS shaped FROM p1),
p3 AS (SELECT *, regexp_extract(shaped, '(["''”’)]*)$', 1) AS qt, regexp_replace(regexp_replace(shaped, '["''”’)]+$', ''), '[,;:]+$', '') AS body FROM p2)
SELECT job_id, word_idx, CASE WHEN nth < n THEN shaped WHEN regexp_matches(body, '[.!?]$') THEN body || qt ELSE body || mark || qt END AS word FROM p3""",
)
def punctuate(spark, d) -> DataFrame:
    return W.punctuate(words_of_conversations(spark, d)).select("job_id", "word_idx", "word")


def sound_events(spark, d) -> DataFrame:
    """Sound events made from the events table, by user."""
    e = table(spark, d, "events", "event_id", "user_id", "event_type", "value")
    start = F.col("event_id") * 137 % 100_000
    return e.select(
        F.col("user_id").alias("job_id"), "event_id", F.concat(F.lit(" ["), F.upper("event_type"), F.lit("] ")).alias("label"),
        start.alias("start_ms"), (start + F.col("event_id") % 900 - 50).alias("end_ms"), ((F.col("event_id") * 13 % 120) / F.lit(100.0)).alias("confidence"),
    )


_EVENTS = """ev AS (SELECT user_id AS job_id, event_id, '[' || lower(event_type) || ']' AS label, event_id * 137 % 100000 AS start_ms, event_id * 137 % 100000 + event_id % 900 - 50 AS end_ms, event_id * 13 % 120 / 100.0 AS confidence FROM events),
kept AS (SELECT job_id, event_id, label, start_ms, end_ms, least(1.0, confidence) AS confidence FROM ev WHERE confidence > 0.8 AND end_ms > start_ms)
"""


@query("sound_event_filter", "WITH " + _EVENTS + "SELECT job_id, event_id, label, start_ms, end_ms, CAST(confidence AS DOUBLE) AS confidence FROM kept")
def sound_event_filter(spark, d) -> DataFrame:
    return W.filter_events(sound_events(spark, d))


def _words_for_events(spark, d) -> DataFrame:
    return words_of_documents(spark, d)


@query(
    "event_antijoin",
    WORDS_DOC + ", " + _EVENTS + """SELECT job_id, event_id, label, start_ms, end_ms FROM kept k WHERE NOT EXISTS
 (SELECT 1 FROM words w WHERE w.job_id = k.job_id AND w.end_ms > k.start_ms + 1 AND w.start_ms < k.end_ms - 1)""",
)
def event_antijoin(spark, d) -> DataFrame:
    return W.events_in_silence(W.filter_events(sound_events(spark, d)), _words_for_events(spark, d)).select("job_id", "event_id", "label", "start_ms", "end_ms")


@query(
    "event_placement",
    "WITH RECURSIVE " + _EVENTS + """, o AS (SELECT *, row_number() OVER (PARTITION BY job_id ORDER BY start_ms, end_ms, label, confidence) AS r FROM kept),
f AS (SELECT job_id, r, start_ms, greatest(end_ms, start_ms + 200) AS end_ms, label, TRUE AS ok, greatest(end_ms, start_ms + 200) AS last FROM o WHERE r = 1
 UNION ALL SELECT o.job_id, o.r, o.start_ms, greatest(o.end_ms, o.start_ms + 200), o.label, f.last <= o.start_ms + 1,
  CASE WHEN f.last <= o.start_ms + 1 THEN greatest(f.last, o.end_ms, o.start_ms + 200) ELSE f.last END FROM f JOIN o ON o.job_id = f.job_id AND o.r = f.r + 1)
SELECT job_id, start_ms, end_ms, label FROM f WHERE ok""",
)
def event_placement(spark, d) -> DataFrame:
    return W.place_events(W.filter_events(sound_events(spark, d))).select("job_id", "start_ms", "end_ms", "label")


_INSERTED = """, kx AS (SELECT *, row_number() OVER (ORDER BY event_id) AS k FROM kept),
fw AS (SELECT k.*, (SELECT min(w.word_idx) FROM words w WHERE w.job_id = k.job_id AND w.end_ms > k.start_ms + 1) AS nxt FROM kx k),
fr AS (SELECT f.* FROM fw f LEFT JOIN words w ON w.job_id = f.job_id AND w.word_idx = f.nxt WHERE f.nxt IS NULL OR w.start_ms >= f.end_ms - 1),
io AS (SELECT *, greatest(end_ms, start_ms + 200) AS e2, row_number() OVER (PARTITION BY job_id ORDER BY start_ms, end_ms, label, confidence) AS r FROM fr),
ifold AS (SELECT job_id, r, start_ms, e2, label, confidence, nxt, TRUE AS ok, e2 AS last FROM io WHERE r = 1
 UNION ALL SELECT o.job_id, o.r, o.start_ms, o.e2, o.label, o.confidence, o.nxt, f.last <= o.start_ms + 1, CASE WHEN f.last <= o.start_ms + 1 THEN greatest(f.last, o.e2) ELSE f.last END
 FROM ifold f JOIN io o ON o.job_id = f.job_id AND o.r = f.r + 1),
im AS (SELECT job_id, word_idx AS pos, 1 AS kind, 0 AS r, word_idx AS old_idx, word, start_ms, end_ms, confidence FROM words
 UNION ALL SELECT job_id, coalesce(nxt, 9000000000000000000), 0, r, NULL, label, start_ms, e2, CAST(confidence AS DOUBLE) FROM ifold WHERE ok),
merged AS (SELECT *, CAST(row_number() OVER (PARTITION BY job_id ORDER BY pos, kind, r) - 1 AS BIGINT) AS word_idx FROM im)
"""


@query("event_insertion", WORDS_DOC + ", " + _EVENTS + _INSERTED + "SELECT job_id, word_idx, old_idx, word, start_ms, end_ms, confidence FROM merged")
def event_insertion(spark, d) -> DataFrame:
    tasks = document_tasks(spark, d)
    words = words_of_documents(spark, d, tasks=tasks)
    merged = W.insert_events(words, W.events_among(words, W.filter_events(sound_events(spark, d)), tasks=tasks), tasks)
    return merged.select("job_id", "word_idx", "old_idx", "word", "start_ms", "end_ms", "confidence")


@query(
    "event_sessions",
    """WITH e AS (SELECT user_id, CAST(floor(epoch(ts)) AS BIGINT) AS t FROM events),
f AS (SELECT *, CASE WHEN t - lag(t) OVER (PARTITION BY user_id ORDER BY t) >= 21600 THEN 1 ELSE 0 END AS n FROM e),
g AS (SELECT *, sum(n) OVER (PARTITION BY user_id ORDER BY t ROWS UNBOUNDED PRECEDING) AS session FROM f)
SELECT user_id, CAST(session AS BIGINT) AS session, min(t) AS start_s, max(t) AS end_s, count(*) AS n_events FROM g GROUP BY ALL""",
)
def event_sessions(spark, d) -> DataFrame:
    e = table(spark, d, "events", "user_id", "ts")
    return W.sessions(e, "user_id", F.floor(F.col("ts").cast("timestamp").cast("double")), 21600)


@query(
    "toggle_labels",
    "WITH RECURSIVE " + """o AS (SELECT user_id AS job_id, event_id * 977 AS start_ms, event_id * 977 + 300 AS end_ms, CAST(event_id % 2 + 1 AS INT) AS label,
 row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS r FROM events),
f AS (SELECT job_id, r, start_ms, end_ms, label FROM o WHERE r = 1
 UNION ALL SELECT o.job_id, o.r, o.start_ms, o.end_ms, CASE WHEN o.start_ms - f.end_ms >= 30000 AND o.label = f.label THEN 3 - o.label ELSE o.label END FROM f JOIN o ON o.job_id = f.job_id AND o.r = f.r + 1)
SELECT job_id, start_ms, end_ms, label FROM f""",
)
def toggle_labels(spark, d) -> DataFrame:
    e = table(spark, d, "events", "event_id", "user_id")
    rows = e.select(F.col("user_id").alias("job_id"), (F.col("event_id") * 977).alias("start_ms"), (F.col("event_id") * 977 + 300).alias("end_ms"), (F.col("event_id") % 2 + 1).cast("int").alias("label"))
    return W.toggle_labels(rows, 30000)


def _segments(words: DataFrame) -> DataFrame:
    """Segments with gaps between them: every third turn is missing."""
    t = W.pause_turns(words).where("turn % 3 <> 1")
    return t.select("job_id", F.col("turn").cast("int").alias("seg_idx"), "speaker", "start_ms", "end_ms")


_MID = ", seg AS (SELECT * FROM segments WHERE turn % 3 <> 1), m AS (SELECT *, (start_ms + end_ms) / 2 AS mid FROM words)"


@query(
    "speaker_at_midpoint",
    WORDS_DOC + _TURNS + _MID + """, c AS (SELECT m.job_id, m.word_idx, max_by(s.speaker, s.turn) AS sp FROM m JOIN seg s ON m.job_id = s.job_id AND m.mid BETWEEN s.start_ms - 1 AND s.end_ms + 1 GROUP BY ALL),
n AS (SELECT m.job_id, m.word_idx, arg_min(s.speaker, least(abs(m.mid - s.start_ms), abs(m.mid - s.end_ms)) * 1000 + s.turn / 1e6) AS sp
 FROM m ANTI JOIN c ON m.job_id = c.job_id AND m.word_idx = c.word_idx JOIN seg s ON m.job_id = s.job_id GROUP BY ALL)
SELECT * FROM (SELECT job_id, word_idx, sp AS speaker FROM c UNION ALL SELECT job_id, word_idx, sp FROM n)""",
)
def speaker_at_midpoint(spark, d) -> DataFrame:
    tasks = document_tasks(spark, d)
    words = words_of_documents(spark, d, tasks=tasks)
    return W.speaker_at(words, _segments(words), tasks=tasks).select("job_id", "word_idx", "speaker")


@query(
    "reading_speed",
    "SELECT doc_id, round(length(flat) / s, 4) AS cps, round((CASE WHEN flat = '' THEN 0 ELSE len(string_split(flat, ' ')) END) / s, 4) AS wps FROM (SELECT doc_id, trim(regexp_replace(text, '\\s+', ' ', 'g')) AS flat, greatest(n_chars * 55, 1) / 1000.0 AS s FROM documents)",
)
def reading_speed(spark, d) -> DataFrame:
    cps, wps = X.reading_speed(F.col("text"), F.col("n_chars") * 55)
    return table(spark, d, "documents", "doc_id", "text", "n_chars").select("doc_id", F.round(cps, 4).alias("cps"), F.round(wps, 4).alias("wps"))
