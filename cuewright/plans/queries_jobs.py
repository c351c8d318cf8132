"""Queries of sinks, audio levels, review state and vocabulary logs, and their SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cuewright.functions import text as X
from cuewright.operators import audio as A
from cuewright.operators import captions as C
from cuewright.operators import evaluation as E
from cuewright.operators import recognition
from cuewright.operators import review as R
from cuewright.operators import safety as S
from cuewright.operators import vocabulary as V
from cuewright.operators import words as W
from cuewright.plans.queries_captions import _CUES, _DENSITY, _MERGED, _ROUGH, _TC, _merged_words, _rough
from cuewright.plans.queries_safety import _DECIDE, _HITS, _LEX, _hits, decisions_of, decisions_of_documents
from cuewright.plans.queries_words import _TURNS
from cuewright.plans.sql import IN_LIST, NORM, WORDS_CONV, WORDS_DOC
from cuewright.schema import Settings
from cuewright.sources import files
from cuewright.sources import sinks as K
from cuewright.sources.bundle import read_bundle, write_bundle
from cuewright.sources.shared import shared_dir
from cuewright.sources.tables import table, words_of_conversations, words_of_documents

Q: dict = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(f):
        Q[name] = f
        if sql is not None:
            SQL[name] = sql
        return f

    return add


# --- sinks ------------------------------------------------------------------------------


def _captions(spark, d) -> DataFrame:
    return C.repair_density(_merged_words(spark, d))


_WORD_JSON = """'{"word":' || to_json(word) || ',"start":' || to_json(start_ms / 1000.0::DOUBLE) || ',"end":' || to_json(end_ms / 1000.0::DOUBLE) || ',"confidence":' || to_json(confidence) || CASE WHEN speaker IS NULL THEN '' ELSE ',"speaker":' || to_json(speaker) END || '}'"""


@query(
    "artifact_bundle",
    WORDS_CONV + f""", t AS (SELECT job_id, string_agg(word, ' ' ORDER BY word_idx) AS txt, string_agg({_WORD_JSON}, ',' ORDER BY word_idx) AS ws FROM words GROUP BY job_id),
 a AS (SELECT job_id, unnest(['transcript.json', 'transcript.txt']) AS name, unnest(['{{"text":' || to_json(txt) || ',"words":[' || ws || ']}}', txt]) AS content FROM t)
SELECT CAST(job_id AS VARCHAR) AS job_id, name, CAST(length(content) AS BIGINT) AS chars, sha256(content) AS content_sha256 FROM a""",
)
def artifact_bundle(spark, d) -> DataFrame:
    """Every conversation's transcript, as JSON and as text, published as a bundle and read back."""
    words = words_of_conversations(spark, d)
    text = words.groupBy("job_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("word_idx", "word"))), lambda x: x["word"]), " ").alias("content"))
    held = lambda rows, name, column: rows.select("job_id", F.lit(name).alias("name"), F.col(column).alias("content"))
    path = f"{shared_dir(spark)}/cuewright-bundle-{uuid.uuid4().hex}"
    write_bundle(held(K.transcript_json(words), "transcript.json", "json").unionByName(held(text, "transcript.txt", "content")), path)
    return read_bundle(spark, path).select("job_id", "name", F.length("content").cast("long").alias("chars"), F.sha2("content", 256).alias("content_sha256"))


@query(
    "reading_speed_report",
    WORDS_CONV + _CUES + _MERGED + _DENSITY + """SELECT job_id, string_agg(printf('#%d Reading speed: %.1f CPS / %.1f WPS  Status: %s', CAST(caption AS BIGINT), round(cps, 1), round(wps, 1), reading_status), chr(10) ORDER BY caption) || chr(10) || 'Reading-speed warnings: ' || count(*) FILTER (reading_status <> 'OK') AS report FROM repaired GROUP BY job_id""",
)
def reading_speed_report(spark, d) -> DataFrame:
    return K.reading_speed_text(_captions(spark, d))


@query(
    "reading_speed_metrics",
    WORDS_CONV + _CUES + _MERGED + _DENSITY + """SELECT job_id, (2 * sum(CAST(round(cps * 10000) AS BIGINT)) + count(*)) // (2 * count(*)) / 10000.0::DOUBLE AS mean_cps, (2 * sum(CAST(round(wps * 10000) AS BIGINT)) + count(*)) // (2 * count(*)) / 10000.0::DOUBLE AS mean_wps,
 count(*) FILTER (contains(flags, 'reading_speed') OR reading_status <> 'OK') AS reading_speed_warnings, count(*) AS caption_count FROM repaired GROUP BY job_id""",
)
def reading_speed_metrics(spark, d) -> DataFrame:
    return E.reading_speed(_captions(spark, d))


@query(
    "captions_payload",
    WORDS_CONV + _CUES + _MERGED + _DENSITY + """SELECT job_id, count(*) AS caption_count, count(*) AS listed, count(*) FILTER (contains(flags, 'needs_review')) AS needs_review, arg_max(text, caption) AS last_text, arg_max(start_ms, caption) AS last_start_ms,
 arg_max(reading_status, caption) AS last_status, arg_max(mean_confidence, caption) AS last_confidence, sha256(string_agg(caption || '|' || start_ms || '|' || end_ms || '|' || text || '|' || reading_status, chr(10) ORDER BY caption)) AS all_sha256 FROM repaired GROUP BY job_id""",
)
def captions_payload(spark, d) -> DataFrame:
    """What stands in each job's JSON: its summary, the number of captions, the last of them, and a digest of all."""
    from cuewright.schema import CAPTIONS

    held = K.captions_json(_captions(spark, d)).select("job_id", F.from_json("json", CAPTIONS).alias("c"), F.from_json("json", "summary struct<caption_count: bigint, needs_review: bigint>").alias("s"))
    last = F.element_at("c.captions", -1)
    ms = lambda x: F.round(x * 1000).cast("long").cast("string")
    lines = F.transform("c.captions", lambda x: F.concat_ws("|", x["index"].cast("string"), ms(x["start"]), ms(x["end"]), x["text"], x["reading_speed"]["status"]))
    return held.select(
        "job_id", F.col("s.summary.caption_count").alias("caption_count"), F.size("c.captions").cast("long").alias("listed"), F.col("s.summary.needs_review").alias("needs_review"), last["text"].alias("last_text"),
        F.round(last["start"] * 1000).cast("long").alias("last_start_ms"), last["reading_speed"]["status"].alias("last_status"), last["mean_confidence"].alias("last_confidence"), F.sha2(F.array_join(lines, "\n"), 256).alias("all_sha256"),
    )


@query(
    "srt_validation",
    WORDS_CONV + _CUES + _ROUGH + """, k AS (SELECT job_id, count(*) FILTER (NOT gone) AS blocks, sum(empty::INT + (NOT empty AND neg)::INT + (NOT empty AND inv)::INT + (NOT empty AND short)::INT + (NOT empty AND long)::INT + coalesce(ov::INT, 0) + coalesce(gp::INT, 0) + coalesce(st::INT, 0) + outside::INT) AS n,
  sum((NOT empty AND long)::INT) AS unfixed FROM va GROUP BY job_id)
SELECT k.job_id, blocks, CAST(n AS BIGINT) AS issue_count, n > unfixed AS repaired, coalesce(srt, '') AS srt FROM k LEFT JOIN (SELECT job_id, string_agg(r || chr(10) || """ + _TC.format("CAST(s AS BIGINT)") + " || ' --> ' || " + _TC.format("CAST(greatest(s, e) AS BIGINT)") + """ || chr(10) || trim(text, ' ' || chr(10) || chr(9)), chr(10) || chr(10) ORDER BY r) || chr(10) AS srt
 FROM (SELECT *, row_number() OVER (PARTITION BY job_id ORDER BY index) AS r FROM va WHERE NOT gone) GROUP BY job_id) USING (job_id)""",
)
def srt_validation(spark, d) -> DataFrame:
    out = K.srt_with_report(_rough(C.assemble(C.assign_cues(words_of_conversations(spark, d)))), duration_ms=60000)
    return out.select("job_id", F.size(F.regexp_extract_all("srt", F.lit(" --> "), F.lit(0))).cast("long").alias("blocks"), "issue_count", "repaired", "srt")


def _jobs(spark, d) -> DataFrame:
    docs = table(spark, d, "documents", F.col("doc_id").alias("job_id"))
    return docs.select("job_id", F.lit("strict").alias("mode"), F.lit("censor").alias("unknown_profanity"), F.when(F.col("job_id") % 2 == 0, "REVIEWED").otherwise("QUEUED").alias("status"))


_REPORT = f"""'# Correction report' || chr(10) || chr(10) || '{K.DISCLAIMER}' || chr(10) || chr(10) || 'Job: `' || j.doc_id || '`' || chr(10) || 'Mode: strict' || chr(10) || 'Unknown profanity: censor' || chr(10) || chr(10) ||
 '{K.REPORT_HEAD.splitlines()[0]}' || chr(10) || '{K.REPORT_HEAD.splitlines()[1]}' || chr(10) || coalesce(l.rows, '{K.REPORT_NONE}') || chr(10) || chr(10) || '{K.REPORT_END}' || chr(10)"""


_REPORT_ROWS = """l AS (SELECT job_id, string_agg('| ' || replace(original, '|', '/') || ' | ' || replace(replacement, '|', '/') || ' | ' || "case" || ' | ' || action || ' | ' || CASE WHEN needs_review THEN 'yes' ELSE 'no' END || ' | ' || reason || ' |', chr(10) ORDER BY word_idx) AS rows FROM decisions GROUP BY job_id)"""


@query("correction_report", WORDS_DOC + _HITS + _DECIDE + f""", {_REPORT_ROWS} SELECT j.doc_id AS job_id, {_REPORT} AS report FROM documents j LEFT JOIN l ON l.job_id = j.doc_id""")
def correction_report(spark, d) -> DataFrame:
    return K.correction_report(_jobs(spark, d), decisions_of_documents(spark, d))


_ITEM_WORDS = f"""WITH iw AS (SELECT item_id, k, {NORM.format('w[k]')} AS t FROM (SELECT item_id, w, unnest(generate_series(1, len(w))) AS k FROM (SELECT item_id, regexp_extract_all(text, '\\S+') AS w FROM benchmark)))
"""


def _item_words(spark, d) -> DataFrame:
    """(item_id, k, t): normalised words of the benchmark items, from 1."""
    return table(spark, d, "benchmark", "item_id", F.posexplode(X.tokens(F.col("text"))).alias("k", "w")).select("item_id", (F.col("k") + 1).alias("k"), X.normalize_token(F.col("w")).alias("t"))


@query("allowlist_text", _ITEM_WORDS + "SELECT 'Allowlist (' || count(*) || ' words): ' || coalesce(string_agg(t, ', ' ORDER BY t), '(empty)') AS text FROM (SELECT DISTINCT t FROM iw WHERE length(t) % 5 = 1)")
def allowlist_text(spark, d) -> DataFrame:
    return K.allowlist_text(_item_words(spark, d).where(F.length("t") % 5 == 1).select(F.col("t").alias("term")))


@query(
    "safety_payload",
    WORDS_DOC + _HITS + """SELECT d.doc_id AS job_id, count(h.job_id) AS hit_count, count(h.job_id) AS listed, count(*) FILTER (h.match_type = 'phrase') AS phrase_hits, 'ofth,pathetic' AS allowlist, 'strict' AS mode, coalesce(arg_min(h.word, h.word_idx), '') AS first_word
 FROM documents d LEFT JOIN hits h ON h.job_id = d.doc_id GROUP BY d.doc_id""",
)
def safety_payload(spark, d) -> DataFrame:
    allowed = spark.createDataFrame([(t,) for t in _LEX.allowlist], "term string")
    kind = "mode string, allowlist array<string>, hits array<struct<word: string>>, summary struct<hit_count: bigint, phrase_hits: bigint>"
    held = K.safety_json(_jobs(spark, d), _hits(spark, d), allowed).select("job_id", F.from_json("json", kind).alias("j"))
    return held.select("job_id", "j.summary.hit_count", F.size("j.hits").cast("long").alias("listed"), "j.summary.phrase_hits", F.array_join("j.allowlist", ",").alias("allowlist"), "j.mode", F.coalesce(F.get("j.hits", F.lit(0))["word"], F.lit("")).alias("first_word"))


@query(
    "export_set",
    WORDS_CONV + _CUES + _HITS + _DECIDE + f""", sp AS (SELECT DISTINCT job_id, job_id AS doc_id FROM words), {_REPORT_ROWS}
SELECT j.job_id, CASE WHEN j.job_id % 2 = 0 THEN 'EXPORTED' ELSE 'QUEUED' END AS status, (SELECT count(*) FROM cues c WHERE c.job_id = j.job_id) AS reviewed_blocks, TRUE AS has_raw, {_REPORT} AS report FROM sp j LEFT JOIN l ON l.job_id = j.job_id""",
)
def export_set(spark, d) -> DataFrame:
    words = words_of_conversations(spark, d)
    jobs = words.select("job_id").distinct().select("job_id", F.when(F.col("job_id") % 2 == 0, "REVIEWED").otherwise("QUEUED").alias("status"), F.lit("strict").alias("mode"), F.lit("censor").alias("unknown_profanity"))
    caps = C.assemble(C.assign_cues(words)).select("job_id", F.col("cue").alias("index"), "start_ms", "end_ms", "text", F.expr("cast(array() as array<string>)").alias("flags"))
    out = K.export_set(caps, words, jobs, decisions_of(words))
    return out.select("job_id", "status", F.size(F.regexp_extract_all("reviewed_srt", F.lit(" --> "), F.lit(0))).cast("long").alias("reviewed_blocks"), (F.col("raw_srt") != "").alias("has_raw"), "report")


# --- review -----------------------------------------------------------------------------


@query(
    "confidence_annotation",
    WORDS_CONV + """, r AS (SELECT job_id, start_ms, end_ms, word, arg_max(confidence, word_idx) AS overall_confidence FROM words WHERE word_idx % 3 <> 0 GROUP BY ALL)
SELECT w.job_id, w.word_idx, r.overall_confidence, CASE WHEN r.overall_confidence >= 0.9 THEN 'high' WHEN r.overall_confidence >= 0.7 THEN 'medium' WHEN r.overall_confidence IS NOT NULL THEN 'low' END AS record_band FROM words w LEFT JOIN r USING (job_id, start_ms, end_ms, word)""",
)
def confidence_annotation(spark, d) -> DataFrame:
    words = words_of_conversations(spark, d)
    records = W.confidence_records(words.where("word_idx % 3 <> 0"))
    return C.annotate_confidence(words, records).select("job_id", "word_idx", "overall_confidence", "record_band")


@query(
    "decision_times",
    WORDS_DOC + """, d AS (SELECT job_id, word_idx + CASE WHEN word_idx % 3 = 0 THEN 0 ELSE 7 END AS word_idx, word_idx + CASE WHEN word_idx % 3 = 0 THEN 0 ELSE 7 END + 1 + word_idx % 4 AS end_idx FROM words WHERE word_idx % 10 = 0), l AS (SELECT job_id, max(word_idx) AS last FROM words GROUP BY job_id)
SELECT d.job_id, d.word_idx, coalesce(a.start_ms, -1) AS start_ms, CASE WHEN a.start_ms IS NULL THEN -1 ELSE b.end_ms END AS end_ms FROM d JOIN l ON l.job_id = d.job_id LEFT JOIN words a ON a.job_id = d.job_id AND a.word_idx = d.word_idx LEFT JOIN words b ON b.job_id = d.job_id AND b.word_idx = least(l.last, d.end_idx - 1)""",
)
def decision_times(spark, d) -> DataFrame:
    words = words_of_documents(spark, d)
    at = F.col("word_idx") + F.when(F.col("word_idx") % 3 == 0, 0).otherwise(7)
    made = words.where("word_idx % 10 = 0").select("job_id", at.alias("word_idx"), (at + 1 + F.col("word_idx") % 4).alias("end_idx"))
    return R.decision_times(made, words).select("job_id", "word_idx", "start_ms", "end_ms")


@query(
    "suggested_texts",
    WORDS_DOC + """, c AS (SELECT job_id, word_idx // 8 AS caption, string_agg(word, ' ' ORDER BY word_idx) AS text FROM words GROUP BY job_id, word_idx // 8), p AS (SELECT *, strpos(lower(text), 'the') AS a, strpos(text, '_') AS m FROM c)
SELECT job_id, caption, CASE WHEN a > 0 THEN left(text, a - 1) || 'THAT' || substr(text, a + 3) WHEN m > 0 THEN left(text, m - 1) || 'THAT' || substr(text, m + 1) ELSE text END AS suggested_text FROM p""",
)
def suggested_texts(spark, d) -> DataFrame:
    caps = C.assemble(words_of_documents(spark, d).withColumn("cue", F.floor(F.col("word_idx") / 8)))
    return caps.select("job_id", F.col("cue").alias("caption"), X.apply_token(F.col("text"), F.lit("The"), F.lit("THAT")).alias("suggested_text"))


@query(
    "review_history",
    """WITH a AS (SELECT user_id AS job_id, event_id, event_id % 9 AS caption, event_type, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS k FROM events WHERE event_id % 2 = 1), o AS (SELECT user_id AS job_id, count(*) AS n FROM events WHERE event_id % 2 = 0 GROUP BY 1)
SELECT CAST(a.job_id AS VARCHAR) AS job_id, k + coalesce(n, 0) AS action_no, caption, 'keep_' || lower(event_type) AS action FROM a LEFT JOIN o ON o.job_id = a.job_id
UNION ALL SELECT CAST(user_id AS VARCHAR), row_number() OVER (PARTITION BY user_id ORDER BY event_id), event_id % 9, 'keep_' || lower(event_type) FROM events WHERE event_id % 2 = 0""",
)
def review_history(spark, d) -> DataFrame:
    e = table(spark, d, "events", "event_id", "user_id", "event_type")
    acts = e.select(F.col("user_id").cast("string").alias("job_id"), F.col("event_id").alias("at"), (F.col("event_id") % 9).alias("caption"), F.concat(F.lit(" Keep "), "event_type").alias("action"), F.lit("t").alias("text"))
    before = R.history(acts.where("at % 2 = 0"))
    return R.history(acts.where("at % 2 = 1"), before).drop("text")


@query(
    "reviewed_versions",
    WORDS_CONV + _CUES + """SELECT job_id, CAST(row_number() OVER (PARTITION BY job_id ORDER BY cue) AS INT) AS caption, CASE WHEN job_id % 2 = 0 THEN 'reviewed ' || text ELSE text END AS text FROM cues WHERE job_id % 2 = 1 OR cue % 2 = 0""",
)
def reviewed_versions(spark, d) -> DataFrame:
    cues = C.assemble(C.assign_cues(words_of_conversations(spark, d))).select("job_id", F.col("cue").cast("int").alias("caption"), "text")
    first = cues.withColumn("version", F.lit(1).cast("long"))
    edited = cues.where("job_id % 2 = 0 and caption % 2 = 0").withColumn("text", F.concat(F.lit("reviewed "), "text"))
    return R.newest_version(R.persist_reviewed(first, edited)).select("job_id", "caption", "text")


@query(
    "caption_at_playhead",
    WORDS_CONV + _CUES + """, h AS (SELECT DISTINCT job_id, 777 * (job_id % 50) AS head_ms FROM cues) SELECT h.job_id, h.head_ms, CAST(min(cue) AS BIGINT) AS caption, arg_min(text, cue) AS text FROM h LEFT JOIN cues c ON c.job_id = h.job_id AND c.start_ms <= h.head_ms AND h.head_ms < c.end_ms GROUP BY ALL""",
)
def caption_at_playhead(spark, d) -> DataFrame:
    cues = C.assemble(C.assign_cues(words_of_conversations(spark, d))).withColumnRenamed("cue", "caption")
    heads = cues.select("job_id", (777 * (F.col("job_id") % 50)).alias("head_ms")).distinct()
    return R.caption_at(cues, heads)


@query(
    "caption_timeline",
    WORDS_CONV + _CUES + _MERGED + """, e AS (SELECT job_id, greatest(max(end_ms), 45000, 1000) AS whole FROM merged GROUP BY job_id)
SELECT job_id, CAST(cue AS BIGINT) AS caption, printf('%02d:%02d', start_ms // 1000 // 60, start_ms // 1000 % 60) AS clock, 'high' AS colour, round(start_ms * 100 / whole, 4) AS left_pct, greatest(round((end_ms - start_ms) * 100 / whole, 4), 0.6) AS width_pct FROM merged JOIN e USING (job_id)""",
)
def caption_timeline(spark, d) -> DataFrame:
    cues = C.assemble(_merged_words(spark, d)).select("job_id", F.col("cue").cast("long").alias("caption"), "start_ms", "end_ms", F.lit(None).cast("string").alias("confidence_band"))
    return R.timeline(cues, cues.select("job_id").distinct().withColumn("duration_ms", F.lit(45000)))


_DURATIONS = "CASE event_id % 5 WHEN 0 THEN '12.5' WHEN 1 THEN '-3' WHEN 2 THEN 'abc' WHEN 3 THEN NULL ELSE CAST(event_id AS VARCHAR) END"


@query("job_durations", f"SELECT event_id, CASE WHEN TRY_CAST(x AS DOUBLE) > 0 THEN CAST(round(TRY_CAST(x AS DOUBLE) * 1000) AS BIGINT) END AS duration_ms FROM (SELECT event_id, {_DURATIONS} AS x FROM events)")
def job_durations(spark, d) -> DataFrame:
    raw = F.expr(_DURATIONS.replace("VARCHAR", "STRING"))
    return table(spark, d, "events", "event_id").select("event_id", R.duration_ms(raw).alias("duration_ms"))


_STATES = R.BUSY + R.REVIEW + R.ENDED


@query(
    "status_kinds",
    f"""SELECT event_id, st AS status, CASE WHEN st IN ({IN_LIST(R.BUSY)}) THEN 'busy' WHEN st IN ({IN_LIST(R.REVIEW)}) THEN 'review' WHEN st IN ({IN_LIST(R.ENDED)}) THEN 'ended' END AS kind
FROM (SELECT event_id, list_value({IN_LIST([*_STATES, 'OTHER'])})[event_id % {len(_STATES) + 1} + 1] AS st FROM events)""",
)
def status_kinds(spark, d) -> DataFrame:
    states = F.array(*[F.lit(s) for s in [*_STATES, "OTHER"]])
    e = table(spark, d, "events", "event_id", F.element_at(states, (F.col("event_id") % (len(_STATES) + 1) + 1).cast("int")).alias("status"))
    return e.withColumn("kind", R.status_kind(F.col("status")))


@query(
    "ended_jobs",
    f"""WITH j AS (SELECT event_id AS job_id, list_value({IN_LIST(_STATES)})[event_id % {len(_STATES)} + 1] AS status, event_id % 3 AS k FROM events)
SELECT job_id, CASE WHEN k > 0 AND status IN ({IN_LIST(R.BUSY)}) THEN CASE k WHEN 1 THEN 'FAILED' ELSE 'CANCELLED' END ELSE status END AS status, CASE WHEN k > 0 AND status IN ({IN_LIST(R.BUSY)}) THEN CASE k WHEN 1 THEN 'no video' ELSE 'Cancelled by creator' END END AS error FROM j""",
)
def ended_jobs(spark, d) -> DataFrame:
    e = table(spark, d, "events", "event_id")
    status = F.element_at(F.array(*[F.lit(s) for s in _STATES]), (F.col("event_id") % len(_STATES) + 1).cast("int"))
    jobs = e.select(F.col("event_id").alias("job_id"), status.alias("status"), F.lit(None).cast("string").alias("error"))
    stops = e.where("event_id % 3 > 0").select(F.col("event_id").alias("job_id"), F.when(F.col("event_id") % 3 == 1, "FAILED").otherwise("CANCELLED").alias("status"), F.lit("no video").alias("error"))
    return R.end_jobs(jobs, stops)


@query(
    "new_job_ids",
    """WITH o AS (SELECT strftime(ts, '%Y%m%d') AS day, count(*) AS n FROM events WHERE event_id % 4 = 0 GROUP BY 1), r AS (SELECT event_id, strftime(ts, '%Y%m%d') AS day, row_number() OVER (PARTITION BY strftime(ts, '%Y%m%d') ORDER BY event_id) AS k FROM events WHERE event_id % 4 = 1)
SELECT printf('job_%s_%03d', r.day, k + coalesce(n, 0)) AS job_id, event_id AS at FROM r LEFT JOIN o USING (day)""",
)
def new_job_ids(spark, d) -> DataFrame:
    e = table(spark, d, "events", "event_id", "ts").select("event_id", F.date_format("ts", "yyyyMMdd").alias("day"))
    old = e.where("event_id % 4 = 0").select(F.concat(F.lit("job_"), "day", F.lit("_x")).alias("job_id"))
    return R.new_job_ids(e.where("event_id % 4 = 1").select("day", F.col("event_id").alias("at")), old).select("job_id", "at")


@query(
    "job_media",
    """WITH f AS (SELECT event_id, event_id // 4 AS job_id, list_value('.avi', '.mkv', '.mov', '.mp4')[event_id % 4 + 1] AS s FROM events WHERE event_id % 3 > 0), o AS (SELECT job_id, arg_min('/j/' || job_id || '/original_video' || s, CASE s WHEN '.mp4' THEN 1 WHEN '.mov' THEN 2 WHEN '.mkv' THEN 3 ELSE 4 END) AS path FROM f WHERE job_id % 5 <> 0 GROUP BY job_id)
SELECT job_id, path FROM o UNION ALL SELECT DISTINCT job_id, '/j/' || job_id || '/other.mp4' FROM f WHERE job_id % 5 = 0""",
)
def job_media(spark, d) -> DataFrame:
    e = table(spark, d, "events", "event_id").where("event_id % 3 > 0")
    job = F.floor(F.col("event_id") / 4)
    suffix = F.element_at(F.array(*[F.lit(s) for s in (".avi", ".mkv", ".mov", ".mp4")]), (F.col("event_id") % 4 + 1).cast("int"))
    own = F.when(job % 5 == 0, F.lit("/other.mp4")).otherwise(F.concat(F.lit("/original_video"), suffix))
    found = e.select(job.alias("job_id"), F.concat(F.lit("/j/"), job, own).alias("path"))
    return files.media(found, found.select("job_id").distinct().select("job_id", F.concat(F.lit("/j/"), "job_id", F.lit("/other.mp4")).alias("original_path")))


@query(
    "job_payloads",
    f"""WITH f AS (SELECT DISTINCT user_id AS job_id FROM events) SELECT job_id, CASE WHEN job_id % 3 = 0 THEN 'REVIEWED' WHEN job_id % 3 = 1 THEN 'FAILED' ELSE 'QUEUED' END AS status, CASE WHEN job_id % 2 = 0 THEN 'file' ELSE 'row' END AS original_filename,
 CASE WHEN job_id % 4 = 0 THEN 1500 END AS duration_ms, job_id % 2 = 0 AS has_video, job_id % 5 < 2 AS has_captions, CASE WHEN job_id % 5 = 0 THEN job_id END AS words, '{X.DISCLAIMER}' AS disclaimer FROM f""",
)
def job_payloads(spark, d) -> DataFrame:
    j = table(spark, d, "events", F.col("user_id").alias("job_id")).distinct()
    i, none = F.col("job_id"), F.lit(None).cast("string")
    own = j.select(i, F.when(i % 3 == 0, "REVIEWED").alias("status"), F.when(i % 2 == 0, "file").otherwise("").alias("original_filename"), none.alias("original_path"), none.alias("error"), F.when(i % 4 == 0, "1.5").alias("duration"))
    rows = j.where("job_id % 3 < 2").select(i, F.lit("FAILED").alias("status"), F.lit("row").alias("original_filename"), none.alias("original_path"), none.alias("error"), F.lit(1).alias("created_at"), F.lit(2).alias("updated_at"))
    rows = rows.unionByName(j.where("job_id % 3 = 2").select(i, none.alias("status"), F.lit("row").alias("original_filename"), none.alias("original_path"), none.alias("error"), F.lit(1).alias("created_at"), F.lit(2).alias("updated_at")))
    out = R.job_payload(own, rows, j.where("job_id % 2 = 0").select(i, F.lit("/v").alias("path")), j.where("job_id % 5 < 2").select(i, (i % 5 == 0).alias("final")), j.select(i, i.alias("words")))
    return out.select("job_id", "status", "original_filename", F.col("duration_ms").cast("int").alias("duration_ms"), "has_video", "has_captions", F.col("quality.words").alias("words"), "disclaimer")


@query("job_row", "SELECT DISTINCT user_id AS job_id FROM events WHERE user_id = 7")
def job_row(spark, d) -> DataFrame:
    return files.job_row(table(spark, d, "events", F.col("user_id").cast("string").alias("job_id")).distinct(), "7").select(F.col("job_id").cast("long").alias("job_id"))


@query("newest_jobs", "SELECT DISTINCT user_id AS job_id FROM events ORDER BY 1 DESC LIMIT 25")
def newest_jobs(spark, d) -> DataFrame:
    return files.newest_jobs(table(spark, d, "events", F.col("user_id").alias("job_id")).distinct(), 25)


@query("busy_job", "SELECT event_id AS job_id FROM events WHERE event_type = 'click' ORDER BY ts, event_id LIMIT 1")
def busy_job(spark, d) -> DataFrame:
    e = table(spark, d, "events", "event_id", "ts", "event_type")
    return R.busy_job(e.select(F.col("event_id").alias("job_id"), F.col("event_type").alias("status"), F.col("ts").alias("created_at")), ["click"]).select("job_id")


# --- vocabulary and lexicon ----------------------------------------------------------------

_CATS = IN_LIST(V.CATEGORIES)
_KNOWN_CATEGORY = f"CASE WHEN category IN ({_CATS}) THEN category ELSE 'other' END"


@query(
    "vocabulary_log",
    f"""WITH g AS (SELECT event_id AS seq, CASE WHEN event_id % 3 = 0 THEN 'remove' ELSE 'add' END AS action, CASE WHEN event_id % 2 = 0 THEN 'TERM' ELSE 'Term' END || ' ' || (user_id * 7 + event_id // 97) % 900 AS term, list_value({_CATS})[event_id % 10 + 1] AS category FROM events),
 k AS (SELECT seq, action, term, lower(term) AS key, {_KNOWN_CATEGORY} AS category, coalesce(max(seq) FILTER (action = 'add') OVER w, -1) AS a, coalesce(max(seq) FILTER (action = 'remove') OVER w, -1) AS r FROM g WINDOW w AS (PARTITION BY lower(term)))
SELECT 'entry' AS kind, key, arg_max(term, seq) AS term, arg_max(category, seq) AS category, min(seq) AS position FROM k WHERE action = 'add' AND a > r AND seq > r GROUP BY key
UNION ALL SELECT 'gone', key, arg_min(term, seq), NULL, min(seq) FROM k WHERE action = 'remove' AND r > a AND seq > a GROUP BY key""",
)
def vocabulary_log(spark, d) -> DataFrame:
    e, i = table(spark, d, "events", "event_id", "user_id"), F.col("event_id")
    cats = F.array(*[F.lit(c) for c in V.CATEGORIES])
    term = F.concat_ws(" ", F.when(i % 2 == 0, "TERM").otherwise("Term"), ((F.col("user_id") * 7 + F.floor(i / 97)) % 900).cast("string"))
    log = e.select(i.alias("seq"), F.when(i % 3 == 0, "remove").otherwise("add").alias("action"), term.alias("term"), F.get(cats, (i % 10).cast("int")).alias("category"))
    entries, gone = V.replay(log)
    kind = lambda df, k: df.select(F.lit(k).alias("kind"), "key", "term", "category", "position")
    return kind(entries, "entry").unionByName(kind(gone.withColumn("category", F.lit(None).cast("string")), "gone"))


def _payloads(spark, d) -> DataFrame:
    """A vocabulary payload of each document's first words: entries as texts and objects, terms, groups and removed terms."""
    t = X.tokens(F.col("text"))
    word = lambda i: F.get(t, F.lit(i))
    entries = F.concat(F.lit("["), F.to_json(F.struct(word(1).alias("term"), F.lit("people").alias("category"))), F.lit(","), F.substring(F.to_json(F.array(word(0))), 2, 1 << 30))
    grouped = F.to_json(F.struct(F.array(word(3)).alias("toys"), F.array(word(0)).alias("none")))
    parts = [F.lit('{"entries":'), entries, F.lit(',"terms":'), F.to_json(F.array(word(2))), F.lit(',"grouped":'), grouped, F.lit(',"removed":'), F.to_json(F.array(word(0))), F.lit("}")]
    return table(spark, d, "documents", F.col("doc_id").alias("ord"), F.concat(*parts).alias("json"))


_MENTIONS = f"""WITH t AS (SELECT doc_id AS ord, regexp_extract_all(text, '\\S+') AS w FROM documents),
 m AS (SELECT ord, 0 AS k, '' AS j, 0 AS i, w[2] AS term, 'people' AS category FROM t UNION ALL SELECT ord, 0, '', 1, w[1], 'other' FROM t UNION ALL SELECT ord, 1, '', 0, w[3], 'other' FROM t
  UNION ALL SELECT ord, 2, 'toys', 0, w[4], 'toys' FROM t UNION ALL SELECT ord, 2, 'none', 0, w[1], 'other' FROM t),
 q AS (SELECT term, category, {NORM.format('term')} AS key, row_number() OVER (ORDER BY ord, k, j, i) AS seq FROM m WHERE term IS NOT NULL)
"""


@query("vocabulary_import", _MENTIONS + "SELECT key, arg_max(term, seq) AS term, arg_max(category, seq) AS category, min(seq) AS position FROM q WHERE key <> '' GROUP BY key")
def vocabulary_import(spark, d) -> DataFrame:
    return V.replay(V.imported(_payloads(spark, d)))[0]


@query("vocabulary_removed", f"SELECT term, row_number() OVER (ORDER BY term) AS position FROM (SELECT DISTINCT {NORM.format('w[1]')} AS term FROM (SELECT regexp_extract_all(text, '\\S+') AS w FROM documents)) WHERE term <> ''")
def vocabulary_removed(spark, d) -> DataFrame:
    return V.removed_terms(_payloads(spark, d))


@query(
    "allowlist_union",
    f"SELECT term, CAST(row_number() OVER (ORDER BY layer, ord) AS INT) AS position FROM (SELECT term, min(struct_pack(l := layer, o := ord)).l AS layer, min(struct_pack(l := layer, o := ord)).o AS ord FROM (SELECT {NORM.format('w[1]')} AS term, doc_id % 4 AS layer, doc_id AS ord FROM (SELECT doc_id, regexp_extract_all(text, '\\S+') AS w FROM documents)) WHERE term <> '' GROUP BY term)",
)
def allowlist_union(spark, d) -> DataFrame:
    layers = table(spark, d, "documents", (F.col("doc_id") % 4).alias("layer"), F.col("doc_id").alias("ord"), F.get(X.tokens(F.col("text")), F.lit(0)).alias("term"))
    return S.allowlist_union(layers)


@query(
    "vocabulary_by_category",
    _ITEM_WORDS
    + f""", v AS (SELECT t AS term, list_value({_CATS})[item_id % 8 + 1] AS category, item_id AS position FROM iw WHERE k = 1), c AS (SELECT unnest([{_CATS}]) AS category, generate_subscripts([{_CATS}], 1) - 1 AS k)
SELECT CAST(k AS INT) AS category_position, c.category, coalesce(string_agg(term, ',' ORDER BY position), '') AS terms FROM c LEFT JOIN v USING (category) GROUP BY ALL""",
)
def vocabulary_by_category(spark, d) -> DataFrame:
    cats = F.array(*[F.lit(c) for c in V.CATEGORIES])
    first = _item_words(spark, d).where("k = 1").select(F.col("t").alias("term"), F.get(cats, (F.col("item_id") % 8).cast("int")).alias("category"), F.col("item_id").alias("position"))
    return V.by_category(first, V.CATEGORIES).select("category_position", "category", F.array_join("terms", ",").alias("terms"))


# --- payloads of varying shape --------------------------------------------------------------


@query(
    "aligner_words",
    """WITH t AS (SELECT item_id, unnest(w) AS word, generate_subscripts(w, 1) - 1 AS i FROM (SELECT item_id, regexp_extract_all(text, '\\S+') AS w FROM benchmark)),
 k AS (SELECT item_id, word, i, CASE WHEN item_id % 4 = 1 THEN CAST(i % 10 / 10.0 AS DOUBLE) ELSE 1.0::DOUBLE END AS confidence FROM t WHERE item_id % 4 < 2 OR item_id % 4 = 2 AND i % 3 > 0 OR item_id % 4 = 3 AND i = 0)
SELECT item_id AS job_id, row_number() OVER (PARTITION BY item_id ORDER BY i) - 1 AS word_idx, word, CAST(i AS DOUBLE) AS start, CAST(i + 1 AS DOUBLE) AS "end", confidence FROM k""",
)
def aligner_words(spark, d) -> DataFrame:
    """Stamps as a list, under ``items``, with empty texts and null times, and one alone."""
    toks = X.tokens(F.col("text"))
    at = lambda i: i.cast("double")
    plain = F.to_json(F.transform(toks, lambda w, i: F.struct(w.alias("text"), at(i).alias("start_time"), at(i + 1).alias("end_time"))))
    held = F.to_json(F.struct(F.transform(toks, lambda w, i: F.struct(w.alias("word"), at(i).alias("start"), at(i + 1).cast("string").alias("end"), (i % 10 / 10.0).alias("confidence"))).alias("items")))
    odd = F.transform(toks, lambda w, i: F.struct(F.lit("").alias("text"), F.concat(w, F.lit(" ")).alias("word"), F.when(i % 3 > 0, at(i)).alias("start_time"), at(i).alias("start"), at(i + 1).alias("end")))
    one = F.to_json(F.struct(F.get(toks, F.lit(0)).alias("text"), F.lit(0.0).alias("start"), F.lit(1.0).alias("end")))
    k = F.col("item_id") % 4
    payload = F.when(k == 0, plain).when(k == 1, held).when(k == 2, F.to_json(odd, {"ignoreNullFields": "false"})).otherwise(one)
    return files.aligner_payloads(table(spark, d, "benchmark", F.col("item_id").alias("job_id"), payload.alias("json")))


@query(
    "speaker_maps",
    WORDS_CONV + _TURNS + """, s AS (SELECT job_id, turn, start_ms, end_ms, CASE WHEN job_id % 3 = 0 AND speaker = '1' THEN 'Host ' || job_id WHEN job_id % 3 = 0 THEN 'Guest' END AS shown, speaker FROM segments)
SELECT job_id, turn, coalesce(shown, speaker) AS speaker, start_ms, end_ms, coalesce(shown, 'Speaker ' || speaker) AS label FROM s""",
)
def speaker_maps(spark, d) -> DataFrame:
    """Each job's own names: a map by speaker and by label, one of blanks, and one that is no object."""
    jobs, i = table(spark, d, "conversations", F.col("conv_id").alias("job_id")).distinct(), F.col("job_id")
    full = F.concat(F.lit('{"1": "Host '), i.cast("string"), F.lit('", "Speaker 2": "Guest", "3": 7}'))
    maps = jobs.select("job_id", F.when(i % 3 == 0, full).when(i % 3 == 1, '{"1": "  ", "2": ""}').otherwise("[1]").alias("json"))
    return W.rename_speakers(W.pause_turns(words_of_conversations(spark, d)), files.speaker_names(maps)).select("job_id", "turn", "speaker", "start_ms", "end_ms", "label")


@query(
    "creator_settings",
    """SELECT event_id AS job_id, CASE event_id % 5 WHEN 1 THEN 'review-only' WHEN 2 THEN 'balanced' ELSE 'strict' END AS safety_mode, CASE event_id % 5 WHEN 1 THEN 'flag' ELSE 'censor' END AS unknown_profanity,
 event_id % 5 = 2 AS enable_sound_events, event_id % 5 <> 2 AS enable_speaker_labels FROM events""",
)
def creator_settings(spark, d) -> DataFrame:
    i = F.col("event_id")
    json = F.element_at(F.array(*[F.lit(x) for x in ('{"safety_mode": "odd"}', '{"safety_mode": " Review ", "unknown_profanity": "FLAG"}', '{"safety_mode": "balanced", "enable_sound_events": true, "enable_speaker_labels": false}', "not json", "[]")]), (i % 5 + 1).cast("int"))
    return files.creator_choices(table(spark, d, "events", i.alias("job_id"), json.alias("json")))


@query("recognizer_hints", "SELECT word AS term, n AS position FROM (SELECT word, min(doc_id * 100000 + k) AS n FROM (SELECT doc_id, unnest(regexp_extract_all(text, '\\S+')) AS word, generate_subscripts(regexp_extract_all(text, '\\S+'), 1) - 1 AS k FROM documents) GROUP BY word ORDER BY n LIMIT 40)")
def recognizer_hints(spark, d) -> DataFrame:
    words = words_of_documents(spark, d, by_job=False).groupBy(F.col("word").alias("term")).agg(F.min(F.col("job_id") * 100000 + F.col("word_idx")).alias("position"))
    return V.hints(words)


_EVEN = """WITH t AS (SELECT item_id AS job_id, regexp_extract_all(text, '\\S+') AS w, 10.0::DOUBLE AS d FROM benchmark), e AS (SELECT job_id, len(w) AS n, d, unnest(w) AS word, CAST(generate_subscripts(w, 1) - 1 AS BIGINT) AS word_idx FROM t),
 f AS (SELECT *, round(word_idx * (d / n), 3) AS s, round(least(d, (word_idx + 1) * (d / n)), 3) AS x FROM e) SELECT job_id, word_idx, word, CAST(round(s * 1000) AS BIGINT) AS start_ms, CAST(round(CASE WHEN x <= s THEN round(s + 0.01, 3) ELSE x END * 1000) AS BIGINT) AS end_ms FROM f"""


@query("stub_transcription", _EVEN)
def stub_transcription(spark, d) -> DataFrame:
    clips = table(spark, d, "benchmark", F.col("item_id").alias("job_id"), "text").withColumn("duration_s", F.lit(10.0))
    return recognition.transcribe(clips).select("job_id", "word_idx", "word", "start_ms", "end_ms")


@query("clip_recognition", _EVEN.replace("item_id AS job_id", "conv_id * 1000 + turn AS job_id").replace("benchmark", "conversations"))
def clip_recognition(spark, d) -> DataFrame:
    """Every turn of the conversations as a clip, through the table function."""
    clips = table(spark, d, "conversations", (F.col("conv_id") * 1000 + F.col("turn")).alias("job_id"), "text").withColumn("duration_s", F.lit(10.0))
    return recognition.recognised(clips).select("job_id", "word_idx", "word", "start_ms", "end_ms")


# --- audio levels -------------------------------------------------------------------------


def _frames(spark, d) -> DataFrame:
    """Quiet and loud stretches of 20 frames, from the positions of the documents' words."""
    w = words_of_documents(spark, d).select("job_id", F.col("word_idx").alias("frame"))
    loud = F.floor(F.col("frame") / 20) % 4 == F.col("job_id") % 4
    return w.withColumn("rms", F.when(loud, 0.3 + (F.col("frame") % 7) / 100.0).otherwise(0.005 + (F.col("frame") % 3) / 1000.0))


_FRAMES = """WITH f AS (SELECT job_id, frame, CASE WHEN frame // 20 % 4 = job_id % 4 THEN 0.3::DOUBLE + (frame % 7) / 100.0::DOUBLE ELSE 0.005::DOUBLE + (frame % 3) / 1000.0::DOUBLE END AS rms FROM
  (SELECT doc_id AS job_id, unnest(generate_series(0, len(regexp_extract_all(text, '\\S+')) - 1)) AS frame FROM documents)),
 l AS (SELECT job_id, median(rms) AS mid, quantile_cont(rms, 0.9) AS high FROM f GROUP BY job_id)
"""
_ISLANDS = "(SELECT *, frame - row_number() OVER (PARTITION BY job_id ORDER BY frame) AS g FROM {0})"


@query("audio_levels", _FRAMES + "SELECT job_id, round(mid, 6) AS mid, round(high, 6) AS high FROM l")
def audio_levels(spark, d) -> DataFrame:
    return A.levels(_frames(spark, d), "job_id").select("job_id", F.round("mid", 6).alias("mid"), F.round("high", 6).alias("high"))


_SPEECH = _FRAMES + """, on_ AS (SELECT f.* FROM f JOIN l USING (job_id) WHERE rms >= greatest(mid * 3, 0.02)),
 sp AS (SELECT job_id, min(frame) * 20 AS start_ms, (max(frame) + 1) * 20 AS end_ms FROM """ + _ISLANDS.format("on_") + """ GROUP BY job_id, g HAVING (max(frame) - min(frame) + 1) * 20 >= 120)
"""


@query("speech_regions", _SPEECH + "SELECT * FROM sp")
def speech_regions(spark, d) -> DataFrame:
    return A.speech_regions(_frames(spark, d), "job_id")


@query(
    "merged_regions",
    _SPEECH + """, m AS (SELECT *, CASE WHEN start_ms - max(end_ms) OVER (PARTITION BY job_id ORDER BY start_ms ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) < 1201 THEN 0 ELSE 1 END AS nw FROM sp), r AS (SELECT *, sum(nw) OVER (PARTITION BY job_id ORDER BY start_ms) AS k FROM m)
SELECT job_id, min(start_ms) AS start_ms, max(end_ms) AS end_ms FROM r GROUP BY job_id, k""",
)
def merged_regions(spark, d) -> DataFrame:
    return A.merge_regions(A.speech_regions(_frames(spark, d), "job_id"), 1201, "job_id")


def _spoken(spark, d) -> DataFrame:
    """A span of half a second in every three seconds."""
    w = words_of_documents(spark, d).where("word_idx % 150 = 0")
    return w.select("job_id", (F.col("word_idx") * 20).alias("start_ms"), (F.col("word_idx") * 20 + 500).alias("end_ms"))


_SPOKEN = """, wd AS (SELECT job_id, frame * 20 AS s, frame * 20 + 500 AS e FROM f WHERE frame % 150 = 0), wb AS (SELECT *, unnest([s // 3000 - 1, s // 3000, s // 3000 + 1]) AS bin FROM wd),
 isp AS (SELECT f.job_id, f.frame FROM f SEMI JOIN wb ON wb.job_id = f.job_id AND wb.bin = f.frame // 150 AND f.frame * 20 BETWEEN wb.s - 50 AND wb.e + 50)
"""


@query("frames_in_speech", _FRAMES + _SPOKEN + "SELECT * FROM isp")
def frames_in_speech(spark, d) -> DataFrame:
    return A.frames_in_speech(_frames(spark, d), _spoken(spark, d), key="job_id").select("job_id", "frame")


@query(
    "noise_events",
    _FRAMES + _SPOKEN + """, nz AS (SELECT f.*, mid, high, greatest(rms, coalesce(lead(rms) OVER (PARTITION BY job_id ORDER BY frame), 0)) AS pk FROM f JOIN l USING (job_id)), non AS (SELECT nz.* FROM nz ANTI JOIN isp ON isp.job_id = nz.job_id AND isp.frame = nz.frame WHERE rms >= greatest(mid * 2.5, 0.015) * 1.8),
 ev AS (SELECT job_id, min(frame) * 20 AS start_ms, (max(frame) + 1) * 20 AS end_ms, least(1.0::DOUBLE, 0.45::DOUBLE + 0.55::DOUBLE * (max(pk) / greatest(any_value(high), 1e-4))) AS confidence FROM """ + _ISLANDS.format("non") + """ GROUP BY job_id, g HAVING (max(frame) - min(frame) + 1) * 20 >= 250)
SELECT job_id, '[background noise]' AS label, start_ms, end_ms, round(confidence, 6) AS confidence FROM ev WHERE confidence > 0.8""",
)
def noise_events(spark, d) -> DataFrame:
    frames = _frames(spark, d)
    return A.noise_events(frames, A.frames_in_speech(frames, _spoken(spark, d), key="job_id"), Settings.sound_event_threshold, "job_id").withColumn("confidence", F.round("confidence", 6))
