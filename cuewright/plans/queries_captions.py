"""Queries of captions and review over conversations, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cuewright.functions import text as X
from cuewright.operators import captions as C
from cuewright.operators import review as R
from cuewright.operators import safety as S
from cuewright.operators import words as W
from cuewright.plans.queries_safety import decisions_of, decisions_of_documents, _DECIDE, _HITS
from cuewright.plans.queries_words import sound_events, _EVENTS, _TURNS
from cuewright.plans.sql import IN_LIST, WORDS_CONV, WORDS_DOC
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


_CUES = """, hb AS (SELECT *, CASE WHEN lag(word) OVER w IS NULL OR speaker <> lag(speaker) OVER w OR start_ms - lag(end_ms) OVER w >= 600 OR regexp_matches(lag(word) OVER w, '[.!?]["''”’]*$') THEN 1 ELSE 0 END AS hard
  FROM words WINDOW w AS (PARTITION BY job_id ORDER BY word_idx)),
 isl AS (SELECT *, sum(hard) OVER (PARTITION BY job_id ORDER BY word_idx) AS island FROM hb),
 pos AS (SELECT *, row_number() OVER (PARTITION BY job_id, island ORDER BY word_idx) AS r FROM isl),
 cf AS (SELECT job_id, island, r, word_idx, start_ms AS cs, length(word) AS size, 1 AS head FROM pos WHERE r = 1
  UNION ALL SELECT p.job_id, p.island, p.r, p.word_idx, CASE WHEN p.end_ms - f.cs > 7000 OR f.size + 1 + length(p.word) > 84 THEN p.start_ms ELSE f.cs END,
   CASE WHEN p.end_ms - f.cs > 7000 OR f.size + 1 + length(p.word) > 84 THEN length(p.word) ELSE f.size + 1 + length(p.word) END, CASE WHEN p.end_ms - f.cs > 7000 OR f.size + 1 + length(p.word) > 84 THEN 1 ELSE 0 END
  FROM cf f JOIN pos p ON p.job_id = f.job_id AND p.island = f.island AND p.r = f.r + 1),
 cued AS (SELECT w.*, sum(head) OVER (PARTITION BY w.job_id ORDER BY w.word_idx) AS cue FROM words w JOIN cf ON w.job_id = cf.job_id AND w.word_idx = cf.word_idx),
 cues AS (SELECT job_id, cue, min(start_ms) AS start_ms, max(end_ms) AS end_ms, string_agg(word, ' ' ORDER BY word_idx) AS text, min(speaker) AS speaker, count(*) AS n_words, min(word_idx) AS first_word FROM cued GROUP BY job_id, cue)
"""


@query("segment_cues", WORDS_CONV + _CUES + "SELECT job_id, CAST(cue AS BIGINT) AS cue, start_ms, end_ms, text, speaker, n_words, first_word FROM cues")
def segment_cues(spark, d) -> DataFrame:
    return C.assemble(C.assign_cues(words_of_conversations(spark, d))).drop("mean_confidence")


_MERGED = """, mo AS (SELECT *, row_number() OVER (PARTITION BY job_id ORDER BY cue) AS r FROM cues),
 mf AS (SELECT job_id, r, cue, start_ms AS s, end_ms AS e, length(text) AS size, speaker, 1 AS head FROM mo WHERE r = 1
  UNION ALL SELECT job_id, r, cue, CASE WHEN j THEN s ELSE start_ms END, end_ms, CASE WHEN j THEN size + 1 + length(text) ELSE length(text) END, speaker2, CASE WHEN j THEN 0 ELSE 1 END
  FROM (SELECT o.job_id, o.r, o.cue, o.start_ms, o.end_ms, o.text, f.s, f.size, o.speaker AS speaker2, f.e - f.s < 500 AND coalesce(f.speaker = o.speaker, TRUE) AND o.end_ms - f.s <= 7000 AND f.size + 1 + length(o.text) <= 84 AS j
   FROM mf f JOIN mo o ON o.job_id = f.job_id AND o.r = f.r + 1)),
 mcue AS (SELECT job_id, cue, sum(head) OVER (PARTITION BY job_id ORDER BY r) AS m FROM mf),
 mwords AS (SELECT c.*, m FROM cued c JOIN mcue USING (job_id, cue)),
 merged AS (SELECT job_id, m AS cue, min(start_ms) AS start_ms, max(end_ms) AS end_ms, string_agg(word, ' ' ORDER BY word_idx) AS text, min(speaker) AS speaker, count(*) AS n_words, (200 * sum(CAST(round(confidence * 100) AS BIGINT)) + count(*)) // (2 * count(*)) / 10000.0::DOUBLE AS mean_confidence FROM mwords GROUP BY job_id, m)
"""


def _merged_words(spark, d) -> DataFrame:
    return C.merge_short(C.assign_cues(words_of_conversations(spark, d)))


@query("merge_short_cues", WORDS_CONV + _CUES + _MERGED + "SELECT job_id, CAST(cue AS BIGINT) AS cue, start_ms, end_ms, text, speaker, n_words, mean_confidence FROM merged")
def merge_short_cues(spark, d) -> DataFrame:
    return C.assemble(_merged_words(spark, d)).drop("first_word")


_WRAP = f"""CASE WHEN length(flat) <= 42 THEN flat ELSE coalesce((SELECT a || chr(10) || b FROM (SELECT i, array_to_string(list_slice(w, 1, i), ' ') AS a, array_to_string(list_slice(w, i + 1, len(w)), ' ') AS b,
  lower(regexp_replace(w[i], '[.!?,;:]+$', '')) AS lw, len(w) AS n FROM (SELECT unnest(generate_series(1, len(w) - 1)) AS i)) WHERE length(a) <= 42 AND length(b) <= 42
  ORDER BY -abs(length(a) - length(b)) * 0.5 - CASE WHEN lw IN ({IN_LIST(X.WEAK_ENDINGS)}) THEN 20 ELSE 0 END - CASE WHEN n - i = 1 AND length(a) > 42 * 0.55 THEN 12 ELSE 0 END - CASE WHEN length(a) < 42 * 0.35 THEN 6 ELSE 0 END DESC, i LIMIT 1),
  trim(CASE WHEN strpos(left(flat, 43), ' ') > 1 THEN left(flat, sp) || chr(10) || rtrim(CASE WHEN length(flat) - sp - 1 > 42 THEN substr(flat, sp + 2, 42) ELSE substr(flat, sp + 2) END) ELSE left(flat, 42) || chr(10) || rtrim(left(ltrim(substr(flat, 43)), 42)) END, ' ' || chr(10))) END"""


@query(
    "wrap_lines",
    WORDS_CONV + _CUES + f", fl AS (SELECT job_id, cue, text AS flat, string_split(text, ' ') AS w, 43 - strpos(reverse(left(text, 43)), ' ') AS sp FROM cues) SELECT job_id, CAST(cue AS BIGINT) AS cue, {_WRAP} AS lines FROM fl",
)
def wrap_lines(spark, d) -> DataFrame:
    cues = C.assemble(C.assign_cues(words_of_conversations(spark, d)))
    return cues.select("job_id", "cue", X.wrap_caption(F.col("text")).alias("lines"))


@query(
    "modal_speaker",
    WORDS_CONV + """, c AS (SELECT job_id, word_idx // 50 AS block, speaker, count(*) AS n, min(word_idx) AS f FROM words WHERE speaker <> '' GROUP BY ALL)
SELECT job_id, CAST(block AS BIGINT) AS block, arg_max(speaker, struct_pack(a := n, b := -f)) AS speaker FROM c GROUP BY job_id, block""",
)
def modal_speaker(spark, d) -> DataFrame:
    blocks = words_of_conversations(spark, d).groupBy("job_id", F.floor(F.col("word_idx") / 50).alias("block")).agg(F.array_sort(F.collect_list(F.struct("word_idx", "speaker"))).alias("w"))
    return blocks.select("job_id", "block", X.modal(F.transform("w", lambda x: x["speaker"])).alias("speaker"))


def _speed(chars: str, words: str, ms: str) -> str:
    seconds = f"(greatest({ms}, 1) / 1000.0::DOUBLE)"
    return f"({chars} / {seconds} > 17.0 OR {words} / {seconds} > 4.0)"


_DENSITY = f""", dq AS (SELECT job_id, m, list(word ORDER BY word_idx) AS w, list(start_ms ORDER BY word_idx) AS st, list(end_ms ORDER BY word_idx) AS en, list(CAST(round(confidence * 100) AS BIGINT) ORDER BY word_idx) AS cf, min(speaker) AS speaker FROM mwords GROUP BY job_id, m),
 dn AS (SELECT *, len(w) AS n, lead(st[1]) OVER (PARTITION BY job_id ORDER BY m) AS nxt FROM dq),
 dc AS (SELECT *, coalesce(list_filter(generate_series(1, n - 1), lambda i: regexp_matches(w[i], '[.!?]["\'\'”’]*$'))[1], list_filter(generate_series(1, n - 1), lambda i: suffix(w[i], ','))[1],
   list_filter(generate_series(1, n - 2), lambda i: lower(trim(w[i + 1], '.,!?')) IN ({IN_LIST(X.CONJUNCTIONS)}))[1], CASE WHEN n >= 6 THEN n // 2 END) AS cut FROM dn),
 dp AS (SELECT job_id, m, n AS total, 0 AS kind, w, st[1] AS s, greatest(en[n], st[1]) AS e, nxt, n, cf, speaker FROM dc
  UNION ALL SELECT job_id, m, n, 1, w[1:cut], st[1], greatest(en[cut], st[1]), st[cut + 1], cut, cf[1:cut], speaker FROM dc WHERE cut IS NOT NULL
  UNION ALL SELECT job_id, m, n, 2, w[cut + 1:n], st[cut + 1], greatest(en[n], st[cut + 1]), nxt, n - cut, cf[cut + 1:n], speaker FROM dc WHERE cut IS NOT NULL),
 df AS (SELECT *, array_to_string(w, ' ') AS flat, list_sum(cf) < 70 * n AS low FROM dp), dw AS (SELECT *, 43 - strpos(reverse(left(flat, 43)), ' ') AS sp FROM df),
 dl AS (SELECT *, {_WRAP} AS lines FROM dw), dm AS (SELECT *, length(lines) AS chars, len(regexp_extract_all(lines, '\\S+')) AS nw FROM dl),
 dd AS (SELECT *, {_speed('chars', 'nw', '(e - s)')} AS dense FROM dm),
 dj AS (SELECT *, max(CASE WHEN kind = 0 THEN dense::INT END) OVER c = 1 AND count(*) OVER c = 3 AND (min(CASE WHEN kind > 0 THEN dense::INT END) OVER c = 0 OR total >= 6) AS splits, max(CASE WHEN kind = 0 THEN low::INT END) OVER c = 1 AS plow FROM dd WINDOW c AS (PARTITION BY job_id, m)),
 dk AS (SELECT * FROM dj WHERE splits = (kind > 0)),
 dlong AS (SELECT *, least(greatest(e, s + CAST(ceil(chars * 1000 / 17.0::DOUBLE) AS BIGINT)), least(s + 7000, nxt - 80)) AS longer FROM dk),
 dy AS (SELECT *, dense AND longer > e + 1 AS stretched, CASE WHEN dense AND longer > e + 1 THEN longer ELSE e END AS e2 FROM dlong),
 dz AS (SELECT *, {_speed('chars', 'nw', '(e2 - s)')} AS still FROM dy),
 repaired AS (SELECT job_id, row_number() OVER (PARTITION BY job_id ORDER BY m, kind) AS caption, s AS start_ms, e2 AS end_ms, lines AS text, CAST(n AS INT) AS n_words, round(chars / (greatest(e2 - s, 1) / 1000.0::DOUBLE), 4) AS cps, round(nw / (greatest(e2 - s, 1) / 1000.0::DOUBLE), 4) AS wps,
   CASE WHEN still THEN 'too_fast' ELSE 'OK' END AS reading_status,
   concat_ws(',', CASE WHEN (splits OR dense) AND NOT (stretched AND NOT still) THEN 'reading_speed' END, CASE WHEN low OR plow THEN 'low_confidence' END, CASE WHEN stretched THEN 'timing_extended' END, CASE WHEN still AND NOT (splits OR dense) THEN 'reading_speed' END, CASE WHEN still THEN 'needs_review' END) AS flags, speaker, CAST((200 * list_sum(cf) + n) // (2 * n) / 10000.0 AS DOUBLE) AS mean_confidence, CASE WHEN list_sum(cf) >= 90 * n THEN 'high' WHEN low THEN 'low' ELSE 'medium' END AS confidence_band FROM dz)
"""


@query("density_repair", WORDS_CONV + _CUES + _MERGED + _DENSITY + "SELECT * FROM repaired")
def density_repair(spark, d) -> DataFrame:
    return C.repair_density(_merged_words(spark, d)).withColumn("flags", F.array_join("flags", ","))


@query(
    "caption_summary",
    WORDS_CONV + _CUES + _MERGED + _DENSITY + """SELECT job_id, count(*) AS caption_count, count(*) FILTER (contains(flags, 'reading_speed') OR reading_status <> 'OK') AS reading_speed_warnings,
 (200 * sum(CAST(round(cps * 10000) AS BIGINT)) // count(*) + 10000) // 20000 / 100.0::DOUBLE AS mean_cps, count(*) FILTER (contains(flags, 'needs_review')) AS needs_review FROM repaired GROUP BY job_id""",
)
def caption_summary(spark, d) -> DataFrame:
    return C.caption_summary(C.repair_density(_merged_words(spark, d)))


def _rough(cues: DataFrame) -> DataFrame:
    """Captions with every kind of fault."""
    i = F.col("cue")
    none = F.expr("cast(array() as array<string>)")
    start = F.col("start_ms") - 170 * (i % 4) - F.when(i == 1, 100).otherwise(0)
    end = F.col("end_ms") + F.when(i % 7 == 0, -2000).when(i % 5 == 0, 9000).otherwise(0) - 100 * (i % 3)
    return cues.select("job_id", i.alias("index"), F.when(i % 11 == 0, " ").otherwise(F.col("text")).alias("text"), start.cast("long").alias("start_ms"), end.cast("long").alias("end_ms"), none.alias("flags"))


_ROUGH = """, rough AS (SELECT job_id, CAST(cue AS BIGINT) AS index, CASE WHEN cue % 11 = 0 THEN ' ' ELSE text END AS text, CAST(start_ms - 170 * (cue % 4) - CASE WHEN cue = 1 THEN 100 ELSE 0 END AS BIGINT) AS s0,
  CAST(end_ms + CASE WHEN cue % 7 = 0 THEN -2000 WHEN cue % 5 = 0 THEN 9000 ELSE 0 END - 100 * (cue % 3) AS BIGINT) AS e0 FROM cues),
 p1 AS (SELECT *, trim(text) = '' AS gone, s0 < 0 OR e0 < 0 AS neg, greatest(e0, 0) < greatest(s0, 0) AS inv, least(greatest(s0, 0), greatest(e0, 0)) AS a, greatest(s0, e0, 0) AS b FROM rough),
 p1b AS (SELECT *, b - a < 500 AS short, CASE WHEN b - a < 500 THEN a + 500 ELSE b END AS e FROM p1),
 vo AS (SELECT *, row_number() OVER (PARTITION BY job_id ORDER BY index) AS r FROM p1b WHERE NOT gone),
 vf AS (SELECT job_id, r, index, a AS s, CASE WHEN e <= a THEN a + 500 ELSE e END AS e, FALSE AS ov, FALSE AS gp, e <= a AS st, a AS a0, CAST(NULL AS BIGINT) AS pe FROM vo WHERE r = 1
  UNION ALL SELECT job_id, r, index, s2, CASE WHEN e <= s2 THEN s2 + 500 ELSE e END, ov, gp, e <= s2, a0, pe FROM (SELECT *, CASE WHEN gp THEN pe ELSE s1 END AS s2 FROM (SELECT *, s1 > pe AND s1 - pe < 80 AS gp FROM
   (SELECT o.job_id, o.r, o.index, o.e, o.a AS a0, f.e AS pe, o.a < f.e AS ov, CASE WHEN o.a < f.e THEN f.e ELSE o.a END AS s1 FROM vf f JOIN vo o ON o.job_id = f.job_id AND o.r = f.r + 1)))),
 va AS (SELECT p.job_id, p.index, p.text, p.gone OR coalesce(f.s >= 60000, FALSE) AS gone, p.gone AS empty, coalesce(f.s, p.a) AS s, CASE WHEN f.s < 60000 AND f.e > 60000 THEN 60000 ELSE coalesce(f.e, p.e) END AS e, neg, inv, short, p.e - p.a > 7000 AS long, f.ov, f.gp, f.st, f.a0, f.pe, f.e AS e1, p.s0, p.e0,
   coalesce(f.s >= 60000 OR f.e > 60000, FALSE) AS outside, coalesce(f.s < 60000 AND f.e > 60000, FALSE) AS clamped FROM p1b p LEFT JOIN vf f ON f.job_id = p.job_id AND f.index = p.index)
"""


def _validated(spark, d) -> DataFrame:
    return C.validate(_rough(C.assemble(C.assign_cues(words_of_conversations(spark, d)))), duration_ms=60000)


@query(
    "validate_captions",
    WORDS_CONV + _CUES + _ROUGH + """SELECT job_id, index, CAST(row_number() OVER (PARTITION BY job_id ORDER BY index) AS BIGINT) AS caption, s AS start_ms, e AS end_ms,
 concat_ws(',', CASE WHEN neg OR inv OR short THEN 'timestamp_repaired' END, CASE WHEN long THEN 'needs_review' END, CASE WHEN NOT (neg OR inv OR short) AND (ov OR gp OR st OR clamped) THEN 'timestamp_repaired' END) AS flags FROM va WHERE NOT gone""",
)
def validate_captions(spark, d) -> DataFrame:
    kept = _validated(spark, d).where("not gone")
    return kept.select("job_id", "index", "caption", "start_ms", "end_ms", F.array_join("flags", ",").alias("flags"))


@query(
    "validation_issues",
    WORDS_CONV + _CUES + _ROUGH + """SELECT job_id, index, concat_ws(',', CASE WHEN empty THEN 'empty' END, CASE WHEN NOT empty AND neg THEN 'negative' END, CASE WHEN NOT empty AND inv THEN 'non_increasing' END,
 CASE WHEN NOT empty AND short THEN 'short_duration' END, CASE WHEN NOT empty AND long THEN 'long_duration' END, CASE WHEN ov THEN 'overlap' END, CASE WHEN gp THEN 'gap' END, CASE WHEN st THEN 'non_increasing' END, CASE WHEN outside THEN 'outside_video' END) AS types,
 concat_ws(';', CASE WHEN empty THEN 'Dropped empty caption' END, CASE WHEN NOT empty AND neg THEN printf('Clamped negative timestamp (%.3f/%.3f)', s0 / 1000.0::DOUBLE, e0 / 1000.0::DOUBLE) END, CASE WHEN NOT empty AND inv THEN printf('Swapped inverted times (%.3f>%.3f)', greatest(s0, 0) / 1000.0::DOUBLE, greatest(e0, 0) / 1000.0::DOUBLE) END,
  CASE WHEN NOT empty AND short THEN 'Extended cue shorter than 0.50s' END, CASE WHEN NOT empty AND long THEN 'Cue longer than 7.00s' END, CASE WHEN ov THEN printf('Moved start from %.3fs to %.3fs', a0 / 1000.0::DOUBLE, pe / 1000.0::DOUBLE) END,
  CASE WHEN gp THEN printf('Gap %.3fs below minimum 0.08s', (greatest(a0, pe) - pe) / 1000.0::DOUBLE) END, CASE WHEN st THEN 'Extended end so the cue is increasing' END, CASE WHEN outside AND NOT clamped THEN 'Dropped caption starting after video end' WHEN clamped THEN printf('Clamped end %.3fs to video duration 60.000s', e1 / 1000.0::DOUBLE) END) AS details
 FROM va WHERE empty OR neg OR inv OR short OR long OR ov OR gp OR st OR outside""",
)
def validation_issues(spark, d) -> DataFrame:
    rows = _validated(spark, d).where(F.size("issues") > 0)
    joined = lambda c, by: F.array_join(F.transform("issues", lambda x: x[c]), by)
    return rows.select("job_id", "index", joined("type", ",").alias("types"), joined("detail", ";").alias("details"))


_TC = "printf('%02d:%02d:%02d,%03d', {0} // 3600000, {0} // 60000 % 60, {0} // 1000 % 60, {0} % 1000)"


@query(
    "render_srt",
    WORDS_CONV + _CUES + f"""SELECT job_id, string_agg(CAST(r AS VARCHAR) || chr(10) || {_TC.format('CAST(start_ms AS BIGINT)')} || ' --> ' || {_TC.format('CAST(end_ms AS BIGINT)')} || chr(10) || text, chr(10) || chr(10) ORDER BY r) || chr(10) AS srt
 FROM (SELECT *, row_number() OVER (PARTITION BY job_id ORDER BY cue) AS r FROM cues) GROUP BY job_id""",
)
def render_srt(spark, d) -> DataFrame:
    return C.render_srt(C.assemble(C.assign_cues(words_of_conversations(spark, d))), order="cue")


@query(
    "parse_srt",
    WORDS_CONV + _CUES + "SELECT job_id, CAST(row_number() OVER (PARTITION BY job_id ORDER BY cue) - 1 AS INT) AS position, CAST(row_number() OVER (PARTITION BY job_id ORDER BY cue) AS INT) AS index, start_ms, end_ms, text FROM cues",
)
def parse_srt(spark, d) -> DataFrame:
    """Rendered and read again: the cues come back."""
    return C.parse_srt(render_srt(spark, d))


_DOC_CAPTIONS = ", caps AS (SELECT job_id, word_idx // 8 AS caption, min(start_ms) AS cs, max(end_ms) AS ce, string_agg(word, ' ' ORDER BY word_idx) AS text FROM words GROUP BY job_id, word_idx // 8)"


@query(
    "caption_safety_join",
    WORDS_DOC + _HITS + _DECIDE + _DOC_CAPTIONS + """SELECT c.job_id, c.caption, count(*) AS n_flags, string_agg(d.action || ':' || d.original, ',' ORDER BY d.word_idx) AS actions FROM caps c JOIN decisions d ON c.job_id = d.job_id
 AND ((d.end_ms > c.cs AND d.start_ms < c.ce) OR (d.original <> '' AND contains(lower(c.text), lower(d.original))) OR (contains(c.text, '_') AND d.action = 'censor')) WHERE d.action IN ('censor', 'flag', 'replace') OR d.needs_review GROUP BY ALL""",
)
def caption_safety_join(spark, d) -> DataFrame:
    words = words_of_documents(spark, d)
    caps = C.assemble(words.withColumn("cue", F.floor(F.col("word_idx") / 8))).select("job_id", F.col("cue").alias("caption"), "start_ms", "end_ms", "text")
    marked = R.caption_safety(caps, decisions_of_documents(spark, d))
    listed = F.array_join(F.transform("flags", lambda f: F.concat_ws(":", f["action"], f["original"])), ",")
    return marked.select("job_id", "caption", F.size("flags").cast("long").alias("n_flags"), listed.alias("actions"))


@query(
    "review_merge",
    WORDS_CONV + _CUES + """, ed AS (SELECT job_id, cue, row_number() OVER (PARTITION BY job_id ORDER BY cue) AS p FROM cues WHERE cue % 3 <> 0 UNION ALL SELECT job_id, 100000, 100000 FROM (SELECT DISTINCT job_id FROM cues))
SELECT e.job_id, CAST(row_number() OVER (PARTITION BY e.job_id ORDER BY e.p) AS INT) AS index, CASE WHEN e.cue = 100000 THEN 'new' ELSE 'edited ' || c.text END AS text, coalesce(c.speaker, 'none') AS speaker FROM ed e LEFT JOIN cues c ON c.job_id = e.job_id AND c.cue = e.cue""",
)
def review_merge(spark, d) -> DataFrame:
    cues = C.assemble(C.assign_cues(words_of_conversations(spark, d)))
    none = F.lit(None)
    existing = cues.select("job_id", F.col("cue").alias("caption"), F.expr("array('kept')").alias("flags"), none.cast("string").alias("confidence_band"), F.col("mean_confidence"))
    edit = cues.where("cue % 3 <> 0").select("job_id", F.col("cue").alias("caption"), F.col("cue").alias("position"), "start_ms", "end_ms", F.concat(F.lit("edited "), "text").alias("text"), "speaker")
    new = cues.select("job_id").distinct().select("job_id", F.lit(100000).alias("caption"), F.lit(100000).alias("position"), F.lit(0).alias("start_ms"), F.lit(1).alias("end_ms"), F.lit("new").alias("text"), F.lit("none").alias("speaker"))
    blank = lambda df: df.withColumns({"flags": none.cast("array<string>"), "confidence_band": none.cast("string"), "mean_confidence": none.cast("double")})
    return R.merge_edits(blank(edit.unionByName(new)), existing).select("job_id", "index", "text", "speaker")


_LOG = "(SELECT user_id AS job_id, ts AS at_, event_id, CASE WHEN event_id % 3 = 0 THEN NULL ELSE event_type END AS status, CASE WHEN event_id % 5 = 0 THEN 'e' || event_id END AS error FROM events)"


@query(
    "job_latest_status",
    f"""SELECT job_id, arg_max(status, k) FILTER (status IS NOT NULL) AS status, arg_max(error, k) FILTER (error IS NOT NULL) AS error, min(k) AS created_at, max(k) AS updated_at FROM (SELECT *, epoch_us(at_) * 1000 + event_id % 1000 AS k FROM {_LOG}) GROUP BY job_id""",
)
def job_latest_status(spark, d) -> DataFrame:
    e = table(spark, d, "events", "event_id", "user_id", "ts", "event_type")
    at = F.unix_micros(F.col("ts").cast("timestamp")) * 1000 + F.col("event_id") % 1000
    log = e.select(
        F.col("user_id").alias("job_id"), at.alias("at"), F.lit("f").alias("original_filename"), F.when(F.col("event_id") % 3 != 0, F.col("event_type")).alias("status"),
        F.when(F.col("event_id") % 5 == 0, F.concat(F.lit("e"), F.col("event_id"))).alias("error"),
    )
    return R.latest_status(log).select("job_id", "status", "error", "created_at", "updated_at")


_REPORT = """, cs AS (SELECT job_id, round(avg(confidence), 4) AS m, count(*) AS n, count(*) FILTER (confidence < 0.7) AS low FROM words GROUP BY job_id),
 ds AS (SELECT job_id, count(*) FILTER (action = 'replace') AS r, count(*) FILTER (action = 'censor') AS c, count(*) FILTER (action = 'flag' OR needs_review) AS f FROM decisions GROUP BY job_id),
 ss AS (SELECT job_id, count(*) AS n FROM segments GROUP BY job_id), es AS (SELECT job_id, count(*) AS n FROM kept GROUP BY job_id){0}
SELECT cs.job_id, CAST(round(m * 100) AS BIGINT) AS overall_confidence, cs.n AS words, low AS low_confidence_words, coalesce(f + r + c, 0) AS potential_profanity, coalesce(r, 0) AS automatically_corrected, coalesce(c, 0) AS censored,
 coalesce(ss.n, 0) AS speaker_changes, coalesce(es.n, 0) AS sound_events{1} FROM cs LEFT JOIN ds USING (job_id) LEFT JOIN ss USING (job_id) LEFT JOIN es USING (job_id){2}"""


_WARNED = (", rs AS (SELECT job_id, count(*) FILTER (contains(flags, 'reading_speed') OR reading_status <> 'OK') AS n FROM repaired GROUP BY job_id)", ", coalesce(rs.n, 0) AS reading_speed_warnings", " LEFT JOIN rs USING (job_id)")


@query("quality_report", WORDS_CONV + _HITS + _DECIDE + _TURNS + ", " + _EVENTS + _CUES + _MERGED + _DENSITY + _REPORT.format(*_WARNED))
def quality_report(spark, d) -> DataFrame:
    """The whole report of the conversations."""
    return _report(spark, d, words_of_conversations(spark, d))


@query("quality_report_captions", WORDS_DOC + _HITS + _DECIDE + _TURNS + ", " + _EVENTS + _CUES + _MERGED + _DENSITY + _REPORT.format(*_WARNED))
def quality_report_captions(spark, d) -> DataFrame:
    """The whole report of the documents."""
    return _report(spark, d, words_of_documents(spark, d))


def _report(spark, d, words: DataFrame) -> DataFrame:
    captions = C.caption_summary(C.captions(words))
    # a job has a turn, and one more for every long pause; counted with its words, as these need no second order for it
    told = W.confidence_records(words.withColumn("new_", W.after_pause()))
    confidence = W.confidence_summary(told, segments=F.count_if("new_") + 1)
    return R.quality_report(confidence, S.decision_summary(decisions_of(words)), captions, None, W.filter_events(sound_events(spark, d)))
