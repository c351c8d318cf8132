"""Sinks: JSON artifacts, SRT files, Markdown and text reports, one text a job."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cuewright.functions import text as X
from cuewright.operators import captions as C
from cuewright.operators import safety as S
from cuewright.schema import Settings

# fixed values ---------------------------------------------------------------------------
DISCLAIMER = X.DISCLAIMER
REPORT_HEAD = "| Original | Replacement | Case | Action | Needs review | Reason |\n|---|---|---|---|---|---|"
REPORT_NONE = "| — | — | — | — | — | No safety decisions recorded |"
REPORT_END = "The original ASR transcript remains in `raw_transcript.json` and `raw.srt`."
# ----------------------------------------------------------------------------------------

_KEEP = {"ignoreNullFields": "false"}


def _seconds(c: str) -> Column:
    return F.round(F.col(c) / 1000, 3)


def _ordered(rows: DataFrame, by: str, value: Column, name: str) -> DataFrame:
    """(job_id, name): the values of each job in the order of ``by``."""
    held = rows.select("job_id", F.struct(F.col(by).alias("k"), value.alias("v")).alias("x_"))
    return held.groupBy("job_id").agg(F.transform(F.array_sort(F.collect_list("x_")), lambda x: x["v"]).alias(name))


def _word_json() -> Column:
    """A word's JSON: three decimals, null confidence written, null speaker left out."""
    base = [F.col("word"), _seconds("start_ms").alias("start"), _seconds("end_ms").alias("end"), F.col("confidence")]
    return F.when(F.col("speaker").isNull(), F.to_json(F.struct(*base), _KEEP)).otherwise(F.to_json(F.struct(*base, F.col("speaker")), _KEEP))


def transcript_json(words: DataFrame) -> DataFrame:
    """(job_id, json) of words."""
    rows = _ordered(words, "word_idx", F.struct(_word_json().alias("j"), F.col("word").alias("word")), "w")
    text = F.to_json(F.struct(F.array_join(F.transform("w", lambda x: x["word"]), " ").alias("text")))
    return rows.select("job_id", F.concat(F.left(text, F.length(text) - 1), F.lit(',"words":['), F.array_join(F.transform("w", lambda x: x["j"]), ","), F.lit("]}")).alias("json"))


def write_artifact(df: DataFrame, path: str, column: str) -> None:
    """One text a job under ``path/job_id=...``."""
    df.select("job_id", F.col(column).alias("value")).write.mode("overwrite").partitionBy("job_id").text(path)


def captions_json(captions: DataFrame, words: DataFrame | None = None) -> DataFrame:
    """(job_id, json): captions in their wire form, and their summary.

    ``words``: job_id, caption, word_idx and the columns of words; without them the lists are empty.
    """
    none = F.expr("cast(array() as array<string>)")
    rows = captions
    if words is not None:
        held = words.select("job_id", "caption", F.struct("word_idx", _word_json().alias("j")).alias("w_"))
        rows = rows.join(held.groupBy("job_id", "caption").agg(F.transform(F.array_sort(F.collect_list("w_")), lambda x: x["j"]).alias("w_")), ["job_id", "caption"], "left")
    own = F.coalesce(F.col("w_"), none) if words is not None else none
    speed = F.struct(F.round("cps", 2).alias("cps"), F.round("wps", 2).alias("wps"), F.col("reading_status").alias("status"))
    lines = F.filter(F.split("text", "\n"), lambda x: x != "")
    head = F.to_json(F.struct(F.col("caption").alias("index"), _seconds("start_ms").alias("start"), _seconds("end_ms").alias("end"), "text", lines.alias("lines")), _KEEP)
    tail = F.to_json(F.struct("speaker", speed.alias("reading_speed"), "flags", "mean_confidence", "confidence_band"), _KEEP)
    one = F.concat(F.left(head, F.length(head) - 1), F.lit(',"words":['), F.array_join(own, ","), F.lit("],"), F.substring(tail, 2, F.length(tail)))
    summary = C.caption_summary(captions)
    sums = F.to_json(F.struct("caption_count", "reading_speed_warnings", "mean_cps", "needs_review"))
    listed = _ordered(rows, "caption", one, "c").join(summary, "job_id")
    return listed.select("job_id", F.concat(F.lit('{"captions":['), F.array_join("c", ","), F.lit('],"summary":'), sums, F.lit("}")).alias("json"))


def srt_with_report(captions: DataFrame, s: Settings = Settings(), duration_ms: int | None = None) -> DataFrame:
    """(job_id, srt, validation, issue_count, repaired) of captions after validation."""
    rows = C.validate(captions, s, duration_ms)
    srt = C.render_srt(rows.where("not gone"))
    issue = lambda x: F.struct(x["i"].alias("index"), x["t"].alias("type"), x["r"].alias("repaired"), x["d"].alias("detail"))
    # passes one after the other, captions in order within a pass
    said = rows.select("job_id", "index", F.posexplode("issues").alias("n_", "x")).select("job_id", F.struct(F.col("x.pass").alias("p"), F.col("index").alias("i"), F.col("n_").alias("n"), F.col("x.type").alias("t"), F.col("x.repaired").alias("r"), F.col("x.detail").alias("d")).alias("x"))
    lists = said.groupBy("job_id").agg(F.transform(F.array_sort(F.collect_list("x")), issue).alias("issues"))
    out = rows.select("job_id").distinct().join(srt, "job_id", "left").join(lists, "job_id", "left")
    n = F.when(F.col("issues").isNull(), 0).otherwise(F.size("issues"))
    fixed = F.coalesce(F.exists("issues", lambda x: x["repaired"]), F.lit(False))
    none = F.expr("cast(array() as array<struct<index: bigint, type: string, repaired: boolean, detail: string>>)")
    body = F.to_json(F.struct(fixed.alias("repaired"), n.alias("issue_count"), F.coalesce(F.col("issues"), none).alias("issues")))
    return out.select("job_id", F.coalesce("srt", F.lit("")).alias("srt"), body.alias("validation"), n.cast("long").alias("issue_count"), fixed.alias("repaired"))


def correction_report(jobs: DataFrame, decisions: DataFrame) -> DataFrame:
    """(job_id, report): each job's decisions as Markdown; pipes become slashes. ``jobs``: job_id, mode, unknown_profanity."""
    clean = lambda c: F.replace(F.coalesce(F.col(c).cast("string"), F.lit("")), F.lit("|"), F.lit("/"))
    plain = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    needs = F.when(F.coalesce("needs_review", F.lit(False)), "yes").otherwise("no")
    line = F.concat(F.lit("| "), F.concat_ws(" | ", clean("original"), clean("replacement"), plain("case"), plain("action"), needs, clean("reason")), F.lit(" |"))
    rows = jobs.join(_ordered(decisions, "word_idx", line, "r"), "job_id", "left")
    known = lambda c: F.coalesce(F.col(c), F.lit("unknown"))
    body = F.coalesce(F.array_join("r", "\n"), F.lit(REPORT_NONE))
    parts = [F.lit(f"# Correction report\n\n{DISCLAIMER}\n"), F.concat(F.lit("Job: `"), F.col("job_id").cast("string"), F.lit("`")), F.concat(F.lit("Mode: "), known("mode")), F.concat(F.lit("Unknown profanity: "), known("unknown_profanity"), F.lit("\n")), F.lit(REPORT_HEAD), body, F.lit(""), F.lit(REPORT_END), F.lit("")]
    return rows.select("job_id", F.concat_ws("\n", *parts).alias("report"))


def safety_json(jobs: DataFrame, hits: DataFrame, allowlist: DataFrame, s: Settings = Settings(), language: str = "en") -> DataFrame:
    """(job_id, json): hits of each job with mode, allow-list and summary; jobs without hits have zeros."""
    hit = F.struct(
        F.col("word_idx").alias("index"), F.col("end_idx").alias("end_index"), "word", _seconds("start_ms").alias("start"), _seconds("end_ms").alias("end"), "match_type", "matched", "severity", "allowlisted", "asr_confidence", "context_before", "context_after"
    )
    names = ["hit_count", "word_hits", "phrase_hits", "allowlisted", "strong", "mild"]
    rows = jobs.select("job_id").join(_ordered(hits, "word_idx", F.to_json(hit, _KEEP), "h"), "job_id", "left").join(S.summary(hits), "job_id", "left").na.fill(0, names)
    terms = allowlist.agg(F.array_sort(F.collect_set("term")).alias("allowlist_"))
    head = F.to_json(F.struct(F.lit(s.safety_mode).alias("mode"), F.lit(s.unknown_profanity).alias("unknown_profanity"), F.lit(language).alias("language"), F.col("allowlist_").alias("allowlist"), F.lit(DISCLAIMER).alias("disclaimer")))
    body = F.concat(F.left(head, F.length(head) - 1), F.lit(',"hits":['), F.coalesce(F.array_join("h", ","), F.lit("")), F.lit('],"summary":'), F.to_json(F.struct(*names)), F.lit("}"))
    return rows.crossJoin(F.broadcast(terms)).select("job_id", body.alias("json"))  # one row of terms


def export_set(captions: DataFrame, words: DataFrame, jobs: DataFrame, decisions: DataFrame, s: Settings = Settings()) -> DataFrame:
    """(job_id, reviewed_srt, raw_srt, report, status): what a job hands out; jobs under or after review become EXPORTED.

    ``captions``: of the newest version; ``words``: the recogniser's; ``jobs``: job_id, status, mode, unknown_profanity.
    """
    reviewed = C.render_srt(C.validate(captions, s).where("not gone")).withColumnRenamed("srt", "reviewed_srt")
    raw = C.repair_density(C.merge_short(C.assign_cues(words, s), s), s).withColumnRenamed("caption", "index")
    raw = C.render_srt(C.validate(raw, s).where("not gone")).withColumnRenamed("srt", "raw_srt")
    done = F.when(F.col("status").isin("READY_FOR_REVIEW", "REVIEWED", "EXPORTED"), "EXPORTED").otherwise(F.col("status"))
    out = jobs.join(reviewed, "job_id", "left").join(raw, "job_id", "left").join(correction_report(jobs, decisions), "job_id")
    return out.select("job_id", F.coalesce("reviewed_srt", F.lit("")).alias("reviewed_srt"), F.coalesce("raw_srt", F.lit("")).alias("raw_srt"), "report", done.alias("status"))


def evaluation_json(scores: DataFrame, summary: DataFrame, model: str) -> DataFrame:
    """(config, json): the summary and the clips' scores of each configuration."""
    metrics = [c for c in scores.columns if c not in ("config", "clip")]
    clip = F.struct(F.col("clip").alias("id"), F.struct(*metrics).alias("metrics"))
    clips = scores.groupBy("config").agg(F.array_sort(F.collect_list(clip)).alias("clips"))
    own = F.struct(*[c for c in summary.columns if c != "config"])
    rows = summary.select("config", own.alias("summary")).join(clips, "config")
    return rows.select("config", F.to_json(F.struct(F.lit(model).alias("model"), "config", "summary", "clips", F.lit(DISCLAIMER).alias("disclaimer"), F.lit(X.NOTE).alias("note"))).alias("json"))


def reading_speed_text(captions: DataFrame) -> DataFrame:
    """(job_id, report): a line a caption on its reading speed, and the number of warnings."""
    line = F.format_string("#%d Reading speed: %.1f CPS / %.1f WPS  Status: %s", "caption", F.col("cps"), F.col("wps"), "reading_status")
    rows = _ordered(captions, "caption", F.struct(line.alias("l"), (F.col("reading_status") != "OK").alias("w")), "r")
    warned = F.size(F.filter("r", lambda x: x["w"]))
    return rows.select("job_id", F.concat(F.array_join(F.transform("r", lambda x: x["l"]), "\n"), F.format_string("\nReading-speed warnings: %d", warned)).alias("report"))


def allowlist_text(terms: DataFrame) -> DataFrame:
    """(text): the sorted distinct allow-list and its size."""
    names = F.array_sort(F.collect_set("term"))
    listed = F.when(F.size(names) > 0, F.array_join(names, ", ")).otherwise("(empty)")
    return terms.agg(F.format_string("Allowlist (%d words): %s", F.size(names), listed).alias("text"))

