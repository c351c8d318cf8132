"""Review: caption edits, safety marks on captions, job status, quality reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cuewright.functions import text as X
from cuewright.sources.shared import written


# states of a job (fixed values)
BUSY = ["UPLOAD", "QUEUED", "EXTRACTING_AUDIO", "TRANSCRIBING", "ALIGNING", "PUNCTUATING", "DETECTING_SPEAKERS", "DETECTING_SOUNDS", "SAFETY_ANALYSIS", "CORRECTING", "SEGMENTING", "GENERATING_SRT"]
REVIEW = ["READY_FOR_REVIEW", "REVIEWED", "EXPORTED"]
ENDED = ["FAILED", "CANCELLED"]


def decision_times(decisions: DataFrame, words: DataFrame) -> DataFrame:
    """``decisions`` with start_ms and end_ms of the words that they span; -1 where there is no such word.

    ``words`` are those before the correction, which the decisions' indices name.
    """
    bare = decisions.drop("start_ms", "end_ms")
    at = words.select("job_id", "word_idx", "start_ms")
    last = words.groupBy("job_id").agg(F.max("word_idx").alias("last_"))
    ends = words.select("job_id", F.col("word_idx").alias("to_"), F.col("end_ms").alias("e_"))
    out = bare.join(at, ["job_id", "word_idx"], "left").join(last, "job_id", "left")
    out = out.withColumn("to_", F.least("last_", F.greatest("end_idx", F.col("word_idx") + 1) - 1)).join(ends, ["job_id", "to_"], "left")
    end = F.when(F.col("start_ms").isNull(), -1).otherwise(F.col("e_"))
    return out.select(*bare.columns, F.coalesce("start_ms", F.lit(-1)).cast("long").alias("start_ms"), F.coalesce(end, F.lit(-1)).cast("long").alias("end_ms"))


GRAM = 3  # characters of a name's longest part that tokens are found by


def mentions(captions: DataFrame, names: DataFrame) -> DataFrame:
    """``captions`` with name_: each caption with each of its job's lower-case names that its text holds, as a substring.

    A part of a name without blanks lies within one token of the text. So the longest part of each
    name is looked up, by its first characters, among the distinct tokens of all captions, which
    gives postings of tokens for parts; a caption then meets only names that one of its tokens may
    hold, and the whole name is compared with the text. A job's captions and names are never paired,
    but for names of blanks alone. ``names``: job_id, name_, distinct.
    """
    cut = lambda c: F.filter(F.split(c, r"\s+"), lambda x: x != "")
    longest = F.array_max(F.transform(cut(F.col("name_")), lambda x: F.struct(F.length(x).alias("n"), x.alias("p"))))["p"]
    held = names.select(F.col("job_id").alias("nj_"), "name_", longest.alias("part_"))
    parts = held.where("part_ is not null").select("part_").distinct().withColumn("gram_", F.left("part_", F.lit(GRAM)))
    tokens = captions.withColumn("token_", F.explode(F.array_distinct(cut(F.lower("text")))))
    at = F.sequence(F.lit(1), F.length("token_"))
    grams = F.array_distinct(F.flatten(F.transform(at, lambda i: F.array(*[F.substring("token_", i, n + 1) for n in range(GRAM)]))))
    postings = tokens.select("token_").distinct().withColumn("gram_", F.explode(grams)).join(parts, "gram_")
    postings = written(postings.where(F.contains("token_", "part_")).select("token_", "part_").distinct(), "postings")
    met = tokens.join(postings, "token_").join(held.where("part_ is not null"), (F.col("job_id") == F.col("nj_")) & (postings["part_"] == held["part_"]))
    blank = captions.join(held.where("part_ is null"), F.col("job_id") == F.col("nj_"))
    cols = [*captions.columns, "name_"]
    both = met.where(F.contains(F.lower("text"), F.col("name_"))).select(cols).dropDuplicates(["job_id", "caption", "name_"])
    return both.unionByName(blank.where(F.contains(F.lower("text"), F.col("name_"))).select(cols))


def caption_safety(captions: DataFrame, decisions: DataFrame, bin_ms: int = 60_000) -> DataFrame:
    """(job_id, caption, flags): decisions that touch, name or censor something in a caption.

    Three arms: overlaps meet in time bins; names are looked up through the tokens that can hold
    them (``mentions``); marks meet by job, only in captions that hold one. Captions of jobs with decisions
    are written once for the three, the others left out before.
    """
    d = decisions.where(F.col("action").isin("censor", "flag", "replace") | F.col("needs_review")).select(
        F.col("job_id").alias("dj"), F.col("word_idx").alias("di"), F.col("start_ms").alias("ds"), F.col("end_ms").alias("de"), "original", "replacement", "reason", "action", "case", "needs_review"
    )
    at = lambda c: F.floor(F.col(c) / bin_ms)
    own = captions.select("job_id", "caption", "start_ms", "end_ms", "text").join(d.select(F.col("dj").alias("job_id")).distinct(), "job_id", "left_semi")
    c = written(own, "captions")
    bins = lambda df, a, b, name: df.where(F.col(b) >= F.col(a)).withColumn(name, F.explode(F.sequence(at(a), at(b))))
    left, right = bins(c, "start_ms", "end_ms", "cb_"), bins(d.where("ds >= 0"), "ds", "de", "db_")
    overlap = left.join(right, (F.col("job_id") == F.col("dj")) & (F.col("cb_") == F.col("db_")) & (F.col("de") > F.col("start_ms")) & (F.col("ds") < F.col("end_ms")))
    named = mentions(c, d.where("original <> ''").select(F.col("dj").alias("job_id"), F.lower("original").alias("name_")).distinct())
    mentioned = named.join(d, (F.col("job_id") == F.col("dj")) & (F.lower("original") == F.col("name_")))
    censored = c.where(F.contains("text", F.lit(X.CENSOR_MARK))).join(d.where("action = 'censor'"), F.col("job_id") == F.col("dj"))
    cols = [*c.columns, *d.columns]
    rows = overlap.select(cols).unionByName(mentioned.select(cols)).unionByName(censored.select(cols)).dropDuplicates(["job_id", "caption", "di"])
    flag = F.struct(
        "di", "original", "replacement", "case", "action", "reason", (F.col("needs_review") | F.col("action").isin("censor", "flag")).alias("needs_review"),
        X.apply_token(F.col("text"), F.col("original"), F.col("replacement")).alias("suggested_text"),
    )
    return rows.groupBy("job_id", "caption").agg(F.array_sort(F.collect_list(flag)).alias("flags"))


def merge_edits(edits: DataFrame, captions: DataFrame) -> DataFrame:
    """Edited captions over existing ones by index; unknown ones are new, others fall away."""
    old = captions.select("job_id", "caption", F.col("flags").alias("old_flags"), F.col("confidence_band").alias("old_band"), F.col("mean_confidence").alias("old_mean"))
    out = edits.join(old, ["job_id", "caption"], "left")
    none = F.expr("cast(array() as array<string>)")
    number = F.row_number().over(Window.partitionBy("job_id").orderBy("position"))
    return out.select(
        "job_id", number.alias("index"), "start_ms", "end_ms", "text", "speaker", F.coalesce("flags", "old_flags", none).alias("flags"),
        F.coalesce("confidence_band", "old_band").alias("confidence_band"), F.coalesce("mean_confidence", "old_mean").alias("mean_confidence"),
    )


def review_action(captions: DataFrame, actions: DataFrame) -> DataFrame:
    """Accept, keep censored or edit: one action a caption. ``captions`` carry ``suggested_text`` and ``original``."""
    rows = captions.join(actions, ["job_id", "caption"], "left")
    action = F.replace(F.lower(F.btrim(F.col("action"))), F.lit(" "), F.lit("_"))
    accept, keep, edit = action == "accept", action.isin("keep_censored", "keep"), action == "edit"
    masked = F.when(F.col("original").isNotNull() & ~F.contains("text", F.lit(X.CENSOR_MARK)), X.apply_token(F.col("text"), F.col("original"), F.lit(X.CENSOR_MARK))).otherwise(F.col("text"))
    text = F.when(accept, F.coalesce("suggested_text", "text")).when(keep, masked).when(edit, F.col("new_text")).otherwise(F.col("text"))
    flags = F.when(accept | edit, F.array_remove("flags", "needs_review")).otherwise(F.col("flags"))
    return rows.select("job_id", "caption", text.alias("text"), flags.alias("flags"))


def history(actions: DataFrame, before: DataFrame | None = None) -> DataFrame:
    """(job_id, action_no, caption, action, text): review actions appended to those before them.

    ``actions``: job_id, at, caption, action, text.
    """
    old = before if before is not None else actions.sparkSession.createDataFrame([], "job_id string, action_no long, caption long, action string, text string")
    so_far = old.groupBy("job_id").agg(F.max("action_no").alias("n_"))
    number = F.row_number().over(Window.partitionBy("job_id").orderBy("at", "caption"))
    name = F.replace(F.lower(F.btrim("action")), F.lit(" "), F.lit("_"))
    new = actions.withColumn("k_", number).join(so_far, "job_id", "left").select("job_id", (F.col("k_") + F.coalesce("n_", F.lit(0))).cast("long").alias("action_no"), F.col("caption").cast("long").alias("caption"), name.alias("action"), "text")
    return new if before is None else old.select(new.columns).unionByName(new)


def newest_version(versions: DataFrame) -> DataFrame:
    """Captions of each job's newest version. ``versions``: job_id, version, caption and the columns of captions."""
    top = F.max("version").over(Window.partitionBy("job_id"))
    return versions.withColumn("top_", top).where("version = top_").drop("top_", "version")


def persist_reviewed(versions: DataFrame, reviewed: DataFrame) -> DataFrame:
    """``versions`` with reviewed captions, numbered from 1, as a version more of their jobs; older ones stay."""
    last = versions.groupBy("job_id").agg(F.max("version").alias("v_"))
    number = F.row_number().over(Window.partitionBy("job_id").orderBy("caption"))
    new = reviewed.withColumn("caption", number).join(last, "job_id", "left").withColumn("version", F.coalesce(F.col("v_") + 1, F.lit(1)).cast("long"))
    return versions.unionByName(new.select([F.col(c).cast(versions.schema[c].dataType).alias(c) for c in versions.columns]))


def caption_at(captions: DataFrame, heads: DataFrame, bin_ms: int = 60_000) -> DataFrame:
    """(job_id, head_ms, caption, text): the caption that runs at each playhead, the first if several; null if none.

    Heads meet the captions of their time bin only.
    """
    bin_of = lambda c: F.floor(c / bin_ms)
    c = captions.where("end_ms > start_ms").select("job_id", "start_ms", "end_ms", "caption", "text")
    c = c.withColumn("bin_", F.explode(F.sequence(bin_of(F.col("start_ms")), bin_of(F.col("end_ms") - 1))))
    near = heads.select("job_id", "head_ms", bin_of(F.col("head_ms")).alias("bin_")).join(c, ["job_id", "bin_"], "left")
    runs = (F.col("start_ms") <= F.col("head_ms")) & (F.col("head_ms") < F.col("end_ms"))
    first = F.min_by(F.when(runs, F.struct("caption", "text")), F.when(runs, F.col("caption"))).alias("c_")
    return near.groupBy("job_id", "head_ms").agg(first).select("job_id", "head_ms", F.col("c_.caption").alias("caption"), F.col("c_.text").alias("text"))


def timeline(captions: DataFrame, durations: DataFrame) -> DataFrame:
    """(job_id, caption, clock, colour, left_pct, width_pct): how a time line shows captions.

    The whole is the larger of the last end and the duration, one second at least; a caption is
    0.6 percent wide at least, and one without a band is shown as high.
    """
    last = captions.groupBy("job_id").agg(F.max("end_ms").alias("end_")).join(durations, "job_id", "left")
    whole = last.select("job_id", F.greatest("end_", F.coalesce("duration_ms", F.lit(0)), F.lit(1000)).alias("whole_"))
    s = F.floor(F.greatest("start_ms", F.lit(0)) / 1000)
    share = lambda c: F.round(c * 100 / F.col("whole_"), 4)
    return captions.join(whole, "job_id").select(
        "job_id", "caption", F.format_string("%02d:%02d", F.floor(s / 60), s % 60).alias("clock"), F.coalesce("confidence_band", F.lit("high")).alias("colour"),
        share(F.col("start_ms")).alias("left_pct"), F.greatest(share(F.col("end_ms") - F.col("start_ms")), F.lit(0.6)).alias("width_pct"),
    )


def duration_ms(raw) -> Column:
    """Milliseconds of a duration in seconds as text or number; null if it is no number or not above zero."""
    value = raw.cast("string").try_cast("double")
    return F.when((value > 0) & (value < float("inf")), F.round(value * 1000).cast("long"))


def status_kind(status: Column) -> Column:
    """busy, review or ended; null for any other text."""
    return F.when(status.isin(*BUSY), "busy").when(status.isin(*REVIEW), "review").when(status.isin(*ENDED), "ended")


def end_jobs(jobs: DataFrame, stops: DataFrame) -> DataFrame:
    """Jobs after being failed or cancelled. ``stops``: job_id, status (FAILED or CANCELLED), error; only busy jobs change."""
    told = stops.select("job_id", F.col("status").alias("s_"), F.col("error").alias("e_"))
    hit = F.col("s_").isNotNull() & F.col("status").isin(*BUSY)
    text = F.when(F.col("s_") == "CANCELLED", "Cancelled by creator").otherwise(F.col("e_"))
    out = jobs.join(told, "job_id", "left")
    return out.withColumns({"error": F.when(hit, text).otherwise(F.col("error")), "status": F.when(hit, F.col("s_")).otherwise(F.col("status"))}).select(jobs.columns)


def new_job_ids(requests: DataFrame, existing: DataFrame) -> DataFrame:
    """Ids of new jobs: the day and a running number after the day's existing jobs. ``requests``: day (yyyymmdd), at."""
    day = F.regexp_extract("job_id", "^job_([0-9]{8})_", 1)
    counted = existing.groupBy(day.alias("day")).agg(F.count("*").alias("n_"))
    number = F.row_number().over(Window.partitionBy("day").orderBy("at"))
    rows = requests.withColumn("k_", number).join(counted, "day", "left")
    return rows.withColumn("job_id", F.format_string("job_%s_%03d", "day", F.col("k_") + F.coalesce("n_", F.lit(0)))).select("job_id", *requests.columns)


def job_payload(files: DataFrame, rows: DataFrame, media: DataFrame, versions: DataFrame, quality: DataFrame) -> DataFrame:
    """One row a job file: its own fields over those of the job index, with media, captions and quality.

    ``files``: job_id and the fields of job.json; ``rows``: the job index; ``media``: (job_id,
    path); ``versions``: job_id and ``final``, whether these captions are the final ones and not a
    review's; ``quality``: the columns of ``quality_report``, given only to jobs with final captions.
    """
    index = rows.select("job_id", *[F.col(c).alias(f"{c}_") for c in ("status", "original_filename", "original_path", "error")], "created_at", "updated_at")
    seen = versions.groupBy("job_id").agg(F.lit(True).alias("c_"), F.max("final").alias("final_"))
    out = files.join(index, "job_id", "left").join(media.select("job_id", F.col("path").alias("video")), "job_id", "left").join(seen, "job_id", "left").join(quality, "job_id", "left")
    text = lambda c: F.coalesce(F.nullif(F.col(c), F.lit("")), F.nullif(F.col(f"{c}_"), F.lit(""))).alias(c)
    has = F.coalesce("c_", F.lit(False))
    report = F.when(F.coalesce("final_", F.lit(False)), F.struct(*[c for c in quality.columns if c != "job_id"]))
    return out.select(
        "job_id", F.coalesce("status", "status_", F.lit("QUEUED")).alias("status"), text("original_filename"), text("original_path"), text("error"), duration_ms(F.col("duration")).alias("duration_ms"),
        "created_at", "updated_at", F.col("video").isNotNull().alias("has_video"), has.alias("has_captions"), report.alias("quality"), F.lit(X.DISCLAIMER).alias("disclaimer"),
    )


def latest_status(log: DataFrame) -> DataFrame:
    """Jobs from an append-only log: of each column the last value that is not null."""
    last = lambda c: F.max_by(c, F.when(F.col(c).isNotNull(), F.col("at"))).alias(c)
    return log.groupBy("job_id").agg(last("original_filename"), last("status"), last("error"), F.min("at").alias("created_at"), F.max("at").alias("updated_at"))


def busy_job(jobs: DataFrame, busy: list[str]) -> DataFrame:
    """The oldest job in a busy state."""
    return jobs.where(F.col("status").isin(*busy)).orderBy("created_at", "job_id").limit(1)


def quality_report(confidence: DataFrame, decisions: DataFrame, captions: DataFrame, segments: DataFrame | None, events: DataFrame) -> DataFrame:
    """One row a job from five summaries; missing ones count as zero. ``segments``: None where ``confidence`` has counted them, as segments."""
    out = confidence.select("job_id", "mean_confidence", "word_count", "low", *(["segments"] if segments is None else []))
    counted = [] if segments is None else [segments.groupBy("job_id").agg(F.count("*").alias("segments"))]
    for part in (decisions.select("job_id", "replaced", "censored", "flagged"), captions.select("job_id", "reading_speed_warnings"), *counted, events.groupBy("job_id").agg(F.count("*").alias("events"))):
        out = out.join(part, "job_id", "left")
    n = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long")
    return out.select(
        "job_id", F.round(F.coalesce("mean_confidence", F.lit(0.0)) * 100).cast("long").alias("overall_confidence"), n("word_count").alias("words"), n("low").alias("low_confidence_words"),
        (n("flagged") + n("replaced") + n("censored")).alias("potential_profanity"), n("replaced").alias("automatically_corrected"), n("censored").alias("censored"),
        n("segments").alias("speaker_changes"), n("events").alias("sound_events"), n("reading_speed_warnings").alias("reading_speed_warnings"),
    )
