"""Caption cues: segmentation, merging, reading speed, validation, SRT.

Cues are rows with job_id, cue (from 1), start_ms, end_ms, text, speaker and n_words. Folds run
over arrays of small structs, one array for a job or for an island between hard breaks, and
keep only what the next step needs. Captions come from words in order by columns (``density``).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from cuewright.functions import text as X
from cuewright.operators import density as D
from cuewright.operators.folds import scan
from cuewright.operators.words import in_job
from cuewright.schema import Settings


def by_cue():
    return Window.partitionBy("job_id").orderBy("cue")


# --- segmentation -----------------------------------------------------------------------


def assign_cues(words: DataFrame, s: Settings = Settings()) -> DataFrame:
    """``words`` with cue (from 1).

    Speaker changes, pauses and sentence ends depend on the previous word only and cut a job
    into islands by a window; inside an island a fold carries the cue's start and text length.
    """
    w = in_job()
    last = F.lag("speaker").over(w)
    hard = (
        (F.coalesce(F.col("speaker"), F.lit("")) != "") & (F.coalesce(last, F.lit("")) != "") & (F.col("speaker") != last)
        | (F.col("start_ms") - F.lag("end_ms").over(w) >= s.pause_gap_ms)
        | X.has_terminal(F.lag("word").over(w))
    )
    rows = words.withColumn("hard_", F.coalesce(hard, F.lit(True)).cast("int")).withColumn("island_", F.sum("hard_").over(w))
    rest = [c for c in words.columns if c not in ("job_id", "word_idx")]
    islands = rows.groupBy("job_id", "island_").agg(F.array_sort(F.collect_list(F.struct("word_idx", *rest))).alias("w"))
    limit = s.max_chars * s.max_lines
    zero = F.struct(F.lit(None).cast("long").alias("start"), F.lit(0).alias("size"), F.lit(0).alias("at"), F.expr("cast(array() as array<int>)").alias("heads"))

    def step(acc: Column, x: Column) -> Column:
        long = F.length(x["word"])
        size = acc["size"] + 1 + long
        cut = acc["start"].isNull() | (x["end_ms"] - acc["start"] > s.max_cue_ms) | (size > limit)
        at = (acc["at"] + 1).cast("int").alias("at")
        fresh = F.struct(x["start_ms"].cast("long").alias("start"), long.cast("int").alias("size"), at, F.concat(acc["heads"], F.array((acc["at"] + 1).cast("int"))).alias("heads"))
        return F.when(cut, fresh).otherwise(F.struct(acc["start"].alias("start"), size.cast("int").alias("size"), at, acc["heads"].alias("heads")))

    # the words travel in their islands' arrays and are cut there, so nothing is joined back or moved again
    ends = lambda h, i: F.coalesce(F.get(h, i + 1), F.size("w") + 1)
    cued = islands.withColumn("h_", F.aggregate("w", zero, step, lambda a: a["heads"]))
    cued = cued.select("job_id", "island_", F.posexplode(F.transform("h_", lambda x, i: F.slice("w", x, ends(F.col("h_"), i) - x))).alias("at_", "w"))
    cued = cued.withColumn("cue", F.row_number().over(Window.partitionBy("job_id").orderBy("island_", "at_")).cast("long"))
    flat = cued.select("job_id", "cue", F.explode("w").alias("x"))
    return flat.select(*[F.col("job_id") if c == "job_id" else F.col(f"x.{c}").alias(c) for c in words.columns], "cue")


def assemble(words: DataFrame, cue: str = "cue") -> DataFrame:
    """Cues from words: first start, last end (the start at least), joined text, modal speaker, mean confidence."""
    item = F.struct("word_idx", "word", "speaker")
    rows = words.groupBy("job_id", cue).agg(
        F.min_by("start_ms", "word_idx").alias("start_ms"),
        F.max_by("end_ms", "word_idx").alias("end_ms"),
        F.array_sort(F.collect_list(item)).alias("w"),
        # decimal sums: the same in any order, and ties round up
        F.round(F.sum(F.col("confidence").cast("decimal(20,10)")) / F.count("confidence"), 4).cast("double").alias("mean_confidence"),
    )
    return rows.select(
        "job_id",
        F.col(cue).alias("cue"),
        "start_ms",
        F.greatest("start_ms", "end_ms").alias("end_ms"),
        F.array_join(F.transform("w", lambda x: x["word"]), " ").alias("text"),
        X.modal(F.transform("w", lambda x: x["speaker"])).alias("speaker"),
        F.size("w").alias("n_words"),
        F.col("w")[0]["word_idx"].alias("first_word"),
        "mean_confidence",
    )


def merge_short(words: DataFrame, s: Settings = Settings()) -> DataFrame:
    """``words`` with cue renumbered after short cues took in the cue that follows them.

    A cue that ends ``min_cue_ms`` or more after every start so far takes in no other, whatever it
    took in before: behind it a job is cut into pieces, and only inside these, mostly of one or two
    cues, a fold goes from cue to cue. The words travel in their cues' arrays, so nothing is joined
    back, and words that lie by job are not moved.
    """
    rest = [c for c in words.columns if c not in ("job_id", "cue", "word_idx")]
    cues = words.groupBy("job_id", "cue").agg(F.array_sort(F.collect_list(F.struct("word_idx", *rest))).alias("w"))
    start, end = F.col("w")[0]["start_ms"], F.element_at("w", -1)["end_ms"]
    cues = cues.select("job_id", "cue", start.cast("long").alias("start_ms"), F.greatest(start, end).cast("long").alias("end_ms"), F.length(F.array_join(F.transform("w", lambda x: x["word"]), " ")).alias("size"), F.transform("w", lambda x: F.coalesce(x["speaker"], F.lit(""))).alias("speakers"), "w")
    so_far = by_cue().rowsBetween(Window.unboundedPreceding, Window.currentRow)
    cues = cues.withColumn("done_", F.col("end_ms") - F.max("start_ms").over(so_far) >= s.min_cue_ms)
    cues = cues.withColumn("new_", F.coalesce(F.lag("done_").over(by_cue()), F.lit(True)).cast("int"))
    cues = cues.withColumn("piece_", F.sum("new_").over(so_far))
    rows = cues.groupBy("job_id", "piece_").agg(F.array_sort(F.collect_list(F.struct("cue", "start_ms", "end_ms", "size", "speakers", "w"))).alias("c"))
    limit = s.max_chars * s.max_lines
    zero = F.struct(F.lit(None).cast("long").alias("start"), F.lit(None).cast("long").alias("end"), F.lit(0).alias("size"), F.expr("cast(array() as array<string>)").alias("speakers"), F.expr("cast(array() as array<bigint>)").alias("heads"))

    def step(acc: Column, x: Column) -> Column:
        size = acc["size"] + 1 + x["size"]
        a, b = X.modal(acc["speakers"]), X.modal(x["speakers"])
        joins = (
            (acc["end"] - acc["start"] < s.min_cue_ms)
            & (x["end_ms"] - acc["start"] <= s.max_cue_ms)
            & (size <= limit)
            & (a.isNull() | b.isNull() | (a == b))
        )
        more = F.struct(acc["start"].alias("start"), x["end_ms"].alias("end"), size.cast("int").alias("size"), F.concat(acc["speakers"], x["speakers"]).alias("speakers"), acc["heads"].alias("heads"))
        fresh = F.struct(x["start_ms"].alias("start"), x["end_ms"].alias("end"), x["size"].cast("int").alias("size"), x["speakers"].alias("speakers"), F.concat(acc["heads"], F.array(x["cue"].cast("long"))).alias("heads"))
        return F.when(F.coalesce(joins, F.lit(False)), more).otherwise(fresh)

    alone = F.array(F.col("c")[0]["cue"].cast("long"))
    heads = F.when(F.size("c") == 1, alone).otherwise(F.aggregate("c", zero, step, lambda a: a["heads"]))
    flat = rows.withColumn("heads", heads).select("job_id", "heads", F.explode("c").alias("x")).select("job_id", F.col("x.cue").alias("was_"), F.array_contains("heads", F.col("x.cue").cast("long")).alias("head_"), F.posexplode("x.w").alias("at_", "y"))
    number = F.sum((F.col("head_") & (F.col("at_") == 0)).cast("int")).over(Window.partitionBy("job_id").orderBy("was_", "at_"))
    held = {c: F.col(f"y.{c}") for c in ("word_idx", *rest)} | {"job_id": F.col("job_id"), "cue": number}
    return flat.select(*[held[c].alias(c) for c in words.columns])


# --- reading speed ----------------------------------------------------------------------


def _speed(ms: Column) -> tuple[Column, Column]:
    """Characters and words a second of the columns chars and said."""
    seconds = F.greatest(ms, F.lit(1)) / F.lit(1000.0)
    return F.col("chars") / seconds, F.col("said") / seconds


def annotate_confidence(words: DataFrame, records: DataFrame) -> DataFrame:
    """``words`` with the overall confidence and band of the record with the same times and word; the last one counts.

    ``records``: job_id, word_idx, word, start_ms, end_ms, overall_confidence, band.
    """
    key = ["job_id", "start_ms", "end_ms", "word"]
    last = records.groupBy(*key).agg(F.max_by(F.struct("overall_confidence", "band"), "word_idx").alias("r_"))
    return words.join(last, key, "left").select(*words.columns, F.col("r_.overall_confidence").alias("overall_confidence"), F.col("r_.band").alias("record_band"))


def captions(words: DataFrame, s: Settings = Settings(), duration_ms: int | None = None) -> DataFrame:
    """Captions of words: ``repair_density`` of the cues of ``assign_cues`` after ``merge_short``, in one pass.

    Words are sorted by job once, and not moved if they lie so already; no cue becomes an array, and
    words are neither grouped nor sorted again.
    """
    return _repaired(words, in_job(), None, s, duration_ms)


def repair_density(words: DataFrame, s: Settings = Settings(), duration_ms: int | None = None) -> DataFrame:
    """Captions of cued words after dense ones were split, extended or flagged.

    A caption sees only itself and the next one's original start. Where words carry the columns of
    ``annotate_confidence``, a cue that stays whole has their mean and a flag for any low word.
    """
    w = Window.partitionBy("job_id").orderBy("cue", "word_idx")
    return _repaired(words, w, ~F.col("cue").eqNullSafe(F.lag("cue").over(w)), s, duration_ms)


_PARTS = (
    "caption int, start_ms long, end_ms long, text string, chars int, said int, next long, dense boolean, split boolean, n_words int, speaker string, "
    "mean_confidence double, confidence_band string, low boolean, parent_low boolean"
)


def _repaired(words: DataFrame, w: WindowSpec, new: Column | None, s: Settings, duration_ms: int | None) -> DataFrame:
    """Captions of words in the order of ``w``, by one pass over Arrow batches. ``new``: where a cue begins; without it, cues are cut and merged there too."""
    annotated, cued = "record_band" in words.columns, new is not None
    more = [new.alias("new")] if cued else []
    if annotated:
        more += [F.col("overall_confidence").cast("double").alias("overall"), ((F.col("record_band") == "low") & F.col("overall_confidence").isNotNull()).alias("low")]
    # the window puts a job's words together and in order, and moves none that lie so
    rows = words.select(
        "job_id", "word", F.col("start_ms").cast("long").alias("start_ms"), F.col("end_ms").cast("long").alias("end_ms"), F.col("confidence").cast("double").alias("confidence"),
        F.col("speaker").cast("string").alias("speaker"), (F.row_number().over(w) == 1).alias("first"), *more,
    )
    kind = T.StructType([rows.schema["job_id"], *T.StructType.fromDDL(_PARTS)])
    target = to_arrow_schema(kind)
    rows = rows.mapInArrow(lambda batches: D.repaired(batches, s, cued, annotated, target), kind)
    readable = F.col("start_ms") + F.ceil(F.col("chars") * 1000 / F.lit(max(s.max_cps, 0.1)))  # up, so that the rate is met
    limit = F.least(F.col("start_ms") + s.max_cue_ms, F.col("next") - s.min_caption_gap_ms, F.lit(duration_ms).cast("long"))
    longer = F.least(F.greatest(F.col("end_ms"), readable), limit)
    stretched = F.col("dense") & (longer > F.col("end_ms") + 1)
    rows = rows.withColumn("stretched", stretched).withColumn("end_ms", F.when(stretched, longer).otherwise(F.col("end_ms")))
    cps, wps = _speed(F.col("end_ms") - F.col("start_ms"))
    rows = rows.withColumn("still", (cps > s.max_cps) | (wps > s.max_wps))
    flag = lambda c, f: F.when(c, F.array(F.lit(f))).otherwise(F.expr("cast(array() as array<string>)"))
    # a split cue hands its flags down, then each part adds its own
    flags = F.concat(flag(F.col("split") | F.col("dense"), "reading_speed"), flag(F.col("parent_low") | F.col("low"), "low_confidence"))
    flags = F.when(F.col("stretched"), F.concat(flags, F.array(F.lit("timing_extended")))).otherwise(flags)
    # a stretched caption that reads well loses the flag; an untouched one keeps its parent's
    flags = F.when(F.col("stretched") & ~F.col("still"), F.array_remove(flags, "reading_speed")).otherwise(flags)
    flags = F.when(F.col("still"), F.concat(flags, F.array(F.lit("reading_speed"), F.lit("needs_review")))).otherwise(flags)
    return rows.select(
        "job_id", "caption", "start_ms", "end_ms", "text", "n_words", F.round(cps, 4).alias("cps"), F.round(wps, 4).alias("wps"),
        F.when(F.col("still"), "too_fast").otherwise("OK").alias("reading_status"), F.array_distinct(flags).alias("flags"), "speaker", "mean_confidence", "confidence_band",
    )


def caption_summary(captions: DataFrame) -> DataFrame:
    warned = F.array_contains("flags", "reading_speed") | (F.col("reading_status") != "OK")
    return captions.groupBy("job_id").agg(
        F.count("*").alias("caption_count"), F.count_if(warned).alias("reading_speed_warnings"), F.round(F.sum(F.col("cps").cast("decimal(20,4)")) / F.count("cps"), 2).cast("double").alias("mean_cps"),
        F.count_if(F.array_contains("flags", "needs_review")).alias("needs_review"),
    )


# --- validation -------------------------------------------------------------------------


_SEPARATED = T.StructType([T.StructField(n, T.LongType()) for n in ("s2", "e2", "moved")] + [T.StructField(n, T.BooleanType()) for n in ("overlap", "gap", "stretched")])


def _separated(rows: DataFrame, s: Settings) -> DataFrame:
    """(job_id, index, before, s2, e2, moved, overlap, gap, stretched): captions that start after the one before has ended.

    The end of a repaired caption is at most its own end, or that of an earlier one and
    ``min_cue_ms`` for every caption since. Windows know that bound, so a caption that starts well
    behind it owes nothing to those before: there a job is cut into pieces, which are gone through side by side.
    """
    by = Window.partitionBy("job_id").orderBy("index", "start_ms", "end_ms")
    far = F.greatest("end_ms", F.col("start_ms") + s.min_cue_ms)
    placed = rows.select("job_id", "index", "start_ms", "end_ms", F.row_number().over(by).alias("n_"), far.alias("far_"))
    bound = F.max(F.col("far_") - F.col("n_") * s.min_cue_ms).over(by.rowsBetween(Window.unboundedPreceding, -1)) + (F.col("n_") - 1) * s.min_cue_ms
    free = F.coalesce(F.col("start_ms") >= bound + s.min_caption_gap_ms, F.lit(True))
    pieces = placed.withColumn("piece_", F.sum(free.cast("int")).over(by.rowsBetween(Window.unboundedPreceding, Window.currentRow)))

    def step(last: int | None, start: int, end: int) -> tuple:
        moved = start
        overlap = last is not None and start < last
        gap = last is not None and last < start < last + s.min_caption_gap_ms
        if overlap or gap:
            moved = last
        stretched = end <= moved
        end = moved + s.min_cue_ms if stretched else end
        return end, {"s2": moved, "e2": end, "moved": last, "overlap": overlap, "gap": gap, "stretched": stretched}

    done = scan(pieces.drop("n_", "far_"), ["job_id", "piece_"], ["index", "start_ms", "end_ms"], ["start_ms", "end_ms"], "r_", _SEPARATED, None, step)
    return done.select("job_id", "index", F.col("start_ms").alias("before"), "r_.*")


def validate(captions: DataFrame, s: Settings = Settings(), duration_ms: int | None = None) -> DataFrame:
    """Repaired captions and all issues of each job.

    Returns job_id, caption (from 1, null for dropped ones), index (as it came), start_ms,
    end_ms, text, flags, the captions' other columns, and issues: array of (pass, type, repaired,
    detail). Passes one and three are row-local; pass two goes over the captions with the
    previous end (``_separated``).
    """
    issue = lambda k, t, detail, ok=True: F.array(F.struct(F.lit(k).alias("pass"), F.lit(t).alias("type"), F.lit(ok).alias("repaired"), (detail if isinstance(detail, Column) else F.lit(detail)).alias("detail")))
    none = F.expr("cast(array() as array<struct<pass: int, type: string, repaired: boolean, detail: string>>)")
    other = [c for c in captions.columns if c not in ("job_id", "index", "text", "start_ms", "end_ms", "flags")]
    said = lambda text, *ms: F.format_string(text, *[c / F.lit(1000.0) for c in ms])
    seconds = lambda ms: f"{ms / 1000:.2f}s"
    when = lambda c, x: F.when(c, x).otherwise(none)
    flag = lambda c, f: F.when(c, F.array(F.lit(f))).otherwise(F.expr("cast(array() as array<string>)"))
    empty = F.btrim(F.regexp_replace(F.col("text"), r"\s+", " ")) == ""
    negative = ~empty & ((F.col("start_ms") < 0) | (F.col("end_ms") < 0))
    lo, hi = F.greatest("start_ms", F.lit(0)), F.greatest("end_ms", F.lit(0))
    inverted = ~empty & (hi < lo)
    a, b = F.least(lo, hi), F.greatest(lo, hi)
    short = ~empty & (b - a < s.min_cue_ms)
    end = F.when(short, a + s.min_cue_ms).otherwise(b)
    long = ~empty & (end - a > s.max_cue_ms)
    one = captions.select(
        "job_id", "index", "text", *other, empty.alias("gone"), a.cast("long").alias("start_ms"), end.cast("long").alias("end_ms"),
        F.concat("flags", flag(negative | inverted | short, "timestamp_repaired"), flag(long, "needs_review")).alias("flags"),
        F.concat(
            when(empty, issue(1, "empty", "Dropped empty caption")), when(negative, issue(1, "negative", said("Clamped negative timestamp (%.3f/%.3f)", F.col("start_ms"), F.col("end_ms")))),
            when(inverted, issue(1, "non_increasing", said("Swapped inverted times (%.3f>%.3f)", lo, hi))), when(short, issue(1, "short_duration", f"Extended cue shorter than {seconds(s.min_cue_ms)}")),
            when(long, issue(1, "long_duration", f"Cue longer than {seconds(s.max_cue_ms)}", False)),
        ).alias("issues"),
    )
    two = _separated(one.where("not gone").select("job_id", "index", "start_ms", "end_ms"), s)
    both = one.join(two, ["job_id", "index"], "left")
    yes = lambda c: F.coalesce(F.col(c), F.lit(False))
    moved = yes("overlap") | yes("gap") | yes("stretched")
    limit = F.lit(duration_ms).cast("long")
    outside = F.coalesce(F.col("s2") >= limit, F.lit(False))
    clamped = F.coalesce(~outside & (F.col("e2") > limit), F.lit(False))
    out = both.select(
        "job_id", "index", "text", *other, (F.col("gone") | outside).alias("gone"), F.coalesce("s2", "start_ms").alias("start_ms"),
        F.when(clamped, limit).otherwise(F.coalesce("e2", "end_ms")).alias("end_ms"),
        F.array_distinct(F.concat("flags", flag(moved | clamped, "timestamp_repaired"))).alias("flags"),
        F.concat(
            "issues", when(yes("overlap"), issue(2, "overlap", said("Moved start from %.3fs to %.3fs", F.col("before"), F.col("moved")))),
            when(yes("gap"), issue(2, "gap", F.concat(said("Gap %.3fs below minimum ", F.greatest(F.col("before"), F.col("moved")) - F.col("moved")), F.lit(seconds(s.min_caption_gap_ms))))),
            when(yes("stretched"), issue(2, "non_increasing", "Extended end so the cue is increasing")), when(outside, issue(3, "outside_video", "Dropped caption starting after video end")),
            when(clamped, issue(3, "outside_video", said("Clamped end %.3fs to video duration %.3fs", F.col("e2"), limit))),
        ).alias("issues"),
    )
    number = F.when(~F.col("gone"), F.sum((~F.col("gone")).cast("int")).over(Window.partitionBy("job_id").orderBy("index")))
    return out.withColumn("caption", number)


# --- SRT --------------------------------------------------------------------------------


def render_srt(captions: DataFrame, order: str = "caption") -> DataFrame:
    """(job_id, srt): numbered blocks of the captions with text; empty for a job without any."""
    text = F.btrim(F.col("text"), F.lit(" \n\t"))
    shown = captions.select("job_id", F.struct(F.col(order).alias("o"), F.col("start_ms").alias("s"), F.greatest("start_ms", "end_ms").alias("e"), text.alias("t")).alias("c"))
    rows = shown.groupBy("job_id").agg(F.filter(F.array_sort(F.collect_list("c")), lambda c: c["t"] != "").alias("c"))
    block = F.transform(
        "c", lambda c, i: F.concat((i + 1).cast("string"), F.lit("\n"), X.format_timecode(c["s"]), F.lit(" --> "), X.format_timecode(c["e"]), F.lit("\n"), c["t"])
    )
    return rows.select("job_id", F.when(F.size("c") == 0, "").otherwise(F.concat(F.array_join(block, "\n\n"), F.lit("\n"))).alias("srt"))


def parse_srt(texts: DataFrame, text: str = "srt") -> DataFrame:
    """(job_id, position, index, start_ms, end_ms, text) of SRT texts.

    Blocks of fewer than two lines or without an arrow are skipped; a malformed time is an error.
    """
    chunks = F.split(F.btrim(F.col(text), F.lit(" \n\t\r")), r"\n\s*\n")
    rows = texts.where(F.btrim(F.col(text), F.lit(" \n\t\r")) != "").select("job_id", F.posexplode(chunks).alias("position", "chunk"))
    lines = F.split(F.col("chunk"), r"\r?\n")
    numbered = F.btrim(lines[0]).rlike("^[0-9]+$") & (F.size(lines) >= 3)
    time = F.when(numbered, lines[1]).otherwise(lines[0])
    body = F.when(numbered, F.slice(lines, 3, F.greatest(F.size(lines) - 2, F.lit(0)))).otherwise(F.slice(lines, 2, F.greatest(F.size(lines) - 1, F.lit(0))))
    kept = rows.where(F.size(lines) >= 2).select(
        "job_id", "position", F.when(numbered, F.btrim(lines[0]).cast("int")).otherwise(1).alias("index"), time.alias("time"), F.btrim(F.array_join(body, "\n"), F.lit(" \n")).alias("text")
    )
    kept = kept.where(F.col("time").contains("-->"))
    side = lambda k: F.btrim(F.split(F.col("time"), "-->")[k])
    return kept.select("job_id", "position", "index", X.parse_timecode(side(0)).alias("start_ms"), X.parse_timecode(F.split(side(1), r"\s+")[0]).alias("end_ms"), "text")
