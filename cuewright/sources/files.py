"""File sources: transcripts, captions, SRT, word lists, clips, jobs, audio.

Schemas are fixed; missing keys become null and are filled as the row types demand.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from cuewright.functions import text as X
from cuewright.operators.captions import parse_srt
from cuewright.operators.safety import LexiconTables
from cuewright.schema import CAPTIONS, CLIP, JOB, TRANSCRIPT

SEVERITIES = ["strong", "mild"]


def job_of(path: Column) -> Column:
    """The job id: the name of the folder that holds a file."""
    return F.element_at(F.split(path, "/"), -2)


def _json(spark: SparkSession, path, schema) -> DataFrame:
    df = spark.read.schema(schema).option("multiLine", True).option("mode", "PERMISSIVE").json(path)
    return df.withColumn("job_id", job_of(F.col("_metadata.file_path")))


def transcripts(spark: SparkSession, path) -> DataFrame:
    """Words of transcript files, with job_id and word_idx; times in milliseconds."""
    rows = _json(spark, path, TRANSCRIPT).select("job_id", F.posexplode("words").alias("word_idx", "w"))
    ms = lambda c: F.round(F.coalesce(c, F.lit(0.0)) * 1000).cast("long")
    return rows.select("job_id", F.col("word_idx").cast("long").alias("word_idx"), F.coalesce("w.word", F.lit("")).alias("word"), ms(F.col("w.start")).alias("start_ms"), ms(F.col("w.end")).alias("end_ms"), "w.confidence", "w.speaker")


def captions(spark: SparkSession, path) -> DataFrame:
    """Captions of caption files; reading speed nested or flat."""
    rows = _json(spark, path, CAPTIONS).select("job_id", F.posexplode("captions").alias("position", "c"))
    ms = lambda c: F.round(F.coalesce(c, F.lit(0.0)) * 1000).cast("long")
    speed = lambda k, flat: F.coalesce(F.col(f"c.reading_speed.{k}"), F.col(f"c.{flat}"))
    return rows.select(
        "job_id", F.coalesce("c.index", F.col("position") + 1).alias("caption"), ms(F.col("c.start")).alias("start_ms"), ms(F.col("c.end")).alias("end_ms"), F.coalesce("c.text", F.lit("")).alias("text"), "c.speaker",
        F.coalesce(speed("cps", "cps"), F.lit(0.0)).alias("cps"), F.coalesce(speed("wps", "wps"), F.lit(0.0)).alias("wps"), F.coalesce(speed("status", "reading_status"), F.lit("OK")).alias("reading_status"),
        F.coalesce("c.flags", F.expr("cast(array() as array<string>)")).alias("flags"), "c.mean_confidence", "c.confidence_band",
    )


def srt(spark: SparkSession, path) -> DataFrame:
    texts = spark.read.text(path, wholetext=True).select(job_of(F.col("_metadata.file_path")).alias("job_id"), F.col("value").alias("srt"))
    return parse_srt(texts)


def newest_stage(artifacts: DataFrame, order: list[str]) -> DataFrame:
    """Of each job the artifact whose stage comes first in ``order``. ``artifacts``: job_id, stage, path."""
    rank = F.array_position(F.array(*[F.lit(s) for s in order]), F.col("stage"))
    return artifacts.where(rank > 0).groupBy("job_id").agg(F.min_by(F.struct("stage", "path"), rank).alias("a")).select("job_id", "a.*")


def _lines(spark: SparkSession, path) -> DataFrame:
    plain = F.split(F.col("value"), "#")[0]
    return spark.read.text(path).select(F.split(plain, "\t").alias("p")).where(F.btrim(F.col("p")[0]) != "")


def lexicon_list(spark: SparkSession, path, phrases: bool = False) -> DataFrame:
    """(matched, severity) of a list file; missing and unknown severities are strong."""
    norm = X.normalize_phrase if phrases else X.normalize_token
    severity = F.lower(F.btrim(F.coalesce(F.get("p", F.lit(1)), F.lit("strong"))))
    out = _lines(spark, path).select(norm(F.btrim(F.col("p")[0])).alias("matched"), F.when(severity.isin(*SEVERITIES), severity).otherwise("strong").alias("severity"))
    return out.where("matched <> ''")


def lexicon(spark: SparkSession, words: list[str], phrases: list[str] | None = None, allowlists: list[str] | None = None, corrections_path: str | None = None, extra_allowed: tuple[str, ...] = (), vocabulary: tuple[str, ...] = ()) -> LexiconTables:
    """One lexicon of list files, corrections and extra terms, normalised, as tables; of repeated entries the last one counts."""

    def entries(paths: list[str] | None, many: bool) -> DataFrame:
        rows = spark.createDataFrame([], "matched string, severity string, file int, line long")
        for i, p in enumerate(paths or []):
            rows = rows.unionByName(lexicon_list(spark, p, many).select("matched", "severity", F.lit(i).alias("file"), F.monotonically_increasing_id().alias("line")))
        return rows.groupBy("matched").agg(F.max_by("severity", F.struct("file", "line")).alias("severity"))

    def terms(some: tuple[str, ...]) -> DataFrame:
        return spark.createDataFrame([(t,) for t in some], "term string").select(X.normalize_token(F.col("term")).alias("term")).where("term <> ''")

    listed = spark.createDataFrame([], "kind string, key string, ord int, cand string") if corrections_path is None else corrections(spark, corrections_path)
    part = lambda kind: listed.where(F.col("kind") == kind).select("key", "ord", "cand")
    allowed = terms(extra_allowed).unionByName(entries(allowlists, False).select(F.col("matched").alias("term"))).distinct()
    return LexiconTables(entries(words, False), entries(phrases, True), allowed, part("confusions"), part("collocations"), terms(vocabulary).distinct())


def vocabulary_list(spark: SparkSession, path, categories: list[str]) -> DataFrame:
    """(term, category) of a list file; missing and unknown categories are ``other``."""
    category = F.lower(F.btrim(F.coalesce(F.get("p", F.lit(1)), F.lit("other"))))
    return _lines(spark, path).select(F.btrim(F.col("p")[0]).alias("term"), F.when(category.isin(*categories), category).otherwise("other").alias("category"))


def corrections(spark: SparkSession, path) -> DataFrame:
    """(kind, key, ord, cand) of a corrections file with two maps of lists."""
    df = spark.read.schema("confusions map<string,array<string>>, collocations map<string,array<string>>").option("multiLine", True).json(path)
    part = lambda k: df.select(F.lit(k).alias("kind"), F.explode(k).alias("key", "v")).select("kind", "key", F.posexplode("v").alias("ord", "cand"))
    rows = part("confusions").unionByName(part("collocations"))
    sides = F.array_join(F.transform(F.split("key", r"\|", -1), X.normalize_token), "|")
    key = F.when(F.col("kind") == "collocations", sides).otherwise(X.normalize_token(F.col("key")))
    return rows.select("kind", key.alias("key"), "ord", X.normalize_token(F.col("cand")).alias("cand")).where("cand <> ''")


def _as_clips(df: DataFrame, name: Column) -> DataFrame:
    toks = X.tokens(F.coalesce("hypothesis.text", F.lit("")))
    made = F.transform(toks, lambda t, i: F.struct(t.alias("word"), (i * 0.3).alias("start"), (i * 0.3 + 0.25).alias("end"), F.lit(0.9).alias("confidence"), F.lit(None).cast("string").alias("speaker")))
    some = lambda *cs: F.coalesce(*[F.when(F.size(c) > 0, F.col(c)) for c in cs])
    text = lambda *cs: F.coalesce(*[F.nullif(F.col(c), F.lit("")) for c in cs], F.lit(""))
    none = lambda kind: F.expr(f"cast(array() as {kind})")
    pairs = "array<struct<from: string, to: string>>"
    return df.select(
        F.coalesce(F.nullif(F.col("id"), F.lit("")), name).alias("id"), text("reference.text", "reference_text").alias("reference"), F.coalesce(some("reference.words"), F.slice(made, 1, 0)).alias("reference_words"),
        F.coalesce(some("hypothesis.words", "words"), made).alias("words"), F.coalesce(some("safety.profane", "gold_profane"), none("array<string>")).alias("profane"),
        F.coalesce(some("safety.clean", "gold_clean"), none("array<string>")).alias("clean"), F.coalesce(some("safety.corrections", "gold_corrections"), none(pairs)).alias("corrections"),
    )


def clips(spark: SparkSession, paths) -> DataFrame:
    """Evaluation clips: nested or flat fields, words made from the text where only that is given, the file's name for a missing id."""
    df = spark.read.schema(CLIP).option("multiLine", True).json(paths)
    return _as_clips(df, F.regexp_extract(F.col("_metadata.file_path"), r"([^/]+?)(\.[^./]*)?$", 1))


def evaluation_set(spark: SparkSession, path: str) -> DataFrame:
    """Clips of a folder's manifest, by path or inline, or of one clip file; ValueError if there are none.

    The manifest is configuration and is read on the driver; clips are read by tasks.
    """
    single = path.endswith(".json") and not path.endswith("manifest.json")
    if single:
        return clips(spark, [path])
    at = path if path.endswith(".json") else f"{path.rstrip('/')}/manifest.json"
    held = spark.read.schema("clips array<string>").option("multiLine", True).json(at).first()
    entries = [e for e in (held["clips"] if held else None) or [] if e]
    inline = [(i, e) for i, e in enumerate(entries, start=1) if e.lstrip().startswith("{")]
    named = [f"{at.rsplit('/', 1)[0]}/{e}" for e in entries if not e.lstrip().startswith("{")]
    parts = [clips(spark, named)] if named else []
    if inline:
        rows = spark.createDataFrame(inline, "i int, raw string").select("i", F.from_json("raw", CLIP).alias("c"))
        parts.append(_as_clips(rows.select("i", "c.*"), F.concat(F.lit("clip_"), F.col("i").cast("string"))))
    if not parts:
        raise ValueError(f"no clips in {path}")
    return parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])


def clip_tables(rows: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(words, clips, reference words) for ``clip_scores`` from clips."""
    ms = lambda c: F.round(F.coalesce(F.col(c), F.lit(0.0)) * 1000).cast("long")

    def words(column: str) -> DataFrame:
        flat = rows.select(F.col("id").alias("job_id"), F.posexplode(column).alias("word_idx", "w"))
        return flat.select("job_id", F.col("word_idx").cast("long").alias("word_idx"), F.coalesce("w.word", F.lit("")).alias("word"), ms("w.start").alias("start_ms"), ms("w.end").alias("end_ms"), "w.confidence", "w.speaker")

    return words("words"), rows.select(F.col("id").alias("job_id"), "reference", "profane", "clean", "corrections"), words("reference_words")


def jobs(spark: SparkSession, path) -> DataFrame:
    """Job files; unreadable ones have null columns, and the folder's name for an id. Newest first is ``newest_jobs``."""
    df = spark.read.schema(StructType([*JOB.fields, StructField("_bad", StringType())])).option("multiLine", True).option("columnNameOfCorruptRecord", "_bad").json(path)
    return df.withColumn("job_id", F.coalesce("job_id", job_of(F.col("_metadata.file_path")))).drop("_bad")


def newest_jobs(rows: DataFrame, limit: int = 100) -> DataFrame:
    """The ``limit`` newest jobs by id, which starts with the day; a top-k, not a sort of all."""
    return rows.orderBy(F.desc("job_id")).limit(limit)


def job_row(rows: DataFrame, job_id: str) -> DataFrame:
    """The row of one job."""
    return rows.where(F.col("job_id") == job_id)


# media suffixes in their order (fixed values)
MEDIA = [".mp4", ".mov", ".mkv"]


def media(found: DataFrame, rows: DataFrame) -> DataFrame:
    """(job_id, path) of each job's media: ``original_video`` by suffix in the order of MEDIA, then by name, then the job's own path if that file is there.

    ``found``: (job_id, path) of existing files; ``rows``: job_id, original_path.
    """
    name = F.regexp_extract("path", "([^/]*)$", 1)
    suffix = F.lower(F.regexp_extract(name, r"(\.[^.]*)$", 1))
    place = F.array_position(F.array(*[F.lit(m) for m in MEDIA]), suffix)
    own = found.where(name.startswith("original_video.")).groupBy("job_id").agg(F.min_by("path", F.struct(F.when(place > 0, place).otherwise(len(MEDIA) + 1), name)).alias("p1_"))
    there = found.select(F.col("path").alias("original_path")).distinct().withColumn("p2_", F.col("original_path"))
    out = rows.select("job_id", "original_path").join(own, "job_id", "left").join(there, "original_path", "left")
    return out.select("job_id", F.coalesce("p1_", "p2_").alias("path")).where("path is not null")


def frame_rate(c: Column) -> Column:
    """``num/den`` as a number; null for a zero denominator."""
    part = F.split(c, "/")
    return part[0].try_cast("double") / F.nullif(F.coalesce(F.get(part, F.lit(1)).try_cast("double"), F.lit(1.0)), F.lit(0.0))


def aligned_words(stamps: DataFrame) -> DataFrame:
    """Aligner rows with either name of a field; rows without text or times fall away. An empty text counts as none."""
    has = set(stamps.columns)
    pick = lambda *names: F.coalesce(*[F.col(n) for n in names if n in has]) if has & set(names) else F.lit(None)
    text = F.coalesce(*[F.nullif(F.col(n), F.lit("")) for n in ("text", "word") if n in has], F.lit(""))
    rows = stamps.select("job_id", _stripped(text).alias("word"), pick("start_time", "start").cast("double").alias("start"), pick("end_time", "end").cast("double").alias("end"), F.coalesce(pick("confidence").cast("double"), F.lit(1.0)).alias("confidence"))
    return rows.where("word <> '' and start is not null and end is not null")


def _stripped(c: Column) -> Column:
    return F.regexp_replace(c, r"^\s+|\s+$", "")


def aligner_payloads(payloads: DataFrame) -> DataFrame:
    """(job_id, word_idx, word, start, end, confidence) of aligner payloads. ``payloads``: job_id, json.

    A payload is a list of stamps, an object with ``items``, or one stamp. A stamp's text is its
    ``text``, or its ``word`` where that is missing, null or empty, stripped; its times are
    ``start_time`` and ``end_time``, or ``start`` and ``end`` where those are missing (a null
    there is no time). Stamps without text or a time fall away, the rest is numbered densely; a
    missing confidence is 1. Texts that are no JSON have no words.
    """
    get = lambda v, path, kind: F.try_variant_get(v, path, kind)

    def number_of(v: Column, path: str) -> Column:
        return F.coalesce(get(v, path, "double"), get(v, path, "string").try_cast("double"))

    def time(v: Column, name: str, other: str) -> Column:
        return F.when(get(v, name, "variant").isNull(), number_of(v, other)).otherwise(number_of(v, name))

    def stamp(v: Column) -> Column:
        text = F.coalesce(F.nullif(get(v, "$.text", "string"), F.lit("")), get(v, "$.word", "string"), F.lit(""))
        return F.struct(
            _stripped(text).alias("word"), time(v, "$.start_time", "$.start").alias("start"), time(v, "$.end_time", "$.end").alias("end"), F.coalesce(number_of(v, "$.confidence"), F.lit(1.0)).alias("confidence")
        )

    held = payloads.select("job_id", F.try_parse_json("json").alias("p"))
    items = F.coalesce(get(F.col("p"), "$.items", "array<variant>"), get(F.col("p"), "$", "array<variant>"), F.array("p"))
    kept = F.filter(F.transform(items, stamp), lambda x: (x["word"] != "") & x["start"].isNotNull() & x["end"].isNotNull())
    rows = held.where("p is not null").select("job_id", F.posexplode(kept).alias("i", "x"))
    return rows.select("job_id", F.col("i").cast("long").alias("word_idx"), "x.*")


def payload_files(spark: SparkSession, paths) -> DataFrame:
    """(job_id, json) of whole files, by the name of the folder they lie in."""
    return spark.read.text(paths, wholetext=True).select(job_of(F.col("_metadata.file_path")).alias("job_id"), F.col("value").alias("json"))


def speaker_names(payloads: DataFrame) -> DataFrame:
    """(job_id, key, value) of speaker maps, for ``rename_speakers``; blank names and payloads that are no objects give nothing. ``payloads``: job_id, json."""
    held = payloads.select("job_id", F.explode(F.try_variant_get(F.try_parse_json("json"), "$", "map<string,variant>")).alias("key", "v"))
    value = F.coalesce(F.try_variant_get("v", "$", "string"), F.to_json("v"))
    return held.select("job_id", "key", value.alias("value")).where(_stripped(F.col("value")) != "")


def creator_choices(payloads: DataFrame) -> DataFrame:
    """(job_id, safety_mode, unknown_profanity, enable_sound_events, enable_speaker_labels) of stored settings over the defaults.

    ``payloads``: job_id, json. Modes are normalised, unknown ones are the strictest; what is no object has the defaults.
    """
    p = F.try_parse_json("json")
    text = lambda name: F.replace(F.lower(_stripped(F.coalesce(F.try_variant_get(p, f"$.{name}", "string"), F.lit("")))), F.lit("_"), F.lit("-"))
    flag = lambda name, default: F.coalesce(F.try_variant_get(p, f"$.{name}", "boolean"), F.lit(default))
    mode, unknown = text("safety_mode"), text("unknown_profanity")
    mode = F.when(mode == "safe", "strict").when(mode.isin("literal", "review"), "review-only").otherwise(mode)
    return payloads.select(
        "job_id", F.when(mode.isin("strict", "balanced", "review-only"), mode).otherwise("strict").alias("safety_mode"),
        F.when(unknown.isin("censor", "flag", "keep"), unknown).otherwise("censor").alias("unknown_profanity"),
        flag("enable_sound_events", False).alias("enable_sound_events"), flag("enable_speaker_labels", True).alias("enable_speaker_labels"),
    )


def audio(spark: SparkSession, path) -> DataFrame:
    return spark.read.format("binaryFile").load(path).select("path", "content")
