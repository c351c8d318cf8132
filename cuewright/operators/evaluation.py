"""Evaluation: error rates, alignment, safety and correction scores, rollups, ablation."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cuewright.functions import text as X
from cuewright.operators import captions as C
from cuewright.operators import safety as S
from cuewright.operators import vocabulary as V
from cuewright.operators import words as W
from cuewright.schema import Settings
from cuewright.sources.shared import written

TOLERANCE_MS = 200


#: more than any distance
_FAR = 1 << 29


def _codes(a: list, b: list) -> tuple[np.ndarray, np.ndarray]:
    known = {t: i for i, t in enumerate(dict.fromkeys([*a, *b]))}
    return tuple(np.asarray([known[t] for t in x], np.int32) for x in (a, b))


class _Band:
    """Rows of the distance table, ``half`` diagonals to either side of those from corner to corner.

    Row i holds the columns from i + low on, in the order of their diagonals.
    """

    def __init__(self, left: np.ndarray, right: np.ndarray, half: int):
        self.left, self.slope = left, len(right) - len(left)
        self.low = min(0, self.slope) - half
        self.width = abs(self.slope) + 2 * half + 1
        self.columns = len(right)
        self.ramp = np.arange(self.width, dtype=np.int32)
        aside = np.full(self.width + len(left), -1, np.int32)
        self.padded, self.at = np.concatenate([aside, right, aside]), len(aside)

    def first(self) -> np.ndarray:
        j = self.low + self.ramp
        return np.where((j >= 0) & (j <= self.columns), j, _FAR).astype(np.int32)

    def after(self, row: np.ndarray, i: int) -> np.ndarray:
        """Row i from the row before it."""
        start = self.at + i + self.low - 1
        best = row + (self.padded[start : start + self.width] != self.left[i - 1])
        np.minimum(best[:-1], row[1:] + 1, out=best[:-1])
        best -= self.ramp
        np.minimum.accumulate(best, out=best)  # insertions along the row
        best += self.ramp
        best[max(0, self.columns - i - self.low + 1) :] = _FAR
        return best

    def last(self, every: int = 0) -> tuple[int, dict[int, np.ndarray]]:
        """The distance within the band, and every so many rows."""
        row = self.first()
        kept = {0: row}
        for i in range(1, len(self.left) + 1):
            row = self.after(row, i)
            if every and i % every == 0:
                kept[i] = row
        return int(row[self.slope - self.low]), kept


def _proven(left: np.ndarray, right: np.ndarray, every: int = 0) -> tuple[_Band, int, dict[int, np.ndarray]]:
    """A band that no optimal path leaves, its distance and every so many of its rows.

    A path that leaves a band of half-width h has 2 h + 2 steps aside and back, besides the
    difference of the lengths. So a distance of less is proven, with all its ties; else the band
    is widened, to twice its width or to what the distance found asks for.
    """
    half, whole = 8, max(len(left), len(right))
    while True:
        band = _Band(left, right, min(half, whole))
        distance, kept = band.last(every)
        if half >= whole or distance <= 2 * half + abs(band.slope) + 1:
            return band, distance, kept
        half = min(2 * half, (distance - abs(band.slope)) // 2 + 1)


def edit_distance(a: list, b: list) -> int:
    """Levenshtein distance of token lists, in time that follows the number of errors."""
    if not a or not b:
        return max(len(a), len(b))
    return _proven(*_codes(a, b))[1]


def alignment(a: list, b: list) -> list[tuple[int, int]]:
    """Index pairs of tokens that one optimal path aligns.

    Read from the end, a path goes diagonally where it can, else drops a token of ``a``, else one
    of ``b``. All optimal paths lie in the band, so the choices are those of the whole table. Every
    ``block``-th row of the band is kept, and the rows between two kept ones are made again when
    the path gets there: time follows the length times the errors, memory less than that.
    """
    if not a or not b:
        return []
    left, right = _codes(a, b)
    block = max(1, int(len(a) ** 0.5))
    band, _, kept = _proven(left, right, block)
    pairs, j = [], len(b)
    for low in range(len(a) - 1 - (len(a) - 1) % block, -1, -block):
        rows = [kept[low]]
        for i in range(low + 1, min(low + block, len(a)) + 1):
            rows.append(band.after(rows[-1], i))
        for i in range(len(rows) - 1, 0, -1):
            here, above, shift = rows[i], rows[i - 1], low + i + band.low
            token = left[low + i - 1]
            while True:
                at = j - shift
                if j and here[at] == above[at] + (right[j - 1] != token):
                    pairs.append((low + i - 1, j - 1))
                    j -= 1
                    break
                if at + 1 < band.width and here[at] == above[at + 1] + 1:
                    break
                j -= 1  # insertions happen while neither of the other steps fits
    return pairs[::-1]


def error_rates(pairs: DataFrame) -> DataFrame:
    """(id, wer, distance, reference_words, hypothesis_words, cer, cer_distance, reference_chars) of (id, reference, hypothesis)."""
    toks = pairs.select("id", X.eval_tokens(F.col("reference")).alias("r"), X.eval_tokens(F.col("hypothesis")).alias("h"))

    def run(batches):
        for batch in batches:
            dist = [edit_distance(r, h) for r, h in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(dist, pa.int64())], names=["id", "r", "h", "distance"])

    kind = toks.schema["id"].dataType.simpleString()
    rows = toks.mapInArrow(run, f"id {kind}, r array<string>, h array<string>, distance long")
    chars = lambda c: F.array_join(c, "")
    cer = F.levenshtein(chars("r"), chars("h")).cast("long")
    n, m = F.greatest(F.size("r"), F.lit(1)), F.greatest(F.length(chars("r")), F.lit(1))
    return rows.select(
        "id", F.round(F.col("distance") / n, 4).alias("wer"), "distance", F.size("r").cast("long").alias("reference_words"), F.size("h").cast("long").alias("hypothesis_words"),
        F.round(cer / m, 4).alias("cer"), cer.alias("cer_distance"), F.length(chars("r")).cast("long").alias("reference_chars"),
    )


def timestamp_accuracy(reference: DataFrame, hypothesis: DataFrame, tolerance_ms: int = TOLERANCE_MS) -> DataFrame:
    """Onset and offset errors of equally aligned tokens of each job."""
    pack = lambda df, name: df.groupBy("job_id").agg(F.array_sort(F.collect_list(F.struct("word_idx", X.normalize_token(F.col("word")).alias("t"), F.col("start_ms").cast("long").alias("start_ms"), F.col("end_ms").cast("long").alias("end_ms")))).alias(name))
    both = pack(reference, "r").join(pack(hypothesis, "h"), "job_id")

    def run(batches):
        for batch in batches:
            rows = []
            for job, r, h in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                pairs = [(r[i], h[j]) for i, j in alignment([x["t"] for x in r], [x["t"] for x in h])]
                errs = [(abs(a["start_ms"] - b["start_ms"]), abs(a["end_ms"] - b["end_ms"])) for a, b in pairs if a["t"] == b["t"] and a["t"]]
                n = len(errs)
                near = sum(s <= tolerance_ms and e <= tolerance_ms for s, e in errs)
                rows.append((job, n, sum(s for s, _ in errs), sum(e for _, e in errs), near))
            cols = list(zip(*rows, strict=True))
            yield pa.RecordBatch.from_arrays([pa.array(cols[0], batch.schema.types[0]), *[pa.array(c, pa.int64()) for c in cols[1:]]], names=["job_id", "pairs_compared", "onset", "offset", "near"])

    kind = both.schema["job_id"].dataType.simpleString()
    rows = both.mapInArrow(run, f"job_id {kind}, pairs_compared long, onset long, offset long, near long")
    mean = lambda c: F.coalesce(F.round(F.col(c) / F.nullif(F.col("pairs_compared"), F.lit(0)) / 1000, 4), F.lit(0.0))
    return rows.select(
        "job_id", "pairs_compared", mean("onset").alias("mean_onset_error_s"), mean("offset").alias("mean_offset_error_s"),
        F.coalesce(F.round(F.col("near") / F.nullif(F.col("pairs_compared"), F.lit(0)), 4), F.lit(1.0)).alias("within_200ms"),
    )


def term_set(c: Column) -> Column:
    return F.filter(F.array_distinct(F.transform(c, X.normalize_token)), lambda x: x != "")


def safety_rates(rows: DataFrame) -> DataFrame:
    """False positive and negative rates over distinct terms of (id, flagged, profane, clean)."""
    f, p, c = (term_set(F.col(x)) for x in ("flagged", "profane", "clean"))
    n = lambda x: F.size(x).cast("long")
    rate = lambda a, b: F.when(F.size(b) > 0, F.round(F.size(a) / F.size(b), 4)).otherwise(0.0)
    tp, fp, fn = F.array_intersect(f, p), F.array_intersect(f, c), F.array_except(p, f)
    return rows.select(
        "id", rate(fp, c).alias("profanity_false_positive_rate"), rate(fn, p).alias("profanity_false_negative_rate"), n(tp).alias("true_positives"), n(fp).alias("false_positives"),
        n(fn).alias("false_negatives"), n(p).alias("gold_profane"), n(c).alias("gold_clean"), n(f).alias("flagged"),
    )


def correction_accuracy(rows: DataFrame) -> DataFrame:
    """Share of gold corrections met, of (id, words, corrections array<struct<from, to>>)."""
    present = F.transform(F.col("words"), X.normalize_token)

    def met(c: Column) -> Column:
        to, source = X.normalize_token(F.coalesce(c["to"], F.lit(""))), X.normalize_token(F.coalesce(c["from"], F.lit("")))
        return ((to != "") & F.array_contains(present, to)) | ((to == "") & (source != "") & ~F.array_contains(present, source))

    right, total = F.size(F.filter("corrections", met)), F.size("corrections")
    return rows.select("id", F.when(total == 0, 1.0).otherwise(F.round(right / total, 4)).alias("correction_accuracy"), F.when(total == 0, 0).otherwise(right).cast("long").alias("correct"), total.cast("long").alias("total"))


def censorship_rate(words: DataFrame) -> DataFrame:
    mark = F.count_if(F.btrim(F.col("word")) == X.CENSOR_MARK)
    return words.groupBy("job_id").agg(F.round(mark / F.count("*"), 4).alias("censorship_rate"), mark.alias("censored"), F.count("*").alias("total"))


# stages of each configuration (fixed values); all of them segment
ABLATIONS = {
    "asr_only": (),
    "asr_punctuation": ("punctuation",),
    "asr_profanity": ("profanity",),
    "asr_correction": ("vocabulary", "correction"),
    "asr_profanity_correction": ("vocabulary", "profanity", "correction"),
    "full_pipeline": ("punctuation", "vocabulary", "profanity", "correction"),
}


def reading_speed(captions: DataFrame) -> DataFrame:
    """(job_id, mean_cps, mean_wps, reading_speed_warnings, caption_count) of captions."""
    mean = lambda c: F.round(F.sum(F.col(c).cast("decimal(20,4)")) / F.count(c), 4).cast("double").alias(f"mean_{c}")
    warned = F.array_contains("flags", "reading_speed") | (F.col("reading_status") != "OK")
    return captions.groupBy("job_id").agg(mean("cps"), mean("wps"), F.count_if(warned).alias("reading_speed_warnings"), F.count("*").alias("caption_count"))


def produce(words: DataFrame, lexicon: S.Lexicon, terms: DataFrame, s: Settings = Settings()) -> tuple[DataFrame, DataFrame]:
    """Words and hits of all configurations at once.

    ``words`` carry ``config``; a job is a clip in a configuration, so every stage runs once over
    the rows of those configurations that have it. Indices are dense after each stage.
    """
    dense = lambda df: df.withColumn("word_idx", F.row_number().over(W.in_job()) - 1)

    def staged(df: DataFrame, stage: str, run) -> DataFrame:
        has = F.col("config").isin(*[c for c, stages in ABLATIONS.items() if stage in stages])
        return run(df.where(has)).select(df.columns).unionByName(df.where(~has))

    now = staged(words, "punctuation", lambda df: W.punctuate(df, s))
    now = written(staged(now, "vocabulary", lambda df: dense(V.apply_terms(df, terms))).withColumn("word_idx", F.col("word_idx").cast("long")), "ablation-words")
    jobs = now.select("job_id", "config").distinct()
    uses = lambda *stages: F.col("config").isin(*[c for c, own in ABLATIONS.items() if set(stages) & set(own)])
    hits = written(S.detect(now.where(uses("profanity", "correction")), lexicon, s), "ablation-hits")
    corrected = hits.join(jobs.where(uses("correction")), "job_id", "left_semi")
    plain = hits.join(jobs.where(uses("profanity") & ~uses("correction")), "job_id", "left_semi")
    made = S.decide(corrected, S.best_alternatives(S.alternatives(corrected, lexicon)), s).unionByName(S.censor_all(plain))
    return dense(S.apply_decisions(now, made)), hits


def score(words: DataFrame, hits: DataFrame, clips: DataFrame, reference_words: DataFrame, s: Settings = Settings()) -> DataFrame:
    """All scores of each job. ``clips``: job_id, reference, profane, clean, corrections."""
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("word_idx", "word"))), lambda x: x["word"])
    text = words.groupBy("job_id").agg(ordered.alias("words"))
    flagged = hits.where("not allowlisted").groupBy("job_id").agg(F.collect_list("matched").alias("flagged"))
    gold = clips.join(text, "job_id", "left").join(flagged, "job_id", "left").select("*", F.col("job_id").alias("id"))
    none = F.expr("cast(array() as array<string>)")
    gold = gold.withColumns({"words": F.coalesce("words", none), "flagged": F.coalesce("flagged", none)}).withColumn("hypothesis", F.array_join("words", " "))
    captions = C.repair_density(C.merge_short(C.assign_cues(words, s), s), s)
    parts = [
        error_rates(gold.select("id", "reference", "hypothesis")),
        safety_rates(gold.select("id", "flagged", "profane", "clean")),
        correction_accuracy(gold.select("id", "words", "corrections")).select("id", "correction_accuracy"),
        *[df.withColumnRenamed("job_id", "id") for df in (
            timestamp_accuracy(reference_words, words), W.low_confidence_rate(words, s).drop("low", "total"), censorship_rate(words).select("job_id", "censorship_rate"), reading_speed(captions),
        )],
    ]
    out = reduce(lambda a, b: a.join(b, "id", "left"), parts)
    # a job without words or captions has the values of an empty list
    return out.na.fill({"low_confidence_rate": 0.0, "censorship_rate": 0.0, "mean_cps": 0.0, "mean_wps": 0.0, "reading_speed_warnings": 0, "caption_count": 0, "within_200ms": 1.0, "mean_onset_error_s": 0.0, "mean_offset_error_s": 0.0, "pairs_compared": 0})


def rollup(scores: DataFrame, *by: str) -> DataFrame:
    """Micro error rates and means of the clips' rounded scores, for each value of ``by``."""
    mean = lambda c, name=None: F.round(F.sum(F.col(c).cast("decimal(20,4)")) / F.count(c), 4).cast("double").alias(name or f"mean_{c}")
    micro = lambda a, b, name: F.round(F.sum(a) / F.greatest(F.sum(b), F.lit(1)), 4).alias(name)
    return scores.groupBy(*by).agg(
        F.count("*").alias("clips"), micro("distance", "reference_words", "wer"), micro("cer_distance", "reference_chars", "cer"), F.sum("reference_words").alias("reference_words"),
        mean("low_confidence_rate"), mean("profanity_false_positive_rate"), mean("profanity_false_negative_rate"), mean("correction_accuracy"), mean("censorship_rate"), mean("mean_cps", "mean_cps"),
        F.sum("reading_speed_warnings").alias("reading_speed_warnings"), mean("within_200ms", "mean_timestamp_within_200ms"), mean("mean_onset_error_s", "mean_onset_error_s"),
    )


def clip_scores(words: DataFrame, clips: DataFrame, reference_words: DataFrame, lexicon: S.Lexicon, terms: DataFrame, s: Settings = Settings(), configs: tuple[str, ...] = tuple(ABLATIONS)) -> DataFrame:
    """(config, id, scores) of every clip in every configuration.

    ``words``: of the hypotheses, by job_id; ``clips``: job_id, reference, profane, clean,
    corrections. Where a clip has no timed reference, its own words are the reference.
    """
    each = F.explode(F.array(*[F.lit(c) for c in configs])).alias("config")
    name = lambda df: df.select("*", each).withColumn("job_id", F.concat_ws("/", "config", F.col("job_id").cast("string")))
    own = words.select("job_id").distinct().join(reference_words.select("job_id").distinct(), "job_id", "left_anti")
    reference = reference_words.select("job_id", "word_idx", "word", "start_ms", "end_ms").unionByName(words.join(own, "job_id", "left_semi").select("job_id", "word_idx", "word", "start_ms", "end_ms"))
    done, hits = produce(name(words), lexicon, terms, s)
    done = written(done, "ablation-done")
    out = score(done, hits, name(clips).drop("config"), name(reference).drop("config"), s)
    return out.select(F.split_part("id", F.lit("/"), F.lit(1)).alias("config"), F.expr("substring(id, instr(id, '/') + 1)").alias("clip"), *[c for c in out.columns if c != "id"])


def ablation(words: DataFrame, clips: DataFrame, reference_words: DataFrame, lexicon: S.Lexicon, terms: DataFrame, s: Settings = Settings()) -> DataFrame:
    """One summary row a configuration, of ``clip_scores``."""
    return rollup(clip_scores(words, clips, reference_words, lexicon, terms, s), "config")


def report_text(summary: DataFrame, model: str, version: str) -> DataFrame:
    """(report): the summaries of all configurations as one text, in the order of ``ABLATIONS``."""
    # labels are fixed values
    line = lambda label, c, fmt="%.4f": F.format_string(f"{label}: {fmt}", F.coalesce(F.col(c), F.lit(0.0)))
    block = F.concat_ws(
        "\n", F.format_string("[%s]", "config"), line("WER", "wer"), line("CER", "cer"), line("word timestamp accuracy (within 200ms)", "mean_timestamp_within_200ms"),
        line("low-confidence rate", "mean_low_confidence_rate"), line("profanity false-positive rate", "mean_profanity_false_positive_rate"), line("profanity false-negative rate", "mean_profanity_false_negative_rate"),
        line("correction accuracy", "mean_correction_accuracy"), line("censorship rate", "mean_censorship_rate"), line("caption reading speed (mean CPS)", "mean_cps", "%.2f"),
        F.format_string("reading-speed warnings: %d", "reading_speed_warnings"),
    )
    order = F.array_position(F.array(*[F.lit(c) for c in ABLATIONS]), F.col("config"))
    blocks = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order.alias("o"), block.alias("b")))), lambda x: x["b"]), "\n\n")
    head = "\n".join(["Caption evaluation", f"Model: {model}", f"Pipeline version: {version}", X.NOTE, X.DISCLAIMER, "", ""])
    return summary.agg(F.concat(F.lit(head), blocks, F.lit("\n")).alias("report"))
