"""Operators over timed words: confidence, punctuation, speakers, sound events.

All are keyed by ``job_id`` and ordered by ``word_idx``, so one exchange on ``job_id``
serves every window of a pipeline.
"""

from __future__ import annotations

from collections import Counter
from heapq import heappop, heappush

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cuewright.functions import text as X
from cuewright.operators.folds import scan
from cuewright.schema import Settings


def in_job():
    """A job's words in order (made on use: windows need a session)."""
    return Window.partitionBy("job_id").orderBy("word_idx")


def before():
    """All words of the job before this one."""
    return in_job().rowsBetween(Window.unboundedPreceding, -1)



# --- confidence -------------------------------------------------------------------------


def confidence_records(words: DataFrame, s: Settings = Settings(), risk: Column | None = None, correction: Column | None = None) -> DataFrame:
    """asr_confidence, overall_confidence and band of each word."""
    asr = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce("confidence", F.lit(s.confidence_unknown))))
    overall = asr if risk is None else F.least(asr, F.lit(1.0) - F.lit(0.25) * risk)
    if correction is not None:
        overall = F.coalesce((overall + correction) / 2, overall)
    return words.withColumn("asr_confidence", F.round(asr, 4)).withColumn("overall_confidence", F.round(overall, 4)).withColumn(
        "band", X.band(overall, s.confidence_high, s.confidence_medium)
    )


def confidence_summary(records: DataFrame, **more: Column) -> DataFrame:
    """Words, mean and band counts of each job, and what ``more`` aggregates of its records."""
    band = lambda b: F.count_if(F.col("band") == b).alias(b)
    return records.groupBy("job_id").agg(
        F.count("*").alias("word_count"), F.round(F.avg("overall_confidence"), 4).alias("mean_confidence"), band("high"), band("medium"), band("low"),
        *[c.alias(name) for name, c in more.items()],
    )


def low_confidence_rate(words: DataFrame, s: Settings = Settings()) -> DataFrame:
    low = F.count_if(X.band(F.coalesce("confidence", F.lit(s.confidence_unknown)), s.confidence_high, s.confidence_medium) == "low")
    return words.groupBy("job_id").agg(F.round(low / F.count("*"), 4).alias("low_confidence_rate"), low.alias("low"), F.count("*").alias("total"))


# --- sentences --------------------------------------------------------------------------


def split_sentences(words: DataFrame, s: Settings = Settings()) -> DataFrame:
    """sentence (from 0) of each word: pauses and marks end one, greetings stand alone."""
    gap = F.col("start_ms") - F.lag("end_ms").over(in_job())
    new = (gap >= s.sentence_pause_ms) | X.has_terminal(F.lag("word").over(in_job()))
    first = words.withColumn("new_", F.coalesce(new, F.lit(True)).cast("int")).withColumn("norm_", X.edge_norm(F.col("word")))
    # the third word of a group has no start at itself and at the word before, and one before that: one order serves all
    start = lambda k: F.lag("new_", k).over(in_job())
    third = (F.col("new_") == 0) & (start(1) == 0) & (start(2) == 1)
    pair = F.concat_ws(" ", F.lag("norm_", 2).over(in_job()), F.lag("norm_", 1).over(in_job()))
    out = first.withColumn("cut_", F.when(third & X.any_of(pair, X.GREETING_PAIRS), 1).otherwise(F.col("new_")))
    return out.withColumn("sentence", F.sum("cut_").over(in_job()) - 1).drop("new_", "norm_", "cut_")


def punctuate(words: DataFrame, s: Settings = Settings()) -> DataFrame:
    """Words with sentence marks and capitals; stems never change."""
    split = split_sentences(words, s)
    in_sentence = Window.partitionBy("job_id", "sentence").orderBy("word_idx")
    whole = Window.partitionBy("job_id", "sentence")
    norm = X.edge_norm(F.col("word"))
    n, nth = F.count("*").over(whole), F.row_number().over(in_sentence)
    first = F.first(norm).over(whole.orderBy("word_idx").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    second = F.nth_value(norm, 2).over(whole.orderBy("word_idx").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    greets = (n <= 2) & (X.any_of(first, X.GREETING_WORDS) | ((n == 2) & X.any_of(F.concat_ws(" ", first, second), X.GREETING_PAIRS)))
    cols = split.select("*", n.alias("n_"), nth.alias("nth_"), F.when(greets, "!").when(X.any_of(first, X.QUESTION_STARTERS), "?").otherwise(".").alias("mark_"))
    shaped = F.when(F.col("nth_") == 1, X.capitalize_token(F.col("word"))).otherwise(X.capitalize_i(F.col("word")))
    marked = F.when(F.col("nth_") == F.col("n_"), X.attach_terminal(shaped, F.col("mark_"))).otherwise(shaped)
    return cols.withColumn("word", marked).drop("n_", "nth_", "mark_")


# --- speakers ---------------------------------------------------------------------------


def after_pause(gap_ms: int = Settings.speaker_gap_ms) -> Column:
    """Whether a word follows a long pause, behind the end of all words before it."""
    return F.coalesce(F.col("start_ms") - F.max("end_ms").over(before()) >= gap_ms, F.lit(False))


def pause_turns(words: DataFrame, gap_ms: int = Settings.speaker_gap_ms) -> DataFrame:
    """Speaker segments: a long pause starts a turn of the other of two speakers."""
    turn = words.withColumn("new_", after_pause(gap_ms).cast("int")).withColumn("turn", F.sum("new_").over(in_job()))
    segments = turn.groupBy("job_id", "turn").agg(F.min("start_ms").alias("start_ms"), F.max("end_ms").alias("end_ms"))
    speaker = (F.col("turn") % 2 + 1).cast("string")
    return segments.select("job_id", "turn", speaker.alias("speaker"), "start_ms", "end_ms", F.concat(F.lit("Speaker "), speaker).alias("label"))


def toggle_labels(regions: DataFrame, gap_ms: int = Settings.speaker_gap_ms) -> DataFrame:
    """Flip a label (1 or 2) that repeats after a long pause, relative to the label given before it.

    After a long pause the given label is always the other one: a repeated label flips, another
    one is other already. So a label is that of the last region without such a pause before it,
    flipped once for every region since; windows count these, and no state is carried.
    """
    order = ["start_ms", "end_ms", "label"]
    by = Window.partitionBy("job_id").orderBy(*order)
    plain = F.coalesce((F.col("start_ms") - F.lag("end_ms").over(by) < gap_ms) | F.lag("label").over(by).isNull() | F.col("label").isNull(), F.lit(True))
    runs = regions.withColumn("plain_", plain).withColumn("run_", F.sum(F.col("plain_").cast("int")).over(by.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    inside = Window.partitionBy("job_id", "run_").orderBy(*order)
    first, flips = F.first("label").over(inside.rowsBetween(Window.unboundedPreceding, Window.currentRow)), F.row_number().over(inside) - 1
    label = F.when(flips % 2 == 1, 3 - first).otherwise(first).cast("int")
    return runs.select("job_id", F.col("start_ms").cast("long").alias("start_ms"), F.col("end_ms").cast("long").alias("end_ms"), label.alias("label"))


_WINNER = T.StructType([T.StructField("n", T.LongType()), T.StructField("on", T.BooleanType()), T.StructField("speaker", T.StringType())])


def _covered(segments: DataFrame, slack_ms: int) -> DataFrame:
    """(job_id, t, kind, w): edges of the segments, and whose segment, if any, covers what follows; the last one counts.

    Edges of a job pass in order, and the segments open at each are kept in a heap. A start takes
    effect before words at its time (kind 0), an end after them (kind 2).
    """
    a, z = F.col("start_ms") - slack_ms, F.col("end_ms") + slack_ms
    whole = segments.where(a <= z)
    both = F.explode(F.array(F.struct(a.cast("double").alias("t"), F.lit(0).alias("kind")), F.struct(z.cast("double").alias("t"), F.lit(2).alias("kind"))))
    edges = whole.select("job_id", F.col("seg_idx").cast("long").alias("seg_idx"), F.col("speaker").cast("string").alias("speaker"), both.alias("e")).select("job_id", "e.t", "e.kind", "seg_idx", "speaker")

    def step(state: tuple | None, kind: int, seg: int | None, speaker: str | None) -> tuple:
        n, heap, ended = state or (0, [], Counter())
        # nulls come before all else, the greatest is on top: letters count downwards
        key = (seg is None, -(seg or 0), speaker is None, (*(-ord(c) for c in speaker or ""), 1), speaker)
        if kind == 0:
            heappush(heap, key)
        else:
            ended[key] += 1
        while heap and ended[heap[0]]:
            ended[heap[0]] -= 1
            heappop(heap)
        top = heap[0] if heap else None
        return (n + 1, heap, ended), {"n": n, "on": top is not None, "speaker": None if top is None else top[4]}

    return scan(edges, ["job_id"], ["t", "kind", "seg_idx", "speaker"], ["kind", "seg_idx", "speaker"], "w", _WINNER, None, step).select("job_id", "t", "kind", "w")


def speaker_at(words: DataFrame, segments: DataFrame, slack_ms: int = 1, tasks: int | None = None) -> DataFrame:
    """Speaker of each word: the last segment over its middle, else the nearest, else its own.

    ``segments``: job_id, seg_idx, speaker, start_ms, end_ms. Words and the edges of their job's
    segments are one stream ordered by time: the last edges before a word say which segment covers
    it and which ended last, the first one behind it which starts next. Words are not joined; the
    stream is moved once, to ``tasks`` tasks if given. Segments without a job go to no word.
    """
    own = segments.where("job_id is not null")
    # edges stand before words at equal times, in both directions
    spots = words.select("job_id", ((F.col("start_ms") + F.col("end_ms")) / 2).alias("t"), F.lit(1).alias("kind"), F.struct(*words.columns).alias("w_"))
    both = F.explode(F.array(F.struct(F.col("end_ms").cast("double").alias("t"), F.lit(0).alias("kind")), F.struct(F.col("start_ms").cast("double").alias("t"), F.lit(2).alias("kind"))))
    sides = own.select("job_id", both.alias("e"), F.col("seg_idx").cast("long").alias("seg_idx"), F.col("speaker").alias("sp")).select("job_id", "e.t", "e.kind", "seg_idx", "sp")
    spots = spots.unionByName(sides.unionByName(_covered(own, slack_ms), allowMissingColumns=True), allowMissingColumns=True)
    spots = spots.repartition(tasks, "job_id") if tasks else spots
    so_far = lambda *order: Window.partitionBy("job_id").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    edge = lambda kind, sign: F.when((F.col("kind") == kind) & F.col("w").isNull(), F.struct("t", (sign * F.col("seg_idx")).alias("i"), "sp"))
    # of segments with equal edges the first wins
    past_order = (F.col("t"), F.col("kind"), F.col("w.n"))
    past = F.max(edge(0, -1)).over(so_far(*past_order))
    cover = F.last("w", ignorenulls=True).over(so_far(*past_order))
    ahead = F.min(edge(2, 1)).over(so_far(F.desc("t"), F.desc("kind")))
    near = spots.withColumns({"p_": past, "cover_": cover}).withColumn("a_", ahead).where("kind = 1")
    behind, ahead_of = F.col("t") - F.col("p_.t"), F.col("a_.t") - F.col("t")
    first = F.coalesce((behind < ahead_of) | ((behind == ahead_of) & (-F.col("p_.i") < F.col("a_.i"))), F.col("a_").isNull())
    nearest = F.when(first, F.col("p_.sp")).otherwise(F.col("a_.sp"))
    found = F.when(F.coalesce(F.col("cover_.on"), F.lit(False)), F.col("cover_.speaker")).otherwise(nearest)
    return near.withColumn("found_", found).select("w_.*", "found_").withColumn("speaker", F.coalesce("found_", "speaker")).drop("found_")


def rename_speakers(segments: DataFrame, mapping: DataFrame) -> DataFrame:
    """Speakers and labels by speaker id first, by label second. ``mapping``: key, value, and job_id where each job has its own."""
    own = ["job_id"] if "job_id" in mapping.columns else []
    by_id = mapping.select(*own, F.col("key").alias("speaker"), F.nullif(F.col("value"), F.lit("")).alias("v1_"))
    by_label = mapping.select(*own, F.col("key").alias("label"), F.nullif(F.col("value"), F.lit("")).alias("v2_"))
    out = segments.join(by_id, [*own, "speaker"], "left").join(by_label, [*own, "label"], "left")
    shown = F.coalesce("v1_", "v2_")
    return out.withColumns({"label": F.coalesce(shown, "label", F.concat(F.lit("Speaker "), "speaker")), "speaker": F.coalesce(shown, "speaker")}).drop("v1_", "v2_")


def speakers_in_order(segments: DataFrame) -> DataFrame:
    """Distinct speakers of each job, in order of appearance."""
    return segments.groupBy("job_id", "speaker").agg(F.min("start_ms").alias("first_ms")).withColumn(
        "position", F.row_number().over(Window.partitionBy("job_id").orderBy("first_ms", "speaker"))
    )


# --- sound events -----------------------------------------------------------------------


def filter_events(events: DataFrame, threshold: float = Settings.sound_event_threshold) -> DataFrame:
    """Events strictly above the threshold with a duration and a label."""
    label = X.sound_label(F.col("label"))
    kept = events.where((F.col("confidence") > threshold) & (F.col("end_ms") > F.col("start_ms")) & (label != ""))
    return kept.withColumn("label", label).withColumn("confidence", F.least(F.lit(1.0), F.col("confidence")))


def events_in_silence(events: DataFrame, words: DataFrame, slack_ms: int = 1, bin_ms: int = 60_000) -> DataFrame:
    """Events that overlap no word; time bins keep long jobs apart."""
    at = lambda c: F.floor(c / bin_ms)
    spans = words.select(
        F.col("job_id").alias("j_"), F.col("start_ms").alias("s_"), F.col("end_ms").alias("e_"),
        F.explode(F.sequence(at(F.col("start_ms")), at(F.col("end_ms")))).alias("b_"),
    )
    named = events.withColumn("id_", F.struct(*events.columns))
    binned = named.select("id_", "job_id", "start_ms", "end_ms", F.explode(F.sequence(at(F.col("start_ms")), at(F.col("end_ms")))).alias("bin_"))
    hit = binned.join(
        spans,
        (binned["job_id"] == spans["j_"]) & (binned["bin_"] == spans["b_"]) & (spans["e_"] > binned["start_ms"] + slack_ms) & (spans["s_"] < binned["end_ms"] - slack_ms),
        "left_semi",
    ).select("id_")
    return named.join(hit.distinct(), "id_", "left_anti").drop("id_")


_EVENT_ORDER = ["start_ms", "end_ms", "label", "confidence"]


def _spaced(events: DataFrame, slack_ms: int, tiny: bool = False) -> DataFrame:
    """Events (``end_ms`` as placed) that start after the end of all kept before them.

    An event that starts after the end of all events before it, kept or not, owes nothing to
    them: there a job is cut into pieces. ``tiny``: an event whose own end ``own_end_`` lies within the slack of its
    start goes before a kept one with its start.
    """
    order = [("own_end_" if tiny and c == "end_ms" else c) for c in _EVENT_ORDER]
    by = Window.partitionBy("job_id").orderBy(*order)
    reach = F.max("end_ms").over(by.rowsBetween(Window.unboundedPreceding, -1))
    free = F.coalesce(reach <= F.col("start_ms") + slack_ms, F.lit(True))
    pieces = events.withColumn("piece_", F.sum(free.cast("int")).over(by.rowsBetween(Window.unboundedPreceding, Window.currentRow)))

    def step(state: tuple, start: int, end: int, own: int) -> tuple:
        at, earlier, last = state  # start of the last kept event, ends of those before that start, and of all
        if at is not None and start > at:
            earlier = last
        clear = last is None or last <= start + slack_ms
        short = tiny and start == at and own <= start + slack_ms and (earlier is None or earlier <= start + slack_ms)
        if not (clear or short):
            return (at, earlier, last) if start == at else (at, last, last), False
        return (start, earlier if start == at else last, end if last is None else max(last, end)), True

    inputs = ["start_ms", "end_ms", "own_end_" if tiny else "end_ms"]
    return scan(pieces, ["job_id", "piece_"], order, inputs, "kept_", T.BooleanType(), (None, None, None), step).where("kept_").drop("kept_", "piece_")


def place_events(events: DataFrame, slack_ms: int = 1, least_ms: int = 200) -> DataFrame:
    """Events that also clear the events placed before them; a placed one lasts ``least_ms`` at least."""
    rows = events.select("job_id", F.col("start_ms").cast("long").alias("start_ms"), F.greatest("end_ms", F.col("start_ms") + least_ms).cast("long").alias("end_ms"), "label", "confidence")
    return _spaced(rows, slack_ms)


def _dealt(rows: DataFrame, tasks: int | None) -> DataFrame:
    """Rows by job, in as many tasks as the words that they join."""
    return rows.repartition(tasks, "job_id") if tasks else rows.repartition("job_id")


def _spoken(words: DataFrame) -> DataFrame:
    """Words with ``at_``, the largest end so far in their job; it never falls."""
    return words.select(*words.columns, F.max("end_ms").over(in_job().rowsBetween(Window.unboundedPreceding, Window.currentRow)).alias("at_"))


def events_among(words: DataFrame, events: DataFrame, slack_ms: int = 1, least_ms: int = 200, tasks: int | None = None) -> DataFrame:
    """(job_id, label, start_ms, end_ms, confidence, next_idx) of the events that get a place between words.

    An event stands before the first word, in the words' order, that ends after the event's
    start (``next_idx``; null behind the last word), and only if that word starts when the event
    has ended; else it would lie over speech and goes. Placed events count as words for later
    ones, and last ``least_ms`` at least. Of events that start together those within the slack all
    stay. Ties go by end, label and confidence.

    Words and events of a job are two ordered streams: the largest end so far never falls, so one
    union sorted by it puts every event behind the words that it follows, and a window over that
    order finds the next word. Words are not joined with events. Both sides are dealt out by job
    in the same way, so words that lie so already, in ``tasks`` tasks, are not moved.
    """
    ours = _spoken(words).select("job_id", "at_", F.lit(0).alias("kind_"), "word_idx", "start_ms")
    heard = _dealt(events, tasks).select(
        "job_id", (F.col("start_ms") + slack_ms).alias("at_"), F.lit(1).alias("kind_"), F.lit(None).cast("long").alias("word_idx"), F.col("start_ms").cast("long").alias("start_ms"),
        F.struct("label", F.greatest("end_ms", F.col("start_ms") + least_ms).cast("long").alias("end_ms"), F.col("end_ms").cast("long").alias("own_end_"), F.col("confidence").cast("double").alias("confidence")).alias("e"),
    )
    back = Window.partitionBy("job_id").orderBy(F.desc("at_"), F.desc("kind_"), F.desc("word_idx"))
    following = F.last(F.when(F.col("kind_") == 0, F.struct("start_ms", "word_idx")), ignorenulls=True).over(back.rowsBetween(Window.unboundedPreceding, -1))
    met = ours.unionByName(heard, allowMissingColumns=True).withColumn("next_", following).where("kind_ = 1")
    silent = met.where(F.coalesce(F.col("next_.start_ms") >= F.col("e.own_end_") - slack_ms, F.lit(True)))
    return _spaced(silent.select("job_id", "start_ms", "e.*", F.col("next_.word_idx").alias("next_idx")), slack_ms, tiny=True).drop("own_end_")


def insert_events(words: DataFrame, placed: DataFrame, tasks: int | None = None) -> DataFrame:
    """Words with the event tokens of ``events_among`` between them, indexed anew.

    ``old_idx`` is a word's index before, null for events.
    """
    cols = ["job_id", "word_idx", "word", "start_ms", "end_ms", "confidence", "speaker"]
    behind = F.lit((1 << 63) - 1)
    tokens = _dealt(placed, tasks).select(
        "job_id", F.lit(None).cast("long").alias("word_idx"), F.col("label").alias("word"), "start_ms", "end_ms", "confidence", F.lit(None).cast("string").alias("speaker"),
        F.coalesce("next_idx", behind).alias("at_"), F.lit(0).alias("kind_"),
    )
    both = words.select(*cols, F.col("word_idx").alias("at_"), F.lit(1).alias("kind_")).unionByName(tokens)
    order = Window.partitionBy("job_id").orderBy("at_", "kind_", "start_ms", F.desc(F.when(F.col("kind_") == 0, F.col("word"))), F.desc("confidence"))
    return both.select("job_id", (F.row_number().over(order) - 1).cast("long").alias("word_idx"), *cols[2:], F.col("word_idx").alias("old_idx"))


def carry_indices(decisions: DataFrame, placed: DataFrame) -> DataFrame:
    """Decisions on words (``word_idx``, and ``end_idx`` after the last) with their indices after ``insert_events``.

    A word moves on by the events placed before it, so decisions meet events only, never the
    words. An event between the words of a decision lies inside its span.
    """
    before = placed.where("next_idx is not null").repartition("job_id").select("job_id", F.col("next_idx").alias("at_"), F.lit(0).alias("kind_"))
    order = Window.partitionBy("job_id").orderBy("at_", "kind_").rowsBetween(Window.unboundedPreceding, Window.currentRow)

    def moved(rows: DataFrame, index: Column) -> DataFrame:
        ours = rows.repartition("job_id").select("job_id", index.alias("at_"), F.lit(1).alias("kind_"), F.struct(*rows.columns).alias("row_"))
        both = ours.unionByName(before, allowMissingColumns=True).withColumn("by_", F.count_if(F.col("kind_") == 0).over(order))
        return both.where("kind_ = 1").select("row_.*", "by_")

    first = moved(decisions, F.col("word_idx")).withColumnRenamed("by_", "first_")
    last = moved(first, F.col("end_idx") - 1).withColumnRenamed("by_", "last_")
    return last.withColumns({"word_idx": F.col("word_idx") + F.col("first_"), "end_idx": F.col("end_idx") + F.col("last_")}).select(*decisions.columns)


def even_spacing(texts: DataFrame, duration: Column) -> DataFrame:
    """Tokens spread evenly over a duration in seconds: job_id, word_idx, word, start_s, end_s."""
    toks = texts.withColumn("d_", F.greatest(duration.cast("double"), F.lit(0.01))).withColumn("w_", X.tokens(F.col("text")))
    rows = toks.select("job_id", "d_", F.size("w_").alias("n_"), F.posexplode("w_").alias("word_idx", "word"))
    slot = F.col("d_") / F.col("n_")
    start = F.round(F.col("word_idx") * slot, 3)
    end = F.round(F.least(F.col("d_"), (F.col("word_idx") + 1) * slot), 3)
    return rows.select("job_id", "word_idx", "word", start.alias("start_s"), F.when(end <= start, F.round(start + 0.01, 3)).otherwise(end).alias("end_s"))


def sessions(events: DataFrame, key: str, at: Column, gap_s: int) -> DataFrame:
    """Runs of events with pauses below ``gap_s`` seconds: key, session, start, end, n."""
    by = Window.partitionBy(key).orderBy("at_")
    rows = events.select(F.col(key), at.alias("at_"))
    new = F.col("at_") - F.lag("at_").over(by) >= gap_s
    return (
        rows.withColumn("session", F.sum(F.coalesce(new, F.lit(False)).cast("int")).over(by))
        .groupBy(key, "session")
        .agg(F.min("at_").alias("start_s"), F.max("at_").alias("end_s"), F.count("*").alias("n_events"))
    )
