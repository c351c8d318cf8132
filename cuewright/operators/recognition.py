"""Speech recognition behind an interface: recognisers turn files into words, found by name.

Model weights are out of scope; ``EvenStub`` and ``EvenWords`` give the words of a known text evenly
spread. A ``Recognizer`` plans a job over a table of clips. A ``ClipRecognizer`` is what a model
looks like: it works on executors, a clip at a time, and is called through a table function, from
SQL or from ``recognised``. A worker process makes one instance for each name and device.
"""

from __future__ import annotations

import re
from abc import ABC, abstractmethod
from collections.abc import Callable, Iterator
from decimal import ROUND_HALF_UP, Decimal

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import udtf
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult, PartitioningColumn

from cuewright.operators import vocabulary as V
from cuewright.operators import words as W


class Recognizer(ABC):
    """What the pipeline asks of a recogniser."""

    @abstractmethod
    def transcribe(self, clips: DataFrame, hints: DataFrame | None = None) -> DataFrame:
        """Words (job_id, word_idx, word, start_ms, end_ms, confidence, speaker) of clips; ``hints``: term, position."""


class EvenStub(Recognizer):
    """Words of ``text`` spread evenly over ``duration_s``, without confidence."""

    def transcribe(self, clips: DataFrame, hints: DataFrame | None = None) -> DataFrame:
        rows = W.even_spacing(clips.select("job_id", "text", "duration_s"), F.col("duration_s"))
        ms = lambda c: F.round(F.col(c) * 1000).cast("long")
        none = F.lit(None)
        return rows.select("job_id", F.col("word_idx").cast("long").alias("word_idx"), "word", ms("start_s").alias("start_ms"), ms("end_s").alias("end_ms"), none.cast("double").alias("confidence"), none.cast("string").alias("speaker"))


_KNOWN: dict[str, Callable[[], Recognizer]] = {"even_stub": EvenStub}
_MADE: dict[str, Recognizer] = {}


def register(name: str, make: Callable[[], Recognizer]) -> None:
    """Make a recogniser known by name; one made before under that name is forgotten."""
    _KNOWN[name] = make
    _MADE.pop(name, None)


def recognizer(name: str) -> Recognizer:
    """The recogniser of a name, made once."""
    if name not in _KNOWN:
        raise ValueError(f"unknown recogniser {name!r}; known: {', '.join(sorted(_KNOWN))}")
    if name not in _MADE:
        _MADE[name] = _KNOWN[name]()
    return _MADE[name]


def transcribe(clips: DataFrame, name: str = "even_stub", vocabulary: DataFrame | None = None) -> DataFrame:
    """Words of clips by a named recogniser, with the vocabulary's first terms as hints."""
    return recognizer(name).transcribe(clips, None if vocabulary is None else V.hints(vocabulary))


# --- on executors -----------------------------------------------------------------------

Word = tuple[str, int, int, float | None, str | None]


class ClipRecognizer(ABC):
    """A recogniser of one clip after the other. It is made on a worker when the first clip comes."""

    def __init__(self, device: str):
        self.device = device

    @abstractmethod
    def words(self, clip: dict, hints: list[str]) -> Iterator[Word]:
        """(word, start_ms, end_ms, confidence, speaker) of a clip, in order. ``clip``: all columns of its row."""


_WORD = re.compile(r"[^ \t\n\x0b\f\r]+")  # what is a word to Spark's patterns as well


class EvenWords(ClipRecognizer):
    """``EvenStub`` for one clip: the words of ``text`` spread evenly over ``duration_s``."""

    def words(self, clip: dict, hints: list[str]) -> Iterator[Word]:
        found = _WORD.findall(clip["text"] or "")
        whole = max(clip["duration_s"] or 0.0, 0.01)
        place = lambda x: int((Decimal(repr(x)) * 1000).to_integral_value(ROUND_HALF_UP))
        for i, word in enumerate(found):
            start, end = place(i * (whole / len(found))), place(min(whole, (i + 1) * (whole / len(found))))
            yield word, start, end if end > start else start + 10, None, None


CLIP_RECOGNIZERS: dict[str, Callable[[str], ClipRecognizer]] = {"even_words": EvenWords}
_HELD: dict[tuple[str, str], ClipRecognizer] = {}


def _instance(name: str, device: str, make: Callable[[str], ClipRecognizer]) -> ClipRecognizer:
    """The instance of this worker process."""
    if (name, device) not in _HELD:
        _HELD[name, device] = make(device)
    return _HELD[name, device]


def _result(job_id: T.DataType) -> T.StructType:
    fields = [("word_idx", T.LongType()), ("word", T.StringType()), ("start_ms", T.LongType()), ("end_ms", T.LongType()), ("confidence", T.DoubleType()), ("speaker", T.StringType())]
    return T.StructType([T.StructField("job_id", job_id), *[T.StructField(n, t) for n, t in fields]])


def _table_function(known: dict[str, Callable[[str], ClipRecognizer]]) -> type:
    class Recognise:
        """Words of a table of clips: ``recognise(TABLE(clips), name => '...', device => '...')``."""

        @staticmethod
        def analyze(clips: AnalyzeArgument, name: AnalyzeArgument, device: AnalyzeArgument | None = None) -> AnalyzeResult:
            if not clips.isTable or "job_id" not in clips.dataType.names:
                raise ValueError("the first argument must be a table with a column job_id")
            if name.value not in known:
                raise ValueError(f"unknown recogniser {name.value!r}; known: {', '.join(sorted(known))}")
            hints = clips.dataType["hints"].dataType if "hints" in clips.dataType.names else None
            if hints is not None and not isinstance(hints, T.ArrayType):
                raise ValueError("hints must be an array of terms")
            return AnalyzeResult(schema=_result(clips.dataType["job_id"].dataType), partitionBy=[PartitioningColumn("job_id")])

        def eval(self, clips, name, device="cpu"):
            clip = clips.asDict()
            hints = clip.pop("hints", None) or []
            for i, word in enumerate(_instance(name, device, known[name]).words(clip, hints)):
                yield (clip["job_id"], i, *word)

    return Recognise


def install(spark: SparkSession, known: dict[str, Callable[[str], ClipRecognizer]] | None = None, function: str = "recognise") -> None:
    """Make the table function known to a session's SQL, with the recognisers of CLIP_RECOGNIZERS and ``known``.

    It takes a table of clips (job_id, an optional array ``hints``, and what the recogniser reads),
    a recogniser's name and a device ('cpu' where none is given). Clips are dealt out by job; an unknown name is an error
    when the query is analysed. Repeated rows of a job each give their words.
    """
    spark.udtf.register(function, udtf(_table_function({**CLIP_RECOGNIZERS, **(known or {})})))


def recognised(clips: DataFrame, name: str = "even_words", device: str = "cpu", vocabulary: DataFrame | None = None) -> DataFrame:
    """Words of clips by the table function; the vocabulary's first terms, at most 40, are each clip's hints."""
    if vocabulary is not None:
        terms = V.hints(vocabulary).agg(F.transform(F.array_sort(F.collect_list(F.struct("position", "term"))), lambda x: x["term"]).alias("hints"))
        clips = clips.crossJoin(F.broadcast(terms))  # one row of at most 40 terms
    return udtf(_table_function(CLIP_RECOGNIZERS))(clips.asTable(), name=F.lit(name), device=F.lit(device))
