"""WAV files of any size, read by ranges of their samples.

A file's head is found by seeking from chunk to chunk, so no task holds a file. Frames and turns
are dealt out to tasks as ranges of at most ``range_bytes`` bytes, small rows that are shuffled in
place of samples; each range is read and measured on its own, so one long file occupies all
executors. The rows do not hang on the size of the ranges.

A task that is lost reads its ranges again. Paths may be local or of any file system that Arrow knows.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cuewright.operators.audio import FRAME_MS, PCM, loudness, mono, scan_header
from cuewright.sources.shared import file_system

RANGE_BYTES = 8 << 20
HEAD = "path string, channels int, rate int, width int, at long, size long, fault string"


@contextmanager
def opened(path: str) -> Iterator[pa.NativeFile]:
    """A file by its path as Spark writes it."""
    system, at = file_system(path)
    with system.open_input_file(at) as f:
        yield f


def _head(path: str, length: int) -> tuple:
    none = (path, None, None, None, None, None)
    try:
        with opened(path) as f:
            head = scan_header(lambda at, n: f.read_at(min(n, length - at), at), length)
    except ValueError:
        return (*none, "unreadable")
    faults = ((head["width"] not in PCM, "unsupported width"), (not head["channels"] or not head["rate"], "unreadable"), (not head["size"], "empty"))
    return (path, head["channels"], head["rate"], head["width"], head["at"], head["size"], next((text for wrong, text in faults if wrong), None))


def heads(spark: SparkSession, path) -> DataFrame:
    """(path, channels, rate, width, at, size, fault) of WAV files; the fault is null where their frames can be read.

    Only names and sizes are listed; the samples stay where they are, also of files beyond the
    2 GB that one value can hold. Spark's listing leaves out files of no bytes.
    """

    def run(batches):
        for b in batches:
            rows = [_head(p, n) for p, n in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_pylist([dict(zip(_HEAD.names, r, strict=True)) for r in rows], _HEAD)

    return spark.read.format("binaryFile").load(path).select("path", "length").mapInArrow(run, HEAD)


_HEAD = pa.schema([("path", pa.string()), *[(c, pa.int32()) for c in ("channels", "rate", "width")], ("at", pa.int64()), ("size", pa.int64()), ("fault", pa.string())])


def rejected(found: DataFrame) -> DataFrame:
    """(path, fault) of the files that have no frames."""
    return found.where("fault is not null").select("path", "fault")


def _dealt(ranges: DataFrame, tasks: int | None, *by: str) -> DataFrame:
    """Ranges over ``tasks`` tasks. The number is given, as ranges are small rows that adaptive execution would put into one."""
    spark = ranges.sparkSession
    own = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    return ranges.repartition(tasks or own, *by)


def _step() -> Column:
    return F.col("channels") * F.col("width")


def frames(found: DataFrame, frame_ms: int = FRAME_MS, range_bytes: int = RANGE_BYTES, tasks: int | None = None) -> DataFrame:
    """(path, frame, rms, zcr) of the files without fault among ``heads``; a file shorter than a frame is one frame of infinite loudness."""
    per = F.greatest(F.lit(1), F.floor(F.col("rate") * frame_ms / 1000)).cast("long")
    rows = found.where("fault is null").withColumns({"step": _step().cast("long"), "per": per}).withColumn("samples", F.floor(F.col("size") / F.col("step")))
    rows = rows.withColumn("n", F.floor(F.col("samples") / F.col("per"))).where("samples > 0")
    held = F.greatest(F.lit(1), F.floor(F.lit(range_bytes) / (F.col("step") * F.col("per")))).cast("long")
    ranges = rows.withColumn("held", held).withColumn("first", F.explode(F.sequence(F.lit(0).cast("long"), F.greatest(F.col("n") - 1, F.lit(0)), F.col("held"))))
    ranges = ranges.select("path", "channels", "width", "per", "first", F.least("held", F.col("n") - F.col("first")).alias("count"), (F.col("at") + F.col("first") * F.col("step") * F.col("per")).alias("from"))

    def run(batches):
        for b in batches:
            for r in b.to_pylist():
                if not r["count"]:
                    measured = [(float("inf"), 0.0)]
                else:
                    x = _samples(r, r["count"] * r["per"])
                    measured = [loudness(part) for part in x.reshape(r["count"], r["per"])]
                rms, zcr = zip(*measured, strict=True)
                frame = np.arange(r["first"], r["first"] + len(measured), dtype=np.int32)
                yield pa.RecordBatch.from_arrays([pa.array([r["path"]] * len(measured), pa.string()), pa.array(frame), pa.array(rms, pa.float64()), pa.array(zcr, pa.float64())], names=["path", "frame", "rms", "zcr"])

    return _dealt(ranges, tasks, "path", "first").mapInArrow(run, "path string, frame int, rms double, zcr double")


def _samples(r: dict, n: int) -> np.ndarray:
    """``n`` samples from a range's place; a file that has become shorter is an error."""
    size = n * r["channels"] * r["width"]
    with opened(r["path"]) as f:
        raw = f.read_at(size, r["from"])
    if len(raw) < size:
        raise ValueError(f"{r['path']} has changed while it was read")
    return mono(raw, r["channels"], r["width"])


def turn_features(found: DataFrame, turns: DataFrame, least_ms: int = 50, range_bytes: int = RANGE_BYTES, tasks: int | None = None) -> DataFrame:
    """(path, start_ms, end_ms, log_rms, zcr) of turns, each of ``least_ms`` at least, from ranges of their files' samples.

    A turn is cut in ranges; squares and crossings are added up over them, where a range also
    sees the sample before it. A turn beyond the end of its file is silent.
    """
    at = lambda c: F.floor(F.greatest(c, F.lit(0)) / 1000 * F.col("rate")).cast("long")
    total = F.floor(F.col("size") / _step()).cast("long")
    rows = found.where("fault is null").join(turns.select("path", "start_ms", "end_ms").distinct(), "path").withColumns({"a": at(F.col("start_ms")), "z": at(F.greatest("end_ms", F.col("start_ms") + least_ms))})
    rows = rows.withColumn("z", F.least(total, F.greatest("z", F.col("a") + 1))).withColumn("a", F.least("a", "z"))
    held = F.greatest(F.lit(1), F.floor(F.lit(range_bytes) / _step())).cast("long")
    ranges = rows.withColumn("held", held).withColumn("first", F.explode(F.sequence("a", F.greatest("a", F.col("z") - 1), F.col("held"))))
    ranges = ranges.withColumn("lead", (F.col("first") > F.col("a")).cast("long")).select(
        "path", "start_ms", "end_ms", "channels", "width", "lead", F.least("held", F.col("z") - F.col("first")).alias("count"), (F.col("at") + (F.col("first") - F.col("lead")) * _step()).alias("from"),
    )

    def run(batches):
        for b in batches:
            out = []
            for r in b.to_pylist():
                x = _samples(r, r["count"] + r["lead"]) if r["count"] else np.zeros(0, np.float32)
                own = x[r["lead"] :].astype(np.float64)
                out.append({k: r[k] for k in ("path", "start_ms", "end_ms")} | {"n": len(own), "squares": float(own @ own), "turned": float(np.abs(np.diff(np.sign(x))).sum() / 2)})
            yield pa.RecordBatch.from_pylist(out, _PART)

    parts = _dealt(ranges, tasks, "path", "start_ms", "from").mapInArrow(run, "path string, start_ms long, end_ms long, n long, squares double, turned double")
    sums = parts.groupBy("path", "start_ms", "end_ms").agg(*[F.sum(c).alias(c) for c in ("n", "squares", "turned")])
    rms = F.when(F.col("n") > 0, F.sqrt(F.col("squares") / F.col("n") + 1e-12)).otherwise(0.0)
    zcr = F.when(F.col("n") > 1, F.col("turned") / (F.col("n") - 1)).otherwise(0.0)
    return sums.select("path", "start_ms", "end_ms", F.log(rms + 1e-6).alias("log_rms"), zcr.alias("zcr"))


_PART = pa.schema([("path", pa.string()), ("start_ms", pa.int64()), ("end_ms", pa.int64()), ("n", pa.int64()), ("squares", pa.float64()), ("turned", pa.float64())])
