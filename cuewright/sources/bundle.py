"""Bundles: the artifacts of all jobs of a run, published together or not at all.

A bundle is a folder. Each task writes one pair of files under ``parts``: the artifacts' bytes one after the
other, and an index of (job_id, name, offset, length) as Parquet. The commit writes a manifest that
names the parts; the newest manifest is the bundle. So readers see all artifacts of a run or none of
them, a run makes two files a task however many jobs it has, and a task that is lost and run again
leaves files that no manifest names, which the commit or the abort takes away.

``overwrite`` makes a bundle of the new parts alone, ``append`` adds them; a job that is written again
is replaced with all its artifacts. The parts of older manifests stay until ``vacuum``. One run writes
to a bundle at a time.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

from cuewright.sources.shared import file_system

SCHEMA = "job_id string, name string, content string, generation long"
BLOCK = 8 << 20  # bytes of artifacts that a reader holds at once
PIECE, PIECES = 1 << 15, 256  # code points in a piece of an artifact, and pieces that a writer holds at once
_INDEX = pa.schema([("job_id", pa.string()), ("name", pa.string()), ("offset", pa.int64()), ("length", pa.int64())])
_ROWS = pa.schema([("job_id", pa.string()), ("name", pa.string()), ("content", pa.string()), ("generation", pa.int64())])


def _manifests(system: fs.FileSystem, at: str) -> list[str]:
    found = system.get_file_info(fs.FileSelector(at, allow_not_found=True))
    return sorted(f.path for f in found if f.base_name.startswith("manifest-") and f.base_name.endswith(".json"))


def _newest(system: fs.FileSystem, at: str) -> dict:
    """The newest manifest: its generation, and its parts with the generation of each."""
    held = _manifests(system, at)
    if not held:
        return {"generation": 0, "parts": {}}
    with system.open_input_stream(held[-1]) as f:
        return json.loads(f.read())


def _of_run(system: fs.FileSystem, at: str, run: str) -> list[str]:
    found = system.get_file_info(fs.FileSelector(f"{at}/parts", allow_not_found=True))
    return [f.path for f in found if f.base_name.startswith(run)]


@dataclass
class Part(WriterCommitMessage, InputPartition):
    """A pair of files, by the name they share."""

    name: str
    generation: int = 0


class _Writer(DataSourceArrowWriter):
    def __init__(self, path: str, overwrite: bool):
        self.path, self.overwrite, self.run = path, overwrite, uuid.uuid4().hex
        system, at = file_system(path)
        system.create_dir(f"{at}/parts", recursive=True)

    def write(self, batches: Iterator[pa.RecordBatch]) -> Part:
        system, at = file_system(self.path)
        name = f"{self.run}-{uuid.uuid4().hex}"
        offset = 0
        with system.open_output_stream(f"{at}/parts/{name}.data") as data, pq.ParquetWriter(f"{at}/parts/{name}.index", _INDEX, filesystem=system) as index:
            own: dict | None = None
            for b in batches:
                rows = []
                for job, artifact, content, piece in zip(*(b.column(b.schema.get_field_index(c)).to_pylist() for c in ("job_id", "name", "content", "generation")), strict=True):
                    if job is None or artifact is None:
                        raise ValueError("an artifact needs a job_id and a name")
                    if not piece:  # the first of an artifact; the others follow it
                        rows += [own] if own else []
                        own = {"job_id": job, "name": artifact, "offset": offset, "length": None if content is None else 0}
                    raw = (content or "").encode()
                    data.write(raw)
                    offset += len(raw)
                    if raw:
                        own["length"] += len(raw)
                if rows:
                    index.write_table(pa.Table.from_pylist(rows, _INDEX))
            if own:
                index.write_table(pa.Table.from_pylist([own], _INDEX))
        return Part(name)

    def commit(self, messages: list[Part | None]) -> None:
        system, at = file_system(self.path)
        old = _newest(system, at)
        now = old["generation"] + 1
        parts = ({} if self.overwrite else old["parts"]) | {m.name: now for m in messages if m is not None}
        for path in _of_run(system, at, self.run):  # what tasks left that were run again
            if path.rsplit("/", 1)[1].rsplit(".", 1)[0] not in parts:
                system.delete_file(path)
        with system.open_output_stream(f"{at}/{self.run}.tmp") as f:
            f.write(json.dumps({"generation": now, "parts": parts}).encode())
        system.move(f"{at}/{self.run}.tmp", f"{at}/manifest-{now:012d}.json")

    def abort(self, messages: list[Part | None]) -> None:
        system, at = file_system(self.path)
        for path in _of_run(system, at, self.run):
            system.delete_file(path)


class _Reader(DataSourceReader):
    def __init__(self, path: str):
        self.path = path

    def partitions(self) -> list[Part]:
        system, at = file_system(self.path)
        # no part at all would be read as one of None
        return [Part(n, g) for n, g in _newest(system, at)["parts"].items()] or [Part("")]

    def read(self, part: Part) -> Iterator[pa.RecordBatch]:
        if not part.name:
            return
        system, at = file_system(self.path)
        with system.open_input_file(f"{at}/parts/{part.name}.index") as found, system.open_input_stream(f"{at}/parts/{part.name}.data") as data:
            rows, used = [], 0
            for b in pq.ParquetFile(found).iter_batches():
                for r in b.to_pylist():
                    content = None if r["length"] is None else data.read(r["length"]).decode()
                    rows.append({"job_id": r["job_id"], "name": r["name"], "content": content, "generation": part.generation})
                    used += 64 + (r["length"] or 0)
                    if used >= BLOCK:
                        yield pa.RecordBatch.from_pylist(rows, _ROWS)
                        rows, used = [], 0
            if rows:
                yield pa.RecordBatch.from_pylist(rows, _ROWS)


class BundleSource(DataSource):
    """Format ``bundle``. Writing takes pieces in order, numbered in ``generation``; use ``write_bundle`` and ``read_bundle``."""

    @classmethod
    def name(cls) -> str:
        return "bundle"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options["path"])

    def writer(self, schema, overwrite: bool) -> DataSourceArrowWriter:
        return _Writer(self.options["path"], overwrite)


def write_bundle(artifacts: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Publish artifacts (job_id, name, content) as a bundle; other columns are ignored, a null content stays null.

    Long contents reach the writer in pieces, few at once, so its memory does not hang on their length.
    """
    spark = artifacts.sparkSession
    spark.dataSource.register(BundleSource)
    rows = artifacts.select(F.col("job_id").cast("string").alias("job_id"), F.col("name").cast("string").alias("name"), F.col("content").cast("string").alias("content"))
    n = F.greatest(F.lit(1), F.ceil(F.length(F.coalesce("content", F.lit(""))) / PIECE)).cast("int")
    piece = F.explode(F.sequence(F.lit(0), n - 1))
    rows = rows.select("job_id", "name", "content", piece.alias("piece")).select("job_id", "name", F.substring("content", F.col("piece") * PIECE + 1, F.lit(PIECE)).alias("content"), F.col("piece").cast("long").alias("generation"))
    held = spark.conf.get(_BATCH)
    spark.conf.set(_BATCH, PIECES)
    try:
        rows.write.format("bundle").mode(mode).save(path)
    finally:
        spark.conf.set(_BATCH, held)


_BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"


def read_bundle(spark: SparkSession, path: str) -> DataFrame:
    """(job_id, name, content) of a bundle: each job's artifacts as its newest run wrote them. A folder without a manifest is empty."""
    spark.dataSource.register(BundleSource)
    rows = spark.read.format("bundle").load(path)
    if len(set(_newest(*file_system(path))["parts"].values())) > 1:
        last = rows.groupBy("job_id").agg(F.max("generation").alias("generation"))
        rows = rows.join(last, ["job_id", "generation"], "left_semi")
    return rows.select("job_id", "name", "content")


def vacuum(path: str) -> None:
    """Take away older manifests, and parts that the newest does not name. No run may write or read an older one then."""
    system, at = file_system(path)
    for old in _manifests(system, at)[:-1]:
        system.delete_file(old)
    kept = _newest(system, at)["parts"]
    for f in system.get_file_info(fs.FileSelector(f"{at}/parts", allow_not_found=True)):
        if f.base_name.rsplit(".", 1)[0] not in kept:
            system.delete_file(f.path)
