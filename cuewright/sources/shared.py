"""Intermediate tables in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; a local one of our own only where all runs on one machine."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    sc = spark.sparkContext
    now = sc._jsc.sc().getCheckpointDir()
    if now.isEmpty():
        if not sc.master.startswith("local[") and sc.master != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="cuewright-"))
        now = sc._jsc.sc().getCheckpointDir()
    return now.get().rstrip("/")


def written(df: DataFrame, tag: str) -> DataFrame:
    """``df`` written as Parquet to the shared folder and read again: it cuts the plan and survives a lost executor."""
    path = f"{shared_dir(df.sparkSession)}/cuewright-{tag}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def small(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """A table of rows that are written down in code. Its size is known to Catalyst, which broadcasts it."""
    kinds = to_arrow_schema(T.StructType.fromDDL(schema))
    columns = list(zip(*rows, strict=True)) or [()] * len(kinds)
    held = pa.table([pa.array(list(c), f.type) for c, f in zip(columns, kinds, strict=True)], schema=kinds)
    return spark.createDataFrame(held, schema=T.StructType.fromDDL(schema))


def file_system(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path as Spark writes it, and the path there; it serves tasks as well as the driver."""
    if path.startswith("file:"):
        path = "/" + path.removeprefix("file:").lstrip("/")
    return (fs.LocalFileSystem(), path) if path.startswith("/") else fs.FileSystem.from_uri(path)
