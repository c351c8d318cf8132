"""What the training-data operators share: reading, shared tables, byte-level text."""

from __future__ import annotations

import string
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from cuewright.sources.shared import shared_dir


def read(spark: SparkSession, sf_dir: str, table: str, *cols: str) -> DataFrame:
    """A table of the input folder, pruned to ``cols`` when some are named."""
    df = spark.read.parquet(f"{sf_dir}/{table}.parquet")
    return df.select(*cols) if cols else df


def lower_ascii(c: Column) -> Column:
    """Lower-case A-Z and nothing else."""
    return F.translate(c, string.ascii_uppercase, string.ascii_lowercase)


class Workspace:
    """Tables written to the shared folder; they cut lineage and survive a lost executor."""

    def __init__(self, spark: SparkSession, tag: str):
        self.spark = spark
        self.root = f"{shared_dir(spark)}/cuewright-{tag}-{uuid.uuid4().hex}"

    def put(self, df: DataFrame, name: str) -> DataFrame:
        """Write ``df`` as Parquet and read it back."""
        path = f"{self.root}/{name}"
        df.write.mode("overwrite").option("compression", "zstd").parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, name: str) -> None:
        """Delete a table that nothing will read again."""
        jvm = self.spark._jvm
        path = jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


def append_column(
    df: DataFrame,
    name: str,
    dtype: T.DataType,
    inputs: list[str],
    factory: Callable[[], Callable[..., pa.Array]],
) -> DataFrame:
    """Add one column computed in Arrow batches; rows and other columns pass through.

    ``factory`` runs once per task (load models there) and returns a function of the
    input columns as Arrow arrays.
    """
    if name in df.columns:
        raise ValueError(f"column {name} exists already")
    schema = T.StructType([*df.schema.fields, T.StructField(name, dtype)])
    target = to_arrow_type(dtype, prefers_large_types=False)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fn = factory()
        for batch in batches:
            for at in range(0, max(batch.num_rows, 1), 512):
                part = batch.slice(at, 512)
                if not part.num_rows:
                    continue
                out = fn(*[part.column(part.schema.get_field_index(c)) for c in inputs])
                if out.type != target:
                    out = out.cast(target)
                yield pa.RecordBatch.from_arrays(
                    [*part.columns, out], names=[*part.schema.names, name]
                )

    return df.mapInArrow(run, schema)


def free_name(df: DataFrame, wish: str) -> str:
    """``wish``, or that with underscores until no column of ``df`` has it."""
    taken = {c.lower() for c in df.columns}
    while wish.lower() in taken:
        wish += "_"
    return wish


def utf8_parts(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a string array, and the n + 1 offsets; null counts as empty."""
    texts = texts.fill_null("").cast(pa.large_string())
    _, offs, data = texts.buffers()
    at = np.frombuffer(offs, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    if data is None or not len(at):
        return np.zeros(0, np.uint8), np.zeros(len(texts) + 1, np.int64)
    return np.frombuffer(data, np.uint8)[at[0] : at[-1]], at - at[0]


