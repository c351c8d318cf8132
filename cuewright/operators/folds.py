"""Sequential rules over ordered rows, in linear time.

A rule that depends on its own last decision cannot be a window. Where the data prove that the
state is forgotten, a job is cut into pieces that are dealt out and folded side by side; inside a
piece rows pass in order through one small step, so nothing grows with the piece.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from cuewright.sources.shared import written


def scan(rows: DataFrame, piece: list[str], order: list[str | Column], inputs: list[str], name: str, dtype: T.DataType, begin: Any, step: Callable[..., tuple[Any, Any]]) -> DataFrame:
    """``rows`` with one column more, computed in ``order`` within each ``piece``.

    ``step(state, *inputs)`` gives the next state and the row's value; every piece starts from
    ``begin``. Rows are dealt out by piece and sorted, and pass in batches: memory is that of a
    batch, however long a piece is.
    """
    if name in rows.columns:
        raise ValueError(f"column {name} exists already")
    placed = rows.repartition(*piece).sortWithinPartitions(*piece, *order)
    target = to_arrow_type(dtype)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, state = None, begin
        for batch in batches:
            values = []
            column = lambda c: batch.column(batch.schema.get_field_index(c)).to_pylist()  # noqa: B023, E731
            for key, *x in zip(zip(*map(column, piece), strict=True), *map(column, inputs), strict=True):
                if key != at:
                    at, state = key, begin
                state, value = step(state, *x)
                values.append(value)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(values, target)], names=[*batch.schema.names, name])

    return placed.mapInArrow(run, T.StructType([*rows.schema.fields, T.StructField(name, dtype)]))


def number(rows: DataFrame, order: list[Column], name: str) -> DataFrame:
    """``rows`` with dense numbers from 1 in ``order``, without one task that holds all of them.

    Rows are sorted by ranges and numbered within each; the ranges' sizes, a row each, give what
    comes before. ``order`` should have no ties.
    """
    inner = (1 << 33) - 1  # a monotonic id holds the partition above these bits, and a running number in them
    placed = written(rows.orderBy(*order).withColumn("id_", F.monotonically_increasing_id()), "numbered")
    part = F.shiftrightunsigned("id_", 33)
    sizes = placed.groupBy(part.alias("part_")).agg(F.count("*").alias("size_"))
    before = sizes.select("part_", (F.sum("size_").over(Window.orderBy("part_")) - F.col("size_")).alias("before_"))
    out = placed.withColumn("part_", part).join(F.broadcast(before), "part_")  # one row a partition
    return out.select(*rows.columns, (F.col("before_") + F.col("id_").bitwiseAND(inner) + 1).alias(name))
