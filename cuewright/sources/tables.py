"""Word tables: one row a token with job_id, word_idx, word, start_ms, end_ms, confidence, speaker."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cuewright.functions.text import tokens


def table(spark: SparkSession, sf_dir: str, name: str, *cols: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return df.select(*cols) if cols else df


def _timed(df: DataFrame, start) -> DataFrame:
    return df.select(
        "job_id",
        "word_idx",
        "word",
        start.cast("long").alias("start_ms"),
        (start + 300).cast("long").alias("end_ms"),
        (((F.col("job_id") * 31 + F.col("word_idx") * 17) % 101) / F.lit(100.0)).alias("confidence"),
        "speaker",
    )


#: Bytes of text whose words one task sorts in memory; as rows they take 20 to 40 times that.
TASK_TEXT = 4 << 20


def tasks_for(texts: DataFrame) -> int:
    """Tasks to deal ``texts`` (a column text) out to, about TASK_TEXT bytes each.

    A named number of partitions stays as it is; others are merged by the size of the shuffled
    texts until there is one a core, and a task's words then grow with the input until they spill.
    """
    size = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    return max(texts.sparkSession.sparkContext.defaultParallelism, math.ceil(size / TASK_TEXT))


def document_tasks(spark: SparkSession, sf_dir: str) -> int:
    return tasks_for(table(spark, sf_dir, "documents", "text"))


def words_of_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns as one job each: 100 ms between words, 1100 ms between turns, the role speaks."""
    held = table(spark, sf_dir, "conversations")
    turns = held.repartition(tasks_for(held), "conv_id").withColumn("ws", tokens(F.col("text")))
    before = Window.partitionBy("conv_id").orderBy("turn").rowsBetween(Window.unboundedPreceding, -1)
    rows = turns.withColumn("o", F.coalesce(F.sum(F.size("ws")).over(before), F.lit(0))).select(
        F.col("conv_id").alias("job_id"), "turn", F.col("role").alias("speaker"), "o", F.posexplode("ws").alias("i", "word")
    )
    rows = rows.withColumn("word_idx", (F.col("o") + F.col("i")).cast("long"))
    return _timed(rows, 400 * F.col("word_idx") + 1000 * F.col("turn"))


def spread(df: DataFrame, key: str) -> DataFrame:
    """Rows over all cores by ``key`` if the input has fewer splits than the session has cores."""
    few = df.rdd.getNumPartitions() < df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(key) if few else df


def words_of_documents(spark: SparkSession, sf_dir: str, by_job: bool = True, tasks: int | None = None) -> DataFrame:
    """Documents as one job each: 100 ms between words, 800 ms before every twelfth.

    ``by_job`` shuffles the texts before they become words, which serves all windows and groups
    of a job: a text is one row there, a fraction of what its timed words take. Leave it off
    where nothing works by job. ``tasks``: the number of them, for callers that deal more out in the
    same way; without it, that of ``document_tasks``.
    """
    docs = table(spark, sf_dir, "documents", "doc_id", "text")
    docs = docs.repartition(tasks or tasks_for(docs), "doc_id") if by_job else spread(docs, "doc_id")
    rows = docs.select(F.col("doc_id").alias("job_id"), F.posexplode(tokens(F.col("text"))).alias("i", "word"))
    rows = rows.withColumn("word_idx", F.col("i").cast("long")).withColumn("speaker", F.lit(None).cast("string"))
    return _timed(rows, 400 * F.col("word_idx") + 700 * F.floor(F.col("word_idx") / 12))
