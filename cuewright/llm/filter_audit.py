"""What each filter of a chain removes, in every order, from one SQL CUBE.

Rows with the same part, flags and labels are counted first. A cube over the part and the
flags then has, for every subset of filters, the grouping set in which just these flags are
kept; its row with all of them false is what survives the subset. A step of an order is the
pair of subsets before and after it, so all steps of all orders come from joins of pairs of
subsets, and no document is read again.

Copies: a text that a smaller id has fails. Documents are counted by id, text (SHA-256), part
and labels before texts meet, so a text with a third of all rows arrives as one row for each
part, label and task.

Defined results: a null text counts as empty, a null part as the empty string; a null id is
neither smaller nor larger than another, so it fails no copy filter and makes none fail; rows
that repeat an id and a text don't fail by each other; an id with several labels is good or
toxic if one of them says so, one without labels is neither, and a label without an id marks nothing; very long texts are counted
whole; an empty table gives no rows. Other columns are not read, so their names can't clash.
"""

from __future__ import annotations

import itertools
import math
import string
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cuewright.llm.common import Workspace, read

SPACE = r"[ \t-\r]+"


def text_filters(text: Column) -> dict[str, Column]:
    """Failure conditions of one text: short, repetitive, capitals, symbols."""
    words = F.array_remove(F.split(text, SPACE), "")
    capitals = F.length(text) - F.length(F.translate(text, string.ascii_uppercase, ""))
    return {
        "A": F.size(words) < 200,
        "B": 100 * F.size(F.array_distinct(words)) < 50 * F.size(words),
        "C": 100 * capitals > 2 * F.length(text),
        "D": text.rlike(r"[#$%&*|]"),
    }


def flag_counts(docs: DataFrame, labels: DataFrame, *, doc_id: str = "doc_id", text: str = "text", part: str = "source", copies: str = "E") -> DataFrame:
    """Counts of documents, good and toxic ones, by part and failure flags."""
    body = F.coalesce(F.col(text), F.lit(""))
    tests = text_filters(body)
    bits = [F.when(test, F.lit(1 << i)).otherwise(0) for i, test in enumerate(tests.values())]
    thin = docs.select(
        F.col(doc_id).alias("id"),
        F.coalesce(F.col(part).cast("string"), F.lit("")).alias("part"),
        reduce(lambda a, b: a + b, bits).alias("bits"),
        F.unhex(F.sha2(body, 256)).alias("digest"),
    )
    counted = thin.groupBy("id", "part", "bits", "digest").agg(F.count("*").alias("n"))
    marks = labels.groupBy(F.col("doc_id").alias("id")).agg(
        F.coalesce(F.max(F.col("quality") == 1), F.lit(False)).alias("good"), F.coalesce(F.max(F.col("toxic") == 1), F.lit(False)).alias("toxic")
    )
    marked = counted.join(marks, "id", "left").withColumns({c: F.coalesce(F.col(c), F.lit(False)) for c in ("good", "toxic")})
    same = marked.groupBy("digest", "part", "bits", "good", "toxic").agg(
        F.sum("n").alias("n"),
        F.coalesce(F.sum(F.when(F.col("id").isNull(), F.col("n"))), F.lit(0)).alias("unnamed"),
        F.min(F.when(F.col("id").isNotNull(), F.struct("id", "n"))).alias("first"),
    )
    least = F.min("first.id").over(Window.partitionBy("digest"))
    fine = F.col("unnamed") + F.when(F.col("first.id") == F.col("least"), F.col("first.n")).otherwise(0)
    split = same.withColumn("least", least).select(
        "part",
        "bits",
        "good",
        "toxic",
        F.explode(F.array(F.struct(F.lit(False).alias("copy"), fine.alias("n")), F.struct(F.lit(True).alias("copy"), (F.col("n") - fine).alias("n")))).alias("x"),
    )
    flags = {f: F.col("bits").bitwiseAND(1 << i) != 0 for i, f in enumerate(tests)} | {copies: F.col("x.copy")}
    return (
        split.where("x.n > 0")
        .select("part", *[c.alias(f) for f, c in flags.items()], F.col("x.n").alias("n"), F.when(F.col("good"), F.col("x.n")).otherwise(0).alias("good"), F.when(F.col("toxic"), F.col("x.n")).otherwise(0).alias("toxic"))
        .groupBy("part", *flags)
        .agg(*[F.sum(c).alias(c) for c in ("n", "good", "toxic")])
    )


def survivors(counts: DataFrame, filters: str) -> DataFrame:
    """(part, subset, n, good, toxic) for every part and subset of filters; subsets are bit masks, zeros included."""
    sums = [F.sum(c).alias(c) for c in ("n", "good", "toxic")]
    subset = reduce(lambda a, b: a + b, [F.when(F.grouping(f) == 0, F.lit(1 << i)).otherwise(0) for i, f in enumerate(filters)])
    cube = counts.cube("part", *filters).agg(F.grouping("part").alias("rolled"), subset.alias("subset"), *sums)
    passing = reduce(lambda a, b: a & b, [~F.coalesce(F.col(f), F.lit(False)) for f in filters])
    found = cube.where((F.col("rolled") == 0) & passing).select("part", "subset", "n", "good", "toxic")
    grid = counts.select("part").distinct().select("part", F.explode(F.sequence(F.lit(0), F.lit((1 << len(filters)) - 1))).alias("subset"))
    return grid.join(found, ["part", "subset"], "left").fillna(0, ["n", "good", "toxic"])


def audit(counts: DataFrame, filters: str = "ABCDE") -> DataFrame:
    """One row for each part, order of ``filters`` and step, from ``counts`` by part and flags (see ``flag_counts``)."""
    if len(filters) > 6:
        raise ValueError("orders of more than six filters are too many to list")
    spark = counts.sparkSession
    work = Workspace(spark, "audit")
    left = work.put(survivors(work.put(counts, "counts"), filters), "survivors")
    at, size = {f: 1 << i for i, f in enumerate(filters)}, len(filters)
    whole = (1 << size) - 1
    pairs = [
        (f, before, before | at[f], math.factorial(before.bit_count()) * math.factorial(size - before.bit_count() - 1))
        for f in filters
        for before in range(whole + 1)
        if not before & at[f]
    ]
    orders = []
    for order in itertools.permutations(filters):
        before = 0
        for step, f in enumerate(order, 1):
            orders.append(("".join(order), step, f, before))
            before |= at[f]
    pairs = spark.createDataFrame(pairs, "filter string, before int, after int, weight long")
    orders = spark.createDataFrame(orders, "filter_order string, step int, filter string, before int")
    first = left.select("part", F.col("subset").alias("before"), *[F.col(c).alias(f"{c}_before") for c in ("n", "good", "toxic")])
    second = left.withColumnRenamed("subset", "after")
    # both lists have a fixed size, whatever the input
    steps = first.join(F.broadcast(pairs), "before").join(second, ["part", "after"])
    steps = steps.select(
        "part",
        "filter",
        "before",
        "after",
        "weight",
        F.col("n").alias("kept"),
        *[(F.col(f"{c}_before") - F.col(c)).alias(out) for c, out in (("n", "removed"), ("good", "good_lost"), ("toxic", "toxic_lost"))],
    )
    totals = steps.groupBy("part", "filter").agg(
        F.max(F.when(F.col("before") == 0, F.col("removed"))).alias("fails"),
        F.max(F.when(F.col("after") == whole, F.col("removed"))).alias("unique_fails"),
        F.sum(F.col("weight") * F.col("removed")).alias("shapley"),
    )
    return (
        steps.join(F.broadcast(orders), ["filter", "before"])
        .join(totals, ["part", "filter"])
        .select("part", "filter_order", "step", "kept", "removed", (F.col("fails") - F.col("removed")).alias("redundant"), "unique_fails", "good_lost", "toxic_lost", "shapley")
    )


def op12_filter_audit(spark, sf_dir: str) -> DataFrame:
    """The audit of five filters over whole ``documents``, by source."""
    docs, labels = read(spark, sf_dir, "documents", "doc_id", "text", "source"), read(spark, sf_dir, "labels", "doc_id", "quality", "toxic")
    return audit(flag_counts(docs, labels))


OP12_SQL = r"""
WITH w AS (
  SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t,
         regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
l AS (SELECT doc_id, max(CAST(quality = 1 AS INT)) AS good, max(CAST(toxic = 1 AS INT)) AS toxic FROM labels GROUP BY doc_id),
f AS (
  SELECT w.doc_id, part, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic,
         {'A': len(w) < 200, 'B': 100 * len(list_distinct(w)) < 50 * len(w),
          'C': 100 * (length(t) - length(translate(t, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', ''))) > 2 * length(t),
          'D': regexp_matches(t, '[#$%&*|]'),
          'E': coalesce(min(w.doc_id) OVER (PARTITION BY t) < w.doc_id, false)} AS x
  FROM w LEFT JOIN l ON w.doc_id = l.doc_id),
c AS (
  SELECT part, x, CAST(count(*) AS BIGINT) AS n, CAST(sum(good) AS BIGINT) AS good, CAST(sum(toxic) AS BIGINT) AS toxic,
         (CASE WHEN x['A'] THEN 'A' ELSE '' END || CASE WHEN x['B'] THEN 'B' ELSE '' END || CASE WHEN x['C'] THEN 'C' ELSE '' END
          || CASE WHEN x['D'] THEN 'D' ELSE '' END || CASE WHEN x['E'] THEN 'E' ELSE '' END) AS bad
  FROM f GROUP BY part, x),
k(k) AS (VALUES ('A'), ('B'), ('C'), ('D'), ('E')),
o AS (
  SELECT a.k || b.k || c.k || d.k || e.k AS filter_order FROM k a, k b, k c, k d, k e
  WHERE a.k <> b.k AND a.k <> c.k AND a.k <> d.k AND a.k <> e.k AND b.k <> c.k AND b.k <> d.k AND b.k <> e.k
    AND c.k <> d.k AND c.k <> e.k AND d.k <> e.k),
s AS (SELECT filter_order, step, substr(filter_order, step, 1) AS filter, substr(filter_order, 1, step - 1) AS earlier
      FROM o, (SELECT CAST(unnest(generate_series(1, 5)) AS INTEGER) AS step)),
g AS (
  SELECT part, filter_order, step, filter, n, good, toxic, contains(bad, filter) AS fails, bad = filter AS alone,
         translate(bad, earlier, '') <> bad AS gone, bad <> '' AND translate(bad, earlier || filter, '') = bad OR bad = '' AS stays
  FROM c, s),
r AS (
  SELECT part, filter_order, step, filter,
         CAST(coalesce(sum(n) FILTER (stays), 0) AS BIGINT) AS kept,
         CAST(coalesce(sum(n) FILTER (fails AND NOT gone), 0) AS BIGINT) AS removed,
         CAST(coalesce(sum(n) FILTER (fails AND gone), 0) AS BIGINT) AS redundant,
         CAST(coalesce(sum(n) FILTER (alone), 0) AS BIGINT) AS unique_fails,
         CAST(coalesce(sum(good) FILTER (fails AND NOT gone), 0) AS BIGINT) AS good_lost,
         CAST(coalesce(sum(toxic) FILTER (fails AND NOT gone), 0) AS BIGINT) AS toxic_lost
  FROM g GROUP BY part, filter_order, step, filter)
SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost,
       CAST(sum(removed) OVER (PARTITION BY part, filter) AS BIGINT) AS shapley
FROM r
"""
