"""Fill-in-the-middle: texts cut in three by an Aho-Corasick event scan.

One automaton finds the characters that end a unit (a line feed for lines, ASCII white space
for words, none for characters) and the sentinels, in one pass over code points. These events
are sparse: between two of them the number of units is arithmetic, so the place of the k-th
unit's end is looked up by rank among the events, and no text is split into units.

Both cuts and the form come from the SHA-256 of ``seed:id``, so a document is treated alike
wherever and however often its task runs.

Defined results: a null text counts as empty; an empty text and one that holds a sentinel are
``plain``, as they could not be told from a cut one; a null id hashes as the empty string;
repeated rows each get the same result; very long texts are cut whole, in memory of a few
times their size; an empty table gives none. Other columns of ``docs`` are kept, and may have
any name but that of the new column.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cuewright.llm.common import append_column, free_name, read

SENTINELS = ("<P>", "<S>", "<M>")
#: Characters that end a unit; between them, units are counted by arithmetic.
ENDS = {"line": "\n", "word": "\t\n\x0b\x0c\r ", "char": ""}

RESULT = T.StructType(
    [
        T.StructField("n", T.LongType()),
        T.StructField("form", T.StringType()),
        T.StructField("prefix_chars", T.LongType()),
        T.StructField("middle_chars", T.LongType()),
        T.StructField("output", T.StringType()),
    ]
)


def automaton(unit: str, sentinels: tuple[str, ...] = SENTINELS) -> ahocorasick.Automaton:
    """One automaton of the unit's ending characters (value 0) and the sentinels (value 1)."""
    auto = ahocorasick.Automaton()
    for c in ENDS[unit]:
        auto.add_word(c, 0)
    for s in sentinels:
        auto.add_word(s, 1)
    auto.make_automaton()
    return auto


def ranks(unit: str, at: np.ndarray, length: int) -> tuple[int, Callable[[int], int]]:
    """Units of a text of ``length`` code points with events ``at``, and where the k-th ends.

    A line is what ends in a line feed, and the rest; a word is a run of other characters
    with the white space before it, and white space at the end is one more; a character is one.
    """
    if unit == "char":
        return length, lambda k: k
    if unit == "line":
        ends = at + 1
        left = length > (ends[-1] if len(ends) else 0)
    else:
        gap = np.diff(at, prepend=-1) > 1
        ends = at[gap]
        left = length > (ends[-1] if len(ends) else 0)
    n = len(ends) + int(left)
    return n, lambda k: 0 if k == 0 else length if k == n else int(ends[k - 1])


def draw(seed: int, key: str) -> list[int]:
    """The first four groups of eight digits of the hash of ``seed:key``."""
    digits = hashlib.sha256(f"{seed}:{key}".encode()).hexdigest()
    return [int(digits[i : i + 8], 16) for i in range(0, 32, 8)]


def transform_one(text: str, key: str, auto, unit: str, seed: int, fim_percent: int, spm_percent: int, sentinels) -> dict:
    """The result of one text, as a struct of ``RESULT``."""
    at, marked = [], False
    for end, kind in auto.iter(text):
        if kind:
            marked = True
        else:
            at.append(end)
    n, end_of = ranks(unit, np.array(at, np.int64), len(text))
    h1, h2, h3, h4 = draw(seed, key)
    if not text or marked or h3 % 100 >= fim_percent:
        return {"n": n, "form": "plain", "prefix_chars": None, "middle_chars": None, "output": text}
    first, second = sorted((h1 % (n + 1), h2 % (n + 1)))
    a, b = end_of(first), end_of(second)
    p, s, m = sentinels
    if h4 % 100 < spm_percent:
        form, output = "spm", f"{s}{text[b:]}{p}{text[:a]}{m}{text[a:b]}"
    else:
        form, output = "psm", f"{p}{text[:a]}{s}{text[b:]}{m}{text[a:b]}"
    return {"n": n, "form": form, "prefix_chars": a, "middle_chars": b - a, "output": output}


def transform(
    docs: DataFrame,
    name: str = "fim",
    *,
    doc_id: str = "doc_id",
    text: str = "text",
    unit: str = "line",
    seed: int = 7,
    fim_percent: int = 100,
    spm_percent: int = 50,
    sentinels: tuple[str, str, str] = SENTINELS,
) -> DataFrame:
    """``docs`` with one struct column more: n, form, prefix_chars, middle_chars, output.

    ``fim_percent`` of the texts are cut, of these ``spm_percent`` with the suffix first.
    ``sentinels`` stand before prefix, suffix and middle.
    """
    if unit not in ENDS:
        raise ValueError(f"unit must be one of {sorted(ENDS)}")
    key = free_name(docs, "fim_key")
    keyed = docs.withColumn(key, F.coalesce(F.col(doc_id).cast("string"), F.lit("")))

    def factory():
        auto = automaton(unit, sentinels)

        def cut(texts: pa.Array, keys: pa.Array) -> pa.Array:
            pairs = zip(texts.to_pylist(), keys.to_pylist(), strict=True)
            return pa.array([transform_one(t or "", k, auto, unit, seed, fim_percent, spm_percent, sentinels) for t, k in pairs], _ARROW)

        return cut

    return append_column(keyed, name, RESULT, [text, key], factory).drop(key)


_ARROW = pa.struct([("n", pa.int64()), ("form", pa.string()), ("prefix_chars", pa.int64()), ("middle_chars", pa.int64()), ("output", pa.string())])


def restore(output: Column, form: Column, sentinels: tuple[str, str, str] = SENTINELS) -> Column:
    """The text from an output and its form. No part holds a sentinel, so the first of each kind is the mark."""
    p, s, m = sentinels

    def parts(opening: str, inner: str) -> Column:
        rest = F.substring(output, F.lit(len(opening) + 1), F.length(output))
        one = F.substring_index(rest, inner, 1)
        later = F.substring(rest, F.length(one) + len(inner) + 1, F.length(rest))
        two = F.substring_index(later, m, 1)
        three = F.substring(later, F.length(two) + len(m) + 1, F.length(later))
        return one, two, three

    prefix, suffix, middle = parts(p, s)
    suffix2, prefix2, middle2 = parts(s, p)
    return F.when(form == "psm", F.concat(prefix, middle, suffix)).when(form == "spm", F.concat(prefix2, middle2, suffix2)).otherwise(output)


def op11_fim(spark, sf_dir: str) -> DataFrame:
    """The contract's digest of ``transform`` over whole ``documents``, cut by lines."""
    out = transform(read(spark, sf_dir, "documents", "doc_id", "text"))
    return out.select(
        "doc_id",
        "fim.n",
        "fim.form",
        "fim.prefix_chars",
        "fim.middle_chars",
        F.sha2(F.col("fim.output"), 256).alias("output_sha256"),
        F.sha2(restore(F.col("fim.output"), F.col("fim.form")), 256).alias("restored_sha256"),
    )


OP11_SQL = r"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS t, sha256('7:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS s FROM documents),
u AS (
  SELECT doc_id, t, regexp_extract_all(t, '[^\n]*\n|[^\n]+') AS u,
         CAST('0x' || s[1:8] AS BIGINT) AS h1, CAST('0x' || s[9:16] AS BIGINT) AS h2,
         CAST('0x' || s[25:32] AS BIGINT) AS h4,
         t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') AS plain
  FROM d),
c AS (
  SELECT doc_id, t, u, plain, len(u) AS n, least(h1 % (len(u) + 1), h2 % (len(u) + 1)) AS a,
         greatest(h1 % (len(u) + 1), h2 % (len(u) + 1)) AS b, h4 % 100 < 50 AS spm FROM u),
p AS (
  SELECT doc_id, t, n, plain, spm, array_to_string(u[1:a], '') AS prefix,
         array_to_string(u[a + 1:b], '') AS middle, array_to_string(u[b + 1:n], '') AS suffix FROM c)
SELECT doc_id, CAST(n AS BIGINT) AS n, CASE WHEN plain THEN 'plain' WHEN spm THEN 'spm' ELSE 'psm' END AS form,
       CASE WHEN NOT plain THEN CAST(length(prefix) AS BIGINT) END AS prefix_chars,
       CASE WHEN NOT plain THEN CAST(length(middle) AS BIGINT) END AS middle_chars,
       sha256(CASE WHEN plain THEN t WHEN spm THEN '<S>' || suffix || '<P>' || prefix || '<M>' || middle
                   ELSE '<P>' || prefix || '<S>' || suffix || '<M>' || middle END) AS output_sha256,
       sha256(t) AS restored_sha256
FROM p
"""
