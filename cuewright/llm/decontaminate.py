"""Benchmark decontamination with one Aho-Corasick automaton over item windows.

Texts are normalised to lower-case words (digits, a-z, every character beyond ASCII), each
preceded and followed by one space. A window is ``width`` consecutive words of an item; an
item with fewer words, but not none, is one window. All windows are patterns of one
automaton; each document is scanned once, and word indices map hits back to code points of
the original text.

Items reach the tasks in slices of at most ``slice_bytes`` bytes of text, so what is
broadcast has a fixed bound: a larger benchmark makes more slices, each of which adds its
hits to those of the slice before, in the same stage, without a shuffle.

Defined results: a null or wordless text has no words, no hits and is not contaminated;
items that are null or wordless have no windows; repeated rows each get their own result;
an empty benchmark hits nothing; an item whose id is null or occurs in several rows counts
under the id's string, ``null`` for a null id, once. Other columns of ``docs`` are ignored
by ``decontaminate`` and kept by ``annotate``.
"""

from __future__ import annotations

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cuewright.llm.common import append_column, free_name, read, utf8_parts

WIDTH = 13
SLICE_BYTES = 16 << 20

_IS_WORD = np.zeros(256, bool)
_IS_WORD[ord("0") : ord("9") + 1] = _IS_WORD[ord("a") : ord("z") + 1] = _IS_WORD[128:] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A") : ord("Z") + 1] += 32

SPAN = T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())])
RESULT = T.StructType(
    [
        T.StructField("n_words", T.LongType()),
        T.StructField("n_hit", T.LongType()),
        T.StructField("item_ids", T.ArrayType(T.StringType())),
        T.StructField("words", T.ArrayType(SPAN)),
        T.StructField("spans", T.ArrayType(SPAN)),
    ]
)


def word_bounds(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Lower-cased bytes, and where words start and end in them."""
    low = _LOWER[raw]
    edge = np.diff(_IS_WORD[low].view(np.int8), prepend=np.int8(0), append=np.int8(0))
    return low, np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)


def item_windows(text: str | None, width: int) -> list[bytes]:
    low, start, end = word_bounds(np.frombuffer((text or "").encode(), np.uint8))
    words = [low[a:b].tobytes() for a, b in zip(start, end, strict=True)]
    if not words:
        return []
    return [b" " + b" ".join(words[i : i + width]) + b" " for i in range(max(1, len(words) - width + 1))]


def build(items: list[tuple[str, str | None]], width: int) -> ahocorasick.Automaton | None:
    """The automaton of all windows; a value is (words in the window, ids with it)."""
    owners: dict[bytes, tuple[int, set[str]]] = {}
    for item_id, text in items:
        for window in item_windows(text, width):
            owners.setdefault(window, (window.count(b" ") - 1, set()))[1].add(item_id)
    if not owners:
        return None
    auto = ahocorasick.Automaton()
    for window, value in owners.items():
        auto.add_word(window.decode("latin-1"), value)
    auto.make_automaton()
    return auto


def scan_one(raw: np.ndarray, auto, hit_runs: list, ids: set[str]) -> tuple[int, list, list]:
    """Words of one text, and the word runs and code-point spans that windows cover."""
    low, start, end = word_bounds(raw)
    n = len(start)
    if n and auto is not None:
        word = _IS_WORD[low]
        keep = word.copy()
        keep[end[end < len(low)]] = True
        line = np.where(word, low, np.uint8(32))[keep]
        norm = " " + line.tobytes().decode("latin-1") + " "
        spaces = None
        for at, (size, owners) in auto.iter(norm):
            if spaces is None:
                # norm starts at the first word: anything before it collapses to one space
                spaces = np.cumsum(np.frombuffer(norm.encode("latin-1"), np.uint8) == 32)
            last = int(spaces[at - 1]) - 1 - (int(start[0]) > 0 and norm.startswith("  "))
            hit_runs.append((last - size + 1, last + 1))
            ids |= owners
    merged: list[list[int]] = []
    for a, b in sorted(hit_runs):
        if merged and a <= merged[-1][1]:
            merged[-1][1] = max(merged[-1][1], b)
        else:
            merged.append([a, b])
    if not merged:
        return n, [], []
    points = np.concatenate([[0], np.cumsum((raw & 0xC0) != 0x80)])
    return n, merged, [(int(points[start[a]]), int(points[end[b - 1]])) for a, b in merged]


def _slices(items: DataFrame, item_id: str, text: str, slice_bytes: int) -> list[list[tuple]]:
    """Items in lists of at most ``slice_bytes`` of text each (one item at least)."""
    held = items.select(F.coalesce(F.col(item_id).cast("string"), F.lit("null")), F.col(text))
    out, used = [[]], 0
    for row in held.toLocalIterator():
        size = len((row[1] or "").encode())
        if out[-1] and used + size > slice_bytes:
            out.append([])
            used = 0
        out[-1].append((row[0], row[1]))
        used += size
    return out


def annotate(
    docs: DataFrame,
    items: DataFrame,
    name: str = "contamination",
    *,
    text: str = "text",
    item_id: str = "item_id",
    item_text: str = "text",
    width: int = WIDTH,
    slice_bytes: int = SLICE_BYTES,
) -> DataFrame:
    """``docs`` with one struct column more: n_words, n_hit, item_ids, words, spans.

    ``words`` are maximal hit runs as word indices, ``spans`` the same as code points of
    the original text, end exclusive.
    """
    spark = docs.sparkSession
    before: str | None = None
    for piece in _slices(items, item_id, item_text, slice_bytes):
        held = spark.sparkContext.broadcast(piece)

        def factory(held=held):
            auto = build(held.value, width)

            def scan(texts: pa.Array, earlier: pa.Array | None = None) -> pa.Array:
                data, at = utf8_parts(texts)
                past = earlier.to_pylist() if earlier is not None else [None] * len(texts)
                rows = []
                for i, old in enumerate(past):
                    runs = [(w["start"], w["end"]) for w in old["words"]] if old else []
                    ids = set(old["item_ids"]) if old else set()
                    n, words, spans = scan_one(data[at[i] : at[i + 1]], auto, runs, ids)
                    as_spans = lambda xs: [{"start": a, "end": b} for a, b in xs]
                    rows.append(
                        {
                            "n_words": n,
                            "n_hit": sum(b - a for a, b in words),
                            "item_ids": sorted(ids),
                            "words": as_spans(words),
                            "spans": as_spans(spans),
                        }
                    )
                return pa.array(rows, _ARROW)

            return scan

        now = free_name(docs, name if before is None else f"{name}_next")
        docs = append_column(docs, now, RESULT, [text] + ([before] if before else []), factory)
        if before:
            docs = docs.drop(before)
        before = now
    return docs.withColumnRenamed(before, name) if name not in docs.columns else docs


_SPANS = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
_ARROW = pa.struct(
    [
        ("n_words", pa.int64()),
        ("n_hit", pa.int64()),
        ("item_ids", pa.list_(pa.string())),
        ("words", _SPANS),
        ("spans", _SPANS),
    ]
)


def decontaminate(docs: DataFrame, items: DataFrame, *, doc_id: str = "doc_id", text: str = "text", **kw) -> DataFrame:
    """One row per document row: id, n_words, n_hit, item_ids, spans, contaminated.

    Contaminated: at least one word in twenty lies in a window of some item.
    """
    named = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    found = annotate(named, items, "hit", text="text", **kw)
    return found.select(
        "doc_id", "hit.n_words", "hit.n_hit", "hit.item_ids", "hit.spans", is_contaminated(F.col("hit")).alias("contaminated")
    )


def is_contaminated(hit):
    return (hit["n_hit"] > 0) & (F.lit(20) * hit["n_hit"] >= hit["n_words"])


def op1_decontaminate(spark, sf_dir: str) -> DataFrame:
    """The contract's digest of ``decontaminate`` over whole tables."""
    out = decontaminate(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark", "item_id", "text"))
    return out.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("item_ids").cast("long").alias("n_items"),
        F.sha2(F.array_join("item_ids", ","), 256).alias("items_sha256"),
        "contaminated",
    )


OP1_SQL = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (
  SELECT CAST(item_id AS VARCHAR) AS item_id, regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
bw AS (
  SELECT DISTINCT item_id, least(len(w), 13) AS k, array_to_string(list_slice(w, p, p + 12), ' ') AS win
  FROM (SELECT item_id, w, unnest(generate_series(1, greatest(1, len(w) - 12))) AS p FROM b WHERE len(w) > 0)),
dw AS (
  SELECT doc_id, p, k, array_to_string(list_slice(w, p, p + k - 1), ' ') AS win
  FROM (SELECT doc_id, w, k, unnest(generate_series(1, len(w) - k + 1)) AS p
        FROM d, (SELECT DISTINCT k FROM bw) WHERE len(w) >= k)),
h AS (SELECT doc_id, p, dw.k AS k, item_id FROM dw JOIN bw ON dw.win = bw.win AND dw.k = bw.k),
n AS (SELECT doc_id, count(DISTINCT q) AS n_hit
      FROM (SELECT doc_id, unnest(generate_series(p, p + k - 1)) AS q FROM h) GROUP BY doc_id),
i AS (SELECT doc_id, count(DISTINCT item_id) AS n_items,
             string_agg(DISTINCT item_id, ',' ORDER BY item_id) AS ids FROM h GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
       CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(ids, '')) AS items_sha256,
       (coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w)) AS contaminated
FROM d LEFT JOIN n ON d.doc_id = n.doc_id LEFT JOIN i ON d.doc_id = i.doc_id
"""
