"""Exact removal of repeated strings by difference-cover suffix sorting.

A byte goes if a string of ``LENGTH`` bytes that covers it starts anywhere else as well.

1. Discarding. Most of a corpus cannot repeat. Each window of ``LENGTH`` bytes names its
   anchor, the leftmost smallest hash of the ``GRAM``-byte strings in it; equal windows have
   equal anchors at equal places. Only anchors whose hash occurs twice can hold repeats. The
   windows of one anchor form one context, a string of up to 2 * LENGTH - GRAM bytes. Equal
   contexts, met by 128 bits of hash, are all repeated and stand for one in what follows.
2. Sorting. The bytes of distinct contexts go to buckets by anchor hash, so all equal windows
   meet in one bucket. A bucket's suffix array is built by the difference-cover algorithm
   modulo three (``suffix_array``): sampled triples are sorted and named, names that are not
   unique are sorted by recursion, the remaining third is sorted by its first letter and the
   rank of what follows, and both are merged.
3. Comparing. Windows that stand next to each other in suffix order are compared over
   LENGTH bytes; equal ones are repeated. No decision between different contexts rests on a
   hash.
4. Every occurrence of a context takes its repeated windows; a document's byte ranges are
   merged and cut out.

Buckets hold at most ``BUCKET`` letters. An anchor with more distinct contexts than that (a
passage in very many surroundings) has its contexts cut to single windows, which are counted
by 128 bits of hash and never meet in one task.

Defined results: a null text counts as empty; shorter texts than LENGTH are kept whole;
repeated rows are copies of one another; an empty table gives an empty table. Matches never
cross documents. Rows are named by hashes of id and text, so equal rows share their (equal)
result.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cuewright.llm.common import Workspace, read, utf8_parts

LENGTH = 400
GRAM = 200
BUCKET = 1 << 20  # letters in a bucket
LARGEST = 1 << 21  # letters that suffix_array packs three of into 63 bits

_PIECE = 1 << 21
_RANDOM = np.random.default_rng(11).integers(0, 1 << 64, (2, 256), dtype=np.uint64)
_BASE = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)


class Powers:
    """Powers of the hash bases and of their inverses modulo 2**64."""

    def __init__(self, n: int):
        with np.errstate(over="ignore"):
            self.up, self.down = [], []
            for b in _BASE:
                for x, into in ((b, self.up), (pow(b, -1, 1 << 64), self.down)):
                    into.append(np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(n, x, np.uint64)])))


_POWERS = Powers(0)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


class Hashes:
    """Hashes of any substring of a sequence, by one of two functions. ``letters(k)``: its letters as random numbers."""

    def __init__(self, n: int, letters: Callable[[int], np.ndarray]):
        global _POWERS
        if len(_POWERS.up[0]) <= n:
            _POWERS = Powers(n)
        with np.errstate(over="ignore"):
            self.sums = [np.concatenate([np.zeros(1, np.uint64), np.cumsum(letters(k) * _POWERS.up[k][:n])]) for k in (0, 1)]

    @classmethod
    def of_bytes(cls, data: np.ndarray) -> Hashes:
        return cls(len(data), lambda k: _RANDOM[k][data])

    def of(self, start: np.ndarray, end: np.ndarray, k: int) -> np.ndarray:
        with np.errstate(over="ignore"):
            return _mix((self.sums[k][end] - self.sums[k][start]) * _POWERS.down[k][start])


def anchors(hashes: Hashes, n: int, at: np.ndarray, length: int = LENGTH, gram: int = GRAM) -> tuple[np.ndarray, ...] | None:
    """Contexts of texts at[i] to at[i + 1] of n letters: text, first and last window, anchor, its hash, hash of the context."""
    w = length - gram + 1
    if n < length:
        return None
    i = np.arange(n - gram + 1)
    h = hashes.of(i, i + gram, 0)
    low = np.uint64((1 << 22) - 1)
    v = (h & ~low) | i.astype(np.uint64)
    x = np.concatenate([v, np.full(-len(v) % w, ~np.uint64(0))]).reshape(-1, w)
    left = np.minimum.accumulate(x, axis=1).ravel()
    right = np.minimum.accumulate(x[:, ::-1], axis=1)[:, ::-1].ravel()
    m = len(v)
    place = (np.minimum(right[: m - w + 1], left[w - 1 : m]) & low).astype(np.int64)
    start = np.arange(len(place))
    ok = start + length <= np.repeat(at[1:], np.diff(at))[: len(place)]
    start, place = start[ok], place[ok]
    if not len(start):
        return None
    first = np.flatnonzero((np.diff(place, prepend=-1) != 0) | (np.diff(start, prepend=-2) != 1))
    a, p = start[first], place[first]
    b = np.append(start[first[1:] - 1], start[-1])
    text = np.searchsorted(at, a, side="right") - 1
    return text, a - at[text], b - at[text], p - at[text], h[p], hashes.of(a, b + length, 1)


def contexts(docs: DataFrame) -> DataFrame:
    """(k1, k2, p, h, lo, hi, ctx) of every anchor: windows p - lo to p - hi. ``docs``: k1, k2, text."""

    def run(batches):
        for batch in batches:
            k1, k2 = (batch.column(i).to_numpy() for i in (0, 1))
            data, at = utf8_parts(batch.column(2))
            i = 0
            while i < batch.num_rows:
                j = max(i + 1, int(np.searchsorted(at, at[i] + (1 << 20), side="right")) - 1)
                # a text beyond the piece size is read in pieces that share LENGTH - 1 bytes
                for off in range(0, max(1, int(at[j] - at[i]) - LENGTH + 1), _PIECE) if j == i + 1 else (0,):
                    end = min(at[j], at[i] + off + _PIECE + LENGTH - 1) if j == i + 1 else at[j]
                    own = data[at[i] + off : end]
                    cut = np.asarray([0, len(own)]) if j == i + 1 else at[i : j + 1] - at[i]
                    found = anchors(Hashes.of_bytes(own), len(own), cut)
                    if found:
                        t, a, b, p, h, ctx = found
                        cols = [k1[i:j][t], k2[i:j][t], p + off, h.view(np.int64), (p - a).astype(np.int16), (p - b).astype(np.int16), ctx.view(np.int64)]
                        yield pa.RecordBatch.from_arrays([pa.array(c) for c in cols], names=_CONTEXT)
                i = j

    return docs.mapInArrow(run, "k1 long, k2 long, p long, h long, lo short, hi short, ctx long")


_CONTEXT = ["k1", "k2", "p", "h", "lo", "hi", "ctx"]

# --- the difference-cover algorithm ----------------------------------------------------


def suffix_array(t: np.ndarray) -> np.ndarray:
    """Suffix array of positive integers by the difference cover {1, 2} modulo 3."""
    n = len(t)
    if n < 3:
        return np.asarray(sorted(range(n), key=lambda i: t[i:].tolist()), np.int64)
    t = np.concatenate([t, np.zeros(3, np.int64)])
    width = int(t.max()) + 1
    # sampled positions; one past the end where that is needed to close the first half
    one, two = np.arange(1, n + (n % 3 == 1), 3), np.arange(2, n, 3)
    sample = np.concatenate([one, two])
    key = (t[sample] * width + t[sample + 1]) * width + t[sample + 2]
    order = np.argsort(key, kind="stable")
    new = np.diff(key[order], prepend=-1) != 0
    names = np.empty(len(sample), np.int64)
    names[order] = np.cumsum(new)
    if not new.all():
        order = suffix_array(names)
    rank = np.zeros(n + 3, np.int64)
    rank[sample[order]] = np.arange(1, len(sample) + 1)
    sorted_sample = sample[order]
    sorted_sample = sorted_sample[sorted_sample < n]
    rest = np.arange(0, n, 3)
    big = len(sample) + 2
    rest = rest[np.argsort(t[rest] * big + rank[rest + 1], kind="stable")]
    s1, s2 = sorted_sample[sorted_sample % 3 == 1], sorted_sample[sorted_sample % 3 == 2]
    pair = lambda i: t[i] * big + rank[i + 1]
    triple = lambda i: (t[i] * width + t[i + 1]) * big + rank[i + 2]
    before = np.searchsorted(pair(s1), pair(rest)) + np.searchsorted(triple(s2), triple(rest))
    out = np.empty(n, np.int64)
    taken = np.zeros(n, bool)
    at = np.arange(len(rest)) + before
    out[at] = rest
    taken[at] = True
    out[~taken] = sorted_sample
    return out


def repeated_windows(texts: list[bytes], windows: list[int]) -> list[np.ndarray]:
    """For each text, whether its windows 0 .. windows - 1 occur again in some text or place."""
    # each text ends in a letter of its own, so no match runs over an end
    size = np.asarray([len(x) + 1 for x in texts])
    first = np.cumsum(size) - size
    raw = np.frombuffer(b"\0".join(texts) + b"\0" * 8, np.uint8)
    t = raw[: int(size.sum())].astype(np.int64) + 1
    t[first + size - 1] = 257 + np.arange(len(texts))
    is_window = np.zeros(len(t), bool)
    for a, n in zip(first.tolist(), windows, strict=True):
        is_window[a : a + n] = True
    order = suffix_array(t)
    order = order[is_window[order]]
    same = np.arange(len(order) - 1)
    lanes = np.ndarray((len(raw) - 7,), "<u8", raw, strides=(1,))
    for step in range(0, LENGTH, 8):
        if not len(same):
            break
        off = min(step, LENGTH - 8)
        same = same[lanes[order[same] + off] == lanes[order[same + 1] + off]]
    hit = np.zeros(len(t), bool)
    hit[order[same]] = hit[order[same + 1]] = True
    return [hit[a : a + n] for a, n in zip(first.tolist(), windows, strict=True)]


def _runs(hit: np.ndarray) -> list[tuple[int, int]]:
    edge = np.diff(hit.view(np.int8), prepend=np.int8(0), append=np.int8(0))
    return list(zip(np.flatnonzero(edge == 1).tolist(), (np.flatnonzero(edge == -1) - 1).tolist(), strict=True))


_FOUND = "h long, lo short, hi short, ctx long, a int, b int"


def _sort_bucket(group: pa.Table) -> pa.Table:
    """Runs of repeated windows a .. b (counted from a context's first) in one bucket."""
    rows = group.select(["h", "lo", "hi", "ctx", "bytes"]).to_pylist()
    hits = repeated_windows([r["bytes"] for r in rows], [r["lo"] - r["hi"] + 1 for r in rows])
    out = [(r["h"], r["lo"], r["hi"], r["ctx"], a, b) for r, hit in zip(rows, hits, strict=True) for a, b in _runs(hit)]
    cols = list(zip(*out, strict=True)) if out else [()] * 6
    kinds = (pa.int64(), pa.int16(), pa.int16(), pa.int64(), pa.int32(), pa.int32())
    return pa.table({c: pa.array(x, k) for c, x, k in zip(("h", "lo", "hi", "ctx", "a", "b"), cols, kinds, strict=True)})


def _single_windows(batches):
    for batch in batches:
        out = []
        for r in batch.select(["h", "lo", "hi", "ctx", "bytes"]).to_pylist():
            hashes, n = Hashes.of_bytes(np.frombuffer(r["bytes"], np.uint8)), r["lo"] - r["hi"] + 1
            i = np.arange(n)
            one, two = (hashes.of(i, i + LENGTH, k).view(np.int64) for k in (0, 1))
            same = [pa.array(np.full(n, r[c]), k) for c, k in (("h", pa.int64()), ("lo", pa.int16()), ("hi", pa.int16()), ("ctx", pa.int64()))]
            out.append(pa.RecordBatch.from_arrays([*same, pa.array(i, pa.int32()), pa.array(one), pa.array(two)], names=["h", "lo", "hi", "ctx", "a", "w1", "w2"]))
        yield from out


def _cut_out(id_type):
    def run(batches):
        for batch in batches:
            ids, texts, spans = batch.column(0), batch.column(1), batch.column(2).to_pylist()
            data, at = utf8_parts(texts)
            rows = []
            for i, own in enumerate(spans):
                raw = data[at[i] : at[i + 1]].tobytes()
                merged: list[list[int]] = []
                for s in sorted((x["a"], x["b"]) for x in own or ()):
                    if merged and s[0] <= merged[-1][1]:
                        merged[-1][1] = max(merged[-1][1], s[1])
                    else:
                        merged.append(list(s))
                kept, done = [], 0
                for a, b in merged:
                    kept.append(raw[done:a])
                    done = b
                kept = b"".join([*kept, raw[done:]])
                rows.append((len(raw), len(raw) - len(kept), [{"a": a, "b": b} for a, b in merged], kept))
            n, gone, cut, kept = zip(*rows, strict=True) if rows else ((), (), (), ())
            span = pa.list_(pa.struct([("a", pa.int64()), ("b", pa.int64())]))
            yield pa.RecordBatch.from_arrays(
                [ids, pa.array(n, pa.int64()), pa.array(gone, pa.int64()), pa.array(cut, span), pa.array(kept, pa.binary()), batch.column(3)],
                names=["doc_id", "n_bytes", "n_removed", "spans", "kept", "passage"],
            )

    return run


def repeats(named: DataFrame, work: Workspace, bucket: int = BUCKET) -> DataFrame:
    """(k1, k2, spans) of the rows with repeats; spans are byte ranges (a, b). ``named``: k1, k2, text."""
    key = ["h", "lo", "hi", "ctx"]
    # counts are written before they are joined: a join with its own exchange on both sides is
    # one whose large partitions Spark can split, and one anchor may hold a third of all rows
    every = work.put(contexts(named), "contexts")
    twice = work.put(every.groupBy("h").count().where("count > 1").select("h"), "twice")
    held = work.put(every.join(twice, "h"), "held")
    work.drop("contexts")
    same = held.groupBy(*key).agg(F.count("*").alias("n"), F.min(F.struct("k1", "k2", "p")).alias("at"))
    same = work.put(same, "same")
    group = same.groupBy("h").agg(F.count("*").alias("g"), F.sum(LENGTH + 1 + F.col("lo") - F.col("hi")).alias("letters"))
    group = work.put(group.where("g > 1"), "groups")
    open_groups = same.join(group, "h")
    wanted = open_groups.select("at.*", *key, "n", "letters").groupBy("k1", "k2").agg(F.collect_list(F.struct("p", *key, "n", "letters")).alias("w"))
    spots = named.join(wanted, ["k1", "k2"]).dropDuplicates(["k1", "k2"])
    # bytes of each wanted context, cut from the UTF-8 text
    raw = F.encode(F.coalesce("text", F.lit("")), "utf-8")
    cut = spots.select(raw.alias("raw"), F.explode("w").alias("c")).select(
        "c.*", F.expr("substring(raw, cast(c.p - c.lo + 1 as int), cast(c.lo - c.hi as int) + " + str(LENGTH) + ")").alias("bytes")
    )
    segments = work.put(cut.drop("p"), "segments")
    total = segments.where(F.col("letters") <= bucket).agg(F.sum(F.length("bytes") + 1)).first()[0] or 0
    n_buckets = max(1, -(-2 * total // bucket))
    fits = F.col("letters") <= bucket
    # large groups get buckets of their own, others share
    number = F.when(F.col("letters") * 8 > bucket, F.col("h")).otherwise(F.pmod(F.xxhash64("h"), F.lit(n_buckets)))
    shared = (F.col("letters") * 8 <= bucket).alias("shared")
    sorted_out = segments.where(fits).withColumn("bucket", number).withColumn("shared", shared).groupBy("shared", "bucket").applyInArrow(_sort_bucket, _FOUND)
    windows = segments.where(~fits).select(*key, "bytes").mapInArrow(_single_windows, "h long, lo short, hi short, ctx long, a int, w1 long, w2 long")
    again = windows.groupBy("w1", "w2").count().where("count > 1").select("w1", "w2")
    single = windows.join(again, ["w1", "w2"]).select(*key, "a", F.col("a").alias("b"))
    whole = same.where("n > 1").select(*key, F.lit(0).alias("a"), (F.col("lo") - F.col("hi")).cast("int").alias("b"))
    found = work.put(whole.unionByName(sorted_out).unionByName(single), "found")
    spans = held.join(found, key).select(
        "k1", "k2", F.struct((F.col("p") - F.col("lo") + F.col("a")).alias("a"), (F.col("p") - F.col("lo") + F.col("b") + LENGTH).alias("b")).alias("s")
    )
    return spans.groupBy("k1", "k2").agg(F.collect_set("s").alias("spans"))


def _keyed(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    own = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    return own.withColumn("k1", F.xxhash64("doc_id")).withColumn("k2", F.xxhash64("text"))


def remove_repeats(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", passages: DataFrame | None = None, **kw) -> DataFrame:
    """One row per document row: doc_id, n_bytes, n_removed, spans, kept (the remaining bytes).

    ``passages``: (k1, k2) of rows to be marked in a column more, ``passage``.
    """
    work = Workspace(docs.sparkSession, "suffix")
    named = _keyed(docs, doc_id, text)
    found = repeats(named.select("k1", "k2", "text"), work, **kw)
    if passages is not None:
        found = found.join(passages.select("k1", "k2", F.lit(True).alias("passage")), ["k1", "k2"], "full")
    else:
        found = found.withColumn("passage", F.lit(False))
    joined = named.join(work.put(found, "spans"), ["k1", "k2"], "left").select("doc_id", "text", "spans", F.coalesce("passage", F.lit(False)).alias("passage"))
    kind = named.schema["doc_id"].dataType
    out = joined.mapInArrow(_cut_out(kind), f"doc_id {kind.simpleString()}, n_bytes long, n_removed long, spans array<struct<a: bigint, b: bigint>>, kept binary, passage boolean")
    return out if passages is not None else out.drop("passage")


# --- passages of many words ---------------------------------------------------------------

WORDS, SEED = 51, 26  # over fifty words; the words of an anchor in them
_SPACE = np.zeros(256, bool)
_SPACE[[32, *range(9, 14)]] = True


def _words(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where words start and end in texts at[i] to at[i + 1]; none runs over the end of its text."""
    inside, edge = ~_SPACE[data], np.zeros(len(data) + 1, bool)
    edge[at] = True
    before, after = np.append(False, inside[:-1]), np.append(inside[1:], False)
    return np.flatnonzero(inside & (~before | edge[:-1])), np.flatnonzero(inside & (~after | edge[1:])) + 1


def _word_pieces(batch, piece: int):
    """(first row, word hashes, words of texts by offsets, word number of the piece) of a batch: k1, k2, text, ...

    Rows are taken together up to ``piece`` bytes; a longer text comes in pieces that share WORDS - 1 words.
    """
    data, at = utf8_parts(batch.column(2))
    i = 0
    while i < batch.num_rows:
        j = max(i + 1, int(np.searchsorted(at, at[i] + piece, side="right")) - 1)
        own, cut = data[at[i] : at[j]], at[i : j + 1] - at[i]
        start, end = _words(own, cut)
        w = 0
        while w < len(start):
            stop = len(start) if len(own) <= 2 * piece else int(np.searchsorted(start, start[w] + piece))
            last = min(len(start), stop + WORDS - 1) if stop < len(start) else stop
            base = int(start[w])
            letters = Hashes.of_bytes(own[base : end[last - 1]])
            a, b = start[w:last] - base, end[w:last] - base
            words = Hashes(last - w, lambda k, letters=letters, a=a, b=b: letters.of(a, b, k))
            yield i, words, np.searchsorted(start[w:last], cut) if stop == len(start) and w == 0 else np.asarray([0, last - w]), w
            w = stop
        i = j


def word_contexts(docs: DataFrame, piece: int = _PIECE) -> DataFrame:
    """(k1, k2, p, h, lo, hi) of every anchor of word windows: windows p - lo to p - hi. ``docs``: k1, k2, text."""

    def run(batches):
        for batch in batches:
            k1, k2 = (batch.column(c).to_numpy() for c in (0, 1))
            for i, words, cut, off in _word_pieces(batch, piece):
                found = anchors(words, int(cut[-1]), cut, WORDS, SEED)
                if found:
                    t, a, b, p, h, _ = found
                    cols = [k1[i:][t], k2[i:][t], p + off, h.view(np.int64), (p - a).astype(np.int16), (p - b).astype(np.int16)]
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in cols], names=["k1", "k2", "p", "h", "lo", "hi"])

    return docs.mapInArrow(run, "k1 long, k2 long, p long, h long, lo short, hi short")


def _window_hashes(piece: int):
    """(k1, k2, w1, w2) of the word windows that a row's list ``w`` of contexts names."""

    def run(batches):
        for batch in batches:
            k1, k2 = (batch.column(c).to_numpy() for c in (0, 1))
            wanted = [np.unique(np.concatenate([np.arange(c["p"] - c["lo"], c["p"] - c["hi"] + 1) for c in x])) for x in batch.column(3).to_pylist()]
            for i, words, cut, off in _word_pieces(batch, piece):
                for n in range(len(cut) - 1):
                    at = wanted[i + n] - off
                    at = at[(at >= 0) & (at + WORDS <= cut[n + 1] - cut[n])] + cut[n]
                    one, two = (words.of(at, at + WORDS, k).view(np.int64) for k in (0, 1))
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), k[i + n])) for k in (k1, k2)] + [pa.array(one), pa.array(two)], names=["k1", "k2", "w1", "w2"])

    return run


def shared_passages(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", piece: int = _PIECE) -> DataFrame:
    """(k1, k2) of rows that hold WORDS consecutive words which a row of another id holds as well.

    Words are runs without white space. As for bytes, anchors that occur in one text only cannot
    lie in such a passage; the windows of the others are counted by 128 bits of hash. Equal texts
    share all their windows and are recognised as such.
    """
    work = Workspace(docs.sparkSession, "passages")
    named = _keyed(docs, doc_id, text).select("k1", "k2", "text")
    every = work.put(word_contexts(named, piece), "contexts")
    several = lambda c: F.min(c) < F.max(c)
    copies = every.groupBy("k2").agg(several("k1").alias("s")).where("s").select("k2")
    rows = every.select("k1", "k2").distinct()
    held = work.put(every.groupBy("h").agg(several("k2").alias("s")).where("s").select("h"), "held")
    lists = every.join(held, "h").groupBy("k1", "k2").agg(F.collect_list(F.struct("p", "lo", "hi")).alias("w"))
    windows = work.put(named.join(lists, ["k1", "k2"]).select("k1", "k2", "text", "w").mapInArrow(_window_hashes(piece), "k1 long, k2 long, w1 long, w2 long"), "windows")
    met = work.put(windows.groupBy("w1", "w2").agg(several("k2").alias("s")).where("s").select("w1", "w2"), "met")
    return rows.join(work.put(copies, "copies"), "k2", "left_semi").select("k1", "k2").unionByName(windows.join(met, ["w1", "w2"], "left_semi").select("k1", "k2")).distinct()


def op2_suffix(spark, sf_dir: str) -> DataFrame:
    """The contract's digest of ``remove_repeats`` over whole documents.

    More columns: what is left, whether anything went, and whether the document shares a passage
    of over fifty words with another, which may have fewer than LENGTH bytes.
    """
    docs = read(spark, sf_dir, "documents", "doc_id", "text")
    done = remove_repeats(docs, passages=shared_passages(docs))
    return done.select(
        "doc_id", "n_bytes", "n_removed", F.coalesce(F.size("spans"), F.lit(0)).cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"),
        (F.col("n_bytes") - F.col("n_removed")).alias("n_kept"), (F.col("n_removed") > 0).alias("repeated"), F.col("passage").alias("shares_passage"),
    )
