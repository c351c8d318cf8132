"""SimHash near-duplicates linked through vantage-point trees.

1. Fingerprints: 64-bit SimHash of word shingles, repeats included, computed in Arrow
   batches with a vectorised XXH64.
2. Distinct fingerprints are dealt to the leaves of a vantage-point tree. The tree is built
   on the driver from at most ``SAMPLE`` distinct fingerprints (it only decides how work is
   dealt, never which links exist). A node holds a vantage point and a distance bound; a
   fingerprint goes to the inner or outer side, and as a visitor to the other side too
   where the triangle bound |d - bound| allows a partner there. So each linked pair meets
   in the home leaf of one of them.
3. In a leaf a vantage-point recursion over numpy arrays prunes by the same bounds and
   compares what is left exactly. A leaf emits a spanning forest, never its pairs.
4. Forests are joined to components by alternating large-star and small-star rounds.

A leaf that no vantage point can split (one tight cluster) is dealt in tiles: its points in
tiles of bounded size, its visitors to each tile.

Defined results: a text without words (null, empty, blank) has fingerprint zero and is
linked like any other; repeated rows get equal results; an empty table gives an empty
table; rows with a null id take part, and ``component_id`` is the smallest id that is not
null, or null if there is none.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cuewright.llm.common import Workspace, append_column, free_name, read, utf8_parts

SHINGLE = 3
RADIUS = 3
SEED = 42
SAMPLE = 8192  # fingerprints that the dealing tree is built from
LEAF = 16384  # distinct fingerprints that a leaf is meant to hold

# XXH64's primes (fixed values)
_P1, _P2, _P3, _P4, _P5 = (
    np.uint64(x)
    for x in (
        11400714785074694791,
        14029467366897019727,
        1609587929392839161,
        9650029242287828579,
        2870177450012600261,
    )
)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A") : ord("Z") + 1] += 32
_SPREAD = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").view("<u8").ravel()
_BLANK = np.zeros(256, bool)
_BLANK[0x20] = _BLANK[0x09:0x0E] = True


def _rot(x: np.ndarray, k: int) -> np.ndarray:
    return (x << np.uint64(k)) | (x >> np.uint64(64 - k))


def _lanes(buf: np.ndarray, at: np.ndarray, size: int) -> np.ndarray:
    """Little-endian integers of ``size`` bytes at the offsets."""
    view = np.ndarray((len(buf) - size + 1,), f"<u{size}", buf, strides=(1,))
    return view[at].astype(np.uint64)


def xxh64_equal_length(buf: np.ndarray, at: np.ndarray, length: int, seed: int = SEED) -> np.ndarray:
    """XXH64 of buf[a : a + length] for each offset a."""
    s, pos = np.uint64(seed), at.copy()
    step = lambda acc, lane: _rot(acc + lane * _P2, 31) * _P1
    with np.errstate(over="ignore"):
        if length >= 32:
            v = [np.full(len(at), x, np.uint64) for x in (s + _P1 + _P2, s + _P2, s, s - _P1)]
            for _ in range(length // 32):
                for k in range(4):
                    v[k] = step(v[k], _lanes(buf, pos + 8 * k, 8))
                pos += 32
            acc = _rot(v[0], 1) + _rot(v[1], 7) + _rot(v[2], 12) + _rot(v[3], 18)
            for k in range(4):
                acc = (acc ^ step(np.uint64(0), v[k])) * _P1 + _P4
        else:
            acc = np.full(len(at), s + _P5, np.uint64)
        acc = acc + np.uint64(length)
        left = length % 32
        while left >= 8:
            acc = _rot(acc ^ step(np.uint64(0), _lanes(buf, pos, 8)), 27) * _P1 + _P4
            pos, left = pos + 8, left - 8
        if left >= 4:
            acc = _rot(acc ^ (_lanes(buf, pos, 4) * _P1), 23) * _P2 + _P3
            pos, left = pos + 4, left - 4
        while left:
            acc = _rot(acc ^ (buf[pos].astype(np.uint64) * _P5), 11) * _P1
            pos, left = pos + 1, left - 1
        acc = (acc ^ (acc >> np.uint64(33))) * _P2
        acc = (acc ^ (acc >> np.uint64(29))) * _P3
        return acc ^ (acc >> np.uint64(32))


def xxh64_ranges(buf: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """XXH64 of each byte range; ranges of one length are hashed together."""
    size = end - start
    small = len(size) and int(size.max()) < 1 << 16
    order = np.argsort(size.astype(np.uint16) if small else size, kind="stable")
    out = np.empty(len(start), np.uint64)
    cuts = np.flatnonzero(np.diff(size[order])) + 1
    for part in np.split(order, cuts) if len(order) else []:
        length = int(size[part[0]])
        if len(part) < 8:
            for i in part:
                out[i] = xxhash.xxh64_intdigest(buf[start[i] : end[i]].tobytes(), seed=SEED)
        else:
            out[part] = xxh64_equal_length(buf, start[part], length)
    return out


def fingerprints(data: np.ndarray, at: np.ndarray, shingle: int = SHINGLE) -> np.ndarray:
    """SimHash of each text; texts are data[at[i] : at[i + 1]]."""
    n = len(at) - 1
    # one blank before, between and after all texts; runs of blanks shrink to one
    buf = np.full(len(data) + n + 1, 0x20, np.uint8)
    buf[np.arange(len(data)) + np.repeat(np.arange(1, n + 1), np.diff(at))] = _LOWER[data]
    blank = _BLANK[buf]
    doc_end = at[1:] + np.arange(1, n + 1)  # the blank after each text
    keep = ~blank
    keep[1:] |= ~blank[:-1]
    shift = np.cumsum(keep)
    line = np.where(blank, np.uint8(0x20), buf)[keep]
    doc_end = shift[doc_end]
    edge = np.diff((line != 0x20).view(np.int8), prepend=np.int8(0), append=np.int8(0))
    start, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    words = np.diff(np.searchsorted(start, doc_end), prepend=0)
    first = np.cumsum(words) - words
    count = np.where(words == 0, 0, np.maximum(words - shingle + 1, 1))
    offset = np.cumsum(count) - count
    ix = np.arange(int(count.sum())) + np.repeat(first - offset, count)
    last = ix + np.repeat(np.minimum(words, shingle) - 1, count)
    h = xxh64_ranges(line, start[ix], end[last]) if len(ix) else np.zeros(0, np.uint64)
    out, some = np.zeros(n, np.uint64), np.flatnonzero(count)
    if len(some):
        # each byte of a hash becomes eight one-byte counters; at most 255 hashes are
        # added up before the counters are widened
        own = np.repeat(np.arange(len(some)), count[some])
        nth = np.arange(len(h)) - np.repeat(offset[some], count[some])
        cut = np.flatnonzero((nth % 255) == 0)
        part = np.add.reduceat(_SPREAD[h.astype("<u8").view(np.uint8).reshape(-1, 8)], cut, axis=0)
        ones = np.add.reduceat(part.view(np.uint8).astype(np.int64), np.searchsorted(own[cut], np.arange(len(some))), axis=0)
        packed = np.packbits(2 * ones > count[some][:, None], axis=1, bitorder="little")
        out[some] = np.ascontiguousarray(packed).view("<u8").ravel()
    return out


def with_fingerprint(docs: DataFrame, name: str, text: str = "text") -> DataFrame:
    """``docs`` with the fingerprint as a signed long."""

    def factory():
        def run(texts: pa.Array) -> pa.Array:
            # bounded working memory: at most about a million bytes of text at once
            data, at = utf8_parts(texts)
            out, i = [], 0
            while i < len(texts):
                j = max(i + 1, int(np.searchsorted(at, at[i] + (1 << 20), side="right")) - 1)
                out.append(fingerprints(data[at[i] : at[j]], at[i : j + 1] - at[i]))
                i = j
            return pa.array(np.concatenate(out).view(np.int64))

        return run

    return append_column(docs, name, T.LongType(), [text], factory)


# --- vantage-point trees ---------------------------------------------------------------


def grow(points: np.ndarray, weight: float, leaf: int, radius: int) -> dict:
    """The dealing tree. ``weight``: fingerprints that each sampled point stands for."""
    count = [0]

    def node(own: np.ndarray) -> dict:
        best = None
        if len(own) >= 16 and len(own) * weight > leaf:
            for v in own[:: max(1, len(own) // 16)][:16]:
                d = np.bitwise_count(own ^ v)
                mu = int(np.median(d))
                if mu == int(d.max()):
                    mu -= 1
                inner = int((d <= mu).sum())
                both = int(((d > mu - radius) & (d <= mu + radius)).sum())
                if 0 < inner < len(own) and (best is None or both < best[0]):
                    best = (both, v, mu, d)
        if best is None or best[0] > 0.9 * len(own):
            count[0] += 1
            return {"leaf": count[0] - 1, "tiles": max(1, round(len(own) * weight / leaf / 1.5))}
        _, v, mu, d = best
        return {"v": v, "mu": mu, "in": node(own[d <= mu]), "out": node(own[d > mu])}

    return node(points)


def deal(tree: dict, fps: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Index of a fingerprint, leaf, tile, and whether that leaf is its home."""
    parts: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]] = []

    def go(node: dict, ix: np.ndarray, home: np.ndarray) -> None:
        if not len(ix):
            return
        if "leaf" in node:
            k = node["tiles"]
            tile = (fps[ix] * _P1 >> np.uint64(40)).astype(np.int64) % k
            for t in range(k):
                stays = home & (tile == t)
                parts.append((ix, np.full(len(ix), node["leaf"]), np.full(len(ix), t), stays))
            return
        d = np.bitwise_count(fps[ix] ^ node["v"]).astype(np.int64)
        inner = d <= node["mu"]
        # a home pair that this node parts is met outside; a visitor may have partners on both sides
        to_in = inner | (~home & (d <= node["mu"] + radius))
        to_out = ~inner | (d > node["mu"] - radius)
        go(node["in"], ix[to_in], (home & inner)[to_in])
        go(node["out"], ix[to_out], (home & ~inner)[to_out])

    with np.errstate(over="ignore"):
        go(tree, np.arange(len(fps)), np.ones(len(fps), bool))
    if not parts:
        none = np.zeros(0, np.int64)
        return none, none, none, none.astype(bool)
    return tuple(np.concatenate(x) for x in zip(*parts, strict=True))


class Forest:
    """Smallest labels under unions that come as arrays of pairs."""

    def __init__(self, n: int):
        self.label = np.arange(n)

    def union(self, a: np.ndarray, b: np.ndarray) -> None:
        while True:
            x, y = self.label[a], self.label[b]
            differ = x != y
            if not differ.any():
                return
            a, b, x, y = a[differ], b[differ], x[differ], y[differ]
            np.minimum.at(self.label, np.maximum(x, y), np.minimum(x, y))
            while True:
                up = self.label[self.label]
                if (up == self.label).all():
                    break
                self.label = up


def near(all_fps: np.ndarray, points: np.ndarray, queries: np.ndarray, radius: int, forest: Forest) -> None:
    """Unite each query with the points within the radius (indices into ``all_fps``)."""
    if not len(points) or not len(queries):
        return
    if len(points) * len(queries) > 1 << 17:
        p, q = all_fps[points], all_fps[queries]
        v = p[len(p) // 2]
        dp, dq = np.bitwise_count(p ^ v).astype(np.int64), np.bitwise_count(q ^ v).astype(np.int64)
        mu = int(np.median(dp))
        if mu == int(dp.max()):
            mu -= 1
        inner = dp <= mu
        q_in, q_out = dq <= mu + radius, dq > mu - radius
        work = inner.sum() * q_in.sum() + (~inner).sum() * q_out.sum()
        if inner.any() and work < 0.95 * len(p) * len(q):
            near(all_fps, points[inner], queries[q_in], radius, forest)
            near(all_fps, points[~inner], queries[q_out], radius, forest)
            return
    p, rows = all_fps[points], max(1, (1 << 20) // len(points))
    for i in range(0, len(queries), rows):
        block = queries[i : i + rows]
        a, b = np.nonzero(np.bitwise_count(all_fps[block][:, None] ^ p[None, :]) <= radius)
        if len(a):
            forest.union(block[a], points[b])


def _leaf_links(radius: int):
    def run(group: pa.Table) -> pa.Table:
        fps, inv = np.unique(group.column("fp").to_numpy().view(np.uint64), return_inverse=True)
        home = np.zeros(len(fps), bool)
        home[inv[group.column("home").to_numpy(zero_copy_only=False)]] = True
        forest = Forest(len(fps))
        near(fps, np.flatnonzero(home), np.arange(len(fps)), radius, forest)
        linked = np.flatnonzero(forest.label != np.arange(len(fps)))
        return pa.table({"a": fps[forest.label[linked]].view(np.int64), "b": fps[linked].view(np.int64)})

    return run


def links(nodes: DataFrame, radius: int = RADIUS, *, sample: int = SAMPLE, leaf: int = LEAF) -> DataFrame:
    """Edges (a, b) that connect exactly the fingerprints that chains of links connect.

    ``nodes`` has the distinct fingerprints in column fp.
    """
    n = nodes.count()
    picked = nodes.orderBy(F.xxhash64("fp"), "fp").limit(sample).select("fp").toPandas()["fp"].to_numpy()
    tree = grow(picked.astype(np.int64).view(np.uint64), n / max(1, len(picked)), leaf, radius)

    def route(batches):
        for batch in batches:
            fps = batch.column(0).to_numpy().view(np.uint64)
            ix, at, tile, home = deal(tree, fps, radius)
            yield pa.RecordBatch.from_arrays(
                [pa.array(fps[ix].view(np.int64)), pa.array(at), pa.array(tile), pa.array(home)],
                names=["fp", "leaf", "tile", "home"],
            )

    dealt = nodes.select("fp").mapInArrow(route, "fp long, leaf long, tile long, home boolean")
    return dealt.groupBy("leaf", "tile").applyInArrow(_leaf_links(radius), "a long, b long")


def components(edges: DataFrame, work: Workspace) -> DataFrame:
    """(node, root) of every node that has an edge; root: the smallest node reachable.

    Large-star and small-star in turn until nothing changes; each round is written to the
    shared folder, and the round before it is deleted.
    """
    now = work.put(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "star0")
    mark = lambda df: tuple(df.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
    seen, k = mark(now), 0
    while seen[0]:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m"))
        large = (
            both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.least("u", "m").alias("v")).where("u <> v").distinct()
        )
        # every edge now points from the larger to the smaller node
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.*")
        k += 1
        now = work.put(small.where("u <> v").distinct(), f"star{k}")
        work.drop(f"star{k - 1}")
        was, seen = seen, mark(now)
        if was == seen:
            break
    roots = now.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return roots.unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())


def classes(prints: DataFrame, work: Workspace, radius: int = RADIUS, **kw) -> DataFrame:
    """(fp, root, component_id) of every distinct fingerprint of (doc_id, fp)."""
    nodes = work.put(prints.groupBy("fp").agg(F.min("doc_id").alias("doc_id")), "nodes")
    found = components(links(nodes, radius, **kw), work)
    rooted = nodes.join(found, nodes["fp"] == found["node"], "left").select("fp", F.coalesce("root", "fp").alias("root"), "doc_id")
    least = rooted.groupBy("root").agg(F.min("doc_id").alias("component_id"))
    return rooted.join(least, "root").select("fp", "root", "component_id")


def near_duplicates(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", radius: int = RADIUS, **kw) -> DataFrame:
    """One row per document row: doc_id, fingerprint (16 hex digits), component_id."""
    work = Workspace(docs.sparkSession, "simhash")
    named = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    prints = work.put(with_fingerprint(named, "fp").select("doc_id", "fp"), "prints")
    return (
        prints.join(classes(prints, work, radius, **kw), "fp")
        .select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
    )


def keep_one(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", radius: int = RADIUS, **kw) -> DataFrame:
    """``docs`` without near-duplicates: of each component the row with the smallest id stays.

    Ties of repeated ids go to the smallest fingerprint; of rows that repeat both, one stays.
    """
    work = Workspace(docs.sparkSession, "simhash")
    fp = free_name(docs, "fp")
    marked = with_fingerprint(docs, fp, text)
    prints = work.put(marked.select(F.col(doc_id).alias("doc_id"), F.col(fp).alias("fp")), "prints")
    rows = prints.join(classes(prints, work, radius, **kw), "fp")
    best = rows.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("no"), "doc_id", "fp")).alias("b"))
    best = best.select(F.col("b.doc_id").alias("__doc"), F.col("b.fp").alias("__fp"))
    kept = marked.join(best, marked[doc_id].eqNullSafe(best["__doc"]) & (marked[fp] == best["__fp"]), "left_semi")
    return kept.dropDuplicates([doc_id, fp]).drop(fp)


def op4_simhash(spark, sf_dir: str) -> DataFrame:
    """The contract's result of ``near_duplicates`` over whole documents."""
    return near_duplicates(read(spark, sf_dir, "documents", "doc_id", "text"))
