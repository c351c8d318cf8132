"""Approximate nearest neighbours by multi-index hashing over learned rotated binary codes.

1. Largest inner product becomes smallest angle: a candidate gets one component more, so that
   all have the length of the longest; queries get a zero there.
2. Codes of ``BITS`` signs come from several rotations, each learned by iterative quantisation
   on at most ``SAMPLE`` vectors picked by a hash of their id. Every vector is indexed.
3. A query's Hamming radius follows from the angle of its k-th nearest among the sampled
   vectors: every true neighbour is at least as near, and its code differs in about
   BITS * angle / pi bits, plus ``MARGIN`` standard deviations. A query that finds fewer than
   k so searches again at a radius that holds every code.
4. In a cell (a shard of the index, a block of queries) the codes are split into ``PARTS``
   substrings, each indexed. A code within radius r agrees with the query's in some substring
   up to r div PARTS bits, so probing all substrings that near finds every code within r.
   Where the radius is so wide that probing would touch more entries than the shard has codes,
   the shard's codes are compared directly: the same set results.
5. Candidates within the radius are ranked by exact inner products in double precision; a
   cell returns k a query, and the best k of all cells are the result.

Equal vectors are indexed once with their k + 1 smallest ids, which is all that any result can
show of them, so large groups of copies cost nothing and ties come out exactly.

Defined results: vectors that are null, zero, of another length than most, or hold null or
non-finite components take no part, nor do rows with a null id; of rows that repeat an id the
one with the smallest vector counts; an empty table gives an empty table.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cuewright.llm.common import Workspace, read

K = 20
BITS = 256
PARTS = 16
MARGIN = 2.5
SAMPLE = 8192
SHARD = 16_384
BLOCK = 8192


def learn_rotations(x: np.ndarray, bits: int, rounds: int = 20, seed: int = 5) -> np.ndarray:
    """Directions (d x bits) of iterative quantisation from different random starts."""
    d, r = x.shape[1], np.random.default_rng(seed)
    vt = np.linalg.eigh(x.T @ x)[1].T[::-1]
    v, out = x @ vt.T, []
    while sum(m.shape[1] for m in out) < bits:
        rot, _ = np.linalg.qr(r.standard_normal((d, d)))
        for _ in range(rounds):
            u, _, wt = np.linalg.svd(np.where(v @ rot > 0, 1.0, -1.0).T @ v)
            rot = (u @ wt).T
        out.append(vt.T @ rot)
    return np.concatenate(out, axis=1)[:, :bits]


def to_codes(x: np.ndarray, directions: np.ndarray) -> np.ndarray:
    return np.packbits(x @ directions > 0, axis=1, bitorder="little")


def lift(x: np.ndarray, longest: float) -> np.ndarray:
    """One component more, so that all vectors have length 1."""
    more = np.sqrt(np.maximum(longest * longest - (x * x).sum(axis=1), 0))
    return np.column_stack([x, more]) / longest


def radius_of(angle: np.ndarray, bits: int) -> np.ndarray:
    p = angle / np.pi
    return np.minimum(np.ceil(bits * p + MARGIN * np.sqrt(bits * p * (1 - p)) + 1), bits).astype(np.int64)


class Shard:
    """A shard's codes with an index for each substring of 16 bits."""

    def __init__(self, codes: np.ndarray):
        self.words = codes.view(np.uint64)
        self.parts = codes.view(np.uint16)
        self.order = self.sorted = None

    def within(self, code: np.ndarray, radius: int) -> np.ndarray:
        """Indices of all codes within the radius."""
        n, m = self.parts.shape
        t = radius // m
        masks = probes(t) if t <= 4 else None
        if masks is None or m * len(masks) >= n:
            cand = np.arange(n)
        else:
            if self.order is None:
                self.order = np.argsort(self.parts, axis=0, kind="stable")
                self.sorted = np.take_along_axis(self.parts, self.order, axis=0)
            found = []
            for j in range(m):
                keys = code.view(np.uint16)[j] ^ masks
                a, b = np.searchsorted(self.sorted[:, j], keys), np.searchsorted(self.sorted[:, j], keys, side="right")
                found += [self.order[x:y, j] for x, y in zip(a[a < b], b[a < b], strict=True)]
            cand = np.unique(np.concatenate(found)) if found else np.zeros(0, np.int64)
        far = np.bitwise_count(self.words[cand] ^ code.view(np.uint64)).sum(axis=1, dtype=np.int64)
        return cand[far <= radius]


_PROBES: dict[int, np.ndarray] = {}


def probes(t: int) -> np.ndarray:
    """All 16-bit masks of at most t bits."""
    if t not in _PROBES:
        _PROBES[t] = np.asarray([sum(1 << i for i in c) for n in range(t + 1) for c in combinations(range(16), n)], np.uint16)
    return _PROBES[t]


def _matrix(column: pa.ChunkedArray, d: int) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(-1, d)


def _bytes(column, n: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(-1, n)


def usable(vectors: DataFrame, vec_id: str, embedding: str) -> DataFrame:
    """(id, v): one row for each id whose vector can take part, components as doubles."""
    v = F.col(embedding).cast("array<double>")
    own = vectors.select(F.col(vec_id).cast("long").alias("id"), v.alias("v")).where("id is not null and v is not null")
    fine = ~F.exists("v", lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf"))) & F.exists("v", lambda c: c != 0)
    # adding zero turns a negative zero into zero, so equal vectors are equal arrays
    return own.where(fine).groupBy("id").agg(F.min("v").alias("v")).withColumn("v", F.transform("v", lambda c: c + F.lit(0.0)))


def nearest(
    vectors: DataFrame, queries_of: str, *, vec_id: str = "vec_id", embedding: str = "embedding", k: int = K, bits: int = BITS, shard: int = SHARD, block: int = BLOCK
) -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest found of each query, its own row left out.

    ``queries_of``: SQL condition on column ``id`` that picks the queries.
    """
    spark = vectors.sparkSession
    work = Workspace(spark, "ann")
    rows = work.put(usable(vectors, vec_id, embedding), "vectors")
    sizes = rows.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").limit(1).collect()
    out = "query_id long, rank int, vec_id long, score double"
    if not sizes:
        return spark.createDataFrame([], out)
    d = sizes[0]["d"]
    rows = rows.where(F.size("v") == d)
    longest = rows.agg(F.max(F.aggregate("v", F.lit(0.0), lambda s, c: s + c * c))).first()[0] ** 0.5
    picked = rows.orderBy(F.xxhash64("id"), "id").limit(SAMPLE).toArrow()
    sample = lift(_matrix(picked.column("v"), d), longest)
    sample_ids = picked.column("id").to_numpy()
    held = spark.sparkContext.broadcast((sample, sample_ids, learn_rotations(sample, bits)))

    def index_codes(batches):
        directions = held.value[2]
        for b in batches:
            codes = to_codes(lift(_matrix(b.column(0), d), longest), directions)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array([c.tobytes() for c in codes], pa.binary())], names=["v", "ids", "code"])

    def query_codes(batches):
        known, known_ids, directions = held.value
        for big in batches:
            for at in range(0, big.num_rows, 512):
                b = big.slice(at, 512)
                q = _matrix(b.column(1), d)
                unit = np.column_stack([q / np.linalg.norm(q, axis=1, keepdims=True), np.zeros(len(q))])
                cos = unit @ known.T
                cos[b.column(0).to_numpy()[:, None] == known_ids[None, :]] = -1
                kth = -np.partition(-cos, k - 1, axis=1)[:, k - 1] if len(known) > k else np.full(len(q), -1.0)
                radius = radius_of(np.arccos(np.clip(kth, -1, 1)), bits)
                codes = to_codes(unit, directions)
                yield pa.RecordBatch.from_arrays(
                    [*b.columns, pa.array([c.tobytes() for c in codes], pa.binary()), pa.array(radius)], names=["id", "v", "code", "radius"]
                )

    first = F.row_number().over(Window.partitionBy("v").orderBy("id"))
    few = rows.withColumn("n", first).where(F.col("n") <= k + 1).groupBy("v").agg(F.array_sort(F.collect_list("id")).alias("ids"))
    index = work.put(few.mapInArrow(index_codes, "v array<double>, ids array<long>, code binary"), "index")
    queries = rows.where(queries_of)
    n_shards, n_blocks = -(-index.count() // shard), -(-queries.count() // block)
    if not n_blocks:
        return spark.createDataFrame([], out)
    queries = work.put(queries.mapInArrow(query_codes, "id long, v array<double>, code binary, radius long"), "queries")
    left = index.select(
        F.pmod(F.hash("code", "v"), F.lit(n_shards)).alias("shard"), F.explode(F.sequence(F.lit(0), F.lit(n_blocks - 1))).alias("block"), "v", "ids", "code"
    )

    def cells(asked: DataFrame) -> DataFrame:
        right = asked.select(
            F.explode(F.sequence(F.lit(0), F.lit(n_shards - 1))).alias("shard"), F.pmod(F.xxhash64("id"), F.lit(n_blocks)).cast("int").alias("block"), "id", "v", "code", "radius"
        )
        return left.groupBy("shard", "block").cogroup(right.groupBy("shard", "block")).applyInArrow(cell, "query_id long, vec_id long, score double")

    def cell(own: pa.Table, asked: pa.Table) -> pa.Table:
        rows_out: list[tuple[int, int, float]] = []
        if own.num_rows and asked.num_rows:
            x, ids = _matrix(own.column("v"), d), own.column("ids").to_pylist()
            table, codes, q = Shard(_bytes(own.column("code"), bits // 8)), _bytes(asked.column("code"), bits // 8), _matrix(asked.column("v"), d)
            for i, (qid, r) in enumerate(zip(asked.column("id").to_pylist(), asked.column("radius").to_pylist(), strict=True)):
                cand = table.within(codes[i], r)
                score = (x[cand] * q[i]).sum(axis=1)
                if len(cand) > k + 1:  # one of them may be the query itself alone
                    cut = np.partition(score, len(score) - k - 1)[len(score) - k - 1]
                    cand, score = cand[score >= cut], score[score >= cut]
                found = sorted((-s, v) for c, s in zip(cand.tolist(), score.tolist(), strict=True) for v in ids[c] if v != qid)
                rows_out += [(qid, v, -s) for s, v in found[:k]]
        a, b, c = zip(*rows_out, strict=True) if rows_out else ((), (), ())
        return pa.table({"query_id": pa.array(a, pa.int64()), "vec_id": pa.array(b, pa.int64()), "score": pa.array(c, pa.float64())})

    near = work.put(cells(queries), "near")
    # a query whose radius held fewer than k asks again, with every code within its radius
    served = near.groupBy(F.col("query_id").alias("id")).count().where(F.col("count") >= k).select("id")
    short = work.put(queries.join(served, "id", "left_anti").withColumn("radius", F.lit(bits).cast("long")), "short")
    if not short.isEmpty():
        near = near.join(short.select(F.col("id").alias("query_id")), "query_id", "left_anti").unionByName(cells(short))
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return near.withColumn("rank", place).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op3_ann(spark, sf_dir: str) -> DataFrame:
    """The contract's search of ``nearest`` over whole embeddings."""
    return nearest(read(spark, sf_dir, "embeddings", "vec_id", "embedding"), "id % 20 = 0")
