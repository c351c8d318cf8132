"""Balanced shards by Karmarkar-Karp differencing over indivisible groups of equal texts.

1. Rows are reduced to sizes and a group key (MD5 of the text). A group larger than a fair
   shard cannot stay whole in balanced shards: it alone is cut, into runs of rows of at most
   one share.
2. Groups are dealt to chunks of about ``CHUNK``. In a chunk, each group starts as a partial
   partition with one full shard; the two partial partitions with the largest spread are
   combined, one ordered up, the other down, until one is left.
3. Chunks' partial partitions are combined in the same way, ``FAN`` at a time, in a tree. No
   task sees more than ``CHUNK`` groups or ``FAN`` partial partitions.
4. A row's slot is a running count: rows before its chunk in the shard, before its group in
   the chunk, and before the row in the group.

Defined results: a null text counts as empty, size 16, crc 0; repeated rows are rows of one
group; an empty table gives an empty table; ties go by group key.
"""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cuewright.llm.common import Workspace, read

SHARDS = 40
OVERHEAD = 16
CHUNK = 10_000
FAN = 256


def difference(partials: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Karmarkar-Karp over partial partitions (arrays of k sums).

    Returns where bin j of partial i ends up, place[i, j], and the final sums.
    """
    k = len(partials[0])
    heap = [(-int(p.max() - p.min()), i) for i, p in enumerate(partials)]
    heapq.heapify(heap)
    sums = {i: p for i, p in enumerate(partials)}
    # moves[i] = (other, perm): bin j of i becomes bin perm[j] of the combined partition
    moves: dict[int, tuple[int, np.ndarray]] = {}
    nxt = len(partials)
    while len(heap) > 1:
        a, b = heapq.heappop(heap)[1], heapq.heappop(heap)[1]
        down, up = np.argsort(-sums[a], kind="stable"), np.argsort(sums[b], kind="stable")
        perm_a, perm_b = np.empty(k, np.int32), np.empty(k, np.int32)
        perm_a[down], perm_b[up] = np.arange(k), np.arange(k)
        moves[a], moves[b] = (nxt, perm_a), (nxt, perm_b)
        both = sums.pop(a)[down] + sums.pop(b)[up]
        sums[nxt] = both
        heapq.heappush(heap, (-int(both.max() - both.min()), nxt))
        nxt += 1
    last = heap[0][1]
    full = {last: np.arange(k)}
    for node in range(last - 1, -1, -1):
        parent, perm = moves[node]
        full[node] = full[parent][perm]
    return np.asarray([full[i] for i in range(len(partials))]), sums[last]


def _local(shards: int):
    def run(group: pa.Table) -> pa.Table:
        group = group.combine_chunks().sort_by([("bytes", "descending"), ("g", "ascending"), ("piece", "ascending")])
        size, rows = group.column("bytes").to_numpy(), group.column("n").to_numpy()
        n = len(size)
        alone = np.zeros((n, shards), np.int64)
        alone[:, 0] = size
        place, _ = difference(list(alone))
        own = place[:, 0]
        order = np.argsort(own, kind="stable")
        before = np.cumsum(rows[order]) - rows[order]
        first = np.searchsorted(own[order], np.arange(shards))
        offset = np.empty(n, np.int64)
        offset[order] = before - np.append(before, 0)[first][own[order]]
        return pa.table({"g": group.column("g"), "piece": group.column("piece"), "bytes": size, "n": rows,
                         "chunk": group.column("chunk"), "bin": own, "row0": offset})

    return run


def _merge(shards: int):
    def run(group: pa.Table) -> pa.Table:
        group = group.combine_chunks().sort_by("chunk")
        sums = [np.asarray(x, np.int64) for x in group.column("bytes").to_pylist()]
        place, _ = difference(sums)
        rows, size = np.zeros(shards, np.int64), np.zeros(shards, np.int64)
        at = []
        for p, n, s in zip(place, group.column("rows").to_pylist(), sums, strict=True):
            at.append(rows[p].tolist())
            rows[p] += np.asarray(n, np.int64)
            size[p] += s
        m = len(place)
        return pa.table({"chunk": group.column("chunk"), "up": group.column("up"), "place": pa.array(place.tolist(), pa.list_(pa.int64())),
                         "row0": pa.array(at, pa.list_(pa.int64())), "bytes": pa.array([size.tolist()] * m, pa.list_(pa.int64())),
                         "rows": pa.array([rows.tolist()] * m, pa.list_(pa.int64()))})

    return run


def shard(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", shards: int = SHARDS, overhead: int = OVERHEAD, chunk: int = CHUNK, fan: int = FAN) -> DataFrame:
    """One row per document row: doc_id, size, text_crc32, shard, slot."""
    work = Workspace(docs.sparkSession, "sharding")
    t = F.coalesce(F.col(text), F.lit(""))
    rows = work.put(
        docs.select(
            F.col(doc_id).alias("doc_id"),
            (F.octet_length(t).cast("long") + overhead).alias("size"),
            F.crc32(t).alias("text_crc32"),
            F.unhex(F.md5(t)).alias("g"),
            F.spark_partition_id().alias("part"),
        ),
        "rows",
    )
    out = ["doc_id", "size", "text_crc32", F.lit(0).alias("shard"), F.lit(0).cast("long").alias("slot")]
    total = rows.agg(F.sum("size")).first()[0]
    if total is None:
        return rows.select(*out)
    share = max(1, total // shards)
    per = rows.groupBy("g", "part").agg(F.count("*").alias("n"), F.max("size").alias("size"))
    starts = per.withColumn("start", F.sum("n").over(Window.partitionBy("g").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)))
    starts = starts.select("g", "part", F.coalesce("start", F.lit(0)).alias("start"))
    groups = per.groupBy("g").agg(F.sum("n").alias("n"), F.max("size").alias("size"))
    run = F.when(F.col("n") * F.col("size") > share, F.greatest(F.lit(1), F.expr(f"{share} div size"))).otherwise(F.col("n"))
    pieces = (
        groups.withColumn("run", run)
        .withColumn("piece", F.explode(F.expr("sequence(0L, (n - 1) div run)")))
        .withColumn("n", F.least(F.col("run"), F.col("n") - F.col("piece") * F.col("run")))
        .select("g", "piece", "run", "n", (F.col("n") * F.col("size")).alias("bytes"))
    )
    pieces = work.put(pieces, "pieces")
    n_chunks = -(-pieces.count() // chunk)
    local = work.put(
        pieces.select("g", "piece", "n", "bytes", F.pmod(F.xxhash64("g", "piece"), F.lit(n_chunks)).alias("chunk"))
        .groupBy("chunk")
        .applyInArrow(_local(shards), "g binary, piece long, bytes long, n long, chunk long, bin long, row0 long"),
        "local",
    )
    ends = F.array(*[F.sum(F.when(F.col("bin") == b, F.col("bytes")).otherwise(0)) for b in range(shards)])
    held = F.array(*[F.sum(F.when(F.col("bin") == b, F.col("n")).otherwise(0)) for b in range(shards)])
    level = local.groupBy("chunk").agg(ends.alias("bytes"), held.alias("rows"))
    kind = "chunk long, up long, place array<long>, row0 array<long>, bytes array<long>, rows array<long>"
    placed, k = local.select("g", "piece", "chunk", "bin", "row0"), 0
    while True:
        merged = work.put(level.withColumn("up", F.expr(f"chunk div {fan}")).groupBy("up").applyInArrow(_merge(shards), kind), f"level{k}")
        step = merged.select("chunk", "up", "place", F.col("row0").alias("base"))
        placed = placed.join(step, "chunk").select(
            "g", "piece", F.col("up").alias("chunk"), F.expr("place[cast(bin as int)]").alias("bin"), F.expr("row0 + base[cast(bin as int)]").alias("row0")
        )
        n_chunks = -(-n_chunks // fan)
        if n_chunks <= 1:
            break
        level = merged.dropDuplicates(["up"]).select(F.col("up").alias("chunk"), "bytes", "rows")
        k += 1
    # a group's place is put beside its count in each part of the input, so that rows meet it by
    # group and part, and no task holds all rows of a large group
    where = work.put(placed.join(pieces.select("g", "piece", "run"), ["g", "piece"]), "where")
    first = where.where("piece = 0").select("g", "run", "bin", "row0")
    beside = work.put(starts.join(first, "g"), "beside")
    nth = F.row_number().over(Window.partitionBy("g", "part").orderBy("doc_id")) - 1
    keyed = rows.withColumn("nth", nth).join(beside, ["g", "part"]).withColumn("nth", F.col("nth") + F.col("start"))
    cols = ["doc_id", "size", "text_crc32", F.col("bin").cast("int").alias("shard"), (F.col("row0") + F.col("nth") - F.col("piece") * F.col("run")).alias("slot")]
    whole = keyed.where("nth < run").withColumn("piece", F.lit(0)).select(*cols)
    if where.where("piece > 0").isEmpty():
        return whole
    # rows past the first run of a group that was cut meet their run by its number
    later = keyed.where("nth >= run").withColumn("piece", F.expr("nth div run")).drop("bin", "row0")
    return whole.unionByName(later.join(where.select("g", "piece", "bin", "row0"), ["g", "piece"]).select(*cols))


def op7_sharding(spark, sf_dir: str) -> DataFrame:
    """The contract's result of ``shard`` over whole documents, under the law ``bytes``."""
    done = shard(read(spark, sf_dir, "documents", "doc_id", "text"))
    return done.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
