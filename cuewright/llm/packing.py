"""Best-fit packing of tokenised documents by hierarchical residual packing.

1. Tasks tokenise their documents (ids, then an end id), cut the longer ones into pieces of
   ``capacity`` tokens, the first of which may be shorter, and best-fit pack every ``CHUNK``
   pieces, longest first. Bins with at most ``SLACK`` free tokens are final.
2. The other bins become items of the size that they use. They are dealt to groups of at
   most ``GROUP`` items, best-fit packed again, final bins leave, and what is still open
   goes to fewer groups, until one group has packed all of it or a round no longer shrinks
   what is open.
3. Pieces of final bins never move again; the others take their place from the small table
   of merged bins.

The first pass is written to the shared folder, so bin numbers hold when executors are lost.

Token ids are those of the ``tokenizers`` library for the vocabulary file. For texts of
characters below U+0250 they are computed by ``tiktoken`` from the same file, four times as
fast, with the same ids (tested); all others, and any that it refuses, go through
``tokenizers`` itself.

Defined results: a null text counts as empty and is one piece of one token, the end id; a
special token's string inside a text becomes the special id, as ``tokenizers`` does;
repeated rows are packed each for itself; an empty table gives an empty table.
"""

from __future__ import annotations

import json
import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cuewright.llm.common import Workspace, read

CAPACITY = 1024
END_ID = 2
SLACK = 4
CHUNK = 1 << 16
GROUP = 50_000
_FAST = re.compile("[^\x00-ɏ]")
# byte-level BPE's pattern (fixed value)
_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def _byte_of() -> dict[str, int]:
    """Characters by which byte-level BPE files write the 256 bytes."""
    shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


class Encoder:
    """ids(text) as an uint32 array, for a byte-level BPE file of the tokenizers library."""

    def __init__(self, path: str):
        import tiktoken
        from tokenizers import Tokenizer

        self.slow = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        byte_of = _byte_of()
        ranks = {bytes(byte_of[c] for c in k): v for k, v in spec["model"]["vocab"].items() if k not in special}
        self.fast = tiktoken.Encoding("file", pat_str=_PATTERN, mergeable_ranks=ranks, special_tokens=special)

    def ids(self, text: str) -> np.ndarray:
        if not _FAST.search(text):
            try:
                return self.fast.encode_to_numpy(text, allowed_special="all")
            except Exception as why:  # tiktoken raises ValueError or a Rust panic on a text that is too much for it
                if type(why).__name__ not in ("ValueError", "PanicException", "RuntimeError"):
                    raise
        return np.asarray(self.slow.encode(text, add_special_tokens=False).ids, np.uint32)


def cut(total: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of a document of ``total`` tokens."""
    rest = total % capacity or min(total, capacity)
    return [(0, rest)] + [(at, capacity) for at in range(rest, total, capacity)]


def best_fit(sizes: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Best fit, largest first: bin and offset of each item, and tokens used in each bin."""
    bins, offsets = np.empty(len(sizes), np.int64), np.empty(len(sizes), np.int64)
    room: list[list[int]] = [[] for _ in range(capacity + 1)]  # bins by free tokens
    some, used = 0, []  # some: bit r set where room[r] has a bin
    for i in np.argsort(-sizes, kind="stable").tolist():
        size = int(sizes[i])
        fits = some >> size
        if fits:
            free = size + (fits & -fits).bit_length() - 1
            b = room[free].pop()
            if not room[free]:
                some &= ~(1 << free)
        else:
            free, b = capacity, len(used)
            used.append(0)
        bins[i], offsets[i] = b, used[b]
        used[b] += size
        if free > size:
            room[free - size].append(b)
            some |= 1 << (free - size)
    return bins, offsets, np.asarray(used, np.int64)


_PLACED = "doc_id {}, piece int, start long, length long, ids_crc32 long, bin long, offset long, used long"


def place(docs: DataFrame, path: str, capacity: int, end_id: int) -> DataFrame:
    """Pieces with their place in bins packed task by task. ``docs``: doc_id, text."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches):
        encoder, task, done = Encoder(path), TaskContext.get().partitionId(), 0
        held: list[tuple] = []

        def flush():
            nonlocal done, held
            sizes = np.asarray([h[3] for h in held], np.int64)
            bins, offsets, used = best_fit(sizes, capacity)
            cols = [pa.array(list(c)) for c in zip(*held, strict=True)]
            number = bins + ((task << 33) + done)
            done, held = done + len(used), []
            table = [*cols[1:], pa.array(number), pa.array(offsets), pa.array(used[bins])]
            first = pa.array(cols[0].to_pylist(), id_type)
            return pa.RecordBatch.from_arrays([first, table[0].cast(pa.int32()), *table[1:]], names=names)

        names = ["doc_id", "piece", "start", "length", "ids_crc32", "bin", "offset", "used"]
        id_type = None
        for batch in batches:
            id_type = batch.column(0).type
            texts = batch.column(1)
            for i, doc in enumerate(batch.column(0).to_pylist()):
                ids = np.append(encoder.ids(texts[i].as_py() or ""), np.uint32(end_id)).astype("<u4")
                for k, (at, n) in enumerate(cut(len(ids), capacity)):
                    held.append((doc, k, at, n, zlib.crc32(ids[at : at + n].tobytes())))
                if len(held) >= CHUNK:
                    yield flush()
        if held:
            yield flush()

    return docs.mapInArrow(run, _PLACED.format(kind))


_ITEM = "bin long, used long, members array<struct<bin: bigint, shift: bigint>>"


def _merge(capacity: int):
    def run(group: pa.Table) -> pa.Table:
        group = group.combine_chunks().sort_by([("used", "descending"), ("bin", "ascending")])
        sizes = group.column("used").to_numpy()
        bins, offsets, used = best_fit(sizes, capacity)
        own, members = group.column("bin").to_pylist(), group.column("members").to_pylist()
        out: list[list[dict]] = [[] for _ in used]
        name: list[int | None] = [None] * len(used)
        for i, (b, at) in enumerate(zip(bins.tolist(), offsets.tolist(), strict=True)):
            name[b] = own[i] if name[b] is None else min(name[b], own[i])
            out[b] += [{"bin": m["bin"], "shift": m["shift"] + at} for m in members[i]]
        return pa.table(
            {
                "bin": pa.array(name, pa.int64()),
                "used": pa.array(used),
                "members": pa.array(out, pa.list_(pa.struct([("bin", pa.int64()), ("shift", pa.int64())]))),
            }
        )

    return run


def merge_open(placed: DataFrame, work: Workspace, capacity: int, slack: int, group: int) -> DataFrame:
    """(bin, sequence_id, shift) of every bin that the first pass left open."""
    items = (
        placed.where(F.col("used") < capacity - slack)
        .groupBy("bin")
        .agg(F.max("used").alias("used"))
        .withColumn("members", F.array(F.struct("bin", F.lit(0).cast("long").alias("shift"))))
    )
    open_bins, k, final = work.put(items, "open0"), 0, []
    n = open_bins.count()
    while n:
        groups = -(-n // group)
        dealt = open_bins.withColumn("g", F.pmod(F.xxhash64("bin", F.lit(k)), F.lit(groups)))
        merged = work.put(dealt.groupBy("g").applyInArrow(_merge(capacity), _ITEM), f"open{k + 1}")
        left = merged.where(F.col("used") < capacity - slack)
        m, k = left.count(), k + 1
        # bins meet others in every round, until one task holds all of them or none fits another
        if groups == 1 or m == n:
            final.append(merged)
            break
        final.append(merged.where(F.col("used") >= capacity - slack))
        open_bins, n = left, m
    if not final:
        return items.select("bin", F.col("bin").alias("sequence_id"), F.lit(0).cast("long").alias("shift"))
    out = final[0]
    for more in final[1:]:
        out = out.unionByName(more)
    return out.select(F.col("bin").alias("sequence_id"), F.explode("members").alias("m")).select("m.bin", "sequence_id", "m.shift")


def pack(
    docs: DataFrame,
    path: str,
    *,
    doc_id: str = "doc_id",
    text: str = "text",
    capacity: int = CAPACITY,
    end_id: int = END_ID,
    slack: int = SLACK,
    group: int = GROUP,
) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    ``path``: the vocabulary file, readable under that name by every executor.
    """
    work = Workspace(docs.sparkSession, "packing")
    named = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    placed = work.put(place(named, path, capacity, end_id), "placed")
    moved = merge_open(placed, work, capacity, slack, group)
    cols = ["doc_id", "piece", "start", "length", "ids_crc32"]
    still = placed.where(F.col("used") >= capacity - slack).select(*cols, F.col("bin").alias("sequence_id"), "offset")
    again = (
        placed.where(F.col("used") < capacity - slack)
        .join(moved, "bin")
        .select(*cols, "sequence_id", (F.col("offset") + F.col("shift")).alias("offset"))
    )
    return still.unionByName(again)


def op10_packing(spark, sf_dir: str) -> DataFrame:
    """The contract's result of ``pack`` over whole documents."""
    import public_tokenizers

    return pack(read(spark, sf_dir, "documents", "doc_id", "text"), public_tokenizers.path("byte_bpe_50k.json"))
