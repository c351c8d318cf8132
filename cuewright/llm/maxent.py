"""Language-model scores from a hashed maximum-entropy model with class-factored softmax.

P(token | history) = P(class | history) * P(token | class). The first factor is a softmax
over classes whose logits add up hashed weights: a bias, the previous token (bigram), the two
previous tokens (trigram) and the one before the previous (skip). The second is a softmax
with unigram weights only, for which the counts are the optimum.

1. Every token of the training rows is counted on the cluster (tokens are named by 64-bit
   hashes). The ``HEAD`` most frequent have classes; all others form the class of rare
   tokens, whose counts stay in a distributed table, with one count for an unseen token.
2. The ``SIGNED`` most frequent tokens are clustered into classes by the frequent tokens next
   to them; the rest of the head goes to classes by frequency.
3. Training: in each round every task starts from the shared weights, makes adaptive gradient
   steps over its share of all training rows, and returns its weights; these are averaged,
   weighted by tokens, in blocks and in a tree of ``FAN`` messages each.
4. Scoring adds log probabilities in sparse numpy batches. Counts of rare tokens are joined
   by hash, after they were added up by row.

The table of hashed weights grows with the training tokens, by their cube root (``table_rows``):
a thousand times the tokens have ten times the rows. So it can be broadcast at every size: 10 MB at
30 GB of text, about 150 MB at 100 TB. The ``HEAD`` tokens broadcast beside it are of a fixed number.

Defined results: a null or blank text has one token, its end; with nothing to learn from,
every token has probability 1 in base and model (the formula with N = V = 0); repeated rows
get equal results; an empty table gives an empty table; a row with a null id counts as a
training row and is not held out.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cuewright.llm.common import Workspace, read, utf8_parts
from cuewright.llm.simhash import _BLANK, _LOWER, xxh64_ranges

HEAD = 1 << 17
SIGNED = 20_000
PIVOTS = 48
CLASSES = 48  # the last one is the class of rare tokens, the one before the frequent end of the unsigned
ROWS = 1 << 13  # weight rows at least
ROWS_A_ROOT = 32  # weight rows for each unit of the cube root of the training tokens
ROUNDS = 2
STEP = 0.3
TOKENS_A_TASK = 4_000_000
BLOCK = 512  # weight rows in a message
FAN = 64  # messages of one block averaged at once
END = np.uint64(0x9E3779B97F4A7C15)  # name of the end token (any fixed number does)
START = np.uint64(0xC2B2AE3D27D4EB4F)  # history before the first token
_MIX = np.uint64(0xFF51AFD7ED558CCD)


def tokens(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Token names of all texts, each followed by the end token, and tokens in each text."""
    data, at = utf8_parts(texts)
    # a blank after each text keeps words apart
    n = len(at) - 1
    buf = np.full(len(data) + n, 0x20, np.uint8)
    buf[np.arange(len(data)) + np.repeat(np.arange(n), np.diff(at))] = _LOWER[data]
    edge = np.diff((~_BLANK[buf]).view(np.int8), prepend=np.int8(0), append=np.int8(0))
    start, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    words = np.diff(np.searchsorted(start, at[1:] + np.arange(1, n + 1)), prepend=0)
    out = np.full(len(start) + n, END, np.uint64)
    out[np.arange(len(start)) + np.repeat(np.arange(n), words)] = xxh64_ranges(buf, start, end) if len(start) else 0
    return out, words + 1


def pieces(batches, column: int, size: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """Batches again, of about ``size`` bytes of text each (one row at least)."""
    for batch in batches:
        _, at = utf8_parts(batch.column(column))
        i = 0
        while i < batch.num_rows:
            j = max(i + 1, int(np.searchsorted(at, at[i] + size, side="right")) - 1)
            yield batch.slice(i, j - i)
            i = j


def count_tokens(texts: DataFrame) -> DataFrame:
    """(h, c) of all tokens of the one text column."""

    def run(batches):
        held: list[tuple[np.ndarray, np.ndarray]] = []

        def flush():
            h = np.concatenate([x for x, _ in held])
            c = np.concatenate([x for _, x in held])
            held.clear()
            u, inv = np.unique(h, return_inverse=True)
            return u, np.bincount(inv, weights=c, minlength=len(u)).astype(np.int64)

        def message(u, c):
            return pa.RecordBatch.from_arrays([pa.array(u.view(np.int64)), pa.array(c)], names=["h", "c"])

        waiting = 0
        for part in pieces(batches, 0):
            u, c = np.unique(tokens(part.column(0))[0], return_counts=True)
            held.append((u, c))
            waiting += len(u)
            if waiting > 1 << 20:
                held.append(flush())
                waiting = len(held[0][0])
                if waiting > 1 << 19:  # bounded memory: what is added up so far leaves
                    yield message(*held.pop())
                    waiting = 0
        if held:
            yield message(*flush())

    return texts.mapInArrow(run, "h long, c long").groupBy("h").agg(F.sum("c").alias("c"))


def history(seq: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The previous token and the one before it, ``START`` before a text's first."""
    first = np.cumsum(length) - length
    one, two = np.roll(seq, 1), np.roll(seq, 2)
    one[first] = START
    two[first] = START
    two[first[length > 1] + 1] = START
    return one, two


def table_rows(n_tokens: int) -> int:
    """Rows of the weight table for so many training tokens: whole blocks."""
    return BLOCK * -(-max(ROWS, int(ROWS_A_ROOT * n_tokens ** (1 / 3))) // BLOCK)


def features(one: np.ndarray, two: np.ndarray, size: int) -> list[np.ndarray]:
    """Rows, of ``size`` ones, of bigram, trigram and skip features; row 0 is the bias."""

    def row(x: np.ndarray, kind: int) -> np.ndarray:
        with np.errstate(over="ignore"):
            x = (x + np.uint64(kind)) * _MIX
            return 1 + ((x ^ (x >> np.uint64(33))) % np.uint64(size - 1)).astype(np.int64)

    with np.errstate(over="ignore"):
        return [row(one, 1), row(one * np.uint64(3) + two, 2), row(two, 3)]


class Head:
    """The frequent tokens: sorted names, counts and classes."""

    def __init__(self, names: np.ndarray, counts: np.ndarray):
        order = np.argsort(names)
        self.names, self.counts = names[order], counts[order]
        self.classes = np.zeros(len(names), np.int64)
        self.within = np.zeros(len(names))

    def find(self, seq: np.ndarray) -> np.ndarray:
        """Index of each token, -1 for rare ones."""
        if not len(self.names):
            return np.full(len(seq), -1)
        at = np.minimum(np.searchsorted(self.names, seq), len(self.names) - 1)
        return np.where(self.names[at] == seq, at, -1)

    def classify(self, classes: np.ndarray) -> None:
        self.classes = classes
        mass = np.bincount(classes, weights=self.counts, minlength=CLASSES)
        self.within = np.log10(self.counts / mass[classes])


def signatures(texts: DataFrame, head: Head) -> np.ndarray:
    """Of the most frequent tokens: how often each pivot stands before and after them."""
    spark = texts.sparkSession
    top = np.argsort(-head.counts, kind="stable")
    signed, pivot = np.full(len(top), -1), np.full(len(top), -1)
    signed[top[:SIGNED]] = np.arange(min(SIGNED, len(top)))
    pivot[top[:PIVOTS]] = np.arange(min(PIVOTS, len(top)))
    held = spark.sparkContext.broadcast((head, signed, pivot))
    wide = 2 * PIVOTS

    def run(batches):
        own, sign, piv = held.value
        total = np.zeros(SIGNED * wide, np.int64)
        for part in pieces(batches, 0, 1 << 22):  # each piece costs a pass over the counters
            seq, length = tokens(part.column(0))
            at = own.find(seq)
            s, p = np.where(at < 0, -1, sign[at]), np.where(at < 0, -1, piv[at])
            inside = np.ones(len(seq), bool)
            inside[np.cumsum(length) - length] = False  # the pair (previous, this) lies in one text
            a, b = np.flatnonzero(inside) - 1, np.flatnonzero(inside)
            for word, other, side in ((b, a, 0), (a, b, PIVOTS)):
                ok = (s[word] >= 0) & (p[other] >= 0)
                total += np.bincount(s[word][ok] * wide + p[other][ok] + side, minlength=SIGNED * wide)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], names=["cell", "c"])

    out = np.zeros(SIGNED * wide)
    for r in texts.mapInArrow(run, "cell long, c long").groupBy("cell").agg(F.sum("c").alias("c")).toArrow().to_batches():
        out[r.column(0).to_numpy()] = r.column(1).to_numpy()
    return out.reshape(SIGNED, wide)[: min(SIGNED, len(top))]


def cluster(sign: np.ndarray, weight: np.ndarray, k: int) -> np.ndarray:
    """Spherical k-means with fixed starts: the heaviest tokens farthest from one another."""
    x = np.sqrt(sign)
    x /= np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-9)
    centre, far = [x[0]], 1 - x @ x[0]
    for _ in range(min(k, len(x)) - 1):
        i = int(np.argmax(far * np.sqrt(weight)))
        centre.append(x[i])
        far = np.minimum(far, 1 - x @ x[i])
    c = np.asarray(centre)
    for _ in range(12):
        own = np.argmax(x @ c.T, axis=1)
        new = np.zeros_like(c)
        np.add.at(new, own, x * np.sqrt(weight)[:, None])
        norm = np.linalg.norm(new, axis=1, keepdims=True)
        c = np.where(norm > 0, new / np.maximum(norm, 1e-9), c)
    return np.argmax(x @ c.T, axis=1)


def logits(w: np.ndarray, rows: list[np.ndarray]) -> np.ndarray:
    """Class logits of one block of positions, the largest of each zero."""
    z = np.take(w, rows[0], axis=0, mode="clip")
    part = np.empty_like(z)
    for r in rows[1:]:
        z += np.take(w, r, axis=0, out=part, mode="clip")  # numpy buffers ``out`` in any other mode
    z += w[0]
    most = z
    while most.shape[1] > 1:  # by halves, which numpy compares faster than the few classes of a row
        half = most.shape[1] // 2
        most = np.concatenate([np.maximum(most[:, :half], most[:, half : 2 * half]), most[:, 2 * half :]], axis=1)
    z -= most
    return z


def add_rows(total: np.ndarray, rows: np.ndarray, z: np.ndarray) -> None:
    """``total[rows] += z`` in place, rows that repeat included, in the order of positions.

    Two floats are added as one complex number, at flat places: numpy does so without sorting the rows.
    """
    half = total.shape[1] // 2
    at = rows[:, None] * half + np.arange(half)
    np.add.at(total.view(np.complex64).reshape(-1), at.reshape(-1), z.view(np.complex64).reshape(-1))


def blocks(n: int, size: int = 4096) -> Iterator[slice]:
    """Positions in blocks whose working arrays stay in a core's cache."""
    return (slice(i, min(i + size, n)) for i in range(0, n, size))


def class_logs(w: np.ndarray, rows: list[np.ndarray], classes: np.ndarray) -> np.ndarray:
    """Log (base e) probability of the given class at each position."""
    out = np.empty(len(classes))
    for b in blocks(len(classes)):
        z = logits(w, [r[b] for r in rows])
        out[b] = z[np.arange(len(z)), classes[b]]
        np.exp(z, out=z)
        out[b] -= np.log(z @ np.ones(z.shape[1], z.dtype))
    return out


def stable_order(r: np.ndarray, size: int) -> np.ndarray:
    """Stable order of numbers below ``size``, by radix sorts of 16 bits."""
    order = np.argsort(r.astype(np.uint16), kind="stable")
    for shift in range(16, (size - 1).bit_length(), 16):
        order = order[np.argsort((r[order] >> shift).astype(np.uint16), kind="stable")]
    return order


def learn(w: np.ndarray, past: np.ndarray, rows: list[np.ndarray], classes: np.ndarray) -> None:
    """One adaptive gradient step over all positions, in place."""
    n, g = len(classes), np.zeros_like(w)
    ones = np.ones(w.shape[1], w.dtype)
    for b in blocks(n):
        own = [r[b] for r in rows]
        z = logits(w, own)
        np.exp(z, out=z)
        z /= (z @ ones)[:, None]
        z[np.arange(len(z)), classes[b]] -= 1
        g[0] += z.sum(axis=0)
        for r in own:
            add_rows(g, r, z)
    count = sum(np.bincount(r, minlength=len(w)) for r in rows)
    count[0] = n
    some = np.flatnonzero(count)
    s = g[some]
    s /= np.sqrt(count[some]).astype(np.float32)[:, None]
    seen = past[some]
    seen += s * s
    past[some] = seen
    seen += 1
    np.sqrt(seen, out=seen)
    s *= STEP
    s /= seen
    w[some] -= s


def train(texts: DataFrame, head: Head, n_tokens: int) -> np.ndarray:
    """Weights after ``ROUNDS`` rounds over all training texts."""
    spark = texts.sparkSession
    size = table_rows(n_tokens)
    w = np.zeros((size, CLASSES), np.float32)
    mass = np.bincount(head.classes, weights=head.counts, minlength=CLASSES)
    mass[CLASSES - 1] = max(0, n_tokens - int(head.counts.sum()))
    w[0] = np.log((mass + 1) / (mass.sum() + CLASSES))
    tasks = max(4, n_tokens // TOKENS_A_TASK)
    spread = texts.coalesce(tasks)
    for _ in range(ROUNDS):
        held = spark.sparkContext.broadcast((w, head))

        def run(batches, held=held):
            start, own = held.value
            now, past, n = start.copy(), np.zeros_like(start), 0
            for part in pieces(batches, 0, 1 << 19):
                seq, length = tokens(part.column(0))
                at = own.find(seq)
                classes = np.where(at < 0, CLASSES - 1, own.classes[at]) if len(own.names) else np.full(len(seq), CLASSES - 1)
                learn(now, past, features(*history(seq, length), size), classes)
                n += len(seq)
            if n:
                delta = (now - start).astype(np.float16)
                blocks = [delta[i : i + BLOCK].tobytes() for i in range(0, size, BLOCK)]
                k = len(blocks)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(range(k), pa.int32()), pa.array([TaskContext.get().partitionId()] * k, pa.int32()), pa.array([n] * k, pa.int64()), pa.array(blocks, pa.binary())],
                    names=["block", "part", "n", "delta"],
                )

        def average(group: pa.Table) -> pa.Table:
            n, part = group.column("n").to_numpy(), group.column("part").to_numpy()
            total = np.zeros(BLOCK * CLASSES)
            for i in np.argsort(part):  # in one order, so that a task run again gives the same sum
                raw = group.column("delta")[int(i)].as_py()
                total += n[i] / n.sum() * np.frombuffer(raw, np.float16 if len(raw) == 2 * len(total) else np.float32)
            mean = total.astype(np.float32).tobytes()
            return pa.table(
                {"block": group.column("block")[:1], "part": pa.array([part[0] // FAN], pa.int32()), "n": pa.array([n.sum()], pa.int64()), "delta": pa.array([mean], pa.binary())}
            )

        kinds = "block int, part int, n long, delta binary"
        sent = spread.mapInArrow(run, kinds)
        left = tasks
        while True:
            sent = sent.groupBy("block", F.floor(F.col("part") / FAN)).applyInArrow(average, kinds)
            left = -(-left // FAN)
            if left == 1:
                break
        w = w.copy()
        for r in sent.select("block", "delta").collect():
            i = r["block"] * BLOCK
            w[i : i + BLOCK] += np.frombuffer(r["delta"], np.float32).reshape(-1, CLASSES)
    return w


def is_held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % 7 == 2, F.lit(False))


def fit(texts: DataFrame, work: Workspace) -> tuple[DataFrame, Head, np.ndarray, int, int]:
    """Counts of all tokens, head, weights, N and V of the one text column."""
    vocab = work.put(count_tokens(texts), "vocab")
    n, v = vocab.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*")).first()
    top = vocab.orderBy(F.desc("c"), "h").limit(HEAD).toArrow()
    head = Head(top.column("h").to_numpy().view(np.uint64), top.column("c").to_numpy().astype(np.int64))
    if len(head.names):
        order = np.argsort(-head.counts, kind="stable")
        sign = signatures(texts, head)
        classes = np.empty(len(order), np.int64)
        classes[order[: len(sign)]] = cluster(sign, head.counts[order[: len(sign)]].astype(float), CLASSES - 3)
        rest = order[len(sign) :]
        classes[rest] = np.where(np.arange(len(rest)) < len(rest) // 4, CLASSES - 3, CLASSES - 2)
        head.classify(classes)
    return vocab, head, train(texts, head, n), n, v


def score(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document row: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score."""
    spark = docs.sparkSession
    work = Workspace(spark, "maxent")
    own = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"), is_held_out(F.col(doc_id)).alias("held_out"))
    vocab, head, w, n, v = fit(own.where("not held_out").select("text"), work)
    rare_mass = n - int(head.counts.sum()) + v - len(head.names) + 1
    held = spark.sparkContext.broadcast((head, w))
    base_unit, rare_unit = float(np.log10(n + v + 1)), float(np.log10(rare_mass))
    ln10 = float(np.log(10))

    def run(batches):
        top, weights = held.value
        log_c = np.log10(top.counts + 1.0)
        for part in pieces(batches, 1, 1 << 19):
            seq, length = tokens(part.column(1))
            at = top.find(seq)
            rare = at < 0
            if len(top.names):
                classes = np.where(rare, CLASSES - 1, top.classes[at])
                inside, base = np.where(rare, -rare_unit, top.within[at]), np.where(rare, 0.0, log_c[at])
            else:
                classes, inside, base = np.full(len(seq), CLASSES - 1), np.full(len(seq), -rare_unit), np.zeros(len(seq))
            logs = class_logs(weights, features(*history(seq, length), len(weights)), classes) if len(top.names) else np.zeros(len(seq))  # else a single class
            model = logs / ln10 + inside
            first = np.cumsum(length) - length
            which = np.repeat(np.arange(len(length)), length)[rare]
            h = seq[rare]
            order = np.lexsort((h, which))
            which, h = which[order], h[order]
            new = np.ones(len(h), bool)
            new[1:] = (which[1:] != which[:-1]) | (h[1:] != h[:-1])
            cut = np.flatnonzero(new)
            times = np.diff(np.append(cut, len(h)))
            offs = np.searchsorted(which[cut], np.arange(len(length) + 1)).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [
                    part.column(0),
                    part.column(2),
                    pa.array(length.astype(np.int64)),
                    pa.array(np.add.reduceat((~rare).astype(np.int64), first)),
                    pa.array(np.add.reduceat(base, first)),
                    pa.array(np.add.reduceat(model, first)),
                    pa.ListArray.from_arrays(pa.array(offs), pa.array(h[cut].view(np.int64))),
                    pa.ListArray.from_arrays(pa.array(offs), pa.array(times.astype(np.int32))),
                    part.column(3),
                ],
                names=["doc_id", "held_out", "n_tokens", "known", "base", "model", "h", "times", "row"],
            )

    kind = own.schema["doc_id"].dataType.simpleString()
    scored = work.put(
        own.withColumn("row", F.monotonically_increasing_id()).mapInArrow(
            run, f"doc_id {kind}, held_out boolean, n_tokens long, known long, base double, model double, h array<long>, times array<int>, row long"
        ),
        "scored",
    )
    rare = scored.select("row", F.explode(F.arrays_zip("h", "times")).alias("p")).select("row", F.col("p.h").alias("h"), F.col("p.times").alias("t"))
    sums = (
        rare.join(vocab, "h")
        .groupBy("row")
        .agg(F.sum(F.col("t") * F.log10(F.col("c") + 1.0)).alias("more"), F.sum("t").alias("seen"))
    )
    more = F.coalesce("more", F.lit(0.0))
    return scored.drop("h", "times").join(sums, "row", "left").select(
        "doc_id",
        "held_out",
        "n_tokens",
        (F.col("known") + F.coalesce("seen", F.lit(0))).alias("n_known"),
        F.lit(n).cast("long").alias("train_tokens"),
        (F.col("base") + more - F.col("n_tokens") * base_unit).alias("base_score"),
        (F.col("model") + more).alias("score"),
    )


def op8_maxent(spark, sf_dir: str) -> DataFrame:
    """The contract's result of ``score`` over whole documents."""
    return score(read(spark, sf_dir, "documents", "doc_id", "text"))
