"""Personal data: base patterns, and a linear-chain conditional random field over word shapes.

Base kinds are found by linear-time scanners with the leftmost non-overlapping semantics of
their patterns. The field labels every white-space token of every text with O or the
beginning or inside of an email, ip, card or phone; it finds forms that the patterns miss,
such as ``743-555-3824`` or ``name at host dot com``. Decoded spans that touch no base span
are added under their kind.

Features of a token are its word shape (which of letters, digits and marks it is made of, how
many digits, its length class) and whether it is one of a few cue words; those of its
neighbours count too. All are packed into one small shape code, so the score of a token is
the sum of three table rows. Every line is one chain, decoded whole by Viterbi in numpy: blocks
of its tokens run side by side, and scores are carried from block to block.

The field is trained by gradient descent on the exact likelihood of a small labelled table,
``labelled()``, made from templates by a fixed random seed.

Defined results: a null text counts as empty and has no spans; repeated rows get equal
results; an empty table gives an empty table. Positions are code points, end exclusive.
"""

from __future__ import annotations

import functools
import random
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cuewright.llm.common import append_column, read

KINDS = ("email", "ip", "card", "phone")
BLOCK = 96  # tokens decoded side by side; no bound on a chain
LABELS = 1 + 2 * len(KINDS)  # O, then B and I of each kind

# --- base patterns ---------------------------------------------------------------------

_LOCAL_END = re.compile(r"[A-Za-z0-9._%+-]+\Z")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_NO_DIGIT = re.compile("[^0-9]")


def emails(text: str) -> list[tuple[int, int]]:
    out, done, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        m = _DOMAIN.match(text, at + 1) if start < at else None
        if m:
            done = m.end()
            out.append((start, done))
        else:
            done = max(done, at + 1)  # nothing before this sign can begin a match any more
        at = text.find("@", done)
    return out


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(map(int, reversed(digits))):
        total += d if i % 2 == 0 else d * 2 - 9 * (d > 4)
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the base kinds, sorted."""
    out = [(a, 0, b) for a, b in emails(text)] if "@" in text else []
    # a match ends at the end of a run of digits, so the next one starts at the start of a run
    for m in _IP.finditer(text):
        if all(int(p[-4:]) <= 255 and len(p.lstrip("0")) <= 3 for p in m[0].split(".")):
            out.append((m.start(), 1, m.end()))
    for m in _CARD.finditer(text):
        digits = _NO_DIGIT.sub("", m[0])
        if 12 <= len(digits) <= 19 and luhn(digits):
            out.append((m.start(), 2, m.end()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 9 <= len(_NO_DIGIT.sub("", m[0])) <= 15:
                out.append((m.start(), 3, m.end()))
    return sorted(out)


# --- word shapes -----------------------------------------------------------------------

# cue words of spelt-out forms (fixed values)
_CUES = {"at": 1, "(at)": 1, "[at]": 1, "dot": 2, "(dot)": 2, "[dot]": 2}
SHAPES = 4096
_KIND_OF = np.zeros(256, np.uint8)  # 1 letter, 2 digit, 4 @, 8 ., 16 - or /, 32 ( ) +, 64 other
_KIND_OF[:] = 64
for _c in range(256):
    if chr(_c).isascii() and chr(_c).isalpha() or _c >= 128:
        _KIND_OF[_c] = 1
    elif 48 <= _c <= 57:
        _KIND_OF[_c] = 2
_KIND_OF[ord("@")] = 4
_KIND_OF[ord(".")] = 8
_KIND_OF[[ord("-"), ord("/")]] = 16
_KIND_OF[[ord("("), ord(")"), ord("+")]] = 32
_SPACE = np.zeros(256, bool)
_SPACE[0x20] = _SPACE[0x09:0x0E] = True
_CUE_BYTES = {k.encode(): v for k, v in _CUES.items()}
_LONGEST_CUE = max(map(len, _CUE_BYTES))


def tokens_of(data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and shape code of every white-space token of UTF-8 bytes."""
    edge = np.diff((~_SPACE[data]).view(np.int8), prepend=np.int8(0), append=np.int8(0))
    start, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    if not len(start):
        return start, end, np.zeros(0, np.int64)
    kind = _KIND_OF[data]
    mask = np.bitwise_or.reduceat(kind, start).astype(np.int64)  # blanks after a token add 64
    digit = np.concatenate([[0], np.cumsum(kind == 2)])
    digits = digit[end] - digit[start]
    other = np.concatenate([[0], np.cumsum((kind == 64) & ~_SPACE[data])])
    has_other = (other[end] - other[start] > 0).astype(np.int64)
    mask = (mask & 63) | has_other << 6
    size = end - start
    count = np.searchsorted([1, 2, 3, 4, 5, 7, 9], digits, side="right")  # 0..7
    code = mask + 128 * count
    plain = ((mask & ~64) == 1) | (size <= 5)
    cue = np.zeros(len(start), np.int64)
    for word, value in _CUE_BYTES.items():
        fits = np.flatnonzero(plain & (size == len(word)))
        if len(fits):
            same = np.ones(len(fits), bool)
            for i, ch in enumerate(word):
                same &= data[start[fits] + i] == ch
            cue[fits[same]] = value
    return start, end, code + 1024 * cue


def chains_of(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Indices of the first token of each chain, that is, of each line with tokens."""
    if not len(start):
        return start
    breaks = np.concatenate([[0], np.cumsum((data == 0x0A) | (data == 0))])
    return np.flatnonzero(np.diff(breaks[start], prepend=-1))


# --- the field -------------------------------------------------------------------------


def neighbours(shape: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Shape codes of the token, the one before and the one after it in its chain (0: none)."""
    before, after = np.roll(shape, 1) + SHAPES, np.roll(shape, -1) + 2 * SHAPES
    before[first] = SHAPES * 3
    after[np.append(first[1:], len(shape)) - 1] = SHAPES * 3 + 1
    return np.stack([shape, before, after])


class Field:
    """Weights of a linear-chain conditional random field."""

    def __init__(self):
        self.unary = np.zeros((SHAPES * 3 + 2, LABELS))
        self.pair = np.zeros((LABELS, LABELS))
        self.begin = np.zeros(LABELS)
        self.allowed = np.zeros((LABELS, LABELS))
        inside = np.arange(2, LABELS, 2)
        self.allowed[:, inside] = -1e4
        for i in inside:
            self.allowed[i, i] = self.allowed[i - 1, i] = 0
        self.first_ok = np.zeros(LABELS)
        self.first_ok[inside] = -1e4

    def scores(self, shape: np.ndarray, first: np.ndarray) -> np.ndarray:
        around = neighbours(shape, first)
        return self.unary[around[0]] + self.unary[around[1]] + self.unary[around[2]]

    def decode(self, shape: np.ndarray, first: np.ndarray) -> np.ndarray:
        """Viterbi labels of all tokens; chains start at ``first`` and are decoded whole.

        Blocks of ``BLOCK`` tokens run side by side. A block inside a chain starts from a guess
        at first; once the block before it has ended, it runs again from that block's scores,
        until these differ from its old ones by a constant, which leaves the rest as it is.
        """
        labels = np.zeros(len(shape), np.int64)
        if not len(shape):
            return labels
        around = neighbours(shape, first)
        best = self.unary[around[0]] + self.unary[around[1]] + self.unary[around[2]]  # emissions, then scores
        back = np.zeros((len(shape), LABELS), np.int8)
        step = self.pair + self.allowed
        size = np.diff(np.append(first, len(shape)))
        more = -(-size // BLOCK)
        begin = np.repeat(first, more) + BLOCK * (np.arange(int(more.sum())) - np.repeat(np.cumsum(more) - more, more))
        count = np.diff(np.append(begin, len(shape)))
        inner = np.ones(len(begin), bool)
        inner[np.cumsum(more) - more] = False
        best[first] += self.begin + self.first_ok
        order = np.argsort(count, kind="stable")
        groups = np.array_split(order, max(1, len(order) // 256))
        for part in groups:
            part = part[::-1]  # long ones first, so that live ones lead
            at, n = begin[part], count[part]
            for t in range(1, int(n[0])):
                i = at[: int(np.searchsorted(-n, -t))] + t
                cand = best[i - 1][:, :, None] + step
                back[i] = cand.argmax(axis=1)
                best[i] += cand.max(axis=1)
        todo = np.flatnonzero(inner)
        while len(todo):
            i, stop, block = begin[todo], begin[todo] + count[todo], todo
            prev = best[i - 1]
            ended = []
            while len(i):
                cand = prev[:, :, None] + step
                back[i] = cand.argmax(axis=1)
                now = cand.max(axis=1) + self.unary[around[0][i]] + self.unary[around[1][i]] + self.unary[around[2][i]]
                apart = now - best[i]
                best[i] = now
                going = np.ptp(apart, axis=1) > 1e-9
                i = i + 1
                at_end = going & (i == stop)
                ended.append(block[at_end] + 1)  # the block after it, if of the same chain, started from other scores
                going &= ~at_end
                i, stop, block, prev = i[going], stop[going], block[going], now[going]
            after = np.sort(np.concatenate(ended))
            after = after[after < len(begin)]
            todo = after[inner[after]]
        # the label before each block by the label at its end
        source = np.zeros((len(begin), LABELS), np.int64)
        for part in groups:
            part = part[inner[part]][::-1]
            if len(part):
                at, n = begin[part], count[part]
                maps = np.tile(np.arange(LABELS), (len(part), 1))
                for t in range(int(n[0]) - 1, -1, -1):
                    live = int(np.searchsorted(-n, -t))
                    maps[:live] = np.take_along_axis(back[at[:live] + t], maps[:live], axis=1)
                source[part] = maps
        last = best[begin + count - 1].argmax(axis=1)
        for b in np.flatnonzero(inner)[::-1].tolist():
            last[b - 1] = source[b, last[b]]
        for part in groups:
            part = part[::-1]
            at, n, now = begin[part], count[part], last[part]
            for t in range(int(n[0]) - 1, -1, -1):
                live = int(np.searchsorted(-n, -t))
                i = at[:live] + t
                labels[i] = now[:live]
                if t:
                    now[:live] = back[i, now[:live]]
        return labels

    def train(self, rows: list[tuple[np.ndarray, np.ndarray]], steps: int = 150, rate: float = 0.3, keep: float = 1e-3) -> None:
        """Adaptive gradient ascent on the exact log likelihood with an L2 prior.

        A shape's weights are sums over its parts (marks, number of digits, cue), so unseen
        combinations have weights too; the sums are stored as one table row for decoding.
        """
        code = np.arange(SHAPES)
        parts = [np.eye(n)[v].T for n, v in ((128, code & 127), (8, code >> 7 & 7), (4, code >> 10))]
        weights = [np.zeros((3, len(m), LABELS)) for m in parts] + [np.zeros((2, LABELS)), self.pair, self.begin]
        past = [np.zeros_like(w) for w in weights]
        n = np.asarray([len(shape) for shape, _ in rows])
        longest, count, own = int(n.max()), len(rows), np.arange(len(rows))
        live = np.arange(longest) < n[:, None]
        around = np.full((3, count, longest), SHAPES * 3)
        gold = np.zeros((count, longest), np.int64)
        for i, (shape, labels) in enumerate(rows):
            around[:, i, : n[i]] = neighbours(shape, np.zeros(1, np.int64))
            gold[i, : n[i]] = labels
        flat = [a[live] for a in around]
        for _ in range(steps):
            self.unary[: SHAPES * 3] = sum((m.T @ w).reshape(-1, LABELS) for m, w in zip(parts, weights[:3], strict=True))
            self.unary[SHAPES * 3 :] = weights[3]
            step = self.pair + self.allowed
            emit = self.unary[around].sum(axis=0)
            fore, rear = np.zeros((count, longest, LABELS)), np.zeros((count, longest, LABELS))
            fore[:, 0] = emit[:, 0] + self.begin + self.first_ok
            for t in range(1, longest):
                fore[:, t] = np.logaddexp.reduce(fore[:, t - 1, :, None] + step, axis=1) + emit[:, t]
            for t in range(longest - 2, -1, -1):
                back = np.logaddexp.reduce(step + (emit[:, t + 1] + rear[:, t + 1])[:, None, :], axis=2)
                rear[:, t] = np.where(live[:, t + 1, None], back, 0)
            z = np.logaddexp.reduce(fore[own, n - 1], axis=1)
            node = -np.exp(fore + rear - z[:, None, None])
            node[own[:, None], np.arange(longest), gold] += 1
            g_u = np.zeros_like(self.unary)
            for a in flat:
                np.add.at(g_u, a, node[live])
            both = live[:, 1:]
            edge = fore[:, :-1, :, None] + step + (emit[:, 1:] + rear[:, 1:])[:, :, None, :] - z[:, None, None, None]
            g_p = -np.exp(edge[both]).sum(axis=0)
            np.add.at(g_p, (gold[:, :-1][both], gold[:, 1:][both]), 1)
            by_shape = g_u[: SHAPES * 3].reshape(3, SHAPES, LABELS)
            grads = [m @ by_shape for m in parts] + [g_u[SHAPES * 3 :], g_p, node[:, 0].sum(axis=0)]
            for w, g, p in zip(weights, grads, past, strict=True):
                g = g / count - keep * w
                p += g * g
                w += rate * g / np.sqrt(p + 1e-8)


# --- training table --------------------------------------------------------------------

_PLAIN = "the of and to house river small under 3 12 1999 2024 v2 4.0 (12) 50% 7,5 a-b and/or x=3 well-known 1. 2) at dot said".split()
_NAMES = "anna bob carla dieter eva frank greta hugo".split()
_HOSTS = "mail example host web server".split()


def _digits(r: random.Random, n: int) -> str:
    return "".join(r.choice("0123456789") for _ in range(n))


def _form(r: random.Random, kind: int) -> str:
    name, host, top = r.choice(_NAMES), r.choice(_HOSTS), r.choice(["com", "org", "net", "de"])
    a, b, c = _digits(r, 3), _digits(r, 3), _digits(r, 4)
    if kind == 0:
        at, dot = r.choice([("at", "dot"), ("(at)", "(dot)"), ("[at]", "[dot]"), ("@", ".")])
        return f"{name}{r.choice(['', _digits(r, 2)])}@{host}.{top}" if at == "@" else f"{name} {at} {host} {dot} {top}"
    if kind == 1:
        return ".".join(str(r.randint(0, 255)) for _ in range(4))
    if kind == 2:
        d = [_digits(r, 4) for _ in range(4)]
        return r.choice(["-", ".", " "]).join(d) if r.random() < 0.8 else "".join(d)
    return r.choice([f"{a}-{b}-{c}", f"({a}) {b}-{c}", f"+1 ({a}) {b}-{c}", f"{a}.{b}.{c}", f"1-{a}-{b}-{c}", f"+49 {a} {b}{c}"])


def labelled(n: int = 300, seed: int = 7) -> list[tuple[list[str], list[int]]]:
    """The labelled table: token lists with their labels."""
    r, out = random.Random(seed), []
    for i in range(n):
        words, labels = [], []
        for _ in range(r.randint(1, 3)):
            for _ in range(r.randint(0, 6)):
                plain = r.choice(_PLAIN) if r.random() < 0.5 else "".join(r.choice("aeioutnrslhé") for _ in range(r.randint(2, 9)))
                words.append(plain + r.choice(["", "", "", ",", "."]))
                labels.append(0)
            if i % 3:
                kind = r.randrange(len(KINDS))
                parts = _form(r, kind).split(" ")
                words += parts
                labels += [1 + 2 * kind] + [2 + 2 * kind] * (len(parts) - 1)
        if words:
            out.append((words, labels))
    return out


@functools.lru_cache(maxsize=1)
def field() -> Field:
    """The field trained on ``labelled()``."""
    own = Field()
    rows = []
    for words, labels in labelled():
        _, _, shape = tokens_of(np.frombuffer(" ".join(words).encode(), np.uint8))
        rows.append((shape, np.asarray(labels)))
    own.train(rows)
    return own


# --- the operator ----------------------------------------------------------------------

_TRIM = ",;:!?\"'*#$%&<>=_`~|{}"


def model_spans(own: Field, texts: list[str]) -> list[list[tuple[int, int, int]]]:
    """Decoded (start, kind, end) of each text."""
    raw = [t.encode() for t in texts]
    data = np.frombuffer(b"\n".join(raw), np.uint8)
    at = np.cumsum([0] + [len(x) + 1 for x in raw])
    start, end, shape = tokens_of(data)
    labels = own.decode(shape, chains_of(data, start, end))
    out: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    begin = np.flatnonzero((labels > 0) & (labels % 2 == 1))
    for i in begin.tolist():
        kind, j = (int(labels[i]) - 1) // 2, i + 1
        while j < len(labels) and labels[j] == labels[i] + 1:
            j += 1
        doc = int(np.searchsorted(at, start[i], side="right")) - 1
        head = raw[doc][: start[i] - at[doc]].decode()
        body = raw[doc][start[i] - at[doc] : end[j - 1] - at[doc]].decode()
        a = len(head) + len(body) - len(body.lstrip(_TRIM))
        b = len(head) + len(body.rstrip(_TRIM + "."))
        if plausible(kind, body) and a < b:
            out[doc].append((a, kind, b))
    return out


_SPELT = re.compile(r"[A-Za-z0-9._%+-]+ +(?:at|\(at\)|\[at\]) +[A-Za-z0-9-]+(?: +(?:dot|\(dot\)|\[dot\]) +[A-Za-z0-9-]+)+\Z")


def plausible(kind: int, body: str) -> bool:
    """The kinds' own bounds: a decoded span must hold as many digits or words as its kind has."""
    digits = _NO_DIGIT.sub("", body)
    if kind == 0:
        return bool(_SPELT.match(body.strip(_TRIM + ".")))
    if kind == 1:
        parts = re.findall("[0-9]+", body)
        return len(parts) == 4 and all(len(p) <= 3 and int(p) <= 255 for p in parts)
    if kind == 2:
        return 12 <= len(digits) <= 19 and luhn(digits)
    return 9 <= len(digits) <= 15


SPAN = T.StructType([T.StructField("start", T.LongType()), T.StructField("kind", T.IntegerType()), T.StructField("end", T.LongType())])
FOUND = T.StructType([T.StructField("base", T.ArrayType(SPAN)), T.StructField("spans", T.ArrayType(SPAN))])


def annotate(docs: DataFrame, name: str = "personal", text: str = "text") -> DataFrame:
    """``docs`` with a struct column: base and all spans as (start, kind, end)."""
    held = docs.sparkSession.sparkContext.broadcast(field())
    one = pa.struct([("start", pa.int64()), ("kind", pa.int32()), ("end", pa.int64())])
    kind = pa.struct([("base", pa.list_(one)), ("spans", pa.list_(one))])

    def factory():
        own = held.value

        def run(texts: pa.Array) -> pa.Array:
            rows = []
            plain = [t or "" for t in texts.to_pylist()]
            i = 0
            while i < len(plain):  # about a million characters at once
                j, size = i + 1, len(plain[i])
                while j < len(plain) and size + len(plain[j]) < 1 << 20:
                    size += len(plain[j])
                    j += 1
                for t, more in zip(plain[i:j], model_spans(own, plain[i:j]), strict=True):
                    base = base_spans(t)
                    new = [s for s in more if not any(b[0] < s[2] and s[0] < b[2] for b in base)]
                    as_rows = lambda xs: [{"start": a, "kind": k, "end": b} for a, k, b in xs]
                    rows.append({"base": as_rows(base), "spans": as_rows(sorted(base + new))})
                i = j
            return pa.array(rows, kind)

        return run

    return append_column(docs, name, FOUND, [text], factory)


def find_personal_data(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document row: doc_id, base and spans as arrays of (start, kind, end)."""
    own = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    return annotate(own, "p").select("doc_id", "p.base", "p.spans")


def as_text(spans: Column) -> Column:
    kinds = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", F.get(kinds, x["kind"]), x["start"], x["end"])), ",")


def op5_pii(spark, sf_dir: str) -> DataFrame:
    """The contract's digest of ``find_personal_data`` over whole documents."""
    found = find_personal_data(read(spark, sf_dir, "documents", "doc_id", "text"))
    count = lambda k: F.size(F.filter("base", lambda x: x["kind"] == k)).cast("long")
    return found.select(
        "doc_id",
        *[count(k).alias(f"n_{kind}") for k, kind in enumerate(KINDS)],
        F.sha2(as_text(F.col("base")), 256).alias("base_sha256"),
        as_text(F.col("spans")).alias("spans"),
        F.size("spans").cast("long").alias("n_spans"),
    )
