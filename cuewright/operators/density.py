"""Captions at a readable speed, by columns: words pass in order as Arrow batches, and cues are cut, wrapped and split there.

All rules work on runs of words: lengths of texts are differences of one running sum, places to cut
are looked up, and only captions that no line break fits are written out one by one. A pass keeps
the last cue, which may go on, and a batch.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from decimal import ROUND_HALF_UP, Decimal
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from cuewright.functions import text as X
from cuewright.schema import Settings

# nulls among times and sizes: comparisons with them come out as SQL's do
_START, _END, _SIZE = -(1 << 61), -(1 << 60), -(1 << 40)
_BLANKS = re.compile(r"[ \t\n\x0b\f\r]+")
_ENDED = re.compile("[.!?][\"'”’]*\\Z")


def collapse(text: str) -> str:
    """``X.collapse`` of one text."""
    return _BLANKS.sub(" ", text).strip(" ")


def lines(words: list[str | None], s: Settings) -> str:
    """``X.wrap_caption`` of one list of words."""
    flat = collapse(" ".join(w for w in words if w is not None))
    if len(flat) <= s.max_chars:
        return flat
    if s.max_lines < 2:
        return flat[: s.max_chars].rstrip(" ")
    parts, best = flat.split(" "), None
    for i in range(1, len(parts)):
        a, b = " ".join(parts[:i]), " ".join(parts[i:])
        if len(a) <= s.max_chars and len(b) <= s.max_chars:
            score = -0.5 * abs(len(a) - len(b)) - 20 * (_weak(parts[i - 1])) - 12 * (len(parts) - i == 1 and len(a) > s.max_chars * 0.55) - 6 * (len(a) < s.max_chars * 0.35)
            if best is None or score > best[0]:
                best = score, f"{a}\n{b}"
    if best:
        return best[1]
    space = flat[: s.max_chars + 1].rfind(" ")
    first, rest = (flat[:space], flat[space + 1 :]) if space > 0 else (flat[: s.max_chars], flat[s.max_chars :].lstrip(" "))
    return f"{first}\n{rest[: s.max_chars].rstrip(' ') if len(rest) > s.max_chars else rest}".strip(" \n")


def _weak(word: str) -> bool:
    return word.rstrip(".!?,;:").lower() in X.WEAK_ENDINGS


def _one_of(words: pa.Array, marks: str, values: list[str]) -> np.ndarray:
    """Words that are one of ``values`` in any case, without the marks at their end."""
    found = pc.is_in(pc.ascii_lower(pc.ascii_rtrim(words, marks)), pa.array(values, words.type))
    return found.to_numpy(zero_copy_only=False)


def modal(values: list[str | None]) -> str | None:
    """``X.modal`` of one list."""
    seen: dict[str, int] = {}
    for v in values:
        if v:
            seen[v] = seen.get(v, 0) + 1
    return max(seen, key=seen.__getitem__) if seen else None


@dataclass
class _Words:
    """Columns of consecutive words; ``first``, ``comma`` and the like say which words have a fact."""

    rows: pa.Table
    s: Settings

    def __post_init__(self) -> None:
        self.n, self.word = len(self.rows), self.column("word").cast(pa.string())
        self.start, self.end = self._times("start_ms", _START), self._times("end_ms", _END)
        self.size = pc.fill_null(pc.utf8_length(self.word).cast(pa.int64()), _SIZE).to_numpy(zero_copy_only=False)
        self.first = self.yes("first")
        # length of the words i to j - 1 with single blanks between: sum[j] - sum[i] - 1
        self.sum = np.concatenate(([0], np.cumsum(np.where(self.size == _SIZE, 0, self.size + 1))))
        edges = np.frombuffer(self.word.buffers()[1], np.int32)[self.word.offset : self.word.offset + self.n + 1]
        held = np.frombuffer(self.word.buffers()[2] or b"", np.uint8)
        some = edges[1:] > edges[:-1]
        end = np.where(some, held[np.maximum(edges[1:] - 1, 0)], 0) if len(held) else np.zeros(self.n, np.uint8)
        self.comma, self.terminal = end == ord(","), np.isin(end, np.frombuffer(b".!?", np.uint8))
        # a mark may stand before closing quotes, of which the last two bytes here end two
        for k in np.flatnonzero(np.isin(end, np.frombuffer(b"\"'\x99\x9d", np.uint8))).tolist():
            word = self.word[k].as_py()
            self.terminal[k] = word is not None and _ENDED.search(word) is not None
        blank = np.concatenate(([0], np.cumsum((held == 32) | ((held >= 9) & (held <= 13)))))
        self.odd = ~some | (self.size == _SIZE) | (blank[edges[1:]] > blank[edges[:-1]])
        self.conjunction = _one_of(pc.ascii_ltrim(self.word, ".,!?"), ".,!?", X.CONJUNCTIONS)
        self.weak = _one_of(self.word, ".!?,;:", X.WEAK_ENDINGS)
        said = self.column("speaker").dictionary_encode()
        self.names = said.dictionary.to_pylist()
        code = pc.fill_null(said.indices, -1).to_numpy(zero_copy_only=False).astype(np.int64)
        self.speaker = np.where(np.isin(code, [k for k, v in enumerate(self.names) if not v]), -1, code)  # -1: null or empty

    def column(self, name: str) -> pa.Array:
        return self.rows.column(name).combine_chunks()

    def _times(self, name: str, null: int) -> np.ndarray:
        return pc.fill_null(self.column(name).cast(pa.int64()), null).to_numpy(zero_copy_only=False)

    def yes(self, name: str) -> np.ndarray:
        return pc.fill_null(self.column(name), False).to_numpy(zero_copy_only=False)

    def said(self, a: int, z: int) -> str | None:
        """The most frequent speaker of some words."""
        return modal([self.names[c] if c >= 0 else None for c in self.speaker[a:z].tolist()]) if self.names else None

    def heads(self, cued: bool) -> np.ndarray:
        """Where a cue must begin: as given, or at another speaker, after a pause and after a sentence; nulls count as these."""
        new = self.first.copy()
        if cued:
            new |= self.yes("new")
        else:
            one, two = self.speaker[:-1], self.speaker[1:]
            new[1:] |= (one >= 0) & (two >= 0) & (one != two)
            new[1:] |= (self.start[1:] == _START) | (self.end[:-1] == _END) | (self.start[1:] - self.end[:-1] >= self.s.pause_gap_ms)
            new[1:] |= self.terminal[:-1] | (self.size[:-1] == _SIZE)
        new[0] = True
        return new

    def following(self, fact: np.ndarray) -> np.ndarray:
        """Of each place the first word from there that has the fact; beyond all words if none."""
        far = self.n + 1
        at = np.where(fact, np.arange(self.n), far)
        return np.concatenate((np.minimum.accumulate(at[::-1])[::-1], [far, far]))

    def long(self, a: np.ndarray, z: np.ndarray) -> np.ndarray:
        return np.maximum(self.sum[z] - self.sum[a] - 1, 0)

    def last_end(self, a: np.ndarray, z: np.ndarray) -> np.ndarray:
        return np.maximum(self.end[z - 1], self.start[a])


def _cues(w: _Words) -> np.ndarray:
    """First words of the cues: where one must begin, and where the text or the time would be too long."""
    limit, most = w.s.max_chars * w.s.max_lines, w.s.max_cue_ms
    new = w.heads(cued=False)
    heads, at, long = [], 0, 0
    for i, (fresh, start, end, size) in enumerate(zip(new.tolist(), w.start.tolist(), w.end.tolist(), w.size.tolist(), strict=True)):
        if not fresh:
            long += 1 + size
            if end - at <= most and long <= limit:
                continue
        heads.append(i)
        at, long = start, size
    return np.array(heads)


def _merged(w: _Words, heads: np.ndarray) -> np.ndarray:
    """First words of the cues after short ones took in what follows them."""
    ends = np.append(heads[1:], w.n)
    start, end, size = w.start[heads], w.last_end(heads, ends), w.long(heads, ends)
    keep = np.ones(len(heads), bool)
    for k in np.flatnonzero(end - start < w.s.min_cue_ms).tolist():
        if not keep[k]:
            continue
        j, long = k, size[k]
        while end[j] - start[k] < w.s.min_cue_ms and j + 1 < len(heads) and not w.first[heads[j + 1]]:
            long += 1 + size[j + 1]
            if end[j + 1] == _END or end[j + 1] - start[k] > w.s.max_cue_ms or long > w.s.max_chars * w.s.max_lines:
                break
            a, b = w.said(heads[k], ends[j]), w.said(heads[j + 1], ends[j + 1])
            if a is not None and b is not None and a != b:
                break
            j += 1
            keep[j] = False
    return heads[keep]


@dataclass
class _Texts:
    """Wrapped texts of runs of words: the word that ends the first line (-1: none), texts written out, and their sizes."""

    at: np.ndarray
    own: dict[int, str]
    chars: np.ndarray
    said: np.ndarray

    def dense(self, ms: np.ndarray, s: Settings) -> np.ndarray:
        seconds = np.maximum(ms, 1) / 1000.0
        return (self.chars / seconds > s.max_cps) | (self.said / seconds > s.max_wps)


def _wrapped(w: _Words, a: np.ndarray, z: np.ndarray) -> _Texts:
    s, n = w.s, z - a
    chars, said, at = w.long(a, z), n.copy(), np.full(len(a), -1)
    odd = np.concatenate(([0], np.cumsum(w.odd)))
    alone = odd[z] > odd[a]
    wide = np.flatnonzero(~alone & (chars > s.max_chars))
    broken = np.zeros(len(a), bool)
    if len(wide) and s.max_lines > 1:
        # every word of a wide text but the last may end its first line
        places = n[wide] - 1
        run = np.repeat(wide, places)
        i = np.arange(len(run)) - np.repeat(np.cumsum(places) - places, places) + a[run]
        first, second = w.sum[i + 1] - w.sum[a[run]] - 1, w.sum[z[run]] - w.sum[i + 1] - 1
        fits = (first <= s.max_chars) & (second <= s.max_chars)
        run, i, first, second = run[fits], i[fits], first[fits], second[fits]
        score = -0.5 * np.abs(first - second) - 20.0 * w.weak[i] - 12.0 * ((z[run] - i == 2) & (first > s.max_chars * 0.55)) - 6.0 * (first < s.max_chars * 0.35)
        order = np.lexsort((i, -score, run))
        run, i = run[order], i[order]
        best = np.append(True, run[1:] != run[:-1]) if len(run) else np.zeros(0, bool)
        at[run[best]] = i[best]
        broken[run[best]] = True
    own = {}
    alone |= (chars > s.max_chars) & ~broken
    for k in np.flatnonzero(alone).tolist():
        own[k] = text = lines(w.word[a[k] : z[k]].to_pylist(), s)
        flat = collapse(text)
        chars[k], said[k] = len(flat), len(flat.split(" ")) if flat else 0
    return _Texts(at, own, chars, said)


def _cuts(w: _Words, a: np.ndarray, z: np.ndarray) -> np.ndarray:
    """Words before the place where a dense cue is cut: behind a sentence mark, a comma, before a conjunction, in the middle; else 0."""
    n, out = z - a, np.zeros(len(a), np.int64)
    out = np.where(n >= 6, n // 2, out)
    for fact, more in ((w.conjunction, 0), (w.comma, 1), (w.terminal, 1)):
        found = w.following(fact)[a + 1 - more]
        out = np.where(found <= z - 2, found - a + more, out)
    return out


def _tenths(c: np.ndarray) -> np.ndarray:
    """Doubles as decimals of ten places, rounded half up as they are written."""
    x = np.abs(c) * 1e10
    out = np.where(x <= 1e10, np.floor(np.where(x <= 1e10, x, 0) + 0.5), 0).astype(np.int64)
    for k in np.flatnonzero((x > 1e10) | (np.abs(x % 1 - 0.5) < 1e-4)).tolist():
        out[k] = int(Decimal(repr(abs(float(c[k])))).scaleb(10).to_integral_value(ROUND_HALF_UP))
    return np.where(c < 0, -out, out)


class _Means:
    """Means of a column over consecutive runs, by sums of decimals."""

    def __init__(self, w: _Words, name: str, rows: int):
        c = w.column(name)[:rows]
        value = pc.fill_null(c, float("nan")).to_numpy(zero_copy_only=False)
        self.valid = np.isfinite(value)
        self.value = _tenths(np.where(self.valid, value, 0.0))

    def __call__(self, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """In units of ten places, and whether there is any value."""
        total, count = np.add.reduceat(self.value, starts), np.add.reduceat(self.valid.astype(np.int64), starts)
        n = np.maximum(count, 1)
        return np.sign(total) * ((2 * np.abs(total) + n) // (2 * n)), count > 0


def _speakers(w: _Words, starts: np.ndarray, rows: int) -> pa.Array:
    code = w.speaker[:rows]
    low, high = np.minimum.reduceat(code, starts), np.maximum.reduceat(code, starts)
    ends = np.append(starts[1:], rows)
    out = [w.names[k] if k >= 0 else None for k in high.tolist()]
    for k in np.flatnonzero(low != high).tolist():
        out[k] = w.said(starts[k], ends[k])
    return pa.array(out, pa.string())


def _captions(w: _Words, bounds: np.ndarray, number: int, annotated: bool, target: pa.Schema) -> tuple[pa.RecordBatch, int]:
    """Captions of the cues between ``bounds``, and how many its last job has. ``number``: captions of the first job before them."""
    s, rows = w.s, int(bounds[-1])
    a, z = bounds[:-1], bounds[1:]
    n = z - a
    goes_on = np.append(z[:-1], rows if rows < w.n else 0)
    after = np.where((z < w.n) & ~w.first[goes_on], w.start[goes_on], _START)
    span = lambda a, z: np.where((w.start[a] == _START) | (w.last_end(a, z) == _END), 1, w.last_end(a, z) - w.start[a])
    whole = _wrapped(w, a, z)
    dense, cut = whole.dense(span(a, z), s), _cuts(w, a, z)
    tried = np.flatnonzero(dense & (cut > 0))
    mid = a[tried] + cut[tried]
    sides = _wrapped(w, np.concatenate((a[tried], mid)), np.concatenate((mid, z[tried])))
    fast = sides.dense(span(np.concatenate((a[tried], mid)), np.concatenate((mid, z[tried]))), s)
    k = len(tried)
    chosen = ~fast[:k] | ~fast[k:] | (n[tried] >= 6)
    split = np.zeros(len(a), bool)
    split[tried[chosen]] = True
    # the parts in order: cues as they are, first halves, second halves
    kept = np.flatnonzero(~split)
    cue = np.concatenate((kept, tried[chosen], tried[chosen]))
    order = np.lexsort((np.repeat([0, 1], [len(kept) + chosen.sum(), chosen.sum()]), cue))
    pick = lambda one, two: np.concatenate((one[kept], two[:k][chosen], two[k:][chosen]))[order]
    starts = np.concatenate((a[kept], a[tried[chosen]], mid[chosen]))[order]
    ends, cue = np.append(starts[1:], rows), cue[order]
    at, chars, said = pick(whole.at, sides.at), pick(whole.chars, sides.chars), pick(whole.said, sides.said)
    own = np.concatenate((kept, len(a) + np.flatnonzero(chosen), len(a) + k + np.flatnonzero(chosen)))[order]
    written = {**whole.own, **{len(a) + j: t for j, t in sides.own.items()}}
    # every word brings what stands behind it
    gap = np.zeros(rows, np.int8)
    gap[at[at >= 0]] = 1
    gap[ends - 1] = 2
    pieces = pc.binary_join_element_wise(w.word[:rows], pa.array([" ", "\n", ""]).take(pa.array(gap)), "")
    text = pc.binary_join(pa.ListArray.from_arrays(pa.array(np.append(starts, rows), pa.int32()), pieces), "")
    alone = np.array([j in written for j in own.tolist()], bool)
    text = pc.replace_with_mask(text, pa.array(alone), pa.array([written[j] for j in own[alone].tolist()], pa.string()))
    second = np.append(False, cue[1:] == cue[:-1])
    follows = np.append(second[1:], False)
    after = np.where(follows, w.start[np.minimum(ends, w.n - 1)], after[cue])
    means = _Means(w, "confidence", rows)
    (mean, known), (parent, parent_known) = means(starts), means(a)
    low = lambda m, ok: ok & (m / 1e10 < s.confidence_medium)
    parent_low, shown, shown_known = low(parent, parent_known), mean, known
    if annotated:
        parent_low |= np.logical_or.reduceat(w.yes("low")[:rows], a)
        overall, any_overall = _Means(w, "overall", rows)(a)
        better = (~split & any_overall)[cue]
        shown, shown_known = np.where(better, overall[cue], mean), known | better
    grade = np.where(mean / 1e10 >= s.confidence_high, 0, np.where(mean / 1e10 >= s.confidence_medium, 1, 2))
    begins = w.first[starts]
    place = np.arange(len(starts))
    caption = place - np.maximum.accumulate(np.where(begins, place, -number)) + 1
    end = w.last_end(starts, ends)
    columns = {
        "job_id": w.column("job_id").take(pa.array(starts)), "caption": caption, "start_ms": pa.array(w.start[starts], mask=w.start[starts] == _START), "end_ms": pa.array(end, mask=end == _END),
        "text": text, "chars": chars, "said": said, "next": pa.array(after, mask=after == _START), "dense": pick(dense, fast), "split": split[cue], "n_words": ends - starts,
        "speaker": _speakers(w, starts, rows), "mean_confidence": pa.array(np.sign(shown) * ((np.abs(shown) + 500_000) // 1_000_000) / 1e4, mask=~shown_known),
        "confidence_band": pa.array(["high", "medium", "low"]).take(pa.array(grade, mask=~known)), "low": low(mean, known), "parent_low": parent_low[cue],
    }
    arrays = [(c if isinstance(c, pa.Array) else pa.array(c)).cast(target.field(name).type) for name, c in columns.items()]
    return pa.RecordBatch.from_arrays(arrays, schema=target), int(caption[-1])


def repaired(batches: Iterator[pa.RecordBatch], s: Settings, cued: bool, annotated: bool, target: pa.Schema) -> Iterator[pa.RecordBatch]:
    """Captions of words that come in order. ``cued``: cues begin where the column new says so, and are not merged."""
    held, number = None, 0
    for batch in chain(batches, [None]):
        if batch is not None:
            if not batch.num_rows:
                continue
            fresh = pa.Table.from_batches([batch])
            held = fresh if held is None else pa.concat_tables([held, fresh]).combine_chunks()
        if held is None:
            return
        w = _Words(held, s)
        heads = np.flatnonzero(w.heads(cued)) if cued else _merged(w, _cues(w))
        bounds = np.append(heads, w.n) if batch is None else heads
        if len(bounds) < 2:
            continue
        out, number = _captions(w, bounds, number, annotated, target)
        yield out
        held = held.slice(int(heads[-1]))
