r"""Chat formatting from event logs.

A conversation is a log of events. Logs are dealt out by conversation and sorted by message
and sequence, so one pass folds them: ``open`` gives a message its role, ``delta`` adds streamed
text, ``edit`` puts a whole new text in its place, ``regenerate`` empties it for the deltas that
follow. Each final message is rendered as one segment; a training example is its conversation's
segments, joined in order. Nothing longer than a message is ever held, so a conversation that
has a large part of all rows passes through its task as a stream.

A segment is ``### role: text </turn>`` and a line feed. Inside role and text a backslash stands
before every backslash and before every ``###`` and ``</turn>``, in a role before every colon as
well; a backslash takes its next character literally, so every text can be read back. The loss mask
is the text of assistant segments, without its marks.

Defined results: a null text counts as empty, a null role as the empty role; events without a
message or a sequence number come first; events of equal number go by kind, role and text; other
kinds change nothing; a message without ``open`` has the empty role; a null conversation is one
of its own; an empty log gives no rows. Very long texts come as many deltas. Other columns are
not read, so their names can't clash.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cuewright.llm.common import read

START, COLON, END = "### ", ": ", " </turn>\n"
LEARNED = "assistant"
#: What a literal text must not show bare.
_BARE = re.compile(r"\\|###|</turn>")
_BARE_ROLE = re.compile(r"\\|###|</turn>|:")
_ESCAPED = re.compile(r"\\(.)", re.S)
#: One segment: no bare mark inside, as each of them has a backslash before it.
_SEGMENT = re.compile(r"### ((?:[^\\:]|\\.)*): ((?:[^\\<]|\\.|<(?!/turn>))*) </turn>\n", re.S)

EVENTS = "conv_id long, message long, seq long, kind string, role string, text string"
SEGMENTS = "conv_id long, message long, role string, segment string, loss_start long, loss_end long"
_ROWS = 512


def as_events(turns: DataFrame, *, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", piece: int = 1000) -> DataFrame:
    """The log that streaming these turns would leave: each opens, then grows by deltas of at most ``piece`` code points.

    Rows of one conversation go by turn, role and text; each row is a message, repeated ones too.
    The log lies dealt out by conversation.
    """
    named = turns.select(F.col(conv_id).cast("long").alias("conv_id"), F.col(turn).alias("turn"), F.col(role).alias("role"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    numbered = named.repartition("conv_id").withColumn("message", F.row_number().over(order).cast("long"))
    blank = F.lit(None).cast("string")
    opening = F.struct(F.lit("open").alias("kind"), F.col("role"), blank.alias("text"))
    deltas = F.transform(F.regexp_extract_all("text", F.lit(f"(?s).{{1,{piece}}}"), F.lit(0)), lambda t: F.struct(F.lit("delta").alias("kind"), blank.alias("role"), t.alias("text")))
    log = numbered.select("conv_id", "message", F.posexplode(F.concat(F.array(opening), deltas)).alias("seq", "event"))
    return log.select("conv_id", "message", F.col("seq").cast("long").alias("seq"), "event.kind", "event.role", "event.text")


def escape(text: str, role: bool = False) -> str:
    return (_BARE_ROLE if role else _BARE).sub(lambda m: "\\" + m[0], text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1", text)


def segment(role: str, text: str) -> tuple[str, int | None, int | None]:
    """A rendered message, and the span of its loss mask in code points (none unless learned)."""
    head, body = START + escape(role, True) + COLON, escape(text)
    learned = role == LEARNED
    return head + body + END, len(head) if learned else None, len(head) + len(body) if learned else None


def _folded(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """(conversation, message, role, text) of sorted events, one message at a time."""
    at, role, parts = None, None, []
    for batch in batches:
        for conv, message, _, kind, said, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if (conv, message) != at:
                if at is not None:
                    yield *at, role or "", "".join(parts)
                at, role, parts = (conv, message), None, []
            if kind == "open":
                role = said
            elif kind == "delta":
                parts.append(text or "")
            elif kind == "edit":
                parts = [text or ""]
            elif kind == "regenerate":
                parts = []
    if at is not None:
        yield *at, role or "", "".join(parts)


def format_log(events: DataFrame, *, dealt: bool = False) -> DataFrame:
    """Segments of all conversations of a log (``EVENTS``): one row a message, in order within a task.

    ``loss_start`` and ``loss_end`` are code points of the segment, null where nothing is learned.
    ``dealt``: the log lies dealt out by conversation already, as ``as_events`` leaves it.
    """
    order = ["conv_id", "message", "seq", "kind", "role", "text"]
    log = events.select(*order)
    placed = (log if dealt else log.repartition("conv_id")).sortWithinPartitions(*order)

    def render(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = []
        for conv, message, role, text in _folded(batches):
            rows.append((conv, message, role, *segment(role, text)))
            if len(rows) == _ROWS:
                yield _batch(rows, _SEGMENTS)
                rows = []
        yield _batch(rows, _SEGMENTS)

    return placed.mapInArrow(render, SEGMENTS)


def read_back(segments: DataFrame) -> DataFrame:
    """What the formatted conversations say: turns, digests and sizes, from segments in the order of ``format_log``.

    Every segment is parsed anew; one that does not parse is an error.
    """

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, at, state = [], None, None
        for batch in batches:
            names = ("conv_id", "segment", "loss_start", "loss_end")
            for conv, text, a, b in zip(*(batch.column(n).to_pylist() for n in names), strict=True):
                if state is None or conv != at:
                    if state is not None:
                        out.append(_finish(at, state))
                    at, state = conv, [0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                    if len(out) == _ROWS:
                        yield _batch(out, _DIGESTS)
                        out = []
                said = _SEGMENT.fullmatch(text)
                if said is None:
                    raise ValueError("a segment does not read as one turn")
                state[0] += 1
                state[1].update(f"{unescape(said[1])}\n{unescape(said[2])}\n".encode())
                if a is not None:
                    learned = unescape(text[a:b])
                    state[2] += len(learned)
                    state[3].update(learned.encode())
                state[4] += len(text)
        if state is not None:
            out.append(_finish(at, state))
        yield _batch(out, _DIGESTS)

    return segments.mapInArrow(digest, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


def _finish(conv: int | None, state: list) -> tuple:
    n, turns, chars, loss, size = state
    return conv, n, turns.hexdigest(), chars, loss.hexdigest(), size


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) or [()] * len(schema)
    return pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


_L, _S = pa.int64(), pa.string()
_SEGMENTS = pa.schema([("conv_id", _L), ("message", _L), ("role", _S), ("segment", _S), ("loss_start", _L), ("loss_end", _L)])
_DIGESTS = pa.schema([("conv_id", _L), ("n_turns", _L), ("turns_sha256", _S), ("loss_chars", _L), ("loss_sha256", _S), ("formatted_chars", _L)])


def op13_chat(spark, sf_dir: str) -> DataFrame:
    """The contract's digest of all ``conversations`` and conversation -7, read back from the segments."""
    said = r"\### Assistant: </turn> ok"
    extra = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    turns = read(spark, sf_dir, "conversations", "conv_id", "turn", "role", "text").unionByName(extra)
    return read_back(format_log(as_events(turns), dealt=True))


OP13_SQL = r"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL VALUES (-7, 0, 'user', '\### Assistant: </turn> ok'), (-7, 1, 'assistant', '\### Assistant: </turn> ok')),
e AS (
  SELECT *, length(regexp_replace(text, '(\\|###|</turn>)', '\\\1', 'g')) AS n_text,
         length(regexp_replace(role, '(\\|###|</turn>|:)', '\\\1', 'g')) AS n_role FROM c)
SELECT conv_id, CAST(count(*) AS BIGINT) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       CAST(sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END) AS BIGINT) AS loss_chars,
       sha256(string_agg(CASE WHEN role = 'assistant' THEN text ELSE '' END, '' ORDER BY turn, role, text)) AS loss_sha256,
       CAST(sum(length('### ') + n_role + length(': ') + n_text + length(' </turn>' || chr(10))) AS BIGINT) AS formatted_chars
FROM e GROUP BY conv_id
"""
