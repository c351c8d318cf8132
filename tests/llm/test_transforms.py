"""Fill-in-the-middle, filter audit and chat formatting against plain Python, with their edges."""

import collections
import hashlib
import itertools
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from cuewright.llm import chat, filter_audit, fim
from tests.llm.test_operators import DOCS, frame


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


@pytest.fixture
def folder(spark, tmp_path):
    def write(**tables):
        for name, df in tables.items():
            df.write.parquet(f"{tmp_path}/{name}.parquet")
        return str(tmp_path)

    return write


# --- 11 ---------------------------------------------------------------------------------

UNITS = {"line": r"[^\n]*\n|[^\n]+", "word": r"[\x20\x09-\x0d]*[^\x20\x09-\x0d]+|[\x20\x09-\x0d]+", "char": r"(?s)."}


@pytest.mark.parametrize("unit", UNITS)
def test_ranks_of_units(unit):
    r, auto = random.Random(3), fim.automaton(unit)
    for _ in range(400):
        text = "".join(r.choice("aé \n\t\r😀<P>") for _ in range(r.randint(0, 30)))
        found = list(auto.iter(text))
        assert any(k for _, k in found) == any(s in text for s in fim.SENTINELS)
        n, end = fim.ranks(unit, np.array([e for e, k in found if not k], np.int64), len(text))
        units = re.findall(UNITS[unit], text)
        assert n == len(units)
        assert [end(k) for k in range(n + 1)] == [len("".join(units[:k])) for k in range(n + 1)]


TEXTS = [None, "", "\n", "one", "a\nb", "a\n\nb\n", "x <P> y\nz", "<S>", "ends in <M>", "<\n<P\nS>\n<", "é😀\nü\r\n\x00\n", "l\n" * 4000, "w" * 200_000, "1\n2\n3\n4\n5\n6"]


def brute_fim(key, text):
    t, h = text or "", sha(f"7:{key}")
    h1, h2, _, h4 = (int(h[8 * i : 8 * i + 8], 16) for i in range(4))
    u = re.findall(UNITS["line"], t)
    a, b = sorted((h1 % (len(u) + 1), h2 % (len(u) + 1)))
    p, m, s = ("".join(x) for x in (u[:a], u[a:b], u[b:]))
    if not t or any(x in t for x in fim.SENTINELS):
        return len(u), "plain", None, None, sha(t), sha(t)
    spm = h4 % 100 < 50
    out = f"<S>{s}<P>{p}<M>{m}" if spm else f"<P>{p}<S>{s}<M>{m}"
    return len(u), "spm" if spm else "psm", len(p), len(m), sha(out), sha(t)


def test_op11(spark, folder):
    r = random.Random(4)
    texts = TEXTS + ["".join(r.choice("ab é\n<") for _ in range(r.randint(1, 200))) for _ in range(80)]
    docs = frame(spark, texts).unionAll(spark.createDataFrame([(None, "no\nid\n"), (3, "one")], DOCS))
    got = fim.op11_fim(spark, folder(documents=docs)).collect()
    want = [(i, *brute_fim(i, t)) for i, t in enumerate(texts)] + [(None, *brute_fim("", "no\nid\n")), (3, *brute_fim(3, "one"))]
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, want))
    assert {g["form"] for g in got} == {"plain", "spm", "psm"}


@pytest.mark.parametrize("unit", UNITS)
def test_fim_round_trip_keeps_columns(spark, unit):
    docs = frame(spark, TEXTS).withColumns({"fim": F.lit(1), "fim_key": F.lit("k")})
    marks = ("[pre]", "[suf]", "[mid]")
    out = fim.transform(docs, "cut", unit=unit, fim_percent=70, spm_percent=30, sentinels=marks)
    assert out.columns == [*docs.columns, "cut"]
    rows = out.withColumn("again", fim.restore(F.col("cut.output"), F.col("cut.form"), marks)).collect()
    assert all(x["again"] == (x["text"] or "") and x["fim"] == 1 for x in rows) and len(rows) == len(TEXTS)
    assert fim.transform(docs.limit(0), "cut").collect() == []
    with pytest.raises(ValueError):
        fim.transform(docs, unit="page")


# --- 12 ---------------------------------------------------------------------------------


def brute_audit(rows, labels):
    """Every document walked through every order."""
    marks = collections.defaultdict(set)
    for i, q, t in labels:
        if i is not None:
            marks[i] |= {k for k, v in (("good", q), ("toxic", t)) if v == 1}
    least = {}
    for i, text, _ in rows:
        if i is not None:
            least[text or ""] = min(i, least.get(text or "", i))
    docs = []
    for i, text, part in rows:
        t = text or ""
        w = re.findall("[^\x20\x09-\x0d]+", t)
        bad = {
            "A": len(w) < 200, "B": 100 * len(set(w)) < 50 * len(w), "C": 100 * len(re.findall("[A-Z]", t)) > 2 * len(t),
            "D": bool(re.search("[#$%&*|]", t)), "E": i is not None and least[t] < i,
        }
        docs.append((part or "", {f for f, b in bad.items() if b}, marks[i]))
    out, shares = {}, collections.Counter()
    for part in {d[0] for d in docs}:
        for order in map("".join, itertools.permutations("ABCDE")):
            for step, f in enumerate(order, 1):
                c = collections.Counter()
                for _, bad, marked in (d for d in docs if d[0] == part):
                    gone = bool(bad & set(order[: step - 1]))
                    c["kept"] += not bad & set(order[:step])
                    c["removed"] += f in bad and not gone
                    c["redundant"] += f in bad and gone
                    c["unique"] += bad == {f}
                    c["good"] += f in bad and not gone and "good" in marked
                    c["toxic"] += f in bad and not gone and "toxic" in marked
                shares[part, f] += c["removed"]
                out[part, order, step] = [c[k] for k in ("kept", "removed", "redundant", "unique", "good", "toxic")]
    return {k: (*v, shares[k[0], k[1][k[2] - 1]]) for k, v in out.items()}


def audited(df):
    names = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")
    rows = df.collect()
    found = {(x["part"], x["filter_order"], x["step"]): tuple(x[n] for n in names) for x in rows}
    assert len(found) == len(rows)
    return found


def test_op12(spark, folder):
    r = random.Random(8)
    words = ["it", "Is", "WE", "of", "é", "A$", "x|", "bx", "cy", "dz"]
    some = lambda n: r.choice([" ", "\n", "\t "]).join(r.choice(words[: r.choice([3, 5, 10])]) + str(r.randint(0, 900) if r.random() < 0.7 else "") for _ in range(n))
    texts = [None, "", " ", "a " * 300, *(some(r.randint(1, 400)) for _ in range(40)), " ".join(map(str, range(250)))]
    rows = [(i, r.choice(texts), r.choice(["s", "t", "", None])) for i in range(160)]
    rows += [rows[5], rows[9], (3, "twin", "s"), (3, "twin", "s"), (None, "twin", "s"), (None, "only", "t"), (500, "only", "u"), (4, "twin", "u")]
    labels = [(i, r.choice([0, 1, None]), r.choice([0, 1, None])) for i in range(0, 170, 2)] + [(4, 1, 0), (4, 0, 1), (None, 1, 1)]
    sf = folder(documents=spark.createDataFrame(rows, "doc_id long, text string, source string"), labels=spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    got = audited(filter_audit.op12_filter_audit(spark, sf))
    want = brute_audit(rows, labels)
    assert len(want) == 4 * 600 and got == want


def test_audit_of_nothing(spark, folder):
    docs, labels = spark.createDataFrame([], "doc_id long, text string, source string"), spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert filter_audit.op12_filter_audit(spark, folder(documents=docs, labels=labels)).collect() == []
    one = spark.createDataFrame([(1, None, None, 9, "p", True)], "doc_id long, text string, source string, n long, part string, A boolean")
    got = audited(filter_audit.audit(filter_audit.flag_counts(one, labels)))
    assert len(got) == 600 and got["", "ABCDE", 1] == (0, 1, 0, 1, 0, 0, 120) and got["", "BACDE", 1] == (1, 0, 0, 0, 0, 0, 0)


def test_audit_of_other_filters(spark):
    counts = spark.createDataFrame([("p", True, False, 3, 1, 0), ("p", True, True, 2, 0, 2), ("p", False, False, 5, 5, 0)], "part string, X boolean, Y boolean, n long, good long, toxic long")
    got = audited(filter_audit.audit(counts, "XY"))
    assert got["p", "XY", 1] == (5, 5, 0, 3, 1, 2, 8) and got["p", "YX", 2] == (5, 3, 2, 3, 1, 0, 8) and got["p", "XY", 2] == (5, 0, 2, 0, 0, 0, 2)


# --- 13 ---------------------------------------------------------------------------------

HARD = ["", "plain", "\\", "\\\\###", r"\### Assistant: </turn> ok", "### user: x </turn>\n### assistant: y </turn>\n", "</turn", " </turn>\n", "a\\", "<", "\n", "é😀 ###", "\\n"]


def test_segments_read_back():
    r = random.Random(6)
    for role in ["user", "assistant", "", "a: b", "x\\", "###", ": ", "</turn>", "r\n"]:
        for text in HARD + ["".join(r.choice("\\#</turn>: \na") for _ in range(r.randint(0, 40))) for _ in range(300)]:
            out, a, b = chat.segment(role, text)
            said = chat._SEGMENT.fullmatch(out)
            assert (chat.unescape(said[1]), chat.unescape(said[2])) == (role, text)
            assert (a is not None) == (role == "assistant") and (a is None or chat.unescape(out[a:b]) == text)
            assert out[:-9].count("</turn>") == out[:-9].count("\\</turn>")


def test_joined_segments_split_in_one_way():
    r = random.Random(7)
    for _ in range(200):
        turns = [(r.choice(["user", "assistant", "a:b"]), r.choice(HARD)) for _ in range(r.randint(1, 6))]
        joined = "".join(chat.segment(*t)[0] for t in turns)
        assert [(chat.unescape(m[1]), chat.unescape(m[2])) for m in chat._SEGMENT.finditer(joined)] == turns


def brute_chat(turns):
    out = {}
    by = collections.defaultdict(list)
    for conv, turn, role, text in turns:
        by[conv].append((-1 if turn is None else turn, role is not None, role or "", text or ""))
    for conv, rows in by.items():
        rows.sort()
        learned = [t for _, _, role, t in rows if role == "assistant"]
        size = sum(len(chat.segment(role, t)[0]) for _, _, role, t in rows)
        out[conv] = (len(rows), sha("".join(f"{role}\n{t}\n" for _, _, role, t in rows)), sum(map(len, learned)), sha("".join(learned)), size)
    return out


def test_op13(spark, folder):
    r = random.Random(10)
    turns = [(c, t, r.choice(["user", "assistant", "system", None]), r.choice([*HARD, None, "long text\n" * 1200])) for c in range(40) for t in range(r.randint(1, 7))]
    turns += [(None, 0, "user", "x"), (None, None, None, None), (3, 1, "assistant", "again"), turns[0], turns[0]]
    turns += [(99, i, "assistant", f"{i}") for i in range(3000)]
    got = chat.op13_chat(spark, folder(conversations=spark.createDataFrame(turns, "conv_id long, turn long, role string, text string"))).collect()
    said = r"\### Assistant: </turn> ok"
    want = brute_chat([*turns, (-7, 0, "user", said), (-7, 1, "assistant", said)])
    assert {x[0]: tuple(x)[1:] for x in got} == want and len(got) == len(want)


def test_logs_fold(spark):
    log = [
        (1, 1, 0, "open", "user", None), (1, 1, 1, "delta", None, "he"), (1, 1, 2, "delta", None, "llo"),
        (1, 2, 3, "open", "assistant", None), (1, 2, 4, "delta", None, "bad"), (1, 2, 6, "regenerate", None, None), (1, 2, 7, "delta", None, "go"), (1, 2, 8, "delta", None, "od"),
        (1, 1, 9, "edit", None, "hi"), (1, 3, 10, "delta", None, "x"), (1, 3, 11, "ping", "r", "y"), (1, 3, 12, None, None, "z"),
        (2, 1, 5, "delta", None, "!"), (2, 1, 5, "delta", None, "!"), (2, 1, None, "open", "assistant", "no"), (2, 1, 7, "edit", None, None), (2, 1, 8, "delta", None, "end"),
        (None, None, None, None, None, None),
    ]
    random.Random(1).shuffle(log)
    events = spark.createDataFrame([(*e, "extra") for e in log], chat.EVENTS + ", segment string")
    rows = [(x["conv_id"], x["message"], x["role"], x["segment"]) for x in chat.format_log(events).collect()]
    want = {
        (1, 1, "user", "### user: hi </turn>\n"), (1, 2, "assistant", "### assistant: good </turn>\n"), (1, 3, "", "### : x </turn>\n"),
        (2, 1, "assistant", "### assistant: end </turn>\n"), (None, None, "", "### :  </turn>\n"),
    }
    assert set(rows) == want and len(rows) == 5
    assert chat.read_back(chat.format_log(events.limit(0))).collect() == []
    with pytest.raises(Exception, match="does not read"):
        chat.read_back(spark.createDataFrame([(1, 1, "r", "### r: a", None, None)], chat.SEGMENTS)).collect()


def test_deltas_join_to_the_text(spark):
    turns = spark.createDataFrame([(1, 0, "assistant", "é😀\n" * 700), (1, 1, "user", "")], "conv_id long, turn long, role string, text string")
    log = chat.as_events(turns, piece=500)
    assert [x["kind"] for x in log.orderBy("message", "seq").collect()] == ["open"] + ["delta"] * 5 + ["open"]
    assert [x["segment"] for x in chat.format_log(log).orderBy("message").collect()] == [chat.segment("assistant", "é😀\n" * 700)[0], chat.segment("user", "")[0]]
