"""The whole pipeline against brute force over its stages' rules."""

import re
import zlib

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

import corpus_pipeline
from cuewright.llm.queries import QUERIES
from test_operators import brute_components, brute_contamination, brute_fingerprint, brute_secrets

SF = "/root/testdata/sf0.001"


def test_run(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").orderBy("doc_id").collect()
    items = [(str(r["item_id"]), r["text"]) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    docs = [d for d in docs if re.search(r"[^\W\d_]", d["text"] or "")]
    comp = brute_components([brute_fingerprint(d["text"]) for d in docs], [d["doc_id"] for d in docs])
    docs = [d for d, c in zip(docs, comp, strict=True) if d["doc_id"] == c]
    clean = []
    for d in docs:
        n, hit, _ = brute_contamination(d["text"], items) if any(i[1].split()[0] in d["text"] for i in items) else (1, 0, [])
        if not (hit and 20 * hit >= n):
            clean.append(d)
    tok = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = {}
    for d in clean:
        out, at = "", 0
        for a, _, b in brute_secrets(d["text"]):
            if a >= at:
                out += d["text"][at:a] + "<secret>"
            at = max(at, b)
        ids = np.asarray([*tok.encode(out + d["text"][at:], add_special_tokens=False).ids, 2], "<u4")
        want[d["doc_id"]] = zlib.crc32(ids[:1].tobytes()), len(ids)
    rows = corpus_pipeline.run(spark, SF).collect()
    got = {}
    for r in rows:
        got[r["doc_id"]] = got.get(r["doc_id"], 0) + r["length"]
    assert got == {k: n for k, (_, n) in want.items()}


def test_registered():
    names = set(QUERIES)
    assert {f"op{n}_" for n in range(1, 14)} == {re.match(r"op\d+_", n)[0] for n in names if n.startswith("op")} and "pipeline" in names
