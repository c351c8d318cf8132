"""Nulls, empty tables, repeated rows and clashing columns, for every operator and stage."""

import public_tokenizers
import pytest

import corpus_pipeline
from cuewright.llm import ann, decontaminate, langid, maxent, packing, pii, secrets, sharding, simhash, suffix

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, fp long, hit string, k1 int, row int, part int, secrets int, language string, contamination string, component_id int"
_REST = (1, "h", 2, 3, 4, 5, "l", "c", 6)
ROWS = [
    (1, "Plain words in a text", "en", "s", 20, *_REST),
    (1, "Plain words in a text", "en", "s", 20, *_REST),
    (2, None, None, None, None, *[None] * 9),
    (None, None, None, None, None, *[None] * 9),
    (None, "no id here", "en", None, 1, *[None] * 9),
    (3, "", "en", "s", 0, *_REST),
    (4, "long " * 60_000, "en", "s", 1, *_REST),
]
PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module", params=["rows", "none"])
def docs(request, spark):
    return spark.createDataFrame(ROWS if request.param == "rows" else [], SCHEMA)


@pytest.fixture(scope="module")
def items(spark):
    return spark.createDataFrame([(1, "words in a"), (None, None), (2, "")], "item_id long, text string")


OPERATORS = {
    "decontaminate": lambda d, i: decontaminate.decontaminate(d, i),
    "suffix": lambda d, i: suffix.remove_repeats(d),
    "simhash": lambda d, i: simhash.near_duplicates(d),
    "pii": lambda d, i: pii.find_personal_data(d),
    "langid": lambda d, i: langid.identify(d),
    "sharding": lambda d, i: sharding.shard(d),
    "maxent": lambda d, i: maxent.score(d),
    "secrets": lambda d, i: secrets.find_secrets(d),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_one_row_a_row(docs, items, name):
    out = OPERATORS[name](docs, items).collect()
    assert len(out) == docs.count()
    if out:
        assert sorted(str(x["doc_id"]) for x in out) == sorted(str(r[0]) for r in ROWS)
        twins = [tuple(map(str, x)) for x in out if x["doc_id"] == 1]
        if name != "sharding":
            assert twins[0] == twins[1]


def test_packing_edges(docs):
    rows = packing.pack(docs, PATH).collect()
    assert sum(r["piece"] == 0 for r in rows) == docs.count()


def test_nearest_of_nothing(spark):
    assert ann.nearest(spark.createDataFrame([], "vec_id long, embedding array<float>"), "id % 20 = 0").collect() == []


@pytest.mark.parametrize("k", range(4))
def test_stages_keep_columns(spark, docs, items, k, monkeypatch):
    monkeypatch.setattr(corpus_pipeline, "read", lambda *a: items)
    out = corpus_pipeline.STAGES[k][1](spark, docs, "")
    assert out.columns == docs.columns
    kept = out.collect()
    if docs.count():
        n = {0: 5, 1: 4, 2: 5, 3: 7}[k]
        if k == 0:
            assert all(r["text"] for r in kept)  # rows without a letter go
        elif k == 1:
            assert len(kept) == 4  # plain, no id, wordless, long
        elif k == 2:
            assert sorted(str(r["doc_id"]) for r in kept) == ["2", "3", "4", "None", "None"]
        else:
            assert len(kept) == n
