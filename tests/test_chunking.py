import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from spanforge.operators import chunking as C
from spanforge.operators.embedding import HashEmbedder, embed_rows, hash_buckets

SCHEMA = "id string, text string, doc_pos bigint"
LONG = "First sentence here. Second one! Third?\n\nA new paragraph with words. " * 9


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([("a", LONG, 0), ("b", "", 1), ("c", None, 2), ("d", "x" * 950, 3), ("e", "é漢😀" * 100, 4), ("f", "\n\n\n\n", 5)], SCHEMA)


def all_chunkers(docs):
    return {
        "fixed": C.chunk_fixed(docs, 100, 30), "recursive": C.chunk_recursive(docs, 120), "parent": C.chunk_parent_child(docs, 250, 100),
        "semantic": C.chunk_semantic(docs, HashEmbedder(64), "h", 75, 200), "custom": C.chunk_custom(docs, lambda t: [(0, len(t))], "whole"),
    }


@pytest.mark.parametrize("name", ["fixed", "recursive", "parent", "semantic", "custom"])
def test_offsets_tile_and_match(docs, name):
    texts = {r["id"]: r["text"] for r in docs.collect()}
    by: dict = {}
    for r in all_chunkers(docs)[name].collect():
        assert texts[r["source_id"]][r["start"] : r["end"]] == r["text"] and r["end"] > r["start"]
        by.setdefault(r["source_id"], []).append((r["chunk_pos"], r["start"], r["end"]))
    assert set(by) == {"a", "d", "e", "f"}
    for k, spans in by.items():
        assert [s[1:] for s in sorted(spans)] == sorted(s[1:] for s in spans)
        covered = np.zeros(len(texts[k]), bool)
        for _, s, e in spans:
            covered[s:e] = True
        assert covered.all()


def test_fixed_has_no_redundant_tail(spark):
    d = spark.createDataFrame([("x", "y" * 50, 0)], SCHEMA)
    assert sorted(r["start"] for r in C.chunk_fixed(d, 20, 5).collect()) == [0, 15, 30]


def test_children_restart_at_parents(spark):
    d = spark.createDataFrame([("x", "y" * 700, 0)], SCHEMA)
    rows = sorted(C.chunk_parent_child(d, 250, 100).select("start", "end", "parent_id").collect())
    assert [r[:2] for r in rows] == [(0, 100), (100, 200), (200, 250), (250, 350), (350, 450), (450, 500), (500, 600), (600, 700)]
    assert {r["parent_id"] for r in rows} == {r["chunk_id"] for r in C.parents(d, 250, 100).collect()}


def test_lossy_drops_the_region(docs):
    spans = [(r["start"], r["end"]) for r in C.chunk_lossy(docs, 200, 350, 100).where("source_id = 'd'").collect()]
    assert not any(s < 350 and e > 200 for s, e in spans) and (350, 450) in spans


@pytest.mark.parametrize("bad", [lambda d: C.chunk_fixed(d, 0), lambda d: C.chunk_fixed(d, 10, 10), lambda d: C.chunk_parent_child(d, 10, 20), lambda d: C.chunk_recursive(d, 0), lambda d: C.chunk_semantic(d, None, "x", 101)])
def test_bad_parameters(docs, bad):
    with pytest.raises(ValueError):
        bad(docs)


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="ab. \n", max_size=200), st.integers(1, 40))
def test_recursive_spans_tile(text, size):
    spans = C.recursive_spans(text, size)
    if text:
        assert spans[0][0] == 0 and spans[-1][1] == len(text) and all(a[1] == b[0] for a, b in zip(spans, spans[1:]))


def test_recursive_sticks_separators_to_the_left():
    assert C.recursive_spans("aaaa bbbb cccc", 9) == [(0, 10), (10, 14)]
    assert C.recursive_spans("....", 2) == [(0, 2), (2, 4)]


@settings(max_examples=100, deadline=None)
@given(st.text(alphabet="ab.!? \n", max_size=120))
def test_sentence_spans_tile(text):
    spans = C.sentence_spans(text)
    assert "".join(text[s:e] for s, e in spans) == text


def test_sentences_as_expressions(docs):
    got = sorted((r["no"], r["start"], r["end"]) for r in C.sentences(docs.where("id = 'a'")).collect())
    assert [g[1:] for g in got] == C.sentence_spans(LONG)


def test_semantic_splits_at_the_percentile():
    s = [(0, 5), (5, 9), (9, 14), (14, 20)]
    assert C.semantic_spans(s, np.array([0.1, 0.9, 0.2]), 75, 1000) == [(0, 9), (9, 20)]
    assert C.semantic_spans(s, np.array([0.0, 0.0, 0.0]), 100, 1000)[0] == (0, 5)


def test_hash_embedding(spark):
    e = HashEmbedder(256)
    v = e(["alpha beta", "", "alpha beta"])
    assert np.allclose(np.linalg.norm(v, axis=1), [1, 0, 1]) and (v[0] == v[2]).all()
    df = spark.createDataFrame([(1, "alpha beta"), (2, None), (3, "alpha beta")], "id int, text string")
    counts = {(r["id"], r["bucket"]): r["value"] for r in hash_buckets(df, "id", "text", 256).collect()}
    assert {k: x for k, x in counts.items() if k[0] == 1} == {(1, int(b)): int(x) for b, x in enumerate(e.counts("alpha beta")) if x}
    rows = {r["id"]: r["vector"] for r in embed_rows(df, "text", e).collect()}
    assert np.allclose(rows[1], v[0]) and rows[2] is None and rows[1] == rows[3]
    with pytest.raises(ValueError):
        HashEmbedder(0)


def test_empty_table(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert all(c.count() == 0 for c in all_chunkers(none).values()) and C.sentences(none).count() == 0


def test_chunk_order_needs_no_sort(docs):
    plan = C.chunk_fixed(docs, 100)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Sort" not in plan
    assert F is not None
