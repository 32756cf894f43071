import math
import re

import numpy as np
import pytest

from spanforge.operators import dense, geometry, ranking, sparse
from spanforge.operators.embedding import HashEmbedder

TEXTS = ["the red fox", "the red red dog and the fox", "", None, "blue whale song", "the red fox"]


@pytest.fixture(scope="module")
def chunks(spark):
    return spark.createDataFrame([(i, f"c{i}", t) for i, t in enumerate(TEXTS)], "chunk_pos bigint, chunk_id string, text string")


@pytest.fixture(scope="module")
def queries(spark):
    return spark.createDataFrame([("q1", "red FOX fox"), ("q2", "whale"), ("q3", ""), ("q4", None), ("q5", "unseen")], "query_id string, text string")


def brute_bm25(query, k1=1.5, b=0.75):
    docs = [re.findall("[a-z0-9]+", (t or "").lower()) for t in TEXTS]
    avg, n = sum(map(len, docs)) / len(docs), len(docs)
    out = []
    for i, d in enumerate(docs):
        s = 0.0
        for t in dict.fromkeys(re.findall("[a-z0-9]+", query.lower())):
            df, f = sum(t in x for x in docs), d.count(t)
            s += math.log(1 + (n - df + 0.5) / (df + 0.5)) * f * (k1 + 1) / (f + k1 * (1 - b + b * len(d) / avg))
        if s > 0:
            out.append((-round(s, 9), i))
    return [i for _, i in sorted(out)]


def lists(df):
    out = {}
    for r in sorted(df.collect(), key=lambda r: (r["query_id"], r["rank"])):
        out.setdefault(r["query_id"], []).append(r["chunk_pos"] if "chunk_pos" in r else r["chunk_id"])
    return out


def test_bm25_matches_brute_force(chunks, queries):
    got = lists(sparse.bm25_topk(chunks, queries, 10))
    assert got == {"q1": brute_bm25("red FOX fox"), "q2": brute_bm25("whale")}
    assert got["q1"][:2] == [0, 5]  # equal texts tie in corpus order


def test_bm25_edges(spark, chunks, queries):
    assert sparse.bm25_topk(chunks, queries, 0).count() == 0
    assert sparse.bm25_topk(chunks.limit(0), queries, 3).count() == 0
    assert sparse.bm25_topk(chunks, queries.limit(0), 3).count() == 0
    assert lists(sparse.bm25_topk(chunks, queries, 1)) == {"q1": [0], "q2": [4]}


def test_bm25_query_blocks(chunks, queries, monkeypatch):
    whole = lists(sparse.bm25_topk(chunks, queries, 10))
    monkeypatch.setattr(sparse, "QUERY_BLOCK", 1)
    assert lists(sparse.bm25_topk(chunks, queries, 10)) == whole


def test_dense_keeps_negative_scores(spark):
    v = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.0, 1.0]), (2, [-1.0, 0.0]), (3, [0.0, 0.0]), (4, None), (5, [1.0])], "chunk_pos bigint, vector array<double>")
    q = spark.createDataFrame([("q", [2.0, 0.0])], "query_id string, vector array<double>")
    assert lists(dense.dense_topk(v, q, 10, 2)) == {"q": [0, 1, 3, 2]}
    assert dense.dense_topk(v, q.limit(0), 10, 2).count() == 0 and dense.dense_topk(v, q, 0, 2).count() == 0


def test_dense_text_equals_vectors(spark, chunks, queries):
    e = HashEmbedder(128)
    got = lists(dense.dense_topk_text(chunks, queries, 3, e))
    m = e([t or "" for t in TEXTS]).astype(np.float32)
    s = m @ e(["red FOX fox"])[0].astype(np.float32)
    assert got["q1"] == [int(i) for i in sorted(range(6), key=lambda i: (-round(float(s[i]), 6), i))[:3]]


def test_lsh_and_recall(spark):
    rng = np.random.default_rng(0)
    x = rng.standard_normal((300, 16))
    v = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)], "chunk_pos bigint, vector array<double>")
    q = spark.createDataFrame([(f"q{i}", x[i].tolist()) for i in range(10)], "query_id string, vector array<double>")
    exact, found = dense.dense_topk(v, q, 5, 16), dense.lsh_topk(v, q, 5, 16, tables=16, bits=5, probes=6)
    d = dense.ann_diagnostic(dense.ann_recall(exact, found, q), 5).first()
    assert d["n"] == 10 and 0.9 <= d["mean_recall"] <= 1
    same = dense.ann_diagnostic(dense.ann_recall(exact, exact, q), 5).first()
    assert same["mean_recall"] == 1 and same["queries_below_full_recall"] == 0
    none = dense.ann_recall(exact.limit(0), found, q)
    assert {r["recall"] for r in none.collect()} == {1.0}


def ranked(spark, *rows):
    return spark.createDataFrame(list(rows), "query_id string, rank int, chunk_id string")


def test_fusion_ties_break_by_id(spark):
    a, b = ranked(spark, ("q", 1, "z"), ("q", 2, "a")), ranked(spark, ("q", 1, "a"), ("q", 2, "z"))
    assert lists(ranking.reciprocal_rank_fusion([a, b])) == {"q": ["a", "z"]}


def test_union_is_first_seen(spark):
    a, b = ranked(spark, ("q", 1, "x"), ("q", 2, "y")), ranked(spark, ("q", 1, "w"), ("q", 2, "x"))
    assert lists(ranking.candidate_union([a, b])) == {"q": ["x", "y", "w"]}


def test_rerank_keeps_incoming_order_on_ties(spark, chunks, queries):
    base = ranked(spark, ("q1", 1, "c4"), ("q1", 2, "c2"), ("q1", 3, "c1"), ("q1", 4, "c3"))
    assert lists(ranking.rerank(base, queries, chunks)) == {"q1": ["c1", "c4", "c2", "c3"]}


def test_expansion(spark):
    m = spark.createDataFrame([("a", "P"), ("b", "P"), ("c", None)], "chunk_id string, parent_id string")
    assert lists(ranking.expand_to_parents(ranked(spark, ("q", 1, "b"), ("q", 2, "x"), ("q", 3, "a"), ("q", 4, "c")), m)) == {"q": ["P", "x", "c"]}


@pytest.mark.parametrize("tokens,budget,kept", [((3, 2, 3), 5, 2), ((9, 1), 5, 0), ((5,), 5, 1), ((1, None, 1), 2, 3), ((1,), 0, 0)])
def test_budget_is_a_prefix(spark, tokens, budget, kept):
    df = spark.createDataFrame([("q", i + 1, f"c{i}", t) for i, t in enumerate(tokens)], "query_id string, rank int, chunk_id string, n_tokens int")
    assert ranking.pack_by_budget(df, budget).count() == kept


def test_topk_limits_before_the_shuffle(spark, chunks, queries):
    plan = sparse.bm25_topk(chunks, queries, 2)._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan


def test_geometry(spark):
    x = np.random.default_rng(1).standard_normal((40, 8))
    v = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)], "id bigint, vector array<double>")
    u = x / np.linalg.norm(x, axis=1)[:, None]
    s = u @ u.T
    assert geometry.anisotropy(v, 8).first()["mean_cosine"] == pytest.approx((s.sum() - 40) / (40 * 39))
    np.fill_diagonal(s, -9)
    counts = np.bincount(np.argsort(-s, axis=1)[:, :5].ravel(), minlength=40)
    assert {r["id"]: r["times"] for r in geometry.neighbour_counts(v, 8, 5).collect()} == dict(enumerate(counts.tolist()))
    one = spark.createDataFrame([(0, [0.0, 0.0])], "id bigint, vector array<double>")
    assert geometry.hubness(one, 2).first().asDict() == {"k": 0, "skewness": 0.0} and geometry.anisotropy(one, 2).first()["isotropy"] == 1
    assert tuple(geometry.query_corpus_mismatch(v.limit(0), v, 8).first()) == (0, 0)


GRAPH = '''
import numpy as np

class Index:
    """Stands in for the optional library: exact search behind its interface."""

    def __init__(self, space, dim):
        self.rows = {}

    def init_index(self, max_elements, ef_construction, M, random_seed):
        pass

    def add_items(self, vectors, labels):
        self.labels, self.vectors = np.asarray(labels), np.asarray(vectors, float)

    def set_ef(self, ef):
        self.ef = ef

    def knn_query(self, queries, k):
        far = 1 - np.asarray(queries, float) @ self.vectors.T
        order = np.argsort(far, axis=1, kind="stable")[:, :k]
        return self.labels[order].astype(np.uint64), np.take_along_axis(far, order, 1).astype(np.float32)
'''


def test_graph_index_merges_the_partitions(spark, tmp_path, monkeypatch):
    import sys

    rng = np.random.default_rng(8)
    v = rng.standard_normal((60, 6))
    vectors = spark.createDataFrame([(i, [float(x) for x in r]) for i, r in enumerate(v)], "chunk_pos bigint, vector array<double>").repartition(3)
    queries = spark.createDataFrame([(f"q{i}", [float(x) for x in r]) for i, r in enumerate(v[:5])], "query_id string, vector array<double>")
    with pytest.raises(ValueError):
        dense.hnsw_topk(vectors, queries, 3, 6, m=0)
    (tmp_path / "hnswlib.py").write_text(GRAPH)
    spark.sparkContext.addPyFile(str(tmp_path / "hnswlib.py"))
    monkeypatch.syspath_prepend(str(tmp_path))
    rows = lambda df: sorted((r["query_id"], r["rank"], r["chunk_pos"]) for r in df.collect())
    assert rows(dense.hnsw_topk(vectors, queries, 4, 6)) == rows(dense.dense_topk(vectors, queries, 4, 6))
    assert dense.hnsw_topk(vectors.limit(0), queries, 4, 6).count() == 0
    sys.modules.pop("hnswlib", None)


def test_index_sizes_grow_with_the_index():
    assert dense.ann_bytes("exact", 10, 4) == 160 and dense.ann_bytes("none", 10, 4) == 0
    assert dense.ann_bytes("lsh", 10, 4, tables=2) == 160 + 320 and dense.ann_bytes("hnsw", 10, 4, m=8) < dense.ann_bytes("hnsw", 10, 4, m=16)
