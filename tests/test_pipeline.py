import pytest

from spanforge.operators import ranking
from spanforge.operators.embedding import EmbeddingStore, HashEmbedder
from spanforge.plans import pipeline as P
from spanforge.plans import sweep as S
from spanforge.plans.session import blocks
from spanforge.sources import corpora, tables


@pytest.fixture(scope="module")
def data(spark):
    c = corpora.basic(spark)
    maker = S.make_chunker("parentchild:60x25")
    return maker.chunk(c.documents).cache(), maker.parents(c.documents).cache(), c.queries.cache()


def test_stages_exist_by_configuration(data):
    chunks, _, queries = data
    e = HashEmbedder(128)
    exact, near, words = P.DenseRetriever(e).index(chunks), P.ApproximateRetriever(e, S.Config("e", "c", "dense", dense_index="lsh", bits=2)).index(chunks), P.Bm25Retriever().index(chunks)
    run = lambda **kw: P.run_pipeline(chunks, queries, S.Config("e", "c", top_k=2, candidate_n=6, **kw), exact, None, words, ranking.lexical_overlap)
    base = {"candidate_union", "pre_final", "final"}
    assert set(run(retrieval="dense").stages) == base | {"dense_candidates"}
    assert set(run(retrieval="sparse").stages) == base | {"sparse_candidates"}
    out = run(retrieval="hybrid", rerank="lexical", budget_tokens=0)
    assert set(out.stages) == base | {"dense_candidates", "sparse_candidates", "fused", "reranker_input", "reranked", "budget_packed"}
    assert out.of("budget_packed").count() == 0 and out.of("exact_candidate_union") is None
    ann = P.run_pipeline(chunks, queries, S.Config("e", "c", "hybrid", top_k=2, candidate_n=6, dense_index="lsh"), near, exact, words)
    assert "exact_candidate_union" in ann.stages and ann.of("final").groupBy("query_id").count().where("count > 2").count() == 0


def test_expansion_returns_parents(data):
    chunks, parents, queries = data
    out = P.run_pipeline(chunks, queries, S.Config("e", "c", "sparse", top_k=2, candidate_n=6, budget_tokens=20), sparse_retriever=P.Bm25Retriever().index(chunks), parents=parents)
    ids = {r["chunk_id"] for r in parents.collect()}
    assert {r["chunk_id"] for r in out.items.collect()} <= ids


def test_missing_components(data):
    chunks, _, queries = data
    for kw in (dict(retrieval="dense"), dict(retrieval="sparse"), dict(retrieval="hybrid")):
        with pytest.raises(ValueError):
            P.run_pipeline(chunks, queries, S.Config("e", "c", **kw))
    with pytest.raises(ValueError):
        P.run_pipeline(chunks, queries, S.Config("e", "c", "sparse", rerank="x"), sparse_retriever=P.Bm25Retriever().index(chunks))
    with pytest.raises(P.NotIndexed):
        P.Bm25Retriever().retrieve(queries, 3)


def test_store_embeds_each_text_once(spark, tmp_path):
    calls = str(tmp_path / "calls")

    def embed(texts):
        with open(calls, "a") as f:
            f.write("".join(t + "\n" for t in texts))
        return HashEmbedder(32)(texts)

    store = EmbeddingStore(str(tmp_path / "vectors"))
    df = spark.createDataFrame([(1, "a b"), (2, "a b"), (3, None), (4, "c")], "id int, text string")
    first = {r["id"]: r["vector"] for r in store.embed(df, "text", embed, "m").collect()}
    again = {r["id"]: r["vector"] for r in store.embed(df.union(spark.createDataFrame([(5, "d")], df.schema)), "text", embed, "m").collect()}
    assert sorted(open(calls).read().split("\n")[:-1]) == ["a b", "c", "d"]
    assert first[1] == first[2] == again[1] and first[3] is None and len(again) == 5
    store.embed(df, "text", embed, "other").collect()
    assert len(open(calls).read().split("\n")) == 6


def test_meta_survives(spark, tmp_path):
    p = tmp_path / "d.jsonl"
    p.write_text('{"id": "1", "text": "x", "meta": {"lang": "en", "n": 1}}\n{"id": "2", "text": "y", "meta": {}}\n{"id": "3", "text": "z"}\n')
    docs = tables.load_documents(spark, str(p))
    out = tables.write_documents_jsonl(docs, str(tmp_path / "o.jsonl"))
    assert open(out).read().split("\n")[:-1] == ['{"id": "1", "text": "x", "meta": {"lang": "en", "n": 1}}', '{"id": "2", "text": "y"}', '{"id": "3", "text": "z"}']


def test_blocks_cover_everything_once(spark):
    df = spark.range(1000).withColumnRenamed("id", "k")
    parts = list(blocks(df, "k", 300))
    assert len(parts) == 4 and sorted(r["k"] for p in parts for r in p.collect()) == list(range(1000))
    assert list(blocks(df.limit(0), "k", 5)) == []
