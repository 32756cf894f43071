import numpy as np
import pytest

from spanforge.operators import counts, dense
from spanforge.operators.embedding import HashEmbedder
from spanforge.operators.topk import TopK

WORDS = "harbor index of vague rows Größe 索引 gauge canal queue".split()


def texts(n, seed):
    rng = np.random.default_rng(seed)
    return [" ".join(rng.choice(WORDS, rng.integers(0, 12))) for _ in range(n)]


def exact(embed, queries, chunks, k):
    scores = np.round(embed(queries) @ embed(chunks).T, 6)
    return {(q, rank + 1, int(p)) for q in range(len(queries)) for rank, p in enumerate(np.lexsort((np.arange(len(chunks)), -scores[q]))[:k])}


def frames(spark, queries, chunks):
    c = spark.createDataFrame(list(enumerate(chunks)), "chunk_pos bigint, text string").repartition(3)
    return c, spark.createDataFrame(list(enumerate(queries)), "query_id bigint, text string")


def rows(df):
    return {(r["query_id"], r["rank"], r["chunk_pos"]) for r in df.collect()}


def test_slots_of_many_texts_are_those_of_each():
    embed = HashEmbedder(256)
    some = [*texts(40, 1), "", "a", "ß  İ\tx", "a" * 300, "".join(map(chr, range(0x4E00, 0x4E00 + 5000)))]
    for part in (some[:-1], some):  # the last has more different characters than are numbered
        assert (counts.count_matrix(*embed.slots_many(part), 256) == np.array([embed.counts(t) for t in part])).all()
        again = counts.decode(counts.encode(embed, part), 256)
        assert (counts.count_matrix(*again, 256) == np.array([embed.counts(t) for t in part])).all()


def test_integer_products_are_exact():
    rng = np.random.default_rng(2)
    a, b = rng.integers(1, 256, (70, 300)).astype(np.uint8), rng.integers(-127, 128, (300, 50)).astype(np.int8)
    assert (counts.product()(a, b) == (a.astype(np.int64) - 128) @ b.astype(np.int64)).all()


@pytest.mark.parametrize("small_blocks", [False, True])
def test_text_search_over_counts_equals_brute_force(spark, monkeypatch, small_blocks):
    """With equal texts, empty ones and counts beyond eight bits on both sides; in one block of queries and in several."""
    if small_blocks:
        monkeypatch.setattr(dense, "COUNT_QUERIES", 10)
    embed = HashEmbedder(128)
    queries, chunks = [*texts(30, 3), "", "?", "a" * 400], [*texts(200, 4), "a" * 500, "", "b" * 200 + " gauge"]
    c, q = frames(spark, queries, chunks)
    assert rows(dense.dense_topk_text(c, q, 7, embed)) == exact(embed, queries, chunks, 7)


def test_rows_tied_with_the_last_place_do_not_pile_up():
    top = TopK(1, 2, 6, buffer=10)
    top.push(0, np.zeros((1, 8)), np.arange(8))
    top._cut()
    for lo in range(8, 800, 8):
        top.push(0, np.zeros((1, 8)), np.arange(lo, lo + 8))
    assert top.size == 2 and top.best()[1].tolist() == [0, 1]


def test_buckets_of_texts_are_those_of_their_vectors(spark):
    embed = HashEmbedder(64)
    queries, chunks = [*texts(25, 6), ""], [*texts(150, 7), "", "a" * 500]
    c, q = frames(spark, queries, chunks)
    vectors = lambda df, key: spark.createDataFrame([(r[key], [float(x) for x in embed([r["text"]])[0]]) for r in df.collect()], f"{key} bigint, vector array<double>")
    by_join = dense.lsh_topk(vectors(c, "chunk_pos"), vectors(q, "query_id"), 5, 64, tables=2, bits=4, probes=2)
    assert rows(dense.lsh_topk_text(c, q, 5, embed, tables=2, bits=4, probes=2)) == rows(by_join)


def test_ngrams_that_share_a_place_keep_their_own_slots(monkeypatch):
    from spanforge.operators import embedding

    monkeypatch.setattr(embedding, "_PLACE_BITS", 4)
    monkeypatch.setattr(embedding, "_KNOWN", 300)
    embed = HashEmbedder(64)
    for seed in range(4):  # most n-grams find their place taken, and what is remembered is dropped
        some = texts(30, seed)
        assert (counts.count_matrix(*embed.slots_many(some), 64) == np.array([embed.counts(t) for t in some])).all()


@pytest.mark.parametrize("by_library", [True, False])
def test_tiles_of_chunks_of_like_norms_keep_the_best(monkeypatch, by_library):
    """Tiles smaller than the inputs, negative cosines, zero rows, ties; with the library's product, packed once for many queries, and with floats."""
    monkeypatch.setattr(counts, "TILE", 8)
    monkeypatch.setattr(counts, "COLUMNS", 16)
    if not by_library:
        monkeypatch.setattr(counts, "eight_bit_product", lambda: None)
    monkeypatch.setattr(counts, "worker_cache", lambda key, make: make())
    dim, rng = 16, np.random.default_rng(9)
    queries, chunks = rng.integers(-3, 4, (30, dim)), rng.integers(-3, 4, (200, dim)) * rng.integers(0, 30, (200, 1))
    slots = [np.concatenate([np.repeat(np.flatnonzero(q > 0), q[q > 0]), dim + np.repeat(np.flatnonzero(q < 0), -q[q < 0])]).astype(counts.slot_bytes(dim)).tobytes() for q in queries]
    asked, at = counts.Asked(slots, dim, 150, 6), rng.permutation(200)
    for lo in (0, 100):
        counts.push_all(asked, chunks[lo : lo + 100].astype(np.int32), at[lo : lo + 100])
    q, p, _ = asked.best()
    unit = lambda x: x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-9)
    scores = np.round(unit(queries) @ unit(chunks).T, 6) + 0.0
    want = {(i, int(at[j])) for i in range(30) for j in np.lexsort((at, -scores[i]))[:150]}
    assert set(zip(q.tolist(), p.tolist())) == want


def test_one_set_of_chunks_meets_many_queries():
    rng = np.random.default_rng(3)
    b = rng.integers(-127, 128, (300, 50)).astype(np.int8)
    times = counts.multiplier()(b)
    for n in (70, 5, 70):
        a = rng.integers(1, 256, (n, 300)).astype(np.uint8)
        assert (times(a) == (a.astype(np.int64) - 128) @ b.astype(np.int64)).all()
