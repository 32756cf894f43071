import numpy as np
import pytest

from spanforge.functions import jvm
from spanforge.operators import dense
from spanforge.operators.embedding import HashEmbedder

WORDS = "harbor index of vague rows Größe 索引 gauge canal queue".split()


@pytest.mark.parametrize("dim", [8, 512])
@pytest.mark.parametrize("block", [1 << 17, 9])
def test_dense_text_search_in_the_jvm_equals_brute_force(spark, monkeypatch, dim, block):
    """Tiles filled and not, sums beyond 8 and 16 bits, more chunks beyond a byte than meet at a time, equal texts, empty ones; queries in one block and several."""
    monkeypatch.setattr(dense, "COUNT_QUERIES", block)
    monkeypatch.setattr(dense.counts, "searcher", None)  # not by Python
    assert jvm.count_search(spark) is not None
    rng, embed = np.random.default_rng(5), HashEmbedder(dim)
    some = lambda n, most: [" ".join(rng.choice(WORDS, rng.integers(0, most))) for _ in range(n)]
    queries = [*some(20, 9), "", "?", "a" * 400, "harbor " * 200, "harbor  of", "harbor of"]
    chunks = [*some(700, 30), *["a" * n for n in range(300, 340)], "", "b" * 200 + " gauge", "harbor " * 35]
    scores = np.round(embed(queries) @ embed(chunks).T, 6)
    want = {(q, r + 1, int(p)) for q in range(len(queries)) for r, p in enumerate(np.lexsort((np.arange(len(chunks)), -scores[q]))[:7])}
    c = spark.createDataFrame(list(enumerate(chunks)), "chunk_pos bigint, text string").repartition(2)
    q = spark.createDataFrame(list(enumerate(queries)), "query_id bigint, text string")
    assert {(r["query_id"], r["rank"], r["chunk_pos"]) for r in dense.dense_topk_text(c, q, 7, embed).collect()} == want


@pytest.mark.parametrize("sizes,words", [((3, 4, 5), True), ((0, 1, 2, 7), False)])
@pytest.mark.parametrize("block", [1 << 17, 3])
def test_texts_are_hashed_in_the_jvm_as_the_embedder_does(spark, monkeypatch, sizes, words, block):
    """Other scripts, characters beyond 16 bits, case that changes lengths, kinds of space, more characters than have numbers over texts and in one; null texts."""
    monkeypatch.setattr(dense, "COUNT_QUERIES", block)
    given, search = [], jvm.search
    monkeypatch.setattr(jvm, "search", lambda chunks, *a: given.append(chunks.columns) or search(chunks, *a))
    embed = HashEmbedder(1 << 15, sizes, words)
    of = lambda first, n: "".join(map(chr, range(first, first + n)))
    texts = ["İstanbul ΣΑΣ ẞ x1\x1fy z 　w\x85v", "  a\t\r\n b\x0b ", "a b", "😀 naïve 😀😀 ﬁne é", of(0x4E00, 2500), of(0x4E00 + 2500, 2500), of(0xAC00, 3000), of(0x3400, 6000), of(0x4E00 + 900, 40), "", None, "gauge42 gauge 42"]
    plain = [t or "" for t in texts]
    scores = np.round(embed(plain) @ embed(plain).T, 6)
    want = {(q, r + 1, int(p)) for q in range(len(plain)) for r, p in enumerate(np.lexsort((np.arange(len(plain)), -scores[q]))[:6])}
    rows = spark.createDataFrame(list(enumerate(texts)), "chunk_pos bigint, text string").coalesce(1)
    assert {(r["query_id"], r["rank"], r["chunk_pos"]) for r in dense.dense_topk_text(rows, rows.withColumnRenamed("chunk_pos", "query_id"), 6, embed).collect()} == want
    assert given and all(x == ["chunk_pos", "text"] for x in given)


def test_tasks_share_the_bounds_they_have_reached(spark):
    """Chunks of one task that are worse than k of another are not returned once those are known, which they are for sure when the search runs again."""
    embed = HashEmbedder(512)
    texts = [f"harbor index {i}" for i in range(5)] + [f"queue of vague rows {i}" for i in range(5)]
    rows = spark.createDataFrame(list(enumerate(texts)), "chunk_pos bigint, text string").repartitionByRange(2, "chunk_pos").localCheckpoint()
    _, *asked = dense.counts.features(dense.counts.encode(embed, ["harbor index"]), embed.dim)
    found = jvm.search(rows, *asked, embed, 5, dense.counts.SLACK, dense.DIGITS)
    first, again = ({r["chunk_pos"] for r in found.collect()} for _ in range(2))
    assert again == set(range(5)) <= first
