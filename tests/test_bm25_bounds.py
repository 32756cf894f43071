import numpy as np

from spanforge.operators import sparse


def test_terms_left_out_lose_no_chunk(spark):
    """Common and rare terms, several batches a task: the same lists as from scores of all chunks."""
    rng = np.random.default_rng(5)
    words = [f"w{i}" for i in range(60)]
    odds = 1 / np.arange(1, 61)
    chunks = [" ".join(rng.choice(words, rng.integers(0, 14), p=odds / odds.sum())) for _ in range(900)]
    queries = [" ".join(rng.choice(words, rng.integers(1, 7))) for _ in range(40)] + ["", "none", "w0", "w0 w1"]
    held = [t.split() for t in chunks]
    avg = np.mean([len(t) for t in held])
    want = set()
    for q, text in enumerate(queries):
        scores = np.zeros(len(chunks))
        for t in sorted(set(text.split())):
            f = np.array([h.count(t) for h in held])
            df = (f > 0).sum()
            idf = np.log(1 + (len(chunks) - df + 0.5) / (df + 0.5))
            scores += idf * f * 2.5 / (f + 1.5 * (0.25 + 0.75 * np.array([len(h) for h in held]) / avg))
        order = np.lexsort((np.arange(len(chunks)), -np.round(scores, 9)))[:7]
        want |= {(q, rank + 1, int(p)) for rank, p in enumerate(x for x in order if scores[x] > 0)}
    c = spark.createDataFrame(list(enumerate(chunks)), "chunk_pos bigint, text string").repartition(2)
    q = spark.createDataFrame(list(enumerate(queries)), "query_id bigint, text string")
    assert {(r["query_id"], r["rank"], r["chunk_pos"]) for r in sparse.bm25_topk(c, q, 7).collect()} == want


def test_common_terms_bring_no_chunk_once_better_ones_are_known():
    from spanforge.operators.topk import TopK

    top, met = TopK(1, 1, 9), []
    top.push_found(np.array([0]), np.array([0]), np.array([5.0]))
    top.settle()
    asked = sparse._Postings(np.array([0, 1, 2]), np.array([0, 0]), np.array([1.0, 6.0]), 1)
    top.push_found = lambda q, p, s: met.extend(p.tolist())
    sparse._score(top, asked, np.array([0, 1, 2, 1]), np.array([0, 0, 0, 1]), np.array([1.0, 1.0, 1.0, 6.0]), np.array([10, 11, 12]))
    assert met == [11]


def test_queries_that_differ_in_rare_terms_share_one_search(spark, monkeypatch):
    """One set of common terms for all queries; chunks are found by it, by a rare term, and by both; the lists are those of all scores."""
    rng = np.random.default_rng(8)
    chunks = [" ".join(rng.choice(["which", "span", "of", "x", "y"], 6)) + (f" r{i % 60}" if i % 5 == 0 else "") for i in range(600)]
    queries = [f"which span of r{i} r{i + 1}" for i in range(40)] + ["which", "r3"]
    made, patterns = [], sparse._patterns
    monkeypatch.setattr(sparse, "_patterns", lambda *a: made.append(patterns(*a)) or made[-1])
    c = spark.createDataFrame(list(enumerate(chunks)), "chunk_pos bigint, text string").repartition(2)
    q = spark.createDataFrame(list(enumerate(queries)), "query_id bigint, text string")
    got = {(r["query_id"], r["rank"], r["chunk_pos"]) for r in sparse.bm25_topk(c, q, 9).collect()}
    assert [x[1][2] for x in made] == [2]
    n, avg, held = len(chunks), np.mean([len(t.split()) for t in chunks]), [t.split() for t in chunks]
    want = set()
    for i, text in enumerate(queries):
        scores = np.zeros(n)
        for t in sorted(set(text.split())):
            f = np.array([h.count(t) for h in held])
            df = (f > 0).sum()
            scores += np.log(1 + (n - df + 0.5) / (df + 0.5)) * f * 2.5 / (f + 1.5 * (0.25 + 0.75 * np.array([len(h) for h in held]) / avg))
        order = np.lexsort((np.arange(n), -np.round(scores, 9)))[:9]
        want |= {(i, rank + 1, int(p)) for rank, p in enumerate(x for x in order if scores[x] > 0)}
    assert got == want


def test_one_pass_gives_the_frequencies_and_sizes_that_columns_give(spark, monkeypatch):
    """Null, empty and wordless texts, repeats in a text, parts that are handed over before the end."""
    monkeypatch.setattr(sparse, "TALLIED", 3)
    texts = ["A b a", None, "", "?! é", "c d e f g", "b-c 7 İ x", "b"]
    chunks = spark.createDataFrame([(t,) for t in texts], "text string").repartition(2)
    n, words, df = 0, 0, {}
    for batches in ([b] for b in chunks.toArrow().to_batches(max_chunksize=2)):
        for part in sparse._tally(batches):
            for r in part.to_pylist():
                if r["term"]:
                    df[r["term"]] = df.get(r["term"], 0) + r["df"]
                else:
                    n, words = n + r["df"], words + r["words"]
    want = sparse.corpus_statistics(chunks).first()
    assert (n, words / n) == (want["n"], want["avgdl"])
    assert df == {r["term"]: r["df"] for r in sparse.document_frequencies(chunks).collect()}
