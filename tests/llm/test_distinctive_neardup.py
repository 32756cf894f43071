import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from spanforge.llm import distinctive, neardup

CHUNKS = [("c1", "Zebra crossing the road"), ("c2", "the road the road"), ("c3", None), ("c3", None), ("c4", ""), ("c5", "a zebra and a lion"), ("c1", "Zebra crossing the road"), (None, "zebra")]
QUERIES = [("q1", "zebra crossing?"), ("q1", "zebra crossing?"), ("q2", "the road"), ("q3", ""), ("q4", None), (None, "zebra"), ("q5", "unheard words lion"), ("q6", "Road, road, ROAD lion")]


def words(t):
    return re.findall("[a-z0-9]+", (t or "").lower())


def brute_matches(chunks, queries, share=0.5):
    held = defaultdict(set)
    for c, t in chunks:
        if c is not None:
            held[c] |= set(words(t))
    n, df = len(held), Counter(t for s in held.values() for t in s)
    out = set()
    for q, t in queries:
        terms = set(words(t))
        if q is None or not terms:
            continue
        w = {x: math.log((n + 1) / (df[x] + 1)) for x in terms}
        out |= {(q, c) for c, s in held.items() if s & terms and sum(w[x] for x in s & terms) >= share * sum(w.values()) - 1e-9}
    return out


def frames(spark, chunks, queries):
    c = spark.createDataFrame([(a, b, "x", 1.0) for a, b in chunks], "chunk_id string, text string, term string, weight double")
    q = spark.createDataFrame([(a, b, "x") for a, b in queries], "id string, text string, query string")
    return c, q


@pytest.mark.parametrize("limit", [0, 1000])
def test_matches(spark, limit):
    c, q = frames(spark, CHUNKS, QUERIES)
    got = distinctive.match_records(c, q, broadcast_terms=limit)
    assert got.columns == ["query_id", "chunk_id"]
    rows = [tuple(r) for r in got.collect()]
    assert len(rows) == len(set(rows)) and set(rows) == brute_matches(CHUNKS, QUERIES)


@pytest.mark.parametrize("limit", [0, 1000])
def test_matches_on_random_collections(spark, limit):
    rng = random.Random(3)
    vocabulary = [f"w{i}" for i in range(30)]
    text = lambda k: " ".join(rng.choices(vocabulary, weights=[1 / (i + 1) for i in range(30)], k=k))
    chunks = [(f"c{i}", text(rng.randint(0, 12))) for i in range(80)]
    queries = [(f"q{i}", text(rng.randint(0, 5))) for i in range(30)]
    c, q = frames(spark, chunks, queries)
    assert {tuple(r) for r in distinctive.match_records(c, q, broadcast_terms=limit).collect()} == brute_matches(chunks, queries)


def test_matches_of_empty_tables(spark):
    c, q = frames(spark, CHUNKS, QUERIES)
    assert distinctive.match_records(c.limit(0), q).count() == 0 and distinctive.match_records(c, q.limit(0)).count() == 0


def test_record_weights(spark):
    c, _ = frames(spark, CHUNKS, [])
    got = {(r["record"], r["term"]): (r["count"], r["weight"]) for r in distinctive.term_record_weights(c, alpha=0.75).collect()}
    rec = {"c1": words(CHUNKS[0][1]), "c2": words(CHUNKS[1][1]), "c5": words(CHUNKS[5][1])}
    total = sum(len(w) ** 0.75 for w in rec.values())
    n = Counter(t for w in rec.values() for t in w)
    want = {}
    for r, w in rec.items():
        for t, k in Counter(w).items():
            pmi = math.log(k * total / (n[t] * len(w) ** 0.75))
            if pmi > 0:
                want[r, t] = (k, pytest.approx(pmi))
    assert got == want
    joined = {(r["record"], r["term"]): (r["count"], r["weight"]) for r in distinctive.term_record_weights(c, broadcast_vocabulary=0).collect()}
    assert joined == want
    assert max(r["rank"] for r in distinctive.term_record_weights(c, top=2).collect()) == 2


def test_collection_weights(spark):
    c, _ = frames(spark, CHUNKS, [])
    got = {r["term"]: (r["records"], r["weight"]) for r in distinctive.collection_weights(c).collect()}
    assert got["zebra"] == (2, pytest.approx(math.log(6 / 3))) and got["lion"] == (1, pytest.approx(math.log(6 / 2)))


def shingles(t, k):
    w = re.findall(r"\w+", (t or "").lower())
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)}, len(w)


def brute_pairs(rows, k, threshold, least):
    sets = {d: s for d, t in rows if d is not None for s, n in [shingles(t, k)] if n >= max(least, k)}
    ids = sorted(sets)
    return {(a, b) for i, a in enumerate(ids) for b in ids[i + 1 :] if len(sets[a] & sets[b]) >= threshold * len(sets[a] | sets[b]) - 1e-12}


def corpus(seed=0, n=60):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(200)] + ["über", "漢字", "x_1"]
    rows, base = [], []
    for i in range(n):
        w = rng.choices(vocabulary, k=rng.randint(15, 70))
        base.append(w)
        rows.append((i, " ".join(w)))
    for i in range(n, 2 * n):
        w = list(rng.choice(base))
        for _ in range(rng.randint(0, 6)):
            at = rng.randrange(len(w))
            w[at : at + 1] = rng.choice([[], ["edited"], [w[at], "added"]])
        rows.append((i, " ".join(w)))
    rows += [(1000 + i, rows[0][1]) for i in range(8)] + [(2000, None), (2001, ""), (2002, "one two"), (None, rows[0][1]), (3000, "dup " * 60), (3001, "dup " * 70), (0, rows[0][1])]
    return rows


@pytest.mark.parametrize("k,threshold,hot,shared,limit", [(3, 0.7, 4096, 3, 10**6), (3, 0.7, 2, 3, 0), (5, 0.8, 3, 1, 10**6), (2, 0.5, 4, 2, 0)])
def test_pairs_equal_brute_force(spark, k, threshold, hot, shared, limit):
    rows = corpus(k)
    df = spark.createDataFrame([(d, t, 1, "x") for d, t in rows], "doc_id bigint, text string, key int, doc string").repartition(3)
    members, links = neardup.near_duplicate_classes(df, words=k, threshold=threshold, min_words=15, hot=hot, shared=shared, broadcast_ids=limit)
    got = [tuple(r) for r in neardup.near_duplicate_pairs(members, links).collect()]
    want = brute_pairs(rows, k, threshold, 15)
    assert len(got) == len(set(got)) and set(got) == want and len(want) > 30
    assert links.select("a", "b").distinct().count() == links.count()
    groups = {r["doc"]: r for r in neardup.near_duplicate_groups(members, links).collect()}
    degree = Counter(x for p in want for x in p)
    assert {d: r["copies"] + r["links"] for d, r in groups.items()} == {d: degree[d] for d in groups}
    assert groups[1003]["class_id"] == groups[0]["class_id"] == 0


def test_near_duplicates_of_empty_tables(spark):
    df = spark.createDataFrame([], "doc_id bigint, text string")
    members, links = neardup.near_duplicate_classes(df)
    assert members.count() == links.count() == 0
    assert neardup.near_duplicate_pairs(members, links).count() == 0 and neardup.near_duplicate_groups(members, links).count() == 0


@settings(max_examples=60, deadline=None)
@given(st.lists(st.sets(st.integers(0, 25), min_size=1, max_size=20), min_size=2, max_size=12), st.sampled_from([0.5, 0.7, 0.9]), st.integers(1, 3))
def test_prefixes_lose_no_pair(sets, threshold, shared):
    count = Counter(x for s in sets for x in s)
    cols = [[] for _ in range(6)]
    for key, s in enumerate(sets):
        order = sorted(s, key=lambda x: (count[x], x))[: neardup.prefix_length(len(s), threshold, shared)]
        for pos, g in enumerate(order):
            for c, v in zip(cols, (g, -1, 2, pos, key, len(s))):
                c.append(v)
    kinds = (np.uint64, np.int32, np.int8, np.int32, np.int64, np.int32)
    found = list(neardup.candidate_pairs(*(np.array(c, k) for c, k in zip(cols, kinds)), threshold, shared, most=3))
    times: Counter = Counter()
    for a, b, t in found:
        for x, y, z in zip(a.tolist(), b.tolist(), t.tolist()):
            times[x, y] += z
    candidates = {p for p, t in times.items() if t >= shared}
    true = {(i, j) for i in range(len(sets)) for j in range(i + 1, len(sets)) if len(sets[i] & sets[j]) >= threshold * len(sets[i] | sets[j]) - 1e-9}
    assert true <= candidates


def test_packing_round_trip():
    rng = np.random.default_rng(0)
    cols = [rng.integers(0, 99, 50).astype(k) for k in neardup._POSTING]
    parts = rng.integers(0, 4, 50).astype(np.int32)
    values, blobs = neardup.pack(parts, cols)
    back = neardup.unpack(blobs, neardup._POSTING)
    order = np.argsort(parts, kind="stable")
    assert all((b == c[order]).all() for b, c in zip(back, cols)) and values.tolist() == sorted(set(parts.tolist()))
