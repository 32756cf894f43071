import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from spanforge.llm import frequency, splitting

KINDS = [["\n\n"], ["\n"], [". ", "! ", "? ", "。", "！", "？"], [" "]]


def plain_pieces(text, limit, overlap, window):
    s, out = 0, []
    while len(text) - s > limit:
        end = s + limit
        for marks in KINDS:
            found = [e for e in range(s + limit - window + 1, s + limit + 1) if any(text[:e].endswith(m) for m in marks)]
            if found:
                end = found[-1]
                break
        out.append((s, end))
        s = end - overlap
    return out + [(s, len(text))]


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="ab. \n!。", min_size=1, max_size=150))
def test_full_placement_is_the_definition(text):
    assert splitting.full_pieces(text, 20, 3, 10) == plain_pieces(text, 20, 3, 10)


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="ab. \n!。", min_size=41, max_size=300))
def test_balanced_pieces_meet_the_limit(text):
    pieces = splitting.balanced_pieces(text, 40, 5, 8)
    assert pieces[0][0] == 0 and pieces[-1][1] == len(text)
    assert all(0 < e - s <= 40 for s, e in pieces) and all(b[0] == a[1] - 5 for a, b in zip(pieces, pieces[1:]))


def test_balanced_pieces_are_even():
    sizes = [e - s for s, e in splitting.balanced_pieces("word " * 1000, 1500, 150, 200)]
    assert max(sizes) - min(sizes) < 200 and len(sizes) == 4


def test_split_frame(spark):
    texts = ["x" * 1500, "x" * 1501, None, "", "Sätze. " * 400, "漢字。" * 1000]
    df = spark.createDataFrame([(i, t, 5) for i, t in enumerate(texts)] + [(None, "y " * 900, 1), (4, texts[4], 5)], "doc_id bigint, text string, piece_start int")
    got = splitting.split_oversized(df, placement="full")
    assert got.columns == ["doc_id", "piece_start", "piece_end"]
    by = defaultdict(list)
    for r in got.collect():
        by[r["doc_id"]].append((r["piece_start"], r["piece_end"]))
    assert set(by) == {1, 4, 5, None}
    for i in (1, 5):
        assert sorted(by[i]) == plain_pieces(texts[i], 1500, 150, 750)
    assert Counter(by[4]) == {p: 2 for p in plain_pieces(texts[4], 1500, 150, 750)}
    assert splitting.split_oversized(df.limit(0)).count() == 0
    short = splitting.split_oversized(df, keep_short=True)
    assert {r["doc_id"] for r in short.collect()} == {0, 1, 4, 5, None}
    for bad in (dict(overlap=800), dict(placement="odd"), dict(window=-1)):
        with pytest.raises(ValueError):
            splitting.split_oversized(df, **bad)


RECORDS = [("r1", "The cat, the CAT and the dog."), ("r2", "the cat"), ("r2", "the cat"), ("r3", None), ("r3", None), ("r4", ""), (None, "ghost cat"), ("r5", "café 42 x2"), ("r6", "dog dog dog"), ("r7", "a b"), ("r7", "b c")]


def brute(rows, max_n):
    texts = defaultdict(set)
    for r, t in rows:
        if r is not None:
            texts[r].add(t)
    occ, docs = Counter(), defaultdict(set)
    for r, ts in texts.items():
        for t in ts:
            w = re.findall("[a-z0-9]+", (t or "").lower())
            for n in range(1, max_n + 1):
                for i in range(len(w) - n + 1):
                    g = " ".join(w[i : i + n])
                    occ[n, g] += 1
                    docs[n, g].add(r)
    return {k: (occ[k], len(docs[k])) for k in occ}, len(texts)


@pytest.mark.parametrize("block", [5, 8_000_000])
def test_ngram_counts(spark, block):
    df = spark.createDataFrame([(r, t, 1, "x") for r, t in RECORDS], "chunk_id string, text string, n int, term string")
    rows = frequency.ngram_frequencies(df, "chunk_id", "text", 3, block).collect()
    want, n = brute(RECORDS, 3)
    assert {(r["n"], r["term"]): (r["occurrences"], r["records"]) for r in rows if r["n"]} == want
    assert [r["records"] for r in rows if not r["n"]] == [n]


def test_marks(spark):
    df = spark.createDataFrame(RECORDS, "chunk_id string, text string")
    got = {r["term"]: r["mark"] for r in frequency.term_frequencies(df, common_from=0.25).collect()}
    assert got["cat"] == "rare" and "ghost" not in got
    got = {r["term"]: r["mark"] for r in frequency.term_frequencies(df, rare_at_most=1, common_from=0.25).collect()}
    assert got["cat"] == got["dog"] == "common" and got["42"] == "rare"
    assert frequency.term_frequencies(df.limit(0)).count() == 0
    with pytest.raises(ValueError):
        frequency.ngram_frequencies(df, "chunk_id", "text", 0)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.lists(st.integers(0, 3), max_size=8), min_size=1, max_size=6), st.integers(1, 4))
def test_interval_counts(records, max_n):
    flat = [t for r in records for t in r]
    if not flat:
        return
    sizes = np.array([len(r) for r in records])
    owner = np.repeat(np.arange(len(records)), sizes)
    left = np.repeat(np.cumsum(sizes), sizes) - np.arange(len(flat))
    tokens = np.array(flat)
    got = {}
    for n, first, occ, docs in frequency.interval_counts(tokens, owner, left, max_n):
        for p, o, d in zip(first, occ, docs):
            got[tuple(tokens[p : p + n].tolist())] = (o, d)
    occ, docs = Counter(), defaultdict(set)
    for i, r in enumerate(records):
        for n in range(1, max_n + 1):
            for j in range(len(r) - n + 1):
                occ[tuple(r[j : j + n])] += 1
                docs[tuple(r[j : j + n])].add(i)
    assert got == {k: (v, len(docs[k])) for k, v in occ.items()}


def test_suffix_array_is_sorted():
    tokens = np.array([2, 1, 2, 1, 0, 2, 1])
    left = np.array([7, 6, 5, 4, 3, 2, 1])
    order = frequency.suffix_array(tokens, left, 7)
    suffixes = [tokens[i:].tolist() for i in order]
    assert suffixes == sorted(suffixes)


def test_hot_record_is_merged_before_the_shuffle(spark):
    df = spark.createDataFrame([("hot", "same text")] * 3000 + [(f"r{i}", "other words") for i in range(10)], "chunk_id string, text string").repartition(3)
    plan = frequency.distinct_records(df, "chunk_id", "text")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ObjectHashAggregate") == 2
    got = {r["term"]: r["records"] for r in frequency.term_frequencies(df).collect()}
    assert got == {"same": 1, "text": 1, "other": 10, "words": 10}
