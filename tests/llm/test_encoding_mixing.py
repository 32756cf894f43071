import os
import random
from collections import Counter

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from spanforge.llm import encoding, mixing

pytestmark = pytest.mark.skipif(not os.path.exists(encoding.DEFAULT_VOCABULARY), reason="no vocabulary files")
TEXTS = ["", None, " ", "It's 3.14 o'clock — don’t", "漢字かな交じり文。次の文！" * 30, "<|endoftext|> is ordinary", "a" * 5000, "🙂👩‍🔬" * 200, "word " * 3000, "\r\n\t \x00 　x  y   z    ", "we'll 'tis ''s 's's 123abc 'LL 've"]


@pytest.fixture(scope="module")
def encoder():
    return encoding.load_encoder()


@settings(max_examples=400, deadline=None)
@given(st.text(alphabet="ab's tre l1 2.,!漢。 \n\t　é'", max_size=60), st.integers(1, 9))
def test_tree_equals_direct(text, leaf):
    e = encoding.load_encoder().encode_ordinary
    assert encoding.encode_tree(text, e, leaf) == e(text)


@settings(max_examples=200, deadline=None)
@given(st.text(max_size=80), st.integers(1, 16))
def test_tree_equals_direct_on_any_text(text, leaf):
    text = text.encode("utf-8", "ignore").decode("utf-8")
    encoder = encoding.load_encoder()
    ids = encoding.encode_tree(text, encoder.encode_ordinary, leaf)
    assert ids == encoder.encode_ordinary(text) and encoding.decode_tree(ids, encoder, 3) == text


@pytest.mark.parametrize("leaf", [7, 64, 4096])
def test_long_texts(encoder, leaf):
    for t in TEXTS:
        if t:
            assert encoding.encode_tree(t, encoder.encode_ordinary, leaf) == encoder.encode_ordinary(t)


def test_frames(spark, encoder):
    rows = [(i, t, "x", t) for i, t in enumerate(TEXTS)] + [(None, "null id", "x", None), (3, TEXTS[3], "x", None)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, ids string, k string")
    got = encoding.encode_documents(df, leaf_chars=50)
    assert got.columns == ["doc_id", "ids"] and got.count() == len(rows)
    by = {r["doc_id"]: r["ids"] for r in got.collect()}
    assert by[0] == by[1] == [] and by[3] == encoder.encode_ordinary(TEXTS[3]) and 50256 not in by[5]
    back = {r["doc_id"]: r["text"] for r in encoding.decode_documents(got).collect()}
    assert all(back[i] == (t or "") for i, t in enumerate(TEXTS))
    assert encoding.encode_documents(df.limit(0)).count() == 0
    counts = {r["doc_id"]: r["n_tokens"] for r in encoding.count_tokens(df, "text", ["doc_id", "ids"]).collect()}
    assert counts[3] == len(by[3]) and counts[1] == 0
    assert "Exchange" not in got._jdf.queryExecution().executedPlan().toString()


SOURCES = {"a": 40, "b": 200, "c": 5, "d": 60}
TARGETS = [("a", 0.3, 3), ("b", 0.2, 1), ("C ", 0.4, 2), ("none", 0.1, 4)]


@pytest.fixture(scope="module")
def mixed(spark):
    rng = random.Random(1)
    rows = [(i, "word " * rng.randint(1, 30), s if i % 3 else f" {s.upper()}\t", 1.0) for i, s in enumerate(s for s, n in SOURCES.items() for _ in range(n))]
    rows += [(9001, None, "a", 1.0), (9002, "", "b", 1.0), (9003, "lost words", None, 1.0)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, source string, target_share double")
    targets = spark.createDataFrame(TARGETS, "source string, target_share double, max_repeats int")
    sizes, plan = mixing.prepare(docs, targets)
    return docs, targets, sizes, plan, mixing.mix_documents(sizes, plan)


def test_plan(mixed, encoder):
    docs, _, _, plan, _ = mixed
    size = Counter()
    for r in docs.collect():
        if r["source"]:
            size[r["source"].strip().lower()] += len(encoder.encode_ordinary(r["text"] or ""))
    total = size["a"] + size["b"] + size["c"]
    for r in plan.collect():
        a = size[r["name"]]
        w = r["target_share"] * total
        assert (r["available"], r["wanted"]) == (a, pytest.approx(w))
        assert r["outcome"] == ("trimmed" if w <= a else "repeated" if w <= r["max_repeats"] * a else "short")
    assert {r["source"] for r in plan.collect()} == {t[0] for t in TARGETS}


def test_mix_respects_limits(mixed):
    _, _, sizes, plan, mix = mixed
    limits = {r["name"]: r for r in plan.collect()}
    used, copies = Counter(), Counter()
    largest = sizes.agg(F.max("n_tokens")).first()[0]
    rows = mix.collect()
    for r in rows:
        used[r["name"]] += r["n_tokens"]
        copies[r["name"], r["doc"]] += 1
    assert set(used) == {"a", "b", "c"}
    for n, u in used.items():
        assert abs(u - limits[n]["limit"]) <= largest
    assert all(c <= limits[n]["max_repeats"] for (n, _), c in copies.items())
    assert all(0 <= r["position"] <= 1 for r in rows)
    positions = [r["position"] for r in rows]
    assert positions == sorted(positions) and len({(r["doc"], r["pass"]) for r in rows}) == len(rows)


def test_schedule_moves_sources(mixed):
    _, _, sizes, plan, _ = mixed
    early = mixing.mix_documents(sizes, plan, slope=F.when(F.col("name") == "b", F.lit(-0.5)).otherwise(F.lit(0.5)))
    mean = {r["name"]: r["m"] for r in early.groupBy("name").agg((F.sum(F.col("position") * F.col("n_tokens")) / F.sum("n_tokens")).alias("m")).collect()}
    assert mean["b"] < 0.42 and mean["a"] > 0.5 and mean["c"] > 0.5


@pytest.mark.parametrize("slope", [0, 1])
def test_a_position_is_the_share_of_tokens_before_it(mixed, slope):
    _, _, sizes, plan, mix = mixed
    if slope:
        mix = mixing.mix_documents(sizes, plan, slope=F.when(F.col("name") == "b", F.lit(-0.5)).otherwise(F.lit(0.5)))
    rows = mix.collect()
    total, before = sum(r["n_tokens"] for r in rows), 0
    for r in rows:
        assert abs(before / total - r["position"]) < 0.02
        before += r["n_tokens"]


def test_report(mixed):
    _, _, _, plan, mix = mixed
    rows = {r["source"]: r for r in mixing.mix_report(mix, plan).collect()}
    assert sum(r["actual_share"] for r in rows.values()) == pytest.approx(1) and rows["none"]["tokens_used"] == 0 and rows["a"]["passes"] >= 1
    want = {r["source"]: (r["outcome"], max(0, r["wanted"] - r["limit"])) for r in plan.collect()}
    assert {k: (r["outcome"], r["deficit"]) for k, r in rows.items()} == want


@pytest.mark.parametrize("share,most,want", [(1.0, 3, "trimmed"), (1.0, 0, "trimmed"), (1.5, 1, "short"), (1.5, 2, "repeated"), (2.0, 2, "repeated"), (2.0001, 2, "short"), (1.0001, 2, "repeated"), (0.0, 2, "trimmed")])
def test_outcome_at_the_edges(spark, share, most, want):
    sizes = spark.createDataFrame([(i, "a", 10) for i in range(9)], "doc bigint, name string, n_tokens bigint")
    targets = spark.createDataFrame([("a", share, most)], "source string, target_share double, max_repeats int")
    plan = mixing.mix_plan(sizes, targets)
    assert mixing.mix_report(mixing.mix_documents(sizes, plan), plan).first()["outcome"] == want == plan.first()["outcome"]


def test_mixing_without_documents(spark):
    docs = spark.createDataFrame([], "doc_id bigint, text string, source string")
    targets = spark.createDataFrame([("x", None, None), ("y", 0.5, 2)], "source string, target_share double, max_repeats int")
    sizes, plan = mixing.prepare(docs, targets)
    assert {r["outcome"] for r in plan.collect()} == {"trimmed"}
    mix = mixing.mix_documents(sizes, plan)
    assert mix.count() == 0 and mixing.mix_report(mix, plan).count() == 2


def test_buckets_do_not_change_the_mix(mixed, monkeypatch):
    _, _, sizes, plan, mix = mixed
    monkeypatch.setattr(mixing, "ROWS_PER_BUCKET", 10)
    again = mixing.mix_documents(sizes, plan)
    count = lambda m: {r["name"]: r["u"] for r in m.groupBy("name").agg(F.sum("n_tokens").alias("u")).collect()}
    a, b = count(mix), count(again)
    assert set(a) == set(b) and all(abs(a[k] - b[k]) <= 60 for k in a)
