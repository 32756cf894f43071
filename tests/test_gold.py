import pytest
from pyspark.sql import functions as F

from spanforge.operators import attribution, gold
from spanforge.sources.tables import GOLD

SPAN = "query_id string, alt_idx int, span_idx int, span_id string, source_id string, start int, end int, quoted_text string, source_version string"


def spans(spark, *rows):
    return spark.createDataFrame([(q, a, i, f"{s}{b}-{e}", s, b, e, "", None) for q, a, i, s, b, e in rows], SPAN)


def items(spark, *rows):
    return spark.createDataFrame(list(rows), "query_id string, rank int, source_id string, start int, end int")


def test_coverage_unites_intervals(spark):
    s = spans(spark, ("q", 0, 0, "D", 0, 10))
    got = gold.span_coverage(items(spark, ("q", 1, "D", 0, 4), ("q", 2, "D", 2, 6), ("q", 3, "E", 0, 10)), s, []).first()
    assert got["coverage"] == 0.6 and got["best_single"] == 0.4


@pytest.mark.parametrize("end,hit", [(8, True), (7, False)])
def test_threshold_is_inclusive(spark, end, hit):
    s, i = spans(spark, ("q", 0, 0, "D", 0, 10)), items(spark, ("q", 1, "D", 0, end))
    groups = spark.createDataFrame([("q",), ("other",)], "query_id string")
    got = {r["query_id"]: r["hit"] for r in gold.satisfied(gold.span_coverage(i, s, []), s, groups, []).collect()}
    assert got == {"q": hit, "other": False}


def test_all_spans_of_any_alternative(spark):
    s = spans(spark, ("q", 0, 0, "D", 0, 10), ("q", 0, 1, "E", 0, 10), ("q", 1, 0, "F", 0, 10))
    groups = spark.createDataFrame([("q",)], "query_id string")
    hit = lambda *i: gold.satisfied(gold.span_coverage(items(spark, *i), s, []), s, groups, []).first()["hit"]
    assert not hit(("q", 1, "D", 0, 10))
    assert hit(("q", 1, "D", 0, 10), ("q", 2, "E", 0, 9))
    assert hit(("q", 1, "F", 0, 10))


def test_completion_rank(spark):
    s = spans(spark, ("q", 0, 0, "D", 0, 10), ("q", 0, 1, "E", 0, 10), ("r", 0, 0, "Z", 0, 5))
    i = items(spark, ("q", 1, "D", 0, 5), ("q", 2, "E", 0, 10), ("q", 3, "X", 0, 9), ("q", 4, "D", 5, 10), ("r", 1, "D", 0, 5))
    assert {r["query_id"]: r["rank"] for r in gold.completion_rank(i, s, []).collect()} == {"q": 4}


def test_fragmented(spark):
    s = spans(spark, ("q", 0, 0, "D", 0, 10))
    c = gold.span_coverage(items(spark, ("q", 1, "D", 0, 5), ("q", 2, "D", 5, 10)), s, [])
    assert gold.fragmented(c, []).count() == 1


def test_verification_reasons(spark):
    docs = spark.createDataFrame([("D", "hello world")], "id string, text string")
    import hashlib

    v = hashlib.sha256(b"hello world").hexdigest()
    rows = [("a", "D", 0, 5, "hello", None), ("b", "X", 0, 5, "hello", None), ("c", "D", 0, 5, "hello", "bad"), ("d", "D", 0, 50, "hello", None), ("e", "D", 0, 5, "HELLO", None), ("f", "D", 0, 5, "hello", v), ("g", "D", 6, 11, "world", v[:16])]
    s = spark.createDataFrame([(q, 0, 0, q, x, b, e, t, w) for q, x, b, e, t, w in rows], SPAN)
    got = {r["query_id"]: r["reason"] for r in gold.verify_spans(s, docs).collect()}
    assert got == {"a": None, "b": "unknown_source", "c": "version_mismatch", "d": "out_of_range", "e": "quote_mismatch", "f": None, "g": "version_mismatch"}
    assert {r["query_id"]: r["reason"] for r in gold.verify_spans(s, docs, version_chars=16).collect()} == got | {"g": None}
    short = s.where("query_id = 'f'").withColumn("source_version", F.explode(F.array(F.lit(""), F.lit(v[:15]), F.lit(v[:16]), F.lit(v))))
    assert sorted(str(r["reason"]) for r in gold.verify_spans(short, docs, version_chars=16).collect()) == ["None", "None", "version_mismatch", "version_mismatch"]


def test_strict_loading_fails_closed(spark):
    docs = spark.createDataFrame([("D", "hello world")], "id string, text string")
    bad = [([("D", 0, 5, "nope", None)],)]
    good = [([("D", 0, 5, "hello", None)],)]
    q = spark.createDataFrame([("x", "t", (bad,)), ("y", "t", (good,)), ("z", "t", None)], f"query_id string, text string, gold {GOLD}")
    with pytest.raises(gold.OffsetVerificationError):
        gold.load_verified(q, docs)
    assert {r["query_id"] for r in gold.load_verified(q, docs, strict=False).collect()} == {"y", "z"}


def test_authoring_occurrences(spark):
    docs = spark.createDataFrame([("D", "aaa b aa")], "id string, text string")
    e = spark.createDataFrame([("q", 0, i, "D", quote, n) for i, (quote, n) in enumerate([("aa", 0), ("aa", 1), ("aa", 2), ("aa", 3), ("zz", 0), ("", 0)])], "query_id string, alt_idx int, span_idx int, source_id string, quote string, occurrence int")
    got = {r["span_idx"]: (r["start"], r["reason"]) for r in gold.author_spans(e, docs).collect()}
    assert [got[i][0] for i in range(6)] == [0, 1, 6, None, None, None]
    assert [got[i][1] for i in (3, 4, 5)] == ["quote_not_found", "quote_not_found", "empty_quote"]


CASES = {
    None: dict(all_chunks=1, union=1, final=1),
    "representation": dict(all_chunks=0, union=0, final=0),
    "ann_index": dict(all_chunks=1, exact_union=1, union=0, final=0),
    "candidate_generation": dict(all_chunks=1, union=0, final=0),
    "fusion": dict(all_chunks=1, union=1, fused=0, final=0, hybrid=1),
    "reranker_demotion": dict(all_chunks=1, union=1, reranker_input=1, final=0, rerank=1),
    "final_cutoff": dict(all_chunks=1, union=1, final=0),
    "budget_cutoff": dict(all_chunks=1, union=1, final=1, budget=0),
}


@pytest.mark.parametrize("stage", list(CASES))
def test_attribution(spark, stage):
    c = CASES[stage]
    row = {k: F.lit(None if k not in c else bool(c[k])).cast("boolean") for k in ("all_chunks", "exact_union", "union", "fused", "reranker_input", "final", "budget")}
    row |= {"is_hybrid": F.lit(bool(c.get("hybrid"))), "has_rerank": F.lit(bool(c.get("rerank")))}
    assert spark.range(1).select(attribution.attribute(row)).first()[0] == stage


def test_branch_diagnostics(spark):
    one = spark.range(1)
    assert one.select(attribution.branch_diagnostics(F.lit(True), F.lit(None).cast("boolean"))).first()[0] == {"dense": True}
    assert one.select(attribution.branch_diagnostics(F.lit(None).cast("boolean"), F.lit(None).cast("boolean"))).first()[0] is None
