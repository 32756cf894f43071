import os

import numpy as np
import pytest

from spanforge.functions.stats import bootstrap_interval
from spanforge.operators import metrics
from spanforge.plans import catalogue
from spanforge.report import RESULT_SCHEMA

SF = "/root/testdata/sf0.001"


def row(config, query, hit, rank=None, stage=None, frag=(), tokens=10, refused=False, diag=None):
    return (config, query, hit, {}, list(frag), rank, stage, diag, tokens, refused, None)


@pytest.fixture(scope="module")
def results(spark):
    rows = [
        row("A", "q1", True, 1, tokens=100), row("A", "q2", True, 2, frag=["s"], tokens=100), row("A", "q3", False, 9, "final_cutoff"), row("A", "q4", False, None, "fusion"), row("A", "q5", False, None, "final_cutoff"),
        row("A", "q6", True, 1, refused=True), row("B", "q2", False, None, "fusion"), row("B", "q1", False, None, "fusion"), row("B", "q3", False, None, "fusion"),
    ]
    return spark.createDataFrame(rows, RESULT_SCHEMA)


def test_config_metrics(results):
    a = {r["config_id"]: r for r in metrics.config_metrics(results, 3).collect()}["A"]
    assert (a["n"], a["hits"], a["fragmented_queries"]) == (5, 2, 1) and a["hit_rate"] == 0.4
    assert a["mrr"] == pytest.approx((1 + 0.5 + 1 / 9) / 5) and a["hit_rate_ci"]["lo"] < 0.4 < a["hit_rate_ci"]["hi"] and not a["verdict_suppressed"]


def test_small_samples_have_no_verdict(results):
    rows = metrics.config_metrics(results, 20).collect()
    assert all(r["hit_rate_ci"] is None and r["verdict_suppressed"] for r in rows)
    assert metrics.best_config(metrics.config_metrics(results, 20)).count() == 0
    assert metrics.best_config(metrics.config_metrics(results, 1)).first()["config_id"] == "A"


def test_breakdown_counts_misses(results):
    got = {(r["config_id"], r["stage"]): r["misses"] for r in metrics.stage_breakdown(results).collect()}
    assert got == {("A", "final_cutoff"): 2, ("A", "fusion"): 1, ("B", "fusion"): 3}


def test_bootstrap_matches_numpy(results):
    got = {r["config_id"]: (r["lo"], r["hi"]) for r in metrics.bootstrap_mrr(results).collect()}
    assert got["A"] == pytest.approx(bootstrap_interval([1, 0.5, 1 / 9, 0, 0]))
    rng = np.random.default_rng(0)
    v = np.array([1, 0.5, 1 / 9, 0, 0])
    means = v[rng.integers(0, 5, size=(2000, 5))].mean(axis=1)
    assert got["A"] == pytest.approx(tuple(np.quantile(means, [0.025, 0.975])))


def test_comparison_is_paired(results):
    c = metrics.compare_configs(results, "A", "B").first()
    assert c["n"] == 3 and c["mean_diff"] == pytest.approx(2 / 3)
    none = metrics.compare_configs(results, "A", "missing").first()
    assert none["n"] == 0 and none["mean_diff"] == 0 and not none["significant"]
    with pytest.raises(ValueError):
        metrics.compare_configs(results, "A", "B", "other")


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
def test_every_pair_has_an_interval(spark):
    rows = {(r["config_a"], r["config_b"]): r.asDict() for r in catalogue.queries()["paired_bootstrap"](spark, SF).collect()}
    assert set(rows) == {(r["config_a"], r["config_b"]) for r in catalogue.queries()["paired_compare"](spark, SF).collect()} and len(rows) == 15
    for a, b in (min(rows), max(rows)):
        one = metrics.compare_configs(catalogue.results(spark, SF), a, b, "rr").first().asDict()
        assert {k: rows[a, b][k] for k in one} == pytest.approx(one)


def test_gates(spark, results):
    assert metrics.validity(metrics.config_metrics(results.where("config_id = 'B'"), 1)).first().asDict() == {"baseline_broken": True, "verdicts_suppressed": False}
    assert metrics.validity(metrics.config_metrics(results.limit(0))).first().asDict() == {"baseline_broken": False, "verdicts_suppressed": False}


def test_pareto_keeps_equal_points(spark):
    rows = []
    for c, hits, tokens in (("a", 2, 10), ("b", 2, 10), ("c", 1, 10), ("d", 3, 50), ("e", 3, 60), ("f", 0, 5), ("g", 2, 20)):
        rows += [row(c, f"q{i}", i < hits, 1 if i < hits else None, tokens=tokens) for i in range(4)]
    got = {r["config_id"] for r in metrics.pareto_frontier(spark.createDataFrame(rows, RESULT_SCHEMA)).collect()}
    assert got == {"a", "b", "d", "f"}


def test_duplicates_and_null_keys_are_dropped(spark):
    rows = [row("A", "q", True, 1), row("A", "q", True, 1), row(None, "q", True, 1), row("A", None, True, 1)]
    assert metrics.distinct_results(spark.createDataFrame(rows, RESULT_SCHEMA)).count() == 1


def test_latency(spark):
    df = spark.createDataFrame([("c", float(x)) for x in (1, 2, 3, 4)] + [("c", None)], "config_id string, ms double")
    r = metrics.latency_stats(df).first()
    assert (r["n"], r["mean_ms"], r["p50_ms"]) == (4, 2.5, 2.5) and r["p95_ms"] == pytest.approx(3.85)


def test_ranking_orders(spark):
    m = spark.createDataFrame([("x", 0.5, 0.1), ("y", 0.5, 0.9), ("z", 0.2, 1.0)], "config_id string, hit_rate double, mrr double")
    names = lambda by: [r["config_id"] for r in metrics.rank_configs(m, by).orderBy("rank").collect()]
    assert names("hit_rate") == ["y", "x", "z"] and names("mrr") == ["z", "y", "x"]
