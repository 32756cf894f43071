import json
import os

import pytest

from spanforge import cli, report
from spanforge.operators import attribution, chunking, ranking
from spanforge.operators.embedding import HashEmbedder
from spanforge.plans import catalogue
from spanforge.plans import sweep as S
from spanforge.sources import corpora

SF = "/root/testdata/sf0.001"


def spec(**kw):
    base = dict(embedders={"det": HashEmbedder(256, name="det")}, chunkers={c: S.make_chunker(c) for c in ("fixed:600", "fixed:140")}, retrieval_modes=("dense", "sparse", "hybrid"), rerankers={None: None, "lexical": ranking.lexical_overlap}, top_k=3, candidate_n=20)
    return S.SweepSpec(**(base | kw))


@pytest.fixture(scope="module")
def swept(spark):
    c = corpora.realistic(spark)
    return S.run_sweep(c.documents, c.queries, spec(budgets=(None, 60)), min_sample=1)


def test_grid(swept):
    assert len(swept.config_ids) == spec(budgets=(None, 60)).n_configs() == 24
    assert swept.results.count() == 24 * 18


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
def test_registered_sweep_covers_the_tables(spark):
    m = catalogue.queries()["sweep_metrics"](spark, SF).collect()
    n = catalogue.asked(spark, SF).count()
    assert n != 18 and len({r["config_id"] for r in m}) == len(m) == 24 and {r["n"] for r in m} == {n}
    assert {(r["queries"], r["violations"]) for r in catalogue.queries()["sweep_violations"](spark, SF).collect()} == {(n, 0)}


def test_hit_iff_no_stage(swept):
    assert attribution.violations(swept.results).count() == 0


def test_configurations_diverge(swept):
    rates = [r["hit_rate"] for r in swept.metrics.collect()]
    assert max(rates) - min(rates) >= 0.2
    assert len({r["stage"] for r in swept.breakdown.collect()}) >= 3


def test_large_chunks_beat_small_ones(swept):
    by = {"fixed:600": [], "fixed:140": []}
    for r in swept.metrics.collect():
        c = S.parse_config_id(r["config_id"])
        if c["budget"] == "none":
            by[c["chunker"]].append(r["hit_rate"])
    assert sum(by["fixed:600"]) > sum(by["fixed:140"])


def test_comparison_and_best(swept):
    best = swept.best().first()["config_id"]
    assert swept.ranked().orderBy("rank").first()["config_id"] == best
    assert swept.compare(best, swept.config_ids[0]).first()["n"] == 18
    with pytest.raises(KeyError):
        swept.compare("x", best)


def test_parent_child_and_lsh(spark):
    c = corpora.realistic(spark)
    s = S.run_sweep(c.documents, c.queries, spec(chunkers={"parentchild:600x140": S.make_chunker("parentchild:600x140")}, retrieval_modes=("dense", "hybrid"), dense_indexes=("exact", "lsh"), rerankers={None: None}), min_sample=1)
    assert attribution.violations(s.results).count() == 0 and len(s.ann_diagnostics) == 2
    assert all(0 <= d["mean_recall"] <= 1 and d["n"] == 18 for d in s.ann_diagnostics.values())


@pytest.mark.parametrize("stage", ["representation", "final_cutoff", "candidate_generation", "reranker_demotion", "budget_cutoff"])
def test_planted_failures_are_found(spark, stage):
    c, p = corpora.planted(spark, stage)
    size = p.get("size", 100)
    chunker = S.Chunker((lambda d: chunking.chunk_lossy(d, *p["drop"], 100)) if "drop" in p else (lambda d: chunking.chunk_fixed(d, size)))
    rr = {"lexical": ranking.lexical_overlap} if stage == "reranker_demotion" else {None: None}
    # The demoted text shares character n-grams with the query but not its words.
    mode = "dense" if stage == "reranker_demotion" else "sparse"
    s = S.run_sweep(c.documents, c.queries, spec(chunkers={"c": chunker}, retrieval_modes=(mode,), rerankers=rr, top_k=p.get("top_k", 3), candidate_n=p.get("candidate_n", 20), budgets=(p.get("budget"),)), min_sample=1)
    assert [r["stage_attribution"] for r in s.results.collect()] == [stage]


@pytest.mark.parametrize("kw", [dict(retrieval="x"), dict(top_k=0), dict(candidate_n=1), dict(budget_tokens=-1), dict(dense_index="x"), dict(retrieval="sparse", dense_index="lsh"), dict(dense_index="none"), dict(dense_index="lsh", bits=0)])
def test_config_validation(kw):
    with pytest.raises(ValueError):
        S.Config(**(dict(embed_model="e", chunker="c", retrieval="dense") | kw))


def test_config_ids():
    c = S.Config("e", "c", "sparse", None, 5, 50)
    assert c.id == "e|c|sparse|rerank=none|k=5|n=50|budget=none|index=none"
    assert S.parse_config_id("e|c|dense|rerank=x")["index"] == "exact"
    assert S.Config("e", "c", "dense", dense_index="hnsw", hnsw_m=8).id.endswith("|index=hnsw|hnsw_m=8|hnsw_ef=50|hnsw_efc=200")


def test_spec_validation():
    for bad in (dict(dense_indexes=("what",)), dict(dense_indexes=()), dict(embedders={"x": None}), dict(ann_diagnostic_queries=-1), dict(dense_indexes=("hnsw",), hnsw_ef=10)):
        with pytest.raises(ValueError):
            spec(**bad).validate()


def test_makers():
    for bad in ("x", "fixedd:3"):
        with pytest.raises(ValueError):
            S.make_chunker(bad)
    with pytest.raises(ValueError):
        S.make_chunker("semantic")
    with pytest.raises(ValueError):
        S.make_embedder("x")
    with pytest.raises(ValueError):
        S.make_reranker("x")
    assert S.make_reranker("none") == (None, None) and S.make_reranker("lexical")[0] == "lexical"


def test_reports(spark, swept, tmp_path):
    s = report.summarise(swept)
    text = report.render_report(s, top=5)
    assert "hit rate" in text and text.count("rerank=") == 5
    assert "Pareto" in report.render_pareto(s)
    path = tmp_path / "r.json"
    report.write_json(swept, str(path), s)
    again = report.read_json(spark, str(path))
    t = report.summarise(again)
    same = lambda x: json.loads(json.dumps(x), parse_float=lambda v: round(float(v), 9))
    assert same(t.metrics) == same(s.metrics) and same(t.frontier) == same(s.frontier) and json.loads(path.read_text())["n_queries"] == 18
    page = report.render_html(s)
    assert page.count("<tr data-") == 24 and "http" not in page and "BEST" in page and "<svg" in page
    assert "&lt;x&gt;" in report.render_html(report.Summary(1, 1, [dict(s.metrics[0], config_id="<x>|c|dense")], {}, [], False, False, []))


def test_cli(tmp_path, capsys, spark):
    c = corpora.basic(spark)
    from spanforge.sources import tables

    docs, queries = tables.DatasetImport(c.documents, c.queries, {}).write_jsonl(str(tmp_path))
    out = str(tmp_path / "o.json")
    run = ["run", "--corpus", docs, "--queries", queries, "--retrieval", "sparse", "--top-k", "2", "--candidate-n", "5", "--json", out]
    assert cli.main([*run, "--min-sample", "1", "--fail-under", "0.5", "--html", str(tmp_path / "o.html")]) == cli.OK
    assert cli.main([*run, "--fail-under", "0.5"]) == cli.GATE
    assert cli.main(["explain", out, "q-tide"]) == cli.OK and "sparse=hit" in capsys.readouterr().out
    assert cli.main(["explain", out, "nope"]) == cli.OK and "no query" in capsys.readouterr().out
    assert cli.main(["pareto", out]) == cli.OK
    assert cli.main([*run[:2], str(tmp_path / "none"), *run[3:]]) == cli.INPUT
    assert cli.main([*run, "--chunkers", "odd"]) == cli.INPUT
    drifted = tmp_path / "drift.jsonl"
    drifted.write_text(open(queries).read().replace("spring tide follows", "spring tide FOLLOWS"))
    assert cli.main(["run", "--corpus", docs, "--queries", str(drifted), "--retrieval", "sparse"]) == cli.INPUT
    spec_file = tmp_path / "spec.jsonl"
    spec_file.write_text(json.dumps({"id": "a", "text": "t", "source_id": "bees", "answer": "queen"}))
    assert cli.main(["make-gold", "--corpus", docs, "--spec", str(spec_file), "--out", str(tmp_path / "g.jsonl")]) == cli.OK
    assert cli.main(["geometry", "--corpus", docs, "--queries", queries]) == cli.OK and "hubness" in capsys.readouterr().out


def test_latency_is_measured_on_request(spark):
    c = corpora.basic(spark)
    s = S.run_sweep(c.documents, c.queries, spec(chunkers={"fixed": S.make_chunker("fixed")}, retrieval_modes=("dense", "sparse"), rerankers={None: None}), min_sample=1, measure_latency=True)
    assert set(s.cost) == set(s.config_ids)
    dense_cost, sparse_cost = s.cost[s.config_ids[0]], s.cost[s.config_ids[-1]]
    assert sparse_cost["index_bytes"] == 0 and dense_cost["mean_ms"] != sparse_cost["mean_ms"] and min(dense_cost["build_ms"], sparse_cost["build_ms"]) > 0
    assert dense_cost["n"] == 4 and dense_cost["p95_ms"] >= dense_cost["p50_ms"] > 0 and dense_cost["index_bytes"] == 4 * 256 * 4
    text, page = report.render_report(report.summarise(s)), report.render_html(report.summarise(s))
    assert "this machine only" in text and "Measured cost" in page and "p95 ms" in text and "p95 ms" in page


@pytest.mark.parametrize("name", ["semantic:60", "recursive:80", "parent-child:200x50", "fixed"])
def test_every_chunker_keeps_the_invariant(spark, name):
    c = corpora.basic(spark)
    s = S.run_sweep(c.documents, c.queries, spec(chunkers={name: S.make_chunker(name, HashEmbedder(64, name="h"))}, retrieval_modes=("sparse",), rerankers={None: None}, budgets=(None, 5)), min_sample=1)
    assert attribution.violations(s.results).count() == 0 and s.results.count() == 8
