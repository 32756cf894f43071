"""Command line: run, explain, pareto, import-squad, import-beir, make-gold, demo, geometry."""

from __future__ import annotations

import argparse
import sys
from pathlib import Path

from pyspark.errors import PySparkException
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from spanforge import report
from spanforge.operators import geometry, metrics
from spanforge.operators.embedding import embed_rows
from spanforge.operators.gold import OffsetVerificationError
from spanforge.plans import sweep as S
from spanforge.sources import corpora, tables

OK, GATE, INPUT = 0, 1, 2


def session() -> SparkSession:
    active = SparkSession.getActiveSession()
    return active or SparkSession.builder.config("spark.sql.session.timeZone", "UTC").getOrCreate()


def listed(option: str | None) -> list[str]:
    """The non-blank items of a comma-separated option."""
    return [item for item in map(str.strip, (option or "").split(",")) if item]


def _fail(message: str, code: int = INPUT) -> int:
    print(f"error: {message}", file=sys.stderr)
    return code


def build_spec(a: argparse.Namespace) -> S.SweepSpec:
    """Models are made only where dense or hybrid retrieval or a semantic chunker needs one; semantic chunking takes the first."""
    modes, names, chunkers = listed(a.retrieval), listed(a.embed_models), listed(a.chunkers)
    needed = any(m in S.DENSE_MODES for m in modes) or any(c.partition(":")[0] == "semantic" for c in chunkers)
    embedders = {n: S.make_embedder(n) for n in names} if needed else {names[0]: None}
    first = next(iter(embedders.values()))
    return S.SweepSpec(
        embedders, {c: S.make_chunker(c, first) for c in chunkers}, tuple(modes), dict(S.make_reranker(r) for r in listed(a.rerank)), a.top_k, a.candidate_n,
        (None, *map(int, listed(a.budget_tokens))), tuple(listed(a.dense_index)), a.tables, a.bits, a.probes, a.ann_diagnostic_queries,
        a.hnsw_m, a.hnsw_ef_construction, a.hnsw_ef, a.latency_queries or None,
    )


def _run(a: argparse.Namespace) -> int:
    spark = session()
    try:
        documents = S.materialise(tables.load_documents(spark, a.corpus))
        queries = S.materialise(tables.load_queries(spark, a.queries, documents))
    except OffsetVerificationError as e:
        return _fail(f"gold verification failed: {e}")
    except (OSError, ValueError, PySparkException) as e:
        return _fail(f"could not load inputs: {e}")
    if not queries.limit(1).count():
        return _fail("no queries loaded")
    try:
        swept = S.run_sweep(documents, queries, build_spec(a), a.min_sample, seed=a.seed, measure_latency=a.measure_latency)
    except (ImportError, ValueError) as e:
        return _fail(f"invalid or unavailable configuration: {e}")
    summary = report.summarise(swept)
    print(report.render_report(summary, a.top))
    if a.json:
        report.write_json(swept, a.json, summary)
        print(f"wrote {a.json}")
    if a.html:
        report.write_html(summary, a.html)
        print(f"wrote {a.html}")
    if summary.baseline_broken:
        return _fail("baseline broken: nothing is ever found", GATE)
    if a.fail_under is not None:
        if summary.verdicts_suppressed:
            return _fail("too few queries to judge --fail-under", GATE)
        best = summary.best()
        if best is None or best["hit_rate"] < a.fail_under:
            return _fail(f"best hit@k is below {a.fail_under:.2f}", GATE)
    return OK


def _explain(a: argparse.Namespace) -> int:
    swept = report.read_json(session(), a.json)
    rows = [r.asDict() for r in metrics.explain_query(swept.results, a.query_id).collect()]
    print(report.render_explain(rows, a.query_id, swept.config_ids))
    return OK


def _pareto(a: argparse.Namespace) -> int:
    print(report.render_pareto(report.summarise(report.read_json(session(), a.json))))
    return OK


def _demo(a: argparse.Namespace) -> int:
    spark, folder = session(), a.out_dir or "spanforge-demo"
    docs, queries = corpora.write_corpus(spark, a.dataset, folder)
    print(f"wrote {docs} and {queries}")
    grid = (
        ["--chunkers", "fixed:600,fixed:140", "--retrieval", "dense,sparse,hybrid", "--candidate-n", "20"] if a.dataset == "realistic"
        else ["--chunkers", "fixed,recursive", "--retrieval", "dense,hybrid", "--candidate-n", "10"]
    )
    out = Path(folder)
    return main(["run", "--corpus", docs, "--queries", queries, "--rerank", "none,lexical", "--top-k", "3", "--min-sample", "1", "--json", str(out / "out.json"), "--html", str(out / "report.html"), *grid])


def _make_gold(a: argparse.Namespace) -> int:
    spark = session()
    try:
        documents = tables.load_documents(spark, a.corpus)
        queries = tables.load_authoring(spark, a.spec, documents)
        tables.write_queries_jsonl(queries, a.out)
    except (OSError, ValueError, PySparkException) as e:
        return _fail(str(e))
    print(f"wrote {queries.count()} verified queries to {a.out}")
    return OK


def _import(a: argparse.Namespace, load) -> int:
    try:
        found = load(session())
        paths = found.write_jsonl(a.out_dir)
    except (OSError, ValueError, KeyError, PySparkException) as e:
        return _fail(f"could not import: {e}")
    print(f"imported {found.summary()}")
    print(f"wrote {paths[0]} and {paths[1]}")
    return OK


def _geometry(a: argparse.Namespace) -> int:
    spark = session()
    try:
        documents = tables.load_documents(spark, a.corpus)
        embed = S.make_embedder(a.embed_model)
        chunks = S.materialise(S.make_chunker(a.chunker, embed).chunk(documents))
        dim = len(embed(["x"])[0])
        vectors = S.materialise(embed_rows(chunks, "text", embed).select(F.col("chunk_pos").alias("id"), "vector"))
        hub, cone = geometry.hubness(vectors, dim).first(), geometry.anisotropy(vectors, dim).first()
        mismatch = None
        if a.queries:
            queries = tables.load_queries(spark, a.queries, documents, strict=False)
            q = embed_rows(queries, "text", embed, "query").select(F.col("query_id").alias("id"), "vector")
            if q.limit(1).count():
                mismatch = tuple(geometry.query_corpus_mismatch(q, vectors, dim).first())
    except (OSError, ValueError, ImportError, PySparkException) as e:
        return _fail(str(e))
    print(geometry.render_geometry(hub["skewness"], hub["k"], cone["mean_cosine"], mismatch))
    return OK


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="spanforge")
    sub = p.add_subparsers(dest="command", required=True)
    r = sub.add_parser("run")
    for name in ("corpus", "queries"):
        r.add_argument(f"--{name}", required=True)
    for name, default in (("embed-models", "det"), ("chunkers", "fixed"), ("retrieval", "hybrid"), ("rerank", "none"), ("budget-tokens", ""), ("dense-index", "exact")):
        r.add_argument(f"--{name}", default=default)
    for name, default in (("top-k", 5), ("candidate-n", 50), ("min-sample", 20), ("seed", 0), ("tables", 16), ("bits", 7), ("probes", 8), ("ann-diagnostic-queries", 100), ("hnsw-m", 16), ("hnsw-ef-construction", 200), ("hnsw-ef", 50), ("latency-queries", 20)):
        r.add_argument(f"--{name}", type=int, default=default)
    r.add_argument("--top", type=int)
    r.add_argument("--fail-under", type=float)
    r.add_argument("--json")
    r.add_argument("--html")
    r.add_argument("--measure-latency", action="store_true")
    r.set_defaults(run=_run)
    e = sub.add_parser("explain")
    e.add_argument("json")
    e.add_argument("query_id")
    e.set_defaults(run=_explain)
    x = sub.add_parser("pareto")
    x.add_argument("json")
    x.set_defaults(run=_pareto)
    q = sub.add_parser("import-squad")
    q.add_argument("input")
    q.add_argument("out_dir")
    q.add_argument("--max-queries", type=int)
    q.set_defaults(run=lambda a: _import(a, lambda s: tables.load_squad(s, a.input, a.max_queries)))
    b = sub.add_parser("import-beir")
    for name in ("corpus", "queries", "qrels", "out_dir"):
        b.add_argument(name)
    b.add_argument("--max-queries", type=int)
    b.set_defaults(run=lambda a: _import(a, lambda s: tables.load_beir(s, a.corpus, a.queries, a.qrels, max_queries=a.max_queries)))
    g = sub.add_parser("make-gold")
    for name in ("corpus", "spec", "out"):
        g.add_argument(f"--{name}", required=True)
    g.set_defaults(run=_make_gold)
    d = sub.add_parser("demo")
    d.add_argument("--dataset", choices=("basic", "realistic"), default="realistic")
    d.add_argument("--out-dir")
    d.set_defaults(run=_demo)
    m = sub.add_parser("geometry")
    m.add_argument("--corpus", required=True)
    m.add_argument("--queries")
    m.add_argument("--embed-model", default="det")
    m.add_argument("--chunker", default="fixed")
    m.set_defaults(run=_geometry)
    return p


def main(argv: list[str] | None = None) -> int:
    a = parser().parse_args(argv)
    return a.run(a)


if __name__ == "__main__":
    sys.exit(main())
