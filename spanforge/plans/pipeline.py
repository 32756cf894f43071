"""One configuration's pipeline over all queries at once, with every stage's ranked list captured.

Stages are rows of one long table (query_id, stage, rank, chunk_id). A stage that the
configuration lacks is not in ``stages``; one that exists but is empty for a query is in
``stages`` and has no rows: the two differ when misses are attributed.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanforge.operators import dense, ranking, sparse
from spanforge.plans.session import materialise
from spanforge.plans.sweep import DENSE_MODES, PARAMETERS, SPARSE_MODES, Config, approximate_topk


class NotIndexed(RuntimeError):
    """A retriever was asked before it had chunks."""


class Retriever:
    """index(chunks) then retrieve(queries, k): (query_id, rank, chunk_id, score)."""

    def __init__(self):
        self.chunks: DataFrame | None = None

    def index(self, chunks: DataFrame) -> Retriever:
        """chunks(chunk_pos, chunk_id, text)."""
        self.chunks = chunks
        return self

    def scored(self, queries: DataFrame, k: int) -> DataFrame:
        raise NotImplementedError

    def retrieve(self, queries: DataFrame, k: int) -> DataFrame:
        if self.chunks is None:
            raise NotIndexed("call index before retrieve")
        return self.scored(queries, k).join(self.chunks.select("chunk_pos", "chunk_id"), "chunk_pos").select("query_id", "rank", "chunk_id", "score")


class Bm25Retriever(Retriever):
    def __init__(self, k1: float = sparse.K1, b: float = sparse.B):
        super().__init__()
        self.k1, self.b = k1, b

    def scored(self, queries, k):
        return sparse.bm25_topk(self.chunks, queries, k, self.k1, self.b)


class DenseRetriever(Retriever):
    def __init__(self, embed: Callable):
        super().__init__()
        self.embed = embed

    def scored(self, queries, k):
        return dense.dense_topk_text(self.chunks, queries, k, self.embed)


class ApproximateRetriever(DenseRetriever):
    """Dense retrieval over the approximate index that config names."""

    def __init__(self, embed: Callable, config: Config):
        super().__init__(embed)
        self.config = config

    def scored(self, queries, k):
        return approximate_topk(self.chunks, queries, replace(self.config, candidate_n=k, top_k=1), self.embed, self.config.dense_index)


def retrievers(chunks: DataFrame, config: Config, embed: Callable | None, reference: bool = False) -> dict[str, Retriever]:
    """The retrievers of a configuration, indexed, as run_pipeline takes them; with ``reference`` exact search beside an approximate index."""
    out: dict[str, Retriever] = {}
    if config.retrieval in SPARSE_MODES:
        out["sparse_retriever"] = Bm25Retriever().index(chunks)
    if config.retrieval in DENSE_MODES and embed is not None:
        near = config.dense_index in PARAMETERS
        out["dense_retriever"] = (ApproximateRetriever(embed, config) if near else DenseRetriever(embed)).index(chunks)
        if near and reference:
            out["dense_reference"] = DenseRetriever(embed).index(chunks)
    return out


@dataclass
class StageOutputs:
    stages: tuple[str, ...]
    items: DataFrame

    def of(self, stage: str) -> DataFrame | None:
        return self.items.where(F.col("stage") == stage).drop("stage") if stage in self.stages else None


def run_pipeline(
    chunks: DataFrame,
    queries: DataFrame,
    config: Config,
    dense_retriever: Retriever | None = None,
    dense_reference: Retriever | None = None,
    sparse_retriever: Retriever | None = None,
    score: Callable | None = None,
    parents: DataFrame | None = None,
    rrf_c: int = ranking.RRF_C,
) -> StageOutputs:
    """Retrieve, fuse, rerank, expand, cut and pack as ``config`` says.

    parents(chunk_id, n_tokens) are the returned units of a parent-child chunker; every stage is
    then expanded to them. dense_reference is the exact search beside an approximate index.
    """
    mode, n = config.retrieval, config.candidate_n
    if mode in ("dense", "hybrid") and dense_retriever is None:
        raise ValueError(f"{mode} retrieval needs a dense retriever")
    if mode in ("sparse", "hybrid") and sparse_retriever is None:
        raise ValueError(f"{mode} retrieval needs a sparse retriever")
    if config.rerank and score is None:
        raise ValueError(f"reranker {config.rerank!r} was not given")
    keep = lambda df: materialise(df.select("query_id", "rank", "chunk_id"))
    d = keep(dense_retriever.retrieve(queries, n)) if mode in ("dense", "hybrid") else None
    s = keep(sparse_retriever.retrieve(queries, n)) if mode in ("sparse", "hybrid") else None
    x = keep(dense_reference.retrieve(queries, n)) if dense_reference is not None and mode != "sparse" else None
    stages: dict[str, DataFrame] = {}
    if d is not None:
        stages["dense_candidates"] = d
    if s is not None:
        stages["sparse_candidates"] = s
    if mode == "hybrid":
        stages["candidate_union"] = ranking.candidate_union([d, s])
        short = keep(ranking.cut(ranking.reciprocal_rank_fusion([d, s], rrf_c), n))
        stages["fused"] = short
        if x is not None:
            stages["exact_candidate_union"] = ranking.candidate_union([x, s])
    else:
        short = d if d is not None else s
        stages["candidate_union"] = short
        if x is not None:
            stages["exact_candidate_union"] = x
    pre = short
    if config.rerank:
        stages["reranker_input"] = short
        pre = keep(ranking.rerank(short, queries, chunks, score))
        stages["reranked"] = pre
    stages["pre_final"] = pre
    if parents is not None:
        stages = {k: ranking.expand_to_parents(v, chunks) for k, v in stages.items()}
    stages["final"] = ranking.cut(stages["pre_final"], config.top_k)
    if config.budget_tokens is not None:
        units = (parents if parents is not None else chunks).select("chunk_id", "n_tokens")
        stages["budget_packed"] = ranking.pack_by_budget(stages["final"].join(units, "chunk_id"), config.budget_tokens)
    items = None
    for name, rows in stages.items():
        part = rows.select("query_id", F.lit(name).alias("stage"), F.col("rank").cast("int").alias("rank"), "chunk_id")
        items = part if items is None else items.unionByName(part)
    return StageOutputs(tuple(stages), items)
