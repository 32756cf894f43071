"""Operators on ranked lists (query_id, rank, chunk_id, ...): fusion, union, rerank, expansion, budget."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from spanforge.functions.text import count_tokens, word_tokens
from spanforge.functions.worker import worker_cache

RRF_C = 60


def _rank(keys: list[str], *order: Column | str) -> Column:
    return F.row_number().over(W.partitionBy(*keys).orderBy(*order))


def reciprocal_rank_fusion(lists: list[DataFrame], c: int = RRF_C, keys: tuple[str, ...] = ("query_id",)) -> DataFrame:
    """(keys, rank, chunk_id, score): sum of 1 / (c + rank), ties by chunk id."""
    keys = list(keys)
    together = None
    for ranked in lists:
        part = ranked.select(*keys, "chunk_id", (F.lit(1.0) / (c + F.col("rank"))).alias("part"))
        together = part if together is None else together.unionByName(part)
    fused = together.groupBy(*keys, "chunk_id").agg(F.sum("part").alias("score"))
    return fused.withColumn("rank", _rank(keys, F.desc("score"), "chunk_id"))


def candidate_union(lists: list[DataFrame], keys: tuple[str, ...] = ("query_id",)) -> DataFrame:
    """(keys, rank, chunk_id): first-seen union, earlier lists first."""
    keys, together = list(keys), None
    for i, ranked in enumerate(lists):
        part = ranked.select(*keys, "chunk_id", F.struct(F.lit(i).alias("branch"), F.col("rank").cast("int").alias("at")).alias("seen"))
        together = part if together is None else together.unionByName(part)
    first = together.groupBy(*keys, "chunk_id").agg(F.min("seen").alias("seen"))
    return first.withColumn("rank", _rank(keys, "seen")).drop("seen")


def lexical_overlap(query_text: Column, chunk_text: Column) -> Column:
    return F.size(F.array_intersect(word_tokens(query_text), word_tokens(chunk_text)))


def rerank(ranked: DataFrame, queries: DataFrame, chunks: DataFrame, score: Callable[[Column, Column], Column] = lexical_overlap, keys: tuple[str, ...] = ("query_id",)) -> DataFrame:
    """(keys, rank, chunk_id, score): by score, ties in incoming order. ``score`` maps query and chunk text to a number
    (the extension point for rerankers); null texts count as empty."""
    texts = chunks.select("chunk_id", F.coalesce("text", F.lit("")).alias("c_text"))
    asked = queries.select("query_id", F.coalesce("text", F.lit("")).alias("q_text"))
    scored = ranked.join(texts, "chunk_id").join(asked, "query_id").withColumn("score", score(F.col("q_text"), F.col("c_text")))
    return scored.withColumn("new", _rank(list(keys), F.desc("score"), "rank")).select(*keys, F.col("new").alias("rank"), "chunk_id", "score")


def cross_encoder(model: str = "cross-encoder/ms-marco-MiniLM-L-6-v2") -> Callable[[Column, Column], Column]:
    """A scoring function backed by an optional model library, loaded once per worker."""

    @F.pandas_udf("double")
    def predict(parts):
        def load():
            try:
                from sentence_transformers import CrossEncoder
            except ImportError as e:
                raise ImportError("this reranker needs the package sentence-transformers") from e
            return CrossEncoder(model)

        encoder = worker_cache(("cross encoder", model), load)
        for q, c in parts:
            yield pd.Series(encoder.predict(list(zip(q, c))), dtype=float)

    return lambda q, c: predict(q, c)


def expand_to_parents(ranked: DataFrame, mapping: DataFrame, keys: tuple[str, ...] = ("query_id",)) -> DataFrame:
    """(keys, rank, chunk_id): children replaced by parents of mapping(chunk_id, parent_id), first-seen; others map to themselves."""
    keys = list(keys)
    to = ranked.join(mapping.select("chunk_id", "parent_id"), "chunk_id", "left").withColumn("chunk_id", F.coalesce("parent_id", "chunk_id"))
    first = to.groupBy(*keys, "chunk_id").agg(F.min("rank").alias("seen"))
    return first.withColumn("rank", _rank(keys, "seen")).drop("seen")


def cut(ranked: DataFrame, k: int) -> DataFrame:
    return ranked.where(F.col("rank") <= k)


def pack_by_budget(ranked: DataFrame, budget: Column | int, keys: tuple[str, ...] = ("query_id",), tokens: str = "n_tokens") -> DataFrame:
    """The prefix of whole chunks whose running tokens stay within the budget, with running_tokens.

    Tokens are never negative, so the running sum is monotone and the filter is the prefix rule;
    null tokens count 0.
    """
    spend = F.sum(F.coalesce(F.col(tokens), F.lit(0))).over(W.partitionBy(*keys).orderBy("rank").rowsBetween(W.unboundedPreceding, 0))
    limit = F.lit(budget) if isinstance(budget, int) else budget
    return ranked.withColumn("running_tokens", spend).where(F.col("running_tokens") <= limit)


def with_tokens(ranked: DataFrame, chunks: DataFrame) -> DataFrame:
    return ranked.join(chunks.select("chunk_id", count_tokens(F.col("text")).alias("n_tokens")), "chunk_id")
