"""Exact and approximate dense retrieval over vector tables.

Exact: queries (blocks of bounded size) go to every task as one matrix; a task multiplies batch
after batch and keeps the best k per query, so only its top-k rows are shuffled. Approximate:
signed random projections in several tables, whose buckets are joined by id and scored exactly;
or, with an optional library, one small-world graph a partition, searched by all queries.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanforge.functions import jvm
from spanforge.functions.text import cosine
from spanforge.operators import counts
from spanforge.operators.embedding import HashEmbedder
from spanforge.operators.sparse import ranked
from spanforge.operators.topk import TopK
from spanforge.plans.session import blocks, materialise

QUERY_BYTES = 64 << 20  # query vectors a task holds at a time: 4,096 at 2,048 dimensions
COUNT_BYTES = 192 << 20  # eight-bit counts of queries a task holds at a time: 98,304 at 2,048 dimensions
COUNT_QUERIES = 131_072  # and their number at most
DIGITS = 6


def _matrix(column, dim: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)


def _unit(x: np.ndarray) -> np.ndarray:
    norm = np.sqrt((x * x).sum(axis=1, keepdims=True))
    return x / np.where(norm == 0, 1, norm)


def usable(df: DataFrame, column: str, dim: int) -> DataFrame:
    """Rows whose vector has dim finite entries."""
    v = F.col(column)
    return df.where((F.size(v) == dim) & ~F.exists(v, lambda x: x.isNull() | F.isnan(x)))


def dense_topk(vectors: DataFrame, queries: DataFrame, k: int, dim: int, exclude_self: bool = False) -> DataFrame:
    """(query_id, rank, chunk_pos, score) by cosine to six digits, then chunk_pos; scores of any sign are kept.

    vectors(chunk_pos bigint, vector), queries(query_id, vector). Zero vectors score 0; vectors of
    another length, with nulls or NaN, are left out. Queries are taken in blocks.
    """
    spark = vectors.sparkSession
    kind = queries.schema["query_id"].dataType.simpleString()
    schema = f"query_id {kind}, chunk_pos bigint, score double"
    asked = usable(queries.select("query_id", F.col("vector").cast("array<double>").alias("vector")), "vector", dim)
    source = usable(vectors.select(F.col("chunk_pos").cast("bigint"), F.col("vector").cast("array<double>")), "vector", dim)
    found = None
    for block in blocks(asked, "query_id", max(1, QUERY_BYTES // (8 * dim))) if k > 0 else ():
        rows = block.orderBy("query_id").toArrow().combine_chunks()
        if not rows.num_rows:
            continue
        q_ids = rows.column("query_id").combine_chunks()
        shared = spark.sparkContext.broadcast((q_ids, _unit(_matrix(rows.column("vector").combine_chunks(), dim))))
        part = source.mapInArrow(_multiplier(shared, dim, k, exclude_self), schema)
        found = part if found is None else found.unionByName(part)
    if found is None:
        found = spark.createDataFrame([], schema)
    return ranked(found, k, DIGITS)


def _multiplier(shared, dim: int, k: int, exclude_self: bool, vectors_of: Callable | None = None):
    """Scores of the batches' rows for all queries, and the task's best k of each query."""

    def run(batches):
        ids, q = shared.value
        own = np.array(ids.to_pylist(), dtype=object) if exclude_self else None
        top = TopK(len(ids), k, DIGITS)
        for batch in batches:
            if not batch.num_rows:
                continue
            pos = batch.column(0).to_numpy()
            for lo in range(0, len(pos), 1024):
                p = pos[lo : lo + 1024]
                part = batch.column(1).slice(lo, 1024)
                v = _unit(_matrix(part, dim)) if vectors_of is None else vectors_of(part.to_pylist())
                for at in range(0, len(q), 4096):
                    scores = q[at : at + 4096] @ v.T
                    if exclude_self:
                        scores[own[at : at + 4096, None] == p[None, :]] = -np.inf
                    top.push(at, scores, p, above=-np.inf)
        a, p, s = top.best()
        yield pa.RecordBatch.from_arrays([ids.take(pa.array(a)), pa.array(p, pa.int64()), pa.array(s, pa.float64())], names=["query_id", "chunk_pos", "score"])

    return run


def dense_topk_text(chunks: DataFrame, queries: DataFrame, k: int, embed: Callable[[list[str]], np.ndarray]) -> DataFrame:
    """dense_topk for chunks(chunk_pos, text) and queries(query_id, text).

    Queries that fit one block meet the chunks where these are embedded, so that vectors are
    never stored; for more blocks the chunks are embedded once into the shared folder. Null texts
    embed as empty ones. Feature counts are multiplied as integers.
    """
    if isinstance(embed, HashEmbedder):
        by_jvm = embed.dim <= jvm.WIDEST and jvm.count_search(chunks.sparkSession) is not None
        return _counts_topk(chunks, queries, k, embed, embed.dim, None if by_jvm else lambda shared, stored: counts.searcher(shared, embed, k, DIGITS, stored))
    spark = chunks.sparkSession
    kind = queries.schema["query_id"].dataType.simpleString()
    schema = f"query_id {kind}, chunk_pos bigint, score double"
    asked = queries.select("query_id", F.coalesce("text", F.lit("")).alias("text"))
    q_prefix, p_prefix = getattr(embed, "query_prefix", ""), getattr(embed, "passage_prefix", "")
    dim = len(embed([q_prefix])[0])
    texts = chunks.select(F.col("chunk_pos").cast("bigint"), F.coalesce("text", F.lit("")).alias("text"))
    of_text = lambda part: embed([p_prefix + t for t in part])
    of_bytes = lambda part: np.frombuffer(b"".join(part), np.float64).reshape(len(part), dim)
    parts = list(blocks(asked, "query_id", max(1, QUERY_BYTES // (8 * dim)))) if k > 0 else []
    if len(parts) > 1:

        def store(batches):
            for batch in batches:
                v = [x.tobytes() for lo in range(0, batch.num_rows, 1024) for x in of_text(batch.column(1).slice(lo, 1024).to_pylist())]
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(v, pa.binary())], names=["chunk_pos", "vector"])

        texts = materialise(texts.mapInArrow(store, "chunk_pos bigint, vector binary"))
    found = None
    for block in parts:
        rows = block.orderBy("query_id").toArrow().combine_chunks()
        if not rows.num_rows:
            continue
        ids = rows.column("query_id").combine_chunks()
        shared = spark.sparkContext.broadcast((ids, embed([q_prefix + t for t in rows.column("text").to_pylist()])))
        part = texts.mapInArrow(_multiplier(shared, dim, k, False, of_bytes if len(parts) > 1 else of_text), schema)
        found = part if found is None else found.unionByName(part)
    if found is None:
        found = spark.createDataFrame([], schema)
    return ranked(found, k, DIGITS)


def lsh_topk_text(chunks: DataFrame, queries: DataFrame, k: int, embed: HashEmbedder, tables: int = 16, bits: int = 7, probes: int = 8, seed: int = 100) -> DataFrame:
    """lsh_topk for chunks(chunk_pos, text) and queries(query_id, text): a task meets bucket after bucket of its chunks with all queries, and no pair travels."""
    planes = np.random.default_rng(seed).standard_normal((tables, bits, embed.dim))
    held = 8 * embed.dim + 16 * tables * min(probes, bits + 1)
    return _counts_topk(chunks, queries, k, embed, held, lambda shared, stored: counts.lsh_searcher(shared, embed, k, DIGITS, planes, probes, stored))


def _counts_topk(chunks: DataFrame, queries: DataFrame, k: int, embed: HashEmbedder, held: int, search: Callable | None) -> DataFrame:
    """Search over feature counts: blocks of queries of bounded size (``held`` bytes each in a task), chunks in one task a core as each holds a best k of all queries.

    Without ``search``, exact search in the JVM.
    """
    spark = chunks.sparkSession
    kind = queries.schema["query_id"].dataType.simpleString()
    schema = f"query_id {kind}, chunk_pos bigint, score double"
    texts = chunks.select(F.col("chunk_pos").cast("bigint"), F.coalesce("text", F.lit("")).alias("text")).coalesce(spark.sparkContext.defaultParallelism)
    found = None
    if k > 0:
        asked = materialise(queries.select("query_id", F.coalesce("text", F.lit("")).alias("text")).mapInArrow(_encoder(embed), f"query_id {kind}, slots binary"))
        mean = asked.agg(F.coalesce(F.avg(F.length("slots")), F.lit(0.0)).alias("mean")).first()["mean"]
        parts = list(blocks(asked, "query_id", max(1, int(min(COUNT_QUERIES, COUNT_BYTES / held, QUERY_BYTES / (mean + 1))))))
        if search is None:
            texts = texts.mapInArrow(_flattener(embed), "chunk_pos bigint, text string")
        elif len(parts) > 1:
            texts = texts.mapInArrow(_encoder(embed), "chunk_pos bigint, slots binary")
        texts = materialise(texts) if len(parts) > 1 else texts
        for block in parts:
            rows = block.orderBy("query_id").toArrow().combine_chunks()
            if not rows.num_rows:
                continue
            if search is None:
                of, *asked_for = counts.features(rows.column("slots").to_pylist(), embed.dim)
                best = ranked(jvm.search(texts, *asked_for, embed, k, counts.SLACK, DIGITS).withColumnRenamed("place", "query_id"), k, DIGITS)
                places = spark.createDataFrame(pa.table({"id": rows.column("query_id"), "query_id": pa.array(of)}))
                part = best.join(places, "query_id").select(F.col("id").cast(kind).alias("query_id"), "chunk_pos", "score")
                found = part if found is None else found.unionByName(part)
                continue
            shared = spark.sparkContext.broadcast((rows.column("query_id").combine_chunks(), rows.column("slots").to_pylist()))
            part = texts.mapInArrow(search(shared, len(parts) > 1), schema)
            found = part if found is None else found.unionByName(part)
    return ranked(spark.createDataFrame([], schema) if found is None else found, k, DIGITS)


def _encoder(embed: HashEmbedder):
    """(id, text) -> (id, feature slots)."""

    def run(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts.encode(embed, batch.column(1).to_pylist()), pa.binary())], names=[batch.schema.names[0], "slots"])

    return run


def _flattener(embed: HashEmbedder):
    """(id, text) -> (id, text as n-grams are cut from it)."""

    def run(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(map(embed.flat, batch.column(1).to_pylist()), pa.string())], names=batch.schema.names)

    return run


def index_bytes(vectors: DataFrame, dim: int) -> DataFrame:
    """(n, dim, bytes) of a float32 matrix."""
    return vectors.agg(F.count(F.lit(1)).alias("n")).select("n", F.lit(dim).alias("dim"), (F.col("n") * dim * 4).alias("bytes"))


def lsh_bits(n: int, per_bucket: int = 256) -> int:
    """Bits that leave some per_bucket of n rows in a bucket."""
    return min(max(round(math.log2(max(n, 1) / per_bucket)), 4), 24)


def _codes(df: DataFrame, id_col: str, dim: int, tables: int, bits: int, seed: int, probes: int) -> DataFrame:
    """(id, table, code): codes of the ``probes`` nearest buckets in each table."""
    planes = np.random.default_rng(seed).standard_normal((tables, bits, dim))
    source = usable(df.select(F.col(id_col).alias("id"), F.col("vector").cast("array<double>").alias("vector")), "vector", dim)
    kind = source.schema["id"].dataType.simpleString()

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            v = _unit(_matrix(batch.column(1), dim))
            rows, tab, codes = [], [], []
            for t in range(tables):
                side = v @ planes[t].T
                code = ((side > 0) << np.arange(bits)).sum(axis=1)
                near = np.argsort(np.abs(side), axis=1)
                for p in range(min(probes, bits + 1)):
                    flip = np.zeros(len(v), np.int64) if p == 0 else 1 << near[:, p - 1]
                    rows.append(np.arange(len(v)))
                    tab.append(np.full(len(v), t))
                    codes.append(code ^ flip)
            take = pa.array(np.concatenate(rows))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(take), pa.array(np.concatenate(tab), pa.int32()), pa.array(np.concatenate(codes), pa.int64())], names=["id", "tab", "code"])

    return source.mapInArrow(run, f"id {kind}, tab int, code bigint")


def lsh_topk(vectors: DataFrame, queries: DataFrame, k: int, dim: int, tables: int = 16, bits: int | None = 7, probes: int = 8, seed: int = 100) -> DataFrame:
    """The interface of dense_topk over an approximate index; queries probe neighbouring buckets.

    Only ids travel until every pair is met once; then the vectors of the candidates are joined
    and scored exactly. ``bits`` None fits the buckets to the number of vectors.
    """
    v = vectors.select(F.col("chunk_pos").cast("bigint").alias("chunk_pos"), "vector")
    if bits is None:
        bits = lsh_bits(v.count())
    index = _codes(v, "chunk_pos", dim, tables, bits, seed, 1).select(F.col("id").alias("chunk_pos"), "tab", "code")
    asked = _codes(queries, "query_id", dim, tables, bits, seed, probes).select(F.col("id").alias("query_id"), "tab", "code")
    met = asked.join(index, ["tab", "code"]).select("query_id", "chunk_pos").distinct()
    scored = met.join(v.select("chunk_pos", F.col("vector").alias("v")), "chunk_pos").join(queries.select("query_id", F.col("vector").alias("q")), "query_id")
    return ranked(scored.select("query_id", "chunk_pos", cosine(F.col("q"), F.col("v")).alias("score")), k, DIGITS)


def graph_library():
    """The optional library of the graph index."""
    try:
        import hnswlib
    except ImportError as e:
        raise ImportError("the index hnsw needs the package hnswlib") from e
    return hnswlib


def hnsw_topk(vectors: DataFrame, queries: DataFrame, k: int, dim: int, m: int = 16, ef_construction: int = 200, ef: int = 50, seed: int = 100) -> DataFrame:
    """The interface of dense_topk over one graph a partition: all queries search every graph, and the best of all are kept.

    A graph is as large as its partition of ``vectors``; more partitions make smaller graphs.
    """
    if min(m, ef_construction, ef) <= 0:
        raise ValueError("m, ef_construction and ef must be positive")
    graph_library()
    spark, kind = vectors.sparkSession, queries.schema["query_id"].dataType.simpleString()
    schema = f"query_id {kind}, chunk_pos bigint, score double"
    asked = usable(queries.select("query_id", F.col("vector").cast("array<double>").alias("vector")), "vector", dim)
    source = usable(vectors.select(F.col("chunk_pos").cast("bigint"), F.col("vector").cast("array<double>")), "vector", dim)
    found = None
    for block in blocks(asked, "query_id", max(1, QUERY_BYTES // (8 * dim))) if k > 0 else ():
        rows = block.orderBy("query_id").toArrow().combine_chunks()
        if not rows.num_rows:
            continue
        shared = spark.sparkContext.broadcast((rows.column("query_id").combine_chunks(), _unit(_matrix(rows.column("vector").combine_chunks(), dim))))

        def run(batches, shared=shared):
            got = [(b.column(0).to_numpy(), _unit(_matrix(b.column(1), dim)).astype(np.float32)) for b in batches if b.num_rows]
            if not got:
                return
            pos, v = (np.concatenate(x) for x in zip(*got))
            ids, q = shared.value
            graph = graph_library().Index(space="cosine", dim=dim)
            graph.init_index(max_elements=len(v), ef_construction=ef_construction, M=m, random_seed=seed)
            graph.add_items(v, np.arange(len(v)))
            graph.set_ef(max(ef, k))
            labels, far = graph.knn_query(q.astype(np.float32), k=min(k, len(v)))
            labels = np.asarray(labels, np.int64)
            rows = np.repeat(np.arange(len(q)), labels.shape[1])
            yield pa.RecordBatch.from_arrays([ids.take(pa.array(rows)), pa.array(pos[labels.ravel()], pa.int64()), pa.array(1.0 - np.asarray(far, float).ravel())], names=["query_id", "chunk_pos", "score"])

        part = source.mapInArrow(run, schema)
        found = part if found is None else found.unionByName(part)
    if found is None:
        found = spark.createDataFrame([], schema)
    return ranked(found, k, DIGITS)


def ann_bytes(index: str, n: int, dim: int, tables: int = 16, m: int = 16) -> int:
    """Size of an index over n vectors: exact, a float32 matrix; lsh, the matrix and an id and code a table; hnsw, the matrix
    and the links of a graph (2m at its lowest level, m at the others, 1/ln m levels more on average)."""
    matrix = 4 * n * dim
    if index == "lsh":
        return matrix + 16 * n * tables
    if index == "hnsw":
        return matrix + int(4 * n * (2 * m + m / math.log(max(m, 2))) + 8 * n)
    return matrix if index == "exact" else 0


def ann_recall(exact: DataFrame, found: DataFrame, queries: DataFrame) -> DataFrame:
    """(query_id, recall): share of the exact ids found; 1 where there is no exact id."""
    hits = exact.select("query_id", "chunk_pos").join(found.select("query_id", "chunk_pos", F.lit(1).alias("hit")), ["query_id", "chunk_pos"], "left")
    per = hits.groupBy("query_id").agg((F.sum(F.coalesce("hit", F.lit(0))) / F.count(F.lit(1))).alias("recall"))
    return queries.select("query_id").distinct().join(per, "query_id", "left").select("query_id", F.coalesce("recall", F.lit(1.0)).alias("recall"))


def ann_diagnostic(recall: DataFrame, k: int) -> DataFrame:
    """(k, n, mean_recall, min_recall, queries_below_full_recall)."""
    return recall.agg(
        F.lit(k).alias("k"), F.count(F.lit(1)).alias("n"), F.coalesce(F.avg("recall"), F.lit(1.0)).alias("mean_recall"),
        F.coalesce(F.min("recall"), F.lit(1.0)).alias("min_recall"), F.count_if(F.col("recall") < 1).alias("queries_below_full_recall"),
    )
