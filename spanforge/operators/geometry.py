"""Embedding-space diagnostics over vectors(id, vector); no n x n matrix is formed."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanforge.functions.text import l2_normalize
from spanforge.operators.dense import dense_topk, usable


def _units(vectors: DataFrame, dim: int) -> DataFrame:
    return usable(vectors, "vector", dim).select("id", l2_normalize(F.col("vector")).alias("u"))


def neighbour_counts(vectors: DataFrame, dim: int, k: int = 10) -> DataFrame:
    """(id, times): how often a vector is among the k nearest of others, unseen ones 0; ties by id.

    Every vector is a query against all, in blocks with partial top-k; k is at most n - 1, and
    below 3 vectors every count is 0.
    """
    rows = usable(vectors.select(F.col("id").cast("bigint").alias("id"), "vector"), "vector", dim)
    n = rows.count()
    k = min(k, n - 1)
    if n < 3:
        return rows.select("id", F.lit(0).cast("bigint").alias("times"))
    near = dense_topk(rows.select(F.col("id").alias("chunk_pos"), "vector"), rows.select(F.col("id").alias("query_id"), "vector"), k, dim, exclude_self=True)
    counts = near.groupBy(F.col("chunk_pos").alias("id")).agg(F.count(F.lit(1)).alias("times"))
    return rows.select("id").join(counts, "id", "left").select("id", F.coalesce("times", F.lit(0)).alias("times"))


def hubness(vectors: DataFrame, dim: int, k: int = 10) -> DataFrame:
    """One row (k, skewness): population skewness of the neighbour counts, 0 without spread."""
    counts = neighbour_counts(vectors, dim, k)
    return counts.agg(F.count(F.lit(1)).alias("n"), F.skewness("times").alias("s")).select(
        F.when(F.col("n") < 3, F.lit(0)).otherwise(F.least(F.lit(k), F.col("n") - 1)).cast("int").alias("k"),
        F.coalesce(F.when(F.isnan("s"), F.lit(0.0)).otherwise(F.col("s")), F.lit(0.0)).alias("skewness"),
    )


def anisotropy(vectors: DataFrame, dim: int) -> DataFrame:
    """One row (mean_cosine, isotropy): the mean cosine of different vectors, (|sum|^2 - sum |v|^2) / (n (n - 1))."""
    u = _units(vectors, dim)
    per = u.select(F.posexplode("u").alias("d", "x")).groupBy("d").agg(F.sum("x").alias("total"), F.sum(F.col("x") * F.col("x")).alias("square"), F.count(F.lit(1)).alias("n"))
    one = per.agg(F.coalesce(F.max("n"), F.lit(0)).alias("n"), F.sum(F.col("total") * F.col("total")).alias("a"), F.sum("square").alias("b"))
    mean = F.when(F.col("n") >= 2, (F.col("a") - F.col("b")) / (F.col("n") * (F.col("n") - 1.0))).otherwise(F.lit(0.0))
    return one.select(mean.alias("mean_cosine"), (1 - mean).alias("isotropy"))


def _centroid(vectors: DataFrame, dim: int, name: str) -> DataFrame:
    return _units(vectors, dim).select(F.posexplode("u").alias("d", "x")).groupBy("d").agg(F.avg("x").alias(name))


def query_corpus_mismatch(queries: DataFrame, corpus: DataFrame, dim: int) -> DataFrame:
    """One row (centroid_cosine, mean_nearest): zeros when either side is empty."""
    both = _centroid(queries, dim, "x").join(_centroid(corpus, dim, "y"), "d")
    centre = both.agg(F.sum(F.col("x") * F.col("y")).alias("xy"), F.sqrt(F.sum(F.col("x") * F.col("x"))).alias("nx"), F.sqrt(F.sum(F.col("y") * F.col("y"))).alias("ny"))
    cosine = F.coalesce(F.when((F.col("nx") > 0) & (F.col("ny") > 0), F.col("xy") / (F.col("nx") * F.col("ny"))), F.lit(0.0))
    near = dense_topk(corpus.select(F.col("id").cast("bigint").alias("chunk_pos"), "vector"), queries.select(F.col("id").alias("query_id"), "vector"), 1, dim)
    nearest = near.agg(F.coalesce(F.avg("score"), F.lit(0.0)).alias("mean_nearest"))
    return centre.select(cosine.alias("centroid_cosine")).join(nearest, F.lit(True))


def notes(skewness: float, mean_cosine: float, mean_nearest: float | None) -> list[str]:
    """Warnings above the usual thresholds: skewness 1, mean cosine 0.3, nearest cosine 0.2."""
    out = []
    if skewness > 1:
        out.append(f"hubness: a few chunks are neighbours of many (skewness {skewness:.2f})")
    if mean_cosine > 0.3:
        out.append(f"anisotropy: vectors crowd in a cone (mean cosine {mean_cosine:.2f})")
    if mean_nearest is not None and mean_nearest < 0.2:
        out.append(f"mismatch: queries lie far from the corpus (mean nearest cosine {mean_nearest:.2f})")
    return out


def render_geometry(skewness: float, k: int, mean_cosine: float, mismatch: tuple[float, float] | None) -> str:
    lines = ["Embedding geometry", f"  hubness: k={k}, skewness={skewness:.3f}", f"  anisotropy: mean cosine={mean_cosine:.3f}, isotropy={1 - mean_cosine:.3f}"]
    if mismatch:
        lines.append(f"  queries vs corpus: centroid cosine={mismatch[0]:.3f}, mean nearest cosine={mismatch[1]:.3f}")
    found = notes(skewness, mean_cosine, mismatch[1] if mismatch else None)
    return "\n".join(lines + [f"  - {n}" for n in found] if found else lines + ["  no warnings"])
