"""Aggregates, intervals, gates, comparisons and the Pareto frontier over the result table."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from spanforge.functions.stats import ALPHA, RESAMPLES, bootstrap_interval, wilson

MIN_SAMPLE = 20


def reciprocal_rank():
    """1 / rank of the completion, 0 without one; a miss at k may have a rank beyond k."""
    return F.coalesce(F.lit(1.0) / F.col("gold_completion_rank"), F.lit(0.0))


def distinct_results(results: DataFrame) -> DataFrame:
    """One row per (config_id, query_id) of a table with re-delivered rows: rows with null keys go, and of
    repeated pairs one whole row stays, the least in the order of its columns."""
    simple = [c for c in results.columns if not results.schema[c].dataType.simpleString().startswith("map")]
    first = F.row_number().over(W.partitionBy("config_id", "query_id").orderBy(*simple))
    return results.where("config_id is not null and query_id is not null").withColumn("__n", first).where("__n = 1").drop("__n")


def live(results: DataFrame) -> DataFrame:
    return results.where(~F.coalesce("refused", F.lit(False)))


def config_metrics(results: DataFrame, min_sample: int = MIN_SAMPLE) -> DataFrame:
    """(config_id, n, hits, hit_rate, hit_rate_ci, mrr, verdict_suppressed, fragmented_queries) of the rows not refused.

    A null hit counts as a miss. Below min_sample the interval is null and the verdict suppressed.
    Configurations all of whose rows are refused keep a row with n = 0.
    """
    ok = ~F.coalesce("refused", F.lit(False))
    hit = ok & F.coalesce("hit", F.lit(False))
    grouped = results.groupBy("config_id").agg(
        F.count_if(ok).alias("n"), F.count_if(hit).alias("hits"),
        F.coalesce(F.avg(F.when(ok, F.coalesce("hit", F.lit(False)).cast("double"))), F.lit(0.0)).alias("hit_rate"),
        F.coalesce(F.avg(F.when(ok, reciprocal_rank())), F.lit(0.0)).alias("mrr"),
        F.count_if(hit & (F.coalesce(F.size("fragmented_spans"), F.lit(0)) > 0)).alias("fragmented_queries"),
    )
    enough = F.col("n") >= min_sample
    return grouped.select(
        "config_id", "n", "hits", "hit_rate", F.when(enough, wilson(F.col("hits"), F.col("n"))).alias("hit_rate_ci"), "mrr",
        (~enough).alias("verdict_suppressed"), "fragmented_queries",
    )


def stage_breakdown(results: DataFrame) -> DataFrame:
    """(config_id, stage, misses) over misses with a stage."""
    missed = live(results).where(~F.coalesce("hit", F.lit(False)) & F.col("stage_attribution").isNotNull())
    return missed.groupBy("config_id", F.col("stage_attribution").alias("stage")).agg(F.count(F.lit(1)).alias("misses"))


def bootstrap_mrr(results: DataFrame, order: str = "query_id", resamples: int = RESAMPLES, seed: int = 0, alpha: float = ALPHA) -> DataFrame:
    """(config_id, lo, hi): the percentile interval of the mean reciprocal rank, values in ``order``."""

    def interval(pdf: pd.DataFrame) -> pd.DataFrame:
        lo, hi = bootstrap_interval(pdf.sort_values("o")["rr"].to_numpy(), resamples, seed, alpha)
        return pd.DataFrame({"config_id": [pdf["config_id"].iloc[0]], "lo": [lo], "hi": [hi]})

    rows = live(results).select("config_id", F.col(order).alias("o"), reciprocal_rank().alias("rr"))
    return rows.groupBy("config_id").applyInPandas(interval, "config_id string, lo double, hi double")


def paired(results: DataFrame, a: str, b: str, metric: str = "hit") -> DataFrame:
    """(query_id, diff): metric of a less that of b on the queries both have; refused rows stay in."""
    if metric not in ("hit", "rr"):
        raise ValueError("metric must be hit or rr")
    value = F.coalesce("hit", F.lit(False)).cast("double") if metric == "hit" else reciprocal_rank()
    left = results.where(F.col("config_id") == a).select("query_id", value.alias("x"))
    right = results.where(F.col("config_id") == b).select("query_id", value.alias("y"))
    return left.join(right, "query_id").select("query_id", (F.col("x") - F.col("y")).alias("diff"))


def compare_configs(results: DataFrame, a: str, b: str, metric: str = "hit", seed: int = 0, resamples: int = RESAMPLES, alpha: float = ALPHA) -> DataFrame:
    """One row (mean_diff, lo, hi, significant, n); zeros without common queries."""

    def interval(pdf: pd.DataFrame) -> pd.DataFrame:
        d = pdf.sort_values("query_id")["diff"].to_numpy()
        lo, hi = bootstrap_interval(d, resamples, seed, alpha)
        return pd.DataFrame({"mean_diff": [float(np.mean(d))], "lo": [lo], "hi": [hi], "significant": [not lo <= 0 <= hi], "n": [len(d)]})

    schema = "mean_diff double, lo double, hi double, significant boolean, n bigint"
    some = paired(results, a, b, metric).withColumn("one", F.lit(1)).groupBy("one").applyInPandas(interval, schema)
    none = results.sparkSession.createDataFrame([(0.0, 0.0, 0.0, False, 0)], schema)
    return some.unionByName(none).orderBy(F.desc("n")).limit(1)


def compare_all(results: DataFrame, metric: str = "hit", seed: int = 0, resamples: int = RESAMPLES, alpha: float = ALPHA) -> DataFrame:
    """(config_a, config_b, mean_diff, lo, hi, significant, n) of every two configurations with common queries, a < b: as compare_configs."""
    if metric not in ("hit", "rr"):
        raise ValueError("metric must be hit or rr")

    def interval(pdf: pd.DataFrame) -> pd.DataFrame:
        d = pdf.sort_values("query_id")["diff"].to_numpy()
        lo, hi = bootstrap_interval(d, resamples, seed, alpha)
        return pd.DataFrame({"config_a": [pdf["config_a"].iloc[0]], "config_b": [pdf["config_b"].iloc[0]], "mean_diff": [float(np.mean(d))], "lo": [lo], "hi": [hi], "significant": [not lo <= 0 <= hi], "n": [len(d)]})

    value = F.coalesce("hit", F.lit(False)).cast("double") if metric == "hit" else reciprocal_rank()
    left = results.select("query_id", F.col("config_id").alias("config_a"), value.alias("x"))
    right = results.select("query_id", F.col("config_id").alias("config_b"), value.alias("y"))
    both = left.join(right, "query_id").where("config_a < config_b").select("config_a", "config_b", "query_id", (F.col("x") - F.col("y")).alias("diff"))
    return both.groupBy("config_a", "config_b").applyInPandas(interval, "config_a string, config_b string, mean_diff double, lo double, hi double, significant boolean, n bigint")


def paired_means(results: DataFrame, metric: str = "hit") -> DataFrame:
    """(config_a, config_b, n, mean_diff) of every two configurations, a < b: one equi-join on the query."""
    value = F.coalesce("hit", F.lit(False)).cast("double") if metric == "hit" else reciprocal_rank()
    left = results.select("query_id", F.col("config_id").alias("config_a"), value.alias("x"))
    right = results.select("query_id", F.col("config_id").alias("config_b"), value.alias("y"))
    both = left.join(right, "query_id").where("config_a < config_b")
    return both.groupBy("config_a", "config_b").agg(F.count(F.lit(1)).alias("n"), F.avg(F.col("x") - F.col("y")).alias("mean_diff"))


def validity(metrics: DataFrame) -> DataFrame:
    """One row (baseline_broken, verdicts_suppressed); an empty table is neither."""
    return metrics.agg(
        ((F.count(F.lit(1)) > 0) & F.coalesce(F.bool_and(F.col("hit_rate") == 0), F.lit(False))).alias("baseline_broken"),
        F.coalesce(F.bool_or("verdict_suppressed"), F.lit(False)).alias("verdicts_suppressed"),
    )


def rank_configs(metrics: DataFrame, by: str = "hit_rate", order: str = "config_id") -> DataFrame:
    """metrics with rank: by hit_rate then mrr (or the reverse), ties in ``order``. The table has one row a configuration."""
    other = {"hit_rate": "mrr", "mrr": "hit_rate"}[by]
    rank = F.row_number().over(W.orderBy(F.desc(by), F.desc(other), order))
    return metrics.withColumn("rank", rank)


def best_config(metrics: DataFrame, by: str = "hit_rate", order: str = "config_id") -> DataFrame:
    """The first ranked row; none when any verdict is suppressed."""
    gate = validity(metrics)
    return rank_configs(metrics, by, order).where("rank = 1").join(F.broadcast(gate), F.lit(True)).where("not verdicts_suppressed").drop("baseline_broken", "verdicts_suppressed", "rank")


def average_tokens(results: DataFrame) -> DataFrame:
    """(config_id, avg_tokens) of the rows not refused; null tokens count 0."""
    return live(results).groupBy("config_id").agg(F.avg(F.coalesce("retrieved_tokens", F.lit(0)).cast("double")).alias("avg_tokens"))


def pareto_frontier(results: DataFrame, min_sample: int = MIN_SAMPLE) -> DataFrame:
    """(config_id, hit_rate, mrr, avg_tokens) of the configurations no other dominates; equal points all stay.

    Skyline by windows over one row a configuration: a point stays if its hit rate is the best at
    its token count and beats the best at any lower one.
    """
    points = config_metrics(results, min_sample).select("config_id", "hit_rate", "mrr").join(average_tokens(results), "config_id", "left")
    points = points.withColumn("avg_tokens", F.coalesce("avg_tokens", F.lit(0.0)))
    best = points.groupBy("avg_tokens").agg(F.max("hit_rate").alias("top"))
    best = best.withColumn("lower", F.max("top").over(W.orderBy("avg_tokens").rowsBetween(W.unboundedPreceding, -1)))
    kept = points.join(best, "avg_tokens").where((F.col("hit_rate") == F.col("top")) & (F.col("lower").isNull() | (F.col("hit_rate") > F.col("lower"))))
    return kept.select("config_id", "hit_rate", "mrr", "avg_tokens")


def explain_query(results: DataFrame, query_id: str | None = None) -> DataFrame:
    """One row a configuration for the query; for every query without one."""
    rows = results if query_id is None else results.where(F.col("query_id") == query_id)
    return rows.select(
        "query_id", "config_id", "hit", "stage_attribution", "gold_completion_rank", (F.coalesce(F.size("fragmented_spans"), F.lit(0)) > 0).alias("fragmented"), "branch_diag"
    )


def latency_stats(samples: DataFrame, configs: list[str] | None = None) -> DataFrame:
    """(config_id, n, mean_ms, p50_ms, p95_ms) of samples(config_id, ms); percentiles interpolate.

    Configurations of ``configs`` without samples get a row of zeros.
    """
    if configs is not None:
        samples = samples.sparkSession.createDataFrame([(c,) for c in configs], "config_id string").join(samples, "config_id", "left")
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    return samples.groupBy("config_id").agg(
        F.count("ms").alias("n"), zero(F.avg("ms")).alias("mean_ms"), zero(F.percentile("ms", F.lit(0.5))).alias("p50_ms"), zero(F.percentile("ms", F.lit(0.95))).alias("p95_ms")
    )
