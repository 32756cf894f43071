"""Gold spans, coverage and the one hit predicate.

Tables: gold_spans(query_id, alt_idx, span_idx, span_id, source_id, start, end, quoted_text,
source_version); items(keys..., query_id, rank, source_id, start, end, n_tokens), keys naming the
configuration and stage. Coverage joins items with spans on query and source, with the overlap as
residual predicate, so it stays a hash join.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from spanforge.functions.text import content_hash, stable_hash, union_length

MIN_COVERAGE = 0.8


class OffsetVerificationError(ValueError):
    """Gold offsets, quotes or versions disagree with the loaded documents."""


def gold_spans(queries: DataFrame) -> DataFrame:
    """One row per required span of queries(query_id, gold); null gold and empty alternatives give none."""
    alts = queries.select("query_id", F.posexplode("gold.alternatives").alias("alt_idx", "alt"))
    spans = alts.select("query_id", "alt_idx", F.posexplode("alt.required_spans").alias("span_idx", "s"))
    return spans.select(
        "query_id", "alt_idx", "span_idx",
        stable_hash(F.col("s.source_id"), F.col("s.start"), F.col("s.end")).alias("span_id"),
        "s.source_id", "s.start", "s.end", "s.quoted_text", "s.source_version",
    )


def required_spans(spans: DataFrame) -> DataFrame:
    """First-seen distinct spans of each query, over all alternatives."""
    first = F.row_number().over(W.partitionBy("query_id", "span_id").orderBy("alt_idx", "span_idx"))
    return spans.withColumn("first", first).where("first = 1").drop("first")


def verify_spans(spans: DataFrame, documents: DataFrame, version_chars: int | None = None) -> DataFrame:
    """spans with ``reason``: unknown_source, version_mismatch, out_of_range, quote_mismatch or null, the first that holds.

    A recorded version must be the text's SHA-256. With ``version_chars`` sources that record
    only its first characters are accepted too, if they record at least so many.
    """
    docs = documents.select(F.col("id").alias("source_id"), F.col("text").alias("d_text"), F.lit(True).alias("known"))
    actual, recorded = content_hash(F.col("d_text")), F.col("source_version")
    same = actual == recorded
    if version_chars is not None:
        if version_chars <= 0:
            raise ValueError("version_chars must be positive")
        same = same | ((F.length(recorded) >= version_chars) & (F.substring(actual, F.lit(1), F.length(recorded)) == recorded))
    reason = (
        F.when(F.col("known").isNull(), "unknown_source")
        .when(recorded.isNotNull() & ~same, "version_mismatch")
        .when(F.col("end") > F.length("d_text"), "out_of_range")
        .when(~F.substring(F.col("d_text"), F.col("start") + 1, F.col("end") - F.col("start")).eqNullSafe(F.col("quoted_text")), "quote_mismatch")
    )
    return spans.join(docs, "source_id", "left").withColumn("reason", reason).drop("d_text", "known")


def load_verified(queries: DataFrame, documents: DataFrame, strict: bool = True, version_chars: int | None = None) -> DataFrame:
    """The queries whose spans all verify; strict raises on the first that does not. Versions as in verify_spans."""
    bad = verify_spans(gold_spans(queries), documents, version_chars).where("reason is not null")
    if strict:
        row = bad.orderBy("query_id", "alt_idx", "span_idx").first()
        if row is not None:
            raise OffsetVerificationError(f"query {row['query_id']}: {row['reason']} in source {row['source_id']} at [{row['start']}, {row['end']})")
    return queries.join(bad.select("query_id").distinct(), "query_id", "left_anti")


def author_spans(entries: DataFrame, documents: DataFrame) -> DataFrame:
    """Offsets and version of quotes: entries(query_id, alt_idx, span_idx, source_id, quote, occurrence).

    The n-th occurrence is searched from one after the previous start. Adds start, end (null when
    absent or the quote is empty), quoted_text, source_version and reason.
    """
    docs = documents.select(F.col("id").alias("source_id"), F.col("text").alias("d_text"), F.lit(True).alias("known"))
    joined = entries.join(docs, "source_id", "left")
    find = F.aggregate(
        F.sequence(F.lit(0), F.coalesce("occurrence", F.lit(0))), F.lit(0),
        lambda at, i: F.when((i > 0) & (at == 0), F.lit(0)).otherwise(F.call_function("locate", F.col("quote"), F.col("d_text"), at + 1)),
    )
    at = F.when(F.length("quote") > 0, find)
    start = F.when(at > 0, at - 1)
    reason = F.when(F.col("known").isNull(), "unknown_source").when(F.coalesce(F.length("quote"), F.lit(0)) == 0, "empty_quote").when(start.isNull(), "quote_not_found")
    return joined.withColumns({"start": start, "reason": reason}).withColumns({
        "end": F.col("start") + F.length("quote"), "quoted_text": F.col("quote"), "source_version": content_hash(F.col("d_text")),
    }).drop("d_text", "known", "quote")


def overlaps(items: DataFrame, spans: DataFrame, keys: list[str]) -> DataFrame:
    """Each overlap of an item with a span: keys, query_id, alt_idx, span_idx, span_id, length, rank, s, e."""
    i = items.select(*keys, "query_id", "rank", "source_id", F.col("start").alias("i_start"), F.col("end").alias("i_end"))
    g = spans.select("query_id", "alt_idx", "span_idx", "span_id", "source_id", "start", "end")
    met = g.join(i, (g["query_id"] == i["query_id"]) & (g["source_id"] == i["source_id"]) & (F.col("i_start") < F.col("end")) & (F.col("i_end") > F.col("start")))
    return met.select(
        *keys, g["query_id"], "alt_idx", "span_idx", "span_id", (F.col("end") - F.col("start")).alias("length"), "rank",
        F.greatest("i_start", "start").alias("s"), F.least("i_end", "end").alias("e"),
    )


def span_coverage(items: DataFrame, spans: DataFrame, keys: list[str]) -> DataFrame:
    """Per touched span: coverage by the union of items, best single coverage."""
    per = overlaps(items, spans, keys).groupBy(*keys, "query_id", "alt_idx", "span_idx", "span_id").agg(
        F.first("length").alias("length"), F.collect_list(F.struct("s", "e")).alias("iv"), F.max(F.col("e") - F.col("s")).alias("longest")
    )
    length = F.col("length").cast("double")
    return per.select(*keys, "query_id", "alt_idx", "span_idx", "span_id", (union_length(F.col("iv")) / length).alias("coverage"), (F.col("longest") / length).alias("best_single"))


def satisfied(coverage: DataFrame, spans: DataFrame, groups: DataFrame, keys: list[str], least: float = MIN_COVERAGE) -> DataFrame:
    """(keys, query_id, hit) for every row of groups(keys, query_id): some alternative has all its spans covered.

    Spans no item touches count as uncovered; queries without gold have no hit.
    """
    need = spans.groupBy("query_id", "alt_idx").agg(F.count(F.lit(1)).alias("need"))
    have = coverage.where(F.col("coverage") >= least).groupBy(*keys, "query_id", "alt_idx").agg(F.count(F.lit(1)).alias("have"))
    won = have.join(need, ["query_id", "alt_idx"]).where("have = need").select(*keys, "query_id", F.lit(True).alias("hit")).distinct()
    return groups.select(*keys, "query_id").join(won, [*keys, "query_id"], "left").withColumn("hit", F.coalesce("hit", F.lit(False)))


def completion_rank(items: DataFrame, spans: DataFrame, keys: list[str], least: float = MIN_COVERAGE) -> DataFrame:
    """(keys, query_id, rank): the smallest prefix that satisfies gold; queries that never do have no row.

    Coverage grows with the prefix, so it is the minimum over alternatives of the maximum over
    spans of the first rank at which a span is covered.
    """
    span = [*keys, "query_id", "alt_idx", "span_idx"]
    prefix = W.partitionBy(*span).orderBy("rank").rowsBetween(W.unboundedPreceding, 0)
    o = overlaps(items, spans, keys).withColumn("iv", F.collect_list(F.struct("s", "e")).over(prefix))
    reached = o.where(union_length(F.col("iv")) / F.col("length").cast("double") >= least).groupBy(*span).agg(F.min("rank").alias("rank"))
    need = spans.groupBy("query_id", "alt_idx").agg(F.count(F.lit(1)).alias("need"))
    alt = reached.groupBy(*keys, "query_id", "alt_idx").agg(F.max("rank").alias("rank"), F.count(F.lit(1)).alias("have"))
    return alt.join(need, ["query_id", "alt_idx"]).where("have = need").groupBy(*keys, "query_id").agg(F.min("rank").alias("rank"))


def fragmented(coverage: DataFrame, keys: list[str], least: float = MIN_COVERAGE) -> DataFrame:
    """(keys, query_id, span_id) covered by the union but by no single item."""
    return coverage.where((F.col("coverage") >= least) & (F.col("best_single") < least)).select(*keys, "query_id", "span_id").distinct()
