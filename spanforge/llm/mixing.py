"""Mixing sources to target weights by a time-varying curriculum.

Each source has a weight schedule over training time t in [0, 1], linear from 1-g to 1+g times
its share of the mix, so its integral over the whole training is its share. The slopes g are
centred on their mean weighted by the shares, so the weights of all sources add up to 1 at every
t and position t has a share t of all tokens before it. Integrating a schedule gives the
cumulative demand W(t) = t + g(t^2 - t); a document whose tokens lie at fraction u of the
source's demand gets the position t with W(t) = u (closed form), and the mix is range-sorted by
position. Fractions come from a two-level prefix sum: documents are hashed into buckets, bucket
totals are summed in order, and running sums are formed inside a bucket only, so a source with a
third of all rows is spread over all tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from spanforge.llm._common import materialise
from spanforge.llm.encoding import DEFAULT_VOCABULARY, count_tokens

ROWS_PER_BUCKET = 20_000


def normal_source(c: Column) -> Column:
    """Lower-cased, without surrounding white space."""
    return F.lower(F.regexp_replace(c.cast("string"), r"^[\s\p{Z}]+|[\s\p{Z}]+$", ""))


def source_sizes(docs: DataFrame, text_col: str = "text", source_col: str = "source", id_col: str = "doc_id", vocabulary: str = DEFAULT_VOCABULARY) -> DataFrame:
    """(doc, name, n_tokens) of every document that has a source."""
    rows = docs.select(F.col(id_col).alias("doc"), normal_source(F.col(source_col)).alias("name"), F.col(text_col).alias("text"))
    return count_tokens(rows.where(F.col("name").isNotNull()), "text", ["doc", "name"], vocabulary)


def mix_plan(sizes: DataFrame, targets: DataFrame) -> DataFrame:
    """One row per row of targets: source, name, target_share, max_repeats, available, wanted, limit, outcome.

    A null target_share counts as 0, a null max_repeats as 1, a source without documents has 0
    tokens available. wanted = target_share * T, T the tokens of all documents of listed sources.
    """
    wanted = targets.select(
        "source",
        normal_source(F.col("source")).alias("name"),
        F.coalesce(F.col("target_share").cast("double"), F.lit(0.0)).alias("target_share"),
        F.coalesce(F.col("max_repeats").cast("bigint"), F.lit(1)).alias("max_repeats"),
    )
    names = wanted.select("name").where(F.col("name").isNotNull()).distinct()
    totals = names.join(sizes.groupBy("name").agg(F.sum("n_tokens").alias("available")), "name", "left")
    totals = totals.withColumn("available", F.coalesce("available", F.lit(0)))
    grand = totals.agg(F.coalesce(F.sum("available"), F.lit(0)).alias("all_tokens"))  # one row
    plan = wanted.join(totals, "name", "left").join(F.broadcast(grand), F.lit(True))
    plan = plan.withColumn("available", F.coalesce("available", F.lit(0))).withColumn("wanted", F.col("target_share") * F.col("all_tokens"))
    most = F.col("max_repeats") * F.col("available")
    return plan.select(
        "source", "name", "target_share", "max_repeats", "available", "wanted",
        F.least(F.col("wanted"), most.cast("double")).alias("limit"),
        F.when(F.col("wanted") <= F.col("available"), "trimmed").when(F.col("wanted") <= most, "repeated").otherwise("short").alias("outcome"),
    )


def invert_demand(u: Column, g: Column) -> Column:
    """t in [0, 1] with t + g(t^2 - t) = u, in the form that is stable for g near 0."""
    b = 1 - g
    root = F.sqrt(F.greatest(b * b + 4 * g * u, F.lit(0.0)))
    return F.when(u <= 0, F.lit(0.0)).otherwise(F.least(2 * u / (b + root), F.lit(1.0)))


def mix_documents(sizes: DataFrame, plan: DataFrame, slope: Column | None = None, seed: int = 7) -> DataFrame:
    """(doc, name, pass, n_tokens, position), range-sorted by position.

    A source's documents are taken in hash order, pass after pass, as long as a copy's middle
    lies inside the source's limit; none is used more than max_repeats times. Documents without
    tokens take no place. ``slope`` gives g before centring from the plan's columns, at most 1/2
    either way (default: half the share's rank from front to back; equal slopes = constant
    weights). ``sizes`` should be materialised: it is read twice. Bucket totals are one row a
    bucket of ROWS_PER_BUCKET documents and source, summed in order for each source by a window.
    """
    n = sizes.count()
    buckets = max(1, -(-n // ROWS_PER_BUCKET))
    order = F.percent_rank().over(W.partitionBy(F.lit(0)).orderBy("target_share", "name"))
    # One row per distinct listed source: as small as the list of targets.
    per_source = (
        plan.where((F.col("limit") > 0) & (F.col("available") > 0))
        .groupBy("name").agg(*[F.max(c).alias(c) for c in ("target_share", "max_repeats", "available", "limit")])
        .withColumn("g", F.greatest(F.lit(-0.5), F.least(F.lit(0.5), slope if slope is not None else order - 0.5)))
    )
    every = W.partitionBy(F.lit(0))
    per_source = per_source.withColumn("g", F.col("g") - F.sum(F.col("g") * F.col("limit")).over(every) / F.sum("limit").over(every))
    rows = (
        sizes.where("n_tokens > 0")
        .withColumn("h", F.xxhash64("doc", F.lit(seed)))
        .withColumn("bucket", F.pmod("h", F.lit(buckets)))
    )
    sums = rows.groupBy("name", "bucket").agg(F.sum("n_tokens").alias("size"))
    before = sums.withColumn(
        "offset", F.sum("size").over(W.partitionBy("name").orderBy("bucket").rowsBetween(W.unboundedPreceding, -1))
    ).select("name", "bucket", F.coalesce("offset", F.lit(0)).alias("offset"))
    run = F.sum("n_tokens").over(W.partitionBy("name", "bucket").orderBy("h", "doc").rowsBetween(W.unboundedPreceding, 0))
    placed = (
        rows.withColumn("run", run)
        .join(before, ["name", "bucket"])
        .join(per_source, "name")
        .withColumn("middle", F.col("offset") + F.col("run") - F.col("n_tokens") / 2)
    )
    passes = F.floor((F.col("limit") - F.col("middle")) / F.col("available")) + 1  # pass p: p*available + middle <= limit
    passes = F.least(passes, F.col("max_repeats"))
    copies = placed.where("middle <= limit").withColumn("pass", F.explode(F.sequence(F.lit(0).cast("bigint"), passes - 1)))
    u = (F.col("pass") * F.col("available") + F.col("middle")) / F.col("limit")
    out = copies.select("doc", "name", F.col("pass").cast("int").alias("pass"), "n_tokens", invert_demand(u, F.col("g")).alias("position"))
    return out.orderBy("position", "name", "doc", "pass")


def mix_report(mix: DataFrame, plan: DataFrame) -> DataFrame:
    """Per source of the plan: target and actual share, tokens available, used and missing, most copies of a document, outcome.

    The outcome is read off the mix: short when every document was used as often as allowed and
    tokens are missing, repeated when all documents were used and one pass is not enough, else
    trimmed. Tokens a short source cannot give are not made up by other sources: each of these
    keeps its own target, and ``deficit`` states what is missing.
    """
    used = mix.groupBy("name").agg(F.sum("n_tokens").alias("used"), F.max("pass").alias("last"))
    every = used.agg(F.sum("used").alias("everything"))  # one row
    joined = plan.join(used, "name", "left").join(F.broadcast(every), F.lit(True)).withColumn("used", F.coalesce("used", F.lit(0)))
    beyond = F.col("wanted") > F.col("available")
    outcome = F.when(beyond & (F.col("used") >= F.col("max_repeats") * F.col("available")) & (F.col("wanted") > F.col("used")), "short").when(beyond & (F.col("used") >= F.col("available")), "repeated").otherwise("trimmed")
    return joined.select(
        "source", "target_share",
        (F.col("used") / F.col("everything")).alias("actual_share"),
        F.col("available").alias("tokens_available"),
        F.col("used").alias("tokens_used"),
        F.greatest(F.col("wanted") - F.col("limit"), F.lit(0.0)).alias("deficit"),
        F.coalesce(F.col("last") + 1, F.lit(0)).alias("passes"),
        outcome.alias("outcome"),
    )


def prepare(docs: DataFrame, targets: DataFrame, vocabulary: str = DEFAULT_VOCABULARY) -> tuple[DataFrame, DataFrame]:
    """Token sizes, computed once into the shared folder, and the plan over them."""
    sizes = materialise(source_sizes(docs, vocabulary=vocabulary))
    return sizes, mix_plan(sizes, targets)
