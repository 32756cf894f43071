"""How distinctive a term is per record: positive pointwise mutual information.

PPMI(t, r) = max(0, ln( n_tr * S / (n_t * c_r^alpha) )), S = sum over records of c_r^alpha, with
joint counts n_tr, term counts n_t and record sizes c_r; the context (record) counts are smoothed
by the fractional exponent alpha. Group-bys and joins only.

With presence counts (n_tr = 1, n_t = number of records holding t), exponent 0 and one added to
both counts it is ln((N + 1) / (df + 1)), the same for every record: the collection-level weight.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from spanforge.llm._common import materialise
from spanforge.llm.frequency import count_records, distinct_records

BROADCAST_VOCABULARY = 1_000_000  # at most some 100 MB in an executor; beyond it the shuffle join is used
BROADCAST_TERMS = 400_000  # (query, term) rows, at most some 40 MB; beyond it shuffle joins are used
HOT_ASKERS = 1_000  # a prefix term of more queries than this is spread over SALTS parts,
HOT_TERMS = 10_000  # the most asked of these terms, so that their list stays small; AQE splits what is left
SALTS = 64


def terms_of(text: Column) -> Column:
    """All maximal runs of a-z or 0-9 in the lower-cased text, repeats included; null gives null."""
    return F.filter(F.split(F.lower(text), "[^a-z0-9]+"), lambda t: t != "")


def ppmi(joint: DataFrame, totals: DataFrame, term_counts: DataFrame, alpha: float, added: int = 0, positive: bool = True) -> DataFrame:
    """Adds ``weight`` to joint(term, n_tr, c_r) from term_counts(term, n_t) and the one-row totals(s).

    ``added`` is the count added to S and n_t (add-one smoothing). Terms of joint that
    term_counts lacks count 0 there; with added = 0 their weight is null.
    """
    rows = joint.join(term_counts, "term", "left").join(F.broadcast(totals), F.lit(True))
    context = F.pow(F.col("c_r").cast("double"), F.lit(float(alpha)))
    seen = F.coalesce("n_t", F.lit(0)) + added
    ratio = F.col("n_tr") * (F.col("s") + added) / F.when(seen > 0, seen * context)
    pmi = F.ln(ratio)
    return rows.withColumn("weight", F.greatest(pmi, F.lit(0.0)) if positive else pmi)


def record_terms(df: DataFrame, record_col: str, text_col: str) -> DataFrame:
    """(record, terms): all terms of every distinct record, repeats included; copies are merged before the shuffle."""
    texts = distinct_records(df, record_col, text_col)
    return texts.select("record", F.flatten(F.transform("texts", terms_of)).alias("terms"))


def term_record_weights(df: DataFrame, record_col: str = "chunk_id", text_col: str = "text", alpha: float = 0.75, top: int | None = None, broadcast_vocabulary: int = BROADCAST_VOCABULARY) -> DataFrame:
    """(record, term, count, weight) with weight = PPMI > 0; with ``top`` the most distinctive terms of each record.

    Records without terms (null or empty text) have no row. Ties rank by term. Repeated rows of a
    record count once. Texts are shuffled once, by record, and counting and ranking reuse that
    partitioning; term counts are broadcast if there are at most ``broadcast_vocabulary`` terms,
    otherwise the (record, term) counts are shuffled to join them.
    """
    records = record_terms(df, record_col, text_col).where(F.size("terms") > 0)
    exploded = records.select("record", F.size("terms").alias("c_r"), F.explode("terms").alias("term"))
    joint = exploded.groupBy("record", "c_r", "term").agg(F.count(F.lit(1)).alias("n_tr"))
    term_counts = materialise(exploded.groupBy("term").agg(F.count(F.lit(1)).alias("n_t")))
    if term_counts.limit(broadcast_vocabulary + 1).count() <= broadcast_vocabulary:
        term_counts = F.broadcast(term_counts)
    totals = records.agg(F.coalesce(F.sum(F.pow(F.size("terms").cast("double"), F.lit(float(alpha)))), F.lit(0.0)).alias("s"))
    weighted = ppmi(joint, totals, term_counts, alpha).where("weight > 0")
    out = weighted.select("record", "term", F.col("n_tr").alias("count"), "weight")
    if top is None:
        return out
    rank = F.row_number().over(W.partitionBy("record").orderBy(F.desc(F.round("weight", 9)), "term"))
    return out.withColumn("rank", rank).where(F.col("rank") <= top)


def collection_counts(df: DataFrame, record_col: str, text_col: str) -> tuple[DataFrame, int]:
    """(term, n_t = records holding it) and N, the number of distinct records, those without text included."""
    terms = record_terms(df, record_col, text_col).select(F.explode(F.array_distinct("terms")).alias("term"))
    return terms.groupBy("term").agg(F.count(F.lit(1)).alias("n_t")), count_records(df, record_col)


def collection_weights(df: DataFrame, record_col: str = "chunk_id", text_col: str = "text") -> DataFrame:
    """(term, records, weight): PPMI from presence counts, exponent 0, one added."""
    counts, n = collection_counts(df, record_col, text_col)
    joint = counts.select("term", F.lit(1).alias("n_tr"), F.lit(1).alias("c_r"))
    totals = df.sparkSession.range(1).select(F.lit(float(n)).alias("s"))
    out = ppmi(joint, totals, counts, alpha=0.0, added=1)
    return out.select("term", F.col("n_t").alias("records"), "weight")


def term_sets(queries: DataFrame, query_col: str, text_col: str) -> DataFrame:
    """(query, terms, asked): the distinct terms of each row of queries and a 128-bit key that equal sets share."""
    terms = F.array_sort(F.array_distinct(terms_of(F.col(text_col).cast("string"))))
    rows = queries.where(F.col(query_col).isNotNull()).select(F.col(query_col).alias("query"), terms.alias("terms"))
    return rows.where(F.size("terms") > 0).withColumn("asked", F.substring(F.unhex(F.sha2(F.array_join("terms", " "), 256)), 1, 16))


def query_weights(chunks: DataFrame, sets: DataFrame, share: float, record_col: str, text_col: str) -> DataFrame:
    """(asked, term, weight, total, first): each term of each distinct set of query terms.

    first marks the rare-first prefix: a record that holds none of these terms cannot reach
    ``share`` of the total, as the weights left are less.
    """
    counts, n = collection_counts(chunks, record_col, text_col)
    distinct = sets.select("asked", "terms").dropDuplicates(["asked"])  # repeated questions are handled once
    joint = distinct.select("asked", F.explode("terms").alias("term"), F.lit(1).alias("n_tr"), F.lit(1).alias("c_r"))
    totals = chunks.sparkSession.range(1).select(F.lit(float(n)).alias("s"))
    weighted = ppmi(joint, totals, counts, alpha=0.0, added=1).select("asked", "term", "weight")
    whole = W.partitionBy("asked")
    rest = F.sum("weight").over(whole.orderBy(F.desc("weight"), "term").rowsBetween(0, W.unboundedFollowing))
    return weighted.withColumns({"total": F.sum("weight").over(whole), "rest": rest}).select(
        "asked", "term", "weight", "total", (F.col("rest") >= F.col("total") * share - 1e-9).alias("first")
    )


def match_records(
    chunks: DataFrame,
    queries: DataFrame,
    share: float = 0.5,
    record_col: str = "chunk_id",
    text_col: str = "text",
    query_col: str = "id",
    query_text_col: str = "text",
    broadcast_terms: int = BROADCAST_TERMS,
) -> DataFrame:
    """(query_id, chunk_id): records whose terms make at least ``share`` of the query's total weight.

    Candidates hold a term of the query's rare-first prefix, so common terms' postings are never
    read; a candidate is verified once, by the exact sum. A record must hold at least one of the query's terms. Queries without terms, null ids
    and records without text give no row; repeated rows give one, and each text of a repeated id
    is judged on its own. The (query, term) weights are broadcast if
    they number at most ``broadcast_terms``; otherwise postings and candidates are joined by
    shuffles, in which the rows of a term that many ask for are spread over SALTS parts.
    """
    sets = term_sets(queries, query_col, query_text_col)
    weights = materialise(query_weights(chunks, sets, share, record_col, text_col))
    first = weights.where("first").select("term", "asked")
    full = weights.groupBy("asked").agg(F.max("total").alias("total"), F.sort_array(F.collect_list(F.struct("term", "weight", "first"))).alias("weights"))  # as long as a query
    records = chunks.where(F.col(record_col).isNotNull()).select(
        F.col(record_col).alias("record"), F.array_distinct(terms_of(F.col(text_col).cast("string"))).alias("terms")
    )
    if weights.limit(broadcast_terms + 1).count() <= broadcast_terms:
        hits = records.select("record", "terms", F.explode("terms").alias("term")).join(F.broadcast(first), "term").join(F.broadcast(full), "asked")
        prefix = F.filter("weights", lambda w: w["first"] & F.array_contains("terms", w["term"]))
        found = hits.where(F.get(prefix, 0)["term"] == F.col("term"))
    else:
        asked_often = first.groupBy("term").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > HOT_ASKERS).orderBy(F.desc("n"), "term").limit(HOT_TERMS)
        often = F.broadcast(asked_often.select("term", F.lit(SALTS).alias("parts")))
        salted = first.join(often, "term", "left").select("term", "asked", F.explode(F.sequence(F.lit(0), F.coalesce("parts", F.lit(1)) - 1)).alias("salt"))
        postings = records.select("record", F.explode("terms").alias("term")).join(often, "term", "left")
        postings = postings.select("record", "term", F.when(F.col("parts").isNotNull(), F.pmod(F.xxhash64("record"), F.lit(SALTS)).cast("int")).otherwise(0).alias("salt"))
        pairs = postings.join(salted, ["term", "salt"]).select("asked", "record").distinct()
        found = pairs.join(full, "asked").join(records.dropDuplicates(["record", "terms"]), "record")
    held = F.aggregate(F.filter("weights", lambda w: F.array_contains("terms", w["term"])), F.lit(0.0), lambda a, w: a + w["weight"])
    exact = found.where(held >= F.col("total") * share - 1e-9).select("asked", "record").distinct()
    return exact.join(sets.select("query", "asked").distinct(), "asked").select(F.col("query").alias("query_id"), F.col("record").alias("chunk_id")).distinct()
