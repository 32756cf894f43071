"""The registered queries of this subpackage, over whole tables with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanforge.llm import distinctive, encoding, frequency, mixing, neardup, neighbors, residue, splitting
from spanforge.llm._common import materialise, table


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    pairs = neighbors.similar_pairs(table(spark, d, "chunk_vectors"))
    return pairs.select(F.least("vec", "other").alias("vec_id_a"), F.greatest("vec", "other").alias("vec_id_b")).distinct()


def p1_recall(spark: SparkSession, d: str) -> DataFrame:
    vectors = table(spark, d, "chunk_vectors")
    return neighbors.recall_report(vectors, neighbors.similar_pairs(vectors))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return splitting.split_oversized(table(spark, d, "documents"), limit=1500, overlap=150, window=750, placement="full")


def p2_balanced(spark: SparkSession, d: str) -> DataFrame:
    return splitting.split_oversized(table(spark, d, "documents"), limit=1500, overlap=150, placement="balanced")


def p2_balanced_summary(spark: SparkSession, d: str) -> DataFrame:
    """Of each oversized document where its balanced pieces begin and end, and whether all keep the limit and overlap by 150."""
    pieces = p2_balanced(spark, d).groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("piece_start", "piece_end"))).alias("p"))  # as long as one document
    follow = F.forall(F.sequence(F.lit(1), F.size("p") - 1), lambda i: F.col("p")[i]["piece_start"] == F.col("p")[i - 1]["piece_end"] - 150)
    return pieces.select(
        "doc_id", F.col("p")[0]["piece_start"].alias("first_start"), F.element_at("p", -1)["piece_end"].alias("last_end"),
        F.forall("p", lambda x: x["piece_end"] - x["piece_start"] <= 1500).alias("within"), follow.alias("overlap"),
    )


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return distinctive.match_records(table(spark, d, "chunks"), table(spark, d, "queries"), share=0.5)


def p3_weights(spark: SparkSession, d: str) -> DataFrame:
    return distinctive.collection_weights(table(spark, d, "chunks")).select("term", "records", F.round("weight", 6).alias("weight"))


def p3_top_terms(spark: SparkSession, d: str) -> DataFrame:
    out = distinctive.term_record_weights(table(spark, d, "chunks"), alpha=0.75, top=5)
    return out.select(F.col("record").alias("chunk_id"), "term", "count", F.round("weight", 6).alias("weight"), "rank")


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    members, links = neardup.near_duplicate_classes(table(spark, d, "documents"), words=3, threshold=0.7, min_words=50)
    return neardup.near_duplicate_pairs(members, links).select(F.col("doc_a").alias("doc_id_a"), F.col("doc_b").alias("doc_id_b"))


def p4_groups(spark: SparkSession, d: str) -> DataFrame:
    members, links = neardup.near_duplicate_classes(table(spark, d, "documents"), words=5, threshold=0.8, min_words=50)
    return neardup.near_duplicate_groups(members, links).select(F.col("doc").alias("doc_id"), "class_id", "copies", "links")


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return frequency.term_frequencies(table(spark, d, "chunks")).where("mark is not null").select("term", "mark")


def p5_terms(spark: SparkSession, d: str) -> DataFrame:
    return frequency.term_frequencies(table(spark, d, "chunks"))


def p5_ngrams(spark: SparkSession, d: str) -> DataFrame:
    return frequency.ngram_frequencies(table(spark, d, "chunks"), "chunk_id", "text", max_n=2).where("n = 2").select("term", "occurrences", "records")


def p5_ngrams_all(spark: SparkSession, d: str) -> DataFrame:
    """Counts of one to five words."""
    return frequency.ngram_frequencies(table(spark, d, "chunks"), "chunk_id", "text", max_n=5).where("n > 0").select("n", "term", "occurrences", "records")


def p6_ids(spark: SparkSession, d: str) -> DataFrame:
    return encoding.encode_documents(table(spark, d, "documents"))


def p6_round_trip(spark: SparkSession, d: str) -> DataFrame:
    """The hash of each document's text after encoding and decoding; null texts come back empty."""
    back = encoding.decode_documents(encoding.encode_documents(table(spark, d, "documents")))
    return back.select("doc_id", F.sha2("text", 256).alias("version"))


def p6_tree(spark: SparkSession, d: str) -> DataFrame:
    """Texts whose token ids differ between leaves of 64 characters and of the usual size, by number of tokens: counts."""
    docs = table(spark, d, "documents")
    small = encoding.encode_documents(docs, leaf_chars=64).select("doc_id", F.sha2(F.array_join("ids", " "), 256).alias("small"))
    usual = encoding.encode_documents(docs).select("doc_id", F.sha2(F.array_join("ids", " "), 256).alias("usual"))
    both = small.join(usual, "doc_id")
    return both.agg(F.count(F.lit(1)).alias("documents"), F.count_if(F.col("small") == F.col("usual")).alias("equal"))


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    """The outcomes of the mix itself."""
    return p7_report(spark, d).select("source", "outcome")


def p7_mix(spark: SparkSession, d: str) -> DataFrame:
    sizes, plan = mixing.prepare(table(spark, d, "documents"), table(spark, d, "mix_targets"))
    mix = mixing.mix_documents(sizes, plan)
    return mix.select(F.col("doc").alias("doc_id"), F.col("name").alias("source"), "pass", "n_tokens", "position")


def p7_report(spark: SparkSession, d: str) -> DataFrame:
    sizes, plan = mixing.prepare(table(spark, d, "documents"), table(spark, d, "mix_targets"))
    return mixing.mix_report(mixing.mix_documents(sizes, plan), plan)


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return residue.find_residue(table(spark, d, "documents")).select(F.col("doc").alias("doc_id"))


def p8_kept(spark: SparkSession, d: str) -> DataFrame:
    return residue.exclude_residue(table(spark, d, "documents")).select("doc_id", "text")


def p8_templates(spark: SparkSession, d: str) -> DataFrame:
    mined = residue.mine_templates(table(spark, d, "documents"))
    return mined.where("verdict is not null").select("leaf", "template", "messages", "verdict")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        f.__name__: f
        for f in (
            p1_found, p1_recall, p2_found, p2_balanced, p2_balanced_summary, p3_found, p3_weights, p3_top_terms, p4_found, p4_groups, p5_found, p5_terms, p5_ngrams, p5_ngrams_all,
            p6_ids, p6_round_trip, p6_tree, p7_found, p7_mix, p7_report, p8_found, p8_kept, p8_templates,
        )
    }


_TERMS = r"""
terms AS (SELECT DISTINCT chunk_id, unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) AS term FROM chunks WHERE chunk_id IS NOT NULL),
n AS (SELECT count(DISTINCT chunk_id) AS n FROM chunks),
df AS (SELECT term, count(*) AS df FROM terms GROUP BY term)
"""



def _similar_pairs(words: int, threshold: float) -> str:
    """j(a, b, j): Jaccard similarity of documents that share a prefix n-gram; c(doc_id, c): set sizes."""
    gram = " || ' ' || ".join(f"w[i + {k}]" for k in range(words))
    return rf"""
WITH w AS (SELECT doc_id, regexp_extract_all(lower(text), '[\p{{L}}\p{{N}}_]+') AS w FROM documents WHERE text IS NOT NULL),
s AS (SELECT DISTINCT doc_id, unnest(list_transform(range(1, len(w) - {words - 2}), lambda i: {gram})) AS g FROM w WHERE len(w) >= 50),
c AS (SELECT doc_id, count(*) AS c FROM s GROUP BY doc_id),
f AS (SELECT g, count(*) AS f FROM s GROUP BY g),
o AS (SELECT doc_id, g, row_number() OVER (PARTITION BY doc_id ORDER BY f, g) AS r FROM s JOIN f USING (g)),
p AS (SELECT doc_id, g FROM o JOIN c USING (doc_id) WHERE r <= c - ceil({threshold} * c - 1e-9) + 1),
k AS (SELECT DISTINCT a.doc_id AS a, b.doc_id AS b FROM p a JOIN p b ON a.g = b.g AND a.doc_id < b.doc_id),
i AS (SELECT a, b, count(*) AS i FROM k JOIN s x ON x.doc_id = a JOIN s y ON y.doc_id = b AND y.g = x.g GROUP BY a, b),
j AS (SELECT a, b, i::DOUBLE / (ca.c + cb.c - i) AS j FROM i JOIN c ca ON ca.doc_id = a JOIN c cb ON cb.doc_id = b)"""


_COSINES = """
WITH v AS (
  SELECT DISTINCT vec_id, model, embedding::DOUBLE[] AS e FROM chunk_vectors
  WHERE embedding IS NOT NULL AND len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
sims AS (
  SELECT a.model, a.vec_id AS x, b.vec_id AS y, list_cosine_similarity(a.e, b.e) AS s
  FROM v a JOIN v b ON a.model = b.model AND a.vec_id <> b.vec_id),
best AS (SELECT model, x, y, row_number() OVER (PARTITION BY x ORDER BY s DESC, y) AS r FROM sims WHERE s >= 0.92)"""

_RECORDS = r"""
texts AS (SELECT DISTINCT chunk_id, text FROM chunks WHERE chunk_id IS NOT NULL AND text IS NOT NULL),
words AS (SELECT chunk_id, text, regexp_extract_all(lower(text), '[a-z0-9]+') AS w FROM texts)
"""


def oracle_sql() -> dict[str, str]:
    return {
        "p1_found": f"{_COSINES} SELECT DISTINCT least(x, y) AS vec_id_a, greatest(x, y) AS vec_id_b FROM best WHERE r <= 5",
        "p2_found": r"""
WITH RECURSIVE p AS (
  SELECT doc_id, text, 0 AS s, length(text)::INT AS n FROM documents WHERE length(text) > 1500
  UNION ALL
  SELECT doc_id, text, e - 150, n FROM (
    SELECT doc_id, text, n, CASE WHEN n - s <= 1500 THEN n
      WHEN k1 > 750 THEN s + k1 WHEN k2 > 750 THEN s + k2 WHEN k3 > 750 THEN s + k3 WHEN k4 > 750 THEN s + k4 ELSE s + 1500 END AS e
    FROM (SELECT *, coalesce(1501 - nullif(strpos(w, chr(10) || chr(10)), 0), 0) AS k1, coalesce(1501 - nullif(strpos(w, chr(10)), 0), 0) AS k2,
      greatest(coalesce(1501 - nullif(strpos(w, ' .'), 0), 0), coalesce(1501 - nullif(strpos(w, ' !'), 0), 0),
        coalesce(1501 - nullif(strpos(w, ' ?'), 0), 0), coalesce(1501 - nullif(strpos(w, '。'), 0), 0),
        coalesce(1501 - nullif(strpos(w, '！'), 0), 0), coalesce(1501 - nullif(strpos(w, '？'), 0), 0)) AS k3,
      coalesce(1501 - nullif(strpos(w, ' '), 0), 0) AS k4
      FROM (SELECT *, array_to_string(list_transform(range(0, 1500), lambda i: substr(text, s + 1500 - i, 1)), '') AS w FROM p WHERE n - s > 1500))))
SELECT doc_id, s::INT AS piece_start, coalesce(lead(s) OVER (PARTITION BY doc_id ORDER BY s) + 150, n)::INT AS piece_end FROM p""",
        "p2_balanced_summary": "SELECT doc_id, 0::INT AS first_start, length(text)::INT AS last_end, true AS within, true AS overlap FROM documents WHERE length(text) > 1500",
        "p1_recall": f"""
{_COSINES},
q AS (SELECT model, x, count(*) FILTER (r <= 5) AS c FROM best WHERE x % 20 = 0 GROUP BY model, x)
SELECT model, 5::INT AS k, count(*)::INT AS n, 1.0::DOUBLE AS mean_recall, 1.0::DOUBLE AS min_recall, 0::INT AS queries_below_full_recall FROM q GROUP BY model""",
        "p3_found": f"""
WITH {_TERMS},
q AS (SELECT DISTINCT id, unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) AS term FROM queries WHERE id IS NOT NULL),
w AS (SELECT id, q.term, ln((n.n + 1.0) / (coalesce(df, 0) + 1)) AS w FROM q LEFT JOIN df USING (term), n),
t AS (SELECT id, sum(w) AS t FROM w GROUP BY id),
s AS (SELECT id, chunk_id, sum(w) AS s FROM w JOIN terms USING (term) GROUP BY id, chunk_id)
SELECT id AS query_id, chunk_id FROM s JOIN t USING (id) WHERE s >= 0.5 * t - 1e-9""",
        "p3_weights": f"""
WITH {_TERMS} SELECT term, df::BIGINT AS records, round(ln((n.n + 1.0) / (df + 1)), 6)::DOUBLE AS weight FROM df, n""",
        "p3_top_terms": f"""
WITH {_RECORDS},
t AS (SELECT chunk_id, unnest(w) AS term FROM words),
c AS (SELECT chunk_id, count(*) AS c_r FROM t GROUP BY chunk_id),
j AS (SELECT chunk_id, term, count(*) AS n_tr FROM t GROUP BY chunk_id, term),
m AS (SELECT term, count(*) AS n_t FROM t GROUP BY term),
s AS (SELECT sum(pow(c_r, 0.75)) AS s FROM c),
p AS (SELECT chunk_id, term, n_tr, ln(n_tr * s.s / (n_t * pow(c_r, 0.75))) AS w FROM j JOIN c USING (chunk_id) JOIN m USING (term), s),
r AS (SELECT *, row_number() OVER (PARTITION BY chunk_id ORDER BY round(w, 9) DESC, term) AS rank FROM p WHERE w > 0)
SELECT chunk_id, term, n_tr::BIGINT AS count, round(w, 6)::DOUBLE AS weight, rank::INT AS rank FROM r WHERE rank <= 5""",
        "p4_found": f"""
{_similar_pairs(3, 0.7)}
SELECT a AS doc_id_a, b AS doc_id_b FROM j WHERE j >= 0.7""",
        "p4_groups": f"""
{_similar_pairs(5, 0.8)},
e AS (SELECT a AS doc_id, b AS other, j FROM j WHERE j >= 0.8 UNION ALL SELECT b, a, j FROM j WHERE j >= 0.8)
SELECT c.doc_id, least(c.doc_id, coalesce(min(other) FILTER (j = 1), c.doc_id)) AS class_id, count(other) FILTER (j = 1) AS copies, count(other) FILTER (j < 1) AS links
FROM c LEFT JOIN e ON e.doc_id = c.doc_id GROUP BY c.doc_id""",
        "p5_found": f"""
WITH {_TERMS}
SELECT term, CASE WHEN df <= 2 THEN 'rare' ELSE 'common' END AS mark FROM df, n WHERE df <= 2 OR df >= 0.2::DOUBLE * n.n""",
        "p5_terms": f"""
WITH {_RECORDS}, n AS (SELECT count(DISTINCT chunk_id) AS n FROM chunks),
t AS (SELECT chunk_id, unnest(w) AS term FROM words),
c AS (SELECT term, count(*)::BIGINT AS occurrences, count(DISTINCT chunk_id)::BIGINT AS records FROM t GROUP BY term)
SELECT term, occurrences, records, CASE WHEN records <= 2 THEN 'rare' WHEN records >= 0.2::DOUBLE * n.n THEN 'common' END AS mark FROM c, n""",
        "p5_ngrams": f"""
WITH {_RECORDS},
t AS (SELECT chunk_id, unnest(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) AS term FROM words)
SELECT term, count(*)::BIGINT AS occurrences, count(DISTINCT chunk_id)::BIGINT AS records FROM t GROUP BY term""",
        "p6_round_trip": "SELECT doc_id, sha256(coalesce(text, '')) AS version FROM documents",
        "p6_tree": "SELECT count(*) AS documents, count(*) AS equal FROM documents",
    }
