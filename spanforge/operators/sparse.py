"""BM25 over chunk tables.

Statistics are one pass over the chunks (document frequencies of the query terms only, and two scalars).
Scoring streams the chunks once past all queries, one task a core, so only partial top-k rows are
shuffled. A query's best chunks either hold one of its rare terms, or are among the best for its
common terms alone. The latter are searched once for all queries that share them: a task keeps the
best k of each such set of terms, and does not meet postings of terms that are too common to bring
a chunk among the best. The queries' terms go to every
task; beyond QUERY_BLOCK queries they do so in parts, each with a pass of its own.
"""

from __future__ import annotations

import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from spanforge.functions.text import word_tokens
from spanforge.operators.topk import TopK
from spanforge.plans.session import blocks, materialise

K1, B = 1.5, 0.75
DIGITS = 9  # scores are compared to this many digits
QUERY_BLOCK = 200_000  # queries sent to every task at a time: some 60 MB
FIRST, LARGEST = 256, 16_384  # chunks scored at a time, at first and at most
PAIRS = 2_000_000  # pairs of query and chunk met at a time
TALLIED = 500_000  # terms whose chunks a task counts at a time
BELOW = 2e-9  # by which an unrounded score may miss the rounded one
RARE_COST = 8  # a posting of a rare term, met by each query and scored in full, against one of a common term
_TOKEN = re.compile(r"[a-z0-9]+")


def corpus_statistics(chunks: DataFrame) -> DataFrame:
    """One row: n chunks (empty ones too) and avgdl."""
    size = F.coalesce(F.size(word_tokens(F.coalesce("text", F.lit("")))), F.lit(0))
    return chunks.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.avg(size), F.lit(0.0)).alias("avgdl"))


def document_frequencies(chunks: DataFrame) -> DataFrame:
    """(term, df); map-side combined before the shuffle."""
    terms = chunks.select(F.explode(F.array_distinct(word_tokens(F.col("text")))).alias("term"))
    return terms.groupBy("term").agg(F.count(F.lit(1)).alias("df"))


def _tally(batches):
    """Chunks' texts -> (term, chunks that hold it) in parts of bounded size, and the term '' with the number of chunks and of words."""
    held, n, words = Counter(), 0, 0
    rows = lambda *x: pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(x, (pa.string(), pa.int64(), pa.int64()))], names=["term", "df", "words"])
    for batch in batches:
        for text in batch.column(0).to_pylist():
            found = _TOKEN.findall(text.lower()) if text else ()
            held.update(set(found))
            words += len(found)
        n += batch.num_rows
        if len(held) > TALLIED:
            yield rows(list(held), list(held.values()), [0] * len(held))
            held.clear()
    yield rows([*held, ""], [*held.values(), n], [0] * len(held) + [words])


def idf(df, n):
    return F.ln(1 + (n - df + 0.5) / (df + 0.5))


def term_statistics(chunks: DataFrame) -> DataFrame:
    """(term, df, idf) of the whole collection."""
    totals = corpus_statistics(chunks).select("n")
    return document_frequencies(chunks).join(F.broadcast(totals), F.lit(True)).select("term", "df", idf(F.col("df"), F.col("n")).alias("idf"))


def query_terms(queries: DataFrame) -> DataFrame:
    """(query_id, term) of distinct terms."""
    return queries.select("query_id", F.explode(F.array_distinct(word_tokens(F.col("text")))).alias("term"))


def bm25_topk(chunks: DataFrame, queries: DataFrame, k: int, k1: float = K1, b: float = B) -> DataFrame:
    """(query_id, rank, chunk_pos, score): scores above 0, ranked by score to nine digits, then corpus order.

    Chunks need chunk_pos and text, queries query_id and text. k <= 0, queries without terms and
    terms outside the collection give no row; null texts have no terms.
    """
    spark = chunks.sparkSession
    kind = queries.schema["query_id"].dataType.simpleString()
    schema = f"query_id {kind}, chunk_pos bigint, score double"
    if k <= 0:
        return spark.createDataFrame([], f"query_id {kind}, rank int, chunk_pos bigint, score double")
    terms = materialise(query_terms(queries))
    wanted = terms.select("term").unionByName(spark.createDataFrame([("",)], "term string")).distinct()
    tally = materialise(chunks.select("text").mapInArrow(_tally, "term string, df bigint, words bigint").join(wanted, "term", "left_semi").groupBy("term").agg(F.sum("df").alias("df"), F.sum("words").alias("words")))
    n, words = tally.where("term = ''").select("df", "words").first() or (0, 0)
    avgdl = words / n if n else 0.0
    weighted = terms.join(tally.where("term <> ''"), "term")
    weighted = materialise(weighted.select("query_id", "term", "df", idf(F.col("df"), F.lit(n)).alias("idf")))
    found = None
    for block in blocks(weighted.select("query_id").distinct(), "query_id", QUERY_BLOCK):
        rows = weighted.join(block, "query_id", "left_semi").orderBy("query_id", "term").toArrow()
        of_query, of_term = (rows.column(c).combine_chunks().dictionary_encode() for c in ("query_id", "term"))
        query, term = of_query.indices.to_numpy().astype(np.int64), of_term.indices.to_numpy().astype(np.int64)
        weight, df = np.zeros(len(of_term.dictionary)), np.zeros(len(of_term.dictionary), np.int64)
        weight[term], df[term] = rows.column("idf").to_numpy(), rows.column("df").to_numpy()
        rare = df <= _rare_below(query, term, df)
        pattern, patterns = _patterns(query[~rare[term]], term[~rare[term]], len(of_query.dictionary))
        shared = spark.sparkContext.broadcast((of_term.dictionary.to_pylist(), weight, rare, query, term, patterns, len(pattern)))
        part = chunks.select("chunk_pos", "text").coalesce(spark.sparkContext.defaultParallelism).mapInArrow(_scorer(shared, avgdl, k, k1, b), "of_pattern boolean, place bigint, chunk_pos bigint, score double")
        part = materialise(part)
        asked = spark.createDataFrame(pa.table({"query_id": of_query.dictionary, "place": pa.array(np.arange(len(pattern))), "pattern": pa.array(pattern)}))
        of_patterns = ranked(part.where("of_pattern").select(F.col("place").alias("query_id"), "chunk_pos", "score"), k)
        alike = of_patterns.withColumnRenamed("query_id", "pattern").join(asked, "pattern")
        own = part.where("not of_pattern").join(asked, "place")
        # a chunk found both ways has its whole score from the rare terms
        both = own.unionByName(alike, allowMissingColumns=True).groupBy(F.col("query_id").cast(kind).alias("query_id"), "chunk_pos").agg(F.max("score").alias("score"))
        found = both if found is None else found.unionByName(both)
    if found is None:
        found = spark.createDataFrame([], schema)
    return ranked(found, k)


def _rare_below(query: np.ndarray, term: np.ndarray, df: np.ndarray) -> int:
    """The document frequency up to which a term counts as rare: that with the fewest postings to meet."""
    of = df[term]
    code = np.random.default_rng(0).integers(1, 1 << 63, len(df), np.uint64)[term]
    best, least = 0, np.inf
    for bound in [0, *(4**i for i in range(1 + int(of.max(initial=1)).bit_length() // 2 + 1))]:
        common = of > bound
        keys, postings = np.zeros(int(query.max(initial=-1)) + 1, np.uint64), np.zeros(int(query.max(initial=-1)) + 1)
        np.add.at(keys, query[common], code[common])
        np.add.at(postings, query[common], of[common])
        cost = postings[np.unique(keys, return_index=True)[1]].sum() + RARE_COST * of[~common].sum()
        if cost < least:
            best, least = bound, cost
    return best


def _patterns(query: np.ndarray, term: np.ndarray, n: int) -> tuple[np.ndarray, tuple[np.ndarray, np.ndarray, int]]:
    """(pattern of each of n queries, -1 without terms; (pattern, term) rows and number of the patterns), a pattern being a set of terms; rows are sorted."""
    first = np.searchsorted(query, np.arange(n + 1))
    seen: dict[bytes, int] = {}
    of = np.full(n, -1, np.int64)
    for i in np.flatnonzero(np.diff(first)):
        of[i] = seen.setdefault(term[first[i] : first[i + 1]].tobytes(), len(seen))
    sets = [np.frombuffer(x, np.int64) for x in seen]
    return of, (np.repeat(np.arange(len(sets)), [len(x) for x in sets]), np.concatenate([np.zeros(0, np.int64), *sets]), len(sets))


def ranked(found: DataFrame, k: int, digits: int = DIGITS) -> DataFrame:
    rank = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc(F.round("score", digits)), "chunk_pos"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "chunk_pos", "score")


def _scorer(shared, avgdl: float, k: int, k1: float, b: float):
    """The task's best k of each pattern, and of each query among the chunks that hold one of its rare terms.

    A pattern's terms are sorted by the most that each adds to a chunk of the batch. Terms that
    together stay below the pattern's k-th score so far cannot make a chunk one of the best, so
    only chunks holding one of the others are met, and of those only the ones that could still
    reach that score with the rest are scored in full.
    """

    def run(batches):
        terms, weight, rare, query, term, (p_query, p_term, patterns), n = shared.value
        number = {t: i for i, t in enumerate(terms)}
        asked, own = (_Postings(*_by_term(*rows, len(weight)), weight, size) for *rows, size in ((p_query, p_term, patterns), (query, term, n)))
        wanted = _by_term(query[rare[term]], term[rare[term]], len(weight))
        top, single = TopK(patterns, k, DIGITS), TopK(n, k, DIGITS)
        done, size = 0, FIRST
        for batch in batches:
            pos = batch.column(0).to_numpy()
            lo = 0
            while lo < len(pos):
                texts = batch.column(1).slice(lo, size).to_pylist()
                at = pos[lo : lo + size]
                chunk, word, count, lengths = _counted(texts, number)
                impact = weight[word] * count * (k1 + 1) / (count + (k1 * (1 - b + b * lengths / avgdl))[chunk])
                _score_holders(single, own, wanted, chunk, word, impact, at)
                common = ~rare[word]
                _score(top, asked, chunk[common], word[common], impact[common], at)
                lo += size
                done += 1
                if done & (done - 1) == 0:  # scores to beat are known early, and then from time to time
                    top.settle()
                size = min(4 * size, LARGEST)
        for of_pattern, best in ((True, top), (False, single)):
            q, p, s = best.best()
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(q), of_pattern)), pa.array(q, pa.int64()), pa.array(p, pa.int64()), pa.array(s, pa.float64())], names=["of_pattern", "place", "chunk_pos", "score"])

    return run


def _by_term(query: np.ndarray, term: np.ndarray, terms: int) -> tuple[np.ndarray, np.ndarray]:
    """(where the queries of each term begin and the last end, queries by term)."""
    order = np.argsort(term, kind="stable")
    return np.searchsorted(term[order], np.arange(terms + 1)), query[order]


class _Postings:
    """Queries of each term and terms of each query."""

    def __init__(self, ends: np.ndarray, of: np.ndarray, weight: np.ndarray, n: int):
        self.n, self.weight = n, weight
        term = np.repeat(np.arange(len(weight)), np.diff(ends))
        order = np.lexsort((term, of))
        self.query, self.term = of[order], term[order]  # by query, then term
        self.first = np.searchsorted(self.query, np.arange(n + 1))


def _counted(texts: list, number: dict[str, int]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(chunk, term, count) of the queries' terms in texts, by term and chunk, and the texts' lengths in words."""
    found = [_TOKEN.findall(t.lower()) if t else [] for t in texts]
    lengths = np.fromiter(map(len, found), np.int64, len(found))
    term = np.fromiter((number.get(t, -1) for part in found for t in part), np.int64, int(lengths.sum()))
    key = (term * len(texts) + np.repeat(np.arange(len(texts)), lengths))[term >= 0]
    key, count = np.unique(key, return_counts=True)
    term, chunk = np.divmod(key, max(len(texts), 1))
    return chunk, term, count, lengths


def _ranges(first: np.ndarray, size: np.ndarray) -> np.ndarray:
    """first[0], first[0] + 1, ... of size[0] places, then those of the next."""
    ends = np.cumsum(size)
    return np.repeat(first - ends + size, size) + np.arange(ends[-1] if len(ends) else 0)


def _score(top: TopK, asked: _Postings, chunk: np.ndarray, term: np.ndarray, impact: np.ndarray, positions: np.ndarray) -> None:
    """Push the chunks of a batch, given as postings (by term, then chunk) with what each adds to a score."""
    if not len(term):
        return
    start = np.flatnonzero(np.diff(term, prepend=-1))
    df, most = np.zeros(len(asked.weight), np.int64), np.zeros(len(asked.weight))
    begin = np.zeros(len(asked.weight), np.int64)
    met = term[start]
    df[met], most[met], begin[met] = np.diff(start, append=len(term)), np.maximum.reduceat(impact, start), start
    e = np.flatnonzero(df[asked.term])
    q, t = asked.query[e], asked.term[e]
    # terms by what they add at most; the first of a query, as far as they stay below its k-th score, bring no chunk
    order = np.lexsort((most[t], q))
    q, t = q[order], t[order]
    total = np.cumsum(most[t])
    new = np.flatnonzero(np.diff(q, prepend=-1))
    before = np.repeat(total[new] - most[t[new]], np.diff(new, append=len(q)))
    upto = (total - before) * (1 + 1e-12) + BELOW
    idle = upto < top.floor[q]
    rest = np.zeros(asked.n)
    np.maximum.at(rest, q[idle], upto[idle])
    q, t = q[~idle], t[~idle]
    cuts = np.searchsorted(np.cumsum(df[t]), np.arange(PAIRS, int(df[t].sum()) + PAIRS, PAIRS), "right") if len(q) else []
    lo = 0
    for hi in cuts:
        hi = int(np.searchsorted(q, q[min(hi, len(q) - 1)], "right"))  # whole queries
        if hi > lo:
            _score_pairs(top, asked, q[lo:hi], t[lo:hi], df, begin, chunk, term, impact, rest, positions)
            lo = hi


def _score_pairs(top: TopK, asked: _Postings, q: np.ndarray, t: np.ndarray, df: np.ndarray, begin: np.ndarray, chunk: np.ndarray, term: np.ndarray, impact: np.ndarray, rest: np.ndarray, positions: np.ndarray) -> None:
    n = len(positions)
    at = _ranges(begin[t], df[t])
    key = np.repeat(q, df[t]) * n + chunk[at]
    order = np.argsort(key, kind="stable")
    key, gain = key[order], impact[at][order]
    start = np.flatnonzero(np.diff(key, prepend=-1))
    if not len(start):
        return
    pair, score = key[start], np.add.reduceat(gain, start)
    able = score + rest[pair // n] + BELOW >= top.floor[pair // n]
    pair = pair[able]
    _push_whole(top, asked, pair, chunk, term, impact, positions)


def _score_holders(top: TopK, own: _Postings, wanted: tuple[np.ndarray, np.ndarray], chunk: np.ndarray, term: np.ndarray, impact: np.ndarray, positions: np.ndarray) -> None:
    """Push the chunks that hold a rare term of a query, for each such query; some whole chunks at a time."""
    ends, of = wanted
    times = np.diff(ends)[term]
    held = np.flatnonzero(times)
    held = held[np.argsort(chunk[held], kind="stable")]
    last = np.append(np.flatnonzero(np.diff(chunk[held])), len(held) - 1) + 1 if len(held) else np.zeros(0, np.int64)
    met = np.append(0, np.cumsum(times[held]))[last]
    cuts = last[np.unique(np.append(np.searchsorted(met, np.arange(PAIRS, met[-1], PAIRS)), len(last) - 1))] if len(last) else []
    for lo, hi in zip([0, *cuts], cuts):
        part = held[lo:hi]
        q = of[_ranges(ends[term[part]], times[part])]
        pair = q * len(positions) + np.repeat(chunk[part], times[part])
        _push_whole(top, own, np.unique(pair), chunk, term, impact, positions)


def _push_whole(top: TopK, asked: _Postings, pair: np.ndarray, chunk: np.ndarray, term: np.ndarray, impact: np.ndarray, positions: np.ndarray) -> None:
    """Pairs (query * chunks + chunk) scored in full: the query's terms in order, each looked up among the batch's postings."""
    n = len(positions)
    a, c = np.divmod(pair, n)
    size = asked.first[a + 1] - asked.first[a]
    terms = asked.term[_ranges(asked.first[a], size)]
    wanted = terms * n + np.repeat(c, size)
    postings = term * n + chunk
    place = np.minimum(np.searchsorted(postings, wanted), len(postings) - 1)
    add = np.where(postings[place] == wanted, impact[place], 0.0)
    if len(a):
        top.push_found(a, positions[c], np.add.reduceat(add, np.cumsum(size) - size))
