"""Occurrences and record counts of all word n-grams from suffix arrays.

Each task builds suffix arrays over blocks of whole records: suffixes of the block's word
sequence, cut at record ends, sorted by their first ``max_n`` words by prefix doubling. For each
n the runs of common prefix >= n are intervals whose length is the n-gram's occurrence count;
its record count is that length less the duplicate adjacencies, i.e. suffixes whose previous
suffix of the same record, in suffix-array order, lies in the same interval. Blocks hold whole
records, so block counts add up; they are summed map-side before the one small shuffle.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

DEFAULT_BLOCK_CHARS = 8_000_000
TERM = re.compile(r"[a-z0-9]+")


def suffix_array(tokens: np.ndarray, left: np.ndarray, depth: int) -> np.ndarray:
    """Suffixes sorted by their first ``depth`` tokens; left[i] is the number of tokens from i to its record's end.

    Prefix doubling: rank by one token, then by pairs of ranks k apart until k >= depth. Suffixes
    that end earlier sort first; equal prefixes keep text order.
    """
    n = len(tokens)
    rank = np.unique(tokens, return_inverse=True)[1].astype(np.int64) + 1
    k = 1
    while k < depth:
        step = min(k, depth - k)
        second = np.zeros(n, np.int64)
        inside = np.flatnonzero(left > step)
        second[inside] = rank[inside + step]
        rank = np.unique(rank * (rank.max() + 2) + second, return_inverse=True)[1].astype(np.int64) + 1
        k += step
    return np.argsort(rank, kind="stable")


def common_prefixes(tokens: np.ndarray, left: np.ndarray, order: np.ndarray, depth: int) -> np.ndarray:
    """lcp[i]: common words, at most depth, of suffixes order[i-1] and order[i]; lcp[0] = 0."""
    a, b = order[:-1], order[1:]
    most = np.minimum(left[a], left[b])
    lcp = np.zeros(len(order), np.int64)
    same = np.ones(len(a), bool)
    last = len(tokens) - 1
    for d in range(depth):
        same = same & (most > d) & (tokens[np.minimum(a + d, last)] == tokens[np.minimum(b + d, last)])
        lcp[1:] += same
    return lcp


def interval_counts(tokens: np.ndarray, records: np.ndarray, left: np.ndarray, max_n: int):
    """Yields (n, first positions, occurrences, record counts) for n = 1..max_n."""
    if not len(tokens):
        return
    order = suffix_array(tokens, left, max_n)
    lcp = common_prefixes(tokens, left, order, max_n)
    owner = records[order]
    by_record = np.argsort(owner, kind="stable")  # within a record in suffix-array order
    previous = np.full(len(order), -1, np.int64)
    follow = owner[by_record][1:] == owner[by_record][:-1]
    previous[by_record[1:][follow]] = by_record[:-1][follow]
    for n in range(1, max_n + 1):
        interval = np.cumsum(lcp < n) - 1  # a suffix shorter than n has lcp < n on both sides
        long = left[order] >= n
        size = int(interval[-1]) + 1
        occurrences = np.bincount(interval[long], minlength=size)
        duplicate = long & (previous >= 0)
        duplicate[duplicate] = interval[previous[duplicate]] == interval[duplicate]
        repeats = np.bincount(interval[duplicate], minlength=size)
        firsts = np.full(size, -1, np.int64)
        starts = np.flatnonzero(np.diff(interval, prepend=-1))
        firsts[interval[starts]] = order[starts]
        real = occurrences > 0
        yield n, firsts[real], occurrences[real], (occurrences - repeats)[real]


def block_counts(texts: list[list[str]], max_n: int) -> list[tuple[int, list[str], np.ndarray, np.ndarray]]:
    """Counts of one block: texts[r] are the texts of record r, between which no n-gram runs."""
    vocabulary: dict[str, int] = {}
    words: list[int] = []
    records, lengths = [], []
    for r, parts in enumerate(texts):
        for part in parts:
            found = TERM.findall(part.lower())
            if found:
                words.extend([vocabulary.setdefault(w, len(vocabulary)) for w in found])
                records.append(r)
                lengths.append(len(found))
    if not words:
        return []
    names = list(vocabulary)
    tokens = np.array(words, np.int64)
    sizes = np.array(lengths, np.int64)
    owner = np.repeat(np.array(records, np.int64), sizes)
    ends = np.repeat(np.cumsum(sizes), sizes)
    left = ends - np.arange(len(tokens))
    out = []
    for n, first, occ, docs in interval_counts(tokens, owner, left, max_n):
        if n == 1:
            grams = [names[t] for t in tokens[first]]
        else:
            grams = [" ".join(names[t] for t in tokens[p : p + n]) for p in first.tolist()]
        out.append((n, grams, occ, docs))
    return out


def distinct_records(df: DataFrame, record_col: str, text_col: str) -> DataFrame:
    """(record, texts): every record once with its distinct non-null texts.

    Copies of a record are merged map-side before the shuffle, so a record that holds a third of
    all rows leaves each task as one row. Rows with a null record are dropped: they belong to none.
    """
    rows = df.select(F.col(record_col).alias("record"), F.col(text_col).cast("string").alias("text"))
    return rows.where(F.col("record").isNotNull()).groupBy("record").agg(F.collect_set("text").alias("texts"))


def ngram_frequencies(df: DataFrame, record_col: str, text_col: str, max_n: int = 1, block_chars: int = DEFAULT_BLOCK_CHARS) -> DataFrame:
    """(n, term, occurrences, records) of every word n-gram up to max_n; n = 0 gives the number of records.

    A record counts once however often it is repeated; repeated equal texts of a record are one
    text; null and empty texts hold no term but count as records. No n-gram runs across texts.
    The row with n = 0 has a null term. An empty table gives an empty result.
    """
    if max_n < 1:
        raise ValueError("max_n must be positive")
    records = distinct_records(df, record_col, text_col).select("texts")

    def emit(block, count):
        counts = block_counts(block, max_n)
        ns = np.concatenate([np.zeros(1, np.int32), *[np.full(len(c[1]), c[0], np.int32) for c in counts]])
        grams = [None] + [g for c in counts for g in c[1]]
        occ = np.concatenate([np.array([count], np.int64), *[c[2] for c in counts]]).astype(np.int64)
        docs = np.concatenate([np.array([count], np.int64), *[c[3] for c in counts]]).astype(np.int64)
        for at in range(0, len(grams), 50_000):
            to = at + 50_000
            yield pa.RecordBatch.from_arrays(
                [pa.array(ns[at:to]), pa.array(grams[at:to], pa.string()), pa.array(occ[at:to]), pa.array(docs[at:to])],
                names=["n", "term", "occurrences", "records"],
            )

    def run(batches):
        block, chars, count = [], 0, 0
        for batch in batches:
            for texts in batch.column(0).to_pylist():
                count += 1
                block.append(texts)
                chars += sum(map(len, texts))
                if chars >= block_chars:
                    yield from emit(block, count)
                    block, chars, count = [], 0, 0
        if count:
            yield from emit(block, count)

    partial = records.mapInArrow(run, "n int, term string, occurrences bigint, records bigint")
    return partial.groupBy("n", "term").agg(F.sum("occurrences").alias("occurrences"), F.sum("records").alias("records"))


def count_records(df: DataFrame, record_col: str) -> int:
    """Distinct non-null records: one number for the driver."""
    return df.select(F.count_distinct(F.col(record_col))).first()[0]


def term_frequencies(df: DataFrame, record_col: str = "chunk_id", text_col: str = "text", rare_at_most: int = 2, common_from: float = 0.2) -> DataFrame:
    """(term, occurrences, records, mark): mark is rare (records <= rare_at_most), common (records >= common_from * N) or null.

    N is the number of distinct records, those without text included. A term that is both rare
    and common (a tiny collection) is marked rare. Nulls, empty texts and repeats as in ngram_frequencies.
    """
    n = count_records(df, record_col)
    terms = ngram_frequencies(df, record_col, text_col, 1).where("n = 1")
    mark = F.when(F.col("records") <= rare_at_most, "rare").when(F.col("records") >= F.lit(common_from) * F.lit(n), "common")
    return terms.select("term", "occurrences", "records", mark.alias("mark"))
