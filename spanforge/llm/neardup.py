"""Near-duplicate texts with small edits: rare-first prefix filtering.

Every text becomes its set of word n-gram hashes (64 bit). All sets are ordered by one global
order, rare n-grams first. Two sets with Jaccard similarity >= t share their first m common
n-grams among the first n - ceil(t*n) + m of either, so only these prefixes are joined and only
pairs that meet m times there are candidates (m = 1 for sets too small to share more). A shared
prefix n-gram passes the length filter (n_a >= t*n_b) and the positional filter (matches still
possible from the two positions); pairs then pass the suffix filter (the sets, divided at fixed
pivots, differ in at least the sum of the parts' size differences) and are verified once.

Frequencies for the order come from a table of fixed size that counts all n-grams of all texts;
where n-grams share a cell the order is only less sharp, never wrong. Texts with equal sets form
a class and are handled once. An n-gram whose cell exceeds ``hot`` (at least four times the mean
cell) is joined in blocks of its texts, so no task sees a whole hot group; nothing is capped.
"""

from __future__ import annotations

import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanforge.llm._common import materialise

WORD = re.compile(r"\w+")  # Unicode letters, numbers and "_"
CELL_BITS = (20, 24)  # frequency cells: 4 MB for small corpora, never more than 64 MB
SLICES = 64
SALTS = 256
SIGNATURE = 64  # pivots of the suffix filter
HOT = 4096
SHARED = 3  # prefix n-grams that a candidate pair has in common
POSTINGS_PER_TASK = 1_000_000
FLUSH = 1_000_000  # postings or pairs packed into blobs at a time
BROADCAST_IDS = 1_000_000  # 8 MB of ids; beyond it a shuffle join
_M1, _M2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _M2
    return x ^ (x >> np.uint64(27))


class _Known(dict):
    """Hashes of the words met so far."""

    def __init__(self):
        import xxhash

        super().__init__()
        self.hash = xxhash.xxh3_64_intdigest

    def __missing__(self, word: str) -> int:
        v = self[word] = self.hash(word)
        return v


class Shingler:
    """Sets of word n-gram hashes; keeps the hashes of words (bounded)."""

    def __init__(self, words: int, min_words: int):
        self.words, self.min_words, self.known = words, max(min_words, words), _Known()

    def sets(self, texts: list[str | None]):
        """(index, sorted distinct hashes) of each text with enough words."""
        lists, at, size = [], [], 0
        for i, text in enumerate(texts):
            found = WORD.findall(text.lower()) if text else ()
            if len(found) >= self.min_words:
                lists.append(found)
                at.append(i)
                size += len(found)
                if size > 2_000_000:
                    yield from self._sets(lists, at)
                    lists, at, size = [], [], 0
        yield from self._sets(lists, at)

    def _sets(self, lists, at):
        if not lists:
            return
        if len(self.known) > 500_000:
            self.known.clear()
        known = self.known.__getitem__
        h = np.fromiter((v for found in lists for v in map(known, found)), np.uint64)
        n = len(h) - self.words + 1
        x = h[:n]
        for i in range(1, self.words):
            x = _mix(x * _M1 + h[i : i + n])
        start = 0
        for i, found in zip(at, lists):  # n-grams that reach into the next text are left out
            g = np.sort(x[start : start + len(found) - self.words + 1])
            start += len(found)
            new = np.empty(len(g), bool)
            new[0] = True
            np.not_equal(g[1:], g[:-1], out=new[1:])
            yield i, g[new]


def class_key(grams: np.ndarray) -> int:
    """Signed 64-bit hash of a set."""
    import xxhash

    v = xxhash.xxh3_64_intdigest(grams.tobytes())
    return v - (1 << 64) if v >= 1 << 63 else v


def signature(grams: np.ndarray) -> bytes:
    """Sizes (at most 255) of the parts of a set between fixed pivots."""
    return np.minimum(np.bincount((grams >> np.uint64(58)).astype(np.int64), minlength=SIGNATURE), 255).astype(np.uint8).tobytes()


def prefix_length(n: int, threshold: float, shared: int = 1) -> int:
    return min(n, n - int(np.ceil(threshold * n - 1e-9)) + shared)


def needed_overlap(a: np.ndarray, b: np.ndarray, threshold: float) -> np.ndarray:
    return np.ceil(threshold / (1 + threshold) * (a + b) - 1e-9).astype(np.int64)


def _texts(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return df.select(F.col(id_col).alias("doc"), F.col(text_col).cast("string").alias("text")).where("doc is not null")


def cell_bits(texts: DataFrame) -> int:
    """Bits of the cell table from the plan's size estimate; texts are measured where there is none."""
    size = int(str(texts._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    if size >= 1 << 62:
        size = texts.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    return min(max((size >> 6).bit_length(), CELL_BITS[0]), CELL_BITS[1])


def _statistics(texts: DataFrame, words: int, min_words: int, bits: int) -> DataFrame:
    """Rows of two kinds: one per text with enough words (doc, key, n, sig), and slices of each task's cell counts."""
    kind = texts.schema["doc"].dataType.simpleString()

    def run(batches):
        shingle = Shingler(words, min_words)
        cells = np.zeros(1 << bits, np.int64)
        any_text = False
        doc_type = None
        for batch in batches:
            take, keys, sizes, sigs, grams = [], [], [], [], []
            doc_type = batch.column(0).type
            for i, g in shingle.sets(batch.column(1).to_pylist()):
                take.append(i)
                keys.append(class_key(g))
                sizes.append(len(g))
                sigs.append(signature(g))
                grams.append(g)
            if take:
                any_text = True
                cells += np.bincount((np.concatenate(grams) >> np.uint64(64 - bits)).astype(np.int64), minlength=len(cells))
                k = len(take)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(pa.array(take, pa.int32())), pa.array(keys, pa.int64()), pa.array(sizes, pa.int32()), pa.array(sigs, pa.binary()), pa.nulls(k, pa.int32()), pa.nulls(k, pa.binary())],
                    names=["doc", "key", "n", "sig", "slice", "cells"],
                )
        if any_text:
            parts = [zlib.compress(x.tobytes(), 1) for x in np.split(cells.astype(np.uint32), SLICES)]
            yield pa.RecordBatch.from_arrays(
                [pa.nulls(SLICES, doc_type), pa.nulls(SLICES, pa.int64()), pa.nulls(SLICES, pa.int32()), pa.nulls(SLICES, pa.binary()), pa.array(range(SLICES), pa.int32()), pa.array(parts, pa.binary())],
                names=["doc", "key", "n", "sig", "slice", "cells"],
            )

    return texts.mapInArrow(run, f"doc {kind}, key bigint, n int, sig binary, slice int, cells binary")


def _frequencies(statistics: DataFrame, bits: int) -> np.ndarray:
    """The summed cell table: of bounded size, so it may be sent to every task."""

    def add(pdf):
        total = sum(np.frombuffer(zlib.decompress(x), np.uint32).astype(np.uint64) for x in pdf["cells"])
        return pdf.head(1).assign(cells=[zlib.compress(np.minimum(total, 2**32 - 1).astype(np.uint32).tobytes(), 1)])[["slice", "cells"]]

    slices = statistics.where("slice is not null").select("slice", "cells", F.pmod(F.spark_partition_id(), F.lit(SALTS)).alias("salt"))
    partly = slices.groupBy("slice", "salt").applyInPandas(add, "slice int, cells binary")  # so that no group holds all tasks' slices
    rows = partly.groupBy("slice").applyInPandas(add, "slice int, cells binary").collect()
    cells = np.zeros((SLICES, (1 << bits) // SLICES), np.uint32)
    for r in rows:
        cells[r["slice"]] = np.frombuffer(zlib.decompress(r["cells"]), np.uint32)
    return cells.ravel()


def pack(parts: np.ndarray, columns: list[np.ndarray]):
    """(part, blob) of the rows of each part: their columns one after the other, so that a row costs no more than its bytes."""
    order = np.argsort(parts, kind="stable")
    columns = [c[order] for c in columns]
    values, starts = np.unique(parts[order], return_index=True)
    ends = [*starts[1:], len(order)]
    return values, [b"".join(c[s:e].tobytes() for c in columns) for s, e in zip(starts, ends)]


def unpack(blobs: list[bytes], kinds: list) -> list[np.ndarray]:
    width = sum(np.dtype(k).itemsize for k in kinds)
    out = [[] for _ in kinds]
    for blob in blobs:
        n, at = len(blob) // width, 0
        for into, kind in zip(out, kinds):
            into.append(np.frombuffer(blob, kind, n, at))
            at += n * np.dtype(kind).itemsize
    return [np.concatenate(x) if x else np.zeros(0, k) for x, k in zip(out, kinds)]


def _blob_batch(parts: np.ndarray, columns: list[np.ndarray]) -> pa.RecordBatch:
    values, blobs = pack(parts, columns)
    return pa.RecordBatch.from_arrays([pa.array(values, pa.int32()), pa.array(blobs, pa.binary())], names=["part", "rows"])


_POSTING = [np.uint32, np.uint16, np.int32, np.int8, np.uint16, np.int64, np.int32]  # gram (upper 48 bits), salt, side, pos, key, n


def _postings(texts: DataFrame, cells, words: int, min_words: int, threshold: float, hot: int, shared: int, parts: int) -> DataFrame:
    """Packed postings of each class's prefix, once per task, by the part of their n-gram."""

    def run(batches):
        shingle, table, seen, out, size = Shingler(words, min_words), cells.value, set(), [], 0
        shift = np.uint64(65 - len(table).bit_length())

        def flush():
            grams, salt, side, pos, keys, sizes = (np.concatenate(x) for x in zip(*out))
            where = (_mix(grams + salt.astype(np.int64).view(np.uint64) * _M1) % np.uint64(parts)).astype(np.int32)
            # Fewer bits and a capped position only let more pairs through to verification, never fewer.
            high, low = (grams >> np.uint64(32)).astype(np.uint32), (grams >> np.uint64(16)).astype(np.uint16)
            return _blob_batch(where, [high, low, salt, side, np.minimum(pos, 65_535).astype(np.uint16), keys, sizes])

        for batch in batches:
            for _, g in shingle.sets(batch.column(0).to_pylist()):
                key = class_key(g)
                if key in seen:
                    continue
                if len(seen) < 2_000_000:
                    seen.add(key)
                count = table[(g >> shift).astype(np.int64)]
                order = np.argsort(count, kind="stable")[: prefix_length(len(g), threshold, shared)]
                grams, count = g[order], count[order]
                m = len(grams)
                pos = np.arange(m, dtype=np.int32)
                salt, side = np.full(m, -1, np.int32), np.full(m, 2, np.int8)
                if count[-1] > hot:
                    big = np.flatnonzero(count > hot)
                    extra = [(np.delete(grams, big), np.delete(salt, big), np.delete(side, big), np.delete(pos, big))]
                    for p in big.tolist():  # blocks of texts against blocks of texts
                        blocks = min(-(-int(count[p]) // hot), 30_000)
                        own = key % blocks
                        other = np.arange(blocks, dtype=np.int32)
                        lo, hi = np.minimum(own, other), np.maximum(own, other)
                        s = np.where(other == own, 2, np.where(own < other, 0, 1)).astype(np.int8)
                        extra.append((np.full(blocks, grams[p]), (lo * 32_768 + hi).astype(np.int32), s, np.full(blocks, pos[p], np.int32)))
                    grams, salt, side, pos = (np.concatenate(x) for x in zip(*extra))
                out.append((grams, salt, side, pos, np.full(len(grams), key, np.int64), np.full(len(grams), len(g), np.int32)))
                size += len(grams)
                if size >= FLUSH:
                    yield flush()
                    out, size = [], 0
        if out:
            yield flush()

    return texts.select("text").mapInArrow(run, "part int, rows binary")


def candidate_pairs(gram, salt, side, pos, key, n, threshold: float, shared: int, most: int = 2_000_000):
    """Yields (keys a, keys b, times), a < b, of rows with equal (gram, salt) that pass the length and positional filters.

    times counts towards ``shared``; pairs that need not share so many n-grams count at once.
    """
    order = np.lexsort((key, n, salt, gram))
    gram, salt, side, pos, key, n = (x[order] for x in (gram, salt, side, pos, key, n))
    if not len(gram):
        return
    once = np.ones(len(gram), bool)  # a class of copies comes once from every task
    once[1:] = (gram[1:] != gram[:-1]) | (salt[1:] != salt[:-1]) | (key[1:] != key[:-1])
    gram, salt, side, pos, key, n = (x[once] for x in (gram, salt, side, pos, key, n))
    new = np.ones(len(gram), bool)
    new[1:] = (gram[1:] != gram[:-1]) | (salt[1:] != salt[:-1])
    run = np.cumsum(new)
    span = np.int64(1) << 32
    code = run.astype(np.int64) * span + n
    longest = np.floor(n / threshold + 1e-9).astype(np.int64)  # n is the smaller of the two
    upto = np.searchsorted(code, run.astype(np.int64) * span + longest, side="right")
    many = upto - np.arange(len(gram)) - 1
    ends = np.cumsum(many)
    lo = 0
    while lo < len(gram):
        base = ends[lo - 1] if lo else 0
        hi = max(lo + 1, int(np.searchsorted(ends, base + most, side="right")))
        c = many[lo:hi]
        total = int(c.sum())
        if total:
            a = np.repeat(np.arange(lo, hi), c)
            b = a + 1 + np.arange(total) - np.repeat(np.cumsum(c) - c, c)
            rest = np.minimum(n[a] - pos[a], n[b] - pos[b]) + np.minimum(pos[a], pos[b])
            need = needed_overlap(n[a], n[b], threshold)
            good = (rest >= need) & (key[a] != key[b]) & ((side[a] != side[b]) | (side[a] == 2))
            x, y = key[a[good]], key[b[good]]
            yield np.minimum(x, y), np.maximum(x, y), np.where(need[good] < shared, shared, 1).astype(np.int32)
        lo = hi


def summed(a: np.ndarray, b: np.ndarray, times: np.ndarray):
    """Distinct pairs with their times added."""
    order = np.lexsort((b, a))
    a, b, times = a[order], b[order], times[order]
    new = np.ones(len(a), bool)
    new[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
    starts = np.flatnonzero(new)
    return a[starts], b[starts], np.add.reduceat(times, starts).astype(np.int32) if len(starts) else times


def _candidates(postings: DataFrame, parts: int, threshold: float, shared: int) -> DataFrame:
    """(a, b) of the pairs of classes that meet ``shared`` times.

    Pairs, whose number no one knows before, are added by an aggregation that spills.
    """

    def join(batches):
        blobs = [x for batch in batches for x in batch.column(1).to_pylist()]
        out, size = [], 0

        def flush():
            a, b, times = summed(*(np.concatenate(x) for x in zip(*out)))
            return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), pa.array(times)], names=["a", "b", "times"])

        high, low, salt, side, pos, key, n = unpack(blobs, _POSTING)
        grams = (high.astype(np.uint64) << np.uint64(16)) | low
        for found in candidate_pairs(grams, salt, side, pos.astype(np.int64), key, n, threshold, shared) if blobs else ():
            if len(found[0]):
                out.append(found)
                size += len(found[0])
                if size >= FLUSH:
                    yield flush()
                    out, size = [], 0
        if out:
            yield flush()

    pairs = postings.repartitionById(parts, F.col("part")).mapInArrow(join, "a bigint, b bigint, times int")
    return pairs.groupBy("a", "b").agg(F.sum("times").alias("times")).where(F.col("times") >= shared).select("a", "b")


def _suffix_filter(pairs: DataFrame, classes: DataFrame, threshold: float) -> DataFrame:
    a = classes.select(F.col("key").alias("a"), F.col("n").alias("n_a"), F.col("sig").alias("s_a"))
    b = classes.select(F.col("key").alias("b"), F.col("n").alias("n_b"), F.col("sig").alias("s_b"))

    def run(batches):
        for batch in batches:
            t = {k: batch.column(batch.schema.get_field_index(k)) for k in ("a", "b", "n_a", "n_b", "s_a", "s_b")}
            if not batch.num_rows:
                continue
            n_a, n_b = (t[k].to_numpy().astype(np.int64) for k in ("n_a", "n_b"))
            s_a, s_b = (np.frombuffer(b"".join(t[k].to_pylist()), np.uint8).reshape(-1, SIGNATURE).astype(np.int64) for k in ("s_a", "s_b"))
            differ = np.abs(s_a - s_b).sum(axis=1)
            good = pa.array(differ <= n_a + n_b - 2 * needed_overlap(n_a, n_b, threshold))
            yield pa.RecordBatch.from_arrays([t["a"].filter(good), t["b"].filter(good)], names=["a", "b"])

    return pairs.join(a, "a").join(b, "b").mapInArrow(run, "a bigint, b bigint")


def _verified(pairs: DataFrame, sets: DataFrame, threshold: float) -> DataFrame:
    a = sets.select(F.col("key").alias("a"), F.col("grams").alias("g_a"))
    b = sets.select(F.col("key").alias("b"), F.col("grams").alias("g_b"))

    def run(batches):
        for batch in batches:
            get = lambda k: batch.column(batch.schema.get_field_index(k))
            good, score = [], []
            for x, y in zip(get("g_a").to_pylist(), get("g_b").to_pylist()):
                u, v = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                both = len(np.intersect1d(u, v, assume_unique=True))
                j = both / (len(u) + len(v) - both)
                good.append(j >= threshold)
                score.append(j)
            mask = pa.array(good, pa.bool_())
            yield pa.RecordBatch.from_arrays([get("a").filter(mask), get("b").filter(mask), pa.array(score, pa.float64()).filter(mask)], names=["a", "b", "similarity"])

    return pairs.join(a, "a").join(b, "b").mapInArrow(run, "a bigint, b bigint, similarity double")


def near_duplicate_classes(
    df: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    words: int = 5,
    threshold: float = 0.8,
    min_words: int = 50,
    hot: int = HOT,
    shared: int = SHARED,
    broadcast_ids: int = BROADCAST_IDS,
) -> tuple[DataFrame, DataFrame]:
    """(members, links): members(doc, key) with the class of each text, links(a, b, similarity) between classes, a < b.

    Texts with fewer than min_words (or words) words, null and empty ones among them, are in no
    class; rows with a null id are dropped; repeated rows of one id and text count once. Equal
    sets make one class. Every pair of different classes with similarity >= threshold is linked.
    """
    spark = df.sparkSession
    texts = _texts(df, id_col, text_col)
    bits = cell_bits(texts)
    statistics = materialise(_statistics(texts, words, min_words, bits))
    rows = statistics.where("slice is null")
    members = rows.select("doc", "key").distinct()
    total = rows.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    table = _frequencies(statistics, bits)
    hot = max(hot, int(4 * table.mean()))
    cells = spark.sparkContext.broadcast(table)
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), int(total * (1.05 - threshold) / POSTINGS_PER_TASK) + 1)
    candidates = _candidates(_postings(texts, cells, words, min_words, threshold, hot, shared, parts), parts, threshold, shared)
    classes = rows.groupBy("key").agg(F.min("n").alias("n"), F.min("sig").alias("sig"), F.min("doc").alias("doc"))
    kept = materialise(_suffix_filter(candidates, classes, threshold))

    involved = kept.select(F.explode(F.array("a", "b")).alias("key")).distinct()
    wanted = classes.join(involved, "key", "left_semi").select("doc", "key")
    if kept.limit(broadcast_ids + 1).count() <= broadcast_ids:
        wanted = F.broadcast(wanted)

    def to_sets(batches):
        shingle = Shingler(words, min_words)
        for batch in batches:
            given, keys, sets = batch.column(0).to_pylist(), [], []
            for i, g in shingle.sets(batch.column(1).to_pylist()):
                if class_key(g) == given[i]:
                    keys.append(given[i])
                    sets.append(g.tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(sets, pa.binary())], names=["key", "grams"])

    sets = texts.join(wanted, "doc").select("key", "text").distinct().mapInArrow(to_sets, "key bigint, grams binary")
    sets = sets.dropDuplicates(["key"])
    return members, materialise(_verified(kept, sets, threshold))


def near_duplicate_pairs(members: DataFrame, links: DataFrame) -> DataFrame:
    """(doc_a, doc_b), a < b: every pair of texts of one class or of two linked classes."""
    left, right = members.select(F.col("doc").alias("x"), F.col("key").alias("a")), members.select(F.col("doc").alias("y"), F.col("key").alias("b"))
    across = links.select("a", "b").join(left, "a").join(right, "b").select("x", "y")
    several = members.groupBy("key").agg(F.count(F.lit(1)).alias("size")).where("size > 1").select("key")
    copies = members.join(several, "key", "left_semi")
    within = copies.select(F.col("doc").alias("x"), "key").join(copies.select(F.col("doc").alias("y"), "key"), "key").where("x < y").select("x", "y")
    return across.unionByName(within).where("x != y").select(F.least("x", "y").alias("doc_a"), F.greatest("x", "y").alias("doc_b")).distinct()


def near_duplicate_groups(members: DataFrame, links: DataFrame) -> DataFrame:
    """(doc, class_id, copies, links): class_id is the smallest id of the class, copies the other texts of the
    class, links the texts of linked classes. Pairs are never expanded, however large a class is."""
    sizes = members.groupBy("key").agg(F.count(F.lit(1)).alias("size"), F.min("doc").alias("class_id"))
    both = links.select(F.col("a").alias("key"), F.col("b").alias("other")).unionByName(links.select(F.col("b").alias("key"), F.col("a").alias("other")))
    linked = both.join(sizes.select(F.col("key").alias("other"), "size"), "other").groupBy("key").agg(F.sum("size").alias("links"))
    table = sizes.join(linked, "key", "left").select("key", "class_id", (F.col("size") - 1).alias("copies"), F.coalesce("links", F.lit(0)).alias("links"))
    return members.join(table, "key").select("doc", "class_id", "copies", "links")
