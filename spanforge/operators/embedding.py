"""Embedders: the feature-hashing embedder, optional model embedders, content-addressed reuse."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanforge.functions.text import stable_hash
from spanforge.functions.worker import worker_cache
from spanforge.plans.session import spread

_WORD = re.compile(r"[a-z0-9]+")
_SPACE = re.compile(r"\s+")
_CHAR_BITS = 12  # characters are numbered as they come, so that n-grams of up to five are one integer
_CHARS_AT_A_TIME = 1 << 20
_KNOWN = 4_000_000  # n-grams remembered: 48 MB
_PLACE_BITS = 22  # places of n-grams that are found without a search: 48 MB


class _Slots(dict):
    """Feature -> its hash modulo a period; features of one kind share a prefix."""

    def __init__(self, prefix: str, period: int):
        super().__init__()
        self.prefix, self.period = prefix, period

    def __missing__(self, feature: str) -> int:
        digest = hashlib.sha256((self.prefix + feature).encode() + b"\0").digest()
        v = self[feature] = int.from_bytes(digest, "big") % self.period
        return v


class _Grams:
    """Slots of the character n-grams of many texts at once; distinct n-grams are hashed once while they are remembered."""

    def __init__(self, period: int):
        self.period = period
        self.forget()

    def forget(self) -> None:
        self.number, self.used = np.zeros(0x110000, np.int64), 0
        self.keys, self.slots = np.zeros(0, np.int64), np.zeros(0, np.int32)
        self.placed, self.of_place = np.zeros(1 << _PLACE_BITS, np.int64), np.zeros(1 << _PLACE_BITS, np.int32)  # no key is 0

    def numbered(self, points: np.ndarray) -> np.ndarray | None:
        """Numbers from 1 of the characters; None if there are too many."""
        new = np.unique(points[self.number[points] == 0])
        if self.used + len(new) >= 1 << _CHAR_BITS:
            self.forget()
            new = np.unique(points)
            if len(new) >= 1 << _CHAR_BITS:
                return None
        self.number[new] = np.arange(self.used + 1, self.used + len(new) + 1)
        self.used += len(new)
        return self.number[points]

    def __call__(self, texts: list[str], sizes: tuple[int, ...]) -> tuple[np.ndarray, np.ndarray] | None:
        """(row, slot) of every n-gram, repeats included; None if these texts have too many different characters."""
        whole = "".join(texts)
        at = self.numbered(np.frombuffer(whole.encode("utf-32-le", "surrogatepass"), "<u4"))
        if at is None:
            return None
        lengths = np.fromiter(map(len, texts), np.int64, len(texts))
        row = np.repeat(np.arange(len(texts), dtype=np.int32), lengths)
        left = np.repeat(np.cumsum(lengths), lengths) - np.arange(len(at))  # characters to the end of the text
        rows, out = [], []
        for n in sizes:
            k = np.zeros(max(len(at) - n + 1, 0), np.int64)
            for i in range(n):
                k = k << _CHAR_BITS | at[i : i + len(k)]
            places = np.flatnonzero(left[: len(k)] >= n)
            k = k[places]
            where = _place(k)
            slots = self.of_place[where]
            missed = np.flatnonzero(self.placed[where] != k)
            slots[missed] = self.searched(k[missed], whole, places[missed], n)
            rows.append(row[places])
            out.append(slots)
        return np.concatenate(rows), np.concatenate(out)

    def searched(self, keys: np.ndarray, whole: str, places: np.ndarray, n: int) -> np.ndarray:
        """Slots of n-grams without a place of their own, at these places of the text; those new get one if it is free."""
        distinct, sample, back = np.unique(keys, return_index=True, return_inverse=True)
        found = np.searchsorted(self.keys, distinct)
        inside = found < len(self.keys)
        known = np.zeros(len(distinct), bool)
        known[inside] = self.keys[found[inside]] == distinct[inside]
        slots = np.zeros(len(distinct), np.int32)
        slots[known] = self.slots[found[known]]
        sha, period, new = hashlib.sha256, self.period, ~known
        slots[new] = [int.from_bytes(sha(b"c:" + whole[p : p + n].encode() + b"\0").digest(), "big") % period for p in places[sample[new]].tolist()]
        where = _place(distinct)
        free = self.placed[where] == 0
        self.placed[where[free]], self.of_place[where[free]] = distinct[free], slots[free]
        rest = np.flatnonzero(new & (self.placed[where] != distinct))
        if len(self.keys) + len(rest) > _KNOWN:
            self.keys, self.slots = distinct[rest], slots[rest]
        else:
            self.keys, self.slots = np.insert(self.keys, found[rest], distinct[rest]), np.insert(self.slots, found[rest], slots[rest])
        return slots[back]


def _place(keys: np.ndarray) -> np.ndarray:
    return (keys.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - _PLACE_BITS)).view(np.int64)


class HashEmbedder:
    """Signed feature hashing of words and character n-grams.

    The SHA-256 of a feature, modulo 2 * dim, gives bucket and sign. Hashes are remembered per
    worker up to a bound.
    """

    def __init__(self, dim: int = 512, sizes: tuple[int, ...] = (3, 4, 5), words: bool = True, name: str = "det-hash"):
        if dim <= 0:
            raise ValueError("dim must be positive")
        self.dim, self.sizes, self.words, self.name = dim, sizes, words, name
        self._words, self._grams, self._many = _Slots("w:", 2 * dim), _Slots("c:", 2 * dim), None

    @staticmethod
    def flat(text: str) -> str:
        """The text in lower case, each run of whitespace as one space: what n-grams are cut from, and words can be."""
        return " ".join(text.lower().split())

    def slots(self, text: str) -> np.ndarray:
        """Hash modulo 2 * dim of every feature, repeats included."""
        low = text.lower()
        flat = _SPACE.sub(" ", low).strip()
        for known in (self._words, self._grams):
            if len(known) > 1_000_000:
                known.clear()
        parts = [map(self._words.__getitem__, _WORD.findall(low))] if self.words else []
        parts += [map(self._grams.__getitem__, [flat[i : i + n] for i in range(len(flat) - n + 1)]) for n in self.sizes if 0 < n <= len(flat)]
        return np.fromiter(chain(*parts), np.int64)

    def slots_many(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(slots of all texts one after the other, their first places and the end); the slots of a text in any order."""
        parts, sizes, lo = [], np.zeros(len(texts), np.int64), 0
        while lo < len(texts):
            hi, n = lo + 1, len(texts[lo])
            while hi < len(texts) and hi - lo < 1 << 14 and n + len(texts[hi]) <= _CHARS_AT_A_TIME:
                n += len(texts[hi])
                hi += 1
            slots, rows = self._slots_of(texts[lo:hi])
            parts.append(slots[np.argsort(rows, kind="stable")])
            sizes[lo:hi] = np.bincount(rows, minlength=hi - lo)
            lo = hi
        return np.concatenate([np.zeros(0, np.int32), *parts]), np.concatenate([[0], np.cumsum(sizes)])

    def _slots_of(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        low = [t.lower() for t in texts]
        wanted = tuple(n for n in self.sizes if n > 0)
        if self._many is None:
            self._many = _Grams(2 * self.dim)
        grams = None if max(wanted, default=0) * _CHAR_BITS > 60 else self._many([_SPACE.sub(" ", t).strip() for t in low], wanted) if wanted else (np.zeros(0, np.int32),) * 2
        if grams is None:
            each = [self.slots(t) for t in texts]
            return np.concatenate(each).astype(np.int32), np.repeat(np.arange(len(each)), [len(x) for x in each]).astype(np.uint16)
        if len(self._words) > 1_000_000:
            self._words.clear()
        words = [_WORD.findall(t) for t in low] if self.words else [[] for _ in low]
        of = np.fromiter(map(self._words.__getitem__, chain(*words)), np.int32)
        return np.concatenate([of, grams[1]]), np.concatenate([np.repeat(np.arange(len(words)), [len(x) for x in words]), grams[0]]).astype(np.uint16)

    def counts(self, text: str) -> np.ndarray:
        """The integer vector before normalisation."""
        c = np.bincount(self.slots(text), minlength=2 * self.dim)
        return c[: self.dim] - c[self.dim :]

    def __call__(self, texts: list[str]) -> np.ndarray:
        v = np.array([self.counts(t) for t in texts], np.float64).reshape(len(texts), self.dim)
        norm = np.sqrt((v * v).sum(axis=1, keepdims=True))
        return v / np.where(norm == 0, 1, norm)


@dataclass(frozen=True)
class ModelEmbedder:
    """A sentence-transformer model with role prefixes; the library is optional; a worker loads the model once."""

    model: str
    name: str
    query_prefix: str = ""
    passage_prefix: str = ""
    batch_size: int = 32

    def __call__(self, texts: list[str]) -> np.ndarray:
        def load():
            try:
                from sentence_transformers import SentenceTransformer
            except ImportError as e:
                raise ImportError("this embedder needs the package sentence-transformers") from e
            return SentenceTransformer(self.model)

        v = np.asarray(worker_cache(("sentence model", self.model), load).encode(texts, batch_size=self.batch_size), float)
        norm = np.sqrt((v * v).sum(axis=1, keepdims=True))
        return v / np.where(norm == 0, 1, norm)


def e5(name: str = "e5") -> ModelEmbedder:
    return ModelEmbedder("intfloat/e5-base-v2", name, "query: ", "passage: ")


def bge(name: str = "bge") -> ModelEmbedder:
    return ModelEmbedder("BAAI/bge-base-en-v1.5", name, "Represent this sentence for searching relevant passages: ", "")


def embed_distinct(df: DataFrame, text_col: str, embed: Callable[[list[str]], np.ndarray], role: str = "passage") -> DataFrame:
    """(key, vector array<double>) of each distinct text, key its SHA-256: equal texts are embedded once.

    ``role`` picks a model's query or passage prefix. Null texts are left out.
    """
    prefix = getattr(embed, f"{role}_prefix", "")
    texts = df.select(F.sha2(text_col, 256).alias("key"), F.col(text_col).alias("text")).where("text is not null").dropDuplicates(["key"])

    return _vectors(texts.withColumn("text", F.concat(F.lit(prefix), "text")), embed)


def _vectors(texts: DataFrame, embed: Callable[[list[str]], np.ndarray]) -> DataFrame:
    """(key, vector) of texts(key, text)."""

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                v = embed(batch.column(1).to_pylist())
                flat = pa.array(np.ascontiguousarray(v, np.float64).ravel())
                offsets = pa.array(np.arange(0, v.size + 1, v.shape[1], dtype=np.int32))
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(offsets, flat)], names=["key", "vector"])

    return texts.select("key", "text").mapInArrow(run, "key string, vector array<double>")


def embed_rows(df: DataFrame, text_col: str, embed: Callable[[list[str]], np.ndarray], role: str = "passage") -> DataFrame:
    """df with a column vector, by way of its distinct texts."""
    vectors = embed_distinct(df, text_col, embed, role)
    return df.withColumn("key", F.sha2(text_col, 256)).join(vectors, "key", "left").drop("key")


class EmbeddingStore:
    """Vectors kept in Parquet by content: only texts not seen before, under this model and role, are embedded.

    The key is the SHA-256 of model name and prefixed text, each ended by NUL. New vectors are
    appended; a key written twice by two runs at once is read once.
    """

    def __init__(self, path: str):
        self.path = path

    def read(self, spark) -> DataFrame:
        try:
            return spark.read.schema("key string, vector array<double>").parquet(self.path).dropDuplicates(["key"])
        except AnalysisException:
            return spark.createDataFrame([], "key string, vector array<double>")

    def embed(self, df: DataFrame, text_col: str, embed: Callable[[list[str]], np.ndarray], name: str, role: str = "passage") -> DataFrame:
        """df with a column vector; null texts get a null one."""
        spark, prefix = df.sparkSession, getattr(embed, f"{role}_prefix", "")
        key = stable_hash(F.lit(name), F.concat(F.lit(prefix), F.col(text_col)))
        texts = df.select(key.alias("key"), F.concat(F.lit(prefix), F.col(text_col)).alias("text")).where("text is not null").dropDuplicates(["key"])
        missing = texts.join(self.read(spark), "key", "left_anti")
        _vectors(missing, embed).write.mode("append").parquet(self.path)
        return df.withColumn("key", key).join(self.read(spark), "key", "left").drop("key")


def hash_buckets(df: DataFrame, id_col: str, text_col: str, dim: int = 256) -> DataFrame:
    """(id, bucket, value): the non-zero integer entries of the feature-hashing vector."""
    embed = HashEmbedder(dim)
    source = spread(df).select(F.col(id_col).alias("id"), F.coalesce(text_col, F.lit("")).alias("text"))
    kind = source.schema["id"].dataType.simpleString()

    def run(batches):
        for batch in batches:
            take, buckets, values = [], [], []
            for i, text in enumerate(batch.column(1).to_pylist()):
                c = embed.counts(text)
                at = np.flatnonzero(c)
                take.append(np.full(len(at), i))
                buckets.append(at)
                values.append(c[at])
            if take:
                t, b, v = (np.concatenate(x) for x in (take, buckets, values))
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(t)), pa.array(b, pa.int32()), pa.array(v, pa.int64())], names=["id", "bucket", "value"])

    return source.mapInArrow(run, f"id {kind}, bucket int, value bigint").withColumnRenamed("id", id_col)
