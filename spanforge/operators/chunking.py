"""Chunkers: documents(id, text, doc_pos) to chunk rows with exact offsets.

All chunkers tile the text, keep no empty chunk and number chunks by corpus order: chunk_pos is
doc_pos * 2^24 + the chunk's number in its document, so order needs no global sort. Null and
empty texts give no chunk. Chunks are row-wise expressions or Arrow maps: nothing is shuffled.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanforge.functions.text import count_tokens, stable_hash

CHUNK_COLUMNS = ("chunker", "chunk_pos", "chunk_id", "source_id", "start", "end", "text", "parent_id", "n_tokens")
SEPARATORS = ("\n\n", "\n", ". ", " ", "")
SENTENCES = 4_096  # sentences embedded at a time
SENTENCE_END = re.compile(r"[.!?]+(?:\s+|$)|\n+")


def chunk_id(source: Column, start: Column, end: Column, spec: str) -> Column:
    return stable_hash(source, start, end, F.lit(spec))


def emit(spans: DataFrame, spec: str, parent: Column | None = None) -> DataFrame:
    """Chunk rows from (id, text, doc_pos, no, start, end)."""
    text = F.substring("text", F.col("start") + 1, F.col("end") - F.col("start"))
    rows = spans.where(F.col("end") > F.col("start")).select(
        F.lit(spec).alias("chunker"),
        (F.shiftleft(F.col("doc_pos").cast("bigint"), 24) + F.col("no")).alias("chunk_pos"),
        chunk_id(F.col("id"), F.col("start"), F.col("end"), spec).alias("chunk_id"),
        F.col("id").alias("source_id"),
        F.col("start").cast("int").alias("start"),
        F.col("end").cast("int").alias("end"),
        text.alias("text"),
        (parent if parent is not None else F.lit(None).cast("string")).alias("parent_id"),
    )
    return rows.withColumn("n_tokens", count_tokens(F.col("text")))


def _filled(docs: DataFrame) -> DataFrame:
    return docs.where(F.length("text") > 0).withColumn("n", F.length("text"))


def fixed_spec(size: int = 400, overlap: int = 0) -> str:
    return f"fixed:size={size}:overlap={overlap}"


def chunk_fixed(docs: DataFrame, size: int = 400, overlap: int = 0) -> DataFrame:
    """Windows at step size - overlap; the first window that reaches the end is the last."""
    if size <= 0 or not 0 <= overlap < size:
        raise ValueError("size must be positive and 0 <= overlap < size")
    step = size - overlap
    last = F.greatest(F.lit(0), F.ceil((F.col("n") - size) / step)).cast("int")
    spans = _filled(docs).select("id", "text", "doc_pos", "n", F.explode(F.sequence(F.lit(0), last)).alias("no"))
    spans = spans.withColumn("start", F.col("no") * step).withColumn("end", F.least(F.col("start") + size, F.col("n")))
    return emit(spans, fixed_spec(size, overlap))


def parent_child_spec(parent: int = 1200, child: int = 300) -> str:
    return f"parentchild:parent={parent}:child={child}"


def chunk_parent_child(docs: DataFrame, parent: int = 1200, child: int = 300) -> DataFrame:
    """Children that tile each parent and begin anew at its start; parent_id names the parent."""
    if parent <= 0 or child <= 0 or child > parent:
        raise ValueError("sizes must be positive and child <= parent")
    spec = parent_child_spec(parent, child)
    per = -(-parent // child)
    n = F.col("n")
    spans = _filled(docs).select("id", "text", "doc_pos", "n", F.explode(F.sequence(F.lit(0), F.floor((n - 1) / parent).cast("int"))).alias("p"))
    spans = spans.withColumn("p_start", F.col("p") * parent).withColumn("p_end", F.least(F.col("p_start") + parent, n))
    inner = F.sequence(F.lit(0), F.floor((F.col("p_end") - F.col("p_start") - 1) / child).cast("int"))
    spans = spans.withColumn("c", F.explode(inner)).withColumn("no", F.col("p") * per + F.col("c"))
    spans = spans.withColumn("start", F.col("p_start") + F.col("c") * child).withColumn("end", F.least(F.col("start") + child, F.col("p_end")))
    return emit(spans, spec, chunk_id(F.col("id"), F.col("p_start"), F.col("p_end"), spec + ":parent"))


def parents(docs: DataFrame, parent: int = 1200, child: int = 300) -> DataFrame:
    """The parent chunks of chunk_parent_child."""
    spans = _filled(docs).select("id", "text", "doc_pos", "n", F.explode(F.sequence(F.lit(0), F.floor((F.col("n") - 1) / parent).cast("int"))).alias("no"))
    spans = spans.withColumn("start", F.col("no") * parent).withColumn("end", F.least(F.col("start") + parent, F.col("n")))
    return emit(spans, parent_child_spec(parent, child) + ":parent")


def chunk_lossy(docs: DataFrame, drop_start: int, drop_end: int, size: int = 100) -> DataFrame:
    """Fixed windows over the text before and after a dropped region: a chunker that loses content."""
    spec = f"lossy:drop={drop_start}-{drop_end}:size={size}"
    rows = _filled(docs)
    n = F.col("n")
    region = F.explode(F.array(F.struct(F.lit(0).alias("a"), F.least(F.lit(drop_start), n).alias("b")), F.struct(F.least(F.lit(drop_end), n).alias("a"), n.alias("b"))))
    rows = rows.select("id", "text", "doc_pos", region.alias("r")).where("r.b > r.a")
    inner = F.sequence(F.lit(0), F.floor((F.col("r.b") - F.col("r.a") - 1) / size).cast("int"))
    rows = rows.withColumn("c", F.explode(inner)).withColumn("start", F.col("r.a") + F.col("c") * size)
    rows = rows.withColumn("end", F.least(F.col("start") + size, F.col("r.b")))
    return emit(rows.withColumn("no", F.col("start")), spec)


def sentence_spans(text: str) -> list[tuple[int, int]]:
    """Contiguous spans, one a sentence, that cover the text."""
    cuts = [0, *(m.end() for m in SENTENCE_END.finditer(text)), len(text)]
    return [(s, e) for s, e in zip(cuts, cuts[1:]) if e > s]


def recursive_spans(text: str, size: int, separators: tuple[str, ...] = SEPARATORS) -> list[tuple[int, int]]:
    """Pieces cut at ever weaker separators, packed up to ``size`` and stretched to tile the text."""
    packed: list[list[int]] = []
    stack = [(0, len(text), 0)]  # explicit stack of (start, end, separator level), leftmost on top
    while stack:
        start, end, level = stack.pop()
        if end - start <= size or level >= len(separators):
            if packed and end - packed[-1][0] <= size:
                packed[-1][1] = end
            else:
                packed.append([start, end])
        elif separators[level] == "":
            stack.extend((i, min(i + size, end), level) for i in reversed(range(start, end, size)))
        else:
            sep, at, parts = separators[level], start, []
            while at <= end:
                stop = text.find(sep, at, end)
                stop = end if stop < 0 else stop
                if stop > at:
                    parts.append((at, stop, level + 1))
                at = stop + len(sep)
            stack.extend(reversed(parts))
    starts = [0, *(s for s, _ in packed[1:]), len(text)]
    return list(zip(starts, starts[1:])) if packed else [(0, len(text))]


def semantic_spans(sentences: list[tuple[int, int]], distances: np.ndarray, percentile: float, max_chars: int) -> list[tuple[int, int]]:
    """Pieces of whole sentences, cut where a distance reaches the document's percentile and where a piece has max_chars.

    A piece's end is the first sentence end at which it is long enough, or the next far one.
    """
    if len(sentences) <= 1:
        return sentences
    ends = np.array([e for _, e in sentences])
    far = np.append(np.flatnonzero(distances >= np.percentile(distances, percentile)), len(ends) - 1)
    pieces, begin = [], sentences[0][0]
    while begin < ends[-1]:
        at = int(ends.searchsorted(begin, side="right"))
        cut = min(int(far[far.searchsorted(at)]), max(at, int(ends.searchsorted(begin + max_chars))))
        pieces.append((begin, int(ends[min(cut, len(ends) - 1)])))
        begin = pieces[-1][1]
    return pieces


def _mapped(docs: DataFrame, spans_of: Callable[[list[str]], Iterator[list[tuple[int, int]]]]) -> DataFrame:
    """(id, text, doc_pos, no, start, end) from a Python function over a batch's texts."""
    source = _filled(docs).select("id", "text", F.col("doc_pos").cast("bigint").alias("doc_pos"))

    def run(batches):
        for batch in batches:
            take, no, starts, ends = [], [], [], []
            for i, spans in enumerate(spans_of(batch.column(1).to_pylist())):
                for k, (s, e) in enumerate(spans):
                    take.append(i)
                    no.append(k)
                    starts.append(s)
                    ends.append(e)
            rows = pa.array(take, pa.int32())
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c).take(rows) for c in range(3)), pa.array(no, pa.int32()), pa.array(starts, pa.int32()), pa.array(ends, pa.int32())],
                names=["id", "text", "doc_pos", "no", "start", "end"],
            )

    return source.mapInArrow(run, "id string, text string, doc_pos bigint, no int, start int, end int")


def recursive_spec(size: int = 400) -> str:
    return f"recursive:size={size}"


def chunk_recursive(docs: DataFrame, size: int = 400, separators: tuple[str, ...] = SEPARATORS) -> DataFrame:
    """``separators`` from strong to weak; the empty one cuts between any two characters."""
    if size <= 0:
        raise ValueError("size must be positive")
    return emit(_mapped(docs, lambda texts: (recursive_spans(t, size, separators) for t in texts)), recursive_spec(size))


def semantic_spec(name: str, percentile: float = 75.0, max_chars: int = 1000) -> str:
    return f"semantic:pct={float(percentile)}:max={max_chars}:emb={name}"


def chunk_semantic(docs: DataFrame, embed: Callable[[list[str]], np.ndarray], name: str, percentile: float = 75.0, max_chars: int = 1000) -> DataFrame:
    """``embed`` gives unit vectors of sentences; it runs in the workers."""
    if not 0 <= percentile <= 100:
        raise ValueError("percentile must be in [0, 100]")

    def spans_of(texts):
        cut = [sentence_spans(text) for text in texts]
        waiting, size = [], 0
        for i, sentences in enumerate(cut):  # the sentences of many documents are embedded at once
            waiting.append(i)
            size += len(sentences)
            if size >= SENTENCES or i + 1 == len(cut):
                v = embed([texts[j][s:e] for j in waiting for s, e in cut[j]])
                at = 0
                for j in waiting:
                    own = v[at : at + len(cut[j])]
                    at += len(cut[j])
                    yield semantic_spans(cut[j], 1.0 - (own[:-1] * own[1:]).sum(axis=1), percentile, max_chars) or [(0, len(texts[j]))]
                waiting, size = [], 0

    return emit(_mapped(docs, spans_of), semantic_spec(name, percentile, max_chars))


def chunk_custom(docs: DataFrame, spans_of: Callable[[str], list[tuple[int, int]]], spec: str) -> DataFrame:
    """Extension point: a Python function from a text to spans."""
    return emit(_mapped(docs, lambda texts: (spans_of(t) for t in texts)), spec)


def sentences(docs: DataFrame) -> DataFrame:
    """(id, no, start, end) of each sentence, by expressions only."""
    marked = F.split(F.regexp_replace("text", r"[.!?]+(?:[\s\x{1c}-\x{1f}\x{85}\p{Z}]+|\z)|\n+", "$0\u0001"), "\u0001")
    parts = _filled(docs).select("id", F.filter(marked, lambda x: x != "").alias("parts"))
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int>>").alias("out"))

    def add(acc, x):
        stop = acc["at"] + F.length(x)
        return F.struct(stop.alias("at"), F.concat(acc["out"], F.array(F.struct(acc["at"].alias("start"), stop.alias("end")))).alias("out"))

    spans = F.aggregate("parts", start, add, lambda acc: acc["out"])
    return parts.select("id", F.posexplode(spans).alias("no", "s")).select("id", "no", "s.start", "s.end")
