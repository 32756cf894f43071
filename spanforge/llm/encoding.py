"""Encoding of a whole corpus with a public byte-level BPE tokenizer.

Method: monoid tree reduction. A text is halved until pieces are at most ``leaf_chars`` long,
leaves are encoded, and two neighbours are joined by re-encoding a window around their border.
The window grows on both sides until each edge lies on a *guaranteed cut*: a position at which
the tokenizer's splitting pattern ends a piece whatever stands further away. The pattern has no
look-behind and pieces are merged independently, so tokens left of the left edge and right of
the right edge are those of the whole text. Where no cut exists the window grows to the whole
neighbour, so the result equals that of encoding at once in every case.
Decoding concatenates byte strings up the same tree.
"""

from __future__ import annotations

import base64
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanforge.llm._common import worker_cache

DEFAULT_VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
DEFAULT_LEAF_CHARS = 4096

# Fixed value: the public splitting pattern that belongs to the rank files.
SPLIT_PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

# Guaranteed cuts. A white-space character after a non-space always starts a new piece; so does
# punctuation after a letter or digit and a change between letter and digit. Only characters
# whose class is the same in every Unicode version are named; others just give no cut.
_WORD = "A-Za-z0-9ぁ-ゖァ-ヺ一-龥가-힣"
CUT = re.compile(
    rf"(?<=\S)(?=[ \n\t\r])|(?<=[{_WORD}])(?=[,.;:!?()\"，。！？；：、])|(?<=[A-Za-z])(?=[0-9])|(?<=[0-9])(?=[A-Za-z])"
)


def load_encoder(vocabulary: str = DEFAULT_VOCABULARY):
    """The tiktoken encoder of a rank file; one per worker process. Special tokens are ordinary text."""

    def make():
        import tiktoken

        with open(vocabulary, "rb") as lines:
            ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
        return tiktoken.Encoding("public", pat_str=SPLIT_PATTERN, mergeable_ranks=ranks, special_tokens={})

    return worker_cache(("encoder", vocabulary), make)


def _cut_before(text: str, lo: int, mid: int) -> int:
    """The last guaranteed cut inside (lo, mid), both neighbours of which lie in [lo, mid); else lo."""
    width = 32
    while True:
        start = max(lo, mid - width)
        last = -1
        for m in CUT.finditer(text, max(start, lo + 1), mid):
            if m.start() < mid:
                last = m.start()
        if last >= 0:
            return last
        if start == lo:
            return lo
        width *= 4


def _cut_after(text: str, mid: int, hi: int) -> int:
    """The first guaranteed cut after mid with both neighbours in [mid, hi); else hi."""
    m = CUT.search(text, mid + 1, hi)
    return m.start() if m and m.start() < hi else hi


def join_tokens(text: str, lo: int, mid: int, hi: int, left: list[int], right: list[int], encode) -> list[int]:
    """The monoid's operation: the tokens of text[lo:hi] from those of its two parts."""
    p, q = _cut_before(text, lo, mid), _cut_after(text, mid, hi)
    keep = len(left) - len(encode(text[p:mid]))
    drop = len(encode(text[mid:q]))
    return left[:keep] + encode(text[p:q]) + right[drop:]


def encode_tree(text: str, encode, leaf_chars: int = DEFAULT_LEAF_CHARS, lo: int = 0, hi: int | None = None) -> list[int]:
    """Token ids of text[lo:hi] by tree reduction; equal to encode(text[lo:hi])."""
    hi = len(text) if hi is None else hi
    if hi - lo <= max(1, leaf_chars):
        return encode(text[lo:hi])
    mid = (lo + hi) // 2
    left = encode_tree(text, encode, leaf_chars, lo, mid)
    right = encode_tree(text, encode, leaf_chars, mid, hi)
    return join_tokens(text, lo, mid, hi, left, right, encode)


def decode_tree(ids: list[int], encoder, leaf_tokens: int = 4096) -> str:
    """The text of ids: byte strings of halves, concatenated up the tree."""

    def part(lo: int, hi: int) -> bytes:
        if hi - lo <= leaf_tokens:
            return encoder.decode_bytes(ids[lo:hi])
        mid = (lo + hi) // 2
        return part(lo, mid) + part(mid, hi)

    return part(0, len(ids)).decode("utf-8")


def encode_documents(
    df: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    vocabulary: str = DEFAULT_VOCABULARY,
    leaf_chars: int = DEFAULT_LEAF_CHARS,
) -> DataFrame:
    """(id_col, ids array<int>), one row per input row, no shuffle.

    Empty and null texts give an empty list; null ids stay null; repeated rows give repeated
    rows; other columns are ignored, whatever their names. An empty table gives an empty table.
    """
    source = df.select(F.col(id_col).alias("k"), F.col(text_col).cast("string").alias("t"))
    kind = source.schema["k"].dataType.simpleString()

    def run(batches):
        encoder = load_encoder(vocabulary)
        encode = encoder.encode_ordinary
        for batch in batches:
            flat: list[int] = []
            offsets = [0]
            for text in batch.column(1).to_pylist():
                if text:
                    flat.extend(encode(text) if len(text) <= leaf_chars else encode_tree(text, encode, leaf_chars))
                offsets.append(len(flat))
            ids = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(flat, pa.int32()))
            yield pa.RecordBatch.from_arrays([batch.column(0), ids], names=["k", "ids"])

    return source.mapInArrow(run, f"k {kind}, ids array<int>").withColumnRenamed("k", id_col)


def count_tokens(
    df: DataFrame,
    text_col: str,
    keep: list[str],
    vocabulary: str = DEFAULT_VOCABULARY,
    leaf_chars: int = DEFAULT_LEAF_CHARS,
) -> DataFrame:
    """The columns in ``keep`` (in order, as given) plus n_tokens bigint; ids never leave the worker."""
    names = [f"k{i}" for i in range(len(keep))]
    source = df.select(*[F.col(c).alias(n) for c, n in zip(keep, names)], F.col(text_col).cast("string").alias("t"))
    schema = ", ".join(f"{n} {source.schema[n].dataType.simpleString()}" for n in names) + ", n_tokens bigint"

    def run(batches):
        encode = load_encoder(vocabulary).encode_ordinary
        for batch in batches:
            counts = [len(encode_tree(t, encode, leaf_chars)) if t else 0 for t in batch.column(len(names)).to_pylist()]
            cols = [batch.column(i) for i in range(len(names))] + [pa.array(counts, pa.int64())]
            yield pa.RecordBatch.from_arrays(cols, names=[*names, "n_tokens"])

    out = source.mapInArrow(run, schema)
    return out.select(*[F.col(n).alias(c) for c, n in zip(keep, names)], "n_tokens")


def decode_documents(df: DataFrame, id_col: str = "doc_id", ids_col: str = "ids", vocabulary: str = DEFAULT_VOCABULARY) -> DataFrame:
    """(id_col, text): the inverse of encode_documents; null and empty lists give the empty text."""
    source = df.select(F.col(id_col).alias("k"), F.col(ids_col).cast("array<int>").alias("ids"))
    kind = source.schema["k"].dataType.simpleString()

    def run(batches):
        encoder = load_encoder(vocabulary)
        for batch in batches:
            texts = [decode_tree(ids, encoder) if ids else "" for ids in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=["k", "text"])

    return source.mapInArrow(run, f"k {kind}, text string").withColumnRenamed("k", id_col)
