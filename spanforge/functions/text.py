"""Text, hashing and interval functions as Column expressions; offsets count code points."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# White space as the query semantics define it: Unicode White_Space and four separators.
SPACE_CLASS = r"\p{IsWhite_Space}\x{1c}-\x{1f}"
WORD_CLASS = r"\p{L}\p{N}_"


def word_tokens(text: Column) -> Column:
    """Runs of a-z or 0-9 of the lower-cased text, in order; null gives null."""
    return F.filter(F.split(F.lower(text), "[^a-z0-9]+"), lambda t: t != "")


def count_tokens(text: Column) -> Column:
    """Number of words (Unicode letters, numbers, "_") and single punctuation marks; null gives 0."""
    found = F.regexp_extract_all(text, F.lit(f"([{WORD_CLASS}]+|[^{WORD_CLASS}{SPACE_CLASS}])"), F.lit(1))
    return F.greatest(F.coalesce(F.size(found), F.lit(0)), F.lit(0))


def normal_space(text: Column) -> Column:
    """Lower-cased, each run of white space one blank, none at the ends."""
    return F.trim(F.regexp_replace(F.lower(text), f"[{SPACE_CLASS}]+", " "))


def strip(text: Column) -> Column:
    return F.regexp_replace(text, f"^[{SPACE_CLASS}]+|[{SPACE_CLASS}]+$", "")


def char_ngrams(text: Column, sizes: tuple[int, ...] = (3, 4, 5)) -> Column:
    """Code-point n-grams of the normalised text, sizes in order; sizes below 1 or above the length give none."""

    def of(chars: Column, n: int) -> Column:
        last = F.size(chars) - n + 1
        grams = F.transform(F.sequence(F.lit(1), last), lambda i: F.array_join(F.slice(chars, i, F.lit(n)), ""))
        return F.when(last >= 1, grams).otherwise(F.array().cast("array<string>"))

    wanted = [n for n in sizes if n > 0]
    if not wanted:
        return F.array().cast("array<string>")
    # One array of code points a row, bound to a lambda variable: it is computed once, and a slice
    # costs no walk through the text.
    points = F.regexp_extract_all(normal_space(text), F.lit("(?s)(.)"), F.lit(1))
    return F.transform(F.array(points), lambda chars: F.concat(*[of(chars, n) for n in wanted]))[0]


def stable_hash(*parts: Column) -> Column:
    """SHA-256 of the parts' strings, each ended by NUL."""
    nul = F.char(F.lit(0))
    return F.sha2(F.concat(*[x for p in parts for x in (p.cast("string"), nul)]), 256)


def content_hash(text: Column) -> Column:
    return F.sha2(text, 256)


def union_length(intervals: Column) -> Column:
    """Length of the union of half-open intervals in an array of struct(s, e); adjacency merges."""
    start = F.struct(F.lit(0).alias("t"), F.lit(-1).alias("e"))

    def add(acc: Column, x: Column) -> Column:
        new = F.greatest(F.lit(0), x["e"] - F.greatest(x["s"], acc["e"]))
        return F.struct((acc["t"] + new).alias("t"), F.greatest(acc["e"], x["e"]).alias("e"))

    return F.aggregate(F.array_sort(intervals), start, add, lambda acc: acc["t"])


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def l2_normalize(v: Column) -> Column:
    """Unit length in double; a zero vector stays zero."""
    norm = F.sqrt(dot(v, v))
    return F.when(norm == 0, v.cast("array<double>")).otherwise(F.transform(v, lambda x: x.cast("double") / norm))


def cosine(a: Column, b: Column) -> Column:
    """0 where either vector is zero."""
    norms = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(norms == 0, F.lit(0.0)).otherwise(dot(a, b) / norms)
