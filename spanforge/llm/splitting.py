"""Splitting oversized texts at natural boundaries.

Method: balanced targets. The minimum number of pieces is computed, targets are placed, each is
snapped to the strongest boundary nearby, and pieces are added when any limit fails.
Two placements share the boundary search:

* ``balanced``: equal-length targets, each snapped within a tolerance; when a piece would exceed
  the limit, the number of pieces grows by one and all targets are placed again.
* ``full``: a target at the limit from each piece's actual start, snapped back over at most
  ``window`` characters to the strongest kind's last boundary; pieces are added until the text
  ends. A task that fixes every cut position by the previous one needs this placement, as
  equal-length targets cannot give it.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Boundary marks from strong to weak; a boundary is the position after the mark.
BOUNDARY_KINDS = (("\n\n",), ("\n",), (". ", "! ", "? ", "。", "！", "？"), (" ",))


def last_boundary(text: str, after: int, upto: int) -> int:
    """The last boundary e, after < e <= upto, of the first kind that occurs there; -1 if none does."""
    for marks in BOUNDARY_KINDS:
        best = -1
        for mark in marks:
            at = text.rfind(mark, max(0, after - len(mark) + 1), upto)
            if at >= 0:
                best = max(best, at + len(mark))
        if best > after:
            return best
    return -1


def nearest_boundary(text: str, target: int, lo: int, hi: int) -> int:
    """The boundary e, lo < e <= hi, of the strongest kind there, nearest to target; target if none."""
    for marks in BOUNDARY_KINDS:
        found = []
        for mark in marks:
            n = len(mark)
            at = text.rfind(mark, max(0, lo - n + 1), target)
            if at >= 0 and at + n > lo:
                found.append(at + n)
            at = text.find(mark, max(0, lo - n + 1, target - n + 1), hi)
            if at >= 0 and at + n > lo:
                found.append(at + n)
        if found:
            return min(found, key=lambda e: (abs(e - target), e))
    return target


def full_pieces(text: str, limit: int, overlap: int, window: int) -> list[tuple[int, int]]:
    n, start, pieces = len(text), 0, []
    while n - start > limit:
        end = last_boundary(text, start + limit - window, start + limit)
        if end < 0:
            end = start + limit
        pieces.append((start, end))
        start = end - overlap
    pieces.append((start, n))
    return pieces


def balanced_pieces(text: str, limit: int, overlap: int, tolerance: int) -> list[tuple[int, int]]:
    n = len(text)
    count = max(1, -(-(n - overlap) // (limit - overlap)))
    while True:
        stride = (n - overlap) / count
        pieces, start = [], 0
        for i in range(1, count):
            target = round(i * stride) + overlap
            lo, hi = max(start + overlap, target - tolerance), min(start + limit, target + tolerance, n)
            end = nearest_boundary(text, min(max(target, lo + 1), hi), lo, hi) if hi > lo else target
            pieces.append((start, end))
            start = end - overlap
        pieces.append((start, n))
        if all(0 < e - s <= limit for s, e in pieces) and all(a[0] < b[0] for a, b in zip(pieces, pieces[1:])):
            return pieces
        if count >= n:  # cuts without snapping always meet the limit
            return full_pieces(text, limit, overlap, 0)
        count += 1


def split_oversized(
    df: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    limit: int = 1500,
    overlap: int = 150,
    placement: str = "balanced",
    window: int = 750,
    tolerance: int = 200,
    keep_short: bool = False,
) -> DataFrame:
    """(id_col, piece_start int, piece_end int) for each text over ``limit`` code points.

    Short texts are filtered out in the JVM before any Python runs (with ``keep_short`` non-empty
    ones give one whole piece); null and empty texts give none. Repeated rows give repeated
    pieces; null ids stay null; other columns are ignored. Rows are independent, so nothing is
    shuffled and one text is the largest unit in memory.
    """
    if not 0 <= overlap < limit - window or window < 0 or (placement == "balanced" and limit <= 2 * overlap):
        raise ValueError("overlap must be shorter than the shortest piece")
    if placement not in ("balanced", "full"):
        raise ValueError("placement must be balanced or full")
    source = df.select(F.col(id_col).alias("k"), F.col(text_col).cast("string").alias("t"))
    source = source.where(F.length("t") > (0 if keep_short else limit))
    kind = source.schema["k"].dataType.simpleString()

    def run(batches):
        for batch in batches:
            take, starts, ends = [], [], []
            for i, text in enumerate(batch.column(1).to_pylist()):
                if len(text) <= limit:
                    pieces = [(0, len(text))]
                elif placement == "full":
                    pieces = full_pieces(text, limit, overlap, window)
                else:
                    pieces = balanced_pieces(text, limit, overlap, tolerance)
                for s, e in pieces:
                    take.append(i)
                    starts.append(s)
                    ends.append(e)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(take, pa.int32())), pa.array(starts, pa.int32()), pa.array(ends, pa.int32())],
                names=["k", "piece_start", "piece_end"],
            )

    return source.mapInArrow(run, f"k {kind}, piece_start int, piece_end int").withColumnRenamed("k", id_col)
