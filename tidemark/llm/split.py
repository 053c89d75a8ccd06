"""Oversized texts cut at natural boundaries, by range-maximum queries over boundary strengths.

A boundary is a run of whitespace. Its strength: 4 blank line, 3 line end, 2 whitespace after . ! or
?, 1 other whitespace. A sparse table over the strengths answers "strongest boundary in this length
window, the rightmost of equals" in constant time.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LEVELS = {4: "paragraph", 3: "line", 2: "sentence", 1: "word", 0: "none"}
_SPACE = re.compile(r"\s+")
_LINE_END = re.compile("\r\n|[\n\r\x85\u2028\u2029]")


class BoundaryIndex:
    """The boundaries of one text: where each begins and ends, its strength, and a sparse table."""

    def __init__(self, text: str):
        begins, ends, strengths = [], [], []
        for m in _SPACE.finditer(text):
            a, b = m.span()
            if a == 0 or b == len(text):
                continue
            breaks = len(_LINE_END.findall(m.group()))
            begins.append(a)
            ends.append(b)
            strengths.append(4 if breaks > 1 else 3 if breaks else 2 if text[a - 1] in ".!?" else 1)
        self.begins, self.ends = np.array(begins, np.int64), np.array(ends, np.int64)
        # strength and position in one number: the maximum is the strongest, then the rightmost
        n = len(begins)
        row = np.array(strengths, np.int64) * (n + 1) + np.arange(n)
        self.table, width = [row], 1
        while 2 * width <= n:
            last = self.table[-1]
            self.table.append(np.maximum(last[:-width], last[width:]))
            width *= 2

    def strongest(self, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Strength (0: none) and index of the strongest boundary in each index range [lo, hi)."""
        n, size = len(self.begins), hi - lo
        strength, where = np.zeros(len(lo), np.int64), np.full(len(lo), -1, np.int64)
        level = np.zeros(len(lo), np.int64)
        some = size > 0
        level[some] = np.floor(np.log2(size[some])).astype(np.int64)
        for k in np.unique(level[some]):
            at = np.flatnonzero(some & (level == k))
            row = self.table[k]
            best = np.maximum(row[lo[at]], row[hi[at] - (1 << int(k))])
            strength[at], where[at] = best // (n + 1), best % (n + 1)
        return strength, where


def cut_level(text: str, limit: int) -> int:
    """The strongest level at which cutting at every boundary of it or above leaves no piece over ``limit``.

    Level s suffices if from the start and from the end of every boundary of strength s or more the
    window of ``limit`` characters holds a boundary of strength s or more, or the end of the text.
    """
    index = BoundaryIndex(text)
    n, size = len(text.rstrip()), len(index.begins)
    lead = len(text) - len(text.lstrip())
    starts = np.concatenate(([lead], index.ends)).astype(np.int64)
    strengths = np.concatenate(([9], index.table[0] // (size + 1))).astype(np.int64)
    lo = np.arange(size + 1)
    hi = np.searchsorted(index.begins, starts + limit, side="right")
    best, _ = index.strongest(lo, np.maximum(hi, lo))
    best[starts + limit >= n] = 9
    for level in (4, 3, 2, 1):
        if (best[strengths >= level] >= level).all():
            return level
    return 0


def split_text(text: str, limit: int = 30_000, overlap: int = 500) -> list[tuple[int, int, int]]:
    """(start, end, strength of the cut at its end) of pieces of at most ``limit`` that overlap by ``overlap``.

    The pieces cover the whole text in order. Each cut is the strongest boundary of the permissible
    window (start + overlap, start + limit], the rightmost of equals, else a hard cut at the limit
    (strength 0). The last piece has strength 5. A text within the limit is one piece; an empty one is
    one empty piece.
    """
    if not 0 <= overlap < limit // 2:
        raise ValueError("overlap must be at least 0 and under half the limit")
    index, n, start, pieces = None, len(text), 0, []
    while n - start > limit:
        index = index or BoundaryIndex(text)
        lo = np.searchsorted(index.begins, start + overlap, side="right")
        hi = np.searchsorted(index.begins, start + limit, side="right")
        strength, where = index.strongest(np.array([lo]), np.array([hi]))
        end = int(index.begins[where[0]]) if strength[0] else start + limit
        pieces.append((start, end, int(strength[0])))
        start = end - overlap
    pieces.append((start, n, 5))
    return pieces


def split_oversized(df: DataFrame, id_col: str, text_col: str, limit: int = 30_000, overlap: int = 500) -> DataFrame:
    """(id, cut_at, piece_no, start, end, cut, piece) for every text of more than ``limit`` code points.

    Lengths are filtered on the JVM, so only oversized texts reach Python, a batch at a time. Null
    texts and ids are left out, repeated ids come out once, other columns are ignored.
    """
    picked = (
        df.where(F.col(id_col).isNotNull() & (F.length(text_col) > limit))
        .select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
        .dropDuplicates(["id"])
    )

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                level, parts = LEVELS[cut_level(text, limit)], split_text(text, limit, overlap)
                yield pa.RecordBatch.from_arrays([
                    pa.array([key] * len(parts), pa.int64()), pa.array([level] * len(parts)),
                    pa.array(range(len(parts)), pa.int32()), pa.array([p[0] for p in parts], pa.int64()),
                    pa.array([p[1] for p in parts], pa.int64()), pa.array([LEVELS.get(p[2], "end") for p in parts]),
                    pa.array([text[a:b] for a, b, _ in parts]),
                ], ["id", "cut_at", "piece_no", "start", "end", "cut", "piece"])

    return picked.mapInArrow(pieces, "id long, cut_at string, piece_no int, start long, end long, cut string, piece string")
