"""Long texts cut into overlapping pieces at natural boundaries.

Every cut position of a text has a strength: paragraph, line, sentence, word, none.  A sparse table
of range maxima answers in constant time which position in the reach of a piece is the strongest,
the latest one among equals.  A piece ends in the second half of its reach if there is any boundary
there, else anywhere that leaves the next piece room to go on, else at its full length.

Nulls and texts within the limit come out as one piece, an empty text as one empty piece.  Lengths
are code points; what a stored length column says doesn't count.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: boundaries from weak to strong; the cut lies at the end of the match
_BOUNDARIES = [
    (1, re.compile(r"\s+")),
    (2, re.compile(r"[.!?…][\"'”’)\]]*\s+|[。！？।॥]+\s*")),
    (3, re.compile(r"(?:\r\n|[\n\r\u2028\x0b])[^\S\n\r\u2028\u2029\x0b\x0c]*")),
    (4, re.compile(r"(?:(?:\r\n|[\n\r\u2028])\s*){2,}|[\x0c\u2029]\s*")),
]
#: texts are looked at in stretches of so many reaches, which bounds the table
STRETCH = 16


def _strengths(text: str) -> np.ndarray:
    """The strength of a cut before each position; 0 none, -1 inside a character or a line end."""
    out = np.zeros(len(text) + 1, dtype=np.int64)
    for strength, pattern in _BOUNDARIES:
        for m in pattern.finditer(text):
            out[m.end()] = max(out[m.end()], strength)
    for i in range(1, len(text)):
        ch = text[i]
        if (ch > "\u02ff" and (unicodedata.combining(ch) or ch in "\u200d\ufe0f" or text[i - 1] == "\u200d")) or (ch == "\n" and text[i - 1] == "\r"):
            out[i] = -1
    return out


class SparseTable:
    """Range maxima: level k holds the maxima of all runs of 2**k values."""

    def __init__(self, values: np.ndarray):
        self.levels = [values]
        while len(last := self.levels[-1]) > (half := 1 << (len(self.levels) - 1)):
            self.levels.append(np.maximum(last[:-half], last[half:]))

    def top(self, low: int, high: int) -> int:
        """The largest of values[low..high], both included."""
        k = (high - low + 1).bit_length() - 1
        level = self.levels[k]
        return int(max(level[low], level[high - (1 << k) + 1]))


def cuts(text: str, limit: int, overlap: int) -> list[tuple[int, int]]:
    """(start, end) of the pieces of a text."""
    if not 0 <= overlap < limit:
        raise ValueError("the overlap must be shorter than a piece")
    n, start, out = len(text), 0, []
    base = reach = 0
    table = None
    while n - start > limit:
        if table is None or start + limit > reach:
            base, reach = start, min(n, start + STRETCH * limit)
            strength = _strengths(text[base:reach])
            size = len(strength)
            table = SparseTable((strength + 1) * size + np.arange(size))
        high = start + limit - base
        for low in (max(start + overlap + 1, start + limit // 2) - base, start + overlap + 1 - base):
            kind, at = divmod(table.top(low, high), size)
            if kind > 1:
                break
        end = base + at
        out.append((start, end))
        start = end - overlap
    return [*out, (start, n)]


def pieces(pages: DataFrame, limit: int, overlap: int, id_col: str = "id", text_col: str = "text") -> DataFrame:
    """One row (page_id, piece_no, piece_start, piece_end, piece) per piece; a narrow map."""

    def convert(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for page, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                spans = cuts(text or "", limit, overlap)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([page] * len(spans), pa.int64()),
                        pa.array(range(len(spans)), pa.int32()),
                        pa.array([s for s, _ in spans], pa.int64()),
                        pa.array([e for _, e in spans], pa.int64()),
                        pa.array([None if text is None else text[s:e] for s, e in spans], pa.string()),
                    ],
                    names=["page_id", "piece_no", "piece_start", "piece_end", "piece"],
                )

    rows = pages.select(F.col(id_col).cast("bigint").alias("page_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(convert, "page_id bigint, piece_no int, piece_start bigint, piece_end bigint, piece string")


def found(pages: DataFrame, limit: int, overlap: int) -> DataFrame:
    """The pages that come out in more than one piece."""
    long = pages.filter(F.length("text") > limit)
    return pieces(long, limit, overlap).filter("piece_no = 1").select("page_id")
