"""Boundary-aware chunks of markdown.

Where a chunk ends depends on where the one before ended, so this is no window: it runs over Arrow batches, one
array of chunks for each text, and the plan explodes them.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.functions.batches import small_batches

#: A boundary must lie behind this share of the chunk: fences, paragraphs and sentences, and words.
STRONG, WEAK = 0.3, 0.8
_BREAK = re.compile(r"\. |\n\n")


def _end(text: str, start: int, size: int) -> int:
    """Where the chunk from ``start`` ends; a paragraph or sentence that lies too far ahead forbids the weaker kinds."""
    hard = start + size
    fence = text.rfind("```", start, hard) - start
    if fence > STRONG * size:
        return start + fence
    for mark, keep in (("\n\n", 0), (". ", 1)):
        at = text.rfind(mark, start, hard) - start
        if at >= 0:
            return start + at + keep if at > STRONG * size else hard
    space = text.rfind(" ", start, hard) - start
    return start + space if space > WEAK * size else hard


def chunks(text: str | None, size: int = 5000, overlap: int = 200) -> list[str]:
    """Stripped chunks of at most ``size`` characters. From the second chunk on, the next one starts up to ``overlap``
    characters before its end, behind the last sentence or paragraph end in that stretch."""
    out: list[str] = []
    if not text or not text.strip():
        return out
    start = 0
    while start < len(text):
        if start + size >= len(text):
            rest = text[start:].strip()
            return [*out, rest] if rest else out
        end = _end(text, start, size)
        piece = text[start:end].strip()
        if piece:
            out.append(piece)
        if len(out) <= 1:
            start = end
            continue
        back = end - overlap
        marks = [m.start() for m in _BREAK.finditer(text[max(0, back) : end])]
        start = max(start + 1, back, back + marks[-1] + 2 if marks else 0)
    return out


def with_chunks(df: DataFrame, text: str, size: int = 5000, overlap: int = 200) -> DataFrame:
    """A row for each chunk of ``text``: ``chunk_number`` (from 1) and ``chunk``; no row for a blank text."""
    small_batches(df.sparkSession)

    @F.pandas_udf("array<string>")
    def cut(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for t in texts:
            yield t.map(lambda x: chunks(x, size, overlap))

    out = df.select("*", F.posexplode(cut(F.col(text))).alias("_pos", "chunk"))
    return out.withColumn("chunk_number", F.col("_pos") + 1).drop("_pos")
