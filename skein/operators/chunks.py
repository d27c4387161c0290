"""Overlapping text chunks whose borders follow sentences and lines."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skein.session import bounded_batches

SIZE, OVERLAP = 1000, 200


def cut(text: str, size: int = SIZE, overlap: int = OVERLAP) -> list[str]:
    """Pieces of up to `size` characters; a piece ends after the last ". " or line end beyond its middle, if any."""
    if len(text) <= size:
        return [text]
    out, start = [], 0
    while start < len(text):
        end = start + size
        piece = text[start:end]
        if end < len(text):
            at = max(piece.rfind(". "), piece.rfind("\n"))
            if at > size // 2:
                piece = piece[: at + 1]
                end = start + at + 1
        out.append(piece.strip())
        start = end - overlap
    return out


def chunk(docs: DataFrame, size: int = SIZE, overlap: int = OVERLAP) -> DataFrame:
    """(doc_id, chunk_no, chunk) of (doc_id, text); where a piece starts depends on where the one before it ended.

    An overlap of more than half a piece would never come to an end, and is an error.
    """
    if not 0 <= overlap <= size // 2:
        raise ValueError("an overlap is half a piece at most")

    bounded_batches(docs.sparkSession)

    @F.pandas_udf("array<string>")
    def pieces(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: cut(t or "", size, overlap))

    out = docs.select("doc_id", F.posexplode(pieces("text")).alias("chunk_no", "chunk"))
    return out.withColumn("chunk_no", F.col("chunk_no").cast("long"))
