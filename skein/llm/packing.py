"""Packing of tokenised documents into fixed-length sequences by first-fit decreasing.

Documents are cut at multiples of the sequence length, the pieces are dealt to random groups of bounded expected
size, and each group is packed on its own: pieces by falling length, each into the first bin that still has room,
found by descending a tournament tree of the bins' free space. Token ids are never shuffled, only piece lengths.
"""

from __future__ import annotations

import os
import re
import zlib
from collections.abc import Iterator
from itertools import chain, islice

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skein.llm.common import bounded_batches
from skein.llm.text import hand_back, text_slices

LENGTH = 1024
END_ID = 0
#: Pieces that meet in one group, on average.
GROUP_PIECES = 2048
#: Distinct chunks whose ids a worker keeps; later ones are forgotten after each slice of texts.
CACHED_CHUNKS = 400_000
_BEFORE_WORD = re.compile(r" (?=\S)")
_ODD_SPACE = re.compile(r" (?:\s|\Z)")


class _Numbering(dict):
    """Numbers its keys in the order in which they are first asked for."""

    def __missing__(self, key: str) -> int:
        self[key] = number = len(self)
        return number


class ChunkTokenizer:
    """Token ids of whole texts, each distinct space-separated chunk being encoded once and then looked up.

    The tokenizer splits at every space that a non-space follows and never merges across, so the ids of a text are
    those of its chunks, each with the space before it, in order. A text with other runs of spaces is cut by pattern
    instead of at every space.
    """

    def __init__(self, path: str, cached: int = CACHED_CHUNKS) -> None:
        from tokenizers import Tokenizer

        self.tokenizer, self.cached = Tokenizer.from_file(path), cached
        self.known = _Numbering()
        self.ids, self.filled = np.zeros(1 << 16, np.uint32), 0
        self.starts, self.sizes = np.zeros(1 << 14, np.int64), np.zeros(1 << 14, np.int64)

    def _encode(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _add(self, chunks: list[str], at: int) -> None:
        """Numbers from `at` on for new chunks."""
        for first in range(0, len(chunks), 50_000):
            made = self._encode([" " + c for c in chunks[first : first + 50_000]])
            sizes = np.fromiter(map(len, made), np.int64, len(made))
            total, begin = int(sizes.sum()), at + first
            need = begin + len(made)
            if need > len(self.starts):
                self.starts, self.sizes = (np.concatenate([x, np.zeros(need, np.int64)]) for x in (self.starts, self.sizes))
            if self.filled + total > len(self.ids):
                self.ids = np.concatenate([self.ids, np.zeros(self.filled + total, np.uint32)])
            self.ids[self.filled : self.filled + total] = np.fromiter(chain.from_iterable(made), np.uint32, total)
            self.sizes[begin:need], self.starts[begin:need] = sizes, self.filled + np.cumsum(sizes) - sizes
            self.filled += total

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        firsts, chunks, counts = [], [], []
        for text in texts:
            parts = _BEFORE_WORD.split(text) if _ODD_SPACE.search(text) else text.split(" ")
            firsts.append(parts[0])
            counts.append(len(parts) - 1)
            chunks += parts[1:]
        mark, before = self.filled, len(self.known)
        index = np.fromiter(map(self.known.__getitem__, chunks), np.int64, len(chunks))
        new = list(islice(self.known, before, None))
        if new:
            self._add(new, before)
        sizes, starts = self.sizes[index], self.starts[index]
        ends = np.cumsum(sizes)
        ids = self.ids[np.arange(int(ends[-1]) if len(ends) else 0) + np.repeat(starts - ends + sizes, sizes)]
        bounds = np.concatenate([[0], ends])[np.cumsum([0, *counts])]
        heads = self._encode(firsts)
        if len(self.known) > self.cached:
            for c in new:
                del self.known[c]
            self.filled = mark
        return [np.concatenate([np.array(h, np.uint32), ids[a:b]]) for h, a, b in zip(heads, bounds, bounds[1:], strict=False)]


_coders: dict[str, ChunkTokenizer] = {}


def chunk_tokenizer(path: str) -> ChunkTokenizer:
    """One for each path, which a worker keeps between its tasks; it takes some 150 MB at most."""
    if path not in _coders:
        _coders.clear()
        _coders[path] = ChunkTokenizer(path)
    return _coders[path]


def default_tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def cut_pieces(docs: DataFrame, length: int, tokenizer_path: str | None, text_col: str, id_col: str) -> DataFrame:
    """(doc_id, start, length, ids_crc32, doc_tokens, salt): each document's ids and the end id, in pieces."""
    schema = docs.select(F.col(id_col).alias("doc_id")).schema
    for name in ("start", "length", "ids_crc32", "doc_tokens", "salt"):
        schema = schema.add(name, "long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        coder = chunk_tokenizer(tokenizer_path or default_tokenizer_path())
        salt = (TaskContext.get().partitionId() if TaskContext.get() else 0) << 33
        for rows, texts in text_slices(batches, "text", 1 << 22):
            owner, start, size, crc, total = [], [], [], [], []
            for d, ids in enumerate(coder.encode([t.decode("utf-8", "replace") for t in texts])):
                ids = np.append(ids, np.uint32(END_ID)).astype("<u4", copy=False)
                for a in range(0, len(ids), length):
                    piece = ids[a : a + length]
                    owner.append(d)
                    start.append(a)
                    size.append(len(piece))
                    crc.append(zlib.crc32(piece))
                    total.append(len(ids))
            out = [rows.column("doc_id").take(pa.array(owner, pa.int64())), *(pa.array(x, pa.int64()) for x in (start, size, crc, total, range(salt, salt + len(owner))))]
            salt += len(owner)
            yield pa.RecordBatch.from_arrays(out, names=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "salt"])
        hand_back()

    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("binary").alias("text")).mapInArrow(run, schema)


def first_fit_decreasing(sizes: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """(bin, offset in it) of each size; ties keep their order. Sizes are from 1 to `capacity`."""
    n = len(sizes)
    leaves = 1 << max(0, (n - 1).bit_length())
    tree = [capacity] * (2 * leaves)
    bins, offsets = np.zeros(n, np.int64), np.zeros(n, np.int64)
    for i in np.argsort(-sizes, kind="stable").tolist():
        size, node = int(sizes[i]), 1
        while node < leaves:
            node *= 2
            if tree[node] < size:
                node += 1
        bins[i], offsets[i] = node - leaves, capacity - tree[node]
        tree[node] -= size
        while node > 1:
            node //= 2
            best = max(tree[2 * node], tree[2 * node + 1])
            if tree[node] == best:
                break
            tree[node] = best
    return bins, offsets


def pack(docs: DataFrame, length: int = LENGTH, tokenizer_path: str | None = None, text_col: str = "text", id_col: str = "doc_id", group_pieces: int = GROUP_PIECES) -> DataFrame:
    """(doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset): where each piece of each row of `docs` lies.

    A document is its token ids and a final id 0; a null or empty text is that id alone. Pieces are at most `length`
    ids; a piece keeps to one sequence. `sequence_id` is unique over the table, `offset` runs without gaps inside a
    sequence. Pieces are dealt to groups by a hash of where they were read, so that repeated ids or rows, and the
    pieces of one long document, spread evenly. An empty table gives an empty table.
    """
    bounded_batches(docs.sparkSession)
    # A text has a token for every byte at most and about one for four; groups are counted by the pieces to come.
    size = docs.agg(F.count("*").alias("n"), F.sum(F.octet_length(F.col(text_col)).cast("long")).alias("b")).first()
    groups = max(1, -(-(size["n"] + (size["b"] or 0) // (4 * length)) // group_pieces))
    pieces = cut_pieces(docs, length, tokenizer_path, text_col, id_col)
    pieces = pieces.withColumn("group", F.pmod(F.xxhash64("salt"), F.lit(groups)))
    schema = pieces.drop("salt", "group").schema.add("sequence_id", "long").add("offset", "long")

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("salt", kind="stable")
        bins, offsets = first_fit_decreasing(pdf["length"].to_numpy(), length)
        pdf = pdf.assign(sequence_id=(pdf["group"].to_numpy() << 32) | bins, offset=offsets)
        return pdf[schema.names]

    return pieces.groupBy("group").applyInPandas(one, schema)
