"""Benchmark decontamination: a hash set of the benchmark's word windows, scanned over every document.

The windows of a block of benchmark items travel with the tasks as sorted 64-bit hashes; a block is cut off at a fixed
number of bytes. Each document's windows are hashed in bulk and looked up, and every hash hit is compared with the
window's words before it counts. A larger benchmark takes one scan a block, of which only the documents with hits are
written down.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skein.llm.common import bounded_batches, cut_lineage, row_columns
from skein.llm.text import BY_LETTER, joined_words, per_text, rolled, text_slices

WINDOW = 10
#: Bytes of benchmark text whose windows a task holds at once.
BLOCK_BYTES = 16 << 20
SPANS = "array<struct<first_word:bigint,end_word:bigint,first_byte:bigint,end_byte:bigint>>"
FOUND = f"struct<n_words:bigint,spans:{SPANS},items:array<string>>"
_SPAN_NAMES = ("first_word", "end_word", "first_byte", "end_byte")
_SPAN_TYPE = pa.list_(pa.struct([(n, pa.int64()) for n in _SPAN_NAMES]))


def words_of(text: bytes) -> list[bytes]:
    return text.translate(BY_LETTER).split()


@dataclass
class Windows:
    """Windows of one width, by rising hash: their items and the places of their words in `Index.buffer`."""

    width: int
    hashes: np.ndarray
    item: np.ndarray
    start: np.ndarray
    end: np.ndarray


@dataclass
class Index:
    ids: list[str]
    buffer: bytes
    tables: list[Windows]


def window_index(items: list[tuple[str, bytes]], window: int = WINDOW) -> Index:
    """All windows of the items; an item with fewer words than `window` is one window of its own width."""
    plain = [b" ".join(words_of(text)) for _, text in items]
    buffer, starts, ends, hashes, owner = joined_words(plain, BY_LETTER)
    counts = np.bincount(owner, minlength=len(items))
    tables = []
    for width in np.unique(np.minimum(counts[counts > 0], window)).tolist():
        rolling = rolled(hashes, width)
        first = np.arange(len(rolling))
        fits = (owner[first] == owner[first + width - 1]) & ((width == window) | (counts[owner[first]] == width))
        first = first[fits]
        first = first[np.argsort(rolling[first], kind="stable")]
        tables.append(Windows(width, rolling[first], owner[first].astype(np.int32), starts[first], ends[first + width - 1]))
    return Index([i for i, _ in items], buffer, tables)


def _merged(spans: list[tuple[int, int, int, int]]) -> list[tuple[int, int, int, int]]:
    out: list[tuple[int, int, int, int]] = []
    for a, b, x, y in sorted(spans):
        if out and a <= out[-1][1]:
            if b > out[-1][1]:
                out[-1] = (out[-1][0], b, out[-1][2], y)
        else:
            out.append((a, b, x, y))
    return out


def _scan(index: Index) -> Callable[[list[bytes]], pa.Array]:
    """A function from texts to their numbers of words, spans and items."""
    filters = []
    for table in index.tables:
        bits = min(26, max(12, (8 * len(table.hashes)).bit_length()))
        seen = np.zeros(1 << bits, bool)
        seen[table.hashes >> np.uint64(64 - bits)] = True
        filters.append((table, np.uint64(64 - bits), seen))

    def found(texts: list[bytes]) -> pa.Array:
        buffer, starts, ends, hashes, owner = joined_words(texts, BY_LETTER)
        first_of = np.searchsorted(owner, np.arange(len(texts) + 1))
        byte_of = np.cumsum([0, *(len(t) + 1 for t in texts)])
        spans: list[list] = [[] for _ in texts]
        items: list[set] = [set() for _ in texts]
        for table, shift, seen in filters:
            windows = rolled(hashes, table.width)
            n = len(windows)
            maybe = np.flatnonzero(seen[windows >> shift] & (owner[:n] == owner[table.width - 1 : table.width - 1 + n]))
            at = np.searchsorted(table.hashes, windows[maybe])
            held = at < len(table.hashes)
            maybe, at = maybe[held], at[held]
            held = table.hashes[at] == windows[maybe]
            for i, k in zip(maybe[held].tolist(), at[held].tolist(), strict=True):
                a, b = int(starts[i]), int(ends[i + table.width - 1])
                words, hit = b" ".join(buffer[a:b].split()), False
                while k < len(table.hashes) and table.hashes[k] == windows[i]:
                    if index.buffer[table.start[k] : table.end[k]] == words:
                        items[owner[i]].add(index.ids[table.item[k]])
                        hit = True
                    k += 1
                if hit:
                    d = int(owner[i])
                    w, byte = i - int(first_of[d]), int(byte_of[d])
                    spans[d].append((w, w + table.width, a - byte, b - byte))
        listed = [[dict(zip(_SPAN_NAMES, s, strict=True)) for s in _merged(own)] for own in spans]
        return pa.StructArray.from_arrays(
            [pa.array(np.diff(first_of), pa.int64()), pa.array(listed, _SPAN_TYPE), pa.array([sorted(x) for x in items], pa.list_(pa.string()))],
            names=["n_words", "spans", "items"],
        )

    return found


_MERGE = """
aggregate(array_sort(concat(spans, coalesce(more_spans, array()))), CAST(array() AS {t}), (acc, s) ->
  CASE WHEN size(acc) > 0 AND s.first_word <= element_at(acc, -1).end_word
    THEN concat(slice(acc, 1, size(acc) - 1), array(named_struct(
      'first_word', element_at(acc, -1).first_word, 'end_word', greatest(element_at(acc, -1).end_word, s.end_word),
      'first_byte', element_at(acc, -1).first_byte, 'end_byte', greatest(element_at(acc, -1).end_byte, s.end_byte))))
    ELSE concat(acc, array(s)) END)
""".format(t=SPANS)


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, text_col: str = "text", item_text: str = "text", item_id: str = "item_id", block_bytes: int = BLOCK_BYTES, carry: tuple[str, ...] | None = None) -> DataFrame:
    """(doc, n_words, n_hit, spans, items) for every row of `docs`, with `doc` the row (or its columns `carry`).

    Words are lower-cased (A-Z) runs of letters, digits and non-ASCII characters. A window is `window` consecutive
    words of an item; an item of fewer words is one window; one without words has none. `spans` are the merged runs
    of document words inside any occurrence of a window, with word and byte borders; `items` the ids, as strings
    and sorted as such, of items with an occurring window (a null id is written "null"). Null and empty texts have
    no words. Items that share a window all count. Repeated rows each get their own result.
    """
    bounded_batches(docs.sparkSession)
    items = benchmark.select(F.coalesce(F.col(item_id).cast("string"), F.lit("null")).alias("id"), F.col(item_text).cast("binary").alias("text")).filter("text IS NOT NULL")
    total = items.agg(F.sum(F.length("text"))).first()[0] or 0
    blocks = max(1, -(-total // block_bytes))

    def found(block: int) -> Column:
        # About block_bytes of text: what reaches the driver and each task has that bound.
        part = [(r["id"], bytes(r["text"])) for r in items.filter(F.pmod(F.xxhash64("id", "text"), F.lit(blocks)) == block).toLocalIterator()]
        index = window_index(part, window)
        return per_text(F.col(text_col), FOUND, lambda: _scan(index))

    state = docs.select(F.struct(*(carry or ["*"])).alias("doc"), found(0).alias("__f"), *([_row_key(docs).alias("__k")] if blocks > 1 else []))
    state = state.select("doc", "__f.*", *(["__k"] if blocks > 1 else []))
    if blocks > 1:
        # Rows that agree in all columns have one key and the same hits.
        rest = None
        for block in range(1, blocks):
            own = docs.select(_row_key(docs).alias("__k"), found(block).alias("f")).filter(F.size("f.items") > 0).select("__k", "f.spans", "f.items")
            own = cut_lineage(own.distinct())
            rest = own if rest is None else rest.unionByName(own)
        more = rest.groupBy("__k").agg(F.flatten(F.collect_list("spans")).alias("more_spans"), F.flatten(F.collect_list("items")).alias("more_items"))
        state = state.join(more, "__k", "left").select(
            "doc", "n_words", F.expr(_MERGE).alias("spans"), F.array_sort(F.array_union("items", F.coalesce("more_items", F.array().cast("array<string>")))).alias("items")
        )
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda acc, s: acc + s["end_word"] - s["first_word"])
    return state.select("doc", "n_words", n_hit.alias("n_hit"), "spans", "items")


def _row_key(docs: DataFrame) -> Column:
    columns = row_columns(docs)
    return F.concat_ws(":", F.xxhash64(*columns).cast("string"), F.xxhash64(F.lit(1), *columns).cast("string"))


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, min_hit_words: int = 1, **how: object) -> DataFrame:
    """The rows of `docs` with fewer than `min_hit_words` words inside benchmark windows; all other columns untouched."""
    return contamination(docs, benchmark, **how).filter(F.col("n_hit") < min_hit_words).select("doc.*")


def _cut(texts: list[bytes | None], spans: list[list[dict]]) -> list[str | None]:
    out: list[str | None] = []
    for text, cuts in zip(texts, spans, strict=True):
        if text is None:
            out.append(None)
            continue
        kept, at = [], 0
        for s in cuts:
            kept.append(text[at : s["first_byte"]])
            at = s["end_byte"]
        out.append(b"".join([*kept, text[at:]]).decode("utf-8", "replace"))
    return out


def remove_spans(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", **how: object) -> DataFrame:
    """`docs` with every span inside benchmark windows cut out of the text, from its first to its last word."""
    found = contamination(docs, benchmark, text_col=text_col, **how)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, _ in text_slices(batches, "__raw"):
            clean = _cut(rows.column("__raw").to_pylist(), rows.column("spans").to_pylist())
            yield pa.RecordBatch.from_arrays([rows.column("doc"), pa.array(clean, pa.string())], names=["doc", "clean"])

    ready = found.select("doc", F.col(f"doc.`{text_col}`").cast("binary").alias("__raw"), "spans")
    cut = ready.mapInArrow(run, ready.select("doc").schema.add("clean", "string"))
    return cut.select(*[F.col("clean").alias(c) if c == text_col else F.col(f"doc.`{c}`").alias(c) for c in docs.columns])
