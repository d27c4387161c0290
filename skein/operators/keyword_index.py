"""An inverted index with block maxima, and exact keyword search that skips blocks which can't reach the best k.

The index is made in one pass over the texts. The documents that meet in a task are cut into shards of a bounded
number; inside a shard they are ordered by length and numbered, and 64 neighbours are a block. A row of the index is a
term in a shard: its documents and frequencies, and for each block the largest frequency and the least length, from
which the largest possible contribution follows. A search brings a block of queries to every shard. There a query adds
up the bounds of its terms for each block, scores the blocks from the largest bound down, and stops where no bound
reaches the k-th best score so far.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StructType

from skein.functions.text import words
from skein.session import shared_folder, spread

#: Documents of a block (a power of two) and of a shard at most, and words of a shard at most unless one document has more.
BLOCK, SHARD_DOCS, SHARD_WORDS = 64, 8192, 500_000
#: Blocks that are scored before the first look at the bounds; each further look takes three times as many.
FIRST_BLOCKS = 8
#: Scores are compared as rounded to six places, so a bound must be this much lower to rule a block out.
SLACK = 2e-6
_LISTS = ("docs", "tfs", "block_no", "block_start", "max_tf", "min_len")


def _schema(docs: DataFrame) -> StructType:
    out = StructType().add("shard", "string").add("term", "string").add("ids", ArrayType(docs.schema["id"].dataType))
    for name in _LISTS:
        out = out.add(name, ArrayType(IntegerType()))
    return out


def _runs(batches: Iterator[pa.RecordBatch], shard_docs: int) -> Iterator[pa.RecordBatch]:
    """Slices of a bounded number of documents and words."""
    for batch in batches:
        sizes = pc.fill_null(pc.list_value_length(batch.column(1)), 0).to_numpy(zero_copy_only=False)
        ends, first = np.cumsum(sizes, dtype=np.int64), 0
        while first < batch.num_rows:
            done = ends[first - 1] if first else 0
            last = min(first + shard_docs, max(first + 1, int(np.searchsorted(ends, done + SHARD_WORDS, side="right"))))
            yield batch.slice(first, last - first)
            first = last


def _lists(values: np.ndarray, offsets: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(values.astype(np.int32)))


def shard_rows(ids: pa.Array, held: pa.ListArray, shard: str) -> pa.RecordBatch:
    """One row for each term of a shard, and before them one with the term '' that has the ids and lengths of its documents.

    A null text counts as a document of the length -1, without words.
    """
    sizes = pc.fill_null(pc.list_value_length(held), -1).to_numpy(zero_copy_only=False).astype(np.int64)
    order = np.argsort(sizes, kind="stable")
    m, number = len(sizes), np.empty(len(sizes), np.int64)
    number[order] = np.arange(m)
    lens = sizes[order]
    coded = pc.dictionary_encode(held.flatten())
    code = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    key, tf = np.unique(code * m + np.repeat(number, np.maximum(sizes, 0)), return_counts=True)
    term, doc = key // max(m, 1), key % max(m, 1)
    edges = lambda x: np.append(np.flatnonzero(np.diff(x, prepend=-1)), len(x)) if len(x) else np.zeros(1, np.int64)
    terms = edges(term)
    block = term * (m // BLOCK + 1) + doc // BLOCK
    starts = edges(block)
    cut = np.searchsorted(starts, terms)
    first = starts[:-1]
    most = np.maximum.reduceat(tf, first) if len(first) else np.zeros(0, np.int64)
    least = np.minimum.reduceat(lens[doc], first) if len(first) else np.zeros(0, np.int64)
    inside = first - np.repeat(terms[:-1], np.diff(cut))
    shift = lambda offsets: np.append(0, offsets + m) if m else offsets  # noqa: E731  # the row of the documents comes first
    none = np.append(0, cut)
    n_rows = len(terms)
    names = pa.concat_arrays([pa.array([""]), coded.dictionary.take(pa.array(term[terms[:-1]])).cast(pa.string())])
    id_lists = pa.ListArray.from_arrays(pa.array(np.append(0, np.full(n_rows, m)).astype(np.int32)), ids.take(pa.array(order)))
    columns = [
        pa.array([shard] * n_rows, pa.string()), names, id_lists,
        _lists(np.concatenate([np.arange(m), doc]), shift(terms)), _lists(np.concatenate([lens, tf]), shift(terms)),
        _lists((doc // BLOCK)[first], none), _lists(inside, none), _lists(most, none), _lists(least, none),
    ]
    return pa.RecordBatch.from_arrays(columns, names=["shard", "term", "ids", *_LISTS])


@dataclass
class KeywordIndex:
    """A written index, the number of its documents and their mean length."""

    rows: DataFrame
    n_docs: int
    mean_length: float


def build_index(docs: DataFrame, path: str | None = None, shard_docs: int = SHARD_DOCS) -> KeywordIndex:
    """The index of (id, text), written to `path` or to a new shared folder; texts are read and cut into words once."""
    spark = docs.sparkSession

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in _runs(batches, shard_docs):
            yield shard_rows(part.column(0), part.column(1), uuid.uuid4().hex)

    path = path or shared_folder(spark, "keywords")
    spread(docs).select("id", words(F.col("text")).alias("w")).mapInArrow(run, _schema(docs)).write.parquet(path)
    return open_index(spark, path)


def open_index(spark: SparkSession, path: str) -> KeywordIndex:
    rows = spark.read.parquet(path)
    known = F.filter("tfs", lambda n: n >= 0)
    total = rows.filter("term = ''").select(F.size("tfs").alias("n"), F.size(known).alias("k"), F.aggregate(known, F.lit(0).cast("long"), lambda a, n: a + n).alias("w")).agg(F.sum("n"), F.sum("k"), F.sum("w")).first()
    return KeywordIndex(rows, int(total[0] or 0), float(total[2] or 0) / total[1] if total[1] else 0.0)


def index_counts(index: KeywordIndex) -> DataFrame:
    """One row: documents, distinct terms, postings and words of an index; zeros for an empty one."""
    of_terms = F.col("term") != ""
    known = F.filter("tfs", lambda n: n > 0)
    return index.rows.agg(
        F.coalesce(F.sum(F.when(~of_terms, F.size("tfs"))), F.lit(0)).cast("long").alias("documents"),
        F.count_distinct(F.when(of_terms, F.col("term"))).alias("terms"),
        F.coalesce(F.sum(F.when(of_terms, F.size("tfs"))), F.lit(0)).cast("long").alias("postings"),
        F.coalesce(F.sum(F.when(~of_terms, F.aggregate(known, F.lit(0).cast("long"), lambda a, n: a + n))), F.lit(0)).cast("long").alias("words"),
    )


@dataclass
class Shard:
    """One shard, flat: its documents, all postings, all blocks of postings, and where each term's blocks lie."""

    ids: pa.Array
    lens: np.ndarray
    docs: np.ndarray
    tfs: np.ndarray
    block: np.ndarray
    begin: np.ndarray
    end: np.ndarray
    max_tf: np.ndarray
    min_len: np.ndarray
    terms: dict[str, tuple[int, int]]


def read_shard(table: pa.Table) -> Shard:
    """The rows of one shard, in any order."""
    table = table.combine_chunks()
    lists = {c: pa.concat_arrays(table.column(c).chunks) for c in (*_LISTS, "ids")}
    flat = {c: lists[c].flatten().to_numpy(zero_copy_only=False) for c in _LISTS}
    sizes = {c: pc.list_value_length(lists[c]).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("docs", "block_no")}
    posts, blocks = np.append(0, np.cumsum(sizes["docs"])), np.append(0, np.cumsum(sizes["block_no"]))
    row = np.repeat(np.arange(table.num_rows), sizes["block_no"])
    begin = flat["block_start"] + posts[row]
    last = np.append(row[1:] != row[:-1], True) if len(row) else np.zeros(0, bool)
    end = np.where(last, posts[row + 1], np.append(begin[1:], 0))
    names = table.column("term").to_pylist()
    at = names.index("")
    terms = {t: (int(blocks[i]), int(blocks[i + 1])) for i, t in enumerate(names) if t}
    return Shard(lists["ids"].flatten(), flat["tfs"][posts[at] : posts[at + 1]], flat["docs"], flat["tfs"], flat["block_no"], begin, end, flat["max_tf"], flat["min_len"], terms)


def best_of_shard(shard: Shard, terms: list[tuple[str, float]], k: int, k1: float, b: float, mean: float) -> tuple[np.ndarray, np.ndarray, int, int]:
    """(numbers, scores, blocks, scored blocks) of a query of (term, weight): the k best documents and ties with the last one."""
    held = [(weight, *shard.terms[t]) for t, weight in terms if t in shard.terms]
    part = lambda tf, n: tf * (k1 + 1) / (tf + k1 * (1 - b + b * n / mean))
    own = np.concatenate([np.arange(first, last) for _, first, last in held] or [np.zeros(0, np.int64)])
    weight = np.repeat([w for w, _, _ in held], [last - first for _, first, last in held])
    block = shard.block[own]
    bound = np.bincount(block, weight * part(shard.max_tf[own], shard.min_len[own]), len(shard.lens) // BLOCK + 1)
    order = np.argsort(-bound, kind="stable")
    order = order[bound[order] > 0]
    total, score = len(order), np.zeros(len(shard.lens))
    done, step, reached = 0, FIRST_BLOCKS, -math.inf
    while done < total and bound[order[done]] >= reached - SLACK:
        chosen = order[done : done + step]
        chosen = chosen[bound[chosen] >= reached - SLACK]
        taken = np.zeros(len(bound), bool)
        taken[chosen] = True
        hit = np.flatnonzero(taken[block])
        begin = shard.begin[own[hit]]
        sizes = shard.end[own[hit]] - begin
        at = np.repeat(begin - np.cumsum(sizes) + sizes, sizes) + np.arange(int(sizes.sum()))
        docs = shard.docs[at]
        score += np.bincount(docs, np.repeat(weight[hit], sizes) * part(shard.tfs[at], shard.lens[docs]), len(score))
        done += len(chosen)
        step *= 3
        found = np.flatnonzero(score)
        if len(found) >= k:
            reached = np.partition(score[found], len(found) - k)[len(found) - k]
    found = np.flatnonzero(score)
    found = found[score[found] >= reached - SLACK]
    return found, score[found], total, done


def search(queries: DataFrame, index: KeywordIndex, k: int, k1: float, b: float) -> DataFrame:
    """(query_id, id, score, blocks, scored): of each shard a query's k best documents and ties, with the blocks that hold a term and those that were scored.

    `queries` has (query_id, terms), distinct words each. The blocks of queries are bounded, and so is what their
    terms' counts bring to the driver; a task works on one shard at a time.
    """
    from skein.operators.retrieve import in_query_blocks

    id_type = index.rows.schema["ids"].dataType.elementType
    schema = queries.select("query_id").schema.add("id", id_type).add("score", "double").add("blocks", "long").add("scored", "long")
    spark = queries.sparkSession

    def one(block: list) -> DataFrame:
        asked = sorted({t for r in block for t in r["terms"]})
        wanted = spark.createDataFrame([("",), *((t,) for t in asked)], "term string")
        # At most the terms of one block of queries.
        own = index.rows.join(F.broadcast(wanted), "term", "left_semi")
        counts = {r["term"]: r["df"] for r in own.filter("term <> ''").groupBy("term").agg(F.sum(F.size("docs")).alias("df")).toLocalIterator()}
        idf = {t: math.log(1 + (index.n_docs - n + 0.5) / (n + 0.5)) for t, n in counts.items()}
        plans = [(r["query_id"], [(t, idf[t]) for t in r["terms"] if t in idf]) for r in block]
        plans = [p for p in plans if p[1]]
        query_type = pa.array([r["query_id"] for r in block[:1]]).type if block else pa.int64()
        mean = index.mean_length

        def run(table: pa.Table) -> pa.Table:
            shard = read_shard(table)
            asked_ids, numbers, scores, blocks, scored = [], [], [], [], []
            for query_id, terms in plans:
                found, values, total, done = best_of_shard(shard, terms, k, k1, b, mean)
                asked_ids += [query_id] * len(found)
                numbers.append(found)
                scores.append(values)
                blocks += [total] * len(found)
                scored += [done] * len(found)
            joined = np.concatenate(numbers) if numbers else np.zeros(0, np.int64)
            out = [pa.array(asked_ids, query_type), shard.ids.take(pa.array(joined, pa.int64())), pa.array(np.concatenate(scores) if scores else np.zeros(0)), pa.array(blocks, pa.int64()), pa.array(scored, pa.int64())]
            return pa.table(out, names=schema.names)

        return own.groupBy("shard").applyInArrow(run, schema)

    return in_query_blocks(queries, F.aggregate("terms", F.lit(8), lambda n, w: n + F.length(w) + 8), one)
