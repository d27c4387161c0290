"""Vector, keyword and fused retrieval for many queries at once.

Queries come as a table, so each operator is one plan for all of them. A table of queries is held against all rows of
the corpus in blocks: a block of queries has a bounded size and travels with the tasks, each task keeps its own best
rows, and only those meet in a shuffle. More queries than a block holds take one scan of the corpus a block.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skein.functions.scores import age_factor, similarity
from skein.functions.text import distinct_words
from skein.operators.keyword_index import KeywordIndex, build_index, search
from skein.session import ensure_checkpoints

RRF_K = 60
BM25_K1, BM25_B = 1.2, 0.75
MIN_K, MAX_K, CONFIDENCE, SIMILARITY_FLOOR = 1, 8, 0.7, 0.2
SIMILARITY_WEIGHT, COVERAGE_WEIGHT = 0.6, 0.4
RELEVANCE, RELEVANCE_CHARS = 0.12, 500
#: Bytes of queries that travel with the tasks at once.
BLOCK_BYTES = 16 << 20
#: Queries of a block that meet 4,096 rows in one product of matrices: 8 MB.
PART_QUERIES = 256
#: Words of two languages that say nothing about relevance.
STOP_WORDS = (
    "el", "la", "los", "las", "un", "una", "de", "del", "en", "con", "por", "para", "que", "es", "son", "este", "esta", "estos", "estas",
    "como", "qué", "cómo", "más", "código", "code",
    "the", "a", "an", "is", "are", "this", "that", "how", "what", "why", "and", "or", "to", "of", "in", "for", "with", "it", "do", "does",
    "has", "have", "not", "no", "si", "se", "su", "al", "lo", "le", "y", "o", "hay", "tiene",
)


def in_query_blocks(queries: DataFrame, size: Column, one: Callable[[list], DataFrame], block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The union of `one(rows)` over blocks of query rows of about `block_bytes`; each row of `queries` is in one block.

    One block is planned into the caller's query; of several, each one's result is written down before the next.
    """
    total = queries.agg(F.sum(size)).first()[0] or 0
    blocks = max(1, -(-int(total) // block_bytes))
    if blocks == 1:
        return one(list(queries.toLocalIterator()))
    ensure_checkpoints(queries.sparkSession)
    of_block = F.pmod(F.xxhash64("query_id"), F.lit(blocks))
    return reduce(DataFrame.unionByName, (one(list(queries.filter(of_block == b).toLocalIterator())).checkpoint() for b in range(blocks)))


def first_k(scored: DataFrame, k: int, *order: Column) -> DataFrame:
    """The first k rows of each query, with their rank from 1; tasks cut their own rows to k before the shuffle."""
    ranked = scored.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(*order)))
    return ranked.filter(F.col("rank") <= k).withColumn("rank", F.col("rank").cast("long"))


def _distances(q: np.ndarray, v: np.ndarray, metric: str) -> np.ndarray:
    """Exact distances of pairs of rows."""
    if metric == "l2":
        return np.sqrt(((q - v) ** 2).sum(axis=1))
    norms = np.sqrt((q * q).sum(axis=1)) * np.sqrt((v * v).sum(axis=1))
    return 1 - np.divide((q * v).sum(axis=1), norms, out=np.zeros(len(q)), where=norms > 0)


def _nearest_in_task(queries: list[tuple], names: list[str], k: int, metric: str, step: int = PART_QUERIES) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Over batches (names, v): for each query the k nearest rows of the task, ties by id."""
    by_length: dict[int, list[tuple]] = {}
    for i, q in queries:
        if q is not None and i is not None:
            by_length.setdefault(len(q), []).append((i, q))
    tables = {n: (np.array([i for i, _ in own]), np.array([q for _, q in own], np.float64)) for n, own in by_length.items()}

    def cut(found: list[tuple]) -> tuple:
        query, id_, distance, at = (np.concatenate(x) for x in zip(*[f[:4] for f in found], strict=True))
        order = np.lexsort((id_, distance, query))
        query = query[order]
        rank = np.arange(len(query)) - np.searchsorted(query, query)
        keep = order[rank < k]
        rows = pa.Table.from_batches([f[4] for f in found])
        offsets = np.cumsum([0, *(f[4].num_rows for f in found)])
        place = np.concatenate([f[3] + o for f, o in zip(found, offsets, strict=False)])[keep]
        taken = rows.take(pa.array(place)).combine_chunks().to_batches()
        whole = taken[0] if taken else rows.schema.empty_table().to_batches()[0]
        return np.concatenate([f[0] for f in found])[keep], id_[keep], distance[keep], np.arange(len(keep)), whole

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: list[tuple] = []
        for whole in batches:
            for first in range(0, whole.num_rows, 4096):
                rb = whole.slice(first, 4096)
                lists, ids = rb.column("v").to_pylist(), rb.column("id").to_numpy(zero_copy_only=False)
                carried = rb.select(names)
                lengths = np.array([len(x) if x is not None else -1 for x in lists])
                for n, (query_ids, q) in tables.items():
                    own = np.flatnonzero(lengths == n)
                    if not len(own):
                        continue
                    v = np.array([lists[i] for i in own], np.float64)
                    hits = []
                    # A part of the queries at a time, so that a product's size does not grow with them.
                    for of in range(0, len(q), step):
                        part, asked = q[of : of + step], query_ids[of : of + step]
                        if metric == "l2":
                            near = (part * part).sum(axis=1)[:, None] + (v * v).sum(axis=1) - 2 * part @ v.T
                        else:
                            lq, lv = np.linalg.norm(part, axis=1, keepdims=True), np.linalg.norm(v, axis=1, keepdims=True)
                            near = -np.divide(part, lq, out=np.zeros_like(part), where=lq > 0) @ np.divide(v, lv, out=np.zeros_like(v), where=lv > 0).T
                        near[asked[:, None] == ids[own]] = np.inf
                        # Matrix products are rounded, so a little more than the k nearest is worked out exactly.
                        border = np.partition(near, min(k, near.shape[1]) - 1, axis=1)[:, [min(k, near.shape[1]) - 1]]
                        i, j = np.nonzero((near <= border + 1e-6 * np.maximum(1, np.abs(border))) & np.isfinite(near))
                        hits.append((asked[i], j, np.round(_distances(part[i], v[j], metric), 9)))
                    query, j, distance = (np.concatenate(x) for x in zip(*hits, strict=True))
                    found.append((query, ids[own[j]], distance, own[j], carried))
                if len(found) > 16:
                    found = [cut(found)]
        if found:
            query, _, distance, at, rows = cut(found)
            rows = rows.take(pa.array(at))
            yield pa.RecordBatch.from_arrays([pa.array(query), *rows.columns, pa.array(distance)], names=["query_id", *names, "distance"])

    return run


def vector_top_k(queries: DataFrame, corpus: DataFrame, k: int = 10, metric: str = "l2", prefilter: Column | None = None, postfilter: Column | None = None) -> DataFrame:
    """(query_id, id, …, distance, rank): the k nearest rows of each query; lower is nearer, ties go by id.

    `queries` has (query_id, q), `corpus` (id, v, …), ids being numbers. A prefilter restricts the corpus, a postfilter
    the k rows found. A row is no neighbour of a query with its own id; null vectors and vectors of another length are
    none either, and a zero vector has cosine distance 1.
    """
    rows = corpus.filter(prefilter) if prefilter is not None else corpus
    names = ["id", *(c for c in corpus.columns if c not in ("id", "v"))]
    schema = queries.select("query_id").schema
    for field in corpus.select(*names).schema:
        schema = schema.add(field)
    schema = schema.add("distance", "double")

    def one(block: list) -> DataFrame:
        return rows.select(*names, "v").mapInArrow(_nearest_in_task([(r["query_id"], r["q"]) for r in block], names, k, metric), schema)

    found = in_query_blocks(queries.select("query_id", "q"), F.lit(8) + 8 * F.coalesce(F.size("q"), F.lit(0)), one)
    top = first_k(found, k, F.asc("distance"), F.asc("id"))
    return top.filter(postfilter) if postfilter is not None else top


def adaptive_stop(hits: DataFrame, confidence: float = CONFIDENCE, min_k: int = MIN_K, max_k: int = MAX_K, floor: float = SIMILARITY_FLOOR, entities: DataFrame | None = None, texts: DataFrame | None = None) -> DataFrame:
    """(query_id, stop_rank, reason, confidence, n_hits) of ranked hits (query_id, id, distance, rank).

    Hits under the similarity floor are no hits. The confidence at a rank is the mean similarity so far; with
    `entities` (query_id, entity) and `texts` (id, text) it is 0.6 of that and 0.4 of the share of the query's entities
    that the texts so far hold in any case. The first rank from `min_k` on that reaches the threshold is where
    retrieval stops, else it goes to `max_k`. A query without entities goes by similarity alone.
    """
    kept = hits.withColumn("sim", similarity(F.col("distance"))).filter(F.col("sim") >= floor).filter(F.col("rank") <= max_k)
    so_far = Window.partitionBy("query_id").orderBy("rank").rowsBetween(Window.unboundedPreceding, 0)
    running = kept.withColumn("conf", F.avg("sim").over(so_far))
    if entities is not None:
        wanted = entities.select("query_id", F.lower("entity").alias("entity")).distinct()
        counts = wanted.groupBy("query_id").agg(F.count("*").alias("n_entities"))
        held = kept.select("query_id", "id", "rank").join(wanted, "query_id").join(texts, "id").filter(F.contains(F.lower("text"), F.col("entity")))
        new = held.groupBy("query_id", "entity").agg(F.min("rank").alias("rank")).groupBy("query_id", "rank").agg(F.count("*").alias("new"))
        running = running.join(counts, "query_id", "left").join(new, ["query_id", "rank"], "left")
        coverage = F.sum(F.coalesce("new", F.lit(0))).over(so_far) / F.col("n_entities")
        running = running.withColumn("conf", F.when(F.col("n_entities").isNull(), F.col("conf")).otherwise(SIMILARITY_WEIGHT * F.col("conf") + COVERAGE_WEIGHT * coverage))
    enough = F.when((F.col("rank") >= min_k) & (F.col("conf") >= confidence), F.col("rank"))
    stops = running.groupBy("query_id").agg(F.min(enough).alias("stop"), F.max("rank").alias("last"), F.min_by("conf", F.when(enough.isNotNull(), F.col("rank"))).alias("at_stop"), F.max_by("conf", "rank").alias("at_last"), F.count("*").alias("n_hits"))
    every = hits.select("query_id").distinct().join(stops, "query_id", "left")
    return every.select(
        "query_id",
        F.coalesce("stop", "last", F.lit(0)).cast("long").alias("stop_rank"),
        F.when(F.col("stop").isNotNull(), "threshold").when(F.col("last").isNotNull(), "max_k").otherwise("no_results").alias("reason"),
        F.coalesce(F.when(F.col("stop").isNotNull(), F.col("at_stop")).otherwise(F.col("at_last")), F.lit(0.0)).alias("confidence"),
        F.coalesce("n_hits", F.lit(0)).cast("long").alias("n_hits"),
    )


def bm25_top_k(queries: DataFrame, docs: DataFrame | None, k: int = 10, k1: float = BM25_K1, b: float = BM25_B, index: KeywordIndex | None = None) -> DataFrame:
    """(query_id, id, bm25, rank, score): documents that share a term with the query; score is 1 / (1 + rank from 0).

    `queries` has (query_id, text). The search goes over `index`, or over one that is built of `docs` (id, text). It
    is exact: what it skips can't be among the first k.
    """
    index = index or build_index(docs)
    scored = search(queries.select("query_id", distinct_words(F.col("text")).alias("terms")).filter(F.size("terms") > 0), index, k, k1, b)
    top = first_k(scored.select("query_id", "id", F.round("score", 6).alias("bm25")), k, F.desc("bm25"), F.asc("id"))
    return top.withColumn("score", 1.0 / F.col("rank"))


def fuse(lists: dict[str, tuple[DataFrame, float]], limit: int = 10, k: int = RRF_K) -> DataFrame:
    """(query_id, id, score, origin, n_sources, rank): reciprocal-rank fusion of ranked lists (query_id, id, rank from 1).

    A list of weight 0 takes no part; an id that one list holds twice counts twice; the first list names the origin
    of an id that only it holds. Without any list of a positive weight there are no rows.
    """
    if all(weight <= 0 for _, weight in lists.values()):
        lists = {name: (hits.limit(0), 1.0) for name, (hits, _) in lists.items()}
    parts = None
    for no, (name, (hits, weight)) in enumerate(lists.items()):
        if weight <= 0:
            continue
        part = hits.select("query_id", "id", F.lit(no).alias("no"), F.lit(name).alias("source"), (weight / (k + F.col("rank") - 1)).alias("part"), F.col("rank").alias("in_list"))
        parts = part if parts is None else parts.unionByName(part)
    grouped = parts.groupBy("query_id", "id").agg(F.round(F.sum("part"), 9).alias("score"), F.count_distinct("source").alias("n_sources"), F.min_by("source", F.struct("no", "in_list")).alias("first_source"))
    named = grouped.select("query_id", "id", "score", F.when(F.col("n_sources") > 1, "hybrid").otherwise(F.col("first_source")).alias("origin"), "n_sources")
    return first_k(named, limit, F.desc("score"), F.asc("id"))


def aged(hits: DataFrame, days: Column, score: str = "score", half: float = 90.0, floor: float = 0.3) -> DataFrame:
    """`hits` with score_raw and age_factor (3 places), the score multiplied by the factor."""
    factor = age_factor(days, half, floor)
    return hits.withColumn("score_raw", F.col(score)).withColumn("age_factor", F.round(factor, 3)).withColumn(score, F.col(score) * factor)


def relevance(query: Column, text: Column, stop: tuple[str, ...] = STOP_WORDS, chars: int = RELEVANCE_CHARS) -> Column:
    """The share of the query's words without stop words that the text's first `chars` hold: 1 without query words, 0 without text words."""
    q, t = distinct_words(query, stop), distinct_words(F.substring(text, 1, chars), stop)
    return F.when(F.size(q) == 0, F.lit(1.0)).when(F.size(t) == 0, F.lit(0.0)).otherwise(F.size(F.array_intersect(q, t)) / F.size(q))


def relevant(queries: DataFrame, docs: DataFrame, least: float = RELEVANCE, stop: tuple[str, ...] = STOP_WORDS, chars: int = RELEVANCE_CHARS) -> DataFrame:
    """(query_id, id, relevance): pairs at or over `least`, which is over 0, of (query_id, text) and (id, text).

    Each document meets a block of queries in the task that read it: its words name the queries that hold them, and
    only pairs that pass go on. Queries without words match everything and are left to the caller.
    """
    if least <= 0:
        raise ValueError("with a least relevance of 0 every pair passes")
    asked = queries.select("query_id", distinct_words(F.col("text"), stop).alias("w")).filter(F.size("w") > 0)
    schema = queries.select("query_id").schema.add(docs.select("id").schema["id"]).add("relevance", "double")
    read = docs.select("id", distinct_words(F.substring("text", 1, chars), stop).alias("w"))

    def one(block: list) -> DataFrame:
        ids, sizes = [r["query_id"] for r in block], np.array([len(r["w"]) for r in block])
        by_word: dict[str, list[int]] = {}
        for i, r in enumerate(block):
            for w in r["w"]:
                by_word.setdefault(w, []).append(i)
        places = {w: np.array(own) for w, own in by_word.items()}
        id_type = pa.array(ids[:1]).type if ids else pa.int64()

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for rb in batches:
                left, right, shares = [], [], []
                for d, held in enumerate(rb.column("w").to_pylist()):
                    own = [places[w] for w in held or () if w in places]
                    if own:
                        some, counts = np.unique(np.concatenate(own), return_counts=True)
                        share = counts / sizes[some]
                        hit = share >= least
                        left += some[hit].tolist()
                        right += [d] * int(hit.sum())
                        shares += share[hit].tolist()
                out = [pa.array([ids[i] for i in left], id_type), rb.column("id").take(pa.array(right, pa.int64())), pa.array(shares, pa.float64())]
                yield pa.RecordBatch.from_arrays(out, names=["query_id", "id", "relevance"])

        return read.mapInArrow(run, schema)

    return in_query_blocks(asked, F.aggregate("w", F.lit(8), lambda n, w: n + F.length(w) + 8), one)


def graph_guided(seeds: DataFrame, expanded: DataFrame, docs: DataFrame, limit: int = 10, hits: int = 3, index: KeywordIndex | None = None) -> DataFrame:
    """(query_id, id, rank): documents found by a query's expansion texts, then by its seeds' names.

    `seeds` has (query_id, name, at), `expanded` (query_id, expansion, no), `docs` (id, text). Each text brings its
    first `hits` documents by keywords, over `index` if there is one; of documents with the same first 100 characters
    the first one stays.
    """
    asked = expanded.select("query_id", F.lit(0).alias("phase"), "no", F.col("expansion").alias("text"))
    asked = asked.unionByName(seeds.select("query_id", F.lit(1).alias("phase"), F.col("at").alias("no"), F.col("name").alias("text")))
    # A text that several queries share is searched once.
    found = bm25_top_k(asked.select(F.col("text").alias("query_id"), "text").distinct(), docs, hits, index=index).select(F.col("query_id").alias("text"), "id", F.col("rank").alias("hit"))
    keyed = asked.join(found, "text").join(docs.select("id", F.substring("text", 1, 100).alias("start")), "id")
    order = F.struct("phase", "no", "text", "hit", "id")
    once = keyed.groupBy("query_id", "start").agg(F.min(order).alias("ord"))
    return first_k(once.select("query_id", "ord.id", "ord"), limit, F.asc("ord")).select("query_id", "id", "rank")


def hybrid(queries: DataFrame, docs: DataFrame, lists: dict[str, tuple[DataFrame, float]], days: Column, limit: int = 10, least: float = RELEVANCE) -> DataFrame:
    """(query_id, id, origin, score, score_raw, age_factor, relevance, query, text, rank) of the fused lists.

    `docs` has (id, text) and what `days` reads. The fused hits are aged, ordered anew and filtered by relevance, so
    fewer than `limit` may remain; a `least` of 0 keeps all.
    """
    fused = fuse(lists, limit).drop("rank", "n_sources")
    dated = fused.join(docs, "id").join(queries.select("query_id", F.col("text").alias("query")), "query_id")
    scored = aged(dated, days).withColumn("relevance", relevance(F.col("query"), F.col("text")))
    kept = scored.filter(F.col("relevance") >= least) if least > 0 else scored
    return first_k(kept, limit, F.desc(F.round("score", 9)), F.asc("id"))


def context_prompts(queries: DataFrame, hits: DataFrame, limit: int = 3, chars: int = 300, paths: DataFrame | None = None) -> DataFrame:
    """(query_id, prompt): each query's first hits (query_id, category, origin, text, rank) and known paths around its text.

    A query without hits is its own prompt.
    """
    part = F.concat(F.lit("["), "category", F.lit("|"), "origin", F.lit("] "), F.substring("text", 1, chars))
    listed = hits.filter(F.col("rank") <= limit).groupBy("query_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", part.alias("p")))), lambda x: x["p"]).alias("parts"))
    every = queries.select("query_id", F.col("text").alias("query")).join(listed, "query_id", "left")
    parts = F.col("parts")
    if paths is not None:
        known = paths.groupBy("query_id").agg(F.array_sort(F.collect_list("path")).alias("paths"))
        every = every.join(known, "query_id", "left")
        parts = F.when(F.size("paths") > 0, F.concat(parts, F.array(F.concat(F.lit("\nKnown relations:\n- "), F.array_join("paths", "\n- "))))).otherwise(parts)
    prompt = F.concat(F.lit("Context:\n"), F.array_join(parts, "\n---\n"), F.lit("\n\n---\nQuestion: "), "query", F.lit("\n\nAnswer from the context where it is relevant."))
    return every.select("query_id", F.when(F.col("parts").isNull(), F.col("query")).otherwise(prompt).alias("prompt"))
