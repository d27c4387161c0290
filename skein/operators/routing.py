"""Classification and routing of queries (query_id, text)."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, IntegerType

from skein.functions.text import bigrams, space_tokens, words
from skein.session import bounded_batches, ensure_checkpoints

#: Words and phrases of each task.
TASK_KEYWORDS = {
    "debugging": ("error", "bug", "fix", "crash", "traceback", "exception", "fails", "broken", "issue", "wrong"),
    "code_review": ("review", "refactor", "clean", "improve", "quality", "smell", "readable"),
    "architecture": ("design", "pattern", "structure", "ddd", "hexagonal", "module", "architecture", "component"),
    "explanation": ("explain", "how", "why", "what is", "difference", "compare", "understand", "meaning"),
    "testing": ("test", "assert", "mock", "coverage", "pytest", "spec", "unit test", "integration test"),
    "devops": ("deploy", "docker", "kubernetes", "ci/cd", "pipeline", "terraform", "nginx", "container"),
    "ml_engineering": ("model", "training", "fine-tune", "embedding", "rag", "llm", "vector", "dataset"),
}
#: Depth, vector and graph weight, confidence, least and most hits, tokens, by task.
STRATEGIES = {
    "debugging": (2, 0.5, 0.5, 0.6, 2, 8, 1536),
    "code_review": (1, 0.7, 0.3, 0.7, 1, 5, 1024),
    "architecture": (3, 0.4, 0.6, 0.5, 2, 8, 1536),
    "explanation": (2, 0.6, 0.4, 0.8, 1, 4, 1024),
    "testing": (2, 0.6, 0.4, 0.7, 1, 5, 1024),
    "devops": (1, 0.7, 0.3, 0.6, 1, 6, 1024),
    "ml_engineering": (2, 0.5, 0.5, 0.6, 2, 8, 1536),
    "general": (2, 0.6, 0.4, 0.7, 1, 5, 768),
}
STRATEGY_FIELDS = ("graph_depth", "vector_weight", "graph_weight", "confidence", "min_k", "max_k", "max_tokens")
MAX_FEATURES, MAX_CLASSES, LEAST_CORPUS = 5000, 500, 50
#: Words that travel with the tasks while their pairs are counted; with more, pairs are counted by name.
KNOWN_WORDS = 100_000


def keyword_classes(queries: DataFrame, keywords: dict[str, tuple[str, ...]] = TASK_KEYWORDS) -> DataFrame:
    """(query_id, task, score): the class with the largest share of its keywords in the text; ties go to the first.

    A keyword of one word must be a token, a phrase a substring. Without any match the class is general at 0.
    """
    low, tokens = F.lower("text"), space_tokens(F.col("text"))
    score = {}
    for task, terms in keywords.items():
        hits = F.lit(0)
        for term in terms:
            hit = F.contains(low, F.lit(term)) if " " in term else F.array_contains("tokens", term)
            hits = hits + hit.cast("int")
        score[task] = hits / len(terms)
    scored = queries.withColumn("tokens", tokens).select("query_id", *(s.alias(f"s_{t}") for t, s in score.items()))
    best = F.greatest(*(F.col(f"s_{t}") for t in score))
    task = F.lit("general")
    for t in reversed(list(score)):
        task = F.when((F.col(f"s_{t}") == best) & (best > 0), F.lit(t)).otherwise(task)
    return scored.select("query_id", task.alias("task"), F.round(best, 6).alias("score"))


def strategies(classified: DataFrame, table: dict[str, tuple] = STRATEGIES) -> DataFrame:
    """`classified` with the retrieval strategy of its task; unknown tasks get the general one."""
    def field(no: int) -> Column:
        pairs = F.create_map(*(F.lit(x) for task, row in table.items() for x in (task, row[no])))
        return F.coalesce(pairs[F.col("task")], F.lit(table["general"][no]))

    return classified.select("*", *(field(i).alias(n) for i, n in enumerate(STRATEGY_FIELDS)))


def tokenised(rows: DataFrame, stop: tuple[str, ...] = ()) -> DataFrame:
    """(id, label, w) of (id, label, text), written down once: the words without stop words, in order."""
    ensure_checkpoints(rows.sparkSession)
    kept = words(F.col("text"))
    return rows.select("id", "label", (F.filter(kept, lambda w: ~w.isin(*stop)) if stop else kept).alias("w")).checkpoint()


def _numbered(batch: pa.RecordBatch, known: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(number in `known` or -1, row) of every word of (w) of a batch, in order."""
    held = batch.column("w")
    row = np.repeat(np.arange(batch.num_rows), pc.fill_null(pc.list_value_length(held), 0).to_numpy(zero_copy_only=False))
    return pc.fill_null(pc.index_in(held.flatten(), value_set=known), -1).to_numpy(zero_copy_only=False).astype(np.int64), row


def _neighbours(number: np.ndarray, row: np.ndarray, known: int) -> tuple[np.ndarray, np.ndarray]:
    """(first * known + second, row) of the neighbouring words of a row that both have a number."""
    both = np.flatnonzero((number[:-1] >= 0) & (number[1:] >= 0) & (row[:-1] == row[1:]))
    return number[both] * known + number[both + 1], row[both]


def _occurrences(term: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(term, times, rows that hold it) of the terms of a batch."""
    order = np.lexsort((row, term))
    term, row = term[order], row[order]
    new = np.diff(term, prepend=-1) != 0
    first = np.flatnonzero(new)
    return term[first], np.diff(first, append=len(term)), np.add.reduceat((new | (np.diff(row, prepend=-1) != 0)).astype(np.int64), first) if len(first) else first


def _summed(counts: DataFrame, *key: str) -> DataFrame:
    return counts.groupBy(*key).agg(F.sum("total").alias("total"), F.sum("df").alias("df"))


def word_totals(tokens: DataFrame) -> DataFrame:
    """(term, total, df) of the words of (w), counted in the tasks a batch at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rb in batches:
            known = pc.unique(rb.column("w").flatten())
            term, total, df = _occurrences(*_numbered(rb, known))
            yield pa.RecordBatch.from_arrays([known.take(pa.array(term)), pa.array(total, pa.int64()), pa.array(df, pa.int64())], names=["term", "total", "df"])

    return _summed(tokens.select("w").mapInArrow(run, "term string, total long, df long"), "term")


def pair_totals(tokens: DataFrame, known: list[str]) -> DataFrame:
    """(term, total, df) of the neighbouring pairs of (w) whose words are both among `known`."""
    words_of, size = pa.array(known, pa.string()), len(known)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rb in batches:
            pair, total, df = _occurrences(*_neighbours(*_numbered(rb, words_of), size))
            yield pa.RecordBatch.from_arrays([pa.array(pair), pa.array(total, pa.int64()), pa.array(df, pa.int64())], names=["pair", "total", "df"])

    sums = _summed(tokens.select("w").mapInArrow(run, "pair long, total long, df long"), "pair")
    names = tokens.sparkSession.createDataFrame(pa.table({"number": pa.array(range(size), pa.int64()), "name": words_of}))
    left, right = names.withColumnsRenamed({"number": "left", "name": "left_name"}), names.withColumnsRenamed({"number": "right", "name": "right_name"})
    numbered = sums.select(F.floor(F.col("pair") / F.lit(size)).cast("long").alias("left"), (F.col("pair") % F.lit(size)).alias("right"), "total", "df")
    spelled = numbered.join(F.broadcast(left), "left").join(F.broadcast(right), "right")
    return spelled.select(F.concat_ws(" ", "left_name", "right_name").alias("term"), "total", "df")


def vocabulary(tokens: DataFrame, max_features: int = MAX_FEATURES, known_words: int = KNOWN_WORDS) -> DataFrame:
    """(term, df) of the most frequent words and neighbouring pairs of (w); at most `max_features` rows.

    A pair is no more frequent than either of its words, and the term of rank `max_features` no less than the word of
    that rank. So only pairs of words that are as frequent as that word are counted. Where equal counts make these
    more than `known_words`, or words are too few, all pairs are.
    """
    ensure_checkpoints(tokens.sparkSession)
    totals = word_totals(tokens).checkpoint()
    top = totals.orderBy(F.desc("total"), "term").limit(max_features)
    last = top.agg(F.min("total").alias("least"), F.count("*").alias("n")).first()
    least = last["least"] if last["n"] == max_features and max_features > 0 else 0
    frequent = [r["term"] for r in totals.filter(F.col("total") >= least).select("term").limit(known_words + 1).toLocalIterator()]
    if len(frequent) > known_words:
        both = bigrams(F.col("w"))
        counted = F.concat(
            F.transform(both, lambda t: F.struct(t.alias("term"), F.lit(1).alias("total"), F.lit(0).alias("df"))),
            F.transform(F.array_distinct(both), lambda t: F.struct(t.alias("term"), F.lit(0).alias("total"), F.lit(1).alias("df"))),
        )
        pairs = _summed(tokens.select(F.inline(counted)), "term")
    else:
        pairs = pair_totals(tokens, frequent).filter(F.col("total") >= least)
    return top.unionByName(pairs).orderBy(F.desc("total"), "term").limit(max_features).select("term", "df")


def tfidf(tokens: DataFrame, max_features: int = MAX_FEATURES) -> DataFrame:
    """(id, label, terms, weights) of (id, label, w): unit vectors over the vocabulary, with smoothed idf.

    The vocabulary has at most `max_features` rows whatever the corpus, so it travels with the tasks and a document's
    vector is made where the document is. `terms` are numbers of the vocabulary, in rising order.
    """
    chosen = sorted(vocabulary(tokens, max_features).collect(), key=lambda r: r["term"])
    n = tokens.count()
    idf = np.array([np.log((1 + n) / (1 + r["df"])) + 1 for r in chosen])
    split = [r["term"].split(" ") for r in chosen]
    known = sorted({w for parts in split for w in parts})
    place = {w: i for i, w in enumerate(known)}
    # Single words follow the pairs: both are looked up as sorted numbers.
    code = np.array([place[p[0]] * len(known) + place[p[1]] if len(p) == 2 else len(known) ** 2 + place[p[0]] for p in split], np.int64)
    order = np.argsort(code)
    code = code[order]
    schema = tokens.select("id", "label").schema.add("terms", ArrayType(IntegerType())).add("weights", ArrayType(DoubleType()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words_of = pa.array(known, pa.string())
        for rb in batches:
            number, row = _numbered(rb, words_of)
            pair, pair_row = _neighbours(number, row, len(known))
            met, rows = np.concatenate([number[number >= 0] + len(known) ** 2, pair]), np.concatenate([row[number >= 0], pair_row])
            at = np.minimum(np.searchsorted(code, met), max(len(code) - 1, 0))
            held = code[at] == met if len(code) else np.zeros(0, bool)
            found, tf = np.unique(rows[held] * len(code) + order[at[held]], return_counts=True)
            rows, index = (found // len(code), found % len(code)) if len(code) else (found, found)
            w = tf * idf[index]
            w = w / np.sqrt(np.bincount(rows, w * w, rb.num_rows))[rows]
            bounds = pa.array(np.append(0, np.cumsum(np.bincount(rows, minlength=rb.num_rows))).astype(np.int32))
            yield pa.RecordBatch.from_arrays(
                [rb.column("id"), rb.column("label"), pa.ListArray.from_arrays(bounds, pa.array(index.astype(np.int32))), pa.ListArray.from_arrays(bounds, pa.array(w, pa.float64()))], names=schema.names
            )

    return tokens.mapInArrow(run, schema)


def centroid_classes(rows: DataFrame, max_features: int = MAX_FEATURES, stop: tuple[str, ...] = (), least: float = 0.3, least_corpus: int = LEAST_CORPUS) -> DataFrame:
    """(id, label, predicted, cosine): the class whose mean vector is nearest; null under `least`. Ties go by name.

    The centroids are `max_features` numbers for each class, a table whose size is checked before it travels with the
    tasks. Rows without a term of the vocabulary are left out; below `least_corpus` rows nothing is predicted.
    """
    bounded_batches(rows.sparkSession)
    tokens = tokenised(rows, stop)
    if tokens.count() < least_corpus:
        return rows.select("id", "label", F.col("label").alias("predicted"), F.lit(0.0).alias("cosine")).limit(0)
    vectors = tfidf(tokens, max_features).filter(F.size("terms") > 0).checkpoint()
    members = {r["label"]: r["n"] for r in rows.groupBy("label").agg(F.count("*").alias("n")).limit(MAX_CLASSES + 1).collect()}
    if len(members) > MAX_CLASSES:
        raise ValueError(f"more than {MAX_CLASSES} classes")
    names = sorted(members, key=lambda c: (c is not None, c))
    centroids = np.zeros((len(names), max_features))

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        whole = np.zeros((len(names), max_features))
        place = {c: i for i, c in enumerate(names)}
        for rb in batches:
            label = np.array([place[c] for c in rb.column("label").to_pylist()], np.int64)
            index = np.repeat(label, pc.list_value_length(rb.column("terms")).to_numpy()) * max_features + rb.column("terms").flatten().to_numpy()
            whole += np.bincount(index, rb.column("weights").flatten().to_numpy(), whole.size).reshape(whole.shape)
        at = np.flatnonzero(whole)
        for a in range(0, len(at), 100_000):
            part = at[a : a + 100_000]
            yield pa.RecordBatch.from_arrays([pa.array(part), pa.array(whole.ravel()[part])], names=["at", "w"])

    for r in vectors.select("label", "terms", "weights").mapInArrow(sums, "at long, w double").groupBy("at").agg(F.sum("w").alias("w")).toLocalIterator():
        centroids[r["at"] // max_features, r["at"] % max_features] = r["w"]
    centroids /= np.array([members[c] for c in names], float).reshape(-1, 1)
    length = np.sqrt((centroids * centroids).sum(axis=1))
    real = np.flatnonzero(length > 0)
    names_of, unit = [names[i] for i in real], centroids[real] / length[real, None]
    schema = vectors.select("id", "label", F.col("label").alias("predicted")).schema.add("cosine", "double")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rb in batches:
            index, w = rb.column("terms").flatten().to_numpy(), rb.column("weights").flatten().to_numpy()
            row = np.repeat(np.arange(rb.num_rows), pc.list_value_length(rb.column("terms")).to_numpy())
            cosines = np.round(np.array([np.bincount(row, own[index] * w, rb.num_rows) for own in unit]).reshape(len(names_of), rb.num_rows).T, 9)
            best = cosines.argmax(axis=1) if rb.num_rows else np.zeros(0, int)
            top = cosines.max(axis=1) if rb.num_rows else np.zeros(0)
            predicted = pa.array([names_of[b] if c >= least else None for b, c in zip(best, top, strict=True)], rb.schema.field("label").type)
            yield pa.RecordBatch.from_arrays([rb.column("id"), rb.column("label"), predicted, pa.array(top)], names=schema.names)

    return vectors.mapInArrow(run, schema).select("id", "label", "predicted", F.round("cosine", 6).alias("cosine"))


def gate(rows: DataFrame, always: tuple[str, ...] = ("debugging", "architecture", "code_review")) -> DataFrame:
    """(query_id, inject, confidence) of (query_id, task, n_entities, level, topic): votes for and against context.

    Some tasks always get context. Otherwise entities (if counted), competence, task and topic vote; equal votes inject.
    """
    entities, lev = F.col("n_entities"), F.col("level")
    yes = F.coalesce((entities > 0).cast("int"), F.lit(0)) + (lev != "Unknown").cast("int") + (F.col("task") != "general").cast("int") + F.col("topic").isNotNull().cast("int")
    total = F.when(entities.isNotNull(), 4).otherwise(3)
    no = total - yes
    forced = F.col("task").isin(*always)
    return rows.select("query_id", (forced | (yes >= no)).alias("inject"), F.when(forced, F.lit(1.0)).otherwise(F.round(F.abs(yes - no) / total, 3)).alias("confidence"))


def valid_pattern(pattern: str) -> bool:
    try:
        re.compile(pattern)
    except re.error:
        return False
    return True


def first_rule(queries: DataFrame, rules: list[tuple[str, str]], otherwise: str) -> DataFrame:
    """`queries` with `rule`: the name of the first (name, pattern) whose case-insensitive pattern is found in the text.

    A pattern that is no regular expression is dropped.
    """
    out = F.lit(otherwise)
    for name, pattern in reversed([r for r in rules if valid_pattern(r[1])]):
        out = F.when(F.col("text").rlike(f"(?i){pattern}"), F.lit(name)).otherwise(out)
    return queries.withColumn("rule", out)


def response_scores(rows: DataFrame, include: tuple[str, ...], exclude: tuple[str, ...], weights: tuple[float, float, float] = (0.5, 0.3, 0.2), ideal: int = 200) -> DataFrame:
    """`rows` with `score`: required terms, length against the ideal and clarity, less 0.2 for each forbidden term.

    Without required terms all of them are held. A null text counts as empty.
    """
    text = F.coalesce("text", F.lit(""))
    low = F.lower(text)
    count = lambda terms: F.size(F.filter(F.array(*map(F.lit, terms)).cast("array<string>"), lambda t: F.contains(low, t)))
    held = count(include) / len(include) if include else F.lit(1.0)
    n = F.length(text)
    complete = F.when(n < 0.3 * ideal, 0.3).when(n < 0.6 * ideal, 0.6).otherwise(F.least(F.lit(1.0), n / (1.5 * ideal)))
    clear = F.when(n < 50, 0.5).when(n > 2000, 0.7).otherwise(1.0)
    score = weights[0] * held + weights[1] * complete + weights[2] * clear - 0.2 * count(exclude)
    return rows.withColumn("score", F.round(F.greatest(F.lit(0.0), score), 3))


def response_report(scored: DataFrame, *dimensions: str) -> DataFrame:
    """(dimension values or nulls, n, mean_score, best, mean_latency): over all rows and by each dimension on its own."""
    return scored.groupingSets([[], *([F.col(d)] for d in dimensions)], *dimensions).agg(
        F.count("*").alias("n"), F.round(F.avg("score"), 4).alias("mean_score"), F.max("score").alias("best"), F.round(F.avg("latency"), 2).alias("mean_latency"), *(F.grouping(d).cast("long").alias(f"all_{d}") for d in dimensions)
    )


def detected_topics(queries: DataFrame, topics: DataFrame) -> DataFrame:
    """(query_id, topic, level): the first of (topic, score, level) by falling score whose lower-cased name is a token.

    Hyphens of the query part tokens, so a topic whose name holds a hyphen or a space is never found. Ties go by name.
    """
    tokens = F.array_distinct(space_tokens(F.replace("text", F.lit("-"), F.lit(" "))))
    asked = queries.select("query_id", F.explode(tokens).alias("token"))
    named = topics.select(F.lower("topic").alias("token"), "topic", "score", "level")
    order = F.struct((-F.col("score")).alias("s"), "topic")
    return asked.join(named, "token").groupBy("query_id").agg(F.min_by("topic", order).alias("topic"), F.min_by("level", order).alias("level"))


#: What each arm adds to the depth and to the vector and graph weights, and its full-text weight.
ARM_CHANGES = {
    "default": (0, 0.0, 0.0, 0.0),
    "graph_boost": (1, 0.0, 0.1, 0.0),
    "deep_graph": (2, 0.0, 0.2, 0.1),
    "vector_focus": (0, 0.1, -0.1, 0.0),
}


def cascaded(classified: DataFrame, arms: DataFrame, overrides: DataFrame, changes: dict[str, tuple] = ARM_CHANGES) -> DataFrame:
    """(query_id, task, topic, strategy fields, source): each task's strategy, changed by an arm, then by an override.

    `classified` has (query_id, task, topic), `arms` (context, arm) with context `task_topic`, or `task` without topic,
    `overrides` (key, any strategy fields) with key `task_topic` or `task`; the longer key wins, field by field.
    """
    rows = strategies(classified.select("query_id", "task", "topic"))
    context = F.when(F.col("topic").isNull(), F.col("task")).otherwise(F.concat_ws("_", "task", "topic"))
    rows = rows.withColumn("context", context).join(arms.select("context", "arm").distinct(), "context", "left")
    for no, field in enumerate(("graph_depth", "vector_weight", "graph_weight")):
        change = F.lit(0.0)
        for arm, own in changes.items():
            change = F.when(F.col("arm") == arm, F.lit(float(own[no]))).otherwise(change)
        moved = F.col(field).cast("double") + change
        rows = rows.withColumn(field, F.greatest(F.lit(1.0), moved) if no == 0 else F.greatest(F.lit(0.0), F.round(moved, 4)))
    rows = rows.select(*(F.col(c).cast("double").alias(c) if c in STRATEGY_FIELDS else F.col(c) for c in rows.columns))
    held = [c for c in STRATEGY_FIELDS if c in overrides.columns]
    for key, mark in (("context", "long"), ("task", "short")):
        own = overrides.select(F.col("key").alias(key), *(F.col(c).cast("double").alias(f"{mark}_{c}") for c in held), F.lit(1).alias(f"{mark}_found"))
        rows = rows.join(own, key, "left")
    source = F.when(F.col("long_found").isNotNull() | F.col("short_found").isNotNull(), "override").when(F.coalesce(F.col("arm"), F.lit("default")) != "default", "arm").otherwise("base")
    return rows.select(
        "query_id", "task", "topic",
        *((F.coalesce(f"long_{c}", f"short_{c}", c) if c in held else F.col(c)).alias(c) for c in STRATEGY_FIELDS),
        source.alias("source"),
    )


def routed(queries: DataFrame, learned: DataFrame, topics: DataFrame, keywords: dict[str, tuple[str, ...]] = TASK_KEYWORDS) -> DataFrame:
    """(query_id, task, how, topic, level): the learned class (query_id, predicted) if there is one, else the keyword class."""
    by_word = keyword_classes(queries, keywords)
    taught = learned.filter("predicted IS NOT NULL").groupBy("query_id").agg(F.min("predicted").alias("predicted"))
    found = by_word.join(taught, "query_id", "left").join(detected_topics(queries, topics), "query_id", "left")
    how = F.when(F.col("predicted").isNotNull(), "learned").when(F.col("score") > 0, "keyword").otherwise("fallback")
    return found.select("query_id", F.coalesce("predicted", "task").alias("task"), how.alias("how"), "topic", F.coalesce("level", F.lit("Unknown")).alias("level"))


def label_of(answer: Column, labels: tuple[str, ...], otherwise: str = "general") -> Column:
    """The label that a model's answer names: the answer itself if it is one, else the first of `labels` that it holds.

    White space around and case don't count; an answer that names none, or is null, is `otherwise`.
    """
    low = F.lower(F.regexp_replace(F.coalesce(answer, F.lit("")), r"^\s+|\s+$", ""))
    out = F.lit(otherwise)
    for name in reversed(labels):
        out = F.when(F.contains(low, F.lit(name.lower())), F.lit(name)).otherwise(out)
    for name in labels:
        out = F.when(low == name.lower(), F.lit(name)).otherwise(out)
    return out
