"""Language-model scores by a Brown class bigram model.

Training words are counted over all training texts. Exchange clustering moves the most frequent words between classes
while the likelihood of the class bigrams rises; in its input, one matrix of bigram counts, all other words are one
node. Then every other repeated word makes its own exchange step on Spark: over all training texts the
classes of its neighbours are counted, and it joins the class under which they are likeliest. Words seen once stand for
unknown words, as one more class. Class bigrams are counted over all training texts with every word in its class. A
text's probability is the product, over its tokens and a final end, of class-transition and word-emission probabilities.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from math import log10

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType

from skein.llm.common import bounded_batches, cut_lineage
from skein.llm.text import hand_back, per_text, text_slices

#: Words that seed the classes by full exchange, and the number of classes.
EXCHANGE_WORDS, CLASSES = 1500, 48
#: Words, and the longest of them, whose class and counts travel with the tasks; all others meet theirs in a join, to the same scores.
TABLE_WORDS, TABLE_BYTES = 200_000, 64
PASSES = 5
_FLUSH = 200_000
#: In a text's classes: a word that is not in the table.
_OUTSIDE = 255
END = b""  # no word is empty
#: Classes beside a word, as a task hands them on: all of a word in one value, so that the word itself is moved once.
PACKED = np.dtype([("slot", "<u2"), ("n", "<u4")])


def tokens_of(text: bytes) -> list[bytes]:
    return text.lower().split()


def word_counts(docs: DataFrame) -> DataFrame:
    """(word, c) of the texts of `docs` (text as bytes), with one END for each; partial counts are summed in the tasks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(list(seen.keys()), pa.binary()), pa.array(list(seen.values()), pa.int64())], names=["word", "n"])

        for _, texts in text_slices(batches):
            seen[END] += len(texts)
            for text in texts:
                seen.update(tokens_of(text))
            if len(seen) > _FLUSH:
                yield out()
                seen.clear()
        if seen:
            yield out()

    return docs.select("text").mapInArrow(run, "word binary, n long").groupBy("word").agg(F.sum("n").alias("c"))


@dataclass
class Vocabulary:
    """What the driver and tasks hold of the vocabulary: totals, and the most frequent words beside the end."""

    tokens: int
    distinct: int
    once: int
    twice: int
    least: int
    words: list[bytes]
    counts: np.ndarray


def in_table(least: int) -> Column:
    return (F.col("c") >= least) & (F.octet_length("word") <= TABLE_BYTES)


def summarise(vocabulary: DataFrame, table_words: int = TABLE_WORDS) -> Vocabulary:
    """Totals and the table of frequent words; the cut is a count, taken from how many words have each count."""
    spectrum = {r["c"]: r["n"] for r in vocabulary.groupBy("c").agg(F.count("*").alias("n")).toLocalIterator()}
    least, room = max(spectrum, default=1) + 1, table_words
    for c in sorted(spectrum, reverse=True):
        room -= spectrum[c]
        if room < 0 or c < 2:
            break
        least = c
    # The end is scored from the table alone, so it is there whatever its count.
    rows = vocabulary.filter(in_table(least) | (F.col("word") == F.lit(END))).select("word", "c").toArrow().sort_by([("c", "descending"), ("word", "ascending")])
    return Vocabulary(
        sum(c * n for c, n in spectrum.items()), sum(spectrum.values()), spectrum.get(1, 0), spectrum.get(2, 0), least,
        rows.column("word").to_pylist(), rows.column("c").to_numpy(),
    )


def seed_words(vocab: Vocabulary, exchange_words: int) -> list[bytes]:
    """The most frequent words of the table beside the end, `exchange_words` at most."""
    return [w for w in vocab.words if w != END][:exchange_words]


def bigram_matrix(docs: DataFrame, words: list[bytes]) -> np.ndarray:
    """Counts of neighbours over all texts: 0 is the end, which stands before the first token too, then `words`, then all others."""
    n_nodes = len(words) + 2

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node = {w: i + 1 for i, w in enumerate(words)}
        get, other = node.get, n_nodes - 1
        sums = np.zeros(n_nodes * n_nodes, np.int64)
        for _, texts in text_slices(batches):
            ids = [0]
            for text in texts:
                ids += [get(w, other) for w in tokens_of(text)]
                ids.append(0)
            row = np.array(ids, np.int64)
            pairs, n = np.unique(row[:-1] * n_nodes + row[1:], return_counts=True)
            sums[pairs] += n
        pairs = np.flatnonzero(sums)
        for a in range(0, len(pairs), 100_000):
            own = pairs[a : a + 100_000]
            yield pa.RecordBatch.from_arrays([pa.array(own, pa.int64()), pa.array(sums[own], pa.int64())], names=["pair", "n"])

    rows = docs.select("text").mapInArrow(run, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(n_nodes * n_nodes, np.float64)
    out[rows.column("pair").to_numpy()] = rows.column("n").to_numpy()
    return out.reshape(n_nodes, n_nodes)


def _xlogx(x: np.ndarray) -> np.ndarray:
    return x * np.log(np.maximum(x, 1))


def exchange(pairs: np.ndarray, movable: int, classes: int = CLASSES, passes: int = PASSES) -> np.ndarray:
    """The class of each node: nodes 1 to `movable` share `classes` classes, every other node is a class of its own.

    Nodes are visited in order and move to the class that raises the class-bigram likelihood most, for up to `passes`
    rounds or until none moves; ties go to the lower class.
    """
    n = len(pairs)
    classes = max(1, min(classes, movable))
    own = np.concatenate([[0], np.arange(movable) % classes + 1, np.arange(n - movable - 1) + classes + 1]).astype(np.int64)
    k = int(own.max()) + 1
    one = np.zeros((n, k))
    one[np.arange(n), own] = 1
    out_of, into = pairs @ one, pairs.T @ one
    between = one.T @ out_of
    total = (pairs.sum(axis=0) + pairs.sum(axis=1)) / 2
    size = one.T @ total
    home = np.arange(1, classes + 1)
    for _ in range(passes):
        moved = 0
        for w in range(1, movable + 1):
            a, self_count = own[w], pairs[w, w]
            if not total[w]:
                continue
            right, left = out_of[w].copy(), into[w].copy()
            right[a] -= self_count
            left[a] -= self_count
            between[a] -= right
            between[:, a] -= left
            between[a, a] -= self_count
            size[a] -= total[w]
            rows, cols = between[home], between[:, home].T
            gain = (_xlogx(rows + right) - _xlogx(rows)).sum(axis=1) + (_xlogx(cols + left) - _xlogx(cols)).sum(axis=1)
            both = between[home, home]
            gain += _xlogx(both + right[home] + left[home] + self_count) - _xlogx(both + right[home]) - _xlogx(both + left[home]) + _xlogx(both)
            gain -= 2 * (_xlogx(size[home] + total[w]) - _xlogx(size[home]))
            b = int(home[np.argmax(gain)]) if gain.max() > gain[a - 1] + 1e-9 else a
            between[b] += right
            between[:, b] += left
            between[b, b] += self_count
            size[b] += total[w]
            if b != a:
                own[w], moved = b, moved + 1
                out_of[:, a] -= pairs[:, w]
                out_of[:, b] += pairs[:, w]
                into[:, a] -= pairs[w]
                into[:, b] += pairs[w]
        if not moved:
            break
    return own


@dataclass
class Seeds:
    """The classes of the seed words (the end has class 0), and how likely their neighbours make each class.

    `left[l, b]` is the log probability that class l stands before a word of class b, `right[r, b]` that r follows it.
    """

    class_of: dict[bytes, int]
    left: np.ndarray
    right: np.ndarray
    size: np.ndarray


def seed_classes(docs: DataFrame, vocab: Vocabulary, exchange_words: int, classes: int) -> Seeds:
    """Full exchange among the most frequent words of `docs` (text as bytes)."""
    words = seed_words(vocab, exchange_words)
    pairs = bigram_matrix(docs, words)
    own = exchange(pairs, len(words), classes)[: len(words) + 1]
    one = np.zeros((len(own), max(1, min(classes, len(words))) + 1))
    one[np.arange(len(own)), own] = 1
    between = one.T @ pairs[: len(own), : len(own)] @ one + 0.5
    class_of = {END: 0} | {w: int(c) for w, c in zip(words, own[1:], strict=True)}
    return Seeds(class_of, np.log(between / between.sum(axis=0)), np.log(between.T / between.sum(axis=1)), between.sum(axis=0))


def neighbour_classes(docs: DataFrame, seeds: Seeds) -> DataFrame:
    """(word, found) of the words that are no seeds: class c before the word is slot c, class c after it slot k + c.

    `found` holds the slots of a word and their counts as `PACKED`; a task gives a word once for each part of its texts.
    """
    class_of, k = seeds.class_of, len(seeds.size)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, words, counted = dict(class_of), [], []

        def out() -> Iterator[pa.RecordBatch]:
            codes, place = np.unique(np.concatenate([c for c, _ in counted]), return_inverse=True)
            packed = np.empty(len(codes), PACKED)
            packed["slot"], packed["n"] = codes % (2 * k), np.bincount(place, np.concatenate([n for _, n in counted]))
            number, first = np.unique(codes // (2 * k), return_index=True)
            bounds = np.append(first, len(codes))
            for a in range(0, len(number), 100_000):
                part, cuts = number[a : a + 100_000], bounds[a : a + 100_001]
                held = [None, pa.py_buffer(((cuts - cuts[0]) * PACKED.itemsize).astype(np.int32)), pa.py_buffer(packed[cuts[0] : cuts[-1]].tobytes())]
                yield pa.RecordBatch.from_arrays([pa.array([words[i] for i in part.tolist()], pa.binary()), pa.Array.from_buffers(pa.binary(), len(part), held)], names=["word", "found"])

        for _, texts in text_slices(batches):
            ids = [0]
            for text in texts:
                for w in tokens_of(text):
                    i = own.get(w)
                    if i is None:
                        own[w] = i = k + len(words)
                        words.append(w)
                    ids.append(i)
                ids.append(0)
            row = np.array(ids, np.int64)
            here, before = np.flatnonzero((row[1:] >= k) & (row[:-1] < k)) + 1, np.flatnonzero((row[:-1] >= k) & (row[1:] < k))
            codes = np.concatenate([(row[here] - k) * 2 * k + row[here - 1], (row[before] - k) * 2 * k + k + row[before + 1]])
            counted.append(np.unique(codes, return_counts=True))
            if len(words) > _FLUSH or len(counted) > 50:
                yield from out()
                own, words, counted = dict(class_of), [], []
        if counted:
            yield from out()

    return docs.select("text").mapInArrow(run, "word binary, found binary")


def likeliest_class(seeds: Seeds) -> Callable[[Column], Column]:
    """From an array of `PACKED` counts to the class, 1 and up, under which a word's neighbours are likeliest; ties go to the lowest."""
    weight = np.concatenate([seeds.left, seeds.right])[:, 1:]
    bias = 1e-6 * np.log(seeds.size[1:])

    @F.arrow_udf("int")
    def chosen(arrays: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for found in arrays:
            held = [b"".join(x) if x is not None else b"" for x in found.to_pylist()]
            pairs = np.frombuffer(b"".join(held), PACKED)
            rows = np.repeat(np.arange(len(found)), [len(x) // PACKED.itemsize for x in held])
            counts = np.bincount(rows * len(weight) + pairs["slot"], pairs["n"], len(found) * len(weight)).reshape(len(found), len(weight))
            score = counts @ weight + bias
            yield pa.array((score.argmax(axis=1) + 1 if weight.shape[1] else np.ones(len(found))).astype(np.int32))

    return chosen


def classed_words(docs: DataFrame, vocabulary: DataFrame, seeds: Seeds) -> DataFrame:
    """(word, c, class) of every word: seeds keep theirs, repeated words take the likeliest, words seen once are class k."""
    k = len(seeds.size)
    of_seed = docs.sparkSession.createDataFrame(list(seeds.class_of.items()), "word binary, seed int")  # EXCHANGE_WORDS rows at most
    seen = neighbour_classes(docs, seeds).groupBy("word").agg(F.collect_list("found").alias("found"))
    every = vocabulary.join(F.broadcast(of_seed), "word", "left")
    known = every.filter("seed IS NOT NULL OR c = 1").select("word", "c", F.coalesce("seed", F.lit(k)).alias("class"))
    rest = every.filter("seed IS NULL AND c > 1").join(seen, "word", "left")
    return known.unionByName(rest.select("word", "c", likeliest_class(seeds)("found").alias("class")))


@dataclass
class Table:
    """Of the most frequent words: numbers, counts and classes; of all classes, the last for words seen once: total counts."""

    words: list[bytes]
    counts: np.ndarray
    classes: np.ndarray
    totals: np.ndarray
    discount: float

    @property
    def unknown(self) -> float:
        """The share of its class that an unknown word has; all of it if no word was seen once."""
        return self.discount if self.totals[-1] else 1.0

    def emission(self) -> np.ndarray:
        single = np.where(self.classes == len(self.totals) - 1, self.discount, 0.0)
        return np.log10((self.counts - single) / self.totals[self.classes])


def word_table(classed: DataFrame, vocab: Vocabulary, classes: int) -> Table:
    rows = classed.filter(in_table(vocab.least) | (F.col("word") == F.lit(END))).select("word", "c", "class").toArrow()
    totals = np.zeros(classes)
    for r in classed.groupBy("class").agg(F.sum("c").alias("n")).collect():
        totals[r["class"]] = r["n"]
    discount = vocab.once / (vocab.once + 2 * vocab.twice) if 0 < vocab.once < vocab.once + vocab.twice else 0.5
    return Table(rows.column("word").to_pylist(), rows.column("c").to_numpy(), rows.column("class").to_numpy().astype(np.int64), totals, discount)


def in_classes(texts: DataFrame, table: Table) -> DataFrame:
    """`texts` (doc_id, learn, text as bytes) with row_id, n_tokens, n_known, base, own, classes, at and others in place of the text.

    `classes` has a byte for each token and the end, _OUTSIDE for a word that the table lacks; `others` are those
    words, each once, with their frequency, and `at` says for each place which of them it is.
    """
    words, counts, classes, emission = table.words, table.counts, table.classes, table.emission()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = {w: i for i, w in enumerate(words)}
        get, outside, end = index.get, len(words), index.get(END, len(words))
        base_of, emission_of = np.append(np.log10(counts + 1), 0.0), np.append(emission, 0.0)
        class_of = np.append(classes, _OUTSIDE).astype(np.uint8)
        row_id = (TaskContext.get().partitionId() if TaskContext.get() else 0) << 40
        for rows, texts in text_slices(batches):
            listed = [tokens_of(t) for t in texts]
            ids = np.array([get(w, outside) for own in listed for w in [*own, END]], np.int64)
            sizes = np.array([len(own) + 1 for own in listed], np.int64)
            stops = np.cumsum(sizes)
            ids[stops - 1] = end
            doc = np.repeat(np.arange(len(texts)), sizes)
            codes = class_of[ids]
            codes[stops - 1] = 0
            per_doc = lambda values: np.bincount(doc, values, len(texts))  # noqa: E731, B023
            names, numbers, times, bounds, at = [], [], [], [0], []
            for own, first, stop in zip(listed, (stops - sizes).tolist(), stops.tolist(), strict=True):
                number: dict[bytes, int] = {}
                place = np.array([number.setdefault(own[i], len(number)) for i in np.flatnonzero(ids[first : stop - 1] == outside).tolist()], np.int32)
                at.append(place.tobytes())
                names += number
                numbers += range(len(number))
                times += np.bincount(place, minlength=len(number)).tolist()
                bounds.append(len(names))
            other = pa.StructArray.from_arrays([pa.array(numbers, pa.int32()), pa.array(names, pa.binary()), pa.array(times, pa.int64())], names=["k", "word", "m"])
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(range(row_id, row_id + len(texts)), pa.int64()), rows.column("doc_id"), rows.column("learn"), pa.array(sizes),
                    pa.array(per_doc(ids != outside).astype(np.int64)), pa.array(per_doc(base_of[ids])), pa.array(per_doc(emission_of[ids])),
                    pa.array([codes[a:b].tobytes() for a, b in zip(stops - sizes, stops, strict=True)], pa.binary()), pa.array(at, pa.binary()),
                    pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), other),
                ],
                names=["row_id", "doc_id", "learn", "n_tokens", "n_known", "base", "own", "classes", "at", "others"],
            )
            row_id += len(texts)
        hand_back()

    fields = "n_tokens long, n_known long, base double, own double, classes binary, at binary, others array<struct<k:int,word:binary,m:bigint>>"
    id_type = texts.select("doc_id").schema[0].dataType.simpleString()
    return texts.select("doc_id", "learn", "text").mapInArrow(run, f"row_id long, doc_id {id_type}, learn boolean, {fields}")


@F.arrow_udf(BinaryType())
def _filled(classes: pa.Array, at: pa.Array, found: pa.Array) -> pa.Array:
    """The classes of a text with those of the words that the table lacks put in their places."""
    out = []
    for own, place, classed in zip(classes.to_pylist(), at.to_pylist(), found.to_pylist(), strict=True):
        if place:
            by_number = np.zeros(len(classed), np.uint8)
            for x in classed:
                by_number[x["k"]] = x["class"]
            row = np.frombuffer(own, np.uint8).copy()
            row[np.flatnonzero(row == _OUTSIDE)] = by_number[np.frombuffer(place, np.int32)]
            own = row.tobytes()
        out.append(own)
    return pa.array(out, pa.binary())


def transitions(sequences: DataFrame, classes: int, strength: float = 5.0) -> np.ndarray:
    """Log10 probabilities from class to class over `sequences` (classes), smoothed with the classes' own shares."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros(classes * classes, np.int64)
        for _, texts in text_slices(batches, "classes"):
            row = np.frombuffer(b"".join([b"\0", *texts]), np.uint8).astype(np.int64)
            sums += np.bincount(row[:-1] * classes + row[1:], minlength=classes * classes)
        pairs = np.flatnonzero(sums)
        yield pa.RecordBatch.from_arrays([pa.array(pairs, pa.int64()), pa.array(sums[pairs], pa.int64())], names=["pair", "n"])

    between = np.zeros(classes * classes)
    for r in sequences.select("classes").mapInArrow(run, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n")).collect():
        between[r["pair"]] = r["n"]
    between = between.reshape(classes, classes)
    shares = (between.sum(axis=0) + 0.5) / (between.sum() + 0.5 * classes)
    return np.log10((between + strength * shares) / (between.sum(axis=1, keepdims=True) + strength))


def score(docs: DataFrame, learn: Column, text_col: str = "text", id_col: str = "doc_id", exchange_words: int = EXCHANGE_WORDS, classes: int = CLASSES, table_words: int = TABLE_WORDS) -> DataFrame:
    """(doc_id, n_tokens, n_known, train_tokens, base_score, score, perplexity) for every row of `docs`.

    The rows where `learn` is true are learned from. Words are runs without ASCII white space, A-Z lower-cased; an end
    follows each text and counts as a token, so a null or empty text has one. `base_score` is the add-one unigram
    log10 probability; `score` that of the class model, an unknown word being one event of the class of words seen
    once. Repeated rows each get their scores. If nothing is learned from, every word is unknown. At most 200 classes.
    """
    if not 0 < classes <= 200:
        raise ValueError("classes are numbered in a byte, from 1 to 200")
    bounded_batches(docs.sparkSession)
    texts = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(learn, F.lit(False)).alias("learn"), F.col(text_col).cast("binary").alias("text"))
    training = texts.filter("learn").select("text")
    vocabulary = cut_lineage(word_counts(training))
    vocab = summarise(vocabulary, table_words)
    seeds = seed_classes(training, vocab, exchange_words, classes)
    classed = cut_lineage(classed_words(training, vocabulary, seeds))
    k = len(seeds.size) + 1
    table = word_table(classed, vocab, k)
    coded = cut_lineage(in_classes(texts, table))
    # Words outside the table meet their counts and classes in a join; each text sends a word once.
    others = coded.select("row_id", F.explode("others").alias("o")).select("row_id", "o.*")
    rarer = classed.filter(~in_table(vocab.least) & (F.col("word") != F.lit(END)))
    found = others.join(rarer, "word", "left").withColumn("c", F.coalesce("c", F.lit(0))).withColumn("class", F.coalesce("class", F.lit(k - 1)))
    known, single = F.col("c") > 0, F.when(F.col("class") == k - 1, table.discount).otherwise(0.0)
    total = F.element_at(F.array(*(F.lit(max(float(t), 1.0)) for t in table.totals)), F.col("class") + 1)
    emission = F.when(known, F.log10((F.col("c") - single) / total)).otherwise(F.lit(log10(table.unknown)))
    sums = found.groupBy("row_id").agg(
        F.sum(F.when(known, F.col("m")).otherwise(0)).alias("more_known"),
        F.sum(F.col("m") * F.log10(F.col("c") + F.lit(1))).alias("more_base"),
        F.sum(F.col("m") * emission).alias("more_own"),
        F.collect_list(F.struct("k", "class")).alias("found"),
    )
    whole = coded.drop("others").join(sums, "row_id", "left").select(
        "doc_id", "learn", "n_tokens", (F.col("n_known") + F.coalesce("more_known", F.lit(0))).alias("n_known"),
        (F.col("base") + F.coalesce("more_base", F.lit(0.0))).alias("base"), (F.col("own") + F.coalesce("more_own", F.lit(0.0))).alias("own"),
        _filled("classes", "at", "found").alias("classes"),
    )
    whole = cut_lineage(whole)
    moves = transitions(whole.filter("learn"), k)

    def load() -> Callable[[list[bytes]], pa.Array]:
        def work(texts: list[bytes]) -> pa.Array:
            rows = [np.frombuffer(b"\0" + t, np.uint8) for t in texts]
            return pa.array([float(moves[row[:-1], row[1:]].sum()) for row in rows], pa.float64())

        return work

    scored = whole.withColumn("score", F.col("own") + per_text(F.col("classes"), "double", load))
    divisor = log10(vocab.tokens + vocab.distinct + 1)
    return scored.select(
        "doc_id",
        "n_tokens",
        "n_known",
        F.lit(vocab.tokens).cast("long").alias("train_tokens"),
        (F.col("base") - F.col("n_tokens") * F.lit(divisor)).alias("base_score"),
        "score",
        F.pow(F.lit(10.0), -F.col("score") / F.col("n_tokens")).alias("perplexity"),
    )
