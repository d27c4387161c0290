"""Hashed text features and logistic regression by follow-the-regularised-leader."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

import numpy as np

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skein.llm.common import bounded_batches, cut_lineage, hash_rank, rank_bound
from skein.llm.text import _BASE, BY_LETTER, blocks, mixed, per_text, run_hashes

#: Number of weights is 2**BITS.
BITS = 20


def _classes() -> np.ndarray:
    """0 white space, 1 letters, digits and bytes beyond ASCII, 2 the other signs."""
    out = np.full(256, 2, np.uint8)
    out[[32, 9, 10, 11, 12, 13]] = 0
    out[[b for b in range(256) if BY_LETTER[b] != 32]] = 1
    return out


_CLASS = _classes()


def token_hashes(texts: list[bytes], lower: bool = False, words_only: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(hashes, owners, prefix hashes, lengths) of the tokens of all texts: maximal runs of one class of bytes."""
    joined = b"\n".join(texts)
    joined = joined.lower() if lower else joined
    found = [(np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.uint64))]
    for at, end in blocks(joined):
        data = np.frombuffer(joined, np.uint8, end - at, at)
        kind = _CLASS[data]
        if words_only:
            kind = np.where(kind == 1, kind, np.uint8(0))
        edges = np.flatnonzero(np.diff(kind, prepend=np.uint8(255), append=np.uint8(255)))
        first, last = edges[:-1], edges[1:]
        real = kind[first] > 0
        first, last = first[real], last[real]
        hashes, sums, down = run_hashes(data, first, last)
        prefix = mixed((sums[np.minimum(last, first + 5)] - sums[first]) * down + np.uint64(1 << 40))
        found.append((hashes, first + at, prefix, (last - first).astype(np.uint64)))
    hashes, starts, prefix, sizes = (np.concatenate(x) for x in zip(*found, strict=True))
    offsets = np.cumsum([0, *(len(t) + 1 for t in texts)])
    return hashes, np.searchsorted(offsets, starts, side="right") - 1, prefix, sizes


def ngram_features(texts: list[bytes], bits: int = BITS) -> list[tuple[np.ndarray, np.ndarray]]:
    """Per text (indices, values): one- and two-token grams by their share of the text, case kept.

    Signs are tokens of their own. A token that repeats the one before it is also counted under one common feature,
    and so is every token's rough length, so that a text's shape shows beside its words. A text without tokens has
    the single feature 0.
    """
    hashes, owner, _, sizes = token_hashes(texts)
    shift = np.uint64(64 - bits)
    pairs = np.zeros(len(hashes), np.uint64)
    pairs[1:] = mixed(hashes[1:] * np.uint64(_BASE) + hashes[:-1])
    same = np.zeros(len(hashes), bool)
    same[1:] = hashes[1:] == hashes[:-1]
    pairs[same] = mixed(np.uint64(77) + np.zeros(int(same.sum()), np.uint64))
    lengths = mixed(np.minimum(sizes, np.uint64(16)) + np.uint64(1 << 50))
    cuts = np.searchsorted(owner, np.arange(len(texts) + 1))
    out = []
    for a, b in zip(cuts.tolist(), cuts[1:].tolist(), strict=False):
        if a == b:
            out.append((np.zeros(1, np.int32), np.ones(1, np.float32)))
            continue
        grams = np.concatenate([hashes[a:b], pairs[a + 1 : b], lengths[a:b]]) >> shift
        index, counts = np.unique(grams.astype(np.int64), return_counts=True)
        out.append((index.astype(np.int32), np.sqrt(counts / (b - a)).astype(np.float32)))
    return out


def word_features(texts: list[bytes], bits: int = BITS) -> list[tuple[np.ndarray, np.ndarray]]:
    """Per text (indices, ones): which lower-cased words and which five-byte word beginnings it holds."""
    hashes, owner, prefix, _ = token_hashes(texts, lower=True, words_only=True)
    shift = np.uint64(64 - bits)
    cuts = np.searchsorted(owner, np.arange(len(texts) + 1))
    out = []
    for a, b in zip(cuts.tolist(), cuts[1:].tolist(), strict=False):
        index = np.unique((np.concatenate([hashes[a:b], prefix[a:b]]) >> shift).astype(np.int64))
        out.append((index.astype(np.int32), np.ones(len(index), np.float32)))
    return out


@dataclass
class Batch:
    """Rows that are learned from in one step: their numbers, the features they hold, and row, place and value of each entry."""

    own: np.ndarray
    index: np.ndarray
    row: np.ndarray
    place: np.ndarray
    value: np.ndarray


def batches_of(rows: list[tuple[np.ndarray, np.ndarray]], seed: int = 1, size: int = 8) -> list[Batch]:
    """All rows in random batches; sorting their features once serves every epoch and model."""
    order = np.random.default_rng(seed).permutation(len(rows))
    out = []
    for first in range(0, len(order), size):
        own = order[first : first + size]
        index, place = np.unique(np.concatenate([rows[i][0] for i in own]), return_inverse=True)
        row = np.repeat(np.arange(len(own), dtype=np.int32), [len(rows[i][0]) for i in own])
        out.append(Batch(own, index.astype(np.int32), row, place.astype(np.int32), np.concatenate([rows[i][1] for i in own])))
    return out


@dataclass
class Ftrl:
    """Per-coordinate FTRL-proximal logistic regression over sparse rows, with a bias and a few dense inputs.

    Rows are learned from in small batches, whose gradients and squared gradients are summed.
    """

    bits: int = BITS
    dense: int = 0
    alpha: float = 0.3
    beta: float = 1.0
    l1: float = 0.2
    l2: float = 0.5
    weights: np.ndarray = field(init=False)

    def fit(self, rows: list[tuple[np.ndarray, np.ndarray]] | list[Batch], labels: np.ndarray, dense: np.ndarray | None = None, epochs: int = 3, seed: int = 1, learn: np.ndarray | None = None) -> Ftrl:
        """Learns from the rows where `learn` is true (all by default); `rows` may come in ready-made batches."""
        batches = rows if rows and isinstance(rows[0], Batch) else batches_of(rows, seed)
        size = (1 << self.bits) + 1 + self.dense
        z, n = np.zeros(size, np.float32), np.zeros(size, np.float32)
        l1 = np.full(size, self.l1, np.float32)
        l1[1 << self.bits :] = 0
        tail = np.arange(1 << self.bits, size)
        rng = np.random.default_rng(seed)
        for _ in range(epochs):
            for k in rng.permutation(len(batches)).tolist():
                b = batches[k]
                extra = np.column_stack([np.ones(len(b.own), np.float32), *([] if dense is None else dense[b.own].T.astype(np.float32))])
                zi, ni, zt, nt = z[b.index], n[b.index], z[tail], n[tail]
                w, wt = self._solve(zi, ni, l1[b.index]), self._solve(zt, nt, l1[tail])
                sums = np.bincount(b.row, weights=w[b.place] * b.value, minlength=len(b.own)) + extra @ wt
                error = (1 / (1 + np.exp(-np.clip(sums, -30, 30))) - labels[b.own]).astype(np.float32)
                if learn is not None:
                    error *= learn[b.own]
                part = error[b.row] * b.value
                for at, old, before, own, g, squares in (
                    (b.index, zi, ni, w, np.bincount(b.place, part, len(b.index)), np.bincount(b.place, part * part, len(b.index))),
                    (tail, zt, nt, wt, error @ extra, ((error[:, None] * extra) ** 2).sum(axis=0)),
                ):
                    grown = before + squares
                    z[at] = old + g - (np.sqrt(grown) - np.sqrt(before)) / self.alpha * own
                    n[at] = grown
        self.weights = self._solve(z, n, l1)
        return self

    def _solve(self, z: np.ndarray, n: np.ndarray, l1: np.ndarray) -> np.ndarray:
        return np.where(np.abs(z) <= l1, np.float32(0), (np.sign(z) * l1 - z) / ((self.beta + np.sqrt(n)) / self.alpha + self.l2)).astype(np.float32)

    def predict(self, rows: list[tuple[np.ndarray, np.ndarray]], dense: np.ndarray | None = None) -> np.ndarray:
        w, base = self.weights, 1 << self.bits
        sums = np.fromiter((w[i] @ x for i, x in rows), np.float64, len(rows)) + w[base]
        if dense is not None:
            sums = sums + dense @ w[base + 1 :].astype(np.float64)
        return 1 / (1 + np.exp(-np.clip(sums, -30, 30)))

    def predict_batches(self, batches: list[Batch], n: int, dense: np.ndarray) -> np.ndarray:
        """`predict` for all `n` rows that ready-made batches hold."""
        w, base = self.weights, 1 << self.bits
        sums = w[base] + dense @ w[base + 1 :].astype(np.float64)
        for b in batches:
            sums[b.own] += np.bincount(b.row, weights=w[b.index][b.place] * b.value, minlength=len(b.own))
        return 1 / (1 + np.exp(-np.clip(sums, -30, 30)))

    def sparse(self) -> tuple[np.ndarray, np.ndarray, int]:
        """(indices, values, size) of the weights, small enough to travel with a task."""
        index = np.flatnonzero(self.weights)
        return index, self.weights[index], len(self.weights)


def from_sparse(parts: tuple[np.ndarray, np.ndarray, int], bits: int, dense: int = 0) -> Ftrl:
    model = Ftrl(bits=bits, dense=dense)
    model.weights = np.zeros(parts[2], np.float32)
    model.weights[parts[0]] = parts[1]
    return model


def within_budget(rows: list[tuple[int, int]], budget: int) -> int:
    """The highest rank up to which (rank, bytes) rows fit into `budget`, those that exceed it alone left out; -1 if none does."""
    best, used = -1, 0
    for rank, size in sorted(r for r in rows if r[1] <= budget):
        used += size
        if used > budget:
            break
        best = rank
    return best


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, per_class: int, max_bytes: int, text_col: str = "text", id_col: str = "doc_id") -> tuple[list[bytes], np.ndarray]:
    """(texts, labels 0 or 1) of about `per_class` labelled documents of each class, or of all if there are fewer.

    The choice goes by a hash of the id, so it is the same on every run. Rows with a null label or id are left out; of
    several labels for one id the least counts. The texts of a class have `max_bytes` at most: ids are taken in the
    order of their hashes up to there, and an id whose rows exceed that alone is left out. So whatever the table's
    size, its longest text or its repeated ids, the driver holds that many bytes; the chosen rows are written down
    before they are counted.
    """
    known = labels.filter(F.col(label).isNotNull() & F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("__id")).agg(F.min(label).cast("int").alias("__y"))
    counts = {r["__y"]: r["n"] for r in known.groupBy("__y").agg(F.count("*").alias("n")).filter("__y IN (0, 1)").collect()}
    bounds = {y: rank_bound(per_class, n) for y, n in counts.items()}
    below = lambda limits: F.coalesce(*(F.when(F.col("__y") == y, F.col("__rank") <= b) for y, b in limits.items()), F.lit(False))
    chosen = known.withColumn("__rank", hash_rank(F.col("__id"), 11)).filter(below(bounds))
    rows = docs.select(F.col(id_col).alias("__id"), F.col(text_col).cast("binary").alias("t")).filter("t IS NOT NULL").join(F.broadcast(chosen), "__id").select("t", "__y", "__rank")
    rows = cut_lineage(rows)
    sizes: dict[int, list[tuple[int, int]]] = {}
    for r in rows.groupBy("__y", "__rank").agg(F.sum(F.octet_length("t")).alias("size")).collect():
        sizes.setdefault(r["__y"], []).append((r["__rank"], r["size"]))
    limits = {y: within_budget(found, max_bytes) for y, found in sizes.items()}
    over = [rank for found in sizes.values() for rank, size in found if size > max_bytes]
    fits = rows.filter(below(limits) & ~F.col("__rank").isin(over)) if over else rows.filter(below(limits))
    got = sorted(((bytes(r["t"]), r["__y"]) for r in fits.select("t", "__y").toLocalIterator()), key=lambda r: (hash_of(r[0]), r))
    return [t for t, _ in got], np.array([y for _, y in got], np.float32)


def in_slices(texts: list[bytes], features: Callable[[list[bytes]], list], limit: int = 1 << 20) -> list:
    """The features of all texts, worked out about `limit` bytes at a time."""
    out, own, size = [], [], 0
    for text in texts:
        own.append(text)
        size += len(text)
        if size > limit:
            out += features(own)
            own, size = [], 0
    return out + features(own) if own else out


def hash_of(text: bytes) -> int:
    import zlib

    return zlib.crc32(text)


def with_scores(docs: DataFrame, names: list[str], load: Callable[[], Callable[[list[bytes]], np.ndarray]], carry: tuple[str, ...] | None = None, text_col: str = "text") -> DataFrame:
    """`docs` as a struct `doc` (all columns, or `carry`), and a double column for each of `names`.

    `load` runs once in each task and gives the function from texts to an (n, len(names)) array.
    """
    bounded_batches(docs.sparkSession)

    def loaded() -> Callable[[list[bytes]], pa.Array]:
        score = load()
        return lambda texts: pa.StructArray.from_arrays([pa.array(v) for v in np.asarray(score(texts), np.float64).reshape(len(texts), len(names)).T], names=names)

    values = per_text(F.col(text_col), "struct<" + ",".join(f"{n}:double" for n in names) + ">", loaded)
    return docs.select(F.struct(*(carry or ["*"])).alias("doc"), values.alias("__scores")).select("doc", *(F.col(f"__scores.{n}").alias(n) for n in names))
