"""k-means on whole numbers, with exact dot products from bit planes.

A component becomes the integer floor(scale * x). Bit b of all 64 components of a vector is one 64-bit word, so a
vector of B-bit numbers is B words. The dot product of two vectors is the sum over pairs of planes of
weight * weight * popcount(plane AND plane), with a negative weight for the sign plane: exact whatever the rounding of
floating point. The planes are written once and all rounds read them in place of the vectors.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skein.llm.common import cut_lineage

WIDTH = 64
CLUSTERS, ROUNDS, SCALE, SEED = 8, 10, 1024, 3
#: Vectors worked on at a time in a task.
BLOCK = 8192
_LARGEST = (1 << 63) - 1


def scaled(x: np.ndarray, scale: int) -> np.ndarray:
    """floor(scale * x) without rounding; Python's integers where 64 bits could be too few."""
    if not x.size or np.abs(x).max() < 2.0**52 / scale:
        return np.floor(x * scale).astype(np.int64)
    from fractions import Fraction

    return np.array([int(Fraction(v) * scale // 1) for v in x.ravel().tolist()], object).reshape(x.shape)


def planes_needed(low: int, high: int) -> int:
    """Bits of the shortest two's complement that holds both."""
    return max(high.bit_length(), (~low).bit_length() if low < 0 else 0) + 1


def pack(values: np.ndarray, planes: int) -> np.ndarray:
    """(n, 64) integers as (n, planes) words: bit c of word b is bit b of component c."""
    out = np.empty((len(values), planes), np.uint64)
    for b in range(planes):
        bits = ((values >> b) & 1).astype(np.uint8)
        out[:, b] = np.packbits(bits, axis=1, bitorder="little").view("<u8")[:, 0]
    return out


def weights_of(planes: int) -> list[int]:
    return [1 << b for b in range(planes - 1)] + [-(1 << (planes - 1))]


def _kind(planes: int) -> type:
    """64-bit sums as long as no squared distance can leave them (4 * 64 * 2**(2 * planes - 2)), else Python's integers."""
    return np.int64 if 2 * planes + 7 < 63 else object


def unpack(words: np.ndarray) -> np.ndarray:
    """The integers back: (n, planes) words as (n, 64)."""
    n, planes = words.shape
    bits = np.unpackbits(np.ascontiguousarray(words, "<u8").view(np.uint8).reshape(n, planes, 8), axis=2, bitorder="little")
    kind = _kind(planes)
    out = np.zeros((n, WIDTH), kind)
    for b, w in enumerate(weights_of(planes)):
        out += bits[:, b].astype(kind) * w
    return out


def dots(words: np.ndarray, centre: np.ndarray) -> np.ndarray:
    """Exact dot products of n vectors with one centroid, all as planes."""
    kind, weights = _kind(words.shape[1]), weights_of(words.shape[1])
    total = np.zeros(len(words), kind)
    own = np.array(weights, kind)
    for plane, w in zip(centre, weights, strict=True):
        if plane:
            total += (np.bitwise_count(words & plane).astype(kind) @ own) * w
    return total


def squares(words: np.ndarray) -> np.ndarray:
    """Exact squared lengths by popcounts of each plane with each."""
    kind, weights = _kind(words.shape[1]), weights_of(words.shape[1])
    total = np.zeros(len(words), kind)
    own = np.array(weights, kind)
    for b, w in enumerate(weights):
        total += (np.bitwise_count(words & words[:, b : b + 1]).astype(kind) @ own) * w
    return total


def nearest(words: np.ndarray, centres: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(number of the nearest centroid, squared distance) of each vector; of equal distances the smaller number."""
    length = squares(words)
    far = np.stack([length - 2 * dots(words, c) + s for c, s in zip(centres, squares(centres), strict=True)], axis=1)
    best = np.argmin(far, axis=1)
    return best, far[np.arange(len(words)), best]


def words_of(column: pa.Array, planes: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64, copy=False).view(np.uint64).reshape(-1, planes)


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for first in range(0, batch.num_rows, BLOCK):
            yield batch.slice(first, BLOCK)


def kept_vectors(vectors: DataFrame, id_col: str, vec_col: str, scale: int) -> tuple[DataFrame, int]:
    """(id, planes) of the vectors with exactly 64 finite components, written down, and the number of planes."""
    v = F.col("v").cast("array<double>")
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    good = vectors.select(F.col(id_col).alias("id"), F.col(vec_col).alias("v")).filter((F.size("v") == WIDTH) & F.coalesce(F.forall("v", lambda x: finite(x.cast("double"))), F.lit(False)))
    ends = good.agg(F.min(F.array_min(v)).alias("low"), F.max(F.array_max(v)).alias("high")).first()
    low, high = (scaled(np.array([x or 0.0]), scale)[0] for x in (ends["low"], ends["high"]))
    planes = planes_needed(int(low), int(high))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in _blocks(batches):
            values = scaled(block.column(1).flatten().to_numpy(zero_copy_only=False).reshape(-1, WIDTH), scale)
            words = pack(values, planes).view(np.int64).ravel()
            offsets = np.arange(0, len(words) + 1, planes, dtype=np.int32)
            yield pa.RecordBatch.from_arrays([block.column(0), pa.ListArray.from_arrays(offsets, pa.array(words))], names=["id", "planes"])

    kind = good.schema["id"].dataType.simpleString()
    return cut_lineage(good.select("id", v.alias("v")).mapInArrow(run, f"id {kind}, planes array<bigint>")), planes


def first_centres(packed: DataFrame, clusters: int, seed: int) -> np.ndarray:
    """The planes of the vectors whose hash of `seed:id` is smallest; of equal ids those with the smaller planes."""
    rank = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("id").cast("string"), F.lit(""))).cast("binary"), 256)
    rows = packed.select(rank.alias("rank"), "planes").orderBy("rank", "planes").limit(clusters).collect()
    return np.array([r["planes"] for r in rows], np.int64).view(np.uint64)


def plane_counts(packed: DataFrame, centres: np.ndarray, planes: int) -> dict[int, tuple[int, list[int]]]:
    """Per centroid number: how many vectors are nearest to it, and the exact sum of each component.

    A task counts, for each centroid and plane, the vectors that have each component's bit set: a few rows whatever
    the number of vectors. Spark adds those up and one row for each centroid and plane reaches the driver.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, sizes = np.zeros((len(centres), planes, WIDTH), np.int64), np.zeros(len(centres), np.int64)
        for block in _blocks(batches):
            words = words_of(block.column(0), planes)
            best, _ = nearest(words, centres)
            for k in np.unique(best).tolist():
                mine = np.ascontiguousarray(words[best == k], "<u8").view(np.uint8).reshape(-1, planes, 8)
                sums[k] += np.unpackbits(mine, axis=2, bitorder="little").sum(axis=0, dtype=np.int64)
                sizes[k] += len(mine)
        used = np.flatnonzero(sizes)
        if len(used):
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.repeat(used, planes).astype(np.int32)), pa.array(np.tile(np.arange(planes, dtype=np.int32), len(used))),
                 pa.array(np.repeat(sizes[used], planes)), pa.array(list(sums[used].reshape(-1, WIDTH)), pa.list_(pa.int64()))],
                names=["cluster", "plane", "n", "bits"],
            )

    parts = packed.select("planes").mapInArrow(run, "cluster int, plane int, n bigint, bits array<bigint>")
    added = parts.groupBy("cluster", "plane").agg(F.sum("n").alias("n"), F.array(*(F.sum(F.col("bits")[c]) for c in range(WIDTH))).alias("bits"))
    out: dict[int, tuple[int, list[int]]] = {}
    weights = weights_of(planes)
    for r in added.collect():
        before = out.get(r["cluster"], (0, [0] * WIDTH))[1]
        out[r["cluster"]] = (r["n"], [a + weights[r["plane"]] * b for a, b in zip(before, r["bits"], strict=True)])
    return out


def moved(centres: np.ndarray, counts: dict[int, tuple[int, list[int]]], planes: int) -> np.ndarray:
    """Each centroid at floor(sum / count) of its vectors; one without vectors stays."""
    out = centres.copy()
    for k, (n, sums) in counts.items():
        kind = _kind(planes)
        out[k] = pack(np.array([[s // n for s in sums]], kind), planes)[0]
    return out


def cluster_vectors(
    vectors: DataFrame, clusters: int = CLUSTERS, rounds: int = ROUNDS, scale: int = SCALE, seed: int = SEED, id_col: str = "vec_id", vec_col: str = "embedding"
) -> DataFrame:
    """(id, cluster, distance, cluster_inertia, inertia, centroid, centroid_sha256) of every vector that is kept.

    Vectors that are null, have not exactly 64 components, or hold a null or non-finite one are left out; a null id
    is hashed as an empty one and stays, and rows that repeat an id each stand for themselves. With fewer vectors
    than clusters there are as many centroids as vectors; an empty table gives an empty one. `centroid` has the
    components as decimal integers joined by commas. Distances and sums that exceed a long are shown as the largest
    long (components beyond some 2**27), while the clusters themselves stay exact. The driver holds the centroids
    and one row for each centroid and plane.
    """
    packed, planes = kept_vectors(vectors, id_col, vec_col, scale)
    centres = first_centres(packed, clusters, seed)
    kind = packed.schema["id"].dataType.simpleString()
    if not len(centres):
        return packed.selectExpr("id", "0 AS cluster", "0L AS distance", "0L AS cluster_inertia", "0L AS inertia", "'' AS centroid", "'' AS centroid_sha256")
    for _ in range(rounds):
        new = moved(centres, plane_counts(packed, centres, planes), planes)
        if (new == centres).all():  # no later round can differ
            break
        centres = new

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in _blocks(batches):
            best, far = nearest(words_of(block.column(1), planes), centres)
            shown = np.minimum(far, _LARGEST).astype(np.int64)
            yield pa.RecordBatch.from_arrays([block.column(0), pa.array(best.astype(np.int32)), pa.array(shown)], names=["id", "cluster", "distance"])

    placed = cut_lineage(packed.mapInArrow(run, f"id {kind}, cluster int, distance bigint"))
    sums = {r["cluster"]: int(r["s"]) for r in placed.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("s")).collect()}
    texts = [",".join(str(int(v)) for v in row) for row in unpack(centres)]
    info = placed.sparkSession.createDataFrame(
        [(k, min(s, _LARGEST), min(sum(sums.values()), _LARGEST), texts[k]) for k, s in sums.items()], "cluster int, cluster_inertia bigint, inertia bigint, centroid string"
    )
    # One row for each centroid.
    return placed.join(F.broadcast(info), "cluster").select("id", "cluster", "distance", "cluster_inertia", "inertia", "centroid", F.sha2(F.col("centroid").cast("binary"), 256).alias("centroid_sha256"))
