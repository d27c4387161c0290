"""Near-duplicate detection on SimHash signatures with a byte-position inverted index.

A signature of 8·m bytes is a set of (position, byte) entries. Two signatures that differ in few bits share many
entries: 4 differing bits of 8 bytes leave at least 4 bytes untouched. Lists of single entries would hold a 256th of
all signatures each, so a posting stands for three positions at once and lists the signatures that agree on all of
them; any 4 of the 8 positions hold one of 20 such triples, so no pair that reaches the guaranteed matches is lost.
Inside a posting each pair's shared bytes are tallied over all positions, pairs with fewer than the guaranteed number
go, and the rest are verified on all bits. A posting returns a spanning forest of its verified pairs, never the pairs
themselves. Rows of postings beyond a size are keyed once more with a fourth position, which a linking pair shares as
well; only what is oversized then is worked off as pairs of bounded chunks. Components of the links give the groups.

The corpus stage asks for a Jaccard similarity of shingle sets, of which a signature gives only an estimate. There, a
longer signature is indexed by its bytes: positions lie in classes, and a posting stands for two positions of a class.
Pairs of a posting that share no further byte of the part of the signature that travels along go, as do those whose
bits differ too often, and every link that is left is verified on the shingle sets themselves.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skein.llm.common import cut_lineage
from skein.llm.components import components
from skein.llm.exact_dedup import bucket, bucket_bitmap, within_buckets
from skein.llm.text import BY_SPACE, joined_words, mixed, rolled, text_slices

SEED = 42
SHINGLE, MAX_BITS = 4, 4
#: Signatures in one posting that are compared within one task; larger postings are dealt out in chunks of half.
BLOCK = 1024
#: The corpus stage: five-word shingles, a similarity of 0.8, signatures of 640 bits, their positions in 16 classes.
STAGE = {"words": 5, "similarity": 0.8, "sig_words": 10, "classes": 16}
#: Words of the stage's signatures that postings carry, and the share of their bits that may differ (0.15 are expected).
CARRIED, DIFFERING = 3, 0.25
#: Signatures in one posting of the stage that are compared within one task.
STAGE_BLOCK = 1 << 14
#: Longer runs of a key are worked off from row to row of a group instead of pair by pair.
RUN = 2048
#: Shingles that are compared within one task of the corpus stage; larger groups are dealt out in chunks of half.
WEIGHT = 1 << 19


def _majority(hashes: np.ndarray) -> np.ndarray:
    """The bits set in over half of the rows of (n, m) hashes, as m words."""
    bits = np.unpackbits(hashes.view(np.uint8).reshape(len(hashes), -1), axis=1, bitorder="little")
    ones = bits.sum(axis=0, dtype=np.int64)
    return np.packbits(2 * ones > len(hashes), bitorder="little").view(np.uint64)


def fingerprint(text: bytes, shingle: int = SHINGLE) -> int:
    """64-bit SimHash of all shingles, repeats included, by XXH64 with seed 42; 0 for a text without words."""
    words = text.lower().split()
    if not words:
        return 0
    k = min(shingle, len(words))
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = [0, *(ends[: len(words) - k] + 1).tolist()]
    h = xxhash.xxh64_intdigest
    hashes = [h(joined[a:b], SEED) for a, b in zip(starts, ends[k - 1 :].tolist(), strict=True)]
    return int(_majority(np.array(hashes, np.uint64).reshape(-1, 1))[0])


def shingle_sets(texts: list[bytes], shingle: int) -> list[np.ndarray]:
    """Each text's distinct shingles as sorted hashes; none for a text without words, one for a short text."""
    _, _, _, hashes, owner = joined_words(texts, BY_SPACE)
    bounds = np.searchsorted(owner, np.arange(len(texts) + 1))
    return [np.unique(rolled(hashes[a:b], min(shingle, b - a))) if b > a else np.zeros(0, np.uint64) for a, b in zip(bounds, bounds[1:], strict=False)]


def set_names(sets: list[np.ndarray]) -> np.ndarray:
    """One 64-bit name for each set of hashes."""
    return mixed(np.array([mixed(s + np.uint64(1)).sum(dtype=np.uint64) + np.uint64(len(s)) for s in sets], np.uint64))


def signatures(sets: list[np.ndarray], sig_words: int) -> np.ndarray:
    """(n, sig_words) SimHash signatures of sets of hashes.

    Each hash gives every bit a weight of -3, -1, 1 or 3, so that few shingles too come near the share of differing bits
    that their angle has; a bit is set if the sum is positive.
    """
    salts = mixed(np.arange(1, 2 * sig_words + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)
    out = np.zeros((len(sets), sig_words), np.uint64)
    for d, own in enumerate(sets):
        ones = np.zeros(128 * sig_words, np.int64)
        for a in range(0, len(own), 255):  # sums of up to 255 ones fit a byte
            h = own[a : a + 255, None] * salts
            h = (h ^ (h >> np.uint64(31))) * np.uint64(0xD6E8FEB86659FD93)
            h ^= h >> np.uint64(29)
            ones += np.unpackbits(h.view(np.uint8), axis=1, bitorder="little").sum(axis=0, dtype=np.uint8)
        low, high = ones.reshape(2, -1)
        out[d] = np.packbits(2 * (low + 2 * high) > 3 * len(own), bitorder="little").view(np.uint64)
    return out


def classed_pairs(n: int, classes: int) -> list[tuple[int, int]]:
    """The pairs of n positions that lie in the same class; any `classes` + 1 positions hold one."""
    return [t for t in combinations(range(n), 2) if t[0] % classes == t[1] % classes]


def covering_triples(n: int) -> list[tuple[int, ...]]:
    """Triples of n positions such that any 4 positions hold one: three classes in a circle, and the triples that lie
    in one class or have two positions in a class and one in the next (Turán)."""
    part = [3 * i // n for i in range(n)]
    inside = lambda t: [sum(part[i] == c for i in t) for c in range(3)]
    return [t for t in combinations(range(n), 3) for k in [inside(t)] if 3 in k or any(k[c] == 2 and k[(c + 1) % 3] == 1 for c in range(3))]


def _posting_sets(sig_words: int, positions: int) -> list[tuple[int, ...]]:
    """Sets of bytes of which any `positions` shared bytes hold one."""
    return covering_triples(8 * sig_words) if positions == 4 else list(combinations(range(8 * sig_words), positions))


def _forest(left: np.ndarray, right: np.ndarray, n: int) -> np.ndarray:
    """For each of n rows the least row it reaches over the given pairs."""
    label = np.arange(n)
    while len(left):
        least = np.minimum(label[left], label[right])
        before = label.copy()
        np.minimum.at(label, left, least)
        np.minimum.at(label, right, least)
        label = label[label]
        if (label == before).all():
            break
    return label


def _near(differing: np.ndarray, least: np.ndarray, max_bits: int) -> np.ndarray:
    """Where the tally of equal bytes reaches `least` and at most `max_bits` bits differ."""
    reached = np.flatnonzero((differing.view(np.uint8) == 0).sum(axis=1, dtype=np.int64) >= least)
    return reached[np.bitwise_count(differing[reached]).sum(axis=1, dtype=np.int64) <= max_bits]


def _links(keys: np.ndarray, sigs: np.ndarray, max_bits: int, least: np.ndarray) -> np.ndarray:
    """Rows are sorted by key; the least row that each reaches over verified pairs inside its key."""
    lefts, rights = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    rows, lag = np.arange(len(keys)), 1
    while True:
        rows = rows[rows < len(keys) - lag]
        rows = rows[keys[rows] == keys[rows + lag]]
        if not len(rows):
            break
        near = rows[_near(sigs[rows] ^ sigs[rows + lag], least[rows], max_bits)]
        lefts.append(near)
        rights.append(near + lag)
        lag += 1
    return _forest(np.concatenate(lefts), np.concatenate(rights), len(keys))


def _spread(sigs: np.ndarray, max_bits: int, least: int) -> np.ndarray:
    """What `_links` gives for rows of one key, where each row found is held against those not found yet."""
    root, left, queue = np.arange(len(sigs)), np.arange(len(sigs)), []
    while len(left):
        if not queue:
            first, left = int(left[0]), left[1:]
            queue.append(first)
            continue
        near = _near(sigs[left] ^ sigs[queue.pop()], least, max_bits)
        root[left[near]] = first
        queue += left[near].tolist()
        left = np.delete(left, near)
    return root


def _linker(sig_words: int, max_bits: int, block: int | None, needed: Callable[[np.ndarray], np.ndarray]):
    """Over rows sorted by key: (a, b, key) with key null for a link of two nodes; rows of oversized keys come back.

    `needed` gives the equal bytes that two rows of each key must have.
    """
    names = ["node", *(f"s{i}" for i in range(sig_words))]

    def batch(a, b, key) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(key, pa.int64())], names=["a", "b", "key"])

    def solved(keys: np.ndarray, rows: np.ndarray) -> pa.RecordBatch:
        sigs, least, root = np.ascontiguousarray(rows[:, 1:]).view(np.uint64), needed(keys), np.arange(len(keys))
        _, first, size = np.unique(keys, return_index=True, return_counts=True)
        for a, n in zip(first[size > RUN].tolist(), size[size > RUN].tolist(), strict=True):
            root[a : a + n] = a + _spread(sigs[a : a + n], max_bits, least[a])
        rest = np.flatnonzero(np.repeat(size <= RUN, size))
        root[rest] = rest[_links(keys[rest], sigs[rest], max_bits, least[rest])]
        moved = np.flatnonzero(root != np.arange(len(root)))
        return batch(rows[root[moved], 0], rows[moved, 0], pa.nulls(len(moved), pa.int64()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, rows, hot = np.zeros(0, np.int64), np.zeros((0, len(names)), np.int64), None
        for rb in batches:
            keys = np.concatenate([keys, rb.column("key").to_numpy()])
            rows = np.concatenate([rows, np.column_stack([rb.column(n).to_numpy() for n in names])])
            if hot is not None:
                n = int(np.searchsorted(keys, hot, side="right"))
                if n:
                    yield batch(rows[:n, 0], rows[:n, 0], keys[:n])
                keys, rows = keys[n:], rows[n:]
                hot = hot if not len(keys) else None
            if not len(keys):
                continue
            cut = int(np.searchsorted(keys, keys[-1], side="left"))
            if cut:
                yield from whole(keys[:cut], rows[:cut])
            keys, rows = keys[cut:], rows[cut:]
            if block and len(keys) > block:
                hot = int(keys[0])
                yield batch(rows[:, 0], rows[:, 0], keys)
                keys, rows = keys[:0], rows[:0]
        if len(keys):
            yield from whole(keys, rows)

    def whole(keys: np.ndarray, rows: np.ndarray) -> Iterator[pa.RecordBatch]:
        if block:
            _, at, size = np.unique(keys, return_inverse=True, return_counts=True)
            large = size[at] > block
            if large.any():
                yield batch(rows[large, 0], rows[large, 0], keys[large])
                keys, rows = keys[~large], rows[~large]
        yield solved(keys, rows)

    return run


def links(nodes: DataFrame, sig_words: int, max_bits: int, positions: int, block: int = BLOCK) -> DataFrame:
    """(a, b): links between different nodes that connect all nodes within `max_bits` which share a posting.

    `nodes` has node and s0.. (longs), one row per distinct signature.
    """
    least = max(0, 8 * sig_words - max_bits)
    sets = _posting_sets(sig_words, positions)
    return _posted(nodes, sets, sig_words, sig_words, max_bits, block, lambda keys: np.full(len(keys), least), positions > len(sets[0]))


def likely_links(nodes: DataFrame, sig_words: int, classes: int, block: int = STAGE_BLOCK) -> DataFrame:
    """(a, b): links between nodes whose signatures share three bytes, two of them in one class of positions, and differ
    in a quarter of the carried bits at most; a group of such nodes comes out connected."""
    sets = classed_pairs(8 * sig_words, classes)
    inside = np.array([sum(place < 8 * CARRIED for place in places) for places in sets])

    def needed(keys: np.ndarray) -> np.ndarray:
        # Of the three, those of the posting count only if they are carried.
        return 1 + inside[keys >> 16]

    found = _posted(nodes, sets, sig_words, CARRIED, int(64 * CARRIED * DIFFERING), block, needed, False)
    # Twice, as the nodes that the first pass moves to are themselves often linked to several.
    return _starred(_starred(found))


def _starred(rows: DataFrame) -> DataFrame:
    """Links (a, b) of the same groups: what links to a node links to the least such instead, so groups keep few links."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node, head = None, 0
        for rb in batches:
            if not rb.num_rows:
                continue
            a, b = rb.column("a").to_numpy(), rb.column("b").to_numpy()
            heads = a[np.maximum.accumulate(np.where(np.append(True, b[1:] != b[:-1]), np.arange(len(b)), 0))]
            if node is not None and b[0] == node:
                heads[b == node] = head
            node, head = b[-1], heads[-1]
            ends = np.unique(np.column_stack([np.concatenate([heads, heads]), np.concatenate([a, b])]), axis=0)
            ends = ends[ends[:, 0] != ends[:, 1]]
            yield pa.RecordBatch.from_arrays([pa.array(ends[:, 0]), pa.array(ends[:, 1])], names=["a", "b"])

    return rows.repartition("b").sortWithinPartitions("b", "a").mapInArrow(run, "a long, b long").distinct()


def _posted(nodes: DataFrame, sets: list[tuple[int, ...]], sig_words: int, carried: int, max_bits: int, block: int, needed: Callable[[np.ndarray], np.ndarray], deeper: bool) -> DataFrame:
    """(a, b): the links of `nodes` inside the postings `sets`, whose rows carry the first words of the signatures.

    With `deeper`, nodes of an oversized posting that may link share one more position.
    """
    every = ["node", *(f"s{i}" for i in range(sig_words))]
    names = every[: 1 + carried]

    def expand(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for first in range(0, whole.num_rows, 1000):
                rb = whole.slice(first, 1000)
                sig = np.column_stack([rb.column(n).to_numpy() for n in every[1:]]).view(np.uint8).astype(np.int64)
                keys = np.empty((rb.num_rows, len(sets)), np.int64)
                for p, places in enumerate(sets):
                    key = np.full(rb.num_rows, p, np.int64)
                    for place in places:
                        key = (key << 8) | sig[:, place]
                    keys[:, p] = key
                yield pa.RecordBatch.from_arrays([pa.array(keys.ravel()), *(pa.array(np.repeat(rb.column(n).to_numpy(), len(sets))) for n in names)], names=["key", *names])

    schema = "key long, " + ", ".join(f"{n} long" for n in names)
    rows = nodes.select(*every).mapInArrow(expand, schema)
    found = rows.repartition("key").sortWithinPartitions("key", "node").mapInArrow(_linker(carried, max_bits, block, needed), "a long, b long, key long")
    found = cut_lineage(found.distinct())
    easy, hot = found.filter("key IS NULL").select("a", "b"), found.filter("key IS NOT NULL").select(F.col("a").alias("node"), "key")
    if hot.isEmpty():
        return easy
    if deeper:
        # The rows of an oversized posting that may still link share one more position, so each is keyed anew by that.
        again = hot.join(nodes.select(*names), "node").select("key", *names)
        again = again.mapInArrow(_one_position_more(sets, sig_words), schema).repartition("key").sortWithinPartitions("key")
        found = cut_lineage(again.mapInArrow(_linker(carried, max_bits, block, needed), "a long, b long, key long").distinct())
        easy, hot = easy.unionByName(found.filter("key IS NULL").select("a", "b")), found.filter("key IS NOT NULL").select(F.col("a").alias("node"), "key")
        if hot.isEmpty():
            return easy
    # What is oversized still is dealt into chunks of half a block; every two chunks meet in one task.
    chunks = hot.groupBy("key").agg(F.ceil(F.count("*") / F.lit(block // 2)).cast("long").alias("n"))
    dealt = hot.join(chunks, "key").withColumn("c", F.pmod(F.xxhash64("node"), "n"))
    dealt = dealt.withColumn("o", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)))
    dealt = dealt.select("node", F.xxhash64("key", F.least("c", "o"), F.greatest("c", "o")).alias("key"))
    again = dealt.join(nodes.select(*names), "node").select("key", *names)
    more = again.repartition("key").sortWithinPartitions("key", "node").mapInArrow(_linker(carried, max_bits, None, lambda keys: np.full(len(keys), needed(np.zeros(1, np.int64))[0])), "a long, b long, key long")
    return easy.unionByName(more.select("a", "b"))


def _one_position_more(sets: list[tuple[int, ...]], sig_words: int):
    """Over rows (key, node, s0..) of oversized postings: a row for each further position, whose byte joins the key."""
    names = [f"s{i}" for i in range(sig_words)]
    width = len(sets[0])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rb in batches:
            keys, node = rb.column("key").to_numpy(), rb.column("node").to_numpy()
            sig = np.column_stack([rb.column(n).to_numpy() for n in names])
            of_byte = np.ascontiguousarray(sig).view(np.uint8).astype(np.int64)
            number = keys >> (8 * width)
            for q in range(8 * sig_words):
                own = np.flatnonzero([q not in sets[p] for p in number.tolist()])
                if len(own):
                    longer = (((number[own] * 8 * sig_words + q) << 8 * width | keys[own] & ((1 << 8 * width) - 1)) << 8) | of_byte[own, q]
                    yield pa.RecordBatch.from_arrays([pa.array(longer), pa.array(node[own]), *(pa.array(c) for c in sig[own].T)], names=["key", "node", *names])

    return run


def _grouped(signed: DataFrame, names: list[str], found: Callable[[DataFrame], DataFrame], kept: list[str] | None = None) -> DataFrame:
    """`signed` (doc_id, node, names, kept) with component_id: the least doc_id of all documents reachable over links.

    `found` gives the links (a, b) of the distinct nodes. `signed` is read several times.
    """
    nodes = cut_lineage(signed.groupBy("node").agg(F.min("doc_id").alias("least"), F.count("*").alias("copies"), *(F.first(n).alias(n) for n in names)))
    roots = components(found(nodes))
    linked = nodes.select("node", "least").join(roots, "node")
    best = linked.groupBy(F.col("root").alias("r")).agg(F.min("least").alias("component"))
    by_node = linked.join(best, F.col("root") == F.col("r")).select("node", "component")
    named = nodes.select("node", "least").join(by_node, "node", "left").select(F.col("node").alias("k"), F.coalesce("component", "least").alias("component_id"))
    # Written down, so that the last join is one of two plain shuffles, whose large partitions Spark splits.
    named = cut_lineage(named)
    return signed.join(named, F.col("node") == F.col("k")).select("doc_id", *names, *(kept or []), "component_id")


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE, max_bits: int = MAX_BITS, text_col: str = "text", id_col: str = "doc_id", block: int = BLOCK) -> DataFrame:
    """(doc_id, fingerprint, component_id) for every row of `docs`; exact for 64-bit fingerprints.

    Texts are lower-cased (A-Z) and cut into words at ASCII white space; `shingle` consecutive words make a shingle,
    a shorter text is one shingle, and a null text, an empty text or one without words has fingerprint 0 and links
    like any other. Rows that repeat an id share its component. `component_id` is the least id reachable over
    fingerprints at `max_bits` or fewer differing bits, null if no row of the group has an id.
    """
    schema = docs.select(F.col(id_col).alias("doc_id")).schema.add("node", "long").add("s0", "long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, texts in text_slices(batches):
            values = pa.array(np.array([fingerprint(t, shingle) for t in texts], np.uint64).view(np.int64))
            yield pa.RecordBatch.from_arrays([rows.column("doc_id"), values, values], names=["doc_id", "node", "s0"])

    signed = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("binary").alias("text")).mapInArrow(run, schema)
    if not 0 <= max_bits < 8:
        raise ValueError("8 bytes guarantee a shared byte only up to 7 differing bits")
    grouped = _grouped(cut_lineage(signed), ["s0"], lambda nodes: links(nodes, 1, max_bits, 8 - max_bits, block))
    return grouped.select("doc_id", F.lower(F.lpad(F.hex("s0"), 16, "0")).alias("fingerprint"), "component_id")


def _alike(sets: list[np.ndarray], similarity: float) -> Iterator[tuple[int, np.ndarray]]:
    """Pairs (a, several b) with at least this Jaccard similarity that connect all sets which such pairs connect."""
    sizes = np.array([len(s) for s in sets])
    _, ids = np.unique(np.concatenate(sets), return_inverse=True)
    bounds = np.cumsum(np.append(0, sizes))
    left, flat, mark, queue = np.arange(len(sets)), ids, np.zeros(ids.max() + 1, bool), []
    while len(left):
        if not queue:
            queue.append(int(left[0]))
            flat, left = flat[sizes[left[0]] :], left[1:]
            continue
        a = queue.pop()
        own = ids[bounds[a] : bounds[a + 1]]
        mark[own] = True
        both = np.add.reduceat(mark[flat], np.cumsum(sizes[left]) - sizes[left], dtype=np.int64)
        mark[own] = False
        near = both / (sizes[a] + sizes[left] - both) >= similarity
        if near.any():
            yield a, left[near]
            queue += left[near].tolist()
            flat, left = flat[np.repeat(~near, sizes[left])], left[~near]


def _verifier(similarity: float):
    """Over rows (key, node, members) sorted by key: links (a, b) of the nodes of each key, verified on their members."""

    def solved(own: dict[int, bytes]) -> Iterator[pa.RecordBatch]:
        nodes = np.array(list(own), np.int64)
        for a, near in _alike([np.frombuffer(x, np.uint64) for x in own.values()], similarity):
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(nodes[a], len(near))), pa.array(nodes[near])], names=["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, key = {}, None
        for rb in batches:
            for k, node, members in zip(rb.column("key").to_pylist(), rb.column("node").to_pylist(), rb.column("members"), strict=True):
                if k != key:
                    if len(rows) > 1:
                        yield from solved(rows)
                    rows, key = {}, k
                if node not in rows:
                    rows[node] = members.as_py()
        if len(rows) > 1:
            yield from solved(rows)

    return run


def jaccard_links(nodes: DataFrame, likely: DataFrame, sets: DataFrame, similarity: float, weight: int = WEIGHT) -> DataFrame:
    """(a, b): links between nodes whose sets have at least this Jaccard similarity.

    `nodes` has node and size, `likely` (a, b) links of what may be alike, `sets` (node, members) the hashes of each set,
    at least once. Nodes that `likely` connects form a loose group, and within it every pair is held against the sets,
    unless other links connect it already.
    """
    loose = cut_lineage(components(likely).join(nodes.select("node", "size"), "node"))
    # Only sets of loose groups move; the bitmap of their nodes has a bound, and a set too many is dropped by the join.
    sets = within_buckets(sets, "node", bucket_bitmap(loose.select(bucket("node").alias("bucket"))))
    # A group of many shingles is dealt into chunks of half a task's weight; every two chunks meet in one task.
    chunks = loose.groupBy("root").agg(F.sum("size").alias("w")).select("root", F.when(F.col("w") <= weight, 1).otherwise(F.ceil(F.col("w") / F.lit(weight // 2))).cast("long").alias("n"))
    dealt = loose.join(chunks, "root").withColumn("c", F.pmod(F.xxhash64("node"), "n"))
    dealt = dealt.withColumn("o", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)))
    dealt = dealt.select("node", F.xxhash64("root", F.least("c", "o"), F.greatest("c", "o")).alias("key"))
    met = dealt.join(sets, "node").select("key", "node", "members")
    return met.repartition("key").sortWithinPartitions("key").mapInArrow(_verifier(similarity), "a long, b long")


def near_duplicate_groups(docs: DataFrame, words: int = STAGE["words"], similarity: float = STAGE["similarity"], sig_words: int = STAGE["sig_words"], classes: int = STAGE["classes"], text_col: str = "text", id_col: str = "doc_id", weight: int = WEIGHT) -> DataFrame:
    """(doc_id, component_id, text_hash): groups of documents whose sets of `words`-word shingles are `similarity` alike or more.

    Every link is a pair whose Jaccard similarity, worked out on the 64-bit hashes of all shingles, is `similarity` or
    more. A pair comes up for that if the index of its signatures' bytes brings it together (see `likely_links`) or if it
    meets in a loose group: at 0.8 with a probability of 0.999 for texts of many shingles. Texts without words form no
    groups.
    """
    parts = [f"s{i}" for i in range(sig_words)]
    schema = docs.select(F.col(id_col).alias("doc_id")).schema.add("text_hash", "long").add("node", "long").add("size", "long")
    for name in parts:
        schema = schema.add(name, "long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for given, texts in text_slices(batches):
            sets = shingle_sets(texts, words)
            sizes = np.array([len(s) for s in sets], np.int64)
            cols = [given.column("doc_id"), given.column("text_hash"), pa.array(set_names(sets).view(np.int64)), pa.array(sizes)]
            cols += [pa.array(np.ascontiguousarray(c).view(np.int64)) for c in signatures(sets, sig_words).T]
            yield pa.RecordBatch.from_arrays(cols, names=schema.names).filter(pa.array(sizes > 0))

    def members(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for _, texts in text_slices(batches):
            sets = [s for s in shingle_sets(texts, words) if len(s)]
            out = {n: s for n, s in zip(set_names(sets).view(np.int64).tolist(), sets, strict=True) if n not in seen}
            # Copies in a task go along once, unless it has seen too many texts to remember.
            if len(seen) > 200_000:
                seen.clear()
            seen |= out.keys()
            yield pa.RecordBatch.from_arrays([pa.array(list(out), pa.int64()), pa.array([s.tobytes() for s in out.values()], pa.binary())], names=["node", "members"])

    texts = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("binary").alias("text"))
    signed = cut_lineage(texts.select("doc_id", F.xxhash64("text").alias("text_hash"), "text").mapInArrow(run, schema))
    sets = texts.select("text").mapInArrow(members, "node long, members binary")
    return _grouped(signed, ["size", *parts], lambda nodes: jaccard_links(nodes, likely_links(nodes, sig_words, classes), sets, similarity, weight), ["text_hash"]).select("doc_id", "component_id", "text_hash")


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **how: object) -> DataFrame:
    """`docs` without the documents of each group other than the one with its least id.

    A document is an id with a text: rows that repeat an id with unlike texts are judged each by its own text, rows
    that repeat both stay or go together, and of a group's texts under its least id the one with the least hash stays.
    Rows without an id stay.
    """
    groups = near_duplicate_groups(docs, id_col=id_col, text_col=text_col, **how).filter("doc_id IS NOT NULL")
    groups = cut_lineage(groups)
    own = groups.filter("doc_id = component_id").groupBy("component_id").agg(F.min("text_hash").alias("least"))
    gone = groups.filter("doc_id <> component_id").select("doc_id", "text_hash").unionByName(
        groups.filter("doc_id = component_id").join(own, "component_id").filter("text_hash <> least").select("doc_id", "text_hash")
    )
    gone = gone.distinct().select(F.col("doc_id").alias("__gone"), F.col("text_hash").alias("__hash"))
    return docs.join(gone, (docs[id_col] == F.col("__gone")) & (F.xxhash64(docs[text_col].cast("binary")) == F.col("__hash")), "left_anti")
