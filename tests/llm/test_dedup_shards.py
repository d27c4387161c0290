import hashlib
import re
import zlib
from collections import defaultdict
from itertools import combinations

import numpy as np
import xxhash

from skein.llm import queries
from skein.llm.exact_dedup import drop_exact_copies, exact_groups
from skein.llm.sharding import shard_by_bytes
from skein.llm.simhash import covering_triples, drop_near_duplicates, fingerprint, near_duplicate_groups, near_duplicates


def norm(t):
    return re.sub(r"[\x20\x09-\x0D]", "", t or "")


def test_exact_groups_match_brute_force(odd_docs):
    rows = odd_docs.select("doc_id", "text").collect()
    groups = defaultdict(list)
    for r in rows:
        groups[norm(r.text)].append((-len(r.text or ""), r.doc_id is None, r.doc_id or 0, r.doc_id))
    got = exact_groups(odd_docs, digest_all=True).select("doc.doc_id", "doc.text", "keep_id", "group_size", "kept", "digest").collect()
    assert len(got) == len(rows)
    for r in got:
        group = groups[norm(r.text)]
        best = min(group)
        assert r.group_size == len(group) and r.keep_id == best[3]
        assert r.kept == (r.doc_id == best[3] and -len(r.text or "") == best[0])
        assert r.digest == hashlib.sha256(norm(r.text).encode()).hexdigest()


def test_exact_copies_leave_one_row_each(odd_docs, no_docs):
    left = drop_exact_copies(odd_docs)
    assert left.columns == odd_docs.columns
    kept = [norm(r.text) for r in left.collect()]
    assert sorted(kept) == sorted({norm(r.text) for r in odd_docs.select("text").collect()})
    assert drop_exact_copies(no_docs).count() == 0


def test_shards_are_contiguous_balanced_and_gapless(spark, sf_dir, odd_docs, no_docs):
    rows = sorted(queries.op3_sharding(spark, sf_dir).collect(), key=lambda r: r.doc_id)
    docs = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    total, at, slots = sum(len(t.encode()) + 1 for t in docs.values()), 0, defaultdict(int)
    for r in rows:
        raw = docs[r.doc_id].encode()
        assert (r.size, r.text_crc32, r.law, r.grown_shard) == (len(raw) + 1, zlib.crc32(raw), "bytes", None)
        assert r.shard == min(15, (2 * at + r.size) * 16 // (2 * total)) and r.slot == slots[r.shard]
        slots[r.shard] += 1
        at += r.size
    odd = shard_by_bytes(odd_docs, 4).collect()
    assert len(odd) == odd_docs.count() and {r.size for r in odd if r.doc_id == 1} == {1}
    for s in {r.shard for r in odd}:
        assert sorted(r.slot for r in odd if r.shard == s) == list(range(sum(r.shard == s for r in odd)))
    assert shard_by_bytes(no_docs).count() == 0


def brute_fingerprint(text):
    words = re.findall(rb"[^\x20\x09-\x0D]+", re.sub(rb"[A-Z]", lambda m: m[0].lower(), (text or "").encode()))
    if not words:
        return 0
    k = min(4, len(words))
    h = [xxhash.xxh64_intdigest(b" ".join(words[i : i + k]), 42) for i in range(len(words) - k + 1)]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def components(ids, near):
    root = {i: i for i in ids}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in near:
        x, y = find(a), find(b)
        root[max(x, y)] = min(x, y)
    return {i: find(i) for i in ids}


def test_any_four_positions_hold_a_chosen_triple():
    triples = covering_triples(8)
    assert len(triples) == 20
    assert all(any(set(t) <= set(four) for t in triples) for four in combinations(range(8), 4))


def test_near_duplicates_match_brute_force(documents, texts, odd_docs, no_docs):
    assert all(fingerprint(t.encode()) == brute_fingerprint(t) for t in list(texts.values())[:60])
    ids = sorted(texts)
    prints = np.array([fingerprint(texts[i].encode()) for i in ids], np.uint64)
    pairs = [(ids[a], ids[b]) for a in range(len(ids)) for b in np.flatnonzero(np.bitwise_count(prints ^ prints[a]) <= 4).tolist() if b > a]
    want = components(ids, pairs)
    for block in (1024, 4):  # the second works every larger posting off in chunks
        got = {r.doc_id: r for r in near_duplicates(documents, block=block).collect()}
        assert {i: r.component_id for i, r in got.items()} == want
        assert all(int(got[i].fingerprint, 16) == p for i, p in zip(ids, prints.tolist(), strict=True))
    odd = near_duplicates(odd_docs).collect()
    assert len(odd) == odd_docs.count() and {r.fingerprint for r in odd if r.doc_id in (1, 2, 3)} == {"0" * 16}
    assert near_duplicates(no_docs).count() == 0


def test_dense_posting_in_chunks_keeps_every_link(spark):
    rng = np.random.default_rng(2)
    base = "the quick brown fox jumps over the lazy dog near the river bank on a cold day in spring ".split() * 12
    rows = []
    for i in range(300):
        words = list(base)
        for at in rng.choice(len(words), 3, replace=False):
            words[at] = f"w{rng.integers(1_000_000)}"
        rows.append((i, " ".join(words)))
    prints = np.array([fingerprint(t.encode()) for _, t in rows], np.uint64)
    pairs = [(a, b) for a in range(300) for b in np.flatnonzero(np.bitwise_count(prints ^ prints[a]) <= 4).tolist() if b > a]
    want = components(range(300), pairs)
    got = near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), block=16).collect()
    assert {r.doc_id: r.component_id for r in got} == want


def pairs_alike(rng, lengths, changes, first=0):
    """Pairs of texts with exactly known Jaccard similarity: words are all different, and spaced-out words change."""
    rows, alike = [], {}
    for n, m in zip(lengths, changes, strict=True):
        words = [f"w{x}" for x in rng.choice(10**9, n, replace=False)]
        other = list(words)
        for j in range(m):
            other[5 + 10 * j] = f"v{rng.integers(10**9)}"
        i = first + 2 * len(alike)
        rows += [(i, " ".join(words)), (i + 1, " ".join(other))]
        alike[i] = (n - 4 - 5 * m) / (n - 4 + 5 * m)
    return rows, alike


def test_corpus_stage_links_pairs_from_the_threshold_up_and_none_below(spark):
    rng = np.random.default_rng(11)
    lengths = rng.integers(104, 320, 1200)
    # Shares of changed shingles from 0.06 to 0.16; one of 1/9 is a similarity of 0.8.
    changes = [max(1, round((n - 4) * s / 5)) for n, s in zip(lengths.tolist(), rng.uniform(0.06, 0.16, 1200), strict=True)]
    rows, alike = pairs_alike(rng, [*lengths.tolist(), *[94] * 300], [*changes, *[2] * 300])
    assert alike[2400] == 0.8 and sum(0.7 < x < 0.8 for x in alike.values()) > 200
    group = {r.doc_id: r.component_id for r in near_duplicate_groups(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    linked = {i for i in alike if group[i] == group[i + 1]}
    assert not [x for i, x in alike.items() if i in linked and x < 0.8]
    assert all(group[i] == i for i in alike)
    for low, high in ((0.8, 0.801), (0.8, 0.85), (0.85, 0.9)):
        near = [i for i, x in alike.items() if low <= x < high]
        assert len(near) > 100 and sum(i in linked for i in near) >= 0.99 * len(near)


def test_corpus_stage_verifies_large_groups_in_chunks(spark):
    rng = np.random.default_rng(12)
    base = [f"b{i}" for i in range(120)]
    rows, sets = [], []
    for i in range(150):
        words = list(base)
        for at in rng.choice(24, rng.integers(0, 8), replace=False):
            words[5 * at] = f"x{rng.integers(10**9)}"
        rows.append((i, " ".join(words)))
        sets.append({tuple(words[a : a + 5]) for a in range(116)})
    pairs = [(a, b) for b in range(150) for a in range(b) if len(sets[a] & sets[b]) / len(sets[a] | sets[b]) >= 0.8]
    want = components(range(150), pairs)
    assert len(set(want.values())) > 10
    for weight in (1 << 19, 2000):
        got = near_duplicate_groups(spark.createDataFrame(rows, "doc_id long, text string"), weight=weight).collect()
        assert {r.doc_id: r.component_id for r in got} == want


def test_corpus_stage_finds_similar_texts_and_leaves_others(documents, texts, odd_docs, no_docs):
    ids = sorted(texts)
    sets = []
    for i in ids:
        w = texts[i].encode().lower().split()
        k = min(5, len(w))
        sets.append({tuple(w[a : a + k]) for a in range(len(w) - k + 1)} if w else set())
    group = {r.doc_id: r.component_id for r in near_duplicate_groups(documents).collect()}
    close, missed, far = 0, 0, 0
    for a in range(len(ids)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            alike = both / (len(sets[a]) + len(sets[b]) - both) if both else 0
            same = group.get(ids[a], -1) == group.get(ids[b], -2)
            close += alike >= 0.9
            missed += alike >= 0.9 and not same
            far += alike < 0.5 and same
    assert close and missed <= 0.02 * close and not far
    left = drop_near_duplicates(odd_docs)
    assert left.columns == odd_docs.columns
    kept = [r.doc_id for r in left.collect()]
    assert {1, 2, 3, None} <= set(kept) and 6 in kept and 11 not in kept and kept.count(4) == 2
    assert drop_near_duplicates(no_docs).count() == 0
