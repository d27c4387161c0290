"""Near dedup of the pipeline finds its pairs by the byte-position index of SimHash signatures (F5)."""

from itertools import combinations

import numpy as np

from skein.llm.simhash import CARRIED, classed_pairs, likely_links, near_duplicate_groups, signatures


def reached(n, pairs):
    label = list(range(n))
    for _ in range(n):
        before = list(label)
        for a, b in pairs:
            label[a] = label[b] = min(label[a], label[b])
        if label == before:
            break
    return label


def test_more_positions_than_classes_hold_a_posting():
    pairs = classed_pairs(12, 3)
    assert len(pairs) == 18 and all(any(set(p) <= set(four) for p in pairs) for four in combinations(range(12), 4))


def test_differing_bits_follow_the_angle_of_long_and_short_sets():
    rng = np.random.default_rng(5)
    for shared, other in ((4, 1), (80, 20), (8, 2)):
        both = [rng.integers(0, 1 << 63, shared + other).astype(np.uint64) for _ in range(300)]
        a, b = signatures(both, 10), signatures([s[:shared] for s in both], 10)
        assert 0.13 < np.bitwise_count(a ^ b).sum() / (300 * 640) < 0.17


def test_links_are_those_that_tallied_positions_and_bits_give(spark):
    rng = np.random.default_rng(6)
    sigs = np.repeat(rng.integers(0, 1 << 63, (60, 10)), 4, axis=0).astype(np.uint64)
    flips = rng.random((240, 640)) < np.repeat(rng.uniform(0, 0.2, 240), 640).reshape(240, 640)
    sigs ^= np.packbits(flips, axis=1, bitorder="little").view(np.uint64)
    places, want = classed_pairs(80, 16), []
    of_byte = sigs.view(np.uint8)
    for a, b in combinations(range(240), 2):
        same = of_byte[a] == of_byte[b]
        few = np.bitwise_count(sigs[a, :CARRIED] ^ sigs[b, :CARRIED]).sum() <= 48
        if few and any(same[i] and same[j] and same[: 8 * CARRIED].sum() - (i < 8 * CARRIED) - (j < 8 * CARRIED) >= 1 for i, j in places):
            want.append((a, b))
    assert len(want) > 100
    nodes = spark.createDataFrame([(i, *map(int, s.view(np.int64))) for i, s in enumerate(sigs)], "node long, " + ", ".join(f"s{i} long" for i in range(10)))
    for block in (1 << 14, 3):  # the second works every posting of more rows off in chunks, with a weaker tally
        got = [(r.a, r.b) for r in likely_links(nodes, 10, 16, block=block).collect()]
        label = reached(240, want)
        assert reached(240, got) == label if block > 3 else reached(240, got + want) == reached(240, got)


def test_short_texts_at_the_threshold_are_linked(spark):
    rng = np.random.default_rng(7)
    rows = []
    for i in range(1000):
        words = [f"w{x}" for x in rng.choice(10**9, 9, replace=False)]
        rows += [(2 * i, " ".join(words)), (2 * i + 1, " ".join(words[:8]))]  # 5 shingles and 4 of them
    got = {r.doc_id: r.component_id for r in near_duplicate_groups(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert sum(got[2 * i] == got[2 * i + 1] for i in range(1000)) >= 990


def test_a_group_of_many_near_copies_keeps_few_links(spark):
    rng = np.random.default_rng(8)
    base = rng.integers(0, 1 << 63, 10).astype(np.uint64)
    flips = rng.random((600, 640)) < 0.03
    sigs = base ^ np.packbits(flips, axis=1, bitorder="little").view(np.uint64)
    nodes = spark.createDataFrame([(i, *map(int, s.view(np.int64))) for i, s in enumerate(sigs)], "node long, " + ", ".join(f"s{i} long" for i in range(10)))
    got = [(r.a, r.b) for r in likely_links(nodes, 10, 16).collect()]
    assert set(reached(600, got)) == {0} and len(got) < 2 * 600
