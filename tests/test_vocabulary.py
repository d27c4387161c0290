"""The vocabulary of words and neighbouring pairs against a plain count, whichever way pairs are counted."""

import random
from collections import Counter

import pytest

from skein.operators import routing


def plain_vocabulary(docs, size):
    total, df = Counter(), Counter()
    for w in docs:
        own = [*(w or ()), *map(" ".join, zip(w or (), (w or ())[1:], strict=False))]
        total.update(own)
        df.update(set(own))
    return {(t, df[t]) for t in sorted(total, key=lambda t: (-total[t], t))[:size]}


@pytest.mark.parametrize("size", [1, 7, 40, 100_000])
@pytest.mark.parametrize("known_words", [5, 1000])
def test_vocabulary_with_equal_counts_at_its_end(spark, size, known_words):
    rng = random.Random(size)
    names = ["über", "b", "a", "aa", "zz", "日本", "ab_1"] + [f"w{i}" for i in range(60)]
    docs = [None, [], ["a"], ["once"], ["a", "a", "a"]] + [rng.choices(names, [1 / (i + 1) for i in range(len(names))], k=rng.randrange(30)) for _ in range(60)]
    tokens = spark.createDataFrame([(w,) for w in docs], "w array<string>").repartition(3)
    assert {(r.term, r.df) for r in routing.vocabulary(tokens, size, known_words).collect()} == plain_vocabulary(docs, size)


def test_only_pairs_of_frequent_words_are_counted(spark):
    tokens = spark.createDataFrame([(["a", "b", "a", "b", f"x{i}", f"y{i}", "a"],) for i in range(50)] + [(["b"],), (None,), (["a", "b"],)], "w array<string>").coalesce(1)
    assert sorted(tuple(r) for r in routing.pair_totals(tokens, ["a", "b"]).collect()) == [("a b", 101, 51), ("b a", 50, 50)]
    assert {tuple(r) for r in routing.word_totals(tokens).filter("total > 1").collect()} == {("a", 151, 51), ("b", 102, 52)}
    assert routing.vocabulary(tokens.limit(0), 5).count() == 0


def test_classes_of_few_rows_and_of_rows_without_terms(spark):
    rows = spark.createDataFrame([(1, "x", "red red car"), (2, "x", "red car"), (3, None, "blue boat"), (4, "y", None), (5, "y", "!"), (6, None, "blue boat boat")], "id long, label string, text string")
    got = {r.id: (r.label, r.predicted, r.cosine > 0.9) for r in routing.centroid_classes(rows, least_corpus=0).collect()}
    assert got == {1: ("x", "x", True), 2: ("x", "x", True), 3: (None, None, True), 6: (None, None, True)}
    assert routing.centroid_classes(rows.filter("id = 5"), least_corpus=0).count() == 0
