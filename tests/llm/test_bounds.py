"""Bounds of training samples at any size, and rows with repeated ids or columns that can't be hashed."""

import numpy as np
from pyspark.sql import functions as F

import corpus_pipeline
from skein.llm.common import hash_rank, rank_bound
from skein.llm.decontaminate import contamination
from skein.llm.exact_dedup import drop_exact_copies
from skein.llm.hashed import labelled_sample, within_budget
from skein.llm.lang_id import WINDOW, few_windows, train_language_id
from skein.llm.simhash import drop_near_duplicates


def test_shares_hold_at_any_count(spark):
    for total in (1, 599, 600, 601, 10**6, 3 * 10**8, 6 * 10**8, 10**10, 10**15):
        share = rank_bound(600, total) / 2**63
        assert abs(share - min(1, 600 / total)) <= 1e-12 * min(1, 600 / total) + 2**-62
    # Of a million ids, those under the bound for ten thousand million are about as many as their share says.
    ranks = spark.range(1_000_000).select(hash_rank(F.col("id"), 13).alias("r"))
    bound = rank_bound(6_000_000, 10**10)
    assert 500 < ranks.filter(F.col("r") <= bound).count() < 700
    assert ranks.filter((F.col("r") < 0) | (F.col("r") > (1 << 63) - 1)).count() == 0


def test_budget_of_a_class():
    assert within_budget([(5, 10), (1, 10), (3, 10)], 25) == 3
    assert within_budget([(5, 10), (1, 100), (3, 10)], 25) == 5
    assert within_budget([(1, 100)], 25) == -1 and within_budget([], 25) == -1


def test_sample_is_bounded_by_bytes(spark):
    docs = spark.createDataFrame([(i, "x" * 100) for i in range(200)] + [(7, "y" * 5000)] * 3 + [(300, None), (None, "z")], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(301)] + [(3, 0)], "doc_id long, quality int")
    texts, y = labelled_sample(docs, labels, "quality", 1000, 2000)
    assert len(texts) == 40 and set(texts) == {b"x" * 100} and np.bincount(y.astype(int)).tolist() == [20, 20]
    whole, _ = labelled_sample(docs, labels, "quality", 1000, 10**6)
    assert len(whole) == 203


def test_windows_are_cut_from_whole_texts():
    text = bytes(range(256)) * 50 + b"end"
    cut = few_windows(text, 6)
    assert 5 * WINDOW < len(cut) <= 6 * WINDOW and few_windows(b"abc", 6) == b"abc"
    windows = [text[k : k + WINDOW] for k in range(0, len(text), WINDOW)]
    assert all(cut[k : k + WINDOW] in windows for k in range(0, len(cut), WINDOW))


def test_long_texts_are_learned_from(spark):
    rows = [(i, ("the cat sat on the mat " if i % 2 else "le chat est sur la table ") * 20_000, "en" if i % 2 else "fr") for i in range(12)]
    net = train_language_id(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert net.languages == ["en", "fr"]


def test_a_repeated_id_loses_no_other_text(spark):
    a = " ".join(f"w{i}" for i in range(200))
    b = " ".join(f"other{i}" for i in range(200))
    schema = "doc_id long, text string"
    got = drop_near_duplicates(spark.createDataFrame([(1, a), (2, a + " more"), (2, b)], schema))
    assert sorted((r.doc_id, r.text) for r in got.collect()) == [(1, a), (2, b)]
    # Near copies under one id are one group: one text of it stays, and repeated rows stay together.
    got = [r.text for r in drop_near_duplicates(spark.createDataFrame([(1, a), (1, a + " more"), (5, b), (5, b)], schema)).collect()]
    assert len(got) == 3 and got.count(b) == 2


def test_columns_of_every_kind_go_through(spark, sf_dir):
    odd = spark.sql(
        """SELECT id AS doc_id, concat('some words of a text that repeat ', id % 3) AS text, map('k', id) AS doc, named_struct('m', map(id, array(map(1, 2)))) AS hash,
                  parse_json('{"a": 1}') AS survives, array(named_struct('x', CAST(CAST(id AS string) AS binary))) AS text_hash FROM range(12)"""
    )
    kept = drop_exact_copies(odd)
    assert kept.columns == odd.columns and sorted(r.doc_id for r in kept.select("doc_id").collect()) == [0, 1, 2]
    bench = spark.createDataFrame([(1, "some words of a text"), (2, "that repeat 1"), (3, None)], "item_id long, text string")
    for block in (1 << 20, 8):
        found = {r["doc_id"]: r["n_hit"] for r in contamination(odd, bench, block_bytes=block).select("doc.doc_id", "n_hit").collect()}
        assert found == {i: 8 if i % 3 == 1 else 5 for i in range(12)}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, odd, sf_dir)
        assert name == "packing" or out.columns == odd.columns
        out.count()
