"""The keyword index against sums over all documents, in many shards, with ties, and what it skips."""

import math
import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from skein.operators import retrieve
from skein.operators.keyword_index import build_index, open_index, search

WORDS = re.compile(r"[^\W]{2,}")


def plain_bm25(docs, queries, k, k1=1.2, b=0.75):
    held = {i: Counter(WORDS.findall((t or "").lower())) for i, t in docs}
    lens = {i: sum(c.values()) for i, c in held.items()}
    known = [lens[i] for i, t in docs if t is not None]
    mean = sum(known) / len(known) if known else 0
    df = Counter(w for c in held.values() for w in c)
    out = {}
    for q, text in queries:
        scores = {}
        for w in set(WORDS.findall((text or "").lower())):
            for i, c in held.items():
                if c[w]:
                    idf = math.log(1 + (len(docs) - df[w] + 0.5) / (df[w] + 0.5))
                    scores[i] = scores.get(i, 0) + idf * c[w] * (k1 + 1) / (c[w] + k1 * (1 - b + b * lens[i] / mean))
        out[q] = sorted(((-round(s, 6), i) for i, s in scores.items()))[:k]
    return out


def corpus(n, seed=1):
    rng = random.Random(seed)
    vocabulary = [f"w{k}" for k in range(300)]
    weights = [1 / (k + 1) for k in range(300)]
    docs = [(i, " ".join(rng.choices(vocabulary, weights, k=rng.choice((0, 1, 3, 20, 60, 200))))) for i in range(n)]
    return docs + [(n + k, docs[k][1]) for k in range(40)] + [(n + 50, None), (n + 51, ""), (n + 52, "é日 Ünder_score X yz"), (n + 53, "a b c")]


@pytest.mark.parametrize("shard_docs", [8192, 100, 1])
def test_same_rows_as_sums_over_all_documents(spark, shard_docs):
    docs = corpus(700)
    queries = [(0, "w0 w1 w299"), (1, "w3 w3 W250 nothere"), (2, ""), (3, None), (4, "ünder_score"), (5, " ".join(f"w{k}" for k in range(60))), (6, "nothere"), (7, "w0")]
    df = spark.createDataFrame(docs, "id long, text string").repartition(3)
    asked = spark.createDataFrame(queries, "query_id long, text string")
    index = build_index(df, shard_docs=shard_docs)
    for k in (1, 3, 10, 5000):
        want = plain_bm25(docs, queries, k)
        got = {}
        for r in retrieve.bm25_top_k(asked, None, k, index=index).orderBy("query_id", "rank").collect():
            got.setdefault(r.query_id, []).append((r.bm25, r.id))
        for q, rows in want.items():
            assert [i for _, i in got.get(q, [])] == [i for _, i in rows]
            assert all(abs(a + b) < 2e-6 for (a, _), (b, _) in zip(got.get(q, []), rows))


def test_skips_blocks_and_is_opened_again(spark, tmp_path):
    rng = random.Random(2)
    docs = [(i, " ".join(["common"] * rng.randrange(1, 4) + ["filler"] * rng.randrange(1, 400) + (["rare"] if i % 997 == 0 else []))) for i in range(6000)]
    df = spark.createDataFrame([(str(i), t) for i, t in docs], "id string, text string").coalesce(1)
    index = build_index(df, f"{tmp_path}/index")
    again = open_index(spark, f"{tmp_path}/index")
    assert (index.n_docs, index.mean_length) == (again.n_docs, again.mean_length) and again.n_docs == 6000
    asked = spark.createDataFrame([("a", "common rare"), ("b", "common"), ("c", "filler common rare")], "query_id string, text string")
    terms = asked.select("query_id", F.split("text", " ").alias("terms"))
    seen = {r.query_id: (r.blocks, r.scored) for r in search(terms, again, 5, 1.2, 0.75).groupBy("query_id").agg(F.max("blocks").alias("blocks"), F.max("scored").alias("scored")).collect()}
    assert all(scored <= blocks for blocks, scored in seen.values()) and min(s / b for b, s in seen.values()) < 0.5, seen
    want = plain_bm25([(str(i), t) for i, t in docs], [("a", "common rare"), ("b", "common"), ("c", "filler common rare")], 5)
    for r in retrieve.bm25_top_k(asked, None, 5, index=again).collect():
        assert want[r.query_id][r.rank - 1][1] == r.id


def test_empty_tables(spark):
    none, some = spark.createDataFrame([], "id long, text string"), spark.createDataFrame([(1, "one two"), (2, None)], "id long, text string")
    asked = spark.createDataFrame([(1, "one")], "query_id long, text string")
    assert retrieve.bm25_top_k(asked, none).count() == 0 == retrieve.bm25_top_k(asked.limit(0), some).count()
    assert retrieve.bm25_top_k(asked, some.filter("id = 2")).count() == 0
    assert [(r.id, r.rank, r.score) for r in retrieve.bm25_top_k(asked, some).collect()] == [(1, 1, 1.0)]


def test_queries_in_blocks(spark, monkeypatch):
    docs, queries = corpus(200), [(q, f"w{q} w{q + 1}") for q in range(30)]
    df, asked = spark.createDataFrame(docs, "id long, text string"), spark.createDataFrame(queries, "query_id long, text string")
    monkeypatch.setattr(retrieve.in_query_blocks, "__defaults__", (200,))
    want = plain_bm25(docs, queries, 4)
    got = {(r.query_id, r.rank): r.id for r in retrieve.bm25_top_k(asked, df, 4).collect()}
    assert got == {(q, n): i for q, rows in want.items() for n, (_, i) in enumerate(rows, 1)}
