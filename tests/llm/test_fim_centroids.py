import hashlib
import math
import re
from fractions import Fraction

import duckdb
import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from test_queries import rows

from skein.llm import centroids, fim, queries
from skein.llm.centroids import cluster_vectors
from skein.llm.fim import Sentinels, fill_in_middle, restore


def plain_fim(i, text, seed=7, fim_rate=100, spm_rate=50):
    text = text or ""
    h = hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[k : k + 8], 16) for k in (0, 8, 16, 24))
    lines = re.findall(r"[^\n]*\n|[^\n]+", text)
    n = len(lines)
    if not text or any(s in text for s in ("<P>", "<S>", "<M>")) or h3 % 100 >= fim_rate:
        return n, "plain", None, None, text
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    p, m, s = "".join(lines[:a]), "".join(lines[a:b]), "".join(lines[b:])
    if h4 % 100 < spm_rate:
        return n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


def sha(t):
    return hashlib.sha256(t.encode()).hexdigest()


def test_fim_matches_plain_version(spark, sf_dir, texts):
    forms = set()
    for r in queries.op11_fim(spark, sf_dir).collect():
        n, form, p, m, out = plain_fim(r.doc_id, texts[r.doc_id])
        assert (r.n, r.form, r.prefix_chars, r.middle_chars, r.output_sha256, r.restored_sha256) == (n, form, p, m, sha(out), sha(texts[r.doc_id]))
        forms.add(form)
    assert forms >= {"psm", "spm"}


def test_fim_on_odd_tables(spark, odd_docs, no_docs):
    more = spark.createDataFrame(
        [(i, t) for i, t in enumerate(["\n", "\n\n\n", "a\nb", "a\r\nb c\x0bd\n", "x <M> y\nz", "<", "<P", "P>\n<", "é\n日本\n👍🏽\n" * 50, "line\n" * 200_000])], "doc_id long, text string"
    )
    for docs in (odd_docs, more, no_docs):
        made = fill_in_middle(docs)
        assert made.select("doc.*").columns == docs.columns
        back = made.withColumn("back", restore(F.col("output"), F.col("form"))).withColumn("sha", restore(F.col("output"), F.col("form"), digest_only=True))
        found = back.collect()
        assert len(found) == docs.count()
        for r in found:
            assert (r.n, r.form, r.prefix_chars, r.middle_chars, r.output) == plain_fim(r.doc.doc_id, r.doc.text)
            assert r.output_sha256 == sha(r.output) and r.back == (r.doc.text or "") and r.sha == sha(r.doc.text or "")


def test_fim_rates_and_other_sentinels(spark, documents):
    docs = documents.select("doc_id", "text")
    some = fill_in_middle(docs, fim_percent=40, spm_percent=100).collect()
    for r in some:
        assert r.output == plain_fim(r.doc.doc_id, r.doc.text, fim_rate=40, spm_rate=100)[-1]
    assert 0.2 < sum(r.form == "plain" for r in some) / len(some) < 0.85 and not any(r.form == "psm" for r in some)
    marks = Sentinels("<|fim_prefix|>", "<|fim_suffix|>", "<|fim_middle|>")
    assert all(r.back == r.doc.text for r in fill_in_middle(docs, marks).withColumn("back", restore(F.col("output"), F.col("form"), marks)).filter("doc.text IS NOT NULL").collect())
    for bad in (("<P>", "<P>", "<M>"), ("", "<S>", "<M>"), ("ab", "bc", "x"), ("a", "ab", "x"), ("aba", "c", "d")):
        with pytest.raises(ValueError):
            Sentinels(*bad)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(["a", "<", ">", "P", "S", "M", "\n", "é", "👍"]), max_size=40).map("".join), st.integers(0, 50))
def test_fim_restores_any_text(text, i):
    n, form, p, m, output, digest = fim.transform(memoryview(text.encode()), str(i), Sentinels(), 7, 100, 50, True)
    assert (n, form, p, m, output) == plain_fim(i, text) and digest == sha(output)
    names = {"P": b"<P>", "S": b"<S>", "M": b"<M>"}
    assert b"".join(fim.stream(fim.restored(output.encode(), form, names), [memoryview(output.encode())])).decode() == text


def test_a_split_keeps_the_text():
    text = memoryview(b"0123456789")
    for a in range(11):
        for b in range(a, 11):
            pieces = fim.split(fim.split([fim.Piece(0, 0, 10)], b)[:1], a)
            assert b"".join(fim.stream(pieces, [text])) == bytes(text[:b]) and bytes(text[pieces[0].start : pieces[0].end]) == bytes(text[:a])


def loop_kmeans(vectors, k=8, rounds=10, scale=1024, seed=3):
    """[(id, cluster, distance)] with Python's integers only."""
    good = [(i, [int(Fraction(float(x)) * scale // 1) for x in v]) for i, v in vectors if v is not None and len(v) == 64 and all(x is not None and math.isfinite(x) for x in v)]
    first = sorted(good, key=lambda r: (sha(f"{seed}:{'' if r[0] is None else r[0]}"), r[1]))[:k]
    centres = [v for _, v in first]
    place = lambda v: min((sum((a - b) ** 2 for a, b in zip(v, c)), n) for n, c in enumerate(centres))
    for _ in range(rounds):
        own = [place(v)[1] for _, v in good]
        for n in range(len(centres)):
            mine = [v for (_, v), o in zip(good, own) if o == n]
            if mine:
                centres[n] = [sum(c) // len(mine) for c in zip(*mine)]
    return [(i, *reversed(place(v))) for i, v in good], centres


def test_centroids_match_loops(spark, sf_dir):
    vectors = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{sf_dir}/embeddings.parquet").collect()]
    want, centres = loop_kmeans(vectors)
    inertia = sum(d for _, _, d in want)
    got = queries.op12_centroids(spark, sf_dir).collect()
    assert sorted((r.vec_id, r.cluster, r.distance) for r in got) == sorted(want)
    assert {r.inertia for r in got} == {inertia}
    for r in got:
        assert r.cluster_inertia == sum(d for _, c, d in want if c == r.cluster)
        assert r.centroid_sha256 == sha(",".join(map(str, centres[r.cluster])))


def odd_vectors():
    rng = np.random.default_rng(5)
    base = [[float(x) for x in rng.normal(size=64)] for _ in range(12)]
    out = [(i, v) for i, v in enumerate(base)] + [(3, base[3]), (3, base[4]), (None, base[5]), (50, [0.0] * 64), (51, [-0.0] * 64)]
    out += [(60, None), (61, []), (62, base[0][:63]), (63, base[0] + [1.0]), (64, base[0][:63] + [None]), (65, base[0][:63] + [math.nan]), (66, base[0][:63] + [math.inf])]
    return out


def test_centroids_on_odd_vectors(spark):
    schema = "vec_id long, embedding array<double>, id string, planes int, cluster string, v string"
    for vectors in (odd_vectors(), odd_vectors()[:3], odd_vectors()[-7:], []):
        df = spark.createDataFrame([(*v, "x", 1, "y", "z") for v in vectors], schema).repartition(3)
        want, _ = loop_kmeans(vectors)
        got = cluster_vectors(df).collect()
        key = lambda r: (str(r[0]), *r[1:])
        assert sorted(((r.id, r.cluster, r.distance) for r in got), key=key) == sorted(want, key=key)
    assert cluster_vectors(spark.createDataFrame([], schema)).count() == 0


@pytest.mark.parametrize("size", [1e-9, 2.0**13, 2.0**20, 2.0**60, 1e300])
def test_centroids_stay_exact_at_any_size(spark, size):
    rng = np.random.default_rng(2)
    vectors = [(i, [float(x) for x in rng.normal(size=64) * size]) for i in range(40)]
    want, centres = loop_kmeans(vectors, k=3, rounds=4)
    got = {r.id: r for r in cluster_vectors(spark.createDataFrame(vectors, "vec_id long, embedding array<double>"), 3, 4).collect()}
    for i, c, d in want:
        assert (got[i].cluster, got[i].distance) == (c, min(d, 2**63 - 1))
        assert got[i].centroid == ",".join(map(str, centres[c]))


@settings(max_examples=50, deadline=None)
@given(st.lists(st.lists(st.integers(-5000, 5000), min_size=64, max_size=64), min_size=2, max_size=6))
def test_plane_dot_products(vectors):
    values = np.array(vectors)
    planes = centroids.planes_needed(int(values.min()), int(values.max()))
    words = centroids.pack(values, planes)
    assert (centroids.unpack(words) == values).all()
    assert (centroids.dots(words, words[0]) == values @ values[0]).all() and (centroids.squares(words) == (values * values).sum(axis=1)).all()


@pytest.mark.parametrize("name", ["op11_fim", "op12_centroids"])
def test_new_queries_match_sql(spark, sf_dir, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    assert rows(queries.queries()[name](spark, sf_dir).toPandas()) == rows(con.execute(queries.oracle_sql()[name]).df())
