import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from skein.llm import queries
from skein.llm.hashed import Ftrl, batches_of, ngram_features
from skein.llm.lang_id import Network, document_probabilities, gradients, identify, new_network, train, train_language_id, windows_of
from skein.llm.lm import PACKED, Seeds, classed_words, exchange, neighbour_classes, score, seed_classes, summarise, word_counts, word_table
from skein.llm.quality import keep_quality, score_quality, train_quality
from skein.llm.text import BY_LETTER, BY_SPACE, joined_words
from skein.llm.toxicity import category_labels, fit_chain, predict_chain, score_toxicity, train_toxicity


def held_out(i, m):
    return zlib.crc32(str(i).encode()) % m == 2


def test_word_hashes_agree_with_words():
    texts = [b"", b" A bc, d\tbc ", "Ünï bc".encode(), b"bc"]
    for table in (BY_SPACE, BY_LETTER):
        buffer, starts, ends, hashes, owner = joined_words(texts, table)
        words = [buffer[a:b] for a, b in zip(starts, ends, strict=True)]
        assert words == [w for t in texts for w in t.translate(table).split()]
        assert owner.tolist() == [i for i, t in enumerate(texts) for _ in t.translate(table).split()]
        assert len(set(hashes.tolist())) == len(set(words)) and len({(w, h) for w, h in zip(words, hashes.tolist(), strict=True)}) == len(set(words))


def test_gradients_match_differences():
    net, rng = new_network(["a", "b"], 3), np.random.default_rng(0)
    x, y = rng.integers(0, 257, (6, 5)), np.array([0, 1, 0, 1, 1])
    grads = gradients(net, x, y)[1]
    for name, at in (("u", (0, 1, 2)), ("u", (1, 4, 0)), ("v", (0, 1)), ("table", (0, int(x[1, 1] % 256), 4)), ("table", (1, int(x[2, 2] % 256), 1))):
        a, keep = getattr(net, name), getattr(net, name)[at]
        a[at] = keep + 1e-2
        up = gradients(net, x, y)[0]
        a[at] = keep - 1e-2
        down = gradients(net, x, y)[0]
        a[at] = keep
        assert grads[name][at] == pytest.approx((up - down) / 2e-2, rel=0.05, abs=2e-5)


def test_every_byte_is_read():
    x, owner = windows_of([b"", b"a" * 128, b"b" * 129])
    assert x.shape == (128, 3) and owner.tolist() == [1, 2, 2] and (x != 256).sum() == 257
    net = train([b"aaaa bbbb " * 20, b"cccc dddd " * 20] * 4, ["x", "y"] * 4, epochs=20, least_steps=60)
    p = document_probabilities(net, [b"aaaa " * 9, b"dddd " * 9, b""])
    assert p[0].argmax() == 0 and p[1].argmax() == 1 and p[2].sum() == 0
    assert p[0].sum() == pytest.approx(1, abs=1e-4)


def test_language_query_on_held_out_documents(spark, sf_dir, documents, odd_docs, no_docs):
    want = {r.doc_id: r.lang for r in documents.collect()}
    rows = queries.op1_language_id(spark, sf_dir).collect()
    assert len(rows) == len(want) and all(r.held_out == held_out(r.doc_id, 4) and 0 <= r.score <= 1 for r in rows)
    own = [r for r in rows if r.held_out]
    assert sum(r.lang_pred == want[r.doc_id] for r in own) >= 0.9 * len(own)
    odd = {r.doc_id: r for r in identify(odd_docs, train_language_id(documents)).select("doc.doc_id", "lang_pred", "score").collect()}
    assert {odd[i].lang_pred for i in (1, 2, 3, 12)} == {"und"} and odd[4].lang_pred != "und"
    nothing = train_language_id(no_docs)
    assert isinstance(nothing, Network) and {r.lang_pred for r in identify(odd_docs, nothing).collect()} == {"und"}
    assert identify(no_docs, nothing).count() == 0


def test_ftrl_learns_and_ties_break_alike():
    texts, y = [b"good fine words here"] * 20 + [b"bad &&& words &&& here"] * 20, np.array([1] * 20 + [0] * 20, np.float32)
    rows = ngram_features(texts, 16)
    p = Ftrl(bits=16, alpha=1.0, l1=0.1).fit(rows, y, epochs=5).predict(rows)
    assert (p[:20] > 0.7).all() and (p[20:] < 0.3).all()


def test_quality_query_on_held_out_documents(spark, documents, odd_docs, no_docs, few_labels):
    big = "/root/testdata/sf0.01"
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{big}/labels.parquet").collect()}
    rows = queries.op4_quality(spark, big).collect()
    assert len(rows) == 1000 and all(r.held_out == held_out(r.doc_id, 4) and r.predicted == int(r.score >= 0.7) for r in rows)
    own = [(r.score, labels[r.doc_id]) for r in rows if r.held_out and r.doc_id in labels]
    good, bad = [s for s, q in own if q], [s for s, q in own if not q]
    assert sum(a > b for a in good for b in bad) >= 0.95 * len(good) * len(bad)
    model = train_quality(odd_docs, few_labels)
    odd = score_quality(odd_docs, model)
    assert odd.count() == odd_docs.count() and all(0 <= r.score <= 1 for r in odd.select("score").collect())
    assert keep_quality(odd_docs, few_labels).columns == odd_docs.columns
    assert {r.score for r in score_quality(odd_docs, train_quality(no_docs, few_labels.limit(0))).collect()} == {0.5}
    assert score_quality(no_docs, model).count() == 0


def test_toxicity_query_on_held_out_documents(spark, odd_docs, no_docs, few_labels):
    big = "/root/testdata/sf0.1"
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{big}/labels.parquet").collect()}
    rows = queries.op10_toxicity(spark, big).collect()
    assert len(rows) == 10_000
    own = [(r.predicted, labels[r.doc_id]) for r in rows if r.held_out and r.doc_id in labels]
    toxic = [p for p, t in own if t]
    assert sum(toxic) >= 0.8 * len(toxic) and sum(p for p, t in own if not t) <= 0.01 * len(own)
    chain = train_toxicity(odd_docs, few_labels)
    assert score_toxicity(odd_docs, chain).count() == odd_docs.count() and score_toxicity(no_docs, chain).count() == 0
    assert train_toxicity(no_docs, few_labels.limit(0))


def word_rows(texts):
    return [(np.unique([zlib.crc32(w) % 1000 for w in t.split()]).astype(np.int32), np.ones(len({zlib.crc32(w) % 1000 for w in t.split()}), np.float32)) for t in texts]


def test_kinds_are_clusters_of_toxic_texts_and_feed_the_chain():
    texts = [b"you idiot moron", b"scum and trash here", b"pathetic awful rot", b"kind words here", b"you and all"] * 40
    toxic = np.array([1, 1, 1, 0, 0] * 40, np.float32)
    rows = word_rows(texts)
    batches = batches_of(rows)
    y = category_labels(rows, batches, toxic, 10)
    assert sorted(map(tuple, y[:3].tolist())) == [(0, 0, 1, 1), (0, 1, 0, 1), (1, 0, 0, 1)] and not y[3:5].any()
    assert (y == np.tile(y[:5], (40, 1))).all()
    chain = fit_chain(batches, y, np.array([zlib.crc32(t) % 3 for t in texts]), 10, epochs=20)
    assert [m.dense for m in chain] == [0, 1, 2, 3]
    p = predict_chain(chain, rows)
    assert p[toxic == 1, -1].min() > p[toxic == 0, -1].max()
    for i in range(5):  # the same in loops
        before = []
        for m in chain:
            margin = sum(float(m.weights[k]) for k in rows[i][0]) + float(m.weights[1 << 10]) + sum(float(w) * x for w, x in zip(m.weights[(1 << 10) + 1 :], before, strict=True))
            before.append(1 / (1 + math.exp(-margin)))
        assert p[i].tolist() == pytest.approx(before, abs=1e-5)


def test_learning_in_batches_matches_loops():
    """One step a batch: gradients and their squares are summed over its rows, weights solved before and after."""
    texts = [b"a b", b"b c", b"c d a", b"d"] * 5
    rows, y, dense = word_rows(texts), np.array([1, 0, 1, 0] * 5, np.float32), np.linspace(0, 1, 20, dtype=np.float32)[:, None]
    learn = np.arange(20) % 4 != 3
    batches = batches_of(rows, size=3)
    model = Ftrl(bits=10, dense=1, alpha=0.5, l1=0.1, l2=0.3).fit(batches, y, dense, epochs=2, seed=4, learn=learn)
    z, n, rng = Counter(), Counter(), np.random.default_rng(4)
    solve = lambda k: 0.0 if abs(z[k]) <= (0.1 if k < 1024 else 0) else (math.copysign(0.1 if k < 1024 else 0, z[k]) - z[k]) / ((1 + math.sqrt(n[k])) / 0.5 + 0.3)
    for _ in range(2):
        for b in rng.permutation(len(batches)).tolist():
            g, g2 = Counter(), Counter()
            for i in batches[b].own.tolist():
                x = {int(k): 1.0 for k in rows[i][0]} | {1024: 1.0, 1025: float(dense[i, 0])}
                error = (1 / (1 + math.exp(-sum(solve(k) * v for k, v in x.items()))) - y[i]) * learn[i]
                for k, v in x.items():
                    g[k] += error * v
                    g2[k] += (error * v) ** 2
            step = {k: (z[k] + g[k] - (math.sqrt(n[k] + g2[k]) - math.sqrt(n[k])) / 0.5 * solve(k), n[k] + g2[k]) for k in g}
            for k, (a, c) in step.items():
                z[k], n[k] = a, c
    for k in g:
        assert model.weights[k] == pytest.approx(solve(k), abs=1e-4)


def test_language_network_matches_loops():
    """Gate, candidate and pooled softmax once more, byte by byte."""
    net = new_network(["a", "b", "c"], 4)
    texts = [b"hello w\xc3\xb6rld", b"x" * 200, b"one two three " * 30]
    squash = lambda x: x / (1 + abs(x))
    for text, got in zip(texts, document_probabilities(net, texts), strict=True):
        total = np.zeros(3)
        for first in range(0, len(text), 128):
            part, states = text[first : first + 128], {}
            for side, order in ((0, range(len(part))), (1, range(len(part) - 1, -1, -1))):
                h = np.zeros(4)
                for i in order:
                    a = squash(net.u[side].astype(float) @ h + net.table[side, part[i]])
                    gate, candidate = 0.5 + 0.5 * a[:4], a[4:]
                    h = h + gate * (candidate - h)
                    states[side, i] = h
            for i in range(len(part)):
                e = np.exp(net.v[:, :-1] @ np.concatenate([states[0, i], states[1, i]]) + net.v[:, -1])
                total += e / e.sum()
        assert got == pytest.approx(total / len(text), abs=1e-4)


def test_exchange_finds_two_kinds_of_words():
    # Nodes 1-6: 1-3 are followed by 4-6 and the other way round.
    pairs = np.zeros((8, 8))
    rng = np.random.default_rng(1)
    for a in (1, 2, 3):
        for b in (4, 5, 6):
            pairs[a, b], pairs[b, a] = rng.integers(20, 40, 2)
    own = exchange(pairs, 6, 2)
    assert len(set(own[1:4])) == 1 and len(set(own[4:7])) == 1 and own[1] != own[4]
    assert len({own[0], own[7], own[1], own[4]}) == 4


def test_lm_scores(spark, sf_dir, texts, odd_docs, no_docs):
    tokens = lambda t: re.findall(rb"[^\x20\x09-\x0D]+", (t or "").encode().lower()) + [b""]
    counts = Counter(w for i, t in texts.items() if not held_out(i, 7) for w in tokens(t))
    n, v = sum(counts.values()), len(counts)
    rows = queries.op5_lm_scoring(spark, sf_dir).collect()
    assert len(rows) == len(texts)
    for r in rows:
        w = tokens(texts[r.doc_id])
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held_out(r.doc_id, 7), len(w), sum(counts[x] > 0 for x in w), n)
        assert r.base_score == pytest.approx(sum(math.log10((counts[x] + 1) / (n + v + 1)) for x in w), abs=1e-6)
    own = [r for r in rows if r.held_out]
    assert sum(r.score for r in own) > sum(r.base_score for r in own)
    learned = F.col("doc_id").isNull() | (F.col("doc_id") != 4)
    wide = sorted(tuple(r) for r in score(odd_docs, learned, exchange_words=1, classes=2).fillna(-1, "doc_id").collect())
    narrow = sorted(tuple(r) for r in score(odd_docs, learned, exchange_words=1, classes=2, table_words=3).fillna(-1, "doc_id").collect())
    assert len(wide) == odd_docs.count() and all(r[5] <= 0 and r[1] >= 1 for r in wide)
    assert [r[:4] for r in wide] == [r[:4] for r in narrow]
    assert np.allclose([r[4:] for r in wide], [r[4:] for r in narrow])  # the table is a cache, no part of the model
    assert score(no_docs, F.lit(True)).count() == 0
    assert {r.n_known for r in score(odd_docs, F.lit(False)).collect()} == {0}


def plain_scores(texts, learn, seeds, totals_of_classes):
    """The class model once more, in loops: the seeds' classes are given, all else follows from the texts."""
    k = len(seeds.size)
    tokens = {i: t.encode().lower().split() for i, t in texts.items()}
    counts = Counter(w for i in learn for w in [*tokens[i], b""])
    around = {w: Counter() for w in counts}
    for i in learn:
        row = [b"", *tokens[i], b""]
        for a, b in zip(row, row[1:], strict=False):
            if b not in seeds.class_of and a in seeds.class_of:
                around[b][("left", seeds.class_of[a])] += 1
            if a not in seeds.class_of and b in seeds.class_of:
                around[a][("right", seeds.class_of[b])] += 1
    classes = {}
    for w, c in counts.items():
        if w in seeds.class_of:
            classes[w] = seeds.class_of[w]
        elif c == 1:
            classes[w] = k
        else:
            gain = [sum(n * (seeds.left if side == "left" else seeds.right)[x, b] for (side, x), n in around[w].items()) + 1e-6 * math.log(seeds.size[b]) for b in range(1, k)]
            classes[w] = 1 + gain.index(max(gain))
    totals, moves = Counter(), Counter()
    for w, c in counts.items():
        totals[classes[w]] += c
    for i in learn:
        row = [0, *(classes[w] for w in tokens[i]), 0]
        moves.update(zip(row, row[1:], strict=False))
    arrivals, everything = Counter(), sum(moves.values())
    leaving = Counter()
    for (a, b), n in moves.items():
        arrivals[b] += n
        leaving[a] += n
    share = lambda b: (arrivals[b] + 0.5) / (everything + 0.5 * (k + 1))
    move = lambda a, b: (moves[a, b] + 5 * share(b)) / (leaving[a] + 5)
    once, twice = (sum(c == x for c in counts.values()) for x in (1, 2))
    discount = once / (once + 2 * twice) if 0 < once < once + twice else 0.5
    for a in range(k + 1):
        assert sum(move(a, b) for b in range(k + 1)) == pytest.approx(1)
    given = lambda w: discount if counts[w] == 0 and once else 1.0 if counts[w] == 0 else (counts[w] - (discount if classes[w] == k else 0)) / totals[classes[w]]
    for b in range(k + 1):
        own = sum(given(w) for w in counts if classes[w] == b) + (given(b"never seen") if b == k else 0)
        assert own == pytest.approx(1) or not totals[b]
    assert all(totals[b] == n for b, n in enumerate(totals_of_classes))
    out = {}
    for i, words in tokens.items():
        row = [*words, b""]
        at = [0, *(classes.get(w, k) for w in words), 0]
        out[i] = sum(math.log10(move(a, b)) for a, b in zip(at, at[1:], strict=False)) + sum(math.log10(given(w)) for w in row)
    return out


def test_lm_matches_a_plain_version_whose_probabilities_add_up(spark, documents, texts):
    small = documents.filter("doc_id < 80").select("doc_id", "text")
    own = {i: t for i, t in texts.items() if i < 80}
    learn = [i for i in own if i % 5]
    training = small.filter("doc_id % 5 <> 0").select(F.col("text").cast("binary").alias("text")).fillna("")
    vocabulary = word_counts(training).cache()
    vocab = summarise(vocabulary, 100)
    seeds = seed_classes(training, vocab, 40, 6)
    totals = word_table(classed_words(training, vocabulary, seeds), vocab, len(seeds.size) + 1).totals
    want = plain_scores(own, learn, seeds, totals)
    got = {r.doc_id: r.score for r in score(small, F.col("doc_id") % 5 != 0, exchange_words=40, classes=6, table_words=100).collect()}
    assert got == {i: pytest.approx(x, abs=1e-6) for i, x in want.items()}


def test_lm_knows_the_end_whatever_its_count(spark):
    one = spark.createDataFrame([(0, "a b c")], "doc_id long, text string")
    r = score(one, F.lit(True)).first()
    assert (r.n_tokens, r.n_known, r.train_tokens) == (4, 4, 4) and r.base_score == pytest.approx(4 * math.log10(2 / 9))
    many = spark.createDataFrame([(i, "a a a b b b") for i in range(3)], "doc_id long, text string")
    rows = score(many, F.lit(True), table_words=2).collect()
    assert {r.n_known for r in rows} == {7} and rows[0].base_score == pytest.approx((6 * math.log10(10) + math.log10(4)) - 7 * math.log10(21 + 3 + 1))


def test_neighbours_of_a_word_are_handed_on_in_one_value(spark):
    seeds = Seeds({b"": 0, b"a": 1, b"b": 2}, np.zeros((3, 3)), np.zeros((3, 3)), np.ones(3))
    docs = spark.createDataFrame([("a x b x a",), ("x x y",), ("y",), ("",), (None,), ("B z A",)], "text string").select(F.col("text").cast("binary").alias("text")).coalesce(1)
    rows = neighbour_classes(docs, seeds).collect()
    told = {bytes(r.word): {int(p["slot"]): int(p["n"]) for p in np.frombuffer(r.found, PACKED)} for r in rows}
    # Slots 0 to 2: the end, a, b before the word; 3 to 5: after it. A row for each word, not for each slot.
    assert len(rows) == 3 and told == {b"x": {1: 1, 2: 1, 5: 1, 4: 1, 0: 1}, b"y": {0: 1, 3: 2}, b"z": {2: 1, 4: 1}}
