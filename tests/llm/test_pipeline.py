import re

import corpus_pipeline
from skein.llm.quality import score_quality, train_quality


def near_groups(texts):
    """The least id that each document reaches over pairs of a Jaccard similarity of 0.8 or more of five-word shingles."""
    sets = {}
    for i, t in texts.items():
        w = t.encode().lower().split()
        sets[i] = {tuple(w[a : a + min(5, len(w))]) for a in range(max(1, len(w) - 4))} if w else set()
    root = {i: i for i in texts}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a in texts:
        for b in texts:
            if a < b and sets[a] and sets[b] and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {i: find(i) for i in texts}


def contaminated(texts, items):
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    windows = set()
    for t in items:
        w = words(t)
        k = min(10, len(w))
        windows |= {tuple(w[a : a + k]) for a in range(len(w) - k + 1)} if w else set()
    sizes = {len(x) for x in windows}
    return {i for i, t in texts.items() for w in [words(t)] if any(tuple(w[a : a + k]) in windows for k in sizes for a in range(len(w) - k + 1))}


def test_stages_match_brute_force(spark, sf_dir, documents, texts):
    docs = documents
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["quality", "exact_dedup", "near_dedup", "decontamination", "packing"]
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    good = stages["quality"](spark, docs, sf_dir)
    assert good.columns == docs.columns
    scores = {r.doc_id: r.score for r in score_quality(docs, train_quality(docs, labels), ("doc_id",)).select("doc.doc_id", "score").collect()}
    kept = {r.doc_id for r in good.collect()}
    assert kept == {i for i, s in scores.items() if s >= 0.7} and len(kept) > 0.7 * len(texts)
    good = good.cache()
    single = stages["exact_dedup"](spark, good, sf_dir)
    best = {}
    for i in sorted(kept):
        key = re.sub(r"[\x20\x09-\x0D]", "", texts[i])
        best[key] = max(best.get(key, (-1, 1)), (len(texts[i]), -i))
    assert single.columns == docs.columns and {r.doc_id for r in single.collect()} == {-i for _, i in best.values()}
    left = sorted(r.doc_id for r in single.collect())
    near = stages["near_dedup"](spark, single, sf_dir)
    assert near.columns == docs.columns and {r.doc_id for r in near.collect()} == {i for i, root in near_groups({i: texts[i] for i in left}).items() if i == root}
    clean = stages["decontamination"](spark, near, sf_dir)
    items = [r.text for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    hit = contaminated({r.doc_id: texts[r.doc_id] for r in near.collect()}, items)
    assert clean.columns == docs.columns and {r.doc_id for r in clean.collect()} == {r.doc_id for r in near.collect()} - hit
    packed = stages["packing"](spark, clean, sf_dir)
    assert {r.doc_id for r in packed.select("doc_id").distinct().collect()} == {r.doc_id for r in clean.select("doc_id").collect()}


def test_odd_tables_go_through_every_stage(spark, sf_dir, odd_docs, no_docs):
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, odd_docs, sf_dir)
        assert name == "packing" or out.columns == odd_docs.columns
        out.count()
        assert stage(spark, no_docs, sf_dir).count() == 0


def test_run_returns_the_last_stage(spark, sf_dir):
    assert corpus_pipeline.run(spark, sf_dir).count() > 0
