"""Readers, marks, labels and instincts on the cases that once lost rows."""

import json

from pyspark.sql import functions as F

from skein.operators import profile, routing, turns
from skein.operators.keyword_index import build_index, index_counts
from skein.sources import lake


def test_the_latest_mark_counts_once(spark):
    said = spark.createDataFrame([(1, "a", "b", None, "m", None), (2, "c", "d", "x", "m", False), (3, "e", "f", None, "m", True)], "id long, input_text string, output_text string, context string, model string, was_accepted boolean")
    marks = spark.createDataFrame([(1, "positive", 1), (1, "negative", 2), (3, "negative", 1), (3, "positive", 5), (3, "neutral", None)], "record_id long, feedback string, timestamp int")
    got = {least: sorted((r.metadata.id, r.metadata.feedback) for r in turns.exported_pairs(said, marks, least).collect()) for least in ("any", "neutral", "positive")}
    assert got == {"any": [(1, "negative"), (3, "positive")], "neutral": [(3, "positive")], "positive": [(3, "positive")]}


def test_files_of_many_folders_and_of_none(spark, tmp_path, monkeypatch):
    for k in range(7):
        (tmp_path / f"d{k}").mkdir()
        (tmp_path / f"d{k}" / "x.json").write_text(json.dumps({"k": k}))
        (tmp_path / f"d{k}" / "y.bin").write_text("not listed")
    files = lake.scan(spark, f"file:{tmp_path}")
    few = sorted((r.path, r.record) for r in lake.read_files(spark, files).collect())
    monkeypatch.setattr(lake, "MAX_FOLDERS", 3)
    assert sorted((r.path, r.record) for r in lake.read_files(spark, files).collect()) == few and len(few) == 7
    assert lake.scan(spark, f"file:{tmp_path}/missing").count() == 0
    assert lake.read_files(spark, lake.scan(spark, f"file:{tmp_path}/missing")).count() == 0


def test_search_with_equal_columns(spark):
    files = spark.createDataFrame([("a/x.md", "Needle", "decision", "l1"), ("a/y.md", "needle", "other", "l1"), ("needle/z.md", "", "decision", "l2"), ("w.md", None, None, None)], "path string, content string, category string, lake string")
    find = lambda **equal: [r.path for r in lake.search(files, "NEEDLE", **equal).collect()]
    assert find() == ["a/x.md", "a/y.md", "needle/z.md"] and find(category="decision") == ["a/x.md", "needle/z.md"] and find(category="decision", lake="l1") == ["a/x.md"]


def test_instincts_of_any_number(spark):
    instincts = spark.createDataFrame([(f"i{k:04}", f"Word{k % 700}", 0.3 + (k % 7) / 10, k % 5 > 0) for k in range(2000)] + [("all", "", 0.9, True), ("weak", "word1", 0.1, True)], "id string, pattern string, confidence double, enabled boolean")
    queries = spark.createDataFrame([(1, "WORD12 and word699"), (2, None), (3, ""), (4, "nothing")], "query_id long, text string")
    got = {}
    for r in profile.matched_instincts(queries, instincts).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append(r.id)
    rows = [(r.id, r.pattern.lower(), r.confidence) for r in instincts.collect() if r.enabled and r.confidence >= 0.3]
    for q, text in ((1, "word12 and word699"), (3, ""), (4, "nothing")):
        assert got[q] == [i for i, p, c in sorted((r for r in rows if r[1] in text), key=lambda r: (-r[2], r[0]))]
    assert 2 not in got


def test_labels_of_answers(spark):
    answers = [" Debugging\n", "I think it is code review.", "neither", "", None, "debugging or testing", "TESTING"]
    df = spark.createDataFrame([(k, a) for k, a in enumerate(answers)], "id int, a string")
    got = [r.l for r in df.select("id", routing.label_of(F.col("a"), ("testing", "debugging", "code review")).alias("l")).orderBy("id").collect()]
    assert got == ["debugging", "code review", "general", "general", "general", "testing", "testing"]


def test_index_counts_of_odd_tables(spark):
    df = spark.createDataFrame([(1, "aa bb aa"), (2, None), (3, ""), (4, "bb c")], "id long, text string")
    assert tuple(index_counts(build_index(df)).first()) == (4, 2, 3, 4)
    assert tuple(index_counts(build_index(df.limit(0))).first()) == (0, 0, 0, 0)


def test_outcome_records_and_benchmark_cases(spark, tmp_path):
    records = spark.createDataFrame([(json.dumps({"id": "a", "topic": "t", "task_type": "x", "latency_ms": 1.5}),), (json.dumps({"id": "b", "topic": "u", "task_type": "x"}),), ("{broken",), ("[]",)], "record string")
    of = lambda **how: sorted(r.id for r in lake.outcomes_of(records, **how).collect())
    assert of() == ["a", "b"] and of(topic="t") == ["a"] and of(task="x") == ["a", "b"] and of(topic="t", task="y") == []
    cases = [{"id": "1", "category": "c1", "input": {"prompt": "p"}, "expected_behavior": {"must_include": ["x"]}}, {"id": "2", "category": "c2"}]
    (tmp_path / "cases.json").write_text(json.dumps(cases))
    assert sorted(r.id for r in lake.benchmark_cases(spark, f"file:{tmp_path}/cases.json").collect()) == ["1", "2"]
    assert [r.input.prompt for r in lake.benchmark_cases(spark, f"file:{tmp_path}/cases.json", "c1").collect()] == ["p"]


def test_a_table_is_replaced_whole_or_not_at_all(spark, tmp_path):
    path, schema = f"{tmp_path}/state", "id long, n long"
    rows = lambda: sorted(map(tuple, lake.read_table_or(spark, path, schema).collect()))
    assert rows() == []
    lake.append(spark.range(2).selectExpr("id", "0L AS n"), path)
    assert rows() == [(0, 0), (1, 0)]
    for n in range(1, 5):
        lake.replace_table(lake.read_table_or(spark, path, schema).withColumn("n", F.col("n") + 1), path)
        assert rows() == [(0, n), (1, n)]
    # A crash leaves a version that the log does not name.
    spark.range(9).selectExpr("id", "99L AS n").write.json(f"{path}.versions/crashed")
    assert rows() == [(0, 4), (1, 4)]
    assert len([p for p in (tmp_path / "state.versions").iterdir() if p.is_dir() and p.name not in ("log", "crashed")]) == 2
    lake.replace_table(lake.read_table_or(spark, path, schema).limit(0), path)
    assert rows() == []


def test_the_cut_of_a_summary_keeps_a_part_of_the_blank_line(spark):
    """Lines that end one, two or three characters before the cut."""
    rows = [(k, turn, "user", "x" * (turns.SUMMARY_CHARS - len("user: ") - k) if turn == 1 else "next") for k in range(4) for turn in (1, 2)]
    got = {r.conv_id: r.text for r in turns.summary_input(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()}
    for k in range(4):
        assert got[k] == "\n\n".join("user: " + r[3] for r in rows if r[0] == k)[: turns.SUMMARY_CHARS]


def test_lists_of_instincts_are_dealt_in_cells(spark, monkeypatch):
    """Many queries that hold one pattern of many instincts: the same rows whatever the cells, and lessons once a pattern."""
    instincts = spark.createDataFrame([(f"i{k:03}", ("ab", "cd", "")[k % 3] if k < 90 else "none", 0.3 + (k % 7) / 10, k % 5 > 0) for k in range(100)], "id string, pattern string, confidence double, enabled boolean")
    rows = [(k, ("AB", "cd ab", "x", None)[k % 4]) for k in range(60)]
    queries = spark.createDataFrame(rows, "query_id long, text string")
    held = [(f"i{k:03}", ("ab", "cd", "")[k % 3], 0.3 + (k % 7) / 10) for k in range(90) if k % 5]
    want = {}
    for q, text in rows:
        own = sorted((-c, i) for i, p, c in held if text is not None and p in text.lower())
        want |= {(q, i): n + 1 for n, (_, i) in enumerate(own)}
    for size in (4096, 4):
        monkeypatch.setattr(profile, "CELL_QUERIES", size)
        monkeypatch.setattr(profile, "CELL_INSTINCTS", size)
        found = profile.matched_instincts(queries, instincts)
        assert {(r.query_id, r.id): r["rank"] for r in found.collect()} == want and found.count() == len(want)
    sizes = found.rdd.glom().map(len).collect()
    assert len(sizes) > 100 and max(sizes) < found.count() / 4
    outcomes = queries.select(F.col("query_id").alias("conv_id"), F.lit(1).alias("turn"), F.when(F.col("query_id") % 3 == 0, "rejected").otherwise("accepted").alias("outcome"))
    lessons, clamped = [], profile.clamped_confidence
    monkeypatch.setattr(profile, "clamped_confidence", lambda events: lessons.append(events.count()) or clamped(events))
    got = {r.key: (round(r.confidence, 6), r.n) for r in profile.taught_instincts(outcomes, queries.select(F.struct(F.col("query_id").alias("conv_id"), F.lit(1).alias("turn")).alias("query_id"), "text"), instincts).collect()}
    for i, p, _ in held:
        now, n = 0.5, 0
        for q, text in rows:
            if text is not None and p in text.lower():
                now, n = (max(0.2, now - 0.05) if q % 3 == 0 else min(0.95, now + 0.03)), n + 1
        assert got[i] == (round(now, 6), n)
    assert len(got) == len(held) and lessons == [30 + 15 + 45]


def test_chunks_bound_their_batches(spark):
    from skein.operators import chunks

    name, before = "spark.sql.execution.arrow.maxBytesPerBatch", spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch")
    try:
        spark.conf.set(name, str(1 << 30))
        got = chunks.chunk(spark.createDataFrame([(1, "ab " * 900), (2, None)], "doc_id long, text string"))
        assert int(spark.conf.get(name)) == 8 << 20 and got.filter("doc_id = 1").count() == len(chunks.cut("ab " * 900)) and got.filter("doc_id = 2").count() == 1
    finally:
        spark.conf.set(name, before)


def test_texts_of_the_term_graph_are_spaced_once(spark, tmp_path):
    """Neither for each name nor for a filter that a generator brings."""
    from skein.plans import catalogue

    rows = [(1, "Thing  ERTH\nx"), (2, "thing\tund nicht"), (3, None), (4, "things"), (5, "x thing erth y")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    found = catalogue._term_graph(spark, str(tmp_path))
    assert sorted((r.src, r.dst) for r in found.collect()) == [("erth", "thing"), ("nicht", "thing"), ("nicht", "und"), ("nicht", "und nicht"), ("thing", "und"), ("thing", "und nicht"), ("und", "und nicht")]
    assert found._jdf.queryExecution().optimizedPlan().toString().count("regexp_replace") == 1


def test_products_of_vectors_do_not_grow_with_the_queries():
    """Parts of the queries find what all at once find, in memory that is that of a part."""
    import tracemalloc

    import numpy as np
    import pyarrow as pa

    from skein.operators import retrieve

    rng = np.random.default_rng(3)
    queries = [(i, q.tolist()) for i, q in enumerate(rng.normal(size=(3000, 8)))]
    batch = pa.RecordBatch.from_arrays([pa.array(np.arange(4096)), pa.array(rng.normal(size=(4096, 8)).tolist())], names=["id", "v"])
    for metric in ("l2", "cosine"):
        run = retrieve._nearest_in_task(queries, ["id"], 3, metric)
        tracemalloc.start()
        got = list(run(iter([batch])))
        peak = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        assert peak < 80 << 20, peak
        assert got == list(retrieve._nearest_in_task(queries, ["id"], 3, metric, 10_000)(iter([batch])))


def test_thoughts_go_to_python_in_bounded_batches(spark):
    from skein.operators import extract

    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(name)
    try:
        spark.conf.set(name, str(1 << 30))
        extract.from_thoughts(spark.createDataFrame([(1, "x" * 200)], "doc long, text string"))
        assert int(spark.conf.get(name).rstrip("b")) == 8 << 20
    finally:
        spark.conf.set(name, before)
