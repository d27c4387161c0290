"""Operators on small tables: odd input, brute-force versions, readers, writers and streams."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from skein.functions import rules

from skein.functions.text import bigrams, date_in, extension, jaccard, overlap, without_fences
from skein.operators import build, chunks, extract, graph, lexicon, profile, retrieve, routing, turns
from skein.sources import lake
from skein.streaming.outcomes import followed_schema, followed_turns, run_available


def frame(spark, schema, *rows):
    return spark.createDataFrame(list(rows), schema)


# --- text and lexicon ------------------------------------------------------------------------------------------------
def test_text_expressions(spark):
    df = frame(spark, "a array<string>, b array<string>", (["x", "y"], ["y"]), ([], ["y"]), ([], []))
    got = df.select(F.round(overlap(F.col("a"), F.col("b")), 3).alias("o"), F.round(jaccard(F.col("a"), F.col("b")), 3).alias("j"), F.size(bigrams(F.col("a"))).alias("n")).collect()
    assert [tuple(r) for r in got] == [(1.0, 0.5, 1), (0.0, 0.0, 0), (0.0, 1.0, 0)]
    one = spark.range(1).select(without_fences(F.lit(" a ```b\nc``` d ")).alias("w"), date_in(F.lit("x-2026-01-02.md")).alias("d"), extension(F.lit("/a/.git/b.tar.gz")).alias("e")).first()
    assert (one.w, one.d, one.e) == ("a  d", "2026-01-02", ".gz")


def test_lexicon_on_null_and_empty_texts(spark):
    docs = frame(spark, "doc_id long, text string", (1, None), (2, ""), (3, "Red, red and BLUE; blueish"), (4, "azure"))
    hits = lexicon.term_hits(docs, {"red": ("red",), "blue": ("blue", "azure")})
    assert sorted(map(tuple, hits.collect())) == [(3, "blue"), (3, "red"), (4, "blue")]
    assert [(r.a, r.b, r.weight, r.reinforcement_count) for r in lexicon.cooccurrence(hits).collect()] == [("blue", "red", 0.5, 0)]
    assert lexicon.cooccurrence(hits.limit(0)).count() == 0
    assert lexicon.substring_hits(docs, ("ish", "re")).count() == 3


def test_chunks_cover_the_text_and_overlap(spark):
    rng = random.Random(3)
    texts = ["", "short", " ".join(rng.choice(["word", "end.", "line\nnext", "x" * 30]) for _ in range(900)), "".join(f"{i:05d}" for i in range(1000))]
    got = chunks.chunk(frame(spark, "doc_id long, text string", *enumerate(texts), (9, None))).collect()
    by = {}
    for r in sorted(got, key=lambda r: (r.doc_id, r.chunk_no)):
        by.setdefault(r.doc_id, []).append(r.chunk)
    assert by[0] == [""] and by[1] == ["short"] and by[9] == [""]
    for no in (2, 3):
        at = 0
        for piece in by[no]:
            found = texts[no].find(piece, max(0, at - chunks.OVERLAP - 2))
            assert 0 <= found <= at + 2 and len(piece) <= chunks.SIZE
            at = found + len(piece)
        assert at >= len(texts[no].rstrip())


# --- graph -----------------------------------------------------------------------------------------------------------
def test_edges_reinforce_up_to_one_and_keep_the_first_relation(spark):
    rows = [(i, " Ab ", "t", "R" if i else "FIRST", "cd", "u", f"d{i}", 0.7) for i in range(9)]
    triples = frame(spark, "ord long, subject string, subject_type string, relation string, object string, object_type string, doc string, confidence double", *rows)
    edge = graph.fold_edges(triples).first()
    assert (edge.src, edge.dst, edge.relation, edge.weight, edge.reinforcement_count, edge.n_docs) == ("ab", "cd", "FIRST", 1.0, 8, 9)
    assert {(r.name, r.type, r.mention_count) for r in graph.fold_entities(triples).collect()} == {("ab", "t", 9), ("cd", "u", 9)}


def test_completion_sees_earlier_relations_and_skips_loops(spark):
    edges = frame(spark, "src string, dst string, relation string", ("a", "b", "DEPENDS_ON"), ("b", "c", "DEPENDS_ON"), ("b", "a", "DEPENDS_ON"), ("a", "x", "PART_OF"), ("x", "c", "PART_OF"))
    assert sorted((r.src, r.dst, r.relation) for r in graph.complete(edges).collect()) == [("a", "c", "DEPENDS_ON")]


def test_components_and_paths_match_brute_force(spark):
    rng = random.Random(1)
    pairs = [(f"n{rng.randrange(60):02d}", f"n{rng.randrange(60):02d}") for _ in range(45)] + [(f"p{i:02d}", f"p{i + 1:02d}") for i in range(40)]
    root = {n: n for p in pairs for n in p}

    def find(n):
        while root[n] != n:
            n = root[n]
        return n

    for a, b in pairs:
        x, y = sorted((find(a), find(b)))
        root[y] = x
    from skein.session import ensure_checkpoints

    ensure_checkpoints(spark)
    edges = frame(spark, "src string, dst string", *pairs)
    got = {r.name: r.component for r in graph.connected_components(edges).collect()}
    assert got == {n: find(n) for p in pairs if p[0] != p[1] for n in p}
    asked = frame(spark, "src string, dst string", ("p00", "p03"), ("p00", "p09"), ("p02", "p01"))
    assert {(r.src, r.dst): r.n_nodes for r in graph.shortest_paths(edges, asked, 4).collect()} == {("p00", "p03"): 4, ("p02", "p01"): 2}


def test_alias_candidates_on_odd_vectors(spark):
    rows = [("k", 1, [1.0, 0.0]), ("k", 2, [2.0, 0.0]), ("k", 3, [0.0, 0.0]), ("k", 4, [1.0]), ("m", 5, [1.0, 0.0]), ("k", 6, [-1.0, 0.0]), ("k", 7, [1.0, 0.1])]
    vectors = frame(spark, "kind string, id long, vector array<float>", *rows)
    for block in (1000, 2):
        got = {(r.a, r.b): round(r.similarity, 4) for r in graph.alias_candidates(vectors, 0.9, block).collect()}
        assert got == {(1, 2): 1.0, (1, 7): 0.995, (2, 7): 0.995}
    assert graph.alias_candidates(vectors.limit(0), 0.9).count() == 0


# --- retrieval -------------------------------------------------------------------------------------------------------
def test_vector_top_k_breaks_ties_by_id_and_leaves_itself_out(spark):
    corpus = frame(spark, "id long, v array<float>", *((i, [float(i % 3), 0.0]) for i in range(9)))
    found = retrieve.vector_top_k(frame(spark, "query_id long, q array<float>", (0, [0.0, 0.0])), corpus, 4).orderBy("rank").collect()
    assert [(r.id, r.distance) for r in found] == [(3, 0.0), (6, 0.0), (1, 1.0), (4, 1.0)]


def test_fusion_of_empty_and_weightless_lists(spark):
    one = frame(spark, "query_id long, id long, rank long", (1, 7, 1), (1, 8, 2))
    fused = retrieve.fuse({"vector": (one, 0.0), "fulltext": (one, 0.25), "graph": (one.limit(0), 0.5)}).orderBy("rank").collect()
    assert [(r.id, r.origin, r.n_sources) for r in fused] == [(7, "fulltext", 1), (8, "fulltext", 1)]


def test_adaptive_stop_reasons(spark):
    hits = frame(spark, "query_id long, distance double, rank long", (1, 0.1, 1), (1, 0.2, 2), (2, 0.6, 1), (2, 0.5, 2), (3, 0.95, 1))
    got = {r.query_id: (r.stop_rank, r.reason) for r in retrieve.adaptive_stop(hits, 0.7, 1, 8).collect()}
    assert got == {1: (1, "threshold"), 2: (2, "max_k"), 3: (0, "no_results")}


# --- conversations and routing ---------------------------------------------------------------------------------------
def test_pairs_need_a_user_turn_just_before(spark):
    rows = [(1, 0, "user", "q"), (1, 1, "assistant", "a"), (1, 2, "assistant", "b"), (1, 3, "user", "r"), (1, 4, "user", ""), (1, 5, "assistant", "c"), (1, 6, "user", None)]
    got = turns.pairs(frame(spark, "conv_id long, turn long, role string, text string", *rows)).collect()
    assert sorted((r.turn, r.instruction, r.output) for r in got) == [(1, "q", "a"), (5, "r", "c")]


def test_outcomes_of_negation_reformulation_and_close(spark):
    rows = [(1, 0, "user", "sort the list of names"), (1, 2, "user", "no, sort the list by date"), (1, 4, "user", "sort the list by date now"), (1, 6, "user", "thanks")]
    got = {r.turn: r.reason for r in turns.outcomes(frame(spark, "conv_id long, turn long, role string, text string", *rows)).collect()}
    assert got == {0: "negation", 2: "reformulation", 4: "new_topic", 6: "session_close"}


def test_classes_and_strategies(spark):
    asked = frame(spark, "query_id long, text string", (1, "fix the bug and the error"), (2, "what is this"), (3, ""), (4, None))
    got = {r.query_id: (r.task, r.max_k) for r in routing.strategies(routing.keyword_classes(asked)).collect()}
    assert got[1] == ("debugging", 8) and got[2] == ("explanation", 4) and got[3] == ("general", 5) and got[4] == ("general", 5)


# --- profile ---------------------------------------------------------------------------------------------------------
def test_clamped_confidence_matches_a_fold(spark):
    rng = random.Random(5)
    rows = [("hot" if rng.random() < 0.6 else f"k{rng.randrange(5)}", i, rng.random() < 0.7) for i in range(3000)]
    want = {}
    for key, _, ok in rows:
        c = want.get(key, 0.5)
        want[key] = min(0.95, c + 0.03) if ok else max(0.2, c - 0.05)
    got = profile.clamped_confidence(frame(spark, "key string, ord long, accepted boolean", *rows).repartition(5)).collect()
    assert {r.key: round(r.confidence, 9) for r in got} == {k: round(v, 9) for k, v in want.items()}
    assert sum(r.n for r in got) == 3000


def test_thompson_prefers_the_better_arm_and_repeats_by_seed(spark):
    arms = frame(spark, "arm string, arm_no int", ("a", 0), ("b", 1))
    log = frame(spark, "context long, arm string, accepted boolean", *[(1, "a", False)] * 40, *[(1, "b", True)] * 40, (1, "gone", True))
    post = profile.posteriors(log, arms, log)
    assert {r.arm: (r.alpha, r.beta) for r in post.collect()} == {"a": (2, 41), "b": (41, 1)}
    drawn = profile.thompson(post, 7, 200)
    assert drawn.filter("arm = 'b'").count() > 190
    assert sorted(drawn.collect()) == sorted(profile.thompson(post, 7, 200).collect())


def test_competence_weights_depend_on_what_is_known(spark):
    t = "timestamp'2026-01-01'"
    entries = frame(spark, "topic string, entries long", ("a", 100), ("b", 0))
    none = lambda col: entries.select("topic", F.expr(col)).limit(0)
    got = {r.topic: (r.score, r.level) for r in profile.competence(entries, none("1 AS edges"), none(f"{t} AS last"), none("0.5 AS rate"), F.expr(t)).collect()}
    assert got == {"a": (1.0, "Expert"), "b": (0.0, "Unknown")}


# --- lake and streams ------------------------------------------------------------------------------------------------
def test_records_of_lines_and_of_objects_without_lines(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"x": 1}\n\n{"x": 2}\nbroken\n')
    (tmp_path / "b.json").write_text('{"x":\n 3} {"y": {"z": "}{"}}\n')
    (tmp_path / "c.json").write_text("")
    got = sorted(r.record for r in lake.read_records(spark, str(tmp_path)).collect())
    assert got == ['{"x": 1}', '{"x": 2}', '{"x": 3}', '{"y": {"z": "}{"}}']


def test_scan_leaves_out_folders_and_suffixes(spark, tmp_path):
    for name in ("decisions/a.md", "node_modules/b.md", "src/c.py", "d.bin"):
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_text("text")
    found = {r.path.rsplit("/", 1)[1]: r.category for r in lake.scan(spark, f"file:{tmp_path}").collect()}
    assert found == {"a.md": "decision", "c.py": "code_python"}


def test_graph_and_logs_are_written_and_read_again(spark, tmp_path):
    assert lake.load_graph(spark, f"{tmp_path}/g") is None
    for n in (2, 1):
        entities, edges = frame(spark, "name string, type string", *[("a", "t")] * n), frame(spark, "src string, dst string, relation string", ("a", "b", "r"))
        lake.save_graph(entities, edges, f"{tmp_path}/g")
    assert [df.count() for df in lake.load_graph(spark, f"{tmp_path}/g")] == [1, 1]
    log = frame(spark, "timestamp string, x int", ("2026-01-01T05:00:00", 1), ("2026-01-02T05:00:00", 2))
    lake.write_by_day(log, f"{tmp_path}/log")
    lake.write_by_day(log, f"{tmp_path}/log")
    assert spark.read.json(f"{tmp_path}/log").groupBy("day").count().count() == 2
    assert lake.unprocessed(frame(spark, "path string, modified int", ("a", 2), ("b", 2)), frame(spark, "file_key string, modified int", ("a", 2), ("b", 1))).collect()[0].path == "b"


@pytest.mark.parametrize("batches", [1, 3])
def test_followed_turns_over_micro_batches(spark, tmp_path, batches):
    schema = "conv_id long, turn long, role string, text string"
    rows = [(c, t, "user" if t % 2 == 0 else "assistant", f"c{c} t{t}") for t in range(6) for c in (1, 2)]
    size = len(rows) // batches
    (tmp_path / "in").mkdir()
    stream = spark.readStream.schema(schema).parquet(f"{tmp_path}/in")
    for b in range(batches):
        frame(spark, schema, *rows[b * size : (b + 1) * size]).write.mode("append").parquet(f"{tmp_path}/in")
        run_available(followed_turns(stream), str(tmp_path), "followed")
    got = spark.read.schema(followed_schema(stream)).parquet(f"{tmp_path}/followed").collect()
    assert sorted(map(tuple, got)) == [(c, t, f"c{c} t{t}", f"c{c} t{t + 2}") for c in (1, 2) for t in (0, 2)]


# --- retrieval in blocks and on odd input ----------------------------------------------------------------------------
def test_vector_top_k_in_blocks_matches_brute_force(spark):
    rng = np.random.default_rng(1)
    v = rng.normal(size=(300, 5))
    v[10] = v[20]
    v[30] = 0
    corpus = frame(spark, "id long, v array<double>, tag string", *((i, x.tolist(), f"t{i % 3}") for i, x in enumerate(v)), (900, None, "n"), (901, [1.0], "s")).repartition(4)
    queries = frame(spark, "query_id long, q array<double>", *((i, v[i].tolist()) for i in range(0, 300, 7)), (902, None))
    for metric in ("l2", "cosine"):
        for block in (1 << 24, 300):
            with pytest.MonkeyPatch.context() as patch:
                patch.setattr(retrieve.in_query_blocks, "__defaults__", (block,))
                got = {(r.query_id, r.rank): (r.id, r.tag) for r in retrieve.vector_top_k(queries, corpus, 5, metric).collect()}
            for i in range(0, 300, 7):
                if metric == "l2":
                    d = np.round(np.sqrt(((v - v[i]) ** 2).sum(axis=1)), 9)
                else:
                    norms = np.linalg.norm(v, axis=1) * np.linalg.norm(v[i])
                    d = np.round(1 - np.divide(v @ v[i], norms, out=np.zeros(300), where=norms > 0), 9)
                want = [j for _, j in sorted((x, j) for j, x in enumerate(d) if j != i)][:5]
                assert [got[i, r + 1] for r in range(5)] == [(j, f"t{j % 3}") for j in want]
            assert not [k for k in got if k[0] == 902]
    assert retrieve.vector_top_k(queries.limit(0), corpus, 5).count() == 0 == retrieve.vector_top_k(queries, corpus.limit(0), 5).count()


def test_relevance_in_blocks_and_without_words(spark):
    queries = frame(spark, "query_id long, text string", (1, "red fox"), (2, "the of"), (3, None), (4, "blue whale song"))
    docs = frame(spark, "id long, text string", (1, "a red door"), (2, None), (3, "Blue WHALE " * 100), (4, "x" * 600 + " red"))
    for block in (1 << 24, 1):
        with pytest.MonkeyPatch.context() as patch:
            patch.setattr(retrieve.in_query_blocks, "__defaults__", (block,))
            got = {(r.query_id, r.id): round(r.relevance, 3) for r in retrieve.relevant(queries, docs).collect()}
        assert got == {(1, 1): 0.5, (4, 3): 0.667}


def test_fusion_without_any_weight_and_rules_that_are_no_patterns(spark):
    one = frame(spark, "query_id long, id long, rank long", (1, 7, 1))
    assert retrieve.fuse({"vector": (one, 0.0)}).count() == 0
    asked = frame(spark, "query_id long, text string", (1, "Why (not"), (2, None))
    assert {r.query_id: r.rule for r in routing.first_rule(asked, [("broken", "(not"), ("why", "why")], "none").collect()} == {1: "why", 2: "none"}
    assert {r.query_id: r.score for r in routing.response_scores(asked, (), ()).collect()} == {1: 0.69, 2: 0.69}


def test_prompts_with_and_without_hits(spark):
    asked = frame(spark, "query_id long, text string", (1, "q"), (2, "r"))
    hits = frame(spark, "query_id long, category string, origin string, text string, rank long", (1, "c", "graph", "x" * 400, 1), (1, "d", "vector", "y", 2), (1, "e", "vector", "z", 3))
    paths = frame(spark, "query_id long, path string", (1, "a -> b"))
    got = {r.query_id: r.prompt for r in retrieve.context_prompts(asked, hits, 2, paths=paths).collect()}
    assert got[2] == "r" and got[1].startswith("Context:\n[c|graph] " + "x" * 300 + "\n---\n[d|vector] y\n---\n\nKnown relations:\n- a -> b\n\n---\nQuestion: q\n") and "z" not in got[1].split("Question")[0]


# --- graph rewrites and builds ---------------------------------------------------------------------------------------
def test_alias_merges_match_a_greedy_fold(spark):
    rng = random.Random(8)
    for _ in range(3):
        mentions = {i: rng.randrange(4) for i in range(14)}
        pairs = sorted({tuple(sorted(rng.sample(range(14), 2))) for _ in range(20)})
        rows = [("k", a, b, round(rng.random(), 2)) for a, b in pairs]
        gone, want = set(), {}
        for _, a, b, s in sorted(rows, key=lambda r: (-r[3], r[1], r[2])):
            canonical, alias = (b, a) if mentions[b] > mentions[a] else (a, b)
            if alias in gone:
                continue
            gone.add(alias)
            want[alias] = (canonical, canonical not in want)
        got = {r.alias: (r.canonical, r.effective) for r in graph.alias_merges(frame(spark, "kind string, a long, b long, similarity double", *rows), frame(spark, "id long, mention_count int", *mentions.items())).collect()}
        assert got == want


def test_paths_prefer_edges_and_weights_bound_walks(spark):
    edges = frame(spark, "src string, dst string, relation string, weight double", ("a", "b", "r", 0.9), ("b", "c", "s", 0.2), ("c", "d", "t", 0.5), ("a", "a", "loop", 0.5))
    pairs = frame(spark, "src string, dst string", ("a", "b"), ("b", "a"), ("a", "c"), ("a", "d"), ("a", "zz"))
    got = {(r.src, r.dst): (r.path, r.n_nodes) for r in graph.context_paths(edges, pairs).collect()}
    assert got == {("a", "b"): ("a --[r]--> b", 2), ("b", "a"): ("a --[r]--> b", 2), ("a", "c"): ("a -> b -> c", 3), ("a", "d"): ("a -> b -> c -> d", 4)}
    near = graph.neighbourhood(edges, frame(spark, "name string", ("a",)), 3, 0.3)
    assert [(r.name, r.distance) for r in near.collect()] == [("b", 1)]
    both = graph.relations_of(edges, frame(spark, "name string", ("a",)))
    assert sorted((r.direction, r.dst) for r in both.collect()) == [("in", "a"), ("out", "a"), ("out", "b")]
    weak = graph.prune(frame(spark, "name string, mention_count int", ("b", 1), ("c", 1)), edges.withColumn("inferred", F.col("weight") < 0.3), keep_inferred=True)
    assert weak[1].count() == 0 and graph.prune(frame(spark, "name string, mention_count int", ("b", 1), ("c", 1)), edges)[1].count() == 1


def test_builds_reinforce_what_was_saved(spark):
    schema = "ord long, subject string, subject_type string, relation string, object string, object_type string, doc string, confidence double"
    first = build.built(frame(spark, schema, (1, "a", "t", "depends_on", "b", "t", "d", 0.5), (2, "b", "t", "depends_on", "c", "t", "d", 0.5)))
    assert sorted((r.src, r.dst, r.weight, r.inferred) for r in first.edges.collect()) == [("a", "b", 0.5, False), ("a", "c", 0.3, True), ("b", "c", 0.5, False)]
    second = build.built(frame(spark, schema, (1, "A ", "u", "uses", "b", "t", "e", 0.9), (2, "b", "t", "uses", "x", "t", "e", 0.9)), (first.entities, first.edges), first.snapshots)
    got = {(r.src, r.dst): (r.relation, round(r.weight, 6), r.reinforcement_count) for r in second.edges.filter("NOT inferred").collect()}
    assert got == {("a", "b"): ("depends_on", 0.6, 1), ("b", "c"): ("depends_on", 0.5, 0), ("b", "x"): ("uses", 0.9, 0)}
    assert {r.name: (r.type, r.mention_count) for r in second.entities.collect()} == {"a": ("t", 2), "b": ("t", 4), "c": ("t", 1), "x": ("t", 1)}
    assert {r.name: r.version for r in second.snapshots.collect()} == {"a": 1, "b": 2, "c": 1, "x": 1}
    assert [(r.name, r.added) for r in second.drifted.collect()] == [("b", ["x"])]


# --- extraction ------------------------------------------------------------------------------------------------------
def test_whole_words_of_several_words_and_shared_aliases(spark):
    texts = ["Use GitHub Actions, tf and next.js", "nextly tfx", "Ports and Adapters with CQRS", None, ""]
    df = frame(spark, "doc long, text string", *enumerate(texts))
    got = df.select("doc", extract.whole_words(F.col("text"), rules.TECHNOLOGIES).alias("t"), extract.anywhere(F.col("text"), rules.PATTERNS).alias("p")).collect()
    assert [r.t for r in got] == [["nextjs", "terraform", "github actions", "tensorflow"], [], [], [], []]
    assert {"hexagonal architecture", "cqrs", "adapter pattern"} <= set(got[2].p) and got[3].p == []


def test_decisions_in_markdown(spark):
    text = ["# Old", "# Use queues ", "", "## Decision:", "", " take kafka ", "Lesson learned", "", "retry with backoff helps"]
    lines = frame(spark, "doc string, no long, line string", *(("d", i, x) for i, x in enumerate(text)), ("e", 0, "nothing"))
    got = {r.doc: (r.topic, r.chosen, r.lesson) for r in extract.decision_fields(lines).collect()}
    assert got == {"d": ("Use queues", "take kafka", "retry with backoff helps"), "e": (None, None, None)}
    triples = extract.from_decisions(extract.decision_fields(lines)).collect()
    assert {(r.subject, r.relation, r.object) for r in triples} == {("kafka", "related_to", "use queues"), ("retry with backoff", "learned_from", "use queues")}


def test_rules_are_read_from_a_file(spark, tmp_path):
    (tmp_path / "r.json").write_text('{"technologies": {"zig": ["ziglang"]}, "errors": {"panic": "pan.c"}}')
    own = extract.Rules(**rules.load_rules(spark, f"file:{tmp_path}/r.json"))
    pairs = frame(spark, "doc string, instruction string, output string, category string", ("d", "a Ziglang panic", None, None))
    assert sorted(r.subject for r in extract.from_pairs(pairs, own).collect()) == ["panic", "zig"]


# --- readers and sinks -----------------------------------------------------------------------------------------------
def test_files_zones_and_saved_tables(spark, tmp_path):
    lake_dir = tmp_path / "lake"
    files = {
        "02-processed/training-pairs/a.jsonl": '{"instruction": "ask", "output": "' + "long answer " * 9 + '", "source_file": "proj/x.py"}\nbroken\n{"output": "short"}\n',
        "03-metadata/decisions/d.md": "# T\nchoose this. " * 200,
        "03-metadata/learnings/l.md": "   ",
        "01-raw/code-changes/c.jsonl": '{"description": "' + "changed much " * 9 + '"}\n',
        "x/bad.json": "{no",
        "x/good.json": '{"a": 1}',
    }
    for name, text in files.items():
        (lake_dir / name).parent.mkdir(parents=True, exist_ok=True)
        (lake_dir / name).write_text(text)
    rows = lake.zone_rows(spark, f"file:{lake_dir}").collect()
    assert {r.category for r in rows} == {"training", "decision", "code_change"} and sum(r.category == "decision" for r in rows) > 3
    assert [r.project for r in rows if r.category == "training"] == ["proj"] and next(r.text for r in rows if r.category == "training").startswith("Q: ask\nA: long")
    read = {r.path.rsplit("/", 1)[1]: (r.record, r.n_records) for r in lake.read_files(spark, lake.scan(spark, f"file:{lake_dir}")).collect()}
    assert read["bad.json"] == (None, None) and read["good.json"][0] == '{"a": 1}' and read["a.jsonl"] == (None, 2)
    assert lake.of_category(lake.scan(spark, f"file:{lake_dir}"), "decision").count() == 1
    state = f"{tmp_path}/state"
    assert lake.read_table_or(spark, state, "id string, n int").count() == 0
    lake.append(frame(spark, "id string, n int", ("a", 1)), state)
    now = lake.read_table_or(spark, state, "id string, n int")
    lake.replace_table(now.withColumn("n", F.col("n") + 1), state)
    assert [tuple(r) for r in lake.read_table_or(spark, state, "id string, n int").collect()] == [("a", 2)]
    for _ in range(2):
        lake.append_vectors(frame(spark, "id string, v array<double>", ("a", [1.0]), ("a", [1.0]), ("b", [2.0])), f"{tmp_path}/v", "id")
    assert spark.read.parquet(f"{tmp_path}/v").count() == 2
    assert lake.captures_since(lake.read_records(spark, f"file:{lake_dir}/01-raw"), "2026-01-01").count() == 1


def test_transcripts_of_strings_arrays_and_odd_records(spark):
    rows = [
        '{"type":"user","uuid":"a","message":{"content":"[not an array"}}', '{"type":"assistant","uuid":"b","parentUuid":"a","message":{"content":[{"type":"text","text":"x"},"y",{"type":"thinking","thinking":"hm"},{"type":"image"}]}}',
        '{"type":"progress","message":{"content":"z"}}', "broken", '{"type":"user","message":null}', '{"type":"assistant","message":{"content":[]}}',
    ]
    records = frame(spark, "file string, ord long, record string", *(("f", i, r) for i, r in enumerate(rows)))
    got = {r.ord: (r.text, r.thinking, r.parent) for r in lake.messages_of(records).collect()}
    assert got == {0: ("[not an array", "", None), 1: ("x\ny", "hm", "a"), 4: ("", "", None), 5: ("", "", None)}
    assert [tuple(r) for r in lake.thinking_stats(records, 2).collect()] == [("f", 6, 1, 1)]
    folders = frame(spark, "path string, folder string", ("p1", "-home-My-Proj"), ("p2", "other"))
    assert [tuple(r) for r in lake.transcripts_of(frame(spark, "project string", ("myproj",)), folders).collect()] == [("myproj", "p1")]


def test_stream_state_with_null_turns_texts_and_string_ids(spark, tmp_path):
    schema = "conv_id string, turn int, role string, text string"
    frame(spark, schema, ("a", 1, "user", None), ("a", None, "user", "lost"), ("a", 1, "user", "same"), ("a", 3, "user", None)).write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(schema).parquet(f"{tmp_path}/in")
    run_available(followed_turns(stream), str(tmp_path), "followed")
    got = spark.read.schema(followed_schema(stream)).parquet(f"{tmp_path}/followed").collect()
    assert sorted((r.conv_id, r.turn, r.text or "", r.next or "") for r in got) == [("a", 1, "", "same"), ("a", 1, "same", "")]
