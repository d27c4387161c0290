"""Registered queries on extraction, profiles, the feedback loop, routing and records; `more_sql` has their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from skein.functions import rules
from skein.operators import extract, profile, prompts, routing, turns
from skein.operators.extract import Rules
from skein.plans.common import long, rounded, table, ts
from skein.sources import lake

TOY = Rules(
    technologies={"thing": ("things",), "earth": ("erth", "erth and"), "joining": ("und", "und nicht"), "both": ("und",), "purpose": ("para", "dans les"), "article": ("the", "las")},
    patterns={"nation": ("ation",), "heit": (), "ment": ("mente", "ción")},
    errors={"ending": r"(tion|heit|ción)\.", "double": r"(the the|de de|und und)"},
    strategies={"comma": r"[\p{L}]+, and", "colon": r"[\p{L}]+: ", "with": r"with [\p{L}]+"},
)
CATEGORIES = ("fastapi", "debugging-real", "ddd", "docker", "general", "ml-rag", "postgresql", "error_fix", "angular", "history")
SUFFIXES = (".py", ".ts", ".md", ".go", ".PY", "")
TOPICS = ("fastapi", "click", "view", "p1", "postgresql", "bash")


def pick(values: tuple, number) -> F.Column:
    return F.element_at(F.array(*map(F.lit, values)), (F.pmod(number, F.lit(len(values))) + 1).cast("int"))


def _counted(triples):
    keys = ("subject", "subject_type", "relation", "object", "object_type")
    return triples.groupBy(*keys, F.round("confidence", 2).alias("confidence")).agg(F.count("*").alias("n"), F.min(F.col("doc").cast("long")).alias("first_doc"))


# --- extraction ------------------------------------------------------------------------------------------------------
def pair_triples(spark, sf):
    docs = table(spark, sf, "documents").select(F.col("doc_id").alias("doc"), F.col("source").alias("instruction"), F.col("text").alias("output"), F.col("lang").alias("category"))
    return _counted(extract.from_pairs(docs, TOY))


def thought_triples(spark, sf):
    return _counted(extract.from_thoughts(table(spark, sf, "documents").select(F.col("doc_id").alias("doc"), "text"), TOY))


def decision_triples(spark, sf):
    docs = table(spark, sf, "documents").select(F.col("doc_id").alias("doc"), F.when(F.col("doc_id") % 3 > 0, F.col("source")).alias("topic"), F.when(F.col("doc_id") % 2 == 0, F.col("lang")).alias("chosen"), F.col("text").alias("lesson"))
    return _counted(extract.from_decisions(docs, TOY))


def learning_triples(spark, sf):
    docs = table(spark, sf, "documents").select(F.col("doc_id").alias("doc"), F.when(F.col("doc_id") % 3 > 0, F.col("source")).alias("topic"), F.split("text", " ").alias("applicable_to"))
    return _counted(extract.from_learnings(docs, TOY))


def _captures(spark, sf):
    e = table(spark, sf, "events")
    return e.select(
        F.col("event_id").alias("doc"), F.col("event_id").alias("id"), F.concat(F.lit("src/f"), F.col("user_id").cast("string"), pick(SUFFIXES, F.col("event_id"))).alias("file_modified"),
        F.concat(F.lit("a "), "event_type", F.lit(" here")).alias("description"), F.concat(F.lit("P"), F.pmod("user_id", F.lit(5)).cast("string")).alias("project"), F.col("event_type").alias("tool"),
        F.when(F.col("event_id") % 4 == 0, F.lit("then a click")).alias("reasoning"), pick(("high", "medium", "none"), F.col("event_id")).alias("enrichment_confidence"),
        F.when(F.col("event_id") % 2 == 0, F.array("event_type", F.lit("Docker"))).alias("tags"), F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss").alias("timestamp"),
    )


CAPTURE_RULES = Rules(technologies={"clicking": ("click",), "viewing": ("view",), "buying": ("purchase",)}, patterns={"mistake": ("error",)}, strategies={"joining": "sign.p"})


def capture_triples(spark, sf):
    return _counted(extract.from_captures(_captures(spark, sf), CAPTURE_RULES))


def model_json_triples(spark, sf):
    """Events as responses: plain, fenced, cut off and broken JSON."""
    e, user = table(spark, sf, "events"), F.concat(F.lit(" U"), F.pmod("user_id", F.lit(9)).cast("string"))
    relation = lambda kind: F.concat(F.lit('"relations":[{"source":"'), user, F.lit('","target":"'), "event_type", F.lit(f'","type":"{kind}"'))
    whole = F.concat(F.lit('{"entities":[{"name":"'), user, F.lit('","type":"Tool"},{"name":"'), "event_type", F.lit('","type":"odd"}],'), relation("USES"), F.lit("}]}"))
    response = F.when(F.col("event_id") % 4 == 0, whole).when(F.col("event_id") % 4 == 1, F.concat(F.lit("```json\n"), whole, F.lit("\n```"))).when(F.col("event_id") % 4 == 2, F.concat(F.lit("{"), relation("odd"))).otherwise("no { json } here")
    return _counted(extract.from_model_json(e.select(F.col("event_id").alias("doc"), response.alias("response"))))


# --- profiles --------------------------------------------------------------------------------------------------------
def _categories(spark, sf):
    return table(spark, sf, "documents").groupBy(pick(CATEGORIES, F.col("doc_id")).alias("category")).agg(F.count("*").alias("n"))


def profile_build(spark, sf):
    suffixes = profile.capture_counts(_captures(spark, sf)).filter("what = 'suffix'").select(F.col("name").alias("suffix"), "n")
    p = profile.profile(_categories(spark, sf), suffixes)
    listed = F.array_join(F.transform("topics", lambda t: F.concat_ws(":", t["topic"], F.round(t["weight"] * 1000, 0).cast("long").cast("string"))), ",")
    return p.select("domain", *rounded("confidence", "formality"), F.array_join("patterns", "; ").alias("patterns"), listed.alias("topics"), F.array_join("task_types", ",").alias("task_types"), "n")


def capture_counts(spark, sf):
    return profile.capture_counts(_captures(spark, sf))


def tag_counts(spark, sf):
    rows = table(spark, sf, "documents").select(pick(CATEGORIES, F.col("doc_id")).alias("category"), F.when(F.col("doc_id") % 3 > 0, F.array("lang", "source")).alias("tags"))
    return profile.tag_counts(rows)


def task_types(spark, sf):
    return profile.task_types(_categories(spark, sf))


def capture_topics(spark, sf):
    return profile.topics_of_captures(_captures(spark, sf), list(TOPICS), rules.FILE_TECHNOLOGIES | {".py": "fastapi"}).groupBy("topic").agg(F.count("*").alias("n"), F.min("id").alias("first_id"))


def topic_activity(spark, sf):
    matched = profile.topics_of_captures(_captures(spark, sf), list(TOPICS), rules.FILE_TECHNOLOGIES | {".py": "fastapi"})
    files = table(spark, sf, "events").select(F.concat(F.date_format("ts", "yyyy-MM-dd"), F.lit("-about-"), pick(("FastAPI", "bash", "none"), F.col("event_id"))).alias("name"))
    return profile.latest_activity(matched, files, list(TOPICS))


def topic_edges(spark, sf):
    from skein.operators import graph
    from skein.plans.catalogue import place_triples

    edges = graph.fold_edges(place_triples(spark, sf))
    names = graph.fold_entities(place_triples(spark, sf)).select("name", F.explode(F.array("name", F.regexp_replace("name", "[ #]", ""))).alias("key"))
    topics = table(spark, sf, "nation").select(F.col("n_name").alias("topic")).unionByName(table(spark, sf, "region").select(F.upper("r_name").alias("topic"))).unionByName(table(spark, sf, "part").select(F.col("p_brand").alias("topic")).distinct())
    return profile.topic_edges(topics, names, edges)


def competence_lookup(spark, sf):
    from skein.plans.catalogue import competence_map

    asked = table(spark, sf, "events").select(F.upper(F.concat_ws(":", "event_type", F.pmod("user_id", F.lit(9)).cast("string"))).alias("topic")).distinct()
    return profile.competence_of(asked, competence_map(spark, sf)).select("topic", "level", *rounded("score"))


def _instincts(spark, sf):
    """Users as instincts: what they did most often is the pattern."""
    e = table(spark, sf, "events").groupBy("user_id").agg(F.max("ts").alias("last_used"), F.count("*").alias("activations"), F.avg("value").alias("mean"))
    return e.select(
        F.concat(F.lit("i"), F.col("user_id").cast("string")).alias("id"), pick(("Erth", "thing", "und", "para", "zzz"), F.col("user_id")).alias("pattern"), pick(("workflow", "preference", "shortcut"), F.col("user_id")).alias("category"),
        F.round(F.least(F.lit(0.95), F.pmod("user_id", F.lit(10)) / 10 + 0.05), 6).alias("confidence"), (F.col("user_id") % 7 > 0).alias("enabled"), "activations", "last_used",
    )


def _asked(spark, sf):
    return table(spark, sf, "conversations").filter("role = 'user'").select((F.col("conv_id") * 1000 + F.col("turn")).alias("query_id"), "text")


def instinct_matches(spark, sf):
    return profile.matched_instincts(_asked(spark, sf), _instincts(spark, sf)).select("query_id", "id", *rounded("confidence"), "rank")


def instinct_changes(spark, sf):
    e = table(spark, sf, "events")
    changes = e.select(
        F.concat(F.lit("i"), F.pmod("user_id", F.lit(60)).cast("string")).alias("id"), F.col("event_id").alias("ord"), (F.col("event_type") == "error").alias("deleted"), F.col("event_type").alias("pattern"),
        pick(("workflow", "unknown", "timing"), F.col("event_id")).alias("category"), F.lit(0.35).alias("confidence"), F.lit(True).alias("enabled"),
    )
    return profile.changed_instincts(_instincts(spark, sf), changes).select("id", "pattern", "category", *rounded("confidence"), "enabled")


def instinct_summary(spark, sf):
    return profile.instinct_stats(profile.decayed_instincts(_instincts(spark, sf), ts("2024-05-01 00:00:00"))).select(*long("total", "enabled", "needs_review"), "mean_confidence", *long("activations"))


def instinct_review(spark, sf):
    return profile.review_candidates(profile.decayed_instincts(_instincts(spark, sf), ts("2024-05-01 00:00:00"))).select("id", *rounded("confidence"))


def _outcomes(spark, sf):
    return turns.outcomes(table(spark, sf, "conversations"), 0.15, 0.1)


def _decisions(spark, sf):
    return table(spark, sf, "conversations").filter("role = 'user'").select("conv_id", "turn", F.concat(F.lit("t"), F.pmod("conv_id", F.lit(4)).cast("string")).alias("context"), pick(("default", "graph_boost", "deep_graph", "vector_focus"), F.col("turn") + F.col("conv_id")).alias("arm"))


def _posterior(spark, sf):
    from skein.plans.catalogue import _arms

    arms, _ = profile.loop_updates(_outcomes(spark, sf), _decisions(spark, sf), _decisions(spark, sf).select("conv_id", "turn", F.lit("x").alias("id")))
    return profile.posteriors(_decisions(spark, sf), _arms(spark), arms)


def feedback_loop(spark, sf):
    """What outcomes teach the arms and the instincts that matched the turn."""
    asked = table(spark, sf, "conversations").filter("role = 'user'").select(F.struct("conv_id", "turn").alias("query_id"), "text")
    return profile.taught_instincts(_outcomes(spark, sf), asked, _instincts(spark, sf)).select("key", *rounded("confidence"), "n")


def arm_updates(spark, sf):
    return _posterior(spark, sf).select("context", "arm", *long("alpha", "beta"))


def best_arms(spark, sf):
    return profile.best_arms(_posterior(spark, sf)).select("context", "arm", *rounded("mean"))


def habit_trigger(spark, sf):
    asked = table(spark, sf, "conversations").filter("role = 'user'").select(F.pmod("conv_id", F.lit(6)).alias("session"), "conv_id", "turn", "text", pick(("a", "b"), F.col("turn")).alias("topic"))
    known = asked.filter("session = 2").select(F.col("topic").alias("pattern")).filter("pattern = 'b'")
    return profile.new_habits(asked, "session", "topic", ("conv_id", "turn"), "text", known).select("session", "topic", "conv_id", "turn")


def drifted_topics(spark, sf):
    events, cut = table(spark, sf, "events"), ts("2024-01-04 00:00:00")
    old, new = (profile.topic_weights(events.filter(c), "event_type", ("user_id",), 100) for c in (F.col("ts") < cut, F.col("ts") >= cut))
    return profile.drifted_topics(old, new, "user_id").select("user_id", F.array_join("topics", ",").alias("topics"))


# --- conversations ---------------------------------------------------------------------------------------------------
def compaction_by_task(spark, sf):
    """A conversation ten times over, so that all limits are met."""
    t = table(spark, sf, "conversations").withColumn("task", pick(("debugging", "code_review", "general", "other"), F.col("conv_id"))).withColumn("text", F.repeat("text", F.lit(10)))
    return turns.compaction_by_task(t).select("conv_id", "task", "tokens", *long("keep_turns"), "action")


def summary_inputs(spark, sf):
    t = table(spark, sf, "conversations").withColumn("text", F.when(F.col("turn") % 2 == 1, F.concat(F.lit("```code``` "), F.repeat("text", F.lit(20)))).otherwise(F.col("text")))
    return turns.summary_input(t).select("conv_id", F.length("text").cast("long").alias("n_chars"), F.md5(F.col("text").cast("binary")).alias("digest"))


def session_stats(spark, sf):
    return turns.session_stats(turns.accepted_pairs(table(spark, sf, "conversations")))


def exported_pairs(spark, sf):
    e = table(spark, sf, "events")
    said = e.select(F.col("event_id").alias("id"), F.col("event_type").alias("input_text"), F.col("props").alias("output_text"), F.lit(None).cast("string").alias("context"), F.lit("m").alias("model"), F.when(F.col("event_id") % 3 > 0, F.col("value") > 20).alias("was_accepted"))
    marks = e.filter(F.col("event_id") % 2 == 0).select(F.col("event_id").alias("record_id"), pick(("positive", "negative", "neutral"), F.col("user_id")).alias("feedback"))
    second = e.filter(F.col("event_id") % 4 == 0).select(F.col("event_id").alias("record_id"), pick(("negative", "positive"), F.col("event_id") / 4).alias("feedback"))
    marks = marks.withColumn("marked", F.lit(1)).unionByName(second.withColumn("marked", F.lit(2)))
    every = [turns.exported_pairs(said, marks, least, "marked").groupBy("instruction").agg(F.count("*").alias("n"), F.max("metadata.id").alias("last_id")).withColumn("least", F.lit(least)) for least in ("positive", "neutral", "any")]
    return every[0].unionByName(every[1]).unionByName(every[2])


def enriched_captures(spark, sf):
    e = table(spark, sf, "events").select(F.col("event_id").alias("id"), "user_id", "props", "event_type", "value")
    match = lambda some, n: e.filter(some).select("id", F.repeat("event_type", F.pmod("user_id", F.lit(n)).cast("int")).alias("thinking"), F.repeat("props", F.pmod("id", F.lit(8)).cast("int")).alias("text"), F.when(F.col("id") % 3 > 0, "event_type").alias("prompt"))
    found = turns.enriched(e.select("id"), match(F.col("id") % 5 < 3, 30), match(F.col("id") % 5 > 1, 40))
    return found.groupBy("enrichment_confidence").agg(F.count("*").alias("n"), F.sum(F.length("reasoning")).alias("thinking_chars"), F.sum(F.length("assistant_context")).alias("text_chars"))


# --- routing ---------------------------------------------------------------------------------------------------------
def _topics(spark):
    return spark.createDataFrame([("the", 0.5, "Competent"), ("Und", 0.9, "Expert"), ("les", 0.5, "Competent"), ("con-una", 0.99, "Expert"), ("para", 0.2, "Novice")], "topic string, score double, level string")


def detected_topics(spark, sf):
    return routing.detected_topics(_asked(spark, sf), _topics(spark))


def routing_decisions(spark, sf):
    from skein.plans.catalogue import TASKS

    learned = _asked(spark, sf).select("query_id", F.when(F.col("query_id") % 6 == 0, "law").when(F.col("query_id") % 6 == 1, None).otherwise(None).alias("predicted"))
    return routing.routed(_asked(spark, sf), learned, _topics(spark), TASKS)


def strategy_cascade(spark, sf):
    tasks = _asked(spark, sf).select("query_id", pick(("debugging", "general", "odd"), F.col("query_id")).alias("task"), F.when(F.col("query_id") % 4 == 0, "sql").when(F.col("query_id") % 4 == 1, "web").alias("topic"))
    arms = spark.createDataFrame([("debugging", "deep_graph"), ("debugging_sql", "graph_boost"), ("general_web", "vector_focus"), ("odd", "default")], "context string, arm string")
    overrides = spark.createDataFrame([("debugging", None, 0.9), ("general_web", 5.0, None), ("general", 1.0, 0.25)], "key string, graph_depth double, vector_weight double")
    return routing.cascaded(tasks, arms, overrides)


def response_report(spark, sf):
    said = table(spark, sf, "conversations").filter("role = 'assistant'").select("conv_id", "turn", "text", F.pmod("conv_id", F.lit(4)).cast("string").alias("category"), pick(("easy", "hard"), F.col("turn")).alias("difficulty"), F.col("turn").cast("double").alias("latency"))
    return routing.response_report(routing.response_scores(said, ("the", "and", "erth"), ("thing", "und")), "category", "difficulty")


# --- records ---------------------------------------------------------------------------------------------------------
def _records(spark, sf):
    """Turns as transcript records: content as a string, or as an array of strings and blocks."""
    t = table(spark, sf, "conversations").filter("role <> 'system'")
    block = lambda kind, text: F.to_json(F.struct(F.lit(kind).alias("type"), text.alias(kind)))
    tool = F.to_json(F.struct(F.lit("tool_use").alias("type"), F.concat(F.lit("t"), F.pmod("conv_id", F.lit(50)).cast("string")).alias("id"), F.lit("Edit").alias("name"), F.struct(F.lit("a.py").alias("file_path")).alias("input")))
    quoted = F.regexp_replace(F.to_json(F.struct(F.col("text").alias("x"))), r'^\{"x":(.*)\}$', "$1")
    blocks = F.concat(F.lit("["), block("text", F.col("text")), F.lit(","), block("thinking", F.concat(F.lit("hm "), F.col("role"))), F.lit(","), tool, F.lit(',"bare"]'))
    content = F.when(F.col("turn") % 3 == 0, quoted).otherwise(blocks)
    record = F.concat(F.lit('{"type":"'), "role", F.lit('","uuid":"u'), (F.col("turn") - F.col("turn") % 2).cast("string"), F.lit('","timestamp":"2026-01-01","message":{"role":"'), "role", F.lit('","content":'), content, F.lit("}}"))
    return t.select(F.concat(F.lit("c"), F.col("conv_id").cast("string")).alias("file"), F.col("turn").alias("ord"), record.alias("record"))


def session_messages(spark, sf):
    found = lake.messages_of(_records(spark, sf))
    return found.select("file", "ord", "role", F.md5(F.col("text").cast("binary")).alias("text"), "thinking", F.size("tools").cast("long").alias("n_tools"))


def messages_by_uuid(spark, sf):
    return lake.messages_by_uuid(lake.messages_of(_records(spark, sf))).select("file", "uuid", "role", F.length("text").cast("long").alias("n_chars"))


def tool_messages(spark, sf):
    wanted = spark.range(60).select(F.concat(F.lit("t"), F.col("id").cast("string")).alias("tool_use_id"))
    return lake.tool_messages(lake.messages_of(_records(spark, sf)), wanted).select("tool_use_id", "ord")


def _training_records(spark, sf):
    d = table(spark, sf, "documents").filter("text IS NOT NULL")
    fields = F.struct(F.when(F.col("doc_id") % 2 == 0, F.col("source")).alias("instruction"), F.when(F.col("doc_id") % 5 > 0, F.col("text")).alias("output"), F.col("text").alias("text"), F.when(F.col("doc_id") % 3 == 0, F.col("lang")).alias("category"), F.concat(F.lit("proj"), F.pmod("doc_id", F.lit(4)).cast("string"), F.lit("/x.py")).alias("source_file"))
    return d.select(F.lit("f").alias("file"), F.to_json(fields).alias("record"))


def index_rows(spark, sf):
    return lake.index_rows(_training_records(spark, sf)).groupBy("category", "project").agg(F.count("*").alias("n"), F.sum(F.length("text")).alias("n_chars"))


def keyword_rows(spark, sf):
    return lake.keyword_rows(_training_records(spark, sf)).groupBy("id", "category").agg(F.count("*").alias("n"), F.max(F.length("text")).cast("long").alias("n_chars"))


def _profile_rows(spark, sf):
    """Users with what they did as topics (by number), habits and tasks."""
    e = table(spark, sf, "events").groupBy("user_id", "event_type").agg(F.count("*").alias("n"))
    own = e.groupBy("user_id").agg(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("n"), "event_type"))).alias("t"), F.array_sort(F.collect_list("event_type")).alias("task_types"))
    u = F.col("user_id")
    profiles = own.select(
        "user_id", pick(("software_engineering", "data_science", "unknown"), u).alias("domain"), (u % 10 / 10).alias("domain_confidence"), pick(("en", "es"), u).alias("language"), (u % 11 / 10).alias("formality"), (u % 9 / 8).alias("verbosity"),
        F.transform("t", lambda x: x["event_type"]).alias("topics"), F.transform(F.filter("t", lambda x: x["n"] <= -14), lambda x: F.concat(F.lit("Use "), x["event_type"])).alias("patterns"), "task_types",
    )
    competence = e.select("user_id", F.col("event_type").alias("topic"), F.when(F.col("n") >= 18, "Expert").when(F.col("n") >= 12, "Competent").otherwise("Novice").alias("level"), (-F.col("n")).alias("place"))
    return profiles, competence


PROMPT_TASKS = ("debugging", "architecture", "explanation", "general", "poetry")


def system_prompts(spark, sf):
    profiles, competence = _profile_rows(spark, sf)
    asked = profiles.select("user_id", pick(PROMPT_TASKS, F.col("user_id")).alias("task"))
    return prompts.system_prompts(asked, profiles, competence)


QUERIES = (
    pair_triples, thought_triples, decision_triples, learning_triples, capture_triples, model_json_triples,
    profile_build, capture_counts, tag_counts, task_types, capture_topics, topic_activity, topic_edges, competence_lookup, instinct_matches, instinct_changes, instinct_summary, instinct_review,
    feedback_loop, arm_updates, best_arms, habit_trigger, drifted_topics,
    compaction_by_task, summary_inputs, session_stats, exported_pairs, enriched_captures,
    detected_topics, routing_decisions, strategy_cascade, response_report, session_messages, messages_by_uuid, tool_messages, index_rows, keyword_rows,
    system_prompts,
)
