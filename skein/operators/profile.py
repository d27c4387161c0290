"""Profiles, competence and the feedback loop as aggregates over logs."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skein.functions.automaton import held_names
from skein.functions.scores import half_life, level, linear_saturation, log_saturation, stepped_decay
from skein.functions.text import date_in, extension
from skein.operators.retrieve import in_query_blocks
from skein.session import ensure_checkpoints

#: Weights of entries, density, recency and outcome by (graph, recency, outcome) being known.
COMPETENCE_WEIGHTS = {
    (True, True, True): (0.30, 0.25, 0.20, 0.25),
    (False, True, True): (0.40, 0.0, 0.30, 0.30),
    (True, False, True): (0.40, 0.30, 0.0, 0.30),
    (False, False, True): (0.60, 0.0, 0.0, 0.40),
    (True, True, False): (0.5, 0.3, 0.2, 0.0),
    (False, True, False): (0.7, 0.0, 0.3, 0.0),
    (True, False, False): (0.6, 0.4, 0.0, 0.0),
    (False, False, False): (1.0, 0.0, 0.0, 0.0),
}
#: Prior successes and failures of the first arm and of all others.
DEFAULT_PRIOR, OTHER_PRIOR = (2, 1), (1, 1)
DRIFT, ALPHA_CALM, ALPHA_DRIFT, TOPICS = 0.3, 0.3, 0.7, 10
#: Categories that say what is done, not what it is about.
META_CATEGORIES = ("general", "error_fix", "explanation", "code_generation", "refactor", "decision")
#: The canonical task type of a category; None drops it, others stand for themselves.
TASK_TYPES = {
    "debugging": "debugging", "debugging-real": "debugging", "error_fix": "debugging", "code_review": "code_review", "code-review": "code_review",
    "ddd": "architecture", "hexagonal": "architecture", "clean-architecture": "architecture", "architecture-decisions": "architecture", "api-design": "architecture",
    "ml": "ml_engineering", "ml-finetuning": "ml_engineering", "ml-rag": "ml_engineering", "ml-embeddings": "ml_engineering", "ml-agents": "ml_engineering",
    "ml-prompting": "ml_engineering", "ml-quantization": "ml_engineering", "ml-deployment": "ml_engineering", "ml-vectordb": "ml_engineering", "ml-evaluation": "ml_engineering",
    "agents": "ml_engineering", "langgraph": "ml_engineering", "docker": "devops", "kubernetes": "devops", "terraform": "devops", "cicd": "devops", "nginx": "devops", "git": "devops",
    "angular": "frontend", "react": "frontend", "nextjs": "frontend", "typescript": "frontend", "postgresql": "backend", "fastapi": "backend", "python": "backend",
    "security": "security", "keycloak": "security", "testing": "testing", "refactoring": "refactoring", "code_generation": "generation", "explanation": "generation",
    "general": None, "decision": None, "refactor": None,
}
#: Languages by suffix, frameworks by category in order, formal categories.
LANGUAGES = {
    ".py": "Python", ".ts": "TypeScript", ".tsx": "TypeScript", ".js": "JavaScript", ".jsx": "JavaScript", ".java": "Java", ".go": "Go", ".rs": "Rust",
    ".rb": "Ruby", ".cs": "C#", ".cpp": "C++", ".c": "C", ".kt": "Kotlin", ".swift": "Swift",
}
CODE_SUFFIXES = (*LANGUAGES, ".h", ".vue", ".svelte", ".sh", ".sql")
FRAMEWORKS = {"fastapi": "FastAPI with async/await and Pydantic", "django": "Django", "flask": "Flask", "angular": "Angular", "react": "React with TypeScript", "nextjs": "Next.js"}
FORMAL = ("ddd", "terraform", "kubernetes", "civil_law", "labor_law")
#: Rows that a table of topics or instincts may have where each row of another table is held against all of them.
SMALL_TABLE = 10_000


def small(table: DataFrame, limit: int = SMALL_TABLE) -> list:
    """All rows of a table that has `limit` rows at most; more are an error, never cut off."""
    rows = table.limit(limit + 1).collect()
    if len(rows) > limit:
        raise ValueError(f"more than {limit} rows in a table that should be small")
    return rows


def tag_counts(rows: DataFrame) -> DataFrame:
    """(what, name, n) of (category, tags): rows by category, by each of their tags, and in all (a null name)."""
    every = F.concat(F.array(F.struct(F.lit("category").alias("what"), F.col("category").alias("name")), F.struct(F.lit("total").alias("what"), F.lit(None).cast("string").alias("name"))), F.transform(F.coalesce("tags", F.array().cast("array<string>")), lambda t: F.struct(F.lit("tag").alias("what"), t.alias("name"))))
    return rows.select(F.inline(every)).groupBy("what", "name").agg(F.count("*").alias("n"))


def capture_counts(captures: DataFrame) -> DataFrame:
    """(what, name, n) of (project, file_modified, tool): by project, by suffix in its own case, by tool, and in all."""
    every = F.array(*(F.struct(F.lit(w).alias("what"), c.alias("name")) for w, c in (("project", F.col("project")), ("suffix", extension(F.col("file_modified"))), ("tool", F.col("tool")), ("total", F.lit(None).cast("string")))))
    named = captures.select(F.inline(every)).filter("what = 'total' OR name <> ''")
    return named.groupBy("what", "name").agg(F.count("*").alias("n"))


def task_types(counts: DataFrame, top: int = 10) -> DataFrame:
    """(task_type, n) of (category, n): categories brought to their canonical types, the `top` first by count, then name."""
    meant = F.create_map(*(F.lit(x) for k, v in TASK_TYPES.items() if v for x in (k, v)))
    dropped = [k for k, v in TASK_TYPES.items() if v is None]
    named = counts.filter(~F.col("category").isin(*dropped)).select(F.coalesce(meant[F.col("category")], F.col("category")).alias("task_type"), "n")
    return named.groupBy("task_type").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "task_type").limit(top)


def profile(categories: DataFrame, suffixes: DataFrame) -> DataFrame:
    """One row of a profile from (category, n) and (suffix, n): domain, confidence, formality, patterns, topics, task types.

    The share of code is 0.6 of the suffixes' and 0.4 of the categories', or the one that is known; over 0.3 the domain
    is software development, else the most frequent category. Ties go by name. Without any counts all is unknown.
    """
    code = F.sum(F.when(F.col("suffix").isin(*CODE_SUFFIXES), F.col("n")).otherwise(0))
    ext = suffixes.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n_ext"), F.coalesce(code, F.lit(0)).alias("code_ext"), F.count("*").alias("n_suffixes"))
    first = suffixes.orderBy(F.desc("n"), "suffix").limit(1).select(F.col("suffix").alias("top_suffix"))
    known = F.sum(F.when(F.col("category").isin(*TASK_TYPES), F.col("n")).otherwise(0))
    formal = F.sum(F.when(F.col("category").isin(*FORMAL), F.col("n")).otherwise(0))
    marked = ("ddd", "hexagonal", "clean-architecture", "docker", "kubernetes", "terraform", "langgraph", "agents", "ml", "ml-rag", "ml-agents", *FRAMEWORKS)
    cat = categories.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("n_cat"), F.coalesce(known, F.lit(0)).alias("code_cat"), F.coalesce(formal, F.lit(0)).alias("n_formal"),
        F.collect_set(F.when(F.col("category").isin(*marked), F.col("category"))).alias("held"),
    )
    order = lambda names: F.transform(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("m"), F.col(names).alias("x")))), lambda r: r["x"])
    top5 = categories.orderBy(F.desc("n"), "category").limit(5).agg(order("category").alias("top_five"), F.max("n").alias("top_n"))
    tasks = task_types(categories).agg(order("task_type").alias("task_types"))
    weights = topic_weights_of(categories).agg(F.transform(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("m"), "topic", F.round("weight", 6).alias("weight")))), lambda r: F.struct(r["topic"].alias("topic"), r["weight"].alias("weight"))).alias("topics"))
    # Every side is one row.
    row = ext.join(cat).join(top5).join(tasks).join(weights).join(first, F.lit(True), "left")
    ratio = (
        F.when((F.col("n_ext") > 0) & (F.col("n_cat") > 0), 0.6 * F.col("code_ext") / F.col("n_ext") + 0.4 * F.col("code_cat") / F.col("n_cat"))
        .when(F.col("n_ext") > 0, F.col("code_ext") / F.col("n_ext"))
        .when(F.col("n_cat") > 0, F.col("code_cat") / F.col("n_cat"))
    )
    row = row.withColumn("ratio", ratio).withColumn("code", F.coalesce(F.col("ratio") > 0.3, F.lit(False)))
    has = lambda c: F.array_contains("held", c)
    language = F.create_map(*(F.lit(x) for k, v in LANGUAGES.items() for x in (k, v)))[F.col("top_suffix")]
    framework = F.lit(None).cast("string")
    for name, text in reversed(FRAMEWORKS.items()):
        framework = F.when(has(name), F.lit(text)).otherwise(framework)
    infra = F.array_compact(F.array(*(F.when(has(n), F.lit(n.capitalize())) for n in ("docker", "kubernetes", "terraform"))))
    real = F.slice(F.filter("top_five", lambda c: ~c.isin(*META_CATEGORIES)), 1, 3)
    of_code = F.array_compact(
        F.array(
            F.when(language.isNotNull(), F.concat(F.lit("Use "), language, F.lit(" for code examples"))),
            F.when(framework.isNotNull(), F.concat(F.lit("Prefer "), framework)),
            F.when(has("ddd") | has("hexagonal"), F.lit("Follow DDD and hexagonal architecture")).when(has("clean-architecture"), F.lit("Follow clean architecture patterns")),
            F.when(F.size(infra) > 0, F.concat(F.lit("Deploy with "), F.array_join(infra, ", "))),
            F.when(has("langgraph") | has("agents") | has("ml") | has("ml-rag") | has("ml-agents"), F.lit("Build AI agents and RAG pipelines")),
        )
    )
    of_other = F.when(F.size(real) > 0, F.array(F.concat(F.lit("Key areas: "), F.array_join(real, ", ")))).otherwise(F.array().cast("array<string>"))
    return row.select(
        F.when(F.col("code"), "software_development").when(F.col("n_cat") > 0, F.replace(F.get("top_five", F.lit(0)), F.lit("-"), F.lit("_"))).otherwise("unknown").alias("domain"),
        F.round(F.when(F.col("code"), F.least(F.col("ratio"), F.lit(1.0))).when(F.col("n_cat") > 0, F.col("top_n") / F.col("n_cat")).otherwise(0.0), 6).alias("confidence"),
        F.round(F.when(F.col("n_cat") > 0, F.least(0.4 + 0.6 * F.col("n_formal") / F.col("n_cat"), F.lit(1.0))).otherwise(0.5), 6).alias("formality"),
        F.when(F.col("code"), of_code).otherwise(of_other).alias("patterns"),
        "topics",
        "task_types",
        (F.col("n_ext") + F.col("n_cat")).cast("long").alias("n"),
    )


def topic_weights_of(counts: DataFrame, top: int = TOPICS) -> DataFrame:
    """(topic, n, weight) of (category, n): the most frequent categories that are no meta ones, by their share of those."""
    own = counts.filter(~F.col("category").isin(*META_CATEGORIES))
    total = own.agg(F.sum("n").alias("total"))
    return own.join(F.broadcast(total)).select(F.col("category").alias("topic"), "n", (F.col("n") / F.col("total")).alias("weight")).orderBy(F.desc("n"), "topic").limit(top)


def ordered_union(old: Column, new: Column, most: int | None = None) -> Column:
    """The elements of both arrays in the order in which they first come, `most` at most."""
    both = F.array_distinct(F.concat(old, new))
    return F.slice(both, 1, most) if most else both


def drifted_topics(old: DataFrame, new: DataFrame, key: str, least: float = 0.1) -> DataFrame:
    """(key, topics): topics of (key, topic, weight) whose weight changed by over `least`, by name."""
    both = old.select(key, "topic", F.col("weight").alias("o")).join(new.select(key, "topic", F.col("weight").alias("n")), [key, "topic"], "full").fillna(0.0, ["o", "n"])
    moved = both.filter(F.round(F.abs(F.col("o") - F.col("n")), 9) > least)
    return moved.groupBy(key).agg(F.array_sort(F.collect_set("topic")).alias("topics"))


def topics_of_captures(captures: DataFrame, topics: list[str], by_suffix: dict[str, str]) -> DataFrame:
    """`captures` (tags, project, file_modified, …) with a row for each topic that they belong to.

    A topic is among the tags, or part of the project's name, or what the file's suffix stands for. The topics are a
    short list, so each capture is held against them in its own row and nothing is joined.
    """
    low = lambda c: F.lower(F.coalesce(c, F.lit("")))
    tags = F.transform(F.coalesce("tags", F.array().cast("array<string>")), F.lower)
    by_file = F.create_map(*(F.lit(x) for k, v in by_suffix.items() for x in (k, v.lower())))[low(extension(F.col("file_modified")))]
    held = F.filter(F.array(*map(F.lit, topics)).cast("array<string>"), lambda t: F.array_contains(tags, F.lower(t)) | F.contains(low(F.col("project")), F.lower(t)) | F.coalesce(by_file == F.lower(t), F.lit(False)))
    return captures.select("*", F.explode(held).alias("topic"))


def latest_activity(matched: DataFrame, files: DataFrame, topics: list[str]) -> DataFrame:
    """(topic, last): the latest ISO time of captures (topic, timestamp) and of dates in file names (name) that hold the topic."""
    held = F.filter(F.array(*map(F.lit, topics)).cast("array<string>"), lambda t: F.contains(F.lower("name"), F.lower(t)))
    dated = files.select(F.explode(held).alias("topic"), date_in(F.col("name")).alias("timestamp")).filter("timestamp IS NOT NULL")
    return matched.select("topic", "timestamp").filter("timestamp <> ''").unionByName(dated).groupBy("topic").agg(F.max("timestamp").alias("last"))


def topic_edges(topics: DataFrame, names: DataFrame, edges: DataFrame) -> DataFrame:
    """(topic, edges): edges at the entity that a topic names, loops left out; a topic without an entity has no row.

    `names` has (key, name): each entity under its name and aliases.
    """
    found = topics.select("topic", F.lower("topic").alias("key")).join(names.select(F.lower("key").alias("key"), "name").distinct(), "key").select("topic", "name").distinct()
    ends = edges.filter("src <> dst").select(F.explode(F.array("src", "dst")).alias("name")).groupBy("name").agg(F.count("*").alias("n"))
    return found.join(ends, "name", "left").groupBy("topic").agg(F.sum(F.coalesce("n", F.lit(0))).alias("edges"))


def experts(competences: DataFrame) -> DataFrame:
    return competences.filter("level = 'Expert'")


def competence_of(topics: DataFrame, competences: DataFrame) -> DataFrame:
    """(topic, level, score) of asked topics (topic), Unknown and 0 where nothing is known."""
    known = competences.select(F.lower("topic").alias("key"), "level", "score")
    found = topics.withColumn("key", F.lower("topic")).join(known, "key", "left")
    return found.select("topic", F.coalesce("level", F.lit("Unknown")).alias("level"), F.coalesce("score", F.lit(0.0)).alias("score"))


#: Categories of instincts, and the least confidence of one that is used.
INSTINCT_CATEGORIES, USABLE = ("workflow", "preference", "shortcut", "context", "timing"), 0.3


def usable_instincts(instincts: DataFrame, least: float = USABLE) -> DataFrame:
    return instincts.filter(F.col("enabled") & (F.col("confidence") >= least)).select("id", F.lower("pattern").alias("pattern"), "confidence")


def held_patterns(queries: DataFrame, usable: DataFrame) -> DataFrame:
    """(query_id, pattern) of the patterns of `usable` that a query holds; one of no characters is in every text."""
    patterns = usable.select(F.col("pattern").alias("query_id")).filter("pattern <> ''").distinct()

    def one(block: list) -> DataFrame:
        held = held_names(F.col("text"), {r["query_id"]: () for r in block}, borders=False)
        return queries.filter("text IS NOT NULL").select("query_id", F.explode(held).alias("pattern"))

    # Patterns go through the texts in bounded blocks.
    found = in_query_blocks(patterns, F.length("query_id") + 8, one)
    return found.unionByName(queries.filter("text IS NOT NULL").select("query_id", F.lit("").alias("pattern")))


#: Queries and instincts that meet at once.
CELL_QUERIES, CELL_INSTINCTS = 4096, 1024
#: Tasks that cells are dealt to at most.
MOST_CELL_TASKS = 4000


def matched_instincts(queries: DataFrame, instincts: DataFrame, least: float = USABLE) -> DataFrame:
    """(query_id, id, confidence, rank): enabled instincts (id, pattern, confidence, enabled) whose pattern a query holds, best first.

    Queries that hold the same patterns have the same list, which is ranked once. A list and its queries are dealt into
    cells of a bounded number of rows, so that no pattern is worked off in one task.
    """
    ensure_checkpoints(queries.sparkSession)
    usable = usable_instincts(instincts, least).checkpoint()
    kinds = usable.select("pattern").distinct()
    asked = held_patterns(queries, usable).join(kinds, "pattern", "left_semi").groupBy("query_id").agg(F.array_sort(F.collect_list("pattern")).alias("held")).checkpoint()
    lists = asked.groupBy("held").agg(F.ceil(F.count("*") / F.lit(CELL_QUERIES)).cast("long").alias("blocks"))
    best = Window.partitionBy("held").orderBy(F.desc("confidence"), "id")
    ranked = lists.select("held", F.explode("held").alias("pattern")).join(usable, "pattern").select("held", "id", "confidence", F.row_number().over(best).cast("long").alias("rank"))
    ranked = ranked.withColumn("part", F.floor((F.col("rank") - 1) / CELL_INSTINCTS)).checkpoint()
    sizes = lists.join(ranked.groupBy("held").agg((F.max("part") + 1).alias("parts")), "held").checkpoint()
    n = int(sizes.agg(F.sum(F.col("blocks") * F.col("parts"))).first()[0] or 1)
    upto = lambda c: F.explode(F.sequence(F.lit(0).cast("long"), F.col(c) - 1))
    left = asked.join(sizes, "held").select("query_id", "held", F.pmod(F.xxhash64("query_id"), "blocks").alias("block"), upto("parts").alias("part"))
    right = ranked.join(sizes.select("held", "blocks"), "held").select("held", upto("blocks").alias("block"), "part", "id", "confidence", "rank")
    # A number that is asked for stays: by the size of what is read, Spark would put all cells into a few tasks.
    cells, keys = min(n, MOST_CELL_TASKS), ["held", "block", "part"]
    return left.repartition(cells, *keys).join(right.repartition(cells, *keys), keys).select("query_id", "id", "confidence", "rank")


def changed_instincts(current: DataFrame, changes: DataFrame) -> DataFrame:
    """`current` (id, pattern, category, confidence, enabled) after the last change (id, ord, deleted, …) of each id.

    A change of a category outside the list is left out.
    """
    fields = ["pattern", "category", "confidence", "enabled"]
    good = changes.filter(F.col("deleted") | F.col("category").isin(*INSTINCT_CATEGORIES))
    last = good.groupBy("id").agg(F.max_by(F.struct("deleted", *fields), "ord").alias("c"))
    kept = current.select("id", *fields).join(last.select("id"), "id", "left_anti")
    return kept.unionByName(last.filter("NOT c.deleted").select("id", *(f"c.{f}" for f in fields)))


def instinct_stats(instincts: DataFrame) -> DataFrame:
    """One row: total, enabled, needing review, mean confidence of enabled ones, activations."""
    on = F.col("enabled")
    return instincts.agg(
        F.count("*").alias("total"), F.count_if(on).alias("enabled"), F.count_if(on & (F.col("confidence") < USABLE)).alias("needs_review"),
        F.coalesce(F.round(F.avg(F.when(on, F.col("confidence"))), 3), F.lit(0.0)).alias("mean_confidence"), F.coalesce(F.sum("activations"), F.lit(0)).alias("activations"),
    )


def decayed_instincts(instincts: DataFrame, reference: Column) -> DataFrame:
    """`instincts` (confidence, last_used, …) with `confidence` lowered in steps for every month without use, and idle_days."""
    idle = F.floor(F.timestamp_diff("MICROSECOND", F.col("last_used"), reference) / F.lit(86_400_000_000))
    return instincts.withColumn("idle_days", idle).withColumn("confidence", F.round(stepped_decay(F.col("confidence"), F.col("idle_days")), 6))


def review_candidates(instincts: DataFrame) -> DataFrame:
    return instincts.filter(F.col("enabled") & (F.col("confidence") < USABLE))


def feedback_of(outcomes: DataFrame) -> DataFrame:
    """`outcomes` that are accepted or rejected, with `feedback` positive or negative."""
    meant = F.when(F.col("outcome") == "accepted", "positive").when(F.col("outcome") == "rejected", "negative")
    return outcomes.withColumn("feedback", meant).filter("feedback IS NOT NULL")


def loop_updates(outcomes: DataFrame, decisions: DataFrame, matched: DataFrame) -> tuple[DataFrame, DataFrame]:
    """What each turn's outcome teaches: (context, arm, accepted) of its decision, (key, ord, accepted) of its instincts.

    `outcomes` has (conv_id, turn, outcome) where the outcome is what the next turn said about this one, `decisions`
    (conv_id, turn, context, arm) and `matched` (conv_id, turn, id). Neutral outcomes teach nothing.
    """
    said = feedback_of(outcomes).select("conv_id", "turn", (F.col("feedback") == "positive").alias("accepted"))
    arms = said.join(decisions, ["conv_id", "turn"]).select("context", "arm", "accepted")
    events = said.join(matched, ["conv_id", "turn"]).select(F.col("id").alias("key"), F.struct("conv_id", "turn").alias("ord"), "accepted")
    return arms, events


def taught_instincts(outcomes: DataFrame, queries: DataFrame, instincts: DataFrame, least: float = USABLE) -> DataFrame:
    """(key, confidence, n) of each instinct (id, pattern, …; an id once) that a turn with an outcome matched.

    `outcomes` has (conv_id, turn, outcome), `queries` (query_id, text) with a query_id (conv_id, turn). Instincts of one
    pattern learn from the same turns, so the lesson is worked out once for each pattern.
    """
    usable = usable_instincts(instincts, least)
    held = held_patterns(queries, usable).select("query_id.conv_id", "query_id.turn", F.col("pattern").alias("id"))
    _, events = loop_updates(outcomes, outcomes.select("conv_id", "turn", F.lit(None).alias("context"), F.lit(None).alias("arm")), held)
    lessons = clamped_confidence(events).withColumnRenamed("key", "pattern")
    return usable.select(F.col("id").alias("key"), "pattern").join(lessons, "pattern").select("key", "confidence", "n")


def best_arms(posterior: DataFrame) -> DataFrame:
    """(context, arm, mean) of the arm with the largest mean other than the default one; the lower number wins ties."""
    order = F.struct((-F.col("mean")).alias("m"), "arm_no")
    return posterior.filter("arm_no > 0").groupBy("context").agg(F.min_by("arm", order).alias("arm"), F.max("mean").alias("mean"))


def new_habits(events: DataFrame, session: str, topic: str, order: tuple[str, ...], text: str, known: DataFrame, n: int = 3, least_words: int = 5) -> DataFrame:
    """The n-th query of each topic in each session, of queries of `least_words` words or more; topics of `known` (pattern) are left out."""
    long_ = events.filter(F.size(F.filter(F.split(F.col(text), r"\s+"), lambda t: t != "")) >= least_words)
    return nth_in_session(long_, session, topic, order, n).join(known.select(F.col("pattern").alias(topic)).distinct(), topic, "left_anti")


def topic_weights(rows: DataFrame, topic: str, keys: tuple[str, ...] = (), top: int = TOPICS, without: tuple[str, ...] = ()) -> DataFrame:
    """(keys, topic, n, weight): the most frequent topics and their share of all counted rows."""
    counted = rows.filter(F.col(topic).isNotNull() & ~F.col(topic).isin(*without)) if without else rows.filter(F.col(topic).isNotNull())
    n = counted.groupBy(*keys, F.col(topic).alias("topic")).agg(F.count("*").alias("n"))
    total = n.groupBy(*keys).agg(F.sum("n").alias("total"))
    # The totals have one row for each profile, or one row at all.
    shares = n.join(total, list(keys)) if keys else n.join(F.broadcast(total))
    shares = shares.withColumn("weight", F.col("n") / F.col("total")).drop("total")
    if not keys:
        return shares.orderBy(F.desc("n"), "topic").limit(top)
    ranked = shares.withColumn("__rank", F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("n"), "topic")))
    return ranked.filter(F.col("__rank") <= top).drop("__rank")


def drift_and_merge(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """(key, topic, weight, distance, drifted) of two tables (key, topic, weight).

    The cosine distance between the two distributions decides how much the new one counts; the merged weights are cut
    to ten topics and add up to one. A key with only one side has distance 0.
    """
    both = old.select(key, "topic", F.col("weight").alias("o")).join(new.select(key, "topic", F.col("weight").alias("n")), [key, "topic"], "full").fillna(0.0, ["o", "n"])
    sums = both.groupBy(key).agg(F.sum(F.col("o") * F.col("n")).alias("on"), F.sum(F.col("o") * F.col("o")).alias("oo"), F.sum(F.col("n") * F.col("n")).alias("nn"))
    known = (F.col("oo") > 0) & (F.col("nn") > 0)
    # Rounded, so that the drift decision doesn't hang on the order of a sum.
    distance = F.round(F.when(known, 1 - F.col("on") / F.sqrt(F.col("oo") * F.col("nn"))).otherwise(F.lit(0.0)), 9)
    sums = sums.select(key, distance.alias("distance")).withColumn("drifted", F.col("distance") > DRIFT)
    alpha = F.when(F.col("drifted"), ALPHA_DRIFT).otherwise(ALPHA_CALM)
    mixed = both.join(sums, key).withColumn("w", F.round(alpha * F.col("n") + (1 - alpha) * F.col("o"), 9))
    ranked = mixed.withColumn("rank", F.row_number().over(Window.partitionBy(key).orderBy(F.desc("w"), "topic"))).filter(F.col("rank") <= TOPICS)
    total = F.sum("w").over(Window.partitionBy(key))
    return ranked.select(key, "topic", F.round(F.when(total > 0, F.col("w") / total).otherwise(0.0), 4).alias("weight"), F.round("distance", 6).alias("distance"), "drifted")


def replay_buffer(counts: DataFrame, known: DataFrame, size: int = 20) -> DataFrame:
    """The `size` topics (topic, n) that come first by novelty to `known` (topic), then count."""
    marked = counts.join(known.select("topic", F.lit(0).alias("old")).distinct(), "topic", "left")
    return marked.select("topic", "n", F.when(F.col("old").isNull(), 1).otherwise(0).alias("novelty")).orderBy(F.desc("novelty"), F.desc("n"), "topic").limit(size)


def competence(entries: DataFrame, density: DataFrame, recency: DataFrame, rates: DataFrame, reference: Column, half: float = 30.0) -> DataFrame:
    """(topic, entries, score, level) from (topic, entries), (topic, edges), (topic, last) and (topic, rate).

    Missing sides are unknown, not zero: the weights depend on which sides a topic has.
    """
    joined = entries.join(density, "topic", "left").join(recency, "topic", "left").join(rates, "topic", "left")
    days = F.greatest(F.timestamp_diff("MICROSECOND", F.col("last"), reference) / F.lit(86_400_000_000), F.lit(0.0))
    parts = {
        "entries": log_saturation(F.col("entries")),
        "density": F.coalesce(linear_saturation(F.col("edges")), F.lit(0.0)),
        "recency": F.coalesce(half_life(days, half), F.lit(0.0)),
        "outcome": F.coalesce("rate", F.lit(0.0)),
    }
    has = (F.col("edges").isNotNull(), F.col("last").isNotNull(), F.col("rate").isNotNull())
    score = F.lit(0.0)
    for no, part in enumerate(parts.values()):
        weight = F.lit(0.0)
        for known, weights in COMPETENCE_WEIGHTS.items():
            same = (has[0] == known[0]) & (has[1] == known[1]) & (has[2] == known[2])
            weight = F.when(same, weights[no]).otherwise(weight)
        score = score + weight * part
    return joined.withColumn("score", F.round(score, 6)).select("topic", "entries", "score", level(F.col("score")).alias("level"))


def posteriors(contexts: DataFrame, arms: DataFrame, outcomes: DataFrame) -> DataFrame:
    """(context, arm, arm_no, alpha, beta, mean, best) from outcomes (context, arm, accepted); rows of unknown arms don't count.

    Every context has every arm, by its prior if it was never drawn; arms are a short fixed table (arm, arm_no).
    """
    if arms.count() > SMALL_TABLE:
        raise ValueError(f"more than {SMALL_TABLE} arms")
    grid = contexts.select("context").distinct().join(F.broadcast(arms))
    counts = outcomes.groupBy("context", "arm").agg(F.count_if("accepted").alias("won"), F.count_if(~F.col("accepted")).alias("lost"))
    first = F.col("arm_no") == 0
    full = grid.join(counts, ["context", "arm"], "left").fillna(0, ["won", "lost"])
    full = full.withColumn("alpha", F.when(first, DEFAULT_PRIOR[0]).otherwise(OTHER_PRIOR[0]) + F.col("won")).withColumn("beta", F.when(first, DEFAULT_PRIOR[1]).otherwise(OTHER_PRIOR[1]) + F.col("lost"))
    full = full.withColumn("mean", F.col("alpha") / (F.col("alpha") + F.col("beta")))
    # The default arm takes no part: what is best is what may replace it.
    best = (F.row_number().over(Window.partitionBy("context").orderBy(first, F.desc("mean"), "arm_no")) == 1) & ~first
    return full.select("context", "arm", "arm_no", "alpha", "beta", "mean", best.alias("best"))


def thompson(posterior: DataFrame, seed: int = 0, draws: int = 1) -> DataFrame:
    """(context, draw, arm): for each draw the arm with the largest Beta sample; the seed fixes every sample."""
    @F.pandas_udf("double")
    def sample(alpha: pd.Series, beta: pd.Series, key: pd.Series) -> pd.Series:
        return pd.Series([np.random.default_rng(abs(k)).beta(a, b) for a, b, k in zip(alpha, beta, key, strict=True)])

    rows = posterior.withColumn("draw", F.explode(F.sequence(F.lit(1), F.lit(draws))))
    drawn = rows.withColumn("value", sample("alpha", "beta", F.xxhash64("context", "arm", "draw", F.lit(seed))))
    return drawn.groupBy("context", "draw").agg(F.max_by("arm", F.struct("value", (-F.col("arm_no")).alias("n"))).alias("arm"))


def latest(rows: DataFrame, keys: tuple[str, ...], order: str, tie: str) -> DataFrame:
    """The row of each key with the largest `order`, the lowest `tie` among equals."""
    picked = rows.withColumn("__rank", F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc(order), tie)))
    return picked.filter("__rank = 1").drop("__rank")


def clamped_confidence(events: DataFrame, start: float = 0.5, up: float = 0.03, down: float = 0.05, ceiling: float = 0.95, floor: float = 0.2) -> DataFrame:
    """(key, confidence, n) of (key, ord, accepted): each acceptance adds, each other outcome takes away, within bounds.

    Once a bound is hit the result is no sum. But a run of events is a shift between two bounds, and two such runs in
    a row are one again. So each range partition folds its own part of a key, however hot, and the parts are joined
    up in order.
    """
    parts = events.repartitionByRange("key", "ord").withColumn("part", F.spark_partition_id())
    change = F.array_sort(F.collect_list(F.struct("ord", "accepted")))
    still = F.struct(F.lit(0.0).alias("by"), F.lit(-1e9).alias("low"), F.lit(1e9).alias("high"))

    def moved(run: Column, event: Column) -> Column:
        rise = lambda x: F.least(F.lit(ceiling), x + up)
        fall = lambda x: F.greatest(F.lit(floor), x - down)
        bound = lambda x: F.when(event["accepted"], rise(x)).otherwise(fall(x))
        return F.struct((run["by"] + F.when(event["accepted"], up).otherwise(-down)).alias("by"), bound(run["low"]).alias("low"), bound(run["high"]).alias("high"))

    runs = parts.groupBy("key", "part").agg(F.aggregate(change, still, moved).alias("run"), F.count("*").alias("n"))
    joined = F.aggregate(F.array_sort(F.collect_list(F.struct("part", "run"))), F.lit(start), lambda c, p: F.least(p["run"]["high"], F.greatest(p["run"]["low"], c + p["run"]["by"])))
    return runs.groupBy("key").agg(joined.alias("confidence"), F.sum("n").alias("n"))


def nth_in_session(events: DataFrame, session: str, topic: str, order: tuple[str, ...], n: int = 3) -> DataFrame:
    """The n-th row of each topic in each session: where a habit is noticed."""
    w = Window.partitionBy(session, topic).orderBy(*order)
    return events.withColumn("nth", F.row_number().over(w)).filter(F.col("nth") == n)


def nearest(left: DataFrame, right: DataFrame, key: str, seconds: int) -> DataFrame:
    """(left_id, right_id, gap): for each (key, left_id, left_ts) the nearest (key, right_id, right_ts) under `seconds` away.

    Times are cut into buckets of `seconds`; a row of the right side goes to its own bucket and both neighbours, so
    the join has an equality and no key is compared over its whole history. Ties go to the lower id.
    """
    bucket = lambda c: F.floor(F.unix_micros(F.col(c).cast("timestamp")) / (seconds * 1_000_000))
    a = left.withColumn("bucket", bucket("left_ts"))
    b = right.withColumn("bucket", F.explode(F.array(*(bucket("right_ts") + d for d in (-1, 0, 1)))))
    gap = F.abs(F.timestamp_diff("MICROSECOND", F.col("left_ts"), F.col("right_ts")))
    pairs = a.join(b, [key, "bucket"]).withColumn("gap", gap).filter(F.col("gap") < F.lit(seconds * 1_000_000))
    return pairs.groupBy("left_id").agg(F.min_by("right_id", F.struct("gap", "right_id")).alias("right_id"), F.min("gap").alias("gap"))
