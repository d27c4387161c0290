"""Operators over ordered conversation turns (conv_id, turn, role, text)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skein.functions.text import chars4, overlap, starts_negation, token_set, without_fences
from skein.session import ensure_checkpoints

#: Openings that reject the previous answer.
NEGATIONS = (
    "no,", "no ", "not ", "wrong", "incorrect", "that's not", "thats not", "don't", "dont ", "didn't", "didnt ", "isn't", "isnt ", "wasn't", "wasnt ",
    "no,", "no ", "mal,", "mal ", "incorrecto", "eso no", "esta mal", "está mal", "no es",
)
#: Signs of structure in an output, and what an instruction is about, in order.
STRUCTURE = ("- ", "* ", "1.", "##", "**")
CATEGORIES = {
    "code_generation": ("escribe", "write", "create", "implement", "función", "function", "class"),
    "error_fix": ("fix", "error", "bug", "arregla", "corrige"),
    "refactor": ("refactor", "improve", "optimize", "mejora", "optimiza"),
    "explanation": ("explain", "what", "how", "why", "explica", "qué", "cómo", "por qué"),
    "code_review": ("review", "check", "revisa", "mira"),
    "decision": ("should", "better", "recommend", "debería", "mejor", "recomienda"),
}
#: Soft, hard and emergency token limits and turns kept, by task.
LIMITS = {
    "debugging": (4500, 6000, 7000, 8),
    "code_review": (3500, 5000, 6000, 6),
    "architecture": (3500, 5000, 6000, 6),
    "general": (2500, 4000, 5000, 4),
    "explanation": (2500, 4000, 5000, 4),
}
OTHER_LIMITS = (3500, 5000, 6000, 6)


def pairs(turns: DataFrame) -> DataFrame:
    """(conv_id, turn, instruction, output): assistant turns whose previous user or assistant turn is a user's."""
    w = Window.partitionBy("conv_id").orderBy("turn")
    spoken = turns.filter(F.col("role").isin("user", "assistant") & (F.col("text") != ""))
    both = spoken.withColumn("before", F.lag("role").over(w)).withColumn("instruction", F.lag("text").over(w))
    return both.filter("role = 'assistant' AND before = 'user'").select("conv_id", "turn", "instruction", F.col("text").alias("output"))


def quality(instruction: Column, output: Column) -> Column:
    """0.5 and up for long, fenced or structured outputs, down for short ones; between 0 and 1."""
    n, n_words = F.length(output), F.size(F.filter(F.split(output, r"\s+"), lambda t: t != ""))
    structured = F.exists(F.array(*map(F.lit, STRUCTURE)), lambda m: F.contains(output, m))
    score = (
        F.lit(0.5)
        + F.when(n > 500, 0.1).otherwise(0.0)
        + F.when(n > 1000, 0.1).otherwise(0.0)
        + F.when(F.contains(output, F.lit("```")), 0.15).otherwise(0.0)
        + F.when(structured, 0.05).otherwise(0.0)
        - F.when(n < 100, 0.2).otherwise(0.0)
        - F.when(n_words < 10, 0.3).otherwise(0.0)
    )
    return F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), score)), 6)


def categorised(rows: DataFrame, rules: dict[str, tuple[str, ...]] = CATEGORIES, fenced: tuple[str, ...] = ("code_generation",), otherwise: str = "general") -> DataFrame:
    """`rows` with `category`: the first rule with a substring in the lower-cased instruction; fenced ones need a code fence."""
    low = F.lower("instruction")
    out = F.lit(otherwise)
    for name, parts in reversed(rules.items()):
        hit = F.exists(F.array(*map(F.lit, parts)), lambda p: F.contains(low, p))
        if name in fenced:
            hit = hit & F.contains(F.col("output"), F.lit("```"))
        out = F.when(hit, F.lit(name)).otherwise(out)
    return rows.withColumn("category", out)


def accepted_pairs(turns: DataFrame, rules: dict[str, tuple[str, ...]] = CATEGORIES, least: float = 0.4) -> DataFrame:
    """Pairs with 10 and 20 characters at least and a quality of `least`, with id, category and score."""
    scored = pairs(turns).withColumn("score", quality(F.col("instruction"), F.col("output")))
    good = scored.filter((F.length("instruction") >= 10) & (F.length("output") >= 20) & (F.col("score") >= least))
    key = F.substring(F.md5(F.concat("instruction", "output").cast("binary")), 1, 12)
    return categorised(good, rules).select(key.alias("pair_id"), "conv_id", "turn", "category", "score")


def outcomes(turns: DataFrame, same: float = 0.5, negated: float = 0.3) -> DataFrame:
    """(conv_id, turn, outcome, reason, overlap): what the next user turn says about each user turn.

    A negation with some overlap or a large overlap rejects, any other next turn accepts, the last one is neutral.
    """
    w = Window.partitionBy("conv_id").orderBy("turn")
    asked = turns.filter("role = 'user'").withColumn("next", F.lead("text").over(w))
    scored = asked.withColumn("overlap", F.when(F.col("next").isNotNull(), overlap(token_set(F.col("text")), token_set(F.col("next")))))
    return scored.select("conv_id", "turn", *outcome_of(F.col("next"), F.col("overlap"), same, negated), F.round("overlap", 6).alias("overlap"))


def outcome_of(following: Column, share: Column, same: float, negated: float) -> tuple[Column, Column]:
    no = starts_negation(following, NEGATIONS) & (share > negated)
    outcome = F.when(following.isNull(), "neutral").when(no | (share >= same), "rejected").otherwise("accepted")
    reason = F.when(following.isNull(), "session_close").when(no, "negation").when(share >= same, "reformulation").otherwise("new_topic")
    return outcome.alias("outcome"), reason.alias("reason")


def outcome_rates(found: DataFrame, *keys: str) -> DataFrame:
    """Totals, accepted and rate of non-neutral outcomes for each combination of `keys` and over all (nulls)."""
    counted = found.rollup(*keys).agg(F.count("*").alias("total"), F.count_if(F.col("outcome") == "accepted").alias("accepted"), F.count_if(F.col("outcome") == "rejected").alias("rejected"))
    both = F.col("accepted") + F.col("rejected")
    return counted.withColumn("rate", F.when(both > 0, F.round(F.col("accepted") / both, 6)))


def _ranked(turns: DataFrame) -> DataFrame:
    spoken = F.col("role").isin("user", "assistant")
    back = Window.partitionBy("conv_id", spoken).orderBy(F.desc("turn"))
    return turns.withColumn("spoken", spoken).withColumn("from_end", F.row_number().over(back)).withColumn("last_role", F.first("role").over(back)).withColumn(
        "tokens_from_end", F.sum(chars4(F.col("text"))).over(back.rowsBetween(Window.unboundedPreceding, 0))
    )


def snip(turns: DataFrame, keep_turns: int) -> DataFrame:
    """System turns and the last `keep_turns` exchanges, one more turn if the last is a user's."""
    room = 2 * keep_turns + F.when(F.col("last_role") == "user", 1).otherwise(0)
    return _ranked(turns).filter(~F.col("spoken") | (F.col("from_end") <= room)).select(*turns.columns)


def emergency_trim(turns: DataFrame, limit: int) -> DataFrame:
    """System turns and the longest tail of user and assistant turns with at most `limit` tokens."""
    return _ranked(turns).filter(~F.col("spoken") | (F.col("tokens_from_end") <= limit)).select(*turns.columns)


def limits_of(task: Column, no: int) -> Column:
    out = F.lit(OTHER_LIMITS[no])
    for name, own in LIMITS.items():
        out = F.when(task == name, F.lit(own[no])).otherwise(out)
    return out


def compaction_plan(turns: DataFrame, soft: int | Column, hard: int | Column, emergency: int | Column) -> DataFrame:
    """(conv_id, tokens, action): none below the soft limit, snip below the hard one, else summary, or emergency beyond that."""
    tokens = F.sum(F.when(F.col("role").isin("user", "assistant"), chars4(F.col("text"))).otherwise(0)).alias("tokens")
    action = F.when(F.col("tokens") < soft, "none").when(F.col("tokens") < hard, "snip").when(F.col("tokens") <= emergency, "summary").otherwise("emergency")
    keys = ["conv_id", *(["task"] if "task" in turns.columns else [])]
    return turns.groupBy(*keys).agg(tokens).withColumn("action", action)


def compaction_by_task(turns: DataFrame) -> DataFrame:
    """(conv_id, task, tokens, keep_turns, action) of turns (conv_id, role, text, task), by the limits of each task."""
    task = F.col("task")
    return compaction_plan(turns, limits_of(task, 0), limits_of(task, 1), limits_of(task, 2)).withColumn("keep_turns", limits_of(task, 3))


#: Characters of dropped turns that a summary is made from.
SUMMARY_CHARS = 12_000


def summary_input(turns: DataFrame) -> DataFrame:
    """(conv_id, text): "role: text" of each turn in order, without code fences, a blank line between, cut at 12,000 characters.

    The cut is part of the operator; it is taken on running lengths, so no conversation is put together beyond it.
    """
    line = F.concat("role", F.lit(": "), without_fences(F.col("text")))
    lines = turns.filter(F.col("text").isNotNull()).select("conv_id", "turn", line.alias("line"))
    before = F.sum(F.length("line") + 2).over(Window.partitionBy("conv_id").orderBy("turn").rowsBetween(Window.unboundedPreceding, -1))
    # A line whose text lies beyond the cut may still bring the blank line before it.
    short = lines.withColumn("before", F.coalesce(before, F.lit(0))).filter(F.col("before") < SUMMARY_CHARS + 2)
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", "line"))), lambda x: x["line"]), "\n\n")
    return short.groupBy("conv_id").agg(F.substring(joined, 1, SUMMARY_CHARS).alias("text"))


def summarised(turns: DataFrame, keep_turns: int) -> DataFrame:
    """`turns` with the part that `snip` drops replaced by one system turn of its first sentences.

    The summary takes the first sentence of each dropped turn, in order; conversations from which nothing is dropped
    stay as they are.
    """
    kept = snip(turns, keep_turns)
    dropped = turns.join(kept.select("conv_id", "turn"), ["conv_id", "turn"], "left_anti")
    first = F.regexp_extract("text", r"^\s*([^.\n]*)", 1)
    lines = dropped.groupBy("conv_id").agg(F.min("turn").alias("turn"), F.array_sort(F.collect_list(F.struct("turn", first.alias("line")))).alias("lines"))
    note = lines.select("conv_id", "turn", F.lit("system").alias("role"), F.concat(F.lit("- "), F.array_join(F.transform("lines", lambda x: x["line"]), "\n- ")).alias("text"))
    return kept.select("conv_id", "turn", "role", "text").unionByName(note)


def parent_chain(messages: DataFrame, starts: DataFrame, hops: int = 20) -> DataFrame:
    """(conv_id, id, depth, n_nodes, context) of each start's chain of parents, at most `hops` long.

    `messages` has (conv_id, id, parent, role, text). A chain ends at a message without a known parent or at the first
    user message, which belongs to it; `context` joins the assistant's texts of the chain in the order of the
    conversation, the start's own included. Steps go on while a chain is open and are cut off by checkpoints.
    """
    ensure_checkpoints(messages.sparkSession)
    nodes = messages.select("conv_id", F.col("id").alias("node"), "parent", "role", "text")
    step = starts.select("conv_id", "id", F.col("id").alias("node"), F.lit(0).alias("depth")).join(nodes, ["conv_id", "node"]).checkpoint()
    walked = step
    for depth in range(1, hops + 1):
        up = step.filter("parent IS NOT NULL AND (depth = 0 OR role <> 'user')").select("conv_id", "id", F.col("parent").alias("node"), F.lit(depth).alias("depth"))
        step = up.join(nodes, ["conv_id", "node"]).checkpoint()
        if step.isEmpty():
            break
        walked = walked.unionByName(step)
    said = F.when(F.col("role") == "assistant", F.struct((-F.col("depth")).alias("d"), "text"))
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(said)), lambda x: x["text"]), "\n\n")
    return walked.groupBy("conv_id", "id").agg(F.max("depth").cast("long").alias("depth"), F.count("*").alias("n_nodes"), joined.alias("context"))


def session_stats(accepted: DataFrame) -> DataFrame:
    """(category, sessions, pairs) of accepted pairs (conv_id, category), and over all (a null category)."""
    return accepted.rollup("category").agg(F.count_distinct("conv_id").alias("sessions"), F.count("*").alias("pairs"))


def exported_pairs(interactions: DataFrame, feedback: DataFrame, least: str = "any", order: str = "timestamp") -> DataFrame:
    """(instruction, input, output, metadata) of interactions (id, input_text, output_text, context, model, was_accepted) by their latest feedback (record_id, feedback, `order`).

    `least` positive takes positive ones alone, neutral all that aren't negative, any all; what was not accepted never
    counts, no word on acceptance does.
    """
    last = feedback.groupBy(F.col("record_id").alias("id")).agg(F.max_by("feedback", F.struct(F.col(order), "feedback")).alias("feedback"))
    both = interactions.join(last, "id", "left")
    keep = {"positive": F.coalesce(F.col("feedback") == "positive", F.lit(False)), "neutral": F.coalesce(F.col("feedback") != "negative", F.lit(True)), "any": F.lit(True)}[least]
    good = both.filter(keep & F.coalesce("was_accepted", F.lit(True)))
    return good.select(F.col("input_text").alias("instruction"), F.coalesce("context", F.lit("")).alias("input"), F.col("output_text").alias("output"), F.struct("id", "model", "feedback").alias("metadata"))


def enriched(captures: DataFrame, direct: DataFrame, fuzzy: DataFrame, keep_low: bool = True) -> DataFrame:
    """`captures` (id, …) with thinking, text and prompt of the direct match, else of the fuzzy one, and enrichment_confidence.

    Both matches have (id, thinking, text, prompt). Confidence is high with over 100 characters of thinking, medium with
    over 50 of text, else low; low ones stay only with `keep_low` and a prompt.
    """
    d = direct.select("id", F.struct("thinking", "text", "prompt").alias("d"))
    f = fuzzy.select("id", F.struct("thinking", "text", "prompt").alias("f"))
    some = lambda c: (F.length(F.coalesce(F.col(f"{c}.thinking"), F.lit(""))) + F.length(F.coalesce(F.col(f"{c}.text"), F.lit("")))) > 0
    both = captures.join(d, "id", "left").join(f, "id", "left").withColumn("m", F.when(some("d"), F.col("d")).when(some("f"), F.col("f")))
    conf = F.when(F.length("m.thinking") > 100, "high").when(F.length("m.text") > 50, "medium").otherwise("low")
    out = both.filter("m IS NOT NULL").select(*captures.columns, F.col("m.thinking").alias("reasoning"), F.col("m.text").alias("assistant_context"), F.col("m.prompt").alias("user_prompt"), conf.alias("enrichment_confidence"))
    prompted = F.length(F.coalesce("user_prompt", F.lit(""))) > 0
    return out.filter((F.col("enrichment_confidence") != "low") | (F.lit(keep_low) & prompted))
