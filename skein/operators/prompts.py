"""System prompts put together from a task, a profile and what the user is competent in."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: What a task asks for, and the parts of a profile that go with it.
INSTRUCTIONS = {
    "debugging": "Focus on root cause analysis. Be direct about the fix.",
    "code_review": "Be specific about issues. Reference patterns and best practices.",
    "architecture": "Explain trade-offs. Consider scalability and maintainability.",
    "explanation": "Be clear and structured. Use examples when helpful.",
    "testing": "Focus on edge cases and coverage. Suggest test strategies.",
    "devops": "Be precise with commands and configs. Warn about destructive ops.",
    "ml_engineering": "Reference specific techniques. Distinguish theory from practice.",
    "general": "",
}
FRAGMENTS = {
    "debugging": ("identity", "tech_stack", "patterns"),
    "code_review": ("identity", "tech_stack", "patterns"),
    "architecture": ("identity", "tech_stack", "patterns", "projects"),
    "explanation": ("identity", "tech_stack"),
    "testing": ("identity", "tech_stack"),
    "devops": ("identity", "tech_stack"),
    "ml_engineering": ("identity", "tech_stack", "patterns"),
    "general": ("identity",),
}
#: The sentence of an unknown user, entries of a list that are named, and the thresholds of style and domain.
ANYONE, NAMED = "You are a general-purpose assistant.", 5
HIGH, LOW, KNOWN_DOMAIN = 0.7, 0.3, 0.1


def _first(name: str, glue: str) -> Column:
    return F.array_join(F.slice(F.coalesce(name, F.array().cast("array<string>")), 1, NAMED), glue)


def _said(text: Column, where: Column) -> Column:
    return F.when(where, text).otherwise(F.lit(""))


def _known() -> Column:
    return F.coalesce((F.col("domain") != "unknown") & (F.col("domain_confidence") >= KNOWN_DOMAIN), F.lit(False))


def _sentences(*parts: Column) -> Column:
    """The parts that say something, with a space between."""
    return F.array_join(F.filter(F.array(*parts), lambda p: p != ""), " ")


def fragment(name: str) -> Column:
    """A part of a profile (domain, domain_confidence, language, formality, verbosity, topics, patterns, task_types) as a sentence.

    Parts are identity, tech_stack, patterns, projects and style; any other one, and one that has nothing to say, is empty.
    """
    some = lambda c: F.coalesce(F.size(c) > 0, F.lit(False))
    other_language = F.coalesce(F.col("language") != "en", F.lit(False))
    spoken = _said(F.concat(F.lit("Respond in "), "language", F.lit(".")), other_language)
    professional = F.concat(F.lit("You are assisting a "), F.replace("domain", F.lit("_"), F.lit(" ")), F.lit(" professional."))
    habits = F.array_join(F.transform(F.slice(F.coalesce("patterns", F.array().cast("array<string>")), 1, NAMED), lambda p: F.concat(p, F.lit("."))), " ")
    tone = F.when(F.col("formality") > HIGH, "Use formal tone.").when(F.col("formality") < LOW, "Use casual tone.").otherwise("")
    length = F.when(F.col("verbosity") < LOW, "Be concise.").when(F.col("verbosity") > HIGH, "Be detailed.").otherwise("")
    return {
        "identity": F.when(_known(), _sentences(professional, spoken)).otherwise(ANYONE),
        "tech_stack": _said(F.concat(F.lit("Tech focus: "), _first("topics", ", "), F.lit(".")), some("topics")),
        "patterns": habits,
        "projects": _said(F.concat(F.lit("Common tasks: "), _first("task_types", ", "), F.lit(".")), some("task_types")),
        "style": _sentences(tone, length),
        "whole": F.when(_known(), _sentences(professional, habits, spoken)).otherwise(f"{ANYONE} Adapt your responses to the user's needs."),
    }.get(name, F.lit(""))


def competence_fragments(competence: DataFrame) -> DataFrame:
    """(user_id, competence): of (user_id, topic, level, place) the first five expert and competent topics of each user, by place."""
    known = competence.filter(F.col("level").isin("Expert", "Competent"))
    rank = F.row_number().over(Window.partitionBy("user_id", "level").orderBy("place", "topic"))
    named = known.withColumn("rank", rank).filter(F.col("rank") <= NAMED).groupBy("user_id", "level").agg(F.array_sort(F.collect_list(F.struct("rank", "topic"))).alias("t"))
    told = named.select("user_id", "level", F.concat(F.col("level"), F.lit(" in: "), F.array_join(F.transform("t", lambda x: x["topic"]), ", ")).alias("part"))
    parts = F.array_sort(F.collect_list(F.struct((F.col("level") == "Competent").alias("second"), "part")))
    return told.groupBy("user_id").agg(parts.alias("p")).select("user_id", F.concat(F.array_join(F.transform("p", lambda x: x["part"]), ". "), F.lit(".")).alias("competence"))


def system_prompts(asked: DataFrame, profiles: DataFrame, competence: DataFrame, personal: bool = True, fragments: dict[str, tuple[str, ...]] = FRAGMENTS, instructions: dict[str, str] = INSTRUCTIONS) -> DataFrame:
    """`asked` (user_id, task, …) with `prompt`: the task's instruction, the profile's parts for it, and what the user is competent in.

    A task that has no list of parts gets the whole profile. Without `personal` only the instruction counts. A user without
    a profile is anyone; a user without competence gets no sentence on it.
    """
    told = F.lit("")
    for task, text in instructions.items():
        told = F.when((F.col("task") == task) & F.lit(text != ""), f"Task: {task}. {text}").otherwise(told)
    if not personal:
        return asked.withColumn("prompt", F.when(told == "", ANYONE).otherwise(told))
    rows = asked.join(profiles, "user_id", "left").join(competence_fragments(competence), "user_id", "left")
    about = fragment("whole")
    for task, names in fragments.items():
        about = F.when(F.col("task") == task, _sentences(*map(fragment, names))).otherwise(about)
    prompt = _sentences(told, about, F.coalesce("competence", F.lit("")))
    return rows.select(*asked.columns, prompt.alias("prompt"))
