"""Triples from documents, decisions, transcripts and captures by rule tables.

A triple is (ord, subject, subject_type, relation, object, object_type, doc, confidence); `ord` orders the triples of a
build: by zone, document, step and place.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skein.functions import rules as fixed
from skein.functions.automaton import held_names
from skein.functions.text import extension
from skein.session import bounded_batches, spread

#: Confidences of steps, of captures by how they were enriched, and of co-occurring pairs.
CAPTURE_CONFIDENCE, CAPTURE_PAIR = {"high": 0.7, "medium": 0.6}, {"high": 0.6, "medium": 0.55}
CAPTURE_OTHER, PAIR_OTHER, TRANSCRIPT = 0.4, 0.5, 0.65
#: Entity and relation types, and what other names of types mean.
ENTITY_TYPES = ("concept", "technology", "pattern", "error_type", "strategy", "category")
RELATION_TYPES = ("uses", "related_to", "fixes", "part_of", "depends_on", "alternative_to", "learned_from")
OTHER_TYPES = {
    "library": "technology", "framework": "technology", "tool": "technology", "language": "technology", "database": "technology", "service": "technology",
    "design_pattern": "pattern", "architecture": "pattern", "method": "strategy", "technique": "strategy", "approach": "strategy", "bug": "error_type", "issue": "error_type",
}
TRIPLE = "struct<subject:string,subject_type:string,relation:string,object:string,object_type:string,confidence:double>"


@dataclass
class Rules:
    """Names with aliases found as whole words, names with aliases found anywhere, and patterns by name."""

    technologies: dict[str, Sequence[str]] = field(default_factory=lambda: fixed.TECHNOLOGIES)
    patterns: dict[str, Sequence[str]] = field(default_factory=lambda: fixed.PATTERNS)
    errors: dict[str, str] = field(default_factory=lambda: fixed.ERRORS)
    strategies: dict[str, str] = field(default_factory=lambda: fixed.STRATEGIES)
    file_technologies: dict[str, str] = field(default_factory=lambda: fixed.FILE_TECHNOLOGIES)


def whole_words(text: Column, lexicon: dict[str, Sequence[str]]) -> Column:
    """The names of which the text holds the name or an alias between word borders, in the table's order.

    One pass over the text finds all aliases, several words included; an alias of two names stands for both.
    """
    return held_names(text, lexicon, borders=True)


def anywhere(text: Column, lexicon: dict[str, Sequence[str]]) -> Column:
    """The names of which the lower-cased text holds the name or an alias, word borders or not."""
    return held_names(text, lexicon, borders=False)


def matching(text: Column, patterns: dict[str, str]) -> Column:
    """The names whose pattern the text matches, in any case."""
    return F.array_compact(F.array(*(F.when(F.coalesce(text, F.lit("")).rlike(f"(?iu){p}"), F.lit(n)) for n, p in patterns.items()))).cast("array<string>")


def _triples(subjects: Column, subject_type: str, relation: str, other: Column | None, object_type: str, confidence: Column | float) -> Column:
    """Triples of each subject with `other`, or with itself."""
    conf = F.lit(confidence) if isinstance(confidence, float) else confidence
    return F.transform(
        subjects,
        lambda s: F.struct(s.alias("subject"), F.lit(subject_type).alias("subject_type"), F.lit(relation).alias("relation"), (s if other is None else other).alias("object"), F.lit(object_type).alias("object_type"), conf.cast("double").alias("confidence")),
    ).cast(f"array<{TRIPLE}>")


def _pairs(names: Column, confidence: Column | float) -> Column:
    """A triple for each two of the names, by name."""
    conf = F.lit(confidence) if isinstance(confidence, float) else confidence
    ordered = F.array_sort(F.array_distinct(names))
    made = F.transform(
        ordered,
        lambda a, i: F.transform(
            F.slice(ordered, i + 2, F.greatest(F.size(ordered) - i - 1, F.lit(0))),
            lambda b: F.struct(a.alias("subject"), F.lit("technology").alias("subject_type"), F.lit("related_to").alias("relation"), b.alias("object"), F.lit("technology").alias("object_type"), conf.cast("double").alias("confidence")),
        ),
    )
    return F.flatten(made).cast(f"array<{TRIPLE}>")


def _fixes(strategies: Column, errors: Column, confidence: float = 0.6) -> Column:
    """A triple for each strategy and error of one document."""
    return F.flatten(F.transform(errors, lambda e: _triples(strategies, "strategy", "fixes", e, "error_type", confidence))).cast(f"array<{TRIPLE}>")


def _numbered(rows: DataFrame, steps: list[Column], doc: str, zone: int) -> DataFrame:
    """One row for each triple of the steps, in order."""
    flat = rows.select(F.col(doc).cast("string").alias("doc"), F.posexplode(F.concat(*steps)).alias("pos", "t"))
    return flat.select(F.struct(F.lit(zone).alias("zone"), "doc", "pos").alias("ord"), "t.subject", "t.subject_type", "t.relation", "t.object", "t.object_type", "doc", "t.confidence")


def _dealt(rows: DataFrame) -> DataFrame:
    """Rows whose texts go to Python: over idle cores, in Arrow batches of a bounded size."""
    bounded_batches(rows.sparkSession)
    return spread(rows)


def from_pairs(pairs: DataFrame, rules: Rules | None = None, zone: int = 0) -> DataFrame:
    """Triples of training pairs (doc, instruction, output, category), in six steps."""
    r = rules or Rules()
    text = F.concat_ws(" ", F.coalesce("instruction", F.lit("")), F.coalesce("output", F.lit("")))
    rows = _dealt(pairs).select(
        "doc", F.lower(F.trim(F.coalesce("category", F.lit("")))).alias("cat"), whole_words(text, r.technologies).alias("tech"), anywhere(text, r.patterns).alias("pat"), matching(text, r.errors).alias("err"), matching(text, r.strategies).alias("str")
    )
    named = F.when(F.col("cat") != "", F.col("tech")).otherwise(F.array().cast("array<string>"))
    steps = [
        _triples(named, "technology", "related_to", F.col("cat"), "category", 0.6),
        _triples(F.col("tech"), "technology", "related_to", None, "technology", 0.8),
        _triples(F.col("pat"), "pattern", "related_to", None, "pattern", 0.7),
        _triples(F.col("err"), "error_type", "related_to", None, "error_type", 0.7),
        _fixes(F.col("str"), F.col("err")),
        _triples(F.col("str"), "strategy", "related_to", None, "strategy", 0.7),
        _pairs(F.col("tech"), 0.5),
    ]
    return _numbered(rows, steps, "doc", zone)


def from_thoughts(thoughts: DataFrame, rules: Rules | None = None, zone: int = 4, least: int = 100) -> DataFrame:
    """Triples of thinking blocks (doc, text) of `least` characters or more, all of one confidence."""
    r = rules or Rules()
    t = F.col("text")
    rows = _dealt(thoughts.filter(F.length("text") >= least)).select("doc", whole_words(t, r.technologies).alias("tech"), anywhere(t, r.patterns).alias("pat"), matching(t, r.errors).alias("err"), matching(t, r.strategies).alias("str"))
    steps = [
        _triples(F.col("tech"), "technology", "related_to", None, "technology", TRANSCRIPT),
        _triples(F.col("pat"), "pattern", "related_to", None, "pattern", TRANSCRIPT),
        _triples(F.col("str"), "strategy", "related_to", None, "strategy", TRANSCRIPT),
        _triples(F.col("err"), "error_type", "related_to", None, "error_type", TRANSCRIPT),
        _fixes(F.col("str"), F.col("err"), TRANSCRIPT),
        _pairs(F.col("tech"), TRANSCRIPT),
    ]
    return _numbered(rows, steps, "doc", zone)


def from_decisions(decisions: DataFrame, rules: Rules | None = None, zone: int = 1) -> DataFrame:
    """Triples of decisions (doc, topic, chosen, lesson): technologies and learned strategies of the topic."""
    r = rules or Rules()
    blank = lambda c: F.coalesce(c, F.lit(""))
    text = F.concat_ws(" ", blank("topic"), blank("chosen"), blank("lesson"))
    rows = _dealt(decisions).select("doc", F.lower(F.trim(blank("topic"))).alias("topic"), (blank("chosen") != "").alias("chose"), whole_words(text, r.technologies).alias("tech"), matching(text, r.strategies).alias("str"))
    none = F.array().cast("array<string>")
    steps = [
        _triples(F.when(F.col("topic") != "", F.col("tech")).otherwise(none), "technology", "related_to", F.col("topic"), "concept", 0.7),
        _triples(F.when(F.col("chose"), F.col("str")).otherwise(none), "strategy", "learned_from", F.when(F.col("topic") != "", F.col("topic")).otherwise("decision"), "concept", 0.7),
    ]
    return _numbered(rows, steps, "doc", zone)


def from_learnings(learnings: DataFrame, rules: Rules | None = None, zone: int = 2) -> DataFrame:
    """Triples of learnings (doc, topic, applicable_to): the topic related to each technology."""
    r = rules or Rules()
    text = F.concat_ws(" ", F.coalesce("topic", F.lit("")), F.array_join(F.coalesce("applicable_to", F.array().cast("array<string>")), " "))
    topic = F.lower(F.trim(F.coalesce("topic", F.lit(""))))
    rows = _dealt(learnings).select("doc", F.when(topic != "", whole_words(text, r.technologies)).otherwise(F.array().cast("array<string>")).alias("tech"), topic.alias("topic"))
    made = F.transform("tech", lambda t: F.struct(F.col("topic").alias("subject"), F.lit("concept").alias("subject_type"), F.lit("related_to").alias("relation"), t.alias("object"), F.lit("technology").alias("object_type"), F.lit(0.6).alias("confidence")))
    return _numbered(rows, [made.cast(f"array<{TRIPLE}>")], "doc", zone)


def from_captures(captures: DataFrame, rules: Rules | None = None, zone: int = 3) -> DataFrame:
    """Triples of captures (doc, file_modified, description, project, reasoning, enrichment_confidence)."""
    r = rules or Rules()
    blank = lambda c: F.coalesce(F.col(c), F.lit(""))
    base, pair = F.lit(CAPTURE_OTHER), F.lit(PAIR_OTHER)
    for name in CAPTURE_CONFIDENCE:
        base = F.when(F.col("enrichment_confidence") == name, CAPTURE_CONFIDENCE[name]).otherwise(base)
        pair = F.when(F.col("enrichment_confidence") == name, CAPTURE_PAIR[name]).otherwise(pair)
    told = F.when(blank("reasoning") != "", F.concat_ws(" ", blank("description"), blank("reasoning"))).otherwise(blank("description"))
    suffixes = F.create_map(*(F.lit(x) for pair_ in r.file_technologies.items() for x in pair_))
    by_file = F.array_compact(F.array(suffixes[F.lower(extension(blank("file_modified")))]))
    rows = _dealt(captures).select(
        "doc", F.lower(F.trim(blank("project"))).alias("project"), base.alias("base"), pair.alias("pair"), by_file.alias("ext"),
        whole_words(F.concat_ws(" ", blank("file_modified"), told), r.technologies).alias("tech"), anywhere(told, r.patterns).alias("pat"), matching(told, r.strategies).alias("str"),
    )
    both = F.array_sort(F.array_union("ext", "tech"))
    used = F.transform(F.when(F.col("project") != "", both).otherwise(F.array().cast("array<string>")), lambda t: F.struct(F.col("project").alias("subject"), F.lit("concept").alias("subject_type"), F.lit("uses").alias("relation"), t.alias("object"), F.lit("technology").alias("object_type"), F.col("pair").cast("double").alias("confidence")))
    steps = [
        _triples(F.col("ext"), "technology", "related_to", None, "technology", F.col("base")),
        _triples(F.col("tech"), "technology", "related_to", None, "technology", F.col("base")),
        _triples(F.col("pat"), "pattern", "related_to", None, "pattern", F.col("base")),
        _triples(F.col("str"), "strategy", "related_to", None, "strategy", F.col("base")),
        used.cast(f"array<{TRIPLE}>"),
        _pairs(both, 0.5),
    ]
    return _numbered(rows, steps, "doc", zone)


def decision_fields(lines: DataFrame) -> DataFrame:
    """(doc, topic, chosen, lesson) of Markdown lines (doc, no, line).

    The topic is the last line that starts with "# ". What was chosen is the next line that isn't empty after the last
    line with "decision:", "chosen:" or "option:"; the lesson likewise after "lesson", "learning" or "takeaway".
    """
    text, low = F.trim("line"), F.lower("line")
    chose = F.contains(low, F.lit("decision:")) | F.contains(low, F.lit("chosen:")) | F.contains(low, F.lit("option:"))
    learnt = F.contains(low, F.lit("lesson")) | F.contains(low, F.lit("learning")) | F.contains(low, F.lit("takeaway"))
    marks = lines.groupBy("doc").agg(
        F.max_by(F.trim(F.substring(F.col("line"), 3, 1 << 20)), F.when(F.startswith("line", F.lit("# ")), F.col("no"))).alias("topic"), F.max(F.when(chose, F.col("no"))).alias("c"), F.max(F.when(learnt, F.col("no"))).alias("l")
    )
    following = lines.filter(text != "").join(marks.select("doc", "c", "l"), "doc").groupBy("doc").agg(
        F.min_by(text, F.when(F.col("no") > F.col("c"), F.col("no"))).alias("chosen"), F.min_by(text, F.when(F.col("no") > F.col("l"), F.col("no"))).alias("lesson")
    )
    return marks.select("doc", "topic").join(following, "doc", "left")


#: Endings that repair a JSON text that was cut off before any closing brace, in order.
CLOSERS = ("}]}", "]}", "}]")
_MODEL_JSON = "entities array<struct<name:string,type:string>>, relations array<struct<source:string,target:string,type:string>>"


def model_json(response: Column) -> Column:
    """The JSON text of a model's response: fences go, then from the first to the last brace, else with the first closer that parses; null if none does."""
    bare = F.trim(F.coalesce(response, F.lit("")))
    bare = F.when(F.startswith(bare, F.lit("```")), F.regexp_replace(F.regexp_replace(bare, r"^```[^\n]*\n", ""), r"\s*```\s*$", "")).otherwise(bare)
    opened, whole = F.regexp_extract(bare, r"(?s)\{.*", 0), F.regexp_extract(bare, r"(?s)\{.*\}", 0)
    valid = lambda t: F.when(F.try_parse_json(t).isNotNull(), t)
    return F.when(opened == "", F.lit(None)).when(whole != "", valid(whole)).otherwise(F.coalesce(*(valid(F.concat(opened, F.lit(c))) for c in CLOSERS)))


def from_model_json(responses: DataFrame, zone: int = 5, confidence: float = 0.6) -> DataFrame:
    """Triples of model responses (doc, response) that hold {"entities": [{name, type}], "relations": [{source, target, type}]}.

    Names are stripped and lower-cased. An unknown type of an entity goes by OTHER_TYPES, else it is a concept, as is
    an end that is no listed entity; of entities with one name the last counts. An unknown relation is related_to;
    relations without both ends, and responses that are no JSON, are left out.
    """
    low = lambda c: F.lower(F.trim(F.coalesce(c, F.lit(""))))
    read = responses.select("doc", F.from_json(model_json(F.col("response")), _MODEL_JSON).alias("j")).filter("j IS NOT NULL")
    none = lambda fields: F.array().cast(f"array<struct<{fields}>>")
    entities = F.coalesce("j.entities", none("name:string,type:string"))
    relations = F.filter(F.coalesce("j.relations", none("source:string,target:string,type:string")), lambda x: (low(x["source"]) != "") & (low(x["target"]) != ""))
    rows = read.select("doc", F.transform(entities, lambda e: F.struct(low(e["name"]).alias("name"), low(e["type"]).alias("type"))).alias("entities"), relations.alias("relations"))
    meant = F.create_map(*(F.lit(x) for pair in [*((t, t) for t in ENTITY_TYPES), *OTHER_TYPES.items()] for x in pair))

    def kind(name: Column) -> Column:
        own = F.filter("entities", lambda e: e["name"] == name)
        return F.coalesce(meant[F.get(own, F.size(own) - 1)["type"]], F.lit("concept"))

    made = F.transform(
        "relations",
        lambda x: F.struct(
            low(x["source"]).alias("subject"), kind(low(x["source"])).alias("subject_type"), F.when(low(x["type"]).isin(*RELATION_TYPES), low(x["type"])).otherwise("related_to").alias("relation"),
            low(x["target"]).alias("object"), kind(low(x["target"])).alias("object_type"), F.lit(confidence).alias("confidence"),
        ),
    )
    return _numbered(rows, [made.cast(f"array<{TRIPLE}>")], "doc", zone)
