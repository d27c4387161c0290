"""Dictionary and pattern matches in documents, and the triples that follow from them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skein.functions.text import distinct_words, entity_id

#: Confidence of each kind of triple; fixed values.
CONFIDENCE = {"technology": 0.8, "pattern": 0.7, "error": 0.7, "strategy": 0.7, "category": 0.6, "fixes": 0.6, "cooccurrence": 0.5, "transcript": 0.65}


def term_hits(docs: DataFrame, lexicon: dict[str, tuple[str, ...]]) -> DataFrame:
    """(doc_id, term): the canonical terms of which a document holds an alias as a whole word."""
    names = F.create_map(*(F.lit(x) for name, aliases in lexicon.items() for alias in aliases for x in (alias, name)))
    aliases = F.array(*(F.lit(a) for group in lexicon.values() for a in group))
    found = F.array_distinct(F.transform(F.array_intersect(distinct_words(F.col("text")), aliases), lambda a: names[a]))
    return docs.select("doc_id", F.explode(found).alias("term"))


def substring_hits(docs: DataFrame, patterns: tuple[str, ...]) -> DataFrame:
    """(doc columns, pattern): patterns that occur anywhere in the lower-cased text, word borders or not."""
    low = docs.withColumn("low", F.lower("text"))
    found = F.filter(F.array(*map(F.lit, patterns)), lambda p: F.contains(F.col("low"), p))
    return low.select(*docs.columns, F.explode(found).alias("pattern"))


def regex_hits(docs: DataFrame, rules: dict[str, str], name: str) -> DataFrame:
    """(doc_id, name): which of the named patterns match a document's lower-cased text."""
    low = F.lower("text")
    found = F.array_compact(F.array(*(F.when(low.rlike(pattern), F.lit(rule)) for rule, pattern in rules.items())))
    return docs.select("doc_id", F.explode(found).alias(name))


def fixes_pairs(docs: DataFrame, errors: dict[str, str], strategies: dict[str, str]) -> DataFrame:
    """(strategy, error, n_docs, confidence) for every pair found in one document."""
    low = F.lower("text")
    arrays = [F.array_compact(F.array(*(F.when(low.rlike(p), F.lit(r)) for r, p in rules.items()))) for rules in (errors, strategies)]
    both = docs.select(arrays[0].alias("errors"), arrays[1].alias("strategies"))
    pairs = both.select(F.explode("strategies").alias("strategy"), "errors").select("strategy", F.explode("errors").alias("error"))
    return pairs.groupBy("strategy", "error").agg(F.count("*").alias("n_docs")).withColumn("confidence", F.lit(CONFIDENCE["fixes"]))


def entities_of_hits(hits: DataFrame) -> DataFrame:
    """A self-triple for each hit counts as two mentions of its entity."""
    return hits.groupBy("term").agg(F.count("*").alias("n_docs"), F.min("doc_id").alias("first_doc")).select(
        entity_id(F.col("term")).alias("entity_id"), F.col("term").alias("name"), (2 * F.col("n_docs")).alias("mention_count"), "n_docs", "first_doc"
    )


def cooccurrence(hits: DataFrame, weight: float = CONFIDENCE["cooccurrence"], step: float = 0.1) -> DataFrame:
    """Edges between terms of one document, a before b by name, reinforced once for every further document.

    The terms of a document are bounded by the lexicon, so pairs are made inside one row and not by a join.
    """
    terms = hits.groupBy("doc_id").agg(F.array_sort(F.collect_set("term")).alias("terms"))
    first = terms.select("doc_id", "terms", F.posexplode("terms").alias("pos", "a"))
    pairs = first.select("doc_id", "a", F.explode(F.slice("terms", F.col("pos") + 2, F.greatest(F.size("terms") - F.col("pos") - 1, F.lit(0)))).alias("b"))
    edges = pairs.groupBy("a", "b").agg(F.count("*").alias("n"), F.min("doc_id").alias("first_doc"))
    return edges.select("a", "b", F.least(F.lit(1.0), weight + step * (F.col("n") - 1)).alias("weight"), (F.col("n") - 1).alias("reinforcement_count"), "first_doc")


def category_links(hits: DataFrame, docs: DataFrame, category: str) -> DataFrame:
    """(term, category, n_docs, confidence): terms related to the category of the documents that hold them."""
    linked = hits.join(docs.select("doc_id", F.col(category).alias("category")).filter("category IS NOT NULL"), "doc_id")
    return linked.groupBy("term", "category").agg(F.count("*").alias("n_docs")).withColumn("confidence", F.lit(CONFIDENCE["category"]))
