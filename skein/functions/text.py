"""Text expressions: tokens, names, ids, and tests on prefixes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

WORD = r"[\p{L}\p{N}_]{2,}"


def words(text: Column) -> Column:
    """Lower-cased runs of two or more letters, digits or underscores, repeats included."""
    return F.regexp_extract_all(F.lower(text), F.lit(WORD), F.lit(0))


def distinct_words(text: Column, stop: tuple[str, ...] = ()) -> Column:
    found = F.array_distinct(words(text))
    return F.array_except(found, F.array(*map(F.lit, stop))) if stop else found


def space_tokens(text: Column) -> Column:
    """Lower-cased parts between white space, repeats included."""
    return F.filter(F.split(F.lower(text), r"\s+"), lambda t: t != "")


def token_set(text: Column) -> Column:
    return F.array_distinct(space_tokens(text))


def normal_name(name: Column) -> Column:
    return F.lower(F.regexp_replace(name, r"^\s+|\s+$", ""))


def entity_id(name: Column) -> Column:
    """Twelve hexadecimal digits that name an entity by its normalised name."""
    return F.substring(F.md5(normal_name(name).cast("binary")), 1, 12)


def overlap(a: Column, b: Column) -> Column:
    """Shared elements over the size of the smaller set; 0 if either is empty."""
    least = F.least(F.size(a), F.size(b))
    return F.when(least == 0, F.lit(0.0)).otherwise(F.size(F.array_intersect(a, b)) / least)


def jaccard(a: Column, b: Column) -> Column:
    """Shared elements over all elements; 1 for two empty sets."""
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, F.lit(1.0)).otherwise(F.size(F.array_intersect(a, b)) / union)


def starts_negation(text: Column, keywords: tuple[str, ...]) -> Column:
    """Whether the first 50 characters start with a keyword or hold one after a space."""
    head = F.lower(F.substring(text, 1, 50))
    return F.exists(F.array(*map(F.lit, keywords)), lambda k: F.startswith(head, k) | F.contains(head, F.concat(F.lit(" "), k)))


def without_fences(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(text, r"(?s)```.*?```", ""), r"^\s+|\s+$", "")


def bigrams(tokens: Column) -> Column:
    """Neighbouring pairs, space-joined."""
    pairs = F.zip_with(F.slice(tokens, 1, F.greatest(F.size(tokens) - 1, F.lit(0))), F.slice(tokens, 2, F.greatest(F.size(tokens) - 1, F.lit(0))), lambda a, b: F.concat_ws(" ", a, b))
    return F.when(F.size(tokens) < 2, F.array().cast("array<string>")).otherwise(pairs)


def date_in(name: Column) -> Column:
    """The first yyyy-mm-dd of a file name, or null."""
    return F.nullif(F.regexp_extract(name, r"(\d{4}-\d{2}-\d{2})", 1), F.lit(""))


def base_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def extension(path: Column) -> Column:
    return F.regexp_extract(path, r"[^/.][^/]*(\.[^./]+)$", 1)


def chars4(text: Column) -> Column:
    """The token estimate: a quarter of the characters, rounded down."""
    return F.floor(F.length(text) / 4).cast("long")
