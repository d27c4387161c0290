"""All names of a dictionary in one pass over a text, whatever the number of names.

The names and aliases make one automaton of Aho and Corasick, built once in a worker. A text is read once; where an
alias ends, the automaton gives it and every alias inside it that ends there as well, and word borders are checked
by the characters beside it. The work is the text's length and the number of hits.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator, Sequence
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

Entries = tuple[tuple[str, tuple[int, ...]], ...]


@lru_cache(maxsize=4096)
def word_character(c: str) -> bool:
    """Letters, marks, decimal digits, letter numbers, connectors and joiners."""
    kind = unicodedata.category(c)
    return kind[0] in "LM" or kind in ("Nd", "Nl", "Pc") or c in "‌‍"


def entries_of(lexicon: dict[str, Sequence[str]]) -> Entries:
    """Each lower-cased alias, and the places in the table of the names that it stands for."""
    out: dict[str, list[int]] = {}
    for no, (name, aliases) in enumerate(lexicon.items()):
        for alias in (name, *aliases):
            own = out.setdefault(alias.lower(), [])
            if no not in own:
                own.append(no)
    return tuple((a, tuple(n)) for a, n in out.items() if a)


@lru_cache(maxsize=8)
def automaton(entries: Entries):
    import ahocorasick

    found = ahocorasick.Automaton()
    for alias, names in entries:
        found.add_word(alias, (len(alias), names))
    found.make_automaton()
    return found


def places(text: str, entries: Entries, borders: bool) -> list[int]:
    """The places of the names that a lower-cased text holds, with word borders on both sides if asked for."""
    hits: set[int] = set()
    last = len(text) - 1
    for end, (size, names) in automaton(entries).iter(text):
        if borders:
            start = end - size + 1
            before = start > 0 and word_character(text[start - 1])
            after = end < last and word_character(text[end + 1])
            if before == word_character(text[start]) or after == word_character(text[end]):
                continue
        hits.update(names)
    return sorted(hits)


def held_names(text: Column, lexicon: dict[str, Sequence[str]], borders: bool) -> Column:
    """An array of the names of which the text holds the name or an alias, in any case, in the table's order.

    A null text holds none, and so does an empty alias. An alias of several names stands for all of them, and one
    inside a longer one counts beside it. A border is a place between a word character and another one or an end.
    """
    entries, names = entries_of(lexicon), list(lexicon)
    if not entries:
        return F.array().cast("array<string>")

    @F.arrow_udf("array<string>")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            yield pa.array([[names[k] for k in places(t, entries, borders)] for t in texts.to_pylist()], pa.list_(pa.string()))

    return run.asNondeterministic()(F.lower(F.coalesce(text, F.lit(""))))
