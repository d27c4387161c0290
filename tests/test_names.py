"""Names of a dictionary in texts: the automaton against regular expressions, and with a large dictionary."""

import random
import re
import time

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from skein.functions import rules
from skein.functions.automaton import entries_of, places
from skein.operators import extract

ALPHABET = "ab cd.-_+#é1"


def slow(text, lexicon, borders):
    low = text.lower()
    find = lambda a: re.search(rf"\b{re.escape(a)}\b", low) if borders else a in low
    return [k for k, (name, aliases) in enumerate(lexicon.items()) if any(a and find(a.lower()) for a in (name, *aliases))]


@settings(max_examples=500, deadline=None)
@given(
    st.text(ALPHABET, max_size=60),
    st.dictionaries(st.text(ALPHABET, min_size=1, max_size=4), st.lists(st.text(ALPHABET, max_size=5), max_size=3), max_size=6),
    st.booleans(),
)
def test_places_match_regular_expressions(text, lexicon, borders):
    assert places(text.lower(), entries_of(lexicon), borders) == slow(text, lexicon, borders) if entries_of(lexicon) else True


def test_nested_overlapping_and_shared_aliases(spark):
    lexicon = {"web": ("web server", "C++"), "server": ("server farm",), "farm": (), "web server farm": (), "both": ("farm", "Straße"), ".net": (), "empty": ("",)}
    texts = ["a Web Server farm", "webserver", "server-farm", "c++ or C++.", "x.net", ".net", "straße STRASSE", None, "", "web_server", "the farm"]
    df = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "id int, text string")
    got = {r.id: (r.w, r.a) for r in df.select("id", extract.whole_words(F.col("text"), lexicon).alias("w"), extract.anywhere(F.col("text"), lexicon).alias("a")).collect()}
    names = list(lexicon)
    for k, t in enumerate(texts):
        assert got[k] == tuple([names[n] for n in slow(t or "", lexicon, b)] for b in (True, False))
    assert df.select(extract.whole_words(F.col("text"), {}).alias("w")).first().w == []


def test_given_tables_on_documents(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").filter("doc_id < 60").select("doc_id", F.concat_ws(" ", "text", F.lit("Python and FastAPI with docker compose; retry on timeout")).alias("text"))
    for lexicon in (rules.TECHNOLOGIES, rules.PATTERNS):
        got = docs.select("text", extract.whole_words(F.col("text"), lexicon).alias("w"), extract.anywhere(F.col("text"), lexicon).alias("a")).collect()
        for r in got:
            assert [list(lexicon).index(n) for n in r.w] == slow(r.text, lexicon, True) and [list(lexicon).index(n) for n in r.a] == slow(r.text, lexicon, False)


def test_cost_does_not_grow_with_the_names():
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(rng.randrange(5, 12)))
    text = " ".join(word() for _ in range(200_000))
    seconds = {}
    for n in (1_000, 100_000):
        lexicon = {f"{word()} {k}": (word(), f"{word()} {word()}") for k in range(n)}
        entries = entries_of(lexicon)
        places("warm", entries, True)
        started = time.perf_counter()
        found = places(text, entries, True)
        seconds[n] = time.perf_counter() - started
        some = random.Random(1).sample(range(n), 50)
        words = set(text.split())
        names = list(lexicon)
        assert all((k in set(found)) == (lexicon[names[k]][0] in words or lexicon[names[k]][1] in text and bool(re.search(rf"\b{lexicon[names[k]][1]}\b", text))) for k in some)
    assert seconds[100_000] < 20 * seconds[1_000] + 1


@pytest.mark.parametrize("c,word", [("a", True), ("_", True), ("9", True), ("é", True), ("́", True), (" ", False), ("-", False), ("½", False), ("日", True)])
def test_word_characters(c, word):
    from skein.functions.automaton import word_character

    assert word_character(c) is word
