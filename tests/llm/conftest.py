import pytest

#: Names that the operators use inside; as further columns of the input they must not matter.
CLASHING = ("doc", "id", "bucket", "norm", "key", "n", "kept", "digest", "node", "component_id", "size", "shard", "spans", "items", "group", "salt", "score", "word", "c", "t", "found", "base", "row_id")


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls, empty and blank texts, repeated rows, a long text, and further columns with clashing names."""
    long_text = " ".join(f"word{i % 977} and" for i in range(20_000))
    rows = [
        (1, None, "en"), (2, "", "en"), (3, " \t\n", None), (4, "Hello wörld, hello again.", "en"), (4, "Hello wörld, hello again.", "en"),
        (5, "Helloword", "de"), (6, long_text, "en"), (7, "hello wörld,  hello again.", "en"), (8, "Hello wörld, hello again. ", "en"),
        (None, "no id here at all", "fr"), (9, "a b\x1cc", "en"), (10, "日本語 テスト 👍🏽", None), (11, long_text, "en"), (12, "!!! ??? ...", "en"),
    ]
    rows = [r + tuple(f"x{i}" for i in range(len(CLASHING))) for r in rows]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, " + ", ".join(f"{c} string" for c in CLASHING)).repartition(3).cache()


@pytest.fixture(scope="session")
def no_docs(odd_docs):
    return odd_docs.limit(0)


@pytest.fixture(scope="session")
def few_labels(spark):
    return spark.createDataFrame([(i, i % 2, (i // 2) % 2) for i in range(14)] + [(3, None, 1), (None, 1, 0)], "doc_id long, quality int, toxic int")


@pytest.fixture(scope="session")
def documents(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


@pytest.fixture(scope="session")
def texts(documents):
    return {r.doc_id: r.text or "" for r in documents.select("doc_id", "text").collect()}
