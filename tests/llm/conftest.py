import pytest

EXTRA = "k string, t string, words string, text string, n string, doc_id bigint, lang string, source string, n_chars bigint, label string, key string"
PROSE = "the cat and the dog went to the house of a man that was in the garden with an old tree by the road"


@pytest.fixture(scope="session")
def edge_docs(spark):
    """Nulls, empty and very long texts, repeated rows and ids, clashing extra columns."""
    row = lambda i, text, lang="en", source="s": ("x", "y", "z", text, "n", i, lang, source, len(text or ""), "l", "q")
    long = " ".join(f"w{i % 977}" for i in range(60_000))
    texts = [None, "", " \t\n", "one", PROSE, PROSE, PROSE.replace("cat", "Cat"), long, "a" * 100_000, "😀 é " * 40, None]
    rows = [row(i, t, None if i % 3 == 0 else "en", None if i % 4 == 0 else "s") for i, t in enumerate(texts)]
    return spark.createDataFrame([*rows, row(4, PROSE), row(None, PROSE), row(None, None)], EXTRA)


@pytest.fixture(scope="session")
def no_docs(edge_docs):
    return edge_docs.limit(0)
