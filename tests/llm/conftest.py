import random

import pytest

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long, text_key string, node int, block string, row string, begin int, part string, first string, seq1 string"


def table(spark, rows):
    """Documents (doc_id, text, lang) with further columns whose names the operators use themselves."""
    full = [(i, t, g, "s", None if t is None else len(t), "k", 1, "b", "r", 2, "p", "f", "q") for i, t, g in rows]
    return spark.createDataFrame(full, COLUMNS)


def words(seed, n, vocabulary=300):
    r = random.Random(seed)
    return " ".join(f"w{r.randrange(vocabulary)}" for _ in range(n))


@pytest.fixture(scope="session")
def edge_rows():
    """Null ids and texts, empty, short and very long texts, ties and repeated rows."""
    long = words(1, 20_000)
    return [
        (1, words(2, 200), "en"), (2, words(2, 200), "en"), (3, words(2, 200) + " tail of it", "fr"), (4, None, "en"), (5, "", None), (6, "   ", "de"), (7, "one", "en"), (7, "one", "en"), (None, "no id", "en"),
        (None, None, None), (8, long, "en"), (9, long[:50_000], "en"), (10, "été ▁ 日本 🎉 \x00 <|endoftext|> <s>", "fr"), (11, "ab " * 400, "en"), (12, "line\n" * 30, "es"), (2**62, words(3, 50), "en"), (-5, words(3, 50), "en"),
        (9, long[:50_000], "en"),
    ]


@pytest.fixture(scope="session")
def edge(spark, edge_rows):
    return table(spark, edge_rows).repartition(3)


@pytest.fixture(scope="session")
def empty(spark):
    return table(spark, [])
