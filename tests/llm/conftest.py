"""Small documents with every awkward case, and columns whose names clash with results."""
import pytest

LONG = " ".join(f"w{i % 977}x{i % 31}" for i in range(30_000))
BASE = " ".join(f"alpha{i} beta{i}" for i in range(60))
NEAR = BASE.replace("alpha30", "omega30")


@pytest.fixture(scope="session")
def edge_rows():
    texts = [
        (1, BASE), (2, BASE), (3, NEAR), (3, NEAR), (4, None), (5, ""), (6, " \t\n "), (7, "one"), (8, "one"),
        (9, "a b c d"), (10, LONG), (11, "x" * 100_000), (12, "1" * 60_000), (None, BASE), (None, None),
        (13, "Écoute é ü 中文 한국어 😀 <|endoftext|> done."), (14, "+1 (212) 555-0147 ana@mail.example.org 10.0.0.1"),
        (15, "same line here\n" * 40), (16, "!!! ### *** | | |"), (17, "The and of to is in it that for with " * 9),
    ]
    return [(i, t, None if i == 5 else "en" if (i or 0) % 2 else "de", "src0", None if t is None else len(t),
             7, True, "digest", "shard", "row", 0.5) for i, t in texts]


SCHEMA = ("doc_id long, text string, lang string, source string, n_chars long, "
          "n_words int, kept boolean, digest string, shard string, _g string, score double")


@pytest.fixture(scope="session")
def edge_docs(spark, edge_rows):
    return spark.createDataFrame(edge_rows, SCHEMA).repartition(3).cache()


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], SCHEMA)
