import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
LONG = " ".join(f"w{i % 977} of" for i in range(60_000))


def rows():
    """Nulls in every column, empty and very long texts, ties, repeated rows, odd signs."""
    base = "the quick brown fox jumps over the lazy dog and runs far away from the old house"
    return [
        (1, base, "en", "a", 80), (2, base, "en", "a", 80), (2, base, "en", "a", 80), (3, base.replace(" ", " \t\n "), "en", "b", None), (4, base + " today", "en", "b", 86),
        (5, None, None, None, None), (6, "", "en", None, 0), (7, " \n\t ", "fr", "c", 4), (8, LONG, "en", "c", len(LONG)), (None, "a text without an identifier", "en", "a", 28), (None, None, None, None, None),
        (9, "12 34 !!", "de", "b", 8), (10, "Ünï©ode \U0001f600 ẞ text here", "de", "b", 20), (11, " " * 300 + "late start", "en", "a", 310), (12, "  late start", "en", "a", 12),
        (13, "one", "es", "d", 3), (14, "one", "es", "d", 3), (15, "x" * 5000, "en", "d", 5000), (16, "lone ퟿ $ back\\slash 'quote' \"double\" 100%", "en", "d", 40),
    ]


@pytest.fixture(scope="session")
def docs(spark):
    return spark.createDataFrame(rows(), DOCS).repartition(3).persist()


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], DOCS)


@pytest.fixture(scope="session")
def clashing(docs):
    """Columns named as those that operators make."""
    from pyspark.sql import functions as F

    names = "keep_id group_size kept text_sha256 lang_pred score bits_per_byte item_id containment n_words labels class_id copies n_links host path rule verdict size source_size target taken log_weight selected a`b id node count".split()
    return docs.select("*", *[F.lit("old").alias(n) for n in names])
