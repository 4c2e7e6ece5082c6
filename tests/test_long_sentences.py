import pytest
from pyspark.sql import functions as F

from tokenloom.operators import match
from tokenloom.sources.fixtures import annotate

N = 1500


@pytest.fixture(scope="module")
def long(spark):
    """A sentence of 1,500 words and 1,499 commas, with a verb at its start."""
    docs = spark.createDataFrame([(1, "was " + " , ".join(f"w{i}" for i in range(N)) + ". Short one.\n"), (2, None)], "doc_id long, text string")
    return annotate(docs).persist()


def test_sentences_of_every_length(long):
    assert [r.sentence_length for r in long.orderBy("sent_ord").collect()] == [2 * N, 2]


@pytest.mark.parametrize("native_only", [True, False])
@pytest.mark.parametrize("query", ["[tag=NN]", "[tag=NN]+", "[tag=PUNCT] [tag=NN]?", "[tag=VBD] >dobj [tag=NN]", "[tag=VBD] >dobj [tag=NN] [tag=PUNCT]?"])
def test_all_matches_of_a_long_sentence(long, query, native_only):
    rows = long.where("sentence_length > 40")
    got = match.matches(rows, query, native_only).select(F.size("matches")).first()[0]
    assert got == (N - 1 if query.startswith("[tag=PUNCT]") else N)
    capped = match.matches(rows, query, native_only, capped=True).select(F.size("matches")).first()[0]
    assert capped == (256 if ">" in query else 1024)
