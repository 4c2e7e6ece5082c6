import pytest

from tokenloom.errors import InvalidQuery, SearchTimeout
from tokenloom.operators.search import Searcher, SearchQuery, decode_cursor, encode_cursor, fingerprint
from tokenloom.sources import annotated

from .test_store import document, graph_field, token_field

WORDS = ["blue birds sing", "birds near water", "water falls", "birds", "small birds fear blue birds"]


@pytest.fixture(scope="module")
def df(spark):
    docs = [document(i, (len(w.split()), token_field("word", w.split()), graph_field([[0, k, "x"] for k in range(1, len(w.split()))], [0]))) for i, w in enumerate(WORDS * 5)]
    return annotated.sentences_of_json(spark, *docs).persist()


@pytest.mark.parametrize("limit", [1, 3, 7, 20, 100])
def test_pages_have_every_hit_once(df, limit):
    s, cursor, seen = Searcher(lambda: df), None, []
    while True:
        r = s.search(SearchQuery("[word=birds]", limit, cursor, count=not seen))
        seen += [h.sentence_id for h in r.hits]
        assert len(r.hits) <= limit and r.exhausted == (len(r.hits) < limit) == (r.next_cursor is None)
        if len(seen) == len(r.hits):
            assert r.total_is_exact and r.total_hits == 20
        else:
            assert not r.total_is_exact
        if r.exhausted:
            break
        cursor = r.next_cursor
    assert seen == [f"d{i}_0" for i, w in enumerate(WORDS * 5) if "birds" in w.split()]


def test_hits_are_rendered(df):
    r = Searcher(lambda: df).search(SearchQuery("(?<a> [word=blue]) [word=birds]", 1))
    m = r.hits[0].matches[0].spans[0]
    assert (r.kind, m.start, m.end, m.text, m.captures[0]["text"]) == ("surface", 0, 2, "blue birds", "blue")
    g = Searcher(lambda: df).search("(?<v> [word=birds]) >x (?<w> [word=water])").hits[0]
    assert [s.text for s in g.matches[0].spans] == ["birds", "water"] and [c["name"] for c in g.matches[0].named] == ["v", "w"] and g.words == ("birds", "near", "water")
    assert Searcher(lambda: df).search("blue birds").to_dict()["timing"]["backend_us"] > 0
    assert Searcher(lambda: df.limit(0)).search("birds").exhausted


@pytest.mark.parametrize("request_", [SearchQuery("birds", 0), SearchQuery(""), SearchQuery("[a"), SearchQuery("x " * 9000), SearchQuery("birds", cursor="zz"), SearchQuery("birds", cursor="abc"), SearchQuery("birds", cursor=b"{}".hex()), SearchQuery("birds", cursor=encode_cursor("water", (1, 2))), SearchQuery("a (b >x c)")])
def test_bad_requests(df, request_):
    with pytest.raises(InvalidQuery):
        Searcher(lambda: df).search(request_)


def test_limits_and_time(df):
    assert len(Searcher(lambda: df, max_limit=2).search(SearchQuery("birds", 50)).hits) == 2
    from pyspark.sql import functions as F

    @F.udf("boolean")
    def slow(_):
        import time

        time.sleep(20)
        return True

    with pytest.raises(SearchTimeout):
        Searcher(lambda: df.where(slow("sent_ord")), timeout_s=1.5).search("birds")
    assert Searcher(lambda: df).search("birds").hits


def test_cursor():
    assert decode_cursor("q", encode_cursor("q", (3, 4))) == (3, 4) and fingerprint("") == 0xCBF29CE484222325 and fingerprint("a") == 0xAF63DC4C8601EC8C
