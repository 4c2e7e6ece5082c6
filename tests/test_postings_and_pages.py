"""Postings without a shuffle, in files that follow the table's size; all pages of a search in one pass."""

import pytest
from pyspark.sql import functions as F

from tokenloom.operators import postings, search
from tokenloom.plans import candidate as c
from tokenloom.queries import PAGED
from tokenloom.sources.fixtures import sentences
from tokenloom.sources.store import Store

DIR = "/root/testdata/sf0.001"


def test_postings_are_gathered_in_each_row(spark):
    rows = [(1, 5, ["a", "b", "", "a", None], [["x", "y", "x"], [], ["x"], None, ["y", "", "y"]]), (1, 6, [], []), (2, 0, None, None), (2, 1, ["b"], [["x"]])]
    df = spark.createDataFrame(rows, "split_id long, sent_ord long, word array<string>, outgoing_edges array<array<string>>").coalesce(1)
    out = postings.build(df, ("word", c.OUT, "lemma"))
    want = [("outgoing_edges", "x", 1, 5, [0, 2]), ("outgoing_edges", "x", 2, 1, [0]), ("outgoing_edges", "y", 1, 5, [0, 4]), ("word", "a", 1, 5, [0, 3]), ("word", "b", 1, 5, [1]), ("word", "b", 2, 1, [0])]
    assert sorted(map(tuple, out.collect())) == want
    assert "Exchange" not in out._jdf.queryExecution().executedPlan().toString()


def test_an_index_has_files_by_the_number_of_sentences(spark, tmp_path):
    df, store = sentences(spark, DIR).where("split_id < 120").repartition(6, "doc_id"), Store(spark, f"{tmp_path}/t", ("word", "tag"))
    store.add_sentences(df.withColumn("sent_ord", F.col("split_id") * (1 << 24) + F.col("sent_ord")), batch="a")
    assert len(store.postings().inputFiles()) > 2
    by_file = store.postings().groupBy(F.input_file_name()).agg(F.count(F.lit(1)).alias("n"), F.count_distinct("field").alias("f"), F.collect_list("term").alias("terms")).collect()
    assert max(r["n"] for r in by_file) < sum(r["n"] for r in by_file) and all(r["f"] == 1 and r["terms"] == sorted(r["terms"]) for r in by_file)


def test_quarters_are_those_of_the_formula():
    for low, high in ((0, 0), (0, 1), (3, 9), (0, 51281), (5, 1004), (-7, 11)):
        at = [low - (high - low + 1) * k // -4 for k in range(5)]
        assert all(at[(x - low) * 4 // (high - low + 1)] <= x < at[(x - low) * 4 // (high - low + 1) + 1] for x in range(low, high + 1))


@pytest.mark.parametrize("limit", [7, 50])
def test_all_pages_are_those_that_the_cursors_give(spark, tmp_path, limit):
    df = sentences(spark, DIR).where("split_id < 40")
    want, cursor, searcher = [], None, search.Searcher(lambda: df, timeout_s=600)
    while not want or cursor:
        r = searcher.search(search.SearchQuery(PAGED, limit=limit, cursor=cursor))
        want.append([h.sentence_id for h in r.hits])
        cursor = r.next_cursor
    found, total = search.pages(df, PAGED, limit, f"{tmp_path}/pages")
    got = [[] for _ in want]
    for r in found.join(df, ["split_id", "sent_ord"]).orderBy("page", "place").collect():
        got[r["page"] - 1].append(r["sentence_id"])
    assert got == want and total == sum(map(len, want)) and len(want) > 2


def test_pages_of_nothing(spark, tmp_path):
    found, total = search.pages(sentences(spark, DIR), "[word=nosuchword]", 5, f"{tmp_path}/pages")
    assert total == 0 and found.count() == 0
