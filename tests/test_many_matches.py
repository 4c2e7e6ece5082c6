"""Sentences with very many matches, and matches worked out once."""

import time

import pytest
from pyspark.sql import functions as F

from tokenloom.lang import parse
from tokenloom.match.graph import Automaton, Matcher, bits, mask, plan
from tokenloom.match.surface import Program, Sentence
from tokenloom.operators import match


def table(spark, tags, edges):
    data = [("d", "d_0", len(tags), tags, tags, [{"src": a, "dst": b, "rel": r} for a, b, r in edges])]
    df = spark.createDataFrame(data, "doc_id string, sentence_id string, sentence_length int, word array<string>, tag array<string>, e array<struct<src:int,dst:int,rel:string>>")
    return df.withColumn("graph", F.struct(F.lit("g").alias("name"), F.col("e").alias("edges"), F.array(F.lit(0)).alias("roots"))).drop("e")


def test_many_tuples_of_a_walk_aren_t_compared_with_each_other(spark):
    """600 x 600 tuples of one sentence, some found twice."""
    n = 600
    tags = ["A"] * n + ["V"] + ["B"] * n
    edges = [(n, i, "x") for i in range(n)] + [(n, n + 1 + i, "y") for i in range(n)] + [(n, 0, "x")]
    df, began = table(spark, tags, edges), time.monotonic()
    got = match.each(df, "[tag=A] <x [tag=V] >y [tag=B]", ("sentence_id",)).agg(F.count(F.lit(1)), F.count_distinct(F.col("m.spans")[0]["start"]), F.max("match")).first()
    assert tuple(got) == (n * n, n, n * n - 1)
    assert time.monotonic() - began < 60  # array_distinct took hours


def test_long_chains_are_closed_in_one_pass():
    n = 1500
    m, s, edges = Matcher(plan(parse("[tag=A] >c+ [tag=B]"))), Sentence(n, lambda f: ["A"] * 10 + ["B"] * (n - 10)), [(i, i + 1, "c") for i in range(n - 1)]
    began = time.monotonic()
    assert sum(1 for _ in m.each(s, edges)) == 10 * (n - 10)
    assert Automaton(m.plan.walks[0]).from_each(n, edges, range(n))[0] == mask(range(1, n))
    assert time.monotonic() - began < 5
    assert bits(mask([0, 3, 70, 71, 72, 73, 74, 75, 900])) == [0, 3, 70, 71, 72, 73, 74, 75, 900] and bits(0) == [] and mask([]) == 0


@pytest.mark.parametrize("most", [1, 1 << 40])
def test_closures_agree_with_each_start_by_itself(monkeypatch, most):
    import random

    from tokenloom.match import graph

    monkeypatch.setattr(graph, "MOST_BYTES", most)  # both ways
    draw = random.Random(5)
    for _ in range(200):
        n = draw.randint(1, 9)
        edges = [(draw.randrange(n), draw.randrange(n), draw.choice("xy")) for _ in range(draw.randint(0, 14))]
        a = Automaton(parse(f"[] {draw.choice(['>x*', '>>+', '>x >y*', '<x+ >y?', '>x|y'])} []").path)
        assert a.from_each(n, edges, range(n)) == {i: a.reached(n, edges, 1 << i) for i in range(n)}


def test_captures_of_a_long_run_take_memory_in_proportion():
    import tracemalloc

    n = 3000
    s = Sentence(n + 1, lambda f: ["N"] * n + ["V"])
    tracemalloc.start()
    try:
        (found,) = Program(parse("(?<x> [tag=N])+ [tag=V]")).spans(s, cap=None)
        assert found.captures[0] == ("x", 0, 1) and found.captures[-1] == ("x", n - 1, n) and len(found.captures) == n
        assert tracemalloc.get_traced_memory()[1] < 60e6  # the captures of every start were 500 MB and more
    finally:
        tracemalloc.stop()


def test_matches_are_worked_out_once(spark):
    """No filter on the matches: Spark would work them out again for each of its conditions."""
    df = table(spark, ["A", "B"], [(0, 1, "c")])
    for query in ("[tag=A] [tag=B]", "[tag=A]+ [tag=B]", "[tag=A] >c [tag=B]", "[tag=A] >c+ [tag=B]", "(?<x> [tag=A])+ [tag=B]"):
        plan_ = match.each(df, query, ("sentence_id",))._jdf.queryExecution().optimizedPlan().toString()
        assert "size(" not in plan_ and plan_.count("MapInArrow") + plan_.count("posexplode(") == 1, query


def test_matches_in_small_batches_are_the_same(spark, monkeypatch):
    tags = ["A", "A", "B", "A", "B", "C"]
    edges = [(0, 2, "c"), (2, 4, "c"), (0, 4, "c"), (4, 0, "d")]
    df = table(spark, tags, edges).union(table(spark, ["C"], [])).union(table(spark, [], []))
    monkeypatch.setattr(match, "MOST_RENDERED", 0)
    for query in ("(?<x> [tag=A])+ [tag=B]", "(?<p> (?<a> [tag=A]) >>+ (?<b> [tag=B]))", "[tag=A]+ [tag=B] >c* [tag=B]+", "[tag=A] []*? [tag=C]"):
        want = [tuple(r) for r in match.matches(df, query).select("sentence_id", F.posexplode("matches")).collect()]
        assert [tuple(r) for r in match.each(df, query, ("sentence_id",)).collect()] == want and want, query
        assert [tuple(r) for r in match.each(df, query, ("sentence_id",), native_only=False).collect()] == want
