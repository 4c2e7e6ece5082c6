"""Edge lists by token: each edge is looked at once, and JSON is read once."""

import random
import time

from pyspark.sql import functions as F

from tokenloom.functions import encodings as enc
from tokenloom.queries import queries

SCHEMA = "n int, edges array<struct<src:int,dst:int,rel:string>>, roots array<int>"


def test_edges_by_token_are_what_filters_give(spark):
    draw, rows = random.Random(3), []
    for _ in range(120):
        n = draw.randint(0, 6)
        edges = None if draw.random() < 0.1 else [(draw.choice([None, *range(-1, n + 1)]), draw.randint(-1, n), draw.choice(["b", "a", "ä", "", None])) for _ in range(draw.randint(0, 9))]
        rows.append((n, edges, draw.choice([[], None, [0], [draw.randint(-1, n), 0]])))
    df = spark.createDataFrame(rows, SCHEMA).coalesce(1)
    n, e, r = F.col("n"), F.col("edges"), F.col("roots")
    out, into = enc.edge_slots(n, e, r)
    got = df.select("n", "edges", "roots", enc.outgoing(n, e).alias("o"), enc.incoming(n, e).alias("i"), enc.labels_out(n, e).alias("lo"), enc.labels_in(n, e).alias("li"), out.alias("so"), into.alias("si")).collect()
    tidy = lambda x: sorted(set(x), key=lambda v: (v is None, v or ""))
    for g in got:
        at = lambda k, i: [tuple(x) for x in g["edges"] if x[k] == i]
        for i in range(g["n"]):
            if g["edges"] is None:
                assert g["o"][i] is None and g["lo"][i] is None and g["so"][i] is None
                continue
            assert [tuple(x) for x in g["o"][i]] == at(0, i) and [tuple(x) for x in g["i"][i]] == at(1, i)
            assert g["lo"][i] == [x[2] for x in at(0, i)] and g["li"][i] == [x[2] for x in at(1, i)]
            assert g["so"][i] == tidy(g["lo"][i])
            assert g["si"][i] == tidy(g["li"][i] + (["root"] if i in (g["roots"] or []) else []))
        assert len(g["o"]) == len(g["si"]) == g["n"]


def test_a_long_sentence_takes_time_in_proportion(spark):
    n = 20_000
    df = spark.createDataFrame([(n, [(0, i, "x") for i in range(1, n)], [0])], SCHEMA)
    began = time.monotonic()
    out, into = enc.edge_slots(F.col("n"), F.col("edges"), F.col("roots"))
    got = df.select(F.size(F.flatten(enc.outgoing(F.col("n"), F.col("edges")))).alias("a"), F.size(F.flatten(out)).alias("b"), F.size(F.flatten(into)).alias("c")).first()
    assert tuple(got) == (n - 1, 1, n)
    assert time.monotonic() - began < 20  # four hundred million comparisons each before


def test_a_document_is_read_once(spark):
    plan = queries()["src_flatten_json"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("from_json(") == 1


def test_values_without_a_backslash_are_read_as_those_with_one(spark):
    values = ["", "a", "a|b", "|", "||", "a,b|c", "a\\|b|c", "\\", "a\\\\|b", "|a\\", "x|\\,y|", None, "[|]", "$1|^"]
    df = spark.createDataFrame([(v,) for v in values], "v string").coalesce(1)
    def parts(v):
        out, at = [""], 0
        while at < len(v):
            if v[at] == "\\" and at + 1 < len(v):
                out[-1] += v[at : at + 2]
                at += 2
                continue
            if v[at] == "|":
                out.append("")
            else:
                out[-1] += v[at]
            at += 1
        return out

    split = enc.split_escaped(F.col("v"), "|")
    got = [r[0] for r in df.select(split).collect()]
    assert got == [None if v is None else parts(v) for v in values]
    plan = df.select(split)._jdf.queryExecution().optimizedPlan().toString()
    assert "split(v" in plan  # the expression is left out where there is no backslash
    words = ["a", "a|b", "\\", "x,\\|y", "", "é"]
    df = spark.createDataFrame([(w,) for w in words], "w string").coalesce(1)
    want = ["".join("\\" + ch if ch in "\\|," else ch for ch in w) for w in words]
    assert [tuple(r) for r in df.select(enc.escape(F.col("w")), enc.unescape(enc.escape(F.col("w")))).collect()] == list(zip(want, words, strict=True))
