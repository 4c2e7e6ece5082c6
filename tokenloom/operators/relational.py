"""Bounded patterns as joins and windows over tokens and edges.

Each shape of a pattern is an operator on two relations that a sentences table unfolds into: tokens (a row a token) and edges.
They shuffle by sentence, so they suit selective tests and results that go on into other joins; the row-wise operators of
match.py find the same without a shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.encodings import TOKEN_FIELDS
from ..lang import parse
from ..lang.ast import Constraint, Step, Token
from ..plans import native
from .match import graph_of

KEY = "sentence_id"


def tokens(df: DataFrame, *fields: str) -> DataFrame:
    """sentence_id, n, pos_in and the fields of each token; all fields if none is named."""
    names = [f for f in (fields or TOKEN_FIELDS) if f in df.columns]
    zipped = F.arrays_zip(*[F.coalesce(F.col(f), F.array().cast("array<string>")).alias(f) for f in names])
    out = df.select(KEY, F.col("sentence_length").alias("n"), F.posexplode(zipped).alias("at", "t"))
    return out.select(KEY, "n", "at", *[F.coalesce(F.col("t")[f], F.lit("")).alias(f) for f in names])


def edges(df: DataFrame) -> DataFrame:
    """sentence_id, src, dst, rel of the graph that is walked."""
    return df.select(KEY, F.explode(graph_of(df.columns)["edges"]).alias("e")).select(KEY, "e.*")


def _test(text: str | Constraint) -> Constraint:
    if not isinstance(text, str):
        return text
    p = parse(text)
    if not isinstance(p, Token):
        raise ValueError(f"{text} isn't a test of one token")
    return p.test


def holding(toks: DataFrame, test: str | Constraint) -> DataFrame:
    """Tokens that hold a test; a field that isn't there reads as empty."""
    return toks.where(native.holds(_test(test), lambda f: F.col(f) if f in toks.columns else F.lit("")))


def adjacent(toks: DataFrame, *tests: str) -> DataFrame:
    """sentence_id, start, end of tokens side by side that hold the tests in order."""
    out = holding(toks, tests[0]).select(KEY, F.col("at").alias("start"), (F.col("at") + 1).alias("end"))
    for t in tests[1:]:
        own = holding(toks, t).select(KEY, F.col("at").alias("end"))
        out = out.join(own, [KEY, "end"]).select(KEY, "start", (F.col("end") + 1).alias("end"))
    return out


def gap(toks: DataFrame, first: str, second: str, least: int, most: int, nearest: bool = False) -> DataFrame:
    """sentence_id, start, end: second comes least to most tokens after first. nearest: for each start only the smallest end (a lazy gap)."""
    a, b = holding(toks, first).select(KEY, F.col("at").alias("start")), holding(toks, second).select(KEY, (F.col("at") + 1).alias("end"))
    out = a.join(b, KEY).where((F.col("end") - F.col("start") - 2).between(least, most))
    return out.groupBy(KEY, "start").agg(F.min("end").alias("end")) if nearest else out


def runs(toks: DataFrame, test: str) -> DataFrame:
    """sentence_id, start, end of the longest runs of tokens that hold a test (a greedy +)."""
    w = Window.partitionBy(KEY).orderBy("at")
    own = holding(toks, test).select(KEY, "at").withColumn("__run", F.col("at") - F.row_number().over(w))
    return own.groupBy(KEY, "__run").agg(F.min("at").alias("start"), (F.max("at") + 1).alias("end")).drop("__run")


def beside(toks: DataFrame, test: str, neighbour: str, ahead: bool, positive: bool) -> DataFrame:
    """sentence_id, start, end of tokens that hold test, by whether the next (or the one before) holds neighbour."""
    w = Window.partitionBy(KEY).orderBy("at")
    flags = toks.withColumns({"__own": native.holds(_test(test), F.col), "__other": native.holds(_test(neighbour), F.col)})
    flags = flags.withColumn("__near", F.coalesce((F.lead if ahead else F.lag)("__other").over(w), F.lit(False)))
    return flags.where(F.col("__own") & (F.col("__near") if positive else ~F.col("__near"))).select(KEY, F.col("at").alias("start"), (F.col("at") + 1).alias("end"))


def step(arcs: DataFrame, path: str) -> DataFrame:
    """sentence_id, a, b: from token a over a walk without stars to token b. path is as in a pattern: `>nsubj`, `<</x/?`, `>a >b`."""
    walk = parse(f"[] {path} []").path
    ways = native.ways(walk)
    if ways is None:
        raise ValueError(f"{path} has no bound")
    out = None
    for way in ways:
        one = None
        for alternatives in way:
            own = _one(arcs, alternatives)
            one = own if one is None else one.withColumnRenamed("b", "m").join(own.withColumnRenamed("a", "m"), [KEY, "m"]).select(KEY, "a", "b")
        if one is None:  # the empty way: a token reaches itself
            ends = arcs.select(KEY, F.col("src").alias("a")).union(arcs.select(KEY, F.col("dst").alias("a"))).distinct()
            one = ends.select(KEY, "a", F.col("a").alias("b"))
        out = one if out is None else out.union(one)
    return out.distinct()


def _one(arcs: DataFrame, alternatives: tuple[Step, ...]) -> DataFrame:
    labelled: Column = F.lit(True) if any(s.label is None for s in alternatives) else native.label([s.label for s in alternatives], F.col("rel"))
    a, b = ("src", "dst") if alternatives[0].out else ("dst", "src")
    return arcs.where(labelled).select(KEY, F.col(a).alias("a"), F.col(b).alias("b")).distinct()


def hop(toks: DataFrame, arcs: DataFrame, src: str, path: str, dst: str) -> DataFrame:
    """sentence_id, a, b of tokens that hold src and dst with a walk between them."""
    a, b = holding(toks, src).select(KEY, F.col("at").alias("a")), holding(toks, dst).select(KEY, F.col("at").alias("b"))
    return step(arcs, path).join(a, [KEY, "a"], "left_semi").join(b, [KEY, "b"], "left_semi").select(KEY, "a", "b")


def chain(toks: DataFrame, arcs: DataFrame, *parts: str) -> DataFrame:
    """sentence_id, t0, t1, ... of test, path, test, path, test, ...; ends that can't go on are dropped by semi-joins first, from both sides."""
    tests, paths = parts[::2], parts[1::2]
    hops = [hop(toks, arcs, tests[i], p, tests[i + 1]) for i, p in enumerate(paths)]
    for i in range(1, len(hops)):
        hops[i] = hops[i].join(hops[i - 1].select(KEY, F.col("b").alias("a")).distinct(), [KEY, "a"], "left_semi").select(KEY, "a", "b")
    for i in range(len(hops) - 2, -1, -1):
        hops[i] = hops[i].join(hops[i + 1].select(KEY, F.col("a").alias("b")).distinct(), [KEY, "b"], "left_semi").select(KEY, "a", "b")
    out = hops[0].select(KEY, F.col("a").alias("t0"), F.col("b").alias("t1"))
    for i, h in enumerate(hops[1:], 2):
        out = out.join(h.select(KEY, F.col("a").alias(f"t{i - 1}"), F.col("b").alias(f"t{i}")), [KEY, f"t{i - 1}"])
    return out.select(KEY, *[f"t{i}" for i in range(len(tests))])


def span_hop(spans: DataFrame, arcs: DataFrame, path: str, toks: DataFrame, dst: str) -> DataFrame:
    """sentence_id, start, end, b: a walk leaves from any token of a span (a range join within the sentence) and arrives at a token that holds dst."""
    b = holding(toks, dst).select(KEY, F.col("at").alias("b"))
    walked = step(arcs, path).join(b, [KEY, "b"], "left_semi")
    return spans.join(walked, KEY).where((F.col("a") >= F.col("start")) & (F.col("a") < F.col("end"))).select(KEY, "start", "end", "b").distinct()


__all__ = ["adjacent", "beside", "chain", "edges", "gap", "holding", "hop", "runs", "span_hop", "step", "tokens"]
