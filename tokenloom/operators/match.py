"""Patterns over a table of sentences: which rows match, where, and how often.

Every plan starts with the pattern's candidates as a plain filter. Rows that pass are decided by plain columns where the
pattern allows it (one token, a fixed sequence, a class string, a bounded walk) and by the Arrow matcher otherwise; only the
columns that the pattern tests reach it. Nothing is shuffled: a sentence is a row.
"""

from __future__ import annotations

from array import array
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from itertools import islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions.arrow import bounded_batches
from ..lang.ast import capture_mode
from ..match.graph import RENDERED_TUPLES
from ..match.surface import MAX_SPANS, Sentence
from ..plans import candidate as c, native
from ..plans.compiler import Compiled, compile_query

SPAN = "struct<start:int,end:int,captures:array<struct<name:string,start:int,end:int>>>"
#: spans: one of a sequence, one for each endpoint of a traversal. named: captures of whole endpoints and of the whole traversal.
MATCHES = f"array<struct<spans:array<{SPAN}>,named:array<struct<name:string,start:int,end:int>>>>"


@dataclass(frozen=True)
class Lowered:
    level: str  # one of decided, fixed, classes, walk, matcher
    candidate: Column
    hit: Column


def graph_of(columns: list[str]) -> Column | None:
    """The sentence's graph, the plain one where the enhanced one isn't there."""
    own = [F.col(g) for g in ("graph", "graph_basic") if g in columns]
    return F.coalesce(*own) if own else None


def lower(query: str | Compiled, columns: list[str], native_only: bool = True) -> Lowered:
    """Conditions on a row of a sentences table with these columns. native_only=False: always by the matcher, for comparison."""
    q = compile_query(query) if isinstance(query, str) else query
    row = native.Row(columns)
    want = row.candidate(q.candidate)
    if native_only and q.kind == "surface":
        if q.decided:
            return Lowered("decided", want, F.lit(True))
        if (shape := native.fixed(q.pattern)) is not None:
            return Lowered("fixed", want, row.fixed_hit(shape))
        if (classes := native.class_string(q.pattern)) is not None:
            return Lowered("classes", want, row.class_hit(classes))
    graph = graph_of(columns)
    if q.kind == "graph":
        if graph is None:
            return Lowered("decided", F.lit(False), F.lit(False))
        want = want & graph.isNotNull()
        if native_only and (ways := native.walk_ways(q.graph)) is not None:
            return Lowered("walk", want, row.walk_hit(ways, q.graph, graph["edges"]))
    return Lowered("matcher", want, _matcher(q, columns, rendered=False))


def hits(df: DataFrame, query: str, native_only: bool = True) -> DataFrame:
    """Rows of df that match."""
    low = lower(query, df.columns, native_only)
    return df.where(low.candidate).where(low.hit)


def count(df: DataFrame, query: str) -> int:
    """How many rows match, exactly."""
    return hits(df, query).count()


def matches(df: DataFrame, query: str, native_only: bool = True, capped: bool = False) -> DataFrame:
    """Rows of df that match, with all their matches in order in the column of that name. capped: at most 1024 of a sequence, 256 of a traversal."""
    q = compile_query(query)
    low = lower(q, df.columns, native_only)
    df = df.where(low.candidate)
    made = _native_matches(q, df.columns, capped) if native_only else None
    if made is None:
        df = df if low.level == "matcher" else df.where(low.hit)
        made = _matcher(q, df.columns, rendered=True, capped=capped)
    else:
        df = df.where(low.hit)
    return df.withColumn("matches", made).where(F.size("matches") > 0)


def _native_matches(q: Compiled, columns: list[str], capped: bool) -> Column | None:
    """The matches as a plain column, for fixed sequences, runs of one test and bounded walks between tokens."""
    row, most_spans, most_tuples = native.Row(columns), *_caps(capped)
    captures = "array<struct<name:string,start:int,end:int>>"
    if q.kind == "surface":
        if (shape := native.fixed(q.pattern)) is not None:
            found = row.fixed_spans(shape, most_spans)
        elif (run := native.run(q.pattern)) is not None:
            found = row.run_spans(run, most_spans)
        else:
            return None
        return F.transform(found, lambda s: F.struct(F.array(s).alias("spans"), F.array().cast(captures).alias("named")))
    ways, graph = native.walk_ways(q.graph), graph_of(columns)
    if ways is None or graph is None:
        return None
    n = len(q.graph.endpoints)

    def render(t: Column) -> Column:
        at = [t[f"t{k}"] for k in range(n)]
        spans = [F.struct(u.alias("start"), (u + 1).alias("end"), F.array().cast(captures).alias("captures")) for u in at]
        named = [F.struct(F.lit(name).alias("name"), u.alias("start"), (u + 1).alias("end")) for e, u in zip(q.graph.endpoints, at, strict=True) for name in e.names]
        named += [F.struct(F.lit(name).alias("name"), F.least(*at).alias("start"), (F.greatest(*at) + 1).alias("end")) for name in q.graph.names]
        return F.struct(F.array(*spans).alias("spans"), (F.array(*named) if named else F.array().cast(captures)).alias("named"))

    return F.transform(row.walk_tuples(ways, q.graph, graph["edges"], most_tuples), render)


def _caps(capped: bool) -> tuple[int | None, int | None]:
    return (MAX_SPANS, RENDERED_TUPLES) if capped else (None, None)


def each(df: DataFrame, query: str, keys: tuple[str, ...], native_only: bool = True) -> DataFrame:
    """A row for each match of each row of df: keys, match (number in the row), m (as in matches()).

    Matches of a row are worked out once; Spark would work out a column of them again for each condition on it. The matcher gives them in
    batches of bounded size, so a sentence with very many of them needs no more memory.
    """
    q = compile_query(query)
    low = lower(q, df.columns, native_only)
    df = df.where(low.candidate)
    made = _native_matches(q, df.columns, False) if native_only else None
    if made is not None:
        return df.select(*keys, F.posexplode(made).alias("match", "m"))
    if low.level != "matcher":
        df = df.where(low.hit)
    names, graph = [f for f in q.fields if f in df.columns], graph_of(df.columns)
    walked = q.kind == "graph"
    if walked and graph is None:
        return df.where("false").select(*keys, F.lit(0).alias("match"), F.lit(None).cast(MATCHES)[0].alias("m"))
    bounded_batches(df.sparkSession)
    rows = df.select(*[F.col(k).alias(f"__{i}") for i, k in enumerate(keys)], F.col("sentence_length").alias("n"), *([graph["edges"].alias("edges")] if walked else []), *[F.col(f).alias(f"f{i}") for i, f in enumerate(names)])
    types = {f.name: f.dataType.simpleString() for f in rows.schema}
    own_keys = [f"__{i}" for i in range(len(keys))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = compile_query(query)
        for b in batches:
            for at in range(0, b.num_rows, SLICE):
                part = b.slice(at, SLICE)
                out = _Rendered()
                for row, (s, arcs) in enumerate(_read(part.column("n"), part.column("edges") if walked else None, {f: part.column(f"f{i}") for i, f in enumerate(names)})):
                    found = own.matcher.each(s, arcs) if walked else ((x,) for x in own.program.spans(s, cap=None))
                    for k, t in enumerate(found):
                        out.add(t, _named(own, t) if walked else ())
                        out.rows.append(row)
                        out.numbers.append(k)
                        if out.size > MOST_RENDERED:
                            yield out.batch(part, own_keys)
                            out = _Rendered()
                if out.size:
                    yield out.batch(part, own_keys)

    found = rows.mapInArrow(run, ", ".join([*(f"{k} {types[k]}" for k in own_keys), "match int", f"m {MATCHES[6:-1]}"]))
    return found.select(*[F.col(k).alias(name) for k, name in zip(own_keys, keys, strict=True)], "match", "m")


def _matcher(q: Compiled, columns: list[str], rendered: bool, capped: bool = False) -> Column:
    """The matcher over Arrow batches; its arguments are the length, the graph's edges if walked, and the fields tested."""
    names = [f for f in q.fields if f in columns]
    walked = q.kind == "graph"
    text, kind = q.query, q.kind
    most_spans, most_tuples = _caps(capped)

    def run(n: pa.Array, *more: pa.Array) -> pa.Array:
        own = compile_query(text)
        out, counts = _Rendered() if rendered else [], []
        for s, arcs in _read(n, more[0] if walked else None, dict(zip(names, more[walked:], strict=True))):
            if not rendered:
                out.append(own.program.hit(s) if kind == "surface" else own.matcher.hit(s, arcs))
                continue
            before = len(out.spans)
            for t in islice(own.matcher.each(s, arcs), most_tuples) if walked else ((x,) for x in own.program.spans(s, cap=most_spans)):
                out.add(t, _named(own, t) if walked else ())
            counts.append(len(out.spans) - before)
        return pa.ListArray.from_arrays(_offsets(counts), out.array()) if rendered else pa.array(out, pa.bool_())

    udf = F.arrow_udf(run, returnType=MATCHES if rendered else "boolean")
    graph = graph_of(columns)
    return udf(F.col("sentence_length"), *([graph["edges"]] if walked else []), *[F.col(f) for f in names])


#: Rows that are turned into Python objects at once; spans and captures of a batch of matches.
SLICE, MOST_RENDERED = 256, 50_000


def _read(n: pa.Array, edges: pa.Array | None, fields: dict[str, pa.Array]) -> Iterator[tuple[Sentence, list | None]]:
    """Sentences of a batch with their edges."""
    for at in range(0, len(n), SLICE):
        values = {f: c.slice(at, SLICE).to_pylist() for f, c in fields.items()}
        arcs = _arcs(edges.slice(at, SLICE)) if edges is not None else None
        for i, size in enumerate(n.slice(at, SLICE).to_pylist()):
            yield Sentence(size or 0, lambda f, i=i, values=values: values[f][i] if f in values else None), None if arcs is None else arcs[i]


def _arcs(edges: pa.Array) -> list[list[tuple[int, int, str]] | None]:
    src, dst, rel = (x.to_pylist() for x in edges.flatten().flatten())
    out, at = [], 0
    for k in pc.list_value_length(edges).to_pylist():
        out.append(None if k is None else list(zip(src[at : at + k], dst[at : at + k], rel[at : at + k], strict=True)))
        at += k or 0
    return out


def _offsets(counts: Iterable[int]) -> pa.Array:
    return pa.array(np.concatenate(([0], np.cumsum(np.fromiter(counts, np.int64)))).astype(np.int32))


class _Captures:
    def __init__(self):
        self.counts, self.names, self.start, self.end = array("i"), [], array("i"), array("i")

    def add(self, found: Iterable[tuple[str, int, int]]) -> int:
        before = len(self.names)
        for name, a, b in found:
            self.names.append(name)
            self.start.append(a)
            self.end.append(b)
        self.counts.append(len(self.names) - before)
        return self.counts[-1]

    def array(self) -> pa.ListArray:
        return pa.ListArray.from_arrays(_offsets(self.counts), pa.StructArray.from_arrays([pa.array(self.names, pa.string()), _ints(self.start), _ints(self.end)], fields=list(_CAPTURE)))


def _ints(values: array) -> pa.Array:
    return pa.array(np.frombuffer(values, np.int32) if len(values) else np.zeros(0, np.int32))


class _Rendered:
    """Matches as flat arrays: a few bytes for each span instead of Python objects."""

    def __init__(self):
        self.rows, self.numbers, self.spans, self.start, self.end = array("i"), array("i"), array("i"), array("i"), array("i")
        self.captures, self.named, self.size = _Captures(), _Captures(), 0

    def add(self, spans: tuple, named: Iterable[tuple[str, int, int]]) -> None:
        self.spans.append(len(spans))
        for x in spans:
            self.start.append(x.start)
            self.end.append(x.end)
            self.size += 1 + self.captures.add(x.captures)
        self.size += self.named.add(named)

    def array(self) -> pa.StructArray:
        spans = pa.StructArray.from_arrays([_ints(self.start), _ints(self.end), self.captures.array()], fields=list(_ARROW.value_type[0].type.value_type))
        return pa.StructArray.from_arrays([pa.ListArray.from_arrays(_offsets(self.spans), spans), self.named.array()], fields=list(_ARROW.value_type))

    def batch(self, of: pa.RecordBatch, keys: list[str]) -> pa.RecordBatch:
        rows = _ints(self.rows)
        return pa.RecordBatch.from_arrays([*(of.column(k).take(rows) for k in keys), _ints(self.numbers), self.array()], names=[*keys, "match", "m"])


_CAPTURE = pa.struct([("name", pa.string()), ("start", pa.int32()), ("end", pa.int32())])
_ARROW = pa.list_(pa.struct([("spans", pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("captures", pa.list_(_CAPTURE))]))), ("named", pa.list_(_CAPTURE))]))


def _span(x) -> dict:
    return {"start": x.start, "end": x.end, "captures": [{"name": n, "start": a, "end": b} for n, a, b in x.captures]}


def _named(q: Compiled, spans: tuple) -> list[tuple[str, int, int]]:
    out = [(name, s.start, s.end) for end, s in zip(q.graph.endpoints, spans, strict=True) for name in end.names]
    return out + [(name, min(s.start for s in spans), max(s.end for s in spans)) for name in q.graph.names]


def span_text(word: Column, start: Column, end: Column) -> Column:
    """The words of a span, parted by a space; empty where the span is out of range."""
    n = F.size(word)
    return F.when((start < n) & (end > start), F.array_join(F.slice(F.transform(word, lambda w: F.coalesce(w, F.lit(""))), start + 1, F.least(end, n) - start), " ")).otherwise("")


def spans(df: DataFrame, query: str, keys: tuple[str, ...] = ("doc_id", "sentence_id"), native_only: bool = True) -> DataFrame:
    """A row for each span: keys, match (number in the row), endpoint, start, end, text, captures."""
    out = each(df, query, (*keys, "word"), native_only).select(*keys, "word", "match", F.posexplode("m.spans").alias("endpoint", "s"))
    return out.select(*keys, "match", "endpoint", F.col("s.start").alias("start"), F.col("s.end").alias("end"), span_text(F.col("word"), F.col("s.start"), F.col("s.end")).alias("text"), F.col("s.captures").alias("captures"))


def captures(df: DataFrame, query: str, keys: tuple[str, ...] = ("doc_id", "sentence_id")) -> DataFrame:
    """A row for each capture: keys, match, name (without mode), start, end, text; captures of whole endpoints too."""
    found = each(df, query, (*keys, "word"))
    every = F.concat(F.flatten(F.transform("m.spans", lambda s: s["captures"])), F.col("m.named"))
    out = found.select(*keys, "word", "match", F.inline(every))
    plain = F.regexp_replace("name", ":(token|phrase|pred)$", "")
    return out.select(*keys, "match", plain.alias("name"), "start", "end", span_text(F.col("word"), F.col("start"), F.col("end")).alias("text"))


def explain(query: str, columns: list[str]) -> str:
    """How a query would run: kind, level, candidates and the columns it reads."""
    q = compile_query(query)
    low = lower(q, columns)
    return f"{q.kind} by {low.level}; candidates {c.show(q.candidate)}; reads {', '.join(q.fields) or 'no token column'}"


def register(spark: SparkSession) -> None:
    """SQL functions token_hit(query, sentence_length, edges, names, columns) and token_spans(...): names are the fields of columns.

    For SQL text only: the DataFrame functions above also filter candidates natively, which a function call can't.
    """
    def each(query, lengths, edges, names, columns, make, kind):
        out = []
        for q, n, e, f, v in zip(query.to_pylist(), lengths.to_pylist(), edges.to_pylist(), names.to_pylist(), columns.to_pylist(), strict=True):
            own, at = compile_query(q), dict(zip(f or [], v or [], strict=False))
            s = Sentence(n or 0, at.get)
            out.append(make(own, s, None if e is None else [(x["src"], x["dst"], x["rel"]) for x in e]))
        return pa.array(out, kind)

    def hit(own, s, arcs):
        return own.program.hit(s) if own.kind == "surface" else own.matcher.hit(s, arcs)

    def render(own, s, arcs):
        if own.kind == "surface":
            return [{"spans": [_span(x)], "named": []} for x in own.program.spans(s)]
        return [{"spans": [_span(x) for x in t], "named": [{"name": n, "start": a, "end": b} for n, a, b in _named(own, t)]} for t in own.matcher.tuples(s, arcs)]

    def token_hit(query: pa.Array, lengths: pa.Array, edges: pa.Array, names: pa.Array, columns: pa.Array) -> pa.Array:
        return each(query, lengths, edges, names, columns, hit, pa.bool_())

    def token_spans(query: pa.Array, lengths: pa.Array, edges: pa.Array, names: pa.Array, columns: pa.Array) -> pa.Array:
        return each(query, lengths, edges, names, columns, render, _ARROW)

    spark.udf.register("token_hit", F.arrow_udf(token_hit, returnType="boolean"))
    spark.udf.register("token_spans", F.arrow_udf(token_spans, returnType=MATCHES))


__all__ = ["Lowered", "capture_mode", "captures", "count", "each", "explain", "graph_of", "hits", "lower", "matches", "register", "span_text", "spans"]
