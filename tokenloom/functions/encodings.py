"""Interchange encodings of tokens and edge labels, and functions of a sentence's graph, as columns."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from .arrow import bounded_batches

#: Fixed values of the interchange format: the separators, and what stood for an empty token in old files.
TOKEN_SEP, LABEL_SEP, EMPTY_TOKEN = "|", ",", ""
ROOT = "root"
TOKEN_FIELDS = ("word", "lemma", "pos", "tag", "entity", "chunk", "norm", "raw")


def escape(value: Column) -> Column:
    """A backslash before each backslash, pipe and comma."""
    for sign in ("\\", TOKEN_SEP, LABEL_SEP):
        value = F.replace(value, F.lit(sign), F.lit("\\" + sign))
    return value


def unescape(value: Column) -> Column:
    """The inverse of escape; a lone backslash at the end goes."""
    return F.when(F.contains(value, F.lit("\\")), F.regexp_replace(value, r"(?s)\\(.?)", "$1")).otherwise(value)


def split_escaped(value: Column, separator: str) -> Column:
    """Parts between separators that no backslash stands before; escapes stay. An empty value is one empty part.

    Escaped characters are read in pairs, so a separator after an escaped backslash parts. A match takes one part and its
    separator; the sentinel separator at the end makes the last part like the others.
    """
    sep = "\\" + separator
    lone = F.length(F.regexp_extract(value, r"(\\*)\z", 1)) % 2 == 1  # a backslash at the end that escapes nothing: it goes back on the last part
    whole = F.when(lone, F.substring(value, F.lit(1), F.length(value) - 1)).otherwise(value)
    found = F.regexp_extract_all(F.concat(whole, F.lit(separator)), F.lit(rf"(?s)([^\\{sep}]*+(?:\\.[^\\{sep}]*+)*){sep}"), F.lit(1))
    read = F.when(lone, F.transform(found, lambda x, i: F.when(i == F.size(found) - 1, F.concat(x, F.lit("\\"))).otherwise(x))).otherwise(found)
    return F.when(F.contains(value, F.lit("\\")), read).otherwise(F.split(value, f"[{separator}]", -1))  # most values have no backslash


def encode_tokens(tokens: Column) -> Column:
    return F.array_join(F.transform(tokens, escape), TOKEN_SEP)


def decode_tokens(value: Column) -> Column:
    """Tokens of an encoded list; none for an empty string."""
    return F.when(value == "", F.array().cast("array<string>")).otherwise(F.transform(split_escaped(value, TOKEN_SEP), unescape))


def decode_tokens_legacy(value: Column) -> Column:
    """As decode_tokens, with the old sign of an empty token read as one."""
    return F.transform(decode_tokens(value), lambda t: F.when(t == EMPTY_TOKEN, "").otherwise(t))


def encode_edges(slots: Column) -> Column:
    return F.array_join(F.transform(slots, lambda s: F.array_join(F.transform(s, escape), LABEL_SEP)), TOKEN_SEP)


def decode_edges(value: Column) -> Column:
    part = lambda s: F.when(s == "", F.array().cast("array<string>")).otherwise(F.transform(split_escaped(s, LABEL_SEP), unescape))
    return F.when(value == "", F.array().cast("array<array<string>>")).otherwise(F.transform(split_escaped(value, TOKEN_SEP), part))


def slot_terms(df: DataFrame, value: Column, multi: bool, keys: tuple[str, ...]) -> DataFrame:
    """keys, position, term of an encoded column: one term a position, or with multi several different ones. Empty ones are left out, their position counts."""
    slots = F.transform(decode_edges(value), F.array_distinct) if multi else F.transform(decode_tokens_legacy(value), lambda t: F.array(t))
    out = df.select(*keys, F.posexplode(slots).alias("position", "__terms"))
    return out.select(*keys, "position", F.explode("__terms").alias("term")).where("term <> ''")


# ---- graphs: edges is an array of (src, dst, rel), n the number of tokens


# Each edge is looked at once: edges of a batch are sorted by token together, where a filter for each token would take the square of a sentence's length.

_EDGE = pa.struct([("src", pa.int32()), ("dst", pa.int32()), ("rel", pa.string())])
_EDGE_LISTS = "array<array<struct<src:int,dst:int,rel:string>>>"


class _Edges:
    """Edges of a batch of sentences as flat arrays; those at a token that isn't there are left out where they are listed by token."""

    def __init__(self, n: pa.Array, edges: pa.Array):
        self.n = np.maximum(pc.fill_null(n, 0).to_numpy(zero_copy_only=False), 0).astype(np.int64)
        self.base, self.total = np.cumsum(self.n) - self.n, int(self.n.sum())
        self.sentence = np.repeat(np.arange(len(self.n)), pc.fill_null(pc.list_value_length(edges), 0).to_numpy(zero_copy_only=False))
        flat = edges.flatten()
        parts = dict(zip([f.name for f in flat.type], flat.flatten(), strict=True))
        self.parts = [parts[f.name].cast(f.type) for f in _EDGE]
        self.src, self.dst = (pc.fill_null(x, -1).to_numpy(zero_copy_only=False).astype(np.int64) for x in self.parts[:2])
        self.missing = np.repeat(pc.is_null(edges).to_numpy(zero_copy_only=False), self.n)

    def at(self, token: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Edges in order of their token, and the token of each, counted over the batch."""
        inside = np.flatnonzero((token >= 0) & (token < self.n[self.sentence]))
        place = self.base[self.sentence[inside]] + token[inside]
        order = np.argsort(place, kind="stable")
        return inside[order], place[order]

    def lists(self, place: np.ndarray, values: pa.Array) -> pa.Array:
        """Values in order of their tokens as a list for each token, null where a sentence has no edges at all."""
        offsets = lambda counts: pa.array(np.concatenate(([0], np.cumsum(counts))).astype(np.int32))
        mask = pa.array(self.missing) if self.missing.any() else None
        return pa.ListArray.from_arrays(offsets(self.n), pa.ListArray.from_arrays(offsets(np.bincount(place, minlength=self.total)), values, mask=mask))


def _by_token(n: Column, edges: Column, out: bool, labels: bool) -> Column:
    def run(n: pa.Array, edges: pa.Array) -> pa.Array:
        own = _Edges(n, edges)
        order, place = own.at(own.src if out else own.dst)
        order = pa.array(order)
        values = own.parts[2].take(order) if labels else pa.StructArray.from_arrays([x.take(order) for x in own.parts], fields=list(_EDGE))
        return own.lists(place, values)

    bounded_batches(SparkSession.active())
    return F.arrow_udf(run, returnType="array<array<string>>" if labels else _EDGE_LISTS)(n, edges)


def labels_out(n: Column, edges: Column) -> Column:
    """Labels of the edges that leave each token, in order of the edges."""
    return _by_token(n, edges, True, True)


def labels_in(n: Column, edges: Column) -> Column:
    return _by_token(n, edges, False, True)


def edge_slots(n: Column, edges: Column, roots: Column) -> tuple[Column, Column]:
    """Sorted distinct labels out of and into each token; a root has the label root among those into it."""
    def slots(n: pa.Array, edges: pa.Array, roots: pa.Array | None) -> pa.Array:
        own = _Edges(n, edges)
        order, place = own.at(own.src if roots is None else own.dst)
        rel = own.parts[2].take(pa.array(order))
        if roots is not None:
            sentence = np.repeat(np.arange(len(own.n)), pc.fill_null(pc.list_value_length(roots), 0).to_numpy(zero_copy_only=False))
            root = pc.fill_null(roots.flatten(), -1).to_numpy(zero_copy_only=False).astype(np.int64)
            inside = (root >= 0) & (root < own.n[sentence])
            place = np.concatenate((place, own.base[sentence[inside]] + root[inside]))
            rel = pa.concat_arrays([rel, pa.array([ROOT] * int(inside.sum()), pa.string())])
        coded = rel.dictionary_encode()
        names = coded.dictionary.to_pylist()
        ranked = sorted(range(len(names)), key=lambda k: names[k])
        rank = np.empty(len(names) + 1, np.int64)
        rank[ranked], rank[-1] = np.arange(len(names)), len(names)  # nulls come last
        both = np.unique(place * (len(names) + 1) + rank[pc.fill_null(coded.indices, len(names)).to_numpy(zero_copy_only=False)])
        return own.lists(both // (len(names) + 1), pa.array([*(names[k] for k in ranked), None], pa.string()).take(pa.array(both % (len(names) + 1))))

    def into(n: pa.Array, edges: pa.Array, roots: pa.Array) -> pa.Array:
        return slots(n, edges, roots)

    def out(n: pa.Array, edges: pa.Array) -> pa.Array:
        return slots(n, edges, None)

    bounded_batches(SparkSession.active())
    return F.arrow_udf(out, returnType="array<array<string>>")(n, edges), F.arrow_udf(into, returnType="array<array<string>>")(n, edges, roots)


def outgoing(n: Column, edges: Column) -> Column:
    """Of each token the edges that leave it."""
    return _by_token(n, edges, True, False)


def incoming(n: Column, edges: Column) -> Column:
    return _by_token(n, edges, False, False)


def distinct_edges(edges: Column) -> Column:
    return F.array_distinct(edges)


def _positions(n: Column) -> Column:
    return F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))


def heads(n: Column, edges: Column, basic: Column | None = None) -> Column:
    """One governor a token, -1 for none: the basic graph's where given, else the closest one, of equally close ones the smaller."""
    def closest(i: Column) -> Column:
        into = F.filter(edges, lambda e: (e["dst"] == i) & (e["src"] != i))
        near = F.transform(into, lambda e: F.struct(F.abs(e["src"] - i).alias("d"), e["src"].alias("src")))
        return F.coalesce(F.array_min(near)["src"], F.lit(-1))

    if basic is None:
        return F.transform(_positions(n), closest)
    first = lambda i: F.array_min(F.transform(F.filter(basic, lambda e: (e["dst"] == i) & (e["src"] != i)), lambda e: e["src"]))
    return F.transform(_positions(n), lambda i: F.coalesce(first(i), closest(i)))


def children(heads_of: Column) -> Column:
    """Of each token the tokens whose head it is."""
    return F.transform(heads_of, lambda _, i: F.filter(F.transform(heads_of, lambda h, j: F.when(h == i, j)), lambda j: j.isNotNull()))


def backbone_roots(heads_of: Column) -> Column:
    return F.filter(F.transform(heads_of, lambda h, i: F.when(h < 0, i)), lambda i: i.isNotNull())


def ancestors(heads_of: Column, i: Column) -> Column:
    """The token and the heads above it, as many steps as there are tokens at most, so a cycle ends."""
    step = lambda acc, _: F.when((F.element_at(acc, -1) >= 0) & (F.get(heads_of, F.element_at(acc, -1)) >= 0), F.array_append(acc, F.get(heads_of, F.element_at(acc, -1)))).otherwise(acc)
    return F.aggregate(heads_of, F.array(i.cast("int")), step)


def subtree(heads_of: Column, root: Column) -> Column:
    """Tokens under a token, itself among them."""
    return F.filter(F.transform(heads_of, lambda _, i: F.when(F.array_contains(ancestors(heads_of, i), root), i)), lambda i: i.isNotNull())


def is_acyclic(heads_of: Column) -> Column:
    """Whether following heads always ends."""
    return F.forall(F.transform(heads_of, lambda _, i: F.get(heads_of, F.element_at(ancestors(heads_of, i), -1))), lambda h: h < 0)


# ---- rows


def to_json_row(df: DataFrame) -> DataFrame:
    """Each row as one line of JSON in the column value; fields that are null are left out."""
    return df.select(F.to_json(F.struct(*[F.col(c) for c in df.columns])).alias("value"))


def present_fields(df: DataFrame) -> DataFrame:
    """df with present: names of the token fields that a row has, in canonical order."""
    own = [F.when(F.col(f).isNotNull(), F.lit(f)) for f in TOKEN_FIELDS if f in df.columns]
    return df.withColumn("present", F.array_compact(F.array(*own)) if own else F.array().cast("array<string>"))


def _ranked(counted: DataFrame) -> DataFrame:
    """term, n, id: ranks by count, then term, from 1. Terms of one count are ranked by their first letters apart, so that no window holds all terms."""
    counted = counted.withColumn("__head", F.substring("term", 1, 3))
    heads = counted.groupBy("n", "__head").agg(F.count(F.lit(1)).alias("__m"))
    counts = heads.groupBy("n").agg(F.sum("__m").alias("__all"))  # one row a different count
    before = counts.select("n", F.coalesce(F.sum("__all").over(Window.orderBy(F.col("n").desc()).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__n_before"))
    heads = heads.withColumn("__h_before", F.coalesce(F.sum("__m").over(Window.partitionBy("n").orderBy("__head").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    heads = heads.join(before, "n").select("n", "__head", (F.col("__n_before") + F.col("__h_before")).alias("__before"))
    own = counted.withColumn("__at", F.row_number().over(Window.partitionBy("n", "__head").orderBy("term")))
    return own.join(heads, ["n", "__head"]).select("term", "n", (F.col("__before") + F.col("__at")).cast("long").alias("id"))


def frequencies(df: DataFrame, value: Column) -> DataFrame:
    """term, n, id: by count, then term; id 0 is the empty term's, whether it is there or not."""
    return _ranked(df.select(value.alias("term")).where("term IS NOT NULL AND term <> ''").groupBy("term").agg(F.count(F.lit(1)).alias("n")))


def with_ids(df: DataFrame, value: str, dictionary: DataFrame, most: int = 1_000_000) -> DataFrame:
    """df with id of the term in value, 0 for the empty one, null for one that the dictionary lacks. A dictionary within most rows is broadcast."""
    own = dictionary.select(F.col("term").alias(value), "id")
    own = F.broadcast(own) if dictionary.limit(most + 1).count() <= most else own
    return df.join(own, value, "left").withColumn("id", F.when(F.col(value) == "", F.lit(0)).otherwise(F.col("id")))


def merge_dictionaries(*dictionaries: DataFrame) -> DataFrame:
    """One dictionary of all: counts added up, ids given anew."""
    every = dictionaries[0].select("term", "n")
    for d in dictionaries[1:]:
        every = every.unionAll(d.select("term", "n"))
    return _ranked(every.groupBy("term").agg(F.sum("n").alias("n")))
