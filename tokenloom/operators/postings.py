"""An inverted table over sentences, and candidates found in it instead of in the sentences themselves.

    postings(field, term, split_id, sent_ord, positions)

Rows are sorted by field and term in files of one field and a range of sentences, so bloom filters and page statistics tell where
a term can be. Tests that no single term decides go over the dictionary of a field first: its terms are far fewer than its rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from ..functions.arrow import bounded_batches
from ..functions.encodings import TOKEN_FIELDS
from ..lang.ast import And, Constraint, Exact, Field, Fuzzy, Or
from ..match.surface import leaf_holds
from ..plans import candidate as c, native

ADDRESS = ("split_id", "sent_ord")
DDL = "field string, term string, split_id long, sent_ord long, positions array<int>"
#: Most terms of a dictionary lookup that are broadcast to the postings.
BROADCAST_TERMS = 200_000


def build(sentences: DataFrame, fields: tuple[str, ...] = (*TOKEN_FIELDS, c.OUT, c.IN)) -> DataFrame:
    """Postings of the fields. An empty token has no term, but its position counts; labels at a token are each a term there.

    All tokens of a sentence are in its row, so nothing is shuffled: positions are gathered by term in each batch.
    """
    bounded_batches(sentences.sparkSession)
    out = None
    for f in (f for f in fields if f in sentences.columns):
        rows = sentences.select(*[F.col(x).cast("long").alias(x) for x in ADDRESS], f).mapInArrow(_gather, "term string, split_id long, sent_ord long, positions array<int>")
        rows = rows.select(F.lit(f).alias("field"), "term", *ADDRESS, "positions")
        out = rows if out is None else out.unionAll(rows)
    return out


def _gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches of an address and a list of tokens, or of lists of labels: a row for each term of each sentence, with its positions."""
    for b in batches:
        slots = b.column(2)
        n = pc.fill_null(pc.list_value_length(slots), 0).to_numpy()
        sentence = np.repeat(np.arange(len(n)), n)
        position = np.arange(len(sentence)) - np.repeat(np.cumsum(n) - n, n)
        terms = slots.flatten()
        if pa.types.is_list(terms.type):
            k = pc.fill_null(pc.list_value_length(terms), 0).to_numpy()
            sentence, position, terms = np.repeat(sentence, k), np.repeat(position, k), terms.flatten()
        coded = terms.dictionary_encode()
        known = coded.dictionary.to_pylist()
        codes = coded.indices.fill_null(-1).to_numpy()
        there = (codes >= 0) & (codes != (known.index("") if "" in known else -1))
        sentence, position, codes = sentence[there], position[there], codes[there]
        order = np.lexsort((position, codes, sentence))
        sentence, position, codes = sentence[order], position[order], codes[order]
        same = (np.diff(sentence, prepend=-1) == 0) & (np.diff(codes, prepend=-1) == 0)
        once = ~(same & (np.diff(position, prepend=-1) == 0))  # a label twice at one token
        sentence, position, codes, same = sentence[once], position[once], codes[once], same[once]
        first = np.flatnonzero(~same)
        if len(first):
            positions = pa.ListArray.from_arrays(pa.array(np.append(first, len(same)).astype(np.int32)), pa.array(position.astype(np.int32)))
            at = pa.array(sentence[first])
            yield pa.RecordBatch.from_arrays([coded.dictionary.take(pa.array(codes[first])), b.column(0).take(at), b.column(1).take(at), positions], names=["term", *ADDRESS, "positions"])


def write(postings: DataFrame, path: str) -> None:
    """Sorted by field and term in files that follow the sentences' own: a task sorts what it has gathered, and nothing is shuffled.

    A file is of one field and of the sentences of one task, so its bloom filter tells whether it can hold a term, and the statistics of its pages where.
    """
    postings.sortWithinPartitions("field", "term", *ADDRESS).write.option("parquet.bloom.filter.enabled#term", "true").parquet(path)


def dictionary(postings: DataFrame, field: str) -> DataFrame:
    """term, df (sentences that have it), n (times it is there)."""
    return postings.where(F.col("field") == field).groupBy("term").agg(F.count(F.lit(1)).alias("df"), F.sum(F.size("positions")).alias("n"))


def of_leaf(postings: DataFrame, leaf: Field | Fuzzy) -> DataFrame:
    """Postings of all terms that hold a test."""
    own = postings.where(F.col("field") == leaf.name)
    if isinstance(leaf, Field) and (word := c.literal(leaf.value)) is not None:
        return own.where(F.col("term") == word)
    return _expanded(own, native.leaf(leaf, F.col("term")))


def _expanded(own: DataFrame, holds) -> DataFrame:
    terms = own.select("term").distinct().where(holds)  # the test runs once a term
    some = [r[0] for r in terms.limit(BROADCAST_TERMS + 1).collect()]
    if len(some) <= BROADCAST_TERMS:  # looked up once: a plan of them would read the postings again
        terms = F.broadcast(own.sparkSession.createDataFrame([(t,) for t in some], "term string"))
    return own.join(terms, "term", "left_semi").select(*own.columns)


def of_label(postings: DataFrame, want: c.HasLabel) -> DataFrame:
    own = postings.where(F.col("field") == want.side)
    holds = native.label(want.labels, F.col("term"))
    return own.where(holds) if all(isinstance(x, Exact) for x in want.labels) else _expanded(own, holds)


def document_frequency(postings: DataFrame, leaf: Field | Fuzzy) -> int:
    """Sentences of each term that holds the test, added up."""
    return of_leaf(postings, leaf).count()


def _sentences(rows: DataFrame) -> DataFrame:
    return rows.select(*ADDRESS).distinct()


def candidates(postings: DataFrame, sentences: DataFrame, want: c.Candidate) -> DataFrame:
    """Addresses of the sentences that a condition lets pass. sentences is read only where the condition is none."""
    if isinstance(want, c.All):
        return sentences.select(*ADDRESS).distinct()
    if isinstance(want, c.Has):
        return _sentences(of_leaf(postings, want.leaf))
    if isinstance(want, c.HasLabel):
        return _sentences(of_label(postings, want))
    if isinstance(want, c.HasPhrase):
        return _phrase(postings, want)
    if isinstance(want, c.SameToken):
        return _same_token(postings, sentences, want)
    found = [candidates(postings, sentences, p) for p in want.parts]
    out = found[0]
    for f in found[1:]:
        out = out.join(f, list(ADDRESS), "left_semi") if isinstance(want, c.AllOf) else out.union(f)
    return out if isinstance(want, c.AllOf) else out.distinct()


def _places(rows: DataFrame) -> DataFrame:
    return rows.select(*ADDRESS, F.explode("positions").alias("at")).distinct()


def _phrase(postings: DataFrame, want: c.HasPhrase) -> DataFrame:
    own, out = postings.where(F.col("field") == want.field), None
    for k, term in enumerate(want.terms):
        at = _places(own.where(F.col("term") == term)).withColumn("at", F.col("at") - k)
        out = at if out is None else out.join(at, [*ADDRESS, "at"], "left_semi")
    return _sentences(out)


def _tested(postings: DataFrame, test: Constraint) -> DataFrame | None:
    """Places that hold a test, or more; None if postings can't tell."""
    if isinstance(test, Field | Fuzzy):
        return None if leaf_holds(test, "") else _places(of_leaf(postings, test))
    if isinstance(test, And):
        parts = [p for p in (_tested(postings, t) for t in test.parts) if p is not None]
        out = parts[0] if parts else None
        for p in parts[1:]:
            out = out.join(p, [*ADDRESS, "at"], "left_semi")
        return out
    if isinstance(test, Or):
        parts = [_tested(postings, t) for t in test.parts]
        if any(p is None for p in parts):
            return None
        out = parts[0]
        for p in parts[1:]:
            out = out.union(p)
        return out.distinct()
    return None


def _same_token(postings: DataFrame, sentences: DataFrame, want: c.SameToken) -> DataFrame:
    parts = [p for p in (_tested(postings, t) for t in want.tests) if p is not None] + [_places(of_label(postings, x)) for x in want.labels]
    if not parts:
        return candidates(postings, sentences, c.All())
    out = parts[0]
    for p in parts[1:]:
        out = out.join(p, [*ADDRESS, "at"], "left_semi")
    return _sentences(out)


def required_terms(want: c.Candidate) -> list[tuple[str, str]]:
    """Field and term that every match has; a file without one of them need not be read."""
    if isinstance(want, c.Has):
        word = c.literal(want.leaf.value) if isinstance(want.leaf, Field) else None
        return [(want.leaf.name, word)] if word is not None else []
    if isinstance(want, c.HasPhrase):
        return [(want.field, t) for t in want.terms]
    if isinstance(want, c.HasLabel):
        word = c.literal(want.labels[0]) if len(want.labels) == 1 else None
        return [(want.side, word)] if word is not None else []
    if isinstance(want, c.SameToken):
        own = [x for t in want.tests for x in required_terms(c.of_test(t))]
        return own + [x for label in want.labels for x in required_terms(label)]
    if isinstance(want, c.AllOf):
        return list(dict.fromkeys(x for p in want.parts for x in required_terms(p)))
    return []


def fields_of(want: c.Candidate) -> set[str] | None:
    """Fields that a condition asks for; None if it lets every sentence pass, which no postings tell."""
    if isinstance(want, c.All):
        return None
    if isinstance(want, c.Has):
        return {want.leaf.name}
    if isinstance(want, c.HasPhrase):
        return {want.field}
    if isinstance(want, c.HasLabel):
        return {want.side}
    if isinstance(want, c.SameToken):
        parts = [*(fields_of(c.of_test(t)) for t in want.tests), *map(fields_of, want.labels)]
    else:
        parts = list(map(fields_of, want.parts))
    return None if any(p is None for p in parts) else set().union(*parts)


def answers(want: c.Candidate, fields: tuple[str, ...]) -> bool:
    """Whether postings of these fields tell which sentences a condition lets pass."""
    asked = fields_of(want)
    return asked is not None and asked <= set(fields)


def splits_with(postings: DataFrame, terms: list[tuple[str, str]]) -> DataFrame:
    """split_id of the splits that have all of the terms."""
    out = postings.select("split_id").distinct()
    for field, term in terms:
        own = postings.where((F.col("field") == field) & (F.col("term") == term)).select("split_id").distinct()
        out = out.join(own, "split_id", "left_semi")
    return out


def hits(sentences: DataFrame, postings: DataFrame, query: str) -> DataFrame:
    """Rows of sentences that match, with candidates from the postings."""
    from ..plans.compiler import compile_query
    from .match import lower

    q = compile_query(query)
    some = sentences.join(candidates(postings, sentences, q.candidate), list(ADDRESS), "left_semi")
    low = lower(q, sentences.columns)
    return some if q.decided else some.where(low.candidate).where(low.hit)
