"""Sentences from plain texts by fixed rules: a stand-in for an annotator, the same in Spark and in SQL.

Lines are cut at full stops; tokens are runs of letters and digits or single signs. Tags go by word
lists and endings, the graph ties each token to its governor by its tag. Sentences of every length are kept.
"""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..errors import ConfigError

#: Fixed values of the rules.
DT = frozenset("the a an this la le les un une der die das el los".split())
IN = frozenset("of to in for on with by at from de en von zu con por".split())
CC = frozenset("and or et und y".split())
VBD = frozenset("is was are be were".split())
_WORD = regex.compile(r"[\p{L}\p{N}]")
_DIGITS = regex.compile(r"[0-9]+")


def tag(w: str) -> str:
    low = w.lower()
    if w in (",", "!"):
        return "PUNCT"
    if not _WORD.search(w):
        return "SYM"
    if _DIGITS.fullmatch(w):
        return "CD"
    for words, name in ((DT, "DT"), (IN, "IN"), (CC, "CC"), (VBD, "VBD")):
        if low in words:
            return name
    for ending, name in (("ed", "VBD"), ("ing", "VBG"), ("ly", "RB")):
        if w.endswith(ending):
            return name
    return "NNP" if "A" <= w[0] <= "Z" else "NNS" if w.endswith("s") else "NN"


_STRINGS = pa.list_(pa.string())
_GRAPH = pa.struct([("name", pa.string()), ("edges", pa.list_(pa.struct([("src", pa.int32()), ("dst", pa.int32()), ("rel", pa.string())]))), ("roots", pa.list_(pa.int32()))])
_MADE = pa.schema([
    ("doc_id", pa.string()), ("sentence_id", pa.string()), ("sent_ord", pa.int64()), ("sentence_length", pa.int32()),
    *[(f, _STRINGS) for f in ("word", "lemma", "tag")], ("outgoing_edges", pa.list_(_STRINGS)), ("incoming_edges", pa.list_(_STRINGS)), ("graph", _GRAPH),
])
_DDL = (
    "doc_id string, sentence_id string, sent_ord long, sentence_length int, word array<string>, lemma array<string>, tag array<string>,"
    " outgoing_edges array<array<string>>, incoming_edges array<array<string>>, graph struct<name:string,edges:array<struct<src:int,dst:int,rel:string>>,roots:array<int>>"
)


#: Names by number: tags, and labels in order of the alphabet.
_TAGS = ("PUNCT", "SYM", "CD", "DT", "IN", "CC", "VBD", "VBG", "RB", "NNP", "NNS", "NN")
_RELS = ("advmod", "case", "cc", "compound", "conj", "det", "dobj", "nsubj", "punct", "ref", "root")
_LABEL = {"DT": "det", "IN": "case", "RB": "advmod", "CC": "cc", "PUNCT": "punct", "SYM": "punct"}
_TAG_NO, _REL = {t: k for k, t in enumerate(_TAGS)}, {r: k for k, r in enumerate(_RELS)}
_VERB, _NOUN = np.array([t[0] == "V" for t in _TAGS]), np.array([t[:2] == "NN" for t in _TAGS])
_FIXED_REL = np.array([_REL[_LABEL[t]] if t in _LABEL else -1 for t in _TAGS])
#: Tokens, full stops and ends of lines, in any text and in one of plain ASCII.
_CUTS, _ASCII_CUTS = regex.compile(r"[\p{L}\p{N}]+|[^ \t\x0b\f\r\p{L}\p{N}]"), re.compile(r"[A-Za-z0-9]+|[^ \t\x0b\f\rA-Za-z0-9]")
#: Characters that are annotated at once; longer texts are taken in pieces of whole lines.
PIECE = 1 << 19
#: Bytes of a documents file for each partition of the sentences made from it.
PART_BYTES = 4 << 20


@lru_cache(1 << 17)
def _tag_no(w: str) -> int:
    return _TAG_NO[tag(w)]


def _pieces(doc_id: str | None, text: str) -> Iterator[tuple[str | None, int, str]]:
    """doc_id, number of the first line, lines."""
    at = line = 0
    while at < len(text):
        end = text.find("\n", at + PIECE)
        end = len(text) if end < 0 else end
        yield doc_id, line, text[at:end]
        line += text.count("\n", at, end) + 1
        at = end + 1


def _strings(names: tuple[str, ...], numbers: np.ndarray) -> pa.Array:
    return pa.array(names, pa.string()).take(pa.array(numbers))


def _lists(counts: np.ndarray, values: pa.Array) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(counts))).astype(np.int32)), values)


def _sentences(pieces: list[tuple[str | None, int, str]]) -> pa.RecordBatch | None:
    """Sentences of pieces of documents, by arrays over all of their tokens at once; None if there are none."""
    found = [(_ASCII_CUTS if text.isascii() else _CUTS).findall(text) for _, _, text in pieces]
    flat = pa.array([w for words in found for w in words], pa.string()).dictionary_encode()
    codes, distinct = flat.indices.to_numpy(), flat.dictionary.to_pylist()
    piece = np.repeat(np.arange(len(found)), [len(words) for words in found])
    line_end, stop = (codes == (distinct.index(sign) if sign in distinct else -1) for sign in ("\n", "."))
    token = ~(line_end | stop)
    if not token.any():
        return None
    # Lines of a piece and sentences of a line are numbered by the signs before them.
    lines, stops = np.cumsum(line_end), np.cumsum(stop)
    line = piece + lines
    begins = np.flatnonzero(np.diff(line, prepend=-1))
    sent_no = stops - np.repeat((stops - stop)[begins], np.diff(begins, append=len(line)))
    heads = np.flatnonzero(np.diff(piece, prepend=-1))
    line_no = lines - np.repeat((lines - line_end)[heads], np.diff(heads, append=len(line))) + np.array([first for _, first, _ in pieces])[piece]
    segment = (line + stops)[token]
    codes, own = codes[token], np.flatnonzero(np.diff(segment, prepend=-1))
    n = np.diff(own, append=len(segment))
    at = np.flatnonzero(token)[own]
    sentence = np.repeat(np.arange(len(own)), n)
    i = np.arange(len(segment)) - own[sentence]

    tags = np.array([_tag_no(w) for w in distinct])[codes]
    noun, verb, name = _NOUN[tags], _VERB[tags], tags == _TAG_NO["NNP"]
    first_verb = np.minimum.reduceat(np.where(verb, i, len(segment)), own)
    root = np.where(first_verb < n, first_verb, 0)
    r = root[sentence]
    chained = noun & np.concatenate(([False], noun[:-1])) & (i > 0)
    ahead = (tags == _TAG_NO["DT"]) | (tags == _TAG_NO["IN"])
    governor = np.where(ahead, np.where(i + 1 < n[sentence], i + 1, r), np.where(chained & (i > r), i - 1, r))
    rel = _FIXED_REL[tags]
    rel = np.where(rel >= 0, rel, np.where(verb, _REL["conj"], np.where(i < r, _REL["nsubj"], np.where(chained, _REL["compound"], _REL["dobj"]))))
    arcs, refs = np.flatnonzero(i != r), np.flatnonzero(name & (i > 0))
    where = np.concatenate((sentence[arcs], sentence[refs]))
    order = np.argsort(where, kind="stable")
    where = where[order]
    src, dst = np.concatenate((governor[arcs], i[refs]))[order], np.concatenate((i[arcs], np.zeros(len(refs), i.dtype)))[order]
    rels = np.concatenate((rel[arcs], np.full(len(refs), _REL["ref"])))[order]

    def slots(tokens: np.ndarray, labels: np.ndarray) -> pa.ListArray:
        """The distinct labels of each token, in order."""
        flags = np.zeros(len(i) * len(_RELS), bool)
        flags[tokens * len(_RELS) + labels] = True
        set_ = np.flatnonzero(flags)
        return _lists(n, _lists(np.bincount(set_ // len(_RELS), minlength=len(i)), _strings(_RELS, set_ % len(_RELS))))

    base = own[where]
    into = slots(np.concatenate((base + dst, own + root)), np.concatenate((rels, np.full(len(own), _REL["root"]))))
    doc, line_at, sent_at = piece[at], line_no[at], sent_no[at]
    ids = [pieces[k][0] for k in doc]
    word, low = _lists(n, flat.dictionary.take(pa.array(codes))), _lists(n, pa.array([w.lower() for w in distinct], pa.string()).take(pa.array(codes)))
    edge = pa.StructArray.from_arrays([pa.array(src.astype(np.int32)), pa.array(dst.astype(np.int32)), _strings(_RELS, rels)], ["src", "dst", "rel"])
    graph = pa.StructArray.from_arrays([_strings(("dependencies",), np.zeros(len(own), int)), _lists(np.bincount(where, minlength=len(own)), edge), _lists(np.ones(len(own), int), pa.array(root.astype(np.int32)))], ["name", "edges", "roots"])
    columns = [
        pa.array(ids, pa.string()), pa.array([f"{d}_{a}_{b}" for d, a, b in zip(ids, line_at.tolist(), sent_at.tolist(), strict=True)], pa.string()), pa.array(line_at * 100000 + sent_at), pa.array(n.astype(np.int32)),
        word, low, _lists(n, _strings(_TAGS, tags)), slots(base + src, rels), into, graph,
    ]
    return pa.RecordBatch.from_arrays(columns, schema=_MADE)


def _whole(lean: DataFrame) -> DataFrame:
    """With the columns that follow from word, lemma and tag, which aren't written: they are worked out where they are read."""
    def runs(inside: Callable[[Column], Column], name: str) -> Column:
        kind = lambda i: F.when((i > 0) & inside(F.get("tag", i - 1)), f"I-{name}").otherwise(f"B-{name}")
        return F.transform("tag", lambda t, i: F.when(inside(t), kind(i)).otherwise("O"))

    made = {
        "pos": F.transform("tag", lambda t: F.substring(t, 1, 2)), "entity": runs(lambda t: t == "NNP", "ENT"), "chunk": runs(lambda t: t.isin("DT", "CD") | t.startswith("NN"), "NP"),
        "norm": F.col("lemma"), "raw": F.col("word"),
    }
    order = ("doc_id", "sentence_id", "sent_ord", "sentence_length", "word", "lemma", "pos", "tag", "entity", "chunk", "norm", "raw", "outgoing_edges", "incoming_edges", "graph")
    return lean.select(*[made[c].alias(c) if c in made else F.col(c) for c in order], *[c for c in lean.columns if c == "split_id"])


def annotate(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """Sentences (without split) of the documents, in batches of a bounded number of characters. Null texts have none."""
    return _whole(_annotated(docs, text_col, id_col))


def _annotated(docs: DataFrame, text_col: str, id_col: str) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        size = 0
        for b in batches:
            for doc_id, text in zip(b.column(0), b.column(1), strict=True):
                for piece in _pieces(doc_id.as_py(), text.as_py() or ""):
                    held.append(piece)
                    size += len(piece[2])
                    if size >= PIECE:
                        if (made := _sentences(held)) is not None:
                            yield made
                        held, size = [], 0
        if held and (made := _sentences(held)) is not None:
            yield made

    return docs.select(F.col(id_col).cast("string"), F.col(text_col)).mapInArrow(run, _DDL)


_built: dict[tuple, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """Where all executors can read and write: the folder in spark.checkpoint.dir, or, on one machine only, a temporary one."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder
    context = spark.sparkContext
    if not context._jsc.sc().getCheckpointDir().isDefined():
        if not context.master.startswith("local"):
            raise ConfigError("spark.checkpoint.dir must name a folder that all executors share")
        context.setCheckpointDir("file://" + tempfile.mkdtemp(prefix="tokenloom-"))
    return context._jsc.sc().getCheckpointDir().get()


def _state(spark: SparkSession, path: str) -> tuple:
    """Files of a table with their sizes and times, by the file system that has them."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return tuple(sorted((f.getPath().toString(), f.getLen(), f.getModificationTime()) for f in fs.listStatus(at)))


def sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sentences of a folder's documents as a table that is written once a session and state of its files, in page order within its files."""
    source = f"{sf_dir}/documents.parquet"
    key = (spark.sparkContext.applicationId, source, _state(spark, source))
    if key not in _built:
        docs = spark.read.parquet(source).select("doc_id", "text")
        parts = max(spark.sparkContext.defaultParallelism, -(-sum(size for _, size, _ in key[2]) // PART_BYTES))  # so a task doesn't grow with the table
        path = f"{shared_folder(spark)}/sentences-{uuid.uuid4().hex}"
        _annotated(docs.repartitionByRange(parts, "doc_id"), "text", "doc_id").withColumn("split_id", F.col("doc_id").cast("long")).write.parquet(path)
        _built[key] = path
    return _whole(spark.read.parquet(_built[key]))


#: The same rules as SQL: sent(sentence_id, doc_id, sent_ord, w, n), tok(sentence_id, n, i, w, lemma, tag), edge(sentence_id, src, dst, rel).
SQL = r"""
WITH RECURSIVE ln AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) - 1 AS ln FROM documents),
sn AS (SELECT doc_id, ln, unnest(string_split(line, '.')) AS s, generate_subscripts(string_split(line, '.'), 1) - 1 AS sn FROM ln),
sent AS (SELECT doc_id || '_' || ln || '_' || sn AS sentence_id, CAST(doc_id AS VARCHAR) AS doc_id, CAST(ln AS BIGINT) * 100000 + sn AS sent_ord, w, len(w) AS n
         FROM (SELECT *, regexp_extract_all(s, '[\p{L}\p{N}]+|[^\s\p{L}\p{N}]') AS w FROM sn) WHERE len(w) > 0),
tok0 AS (SELECT sentence_id, doc_id, sent_ord, n, CAST(generate_subscripts(w, 1) - 1 AS INTEGER) AS i, unnest(w) AS w FROM sent),
tok AS MATERIALIZED (SELECT sentence_id, doc_id, sent_ord, n, i, w, lower(w) AS lemma, CASE
    WHEN w IN (',', '!') THEN 'PUNCT' WHEN NOT regexp_matches(w, '[\p{L}\p{N}]') THEN 'SYM' WHEN regexp_matches(w, '^[0-9]+$') THEN 'CD'
    WHEN lower(w) IN ('the','a','an','this','la','le','les','un','une','der','die','das','el','los') THEN 'DT'
    WHEN lower(w) IN ('of','to','in','for','on','with','by','at','from','de','en','von','zu','con','por') THEN 'IN'
    WHEN lower(w) IN ('and','or','et','und','y') THEN 'CC' WHEN lower(w) IN ('is','was','are','be','were') OR w LIKE '%ed' THEN 'VBD'
    WHEN w LIKE '%ing' THEN 'VBG' WHEN w LIKE '%ly' THEN 'RB' WHEN regexp_matches(w, '^[A-Z]') THEN 'NNP' WHEN w LIKE '%s' THEN 'NNS' ELSE 'NN' END AS tag FROM tok0),
root AS (SELECT sentence_id, coalesce(min(CASE WHEN tag LIKE 'V%' THEN i END), 0) AS r FROM tok GROUP BY sentence_id),
tr AS (SELECT t.*, r, lag(tag) OVER (PARTITION BY sentence_id ORDER BY i) AS prev FROM tok t JOIN root USING (sentence_id)),
edge AS MATERIALIZED (SELECT sentence_id, CAST(CASE WHEN tag IN ('DT', 'IN') THEN CASE WHEN i + 1 < n THEN i + 1 ELSE r END WHEN tag LIKE 'NN%' AND i > r AND prev LIKE 'NN%' THEN i - 1 ELSE r END AS INTEGER) AS src, i AS dst,
    CASE WHEN tag = 'DT' THEN 'det' WHEN tag = 'IN' THEN 'case' WHEN tag = 'RB' THEN 'advmod' WHEN tag = 'CC' THEN 'cc' WHEN tag IN ('PUNCT', 'SYM') THEN 'punct' WHEN tag LIKE 'V%' THEN 'conj'
         WHEN i < r THEN 'nsubj' WHEN tag LIKE 'NN%' AND prev LIKE 'NN%' THEN 'compound' ELSE 'dobj' END AS rel FROM tr WHERE i <> r
  UNION ALL SELECT sentence_id, i, 0, 'ref' FROM tok WHERE tag = 'NNP' AND i > 0)
"""
