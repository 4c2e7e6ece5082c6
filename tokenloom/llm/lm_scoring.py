"""LM scoring by deleted interpolation of trigram, bigram, unigram and uniform models.

Counts cover all training documents. Texts are dealt once into chunks; a chunk asks for the counts of its distinct n-grams
(56-bit hashes) by sending them, with its own counts, to the groups that own them, which add up and answer in the
same order. So an n-gram that is in every document travels once for each chunk, and no table of counts is broadcast. Chunks and
owners are groups of bounded size, dealt over as many partitions as the session sets: the number of partitions doesn't depend on the data.

The mixture weights of a bucket of contexts are found by expectation-maximisation on the tokens of a deleted eighth of the training
documents, under the counts of the rest. A bucket is the power of two of the count of the two words before, or, where they were
never seen together, that of the count of the last one. The deleted tokens meet in a table over bucket, trigram share, bigram share
and unigram count (quarter and half octaves), whose size doesn't depend on the corpus; every cell carries the exact sums of its
shares, so that expectation-maximisation sees their exact mean. Final scores use the counts of all training documents. A weight whose
model is undefined (a context that was never seen) is shared by the others, so the probabilities of all words add up to one.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame, functions as F

from .batches import bounded_batches, segment_sums
from .common import quoted, shuffle_partitions

#: Bytes of text in a chunk, and bytes of text whose n-grams one owner has, on average.
CHUNK_BYTES, OWNED_BYTES = 8 << 20, 8 << 20
DELETED = 8
#: Classes of a count by powers of two, and buckets of contexts: by the last two words, and by the last one.
CLASSES = 48
BUCKETS = 2 * CLASSES
STEPS = 60
#: Hashes of the end of a text, which is a token, and of the two contexts before its first word, which aren't.
END, START, BEFORE = np.uint64(0x2D358DCCAA6C78A4), np.uint64(0x8BB84B93962EACC8), np.uint64(0x4B33A62ED433D4A3)
_A, _B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
#: Bits of a key: the last two say how many words it has.
KEY_BITS, KINDS = 56, np.uint64(3)
KNOWN_WORDS = 150_000
MADE = ("n_tokens", "n_known", "train_tokens", "base_score", "score")


class WordHashes(dict):
    """Hash of a word as bytes; remembers a bounded number of them."""

    def __missing__(self, word: bytes) -> int:
        h = xxhash.xxh64_intdigest(word)
        if len(self) < KNOWN_WORDS:
            self[word] = h
        return h


_hashes = WordHashes()


def _key(hashes: np.ndarray, n: int) -> np.ndarray:
    return (hashes >> np.uint64(64 - KEY_BITS)) & ~KINDS | np.uint64(n)


def _mixed(before: np.ndarray, words: np.ndarray) -> np.ndarray:
    mixed = before * _A
    mixed ^= mixed >> np.uint64(29)
    return (mixed + words) * _B


def distinct(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct values in order, and each value's place among them."""
    order = np.argsort(values)
    values = values[order]
    new = np.ones(len(values), bool)
    new[1:] = values[1:] != values[:-1]
    places = np.empty(len(values), np.int32)
    places[order] = np.cumsum(new) - 1
    return values[new], places


class Tokens:
    """The tokens of a chunk: distinct keys, and of each token the places of its word, pair and triple, and of the contexts of the last two."""

    def __init__(self, texts: list[bytes | None]):
        docs = []
        for t in texts:
            words = (t or b"").lower().split()
            ids = np.empty(len(words) + 3, np.uint64)
            ids[0], ids[1], ids[-1] = BEFORE, START, END
            ids[2:-1] = np.fromiter(map(_hashes.__getitem__, words), np.uint64, len(words))
            docs.append(ids)
        self.lengths = np.array([len(d) - 2 for d in docs], np.int64)
        firsts = np.cumsum(self.lengths) - self.lengths
        n = int(self.lengths.sum())
        stream = np.concatenate(docs) if docs else np.zeros(0, np.uint64)
        last = np.ones(len(stream), bool)
        starts = firsts + 2 * np.arange(len(docs))
        last[starts] = last[starts + 1] = False
        at = np.flatnonzero(last)
        words, pairs = stream[at], _mixed(stream[at - 1], stream[at])
        context = _mixed(np.array([BEFORE]), np.array([START]))
        before = np.empty(n, np.uint64)
        before[1:] = pairs[:-1]
        before[firsts] = context[0]
        every = np.concatenate([_key(words, 1), _key(pairs, 2), _key(_mixed(before, words), 3), _key(np.array([START]), 1), _key(context, 2)])
        self.keys, places = distinct(every)
        self.word, self.pair, self.triple = places[:n], places[n : 2 * n], places[2 * n : 3 * n]
        self.starts = places[3 * n :]  # of START and of BEFORE START
        self.after_one, self.after_two = np.empty(n, np.int32), np.empty(n, np.int32)
        self.after_one[1:], self.after_two[1:] = self.word[:-1], self.pair[:-1]
        self.after_one[firsts], self.after_two[firsts] = self.starts

    def counts(self, docs: np.ndarray) -> np.ndarray:
        """How often the chosen documents have each key; the contexts before the first word count once for each of them."""
        token = np.repeat(docs, self.lengths)
        out = sum(np.bincount(x[token], minlength=len(self.keys)) for x in (self.word, self.pair, self.triple))
        out[self.starts] += int(docs.sum())
        return out.astype(np.uint32)


def pack(values: np.ndarray) -> bytes:
    """Numbers as planes of bytes, compressed: the high ones are mostly zero, and so are most counts but for their lowest."""
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(values.view(np.uint8).reshape(len(values), values.itemsize).T).tobytes())


def unpack(raw: bytes, kind: type) -> np.ndarray:
    size = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(zstandard.ZstdDecompressor().decompress(raw), np.uint8).reshape(size, -1).T).view(kind).ravel()


def pack_keys(keys: np.ndarray) -> bytes:
    return pack(np.diff(keys, prepend=np.uint64(0)))


def unpack_keys(raw: bytes) -> np.ndarray:
    return np.cumsum(unpack(raw, np.uint64), dtype=np.uint64)


def _binary(column: pa.ChunkedArray) -> list[bytes | None]:
    return column.cast(pa.binary()).to_pylist()


ASKED = pa.schema([("part", pa.int32()), ("chunk", pa.int64()), ("keys", pa.binary()), ("n_train", pa.binary()), ("n_deleted", pa.binary())])
ANSWERED = pa.schema([("chunk", pa.int64()), ("part", pa.int32()), ("n_train", pa.binary()), ("n_deleted", pa.binary()), ("sizes", pa.list_(pa.int64()))])
SEEN = pa.schema([("cell", pa.int64()), ("n", pa.int64()), ("triple", pa.float64()), ("pair", pa.float64()), ("word", pa.float64())])
SCORED = [("n_tokens", pa.int64()), ("n_known", pa.int64()), ("train_tokens", pa.int64()), ("base_score", pa.float64()), ("score", pa.float64())]


def _ddl(schema: pa.Schema) -> str:
    kinds = {pa.int32(): "int", pa.int64(): "long", pa.binary(): "binary", pa.float64(): "double", pa.list_(pa.int64()): "array<long>"}
    return ", ".join(f"{f.name} {kinds[f.type]}" for f in schema)


def _table(columns, schema: pa.Schema) -> pa.Table:
    return pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


def asking(parts: int):
    def ask(docs: pa.Table) -> pa.Table:
        """The chunk's distinct keys with its counts, cut by the group that owns them."""
        t = Tokens(_binary(docs["text"]))
        train, deleted = (np.array(docs[c].to_pylist(), bool) for c in ("train", "deleted"))
        n_train, n_deleted = t.counts(train), t.counts(deleted)
        owner = ((t.keys >> np.uint64(KEY_BITS - 32)) * np.uint64(parts)) >> np.uint64(32)
        cuts = np.flatnonzero(np.diff(owner, prepend=np.uint64(parts)))  # keys are in order, and so are their owners
        ends = np.append(cuts[1:], len(owner))
        chunk = docs["chunk"][0].as_py()
        rows = [(int(owner[a]), chunk, pack_keys(t.keys[a:b]), pack(n_train[a:b]), pack(n_deleted[a:b])) for a, b in zip(cuts, ends, strict=True)]
        return _table(zip(*rows, strict=True), ASKED)

    return ask


def answer(asked: pa.Table) -> pa.Table:
    """Counts over all chunks of the keys that one group owns, for each chunk in the order of its keys. sizes: training tokens and distinct words, then those without the deleted documents.

    Deleted counts are of use to the chunks of deleted documents only, whose numbers are negative; others get none.
    """
    keys = [unpack_keys(k) for k in asked["keys"].to_pylist()]
    ends = np.cumsum([len(k) for k in keys])
    own, places = distinct(np.concatenate(keys))
    del keys
    added = []
    for c in ("n_train", "n_deleted"):
        each = np.concatenate([unpack(x, np.uint32) for x in asked[c].to_pylist()])
        added.append(np.bincount(places, weights=each, minlength=len(own)).astype(np.uint64))
        del each
    word = ((own & KINDS) == 1) & (own != _key(np.array([START]), 1)[0])
    full, rest = added[0][word], added[0][word] - added[1][word]
    sizes = [int(full.sum()), int((full > 0).sum()), int(rest.sum()), int((rest > 0).sum())]
    rows, start = [], 0
    for i, (chunk, part) in enumerate(zip(asked["chunk"].to_pylist(), asked["part"].to_pylist(), strict=True)):
        at = places[start : ends[i]]
        rows.append((chunk, part, pack(added[0][at]), pack(added[1][at]) if chunk < 0 else None, sizes if i == 0 else [0] * 4))
        start = ends[i]
    return _table(zip(*rows, strict=True), ANSWERED)


def _answers(answered: pa.Table, column: str) -> np.ndarray:
    rows = sorted(zip(answered["part"].to_pylist(), answered[column].to_pylist(), strict=True))
    return np.concatenate([unpack(x, np.uint64) for _, x in rows]).astype(np.int64)


def class_of(counts: np.ndarray) -> np.ndarray:
    return np.minimum(np.ceil(np.log2(counts + 1.0)), CLASSES - 1).astype(np.int64)


def bucket_of(two: np.ndarray, one: np.ndarray) -> np.ndarray:
    """Bucket of contexts of which the last two words were seen so often together, and the last one."""
    return np.where(two > 0, class_of(two), CLASSES + class_of(one))


def shares(t: Tokens, counts: np.ndarray, token: np.ndarray | slice = slice(None)) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of each token its bucket, trigram share, bigram share and count."""
    two, one = counts[t.after_two[token]], counts[t.after_one[token]]
    return bucket_of(two, one), counts[t.triple[token]] / np.maximum(two, 1), counts[t.pair[token]] / np.maximum(one, 1), counts[t.word[token]]


def cells_of(bucket: np.ndarray, triple: np.ndarray, pair: np.ndarray, word: np.ndarray) -> np.ndarray:
    """Cell of the table: bucket, shares by quarter octaves, counts by half octaves."""
    eighth = lambda share: np.where(share > 0, 1 + np.rint(-4 * np.log2(np.maximum(share, 2.0**-60))), 0).astype(np.int64)
    return (bucket << 30) | (eighth(triple) << 20) | (eighth(pair) << 10) | np.where(word > 0, 1 + np.rint(2 * np.log2(np.maximum(word, 1))), 0).astype(np.int64)


#: Rows of SEEN whose cell is negative carry sizes: -1 to -4 for the four of answer().
def see(docs: pa.Table, answered: pa.Table) -> pa.Table:
    """Table of the chunk's deleted tokens under the counts of the rest; chunks of other documents give sizes only."""
    if not len(docs) or not len(answered):
        return SEEN.empty_table()
    sizes = np.array(answered["sizes"].to_pylist()).sum(axis=0)
    cells, sums = np.zeros(0, np.int64), [np.zeros(0)] * 4
    if docs["chunk"][0].as_py() < 0:
        t = Tokens(_binary(docs["text"]))
        bucket, triple, pair, word = shares(t, _answers(answered, "n_train") - _answers(answered, "n_deleted"))
        cells, at = distinct(cells_of(bucket, triple, pair, word))
        sums = [np.bincount(at, minlength=len(cells)), *[np.bincount(at, weights=x, minlength=len(cells)) for x in (triple, pair, word)]]
    out = [np.append(cells, [-1, -2, -3, -4]), np.append(sums[0], sizes).astype(np.int64), *[np.append(x, [0.0] * 4) for x in sums[1:]]]
    return _table(out, SEEN)


def em(bucket: np.ndarray, n: np.ndarray, parts: np.ndarray, steps: int = STEPS) -> np.ndarray:
    """Weights of the four parts in each bucket that make n tokens of these parts likeliest."""
    weights = np.full((BUCKETS, 4), 1 / 4)
    for _ in range(steps):
        mixed = parts * weights[bucket]
        mixed *= (n / mixed.sum(axis=1))[:, None]
        new = np.stack([np.bincount(bucket, weights=mixed[:, j], minlength=BUCKETS) for j in range(4)], axis=1)
        weights = np.where(new.sum(axis=1, keepdims=True) > 0, new / np.maximum(new.sum(axis=1, keepdims=True), 1e-300), weights)
    seen = np.bincount(bucket, minlength=BUCKETS)
    for b in (b for b in range(1, BUCKETS) if b != CLASSES):  # a bucket that no deleted token has takes over its neighbour's weights
        if not seen[b]:
            weights[b] = weights[b - 1]
    weights[:, 3] = np.maximum(weights[:, 3], 1e-6)
    return weights / weights.sum(axis=1, keepdims=True)


def weigh(seen: pa.Table) -> pa.Table:
    """Mixture weights of each bucket by expectation-maximisation; after them the sizes."""
    cell, n = seen["cell"].to_numpy(), seen["n"].to_numpy().astype(np.float64)
    size = {-c: int(n[cell == c].sum()) for c in (-1, -2, -3, -4)}
    own = cell >= 0
    parts = np.stack([*[seen[c].to_numpy()[own] / n[own] for c in ("triple", "pair", "word")], np.full(int(own.sum()), 1.0 / (size[4] + 1))], axis=1)
    parts[:, 2] /= max(1, size[3])
    weights = em(cell[own] >> 30, n[own], parts)
    return pa.table({"model": pa.array([[*weights.ravel().tolist(), float(size[1]), float(size[2])]], pa.list_(pa.float64()))})


def mixture(weights: np.ndarray, bucket: np.ndarray, triple: np.ndarray, pair: np.ndarray, word: np.ndarray, total: float, distinct_words: float) -> np.ndarray:
    """Probability of each token. Weights of undefined models are shared by the others."""
    w = weights[bucket].copy()
    w[:, 0] *= bucket < CLASSES
    w[:, 1] *= bucket != CLASSES
    w[:, 2] *= total > 0
    p = w[:, 0] * triple + w[:, 1] * pair + w[:, 2] * word / max(1.0, total) + w[:, 3] / (distinct_words + 1)
    return p / w.sum(axis=1)


def score(docs: pa.Table, answered: pa.Table) -> pa.Table:
    t = Tokens(_binary(docs["text"]))
    full = _answers(answered, "n_train")
    model = np.array(answered["model"][0].as_py())
    weights, total, kinds = model[:-2].reshape(BUCKETS, 4), model[-2], model[-1]
    bucket, triple, pair, word = shares(t, full)
    p = mixture(weights, bucket, triple, pair, word, total, kinds)
    sums = segment_sums(np.stack([word > 0, np.log10((word + 1) / (total + kinds + 1)), np.log10(p)], axis=1), t.lengths)
    out = [t.lengths, np.rint(sums[:, 0]).astype(np.int64), np.full(len(t.lengths), int(total)), sums[:, 1], sums[:, 2]]
    made = [pa.array(x, k) for x, (_, k) in zip(out, SCORED, strict=True)]
    return pa.Table.from_arrays([docs["id"].combine_chunks(), docs["train"].combine_chunks(), *made], names=["id", "train", *[n for n, _ in SCORED]])


def score_texts(df: DataFrame, train: Column, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """id, train and for each row of df n_tokens, n_known, train_tokens, base_score and score (log10 of its probability).

    train tells which rows are learnt from; where it is null they aren't. A null or empty text is the end token alone. Repeated
    rows and identifiers count and are scored row by row; null identifiers are carried. Without training rows N and V are 0 and
    the model is uniform over the one unknown word. An empty table gives no rows.
    """
    spark = df.sparkSession
    bounded_batches(spark)
    ident, text = F.col(quoted(id_col)), F.col(quoted(text_col)).cast("string")
    size = df.agg(F.sum(F.octet_length(text))).first()[0] or 0
    n = shuffle_partitions(spark)
    chunks, parts = (max(n, math.ceil(size / x)) for x in (CHUNK_BYTES, OWNED_BYTES))
    learnt = F.coalesce(train, F.lit(False))
    deleted = learnt & (F.pmod(F.xxhash64(ident, text, F.lit("deleted")), F.lit(DELETED)) == 0)
    row = F.xxhash64(ident, text)
    chunk = F.when(deleted, -1 - F.pmod(row, F.lit(max(1, chunks // DELETED)))).otherwise(F.pmod(row, F.lit(chunks)))  # deleted documents have chunks of their own
    docs = df.select(ident.alias("id"), text.alias("text"), learnt.alias("train"), deleted.alias("deleted"), chunk.alias("chunk"))
    # Each of these two exchanges stands once in the plan that runs: Spark reuses it for all that reads it.
    docs = docs.repartition(n, "chunk")
    asked = docs.groupBy("chunk").applyInArrow(asking(parts), _ddl(ASKED))
    answered = asked.repartition(n, "part").groupBy("part").applyInArrow(answer, _ddl(ANSWERED)).repartition(n, "chunk")
    seen = docs.groupBy("chunk").cogroup(answered.groupBy("chunk")).applyInArrow(see, _ddl(SEEN))
    seen = seen.groupBy("cell").agg(*[F.sum(c).alias(c) for c in ("n", "triple", "pair", "word")]).withColumn("all", F.lit(1))
    model = seen.groupBy("all").applyInArrow(weigh, "model array<double>")
    known = answered.withColumn("model", model.scalar())
    made = ", ".join(f"{n} {'double' if k == pa.float64() else 'long'}" for n, k in SCORED)
    schema = f"id {dict(df.select(ident.alias('id')).dtypes)['id']}, train boolean, {made}"
    return docs.groupBy("chunk").cogroup(known.groupBy("chunk")).applyInArrow(score, schema)


#: Of seven parts of the documents by crc32 of the identifier, the one that is held out of learning.
FOLDS, HELD_OUT = 7, 2


def op4_lm_scoring(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    held_out = F.crc32(F.col("doc_id").cast("string").cast("binary")) % FOLDS == HELD_OUT
    return score_texts(docs, ~held_out).select(F.col("id").alias("doc_id"), (~F.col("train")).alias("held_out"), *MADE)
