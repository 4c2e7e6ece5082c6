"""Language ID by prediction by partial matching.

Each language has a tree of byte contexts of up to ORDER bytes with the counts of what follows, learnt from a bounded sample of
labelled rows and then frozen. A byte costs -log2 of its share c / (T + q) in the longest context that has it, after escapes of
q / (T + q) from the longer ones (T: all that followed the context, q: how many different bytes). The language with the
shortest exact code for the whole text is predicted; the score is its share of 2 ** -code among all languages.

As the statistics are frozen, the cost of a byte depends on its last ORDER bytes only, so costs of all strings seen in any
language are tabulated for all languages side by side, and a text is scored by looking its strings up.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame, functions as F

from .batches import bounded_batches, segment_sums
from .common import others, quoted, small_table

ORDER = 4
#: Most bytes of sample learnt from for each language, for all languages together, and of one piece of a document in it.
SAMPLE_BYTES, ALL_SAMPLE_BYTES, SAMPLE_DOC_BYTES = 2_000_000, 256_000_000, 200_000
#: Pieces are drawn by a hash of so many values; so much more is drawn than is learnt from, as pieces differ in length.
PLACES, SPARE = 1 << 30, 1.25
#: Bytes scored at once, and those of them whose strings are looked up at once: what a look-up needs on the way takes several times its result.
WINDOW, PIECE = 1 << 18, 1 << 14
MADE = ("lang_pred", "score", "bits_per_byte")
UNKNOWN = "und"
#: Before its first byte a text stands in this context.
START = b"\n" * ORDER
_LETTER = regex.compile(r"\p{L}")
_MIX = np.uint64(0x9E3779B97F4A7C15)


class Lookup:
    """Rows of a table by 64-bit key: open addressing in numpy arrays."""

    def __init__(self, keys: np.ndarray):
        self.bits = max(4, int(np.ceil(np.log2(max(1, len(keys)) * 2.5))))
        self.keys, self.rows = np.zeros(1 << self.bits, np.uint64), np.full(1 << self.bits, -1, np.int32)
        left, at = np.arange(len(keys), dtype=np.int32), self.slots(keys)
        while len(left):
            free = self.rows[at] < 0
            self.rows[at[free]] = left[free]  # of those that want one slot, the last gets it
            self.keys[at[free]] = keys[left[free]]
            wait = self.rows[at] != left
            left, at = left[wait], (at[wait] + 1) & ((1 << self.bits) - 1)

    def slots(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * _MIX) >> np.uint64(64 - self.bits)).astype(np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Row of each key, -1 where there is none."""
        at = self.slots(keys)
        out = self.rows[at]
        open_ = np.flatnonzero((out >= 0) & (self.keys[at] != keys))
        while len(open_):
            at_open = (at[open_] + 1) & ((1 << self.bits) - 1)
            at[open_] = at_open
            out[open_] = self.rows[at_open]
            open_ = open_[(out[open_] >= 0) & (self.keys[at_open] != keys[open_])]
        return out


def strings(stream: np.ndarray, n: int) -> np.ndarray:
    """The last n bytes at each position from n - 1 on, as one number."""
    code = np.zeros(len(stream) - n + 1, np.uint64)
    for i in range(n):
        code = (code << np.uint64(8)) | stream[i : len(stream) - n + 1 + i]
    return code


class ContextTrees:
    """Frozen statistics of all languages: for each order, the costs of the strings that end in a byte, and those of escapes."""

    def __init__(self, samples: dict[str, list[bytes]], order: int = ORDER):
        self.languages, self.order = sorted(samples), order
        n_lang = len(self.languages)
        streams = [np.frombuffer(b"".join(START[:order] + t for t in samples[x]), np.uint8) for x in self.languages]
        self.costs: list[np.ndarray] = []
        self.escapes: list[np.ndarray] = []  # of contexts of d bytes, by row of the strings of d bytes
        self.tables: list[Lookup] = []
        below = np.full((1, n_lang), 8.0)
        for d in range(order + 1):  # d bytes of context
            mask = np.uint64((1 << (8 * d)) - 1)
            counted = [np.unique(strings(s, d + 1), return_counts=True) if len(s) > d else (np.zeros(0, np.uint64), np.zeros(0, np.int64)) for s in streams]
            keys = np.unique(np.concatenate([k for k, _ in counted])) if n_lang else np.zeros(0, np.uint64)
            if d:
                parent = self.tables[d - 1].find(keys & mask)
                context = self.tables[d - 1].find(keys >> np.uint64(8))
                base, n_contexts = self.costs[d - 1][parent], len(self.costs[d - 1])
            else:
                context, base, n_contexts = np.zeros(len(keys), np.int32), np.repeat(below, len(keys), axis=0), 1
            costs, escapes = np.empty((len(keys), n_lang)), np.zeros((n_contexts, n_lang))
            for j, (k, c) in enumerate(counted):
                at = np.searchsorted(keys, k)
                total = np.bincount(context[at], weights=c, minlength=n_contexts)
                kinds = np.bincount(context[at], minlength=n_contexts)
                seen = total > 0
                escapes[seen, j] = -np.log2(kinds[seen] / (total[seen] + kinds[seen]))
                costs[:, j] = base[:, j] + escapes[context, j]
                costs[at, j] = -np.log2(c / (total[context[at]] + kinds[context[at]]))
            self.costs.append(costs)
            self.escapes.append(escapes)
            self.tables.append(Lookup(keys))

    def cost(self, stream: np.ndarray) -> np.ndarray:
        """Code lengths in bits of the bytes of stream after its first ORDER ones: a row a byte, a column a language."""
        out = np.empty((len(stream) - self.order, len(self.languages)))
        for at in range(0, len(out), PIECE):
            out[at : at + PIECE] = self._cost(stream[at : at + PIECE + self.order])
        return out

    def _cost(self, stream: np.ndarray) -> np.ndarray:
        code = strings(stream, self.order + 1)
        out = np.zeros((len(code), len(self.languages)))
        left: np.ndarray | slice = slice(None)
        for d in range(self.order, -1, -1):
            row = self.tables[d].find(code)
            hit = row >= 0
            if d == self.order and hit.all():
                return self.costs[d][row]
            at = np.arange(len(code)) if isinstance(left, slice) else left
            out[at[hit]] += self.costs[d][row[hit]]
            left, code = at[~hit], code[~hit]
            if not len(left):
                return out
            if d:
                context = self.tables[d - 1].find(code >> np.uint64(8))
                known = context >= 0
                out[left[known]] += self.escapes[d][context[known]]
                code = code & np.uint64((1 << (8 * d)) - 1)
            else:
                out[left] += self.escapes[0][0] + 8.0
        return out

    def bits(self, texts: list[bytes]) -> np.ndarray:
        """Code length of each text in each language. A text longer than a window is scored window by window."""
        out = np.zeros((len(texts), len(self.languages)))
        start = START[: self.order]
        pending: list[int] = []
        size = 0

        def flush() -> None:
            nonlocal pending, size
            if pending:
                stream = np.frombuffer(b"".join(start + texts[i] for i in pending) + b"", np.uint8)
                cost = self.cost(np.concatenate([np.zeros(self.order, np.uint8), stream]))
                runs = np.array([n for i in pending for n in (self.order, len(texts[i]))])
                out[pending] = segment_sums(cost, runs)[1::2]
                pending, size = [], 0

        for i, t in enumerate(texts):
            if len(t) > WINDOW:
                whole = np.frombuffer(start + t, np.uint8)
                for at in range(0, len(t), WINDOW):
                    out[i] += self.cost(whole[at : at + WINDOW + self.order]).sum(axis=0, dtype=np.float64)
                continue
            pending.append(i)
            size += len(t) + self.order
            if size > WINDOW:
                flush()
        flush()
        return out

    def predict(self, texts: list[str | None]) -> pd.DataFrame:
        raw = [(t or "").encode("utf-8", "replace") for t in texts]
        size = np.array([len(t) for t in raw], np.float64)
        lang, score, rate = np.full(len(raw), UNKNOWN, object), np.zeros(len(raw)), np.zeros(len(raw))
        letters = np.array([bool(t) and _LETTER.search(t) is not None for t in texts], bool)
        if self.languages and letters.any():
            at = np.flatnonzero(letters)
            bits = self.bits([raw[i] for i in at])
            best = bits.argmin(axis=1)
            least = bits.min(axis=1)
            lang[at] = np.array(self.languages, object)[best]
            score[at] = 1 / np.exp2(np.maximum(least[:, None] - bits, -1000)).sum(axis=1)
            rate[at] = least / size[at]
        return pd.DataFrame({"lang_pred": lang, "score": score, "bits_per_byte": rate})


def draw_samples(train: DataFrame, text_col: str, lang_col: str, id_col: str, sample_bytes: int) -> dict[str, list[bytes]]:
    """Of each non-null language, at most sample_bytes of its texts, in the order of a hash of identifier, text and piece.

    Texts of up to SAMPLE_DOC_BYTES are taken whole; longer ones are cut into pieces of so many bytes, each drawn by itself. Rows equal in
    identifier and text count once. Two passes over the rows, however many languages there are: one adds up their bytes, one draws.
    """
    text, lang = F.col(quoted(text_col)), F.col(quoted(lang_col)).cast("string")
    rows = train.where(lang.isNotNull() & text.isNotNull() & (F.octet_length(text) > 0)).select(lang.alias("lang"), F.xxhash64(F.col(quoted(id_col)), text).alias("row"), text.cast("binary").alias("b"))
    sizes = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.sum(F.octet_length("b")).alias("n")).collect()}
    if not sizes:
        return {}
    most = min(sample_bytes, ALL_SAMPLE_BYTES // len(sizes))
    limits = small_table(train.sparkSession, lang=[*sizes], limit=[int(min(1.0, SPARE * most / n) * PLACES) for n in sizes.values()])
    place = lambda n: F.pmod(F.xxhash64("row", n), F.lit(PLACES))
    numbers = F.sequence(F.lit(0), F.ceil(F.octet_length("b") / SAMPLE_DOC_BYTES).cast("int") - 1)
    pieces = rows.join(F.broadcast(limits), "lang").select("lang", "row", "b", F.explode(F.filter(numbers, lambda n: place(n) < F.col("limit"))).alias("n"))
    pieces = pieces.select("lang", place(F.col("n")).alias("place"), "row", "n", F.substring("b", F.col("n") * SAMPLE_DOC_BYTES + 1, F.lit(SAMPLE_DOC_BYTES)).alias("t"))
    drawn: dict[str, list[tuple]] = {}
    for x, *key, t in pieces.dropDuplicates(["lang", "row", "n"]).toLocalIterator():
        drawn.setdefault(x, []).append((*key, bytes(t)))
    samples: dict[str, list[bytes]] = {}
    for x, found in drawn.items():
        left = most
        for *_, t in sorted(found):
            if (left := left - len(t)) < 0:
                break
            samples.setdefault(x, []).append(t)
    return samples


def learn(train: DataFrame, text_col: str = "text", lang_col: str = "lang", id_col: str = "doc_id", sample_bytes: int = SAMPLE_BYTES, order: int = ORDER) -> ContextTrees:
    """Trees from at most sample_bytes of texts for each non-null language, and ALL_SAMPLE_BYTES for all, drawn by a hash."""
    return ContextTrees(draw_samples(train, text_col, lang_col, id_col, sample_bytes), order)


def identify_language(df: DataFrame, trees: ContextTrees, text_col: str = "text") -> DataFrame:
    """df with lang_pred, score (0 to 1) and bits_per_byte, the code length under the predicted language.

    A text that is null or has no letter, and any text where nothing was learnt, is `und` with score 0 and 0 bits. The prediction
    depends on the text alone: repeated rows get the same. Input columns named as a made column are replaced; all others are
    carried along.
    """
    spark = df.sparkSession
    bounded_batches(spark)
    shared = spark.sparkContext.broadcast(trees)

    @F.pandas_udf("lang_pred string, score double, bits_per_byte double")
    def predict(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            yield shared.value.predict(texts.tolist())

    out = df.select(*others(df, *MADE), predict(F.col(quoted(text_col)).cast("string")).alias("__made"))
    return out.select(*others(df, *MADE), *[F.col("__made")[c].alias(c) for c in MADE])


#: Of four parts of the documents by crc32 of the identifier, the one that is held out of learning.
FOLDS, HELD_OUT = 4, 2


def held_out():
    """Whether a document is held out of learning; one without identifier is."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % FOLDS == HELD_OUT, F.lit(True))


def op2_language_id(spark, sf_dir):
    """Documents without identifier are held out: they aren't learnt from."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    trees = learn(docs.where(~held_out()).select("doc_id", "text", "lang"))
    return identify_language(docs.select("doc_id", "text"), trees).select("doc_id", held_out().alias("held_out"), *MADE)
