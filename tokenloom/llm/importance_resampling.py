"""Quality by importance resampling: how much likelier a text is under the target's n-grams than under the raw corpus's.

Words and runs of signs, and pairs of them, are hashed into BINS; the target model has the shares of the bins in labelled good
documents, the raw model those in all documents. A document's log weight is the sum of the log ratios of its n-grams, and
resampling without replacement takes the k largest of log weight plus Gumbel noise (noise from a hash of the identifier).
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from .batches import bounded_batches, segment_sums
from .common import materialise, others, place_of_kth, quoted

BINS = 10_000
#: Most labelled good documents that the target model is fitted on; they are drawn by a hash of the identifier.
TARGET_DOCS = 50_000
#: Added to each bin of both models, so that no ratio is infinite.
SMOOTH = 1.0
KNOWN_WORDS = 150_000
MADE = ("log_weight", "score", "gumbel_key", "selected")
_TOKEN = re.compile(r"\w+|[^\w\s]+")
_MIX = np.uint64(0x9E3779B97F4A7C15)


class WordHashes(dict):
    def __missing__(self, word: str) -> int:
        h = xxhash.xxh64_intdigest(word.encode("utf-8", "replace"))
        if len(self) < KNOWN_WORDS:
            self[word] = h
        return h


_hashes = WordHashes()


def bins_of(texts: list[str | None], bins: int = BINS) -> tuple[np.ndarray, np.ndarray]:
    """Bins of the n-grams of all texts, and how many each text has."""
    out, sizes = [], []
    for t in texts:
        words = _TOKEN.findall((t or "").lower())
        h = np.fromiter(map(_hashes.__getitem__, words), np.uint64, len(words))
        out += [h, ((h[:-1] * _MIX) ^ (h[:-1] >> np.uint64(31))) + h[1:]] if len(h) else []
        sizes.append(max(0, 2 * len(h) - 1))
    grams = np.concatenate(out) if out else np.zeros(0, np.uint64)
    return ((grams ^ (grams >> np.uint64(32))) % np.uint64(bins)).astype(np.int64), np.array(sizes, np.int64)


def learn_ratios(df: DataFrame, target: Column, text_col: str = "text", bins: int = BINS) -> np.ndarray:
    """Log ratio of each bin's share in the rows where target holds and in all rows. Each task adds up all of its rows."""
    bounded_batches(df.sparkSession)

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums = np.zeros((2, bins))
        for b in batches:
            at, sizes = bins_of(b["text"].tolist(), bins)
            sums[0] += np.bincount(at, minlength=bins)
            sums[1] += np.bincount(at[np.repeat(b["target"].to_numpy(bool), sizes)], minlength=bins)
        some = np.flatnonzero(sums[0])
        yield pd.DataFrame({"bin": some, "n_raw": sums[0][some], "n_target": sums[1][some]})

    rows = df.select(F.col(quoted(text_col)).cast("string").alias("text"), F.coalesce(target, F.lit(False)).alias("target"))
    found = rows.mapInPandas(count, "bin int, n_raw double, n_target double").groupBy("bin").agg(F.sum("n_raw"), F.sum("n_target")).collect()
    raw, wanted = np.full(bins, SMOOTH), np.full(bins, SMOOTH)
    for b, r, t in found:
        raw[b] += r
        wanted[b] += t
    return np.log(wanted / wanted.sum()) - np.log(raw / raw.sum())


def gumbel(ident: Column, seed: str) -> Column:
    u = (F.pmod(F.xxhash64(ident, F.lit(seed)), F.lit(1 << 52)) + 0.5) / float(1 << 52)
    return -F.log(-F.log(u))


def weigh_texts(df: DataFrame, ratios: np.ndarray, text_col: str = "text") -> DataFrame:
    """df with log_weight; 0 for a null text or one without words."""
    bounded_batches(df.sparkSession)
    shared = df.sparkSession.sparkContext.broadcast(ratios)

    @F.pandas_udf("double")
    def weigh(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            at, sizes = bins_of(texts.tolist(), len(shared.value))
            yield pd.Series(segment_sums(shared.value[at], sizes))

    return df.select(*others(df, "log_weight"), weigh(F.col(quoted(text_col)).cast("string")).alias("log_weight"))


def resample(weighed: DataFrame, share: float, id_col: str = "doc_id", seed: str = "gumbel") -> DataFrame:
    """weighed with score (0 to 1: the odds that its log_weight gives), gumbel_key and selected (in the top share by key).

    A text without words has weight 0 and so score 0.5. Rows of one identifier have the same noise; of equal keys the smaller
    identifier goes first, and rows equal in both are selected together. An empty table stays empty. Input columns named as a
    made column are replaced; all others are carried along, and written once on the way: leave texts out that aren't needed.
    """
    ident = F.col(quoted(id_col))
    out = weighed.select(*others(weighed, *MADE), "log_weight")
    out = out.withColumns({"score": 1 / (1 + F.exp(-F.greatest(F.least("log_weight", F.lit(500.0)), F.lit(-500.0)))), "gumbel_key": F.col("log_weight") + gumbel(ident, seed)})
    out = materialise(out)
    n = out.count()
    k = round(n * share)
    last = place_of_kth(out.select("gumbel_key", ident), "gumbel_key", id_col, k)
    if last is None:
        return out.withColumn("selected", F.lit(k >= n and n > 0))
    key = F.col("gumbel_key")
    first = F.lit(True) if last[1] is None else F.coalesce(ident <= F.lit(last[1]), F.lit(False))  # null identifiers come last
    return out.withColumn("selected", (key > last[0]) | ((key == last[0]) & first))


def op10_importance_resampling(spark, sf_dir):
    """Target: documents labelled quality 1, at most TARGET_DOCS. The share selected is that of quality 1 among labelled documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    n, good = labels.where("quality IS NOT NULL").agg(F.count(F.lit(1)), F.count(F.when(F.col("quality") == 1, 1))).first()
    drawn = F.pmod(F.xxhash64("doc_id", F.lit("target")), F.lit(1 << 30)) < int(min(1.0, TARGET_DOCS / max(1, good)) * (1 << 30)) + 1
    target = labels.where((F.col("quality") == 1) & drawn).select("doc_id").distinct().orderBy(F.xxhash64("doc_id", F.lit("target")), "doc_id").limit(TARGET_DOCS).withColumn("__good", F.lit(True))
    ratios = learn_ratios(docs.join(F.broadcast(target), "doc_id", "left"), F.col("__good"))
    weighed = weigh_texts(docs, ratios).select("doc_id", "log_weight")
    return resample(weighed, good / n if n else 1.0).select("doc_id", *MADE)
