"""N-gram Jaccard self-join by a MinHash LSH forest with exact verification.

Copies of one text are one node. A node's signature is TREES sequences of MAX_DEPTH MinHash values over its five-word shingles;
each tree is the trie of its sequences, kept as the keys of their prefixes. A node's matched prefix starts at MAX_DEPTH values
and is shortened, value by value, until the chance to meet a linked text in one of the trees reaches RECALL at the least
similarity that the sizes of the two sets allow (a text of three shingles can only link with an equal set, one of seven at 6/7 or
more, a long one at the threshold itself). Nodes that agree on a prefix so shortened are a subtrie, and every pair of a subtrie
is verified on whole shingle sets; classes are the closure of verified links only.

Pairs are verified in groups. Subtries with the same members count once. Nodes that subtries join into a component of at most
BLOCK are one group. A larger component is either one group or as many groups as it has subtries, whichever ships fewer texts,
so that subtries that meet by chance don't multiply each other; a pair that is in several subtries counts in the smallest. A group of more than
BLOCK is cut into blocks, and every pair of blocks is a tile of its own; tiles are dealt by range, so that none meet in one task by
chance. A tile gives back counts of links and a tie to the smallest node it is linked with, never its pairs.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import cache

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from .batches import bounded_batches, groups
from .common import LOWER, UPPER, broadcast_if_small, materialise, quoted
from .components import components

SHINGLE, THRESHOLD = 5, 0.8
TREES, MAX_DEPTH, RECALL = 24, 8, 0.9999
BLOCK = 256
#: A pair with a set of so many shingles or more meets at the length that the threshold itself asks for, as its least similarity is next to it.
SETTLED = 128
#: Shingles hashed at once, most words whose hash is remembered, most candidate nodes that are broadcast to the scan of their texts.
SLAB, KNOWN_WORDS, BROADCAST_NODES = 1 << 15, 150_000, 500_000
#: A shingle that at most so many texts of a group have is counted pair by pair, others by a product of matrices.
RARE = 24
MADE = ("class_id", "copies", "n_links")
_TO_WORDS = bytes(c if c >= 0x80 or chr(c).isalnum() else 0x20 for c in range(256)).translate(bytes.maketrans(UPPER.encode(), LOWER.encode()))
_MIX = np.uint64(0x9E3779B97F4A7C15)


class WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        h = xxhash.xxh64_intdigest(word)
        if len(self) < KNOWN_WORDS:
            self[word] = h
        return h


_hashes = WordHashes()


def shingles(text: bytes | None) -> np.ndarray:
    """Distinct hashes of all runs of five words, in order of size; a shorter text is one run, one without words has none."""
    words = (text or b"").translate(_TO_WORDS).split()
    h = np.fromiter(map(_hashes.__getitem__, words), np.uint64, len(words))
    n = min(SHINGLE, len(h))
    if not n:
        return h
    out = np.zeros(len(h) - n + 1, np.uint64)
    for i in range(n):
        out = (out ^ (out >> np.uint64(31))) * _MIX + h[i : len(h) - n + 1 + i]
    out.sort()
    return out[np.flatnonzero(np.concatenate([[True], out[1:] != out[:-1]]))]


def least_similarity(n: int, m: int, threshold: float = THRESHOLD) -> float | None:
    """The least similarity at or over the threshold that sets of n and m elements can have; None if they can't reach it."""
    n, m = min(n, m), max(n, m)
    shared = max(1, math.ceil(threshold * (n + m) / (1 + threshold) - 1e-9))
    return shared / (n + m - shared) if shared <= n else None


@cache
def depth(similarity: float = THRESHOLD, trees: int = TREES, recall: float = RECALL) -> int:
    """A prefix of MAX_DEPTH values shortened until two texts of that similarity match in one of the trees with the wanted probability."""
    d = MAX_DEPTH
    while d > 1 and 1 - (1 - similarity**d) ** trees < recall:
        d -= 1
    return d


class Forest:
    """The hash functions of all trees, and the depths at which a set of a size is entered."""

    def __init__(self, trees: int = TREES, threshold: float = THRESHOLD, recall: float = RECALL):
        self.trees, self.threshold, self.recall = trees, threshold, recall
        draw = np.random.default_rng(20240229)
        self.a = draw.integers(1 << 62, size=(trees, MAX_DEPTH), dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        self.b = draw.integers(1 << 62, size=(trees, MAX_DEPTH), dtype=np.uint64)
        self._depths: dict[int, tuple[int, ...]] = {}

    def length(self, n: int, m: int) -> int | None:
        """Length of the prefix at which sets of n and m elements meet; None if no such two can link."""
        if max(n, m) >= SETTLED:
            return depth(self.threshold, self.trees, self.recall)
        least = least_similarity(n, m, self.threshold)
        return None if least is None else depth(least, self.trees, self.recall)

    def depths(self, n: int) -> tuple[int, ...]:
        """Lengths of the prefixes that a set of n elements is entered by, one for each of its possible partners' sizes: one in all for most sizes."""
        n = min(n, SETTLED)
        if n not in self._depths:
            partners = range(max(1, math.ceil(n * self.threshold - 1e-9)), max(SETTLED + 1 if n == SETTLED else 1, math.floor(n / self.threshold + 1e-9) + 1))
            self._depths[n] = tuple(sorted({d for m in partners if (d := self.length(n, m)) is not None}))
        return self._depths[n]

    def prefixes(self, sets: list[np.ndarray]) -> list[np.ndarray]:
        """For each set, the keys of its prefixes in each tree (with tree and length in them); none for an empty set."""
        out: list[np.ndarray] = [np.zeros(0, np.int64)] * len(sets)
        kinds: dict[tuple[int, ...], list[int]] = {}
        for i, s in enumerate(sets):
            if len(s):
                kinds.setdefault(self.depths(len(s)), []).append(i)
        for depths, own in kinds.items():
            for start, end in groups([sets[i] for i in own], SLAB):
                here = own[start:end]
                values = np.concatenate([sets[i] for i in here])
                starts = np.cumsum([0, *[len(sets[i]) for i in here[:-1]]])
                keys = np.zeros((len(here), len(depths), self.trees), np.uint64)
                for t in range(self.trees):
                    key = np.full(len(here), t + 1, np.uint64)
                    for d in range(depths[-1]):
                        mixed = values * self.a[t, d]
                        mixed += self.b[t, d]
                        mixed >>= np.uint64(24)
                        key = (key ^ (key >> np.uint64(29))) * _MIX + np.minimum.reduceat(mixed, starts)
                        if d + 1 in depths:
                            keys[:, depths.index(d + 1), t] = key + np.uint64(d)
                for row, i in enumerate(here):
                    out[i] = keys[row].view(np.int64).ravel()
        return out


def common_counts(sets: list[np.ndarray]) -> np.ndarray:
    """How many elements each two of the sets share, exactly."""
    n = len(sets)
    doc = np.repeat(np.arange(n), [len(s) for s in sets])
    value = np.concatenate(sets) if n else np.zeros(0, np.uint64)
    order = np.argsort(value, kind="stable")
    value, doc = value[order], doc[order]
    first = np.flatnonzero(np.concatenate([[True], value[1:] != value[:-1]])) if len(value) else np.zeros(0, np.int64)
    often = np.diff(np.append(first, len(value)))
    out = np.zeros(n * n, np.int64)
    for k in range(2, min(RARE, n) + 1):
        at = first[often == k]
        if len(at):
            held = doc[at[:, None] + np.arange(k)]
            for i in range(k - 1):
                for j in range(i + 1, k):
                    out += np.bincount(held[:, i] * n + held[:, j], minlength=n * n)
    out = out.reshape(n, n)
    wide = np.flatnonzero(often > RARE)
    for at in range(0, len(wide), 2048):
        some = wide[at : at + 2048]
        x = np.zeros((n, len(some)), np.float32)
        for column, w in enumerate(some):
            x[doc[first[w] : first[w] + often[w]], column] = 1
        out += np.triu(np.rint(x @ x.T).astype(np.int64), 1)
    return out


CHECKED = "node long, root long, n_links long, whole boolean"


def met_before(own: list, key: int) -> np.ndarray:
    """Whether each two of the nodes, whose subtries are own, are together in one with a smaller key than this."""
    n = len(own)
    node = np.repeat(np.arange(n), [len(x) for x in own])
    at = np.concatenate([np.asarray(x, np.int64) for x in own]) if n else np.zeros(0, np.int64)
    node, at = node[at < key], at[at < key]
    order = np.argsort(at, kind="stable")
    node, at = node[order], at[order]
    first = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]])) if len(at) else np.zeros(0, np.int64)
    often = np.diff(np.append(first, len(at)))
    out = np.zeros((n, n), bool)
    for f, k in zip(first[often > 1], often[often > 1], strict=True):
        out[np.ix_(node[f : f + k], node[f : f + k])] = True
    return out


def checking(threshold: float):
    def check(tile: pa.Table) -> pa.Table:
        """Links within a tile: of each node their number, and the smallest node that it hangs together with here.

        In a tile of two blocks only pairs across them count; those inside a block are the block's own tile's. Pairs that are together in a
        subtrie with a smaller key count there.
        """
        node = np.array(tile["node"].to_pylist(), np.int64)
        order = np.argsort(node)
        node = node[order]
        texts, own = tile["text"].cast(pa.binary()).to_pylist(), tile["own"].to_pylist()
        block = np.array(tile["block"].to_pylist())[order]
        sets = [shingles(texts[i]) for i in order]
        size = np.array([len(s) for s in sets])
        shared = common_counts(sets)
        linked = (shared > 0) & (shared >= threshold * (size[:, None] + size[None, :] - shared) - 1e-9)
        if tile["left"][0].as_py() != tile["right"][0].as_py():
            linked &= block[:, None] != block[None, :]
        if linked.any() and any(own):
            linked &= ~met_before([own[i] for i in order], tile["key"][0].as_py())
        links = linked.sum(axis=0) + linked.sum(axis=1)
        root = np.arange(len(node))
        a, b = np.nonzero(linked)
        while True:  # the smallest index along links; few rounds, as roots are followed too
            low = np.minimum(root[a], root[b])
            new = root.copy()
            np.minimum.at(new, a, low)
            np.minimum.at(new, b, low)
            new = new[new]
            if (new == root).all():
                break
            root = new
        return pa.table({"node": node, "root": node[root], "n_links": links.astype(np.int64), "whole": pa.array([tile["whole"][0].as_py()] * len(node), pa.bool_())})

    return check


def similar_classes(df: DataFrame, text_col: str = "text", id_col: str = "doc_id", threshold: float = THRESHOLD) -> DataFrame:
    """A row for each row of df: its identifier, class_id, copies and n_links. Identifiers may be of any type that has an order.

    class_id is the smallest identifier among all texts that chains of links (Jaccard similarity of the sets of five-word shingles
    at or over the threshold) or equality join with the row's text; copies counts the rows with exactly this text, n_links the
    different texts linked with it. Words are lower-cased (A-Z) runs of letters, digits and non-ASCII characters. A text of one to
    four words is a single shingle; one without words (or null) links with nothing, but its copies are one class. Rows without
    identifier get the class of their text like others; class_id is null only where no text of the class has an identifier. Texts are
    the nodes, so identifiers may repeat. An empty table gives none.
    """
    keyed, texts, linked = _linked(df, text_col, id_col, threshold)
    classes = texts.join(linked, "node", "left").select("h1", "h2", "copies", F.when(F.col("best").isNull(), F.col("low")).otherwise(F.col("best.low")).alias("class_id"), F.coalesce("n_links", F.lit(0)).alias("n_links"))
    return keyed.join(classes, ["h1", "h2"]).select(F.col("id").alias(id_col), *MADE)


def _linked(df: DataFrame, text_col: str, id_col: str, threshold: float) -> tuple[DataFrame, DataFrame, DataFrame]:
    """id, h1, h2 of the rows; node, h1, h2, low (smallest identifier), copies, lows (rows with it) of the texts; node, n_links, best of those
    compared with others, where best is the text of the class with the smallest identifier, as a struct with low, h1 and h2."""
    spark = df.sparkSession
    bounded_batches(spark)
    forest = spark.sparkContext.broadcast(Forest(threshold=threshold))

    @F.pandas_udf("array<long>")
    def sign(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series(forest.value.prefixes([shingles(None if t is None else t.encode("utf-8", "replace")) for t in texts]))

    rows = df.select(F.col(quoted(id_col)).alias("id"), F.coalesce(F.col(quoted(text_col)).cast("string"), F.lit("")).alias("text"))
    keyed = rows.withColumns({"h1": F.xxhash64("text"), "h2": F.xxhash64("text", F.lit("2"))})
    signed = materialise(keyed.withColumn("prefixes", sign("text")).select("id", "h1", "h2", "prefixes"))
    texts = signed.groupBy("h1", "h2").agg(F.min("id").alias("low"), F.count(F.lit(1)).alias("copies"))
    texts = materialise(texts.withColumn("node", F.monotonically_increasing_id()))
    nodes = signed.join(texts, ["h1", "h2"]).where("id <=> low").select("node", F.explode("prefixes").alias("key")).distinct()
    nodes = materialise(nodes)
    subtries = nodes.groupBy("key").agg(F.min("node").alias("low"), F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("node")).alias("who")).where("n > 1")
    subtries = subtries.groupBy("low", "n", "who").agg(F.min("key").alias("key"))  # those with the same members count once
    subtries = materialise(subtries)  # so that the join's sides are plain exchanges, and Spark can split the nodes of a large subtrie
    met = nodes.join(subtries, "key")
    candidates = components(met.where("node <> low").select(F.col("node").alias("a"), F.col("low").alias("b")))
    shipped = lambda n: n * F.ceil(n / BLOCK)  # noqa: E731  texts that go into the tiles of a group of n
    cost = subtries.join(candidates.withColumnRenamed("node", "low"), "low").groupBy("root").agg(F.sum(shipped(F.col("n"))).alias("parted"))
    sizes = candidates.groupBy("root").agg(F.count(F.lit(1)).alias("n")).join(cost, "root")
    sizes = sizes.select("root", "n", ((F.col("n") > BLOCK) & (F.col("parted") < shipped(F.col("n")))).alias("parted"))
    sizes = materialise(sizes)  # so that nodes aren't dealt by component, where one may have a third of them
    held = candidates.join(broadcast_if_small(sizes, sizes.count(), BROADCAST_NODES), "root")
    place = F.struct(F.col("root").alias("key"), F.ceil(F.col("n") / BLOCK).cast("int").alias("blocks"))
    whole = held.where("NOT parted").select("node", F.array(place).alias("places"), F.lit(None).cast("array<long>").alias("own"), (F.col("n") <= BLOCK).alias("whole"))
    place = F.struct("key", F.ceil(F.col("n") / BLOCK).cast("int").alias("blocks"))
    parted = met.select("node", "key", "n").join(held.where("parted").select("node"), "node").groupBy("node").agg(F.collect_list(place).alias("places"))
    held = whole.unionAll(parted.select("node", "places", F.col("places.key").alias("own"), F.lit(False).alias("whole")))
    held = materialise(held.join(texts.select("node", "low", "h1", "h2"), "node"))
    found = keyed.join(broadcast_if_small(held, held.count(), BROADCAST_NODES), ["h1", "h2"]).where("id <=> low").dropDuplicates(["node"])
    found = found.select("node", "text", "own", "whole", F.explode("places").alias("place")).select("*", "place.key", "place.blocks")
    found = found.withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    pairs = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda j: F.struct(F.least(j, F.col("block")).alias("left"), F.greatest(j, F.col("block")).alias("right")))
    tiles = found.select("key", "node", "block", "text", "own", "whole", F.explode(pairs).alias("tile")).select("*", "tile.left", "tile.right").drop("tile")
    tiles = tiles.repartitionByRange("key", "left", "right")
    checked = materialise(tiles.groupBy("key", "left", "right").applyInArrow(checking(threshold), CHECKED))
    whole = checked.where("whole").select("node", "root", "n_links")
    ties = checked.where("NOT whole")
    joined = components(ties.select(F.col("node").alias("a"), F.col("root").alias("b"))).select("node", "root")
    links = ties.groupBy("node").agg(F.sum("n_links").alias("n_links"))
    whole = whole.union(links.join(joined, "node", "left").select("node", F.coalesce("root", "node").alias("root"), "n_links"))
    whole = materialise(whole.join(texts.select("node", "low", "h1", "h2"), "node"))
    best = materialise(whole.groupBy("root").agg(F.min(F.struct(F.col("low").isNull().alias("none"), "low", "h1", "h2")).alias("best")))
    best = broadcast_if_small(best, best.count(), BROADCAST_NODES)
    return signed.select("id", "h1", "h2"), texts, whole.select("node", "root", "n_links").join(best, "root").select("node", "n_links", "best")


def drop_near_duplicates(df: DataFrame, text_col: str = "text", id_col: str = "doc_id", threshold: float = THRESHOLD) -> DataFrame:
    """df with one document of each class, the one with the smallest identifier (null ones last, then by a hash of the text), and all columns.

    Documents are told apart by their text, so identifiers may be null or repeated; of rows equal in text and identifier one stays.
    """
    _, texts, linked = _linked(df, text_col, id_col, threshold)
    wins = F.col("best").isNull() | (F.col("best.h1") == F.col("h1")) & (F.col("best.h2") == F.col("h2"))
    judged = texts.join(linked, "node", "left").select(F.col("h1").alias("__h1"), F.col("h2").alias("__h2"), "copies", F.col("low").alias("__low"), wins.alias("__wins")).where("NOT __wins OR copies > 1")
    judged = materialise(judged.drop("copies"))
    text, key = F.coalesce(F.col(quoted(text_col)).cast("string"), F.lit("")), ("__a", "__b")
    rows = df.withColumns({"__a": F.xxhash64(text), "__b": F.xxhash64(text, F.lit("2"))})
    rows = rows.join(broadcast_if_small(judged, judged.count(), BROADCAST_NODES), (F.col("__a") == F.col("__h1")) & (F.col("__b") == F.col("__h2")), "left")
    rows = rows.where(F.col("__wins").isNull() | F.col("__wins") & F.col(quoted(id_col)).eqNullSafe(F.col("__low")))
    several = F.col("__wins").isNotNull()
    if not judged.where("__wins").isEmpty():  # copies: of those with the smallest identifier one stays
        rows = rows.where(~several).unionAll(rows.where(several).dropDuplicates(key))
    return rows.select(*[quoted(c) for c in df.columns])


def op7_jaccard_join(spark, sf_dir):
    return similar_classes(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))


#: All pairs that share a shingle, and the closure of the links: for small tables.
OP7_SQL = r"""
WITH RECURSIVE t AS (SELECT coalesce(text, '') AS text, min(doc_id) AS node, count(*) AS copies FROM documents GROUP BY ALL),
w AS (SELECT node, list_filter(regexp_split_to_array(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM t),
s AS (SELECT DISTINCT node, unnest(CASE WHEN len(w) >= 5 THEN list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS sh FROM w),
n AS (SELECT node, count(*) AS n FROM s GROUP BY node),
p AS (SELECT a.node AS a, b.node AS b, count(*) AS k FROM s a JOIN s b ON a.sh = b.sh AND a.node < b.node GROUP BY ALL),
l AS (SELECT a, b FROM p JOIN n x ON x.node = a JOIN n y ON y.node = b WHERE k >= 0.8 * (x.n + y.n - k) - 1e-9),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r AS (SELECT node, node AS root FROM t UNION SELECT e.b, r.root FROM r JOIN e ON e.a = r.node),
c AS (SELECT node, min(root) AS class_id FROM r GROUP BY node),
k AS (SELECT a AS node, count(*) AS n_links FROM e GROUP BY a)
SELECT d.doc_id, c.class_id, t.copies, coalesce(k.n_links, 0) AS n_links
FROM documents d JOIN t ON t.text = coalesce(d.text, '') JOIN c ON c.node = t.node LEFT JOIN k ON k.node = t.node
"""
