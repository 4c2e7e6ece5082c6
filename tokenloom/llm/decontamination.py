"""Benchmark decontamination by size-partitioned MinHash containment search, in DataFrame operations only.

Test items are short and documents long, so the Jaccard similarity of the two says little, and a document's own signature would
have to hold most of its shingles. The search therefore sketches the short side: items are put into size classes (powers of
two of their number of shingles), and an item keeps k values of one hash over its shingles, those that the fewest items have and of these the smallest, with k set by the
class so that an item of which the wanted share is in a document cannot miss with more than k - MATCHES of them (a share of t leaves out at
most (1 - t) * m shingles, whichever they are). Lines that many items share are so sketched last, and a pair needs MATCHES common values,
so a template of items and documents doesn't pair them all. Documents are probed with the hashes of all their shingles, and every pair found is
verified by the exact share of the item's distinct shingles, as words, that the document has.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .common import broadcast_if_small, let, materialise, quoted, text_of, words_of

SHINGLE = 5
CONTAINMENT = 0.8
#: Common sketch values that a pair needs (all, if the item has fewer shingles that a document may lack).
MATCHES = 3
#: Most rows of a sketch, of items or of candidate pairs that are broadcast; above that the joins shuffle.
BROADCAST_SKETCH, BROADCAST_ITEMS, BROADCAST_PAIRS = 1_000_000, 20_000, 500_000


def _runs(words: Column, n: int, make, kind: str) -> Column:
    """Distinct make(n words) over all runs of n words; none for a shorter text."""
    runs = lambda w: F.transform(F.sequence(F.lit(1), F.size(w) - (n - 1)), lambda i: make(*[F.element_at(w, i + j) for j in range(n)]))
    return let(words, lambda w: F.when(F.size(w) >= n, F.array_distinct(runs(w))).otherwise(F.array().cast(f"array<{kind}>")))


def shingle_hashes(words: Column, n: int = SHINGLE) -> Column:
    return _runs(words, n, F.xxhash64, "bigint")


def shingles(words: Column, n: int = SHINGLE) -> Column:
    return _runs(words, n, lambda *w: F.concat_ws(" ", *w), "string")


def item_sketches(items: DataFrame, containment: float = CONTAINMENT) -> DataFrame:
    """__item, __hash, __need: of each item of items (__item, __hashes) the k hashes of its sketch, and how many of them a document with the item has at least."""
    every = items.select("__item", F.size("__hashes").alias("__size"), F.explode("__hashes").alias("__hash"))
    often = every.groupBy("__hash").agg(F.count(F.lit(1)).alias("__often"))
    limit = F.pow(F.lit(2), F.ceil(F.log2("__size")))  # the class's upper bound
    lacking = F.floor(limit * (1 - containment) + 1e-9).cast("int")
    k = F.least(F.col("__size"), lacking + MATCHES)
    missed = F.least(lacking, F.floor(F.col("__size") * (1 - containment) + 1e-9).cast("int"))
    own = every.join(often, "__hash").groupBy("__item", "__size").agg(F.array_sort(F.collect_list(F.struct("__often", "__hash"))).alias("__all"))
    return own.select("__item", (k - missed).alias("__need"), F.explode(F.slice("__all", 1, k)).alias("__one")).select("__item", "__one.__hash", "__need")


def contaminated_pairs(docs: DataFrame, items: DataFrame, text_col: str = "text", id_col: str = "doc_id", item_text_col: str = "text", item_id_col: str = "item_id", containment: float = CONTAINMENT) -> DataFrame:
    """doc_id, item_id, item_shingles, shared_shingles, containment of the pairs whose document has at least that share of the item.

    Words are runs of letters, digits and non-ASCII characters after lower-casing A-Z. A null text is empty; items of fewer than
    five words have no shingle and match nothing; equal items are each reported; null identifiers are kept as null. Rows that
    repeat an identifier count as its versions, and the largest share of them is reported, once. Empty tables give no pairs.
    """
    ident = F.col(quoted(id_col))
    own = items.select(F.col(quoted(item_id_col)).alias("__item"), words_of(text_of(item_text_col)).alias("__words"))
    own = own.select("__item", shingles(F.col("__words")).alias("__shingles"), shingle_hashes(F.col("__words")).alias("__hashes"))
    own = own.where(F.size("__shingles") > 0).select(F.monotonically_increasing_id().alias("__no"), "*")
    own = materialise(own)
    sketch = materialise(item_sketches(own.select(F.col("__no").alias("__item"), "__hashes"), containment))
    sketch = broadcast_if_small(sketch, sketch.count(), BROADCAST_SKETCH)
    texts = docs.select(ident.alias("__doc"), text_of(text_col).alias("__text"))
    probes = texts.select("__doc", F.explode(shingle_hashes(words_of(F.col("__text")))).alias("__hash"))
    met = probes.join(sketch, "__hash").groupBy("__doc", "__item", "__need").agg(F.count(F.lit(1)).alias("__met"))
    pairs = materialise(met.where(F.col("__met") >= F.col("__need")).select("__doc", "__item"))
    pairs_of = broadcast_if_small(pairs, pairs.count(), BROADCAST_PAIRS)
    found = texts.join(pairs_of.withColumnRenamed("__doc", "__of"), F.col("__doc").eqNullSafe(F.col("__of")))
    own = broadcast_if_small(own, own.count(), BROADCAST_ITEMS)
    found = found.join(own.select(F.col("__no").alias("__item"), F.col("__item").alias("item_id"), "__shingles"), "__item")
    shared = F.size(F.array_intersect("__shingles", shingles(words_of(F.col("__text"))))).cast("long")
    found = found.select("__doc", "__item", "item_id", F.size("__shingles").cast("long").alias("item_shingles"), shared.alias("shared_shingles"))
    found = found.where(F.col("shared_shingles") >= F.lit(containment) * F.col("item_shingles") - 1e-9)
    found = found.groupBy("__doc", "__item", "item_id", "item_shingles").agg(F.max("shared_shingles").alias("shared_shingles"))
    return found.select(F.col("__doc").alias("doc_id"), "item_id", "item_shingles", "shared_shingles", (F.col("shared_shingles") / F.col("item_shingles")).alias("containment"))


def decontaminate(docs: DataFrame, items: DataFrame, text_col: str = "text", id_col: str = "doc_id", **more) -> DataFrame:
    """docs without the documents that have an item, columns as they are.

    Documents are told apart by their text, so identifiers (id_col is not read) may be null or repeated: each row goes or stays for its own text.
    """
    key = F.concat_ws(" ", F.xxhash64(text_of(text_col)), F.xxhash64(text_of(text_col), F.lit("2")))
    texts = docs.select(key.alias("__key"), text_of(text_col).alias("__text"))
    found = materialise(contaminated_pairs(texts, items, "__text", "__key", **more).select(F.col("doc_id").alias("__of")).distinct())
    return docs.join(broadcast_if_small(found, found.count(), BROADCAST_PAIRS), key == F.col("__of"), "left_anti")


def op3_decontamination(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return contaminated_pairs(docs.select("doc_id", "text"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


OP3_SQL = r"""
WITH words AS (
  SELECT 'd' AS side, doc_id AS id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM documents
  UNION ALL
  SELECT 'i', item_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') FROM benchmark),
s AS (SELECT DISTINCT side, id, unnest(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) AS sh FROM words WHERE len(w) >= 5),
n AS (SELECT id AS item_id, count(*) AS item_shingles FROM s WHERE side = 'i' GROUP BY id),
p AS (SELECT d.id AS doc_id, i.id AS item_id, count(*) AS shared_shingles FROM s d JOIN s i ON d.sh = i.sh AND d.side = 'd' AND i.side = 'i' GROUP BY ALL)
SELECT doc_id, item_id, item_shingles, shared_shingles, shared_shingles / item_shingles AS containment FROM p JOIN n USING (item_id)
WHERE shared_shingles >= 0.8 * item_shingles - 1e-9
"""
