"""Exact dedup by a content sort, in DataFrame operations only.

Sampled splitters range-partition the rows by their normalised text (its first characters, then its hash, so that splitters
stay short), Spark's external sort places equal texts side by side, and a window over the sorted run compares whole
neighbouring texts. A text with so many copies that they would fill a good part of one partition is dealt out by its rows'
identifiers; its copies are combined before any shuffle into one row a task, which gives the identifier and the count for all.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from .common import SPACE, others, quoted, shuffle_partitions, small_table, text_of

#: Characters of a splitter. Longer common beginnings are told apart by hash; equality is decided on whole texts.
SPLITTER_CHARS = 48
MADE = ("keep_id", "group_size", "kept", "text_sha256")


def normalised(text: Column) -> Column:
    return F.regexp_replace(text, SPACE, " ")


def exact_dedup(df: DataFrame, text_col: str = "text", id_col: str = "doc_id", partitions: int | None = None) -> DataFrame:
    """df with keep_id, group_size, kept and text_sha256; of equal normalised texts the row with the smallest identifier is kept.

    A null text counts as empty. Null identifiers come last: keep_id is null only where every copy's is. Of repeated rows (same
    text and identifier) exactly one is kept. An empty table gives an empty table. Input columns named as a made column are
    replaced; all others are carried along.
    """
    n = partitions or shuffle_partitions(df.sparkSession)
    ident = F.col(quoted(id_col))
    src = df.select(*others(df, *MADE), text_of(text_col).alias("__text")).withColumn("__hash", F.xxhash64(normalised(F.col("__text"))))
    total = df.count()
    # At most 2 * n texts can each have more than 1 / (2 * n) of the rows, so this list is bounded by the partitions.
    hot = src.groupBy("__hash").count().where(F.col("count") * (2 * n) > F.lit(max(total, 2 * n))).collect()
    salts = small_table(df.sparkSession, __hash=[r[0] for r in hot], __salts=[-(-r[1] * 4 * n // total) for r in hot]) if hot else None
    if hot:
        src = src.join(F.broadcast(salts), "__hash", "left").withColumn("__salt", F.when(F.col("__salts").isNull(), 0).otherwise(F.pmod(F.xxhash64(ident), F.col("__salts"))))
    else:
        src = src.withColumns({"__salts": F.lit(None).cast("long"), "__salt": F.lit(0).cast("long")})
    src = src.withColumn("__head", F.substring(normalised(F.col("__text")), 1, SPLITTER_CHARS))
    keys = ["__head", "__hash", *["__salt"] * bool(hot)]  # a constant key would be folded away, and the window would shuffle once more
    run = src.repartitionByRange(n, *keys).withColumn("__norm", normalised(F.col("__text")))
    spec = Window.partitionBy(*keys, "__norm").orderBy(ident.asc_nulls_last())
    whole = spec.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    run = run.withColumns({
        "__at": F.row_number().over(spec), "keep_id": F.first(ident).over(whole), "group_size": F.count(F.lit(1)).over(whole),
    }).withColumn("text_sha256", F.sha2(F.col("__norm"), 256)).withColumn("kept", F.col("__at") == 1)
    if hot:
        copies = src.where(F.col("__salts").isNotNull()).groupBy(normalised(F.col("__text")).alias("__norm")).agg(F.min(ident).alias("__keep"), F.count(F.lit(1)).alias("__size"))
        copies = F.broadcast(copies.select(F.sha2("__norm", 256).alias("__sha"), "__keep", "__size"))  # no more than 2 * n texts, and those whose hash is the same
        run = run.join(copies, F.col("text_sha256") == F.col("__sha"), "left")
        dealt = F.col("__sha").isNotNull()
        run = run.withColumns({
            "kept": F.when(dealt, F.col("kept") & F.col("keep_id").eqNullSafe(F.col("__keep"))).otherwise(F.col("kept")),
            "keep_id": F.when(dealt, F.col("__keep")).otherwise(F.col("keep_id")), "group_size": F.when(dealt, F.col("__size")).otherwise(F.col("group_size")),
        })
    return run.select(*others(df, *MADE), *MADE)


def op1_exact_dedup(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return exact_dedup(docs.select("doc_id", "text")).select("doc_id", *MADE)


OP1_SQL = r"""
WITH n AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS t FROM documents)
SELECT doc_id, min(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       row_number() OVER (PARTITION BY t ORDER BY doc_id) = 1 AS kept, sha256(t) AS text_sha256
FROM n WINDOW w AS (PARTITION BY t)
"""
