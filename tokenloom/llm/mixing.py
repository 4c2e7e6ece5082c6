"""Mixing sources to target weights by weighted fair queueing.

Every source's documents are shuffled by a keyed digest; a document's virtual finish time in pass e (0, 1, 2 for the repeats a
source may need) is (e * source size + words up to and including it) / target of its source. The queue of all sources is the
global order of these times, cut where the total budget is used up.

Running sums are by levels: a source's shuffle order is cut into buckets by the digest's first digits, so that no window holds
more than a few thousand rows however large the source is, and the buckets' sums give the offsets. The cut is found from a
histogram of finish times and then exactly inside the one slice where the budget ends.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window, functions as F

from .common import NOT_SPACE, materialise, others, quoted, text_of

#: Fixed values of the contract: weights by the source's place in code-point order, and how often a document may be used.
WEIGHTS = (5, 2, 1)
REPEATS = 3
#: Rows that a window of the running sums, or the slice in which the budget ends, holds on average at most.
BUCKET_ROWS = 1024
#: Most slices of finish times that are summed up in one place.
MAX_SLICES = 1 << 16
MADE = ("size", "source_size", "target", "taken")


def n_words(text: Column) -> Column:
    return F.regexp_count(text, F.lit(NOT_SPACE)).cast("long")


def source_targets(sized: DataFrame) -> DataFrame:
    """__source, source_size, __rank, target of each source: weights share the total, none above REPEATS times its size.

    One row a source goes through these windows, not one a document. A source is filled to its limit if it reaches it at the
    level that those reaching theirs earlier leave to the rest.
    """
    per = sized.groupBy("__source").agg(F.sum("size").alias("source_size"))
    by_name, everything = Window.orderBy(F.col("__source").asc_nulls_last()), Window.partitionBy()
    per = per.withColumn("__rank", F.row_number().over(by_name) - 1)
    weight = F.lit(WEIGHTS[-1])
    for i, w in enumerate(WEIGHTS[:-1]):
        weight = F.when(F.col("__rank") % len(WEIGHTS) == i, w).otherwise(weight)
    per = per.withColumns({"__w": weight.cast("double"), "__most": (F.col("source_size") * REPEATS).cast("double")})
    earlier = Window.orderBy(F.col("__most") / F.col("__w"), "__rank").rowsBetween(Window.unboundedPreceding, -1)
    per = per.withColumns({
        "__total": F.sum("source_size").over(everything).cast("double"), "__all": F.sum("__w").over(everything),
        "__before": F.coalesce(F.sum("__most").over(earlier), F.lit(0.0)), "__w_before": F.coalesce(F.sum("__w").over(earlier), F.lit(0.0)),
    })
    per = per.withColumn("__full", F.col("__most") * (F.col("__all") - F.col("__w_before")) <= F.col("__w") * (F.col("__total") - F.col("__before")))
    full = lambda c: F.sum(F.when(F.col("__full"), F.col(c)).otherwise(0.0)).over(everything)
    level = F.try_divide(F.col("__total") - full("__most"), F.col("__all") - full("__w"))
    return per.withColumn("target", F.when(F.col("__full"), F.col("__most")).otherwise(F.col("__w") * level)).select("__source", "source_size", "__rank", "target")


def queued(df: DataFrame, text_col: str, id_col: str, source_col: str, seed: str, size: Column | None = None) -> DataFrame:
    """df with size, source_size, target, __rank, __key (place in the shuffle) and __upto (words of its source up to it)."""
    ident = F.col(quoted(id_col))
    sized = df.select(*others(df, *MADE), (n_words(text_of(text_col)) if size is None else size).alias("size"), F.col(quoted(source_col)).alias("__source"))
    digits = max(0, math.ceil(math.log(max(1, df.count()) / BUCKET_ROWS, 16)))
    sized = sized.withColumn("__key", F.md5(F.concat(F.lit(seed), F.coalesce(ident.cast("string"), F.lit("null")))))
    sized = sized.withColumn("__bucket", F.substring("__key", 1, digits) if digits else F.lit(""))
    sized = sized.withColumns({"__no_source": F.col("__source").isNull(), "__name": F.coalesce("__source", F.lit(""))})
    at = ["__no_source", "__name", "__bucket"]
    sums = sized.groupBy(*at, "__source").agg(F.sum("size").alias("__sum"))
    # buckets' offsets go by the first half of their digits and then within it, so no window holds more than about the root of their number
    half, before = digits // 2, lambda *by, order: Window.partitionBy("__no_source", "__name", *by).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    offset = lambda c, window: F.coalesce(F.sum(c).over(window), F.lit(0))
    sums = sums.withColumn("__half", F.substring("__bucket", 1, half) if half else F.lit(""))
    halves = sums.groupBy("__no_source", "__name", "__half").agg(F.sum("__sum").alias("__half_sum"))
    halves = halves.withColumn("__half_offset", offset("__half_sum", before(order="__half"))).drop("__half_sum")
    offsets = sums.withColumn("__offset", offset("__sum", before("__half", order="__bucket"))).join(halves, ["__no_source", "__name", "__half"])
    offsets = offsets.withColumn("__offset", F.col("__offset") + F.col("__half_offset")).drop("__half", "__half_offset")
    per = source_targets(sums.select("__source", F.col("__sum").alias("size")))
    per = per.select(F.col("__source").isNull().alias("__no_source"), F.coalesce("__source", F.lit("")).alias("__name"), "source_size", "__rank", "target")
    offsets = offsets.join(per, ["__no_source", "__name"]).drop("__source", "__sum")
    inside = Window.partitionBy(*at).orderBy("__key", ident, "size").rowsBetween(Window.unboundedPreceding, 0)
    return sized.withColumn("__in", F.sum("size").over(inside)).join(offsets, at).withColumn("__upto", F.col("__offset") + F.col("__in")).drop("__in", "__offset", "__bucket", "__no_source", "__name", "__source")


def finish(e: Column | int) -> Column:
    """Virtual finish time in pass e; null where the source takes no words."""
    return F.try_divide((F.lit(e) if isinstance(e, int) else e) * F.col("source_size") + F.col("__upto"), F.col("target"))


def passes(q: DataFrame, id_col: str) -> DataFrame:
    """The queue: a row for each row and pass, with its place in the global order."""
    at = F.explode(F.array(*[F.struct(F.lit(e).alias("__pass"), finish(e).alias("__finish")) for e in range(REPEATS)]))
    return q.withColumn("__p", at).select("*", "__p.*").drop("__p").where("__finish IS NOT NULL AND size > 0")


def cut(q: DataFrame, id_col: str) -> tuple | None:
    """The last place of the global order that is within the budget (all words of q): finish, rank, key, id, pass; None if nothing is."""
    rows, budget = q.agg(F.count(F.lit(1)), F.sum("size")).first()
    if not budget:
        return None
    slices = max(1, min(MAX_SLICES, rows * REPEATS // BUCKET_ROWS))
    when = F.col("__finish")
    slice_of = F.when(when < 4, F.floor(when * slices)).otherwise(4 * slices + F.floor(F.log2(F.greatest(when, F.lit(1.0))) * slices))
    e = passes(q, id_col).withColumn("__slice", slice_of)
    upto = Window.orderBy("__slice")
    sums = e.groupBy("__slice").agg(F.sum("size").alias("__sum")).withColumn("__all", F.sum("__sum").over(upto))  # one row a slice
    last = sums.where(F.col("__all") > budget).orderBy("__slice").select("__slice", F.col("__all") - F.col("__sum")).first()
    order = ["__finish", "__rank", "__key", quoted(id_col), "__pass"]
    fits = e if last is None else e.where(F.col("__slice") <= last[0])
    if last is not None:
        there = e.where(F.col("__slice") == last[0]).withColumn("__run", F.sum("size").over(Window.orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)))
        inside = there.where(F.col("__run") <= budget - last[1]).orderBy(*[F.col(c).desc() for c in order]).select(*order).first()
        if inside is not None:
            return tuple(inside)
        fits = e.where(F.col("__slice") < last[0])
    found = fits.select(F.max(F.struct(*order)).alias("m")).first()[0]
    return tuple(found) if found is not None else None


def within(last: tuple, id_col: str, kind: str, e: int) -> Column:
    """Whether a row's pass e is at or before the cut. kind: the identifier's type."""
    at = [finish(e), F.col("__rank"), F.col("__key"), F.col(quoted(id_col)), F.lit(e)]
    return F.coalesce(F.struct(*at) <= F.struct(*[F.lit(x).cast(t) for x, t in zip(last, ("double", "int", "string", kind, "int"), strict=True)]), F.lit(False))


def mix_sources(df: DataFrame, text_col: str = "text", id_col: str = "doc_id", source_col: str = "source", seed: str = "mix:", size: Column | None = None) -> DataFrame:
    """df with size (words), source_size, target (words its source should give) and taken (words the mix takes, repeats counted).

    A null text has no words, a null source is a source of its own and the last in order. Documents are taken whole, up to
    REPEATS times. Rows of one identifier share a place in the shuffle and stand in order of size. An empty table stays empty.
    Input columns named as a made column are replaced; all others are carried along, texts too: give size, the words of each
    row, with texts left out where they aren't needed. Reruns agree: the shuffle is a digest of seed and identifier.
    """
    q = materialise(queued(df, text_col, id_col, source_col, seed, size))
    last = cut(q, id_col)
    taken = F.lit(0).cast("long")
    for e in range(REPEATS if last else 0):
        taken = taken + F.when(within(last, id_col, dict(q.dtypes)[id_col], e), F.col("size")).otherwise(0)
    return q.withColumn("taken", taken).withColumn("target", F.coalesce("target", F.lit(0.0))).select(*others(df, *MADE), *MADE)


def mixed_stream(df: DataFrame, text_col: str = "text", id_col: str = "doc_id", source_col: str = "source", seed: str = "mix:") -> DataFrame:
    """The mix itself: the taken rows of df, repeats as rows of their own, range-sorted by virtual finish time; adds pass and finish."""
    q = materialise(queued(df, text_col, id_col, source_col, seed))
    if (last := cut(q, id_col)) is None:
        return q.limit(0).select(*others(df, *MADE, "pass", "finish"), F.lit(0).alias("pass"), F.lit(0.0).alias("finish"))
    keep = F.lit(False)
    for e in range(REPEATS):
        keep = keep | ((F.col("__pass") == e) & within(last, id_col, dict(q.dtypes)[id_col], e))
    return passes(q, id_col).where(keep).orderBy("__finish", "__rank", "__key", quoted(id_col), "__pass").select(*others(df, *MADE, "pass", "finish"), F.col("__pass").alias("pass"), F.col("__finish").alias("finish"))


def op9_mixing(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    sized = docs.select("doc_id", "source", n_words(text_of("text")).alias("n_words"))
    return mix_sources(sized, size=F.col("n_words")).select("doc_id", *MADE)


OP9_SQL = r"""
WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size, md5('mix:' || doc_id) AS k FROM documents),
s AS (SELECT source, sum(size) AS source_size, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS rnk FROM d GROUP BY source),
w AS (SELECT *, CAST(CASE rnk % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS DOUBLE) AS w, CAST(source_size * 3 AS DOUBLE) AS most FROM s),
b AS (SELECT *, CAST(sum(source_size) OVER () AS DOUBLE) AS total, sum(w) OVER () AS w_all,
             coalesce(sum(most) OVER e, 0) AS before, coalesce(sum(w) OVER e, 0) AS w_before
      FROM w WINDOW e AS (ORDER BY most / w, rnk ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
f AS (SELECT *, most * (w_all - w_before) <= w * (total - before) AS is_full FROM b),
t AS (SELECT source, source_size, rnk, total,
             CASE WHEN is_full THEN most ELSE w * ((total - sum(CASE WHEN is_full THEN most ELSE 0 END) OVER ()) / (w_all - sum(CASE WHEN is_full THEN w ELSE 0 END) OVER ())) END AS target
      FROM f),
q AS (SELECT d.*, t.source_size, t.rnk, t.target, t.total, sum(size) OVER (PARTITION BY d.source ORDER BY k, doc_id ROWS UNBOUNDED PRECEDING) AS upto
      FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
e AS (SELECT q.*, p, (p * source_size + upto) / target AS finish FROM q, (VALUES (0), (1), (2)) v(p) WHERE size > 0),
r AS (SELECT *, sum(size) OVER (ORDER BY finish, rnk, k, doc_id, p ROWS UNBOUNDED PRECEDING) AS run FROM e),
g AS (SELECT doc_id, sum(size) AS taken FROM r WHERE run <= total GROUP BY doc_id)
SELECT q.doc_id, q.size, CAST(q.source_size AS BIGINT) AS source_size, q.target, CAST(coalesce(g.taken, 0) AS BIGINT) AS taken FROM q LEFT JOIN g USING (doc_id)
"""
