"""Helpers that the training-data operators share: tables, materialising, names, and cutting an ordered stream."""

from __future__ import annotations

import tempfile
import uuid

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

#: The white space of the corpus contracts, and the bytes that part words of a normalised text.
SPACE = r"[\x20\x09-\x0D]+"
NOT_SPACE = r"[^\x20\x09-\x0D]+"
NOT_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def shared_folder(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir, which all executors see. Only on one machine, where it is unset, a temporary one."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder
    context = spark.sparkContext
    if not context._jsc.sc().getCheckpointDir().isDefined():
        if not context.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        context.setCheckpointDir("file://" + tempfile.mkdtemp(prefix="tokenloom-"))
    return context._jsc.sc().getCheckpointDir().get()


_written: list[tuple[str, str]] = []


def materialise(df: DataFrame) -> DataFrame:
    """Write df as a table in the shared folder and read it again: lineage ends there, and a lost executor costs no recomputation.

    The table stays, as what is made of it may be read at any time; remove_tables() takes away those of a session.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/tokenloom-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _written.append((spark.sparkContext.applicationId, path))
    return spark.read.schema(df.schema).parquet(path)


def small_table(spark: SparkSession, **columns: list) -> DataFrame:
    """A table of the driver's own rows, of strings and longs, as a local relation.

    createDataFrame(rows) would send them through a Python RDD, for which executors start a second daemon, which stays, and workers of its own.
    """
    return spark.createDataFrame(pa.table({c: pa.array(x, pa.string() if x and isinstance(x[0], str) else pa.int64()) for c, x in columns.items()}))


def tables_made() -> int:
    """How many intermediate tables there are by now: those made later can be removed by themselves."""
    return len(_written)


def remove_tables(spark: SparkSession, since: int = 0, but_last: int = 0) -> int:
    """Remove the intermediate tables of this session (those made since, but for the last ones), whose results must have been written by now; how many they were."""
    own = [x for x in _written[since : len(_written) - but_last] if x[0] == spark.sparkContext.applicationId]
    for x in own:
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(x[1])
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
        _written.remove(x)
    return len(own)


def text_of(col: str) -> Column:
    return F.coalesce(F.col(quoted(col)).cast("string"), F.lit(""))


def quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def others(df: DataFrame, *made: str) -> list[Column]:
    """The columns of df but those that an operator makes itself: a made column replaces an input column of its name."""
    return [F.col(quoted(c)) for c in df.columns if c not in made]


def ascii_lower(text: Column) -> Column:
    return F.translate(text, UPPER, LOWER)


def words_of(text: Column) -> Column:
    """Words of WORD after lower-casing A-Z, as an array without empty strings."""
    return F.filter(F.split(ascii_lower(text), NOT_WORD), lambda w: w != "")


def let(value: Column, body) -> Column:
    """body(value) with value computed once: inside a lambda, an expression written out would be computed again for each element."""
    return F.element_at(F.transform(F.array(value), body), 1)


def broadcast_if_small(df: DataFrame, rows: int, most: int) -> DataFrame:
    """Broadcast df if its counted rows are within the bound, else leave the join to a shuffle."""
    return F.broadcast(df) if rows <= most else df


def place_of_kth(df: DataFrame, key: str, tie: str, k: int, most: int = 5000) -> tuple | None:
    """(key, tie) of the k-th row by key descending, then tie ascending, or None if there are fewer than k rows or k is 0.

    Histograms narrow the range of keys until few rows are in it, so no task sorts more than about most rows, unless that many
    have one key. df is read several times: give a materialised one. The tie must tell apart rows of equal keys, or be equal.
    """
    slices = 4096
    if k <= 0:
        return None
    left, (n, low, high) = k, df.agg(F.count(key), F.min(key), F.max(key)).first()
    if n < k:
        return None
    inside = df.where(F.col(key).isNotNull())
    while n > most and high > low:
        at = F.least(F.floor((F.col(key) - F.lit(low)) / F.lit(high - low) * slices), F.lit(slices - 1))
        sums = {r[0]: r[1:] for r in inside.groupBy(at.alias("at")).agg(F.count(F.lit(1)), F.min(key), F.max(key)).collect()}
        for slice_ in sorted(sums, reverse=True):
            n, low, high = sums[slice_]
            if left <= n:
                break
            left -= n
        inside = inside.where(F.col(key).between(low, high))
    # rows equal in key and tie are one group, so however many rows have one key, the driver reads no more groups than it needs, one after another
    groups = inside.groupBy(key, quoted(tie)).agg(F.count(F.lit(1)).alias("__rows")).orderBy(F.col(key).desc(), F.col(quoted(tie)).asc_nulls_last())
    for *place, rows in groups.toLocalIterator():
        left -= rows
        if left <= 0:
            return tuple(place)
    return None
