"""Batches and compaction without a row, a task or a driver that holds all of them."""

import hashlib

from pyspark.sql import functions as F

from tokenloom.functions.numbering import numbered
from tokenloom.queries import _wire
from tokenloom.sources import store as stores
from tokenloom.sources.fixtures import sentences
from tokenloom.sources.store import Store, batch_hash

DIR = "/root/testdata/sf0.001"


def test_rows_are_numbered_in_order(spark, tmp_path):
    df = spark.range(1000).select((F.col("id") * 7919 % 1000).alias("a"), F.col("id").cast("string").alias("b")).repartition(7)
    got, n = numbered(df, ("a",), f"{tmp_path}/n")
    assert n == 1000 and all(r["a"] == r["place"] for r in got.collect()) and got.columns == ["a", "b", "place"]


def test_the_hash_of_a_large_batch_is_made_of_its_parts(spark, monkeypatch):
    rows = [(k, f"text {k}") for k in range(10)]
    df = spark.createDataFrame(rows, "place long, value string").repartition(3)
    sums = [hashlib.sha256(v.encode()).hexdigest() for _, v in rows]
    whole = lambda xs: hashlib.sha256(",".join(xs).encode()).hexdigest()
    assert batch_hash(df, "place") == f"sha256-{whole(sums)[:32]}"
    monkeypatch.setattr(stores, "HASHED", 4)
    assert batch_hash(df, "place") == f"sha256-{whole([whole(sums[:4]), whole(sums[4:8]), whole(sums[8:])])[:32]}"


def test_a_batch_is_staged_and_the_stage_goes(spark, tmp_path, monkeypatch):
    docs, store = _wire(sentences(spark, DIR).where("split_id < 30")), Store(spark, f"{tmp_path}/t")
    assert store.add_documents(docs).batches == 1
    monkeypatch.setattr(stores, "BROADCAST_PATHS", 0)
    other = Store(spark, f"{tmp_path}/u")
    assert other.add_documents(docs).batches == 1
    rows = lambda s: [tuple(r) for r in s.sentences().select("sent_ord", "sentence_id").orderBy("sent_ord").collect()]
    assert rows(store) == rows(other) and store.add_documents(docs).known_batches == 1
    assert not list((tmp_path / "t/staged").glob("*")) and not spark.sparkContext._jsc.getPersistentRDDs()


def test_compaction_needs_no_window(spark, tmp_path):
    store, df = Store(spark, f"{tmp_path}/t"), sentences(spark, DIR).where("split_id < 30")
    for k in range(3):
        store.add_sentences(df.where(F.col("split_id") % 3 == k).withColumn("sent_ord", F.col("split_id") * (1 << 24) + F.col("sent_ord")), batch=f"part-{k}")
    want = [r[0] for r in store.sentences().orderBy("split_id", "sent_ord").select("sentence_id").collect()]
    assert store.compact(target=1 << 40) == 3
    got = store.sentences().orderBy("sent_ord").select("sentence_id", "sent_ord").collect()
    assert [r[0] for r in got] == want and len({r[1] for r in got}) == len(want)
    assert store.sentences().select("split_id").distinct().count() == 1
