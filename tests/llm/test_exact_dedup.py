import hashlib
import re
from collections import defaultdict

from tokenloom.llm.exact_dedup import MADE, exact_dedup


def expected(rows):
    groups = defaultdict(list)
    for r in rows:
        groups[re.sub(r"[\x20\x09-\x0D]+", " ", r[1] or "")].append(r[0])
    out = []
    for text, ids in groups.items():
        known = sorted(i for i in ids if i is not None)
        keep = known[0] if known else None
        kept = False
        for i in [*known, *[None] * (len(ids) - len(known))]:
            out.append((i, keep, len(ids), not kept, hashlib.sha256(text.encode()).hexdigest()))
            kept = True
    return sorted(out, key=repr)


def found(df):
    return sorted((tuple(r) for r in df.select("doc_id", *MADE).collect()), key=repr)


def test_against_brute_force(docs):
    assert found(exact_dedup(docs)) == expected([tuple(r) for r in docs.collect()])


def test_hot_text_is_dealt_out(spark):
    rows = [(i, "same  text" if i % 3 else "same text") for i in range(600)] + [(1000 + i, f"text {i}") for i in range(100)] + [(7, "same text"), (None, "same text")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert found(exact_dedup(df, partitions=4)) == expected(rows)


def test_all_rows_alike(spark):
    rows = [(i % 5, "t") for i in range(50)]
    assert found(exact_dedup(spark.createDataFrame(rows, "doc_id long, text string"))) == expected(rows)


def test_long_white_space_at_the_start(spark):
    rows = [(1, " " * 500 + "a b"), (2, " a b"), (3, "\n" * 200 + "a\tb"), (4, "a b")]
    assert found(exact_dedup(spark.createDataFrame(rows, "doc_id long, text string"))) == expected(rows)


def test_empty_table_and_clashing_names(empty, clashing, docs):
    assert exact_dedup(empty).collect() == []
    out = exact_dedup(clashing)
    assert found(out) == expected([tuple(r) for r in docs.collect()])
    assert sorted(out.columns) == sorted(clashing.columns)


def test_dealing_out_starts_no_python_rdd(spark, monkeypatch):
    rows = [(i, "same text") for i in range(600)] + [(1000 + i, f"text {i}") for i in range(100)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    monkeypatch.setattr(type(spark.sparkContext), "parallelize", lambda *a, **b: (_ for _ in ()).throw(AssertionError("rows went through a Python RDD")))
    assert found(exact_dedup(df, partitions=4)) == expected(rows)
