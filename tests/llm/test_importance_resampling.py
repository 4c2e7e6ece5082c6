import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tokenloom.llm import importance_resampling as ir
from tokenloom.llm.common import place_of_kth


def good_and_bad(n):
    draw = random.Random(4)
    words = [f"word{i}" for i in range(80)]
    return [(i, " ".join(draw.choice(words) for _ in range(40)) if i % 5 else "!!! ".join(draw.choice(words[:3]) for _ in range(40))) for i in range(n)]


def test_good_texts_are_selected(spark):
    df = spark.createDataFrame(good_and_bad(400), "doc_id long, text string")
    ratios = ir.learn_ratios(df, (F.col("doc_id") % 5 != 0) & (F.col("doc_id") < 200))
    out = ir.resample(ir.weigh_texts(df, ratios), 0.8).collect()
    assert sum(r.selected for r in out) == 320 and all(r.selected == (r.doc_id % 5 != 0) for r in out)
    assert all(0 <= r.score <= 1 for r in out)


def test_weights_against_plain_sums(spark):
    rows = good_and_bad(60)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    raw, wanted = np.full(ir.BINS, ir.SMOOTH), np.full(ir.BINS, ir.SMOOTH)
    for i, t in rows:
        at, n = ir.bins_of([t])
        assert n[0] == len(at) == 2 * len(ir._TOKEN.findall(t)) - 1
        np.add.at(raw, at, 1)
        if i % 2:
            np.add.at(wanted, at, 1)
    ratios = ir.learn_ratios(df, F.col("doc_id") % 2 == 1)
    assert ratios == pytest.approx(np.log(wanted / wanted.sum()) - np.log(raw / raw.sum()))
    got = {r.doc_id: r.log_weight for r in ir.weigh_texts(df, ratios).collect()}
    for i, t in rows:
        assert got[i] == pytest.approx(ratios[ir.bins_of([t])[0]].sum(), abs=1e-6)


def test_noise_is_gumbel(spark):
    x = np.array([r[0] for r in spark.range(20_000).select(ir.gumbel(F.col("id"), "s")).collect()])
    assert x.mean() == pytest.approx(0.5772, abs=0.03) and x.std() == pytest.approx(math.pi / math.sqrt(6), abs=0.03)


@pytest.mark.parametrize("share", [0.0, 0.37, 1.0])
def test_top_share(spark, share):
    df = spark.range(1, 301).select(F.col("id").alias("doc_id"), (F.col("id") % 7).cast("double").alias("log_weight"))
    out = ir.resample(df, share).collect()
    k = round(300 * share)
    want = {r.doc_id for r in sorted(out, key=lambda r: (-r.gumbel_key, r.doc_id))[:k]}
    assert {r.doc_id for r in out if r.selected} == want


@pytest.mark.parametrize("most", [3, 5000])
def test_place_of_kth(spark, most):
    rows = [(float(i % 10), i) for i in range(200)] + [(1e9, 1000), (-1e9, 1001), (3.0, None), (None, 5)]
    df = spark.createDataFrame(rows, "key double, id long")
    order = sorted((r for r in rows if r[0] is not None), key=lambda r: (-r[0], r[1] is None, r[1] or 0))
    for k in (1, 2, 21, 100, 141, 142, 203):
        assert place_of_kth(df, "key", "id", k, most) == order[k - 1]
    assert place_of_kth(df, "key", "id", 204, most) is None and place_of_kth(df, "key", "id", 0, most) is None


def test_odd_rows(docs, empty, clashing):
    ratios = ir.learn_ratios(docs, F.col("lang") == "en")
    out = ir.resample(ir.weigh_texts(clashing, ratios), 0.5)
    assert sorted(out.columns) == sorted({*clashing.columns, *ir.MADE}) and out.count() == docs.count()
    assert {(r.log_weight, r.score) for r in out.where("text IS NULL").collect()} == {(0.0, 0.5)}
    assert ir.resample(ir.weigh_texts(empty, ratios), 0.5).collect() == []
    assert (ir.learn_ratios(empty, F.lit(True)) == 0).all()


def test_query_against_brute_force(spark, tmp_path):
    """All rows of the query, with weights and ratios added up one n-gram at a time."""
    import regex
    import xxhash

    rows = [(i, t) for i, t in good_and_bad(150)] + [(500, None), (501, ""), (502, "Émile's ÜBER-word, again: again again"), (None, "without an identifier")]
    labels = [(i, int(i % 5 != 0) if i % 3 else None, 0) for i in range(0, 150, 2)] + [(None, 1, 0), (9999, 1, 0), (4, 1, 0)]
    spark.createDataFrame([(i, t, "en", "s", 1) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    m = (1 << 64) - 1

    def grams(text):
        words = [xxhash.xxh64_intdigest(w.encode()) for w in regex.findall(r"\w+|[^\w\s]+", (text or "").lower())]
        pairs = [((((a * 0x9E3779B97F4A7C15) & m) ^ (a >> 31)) + b) & m for a, b in zip(words, words[1:], strict=False)]
        return [(h ^ (h >> 32)) % ir.BINS for h in words + pairs]

    good = {i for i, q, _ in labels if q == 1 and i is not None}
    raw, wanted = [ir.SMOOTH] * ir.BINS, [ir.SMOOTH] * ir.BINS
    for i, t in rows:
        for g in grams(t):
            raw[g] += 1
            wanted[g] += i in good
    weight = lambda t: sum(math.log(wanted[g] / sum_wanted) - math.log(raw[g] / sum_raw) for g in grams(t))
    sum_raw, sum_wanted = sum(raw), sum(wanted)
    noise = {r.doc_id: r.g for r in spark.createDataFrame(rows, "doc_id long, text string").select("doc_id", ir.gumbel(F.col("doc_id"), "gumbel").alias("g")).collect()}
    keys = sorted(((-(weight(t) + noise[i]), i is None, i or 0) for i, t in rows))
    known = [q for _, q, _ in labels if q is not None]
    chosen = {(None if none else i) for _, none, i in keys[: round(len(rows) * sum(q == 1 for q in known) / len(known))]}
    got = {r.doc_id: r for r in ir.op10_importance_resampling(spark, str(tmp_path)).collect()}
    assert len(got) == len(rows)
    for i, t in rows:
        assert got[i].log_weight == pytest.approx(weight(t), abs=1e-6) and got[i].score == pytest.approx(1 / (1 + math.exp(min(500.0, max(-500.0, -weight(t))))), abs=1e-6) and got[i].selected == (i in chosen)
