import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tokenloom.llm import lm_scoring as lm


def tokens(text):
    return [*(text or "").encode().lower().split(), None]


def brute(rows, train):
    """Counts of words, pairs and triples of the rows that train chooses."""
    count = Counter()
    for i, text in rows:
        if train(i):
            t = tokens(text)
            full = ["<b>", "<s>", *t]
            count.update(zip(t))
            count.update(zip(full[1:], t))
            count.update(zip(full, full[1:], t))
            count[("<s>",)] += 1
            count["<b>", "<s>"] += 1
    return count


def sizes(count):
    words = {k: n for k, n in count.items() if len(k) == 1 and k != ("<s>",)}
    return sum(words.values()), len(words)


def contexts(text):
    """Before last, last and token of each token."""
    t = tokens(text)
    full = ["<b>", "<s>", *t]
    return zip(full, full[1:], t)


def bucket(count, a, b):
    """What the mixture weights depend on: the power of two of a context's count."""
    power = lambda n: 0 if not n else math.ceil(math.log2(n + 1))
    return (2, power(count[a, b])) if count[a, b] else (1, power(count[b,]))


def parts(count, n, v, a, b, w):
    """Probability of w in each model; None where it is undefined."""
    return [count[a, b, w] / count[a, b] if count[a, b] else None, count[b, w] / count[b,] if count[b,] else None, count[w,] / n if n else None, 1 / (v + 1)]


def plain_em(rows, deleted, count, steps=60):
    """Mixture weights by bucket, token by token."""
    n, v = sizes(count)
    seen = [(bucket(count, a, b), [p or 0.0 for p in parts(count, n, v, a, b, w)]) for i, text in rows if i in deleted for a, b, w in contexts(text)]
    weights = {k: [0.25] * 4 for k, _ in seen}
    for _ in range(steps):
        got = {k: [0.0] * 4 for k in weights}
        for k, p in seen:
            mixed = [x * y for x, y in zip(p, weights[k], strict=True)]
            for j in range(4):
                got[k][j] += mixed[j] / sum(mixed)
        weights = {k: [x / sum(g) for x in g] for k, g in got.items()}
    return weights


def test_counts_and_base_scores(spark, docs):
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    learnt = lambda i: i is not None and zlib.crc32(str(i).encode()) % 7 != 2
    count = brute(rows, learnt)
    n, v = sizes(count)
    want = sorted((repr(i), len(tokens(t)), sum(count[x,] > 0 for x in tokens(t)), n, round(sum(math.log10((count[x,] + 1) / (n + v + 1)) for x in tokens(t)), 6)) for i, t in rows)
    got = lm.score_texts(docs, F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 != 2).collect()
    assert sorted((repr(r.id), r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in got) == want
    assert all(r.score < 0 and math.isfinite(r.score) for r in got)


def test_score_is_the_mixture_that_plain_em_learns(spark):
    draw = random.Random(3)
    rows = []
    for i in range(400):
        word, text = draw.randrange(40), []
        for _ in range(draw.randrange(60)):
            word = (word * 7 + draw.choice([1, 1, 1, 2, 5])) % 40 if draw.random() < 0.8 else draw.randrange(400)
            text.append(f"w{word}")
        rows.append((i, " ".join(text)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    train = F.col("doc_id") % 5 != 0
    got = {r.id: r.score for r in lm.score_texts(df, train).collect()}
    dev = {r[0] for r in df.where(train & (F.pmod(F.xxhash64("doc_id", "text", F.lit("deleted")), F.lit(lm.DELETED)) == 0)).select("doc_id").collect()}
    weights = plain_em(rows, dev, brute(rows, lambda i: i % 5 != 0 and i not in dev))
    count = brute(rows, lambda i: i % 5 != 0)
    n, v = sizes(count)
    checked = 0
    for i, text in rows:
        want = 0.0
        for a, b, w in contexts(text):
            p, own = parts(count, n, v, a, b, w), weights.get(bucket(count, a, b))
            if own is None:  # a bucket that no deleted token has
                break
            defined = [(x, y) for x, y in zip(own, p, strict=True) if y is not None]
            want += math.log10(sum(x * y for x, y in defined) / sum(x for x, _ in defined))
        else:
            checked += 1
            assert got[i] == pytest.approx(want, rel=0.005, abs=0.02)
    assert checked > 200


def test_probabilities_add_up_to_one(spark):
    """Over all words and the unknown one, in every context."""
    rows = [(i, " ".join(f"w{(i * j) % 7}" for j in range(i % 9))) for i in range(80)]
    count = brute(rows, lambda i: True)
    n, v = sizes(count)
    draw = np.random.default_rng(4)
    weights = draw.random((lm.BUCKETS, 4))
    words = [k for k in count if len(k) == 1 and k != ("<s>",)]
    for a, b in [("<b>", "<s>"), (b"w1", b"w2"), (b"w0", b"w0"), (b"w3", b"nosuch"), (b"nosuch", b"w3"), (b"no", b"nosuch")]:
        at = lm.bucket_of(np.array([count[a, b]]), np.array([count[b,]]))
        each = [(count[a, b, w] / max(1, count[a, b]), count[b, w] / max(1, count[b,]), count[w,]) for (w,) in words] + [(0.0, 0.0, 0)]
        p = lm.mixture(weights, np.repeat(at, len(each)), *(np.array(x) for x in zip(*each, strict=True)), n, v)
        assert p.sum() == pytest.approx(1)


def test_partitions_do_not_grow_with_the_data(spark, monkeypatch):
    monkeypatch.setattr(lm, "CHUNK_BYTES", 200)
    monkeypatch.setattr(lm, "OWNED_BYTES", 300)
    rows = [(i, " ".join(f"w{(i * j) % 23}" for j in range(40))) for i in range(100)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    scored = lm.score_texts(df, F.col("doc_id") % 5 != 0)
    assert scored.rdd.getNumPartitions() <= 4
    many = {r.id: r.score for r in scored.collect()}
    monkeypatch.undo()
    assert many == pytest.approx({r.id: r.score for r in lm.score_texts(df, F.col("doc_id") % 5 != 0).collect()})


def test_model_beats_its_base_on_held_out_text(spark):
    rows = [(i, " ".join(f"a{(i + j) % 19} b{(i + j) % 19}" for j in range(30))) for i in range(150)]
    got = lm.score_texts(spark.createDataFrame(rows, "doc_id long, text string"), F.col("doc_id") % 7 != 2).where("NOT train").agg(F.sum("score"), F.sum("base_score")).first()
    assert got[0] > got[1]


def test_odd_tables(spark, empty, clashing):
    assert lm.score_texts(empty, F.lit(True)).collect() == []
    none = lm.score_texts(clashing, F.lit(False)).collect()
    assert len(none) == clashing.count() and all(r.n_known == 0 and r.train_tokens == 0 and math.isfinite(r.score) for r in none)
    assert lm.score_texts(clashing, F.lit(None).cast("boolean")).where("train").count() == 0


def test_packing():
    keys = np.unique(np.random.default_rng(1).integers(1 << 63, size=1000, dtype=np.uint64) * np.uint64(2))
    assert (lm.unpack_keys(lm.pack_keys(keys)) == keys).all() and len(lm.unpack_keys(lm.pack_keys(keys[:0]))) == 0
