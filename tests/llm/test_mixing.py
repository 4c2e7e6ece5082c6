import hashlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from tokenloom.llm import mixing as m


def targets(sizes):
    """Targets of sources in order: level raised until the total is placed, one full source after another."""
    total, weights = float(sum(sizes)), [(5, 2, 1)[i % 3] for i in range(len(sizes))]
    full = set()
    while True:
        rest = [i for i in range(len(sizes)) if i not in full]
        w = sum(weights[i] for i in rest)
        level = (total - sum(3.0 * sizes[i] for i in full)) / w if w else 0.0
        over = [i for i in rest if 3.0 * sizes[i] <= weights[i] * level]
        if not over:
            return [3.0 * sizes[i] if i in full else weights[i] * level for i in range(len(sizes))]
        full.update(over)


def brute(rows):
    """rows: id, text, source. Of each the size, source size, target and words taken."""
    size = [len((t or "").encode().split()) for _, t, _ in rows]
    sources = sorted({s for _, _, s in rows}, key=lambda s: (s is None, (s or "").encode()))
    total = {s: sum(n for n, r in zip(size, rows, strict=True) if r[2] == s) for s in sources}
    target = dict(zip(sources, targets([total[s] for s in sources]), strict=True))
    queue, upto = [], defaultdict(int)
    key = lambda i: hashlib.md5(("mix:" + ("null" if i is None else str(i))).encode()).hexdigest()
    order = sorted(range(len(rows)), key=lambda k: (key(rows[k][0]), rows[k][0] is not None, rows[k][0] or 0, size[k]))
    for k in order:
        s = rows[k][2]
        upto[s] += size[k]
        for e in range(3):
            if size[k] and target[s]:
                queue.append(((e * total[s] + upto[s]) / target[s], sources.index(s), key(rows[k][0]), k, e))
    taken, left = [0] * len(rows), sum(size)
    for _, _, _, k, _ in sorted(queue):
        if size[k] > left:
            break
        left -= size[k]
        taken[k] += size[k]
    return sorted(((r[0], r[2], n, total[r[2]], pytest.approx(target[r[2]]), t) for r, n, t in zip(rows, size, taken, strict=True)), key=lambda x: repr(x[:3]))


def found(df):
    return sorted((tuple(r) for r in df.select("doc_id", "source", *m.MADE).collect()), key=lambda x: repr(x[:3]))


def corpus():
    return [(i, " ".join(["w"] * ((i * 7919) % 40)), ("big" if i % 3 else f"s{i % 7}") if i % 11 else None) for i in range(500)]


@pytest.mark.parametrize("bucket", [4, 1024])
def test_against_brute_force(spark, monkeypatch, bucket):
    monkeypatch.setattr(m, "BUCKET_ROWS", bucket)
    rows = corpus()
    got = found(m.mix_sources(spark.createDataFrame(rows, "doc_id long, text string, source string")))
    assert got == brute(rows)
    by = defaultdict(int)
    for r in got:
        by[r[1]] += r[5]
        assert r[5] <= 3 * r[2] and (not r[2] or r[5] % r[2] == 0)
    target = {r[1]: r[4] for r in got}
    assert all(abs(by[s] - target[s]) <= 45 for s in target)


def test_stream_is_the_mix(spark):
    df = spark.createDataFrame(corpus(), "doc_id long, text string, source string")
    per = {r.doc_id: r.taken for r in m.mix_sources(df).collect() if r.taken}
    stream = m.mixed_stream(df).collect()
    again = defaultdict(int)
    for r in stream:
        again[r.doc_id] += len(r.text.split())
    assert dict(again) == per and [r.finish for r in stream] == sorted(r.finish for r in stream)


def test_odd_rows(docs, empty, clashing):
    rows = [(r.doc_id, r.text, r.source) for r in docs.collect()]
    got = m.mix_sources(clashing.withColumn("source", F.col("source")).drop("taken"))
    assert sum(r.taken for r in got.collect()) <= sum(len((t or "").encode().split()) for _, t, _ in rows)
    assert sorted((repr(r.doc_id), r.size) for r in m.mix_sources(docs).collect()) == sorted((repr(i), len((t or "").encode().split())) for i, t, _ in rows)
    assert m.mix_sources(empty).collect() == [] and m.mixed_stream(empty).collect() == []


def test_tables_without_words(spark):
    df = spark.createDataFrame([(1, None, None), (2, " ", "a")], "doc_id long, text string, source string")
    assert [(r.doc_id, r.size, r.target, r.taken) for r in m.mix_sources(df).orderBy("doc_id").collect()] == [(1, 0, 0.0, 0), (2, 0, 0.0, 0)]
    one = spark.createDataFrame([(None, "a b c", None)] * 3, "doc_id long, text string, source string")
    assert sum(r.taken for r in m.mix_sources(one).collect()) <= 9
