import random
from collections import defaultdict

import numpy as np
import pytest

from tokenloom.llm import jaccard_join as j
from tokenloom.llm.components import components


def brute(rows, threshold=0.8):
    """Of each row its class, copies and links."""
    texts = defaultdict(list)
    for i, t in rows:
        texts[t or ""].append(i)
    nodes = {t: min((i for i in ids if i is not None), default=None) for t, ids in texts.items()}
    keys = list(nodes)
    sets = {t: set(j.shingles(t.encode("utf-8", "replace")).tolist()) for t in keys}
    up, links = {t: t for t in keys}, defaultdict(int)

    def root(t):
        while up[t] != t:
            t = up[t]
        return t

    for x in range(len(keys)):
        for y in range(x):
            a, b = keys[x], keys[y]
            shared = len(sets[a] & sets[b])
            if shared and shared >= threshold * len(sets[a] | sets[b]) - 1e-9 and nodes[a] is not None and nodes[b] is not None:
                links[a] += 1
                links[b] += 1
                up[root(a)] = root(b)
    low = defaultdict(list)
    for t in keys:
        low[root(t)].append(nodes[t])
    best = {r: min((i for i in ids if i is not None), default=None) for r, ids in low.items()}
    return sorted(((i, best[root(t or "")], len(texts[t or ""]), links[t or ""]) for i, t in rows), key=repr)


def found(df):
    return sorted((tuple(r) for r in df.select("doc_id", *j.MADE).collect()), key=repr)


def corpus(n, seed):
    draw = random.Random(seed)
    word = lambda: "w" + str(draw.randint(0, 5000))
    rows = []
    while len(rows) < n:
        base = [word() for _ in range(draw.choice([3, 8, 40, 120]))]
        for _ in range(draw.choice([1, 1, 2, 6, 25])):
            own = list(base)
            for _ in range(draw.choice([0, 0, 1, 1, 2, 9])):
                own[draw.randrange(len(own))] = word()
            rows.append((len(rows), " ".join(own)))
    draw.shuffle(rows)
    return rows


@pytest.mark.parametrize("block", [512, 3])
def test_against_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(j, "BLOCK", block)
    rows = corpus(260, block)
    got = found(j.similar_classes(spark.createDataFrame(rows, "doc_id long, text string")))
    assert got == brute(rows) and max(r[3] for r in got) >= 4


def test_one_large_group(spark, monkeypatch):
    monkeypatch.setattr(j, "BLOCK", 16)
    monkeypatch.setattr(j, "BROADCAST_NODES", 0)
    rows = [(i, " ".join(f"x{k}" if k != i else f"y{i}" for k in range(100))) for i in range(90)] + [(1000 + i, "copy of a text that many have today") for i in range(50)]
    assert found(j.similar_classes(spark.createDataFrame(rows, "doc_id long, text string"))) == brute(rows)


def test_odd_rows(spark, docs, empty, clashing):
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    want = brute(rows)
    assert found(j.similar_classes(docs)) == want == found(j.similar_classes(clashing))
    assert j.similar_classes(empty).collect() == []
    left = j.drop_near_duplicates(clashing)
    keep = {i for i, c, _, _ in want if i is None or i == c}
    assert left.columns == clashing.columns and {r.doc_id for r in left.collect()} == keep
    assert j.drop_near_duplicates(empty).collect() == []


def test_recall_at_the_threshold():
    d = j.depth()
    assert 1 - (1 - 0.8**d) ** j.TREES >= j.RECALL > 1 - (1 - 0.8 ** (d + 1)) ** j.TREES
    draw = np.random.default_rng(5)
    forest, hit = j.Forest(), 0
    for _ in range(300):
        shared, a, b = (np.unique(draw.integers(1 << 62, size=n, dtype=np.uint64)) for n in (400, 50, 50))
        pair = forest.prefixes([np.union1d(shared, a), np.union1d(shared, b)])
        hit += bool((pair[0] == pair[1]).any())
    assert hit == 300


def test_common_counts(monkeypatch):
    draw = np.random.default_rng(2)
    sets = [np.unique(draw.integers(60, size=draw.integers(0, 90), dtype=np.uint64)) for _ in range(40)]
    for rare in (1, 5, 24):
        monkeypatch.setattr(j, "RARE", rare)
        got = j.common_counts(sets)
        for a in range(40):
            for b in range(40):
                assert got[a, b] == (len(np.intersect1d(sets[a], sets[b])) if a < b else 0)


@pytest.mark.parametrize("bound", [0, 400_000])
def test_components(spark, monkeypatch, bound):
    from tokenloom.llm import components as c

    monkeypatch.setattr(c, "BROADCAST_EDGES", bound)
    edges = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 160)] + [(200, 201), (201, 202), (202, 200), (7, 7)]
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(41)} | {i: 100 for i in range(100, 160)} | {200: 200, 201: 200, 202: 200}
    assert components(spark.createDataFrame([], "a long, b long")).collect() == []


def test_prefixes_are_shortened_as_far_as_the_sizes_ask():
    forest = j.Forest()
    assert forest.depths(1) == forest.depths(3) == (j.MAX_DEPTH,) and forest.depths(500) == (j.depth(),)
    for n in range(1, 150):
        for m in range(n, 190):
            attained = [k / (n + m - k) for k in range(1, n + 1) if k / (n + m - k) >= 0.8 - 1e-9]
            if attained:
                met = set(forest.depths(n)) & set(forest.depths(m))
                assert met and any(1 - (1 - min(attained) ** d) ** j.TREES >= j.RECALL for d in met)


def test_recall_of_random_pairs_of_all_sizes():
    draw, forest, hits, pairs = np.random.default_rng(8), j.Forest(), 0, 0
    while pairs < 400:
        n = int(draw.integers(1, 120))
        every = np.unique(draw.integers(1 << 62, size=n + 40, dtype=np.uint64))
        cut = int(draw.integers(0, max(1, n // 4) + 1))
        a, b = every[:n], every[cut : cut + n]
        if len(np.intersect1d(a, b)) < 0.8 * len(np.union1d(a, b)):
            continue
        pairs += 1
        keys = forest.prefixes([np.sort(a), np.sort(b)])
        hits += bool(np.intersect1d(keys[0], keys[1]).size)
    assert hits >= 0.99 * pairs


@pytest.mark.parametrize("kind", ["long", "string"])
def test_identifiers_that_repeat_or_are_null_or_no_numbers(spark, kind):
    a, b = (" ".join(f"{x}{k}" for k in range(60)) for x in "ab")
    rows = [(1, a), (1, b), (2, a + " end"), (3, b + " end"), (None, a + " other")]
    df = spark.createDataFrame([(None if i is None else i if kind == "long" else f"d{i}", t) for i, t in rows], f"doc_id {kind}, text string")
    got = {(r.doc_id, r.class_id, r.n_links) for r in j.similar_classes(df).collect()}
    one = 1 if kind == "long" else "d1"
    assert {(i, n) for i, _, n in got} == {(one, 2), (one, 1), (2 if kind == "long" else "d2", 2), (3 if kind == "long" else "d3", 1), (None, 2)} and {c for _, c, _ in got} == {one}


def test_a_component_that_chance_has_joined_is_parted(spark, monkeypatch):
    """Chains of texts, each near its neighbours only: one component, whose subtries are small."""
    monkeypatch.setattr(j, "BLOCK", 8)
    words = [f"c{k}" for k in range(700)]
    rows = [(i, " ".join(words[3 * i : 3 * i + 100])) for i in range(150)]
    assert found(j.similar_classes(spark.createDataFrame(rows, "doc_id long, text string"))) == brute(rows)
