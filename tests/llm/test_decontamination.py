import random
import re

from tokenloom.llm.decontamination import contaminated_pairs, decontaminate


def shingles(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    w = [x for x in re.split(r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", low) if x]
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)}


def brute(docs, items):
    out = set()
    for i, text in items:
        own = shingles(text)
        for d, doc in docs:
            shared = len(own & shingles(doc))
            if own and shared >= 0.8 * len(own) - 1e-9:
                out.add((d, i, len(own), shared))
    return out


def found(df):
    return {(r.doc_id, r.item_id, r.item_shingles, r.shared_shingles) for r in df.collect()}


def test_against_brute_force(spark):
    draw = random.Random(3)
    word = lambda: draw.choice("alpha beta gamma delta epsilon zeta eta theta".split()) + str(draw.randint(0, 40))
    items = [(i, " ".join(word() for _ in range(draw.choice([3, 5, 6, 9, 17, 33, 60])))) for i in range(60)] + [(60, None), (61, ""), (None, "a b c d e f g")]
    docs = []
    for i in range(80):
        words = [word() for _ in range(draw.randint(0, 200))]
        own = (draw.choice(items)[1] or "").split()
        for _ in range(draw.choice([0, 0, 1, 2, len(own) // 5])):
            if own:
                own[draw.randrange(len(own))] = word()
        at = draw.randint(0, len(words))
        docs.append((i, ", ".join(words[:at] + [w.upper() for w in own] + words[at:])))
    docs += [(100, None), (101, ""), (102, "x A b, c. D e f g y"), (None, items[0][1]), (3, items[5][1])]
    merged = {}
    for d, i, m, shared in brute(docs, items):
        merged[d, i, m] = max(shared, merged.get((d, i, m), 0))
    got = found(contaminated_pairs(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")))
    assert got == {(*k, v) for k, v in merged.items()} and len(got) > 20


def test_joins_by_shuffle_give_the_same(spark, monkeypatch):
    from tokenloom.llm import decontamination as d

    docs = spark.createDataFrame([(i, f"p{i} q r s t u v w x y z {i} end of it") for i in range(30)], "doc_id long, text string")
    items = spark.createDataFrame([(1, "q r s t u v w x y z"), (2, "7 end of it p7")], "item_id long, text string")
    want = found(contaminated_pairs(docs, items))
    for name in ("BROADCAST_SKETCH", "BROADCAST_ITEMS", "BROADCAST_PAIRS"):
        monkeypatch.setattr(d, name, 0)
    assert found(contaminated_pairs(docs, items)) == want and len(want) == 30


def test_odd_rows(spark, docs, empty, clashing):
    items = spark.createDataFrame([(1, "brown fox jumps over the lazy dog and"), (1, "brown fox jumps over the lazy dog and")], "item_id long, text string")
    none = items.limit(0)
    assert {r[0] for r in found(contaminated_pairs(docs, items))} == {1, 2, 3, 4}
    assert contaminated_pairs(docs, items).where("doc_id = 1").count() == 2  # equal items are each reported
    assert contaminated_pairs(empty, items).collect() == [] and contaminated_pairs(docs, none).collect() == []
    left = decontaminate(clashing, items)
    assert left.columns == clashing.columns and left.count() == docs.count() - 5
    assert decontaminate(docs, none).count() == docs.count()


def test_a_template_of_items_and_documents_does_not_pair_them_all(spark):
    """A line that all items and all documents have makes no candidates, and items that a document has are found nonetheless."""
    from pyspark.sql import functions as F

    from tokenloom.llm import decontamination as d

    template = "answer the following question with one of these letters only"
    items = [(i, template + " " + " ".join(f"own{i}x{k}" for k in range(30))) for i in range(40)]
    docs = [(i, template + " " + " ".join(f"doc{i}x{k}" for k in range(50))) for i in range(60)] + [(100 + i, "before " + t + " after") for i, t in items[::10]]
    own = spark.createDataFrame(items, "item_id long, text string").select(F.col("item_id").alias("__item"), d.shingle_hashes(d.words_of(F.col("text"))).alias("__hashes"))
    probes = spark.createDataFrame(docs, "doc_id long, text string").select("doc_id", F.explode(d.shingle_hashes(d.words_of(F.col("text")))).alias("__hash"))
    met = probes.join(d.item_sketches(own), "__hash").groupBy("doc_id", "__item").agg(F.count(F.lit(1)).alias("n"), F.max("__need").alias("need")).where("n >= need")
    assert sorted((r.doc_id, r["__item"]) for r in met.collect()) == [(100 + i, i) for i, _ in items[::10]]
    got = found(contaminated_pairs(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")))
    assert got == brute(docs, items) and len(got) == 4
