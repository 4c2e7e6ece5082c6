"""The sentences made by arrays against the rules told token by token."""

import regex
from pyspark.sql import functions as F

from tokenloom.sources import fixtures
from tokenloom.sources.fixtures import annotate, sentences, tag

TOKEN = regex.compile(r"[\p{L}\p{N}]+|[^ \t\n\x0b\f\r\p{L}\p{N}]")
LABEL = {"DT": "det", "IN": "case", "RB": "advmod", "CC": "cc", "PUNCT": "punct", "SYM": "punct"}


def edges(tags):
    n, noun = len(tags), [t.startswith("NN") for t in tags]
    root = next((i for i, t in enumerate(tags) if t[0] == "V"), 0)
    out = []
    for i, t in enumerate(tags):
        if i == root:
            continue
        chained = noun[i] and i > 0 and noun[i - 1]
        src = (i + 1 if i + 1 < n else root) if t in ("DT", "IN") else i - 1 if chained and i > root else root
        out.append((src, i, LABEL.get(t) or ("conj" if t[0] == "V" else "nsubj" if i < root else "compound" if chained else "dobj")))
    return out + [(i, 0, "ref") for i, t in enumerate(tags) if i and t == "NNP"], root


def runs(inside, name):
    return [("I-" if i and inside[i - 1] else "B-") + name if x else "O" for i, x in enumerate(inside)]


def plain(doc_id, text):
    for ln, line in enumerate(text.split("\n")):
        for sn, part in enumerate(line.split(".")):
            if not (word := TOKEN.findall(part)):
                continue
            tags, low = [tag(w) for w in word], [w.lower() for w in word]
            arcs, root = edges(tags)
            out, into = [{r for a, _, r in arcs if a == i} for i in range(len(word))], [{r for _, b, r in arcs if b == i} | ({"root"} if i == root else set()) for i in range(len(word))]
            yield (
                doc_id, f"{doc_id}_{ln}_{sn}", ln * 100000 + sn, len(word), word, low, [t[:2] for t in tags], tags, runs([t == "NNP" for t in tags], "ENT"), runs([t in ("DT", "CD") or t[:2] == "NN" for t in tags], "NP"),
                low, word, [sorted(x) for x in out], [sorted(x) for x in into], ("dependencies", arcs, [root]),
            )


TEXTS = [
    "The Big Dogs quickly chased a cat and ran to Paris. He was, in 1999, of the!\n\nIs it. .. ok", "", None, "..\n.\n\n", "the\n", "Le gat½ x²_y z.\r\nGroße Häuser und die Ünï ünter\x0btab  von", "one two three Four Five walking\nof",
    "naïve İstanbul ΣΑΣ 12 ３ ١٢ . 日本 语s ed ing ly", "a.b.c\n" * 40, "The Cat and The Dog sees Paris London Rome jumped over it " * 30,
]


def rows(df):
    got = df.select(*[c for c in df.columns if c not in ("graph", "split_id")], F.col("graph.name").alias("g"), F.transform("graph.edges", lambda e: F.array(e["src"].cast("string"), e["dst"].cast("string"), e["rel"])).alias("e"), F.col("graph.roots").alias("r")).collect()
    return sorted((*r[:-3], (r["g"], [(int(a), int(b), c) for a, b, c in r["e"]], r["r"])) for r in got)


def test_sentences_follow_the_rules(spark, monkeypatch):
    want = sorted(x for d, t in enumerate(TEXTS) for x in plain(str(d), t or ""))
    df = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string").coalesce(1)
    assert rows(annotate(df)) == want
    monkeypatch.setattr(fixtures, "PIECE", 20)  # texts in pieces of a few lines
    pieces = [p for d, t in enumerate(TEXTS) for p in fixtures._pieces(str(d), t or "")]
    assert len(pieces) > len(TEXTS) and sum(b.num_rows for p in pieces if (b := fixtures._sentences([p])) is not None) == len(want)
    ids = [x for p in pieces if (b := fixtures._sentences([p])) is not None for x in b.column(1).to_pylist()]
    assert sorted(ids) == sorted(x[1] for x in want)


def test_partitions_follow_the_size_of_the_table(spark, tmp_path, monkeypatch):
    spark.createDataFrame([(i, f"the dog {i} ran. a cat slept") for i in range(400)], "doc_id long, text string").write.parquet(f"{tmp_path}/t/documents.parquet")
    size = sum(f.stat().st_size for f in (tmp_path / "t/documents.parquet").glob("*.parquet"))
    monkeypatch.setattr(fixtures, "PART_BYTES", size // 20)
    df = sentences(spark, f"{tmp_path}/t")
    assert len(df.inputFiles()) >= 15 and df.count() == 800
    assert df.columns[:8] == ["doc_id", "sentence_id", "sent_ord", "sentence_length", "word", "lemma", "pos", "tag"]
