import random

from pyspark.sql import functions as F

from tokenloom.functions import encodings as e


def parts(text, sep):
    """Split at separators that aren't escaped, read one character at a time."""
    out, now, i = [], "", 0
    while i < len(text):
        if text[i] == "\\" and i + 1 < len(text):
            now += text[i : i + 2]
            i += 2
        elif text[i] == sep:
            out.append(now)
            now, i = "", i + 1
        else:
            now += text[i]
            i += 1
    return [*out, now]


def plain(text):
    out, i = "", 0
    while i < len(text):
        if text[i] == "\\":
            i += 1
            out += text[i : i + 1]
        else:
            out += text[i]
        i += 1
    return out


def test_encodings_against_a_character_loop(spark):
    draw = random.Random(2)
    texts = ["".join(draw.choice("ab\\|,\n") for _ in range(draw.randint(0, 12))) for _ in range(800)] + ["", "\\", "|", "a|", "\\|", "\\\\|a", "a\\|b|c||"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    t = F.col("t")
    for r in df.select("t", e.split_escaped(t, "|").alias("bar"), e.split_escaped(t, ",").alias("comma"), e.unescape(t).alias("plain"), e.unescape(e.escape(t)).alias("same")).collect():
        assert r.bar == parts(r.t, "|") and r.comma == parts(r.t, ",") and r.plain == plain(r.t) and r.same == r.t, r


def test_round_trips(spark):
    draw = random.Random(3)
    word = lambda: "".join(draw.choice("ab\\|,") for _ in range(draw.randint(0, 4)))
    rows = [([word() for _ in range(draw.randint(2, 6))], [[word() or "x" for _ in range(draw.randint(0, 3))] for _ in range(draw.randint(2, 5))]) for _ in range(300)]
    df = spark.createDataFrame(rows, "toks array<string>, slots array<array<string>>")
    for r in df.select("toks", e.decode_tokens(e.encode_tokens(F.col("toks"))).alias("t"), "slots", e.decode_edges(e.encode_edges(F.col("slots"))).alias("s")).collect():
        assert r.t == r.toks and r.s == r.slots
    one = spark.createDataFrame([("",)], "v string").select(e.decode_tokens(F.col("v")), e.decode_edges(F.col("v")), e.decode_tokens_legacy(F.lit("a|\ue000|b"))).first()
    assert tuple(one) == ([], [], ["a", "", "b"])


def test_graph_functions(spark):
    edges = [(1, 0, "nsubj"), (1, 2, "dobj"), (1, 2, "dobj"), (2, 2, "self"), (3, 2, "a")]
    df = spark.createDataFrame([(4, [dict(zip(("src", "dst", "rel"), x, strict=True)) for x in edges], [1])], "n int, edges array<struct<src:int,dst:int,rel:string>>, roots array<int>")
    n, g, roots = F.col("n"), F.col("edges"), F.col("roots")
    out, into = e.edge_slots(n, g, roots)
    heads = e.heads(n, g)
    r = df.select(out.alias("o"), into.alias("i"), e.labels_out(n, g).alias("lo"), F.size(e.distinct_edges(g)).alias("d"), heads.alias("h"), e.children(heads).alias("c"), e.backbone_roots(heads).alias("r"), e.subtree(heads, F.lit(1)).alias("s"), e.is_acyclic(heads).alias("ok"), e.outgoing(n, g).alias("out"), e.incoming(n, g).alias("inc"), e.is_acyclic(F.array(F.lit(1), F.lit(0))).alias("cyclic")).first()
    assert r.o == [[], ["dobj", "nsubj"], ["self"], ["a"]] and r.i == [["nsubj"], ["root"], ["a", "dobj", "self"], []] and r.lo[1] == ["nsubj", "dobj", "dobj"] and r.d == 4
    assert r.h == [1, -1, 1, -1] and r.c == [[], [0, 2], [], []] and r.r == [1, 3] and r.s == [0, 1, 2] and r.ok and not r.cyclic
    assert [len(x) for x in r.out] == [0, 3, 1, 1] and [len(x) for x in r.inc] == [1, 0, 4, 0]
    assert df.select(e.heads(n, g, F.filter(g, lambda x: x["rel"] == "a"))).first()[0] == [1, -1, 3, -1]


def test_slot_terms_and_dictionaries(spark):
    df = spark.createDataFrame([("k", "a||b", "x,y,x||z")], "k string, v string, m string")
    assert sorted(map(tuple, e.slot_terms(df, F.col("v"), False, ("k",)).collect())) == [("k", 0, "a"), ("k", 2, "b")]
    assert sorted(map(tuple, e.slot_terms(df, F.col("m"), True, ("k",)).collect())) == [("k", 0, "x"), ("k", 0, "y"), ("k", 2, "z")]
    words = spark.createDataFrame([(w,) for w in "b a a c c".split()] + [("",), (None,)], "w string")
    d = e.frequencies(words, F.col("w"))
    assert [tuple(r) for r in d.orderBy("id").collect()] == [("a", 2, 1), ("c", 2, 2), ("b", 1, 3)]
    assert sorted(map(tuple, e.with_ids(words.na.drop().distinct(), "w", d).select("w", "id").collect())) == [("", 0), ("a", 1), ("b", 3), ("c", 2)]
    assert [tuple(r) for r in e.merge_dictionaries(d, d.where("term = 'b'")).orderBy("id").collect()] == [("a", 2, 1), ("b", 2, 2), ("c", 2, 3)]
    rows = spark.createDataFrame([(["a"], None)], "word array<string>, tag array<string>")
    assert e.present_fields(rows).first().present == ["word"] and e.to_json_row(rows).first().value == '{"word":["a"]}'


def test_ranks_of_many_terms(spark):
    draw = random.Random(6)
    words = ["".join(draw.choice("abcé") for _ in range(draw.randint(1, 6))) for _ in range(3000)]
    counts = {w: words.count(w) for w in set(words)}
    want = [(w, counts[w], k) for k, w in enumerate(sorted(counts, key=lambda w: (-counts[w], w.encode())), 1)]
    got = e.frequencies(spark.createDataFrame([(w,) for w in words], "w string"), F.col("w"))
    assert [tuple(r) for r in got.orderBy("id").collect()] == want
