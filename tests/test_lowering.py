import random

import pytest
from pyspark.sql import functions as F

from tokenloom.operators import match, postings, relational as rel
from tokenloom.plans import candidate as c, native
from tokenloom.plans.compiler import compile_query
from tokenloom.schema import SENTENCES

FIELDS = {"word": ["the", "elm", "oak", "a|b", "", "The"], "tag": ["A", "B", "C"], "lemma": ["the", "elm", None, "ü"]}


def rows():
    draw, out = random.Random(17), []
    for i in range(160):
        n = draw.choice([0, 1, 1, 2, 3, 4, 5, 6, 9])
        edges = [{"src": draw.randrange(n), "dst": draw.randrange(n), "rel": draw.choice(["x", "y", "zz"])} for _ in range(draw.randint(0, 9))] if n else []
        graph = None if i % 13 == 5 else {"name": "dependencies", "edges": edges, "roots": [0] if n else []}
        own = {f: None if f == "lemma" and i % 11 == 0 else [draw.choice(v) for _ in range(n)] for f, v in FIELDS.items()}
        labels = lambda side: [sorted({e["rel"] for e in edges if e[side] == k}) for k in range(n)] if graph else [[] for _ in range(n)]  # noqa: E731, B023
        out.append({"split_id": i % 3, "sent_ord": i, "doc_id": f"d{i}", "sentence_id": f"d{i}_0", "sentence_length": n, **own, "graph": graph, "outgoing_edges": labels("src"), "incoming_edges": labels("dst")})
    return out


@pytest.fixture(scope="module")
def df(spark):
    return spark.createDataFrame(rows(), SENTENCES).persist()


QUERIES = [
    "the", "[tag=A]", "[tag=/[AB]/]", "[word=T~]", "[word!=the]", "[word!=T~]", "[!tag=A & word=elm]", "[tag=A | lemma=elm]", "[!(tag=A | word=oak)]", "[]", "[nosuch=x]", "[nosuch!=x]", "[word=/.*/]", "[lemma=/.?/]", "[lemma!=elm & tag=B]",
    "[tag=A] [tag=B]", "the elm", "the [] oak", "[tag=A] [] [] [tag=B]", "[tag=A] []{0,2} [tag=B]", "[tag=A] []{1,3}? [tag=C]", "[tag=A]+", "[tag=A]*", "[tag=A]+? [tag=B]", "[tag=A]+?", "[tag=A] [tag=B]{2,4}?", "(?<x> [tag=A])+?", "(?<y> [tag=C] (?<x> [tag=A]){2,}?)", "[tag=A] (?=[tag=B]+?)", "[tag=A]{2,3}", "[tag=A]{,2} [tag=C]", "[tag=A] [tag=B]? [tag=C]",
    "([tag=A] [tag=B])+", "[tag=A] (?=[tag=B])", "[tag=A] (?![tag=B])", "(?<=[tag=A]) [tag=B]", "(?<![tag=A]) [tag=B]", "(?<=[tag=A] [tag=B]) [tag=B]", "[tag=A]+ (?=[tag=B] [tag=C])", "(?<![tag=A]) [tag=B]+", "(?=[tag=A])", "(?![tag=A])",
    "(?<x> [tag=A]) (?<y:phrase> [tag=B] [])", "(?<x> [tag=A])+ [tag=B]", "[tag=A]* [tag=B]* [tag=C]* [word=elm]", "([tag=A]+ [tag=B])*", "[word=/a\\|b/]", "[word=/t.*/ & tag=A] [lemma=/ü/]",
    "[tag=A] >x [tag=B]", "[tag=A] <x [tag=B]", "[] >> []", "[] << [tag=C]", "[] >/z+/ []", "[tag=A] >x|zz [tag=B]", "[tag=A] >x? [tag=B]", "[tag=A] >x* [tag=B]", "[tag=A] >y+ [tag=B]", "[] >x >y []", "[tag=A] >x [tag=B] <y [tag=C]",
    "[tag=A] >x >y? [tag=B]", "[tag=A] [tag=B]+ >x [tag=C]", "[tag=A] >x [tag=B] [tag=C]", "[tag=A] >x", "(?<m> (?<a> [tag=A]) >x (?<b> [tag=B]))", "([tag=A] >x [tag=B]) >y [tag=C]", "[word!=the] >x? []", "[] >>+ <x [tag=A]", "[tag=A | word=elm] >x [!tag=B]",
]
LEVELS = {"the": "decided", "[tag=A] [tag=B]": "fixed", "[tag=A]+": "classes", "([tag=A]+ [tag=B])*": "matcher", "[tag=A] >x [tag=B]": "walk", "[tag=A] >x* [tag=B]": "matcher", "[tag=A]* [tag=B]* [tag=C]* [word=elm]": "matcher"}


@pytest.mark.parametrize("query", QUERIES)
def test_native_plans_agree_with_the_matcher(df, query):
    q = compile_query(query)
    plain = df.where(match.lower(q, df.columns, native_only=False).hit) if not q.decided or q.kind == "graph" else None
    ids = lambda d: sorted(r[0] for r in d.select("sentence_id").collect())
    found = ids(match.hits(df, query))
    own = match._matcher(q, df.columns, rendered=False)
    assert found == ids(df.where(own))  # candidates lose nothing
    if plain is not None:
        assert found == ids(plain)
    get = lambda native_only: sorted((r.sentence_id, repr(r.matches)) for r in match.matches(df, query, native_only).select("sentence_id", "matches").collect())
    assert get(True) == get(False)
    assert match.count(df, query) == len(found)


@pytest.mark.parametrize("query", LEVELS)
def test_level(df, query):
    assert match.lower(query, df.columns).level == LEVELS[query]
    assert LEVELS[query] in match.explain(query, df.columns)


@pytest.mark.parametrize("query", [q for q in QUERIES if "nosuch" not in q])
def test_candidates_from_postings(df, query):
    own = postings.build(df.where("sentence_length > 0")).persist()
    want = sorted(r[0] for r in match.hits(df, query).select("sent_ord").collect())
    assert sorted(r[0] for r in postings.hits(df, own, query).select("sent_ord").collect()) == want
    own.unpersist()


def test_python_only_after_the_candidate_filter(df):
    plan = match.matches(df, "[word=elm] >x* [tag=B]")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("ArrowEvalPython") < plan.index("array_contains") or "array_contains" in plan[plan.index("ArrowEvalPython") :]
    native_plan = match.hits(df, "[tag=A]+ [tag=B]")._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in native_plan and "Exchange" not in native_plan


def test_candidate_shapes():
    show = lambda q: c.show(compile_query(q).candidate)
    assert show("the elm") == '(word:the AND word:elm AND word:"the elm")'
    assert show("[tag=A | word!=x]") == "*" and show("[tag=A]* b?") == "*" and show("[tag=A]+ [x=/y./]") == "(tag:A AND x:/y./)"
    assert show("[tag=A] >x|y [tag=B]") == "(SAME(tag:A, outgoing_edges:(x OR y)) AND SAME(tag:B, incoming_edges:(x OR y)))"
    assert show("[tag=A] >x* [tag=B]") == "(SAME(tag:A) AND SAME(tag:B))" and show("[] >> []") == "*"
    assert show("[tag=A] <x? >y [] ") == "(SAME(tag:A) AND incoming_edges:(y))"
    assert postings.required_terms(compile_query("[word=the] [tag=A & lemma=b]").candidate) == [("word", "the"), ("tag", "A"), ("lemma", "b")]


def test_relational_shapes_agree(df):
    toks, arcs = rel.tokens(df), rel.edges(df)
    spans = lambda q: sorted((r.sentence_id, r.start, r.end) for r in match.spans(df, q, ("sentence_id",)).collect())
    rows_of = lambda d: sorted(tuple(r) for r in d.select("sentence_id", "start", "end").collect())
    assert rows_of(rel.adjacent(toks, "[tag=A]", "[word!=the]", "[tag=B]")) == spans("[tag=A] [word!=the] [tag=B]")
    assert rows_of(rel.runs(toks, "[tag=A]")) == spans("[tag=A]+")
    assert rows_of(rel.gap(toks, "[tag=A]", "[tag=C]", 1, 3, nearest=True)) == spans("[tag=A] []{1,3}? [tag=C]")
    for ahead in (True, False):
        for positive in (True, False):
            look = f"(?{'' if ahead else '<'}{'=' if positive else '!'}[tag=A])"
            assert rows_of(rel.beside(toks, "[tag=B]", "[tag=A]", ahead, positive)) == spans(f"[tag=B] {look}" if ahead else f"{look} [tag=B]")
    tuples = lambda q: sorted((r.sentence_id, *[s.start for s in m.spans]) for r in match.matches(df, q).collect() for m in r.matches)
    for path in (">x", "<y", ">x >y", ">>", ">x|zz", ">x? >y"):
        assert sorted(map(tuple, rel.hop(toks, arcs, "[tag=A]", path, "[tag=B]").collect())) == tuples(f"[tag=A] {path} [tag=B]")
    assert sorted(map(tuple, rel.chain(toks, arcs, "[tag=A]", ">x", "[tag=B]", "<y", "[]").collect())) == tuples("[tag=A] >x [tag=B] <y []")
    walked = sorted((r.sentence_id, m.spans[0].start, m.spans[0].end, m.spans[1].start) for r in match.matches(df, "[tag=A]+ >x [tag=B]").collect() for m in r.matches)
    assert sorted(map(tuple, rel.span_hop(rel.runs(toks, "[tag=A]"), arcs, ">x", toks, "[tag=B]").collect())) == walked
    with pytest.raises(ValueError):
        rel.step(arcs, ">x*")


def test_sql_functions(spark, df):
    match.register(spark)
    df.createOrReplaceTempView("sents")
    got = spark.sql("SELECT sentence_id, size(token_spans('[tag=A] >x* [tag=B]', sentence_length, graph.edges, array('tag'), array(tag))) n FROM sents WHERE token_hit('[tag=A] >x* [tag=B]', sentence_length, graph.edges, array('tag'), array(tag))")
    want = match.matches(df, "[tag=A] >x* [tag=B]").select("sentence_id", F.size("matches").alias("n"))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_captures_and_text(df):
    got = match.captures(df, "(?<m> (?<a:pred> [tag=A]) >x (?<b> [tag=B]))", ("sentence_id",)).collect()
    assert {r.name for r in got} == {"m", "a", "b"} and all(r.end > r.start for r in got)
    one = df.sparkSession.createDataFrame([(["a", None, "c"],)], "word array<string>")
    texts = [one.select(match.span_text(F.col("word"), F.lit(a), F.lit(b))).first()[0] for a, b in ((0, 2), (1, 9), (3, 4), (1, 1))]
    assert texts == ["a ", " c", "", ""]


def test_whole_values_only(spark):
    one = spark.createDataFrame([("elm\n",), ("elm",), ("ELM",), ("ünï",)], "v string")
    hold = lambda source: [r[0] for r in one.where(native.whole(F.col("v"), source)).collect()]
    assert hold("elm") == ["elm"] and hold("\\w+") == ["elm", "ELM", "ünï"] and hold("e|elm") == ["elm"] and hold("elm.") == []
