import pytest
from hypothesis import given, settings, strategies as st

from tokenloom.errors import EngineError, QuerySyntaxError, UnsupportedPattern
from tokenloom.lang import capture_mode, fields, negation_normal, parse
from tokenloom.lang.ast import And, Anything, Capture, Either, Exact, Field, Fuzzy, Hop, Look, Maybe, Not, Or, Regex, Repeat, Seq, Star, Step, Token, Walk
from tokenloom.plans.compiler import compile_query

word = lambda w: Token(Field("word", Exact(w)))
A, B, C = word("a"), word("b"), word("c")

SHAPES = {
    "a": A,
    "/a.*/": Token(Field("word", Regex("a.*"))),
    "[]": Token(Anything()),
    "[*]": Token(Anything()),
    " [ word = a ] ": A,
    "[word=a-b_c]": word("a-b_c"),
    "[word=a~]": Token(Fuzzy("word", "a")),
    "[word=/a/~]": Token(Field("word", Regex("a"))),
    "[word!=a]": Token(Not(Field("word", Exact("a")))),
    "[word!=a~]": Token(Not(Fuzzy("word", "a"))),
    "[!word=a]": Token(Not(Field("word", Exact("a")))),
    "[x=1 | y=2 & z=3]": Token(Or((Field("x", Exact("1")), And((Field("y", Exact("2")), Field("z", Exact("3"))))))),
    "[(x=1|y=2)&!z=3]": Token(And((Or((Field("x", Exact("1")), Field("y", Exact("2")))), Not(Field("z", Exact("3")))))),
    "[!(x=1)]": Token(Not(Field("x", Exact("1")))),
    "a b": Seq((A, B)),
    "a\n\tb": Seq((A, B)),
    "(a b) c": Seq((Seq((A, B)), C)),
    "a*": Repeat(A, 0, None),
    "a+?": Repeat(A, 1, None, False),
    "a ?": Repeat(A, 0, 1),
    "a??": Repeat(A, 0, 1, False),
    "a{2,3}": Repeat(A, 2, 3),
    "a{2,}?": Repeat(A, 2, None, False),
    "a{,3}": Repeat(A, 0, 3),
    "a{ , }": Repeat(A, 0, None),
    "(a b)+": Repeat(Seq((A, B)), 1, None),
    "(?<n> a)": Capture("n", A),
    "(?<n:phrase> a b)": Capture("n:phrase", Seq((A, B))),
    "a (?= b)": Seq((A, Look(True, True, B))),
    "a (?! b c)": Seq((A, Look(True, False, Seq((B, C))))),
    "(?<= a) b": Seq((Look(False, True, A), B)),
    "(?<! (?<x> a) b) c": Seq((Look(False, False, Seq((Capture("x", A), B))), C)),
    "a >x b": Hop(A, Step(True, Exact("x")), B),
    "a <x:y-z b": Hop(A, Step(False, Exact("x:y-z")), B),
    "a >> b": Hop(A, Step(True, None), B),
    "a << b": Hop(A, Step(False, None), B),
    "a >/n.*/ b": Hop(A, Step(True, Regex("n.*")), B),
    "a >x|/y/ b": Hop(A, Either((Step(True, Exact("x")), Step(True, Regex("y")))), B),
    "a >x? b": Hop(A, Maybe(Step(True, Exact("x"))), B),
    "a >x* b": Hop(A, Star(Step(True, Exact("x"))), B),
    "a >x+ b": Hop(A, Walk((Step(True, Exact("x")), Star(Step(True, Exact("x"))))), B),
    "a >x <y b": Hop(A, Walk((Step(True, Exact("x")), Step(False, Exact("y")))), B),
    "a >x": Hop(A, Step(True, Exact("x")), Token(Anything())),
    "a >x b c": Hop(A, Step(True, Exact("x")), Seq((B, C))),
    "a b >x c": Hop(Seq((A, B)), Step(True, Exact("x")), C),
    "a >x b >y c": Hop(Hop(A, Step(True, Exact("x")), B), Step(True, Exact("y")), C),
    "(a >x b) >y c": Hop(Hop(A, Step(True, Exact("x")), B), Step(True, Exact("y")), C),
    "a >x b c >y a": Hop(Hop(A, Step(True, Exact("x")), Seq((B, C))), Step(True, Exact("y")), A),
    "(?<m> a >x b)": Capture("m", Hop(A, Step(True, Exact("x")), B)),
}


@pytest.mark.parametrize("query", SHAPES)
def test_shape(query):
    assert parse(query) == SHAPES[query]


ACCEPTED = """[word=cat]
[tag=/NN.*/]
[entity=B-ENT]
[raw=The]
[word=123]
[word=/^a.*$/]
[word=/\\d+/]
[word=/[A-Z][a-z]{2,}/]
[word=/(a|b)c/]
[tag=NN & !word=cat]
[(tag=NN | tag=NNS) & (word=/a.*/ | lemma=b)]
[tag=NN&word=a|lemma=c]
[] [] []
[tag=DT] [tag=JJ]* [tag=NN]
[tag=NN]{1,}
[tag=NN]{,2}?
([tag=DT] [tag=NN])*?
the []{0,3} cat
(?<subj> [tag=NN]) [tag=VB]
(?<p:pred> [tag=VB] [tag=RB]?)
(?<!the) cat
cat (?=[] sat)
(?<=[tag=DT] [tag=JJ]) cat
[] >nsubj []
[tag=VB] >nsubj >amod [tag=JJ]
[tag=VB] >/nmod_.*/ []
[tag=VB] >obl:in []
[tag=VB] >>* []
[tag=VB] <<+ []
[tag=DT] [tag=NN] <nsubj [tag=VB] >dobj [tag=DT] [tag=NN]+
(?<a> [tag=VB]) >nsubj (?<b> [tag=NN])
((a) >x (b)) >y c""".split("\n")
REJECTED = ["", "   ", "[", "]", "[word]", "[word=]", "[=a]", "[word=a", "[word=a &]", "[word=a |]", "[! ]", "a{2}", "a{2", "a{a,b}", "(a", "a)", "()", "> x", ">nsubj a", "a >", "a > > b", "a >x{1,2} b", "(?= )", "(?<>a)", "(?<n a)", "(?<n:other> a)", "/a", "[word=/a]", "[word=/(/]", "[word=/a(?=b)/]", "[word=/(a)\\1/]", "[word=/a++/]", "a | b", "[word==a]", "[wo_rd=a]", "é", "[word=é]", "a " * 6000]


@pytest.mark.parametrize("query", ACCEPTED)
def test_accepted(query):
    parse(query)


@pytest.mark.parametrize("query", REJECTED)
def test_rejected(query):
    with pytest.raises(QuerySyntaxError):
        parse(query)


@pytest.mark.parametrize("query", ["a (b >x c)", "(a >x b)*", "a >x (?= b)", "(?= a >x b)", "(a >x b) c >y d"])
def test_unsupported(query):
    with pytest.raises(EngineError):
        compile_query(query)


def test_too_large():
    with pytest.raises(EngineError):
        compile_query("((a{60,}){60,}){60,}")
    with pytest.raises(UnsupportedPattern):
        compile_query("a [] (b >x c)")


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=40))
def test_any_text_is_read_or_refused(text):
    try:
        parse(text)
    except QuerySyntaxError:
        pass


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="ab[]()<>=!?*+{},|&~/ :x1", max_size=30))
def test_any_signs_compile_or_are_refused(text):
    try:
        compile_query(text)
    except EngineError:
        pass


def test_helpers():
    assert capture_mode("a:phrase") == ("a", "phrase") and capture_mode("a") == ("a", "token") and capture_mode("a:b") == ("a:b", "token")
    assert fields(parse("[tag=a | word=b] >x [lemma!=c~] (?=[pos=d])")) == ["lemma", "pos", "tag", "word"]
    t = parse("[!(a=1 & !(b=2 | c=3))]").test
    assert negation_normal(t) == Or((Not(Field("a", Exact("1"))), Or((Field("b", Exact("2")), Field("c", Exact("3"))))))
