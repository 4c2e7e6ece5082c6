"""Patterns as plain columns: conditions and spans that Spark evaluates itself, without Python.

A sentence is a row with aligned token arrays; position i of a field that isn't there reads as an empty string, never null.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable
from dataclasses import dataclass

from pyspark.sql import Column, functions as F

from ..lang.ast import And, Anything, Capture, Constraint, Either, Exact, Field, Fuzzy, Look, Maybe, Not, Or, Path, Pattern, Regex, Repeat, Seq, Star, Step, Token
from ..match.graph import Plan
from ..match.surface import MAX_SPANS, leaf_holds
from . import candidate as c

#: Limits beyond which the native forms give way to the matcher: tokens of a fixed pattern, tests in a class string, steps of a walk, ways through it.
MAX_FIXED, MAX_CLASSES, MAX_STEPS, MAX_WAYS = 32, 7, 4, 12

ValueAt = Callable[[str], Column]


def whole(value: Column, source: str) -> Column:
    """The whole value matches: Unicode classes, a dot for anything but a newline, no trailing newline let through."""
    return value.rlike(rf"(?Ud)\A(?:{source})\z")


def leaf(test: Field | Fuzzy, value: Column) -> Column:
    if isinstance(test, Fuzzy):
        return F.contains(F.lower(value), F.lit(test.text.lower()))
    return value == F.lit(test.value.text) if isinstance(test.value, Exact) else whole(value, test.value.source)


def holds(test: Constraint, at: ValueAt) -> Column:
    if isinstance(test, Anything):
        return F.lit(True)
    if isinstance(test, Not):
        return ~holds(test.of, at)
    if isinstance(test, And | Or):
        out = holds(test.parts[0], at)
        for p in test.parts[1:]:
            out = out & holds(p, at) if isinstance(test, And) else out | holds(p, at)
        return out
    return leaf(test, at(test.name))


class Row:
    """The columns of a sentences table that conditions are written over."""

    def __init__(self, columns: Iterable[str]):
        self.columns = set(columns)
        self.n = F.col("sentence_length")

    def values(self, field: str) -> Column | None:
        return F.col(field) if field in self.columns else None

    def at(self, i: Column) -> ValueAt:
        return lambda field: F.coalesce(F.get(F.col(field), i), F.lit("")) if field in self.columns else F.lit("")

    def positions(self) -> Column:
        """0 to n - 1; sequence() would count down for an empty sentence."""
        return F.when(self.n > 0, F.sequence(F.lit(0), self.n - 1)).otherwise(F.array().cast("array<int>"))

    # ---- candidates

    def some(self, test: Constraint) -> Column:
        """Some token holds the test."""
        names = {x.name for x in _leaves(test)}
        if len(names) == 1 and not _on_empty(test):
            values = self.values(next(iter(names)))
            if values is None:
                return F.lit(False)
            if isinstance(test, Field) and isinstance(test.value, Exact):
                return F.coalesce(F.array_contains(values, F.lit(test.value.text)), F.lit(False))
            return F.coalesce(F.exists(values, lambda x: holds(test, lambda _: F.coalesce(x, F.lit("")))), F.lit(False))
        return F.exists(self.positions(), lambda i: holds(test, self.at(i)))

    def label_at(self, want: c.HasLabel, i: Column | None) -> Column:
        if want.side not in self.columns:
            return F.lit(True)
        slots = F.col(want.side)
        labels = F.flatten(slots) if i is None else F.get(slots, i)
        if all(isinstance(x, Exact) for x in want.labels):
            own = F.arrays_overlap(labels, F.array(*[F.lit(x.text) for x in want.labels]))
        else:
            own = F.exists(labels, lambda r: label(want.labels, r))
        return F.coalesce(own, F.lit(False))

    def candidate(self, want: c.Candidate) -> Column:
        if isinstance(want, c.All):
            return F.lit(True)
        if isinstance(want, c.Has):
            return self.some(want.leaf)
        if isinstance(want, c.HasLabel):
            return self.label_at(want, None)
        if isinstance(want, c.HasPhrase):
            tests = [Field(want.field, Exact(t)) for t in want.terms]
            return F.exists(self.positions(), lambda i: _all(holds(t, self.at(i + k)) for k, t in enumerate(tests)))
        if isinstance(want, c.SameToken):
            if not want.labels and len(want.tests) == 1:
                return self.some(want.tests[0])
            return F.exists(self.positions(), lambda i: _all([*(holds(t, self.at(i)) for t in want.tests), *(self.label_at(x, i) for x in want.labels)]))
        parts = sorted(want.parts, key=_cost)  # cheap ones first: the rest isn't looked at where they fail
        out = self.candidate(parts[0])
        for p in parts[1:]:
            out = out & self.candidate(p) if isinstance(want, c.AllOf) else out | self.candidate(p)
        return out

    # ---- sequences of fixed length

    def starts(self, shape: Fixed) -> Column:
        return F.filter(self.positions(), lambda i: self.starts_at(shape, i))

    def starts_at(self, shape: Fixed, i: Column) -> Column:
        parts = [i + F.lit(len(shape.tests)) <= self.n] if len(shape.tests) > 1 else []
        parts += [holds(t, self.at(i + k if k else i)) for k, t in enumerate(shape.tests) if not isinstance(t, Anything)]
        for look, k in shape.looks:
            start = i + F.lit(k if look.ahead else k - 1)
            own = _all([start >= 0, start + F.lit(len(look.tests)) <= self.n, *(holds(t, self.at(start + j)) for j, t in enumerate(look.tests))])
            parts.append(own if look.positive else ~own)
        return _all(parts)

    def fixed_hit(self, shape: Fixed) -> Column:
        return F.exists(self.positions(), lambda i: self.starts_at(shape, i))

    def fixed_spans(self, shape: Fixed, cap: int | None = MAX_SPANS) -> Column:
        """Spans with captures, as the matcher gives them."""
        def span(i: Column) -> Column:
            made = [F.struct(F.lit(name).alias("name"), (i + a).cast("int").alias("start"), (i + b).cast("int").alias("end")) for name, a, b in shape.captures]
            captures = F.array(*made) if made else F.array().cast("array<struct<name:string,start:int,end:int>>")
            return F.struct(i.cast("int").alias("start"), (i + len(shape.tests)).cast("int").alias("end"), captures.alias("captures"))

        return F.transform(_first(self.starts(shape), cap), span)

    # ---- longest runs of one test

    def run_spans(self, shape: Run, cap: int | None = MAX_SPANS) -> Column:
        """The longest runs of tokens that hold the test; starts and ends of runs come in the same order."""
        def spans(flags: Column) -> Column:
            at = lambda i: F.coalesce(F.get(flags, i), F.lit(False))
            starts = F.filter(self.positions(), lambda i: at(i) & ~at(i - 1))
            ends = F.filter(self.positions(), lambda i: at(i) & ~at(i + 1))
            made = lambda a, b: [F.struct(F.lit(name).alias("name"), a.alias("start"), b.alias("end")) for name in shape.names]
            captures = lambda a, b: F.array(*made(a, b)) if shape.names else F.array().cast("array<struct<name:string,start:int,end:int>>")
            own = F.zip_with(starts, ends, lambda a, b: F.struct(a.cast("int").alias("start"), (b + 1).cast("int").alias("end"), captures(a.cast("int"), (b + 1).cast("int")).alias("captures")))
            return _first(F.filter(own, lambda s: s["end"] - s["start"] >= shape.least), cap)

        flags = F.transform(self.positions(), lambda i: holds(shape.test, self.at(i)))
        return F.element_at(F.transform(F.array(flags), spans), 1)  # the flags are worked out once

    # ---- sequences with repetitions: one letter a token, then a regular expression over the letters

    def class_hit(self, shape: ClassString) -> Column:
        letters = F.array(*[F.lit(chr(_LETTERS + bits)) for bits in range(1 << len(shape.tests))])

        def letter(i: Column) -> Column:
            bits = F.lit(1)
            for k, t in enumerate(shape.tests):
                bits = bits + F.when(holds(t, self.at(i)), 1 << k).otherwise(0)
            return F.element_at(letters, bits)

        return F.array_join(F.transform(self.positions(), letter), "").rlike(shape.source)

    # ---- traversals

    def walk_hit(self, ways: list[list[list[Step]]], p: Plan, edges: Column) -> Column:
        """Some chain of edges leads through the endpoints. ways: of each walk, the sequences of steps that it allows."""
        def onward(i: int, u: Column) -> Column:
            """The chain goes on from endpoint i at token u, which holds its test."""
            if i == len(p.walks):
                return F.lit(True)
            return _any(steps(i, way, u) for way in ways[i])

        def arrive(i: int, u: Column) -> Column:
            return holds(p.endpoints[i].test, self.at(u)) & onward(i, u)

        def steps(i: int, way: list[tuple[Step, ...]], u: Column) -> Column:
            if not way:
                return arrive(i + 1, u)
            return F.exists(edges, lambda e: _step(way[0], e, u) & steps(i, way[1:], _far(way[0], e)))

        def first(way: list[tuple[Step, ...]]) -> Column:
            start = p.endpoints[0].test
            if not way:
                return F.exists(self.positions(), lambda u: holds(start, self.at(u)) & arrive(1, u))
            return F.exists(edges, lambda e: _labelled(way[0], e) & holds(start, self.at(_near(way[0], e))) & steps(0, way[1:], _far(way[0], e)))

        return F.coalesce(_any(first(way) for way in ways[0]), F.lit(False)) & edges.isNotNull()


    def walk_tuples(self, ways: list[list[list[Step]]], p: Plan, edges: Column, cap: int | None) -> Column:
        """The first cap (None: all) of the distinct tuples of tokens, one for each endpoint, in order, as structs of t0, t1, ...

        The edges that can be a step (by label, and by the endpoints' tests where it is the first or the last of its walk) are found once
        a sentence, so a chain looks through these only.
        """
        none = F.array().cast("array<struct<" + ",".join(f"t{k}:int" for k in range(len(p.endpoints))) + ">>")
        test = lambda i: p.endpoints[i].test
        wanted = list(dict.fromkeys((i, way[k], k == 0 and i == 0, k == len(way) - 1) for i, own in enumerate(ways) for way in own for k in range(len(way))))

        def own(key: tuple) -> Column:
            i, step, first, last = key
            def fits(e: Column) -> Column:
                return _all([_labelled(step, e), *([holds(test(i), self.at(_near(step, e)))] if first else []), *([holds(test(i + 1), self.at(_far(step, e)))] if last else [])])

            return F.filter(edges, fits)

        def tuples(having: dict) -> Column:
            def onward(i: int, u: Column, so_far: list[Column]) -> Column:
                """Tuples that go on from endpoint i at token u, which holds its test."""
                if i == len(p.walks):
                    return F.array(F.struct(*[t.cast("int").alias(f"t{k}") for k, t in enumerate(so_far)]))
                return _concat([steps(i, way, 0, u, so_far) for way in ways[i]])

            def steps(i: int, way: list[tuple[Step, ...]], k: int, u: Column | None, so_far: list[Column]) -> Column:
                """u is None at the very first step, which may begin anywhere."""
                if not way:
                    return F.when(holds(test(i + 1), self.at(u)), onward(i + 1, u, [*so_far, u])).otherwise(none)
                step, last = way[k], k == len(way) - 1
                some = having[i, step, k == 0 and i == 0, last]
                some = some if u is None else F.filter(some, lambda e: _near(step, e) == u)

                def go(e: Column) -> Column:
                    before, far = so_far or [_near(step, e)], _far(step, e)
                    return onward(i + 1, far, [*before, far]) if last else steps(i, way, k + 1, far, before)

                return F.flatten(F.transform(some, go))

            def first(way: list[tuple[Step, ...]]) -> Column:
                if not way:
                    return F.flatten(F.transform(F.filter(self.positions(), lambda u: holds(test(0), self.at(u))), lambda u: steps(0, [], 0, u, [u])))
                return steps(0, way, 0, None, [])

            return _bound(F.sort_array(_concat([first(way) for way in ways[0]])), _once)

        def bind(left: list, having: dict) -> Column:
            return _bound(own(left[0]), lambda found: bind(left[1:], having | {left[0]: found})) if left else tuples(having)

        return _first(bind(wanted, {}), cap)


def _bound(value: Column, then: Callable[[Column], Column]) -> Column:
    """then(value), with value worked out once however often it is used."""
    return F.element_at(F.transform(F.array(value), then), 1)


def _once(found: Column) -> Column:
    """The distinct ones of a sorted array: array_distinct compares each struct with all others."""
    return F.filter(found, lambda t, i: (i == 0) | ~t.eqNullSafe(F.get(found, i - 1)))


def _first(found: Column, cap: int | None) -> Column:
    return found if cap is None else F.slice(found, 1, cap)


def _concat(parts: list[Column]) -> Column:
    return parts[0] if len(parts) == 1 else F.concat(*parts)


def _near(step: tuple[Step, ...], e: Column) -> Column:
    return e["src"] if step[0].out else e["dst"]


def _far(step: tuple[Step, ...], e: Column) -> Column:
    return e["dst"] if step[0].out else e["src"]


def _labelled(step: tuple[Step, ...], e: Column) -> Column:
    return F.lit(True) if any(s.label is None for s in step) else label([s.label for s in step], e["rel"])


def _step(step: tuple[Step, ...], e: Column, u: Column) -> Column:
    return (_near(step, e) == u) & _labelled(step, e)


def label(labels: Iterable[Exact | Regex], rel: Column) -> Column:
    labels = list(labels)
    plain, other = [x.text for x in labels if isinstance(x, Exact)], [x.source for x in labels if isinstance(x, Regex)]
    return _any([*([rel.isin(plain) if len(plain) > 1 else rel == plain[0]] if plain else []), *(whole(rel, s) for s in other)])


def _all(parts: Iterable[Column]) -> Column:
    out = None
    for p in parts:
        out = p if out is None else out & p
    return F.lit(True) if out is None else out


def _any(parts: Iterable[Column]) -> Column:
    out = None
    for p in parts:
        out = p if out is None else out | p
    return F.lit(False) if out is None else out


def _leaves(test: Constraint):
    from ..lang.ast import leaves

    return leaves(test)


def _on_empty(test: Constraint) -> bool:
    """Whether a token that isn't there would hold the test."""
    if isinstance(test, Anything):
        return True
    if isinstance(test, Not):
        return not _on_empty(test.of)
    if isinstance(test, And):
        return all(_on_empty(t) for t in test.parts)
    if isinstance(test, Or):
        return any(_on_empty(t) for t in test.parts)
    return leaf_holds(test, "")


def _cost(want: c.Candidate) -> int:
    if isinstance(want, c.Has):
        return 0 if isinstance(want.leaf, Field) and isinstance(want.leaf.value, Exact) else 2
    return {c.HasLabel: 1, c.AnyOf: 3, c.SameToken: 4, c.HasPhrase: 5}.get(type(want), 6)


# ---- shapes


@dataclass(frozen=True)
class FixedLook:
    ahead: bool
    positive: bool
    tests: tuple[Constraint, ...]


@dataclass(frozen=True)
class Fixed:
    """A pattern whose matches have one length and one reading."""

    tests: tuple[Constraint, ...]
    looks: tuple[tuple[FixedLook, int], ...]
    captures: tuple[tuple[str, int, int], ...]


def fixed(p: Pattern) -> Fixed | None:
    """The fixed shape of a sequence without choices, or None."""
    tests: list[Constraint] = []
    looks: list[tuple[FixedLook, int]] = []
    captures: list[tuple[str, int, int]] = []

    def put(q: Pattern) -> bool:
        if isinstance(q, Token):
            tests.append(q.test)
            return len(tests) <= MAX_FIXED
        if isinstance(q, Seq):
            return all(put(i) for i in q.items)
        if isinstance(q, Capture):
            start = len(tests)
            if not put(q.of):
                return False
            captures.append((q.name, start, len(tests)))
            return True
        if isinstance(q, Look):
            inner = fixed(q.of)
            if inner is None or inner.looks:
                return False
            looks.append((FixedLook(q.ahead, q.positive, inner.tests), len(tests)))
            return True
        return False

    return Fixed(tuple(tests), tuple(looks), tuple(captures)) if put(settled(p)) else None


def settled(p: Pattern) -> Pattern:
    """p with a lazy repetition at its end written out: nothing comes after it, so it never goes more rounds than it must."""
    if isinstance(p, Seq) and p.items:
        return Seq((*p.items[:-1], settled(p.items[-1])))
    if isinstance(p, Capture):
        return Capture(p.name, settled(p.of))
    if isinstance(p, Repeat) and not p.greedy and 1 <= p.least <= MAX_FIXED:
        return Seq((p.of,) * p.least)
    return p


@dataclass(frozen=True)
class Run:
    """A greedy repetition of one test without an upper limit: its matches are the longest runs, as these win over what they overlap."""

    test: Constraint
    least: int
    names: tuple[str, ...]  # captures of the whole, inner ones first


def run(p: Pattern) -> Run | None:
    names: list[str] = []
    while isinstance(p, Capture):
        names.insert(0, p.name)
        p = p.of
    if isinstance(p, Repeat) and p.greedy and p.least and p.most is None and isinstance(p.of, Token):
        return Run(p.of.test, p.least, tuple(names))
    return None


@dataclass(frozen=True)
class ClassString:
    tests: tuple[Constraint, ...]
    source: str


#: First of the letters that stand for sets of tests; plain letters, none of which means anything in an expression.
_LETTERS = 0x4E00


def class_string(p: Pattern) -> ClassString | None:
    """A regular expression over one letter a token that finds a match wherever the pattern does; None if it could be slow.

    Whether there is a match doesn't depend on preferences, so a backtracking engine answers as the matcher does. Repetitions inside repetitions,
    and more than two without limit, could take very long in such an engine and are left to the matcher.
    """
    tests: list[Constraint] = []
    open_ended = 0

    def letters(t: Constraint) -> str:
        if isinstance(t, Anything):
            return "."
        if t not in tests:
            tests.append(t)
        return f"<{tests.index(t)}>"

    def put(q: Pattern, repeated: bool) -> str | None:
        nonlocal open_ended
        if isinstance(q, Token):
            return letters(q.test)
        if isinstance(q, Capture):
            return put(q.of, repeated)
        if isinstance(q, Seq):
            parts = [put(i, repeated) for i in q.items]
            return None if None in parts else "".join(parts)
        if isinstance(q, Look):
            inner = put(q.of, repeated)
            sign = "=" if q.positive else "!"
            return None if inner is None else f"(?{sign}{inner})" if q.ahead else f"(?<{sign}(?={inner}).)"
        if isinstance(q, Repeat):
            inner = put(q.of, True)
            open_ended += q.most is None
            if repeated or inner is None or open_ended > 2 or q.least > 64 or (q.most or 0) > 64:
                return None
            most = "" if q.most is None else str(max(q.least, q.most))
            return f"(?:{inner}){{{q.least},{most}}}"
        return None

    source = put(p, False)
    if source is None or len(tests) > MAX_CLASSES:
        return None
    for k in range(len(tests)):
        own = "".join(chr(_LETTERS + bits) for bits in range(1 << len(tests)) if bits >> k & 1)
        source = source.replace(f"<{k}>", f"[{own}]")
    return ClassString(tuple(tests), f"(?s)(?=.){source}")


def ways(path: Path) -> list[list[tuple[Step, ...]]] | None:
    """The sequences of steps that a walk without stars allows; a step is the alternatives of one direction. None if there are too many."""
    if isinstance(path, Step):
        return [[(path,)]]
    if isinstance(path, Star):
        return None
    if isinstance(path, Maybe):
        inner = ways(path.of)
        return None if inner is None else [[], *[w for w in inner if w]]
    if isinstance(path, Either):
        if all(isinstance(x, Step) and x.out == path.parts[0].out for x in path.parts):
            return [[tuple(path.parts)]]
        each = [ways(x) for x in path.parts]
        return None if None in each else [w for e in each for w in e]
    out: list[list[tuple[Step, ...]]] = [[]]
    for part in path.parts:
        own = ways(part)
        if own is None or len(out) * len(own) > MAX_WAYS:
            return None
        out = [a + b for a in out for b in own]
    return out if all(len(w) <= MAX_STEPS for w in out) else None


def walk_ways(p: Plan) -> list | None:
    """ways() of each walk if all endpoints are single tokens and the whole stays small."""
    if any(e.test is None for e in p.endpoints):
        return None
    each = [ways(w) for w in p.walks]
    if None in each:
        return None
    total, longest = 1, 0
    for w in each:
        total *= len(w)
        longest += max(len(x) for x in w)
    return each if total <= MAX_WAYS and longest <= MAX_STEPS else None
