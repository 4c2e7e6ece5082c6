"""Syntax trees of patterns: tests on one token, sequences of tokens, and walks over the sentence's graph."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

# ---- values


@dataclass(frozen=True)
class Exact:
    text: str


@dataclass(frozen=True)
class Regex:
    """Matches a whole value."""

    source: str


Value = Exact | Regex

# ---- tests on one token


@dataclass(frozen=True)
class Anything:
    pass


@dataclass(frozen=True)
class Field:
    name: str
    value: Value


@dataclass(frozen=True)
class Fuzzy:
    """The value contains the text, whatever the case."""

    name: str
    text: str


@dataclass(frozen=True)
class Not:
    of: Constraint


@dataclass(frozen=True)
class And:
    parts: tuple[Constraint, ...]


@dataclass(frozen=True)
class Or:
    parts: tuple[Constraint, ...]


Constraint = Anything | Field | Fuzzy | Not | And | Or

# ---- walks


@dataclass(frozen=True)
class Step:
    """One edge, out from governor to dependent or in the other way; any label if label is None."""

    out: bool
    label: Value | None


@dataclass(frozen=True)
class Walk:
    """One after another."""

    parts: tuple[Path, ...]


@dataclass(frozen=True)
class Either:
    parts: tuple[Path, ...]


@dataclass(frozen=True)
class Maybe:
    of: Path


@dataclass(frozen=True)
class Star:
    of: Path


Path = Step | Walk | Either | Maybe | Star

# ---- patterns


@dataclass(frozen=True)
class Token:
    test: Constraint


@dataclass(frozen=True)
class Seq:
    items: tuple[Pattern, ...]


@dataclass(frozen=True)
class Capture:
    name: str
    of: Pattern


@dataclass(frozen=True)
class Repeat:
    of: Pattern
    least: int
    most: int | None
    greedy: bool = True


@dataclass(frozen=True)
class Look:
    ahead: bool
    positive: bool
    of: Pattern


@dataclass(frozen=True)
class Hop:
    """From any token of src over path to any token of dst."""

    src: Pattern
    path: Path
    dst: Pattern


Pattern = Token | Seq | Capture | Repeat | Look | Hop

MODES = ("token", "phrase", "pred")


def capture_mode(name: str) -> tuple[str, str]:
    """A capture's plain name and its mode; token unless a known mode is given."""
    plain, colon, mode = name.rpartition(":")
    return (plain, mode) if colon and mode in MODES else (name, "token")


def leaves(test: Constraint) -> Iterator[Field | Fuzzy]:
    if isinstance(test, Field | Fuzzy):
        yield test
    elif isinstance(test, Not):
        yield from leaves(test.of)
    elif isinstance(test, And | Or):
        for part in test.parts:
            yield from leaves(part)


def tests(pattern: Pattern) -> Iterator[Constraint]:
    """All token tests of a pattern in order, those in look-arounds and endpoints too."""
    if isinstance(pattern, Token):
        yield pattern.test
    elif isinstance(pattern, Seq):
        for item in pattern.items:
            yield from tests(item)
    elif isinstance(pattern, Hop):
        yield from tests(pattern.src)
        yield from tests(pattern.dst)
    else:
        yield from tests(pattern.of)


def fields(pattern: Pattern) -> list[str]:
    """Names of the token columns that a pattern tests, sorted."""
    return sorted({leaf.name for test in tests(pattern) for leaf in leaves(test)})


def negation_normal(test: Constraint, negated: bool = False) -> Constraint:
    """An equal test with negation on leaves only. Anything's negation stays Not(Anything)."""
    if isinstance(test, Not):
        return negation_normal(test.of, not negated)
    if isinstance(test, And | Or):
        parts = tuple(negation_normal(p, negated) for p in test.parts)
        return Or(parts) if isinstance(test, And) == negated else And(parts)
    return Not(test) if negated else test
