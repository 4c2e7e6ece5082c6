"""From the text of a query to a plan: sequence or traversal, its candidates, and whether they decide."""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property, lru_cache

from ..lang import fields, parse
from ..lang.ast import Pattern
from ..match.graph import Matcher, Plan, is_traversal, plan
from ..match.surface import Program
from . import candidate as c


@dataclass(frozen=True)
class Compiled:
    query: str
    pattern: Pattern
    kind: str  # surface or graph
    candidate: c.Candidate
    decided: bool
    graph: Plan | None = None

    @property
    def fields(self) -> list[str]:
        return fields(self.pattern)

    @cached_property
    def program(self) -> Program:
        return Program(self.pattern)

    @cached_property
    def matcher(self) -> Matcher:
        return Matcher(self.graph)


@lru_cache(1024)
def compile_query(query: str) -> Compiled:
    """Raises QuerySyntaxError, UnsupportedPattern or CompileError; whatever is returned can be run."""
    pattern = parse(query)
    if is_traversal(pattern):
        p = plan(pattern)
        out = Compiled(query, pattern, "graph", c.of_plan(p), False, p)
        out.matcher  # noqa: B018  errors come now, not on an executor
        return out
    out = Compiled(query, pattern, "surface", c.of_surface(pattern), c.decides(pattern))
    out.program  # noqa: B018
    return out
