"""Search with pages: exact counts, a cursor that goes on where a page ended, and text for the page only."""

from __future__ import annotations

import json
import threading
import time
import uuid
from collections.abc import Callable
from dataclasses import asdict, dataclass
from typing import TYPE_CHECKING

from pyspark.sql import Column, DataFrame, functions as F

from ..errors import BackendError, CompileError, EngineError, InvalidQuery, QuerySyntaxError, SearchTimeout, UnsupportedPattern
from ..functions.numbering import numbered
from ..plans.compiler import Compiled, compile_query
from ..schema import SENTENCES
from . import match, postings

if TYPE_CHECKING:
    from ..sources.store import Store

DEFAULT_LIMIT, MAX_LIMIT = 20, 1000
TIMEOUT_S = 30.0
ADDRESS = ("split_id", "sent_ord")


@dataclass(frozen=True)
class SearchQuery:
    query: str
    limit: int = DEFAULT_LIMIT
    cursor: str | None = None
    count: bool = False


@dataclass(frozen=True)
class SpanOut:
    start: int
    end: int
    text: str
    captures: tuple[dict, ...] = ()


@dataclass(frozen=True)
class Match:
    spans: tuple[SpanOut, ...]
    named: tuple[dict, ...] = ()


@dataclass(frozen=True)
class Hit:
    doc_id: str
    sentence_id: str
    sentence_length: int
    words: tuple[str, ...]
    matches: tuple[Match, ...]


@dataclass(frozen=True)
class SearchResults:
    query: str
    kind: str
    hits: tuple[Hit, ...]
    total_hits: int
    total_is_exact: bool
    exhausted: bool
    next_cursor: str | None
    took_ms: int
    backend_us: int
    render_us: int

    def to_dict(self) -> dict:
        out = asdict(self)
        out["timing"] = {"backend_us": out.pop("backend_us"), "render_us": out.pop("render_us")}
        return out


def fingerprint(query: str) -> int:
    """64-bit FNV-1a of the query's UTF-8; fixed values: offset basis and prime."""
    h = 0xCBF29CE484222325
    for b in query.encode():
        h = (h ^ b) * 0x100000001B3 & 0xFFFFFFFFFFFFFFFF
    return h


def encode_cursor(query: str, address: tuple) -> str:
    return json.dumps([fingerprint(query), list(address)]).encode().hex()


def decode_cursor(query: str, cursor: str) -> tuple:
    try:
        own, address = json.loads(bytes.fromhex(cursor))
        address = tuple(int(x) for x in address)
    except (ValueError, TypeError) as e:
        raise InvalidQuery("the cursor can't be read") from e
    if own != fingerprint(query) or len(address) != len(ADDRESS):
        raise InvalidQuery("the cursor is of another query")
    return address


def page(df: DataFrame, query: str | Compiled, limit: int, after: tuple | None = None) -> DataFrame:
    """The first limit rows of df that match after an address, in order of address."""
    q = compile_query(query) if isinstance(query, str) else query
    low = match.lower(q, df.columns)
    rows = df if after is None else df.where(_after(after))
    return rows.where(low.candidate).where(low.hit).orderBy(*ADDRESS).limit(limit)


def pages(df: DataFrame, query: str, limit: int, folder: str) -> tuple[DataFrame, int]:
    """All pages of limit hits, as following the cursors gives them, in one pass: page (from 1), place in it, address of each hit; and how many hits there are.

    Following cursors looks through the table once a page. Here addresses of hits are sorted by ranges, written to folder, which all executors
    share, and numbered from how many each range has.
    """
    found, total = numbered(match.hits(df, query).select(*ADDRESS), ADDRESS, folder)
    return found.select((F.floor(F.col("place") / limit) + 1).cast("long").alias("page"), (F.col("place") % limit).alias("place"), *ADDRESS), total


def _after(after: tuple) -> Column:
    """split_id is tested alone too, so files whose statistics are before it are skipped."""
    split, ord_ = after
    return (F.col("split_id") >= split) & ((F.col("split_id") > split) | (F.col("sent_ord") > ord_))


class Searcher:
    """Searches what source() gives; it is asked again for each search, so additions are seen."""

    def __init__(self, source: Callable[[], DataFrame], timeout_s: float = TIMEOUT_S, max_limit: int = MAX_LIMIT):
        self.source, self.timeout_s, self.max_limit = source, timeout_s, max_limit

    def compile(self, request: SearchQuery) -> Compiled:
        try:
            return compile_query(request.query)
        except (QuerySyntaxError, UnsupportedPattern, CompileError) as e:
            raise InvalidQuery(str(e)) from e

    def search(self, request: SearchQuery | str) -> SearchResults:
        request = SearchQuery(request) if isinstance(request, str) else request
        began = time.monotonic()
        if request.limit < 1:
            raise InvalidQuery("the limit must be 1 or more")
        limit = min(request.limit, self.max_limit)
        q = self.compile(request)
        after = decode_cursor(request.query, request.cursor) if request.cursor else None
        df = self.source()
        rows, total = self._run(df, lambda: self._fetch(df, q, request, limit, after))
        backend = time.monotonic()
        found = tuple(_hit(r) for r in rows)
        exhausted = len(rows) < limit
        cursor = None if exhausted else encode_cursor(request.query, tuple(rows[-1][c] for c in ADDRESS))
        now = time.monotonic()
        return SearchResults(request.query, q.kind, found, len(rows) if total is None else total, total is not None, exhausted, cursor, round((now - began) * 1e3), round((backend - began) * 1e6), round((now - backend) * 1e6))

    def _fetch(self, df: DataFrame, q: Compiled, request: SearchQuery, limit: int, after: tuple | None):
        """The page's rows are chosen by address first; spans are worked out for them alone."""
        few = page(df, q, limit, after)
        rows = match.matches(few, request.query, capped=True).select(*ADDRESS, "doc_id", "sentence_id", "sentence_length", "word", "matches").orderBy(*ADDRESS).collect()
        return rows, match.count(df, request.query) if request.count else None

    def _run(self, df: DataFrame, work):
        sc, group = df.sparkSession.sparkContext, f"search-{uuid.uuid4().hex}"
        late = threading.Event()

        def cancel() -> None:
            late.set()
            sc.cancelJobGroup(group)

        timer = threading.Timer(self.timeout_s, cancel)
        sc.setJobGroup(group, "search", interruptOnCancel=True)
        timer.start()
        try:
            return work()
        except EngineError:
            raise
        except Exception as e:
            if late.is_set():
                raise SearchTimeout(f"the search took more than {self.timeout_s} seconds") from e
            raise BackendError(str(e)[:2000]) from e
        finally:
            timer.cancel()
            sc.setLocalProperty("spark.jobGroup.id", None)
            sc.setLocalProperty("spark.job.description", None)


class StoreSearcher(Searcher):
    """Searches a store split by split, in page order, until the page is full.

    Splits that lack a term that every match has are left out by the postings, where the table has them; and what the postings decide
    alone is counted in them, without reading a sentence. The number of splits read at once doubles, so a rare match takes few jobs.
    """

    def __init__(self, store: Store, timeout_s: float = TIMEOUT_S, max_limit: int = MAX_LIMIT):
        super().__init__(store.sentences, timeout_s, max_limit)
        self.store, self.read = store, []  # read: the splits that the last search looked at

    def _fetch(self, df: DataFrame, q: Compiled, request: SearchQuery, limit: int, after: tuple | None):
        folders = {r.split_id: f"{self.store.path}/data/{r.folder}" for r in self.store._live() if r.sentences}
        index = self.store.postings()
        indexed = index is not None and postings.answers(q.candidate, self.store.index)
        left = sorted(x for x in folders if after is None or x >= after[0])
        if index is not None and (terms := [t for t in postings.required_terms(q.candidate) if t[0] in self.store.index]):
            having = {r[0] for r in postings.splits_with(index, terms).collect()}
            left = [x for x in left if x in having]
        rows, step, self.read = [], 1, []
        while left and len(rows) < limit:
            now, left, step = left[:step], left[step:], 2 * step
            self.read += now
            few = page(self.store.spark.read.schema(SENTENCES).parquet(*[folders[x] for x in now]), q, limit - len(rows), after)
            rows += match.matches(few, request.query, capped=True).select(*ADDRESS, "doc_id", "sentence_id", "sentence_length", "word", "matches").orderBy(*ADDRESS).collect()
        return rows, self._count(df, q, request, index if indexed else None) if request.count else None

    def _count(self, df: DataFrame, q: Compiled, request: SearchQuery, index: DataFrame | None) -> int:
        if index is None or not q.decided:
            return match.count(df, request.query)
        return postings.candidates(index, df, q.candidate).count()


def _hit(r) -> Hit:
    words = tuple("" if w is None else w for w in r["word"] or ())
    text = lambda a, b: " ".join(words[a : min(b, len(words))]) if 0 <= a < len(words) else ""
    capture = lambda c: {"name": c["name"], "start": c["start"], "end": c["end"], "text": text(c["start"], c["end"])}
    matches = tuple(Match(tuple(SpanOut(s["start"], s["end"], text(s["start"], s["end"]), tuple(capture(c) for c in s["captures"])) for s in m["spans"]), tuple(capture(c) for c in m["named"])) for m in r["matches"])
    return Hit(r["doc_id"], r["sentence_id"], r["sentence_length"], words, matches)
