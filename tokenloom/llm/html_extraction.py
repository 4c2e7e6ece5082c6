"""HTML extraction: the article of a page, and a host suffix sort where the page's structure doesn't mark it.

The page is read once as a stream of tags and text. Text in navigation, headers, footers, asides, forms, adverts, notices,
comments and the like is never kept; if the page has an article or main element, the blocks inside are its text, whole. If no
text is found in one, a form and a mark in a class or id don't hide what contains the article or main element, or nearly all text.

Pages without one are judged by repetition, in the token streams of all pages of their host: what pages with an article have outside
of it, and all that the others have. A suffix is known by its first RUN tokens; suffixes that agree on them are neighbours in the host's suffix
array, and such a run is boilerplate if MIN_PAGES distinct pages share it. Every substring of RUN tokens or more that so many pages share is
made of runs that they share, and the other way round, so the tokens that these runs cover are exactly those of the array's maximal repeats; they are
removed, and the unique runs stay. Longer prefixes of the suffixes needn't be sorted for that, and suffixes are counted by host and run with
partial sums, so a host with a third of all pages is never in one task. Pages are distinct if their texts differ and, without the runs so
shared, still have RUN tokens or more that differ: copies and near copies of a page count once, and one that would be left with less keeps
its text whole. Text inside an article isn't judged so: articles of one host repeat passages and whole texts, and the repeated part is the article nonetheless.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import pandas as pd
import xxhash
from pyspark.sql import DataFrame, functions as F

from .batches import bounded_batches
from .common import materialise, others, quoted
from .url_filter import host_of

RUN, MIN_PAGES = 8, 3
MADE = ("text", "n_chars")

#: Elements by what they do to the text.
BLOCK = frozenset("address article aside blockquote body br caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol option p pre section summary table tbody td tfoot th thead tr ul".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp noembed noframes iframe".split())
NEVER = frozenset("head script style noscript template title textarea svg iframe object canvas audio video select option button datalist nav footer aside form menu dialog map applet xmp noembed noframes frameset".split())
ROLES = frozenset("navigation banner contentinfo complementary search dialog alertdialog alert menu menubar toolbar form tablist".split())
MARKS = frozenset("ad ads advert adverts advertisement advertising adsense sponsor sponsored promo promotion nav navbar navigation menu breadcrumb breadcrumbs sidebar cookie cookies consent gdpr notice notices banner footer comment comments disqus reply replies share sharing social related newsletter subscribe subscription popup modal overlay login signin signup register widget toolbar pagination pager masthead skip".split())
ONCE = {"p": {"p"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
CLOSES_P = BLOCK - {"br", "body", "html"}
#: An element open beyond these isn't closed by a sibling's start.
WALLS = frozenset("article aside body div dialog fieldset footer form header html main nav ol section table td th ul dl blockquote button figure".split())

_TAG = re.compile(r"""<!--.*?(?:-->|\Z)|<!\[CDATA\[(?P<cdata>.*?)(?:\]\]>|\Z)|<(?P<end>/?)(?P<name>[a-zA-Z][^\s/>]*)(?P<rest>(?>(?:[^>"']|"[^"]*"|'[^']*')*))>|<(?P<end2>/?)(?P<name2>[a-zA-Z][^\s/>]*)(?P<rest2>[^>]*)>|<[!?/][^>]*(?:>|\Z)|<[a-zA-Z][^>]*\Z""", re.S)
_ATTR = re.compile(r"""([^\s"'>/=]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
#: Attributes that can tell boilerplate or the main text; an element with none of them isn't looked at.
_TELLING = re.compile(r"class|id|role|hidden|style", re.I)
_MARK = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+")
#: Share of a page's text (outside of what is never kept) from which on a form or a mark doesn't hide it.
NEARLY_ALL = 0.9
#: Marks that hide an article itself.
NOT_MAIN = frozenset("ad ads advert adverts advertisement sponsor sponsored promo promotion comment comments disqus reply replies related".split())
#: Words that a class may have beside a mark; any other says that it names something else (has-sidebar, ad-free, related-work).
BESIDE = frozenset("site page main top bottom left right list item items box boxes wrap wrapper container area section block blocks bar buttons button links link posts post articles article stories news content inner outer primary secondary global text title label icon icons group row column panel unit slot zone space holder frame form message policy settings info count thread reader user latest more also read us mobile desktop sticky fixed floating small large big mini inline view first last home body".split())


NONE, SOFT, HARD = range(3)


def _attributes(rest: str) -> dict[str, str]:
    """Attributes of a tag by lower-case name; the first of a name counts."""
    out: dict[str, str] = {}
    for name, a, b, c in _ATTR.findall(rest):
        out.setdefault(name.lower(), html.unescape(a or b or c))
    return out


def _marked(value: str, in_main: bool, marks_of: frozenset[str] = MARKS) -> bool:
    """Whether one of the names in a class or id is made of marks and words that go with them."""
    for one in value.split():
        words = {w.lower() for w in _MARK.findall(one)}
        marks = words & marks_of or not in_main and words & {"header"}
        if marks and words <= MARKS | BESIDE | {"header"}:
            return True
    return False


def _boilerplate(name: str, attributes: dict[str, str], in_main: bool) -> int:
    """HARD: never kept. SOFT: a form or a mark, which may also be a wrapper around the page's text.

    A mark never hides a main element, nor, unless it names a comment or an advert, an article that isn't within another.
    """
    if name != "form" and name in NEVER or name == "header" and not in_main:
        return HARD
    soft = SOFT if name == "form" else NONE
    if not attributes or name in ("html", "body"):
        return soft
    if "hidden" in attributes or attributes.get("aria-hidden", "").lower() == "true" or re.search(r"display\s*:\s*none", attributes.get("style", ""), re.I):
        return HARD
    if attributes.get("role", "").strip().lower() in ROLES:
        return HARD
    if name == "main" or name == "article" and not in_main and not any(_marked(attributes.get(key, ""), True, NOT_MAIN) for key in ("class", "id")):
        return soft
    return SOFT if any(_marked(attributes.get(key, ""), in_main) for key in ("class", "id")) else soft


def blocks_of(page: str | None) -> tuple[list[str], bool]:
    """Blocks of the page's text outside boilerplate, and whether they are those of an article or main element."""
    inside, outside = split_page(page)
    return (inside, True) if inside else (outside, False)


def split_page(page: str | None) -> tuple[list[str], list[str]]:
    """Blocks outside boilerplate in the page's article or main elements, and those in none."""
    src = page or ""
    inside, outside, held = _read(src, frozenset())
    if inside or not held:
        return inside, outside
    own, hidden = sum(map(len, outside)), sum(h[0] for h in held.values() if h[2])
    # a wrapper is opened for a main element, for articles that outweigh the rest of the text, or for nearly all text
    opened = frozenset(at for at, (n, holds, _) in held.items() if holds == "main" or holds and n > own or n and n >= NEARLY_ALL * (own + hidden))
    if not opened:
        return inside, outside
    inside, outside, _ = _read(src, opened)
    return inside, outside


def _read(src: str, opened: frozenset[int]) -> tuple[list[str], list[str], dict[int, list]]:
    """Blocks inside and outside of articles and main elements, and by its place in src each element that a form or mark alone hides:
    characters of its text, whether an article or main element is in it, and whether it is outermost. Those of opened aren't hidden."""
    stack: list[tuple[str, bool, bool, bool]] = []  # name, whether it starts boilerplate, the main text, boilerplate for good
    skip = main = hard = 0
    held: dict[int, list] = {}
    open_: list[int] = []
    parts: list[str] = []
    inside: list[str] = []
    outside: list[str] = []

    def flush() -> None:
        if parts:
            text = " ".join("".join(parts).split())
            parts.clear()
            if text:
                (inside if main else outside).append(text)

    def pop_to(at: int) -> None:
        nonlocal skip, main, hard
        flush()
        for _, s, m, h in stack[at:]:
            skip -= s
            main -= m
            hard -= h
            if s and not h:
                open_.pop()
        del stack[at:]

    at, end = 0, len(src)
    while at < end:
        m = _TAG.search(src, at)
        stop = m.start() if m else end
        if not skip and stop > at:
            parts.append(html.unescape(src[at:stop]))  # a reference ends where a tag begins
        elif open_ and not hard and stop > at:
            n = len(src[at:stop].strip())
            for wrapper in open_:
                held[wrapper][0] += n
        if not m:
            break
        place, at = m.start(), m.end()
        name = (m["name"] or m["name2"] or "").lower()
        if not name:
            if m["cdata"] and not skip:
                parts.append(m["cdata"])
            continue
        if m["end"] or m["end2"]:
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] == name:
                    if name in BLOCK or any(s or x or n in BLOCK for n, s, x, _ in stack[i:]):
                        pop_to(i)
                    else:
                        del stack[i]
                    break
            else:
                if name in BLOCK:
                    flush()
            continue
        rest = m["rest"] or m["rest2"] or ""
        if name in BLOCK:
            flush()
        if name in ("body", "article", "main") and any(s[0] == "head" for s in stack):
            pop_to(next(i for i, s in enumerate(stack) if s[0] == "head"))
        if name in RAW:
            close = re.compile(rf"</{name}\b[^>]*>", re.I).search(src, at)
            at = close.end() if close else end
            continue
        if name in VOID or rest.endswith("/") and name not in BLOCK:
            continue
        same = ONCE.get(name, set()) | ({"p"} if name in CLOSES_P else set())
        for i in range(len(stack) - 1, -1, -1):
            if stack[i][0] in same:
                pop_to(i)
                break
            if stack[i][0] in WALLS:
                break
        attributes = _attributes(rest) if rest and _TELLING.search(rest) else {}
        how = _boilerplate(name, attributes, main > 0)
        bad, for_good = how == HARD or how == SOFT and place not in opened, how == HARD
        start = not bad and (name in ("article", "main") or attributes.get("role", "").strip().lower() == "main")
        if start and skip:
            if not hard:
                for wrapper in open_:
                    held[wrapper][1] = "article" if name == "article" and held[wrapper][1] != "main" else "main"
            start = False
        if bad or start:
            flush()
        stack.append((name, bad, start, for_good))
        if bad and not for_good:
            held[place] = [0, "", not skip]
            open_.append(place)
        skip += bad
        main += start
        hard += for_good
    flush()
    return inside, outside, held


def runs_of(blocks: list[str], run: int = RUN) -> list[int]:
    """Hash of the first run tokens of each suffix of the page's tokens; none for the last ones, which are shorter."""
    tokens = " \n ".join(blocks).split(" ") if blocks else []
    return [xxhash.xxh64_intdigest(" ".join(tokens[i : i + run]).encode("utf-8", "replace")) - (1 << 63) for i in range(len(tokens) - run + 1)]


def without_runs(blocks: list[str], starts: list[int], run: int = RUN) -> list[str]:
    """Blocks without the tokens that the runs at starts cover."""
    covered = {i + j for i in starts for j in range(run)}
    out, at = [], 0
    for b in blocks:
        tokens = b.split(" ")
        kept = " ".join(t for i, t in enumerate(tokens, at) if i not in covered)
        at += len(tokens) + 1  # the token that parts blocks
        if kept:
            out.append(kept)
    return out


def extract_main_text(df: DataFrame, html_col: str = "html", url_col: str = "url") -> DataFrame:
    """df with text (the blocks of the main text joined by a newline) and n_chars (its code points).

    A null, empty or text-less page gives an empty text. Repeated rows and identifiers are rows of their own, but copies of a page count
    once among the pages of their host; a null url has the empty host. An empty table stays empty. Input columns named as a made
    column are replaced; all others but the html are carried along.
    """
    bounded_batches(df.sparkSession)

    @F.pandas_udf("text string, blocks array<string>")
    def read(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for pages in batches:
            rows = [split_page(p) for p in pages]
            yield pd.DataFrame({"text": ["\n".join(inside) if inside else None for inside, _ in rows], "blocks": [outside for _, outside in rows]})

    @F.pandas_udf("array<long>")
    def suffixes(blocks: pd.Series) -> pd.Series:
        return blocks.map(lambda b: runs_of(list(b)))

    @F.pandas_udf("long")
    def rest(blocks: pd.Series, starts: pd.Series, inside: pd.Series) -> pd.Series:
        """Hash of what is left of a page without the runs at starts, its article included; null if it is less than a run."""
        left = [" ".join(without_runs(list(b), list(s))) + ("" if pd.isna(i) else f" {i}" + " -" * RUN) for b, s, i in zip(blocks, starts, inside, strict=True)]
        return pd.Series([xxhash.xxh64_intdigest(x.encode("utf-8", "replace")) - (1 << 63) if x.count(" ") >= RUN - 1 else None for x in left], dtype="Int64")

    @F.pandas_udf("string")
    def unique(blocks: pd.Series, starts: pd.Series) -> pd.Series:
        return pd.Series(["\n".join(without_runs(list(b), [] if s is None else list(s))) for b, s in zip(blocks, starts, strict=True)])

    keep = others(df, *MADE, html_col)
    read_pages = materialise(df.select(*keep, read(F.col(quoted(html_col)).cast("string")).alias("__read"), host_of(F.col(quoted(url_col))).alias("__host")).withColumn("__row", F.monotonically_increasing_id()))
    known = read_pages.where("__read.text IS NOT NULL OR size(__read.blocks) = 0").withColumn("text", F.coalesce("__read.text", F.lit("")))
    read_pages = read_pages.where("size(__read.blocks) > 0")  # what pages with an article have outside of it tells of boilerplate too
    inside = F.when(F.size(F.split("__read.text", r"\s+")) >= RUN, F.xxhash64("__read.text"))
    read_pages = read_pages.withColumns({"__inside": inside, "__page": F.xxhash64("__read.blocks", inside)})
    open_ = read_pages.where("__read.text IS NULL")
    pages = read_pages.groupBy("__host", "__page").agg(F.min("__row").alias("__first"))
    first = read_pages.join(pages.select("__first"), F.col("__row") == F.col("__first"), "left_semi")
    first = materialise(first.select("__host", "__page", F.col("__read.blocks").alias("__blocks"), "__inside", F.col("__read.text").isNull().alias("__open")))
    runs = first.select("__host", "__page", F.posexplode(suffixes("__blocks")).alias("__at", "__run"))

    def often(df: DataFrame, by: str) -> DataFrame:
        """Runs that MIN_PAGES pages of a host or more share, written out so that a join's sides are plain exchanges, and Spark can split the pages of a run that very many share."""
        return materialise(df.select(by, "__host", "__run").distinct().groupBy("__host", "__run").count().where(F.col("count") >= MIN_PAGES).drop("count"))

    starts = lambda shared: runs.join(shared, ["__host", "__run"]).groupBy("__host", "__page").agg(F.collect_list("__at").alias("__starts"))
    shared = often(runs, "__page")
    rests = materialise(first.join(starts(shared), ["__host", "__page"]).select("__host", "__page", "__open", rest("__blocks", "__starts", "__inside").alias("__rest")).where("__rest IS NOT NULL"))
    shared = often(runs.join(shared, ["__host", "__run"]).join(rests, ["__host", "__page"]), "__rest")
    covered = starts(shared).join(rests.where("__open"), ["__host", "__page"], "left_semi")
    judged = open_.join(covered, ["__host", "__page"], "left").withColumn("text", unique("__read.blocks", F.coalesce("__starts", F.array().cast("array<int>"))))
    out = known.select(*keep, "text").unionAll(judged.select(*keep, "text"))
    return out.withColumn("n_chars", F.length("text").cast("long"))


def op5_html_extraction(spark, sf_dir):
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html")
    return extract_main_text(pages).select("page_id", "url", *MADE)
