from pyspark.sql import functions as F

from tokenloom.llm.html_extraction import MIN_PAGES, RUN, blocks_of, extract_main_text

PAGE = """<!DOCTYPE html><html><head><title>t</title><style>p{}</style><script>var t="</p><article>no</article>";</script></head><body>
<header><h1>Site</h1></header><nav><ul><li><a href="/a">Menu</a></ul></nav><!-- <article>comment</article> --><div class="cookie-notice">cookies</div><div class="ad">Buy</div>
<article><h1>Ti&amp;tle</h1><p><b>one   two<br><p>three &lt;four&gt; &#233;&nbsp;&hellip;</p><ul><li>x<li>y</ul><aside>side</aside><div class="share-bar">share</div><form>name <input></form><p>last<script>x()</script> words</p></article>
<section id="comments"><article class="comment"><p>reader says</p></article></section><footer>&copy; site</footer></body></html>"""


def test_article():
    assert blocks_of(PAGE) == (["Ti&tle", "one two", "three <four> é …", "x", "y", "last words"], True)


def test_broken_markup():
    assert blocks_of("<article><p>a<p>b<b>c</article><footer>f") == (["a", "bc"], True)
    assert blocks_of("<body><main>a <div>b</div> c<footer>no</footer>") == (["a", "b", "c"], True)
    assert blocks_of("<article>1 < 2 & 3 > 2 <unknown>kept</unknown>") == (["1 < 2 & 3 > 2 kept"], True)
    assert blocks_of('<article data-x="a > b">in</article>') == (["in"], True)
    assert blocks_of("<p>no article</p><nav>n</nav>") == (["no article"], False)
    assert blocks_of("<article>a<script>never closed") == (["a"], True)
    assert blocks_of("<article>a<![CDATA[b]]></article>") == (["ab"], True)
    assert blocks_of(None) == blocks_of("") == blocks_of("<p></p>") == ([], False)
    assert blocks_of("<article><header><h1>head</h1></header>t</article>") == (["head", "t"], True)
    assert blocks_of("<div role='main'><p>m</p></div><div>x</div>") == (["m"], True)
    assert blocks_of("<article><div hidden>h</div><p style='display: none'>n</p>t</article>") == (["t"], True)
    assert blocks_of("<div class='page has-sidebar'><article class='ad-free'>t<p class='top-ad x'>a</p><p id='Cookie_Notice'>c</p></article></div>") == (["t"], True)


def brute(pages):
    """Texts of pages without article: tokens in no run of RUN tokens that MIN_PAGES pages of the host share."""
    streams = [" \n ".join(b).split(" ") if b else [] for _, b in pages]
    seen = {}
    for n, ((host, _), t) in enumerate(zip(pages, streams, strict=True)):
        for i in range(len(t) - RUN + 1):
            seen.setdefault((host, tuple(t[i : i + RUN])), set()).add(n)
    out = []
    for (host, _), t in zip(pages, streams, strict=True):
        keep = [True] * len(t)
        for i in range(len(t) - RUN + 1):
            if len(seen[host, tuple(t[i : i + RUN])]) >= MIN_PAGES:
                keep[i : i + RUN] = [False] * RUN
        lines = " ".join(x for x, k in zip(t, keep, strict=True) if k or x == "\n").split("\n")
        out.append("\n".join(x.strip() for x in lines if x.strip()))
    return out


def test_repeated_runs_go_where_no_article_is(spark):
    menu = "home about news sports weather contact help terms privacy imprint"
    rows = []
    for i in range(12):
        host = "http://a.x/" if i % 3 else "http://b.x/"
        rows.append((i, host + str(i), [menu, f"own text {i} is here only " + " ".join(f"t{i}{k}" for k in range(9)), "once on two pages only but long enough now" if i < 2 else f"tail {i}", menu[:20]]))
    df = spark.createDataFrame([(i, u, "".join(f"<div>{b}</div>" for b in blocks)) for i, u, blocks in rows] + [(50, "http://a.x/z", PAGE), (51, None, None), (52, "", "<p>x")], "page_id long, url string, html string")
    got = {r.page_id: r.text for r in extract_main_text(df).collect()}
    want = brute([(u[:10], b) for _, u, b in rows])
    assert [got[i] for i in range(12)] == want and "5 is here only" in got[5] and "news sports" not in got[5]
    assert got[50] == "Ti&tle\none two\nthree <four> é …\nx\ny\nlast words" and got[51] == "" and got[52] == "x"


def test_odd_tables(spark):
    df = spark.createDataFrame([(1, "http://a/", PAGE, "old"), (1, "http://a/", PAGE, "old"), (None, None, None, None)], "page_id long, url string, html string, text string")
    out = extract_main_text(df)
    assert out.columns == ["page_id", "url", "text", "n_chars"] and out.where(F.col("n_chars") != F.length("text")).count() == 0 and out.count() == 3
    assert extract_main_text(df.limit(0)).collect() == []
    long = spark.createDataFrame([(1, "http://a/", "<article>" + "<p>word word</p>" * 50_000)], "page_id long, url string, html string")
    assert extract_main_text(long).first().text.count("\n") == 49_999


BODY = "<p>The body of the page, which is long enough to be its text.</p>"
TEXT = "The body of the page, which is long enough to be its text."


def test_wrappers_do_not_hide_the_text():
    """Forms and marked classes around the article, main element or nearly all text."""
    for start, end in (("<form id=aspnetForm>", "</form>"), ("<div class='layout sidebar-right'>", "</div>"), ("<div id='page' class='menu-closed'><form>", "</form></div>")):
        for tag in ("article", "main"):
            page = f"<nav>n</nav>{start}<div class='ad'>Buy</div><{tag}>{BODY}<div class='share'>s</div></{tag}><p>c</p>{end}<footer>f</footer>"
            assert blocks_of(page) == ([TEXT], True), page
        assert blocks_of(f"<nav>n</nav>{start}{BODY}{end}<footer>f</footer>") == ([TEXT], False)
    assert blocks_of(f"{BODY}<section class='comments'><article>reader says</article></section>") == ([TEXT], False)
    assert blocks_of(f"<article><div class='ad'>Buy</div></article>{BODY}") == ([TEXT], False)
    assert blocks_of(f"<div class='related'><article>teaser</article></div><article>{BODY}</article>") == ([TEXT], True)
    assert blocks_of(f"{BODY}<form>name <input></form><nav><main>n</main></nav>") == ([TEXT], False)


def test_copies_of_a_page_keep_their_text(spark):
    menu = "home about news sports weather contact help terms privacy imprint"
    own = lambda k: " ".join(f"{k}word{i}" for i in range(40))
    texts = [("a", [own("a")])] * 3 + [("b", [own("b"), f"read {i} times"]) for i in range(5)] + [("c", [menu, own("c")])] * 4 + [("c", [menu, own(f"d{i}")]) for i in range(2)] + [("e", [menu])] * 3 + [("f", [menu, own("f")])] * 9
    df = spark.createDataFrame([(i, f"http://{host}/", "".join(f"<div>{b}</div>" for b in blocks)) for i, (host, blocks) in enumerate(texts)], "page_id long, url string, html string")
    got = {r.page_id: r.text for r in extract_main_text(df).collect()}
    for i, (host, blocks) in enumerate(texts):  # the menu goes where three different pages have it, and nothing else
        assert got[i] == "\n".join(blocks[1:] if host == "c" else blocks), (i, got[i])


def test_marks_are_whole_names_of_class_and_id_only():
    read = lambda x: blocks_of(x)[0]
    assert read('<article><p title="hidden gems">a</p><p data-id="menu">b</p><p alt="x class=ad">c</p></article>') == ["a", "b", "c"]
    assert read('<main id="skip-to-content"><p>all</p></main><div>x</div>') == ["all"]
    assert read('<article class="related-work"><section class="related-work">w</section><div class="related-posts">no</div></article>') == ["w"]
    assert read("<article><p>let <math><mi>x</mi><mo>=</mo><mn>2</mn></math> be</p></article>") == ["let x=2 be"]
    assert read("<article>AT&<b>amp;</b> &amp;amp; &lt;b&gt;</article>") == ["AT&amp; &amp; <b>"]
    assert read('<article class="sidebar-left post">t<div class="siteFooter">no</div><div class="adSlot3">no</div><div class="headline">h</div></article>') == ["t", "h"]
    assert read('<article class="comment"><p>reader</p></article><article class="post"><p>body</p></article>') == ["body"]


def test_what_stands_outside_of_articles_tells_of_boilerplate(spark):
    menu = "home about news sports weather contact help terms privacy imprint"
    article = "<article>" + " ".join(f"own{{0}}x{k}" for k in range(12)) + "</article>"
    rows = [(i, "http://a.x/", f"<div>{menu}</div>" + article.format(i)) for i in range(3)] + [(9, "http://a.x/", f"<div>{menu}</div><div>" + " ".join(f"t{k}" for k in range(12)) + "</div>"), (10, "http://b.x/", f"<div>{menu}</div><div>only page of its host {menu[:9]}</div>")]
    got = {r.page_id: r.text for r in extract_main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert menu not in got[9] and got[9].startswith("t0 t1") and menu in got[10] and got[0].startswith("own0x0")
