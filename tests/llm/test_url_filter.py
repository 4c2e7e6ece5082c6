import re
from collections import Counter, defaultdict

import pytest

from tokenloom.llm.url_filter import DAMPING, DISTRUST, ROUNDS, RULES, filter_urls


def parts(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    host = re.match(r"[^/?#]*", rest)[0]
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in host), re.match(r"[^?#]*", rest[len(host) :])[0]


def rule(host, path):
    fit = [(len(r), r, v) for v, r in RULES for of, _, start in [r.partition("/")] if (host == of or host.endswith("." + of)) and path.startswith("/" + start)]
    return max(fit)[1:] if fit else (None, None)


def brute(pages):
    own = [(i, *parts(u), *rule(*parts(u)), h) for i, u, h in pages]
    n = Counter(h for _, h, *_ in own)
    links = Counter()
    for _, host, _, _, _, html in own:
        to = {parts("http:" + u if u.startswith("//") else u)[0] for u in re.findall(r"""(?i)<a\s[^>]*?\bhref\s*=\s*["']?\s*((?:https?:)?//[^"'\s>]+)""", html or "")}
        links.update((host, t) for t in to if t != host and t and host)

    def spread(verdict, edges):
        share = {h: sum(v == verdict for _, x, _, _, v, _ in own if x == h) / n[h] for h in n}
        total = sum(share.values()) or 1.0
        seed = {h: s / total for h, s in share.items()}
        out = defaultdict(float)
        for (a, _), w in edges.items():
            out[a] += w
        rank, got = dict(seed), {}
        for _ in range(ROUNDS):
            got = defaultdict(float)
            for (a, b), w in edges.items():
                got[b] += DAMPING * rank.get(a, 0.0) * w / out[a]
            rank = {h: (1 - DAMPING) * seed.get(h, 0.0) + got[h] for h in {*seed, *got}}
        return got

    trust = spread("allow", links) if links else {}
    distrust = spread("block", Counter({(b, a): w for (a, b), w in links.items()})) if links else {}
    bad = {h for h, d in distrust.items() if d > DISTRUST and d > trust.get(h, 0.0)}
    return sorted(((i, h, p, r, v or ("block" if h in bad else "allow")) for i, h, p, r, v, _ in own), key=repr)


def found(df):
    return sorted((tuple(r) for r in df.select("page_id", "host", "path", "rule", "verdict").collect()), key=repr)


URLS = [
    "http://Foo.COM/en/1", "https://example.com/en/7x", "http://a.example.com/en/71#t", "http://example.com/en/6", "http://x.net/de/", "http://example.net/de/8", "http://b.example.net/de/81?x", "http://b.example.net/de/9", "http://y.org/es/q?u#v",
    "http://yorg/es/", "http://com/en/", "http://examplecom/en/", "ftp://z.net?de/", "http://z.net#/de/", "nohost", "", None, "http://", "http:///path", "HTTP://Q.ORG/ES/", "x://y.org/es/://z.com/en/", "http://u@h.com:80/en/",
]


def test_rules(spark):
    pages = [(i, u, None) for i, u in enumerate(URLS)]
    assert found(filter_urls(spark.createDataFrame(pages, "page_id long, url string, html string"))) == brute(pages)


def test_links_carry_trust_and_distrust(spark):
    pages = [(i, u, None) for i, u in enumerate(URLS)]
    link = lambda *to: " ".join(f'<a class="x" href="{t}">l</a>' for t in to)
    pages += [
        (100, "http://spam1.info/", link("http://y.org/es/1", "http://yorg/x")), (101, "http://spam2.info/a", link("//y.org/es/2")), (102, "http://spam3.info/", link("http://spam1.info/", "http://spam2.info/")),
        (103, "http://good.info/", "<p>none"), (104, "http://x.net/de/2", link("http://good.info/", "http://spam3.info/") + "<a href=http://q.org/es/>"), (105, "http://plain.info/", link("/rel", "http://plain.info/2")), (106, None, link("http://y.org/")),
    ]
    got = found(filter_urls(spark.createDataFrame(pages, "page_id long, url string, html string")))
    assert got == brute(pages)
    verdict = {r[0]: r[4] for r in got}
    assert verdict[100] == verdict[101] == "block" and verdict[103] == verdict[105] == "allow"


@pytest.mark.parametrize("rows", [[], [(None, None, None), (None, None, None)], [(1, "http://a.com/en/", "x" * 100_000)] * 3])
def test_odd_tables(spark, rows):
    df = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "'old' host", "'old' verdict")
    out = filter_urls(df)
    assert found(out) == brute(rows) and sorted(out.columns) == ["host", "html", "page_id", "path", "rule", "url", "verdict"]


def test_verdicts_of_a_pattern_stay_when_hosts_are_added(spark):
    link = lambda *to: " ".join(f'<a href="{t}">l</a>' for t in to)
    pattern = [
        (1, "http://spam.info/", link("http://bad.org/es/1")), (2, "http://bad.org/es/1", ""), (3, "http://mixed.info/", link("http://bad.org/es/1")), (4, "http://x.net/de/1", link("http://mixed.info/", "http://good.info/")),
        (5, "http://good.info/", ""), (6, "http://behind.info/", link("http://spam.info/")), (7, "http://plain.info/", link("http://good.info/")),
    ]
    more = [(100 + i, f"http://h{i}.{('com/en', 'org/es', 'net/de', 'info')[i % 4]}/", link(f"http://h{i + 1}.info/")) for i in range(4000)]
    verdicts = [{r[0]: r[4] for r in found(filter_urls(spark.createDataFrame(rows, "page_id long, url string, html string"))) if r[0] < 100} for rows in (pattern, pattern + more)]
    assert verdicts[0] == verdicts[1] == {1: "block", 2: "block", 3: "allow", 4: "allow", 5: "allow", 6: "block", 7: "allow"}


def test_sql_gives_the_same_rows(spark):
    import duckdb

    from tokenloom.llm.url_filter import OP8_SQL

    link = lambda *to: " ".join(f'<a class="x" href="{t}">l</a>' for t in to)
    pages = [(i, u, None) for i, u in enumerate(URLS)] + [
        (100, "http://spam1.info/", link("http://y.org/es/1", "http://yorg/x")), (101, "http://spam2.info/a", link("//y.org/es/2")), (102, "http://spam3.info/", link("http://spam1.info/", "http://spam2.info/")), (102, "http://spam3.info/", link("http://spam1.info/")),
        (104, "http://x.net/de/2", link("http://good.info/", "http://spam3.info/") + "<a href=http://q.org/es/>"), (105, "http://plain.info/", link("/rel", "http://plain.info/2")), (106, None, link("http://y.org/")), (107, "http://Y.org/\nx", "<a\nhref='http://q.org/'>"),
    ]
    for rows in (pages, pages[: len(URLS)], []):
        con = duckdb.connect()
        con.execute("CREATE TABLE pages (page_id BIGINT, url VARCHAR, html VARCHAR)")
        if rows:
            con.executemany("INSERT INTO pages VALUES (?, ?, ?)", rows)
        cur = con.execute(OP8_SQL)
        at = [[d[0] for d in cur.description].index(c) for c in ("page_id", "host", "path", "rule", "verdict")]
        assert sorted((tuple(r[i] for i in at) for r in cur.fetchall()), key=repr) == found(filter_urls(spark.createDataFrame(rows, "page_id long, url string, html string")))
