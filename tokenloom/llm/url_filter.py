"""URL filters: rules first, and for what no rule fits, trust and distrust spread over the links between hosts.

Trust is a personalised PageRank that starts from hosts in proportion to the share of their pages that a rule allows and follows
links; distrust starts from the share that a rule blocks and follows links backwards, to those who link there. A rule has
judged a seed's own paths already, so a host's other pages are judged by what reaches it over links alone: it is blocked
if the distrust that reaches it is over DISTRUST and over the trust that does. Both are counted in pages' shares of one host, not as
parts of the table's total, so hosts that have nothing to do with it don't change a verdict, however many there are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .common import ascii_lower, materialise, others, quoted

#: Fixed values of the contract: verdict, and host and path in one.
RULES = (("block", "com/en/"), ("allow", "example.com/en/7"), ("allow", "net/de/"), ("block", "example.net/de/8"), ("block", "org/es/"))
ROUNDS, DAMPING, DISTRUST = 20, 0.85, 0.01
MADE = ("host", "path", "rule", "verdict")
_URL = r"(?s)^.*?://([^/?#]*)([^?#]*)"


def host_of(url: Column) -> Column:
    return ascii_lower(F.coalesce(F.regexp_extract(url, _URL, 1), F.lit("")))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, _URL, 2), F.lit(""))


def rule_of(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """The longest rule that fits, and its verdict; both null if none does."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for v, r in sorted(rules, key=lambda x: len(x[1])):  # the longest is asked first, as it is put last
        of, slash, start = r.partition("/")
        fits = ((host == of) | F.endswith(host, F.lit("." + of))) & F.startswith(path, F.lit(slash + start))
        rule, verdict = F.when(fits, F.lit(r)).otherwise(rule), F.when(fits, F.lit(v)).otherwise(verdict)
    return rule, verdict


def host_links(pages: DataFrame, html_col: str) -> DataFrame:
    """src, dst, n: on how many pages a host links to another one. pages has __host."""
    hrefs = F.regexp_extract_all(F.coalesce(F.col(quoted(html_col)).cast("string"), F.lit("")), F.lit(r"""(?i)<a\s[^>]*?\bhref\s*=\s*["']?\s*((?:https?:)?//[^"'\s>]+)"""), F.lit(1))
    to = F.array_distinct(F.transform(hrefs, lambda u: host_of(F.when(F.startswith(u, F.lit("//")), F.concat(F.lit("http:"), u)).otherwise(u))))
    return pages.select(F.col("__host").alias("src"), F.explode(to).alias("dst")).where("src <> dst AND src <> '' AND dst <> ''").groupBy("src", "dst").agg(F.count(F.lit(1)).alias("n"))


def spread(seeds: DataFrame, edges: DataFrame, rounds: int = ROUNDS, damping: float = DAMPING) -> DataFrame:
    """host, reached: what arrives over edges (a, b, n) in a PageRank that restarts at seeds (host, seed), in proportion to them.

    Each round joins the ranks with the edges and adds up by target. Ranks are written out: lineage stays short, and as both sides of the join are
    plain exchanges, Spark can split the edges of a host with very many.
    """
    out_n = edges.groupBy("a").agg(F.sum("n").alias("all"))
    shares = materialise(edges.join(out_n, "a").select("a", "b", (F.col("n") / F.col("all")).alias("share")))
    hosts = materialise(seeds.select("host").union(shares.select("a")).union(shares.select("b")).distinct().join(seeds, "host", "left").select("host", F.coalesce("seed", F.lit(0.0)).alias("seed")))
    ranks = hosts.select("host", F.col("seed").alias("rank"), F.lit(0.0).alias("reached"))
    for _ in range(rounds):
        moved = ranks.join(shares, F.col("host") == F.col("a")).groupBy("b").agg((F.sum(F.col("rank") * F.col("share")) * damping).alias("reached"))
        ranks = hosts.join(moved, F.col("host") == F.col("b"), "left").select("host", ((1 - damping) * F.col("seed") + F.coalesce("reached", F.lit(0.0))).alias("rank"), F.coalesce("reached", F.lit(0.0)).alias("reached"))
        ranks = materialise(ranks)
    return ranks.select("host", "reached")


def filter_urls(df: DataFrame, url_col: str = "url", html_col: str = "html", rules=RULES) -> DataFrame:
    """df with host, path, rule (null where none fits) and verdict (allow or block).

    A null url, or one without `://`, has an empty host and path, fits no rule and is allowed. A null html has no links. Repeated
    rows weigh as pages of their own. Without links between hosts, pages that no rule fits are allowed. An empty table stays
    empty. Input columns named as a made column are replaced; all others are carried along.
    """
    url = F.col(quoted(url_col)).cast("string")
    pages = df.withColumns({"__host": host_of(url), "__path": path_of(url)})
    rule, verdict = rule_of(F.col("__host"), F.col("__path"), rules)
    pages = pages.withColumns({"__rule": rule, "__verdict": verdict})
    links = materialise(host_links(pages, html_col))
    out = pages.select(*others(df, *MADE), F.col("__host").alias("host"), F.col("__path").alias("path"), F.col("__rule").alias("rule"), "__verdict")
    if links.isEmpty():
        return out.withColumn("verdict", F.coalesce("__verdict", F.lit("allow"))).drop("__verdict")
    per = materialise(pages.groupBy("__host").agg(*[F.avg((F.coalesce("__verdict", F.lit("")) == v).cast("double")).alias(v) for v in ("allow", "block")]).withColumnRenamed("__host", "host"))
    judged = None
    for v, edges in (("allow", links.select(F.col("src").alias("a"), F.col("dst").alias("b"), "n")), ("block", links.select(F.col("dst").alias("a"), F.col("src").alias("b"), "n"))):
        seeds = per.where(F.col(v) > 0).select("host", F.col(v).alias("seed"))
        reached = spread(seeds, edges).withColumnRenamed("reached", v)
        judged = reached if judged is None else judged.join(reached, "host", "full")
    bad = judged.where((F.coalesce("block", F.lit(0.0)) > F.lit(DISTRUST)) & (F.coalesce("block", F.lit(0.0)) > F.coalesce("allow", F.lit(0.0)))).select(F.col("host").alias("__bad"))
    out = out.join(bad, F.col("host") == F.col("__bad"), "left")
    return out.withColumn("verdict", F.coalesce("__verdict", F.when(F.col("__bad").isNotNull(), "block").otherwise("allow"))).drop("__verdict", "__bad")


def op8_url_filter(spark, sf_dir):
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html")
    return filter_urls(pages).select("page_id", *MADE)


def _sql() -> str:
    """The same rows in SQL: rules by nested cases, and each round of the two spreads as a table of its own."""
    rule, verdict = "NULL", "NULL"
    for v, r in sorted(RULES, key=lambda x: len(x[1])):
        of, slash, start = r.partition("/")
        fits = f"(host = '{of}' OR ends_with(host, '.{of}')) AND starts_with(path, '{slash}{start}')"
        rule, verdict = f"CASE WHEN {fits} THEN '{r}' ELSE {rule} END", f"CASE WHEN {fits} THEN '{v}' ELSE {verdict} END"
    parts = [
        f"""WITH u AS (SELECT page_id, coalesce(html, '') AS html, translate(coalesce(regexp_extract(url, '{_URL}', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, coalesce(regexp_extract(url, '{_URL}', 2), '') AS path FROM pages),
p AS (SELECT *, row_number() OVER () AS row, {rule} AS rule, {verdict} AS judged FROM u)""",
        """t AS (SELECT row, host AS src, unnest(regexp_extract_all(html, '(?i)<a\\s[^>]*?\\bhref\\s*=\\s*["'']?\\s*((?:https?:)?//[^"''\\s>]+)', 1)) AS link FROM p)""",
        f"""l AS MATERIALIZED (SELECT src, dst, count(DISTINCT row) AS n FROM (SELECT row, src, translate(regexp_extract(CASE WHEN starts_with(link, '//') THEN 'http:' || link ELSE link END, '{_URL}', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS dst FROM t) WHERE src <> dst AND src <> '' AND dst <> '' GROUP BY ALL)""",
    ]
    for v, (a, b) in (("allow", ("src", "dst")), ("block", ("dst", "src"))):
        parts += [
            f"{v}_s AS MATERIALIZED (SELECT host, avg(CASE WHEN coalesce(judged, '') = '{v}' THEN 1.0 ELSE 0.0 END) AS seed FROM p GROUP BY host HAVING seed > 0)",
            f"{v}_e AS MATERIALIZED (SELECT {a} AS a, {b} AS b, n / sum(n) OVER (PARTITION BY {a}) AS share FROM l)",
            f"{v}_h AS MATERIALIZED (SELECT host, coalesce(seed, 0) AS seed FROM (SELECT host FROM {v}_s UNION SELECT a FROM {v}_e UNION SELECT b FROM {v}_e) LEFT JOIN {v}_s USING (host))",
            f"{v}_0 AS MATERIALIZED (SELECT host, seed AS rank, 0.0 AS reached FROM {v}_h)",
            *[f"{v}_{k + 1} AS MATERIALIZED (SELECT h.host, {1 - DAMPING} * seed + coalesce(m.x, 0) AS rank, coalesce(m.x, 0) AS reached FROM {v}_h h LEFT JOIN (SELECT b, {DAMPING} * sum(rank * share) AS x FROM {v}_{k} JOIN {v}_e ON host = a GROUP BY b) m ON m.b = h.host)" for k in range(ROUNDS)],
        ]
    bad = f"SELECT host FROM block_{ROUNDS} b LEFT JOIN (SELECT host, reached AS trust FROM allow_{ROUNDS}) a USING (host) WHERE b.reached > {DISTRUST} AND b.reached > coalesce(trust, 0)"
    return ",\n".join(parts) + f"\nSELECT page_id, host, path, rule, coalesce(judged, CASE WHEN host IN ({bad}) THEN 'block' ELSE 'allow' END) AS verdict FROM p"


OP8_SQL = _sql()
