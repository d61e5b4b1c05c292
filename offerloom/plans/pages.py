"""Queries over raw pages."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import expressions as ex
from ..functions import fixed
from ..operators import crawl as cr
from ..sources import html
from ..sources.tables import table

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


_TEXT = "trim(regexp_replace(replace(replace(replace(replace({0}, '&lt;', '<'), '&gt;', '>'), '&quot;', '\"'), '&amp;', '&'), '\\s+', ' ', 'g'))"
_TITLE = _TEXT.format("regexp_extract(html, '<title>([^<]*)</title>', 1)")
_H1 = _TEXT.format("regexp_extract(html, '<h1>([^<]*)</h1>', 1)")


@query(f"SELECT page_id, {_TITLE} AS title, {_H1} AS h1 FROM pages WHERE html IS NOT NULL")
def page_titles(spark, d):
    return html.summaries(table(spark, d, "pages"), "page_id").select("page_id", "title", "h1")


@query("""SELECT page_id, CAST(count(*) AS BIGINT) AS links, count(*) FILTER (starts_with(h, '<a href="/')) AS local FROM (SELECT page_id, unnest(regexp_extract_all(html, '<a href="[^"]+"')) AS h FROM pages) GROUP BY 1""")
def page_links(spark, d):
    found = html.anchors(table(spark, d, "pages"), "page_id")
    return found.groupBy("page_id").agg(F.count(F.lit(1)).alias("links"), F.count_if(F.col("href").startswith("/")).alias("local"))


@query()
def page_records(spark, d):
    return html.records(table(spark, d, "pages"), "page_id").drop("data")


@query(f"""SELECT page_id, 'title' AS name, title AS value, CAST(0.74 AS DOUBLE) AS confidence, 'title' AS kind, 'document/html[1]/head[1]/title[1]' AS place, CAST(NULL AS VARCHAR) AS error FROM (SELECT page_id, {_TITLE} AS title FROM pages WHERE html IS NOT NULL) WHERE title <> ''""")
def page_signals(spark, d):
    return html.signals(table(spark, d, "pages"), "page_id")


def _sql_list(words):
    return "[" + ", ".join(f"'{w}'" for w in words) + "]"


# Paths of the test pages say nothing about offers, so a word of each kind is put before them.
_WORDS = ["promo/deals", "shop", "category", "login", "coupon/sale/offers/discount/promo"]
_ANCHORS = ["Промокод и скидка", "Read on", "All coupons: discount, deal, cashback"]
_MADE = "SELECT page_id, regexp_replace(split_part(url, '#', 1), '(https?://[^/]+)/', '\\1/' || " + f"{_sql_list(_WORDS)}[page_id % 5 + 1] || '/') AS u, {_sql_list(_ANCHORS)}[page_id % 3 + 1] AS a FROM pages"
_PARTS = "SELECT *, list_filter(string_split(lower(regexp_replace(split_part(u, '?', 1), '^https?://[^/]+', '')), '/'), lambda p: p <> '') AS parts, list_transform(string_split(split_part(u, '?', 2), '&'), lambda p: lower(split_part(p, '=', 1))) AS keys FROM (" + _MADE + ")"
_AMONG = lambda words: f"len(list_distinct(list_intersect(parts, {_sql_list(words)})))"
_SCORED = (
    f"SELECT page_id, CASE WHEN {_AMONG(fixed.NEGATIVE_SEGMENTS)} > 0 THEN -100.0 ELSE CASE WHEN {_AMONG(fixed.STRONG_SEGMENTS)} > 0 THEN least(5.0, 3.5 + 0.5 * ({_AMONG(fixed.STRONG_SEGMENTS)} - 1)) ELSE 0 END"
    f" + CASE WHEN {_AMONG(fixed.MERCHANT_SEGMENTS)} > 0 THEN 1.25 ELSE 0 END - CASE WHEN {_AMONG(fixed.NAVIGATION_SEGMENTS)} > 0 THEN 1.5 ELSE 0 END - CASE WHEN list_has_any(keys, {_sql_list(fixed.PAGINATION_KEYS)}) THEN 2.0 ELSE 0 END"
    f" + least(2.0, 0.75 * len(list_filter({_sql_list(fixed.DISCOUNT_TERMS)}, lambda t: contains(lower(a), t)))) END AS score FROM ({_PARTS})"
)


@query(f"SELECT page_id, CAST(score AS DOUBLE) AS score, CASE WHEN score >= 5 THEN 'target' WHEN score >= 2 THEN 'candidate' ELSE 'non_target' END AS status FROM ({_SCORED})")
def link_relevance(spark, d):
    return _relevance(spark, d).select("page_id", "score", "status")


@query(f"""SELECT page_id, CAST(score AS DOUBLE) AS score FROM ({_SCORED}) WHERE score >= 2 ORDER BY score >= 5 DESC, score DESC, page_id LIMIT 100""")
def selected_urls(spark, d):
    return cr.selected(_relevance(spark, d).withColumn("discovery_index", F.col("page_id"))).select("page_id", "score")


def _relevance(spark, d):
    pick = lambda words, n: F.element_at(F.array(*[F.lit(w) for w in words]), (F.pmod("page_id", F.lit(n)) + 1).cast("int"))
    url = F.regexp_replace(F.substring_index("url", "#", 1), F.lit("(https?://[^/]+)/"), F.concat(F.lit("$1/"), pick(_WORDS, 5), F.lit("/")))
    made = table(spark, d, "pages").select("page_id", cr.link_score(url, pick(_ANCHORS, 3)).alias("score"))
    return made.withColumn("status", cr.status(F.col("score")))


_HREF = "SELECT page_id, url, unnest(regexp_extract_all(html, '<a href=\"([^\"]+)\"', 1)) AS h FROM pages"
_ORIGIN = "regexp_extract(url, '^https?://[^/?#]+')"


@query(f"""SELECT page_id, count(*) AS links, count(DISTINCT CASE WHEN starts_with(h, '/') THEN {_ORIGIN} || h ELSE h END) AS targets FROM ({_HREF}) WHERE starts_with(h, '/') OR starts_with(h, 'http') GROUP BY 1""")
def resolved_links(spark, d):
    pages = table(spark, d, "pages")
    found = html.anchors(pages, "page_id").join(pages.select("page_id", "url"), "page_id")
    to = found.select("page_id", ex.resolve_link(F.col("url"), F.col("href")).alias("to")).where("to IS NOT NULL")
    return to.groupBy("page_id").agg(F.count(F.lit(1)).alias("links"), F.count_distinct("to").alias("targets"))


@query("""WITH RECURSIVE l AS (SELECT page_id % 50 AS src, page_id AS dst FROM pages UNION ALL SELECT page_id, page_id + 7 FROM pages), b AS (SELECT CAST(0 AS BIGINT) AS k, 0 AS depth UNION SELECT dst, depth + 1 FROM b JOIN l ON l.src = b.k WHERE depth < 2)
SELECT k AS url, min(depth) AS depth FROM b GROUP BY 1""")
def crawl_reach(spark, d):
    """Pages within two steps of page 0, over links made from the numbers of all pages."""
    p = table(spark, d, "pages").select(F.col("page_id").cast("long").alias("p"))
    links = p.select((F.col("p") % 50).alias("s"), F.col("p").alias("t")).union(p.select("p", F.col("p") + 7))
    edges = links.select(F.col("s").cast("string").alias("url"), F.col("t").cast("string").alias("target"), F.col("t").cast("int").alias("position"), F.lit(False).alias("nofollow"))
    seeds = spark.createDataFrame([("0", 0)], "url string, position int")
    return cr.discover(seeds, edges, 2, 1_000_000, 1_000_000).select(F.col("url").cast("long").alias("url"), "depth")
