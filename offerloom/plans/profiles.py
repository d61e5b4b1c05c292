"""Queries of extraction profiles."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import expressions as ex
from ..operators import inference
from ..operators import profiles as pr
from ..sources import containers
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


_NOW = "2026-01-01 00:00:00"

# Name, cards, title and link of each profile, and the cards as SQL over the list of menu entries
# ``li`` (numbers from 1) or over another list of texts.
_ENTRY = "list_transform(list_filter({0}, lambda x: {1}), lambda x: {{'title': x.t, 'href': x.h}})"
_PROFILES = [
    ("all", "nav li", "a", "a", _ENTRY.format("li", "true")),
    ("children", "body > nav > ul > li", "a", "a[href]", _ENTRY.format("li", "true")),
    ("first", "nav li:first-child", "a", "a", _ENTRY.format("li", "x.k = 1")),
    ("second", "ul > li:nth-child(2)", ":scope > a", "a", _ENTRY.format("li", "x.k = 2")),
    ("odd", "li:nth-of-type(2n+1)", "a", ":scope > a", _ENTRY.format("li", "x.k % 2 = 1")),
    ("after", "li + li", "a", "a", _ENTRY.format("li", "x.k > 1")),
    ("later", "li:nth-child(2) ~ li", "a", "a", _ENTRY.format("li", "x.k > 2")),
    ("th", 'nav a[href^="/th"]', ":scope", None, _ENTRY.format("li", "starts_with(x.h, '/th')").replace("'href': x.h", "'href': NULL")),
    ("no e", 'nav a:not([href*="e"])', None, None, _ENTRY.format("li", "NOT contains(x.h, 'e')").replace("'href': x.h", "'href': NULL")),
    ("ends", "nav a[href$='n'], nav a[href$='e']", None, None, _ENTRY.format("li", "ends_with(x.h, 'n') OR ends_with(x.h, 'e')").replace("'href': x.h", "'href': NULL")),
    ("advert", "body > div.ad", None, None, "list_transform(ads, lambda x: {'title': x, 'href': NULL})"),
    ("any advert", "html .ad", ".missing", "footer a", "list_transform(ads, lambda x: {'title': x, 'href': NULL})"),
    ("heading", "article > h1", None, None, "list_transform(h1, lambda x: {'title': x, 'href': NULL})"),
    ("page title", "head title", ":scope", None, "list_transform(titles, lambda x: {'title': x, 'href': NULL})"),
]
_PLAIN = "replace(replace(replace(replace({0}, '&lt;', '<'), '&gt;', '>'), '&quot;', '\"'), '&amp;', '&')"
_ALL = lambda pattern: f"list_filter(list_transform(regexp_extract_all(html, '{pattern}', 1), lambda x: trim({_PLAIN.format('x')})), lambda x: x <> '')"
_PARTS = (
    "SELECT page_id, url, list_transform(range(1, len(e) + 1), lambda k: {'k': k, 'h': " + _PLAIN.format("regexp_extract(e[k], 'href=\"([^\"]*)\"', 1)") + ", 't': trim(" + _PLAIN.format("regexp_extract(e[k], '>([^<]*)</a>', 1)") + ")}) AS li,"
    f" {_ALL('<div class=\"ad\">([^<]*)</div>')} AS ads, {_ALL('<h1>([^<]*)</h1>')} AS h1, {_ALL('<title>([^<]*)</title>')} AS titles"
    " FROM (SELECT *, regexp_extract_all(regexp_extract(html, '<nav>.*?</nav>'), '<li>.*?</li>') AS e FROM pages WHERE html IS NOT NULL)"
)
_ROWS = " UNION ALL ".join(f"SELECT page_id, url, '{name}' AS profile, unnest({cards}) AS x FROM p" for name, _, _, _, cards in _PROFILES)


@query(f"""WITH p AS ({_PARTS}), r AS ({_ROWS}),
i AS (SELECT page_id, profile, left(x.title, 1000) AS title, left(x.title, 12000) AS text, CASE WHEN x.href IS NULL THEN url ELSE regexp_extract(url, '^[^:]+://[^/]+') || x.href END AS url FROM r WHERE x.title <> '')
SELECT page_id, profile, title, url, sha256(url || '|' || title || '|' || text) AS external_id FROM i""")
def profile_items(spark, d):
    """Fourteen profiles on every page, given by site."""
    pages = table(spark, d, "pages").select(F.col("page_id").alias("key"), ex.url_host(F.col("url")).alias("site"), "url", "html")
    rows = [(name, item, title, link) for name, item, title, link, _ in _PROFILES]
    known = spark.createDataFrame(rows, "profile string, item_selector string, title_selector string, link_selector string")
    profiles = pages.select("site").distinct().join(F.broadcast(known))  # fourteen rows for every site
    found = pr.profile_items(pages, profiles, F.lit(_NOW).cast("timestamp"))
    return found.where("error IS NULL").select(F.col("key").alias("page_id"), "profile", "title", "url", "external_id")


# Selectors as a browser copies them: a card in a numbered place, and fields inside and outside it.
_SAMPLE = "'#list > div.page' || page_id || ' > article.card:nth-child(' || page_id % 7 || ')' || CASE WHEN page_id % 2 = 0 THEN ':nth-of-type(3)' ELSE '' END"
_CARD = "'#list > div.page' || page_id || ' > article.card'"


@query(f"""SELECT page_id, {_CARD} AS item_selector, CASE page_id % 4 WHEN 0 THEN ':scope' WHEN 1 THEN 'h3 > a:nth-child(2)' WHEN 2 THEN 'header > h1' ELSE 'p.terms' END AS title_selector,
CASE WHEN page_id % 3 = 0 THEN NULL ELSE 'a' END AS link_selector, CASE WHEN page_id % 5 = 0 THEN 'data-src' END AS image_attribute FROM pages""")
def profile_selectors(spark, d):
    sample = F.expr(f"concat('  ', {_SAMPLE}, ' ')")
    title = F.expr(f"CASE page_id % 4 WHEN 0 THEN {_SAMPLE} WHEN 1 THEN {_SAMPLE} || ' > h3 > a:nth-child(2)' WHEN 2 THEN ' header > h1' ELSE {_CARD} || ' > p.terms' END")
    link = F.expr(f"CASE WHEN page_id % 3 = 0 THEN '  ' ELSE {_CARD} || ' >  a' END")
    copied = table(spark, d, "pages").select(
        "page_id", F.lit("s").alias("site"), F.col("page_id").cast("string").alias("profile"), sample.alias("item_selector"), title.alias("title_selector"), link.alias("link_selector"),
        F.expr("CASE WHEN page_id % 5 = 0 THEN ' data-src ' ELSE '' END").alias("image_attribute"),
    )
    found = pr.normalized_profiles(copied)
    return found.select(F.col("profile").cast("long").alias("page_id"), "item_selector", "title_selector", "link_selector", "image_attribute")


# Listing pages of three layouts, one for each site, with three to five cards on a page.
_SITE = "regexp_extract(url, '^[^:]+://([^/?#:]+)', 1)"
_CARDS = "3 + page_id % 3"
_LAYOUTS = [
    ('<nav><ul><li>Главная страница магазина скидок</li></ul></nav><ul class="list">', '<li class="offer"><h3>Скидка {k}%</h3><p>Скидка на весь заказ</p><a href="/x/{k}">К</a></li>', "</ul>"),
    ('<div class="grid">', "<article><h4>Подарок номер {k}</h4><p>дарим по промокоду</p><code>GIFT{k}00</code></article>", "</div><div><p>Все скидки на этой странице</p></div>"),
    ("<main>", '<div class="promo-card a1b2c3d4e5"><strong>Товар {k}</strong><span>до {k} мая</span><div>Промокод на скидку</div><a href="/y/{k}">К</a><img src="/i/{k}.png"></div>', "</main>"),
]
_LEARNT = [
    {"item_selector": "li.offer", "title_selector": "h3", "conditions_selector": "p", "link_selector": "a", "filled": 3},
    {"item_selector": "article", "title_selector": "h4", "promo_code_selector": "code", "conditions_selector": "p", "filled": 3},
    {"item_selector": "div.promo-card", "title_selector": "strong", "conditions_selector": "div", "valid_until_selector": "span", "link_selector": "a", "image_selector": "img", "filled": 5},
]
_LAYOUT = f"length({_SITE}) % 3"


def _listings(spark, d):
    spelled = []
    for k, (head, card, tail) in enumerate(_LAYOUTS):
        parts = "', x, '".join(card.split("{k}"))
        spelled.append(f"WHEN {k} THEN concat('{head}', array_join(transform(sequence(1, {_CARDS}), x -> concat('{parts}')), ''), '{tail}')")
    made = F.expr(f"concat('<html><body>', CASE {_LAYOUT} {' '.join(spelled)} END, '</body></html>')")
    return table(spark, d, "pages").select(F.col("page_id").alias("key"), F.expr(_SITE).alias("site"), "url", made.alias("html"))


def _inferred(spark, d):
    """Learnt on the pages with even numbers."""
    seen = _listings(spark, d).where("key % 2 = 0")
    pages = inference.page_profiles(containers.containers(seen, "key"), "key").join(seen.select("key", "site"), "key")
    return inference.site_profiles(pages, "site")


@query(f"""SELECT site, {", ".join(f"CASE lay " + " ".join(f"WHEN {k} THEN '{x[n]}'" for k, x in enumerate(_LEARNT) if n in x) + f" END AS {n}" for n in ("item_selector", "title_selector", "promo_code_selector", "conditions_selector", "valid_until_selector", "link_selector", "image_selector"))},
pages, cards, CAST(round(least(0.94, 0.68 + 0.04 * (CASE lay {" ".join(f"WHEN {k} THEN {x['filled']}" for k, x in enumerate(_LEARNT))} END) + 0.02 * most), 2) AS DOUBLE) AS confidence
FROM (SELECT {_SITE} AS site, any_value({_LAYOUT}) AS lay, count(*) AS pages, CAST(sum({_CARDS}) AS BIGINT) AS cards, max({_CARDS}) AS most FROM pages WHERE page_id % 2 = 0 GROUP BY 1)""")
def inferred_profiles(spark, d):
    columns = ["item_selector", "title_selector", "promo_code_selector", "conditions_selector", "valid_until_selector", "link_selector", "image_selector"]
    return _inferred(spark, d).select("site", *columns, "pages", "cards", "confidence")


@query(f"""SELECT {_SITE} AS site, CAST(sum({_CARDS}) AS BIGINT) AS planted, CAST(sum({_CARDS}) AS BIGINT) AS found FROM pages WHERE page_id % 2 = 1 AND {_SITE} IN (SELECT {_SITE} FROM pages WHERE page_id % 2 = 0) GROUP BY 1""")
def inferred_recall(spark, d):
    """Cards that the inferred profiles find on the other half of each site's pages."""
    unseen = _listings(spark, d).where("key % 2 = 1").withColumn("planted", F.expr(_CARDS.replace("page_id", "key")))
    learnt = _inferred(spark, d)
    found = pr.profile_items(unseen.drop("planted"), learnt, F.lit(_NOW).cast("timestamp")).where("error IS NULL").groupBy("key").agg(F.count(F.lit(1)).alias("n"))
    both = unseen.join(learnt.select("site"), "site").join(found, "key", "left")
    return both.groupBy("site").agg(F.sum("planted").cast("long").alias("planted"), F.coalesce(F.sum("n"), F.lit(0)).alias("found"))


@query("""SELECT c_custkey, CAST(CASE WHEN items = 0 THEN 0.0 WHEN adapted > 0 THEN 0.98 WHEN items >= 3 AND codes > 0 THEN 0.9 WHEN items >= 3 AND titles >= 2 THEN 0.82 WHEN titles > 0 THEN 0.68 ELSE 0.5 END AS DOUBLE) AS confidence
FROM (SELECT c_custkey, count(o_orderkey) AS items, count(*) FILTER (o_orderpriority = '1-URGENT' AND o_orderstatus = 'P') AS adapted, count(*) FILTER (o_orderstatus = 'F') AS codes, count(*) FILTER (o_orderpriority <> '5-LOW') AS titles FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1)""")
def source_confidence(spark, d):
    """Customers as sources, their orders as items."""
    o = table(spark, d, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(
        F.count(F.lit(1)).alias("items"), F.count_if(F.expr("o_orderpriority = '1-URGENT' AND o_orderstatus = 'P'")).alias("adapted"),
        F.count_if(F.col("o_orderstatus") == "F").alias("codes"), F.count_if(F.col("o_orderpriority") != "5-LOW").alias("titles"),
    )
    counts = table(spark, d, "customer").select("c_custkey").join(o, "c_custkey", "left").fillna(0)
    return counts.select("c_custkey", inference.source_confidence(*[F.col(n) for n in ("items", "adapted", "codes", "titles")]).alias("confidence"))
