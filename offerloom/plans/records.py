"""Queries from record slices to offers."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from ..operators import blocks
from ..operators import record_fields as rf
from ..operators import semantic_records as sr
from ..sources import html, jsonld
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


def _filled(template: str) -> str:
    """A text with {n} and {id} as SQL: n is 10 to 89, id the page's number."""
    parts = re.split(r"\{(n|id)\}", template)
    return " || ".join(f"'{p}'" if k % 2 == 0 else {"n": "CAST(10 + page_id % 80 AS STRING)", "id": "CAST(page_id AS STRING)"}[p] for k, p in enumerate(parts) if p)


# A card of each kind that a record can be anchored by, and the fields that it states. ``link`` is null
# where the card has none; ``key`` are the parts of the identity, or the identity itself in ``given``.
_CARDS = [
    {"html": '<article><h3>Скидка {n}% от Альфа на обувь</h3><p>Срок</p><a href="/go/{id}">Подробнее</a></article>', "link": "/go/{id}", "merchant": "Альфа", "title": "Скидка {n}% от Альфа на обувь", "percent": "{n}", "key": "UT", "said": "heading_pattern heading - heading"},
    {"html": '<ul><li><img alt="Бета" src="/i.png"><b>осталось 3 дня</b> Скидка до {n}%<a href="/r?offer_id={id}">Купить</a></li></ul>', "link": "/r?offer_id={id}", "merchant": "Бета", "title": "Скидка до {n}% осталось 3 дня Купить", "percent": "{n}", "image": "/i.png", "given": "{id}", "said": "image_alt text - offer_id"},
    {"html": '<div data-promocode="SAVE{n}" class="x"><h4>Доставка</h4><b>Гамма</b> <span>{n} ₽</span></div>', "merchant": "Гамма", "title": "Доставка Гамма {n} ₽", "code": "SAVE{n}", "amount": "{n}", "key": "UMTC", "said": "strong text data-promocode machine_code"},
    {"html": '<div data-coupon-id="{id}"><b>Скидка {n}%</b> на всё</div>', "merchant": "на всё", "title": "Скидка {n}%", "percent": "{n}", "given": "shop-coupon:{id}", "said": "before_benefit text - coupon_id"},
    {"html": '<article><strong>Дельта</strong><p>Кэшбэк {n}%</p><a href="/o/{id}">Открыть промокод</a></article>', "link": "/o/{id}", "merchant": "Дельта", "title": "Кэшбэк {n}%", "cashback": "{n}", "key": "UMT", "said": "strong text - opens"},
    {"html": '<ul><li><img src="/p.png" alt="Эпсилон"><p>Бонус {n} руб</p><a href="/s/{id}">Показать промокод</a></li></ul>', "link": "/s/{id}", "merchant": "Эпсилон", "title": "Бонус {n} руб", "amount": "{n}", "image": "/p.png", "key": "UT", "said": "image_alt text - shows"},
    {"html": '<article><h3>Магазин Зета</h3><p>Заказ от 500 ₽. Код ZETA{n}</p><a href="/a/{id}">Активировать промокод</a></article>', "link": "/a/{id}", "merchant": "Магазин Зета", "title": "Заказ от 500 ₽. Код ZETA{n}", "code": "ZETA{n}", "amount": "500", "key": "UMTC", "said": "heading text labelled activates"},
    {"html": "<article>Скидка {n}% для студентов <b>до 31.12.2030</b></article>", "merchant": "до 31.12.2030", "title": "Скидка {n}% для студентов до 31.12.2030", "percent": "{n}", "code": "2030", "until": "2030-12-31 23:59:59", "key": "UT", "said": "strong text scanned code"},
    {"html": '<section><article><p>Промокод XY{n}ZW на 300 ₽ от Йота</p><button>Получить промокод от Йота</button></article></section>', "merchant": "Йота Получить промокод от Йота", "title": "Промокод XY{n}ZW на 300 ₽ от Йота", "code": "XY{n}ZW", "amount": "300", "key": "UMTC", "said": "text_after_from text labelled activates"},
]
_SIZE = len(_CARDS)


def _case(field: str, none: str = "NULL") -> str:
    return f"CASE page_id % {_SIZE} " + " ".join(f"WHEN {k} THEN {_filled(c[field])}" for k, c in enumerate(_CARDS) if c.get(field)) + f" ELSE {none} END"


def _identity() -> str:
    part = {"U": "u", "T": "title", "M": "coalesce(merchant, '')", "C": "coalesce(promo_code, '')"}
    # A heading's identity, and that of a card that is known by its code, end in the code.
    keys = {"UT": "u || '|' || title"}
    cases = []
    for k, c in enumerate(_CARDS):
        if "given" in c:
            cases.append(f"WHEN {k} THEN {_filled(c['given'])}")
            continue
        text = keys.get(c["key"]) or " || '|' || ".join(part[x] for x in c["key"])
        if c["said"].split()[-1] in ("heading", "code"):
            text += " || '|' || coalesce(promo_code, '')"
        cases.append(f"WHEN {k} THEN substr(sha256({text}), 1, 32)")
    return f"CASE page_id % {_SIZE} {' '.join(cases)} END"


_ORIGIN = "regexp_extract(url, '^[^:]+://[^/?#]+')"


@query(f"""WITH f AS (SELECT page_id, url, CASE WHEN {_case('link')} IS NULL THEN url ELSE {_ORIGIN} || {_case('link')} END AS u, {_case('title')} AS title, {_case('merchant')} AS merchant, {_case('code')} AS promo_code FROM pages)
SELECT page_id, {_identity()} AS external_id, u AS offer_url, title, merchant, promo_code, CAST({_case('percent')} AS INTEGER) AS discount_percent, CAST({_case('cashback')} AS INTEGER) AS cashback_percent,
CAST({_case('amount')} AS DECIMAL(14,2)) AS discount_amount, {_ORIGIN} || {_case('image')} AS image_url, {_case('until')} AS valid_until, {_case('said')} AS said FROM f""")
def record_fields(spark, d):
    """A card on every page, in turn of each kind, read from its HTML."""
    cards = table(spark, d, "pages").select("page_id", "url", F.expr(f"concat('<html><body>', {_case('html')}, '</body></html>')").alias("html"))
    found = html.records(cards.repartition("page_id"), "page_id").where("error IS NULL").join(cards.select("page_id", F.col("url").alias("source_url")), "page_id")
    fields = rf.offer_fields(found.withColumn("source_key", F.lit("shop")), F.lit("2026-01-01").cast("timestamp"))
    said = F.concat_ws(" ", *[F.coalesce(F.col("evidence")[n], F.lit("-")) for n in ("merchant", "title", "code", "identity")])
    shown = fields.drop("data", *[c for c in fields.columns if c.endswith("_candidates")])
    return rf.offers_of_pages(shown, "page_id").select(
        "page_id", "external_id", "offer_url", "title", "merchant", "promo_code", "discount_percent", "cashback_percent", "discount_amount", "image_url",
        F.date_format("valid_until", "yyyy-MM-dd HH:mm:ss").alias("valid_until"), said.alias("said"),
    )


_FIELDS = [("name", ["Title", "Наименование"]), ("price", ["Full price", "Цена"]), ("code", ["promo-code"])]
_FIELD_KIND = "field string, aliases array<string>"


def _rec(provider: str, parent: str, ref: str) -> str:
    return f"""'rec_' || substr(sha256('{{"parent_asset_id":"' || {parent} || '","provider":"{provider}","source_ref":"' || {ref} || '"}}'), 1, 24)"""


# JSON-LD by page: names are spelled in full width, with signs, in capitals, or by an alias; numbers come from
# the page. Each object: its place, its text with sorted keys, and the fields that its keys mean.
_SCRIPTS = [
    ('<script type="application/ld+json">{"@type":"Offer","ＮＡＭＥ":"x","Price":{n}}</script>', [("script[1]", '{"@type":"Offer","Price":{n},"ＮＡＭＥ":"x"}', "name,price", "Offer")]),
    ('<script>{"name":"a","price":1}</script><script type="Application/LD+JSON; charset=utf-8">{"items":[{"цена":{n},"TITLE":"t"},{"name":"only"},{"name":"","price":{n}}]}</script>', [("script[1].items[0]", '{"TITLE":"t","цена":{n}}', "name,price", None)]),
    ('<script type="application/ld+json">{broken {n}</script><script type="application/ld+json">[{"promo_code":"P{n}","full-price":[1,2],"наименование":"н","nested":{"name":"i","code":"c","price":null}}]</script>', [("script[2][0]", '{"full-price":[1,2],"nested":{"code":"c","name":"i","price":null},"promo_code":"P{n}","наименование":"н"}', "code,name,price", None), ("script[2][0].nested", '{"code":"c","name":"i","price":null}', "code,name", None)]),
    ("<p>{n}</p>", []),
]
_SPREAD = " UNION ALL ".join(
    f"SELECT page_id, {k} AS ordinal, '{ref}' AS source_ref, {_filled(text)} AS object, '{fields}' AS fields, {'NULL' if kind is None else repr(kind)} AS type FROM pages WHERE page_id % {len(_SCRIPTS)} = {m}"
    for m, (_, found) in enumerate(_SCRIPTS)
    for k, (ref, text, fields, kind) in enumerate(found)
)


@query(f"""SELECT page_id, {_rec('jsonld_records', 'CAST(page_id AS VARCHAR)', 'source_ref')} AS record_id, source_ref, CAST(ordinal AS INTEGER) AS ordinal, CAST(CASE WHEN fields = 'code,name,price' THEN 0.98 ELSE 0.96 END AS DOUBLE) AS confidence, fields, type, object FROM ({_SPREAD})""")
def jsonld_records(spark, d):
    scripts = F.expr(f"CASE page_id % {len(_SCRIPTS)} " + " ".join(f"WHEN {k} THEN concat('<html>', {_filled(t)}, '</html>')" for k, (t, _) in enumerate(_SCRIPTS)) + " END")
    pages = table(spark, d, "pages").select("page_id", scripts.alias("html"))
    found = sr.jsonld_records(jsonld.objects(pages, "page_id"), spark.createDataFrame(_FIELDS, _FIELD_KIND), "page_id")
    return found.select("page_id", "record_id", "source_ref", "ordinal", "confidence", F.array_join("matched_fields", ",").alias("fields"), "type", "object")


@query(f"""SELECT l_orderkey, {_rec('attribute_records', 'CAST(l_orderkey AS VARCHAR)', "'attributes.lines[' || CAST(k AS VARCHAR) || ']'")} AS record_id, CAST(k AS INTEGER) AS ordinal, CAST(l_partkey AS VARCHAR) AS part, CASE WHEN n > 4 THEN 'max_records:4' END AS warning
FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) - 1 AS k, count(*) OVER (PARTITION BY l_orderkey) AS n FROM lineitem) WHERE k < 4""")
def attribute_records(spark, d):
    """The lines of an order as an attribute of mappings, at most four of each."""
    line = F.struct("l_linenumber", "l_partkey", "l_suppkey")
    orders = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.sort_array(F.collect_list(line)).alias("lines"))
    maps = orders.select("l_orderkey", F.transform("lines", lambda x: F.create_map(F.lit("part"), x["l_partkey"].cast("string"))).alias("lines"))
    found = sr.attribute_records(maps, "l_orderkey", "lines", most=4)
    return found.select("l_orderkey", "record_id", "ordinal", F.col("attributes")["part"].alias("part"), "warning")


_NAMES = ["Price", "full PRICE!", "ｐｒｉｃｅ", "title", "НАИМЕНОВАНИЕ", "Promo Code", "ﬁeld", "-", "names"]
_MEANT = {"Price": ("price", "price", 0), "full PRICE!": ("price", "Full price", 1), "ｐｒｉｃｅ": ("price", "price", 0), "title": ("name", "Title", 1), "НАИМЕНОВАНИЕ": ("name", "Наименование", 1), "Promo Code": ("code", "promo-code", 1)}


@query(f"SELECT p_partkey, v.field, v.term, CAST(round(greatest(0, (p_partkey % 90) / 100.0 - 0.02 * v.alias), 6) AS DOUBLE) AS confidence FROM part JOIN (VALUES {', '.join(f'({_NAMES.index(k)}, {f!r}, {t!r}, {a})' for k, (f, t, a) in _MEANT.items())}) v(k, field, term, alias) ON p_partkey % {len(_NAMES)} = v.k")
def matched_signals(spark, d):
    """Names of all spellings, with a confidence from the part's number."""
    name = F.element_at(F.array(*[F.lit(n) for n in _NAMES]), (F.col("p_partkey") % len(_NAMES) + 1).cast("int"))
    signals = table(spark, d, "part").select("p_partkey", name.alias("name"), (F.col("p_partkey") % 90 / 100.0).alias("confidence"))
    found = sr.matched_signals(signals, spark.createDataFrame(_FIELDS, _FIELD_KIND))
    return found.select("p_partkey", "field", "term", F.round("match_confidence", 6).alias("confidence"))


# Pages that list codes: one block on every page, a second one on even pages, and one after the end.
_LISTED = "<h1>Лавка {n}</h1><nav>Войти</nav><b>CODE{n}</b><p>промокод на {n}%</p><p>для всех</p><p>до 31.12.2030</p><a>Активировать промокод</a>"
_SECOND = "<b>X-{n}</b><p>Промокод 500 ₽</p><i>на заказ {id}</i><a>Активировать промокод</a>"
_LAST = "<h2>О сервисе</h2><b>ZZZ1</b><p>Промокод после конца</p>"
_BLOCK_ID = lambda code, text: f"substr(sha256(url || '|' || lower({code}) || '|' || lower({text})), 1, 32)"
_ONE, _TWO = _filled("промокод на {n}% для всех до 31.12.2030"), _filled("Промокод 500 ₽ на заказ {id}")


@query(f"""SELECT page_id, {_filled('CODE{n}')} AS promo_code, {_filled('Лавка {n} — Промокод на {n}%')} AS title, 'для всех' AS conditions, CAST({_filled('{n}')} AS INTEGER) AS discount_percent, CAST(NULL AS DECIMAL(14,2)) AS discount_amount, '2030-12-31' AS until, {_BLOCK_ID(_filled('CODE{n}'), _ONE)} AS external_id FROM pages
UNION ALL SELECT page_id, {_filled('X-{n}')}, {_filled('Лавка {n} — Промокод 500 ₽')}, {_filled('на заказ {id}')}, NULL, 500.00, NULL, {_BLOCK_ID(_filled('X-{n}'), _TWO)} FROM pages WHERE page_id % 2 = 0""")
def code_blocks(spark, d):
    made = F.expr(f"concat('<html><body>', {_filled(_LISTED)}, CASE WHEN page_id % 2 = 0 THEN {_filled(_SECOND)} ELSE '' END, '{_LAST}</body></html>')")
    pages = table(spark, d, "pages").select("page_id", "url", made.alias("html"))
    texts = blocks.page_texts(pages, "page_id").where("error IS NULL").join(pages.select("page_id", "url"), "page_id")
    found = blocks.block_offers(texts, "page_id", F.col("url"), F.lit("2026-01-01").cast("timestamp"))
    return found.select("page_id", "promo_code", "title", "conditions", "discount_percent", "discount_amount", F.date_format("valid_until", "yyyy-MM-dd").alias("until"), "external_id")
