"""The domain functions on the golden cases."""

from datetime import datetime
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from offerloom.functions import expressions as ex


def now():
    return F.lit("2026-08-17 12:00:00").cast("timestamp")


def one(spark, column, **values):
    kinds = ", ".join(f"{k} string" for k in values) or "x string"
    return spark.createDataFrame([tuple(values.values()) or ("",)], kinds).select(column.alias("r")).first()["r"]


@pytest.mark.parametrize(
    "text, want",
    [
        ("Купон примут до 09.11.2026 в любом магазине", datetime(2026, 11, 9, 23, 59, 59)),
        ("Распродажа до 3 октября 2026", datetime(2026, 10, 3, 23, 59, 59)),
        ("Успейте до 2 мая", datetime(2027, 5, 2, 23, 59, 59)),
        ("Карта гостя бессрочная", None),
        ("Купон примут до 30.02.2027", None),
        ("", None),
    ],
)
def test_valid_until(spark, text, want):
    assert one(spark, ex.valid_until(F.col("x"), now()).cast("timestamp_ntz"), x=text) == want


def test_conditions(spark):
    got = one(spark, ex.conditions(F.col("x")), x="Дешевле на 15%, но не более 700 ₽. Только при заказе от 2 500 ₽.")
    assert got["max_discount_amount"] == Decimal("700.00") and got["min_order_amount"] == Decimal("2500.00")
    assert got["conditions"] == "Дешевле на 15%, но не более 700 ₽. Только при заказе от 2 500 ₽."
    assert one(spark, ex.conditions(F.col("x")), x="Хорошая погода")["conditions"] is None


@pytest.mark.parametrize(
    "text, want",
    [
        ("Привезём по всей России за неделю", ("all_russia", None, None)),
        ("Ждём гостей в Москве каждый вторник", ("city", "Москва", None)),
        ("Склады есть в Московской области", ("region", None, "Московская область")),
        ("Приходите завтра", ("unknown", None, None)),
    ],
)
def test_geo(spark, text, want):
    assert tuple(one(spark, ex.geo(F.col("x")), x=text)) == want


def test_url(spark):
    assert one(spark, ex.canonical_url(F.col("x")), x="HTTP://Store.TEST//summer//?gclid=1&size=xl&utm_term=q#top") == "http://store.test/summer?size=xl"
    assert tuple(one(spark, ex.origin_key(F.col("x")), x="https://u:p@Shop.example:8443/a")) == ("https", "shop.example", 8443)
    assert tuple(one(spark, ex.origin_key(F.col("x")), x="http://shop.example:80/a")) == ("http", "shop.example", None)


def test_percent(spark):
    d = lambda c: F.col(c).cast(ex.MONEY)
    assert one(spark, ex.discount_percent(d("a"), d("b")), a="1000", b="750") == Decimal("25.00")
    assert one(spark, ex.discount_percent(d("a"), d("b")), a="100", b="100") is None
    assert one(spark, ex.discount_percent(d("a"), d("b")), a="0", b="0") is None


def test_promo_code(spark):
    assert one(spark, ex.promo_code(F.col("x")), x="Промокод: SALE2026 на всё") == "SALE2026"
    assert one(spark, ex.promo_code(F.col("x")), x="Текст\nSPRING_25\nеще") == "SPRING_25"
    assert one(spark, ex.promo_code(F.col("x")), x="https://a.example/CODE12345 просто") is None


def test_redaction_and_captions(spark):
    assert one(spark, ex.redact(F.col("x")), x="token=abc https://u:p@h/") == "token=***REDACTED*** https://***REDACTED***:***REDACTED***@h/"
    assert one(spark, ex.clip(F.col("x"), 12), x="alpha  beta gamma delta") == "alpha beta…"
    assert one(spark, ex.money(F.col("x")), x="12345.50") == "12 345.50 ₽"
    assert one(spark, ex.money(F.col("x")), x="12345") == "12 345 ₽"
    assert one(spark, ex.html_escape(F.col("x")), x="a<b>&\"'") == "a&lt;b&gt;&amp;&quot;&#x27;"


def test_fingerprint_ignores_scale(spark):
    f = lambda kind: ex.fingerprint(F.lit("M"), F.lit("T"), F.lit(None).cast("string"), [F.lit("20.00").cast(kind)])
    assert one(spark, f("decimal(8,2)")) == one(spark, f("decimal(8,4)"))


BASE = "https://shop.example/a/b/c?x=1"


@pytest.mark.parametrize("href", ["d", "./d", "../d/./e", "../../../d", "/d/../e", "//other.example/z", "?q=2", "d?q#f", "https://o.example/a/../b", "", "x//y", "..", "e/.", "HTTP://O.example:80/p"])
def test_resolved_links_agree_with_the_standard_library(spark, href):
    from urllib.parse import urldefrag, urljoin, urlsplit, urlunsplit

    got = one(spark, ex.resolve_link(F.col("b"), F.col("h")), b=BASE, h=href)
    parts = urlsplit(urldefrag(urljoin(BASE, href)).url)
    host = parts.hostname if (parts.scheme, parts.port) in (("http", 80), ("https", 443)) or parts.port is None else f"{parts.hostname}:{parts.port}"
    assert got == (urlunsplit((parts.scheme, host, parts.path or "/", parts.query, "")) if href else None)


@pytest.mark.parametrize("href", ["#top", "mailto:a@b.example", "javascript:void(0)", "https://u:p@h.example/", "https://h.example:99999/", "https://h.example:x/"])
def test_links_that_mean_nothing(spark, href):
    assert one(spark, ex.resolve_link(F.col("b"), F.col("h")), b=BASE, h=href) is None


def test_files_are_no_pages(spark):
    assert one(spark, ex.blocked_suffix(F.col("x")), x="https://h.example/a/B.PDF?x=.html") and not one(spark, ex.blocked_suffix(F.col("x")), x="https://h.example/a?f=b.pdf")
