"""Structuring and the source registry."""

from pyspark.sql import functions as F

from offerloom.operators import registry, structuring

OFFER = "offer_id int, title string, description string, source_url string, merchant string, promo_code string, conditions string, meta map<string,string>"


def structured(spark, *rows):
    now = F.lit("2026-08-17 12:00:00").cast("timestamp")
    return {r.offer_id: r for r in structuring.disposition(structuring.structure(spark.createDataFrame(list(rows), OFFER), now)).collect()}


def test_structuring(spark):
    got = structured(
        spark,
        (1, "Скидка 20% на обувь", "Промокод: SHOE2026\nСрок действия до 31.12.2026", "https://shop.example/a", None, None, None, {}),
        (2, None, "Промокод: AAA11 и промокод: BBB22", None, None, None, None, {}),
        (3, "Кэшбэк 5% по карте", "Кэшбэк 5% при оплате", "https://t.me/x", None, None, None, {"structured_fields": "1", "merchant": "Shop"}),
        (4, "Цены: 1000 ₽, 900 ₽, 800 ₽", "", None, None, None, None, {}),
        (5, None, None, None, None, None, None, None),
        (6, "Было 2 000 ₽ стало 1 500 ₽ на куртки", "", None, "M", "активировать", None, {}),
    )
    assert (got[1].promo_code, float(got[1].discount_percent), got[1].confidence, got[1].disposition) == ("SHOE2026", 20.0, 0.73, "processed")
    assert got[2].issues == ["multiple_promo_codes"] and got[2].disposition == "needs_review"
    assert got[3].merchant == "Shop" and float(got[3].cashback_percent) == 5.0 and got[3].discount_percent is None and got[3].auto_ready
    assert got[4].issues == ["multiple_prices"] and not got[4].auto_ready
    assert got[5].title == "Предложение требует проверки" and got[5].disposition == "ignored"
    assert (float(got[6].old_price), float(got[6].new_price)) == (2000.0, 1500.0) and "invalid_structured_promo" in got[6].issues


def test_signal(spark):
    rows = [("Скидка 50% промокод: SALE50",), ("Обзор телефона",), ("Скидка 100%",), (None,)]
    got = [r.s for r in spark.createDataFrame(rows, "x string").select(structuring.signal(F.col("x")).alias("s")).collect()]
    assert got[0].is_offer and got[0].promo_code == "SALE50" and got[0].offer_type == "promo"
    assert not got[1].is_offer and got[1].score == 0
    assert got[2].discount_percent is None  # two digits at most are read, so 100 % is none
    assert not got[3].is_offer


def test_slugs_keywords_and_candidates(spark):
    new = spark.createDataFrame([("Big Shop",), ("Big  Shop",), ("Other",)], "name string")
    keys = {r.key for r in registry.unique_slugs(new, spark.createDataFrame([("other",)], "key string"), "name").collect()}
    assert keys == {"big-shop", "big-shop-2", "other-2"}
    known = spark.createDataFrame([("sale", "positive", None), ("sale", "positive", "M")], "normalized_keyword string, kind string, merchant string")
    asked = spark.createDataFrame([(" SALE ", "positive", None), ("sale", "positive", "N"), ("sale", "negative", None)], "keyword string, kind string, merchant string")
    assert {(r.kind, r.merchant) for r in registry.new_keywords(asked, known).collect()} == {("positive", "N"), ("negative", None)}
    stored = spark.createDataFrame([("website", "u", "Old", "M", 0.4, "approved", 1, 1)], "platform string, url string, name string, merchant string, confidence double, status string, first_seen_at int, last_seen_at int")
    found = spark.createDataFrame([("website", "u", "", "N", 1.7, 5), ("website", "v", "V", None, 0.2, 6)], "platform string, url string, name string, merchant string, confidence double, seen_at int")
    got = {r.url: tuple(r) for r in registry.merge_candidates(stored, found).collect()}
    assert got["u"] == ("website", "u", "Old", "N", 1.0, "approved", 1, 5) and got["v"] == ("website", "v", "V", None, 0.2, "new", 6, 6)


def test_acquisition(spark):
    rows = [(1, True, None, True, "auto"), (2, True, "client_rendered_shell", True, "auto"), (3, True, "client_rendered_shell", False, "auto"), (4, False, None, False, "never")]
    got = {r.k: r for r in registry.acquire(spark.createDataFrame(rows, "k int, static_ok boolean, reason string, rendered_ok boolean, mode string")).collect()}
    assert [got[k].chosen for k in (1, 2, 3, 4)] == ["static", "rendered", "static", None]
    assert got[3].warnings == ["render_failed", "client_rendered_shell"] and len(got[2].attempts) == 2


def test_feeds(spark):
    feed = spark.createDataFrame([(1, '[{"id": 5, "date": 0, "text": "t"}]'), (2, "broken")], "source_id int, payload string")
    got = registry.feed_items(feed).collect()
    assert [(r.external_id, r.text) for r in got] == [("5", "t")]
