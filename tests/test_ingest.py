"""Ingest and lifecycle on small batches."""

from pyspark.sql import functions as F

from offerloom.operators import ingest as ig
from offerloom.operators import lifecycle as lc

RAW = "row_no long, source_id long, external_id string, title string, merchant string, promo_code string, source_url string, old_price string, new_price string"


def now():
    return F.lit("2026-05-01").cast("timestamp")


def batch(spark, rows):
    df = spark.createDataFrame(rows, RAW)
    for c in ("description", "brand", *ig.AMOUNTS):
        df = df.withColumn(c, F.lit(None).cast("string"))
    return ig.normalize_offers(df)


def store(spark, rows=()):
    if not rows:
        rows = [(0, None, "nowhere", "x", None, None, None, None, None)]
    offers = batch(spark, rows).withColumn("offer_id", F.col("row_no") + 10).withColumn("status", F.lit("new")).withColumn("updated_at", now())
    return offers, offers.select("source_id", "external_id", "offer_id")


def test_numbers_codes_and_missing_texts(spark):
    rows = batch(spark, [(1, 1, "a", None, "  ", " abc ", None, "1 000,00", "750"), (2, 1, "b", " Two  words", "M  N", None, "", "abc", None)]).orderBy("row_no").collect()
    assert (rows[0].title, rows[0].merchant, rows[0].promo_code, float(rows[0].discount_percent), rows[0].offer_type) == ("", None, "ABC", 25.0, "promo")
    assert (rows[1].title, rows[1].merchant, rows[1].old_price, rows[1].canonical_url) == ("Two words", "M N", None, None)


def test_batch_meets_store_and_itself(spark):
    offers, seen = store(spark, [(0, 1, "old", "Kettle", "Home", "TEA", "https://h.example/k", None, None)])
    rows = batch(
        spark,
        [
            (1, 1, "old", "Kettle, new", "Home", None, "https://h.example/other", None, None),  # observed
            (2, 2, "x", "Else", "Home", "tea", None, None, None),  # code and merchant of the store
            (3, 2, "y", "Fresh", "Garden", None, "https://g.example/1", None, None),  # created
            (4, 3, "z", "Fresh too", "Garden", "HOSE", "https://g.example/1/", None, None),  # URL of row 3
            (5, 3, "q", "Third", "Garden", "HOSE", "https://g.example/2", None, None),  # code of row 4, so row 3's offer
            (6, 2, "y", "Fresh again", "Garden", None, "https://g.example/9", None, None),  # source's row of row 3
            (7, None, None, "Nameless", None, None, None, None, None),
        ],
    )
    got = {r.row_no: (r.offer_id, r.outcome, r.reason) for r in ig.assign(rows, offers, seen).collect()}
    fresh = got[3][0]
    assert got[1] == (10, "updated", "source_external_id") and got[2] == (10, "duplicate", "merchant_promo_code")
    assert got[3][1:] == ("created", "new") and got[4] == (fresh, "duplicate", "batch") and got[5] == (fresh, "duplicate", "batch")
    assert got[6] == (fresh, "updated", "source_external_id") and got[7][1] == "created" and len({got[7][0], fresh, 10}) == 3


def test_empty_batch_and_empty_store(spark):
    offers, seen = store(spark)
    none, unseen = offers.limit(0), seen.limit(0)
    rows = batch(spark, [(1, 1, "a", "One", "M", None, None, None, None), (2, 2, "b", "One", "M", None, None, None, None)])
    assert {r.outcome for r in ig.assign(rows, none, unseen).collect()} == {"created", "duplicate"}
    assert ig.assign(rows.limit(0), offers, seen).count() == 0


def test_status_values_and_observations(spark):
    rows = spark.createDataFrame([(1, 1, True, True, True), (2, 1, True, True, False), (3, 2, True, True, True), (4, 3, False, True, True), (5, 4, True, True, False)], "row_no long, offer_id long, benefit boolean, classified boolean, auto_ready boolean")
    offers = spark.createDataFrame([(2, "new"), (3, "new"), (4, "published")], "offer_id long, status string")
    assert {r.offer_id: r.status for r in ig.next_status(rows, offers).collect()} == {1: "needs_review", 2: "ready", 3: "new", 4: "published"}
    values = spark.createDataFrame([(1, 1, "a"), (2, 1, ""), (3, 1, None)], "row_no long, offer_id long, city string")
    assert ig.latest_values(values, ["city"]).first().city == "a"
    old = spark.createDataFrame([(1, "a", 7, "u", "t", None), (2, "b", 8, "u", "t", None)], "source_id long, external_id string, offer_id long, source_url string, raw_title string, observed_at timestamp")
    new = spark.createDataFrame([(1, 1, "a", 7, "v", "T"), (2, 3, None, 9, "w", "W")], "row_no long, source_id long, external_id string, offer_id long, source_url string, title string")
    assert sorted((r.source_id, r.source_url) for r in ig.next_observations(new, old, now()).collect()) == [(1, "v"), (2, "u")]


def test_candidates_and_rejections(spark):
    candidates = spark.createDataFrame([(1, "u1", "vk", "", "Shop", "new", None, None), (2, "u1", "vk", "N", None, "new", None, None), (3, "u3", "other", None, None, "approved", None, None), (4, "u4", "dzen", None, None, "new", None, None)], "candidate_id long, url string, platform string, name string, merchant string, status string, approved_at timestamp, rejected_at timestamp")
    said = spark.createDataFrame([(1, "approved", None), (2, "approved", "own"), (3, "approved", None), (4, "rejected", None)], "candidate_id long, decision string, collector_type string")
    after, new = lc.review_candidates(candidates, said, spark.createDataFrame([("u9",)], "url string"), now())
    assert [(r.url, r.name, r.collector_type) for r in new.collect()] == [("u1", "Shop", "vk_api")]
    assert {r.candidate_id: (r.status, r.approved_at is not None, r.rejected_at is not None) for r in after.collect()} == {1: ("approved", True, False), 2: ("approved", True, False), 3: ("approved", False, False), 4: ("rejected", False, True)}
    offers = spark.createDataFrame([(1, "ready"), (2, "published"), (3, "new")], "offer_id long, status string")
    assert {r.offer_id: r.status for r in lc.reject_offers(offers, spark.createDataFrame([(1,), (2,), (2,)], "offer_id long")).collect()} == {1: "rejected", 2: "published", 3: "new"}
