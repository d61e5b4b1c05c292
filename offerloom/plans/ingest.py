"""Queries of ingest and lifecycle over the driver's tables, with the SQL that checks them.

Parts stand for raw offers: two neighbours share a URL, and every fourth part is in the store.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import ingest as ig
from ..operators import lifecycle as lc
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


def _raw(spark, d):
    k, none = F.col("k"), F.lit(None).cast("string")
    part = table(spark, d, "part").select(F.col("p_partkey").alias("k"), "p_name", "p_brand", "p_size", F.round(F.col("p_retailprice") * 100).cast("long").alias("cents"))
    return part.select(
        k.alias("row_no"), (k % 3).alias("source_id"), F.concat(F.lit("e"), k).alias("external_id"), F.concat(F.lit("  "), "p_name", F.lit("   "), k).alias("title"), none.alias("description"),
        F.concat(F.lit("https://Shop.Example//p/"), k - k % 2, F.lit("/?utm_source=a")).alias("source_url"), none.alias("merchant"), F.concat(F.col("p_brand"), F.lit(" ")).alias("brand"), F.when(k % 10 == 0, F.concat(F.lit(" code"), k)).alias("promo_code"),
        F.concat(F.lit("1 "), F.lpad((F.col("cents") % 1000).cast("string"), 3, "0"), F.lit(",50")).alias("old_price"), F.when(k % 5 == 0, F.lit("500")).alias("new_price"), F.when(k % 15 == 0, F.lit("0")).alias("discount_percent"),
        none.alias("discount_amount"), F.when(k % 7 == 0, F.lit("x")).alias("cashback_percent"), none.alias("cashback_amount"), none.alias("delivery_price"),
    )


def _store(spark, d):
    """Every fourth part as a stored offer, and every eighth as observed."""
    rows = ig.normalize_offers(_raw(spark, d)).where("row_no % 4 = 0").withColumn("offer_id", F.col("row_no") + 1)
    status = F.when(F.col("row_no") % 12 == 0, "published").otherwise("new")
    offers = rows.withColumn("status", status).withColumn("updated_at", F.lit("2026-01-01").cast("timestamp"))
    return offers, rows.where("row_no % 8 = 0").select("source_id", "external_id", "offer_id")


_CENTS = "CAST(round(p_retailprice * 100) AS BIGINT)"
_OLD = f"(1000.5 + {_CENTS} % 1000)"


@query(f"""SELECT p_partkey AS row_no, trim(regexp_replace(p_name, '\\s+', ' ', 'g')) || ' ' || p_partkey AS title, trim(p_brand) AS brand, CASE WHEN p_partkey % 10 = 0 THEN 'CODE' || p_partkey END AS promo_code,
CAST({_OLD} AS DOUBLE) AS old_price, p_partkey % 5 = 0 AS cheaper, 'https://shop.example/p/' || (p_partkey - p_partkey % 2) AS canonical_url, CASE WHEN p_partkey % 10 = 0 THEN 'promo' ELSE 'discount' END AS offer_type FROM part""")
def normalize_offers(spark, d):
    n = ig.normalize_offers(_raw(spark, d))
    return n.select("row_no", "title", "brand", "promo_code", F.col("old_price").cast("double").alias("old_price"), F.col("discount_percent").isNotNull().alias("cheaper"), "canonical_url", "offer_type")


_ASSIGNED = """SELECT p_partkey AS row_no, p_partkey - p_partkey % 2 AS e, CASE WHEN p_partkey % 8 = 0 THEN 'updated' WHEN p_partkey % 4 = 2 THEN 'created' ELSE 'duplicate' END AS outcome,
CASE WHEN (p_partkey - p_partkey % 2) % 4 = 0 THEN p_partkey - p_partkey % 2 + 1 ELSE (SELECT max(p_partkey) + 2 FROM part WHERE p_partkey % 4 = 0) + p_partkey - p_partkey % 2 - (SELECT min(p_partkey) FROM part) END AS offer_id FROM part"""


@query(f"SELECT row_no, CAST(offer_id AS BIGINT) AS offer_id, outcome, CASE WHEN outcome = 'updated' THEN 'source_external_id' WHEN outcome = 'created' THEN 'new' WHEN e % 4 = 0 THEN 'canonical_url' ELSE 'batch' END AS reason FROM ({_ASSIGNED})")
def persist_offers(spark, d):
    return ig.assign(ig.normalize_offers(_raw(spark, d)), *_store(spark, d)).select("row_no", "offer_id", "outcome", "reason")


@query(f"""WITH a AS (SELECT *, CASE WHEN row_no % 7 = 0 THEN 'needs_review' WHEN row_no % 5 = 0 AND row_no % 3 = 0 THEN 'ready' END AS says FROM ({_ASSIGNED}))
SELECT CAST(offer_id AS BIGINT) AS offer_id, CASE WHEN any_value(e) % 12 = 0 THEN 'published' ELSE coalesce(arg_max(says, row_no) FILTER (says IS NOT NULL), CASE WHEN any_value(e) % 4 = 0 THEN 'new' ELSE 'needs_review' END) END AS status FROM a GROUP BY 1""")
def ingest_status(spark, d):
    offers, observed = _store(spark, d)
    rows = ig.normalize_offers(_raw(spark, d)).withColumn("benefit", ig.has_benefit())
    got = rows.join(ig.assign(rows, offers, observed).select("row_no", "offer_id"), "row_no")
    k = F.col("row_no")
    return ig.next_status(got.select("row_no", "offer_id", "benefit", (k % 3 == 0).alias("classified"), (k % 7 != 0).alias("auto_ready")), offers)


@query("""SELECT CASE c_custkey % 5 WHEN 0 THEN 'saved' WHEN 1 THEN CASE WHEN c_custkey % 3 = 0 THEN 'category_missing' ELSE 'approved' END WHEN 2 THEN 'rejected' WHEN 3 THEN 'unsupported_action' ELSE 'unsupported_scope' END AS outcome, count(*) AS n,
CAST(sum(CASE c_custkey % 5 WHEN 0 THEN 7 WHEN 1 THEN CASE WHEN c_custkey % 3 = 0 THEN 0 ELSE 8 END WHEN 2 THEN 8 ELSE 0 END) AS BIGINT) AS fields FROM customer GROUP BY 1""")
def review_actions(spark, d):
    k, at = F.col("c_custkey"), F.pmod("c_custkey", F.lit(5))
    offers = table(spark, d, "customer").select(k.alias("offer_id"), F.col("c_name").alias("title"))
    forms = table(spark, d, "customer").select(
        k.alias("offer_id"), F.when(at.isin(0, 4), "save").when(at == 1, "approve").when(at == 2, "reject").otherwise("burn").alias("action"), F.lit(" ").alias("display_title"), F.when(at == 4, "moon").otherwise("city").alias("geo_scope"),
        F.when(k % 3 == 0, " ").otherwise("food").alias("category"), *[F.lit("").alias(c) for c in ("subcategory", "region", "city", "conditions")],
    )
    overrides, outcomes = lc.review_overrides(forms, offers)
    per = overrides.groupBy("offer_id").agg(F.count(F.lit(1)).alias("f"))
    return outcomes.join(per, "offer_id", "left").groupBy("outcome").agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("f"), F.lit(0)).alias("fields"))


@query("""SELECT CASE o_orderkey % 3 WHEN 0 THEN 'published' WHEN 1 THEN 'failed' ELSE 'pending' END AS ledger, CASE WHEN o_orderkey % 3 = 0 THEN 'published' ELSE 'ready' END AS offer, count(*) AS n FROM orders GROUP BY 1, 2""")
def settled_publications(spark, d):
    k, none = F.col("o_orderkey"), F.lit(None).cast("string")
    orders = table(spark, d, "orders")
    offers = orders.select(k.alias("offer_id"), F.lit("ready").alias("status"))
    ledger = orders.select(k.alias("offer_id"), F.lit("c").alias("channel_id"), F.lit("pending").alias("status"), none.alias("message_id"), F.lit(None).cast("timestamp").alias("published_at"), none.alias("error"))
    results = orders.where("o_orderkey % 3 < 2").select(k.alias("offer_id"), F.lit("c").alias("channel_id"), k.cast("string").alias("message_id"), F.when(k % 3 == 1, "refused").alias("error"))
    after, shown = lc.settle_publications(ledger, offers, results, F.lit("2026-01-01").cast("timestamp"))
    both = after.select("offer_id", F.col("status").alias("ledger")).join(shown.select("offer_id", F.col("status").alias("offer")), "offer_id")
    return both.groupBy("ledger", "offer").agg(F.count(F.lit(1)).alias("n"))
