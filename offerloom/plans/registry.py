"""Queries of structuring and of the source registry."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import registry as rg
from ..operators import structuring as st
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


@query()
def structure_offers(spark, d):
    text = F.col("text")
    offers = table(spark, d, "documents").select(F.col("doc_id").alias("offer_id"), F.substring_index(text, "\n", 1).alias("title"), text.alias("description"), F.lit(None).cast("string").alias("source_url"), F.col("source").alias("merchant"), F.lit(None).cast("string").alias("promo_code"), F.lit(None).cast("string").alias("conditions"), F.create_map().cast("map<string,string>").alias("meta"))
    return st.disposition(st.structure(offers, F.lit("2026-08-17 12:00:00").cast("timestamp"))).select("offer_id", "title", "issues", "confidence", "accepted", "auto_ready", "disposition")


@query()
def detect_signals(spark, d):
    return table(spark, d, "documents").select("doc_id", st.signal(F.col("text")).alias("s")).select("doc_id", "s.is_offer", "s.score", "s.offer_type")


@query("""SELECT n_nationkey AS id, CASE WHEN n_nationkey % 2 = 0 THEN 'legacy-source-' || n_nationkey ELSE n_name END AS key, CASE WHEN n_nationkey % 3 = 0 THEN 'telegram' ELSE 'other' END AS platform, CASE WHEN n_nationkey % 5 = 0 THEN 50 ELSE 7 END AS priority, n_nationkey % 2 = 0 OR n_nationkey % 3 <> 0 OR n_nationkey % 5 = 0 AS repaired FROM nation""")
def registry_repair(spark, d):
    k = F.col("n_nationkey")
    sources = table(spark, d, "nation").select(
        k.alias("id"), F.when(k % 2 == 0, "").otherwise(F.col("n_name")).alias("key"), F.lit("n").alias("name"), F.when(k % 3 == 0, "telegram").otherwise("odd").alias("platform"), F.lit("x").alias("source_type"), F.lit("u").alias("url"), F.lit("c").alias("collector_type"), F.lit("auto").alias("network_policy"),
        F.when(k % 5 != 0, 7).alias("priority"), F.lit("official").alias("trust_level"), F.lit(5).alias("check_interval_minutes"), F.lit(True).alias("enabled"), F.lit("healthy").alias("status"), F.lit(0).alias("failure_count"),
    )
    return rg.repair(sources).select("id", "key", "platform", "priority", "repaired")


@query("SELECT CASE WHEN s_suppkey % 4 = 0 THEN 'inserted' WHEN s_suppkey % 3 = 0 THEN 'retired' ELSE 'kept' END AS outcome, count(*) AS n FROM supplier GROUP BY 1")
def registry_seed(spark, d):
    key = table(spark, d, "supplier").select(F.col("s_suppkey").alias("k"), F.col("s_suppkey").cast("string").alias("key"))
    config = key.where("k % 4 = 0 OR k % 3 <> 0").select("key")
    registry = key.where("k % 4 <> 0").select("key", F.lit("legacy_adapter").alias("collector_type"))
    return rg.seed(config, registry).groupBy("outcome").agg(F.count(F.lit(1)).alias("n"))


_SHELLS = """SELECT page_id AS key, CASE page_id % 5 WHEN 0 THEN '<html><body><div id="root"></div><script>a</script><script>b</script></body></html>' WHEN 1 THEN '<p>You need to enable JavaScript</p>' WHEN 2 THEN ' ' WHEN 3 THEN NULL ELSE html END AS html FROM pages"""


@query(f"""SELECT key, CASE WHEN html IS NULL THEN NULL WHEN contains(lower(html), 'enable javascript') THEN 'javascript_required_message' WHEN contains(html, 'id="root"') THEN 'client_rendered_shell' WHEN trim(html) = '' THEN 'empty_html' END AS reason,
regexp_matches(lower(ltrim(substr(html, 1, 128))), '^(<!doctype html|<html|<head|<body)') AS is_html FROM ({_SHELLS})""")
def render_policy(spark, d):
    """Four of five pages are replaced by a shell, a message, a blank and nothing."""
    k = F.pmod("page_id", F.lit(5))
    shell = F.when(k == 0, '<html><body><div id="root"></div><script>a</script><script>b</script></body></html>').when(k == 1, "<p>You need to enable JavaScript</p>").when(k == 2, " ").when(k == 4, F.col("html"))
    pages = table(spark, d, "pages").select(F.col("page_id").alias("key"), shell.alias("html"))
    joined = pages.join(html.summaries(pages, "key").select("key", "visible", "scripts"), "key", "left")
    return joined.select("key", rg.render_reason(F.col("html"), F.col("visible"), F.col("scripts")).alias("reason"), rg.is_html(F.lit(None).cast("string"), F.col("html")).alias("is_html"))


@query("""SELECT c_custkey, CASE WHEN c_custkey % 4 = 0 THEN 'shop_' || c_custkey WHEN c_custkey % 4 = 1 THEN 'shop_' || c_custkey WHEN c_custkey % 4 = 2 THEN NULL ELSE NULL END AS channel FROM customer""")
def channel_names(spark, d):
    k = F.col("c_custkey")
    name = F.concat(F.lit("shop_"), k)
    text = F.when(k % 4 == 0, F.concat(F.lit("@"), name)).when(k % 4 == 1, F.concat(F.lit("https://t.me/s/"), name)).when(k % 4 == 2, F.concat(F.lit("https://t.me/"), name, F.lit("/15"))).otherwise("https://vk.com/abcdef")
    return table(spark, d, "customer").select("c_custkey", rg.channel_name(text).alias("channel"))
