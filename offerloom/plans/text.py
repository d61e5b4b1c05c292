"""Queries that apply the column functions to whole tables, with the SQL that checks them."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import expressions as ex
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


@query("SELECT doc_id, sha256(trim(regexp_replace(replace(lower(text), 'ё', 'е'), '[^a-zа-я0-9%+.-]+', ' ', 'g'))) AS digest FROM documents")
def normalize_text(spark, d):
    return table(spark, d, "documents").select("doc_id", F.sha2(ex.normalize_text(F.col("text")), 256).alias("digest"))


@query("SELECT p_partkey, regexp_replace(regexp_replace(lower(p_name || ' / ' || p_brand), '[^a-z0-9а-яё]+', '-', 'g'), '^-+|-+$', '', 'g') AS slug FROM part")
def part_slug(spark, d):
    return table(spark, d, "part").select("p_partkey", ex.slug(F.concat_ws(" / ", "p_name", "p_brand")).alias("slug"))


_HOST = "lower(regexp_extract(url, '^[A-Za-z]+://([^/?#:]*)', 1))"
_SCHEME = "lower(regexp_extract(url, '^([A-Za-z]+):', 1))"


@query(f"SELECT page_id, {_SCHEME} AS scheme, {_HOST} AS host, {_SCHEME} || '://' || {_HOST} AS origin FROM pages")
def origin_key(spark, d):
    url = F.col("url")
    key = ex.origin_key(url)
    return table(spark, d, "pages").select("page_id", key["scheme"].alias("scheme"), ex.site_key(url).alias("host"), ex.safe_origin(url).alias("origin"))


@query("""WITH p AS (SELECT page_id, lower(regexp_extract(url, '^([A-Za-z]+://[^/?#]*)', 1)) AS head, regexp_replace(regexp_extract(url, '^[A-Za-z]+://[^/?#]*([^?#]*)', 1), '/{2,}', '/', 'g') AS path, regexp_extract(url, '^[^?#]*\\?([^#]*)', 1) AS q FROM pages),
k AS (SELECT page_id, head, path, array_to_string(list_filter(string_split(q, '&'), lambda x: x <> '' AND split_part(x, '=', 1) NOT IN ('ref', 'from', 'referrer', 'gclid', 'yclid', 'fbclid') AND NOT starts_with(x, 'utm_')), '&') AS q FROM p)
SELECT page_id, head || CASE WHEN path IN ('', '/') THEN '/' ELSE regexp_replace(path, '/+$', '') END || CASE WHEN q <> '' THEN '?' || q ELSE '' END AS canonical FROM k""")
def canonical_url(spark, d):
    return table(spark, d, "pages").select("page_id", ex.canonical_url(F.col("url")).alias("canonical"))


@query("SELECT l_orderkey, l_linenumber, CAST(round(l_discount * 100, 2) AS DECIMAL(8,2)) AS percent FROM lineitem WHERE l_discount > 0 AND l_extendedprice > 0")
def percent_amount(spark, d):
    lines = table(spark, d, "lineitem").where("l_discount > 0 AND l_extendedprice > 0")
    old = F.lit(1000).cast(ex.MONEY)
    new = (1000 - F.col("l_discount") * 1000).cast(ex.MONEY)
    return lines.select("l_orderkey", "l_linenumber", ex.discount_percent(old, new).alias("percent"))


@query("SELECT p_partkey, sha256(concat_ws('|', trim(regexp_replace(lower(p_brand), '[^a-zа-я0-9%+.-]+', ' ', 'g')), trim(regexp_replace(lower(p_name), '[^a-zа-я0-9%+.-]+', ' ', 'g')), '', CASE WHEN p_size = 0 THEN '' ELSE CAST(p_size AS VARCHAR) END, '')) AS fingerprint FROM part")
def fingerprint(spark, d):
    got = ex.fingerprint(F.col("p_brand"), F.col("p_name"), F.lit(None).cast("string"), [F.col("p_size").cast(ex.MONEY), F.lit(None).cast(ex.MONEY)])
    return table(spark, d, "part").select("p_partkey", got.alias("fingerprint"))


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN NULL WHEN o_orderkey % 3 = 1 THEN date_trunc('day', o_orderdate) + INTERVAL 86399 SECOND ELSE NULL END AS valid_until FROM orders")
def valid_until(spark, d):
    date = F.col("o_orderdate").cast("timestamp")
    text = F.when(F.col("o_orderkey") % 3 == 0, "Предложение бессрочно").when(F.col("o_orderkey") % 3 == 1, F.concat(F.lit("Акция действует до "), F.date_format(date, "dd.MM.yyyy"), F.lit(" включительно"))).otherwise(F.lit("Срок действия до 31.02.2026"))
    return table(spark, d, "orders").select("o_orderkey", ex.valid_until(text, F.lit("2026-08-17 12:00:00").cast("timestamp")).cast("timestamp_ntz").alias("valid_until"))


@query("SELECT count(*) AS orders, count(*) FILTER (o_orderdate < TIMESTAMP '1996-06-01') AS expired FROM orders")
def is_expired(spark, d):
    gone = F.col("o_orderdate").cast("timestamp") < F.lit("1996-06-01").cast("timestamp")
    return table(spark, d, "orders").agg(F.count(F.lit(1)).alias("orders"), F.count_if(gone).alias("expired"))


@query(r"""SELECT doc_id, sha256(regexp_replace(regexp_replace(regexp_replace(text, '(?i)\b(token|bot[_-]?token|telegram[_-]?bot[_-]?token|api[_-]?(?:key|hash)|password|passwd|proxy[_-]?password|access[_-]?token|secret|session|authorization|proxy-authorization|vk[_-]?access[_-]?token|cookie|set-cookie|x-api-key|telegram[_-]?(?:channel_id|admin_ids)|admin[_-]?id|channel[_-]?id)[ \t\n\x0b\f\r]*[:=][ \t\n\x0b\f\r]*[''"]?([^''" \t\n\x0b\f\r,;]+)', '\1=***REDACTED***', 'g'),
'(?i)(https?://)([^/@: \t\n\x0b\f\r]+):([^/@ \t\n\x0b\f\r]+)@', '\1***REDACTED***:***REDACTED***@', 'g'), '\d{7,12}:[A-Za-z0-9_-]{34,46}', '***REDACTED_TOKEN***', 'g')) AS digest FROM documents""")
def redact_secrets(spark, d):
    return table(spark, d, "documents").select("doc_id", F.sha2(ex.redact(F.col("text")), 256).alias("digest"))


@query("""SELECT o_orderkey, '<b>' || replace(o_orderpriority, '&', '&amp;') || '</b>' || chr(10) || replace(replace(format('{:,.2f}', o_totalprice), ',', ' '), '.00', '') || ' ₽' || CASE WHEN o_orderstatus = 'F' THEN chr(10) || 'ready' ELSE '' END AS caption FROM orders WHERE round(o_totalprice, 2) = o_totalprice""")
def caption(spark, d):
    orders = table(spark, d, "orders").where("round(o_totalprice, 2) = o_totalprice")
    return orders.select("o_orderkey", ex.caption(F.col("o_orderpriority"), [ex.money(F.col("o_totalprice")), F.when(F.col("o_orderstatus") == "F", "ready")]).alias("caption"))


@query("""SELECT page_id, 'rec_' || substr(sha256('{"parent_asset_id":"' || CAST(page_id AS VARCHAR) || '","provider":"pages","source_ref":"' || url || '"}'), 1, 24) AS record_id FROM pages""")
def record_ids(spark, d):
    return table(spark, d, "pages").select("page_id", ex.record_id(F.col("page_id").cast("string"), F.lit("pages"), F.col("url")).alias("record_id"))


@query(r"""SELECT doc_id, k AS line, regexp_extract(l, '^[ \t]*([^:\n]{1,60}?)[ \t]*:[ \t]*([^ \t].*)$', 1) AS label, trim(regexp_extract(l, '^[ \t]*([^:\n]{1,60}?)[ \t]*:[ \t]*([^ \t].*)$', 2)) AS value
FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS l, generate_subscripts(string_split(text, chr(10)), 1) AS k FROM documents) WHERE regexp_matches(l, '^[ \t]*([^:\n]{1,60}?)[ \t]*:[ \t]*([^ \t].*)$')""")
def text_signals(spark, d):
    lines = table(spark, d, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("p", "l"))
    pattern = r"^[ \t]*([^:\n]{1,60}?)[ \t]*:[ \t]*([^ \t].*)$"
    return lines.where(F.col("l").rlike(pattern)).select("doc_id", (F.col("p") + 1).cast("long").alias("line"), F.regexp_extract("l", pattern, 1).alias("label"), F.trim(F.regexp_extract("l", pattern, 2)).alias("value"))


@query()
def promo_codes(spark, d):
    return table(spark, d, "documents").select("doc_id", ex.promo_code(F.col("text")).alias("promo_code")).where("promo_code IS NOT NULL")


@query()
def conditions_amounts(spark, d):
    return table(spark, d, "documents").select("doc_id", ex.conditions(F.col("text")).alias("c")).select("doc_id", "c.*")


@query("SELECT l_orderkey, l_linenumber, CASE WHEN l_returnflag = 'A' THEN 'promo' WHEN l_returnflag = 'R' THEN 'cashback' WHEN l_linestatus = 'O' THEN 'delivery' ELSE 'discount' END AS offer_type FROM lineitem")
def offer_type(spark, d):
    flag = F.col("l_returnflag")
    got = ex.offer_type(F.lit("title"), F.when(flag == "A", "CODE"), F.when(flag == "R", 1), F.when(F.col("l_linestatus") == "O", 1))
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", got.alias("offer_type"))


_WORDS = ["and", "the", "token", "rights"]


@query("SELECT doc_id, array_to_string(list_filter(['and', 'the', 'token', 'rights'], lambda w: contains(lower(text), w)), ',') AS terms, CAST(CASE WHEN contains(lower(text), 'token') THEN 4 ELSE 0 END + CASE WHEN contains(lower(text), 'rights') THEN 2 ELSE 0 END AS INTEGER) AS score FROM documents")
def offer_signal(spark, d):
    low = F.lower("text")
    terms = ex.matched_terms(low, _WORDS)
    score = F.when(F.array_contains(terms, "token"), 4).otherwise(0) + F.when(F.array_contains(terms, "rights"), 2).otherwise(0)
    return table(spark, d, "documents").select("doc_id", F.array_join(terms, ",").alias("terms"), score.alias("score"))
