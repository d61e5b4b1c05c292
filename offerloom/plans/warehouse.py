"""Warehouse queries on the driver's tables, each with the SQL that checks it.

The tables hold no offers, so every query maps them: orders stand for offers (status F is
ready), lineitem rows for observations or publications, events for runs and signals, parts for
titles, documents for item texts, pages for collected URLs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import scoring as sc
from ..operators import warehouse as wh
from ..sources.tables import instant, table

AS_OF = "1997-01-01 00:00:00"
QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def _as_of():
    return F.lit(AS_OF).cast("timestamp")


def _offers(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "orders").where("o_orderstatus = 'F'").select("o_orderkey", "o_totalprice", instant("o_orderdate").alias("valid_until"))


def _publications(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "lineitem").where("l_returnflag IN ('A', 'R')").select(F.col("l_orderkey").alias("o_orderkey"), F.lit("published").alias("status"))


_CANDIDATES = """SELECT o_orderkey, o_totalprice FROM orders o WHERE o_orderstatus = 'F'
AND NOT EXISTS (SELECT 1 FROM lineitem l WHERE l.l_orderkey = o.o_orderkey AND l_returnflag IN ('A', 'R'))
ORDER BY o_totalprice DESC NULLS LAST, o_orderkey LIMIT 20"""


@query(_CANDIDATES)
def publish_candidates(spark, d):
    order = [F.col("o_totalprice").desc_nulls_last(), F.col("o_orderkey")]
    return wh.publish_candidates(_offers(spark, d), _publications(spark, d), "o_orderkey", order, 20).select("o_orderkey", "o_totalprice")


@query(f"SELECT * FROM (SELECT o_orderkey, o_totalprice FROM ({_CANDIDATES}) JOIN (SELECT o_orderkey AS k, o_orderdate FROM orders) ON k = o_orderkey WHERE o_orderdate >= TIMESTAMP '{AS_OF}')")
def publish_expiry_after_limit(spark, d):
    order = [F.col("o_totalprice").desc_nulls_last(), F.col("o_orderkey")]
    return wh.publish_candidates(_offers(spark, d), _publications(spark, d), "o_orderkey", order, 20, _as_of()).select("o_orderkey", "o_totalprice")


@query("SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE n_nationkey = 7)")
def publish_by_source(spark, d):
    source = table(spark, d, "customer").join(table(spark, d, "nation").where("n_nationkey = 7"), F.col("c_nationkey") == F.col("n_nationkey"), "left_semi")
    return table(spark, d, "orders").join(source, F.col("o_custkey") == F.col("c_custkey"), "left_semi").select("o_orderkey", "o_custkey")


@query("SELECT count(*) AS total, count(*) FILTER (o_orderstatus = 'F') AS ready, count(*) FILTER (o_orderstatus = 'O') AS fresh, count(*) FILTER (o_orderstatus = 'P') AS review FROM orders")
def status_metrics(spark, d):
    return wh.status_metrics(table(spark, d, "orders"), "o_orderstatus", {"ready": "F", "fresh": "O", "review": "P"})


@query("SELECT (SELECT count(*) FROM customer) AS customers, (SELECT count(*) FROM orders) AS orders, (SELECT count(*) FROM lineitem) AS lines, (SELECT o_orderkey FROM orders ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 1) AS latest_order")
def smoke_report(spark, d):
    one = table(spark, d, "orders").agg(F.count(F.lit(1)).alias("orders"), F.max_by("o_orderkey", F.struct("o_orderdate", "o_orderkey")).alias("latest_order"))
    counts = [table(spark, d, t).agg(F.count(F.lit(1)).alias(n)) for t, n in (("customer", "customers"), ("lineitem", "lines"))]
    both = counts[0].withColumn("k", F.lit(1)).join(counts[1].withColumn("k", F.lit(1)), "k").join(one.withColumn("k", F.lit(1)), "k")
    return both.select("customers", "orders", "lines", "latest_order")


@query("SELECT count(DISTINCT o_orderkey) AS review_count FROM orders JOIN lineitem ON l_orderkey = o_orderkey WHERE o_orderstatus = 'P' AND l_shipdate >= TIMESTAMP '1996-01-01'")
def review_count(spark, d):
    seen = table(spark, d, "lineitem").where(instant("l_shipdate") >= F.lit("1996-01-01").cast("timestamp"))
    return table(spark, d, "orders").where("o_orderstatus = 'P'").join(seen, F.col("o_orderkey") == F.col("l_orderkey"), "left_semi").agg(F.count_distinct("o_orderkey").alias("review_count"))


@query("""SELECT user_id, arg_max(event_id, (ts, event_id)) AS last_run, max(ts) AS last_started,
max(ts) FILTER (event_type <> 'error') AS last_success, arg_max(event_type = 'error', (ts, event_id)) AS last_failed FROM events GROUP BY user_id""")
def latest_run_status(spark, d):
    return wh.latest_state(table(spark, d, "events"), "user_id", "ts", "event_id", F.col("event_type") == "error")


@query("SELECT DISTINCT p_type AS value FROM part WHERE p_type <> '' ORDER BY 1 LIMIT 200")
def facet_values(spark, d):
    return wh.facet(table(spark, d, "part"), "p_type", 200)


@query("SELECT value FROM (SELECT DISTINCT p_brand AS value FROM part WHERE p_size < 10 AND p_brand <> '' ORDER BY 1 LIMIT 8) WHERE octet_length(encode(value)) <= 64")
def facet_sub(spark, d):
    return wh.facet(table(spark, d, "part").where("p_size < 10"), "p_brand", 8, 64)


@query("SELECT p_partkey, p_name FROM part WHERE (p_name ILIKE '%an%' OR p_brand ILIKE '%an%' OR p_type ILIKE '%an%') AND p_size = 7 ORDER BY p_retailprice DESC, p_partkey LIMIT 40 OFFSET 5")
def offers_search_page(spark, d):
    found = wh.search(table(spark, d, "part"), "an", ["p_name", "p_brand", "p_type"], {"p_size": 7, "p_brand": None})
    return found.orderBy(F.desc("p_retailprice"), "p_partkey").offset(5).limit(40).select("p_partkey", "p_name")


@query("SELECT o_orderkey, c_name FROM orders LEFT JOIN customer ON c_custkey = o_custkey WHERE o_orderstatus = 'P' ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 150")
def runs_log(spark, d):
    runs = table(spark, d, "orders").where("o_orderstatus = 'P'")
    return runs.join(table(spark, d, "customer"), F.col("c_custkey") == F.col("o_custkey"), "left").orderBy(F.desc("o_orderdate"), F.desc("o_orderkey")).limit(150).select("o_orderkey", "c_name")


@query("SELECT l_orderkey, l_linenumber, s_name FROM lineitem JOIN supplier ON s_suppkey = l_suppkey WHERE l_orderkey = 7")
def offer_detail(spark, d):
    return table(spark, d, "lineitem").where("l_orderkey = 7").join(table(spark, d, "supplier"), F.col("s_suppkey") == F.col("l_suppkey")).select("l_orderkey", "l_linenumber", "s_name")


@query("""WITH m AS (SELECT l_suppkey, max(l_shipdate) AS latest FROM lineitem WHERE l_linestatus = 'F' GROUP BY 1)
SELECT l_orderkey, count(*) AS observations FROM lineitem LEFT JOIN m USING (l_suppkey) GROUP BY 1 HAVING bool_and(coalesce(latest > l_shipdate, false))""")
def stale_for_review(spark, d):
    lines = table(spark, d, "lineitem").select("l_orderkey", "l_suppkey", "l_shipdate", "l_linestatus")
    return wh.stale(lines, lines.where("l_linestatus = 'F'").withColumnRenamed("l_shipdate", "done"), "l_orderkey", "l_suppkey", "l_shipdate", "done")


@query("SELECT l_orderkey, l_linenumber, l_suppkey FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_orderkey ORDER BY l_shipdate DESC, l_linenumber, l_suppkey, l_partkey) = 1")
def newest_observation(spark, d):
    lines = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_suppkey", "l_partkey", "l_shipdate")
    return wh.first_by(lines, ["l_orderkey"], [F.desc("l_shipdate"), F.col("l_linenumber"), F.col("l_suppkey"), F.col("l_partkey")]).select("l_orderkey", "l_linenumber", "l_suppkey")


@query("SELECT DISTINCT p_partkey, p_name FROM part WHERE p_size = 1 OR p_brand LIKE '%1' OR p_retailprice > 1500")
def keyword_union(spark, d):
    part = table(spark, d, "part")
    parts = [part.where(c).select("p_partkey", "p_name") for c in ("p_size = 1", "p_brand LIKE '%1'", "p_retailprice > 1500")]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).dropDuplicates(["p_partkey"])


@query("""WITH a AS (SELECT o_orderkey, o_orderstatus, o_custkey FROM orders WHERE o_orderkey % 10 <> 1), b AS (SELECT o_orderkey, CASE WHEN o_orderkey % 7 = 0 THEN 'X' ELSE o_orderstatus END AS o_orderstatus, o_custkey FROM orders WHERE o_orderkey % 10 <> 2)
SELECT *, missing = 0 AND extra = 0 AND mismatch_o_orderstatus = 0 AND mismatch_o_custkey = 0 AND repeated = 0 AS safe FROM (
SELECT count(*) FILTER (b.o_orderkey IS NULL) AS missing, count(*) FILTER (a.o_orderkey IS NULL) AS extra,
count(*) FILTER (a.o_orderkey IS NOT NULL AND b.o_orderkey IS NOT NULL AND a.o_orderstatus IS DISTINCT FROM b.o_orderstatus) AS mismatch_o_orderstatus,
count(*) FILTER (a.o_orderkey IS NOT NULL AND b.o_orderkey IS NOT NULL AND a.o_custkey IS DISTINCT FROM b.o_custkey) AS mismatch_o_custkey, CAST(0 AS BIGINT) AS repeated
FROM a FULL JOIN b ON a.o_orderkey = b.o_orderkey)""")
def parity_compare(spark, d):
    orders = table(spark, d, "orders").select("o_orderkey", "o_orderstatus", "o_custkey")
    right = orders.where("o_orderkey % 10 <> 2").withColumn("o_orderstatus", F.when(F.col("o_orderkey") % 7 == 0, "X").otherwise(F.col("o_orderstatus")))
    return wh.compare_sets(orders.where("o_orderkey % 10 <> 1"), right, "o_orderkey", ["o_orderstatus", "o_custkey"])


@query("""WITH s AS (SELECT doc_id, sha256(text) AS h FROM documents), k AS (SELECT h, min(doc_id) AS m FROM s WHERE doc_id % 2 = 0 GROUP BY h)
SELECT doc_id, CASE WHEN doc_id % 6 = 0 THEN doc_id ELSE m END AS matched_id, CASE WHEN doc_id % 6 = 0 THEN 'key' WHEN m IS NOT NULL THEN 'content' ELSE 'new' END AS match
FROM s LEFT JOIN k USING (h) WHERE doc_id % 3 = 0""")
def item_upsert_match(spark, d):
    items = table(spark, d, "documents").select("doc_id", F.sha2("text", 256).alias("content_hash"))
    known = items.where("doc_id % 2 = 0").withColumn("item_id", F.col("doc_id")).withColumnRenamed("doc_id", "external")
    got = wh.match_items(items.where("doc_id % 3 = 0").withColumnRenamed("doc_id", "external"), known, "external", "content_hash")
    return got.select(F.col("external").alias("doc_id"), "matched_id", "match")


@query("SELECT n_nationkey, coalesce(nullif(CASE WHEN n_regionkey = 2 THEN '' ELSE r_name END, ''), n_name) AS label FROM nation LEFT JOIN region ON r_regionkey = n_regionkey AND r_regionkey <> 3")
def config_overlay(spark, d):
    base = table(spark, d, "nation").select("n_nationkey", F.col("n_regionkey").alias("r_regionkey"), F.col("n_name").alias("r_name"))
    state = table(spark, d, "region").where("r_regionkey <> 3").withColumn("r_name", F.when(F.col("r_regionkey") == 2, "").otherwise(F.col("r_name")))
    return wh.overlay(base, state, "r_regionkey", ["r_name"]).select("n_nationkey", F.col("r_name").alias("label"))


@query("SELECT s_suppkey FROM supplier WHERE s_nationkey NOT IN (SELECT n_nationkey FROM nation WHERE n_regionkey = 0)")
def retire_orphans(spark, d):
    return table(spark, d, "supplier").join(table(spark, d, "nation").where("n_regionkey = 0"), F.col("s_nationkey") == F.col("n_nationkey"), "left_anti").select("s_suppkey")


@query("SELECT min(doc_id) AS doc_id, count(*) AS copies FROM documents GROUP BY sha256(text)")
def first_occurrence(spark, d):
    return table(spark, d, "documents").groupBy(F.sha2("text", 256).alias("h")).agg(F.min("doc_id").alias("doc_id"), F.count(F.lit(1)).alias("copies")).drop("h")


@query("SELECT user_id FROM events GROUP BY user_id HAVING max(ts) + INTERVAL 120 MINUTE <= TIMESTAMP '2024-01-29 12:00:00'")
def due_sources(spark, d):
    last = table(spark, d, "events").groupBy("user_id").agg(F.max("ts").cast("timestamp").alias("last"))
    return last.where(F.col("last") + F.expr("INTERVAL 120 MINUTES") <= F.lit("2024-01-29 12:00:00").cast("timestamp")).select("user_id")


@query("SELECT user_id, CASE WHEN bool_or(event_type = 'error' AND value > 60) THEN 'error' WHEN bool_or(event_type = 'error') THEN 'warning' ELSE 'ok' END AS state, count(*) FILTER (event_type = 'error') AS errors FROM events GROUP BY 1")
def operational_state(spark, d):
    bad = F.col("event_type") == "error"
    return table(spark, d, "events").groupBy("user_id").agg(F.when(F.bool_or(bad & (F.col("value") > 60)), "error").when(F.bool_or(bad), "warning").otherwise("ok").alias("state"), F.count_if(bad).alias("errors"))


@query(f"SELECT CASE WHEN o_orderstatus IN ('O', 'P') AND o_orderdate < TIMESTAMP '{AS_OF}' THEN 'expired' ELSE o_orderstatus END AS status, count(*) AS n FROM orders GROUP BY 1")
def expire_offers(spark, d):
    offers = table(spark, d, "orders").select(F.col("o_orderstatus").alias("status"), instant("o_orderdate").alias("valid_until"))
    return wh.expire(offers, _as_of(), active=("O", "P")).groupBy("status").agg(F.count(F.lit(1)).alias("n"))


@query(f"SELECT (SELECT count(*) FROM orders WHERE o_orderstatus = 'O' AND o_orderdate < TIMESTAMP '{AS_OF}') AS expired, (SELECT count(*) FROM orders WHERE o_orderstatus = 'O' AND o_orderdate >= TIMESTAMP '{AS_OF}' AND o_orderdate < TIMESTAMP '{AS_OF}' + INTERVAL 90 DAY) AS stale")
def maintenance_counts(spark, d):
    date = instant("o_orderdate")
    return table(spark, d, "orders").where("o_orderstatus = 'O'").agg(F.count_if(date < _as_of()).alias("expired"), F.count_if((date >= _as_of()) & (date < _as_of() + F.expr("INTERVAL 90 DAYS"))).alias("stale"))


_SIGNALS = "SELECT user_id AS asset, event_type AS field, event_id AS candidate_id, round(value) AS value, least(0.99, value / 100) AS confidence FROM events"
_FIELDS = ("click", "error", "purchase", "signup", "view")


@query(f"""WITH c AS ({_SIGNALS}), f AS (SELECT unnest({list(_FIELDS)}) AS field),
r AS (SELECT *, lead(confidence) OVER w AS second, row_number() OVER w AS rk FROM c WINDOW w AS (PARTITION BY asset, field ORDER BY confidence DESC, candidate_id))
SELECT a.asset, f.field, candidate_id AS value, confidence, CASE WHEN confidence IS NULL THEN 'unresolved' WHEN confidence < 0.3 THEN 'needs_confirmation' WHEN confidence - second < 0.02 THEN 'needs_confirmation' ELSE 'auto_selected' END AS status
FROM (SELECT DISTINCT asset FROM c) a CROSS JOIN f LEFT JOIN (SELECT * FROM r WHERE rk = 1) r ON r.asset = a.asset AND r.field = f.field""")
def resolve_fields(spark, d):
    candidates = table(spark, d, "events").select(F.col("user_id").alias("asset"), F.col("event_type").alias("field"), F.col("event_id").alias("value"), F.least(F.lit(0.99), F.col("value") / 100).alias("confidence"), F.lit("events").alias("provider"), F.col("event_id").alias("candidate_id"))
    fields = spark.createDataFrame([(f, 0.3, 0.02) for f in _FIELDS], "field string, min_confidence double, min_margin double")
    return sc.resolve_fields(candidates, fields)


@query("""SELECT user_id AS asset, CAST(round(value / 10) AS BIGINT) AS value, least(0.99, max(least(0.9, value / 100)) + least(0.09, 0.03 * (count(DISTINCT event_type) - 1))) AS confidence, count(DISTINCT event_type) AS kinds FROM events GROUP BY 1, 2""")
def discovery_corroboration(spark, d):
    signals = table(spark, d, "events").select(F.col("user_id").alias("asset"), F.lit("f").alias("field"), F.round(F.col("value") / 10).cast("long").alias("value"), F.col("event_type").alias("kind"), F.least(F.lit(0.9), F.col("value") / 100).alias("confidence"))
    return sc.corroborate(signals).drop("field")


_STATUS = "CASE event_type WHEN 'error' THEN 'rejected' WHEN 'signup' THEN 'unresolved' WHEN 'view' THEN 'needs_confirmation' ELSE 'auto_selected' END"


@query(f"SELECT user_id, CASE WHEN bool_or(s = 'rejected') THEN 'rejected' WHEN bool_or(s = 'unresolved') THEN 'incomplete' WHEN bool_or(s = 'needs_confirmation') THEN 'needs_confirmation' ELSE 'ready' END AS record_status FROM (SELECT user_id, {_STATUS} AS s FROM events) GROUP BY 1")
def record_status(spark, d):
    rows = table(spark, d, "events").select("user_id", F.expr(_STATUS).alias("status"))
    return sc.record_status(rows, "user_id")


_JOB = "CASE event_type WHEN 'error' THEN 'failed' WHEN 'signup' THEN 'needs_review' ELSE 'succeeded' END"


@query(f"SELECT user_id, CASE WHEN bool_or(s = 'failed') THEN 'completed_with_failures' WHEN bool_or(s = 'needs_review') THEN 'needs_attention' ELSE 'succeeded' END AS job_status FROM (SELECT user_id, {_JOB} AS s FROM events) GROUP BY 1")
def job_status(spark, d):
    rows = table(spark, d, "events").select("user_id", F.expr(_JOB).alias("status"))
    return sc.job_status(rows, "user_id")


# A user with many events mostly has the worst status; by user and day all of them occur.
_DAILY = "SELECT user_id, CAST(ts AS DATE) AS day, {0} AS s FROM events"


@query(f"SELECT user_id, day, CASE WHEN bool_or(s = 'rejected') THEN 'rejected' WHEN bool_or(s = 'unresolved') THEN 'incomplete' WHEN bool_or(s = 'needs_confirmation') THEN 'needs_confirmation' ELSE 'ready' END AS record_status FROM ({_DAILY.format(_STATUS)}) GROUP BY 1, 2")
def record_status_by_day(spark, d):
    rows = table(spark, d, "events").select(F.struct("user_id", F.to_date("ts").alias("day")).alias("k"), F.expr(_STATUS).alias("status"))
    return sc.record_status(rows, "k").select("k.user_id", "k.day", "record_status")


@query(f"SELECT user_id, day, CASE WHEN bool_or(s = 'failed') THEN 'completed_with_failures' WHEN bool_or(s = 'needs_review') THEN 'needs_attention' ELSE 'succeeded' END AS job_status FROM ({_DAILY.format(_JOB)}) GROUP BY 1, 2")
def job_status_by_day(spark, d):
    rows = table(spark, d, "events").select(F.struct("user_id", F.to_date("ts").alias("day")).alias("k"), F.expr(_JOB).alias("status"))
    return sc.job_status(rows, "k").select("k.user_id", "k.day", "job_status")


@query("""SELECT user_id, count(*) FILTER (event_type = 'error') AS unresolved, count(*) FILTER (event_type = 'view') AS review, (count(*) FILTER (event_type = 'error'), count(*) FILTER (event_type = 'view')) < (count(*) FILTER (event_type = 'signup'), count(*) FILTER (event_type = 'click')) AS better FROM events GROUP BY 1""")
def extraction_quality_rank(spark, d):
    n = lambda t: F.count_if(F.col("event_type") == t)
    return table(spark, d, "events").groupBy("user_id").agg(n("error").alias("unresolved"), n("view").alias("review"), (F.struct(n("error").alias("a"), n("view").alias("b")) < F.struct(n("signup").alias("a"), n("click").alias("b"))).alias("better"))


@query("""SELECT user_id, CASE WHEN errors > 12 THEN 'FAIL' WHEN buys < 5 THEN 'NEEDS_EVIDENCE' ELSE 'PASS' END AS verdict, concat_ws(',', CASE WHEN errors > 12 THEN 'errors' END, CASE WHEN buys < 5 THEN 'few_purchases' END) AS reasons
FROM (SELECT user_id, count(*) FILTER (event_type = 'error') AS errors, count(*) FILTER (event_type = 'purchase') AS buys FROM events GROUP BY 1)""")
def acceptance_verdict(spark, d):
    c = table(spark, d, "events").groupBy("user_id").agg(F.count_if(F.col("event_type") == "error").alias("errors"), F.count_if(F.col("event_type") == "purchase").alias("buys"))
    fail, few = F.col("errors") > 12, F.col("buys") < 5
    reasons = F.array_join(F.array_compact(F.array(F.when(fail, "errors"), F.when(few, "few_purchases"))), ",")
    return c.select("user_id", F.when(fail, "FAIL").when(few, "NEEDS_EVIDENCE").otherwise("PASS").alias("verdict"), reasons.alias("reasons"))


@query("SELECT event_type, round(count(*) FILTER (value > 20) / nullif(count(*) FILTER (value > 5), 0), 9) AS rate FROM events GROUP BY 1")
def parity_rate(spark, d):
    rate = F.try_divide(F.count_if(F.col("value") > 20), F.count_if(F.col("value") > 5))
    return table(spark, d, "events").groupBy("event_type").agg(F.round(rate, 9).alias("rate"))


_AGE = "greatest(0, floor(1708000000 - epoch(ts)))"
_WEIGHT = f"CASE WHEN {_AGE} >= 15552000 THEN 0.0 ELSE pow(0.5, {_AGE} / 2592000) END"


def _signals(spark, d):
    weight = sc.effective(F.lit(1.0), F.unix_micros(F.col("ts").cast("timestamp")) / 1_000_000, F.lit(1_708_000_000))
    bad = F.col("event_type") == "error"
    return table(spark, d, "events").groupBy("user_id").agg(F.sum(F.when(bad, 0.0).otherwise(weight)).alias("confirmed"), F.sum(F.when(bad, weight).otherwise(0.0)).alias("rejected"))


@query(f"""SELECT user_id, round(c, 6) AS confirmed, round(r, 6) AS rejected, round(least(0.18, 0.06 * c) - least(0.24, 0.08 * r), 6) AS adjustment FROM (
SELECT user_id, sum(CASE WHEN event_type = 'error' THEN 0.0 ELSE {_WEIGHT} END) AS c, sum(CASE WHEN event_type = 'error' THEN {_WEIGHT} ELSE 0.0 END) AS r FROM events GROUP BY 1)""")
def profile_decay(spark, d):
    return _signals(spark, d).select("user_id", F.round("confirmed", 6).alias("confirmed"), F.round("rejected", 6).alias("rejected"), F.round(sc.adjustment(F.col("confirmed"), F.col("rejected")), 6).alias("adjustment"))


@query("SELECT count(*) FILTER (w <= 0.05) AS removed, count(*) FILTER (w > 0.05) AS kept FROM (SELECT user_id, event_type, sum(pow(0.5, greatest(0, floor(1714000000 - epoch(ts))) / 2592000)) * 0.05 AS w FROM events GROUP BY 1, 2)")
def profile_prune(spark, d):
    weight = sc.effective(F.lit(1.0), F.unix_micros(F.col("ts").cast("timestamp")) / 1_000_000, F.lit(1_714_000_000))
    patterns = table(spark, d, "events").groupBy("user_id", "event_type").agg((F.sum(weight) * 0.05).alias("w"))
    return patterns.agg(F.count_if(F.col("w") <= 0.05).alias("removed"), F.count_if(F.col("w") > 0.05).alias("kept"))


@query("""WITH r AS (SELECT user_id, ts, event_id, CASE WHEN event_type = 'error' THEN 0 ELSE CAST(ceil(value / 10) AS BIGINT) END AS passed, event_type = 'error' AS bad FROM events),
a AS (SELECT *, sum(CAST(bad AS INT)) OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS failures_from_here FROM r),
s AS (SELECT user_id, CAST(coalesce(sum(passed) FILTER (failures_from_here = 0), 0) AS BIGINT) AS streak, count(*) FILTER (failures_from_here = 0 AND passed > 0) AS clean_runs FROM a GROUP BY 1)
SELECT *, CASE WHEN streak >= 30 AND clean_runs >= 3 THEN 'generic_primary' ELSE 'observing' END AS mode FROM s""")
def parity_fold(spark, d):
    runs = table(spark, d, "events").select("user_id", "ts", "event_id", F.when(F.col("event_type") == "error", 0).otherwise(F.ceil(F.col("value") / 10)).cast("long").alias("passed"), (F.col("event_type") == "error").cast("long").alias("failed"))
    return sc.parity_fold(runs, "user_id", ["ts", "event_id"])


@query("""WITH t AS (SELECT page_id, len(string_split(url, '/')) * 0.5 + CASE WHEN url LIKE 'https%' THEN 2 ELSE 0 END AS score FROM pages)
SELECT page_id, score FROM t ORDER BY score DESC, page_id LIMIT 100""")
def ranked_urls(spark, d):
    score = (F.size(F.split("url", "/")) * 0.5 + F.when(F.col("url").startswith("https"), 2).otherwise(0)).cast("double")
    return table(spark, d, "pages").select("page_id", score.alias("score")).orderBy(F.desc("score"), "page_id").limit(100)


@query("SELECT page_id FROM pages WHERE pmod_((SELECT count(*) FROM pages p WHERE p.page_id < pages.page_id), 10) = 3".replace("pmod_(", "mod("))
def rotating_sample(spark, d):
    return wh.numbered(table(spark, d, "pages").select("page_id"), "page_id", "rank").where(F.pmod("rank", F.lit(10)) == 3).select("page_id")


_RULES = [(1, "red", "warm", 10), (2, "blue", "cold", 30), (3, "green", "fresh", 20), (4, "steel", "metal", 40), (5, "an", "other", 1)]


@query("SELECT p_partkey, CASE " + " ".join(f"WHEN contains(lower(p_name || ' ' || p_type), '{v}') THEN '{c}'" for _, v, c, _ in sorted(_RULES, key=lambda r: -r[3])) + " ELSE 'Unsorted' END AS category FROM part")
def rule_classify(spark, d):
    rules = spark.createDataFrame([(i, v, c, p, True) for i, v, c, p in _RULES], "id int, match_value string, category string, priority int, enabled boolean")
    rows = table(spark, d, "part").withColumn("text", F.concat_ws(" ", "p_name", "p_type"))
    return wh.classify_by_rules(rows, rules, "text", "Unsorted").select("p_partkey", "category")
