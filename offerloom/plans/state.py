"""Queries over event logs, link graphs and duplicate cascades."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import expressions as ex
from ..operators import crawl as cr
from ..operators import matching, scoring, state
from ..operators import warehouse as wh
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


_NOW = "2024-01-15 00:00:00"
_ACTION = "CASE event_type WHEN 'signup' THEN 'claimed' WHEN 'click' THEN 'renewed' WHEN 'view' THEN 'taken_over' WHEN 'error' THEN 'released' ELSE 'completed' END"


def _leases(spark, d):
    rows = table(spark, d, "events").where(F.col("ts").cast("timestamp") <= F.lit(_NOW).cast("timestamp"))
    at = F.col("ts").cast("timestamp")
    return rows.select(F.lit("job").alias("job_id"), F.col("user_id").alias("item_id"), F.expr(_ACTION).alias("action"), F.pmod("event_id", F.lit(5)).alias("reviewer_id"), at.alias("at"), (at + F.expr("INTERVAL 6 HOURS")).alias("expires_at"), "event_id", F.col("event_id").cast("string").alias("lease_token"))


_LATEST = f"SELECT user_id AS item_id, arg_max({_ACTION}, (ts, event_id)) AS action, arg_max(event_id % 5, (ts, event_id)) AS reviewer_id, max(ts) AS seen, count(*) AS revision FROM events WHERE ts <= TIMESTAMP '{_NOW}' GROUP BY 1"


@query(f"SELECT item_id, reviewer_id, revision, action IN ('claimed', 'renewed', 'taken_over') AND seen + INTERVAL 6 HOUR > TIMESTAMP '{_NOW}' AS active FROM ({_LATEST})")
def current_leases(spark, d):
    return state.current_leases(_leases(spark, d), F.lit(_NOW).cast("timestamp")).select("item_id", "reviewer_id", "revision", "active")


@query(f"""SELECT item_id, reviewer, CASE WHEN l.reviewer_id IS NULL THEN 'claimed' WHEN active AND l.reviewer_id = reviewer THEN 'already_held' WHEN active THEN 'refused' WHEN l.reviewer_id = reviewer THEN 'claimed' ELSE 'taken_over' END AS outcome
FROM (SELECT c_custkey AS item_id, c_custkey % 5 AS reviewer FROM customer) r LEFT JOIN (SELECT *, action IN ('claimed', 'renewed', 'taken_over') AND seen + INTERVAL 6 HOUR > TIMESTAMP '{_NOW}' AS active FROM ({_LATEST})) l USING (item_id)""")
def claim_outcomes(spark, d):
    key = F.col("c_custkey").cast("long")
    requests = table(spark, d, "customer").select(F.lit("job").alias("job_id"), key.alias("item_id"), F.pmod(key, F.lit(5)).alias("reviewer_id"))
    got = state.claim(requests, _leases(spark, d), F.lit(_NOW).cast("timestamp"), F.expr("INTERVAL 15 MINUTES"))
    return got.select("item_id", F.col("reviewer_id").alias("reviewer"), "outcome")


@query(f"""SELECT item_id, reviewer, CASE WHEN l.reviewer_id IS NULL THEN 'claimed' WHEN active AND l.reviewer_id = reviewer THEN 'already_held' WHEN active THEN 'refused' WHEN l.reviewer_id = reviewer THEN 'claimed' ELSE 'taken_over' END AS outcome
FROM (SELECT DISTINCT user_id AS item_id, user_id % 5 AS reviewer FROM events) r LEFT JOIN (SELECT *, action IN ('claimed', 'renewed', 'taken_over') AND seen + INTERVAL 6 HOUR > TIMESTAMP '{_NOW}' AS active FROM ({_LATEST})) l USING (item_id)""")
def claim_outcomes_of_users(spark, d):
    """A claim for every user of events, where claim_outcomes asks for every customer's number."""
    users = table(spark, d, "events").select(F.col("user_id").alias("item_id")).distinct()
    requests = users.select(F.lit("job").alias("job_id"), "item_id", F.pmod("item_id", F.lit(5)).alias("reviewer_id"))
    got = state.claim(requests, _leases(spark, d), F.lit(_NOW).cast("timestamp"), F.expr("INTERVAL 15 MINUTES"))
    return got.select("item_id", F.col("reviewer_id").alias("reviewer"), "outcome")


@query(f"SELECT DISTINCT user_id AS item_id FROM events WHERE event_type = 'purchase' AND user_id NOT IN (SELECT item_id FROM ({_LATEST}) WHERE action IN ('claimed', 'renewed', 'taken_over') AND seen + INTERVAL 6 HOUR > TIMESTAMP '{_NOW}')")
def pending_review(spark, d):
    results = table(spark, d, "events").where("event_type = 'purchase'").select(F.lit("job").alias("job_id"), F.col("user_id").alias("item_id"), F.lit("needs_review").alias("status")).distinct()
    return state.pending_review(results, _leases(spark, d), F.lit(_NOW).cast("timestamp")).select("item_id")


@query("SELECT o_orderkey AS item_id FROM orders WHERE o_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F')")
def remaining_items(spark, d):
    orders = table(spark, d, "orders").select(F.lit("job").alias("job_id"), F.col("o_orderkey").alias("item_id"), F.when(F.col("o_orderstatus") == "F", "succeeded").otherwise("pending").alias("status"))
    return state.remaining(orders, orders).select("item_id")


@query("SELECT outcome, count(*) AS n FROM (SELECT CASE WHEN o_orderkey % 4 = 0 THEN 'created' WHEN o_orderkey % 7 = 0 THEN 'mismatch' WHEN o_orderkey % 5 = 0 THEN 'conflict' ELSE 'unchanged' END AS outcome FROM orders) GROUP BY 1")
def persist_results(spark, d):
    new = table(spark, d, "orders").select(F.lit("job").alias("job_id"), F.col("o_orderkey").alias("item_id"), F.lit("d1").alias("definition_hash"), F.lit("p1").alias("payload_hash"))
    k = F.col("item_id")
    stored = new.where(k % 4 != 0).withColumn("definition_hash", F.when(k % 7 == 0, "d0").otherwise("d1")).withColumn("payload_hash", F.when(k % 5 == 0, "p0").otherwise("p1"))
    return state.persist(new, stored).groupBy("outcome").agg(F.count(F.lit(1)).alias("n"))


@query("""SELECT o_orderkey AS offer_id, CASE WHEN o_orderstatus <> 'F' THEN 'not_ready' WHEN o_orderkey % 3 = 0 THEN 'reserved' WHEN o_orderkey % 3 = 1 THEN 'retried' ELSE 'blocked' END AS outcome FROM orders""")
def reserve_publications(spark, d):
    offers = table(spark, d, "orders").select(F.col("o_orderkey").alias("offer_id"), F.when(F.col("o_orderstatus") == "F", "ready").otherwise("new").alias("status"))
    wanted = offers.select("offer_id", F.lit("c").alias("channel_id"))
    ledger = wanted.where("offer_id % 3 <> 0").withColumn("status", F.when(F.col("offer_id") % 3 == 1, "failed").otherwise("published"))
    return state.reserve_publications(wanted, offers, ledger).select("offer_id", "outcome")


@query("""SELECT p_partkey, p_brand, CASE WHEN p_partkey % 4 = 0 THEN 'By hand' WHEN p_partkey % 3 = 0 THEN 'New ' || p_name ELSE p_name END AS p_name FROM part""")
def upsert_with_overrides(spark, d):
    stored = table(spark, d, "part").select("p_partkey", "p_name", "p_brand")
    hand = stored.where("p_partkey % 4 = 0").select("p_partkey", F.lit("p_name").alias("field_name"), F.lit("By hand").alias("value"))
    incoming = stored.where("p_partkey % 3 = 0").select("p_partkey", F.concat(F.lit("New "), "p_name").alias("p_name"), F.lit("").alias("p_brand"))
    return wh.upsert(wh.merge_overrides(stored, hand, "p_partkey", ["p_name"]), incoming, "p_partkey", hand)


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN 'new' ELSE 'old' END AS payload, CAST(CASE WHEN o_orderkey % 2 = 0 THEN 2 ELSE 1 END AS BIGINT) AS revision FROM orders")
def compare_and_swap(spark, d):
    stored = table(spark, d, "orders").select("o_orderkey", F.lit("d").alias("definition_hash"), F.lit("old").alias("payload"), F.lit(1).cast("long").alias("revision"))
    changes = stored.select("o_orderkey", "definition_hash", F.lit("new").alias("payload"), F.when(F.col("o_orderkey") % 2 == 0, 1).otherwise(9).cast("long").alias("expected_revision"))
    return wh.compare_and_swap(stored, changes, "o_orderkey")[0].select("o_orderkey", "payload", "revision")


@query("""WITH p AS (SELECT user_id, event_type, value > 50 AS good FROM events),
g AS (SELECT user_id, event_type, bool_or(good) AS good FROM p GROUP BY 1, 2)
SELECT event_type AS fingerprint, count(*) FILTER (good) AS confirmed, count(*) FILTER (NOT good) AS rejected FROM g GROUP BY 1""")
def learn_signals(spark, d):
    prints = table(spark, d, "events").select(F.lit("site").alias("site"), F.col("user_id").alias("asset"), F.lit("f").alias("field"), F.col("event_type").alias("fingerprint"), F.when(F.col("value") > 50, "yes").otherwise("no").alias("candidate_id"))
    chosen = prints.select("asset", "field").distinct().withColumn("candidate_id", F.lit("yes"))
    return state.learn(chosen, prints).select("fingerprint", "confirmed", "rejected")


@query("""SELECT event_id AS candidate_id, round(greatest(0, least(0.99, least(0.9, value / 100) + CASE event_type WHEN 'error' THEN -0.16 WHEN 'view' THEN 0.12 ELSE 0 END)), 9) AS confidence FROM events""")
def profile_adjust(spark, d):
    candidates = table(spark, d, "events").select(F.col("event_id").alias("candidate_id"), F.least(F.lit(0.9), F.col("value") / 100).alias("confidence"), F.col("event_type").alias("fingerprint"))
    stats = spark.createDataFrame([("error", 0, 2), ("view", 2, 0)], "fingerprint string, confirmed int, rejected int")
    return scoring.adjust(candidates, stats).select("candidate_id", F.round("confidence", 9).alias("confidence"))


@query("""WITH RECURSIVE b AS (SELECT 0 AS k, 0 AS depth UNION SELECT n, depth + 1 FROM b, LATERAL (SELECT unnest([k * 2 + 1, k * 2 + 2]) AS n) WHERE depth < 4 AND k IN (SELECT page_id FROM pages))
SELECT CAST(k AS VARCHAR) AS url, depth, CAST(k AS BIGINT) AS discovery_index FROM b""")
def crawl_tree(spark, d):
    seeds = spark.createDataFrame([("0", 0)], "url string, position int")
    links = table(spark, d, "pages").select(F.col("page_id").cast("long").alias("id")).select(F.col("id").cast("string").alias("url"), F.explode(F.array(F.struct((F.col("id") * 2 + 1).alias("t"), F.lit(0).alias("p")), F.struct((F.col("id") * 2 + 2).alias("t"), F.lit(1).alias("p")))).alias("x"))
    links = links.select("url", F.col("x.t").cast("string").alias("target"), F.col("x.p").alias("position"), F.lit(False).alias("nofollow"))
    return cr.discover(seeds, links, 4, 50, 500).select("url", "depth", F.col("discovery_index").cast("long").alias("discovery_index"))


@query("""WITH RECURSIVE b AS (SELECT 0 AS k, 0 AS depth, CAST(NULL AS INTEGER) AS p UNION ALL SELECT n, depth + 1, k FROM b, LATERAL (SELECT unnest([k * 2 + 1, k * 2 + 2]) AS n) WHERE depth < 6 AND n % 11 <> 5 AND k IN (SELECT page_id FROM pages))
SELECT CAST(k AS VARCHAR) AS url, CASE WHEN p % 7 = 3 THEN 'r' ELSE '' END || p AS parent, depth, i AS discovery_index FROM (SELECT *, row_number() OVER (ORDER BY k) - 1 AS i FROM b) WHERE k > 0 AND i <= 40""")
def crawl_redirects(spark, d):
    """A tree over the numbers of pages; every seventh page has moved twice, some links are not to be followed, and the crawl ends at 40 URLs."""
    here, k = table(spark, d, "pages").select(F.col("page_id").cast("long").alias("page_id")), F.col("page_id")
    moved = k % 7 == 3
    redirects = here.where(moved).select(F.inline(F.array(*[F.struct(F.concat(F.lit(a), k.cast("string")).alias("url"), F.concat(F.lit(b), k.cast("string")).alias("target")) for a, b in (("", "m"), ("m", "r"))])))
    place = F.posexplode(F.array(k * 2 + 1, k * 2 + 2)).alias("position", "to")
    links = here.select(F.concat(F.when(moved, "r").otherwise(""), k.cast("string")).alias("url"), place)
    links = links.select("url", F.col("to").cast("string").alias("target"), "position", (F.col("to") % 11 == 5).alias("nofollow"))
    seeds = spark.createDataFrame([("0", 0)], "url string, position int")
    found, _ = cr.crawl(seeds, links, redirects, 6, 1_000, 40)
    return found.select("url", "parent", "depth", F.col("discovery_index").cast("long").alias("discovery_index"))


_TERMS, _CALLS = ["and", "rights", "license"], ["see", "token"]


@query()
def content_relevance(spark, d):
    score = cr.content_score(F.substring_index("text", "\n", 1), F.lit(None).cast("string"), F.lit(None).cast("string"), F.col("text"), _TERMS, _CALLS)
    scored = table(spark, d, "documents").select("doc_id", score.alias("score"))
    return scored.select("doc_id", F.round("score", 6).alias("score"), cr.status(F.col("score")).alias("status"))


@query()
def dedup_cascade(spark, d):
    part = table(spark, d, "part").withColumn("offer_id", F.col("p_partkey"))
    row = part.select(
        "offer_id", F.when(F.col("offer_id") % 5 == 0, F.concat(F.lit("https://x/"), F.col("offer_id") % 50)).alias("canonical_url"), F.when(F.col("offer_id") % 3 == 0, F.concat(F.lit("C"), F.col("offer_id") % 30)).alias("promo_code"),
        F.col("p_brand").alias("merchant"), ex.external_id("p_name", "p_type").alias("fingerprint"), ex.normalize_text(F.col("p_brand")).alias("norm_merchant"), ex.normalize_text(F.col("p_name")).alias("norm_title"),
        F.col("p_size").cast("decimal(8,2)").alias("discount_percent"), F.lit(None).cast("decimal(14,2)").alias("discount_amount"), F.col("p_retailprice").alias("updated_at"),
    )
    return matching.cascade(row.where("offer_id % 2 = 1").drop("updated_at"), row.where("offer_id % 2 = 0"))
