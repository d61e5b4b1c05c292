"""Operators whose behaviour a single query does not show."""

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from offerloom.operators import crawl, matching, scoring, state, warehouse
from offerloom.sources.sinks import Snapshots, export_sheets
from offerloom.streaming import jobs

NOW = datetime(2026, 8, 17, 12)


def at(minutes):
    return NOW + timedelta(minutes=minutes)


def now():
    return F.lit(str(NOW)).cast("timestamp")


@pytest.mark.parametrize(
    "a, b, want",
    [("a b c", "c b a", 100.0), ("a b", "a b c", 100.0), ("", "a", 0.0), ("abc", "abd", 200 * 2 / 6), ("x abc", "x abd", 200 * 4 / 10), ("abc", "xyz", 0.0)],
)
def test_token_set_ratio(a, b, want):
    assert matching.token_set_ratio(a, b) == pytest.approx(want)


OFFER = "offer_id long, canonical_url string, promo_code string, merchant string, fingerprint string, norm_merchant string, norm_title string, discount_percent double, discount_amount double"


def test_cascade_levels(spark):
    stored = spark.createDataFrame(
        [
            (1, "u1", "P1", "M", "f1", "m", "red shoes sale", 10.0, None, 1),
            (2, "u2", "P2", "M", "f2", "m", "blue hats for all", 10.0, None, 2),
            (3, None, None, None, "f3", "", "no shop here", None, None, 3),
        ],
        OFFER + ", updated_at int",
    )
    new = spark.createDataFrame(
        [
            (10, "u1", "P2", "M", "f2", "m", "x", None, None),
            (11, "u9", "P2", "M", "f1", "m", "x", None, None),
            (12, None, None, "Z", "f3", "z", "x", None, None),
            (13, None, None, "M", "zz", "m", "sale shoes red", 10.0, None),
            (14, None, None, "M", "zz", "m", "sale shoes red", 20.0, None),
            (15, None, None, None, "zz", "", "red shoes sale", 10.0, None),
            (16, "", "", "M", "zz", "m", "", None, None),
        ],
        OFFER,
    )
    got = {r.offer_id: (r.match_id, r.reason) for r in matching.cascade(new, stored).collect()}
    assert got == {10: (1, "canonical_url"), 11: (2, "merchant_promo_code"), 12: (3, "fingerprint"), 13: (1, "fuzzy_title"), 14: (1, "fuzzy_title") if 100 - 8 >= 92 else None, 15: (None, None), 16: (None, None)}


def test_leases_replay(spark):
    schema = "job_id string, item_id int, action string, reviewer_id string, at timestamp, expires_at timestamp, event_id int, lease_token string"
    log = [("j", 1, "claimed", "ann", at(-20), at(-5), 1, "t1"), ("j", 2, "claimed", "bob", at(-5), at(10), 2, "t2"), ("j", 3, "claimed", "bob", at(-5), at(10), 3, "t3"), ("j", 3, "released", "bob", at(-1), at(10), 4, "t3")]
    events = spark.createDataFrame(log, schema)
    assert {r.item_id: r.active for r in state.current_leases(events, now()).collect()} == {1: False, 2: True, 3: False}
    asks = spark.createDataFrame([("j", 1, "cat"), ("j", 2, "bob"), ("j", 3, "ann"), ("j", 4, "ann"), ("j", 4, "zoe")], "job_id string, item_id int, reviewer_id string")
    got = {r.item_id: (r.reviewer_id, r.outcome) for r in state.claim(asks, events, now(), F.expr("INTERVAL 15 MINUTES")).collect()}
    assert got == {1: ("cat", "taken_over"), 2: ("bob", "already_held"), 3: ("ann", "taken_over"), 4: ("ann", "claimed")}
    renew = spark.createDataFrame([("j", 2, "bob", "t2"), ("j", 2, "bob", "no")], "job_id string, item_id int, reviewer_id string, lease_token string")
    assert sorted(r.renewed for r in state.extend(renew, events, now(), F.expr("INTERVAL 15 MINUTES")).collect()) == [False, True]


def test_confirm(spark):
    decisions = spark.createDataFrame([("a", "f", "needs_confirmation"), ("a", "g", "auto_selected")], "asset string, field string, status string")
    candidates = spark.createDataFrame([("a", "f", "c1", "v1")], "asset string, field string, candidate_id string, value string")
    picks = spark.createDataFrame([("a", "f", "c1"), ("a", "g", "c1"), ("a", "h", "c1")], "asset string, field string, candidate_id string")
    got = {r.field: (r.status, r.error) for r in state.confirm(decisions, picks, candidates).collect()}
    assert got["f"] == ("confirmed", None) and got["g"] == ("auto_selected", "not_open") and got["h"][1] == "unknown_field"


def test_decay_and_merge(spark):
    day = 86_400
    stored = spark.createDataFrame([("s", "f", "old", 4.0, 2.0, 0.0), ("s", "f", "dead", 4.0, 2.0, -151.0 * day)], "site string, field string, fingerprint string, confirmed double, rejected double, updated_at double")
    learnt = spark.createDataFrame([("s", "f", "old", 1, 0), ("s", "f", "dead", 0, 1), ("s", "f", "new", 1, 1)], "site string, field string, fingerprint string, confirmed int, rejected int")
    got = {r.fingerprint: (r.confirmed, r.rejected) for r in state.merge_signals(stored, learnt, F.lit(30.0 * day)).collect()}
    assert got == {"old": (3.0, 1.0), "dead": (0.0, 1.0), "new": (1.0, 1.0)}


def test_parity_fold(spark):
    rows = [("a", i, 15, 0) for i in range(3)] + [("b", 0, 40, 0), ("b", 1, 0, 1), ("b", 2, 5, 0)] + [("c", 0, 20, 0), ("c", 1, 20, 0), ("c", 2, 1, 0)]
    got = {r.source: (r.streak, r.clean_runs, r.mode) for r in scoring.parity_fold(spark.createDataFrame(rows, "source string, at int, passed long, failed long"), "source", ["at"]).collect()}
    assert got == {"a": (45, 3, "generic_primary"), "b": (5, 1, "observing"), "c": (41, 3, "generic_primary")}


def test_bounded_crawl(spark):
    links = [("s", "a", 0, False), ("s", "b", 1, False), ("s", "n", 2, True), ("a", "b", 0, False), ("a", "c", 1, False), ("b", "d", 0, False)]
    edges = spark.createDataFrame(links, "url string, target string, position int, nofollow boolean")
    seeds = spark.createDataFrame([("s", 0), ("s", 1)], "url string, position int")
    got = lambda **k: [(r.url, r.depth) for r in crawl.discover(seeds, edges, **k).orderBy("discovery_index").collect()]
    assert got(depth=2, pages=50, urls=500) == [("s", 0), ("a", 1), ("b", 1), ("c", 2), ("d", 2)]
    assert got(depth=2, pages=2, urls=500) == [("s", 0), ("a", 1), ("b", 1), ("c", 2)]
    assert got(depth=2, pages=50, urls=3) == [("s", 0), ("a", 1), ("b", 1)]


def test_upsert_keeps_what_is_blank_or_held(spark):
    stored = spark.createDataFrame([(1, "a", 5), (2, "b", None)], "id int, name string, n int")
    incoming = spark.createDataFrame([(1, "", 7), (2, "z", 8), (3, "c", None)], "id int, name string, n int")
    held = spark.createDataFrame([(2, "name")], "id int, field_name string")
    got = sorted(map(tuple, warehouse.upsert(stored, incoming, "id", held).collect()))
    assert got == [(1, "a", 7), (2, "b", 8), (3, "c", None)]
    assert sorted(map(tuple, warehouse.upsert(warehouse.upsert(stored, incoming, "id", held), incoming, "id", held).collect())) == got


def test_snapshots_and_exports(spark, tmp_path):
    store = Snapshots(spark, f"file://{tmp_path}/t")
    assert store.read() is None
    store.commit(spark.range(3))
    assert store.read().count() == 3
    store.commit(store.read().where("id > 0"))
    assert sorted(r.id for r in store.read().collect()) == [1, 2]
    export_sheets(store.read(), f"file://{tmp_path}/x", F.when(F.col("id") > 1, "big").otherwise("small"))
    assert {p.name for p in (tmp_path / "x").glob("sheet=*")} == {"sheet=big", "sheet=small"}


def test_streams_equal_batches(spark, tmp_path):
    rows = spark.createDataFrame([(i % 7, f"s{i % 3}", at(i), i % 5 == 0) for i in range(100)], "key int, source string, at timestamp, failed boolean")
    rows.repartition(4).write.parquet(f"{tmp_path}/in")
    stream = jobs.read(spark, f"{tmp_path}/in", StructType.fromJson(rows.schema.jsonValue()), 2)
    jobs.append_to(jobs.first_seen(stream, ["key"], "at"), f"{tmp_path}/out", f"{tmp_path}/c1").awaitTermination()
    assert sorted(r.key for r in spark.read.parquet(f"{tmp_path}/out").collect()) == list(range(7))
    seen = []
    jobs.upsert_into(stream, lambda batch, epoch: seen.append((epoch, batch.count())), f"{tmp_path}/c2").awaitTermination()
    assert sum(n for _, n in seen) == 100 and len({e for e, _ in seen}) == len(seen)
    jobs.append_to(jobs.run_metrics(stream, "at"), f"{tmp_path}/m", f"{tmp_path}/c3").awaitTermination()
    final = spark.read.parquet(f"{tmp_path}/m")
    batch = rows.groupBy(F.window("at", "1 hour").alias("w"), "source").agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("start"), "source", "n")
    assert final.select("start", "source", "n").exceptAll(batch).count() == 0
