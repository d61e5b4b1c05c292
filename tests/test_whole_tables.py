"""Queries that must read whole tables."""

from offerloom.operators import warehouse
from offerloom.plans import catalog


def events(spark, folder, rows):
    schema = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"
    df = spark.createDataFrame([(i, "2024-01-01 10:00:00", u, kind, 1.0, "") for i, u, kind in rows], schema.replace("timestamp_ntz", "string"))
    df.withColumn("ts", df.ts.cast("timestamp_ntz")).write.parquet(f"{folder}/events.parquet")


def test_statuses_see_every_event(spark, tmp_path):
    # User 1 has an error only at event 2, user 2 no event whose id is its own modulo 40.
    events(spark, tmp_path, [(1, 1, "click"), (2, 1, "error"), (3, 2, "signup"), (300, 2, "click")])
    run = lambda name: {r.user_id: r[name] for r in catalog.queries()[f"{name}_by_day"](spark, str(tmp_path)).collect()}
    assert run("record_status") == {1: "rejected", 2: "incomplete"}
    assert run("job_status") == {1: "completed_with_failures", 2: "needs_attention"}


def test_claims_of_all_users(spark, tmp_path):
    events(spark, tmp_path, [(i, i * 100, "click") for i in range(5)])
    got = catalog.queries()["claim_outcomes_of_users"](spark, str(tmp_path)).collect()
    assert sorted(r.item_id for r in got) == [0, 100, 200, 300, 400]


def test_stale_offers_are_grouped_in_parts_by_rows(spark, monkeypatch):
    monkeypatch.setattr(warehouse, "PART_ROWS", 10)
    seen = [(i // 4, i % 3, i % 7) for i in range(200)] + [(None, 0, 1), (None, 0, 2), (60, None, 1), (61, 0, None), (62, 9, 1)]
    done = [(0, 5), (0, 4), (1, 6), (2, 7), (None, 9)]
    latest = {0: 5, 1: 6, 2: 7}
    want = {}
    for offer, source, at in seen:
        want.setdefault(offer, []).append(source in latest and at is not None and latest[source] > at)
    found = warehouse.stale(spark.createDataFrame(seen, "offer int, source int, seen int"), spark.createDataFrame(done, "source int, done int"), "offer", "source", "seen", "done")
    assert found.rdd.getNumPartitions() == 21  # 205 rows; four shuffle partitions would grow with the table
    assert {r.offer: r.observations for r in found.collect()} == {k: len(v) for k, v in want.items() if all(v)}
