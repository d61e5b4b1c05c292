"""Leases, checkpoints, durable results and learning, as queries over event logs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .scoring import effective

TERMINAL = ("succeeded", "failed", "skipped")
KEY = ["job_id", "item_id"]


def current_leases(events: DataFrame, now: Column) -> DataFrame:
    """The latest event of each item, and whether its lease still holds at ``now``.

    ``events``: job_id, item_id, action (claimed, renewed, taken_over, released, completed),
    reviewer_id, at, expires_at, event_id.
    """
    last = F.max_by(F.struct("action", "reviewer_id", "expires_at", "lease_token"), F.struct("at", "event_id"))
    latest = events.groupBy(*KEY).agg(last.alias("e"), F.count(F.lit(1)).alias("revision"))
    held = F.col("e.action").isin("claimed", "renewed", "taken_over") & (F.col("e.expires_at") > now)
    return latest.select(*KEY, F.col("e.reviewer_id").alias("reviewer_id"), F.col("e.expires_at").alias("expires_at"), F.col("e.lease_token").alias("lease_token"), "revision", held.alias("active"))


def claim(requests: DataFrame, events: DataFrame, now: Column, ttl: Column) -> DataFrame:
    """Outcome of claims (job_id, item_id, reviewer_id): claimed, already_held, taken_over or
    refused, with the new expiry. Of several claims on an item the smallest reviewer wins."""
    leases = current_leases(events, now)
    first = requests.groupBy(*KEY).agg(F.min("reviewer_id").alias("reviewer_id"))
    joined = first.join(leases.withColumnRenamed("reviewer_id", "holder"), KEY, "left")
    mine = F.col("holder") == F.col("reviewer_id")
    outcome = F.when(F.col("holder").isNull(), "claimed").when(F.col("active") & mine, "already_held").when(F.col("active"), "refused").when(mine, "claimed").otherwise("taken_over")
    expires = F.when(outcome == "refused", F.col("expires_at")).otherwise(now + ttl)
    return joined.select(*KEY, "reviewer_id", outcome.alias("outcome"), expires.alias("expires_at"))


def extend(requests: DataFrame, events: DataFrame, now: Column, ttl: Column) -> DataFrame:
    """Renewals: they hold only for the owner, with the right token, of a live lease."""
    leases = current_leases(events, now).select(*KEY, F.col("reviewer_id").alias("holder"), F.col("lease_token").alias("held"), "active")
    joined = requests.join(leases, KEY, "left")
    fine = F.coalesce(F.col("active") & (F.col("holder") == F.col("reviewer_id")) & (F.col("held") == F.col("lease_token")), F.lit(False))
    return joined.select(*KEY, "reviewer_id", fine.alias("renewed"), F.when(fine, now + ttl).alias("expires_at"))


def pending_review(results: DataFrame, events: DataFrame, now: Column) -> DataFrame:
    """Results that need review and that nobody holds."""
    held = current_leases(events, now).where("active").select(*KEY)
    return results.where("status IN ('needs_review', 'needs_confirmation')").join(held, KEY, "left_anti")


def remaining(items: DataFrame, checkpoint: DataFrame) -> DataFrame:
    """Items that a resumed job still has to run."""
    done = checkpoint.where(F.col("status").isin(*TERMINAL)).select(*KEY)
    return items.join(done, KEY, "left_anti")


def persist(new: DataFrame, stored: DataFrame) -> DataFrame:
    """How each first result meets the store: created, unchanged, conflict or mismatch."""
    old = stored.select(*KEY, F.col("definition_hash").alias("__d"), F.col("payload_hash").alias("__p"))
    joined = new.join(old, KEY, "left")
    outcome = F.when(F.col("__d").isNull(), "created").when(F.col("__d") != F.col("definition_hash"), "mismatch").when(F.col("__p") == F.col("payload_hash"), "unchanged").otherwise("conflict")
    return joined.withColumn("outcome", outcome).drop("__d", "__p")


def confirm(decisions: DataFrame, selections: DataFrame, candidates: DataFrame) -> DataFrame:
    """Reviewers' choices: an existing candidate or none, only where confirmation is asked for."""
    chosen = selections.join(decisions, ["asset", "field"], "left").join(candidates.select("asset", "field", F.col("candidate_id"), F.col("value").alias("__value")), ["asset", "field", "candidate_id"], "left")
    error = F.when(F.col("status").isNull(), "unknown_field").when(F.col("status") != "needs_confirmation", "not_open").when(F.col("candidate_id").isNotNull() & F.col("__value").isNull(), "unknown_candidate")
    after = F.when(error.isNotNull(), F.col("status")).when(F.col("candidate_id").isNull(), "rejected").otherwise("confirmed")
    return chosen.select("asset", "field", "candidate_id", F.col("__value").alias("value"), after.alias("status"), error.alias("error"))


def learn(selections: DataFrame, prints: DataFrame) -> DataFrame:
    """Confirmations and rejections per fingerprint: the chosen candidate's confirm; the others'
    reject, but for those the chosen one has as well."""
    joined = prints.join(selections.select("asset", "field", F.col("candidate_id").alias("__chosen")), ["asset", "field"])
    per = joined.groupBy("site", "asset", "field", "fingerprint").agg(F.bool_or(F.col("candidate_id") == F.col("__chosen")).alias("good"))
    return per.groupBy("site", "field", "fingerprint").agg(F.count_if("good").alias("confirmed"), F.count_if(~F.col("good")).alias("rejected"))


def merge_signals(stored: DataFrame, learnt: DataFrame, as_of: Column) -> DataFrame:
    """Decay what is stored to ``as_of``, add what is learnt, and stamp it."""
    new = learnt.withColumnsRenamed({"confirmed": "__c", "rejected": "__r"})
    joined = stored.join(new, ["site", "field", "fingerprint"], "full_outer")
    aged = lambda c: F.coalesce(effective(F.col(c), F.col("updated_at"), as_of), F.lit(0.0))
    touched = F.col("__c").isNotNull()
    value = lambda c, n: F.when(touched, aged(c) + F.coalesce(F.col(n), F.lit(0))).otherwise(F.col(c))
    return joined.select("site", "field", "fingerprint", value("confirmed", "__c").alias("confirmed"), value("rejected", "__r").alias("rejected"), F.when(touched, as_of).otherwise(F.col("updated_at")).alias("updated_at"))


def reserve_publications(wanted: DataFrame, offers: DataFrame, ledger: DataFrame) -> DataFrame:
    """Outcome of reserving (offer_id, channel_id): reserved once, again after a failure, never
    while one is pending or done, and only for ready offers."""
    state = offers.select("offer_id", F.col("status").alias("__offer"))
    joined = wanted.join(state, "offer_id", "left").join(ledger.select("offer_id", "channel_id", F.col("status").alias("__ledger")), ["offer_id", "channel_id"], "left")
    outcome = F.when(F.coalesce(F.col("__offer"), F.lit("")) != "ready", "not_ready").when(F.col("__ledger").isNull(), "reserved").when(F.col("__ledger").isin("failed", "skipped"), "retried").otherwise("blocked")
    return joined.select("offer_id", "channel_id", outcome.alias("outcome"))
