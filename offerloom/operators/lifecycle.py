"""What operators and the publisher do to offers and candidates, as joins with their decisions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import fixed
from .ingest import OPEN

REVIEWED = ("category", "subcategory", "region", "city", "conditions")


def review_overrides(decisions: DataFrame, offers: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(overrides, outcomes) of reviewers' forms, one form per offer.

    ``decisions``: offer_id, action (save, approve or reject), display_title, geo_scope and the
    ``REVIEWED`` fields. Every accepted form overrides seven fields, blanks as null but for the
    title, which falls back to the offer's own; approving and rejecting override the status too.
    Outcomes are saved, approved, rejected, or why nothing was done.
    """
    joined = decisions.join(offers.select("offer_id", F.col("title").alias("__title"), F.lit(True).alias("__known")), "offer_id", "left")
    text = lambda c: F.nullif(F.trim(c), F.lit(""))
    error = (
        F.when(~F.coalesce(F.col("action").isin("save", "approve", "reject"), F.lit(False)), "unsupported_action")
        .when(~F.coalesce(F.col("geo_scope").isin("unknown", "all_russia", "region", "city"), F.lit(False)), "unsupported_scope")
        .when((F.col("action") == "approve") & text("category").isNull(), "category_missing")
        .when(F.col("__known").isNull(), "unknown_offer")
    )
    done = F.create_map(*[F.lit(x) for x in ("save", "saved", "approve", "approved", "reject", "rejected")])[F.col("action")]
    status = F.when(F.col("action") == "approve", "ready").when(F.col("action") == "reject", "rejected")
    pair = lambda name, value: F.struct(F.lit(name).alias("field_name"), value.alias("value"))
    fields = [pair("display_title", F.coalesce(text("display_title"), F.col("__title"))), pair("geo_scope", F.col("geo_scope")), *[pair(c, text(c)) for c in REVIEWED]]
    every = F.array_compact(F.array(*fields, F.when(status.isNotNull(), pair("status", status))))
    judged = joined.withColumn("outcome", F.coalesce(error, done)).withColumn("__fine", error.isNull())
    return judged.where("__fine").select("offer_id", F.inline(every)), judged.select("offer_id", "outcome")


def reject_offers(offers: DataFrame, rejected: DataFrame) -> DataFrame:
    """Next snapshot: open offers that are named become rejected, others stay as they are."""
    named = rejected.select("offer_id", F.lit(True).alias("__no")).distinct()
    hit = F.coalesce(F.col("__no"), F.lit(False)) & F.col("status").isin(*OPEN)
    return offers.join(named, "offer_id", "left").withColumn("status", F.when(hit, "rejected").otherwise(F.col("status"))).select(*offers.columns)


def settle_publications(ledger: DataFrame, offers: DataFrame, results: DataFrame, now: Column) -> tuple[DataFrame, DataFrame]:
    """(ledger, offers) after a publisher's run.

    ``results``: offer_id, channel_id, message_id and error, once a reservation. Without an error a
    reservation is published and so is its offer; with one it has failed, and may be tried again.
    Results without a reservation change nothing.
    """
    key = ["offer_id", "channel_id"]
    told = results.select(*key, F.col("message_id").alias("__message"), F.substring("error", 1, 10_000).alias("__error"), F.lit(True).alias("__told"))
    joined = ledger.join(told, key, "left")
    is_told, good = F.coalesce(F.col("__told"), F.lit(False)), F.col("__error").isNull()
    after = joined.withColumns(
        {
            "status": F.when(is_told & good, "published").when(is_told, "failed").otherwise(F.col("status")),
            "message_id": F.when(is_told & good, F.col("__message")).otherwise(F.col("message_id")),
            "published_at": F.when(is_told & good, now).otherwise(F.col("published_at")),
            "error": F.when(is_told, F.col("__error")).otherwise(F.col("error")),
        }
    )
    out = joined.where(is_told & good).select("offer_id", F.lit(True).alias("__out")).distinct()
    shown = offers.join(out, "offer_id", "left").withColumn("status", F.when(F.col("__out"), "published").otherwise(F.col("status")))
    return after.select(*ledger.columns), shown.select(*offers.columns)


def review_candidates(candidates: DataFrame, decisions: DataFrame, registry: DataFrame, now: Column) -> tuple[DataFrame, DataFrame]:
    """(candidates, new sources) after decisions (candidate_id, decision, collector_type).

    An approval stamps the candidate, unless it was approved before, and makes a source of it
    unless the registry has its URL; of several candidates with one URL the first does. The
    collector is the one named or the platform's own. Other decisions only set the status.
    """
    said = decisions.select("candidate_id", F.col("decision").alias("__d"), F.col("collector_type").alias("__collector"))
    joined = candidates.join(said, "candidate_id", "left").withColumn("__new", F.col("__d").isNotNull() & ~F.coalesce((F.col("status") == "approved") & (F.col("__d") == "approved"), F.lit(False)))
    stamp = lambda c, d: F.when(F.col("__new") & (F.col("__d") == d), now).otherwise(F.col(c))
    after = joined.withColumns({"status": F.coalesce("__d", "status"), "approved_at": stamp("approved_at", "approved"), "rejected_at": stamp("rejected_at", "rejected")})
    platforms = F.create_map(*[F.lit(x) for pair in fixed.COLLECTORS.items() for x in pair])
    passed = joined.where("__new AND __d = 'approved'").join(registry.select("url"), "url", "left_anti")
    name = F.coalesce(*[F.nullif(F.col(c), F.lit("")) for c in ("name", "merchant", "url")])
    new = passed.withColumn("name", name).withColumn("collector_type", F.coalesce("__collector", platforms[F.col("platform")]))
    one = new.groupBy("url").agg(F.min_by(F.struct("name", "platform", "merchant", "collector_type"), "candidate_id").alias("s")).select("url", "s.*")
    return after.select(*candidates.columns), one
