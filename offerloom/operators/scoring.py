"""Candidate resolution, corroboration, status roll-ups, decay, and additive scores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Fixed values of the profile lifecycle: half-life and life in seconds, and the least weight.
HALF_LIFE, LIFE, LEAST_WEIGHT = 30 * 86_400, 180 * 86_400, 0.01
#: What a confirmation adds and a rejection takes off, and the most of each.
GAIN, MOST_GAIN, LOSS, MOST_LOSS = 0.06, 0.18, 0.08, 0.24


def resolve_fields(candidates: DataFrame, fields: DataFrame) -> DataFrame:
    """Per asset and field the best candidate and its status.

    ``candidates``: asset, field, value, confidence, provider, candidate_id; ``fields``: field,
    min_confidence, min_margin. The best is the most confident, then by provider and id. It is
    selected if it is confident enough and far enough ahead of the second.
    """
    order = Window.partitionBy("asset", "field").orderBy(F.desc("confidence"), "provider", "candidate_id")
    ranked = candidates.withColumn("__rank", F.row_number().over(order)).withColumn("second", F.lead("confidence").over(order)).where("__rank = 1")
    assets = candidates.select("asset").distinct()
    names = fields.agg(F.collect_set("field")).scalar()  # a specification, one small row
    spread = assets.withColumn("field", F.explode(names)).join(fields, "field")
    joined = spread.join(ranked.select("asset", "field", "value", "confidence", "second"), ["asset", "field"], "left")
    status = (
        F.when(F.col("confidence").isNull(), "unresolved")
        .when(F.col("confidence") < F.col("min_confidence"), "needs_confirmation")
        .when(F.col("confidence") - F.col("second") < F.col("min_margin"), "needs_confirmation")
        .otherwise("auto_selected")
    )
    return joined.select("asset", "field", "value", "confidence", status.alias("status"))


def corroborate(signals: DataFrame) -> DataFrame:
    """Signals (asset, field, value, kind, confidence) that name one value support each other:
    the best confidence, .03 more for each further kind, .09 more at most, under .99."""
    grouped = signals.groupBy("asset", "field", "value").agg(F.max("confidence").alias("best"), F.count_distinct("kind").alias("kinds"))
    return grouped.select("asset", "field", "value", F.least(F.lit(0.99), F.col("best") + F.least(F.lit(0.09), 0.03 * (F.col("kinds") - 1))).alias("confidence"), "kinds")


def record_status(statuses: DataFrame, asset: str) -> DataFrame:
    """rejected, incomplete, needs_confirmation or ready, in this order of precedence."""
    s = F.col("status")
    return statuses.groupBy(asset).agg(
        F.when(F.bool_or(s == "rejected"), "rejected").when(F.bool_or(s == "unresolved"), "incomplete").when(F.bool_or(s == "needs_confirmation"), "needs_confirmation").otherwise("ready").alias("record_status")
    )


def job_status(items: DataFrame, job: str) -> DataFrame:
    """partial, completed_with_failures, needs_attention or succeeded."""
    s = F.col("status")
    return items.groupBy(job).agg(
        F.when(F.bool_or(s.isin("pending", "running")), "partial").when(F.bool_or(s == "failed"), "completed_with_failures").when(F.bool_or(s.isin("needs_review", "incomplete")), "needs_attention").otherwise("succeeded").alias("job_status")
    )


def effective(weight: Column, updated: Column, as_of: Column) -> Column:
    """A weight that halves every half-life (whole seconds, never negative) and ends at LIFE."""
    age = F.greatest(F.lit(0), F.floor(as_of - updated))
    return F.when(age >= LIFE, 0.0).otherwise(weight * F.pow(F.lit(0.5), age / HALF_LIFE))


def adjustment(confirmed: Column, rejected: Column) -> Column:
    return F.least(F.lit(MOST_GAIN), GAIN * confirmed) - F.least(F.lit(MOST_LOSS), LOSS * rejected)


def adjust(candidates: DataFrame, stats: DataFrame) -> DataFrame:
    """Candidates with the best gain and the worst loss of their fingerprints added."""
    delta = adjustment(F.col("confirmed"), F.col("rejected"))
    joined = candidates.join(stats.select("fingerprint", delta.alias("__d")), "fingerprint", "left")
    moved = joined.groupBy("candidate_id").agg(F.first("confidence").alias("confidence"), F.max(F.greatest("__d", F.lit(0.0))).alias("__up"), F.min(F.least("__d", F.lit(0.0))).alias("__down"))
    total = F.col("confidence") + F.coalesce("__up", F.lit(0.0)) + F.coalesce("__down", F.lit(0.0))
    return moved.select("candidate_id", F.greatest(F.lit(0.0), F.least(F.lit(0.99), total)).alias("confidence"))


def parity_fold(runs: DataFrame, source: str, order: list[str], needed: int = 30, clean: int = 3) -> DataFrame:
    """Fold the runs of a source (passed, failed pages) in order.

    A run with a failure sends the source back to observing and ends both streaks; after
    ``needed`` passes in a row and ``clean`` clean runs it is promoted.
    """
    at = F.struct(*order)
    failed = runs.where("failed > 0").groupBy(source).agg(F.max(at).alias("__last"))
    # After the last failure both streaks only grow, so their sums decide; no run waits for another.
    after = runs.join(failed, source, "left").withColumn("__on", (F.col("failed") <= 0) & (F.col("__last").isNull() | (at > F.col("__last"))))
    zero = F.lit(0).cast("long")
    streaks = after.groupBy(source).agg(F.coalesce(F.sum(F.when(F.col("__on"), F.col("passed"))), zero).alias("streak"), F.count_if(F.col("__on") & (F.col("passed") > 0)).alias("clean_runs"))
    return streaks.withColumn("mode", F.when((F.col("streak") >= needed) & (F.col("clean_runs") >= clean), "generic_primary").otherwise("observing"))


def quality(flags: dict[str, Column], weights: dict[str, str]) -> Column:
    """Additive score in exact decimals, between 0 and 1."""
    total = sum((F.when(flags[name], F.lit(w).cast("decimal(6,2)")).otherwise(F.lit("0").cast("decimal(6,2)")) for name, w in weights.items()), F.lit("0").cast("decimal(6,2)"))
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), total.cast("double")))
