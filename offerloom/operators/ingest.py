"""Raw offers into the store: normalised fields, the offer each row belongs to, its status, and the
next snapshots of offers and observations.

A batch is taken as a whole. Rows meet the store by source and external id, then by the duplicate
cascade, and what is new meets the rest of its batch by URL, by code and merchant and by
fingerprint. Everything is a join or a grouping on those keys; no row is handled on its own.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import expressions as ex
from .matching import cascade

AMOUNTS = ("discount_percent", "discount_amount", "cashback_percent", "cashback_amount", "delivery_price")
OPEN = ("new", "ready", "needs_review")
OBSERVED = ["source_id", "external_id"]


def filled(x: Column) -> Column:
    """Neither null nor empty."""
    return F.coalesce(x.cast("string") != "", F.lit(False))


def normalize_offers(raw: DataFrame) -> DataFrame:
    """Raw rows with their fields normalised, the offer type, the fingerprint and the keys of the cascade.

    ``raw``: title, description, merchant, brand, promo_code, source_url, old_price, new_price and the
    ``AMOUNTS`` as text or numbers; null where a source names none. A stated percentage of nothing or
    zero gives way to the one that the prices make. Other columns stay as they are.
    """
    number = lambda c, kind=ex.MONEY: ex.decimal_or_none(F.col(c).cast("string"), kind)
    df = raw.withColumns({c: number(c) for c in ("old_price", "new_price", *AMOUNTS) if c != "discount_percent"})
    stated = number("discount_percent", ex.PERCENT)
    df = df.withColumns(
        {
            "discount_percent": F.coalesce(F.when(stated != 0, stated), ex.discount_percent(F.col("old_price"), F.col("new_price"))),
            "merchant": ex.collapse(F.col("merchant")),
            "brand": ex.collapse(F.col("brand")),
            "title": F.coalesce(ex.collapse(F.col("title")), F.lit("")),
            "promo_code": F.nullif(F.upper(F.trim("promo_code")), F.lit("")),
            "canonical_url": ex.canonical_url(F.col("source_url")),
        }
    )
    said = F.concat_ws(" ", "title", "description")
    cash = F.coalesce("cashback_percent", "cashback_amount")
    return df.withColumns(
        {
            "offer_type": ex.offer_type(said, F.col("promo_code"), cash, F.col("delivery_price")),
            "fingerprint": ex.fingerprint(F.col("merchant"), F.col("title"), F.col("promo_code"), [F.col(c) for c in AMOUNTS]),
            "norm_merchant": ex.normalize_text(F.col("merchant")),
            "norm_title": ex.normalize_text(F.col("title")),
        }
    )


def has_benefit() -> Column:
    """Any amount, a code, or a title that says free of charge."""
    return ex.any_of([F.col(c).isNotNull() for c in AMOUNTS]) | filled(F.col("promo_code")) | F.contains(F.lower("title"), F.lit("бесплат"))


def _within(rows: DataFrame) -> DataFrame:
    """row_no and lead: the first row of the batch that each row of it repeats.

    A row follows the earliest row with its URL, else with its code and merchant, else with its
    fingerprint; the row it follows may follow another, so steps are doubled until none moves.
    """
    out = rows
    for name, keys in {"__u": ["canonical_url"], "__c": ["promo_code", "merchant"], "__f": ["fingerprint"]}.items():
        firsts = rows.where(reduce(lambda a, b: a & b, [filled(F.col(k)) for k in keys])).groupBy(*keys).agg(F.min("row_no").alias(name))
        out = out.join(firsts, keys, "left")
    earlier = [F.when(F.col(c) < F.col("row_no"), F.col(c)) for c in ("__u", "__c", "__f")]
    links = _settled(out.select("row_no", F.coalesce(*earlier, F.col("row_no")).alias("lead")))
    while True:
        onward = links.select(F.col("row_no").alias("lead"), F.col("lead").alias("__next"))
        moved = _settled(links.join(onward, "lead").select("row_no", F.col("__next").alias("lead"), (F.col("lead") != F.col("__next")).alias("__moved")))
        links = moved.drop("__moved")
        if moved.where("__moved").isEmpty():
            return links


def _settled(df: DataFrame) -> DataFrame:
    """Lineage cut in the folder that the cluster shares; one in the warehouse where none is named."""
    spark = df.sparkSession
    if not spark.conf.get("spark.checkpoint.dir", None):
        spark.sparkContext.setCheckpointDir(f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/_checkpoints")
    return df.checkpoint()


def assign(rows: DataFrame, offers: DataFrame, observations: DataFrame) -> DataFrame:
    """row_no, offer_id, outcome, reason and score of each row of a batch.

    ``rows``: rows of :func:`normalize_offers` with row_no (distinct, in order of arrival), source_id
    and external_id. ``offers`` and ``observations`` (source_id, external_id, offer_id) are the store.
    An observed row is ``updated``; a row that the cascade finds is a ``duplicate``; of the rest the
    first of its kind is ``created`` under the number after the store's last, and later ones repeat
    it (``updated`` from the same source and external id, else ``duplicate``). Fuzzy titles are
    compared with the store, not within a batch. A null external id is never observed.
    """
    seen = observations.where("source_id IS NOT NULL AND external_id IS NOT NULL").groupBy(*OBSERVED).agg(F.min("offer_id").alias("__seen"))
    rows = rows.join(seen, OBSERVED, "left")
    fresh = rows.where("__seen IS NULL")
    # A batch that holds a source's row twice has one offer for both.
    first = fresh.where("source_id IS NOT NULL AND external_id IS NOT NULL").groupBy(*OBSERVED).agg(F.min("row_no").alias("__first"))
    fresh = fresh.join(first, OBSERVED, "left").withColumn("__again", F.coalesce(F.col("__first") < F.col("row_no"), F.lit(False)))
    once = fresh.where("NOT __again")
    keys = ["canonical_url", "promo_code", "merchant", "fingerprint", "norm_merchant", "norm_title", "discount_percent", "discount_amount"]
    met = _settled(cascade(once.select(F.col("row_no").alias("offer_id"), *keys), offers).withColumnRenamed("offer_id", "row_no"))
    open_ = once.join(met.where("match_id IS NULL").select("row_no"), "row_no")
    links = _within(open_.select("row_no", *keys[:4]))
    last = offers.agg(F.coalesce(F.max("offer_id"), F.lit(0)).cast("long")).scalar()
    # New offers are numbered by their first row, which leaves gaps but needs no total order.
    base = rows.agg(F.min("row_no")).scalar()
    created = links.select("row_no", (last + 1 + F.col("lead") - base).alias("__new"), (F.col("lead") == F.col("row_no")).alias("__lead"))
    found = met.join(created, "row_no", "left").select(
        "row_no", F.coalesce("match_id", "__new").cast("long").alias("offer_id"), F.when(F.col("__lead"), "created").otherwise("duplicate").alias("outcome"), F.coalesce("reason", F.when(~F.col("__lead"), "batch"), F.lit("new")).alias("reason"), "score"
    )
    again = fresh.where("__again").select("row_no", F.col("__first")).join(found.select(F.col("row_no").alias("__first"), "offer_id"), "__first")
    updated = lambda df, offer: df.select("row_no", F.col(offer).cast("long").alias("offer_id"), F.lit("updated").alias("outcome"), F.lit("source_external_id").alias("reason"), F.lit(100.0).alias("score"))
    return found.unionByName(updated(again, "offer_id")).unionByName(updated(rows.where("__seen IS NOT NULL"), "__seen"))


def next_status(rows: DataFrame, offers: DataFrame) -> DataFrame:
    """offer_id and status after a batch, one row per offer that it touches.

    ``rows``: row_no, offer_id, benefit, classified and auto_ready. A row with a benefit and a rule's
    category makes an offer ready; one that is not sure enough sends it back to review. The last
    row that says either decides. Offers that an operator has published, rejected or let expire keep
    their status.
    """
    says = F.when(~F.col("auto_ready"), "needs_review").when(F.col("benefit") & F.col("classified"), "ready")
    last = rows.groupBy("offer_id").agg(F.max_by(says, F.when(says.isNotNull(), F.col("row_no"))).alias("__says"))
    old = last.join(offers.select("offer_id", F.col("status").alias("__old")), "offer_id", "left")
    keeps = ~F.coalesce(F.col("__old").isin(*OPEN), F.lit(True))
    return old.select("offer_id", F.when(keeps, F.col("__old")).otherwise(F.coalesce("__says", "__old", F.lit("needs_review"))).alias("status"))


def latest_values(rows: DataFrame, fields: list[str]) -> DataFrame:
    """Per offer and field the last value of a batch that is neither null nor empty."""
    return rows.groupBy("offer_id").agg(*[F.max_by(c, F.when(filled(F.col(c)), F.col("row_no"))).alias(c) for c in fields])


def next_observations(rows: DataFrame, observations: DataFrame, now: Column) -> DataFrame:
    """The next snapshot of observations: the last row of each source and external id replaces
    what is stored, under the offer it was assigned to."""
    fields = ["offer_id", "source_url", "raw_title", "observed_at"]
    named = rows.where("source_id IS NOT NULL AND external_id IS NOT NULL")
    last = named.groupBy(*OBSERVED).agg(F.max_by(F.struct("offer_id", "source_url", F.col("title").alias("raw_title")), "row_no").alias("__r"))
    new = last.select(*OBSERVED, "__r.offer_id", "__r.source_url", "__r.raw_title", now.alias("observed_at"))
    kept = observations.select(*OBSERVED, *fields).join(new.select(*OBSERVED), OBSERVED, "left_anti")
    return kept.unionByName(new)
