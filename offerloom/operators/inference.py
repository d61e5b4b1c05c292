"""Profiles inferred from repeated structure: containers of a page, then of a whole site."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .profiles import FIELDS

_FIELD_SELECTORS = ["title_selector", "promo_code_selector", "conditions_selector", "valid_until_selector", "link_selector", "image_selector"]


def _known(columns: list[str]) -> list[Column]:
    return [F.col(n) if n in columns else F.lit(None).cast("string").alias(n) for n in FIELDS]


def page_profiles(containers: DataFrame, key: str) -> DataFrame:
    """The profile that a page suggests by itself: its first container with at least two matches, two
    useful cards and a code or conditions. ``confidence`` grows with filled fields and useful cards."""
    fits = (F.col("matches") >= 2) & (F.col("useful") >= 2) & F.coalesce("promo_code_selector", "conditions_selector").isNotNull()
    filled = sum((F.col(n).isNotNull().cast("int") for n in _FIELD_SELECTORS), F.lit(0))
    confidence = F.least(F.lit(0.94), F.round(0.68 + 0.04 * filled + 0.02 * F.least("useful", F.lit(5)), 2)).alias("confidence")
    rows = containers.where(F.col("error").isNull() & fits).select(key, "rank", "score", "matches", "useful", confidence, *_known(containers.columns))
    best = rows.groupBy(key).agg(F.min(F.struct("rank", *[c for c in rows.columns if c not in (key, "rank")])).alias("b"))
    return best.select(key, "b.*")


def site_profiles(profiles: DataFrame, site: str) -> DataFrame:
    """One profile per site: the one that most of its pages suggest, then the surer one, then by name.

    ``profiles`` are those of :func:`page_profiles` with the site's column. Evidence: pages that suggest
    it, pages of the site that suggest any, and cards that it matched.
    """
    same = profiles.groupBy(site, *FIELDS).agg(F.count(F.lit(1)).alias("pages"), F.max("confidence").alias("confidence"), F.sum("matches").alias("cards"))
    order = F.struct(-F.col("pages"), -F.col("confidence"), *[F.coalesce(n, F.lit("")) for n in FIELDS])
    best = same.groupBy(site).agg(F.min_by(F.struct(*FIELDS, "pages", "confidence", "cards"), order).alias("b"), F.sum("pages").alias("suggesting"))
    return best.select(F.col(site).alias("site"), F.lit("inferred").alias("profile"), "b.*", "suggesting")


def source_confidence(items: Column, adapted: Column, with_code: Column, with_title: Column) -> Column:
    """How sure the setup of a source is, by its items and those of the preview with a code and a title."""
    return (
        F.when(items == 0, 0.0).when(adapted > 0, 0.98).when((items >= 3) & (with_code > 0), 0.9)
        .when((items >= 3) & (with_title >= 2), 0.82).when(with_title > 0, 0.68).otherwise(0.5)
    )
