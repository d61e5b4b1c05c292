"""The source registry: seeding, repair, keywords, candidates, and pages as they are acquired."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import expressions as ex
from ..functions import fixed


def _in(x: Column, allowed: list[str], otherwise: str) -> Column:
    return F.when(x.isin(*allowed), x).otherwise(F.lit(otherwise))


def repair(sources: DataFrame) -> DataFrame:
    """Registry rows with nulls, blanks and unknown words replaced, and whether that changed one."""
    blank = lambda c: F.nullif(F.col(c), F.lit(""))
    fixed_ = {
        "key": F.coalesce(blank("key"), F.concat(F.lit("legacy-source-"), F.col("id"))),
        "name": F.coalesce(blank("name"), blank("key"), F.concat(F.lit("Источник #"), F.col("id"))),
        "platform": _in(F.col("platform"), fixed.PLATFORMS, "other"),
        "source_type": F.coalesce(blank("source_type"), F.lit("other")),
        "url": F.coalesce("url", F.lit("")),
        "collector_type": F.coalesce(blank("collector_type"), F.lit("legacy_adapter")),
        "network_policy": _in(F.col("network_policy"), fixed.NETWORK, "auto"),
        "priority": F.coalesce("priority", F.lit(50)),
        "trust_level": _in(F.col("trust_level"), fixed.TRUST, "unknown"),
        "check_interval_minutes": F.coalesce("check_interval_minutes", F.lit(120)),
        "enabled": F.coalesce("enabled", F.lit(False)),
        "status": _in(F.col("status"), fixed.SOURCE_STATUS, "unknown"),
        "failure_count": F.coalesce("failure_count", F.lit(0)),
    }
    fixed_ = {c: x for c, x in fixed_.items() if c in sources.columns}
    changed = ex.any_of([~F.col(c).eqNullSafe(x) for c, x in fixed_.items()])
    return sources.select("*", changed.alias("repaired")).withColumns(fixed_)


def seed(config: DataFrame, registry: DataFrame) -> DataFrame:
    """What seeding does to each key: inserted, kept, or retired (a mirror that lost its config)."""
    both = config.select("key", F.lit(True).alias("__c")).join(registry.select("key", "collector_type", F.lit(True).alias("__r")), "key", "full_outer")
    orphan = F.col("__c").isNull() & (F.col("collector_type") == "legacy_adapter")
    return both.select("key", F.when(F.col("__r").isNull(), "inserted").when(orphan, "retired").otherwise("kept").alias("outcome"))


def unique_slugs(new: DataFrame, taken: DataFrame, name: str) -> DataFrame:
    """New sources with a key from their name; further ones of a name get ``-2``, ``-3``."""
    stem = new.withColumn("__slug", ex.slug(F.col(name)))
    used = taken.select(F.regexp_replace("key", r"-\d+$", "").alias("__slug")).groupBy("__slug").agg(F.count(F.lit(1)).alias("__used"))
    order = Window.partitionBy("__slug").orderBy(name, *[c for c in new.columns if c != name])
    n = F.row_number().over(order) + F.coalesce("__used", F.lit(0))
    out = stem.join(used, "__slug", "left").withColumn("__n", n)
    return out.withColumn("key", F.when(F.col("__n") == 1, F.col("__slug")).otherwise(F.concat_ws("-", "__slug", "__n"))).drop("__slug", "__n", "__used")


def new_keywords(asked: DataFrame, known: DataFrame) -> DataFrame:
    """Keywords that are not there yet; a missing merchant equals a missing merchant."""
    asked = asked.withColumn("normalized_keyword", ex.normalize_keyword(F.col("keyword"))).dropDuplicates(["normalized_keyword", "kind", "merchant"])
    k = known.select(F.col("normalized_keyword").alias("__k"), F.col("kind").alias("__kind"), F.col("merchant").alias("__m"))
    same = (F.col("normalized_keyword") == F.col("__k")) & (F.col("kind") == F.col("__kind")) & F.col("merchant").eqNullSafe(F.col("__m"))
    return asked.join(k, same, "left_anti")


def merge_candidates(stored: DataFrame, found: DataFrame) -> DataFrame:
    """Candidates by platform and URL: new values that are not empty win; confidence stays within
    0 and 1; first_seen is kept and last_seen moves on."""
    key = ["platform", "url"]
    newest = found.groupBy(*key).agg(F.max_by(F.struct("name", "merchant", "confidence"), "seen_at").alias("f"), F.min("seen_at").alias("__a"), F.max("seen_at").alias("__b"))
    joined = stored.join(newest, key, "full_outer")
    value = lambda c: F.coalesce(F.nullif(F.col(f"f.{c}"), F.lit("")), F.col(c)).alias(c)
    confidence = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce("f.confidence", "confidence", F.lit(0.0))))
    return joined.select(*key, value("name"), value("merchant"), confidence.alias("confidence"), F.coalesce("status", F.lit("new")).alias("status"), F.coalesce("first_seen_at", "__a").alias("first_seen_at"), F.coalesce("__b", "last_seen_at").alias("last_seen_at"))


def channel_name(x: Column) -> Column:
    """The public channel that a reference names (``@name``, a link, or the name), else null."""
    raw = F.trim(F.coalesce(x, F.lit("")))
    link = raw.rlike("://")
    good = ex.url_host(raw).isin("t.me", "www.t.me", "telegram.me", "www.telegram.me")
    path = F.filter(F.split(F.regexp_extract(raw, r"^[^:]+://[^/?#]*([^?#]*)", 1), "/"), lambda p: p != "")
    path = F.when(F.get(path, F.lit(0)) == "s", F.slice(path, 2, 9)).otherwise(path)
    name = F.when(link, F.when(good & (F.size(path) == 1), F.get(path, F.lit(0)))).otherwise(F.regexp_replace(raw, "^@", ""))
    return F.when(name.rlike("^[A-Za-z][A-Za-z0-9_]{3,127}$") & ~F.lower(name).startswith("joinchat"), name)


def is_html(content_type: Column, body: Column) -> Column:
    kind = F.trim(F.get(F.split(F.lower(F.coalesce(content_type, F.lit(""))), ";"), F.lit(0)))
    return kind.isin("text/html", "application/xhtml+xml") | F.lower(F.substring(F.ltrim(body), 1, 128)).rlike(r"^(<!doctype html|<html|<head|<body)")


def render_reason(html: Column, visible: Column, scripts: Column) -> Column:
    """Why a page must be rendered, or null."""
    low, seen = F.lower(html), F.char_length(F.trim(F.coalesce(visible, F.lit(""))))
    asks = ex.any_of([F.contains(low, F.lit(m)) for m in fixed.JS_MESSAGES])
    return F.when(asks & (seen < 80), "javascript_required_message").when(html.rlike(fixed.JS_ROOT) & (scripts >= 2) & (seen < 80), "client_rendered_shell").when((seen == 0) & (F.char_length(F.trim(html)) < 128), "empty_html")


def acquire(pages: DataFrame) -> DataFrame:
    """Which snapshot of each page counts, and what was tried.

    ``pages``: static_ok, reason, rendered_ok, mode (never, auto, always). The static page stands
    if rendering fails.
    """
    wants = (F.col("mode") == "always") | ((F.col("mode") == "auto") & (F.col("reason").isNotNull() | ~F.col("static_ok")))
    chosen = F.when(wants & F.col("rendered_ok"), "rendered").when(F.col("static_ok"), "static")
    attempts = F.array_compact(F.array(F.struct(F.lit("http").alias("step"), F.col("static_ok").alias("ok")), F.when(wants, F.struct(F.lit("render").alias("step"), F.col("rendered_ok").alias("ok")))))
    warnings = F.array_compact(F.array(F.when(wants & ~F.col("rendered_ok"), "render_failed"), F.col("reason")))
    return pages.withColumns({"chosen": chosen, "attempts": attempts, "warnings": warnings})


def feed_items(feed: DataFrame, schema: str = "array<struct<id:bigint,date:bigint,text:string>>") -> DataFrame:
    """A JSON wall to items; times are seconds since 1970."""
    posts = feed.select("source_id", F.explode(F.from_json("payload", schema)).alias("p"))
    return posts.select("source_id", F.col("p.id").cast("string").alias("external_id"), F.col("p.text").alias("text"), F.timestamp_seconds("p.date").alias("published_at"))


def page_items(anchors: DataFrame, marker: str = "/video/", most: int = 500) -> DataFrame:
    """Links of a page that hold ``marker``, once each, the first ``most``; the last part of the
    path is the id."""
    hits = anchors.where(F.contains("href", F.lit(marker)))
    once = hits.groupBy("source_id", "href").agg(F.min_by("text", "position").alias("title"), F.min("position").alias("position"))
    ranked = once.withColumn("__n", F.row_number().over(Window.partitionBy("source_id").orderBy("position"))).where(F.col("__n") <= most)
    return ranked.select("source_id", F.element_at(F.split(F.regexp_replace("href", r"[/?#]+$", ""), "/"), -1).alias("external_id"), "href", "title")
