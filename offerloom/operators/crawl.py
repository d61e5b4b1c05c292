"""Breadth-first discovery over a table of links, and relevance of pages."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import expressions as ex
from ..functions import fixed
from ..sources.tables import settled


def discover(seeds: DataFrame, links: DataFrame, depth: int, pages: int, urls: int) -> DataFrame:
    """url, parent, depth and discovery_index of all URLs within ``depth`` steps of the seeds.

    ``seeds``: url, position; ``links``: url, target, position, nofollow. A URL counts when it
    is first seen, in the order of its page and then of its place there. Of the known URLs the
    first ``pages`` are opened and no more than ``urls`` are kept. One join per step.
    """
    first = Window.partitionBy("url").orderBy("__page", "position")
    known = seeds.groupBy("url").agg(F.min("position").alias("discovery_index")).withColumn("depth", F.lit(0)).withColumn("parent", F.lit(None).cast("string"))
    known = known.where(F.col("discovery_index") < urls)
    last = known
    for step in range(1, depth + 1):
        opened = last.where(F.col("discovery_index") < pages).select(F.col("url").alias("parent"), F.col("discovery_index").alias("__page"))
        out = links.where("NOT nofollow").select(F.col("url").alias("parent"), F.col("target").alias("url"), "position")
        found = opened.join(out, "parent").join(known.select("url"), "url", "left_anti")
        found = found.withColumn("__n", F.row_number().over(first)).where("__n = 1")
        start = known.agg(F.coalesce(F.max("discovery_index") + 1, F.lit(0))).first()[0]
        if start >= urls:
            break
        # At most ``urls`` rows are numbered, so one ordered pass is enough.
        kept = found.orderBy("__page", "position", "url").limit(urls - start)
        order = Window.partitionBy(F.lit(0)).orderBy("__page", "position", "url")
        last = kept.withColumn("discovery_index", F.row_number().over(order) - 1 + start).withColumn("depth", F.lit(step)).select("url", "discovery_index", "depth", "parent")
        known = known.unionByName(last)
    return known


def final_urls(redirects: DataFrame) -> DataFrame:
    """url and final of every redirecting URL of ``redirects`` (url, target).

    Chains are followed by doubling: each round joins the pointers with themselves, so n redirects take
    log n rounds at the most. URLs whose chain never ends have a null final.
    """
    now = settled(redirects.where("url <> target").groupBy("url").agg(F.min("target").alias("final")))
    for _ in range(now.count().bit_length() + 1):
        ahead = now.select(F.col("url").alias("final"), F.col("final").alias("__next"))
        moved = settled(now.join(ahead, "final", "left").select("url", F.coalesce("__next", "final").alias("final"), F.col("__next").isNotNull().alias("__moved")))
        now = moved.drop("__moved")
        if moved.where("__moved").isEmpty():
            return now
    endless = now.select(F.col("url").alias("final"), F.lit(True).alias("__endless"))
    return now.join(endless, "final", "left").select("url", F.when(F.col("__endless").isNull(), F.col("final")).alias("final"))


def crawl(seeds: DataFrame, links: DataFrame, redirects: DataFrame, depth: int, pages: int, urls: int) -> tuple[DataFrame, DataFrame]:
    """(found, visited) of a breadth-first crawl that follows redirects, within its limits.

    ``seeds``: url, position; ``links``: url, target, position, nofollow, by the URL where a page really
    is; ``redirects``: url, target. Found: url, parent (where the link stood), depth, discovery_index;
    visited: url, final_url, depth, discovery_index. A page is visited once, under its first URL: a URL that
    an earlier visit has ended at is neither found nor visited again. No more than ``pages`` pages are
    visited and ``urls`` URLs found; the page with one URL too many is the last. Pages whose redirects
    never end are visited and give nothing. Each step starts from written tables, so its work does not
    grow with the steps before it.
    """
    final = final_urls(redirects)
    first = seeds.groupBy("url").agg(F.min("position").alias("discovery_index"))
    level = settled(first.select("url", F.lit(None).cast("string").alias("parent"), F.lit(0).alias("depth"), "discovery_index"))
    known, ended = level.select("url"), level.select(F.col("url").alias("final_url"), F.lit(0).alias("order")).limit(0)
    found, visited, opened, have = [], [], 0, 0
    follow = links.where("NOT nofollow").select(F.col("url").alias("final_url"), F.col("target").alias("url"), "position")
    for step in range(depth + 1):
        resolved = level.join(final.withColumn("__redirects", F.lit(True)), "url", "left")
        resolved = resolved.withColumn("final_url", F.when(F.col("__redirects"), F.col("final")).otherwise(F.col("url")))
        ends = resolved.where("__redirects AND final IS NOT NULL").groupBy("final_url").agg(F.min("discovery_index").alias("order"))
        before = ended.unionByName(ends).groupBy("final_url").agg(F.min("order").alias("__before"))
        taken = before.withColumnRenamed("final_url", "url")
        fresh = resolved.join(taken, "url", "left").where("__before IS NULL OR __before > discovery_index")
        now = settled(fresh.select("url", "final_url", "depth", "discovery_index").orderBy("discovery_index").limit(max(0, pages - opened)))
        visited.append(now)
        opened += now.count()
        if step == depth:
            break
        ended = settled(ended.unionByName(now.where("final_url IS NOT NULL").groupBy("final_url").agg(F.min("discovery_index").alias("order"))).groupBy("final_url").agg(F.min("order").alias("order")))
        out = now.select("final_url", F.col("discovery_index").alias("__page")).join(follow, "final_url")
        seen = out.groupBy("url").agg(F.min(F.struct("__page", "position", F.col("final_url").alias("parent"))).alias("s"))
        seen = seen.join(known, "url", "left_anti").join(ended.withColumnRenamed("final_url", "url"), "url", "left").where("order IS NULL OR order > s.__page")
        start = known.count()
        # At most ``urls`` rows and one are numbered, so one ordered pass is enough; the one more ends the crawl.
        kept = seen.orderBy("s.__page", "s.position", "url").limit(urls - have + 1)
        place = F.row_number().over(Window.partitionBy(F.lit(0)).orderBy("s.__page", "s.position", "url"))
        rows = settled(kept.select("url", F.col("s.parent").alias("parent"), F.lit(step + 1).alias("depth"), (place - 1 + start).alias("discovery_index"), F.col("s.__page").alias("__page")))
        level = rows.where(F.col("discovery_index") < start + urls - have).drop("__page")
        found.append(level)
        if (last := rows.where(F.col("discovery_index") == start + urls - have).select("__page").first()) is not None:
            visited[-1] = now.where(F.col("discovery_index") <= last[0])
            break
        have += rows.count()
        known = settled(known.unionByName(level.select("url")))
    empty = level.limit(0)
    joined = lambda parts, none: reduce(DataFrame.unionByName, parts, none)
    return joined(found, empty), joined(visited, visited[0].limit(0))


def in_scope(url: Column, origins: Column, hosts: Column | None = None) -> Column:
    """Whether a URL has the origin of a seed, or, where ``hosts`` are given, one of those hosts."""
    own = F.array_contains(origins, ex.origin_key(url))
    return own if hosts is None else own | F.array_contains(hosts, F.regexp_replace(ex.url_host(url), r"\.+$", ""))


def page_edges(anchors: DataFrame, seeds: DataFrame, most: int = 250) -> DataFrame:
    """Links of pages as edges (url, target, position, nofollow): resolved, inside the origins of
    the seeds, no files, once each per page, the first ``most`` anchors of a page.

    ``anchors``: url, base, href, rel and position. The few origins of seeds travel as one array.
    """
    origins = seeds.select(ex.origin_key(F.col("url")).alias("o")).distinct().agg(F.collect_list("o")).scalar()
    resolved = ex.resolve_link(F.coalesce(ex.resolve_link(F.col("url"), F.col("base")), F.col("url")), F.col("href"))
    links = anchors.where(F.col("position") < most).select("url", resolved.alias("target"), "position", F.array_contains("rel", "nofollow").alias("nofollow"))
    good = links.where(F.col("target").isNotNull() & ~ex.blocked_suffix(F.col("target")) & in_scope(F.col("target"), origins))
    return good.groupBy("url", "target").agg(F.min("position").alias("position"), F.bool_and("nofollow").alias("nofollow"))


def link_score(url: Column, anchor: Column) -> Column:
    """How likely a link leads to offers, from its path, query and text; -100 rules it out."""
    parts = F.transform(F.filter(F.split(ex.url_path(url), "/"), lambda p: p != ""), lambda p: F.lower(ex.unquoted(p)))
    among = lambda words: F.size(F.array_intersect(parts, F.array(*[F.lit(w) for w in words])))
    keys = F.transform(F.filter(F.split(ex.url_query(url), "&"), lambda p: p != ""), lambda p: F.lower(ex.unquoted(F.substring_index(p, "=", 1))))
    paged = F.arrays_overlap(keys, F.array(*[F.lit(k) for k in fixed.PAGINATION_KEYS]))
    strong = among(fixed.STRONG_SEGMENTS)
    named = F.size(ex.matched_terms(plain(anchor), fixed.DISCOUNT_TERMS))
    score = (
        F.when(strong > 0, F.least(F.lit(5.0), 3.5 + 0.5 * (strong - 1))).otherwise(0.0)
        + F.when(among(fixed.MERCHANT_SEGMENTS) > 0, 1.25).otherwise(0.0)
        + F.when(among(fixed.NAVIGATION_SEGMENTS) > 0, -1.5).otherwise(0.0)
        + F.when(paged, -2.0).otherwise(0.0)
        + F.least(F.lit(2.0), 0.75 * named)
    )
    return F.when(among(fixed.NEGATIVE_SEGMENTS) > 0, -100.0).otherwise(F.round(score, 6))


def plain(x: Column) -> Column:
    return ex.collapse(F.translate(F.lower(F.coalesce(x, F.lit(""))), "ё", "е"))


def ranked(assessed: DataFrame) -> DataFrame:
    """Order of merit: targets, candidates, unprobed, the rest; then by score and discovery."""
    turn = F.array_position(F.array(*[F.lit(s) for s in ("target", "candidate", "unprobed", "non_target")]), F.col("status"))
    return assessed.orderBy(turn, F.desc("score"), "discovery_index")


def selected(assessed: DataFrame, candidates: bool = True, unprobed: bool = False, most: int = 100) -> DataFrame:
    """The best ``most`` URLs whose status is allowed."""
    allowed = ["target"] + ["candidate"] * candidates + ["unprobed"] * unprobed
    return ranked(assessed.where(F.col("status").isin(allowed))).limit(most)


def content_score(title: Column, h1: Column, meta: Column, visible: Column, terms: list[str], calls: list[str]) -> Column:
    """Terms in title, h1 and description count two each; how many different ones the text has,
    how often, and calls to action add to it; a title that says nothing takes 2.5 off."""
    has = lambda v: F.exists(F.array(*[F.lit(t) for t in terms]), lambda t: F.contains(v, t))
    named = lambda v: F.when(has(v), 2.0).otherwise(0.0)
    heading = ex.once(plain(title), lambda v: F.when(v.isin(fixed.GENERIC_PAGE_TITLES), -2.5).otherwise(0.0) + named(v))

    def body(low: Column) -> Column:
        count = lambda words: F.array(*[(F.char_length(low) - F.char_length(F.replace(low, F.lit(w)))) / len(w) for w in words])
        return ex.once(F.struct(count(terms).alias("terms"), count(calls).alias("calls")), weighed)

    def weighed(n: Column) -> Column:
        some = lambda counts: F.size(F.filter(counts, lambda k: k > 0))
        density = ex.once(F.aggregate(n["terms"], F.lit(0.0), lambda a, k: a + k), lambda v: F.when(v >= 8, 2.0).when(v >= 3, 1.0).otherwise(0.0))
        return F.least(F.lit(3.0), 0.5 * some(n["terms"])) + density + F.least(F.lit(1.5), 0.75 * some(n["calls"]))

    return heading + sum((ex.once(plain(x), named) for x in (h1, meta)), F.lit(0.0)) + ex.once(plain(visible), body)


def status(score: Column) -> Column:
    return F.when(score >= 5, "target").when(score >= 2, "candidate").otherwise("non_target")


def to_probe(assessed: DataFrame, most: int = 100) -> DataFrame:
    """The best ``most`` links by score, then by order of discovery."""
    return assessed.orderBy(F.desc("score"), "discovery_index").limit(most)
