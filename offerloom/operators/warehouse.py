"""Queries of the offer warehouse: candidates, facets, run state, set comparison, lifecycle.

Names of columns are parameters where operators are used on several tables. ``as_of`` is always
a literal, never the clock, so results can be repeated.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: A merge is blocked by publications in these states; failed and skipped ones may be retried.
BLOCKING = ("pending", "published")
#: Observations behind one task that groups them by offer.
PART_ROWS = 1 << 20


def first_by(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key in the given order, all columns kept."""
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("__rank", rank).where("__rank = 1").drop("__rank")


def unpublished(offers: DataFrame, publications: DataFrame, key: str) -> DataFrame:
    """Offers without a blocking publication."""
    return offers.join(publications.where(F.col("status").isin(*BLOCKING)).select(key), key, "left_anti")


def publish_candidates(offers: DataFrame, publications: DataFrame, key: str, order: list[Column], limit: int, as_of: Column | None = None, until: str = "valid_until", strict: bool = False) -> DataFrame:
    """Ready offers without a blocking publication, the best ``limit`` (1 to 100) of them.

    Offers past ``as_of`` are left out after the limit is taken, so fewer rows may come back;
    with ``strict`` they are left out before.
    """
    found = unpublished(offers, publications, key)
    alive = F.lit(True) if as_of is None else F.col(until).isNull() | (F.col(until) >= as_of)
    if strict:
        return found.where(alive).orderBy(*order).limit(min(100, max(1, limit)))
    return found.orderBy(*order).limit(min(100, max(1, limit))).where(alive)


def status_metrics(df: DataFrame, status: str, names: dict[str, str]) -> DataFrame:
    """One row: the number of rows and of rows in each status."""
    return df.agg(F.count(F.lit(1)).alias("total"), *[F.count_if(F.col(status) == value).alias(name) for name, value in names.items()])


def facet(df: DataFrame, column: str, limit: int, most_bytes: int | None = None) -> DataFrame:
    """Distinct values that are not empty, sorted, the first ``limit``."""
    found = df.select(F.col(column).alias("value")).where(F.col("value").isNotNull() & (F.col("value") != "")).distinct().orderBy("value").limit(limit)
    return found if most_bytes is None else found.where(F.octet_length("value") <= most_bytes)


def search(df: DataFrame, text: str | None, columns: list[str], exact: dict[str, object]) -> DataFrame:
    """Rows in which any column holds the text, in any case (``%`` and ``_`` are wildcards),
    and that meet every exact filter given."""
    if text:
        df = df.where(reduce(lambda a, b: a | b, [F.col(c).ilike(f"%{text}%") for c in columns]))
    for column, value in exact.items():
        if value is not None:
            df = df.where(F.col(column) == value)
    return df


def page(df: DataFrame, order: list[Column], number: int, size: int) -> DataFrame:
    """Rows of one page; the order must end in a unique key."""
    return df.orderBy(*order).offset((number - 1) * size).limit(size)


def latest_state(runs: DataFrame, source: str, started: str, key: str, failed: Column) -> DataFrame:
    """Per source: its latest run, the latest success, and whether the latest run failed."""
    order = F.struct(F.col(started), F.col(key))
    return runs.groupBy(source).agg(
        F.max_by(key, order).alias("last_run"),
        F.max(started).alias("last_started"),
        F.max(F.when(~failed, F.col(started))).alias("last_success"),
        F.max_by(failed, order).alias("last_failed"),
    )


def stale(observations: DataFrame, successes: DataFrame, offer: str, source: str, seen: str, finished: str) -> DataFrame:
    """Offers of which every observation has a later success of the same source.

    The latest success of a source decides, so one row per source joins instead of all runs; it
    is hashed, so observations need no sort. Offers are counted in parts of about ``PART_ROWS``
    observations, so the groups that a task holds do not grow with the table; the rows of one
    offer meet in one task.
    """
    latest = successes.groupBy(source).agg(F.max(finished).alias("__latest")).hint("shuffle_hash")
    newer = F.coalesce(F.col("__latest") > F.col(seen), F.lit(False))
    parts = max(int(observations.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-observations.count() // PART_ROWS))
    joined = observations.join(latest, source, "left").select(offer, newer.alias("__newer")).repartition(parts, offer)
    return joined.groupBy(offer).agg(F.bool_and("__newer").alias("__all"), F.count(F.lit(1)).alias("observations")).where("__all").drop("__all")


def compare_sets(left: DataFrame, right: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """One row: missing and extra keys, mismatches (where the left value is not null), and
    whether the sets agree. Repeated keys on either side make the comparison unsafe."""
    a = left.groupBy(key).agg(F.count(F.lit(1)).alias("__n"), *[F.first(f).alias(f"__a_{f}") for f in fields])
    b = right.groupBy(key).agg(F.count(F.lit(1)).alias("__m"), *[F.first(f).alias(f"__b_{f}") for f in fields])
    both = a.join(b, key, "full_outer")
    differs = [F.col("__n").isNotNull() & F.col("__m").isNotNull() & F.col(f"__a_{f}").isNotNull() & ~F.col(f"__a_{f}").eqNullSafe(F.col(f"__b_{f}")) for f in fields]
    counts = both.agg(
        F.count_if(F.col("__m").isNull()).alias("missing"),
        F.count_if(F.col("__n").isNull()).alias("extra"),
        *[F.count_if(d).alias(f"mismatch_{f}") for f, d in zip(fields, differs)],
        F.count_if((F.coalesce("__n", F.lit(0)) > 1) | (F.coalesce("__m", F.lit(0)) > 1)).alias("repeated"),
    )
    agree = reduce(lambda x, y: x & y, [F.col(c) == 0 for c in counts.columns])
    return counts.withColumn("safe", agree)


def match_items(new: DataFrame, known: DataFrame, key: str, content: str) -> DataFrame:
    """How each new item meets the store: by key, else by content hash, else not at all."""
    by_key = known.groupBy(key).agg(F.min("item_id").alias("__k"))
    by_hash = known.groupBy(content).agg(F.min("item_id").alias("__h"))
    joined = new.join(by_key, key, "left").join(by_hash, content, "left")
    return joined.withColumn("matched_id", F.coalesce("__k", "__h")).withColumn("match", F.when(F.col("__k").isNotNull(), "key").when(F.col("__h").isNotNull(), "content").otherwise("new")).drop("__k", "__h")


def classify_by_rules(rows: DataFrame, rules: DataFrame, text: str, fallback: str) -> DataFrame:
    """The category of the first rule, by priority then id, whose value the text contains.

    The enabled rules travel as one array in order, so rows meet no rule in a join and any
    number of rules works.
    """
    each = F.struct((-F.col("priority")).alias("p"), F.col("id"), F.lower("match_value").alias("value"), F.col("category"))
    ordered = rules.where("enabled").agg(F.sort_array(F.collect_list(each))).scalar()
    hit = F.get(F.filter("__rules", lambda r: F.contains(F.lower(text), r["value"])), F.lit(0))
    return rows.withColumn("__rules", ordered).withColumn("category", F.coalesce(hit["category"], F.lit(fallback))).drop("__rules")


def numbered(df: DataFrame, key: str, name: str, width: int = 65_536) -> DataFrame:
    """Rows with their place (from 0) in the order of an integer key that no two rows share.

    Ranges of ``width`` keys are numbered side by side; the counts of the ranges before are
    added, so no task sees more than one range of rows.
    """
    ranged = df.withColumn("__range", F.floor(F.col(key) / width))
    counts = ranged.groupBy("__range").agg(F.count(F.lit(1)).alias("__n"))
    before = counts.withColumn("__before", F.coalesce(F.sum("__n").over(Window.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("__n")
    place = F.row_number().over(Window.partitionBy("__range").orderBy(key)) - 1
    return ranged.withColumn("__place", place).join(before, "__range").withColumn(name, F.col("__place") + F.col("__before")).drop("__range", "__place", "__before")


def overlay(base: DataFrame, state: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Configuration with the stored state over it: a stored value wins unless null or empty."""
    stored = state.select(key, *[F.col(c).alias(f"__{c}") for c in columns])
    joined = base.join(stored, key, "left")
    for c in columns:
        value = F.col(f"__{c}")
        joined = joined.withColumn(c, F.coalesce(F.when(value.cast("string") != "", value), F.col(c))).drop(f"__{c}")
    return joined


def expire(offers: DataFrame, as_of: Column, until: str = "valid_until", status: str = "status", active: tuple[str, ...] = ("new", "ready", "needs_review")) -> DataFrame:
    """Active offers past ``as_of`` become expired."""
    return offers.withColumn(status, F.when(F.col(status).isin(*active) & (F.col(until) < as_of), "expired").otherwise(F.col(status)))


def merge_overrides(offers: DataFrame, overrides: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """Apply manual overrides, which win over anything collected; null overrides clear a field."""
    map_ = overrides.groupBy(key).agg(F.map_from_entries(F.collect_list(F.struct("field_name", "value"))).alias("__o"))
    out = offers.join(map_, key, "left")
    for f in fields:
        has = F.coalesce(F.map_contains_key("__o", F.lit(f)), F.lit(False))
        out = out.withColumn(f, F.when(has, F.col("__o")[f].cast(offers.schema[f].dataType)).otherwise(F.col(f)))
    return out.drop("__o")


def upsert(stored: DataFrame, incoming: DataFrame, key: str, protected: DataFrame | None = None) -> DataFrame:
    """Next snapshot of a table: values that are not empty overwrite, blanks never do, fields
    with a manual override stay, and unknown keys are added.

    ``incoming`` must hold a key once; see :func:`first_by`.
    """
    fields = [c for c in stored.columns if c != key]
    fresh = incoming.select(key, *[(F.col(c) if c in incoming.columns else F.lit(None).cast(stored.schema[c].dataType)).alias(f"__{c}") for c in fields])
    joined = stored.join(fresh, key, "full_outer")
    if protected is not None:
        held = protected.groupBy(key).agg(F.collect_set("field_name").alias("__held"))
        joined = joined.join(held, key, "left")
    for c in fields:
        value = F.when(F.col(f"__{c}").cast("string") != "", F.col(f"__{c}"))
        new = F.coalesce(value, F.col(c))
        if protected is not None:
            new = F.when(F.coalesce(F.array_contains("__held", c), F.lit(False)), F.col(c)).otherwise(new)
        joined = joined.withColumn(c, new)
    return joined.select(*stored.columns)


def compare_and_swap(stored: DataFrame, changes: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """(next snapshot, conflicts): a change applies only if it names the current revision and
    definition. ``changes`` has expected_revision, definition_hash and payload, one per key."""
    change = changes.select(key, "expected_revision", F.col("definition_hash").alias("__d"), F.col("payload").alias("__p"))
    joined = stored.join(change, key, "left")
    fits = (F.col("expected_revision") == F.col("revision")) & (F.col("__d") == F.col("definition_hash"))
    applied = F.coalesce(fits, F.lit(False))
    after = joined.withColumn("payload", F.when(applied, F.col("__p")).otherwise(F.col("payload"))).withColumn("revision", F.col("revision") + applied.cast("int"))
    conflicts = change.join(stored.select(key, "revision", "definition_hash"), key, "left").where(~F.coalesce(fits, F.lit(False)))
    reason = F.when(F.col("revision").isNull(), "missing").when(F.col("__d") != F.col("definition_hash"), "definition_mismatch").otherwise("revision_conflict")
    return after.select(*stored.columns), conflicts.select(key, reason.alias("reason"))
