"""Corrections from edited tables: wide rows become typed cells, changed cells become overrides."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import fixed

_AMOUNT = "decimal(18,4)"


def typed_cell(field: str, cell: Column) -> tuple[Column, Column]:
    """(value as text, error) of a cell; a blank is null and no error. Amounts may have spaces and a comma,
    dates are ISO or dd.mm.yyyy, a scope is one of four, a URL starts with http."""
    text = F.nullif(F.regexp_replace(cell, r"(?U)^\s+|\s+$", ""), F.lit(""))
    bad = lambda value, why: (value, F.when(text.isNotNull() & value.isNull(), F.lit(why)))
    if field in fixed.AMOUNT_FIELDS:
        return bad(F.replace(F.replace(text, F.lit(" ")), F.lit(","), F.lit(".")).try_cast(_AMOUNT).cast("string"), "invalid number")
    if field == "valid_until":
        day, month, year = (F.regexp_extract(text, r"^(\d{1,2})\.(\d{1,2})\.(\d{4})$", k).try_cast("int") for k in (1, 2, 3))
        iso = F.when(text.rlike(r"^\d{4}-\d{2}-\d{2}"), F.try_to_timestamp(text))
        return bad(F.coalesce(iso, F.try_make_timestamp(year, month, day, F.lit(0), F.lit(0), F.lit(0))).cast("string"), "invalid date")
    if field == "geo_scope":
        return bad(F.when(text.isin(fixed.SCOPES), text), "invalid geo_scope")
    if field == "canonical_url":
        return bad(F.when(text.startswith("http://") | text.startswith("https://"), text), "URL must start with http:// or https://")
    return text, F.lit(None).cast("string")


def change_cells(corrections: DataFrame, offers: DataFrame, blanks: bool = True) -> DataFrame:
    """One row per cell of an editable column: sheet, row, offer_id, field_name, cell, value, outcome, error.

    ``corrections`` has sheet, row, id as text and any of the editable columns; rows without an id are left
    out. Outcomes: changed, same, bad_cell, and for whole rows (field_name null) invalid_id and
    unknown_offer. Without ``blanks`` an empty cell changes nothing; with it, it clears the field.
    """
    fields = [f for f in fixed.EDITABLE if f in corrections.columns and f in offers.columns]
    number = F.col("id").cast("string").try_cast("double")
    rows = corrections.where("id IS NOT NULL AND trim(CAST(id AS STRING)) <> ''").withColumn("offer_id", F.when(F.abs(number) < 2.0**53, number.cast("long")))
    stored = {f: (F.col(f).cast(_AMOUNT) if f in fixed.AMOUNT_FIELDS else F.col(f).cast("timestamp") if f == "valid_until" else F.col(f)).cast("string") for f in fields}
    known = offers.select("offer_id", F.map_from_arrays(F.array(*[F.lit(f) for f in fields]), F.array(*[stored[f] for f in fields])).alias("__stored"))
    cells = [typed_cell(f, F.col(f).cast("string")) for f in fields]
    every = F.array(*[F.struct(F.lit(f).alias("field_name"), F.col(f).cast("string").alias("cell"), v.alias("value"), e.alias("error")) for f, (v, e) in zip(fields, cells)])
    joined = rows.select("sheet", "row", "id", "offer_id", every.alias("__cells")).join(known, "offer_id", "left")
    whole = F.when(F.col("offer_id").isNull(), "invalid_id").when(F.col("__stored").isNull(), "unknown_offer")
    nothing = F.array(F.struct(*[F.lit(None).cast("string").alias(n) for n in ("field_name", "cell", "value", "error")]))
    out = joined.withColumn("__row", whole).select("sheet", "row", "offer_id", "__row", "__stored", F.inline(F.when(whole.isNull(), F.col("__cells")).otherwise(nothing)))
    skipped = F.lit(not blanks) & F.col("value").isNull()
    same = F.col("value").eqNullSafe(F.col("__stored")[F.col("field_name")]) | skipped
    outcome = F.coalesce(F.col("__row"), F.when(F.col("error").isNotNull(), "bad_cell").when(same, "same").otherwise("changed"))
    return out.withColumn("outcome", outcome).drop("__row", "__stored")


def corrected_offers(offers: DataFrame, cells: DataFrame) -> DataFrame:
    """Next snapshot of the offers: changed cells are set, the last row of an offer wins, and an offer
    under review that now has a category and a benefit is ready."""
    changed = cells.where("outcome = 'changed'")
    last = changed.groupBy("offer_id", "field_name").agg(F.max_by("value", F.struct("sheet", "row")).alias("value"))
    sets = last.groupBy("offer_id").agg(F.map_from_entries(F.collect_list(F.struct("field_name", "value"))).alias("__set"))  # one entry per column
    out = offers.join(sets, "offer_id", "left")
    for f in [f for f in fixed.EDITABLE if f in offers.columns]:
        out = out.withColumn(f, F.when(F.map_contains_key("__set", F.lit(f)), F.col("__set")[f].cast(offers.schema[f].dataType)).otherwise(F.col(f)))
    benefit = F.coalesce(*[F.col(f).cast("string") for f in fixed.BENEFIT_FIELDS if f in offers.columns], F.nullif(F.col("promo_code"), F.lit(""))).isNotNull()
    ready = F.col("__set").isNotNull() & (F.col("status") == "needs_review") & (F.coalesce(F.col("category"), F.lit("")) != "") & (F.col("category") != fixed.OTHER_CATEGORY) & benefit
    return out.withColumn("status", F.when(ready, "ready").otherwise(F.col("status"))).select(*offers.columns)


def title_rules(corrected: DataFrame, cells: DataFrame, rules: DataFrame) -> DataFrame:
    """New rules that file later offers with the same title alike: for offers whose category changed, with a
    category and a title of six letters or more, unless an enabled rule says the same."""
    named = cells.where("outcome = 'changed' AND field_name IN ('category', 'subcategory')").select("offer_id").distinct()
    fits = (F.coalesce(F.col("category"), F.lit("")) != "") & (F.length(F.trim("title")) >= 6)
    new = corrected.join(named, "offer_id", "left_semi").where(fits).select(F.lit("title").alias("match_key"), F.col("title").alias("match_value"), "category", "subcategory").distinct()
    have = rules.where("enabled AND match_key = 'title'").select("match_value", "category", "subcategory")
    met = [new[c].eqNullSafe(have[c]) for c in ("match_value", "category", "subcategory")]
    return new.join(have, met, "left_anti").select("*", F.lit("manual").alias("source"), F.lit(fixed.TITLE_RULE_PRIORITY).alias("priority"), F.lit(True).alias("enabled"))
