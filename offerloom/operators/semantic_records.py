"""Records found by what their keys mean: an alias index joined to the keys of structured values.

Two names mean the same if they agree after compatibility normalisation and case folding, letters
and digits only. The index has one row per field and meaning; names of objects and of page signals meet it
by a join.
"""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import expressions as ex

JSONLD, ATTRIBUTES = "jsonld_records", "attribute_records"
MOST_RECORDS, LEAST_FIELDS, ALIAS_COST, ATTRIBUTE_CONFIDENCE = 200, 2, 0.02, 0.99


@F.pandas_udf(T.StringType())
def _folded(names: pd.Series) -> pd.Series:
    return names.map(lambda x: None if x is None else "".join(c for c in unicodedata.normalize("NFKC", x).casefold() if c.isalnum()))


def semantic_key(x: Column) -> Column:
    """What a name means; empty for a name without letters and digits. Spark has no such normal form,
    so this is an Arrow function."""
    return _folded(x.cast("string"))


def alias_index(fields: DataFrame) -> DataFrame:
    """field, term, meaning, alias: one row per field and meaning of ``fields`` (field, aliases array).

    The field's own name goes before its aliases, an earlier alias before a later one.
    """
    terms = F.posexplode(F.concat(F.array("field"), F.coalesce("aliases", F.array().cast("array<string>")))).alias("place", "term")
    rows = fields.select("field", terms).where("term IS NOT NULL").withColumn("meaning", semantic_key(F.col("term"))).where("meaning <> ''")
    first = rows.groupBy("field", "meaning").agg(F.min(F.struct("place", "term")).alias("t"))
    return first.select("field", F.col("t.term").alias("term"), "meaning", (F.col("t.place") > 0).alias("alias"))


def matched_signals(signals: DataFrame, fields: DataFrame) -> DataFrame:
    """``signals`` (name, confidence, ...) with each field they mean: field, term, and the confidence, which an
    alias lowers by ``ALIAS_COST``. A signal may mean several fields; one that means none goes."""
    met = signals.withColumn("meaning", semantic_key(F.col("name"))).join(alias_index(fields), "meaning")
    confidence = F.when(F.col("alias"), F.greatest(F.lit(0.0), F.col("confidence") - ALIAS_COST)).otherwise(F.col("confidence"))
    return met.withColumn("match_confidence", confidence).drop("meaning", "alias")


def matched_fields(objects: DataFrame, fields: DataFrame, id_columns: list[str]) -> DataFrame:
    """For every object (``id_columns``, keys) the fields that its keys mean, in order, without repeats."""
    keys = objects.select(*id_columns, F.explode("keys").alias("name"))
    met = keys.withColumn("meaning", semantic_key(F.col("name"))).join(alias_index(fields).select("field", "meaning"), "meaning")
    return met.groupBy(*id_columns).agg(F.sort_array(F.collect_set("field")).alias("matched_fields"))


def jsonld_records(objects: DataFrame, fields: DataFrame, key: str, least: int = LEAST_FIELDS, most: int = MOST_RECORDS) -> DataFrame:
    """Records among the JSON-LD objects of pages (see :func:`offerloom.sources.jsonld.objects`): those with
    ``least`` matching fields, or all fields if there are fewer.

    Columns: key, record_id, source_ref, ordinal, confidence, matched_fields, type, object, warning. Pages with more
    than ``most`` records keep the first ones and say so in ``warning``.
    """
    wanted = max(1, min(least, fields.select("field").distinct().count()))
    good = matched_fields(objects.where("warning IS NULL AND error IS NULL"), fields, [key, "position"])
    found = objects.join(good.where(F.size("matched_fields") >= wanted), [key, "position"])
    page = Window.partitionBy(key)
    found = found.withColumn("ordinal", F.row_number().over(page.orderBy("position")) - 1).withColumn("all", F.count(F.lit(1)).over(page))
    confidence = F.least(F.lit(0.99), F.round(F.lit(0.92) + F.lit(0.02) * F.least(F.size("matched_fields"), F.lit(3)), 2))
    return found.where(F.col("ordinal") < most).select(
        key, ex.record_id(F.col(key).cast("string"), F.lit(JSONLD), F.col("source_ref")).alias("record_id"), "source_ref", "ordinal", confidence.alias("confidence"), "matched_fields", "type", "object",
        F.when(F.col("all") > most, f"max_records:{most}").alias("warning"),
    )


def attribute_records(assets: DataFrame, key: str, attribute: str = "records", most: int = MOST_RECORDS, confidence: float = ATTRIBUTE_CONFIDENCE) -> DataFrame:
    """Each mapping of an asset's array column ``attribute`` as a record, the first ``most`` of them.

    A null array gives none; a null member is an error, told in its row.
    """
    cut = F.when(F.size(attribute) > most, f"max_records:{most}").alias("warning")
    rows = assets.where(F.col(attribute).isNotNull()).select(key, cut, F.posexplode(F.slice(attribute, 1, most)).alias("ordinal", "attributes"))
    ref = F.concat(F.lit(f"attributes.{attribute}["), F.col("ordinal").cast("string"), F.lit("]"))
    error = F.when(F.col("attributes").isNull(), F.concat(ref, F.lit(" must be a mapping")))
    return rows.select(key, ex.record_id(F.col(key).cast("string"), F.lit(ATTRIBUTES), ref).alias("record_id"), ref.alias("source_ref"), "ordinal", F.lit(confidence).alias("confidence"), "attributes", "warning", error.alias("error"))
