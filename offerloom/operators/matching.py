"""The duplicate cascade for offers: URL, code and merchant, fingerprint, then fuzzy titles."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import DoubleType

THRESHOLD, BUDGET, PENALTY = 92.0, 100, 8.0


def _common(a: str, b: str) -> int:
    """Length of the longest common subsequence, bit-parallel: one integer holds a row."""
    masks: dict[str, int] = {}
    for i, c in enumerate(a):
        masks[c] = masks.get(c, 0) | 1 << i
    row = (1 << len(a)) - 1
    full = row
    for c in b:
        hit = row & masks.get(c, 0)
        row = ((row + hit) | (row - hit)) & full
    return len(a) - row.bit_count()


def ratio(a: str, b: str) -> float:
    return 200.0 * _common(a, b) / (len(a) + len(b)) if a or b else 0.0


def token_set_ratio(a: str, b: str) -> float:
    """Likeness of two token sets, 0 to 100: shared tokens count fully, the rest by likeness."""
    x, y = set(a.split()), set(b.split())
    if not x or not y:
        return 0.0
    both, left, right = (" ".join(sorted(s)) for s in (x & y, x - y, y - x))
    if both and (not left or not right):
        return 100.0
    join = lambda rest: f"{both} {rest}" if both else rest
    scores = [ratio(join(left), join(right))]
    if both:
        scores += [ratio(both, join(left)), ratio(both, join(right))]
    return max(scores)


@pandas_udf(DoubleType())
def token_set_score(pairs: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    for a, b in pairs:
        yield pd.Series([token_set_ratio(x or "", y or "") for x, y in zip(a, b)])


def cascade(new: DataFrame, stored: DataFrame) -> DataFrame:
    """Each new row with the stored offer it repeats, the reason and the score.

    Both have offer_id, canonical_url, promo_code, merchant, fingerprint, norm_merchant,
    norm_title, discount_percent and discount_amount; stored has updated_at. The first level
    that hits wins. In the fuzzy level the ``BUDGET`` newest offers of the merchant (or of
    none) are drawn first and checked for the same normalised merchant after, so each new row
    meets a bounded number of offers.
    """
    least = lambda keys, name: stored.where(" AND ".join(f"{k} IS NOT NULL AND {k} <> ''" for k in keys)).groupBy(*keys).agg(F.min("offer_id").alias(name))
    out = new.join(least(["canonical_url"], "__url"), ["canonical_url"], "left")
    out = out.join(least(["promo_code", "merchant"], "__code"), ["promo_code", "merchant"], "left")
    out = out.join(least(["fingerprint"], "__print"), ["fingerprint"], "left")
    open_ = out.where("__url IS NULL AND __code IS NULL AND __print IS NULL AND merchant IS NOT NULL AND merchant <> ''")
    fields = ["norm_merchant", "norm_title", "discount_percent", "discount_amount", "updated_at"]
    pool = stored.select(F.col("merchant").alias("__m"), F.col("offer_id").alias("__other"), *[F.col(c).alias(f"__{c}") for c in fields])
    newest = lambda *keys: F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("__updated_at"), "__other"))
    named = pool.where("__m IS NOT NULL").withColumn("__rank", newest("__m")).where(F.col("__rank") <= BUDGET).drop("__rank")
    # Offers without a merchant use up the budget of every merchant; they are BUDGET rows at most.
    nobody = pool.where("__m IS NULL").orderBy(F.desc("__updated_at"), "__other").limit(BUDGET)
    asked = open_.select(F.col("merchant").alias("__m")).distinct()
    lone = nobody.agg(F.collect_list(F.struct(*nobody.columns[1:]))).scalar()
    both = named.unionByName(asked.select("__m", F.inline(lone)))
    drawn = both.withColumn("__rank", newest("__m")).where(F.col("__rank") <= BUDGET)
    named = open_.join(drawn, F.col("merchant") == F.col("__m")).where("norm_merchant = __norm_merchant")
    apart = lambda c: F.when(F.col(c).isNotNull() & F.col(f"__{c}").isNotNull() & (F.col(c) != F.col(f"__{c}")), PENALTY).otherwise(0.0)
    scored = named.withColumn("__score", token_set_score("norm_title", "__norm_title") - apart("discount_percent") - apart("discount_amount"))
    best = scored.groupBy("offer_id").agg(F.max_by(F.struct("__other", "__score"), F.struct("__score", "__updated_at", -F.col("__other"))).alias("__best"))
    out = out.join(best, "offer_id", "left")
    fuzzy = F.col("__best.__score") >= THRESHOLD
    match = F.coalesce("__url", "__code", "__print", F.when(fuzzy, F.col("__best.__other")))
    reason = F.when(F.col("__url").isNotNull(), "canonical_url").when(F.col("__code").isNotNull(), "merchant_promo_code").when(F.col("__print").isNotNull(), "fingerprint").when(fuzzy, "fuzzy_title")
    score = F.when(F.coalesce("__url", "__code", "__print").isNotNull(), 100.0).otherwise(F.col("__best.__score"))
    return out.select("offer_id", match.alias("match_id"), reason.alias("reason"), score.alias("score"))
