"""Record slices of pages to offer fields, by precedence.

A field is an ordered array of candidates (rank, value, evidence). A rule says what it reads, when it
speaks at all, and whether it ends the search even with nothing to say; the first candidate with a
value wins. All rules are column expressions, so Catalyst plans them with the rest of the query.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import expressions as ex
from ..functions import fixed

#: Confidence of every field that a record slice gives.
CONFIDENCE = 0.98
_MARK = "\ue000"  # parts tokens from the text around them


class Rule(NamedTuple):
    """A candidate: its evidence, its value, and when it applies; a closing rule that applies is the last."""

    evidence: str
    value: Column
    when: Column | None = None
    closes: bool = False


def candidates(rules: list[Rule]) -> Column:
    """The admissible candidates of a field in order of rank."""
    open_ = F.lit(True)
    made = []
    for rank, r in enumerate(rules, 1):
        applies = open_ if r.when is None else open_ & F.coalesce(r.when, F.lit(False))
        made.append(F.struct(F.lit(rank).alias("rank"), F.when(applies, F.nullif(r.value, F.lit(""))).alias("value"), F.lit(r.evidence).alias("evidence")))
        if r.closes and r.when is not None:
            open_ = open_ & ~F.coalesce(r.when, F.lit(False))
    return F.filter(F.array(*made), lambda c: c["value"].isNotNull())


def _edges(x: Column) -> Column:
    return F.regexp_replace(x, rf"^[{fixed.EDGE_SIGNS[:-2]}\-—]+|[{fixed.EDGE_SIGNS[:-2]}\-—]+$", "")


def _says(x: Column, pattern: str) -> Column:
    return F.coalesce(x.rlike(pattern), F.lit(False))


def _unlike(x: Column, other: Column) -> Column:
    return F.lower(x) != F.lower(F.coalesce(other, F.lit("")))


def merchant_rules(c: dict[str, Column]) -> list[Rule]:
    """Eleven rules; a heading's own record closes after its patterns, a summary after itself."""
    named = lambda x, p: F.substring(_edges(F.regexp_extract(x, p, 1)), 1, 120)
    by_heading, is_summary, strong, before = c["kind"] == "heading", c["total"].isNotNull(), c["fair_strong"], c["before"]
    pictured = _says(c["action_text"], fixed.SHOWS) | F.coalesce(F.contains(c["action_href"], F.lit("offer_id=")), F.lit(False))
    first, second, third = fixed.MERCHANT_PATTERNS
    best = F.coalesce(c["heading"], c["text"])
    return [
        Rule("image_alt", c["image_alt"], pictured & (F.length(c["image_alt"]) <= 120)),
        Rule("heading_pattern", named(c["heading"], first), by_heading),
        Rule("heading_code_pattern", named(c["heading"], second), by_heading),
        Rule("no_merchant_in_heading", F.lit(None).cast("string"), by_heading, closes=True),
        Rule("text_after_from", named(c["text"], fixed.MERCHANT_AFTER_FROM), _says(c["action_text"], r"(?iuU)\bот\b")),
        Rule("strong_after_from", named(strong, fixed.MERCHANT_IN_STRONG), strong.isNotNull()),
        Rule("strong", strong, (F.length(strong) <= 120) & ~_says(strong, fixed.BENEFIT) & ~_says(strong, fixed.CODE_TOKEN) & _unlike(strong, c["action_text"])),
        Rule("heading", c["heading"], (F.length(c["heading"]) <= 120) & ~_says(c["heading"], fixed.BENEFIT) & _unlike(c["heading"], c["action_text"])),
        Rule("summary", named(c["text"], fixed.SUMMARY), is_summary, closes=True),
        Rule("pattern", F.coalesce(*[F.nullif(named(best, p), F.lit("")) for p in (first, second, third)])),
        Rule("before_benefit", before, _says(c["text"], fixed.BENEFIT) & (F.length(before) <= 120) & _unlike(before, c["heading"])),
    ]


def title_rules(c: dict[str, Column], merchant: Column) -> list[Rule]:
    starts = F.coalesce(F.lower(c["text"]).startswith(F.lower(merchant)), F.lit(False))
    rest = F.when(starts, _edges(F.substring(c["text"], F.length(merchant) + 1, F.length(c["text"])))).otherwise(c["text"])
    cut = lambda x: F.substring(x, 1, 300)
    return [
        Rule("heading", cut(c["heading"]), _says(c["heading"], fixed.BENEFIT)),
        Rule("summary", cut(F.concat(F.lit("Скидка до "), c["total"].cast("string"), F.lit("% в "), merchant)), c["total"].isNotNull()),
        Rule("text", cut(_edges(F.regexp_replace(rest, fixed.ACTION_SUFFIX, "")))),
        Rule("merchant", merchant),
        Rule("none", F.lit(fixed.NO_TITLE)),
    ]


def _inferred(token: Column) -> Column:
    """Whether a token found in text may be a code: all upper case, or with a digit, and no stop word."""
    upper = F.upper(token)
    return ~upper.isin(fixed.STOP_CODES) & upper.rlike(fixed.CODE_TOKEN) & ((token == upper) | token.rlike(r"(?U)\d"))


def _scanned(parts: Column) -> Column:
    """The first code-like token, of a text cut into what lies between tokens and the tokens; a number
    beside a currency sign is a price."""
    near = lambda k: F.concat(F.right(F.array_join(F.slice(parts, F.lit(1), k), ""), F.lit(12)), F.element_at(parts, k + 1), F.left(F.array_join(F.slice(parts, k + 2, F.size(parts)), ""), F.lit(12)))
    places = F.filter(F.sequence(F.lit(1), F.size(parts)), lambda k: (k % 2 == 1) & (k < F.size(parts)))
    tokens = F.transform(places, lambda k: F.when(F.element_at(parts, k + 1).rlike(r"(?U)^\d+$") & near(k).rlike(fixed.CURRENCY_NEAR), F.lit("")).otherwise(F.element_at(parts, k + 1)))
    return F.try_element_at(F.filter(tokens, _inferred), F.lit(1))


def code_rules(c: dict[str, Column]) -> list[Rule]:
    """Stated codes first; where the card must be opened to see its code, nothing is inferred."""
    stated = lambda key: (lambda v: F.when(~v.rlike(r"(?U)^[•*\s]+$"), F.substring(v, 1, 120)))(ex.collapse(F.try_element_at(c["data"], F.lit(key))))
    labelled = F.regexp_extract(c["tail"], fixed.CODE_AFTER_LABEL, 1)
    return [
        Rule("data-promocode", stated("data-promocode")),
        Rule("data-promo-code", stated("data-promo-code")),
        Rule("hidden", F.lit(None).cast("string"), _says(c["action_text"], fixed.REVEALS), closes=True),
        Rule("strong", c["strong"], _inferred(c["strong"])),
        Rule("labelled", labelled, _inferred(labelled)),
        Rule("scanned", _scanned(c["parts"])),
    ]


def identity_rules(c: dict[str, Column], url: Column, title: Column, merchant: Column, code: Column, percent: Column) -> list[Rule]:
    offer = F.try_url_decode(F.replace(F.regexp_extract(url, r"^[^#]*?\?(?:[^#]*&)?offer_id=([^&#]+)", 1), F.lit("+"), F.lit(" ")))
    explicit = ex.collapse(F.coalesce(F.nullif(F.try_element_at(c["data"], F.lit("data-promocode")), F.lit("")), F.try_element_at(c["data"], F.lit("data-promo-code"))))
    coupon = ex.collapse(F.try_element_at(c["data"], F.lit("data-coupon-id")))
    signal = F.coalesce(c["action_text"], c["text"])
    machine = c["kind"] == "machine"
    return [
        Rule("heading", ex.external_id(url, title, code), c["kind"] == "heading"),
        Rule("offer_id", offer),
        Rule("machine_code", ex.external_id(url, merchant, title, F.coalesce(code, explicit)), machine & explicit.isNotNull()),
        Rule("coupon_id", F.concat(c["source_key"], F.lit("-coupon:"), coupon), coupon.rlike(r"(?U)^\d+$") & c["heading"].isNull()),
        Rule("machine_heading", ex.external_id(url, title, code), machine & c["heading"].isNotNull()),
        Rule("summary", ex.external_id(url, merchant, percent.cast("string")), c["total"].isNotNull() & merchant.isNotNull() & percent.isNotNull()),
        Rule("activates", ex.external_id(url, merchant, title, code), _says(signal, fixed.ACTIVATES)),
        Rule("shows", ex.external_id(url, title), _says(signal, fixed.SHOWS)),
        Rule("opens", ex.external_id(url, merchant, title), _says(signal, fixed.OPENS)),
        Rule("code", ex.external_id(url, title, code), code.isNotNull() | (c["tag"] == "article")),
        Rule("plain", ex.external_id(url, merchant, title)),
    ]


def _joined(base: Column, link: Column) -> Column:
    """The absolute URL of a link, of whatever scheme; the page's own where there is no link."""
    absolute = F.when(link.rlike("^[A-Za-z][A-Za-z0-9+.-]*:"), link).otherwise(F.coalesce(ex.resolve_link(base, link), link))
    return F.when(link.isNull(), base).otherwise(absolute)


def offer_fields(records: DataFrame, now: Column) -> DataFrame:
    """The twelve business fields of every record slice, and which rule gave its merchant, title, code and
    identity.

    ``records`` has what :func:`offerloom.sources.html.records` gives, source_url and source_key. Records without
    text give no row. Columns of ``records`` stay under their names, but for those this adds.
    """
    names = ("text", "heading", "strong", "action_href", "action_text", "image_alt", "tag", "image", "href", "anchor_kind", "source_key")
    out = records.withColumns({f"__{n}": ex.collapse(F.col(n).cast("string")) for n in names})
    # Written as columns of their own, so that later rules refer to them and do not repeat them.
    out = out.where("__text IS NOT NULL").withColumns({
        "__kind": F.lower(F.coalesce("__anchor_kind", F.lit(""))), "__key": F.coalesce("__source_key", F.lit("generic")), "__base": F.coalesce("source_url", F.lit("")),
        "__fair_strong": F.when(~_says(F.col("__strong"), fixed.STATUS_STRONG), F.col("__strong")), "__before": _edges(F.element_at(F.split("__text", fixed.BENEFIT, 2), 1)),
        "__place": F.coalesce(F.position(F.lower("__heading"), F.lower("__text")), F.lit(0)), "__total": F.regexp_extract("__text", fixed.SUMMARY, 2).try_cast("int"),
    })
    after = F.col("__place") + F.length("__heading")
    out = out.withColumn("__tail", F.when(F.col("__place") > 0, F.substring(F.col("__text"), after, F.length("__text"))).otherwise(F.col("__text")))
    out = out.withColumn("__parts", F.split(F.regexp_replace(F.replace("__tail", F.lit(_MARK), F.lit(" ")), fixed.CODE_SCAN, f"{_MARK}$1{_MARK}"), _MARK))
    link = F.when(F.col("__kind") == "action", F.col("__action_href")).when(F.col("__kind") == "heading", F.coalesce("__action_href", "__href")).otherwise(F.col("__href"))
    out = out.withColumn("__link", link).withColumn("offer_url", _joined(F.col("__base"), F.col("__link"))).withColumn("image_url", F.when(F.col("__image").isNotNull(), _joined(F.col("__base"), F.col("__image"))))
    c = {n: F.col(f"__{n}") for n in (*names, "kind", "fair_strong", "before", "tail", "parts", "total")} | {"source_key": F.col("__key"), "data": F.col("data")}
    pick = lambda name, field: F.try_element_at(F.col(name), F.lit(1))[field]

    out = out.withColumn("merchant_candidates", candidates(merchant_rules(c))).withColumn("merchant", pick("merchant_candidates", "value"))
    out = out.withColumn("title_candidates", candidates(title_rules(c, F.col("merchant")))).withColumn("title", pick("title_candidates", "value"))
    out = out.withColumn("code_candidates", candidates(code_rules(c))).withColumn("promo_code", pick("code_candidates", "value"))
    out = out.withColumn("__percent", F.coalesce(ex.first_percent(F.col("title")), ex.first_percent(c["text"])))
    out = out.withColumn("__back", F.col("__percent").isNotNull() & F.col("title").rlike(fixed.CASHBACK_WORD))
    out = out.withColumns({
        "discount_percent": F.when(~F.col("__back"), F.col("__percent")), "cashback_percent": F.when(F.col("__back"), F.col("__percent")),
        "discount_amount": F.when(F.col("__percent").isNull(), F.coalesce(ex.first_amount(F.col("title")), ex.first_amount(c["text"]))),
        "description": F.substring(c["text"], 1, 2000), "conditions": F.when(_says(c["text"], fixed.ACTIVATES), F.substring(c["text"], 1, 2000)), "valid_until": ex.valid_until(c["text"], now),
    })
    rules = identity_rules(c, F.col("offer_url"), F.col("title"), F.col("merchant"), F.col("promo_code"), F.col("discount_percent"))
    out = out.withColumn("identity_candidates", candidates(rules)).withColumn("external_id", pick("identity_candidates", "value"))
    chosen = F.struct(*[pick(f"{n}_candidates", "evidence").alias(n) for n in ("merchant", "title", "code", "identity")])
    out = out.withColumn("evidence", chosen).withColumn("field_confidence", F.lit(CONFIDENCE))
    return out.drop(*[n for n in out.columns if n.startswith("__") and n not in records.columns])


def offers_of_pages(fields: DataFrame, page: str) -> DataFrame:
    """One row per page and identity: the record that comes first, and how many records share it."""
    rest = F.struct("ordinal", *[n for n in fields.columns if n not in (page, "external_id", "ordinal")])
    first = fields.groupBy(page, "external_id").agg(F.min_by(rest, "ordinal").alias("r"), F.count(F.lit(1)).alias("records"))
    return first.select(page, "external_id", "records", "r.*")
