"""Structuring: what an offer's text says, how sure that is, and whether it may go out unseen.

One ``select`` per step, all built-in expressions. Values that a source gives in ``meta`` win over
the offer's own fields, and those win over what the text suggests.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import expressions as ex
from ..functions import fixed


def _texts(x: Column, pattern: str) -> Column:
    return F.regexp_extract_all(x, F.lit(pattern), F.lit(1))


def _decimals(x: Column, pattern: str, kind: str = ex.MONEY) -> Column:
    """Distinct numbers in order of appearance."""
    plain = lambda v: F.replace(F.regexp_replace(v, r"(?U)[\s ]+", ""), F.lit(","), F.lit(".")).try_cast(kind)
    return F.array_distinct(F.filter(F.transform(_texts(x, pattern), plain), lambda v: v.isNotNull()))


def codes(x: Column) -> Column:
    """All codes of a text: labelled ones, then lines that are one."""
    return ex.once(ex.without_urls(x), codes_in)


def codes_in(clean: Column) -> Column:
    """All codes of a text without links."""
    labelled = F.filter(F.transform(_texts(clean, fixed.LABELLED_CODE), lambda v: F.upper(v)), lambda v: ex.is_code(v))
    own = F.transform(F.split(clean, "\n"), lambda v: F.regexp_replace(F.trim(v), r"^[•—–\-:;,.\[\](){}<>]+|[•—–\-:;,.\[\](){}<>]+$", ""))
    lines = F.filter(own, lambda v: ex.is_code(v) & (F.upper(v) == v) & v.rlike("[0-9_]"))
    return F.array_distinct(F.concat(labelled, lines))


def clean_link(x: Column) -> Column:
    cut = F.regexp_replace(F.trim(x), r"""[.,);\]}>"']+$""", "")
    return ex.once(cut, lambda v: F.when(v.rlike("^https?://") & (ex.url_host(v) != ""), v))


def external_link(text: Column, fallback: Column) -> Column:
    """The first link to a shop if the fallback leads to a social network or nowhere."""
    host = lambda v: F.regexp_replace(ex.url_host(v), r"^www\.", "")
    links = F.filter(F.transform(F.regexp_extract_all(text, F.lit(fixed.URL), F.lit(0)), clean_link), lambda v: v.isNotNull() & ~host(v).isin(*fixed.SOCIAL_HOSTS))
    return ex.once(clean_link(fallback), lambda own: F.when(own.isNotNull() & ~host(own).isin(*fixed.SOCIAL_HOSTS), own).otherwise(F.coalesce(F.get(links, F.lit(0)), own)))


def merchant_of(x: Column) -> Column:
    found = F.regexp_replace(F.regexp_replace(F.regexp_extract(x, fixed.ADVERTISER, 1), r"(?U)\s+", " "), r"^[ ,.;:\-]+|[ ,.;:\-]+$", "")
    return ex.filled(F.substring(found, 1, 255))


def meaningful(x: Column) -> Column:
    def says(text: Column) -> Column:
        generic = F.regexp_replace(F.lower(text), r"^[ .:\-—]+|[ .:\-—]+$", "").isin(*fixed.GENERIC_TITLES)
        bad = generic | text.rlike(fixed.CALL_TO_ACTION) | text.rlike(fixed.NOISE_LINE) | (ex.is_code(text) & (F.upper(text) == text)) | clean_link(text).isNotNull()
        return F.coalesce(~bad & (F.char_length(text) >= 4), F.lit(False))

    return ex.once(ex.collapse(x), says)

def benefit_label(promo: Column, percent: Column, amount: Column, cash_percent: Column, cash_amount: Column, free: Column) -> Column:
    text = lambda a, x, b: F.when(x.isNotNull(), F.concat(F.lit(a), F.when(x == 0, "0").otherwise(ex.decimal_text(x)), F.lit(b)))
    return F.coalesce(
        text("Скидка ", percent, "%"), text("Скидка ", amount, " ₽"), text("Кэшбэк ", cash_percent, "%"), text("Кэшбэк ", cash_amount, " ₽"),
        F.when(free, "Бесплатная доставка"), F.when(promo.isNotNull(), F.concat(F.lit("Промокод "), promo)),
    )


def title_of(x: Column, fallback: Column) -> Column:
    """(title, cut): the first line with an offer word, else the first line that says something."""
    lines = F.filter(F.transform(F.split(F.coalesce(x, F.lit("")), "\n"), lambda v: F.regexp_replace(F.regexp_replace(v, r"(?U)\s+", " "), r"^[ •\t]+|[ •\t]+$", "")), lambda v: meaningful(v) & ~F.lower(v).startswith("рекламодатель"))
    whole = ex.once(lines, lambda ls: F.coalesce(F.get(F.filter(ls, lambda v: v.rlike(fixed.OFFER_WORD)), F.lit(0)), F.get(ls, F.lit(0)), fallback))

    def short(text: Column) -> Column:
        head = F.substring(text, 1, 240)
        word = F.when(F.contains(head, F.lit(" ")), F.regexp_extract(head, r"(?s)^(.*) ", 1)).otherwise(head)
        sentence = F.trim(F.get(F.split(text, r"(?<=[.!?;])\s+", 2), F.lit(0)))
        return ex.once(sentence, lambda v: F.when(F.char_length(v).between(4, 240), v).otherwise(F.concat(F.regexp_replace(word, r"[ ,.;:\-]+$", ""), F.lit("…"))))

    def cut(text: Column) -> Column:
        long_ = F.coalesce(F.char_length(text) > 240, F.lit(False))
        return F.struct(F.when(long_, short(text)).otherwise(text).alias("title"), long_.alias("cut"))

    return ex.once(whole, cut)


MONEY_FIELDS = ("discount_percent", "discount_amount", "cashback_percent", "cashback_amount", "old_price", "new_price", "delivery_price")


def structure(offers: DataFrame, now: Column) -> DataFrame:
    """Offers with their structured fields, issues, confidence, accepted and auto_ready.

    ``offers``: offer_id, title, description, source_url, merchant, promo_code, conditions and
    meta (map of strings; ``structured_fields`` set where a source gave fields).
    """
    meta = lambda k: F.nullif(F.col("meta")[k], F.lit(""))
    money = lambda k: ex.decimal_or_none(F.replace(meta(k), F.lit(" ")))
    df = offers.withColumn("__text", F.concat_ws("\n", F.nullif(F.col("title"), F.lit("")), F.nullif(F.col("description"), F.lit(""))))
    df = df.withColumn("__clean", ex.without_urls(F.col("__text"))).withColumn("__given", F.coalesce(meta("structured_fields"), F.lit("")) != "")
    clean = F.col("__clean")
    df = df.withColumns(
        {
            "__codes": codes_in(clean),
            "__said": ex.collapse(F.coalesce(meta("promo_code"), F.col("promo_code"))),
            "__percents": _decimals(clean, fixed.ANY_PERCENT),
            "__cash": _decimals(clean, fixed.CASHBACK_PERCENT),
            "__prices": ex.prices(clean),
            "__marker": clean.rlike(fixed.OFFER_WORD),
            "__preferred": F.coalesce(ex.collapse(meta("title")), ex.collapse(F.col("title"))),
            "__free": clean.rlike(fixed.FREE_DELIVERY),
            "__conditions": ex.conditions(F.col("__text"), F.coalesce(meta("conditions"), F.col("conditions"))),
        }
    )
    first = lambda a: F.get(a, F.lit(0))
    prices, pair = F.col("__prices"), (F.size("__prices") == 2) & (F.get("__prices", F.lit(0)) > F.get("__prices", F.lit(1)))
    no_price = money("old_price").isNull() & money("new_price").isNull()
    said = F.upper(F.col("__said"))
    df = df.withColumns(
        {
            "promo_code": F.coalesce(F.when(ex.is_code(said), said), first(F.col("__codes"))),
            "discount_percent": F.coalesce(money("discount_percent"), first(F.array_except("__percents", "__cash"))),
            "cashback_percent": F.coalesce(money("cashback_percent"), first(F.col("__cash"))),
            "discount_amount": F.coalesce(money("discount_amount"), first(_decimals(clean, fixed.DISCOUNT_AMOUNT))),
            "cashback_amount": F.coalesce(money("cashback_amount"), first(_decimals(clean, fixed.CASHBACK_AMOUNT))),
            "old_price": F.coalesce(money("old_price"), F.when(no_price & pair, first(prices))),
            "new_price": F.coalesce(money("new_price"), F.when(no_price & pair, F.get(prices, F.lit(1)))),
            "delivery_price": F.coalesce(money("delivery_price"), F.when(F.col("__free"), F.lit(0).cast(ex.MONEY))),
            "merchant": F.coalesce(ex.collapse(meta("merchant")), ex.collapse(F.col("merchant")), merchant_of(F.col("__text"))),
            "conditions": F.col("__conditions.conditions"),
            "max_discount_amount": F.col("__conditions.max_discount_amount"),
            "min_order_amount": F.col("__conditions.min_order_amount"),
            "source_url": F.coalesce(clean_link(meta("offer_url")), external_link(F.coalesce("description", F.lit("")), F.col("source_url")), F.col("source_url")),
            "valid_until": ex.valid_until(F.coalesce(meta("valid_until"), F.col("__text")), now),
        }
    )
    benefit = ex.any_of([F.col(c).isNotNull() for c in ("promo_code", *MONEY_FIELDS)])
    marker, preferred = F.col("__marker"), F.col("__preferred")
    label = benefit_label(*[F.col(c) for c in ("promo_code", "discount_percent", "discount_amount", "cashback_percent", "cashback_amount", "__free")])
    preferred = F.when(meaningful(preferred) & (F.char_length(preferred) <= 240), preferred)
    fallback = F.nullif(F.concat_ws(" — ", label, F.col("merchant")), F.lit(""))
    df = df.withColumn("__derived", title_of(F.coalesce("description", "title"), fallback)).withColumn("title", F.coalesce(preferred, F.col("__derived.title"))).withColumn("__sound", meaningful(F.col("title")))
    loose = ~F.col("__given")
    many = lambda p, n: F.regexp_count(clean, F.lit(p)) >= n
    issue = {
        "invalid_structured_promo": F.col("__said").isNotNull() & ~F.coalesce(ex.is_code(said), F.lit(False)),
        "multiple_promo_codes": loose & (F.size("__codes") > 1),
        "multiple_discount_percentages": loose & (F.size("__percents") > 2),
        "multiple_prices": loose & (F.size(F.array_distinct(prices)) > 2),
        "title_truncated": F.col("__derived.cut"),
        "invalid_title": ~F.col("__sound"),
        "multiple_offer_markers": loose & many(fixed.OFFER_MARKER, 3),
        "multiple_validity_markers": loose & many(fixed.VALIDITY_MARKER, 3) & (F.char_length("__text") > 300),
        "benefit_needs_review": ~benefit & marker,
    }
    df = df.withColumn("issues", F.array_compact(F.array(*[F.when(c, F.lit(name)) for name, c in issue.items()]))).withColumn("__benefit", benefit)
    severe = F.arrays_overlap("issues", F.array(*[F.lit(x) for x in ("multiple_promo_codes", "multiple_offer_markers", "invalid_title")]))
    df = df.withColumn("accepted", (benefit | marker) & ~severe)
    has = lambda c: F.coalesce(F.col(c), F.lit("")) != ""
    part = lambda c, w: F.when(c, F.lit(w)).otherwise(F.lit("0")).cast("decimal(6,2)")
    score = (
        F.lit("0.15").cast("decimal(6,2)") + part(F.col("__sound"), "0.25") + part(F.col("__benefit"), "0.25") + part(has("merchant"), "0.10") + part(has("conditions"), "0.10")
        + part(has("source_url"), "0.08") + part(F.col("__given"), "0.12") - part(F.exists("issues", lambda i: i.startswith("multiple_")), "0.25") - part(F.array_contains("issues", "title_truncated"), "0.05")
    )
    df = df.withColumn("confidence", F.greatest(F.lit(0.0), F.least(F.lit(1.0), score.cast("double"))))
    blocked = F.arrays_overlap("issues", F.array(*[F.lit(x) for x in fixed.BLOCKING]))
    df = df.withColumn("auto_ready", F.col("accepted") & F.col("__benefit") & ~blocked & (F.col("confidence") >= fixed.AUTO_READY))
    return df.withColumn("title", F.coalesce("title", F.lit("Предложение требует проверки"))).drop(*[c for c in df.columns if c.startswith("__")])


def signal(x: Column, keywords: list[tuple[str, str]] = fixed.KEYWORDS) -> Column:
    """Does a text announce an offer? Keywords, a code, a percentage and a falling price add up;
    four points make an offer. Links are no evidence."""
    return ex.once(ex.without_urls(F.coalesce(x, F.lit(""))), lambda clean: _signal_in(clean, keywords))


def _signal_in(clean: Column, keywords: list[tuple[str, str]]) -> Column:
    said = F.when(F.contains(clean, F.lit("%")), ex.filled(F.regexp_extract(clean, fixed.SIGNAL_PERCENT, 1)))
    percent = ex.once(F.replace(said, F.lit(","), F.lit(".")).try_cast(ex.PERCENT), lambda v: F.when((v > 0) & (v <= 100), v))
    prices = F.transform(_texts(clean, fixed.SIGNAL_PRICE), lambda v: F.regexp_replace(v, r"(?U)[\s ]+", "").try_cast(ex.MONEY))
    hits = lambda low: F.array(*[F.contains(low, F.lit(word)) for word, _ in keywords])

    def kind(low: Column, code: Column) -> Column:
        has = lambda w: F.contains(low, F.lit(w))
        return F.when(code.isNotNull(), "promo").when(has("кэшбэк") | has("cashback"), "cashback").when(has("достав") & (has("бесплат") | F.contains(clean, F.lit("0 ₽"))), "delivery").otherwise("discount")

    def named(low: Column) -> Column:
        return ex.once(ex.code_in(clean), lambda code: F.struct(hits(low).alias("hits"), code.alias("code"), kind(low, code).alias("kind")))

    def scored(r: Column) -> Column:
        n, code, percent, old, new = r["named"], r["named"]["code"], r["percent"], F.get(r["prices"], F.lit(0)), F.get(r["prices"], F.lit(1))
        points = sum((F.when(n["hits"][k], F.lit(fixed.KEYWORD_SCORE[sort])).otherwise(F.lit(0)) for k, (_, sort) in enumerate(keywords)), F.lit(0))
        points = points + F.when(code.isNotNull(), 4).otherwise(0) + F.when(percent.isNotNull(), 3).otherwise(0) + F.when(old > new, 3).otherwise(0)
        matched = F.array_compact(F.array(*[F.when(n["hits"][k], F.lit(word)) for k, (word, _) in enumerate(keywords)]))
        return ex.once(F.greatest(F.lit(0), points), lambda score: F.struct((score >= 4).alias("is_offer"), score.alias("score"), n["kind"].alias("offer_type"), matched.alias("matched"), code.alias("promo_code"), percent.alias("discount_percent"), old.alias("old_price"), new.alias("new_price")))

    return ex.once(F.struct(ex.once(ex.normalize_keyword(clean), named).alias("named"), percent.alias("percent"), prices.alias("prices")), scored)

def disposition(structured: DataFrame) -> DataFrame:
    """processed, needs_review (several codes or an open issue) or ignored."""
    several = F.array_contains("issues", "multiple_promo_codes")
    return structured.withColumn("disposition", F.when(several, "needs_review").when(~F.col("accepted"), "ignored").when(F.col("auto_ready"), "processed").otherwise("needs_review"))
