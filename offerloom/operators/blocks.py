"""Offers from a page's run of texts: a code, its description, and what is said about it.

Every text of a page becomes one letter by the rules below, and the page a word of such letters; a
regular expression over that word is the automaton that finds the blocks, in one pass.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import expressions as ex
from ..functions import fixed
from ..sources import selectors as css
from ..sources.html import explode_pages

#: Letters, the first that fits: a stop, a code before a description, a call to act, an end date, other text.
STOP, CODE, ACTION, UNTIL, OTHER = "sbadx"
#: A code and its description, then other lines up to an end date, or as many as a block may have.
BLOCK = f"{CODE}.(?:{OTHER}{{0,{fixed.BLOCK_LINES - 2}}}{UNTIL}|{OTHER}{{0,{fixed.BLOCK_LINES - 1}}})"


def texts_of(asset: str, html: str) -> list[dict]:
    """The texts of a page in order, white space collapsed, and its name: the first h1 or h2 of moderate
    length, or one of the first texts that is no call."""
    tree = css.Tree(html)
    texts = [" ".join(s.split()) for s, owner in tree.strings if tree.tag[owner] not in css.SILENT]
    heads = [tree.text(i) for tag in ("h1", "h2") for i in [next((k for k in range(1, len(tree.tag)) if tree.tag[k] == tag), None)] if i is not None]
    named = [" ".join(h.split()) for h in heads if h and len(h) <= 255]
    plain = [t for t in texts[:8] if not t.casefold().startswith(("активировать", "промокод")) and len(t) <= 120]
    return [{"texts": texts, "merchant": next(iter(named or plain), None)}]


def page_texts(pages: DataFrame, key: str) -> DataFrame:
    return explode_pages(pages, key, texts_of, "texts array<string>, merchant string")


def letters(texts: Column, now: Column) -> Column:
    """One letter for each text."""
    low = lambda t: F.lower(F.coalesce(t, F.lit("")))
    stops = lambda t: ex.any_of([F.regexp_replace(low(t), "^[ :]+", "").startswith(p) for p in fixed.BLOCK_STOPS])
    described = lambda t: F.coalesce(t, F.lit("")).rlike(fixed.BLOCK_DESCRIPTION)
    code = lambda t, i: t.rlike(fixed.BLOCK_CODE) & ~low(t).isin(fixed.BLOCK_NO_CODES) & described(F.get(texts, i + 1))
    until = lambda t: low(t).startswith(fixed.BLOCK_UNTIL) & ex.valid_until(t, now).isNotNull()
    return F.array_join(F.transform(texts, lambda t, i: F.when(stops(t), STOP).when(code(t, i), CODE).when(low(t).startswith(fixed.BLOCK_ACTION), ACTION).when(until(t), UNTIL).otherwise(OTHER)), "")


def block_offers(texts: DataFrame, key: str, source_url: Column, now: Column) -> DataFrame:
    """One row per block: key, position, promo_code, title, description, conditions, the amounts, valid_until,
    and an id of the URL, code and text. Of blocks with one code and text the first stays; blocks after a stop
    are not read; pages without blocks give nothing."""
    word = F.substring_index(letters(F.col("texts"), now), STOP, 1)
    cut = texts.withColumn("__url", source_url).withColumn("__parts", F.split(F.regexp_replace(word, f"({BLOCK})", "|$1|"), "[|]"))
    # Every second part is a block; the lengths before it say where its texts are.
    places = F.filter(F.sequence(F.lit(1), F.size("__parts")), lambda k: k % 2 == 0)
    block = lambda k: F.struct((F.length(F.array_join(F.slice("__parts", F.lit(1), k - 1), "")) + 1).alias("start"), F.length(F.element_at("__parts", k)).alias("size"))
    rows = cut.select(key, "merchant", "__url", "texts", F.explode(F.transform(places, block)).alias("b"))
    rows = rows.select(key, "merchant", "__url", F.col("b.start").alias("position"), F.element_at("texts", F.col("b.start")).alias("promo_code"), F.slice("texts", F.col("b.start") + 1, F.col("b.size") - 1).alias("lines"))
    rows = rows.withColumn("description", F.trim(F.array_join("lines", " "))).withColumn("signature", F.concat(F.lower("promo_code"), F.lit("|"), F.lower("description")))
    first = rows.groupBy(key, "signature").agg(F.min_by(F.struct("position", "merchant", "__url", "promo_code", "lines", "description"), "position").alias("r")).select(key, "signature", "r.*")
    said = F.filter(F.slice("lines", F.lit(2), F.size("lines")), lambda t: ex.valid_until(t, now).isNull())
    head = F.element_at("lines", 1)
    title = F.concat(F.coalesce(F.concat("merchant", F.lit(" — ")), F.lit("")), F.upper(F.left(head, F.lit(1))), F.substring(head, 2, 1 << 20))
    percent = ex.first_percent(F.col("description"))
    return first.select(
        key, "position", "promo_code", F.substring(title, 1, 300).alias("title"), "merchant", F.substring("description", 1, 2000).alias("description"), F.nullif(F.trim(F.array_join(said, " ")), F.lit("")).alias("conditions"),
        percent.alias("discount_percent"), F.when(percent.isNull(), ex.first_amount(F.col("description"))).alias("discount_amount"), ex.valid_until(F.col("description"), now).alias("valid_until"),
        F.substring(F.sha2(F.concat_ws("|", "__url", "signature"), 256), 1, 32).alias("external_id"),
    )
