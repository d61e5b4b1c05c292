"""Extraction profiles: CSS selectors of a site's cards and of the fields inside them."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from itertools import islice
from urllib.parse import urljoin, urlsplit

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import expressions as ex
from ..functions import fixed
from ..sources import selectors as css
from ..sources.html import ROWS_OUT

#: Columns of a profile besides site and profile; all but item_selector may be null.
FIELDS = [
    "item_selector", "title_selector", "promo_code_selector", "promo_code_attribute", "conditions_selector",
    "valid_until_selector", "link_selector", "reveal_selector", "reveal_code_attribute", "image_selector", "image_attribute",
]
TEXT_CHARS, TITLE_CHARS = 12_000, 1_000


def _strip(x: Column) -> Column:
    return F.regexp_replace(x, r"(?U)^\s+|\s+$", "")


def generalized_selector(sample: Column) -> Column:
    """The selector of one sample card without the positions of its last step, so that it finds all
    cards beside it; null if blank."""
    raw = F.nullif(_strip(sample), F.lit(""))
    parts = F.transform(F.split(raw, ">"), _strip)
    last = _strip(F.regexp_replace(F.element_at(parts, -1), fixed.POSITION, ""))
    parts = F.filter(F.concat(F.slice(parts, F.lit(1), F.size(parts) - 1), F.array(last)), lambda p: p != "")
    return F.coalesce(F.nullif(F.array_join(parts, " > "), F.lit("")), raw)


def relative_selector(sample: Column, field: Column) -> Column:
    """A selector of the whole page as one inside the sample card; ``:scope`` is the card itself."""
    field, sample = F.nullif(_strip(field), F.lit("")), _strip(F.coalesce(sample, F.lit("")))
    found = field
    for prefix in (generalized_selector(sample), sample):  # the sample itself is tried first
        tail = _strip(F.regexp_replace(F.substring(field, F.length(prefix) + 1, F.length(field)), r"(?U)^\s*>*", ""))
        inside = F.coalesce(F.nullif(tail, F.lit("")), F.lit(":scope"))
        found = F.when(field == prefix, ":scope").when(field.startswith(F.concat(prefix, F.lit(" >"))), inside).otherwise(found)
    return found


def normalized_profiles(profiles: DataFrame) -> DataFrame:
    """Profiles copied from a browser as reusable ones: cards generalised, fields relative to them."""
    text = {name: F.nullif(_strip(F.col(name).cast("string")), F.lit("")) if name in profiles.columns else F.lit(None).cast("string") for name in FIELDS}
    fields = [relative_selector(text["item_selector"], text[n]).alias(n) for n in FIELDS if n.endswith("_selector") and n != "item_selector"]
    attributes = [text[n].alias(n) for n in FIELDS if n.endswith("_attribute")]
    return profiles.select("site", "profile", generalized_selector(text["item_selector"]).alias("item_selector"), *fields, *attributes)


_ITEM = "position int, page_url string, url string, title string, text string, promo_code string, conditions string, validity string, coupon_id string, needs_reveal boolean, image_url string"
IMAGE_ATTRIBUTES = ["src", "data-src", "data-lazy-src", "data-original", "content"]


@lru_cache(maxsize=4096)
def _problem(selector: str) -> str | None:
    try:
        css.parse(selector)
    except css.SelectorError as e:
        return str(e)
    return None


def _items(tree: css.Tree, finder: css.Finder, url: str, p: dict) -> Iterator[dict]:
    def value(node: int, selector: str | None, attribute: str | None = None) -> str | None:
        at = finder.first(node, selector) if selector else None
        if at is None:
            return None
        return (tree.attrs[at].get(attribute, "") if attribute else tree.text(at)).strip() or None

    host = (urlsplit(url).hostname or "").casefold().removeprefix("www.")
    numbered = host in fixed.COUPON_ID_SITES and (p["reveal_code_attribute"] or "").casefold() == "data-coupon-id"
    for position, node in enumerate(finder.all(p["item_selector"])):
        text = tree.text(node, most=TEXT_CHARS)
        if not text:
            continue
        promo, reveal = value(node, p["promo_code_selector"], p["promo_code_attribute"]), value(node, p["reveal_selector"], p["reveal_code_attribute"])
        coupon = numbered and bool(reveal) and reveal.isdigit()
        link = value(node, p["link_selector"], "href")
        shown = finder.first(node, p["image_selector"]) if p["image_selector"] else None
        images = [tree.attrs[shown].get(a, "").strip() for a in ([p["image_attribute"]] if p["image_attribute"] else IMAGE_ATTRIBUTES)] if shown is not None else []
        image = next((x for x in images if x and not x.startswith(("data:", "blob:"))), None)
        yield {
            "position": position, "page_url": url, "url": urljoin(url, link) if link else url, "title": value(node, p["title_selector"]) or text[:TITLE_CHARS], "text": text,
            "promo_code": promo or (None if coupon else reveal), "conditions": value(node, p["conditions_selector"]), "validity": value(node, p["valid_until_selector"]),
            "coupon_id": reveal if coupon else None, "needs_reveal": coupon and not promo, "image_url": urljoin(url, image) if image else None,
        }


def profile_items(pages: DataFrame, profiles: DataFrame, now: Column) -> DataFrame:
    """The cards that each profile of a page's site finds on it, with their fields.

    ``pages`` has key, site, url and html; ``profiles`` site, profile and :data:`FIELDS`. All profiles of a
    site meet a page at once: its nodes are read once and all selectors run in one sweep. A profile whose
    selector cannot be read, or a page that fails, gives a row with an error. Null pages and cards
    without text give nothing; all cards of a page are read.
    """
    fields = [F.col(n).cast("string").alias(n) if n in profiles.columns else F.lit(None).cast("string").alias(n) for n in FIELDS]
    known = profiles.where("item_selector IS NOT NULL").groupBy("site").agg(F.sort_array(F.collect_list(F.struct("profile", *fields))).alias("profiles"))
    joined = pages.where("html IS NOT NULL").join(known, "site").select("key", "url", "html", "profiles")
    kind = joined.schema["key"].dataType.simpleString()
    whole = f"key {kind}, profile string, {_ITEM}, error string"
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    arrow = to_arrow_schema(StructType.fromDDL(whole))

    def read(key, url: str, html: str, known: list[dict]) -> Iterator[dict]:
        good = []
        for p in known:
            problems = [x for n in FIELDS if n.endswith("_selector") and p[n] and (x := _problem(p[n]))]
            if problems:
                yield {"key": key, "profile": p["profile"], "error": f"invalid selector: {problems[0]}"[:500]}
            else:
                good.append(p)
        try:
            tree = css.Tree(html)
            finder = css.Finder(tree, [p[n] for p in good for n in FIELDS if n.endswith("_selector") and p[n]])
            rows = [{"key": key, "profile": p["profile"]} | item for p in good for item in _items(tree, finder, url or "", p)]
        except Exception as e:  # noqa: BLE001  one bad page must not fail the job
            rows = [{"key": key, "error": f"{type(e).__name__}: {e}"[:500]}]
        yield from rows

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k, url, html, known in zip(*(c.to_pylist() for c in batch.columns)):
                found = read(k, url, html, known)
                while rows := [{f.name: row.get(f.name) for f in arrow} for row in islice(found, ROWS_OUT)]:
                    yield pa.RecordBatch.from_pylist(rows, schema=arrow)

    found = joined.mapInArrow(run, whole)
    ends = F.date_format(ex.valid_until(F.coalesce("validity", "text"), now), "yyyy-MM-dd'T'HH:mm:ssXXX")
    digest = F.when(F.col("error").isNull(), F.sha2(F.concat_ws("|", "url", "title", "text").cast("binary"), 256))
    return found.withColumn("valid_until", ends).withColumn("external_id", digest).drop("validity", "page_url")
