"""Repeated containers of a page: which nodes look like cards, and selectors of them and their fields."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame

from ..functions import fixed
from . import selectors as css
from .html import explode_pages

MOST, LEAST_SCORE, SHOWN = 30, 3.0, 5
_GENERATED, _PROMO, _DATE, _CODE = (re.compile(p) for p in (fixed.GENERATED_NAME, fixed.PROMO_HINT, fixed.DATE_HINT, fixed.CODE_SHAPE))
LEFT_OUT = frozenset({"script", "style", "noscript", "svg"})


def _classes(tree: css.Tree, i: int) -> list[str]:
    """Class names that a later visit will still find, at most three."""
    names = tree.attrs[i].get("class", "").split()
    return [n for n in names if len(n) <= 64 and not _GENERATED.search(n) and not any(c in n for c in ":/[]()")][:3]


def signature(tree: css.Tree, i: int) -> str:
    """A selector of nodes like this one, without its place."""
    name = tree.attrs[i].get("id", "").strip()
    if name and len(name) <= 80 and not _GENERATED.search(name):
        return f"#{name}"
    return tree.tag[i] + "".join(f".{c}" for c in _classes(tree, i))


def score(tree: css.Tree, i: int, text: str) -> float:
    """How much a node looks like a card; 0 if its text is too short or too long for one."""
    if not 20 <= len(text) <= 1800:
        return 0.0
    tags = {tree.tag[k] for k in range(i + 1, tree.end[i]) if tree.tag[k] != "a" or "href" in tree.attrs[k]}
    named = " ".join(_classes(tree, i)).casefold()
    return (
        2.0 * (tree.tag[i] in ("article", "li")) + 3.0 * bool(_PROMO.search(text)) + 1.0 * ("a" in tags) + 0.5 * ("img" in tags)
        + 2.0 * any(w in named for w in fixed.CONTAINER_WORDS)
    )


def _fields(tree: css.Tree, card: int, text: str) -> dict:
    """Selectors of the fields of one sample card, relative to it."""
    inside = range(card + 1, tree.end[card])
    first = lambda tags, test=lambda k: True: next((k for k in inside if tree.tag[k] in tags and test(k)), None)
    own = signature(tree, card)
    name = lambda k: None if k is None else ":scope" if signature(tree, k) == own else signature(tree, k)
    attribute = lambda k, names: None if k is None else next((a for a in names if tree.attrs[k].get(a)), None)
    promo = first({"code", "span", "div", "button"}, lambda k: _CODE.search(tree.text(k))) if _PROMO.search(text) else None
    image = first({"img"})
    source = attribute(image, ("src", "data-src", "data-original"))
    return {
        "item_selector": own,
        "title_selector": name(first({"h1", "h2", "h3", "h4", "strong", "b"})),
        "promo_code_selector": name(promo),
        "promo_code_attribute": attribute(promo, ("data-code", "data-coupon", "value")),
        "conditions_selector": name(first({"p", "div"}, lambda k: _PROMO.search(tree.only_string(k)))),
        "valid_until_selector": name(first({"time", "span", "div"}, lambda k: _DATE.search(tree.only_string(k)))),
        "link_selector": name(first({"a"}, lambda k: "href" in tree.attrs[k])),
        "image_selector": name(image),
        "image_attribute": None if source == "src" else source,
    }


def containers_of(asset: str, html: str) -> list[dict]:
    """The best scored containers of a page, at most ``MOST``, in order, each with a profile of it, how
    many nodes its selector finds, and how many of the first ``SHOWN`` have a field."""
    tree = css.Tree(html, LEFT_OUT)
    scored = []
    for i in range(1, len(tree.tag)):
        if tree.tag[i] in ("article", "li", "div"):
            text = tree.text(i)
            if (s := score(tree, i, text)) >= LEAST_SCORE:
                scored.append((-s, i, text))
    chosen = sorted(scored)[:MOST]
    profiles = [_fields(tree, i, text) for _, i, text in chosen]
    names = {p[n] for p in profiles for n in p if n.endswith("_selector") and p[n]}
    readable = {n for n in names if _readable(n)}
    finder = css.Finder(tree, sorted(readable))
    out = []
    for rank, ((s, i, _), p) in enumerate(zip(chosen, profiles), 1):
        used = [p[n] for n in p if n.endswith("_selector") and p[n]]
        nodes = finder.all(p["item_selector"]) if set(used) <= readable else []
        value = lambda node, n, a=None: (at := finder.first(node, p[n]) if p[n] else None) is not None and bool((tree.attrs[at].get(a, "") if a else tree.text(at)).strip())  # noqa: B023, E731
        useful = sum(value(k, "title_selector") or value(k, "promo_code_selector", p["promo_code_attribute"]) or value(k, "conditions_selector") for k in nodes[:SHOWN])
        out.append({"rank": rank, "score": -s, "matches": len(nodes), "useful": useful, **p})
    return out


def _readable(selector: str) -> bool:
    try:
        return bool(css.parse(selector))
    except css.SelectorError:
        return False


CONTAINER = (
    "rank int, score double, matches int, useful int, item_selector string, title_selector string, promo_code_selector string, promo_code_attribute string, conditions_selector string,"
    " valid_until_selector string, link_selector string, image_selector string, image_attribute string"
)


def containers(pages: DataFrame, key: str) -> DataFrame:
    return explode_pages(pages, key, containers_of, CONTAINER)
