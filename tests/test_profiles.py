"""Selectors against a plain matcher, and profiles on small pages."""

import random

import pytest
from pyspark.sql import functions as F

from offerloom.operators import profiles as pr
from offerloom.sources import selectors as css

PAGE = """<html><body><div id="list" class="cards big"><!-- c -->
<article class="card" data-n="1"><h3>Скидка <b>20%</b></h3><p class="terms">Заказ от 500 ₽</p><code data-code="SALE20">***</code><time>до 31.12.2030</time><a href="/go/1">Открыть</a><img data-src="/i/1.png"></article>
<article class="card x"><h3>Подарок</h3><script>var x = 1</script><p>Без кода</p><a href="https://b.example/2">Go</a></article>
<article class="card"></article></div><p class="terms">outside</p></body></html>"""


def path_of(tree, i):
    while i > 0:
        yield i
        i = tree.parent[i]


def plain(tree, steps, i, scope):
    """Whether a path ends at a node, tried backwards step by step."""
    step = steps[-1]
    if i == 0 or (step.tag not in (None, tree.tag[i])) or (step.scope and i != scope) or not all(f(tree, i) for f in step.tests):
        return False
    before = []
    j = tree.before[i]
    while j >= 0:
        before.append(j)
        j = tree.before[j]
    to = {"": None, "child": [tree.parent[i]], "below": list(path_of(tree, tree.parent[i])), "next": before[:1], "later": before}[step.relation]
    return True if to is None else any(plain(tree, steps[:-1], k, scope) for k in to)


def test_automaton_equals_a_backtracking_matcher():
    rng = random.Random(4)
    tests = ["a", "b", "*", ".x", ".y", "#i", "[k]", "[k=v]", "a.x", "b:first-child", "a:nth-child(2n+1)", "b:not(.x)", "a:last-child", "*:nth-of-type(2)"]
    for _ in range(60):
        html = ""
        for _ in range(40):
            tag = rng.choice("ab")
            html += rng.choice([f"<{tag}{rng.choice(['', ' class=x', ' class=\"y x\"', ' id=i', ' k=v', ' k'])}>", f"</{tag}>", "t", "<br>"])
        tree = css.Tree(html)
        chosen = ["".join([rng.choice(tests), *(rng.choice([" ", " > ", "+", " ~ "]) + rng.choice(tests) for _ in range(rng.randint(0, 3)))]) for _ in range(12)]
        chosen.append(f"{chosen[0]}, {chosen[1]}")
        finder = css.Finder(tree, chosen)
        for s in chosen:
            want = [i for i in range(1, len(tree.tag)) if any(plain(tree, p, i, None) for p in css.parse(s))]
            assert finder.all(s) == want, (s, html)
            for node in range(1, len(tree.tag)):
                assert finder.first(node, s) == next((i for i in want if node < i < tree.end[node]), None)
        scoped = ":scope > " + rng.choice(tests)
        finder = css.Finder(tree, [scoped])
        for node in range(1, len(tree.tag)):
            assert finder.first(node, scoped) == next((i for i in range(node + 1, tree.end[node]) if plain(tree, css.parse(scoped)[0], i, node)), None)


@pytest.mark.parametrize("bad", ["", "a >", "> a", "a[", "a..b", ":hover", "a,,b", "li:nth-child(x)"])
def test_selectors_that_cannot_be_read(bad):
    with pytest.raises(css.SelectorError):
        css.parse(bad)


def test_profile_items(spark):
    pages = spark.createDataFrame([(1, "s", "https://s.example/list", PAGE), (2, "s", "https://s.example/", None), (3, "t", "https://t.example/", PAGE), (4, "s", None, "")], "key int, site string, url string, html string")
    row = {"site": "s", "profile": "p", "item_selector": "#list > .card", "title_selector": "h3", "promo_code_selector": "code", "promo_code_attribute": "data-code", "conditions_selector": ".terms", "valid_until_selector": "time", "link_selector": "a", "image_selector": "img"}
    profiles = spark.createDataFrame([row, row | {"profile": "q", "item_selector": "a["}, row | {"profile": "r", "item_selector": None}], ", ".join(f"{k} string" for k in row))
    got = sorted(pr.profile_items(pages, profiles, F.lit("2026-01-01").cast("timestamp")).collect(), key=lambda r: (r.key, r.profile, r.position or 0))
    assert [(r.key, r.profile, r.error is None) for r in got] == [(1, "p", True), (1, "p", True), (1, "q", False), (4, "q", False)]
    first, second = got[:2]
    assert (first.title, first.promo_code, first.conditions, first.url, first.image_url) == ("Скидка 20%", "SALE20", "Заказ от 500 ₽", "https://s.example/go/1", "https://s.example/i/1.png")
    assert first.valid_until == "2030-12-31T23:59:59Z" and first.text == "Скидка 20% Заказ от 500 ₽ *** до 31.12.2030 Открыть"
    assert (second.text, second.promo_code, second.conditions, second.url) == ("Подарок Без кода Go", None, None, "https://b.example/2")


def test_pages_with_very_many_cards_are_whole(spark):
    cards = "".join(f"<li>Скидка {k}<a href='/{k}'>x</a></li>" for k in range(1300))
    pages = spark.createDataFrame([(1, "s", "https://s.example/", f"<ul>{cards}</ul>"), (2, "s", "https://s.example/", "<ul><li>Скидка</li></ul>")], "key int, site string, url string, html string")
    profiles = spark.createDataFrame([("s", "p", "li", "a"), ("s", "q", "ul > li", ":scope > a")], "site string, profile string, item_selector string, link_selector string")
    got = pr.profile_items(pages, profiles, F.lit("2026-01-01").cast("timestamp")).collect()
    assert sorted((r.key, r.profile, r.position, r.url.rsplit("/", 1)[1]) for r in got) == sorted([(1, p, k, str(k)) for p in "pq" for k in range(1300)] + [(2, p, 0, "") for p in "pq"])


def test_first_characters_of_a_text():
    tree = css.Tree("<p>abc<b>de</b><script>x</script><i>f</i></p>")
    for most in range(12):
        assert tree.text(1, most=most) == "abc de f"[:most]


def test_revealed_numbers_are_no_codes(spark):
    html = '<div class="c">Скидка<button data-coupon-id="77">Показать</button></div>'
    pages = spark.createDataFrame([(k, h, f"https://{h}/x", html) for k, h in ((1, "www.promko.net"), (2, "other.example"))], "key int, site string, url string, html string")
    profiles = spark.createDataFrame([(h, "p", ".c", "button", "data-coupon-id") for h in ("www.promko.net", "other.example")], "site string, profile string, item_selector string, reveal_selector string, reveal_code_attribute string")
    got = {r.key: (r.promo_code, r.coupon_id, r.needs_reveal) for r in pr.profile_items(pages, profiles, F.current_timestamp()).collect()}
    assert got == {1: (None, "77", True), 2: ("77", None, False)}


@pytest.mark.parametrize(
    "sample, field, item, relative",
    [
        ("#a > li:nth-child(3)", "#a > li:nth-child(3) > h3", "#a > li", "h3"),
        ("#a > li:nth-child(3)", "#a > li > h3 > b", "#a > li", "h3 > b"),
        ("#a > li:nth-child( 3 ):nth-of-type(1)", "#a > li:nth-child( 3 ):nth-of-type(1)", "#a > li", ":scope"),
        ("ul:nth-child(2) > li", "footer a", "ul:nth-child(2) > li", "footer a"),
        (":nth-child(2)", None, ":nth-child(2)", None),
        ("  ", " b ", None, "b"),
    ],
)
def test_copied_selectors(spark, sample, field, item, relative):
    df = spark.createDataFrame([(sample, field)], "s string, f string")
    assert tuple(df.select(pr.generalized_selector(F.col("s")), pr.relative_selector(F.col("s"), F.col("f"))).first()) == (item, relative)


def test_references_need_their_semicolon():
    tree = css.Tree('<div class="a&b">x &amp;&am &amp</div><a href="/?a=1&copy=2&amp;b=3">&quot;</a>')
    assert [tree.text(1), tree.text(2)] == ["x &&am &amp", '"']
    assert tree.attrs[1]["class"] == "a&b" and tree.attrs[2]["href"] == "/?a=1&copy=2&b=3"
