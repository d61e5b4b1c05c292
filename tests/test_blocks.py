"""The block automaton against a machine that walks the texts one by one."""

import random

from pyspark.sql import functions as F

from offerloom.operators import blocks

PIECES = {"b": ["AB12", "Sale-5", "скидка"], "p": ["Промокод на 10%", "промокод 500 ₽", "Промокоды"], "a": ["Активировать промокод"], "d": ["до 31.12.2030", "До 1 мая", "до завтра"], "s": ["О сервисе"], "x": ["Условия", "для новых", "100"]}
NO_CODES = {"активировать", "промокод", "промокоды", "скидка", "скидки", "открыть", "подробнее", "получить", "применить", "использовать"}


def walk(texts):
    import re

    code = lambda t: re.fullmatch("[A-Za-zА-Яа-яЁё0-9][A-Za-zА-Яа-яЁё0-9_-]{2,31}", t) and t.casefold() not in NO_CODES
    said = lambda t: re.match(r"промокод\b", t, re.I)
    until = lambda t: t.casefold().startswith("до ") and "завтра" not in t
    end = next((k for k, t in enumerate(texts) if t.casefold().startswith("о сервисе")), len(texts))
    out, seen, i = [], set(), 0
    while i + 1 < end:
        if not (code(texts[i]) and said(texts[i + 1])):
            i += 1
            continue
        lines, k = [texts[i + 1]], i + 2
        while k < end and len(lines) < 6:
            if (k + 1 < end and code(texts[k]) and said(texts[k + 1])) or texts[k].casefold().startswith("активировать промокод"):
                break
            lines.append(texts[k])
            k += 1
            if until(lines[-1]):
                break
        if (texts[i].casefold(), " ".join(lines).casefold()) not in seen:
            seen.add((texts[i].casefold(), " ".join(lines).casefold()))
            out.append((i + 1, texts[i], " ".join(lines)))
        i = k
    return out


def test_blocks_equal_a_walk(spark):
    rng = random.Random(8)
    rows = []
    for n in range(300):
        word = "".join(rng.choices(["bp", "b", "p", "a", "d", "x", "s"], [6, 2, 2, 2, 3, 8, 0.3], k=rng.randint(0, 25)))
        rows.append((n, [rng.choice(PIECES[c]) for c in word], "М"))
    df = spark.createDataFrame(rows, "page int, texts array<string>, merchant string")
    got = blocks.block_offers(df, "page", F.lit("u"), F.lit("2026-01-01").cast("timestamp")).select("page", "position", "promo_code", "description").collect()
    want = [(n, *x) for n, texts, _ in rows for x in walk(texts)]
    assert len(want) > 200 and sorted(map(tuple, got)) == sorted(want)


def test_offers_of_a_page(spark):
    html = "<h1>Лавка</h1><div>SALE10</div><div>Промокод на скидку 10%</div><p>для новых</p><p>до 31.12.2030</p><a>Активировать промокод</a><div>SALE10</div><div>промокод на скидку 10%</div><p>для новых</p><p>до 31.12.2030</p><h3>О сервисе</h3><div>ABC1</div><div>Промокод</div>"
    pages = spark.createDataFrame([(1, html), (2, "<p>x"), (3, None)], "page int, html string")
    got = blocks.block_offers(blocks.page_texts(pages, "page"), "page", F.lit("https://s.example/"), F.lit("2026-01-01").cast("timestamp")).collect()
    assert len(got) == 1
    r = got[0]
    assert (r.promo_code, r.title, r.conditions, r.discount_percent, str(r.valid_until)) == ("SALE10", "Лавка — Промокод на скидку 10%", "для новых", 10, "2030-12-31 23:59:59")
