"""Record fields, semantic records, inferred containers, corrections, the codec and redaction on small cases."""

import datetime
import decimal
import hashlib
import json
import math

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from offerloom.functions import nested
from offerloom.operators import corrections as co
from offerloom.operators import inference
from offerloom.operators import record_fields as rf
from offerloom.operators import semantic_records as sr
from offerloom.sources import containers, jsonld

SLICE = "case string, text string, heading string, strong string, href string, action_href string, action_text string, image string, image_alt string, anchor_kind string, tag string, data map<string,string>, ordinal int, source_url string, source_key string"


def slices(spark, **cases):
    base = dict.fromkeys(x.split()[0] for x in SLICE.split(", "))
    return spark.createDataFrame([base | {"case": k, "ordinal": 0, "tag": "div", "anchor_kind": "action", "source_url": "https://s.example/p"} | v for k, v in cases.items()], SLICE)


def test_record_fields(spark):
    rows = slices(
        spark,
        stop={"text": "Промокод получите в приложении ПРОМОКОД", "strong": "ПРОМОКОД"},
        price={"text": "Скидка 1500 ₽ на самый большой заказ 20231 шт", "heading": "Скидка"},
        bullets={"text": "Бонус до 50%", "data": {"data-promocode": "•••• ", "data-promo-code": "REAL5"}},
        hidden={"text": "Скидка ABC123", "action_text": "Открыть промокод", "strong": "ABC123"},
        summary={"text": "Альфа до 30%"},
        no_merchant={"text": "Скидка 5% от Бета", "heading": "Большая скидка", "anchor_kind": "heading", "href": "/h"},
        empty={"text": "  "},
        mail={"text": "Подарок", "anchor_kind": "x", "href": "mailto:a@b.example"},
        back={"text": "Кешбэк 7% в Гамма"},
    )
    got = {r.case: r for r in rf.offer_fields(rows, F.lit("2026-01-01").cast("timestamp")).collect()}
    assert set(got) == {"stop", "price", "bullets", "hidden", "summary", "no_merchant", "mail", "back"}
    assert got["stop"].promo_code is None
    assert got["price"].promo_code == "20231" and got["price"].discount_amount == decimal.Decimal("1500.00")  # 1500 lies beside its sign
    assert got["bullets"].promo_code == "REAL5" and got["bullets"].evidence.code == "data-promo-code"
    assert got["hidden"].promo_code is None
    assert (got["summary"].merchant, got["summary"].title, got["summary"].evidence.identity) == ("Альфа", "Скидка до 30% в Альфа", "summary")
    assert got["summary"].external_id == hashlib.sha256("https://s.example/p|Альфа|30".encode()).hexdigest()[:32]
    assert got["no_merchant"].merchant is None and got["no_merchant"].offer_url == "https://s.example/h"
    assert got["mail"].offer_url == "mailto:a@b.example"
    assert (got["back"].cashback_percent, got["back"].discount_percent, got["back"].merchant) == (7, None, "Гамма")
    assert [c.rank for c in got["hidden"].code_candidates] == []


def test_first_record_of_an_identity_stays(spark):
    same = {"text": "Скидка 5%", "anchor_kind": "plain"}
    fields = rf.offer_fields(slices(spark, a=same, b=same | {"ordinal": 1}), F.current_timestamp())
    got = rf.offers_of_pages(fields.withColumn("page", F.lit(1)), "page").collect()
    assert [(r.records, r.ordinal, r.case) for r in got] == [(2, 0, "a")]


def test_semantic_keys(spark):
    names = ["Full-Price", "ＦＵＬＬ　ｐｒｉｃｅ", "ﬁne №5", "Straße", "--", None, "ПРОМО_код"]
    got = [r[0] for r in spark.createDataFrame([(n,) for n in names], "n string").select(sr.semantic_key(F.col("n"))).collect()]
    assert got == ["fullprice", "fullprice", "fineno5", "strasse", "", None, "промокод"]


def test_jsonld_objects_and_records(spark):
    html = '<script type="application/ld+json">[{"Name":"a","price":1,"x":{"name":"b","price":[1,2]}},{"name":"c","price":null},{"name":"d","price":{}}]</script><script type="application/ld+json">{</script><script>{"name":"e","price":1}</script>'
    pages = spark.createDataFrame([(1, html), (2, None), (3, "<p>x"), (4, html.replace("[1,2]", "[]"))], "page int, html string")
    fields = spark.createDataFrame([("name", ["title"]), ("price", None)], "field string, aliases array<string>")
    objects = jsonld.objects(pages, "page")
    assert [r.warning for r in objects.where("warning IS NOT NULL AND page = 1").collect()] == ["malformed_jsonld:script[2]"]
    got = sr.jsonld_records(objects, fields, "page", most=1).orderBy("page").collect()
    assert [(r.page, r.source_ref, r.ordinal, r.warning) for r in got] == [(1, "script[1][0]", 0, "max_records:1"), (4, "script[1][0]", 0, None)]
    one = spark.createDataFrame([("name", None)], "field string, aliases array<string>")
    assert sr.jsonld_records(objects, one, "page").where("page = 1").count() == 4  # with one field, one is enough


def test_aliases_and_signals(spark):
    fields = spark.createDataFrame([("price", ["Price", "cost", None, "--"]), ("total", ["cost"])], "field string, aliases array<string>")
    assert sr.alias_index(fields).count() == 4
    signals = spark.createDataFrame([("COST", 0.5), ("Price", 0.01), ("cost!", 0.01), ("other", 1.0)], "name string, confidence double")
    got = sorted((r.name, r.field, r.term, round(r.match_confidence, 3)) for r in sr.matched_signals(signals, fields).collect())
    assert got == [("COST", "price", "cost", 0.48), ("COST", "total", "cost", 0.48), ("Price", "price", "price", 0.01), ("cost!", "price", "cost", 0.0), ("cost!", "total", "cost", 0.0)]


def test_attribute_records(spark):
    df = spark.createDataFrame([(1, [{"a": "1"}, None, {"b": "2"}]), (2, None), (3, [])], "asset int, records array<map<string,string>>")
    got = sr.attribute_records(df, "asset", most=2).orderBy("ordinal").collect()
    assert [(r.asset, r.source_ref, r.warning, r.error) for r in got] == [(1, "attributes.records[0]", "max_records:2", None), (1, "attributes.records[1]", "max_records:2", "attributes.records[1] must be a mapping")]


def test_containers_of_a_page(spark):
    card = '<li class="deal a1234567ab"><b>Скидка {k}</b><code value="AB{k}00">AB{k}00</code><p>по промокоду {k}</p><img data-src="/a"></li>'
    html = "<ul>" + "".join(card.format(k=k) for k in range(3)) + "</ul><li>Скидка одна, без повторов</li><noscript><li class=deal>Скидка в noscript, без скрипта</li></noscript>"
    found = containers.containers(spark.createDataFrame([(1, html), (2, "<p>"), (3, None)], "page int, html string"), "page")
    best = inference.page_profiles(found, "page").collect()
    assert len(best) == 1
    p = best[0]
    assert (p.item_selector, p.matches, p.useful, p.title_selector, p.promo_code_selector, p.promo_code_attribute, p.conditions_selector, p.image_attribute) == ("li.deal", 3, 3, "b", "code", "value", "p", "data-src")
    assert p.confidence == pytest.approx(0.68 + 0.04 * 4 + 0.02 * 3)


OFFER = "offer_id long, status string, title string, category string, subcategory string, discount_percent decimal(8,2), promo_code string, valid_until timestamp"


def test_corrections(spark):
    offers = spark.createDataFrame([(1, "needs_review", "Длинный заголовок", None, None, decimal.Decimal("5.00"), None, None), (2, "new", "Кор", "Еда", None, None, None, None)], OFFER)
    sheet = spark.createDataFrame(
        [("s", 2, "1.0", "Еда", "5", "2026-02-03T00:00:00+00:00", "x"), ("s", 3, "2", "", "1 000,5", "03.02.2026", "x"), ("s", 4, "abc", "", "", "", ""), ("s", 5, "9", "", "", "", ""), ("s", 6, " ", "", "", "", ""), ("s", 7, None, "", "", "", ""), ("s", 8, "1", "Еда", "1e", "30.02.2026", "x")],
        "sheet string, row int, id string, category string, discount_percent string, valid_until string, status string",
    )
    cells = co.change_cells(sheet, offers)
    got = sorted((r.row, r.field_name or "", r.outcome) for r in cells.collect())
    assert got == [
        (2, "category", "changed"), (2, "discount_percent", "same"), (2, "valid_until", "changed"), (3, "category", "changed"), (3, "discount_percent", "changed"), (3, "valid_until", "changed"),
        (4, "", "invalid_id"), (5, "", "unknown_offer"), (8, "category", "changed"), (8, "discount_percent", "bad_cell"), (8, "valid_until", "bad_cell"),
    ]
    kept = sorted((r.row, r.field_name or "", r.outcome) for r in co.change_cells(sheet, offers, blanks=False).collect())
    assert (3, "category", "same") in kept
    after = co.corrected_offers(offers, cells)
    rows = {r.offer_id: r for r in after.collect()}
    assert (rows[1].status, rows[1].category, rows[1].valid_until) == ("ready", "Еда", datetime.datetime(2026, 2, 3))
    assert (rows[2].category, rows[2].discount_percent, rows[2].status) == (None, decimal.Decimal("1000.50"), "new")
    rules = spark.createDataFrame([], "match_key string, match_value string, category string, subcategory string, enabled boolean")
    new = co.title_rules(after, cells, rules)
    assert [(r.match_value, r.category, r.priority) for r in new.collect()] == [("Длинный заголовок", "Еда", 200)]
    assert co.title_rules(after, cells, new.select("match_key", "match_value", "category", "subcategory", "enabled")).count() == 0


KIND = "b binary, d decimal(10,3), f double, i int, l array<struct<x:string,y:date>>, m map<string,array<boolean>>, t timestamp, z string"
VALUES = [
    (bytearray(b"\x00\xff"), decimal.Decimal("1.500"), 0.1, -5, [("a\"\\\n\x01é", datetime.date(2026, 1, 2)), (None, None), None], {"b": [True, None], "a": None, "": []}, datetime.datetime(2026, 1, 2, 3, 4, 5, 6000), "x"),
    (None, None, 1e22, None, None, None, None, None),
    (bytearray(), decimal.Decimal("-0.001"), 5e-324, 2**31 - 1, [], {}, datetime.datetime(1999, 12, 31), "\t ё"),
]


def tagged(v):
    if v is None:
        return ["null"]
    if isinstance(v, bool):
        return ["bool", v]
    if isinstance(v, int):
        return ["int", v]
    if isinstance(v, float):
        return ["float", repr(v)]
    if isinstance(v, str):
        return ["str", v]
    if isinstance(v, (bytes, bytearray)):
        import base64

        return ["bytes", base64.b64encode(v).decode()]
    if isinstance(v, decimal.Decimal):
        return ["decimal", str(v)]
    if isinstance(v, datetime.datetime):
        return ["time", v.strftime("%Y-%m-%dT%H:%M:%S.%f+00:00")]
    if isinstance(v, datetime.date):
        return ["date", str(v)]
    if isinstance(v, list):
        return ["list", [tagged(dict(zip("xy", x)) if isinstance(x, tuple) else x) for x in v]]
    return ["dict", [[k, tagged(v[k])] for k in sorted(v)]]


def test_codec(spark):
    kind = T.StructType.fromDDL(KIND)
    df = spark.createDataFrame([(k, v) for k, v in enumerate(VALUES)], T.StructType([T.StructField("k", T.IntegerType()), T.StructField("v", kind)]))
    text = df.select("k", "v", nested.encode(F.col("v"), kind).alias("p"))
    rows = text.select("k", "p", nested.payload_hash(F.col("p")).alias("h")).orderBy("k").collect()
    for r, v in zip(rows, VALUES):
        want = json.dumps(tagged(dict(zip(kind.fieldNames(), v))), ensure_ascii=False, separators=(",", ":"))
        assert r.p == want and r.h == hashlib.sha256(want.encode()).hexdigest()
    stored = spark.createDataFrame([(r.k, r.p) for r in rows], "k int, p string").join(df, "k")
    back = stored.select("v", nested.decode(F.col("p"), kind).alias("r")).collect()
    assert all(b.r.error is None and b.r.value == b.v for b in back)


@pytest.mark.parametrize(
    "text, kind, error",
    [
        ('["int",5]', "int", None), ('["null"]', "int", None), ("{", "int", "not a JSON text"), (None, "int", "not a JSON text"), ('["str","5"]', "int", "expected int, found str"), ('["int"]', "int", "invalid value for tag int"),
        ('["int",5,6]', "int", "invalid value for tag int"), ("[]", "int", "a typed value must be a list with a tag"), ("5", "int", "a typed value must be a list with a tag"), ('["int","x"]', "int", "int payload cannot be read"),
        ('["int",99999999999]', "int", "int payload cannot be read"), ('["list",5]', "array<int>", "list payload must be a list"), ('["list",[["int",1],["str","a"]]]', "array<int>", "expected int, found str"),
        ('["dict",[["a",["int",1]],["a",["int",2]]]]', "struct<a:int>", "duplicate key"), ('["dict",[]]', "struct<a:int>", "missing key a"), ('["dict",[["a",["int",1]],["b",["int",2]]]]', "struct<a:int>", "unknown key"),
        ('["dict",[[1,["int",1]]]]', "map<string,int>", "a dict entry must be a string key and a typed value"), ('["int",5] x', "int", "not in canonical form"), ('["int", 5]', "int", "not in canonical form"), ('["date","2026-02-30"]', "date", "date payload cannot be read"),
    ],
)
def test_damaged_payloads(spark, text, kind, error):
    t = T.StructType.fromDDL(f"x {kind}")["x"].dataType
    df = spark.createDataFrame([(text,)], "p string")
    assert df.select(nested.decode(F.col("p"), t)["error"]).first()[0] == error


DAMAGES = [
    lambda t: t + " true", lambda t: " " + t, lambda t: t.replace('["date"', '["time"'), lambda t: t.replace('["int",', '["int", '), lambda t: t.replace('["str","', '["bytes","'), lambda t: t[:-1], lambda t: t.replace('],["', ']],["', 1),
    lambda t: t.replace('[["a",', '[["b",', 1), lambda t: t.replace('["l",', '["n",'), lambda t: t[:-2] + ',["zz",["null"]]]]', lambda t: t.replace('"]],["z",', '","]],["z",'), lambda t: t.replace("\\u0001", "\\u0002"), lambda t: t.replace("\\u001f", "\\u001F"),
    lambda t: t.replace('["m",["dict",[', '["m",["dict",[["q",["int",1]],["q",["int",2]],'), lambda t: '["dict",[]]', lambda t: t.replace("]]]", "]]"), lambda t: t.replace("true", '"true"'),
]


def test_payloads_of_many_rows_are_read_as_single_ones(spark):
    import random

    kind = T.StructType.fromDDL("z string, l array<struct<y:date,x:string>>, b boolean, m map<string,int>, s struct<n:array<int>,e:decimal(4,1)>, f double")
    day = datetime.date(2026, 1, 2)
    values = [
        ("q\"\\\n\x01\x1fё],[\"l\",", [("a", day), ('","]]],["dict"', day)], True, {"b": 1, 'a",["': None}, ([1, 2], decimal.Decimal("1.5")), 0.5), (None, [(None, None), None], None, None, (None, None), None),
        ("", [], False, {}, ([], None), -0.0), ("x", None, None, {"": 5}, None, 1e22), None, ("]]]", [("", None)], True, {"k": 1, "j": 2}, ([None, 3], decimal.Decimal("0.0")), 3.0),
    ]
    values = [v and (v[0], v[1] and [x and (x[1], x[0]) for x in v[1]], *v[2:]) for v in values]
    made = spark.createDataFrame([(v,) for v in values], T.StructType([T.StructField("v", kind)]))
    texts = [r[0] for r in made.select(nested.encode(F.col("v"), kind)).collect()]
    rng = random.Random(3)
    rows = [*texts, *(f(t) for t in texts for f in DAMAGES), None, "", "{", *(t[:k] + rng.choice(['"', "]", "[", ",", "x", ""]) + t[k + 1 :] for t in texts for k in rng.sample(range(len(t)), min(len(t), 40)))]
    df = spark.createDataFrame([(k, t, k % 7 == 6) for k, t in enumerate(rows)], "k int, p string, other boolean").repartition(4)
    expected = nested.payload_hash(F.when(F.col("other"), F.lit("other")).otherwise(F.col("p")))
    many = nested.with_decoded(df, "r", "p", kind, expected)
    assert many.columns == ["k", "p", "other", "r"]
    single = df.select("k", nested.decode(F.col("p"), kind, expected).alias("r"))
    show = lambda d: sorted((r.k, r.r.error, repr(r.r.value)) for r in d.select("k", "r").collect())
    found, want = show(many), show(single)
    assert [(a, b, rows[a[0]]) for a, b in zip(found, want) if a != b] == [] and [x[1] for x in want[: len(texts)]] == [None] * len(texts)
    assert len({x[1] for x in want}) >= 9


def test_right_payloads_are_not_walked(spark, monkeypatch):
    kind = T.StructType.fromDDL("a int, l array<struct<x:int,y:date>>, m map<string,boolean>, t string")
    made = spark.createDataFrame([((5, [(1, datetime.date(2026, 1, 2))], {"k": True}, "a\nb"),)], T.StructType([T.StructField("v", kind)]))
    text = made.select(nested.encode(F.col("v"), kind)).first()[0]
    monkeypatch.setattr(nested, "decode", lambda text, kind, expected_hash=None: F.struct(F.lit(None).cast(kind).alias("value"), F.concat(F.lit("walked "), text).alias("error")))
    df = spark.createDataFrame([(text,), (text.replace('["int",5]', '["str","5"]'),)], "p string")
    got = [r.r.error for r in nested.with_decoded(df, "r", "p", kind).collect()]
    assert got == [None, 'walked ["dict",[["a",["str","5"]],["l",["null"]],["m",["null"]],["t",["null"]]]]']


def test_floats_are_spelled_as_python_does(spark):
    import random

    rng = random.Random(1)
    values = [0.0, -0.0, 1.0, 0.1, 1e15, 1e16, 123456789012345680.0, 1e-4, 1e-5, 5e-324, 1.7976931348623157e308, 2.0**-44, 1e23, 0.30000000000000004, 100.0, 12.5] + [rng.uniform(-1, 1) * 10 ** rng.randint(-20, 20) for _ in range(300)]
    df = spark.createDataFrame([(v,) for v in [*values, math.nan, math.inf]], "x double")
    assert [r[0] for r in df.select(nested.float_text(F.col("x"))).collect()] == [*map(repr, values), None, None]


def test_canonical_json(spark):
    kind = T.StructType.fromDDL("b string, a struct<z:int,y:array<double>>, m map<string,boolean>")
    df = spark.createDataFrame([(("ё\x7f", (1, [0.5, 1e16]), {"q": True, "p": None}),), ((None, None, None),), (("x", (None, [math.nan]), {}),)], T.StructType([T.StructField("v", kind)]))
    got = [r[0] for r in df.select(nested.canonical_json(F.col("v"), kind)).collect()]
    plain = [{"b": "ё\x7f", "a": {"z": 1, "y": [0.5, 1e16]}, "m": {"q": True, "p": None}}, {"a": None, "b": None, "m": None}]
    assert got == [*(json.dumps(x, ensure_ascii=False, sort_keys=True, separators=(",", ":")) for x in plain), None]


def test_nested_redaction(spark):
    kind = T.StructType.fromDDL("note string, api_key string, list array<struct<v:string>>, tags map<string,string>, n int")
    df = spark.createDataFrame([(("token=abc x", "zzz", [("password: q",), None], {"cookie": "a", "k": "ok"}, 1),), (None,)], T.StructType([T.StructField("v", kind)]))
    plain, hidden = (df.select(nested.redact_nested(F.col("v"), kind, by_key).alias("v")).collect() for by_key in (False, True))
    assert plain[0].v.note == "token=***REDACTED*** x" and plain[0].v.api_key == "zzz" and plain[0].v.tags == {"cookie": "a", "k": "ok"} and plain[0].v.n == 1
    assert plain[0].v.list[0].v == "password=***REDACTED***" and plain[0].v.list[1] is None and plain[1].v is None
    assert hidden[0].v.api_key == "***REDACTED***" and hidden[0].v.tags == {"cookie": "***REDACTED***", "k": "ok"}
