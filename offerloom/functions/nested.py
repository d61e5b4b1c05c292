"""Expressions that walk a value's type: canonical JSON, a tagged codec with a strict inverse, and redaction.

The walk happens once, over the schema, and leaves plain expressions; rows never leave the JVM.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import expressions as ex

_NAMED = {"\\": "\\\\", '"': '\\"', "\n": "\\n", "\r": "\\r", "\t": "\\t", "\b": "\\b", "\f": "\\f"}
_CONTROL = {chr(k): f"\\u{k:04x}" for k in range(32) if chr(k) not in _NAMED}
_HEX = lambda s: f"decode(unhex('{s.encode().hex()}'), 'utf-8')"
#: All of them as an SQL array, the backslash first: one constant of a plan instead of many calls.
_SPELLED = "array(" + ", ".join(f"named_struct('sign', {_HEX(a)}, 'code', {_HEX(b)})" for a, b in {**_NAMED, **_CONTROL}.items()) + ")"
_NESTED = (T.ArrayType, T.MapType, T.StructType)
_WHOLE = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)


def float_text(x: Column) -> Column:
    """The shortest text that reads back as the same double, as Python spells it; null if not finite."""

    def spelled(s: Column) -> Column:
        digits, e = F.replace(F.regexp_extract(s, r"^-?([0-9.]+)e", 1), F.lit("."), F.lit("")), F.regexp_extract(s, r"e([+-]\d+)$", 1).cast("int")
        n = F.length(digits)
        small = F.concat(F.lit("0."), F.repeat(F.lit("0"), -e - 1), digits)
        whole = F.concat(digits, F.repeat(F.lit("0"), e + 1 - n), F.lit(".0"))
        mixed = F.concat(F.left(digits, e + 1), F.lit("."), F.substring(digits, e + 2, n))
        power = F.concat(F.left(digits, F.lit(1)), F.when(n > 1, F.concat(F.lit("."), F.substring(digits, F.lit(2), n))).otherwise(""), F.when(e < 0, "e-").otherwise("e+"), F.lpad(F.abs(e).cast("string"), F.greatest(F.lit(2), F.length(F.abs(e).cast("string"))), F.lit("0")))
        plain = F.when((e < -4) | (e >= 16), power).when(e < 0, small).when(n <= e + 1, whole).otherwise(mixed)
        return F.concat(F.when(s.startswith("-"), "-").otherwise(""), plain)

    tries = F.array(*[F.format_string(f"%.{k}e", x) for k in range(17)])
    found = ex.once(F.try_element_at(F.filter(tries, lambda t: t.cast("double") == x), F.lit(1)), spelled)
    return F.when(~F.isnan(x) & (F.abs(x) != float("inf")), found)


def json_string(x: Column) -> Column:
    """A string as JSON spells it, other letters than ASCII as they are."""
    # Spark's writer spells the code of a sign in capitals, so signs whose code has letters are replaced one by one.
    each = F.concat(F.lit('"'), F.aggregate(F.expr(_SPELLED), x, lambda y, c: F.replace(y, c["sign"], c["code"])), F.lit('"'))
    written = ex.once(F.to_json(F.struct(x.alias("a"))), lambda t: F.substring(t, F.lit(6), F.length(t) - 6))
    return F.when(~x.rlike(r'["\\\x00-\x1f]'), F.concat(F.lit('"'), x, F.lit('"'))).when(x.rlike(r"[\x0b\x0e\x0f\x1a-\x1f]"), each).otherwise(written)


def _listed(items: Column, signs: str = "[]") -> Column:
    """The items between brackets, or null if one of them is null."""
    return ex.once(items, lambda x: F.when(~F.exists(x, lambda i: i.isNull()), F.concat(F.lit(signs[0]), F.array_join(x, ","), F.lit(signs[1]))))


def canonical_json(x: Column, kind: T.DataType) -> Column:
    """Compact JSON with sorted keys; structs keep their null fields. Decimals, dates and times are strings, bytes
    base64; a float that is no number makes the whole text null, as JSON has no such value."""
    if isinstance(kind, T.StructType):
        names = sorted(kind.fieldNames())
        parts = [F.concat(json_string(F.lit(n)), F.lit(":"), canonical_json(x[n], kind[n].dataType)) for n in names]
        whole = F.concat(F.lit("{"), *[y for k, p in enumerate(parts) for y in ((F.lit(","), p) if k else (p,))], F.lit("}"))
    elif isinstance(kind, T.MapType):
        keys = F.array_sort(F.map_keys(x))
        pairs = F.transform(keys, lambda k: F.concat(json_string(k.cast("string")), F.lit(":"), canonical_json(x[k], kind.valueType)))
        whole = _listed(pairs, "{}")
    elif isinstance(kind, T.ArrayType):
        whole = _listed(F.transform(x, lambda i: canonical_json(i, kind.elementType)))
    elif isinstance(kind, (*_WHOLE, T.BooleanType)):
        whole = x.cast("string")
    elif isinstance(kind, (T.FloatType, T.DoubleType)):
        whole = float_text(x.cast("double"))
    else:
        whole = json_string(_plain_text(x, kind))
    return F.when(x.isNull(), F.lit("null")).otherwise(whole)


def _plain_text(x: Column, kind: T.DataType) -> Column:
    if isinstance(kind, T.BinaryType):
        return F.base64(x)
    if isinstance(kind, T.TimestampType):
        return F.date_format(F.to_utc_timestamp(x, F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'+00:00'")
    return x.cast("string")


def _tag(kind: T.DataType) -> str:
    tags: list[tuple[tuple, str]] = [
        (_WHOLE, "int"), ((T.BooleanType,), "bool"), ((T.FloatType, T.DoubleType), "float"), ((T.StringType,), "str"), ((T.BinaryType,), "bytes"),
        ((T.DecimalType,), "decimal"), ((T.DateType,), "date"), ((T.TimestampType,), "time"), ((T.ArrayType,), "list"), ((T.StructType, T.MapType), "dict"),
    ]
    found = next((tag for types, tag in tags if isinstance(kind, types)), None)
    if found is None:
        raise TypeError(f"no tag for {kind.simpleString()}")
    return found


def _has_gaps(kind: T.DataType) -> bool:
    """Whether a value of the type may have no text: a float that is no number has none."""
    if isinstance(kind, T.StructType):
        return any(_has_gaps(f.dataType) for f in kind.fields)
    inner = kind.valueType if isinstance(kind, T.MapType) else kind.elementType if isinstance(kind, T.ArrayType) else None
    return _has_gaps(inner) if inner is not None else isinstance(kind, (T.FloatType, T.DoubleType))


def _frame(kind: T.DataType) -> tuple[str, str]:
    """What begins and ends every text of a type but that of its null."""
    tag = _tag(kind)
    if isinstance(kind, T.StructType) and kind.fields:
        return f'["{tag}",[[{_name(min(kind.fieldNames()))},', "]]]"
    if tag in ("list", "dict"):
        return f'["{tag}",[', "]]"
    return (f'["{tag}",', "]") if tag in ("int", "bool") else (f'["{tag}","', '"]')


def _name(text: str) -> str:
    return json.dumps(text, ensure_ascii=False)


def _joined(kind: T.StructType, parts: list[Column]) -> list[Column]:
    """The parts of a struct, by name, with what stands between them."""
    return [y for k, (n, p) in enumerate(zip(sorted(kind.fieldNames()), parts)) for y in ((F.lit(f"],[{_name(n)},"), p) if k else (p,))]


def encode(x: Column, kind: T.DataType) -> Column:
    """A value as tagged JSON, ``["int",5]``; a null is ``["null"]``, a mapping a list of sorted pairs."""
    tag, (head, tail) = _tag(kind), _frame(kind)

    def items(texts: Column, inner: T.DataType) -> Column:
        sound = ex.once(texts, lambda t: F.when(~F.exists(t, lambda i: i.isNull()), t)) if _has_gaps(inner) else texts
        return F.array_join(sound, ",")

    if isinstance(kind, T.StructType):
        body = _joined(kind, [encode(x[n], kind[n].dataType) for n in sorted(kind.fieldNames())])
    elif isinstance(kind, T.MapType):
        if not isinstance(kind.keyType, T.StringType):
            raise TypeError("mappings need string keys")
        pairs = F.transform(F.array_sort(F.map_keys(x)), lambda k: F.concat(F.lit("["), json_string(k), F.lit(","), encode(x[k], kind.valueType), F.lit("]")))
        body = [items(pairs, kind.valueType)]
    elif isinstance(kind, T.ArrayType):
        body = [items(F.transform(x, lambda i: encode(i, kind.elementType)), kind.elementType)]
    elif tag in ("str", "bytes"):
        head, tail, body = head[:-1], tail[1:], [json_string(_plain_text(x, kind))]
    else:  # digits and signs that JSON writes as they are
        body = [float_text(x.cast("double")) if tag == "float" else x.cast("string") if tag in ("int", "bool") else _plain_text(x, kind)]
    return F.when(x.isNull(), F.lit('["null"]')).otherwise(F.concat(F.lit(head), *body, F.lit(tail)))


def payload_hash(text: Column) -> Column:
    return F.sha2(text.cast("binary"), 256)


def _result(value: Column, error: Column) -> Column:
    return ex.once(error, lambda e: F.struct(F.when(e.isNull(), value).alias("value"), e.alias("error")))


def _result_of(value: Column, error: Column) -> Column:
    return F.struct(F.when(error.isNull(), value).alias("value"), error.alias("error"))


def _first_error(parts: Column) -> Column:
    return F.try_element_at(F.filter(F.transform(parts, lambda p: p["error"]), lambda e: e.isNotNull()), F.lit(1))


def _parts(v: Column) -> Column:
    """The items of a variant that is a list; each reading copies all below it, so it is done once a list."""
    return F.try_variant_get(v, "$", "array<variant>")


def _read(payload: Column, kind: T.DataType) -> Column:
    """The payload of a tagged variant as (value, error)."""
    tag, get = _tag(kind), lambda as_: F.try_variant_get(payload, "$", as_)
    if isinstance(kind, (T.ArrayType, T.MapType, T.StructType)):
        return ex.once(_parts(payload), lambda items: F.when(items.isNull(), _result(F.lit(None).cast(kind), F.lit(f"{tag} payload must be a list"))).otherwise(_read_items(items, kind)))
    at = get("string")
    value = {"int": get("long"), "bool": get("boolean"), "bytes": F.try_to_binary(at, F.lit("base64")), "time": F.try_to_timestamp(at)}.get(tag, at).try_cast(kind)
    return ex.once(value, lambda x: _result(x, F.when(x.isNull(), F.lit(f"{tag} payload cannot be read"))))


def _read_items(items: Column, kind: T.DataType) -> Column:
    if isinstance(kind, T.ArrayType):
        return ex.once(F.transform(items, lambda i: _decoded(i, kind.elementType)), lambda parts: _result(F.transform(parts, lambda p: p["value"]), _first_error(parts)))

    def pair(p: Column) -> Column:
        good = (F.size(p) == 2) & (F.schema_of_variant(F.get(p, F.lit(0))) == "STRING")
        return F.struct(F.when(F.coalesce(good, F.lit(False)), F.try_variant_get(F.get(p, F.lit(0)), "$", "string")).alias("key"), F.get(p, F.lit(1)).alias("at"))

    def keyed(pairs: Column) -> Column:
        keys = F.transform(pairs, lambda p: p["key"])
        wrong = F.when(F.exists(keys, lambda k: k.isNull()), F.lit("a dict entry must be a string key and a typed value")).when(F.size(keys) != F.size(F.array_distinct(keys)), F.lit("duplicate key"))
        return ex.once(wrong, lambda w: F.when(w.isNotNull(), _result(F.lit(None).cast(kind), w)).otherwise(_fields(pairs, kind)))

    return ex.once(F.transform(items, lambda p: ex.once(_parts(p), pair)), keyed)


def _fields(pairs: Column, kind: T.DataType) -> Column:
    if isinstance(kind, T.MapType):
        parts = F.transform(pairs, lambda p: F.struct(p["key"].alias("key"), _decoded(p["at"], kind.valueType).alias("r")))
        entries = lambda ps: F.map_from_entries(F.transform(ps, lambda p: F.struct(p["key"], p["r"]["value"])))
        return ex.once(parts, lambda ps: _result(entries(ps), _first_error(F.transform(ps, lambda p: p["r"]))))
    names = kind.fieldNames()

    def one(name: str) -> Column:
        return ex.once(F.try_element_at(F.filter(pairs, lambda p: p["key"] == name), F.lit(1))["at"], lambda v: F.when(v.isNull(), _result(F.lit(None).cast(kind[name].dataType), F.lit(f"missing key {name}"))).otherwise(_decoded(v, kind[name].dataType)))

    fields = F.struct(*[one(n).alias(n) for n in names])
    extra = F.when(F.size(pairs) > len(names), F.lit("unknown key"))
    return ex.once(fields, lambda r: _result(F.struct(*[r[n]["value"].alias(n) for n in names]), F.coalesce(*[r[n]["error"] for n in names], extra)))


def _decoded(v: Column, kind: T.DataType) -> Column:
    """(value, error) of a tagged variant; the error is null if all of it fits the type."""
    tag, empty = _tag(kind), F.lit(None).cast(kind)

    def judged(items: Column) -> Column:
        return ex.once(F.try_variant_get(F.get(items, F.lit(0)), "$", "string"), lambda said: read(items, said))

    def read(items: Column, said: Column) -> Column:
        size = F.size(items)
        wrong = (
            F.when(size.isNull() | (size < 1) | said.isNull(), F.lit("a typed value must be a list with a tag"))
            .when((said != tag) & ~((said == "null") & (size == 1)), F.concat(F.lit(f"expected {tag}, found "), said))
            .when((said == tag) & (size != 2), F.concat(F.lit("invalid value for tag "), said))
        )
        right = F.when(said == "null", _result(empty, F.lit(None).cast("string"))).otherwise(_read(F.get(items, F.lit(1)), kind))
        return ex.once(wrong, lambda w: F.when(w.isNotNull(), _result(empty, w)).otherwise(right))

    return ex.once(_parts(v), judged)


def _between(text: Column, before: int, behind: int) -> Column:
    return F.substring(text, F.lit(before + 1), F.length(text) - (before + behind))


def _split(text: Column, *marks: str) -> Column:
    """The text cut at each of the marks, none of which is a pattern. The encoder writes no raw control signs, so one can stand for them."""
    for mark in marks:
        text = F.replace(text, F.lit(mark), F.lit("\x01"))
    return F.split(text, "\x01")


def _marks(kind: T.StructType) -> list[str]:
    """What stands between the fields of a struct."""
    return [f"],[{_name(n)}," for n in sorted(kind.fieldNames())[1:]]


def _unescaped(text: Column) -> Column:
    return F.when(F.contains(text, F.lit("\\")), F.try_variant_get(F.try_parse_json(F.concat(F.lit('"'), text, F.lit('"'))), "$", "string")).otherwise(text)


def _guess(text: Column, kind: T.DataType) -> Column:
    """The value that a text of the encoder's spells, by cutting it where the type says. Any other text may give
    any value, so it counts only if the encoder writes that text for it."""
    tag, (head, tail) = _tag(kind), _frame(kind)
    inside = F.when(text.startswith(head), _between(text, len(head), len(tail)))
    if isinstance(kind, T.StructType):
        at = {n: k for k, n in enumerate(sorted(kind.fieldNames()))}
        fields = lambda p: F.struct(*[_guess(F.get(p, F.lit(at[n])), kind[n].dataType).alias(n) for n in kind.fieldNames()])
        return ex.once(_split(inside, *_marks(kind)), lambda p: F.when(p.isNotNull(), fields(p)))
    if isinstance(kind, T.ArrayType):
        item = kind.elementType
        first, last = _frame(item)
        if isinstance(item, T.StructType) and item.fields and not any(isinstance(f.dataType, _NESTED) for f in item.fields):
            return F.when(text == head + tail, F.array().cast(kind)).otherwise(_guess_flat(text, head, tail, item))
        items = lambda x: F.transform(_split(_between(x, len(first), len(last)), f"{last},{first}"), lambda p: _guess(F.concat(F.lit(first), p, F.lit(last)), item))
        return ex.once(inside, lambda x: F.when(x == "", F.array().cast(kind)).otherwise(items(x)))
    if isinstance(kind, T.MapType):
        if isinstance(kind.valueType, _NESTED):
            return _decoded(F.try_parse_json(text), kind)["value"]
        entry = lambda p: ex.once(F.substring_index(p, '",', 1), lambda k: F.struct(_unescaped(k).alias("key"), _guess(F.concat(F.substring(p, F.length(k) + 3, F.length(p)), F.lit("]")), kind.valueType).alias("value")))
        entries = F.transform(F.when(text == head + tail, F.array().cast("array<string>")).otherwise(_split(_between(text, len(head) + 2, len(tail) + 2), ']],["')), entry)
        sound = lambda e: ~F.exists(e["key"], lambda k: k.isNull()) & (F.size(F.array_distinct(e["key"])) == F.size(e))
        return ex.once(entries, lambda e: F.when(sound(e), F.map_from_entries(e)))
    return _plain(inside, kind)


def _plain(inside: Column, kind: T.DataType) -> Column:
    """A value of a plain type from what stands between its tag and its end."""
    tag = _tag(kind)
    if tag == "str":
        return _unescaped(inside)
    return {"bytes": F.try_to_binary(inside, F.lit("base64")), "time": F.try_to_timestamp(inside)}.get(tag, inside).try_cast(kind)


def _guess_flat(text: Column, head: str, tail: str, kind: T.StructType) -> Column:
    """A list of structs of plain values without nulls: one cut gives the values of all of them in turn."""
    names = sorted(kind.fieldNames())
    frames = [_frame(kind[n].dataType) for n in names]
    first, last = _frame(kind)[0] + frames[0][0], frames[-1][1] + _frame(kind)[1]
    marks = [f"{a[1]}{mark}{b[0]}" for a, mark, b in zip(frames, _marks(kind), frames[1:])] + [f"{last},{first}"]
    inside = F.when(text.startswith(head + first), _between(text, len(head + first), len(last + tail)))
    pieces = _split(inside, *marks)
    at = {n: k for k, n in enumerate(names)}

    def items(p: Column) -> Column:
        starts = F.sequence(F.lit(0), F.size(p) - 1, F.lit(len(names)))
        return F.transform(starts, lambda i: F.struct(*[_plain(F.get(p, i + at[n]), kind[n].dataType).alias(n) for n in kind.fieldNames()]))

    return ex.once(pieces, items)


def decode(text: Column, kind: T.DataType, expected_hash: Column | None = None) -> Column:
    """The strict inverse of :func:`encode`: a struct of the value and what is wrong with the text, if
    anything: no JSON, another tag, a missing or repeated key, another spelling than the encoder's, or
    another hash than expected."""
    read = ex.once(F.try_parse_json(text), lambda v: F.when(v.isNull(), _result(F.lit(None).cast(kind), F.lit("not a JSON text"))).otherwise(_decoded(v, kind)))
    # The parser stops at the end of the first value; whatever the encoder would not write is refused.
    exact = lambda r: _result(r["value"], F.coalesce(r["error"], F.when(~encode(r["value"], kind).eqNullSafe(text), F.lit("not in canonical form"))))
    found = ex.once(read, exact)
    if expected_hash is None:
        return found
    return F.when(payload_hash(text) != expected_hash, _result(F.lit(None).cast(kind), F.lit("hash differs"))).otherwise(found)


def with_decoded(df: DataFrame, out: str, text: str, kind: T.DataType, expected_hash: Column | None = None) -> DataFrame:
    """``df`` with :func:`decode` of its column ``text`` as a column ``out``, for many rows.

    The text of a struct is cut where the names of its fields stand. A field is right if the encoder writes its text for the
    value guessed from it. Only texts with other fields are read step by step, with ``["null"]``, in which nothing
    is wrong, in place of the right ones. Each step is a column, so Spark computes it once.
    """
    if not isinstance(kind, T.StructType) or not kind.fields:
        return df.withColumn(out, decode(F.col(text), kind, expected_hash))
    names, (head, tail), kept = sorted(kind.fieldNames()), _frame(kind), df.columns
    col = lambda step, n="": F.col(f"`__{out} {step} {n}`")

    def add(df: DataFrame, step: str, columns: dict[str, Column]) -> DataFrame:
        return df.withColumns({f"__{out} {step} {n}": c for n, c in columns.items()})

    def whole(parts: list[Column]) -> Column:
        return F.concat(F.lit(head), *_joined(kind, parts), F.lit(tail), col("rest"))

    every = lambda step: {n: col(step, n) for n in names}
    differs = F.lit(False) if expected_hash is None else F.coalesce(payload_hash(F.col(text)) != expected_hash, F.lit(False))
    df = add(df, "differs", {"": differs})
    df = add(df, "seen", {"": F.when(~col("differs"), F.col(text))})
    df = add(df, "cut", {"": _split(col("seen"), *_marks(kind))})
    df = add(df, "ends", {"first": F.get(col("cut"), F.lit(0)), "last": F.get(col("cut"), F.lit(len(names) - 1))})
    df = add(df, "rest", {"": F.substring_index(col("ends", "last"), tail, -1)})
    texts = {n: F.get(col("cut"), F.lit(k)) for k, n in enumerate(names)}
    end = lambda x: F.substring(x, F.lit(1), F.length(x) - F.length(col("rest")) - len(tail))
    texts[names[-1]] = end(texts[names[-1]])
    texts[names[0]] = F.when(col("ends", "first").startswith(head), F.substring(texts[names[0]], F.lit(len(head) + 1), F.length(texts[names[0]])))
    df = add(df, "text", texts)
    df = add(df, "guess", {n: _guess(x, kind[n].dataType) for n, x in every("text").items()})
    df = add(df, "right", {n: encode(x, kind[n].dataType).eqNullSafe(col("text", n)) for n, x in every("guess").items()})
    df = add(df, "whole", {"": F.coalesce(whole([*every("text").values()]) == col("seen"), F.lit(False))})
    settled = col("whole")  # all fields are right; a rest behind them is what the parser does not reach
    for r in every("right").values():
        settled = settled & r
    df = add(df, "settled", {"": settled})
    # The other texts must be one JSON value each, or what stands behind them could belong to them.
    parts = [F.when(col("right", n), F.lit('["null"]')).when(F.to_json(F.try_parse_json(x)) == x, x) for n, x in every("text").items()]
    df = add(df, "short", {"": F.when(col("whole") & ~col("settled"), whole(parts))})
    df = add(df, "slow", {"": F.when(~col("settled") & ~col("differs"), decode(F.coalesce(col("short"), col("seen")), kind))})
    value = F.struct(*[F.when(col("right", n), col("guess", n)).otherwise(col("slow")["value"][n]).alias(n) for n in kind.fieldNames()])
    slow = _result_of(F.when(col("short").isNull(), col("slow")["value"]).otherwise(value), col("slow")["error"])
    fast = _result_of(F.struct(*[col("guess", n).alias(n) for n in kind.fieldNames()]), F.when(col("rest") != "", F.lit("not in canonical form")))
    wrong = _result_of(F.lit(None).cast(kind), F.lit("hash differs"))
    return df.select(*[F.col(f"`{c}`") for c in kept], F.when(col("differs"), wrong).when(col("settled"), fast).otherwise(slow).alias(out))


SECRET_KEY = r"(?i)^(?:token|.*[_-]token|api[_-]?(?:key|hash)|x-api-key|password|passwd|.*[_-]password|secret|session|authorization|proxy-authorization|cookie|set-cookie)$"


def redact_nested(x: Column, kind: T.DataType, by_key: bool = False) -> Column:
    """The value with secrets redacted in every string inside it, map keys aside. With ``by_key`` strings
    under a name that means a secret are redacted whole."""

    def walk(x: Column, kind: T.DataType, hidden: Column) -> Column:
        if isinstance(kind, T.StringType):
            return F.when(hidden & x.isNotNull(), F.lit("***REDACTED***")).otherwise(ex.redact(x))
        if isinstance(kind, T.ArrayType):
            return F.transform(x, lambda i: walk(i, kind.elementType, hidden))
        if isinstance(kind, T.MapType):
            named = lambda k: hidden | k.cast("string").rlike(SECRET_KEY) if by_key else hidden
            return F.transform_values(x, lambda k, v: walk(v, kind.valueType, named(k)))
        if isinstance(kind, T.StructType):
            import re

            fields = [walk(x[f.name], f.dataType, hidden | F.lit(by_key and bool(re.search(SECRET_KEY, f.name)))).alias(f.name) for f in kind.fields]
            return F.when(x.isNotNull(), F.struct(*fields))
        return x

    return walk(x, kind, F.lit(False))
