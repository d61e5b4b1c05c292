"""Column functions of the offer domain. All stay in the JVM: no Python in the plan."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import fixed

MONEY = "decimal(14,2)"
PERCENT = "decimal(8,2)"
_SPACES = r"(?U)[\s ]+"


def once(x: Column, f: Callable[[Column], Column]) -> Column:
    """``f(x)`` with ``x`` written and computed once, however often ``f`` uses it. Spark repeats an expression
    at each use, and inside ``when`` and lambdas it does not find the common ones again."""
    return F.try_element_at(F.transform(F.array(x), f), F.lit(1))


def filled(x: Column) -> Column:
    """The text, or null if it is empty."""
    return once(x, lambda v: F.when(v != "", v))


def collapse(x: Column) -> Column:
    """White space collapsed and trimmed; empty becomes null."""
    return filled(F.trim(F.regexp_replace(x, _SPACES, " ")))


def normalize_text(x: Column) -> Column:
    """Lower case, ё as е, and only letters of the two alphabets, digits and ``% + . -``."""
    low = F.replace(F.lower(F.coalesce(x, F.lit(""))), F.lit("ё"), F.lit("е"))
    return F.trim(F.regexp_replace(low, r"[^a-zа-я0-9%+.-]+", " "))


def normalize_keyword(x: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(F.coalesce(x, F.lit(""))), _SPACES, " "))


def slug(x: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(x), "[^a-z0-9а-яё]+", "-"), "^-+|-+$", "")


def matched_terms(x: Column, terms: list[str]) -> Column:
    """Terms that the text contains, in the order of the list."""
    return F.filter(F.array(*[F.lit(t) for t in terms]), lambda t: F.contains(x, t))


# -- URLs -----------------------------------------------------------------------------------


def url_scheme(x: Column) -> Column:
    return F.lower(F.regexp_extract(x, r"^([A-Za-z][A-Za-z0-9+.-]*):", 1))


def url_host(x: Column) -> Column:
    return F.lower(F.regexp_extract(x, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))


def url_port(x: Column) -> Column:
    return F.nullif(F.regexp_extract(x, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?[^/?#:]*:(\d+)", 1), F.lit("")).cast("int")


def explicit_port(x: Column) -> Column:
    """The port, or null if it is the scheme's own."""
    port, scheme = url_port(x), url_scheme(x)
    own = ((scheme == "http") & (port == 80)) | ((scheme == "https") & (port == 443))
    return F.when(F.coalesce(own, F.lit(False)), F.lit(None).cast("int")).otherwise(port)


def origin_key(x: Column) -> Column:
    return F.struct(url_scheme(x).alias("scheme"), url_host(x).alias("host"), explicit_port(x).alias("port"))


def safe_origin(x: Column) -> Column:
    port = url_port(x)
    return F.concat(url_scheme(x), F.lit("://"), url_host(x), F.coalesce(F.concat(F.lit(":"), port.cast("string")), F.lit("")))


def site_key(x: Column) -> Column:
    """Host without a trailing dot, with a port that is not the scheme's own."""
    host = F.regexp_replace(url_host(x), r"\.+$", "")
    return F.when(host != "", F.concat(host, F.coalesce(F.concat(F.lit(":"), explicit_port(x).cast("string")), F.lit(""))))


def url_path(x: Column) -> Column:
    return F.regexp_extract(x, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)", 1)


def url_query(x: Column) -> Column:
    return F.regexp_extract(x, r"^[^?#]*\?([^#]*)", 1)


def unquoted(x: Column) -> Column:
    """Percent-decoded text, as written where it cannot be decoded."""
    return F.coalesce(F.try_url_decode(F.replace(x, F.lit("+"), F.lit("%2B"))), x)


def resolve_link(base: Column, href: Column) -> Column:
    """The absolute http(s) URL that a link on a page means, without its fragment, or null.

    Links with a user name, without a host or with an impossible port mean nothing.
    """
    h, origin = F.trim(href), F.regexp_extract(base, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*", 0)
    at = F.regexp_extract(h, "^[^?#]*", 0)
    rest = F.regexp_extract(h, r"^[^?#]*(\?[^#]*)", 1)
    folder = F.regexp_replace(url_path(base), "[^/]*$", "")
    parts = F.split(F.when(at.startswith("/"), at).otherwise(F.concat(F.when(folder == "", "/").otherwise(folder), at)), "/")
    parts = F.when(at.startswith("/"), parts).otherwise(F.concat(F.slice(parts, 1, 1), F.filter(F.slice(parts, F.lit(2), F.greatest(F.size(parts) - 2, F.lit(0))), lambda p: p != ""), F.slice(parts, -1, 1)))
    last = F.element_at(parts, -1)
    none = F.array().cast("array<string>")
    walked = F.aggregate(parts, none, lambda done, p: F.when(p == "..", F.slice(done, F.lit(1), F.greatest(F.size(done) - 1, F.lit(0)))).when(p == ".", done).otherwise(F.concat(done, F.array(p))))
    walked = F.when(last.isin(".", ".."), F.concat(walked, F.array(F.lit("")))).otherwise(walked)
    joined = F.array_join(walked, "/")
    path = F.when(joined.startswith("/"), joined).otherwise(F.concat(F.lit("/"), joined))
    whole = (
        F.when(h.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:"), h)
        .when(h.startswith("//"), F.concat(url_scheme(base), F.lit(":"), h))
        .when(at == "", F.concat(origin, url_path(base), F.when(rest != "", rest).otherwise(F.regexp_extract(base, r"^[^?#]*(\?[^#]*)", 1))))
        .otherwise(F.concat(origin, path, rest))
    )
    authority = F.regexp_extract(whole, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1)
    number = F.regexp_extract(authority, r":([^:\]]*)$", 1)
    fits = (number == "") | (number.rlike("^[0-9]+$") & (number.try_cast("long") <= 65535))
    host = F.regexp_replace(F.lower(F.regexp_replace(authority, r":[^:\]]*$", "")), r"\.+$", "")
    port = explicit_port(whole)
    good = (h != "") & ~h.startswith("#") & url_scheme(whole).isin("http", "https") & (host != "") & ~F.contains(authority, F.lit("@")) & fits
    tail = F.concat(F.when(url_path(whole) == "", "/").otherwise(url_path(whole)), F.regexp_extract(whole, r"^[^?#]*(\?[^#]+)", 1))
    return F.when(good, F.concat(url_scheme(whole), F.lit("://"), host, F.coalesce(F.concat(F.lit(":"), port.cast("string")), F.lit("")), tail))


def blocked_suffix(url: Column) -> Column:
    """Whether the path names a file that is no page."""
    return any_of([F.lower(url_path(url)).endswith(s) for s in fixed.BLOCKED_SUFFIXES])


def canonical_url(x: Column) -> Column:
    """Lower-case scheme and authority, no tracking keys, no doubled or trailing slashes, no
    fragment. Queries are kept as written, for plain characters the same as re-encoding them."""
    t = F.trim(x)
    authority = F.lower(F.regexp_extract(t, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1))
    path = F.regexp_extract(t, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)", 1)
    path = F.regexp_replace(F.when(path == "", "/").otherwise(path), "/{2,}", "/")
    path = F.when(path == "/", path).otherwise(F.regexp_replace(path, "/+$", ""))
    query = F.regexp_extract(t, r"^[^?#]*\?([^#]*)", 1)
    key = lambda p: F.lower(F.substring_index(p, "=", 1))
    kept = F.filter(F.split(query, "&"), lambda p: (p != "") & ~key(p).isin(*fixed.TRACKING) & ~key(p).startswith("utm_"))
    kept = F.transform(kept, lambda p: F.when(F.contains(p, F.lit("=")), p).otherwise(F.concat(p, F.lit("="))))
    rest = F.array_join(kept, "&")
    out = F.concat(url_scheme(t), F.lit("://"), authority, path, F.when(rest != "", F.concat(F.lit("?"), rest)).otherwise(""))
    return F.when(F.coalesce(x, F.lit("")) != "", out)


# -- numbers --------------------------------------------------------------------------------


def decimal_or_none(x: Column, kind: str = MONEY) -> Column:
    return F.replace(F.replace(x, F.lit(" ")), F.lit(","), F.lit(".")).try_cast(kind)


def discount_percent(old: Column, new: Column) -> Column:
    """Half-even, as money is rounded; null unless 0 <= new < old."""
    part = (old - new).cast("decimal(20,6)") / old * 100
    return F.when((old > 0) & (new >= 0) & (new < old), F.bround(part, 2).cast(PERCENT))


def decimal_text(x: Column) -> Column:
    """One text per value: no trailing zeros, and nothing for null or zero."""
    plain = F.regexp_replace(F.regexp_replace(x.cast("string"), r"(\.\d*?)0+$", "$1"), r"\.$", "")
    return F.when(x.isNull() | (x == 0), "").otherwise(plain)


def first_percent(x: Column) -> Column:
    value = F.regexp_extract(x, r"(\d{1,3})\s*%", 1).try_cast("int")
    return F.when((value > 0) & (value <= 100), value)


def first_amount(x: Column) -> Column:
    found = F.regexp_extract(x, r"(?iuU)(\d[\d\s ]*)\s*(?:₽|руб|rub)", 1)
    return F.regexp_replace(found, _SPACES, "").try_cast(MONEY)


def prices(x: Column) -> Column:
    """All prices of a text, in order."""
    part = lambda found, k: F.regexp_extract(found, fixed.PRICE, k)
    cents = lambda c: F.when(c != "", F.concat(F.lit("."), c)).otherwise("")
    text = F.transform(F.regexp_extract_all(x, F.lit(fixed.PRICE), F.lit(0)), lambda found: F.concat(F.regexp_replace(part(found, 1), _SPACES, ""), once(part(found, 2), cents)))
    return F.filter(F.transform(text, lambda v: v.try_cast(MONEY)), lambda v: v.isNotNull())


def offer_type(title: Column, promo: Column, cashback: Column, delivery: Column) -> Column:
    text = normalize_text(title)
    has = lambda w: F.contains(text, F.lit(w))
    return (
        F.when(F.coalesce(promo, F.lit("")) != "", "promo")
        .when(cashback.isNotNull() | has("кэшб") | has("кешб") | has("cashback"), "cashback")
        .when(delivery.isNotNull() | (has("доставк") & has("бесплат")), "delivery")
        .otherwise("discount")
    )


def fingerprint(merchant: Column, title: Column, promo: Column, amounts: list[Column]) -> Column:
    parts = [normalize_text(merchant), normalize_text(title), normalize_text(promo), *map(decimal_text, amounts)]
    return F.sha2(F.concat_ws("|", *parts), 256)


def external_id(*parts: Column) -> Column:
    return F.substring(F.sha2(F.concat_ws("|", *[F.coalesce(p, F.lit("")) for p in parts]), 256), 1, 32)


def content_hash(*parts: Column) -> Column:
    return F.sha2(F.concat_ws("\n", *[F.coalesce(p, F.lit("")) for p in parts]), 256)


def json_text(x: Column) -> Column:
    """A string as JSON spells it."""
    for plain, spelled in (("\\", "\\\\"), ('"', '\\"'), ("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t")):
        x = F.replace(x, F.lit(plain), F.lit(spelled))
    return F.concat(F.lit('"'), x, F.lit('"'))


def record_id(parent: Column, provider: Column, source: Column) -> Column:
    body = F.concat(F.lit('{"parent_asset_id":'), json_text(parent), F.lit(',"provider":'), json_text(provider), F.lit(',"source_ref":'), json_text(source), F.lit("}"))
    return F.concat(F.lit("rec_"), F.substring(F.sha2(body, 256), 1, 24))


def retry_delay(attempt: Column) -> Column:
    return F.least(F.lit(10.0), 0.5 * F.pow(F.lit(2.0), attempt - 1))


# -- codes, conditions, dates, places -----------------------------------------------------------


def without_urls(x: Column) -> Column:
    return F.regexp_replace(x, fixed.URL, " ")


def is_code(x: Column) -> Column:
    return x.rlike(fixed.STANDALONE_CODE) & ~x.isin(*fixed.NOT_A_CODE) & ~x.rlike(fixed.CALL_TO_ACTION)


def promo_code(x: Column) -> Column:
    """A labelled code, else the first line that is one (upper case, with a digit or ``_``)."""
    return once(without_urls(F.coalesce(x, F.lit(""))), code_in)


def code_in(clean: Column) -> Column:
    """The promo code of a text without links."""
    labelled = once(F.upper(F.regexp_extract(clean, fixed.LABELLED_CODE, 1)), lambda v: F.when((v != "") & ~v.isin(*fixed.NOT_A_CODE) & ~v.rlike(fixed.CALL_TO_ACTION), v))
    own = F.transform(F.split(clean, "\n"), lambda v: F.regexp_replace(F.trim(v), r"^[•—–\-:;,.\[\](){}<>]+|[•—–\-:;,.\[\](){}<>]+$", ""))
    lines = F.filter(own, lambda v: is_code(v) & (F.upper(v) == v) & v.rlike("[0-9_]"))
    return F.coalesce(labelled, F.get(lines, F.lit(0)))


def _amount(x: Column, patterns: list[str]) -> Column:
    found = [F.regexp_replace(filled(F.regexp_extract(x, p, 1)), _SPACES, "").try_cast(MONEY) for p in patterns]
    return F.coalesce(*found)


def sentences(x: Column) -> Column:
    return F.transform(F.split(x, r"(?<=[.!?;])\s+|\n+"), lambda v: F.regexp_replace(F.trim(F.regexp_replace(v, _SPACES, " ")), r"^[ •—\-\t]+|[ •—\-\t]+$", ""))


def conditions(x: Column, explicit: Column | None = None) -> Column:
    """conditions, max_discount_amount and min_order_amount of a text."""
    said = collapse(explicit) if explicit is not None else F.lit(None).cast("string")

    def read(text: Column) -> Column:
        chosen = F.array_distinct(F.filter(sentences(text), lambda v: v.rlike(fixed.CONDITION)))
        found = filled(F.substring(F.array_join(chosen, " "), 1, 2000))
        return F.struct(F.coalesce(said, found).alias("conditions"), _amount(text, fixed.MOST_DISCOUNT).alias("max_discount_amount"), _amount(text, fixed.LEAST_ORDER).alias("min_order_amount"))

    return once(F.trim(F.coalesce(x, F.lit(""))), read)


def valid_until(x: Column, now: Column) -> Column:
    """The end of the day that a text names, in UTC; a day without a year lies ahead of ``now``."""
    end = lambda y, m, d: F.try_make_timestamp(y, m, d, F.lit(23), F.lit(59), F.lit(59))
    part = lambda found, p, k: F.regexp_extract(found, p, k).try_cast("int")
    months = F.array(*[F.lit(m) for m in fixed.MONTHS])

    def numeric(found: Column) -> Column:
        return end(part(found, fixed.DATE, 3), part(found, fixed.DATE, 2), part(found, fixed.DATE, 1))

    def worded(found: Column) -> Column:
        month = F.nullif(F.array_position(months, F.lower(F.regexp_extract(found, fixed.DAY_MONTH, 2))).cast("int"), F.lit(0))
        day, year = part(found, fixed.DAY_MONTH, 1), part(found, fixed.DAY_MONTH, 3)
        this = end(F.coalesce(year, F.year(now)), month, day)
        return F.when(year.isNull() & (this < now), end(F.year(now) + 1, month, day)).otherwise(this)

    # The text is searched once for each pattern; the parts are read from what was found.
    dated = once(F.regexp_extract(x, fixed.DATE, 0), lambda found: F.when(found != "", numeric(found)).otherwise(once(F.regexp_extract(x, fixed.DAY_MONTH, 0), worded)))
    return F.when(x.rlike(fixed.ENDLESS), F.lit(None).cast("timestamp")).otherwise(dated)

def _alias(text: Column, aliases: list[tuple[str, str]]) -> Column:
    """What the first alias in the list that the text holds as a word stands for."""
    hits = [F.when(text.rlike(rf"(?uU)(?<![\w-]){a.replace('-', '[-]')}(?![\w-])"), F.lit(name)) for a, name in aliases]
    return F.coalesce(*hits)


def geo(x: Column) -> Column:
    """scope, city and region that a text names."""
    text = F.trim(F.coalesce(x, F.lit("")))
    clean = lambda v: F.nullif(F.regexp_replace(F.replace(v, F.lit("ё"), F.lit("е")), r"^[ ,.;:()\[\]]+|[ ,.;:()\[\]]+$", ""), F.lit(""))
    low = F.lower(text)
    region = F.coalesce(_alias(low, fixed.REGIONS), clean(F.regexp_extract(text, fixed.REGION, 1)))
    city = F.coalesce(_alias(low, fixed.CITIES), clean(F.regexp_extract(text, fixed.CITY, 1)))
    everywhere = text.rlike(fixed.ALL_RUSSIA)
    scope = F.when(everywhere, "all_russia").when(city.isNotNull(), "city").when(region.isNotNull(), "region").otherwise("unknown")
    return F.struct(scope.alias("scope"), F.when(~everywhere, city).alias("city"), F.when(~everywhere, region).alias("region"))


# -- redaction and captions -----------------------------------------------------------------------


def redact(x: Column) -> Column:
    x = F.regexp_replace(x, fixed.NAMED_SECRET, "$1=***REDACTED***")
    x = F.regexp_replace(x, fixed.URL_SECRET, "$1***REDACTED***:***REDACTED***@")
    return F.regexp_replace(x, fixed.BOT_SECRET, "***REDACTED_TOKEN***")


def sanitized(x: Column) -> Column:
    """A text for a status page: redacted, then whole headers, named values and ids once more."""
    x = F.regexp_replace(redact(F.nullif(x, F.lit(""))), fixed.URL_SECRET, "$1***REDACTED***:***REDACTED***@")
    x = F.regexp_replace(x, fixed.HEADER_SECRET, "$1: ***REDACTED***")
    for pattern in (fixed.GENERIC_SECRET, fixed.ID_SECRET):
        x = F.regexp_replace(x, pattern, "$1=***REDACTED***")
    return x


def error_text(x: Column) -> Column:
    clean = F.regexp_replace(x, fixed.URL, "<url>")
    return F.when(F.char_length(clean) > 2000, F.concat(F.substring(clean, 1, 1997), F.lit("..."))).otherwise(clean)


def clip(x: Column, limit: int) -> Column:
    """White space collapsed; a longer text is cut at a word and marked."""
    text = collapse(x)
    head = F.substring(text, 1, limit - 1)
    word = F.when(F.contains(head, F.lit(" ")), F.regexp_extract(head, r"(?s)^(.*) ", 1)).otherwise(head)
    word = F.regexp_replace(word, r"[ ,.;:\-]+$", "")
    cut = F.concat(F.when(word != "", word).otherwise(F.rtrim(head)), F.lit("…"))
    return F.when(F.char_length(text) <= limit, text).otherwise(cut)


def money(x: Column, sign: str = "₽") -> Column:
    """Thousands apart, no cents if there are none."""
    return F.concat(F.replace(F.replace(F.format_number(x.cast(MONEY), 2), F.lit(","), F.lit(" ")), F.lit(".00")), F.lit(f" {sign}"))


def html_escape(x: Column) -> Column:
    for plain, spelled in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        x = F.replace(x, F.lit(plain), F.lit(spelled))
    return x


def caption(title: Column, lines: list[Column]) -> Column:
    """A bold title and the lines that are not null, one below the other."""
    return F.concat_ws("\n", F.concat(F.lit("<b>"), html_escape(clip(title, 110)), F.lit("</b>")), *lines)


def any_of(conditions_: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, conditions_, F.lit(False))
