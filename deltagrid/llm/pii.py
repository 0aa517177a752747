"""Personal data replaced by format-preserving pseudonyms.

A value becomes a vector of numbers, each below its radix: digits below 10, letters below 26, address octets below 256,
a date's day number as two numbers. ROUNDS rounds of a keyed Feistel network (SHA-256 of key, kind, round and the other
half) permute these vectors within their format, so a value always gets the same pseudonym, in whatever document, two
values never share one, and whoever has the key can invert it. Numbers count only if their format's own rule holds
(check digits, ranges, calendar), and pseudonyms obey the same rule: check digits are computed anew, dates are dates (written with leading zeros).
At each place a card or IBAN is the longest run of whole groups whose check digits are right; what is beside it is read for
itself. Digits beside a pseudonym can, about once in ten for a card, make a longer number with right check digits, which
back then reads instead.

Kinds: email (top-level domain kept), card (first digit kept, Luhn), iban (country kept, mod 97), ssn, phone (country code
kept), ipv4, date (of one 400-year cycle, 1800-2199), and secrets: access keys and values assigned to names such as
password or token.

Everything is DataFrame expressions; nothing is shuffled. Nulls stay null with n_pii 0, empty texts stay empty. Texts of
any length are read whole. Rows are independent: repeated rows get the same text, an empty table gives an empty one.
Other columns pass through; an input column named n_pii or pii_kinds is replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fresh, others

ROUNDS = 8
#: Days of one Gregorian cycle, 1800-01-01 to 2199-12-31: 146,097 = 189 * 773.
DAYS, MAJOR, MINOR, FIRST_DAY = 146_097, 189, 773, "1800-01-01"

EMAIL = r"(?<![A-Za-z0-9._%+\-])[A-Za-z0-9._%+\-]++@[A-Za-z0-9\-]+(?:\.[A-Za-z0-9\-]+)*\.[A-Za-z]{2,}"
IBAN = r"\b[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?\b"
KEY = r"\b(?:AKIA|ASIA)[A-Z0-9]{16}\b|\b(?:ghp|gho|ghs)_[A-Za-z0-9]{36}\b|\bsk-[A-Za-z0-9]{20,}\b"
ASSIGNED = r"(?i:\b(?:password|passwd|pwd|secret|token|api_?key|access_?key|auth)\b[\"']? ?[=:] ?[\"']?)[A-Za-z0-9_+/\-]{8,}"
IPV4 = r"(?<![\d.])\d{1,3}(?:\.\d{1,3}){3}(?![\d.]*\d)"
DATE = r"(?<![\d\-/.])(?:\d{4}-\d{2}-\d{2}|\d{1,2}/\d{1,2}/\d{4}|\d{1,2}\.\d{1,2}\.\d{4})(?![\d\-/])"
SSN = r"(?<![\d\-])\d{3}-\d{2}-\d{4}(?![\d\-])"
CARD = r"(?<![\d\-])\d(?:[ \-]?\d){12,18}(?![\d\-])"
PHONE = r"(?<![\d+])(?:\+\d{1,3}[ .\-]?)?(?:\(\d{3}\) ?|\d{3}[ .\-])\d{3}[ .\-]\d{4}(?!\d)|(?<![\d+])\+\d{1,3}(?:[ .\-]?\d{2,4}){2,5}(?!\d)"
#: In order of precedence at one place.
KINDS = {"email": EMAIL, "iban": IBAN, "key": KEY, "assigned": ASSIGNED, "ipv4": IPV4, "date": DATE, "ssn": SSN, "card": CARD, "phone": PHONE}
#: At every place where one may begin: the longest text that has the form of a card or IBAN; and the least characters of one.
FORMS = {"card": (rf"(?<![\d\-])(?=({CARD}))\d+", 13), "iban": (rf"(?=({IBAN}))\b[A-Z]{{2}}\d{{2}}", 12)}


def feistel(values: Column, radix: Column, kind: str, key: str, back: bool = False) -> Column:
    """The permuted vector (array<int>); with back, its inverse. values[i] is below radix[i]."""
    n = F.size(values)
    h = F.floor(n / 2).cast("int")
    half = lambda x, first: F.slice(x, F.lit(1), h) if first else F.slice(x, h + 1, n - h)
    begin = F.struct(half(values, True).alias("a"), half(values, False).alias("b"), half(radix, True).alias("ra"), half(radix, False).alias("rb"))

    def pad(half: Column, r: Column, k: Column, sign: int, rest: Column, bound: Column) -> Column:
        digest = lambda block: F.sha2(F.concat_ws("|", F.lit(key), F.lit(kind), k.cast("string"), block.cast("string"), F.array_join(half.cast("array<string>"), ",")).cast("binary"), 256)
        number = lambda i: F.conv(F.substr(digest(F.floor(i / 8)), (F.pmod(i, F.lit(8)) * 8 + 1).cast("int"), F.lit(8)), 16, 10).cast("bigint")
        return F.transform(rest, lambda x, i: F.pmod(x + sign * number(i), F.get(bound, i)).cast("int"))

    if back:
        # a round took (a, b) to (b, a + pad(b))
        step = lambda s, k: F.struct(pad(s["a"], s["ra"], F.lit(ROUNDS - 1) - k, -1, s["b"], s["rb"]).alias("a"), s["a"].alias("b"), s["rb"].alias("ra"), s["ra"].alias("rb"))
    else:
        step = lambda s, k: F.struct(s["b"].alias("a"), pad(s["b"], s["rb"], k, 1, s["a"], s["ra"]).alias("b"), s["rb"].alias("ra"), s["ra"].alias("rb"))
    return F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), begin, step, lambda s: F.concat(s["a"], s["b"]))


def _chars(s: Column) -> Column:
    return F.split(s, "")


def _class(c: Column) -> tuple[Column, Column]:
    """A character's radix (1: kept) and first code."""
    return (
        F.when(c.rlike("[0-9]"), 10).when(c.rlike("[a-zA-Z]"), 26).otherwise(1),
        F.when(c.rlike("[0-9]"), 48).when(c.rlike("[a-z]"), 97).when(c.rlike("[A-Z]"), 65).otherwise(F.ascii(c)),
    )


def spelled(s: Column, kind: str, key: str, back: bool = False, hexadecimal: bool = True) -> Column:
    """A string with its digits and letters permuted within their classes (all within 0-9a-f if it is lower-case hexadecimal); other characters stay."""
    by_class = feistel(F.transform(_chars(s), lambda c: F.when(_class(c)[0] == 1, 0).otherwise(F.ascii(c) - _class(c)[1])), F.transform(_chars(s), lambda c: _class(c)[0]), kind, key, back)
    plain = F.array_join(F.zip_with(by_class, _chars(s), lambda v, c: F.when(_class(c)[0] == 1, c).otherwise(F.char(v + _class(c)[1]))), "")
    if not hexadecimal:
        return plain
    as_hex = feistel(F.transform(_chars(s), lambda c: F.conv(c, 16, 10).cast("int")), F.transform(_chars(s), lambda c: F.lit(16)), kind, key, back)
    return F.when(s.rlike("^[0-9a-f]{12,}$"), F.array_join(F.transform(as_hex, lambda v: F.lower(F.hex(v))), "")).otherwise(plain)


def _digits(s: Column) -> Column:
    return F.regexp_replace(s, "[^0-9]", "")


def _numbers(s: Column) -> Column:
    return F.transform(_chars(s), lambda c: c.cast("int"))


def _fill(shape: Column, digits: Column) -> Column:
    """shape with its digits replaced by those of a string of digits, one after the other; each separator is short, so its place is kept by counting the digits before it."""
    chars = _chars(shape)
    place = lambda i: F.size(F.filter(F.slice(chars, F.lit(1), i + 1), lambda c: c.rlike("[0-9]")))
    return F.array_join(F.transform(chars, lambda c, i: F.when(c.rlike("[0-9]"), F.substr(digits, place(i), F.lit(1))).otherwise(c)), "")


def _luhn(body: Column) -> Column:
    """The check digit for a string of digits."""
    total = F.aggregate(F.transform(F.reverse(_numbers(body)), lambda d, i: F.when(i % 2 == 1, d).when(d > 4, 2 * d - 9).otherwise(2 * d)), F.lit(0), lambda a, x: a + x)
    return F.pmod(10 - total % 10, F.lit(10)).cast("string")


def _mod97(s: Column) -> Column:
    """The remainder of letters (10-35) and digits read as one number."""
    return F.aggregate(_chars(s), F.lit(0).cast("bigint"), lambda a, c: F.when(c.rlike("[0-9]"), (a * 10 + c.cast("int")) % 97).otherwise((a * 100 + F.ascii(c) - 55) % 97))


def _card(m: Column, key: str, back: bool) -> Column:
    d = _digits(m)
    n = F.length(d)
    body = F.substr(d, F.lit(1), n - 1)
    inner = feistel(F.slice(_numbers(body), F.lit(2), n - 2), F.transform(F.slice(_numbers(body), F.lit(2), n - 2), lambda _: F.lit(10)), "card", key, back)
    new = F.concat(F.substr(d, F.lit(1), F.lit(1)), F.array_join(inner.cast("array<string>"), ""))
    return F.when(_luhn(body) == F.substr(d, n, F.lit(1)), _fill(m, F.concat(new, _luhn(new))))


def _iban(m: Column, key: str, back: bool) -> Column:
    s = F.regexp_replace(m, " ", "")
    land, body = F.substr(s, F.lit(1), F.lit(2)), F.substring(s, 5, 40)
    new = spelled(body, "iban", key, back, hexadecimal=False)
    check = F.lpad((98 - _mod97(F.concat(new, land, F.lit("00")))).cast("string"), 2, "0")
    out = F.concat(land, check, new)
    chars = _chars(m)
    at = lambda i: F.size(F.filter(F.slice(chars, F.lit(1), i + 1), lambda c: c != " "))
    spaced = F.array_join(F.transform(chars, lambda c, i: F.when(c == " ", c).otherwise(F.substr(out, at(i), F.lit(1)))), "")
    return F.when(_mod97(F.concat(body, F.substr(s, F.lit(1), F.lit(4)))) == 1, spaced)


def _ssn(m: Column, key: str, back: bool) -> Column:
    a, g, s = (F.substring(m, *x).cast("int") for x in ((1, 3), (5, 2), (8, 4)))
    place = F.when(a > 666, a - 2).otherwise(a - 1)  # 001-665 and 667-899
    v = feistel(F.array(place, g - 1, s - 1), F.array(F.lit(898), F.lit(99), F.lit(9999)), "ssn", key, back)
    return F.when((a > 0) & (a != 666) & (a < 900) & (g > 0) & (s > 0), F.aggregate(F.array(v), F.lit(""), lambda _, w: F.format_string("%03d-%02d-%04d", F.when(F.get(w, F.lit(0)) >= 665, F.get(w, F.lit(0)) + 2).otherwise(F.get(w, F.lit(0)) + 1), F.get(w, F.lit(1)) + 1, F.get(w, F.lit(2)) + 1)))


def _ipv4(m: Column, key: str, back: bool) -> Column:
    octets = F.transform(F.split(m, r"\."), lambda x: x.cast("int"))
    new = F.array_join(feistel(octets, F.transform(octets, lambda _: F.lit(256)), "ipv4", key, back).cast("array<string>"), ".")
    return F.when(F.forall(octets, lambda x: x < 256) & ~F.exists(F.split(m, r"\."), lambda x: x.rlike("^0.")), new)


def _date(m: Column, key: str, back: bool) -> Column:
    parts = F.split(m, r"[\-/.]")
    iso, at = m.rlike("^[0-9]{4}-"), lambda i: F.get(parts, F.lit(i))
    slash = m.contains("/")
    text = F.when(iso, m).when(slash & (at(0).cast("int") <= 12), F.concat_ws("-", at(2), F.lpad(at(0), 2, "0"), F.lpad(at(1), 2, "0"))).otherwise(F.concat_ws("-", at(2), F.lpad(at(1), 2, "0"), F.lpad(at(0), 2, "0")))
    # a month-first date stays one: its pseudonym's day and month are written in the same order
    month_first = slash & (at(0).cast("int") <= 12)
    day = F.datediff(F.try_to_date(text, "yyyy-MM-dd"), F.lit(FIRST_DAY).cast("date"))
    v = feistel(F.array(F.floor(day / MINOR).cast("int"), F.pmod(day, F.lit(MINOR))), F.array(F.lit(MAJOR), F.lit(MINOR)), "date", key, back)
    new = F.aggregate(F.array(v), F.lit(FIRST_DAY).cast("date"), lambda _, w: F.date_add(F.lit(FIRST_DAY).cast("date"), F.get(w, F.lit(0)) * MINOR + F.get(w, F.lit(1))))
    out = F.when(iso, F.date_format(new, "yyyy-MM-dd")).when(month_first, F.date_format(new, "MM/dd/yyyy")).when(slash, F.date_format(new, "dd/MM/yyyy")).otherwise(F.date_format(new, "dd.MM.yyyy"))
    return F.when((day >= 0) & (day < DAYS), out)


def _phone(m: Column, key: str, back: bool) -> Column:
    head = F.regexp_extract(m, r"^\+\d{1,3}(?=[ .\-(])[ .\-]?|^\+\d", 0)
    rest = F.substr(m, F.length(head) + 1, F.length(m))
    d = _numbers(_digits(rest))
    # the first digit stays within 2-9 or 0-1, as it was
    first = F.transform(d, lambda x, i: F.when((i == 0) & (x >= 2), x - 2).otherwise(x))
    radix = F.transform(d, lambda x, i: F.when(i > 0, 10).when(x >= 2, 8).otherwise(2))
    v = feistel(first, radix, "phone", key, back)
    new = F.zip_with(v, F.transform(d, lambda x, i: F.when((i == 0) & (x >= 2), 2).otherwise(0)), lambda x, y: (x + y).cast("string"))
    return F.concat(head, _fill(rest, F.array_join(new, "")))


def _email(m: Column, key: str, back: bool) -> Column:
    stem = F.regexp_replace(m, r"\.[A-Za-z]+$", "")
    return F.concat(spelled(stem, "email", key, back, hexadecimal=False), F.regexp_extract(m, r"\.[A-Za-z]+$", 0))


def _key(m: Column, key: str, back: bool) -> Column:
    head = F.regexp_extract(m, r"^(?:AKIA|ASIA|gh[pos]_|sk-)", 0)
    return F.concat(head, spelled(F.substr(m, F.length(head) + 1, F.length(m)), "key", key, back))


def _assigned(m: Column, key: str, back: bool) -> Column:
    value = F.regexp_extract(m, r"[A-Za-z0-9_+/\-]{8,}$", 0)
    value = F.when(F.regexp_extract(m, r"[=:] ?[\"']?(.+)$", 1) != "", F.regexp_extract(m, r"[=:] ?[\"']?(.+)$", 1)).otherwise(value)
    return F.concat(F.substr(m, F.lit(1), F.length(m) - F.length(value)), spelled(value, "assigned", key, back))


RULES = {"email": _email, "iban": _iban, "key": _key, "assigned": _assigned, "ipv4": _ipv4, "date": _date, "ssn": _ssn, "card": _card, "phone": _phone}


def _holds(m: Column, kind: str) -> Column:
    """Whether the check digits of a card or IBAN are right."""
    s = F.regexp_replace(m, "[ \\-]", "")
    if kind == "iban":
        return _mod97(F.concat(F.substring(s, 5, 40), F.substr(s, F.lit(1), F.lit(4)))) == 1
    return _luhn(F.substr(s, F.lit(1), F.length(s) - 1)) == F.substr(s, F.length(s), F.lit(1))


def _readings(t: Column, kind: str) -> Column:
    """A pattern of the cards or IBANs in a text: at each place the longest reading, ending with a group of characters, whose check digits are right."""
    form, least = FORMS[kind]
    inside = lambda m, i: F.substr(m, i, F.lit(1)).rlike("[0-9A-Z]")
    ends = lambda m: F.reverse(F.filter(F.sequence(F.lit(least), F.length(m)), lambda i: inside(m, i) & ~inside(m, i + 1)))
    prefixes = lambda m: F.transform(ends(m), lambda i: F.substr(m, F.lit(1), i))
    right = lambda m: F.get(F.filter(prefixes(m), lambda s: (F.length(F.regexp_replace(s, "[ \\-]", "")) >= least) & _holds(s, kind)), F.lit(0))
    found = F.filter(F.transform(F.array_distinct(F.regexp_extract_all(t, F.lit(form), F.lit(1))), right), lambda s: s.isNotNull())
    longest = F.transform(F.sort_array(F.transform(F.array_distinct(found), lambda s: F.struct((-F.length(s)).alias("n"), s.alias("s")))), lambda x: x["s"])
    before, after = (r"(?<![\d\-])", r"(?!\d)") if kind == "card" else (r"\b", r"\b")
    return F.when(F.size(longest) > 0, F.concat(F.lit(f"{before}(?:"), F.array_join(longest, "|"), F.lit(f"){after}"))).otherwise(F.lit("(?!)"))


def any_of(t: Column) -> Column:
    """The pattern of all values in a text."""
    return F.concat_ws("|", *(F.concat(F.lit("(?:"), _readings(t, k) if k in FORMS else F.lit(p), F.lit(")")) for k, p in KINDS.items()))


def kind_of(m: Column) -> Column:
    """The first kind whose pattern a match fits."""
    kind = F.lit(None).cast("string")
    for name, pattern in reversed(KINDS.items()):
        kind = F.when(m.rlike(f"^(?:{pattern})$"), F.lit(name)).otherwise(kind)
    return kind


def pseudonym(m: Column, kind: Column, key: str, back: bool = False) -> Column:
    """The replacement of a match of some kind; null if its rule does not hold."""
    out = F.lit(None).cast("string")
    for name, rule in RULES.items():
        out = F.when(kind == name, rule(m, key, back)).otherwise(out)
    return out


def protect(df: DataFrame, key: str, text: str = "text", back: bool = False) -> DataFrame:
    """df with text replaced, n_pii (values replaced) and pii_kinds (their kinds, in order). key: the secret; back: undo."""
    pattern, values = fresh(df, "_any", "_pii")
    t, p, v = F.col(text), F.col(pattern), F.col(values)
    maybe = t.rlike("[@0-9=:]")
    found = F.when(maybe, F.regexp_extract_all(t, p, F.lit(0))).otherwise(F.array().cast("array<string>"))
    new = F.transform(F.transform(found, lambda m: F.struct(m.alias("old"), kind_of(m).alias("kind"))), lambda x: F.struct(x["old"].alias("old"), x["kind"].alias("kind"), pseudonym(x["old"], x["kind"], key, back).alias("new")))
    kept = others(df, "n_pii", "pii_kinds")
    held = df.select(*kept, F.when(maybe, any_of(t)).alias(pattern)).select(*kept, p, new.alias(values))
    joined = F.array_join(F.zip_with(F.split(t, p, -1), F.transform(v, lambda x: F.coalesce(x["new"], x["old"])), lambda a, b: F.concat(a, F.coalesce(b, F.lit("")))), "")
    done = F.filter(v, lambda x: x["new"].isNotNull())
    out = F.when(F.size(v) > 0, joined).otherwise(t).alias(text)
    cols = [out if c.lower() == text.lower() else F.col(f"`{c}`") for c in held.columns if c not in (pattern, values)]
    return held.select(*cols, F.greatest(F.size(done), F.lit(0)).cast("bigint").alias("n_pii"), F.transform(done, lambda x: x["kind"]).alias("pii_kinds"))
