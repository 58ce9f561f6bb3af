"""Personal data replaced by format-preserving pseudonyms, in DataFrame functions only.

Candidates are found by one regular expression and validated: card numbers by Luhn's
check, addresses by their octets, social security numbers by their ranges, dates by
the calendar. A valid number or date is mapped to an index in the set of all valid
values of its format and permuted there by a Feistel network keyed with a secret;
its separators stay where they are, and a card's check digit is computed anew. The
permutation is a bijection, so equal values have equal pseudonyms in all documents
and different values different ones. E-mail addresses and credentials have no such
numeric domain; keyed digests of the same kind of text take their place.

The main path is a narrow projection (no shuffle, no Python). Texts without digit,
``@`` and the opening of an access key skip all of it.

Cases: null text stays null with n_pii 0; empty text stays empty; invalid candidates
stay as they are; repeated rows give repeated results; any character may stand in
the text (the marker character is escaped); a very long text takes time in proportion
to its length; other columns are not looked at and stay, but for one with the name of the
count, which the count replaces; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ROUNDS = 8

# One alternative a kind; the first that matches at a place counts.
EMAIL = r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+"
ACCESS_KEY = r"(?<![A-Za-z0-9])AKIA[0-9A-Z]{16}(?![A-Za-z0-9])"
CREDENTIAL = r"""(?<![A-Za-z0-9])(?i:password|passwd|secret|token|api_?key)\s{0,3}[=:]\s{0,3}["']?(?=[^\s"']*[0-9])[A-Za-z0-9_/+.\-]{8,}+["']?"""
PHONE = r"(?<![\w+])(?:\+\d{1,3}[ .-]?)?(?:\(\d{3}\)[ .-]?|\d{3}[ .-])\d{3}[ .-]\d{4}(?!\w)"
ADDRESS = r"(?<![\w.])(?:\d{1,3}\.){3}\d{1,3}(?!\w|\.\d)"
SOCIAL = r"(?<![\w-])\d{3}-\d{2}-\d{4}(?![\w-])"
ISO_DATE = r"(?<![\w-])(?:19|20)\d{2}-\d{2}-\d{2}(?![\w-])"
SLASH_DATE = r"(?<![\w/])\d{1,2}/\d{1,2}/(?:19|20)\d{2}(?![\w/])"
CARD = r"(?<![\w-])(?:\d{13,19}|\d{4}[ -]\d{4}(?:[ -]\d{4}){2}|\d{4}[ -]\d{6}[ -]\d{5})(?![\w-])"
ANY = "|".join((EMAIL, ACCESS_KEY, CREDENTIAL, PHONE, ADDRESS, SOCIAL, ISO_DATE, SLASH_DATE, CARD))

_MARK = "\u0001"


def _digits(x: Column) -> Column:
    return F.regexp_replace(x, "[^0-9]", "")


def _number(x: Column) -> Column:
    return x.try_cast("bigint")


def _div(x: Column, y: Column) -> Column:
    """Whole-number division (``/`` would go through double and lose digits)."""
    return F.call_function("div", x, y)


def _keyed(key: str, what: str, x: Column) -> Column:
    """Hex HMAC-SHA-256 of ``x`` (and of what it is for) under ``key``."""
    raw = key.encode()
    block = (hashlib.sha256(raw).digest() if len(raw) > 64 else raw).ljust(64, b"\0")
    inner, outer = (F.lit(bytearray(b ^ pad for b in block)) for pad in (0x36, 0x5C))
    message = F.concat(F.lit(f"{what}|"), x.cast("string")).cast("binary")
    return F.sha2(F.concat(outer, F.unhex(F.sha2(F.concat(inner, message), 256))), 256)


def feistel(value: Column, a: Column | int, b: Column | int, key: str, what: str) -> Column:
    """A keyed permutation of 0 .. a * b - 1: halves of radix a and b, changed in turn by a keyed digest of the other."""
    a, b = (x if isinstance(x, Column) else F.lit(x).cast("bigint") for x in (a, b))

    def step(s: Column, k: Column) -> Column:
        half = F.when(k % 2 == 0, s["r"]).otherwise(s["l"])
        # 60 bits of the digest: far more than any radix, so the remainder is as good as even
        word = F.conv(F.substring(_keyed(key, what, F.concat(k.cast("string"), F.lit("|"), half.cast("string"))), 1, 15), 16, 10).cast("bigint")
        left = F.when(k % 2 == 0, (s["l"] + word % a) % a).otherwise(s["l"])
        right = F.when(k % 2 == 0, s["r"]).otherwise((s["r"] + word % b) % b)
        return F.struct(left.alias("l"), right.alias("r"))

    start = F.struct(_div(value, b).alias("l"), (value % b).alias("r"))
    return F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), start, step, lambda s: s["l"] * b + s["r"])


def luhn_sum(digits: Column, shift: int) -> Column:
    """Luhn's sum; ``shift`` 0: the last digit is the check digit, 1: it is still missing."""
    n = F.length(digits)

    def add(total: Column, i: Column) -> Column:
        d = _number(F.substr(digits, n - i, F.lit(1)))
        twice = F.when(d >= 5, d * 2 - 9).otherwise(d * 2)
        return total + F.when((i + shift) % 2 == 1, twice).otherwise(d)

    return F.aggregate(F.sequence(F.lit(0), n - 1), F.lit(0).cast("bigint"), add)


def refill(x: Column, digits: Column) -> Column:
    """``x`` with its digits replaced in order by ``digits``; everything else stays in place."""

    def one(i: Column) -> Column:
        c = F.substr(x, i, F.lit(1))
        return F.when(c.between("0", "9"), F.substr(digits, F.length(_digits(F.substr(x, F.lit(1), i))), F.lit(1))).otherwise(c)

    return F.array_join(F.transform(F.sequence(F.lit(1), F.length(x)), one), "")


def _padded(value: Column, width: Column | int) -> Column:
    return F.lpad(value.cast("string"), width, F.lit("0")) if isinstance(width, Column) else F.lpad(value.cast("string"), width, "0")


def _card(x: Column, key: str) -> Column:
    d = _digits(x)
    m = F.length(d) - 1  # without the check digit
    low = (m / 2).cast("int")
    power = lambda n: F.pow(F.lit(10.0), n).cast("bigint")  # noqa: E731  exact up to 10^9
    payload = _padded(feistel(_number(F.substr(d, F.lit(1), m)), power(m - low), power(low), key, "card"), m)
    check = (F.lit(10) - luhn_sum(payload, 1) % 10) % 10
    return F.when(luhn_sum(d, 0) % 10 == 0, refill(x, F.concat(payload, check.cast("string")))).otherwise(x)


def _phone(x: Column, key: str) -> Column:
    d = _digits(x)
    number = _number(F.substring(d, -10, 10))
    two = F.lit(2_000_000_000).cast("bigint")
    new = F.when(number >= two, feistel(number - two, 80_000, 100_000, key, "phone") + two).otherwise(feistel(number, 20_000, 100_000, key, "phone0"))
    return refill(x, F.concat(F.substr(d, F.lit(1), F.length(d) - 10), _padded(new, 10)))


def _address(x: Column, key: str) -> Column:
    octet = [_number(F.element_at(F.split(x, r"\."), i + 1)) for i in range(4)]
    value = feistel(((octet[0] * 256 + octet[1]) * 256 + octet[2]) * 256 + octet[3], 65_536, 65_536, key, "address")
    out = F.concat_ws(".", *(F.shiftright(value, 24 - 8 * i).bitwiseAND(F.lit(255).cast("bigint")).cast("string") for i in range(4)))
    return F.when((octet[0] < 256) & (octet[1] < 256) & (octet[2] < 256) & (octet[3] < 256), out).otherwise(x)


def _social(x: Column, key: str) -> Column:
    area, group, serial = (_number(F.element_at(F.split(x, "-"), i)) for i in (1, 2, 3))
    valid = area.between(1, 899) & (area != 666) & (group > 0) & (serial > 0)
    value = feistel(((area - 1 - F.when(area > 666, 1).otherwise(0)) * 99 + group - 1) * 9_999 + serial - 1, 898, 99 * 9_999, key, "social")
    rest = value % (99 * 9_999)
    index = _div(value, F.lit(99 * 9_999).cast("bigint"))
    new_area = index + 1 + F.when(index >= 665, 1).otherwise(0)
    new_serial = rest % 9_999
    new_group = _div(rest, F.lit(9_999).cast("bigint")) + 1
    return F.when(valid, F.concat_ws("-", _padded(new_area, 3), _padded(new_group, 2), _padded(new_serial + 1, 4))).otherwise(x)


def _date(day: Column, x: Column, key: str, pattern: Column | str) -> Column:
    """``day``: the date, null if ``x`` is none. All days of 1900 to 2099 are 73,049 = 319 x 229."""
    first = F.to_date(F.lit("1900-01-01"))
    new = F.date_add(first, feistel(F.datediff(day, first).cast("bigint"), 319, 229, key, "date").cast("int"))
    y, m, d = F.year(new), F.month(new), F.dayofmonth(new)
    if pattern == "iso":
        out = F.concat_ws("-", _padded(y, 4), _padded(m, 2), _padded(d, 2))
    else:
        short = F.length(x) < 10
        part = lambda v: F.when(short, v.cast("string")).otherwise(_padded(v, 2))
        one, two = (m, d) if pattern == "mdy" else (d, m)
        out = F.concat_ws("/", part(one), part(two), _padded(y, 4))
    return F.when(day.isNull(), x).otherwise(out)


def _slash(x: Column, key: str) -> Column:
    part = F.split(x, "/")
    try_date = lambda m, d: F.try_to_timestamp(F.concat_ws("-", F.element_at(part, 3), F.lpad(m, 2, "0"), F.lpad(d, 2, "0")), F.lit("yyyy-MM-dd")).cast("date")
    mdy, dmy = try_date(F.element_at(part, 1), F.element_at(part, 2)), try_date(F.element_at(part, 2), F.element_at(part, 1))
    return F.when(mdy.isNotNull(), _date(mdy, x, key, "mdy")).otherwise(_date(dmy, x, key, "dmy"))


def _email(x: Column, key: str) -> Column:
    h = _keyed(key, "email", F.lower(x))
    return F.concat(F.lit("u"), F.substring(h, 1, 12), F.lit("@d"), F.substring(h, 13, 8), F.lit(".example"))


def pseudonym(x: Column, key: str) -> Column:
    """The pseudonym of one candidate (``x`` itself if it isn't valid)."""
    whole = lambda p: x.rlike(f"^(?:{p})$")
    secret = _keyed(key, "secret", x)
    iso = F.try_to_timestamp(x, F.lit("yyyy-MM-dd")).cast("date")
    return (
        F.when(F.contains(x, F.lit("@")), _email(x, key))
        .when(x.startswith("AKIA"), F.concat(F.lit("AKIA"), F.upper(F.substring(secret, 1, 16))))
        .when(x.rlike("^[A-Za-z]"), F.concat(F.regexp_extract(x, r"^[A-Za-z_]+\s*[=:]\s*", 0), F.lit("[SECRET-"), F.substring(secret, 1, 12), F.lit("]")))
        .when(whole(PHONE), _phone(x, key))
        .when(whole(ADDRESS), _address(x, key))
        .when(whole(SOCIAL), _social(x, key))
        .when(whole(ISO_DATE), _date(iso, x, key, "iso"))
        .when(F.contains(x, F.lit("/")), _slash(x, key))
        .otherwise(_card(x, key))
    )


def pseudonymise_columns(text: Column, key: str) -> Column:
    """A struct (text, n) of the text with pseudonyms and the number of values replaced."""
    escaped = F.replace(text, F.lit(_MARK), F.lit(_MARK + "e"))
    marked = F.regexp_replace(escaped, f"({ANY})", _MARK + "d$1" + _MARK + "d")
    parts = F.when(text.rlike("[0-9@]|AKIA"), F.split(marked, _MARK + "d", -1)).otherwise(F.array(escaped))
    return F.transform(parts, lambda x, i: F.when(i % 2 == 1, F.struct(x.alias("was"), pseudonym(x, key).alias("now"))).otherwise(F.struct(x.alias("was"), x.alias("now"))))


def pseudonymise(docs: DataFrame, key: str, column: str = "text", count: str = "n_pii") -> DataFrame:
    """``docs`` with the personal data in ``column`` replaced, and how many values were, in ``count``."""
    if not key:
        raise ValueError("a secret key is needed")
    held = "__parts"
    while held in docs.columns:
        held += "_"
    out = docs.withColumn(held, pseudonymise_columns(F.col(column).cast("string"), key))
    changed = F.aggregate(F.col(held), F.lit(0).cast("bigint"), lambda n, x: n + F.when(x["was"] != x["now"], 1).otherwise(0))
    text = F.replace(F.array_join(F.transform(F.col(held), lambda x: x["now"]), ""), F.lit(_MARK + "e"), F.lit(_MARK))
    text = F.when(F.col(column).isNotNull(), text)
    return out.withColumns({column: text, count: F.coalesce(changed, F.lit(0).cast("bigint"))}).drop(held)
