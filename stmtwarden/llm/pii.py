"""Format-preserving pseudonyms for personal data, in DataFrame functions only.

Numbers and dates that pass their check are permuted within their format by a
keyed Feistel network on two digit groups (sums modulo the groups' sizes, so
every value of the format has exactly one pseudonym of the format and equal
values stay linked across documents). Mail addresses and secrets, which are not
numbers, get a keyed hash in their own alphabet. What fails its check is left
alone.

The key travels in the plan: keep plans and event logs as safe as the key, and
pass one of your own; the default is for tests.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stmtwarden.llm.common import free_name

KEY = "test key, replace"
ROUNDS = 10
#: Days from this one on that dates are permuted among: 365 x 400.
FIRST_DAY, DAY_GROUPS = "1700-01-01", (365, 400)

EMAIL = r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9_%+-][A-Za-z0-9._%+-]{0,63}+@[A-Za-z0-9-]{1,63}+(?:\.[A-Za-z0-9-]{1,63}+)+"
#: After a password's key any value counts: to the quote or the line's end, or unquoted to the next space, quote or angle bracket. After the other keys, 12 characters or more of the alphabet of tokens.
PASSWORD = r"(?i:(?<![A-Za-z0-9])(?:password|passwd))[\"']?\s{0,4}+[=:]\s{0,4}+(?:[\"'][^\"'\r\n]++|[^\s\"'<>]++)"
SECRET = rf"(?:{PASSWORD}|(?i:(?<![A-Za-z0-9])(?:token|secret|api[_-]?key|access[_-]?key))[\"']?\s{{0,4}}+[=:]\s{{0,4}}+[\"']?[A-Za-z0-9_/+.-]{{12,}}+)"
IP = r"(?<![\d.])\d{1,3}(?:\.\d{1,3}){3}(?![\d]|\.\d)"
DATE = r"(?<![\d/.-])(?:\d{4}-\d{2}-\d{2}|\d{2}/\d{2}/\d{4}|\d{2}\.\d{2}\.\d{4})(?![\d/-])"
SSN = r"(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-])"
CARD = r"(?<![\d-])\d(?:[ -]?\d){12,18}(?![\d]|-\d)"
PHONE = r"(?<![\w+])(?:\+?1[ .-]?)?(?:\(\d{3}\)[ .-]?|\d{3}[ .-])\d{3}[ .-]\d{4}(?!\d)|(?<![\w+])\+\d{1,3}(?:[ .-]?\d{2,4}){2,5}(?!\d)"
#: The alternatives by the character they may start with, so that most positions of a text are passed over at once.
ANY = rf"(?=[\d+(])(?:{IP}|{DATE}|{SSN}|{PHONE}|{CARD})|(?=[A-Za-z0-9_%+-])(?<![A-Za-z0-9._%+-])(?:{EMAIL}|{SECRET})"
KINDS = ["email", "secret", "ip", "date", "ssn", "card", "phone"]


def keyed(key: str, *parts: Column) -> Column:
    """A keyed number below 2^60."""
    return F.conv(F.substring(F.sha2(F.concat_ws("|", F.lit(key), *[p.cast("string") for p in parts]), 256), 1, 15), 16, 10).cast("long")


def feistel(left: Column, right: Column, a: Column | int, b: Column | int, key: str, tag: str | Column) -> Column:
    """A keyed permutation of the pairs (left below ``a``, right below ``b``): struct (l, r)."""
    a, b = (x if isinstance(x, Column) else F.lit(x) for x in (a, b))
    tag = tag if isinstance(tag, Column) else F.lit(tag)
    start = F.struct(left.cast("long").alias("l"), right.cast("long").alias("r"))

    def step(acc: Column, i: Column) -> Column:
        l_, r_ = acc["l"], acc["r"]
        even = F.pmod(l_ + keyed(key, tag, i, r_), a.cast("long"))
        odd = F.pmod(r_ + keyed(key, tag, i, l_), b.cast("long"))
        return F.struct(F.when(i % 2 == 0, even).otherwise(l_).alias("l"), F.when(i % 2 == 1, odd).otherwise(r_).alias("r"))

    return F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), start, step)


def power10(n: Column) -> Column:
    return F.rpad(F.lit("1"), n + 1, "0").cast("long")


def permuted_digits(digits: Column, key: str, tag: str) -> Column:
    """Another string of as many digits; 2 to 36 of them."""
    n = F.length(digits)
    h = F.floor(n / 2).cast("int")
    out = feistel(F.substr(digits, F.lit(1), h), F.substr(digits, h + 1), power10(h), power10(n - h), key, F.concat(F.lit(tag), n.cast("string")))
    return F.concat(F.lpad(out["l"].cast("string"), h, "0"), F.lpad(out["r"].cast("string"), n - h, "0"))


def in_format(value: Column, digits: Column) -> Column:
    """``value`` with its digits replaced in order."""
    gaps = F.split(value, "[0-9]", -1)
    return F.array_join(F.zip_with(gaps, F.split(digits, "(?<=.)(?=.)"), lambda g, d: F.concat(g, F.coalesce(d, F.lit("")))), "")


def luhn_sum(digits: Column) -> Column:
    """The sum over digits, every second from the right (the second first) doubled."""
    each = F.transform(F.split(F.reverse(digits), "(?<=.)(?=.)"), lambda d, i: F.when(i % 2 == 0, d.cast("int")).otherwise(F.pmod(2 * d.cast("int"), F.lit(10)) + F.floor(d.cast("int") / 5).cast("int")))
    return F.aggregate(each, F.lit(0), lambda s, d: s + d)


def card(value: Column, key: str) -> Column:
    d = F.regexp_replace(value, "[^0-9]", "")
    body = permuted_digits(F.substr(d, F.lit(1), F.length(d) - 1), key, "card")
    check = F.pmod(10 - luhn_sum(F.concat(body, F.lit("0"))) % 10, F.lit(10))
    valid = F.length(d).between(13, 19) & (luhn_sum(d) % 10 == 0)
    return F.when(valid, in_format(value, F.concat(body, check.cast("string"))))


def phone(value: Column, key: str) -> Column:
    """The last ten digits (or all, if fewer follow a country code) are permuted; a leading country code stays."""
    d = F.regexp_replace(value, "[^0-9]", "")
    n = F.least(F.length(d), F.lit(10))
    head = F.substr(d, F.lit(1), F.length(d) - n)
    return F.when(F.length(d).between(8, 16), in_format(value, F.concat(head, permuted_digits(F.right(d, n), key, "phone"))))


def ip(value: Column, key: str) -> Column:
    o = F.transform(F.split(value, r"\."), lambda x: x.cast("int"))
    p = feistel(o[0] * 256 + o[1], o[2] * 256 + o[3], 65536, 65536, key, "ip")
    octets = [F.floor(p["l"] / 256), p["l"] % 256, F.floor(p["r"] / 256), p["r"] % 256]
    return F.when(F.array_max(o) < 256, F.concat_ws(".", *[x.cast("string") for x in octets]))


def ssn(value: Column, key: str) -> Column:
    """Areas 001-665 and 667-899, groups 01-99, serials 0001-9999; nothing else is valid."""
    area, group, serial = F.substring(value, 1, 3).cast("int"), F.substring(value, 5, 2).cast("int"), F.substring(value, 8, 4).cast("int")
    valid = area.between(1, 899) & (area != 666) & (group > 0) & (serial > 0)
    nth = area - 1 - F.when(area > 666, 1).otherwise(0)
    p = feistel(nth, (group - 1) * 9999 + serial - 1, 898, 99 * 9999, key, "ssn")
    new_area = p["l"] + 1 + F.when(p["l"] >= 665, 1).otherwise(0)
    new = F.concat_ws("-", F.lpad(new_area.cast("string"), 3, "0"), F.lpad((F.floor(p["r"] / 9999) + 1).cast("string"), 2, "0"), F.lpad((p["r"] % 9999 + 1).cast("string"), 4, "0"))
    return F.when(valid, new)


def day(value: Column, key: str) -> Column:
    """Dates that exist, as year-month-day or day-month-year, within 146 000 days of 1700-01-01."""
    p = F.split(value, "[-/.]")
    year_first = F.substring(value, 5, 1) == "-"
    y, m, d = (F.when(year_first, p[i]).otherwise(p[2 - i]) for i in range(3))
    date = F.try_to_date(F.concat_ws("-", y, m, d), "yyyy-MM-dd")
    n = F.datediff(date, F.lit(FIRST_DAY).cast("date"))
    a, b = DAY_GROUPS
    q = feistel(F.floor(n / b), n % b, a, b, key, "date")
    new = F.date_add(F.lit(FIRST_DAY).cast("date"), (q["l"] * b + q["r"]).cast("int"))
    iso, sep = F.date_format(new, "yyyy-MM-dd"), F.substring(value, 3, 1)
    back = F.concat(F.substring(iso, 9, 2), sep, F.substring(iso, 6, 2), sep, F.substring(iso, 1, 4))
    return F.when(n.between(0, a * b - 1), F.when(year_first, iso).otherwise(back))


def email(value: Column, key: str) -> Column:
    """Local part and domain become keyed hexadecimal words of their own; the last label stays."""
    v = F.lower(value)
    h = F.sha2(F.concat(F.lit(f"{key}|email|"), v), 256)
    host = F.sha2(F.concat(F.lit(f"{key}|host|"), F.regexp_extract(v, "@(.*)$", 1)), 256)
    return F.concat(F.lit("u"), F.substring(h, 1, 14), F.lit("@h"), F.substring(host, 1, 8), F.regexp_extract(v, r"(\.[a-z0-9-]+)$", 1))


def secret(value: Column, key: str) -> Column:
    """The value after the sign, whatever its length, replaced by as many keyed hexadecimal digits."""
    parts = r"(?s)^([^=:]*[=:]\s*[\"']?)(.+)$"
    head, body = F.regexp_extract(value, parts, 1), F.regexp_extract(value, parts, 2)
    chunks = F.transform(F.sequence(F.lit(0), F.floor(F.length(body) / 64).cast("int")), lambda i: F.sha2(F.concat(F.lit(f"{key}|secret|"), i.cast("string"), body), 256))
    return F.concat(head, F.substr(F.array_join(chunks, ""), F.lit(1), F.length(body)))


MAKERS = {"email": (EMAIL, email), "secret": (SECRET, secret), "ip": (IP, ip), "date": (DATE, day), "ssn": (SSN, ssn), "card": (CARD, card), "phone": (PHONE, phone)}


def pseudonym(value: Column, key: str) -> Column:
    """struct (kind, new): the pseudonym of one found string, or nulls when no check passes."""
    out = F.struct(F.lit(None).cast("string").alias("kind"), F.lit(None).cast("string").alias("new"))
    tests = {
        "email": value.contains("@") & ~value.rlike("[=:]"), "secret": value.rlike("[=:]"), "ip": value.rlike(f"^(?:{IP})$"), "date": value.rlike(f"^(?:{DATE})$"),
        "ssn": value.rlike(f"^(?:{SSN})$"), "card": value.rlike(f"^(?:{CARD})$"), "phone": value.rlike(f"^(?:{PHONE})$"),
    }
    for kind in reversed(KINDS):
        new = MAKERS[kind][1](value, key)
        # what fails the check of a card may still be a phone number
        hit = tests[kind] & new.isNotNull() if kind == "card" else tests[kind]
        out = F.when(hit, F.struct(F.when(new.isNotNull(), F.lit(kind)).alias("kind"), new.alias("new"))).otherwise(out)
    return out


def _equals(kind: str):
    return lambda x: F.coalesce(x == kind, F.lit(False))


def pseudonymised(docs: DataFrame, key: str = KEY, counts: str | None = None) -> DataFrame:
    """``docs`` with ``text`` replaced; its other columns stay as they are.

    Null texts stay null, empty ones empty. Equal values get equal pseudonyms
    wherever they stand. ``counts`` names a map column kind -> number of
    replacements to add.
    """
    found, gaps, made = (free_name(docs, f"{x}_{counts or ''}") for x in ("found", "gaps", "made"))
    text = F.col("text").cast("string")
    may = text.rlike("[0-9@]") | text.rlike("[A-Za-z][\"']?\\s{0,4}[=:]")
    out = docs.withColumns({found: F.when(may, F.regexp_extract_all(text, F.lit(f"({ANY})"), F.lit(1)))})
    out = out.withColumn(gaps, F.when(F.size(found) > 0, F.split(text, ANY, -1)))
    out = out.withColumn(made, F.transform(found, lambda v: F.struct(v.alias("old"), pseudonym(v, key).alias("p"))))
    pieces = F.zip_with(gaps, made, lambda g, m: F.concat(g, F.coalesce(m["p"]["new"], m["old"], F.lit(""))))
    new = F.when(F.size(found) > 0, F.array_join(pieces, "")).otherwise(text)
    if counts:
        kinds = F.transform(made, lambda m: m["p"]["kind"])
        tally = [F.greatest(F.size(F.filter(kinds, _equals(kind))), F.lit(0)).cast("long") for kind in KINDS]
        out = out.withColumn(counts, F.map_from_arrays(F.array(*map(F.lit, KINDS)), F.array(*tally)))
    return out.withColumn("text", F.when(text.isNotNull(), new)).drop(found, gaps, made)
