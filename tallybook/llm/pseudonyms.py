"""Personal data replaced by format-preserving Feistel pseudonyms, in DataFrame functions only.

A value becomes an array of symbols, each below a radix of its own: digits, letters, octets, or the parts of a day
number. ROUNDS Feistel rounds add keyed hashes of one half to the other, modulo the radices, so the permutation maps
valid values to valid values of the same format, one to one. Equal values get equal pseudonyms in every document,
whatever separators or letter case they are written with.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallybook.llm.common import besides, quoted, unused

ROUNDS = 8
#: The setting of the session that holds the secret key, and the key where it is unset.
KEY_SETTING, KEY = "tallybook.pseudonyms.key", "tallybook"

#: Kinds in the order in which they are tried at one place of a text.
PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]{1,64}@[A-Za-z0-9-]{1,63}(?:\.[A-Za-z0-9-]{1,63})++",
    "phone": r"\+[0-9]{1,3}[ .-]?\(?[0-9]{2,4}\)?[ .-]?[0-9]{3}[ .-]?[0-9]{4}(?![0-9])",
    "card": r"(?<![0-9A-Za-z])(?:[0-9]{4}[ -][0-9]{4}[ -][0-9]{4}[ -][0-9]{4}|[0-9]{4}[ -][0-9]{6}[ -][0-9]{5}|[0-9]{13,19})(?![0-9A-Za-z])",
    "date": r"(?<![0-9A-Za-z.-])(?:[0-9]{4}-[0-9]{2}-[0-9]{2}|[0-9]{2}\.[0-9]{2}\.[0-9]{4}|[0-9]{2}/[0-9]{2}/[0-9]{4})(?![0-9A-Za-z-])",
    "ssn": r"(?<![0-9A-Za-z-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9A-Za-z-])",
    "ip": r"(?<![0-9A-Za-z.])[0-9]{1,3}(?:\.[0-9]{1,3}){3}(?![0-9A-Za-z]|\.[0-9])",
}
ANY = "|".join(f"(?:{p})" for p in PATTERNS.values())
#: First day and number of days of the dates that are permuted: 1900 to 2099, which is 17 times 4297 days.
FIRST_DAY, DAY_RADICES = "1900-01-01", (17, 4297)
#: Days up to the twelfth of a month are permuted among each other and so are later ones, as only later ones can be told
#: apart in dd/MM and MM/dd. The permutation is repeated until it is back in the class: so often at most, of which a day
#: needs more with probability (1 - 0.39) ** 96 < 1e-20.
WALK = 96
DATE_FORMATS = ("yyyy-MM-dd", "dd.MM.yyyy", "dd/MM/yyyy", "MM/dd/yyyy")
DIGITS, LOWER, UPPER = "0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def characters(text: Column) -> Column:
    return F.filter(F.split(text, ""), lambda c: c != "")


def numbers(chars: Column) -> Column:
    return F.transform(chars, lambda c: c.cast("bigint"))


def permuted(values: Column, radices: Column, kind: str, key: str) -> Column:
    """Feistel rounds over an array of numbers, each below its radix: the left half is moved in even rounds."""

    def half(acc: Column, left: Column) -> Column:
        middle = F.floor(F.size(acc) / 2).cast("int")
        return F.when(left, F.slice(acc, F.lit(1), middle)).otherwise(F.slice(acc, middle + 1, F.size(acc) - middle))

    def one_round(acc: Column, number: Column) -> Column:
        moves_left = number % 2 == 0
        seen = F.concat_ws(",", F.lit(key), F.lit(kind), number.cast("string"), F.size(acc).cast("string"), half(acc, ~moves_left).cast("array<string>"))

        def moved(x: Column, i: Column) -> Column:
            noise = F.conv(F.substring(F.sha2(F.concat_ws(";", seen, i.cast("string")), 256), 1, 13), 16, 10).cast("bigint")
            radix = F.get(radices, i)
            return F.when((i < F.floor(F.size(acc) / 2)) == moves_left, (x + noise % radix) % radix).otherwise(x)

        return F.transform(acc, moved)

    return F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), values.cast("array<bigint>"), one_round)


def with_digits(text: Column, digits: Column, first: int | Column = 0) -> Column:
    """text with its digits, from number `first` on, replaced in order."""
    begin = F.struct(F.lit("").alias("out"), F.lit(0).alias("at"))

    def step(acc: Column, c: Column) -> Column:
        digit = c.rlike("[0-9]")
        fresh = F.when(digit & (acc["at"] >= first), F.substring(digits, acc["at"] - first + 1, F.lit(1))).otherwise(c)
        return F.struct(F.concat(acc["out"], fresh).alias("out"), (acc["at"] + digit.cast("int")).alias("at"))

    return F.aggregate(characters(text), begin, step, lambda acc: acc["out"])


def luhn_sum(digits: Column) -> Column:
    """Luhn sum of an array of digits whose last is the check digit."""
    doubled = F.transform(F.reverse(digits), lambda d, i: F.when(i % 2 == 0, d).when(d > 4, 2 * d - 9).otherwise(2 * d))
    return F.aggregate(doubled, F.lit(0).cast("bigint"), lambda a, d: a + d)


def tens(values: Column) -> Column:
    return F.transform(values, lambda _: F.lit(10).cast("bigint"))


def card(m: Column, key: str) -> Column:
    """All digits but the check digit are permuted; the check digit follows. Numbers that fail the check stay."""
    digits = numbers(characters(F.regexp_replace(m, "[^0-9]", "")))
    body = F.slice(digits, F.lit(1), F.size(digits) - 1)
    fresh = permuted(body, tens(body), "card", key)
    check = (10 - luhn_sum(F.concat(fresh, F.array(F.lit(0).cast("bigint")))) % 10) % 10
    text = F.array_join(F.concat(fresh, F.array(check)).cast("array<string>"), "")
    return F.when(luhn_sum(digits) % 10 == 0, with_digits(m, text))


def phone(m: Column, key: str) -> Column:
    """The digits behind the country code are permuted."""
    code = F.length(F.regexp_extract(m, r"^\+([0-9]{1,3})", 1))
    digits = numbers(characters(F.substring(F.regexp_replace(m, "[^0-9]", ""), code + 1, F.lit(20))))
    return with_digits(m, F.array_join(permuted(digits, tens(digits), "phone", key).cast("array<string>"), ""), code)


def email(m: Column, key: str) -> Column:
    """Letters and digits before the @ are permuted, each among its kind; the domain stays."""
    local = characters(F.lower(F.regexp_extract(m, "^([^@]+)@", 1)))
    shown = characters(F.regexp_extract(m, "^([^@]+)@", 1))
    values = F.transform(local, lambda c: F.greatest(F.instr(F.lit(DIGITS), c), F.instr(F.lit(LOWER), c), F.lit(1)).cast("bigint") - 1)
    radices = F.transform(local, lambda c: F.when(c.rlike("[0-9]"), 10).when(c.rlike("[a-z]"), 26).otherwise(1).cast("bigint"))
    fresh = permuted(values, radices, "email", key)

    def shape(c: Column, v: Column) -> Column:
        at = (v + 1).cast("int")
        return F.when(c.rlike("[0-9]"), F.substring(F.lit(DIGITS), at, F.lit(1))).when(c.rlike("[a-z]"), F.substring(F.lit(LOWER), at, F.lit(1))).when(c.rlike("[A-Z]"), F.substring(F.lit(UPPER), at, F.lit(1))).otherwise(c)

    return F.concat(F.array_join(F.zip_with(shown, fresh, shape), ""), F.regexp_extract(m, "(@.*)$", 1))


def moved_day(date: Column, key: str) -> Column:
    """The day that a day of 1900 to 2099 is permuted to, of the same class; null for other days."""
    first = F.lit(FIRST_DAY).cast("date")
    radices = F.array(*(F.lit(r).cast("bigint") for r in DAY_RADICES))
    n = F.datediff(date, first).cast("bigint")

    def early(number: Column) -> Column:
        return F.dayofmonth(F.date_add(first, number.cast("int"))) <= 12

    def step(acc: Column, _: Column) -> Column:
        fresh = permuted(F.array(F.floor(acc["n"] / DAY_RADICES[1]), acc["n"] % DAY_RADICES[1]), radices, "date", key)
        number = F.get(fresh, F.lit(0)) * DAY_RADICES[1] + F.get(fresh, F.lit(1))
        moved = F.struct(number.alias("n"), (early(number) == acc["early"]).alias("done"), acc["early"].alias("early"))
        return F.when(acc["done"], acc).otherwise(moved)

    begin = F.struct(n.alias("n"), F.lit(False).alias("done"), early(n).alias("early"))
    walked = F.aggregate(F.sequence(F.lit(1), F.lit(WALK)), begin, step, lambda acc: F.date_add(first, acc["n"].cast("int")))
    return F.when(date.isNotNull() & (n >= 0) & (n < DAY_RADICES[0] * DAY_RADICES[1]), walked)


def day(m: Column, key: str) -> Column:
    """Valid days of 1900 to 2099 are permuted among each other; others stay.

    A date with slashes is day first if that is a day, else month first. As the class of moved_day stays, the formats
    stay apart too: the pseudonym of a date that can only be read month first can only be read so.
    """
    shapes = list(zip(DATE_FORMATS, ("^[0-9]{4}-", r"\.", "/", "/"), strict=True))
    found = F.array(*(F.when(m.rlike(rx), F.try_to_timestamp(m, F.lit(pattern)).cast("date")) for pattern, rx in shapes))
    which = F.array_position(F.transform(found, lambda d: d.isNotNull()), F.lit(True)).cast("int")
    moved = moved_day(F.get(found, which - 1), key)
    return F.coalesce(*(F.when(which == i, F.date_format(moved, pattern)) for i, (pattern, _) in enumerate(shapes, 1)))


def ssn(m: Column, key: str) -> Column:
    """Area 001 to 899 without 666, group 01 to 99, serial 0001 to 9999; numbers outside stay."""
    area, group, serial = (F.split_part(m, F.lit("-"), F.lit(i)).cast("bigint") for i in (1, 2, 3))
    valid = (area > 0) & (area < 900) & (area != 666) & (group > 0) & (serial > 0)
    values = F.array(area - F.when(area > 666, 2).otherwise(1), group - 1, serial - 1)
    fresh = permuted(values, F.array(*(F.lit(r).cast("bigint") for r in (898, 99, 9999))), "ssn", key)
    first = F.get(fresh, F.lit(0))
    return F.when(valid, F.format_string("%03d-%02d-%04d", first + F.when(first > 664, 2).otherwise(1), F.get(fresh, F.lit(1)) + 1, F.get(fresh, F.lit(2)) + 1))


def ip(m: Column, key: str) -> Column:
    """Four octets below 256 are permuted; others, as of version numbers with large parts, stay."""
    octets = numbers(F.split(m, r"\."))
    fresh = permuted(octets, F.transform(octets, lambda _: F.lit(256).cast("bigint")), "ip", key)
    return F.when(F.forall(octets, lambda x: x < 256), F.array_join(fresh.cast("array<string>"), "."))


KINDS: dict[str, Callable[[Column, str], Column]] = {"email": email, "phone": phone, "card": card, "date": day, "ssn": ssn, "ip": ip}


def kind_of(m: Column) -> Column:
    """Which pattern a match belongs to; formats tell the kinds apart."""
    out = F.lit("card")
    for kind, rx in (("ip", r"^[0-9]{1,3}(\.[0-9]{1,3}){3}$"), ("ssn", "^[0-9]{3}-[0-9]{2}-[0-9]{4}$"), ("date", "^([0-9]{4}-[0-9]{2}-[0-9]{2}|[0-9]{2}([./])[0-9]{2}\\2[0-9]{4})$"), ("phone", r"^\+"), ("email", "@")):
        out = F.when(m.rlike(rx), kind).otherwise(out)
    return out


def running(sizes: Column, total: Callable[[Column], Column], place: Callable[[Column, Column], Column], kind: str) -> Column:
    """place(x, start) of all x of an array, start being the sum of total over those before, flattened: arrays of `kind`.

    In stretches of about the square root of the array's size: their sums first, then each stretch from its start. So an
    array of n needs n ** 1.5 steps of a copy instead of n ** 2.
    """
    stretch = F.greatest(F.ceil(F.sqrt(F.size(sizes))), F.lit(1)).cast("int")
    parts = F.transform(F.sequence(F.lit(0), F.floor((F.size(sizes) - 1) / stretch).cast("int")), lambda i: F.slice(sizes, i * stretch + 1, stretch))

    def whole(part: Column) -> Column:
        return F.aggregate(part, F.lit(0), lambda n, x: n + total(x))

    begin = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("starts"))
    starts = F.aggregate(parts, begin, lambda acc, part: F.struct((acc["at"] + whole(part)).alias("at"), F.concat(acc["starts"], F.array(acc["at"])).alias("starts")), lambda acc: acc["starts"])

    def placed(part: Column, start: Column) -> Column:
        first = F.struct(start.alias("at"), F.array().cast(kind).alias("out"))
        return F.aggregate(part, first, lambda acc, x: F.struct((acc["at"] + total(x)).alias("at"), F.concat(acc["out"], place(x, acc["at"])).alias("out")), lambda acc: acc["out"])

    return F.flatten(F.zip_with(parts, starts, placed))


def pseudonymise(docs: DataFrame, key: str | None = None, text_col: str = "text") -> DataFrame:
    """All columns of docs, personal data in text_col replaced, and `replaced`: an array of (kind, start, end).

    Kinds: e-mail addresses, phone numbers with country code, card numbers that pass the Luhn check, days of 1900 to
    2099, social security numbers, IPv4 addresses. Matches are leftmost and do not overlap; those that fail validation
    stay as they are. Positions are code points of the input, end exclusive. A column named replaced, in either letter
    case, is replaced; other names are free. The key is `key`, else the session's setting KEY_SETTING, else KEY.

    Rows are independent: no shuffle, and repeated rows, null ids and empty tables need no care. Null texts stay null
    with an empty array, empty texts stay empty.
    """
    key = key if key is not None else docs.sparkSession.conf.get(KEY_SETTING, KEY)
    text, spans = F.col(text_col), "array<struct<kind:string,start:int,end:int>>"
    found, measured = unused(docs, "found", "measured")
    pieces = F.split(text, ANY, -1)

    def shape(m: Column) -> Column:
        kind = kind_of(m)
        fresh = reduce(lambda out, k: F.when(kind == k, KINDS[k](m, key)).otherwise(out), KINDS, F.lit(None).cast("string"))
        return F.struct(kind.alias("kind"), m.alias("old"), fresh.alias("new"))

    matched = docs.withColumn(found, F.when(text.rlike(ANY), F.transform(F.regexp_extract_all(text, F.lit(ANY), F.lit(0)), shape)))
    glued = F.array_join(F.zip_with(pieces, F.col(found), lambda p, x: F.concat(p, F.coalesce(x["new"], x["old"], F.lit("")))), "")
    # columns of their own, so that the array is made once and not for each stretch
    sizes = F.zip_with(pieces, F.col(found), lambda p, x: F.struct(F.length(p).alias("gap"), F.coalesce(F.length(x["old"]), F.lit(0)).alias("size"), x["kind"].alias("kind"), x["new"].isNotNull().alias("valid")))

    def span(x: Column, at: Column) -> Column:
        begin = at + x["gap"]
        return F.when(x["valid"], F.array(F.struct(x["kind"].alias("kind"), begin.alias("start"), (begin + x["size"]).alias("end")))).otherwise(F.array().cast(spans))

    replaced = F.when(F.col(found).isNotNull(), running(F.col(measured), lambda x: x["gap"] + x["size"], span, spans)).otherwise(F.array().cast(spans))
    fresh = F.when(F.col(found).isNotNull(), glued).otherwise(text)
    kept = besides(docs, "replaced")
    return matched.withColumn(measured, F.when(F.col(found).isNotNull(), sizes)).select(*(fresh.alias(c) if c.lower() == text_col.lower() else q for c, q in zip(kept, quoted(kept), strict=True)), replaced.alias("replaced"))
