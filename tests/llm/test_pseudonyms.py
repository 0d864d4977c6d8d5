"""Feistel pseudonyms against a plain version, and their properties."""

import hashlib
import itertools
import re
from collections import Counter
from datetime import date, timedelta

from pyspark.sql import functions as F

from tallybook.llm import pseudonyms as P


def plain_permuted(values, radices, kind, key=P.KEY):
    values, middle = list(values), len(values) // 2
    for number in range(P.ROUNDS):
        left = number % 2 == 0
        seen = values[middle:] if left else values[:middle]
        text = ",".join([key, kind, str(number), str(len(values)), *map(str, seen)])
        noise = lambda i: int(hashlib.sha256(f"{text};{i}".encode()).hexdigest()[:13], 16)  # noqa: B023, E731
        values = [(x + noise(i)) % radices[i] if (i < middle) == left else x for i, x in enumerate(values)]
    return values


def luhn(text):
    digits = [int(c) for c in text if c.isdigit()][::-1]
    return sum(d if i % 2 == 0 else sum(divmod(2 * d, 10)) for i, d in enumerate(digits)) % 10 == 0


def fill(shape, digits, skip=0):
    it = iter(digits)
    return "".join(c if not c.isdigit() or i < skip else str(next(it)) for i, c in enumerate(shape))


def plain(kind, m):
    digits = [int(c) for c in m if c.isdigit()]
    if kind == "card":
        if not luhn(m):
            return None
        body = plain_permuted(digits[:-1], [10] * (len(digits) - 1), "card")
        return next(t for c in range(10) if luhn(t := fill(m, [*body, c])))
    if kind == "phone":
        code = len(re.match(r"\+(\d{1,3})", m)[1])
        return fill(m, plain_permuted(digits[code:], [10] * (len(digits) - code), "phone"), code + 1)
    if kind == "email":
        local, _, domain = m.partition("@")
        sets = [P.DIGITS if c.isdigit() else P.LOWER if c.isalpha() else c for c in local]
        fresh = plain_permuted([s.index(c) for s, c in zip(sets, local.lower())], [len(s) for s in sets], "email")
        return "".join(s[v].upper() if c.isupper() else s[v] for s, v, c in zip(sets, fresh, local)) + "@" + domain
    if kind == "ip":
        octets = list(map(int, m.split(".")))
        return ".".join(map(str, plain_permuted(octets, [256] * 4, "ip"))) if max(octets) < 256 else None
    if kind == "ssn":
        a, g, s = map(int, m.split("-"))
        if not (0 < a < 900 and a != 666 and g and s):
            return None
        a, g, s = plain_permuted([a - 1 - (a > 666), g - 1, s - 1], [898, 99, 9999], "ssn")
        return f"{a + 1 + (a > 664):03}-{g + 1:02}-{s + 1:04}"
    from datetime import datetime

    for form in {"-": ["%Y-%m-%d"], ".": ["%d.%m.%Y"], "/": ["%d/%m/%Y", "%m/%d/%Y"]}[re.search("[-./]", m)[0]]:
        try:
            day, first = datetime.strptime(m, form).date(), date(1900, 1, 1)
            n = (day - first).days
        except ValueError:
            continue
        if 0 <= n < 17 * 4297:
            while True:  # until the day is early or late in its month as it was
                a, b = plain_permuted(divmod(n, 4297), P.DAY_RADICES, "date")
                n = a * 4297 + b
                if ((first + timedelta(n)).day <= 12) == (day.day <= 12):
                    return (first + timedelta(n)).strftime(form)
    return None


def plain_text(text):
    spans = []

    def swap(m):
        kind = next(k for k, p in P.PATTERNS.items() if re.fullmatch(p, m[0]))
        fresh = plain(kind, m[0])
        if fresh is not None:
            spans.append((kind, m.start(), m.end()))
        return m[0] if fresh is None else fresh

    return re.sub(P.ANY, swap, text), spans


TEXTS = [
    "card 4111111111111111, again 4111 1111 1111 1111 or 4111-1111-1111-1111; not 4111111111111112 nor 4111",
    "call +1 (415) 555-0101 or +49 30 555 0101, write Jo.Smith+x@mail.example.com and jo.smith+x@mail.example.com!",
    "born 1984-02-29, 29.02.1984, 29/02/1984 and 02/29/1984; no date: 31.02.1984, 1884-02-28, 2024-13-01",
    "ssn 123-45-6789, not 666-12-3456 or 000-12-3456; hosts 10.0.0.1, 256.1.1.1, 1.2.3.4.5 v1.2.3.4",
    "💳 5500005555555559\n378282246310005 3782 822463 10005", "", "nothing here", "a@b.c", "7536784127813050 4845168114407329",
]


def run(spark, texts):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    return {r.doc_id: (r.text, [tuple(s) for s in r.replaced]) for r in P.pseudonymise(df).collect()}


def test_equals_plain_version(spark):
    got = run(spark, TEXTS)
    for i, text in enumerate(TEXTS):
        assert got[i] == plain_text(text), text


def test_validity_and_links(spark):
    got = run(spark, TEXTS)
    text, spans = got[0]
    cards = re.findall(r"\d[\d -]{11,}\d", text)[:3]
    assert len({re.sub(r"\D", "", c) for c in cards}) == 1 and all(map(luhn, cards)) and "4111111111111111" not in text
    assert "4111111111111112" in text and len(spans) == 3
    mails = re.findall(r"\S+@\S+", got[1][0])
    assert mails[0].lower() == mails[1].rstrip("!") and "smith" not in got[1][0].lower()
    days = re.findall(r"[\d./-]{10}", got[2][0])
    y, m, d = days[0].split("-")
    assert days[1] == f"{d}.{m}.{y}" and "31.02.1984" in got[2][0] and "1884-02-28" in got[2][0]
    assert "256.1.1.1" in got[3][0] and "1.2.3.4.5" in got[3][0] and "666-12-3456" in got[3][0]


def test_one_to_one(spark):
    """All values of a small domain give all values of it."""
    values = spark.range(10_000).select(F.array(*(F.floor(F.col("id") / 10**i).cast("bigint") % 10 for i in range(4))).alias("v"))
    ten = F.transform("v", lambda _: F.lit(10).cast("bigint"))
    assert values.select(F.array_join(P.permuted(F.col("v"), ten, "x", "k").cast("array<string>"), "")).distinct().count() == 10_000
    for n, radix in itertools.product((1, 2), (26,)):
        some = spark.range(radix**n).select(F.array(*(F.floor(F.col("id") / radix**i).cast("bigint") % radix for i in range(n))).alias("v"))
        fresh = P.permuted(F.col("v"), F.transform("v", lambda _: F.lit(26).cast("bigint")), "x", "k")
        assert some.select(fresh.cast("string")).distinct().count() == radix**n
    days = spark.range(17 * 4297).select(F.date_format(F.date_add(F.lit("1900-01-01").cast("date"), F.col("id").cast("int")), "yyyy-MM-dd").alias("d"))
    assert days.select(P.day(F.col("d"), "k")).distinct().count() == 17 * 4297


def test_all_dates_with_slashes_are_one_to_one(spark):
    """Day first and month first, and the same days in the other formats."""
    days = spark.range(17 * 4297).select(F.date_add(F.lit("1900-01-01").cast("date"), F.col("id").cast("int")).alias("d"))
    forms = [days.select("d", F.date_format("d", form).alias("text")) for form in ("dd/MM/yyyy", "MM/dd/yyyy", "yyyy-MM-dd")]
    slashed = forms[0].unionByName(forms[1]).select("text").distinct()
    got = P.pseudonymise(slashed).select("text").distinct().count()
    assert got == slashed.count() == 117_298
    iso = P.pseudonymise(forms[2]).select("d", "text")
    for frame, form in ((forms[0], "dd/MM/yyyy"), (forms[1].where("dayofmonth(d) > 12"), "MM/dd/yyyy")):
        both = P.pseudonymise(frame).select("d", F.to_date("text", form).alias("moved")).join(iso, "d")
        assert both.where("moved is null or date_format(moved, 'yyyy-MM-dd') <> text").count() == 0


def test_texts_full_of_personal_data(spark):
    """50,000 matches in one text, and repetitions that would need a stack frame each."""
    ips = " ".join(f"10.{i >> 16 & 255}.{i >> 8 & 255}.{i & 255}" for i in range(50_000))
    docs = spark.createDataFrame([(1, ips), (2, "a@b" + ".c" * 50_000)], "doc_id long, text string")
    got = {r.doc_id: r for r in P.pseudonymise(docs).select("doc_id", "replaced", "text").collect()}
    assert len(got[1].replaced) == 50_000 == len(set(got[1].text.split()))
    assert got[1].replaced[-1].end == len(ips) and got[2].replaced[0].end == 3 + 100_000


def test_keys_differ(spark):
    df = spark.createDataFrame([("4111111111111111",)], "text string")
    by_key = {k: P.pseudonymise(df, k).first().text for k in ("a", "b")}
    assert by_key["a"] != by_key["b"]
    spark.conf.set(P.KEY_SETTING, "b")
    try:
        assert P.pseudonymise(df).first().text == by_key["b"]
    finally:
        spark.conf.unset(P.KEY_SETTING)


def test_awkward(awkward, nothing, rows):
    out = P.pseudonymise(awkward)
    assert out.columns == [*(c for c in awkward.columns if c != "replaced"), "replaced"] and {r.found for r in out.collect()} == {"x"}
    assert Counter((r.doc_id, r.text) for r in out.collect()) == Counter((i, t if t is None else plain_text(t)[0]) for i, t in rows)
    assert P.pseudonymise(nothing).count() == 0


def test_plan_is_native(awkward):
    plan = P.pseudonymise(awkward)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
