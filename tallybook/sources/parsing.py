"""Text to typed values: locale numbers, dates in several formats, yes/no words. Expressions only, no Python per row."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F

SPARK_TYPES = {"string": "string", "int": "bigint", "float": "double", "date": "date", "datetime": "timestamp_ntz", "bool": "boolean"}

# Words for yes and no. Digits may be typed as them, but a column of digits is one of numbers.
YES = ("true", "t", "yes", "y", "1", "да", "д", "истина")
NO = ("false", "f", "no", "n", "0", "нет", "н", "ложь")
FLAG_WORDS = tuple(w for w in (*YES, *NO) if not w.isdigit())

# Dates: year first with - or /, or day first with . or /, the year in four digits or, after dots, in two; a time may follow.
TIME = "(?:[ T](\\d{1,2}:\\d{2}(?::\\d{2}(?:\\.\\d{1,9})?)?))?"
YEAR_FIRST = f"^(\\d{{4}})([-/])(\\d{{1,2}})\\2(\\d{{1,2}}){TIME}$"
DAY_FIRST = f"^(\\d{{1,2}})([./])(\\d{{1,2}})\\2(\\d{{4}}){TIME}$"
SHORT_YEAR = f"^(\\d{{1,2}})\\.(\\d{{1,2}})\\.(\\d{{2}}){TIME}$"
#: A year of two digits from here on is one of the last century.
LAST_CENTURY = 70


#: Digits with one mark at most, which most numbers are; all that any number may hold, a digit among it; a number to cast.
PLAIN_NUMBER = "^-?\\d+(?:[.,]\\d+)?$"
ANY_NUMBER = "^[\\s\\u00A0\\u202F\\u2009'(+−–-]*[.,]?\\d[\\d.,eE+−–\\s\\u00A0\\u202F\\u2009')-]*$"
ONE_MARK = "^[+-]?(?:\\d+\\.?\\d*|\\.\\d+)(?:[eE][+-]?\\d+)?$"


def may_be_number(text: Column) -> Column:
    """Whether the first character may begin a number: a cheap test that spares words the patterns."""
    first = F.ascii(text)
    return first.between(ord("("), ord("9")) | (first == ord(" ")) | (first == ord("'")) | (first == ord("\t")) | (first > 127)


def plain_number(text: Column) -> Column:
    """Digits with one mark at most, with a dot for the decimals; null of all other text."""
    return F.when(may_be_number(text) & text.rlike(PLAIN_NUMBER), F.replace(text, F.lit(","), F.lit(".")))


def cleaned_number(text: Column) -> Column:
    """Text that may be a number, without spaces and with a plain minus."""
    cleaned = F.translate(F.regexp_replace(F.trim(text), "[\\s\\u00A0\\u202F\\u2009']", ""), "−–", "--")
    return F.when(may_be_number(text) & text.rlike(ANY_NUMBER), F.regexp_replace(cleaned, "^\\((.*)\\)$", "-$1"))


def one_mark(t: Column) -> Column:
    """Cleaned text with a dot for the decimals alone."""
    comma, dot = F.instr(t, ","), F.instr(t, ".")
    last_comma, last_dot = F.length(t) - F.instr(F.reverse(t), ","), F.length(t) - F.instr(F.reverse(t), ".")
    both = F.when(last_comma > last_dot, F.translate(F.replace(t, F.lit("."), F.lit("")), ",", ".")).otherwise(F.replace(t, F.lit(","), F.lit("")))
    one = F.when(F.length(t) - F.length(F.replace(t, F.lit(","), F.lit(""))) > 1, F.replace(t, F.lit(","), F.lit(""))).otherwise(F.translate(t, ",", "."))
    return F.when(comma == 0, t).when(dot > 0, both).otherwise(one)


def as_double(t: Column) -> Column:
    return F.when(t.rlike(ONE_MARK), t.try_cast("double"))


def number(text: Column) -> Column:
    """Spaces of any kind inside, comma or dot for decimals, both as thousands and decimals, (x) or a Unicode minus for negatives."""
    return F.coalesce(plain_number(text).try_cast("double"), as_double(one_mark(cleaned_number(text))))


def with_numbers(df: DataFrame, names: dict[str, str]) -> DataFrame:
    """df with the numbers of text columns (name -> new column): the steps of number() as columns, which Spark compiles."""
    odd = {new: f"{new}_odd" for new in names.values()}
    out = df.withColumns({new: plain_number(F.col(f"`{c}`")) for c, new in names.items()})
    out = out.withColumns({odd[new]: F.when(F.col(new).isNull(), cleaned_number(F.col(f"`{c}`"))) for c, new in names.items()})
    out = out.withColumns({new: F.coalesce(F.col(new).try_cast("double"), F.when(F.col(odd[new]).isNotNull(), as_double(one_mark(F.col(odd[new]))))) for new in names.values()})
    return out.drop(*odd.values())


def whole_of(value: Column) -> Column:
    """A double as a long if it is a whole number that a long holds."""
    return F.when((value == F.rint(value)) & (F.abs(value) < 2.0**63), value.cast("long"))


def whole(text: Column) -> Column:
    return whole_of(number(text))


def moment_text(text: Column) -> Column:
    """Year, month, day and time in Spark's own order, of text that has the shape of a date; null of all other text."""
    t = F.trim(text)
    digit = F.ascii(t).between(ord("0"), ord("9"))
    at = lambda start, size: F.substring(t, start, size)
    plain = digit & (F.length(t) == 10) & (at(3, 1) == ".") & (at(6, 1) == ".")
    century = F.when(F.regexp_extract(t, SHORT_YEAR, 3).try_cast("int") >= LAST_CENTURY, "19").otherwise("20")
    return (
        F.when(plain, F.concat(at(7, 4), F.lit("-"), at(4, 2), F.lit("-"), at(1, 2)))
        .when(digit & t.rlike(YEAR_FIRST), F.regexp_replace(t, YEAR_FIRST, "$1-$3-$4 $5"))
        .when(digit & t.rlike(DAY_FIRST), F.regexp_replace(t, DAY_FIRST, "$4-$3-$1 $5"))
        .when(digit & t.rlike(SHORT_YEAR), F.concat(century, F.regexp_replace(t, SHORT_YEAR, "$3-$2-$1 $4")))
    )


def moment_of(found: Column) -> Column:
    """moment_text as a timestamp; seconds may be missing. Days and hours that do not exist are null."""
    clean = F.rtrim(found)
    marks = F.length(clean) - F.length(F.replace(clean, F.lit(":"), F.lit("")))
    return F.when(marks == 1, F.concat(clean, F.lit(":00"))).otherwise(clean).try_cast("timestamp_ntz")


def moment(text: Column) -> Column:
    return moment_of(moment_text(text))


def day(text: Column) -> Column:
    return moment(text).cast("date")


def flag(text: Column) -> Column:
    word = F.lower(F.trim(text))
    return F.when(word.isin(*YES), True).when(word.isin(*NO), False)


@contextmanager
def short_methods(spark: SparkSession) -> Iterator[None]:
    """Run with generated code in methods that the JVM compiles: it leaves those beyond 8,000 bytes of bytecode interpreted,
    which parsers of wide rows exceed when a whole stage is one method."""
    key = "spark.sql.codegen.hugeMethodLimit"
    before = spark.conf.get(key)
    spark.conf.set(key, "8000")
    try:
        yield
    finally:
        spark.conf.set(key, before)


PARSERS: dict[str, Callable[[Column], Column]] = {"string": lambda c: c, "int": whole, "float": number, "date": day, "datetime": moment, "bool": flag}


def filled(text: Column) -> Column:
    return text.isNotNull() & (F.trim(text) != "")


def typed(df: DataFrame, types: dict[str, str]) -> DataFrame:
    """df with the columns parsed, and `_errors`: the names of those that hold text which no parser reads.

    Each cell is parsed once: the parsed values are columns of their own, from which the errors follow.
    """
    place = {c: i for i, c in enumerate(types)}
    numbers, dates = ({c: f"_parsed_{place[c]}" for c, k in types.items() if k in kinds} for kinds in (("int", "float"), ("date", "datetime")))
    parsed = with_numbers(df, numbers).withColumns({numbers[c]: whole_of(F.col(numbers[c])) for c, k in types.items() if k == "int"})
    parsed = parsed.withColumns({new: moment_text(F.col(f"`{c}`")) for c, new in dates.items()})
    parsed = parsed.withColumns({new: moment_of(F.col(new)).cast(SPARK_TYPES[types[c]]) for c, new in dates.items()})
    parsed = parsed.withColumns({f"_parsed_{i}": PARSERS[types[c]](F.col(f"`{c}`")) for c, i in place.items() if c not in numbers and c not in dates and types[c] != "string"})
    wrong = [F.when(filled(F.col(f"`{c}`")) & F.col(f"_parsed_{i}").isNull(), F.lit(c)) for i, (c, k) in enumerate(types.items()) if k != "string"]
    errors = F.filter(F.array(*wrong), lambda x: x.isNotNull()) if wrong else F.array().cast("array<string>")
    kept = [F.col(f"_parsed_{place[c]}").alias(c) if types.get(c, "string") != "string" else F.col(f"`{c}`") for c in df.columns if c != "_errors"]
    return parsed.withColumn("_errors", errors).select(*kept, "_errors")


def code_like(name: str) -> bool:
    """Whether a column's name speaks of codes rather than quantities."""
    return bool(re.search(r"(?i)(^|[\W_])(code|id|no|number|phone|zip|inn|sku|код|номер|телефон|инн|артикул)([\W_]|$)|№", name))


def cell_counts(df: DataFrame) -> DataFrame:
    """One row per column with filled cells (`at`, its place): how many, and how many read as each kind of value.

    Cells become rows of (place, text), so that one set of parsers serves all columns and the compiled code does not grow
    with them; each task sends a row of counts per column to the shuffle, and no cells.
    """
    cells = df.select(F.posexplode(F.array(*(F.col(f"`{c}`") for c in df.columns))).alias("at", "cell")).where(filled(F.col("cell")))
    cells = with_numbers(cells.select("at", F.trim("cell").alias("cell")), {"cell": "number"})
    cells = cells.withColumn("moment", F.when(F.col("number").isNull(), moment_text(F.col("cell")))).withColumn("moment", moment_of(F.col("moment")))
    count = F.count_if
    return cells.groupBy("at").agg(
        F.count(F.lit(1)).alias("filled"),
        count(F.lower("cell").isin(*FLAG_WORDS)).alias("words"),
        count(F.col("number").isNotNull()).alias("numbers"),
        count(whole_of(F.col("number")).isNotNull()).alias("whole"),
        count(F.col("cell").rlike("^0\\d")).alias("zeros"),
        count(F.abs("number") >= 1e9).alias("long"),
        count(F.col("moment").isNotNull()).alias("moments"),
        count(F.col("moment").cast("date").cast("timestamp_ntz") != F.col("moment")).alias("timed"),
    )


def kind_of(name: str, found: Row, share: float) -> str:
    """A column's type by its counts. All cells that are words for yes and no: bool; digits alone are numbers.

    Numbers, if `share` of the cells read as such; whole ones if all of these are. With a leading zero, with ten digits
    or more in every whole number, or as whole numbers under a name that speaks of codes, they are text. Dates, if
    `share` of the cells read as such and none has a time but midnight.
    """
    n = found["filled"]
    if found["words"] == n:
        return "bool"
    if found["numbers"] >= share * n:
        if found["zeros"]:
            return "string"
        if found["whole"] < found["numbers"]:
            return "float"
        return "string" if found["long"] == found["numbers"] or code_like(name) else "int"
    if found["moments"] >= share * n:
        return "datetime" if found["timed"] else "date"
    return "string"


def infer(df: DataFrame, share: float = 0.98, rows: int | None = None) -> dict[str, str]:
    """A type for every text column, by kind_of over one pass of all rows, or of a sample of about `rows` from all over the table.

    What a type does not fit is found again as an error when all rows are parsed. A column without filled cells is text.
    """
    if rows is not None and (n := df.count()) > rows:
        df = df.sample(rows / n, seed=1)
    with short_methods(df.sparkSession):
        found = {r["at"]: r for r in cell_counts(df).collect()}
    return {c: kind_of(c, found[i], share) if i in found else "string" for i, c in enumerate(df.columns)}
