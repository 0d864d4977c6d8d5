"""Formulas are Spark SQL expressions, with a few functions and rules of the report dialect on top.

Catalyst parses, types and optimises them. The dialect's own functions are SQL functions, which Catalyst inlines.
Division by zero is null, because expressions are built without ANSI mode; fractional literals are doubles.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar
from datetime import date
from functools import reduce
from uuid import uuid4

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Fixed values: % codes of dates and Spark's patterns.
DATE_CODES = {"%Y": "yyyy", "%y": "yy", "%m": "MM", "%d": "dd", "%H": "HH", "%I": "hh", "%M": "mm", "%S": "ss", "%j": "DDD", "%B": "MMMM", "%b": "MMM", "%A": "EEEE", "%a": "EEE", "%p": "a"}
JAVA_PATTERN = reduce(lambda text, code: f"replace({text}, '{code[0]}', '{code[1]}')", DATE_CODES.items(), "format")
#: name -> (parameters, return type, body)
FUNCTIONS = {
    "strftime": ("d TIMESTAMP_NTZ, format STRING", "STRING", f"date_format(d, {JAVA_PATTERN})"),
    "strptime": ("s STRING, format STRING", "TIMESTAMP_NTZ", f"CAST(try_to_timestamp(s, {JAVA_PATTERN}) AS TIMESTAMP_NTZ)"),
    "regexp_matches": ("s STRING, rx STRING", "BOOLEAN", "s RLIKE rx"),
    "regexp_full_match": ("s STRING, rx STRING", "BOOLEAN", "s RLIKE concat('^(?:', rx, ')$')"),
    "boundaries_between": ("unit STRING, a TIMESTAMP_NTZ, b TIMESTAMP_NTZ", "BIGINT", "CAST(CASE lower(unit) WHEN 'year' THEN year(b) - year(a) WHEN 'quarter' THEN (year(b) - year(a)) * 4 + quarter(b) - quarter(a) WHEN 'month' THEN (year(b) - year(a)) * 12 + month(b) - month(a) WHEN 'week' THEN datediff(date_trunc('week', b), date_trunc('week', a)) div 7 WHEN 'day' THEN datediff(b, a) END AS BIGINT)"),
    "half_even_cast": ("s STRING", "BIGINT", "CAST(bround(try_cast(s AS DOUBLE), 0) AS BIGINT)"),
    "half_even_int": ("x DOUBLE", "BIGINT", "CAST(bround(x, 0) AS BIGINT)"),
    "join_text": ("a STRING, b STRING", "STRING", "concat_ws('', a, b)"),
    "months_between_starts": ("a TIMESTAMP_NTZ, b TIMESTAMP_NTZ", "BIGINT", "CAST((year(b) - year(a)) * 12 + month(b) - month(a) AS BIGINT)"),
    "quarters_between_starts": ("a TIMESTAMP_NTZ, b TIMESTAMP_NTZ", "BIGINT", "CAST((year(b) - year(a)) * 4 + quarter(b) - quarter(a) AS BIGINT)"),
    "years_between_starts": ("a TIMESTAMP_NTZ, b TIMESTAMP_NTZ", "BIGINT", "CAST(year(b) - year(a) AS BIGINT)"),
    "sunday_based_dow": ("d TIMESTAMP_NTZ", "BIGINT", "CAST(dayofweek(d) - 1 AS BIGINT)"),
    "iso_dow": ("d TIMESTAMP_NTZ", "BIGINT", "CAST(weekday(d) + 1 AS BIGINT)"),
    "floor_double": ("x DOUBLE", "DOUBLE", "CAST(floor(x) AS DOUBLE)"),
    "ceil_double": ("x DOUBLE", "DOUBLE", "CAST(ceil(x) AS DOUBLE)"),
    "replace_first": ("s STRING, rx STRING, by STRING", "STRING", "CASE WHEN regexp_instr(s, rx) = 0 THEN s ELSE concat(substring(s, 1, regexp_instr(s, rx) - 1), by, substring(s, regexp_instr(s, rx) + length(regexp_substr(s, rx)))) END"),
    "extract_first": ("s STRING, rx STRING", "STRING", "coalesce(regexp_substr(s, rx), CASE WHEN s IS NOT NULL THEN '' END)"),
}


#: A setting of the session's own that says that its functions are defined.
DEFINED = "tallybook.formulas.defined"


def register(spark: SparkSession) -> None:
    """Define the dialect's functions in the session, once."""
    if spark.conf.get(DEFINED, "") == "true":
        return
    for name, (parameters, kind, body) in FUNCTIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({parameters}) RETURNS {kind} RETURN {body}")
    spark.conf.set(DEFINED, "true")


#: Functions of the dialect whose names mean something else to Spark -> what they are written as.
WRITTEN = {"date_diff": "boundaries_between", "dayofweek": "sunday_based_dow", "isodow": "iso_dow"}
#: Quoted text, and names in either kind of quotes, which are never rewritten.
QUOTED = re.compile(r"'(?:[^']|'')*'|`[^`]*`|\"[^\"]*\"")


def blanked(text: str) -> str:
    """The text with what is quoted as underscores, at the same places."""
    return QUOTED.sub(lambda m: "_" * len(m[0]), text)


def closing(text: str, start: int) -> tuple[int, list[int]]:
    """Of an argument list that begins at start: where it ends, and its commas; brackets of all kinds nest."""
    depth, commas = 1, []
    for i in range(start, len(text)):
        depth += (text[i] in "([{") - (text[i] in ")]}")
        if not depth:
            return i, commas
        if text[i] == "," and depth == 1:
            commas.append(i)
    return len(text), commas


def operand_before(text: str, stop: int) -> int:
    """Where the factor that ends at stop begins: a name, a literal, a call or brackets, with dots and a sign of casts."""
    i = stop
    while i and text[i - 1].isspace():
        i -= 1
    while i and (re.match(r"[\w.:]", text[i - 1]) or text[i - 1] in ")]"):
        if text[i - 1] in ")]":
            depth = 0
            while i:
                i -= 1
                depth += (text[i] in ")]") - (text[i] in "([")
                if not depth:
                    break
        else:
            i -= 1
    return i


def operand_after(text: str, start: int) -> int:
    """Where the factor that begins at start ends."""
    m = re.compile(r"\s*[-+]?\s*[\w.:]*").match(text, start)
    i = m.end()
    while i < len(text) and text[i] in "([":
        i = closing(text, i + 1)[0] + 1
        i = re.compile(r"[\w.:]*").match(text, i).end()
    return i


def _whole_divisions(text: str) -> str:
    """a // b as a quotient cut towards zero; a is all of the term so far, as * / and % bind from the left."""
    while (at := blanked(text).find("//")) >= 0:
        flat = blanked(text)
        start, stop = operand_before(flat, at), operand_after(flat, at + 2)
        while (before := flat[:start].rstrip()) and before[-1] in "*/%":
            start = operand_before(flat, len(before) - 1)
        text = f"{text[:start]}CAST(({text[start:at].strip()}) / ({text[at + 2 : stop].strip()}) AS BIGINT){text[stop:]}"
    return text


def _calls(text: str) -> str:
    """Calls whose meaning differs: log of one argument is to base ten; concat passes over nulls, but for arrays."""
    flat = blanked(text)
    edits = []
    for m in re.finditer(r"(?i)(?<![\w.])(log|concat)\s*\(", flat):
        stop, commas = closing(flat, m.end())
        if m[1].lower() == "log" and not commas:
            edits.append((m.start(), m.end(), "log10("))
        if m[1].lower() == "concat" and not is_array(flat[m.end() : commas[0] if commas else stop]):
            edits.append((m.start(), m.end(), "concat_ws('', "))
    for start, stop, written in reversed(edits):
        text = text[:start] + written + text[stop:]
    return text


#: Casts to whole numbers round half to even, of numbers and of their text; what is neither is null.
ROUNDED = "coalesce(try_cast(CAST({0} AS STRING) AS BIGINT), CAST(bround(try_cast({0} AS DOUBLE), 0) AS BIGINT))"


def _casts(text: str) -> str:
    """CAST and TRY_CAST to whole numbers, and ::int, as rounding ones."""
    at = 0
    while m := re.compile(r"(?i)(?<![\w.])(?:try_)?cast\s*\(").search(blanked(text), at):
        flat = blanked(text)
        stop = closing(flat, m.end())[0]
        kind = re.search(r"(?i)\s+as\s+(int|integer|bigint|long)\s*$", flat[m.end() : stop])
        if kind:
            written = ROUNDED.format(_casts(text[m.end() : m.end() + kind.start()]).strip())
            text = text[: m.start()] + written + text[stop + 1 :]
        at = m.start() + len(written) if kind else m.end()
    while m := re.search(r"(?i)::\s*(int|integer|bigint|long)\b", blanked(text)):
        start = operand_before(blanked(text), m.start())
        text = text[:start] + ROUNDED.format(text[start : m.start()].strip()) + text[m.end() :]
    return text


def is_array(argument: str) -> bool:
    """Whether an argument is written as an array: a constructor, or a function that gives one."""
    return bool(re.match(r"(?i)\s*(array\w*|sequence|split|collect_(list|set)|filter|transform|slice|flatten|shuffle|sort_array|map_(keys|values|entries))\s*\(", argument))


def _quoted(text: str, like: bool) -> str:
    """What is quoted, for Spark: names in double quotes, and text in which a backslash means itself, in patterns too."""
    if text[0] == '"':
        return "`" + text[1:-1].replace("`", "``") + "`"
    if text[0] == "'":
        body = text[1:-1].replace("''", "'").replace("\\", "\\\\" if like else "\\")
        return "'" + body.replace("\\", "\\\\").replace("'", "\\'") + "'"
    return text


#: The day that CURRENT_DATE and TODAY() mean, if a run fixes one.
RUN_DAY: ContextVar[date | None] = ContextVar("RUN_DAY", default=None)


@contextmanager
def run_on(day: date | None) -> Iterator[None]:
    """Build plans as of a day, so that a report made again later is the same."""
    token = RUN_DAY.set(day)
    try:
        yield
    finally:
        RUN_DAY.reset(token)


def spark_text(text: str) -> str:
    """The dialect's text as Spark's: fractional literals as doubles, // as whole division, functions by names that
    Spark knows, and the run's day. What is quoted keeps its meaning; backslashes escape nothing."""
    text = _calls(_whole_divisions(_casts(text)))
    out, at = [], 0
    for m in [*QUOTED.finditer(text), None]:
        part = text[at : m.start() if m else len(text)]
        part = re.sub(r"(?<![\w.])(\d+\.\d*|\.\d+)(?![\w.])", r"\1D", part)
        for name, written in WRITTEN.items():
            part = re.sub(rf"(?i)(?<![\w.]){name}\s*\(", f"{written}(", part)
        day = RUN_DAY.get()
        part = re.sub(r"(?i)(?<![\w.])(current_date\b(\s*\(\s*\))?|(today|curdate)\s*\(\s*\))", f"DATE '{day}'" if day else "current_date()", part)
        out.append(part)
        if m:
            like = re.search(r"(?i)\bi?like\s*$", part) and not re.match(r"(?i)\s*escape\b", text[m.end() :])
            out.append(_quoted(m[0], bool(like)))
            at = m.end()
    return "".join(out)


@contextmanager
def lenient(spark: SparkSession) -> Iterator[None]:
    """Build plans without ANSI errors; the choice stays in plans built inside."""
    keys = {"spark.sql.ansi.enabled": "false"}
    before = {k: spark.conf.get(k) for k in keys}
    for k, v in keys.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def normalised(df: DataFrame) -> DataFrame:
    """Decimals as doubles, narrow integers as longs, zoned timestamps as zone-less ones."""
    kinds = {"tinyint": "bigint", "smallint": "bigint", "int": "bigint", "float": "double", "timestamp": "timestamp_ntz"}
    return df.select(*(F.col(f"`{n}`").cast("double" if t.startswith("decimal") else kinds[t]).alias(n) if t.startswith("decimal") or t in kinds else F.col(f"`{n}`") for n, t in df.dtypes))


def with_formula(df: DataFrame, name: str, text: str) -> DataFrame:
    """df with a new or replaced column."""
    register(df.sparkSession)
    with lenient(df.sparkSession):
        out = df.selectExpr(*(f"`{c}`" for c in df.columns if c != name), f"{spark_text(text)} AS `{name}`")
        out.schema  # analysed here, so that the mode is captured
    return out.select(*(F.col(f"`{c}`") for c in ([*df.columns] if name in df.columns else [*df.columns, name])))


def filtered(df: DataFrame, text: str) -> DataFrame:
    """Rows for which the condition holds; null counts as no."""
    register(df.sparkSession)
    with lenient(df.sparkSession):
        out = df.where(spark_text(text))
        out.schema
    return out


def relations(spark: SparkSession, query: str) -> set[str]:
    """Names of the tables that a query reads, by Catalyst's parse of it: those of its own WITH clauses are none."""
    with lenient(spark):
        plan = spark._jsparkSession.sessionState().sqlParser().parsePlan(spark_text(query).strip().rstrip(";")).treeString()
    own = {name.strip() for names in re.findall(r"CTE \[([^\]]*)\]", plan) for name in names.split(",")}
    return set(re.findall(r"'UnresolvedRelation \[([^\]]*)\]", plan)) - own


def run_sql(spark: SparkSession, query: str, tables: dict[str, DataFrame]) -> DataFrame:
    """A SELECT over named tables; columns come back in the engine's six types.

    The tables are common table expressions in front of the query, over views of names of their own that are dropped
    once the plan is made; so views of the session neither change nor hide them.
    """
    register(spark)
    own = {name: f"_view_{uuid4().hex}" for name in tables}
    text = spark_text(query).strip().rstrip(";")
    started = re.match(r"(?is)with\s+(?!recursive\b)", text)
    named = [f"`{name}` AS (SELECT * FROM {view})" for name, view in own.items() if not re.search(rf"(?i)\b{re.escape(name)}\s+AS\s*\(\s*(SELECT|WITH|FROM|VALUES)\b", text)]
    body = text[started.end() :] if started else text
    prefix = "WITH " + ", ".join(named) + (", " if started else " ") if named else ("WITH " if started else "")
    for name, view in own.items():
        tables[name].createOrReplaceTempView(view)
    try:
        with lenient(spark):
            out = normalised(spark.sql(prefix + body))
            out.schema
    finally:
        for view in own.values():
            spark.catalog.dropTempView(view)
    return out


def safe_ratio(a: Column, b: Column) -> Column:
    """a / b in doubles; null if b is zero or null."""
    return F.when(b != 0, a.cast("double") / b)
