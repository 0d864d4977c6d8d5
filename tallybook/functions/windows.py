"""Named windows: from a report period to the span of history that a node reads."""

from __future__ import annotations

from collections.abc import Callable
from datetime import date, timedelta

from pyspark.sql import Column
from pyspark.sql import functions as F

from tallybook.functions.periods import Period

#: First day (None: open) and the day after the last.
Span = tuple[date | None, date]


def _to_date(unit: str) -> Callable[[Period], Span]:
    return lambda p: (min(Period.around(p.last_day, unit).start, p.start), p.stop)


def last_n(p: Period, n: int) -> Span:
    return p.moved(1 - n).start, p.stop


def fixed(p: Period, start: str, end: str) -> Span:
    return date.fromisoformat(start), date.fromisoformat(end) + timedelta(1)


WINDOWS: dict[str, Callable[..., Span]] = {
    "report_period": lambda p: (p.start, p.stop),
    "previous_period": lambda p: (p.moved(-1).start, p.moved(-1).stop),
    "same_period_last_year": lambda p: (p.a_year_before().start, p.a_year_before().stop),
    "quarter_to_date": _to_date("quarter"),
    "year_to_date": _to_date("year"),
    "last_n": last_n,
    "all": lambda p: (None, p.stop),
    "range": fixed,
}


def span_of(window: str | dict, period: Period) -> Span:
    """The span of a window, given by name or as {name: parameters}."""
    if isinstance(window, str):
        return WINDOWS[window](period)
    ((name, arguments),) = window.items()
    return WINDOWS[name](period, **arguments) if isinstance(arguments, dict) else WINDOWS[name](period, arguments)


def within(column: str | Column, span: Span) -> Column:
    """Rows of a span; literal bounds, so that the filter reaches the scan. Null dates are out."""
    c = F.col(column) if isinstance(column, str) else column
    start, stop = span
    below = c < F.lit(stop)
    return below if start is None else (c >= F.lit(start)) & below
