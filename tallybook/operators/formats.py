"""Values as text for slides, and the variables of a report's period."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tallybook.functions.formulas import DATE_CODES
from tallybook.functions.periods import Period

#: Unicode no-break space, between thousands and before units.
THIN = "\u00a0"


def number(value: Column, digits: int = 0, thousands: str = THIN, decimal: str = ",") -> Column:
    """Thousands apart, a decimal mark, a fixed number of digits behind it (half away from zero); null stays null."""
    shown = F.format_number(F.round(value.cast("double"), digits), digits)
    return F.translate(F.translate(F.translate(shown, ",", "\x01"), ".", "\x02"), "\x01\x02", thousands + decimal)


def percent(value: Column, digits: int = 1, signed: bool = False) -> Column:
    """A share as percent, with + before positive changes if asked."""
    sign = F.when(value > 0, "+").otherwise("") if signed else F.lit("")
    return F.concat(sign, number(value * 100, digits), F.lit(f"{THIN}%"))


def money(value: Column, currency: str, digits: int = 2) -> Column:
    return F.concat(number(value, digits), F.lit(THIN + currency))


def day(value: Column, code: str = "%d.%m.%Y") -> Column:
    """A date by % codes."""
    for short, pattern in DATE_CODES.items():
        code = code.replace(short, pattern)
    return F.date_format(value, code)


def period_variables(period: Period) -> dict[str, str]:
    """What texts may name: the period, its ends, the two that it is compared with, and the calendar around its last day:
    year, month and quarter, the year before, and the last quarter that had ended by then."""
    before, last_year, end = period.moved(-1), period.a_year_before(), period.last_day
    quarter = Period.around(end, "quarter")
    ended = quarter if quarter.stop <= period.stop else quarter.moved(-1)
    return {
        "period": period.code, "period_start": f"{period.start:%d.%m.%Y}", "period_end": f"{end:%d.%m.%Y}", "year": str(end.year),
        "month": f"{end.month:02}", "quarter": quarter.code[-1], "previous_period": before.code, "last_year_period": last_year.code,
        "unit": period.unit, "previous_year": str(end.year - 1), "quarter_year": str(end.year),
        "last_quarter": ended.code[-1], "last_quarter_year": ended.code[:4], "last_quarter_period": ended.code,
    }


def filled(text: str, values: dict[str, object]) -> str:
    """text with {name} replaced; an unknown name is an error."""
    try:
        return text.format_map(values)
    except KeyError as missing:
        raise ValueError(f"no variable {missing.args[0]!r}; there are {', '.join(values)}") from missing
