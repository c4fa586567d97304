"""Date text to timestamps without a zone, in Catalyst expressions.

Every style is rewritten to ISO text by a chain of replacements and cast once,
so the session's time zone never matters and the generated code stays small. An
offset or Z is dropped and the wall time kept.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MONTHS = ["jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec"]
#: Seconds since 1970 at which the years 1990 and 2041 begin: the epochs read.
EPOCHS = (631_152_000, 2_240_611_200)
_ZONE = r"(?i)(?<=:\d\d|\.\d{1,9})\s*(?:Z|UTC|[+-]\d{2}:?\d{2})$"
_ISO = r"^\d{4}-\d{1,2}-\d{1,2}(?:[T ]\d{1,2}:\d{2}(?::\d{2}(?:\.\d{1,6})?)?)?$"
_MONTH, _DAY = r"(0?[1-9]|1[0-2])", r"(\d{1,2})"


def from_epoch(text: Column) -> Column:
    """Digits as epoch seconds, milliseconds or microseconds, by magnitude."""
    n = F.when(F.trim(text).rlike(r"^\d{9,16}(\.0+)?$"), F.regexp_replace(F.trim(text), r"\..*", "")).cast("long")
    low, high = EPOCHS
    inside = lambda unit: (n >= low * unit) & (n < high * unit)
    micros = F.when(inside(1), n * 1_000_000).when(inside(1000), n * 1000).when(inside(1_000_000), n)
    seconds = (micros.cast("decimal(18,0)") / F.lit(1_000_000).cast("decimal(7,0)")).cast("decimal(18,6)")
    zero = F.lit(0)
    return F.lit("1970-01-01 00:00:00").cast("timestamp_ntz") + F.make_dt_interval(zero, zero, zero, seconds)


def _to_iso(text: Column, day_first: bool) -> Column:
    got = F.regexp_replace(F.regexp_replace(F.trim(text), _ZONE, ""), r"^(\d{4})[/.](\d{1,2})[/.]", "$1-$2-")
    # "5 January 2025" and "Jan 5, 2025": the name's place in a string of names.
    name = F.lower(F.regexp_extract(got, r"(?i)^(?:\d{1,2}[a-z]{0,2}[ -])?([a-z]{3})", 1))
    place = F.instr(F.lit("".join(MONTHS)), name)
    number = F.when((place > 0) & (place % 3 == 1), ((place + 2) / 3).cast("int"))
    parts = F.regexp_replace(got, r"(?i)^(\d{1,2})[a-z]{0,2}[ -][a-z]+\.?,?[ -](\d{4})|^[a-z]+\.? (\d{1,2})(?:st|nd|rd|th)?,? (\d{4})", "$2$4-#-$1$3")
    got = F.when(name != "", F.replace(parts, F.lit("#"), number.cast("string"))).otherwise(got)
    by_day, by_month = (_DAY, _MONTH, "$3-$2-$1"), (_MONTH, _DAY, "$3-$1-$2")
    for a, b, order in (by_day, by_month) if day_first else (by_month, by_day):
        got = F.regexp_replace(got, rf"^{a}[/.-]{b}[/.-](\d{{4}})\b", order)
    return got


def parse_timestamp(text: Column, day_first: bool = False) -> Column:
    """A timestamp without zone from date text, null where it is none.

    Read are ISO dates with -, / or points, day and month by number in the order
    asked for and, where that can't be, in the other one, month names, and
    epochs. Times have at most six digits of a second.
    """
    iso = _to_iso(text, day_first)
    return F.coalesce(F.when(iso.rlike(_ISO), iso).try_cast("timestamp_ntz"), from_epoch(text))


def order_shares(text: Column) -> tuple[Column, Column]:
    """Aggregates: the shares of values that can have the month first, and the
    day first; see ``is_day_first``."""
    share = lambda a, b: F.avg(F.coalesce(F.trim(text).rlike(rf"^{a}[/.-]{b}[/.-]\d{{4}}\b"), F.lit(False)).cast("double"))
    return share(_MONTH, r"\d{1,2}"), share(r"(?:[0-2]?\d|3[01])", _MONTH)


def is_day_first(df: DataFrame, column: str) -> bool:
    """Whether the day stands first: it reads over 2 points more of the values."""
    row = df.agg(*order_shares(F.col(column))).first()
    return (row[1] or 0.0) > (row[0] or 0.0) + 0.02
