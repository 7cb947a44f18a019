"""Values as numbers, dates and text, without errors."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidemark.functions.names import PRICE_UNIT


def finite(value: Column) -> Column:
    """The value as a double; null if it isn't a finite number."""
    number = value.try_cast("double")
    return F.when(~F.isnan(number) & (F.abs(number) != float("inf")), number)


def first_finite(*values: Column) -> Column:
    return F.coalesce(*(finite(v) for v in values))


def whole(value: Column) -> Column:
    """The value cut to a whole number; null if it isn't finite. Prices are coerced so, too."""
    number = finite(value)
    return F.when(number >= 0, F.floor(number)).otherwise(F.ceil(number)).cast("long")


def dollars(price: Column) -> Column:
    """A price in its fixed unit as dollars; null if it isn't finite."""
    return finite(price) / PRICE_UNIT


def compact_date(day: Column) -> Column:
    """A day as eight digits."""
    return F.replace(day.cast("date").cast("string"), F.lit("-"), F.lit(""))


def window_suffix(ms: Column) -> Column:
    """The part of a column name that stands for a window: ``names.suffix`` for a column."""
    seconds = F.concat(F.format_string("%.1f", ms / 1000.0), F.lit("s"))
    return F.when(ms >= 60_000, F.concat(F.floor(ms / 1000).cast("string"), F.lit("s"))).when(ms >= 1000, seconds).otherwise(F.concat(ms.cast("string"), F.lit("ms")))


def ns_text(ns: Column) -> Column:
    """Nanoseconds since the epoch as a time in UTC, whatever the session's time zone."""
    second = F.floor(ns / 1_000_000_000)
    days, rest = F.floor(second / 86_400).cast("int"), F.pmod(second, F.lit(86_400))
    clock = F.format_string("%02d:%02d:%02d", F.floor(rest / 3600), F.floor(rest / 60) % 60, rest % 60)
    part = F.pmod(ns, F.lit(1_000_000_000))
    return F.concat(F.date_add(F.lit("1970-01-01").cast("date"), days).cast("string"), F.lit(" "), clock, F.when(part == 0, "").otherwise(F.format_string(".%09d", part)), F.lit("+00:00"))


def filled(labelled_status: Column, original_status: Column, labelled_event: Column, original_event: Column, otherwise: Column) -> Column:
    """Whether a labelled order was filled: by the first known status, else by the first known event, else ``otherwise``."""

    def known(status: Column) -> Column:
        text = F.upper(status.cast("string"))
        return F.when(text.isNotNull() & ~text.isin("", "NAN", "NONE"), text)

    status, event = F.coalesce(known(labelled_status), known(original_status)), F.coalesce(whole(labelled_event), whole(original_event))
    return F.when(status.isNotNull(), status == "FILLED").when(event.isNotNull(), event.isin(1, 2)).otherwise(otherwise)
