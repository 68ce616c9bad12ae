"""Labels of dates, places and sections, in the forms that are shown or exchanged."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Short names of the months.
MONTHS = "JAN FEB MAC APR MEI JUN JUL OGO SEP OKT NOV DIS".split()


def iso_date(moment: Column) -> Column:
    """yyyy-MM-dd of a date or of a moment in the session's time zone."""
    return F.date_format(moment, "yyyy-MM-dd")


def baseline(day: Column) -> Column:
    """Midnight of the election's date, from which the edits of a term count."""
    return F.concat(iso_date(day), F.lit("T00:00:00.000Z"))


def day_label(day: Column) -> Column:
    """Two digits, the month's short name in capitals, the year."""
    month = F.element_at(F.array(*map(F.lit, MONTHS)), F.month(day))
    return F.concat_ws(" ", F.lpad(F.dayofmonth(day).cast("string"), 2, "0"), month, F.lpad(F.year(day).cast("string"), 4, "0"))


def year_range(first: Column, last: Column) -> Column:
    """The years of two dates, once if they are the same; null if a date is."""
    a, b = F.year(first).cast("string"), F.year(last).cast("string")
    return F.when(a == b, a).otherwise(F.concat(a, F.lit("–"), b))


def section(code: Column) -> Column:
    """postal, early or ordinary, by the end of a polling district's code; null without a code."""
    return F.when(code.endswith("/UP"), "postal").when(code.endswith("/00"), "early").when(code.isNotNull(), "ordinary")


def place_label(code: Column, name: Column, label: Column) -> Column:
    """code name · label; what is null or empty leaves its separator out."""
    some = lambda x: F.nullif(x, F.lit(""))
    return F.concat_ws(" · ", some(F.concat_ws(" ", some(code), some(name))), some(label))
