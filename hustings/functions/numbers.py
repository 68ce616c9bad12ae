"""Safe ratios, tolerance and integer coercion. Each variant has its own name, since they aren't interchangeable."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def ratio_or_zero(a: Column, b: Column) -> Column:
    return F.when(b == 0, F.lit(0.0)).otherwise(a.cast("double") / b)


def ratio_or_null(a: Column, b: Column) -> Column:
    return F.when(b != 0, a.cast("double") / b)


def ratio_at_least_one(a: Column, b: Column) -> Column:
    """The denominator counts as one at least."""
    return a.cast("double") / F.greatest(b, F.lit(1))


def parts_per_million(a: Column, b: Column) -> Column:
    """a / b in whole millionths, halves up; exact for integers."""
    return F.when(b == 0, F.lit(0).cast("bigint")).otherwise(F.floor((2 * 1_000_000 * a + b) / (2 * b).cast("decimal(38,0)")).cast("bigint"))


def approx_equal(a: Column, b: Column, absolute: float = 2e-6, relative: float = 1e-9) -> Column:
    """False where either is null; true within the absolute or the relative tolerance."""
    near = F.abs(a - b) <= F.greatest(relative * F.greatest(F.abs(a), F.abs(b)), F.lit(absolute))
    return F.coalesce(near, F.lit(False))


def round_fraction(x: Column, digits: int = 6) -> Column:
    """Half to even, as the published form has it."""
    return F.bround(F.coalesce(x, F.lit(0.0)), digits)


def integer_audit(x: Column) -> Column:
    """Null, empty, NULL and - are 0; commas are dropped; anything else must be an integer."""
    bare = F.trim(F.regexp_replace(x, ",", ""))
    return F.when(x.isNull() | bare.isin("", "NULL", "-"), F.lit(0).cast("bigint")).otherwise(bare.cast("bigint"))


def integer_state(x: Column) -> Column:
    """NULL in any case is 0; decimals are cut off."""
    bare = F.trim(F.regexp_replace(x, ",", ""))
    return F.when(x.isNull() | F.upper(bare).isin("", "NULL"), F.lit(0).cast("bigint")).otherwise(bare.cast("double").cast("bigint"))


def integer_strict(x: Column) -> Column:
    """Null and empty are 0, anything else must be an integer."""
    return F.when(x.isNull() | (x == ""), F.lit(0).cast("bigint")).otherwise(x.cast("bigint"))


def integer_digits(x: Column) -> Column:
    """The digits alone; none are null."""
    return F.nullif(F.regexp_replace(x, "[^0-9]", ""), F.lit("")).cast("bigint")


def first_number(x: Column) -> Column:
    """The first run of digits and commas; null without one."""
    return F.nullif(F.regexp_replace(F.regexp_extract(x, r"\d[\d,]*", 0), ",", ""), F.lit("")).cast("bigint")


def percentage(x: Column) -> Column:
    bare = F.trim(F.regexp_replace(x, "%", ""))
    return F.when(x.isNull() | (bare == ""), F.lit(0.0)).otherwise(bare.cast("double") / 100)


def merge_sums(a: Column, b: Column) -> Column:
    """Maps added key by key."""
    return F.map_zip_with(a, b, lambda _, x, y: F.coalesce(x, F.lit(0)) + F.coalesce(y, F.lit(0)))


def changed_keys(a: Column, b: Column) -> Column:
    """Keys whose values differ, with both values."""
    both = F.map_zip_with(a, b, lambda _, x, y: F.struct(x.alias("before"), y.alias("after")))
    return F.map_filter(both, lambda _, v: ~v["before"].eqNullSafe(v["after"]))


def finite(x: Column) -> Column:
    """Whether it is a number: not null, not NaN, not infinite."""
    return x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) != float("inf"))


def same_values(a: Column, b: Column) -> Column:
    """Whether two arrays hold the same values equally often, in any order."""
    return F.array_sort(a) == F.array_sort(b)


def grouped(x: Column) -> Column:
    """Thousands parted by commas, at most three decimals."""
    return F.call_function("format_number", F.round(x, 3), F.lit("#,##0.###"))


def signed(x: Column, digits: int | None = None, suffix: str = "") -> Column:
    """With a plus if positive; zero has no sign. Grouped, or with so many decimals."""
    shown = grouped(x) if digits is None else F.format_string(f"%.{digits}f", x.cast("double"))
    return F.when(x.isNotNull(), F.concat(F.when(x > 0, "+").otherwise(""), shown, F.lit(suffix)))


def percent_text(x: Column, digits: int = 1) -> Column:
    return F.when(x.isNotNull(), F.format_string(f"%.{digits}f%%", x.cast("double") * 100))


# Units of the compact form.
UNITS = {"": 1, "K": 1_000, "J": 1_000_000, "B": 1_000_000_000, "T": 1_000_000_000_000}


def compact(x: Column) -> Column:
    """At most one decimal and the unit in which what is shown stays below a thousand; the last unit takes the rest."""
    shown = lambda n: F.regexp_replace(F.format_string("%.1f", F.round(x.cast("double") / n, 1)), r"\.0$", "")
    *usual, (last, most) = UNITS.items()
    out = F.concat(shown(most), F.lit(last))
    for unit, n in reversed(usual):
        out = F.when(F.round(F.abs(x.cast("double")) / n, 1) < 1000, F.concat(shown(n), F.lit(unit))).otherwise(out)
    return F.when(x.isNotNull(), out)
