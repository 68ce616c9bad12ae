"""Search, typeahead and drill-down."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hustings.functions.labels import place_label


def contains_any(df: DataFrame, columns: Sequence[str], needle: str, fold=F.lower) -> DataFrame:
    """Rows in which any of the columns contains the needle, both folded; an empty needle finds all."""
    if not needle.strip():
        return df
    wanted = fold(F.lit(needle.strip()))
    return df.where(reduce(lambda a, b: a | b, (F.contains(fold(F.col(c)), wanted) for c in columns)))


def options(df: DataFrame, column: str, needle: str = "", limit: int = 60) -> DataFrame:
    """The first distinct non-empty values that contain the needle, in order."""
    found = df.select(column).where(F.col(column).isNotNull() & (F.col(column) != "")).distinct()
    return contains_any(found, [column], needle).orderBy(column).limit(limit)


def chosen(df: DataFrame, column: str, value, everything: object = "ALL") -> DataFrame:
    """A filter that is skipped for the value that stands for all."""
    return df if value == everything else df.where(F.col(column) == value)


def drill(levels: DataFrame, names: Sequence[str], selected: Sequence) -> DataFrame:
    """Children of the deepest selected level; levels is a hierarchy with `level` and a column for each name."""
    depth = len(selected)
    held: Column = reduce(lambda a, b: a & b, (F.col(n) == v for n, v in zip(names, selected, strict=False)), F.lit(True))
    return levels.where(held & (F.col("level") == depth + 1))


def resolve_events(asked: DataFrame, events: DataFrame) -> DataFrame:
    """asked (id, first, second) with `event` and `redirect`: what a route's two parts mean.

    A state and a year (first isn't a number, second is) mean the state's event of that year; a number and a state the
    event of that assembly; a state alone (first null) its latest event. Of several the latest counts, then the greatest
    event. redirect: there is one, and the route isn't the assembly's own. events: event, state, number, year, date."""
    digits = lambda c: F.coalesce(F.col(c).rlike("^[0-9]+$"), F.lit(False))
    legacy = F.col("first").isNotNull() & ~digits("first") & digits("second")
    rows = asked.withColumn("legacy", legacy).withColumn("state", F.when(F.col("legacy"), F.col("first")).otherwise(F.col("second")))
    wanted = F.when(F.col("legacy"), F.col("year") == F.col("second").try_cast("int")).otherwise(F.col("first").isNull() | F.coalesce(F.col("number") == F.col("first").try_cast("bigint"), F.lit(False)))
    best = rows.join(events, "state").where(wanted).groupBy("id").agg(F.max_by("event", F.struct("date", "event")).alias("event"))
    redirect = F.col("event").isNotNull() & (F.col("legacy") | F.col("first").isNull())
    return rows.join(best, "id", "left").select("id", "event", redirect.alias("redirect"))


def page(df: DataFrame, order: Sequence, number: int, size: int) -> DataFrame:
    return df.orderBy(*order).offset(number * size).limit(size)


def last_value_first_place(entries: DataFrame, label: str, order: str) -> DataFrame:
    """One row per label, with the other columns of its last entry and the place of its first in `order`."""
    rest = [c for c in entries.columns if c not in (label, order)]
    kept = entries.groupBy(label).agg(F.max_by(F.struct(*rest), order).alias("_last"), F.min(order).alias(order))
    return kept.select(label, order, *(F.col(f"_last.{c}").alias(c) for c in rest))


def offered(areas: DataFrame, results: DataFrame, heading: str = "NEGERI") -> DataFrame:
    """(label, place, area, feature): what a search offers, before its labels are made distinct.

    Areas (area, name) come first under their heading, then for each result (area, feature, code, name, winner, terms) its
    own label and one per distinct term. place orders them: kind of entry, area or feature, place within the result."""
    named = areas.select(place_label(F.lit(heading), F.lit(None), F.col("name")).alias("label"), F.struct(F.lit(0).alias("kind"), F.col("area").alias("of"), F.lit(0).alias("n")).alias("place"), "area", F.lit(None).cast(results.schema["feature"].dataType).alias("feature"))
    title = place_label(F.col("code"), F.col("name"), F.lit(None))
    terms = F.array_distinct(F.coalesce("terms", F.array().cast("array<string>")))
    labels = F.concat(F.array(place_label(F.col("code"), F.col("name"), F.col("winner"))), F.transform(terms, lambda t: place_label(F.lit(None), t, title)))
    found = results.select("area", "feature", F.posexplode(labels).alias("n", "label"))
    return named.unionByName(found.select("label", F.struct(F.lit(1).alias("kind"), F.col("feature").alias("of"), "n").alias("place"), "area", "feature"))
