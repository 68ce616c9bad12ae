"""Comparison of editions: change of hands, differences, swing, growth and buckets."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def with_baseline(now: DataFrame, before: DataFrame, on: Sequence[str], columns: Sequence[str], prefix: str = "before_") -> DataFrame:
    """Each row with its baseline's columns; null and `has_baseline` false where there is none."""
    base = before.select(*on, *(F.col(c).alias(prefix + c) for c in columns), F.lit(True).alias("has_baseline"))
    return now.join(base, list(on), "left").withColumn("has_baseline", F.coalesce("has_baseline", F.lit(False)))


def changes(joined: DataFrame) -> DataFrame:
    """changed (hands), and differences that are null where a side is; joined has winner, margin, turnout and before_*."""
    return joined.withColumns({
        "changed": F.coalesce(F.col("has_baseline") & (F.col("winner") != F.col("before_winner")), F.lit(False)),
        "margin_change": F.col("margin") - F.col("before_margin"),
        "turnout_change": F.col("turnout") - F.col("before_turnout"),
    })


def swing(now: DataFrame, before_shares: DataFrame, on: Sequence[str]) -> DataFrame:
    """The winner's share minus its ticket's share before: 0 before if it didn't stand, null without a baseline.

    before_shares has the map ticket_shares."""
    joined = now.join(before_shares.select(*on, "ticket_shares"), list(on), "left")
    earlier = F.coalesce(F.element_at("ticket_shares", F.col("ticket")), F.lit(0.0))
    return joined.withColumn("swing", F.when(F.col("ticket_shares").isNotNull(), F.col("share") - earlier)).drop("ticket_shares")


def first_to_last(df: DataFrame, keys: Sequence[str], order: str, value: str) -> DataFrame:
    """First and last value in the order, and growth in percent (0 if the first is 0)."""
    out = df.groupBy(*keys).agg(F.min_by(value, order).alias("first_value"), F.max_by(value, order).alias("last_value"))
    return out.withColumn("growth", F.when(F.col("first_value") == 0, 0.0).otherwise((F.col("last_value") / F.col("first_value") - 1) * 100))


def quartiles(df: DataFrame, value: str, keys: Sequence[str] = ()) -> DataFrame:
    """Linear-interpolated quartiles; zeros without values."""
    q = F.percentile(value, F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)))
    return df.groupBy(*keys).agg(F.coalesce(q, F.array(F.lit(0.0), F.lit(0.0), F.lit(0.0))).alias("thresholds"))


def bucket(value: Column, thresholds: Sequence[Column]) -> Column:
    """The first i with value <= threshold i, else their number."""
    out = F.lit(len(thresholds))
    for i in range(len(thresholds) - 1, -1, -1):
        out = F.when(value <= thresholds[i], i).otherwise(out)
    return out


def diverging_bucket(value: Column, scale: Column) -> Column:
    """0 near zero, else 1 or 2 steps with the sign; scale is the median size, 1 if that is 0."""
    m = F.when(scale == 0, 1.0).otherwise(scale)
    size = F.least(F.lit(2), F.floor(F.abs(value) / m).cast("int"))
    return F.when(F.abs(value) < 0.12 * m, 0).when(value < 0, -size).otherwise(size)


def insights(margin_share: Column, changed: Column, turnout: Column, difference: Column) -> Column:
    """Labels of the notable: close, changed, high and low turnout, large difference."""
    return F.array_compact(F.array(
        F.when(margin_share <= 0.05, F.lit("close")), F.when(changed, F.lit("changed")), F.when(turnout >= 0.8, F.lit("high-turnout")),
        F.when(turnout < 0.6, F.lit("low-turnout")), F.when(F.abs(difference) >= 0.08, F.lit("large-change")),
    ))


def carry_forward(lines: DataFrame, keys: Sequence[str], order: str, heading: str) -> DataFrame:
    """The latest heading at or above each line."""
    w = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return lines.withColumn("carried", F.last(heading, ignorenulls=True).over(w))


def blocks(lines: DataFrame, keys: Sequence[str], order: str, is_header: str) -> DataFrame:
    """Number of the block that each line lies in; a header begins one."""
    w = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return lines.withColumn("block", F.sum(F.col(is_header).cast("int")).over(w))


def gap_segments(points: DataFrame, keys: Sequence[str], position: str, gap: float) -> DataFrame:
    """Number of the segment; a gap larger than `gap` begins one."""
    w = Window.partitionBy(*keys).orderBy(position)
    step = points.withColumn("_new", F.coalesce((F.col(position) - F.lag(position).over(w)) > gap, F.lit(False)).cast("int"))
    return step.withColumn("segment", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_new")


def without_repeats(df: DataFrame, keys: Sequence[str], order: str, value: str) -> DataFrame:
    """Rows whose value isn't that of the row before."""
    w = Window.partitionBy(*keys).orderBy(order)
    return df.withColumn("_before", F.lag(value).over(w)).where(~F.col(value).eqNullSafe(F.col("_before")) | F.col("_before").isNull()).drop("_before")
