"""Joins that enforce their contract: a duplicate or a missing row fails the query and is named in the message.

The check is a filter inside the plan, so no column pruning can drop it and no second pass is needed: each side is
grouped by its key, which deals it as the join needs it.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _keyed(df: DataFrame, keys: Sequence[str], name: str) -> DataFrame:
    """One row per key: how many rows it has, and the first one's other columns."""
    rest = [c for c in df.columns if c not in keys]
    return df.groupBy(*keys).agg(F.count("*").alias(f"_n_{name}"), F.first(F.struct(*(F.col(c) for c in rest), F.lit(1).alias("_"))).alias(f"_{name}"))


def _demand(df: DataFrame, wrong: Column, keys: Sequence[str], message: str) -> DataFrame:
    key = F.concat_ws(", ", *(F.concat(F.lit(f"{k}="), F.coalesce(F.col(k).cast("string"), F.lit("null"))) for k in keys))
    return df.where(F.when(wrong, F.raise_error(F.concat(F.lit(f"{message}: "), key)).cast("boolean")).otherwise(True))


def one_to_one(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The join of two sides that have the same keys, once each; anything else fails. Null keys equal each other."""
    a, b = _keyed(left, keys, "left"), _keyed(right, keys, "right")
    on = [F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}")) for k in keys]
    both = a.alias("a").join(b.alias("b"), on, "full").select(*(F.coalesce(f"a.{k}", f"b.{k}").alias(k) for k in keys), "_n_left", "_left", "_n_right", "_right")
    both = _demand(both, F.col("_n_left").isNull(), keys, "missing on the left")
    both = _demand(both, F.col("_n_right").isNull(), keys, "missing on the right")
    both = _demand(both, F.col("_n_left") > 1, keys, "duplicate on the left")
    both = _demand(both, F.col("_n_right") > 1, keys, "duplicate on the right")
    return both.select(*keys, *(F.col(f"_left.{c}").alias(c) for c in left.columns if c not in keys), *(F.col(f"_right.{c}").alias(c) for c in right.columns if c not in keys))


def mandatory(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Every row of the left with its one row of the right; a key without one, or with several, fails."""
    b = _keyed(right, keys, "right")
    both = left.join(b, list(keys), "left")
    both = _demand(both, F.col("_n_right").isNull(), keys, "nothing to look up")
    both = _demand(both, F.col("_n_right") > 1, keys, "several to look up")
    return both.select(*left.columns, *(F.col(f"_right.{c}").alias(c) for c in right.columns if c not in keys))


def resolved(rows: DataFrame, targets: DataFrame, on: Sequence[str], key: str, strict: bool = True) -> DataFrame:
    """rows with `key` filled in where it is null: by the one target of the same `on`.

    Without exactly one target the row fails, or if not strict keeps its null. Targets are rows of `on` and `key`."""
    only = targets.groupBy(*on).agg(F.count("*").alias("_n"), F.first(key).alias("_found"))
    both = rows.join(only, list(on), "left")
    if strict:
        both = _demand(both, F.col(key).isNull() & ~F.col("_n").eqNullSafe(F.lit(1).cast("long")), on, f"{key} can't be resolved")
    return both.select(*(F.coalesce(key, F.when(F.col("_n") == 1, F.col("_found"))).alias(c) if c == key else F.col(c) for c in rows.columns))
