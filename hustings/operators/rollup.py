"""Aggregations over contests and hierarchies."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hustings.functions.numbers import ratio_or_null, ratio_or_zero


def composition(winners: DataFrame, keys: Sequence[str], ticket: str = "ticket") -> DataFrame:
    """Seats won by each ticket."""
    return winners.groupBy(*keys, ticket).agg(F.count("*").alias("seats"))


def leaders(counts: DataFrame, keys: Sequence[str], ticket: str = "ticket", count: str = "seats", first: str | None = None) -> DataFrame:
    """The ticket with the most; ties to the one seen first (`first`, an ordinal), else to the least name."""
    order = Window.partitionBy(*keys).orderBy(F.desc(count), first or ticket)
    return counts.withColumn("_place", F.row_number().over(order)).where("_place = 1").drop("_place")


def turnout(contests: DataFrame, keys: Sequence[str]) -> DataFrame:
    """issued / registered where every contest is complete, else weighted by the stated percentage; 0 without electors.

    contests has registered, issued (null if unknown) and stated (a fraction)."""
    complete = F.bool_and(F.col("issued").isNotNull())
    total = F.sum("registered")
    known, guessed = F.sum("issued"), F.sum(F.col("registered") * F.col("stated"))
    return contests.groupBy(*keys).agg(total.alias("registered"), F.when(total == 0, 0.0).when(complete, known / total).otherwise(guessed / total).alias("turnout"))


def hierarchy(df: DataFrame, levels: Sequence[str], metrics: Sequence[str]) -> DataFrame:
    """All levels at once: level 0 is the total, level k has the first k columns set."""
    rolled = df.rollup(*levels).agg(F.grouping_id().alias("_g"), *(F.sum(m).cast("bigint").alias(m) for m in metrics))
    depth = {(1 << (len(levels) - k)) - 1: k for k in range(len(levels) + 1)}
    level = F.lit(None).cast("int")
    for g, k in depth.items():
        level = F.when(F.col("_g") == g, k).otherwise(level)
    return rolled.withColumn("level", level).drop("_g")


def ticket_shares(candidates: DataFrame, keys: Sequence[str], ticket: str = "ticket", votes: str = "votes") -> DataFrame:
    """Votes of each ticket and their share of all votes under the keys."""
    by = candidates.groupBy(*keys, ticket).agg(F.sum(votes).alias("votes"))
    return by.withColumn("share", ratio_or_zero(F.col("votes"), F.sum("votes").over(Window.partitionBy(*keys))))


def share_map(shares: DataFrame, keys: Sequence[str], ticket: str = "ticket", value: str = "share") -> DataFrame:
    return shares.groupBy(*keys).agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct(ticket, value)))).alias("ticket_shares"))


def weighted_rate(df: DataFrame, keys: Sequence[str], weight: str, rate: str) -> DataFrame:
    """Sum of weight times rate over sum of weights, over rows that have both."""
    both = df.where(F.col(weight).isNotNull() & F.col(rate).isNotNull())
    return both.groupBy(*keys).agg(ratio_or_null(F.sum(F.col(weight) * F.col(rate)), F.sum(weight)).alias(rate))


def top_and_others(counts: DataFrame, label: str, count: str, k: int = 9, others: str = "others") -> DataFrame:
    """The k largest and the sum of the rest. The labels are few (categories), their counts come aggregated."""
    order = Window.orderBy(F.desc(count), label)
    ranked = counts.withColumn("_place", F.row_number().over(order))
    return ranked.groupBy(F.when(F.col("_place") <= k, F.col(label)).otherwise(others).alias(label)).agg(F.sum(count).alias(count))


def matrix(df: DataFrame, row: str, column: str, columns: Sequence, value: str) -> DataFrame:
    """A pivot with stated columns; a missing cell is null, not zero."""
    return df.groupBy(row).pivot(column, list(columns)).agg(F.sum(value))


def spine(rows: DataFrame, columns: DataFrame, facts: DataFrame, on: Sequence[str]) -> DataFrame:
    """Every combination of a dimension's rows and the few values of another, with the facts where there are any.

    The values of `columns` travel as one row, so the rows stay where they are."""
    every = columns.agg(F.collect_set(F.struct(*columns.columns)).alias("_every"))
    grid = rows.crossJoin(F.broadcast(every)).withColumn("_one", F.explode("_every")).select(*rows.columns, "_one.*")  # one row
    return grid.join(facts, list(on), "left")


def single_value(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """The one value other than null and zero; 0 without, and `several` where there is more than one."""
    seen = F.collect_set(F.nullif(F.col(value), F.lit(0)))
    return df.groupBy(*keys).agg(F.coalesce(F.get(F.sort_array(seen), F.lit(0)), F.lit(0)).alias(value), (F.size(seen) > 1).alias("several"))


def registry(rows: DataFrame, person: str = "person", name: str = "name", candidacy: str = "candidacy", ordinal: str = "ordinal") -> DataFrame:
    """Per person: the first name as canonical, other spellings as aliases, all candidacies; arrays sorted."""
    folded = rows.groupBy(person).agg(F.min_by(name, ordinal).alias("canonical"), F.collect_set(name).alias("names"), F.sort_array(F.collect_set(candidacy)).alias("candidacies"))
    return folded.withColumn("aliases", F.sort_array(F.filter("names", lambda x: x != F.col("canonical")))).drop("names")


def special_voters(military: Column, police: Column, overseas: Column) -> Column:
    """Voters who vote ahead or by post; null if a part is unknown."""
    return military + police + overseas


def of_latest(df: DataFrame, coverage: str) -> DataFrame:
    """Rows of the latest coverage; the latest is one row, so it is sent to all."""
    return df.join(F.broadcast(df.agg(F.max(coverage).alias(coverage))), coverage).select(*df.columns)
