"""Ranking of candidates within a contest: shares, margins, winners and totals.

Every ranking names its tie-break; the default is the candidate's name, ascending. The roles are column names: `keys`
identify a contest, `candidate` a row in it, `votes` is a BIGINT.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hustings.functions.numbers import ratio_or_zero


def rank_candidates(df: DataFrame, keys: Sequence[str], candidate: str = "candidate", votes: str = "votes", tie_break: Sequence[str | Column] | None = None) -> DataFrame:
    """position, contest_votes, share, margin_votes and margin_share of every candidate; one sort per contest."""
    order = Window.partitionBy(*keys).orderBy(F.desc(votes), *(tie_break or [candidate]))
    whole = Window.partitionBy(*keys)
    ranked = df.withColumns({"position": F.row_number().over(order), "next_votes": F.lead(votes).over(order), "contest_votes": F.sum(votes).over(whole)})
    v, n, total = F.col(votes), F.coalesce("next_votes", F.lit(0)), F.col("contest_votes")
    return ranked.withColumns({"share": ratio_or_zero(v, total), "margin_votes": v - n, "margin_share": ratio_or_zero(v, total) - ratio_or_zero(n, total)}).drop("next_votes")


def winners(ranked: DataFrame) -> DataFrame:
    return ranked.where("position = 1")


def podium(ranked: DataFrame, keys: Sequence[str], candidate: str = "candidate", votes: str = "votes") -> DataFrame:
    """One row per contest: winner and runner-up with their votes; the runner-up null if uncontested."""
    at = lambda column, k: F.max(F.when(F.col("position") == k, F.col(column)))
    return ranked.where("position <= 2").groupBy(*keys).agg(at(candidate, 1).alias("winner"), at(votes, 1).alias("winner_votes"), at(candidate, 2).alias("runner_up"), at(votes, 2).alias("runner_up_votes"), at("margin_votes", 1).alias("margin_votes"))


def accounts(parts: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Contest totals from (valid, rejected, unreturned): issued is their sum."""
    return parts.groupBy(*keys).agg(*(F.sum(c).cast("bigint").alias(c) for c in ("valid", "rejected", "unreturned"))).withColumn("issued", F.col("valid") + F.col("rejected") + F.col("unreturned"))


def normalise_contests(rows: DataFrame, keys: Sequence[str], ordinal: str = "ordinal") -> DataFrame:
    """Rows to contests: totals, the largest vote as majority base, candidates in order, header from the first row with
    electors (else the first row)."""
    header = F.min_by(F.struct("registered", "rejected", "unreturned"), F.struct((F.col("registered") <= 0).alias("none"), F.col(ordinal)))
    out = rows.groupBy(*keys).agg(header.alias("header"), F.sum("votes").alias("valid"), F.max("votes").alias("top"), F.sort_array(F.collect_list(F.struct((-F.col("votes")).alias("order"), "candidate", "votes"))).alias("listed"))
    return out.select(
        *keys, "valid", "top", F.col("header.registered").alias("registered"), F.col("header.rejected").alias("rejected"), F.col("header.unreturned").alias("unreturned"),
        (F.col("valid") + F.col("header.rejected") + F.col("header.unreturned")).alias("issued"), F.transform("listed", lambda x: F.struct(x["candidate"].alias("candidate"), x["votes"].alias("votes"))).alias("candidates"),
    )


def neighbours(df: DataFrame, keys: Sequence[str], order: Sequence[str | Column], item: str) -> DataFrame:
    """previous and next item in the order, null at the ends."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumns({f"previous_{item}": F.lag(item).over(w), f"next_{item}": F.lead(item).over(w)})


def override(headline: DataFrame, detail: DataFrame, keys: Sequence[str], candidate: str = "candidate") -> DataFrame:
    """Detail votes replace headline votes where there are any; ranks follow from the result."""
    d = detail.select(*keys, candidate, F.col("votes").alias("detail_votes"))
    return rank_candidates(headline.join(d, [*keys, candidate], "left").withColumn("votes", F.coalesce("detail_votes", "votes")).drop("detail_votes"), keys, candidate)


def uncontested(contests: DataFrame) -> DataFrame:
    """Contests with one candidate and no valid vote; unknown votes aren't none."""
    return contests.where((F.col("candidates") == 1) & (F.col("valid") == 0))
