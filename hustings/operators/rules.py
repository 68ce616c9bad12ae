"""Rules: each turns data into issue rows (severity, rule_id, message, code, details)."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hustings.functions.numbers import approx_equal
from hustings.functions.text import upper_with_spaces

SCHEMA = "severity string, rule_id string, message string, code string, details map<string,string>"


def issues(df: DataFrame, rule_id: str, message: str, code: Column, details: Sequence[str] = (), severity: str = "error") -> DataFrame:
    pairs = [x for c in details for x in (F.lit(c), F.col(c).cast("string"))]
    return df.select(F.lit(severity).alias("severity"), F.lit(rule_id).alias("rule_id"), F.lit(message).alias("message"), code.cast("string").alias("code"), (F.create_map(*pairs) if pairs else F.create_map().cast("map<string,string>")).alias("details"))


def check(df: DataFrame, rule_id: str, holds: Column, message: str, code: Column, details: Sequence[str] = (), severity: str = "error") -> DataFrame:
    """An issue for each row where the predicate is false; where it is null (a part is unknown) there is none."""
    return issues(df.where(~F.coalesce(holds, F.lit(True))), rule_id, message, code, details, severity)


def duplicate_keys(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    n = df.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")
    return issues(n, "V2", "duplicate key", F.concat_ws(":", *keys), ["n"])


def coverage(actual: DataFrame, expected: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Missing and extra keys."""
    missing = expected.select(*keys).distinct().join(actual.select(*keys).distinct(), list(keys), "left_anti")
    extra = actual.select(*keys).distinct().join(expected.select(*keys).distinct(), list(keys), "left_anti")
    return issues(missing, "V3", "missing key", F.concat_ws(":", *keys)).unionByName(issues(extra, "V3", "unexpected key", F.concat_ws(":", *keys)))


def cardinality(df: DataFrame, name: str, expected: int) -> DataFrame:
    n = df.agg(F.count("*").alias("n"))
    return check(n, "V4", F.col("n") == expected, f"{name}: expected {expected} rows", F.lit(name), ["n"])


def orphans(df: DataFrame, parents: DataFrame, keys: Sequence[str]) -> DataFrame:
    return issues(df.join(parents.select(*keys).distinct(), list(keys), "left_anti"), "V17", "no such parent", F.concat_ws(":", *keys))


def contest_rules(contests: DataFrame, code: Column) -> DataFrame:
    """V5-V11 on one row per contest: valid, candidate_votes, issued, rejected, unreturned, winner_votes, top_votes,
    margin, stated_margin, turnout, stated_turnout, candidates, stated_candidates; a missing column skips its rule."""
    have = set(contests.columns)
    wanted = [
        ("V5", {"valid", "candidate_votes"}, lambda: F.col("valid") == F.col("candidate_votes"), "candidate votes don't add up to valid votes"),
        ("V6", {"issued", "valid", "rejected", "unreturned"}, lambda: F.col("issued") == F.col("valid") + F.col("rejected") + F.col("unreturned"), "issued isn't valid + rejected + unreturned"),
        ("V7", {"winner_votes", "top_votes"}, lambda: F.col("winner_votes") == F.col("top_votes"), "the winner hasn't the most votes"),
        ("V8", {"margin", "stated_margin"}, lambda: F.col("margin") == F.col("stated_margin"), "the majority isn't that of the two first"),
        ("V10", {"turnout", "stated_turnout"}, lambda: F.when(F.col("turnout").isNotNull() & F.col("stated_turnout").isNotNull(), approx_equal(F.col("turnout"), F.col("stated_turnout"))), "turnout differs"),
        ("V11", {"candidates", "stated_candidates"}, lambda: F.col("candidates") == F.col("stated_candidates"), "number of candidates differs"),
    ]
    found = [check(contests, rule, holds(), message, code, sorted(columns)) for rule, columns, holds, message in wanted if columns <= have]
    return reduce(DataFrame.unionByName, found)


def cross_source(a: DataFrame, b: DataFrame, keys: Sequence[str], fields: Sequence[str], declared: DataFrame | None = None) -> DataFrame:
    """Fields that differ between two sources, without declared exceptions (keys and field)."""
    long = lambda df, name: df.unpivot(list(keys), list(fields), "field", name)
    both = long(a, "first").join(long(b, "second"), [*keys, "field"], "full").where(~F.col("first").eqNullSafe(F.col("second")))
    if declared is not None:
        both = both.join(declared, [*keys, "field"], "left_anti")
    return issues(both, "V13", "sources differ", F.concat_ws(":", *keys), ["field", "first", "second"])


def detail_against_headline(detail: DataFrame, headline: DataFrame, keys: Sequence[str], fields: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """V12: one issue per contest whose detail differs from its headline in a field, with both values of each such field;
    and one row with the number of contests that agree in all (`matches`) and that have both (`compared`)."""
    a = detail.select(*keys, *(F.col(c).cast("string").alias(f"_{c}") for c in fields))
    joined = a.join(headline.select(*keys, *(F.col(c).cast("string").alias(c) for c in fields)), list(keys))
    pairs = F.filter(F.array(*(F.struct(F.lit(c).alias("key"), F.when(~F.col(f"_{c}").eqNullSafe(F.col(c)), F.concat(F.coalesce(f"_{c}", F.lit("null")), F.lit(" and "), F.coalesce(c, F.lit("null")))).alias("value")) for c in fields)), lambda x: x["value"].isNotNull())
    both = joined.select(F.concat_ws(":", *keys).alias("code"), F.map_from_entries(pairs).alias("details"))
    found = both.where(F.size("details") > 0).select(F.lit("error").alias("severity"), F.lit("V12").alias("rule_id"), F.lit("detail differs from the headline").alias("message"), "code", "details")
    return found, both.agg(F.count_if(F.size("details") == 0).alias("matches"), F.count("*").alias("compared"))


def parts_sum(df: DataFrame, whole: str, parts: Sequence[str], code: Column) -> DataFrame:
    return check(df, "V15", F.col(whole) == reduce(lambda x, y: x + y, map(F.col, parts)), f"{' + '.join(parts)} isn't {whole}", code, [whole, *parts])


def run_status(found: DataFrame) -> DataFrame:
    """One row: counts by severity, and failed, warning or passed."""
    n = found.agg(F.count_if(F.col("severity") == "error").alias("errors"), F.count_if(F.col("severity") == "warning").alias("warnings"))
    return n.withColumn("status", F.when(F.col("errors") > 0, "failed").when(F.col("warnings") > 0, "warning").otherwise("passed"))


def stale(published: DataFrame, recomputed: DataFrame, ignore: Sequence[str] = ()) -> DataFrame:
    """Rows of either side that the other lacks; empty when nothing is stale."""
    columns = [c for c in published.columns if c not in ignore]
    a, b = published.select(*columns), recomputed.select(*columns)
    return a.exceptAll(b).withColumn("side", F.lit("published")).unionByName(b.exceptAll(a).withColumn("side", F.lit("recomputed")))


def identity(datasets: DataFrame, registered: DataFrame, key: str, fields: Sequence[str]) -> DataFrame:
    """V1: datasets whose key is not registered, or that differ from their registration in a field."""
    other = registered.select(F.col(key), F.lit(True).alias("_there"), *(F.col(c).alias(f"_{c}") for c in fields))
    joined = datasets.join(other, key, "left")
    same = reduce(lambda a, b: a & b, (F.col(c).eqNullSafe(F.col(f"_{c}")) for c in fields))
    return check(joined, "V1", F.coalesce(F.col("_there"), F.lit(False)) & same, "identity isn't that of the registry", F.col(key), list(fields))


def hierarchy_sums(children: DataFrame, parents: DataFrame, keys: Sequence[str], metrics: Sequence[str]) -> DataFrame:
    """V14: metrics of parents that aren't the sums of their children; a parent without children sums to zero."""
    sums = children.groupBy(*keys).agg(*(F.sum(c).alias(f"_{c}") for c in metrics))
    joined = parents.join(sums, list(keys), "left")
    found = [check(joined.select(*keys, F.col(c).alias("stated"), F.coalesce(f"_{c}", F.lit(0)).alias("added"), F.lit(c).alias("metric")), "V14", F.col("stated") == F.col("added"), "children don't add up", F.concat_ws(":", *keys), ["metric", "stated", "added"]) for c in metrics]
    return reduce(DataFrame.unionByName, found)


def expected_counts(counts: DataFrame, label: str, count: str, expected: dict[str, int]) -> DataFrame:
    """V20: labels whose count isn't the expected one; labels missing on either side count as zero there."""
    stated = F.explode(F.map_from_arrays(F.array(*map(F.lit, expected)), F.array(*map(F.lit, expected.values())))).alias(label, "expected")
    both = counts.join(counts.sparkSession.range(1).select(stated), label, "full")
    both = both.select(label, F.coalesce(count, F.lit(0)).alias("n"), F.coalesce("expected", F.lit(0)).alias("expected"))
    return check(both, "V20", F.col("n") == F.col("expected"), "another count than expected", F.col(label), ["n", "expected"])


def report(found: DataFrame, release: str) -> tuple[DataFrame, DataFrame]:
    """K7: the run row (release, counts, status) and its issue rows, which carry the release."""
    return run_status(found).withColumn("release", F.lit(release)), found.withColumn("release", F.lit(release))


def tuple_differences(left: DataFrame, right: DataFrame, keys: Sequence[str], normalise=upper_with_spaces) -> DataFrame:
    """(side, keys): normalised tuples that only one side has, once each; none if the sets are equal."""
    a, b = (df.select(*(normalise(F.col(k).cast("string")).alias(k) for k in keys)) for df in (left, right))
    return a.subtract(b).select(F.lit("left").alias("side"), *keys).unionByName(b.subtract(a).select(F.lit("right").alias("side"), *keys))
