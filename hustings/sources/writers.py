"""Writers: checked, partitioned and guarded output, manifests and logs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hustings.functions.geometry import simplified_rings
from hustings.operators.rules import check, stale


class StaleOutput(RuntimeError):
    """What is published isn't what is computed now."""


def write_or_check(df: DataFrame, path: str, check: bool = False, ignore: Sequence[str] = ()) -> None:
    """Write, or with check compare with what is there and fail if it differs."""
    if not check:
        df.write.mode("overwrite").parquet(path)
    elif not stale(df.sparkSession.read.parquet(path), df, ignore).isEmpty():
        raise StaleOutput(path)


def json_lines(df: DataFrame, path: str) -> None:
    """Compact JSON, columns in the order of their names."""
    df.select(*sorted(df.columns)).write.mode("overwrite").json(path)


def partitioned(df: DataFrame, path: str, by: str) -> None:
    """One folder per value; values no longer present go."""
    df.repartition(by).write.mode("overwrite").partitionBy(by).parquet(path)


def two_tiers(features: DataFrame, path: str, by: str, shape: str, tolerance: float, rows_per_file: int = 10_000) -> None:
    """Features with a ring column, twice, from one scan: simplified as an index of all, and as they are in a folder per
    value of `by`. JSON; layout tier=index/area=all and tier=area/area=<value>."""
    coarse = simplified_rings(F.col(shape), tolerance)
    tiers = F.explode(F.array(F.struct(F.lit("index").alias("tier"), F.lit("all").alias("area"), coarse.alias("ring")), F.struct(F.lit("area").alias("tier"), F.col(by).alias("area"), F.col(shape).alias("ring"))))
    rest = [c for c in features.columns if c != shape]
    rows = features.select(*rest, tiers.alias("t")).select(*rest, "t.tier", "t.area", F.col("t.ring").alias(shape))
    rows.repartition("tier", "area").write.mode("overwrite").option("maxRecordsPerFile", rows_per_file).partitionBy("tier", "area").json(path)


def over_budget(spark: SparkSession, path: str, budgets: dict[str, int]) -> DataFrame:
    """Issues for tiers with a folder of more bytes than the tier's budget."""
    read = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "part-*").load(path)
    part = lambda name: F.regexp_extract("path", f"/{name}=([^/]*)/", 1).alias(name)
    sizes = read.select(part("tier"), part("area"), "length").groupBy("tier", "area").agg(F.sum("length").alias("bytes"))
    most = F.create_map(*(x for tier, n in budgets.items() for x in (F.lit(tier), F.lit(n))))
    return check(sizes.withColumn("budget", F.try_element_at(most, F.col("tier"))), "K4", F.col("bytes") <= F.col("budget"), "more bytes than the budget", F.concat_ws("/", "tier", "area"), ["bytes", "budget"])


def guarded_append(df: DataFrame, path: str, published: DataFrame, keys: Sequence[str]) -> None:
    """Append, unless a row belongs to something already published."""
    hit = df.join(published.select(*keys).distinct(), list(keys), "left_semi")
    if not hit.isEmpty():
        raise PermissionError(f"published results are immutable: {hit.first()}")
    df.write.mode("append").parquet(path)


def manifest(spark: SparkSession, path: str) -> DataFrame:
    """(file, sha256, bytes) of every file below a folder."""
    read = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    return read.select(F.element_at(F.split("path", "/"), -1).alias("file"), F.sha2("content", 256).alias("sha256"), F.col("length").alias("bytes"))


def entity_tag(df: DataFrame, name: str = "etag") -> DataFrame:
    """A digest of each row's JSON."""
    return df.withColumn(name, F.sha2(F.to_json(F.struct(*(F.col(c) for c in df.columns))), 256))
