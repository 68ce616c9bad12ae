"""Editions of a dataset, read as a registry says.

A folder has `metadata` (one row per edition) and datasets partitioned by edition. The registry decides which folders are
opened: the keys of a registry of at most MOST rows become a filter on the partition column; a larger one is only joined.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hustings.operators.joins import mandatory
from hustings.sources.readers import nothing

MOST = 10_000


def verified(spark: SparkSession, path: str, registry: DataFrame, identity: Sequence[str], key: str = "edition") -> DataFrame:
    """The registry's rows; one that the published metadata lack, or contradict in a field, fails the query."""
    published = spark.read.parquet(f"{path}/metadata").select(key, *(F.col(c).alias(f"_{c}") for c in identity))
    both = mandatory(registry, published, [key])
    for c in identity:
        said = F.concat(F.lit(f"{c} of edition "), F.col(key).cast("string"), F.lit(" isn't the registered one: "), F.coalesce(F.col(f"_{c}").cast("string"), F.lit("null")))
        both = both.where(F.when(~F.col(c).eqNullSafe(F.col(f"_{c}")), F.raise_error(said).cast("boolean")).otherwise(True))
    return both.select(*registry.columns)


def scan(spark: SparkSession, path: str, dataset: str, registry: DataFrame, identity: Sequence[str], key: str = "edition") -> DataFrame:
    """A dataset's rows of all registered editions, each verified, with the registry's columns."""
    rows, checked = spark.read.parquet(f"{path}/{dataset}"), verified(spark, path, registry, identity, key)
    keys = [r[0] for r in registry.select(key).limit(MOST + 1).collect()]  # bounded
    if len(keys) > MOST:
        return rows.join(checked, key)
    return rows.where(F.col(key).isin(keys)).join(F.broadcast(checked), key)


def optional(spark: SparkSession, path: str, dataset: str, registry: DataFrame, capability: str, schema: str, identity: Sequence[str], key: str = "edition") -> DataFrame:
    """As `scan`, of the editions that have the capability; typed and empty if none has. A dataset that isn't published
    is then never opened."""
    have = registry.where(F.coalesce(F.col(capability), F.lit(False)))
    if have.isEmpty():
        return nothing(spark, schema)
    columns = nothing(spark, schema).columns
    return scan(spark, path, dataset, have, identity, key).select(*columns)
