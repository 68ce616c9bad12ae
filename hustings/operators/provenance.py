"""Which legal version of a boundary a place has on a date, and by which rule."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# The region of each state, and the regions' versions with their dates and orders.
REGIONS = {
    "peninsula": ["perlis", "kedah", "kelantan", "terengganu", "pulau-pinang", "perak", "pahang", "selangor", "wp-kuala-lumpur", "wp-putrajaya", "negeri-sembilan", "melaka", "johor", "wp-labuan"],
    "sabah": ["sabah"],
    "sarawak": ["sarawak"],
}
VERSIONS = [
    ("region", "peninsula", "my-peninsula-2018", "2018-03-29"),
    ("region", "sarawak", "my-sarawak-2015", "2015-12-19"),
    ("region", "sabah", "my-sabah-2019", "2019-08-22"),
]


def registered(spark: SparkSession) -> tuple[DataFrame, DataFrame]:
    """(regions, versions) as registered."""
    regions = spark.createDataFrame([(state, region) for region, states in REGIONS.items() for state in states], "state string, region string")
    versions = spark.createDataFrame(VERSIONS, "scope string, name string, version string, effective_from string")
    return regions, versions.withColumn("effective_from", F.to_date("effective_from"))


def boundary_provenance(places: DataFrame, regions: DataFrame, versions: DataFrame) -> DataFrame:
    """places (place, state, date) with region, version, effective_from and rule.

    regions: (state, region); versions: (scope, name, version, effective_from), scope `state` or `region`. The latest
    version in force on the date decides; one of the state goes before one of its region. A place without any has the
    rule `unregistered state` or `no version in force`, which `unresolved` turns into issues. The log of versions is
    joined by name; its latest row is found after partial aggregation, so a name with many places isn't gathered."""
    asked = places.select("state", "date").distinct().join(regions, "state", "left")
    steps = F.explode(F.array(F.struct(F.lit("state").alias("scope"), F.col("state").alias("name")), F.struct(F.lit("region").alias("scope"), F.col("region").alias("name")))).alias("s")
    chain = asked.select("state", "date", steps).select("state", "date", "s.*").join(versions, ["scope", "name"]).where(F.col("effective_from") <= F.col("date"))
    rank = F.struct((F.col("scope") == "state").cast("int"), "effective_from", "version")
    best = chain.groupBy("state", "date").agg(F.max_by(F.struct("version", "effective_from", "scope", "name"), rank).alias("b"))
    held = places.join(asked, ["state", "date"], "left").join(best, ["state", "date"], "left")
    rule = F.when(F.col("b").isNotNull(), F.concat_ws(" ", "b.scope", "b.name")).when(F.col("region").isNull(), "unregistered state").otherwise("no version in force")
    return held.select(*places.columns, "region", "b.version", "b.effective_from", rule.alias("rule"))


def unresolved(found: DataFrame) -> DataFrame:
    return found.where("version is null").select("place", "state", F.col("rule").alias("reason"))
