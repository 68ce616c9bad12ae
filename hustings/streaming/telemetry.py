"""Telemetry: validation at ingest, cleaning, and trailing rollups, as a batch or as a stream.

The same functions serve both: they take a DataFrame, streaming or not. State is bounded by the watermark.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hustings.functions.text import clean_path, clean_text

# Kinds of events, names of vitals, the most bytes of an event.
KINDS = ("web-vital", "client-error", "interaction")
VITALS = ("CLS", "FCP", "INP", "LCP", "TTFB")
MOST_BYTES = 4096


def reason(columns: Sequence[str] = ()) -> Column:
    """Why an event isn't taken in; null if it is. With origin and host among the columns both must name one host."""
    size = F.octet_length(F.to_json(F.struct("kind", "name", "path", "message")))
    found = F.when(size > MOST_BYTES, "payload_too_large")
    if {"origin", "host"} <= set(columns):
        found = found.when(F.col("origin").isNotNull() & ~F.col("host").eqNullSafe(F.regexp_extract("origin", r"^[a-z][a-z0-9+.-]*://([^/?#]+)", 1)), "origin_not_allowed")
    found = found.when(~F.coalesce(F.col("kind").isin(*KINDS), F.lit(False)), "invalid_event")
    return found.when((F.col("kind") == "web-vital") & ~F.coalesce(F.col("name").isin(*VITALS), F.lit(False)), "invalid_metric")


def split(events: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(events taken in, events set aside)."""
    why = reason(events.columns)
    return events.where(why.isNull()), events.where(why.isNotNull())


def taken_in(events: DataFrame) -> DataFrame:
    """The log's rows: texts on one line and cut to length, only finite values, a path from the root; blanks are null."""

    def cut(name: str, length: Column | int) -> Column:
        return F.substring(F.regexp_replace(F.coalesce(name, F.lit("")), r"[\r\n\t]+", " "), F.lit(1), length if isinstance(length, Column) else F.lit(length))

    given = lambda name, kind: F.col(name) if name in events.columns else F.lit(None).cast(kind)
    blank = lambda x: F.nullif(x, F.lit(""))
    path = cut("path", 180)
    value = given("value", "double")
    received = F.date_format("received_at", "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")
    return events.withColumn("occurred_at", given("occurred_at", "string")).select(
        "kind", cut("name", F.when(F.col("kind") == "interaction", 80).otherwise(50)).alias("name"),
        F.when(~F.isnan(value) & (F.abs(value) < float("inf")), value).alias("value"), blank(cut("rating", 20)).alias("rating"),
        F.when(path.startswith("/"), path).otherwise("/").alias("path"), blank(cut("message", 400)).alias("message"),
        F.coalesce(blank(cut("occurred_at", 40)), received).alias("occurred_at"), "received_at",
    )


def cleaned(events: DataFrame) -> DataFrame:
    return events.withColumns({"name": clean_text(F.col("name"), 80), "path": clean_path(F.col("path")), "message": clean_text(F.col("message"), 300)})


def rollup(events: DataFrame, since: Column | None = None) -> DataFrame:
    """By kind and name: samples, mean to three places, and poor ratings."""
    held = events if since is None else events.where(F.col("received_at") >= since)
    return held.groupBy("kind", "name").agg(F.count("*").alias("samples"), F.round(F.avg("value"), 3).alias("average"), F.count_if(F.col("rating") == "poor").alias("poor"))


def trailing(events: DataFrame, days: int = 7, late: str = "1 day") -> DataFrame:
    """The same over sliding windows; on a stream, events later than the watermark are dropped."""
    w = F.window("received_at", f"{days} days", "1 day")
    out = events.withWatermark("received_at", late).groupBy(w, "kind", "name")
    return out.agg(F.count("*").alias("samples"), F.round(F.avg("value"), 3).alias("average"), F.count_if(F.col("rating") == "poor").alias("poor"))
