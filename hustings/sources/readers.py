"""Readers: declared schemas, strict modes, and files as rows."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from hustings.functions.text import cells


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def json_documents(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    """Whole-file JSON; a root that isn't what the schema says is an error."""
    return spark.read.schema(schema).option("multiLine", True).option("mode", "FAILFAST").json(path)


def csv_table(spark: SparkSession, path: str) -> DataFrame:
    """All strings, with a header; a byte-order mark before the first name is dropped."""
    df = spark.read.option("header", True).option("inferSchema", False).csv(path)
    return df.toDF(*(c.lstrip("﻿") for c in df.columns))


def files(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """(path, name, code, bytes, sha256) of files below a folder; code is P.ddd in the name."""
    read = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(path)
    name = F.element_at(F.split("path", "/"), -1)
    return read.select("path", name.alias("name"), F.nullif(F.regexp_extract(name, r"(P\.\d{3})", 1), F.lit("")).alias("code"), F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"))


def locked(found: DataFrame, registered: DataFrame) -> DataFrame:
    """Files whose digest is the registered one; another digest fails the query."""
    joined = found.join(registered.select("name", F.col("sha256").alias("_expected")), "name")
    return joined.withColumn("sha256", F.when(F.col("sha256") == F.col("_expected"), F.col("sha256")).otherwise(F.raise_error(F.concat(F.lit("digest of "), "name", F.lit(" isn't the registered one"))))).drop("_expected")


def mismatched(found: DataFrame, registered: DataFrame) -> DataFrame:
    """Files with the outcome that `locked` would have for each: read, refused, or unregistered."""
    joined = found.join(registered.select("name", F.col("sha256").alias("_expected")), "name", "left")
    outcome = F.when(F.col("_expected").isNull(), "unregistered").when(F.col("sha256") == F.col("_expected"), "read").otherwise("refused")
    return joined.withColumn("outcome", outcome).drop("_expected")


def unify(parts: list[DataFrame]) -> DataFrame:
    """Union by name of differently laid-out sources; absent columns are null."""
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part, allowMissingColumns=True)
    return out


def nothing(spark: SparkSession, schema: StructType | str) -> DataFrame:
    """A typed empty table, for a dataset that isn't published."""
    return spark.createDataFrame([], schema)


def placemarks(spark: SparkSession, path: str) -> DataFrame:
    """(path, name, description, rings) of KML or KMZ files; a ring is its coordinate text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        local = lambda e: e.tag.rsplit("}", 1)[-1]
        for batch in batches:
            for source, content in zip(batch.column("path").to_pylist(), batch.column("content").to_pylist(), strict=True):
                if content[:2] == b"PK":
                    with zipfile.ZipFile(io.BytesIO(content)) as packed:
                        content = packed.read(next(n for n in packed.namelist() if n.lower().endswith(".kml")))
                rows = []
                for mark in (e for e in ElementTree.fromstring(content).iter() if local(e) == "Placemark"):
                    first = lambda tag, mark=mark: next(((e.text or "").strip() for e in mark.iter() if local(e) == tag), None)
                    rows.append({"path": source, "name": first("name"), "description": first("description"), "rings": [" ".join((e.text or "").split()) for e in mark.iter() if local(e) == "coordinates"]})
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, pa.schema([("path", pa.string()), ("name", pa.string()), ("description", pa.string()), ("rings", pa.list_(pa.string()))]))

    read = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("path", "content")
    return read.mapInArrow(run, "path string, name string, description string, rings array<string>")


def coordinates(text):
    """lon,lat[,alt] tokens as points."""
    return F.transform(F.filter(F.split(F.trim(text), r"\s+"), lambda t: t != ""), lambda t: F.struct(F.split(t, ",")[0].cast("double").alias("x"), F.split(t, ",")[1].cast("double").alias("y")))


def _marks(stream) -> Iterator[dict]:
    """The placemarks of a KML stream, one at a time: what has been read is forgotten."""
    local = lambda e: e.tag.rsplit("}", 1)[-1]
    text = lambda e: " ".join((e.text or "").split())
    first = lambda e, tag: next((x for x in e.iter() if local(x) == tag and (x.text or "").strip()), None)
    own = lambda e, tag: next((x.text or "" for x in e if local(x) == tag), "").strip()
    parents: list[ElementTree.Element] = []
    for event, element in ElementTree.iterparse(stream, events=("start", "end")):
        if event == "start":
            parents.append(element)
            continue
        parents.pop()
        if local(element) == "Placemark":
            polygons = []
            for polygon in (e for e in element.iter() if local(e) == "Polygon"):
                rings = {kind: [text(c) for b in polygon if local(b) == kind and (c := first(b, "coordinates")) is not None] for kind in ("outerBoundaryIs", "innerBoundaryIs")}
                if rings["outerBoundaryIs"]:
                    polygons.append({"outer": rings["outerBoundaryIs"][0], "inners": rings["innerBoundaryIs"]})
            yield {"label": own(element, "name"), "description": own(element, "description"), "polygons": polygons}
            element.clear()
            if parents:
                parents[-1].remove(element)


def boundary_marks(spark: SparkSession, path: str) -> DataFrame:
    """(path, label, description, polygons) of KML files and of the KML in KMZ archives; an archive without one fails.

    A polygon is its outer ring and its holes, each a list of points. Archive members are inflated and parsed as a stream."""
    ring = pa.list_(pa.string())
    fields = pa.schema([("path", pa.string()), ("label", pa.string()), ("description", pa.string()), ("polygons", pa.list_(pa.struct([("outer", pa.string()), ("inners", ring)])))])

    def of(source: str, content: pa.Buffer) -> Iterator[dict]:
        stream = pa.BufferReader(content)
        if content.slice(0, 2).to_pybytes() != b"PK":
            yield from _marks(stream)
            return
        with zipfile.ZipFile(stream) as packed:
            name = next((n for n in packed.namelist() if n.lower().endswith(".kml")), None)
            if name is None:
                raise ValueError(f"no KML in {source}")
            with packed.open(name) as member:
                yield from _marks(member)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for source, content in zip(batch.column("path").to_pylist(), batch.column("content"), strict=True):
                rows = []
                for mark in of(source, content.as_buffer()):
                    rows.append({"path": source, **mark})
                    if len(rows) == 64:
                        yield pa.RecordBatch.from_pylist(rows, fields)
                        rows = []
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, fields)

    read = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("path", "content")
    found = read.mapInArrow(run, "path string, label string, description string, polygons array<struct<outer: string, inners: array<string>>>")
    points = F.transform("polygons", lambda p: F.struct(coordinates(p["outer"]).alias("outer"), F.transform(p["inners"], coordinates).alias("inners")))
    return found.withColumn("polygons", points)


def boundaries(marks: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(features, issues) of placemarks labelled "P. 12 NAME" or "N. 3 NAME"; others are left out.

    features: layer, code, name, state, area, polygons. A labelled placemark without a polygon is an issue."""
    pattern = r"(?i)^([PN])\.\s*(\d+)\s+(.+)$"
    part = lambda k: F.regexp_extract("label", pattern, k)
    federal = F.upper(part(1)) == "P"
    rows = marks.where(F.col("label").rlike(pattern)).withColumn("fields", cells(F.col("description")))
    number = part(2).cast("int").cast("string")
    wide = F.when(federal, 3).otherwise(2)
    code = F.concat(F.upper(part(1)), F.lit("."), F.when(F.length(number) < wide, F.lpad(number, wide, F.lit("0"))).otherwise(number))
    features = rows.select(
        "path", F.when(federal, "parliament").otherwise("dun").alias("layer"), code.alias("code"), F.upper(F.trim(part(3))).alias("name"),
        F.upper(F.trim(F.coalesce(F.col("fields")["NAMA_NEGERI"], F.lit("")))).alias("state"), F.round(F.col("fields")["LUAS_KILOMETER_PERSEGI"].try_cast("double"), 3).alias("area"), "polygons",
    )
    none = F.size("polygons") == 0
    return features.where(~none), features.where(none).select("path", "code", F.lit("no polygon").alias("reason"))
