"""Nested JSON documents and lists: typed, validated element by element, with a table of what is wrong.

A text's root decides how it is read; nothing is guessed. Elements keep their place in the list, and every fault names
its path (list, place, field).
"""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

ISSUE = "path string, ordinal int, field string, reason string"


@dataclass(frozen=True)
class Field:
    """A field of an element: its type, whether it must be there, and the values it may have."""

    kind: str = "string"
    required: bool = False
    among: tuple[str, ...] = ()
    least: float | None = None
    #: Required only where another field has a value: (field, value).
    given: tuple[str, str] | None = None


def whole_files(spark: SparkSession, path: str, pattern: str = "*.json") -> DataFrame:
    """(path, text): one row per file."""
    read = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", pattern).text(path, wholetext=True)
    return read.select(F.col("_metadata.file_path").alias("path"), F.regexp_replace("value", "^\\x{FEFF}", "").alias("text"))


def _root(text: Column) -> Column:
    """list, object or other, by the first character; null if the text isn't JSON."""
    mark = F.substring(F.regexp_replace(text, r"^\s+", ""), 1, 1)
    return F.when(F.try_parse_json(text).isNotNull(), F.when(mark == "[", "list").when(mark == "{", "object").otherwise("other"))


def lists(texts: DataFrame, element: str | StructType, wrapper: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(elements, issues) of texts (path, text) that are lists, or objects with the list under the wrapper's name.

    A list too long for one text may come in parts: with a column `first`, its place in the list is added to each
    element's. elements: path, ordinal from 0, element (null if it isn't an object). A text that isn't JSON, or whose root is another, is one issue."""
    kind = element.simpleString() if isinstance(element, StructType) else f"struct<{element}>" if not element.lower().startswith("struct<") else element
    first = F.col("first") if "first" in texts.columns else F.lit(0)
    rows = texts.select("path", "text", first.cast("int").alias("first"), _root(F.col("text")).alias("root"))
    bare = F.from_json("text", "array<string>")  # each element's own text, so that one at fault doesn't take the others along
    if wrapper is None:
        held, fault = F.when(F.col("root") == "list", bare), "not_a_list"
    else:
        inside = F.from_json("text", f"struct<`{wrapper}`: array<string>>")[wrapper]
        held, fault = F.when(F.col("root") == "list", bare).when(F.col("root") == "object", inside), f"no_list_{wrapper}"
    rows = rows.withColumn("held", held)
    one = F.when(F.substring("one", 1, 1) == "{", F.from_json("one", kind))
    elements = rows.where("held is not null").select("path", "first", F.posexplode("held").alias("at", "one")).select("path", (F.col("first") + F.col("at")).alias("ordinal"), one.alias("element"))
    reason = F.when(F.col("root").isNull(), "not_json").otherwise(fault)
    issues = rows.where("held is null").select("path", F.lit(None).cast("int").alias("ordinal"), F.lit(None).cast("string").alias("field"), reason.alias("reason"))
    return elements, issues


def loose(fields: Mapping[str, Field]) -> str:
    """The schema by which fields are first read: texts as they stand, so that a wrong type is a fault and not a null."""
    return ", ".join(f"`{name}`: {'array<string>' if f.kind.startswith('array') else 'string'}" for name, f in fields.items())


def validated(elements: DataFrame, fields: Mapping[str, Field]) -> tuple[DataFrame, DataFrame]:
    """(rows, issues) of elements (path, ordinal, element), read by `loose`.

    Texts are trimmed, blanks are missing. rows: path, ordinal and the typed fields, of elements without a fault."""

    def text(name: str) -> Column:
        if fields[name].kind.startswith("array"):
            return F.filter(F.transform(F.col(f"element.{name}"), lambda x: F.trim(x)), lambda x: F.coalesce(x != "", F.lit(False)))
        return F.nullif(F.trim(F.col(f"element.{name}")), F.lit(""))

    def faults(name: str, f: Field) -> Column:
        own = text(name)
        if f.kind.startswith("array"):
            return F.when(F.lit(f.required) & own.isNull(), F.lit("missing"))
        must = F.lit(f.required)
        if f.given:
            must = F.coalesce(text(f.given[0]) == f.given[1], F.lit(False))
        typed = own if f.kind == "string" else own.try_cast(f.kind)
        out = F.when(own.isNull(), F.when(must, "missing")).when(typed.isNull(), f"not_{f.kind}")
        if f.kind == "int":
            out = out.when(~own.rlike("^-?[0-9]+$"), "not_int")
        if f.among:
            out = out.when(~own.isin(*f.among), "not_allowed")
        if f.least is not None:
            out = out.when(typed < f.least, "too_small")
        return out

    def value(name: str, f: Field) -> Column:
        return text(name) if f.kind == "string" or f.kind.startswith("array") else text(name).try_cast(f.kind)

    found = F.filter(F.array(*(F.struct(F.lit(name).alias("field"), faults(name, f).alias("reason")) for name, f in fields.items())), lambda x: x["reason"].isNotNull())
    rows = elements.withColumn("_faults", F.when(F.col("element").isNull(), F.array(F.struct(F.lit(None).cast("string").alias("field"), F.lit("not_an_object").alias("reason")))).otherwise(found))
    good = rows.where(F.size("_faults") == 0).select("path", "ordinal", *(value(name, f).alias(name) for name, f in fields.items()))
    return good, rows.select("path", "ordinal", F.explode("_faults").alias("f")).select("path", "ordinal", "f.field", "f.reason")


#: The fields of the lists that users exchange, by the name of their list.
LISTS: dict[str, dict[str, Field]] = {
    "changes": {
        "id": Field(required=True), "electionId": Field(), "seatCode": Field(required=True), "effectiveDate": Field(required=True), "status": Field(required=True, among=("active", "vacant", "suspended")),
        "alliance": Field(), "party": Field(), "reason": Field(required=True), "sourceUrl": Field(), "createdAt": Field(required=True),
    },
    "candidateChanges": {
        "id": Field(required=True), "electionId": Field(), "seatCode": Field(required=True), "candidateIndex": Field("int", required=True, least=0), "effectiveDate": Field(required=True),
        "name": Field(required=True), "alliance": Field(required=True), "party": Field(required=True), "gender": Field(), "ethnicity": Field(), "reason": Field(required=True), "sourceUrl": Field(), "createdAt": Field(required=True),
    },
    "affiliations": {
        "id": Field(required=True), "electionId": Field(), "termId": Field(), "personId": Field(), "seatCode": Field(required=True), "effectiveDate": Field(required=True), "status": Field(required=True, among=("party", "independent")),
        "partyId": Field(), "partyName": Field(given=("status", "party")), "allianceId": Field(), "allianceName": Field(given=("status", "party")), "reason": Field(required=True), "sourceUrl": Field(), "createdAt": Field(required=True),
    },
    "alliances": {
        "id": Field(required=True), "sourceName": Field(required=True), "aliases": Field("array<string>"), "name": Field(required=True), "shortName": Field(required=True), "color": Field(required=True), "active": Field("boolean"), "createdAt": Field(), "updatedAt": Field(),
    },
    "parties": {
        "id": Field(required=True), "sourceName": Field(required=True), "aliases": Field("array<string>"), "name": Field(required=True), "shortName": Field(required=True), "alliance": Field(required=True), "active": Field("boolean"), "createdAt": Field(), "updatedAt": Field(),
    },
}

#: What a missing text is, by list.
DEFAULTS = {"changes": {"alliance": "", "party": ""}, "affiliations": {"partyName": "INDEPENDENT", "allianceName": "INDEPENDENT"}, "alliances": {"active": "true"}, "parties": {"active": "true"}}


def exchanged(texts: DataFrame, name: str) -> tuple[DataFrame, DataFrame]:
    """(rows, issues) of texts that hold one of LISTS, bare or in an envelope. Dates of creation and change that are
    missing in catalogues follow each other: a change without a date is as old as its item."""
    fields = LISTS[name]
    elements, broken = lists(texts, f"struct<{loose(fields)}>", name)
    rows, issues = validated(elements, fields)
    if name in DEFAULTS:
        rows = rows.withColumns({c: F.coalesce(F.col(c), F.lit(v).cast(fields[c].kind)) for c, v in DEFAULTS[name].items()})
    if name in ("alliances", "parties"):
        rows = rows.withColumns({"aliases": F.coalesce("aliases", F.array().cast("array<string>")), "updatedAt": F.coalesce("updatedAt", "createdAt")})
    if name == "affiliations":
        rows = rows.withColumn("personId", F.coalesce("personId", F.concat(F.lit("person:legacy:"), "seatCode", F.lit(":winner"))))
    return rows, broken.unionByName(issues)


def envelope(rows: DataFrame, name: str, election: str, exported_at: str, version: int = 2) -> DataFrame:
    """(text): one document that holds the rows as a list in their order (path, ordinal), with version, election and time.

    The list is one document by contract: a user's exchanged edits, some thousands."""
    own = [c for c in rows.columns if c not in ("path", "ordinal")]
    listed = rows.agg(F.transform(F.array_sort(F.collect_list(F.struct("ordinal", F.struct(*own).alias("x")))), lambda s: s["x"]).alias(name))
    return listed.select(F.to_json(F.struct(F.lit(version).alias("version"), F.lit(election).alias("electionId"), F.lit(exported_at).alias("exportedAt"), name)).alias("text"))


def imported(texts: DataFrame, name: str, election: str) -> tuple[DataFrame, DataFrame]:
    """As `exchanged`, for one election: an envelope of another election is an issue."""
    other = F.get_json_object("text", "$.electionId").isNotNull() & (F.get_json_object("text", "$.electionId") != election)
    rows, issues = exchanged(texts.where(~other), name)
    wrong = texts.where(other).select("path", F.lit(None).cast("int").alias("ordinal"), F.lit("electionId").alias("field"), F.lit("another_election").alias("reason"))
    return rows, issues.unionByName(wrong)


#: An edition's nested document: what describes it, and its seats with their candidates.
DOCUMENT = """metadata struct<electionId: string, electionNumber: int, termId: string, boundaryVersion: string, seatCount: int, candidateCount: int>,
seats array<struct<code: string, state: string, registered: bigint, candidates: array<struct<id: string, name: string, alliance: string, votes: bigint>>>>"""


def documents(spark: SparkSession, path: str, schema: str = DOCUMENT, pattern: str = "*.json") -> tuple[DataFrame, DataFrame]:
    """(documents, issues) of files that hold one JSON object each; a list, or a text that isn't JSON, is an issue."""
    texts = whole_files(spark, path, pattern)
    rows = texts.withColumn("root", _root(F.col("text")))
    good = rows.where("root = 'object'").select("path", F.from_json("text", schema).alias("d")).select("path", "d.*")
    bad = rows.where("root is null or root <> 'object'").select("path", F.lit(None).cast("int").alias("ordinal"), F.lit(None).cast("string").alias("field"), F.when(F.col("root").isNull(), "not_json").otherwise("not_an_object").alias("reason"))
    return good, bad


def seats_of(docs: DataFrame) -> DataFrame:
    """One row per seat, with its place in the document."""
    edition = F.col("metadata.electionId").alias("edition")
    return docs.select(edition, F.posexplode("seats").alias("ordinal", "seat")).select("edition", "ordinal", "seat.*")


def candidates_of(seats: DataFrame) -> DataFrame:
    """One row per candidate, with its place in the seat's list."""
    return seats.select("edition", F.col("code").alias("seat"), F.posexplode("candidates").alias("ordinal", "c")).select("edition", "seat", "ordinal", "c.*")
