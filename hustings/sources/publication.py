"""Governed publication: revisions, their log and the read model change together or not at all.

A store (`store.py`) holds four tables, in parts by a checksum of the key: `revisions` (revision, key, status, author,
reviewer, publisher, payload), `models` (key, revision, payload, etag), and, in parts by version and release, the log
`events` and the reports `runs` and `issues`. A transition reads and rewrites the one part of its key.
"""

from __future__ import annotations

import zlib

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from hustings.operators import editorial, rules
from hustings.sources.store import Snapshot, commit, read, snapshot

PARTS = 16


class Refused(PermissionError):
    """A step that the policy doesn't allow; the store stays as it is."""


def part_of(key: object) -> str:
    return str(zlib.crc32(str(key).encode()) % PARTS)


def _part(key: Column) -> Column:
    return (F.crc32(key.cast("string")) % PARTS).cast("string").alias("part")


def _etag(payload: Column) -> Column:
    return F.sha2(payload, 256).alias("etag")


def create(spark: SparkSession, root: str, revisions: DataFrame) -> Snapshot:
    """A new store: all revisions, and for each key the newest published one as its model.

    revisions: revision, key, status, author, payload."""
    none = F.lit(None).cast("string")
    rows = revisions.select("revision", "key", "status", "author", none.alias("reviewer"), none.alias("publisher"), "payload")
    top = F.max_by(F.struct("revision", "payload"), "revision").alias("m")
    models = rows.where("status = 'published'").groupBy("key").agg(top).select("key", "m.revision", "m.payload", _etag(F.col("m.payload")))
    log = rows.where(F.lit(False)).select("revision", F.col("status").alias("from_status"), F.col("status").alias("to_status"), F.col("author").alias("actor"), F.col("author").alias("note"), F.lit("0").alias("part"))
    return commit(spark, root, {"revisions": rows.withColumn("part", _part(F.col("key"))), "models": models.withColumn("part", _part(F.col("key"))), "events": log}, snapshot(spark, root))


def _own(spark: SparkSession, held: Snapshot, key: object, revision: object) -> tuple[DataFrame, dict]:
    rows = read(spark, held, "revisions", [part_of(key)])
    found = rows.where((F.col("revision") == F.lit(revision)) & (F.col("key") == F.lit(key))).first()
    if found is None:
        raise Refused("revision_not_found")
    return rows, found.asDict()


def _write(spark: SparkSession, held: Snapshot, root: str, key: object, changes: dict[str, DataFrame]) -> Snapshot:
    part = part_of(key)
    named = {name: rows.withColumn("part", F.lit(str(held.version + 1) if name == "events" else part)) for name, rows in changes.items()}
    return commit(spark, root, named, held, {name: [part] for name in named if name != "events"})


def transition(spark: SparkSession, root: str, key: object, revision: object, target: str, actor: str, note: str = "", began: Snapshot | None = None) -> Snapshot:
    """One step of a revision: its new status, the log rows and, if it is published, the superseded ones and the model.

    began: the version that the caller has seen; Conflict if there is a newer one. Refused by the policy: Refused."""
    held = began or snapshot(spark, root)
    rows, old = _own(spark, held, key, revision)
    ok = spark.range(1).select(editorial.allowed(F.lit(old["status"]), F.lit(target), F.lit(actor), F.lit(old["author"])).alias("ok")).first()["ok"]
    if not ok:
        raise Refused(f"{old['status']} to {target} by {actor}")
    mine = (F.col("revision") == F.lit(revision)) & (F.col("key") == F.lit(key))
    other = (F.col("key") == F.lit(key)) & (F.col("status") == "published") & ~mine & F.lit(target == "published")
    status = F.when(mine, target).when(other, "superseded").otherwise(F.col("status"))
    by = lambda name, step: F.when(mine & F.lit(target == step), F.trim(F.lit(actor))).otherwise(F.col(name))
    after = rows.withColumns({"status": status, "reviewer": by("reviewer", "reviewed"), "publisher": by("publisher", "published")})
    said = F.when(mine, F.nullif(F.substring(F.lit(note), 1, 1000), F.lit(""))).otherwise("Superseded by a newly published revision")
    log = rows.where(mine | other).select("revision", F.col("status").alias("from_status"), status.alias("to_status"), F.trim(F.lit(actor)).alias("actor"), said.alias("note"))
    changes = {"revisions": after, "events": log}
    if target == "published":
        changes["models"] = _pointed(spark, held, key, rows.where(mine))
    return _write(spark, held, root, key, changes)


def _pointed(spark: SparkSession, held: Snapshot, key: object, revision: DataFrame) -> DataFrame:
    """The models of the key's part, in which the key has this revision."""
    rest = read(spark, held, "models", [part_of(key)]).where(F.col("key") != F.lit(key))
    return rest.unionByName(revision.select("key", "revision", "payload", _etag(F.col("payload"))))


def rollback(spark: SparkSession, root: str, key: object, revision: object, actor: str, began: Snapshot | None = None) -> Snapshot:
    """Point the key's model to one of its published or superseded revisions; no status changes."""
    held = began or snapshot(spark, root)
    rows, old = _own(spark, held, key, revision)
    if old["status"] not in ("published", "superseded") or not 2 <= len(actor.strip()) <= 120:
        raise Refused(f"rollback to a {old['status']} revision by {actor}")
    mine = rows.where((F.col("revision") == F.lit(revision)) & (F.col("key") == F.lit(key)))
    log = mine.select("revision", F.col("status").alias("from_status"), F.col("status").alias("to_status"), F.trim(F.lit(actor)).alias("actor"), F.lit("Published read model rolled back to this revision").alias("note"))
    return _write(spark, held, root, key, {"models": _pointed(spark, held, key, mine), "events": log})


def publish_report(spark: SparkSession, root: str, found: DataFrame, release: str, began: Snapshot | None = None) -> Snapshot:
    """The run and its issue rows in one commit; a release that is there already is refused."""
    held = began or snapshot(spark, root)
    if release in held.tables.get("runs", {}):
        raise Refused(f"release {release} is published")
    run, rows = rules.report(found, release)
    return commit(spark, root, {"runs": run.withColumn("part", F.lit(release)), "issues": rows.withColumn("part", F.lit(release))}, held)


def write_results(spark: SparkSession, root: str, results: DataFrame, edition: str, began: Snapshot | None = None) -> Snapshot:
    """Replace an edition's results, unless they are sealed."""
    held = began or snapshot(spark, root)
    if edition in held.notes.get("sealed", []):
        raise Refused(f"published results are immutable: {edition}")
    return commit(spark, root, {"results": results.withColumn("part", F.lit(edition))}, held, {"results": [edition]})


def seal(spark: SparkSession, root: str, edition: str) -> Snapshot:
    """From now on an edition's results stay as they are."""
    held = snapshot(spark, root)
    return commit(spark, root, {}, held, notes={"sealed": sorted({*held.notes.get("sealed", []), edition})})
