"""Reviewed publication: a revision's events folded into its state, and the read model."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# The allowed transitions.
TRANSITIONS = {("draft", "reviewed"), ("reviewed", "draft"), ("reviewed", "published"), ("published", "superseded")}


def allowed(before: Column, after: Column, actor: Column, author: Column) -> Column:
    """Whether a transition may happen: it is listed, the actor's name has 2 to 120 characters, nobody reviews or
    publishes their own revision. Names are compared without case, so that one person counts as one."""
    listed = F.concat_ws(">", before, after).isin(*(f"{a}>{b}" for a, b in sorted(TRANSITIONS)))
    named = F.length(F.trim(actor)).between(2, 120)
    return listed & named & ~(after.isin("reviewed", "published") & (F.lower(F.trim(actor)) == F.lower(F.trim(author))))


def states(events: DataFrame) -> DataFrame:
    """(revision, status): the latest event's status."""
    return events.groupBy("revision").agg(F.max_by("status", "ordinal").alias("status"))


def publish(revisions: DataFrame, revision: Column, actor: Column) -> DataFrame:
    """Revisions after one is published: it is published, the published one of its key is superseded; others stay.

    Rows: (revision, key, status, author). A revision that may not be published changes nothing."""
    whole = Window.partitionBy("key")
    mine = (F.col("revision") == revision) & allowed(F.col("status"), F.lit("published"), actor, F.col("author"))
    marked = revisions.withColumn("_now", F.max(mine.cast("int")).over(whole) == 1).withColumn("_mine", mine)
    status = F.when(F.col("_mine"), "published").when(F.col("_now") & (F.col("status") == "published"), "superseded").otherwise(F.col("status"))
    return marked.withColumn("status", status).drop("_now", "_mine")


def read_model(revisions: DataFrame) -> DataFrame:
    """The published revision of each key."""
    return revisions.where("status = 'published'").groupBy("key").agg(F.max("revision").alias("revision"))


def valid_input(kind: Column, reason: Column, actor: Column, edition: Column) -> Column:
    return kind.rlike(r"^[a-z][a-z0-9-]{1,60}$") & F.length(F.trim(reason)).between(8, 1000) & F.length(F.trim(actor)).between(2, 120) & edition.rlike(r"^(pru|prn)-[a-z0-9-]+$")


def publish_events(revisions: DataFrame, revision: Column, actor: Column) -> DataFrame:
    """The log rows of a publication: (revision, from_status, to_status, actor, note) of the revision and of the one it
    supersedes; none if it may not be published."""
    after = publish(revisions, revision, actor).select("revision", F.col("status").alias("to_status"))
    moved = revisions.select("revision", F.col("status").alias("from_status")).join(after, "revision").where("from_status <> to_status")
    note = F.when(F.col("to_status") == "superseded", "Superseded by a newly published revision")
    return moved.select("revision", "from_status", "to_status", actor.alias("actor"), note.alias("note"))


def point(models: DataFrame, revisions: DataFrame, revision: Column, actor: Column) -> DataFrame:
    """The read model after a rollback to a revision: its key points to it, if it is published or superseded and the
    actor's name is valid; other keys stay. models: key, revision, payload, etag; revisions: key, revision, status,
    payload. After a publication the same holds, with the revisions as they are then."""
    fit = F.col("status").isin("published", "superseded") & F.length(F.trim(actor)).between(2, 120)
    chosen = revisions.where((F.col("revision") == revision) & fit).select("key", "revision", "payload", F.sha2("payload", 256).alias("etag"))
    return models.join(chosen.select("key"), "key", "left_anti").unionByName(chosen)
