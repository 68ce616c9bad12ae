"""Streams into a store: a log with its quarantine, and the current overlay of an effective-dated log.

Both run as foreachBatch. The number of the micro-batch is part of the commit, so a batch that is run again after a
failure changes nothing. A batch writes what it brings; from time to time small parts are folded into one, so that the
number of parts, not the size of the log, decides what a reader opens.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from hustings.operators import overlay
from hustings.sources.store import Snapshot, commit, read, snapshot
from hustings.streaming import telemetry

#: After so many batches their parts are folded into one.
FOLD = 16


def _each(stream: DataFrame, checkpoint: str, step: Callable[[DataFrame, int], None]) -> DataStreamWriter:
    return stream.writeStream.option("checkpointLocation", checkpoint).foreachBatch(step)


def _done(held: Snapshot, batch: int) -> bool:
    return int(held.notes.get("batch", -1)) >= batch


def append_batch(events: DataFrame, batch: int, root: str) -> Snapshot:
    """One micro-batch of telemetry: what is taken in goes cleaned to `events`, the rest with its reason to `rejected`."""
    spark = events.sparkSession
    held = snapshot(spark, root)
    if _done(held, batch):
        return held
    events = events.persist()
    try:
        good, bad = telemetry.split(events)
        name = F.lit(f"{batch:012d}").alias("part")
        changes = {"events": telemetry.taken_in(good).select("*", name), "rejected": bad.select("*", telemetry.reason(events.columns).alias("reason"), name)}
        gone: dict[str, list[str]] = {}
        if (batch + 1) % FOLD == 0:
            for table, rows in list(changes.items()):
                single = [p for p in held.tables.get(table, {}) if "-" not in p]
                if single:
                    folded = F.lit(f"{min(single)}-{batch:012d}").alias("part")
                    changes[table] = read(spark, held, table, single).unionByName(rows.drop("part")).select("*", folded)
                    gone[table] = single
        return commit(spark, root, changes, held, gone, {"batch": batch})
    finally:
        events.unpersist()


def append(stream: DataFrame, root: str, checkpoint: str) -> DataStreamWriter:
    """A stream of telemetry into a store."""
    return _each(stream, checkpoint, lambda events, batch: append_batch(events, batch, root))


def _held(events: DataFrame, keys: Sequence[str], columns: Sequence[str], horizon: str) -> DataFrame:
    """Of events up to the horizon the latest of each key; all later ones."""
    date = F.lit(horizon).cast("date")
    rest = [c for c in (*columns, *overlay.ORDER)]
    return overlay.latest(events, keys, rest, date).unionByName(events.where(F.col("effective_date") > date).select(*keys, *rest))


def follow_batch(events: DataFrame, batch: int, root: str, keys: Sequence[str], columns: Sequence[str], horizon: str) -> Snapshot:
    """One micro-batch of an effective-dated log into the overlay's state. The horizon may only go on, never back."""
    spark = events.sparkSession
    held = snapshot(spark, root)
    if _done(held, batch):
        return held
    if str(held.notes.get("horizon", horizon)) > horizon:
        raise ValueError(f"the state is folded up to {held.notes['horizon']}")
    rows = events.select(*keys, *columns, *overlay.ORDER)
    parts = list(held.tables.get("state", {}))
    fold = len(parts) + 1 >= FOLD
    if fold:
        rows = read(spark, held, "state").unionByName(rows)
    own = _held(rows, keys, columns, horizon).withColumn("part", F.lit(f"{batch:012d}"))
    return commit(spark, root, {"state": own}, held, {"state": parts} if fold else None, {"batch": batch, "horizon": horizon})


def follow(stream: DataFrame, root: str, checkpoint: str, keys: Sequence[str], columns: Sequence[str], horizon: str) -> DataStreamWriter:
    """A growing log as a stream; `current` reads what holds on a date from the horizon on, after each batch."""
    return _each(stream, checkpoint, lambda events, batch: follow_batch(events, batch, root, keys, columns, horizon))


def current(spark, root: str, keys: Sequence[str], columns: Sequence[str], as_of: Column, version: int | None = None) -> DataFrame:
    """The overlay on a date, after all batches so far: as if computed from the whole log."""
    held = snapshot(spark, root, version)
    return overlay.latest(read(spark, held, "state"), keys, columns, as_of)
