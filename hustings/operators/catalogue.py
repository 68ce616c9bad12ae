"""Edits of a catalogue in their order: save under a name, or delete, with one live holder for each name.

A save is refused while another item holds the name (names are compared normalised), a delete while the item isn't
there. Whether an edit stands depends on earlier ones alone, so the fold is found in rounds: all edits stand at first;
each round judges all of them by the names that the standing ones hold; the rounds end when none changes. Items and
names are dealt over tasks; no group is larger than the edits of one item or one name.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hustings.functions.text import lower_no_spaces
from hustings.sources.scratch import cut


def judged(edits: DataFrame, normalise=lower_no_spaces) -> DataFrame:
    """The edits with `stands` and the reason of those that don't: (ordinal, id, action, name), action save or delete.

    ordinal is unique. A save without an id, a name or letters in it is refused, and so is an unknown action."""
    name = F.trim("name")
    rows = edits.select("ordinal", "id", "action", name.alias("name"), normalise(name).alias("norm"))
    plain = F.when(F.col("id").isNull() | ~F.coalesce(F.col("action").isin("save", "delete"), F.lit(False)), "invalid").when((F.col("action") == "save") & (F.coalesce("norm", F.lit("")) == ""), "name_required")
    rows = cut(rows.withColumn("fault", plain))
    now = rows.where("fault is null").select("ordinal", "id", "norm", (F.col("action") == "save").alias("saves"), F.lit(True).alias("stands"))
    while True:
        after = cut(_judge(now))
        if after.where("stands <> before").isEmpty():
            break
        now = after.drop("before")
    refused = after.where("not stands").select("ordinal", F.when(F.col("saves"), "name_exists").otherwise("not_found").alias("why"))
    why = F.coalesce("fault", "why")
    return rows.join(refused, "ordinal", "left").select("ordinal", "id", "action", "name", why.isNull().alias("stands"), why.alias("reason"))


def _judge(edits: DataFrame) -> DataFrame:
    """One round: which edits stand, given which ones stood before. Edits go once by item and the saves once by name;
    what a save needs to know of its item goes along with it."""
    own = Window.partitionBy("id").orderBy("ordinal").rowsBetween(Window.unboundedPreceding, -1)
    back = Window.partitionBy("id").orderBy(F.desc("ordinal")).rowsBetween(Window.unboundedPreceding, -1)
    # An item is there if the last standing edit before was a save; a save holds its name until the next standing edit.
    there = F.last(F.when(F.col("stands"), F.col("saves")), ignorenulls=True).over(own)
    ends = F.last(F.when(F.col("stands"), F.col("ordinal")), ignorenulls=True).over(back)
    seen = edits.withColumns({"there": F.coalesce(there, F.lit(False)), "ends": ends})
    deletes = seen.where("not saves").select("ordinal", "id", "norm", "saves", F.col("there").alias("stands"), F.col("stands").alias("before"))
    start = F.struct(F.col("ordinal").alias("at"), F.col("stands").cast("int").alias("step"), F.lit(True).alias("asks"))
    end = F.when(F.col("stands") & F.col("ends").isNotNull(), F.struct(F.col("ends").alias("at"), F.lit(-1).alias("step"), F.lit(False).alias("asks")))
    saves = seen.where("saves").select("ordinal", "id", "norm", "stands", "ends").repartition("norm")
    line = saves.select("ordinal", "id", "norm", "stands", F.explode(F.array_compact(F.array(start, end))).alias("x")).select("ordinal", "id", "norm", "stands", "x.*")
    # Holders just before the edit: steps at earlier ordinals only.
    before = lambda *by: F.coalesce(F.sum("step").over(Window.partitionBy(*by).orderBy("at").rangeBetween(Window.unboundedPreceding, -1)), F.lit(0))
    held = line.withColumn("all", before("norm")).withColumn("ours", before("norm", "id")).where("asks")
    return deletes.unionByName(held.select("ordinal", "id", "norm", F.lit(True).alias("saves"), (F.col("all") == F.col("ours")).alias("stands"), F.col("stands").alias("before")))


def catalogue(edits: DataFrame, normalise=lower_no_spaces) -> tuple[DataFrame, DataFrame]:
    """(items, refused). items: id, name, aliases - the earlier names since the item was made, in the order of their
    loss; refused: the edits that don't stand, with the reason."""
    found = judged(edits, normalise)
    own = Window.partitionBy("id").orderBy("ordinal")
    made = F.sum((F.col("action") == "delete").cast("int")).over(own)
    rows = found.where("stands").withColumns({"life": made, "was": F.lag("name").over(own), "did": F.lag("action").over(own)})
    lost: Column = F.when((F.col("did") == "save") & (F.col("was") != F.col("name")), F.struct("ordinal", F.col("was").alias("name")))
    latest = rows.groupBy("id").agg(F.max_by(F.struct("action", "name", "life"), "ordinal").alias("now"))
    lives = rows.where("action = 'save'").groupBy("id", "life").agg(F.array_distinct(F.transform(F.array_sort(F.collect_list(lost)), lambda x: x["name"])).alias("aliases"))
    items = latest.where("now.action = 'save'").select("id", "now.name", "now.life").join(lives, ["id", "life"]).select("id", "name", "aliases")
    return items, found.where("not stands").select("ordinal", "id", "action", "name", "reason")
