"""Effective-dated overlays: what held for a key on a date, from an append-only log.

The latest event by (effective date, creation, ordinal) wins; the date itself counts. max_by over the whole order key
combines on the map side, so a key with very many events costs one partial row per task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hustings.functions.text import lower_no_spaces

ORDER = ("effective_date", "created_at", "ordinal")


def latest(events: DataFrame, keys: Sequence[str], columns: Sequence[str], as_of: Column | None = None, order: Sequence[str] = ORDER) -> DataFrame:
    """The columns of each key's latest event, up to and including as_of."""
    held = events if as_of is None else events.where(F.col(order[0]) <= as_of)
    packed = held.groupBy(*keys).agg(F.max_by(F.struct(*columns), F.struct(*order)).alias("_event"))
    return packed.select(*keys, *(F.col(f"_event.{c}").alias(c) for c in columns))


def as_of_join(left: DataFrame, events: DataFrame, keys: Sequence[str], columns: Sequence[str], as_of: Column, order: Sequence[str] = ORDER) -> DataFrame:
    return left.join(latest(events, keys, columns, as_of, order), list(keys), "left")


def as_of_with_fallback(left: DataFrame, events: DataFrame, first: str, second: str, columns: Sequence[str], as_of: Column) -> DataFrame:
    """An event of the first key wins over one of the second, even if older."""
    one = latest(events.where(F.col(first).isNotNull()), [first], columns, as_of).select(first, F.struct(*columns).alias("_one"))
    two = latest(events.where(F.col(second).isNotNull()), [second], columns, as_of).select(second, F.struct(*columns).alias("_two"))
    joined = left.join(one, first, "left").join(two, second, "left").withColumn("_event", F.coalesce("_one", "_two"))
    return joined.select(*left.columns, *(F.col(f"_event.{c}").alias(c) for c in columns))


def correct_positions(contests: DataFrame, events: DataFrame, key: str, as_of: Column) -> DataFrame:
    """Corrections of names by position in the published order; votes and order stay. Blank names keep the old one."""
    own = latest(events, [key, "position"], ["name"], as_of)
    changed = own.groupBy(key).agg(F.map_from_entries(F.collect_list(F.struct("position", F.nullif(F.trim("name"), F.lit("")).alias("name")))).alias("_names"))
    item = lambda c, i: c.withField("name", F.coalesce(F.try_element_at("_names", i), c["name"]))
    return contests.join(changed, key, "left").withColumn("candidates", F.when(F.col("_names").isNull(), F.col("candidates")).otherwise(F.transform("candidates", item))).drop("_names")


def resolve_aliases(df: DataFrame, column: str, catalogue: DataFrame) -> DataFrame:
    """The catalogue's name for any of its source names, names and aliases; the last entry wins, a miss stays as it is."""
    spelt = F.explode(F.array_distinct(F.concat(F.array("source_name", "name"), F.coalesce("aliases", F.array().cast("array<string>"))))).alias("_spelt")
    table = catalogue.select("name", "ordinal", spelt).groupBy("_spelt").agg(F.max_by("name", "ordinal").alias("_name"))
    return df.join(table, F.col(column) == F.col("_spelt"), "left").withColumn(column, F.coalesce("_name", column)).drop("_spelt", "_name")


def aliases_of(df: DataFrame, column: str, prefixes: Sequence[str]) -> DataFrame:
    """df once per distinct spelling (`alias`) of a name: upper-cased, and without each of the prefixes (patterns)."""
    upper = F.upper(F.trim(F.col(column)))
    return df.withColumn("alias", F.explode(F.array_distinct(F.array(upper, *(F.regexp_replace(upper, f"^(?:{p})", "") for p in prefixes)))))


def alias_lookup(asked: DataFrame, names: DataFrame, column: str, prefixes: Sequence[str]) -> DataFrame:
    """Asked rows (column `asked`) with each row of names that has the asked spelling among its aliases, once."""
    return asked.join(aliases_of(names, column, prefixes), F.upper(F.trim("asked")) == F.col("alias")).drop("alias").distinct()


def with_catalogue(df: DataFrame, column: str, catalogue: DataFrame, defaults: dict[str, Column]) -> DataFrame:
    """df with the catalogue's columns for its name; a name that the catalogue lacks has the defaults. Of several entries
    of a name the first by `ordinal` counts."""
    one = catalogue.groupBy(F.col("name").alias("_name")).agg(*(F.min_by(c, "ordinal").alias(f"_{c}") for c in defaults))
    return df.join(one, F.col(column) == F.col("_name"), "left").select(*df.columns, *(F.coalesce(f"_{c}", v).alias(c) for c, v in defaults.items()))


def seat_status(seats: DataFrame, events: DataFrame, as_of: Column, vacant_alliance: str = "VACANT", vacant_party: str = "-") -> DataFrame:
    """Seats with their current holder: vacant seats have the stated names, seats without an event their winner."""
    held = as_of_join(seats, events, ["seat"], ["status", "alliance", "party"], as_of)
    vacant = F.col("status") == "vacant"
    return held.withColumns({
        "current_alliance": F.when(vacant, vacant_alliance).otherwise(F.coalesce("alliance", "winner_alliance")),
        "current_party": F.when(vacant, vacant_party).otherwise(F.coalesce("party", "winner_party")),
        "is_changed": F.col("status").isNotNull(),
    })


def upsert(target: DataFrame, changes: DataFrame, keys: Sequence[str], order: str) -> DataFrame:
    """Insert or replace by key: the latest change wins, and a change wins over the target."""
    rows = target.withColumns({"_new": F.lit(0), "_order": F.lit(None).cast(changes.schema[order].dataType)}).unionByName(changes.withColumns({"_new": F.lit(1), "_order": F.col(order)}), allowMissingColumns=True)
    columns = [c for c in target.columns if c not in keys]
    out = rows.groupBy(*keys).agg(F.max_by(F.struct(*columns), F.struct("_new", F.coalesce(F.col("_order").cast("string"), F.lit("")))).alias("_row"))
    return out.select(*keys, *(F.col(f"_row.{c}").alias(c) for c in columns)).select(*target.columns)


def precedence_union(primary: DataFrame, fallback: DataFrame, keys: Sequence[str]) -> DataFrame:
    """All primary rows, and fallback rows of keys that the primary lacks."""
    return primary.unionByName(fallback.join(primary.select(*keys).distinct(), list(keys), "left_anti"))


def merge_by_key(first: DataFrame, second: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows of both; of one key the second's."""
    return first.join(second.select(*keys).distinct(), list(keys), "left_anti").unionByName(second)


# The names of seats without a holder and of members without a party.
VACANT_ALLIANCE, VACANT_PARTY, INDEPENDENT = "VACANT", "-", "INDEPENDENT"


def correct_candidates(seats: DataFrame, events: DataFrame, as_of: Column) -> DataFrame:
    """Candidate corrections: name, alliance and party by position; votes and order stay.

    The correction of position 0 goes to the winner too, whose gender and ethnicity stay where it leaves them blank.
    seats: seat, candidates (array of structs), winner (struct); events: seat, position and the corrected fields.
    """
    fields = ["name", "alliance", "party", "gender", "ethnicity"]
    own = latest(events, ["seat", "position"], fields, as_of)
    changed = own.groupBy("seat").agg(F.map_from_entries(F.collect_list(F.struct("position", F.struct(*fields)))).alias("_changes"))
    at = lambda i: F.try_element_at("_changes", i)

    def patched(old: Column, new: Column, kept_if_blank: Sequence[str] = ()) -> Column:
        out = old
        for c in fields[:3]:
            out = out.withField(c, new[c])
        for c in kept_if_blank:
            out = out.withField(c, F.coalesce(F.nullif(new[c], F.lit("")), old[c]))
        return F.when(new.isNull(), old).otherwise(out)

    joined = seats.join(changed, "seat", "left")
    return joined.withColumns({
        "candidates": F.transform("candidates", lambda c, i: patched(c, at(i))),
        "winner": patched(F.col("winner"), at(F.lit(0)), fields[3:]),
    }).drop("_changes")


def affiliations(seats: DataFrame, events: DataFrame, parties: DataFrame, alliances: DataFrame, as_of: Column) -> DataFrame:
    """Seats with the member's affiliation: an event of the person wins over one of the seat. Independents have one
    name; a party or alliance has the catalogue's name of its id, else the event's."""
    columns = ["affiliation", "party_id", "party_name", "alliance_id", "alliance_name"]
    held = as_of_with_fallback(seats, events, "person_id", "seat", columns, as_of)
    named = held.join(parties.select(F.col("id").alias("party_id"), F.col("name").alias("_party")), "party_id", "left")
    named = named.join(alliances.select(F.col("id").alias("alliance_id"), F.col("name").alias("_alliance")), "alliance_id", "left")
    alone = F.col("affiliation") == "independent"
    return named.select(
        *seats.columns, "affiliation",
        F.when(alone, INDEPENDENT).otherwise(F.coalesce("_party", "party_name")).alias("affiliation_party"),
        F.when(alone, INDEPENDENT).otherwise(F.coalesce("_alliance", "alliance_name")).alias("affiliation_alliance"),
    )


def current(status: Column, affiliation: Column, stated: Column, winner: Column, vacant: str) -> Column:
    """What a seat shows now: the name of vacancy, else the affiliation, the stated change, the winner."""
    return F.when(status == "vacant", vacant).otherwise(F.coalesce(affiliation, stated, winner))


def managed(seats: DataFrame, corrections: DataFrame, statuses: DataFrame, membership: DataFrame, parties: DataFrame, alliances: DataFrame, as_of: Column, current_term: bool) -> DataFrame:
    """All overlays in their order: candidate corrections, then seat status and affiliation (of the current term only),
    then the catalogue's names. statuses: seat, status, stated_alliance, stated_party."""
    fixed = correct_candidates(seats, corrections, as_of)
    none = lambda df: df if current_term else df.where(F.lit(False))
    held = as_of_join(fixed, none(statuses), ["seat"], ["status", "stated_alliance", "stated_party"], as_of)
    held = affiliations(held, none(membership), parties, alliances, as_of)
    status = F.coalesce("status", F.lit("active"))
    shown = held.withColumns({
        "current_alliance": current(status, F.col("affiliation_alliance"), F.col("stated_alliance"), F.col("winner.alliance"), VACANT_ALLIANCE),
        "current_party": current(status, F.col("affiliation_party"), F.col("stated_party"), F.col("winner.party"), VACANT_PARTY),
        "is_changed": F.col("status").isNotNull() | F.col("affiliation").isNotNull(),
    })
    return resolve_aliases(resolve_aliases(shown, "current_alliance", alliances), "current_party", parties)


def replay(seats: DataFrame, events: DataFrame, keys: Sequence[str], columns: Sequence[str], dates: DataFrame) -> DataFrame:
    """The overlay as it stood on each date of a short list: (date, keys, columns), for keys with an event by then."""
    held = events.join(F.broadcast(dates), F.col("effective_date") <= F.col("date"))  # a row per date
    return seats.select(*keys).join(latest(held, ["date", *keys], columns), list(keys))


def without_misfiled(changes: DataFrame, exceptions: DataFrame, normalise=lower_no_spaces) -> DataFrame:
    """changes without those that an exception names; both have seat and position, changes date, party and alliance too.

    An exception holds from from_date on (null: always), for a party other than but_party (null: for any), and if
    party or alliance is given, for changes to that party or into that alliance. Names are compared normalised; an
    unknown name of a change equals none."""
    name = lambda c: normalise(F.coalesce(F.col(c), F.lit("")))
    x, y = changes.alias("x"), exceptions.alias("y")
    since = F.col("y.from_date").isNull() | (F.col("x.date") >= F.col("y.from_date"))
    other = F.col("y.but_party").isNull() | (name("x.party") != name("y.but_party"))
    into = lambda c: F.coalesce(name(f"x.{c}") == normalise(F.col(f"y.{c}")), F.lit(False))
    any_of = (F.col("y.party").isNull() & F.col("y.alliance").isNull()) | into("party") | into("alliance")
    return x.join(y, (F.col("x.seat") == F.col("y.seat")) & (F.col("x.position") == F.col("y.position")) & since & other & any_of, "left_anti")


def supplemented(rows: DataFrame, others: DataFrame, supplements: DataFrame, held: str = "held") -> DataFrame:
    """An event's rows, and the rows of other datasets that its supplements (dataset, place, held) name, with their own date."""
    taken = others.join(supplements.select("dataset", "place", F.col(held).alias("_held")), ["dataset", "place"])
    return rows.unionByName(taken.withColumn(held, F.col("_held")).select(*rows.columns))
