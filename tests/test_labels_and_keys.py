"""Edge frames of labels, number formats, exceptions, key resolution, supplements and search entries."""

import datetime

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from hustings.functions import labels, numbers
from hustings.operators import contest, joins, overlay, rollup, rules, search

DAY = datetime.date


def values(df, *columns):
    return [tuple(r) for r in df.select(*columns).collect()]


def test_dates(spark):
    df = spark.createDataFrame([(1, DAY(1999, 8, 3), DAY(2004, 3, 21)), (2, DAY(2018, 5, 9), DAY(2018, 12, 31)), (3, None, DAY(2018, 1, 1))], "k int, a date, b date").orderBy("k")
    found = values(df, labels.year_range(F.col("a"), F.col("b")), labels.day_label(F.col("b")), labels.baseline(F.col("a")), labels.iso_date(F.col("b")))
    assert found[0] == ("1999–2004", "21 MAC 2004", "1999-08-03T00:00:00.000Z", "2004-03-21")
    assert found[1][:2] == ("2018", "31 DIS 2018") and found[2][:3] == (None, "01 JAN 2018", None)


def test_number_formats(spark):
    df = spark.createDataFrame([(i, x) for i, x in enumerate([0.0, 999.94, 999.96, 1500.0, 999949.0, 999950.0, -2.5e6, 1e9, 1.26e15, None])], "k int, x double").orderBy("k")
    assert [r[0] for r in values(df, numbers.compact(F.col("x")))] == ["0", "999.9", "1K", "1.5K", "999.9K", "1J", "-2.5J", "1B", "1260T", None]
    few = spark.createDataFrame([(0, 0.0), (1, 1234567.0), (2, -0.25), (3, None)], "k int, x double").orderBy("k")
    assert values(few, numbers.signed(F.col("x")), numbers.signed(F.col("x"), 1, " pp"), numbers.percent_text(F.col("x"))) == [
        ("0", "0.0 pp", "0.0%"), ("+1,234,567", "+1234567.0 pp", "123456700.0%"), ("-0.25", "-0.3 pp", "-25.0%"), (None, None, None),
    ]


def test_finite_and_same_values(spark):
    df = spark.createDataFrame([(i, x) for i, x in enumerate([1.0, None, float("nan"), float("inf"), float("-inf"), 0.0])], "k int, x double").orderBy("k")
    assert [r[0] for r in values(df, numbers.finite(F.col("x")))] == [True, False, False, False, False, True]
    df = spark.createDataFrame([([1, 2, 2], [2, 1, 2]), ([1, 1, 2], [1, 2, 2]), ([], [])], "a array<int>, b array<int>")
    assert [r[0] for r in values(df, numbers.same_values(F.col("a"), F.col("b")))] == [True, False, True]


def test_labels(spark):
    df = spark.createDataFrame([("1/UP",), ("2/00",), ("3/01",), (None,)], "c string")
    assert [r[0] for r in values(df, labels.section(F.col("c")))] == ["postal", "early", "ordinary", None]
    df = spark.createDataFrame([("P.1", "Place", "Party"), (None, "Place", ""), ("P.1", "", "Party"), (None, None, None)], "c string, n string, l string")
    assert [r[0] for r in values(df, labels.place_label(*map(F.col, "cnl")))] == ["P.1 Place · Party", "Place", "P.1 · Party", ""]


def test_exceptions_leave_unknown_and_other_changes(spark):
    early, late = DAY(2026, 2, 1), DAY(2026, 2, 13)
    rows = [
        (1, "A", 0, late, "Party  x", None), (2, "A", 0, late, "kept-party", None), (3, "A", 0, early, "other", None), (4, "A", 1, late, "other", None), (5, "A", 0, late, None, None),
        (6, "B", 0, early, "Gone", "any"), (7, "B", 0, early, "stays", "LEFT / OUT"), (8, "B", 0, early, None, None), (9, "C", 0, late, "Gone", None), (10, None, 0, late, "Gone", None),
    ]
    changes = spark.createDataFrame(rows, "id int, seat string, position int, date date, party string, alliance string")
    exceptions = spark.createDataFrame([("A", 0, late, "KEPT PARTY", None, None), ("B", 0, None, None, "gone", "left out")], "seat string, position int, from_date date, but_party string, party string, alliance string")
    kept = overlay.without_misfiled(changes, exceptions)
    assert kept.columns == changes.columns and sorted(r.id for r in kept.collect()) == [2, 3, 4, 8, 9, 10]
    assert overlay.without_misfiled(changes, exceptions.limit(0)).count() == 10


def test_key_is_resolved_by_the_one_target(spark):
    rows = spark.createDataFrame([(1, "s", "d1", None), (2, "s", "d1", "own"), (3, "s", "d2", None), (4, "s", "d3", None), (5, None, "d1", None)], "id int, state string, dun string, parliament string")
    targets = spark.createDataFrame([("s", "d1", "P1"), ("s", "d2", "P2"), ("s", "d2", "P3")], "state string, dun string, parliament string")
    found = {r.id: r.parliament for r in joins.resolved(rows, targets, ["state", "dun"], "parliament", strict=False).collect()}
    assert found == {1: "P1", 2: "own", 3: None, 4: None, 5: None}
    assert joins.resolved(rows.where("id < 3"), targets, ["state", "dun"], "parliament").count() == 2
    for bad in (3, 4, 5):
        with pytest.raises(PySparkException, match="can't be resolved: state="):
            joins.resolved(rows.where(f"id = {bad}"), targets, ["state", "dun"], "parliament").collect()


def test_supplements_bring_their_date(spark):
    event = spark.createDataFrame([("a", "2018-05-09")], "place string, held string")
    others = spark.createDataFrame([("by", "b", "2018-05-09"), ("by", "c", "2018-05-09"), ("else", "b", "2018-05-09")], "dataset string, place string, held string")
    supplements = spark.createDataFrame([("by", "b", "2020-01-18")], "dataset string, place string, held string")
    assert sorted(values(overlay.supplemented(event, others, supplements), "place", "held")) == [("a", "2018-05-09"), ("b", "2020-01-18")]


def test_search_entries(spark):
    areas = spark.createDataFrame([("s1", "Johor"), ("s2", "Kedah")], "area string, name string")
    results = spark.createDataFrame([("s1", "f1", "P.1", "One", "X", ["term", "term", "P.2 Two"]), ("s2", "f2", "P.2", "Two", None, None)], "area string, feature string, code string, name string, winner string, terms array<string>")
    with pytest.raises(PySparkException):
        search.offered(areas, results.withColumn("terms", F.lit(1))).collect()
    found = search.last_value_first_place(search.offered(areas, results), "label", "place").orderBy("place").collect()
    assert [(r.label, r.area, r.feature) for r in found] == [
        ("NEGERI · Johor", "s1", None), ("NEGERI · Kedah", "s2", None), ("P.1 One · X", "s1", "f1"), ("term · P.1 One", "s1", "f1"), ("P.2 Two · P.1 One", "s1", "f1"), ("P.2 Two", "s2", "f2"),
    ]
    twice = spark.createDataFrame([("a", 3, "x"), ("a", 1, None), ("b", 2, "y"), ("a", 9, None)], "label string, place int, value string")
    assert sorted(values(search.last_value_first_place(twice, "label", "place"), "label", "place", "value")) == [("a", 1, None), ("b", 2, "y")]


def test_tuple_differences_uncontested_special_and_latest(spark):
    left = spark.createDataFrame([(" a-b", "1"), ("A B", "1"), ("c", "2"), (None, "3")], "x string, y string")
    right = spark.createDataFrame([("A b ", "1"), ("c", "9"), (None, "3")], "x string, y string")
    assert sorted(values(rules.tuple_differences(left, right, ["x", "y"]), "side", "x", "y")) == [("left", "C", "2"), ("right", "C", "9")]
    df = spark.createDataFrame([(1, 1, 0), (2, 2, 0), (3, 1, 5), (4, 1, None)], "id int, candidates int, valid int")
    assert [r.id for r in contest.uncontested(df).collect()] == [1]
    sums = spark.createDataFrame([(1, 2, 3), (1, None, 3)], "m int, p int, o int")
    assert [r[0] for r in values(sums, rollup.special_voters(*map(F.col, "mpo")))] == [6, None]
    days = spark.createDataFrame([(1, "2020"), (2, "2021"), (3, "2021"), (4, None)], "id int, coverage string")
    assert sorted(r.id for r in rollup.of_latest(days, "coverage").collect()) == [2, 3] and rollup.of_latest(days.limit(0), "coverage").count() == 0
