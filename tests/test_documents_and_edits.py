"""Joins that enforce, edits in order, payloads, nested documents, boundaries, editions, tiers and provenance."""

import json
import random
import zipfile

import pytest
from pyspark.sql import functions as F

from hustings.functions import geometry
from hustings.operators import catalogue, joins, provenance
from hustings.sources import editions, payloads, readers, writers


def rows(df, *columns):
    return sorted((tuple(r) for r in (df.select(*columns) if columns else df).collect()), key=str)


def test_one_to_one_fails_on_duplicates_and_misses(spark):
    left = spark.createDataFrame([(1, "a", 10), (2, "b", 20), (None, "c", 30)], "k int, name string, v int")
    right = spark.createDataFrame([(2, "x"), (1, "y"), (None, "z")], "k int, w string")
    assert rows(joins.one_to_one(left, right, ["k"])) == sorted([(1, "a", 10, "y"), (2, "b", 20, "x"), (None, "c", 30, "z")], key=str)
    assert joins.one_to_one(left, right, ["k"]).select("name").count() == 3
    for a, b, said in [
        (left, right.where("k = 1 or k is null"), "missing on the right: k=2"), (left.where("k = 1"), right, "missing on the left: k="), (left.unionByName(left.where("k = 2")), right, "duplicate on the left: k=2"),
        (left, right.unionByName(right.where("k is null")), "duplicate on the right: k=null"),
    ]:
        with pytest.raises(Exception, match=said):
            joins.one_to_one(a, b, ["k"]).select("k").collect()  # also if no column of the other side is asked for
    assert joins.one_to_one(left.where("false"), right.where("false"), ["k"]).count() == 0


def test_mandatory_lookup_fails_on_a_miss_and_on_several(spark):
    left = spark.createDataFrame([(1, "a"), (1, "b"), (2, "c")], "k int, name string")
    right = spark.createDataFrame([(1, "x"), (2, "y"), (3, "z")], "k int, w string")
    assert rows(joins.mandatory(left, right, ["k"])) == [(1, "a", "x"), (1, "b", "x"), (2, "c", "y")]
    with pytest.raises(Exception, match="nothing to look up: k=2"):
        joins.mandatory(left, right.where("k <> 2"), ["k"]).count()
    with pytest.raises(Exception, match="several to look up: k=1"):
        joins.mandatory(left, right.unionByName(right.where("k = 1")), ["k"]).count()


def fold(edits):
    """The same by a plain loop."""
    held, refused = {}, []
    plain = lambda x: "".join(c for c in (x or "").lower() if c.isalnum())
    for ordinal, name_id, action, name in sorted(edits):
        name = name.strip() if name is not None else None
        if name_id is None or action not in ("save", "delete"):
            refused.append((ordinal, "invalid"))
        elif action == "save" and not plain(name):
            refused.append((ordinal, "name_required"))
        elif action == "save" and any(k != name_id and plain(v[0]) == plain(name) for k, v in held.items()):
            refused.append((ordinal, "name_exists"))
        elif action == "delete" and name_id not in held:
            refused.append((ordinal, "not_found"))
        elif action == "delete":
            del held[name_id]
        else:
            old = held.get(name_id)
            aliases = [] if old is None else old[1] + [old[0]] * (old[0] != name and old[0] not in old[1])
            held[name_id] = (name, aliases)
    return sorted((k, *v) for k, v in held.items()), sorted(refused)


def test_edits_equal_a_plain_fold(spark):
    rng = random.Random(2)
    names = ["Alpha", " alpha ", "AL-PHA", "Beta", "beta", "Gamma", "", None, "Delta", "delta!", "Epsilon"]
    edits = [(k, rng.choice([1, 2, 3, 4, 5, None] if rng.random() < 0.1 else [1, 2, 3, 4, 5]), rng.choice(["save", "save", "save", "delete"]) if rng.random() > 0.03 else "odd", rng.choice(names)) for k in range(140)]
    # A chain: whether each stands depends on the one before.
    edits += [(200, 11, "save", "one"), (201, 12, "save", "two"), (202, 12, "save", "One"), (203, 13, "save", "TWO"), (204, 11, "save", "three"), (205, 12, "save", "one"), (206, 13, "save", "two"), (207, 14, "delete", None), (208, 12, "delete", None), (209, 14, "save", "one"), (210, 13, "save", "deux")]
    df = spark.createDataFrame(edits, "ordinal int, id int, action string, name string")
    items, refused = catalogue.catalogue(df)
    want, gone = fold(edits)
    assert sorted((r.id, r.name, list(r.aliases)) for r in items.collect()) == want
    assert sorted((r.ordinal, r.reason) for r in refused.collect()) == gone
    assert catalogue.catalogue(df.where("false"))[0].count() == 0


CHANGE = {"id": "1", "seatCode": "P.001", "effectiveDate": "2024-01-01", "status": "active", "reason": " r ", "createdAt": "t"}


def test_payloads_name_the_element_at_fault(spark):
    wrong = [{**CHANGE, "status": "gone"}, {**CHANGE, "reason": "  "}, {k: v for k, v in CHANGE.items() if k != "id"}, 5]
    texts = [("bare", json.dumps([CHANGE])), ("boxed", json.dumps({"version": 2, "changes": [{**CHANGE, "alliance": " A "}, *wrong]})), ("none", '{"other": []}'), ("bad", "[{"), ("text", '"x"'), ("empty", "[]")]
    good, issues = payloads.exchanged(spark.createDataFrame(texts, "path string, text string"), "changes")
    assert rows(good, "path", "ordinal", "reason", "alliance", "party") == [("bare", 0, "r", "", ""), ("boxed", 0, "r", "A", "")]
    want = [("bad", None, None, "not_json"), ("boxed", 1, "status", "not_allowed"), ("boxed", 2, "reason", "missing"), ("boxed", 3, "id", "missing"), ("none", None, None, "no_list_changes"), ("text", None, None, "no_list_changes")]
    found = rows(issues)
    assert [x for x in found if x[1] != 4] == sorted(want, key=str) and any(x[:2] == ("boxed", 4) for x in found)


def test_payload_types_defaults_and_conditions(spark):
    one = lambda name, *items: payloads.exchanged(spark.createDataFrame([("p", json.dumps(list(items)))], "path string, text string"), name)
    base = {"id": "1", "seatCode": "P.001", "effectiveDate": "d", "name": "n", "alliance": "a", "party": "p", "reason": "r", "createdAt": "t"}
    good, issues = one("candidateChanges", {**base, "candidateIndex": 2}, {**base, "candidateIndex": -1}, {**base, "candidateIndex": 1.5}, {**base, "candidateIndex": "x"}, base)
    assert rows(good, "ordinal", "candidateIndex", "gender") == [(0, 2, None)]
    assert rows(issues, "ordinal", "field", "reason") == [(1, "candidateIndex", "too_small"), (2, "candidateIndex", "not_int"), (3, "candidateIndex", "not_int"), (4, "candidateIndex", "missing")]
    member = {"id": "1", "seatCode": "P.001", "effectiveDate": "d", "reason": "r", "createdAt": "t"}
    good, issues = one("affiliations", {**member, "status": "independent"}, {**member, "status": "party", "partyName": "X"}, {**member, "status": "party", "partyName": "X", "allianceName": "Y", "personId": "q"})
    assert rows(good, "ordinal", "personId", "partyName", "allianceName") == [(0, "person:legacy:P.001:winner", "INDEPENDENT", "INDEPENDENT"), (2, "q", "X", "Y")]
    assert rows(issues, "ordinal", "field", "reason") == [(1, "allianceName", "missing")]
    item = {"id": "1", "sourceName": "S", "name": "N", "shortName": "n", "color": "#fff"}
    good, _ = one("alliances", {**item, "aliases": [" a ", "", "b"], "active": False, "createdAt": "t"}, item)
    assert rows(good, "ordinal", "aliases", "active", "updatedAt") == [(0, ["a", "b"], False, "t"), (1, [], True, None)]


def test_envelope_comes_back_and_another_election_does_not(spark):
    good, _ = payloads.exchanged(spark.createDataFrame([("p", json.dumps([CHANGE, {**CHANGE, "id": "2"}]))], "path string, text string"), "changes")
    sent = payloads.envelope(good, "changes", "pru-15", "2024-01-01T00:00:00Z").withColumn("path", F.lit("e"))
    box = json.loads(sent.first().text)
    assert box["version"] == 2 and [x["id"] for x in box["changes"]] == ["1", "2"]
    back, issues = payloads.imported(sent, "changes", "pru-15")
    assert rows(back.drop("path")) == rows(good.drop("path")) and issues.count() == 0
    back, issues = payloads.imported(sent, "changes", "pru-14")
    assert back.count() == 0 and rows(issues) == [("e", None, "electionId", "another_election")]


def test_nested_documents(spark, tmp_path):
    candidate = lambda k: {"id": f"c{k}", "name": f"N{k}", "alliance": "A", "votes": k}
    doc = {"metadata": {"electionId": "pru-15", "electionNumber": 15, "seatCount": 2}, "seats": [{"code": "P.001", "state": "x", "registered": 9, "candidates": [candidate(5), candidate(3)]}, {"code": "P.002", "candidates": []}], "more": 1}
    for name, text in {"a.json": "﻿" + json.dumps(doc, indent=2), "b.json": "[1, 2]", "c.json": '{"metadata": ', "d.txt": "{}"}.items():
        (tmp_path / name).write_text(text)
    docs, issues = payloads.documents(spark, str(tmp_path))
    assert [(r.path.rsplit("/", 1)[-1], r.reason) for r in issues.orderBy("path").collect()] == [("b.json", "not_an_object"), ("c.json", "not_json")]
    seats = payloads.seats_of(docs)
    assert rows(seats, "edition", "ordinal", "code", "registered") == [("pru-15", 0, "P.001", 9), ("pru-15", 1, "P.002", None)]
    assert rows(payloads.candidates_of(seats), "seat", "ordinal", "id", "votes") == [("P.001", 0, "c5", 5), ("P.001", 1, "c3", 3)]


def _kml(*marks):
    return '<kml xmlns="http://k"><Document><Folder>' + "".join(marks) + "</Folder></Document></kml>"


def _mark(label, *polygons, description=""):
    ring = lambda kind, x: f"<{kind}><LinearRing><coordinates>\n {x} </coordinates></LinearRing></{kind}>"
    body = "".join("<Polygon>" + ring("outerBoundaryIs", p[0]) + "".join(ring("innerBoundaryIs", x) for x in p[1:]) + "</Polygon>" for p in polygons)
    return f"<Placemark><name>{label}</name><description><![CDATA[{description}]]></description><MultiGeometry>{body}</MultiGeometry></Placemark>"


def test_boundaries_of_archives_keep_holes_apart(spark, tmp_path):
    cells = "<table><tr><td>NAMA_NEGERI</td><td> Perak </td></tr><tr><td>LUAS_KILOMETER_PERSEGI</td><td><b>12.34567</b></td></tr></table>"
    outer, hole, other = "0,0 9,0,5 9,9 0,9 0,0", "1,1 2,1 2,2 1,1", "20,20 21,20 21,21 20,20"
    with zipfile.ZipFile(tmp_path / "a.kmz", "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("readme.txt", "x")
        z.writestr("doc.KML", _kml(_mark("P. 7 Chenderoh", (outer, hole, hole), (other,), description=cells), _mark("n.3 lenggong", (other,)), _mark("Ground", (other,)), _mark("P.008 None")))
    (tmp_path / "b.kml").write_text(_kml(*(_mark(f"N.{k} S{k}", (other,)) for k in range(150))))
    features, issues = readers.boundaries(readers.boundary_marks(spark, str(tmp_path)))
    assert features.count() == 152 and rows(issues, "code", "reason") == [("P.008", "no polygon")]
    one = features.where("code = 'P.007'").first()
    assert (one.layer, one.name, one.state, one.area) == ("parliament", "CHENDEROH", "PERAK", 12.346)
    assert [(len(p.outer), [len(x) for x in p.inners]) for p in one.polygons] == [(5, [4, 4]), (4, [])]
    assert (one.polygons[0].outer[1].x, one.polygons[0].inners[0][2].y) == (9.0, 2.0)
    assert rows(features.where("path like '%.kmz' and layer = 'dun'"), "code", "name", "state", "area") == [("N.03", "LENGGONG", "", None)]
    kinds = features.select("code", geometry.geometry_type(F.col("polygons")).alias("kind"))
    assert kinds.where("kind = 'MultiPolygon'").count() == 1
    with zipfile.ZipFile(tmp_path / "c.kmz", "w") as z:
        z.writestr("x.txt", "")
    with pytest.raises(Exception, match="no KML"):
        readers.boundary_marks(spark, str(tmp_path)).count()


def test_registry_decides_which_editions_are_read(spark, tmp_path):
    path = str(tmp_path)
    data = spark.createDataFrame([(e, s) for e in ("a", "b", "c") for s in range(3)], "edition string, seat int")
    data.write.partitionBy("edition").parquet(f"{path}/seats")
    spark.createDataFrame([("a", 1), ("b", 2), ("c", 9)], "edition string, number int").write.parquet(f"{path}/metadata")
    registry = spark.createDataFrame([("a", 1, False), ("b", 2, True)], "edition string, number int, rolls boolean")
    got = editions.scan(spark, path, "seats", registry, ["number"])
    assert rows(got.groupBy("edition", "number").count()) == [("a", 1, 3), ("b", 2, 3)]
    read = [x for x in got._jdf.queryExecution().toString().splitlines() if "PartitionFilters" in x and "seat" in x]
    assert read and all("edition" in x.split("PartitionFilters: [")[1].split("]")[0] and " IN (a,b)" in x for x in read)
    with pytest.raises(Exception, match="number of edition c isn't the registered one: 9"):
        editions.scan(spark, path, "seats", spark.createDataFrame([("c", 3, True)], registry.schema), ["number"]).count()
    with pytest.raises(Exception, match="nothing to look up: edition=z"):
        editions.scan(spark, path, "seats", spark.createDataFrame([("z", 3, True)], registry.schema), ["number"]).count()
    shape = "edition string, seat int"
    assert rows(editions.optional(spark, path, "seats", registry, "rolls", shape, ["number"])) == [("b", 0), ("b", 1), ("b", 2)]
    none = editions.optional(spark, path, "never written", registry.withColumn("rolls", F.lit(None).cast("boolean")), "rolls", shape, ["number"])
    assert none.count() == 0 and none.columns == ["edition", "seat"]


def test_two_tiers_within_their_budgets(spark, tmp_path):
    import numpy as np

    turn = lambda n: [float(v) for t in np.linspace(0, 2 * np.pi, n, endpoint=False) for v in (np.cos(t), np.sin(t))]
    df = spark.createDataFrame([(f"P.{k:03d}", "ab"[k % 2], turn(200)) for k in range(6)], "code string, state string, flat array<double>").select("code", "state", geometry.ring(F.col("flat")).alias("ring"))
    path = str(tmp_path / "atlas")
    writers.two_tiers(df, path, "state", "ring", 0.05)
    back = spark.read.json(path)
    assert rows(back.groupBy("tier", "area").count()) == [("area", "a", 3), ("area", "b", 3), ("index", "all", 6)]
    sizes = {r.tier: r.n for r in back.groupBy("tier").agg(F.max(F.size("ring")).alias("n")).collect()}
    assert sizes["area"] == 200 and sizes["index"] < 20
    assert writers.over_budget(spark, path, {"index": 10_000, "area": 1_000_000}).count() == 0
    assert rows(writers.over_budget(spark, path, {"index": 10, "area": 1_000_000}), "rule_id", "code") == [("K4", "index/all")]


def test_provenance_names_its_rule(spark):
    regions, versions = provenance.registered(spark)
    own = spark.createDataFrame([("state", "perlis", "perlis-2020", "2020-01-01")], "scope string, name string, version string, effective_from string").withColumn("effective_from", F.to_date("effective_from"))
    places = spark.createDataFrame([("a", "johor", "2019-01-01"), ("b", "johor", "2018-03-28"), ("c", "sarawak", "2015-12-19"), ("d", "perlis", "2019-12-31"), ("e", "perlis", "2020-01-01"), ("f", "atlantis", "2020-01-01"), ("g", None, "2020-01-01")], "place string, state string, date string").withColumn("date", F.to_date("date"))
    found = provenance.boundary_provenance(places, regions, versions.unionByName(own))
    assert rows(found, "place", "version", "rule") == [
        ("a", "my-peninsula-2018", "region peninsula"), ("b", None, "no version in force"), ("c", "my-sarawak-2015", "region sarawak"), ("d", "my-peninsula-2018", "region peninsula"), ("e", "perlis-2020", "state perlis"), ("f", None, "unregistered state"), ("g", None, "unregistered state"),
    ]
    assert rows(provenance.unresolved(found), "place", "reason") == [("b", "no version in force"), ("f", "unregistered state"), ("g", "unregistered state")]
