"""Text, number and geometry functions, files, and telemetry as a stream."""

import zipfile

import pytest
from pyspark.sql import functions as F

from hustings.functions import geometry, numbers, parsing, text
from hustings.operators import match
from hustings.sources import readers, writers
from hustings.streaming import telemetry


def one(spark, column):
    return spark.range(1).select(column.alias("v")).first().v


@pytest.mark.parametrize("name,value,expected", [
    ("upper_with_spaces", "Çan-ﬁ ß x", "CAN FI X"), ("upper_no_spaces", "a-b c", "ABC"), ("lower_with_spaces", " Foo--Bar ", "foo bar"), ("lower_no_spaces", "É t", "et"), ("lower_marks", "École ß!", "ecole ß!"),
    ("canonical_name", " école 1 ", "COLE 1"), ("slug", "W.P. Kuala Lumpur", "w-p-kuala-lumpur"), ("slug_territory", "W.P. Kuala Lumpur", "wp-kuala-lumpur"), ("state_id", "W.P Labuan", "wp-labuan"),
    ("short_name", "Long Name (LN)", "LN"), ("short_name", "Plain", "Plain"), ("collapse_spaces", " a \n b ", "a b"), ("clean_path", "https://x.y/a/b?q=1#z", "/a/b"), ("clean_path", "", "/"), ("code", "P.012 SEAT", "P.012"), ("code", "none", None), ("without_code", "P.012 SEAT", "SEAT"),
])
def test_text(spark, name, value, expected):
    assert one(spark, getattr(text, name)(F.lit(value))) == expected


def test_cells_and_similarity(spark):
    assert one(spark, text.cells(F.lit("<table><tr><td>A</td><td><b>1</b></td></tr><tr><td>B</td><td>2</td></tr></table>"))) == {"A": "1", "B": "2"}
    assert one(spark, text.similarity(F.lit("abcd"), F.lit("bcde"))) == pytest.approx(0.75)
    assert one(spark, text.padded_code(F.lit(7))) == "N.07"


@pytest.mark.parametrize("name,value,expected", [
    ("integer_audit", "1,234", 1234), ("integer_audit", "-", 0), ("integer_audit", None, 0), ("integer_state", "12.9", 12), ("integer_state", "null", 0), ("integer_strict", "", 0),
    ("integer_digits", "a1b2", 12), ("integer_digits", "x", None), ("first_number", "seen 1,234 of 9", 1234), ("percentage", "65.5%", 0.655), ("percentage", "", 0.0),
])
def test_numbers(spark, name, value, expected):
    assert one(spark, getattr(numbers, name)(F.lit(value).cast("string"))) == expected


def test_ratios_tolerance_and_maps(spark):
    z = F.lit(0)
    assert one(spark, numbers.ratio_or_zero(F.lit(1), z)) == 0.0 and one(spark, numbers.ratio_or_null(F.lit(1), z)) is None and one(spark, numbers.ratio_at_least_one(F.lit(3), z)) == 3.0
    assert one(spark, numbers.approx_equal(F.lit(1.0), F.lit(1.0000015))) and not one(spark, numbers.approx_equal(F.lit(None).cast("double"), F.lit(1.0)))
    assert one(spark, numbers.round_fraction(F.lit(0.1234565))) == round(0.1234565, 6)
    a, b = F.create_map(F.lit("x"), F.lit(1), F.lit("y"), F.lit(2)), F.create_map(F.lit("y"), F.lit(3))
    assert one(spark, numbers.merge_sums(a, b)) == {"x": 1, "y": 5}
    assert set(one(spark, numbers.changed_keys(a, b))) == {"x", "y"}
    assert one(spark, numbers.parts_per_million(F.lit(41), F.lit(640))) == 64063


@pytest.mark.parametrize("given,groups", [([5, 2, 3, 7, 3, 4], [[5, 2, 3], [7, 3, 4]]), ([9, 5, 2, 3, 1, 1], [[5, 2, 3]]), ([1, 2, 4], None), ([], None)])
def test_runs_of_numbers_balance(spark, given, groups):
    assert one(spark, parsing.balanced_groups(F.array(*map(F.lit, given)).cast("array<bigint>"), 3)) == groups


def test_lines_parse(spark):
    assert one(spark, parsing.fixed_row(F.lit("01/02  Upper Town  1,000 20"), 2)).asDict() == {"code": "01/02", "name": "Upper Town", "values": [1000, 20]}
    assert one(spark, parsing.fixed_row(F.lit("heading only"), 2)) is None
    assert one(spark, parsing.collapse_overlay(F.lit("aabb cc\naabb cc\nx\naabb cc\naabb cc\nx"))) == "ab cc\nx"
    assert str(one(spark, parsing.date_in(F.lit("D:20240131120000")))) == "2024-01-31" and one(spark, parsing.date_in(F.lit("none"))) is None


def test_segments_are_used_once(spark):
    segments = spark.createDataFrame([(1, 1, "Upper"), (1, 2, "Town"), (1, 3, "Town"), (1, 4, "Hill")], "page int, id int, text string")
    names = spark.createDataFrame([(1, "Town"), (1, "Upper Town"), (1, "Vale")], "page int, name string")
    assert sorted((r.name, r.segments) for r in match.label_segments(segments, names, "page").collect()) == [("Town", [3]), ("Upper Town", [1, 2])]


def square(spark, points):
    return spark.createDataFrame([(points,)], f"r {geometry.RING}")


def test_geometry(spark):
    df = square(spark, [(0.0, 0.0), (2.0, 0.0), (2.0, 2.0), (0.0, 2.0)])
    r = df.select(geometry.signed_area(F.col("r")).alias("a"), geometry.centroid(F.col("r")).alias("c"), geometry.bounds(F.col("r")).alias("b"), geometry.oriented(F.col("r")).alias("o"), geometry.svg_path(F.col("r")).alias("p")).first()
    assert r.a == 4.0 and (r.c.x, r.c.y) == (1.0, 1.0) and (r.b.min_x, r.b.max_y) == (0.0, 2.0) and [p.x for p in r.o] == [0.0, 2.0, 2.0, 0.0] and r.p == "M0,0L2,0L2,2L0,2Z"
    flat = square(spark, [(0.0, 0.0), (2.0, 0.0)]).select(geometry.centroid(F.col("r")).alias("c")).first().c
    assert (flat.x, flat.y) == (1.0, 0.0)
    line = square(spark, [(0.0, 0.0), (1.0, 0.01), (2.0, 0.0), (3.0, 5.0), (4.0, 0.0)])
    assert [p.x for p in line.select(geometry.simplified(F.col("r"), 0.1).alias("s")).first().s] == [0.0, 2.0, 3.0, 4.0]
    assert one(spark, geometry.segment_distance(*(F.lit(x) for x in (0.0, 5.0, 1.0, 0.0, 2.0, 0.0)))) == pytest.approx(26**0.5)
    assert one(spark, geometry.mercator(F.lit(180.0), F.lit(0.0))).x == pytest.approx(3.14159265)


def test_files(spark, tmp_path):
    (tmp_path / "t.csv").write_bytes("﻿name,n\nx,1\n".encode())
    assert readers.csv_table(spark, str(tmp_path / "t.csv")).columns == ["name", "n"]
    (tmp_path / "d.json").write_text('[{"a": 1},\n {"a": 2}]')
    assert sorted(r.a for r in readers.json_documents(spark, str(tmp_path / "d.json"), "a int").collect()) == [1, 2]
    (tmp_path / "P.012 sheet.txt").write_text("hello")
    found = readers.files(spark, str(tmp_path), "*.txt")
    assert found.first().code == "P.012"
    ok = found.select("name", "sha256")
    assert readers.locked(found, ok).count() == 1
    with pytest.raises(Exception, match="registered"):
        readers.locked(found, ok.withColumn("sha256", F.lit("0"))).select("sha256").collect()
    kml = '<kml xmlns="k"><Placemark><name>A</name><Polygon><coordinates>1,2 3,4,0 5,6</coordinates></Polygon></Placemark></kml>'
    (tmp_path / "k").mkdir()
    with zipfile.ZipFile(tmp_path / "k" / "a.kmz", "w") as z:
        z.writestr("doc.kml", kml)
    r = readers.placemarks(spark, str(tmp_path / "k")).select("name", readers.coordinates(F.col("rings")[0]).alias("c")).first()
    assert r.name == "A" and [(p.x, p.y) for p in r.c] == [(1.0, 2.0), (3.0, 4.0), (5.0, 6.0)]
    assert readers.nothing(spark, "a int").count() == 0


def test_checked_and_guarded_writing(spark, tmp_path):
    df = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    path = str(tmp_path / "out")
    writers.write_or_check(df, path)
    writers.write_or_check(df, path, check=True)
    with pytest.raises(writers.StaleOutput):
        writers.write_or_check(df.where("k = 1"), path, check=True)
    with pytest.raises(PermissionError):
        writers.guarded_append(df, path, df.where("k = 2"), ["k"])
    writers.partitioned(df, str(tmp_path / "parts"), "v")
    assert (tmp_path / "parts" / "v=a").is_dir()
    assert len(writers.manifest(spark, path).where("file like '%parquet'").collect()) >= 1
    assert writers.entity_tag(df).select("etag").distinct().count() == 2


EVENTS = [("web-vital", "LCP", 1.5, "good", "/a", "2024-01-01 00:00:00"), ("web-vital", "LCP", 2.5, "poor", "/a", "2024-01-02 00:00:00"), ("interaction", "open", None, None, "/b?x", "2024-01-02 01:00:00"), ("web-vital", "??", 1.0, "good", "/a", "2024-01-02 00:00:00"), ("spam", "x", 1.0, "good", "/a", "2024-01-02 00:00:00")]
KIND = "kind string, name string, value double, rating string, path string, received_at string"


def test_stream_equals_batch(spark, tmp_path):
    df = spark.createDataFrame(EVENTS, KIND).withColumns({"received_at": F.to_timestamp("received_at"), "message": F.lit("m")})
    good, bad = telemetry.split(df)
    assert (good.count(), bad.count()) == (3, 2)
    assert {r.path for r in telemetry.cleaned(good).collect()} == {"/a", "/b"}
    df.repartition(2).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    query = telemetry.trailing(telemetry.split(stream)[0]).writeStream.format("memory").queryName("rolled").outputMode("complete").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    query.awaitTermination(120)
    rows = lambda d: sorted((str(r.window.start), r.name, r.samples, r.average, r.poor) for r in d.collect())
    assert rows(spark.table("rolled")) == rows(telemetry.trailing(good))


def test_centroid_and_simplified_rings_against_plain_loops(spark):
    import numpy as np

    rng = np.random.default_rng(5)
    rings = [rng.normal(size=(12, 2)) for _ in range(6)] + [np.array([[0.0, 0], [1, 1], [2, 2]])]
    df = spark.createDataFrame([(k, [float(v) for v in r.ravel()]) for k, r in enumerate(rings)], "k int, flat array<double>").select("k", geometry.ring(F.col("flat")).alias("ring"))
    rows = df.select("k", geometry.centroid(F.col("ring")).alias("c"), geometry.simplified(F.col("ring"), 0.4).alias("s")).collect()

    def kept(points):
        if len(points) < 3:
            return points
        a, d = points[0], points[-1] - points[0]
        t = np.clip(((points[1:-1] - a) @ d) / (d @ d), 0, 1)
        far = np.hypot(*(points[1:-1] - (a + t[:, None] * d)).T)
        at = int(far.argmax()) + 1
        return np.vstack([kept(points[: at + 1])[:-1], kept(points[at:])]) if far[at - 1] > 0.4 else points[[0, -1]]

    for row in rows:
        p, q = rings[row.k], np.roll(rings[row.k], -1, axis=0)
        cross = p[:, 0] * q[:, 1] - q[:, 0] * p[:, 1]
        want = p.mean(0) if abs(cross.sum()) < 1e-9 else ((p + q) * cross[:, None]).sum(0) / (3 * cross.sum())
        assert np.allclose([row.c.x, row.c.y], want)
        assert np.allclose([(x.x, x.y) for x in row.s], kept(rings[row.k]))


def test_folding_equals_the_unicode_tables_for_every_character(spark):
    import unicodedata

    chars = [chr(c) for c in range(0x20, 0x20000) if not 0xD800 <= c <= 0xDFFF]
    texts = ["x" + "".join(chars[k : k + 7]) + "y" for k in range(0, len(chars), 7)] + ["e\u0301o\u0308", "ﬁné ½ Å\u0327", "", None, "plain"]
    got = spark.createDataFrame(list(enumerate(texts)), "k int, t string").select("k", "t", text.fold_ascii(F.col("t")).alias("a"), text.strip_marks(F.col("t")).alias("m")).collect()
    assert len(got) == len(texts)
    for r in got:
        if r.t is None:
            assert r.a is None and r.m is None
            continue
        assert r.a == unicodedata.normalize("NFKD", r.t).encode("ascii", "ignore").decode()
        want = "".join(c for c in unicodedata.normalize("NFD", r.t) if not "\u0300" <= c <= "\u036f")
        assert r.m == want or sorted(r.m) == sorted(want)  # only the order of other marks may differ
    plan = spark.createDataFrame([("é",)], "t string").select(text.upper_with_spaces(F.col("t")))._jdf.queryExecution().toString()
    assert "Python" not in plan
