"""Queries on the text, number, geometry and label functions, each over values whose result SQL can state."""

from __future__ import annotations

from pyspark.sql import functions as F

from hustings.functions import geometry, numbers, parsing, text
from hustings.operators import match
from hustings.sources.scratch import folder
from hustings.plans.relations import _EDGES
from hustings.plans.roles import Registry
from hustings.sources import readers
from hustings.sources.readers import table
from hustings.streaming import telemetry

registry = Registry()
query = registry.query


def _customers(spark, d):
    return table(spark, d, "customer").select("c_custkey", "c_name", "c_mktsegment")


# Text


_FOLDED = "c_name || ' Ecole, (' || c_mktsegment || ')'"


@query(
    "f1a_f1e_normalised",
    f"SELECT c_custkey, trim(regexp_replace(upper(x), '[^A-Z0-9]+', ' ', 'g')) AS a, regexp_replace(upper(x), '[^A-Z0-9]+', '', 'g') AS b, trim(regexp_replace(lower(x), '[^a-z0-9]+', ' ', 'g')) AS c, regexp_replace(lower(x), '[^a-z0-9]+', '', 'g') AS d, lower(x) AS e FROM (SELECT c_custkey, {_FOLDED} AS x FROM customer)",
)
def f1a_f1e(spark, d):
    x = F.concat("c_name", F.lit(" École, ("), "c_mktsegment", F.lit(")"))
    return _customers(spark, d).select("c_custkey", text.upper_with_spaces(x).alias("a"), text.upper_no_spaces(x).alias("b"), text.lower_with_spaces(x).alias("c"), text.lower_no_spaces(x).alias("d"), text.lower_marks(x).alias("e"))


_DASHED = "regexp_replace(regexp_replace({}, '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g')"


@query(
    "f2a_f2d_slugs",
    f"SELECT n_nationkey, {_DASHED.format('x')} AS slug, {_DASHED.format("replace(x, 'w.p', 'wp')")} AS territory, 'party-' || {_DASHED.format("y || 'le'")} AS catalogue FROM (SELECT n_nationkey, 'w.p. ' || lower(n_name) || ' (1) ' AS y, y || 'ile' AS x FROM nation)",
)
def f2a_f2d(spark, d):
    x = F.concat(F.lit("W.P. "), "n_name", F.lit(" (1) Île"))
    return table(spark, d, "nation").select("n_nationkey", text.slug(x).alias("slug"), text.slug_territory(x).alias("territory"), text.catalogue_id("party", x).alias("catalogue"))


@query("f5_similarity", "SELECT p_partkey, 2.0::DOUBLE * p_size / (2 * p_size + p_partkey % 5) AS ratio FROM part")
def f5(spark, d):
    same = F.repeat(F.lit("a"), F.col("p_size"))
    return table(spark, d, "part").select("p_partkey", text.similarity(same, F.concat(same, F.expr("repeat('b', CAST(p_partkey % 5 AS INT))"))).alias("ratio"))


@query("p2_normalised_equality", "SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING'")
def p2(spark, d):
    return _customers(spark, d).where(text.lower_no_spaces(F.col("c_mktsegment")) == text.lower_no_spaces(F.lit(" Buílding."))).select("c_custkey")


@query("p8_finite_values", "SELECT event_id, value FROM events WHERE event_id % 3 <> 0 AND event_id % 5 <> 0 AND value IS NOT NULL")
def p8(spark, d):
    value = F.when(F.col("event_id") % 3 == 0, None).when(F.col("event_id") % 5 == 0, F.when(F.col("event_id") % 2 == 0, float("nan")).otherwise(float("-inf"))).otherwise(F.col("value"))
    return table(spark, d, "events").select("event_id", value.alias("value")).where(numbers.finite(F.col("value")))


@query("m2_cleaned_events", "SELECT event_id, substring(event_type || ' ' || props, 1, 80) AS name, '/' || event_type AS path, event_type || ' ' || CAST(user_id AS VARCHAR) AS message FROM events")
def m2(spark, d):
    events = table(spark, d, "events").select(
        "event_id", F.concat(F.lit("\n"), "event_type", F.lit("\x01\t"), "props").alias("name"),
        F.concat(F.lit("https://host/"), "event_type", F.lit("?q=1#top")).alias("path"), F.concat_ws("\r\n", "event_type", "user_id").alias("message"),
    )
    return telemetry.cleaned(events)


# Numbers and parsing


@query("r3_without_code", "SELECT c_custkey, c_mktsegment || ' P.7' AS name FROM customer")
def r3(spark, d):
    label = F.concat(F.lit("P."), F.lpad((F.col("c_custkey") % 1000).cast("string"), 3, "0"), F.lit("  "), "c_mktsegment", F.lit(" P.7"))
    return _customers(spark, d).select("c_custkey", text.without_code(label).alias("name"))


@query("r5a_r5c_integers", "SELECT c_custkey, CASE WHEN c_custkey % 5 = 0 THEN c_custkey * 1000 ELSE 0 END AS audit, CASE WHEN c_custkey % 5 = 0 THEN 0 ELSE c_custkey END AS state, CASE WHEN c_custkey % 5 = 0 THEN 0 ELSE c_custkey END AS strict FROM customer")
def r5a_r5c(spark, d):
    k, key = F.col("c_custkey") % 5, F.col("c_custkey").cast("string")
    audit = F.when(k == 0, F.concat(key, F.lit(",000"))).when(k == 1, "-").when(k == 2, "NULL").when(k == 3, " ")
    state = F.when(k == 0, "null").otherwise(F.concat(key, F.lit(".9")))
    return _customers(spark, d).select("c_custkey", numbers.integer_audit(audit).alias("audit"), numbers.integer_state(state).alias("state"), numbers.integer_strict(F.when(k == 0, "").otherwise(key)).alias("strict"))


@query("r6_percentages", "SELECT c_custkey, CASE WHEN c_custkey % 5 = 0 THEN 0 ELSE CAST((c_custkey % 100) || '.5' AS DOUBLE) / 100 END AS share FROM customer")
def r6(spark, d):
    label = F.when(F.col("c_custkey") % 5 == 0, "  ").otherwise(F.concat((F.col("c_custkey") % 100).cast("string"), F.lit(".5%")))
    return _customers(spark, d).select("c_custkey", numbers.percentage(label).alias("share"))


@query("r10_coordinates", "SELECT c_custkey, CAST(4 AS INTEGER) AS points, CAST(c_custkey % 180 + 0.25 AS DOUBLE) AS x, CAST(-1.5 AS DOUBLE) AS y FROM customer")
def r10(spark, d):
    listed = F.concat(F.lit(" 1,2,0\n 3,4  5,6\t"), (F.col("c_custkey") % 180).cast("string"), F.lit(".25,-1.5,7 "))
    points = _customers(spark, d).select("c_custkey", readers.coordinates(listed).alias("p"))
    return points.select("c_custkey", F.size("p").alias("points"), F.element_at("p", -1)["x"].alias("x"), F.element_at("p", -1)["y"].alias("y"))


@query("r11_number_runs", "SELECT c_custkey, CASE WHEN c_custkey % 3 < 2 THEN c_custkey + 10 || ',' || c_custkey + 9 || ',1;7,3,4' END AS groups FROM customer")
def r11(spark, d):
    """Two groups of three that balance, a third of the rows with a stray number before, a third with a wrong sum."""
    k = F.col("c_custkey")
    run = F.array(k + 10 + F.when(k % 3 == 2, 50).otherwise(0), k + 9, F.lit(1), F.lit(7), F.lit(3), F.lit(4)).cast("array<bigint>")
    given = F.when(k % 3 == 1, F.concat(F.array(F.lit(999)).cast("array<bigint>"), run)).otherwise(run)
    groups = parsing.balanced_groups(F.col("given"), 3)
    joined = F.array_join(F.transform(groups, lambda g: F.array_join(g.cast("array<string>"), ",")), ";")
    return _customers(spark, d).select("c_custkey", given.alias("given")).select("c_custkey", joined.alias("groups"))


@query("n9_merged_sums", "SELECT c_custkey, c_custkey + 1 AS a, CAST(2 AS BIGINT) AS b, CAST(c_custkey % 9 AS BIGINT) AS c FROM customer")
def n9(spark, d):
    k = F.col("c_custkey").cast("bigint")
    one = lambda x: F.lit(x).cast("bigint")
    total = numbers.merge_sums(F.create_map(F.lit("a"), k, F.lit("b"), one(2)), F.create_map(F.lit("a"), one(1), F.lit("c"), k % 9))
    return _customers(spark, d).select("c_custkey", total.alias("m")).select("c_custkey", *(F.col("m")[x].alias(x) for x in "abc"))


# Geometry and labels


@query("g3_ring_areas", _EDGES + " SELECT vec_id, CAST(round(abs(sum(ax * by_ - bx * ay)) / 2 * 1e6) AS BIGINT) AS area_millionths FROM e GROUP BY vec_id")
def g3(spark, d):
    ring = geometry.ring(F.col("embedding"))
    return table(spark, d, "embeddings").select("vec_id", F.round(geometry.area(ring) * 1e6).cast("bigint").alias("area_millionths"))


@query(
    "g8_view_boxes",
    "WITH b AS (SELECT vec_id, min(x) AS x0, max(x) AS x1, min(y) AS y0, max(y) AS y1 FROM (SELECT vec_id, CAST(embedding[2 * i + 1] AS DOUBLE) * 100 AS x, CAST(embedding[2 * i + 2] AS DOUBLE) * 100 AS y FROM embeddings, range(32) r(i)) GROUP BY vec_id), s AS (SELECT *, greatest(x1 - x0, 22) * 1.2 AS w, greatest(y1 - y0, 22) * 1.2 AS h FROM b), t AS (SELECT *, greatest(w, h * 12 / 7) AS wide, greatest(h, w * 7 / 12) AS high FROM s) SELECT vec_id, round((x0 + x1) / 2 - wide / 2, 6) AS x, round((y0 + y1) / 2 - high / 2, 6) AS y, round(wide, 6) AS width, round(high, 6) AS height FROM t",
)
def g8(spark, d):
    ring = geometry.ring(F.transform("embedding", lambda x: x.cast("double") * 100))
    boxes = table(spark, d, "embeddings").select("vec_id", geometry.view_box(geometry.bounds(ring)).alias("v"))
    return boxes.select("vec_id", *(F.round(F.col("v")[k], 6).alias(k) for k in ("x", "y", "width", "height")))


@query("g12_paths", "SELECT c_custkey, CASE WHEN c_custkey % 4 = 0 THEN '' ELSE 'M' || k || ',0L' || k + 1 || ',0.25L' || k + 1 || ',1.5L' || k || ',1.33Z' END AS path FROM (SELECT c_custkey, c_custkey % 1000 AS k FROM customer)")
def g12(spark, d):
    k = (F.col("c_custkey") % 1000).cast("double")
    at = lambda x, y: F.struct(x.alias("x"), F.lit(y).alias("y"))
    whole = F.array(at(k, 0.0), at(k + 1, 0.25), at(k + 1, 1.5), at(k, 1.3333))
    ring = F.when(F.col("c_custkey") % 4 == 0, F.slice(whole, 1, 3)).otherwise(whole)
    return _customers(spark, d).select("c_custkey", geometry.svg_path(ring).alias("path"))


@query("s7_g14_placemarks", "SELECT n_name AS name, 'nation ' || n_nationkey AS description, '0,0 1,0 1,1 0,' || n_nationkey || '|2,2 3,2 3,3' AS rings FROM nation")
def s7_g14(spark, d):
    path = folder(spark, "placemarks")
    ring = lambda x: F.concat(F.lit("<LinearRing><coordinates> "), x, F.lit(" </coordinates></LinearRing>"))
    outer, inner = ring(F.concat(F.lit("0,0 1,0  1,1 0,"), "n_nationkey")), ring(F.lit("2,2 3,2 3,3"))
    mark = F.concat(
        F.lit("<kml><Document><Placemark><name>"), "n_name", F.lit("</name><description>nation "), "n_nationkey", F.lit("</description><Polygon><outerBoundaryIs>"),
        outer, F.lit("</outerBoundaryIs><innerBoundaryIs>"), inner, F.lit("</innerBoundaryIs></Polygon></Placemark></Document></kml>"),
    )
    table(spark, d, "nation").select(F.col("n_nationkey").alias("file"), mark.alias("value")).write.partitionBy("file").text(path)
    return readers.placemarks(spark, path).select("name", "description", F.array_join("rings", "|").alias("rings"))


_AT = {"p": (7, 13, 11, 29), "s": (17, 19, 23, 31)}


@query(
    "j21_least_total_distance",
    "WITH c AS (SELECT s_suppkey AS k, p, s, power((k * 7 + p * 13) % 50 - (k * 17 + s * 19) % 50, 2) + power((k * 11 + p * 29) % 50 - (k * 23 + s * 31) % 50, 2) AS cost FROM supplier, range(2) a(p), range(3) b(s)) SELECT a.k, CAST(min(a.cost + b.cost) AS BIGINT) AS total FROM c a JOIN c b ON a.k = b.k AND a.p = 0 AND b.p = 1 AND a.s <> b.s GROUP BY a.k",
)
def j21(spark, d):
    """Two points and three slots for each supplier; the total of the squared distances."""

    def places(name, count):
        a, b, c, e = _AT[name]
        rows = table(spark, d, "supplier").select(F.col("s_suppkey").alias("k"), F.explode(F.sequence(F.lit(0), F.lit(count - 1))).alias("id"))
        return rows.select("k", "id", ((F.col("k") * a + F.col("id") * b) % 50).alias("x"), ((F.col("k") * c + F.col("id") * e) % 50).alias("y"))

    return match.assign_points(places("p", 2), places("s", 3), "k").groupBy("k").agg(F.sum("squared").cast("bigint").alias("total"))


@query("j25_labels", "SELECT n_nationkey, 'NORTH ' || n_name AS name, '1,2' AS segments FROM nation UNION ALL SELECT n_nationkey, n_name, '3' FROM nation")
def j25(spark, d):
    """The longer name takes the two neighbouring segments, the shorter the one that is left."""
    n = table(spark, d, "nation").select("n_nationkey", "n_name")
    north = F.concat(F.lit("NORTH "), "n_name")
    segments = n.select("n_nationkey", F.posexplode(F.array(F.lit("x"), F.lit("NORTH"), "n_name", "n_name")).alias("id", "text"))
    names = n.select("n_nationkey", F.explode(F.array("n_name", north)).alias("name"))
    return match.label_segments(segments, names, "n_nationkey").select("n_nationkey", "name", F.array_join(F.col("segments").cast("array<string>"), ",").alias("segments"))
