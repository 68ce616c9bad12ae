"""Queries on parsing, identity, positions and publication."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from hustings.functions import geometry, parsing, text
from hustings.operators import compare, contest, editorial, match, overlay, rollup, rules, search
from hustings.plans import roles
from hustings.plans.roles import BASE, KEYS, Registry
from hustings.sources import writers
from hustings.sources.readers import table

registry = Registry()
query = registry.query

_LINES = "lines_of AS (SELECT doc_id, i, ls[i + 1] AS line FROM (SELECT doc_id, string_split(text, chr(10)) AS ls, unnest(range(len(string_split(text, chr(10))))) AS i FROM documents))"


def _lines(spark, d):
    return table(spark, d, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("i", "line"))


@query("r2_code_and_name", "SELECT p_partkey, regexp_extract(p_brand, '^([A-Za-z]+)#([0-9]+)$', 1) AS name, regexp_extract(p_brand, '^([A-Za-z]+)#([0-9]+)$', 2) AS code FROM part")
def r2(spark, d):
    at = lambda k: F.regexp_extract("p_brand", r"^([A-Za-z]+)#([0-9]+)$", k)
    return table(spark, d, "part").select("p_partkey", at(1).alias("name"), at(2).alias("code"))


@query("r4_padded_codes", "SELECT n_nationkey, 'N.' || lpad(CAST(n_nationkey AS VARCHAR), 2, '0') AS code FROM nation")
def r4(spark, d):
    return table(spark, d, "nation").select("n_nationkey", text.padded_code(F.col("n_nationkey")).alias("code"))


@query("r7_fixed_rows", "SELECT o_orderkey, o_orderstatus AS code, o_custkey + o_orderkey AS total FROM orders")
def r7(spark, d):
    line = F.concat_ws("  ", "o_orderstatus", F.lit("SOME NAME"), "o_custkey", "o_orderkey")
    row = parsing.fixed_row(line, 2)
    return table(spark, d, "orders").select("o_orderkey", row.alias("r")).select("o_orderkey", "r.code", (F.col("r.values")[0] + F.col("r.values")[1]).alias("total"))


@query("r8_labelled_numbers", "SELECT event_id, coalesce(CASE WHEN event_id % 2 = 0 THEN event_id END, CASE WHEN l1 % 2 = 0 THEN l1 END, CASE WHEN l2 % 2 = 0 THEN l2 END) AS number FROM (SELECT *, lead(event_id, 1) OVER w AS l1, lead(event_id, 2) OVER w AS l2 FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id)) WHERE event_type = 'purchase'")
def r8(spark, d):
    line = F.when(F.col("event_id") % 2 == 0, F.concat_ws(" ", "event_type", "event_id")).otherwise(F.col("event_type"))
    rows = table(spark, d, "events").select("user_id", "event_id", line.alias("line"))
    return parsing.labelled_numbers(rows, ["user_id"], "event_id", "line", "purchase").select("event_id", "number")


@query("r14_numbers_after_last_marker", "SELECT user_id, string_agg(CAST(event_id AS VARCHAR), ',' ORDER BY event_id) AS numbers FROM events e JOIN (SELECT user_id AS u, max(event_id) AS f FROM events WHERE event_type = 'signup' GROUP BY user_id) ON u = user_id AND event_id >= f GROUP BY user_id")
def r14(spark, d):
    rows = table(spark, d, "events").select("user_id", "event_id", F.concat_ws(" ", "event_type", "event_id").alias("line"))
    found = parsing.after_last(rows, ["user_id"], "event_id", "line", "signup")
    return found.select("user_id", F.array_join(F.col("numbers").cast("array<string>"), ",").alias("numbers"))


@query("r15_best_header_row", "WITH " + _LINES + ", c AS (SELECT doc_id, CAST(i AS INTEGER) AS i, CAST(len(list_filter(string_split(line, ','), lambda x: trim(x) <> '')) AS INTEGER) AS filled FROM lines_of WHERE i < 10) SELECT doc_id, i AS at, filled FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY filled DESC, i) AS p FROM c) WHERE p = 1")
def r15(spark, d):
    return parsing.best_header(_lines(spark, d).withColumn("cells", F.split("line", ",")), ["doc_id"], "i", "cells")


@query("r16_dates", "SELECT o_orderkey, CAST(o_orderdate AS DATE) AS day FROM orders")
def r16(spark, d):
    name = F.concat(F.lit("report-"), F.date_format("o_orderdate", "yyyyMMdd"), F.lit(".pdf"))
    return table(spark, d, "orders").select("o_orderkey", parsing.date_in(name).alias("day"))


_PAIRS = "array_to_string(list_transform(range(0, length(w) // 2), lambda k: substr(w, 2 * k + {}, 1)), '')"
_SINGLE = f"CASE WHEN length(w) > 2 AND length(w) % 2 = 0 AND {_PAIRS.format(1)} = {_PAIRS.format(2)} THEN {_PAIRS.format(1)} ELSE w END"


@query("f6_collapsed_overlays", f"SELECT doc_id, CAST(length(t) AS INTEGER) AS n, sha256(t) AS digest FROM (SELECT doc_id, array_to_string(list_transform(list_filter(l, lambda x, i: i = 1 OR x <> l[i - 1]), lambda x: array_to_string(list_transform(string_split(x, ' '), lambda w: {_SINGLE}), ' ')), chr(10)) AS t FROM (SELECT doc_id, string_split(text || ' aabbcc xx', chr(10)) AS l FROM documents))")
def f6(spark, d):
    once = F.concat("text", F.lit(" aabbcc xx"))
    both = table(spark, d, "documents").select("doc_id", parsing.collapse_overlay(F.concat(once, F.lit("\n"), once)).alias("t"))
    return both.select("doc_id", F.length("t").alias("n"), F.sha2("t", 256).alias("digest"))


@query("f3_short_names", "SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 THEN c_mktsegment ELSE c_name END AS short FROM customer")
def f3(spark, d):
    whole = F.when(F.col("c_custkey") % 2 == 0, F.concat("c_name", F.lit(" ("), "c_mktsegment", F.lit(")"))).otherwise(F.col("c_name"))
    return table(spark, d, "customer").select("c_custkey", text.short_name(whole).alias("short"))


@query("n8_zip_to_map", "SELECT p_partkey, p_size AS size, CAST(length(p_name) AS INTEGER) AS length FROM part")
def n8(spark, d):
    m = F.map_from_arrays(F.array(F.lit("size"), F.lit("length")), F.array(F.col("p_size"), F.length("p_name")))
    return table(spark, d, "part").select("p_partkey", m.alias("m")).select("p_partkey", F.col("m")["size"].alias("size"), F.col("m")["length"].alias("length"))


@query("n12_sorted_values_equal", BASE + "SELECT edition, seat, true AS equal FROM cand GROUP BY edition, seat")
def n12(spark, d):
    c = roles.candidacies(spark, d)
    lists = lambda df, name: df.groupBy(*KEYS).agg(F.array_sort(F.collect_list("votes")).alias(name))
    return lists(c, "a").join(lists(c.orderBy("votes"), "b"), KEYS).select(*KEYS, (F.col("a") == F.col("b")).alias("equal"))


@query("n15_entity_tags", "SELECT count(DISTINCT (s_suppkey, s_name)) AS tags FROM supplier")
def n15(spark, d):
    return writers.entity_tag(table(spark, d, "supplier").select("s_suppkey", "s_name")).agg(F.count_distinct("etag").alias("tags"))


@query("j2_mandatory_lookup", "SELECT count(*) AS n, count(*) FILTER (WHERE c_custkey IS NULL) AS missing FROM orders LEFT JOIN customer ON o_custkey = c_custkey")
def j2(spark, d):
    c = table(spark, d, "customer").select("c_custkey", F.lit(True).alias("found"))
    joined = table(spark, d, "orders").join(c, F.col("o_custkey") == F.col("c_custkey"), "left")
    return joined.agg(F.count("*").alias("n"), F.count_if(F.col("found").isNull()).alias("missing"))


@query("j14_positional_corrections", BASE + "SELECT edition, seat, CASE WHEN edition = 2000 AND candidate = w THEN 'corrected' ELSE candidate END AS candidate, votes FROM ranked JOIN (SELECT edition AS e, seat AS s, candidate AS w FROM ranked WHERE position = 1) ON e = edition AND s = seat ")
def j14(spark, d):
    top = roles.ranked(spark, d).withColumn("contest", F.concat_ws(":", *KEYS))
    item = F.struct("position", F.col("candidate").alias("name"), "votes")
    nested = top.groupBy("contest", *KEYS).agg(F.array_sort(F.collect_list(item)).alias("candidates"))
    events = top.where("edition = 2000 and position = 1").select("contest", F.lit(0).alias("position"), F.lit("corrected").alias("name"), F.lit("2024-01-01").cast("date").alias("effective_date"), F.lit(1).alias("created_at"), F.lit(1).alias("ordinal"))
    fixed = overlay.correct_positions(nested, events, "contest", F.lit("2024-06-01").cast("date"))
    return fixed.select(*KEYS, F.explode("candidates").alias("c")).select(*KEYS, F.col("c.name").alias("candidate"), "c.votes")


@query("j18_person_identity", "SELECT s_suppkey AS row, CASE WHEN s_suppkey % 3 = 0 THEN 'x' || CAST(s_suppkey AS VARCHAR) WHEN s_suppkey % 3 = 1 THEN 'p' || CAST(s_suppkey AS VARCHAR) ELSE 'person:' || s_name END AS person FROM supplier")
def j18(spark, d):
    s = table(spark, d, "supplier")
    explicit = F.when(F.col("s_suppkey") % 3 == 0, F.concat(F.lit("x"), F.col("s_suppkey").cast("string")))
    rows = s.select(F.col("s_suppkey").alias("row"), explicit.alias("person_id"), F.col("s_name").alias("n1"), F.upper("s_name").alias("n2"))
    known = s.where("s_suppkey % 3 = 1").select(F.concat(F.lit("p"), F.col("s_suppkey").cast("string")).alias("person_id"), F.upper("s_name").alias("name"))
    return match.resolve_person(rows, known, ["n1", "n2"]).select("row", "person")


def _sheet(spark, d):
    ranked = roles.ranked(spark, d).withColumn("contest", F.concat_ws(":", *KEYS))
    rows = ranked.select("contest", F.col("position").alias("row"), F.lower("candidate").alias("name"), (F.col("votes") + (F.col("position") % 2)).alias("votes"))
    return rows, ranked.select("contest", F.col("candidate").alias("candidate_id"), F.col("candidate").alias("name"), "votes")


@query("j19_fuzzy_candidate_match")
def j19(spark, d):
    rows, candidates = _sheet(spark, d)
    return match.fuzzy_match(rows, candidates).select("contest", "row", "candidate_id")


@query("j20_column_assignment")
def j20(spark, d):
    rows, candidates = _sheet(spark, d)
    return match.assign_columns(rows.withColumnRenamed("row", "column"), candidates)


@query("j31_winner_lookup", BASE + "SELECT edition, seat, winner FROM win")
def j31(spark, d):
    lists = roles.ranked(spark, d).groupBy(*KEYS).agg(F.collect_list(F.struct("candidate", "position")).alias("cs"))
    return lists.select(*KEYS, F.get(F.filter("cs", lambda c: c["position"] == 1), F.lit(0))["candidate"].alias("winner"))


@query("a19_candidate_totals", BASE + "SELECT seat, candidate, CAST(sum(votes) AS BIGINT) AS votes FROM cand GROUP BY seat, candidate")
def a19(spark, d):
    return roles.candidacies(spark, d).groupBy("seat", "candidate").agg(F.sum("votes").alias("votes"))


@query("a23_event_rollup", BASE + "SELECT edition, region, CAST(sum(registered) AS BIGINT) AS registered, CASE WHEN bool_and(margin > 0) THEN CAST(sum(issued) AS BIGINT) END AS turnout FROM win GROUP BY edition, region")
def a23(spark, d):
    complete = F.bool_and(F.col("margin") > 0)
    return roles.results(spark, d).groupBy("edition", "region").agg(F.sum("registered").alias("registered"), F.when(complete, F.sum("issued")).alias("turnout"))


@query("c6_growth", BASE + "SELECT region, min_by(v, edition) AS first_value, max_by(v, edition) AS last_value, (max_by(v, edition) / min_by(v, edition) - 1) * 100 AS growth FROM (SELECT region, edition, count(*) AS v FROM win GROUP BY region, edition) GROUP BY region")
def c6(spark, d):
    return compare.first_to_last(roles.results(spark, d).groupBy("region", "edition").agg(F.count("*").alias("v")), ["region"], "edition", "v")


@query("c8_not_applicable", BASE + "SELECT s.state, e.edition, n AS tied FROM (SELECT DISTINCT state FROM dim) s CROSS JOIN (SELECT DISTINCT edition FROM cont) e LEFT JOIN (SELECT state, edition, count(*) AS n FROM win WHERE margin = 0 GROUP BY state, edition) f ON f.state = s.state AND f.edition = e.edition")
def c8(spark, d):
    won = roles.results(spark, d)
    tied = won.where("margin = 0").groupBy("state", "edition").agg(F.count("*").alias("tied"))
    return rollup.spine(roles.seats(spark, d).select("state").distinct(), won.select("edition").distinct(), tied, ["state", "edition"])


@query("e9_publish", "SELECT o_orderkey AS revision, CASE WHEN o_orderkey = 7 THEN 'published' WHEN o_orderstatus = 'F' AND o_custkey = (SELECT o_custkey FROM orders WHERE o_orderkey = 7) THEN 'superseded' WHEN o_orderstatus = 'F' THEN 'published' ELSE 'draft' END AS status FROM orders")
def e9(spark, d):
    status = F.when(F.col("o_orderkey") == 7, "reviewed").when(F.col("o_orderstatus") == "F", "published").otherwise("draft")
    revisions = table(spark, d, "orders").select(F.col("o_orderkey").alias("revision"), F.col("o_custkey").alias("key"), status.alias("status"), F.lit("ann").alias("author"))
    return editorial.publish(revisions, F.lit(7), F.lit("bob")).select("revision", "status")


@query("e11_input_validation", "SELECT c_custkey, regexp_matches('pru-' || CAST(c_custkey AS VARCHAR), '^(pru|prn)-[a-z0-9-]+$') AND length(c_name) BETWEEN 8 AND 1000 AND length(c_mktsegment) BETWEEN 2 AND 120 AND c_custkey % 2 = 0 AS ok FROM customer")
def e11(spark, d):
    kind = F.when(F.col("c_custkey") % 2 == 0, "results").otherwise("9 bad")
    return table(spark, d, "customer").select("c_custkey", editorial.valid_input(kind, F.col("c_name"), F.col("c_mktsegment"), F.concat(F.lit("pru-"), F.col("c_custkey").cast("string"))).alias("ok"))


@query("e12_latest_edit", "SELECT user_id AS id, max_by(event_type, event_id) AS name FROM events GROUP BY user_id HAVING max_by(event_type, event_id) <> 'error'")
def e12(spark, d):
    edits = table(spark, d, "events").select(F.col("user_id").alias("id"), F.col("event_type").alias("name"), "event_id")
    return overlay.latest(edits, ["id"], ["name"], order=("event_id",)).where("name <> 'error'")


@query("e15_route", "SELECT o_custkey, max_by(o_orderkey, (o_orderdate, o_orderkey)) AS event FROM orders GROUP BY o_custkey")
def e15(spark, d):
    return table(spark, d, "orders").groupBy("o_custkey").agg(F.max_by("o_orderkey", F.struct("o_orderdate", "o_orderkey")).alias("event"))


_ROUTES = "(SELECT c_custkey AS id, CASE WHEN c_custkey % 3 = 0 THEN CAST(k AS VARCHAR) WHEN c_custkey % 3 = 1 THEN 's' || c_custkey END AS first, CASE WHEN c_custkey % 3 = 1 THEN '1996' ELSE 's' || c_custkey END AS second FROM customer LEFT JOIN (SELECT o_custkey, min(o_orderkey) AS k FROM orders GROUP BY o_custkey) ON o_custkey = c_custkey)"


@query("e15_event_routes", f"SELECT id, event, event IS NOT NULL AND (first IS NULL OR second = '1996') AS redirect FROM (SELECT r.id, any_value(r.first) AS first, any_value(r.second) AS second, max_by(o_orderkey, (o_orderdate, o_orderkey)) AS event FROM {_ROUTES} r LEFT JOIN orders ON o_custkey = r.id AND CASE WHEN second = '1996' THEN year(o_orderdate) = 1996 WHEN first IS NULL THEN r.id % 3 = 2 ELSE CAST(o_orderkey AS VARCHAR) = first END GROUP BY r.id)")
def e15_routes(spark, d):
    """Routes by assembly number, by a year, or by the state alone."""
    o = table(spark, d, "orders")
    first = o.groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.min("o_orderkey").alias("k"))
    state, third = F.concat(F.lit("s"), F.col("c_custkey").cast("string")), F.col("c_custkey") % 3
    c = table(spark, d, "customer").select("c_custkey").join(first, "c_custkey", "left")
    asked = c.select(F.col("c_custkey").alias("id"), F.when(third == 0, F.coalesce(F.col("k").cast("string"), F.lit("0"))).when(third == 1, state).alias("first"), F.when(third == 1, "1996").otherwise(state).alias("second"))
    events = o.select(F.col("o_orderkey").alias("event"), F.concat(F.lit("s"), F.col("o_custkey").cast("string")).alias("state"), F.col("o_orderkey").alias("number"), F.year("o_orderdate").alias("year"), F.col("o_orderdate").alias("date"))
    return search.resolve_events(asked, events)


@query("v9_share_tolerance", BASE + "SELECT CAST(edition AS VARCHAR) || ':' || CAST(seat AS VARCHAR) AS code FROM win WHERE NOT (abs(share - (share + (seat % 3) * 1e-6)) <= greatest(1e-9 * greatest(abs(share), abs(share + (seat % 3) * 1e-6)), 1.5e-6))")
def v9(spark, d):
    from hustings.functions.numbers import approx_equal

    stated = F.col("share") + (F.col("seat") % 3) * 1e-6
    return rules.check(roles.results(spark, d), "V9", approx_equal(F.col("share"), stated, 1.5e-6), "share differs", F.concat_ws(":", *KEYS), severity="warning").select("code")


@query("v12_detail_equals_headline", BASE + "SELECT 'x' AS code WHERE (SELECT sum(votes) FROM cand) <> (SELECT sum(valid) FROM cont)")
def v12(spark, d):
    detail = roles.lines(spark, d).where("flag = 'N'").groupBy(*KEYS).agg(F.sum("q").alias("valid"))
    return rules.cross_source(detail, roles.contests(spark, d).where("valid > 0").select(*KEYS, "valid"), KEYS, ["valid"]).select("code")


@query("v16_parent_child", "SELECT CAST(n_nationkey AS VARCHAR) AS code FROM nation WHERE n_nationkey % 5 <> n_regionkey")
def v16(spark, d):
    n = table(spark, d, "nation")
    return rules.check(n, "V16", F.col("n_nationkey") % 5 == F.col("n_regionkey"), "another parent", F.col("n_nationkey")).select("code")


@query("v19_geometry_sanity", "SELECT CAST(vec_id AS VARCHAR) AS code FROM embeddings WHERE list_max(embedding) > 0.3")
def v19(spark, d):
    rings = table(spark, d, "embeddings").select("vec_id", geometry.ring(F.col("embedding")).alias("ring"))
    b = geometry.bounds(F.col("ring"))
    inside = (F.size("ring") >= 4) & (b["max_x"] <= F.lit(0.3).cast("float")) & (b["max_y"] <= F.lit(0.3).cast("float"))
    return rules.check(rings, "V19", inside, "outside its bounds", F.col("vec_id")).select("code")


@query("w2_rank_by_source_order", BASE + "SELECT edition, seat, candidate, CAST(row_number() OVER (PARTITION BY edition, seat ORDER BY votes DESC, candidate DESC) AS INTEGER) AS position FROM cand")
def w2(spark, d):
    return contest.rank_candidates(roles.candidacies(spark, d), KEYS, tie_break=[F.desc("candidate")]).select(*KEYS, "candidate", "position")


@query("o3_chosen_sort", BASE + "SELECT edition, seat, CAST(row_number() OVER (PARTITION BY edition ORDER BY coalesce(CASE WHEN seat % 7 = 0 THEN NULL ELSE margin END, -1) DESC, seat) AS INTEGER) AS place FROM win")
def o3(spark, d):
    value = F.coalesce(F.when(F.col("seat") % 7 != 0, F.col("margin")), F.lit(-1))
    return roles.results(spark, d).select(*KEYS, F.row_number().over(Window.partitionBy("edition").orderBy(F.desc(value), "seat")).alias("place"))
