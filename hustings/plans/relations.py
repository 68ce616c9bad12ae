"""Queries on joins, sets, overlays, rules, search and telemetry."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from hustings.functions import geometry, numbers, text
from hustings.operators import compare, editorial, match, overlay, rollup, rules, search
from hustings.plans import roles
from hustings.plans.roles import BASE, KEYS, Registry
from hustings.sources.readers import table, unify
from hustings.streaming import telemetry

registry = Registry()
query = registry.query

AS_OF = "2024-01-15"


# Scans, projections and filters


@query("s4_parquet_scan", "SELECT o_orderpriority, count(*) AS n, CAST(sum(o_custkey) AS BIGINT) AS keys FROM orders GROUP BY o_orderpriority")
def s4(spark, d):
    return table(spark, d, "orders").groupBy("o_orderpriority").agg(F.count("*").alias("n"), F.sum("o_custkey").alias("keys"))


@query("s16_unified_sources", "SELECT kind, count(*) AS n, CAST(count(balance) AS BIGINT) AS with_balance, count(priority) AS with_priority FROM (SELECT 'customer' AS kind, c_acctbal AS balance, NULL AS priority FROM customer UNION ALL SELECT 'supplier', s_acctbal, NULL FROM supplier UNION ALL SELECT 'order', NULL, o_orderpriority FROM orders) GROUP BY kind")
def s16(spark, d):
    parts = [
        table(spark, d, "customer").select(F.lit("customer").alias("kind"), F.col("c_acctbal").alias("balance")),
        table(spark, d, "supplier").select(F.lit("supplier").alias("kind"), F.col("s_acctbal").alias("balance")),
        table(spark, d, "orders").select(F.lit("order").alias("kind"), F.col("o_orderpriority").alias("priority")),
    ]
    return unify(parts).groupBy("kind").agg(F.count("*").alias("n"), F.count("balance").alias("with_balance"), F.count("priority").alias("with_priority"))


@query("p1_conjunctive_filter", "SELECT l_orderkey, l_linenumber, CAST(l_quantity AS BIGINT) AS q FROM lineitem WHERE year(l_shipdate) = 1998 AND l_returnflag = 'R' AND l_linestatus = 'F'")
def p1(spark, d):
    keep = (F.year("l_shipdate") == 1998) & (F.col("l_returnflag") == "R") & (F.col("l_linestatus") == "F")
    return table(spark, d, "lineitem").where(keep).select("l_orderkey", "l_linenumber", F.col("l_quantity").cast("bigint").alias("q"))


@query("p3_optional_filter", "SELECT c_mktsegment, count(*) AS n FROM customer WHERE c_nationkey = 7 GROUP BY c_mktsegment")
def p3(spark, d):
    held = search.chosen(search.chosen(table(spark, d, "customer"), "c_mktsegment", "ALL"), "c_nationkey", 7)
    return held.groupBy("c_mktsegment").agg(F.count("*").alias("n"))


@query("p4_contains_search", "SELECT p_partkey, p_name, p_brand FROM part WHERE contains(strip_accents(lower(p_name)), 'ring') OR contains(strip_accents(lower(p_brand)), 'ring')")
def p4(spark, d):
    return search.contains_any(table(spark, d, "part"), ["p_name", "p_brand"], " RING ", fold=text.lower_marks).select("p_partkey", "p_name", "p_brand")


@query("p5_typeahead", "SELECT DISTINCT p_name FROM part WHERE p_name IS NOT NULL AND p_name <> '' AND contains(lower(p_name), 're') ORDER BY p_name LIMIT 60")
def p5(spark, d):
    return search.options(table(spark, d, "part"), "p_name", "re")


@query("p6_date_predicate", f"SELECT count(*) AS n, CAST(max(CAST(ts AS DATE)) AS DATE) AS latest FROM events WHERE CAST(ts AS DATE) <= DATE '{AS_OF}'")
def p6(spark, d):
    return table(spark, d, "events").where(F.to_date("ts") <= F.lit(AS_OF).cast("date")).agg(F.count("*").alias("n"), F.max(F.to_date("ts")).alias("latest"))


@query("p13_label_derivation", "SELECT c_custkey, CASE WHEN c_acctbal < 0 THEN c_mktsegment || ' (overdrawn)' ELSE c_mktsegment END AS label FROM customer")
def p13(spark, d):
    return table(spark, d, "customer").select("c_custkey", F.when(F.col("c_acctbal") < 0, F.concat("c_mktsegment", F.lit(" (overdrawn)"))).otherwise(F.col("c_mktsegment")).alias("label"))


@query("p14_status_classes", "SELECT CASE WHEN o_orderstatus = 'F' THEN 'winner' WHEN o_orderstatus = 'P' THEN 'lost-deposit' ELSE 'runner-up' END AS status, count(*) AS n FROM orders GROUP BY 1")
def p14(spark, d):
    status = F.when(F.col("o_orderstatus").isin("F"), "winner").when(F.col("o_orderstatus").isin("P"), "lost-deposit").otherwise("runner-up")
    return table(spark, d, "orders").groupBy(status.alias("status")).agg(F.count("*").alias("n"))


@query("p16_enum_mapping", "SELECT CASE o_orderpriority WHEN '1-URGENT' THEN 'urgent' WHEN '2-HIGH' THEN 'high' ELSE 'other' END AS level, count(*) AS n FROM orders GROUP BY 1")
def p16(spark, d):
    known = F.create_map(F.lit("1-URGENT"), F.lit("urgent"), F.lit("2-HIGH"), F.lit("high"))
    return table(spark, d, "orders").groupBy(F.coalesce(F.try_element_at(known, F.col("o_orderpriority")), F.lit("other")).alias("level")).agg(F.count("*").alias("n"))


@query("p22_default_catalogue", "SELECT DISTINCT 'party-' || lower(p_type) AS id, p_type AS name, true AS active FROM part UNION ALL SELECT 'party-others', 'OTHERS', true")
def p22(spark, d):
    found = table(spark, d, "part").select("p_type").distinct().select(text.catalogue_id("party", F.col("p_type")).alias("id"), F.col("p_type").alias("name"))
    return found.unionByName(spark.createDataFrame([("party-others", "OTHERS")], "id string, name string")).withColumn("active", F.lit(True))


@query("p24_blank_to_default", "SELECT coalesce(nullif(trim(CASE WHEN c_custkey % 5 = 0 THEN '  ' ELSE c_mktsegment END), ''), 'NOT STATED') AS segment, count(*) AS n FROM customer GROUP BY 1")
def p24(spark, d):
    blank = F.when(F.col("c_custkey") % 5 == 0, "  ").otherwise(F.col("c_mktsegment"))
    return table(spark, d, "customer").groupBy(F.coalesce(F.nullif(F.trim(blank), F.lit("")), F.lit("NOT STATED")).alias("segment")).agg(F.count("*").alias("n"))


# Joins


@query("j1_one_to_one", "SELECT s_suppkey AS seat, s_name, n FROM supplier JOIN (SELECT l_suppkey, count(*) AS n FROM lineitem GROUP BY l_suppkey) ON s_suppkey = l_suppkey")
def j1(spark, d):
    n = table(spark, d, "lineitem").groupBy(F.col("l_suppkey").alias("seat")).agg(F.count("*").alias("n"))
    return table(spark, d, "supplier").select(F.col("s_suppkey").alias("seat"), "s_name").join(n, "seat")


@query("j3_optional_lookup", "SELECT c_custkey, coalesce(n, 0) AS orders, n IS NOT NULL AS has_orders FROM customer LEFT JOIN (SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey) ON c_custkey = o_custkey")
def j3(spark, d):
    n = table(spark, d, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("*").alias("n"))
    return table(spark, d, "customer").select("c_custkey").join(n, "c_custkey", "left").select("c_custkey", F.coalesce("n", F.lit(0)).alias("orders"), F.col("n").isNotNull().alias("has_orders"))


@query("j4_composite_key", BASE + "SELECT edition, seat, stream, a.q AS valid, b.q AS rejected FROM (SELECT edition, seat, stream, CAST(sum(q) AS BIGINT) AS q FROM lines WHERE flag = 'N' GROUP BY ALL) a JOIN (SELECT edition, seat, stream, CAST(sum(q) AS BIGINT) AS q FROM lines WHERE flag = 'R' GROUP BY ALL) b USING (edition, seat, stream)")
def j4(spark, d):
    rows = roles.lines(spark, d)
    by = lambda flag, name: rows.where(F.col("flag") == flag).groupBy(*KEYS, "stream").agg(F.sum("q").alias(name))
    return by("N", "valid").join(by("R", "rejected"), [*KEYS, "stream"])


@query("j6_fallback_key", "SELECT c_custkey, CASE WHEN c_custkey % 4 <> 0 THEN c_nationkey ELSE r END AS nation FROM customer JOIN (SELECT c_mktsegment AS seg, max(c_nationkey) AS r FROM customer GROUP BY 1) ON seg = c_mktsegment")
def j6(spark, d):
    c = table(spark, d, "customer")
    resolved = c.groupBy("c_mktsegment").agg(F.max("c_nationkey").alias("resolved"))
    own = F.when(F.col("c_custkey") % 4 != 0, F.col("c_nationkey"))
    return c.join(F.broadcast(resolved), "c_mktsegment").select("c_custkey", F.coalesce(own, "resolved").alias("nation"))  # five segments


@query("j7_anti", "SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)")
def j7(spark, d):
    return table(spark, d, "customer").select("c_custkey").join(table(spark, d, "orders").select(F.col("o_custkey").alias("c_custkey")), "c_custkey", "left_anti")


@query("j8_semi", "SELECT c_custkey FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT')")
def j8(spark, d):
    urgent = table(spark, d, "orders").where("o_orderpriority = '1-URGENT'").select(F.col("o_custkey").alias("c_custkey"))
    return table(spark, d, "customer").select("c_custkey").join(urgent, "c_custkey", "left_semi")


@query("j9_array_semi", BASE + "SELECT edition, seat FROM cand GROUP BY edition, seat HAVING bool_or(ticket = 'A3')")
def j9(spark, d):
    lists = roles.candidacies(spark, d).groupBy(*KEYS).agg(F.collect_set("ticket").alias("tickets"))
    return lists.where(F.array_contains("tickets", "A3")).select(*KEYS)


@query("j10_full_outer_coverage", "SELECT coalesce(a.k, b.k) AS k, a.k IS NOT NULL AS official, b.k IS NOT NULL AS project FROM (SELECT DISTINCT o_custkey AS k FROM orders WHERE o_orderkey % 2 = 0) a FULL JOIN (SELECT DISTINCT o_custkey AS k FROM orders WHERE o_orderkey % 2 = 1) b ON a.k = b.k")
def j10(spark, d):
    keys = lambda odd, name: table(spark, d, "orders").where(F.col("o_orderkey") % 2 == odd).select(F.col("o_custkey").alias("k")).distinct().withColumn(name, F.lit(True))
    both = keys(0, "official").join(keys(1, "project"), "k", "full")
    return both.select("k", F.coalesce("official", F.lit(False)).alias("official"), F.coalesce("project", F.lit(False)).alias("project"))


_LATEST = f"(SELECT user_id, event_type AS status, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY CAST(ts AS DATE) DESC, ts DESC, event_id DESC) AS p FROM events WHERE CAST(ts AS DATE) <= DATE '{AS_OF}') WHERE p = 1)"


@query("j12_as_of", f"SELECT c_custkey AS user_id, status FROM customer LEFT JOIN {_LATEST} ON user_id = c_custkey")
def j12(spark, d):
    people = table(spark, d, "customer").select(F.col("c_custkey").alias("user_id"))
    return overlay.as_of_join(people, roles.status_events(spark, d), ["user_id"], ["status"], F.lit(AS_OF).cast("date"))


@query("w8_latest_per_key", f"SELECT user_id, status, event_id AS ordinal FROM {_LATEST}")
def w8(spark, d):
    held = roles.status_events(spark, d).withColumn("event", F.col("ordinal"))
    return overlay.latest(held, ["user_id"], ["status", "event"], F.lit(AS_OF).cast("date")).withColumnRenamed("event", "ordinal")


@query("j13_as_of_fallback", f"WITH one AS (SELECT user_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY CAST(ts AS DATE) DESC, ts DESC, event_id DESC) AS p FROM events WHERE event_type = 'purchase' AND CAST(ts AS DATE) <= DATE '{AS_OF}') WHERE p = 1), two AS (SELECT grp, event_type FROM (SELECT *, user_id % 10 AS grp, row_number() OVER (PARTITION BY user_id % 10 ORDER BY CAST(ts AS DATE) DESC, ts DESC, event_id DESC) AS p FROM events WHERE event_type <> 'purchase' AND CAST(ts AS DATE) <= DATE '{AS_OF}') WHERE p = 1) SELECT c_custkey AS person, c_custkey % 10 AS seat, coalesce(one.event_type, two.event_type) AS status FROM customer LEFT JOIN one ON one.user_id = c_custkey LEFT JOIN two ON two.grp = c_custkey % 10")
def j13(spark, d):
    e = roles.status_events(spark, d)
    own = F.col("status") == "purchase"
    events = e.withColumn("person", F.when(own, F.col("user_id"))).withColumn("seat", F.when(~own, F.col("user_id") % 10))
    people = table(spark, d, "customer").select(F.col("c_custkey").alias("person"), (F.col("c_custkey") % 10).alias("seat"))
    return overlay.as_of_with_fallback(people, events, "person", "seat", ["status"], F.lit(AS_OF).cast("date"))


@query("j15_alias_resolution", "SELECT o_orderkey, CASE WHEN o_orderstatus IN ('F', 'P') THEN 'DONE' ELSE o_orderstatus END AS name FROM orders")
def j15(spark, d):
    catalogue = spark.createDataFrame([("F", "FINISHED", ["P"], 1), ("F", "DONE", ["P"], 2)], "source_name string, name string, aliases array<string>, ordinal int")
    return overlay.resolve_aliases(table(spark, d, "orders").select("o_orderkey", F.col("o_orderstatus").alias("name")), "name", catalogue)


@query("j17_key_merge", "SELECT s_suppkey AS k, CASE WHEN s_suppkey % 3 = 0 THEN 'override' ELSE s_name END AS name FROM supplier")
def j17(spark, d):
    base = table(spark, d, "supplier").select(F.col("s_suppkey").alias("k"), F.col("s_name").alias("name"))
    return overlay.merge_by_key(base, base.where("k % 3 = 0").withColumn("name", F.lit("override")), ["k"])


@query("j22_pairs_in_range", "SELECT a.g AS grp, a.id, b.id AS below FROM (SELECT o_custkey % 50 AS g, o_orderkey AS id, CAST(o_orderkey % 97 AS DOUBLE) AS top, CAST(o_orderkey % 31 AS DOUBLE) AS cx FROM orders) a JOIN (SELECT o_custkey % 50 AS g, o_orderkey AS id, CAST(o_orderkey % 97 AS DOUBLE) AS top, CAST(o_orderkey % 31 AS DOUBLE) AS cx FROM orders) b ON a.g = b.g AND b.top - a.top BETWEEN 4.3 AND 5.0 AND abs(b.cx - a.cx) <= 6")
def j22(spark, d):
    points = table(spark, d, "orders").select((F.col("o_custkey") % 50).alias("grp"), F.col("o_orderkey").alias("id"), (F.col("o_orderkey") % 97).cast("double").alias("top"), (F.col("o_orderkey") % 31).cast("double").alias("cx"))
    return match.pairs_in_range(points, "grp", 4.3, 5.0, 6)


@query("j23_nearest_in_cone", "WITH p AS (SELECT label AS grp, vec_id AS id, CAST(embedding[1] AS DOUBLE) AS x, CAST(embedding[2] AS DOUBLE) AS y FROM embeddings), pairs AS (SELECT a.grp, a.id, b.id AS neighbour, sqrt((b.x - a.x) * (b.x - a.x) + (b.y - a.y) * (b.y - a.y)) AS r, b.x - a.x AS dx FROM p a JOIN p b ON a.grp = b.grp AND a.id <> b.id) SELECT grp, id, neighbour FROM (SELECT *, row_number() OVER (PARTITION BY grp, id ORDER BY r / greatest(0.08, pow(dx / r, 3)), neighbour) AS place FROM pairs WHERE r > 0 AND dx / r > 0.18) WHERE place = 1")
def j23(spark, d):
    points = table(spark, d, "embeddings").select(F.col("label").alias("grp"), F.col("vec_id").alias("id"), F.col("embedding")[0].cast("double").alias("x"), F.col("embedding")[1].cast("double").alias("y"))
    return match.nearest_in_direction(points, "grp", 1, 0)


@query("j29_precedence_union", "SELECT o_custkey AS k, 'orders' AS source FROM orders GROUP BY o_custkey UNION ALL SELECT c_custkey, 'customer' FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)")
def j29(spark, d):
    primary = table(spark, d, "orders").select(F.col("o_custkey").alias("k"), F.lit("orders").alias("source")).distinct()
    return overlay.precedence_union(primary, table(spark, d, "customer").select(F.col("c_custkey").alias("k"), F.lit("customer").alias("source")), ["k"])


@query("j32_directory_join", "SELECT c_custkey, n_name, r_name FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey")
def j32(spark, d):
    n = table(spark, d, "nation").join(table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return table(spark, d, "customer").join(F.broadcast(n), F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey", "n_name", "r_name")  # 25 nations


# Windows over logs


@query("w10_duplicates", "SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY l_orderkey, l_linenumber HAVING count(*) > 1")
def w10(spark, d):
    return table(spark, d, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.count("*").alias("n")).where("n > 1")


def _log(spark, d):
    return table(spark, d, "events").select("user_id", "event_id", "event_type", "ts")


@query("w15_carry_forward", "SELECT event_id, last_value(CASE WHEN event_type = 'signup' THEN event_id END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS carried FROM events")
def w15(spark, d):
    marked = _log(spark, d).withColumn("heading", F.when(F.col("event_type") == "signup", F.col("event_id")))
    return compare.carry_forward(marked, ["user_id"], "event_id", "heading").select("event_id", "carried")


@query("w16_blocks", "SELECT event_id, CAST(sum(CASE WHEN event_type = 'purchase' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) AS block FROM events")
def w16(spark, d):
    marked = _log(spark, d).withColumn("header", F.col("event_type") == "purchase")
    return compare.blocks(marked, ["user_id"], "event_id", "header").select("event_id", "block")


@query("w17_gap_segments", "SELECT event_id, CAST(sum(n) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) AS segment FROM (SELECT user_id, event_id, CASE WHEN event_id - lag(event_id) OVER (PARTITION BY user_id ORDER BY event_id) > 100 THEN 1 ELSE 0 END AS n FROM events)")
def w17(spark, d):
    return compare.gap_segments(_log(spark, d), ["user_id"], "event_id", 100).select("event_id", "segment")


@query("w18_consecutive_repeats", "SELECT event_id FROM (SELECT event_id, event_type, lag(event_type) OVER (PARTITION BY user_id ORDER BY event_id) AS b FROM events) WHERE b IS NULL OR b <> event_type")
def w18(spark, d):
    return compare.without_repeats(_log(spark, d), ["user_id"], "event_id", "event_type").select("event_id")


# Sets, sorts and pages


@query("u1_bag_union", "SELECT k, count(*) AS n FROM (SELECT l_suppkey AS k FROM lineitem UNION ALL SELECT s_suppkey FROM supplier) GROUP BY k")
def u1(spark, d):
    a = table(spark, d, "lineitem").select(F.col("l_suppkey").alias("k"))
    return a.unionByName(table(spark, d, "supplier").select(F.col("s_suppkey").alias("k"))).groupBy("k").agg(F.count("*").alias("n"))


def _keys(spark, d, rest):
    return table(spark, d, "orders").where(F.col("o_orderkey") % 3 == rest).select(F.col("o_custkey").alias("k"))


@query("u3_difference", "SELECT o_custkey AS k FROM orders WHERE o_orderkey % 3 = 0 EXCEPT SELECT o_custkey FROM orders WHERE o_orderkey % 3 = 1")
def u3(spark, d):
    return _keys(spark, d, 0).subtract(_keys(spark, d, 1))


@query("u4_intersection", "SELECT o_custkey AS k FROM orders WHERE o_orderkey % 3 = 0 INTERSECT SELECT o_custkey FROM orders WHERE o_orderkey % 3 = 1")
def u4(spark, d):
    return _keys(spark, d, 0).intersect(_keys(spark, d, 1))


@query("u2_set_equality", "SELECT (SELECT count(*) FROM (SELECT o_custkey FROM orders WHERE o_orderkey % 3 = 0 EXCEPT SELECT o_custkey FROM orders WHERE o_orderkey % 3 = 1)) AS missing, (SELECT count(*) FROM (SELECT o_custkey FROM orders WHERE o_orderkey % 3 = 1 EXCEPT SELECT o_custkey FROM orders WHERE o_orderkey % 3 = 0)) AS extra")
def u2(spark, d):
    a, b = _keys(spark, d, 0).distinct(), _keys(spark, d, 1).distinct()
    sides = a.join(b, "k", "left_anti").select(F.lit("missing").alias("s")).unionByName(b.join(a, "k", "left_anti").select(F.lit("extra").alias("s")))
    return sides.agg(F.count_if(F.col("s") == "missing").alias("missing"), F.count_if(F.col("s") == "extra").alias("extra"))


@query("u5_partition_test", "SELECT count(*) = count(DISTINCT o_orderkey) AND count(*) = (SELECT count(*) FROM orders) AS holds FROM (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F' UNION ALL SELECT o_orderkey FROM orders WHERE o_orderstatus <> 'F')")
def u5(spark, d):
    o = table(spark, d, "orders").select("o_orderkey", "o_orderstatus")
    parts = o.where("o_orderstatus = 'F'").unionByName(o.where("o_orderstatus <> 'F'"))
    one = parts.agg(F.count("*").alias("n"), F.count_distinct("o_orderkey").alias("m"))
    return one.crossJoin(F.broadcast(o.agg(F.count("*").alias("all")))).select(((F.col("n") == F.col("m")) & (F.col("n") == F.col("all"))).alias("holds"))  # one row


@query("u6_union_first_wins", "SELECT name, min(k) AS k FROM (SELECT c_mktsegment AS name, c_custkey AS k FROM customer UNION ALL SELECT p_type, p_partkey FROM part) GROUP BY name")
def u6(spark, d):
    a = table(spark, d, "customer").select(F.col("c_mktsegment").alias("name"), F.col("c_custkey").alias("k"))
    return a.unionByName(table(spark, d, "part").select(F.col("p_type").alias("name"), F.col("p_partkey").alias("k"))).groupBy("name").agg(F.min("k").alias("k"))


@query("u8_row_signature_dedupe", "SELECT DISTINCT l_suppkey, l_returnflag, l_linestatus, l_linenumber FROM lineitem")
def u8(spark, d):
    return table(spark, d, "lineitem").select("l_suppkey", "l_returnflag", "l_linestatus", "l_linenumber").dropDuplicates()


@query("o1_sort_by_code_number", "SELECT name, n, CAST(row_number() OVER (ORDER BY n) AS INTEGER) AS place FROM (SELECT DISTINCT p_brand AS name, CAST(regexp_extract(p_brand, '[0-9]+') AS INTEGER) AS n FROM part)")
def o1(spark, d):
    names = table(spark, d, "part").select(F.col("p_brand").alias("name")).distinct().withColumn("n", F.regexp_extract("name", "[0-9]+", 0).cast("int"))
    return names.withColumn("place", F.row_number().over(Window.orderBy("n")))  # 25 brands


@query("o6_page", "SELECT o_orderkey FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 24 OFFSET 24")
def o6(spark, d):
    return search.page(table(spark, d, "orders").select("o_orderkey", "o_totalprice"), [F.desc("o_totalprice"), "o_orderkey"], 1, 24).select("o_orderkey")


@query("o8_reverse_history", "SELECT event_id FROM events ORDER BY CAST(ts AS DATE) DESC, ts DESC LIMIT 100")
def o8(spark, d):
    return table(spark, d, "events").orderBy(F.desc(F.to_date("ts")), F.desc("ts")).limit(100).select("event_id")


@query("o9_option_lists", "SELECT DISTINCT c_mktsegment AS value FROM customer")
def o9(spark, d):
    return table(spark, d, "customer").select(F.col("c_mktsegment").alias("value")).distinct()


# Text, parsing, numbers, geometry


@query("f1f_canonical_name", "SELECT c_custkey, trim(regexp_replace(upper(trim(c_name || '  (' || c_mktsegment || ')')), '[^A-Z0-9]+', ' ', 'g')) AS name FROM customer")
def f1f(spark, d):
    whole = F.concat("c_name", F.lit("  ("), "c_mktsegment", F.lit(")"))
    return table(spark, d, "customer").select("c_custkey", text.canonical_name(whole).alias("name"))


@query("f1_normalise_family")
def f1(spark, d):
    t = F.col("text")
    return table(spark, d, "documents").select("doc_id", text.upper_with_spaces(t).alias("upper"), text.lower_no_spaces(t).alias("packed"), text.slug(t).alias("slug"), text.lower_marks(t).alias("marks"))


@query("f2c_state_ids", "SELECT n_name, regexp_replace(regexp_replace(replace(lower(n_name), 'w.p', 'wp'), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g') AS id FROM nation")
def f2c(spark, d):
    return table(spark, d, "nation").select("n_name", text.state_id(F.col("n_name")).alias("id"))


@query("f4_collapse_spaces", "SELECT doc_id, trim(regexp_replace(text, '\\s+', ' ', 'g')) AS text FROM documents")
def f4(spark, d):
    return table(spark, d, "documents").select("doc_id", text.collapse_spaces(F.col("text")).alias("text"))


@query("f7_clean_path", "SELECT page_id, substring(coalesce(nullif(regexp_extract(regexp_replace(url, '^[a-z]+://[^/]*', ''), '^[^?#]*'), ''), '/'), 1, 180) AS path FROM pages")
def f7(spark, d):
    return table(spark, d, "pages").select("page_id", text.clean_path(F.col("url")).alias("path"))


@query("f9_hue", "SELECT DISTINCT p_name, list_reduce(list_prepend(CAST(0 AS BIGINT), list_transform(string_split(p_name, ''), lambda c: CAST(ascii(c) AS BIGINT))), lambda h, c: (h * 31 + c) % 4294967296) % 360 AS hue FROM part")
def f9(spark, d):
    return table(spark, d, "part").select("p_name").distinct().select("p_name", text.hue(F.col("p_name")).alias("hue"))


@query("r1_extract_code", "SELECT c_custkey, nullif(regexp_extract(label, '^(P\\.[0-9]{3})', 1), '') AS code FROM (SELECT c_custkey, CASE WHEN c_custkey % 7 = 0 THEN 'none' ELSE 'P.' || lpad(CAST(c_custkey % 1000 AS VARCHAR), 3, '0') || ' SEAT' END AS label FROM customer)")
def r1(spark, d):
    label = F.when(F.col("c_custkey") % 7 == 0, "none").otherwise(F.concat(F.lit("P."), F.lpad((F.col("c_custkey") % 1000).cast("string"), 3, "0"), F.lit(" SEAT")))
    return table(spark, d, "customer").select("c_custkey", text.code(label).alias("code"))


@query("r5d_digits", "SELECT c_custkey, CAST(regexp_replace(c_name, '[^0-9]', '', 'g') AS BIGINT) AS n FROM customer")
def r5d(spark, d):
    return table(spark, d, "customer").select("c_custkey", numbers.integer_digits(F.col("c_name")).alias("n"))


@query("r5e_first_number", "SELECT event_id, CAST(regexp_extract(props, '[0-9]+') AS BIGINT) AS n FROM events")
def r5e(spark, d):
    return table(spark, d, "events").select("event_id", numbers.first_number(F.col("props")).alias("n"))


@query("r9_html_links", "SELECT page_id, CAST(len(regexp_extract_all(html, '<li><a ')) AS INTEGER) AS links FROM pages")
def r9(spark, d):
    return table(spark, d, "pages").select("page_id", F.size(F.regexp_extract_all("html", F.lit("<li><a "), 0)).alias("links"))


@query("r9_html_cells", "SELECT page_id, 'u' || page_id AS name, CASE WHEN page_id % 2 = 0 THEN CAST(page_id * 3 AS VARCHAR) END AS area FROM pages")
def r9_cells(spark, d):
    """Pages behind a table of key and value cells, with tags in them; of a repeated key the last value counts."""
    k = F.col("page_id")
    cell = lambda key, value: F.concat(F.lit(f"<tr><td class='k'>{key}</td> <td><b>"), value, F.lit("</b></td></tr>"))
    html = F.concat(F.lit("<TABLE>"), cell("NAME", F.lit("old")), F.when(k % 2 == 0, cell("AREA", k * 3)).otherwise(""), cell("NAME", F.concat(F.lit("u"), k)), F.lit("</TABLE>"))
    found = table(spark, d, "pages").select("page_id", text.cells(html).alias("cells"))
    return found.select("page_id", F.try_element_at("cells", F.lit("NAME")).alias("name"), F.try_element_at("cells", F.lit("AREA")).alias("area"))


@query("r12_typed_json", "SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events")
def r12(spark, d):
    return table(spark, d, "events").select("event_id", F.from_json("props", "k bigint")["k"].alias("k"))


@query("n2_approx_equal", "SELECT o_orderkey, abs(a - b) <= greatest(1e-9 * greatest(abs(a), abs(b)), 2e-6) AS near FROM (SELECT o_orderkey, o_totalprice AS a, o_totalprice + (o_orderkey % 3) * 1e-6 AS b FROM orders)")
def n2(spark, d):
    b = F.col("o_totalprice") + (F.col("o_orderkey") % 3) * 1e-6
    return table(spark, d, "orders").select("o_orderkey", numbers.approx_equal(F.col("o_totalprice"), b).alias("near"))


@query("n11_ordered_unique", "SELECT c_custkey, c_mktsegment || '-' || CAST(c_nationkey AS VARCHAR) AS label FROM customer")
def n11(spark, d):
    parts = F.array_distinct(F.array("c_mktsegment", "c_mktsegment", F.col("c_nationkey").cast("string"), F.col("c_nationkey").cast("string")))
    return table(spark, d, "customer").select("c_custkey", F.array_join(parts, "-").alias("label"))


@query("n13_sha256", "SELECT page_id, sha256(html) AS digest FROM pages")
def n13(spark, d):
    return table(spark, d, "pages").select("page_id", F.sha2("html", 256).alias("digest"))


def _rings(spark, d):
    return table(spark, d, "embeddings").select("vec_id", geometry.ring(F.col("embedding")).alias("ring"))


_EDGES = "WITH p AS (SELECT vec_id, i, CAST(embedding[2 * i + 1] AS DOUBLE) AS x, CAST(embedding[2 * i + 2] AS DOUBLE) AS y FROM embeddings, range(32) r(i)), e AS (SELECT a.vec_id, a.x AS ax, a.y AS ay, b.x AS bx, b.y AS by_ FROM p a JOIN p b ON b.vec_id = a.vec_id AND b.i = (a.i + 1) % 32)"


@query("g1_signed_area", _EDGES + " SELECT vec_id, CAST(round(sum(ax * by_ - bx * ay) / 2 * 1e6) AS BIGINT) AS area_millionths FROM e GROUP BY vec_id")
def g1(spark, d):
    return _rings(spark, d).select("vec_id", F.round(geometry.signed_area(F.col("ring")) * 1e6).cast("bigint").alias("area_millionths"))


@query("g2_orientation", _EDGES + " SELECT vec_id, sum(ax * by_ - bx * ay) > 0 AS turned FROM e GROUP BY vec_id")
def g2(spark, d):
    turned = _rings(spark, d).withColumn("outer", geometry.oriented(F.col("ring")))
    return turned.select("vec_id", (F.col("outer") != F.col("ring")).alias("turned"))


@query("g4_centroids")
def g4(spark, d):
    return _rings(spark, d).select("vec_id", geometry.centroid(F.col("ring")).alias("c")).select("vec_id", "c.x", "c.y")


@query("g7_bounds", "WITH p AS (SELECT vec_id, i, CAST(embedding[2 * i + 1] AS DOUBLE) AS x, CAST(embedding[2 * i + 2] AS DOUBLE) AS y FROM embeddings, range(32) r(i)) SELECT vec_id, min(x) AS min_x, min(y) AS min_y, max(x) AS max_x, max(y) AS max_y FROM p GROUP BY vec_id")
def g7(spark, d):
    return _rings(spark, d).select("vec_id", geometry.bounds(F.col("ring")).alias("b")).select("vec_id", "b.*")


@query("g10_simplified_rings")
def g10(spark, d):
    return _rings(spark, d).select("vec_id", F.size(geometry.simplified(F.col("ring"), 0.05)).alias("points"))


# Rules


@query("v2_duplicate_keys", "SELECT 'V2' AS rule_id, CAST(l_orderkey AS VARCHAR) || ':' || CAST(l_linenumber AS VARCHAR) AS code FROM lineitem GROUP BY l_orderkey, l_linenumber HAVING count(*) > 1")
def v2(spark, d):
    return rules.duplicate_keys(table(spark, d, "lineitem"), ["l_orderkey", "l_linenumber"]).select("rule_id", "code")


@query("v3_coverage", "SELECT CAST(c_custkey AS VARCHAR) AS code, 'missing key' AS message FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)")
def v3(spark, d):
    actual, expected = table(spark, d, "orders").select(F.col("o_custkey").alias("k")), table(spark, d, "customer").select(F.col("c_custkey").alias("k"))
    return rules.coverage(actual, expected, ["k"]).select("code", "message")


@query("v4_cardinality", "SELECT 'V4' AS rule_id, 'nation' AS code FROM nation HAVING count(*) <> 24")
def v4(spark, d):
    return rules.cardinality(table(spark, d, "nation"), "nation", 24).select("rule_id", "code")


@query("v5_v11_contest_rules", BASE + ", c AS (SELECT edition, seat, any_value(valid) AS valid, CAST(sum(votes) AS BIGINT) AS cv FROM cand JOIN cont USING (edition, seat) GROUP BY edition, seat) SELECT CAST(edition AS VARCHAR) || ':' || CAST(seat AS VARCHAR) AS code, 'V5' AS rule_id FROM c WHERE valid + (CASE WHEN seat = 1 THEN 1 ELSE 0 END) <> cv")
def v5(spark, d):
    sums = roles.candidacies(spark, d).groupBy(*KEYS).agg(F.sum("votes").alias("candidate_votes"))
    own = roles.contests(spark, d).join(sums, KEYS).withColumn("valid", F.col("valid") + (F.col("seat") == 1).cast("int")).withColumn("issued", F.col("issued") + (F.col("seat") == 1).cast("int"))
    return rules.contest_rules(own, F.concat_ws(":", "edition", "seat")).select("code", "rule_id")


@query("v13_cross_source", "SELECT CAST(s_suppkey AS VARCHAR) AS code, 'name' AS field FROM supplier WHERE s_suppkey % 4 = 0 AND s_suppkey % 8 <> 0")
def v13(spark, d):
    a = table(spark, d, "supplier").select(F.col("s_suppkey").alias("k"), F.col("s_name").alias("name"), F.col("s_nationkey").cast("string").alias("nation"))
    b = a.withColumn("name", F.when(F.col("k") % 4 == 0, "other").otherwise(F.col("name")))
    declared = a.where("k % 8 = 0").select("k", F.lit("name").alias("field"))
    return rules.cross_source(a, b, ["k"], ["name", "nation"], declared).select("code", F.col("details")["field"].alias("field"))


@query("v14_hierarchical_sums", "SELECT n_regionkey, count(*) AS customers FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY n_regionkey")
def v14(spark, d):
    n = table(spark, d, "customer").groupBy(F.col("c_nationkey").alias("n_nationkey")).agg(F.count("*").alias("customers"))
    return n.join(table(spark, d, "nation"), "n_nationkey").groupBy("n_regionkey").agg(F.sum("customers").alias("customers"))


@query("v15_partition_sums", "SELECT CAST(p_partkey AS VARCHAR) AS code FROM part WHERE p_size <> (p_size // 2) * 2")
def v15(spark, d):
    halves = table(spark, d, "part").withColumns({"a": F.floor(F.col("p_size") / 2), "b": F.floor(F.col("p_size") / 2)})
    return rules.parts_sum(halves, "p_size", ["a", "b"], F.col("p_partkey")).select("code")


@query("v17_orphans", "SELECT CAST(o_custkey AS VARCHAR) AS code FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_custkey % 2 = 0)")
def v17(spark, d):
    parents = table(spark, d, "customer").where("c_custkey % 2 = 0").select(F.col("c_custkey").alias("k"))
    return rules.orphans(table(spark, d, "orders").select(F.col("o_custkey").alias("k")), parents, ["k"]).select("code")


@query("v18_one_winner", BASE + "SELECT edition, seat, count(*) AS winners FROM ranked WHERE position = 1 GROUP BY edition, seat")
def v18(spark, d):
    return roles.ranked(spark, d).where("position = 1").groupBy(*KEYS).agg(F.count("*").alias("winners"))


@query("v21_run_status", "SELECT count(*) AS errors, CAST(0 AS BIGINT) AS warnings, CASE WHEN count(*) > 0 THEN 'failed' ELSE 'passed' END AS status FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)")
def v21(spark, d):
    actual, expected = table(spark, d, "orders").select(F.col("o_custkey").alias("k")), table(spark, d, "customer").select(F.col("c_custkey").alias("k"))
    return rules.run_status(rules.coverage(actual, expected, ["k"]))


@query("v22_stale", "SELECT count(*) AS differences FROM supplier WHERE s_suppkey % 10 = 0")
def v22(spark, d):
    now = table(spark, d, "supplier").select("s_suppkey", "s_name")
    old = now.withColumn("s_name", F.when(F.col("s_suppkey") % 10 == 0, "old").otherwise(F.col("s_name")))
    return rules.stale(old, now).where("side = 'published'").agg(F.count("*").alias("differences"))


# Overlays, publication, telemetry


@query("e1_seat_status", f"SELECT s_suppkey AS seat, CASE WHEN status = 'error' THEN 'VACANT' ELSE coalesce(status, s_name) END AS current_alliance, status IS NOT NULL AS is_changed FROM supplier LEFT JOIN {_LATEST} ON user_id = s_suppkey")
def e1(spark, d):
    status = F.when(F.col("status") == "error", "vacant").otherwise("changed")
    events = roles.status_events(spark, d).withColumns({"seat": F.col("user_id"), "alliance": F.col("status"), "party": F.col("status"), "status": status})
    seats = table(spark, d, "supplier").select(F.col("s_suppkey").alias("seat"), F.col("s_name").alias("winner_alliance"), F.col("s_name").alias("winner_party"))
    return overlay.seat_status(seats, events, F.lit(AS_OF).cast("date")).select("seat", "current_alliance", "is_changed")


@query("k6_upsert", "SELECT k, CASE WHEN m IS NOT NULL THEN m ELSE name END AS name FROM (SELECT s_suppkey AS k, s_name AS name FROM supplier) LEFT JOIN (SELECT user_id, max_by(event_type, event_id) AS m FROM events GROUP BY user_id) ON user_id = k")
def k6(spark, d):
    target = table(spark, d, "supplier").select(F.col("s_suppkey").alias("k"), F.col("s_name").alias("name"))
    changes = table(spark, d, "events").select(F.col("user_id").alias("k"), F.col("event_type").alias("name"), F.lpad(F.col("event_id").cast("string"), 12, "0").alias("at"))
    return overlay.upsert(target, changes.join(target.select("k"), "k", "left_semi"), ["k"], "at")


@query("e8_transitions", "SELECT CASE WHEN b = 'draft' AND a = 'reviewed' THEN actor <> author WHEN b = 'reviewed' AND a = 'draft' THEN true WHEN b = 'reviewed' AND a = 'published' THEN actor <> author WHEN b = 'published' AND a = 'superseded' THEN true ELSE false END AS ok, count(*) AS n FROM (SELECT ['draft', 'reviewed', 'published', 'superseded'][1 + o_orderkey % 4] AS b, ['draft', 'reviewed', 'published', 'superseded'][1 + o_custkey % 4] AS a, 'user' || CAST(o_orderkey % 5 AS VARCHAR) AS actor, 'user' || CAST(o_custkey % 5 AS VARCHAR) AS author FROM orders) GROUP BY 1")
def e8(spark, d):
    names = F.array(*(F.lit(x) for x in ("draft", "reviewed", "published", "superseded")))
    o = table(spark, d, "orders").select(F.get(names, F.col("o_orderkey") % 4).alias("b"), F.get(names, F.col("o_custkey") % 4).alias("a"), F.concat(F.lit("user"), (F.col("o_orderkey") % 5).cast("string")).alias("actor"), F.concat(F.lit("user"), (F.col("o_custkey") % 5).cast("string")).alias("author"))
    return o.groupBy(editorial.allowed(F.col("b"), F.col("a"), F.col("actor"), F.col("author")).alias("ok")).agg(F.count("*").alias("n"))


@query("e10_read_model", "SELECT CAST(o_custkey AS VARCHAR) AS key, max(o_orderkey) AS revision FROM orders WHERE o_orderstatus = 'F' GROUP BY o_custkey")
def e10(spark, d):
    status = F.when(F.col("o_orderstatus") == "F", "published").otherwise("draft")
    return editorial.read_model(table(spark, d, "orders").select(F.col("o_custkey").cast("string").alias("key"), F.col("o_orderkey").alias("revision"), status.alias("status")))


@query("e16_drill_down", "SELECT n_name AS nation, count(*) AS registered FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey WHERE r_regionkey = 1 GROUP BY n_name")
def e16(spark, d):
    n = table(spark, d, "nation").join(table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    rows = table(spark, d, "customer").join(F.broadcast(n), F.col("c_nationkey") == F.col("n_nationkey")).select(F.col("r_regionkey").alias("region"), F.col("n_name").alias("nation"), F.lit(1).alias("registered"))  # 25 nations
    return search.drill(rollup.hierarchy(rows, ["region", "nation"], ["registered"]), ["region", "nation"], [1]).select("nation", "registered")


def _telemetry(spark, d):
    e = table(spark, d, "events")
    return e.select(F.lit("interaction").alias("kind"), F.col("event_type").alias("name"), F.col("value"), F.when(F.col("value") > 50, "poor").otherwise("good").alias("rating"), F.col("ts").cast("timestamp").alias("received_at"))


@query("a25_telemetry_rollup", "SELECT 'interaction' AS kind, event_type AS name, count(*) AS samples, count(*) FILTER (WHERE value > 50) AS poor FROM events WHERE ts >= (SELECT max(ts) FROM events) - INTERVAL 7 DAY GROUP BY event_type")
def a25(spark, d):
    rows = _telemetry(spark, d)
    edge = rows.agg((F.max("received_at") - F.expr("interval 7 days")).alias("edge"))
    return telemetry.rollup(rows.crossJoin(F.broadcast(edge)).where("received_at >= edge")).drop("average")  # one row


@query("a26_status_histogram", "SELECT event_type AS status, count(*) AS n FROM events GROUP BY event_type")
def a26(spark, d):
    return table(spark, d, "events").groupBy(F.col("event_type").alias("status")).agg(F.count("*").alias("n"))


@query("a28_person_registry", "SELECT user_id AS person, min_by(event_type, event_id) AS canonical, string_agg(DISTINCT event_type, ',' ORDER BY event_type) AS spellings FROM events GROUP BY user_id")
def a28(spark, d):
    folded = rollup.registry(table(spark, d, "events"), "user_id", "event_type", "event_type", "event_id")
    return folded.select(F.col("user_id").alias("person"), "canonical", F.array_join(F.array_sort(F.concat("aliases", F.array("canonical"))), ",").alias("spellings"))


@query("a30_histogram_with_default", "SELECT coalesce(nullif(trim(CASE WHEN doc_id % 3 = 0 THEN '' ELSE lang END), ''), 'NOT STATED') AS gender, count(*) AS n FROM documents GROUP BY 1")
def a30(spark, d):
    blank = F.when(F.col("doc_id") % 3 == 0, "").otherwise(F.col("lang"))
    return table(spark, d, "documents").groupBy(F.coalesce(F.nullif(F.trim(blank), F.lit("")), F.lit("NOT STATED")).alias("gender")).agg(F.count("*").alias("n"))


@query("a31_reconciliation_block", BASE + "SELECT (SELECT CAST(sum(votes) AS BIGINT) FROM cand) AS official, (SELECT CAST(sum(valid) AS BIGINT) FROM cont) AS published")
def a31(spark, d):
    sides = roles.candidacies(spark, d).select(F.col("votes").alias("official"), F.lit(0).cast("bigint").alias("published")).unionByName(roles.contests(spark, d).select(F.lit(0).cast("bigint").alias("official"), F.col("valid").alias("published")))
    return sides.agg(F.sum("official").alias("official"), F.sum("published").alias("published"))


@query("m1_event_validation", "SELECT ok, count(*) AS n FROM (SELECT event_type <> 'error' AS ok FROM events) GROUP BY ok")
def m1(spark, d):
    kind = F.when(F.col("event_type") == "error", "unknown").otherwise("interaction")
    rows = table(spark, d, "events").select(kind.alias("kind"), F.col("event_type").alias("name"), "value", F.lit("/").alias("path"), F.lit("").alias("message"))
    good, bad = telemetry.split(rows)
    return reduce(DataFrame.unionByName, [good.select(F.lit(True).alias("ok")), bad.select(F.lit(False).alias("ok"))]).groupBy("ok").agg(F.count("*").alias("n"))
