"""Queries on reconciliation with planted violations, on overlays in their order, publication, geometry and files."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from hustings.functions import geometry, labels, numbers
from hustings.operators import contest, editorial, joins, match, overlay, rollup, rules, search
from hustings.plans import roles
from hustings.plans.roles import BASE, KEYS, Registry
from hustings.sources import readers, writers
from hustings.sources.readers import table
from hustings.sources.scratch import folder

registry = Registry()
query = registry.query

AS_OF = "2024-01-15"
CODE = "CAST(edition AS VARCHAR) || ':' || CAST(seat AS VARCHAR)"


def _code():
    return F.concat_ws(":", *KEYS)


# Rules, each with rows that break it and rows that keep it


@query("v1_edition_identity", "SELECT 'pru-' || CAST(edition AS VARCHAR) AS code FROM (SELECT DISTINCT year(l_shipdate) AS edition FROM lineitem) WHERE edition % 3 = 0 OR edition > 1997")
def v1(spark, d):
    editions = table(spark, d, "lineitem").select(F.year("l_shipdate").alias("edition")).distinct()
    name = F.concat(F.lit("pru-"), F.col("edition").cast("string")).alias("id")
    datasets = editions.select(name, (F.col("edition") - 1990).alias("number"), F.lit("2018").alias("boundary"))
    known = editions.where("edition <= 1997").select(name, (F.col("edition") - 1990 + (F.col("edition") % 3 == 0).cast("int")).alias("number"), F.lit("2018").alias("boundary"))
    return rules.identity(datasets, known, "id", ["number", "boundary"]).select("code")


_BROKEN = {"V5": 23, "V6": 7, "V7": 11, "V8": 13, "V10": 17, "V11": 19}


@query("v5_to_v11_planted", BASE + " UNION ALL ".join(f"SELECT '{rule}' AS rule_id, {CODE} AS code FROM win WHERE seat % {k} = 0" for rule, k in _BROKEN.items()))
def v5_to_v11(spark, d):
    off = lambda rule: (F.col("seat") % _BROKEN[rule] == 0).cast("bigint")
    counted = roles.candidacies(spark, d).groupBy(*KEYS).agg(F.sum("votes").alias("all_votes"), F.count("*").alias("candidates"), F.max("votes").alias("top_votes"))
    won = roles.results(spark, d).join(counted, KEYS)
    broken = won.withColumns({
        "candidate_votes": F.col("all_votes") + off("V5"), "issued": F.col("issued") + off("V6"), "winner_votes": F.col("votes") - off("V7"), "stated_margin": F.col("margin") + off("V8"),
        "stated_turnout": F.col("turnout") + 0.01 * off("V10"), "stated_candidates": F.col("candidates") + off("V11"),
    })
    return rules.contest_rules(broken, _code()).select("rule_id", "code")


_OFF = {"registered": 13, "issued": 11, "valid": 5, "rejected": 9, "unreturned": 7}


def _v12(spark, d):
    """Details from the lines, planted with differences; headlines from the accounts."""
    headline = roles.contests(spark, d)
    flag = lambda x, name: F.sum(F.when(F.col("flag") == x, F.col("q")).otherwise(0)).alias(name)
    detail = roles.lines(spark, d).groupBy(*KEYS).agg(flag("N", "valid"), flag("R", "rejected"), flag("A", "unreturned"), F.sum("q").alias("issued"))
    detail = detail.withColumn("registered", F.sum("issued").over(Window.partitionBy("seat")))
    planted = detail.withColumns({c: F.col(c) + (F.col("seat") % k == 0).cast("bigint") for c, k in _OFF.items()})
    return rules.detail_against_headline(planted, headline, KEYS, list(_OFF))


@query("v12_detail_against_headline", BASE + f"SELECT {CODE} AS code, string_agg(field, ',' ORDER BY field) AS fields FROM cont, (VALUES " + ", ".join(f"('{c}', {k})" for c, k in _OFF.items()) + ") f (field, k) WHERE seat % k = 0 GROUP BY edition, seat")
def v12(spark, d):
    return _v12(spark, d)[0].select("code", F.array_join(F.array_sort(F.map_keys("details")), ",").alias("fields"))


@query("v12_matches", BASE + "SELECT count(*) FILTER (WHERE " + " AND ".join(f"seat % {k} <> 0" for k in _OFF.values()) + ") AS matches, count(*) AS compared FROM cont")
def v12_matches(spark, d):
    return _v12(spark, d)[1]


@query("v14_children_against_parents", "SELECT r_name AS code, 'customers' AS metric FROM region WHERE r_regionkey = 2 UNION ALL SELECT r_name, 'segments' FROM region WHERE r_regionkey = 4")
def v14(spark, d):
    n = table(spark, d, "nation").join(table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    children = table(spark, d, "customer").join(F.broadcast(n), F.col("c_nationkey") == F.col("n_nationkey")).groupBy("r_name", "n_name").agg(F.count("*").alias("customers"), F.sum(F.length("c_mktsegment")).alias("segments"))  # 25 nations
    off = lambda k: (F.col("r_regionkey") == k).cast("bigint")
    parents = children.groupBy("r_name").agg(F.sum("customers").alias("customers"), F.sum("segments").alias("segments")).join(table(spark, d, "region"), "r_name")
    planted = parents.select("r_name", (F.col("customers") + off(2)).alias("customers"), (F.col("segments") - off(4)).alias("segments"))
    return rules.hierarchy_sums(children, planted, ["r_name"], ["customers", "segments"]).select("code", F.col("details")["metric"].alias("metric"))


@query("v16_parent_of_child", "SELECT CAST(c_custkey AS VARCHAR) AS code FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE n_regionkey <> c_custkey % 5")
def v16(spark, d):
    n = table(spark, d, "nation").select("n_nationkey", "n_regionkey")
    joined = table(spark, d, "customer").join(F.broadcast(n), F.col("c_nationkey") == F.col("n_nationkey"))  # 25 nations
    return rules.check(joined, "V16", F.col("n_regionkey") == F.col("c_custkey") % 5, "another parent", F.col("c_custkey")).select("code")


_SEATS = {"A0": 20, "A1": 20, "A2": 20, "A7": 1}


@query("v20_expected_composition", BASE + ", c AS (SELECT ticket, count(*) AS n FROM win WHERE edition = 1995 GROUP BY ticket) SELECT coalesce(c.ticket, e.ticket) AS code, coalesce(n, 0) AS n FROM c FULL JOIN (VALUES " + ", ".join(f"('{k}', {v})" for k, v in _SEATS.items()) + ") e (ticket, expected) ON e.ticket = c.ticket WHERE coalesce(n, 0) <> coalesce(expected, 0)")
def v20(spark, d):
    counts = roles.results(spark, d).where("edition = 1995").groupBy("ticket").agg(F.count("*").alias("n"))
    return rules.expected_counts(counts, "ticket", "n", _SEATS).select("code", F.col("details")["n"].cast("bigint").alias("n"))


@query("k7_run_and_issues", "SELECT 'r1' AS release, CASE WHEN count(*) > 0 THEN 'failed' ELSE 'passed' END AS status, count(*) AS issues FROM customer WHERE c_acctbal < 0")
def k7(spark, d):
    found = rules.check(table(spark, d, "customer"), "V0", F.col("c_acctbal") >= 0, "negative balance", F.col("c_custkey"))
    run, rows = rules.report(found, "r1")
    return run.join(rows.groupBy("release").agg(F.count("*").alias("issues")), "release", "left").select("release", "status", F.coalesce("issues", F.lit(0)).alias("issues"))


# Overlays

_LATEST = "(SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY {keys} ORDER BY CAST(ts AS DATE) DESC, ts DESC, event_id DESC) AS place FROM (SELECT *, event_id % 3 AS position FROM events) WHERE CAST(ts AS DATE) <= DATE '" + AS_OF + "' AND {where}) WHERE place = 1)"


def _seats(spark, d):
    s = table(spark, d, "supplier")
    item = lambda name, votes: F.struct(name.alias("name"), F.lit("OLD").alias("alliance"), F.lit("old").alias("party"), F.lit(votes).alias("votes"))
    winner = F.struct(F.col("s_name").alias("name"), F.lit("OLD").alias("alliance"), F.lit("old").alias("party"), F.lit("M").alias("gender"), F.lit("x").alias("ethnicity"))
    return s.select(F.col("s_suppkey").alias("seat"), (F.col("s_suppkey") + 40).alias("person_id"), F.array(item(F.col("s_name"), 9), item(F.lit("second"), 5)).alias("candidates"), winner.alias("winner"))


def _events(spark, d):
    return table(spark, d, "events").select(F.col("user_id").alias("seat"), F.col("user_id").alias("person_id"), (F.col("event_id") % 3).cast("int").alias("position"), "event_type", "event_id", F.to_date("ts").alias("effective_date"), F.col("ts").alias("created_at"), F.col("event_id").alias("ordinal"))


def _corrections(spark, d):
    blank = F.when(F.col("event_id") % 2 == 0, "").otherwise("F")
    return _events(spark, d).where("position < 2").withColumns({"name": F.col("event_type"), "alliance": F.upper("event_type"), "party": F.col("event_type"), "gender": blank, "ethnicity": F.lit("")})


@query("e3_candidate_corrections", "SELECT s_suppkey AS seat, coalesce(a.event_type, s_name) AS winner, CASE WHEN a.event_id % 2 = 1 THEN 'F' ELSE 'M' END AS gender, coalesce(a.event_type, s_name) AS first, coalesce(b.event_type, 'second') AS second, coalesce(upper(b.event_type), 'OLD') AS alliance, 14 AS votes FROM supplier LEFT JOIN " + _LATEST.format(keys="user_id, position", where="position < 2") + " a ON a.user_id = s_suppkey AND a.position = 0 LEFT JOIN " + _LATEST.format(keys="user_id, position", where="position < 2") + " b ON b.user_id = s_suppkey AND b.position = 1")
def e3(spark, d):
    fixed = overlay.correct_candidates(_seats(spark, d), _corrections(spark, d), F.lit(AS_OF).cast("date"))
    at = lambda k, c: F.col("candidates")[k][c]
    return fixed.select("seat", F.col("winner.name").alias("winner"), F.col("winner.gender").alias("gender"), at(0, "name").alias("first"), at(1, "name").alias("second"), at(1, "alliance").alias("alliance"), (at(0, "votes") + at(1, "votes")).alias("votes"))


def _membership(spark, d):
    alone = F.when(F.col("event_id") % 4 == 0, "independent").otherwise("party")
    number = (F.col("event_id") % 5).cast("int")
    return _events(spark, d).where("position = 2").withColumns({"seat": F.col("seat") + 7, "affiliation": alone, "party_id": number, "party_name": F.concat(F.lit("own "), "event_type"), "alliance_id": number + 1, "alliance_name": F.col("event_type")})


def _catalogues(spark):
    parties = spark.createDataFrame([(0, "P0", "old", ["P zero"], 1), (1, "P1", "one", [], 2)], "id int, name string, source_name string, aliases array<string>, ordinal int")
    alliances = spark.createDataFrame([(1, "L1", "OLD", ["click"], 1), (2, "L2", "two", ["view"], 2)], "id int, name string, source_name string, aliases array<string>, ordinal int")
    return parties, alliances


_HELD = "SELECT s_suppkey AS seat, coalesce(p.event_id, s.event_id) AS event, coalesce(p.event_type, s.event_type) AS kind FROM supplier LEFT JOIN " + _LATEST.format(keys="user_id", where="position = 2") + " p ON p.user_id = s_suppkey + 40 LEFT JOIN " + _LATEST.format(keys="user_id", where="position = 2") + " s ON s.user_id + 7 = s_suppkey"
_NAMED = f"SELECT seat, event, CASE WHEN event IS NULL THEN NULL WHEN event % 4 = 0 THEN 'INDEPENDENT' WHEN event % 5 < 2 THEN 'P' || CAST(event % 5 AS VARCHAR) ELSE 'own ' || kind END AS affiliation_party, CASE WHEN event IS NULL THEN NULL WHEN event % 4 = 0 THEN 'INDEPENDENT' WHEN event % 5 < 2 THEN 'L' || CAST(event % 5 + 1 AS VARCHAR) ELSE kind END AS affiliation_alliance FROM ({_HELD})"


@query("e2_affiliations", f"SELECT seat, affiliation_party, affiliation_alliance FROM ({_NAMED})")
def e2(spark, d):
    return overlay.affiliations(_seats(spark, d).select("seat", "person_id"), _membership(spark, d), *_catalogues(spark), F.lit(AS_OF).cast("date")).select("seat", "affiliation_party", "affiliation_alliance")


_STATUS = _LATEST.format(keys="user_id", where="position = 0")
_SHOWN = f"SELECT n.seat, CASE WHEN t.event_type = 'error' THEN 'VACANT' ELSE coalesce(affiliation_alliance, 'stated', 'OLD') END AS alliance, CASE WHEN t.event_type = 'error' THEN '-' WHEN affiliation_party IS NOT NULL THEN affiliation_party WHEN t.event_type IS NOT NULL THEN 'stated' ELSE coalesce(c.event_type, 'old') END AS party, t.event_type IS NOT NULL OR event IS NOT NULL AS is_changed, CASE WHEN t.event_type = 'error' THEN 'VACANT' WHEN affiliation_alliance IS NOT NULL THEN affiliation_alliance WHEN t.event_type IS NOT NULL THEN 'stated' ELSE coalesce(upper(c.event_type), 'OLD') END AS raw FROM ({_NAMED}) n LEFT JOIN {_STATUS} t ON t.user_id = n.seat LEFT JOIN " + _LATEST.format(keys="user_id, position", where="position < 2") + " c ON c.user_id = n.seat AND c.position = 0"


@query("e5_overlays_in_order", f"SELECT seat, CASE raw WHEN 'OLD' THEN 'L1' WHEN 'click' THEN 'L1' WHEN 'two' THEN 'L2' WHEN 'view' THEN 'L2' ELSE raw END AS current_alliance, CASE party WHEN 'old' THEN 'P0' WHEN 'one' THEN 'P1' ELSE party END AS current_party, is_changed FROM ({_SHOWN})")
def e5(spark, d):
    statuses = _events(spark, d).where("position = 0").select("seat", F.when(F.col("event_type") == "error", "vacant").otherwise("active").alias("status"), F.lit("stated").alias("stated_alliance"), F.lit("stated").alias("stated_party"), "effective_date", "created_at", "ordinal")
    shown = overlay.managed(_seats(spark, d), _corrections(spark, d), statuses, _membership(spark, d), *_catalogues(spark), F.lit(AS_OF).cast("date"), current_term=True)
    return shown.select("seat", "current_alliance", "current_party", "is_changed")


@query("e6_current_of_past_term", "SELECT s_suppkey AS seat, CASE WHEN coalesce(upper(event_type), 'OLD') = 'OLD' THEN 'L1' ELSE upper(event_type) END AS current_alliance, false AS is_changed FROM supplier LEFT JOIN " + _LATEST.format(keys="user_id, position", where="position < 2") + " a ON user_id = s_suppkey AND position = 0")
def e6(spark, d):
    statuses = _events(spark, d).select("seat", F.lit("vacant").alias("status"), F.lit("stated").alias("stated_alliance"), F.lit("stated").alias("stated_party"), "effective_date", "created_at", "ordinal")
    shown = overlay.managed(_seats(spark, d), _corrections(spark, d), statuses, _membership(spark, d), *_catalogues(spark), F.lit(AS_OF).cast("date"), current_term=False)
    return shown.select("seat", "current_alliance", "is_changed")


@query("m4_replay", "SELECT CAST(date AS VARCHAR) AS date, user_id AS seat, max_by(event_type, (CAST(ts AS DATE), ts, event_id)) AS status FROM events JOIN supplier ON s_suppkey = user_id, (VALUES (DATE '2024-01-05'), (DATE '2024-01-20')) v (date) WHERE CAST(ts AS DATE) <= date GROUP BY date, user_id")
def m4(spark, d):
    dates = spark.createDataFrame([("2024-01-05",), ("2024-01-20",)], "date string").select(F.col("date").cast("date").alias("date"))
    events = _events(spark, d).withColumn("status", F.col("event_type"))
    return overlay.replay(_seats(spark, d), events, ["seat"], ["status"], dates).select(F.col("date").cast("string").alias("date"), "seat", "status")


# Publication


def _revisions(spark, d):
    status = F.when(F.col("o_orderkey") % 5 == 1, "reviewed").when(F.col("o_orderstatus") == "F", "published").when(F.col("o_orderstatus") == "O", "superseded").otherwise("draft")
    return table(spark, d, "orders").select(F.col("o_orderkey").alias("revision"), F.col("o_custkey").alias("key"), status.alias("status"), F.lit("ann").alias("author"), F.concat_ws("|", F.col("o_orderkey").cast("string"), "o_orderpriority").alias("payload"))


_REVISIONS = "(SELECT o_orderkey AS revision, o_custkey AS key, CASE WHEN o_orderkey % 5 = 1 THEN 'reviewed' WHEN o_orderstatus = 'F' THEN 'published' WHEN o_orderstatus = 'O' THEN 'superseded' ELSE 'draft' END AS status, CAST(o_orderkey AS VARCHAR) || '|' || o_orderpriority AS payload FROM orders)"


@query("e9_publication_log", f"WITH r AS {_REVISIONS} SELECT revision, status AS from_status, CASE WHEN revision = 11 THEN 'published' ELSE 'superseded' END AS to_status, 'bob' AS actor FROM r WHERE (revision = 11 OR (status = 'published' AND key = (SELECT key FROM r WHERE revision = 11))) AND EXISTS (SELECT 1 FROM r WHERE revision = 11 AND status = 'reviewed')")
def e9(spark, d):
    return editorial.publish_events(_revisions(spark, d), F.lit(11), F.lit("bob")).drop("note")


def _models(spark, d):
    r = _revisions(spark, d)
    return editorial.read_model(r).join(r.select("key", "revision", "payload"), ["key", "revision"]).select("key", "revision", "payload", F.sha2("payload", 256).alias("etag"))


@query("e10_rollback", f"WITH r AS {_REVISIONS}, m AS (SELECT key, max(revision) AS revision FROM r WHERE status = 'published' GROUP BY key), back AS (SELECT key, min(revision) AS revision FROM r WHERE status = 'superseded' GROUP BY key ORDER BY key LIMIT 1) SELECT x.key, x.revision, sha256(payload) AS etag FROM (SELECT * FROM m WHERE key NOT IN (SELECT key FROM back) UNION ALL SELECT * FROM back) x JOIN r ON r.revision = x.revision")
def e10(spark, d):
    r = _revisions(spark, d)
    first = r.where("status = 'superseded'").groupBy("key").agg(F.min("revision").alias("revision")).agg(F.min(F.struct("key", "revision")).alias("x"))
    back = r.join(F.broadcast(first.select(F.col("x.revision").alias("_back"))), F.col("revision") == F.col("_back"), "left")  # one row
    return editorial.point(_models(spark, d), back, F.col("_back"), F.lit("bob")).select("key", "revision", "etag")


@query("e10_rollback_refused", f"WITH r AS {_REVISIONS} SELECT key, max(revision) AS revision FROM r WHERE status = 'published' GROUP BY key")
def e10_refused(spark, d):
    return editorial.point(_models(spark, d), _revisions(spark, d), F.lit(11), F.lit("bob")).select("key", "revision")  # reviewed only


@query("k9_edit_envelope", "SELECT s_suppkey AS seat, s_name AS name FROM supplier WHERE s_suppkey % 2 = 0")
def k9(spark, d):
    rows = table(spark, d, "supplier").select(F.lit(2).alias("version"), F.when(F.col("s_suppkey") % 2 == 0, "pru-15").otherwise("pru-14").alias("electionId"), F.struct(F.col("s_suppkey").alias("seat"), F.col("s_name").alias("name")).alias("change"))
    sent = rows.select(F.to_json(F.struct("*")).alias("line"))
    back = sent.select(F.from_json("line", "version int, electionId string, change struct<seat: bigint, name: string>").alias("e"))
    return back.where("e.version = 2 and e.electionId = 'pru-15'").select("e.change.*")


@query("e18_catalogue_edits", "SELECT id, name, status FROM (SELECT user_id % 40 AS id, max_by(event_type, event_id) AS name, max_by(CASE WHEN event_id % 6 = 0 THEN 'deleted' ELSE 'kept' END, event_id) AS status FROM events GROUP BY 1) WHERE status <> 'deleted'")
def e18(spark, d):
    edits = table(spark, d, "events").select((F.col("user_id") % 40).alias("id"), F.col("event_type").alias("name"), F.when(F.col("event_id") % 6 == 0, "deleted").otherwise("kept").alias("status"), "event_id")
    return overlay.latest(edits, ["id"], ["name", "status"], order=("event_id",)).where("status <> 'deleted'")


# Joins


@query("j5_hierarchy_keys", "SELECT s_suppkey AS seat, n_name AS state, r_name AS region, n_regionkey = s_suppkey % 5 AS consistent FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey")
def j5(spark, d):
    """A place without its parent, or a parent without its own, fails."""
    nations = table(spark, d, "nation").select(F.col("n_nationkey").alias("s_nationkey"), "n_name", "n_regionkey")
    placed = joins.mandatory(table(spark, d, "supplier").select("s_suppkey", "s_nationkey"), nations, ["s_nationkey"])
    joined = joins.mandatory(placed, table(spark, d, "region").select(F.col("r_regionkey").alias("n_regionkey"), "r_name"), ["n_regionkey"])
    return joined.select(F.col("s_suppkey").alias("seat"), F.col("n_name").alias("state"), F.col("r_name").alias("region"), (F.col("n_regionkey") == F.col("s_suppkey") % 5).alias("consistent"))


@query("j6_unique_fallback", "SELECT c_custkey, CASE WHEN c_custkey % 4 <> 0 THEN c_custkey % 9 ELSE k END AS seat FROM customer LEFT JOIN (SELECT s_nationkey, any_value(s_suppkey) AS k FROM supplier GROUP BY s_nationkey HAVING count(*) = 1) ON s_nationkey = c_nationkey")
def j6(spark, d):
    rows = table(spark, d, "customer").select("c_custkey", F.col("c_nationkey").alias("state"), F.when(F.col("c_custkey") % 4 != 0, F.col("c_custkey") % 9).alias("seat"))
    targets = table(spark, d, "supplier").select(F.col("s_nationkey").alias("state"), F.col("s_suppkey").alias("seat"))
    return joins.resolved(rows, targets, ["state"], "seat", strict=False).drop("state")


_POINTS = "(SELECT label AS grp, vec_id AS id, CAST(embedding[1] AS DOUBLE) AS x, CAST(embedding[2] AS DOUBLE) AS y FROM embeddings)"


@query("j24_nearest_half_plane", f"SELECT grp, id, neighbour FROM (SELECT a.grp, a.id, b.id AS neighbour, row_number() OVER (PARTITION BY a.grp, a.id ORDER BY abs(b.y - a.y) + 2 * abs(b.x - a.x), b.id) AS p FROM {_POINTS} a JOIN {_POINTS} b ON a.grp = b.grp AND b.y < a.y) WHERE p = 1")
def j24(spark, d):
    points = table(spark, d, "embeddings").select(F.col("label").alias("grp"), F.col("vec_id").alias("id"), F.col("embedding")[0].cast("double").alias("x"), F.col("embedding")[1].cast("double").alias("y"))
    return match.nearest_half_plane(points, "grp", horizontal=False, sign=-1)


@query("j26_geometry_and_result", BASE + "SELECT vec_id AS feature, edition, winner FROM embeddings JOIN win ON vec_id = seat")
def j26(spark, d):
    """Every result has its one geometry, or the query fails."""
    won = roles.results(spark, d).select(F.col("seat").alias("feature"), "edition", "winner")
    return joins.mandatory(won, table(spark, d, "embeddings").select(F.col("vec_id").alias("feature"), "label"), ["feature"]).drop("label")


_ASKED = ["NATION_7", " 12", "nation_3", "3", "17", "NOWHERE"]


@query("j27_alias_lookup", "SELECT DISTINCT n_nationkey AS id, s.name AS asked FROM nation JOIN (VALUES " + ", ".join(f"('{x}')" for x in _ASKED) + ") s (name) ON upper(trim(s.name)) IN (upper(n_name), regexp_replace(upper(n_name), '^NATION_', ''), regexp_replace(upper(n_name), '^NATION_1', ''))")
def j27(spark, d):
    asked = spark.createDataFrame([(x,) for x in _ASKED], "asked string")
    return overlay.alias_lookup(asked, table(spark, d, "nation").select(F.col("n_nationkey").alias("id"), "n_name"), "n_name", ["NATION_", "NATION_1"]).select("id", "asked")


@query("j30_supplemented_event", "SELECT l_suppkey AS seat, CAST(DATE '1995-06-01' AS VARCHAR) AS held, count(*) AS n FROM lineitem WHERE year(l_shipdate) = 1995 AND l_suppkey <> 3 GROUP BY 1 UNION ALL SELECT l_suppkey, CAST(max(CAST(l_shipdate AS DATE)) AS VARCHAR), count(*) FROM lineitem WHERE year(l_shipdate) = 1996 AND l_suppkey = 3 GROUP BY 1")
def j30(spark, d):
    rows = table(spark, d, "lineitem").select(F.col("l_suppkey").alias("seat"), F.year("l_shipdate").alias("year"), F.to_date("l_shipdate").alias("day"))
    event = rows.where("year = 1995 and seat <> 3").select("seat", F.lit("1995-06-01").alias("held"))
    others = rows.where("year > 1995").select(F.col("year").alias("dataset"), F.col("seat").alias("place"), "seat", F.lit(None).cast("string").alias("held"))
    one = rows.where("year = 1996 and seat = 3").groupBy(F.col("year").alias("dataset"), F.col("seat").alias("place")).agg(F.max("day").cast("string").alias("held"))
    return overlay.supplemented(event, others, one).groupBy("seat", "held").agg(F.count("*").alias("n"))


@query("j7_without_source", "SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT')")
def j7(spark, d):
    urgent = table(spark, d, "orders").where("o_orderpriority = '1-URGENT'").select(F.col("o_custkey").alias("c_custkey"))
    return table(spark, d, "customer").select("c_custkey").join(urgent, "c_custkey", "left_anti")


@query("v3_missing_and_unexpected", "SELECT CAST(c_custkey AS VARCHAR) AS code, 'missing key' AS message FROM customer WHERE c_custkey % 10 <> 3 AND c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT') UNION ALL SELECT DISTINCT CAST(o_custkey AS VARCHAR), 'unexpected key' FROM orders WHERE o_orderpriority = '1-URGENT' AND o_custkey % 10 = 3")
def v3(spark, d):
    actual = table(spark, d, "orders").where("o_orderpriority = '1-URGENT'").select(F.col("o_custkey").alias("k"))
    return rules.coverage(actual, table(spark, d, "customer").where("c_custkey % 10 <> 3").select(F.col("c_custkey").alias("k")), ["k"]).select("code", "message")


# Filters, projections and labels


@query("p7_latest_coverage", "SELECT o_orderkey FROM orders WHERE o_orderdate = (SELECT max(o_orderdate) FROM orders)")
def p7(spark, d):
    return rollup.of_latest(table(spark, d, "orders").select("o_orderkey", "o_orderdate"), "o_orderdate").select("o_orderkey")


@query("p9_excluded_corrections", "SELECT event_id FROM events WHERE NOT (user_id = 5 AND event_id % 2 = 0 AND CAST(ts AS DATE) >= DATE '2024-01-10' AND event_type <> 'click') AND NOT (user_id = 7 AND event_id % 2 = 0 AND (event_type = 'view' OR event_id % 3 = 2))")
def p9(spark, d):
    changes = table(spark, d, "events").select("event_id", F.col("user_id").alias("seat"), (F.col("event_id") % 2).alias("position"), F.to_date("ts").alias("date"), F.concat(F.lit(" "), F.upper("event_type")).alias("party"), F.concat(F.lit("group "), F.col("event_id") % 3).alias("alliance"))
    rules_ = [(5, 0, "2024-01-10", "click", None, None), (7, 0, None, None, "VIEW.", "Group-2")]
    exceptions = spark.createDataFrame(rules_, "seat long, position long, from_date string, but_party string, party string, alliance string").withColumn("from_date", F.to_date("from_date"))
    return overlay.without_misfiled(changes, exceptions).select("event_id")


@query("p10_renamed_columns", "SELECT s_suppkey AS seat, s_name AS winner, s_nationkey AS state FROM supplier")
def p10(spark, d):
    names = {"s_suppkey": "seat", "s_name": "winner", "s_nationkey": "state"}
    return table(spark, d, "supplier").select(*names).withColumnsRenamed(names)


@query("p11_p12_struct_fields", "SELECT s_suppkey AS seat, '{\"name\":\"' || s_name || '\",\"held\":\"1995\"}' AS row FROM supplier")
def p11_p12(spark, d):
    row = F.struct(F.col("s_name").alias("name"), F.lit("F").alias("gender"), F.lit("x").alias("ethnicity"))
    return table(spark, d, "supplier").select(F.col("s_suppkey").alias("seat"), F.to_json(row.withField("held", F.lit("1995")).dropFields("gender", "ethnicity")).alias("row"))


@query("p15_sections", "SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN 'postal' WHEN c_custkey % 3 = 1 THEN 'early' ELSE 'ordinary' END AS section FROM customer")
def p15(spark, d):
    code = F.concat(F.col("c_custkey").cast("string"), F.when(F.col("c_custkey") % 3 == 0, "/UP").when(F.col("c_custkey") % 3 == 1, "/00").otherwise("/01"))
    return table(spark, d, "customer").select("c_custkey", labels.section(code).alias("section"))


@query("p18_uncontested_by_order", BASE + "SELECT edition, count(*) AS n FROM (SELECT edition, seat, orderkey FROM lines GROUP BY ALL HAVING count(DISTINCT candidate) = 1 AND sum(CASE WHEN flag = 'N' THEN q ELSE 0 END) = 0) GROUP BY edition")
def p18(spark, d):
    by = roles.lines(spark, d).groupBy(*KEYS, "orderkey").agg(F.count_distinct("candidate").alias("candidates"), F.sum(F.when(F.col("flag") == "N", F.col("q")).otherwise(0)).alias("valid"))
    return contest.uncontested(by).groupBy("edition").agg(F.count("*").alias("n"))


@query("p19_special_voters", BASE + "SELECT seat, CAST(sum(CASE WHEN stream <= 3 THEN q ELSE 0 END) AS BIGINT) AS special FROM lines GROUP BY seat")
def p19(spark, d):
    part = lambda k: F.sum(F.when(F.col("stream") == k, F.col("q")).otherwise(0))
    sums = roles.lines(spark, d).groupBy("seat").agg(part(1).alias("military"), part(2).alias("police"), part(3).alias("overseas"))
    return sums.select("seat", rollup.special_voters(F.col("military"), F.col("police"), F.col("overseas")).alias("special"))


@query("u7_last_value_first_place", "SELECT event_type || ' ' || CAST(user_id % 9 AS VARCHAR) AS label, max_by(user_id, event_id) AS value, min(event_id) AS place FROM events GROUP BY 1")
def u7(spark, d):
    offered = table(spark, d, "events").select(F.concat_ws(" ", "event_type", (F.col("user_id") % 9).cast("string")).alias("label"), F.col("user_id").alias("value"), F.col("event_id").alias("place"))
    return search.last_value_first_place(offered, "label", "place")


_OFFERED = "SELECT 'NEGERI · ' || r_name AS label, 0 AS kind, CAST(r_regionkey AS BIGINT) AS x, 0 AS n, r_regionkey AS area, NULL AS feature FROM region UNION ALL SELECT 'S' || s_suppkey || ' ' || s_name || ' · ' || n_name, 1, s_suppkey, 0, n_regionkey, s_suppkey FROM supplier JOIN nation ON s_nationkey = n_nationkey UNION ALL SELECT n_name || ' · S' || s_suppkey || ' ' || s_name, 1, s_suppkey, 1, n_regionkey, s_suppkey FROM supplier JOIN nation ON s_nationkey = n_nationkey UNION ALL SELECT 'NEGERI · ' || r_name, 1, s_suppkey, 2, n_regionkey, s_suppkey FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey WHERE s_suppkey % 50 = 0"


@query("f11_search_entries", f"SELECT label, area, feature, first_kind, first_of FROM (SELECT label, max_by(area, (kind, x, n)) AS area, max_by(coalesce(feature, -1), (kind, x, n)) AS feature, min((kind, x, n))[1] AS first_kind, min((kind, x, n))[2] AS first_of FROM ({_OFFERED}) GROUP BY label)")
def f11(spark, d):
    """A supplier in fifty has a term that reads like a region's own entry: the entry keeps its place and leads to the last."""
    regions = table(spark, d, "region").select(F.col("r_regionkey").cast("long").alias("area"), F.col("r_name").alias("name"))
    nations = table(spark, d, "nation").join(table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    placed = table(spark, d, "supplier").join(nations, F.col("s_nationkey") == F.col("n_nationkey"))
    odd = F.col("s_suppkey") % 50 == 0
    code = F.concat(F.lit("S"), F.col("s_suppkey").cast("string"))
    results = placed.select(F.col("n_regionkey").cast("long").alias("area"), F.col("s_suppkey").cast("long").alias("feature"), code.alias("code"), F.col("s_name").alias("name"), F.col("n_name").alias("winner"), F.array("n_name", "n_name").alias("terms"))
    plain = search.offered(regions, results)
    clash = placed.where(odd).select(labels.place_label(F.lit("NEGERI"), F.lit(None), F.col("r_name")).alias("label"), F.struct(F.lit(1).alias("kind"), F.col("s_suppkey").cast("long").alias("of"), F.lit(2).alias("n")).alias("place"), F.col("n_regionkey").cast("long").alias("area"), F.col("s_suppkey").cast("long").alias("feature"))
    found = search.last_value_first_place(plain.unionByName(clash), "label", "place")
    return found.select("label", "area", F.coalesce("feature", F.lit(-1)).alias("feature"), F.col("place.kind").alias("first_kind"), F.col("place.of").alias("first_of"))


@query("u9_normalised_tuples", "SELECT 'left' AS side, replace(n_name, '_', ' ') AS name FROM nation WHERE n_nationkey % 7 = 0 UNION ALL SELECT 'right', 'X ' || replace(n_name, '_', ' ') FROM nation WHERE n_nationkey % 7 = 0")
def u9(spark, d):
    n = table(spark, d, "nation")
    left = n.select(F.concat(F.lit(" "), F.lower("n_name")).alias("name"), "n_regionkey")
    right = n.select(F.when(F.col("n_nationkey") % 7 == 0, F.concat(F.lit("x-"), "n_name")).otherwise(F.col("n_name")).alias("name"), "n_regionkey")
    return rules.tuple_differences(left, right, ["name", "n_regionkey"]).select("side", "name")


@query("f8_short_names", "SELECT n_name, CASE WHEN n_nationkey % 4 = 0 THEN 'N' || n_nationkey ELSE n_name END AS short, CASE WHEN n_nationkey % 4 = 0 THEN '#0000ff' ELSE '#7b8580' END AS color FROM nation")
def f8(spark, d):
    n = table(spark, d, "nation")
    entry = lambda ordinal, short: n.where("n_nationkey % 4 = 0").select(F.col("n_name").alias("name"), F.lit(ordinal).alias("ordinal"), short.alias("shortName"), F.lit("#0000ff").alias("color"))
    known = entry(1, F.concat(F.lit("N"), "n_nationkey")).unionByName(entry(2, F.lit("later")))
    named = overlay.with_catalogue(n.select("n_name"), "n_name", known, {"shortName": F.col("n_name"), "color": F.lit("#7b8580")})
    return named.withColumnRenamed("shortName", "short")


_COMPACT = "CASE " + " ".join(f"WHEN round(x / {n}, 1) < 1000 THEN regexp_replace(printf('%.1f', round(x / {n}, 1)), '\\.0$', '') || '{unit}'" for unit, n in [("", "1.0"), ("K", "1e3"), ("J", "1e6"), ("B", "1e9")]) + " ELSE regexp_replace(printf('%.1f', round(x / 1e12, 1)), '\\.0$', '') || 'T' END"


@query("f10_number_formats", f"SELECT c_custkey, format('{{:,}}', c_custkey * 1234) AS grouped, CASE c_custkey % 3 WHEN 0 THEN '0 kerusi' WHEN 1 THEN '+' || format('{{:,}}', c_custkey) || ' kerusi' ELSE '-' || format('{{:,}}', c_custkey) || ' kerusi' END AS signed, CAST(c_custkey % 100 AS VARCHAR) || '.0%' AS percent, {_COMPACT} AS compact FROM (SELECT c_custkey, CAST(c_custkey AS DOUBLE) * c_custkey * c_custkey AS x FROM customer)")
def f10(spark, d):
    k = F.col("c_custkey")
    change = F.when(k % 3 == 0, 0).when(k % 3 == 1, k).otherwise(-k)
    cube = k.cast("double") * k * k
    return table(spark, d, "customer").select("c_custkey", numbers.grouped(k * 1234).alias("grouped"), numbers.signed(change, suffix=" kerusi").alias("signed"), numbers.percent_text((k % 100) / 100).alias("percent"), numbers.compact(cube).alias("compact"))


@query("n5_n6_dates", "SELECT o_custkey, CASE WHEN year(a) = year(b) THEN CAST(year(a) AS VARCHAR) ELSE year(a) || '–' || year(b) END AS years, strftime(a, '%d ') || ['JAN','FEB','MAC','APR','MEI','JUN','JUL','OGO','SEP','OKT','NOV','DIS'][month(a)] || strftime(a, ' %Y') AS first, strftime(a, '%Y-%m-%dT00:00:00.000Z') AS baseline, strftime(b, '%Y-%m-%d') AS last FROM (SELECT o_custkey, min(CAST(o_orderdate AS DATE)) AS a, max(CAST(o_orderdate AS DATE)) AS b FROM orders GROUP BY o_custkey)")
def n5_n6(spark, d):
    day = F.to_date("o_orderdate")
    ends = table(spark, d, "orders").groupBy("o_custkey").agg(F.min(day).alias("a"), F.max(day).alias("b"))
    a, b = F.col("a"), F.col("b")
    return ends.select("o_custkey", labels.year_range(a, b).alias("years"), labels.day_label(a).alias("first"), labels.baseline(a).alias("baseline"), labels.iso_date(b).alias("last"))


@query("n12_multisets", BASE + "SELECT edition, seat, list_sort(list(votes)) = list_sort(list(votes + CASE WHEN seat % 3 = 0 AND position = 1 THEN 1 ELSE 0 END)) AS equal FROM ranked GROUP BY edition, seat")
def n12(spark, d):
    ranked = roles.ranked(spark, d)
    off = F.when((F.col("seat") % 3 == 0) & (F.col("position") == 1), 1).otherwise(0)
    both = ranked.groupBy(*KEYS).agg(F.collect_list("votes").alias("a"), F.collect_list(F.col("votes") + off).alias("b"))
    return both.select(*KEYS, numbers.same_values(F.col("a"), F.col("b")).alias("equal"))


@query("n15_tag_of_payload", "SELECT s_suppkey, sha256('{\"s_suppkey\":' || CAST(s_suppkey AS VARCHAR) || ',\"s_name\":\"' || s_name || '\"}') AS etag FROM supplier")
def n15(spark, d):
    return writers.entity_tag(table(spark, d, "supplier").select("s_suppkey", "s_name")).select("s_suppkey", "etag")


@query("n1_n10_numbers", "SELECT c_custkey, round(c_custkey / 7.0, 6) AS rounded, CASE WHEN c_custkey % 2 = 0 THEN 'b' ELSE '' END AS changed FROM customer")
def n1_n10(spark, d):
    k = F.col("c_custkey")
    before = F.create_map(F.lit("a"), F.lit(1), F.lit("b"), F.lit(0))
    after = F.create_map(F.lit("a"), F.lit(1), F.lit("b"), F.when(k % 2 == 0, 5).otherwise(0))
    return table(spark, d, "customer").select("c_custkey", numbers.round_fraction(k / 7.0).alias("rounded"), F.array_join(F.array_sort(F.map_keys(numbers.changed_keys(before, after))), ",").alias("changed"))


# Geometry


def _rings(spark, d):
    return table(spark, d, "embeddings").select("vec_id", geometry.ring(F.col("embedding")).alias("ring"))


@query("g5_mercator", "SELECT c_custkey, round(radians(c_custkey % 360 - 180), 9) + 0 AS x, round(ln(tan(pi() / 4 + radians(c_custkey % 160 - 80) / 2)), 9) + 0 AS y FROM customer")
def g5(spark, d):
    at = geometry.mercator((F.col("c_custkey") % 360 - 180).cast("double"), (F.col("c_custkey") % 160 - 80).cast("double"))
    return table(spark, d, "customer").select("c_custkey", (F.round(at["x"], 9) + 0).alias("x"), (F.round(at["y"], 9) + 0).alias("y"))


@query("g9_segment_distance", "SELECT c_custkey, round(CASE WHEN c_custkey % 20 <= 10 THEN c_custkey % 7 ELSE sqrt((c_custkey % 20 - 10) * (c_custkey % 20 - 10) + (c_custkey % 7) * (c_custkey % 7)) END, 9) AS distance FROM customer")
def g9(spark, d):
    n = lambda x: F.lit(x).cast("double")
    far = geometry.segment_distance((F.col("c_custkey") % 20).cast("double"), (F.col("c_custkey") % 7).cast("double"), n(0), n(0), n(10), n(0))
    return table(spark, d, "customer").select("c_custkey", F.round(far, 9).alias("distance"))


@query("g6_fitted_bounds", "WITH p AS (SELECT CAST(unnest(list_filter(embedding, lambda x, i: i % 2 = 1)) AS DOUBLE) AS x, CAST(unnest(list_filter(embedding, lambda x, i: i % 2 = 0)) AS DOUBLE) AS y FROM embeddings), b AS (SELECT min(x) AS ax, max(x) AS bx, min(y) AS ay, max(y) AS az FROM p) SELECT round(least(944 / (bx - ax), 544 / (az - ay)), 6) AS scale, round((1000 - (bx - ax) * least(944 / (bx - ax), 544 / (az - ay))) / 2, 6) AS left_edge FROM b")
def g6(spark, d):
    xs = _rings(spark, d).select(F.explode("ring").alias("p"))
    box = xs.agg(*(f(F.col(f"p.{c}").cast("double")).alias(f"{n}_{c}") for c in "xy" for n, f in (("min", F.min), ("max", F.max))))
    b = F.struct("min_x", "min_y", "max_x", "max_y")
    corner = lambda x, y: geometry.fitted(F.struct(F.col(x).alias("x"), F.col(y).alias("y")), b, 1000.0, 600.0)
    low, high = corner("min_x", "min_y"), corner("max_x", "max_y")
    return box.select(F.round((high["x"] - low["x"]) / (F.col("max_x") - F.col("min_x")), 6).alias("scale"), F.round(low["x"], 6).alias("left_edge"))


@query("g11_simplified_closed_rings")
def g11(spark, d):
    closed = F.concat("ring", F.slice("ring", 1, 1))
    return _rings(spark, d).select("vec_id", geometry.simplified_rings(closed, 0.2).alias("ring")).select("vec_id", F.size("ring").alias("points"), (F.element_at("ring", 1) == F.element_at("ring", -1)).alias("closed"))


@query("g13_geometry_types", "SELECT label, CASE WHEN count(*) = 1 THEN 'Polygon' ELSE 'MultiPolygon' END AS kind FROM embeddings GROUP BY label")
def g13(spark, d):
    parts = table(spark, d, "embeddings").groupBy("label").agg(F.count("*").cast("int").alias("n"))
    return parts.select("label", geometry.type_of(F.col("n")).alias("kind"))


# Files: written, then read back


@query("s1_s3_json_and_csv", "SELECT n_nationkey, n_name, CAST(n_regionkey AS VARCHAR) AS region FROM nation")
def s1_s3(spark, d):
    path = folder(spark, "files")
    n = table(spark, d, "nation").select("n_nationkey", "n_name", "n_regionkey")
    writers.json_lines(n, f"{path}/json")
    n.write.option("header", True).csv(f"{path}/csv")
    names = spark.read.schema("n_nationkey bigint, n_name string").json(f"{path}/json")
    regions = readers.csv_table(spark, f"{path}/csv").select(F.col("n_nationkey").cast("bigint").alias("n_nationkey"), F.col("n_regionkey").alias("region"))
    return names.join(regions, "n_nationkey")


@query("k2_k3_checked_partitions", "SELECT n_regionkey, count(*) AS n FROM nation GROUP BY n_regionkey")
def k2_k3(spark, d):
    path = folder(spark, "parts")
    n = table(spark, d, "nation")
    writers.partitioned(n.select("n_nationkey", "n_regionkey"), path, "n_regionkey")
    back = spark.read.parquet(path)
    counts = back.groupBy(F.col("n_regionkey").cast("bigint").alias("n_regionkey")).agg(F.count("*").alias("n"))
    writers.write_or_check(counts, f"{path}-counts")
    writers.write_or_check(counts, f"{path}-counts", check=True)
    return spark.read.parquet(f"{path}-counts")


@query("s10_s11_k5_locked_files", "SELECT CASE WHEN n_nationkey < 10 THEN 'P.00' ELSE 'P.0' END || n_nationkey AS code, sha256(n_name || chr(10)) AS sha256, CAST(strlen(n_name) + 1 AS BIGINT) AS bytes, n_nationkey % 3 <> 0 AS registered FROM nation")
def s10_s11_k5(spark, d):
    """A file per nation; two of three are registered with their digest, and locked reading takes just these."""
    path = folder(spark, "locked")
    code = F.format_string("P.%03d", "n_nationkey")
    table(spark, d, "nation").select(code.alias("file"), F.col("n_name").alias("value")).write.partitionBy("file").text(path)
    found = readers.files(spark, path, "part-*").withColumns({"code": F.regexp_extract("path", "/file=([^/]*)/", 1)}).drop("name").withColumn("name", F.col("code"))
    stated = table(spark, d, "nation").where("n_nationkey % 3 <> 0").select(code.alias("name"), F.sha2(F.concat("n_name", F.lit("\n")), 256).alias("sha256"))
    held = readers.locked(found, stated).select("name", F.lit(True).alias("registered"))
    return found.join(held, "name", "left").select("code", "sha256", "bytes", F.coalesce("registered", F.lit(False)).alias("registered"))


@query("s11_wrong_digest_refused", "SELECT CASE WHEN n_nationkey % 3 = 0 THEN 'refused' ELSE 'read' END AS outcome, count(*) AS n FROM nation GROUP BY 1")
def s11(spark, d):
    """The same with some digests wrong: what a locked reader would refuse."""
    path = folder(spark, "locked")
    table(spark, d, "nation").select(F.col("n_nationkey").alias("file"), F.col("n_name").alias("value")).write.partitionBy("file").text(path)
    found = readers.files(spark, path, "part-*").withColumn("name", F.regexp_extract("path", "/file=([^/]*)/", 1))
    wrong = F.when(F.col("n_nationkey") % 3 == 0, "?").otherwise("")
    stated = table(spark, d, "nation").select(F.col("n_nationkey").cast("string").alias("name"), F.sha2(F.concat("n_name", F.lit("\n"), wrong), 256).alias("sha256"))
    try:
        readers.locked(found, stated).select("sha256").write.format("noop").mode("overwrite").save()
        raise AssertionError("a wrong digest was read")
    except Exception as error:
        if "isn't the registered one" not in str(error):
            raise
    return readers.mismatched(found, stated).groupBy("outcome").agg(F.count("*").alias("n"))


@query("s12_one_partition", "SELECT s_suppkey FROM supplier WHERE s_nationkey = 3")
def s12(spark, d):
    path = folder(spark, "lazy")
    writers.partitioned(table(spark, d, "supplier").select("s_suppkey", "s_nationkey"), path, "s_nationkey")
    return spark.read.parquet(path).where("s_nationkey = 3").select("s_suppkey")


@query("s14_parameterised_scan", "SELECT o_orderkey FROM orders WHERE o_orderpriority = '1-URGENT' ORDER BY o_orderdate DESC, o_orderkey LIMIT 100")
def s14(spark, d):
    wanted = "1-URGENT"
    held = spark.sql("SELECT o_orderkey FROM {orders} WHERE (:kind = '' OR o_orderpriority = :kind) ORDER BY o_orderdate DESC, o_orderkey LIMIT 100", args={"kind": wanted}, orders=table(spark, d, "orders"))
    return held


@query("s15_editions", BASE + "SELECT edition, count(*) AS seats, CAST(row_number() OVER (ORDER BY edition) AS INTEGER) AS place FROM win GROUP BY edition")
def s15(spark, d):
    seats = roles.results(spark, d).groupBy("edition").agg(F.count("*").alias("seats"))
    return seats.withColumn("place", F.row_number().over(Window.orderBy("edition")))  # a row per edition
