"""Queries on contests: ranking, aggregation, comparison."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from hustings.functions.numbers import parts_per_million, ratio_at_least_one, ratio_or_zero
from hustings.operators import compare, contest, rollup
from hustings.plans import roles
from hustings.plans.roles import BASE, KEYS, Registry
from hustings.sources.readers import table

registry = Registry()
query = registry.query


@query("w1_rank_candidates", BASE + "SELECT edition, seat, candidate, votes, position FROM ranked")
def w1(spark: SparkSession, d: str) -> DataFrame:
    return roles.ranked(spark, d).select(*KEYS, "candidate", "votes", "position")


@query("w3_winner_runner_up", BASE + "SELECT edition, seat, max(CASE WHEN position = 1 THEN candidate END) AS winner, max(CASE WHEN position = 1 THEN votes END) AS winner_votes, max(CASE WHEN position = 2 THEN candidate END) AS runner_up, max(CASE WHEN position = 2 THEN votes END) AS runner_up_votes, max(CASE WHEN position = 1 THEN margin_votes END) AS margin_votes FROM ranked GROUP BY edition, seat")
def w3(spark, d):
    return contest.podium(roles.ranked(spark, d), KEYS)


@query("w4_margin_votes", BASE + "SELECT edition, seat, candidate, margin_votes FROM ranked")
def w4(spark, d):
    return roles.ranked(spark, d).select(*KEYS, "candidate", "margin_votes")


@query("w5_margin_share", BASE + "SELECT edition, seat, votes / contest_votes - coalesce(lead(votes) OVER (PARTITION BY edition, seat ORDER BY votes DESC, candidate), 0) / contest_votes AS margin_share, candidate FROM ranked")
def w5(spark, d):
    return roles.ranked(spark, d).select(*KEYS, "candidate", "margin_share")


@query("w6_vote_share", BASE + "SELECT edition, seat, candidate, votes / contest_votes AS share, (2000000 * votes + contest_votes) // (2 * contest_votes) AS share_ppm FROM ranked")
def w6(spark, d):
    return roles.ranked(spark, d).select(*KEYS, "candidate", "share", parts_per_million(F.col("votes"), F.col("contest_votes")).alias("share_ppm"))


@query("w7_candidacy_ids", BASE + "SELECT CAST(edition AS VARCHAR) || ':' || CAST(seat AS VARCHAR) || ':' || lpad(CAST(position AS VARCHAR), 2, '0') AS candidacy_id, candidate FROM ranked")
def w7(spark, d):
    return roles.ranked(spark, d).select(F.concat_ws(":", "edition", "seat", F.lpad(F.col("position").cast("string"), 2, "0")).alias("candidacy_id"), "candidate")


@query("w9_leader_first_seen", BASE + "SELECT edition, state, ticket, seats FROM (SELECT edition, state, ticket, count(*) AS seats, row_number() OVER (PARTITION BY edition, state ORDER BY count(*) DESC, min(seat)) AS p FROM win GROUP BY edition, state, ticket) WHERE p = 1")
def w9(spark, d):
    counts = roles.results(spark, d).groupBy("edition", "state", "ticket").agg(F.count("*").alias("seats"), F.min("seat").alias("first"))
    return rollup.leaders(counts, ["edition", "state"], first="first").drop("first")


@query("w11_first_to_last_edition", BASE + "SELECT state, min_by(valid, edition) AS first_value, max_by(valid, edition) AS last_value, CASE WHEN min_by(valid, edition) = 0 THEN 0 ELSE (max_by(valid, edition) / min_by(valid, edition) - 1) * 100 END AS growth FROM (SELECT state, edition, CAST(sum(valid) AS BIGINT) AS valid FROM win GROUP BY state, edition) GROUP BY state")
def w11(spark, d):
    by = roles.results(spark, d).groupBy("state", "edition").agg(F.sum("valid").alias("valid"))
    return compare.first_to_last(by, ["state"], "edition", "valid")


@query("w12_quartiles", BASE + "SELECT edition, quantile_cont(margin, 0.25) AS q1, quantile_cont(margin, 0.5) AS q2, quantile_cont(margin, 0.75) AS q3 FROM win GROUP BY edition")
def w12(spark, d):
    q = compare.quartiles(roles.results(spark, d), "margin", ["edition"])
    return q.select("edition", *(F.col("thresholds")[k].alias(f"q{k + 1}") for k in range(3)))


@query("w13_bucket", BASE + ", q AS (SELECT edition, quantile_cont(margin, 0.25) AS q1, quantile_cont(margin, 0.5) AS q2, quantile_cont(margin, 0.75) AS q3 FROM win GROUP BY edition) SELECT edition, seat, CASE WHEN margin <= q1 THEN 0 WHEN margin <= q2 THEN 1 WHEN margin <= q3 THEN 2 ELSE 3 END AS bucket FROM win JOIN q USING (edition)")
def w13(spark, d):
    won = roles.results(spark, d)
    joined = won.join(compare.quartiles(won, "margin", ["edition"]), "edition")
    return joined.select(*KEYS, compare.bucket(F.col("margin"), [F.col("thresholds")[k] for k in range(3)]).alias("bucket"))


_DELTA = BASE + ", diff AS (SELECT n.edition, n.seat, n.margin - b.margin AS dm FROM win n JOIN win b ON b.seat = n.seat AND b.edition = n.edition - 1)"


def _differences(spark, d):
    won = roles.results(spark, d)
    before = won.withColumn("edition", F.col("edition") + 1)
    return compare.changes(compare.with_baseline(won, before, KEYS, ["winner", "margin", "turnout"]))


@query("w14_diverging_bucket", _DELTA + ", m AS (SELECT edition, quantile_cont(abs(dm), 0.5) AS m FROM diff GROUP BY edition) SELECT edition, seat, CAST(CASE WHEN abs(dm) < 0.12 * mm THEN 0 WHEN dm < 0 THEN -least(2, floor(abs(dm) / mm)) ELSE least(2, floor(abs(dm) / mm)) END AS INTEGER) AS bucket FROM (SELECT *, CASE WHEN m = 0 THEN 1.0 ELSE m END AS mm FROM diff JOIN m USING (edition))")
def w14(spark, d):
    diff = _differences(spark, d).where("has_baseline")
    scale = diff.groupBy("edition").agg(F.percentile(F.abs("margin_change"), F.lit(0.5)).alias("scale"))
    return diff.join(scale, "edition").select(*KEYS, compare.diverging_bucket(F.col("margin_change"), F.col("scale")).cast("int").alias("bucket"))


@query("a1_votes_by_candidate", BASE + "SELECT edition, seat, candidate, votes FROM cand")
def a1(spark, d):
    return roles.candidacies(spark, d).select(*KEYS, "candidate", "votes")


@query("a2_contest_accounts", BASE + "SELECT edition, seat, valid, rejected, unreturned, issued FROM cont")
def a2(spark, d):
    return roles.contests(spark, d).select(*KEYS, "valid", "rejected", "unreturned", "issued")


_ROLL = "SELECT r_name AS region, n_name AS nation, c_mktsegment AS segment, count(*) AS registered, CAST(sum(c_custkey % 2) AS BIGINT) AS odd, CAST(sum(CASE WHEN c_acctbal < 0 THEN 1 ELSE 0 END) AS BIGINT) AS overdrawn FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY "


def _roll(spark, d):
    n = table(spark, d, "nation").join(table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    c = table(spark, d, "customer").join(F.broadcast(n), F.col("c_nationkey") == F.col("n_nationkey"))  # 25 nations
    return c.select(F.col("r_name").alias("region"), F.col("n_name").alias("nation"), F.col("c_mktsegment").alias("segment"), F.lit(1).alias("registered"), (F.col("c_custkey") % 2).alias("odd"), (F.col("c_acctbal") < 0).cast("int").alias("overdrawn"))


@query("a3_hierarchy_rollup", "SELECT region, nation, segment, registered, odd, overdrawn, CAST(CASE WHEN region IS NULL THEN 0 WHEN nation IS NULL THEN 1 WHEN segment IS NULL THEN 2 ELSE 3 END AS INTEGER) AS level FROM (" + _ROLL + "ROLLUP (r_name, n_name, c_mktsegment))")
def a3(spark, d):
    return rollup.hierarchy(_roll(spark, d), ["region", "nation", "segment"], ["registered", "odd", "overdrawn"])


@query("a4_sums_and_counts", "SELECT nation, CAST(sum(registered) AS BIGINT) AS registered, CAST(sum(odd) AS BIGINT) AS odd, count(*) AS parts FROM (" + _ROLL + "r_name, n_name, c_mktsegment) GROUP BY nation")
def a4(spark, d):
    parts = _roll(spark, d).groupBy("nation", "segment").agg(F.sum("registered").alias("registered"), F.sum("odd").alias("odd"))
    return parts.groupBy("nation").agg(F.sum("registered").alias("registered"), F.sum("odd").alias("odd"), F.count("*").alias("parts"))


_SECTION = "CASE WHEN stream = 1 THEN 'postal' WHEN stream = 2 THEN 'early' ELSE 'ordinary' END"


def _streams(spark, d):
    section = F.when(F.col("stream") == 1, "postal").when(F.col("stream") == 2, "early").otherwise("ordinary")
    return roles.lines(spark, d).withColumn("section", section)


@query("a5_sheet_totals", BASE + f"SELECT edition, seat, count(DISTINCT stream) AS streams, CAST(sum(q) AS BIGINT) AS ballots, CAST(sum(CASE WHEN flag = 'N' AND {_SECTION} = 'postal' THEN q ELSE 0 END) AS BIGINT) AS postal FROM lines GROUP BY edition, seat")
def a5(spark, d):
    postal = F.when((F.col("flag") == "N") & (F.col("section") == "postal"), F.col("q")).otherwise(0)
    return _streams(spark, d).groupBy(*KEYS).agg(F.count_distinct("stream").alias("streams"), F.sum("q").alias("ballots"), F.sum(postal).alias("postal"))


@query("a6_coverage_index", BASE + "SELECT edition, count(DISTINCT seat) AS seats, count(*) AS rows_, count(DISTINCT stream) AS streams, CAST(count(DISTINCT seat) AS DOUBLE) / any_value(n) AS coverage FROM lines, (SELECT count(*) AS n FROM supplier) GROUP BY edition")
def a6(spark, d):
    total = table(spark, d, "supplier").agg(F.count("*").alias("n"))
    by = roles.lines(spark, d).groupBy("edition").agg(F.count_distinct("seat").alias("seats"), F.count("*").alias("rows_"), F.count_distinct("stream").alias("streams"))
    return by.crossJoin(F.broadcast(total)).select("edition", "seats", "rows_", "streams", (F.col("seats") / F.col("n")).alias("coverage"))  # one row


@query("a7_seat_composition", BASE + "SELECT edition, ticket, count(*) AS seats FROM win GROUP BY edition, ticket")
def a7(spark, d):
    return rollup.composition(roles.results(spark, d), ["edition"])


@query("a8_composition_by_parity", BASE + "SELECT edition, CAST(CAST(regexp_extract(winner, '[0-9]+') AS INTEGER) % 2 AS INTEGER) AS parity, count(*) AS seats FROM win GROUP BY ALL")
def a8(spark, d):
    return roles.results(spark, d).groupBy("edition", (F.regexp_extract("winner", "[0-9]+", 0).cast("int") % 2).alias("parity")).agg(F.count("*").alias("seats"))


@query("a9_summary_totals", BASE + "SELECT edition, CAST(sum(registered) AS BIGINT) AS registered, CAST(sum(valid) AS BIGINT) AS valid, CAST(sum(issued) AS BIGINT) AS issued, (SELECT count(*) FROM cand c WHERE c.edition = win.edition) AS candidates FROM win GROUP BY edition")
def a9(spark, d):
    n = roles.candidacies(spark, d).groupBy("edition").agg(F.count("*").alias("candidates"))
    return roles.contests(spark, d).groupBy("edition").agg(*(F.sum(c).alias(c) for c in ("registered", "valid", "issued"))).join(n, "edition")


@query("a10_turnout", BASE + "SELECT edition, CAST(sum(registered) AS BIGINT) AS registered, CASE WHEN sum(registered) = 0 THEN 0 ELSE CAST(sum(issued) AS BIGINT) / CAST(sum(registered) AS BIGINT) END AS turnout FROM cont GROUP BY edition")
def a10(spark, d):
    return rollup.turnout(roles.contests(spark, d).withColumn("stated", F.lit(None).cast("double")), ["edition"])


@query("a10_turnout_estimated", BASE + "SELECT edition, seat % 3 AS grp, CASE WHEN bool_and(seat % 7 <> 0) THEN sum(issued) / sum(registered) ELSE sum(registered * (seat % 10 / 10.0::DOUBLE)) / sum(registered) END AS turnout FROM cont GROUP BY edition, seat % 3")
def a10_estimated(spark, d):
    """Contests without their accounts make the group's turnout an estimate from stated percentages."""
    rows = roles.contests(spark, d).withColumns({"grp": F.col("seat") % 3, "stated": F.col("seat") % 10 / F.lit(10.0), "issued": F.when(F.col("seat") % 7 != 0, F.col("issued"))})
    return rollup.turnout(rows, ["edition", "grp"]).drop("registered")


@query("a11_state_summary", BASE + ", l AS (SELECT edition, state, ticket AS leader, n AS leader_seats FROM (SELECT edition, state, ticket, count(*) AS n, row_number() OVER (PARTITION BY edition, state ORDER BY count(*) DESC, min(seat)) AS p FROM win GROUP BY edition, state, ticket) WHERE p = 1) SELECT edition, state, count(*) AS seats, CAST(sum(registered) AS BIGINT) AS registered, CAST(sum(valid) AS BIGINT) AS valid, CAST(sum(issued) AS BIGINT) / CAST(sum(registered) AS BIGINT) AS turnout, any_value(leader) AS leader, any_value(leader_seats) AS leader_seats FROM win JOIN l USING (edition, state) GROUP BY edition, state")
def a11(spark, d):
    return state_summary(spark, d)


def state_summary(spark, d):
    """Flagship: per edition and state its seats, electors, votes, turnout and leading ticket."""
    won = roles.results(spark, d)
    counts = won.groupBy("edition", "state", "ticket").agg(F.count("*").alias("leader_seats"), F.min("seat").alias("first"))
    leader = rollup.leaders(counts, ["edition", "state"], count="leader_seats", first="first").select("edition", "state", F.col("ticket").alias("leader"), "leader_seats")
    totals = won.groupBy("edition", "state").agg(F.count("*").alias("seats"), F.sum("registered").alias("registered"), F.sum("valid").alias("valid"), (F.sum("issued") / F.sum("registered")).alias("turnout"))
    return totals.join(leader, ["edition", "state"])


_TICKETS = BASE + ", tv AS (SELECT edition, ticket, CAST(sum(votes) AS BIGINT) AS votes, count(*) AS candidates FROM cand GROUP BY edition, ticket), tw AS (SELECT edition, ticket, count(*) AS seats FROM win GROUP BY edition, ticket)"


@query("a12_edition_tickets", _TICKETS + " SELECT edition, ticket, votes, candidates, coalesce(seats, 0) AS seats, votes / CAST(sum(votes) OVER (PARTITION BY edition) AS BIGINT) AS share FROM tv LEFT JOIN tw USING (edition, ticket)")
def a12(spark, d):
    c = roles.candidacies(spark, d)
    shares = rollup.ticket_shares(c, ["edition"]).join(c.groupBy("edition", "ticket").agg(F.count("*").alias("candidates")), ["edition", "ticket"])
    seats = rollup.composition(roles.results(spark, d), ["edition"])
    return shares.join(seats, ["edition", "ticket"], "left").withColumn("seats", F.coalesce("seats", F.lit(0)))


@query("a13_state_edition_model", BASE + ", s AS (SELECT DISTINCT state FROM dim), e AS (SELECT DISTINCT edition FROM cont), f AS (SELECT state, edition, count(*) AS seats, CAST(sum(issued) AS BIGINT) / CAST(sum(registered) AS BIGINT) AS turnout FROM win GROUP BY state, edition) SELECT s.state, e.edition, seats, turnout, seats IS NOT NULL AS applicable FROM s CROSS JOIN e LEFT JOIN f ON f.state = s.state AND f.edition = e.edition")
def a13(spark, d):
    won = roles.results(spark, d)
    facts = won.groupBy("state", "edition").agg(F.count("*").alias("seats"), (F.sum("issued") / F.sum("registered")).alias("turnout"))
    full = rollup.spine(roles.seats(spark, d).select("state").distinct(), won.select("edition").distinct(), facts, ["state", "edition"])
    return full.withColumn("applicable", F.col("seats").isNotNull())


@query("a14_state_means", BASE + "SELECT edition, state, CAST(sum(margin) AS BIGINT) / count(*) AS mean_margin, CAST(sum(registered) AS BIGINT) AS registered, bool_or(margin = 0) AS any_tied FROM win GROUP BY edition, state")
def a14(spark, d):
    return roles.results(spark, d).groupBy("edition", "state").agg((F.sum("margin") / F.count("*")).alias("mean_margin"), F.sum("registered").alias("registered"), F.bool_or(F.col("margin") == 0).alias("any_tied"))


@query("a15_weighted_rate", BASE + "SELECT edition, region, CAST(sum(registered * margin) AS BIGINT) / CAST(sum(registered) AS BIGINT) AS margin FROM win GROUP BY edition, region")
def a15(spark, d):
    return rollup.weighted_rate(roles.results(spark, d), ["edition", "region"], "registered", "margin")


@query("a16_ticket_shares", BASE + "SELECT edition, seat, ticket, votes, votes / CAST(sum(votes) OVER (PARTITION BY edition, seat) AS BIGINT) AS share FROM (SELECT edition, seat, ticket, CAST(sum(votes) AS BIGINT) AS votes FROM cand GROUP BY edition, seat, ticket)")
def a16(spark, d):
    return rollup.ticket_shares(roles.candidacies(spark, d), KEYS)


@query("a17_district_groups", BASE + f"SELECT edition, seat, CASE WHEN {_SECTION} = 'postal' THEN CAST(seat AS VARCHAR) || ':postal' ELSE CAST(seat AS VARCHAR) || ':' || CAST(stream AS VARCHAR) END AS district, CAST(sum(q) AS BIGINT) AS ballots, count(DISTINCT candidate) AS candidates FROM lines GROUP BY ALL")
def a17(spark, d):
    district = F.when(F.col("section") == "postal", F.concat(F.col("seat").cast("string"), F.lit(":postal"))).otherwise(F.concat_ws(":", "seat", "stream"))
    return _streams(spark, d).groupBy(*KEYS, district.alias("district")).agg(F.sum("q").alias("ballots"), F.count_distinct("candidate").alias("candidates"))


@query("a18_section_matrix", BASE + "SELECT candidate, " + ", ".join(f"CAST(sum(CASE WHEN {_SECTION} = '{s}' THEN q END) AS BIGINT) AS {s}" for s in ("postal", "early", "ordinary")) + " FROM lines WHERE flag = 'N' GROUP BY candidate")
def a18(spark, d):
    return rollup.matrix(_streams(spark, d).where("flag = 'N'"), "candidate", "section", ["postal", "early", "ordinary"], "q")


@query("a20_children_with_flag", BASE + "SELECT state, count(*) AS seats, CAST(sum(registered) AS BIGINT) AS registered, count(*) FILTER (WHERE registered > 3000) AS large FROM dim JOIN reg USING (seat) GROUP BY state")
def a20(spark, d):
    return roles.seats(spark, d).join(roles.registered(spark, d), "seat").groupBy("state").agg(F.count("*").alias("seats"), F.sum("registered").alias("registered"), F.count_if(F.col("registered") > 3000).alias("large"))


_BANDS = "count(*) FILTER (WHERE p_size < 15) AS young, count(*) FILTER (WHERE p_size BETWEEN 15 AND 35) AS middle, count(*) FILTER (WHERE p_size > 35) AS old"


@query("a21_bands_and_largest", f"SELECT *, CASE WHEN young >= middle AND young >= old THEN 'young' WHEN middle >= old THEN 'middle' ELSE 'old' END AS largest FROM (SELECT p_type, {_BANDS} FROM part GROUP BY p_type)")
def a21(spark, d):
    bands = table(spark, d, "part").groupBy("p_type").agg(F.count_if(F.col("p_size") < 15).alias("young"), F.count_if(F.col("p_size").between(15, 35)).alias("middle"), F.count_if(F.col("p_size") > 35).alias("old"))
    first = F.when((F.col("young") >= F.col("middle")) & (F.col("young") >= F.col("old")), "young").when(F.col("middle") >= F.col("old"), "middle").otherwise("old")
    return bands.withColumn("largest", first)


@query("a22_national_from_states", "SELECT 'all' AS name, count(*) AS total, " + _BANDS + " FROM part")
def a22(spark, d):
    return a21(spark, d).agg(F.lit("all").alias("name"), F.sum(F.col("young") + F.col("middle") + F.col("old")).alias("total"), *(F.sum(c).alias(c) for c in ("young", "middle", "old")))


@query("a24_edition_roll_up", BASE + "SELECT region, min(edition) AS first_edition, max(edition) AS last_edition, count(DISTINCT seat) AS seats, CAST(sum(issued) AS BIGINT) AS issued FROM win GROUP BY region")
def a24(spark, d):
    return roles.results(spark, d).groupBy("region").agg(F.min("edition").alias("first_edition"), F.max("edition").alias("last_edition"), F.count_distinct("seat").alias("seats"), F.sum("issued").alias("issued"))


@query("a27_distinct_counts", BASE + "SELECT edition, count(DISTINCT candidate) AS candidates, count(DISTINCT ticket) AS tickets, count(DISTINCT seat) AS seats FROM cand GROUP BY edition")
def a27(spark, d):
    return roles.candidacies(spark, d).groupBy("edition").agg(*(F.count_distinct(c).alias(n) for c, n in (("candidate", "candidates"), ("ticket", "tickets"), ("seat", "seats"))))


@query("a29_modal_ticket", BASE + "SELECT candidate, winner_of FROM (SELECT winner AS candidate, region AS winner_of, row_number() OVER (PARTITION BY winner ORDER BY count(*) DESC, min(edition * 100000 + seat)) AS p FROM win GROUP BY winner, region) WHERE p = 1")
def a29(spark, d):
    counts = roles.results(spark, d).groupBy(F.col("winner").alias("candidate"), F.col("region").alias("winner_of")).agg(F.count("*").alias("n"), F.min(F.col("edition") * 100000 + F.col("seat")).alias("first"))
    return rollup.leaders(counts, ["candidate"], ticket="winner_of", count="n", first="first").select("candidate", "winner_of")


@query("a32_profile_shares", BASE + "SELECT seat, registered, registered / greatest(1, CAST(sum(registered) OVER () AS BIGINT)) AS national_share FROM reg")
def a32(spark, d):
    reg = roles.registered(spark, d)
    total = reg.agg(F.sum("registered").alias("total"))
    return reg.crossJoin(F.broadcast(total)).select("seat", "registered", ratio_at_least_one(F.col("registered"), F.col("total")).alias("national_share"))  # one row


@query("a33_mean_candidates_and_majority", BASE + "SELECT edition, count(*) / count(DISTINCT seat) AS mean_candidates, count(DISTINCT seat) // 2 + 1 AS majority FROM cand GROUP BY edition")
def a33(spark, d):
    n = F.count_distinct("seat")
    return roles.candidacies(spark, d).groupBy("edition").agg((F.count("*") / n).alias("mean_candidates"), (F.floor(n / 2) + 1).alias("majority"))


@query("a34_top_and_others", BASE + "SELECT label, CAST(sum(n) AS BIGINT) AS n FROM (SELECT CASE WHEN row_number() OVER (ORDER BY count(*) DESC, winner) <= 9 THEN winner ELSE 'others' END AS label, count(*) AS n FROM win GROUP BY winner) GROUP BY label")
def a34(spark, d):
    return rollup.top_and_others(roles.results(spark, d).groupBy(F.col("winner").alias("label")).agg(F.count("*").alias("n")), "label", "n")


@query("a35_children_lists", BASE + "SELECT region, string_agg(state, ',' ORDER BY state) AS states FROM (SELECT DISTINCT region, state FROM dim) GROUP BY region")
def a35(spark, d):
    return roles.seats(spark, d).groupBy("region").agg(F.array_join(F.sort_array(F.collect_set("state")), ",").alias("states"))


@query("a36_single_value", "SELECT o_custkey % 100 AS grp, CASE WHEN count(DISTINCT nullif(o_orderkey % 3, 0)) >= 1 THEN min(nullif(o_orderkey % 3, 0)) ELSE 0 END AS value, count(DISTINCT nullif(o_orderkey % 3, 0)) > 1 AS several FROM orders GROUP BY o_custkey % 100")
def a36(spark, d):
    rows = table(spark, d, "orders").select((F.col("o_custkey") % 100).alias("grp"), (F.col("o_orderkey") % 3).alias("value"))
    return rollup.single_value(rows, ["grp"], "value")


@query("a37_cross_edition_matrix", BASE + ", s AS (SELECT DISTINCT state FROM dim), e AS (SELECT DISTINCT edition FROM cont), l AS (SELECT edition, state, ticket, n FROM (SELECT edition, state, ticket, count(*) AS n, row_number() OVER (PARTITION BY edition, state ORDER BY count(*) DESC, ticket) AS p FROM win GROUP BY edition, state, ticket) WHERE p = 1) SELECT s.state, e.edition, coalesce(ticket, 'no seats') AS leader, n AS seats FROM s CROSS JOIN e LEFT JOIN l ON l.state = s.state AND l.edition = e.edition")
def a37(spark, d):
    won = roles.results(spark, d)
    lead = rollup.leaders(rollup.composition(won, ["edition", "state"]), ["edition", "state"])
    full = rollup.spine(roles.seats(spark, d).select("state").distinct(), won.select("edition").distinct(), lead, ["state", "edition"])
    return full.select("state", "edition", F.coalesce("ticket", F.lit("no seats")).alias("leader"), "seats")


@query("a38_chart_series", BASE + "SELECT ticket, " + ", ".join(f"CAST(sum(CASE WHEN edition = {y} THEN 1 END) AS BIGINT) AS e{y}" for y in range(1995, 2002)) + " FROM win GROUP BY ticket")
def a38(spark, d):
    wide = rollup.matrix(roles.results(spark, d).withColumn("one", F.lit(1)), "ticket", "edition", range(1995, 2002), "one")
    return wide.select("ticket", *(F.col(str(y)).alias(f"e{y}") for y in range(1995, 2002)))


@query("a39_scoped_composition", BASE + "SELECT ticket, count(*) AS seats FROM win WHERE region = (SELECT min(region) FROM dim) AND edition = 2000 GROUP BY ticket")
def a39(spark, d):
    first = roles.seats(spark, d).agg(F.min("region").alias("region"))
    scope = roles.results(spark, d).where("edition = 2000").join(F.broadcast(first), "region", "left_semi")  # one row
    return rollup.composition(scope, [])


@query("a40_change_counts", BASE + "SELECT n.edition, count(DISTINCT n.seat) FILTER (WHERE n.winner <> b.winner) AS seats_changed, count(DISTINCT n.winner) FILTER (WHERE n.winner <> b.winner) AS new_winners FROM win n JOIN win b ON b.seat = n.seat AND b.edition = n.edition - 1 GROUP BY n.edition")
def a40(spark, d):
    diff = _differences(spark, d).where("has_baseline")
    return diff.groupBy("edition").agg(F.count_distinct(F.when(F.col("changed"), F.col("seat"))).alias("seats_changed"), F.count_distinct(F.when(F.col("changed"), F.col("winner"))).alias("new_winners"))


_BEFORE = BASE + "SELECT n.edition, n.seat, coalesce(b.winner IS NOT NULL AND b.winner <> n.winner, false) AS changed, n.margin - b.margin AS margin_change, n.turnout - b.turnout AS turnout_change FROM win n LEFT JOIN win b ON b.seat = n.seat AND b.edition = n.edition - 1"


@query("c1_change_of_hands", "SELECT edition, seat, changed FROM (" + _BEFORE + ")")
def c1(spark, d):
    return _differences(spark, d).select(*KEYS, "changed")


@query("c2_margin_change", "SELECT edition, seat, margin_change FROM (" + _BEFORE + ")")
def c2(spark, d):
    return _differences(spark, d).select(*KEYS, "margin_change")


@query("c3_turnout_change", "SELECT edition, seat, turnout_change FROM (" + _BEFORE + ")")
def c3(spark, d):
    return _differences(spark, d).select(*KEYS, "turnout_change")


@query("c4_swing", BASE + ", ts AS (SELECT edition, seat, ticket, votes / CAST(sum(votes) OVER (PARTITION BY edition, seat) AS BIGINT) AS share FROM (SELECT edition, seat, ticket, CAST(sum(votes) AS BIGINT) AS votes FROM cand GROUP BY edition, seat, ticket)), old AS (SELECT DISTINCT edition + 1 AS edition, seat FROM ts) SELECT w.edition, w.seat, CASE WHEN o.seat IS NOT NULL THEN n.share - coalesce(b.share, 0) END AS swing FROM win w JOIN ts n ON n.edition = w.edition AND n.seat = w.seat AND n.ticket = w.ticket LEFT JOIN old o ON o.edition = w.edition AND o.seat = w.seat LEFT JOIN ts b ON b.edition = w.edition - 1 AND b.seat = w.seat AND b.ticket = w.ticket")
def c4(spark, d):
    shares = rollup.ticket_shares(roles.candidacies(spark, d), KEYS)
    now = roles.results(spark, d).select(*KEYS, "ticket").join(shares.drop("votes"), [*KEYS, "ticket"])
    before = rollup.share_map(shares, KEYS).withColumn("edition", F.col("edition") + 1)
    return compare.swing(now, before, KEYS).select(*KEYS, "swing")


@query("c5_missing_baseline", BASE + "SELECT n.edition, count(*) FILTER (WHERE b.seat IS NULL) AS without_baseline, count(*) AS seats FROM win n LEFT JOIN win b ON b.seat = n.seat AND b.edition = n.edition - 1 GROUP BY n.edition")
def c5(spark, d):
    return _differences(spark, d).groupBy("edition").agg(F.count_if(~F.col("has_baseline")).alias("without_baseline"), F.count("*").alias("seats"))


@query("c7_metric_selector", BASE + "SELECT edition, metric, value FROM (SELECT edition, count(*) AS seats, CAST(sum(registered) AS BIGINT) AS voters, CAST(sum(valid) AS BIGINT) AS votes FROM win GROUP BY edition) UNPIVOT (value FOR metric IN (seats, voters, votes))")
def c7(spark, d):
    wide = roles.results(spark, d).groupBy("edition").agg(F.count("*").alias("seats"), F.sum("registered").alias("voters"), F.sum("valid").alias("votes"))
    return wide.unpivot(["edition"], ["seats", "voters", "votes"], "metric", "value")


@query("p17_insights", BASE + "SELECT edition, seat, concat_ws(',', CASE WHEN margin / valid <= 0.05 THEN 'close' END, CASE WHEN winner = 'Brand#1' THEN 'changed' END, CASE WHEN turnout >= 0.8 THEN 'high-turnout' END, CASE WHEN turnout < 0.6 THEN 'low-turnout' END, CASE WHEN abs(margin) >= 0.08 THEN 'large-change' END) AS labels FROM win")
def p17(spark, d):
    labels = compare.insights(F.col("margin") / F.col("valid"), F.col("winner") == "Brand#1", F.col("turnout"), F.col("margin"))
    return roles.results(spark, d).select(*KEYS, F.array_join(labels, ",").alias("labels"))


@query("p18_uncontested", BASE + "SELECT edition, seat FROM cand GROUP BY edition, seat HAVING count(*) = 1 AND sum(votes) = 0")
def p18(spark, d):
    return roles.candidacies(spark, d).groupBy(*KEYS).agg(F.count("*").alias("n"), F.sum("votes").alias("v")).where("n = 1 and v = 0").select(*KEYS)


@query("p21_denormalised_results", BASE + "SELECT edition, seat, state, region, winner, ticket, votes, margin, share, turnout, CAST(seat AS VARCHAR) || ' ' || state || ' / ' || winner AS label FROM win")
def p21(spark, d):
    return roles.results(spark, d).select(*KEYS, "state", "region", "winner", "ticket", "votes", "margin", "share", "turnout", F.concat(F.col("seat").cast("string"), F.lit(" "), "state", F.lit(" / "), "winner").alias("label"))


@query("o2_multi_key_sort", BASE + "SELECT edition, ticket, count(*) AS seats, CAST(row_number() OVER (PARTITION BY edition ORDER BY count(*) DESC, ticket) AS INTEGER) AS place FROM win GROUP BY edition, ticket")
def o2(spark, d):
    counts = rollup.composition(roles.results(spark, d), ["edition"])
    return counts.withColumn("place", F.row_number().over(Window.partitionBy("edition").orderBy(F.desc("seats"), "ticket")))


@query("o4_closest_contests", BASE + "SELECT edition, seat, margin FROM win ORDER BY margin, edition, seat LIMIT 5")
def o4(spark, d):
    return roles.results(spark, d).select(*KEYS, "margin").orderBy("margin", "edition", "seat").limit(5)


@query("o5_top_tickets", BASE + "SELECT edition, ticket, seats FROM (SELECT edition, ticket, count(*) AS seats, row_number() OVER (PARTITION BY edition ORDER BY count(*) DESC, ticket) AS p FROM win GROUP BY edition, ticket) WHERE p <= 4")
def o5(spark, d):
    return o2(spark, d).where("place <= 4").select("edition", "ticket", "seats")


@query("j11_baseline_self_join", BASE + "SELECT n.edition, n.seat, n.winner, b.winner AS before_winner FROM win n LEFT JOIN win b ON b.seat = n.seat AND b.edition = n.edition - 1")
def j11(spark, d):
    return _differences(spark, d).select(*KEYS, "winner", "before_winner")


@query("j28_adjacent_contests", BASE + "SELECT edition, seat, lag(winner) OVER (PARTITION BY edition ORDER BY seat) AS previous_winner, lead(winner) OVER (PARTITION BY edition ORDER BY seat) AS next_winner FROM win")
def j28(spark, d):
    return contest.neighbours(roles.results(spark, d).select(*KEYS, "winner"), ["edition"], ["seat"], "winner").drop("winner")


@query("e7_detail_overrides_headline", BASE + ", fixed AS (SELECT edition, seat, candidate, CASE WHEN seat % 10 = 0 AND candidate = 'Brand#5' THEN votes + 50 ELSE votes END AS votes FROM cand) SELECT edition, seat, candidate, votes FROM (SELECT *, row_number() OVER (PARTITION BY edition, seat ORDER BY votes DESC, candidate) AS p FROM fixed) WHERE p = 1")
def e7(spark, d):
    headline = roles.candidacies(spark, d)
    detail = headline.where("seat % 10 = 0 and candidate = 'Brand#5'").withColumn("votes", F.col("votes") + 50)
    return contest.winners(contest.override(headline, detail, KEYS)).select(*KEYS, "candidate", "votes")


@query("n17_safe_ratios", "SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN 0.0 ELSE o_custkey / (o_orderkey % 3) END AS zero, o_custkey / greatest(o_orderkey % 3, 1) AS one FROM orders")
def n17(spark, d):
    o = table(spark, d, "orders")
    return o.select("o_orderkey", ratio_or_zero(F.col("o_custkey"), F.col("o_orderkey") % 3).alias("zero"), ratio_at_least_one(F.col("o_custkey"), F.col("o_orderkey") % 3).alias("one"))
