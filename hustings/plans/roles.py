"""The election roles on the star schema, and a registry of queries with their SQL.

edition = year of shipping, seat = supplier, candidate = brand, votes = quantity returned as N, rejected = R,
unreturned = A, state and region = nation and region of the supplier, registered = the seat's total of all editions.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from hustings.operators import contest
from hustings.sources.readers import table

Query = Callable[[SparkSession, str], DataFrame]


class Registry:
    def __init__(self) -> None:
        self.queries: dict[str, Query] = {}
        self.oracles: dict[str, str] = {}

    def query(self, name: str, sql: str | None = None) -> Callable[[Query], Query]:
        def add(f: Query) -> Query:
            assert name not in self.queries
            self.queries[name] = f
            if sql is not None:
                self.oracles[name] = sql
            return f

        return add


KEYS = ["edition", "seat"]

#: Common table expressions of the SQL side, as the functions below have them.
BASE = """WITH lines AS (SELECT CAST(year(l_shipdate) AS INTEGER) AS edition, l_suppkey AS seat, p_brand AS candidate, CAST(regexp_extract(p_brand, '[0-9]+') AS INTEGER) % 5 AS t, l_returnflag AS flag, CAST(l_quantity AS BIGINT) AS q, l_linenumber AS stream, l_orderkey AS orderkey FROM lineitem JOIN part ON l_partkey = p_partkey),
cand AS (SELECT edition, seat, candidate, 'A' || CAST(t AS VARCHAR) AS ticket, CAST(sum(q) AS BIGINT) AS votes FROM lines WHERE flag = 'N' GROUP BY edition, seat, candidate, t),
reg AS (SELECT seat, CAST(sum(q) AS BIGINT) AS registered FROM lines GROUP BY seat),
cont AS (SELECT edition, seat, CAST(sum(CASE WHEN flag = 'N' THEN q ELSE 0 END) AS BIGINT) AS valid, CAST(sum(CASE WHEN flag = 'R' THEN q ELSE 0 END) AS BIGINT) AS rejected, CAST(sum(CASE WHEN flag = 'A' THEN q ELSE 0 END) AS BIGINT) AS unreturned, CAST(sum(q) AS BIGINT) AS issued, any_value(registered) AS registered FROM lines JOIN reg USING (seat) GROUP BY edition, seat),
dim AS (SELECT s_suppkey AS seat, n_name AS state, r_name AS region FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey),
ranked AS (SELECT *, CAST(row_number() OVER w AS INTEGER) AS position, votes - coalesce(lead(votes) OVER w, 0) AS margin_votes, CAST(sum(votes) OVER (PARTITION BY edition, seat) AS BIGINT) AS contest_votes FROM cand WINDOW w AS (PARTITION BY edition, seat ORDER BY votes DESC, candidate)),
win AS (SELECT r.edition, r.seat, state, region, candidate AS winner, ticket, votes, margin_votes AS margin, votes / contest_votes AS share, issued, registered, valid, issued / registered AS turnout FROM ranked r JOIN cont USING (edition, seat) JOIN dim USING (seat) WHERE position = 1)
"""


def lines(spark: SparkSession, d: str) -> DataFrame:
    part = table(spark, d, "part").select("p_partkey", F.col("p_brand").alias("candidate"))
    own = table(spark, d, "lineitem").select(F.year("l_shipdate").alias("edition"), F.col("l_suppkey").alias("seat"), F.col("l_partkey").alias("p_partkey"), F.col("l_returnflag").alias("flag"), F.col("l_quantity").cast("bigint").alias("q"), F.col("l_linenumber").alias("stream"), F.col("l_orderkey").alias("orderkey"))
    return own.join(part, "p_partkey").withColumn("ticket", F.concat(F.lit("A"), (F.regexp_extract("candidate", "[0-9]+", 0).cast("int") % 5).cast("string")))


def candidacies(spark: SparkSession, d: str) -> DataFrame:
    return lines(spark, d).where("flag = 'N'").groupBy(*KEYS, "candidate", "ticket").agg(F.sum("q").alias("votes"))


def registered(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "lineitem").groupBy(F.col("l_suppkey").alias("seat")).agg(F.sum(F.col("l_quantity").cast("bigint")).alias("registered"))


def contests(spark: SparkSession, d: str) -> DataFrame:
    part = lambda flag: F.when(F.col("l_returnflag") == flag, F.col("l_quantity").cast("bigint")).otherwise(0)
    rows = table(spark, d, "lineitem").select(F.year("l_shipdate").alias("edition"), F.col("l_suppkey").alias("seat"), part("N").alias("valid"), part("R").alias("rejected"), part("A").alias("unreturned"))
    # Every line has one of the three flags, so a seat's total of all editions is the sum of what was issued.
    return contest.accounts(rows, KEYS).withColumn("registered", F.sum("issued").over(Window.partitionBy("seat")))


def seats(spark: SparkSession, d: str) -> DataFrame:
    n = table(spark, d, "nation").join(table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey")).select("n_nationkey", F.col("n_name").alias("state"), F.col("r_name").alias("region"))
    return table(spark, d, "supplier").join(F.broadcast(n), F.col("s_nationkey") == F.col("n_nationkey")).select(F.col("s_suppkey").alias("seat"), "state", "region")  # 25 nations


def ranked(spark: SparkSession, d: str) -> DataFrame:
    return contest.rank_candidates(candidacies(spark, d), KEYS)


def results(spark: SparkSession, d: str) -> DataFrame:
    """One row per contest: its winner, margin, share, turnout and place."""
    won = contest.winners(ranked(spark, d)).select(*KEYS, F.col("candidate").alias("winner"), "ticket", "votes", F.col("margin_votes").alias("margin"), "share", "margin_share")
    return won.join(contests(spark, d), KEYS).join(seats(spark, d), "seat").withColumn("turnout", F.col("issued") / F.col("registered"))


def status_events(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").select("user_id", F.col("event_id").alias("ordinal"), F.to_date("ts").alias("effective_date"), F.col("ts").alias("created_at"), F.col("event_type").alias("status"), "value")
