"""Operator 12: the trie of conversations' prefixes, by a van Emde Boas recursion over depth.

A node is a distinct sequence of first turns; its name is its depth and the smallest conversation that starts with it.

Down: sequences are cut at half depth. A prefix up to the cut is named by the name above and a hash of the turns between
(so two prefixes of one length are compared by one row each, whatever lies between); the upper part and all lower forests
are then cut at half their depth in the same way, all of them in one round. After log2(depth) rounds every prefix has its
name. Hashes of blocks of 1, 2, 4 ... turns are made from those of half the size.

Up: each node starts with its own totals. Blocks of 1, 2, 4 ... levels are joined in pairs: the totals of the lower
block's roots are grafted onto the nodes above them in the upper block. After log2(depth) rounds each node has the totals
of its subtree.

Turns are numbered over ranges of (conversation, turn), so that a huge conversation is dealt over tasks; groups are
combined before they are shuffled, and what is joined back can be split where a name is hot. The members that end at a
node are sorted and joined into bounded pieces by ranges; only the digest itself goes over the pieces in sequence.

Defined results: rows without a conversation are left out; turns of one number follow a hash of role and text; null role
or text is empty; repeated rows are turns of their own; other columns are not carried, so their names can't clash; an
empty table gives an empty table.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from hustings.llm.common import cut, table

#: So many ids make one piece of a node's list of ends.
PIECE = 4096


def numbered(conversations: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(conv, depth, a, b, bytes): turns numbered from 1, with two hashes of role and text."""
    role_col, text_col = (F.coalesce(F.col(f"`{c}`"), F.lit("")) for c in (role, text))
    rows = conversations.select(
        F.col(f"`{conv}`").cast("long").alias("conv"), F.col(f"`{turn}`").alias("turn"), F.xxhash64(role_col, text_col).alias("a"), F.xxhash64(F.lit(1), text_col, role_col).alias("b"), F.octet_length(text_col).cast("long").alias("bytes"),
    ).where("conv is not null")

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, first, last, count = TaskContext.get().partitionId(), None, None, 0
        for batch in batches:
            if not batch.num_rows:
                continue
            own = batch.column("conv").to_numpy()
            first = own[0] if first is None else first
            opens = np.concatenate([[own[0] != last], own[1:] != own[:-1]])
            since = np.maximum.accumulate(np.where(opens, np.arange(len(own)), -1))
            nr = np.where(since >= 0, np.arange(len(own)) - since + 1, np.arange(len(own)) + count + 1)
            last, count = own[-1], int(nr[-1])
            columns = [batch.column(x) for x in ("conv", "a", "b", "bytes")]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(nr), pa.array(np.full(len(own), part)), pa.array(own == first)], ["conv", "a", "b", "bytes", "nr", "part", "head"])

    ranged = rows.repartitionByRange("conv", F.col("turn").asc_nulls_first()).sortWithinPartitions("conv", F.col("turn").asc_nulls_first(), "a", "b")
    parts = cut(ranged.mapInArrow(number, "conv long, a long, b long, bytes long, nr long, part long, head boolean"))
    # A conversation goes on in the next part only from a part's last conversation: a row or two for each part.
    ends = parts.groupBy("part").agg(F.min("conv").alias("first"), F.count_if("head").alias("n"), F.max(F.struct("conv", "nr")).alias("last"))
    counted = ends.select("part", F.explode(F.array_distinct(F.array(F.struct(F.col("first").alias("conv"), F.col("n").alias("nr")), "last"))).alias("x")).select("part", "x.conv", "x.nr")
    before = counted.withColumn("before", F.sum("nr").over(Window.partitionBy("conv").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)))
    placed = parts.join(F.broadcast(before.where("before > 0").select("part", "conv", "before")), ["part", "conv"], "left")  # as many rows as parts, at most
    return placed.select("conv", (F.col("nr") + F.coalesce("before", F.lit(0))).alias("depth"), "a", "b", "bytes")


def _names(rows: DataFrame, members: DataFrame, deepest: int) -> DataFrame:
    """(conv, depth, name) of every prefix of every conversation, the empty one included."""
    root = members.agg(F.min("conv").alias("name"))
    names = members.select("conv", F.lit(0).cast("long").alias("depth")).crossJoin(F.broadcast(root))  # one row
    blocks, size = {}, 1
    block = rows.select("conv", (F.col("depth") - 1).alias("block"), F.xxhash64("a", "depth", "b").alias("a"), F.xxhash64("b", "depth", "a").alias("b"))
    while size <= deepest:
        blocks[size] = block = cut(block)
        size *= 2
        block = block.groupBy("conv", F.floor(F.col("block") / 2).alias("block")).agg(F.bit_xor("a").alias("a"), F.bit_xor("b").alias("b"))
    for size, block in reversed(blocks.items()):
        whole = block.where("block % 2 = 0").select("conv", (F.col("block") * size).alias("depth"), "a", "b").join(members, "conv").where(F.col("size") >= F.col("depth") + size).drop("size")
        upper = cut(whole.join(names, ["conv", "depth"]).select("conv", (F.col("depth") + size).alias("depth"), F.col("name").alias("upper"), "a", "b"))
        key = ["depth", "upper", "a", "b"]
        least = upper.groupBy(*key).agg(F.min("conv").alias("name"))
        names = names.unionByName(cut(upper.join(least, key).select("conv", "depth", "name")))
    return names


def _subtrees(own: DataFrame, names: DataFrame, deepest: int, totals: list[str]) -> DataFrame:
    """(depth, name, totals) with each node's totals summed over its subtree; own: the nodes' own totals."""
    parts, size = [own.select("depth", "name", *totals)], 1
    sums = [F.sum(c).alias(c) for c in totals]
    while size <= deepest:
        both = parts[0]
        for part in parts[1:]:
            both = both.unionByName(part)
        roots = both.where(F.col("depth") % (2 * size) == size).groupBy("depth", "name").agg(*sums)
        roots = roots.select(F.col("name").alias("conv"), F.floor(F.col("depth") / (2 * size)).alias("block"), *totals)
        above = names.where(F.col("depth") % (2 * size) < size).withColumn("block", F.floor(F.col("depth") / (2 * size)))
        parts.append(cut(roots.join(above, ["conv", "block"]).groupBy("depth", "name").agg(*sums)))
        size *= 2
    both = parts[0]
    for part in parts[1:]:
        both = both.unionByName(part)
    return both.groupBy("depth", "name").agg(*sums)


def end_digests(ends: DataFrame) -> DataFrame:
    """(depth, name, digest): SHA-256 of each node's ascending, comma-joined conversations; rows of (depth, name, conv)."""

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            depth, name, conv = (batch.column(x).to_numpy() for x in ("depth", "name", "conv"))
            edges = np.flatnonzero(np.concatenate([[True], (depth[1:] != depth[:-1]) | (name[1:] != name[:-1]), [True]]))
            starts = np.concatenate([np.arange(a, b, PIECE) for a, b in zip(edges[:-1], edges[1:], strict=True)])
            stops = np.append(starts[1:], len(conv))
            lists = [",".join(map(str, conv[a:b].tolist())) for a, b in zip(starts, stops, strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(depth[starts]), pa.array(name[starts]), pa.array(conv[starts]), pa.array(lists)], ["depth", "name", "first", "list"])

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, sha = None, hashlib.sha256()
        names = ["depth", "name", "digest"]
        for batch in batches:
            out = []
            for depth, name, part in zip(*(batch.column(x).to_pylist() for x in ("depth", "name", "list")), strict=True):
                if (depth, name) != now:
                    if now is not None:
                        out.append((*now, sha.hexdigest()))
                    now, sha = (depth, name), hashlib.sha256(part.encode())
                else:
                    sha.update(f",{part}".encode())
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*out, strict=True)], names)
        if now is not None:
            yield pa.RecordBatch.from_arrays([pa.array([x]) for x in (*now, sha.hexdigest())], names)

    key = ["depth", "name"]
    lists = cut(ends.repartitionByRange(*key, "conv").sortWithinPartitions(*key, "conv").mapInArrow(join, "depth long, name long, first long, list string"))
    return lists.repartition(*key).sortWithinPartitions(*key, "first").mapInArrow(digest, "depth long, name long, digest string")


def prefix_trie(rows: DataFrame, members: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(nodes, names). rows: (conv, depth, a, b, bytes), depth from 1 to the conversation's size; members: (conv, size).

    nodes: depth, name, parent, n_convs, n_children, n_leaves, saved (each member but one of each node of the subtree
    saves its last turn's bytes), ends. names: conv, depth, name of every prefix."""
    rows, members = cut(rows), cut(members)
    deepest = members.agg(F.max("size")).first()[0] or 0
    names = cut(_names(rows, members, deepest))
    nodes = names.groupBy("depth", "name").agg(F.count("*").alias("n_convs"))
    last = rows.select(F.col("conv").alias("name"), "depth", "bytes")
    above = names.select(F.col("conv").alias("name"), (F.col("depth") + 1).alias("depth"), F.col("name").alias("parent"))
    nodes = cut(nodes.join(last, ["name", "depth"], "left").join(above, ["name", "depth"], "left"))
    children = nodes.where("depth > 0").groupBy((F.col("depth") - 1).alias("depth"), F.col("parent").alias("name")).agg(F.count("*").alias("n_children"))
    nodes = cut(nodes.join(children, ["depth", "name"], "left").withColumn("n_children", F.coalesce("n_children", F.lit(0))))
    own = nodes.select("depth", "name", (F.col("n_children") == 0).cast("long").alias("n_leaves"), ((F.col("n_convs") - 1) * F.coalesce("bytes", F.lit(0))).alias("saved"))
    totals = _subtrees(own, names, deepest, ["n_leaves", "saved"])
    ends = end_digests(cut(names.join(members.withColumnRenamed("size", "depth"), ["conv", "depth"]).select("depth", "name", "conv")))
    full = nodes.join(totals, ["depth", "name"]).join(ends, ["depth", "name"], "left")
    return full.select("depth", "name", "parent", "n_convs", "n_children", "n_leaves", "saved", F.coalesce("digest", F.sha2(F.lit(""), 256)).alias("ends")), names


def rebuilt(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows, members) of the contract's conversations: the first h turns of conversation c - c % 5, then those of c after
    its own first h, where h is a checksum of c modulo 9."""
    turns = cut(turns)
    sizes = turns.groupBy("conv").agg(F.count("*").alias("n"))
    own = sizes.select("conv", "n", (F.col("conv") - F.col("conv") % 5).alias("base"), (F.crc32(F.col("conv").cast("string")) % 9).alias("h"))
    plan = own.join(sizes.select(F.col("conv").alias("base"), F.col("n").alias("n_base")), "base", "left")
    plan = cut(plan.select("conv", "base", "h", F.least("h", F.coalesce("n_base", F.lit(0))).alias("head"), F.greatest(F.col("n") - F.col("h"), F.lit(0)).alias("rest")))
    later = turns.join(plan.select("conv", "h", "head"), "conv").where(F.col("depth") > F.col("h")).withColumn("depth", F.col("depth") - F.col("h") + F.col("head")).drop("h", "head")
    first = turns.where("depth <= 8").withColumnRenamed("conv", "base").join(plan.select("conv", "base", "h"), "base").where(F.col("depth") <= F.col("h"))
    return later.unionByName(first.select(*later.columns)), plan.select("conv", (F.col("head") + F.col("rest")).alias("size"))


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes, _ = prefix_trie(*rebuilt(numbered(table(spark, sf_dir, "conversations"))))
    names = {"name": "conv_id", "parent": "parent_conv_id", "saved": "saved_tokens", "ends": "ends_sha256"}
    return nodes.withColumnsRenamed(names).select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")


QUERIES = {"op12_prefix_trie": op12_prefix_trie}
#: The checksum bit by bit; a node is a depth and the list of its turns, a subtree the nodes whose list begins with its own.
ORACLES = {"op12_prefix_trie": """WITH t AS MATERIALIZED (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST) AS p, {'r': coalesce(role, ''), 'x': coalesce(text, '')} AS turn FROM conversations WHERE conv_id IS NOT NULL),
ids AS MATERIALIZED (SELECT conv_id, CAST(conv_id AS VARCHAR) AS s FROM (SELECT DISTINCT conv_id FROM t)),
sums AS MATERIALIZED (SELECT conv_id, CAST(xor(list_reduce(list_prepend(4294967295, range(0, 8 * length(s))), lambda c, i: CASE WHEN (xor(c, CASE WHEN i % 8 = 0 THEN ascii(substr(s, i // 8 + 1, 1)) ELSE 0 END) & 1) = 1 THEN xor(xor(c, CASE WHEN i % 8 = 0 THEN ascii(substr(s, i // 8 + 1, 1)) ELSE 0 END) >> 1, 3988292384) ELSE xor(c, CASE WHEN i % 8 = 0 THEN ascii(substr(s, i // 8 + 1, 1)) ELSE 0 END) >> 1 END), 4294967295) % 9 AS BIGINT) AS h FROM ids),
r AS (SELECT s.conv_id, 0 AS part, p, turn FROM sums s JOIN t ON t.conv_id = s.conv_id - s.conv_id % 5 AND p <= h UNION ALL SELECT s.conv_id, 1, p, turn FROM sums s JOIN t ON t.conv_id = s.conv_id AND p > h),
l AS MATERIALIZED (SELECT conv_id, coalesce(turns, []) AS turns FROM ids LEFT JOIN (SELECT conv_id, list(turn ORDER BY part, p) AS turns FROM r GROUP BY conv_id) USING (conv_id)),
m AS MATERIALIZED (SELECT conv_id, d AS depth, list_slice(turns, 1, d) AS k, d = len(turns) AS ends FROM l, LATERAL (SELECT unnest(range(0, len(turns) + 1)) AS d)),
n AS MATERIALIZED (SELECT depth, k, min(conv_id) AS conv_id, count(*) AS n_convs, coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (WHERE ends), '') AS done FROM m GROUP BY depth, k),
u AS MATERIALIZED (SELECT n.*, (SELECT count(*) FROM n c WHERE c.depth = n.depth + 1 AND list_slice(c.k, 1, n.depth) = n.k) AS n_children FROM n)
SELECT u.conv_id, CAST(u.depth AS BIGINT) AS depth, p.conv_id AS parent_conv_id, u.n_convs, u.n_children, CAST(s.n_leaves AS BIGINT) AS n_leaves, CAST(s.saved_tokens AS BIGINT) AS saved_tokens, sha256(u.done) AS ends_sha256 FROM u LEFT JOIN n p ON p.depth = u.depth - 1 AND p.k = list_slice(u.k, 1, u.depth - 1)
JOIN (SELECT a.depth, a.k, sum(CASE WHEN b.n_children = 0 THEN 1 ELSE 0 END) AS n_leaves, sum((b.n_convs - 1) * CASE WHEN b.depth = 0 THEN 0 ELSE strlen(b.k[-1].x) END) AS saved_tokens FROM u a JOIN u b ON b.depth >= a.depth AND list_slice(b.k, 1, a.depth) = a.k GROUP BY a.depth, a.k) s ON s.depth = u.depth AND s.k = u.k"""}
