"""Operator 10: approximate nearest neighbours by shifted space-filling curves.

Vectors are projected onto several random subspaces; in each, a shifted Hilbert curve gives them an order. Spark
range-partitions every order, so that each vector has a rank on each curve; a query's candidates are the vectors within
a window of ranks around it on any curve, cut into blocks of ranks. Each block ranks its candidates by the inner product
in double precision, and a query's best over all blocks are merged.

For inner products of vectors of different length, a vector gets one more coordinate that makes all lengths equal, and
a query zero there; near in angle then means large in inner product. The window is measured, not guessed: for a fixed
number of sample queries the true neighbours are found by brute force in one pass, and the window is what reaches
the wanted share of them. Every vector is indexed. On vectors without any structure (the synthetic table is close to
uniform on the sphere) the window must be a large share of the table, whatever the index.

Defined results: vectors that are null, zero, of another length than most, or hold a null or a non-finite component
take no part; a query's own id is no candidate, repeated rows of one id count as one (where their
vectors differ, the least in lexicographic order); equal products are ordered by id;
with fewer candidates than k all are returned; other columns are not carried; an empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from hustings.llm.common import cut, lean, table

CURVES, DIMENSIONS, BITS = 8, 4, 15
SAMPLE, RECALL = 64, 0.95
BLOCK_LOW, BLOCK_HIGH = 256, 32_768
#: Queries of one block that are compared in one task; more are dealt to several.
PER_TASK = 2048


def hilbert_keys(cells: np.ndarray, bits: int) -> np.ndarray:
    """Places of integer cells (rows) on the Hilbert curve: Gray-code rotations from the highest bit down."""
    axes = [cells[:, i].astype(np.int64) for i in range(cells.shape[1])]
    for level in range(bits - 1, 0, -1):
        top, low = np.int64(1) << level, (np.int64(1) << level) - 1
        for i, axis in enumerate(axes):
            high = (axis & top) != 0
            swap = np.where(high, 0, (axes[0] ^ axis) & low)
            axes[0] = np.where(high, axes[0] ^ low, axes[0] ^ swap)
            if i:
                axes[i] = axis ^ swap
    for i in range(1, len(axes)):
        axes[i] = axes[i] ^ axes[i - 1]
    turn = np.zeros(len(cells), np.int64)
    for level in range(bits - 1, 0, -1):
        turn ^= np.where((axes[-1] >> level) & 1, (np.int64(1) << level) - 1, 0)
    key = np.zeros(len(cells), np.int64)
    for level in range(bits - 1, -1, -1):
        for axis in axes:
            key = (key << 1) | (((axis ^ turn) >> level) & 1)
    return key


def curves(dimension: int, count: int, own: int, seed: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """(dimension x count*own) projections, orthonormal as far as they can be, and a shift for each."""
    rng = np.random.default_rng(seed)
    parts, left = [], count * own
    while left > 0:
        basis, _ = np.linalg.qr(rng.normal(size=(dimension, dimension)))
        parts.append(basis[:, : min(left, dimension)])
        left -= dimension
    return np.hstack(parts), rng.random(count * own)


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def _best(found: np.ndarray, candidates: np.ndarray, ids: np.ndarray, queries: np.ndarray, own: np.ndarray, k: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(query, ids, products) of each query's k best of a block. Products are summed row by row, so that equal vectors
    have equal ones wherever they lie; the matrix product only shortlists, with all that could tie."""
    for row in range(len(queries)):
        near = found[row].copy()
        near[ids == own[row]] = -np.inf
        if len(near) > k:
            edge = np.partition(near, len(near) - k)[len(near) - k]
            take = np.flatnonzero(near >= edge - 1e-9 * max(1.0, abs(edge))) if np.isfinite(edge) else np.flatnonzero(np.isfinite(near))
        else:
            take = np.flatnonzero(np.isfinite(near))
        exact = (candidates[take] * queries[row]).sum(axis=1)
        order = np.lexsort((ids[take], -exact))
        unique = order[np.sort(np.unique(ids[take][order], return_index=True)[1])][:k]
        yield row, ids[take][unique], exact[unique]


def usable(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(id, v) of the vectors that take part, one row per id."""
    v = F.col("v")
    whole = v.isNotNull() & ~F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) & F.exists(v, lambda x: x != 0)
    fit = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("v")).where(F.col("id").isNotNull() & whole)
    rows = cut(fit.groupBy("id", F.size("v").alias("size")).agg(F.count("*").alias("rows")))
    size = rows.groupBy("size").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "size").first()
    fit = fit.where(F.size("v") == (size["size"] if size else 0))
    again = rows.where((F.col("rows") > 1) & (F.col("size") == (size["size"] if size else 0))).select("id")
    if again.isEmpty():
        return fit
    # Only the repeated ids' vectors are gathered; the choice is kept, as it is read several times.
    return cut(fit.join(again, "id", "left_anti").unionByName(fit.join(again, "id", "left_semi").groupBy("id").agg(F.min("v").alias("v"))))


def nearest(vectors: DataFrame, queries: Column, k: int = 20, id_col: str = "vec_id", vector_col: str = "embedding", recall: float = RECALL, count: int = CURVES) -> DataFrame:
    """(query_id, rank, id, score): for the rows of `queries` (a condition on id) the k nearest of all rows."""
    spark = vectors.sparkSession
    base = usable(vectors, id_col, vector_col)
    norm = F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x))
    top, size = base.agg(F.max(norm), F.max(F.size("v"))).first()
    empty = spark.createDataFrame([], f"query_id long, rank int, {id_col} long, score double")
    if top is None:
        return empty
    own = min(DIMENSIONS, size + 1)
    basis, shift = curves(size + 1, count, own)
    reach = 4.0 * top / np.sqrt(size + 1)

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x = _matrix(batch.column("v"))
            square = (x**2).sum(axis=1)
            asks = batch.column("asks").to_numpy(zero_copy_only=False).astype(bool)
            # As a candidate a vector is filled up to the longest; as a query it is scaled to it.
            filled = np.hstack([x, np.sqrt(np.maximum(top**2 - square, 0))[:, None]])
            scaled = np.hstack([x * (top / np.sqrt(square))[:, None], np.zeros((len(x), 1))])[asks]
            for role, points, ids in ((False, filled, batch.column("id")), (True, scaled, batch.column("id").filter(pa.array(asks)))):
                cells = np.clip((points @ basis / (2 * reach) + 0.5) * 0.75 + shift * 0.25, 0, 1 - 1e-12) * (1 << BITS)
                for c in range(count):
                    key = hilbert_keys(cells[:, c * own : (c + 1) * own].astype(np.int64), BITS)
                    n = len(key)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(n, c, np.int32)), pa.array(key), ids, pa.array(np.full(n, role))], ["curve", "key", "id", "asks"])

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seen = TaskContext.get().partitionId(), {}
        for batch in batches:
            curve, asks = batch.column("curve").to_numpy(), batch.column("asks").to_numpy(zero_copy_only=False).astype(bool)
            place = np.zeros(len(curve), np.int64)
            for c in np.unique(curve):
                mine = curve == c
                counted = np.cumsum(~asks[mine])  # a query stands before the candidate that follows it
                place[mine] = seen.get(c, 0) + counted - ~asks[mine]
                seen[c] = seen.get(c, 0) + int(counted[-1])
            yield pa.RecordBatch.from_arrays([batch.column("curve"), batch.column("id"), batch.column("asks"), pa.array(np.full(len(curve), part, np.int32)), pa.array(place)], ["curve", "id", "asks", "part", "place"])

    source = base.withColumn("asks", F.coalesce(queries, F.lit(False)))
    placed = source.mapInArrow(keys, "curve int, key long, id long, asks boolean")
    # The order is drawn once and kept: ranges are sampled, and a second drawing might cut elsewhere.
    ordered = cut(placed.repartitionByRange("curve", "key", "id").sortWithinPartitions("curve", "key", "id", "asks").mapInArrow(number, "curve int, id long, asks boolean, part int, place long"))
    parts = ordered.groupBy("curve", "part").agg(F.count_if(~F.col("asks")).alias("n")).orderBy("curve", "part").toPandas()  # a row per partition and curve at most
    parts["base"] = parts.groupby("curve")["n"].cumsum() - parts["n"]
    total = int(parts.loc[parts["curve"] == 0, "n"].sum())
    starts = F.broadcast(spark.createDataFrame(parts[["curve", "part", "base"]].astype({"curve": "int32", "part": "int32"})))
    ranked = ordered.join(starts, ["curve", "part"]).select("curve", "id", "asks", (F.col("base") + F.col("place")).alias("place"))

    window = _window(base, source, ranked, k, recall, total)
    block = int(min(max(window, BLOCK_LOW), BLOCK_HIGH))
    rows = ranked.where("not asks").select("curve", "id", F.floor(F.col("place") / block).cast("long").alias("block"))
    spans = F.explode(F.sequence(F.greatest(F.lit(0), F.floor((F.col("place") - window) / block)).cast("long"), F.floor((F.col("place") + window) / block).cast("long"))).alias("block")
    asked = ranked.where("asks").select("curve", "id", spans)
    # A block's candidates go to as many tasks as its queries need, so that no group grows with the queries.
    parts_of = lean(cut(asked.groupBy("curve", "block").agg(F.ceil(F.count("*") / PER_TASK).cast("int").alias("parts"))))
    asked = asked.join(parts_of, ["curve", "block"]).withColumn("part", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int")).join(source.where("asks").select("id", "v"), "id").select("curve", "block", "part", "id", "v").toDF("on", "at", "of", "asking", "q")
    rows = rows.join(parts_of, ["curve", "block"]).withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).join(base, "id").select("curve", "block", "part", "id", "v")

    def compare(left: pa.Table, right: pa.Table) -> pa.Table:
        rows = []
        if left.num_rows and right.num_rows:
            candidates, ids = _matrix(left.column("v").combine_chunks()), left.column("id").to_numpy()
            asking, own_ids = _matrix(right.column("q").combine_chunks()), right.column("asking").to_numpy()
            for at in range(0, len(asking), 256):
                part, mine = asking[at : at + 256], own_ids[at : at + 256]
                for row, near, exact in _best(part @ candidates.T, candidates, ids, part, mine, k):
                    rows.append((np.full(len(near), mine[row]), near, exact))
        cols = [np.concatenate(x) for x in zip(*rows, strict=True)] if rows else [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)]
        return pa.table(dict(zip(("query_id", "id", "score"), cols, strict=True)))

    found = rows.groupBy("curve", "block", "part").cogroup(asked.groupBy("on", "at", "of")).applyInArrow(compare, "query_id long, id long, score double")
    best = found.groupBy("query_id", "id").agg(F.max("score").alias("score"))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    return best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", F.col("id").alias(id_col), "score")


def brute_force(base: DataFrame, queries: list[tuple[int, list[float]]], k: int) -> DataFrame:
    """(query_id, id, score): exact neighbours of a fixed number of queries, in one pass over all rows."""
    ids, asking = np.array([q[0] for q in queries]), np.array([q[1] for q in queries], float)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x, names = _matrix(batch.column("v")), batch.column("id").to_numpy()
                out = [(np.full(len(near), ids[row]), near, exact) for row, near, exact in _best(asking @ x.T, x, names, asking, ids, k)]
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*out, strict=True)], ["query_id", "id", "score"])

    best = base.mapInArrow(run, "query_id long, id long, score double").groupBy("query_id", "id").agg(F.max("score").alias("score"))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    return best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def _window(base: DataFrame, source: DataFrame, ranked: DataFrame, k: int, recall: float, total: int) -> int:
    """Ranks on either side of a query that hold the wanted share of the sample queries' true neighbours."""
    sample = [(r["id"], r["v"]) for r in source.where("asks").select("id", "v").orderBy(F.xxhash64("id"), "id").limit(SAMPLE).collect()]
    if not sample:
        return 1
    truth = F.broadcast(brute_force(base, sample, k).select("query_id", "id"))  # SAMPLE x k rows
    asked = ranked.where("asks").join(truth.select(F.col("query_id").alias("id")).distinct(), "id").select(F.col("id").alias("query_id"), "curve", F.col("place").alias("from"))
    there = ranked.where("not asks").join(truth, "id").join(F.broadcast(asked), ["query_id", "curve"])
    gap = there.groupBy("query_id", "id").agg(F.min(F.abs(F.col("place") - F.col("from"))).alias("gap"))
    gaps = np.sort(np.array([r["gap"] for r in gap.collect()]))  # SAMPLE x k numbers at most
    return int(gaps[min(len(gaps) - 1, int(np.ceil(recall * len(gaps))))]) + 1 if len(gaps) else max(total, 1)


def op10_hilbert_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(table(spark, sf_dir, "embeddings"), F.col("id") % 20 == 0)


QUERIES = {"op10_hilbert_neighbours": op10_hilbert_neighbours}
ORACLES: dict[str, str] = {}
