"""Operator 8: packing documents into fixed-length sequences by cutting-stock column generation.

Each document's ids are cut into full blocks and one rest. Full blocks are sequences of their own. The rests form a
histogram over at most `length` lengths. A linear program over patterns (multisets of lengths that fit one sequence)
covers the histogram with the fewest sequences; its dual values price new patterns by a knapsack recursion until no
pattern improves. Pattern counts are rounded down, what remains is packed largest first, and the plan - which ranks of
which length go to which slot of which sequences - is joined to the ranked documents. Only the histogram and the plan
pass the driver; both are bounded by the sequence length, not by the corpus.

Defined results: a null or empty text is the single end id; repeated rows (even of one id) are separate documents;
other columns are not carried; an empty table gives an empty table; ties in rank are broken by id and content.
"""

from __future__ import annotations

import json
import re
import zlib
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from hustings.llm.bpe import encoding, ids_of
from hustings.llm.common import cut, table

#: Ranks of one length are counted in this many parts, so that no length is one task's.
PARTS = 64


def added_tokens(path: str) -> dict[str, int]:
    """The added tokens of a tokenizer's JSON file, with their ids."""
    with open(path) as file:
        rows = json.load(file)["added_tokens"]
    for row in rows:
        if row["single_word"] or row["lstrip"] or row["rstrip"] or row["normalized"]:
            raise ValueError(f"added token with rules of its own: {row}")
    return {row["content"]: row["id"] for row in rows}


def tokenise(docs: DataFrame, ranks: str, length: int, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text", keep_ids: bool = False, pattern: str = public_tokenizers.PATTERN, added: dict[str, int] | None = None) -> DataFrame:
    """(id, doc_tokens, crcs, ids): the ids with the end id; one checksum per block of `length`; ids null unless kept.

    The rank file holds the same vocabulary and merges as the JSON file of the `tokenizers` library, so the ids are
    that library's (tests compare them); reading ranks is several times as fast. Where an `added` token stands in a
    text it has its own id, and the stretches between are encoded by themselves; without any they are plain text.
    """
    kind = docs.schema[id_col].dataType.simpleString()

    # Of tokens that start at one place the longest counts.
    marks = "|".join(re.escape(x) for x in sorted(added or {}, key=len, reverse=True))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, end = encoding(ranks, pattern), np.array([end_id], np.uint32)

        def parts(text: str) -> list[np.ndarray]:
            if not marks:
                return [ids_of(own, text)]
            return [np.array([added[x]], np.uint32) if k % 2 else ids_of(own, x) for k, x in enumerate(re.split(f"({marks})", text))]

        for batch in batches:
            sizes, crcs, kept = [], [], []
            for text in batch.column(1):
                ids = np.concatenate([*parts(text.as_py() or ""), end])
                sizes.append(len(ids))
                crcs.append([zlib.crc32(ids[k : k + length].astype("<u4").tobytes()) for k in range(0, len(ids), length)])
                kept.append(ids.astype(np.int32).tolist() if keep_ids else None)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), pa.array(crcs, pa.list_(pa.int64())), pa.array(kept, pa.list_(pa.int32()))], ["id", "doc_tokens", "crcs", "ids"])

    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, f"id {kind}, doc_tokens long, crcs array<long>, ids array<int>")


def best_pattern(values: np.ndarray, sizes: np.ndarray, length: int) -> tuple[float, np.ndarray]:
    """The unbounded knapsack: the most valuable multiset of sizes that fits the length."""
    best, choice = np.zeros(length + 1), np.full(length + 1, -1)
    for room in range(1, length + 1):
        best[room] = best[room - 1]
        fit = np.searchsorted(sizes, room, "right")
        if fit:
            worth = values[:fit] + best[room - sizes[:fit]]
            k = int(worth.argmax())
            if worth[k] > best[room] + 1e-12:
                best[room], choice[room] = worth[k], k
    counts, room = np.zeros(len(sizes), np.int64), length
    while room > 0:
        if choice[room] < 0:
            room -= 1
        else:
            counts[choice[room]] += 1
            room -= sizes[choice[room]]
    return float(best[length]), counts


def solve(sizes: np.ndarray, demand: np.ndarray, length: int, rounds: int = 4000, tolerance: float = 1e-6) -> tuple[np.ndarray, np.ndarray]:
    """(patterns as rows, how often each is used, fractional): revised simplex with priced columns.

    The basis inverse is updated by one elementary row operation per column; the first basis repeats each size alone.
    """
    m = len(sizes)
    patterns = np.diag(length // sizes)
    inverse = np.diag(1.0 / (length // sizes))
    use = inverse @ demand
    for _ in range(rounds):
        duals = inverse.sum(axis=0)  # every sequence costs one
        value, column = best_pattern(np.maximum(duals, 0), sizes, length)
        if value <= 1 + tolerance:
            break
        direction = inverse @ column
        ratio = np.where(direction > 1e-9, use / np.where(direction > 1e-9, direction, 1), np.inf)
        out = int(ratio.argmin())
        if not np.isfinite(ratio[out]):
            break
        step = ratio[out]
        use = use - step * direction
        use[out] = step
        pivot = inverse[out] / direction[out]
        inverse -= np.outer(direction, pivot)
        inverse[out] = pivot
        patterns[out] = column
    assert len(patterns) == m
    return patterns, np.maximum(use, 0)


def plan(sizes: np.ndarray, demand: np.ndarray, length: int, grain: int | None = None) -> list[tuple[int, int, int, int, int]]:
    """(size, first rank, last rank + 1, first sequence, offset): which ranks of a size go to which slot.

    Row by row, rank r of the size goes to sequence `first sequence + r - first rank` at the offset. Sizes are grouped
    upwards by `grain` for the linear program (a sequence then fits at least what the program assumes).
    """
    grain = grain or max(1, length // 128)
    classes = np.maximum(grain, -(-sizes // grain) * grain)
    classes = np.minimum(classes, length)
    unique, of = np.unique(classes, return_inverse=True)
    total = np.bincount(of, weights=demand).astype(np.int64)
    units = length // grain
    patterns, use = solve(np.minimum(unique // grain, units), total.astype(float), units)
    patterns[patterns @ unique > length] = 0  # a capped class may be a little longer than its units
    times = np.floor(use + 1e-9).astype(np.int64)
    left = total.copy()
    runs: list[tuple[np.ndarray, int]] = []
    for pattern, n in zip(patterns, times, strict=True):
        pattern = pattern.astype(np.int64)
        if not pattern.any():
            continue
        n = min(int(n), *(int(left[k] // pattern[k]) for k in np.flatnonzero(pattern)))
        if n > 0:
            left -= pattern * n
            runs.append((pattern, n))
    while left.any():  # what rounding left: largest first, as long as one fits
        room, pattern = length, np.zeros(len(unique), np.int64)
        for k in range(len(unique) - 1, -1, -1):
            pattern[k] = min(left[k], room // unique[k])
            room -= pattern[k] * unique[k]
        n = min(int(left[k] // pattern[k]) for k in np.flatnonzero(pattern))
        left -= pattern * n
        runs.append((pattern, n))
    # The members of a class are its sizes in order; a slot takes the next n of them, whatever their own sizes.
    order = np.argsort(of, kind="stable")
    ends = np.cumsum(demand[order])
    starts = ends - demand[order]
    base = {k: int(starts[np.searchsorted(of[order], k)]) for k in range(len(unique))}
    taken = dict.fromkeys(range(len(unique)), 0)
    rows, sequence = [], 0
    for pattern, n in runs:
        slot = 0
        for k in np.flatnonzero(pattern):
            for _ in range(int(pattern[k])):
                low = base[k] + taken[k]
                taken[k] += n
                j = int(np.searchsorted(ends, low, "right"))
                while low < base[k] + taken[k]:
                    high = int(min(base[k] + taken[k], ends[j]))
                    rows.append((int(sizes[order[j]]), int(low - starts[j]), int(high - starts[j]), sequence + low - (base[k] + taken[k] - n), slot))
                    low, j = high, j + 1
                slot += 1
        sequence += n
    return rows


def pack(docs: DataFrame, ranks: str, length: int = 1024, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text", keep_ids: bool = False, added: dict[str, int] | None = None) -> DataFrame:
    """One row per piece: id, start, length, crc, doc_tokens, sequence_id, offset and, if kept, its ids."""
    ready = tokenise(docs, ranks, length, end_id, id_col, text_col, keep_ids, added=added)
    tokens = cut(ready.withColumns({
        "rest": (F.col("doc_tokens") % length).cast("int"), "blocks": F.floor(F.col("doc_tokens") / length).cast("long"),
        "part": F.pmod(F.xxhash64("id", "crcs"), F.lit(PARTS)).cast("int"),
    }))
    spark = docs.sparkSession
    counted = tokens.groupBy("rest", "part").agg(F.count("*").alias("n"), F.sum("blocks").alias("blocks")).orderBy("rest", "part").toPandas()  # at most length x PARTS rows
    counted["rank0"] = counted.groupby("rest")["n"].cumsum() - counted["n"]
    counted["block0"] = counted["blocks"].cumsum() - counted["blocks"]
    rests = counted[counted["rest"] > 0].groupby("rest")["n"].sum()
    rows = plan(rests.index.to_numpy(np.int64), rests.to_numpy(np.int64), length) if len(rests) else []
    packed = max((r[3] + r[2] - r[1] for r in rows), default=0)
    ranges = spark.createDataFrame(counted[["rest", "part", "rank0", "block0"]].astype({"rest": "int32", "part": "int32"}) if len(counted) else [], "rest int, part int, rank0 long, block0 long")
    slots = spark.createDataFrame(rows or [], "rest int, low long, high long, sequence0 long, slot int")
    order = Window.partitionBy("rest", "part").orderBy(F.col("id").asc_nulls_first(), "crcs")
    ranked = tokens.join(F.broadcast(ranges), ["rest", "part"]).withColumns({
        "rank": F.col("rank0") + F.row_number().over(order) - 1,
        "block0": F.col("block0") + F.sum("blocks").over(order.rowsBetween(Window.unboundedPreceding, 0)) - F.col("blocks"),
    })
    at = F.broadcast(slots.withColumnRenamed("rest", "of"))
    placed = ranked.join(at, (F.col("rest") == F.col("of")) & (F.col("rank") >= F.col("low")) & (F.col("rank") < F.col("high")), "left")
    piece = F.explode(F.transform("crcs", lambda c, k: F.struct(c.alias("crc"), k.cast("long").alias("k")))).alias("piece")
    cutup = placed.select("id", "doc_tokens", "ids", "rest", "blocks", "block0", "rank", "low", "sequence0", "slot", piece)
    own = F.col("piece.k") < F.col("blocks")
    start = F.col("piece.k") * length
    size = F.when(own, F.lit(length)).otherwise(F.col("rest"))
    rests_at = cutup.select(
        F.col("id").alias(id_col), start.alias("start"), size.cast("long").alias("length"), F.col("piece.crc").alias("ids_crc32"), "doc_tokens",
        F.when(own, packed + F.col("block0") + F.col("piece.k")).otherwise(F.col("sequence0") + F.col("rank") - F.col("low")).alias("sequence_id"),
        F.when(own, 0).otherwise(F.col("slot")).alias("slot"),
        (F.slice("ids", (start + 1).cast("int"), size.cast("int")) if keep_ids else F.lit(None).cast("array<int>")).alias("ids"),
    )
    inside = Window.partitionBy("sequence_id").orderBy("slot").rowsBetween(Window.unboundedPreceding, -1)
    done = rests_at.withColumn("offset", F.coalesce(F.sum("length").over(inside), F.lit(0)))
    return done.drop("slot")


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    added = added_tokens(public_tokenizers.path("byte_bpe_50k.json"))
    return pack(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), added=added).select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")


QUERIES = {"op8_packing": op8_packing}
ORACLES: dict[str, str] = {}
