"""Operator 11: periodic runs of words, found by multi-scale minimizers.

A run is a stretch of words with smallest period q, at least max(least, exponent * q) long, that no neighbouring word
extends. Periods up to DIRECT are found by scans at each lag. A longer period lies at one scale k, a power of two with
k/2 < q <= k. There, windows of k/2 neighbouring k-grams each select their smallest k-gram. A run of four periods holds
a whole window and the same window one period later, and the k-grams that start within one period all differ (a
primitive word has as many rotations as letters). So the two windows select equal k-grams exactly q apart, with no equal
one between them: selected positions and their next equal ones are the seeds. A seed is extended to both sides word by
word, which is exact, and a stretch with a shorter period that divides q is dropped (that run has its own seed).

The work is linear in a text's words at each of its scales, and a text is a row, so nothing is shuffled. Texts of an
Arrow batch are worked on together in slices of about SLICE words with a word of its own between two texts.

Defined results: a null or empty text, or one without words, has no run; equal rows give equal rows; null ids are kept
and come back null; very long texts are slices of their own; other columns are not carried, so their names can't clash;
an empty table gives an empty table.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from hustings.llm.common import mix, table

#: Periods up to this are found by direct scans.
DIRECT = 8
SLICE = 1 << 16
_ODD = np.uint64(0x9E3779B97F4A7C15)


def sliding(best: np.ufunc, x: np.ndarray, width: int) -> np.ndarray:
    """best over x[i : i + width], by doubling."""
    out, k = x, 1
    while 2 * k <= width:
        out, k = best(out[:-k], out[k:]), 2 * k
    rest = width - k
    return best(out[:-rest], out[rest:]) if rest else out


def selected(values: np.ndarray, width: int, barred: np.ndarray | None = None) -> np.ndarray:
    """Positions that hold the smallest value, none of which is 0, of some window that doesn't start at a barred place."""
    least = sliding(np.minimum, values, width)
    if barred is not None:
        least = np.where(barred, values.dtype.type(0), least)
    edge = np.zeros(width - 1, values.dtype)
    return np.flatnonzero(sliding(np.maximum, np.concatenate([edge, least, edge]), width) == values)


def _stretch(words: np.ndarray, at: int, period: int) -> tuple[int, int]:
    """The longest stretch around at, at + period whose words equal those a period later: (start, end)."""
    n, step = len(words), 64
    right = at
    while right + period < n:
        part = words[right : min(right + step, n - period)] != words[right + period : right + period + step]
        if part.any():
            right += int(part.argmax())
            break
        right, step = right + len(part), 2 * step
    left, step = at, 64
    while left > 0:
        low = max(0, left - step)
        part = words[low:left] != words[low + period : left + period]
        if part.any():
            left -= int(part[::-1].argmax())
            break
        left, step = low, 2 * step
    return left, right + period


def _primitive(words: np.ndarray, start: int, end: int, period: int) -> bool:
    """Whether no period that divides this one holds."""
    rest, factor = period, 2
    while rest > 1:
        factor = factor if factor * factor <= rest else rest
        if rest % factor == 0:
            shorter = period // factor
            if np.array_equal(words[start : end - shorter], words[start + shorter : end]):
                return False
            while rest % factor == 0:
                rest //= factor
        factor += 1
    return True


def find_runs(words: np.ndarray, longest: int, least: int = 6, exponent: int = 4) -> list[tuple[int, int, int]]:
    """(start, end, period) of the runs in a sequence of whole numbers; longest: of the texts in it. exponent: 4 or more."""
    out = []
    for period in range(1, min(DIRECT, longest // exponent) + 1):
        need = max(least, exponent * period) - period
        edges = np.flatnonzero(np.diff(np.concatenate([[False], words[:-period] == words[period:], [False]]).astype(np.int8)))
        starts, ends = edges[::2], edges[1::2]
        for k in np.flatnonzero(ends - starts >= need):
            start, end = int(starts[k]), int(ends[k]) + period
            if _primitive(words, start, end, period):
                out.append((start, end, period))
    scale = 2 * DIRECT
    with np.errstate(over="ignore"):
        grams, k = mix((words.astype(np.uint64) + np.uint64(1)) * _ODD), 1
        while exponent * (scale // 2 + 1) <= longest:
            while k < scale:  # a k-gram's hash from those of its halves
                grams, k = mix(grams[:-k] * _ODD + grams[k:]), 2 * k
            at = selected(grams | np.uint64(1), scale // 2)
            order = np.lexsort((at, grams[at]))
            same = grams[at[order[1:]]] == grams[at[order[:-1]]]
            first, lag = at[order[:-1]][same], np.diff(at[order])[same]
            near = (lag > scale // 2) & (lag <= scale)
            covered: dict[int, int] = {}
            for start, period in sorted(zip(first[near].tolist(), lag[near].tolist(), strict=True)):
                if start < covered.get(period, -1):
                    continue
                low, end = _stretch(words, start, period)
                covered[period] = end - period
                if end - low >= max(least, exponent * period) and _primitive(words, low, end, period):
                    out.append((low, end, period))
            scale *= 2
    return sorted(out)


def _collapsed(count: int, runs: list[tuple[int, int, int]]) -> np.ndarray:
    """Which words stay when each run keeps its first period."""
    change = np.zeros(count + 1, np.int64)
    for start, end, period in runs:
        change[start + period] += 1
        change[end] -= 1
    return np.cumsum(change[:-1]) == 0


def periodic_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = 6, exponent: int = 4) -> DataFrame:
    """(id, n_words, runs, collapsed): each text's runs by start and period, and its words joined by one space where each
    run keeps only its first period."""
    if exponent < 4:
        raise ValueError("shorter runs than four periods need windows of their own")
    kind = docs.schema[id_col].dataType.simpleString()
    run_type = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("text")
            row = 0
            while row < batch.num_rows:
                names: dict[bytes, int] = {}
                ids: list[int] = []
                own: list[list[bytes]] = []
                bounds = [0]
                while row < batch.num_rows and len(ids) < SLICE:
                    value = texts[row].as_buffer()
                    words = value.to_pybytes().split() if value is not None else []  # at the six ASCII white-space bytes
                    ids += [names.setdefault(word, len(names)) for word in words]
                    ids.append(-len(own) - 1)  # no run crosses it
                    own.append(words)
                    bounds.append(len(ids))
                    row += 1
                found = find_runs(np.array(ids, np.int64), max(map(len, own)), least, exponent)
                at = np.searchsorted(bounds, [x[0] for x in found], "right") - 1
                runs: list[list[tuple[int, int, int]]] = [[] for _ in own]
                for (start, end, period), k in zip(found, at, strict=True):
                    runs[k].append((start - bounds[k], end - bounds[k], period))
                joined = []
                for words, held in zip(own, runs, strict=True):
                    if held:
                        words = [words[k] for k in np.flatnonzero(_collapsed(len(words), held))]
                    joined.append(b" ".join(words))
                listed = [[{"start": a, "length": b - a, "period": q} for a, b, q in held] for held in runs]
                columns = [batch.column("id").slice(row - len(own), len(own)), pa.array([len(x) for x in own], pa.int64()), pa.array(listed, run_type), pa.array(joined, pa.binary()).cast(pa.string())]
                yield pa.RecordBatch.from_arrays(columns, ["id", "n_words", "runs", "collapsed"])

    rows = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text"))
    return rows.mapInArrow(work, f"id {kind}, n_words long, runs array<struct<start: long, length: long, period: long>>, collapsed string")


def planted(docs: DataFrame) -> DataFrame:
    """(doc_id, text): the contract's input. In one document of ten by its id's checksum, the words from a place on
    repeat with a period; those texts become their words joined by one space."""
    checksum = F.crc32(F.col("doc_id").cast("string"))
    words: Column = F.filter(F.split("text", "[ \\t\\n\\x0B\\f\\r]+"), lambda w: w != "")
    g, n = F.floor(checksum / 10), F.size("_words")
    from_word = (g % n).cast("int")
    period = (1 + F.floor((n - F.col("_a")) / (3 + g % 8))).cast("int")
    times = F.ceil((n - F.col("_a")) / F.col("_p")).cast("int")
    part = F.flatten(F.array_repeat(F.slice("_words", F.col("_a") + 1, F.col("_p")), times))
    repeated = F.array_join(F.concat(F.slice("_words", F.lit(1), F.col("_a")), F.slice(part, F.lit(1), n - F.col("_a"))), " ")
    chosen = (checksum % 10 == 0) & F.col("text").isNotNull()
    # An array for the chosen rows only; the others pass unchanged.
    rows = docs.select("doc_id", "text", F.when(chosen, words).alias("_words"))
    rows = rows.withColumn("_a", F.when(n > 0, from_word)).withColumn("_p", F.when(n > 0, period))
    return rows.select("doc_id", F.when(F.col("_a").isNotNull(), repeated).otherwise(F.col("text")).alias("text"))


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = periodic_runs(planted(table(spark, sf_dir, "documents").select("doc_id", "text")))
    # The exact quotient decides: of a and b, a is greater if a.length * b.period > b.length * a.period.
    better = lambda a, b: a["length"] * b["period"] > b["length"] * a["period"]
    best = F.aggregate(F.slice("runs", F.lit(2), F.size("runs")), F.try_element_at("runs", F.lit(1)), lambda held, r: F.when(better(r, held), r).otherwise(held))
    listed = F.array_join(F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"].cast("string"), r["length"].cast("string"), r["period"].cast("string")), F.lit("\n"))), "")
    return found.select(F.col("id").alias("doc_id"), F.size("runs").cast("long").alias("n_runs"), best.alias("best"), listed.alias("listed"), "collapsed").select(
        "doc_id", "n_runs", "best.start", "best.length", "best.period", F.expr("1000 * best.length div best.period").alias("exponent_milli"),
        F.sha2("listed", 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


def brute_force(words: list, least: int = 6, exponent: int = 4) -> list[tuple[int, int, int]]:
    """(start, end, period) of all runs, by comparing at every lag; for tests."""
    out, n = [], len(words)
    for q in range(1, n // exponent + 1):
        start = 0
        while start + q < n:
            end = start
            while end + q < n and words[end] == words[end + q]:
                end += 1
            if end + q - start >= max(least, exponent * q) and not any(all(words[i] == words[i + p] for i in range(start, end + q - p)) for p in range(1, q)):
                out.append((start, end + q, q))
            start = max(end, start) + 1
    return sorted(out)


def digest(runs: list[tuple[int, int, int]]) -> str:
    """The contract's digest of runs, as the query computes it; for tests."""
    return hashlib.sha256("".join(f"{a},{b - a},{q}\n" for a, b, q in runs).encode()).hexdigest()


QUERIES = {"op11_periodic_runs": op11_periodic_runs}
ORACLES: dict[str, str] = {}
