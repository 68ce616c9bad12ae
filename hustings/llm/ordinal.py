"""Operator 6: quality classifier by ordinal (cumulative-link) regression on graded ratings.

One weight per hashed text feature is shared by all grades; ordered thresholds cut the score into grades, so that
P(grade <= k) is the logistic of threshold k minus the score. A document gets its expected grade and the probability of
the highest grade, by which documents are selected. Features are the distinct words (runs of letters) and a few shapes
of the text, binned. The weights are fitted on about MAX_LABELLED labelled rows (a documented bound), chosen by a hash of
the id, in one task; scoring runs over all documents with a model whose size follows that bound. A feature needs a
weight if it stands in one of a thousand documents of the sample, in two at least.

Defined results: a null or empty text has the shape features of an empty one; without any label every weight is zero
and every document is selected; rows with a null rating are not fitted on; repeated rows are scored alike; columns of
the input that have the name of a result column are replaced by it in `grade` and kept in `select`; an empty table
gives an empty table; a tail probability equal to the least one selects.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from hustings.llm.common import WHITE, hashed_texts, mix, slices, table, texts_of

BITS = 24
MAX_LABELLED = 20_000
LEAST_SHARE = 1e-3
EPOCHS, BATCH, RATE, SHRINK = 12, 128, 0.15, 1e-2
LEAST_TAIL = 0.5

LETTER = np.zeros(256, bool)
LETTER[[*range(65, 91), *range(97, 123), *range(128, 256)]] = True
SYMBOL = np.zeros(256, bool)
SYMBOL[list(b"#*$%&|<>!{}[]@^~=+\\/")] = True
UPPER = np.zeros(256, bool)
UPPER[65:91] = True


def _shape(kind: int, value: np.ndarray) -> np.ndarray:
    """A feature for each binned value of a shape."""
    return (mix((np.uint64(kind) << np.uint64(32)) + value.astype(np.uint64)) >> np.uint64(64 - BITS)).astype(np.int64)


def features(batch: pa.RecordBatch, text: str) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, row after the last, row of each feature, feature), every feature once in a row, rows ascending."""
    raw, offsets = texts_of(batch.column(text))
    sums = {}
    for name, kind in (("symbol", SYMBOL), ("upper", UPPER), ("letter", LETTER), ("white", WHITE)):
        total = np.zeros(len(offsets), np.int64)
        for first, last in slices(offsets):  # counted by slices, so that the working memory follows their size
            part = kind[raw[offsets[first] : offsets[last]]]
            total[first + 1 : last + 1] = np.diff(np.concatenate([[0], np.cumsum(part)])[offsets[first : last + 1] - offsets[first]])
        sums[name] = total[1:]
    size = np.maximum(np.diff(offsets), 1)
    for first, last, hashes, words in hashed_texts(batch, text, ~LETTER):
        n = np.diff(words)
        row = np.repeat(np.arange(last - first), n)
        unique = np.unique((row.astype(np.uint64) << np.uint64(BITS)) | (hashes >> np.uint64(64 - BITS)))
        rows, found = (unique >> np.uint64(BITS)).astype(np.int64), (unique & np.uint64((1 << BITS) - 1)).astype(np.int64)
        distinct = np.bincount(rows, minlength=last - first)
        own = slice(first, last)
        shapes = [
            _shape(1, np.minimum(10, 50 * sums["symbol"][own] // size[own])), _shape(2, 10 * sums["upper"][own] // np.maximum(sums["letter"][own], 1)),
            _shape(3, 10 * distinct // np.maximum(n, 1)), _shape(4, np.minimum(6, np.log2(n + 1).astype(np.int64))), _shape(5, 10 * sums["white"][own] // size[own]),
        ]
        every = np.tile(np.arange(last - first), len(shapes))
        rows, found = np.concatenate([rows, every]), np.concatenate([found, *shapes])
        order = np.argsort(rows, kind="stable")
        yield first, last, rows[order], found[order]


@dataclass
class Model:
    """Features in ascending order with their weights, and ordered thresholds, one fewer than grades."""

    features: np.ndarray
    weights: np.ndarray
    thresholds: np.ndarray

    def grades(self, scores: np.ndarray) -> np.ndarray:
        """P(grade) in a column for each grade."""
        below = 1 / (1 + np.exp(-np.clip(self.thresholds[None, :] - scores[:, None], -500, 500)))
        edges = np.hstack([np.zeros((len(scores), 1)), below, np.ones((len(scores), 1))])
        return np.diff(edges, axis=1)

    def scores(self, rows: np.ndarray, found: np.ndarray, count: int) -> np.ndarray:
        if not len(self.features):
            return np.zeros(count)
        at = np.minimum(np.searchsorted(self.features, found), len(self.features) - 1)
        return np.bincount(rows, np.where(self.features[at] == found, self.weights[at], 0.0), minlength=count)


def slopes(scores: np.ndarray, grades: np.ndarray, cuts: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
    """The negated log-likelihood of the grades, and its slopes in the scores and in the thresholds."""
    edge = np.concatenate([[-np.inf], cuts, [np.inf]])
    with np.errstate(over="ignore"):
        high, low = 1 / (1 + np.exp(scores - edge[grades + 1])), 1 / (1 + np.exp(scores - edge[grades]))
    chance = np.maximum(high - low, 1e-12)
    down = np.zeros(len(cuts) + 2)
    np.subtract.at(down, grades + 1, high * (1 - high) / chance)
    np.add.at(down, grades, low * (1 - low) / chance)
    return float(-np.log(chance).sum()), 1 - high - low, down[1:-1]


def fit_arrays(rows: np.ndarray, found: np.ndarray, grades: np.ndarray, n_grades: int, seed: int = 3) -> Model:
    """Adagrad on the log-likelihood over mini-batches; features of too few documents have no weight."""
    kept, place, times = np.unique(found, return_inverse=True, return_counts=True)
    often = times >= max(2, LEAST_SHARE * len(grades))
    local = np.full(len(kept), -1)
    local[often] = np.arange(often.sum())
    column = local[place]
    rows, column = rows[column >= 0], column[column >= 0]
    starts = np.searchsorted(rows, np.arange(len(grades) + 1))
    weights, size = np.zeros(often.sum()), np.full(often.sum(), 1e-6)
    shares = np.cumsum(np.bincount(grades, minlength=n_grades) + 1.0)[:-1] / (len(grades) + n_grades)
    cuts = np.log(shares / (1 - shares))
    cut_size = np.full(len(cuts), 1e-6)
    rng = np.random.default_rng(seed)
    for _ in range(EPOCHS):
        order = rng.permutation(len(grades))
        for at in range(0, len(order), BATCH):
            take = order[at : at + BATCH]
            lengths = starts[take + 1] - starts[take]
            index = np.repeat(starts[take] - np.concatenate([[0], np.cumsum(lengths)[:-1]]), lengths) + np.arange(lengths.sum())
            mine, of = column[index], np.repeat(np.arange(len(take)), lengths)
            score = np.bincount(of, weights[mine], minlength=len(take))
            _, slope, down = slopes(score, grades[take], cuts)
            touched, where = np.unique(mine, return_inverse=True)
            gradient = np.bincount(where, slope[of], minlength=len(touched)) + SHRINK * len(take) * weights[touched]
            size[touched] += gradient**2
            weights[touched] -= RATE * gradient / np.sqrt(size[touched])
            cut_size += down**2
            cuts = np.maximum.accumulate(cuts - RATE * down / np.sqrt(cut_size))
    return Model(kept[often], weights, cuts)


def fit(docs: DataFrame, ratings: DataFrame, n_grades: int, id_col: str = "doc_id", text_col: str = "text", grade_col: str = "grade", bound: int = MAX_LABELLED) -> Model:
    """The model of documents joined with ratings (id, grade from 0), fitted on about `bound` rated rows.

    A rated id is in the sample if its hash lies below the share that the bound is of all rated ids. Of several rows
    of one id the one with the least hash of its text stands for it.
    """
    rated = ratings.select(F.col(id_col).alias("id"), F.col(grade_col).cast("int").alias("grade")).where("id is not null and grade is not null")
    rated = rated.groupBy("id").agg(F.min("grade").alias("grade"))
    share = int(min(1.0, bound / max(rated.count(), 1)) * (1 << 30))
    chosen = rated.where(F.pmod(F.xxhash64("id"), F.lit(1 << 30)) < share)
    found = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(F.broadcast(chosen), "id")
    text_of = F.min_by("text", F.xxhash64("text")).alias("text")
    # The scan runs in as many tasks as there are; the sample, whose size is bounded, goes to one.
    sample = found.groupBy("id", "grade").agg(text_of).repartition(1).sortWithinPartitions("id").select("text", "grade")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, found, grades, before = [], [], [], 0
        for batch in batches:
            grades.append(batch.column("grade").to_numpy())
            for first, _, r, f in features(batch, "text"):
                rows.append(r + before + first)
                found.append(f)
            before += batch.num_rows
        if before:
            model = fit_arrays(np.concatenate(rows), np.concatenate(found), np.concatenate(grades), n_grades)
            yield pa.RecordBatch.from_arrays([pa.array([x.tobytes()]) for x in (model.features.astype("<i8"), model.weights.astype("<f8"), model.thresholds.astype("<f8"))], ["features", "weights", "thresholds"])

    found = sample.mapInArrow(run, "features binary, weights binary, thresholds binary").first()
    if found is None:
        return Model(np.zeros(0, np.int64), np.zeros(0), np.full(n_grades - 1, -50.0))
    return Model(np.frombuffer(found["features"], "<i8"), np.frombuffer(found["weights"], "<f8"), np.frombuffer(found["thresholds"], "<f8"))


def grade(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """The input rows with expected_grade and tail, the probability of the highest grade."""
    graded_rows = _grade(docs, model, text_col)
    kept = [(k, c) for k, c in enumerate(docs.columns) if c not in ("expected_grade", "tail")]
    return graded_rows.select(*(F.col(f"in_{k}").alias(c) for k, c in kept), "expected_grade", "tail")


def _grade(docs: DataFrame, model: Model, text_col: str) -> DataFrame:
    """Column k of the input as in_k, so that no name can clash, with expected_grade and tail."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    base = docs.toDF(*(f"in_{k}" for k in range(len(docs.columns))))
    names, text = [*base.columns, "expected_grade", "tail"], f"in_{docs.columns.index(text_col)}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for batch in batches:
            expected, tail = np.zeros(batch.num_rows), np.zeros(batch.num_rows)
            for first, last, rows, found in features(batch, text):
                chance = own.grades(own.scores(rows, found, last - first))
                expected[first:last], tail[first:last] = chance @ np.arange(chance.shape[1]), chance[:, -1]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(expected), pa.array(tail)], names)

    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in base.schema.fields)
    return base.mapInArrow(run, f"{kinds}, expected_grade double, tail double")


def graded(labels: DataFrame) -> DataFrame:
    """Grades of the labels table: 0 toxic, 1 of low quality, 2 neither."""
    value: Column = F.when(F.col("toxic") == 1, 0).when(F.col("quality") == 0, 1).when((F.col("quality") == 1) & (F.col("toxic") == 0), 2)
    return labels.select("doc_id", value.alias("grade"))


def select(docs: DataFrame, model: Model, least: float = LEAST_TAIL, text_col: str = "text") -> DataFrame:
    """The input rows whose tail probability reaches the least, with all their columns."""
    return _grade(docs, model, text_col).where(F.col("tail") >= least).select(*(F.col(f"in_{k}").alias(c) for k, c in enumerate(docs.columns)))


def op6_ordinal_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = fit(docs, graded(table(spark, sf_dir, "labels")), 3)
    return grade(docs.select("doc_id", "text"), model).select("doc_id", "expected_grade", "tail", (F.col("tail") >= LEAST_TAIL).alias("selected"))


QUERIES = {"op6_ordinal_quality": op6_ordinal_quality}
ORACLES: dict[str, str] = {}
