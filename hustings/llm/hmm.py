"""Operator 7: a hidden Markov language model, trained by Baum-Welch over partitions and scored exactly.

A word is emitted in two steps: the state emits a bucket (the commonest words have one each, the others share hashed
buckets), the bucket emits the word by its smoothed share of the bucket, from counts of all training words. The second
step does not depend on the state, so the likelihood of a text is that of its bucket sequence times those shares.

Sequences are cut into windows. A window's transfer matrix, the scaled product of its steps, carries the forward vector
over it exactly, so windows of all documents advance together and a long text costs no more per word than a short one.
Each round sums expected counts per task, then per block of parameters; only the parameters reach the driver, and their
number is fixed. The first model comes from counts of neighbouring words over all training documents, in a table of
fixed size (the commonest words have a row each, the others share rows): expectation and maximisation on that table fits
a chain of states to it. Every round after it runs over all training texts.

Words outside the broadcast table of the commonest are joined with their counts. Defined results: a null or empty text
is the end token alone; a null id counts as the empty text when the training part is chosen; repeated rows are scored
each; other columns are not carried; an empty table gives an empty table; without training tokens every count is zero.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from hustings.llm.common import cut, hashed_texts, mix, table

STATES, OWN, SHARED, WINDOW = 6, 8192, 4096, 64
KNOWN = 1 << 17
PAIRS_OWN, PAIRS_SHARED, PAIR_ROUNDS, ROUNDS = 767, 256, 200, 2
BLOCKS = 32
END = np.uint64(0xE0D0E0D0E0D0E0D1)


@dataclass
class Words:
    """The commonest words: hashes in ascending order, their counts, and the bucket of each (-1: a shared one)."""

    hashes: np.ndarray
    counts: np.ndarray
    own: np.ndarray

    def look(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(bucket, place in the table or -1) of each word."""
        if not len(self.hashes):
            at = np.full(len(hashes), -1)
        else:
            at = np.minimum(np.searchsorted(self.hashes, hashes), len(self.hashes) - 1)
            at = np.where(self.hashes[at] == hashes, at, -1)
        own = np.where(at >= 0, self.own[at] if len(self.own) else -1, -1)
        return np.where(own >= 0, own, OWN + (hashes % np.uint64(SHARED)).astype(np.int64)), at


@dataclass
class Model:
    """start (K), move (K x K) and emit (buckets x K); columns of emit sum to one."""

    start: np.ndarray
    move: np.ndarray
    emit: np.ndarray


def sequences(batch: pa.RecordBatch, text: str = "text") -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, last row + 1, word hashes with an end after each text, first token of each row)."""
    for first, last, hashes, words in hashed_texts(batch, text):
        yield first, last, np.insert(hashes, words[1:], END), words + np.arange(len(words))


class Windows:
    """The windows of a slice's texts, longest first, so that those still running are a prefix."""

    def __init__(self, offsets: np.ndarray) -> None:
        self.lengths = np.diff(offsets)
        per = -(-self.lengths // WINDOW)
        text = np.repeat(np.arange(len(per)), per)
        self.number = np.arange(len(text)) - np.repeat(np.cumsum(per) - per, per)
        begin = offsets[text] + self.number * WINDOW
        size = np.minimum(offsets[text + 1] - begin, WINDOW)
        order = np.argsort(-size, kind="stable")
        self.begin, self.size = begin[order], size[order]
        self.running = [int(n) for n in np.searchsorted(-self.size, -np.arange(self.size.max(initial=0)), "left")]
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        self.per, self.first, self.place = per, np.cumsum(per) - per, place

    def chain(self) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """For k = 0, 1, ...: the texts with a k-th window, and where that window is."""
        for k in range(int(self.per.max(initial=0))):
            texts = np.flatnonzero(self.per > k)
            yield texts, self.place[self.first[texts] + k]


def transfer(model: Model, buckets: np.ndarray, windows: Windows) -> tuple[np.ndarray, np.ndarray]:
    """Each window's scaled product of steps (row vector in, row vector out), and the logarithm of its scale."""
    k = len(model.start)
    out, scale = np.tile(np.eye(k), (len(windows.begin), 1, 1)), np.zeros(len(windows.begin))
    for t, n in enumerate(windows.running):
        step = out[:n] * model.emit[buckets[windows.begin[:n] + t]][:, None, :]
        step = (step.reshape(-1, k) @ model.move).reshape(n, k, k)
        size = step.max(axis=(1, 2))
        out[:n] = step / size[:, None, None]
        scale[:n] += np.log(size)
    return out, scale


def likelihood(model: Model, buckets: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """log10 probability of each bucket sequence."""
    windows = Windows(offsets)
    steps, scale = transfer(model, buckets, windows)
    p, total = np.tile(model.start, (len(windows.per), 1)), np.zeros(len(windows.per))
    for texts, at in windows.chain():
        q = np.einsum("nk,nkj->nj", p[texts], steps[at])
        size = q.sum(axis=1)
        p[texts] = q / size[:, None]
        total[texts] += scale[at] + np.log(size)
    return total / np.log(10)


def expect(model: Model, buckets: np.ndarray, offsets: np.ndarray, start: np.ndarray, move: np.ndarray, emit: np.ndarray) -> None:
    """Add the expected counts of a slice to start, move and emit (one forward-backward pass)."""
    windows = Windows(offsets)
    k, n_windows = len(model.start), len(windows.begin)
    if not n_windows:
        return
    steps, _ = transfer(model, buckets, windows)
    into, back = np.empty((n_windows, k)), np.empty((n_windows, k))
    p = np.tile(model.start, (len(windows.per), 1))
    chain = list(windows.chain())
    for texts, at in chain:
        into[at] = p[texts]
        q = np.einsum("nk,nkj->nj", p[texts], steps[at])
        p[texts] = q / q.sum(axis=1, keepdims=True)
    b = np.ones((len(windows.per), k))
    for texts, at in reversed(chain):
        back[at] = b[texts]
        q = np.einsum("nkj,nj->nk", steps[at], b[texts])
        b[texts] = q / q.sum(axis=1, keepdims=True)
    ahead: list[np.ndarray] = []
    p = into.copy()
    for t, n in enumerate(windows.running):
        a = p[:n] * model.emit[buckets[windows.begin[:n] + t]]
        a /= a.sum(axis=1, keepdims=True)
        ahead.append(a)
        p[:n] = a @ model.move
    posterior = np.empty((len(buckets), k))
    ends = np.zeros(len(buckets) + 1, bool)
    ends[offsets[1:]] = True
    for t in range(len(windows.running) - 1, -1, -1):
        n, a = windows.running[t], ahead[t]
        after = back[:n] @ model.move.T
        gamma = a * after
        total = gamma.sum(axis=1, keepdims=True)
        posterior[windows.begin[:n] + t] = gamma / total
        # The move into the next token counts where there is one: `back` then holds its emission and what follows.
        more = windows.begin[:n] + t + 1
        weight = (a / total) * ~ends[more][:, None]
        move += (weight.T @ back[:n]) * model.move
        back[:n] = model.emit[buckets[windows.begin[:n] + t]] * after
        back[:n] /= back[:n].sum(axis=1, keepdims=True)
    start += posterior[offsets[:-1]].sum(axis=0)
    for s in range(k):
        emit[:, s] += np.bincount(buckets, posterior[:, s], minlength=len(emit))


def improve(start: np.ndarray, move: np.ndarray, emit: np.ndarray, prior: np.ndarray) -> Model:
    """The next model; each state's emission is smoothed by the corpus shares, one part in twenty."""
    k = len(start)
    start, move = (start + 1) / (start.sum() + k), (move + 1) / (move + 1).sum(axis=1, keepdims=True)
    sums = emit.sum(axis=0)
    return Model(start, move, 0.95 * np.where(sums > 0, emit / np.maximum(sums, 1e-300), prior[:, None]) + 0.05 * prior[:, None])


def count_words(docs: DataFrame, text_col: str) -> DataFrame:
    """(word, c): how often each word, and the end, occurs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, _, hashes, _ in sequences(batch):
                words, c = np.unique(hashes, return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(words.view(np.int64)), pa.array(c.astype(np.int64))], ["word", "c"])

    return docs.select(F.col(text_col).alias("text")).mapInArrow(run, "word long, c long").groupBy("word").agg(F.sum("c").alias("c"))


def commonest(counts: DataFrame, most: int) -> pd.DataFrame:
    """The words of the largest counts, no more than `most`: a histogram of counts says from where on.

    Equal counts stay together, so that a count in which too many words share is left out with them."""
    binned = counts.withColumn("bin", F.floor(F.log2("c") * 64).cast("int"))
    sizes = binned.groupBy("bin").agg(F.count("*").alias("n")).toPandas().sort_values("bin", ascending=False)  # 4096 bins at most
    taken = sizes[sizes["n"].cumsum() <= most]
    return binned.where(F.col("bin") >= int(taken["bin"].min())).select("word", "c").toPandas() if len(taken) else pd.DataFrame({"word": np.zeros(0, np.int64), "c": np.zeros(0, np.int64)})


def _blocks(start: np.ndarray, move: np.ndarray, emit: np.ndarray) -> Iterator[pa.RecordBatch]:
    flat = np.concatenate([start, move.ravel(), emit.ravel()])
    for block, part in enumerate(np.array_split(flat, BLOCKS)):
        yield pa.RecordBatch.from_arrays([pa.array([block], pa.int32()), pa.array([part.astype("<f8").tobytes()])], ["block", "sums"])


def _sum(key: tuple[pa.Scalar, ...], parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = sum(np.frombuffer(x.as_buffer(), "<f8") for part in parts for x in part.column("sums"))
    yield pa.RecordBatch.from_arrays([pa.array([key[0].as_py()], pa.int32()), pa.array([total.tobytes()])], ["block", "sums"])


def _unpack(rows: list, states: int, buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    if not rows:
        return np.zeros(states), np.zeros((states, states)), np.zeros((buckets, states))
    flat = np.concatenate([np.frombuffer(x["sums"], "<f8") for x in sorted(rows, key=lambda x: x["block"])])
    return flat[:states], flat[states : states + states**2].reshape(states, states), flat[states + states**2 :].reshape(buckets, states)


def coarse(buckets: np.ndarray) -> np.ndarray:
    """Rows of the table of pairs: the commonest words, the end, shared ones."""
    last = OWN + SHARED
    shared = PAIRS_OWN + 1 + buckets % PAIRS_SHARED
    return np.where(buckets < PAIRS_OWN, buckets, np.where(buckets == last, PAIRS_OWN, shared))


def count_pairs(training: DataFrame, text_col: str, table_of) -> np.ndarray:
    """How often each row of the table is followed by each, within a text."""
    size = PAIRS_OWN + 1 + PAIRS_SHARED

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs = np.zeros(size * size, np.int64)
        for batch in batches:
            for _, _, hashes, offsets in sequences(batch):
                at = coarse(table_of.value.look(hashes)[0])
                inside = np.ones(len(at), bool)
                inside[offsets[1:] - 1] = False  # nothing follows the end
                inside = inside[:-1]
                pairs += np.bincount(at[:-1][inside] * size + at[1:][inside], minlength=size * size)
        pack = zstandard.ZstdCompressor(level=1).compress
        for block, part in enumerate(np.array_split(pairs, BLOCKS)):
            yield pa.RecordBatch.from_arrays([pa.array([block], pa.int32()), pa.array([pack(part.tobytes())])], ["block", "sums"])

    def merge(key: tuple[pa.Scalar, ...], parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor().decompress
        total = sum(np.frombuffer(unpack(x.as_py()), np.int64) for part in parts for x in part.column("sums"))
        packed = zstandard.ZstdCompressor(level=1).compress(total.tobytes())
        yield pa.RecordBatch.from_arrays([pa.array([key[0].as_py()], pa.int32()), pa.array([packed])], ["block", "sums"])

    counted = training.select(F.col(text_col).alias("text")).mapInArrow(count, "block int, sums binary")
    rows = counted.groupBy("block").applyInArrow(merge, "block int, sums binary").collect()  # BLOCKS rows
    if not rows:
        return np.zeros((size, size))
    unpack = zstandard.ZstdDecompressor().decompress
    return np.concatenate([np.frombuffer(unpack(bytes(x["sums"])), np.int64) for x in sorted(rows, key=lambda x: x["block"])]).reshape(size, size).astype(float)


def fit_pairs(pairs: np.ndarray, states: int, rounds: int | None = None, seed: int = 7) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[float]]:
    """(share of each state, moves, emissions, log-likelihood of each round) of a chain of states fitted to pair counts."""
    rng, size = np.random.default_rng(seed), len(pairs)
    shares = (pairs.sum(axis=0) + pairs.sum(axis=1) + 1) / (2 * pairs.sum() + size)
    p, move = np.full(states, 1 / states), 0.5 * np.eye(states) + 0.5 / states
    emit = shares[:, None] * rng.dirichlet(np.full(states, 2.0), size)
    emit /= emit.sum(axis=0)
    seen: list[float] = []
    for _ in range(PAIR_ROUNDS if rounds is None else rounds):
        joint = p[:, None] * move
        chance = emit @ joint @ emit.T
        seen.append(float((pairs * np.log(np.maximum(chance, 1e-300))).sum()))
        if len(seen) > 1 and seen[-1] - seen[-2] <= 1e-6 * abs(seen[-1]):
            break
        ratio = pairs / np.maximum(chance, 1e-300)
        moved = joint * (emit.T @ ratio @ emit)
        emitted = emit * (ratio @ emit @ joint.T) + emit * (ratio.T @ emit @ joint)
        p = (moved.sum(axis=1) + 1) / (moved.sum() + states)
        move = (moved + 1) / (moved + 1).sum(axis=1, keepdims=True)
        emit = emitted + shares[:, None]
        emit /= emit.sum(axis=0)
    return p, move, emit, seen


def train(training: DataFrame, text_col: str, words: Words, prior: np.ndarray, states: int = STATES, rounds: int = ROUNDS) -> Model:
    """Baum-Welch: a first model from counts of pairs, then `rounds` passes, both over all training texts."""
    spark, buckets = training.sparkSession, len(prior)
    table_of = spark.sparkContext.broadcast(words)
    p, move, rough, _ = fit_pairs(count_pairs(training, text_col, table_of), states)
    at = coarse(np.arange(buckets))
    emit = prior[:, None] * rough[at] / np.maximum(np.bincount(at, prior, len(rough)), 1e-300)[at][:, None]
    model = Model(p, move, 0.95 * emit / np.maximum(emit.sum(axis=0), 1e-300) + 0.05 * prior[:, None])
    for _ in range(rounds):
        current = spark.sparkContext.broadcast(model)

        def count(batches: Iterator[pa.RecordBatch], current=current) -> Iterator[pa.RecordBatch]:
            sums = np.zeros(states), np.zeros((states, states)), np.zeros((buckets, states))
            for batch in batches:
                for _, _, hashes, offsets in sequences(batch):
                    expect(current.value, table_of.value.look(hashes)[0], offsets, *sums)
            yield from _blocks(*sums)

        counted = training.select(F.col(text_col).alias("text")).mapInArrow(count, "block int, sums binary")
        rows = counted.groupBy("block").applyInArrow(_sum, "block int, sums binary").collect()
        model = improve(*_unpack(rows, states, buckets), prior)
        current.unpersist()
    return model


def score(docs: DataFrame, training: Column, id_col: str = "doc_id", text_col: str = "text", states: int = STATES, rounds: int = ROUNDS) -> DataFrame:
    """One row per document: id, training, n_tokens, n_known, train_tokens, base_score and score."""
    spark = docs.sparkSession
    kind = docs.schema[id_col].dataType.simpleString()
    known = docs.where(training).select(id_col, text_col)
    counts = cut(count_words(known, text_col))
    total, distinct = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*")).first()
    end = np.array([END], np.uint64).view(np.int64)[0].item()
    top = commonest(counts.where(F.col("word") != end), KNOWN).sort_values(["c", "word"], ascending=[False, True])
    shared = counts.where(F.col("word") != end).groupBy(F.expr(f"int(pmod(word, {SHARED}))").alias("bucket")).agg(F.sum("c").alias("c"), F.count("*").alias("v")).toPandas()
    ends = counts.where(F.col("word") == end).select("c").first()
    mass, kinds = np.zeros(OWN + SHARED + 1), np.zeros(OWN + SHARED + 1)
    mass[OWN + shared["bucket"].to_numpy(int)], kinds[OWN + shared["bucket"].to_numpy(int)] = shared["c"], shared["v"]
    hashes, c = top["word"].to_numpy(np.int64).view(np.uint64), top["c"].to_numpy(np.int64)
    own = np.where(np.arange(len(top)) < OWN, np.arange(len(top)), -1)
    leaving = OWN + (hashes[:OWN] % np.uint64(SHARED)).astype(np.int64)
    np.subtract.at(mass, leaving, c[:OWN])
    np.subtract.at(kinds, leaving, 1)
    mass[: len(c[:OWN])] = c[:OWN]
    last = OWN + SHARED
    mass[last] = ends[0] if ends else 0
    hashes, c, own = np.append(hashes, END), np.append(c, int(mass[last])), np.append(own, last)
    order = np.argsort(hashes)
    words = Words(hashes[order], c[order], own[order])
    prior = np.where(np.arange(last + 1) < OWN, mass, mass + 1)  # a shared bucket keeps room for unknown words
    prior[:OWN] += prior[:OWN] > 0
    prior /= prior.sum()
    model = train(known, text_col, words, prior, states, rounds)
    rest = np.log10(mass + kinds + 1)
    model_of, words_of = spark.sparkContext.broadcast(model), spark.sparkContext.broadcast(words)
    schema = f"kind int, row long, id {kind}, held boolean, n_tokens long, n_known long, base double, score double, word long, tf long"
    names = [x.split(" ")[0] for x in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, words = model_of.value, words_of.value
        for batch in batches:
            rows = batch.column("row").to_numpy()
            for first, to, hashes, offsets in sequences(batch):
                buckets, at = words.look(hashes)
                c = np.where(at >= 0, words.counts[at], 0)
                sizes = np.log10(c + 1.0)
                sharing = (buckets >= OWN) & (buckets < last)
                part = likelihood(model, buckets, offsets) + np.add.reduceat(np.where(sharing, sizes - rest[buckets], 0.0), offsets[:-1])
                base = np.add.reduceat(sizes, offsets[:-1])
                n = to - first
                none = lambda size, t: pa.nulls(size, t)
                # A document's own row joins nothing (kind 1); its key only spreads it.
                yield pa.RecordBatch.from_arrays([
                    pa.array(np.ones(n, np.int32)), batch.column("row").slice(first, n), batch.column("id").slice(first, n), batch.column("held").slice(first, n),
                    pa.array(np.diff(offsets)), pa.array(np.add.reduceat((c > 0).astype(np.int64), offsets[:-1])), pa.array(base), pa.array(part),
                    pa.array(mix(rows[first:to].astype(np.uint64)).view(np.int64)), none(n, pa.int64()),
                ], names)
                rare = np.flatnonzero(at < 0)
                if len(rare):
                    text = np.searchsorted(offsets, rare, "right") - 1
                    by = np.lexsort((hashes[rare], text))
                    h, text = hashes[rare][by], text[by]
                    new = np.flatnonzero(np.concatenate([[True], (h[1:] != h[:-1]) | (text[1:] != text[:-1])]))
                    m = len(new)
                    tf = np.diff(np.append(new, len(h)))
                    yield pa.RecordBatch.from_arrays([
                        pa.array(np.zeros(m, np.int32)), pa.array(rows[first + text[new]]), none(m, batch.schema.field("id").type), none(m, pa.bool_()), none(m, pa.int64()), none(m, pa.int64()),
                        none(m, pa.float64()), none(m, pa.float64()), pa.array(h[new].view(np.int64)), pa.array(tf.astype(np.int64)),
                    ], names)

    source = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("id"), F.coalesce(~training, F.lit(False)).alias("held"), F.col(text_col).alias("text"))
    scored = source.mapInArrow(run, schema)
    rare_counts = counts.select(F.lit(0).alias("kind"), "word", "c")
    met = scored.join(rare_counts, ["kind", "word"], "left")
    extra = F.col("tf") * F.log10(F.coalesce("c", F.lit(0)) + 1.0)
    return met.groupBy("row").agg(
        F.max("id").alias(id_col), F.max("held").alias("held_out"), F.max("n_tokens").alias("n_tokens"),
        F.sum(F.coalesce("n_known", F.when(F.col("c") > 0, F.col("tf")), F.lit(0))).alias("n_known"), F.lit(int(total)).cast("long").alias("train_tokens"),
        (F.sum(F.coalesce("base", extra)) - F.max("n_tokens") * float(np.log10(total + distinct + 1))).alias("base_score"), F.sum(F.coalesce("score", extra)).alias("score"),
    ).drop("row")


def op7_hmm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    training = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % 7 != 2
    return score(table(spark, sf_dir, "documents"), training)


QUERIES = {"op7_hmm_scoring": op7_hmm_scoring}
ORACLES: dict[str, str] = {}
