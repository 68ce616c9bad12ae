"""Operator 2: n-gram Jaccard join by vertical partitioning of the global n-gram order.

Documents are sets of distinct word n-grams. Equal sets form a class, and one row per class is joined. All n-grams
have one global order, rare ones first: its high bits are a rarity class from count sketches of all words and n-grams,
its low bits a hash. The order is cut into fragments. Candidate pairs (classes that share an n-gram in their prefixes, within
the length and position bounds) have their overlap counted in each fragment by itself; the partial counts are summed
per pair and compared with the threshold in whole numbers.

Pairs within a group of near copies grow with its square. For the question which documents hang together they
are not all needed: first each class is joined with one leader of each of its prefix n-grams; only classes that share
a prefix n-gram and are not yet connected are then paired with each other. Every link between different components is
still tested, so the components are exact. With `whole` every pair that shares a prefix n-gram is tested instead.

Only n-grams that more than one class has in its prefix go on after they were counted. Lists of few rows are broadcast
after their size was checked, longer ones are joined by a shuffle that Spark may split where a key is hot.

Defined results: a null or empty text, or one without words, has an empty set and links with nothing; with fewer than
n words the whole sequence is the one n-gram; repeated rows are equal sets and come back as often as they came; rows of
one id and different texts stay rows of their own; rows with a null id are joined like others, but a null id never
becomes a component's name unless all its members' ids are null; other columns are not carried; an empty table gives
an empty table.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from hustings.llm.common import cut, hashed_texts, lean, mix, remove, shared_dir, table
from hustings.llm.components import connected_components

WORD_BITS, GRAM_BITS = 22, 24
BLOCK_BITS = 16
FRAGMENTS = 4
#: A prefix n-gram of more classes than this has its leader sent to them as part of a list.
HOT = 200
#: Rows that share a key are paired by bins of sizes, so many to a factor of e; beyond CROWD that answer in a bin, those
#: that ask are dealt out.
BINS, CROWD = 10, 2000
#: Copies (8 bits, reversed), place (22) and size (30) of a class travel in one number, which orders them for the choice of
#: a leader. A place beyond 22 bits counts as less, which keeps more candidates; more copies than 255 rank as 255.
COPIES, PLACE, SIZE = (1 << 8) - 1, (1 << 22) - 1, (1 << 30) - 1
_FACTORS = mix(np.arange(101, 165, dtype=np.uint64)) | np.uint64(1)


def sketches(docs: DataFrame, n: int, text_col: str = "text", word_bits: int = WORD_BITS, gram_bits: int = GRAM_BITS) -> tuple[np.ndarray, np.ndarray]:
    """Rarity classes (floor of log2 of the count) of 2**word_bits word and 2**gram_bits n-gram buckets.

    All words and n-grams of all texts are counted. The arrays have a fixed size, whatever the corpus: buckets are
    counted in each task, summed per block of buckets. More n-grams per bucket blur the order, never the result.
    """

    def blocks(kind: int, total: np.ndarray) -> Iterator[pa.RecordBatch]:
        pack = zstandard.ZstdCompressor(level=1).compress
        for block, part in enumerate(total.reshape(-1, 1 << BLOCK_BITS)):
            if part.any():
                yield pa.RecordBatch.from_arrays([pa.array([kind], pa.int32()), pa.array([block], pa.int32()), pa.array([pack(part.tobytes())])], ["kind", "block", "packed"])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, grams = np.zeros(1 << word_bits, np.uint32), np.zeros(1 << gram_bits, np.uint8)
        for batch in batches:
            for _, _, hashes, firsts in hashed_texts(batch, "text"):
                np.add.at(words, (hashes >> np.uint64(64 - word_bits)).astype(np.int64), 1)
                if len(hashes) >= n:
                    inside = np.ones(len(hashes) - n + 1, bool)  # not across two texts
                    for k in range(1, n):
                        inside[(edges := firsts[1:-1] - k)[(edges >= 0) & (edges < len(inside))]] = False
                    at, c = np.unique(gram_hashes(hashes, n)[inside] >> np.uint64(64 - gram_bits), return_counts=True)
                    at = at.astype(np.int64)
                    grams[at] = np.minimum(grams[at] + c, 255)  # a task's count saturates; the order only needs sizes
        yield from blocks(0, words)
        yield from blocks(1, grams)

    def merge(key: tuple[pa.Scalar, ...], parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind, total = key[0].as_py(), np.zeros(1 << BLOCK_BITS, np.uint64)
        unpack = zstandard.ZstdDecompressor().decompress
        for part in parts:
            for packed in part.column("packed"):
                total += np.frombuffer(unpack(packed.as_py()), np.uint8 if kind else np.uint32)
        classes = np.where(total > 0, np.frexp(total.astype(float))[1] - 1, 0).astype(np.uint8)
        packed = zstandard.ZstdCompressor(level=1).compress(classes.tobytes())
        yield pa.RecordBatch.from_arrays([pa.array([kind], pa.int32()), pa.array([key[1].as_py()], pa.int32()), pa.array([packed])], ["kind", "block", "classes"])

    counted = docs.select(F.col(text_col).alias("text")).mapInArrow(count, "kind int, block int, packed binary")
    out = np.zeros(1 << word_bits, np.uint8), np.zeros(1 << gram_bits, np.uint8)
    unpack = zstandard.ZstdDecompressor().decompress
    for kind, block, classes in counted.groupBy("kind", "block").applyInArrow(merge, "kind int, block int, classes binary").toLocalIterator():
        out[kind][block << BLOCK_BITS : (block + 1) << BLOCK_BITS] = np.frombuffer(unpack(bytes(classes)), np.uint8)
    return out


def gram_hashes(hashes: np.ndarray, n: int) -> np.ndarray:
    count = len(hashes) - n + 1
    with np.errstate(over="ignore"):
        h = np.full(count, np.uint64(n))
        for k in range(n):
            h += hashes[k : k + count] * _FACTORS[k]
    return mix(h)


def shingle_keys(hashes: np.ndarray, n: int, rarity: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """Keys of the n-grams of one text's words, in the global order: 6 bits of rarity, 58 bits of hash.

    The class is the least of the n-gram's own bucket and its words' buckets: an n-gram is no commoner than its words.
    """
    short = len(hashes) < n
    n = min(n, len(hashes))
    count = len(hashes) - n + 1
    word_bits, gram_bits = (len(x).bit_length() - 1 for x in rarity)
    classes = rarity[0][(hashes >> np.uint64(64 - word_bits)).astype(np.int64)]
    grams = gram_hashes(hashes, n)
    least = np.full(count, 63, np.uint8) if short else rarity[1][(grams >> np.uint64(64 - gram_bits)).astype(np.int64)]
    for k in range(n):
        np.minimum(least, classes[k : k + count], out=least)
    return (least.astype(np.uint64) << np.uint64(58)) | (grams >> np.uint64(6))


def pivots(grams: np.ndarray, fragments: int) -> np.ndarray:
    """Keys that cut the global order into fragments of about equal mass, estimated from the sketch alone."""
    # By parts: bincount widens what it counts to eight bytes each.
    counts = sum(np.bincount(part[part > 0], minlength=64) for part in np.array_split(grams, max(1, len(grams) >> BLOCK_BITS)))
    mass = counts.astype(float) * 2.0 ** np.arange(64)
    edges = np.concatenate([[0.0], np.cumsum(mass)]) / max(mass.sum(), 1)
    goals = np.arange(1, fragments) / fragments
    at = np.clip(np.searchsorted(edges, goals, "right") - 1, 0, 63)
    inside = np.clip((goals - edges[at]) / np.maximum(edges[at + 1] - edges[at], 1e-12), 0, 1)
    return np.unique((at.astype(np.uint64) << np.uint64(58)) | (inside * (2.0**58 - 1)).astype(np.uint64))


def _lists(rows: list[np.ndarray]) -> pa.Array:
    offsets = np.zeros(len(rows) + 1, np.int32)
    np.cumsum([len(x) for x in rows], out=offsets[1:])
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(rows).view(np.int64) if rows else np.zeros(0, np.int64)))


def _identity(keys: np.ndarray) -> tuple[int, int]:
    """The name of a set: two independent 64-bit sums over its keys."""
    with np.errstate(over="ignore"):
        sums = np.array([mix(keys).sum(dtype=np.uint64), mix(keys ^ np.uint64(0xA5A5A5A5DEADBEEF)).sum(dtype=np.uint64)], np.uint64)
        one, two = mix(sums + np.uint64(len(keys))).view(np.int64)
    return int(one), int(two)


def _sets(batch: pa.RecordBatch, n: int, rarity: tuple[np.ndarray, np.ndarray]) -> Iterator[tuple[int, int, list[np.ndarray]]]:
    """(first row, row after the last, sorted keys of each row), by slices."""
    for first, last, hashes, words in hashed_texts(batch, "text"):
        own = [hashes[words[k] : words[k + 1]] for k in range(last - first)]
        yield first, last, [np.unique(shingle_keys(x, n, rarity)) if len(x) else np.zeros(0, np.uint64) for x in own]


def _row_hashes(id_col: str, text_col: str) -> tuple[Column, Column]:
    """Two hashes of a row's id and text, by which the row is found again."""
    name, text = F.col(f"`{id_col}`"), F.col(f"`{text_col}`")
    return F.xxhash64(name, text).alias("row"), F.xxhash64(F.lit(1), text, name).alias("twin")


def keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(*_row_hashes(id_col, text_col), F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text"))


def describe(docs: DataFrame, sketch, n: int, numerator: int, denominator: int, id_col: str, text_col: str) -> DataFrame:
    """(row, twin, id, size, s1, s2, prefix, nr): the prefix holds the rarest keys, of which two linked sets share at
    least one; s1 and s2 name the set; nr numbers the rows."""
    kind = docs.schema[id_col].dataType.simpleString()
    names = ["row", "twin", "id", "size", "s1", "s2", "prefix"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rarity = sketch.value
        for batch in batches:
            for first, last, sets in _sets(batch, n, rarity):
                part = batch.slice(first, last - first)
                lengths = [len(keys) - -(-numerator * len(keys) // denominator) + 1 if len(keys) else 0 for keys in sets]
                s1, s2 = zip(*(_identity(keys) if len(keys) else (0, 0) for keys in sets), strict=True)
                numbers = (pa.array(x, pa.int64()) for x in ([len(keys) for keys in sets], s1, s2))
                yield pa.RecordBatch.from_arrays([*(part.column(x) for x in names[:3]), *numbers, _lists([keys[:k] for keys, k in zip(sets, lengths, strict=True)])], names)

    found = keyed(docs, id_col, text_col).mapInArrow(run, f"row long, twin long, id {kind}, size long, s1 long, s2 long, prefix array<long>")
    return found.withColumn("nr", F.monotonically_increasing_id())


def _place(order: Column) -> Column:
    return F.shiftright(order, 30).bitwiseAND(F.lit(PLACE))


def _size(order: Column) -> Column:
    return order.bitwiseAND(F.lit(SIZE))


def _possible(x: Column, y: Column, numerator: int, denominator: int) -> Column:
    """Whether two sets whose first common key has these sizes and places can reach the threshold."""
    a, b = _size(x), _size(y)
    least = F.least(a - _place(x), b - _place(y))  # the most they can share
    return (denominator * F.least(a, b) >= numerator * F.greatest(a, b)) & (least * (numerator + denominator) >= numerator * (a + b))


def overlaps(pairs: DataFrame, segments: DataFrame) -> DataFrame:
    """(a, b, sizes, overlap): partial overlaps by fragment, summed per pair."""
    left = segments.select(F.col("set").alias("a"), "fragment", F.col("keys").alias("keys_a"))
    right = segments.select(F.col("set").alias("b"), "fragment", F.col("keys").alias("keys_b"))
    met = left.join(lean(pairs), "a").join(right, ["b", "fragment"])
    partial = met.select("a", "b", "sizes", F.size(F.array_intersect("keys_a", "keys_b")).cast("long").alias("partial"))
    return partial.groupBy("a", "b", "sizes").agg(F.sum("partial").alias("overlap"))


def jaccard_join(docs: DataFrame, n: int = 5, numerator: int = 80, denominator: int = 100, id_col: str = "doc_id", text_col: str = "text", fragments: int = FRAGMENTS, whole: bool = False) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(members, classes, links).

    members: nr, row, twin, id, size, set, copies of every row. classes: set, size, copies, least_id, group and component
    (the least id that links reach). links: a, b (sets), overlap - every pair of linked classes if `whole`, else enough
    to connect every component.
    """
    spark = docs.sparkSession
    folder = f"{shared_dir(spark)}/jaccard-{uuid.uuid4().hex}"
    rarity = sketches(docs, n, text_col)
    sketch = spark.sparkContext.broadcast(rarity)  # 2**WORD_BITS + 2**GRAM_BITS bytes, whatever the corpus
    cuts = pivots(rarity[1], fragments)
    del rarity  # the broadcast has its own copy on disk
    described = cut(describe(docs, sketch, n, numerator, denominator, id_col, text_col), f"{folder}/described")
    own = described.drop("prefix")
    # Only rows with equal sets need to know of each other; a row without any is a class of its own.
    equal = own.where("size > 0").groupBy("s1", "s2").agg(F.min("nr").alias("set"), F.count("*").alias("copies"), F.min("id").alias("least_id")).where("copies > 1")
    met = own.where("size > 0").join(lean(cut(equal)), ["s1", "s2"], "left")
    alone = F.col("set").isNull()
    full = met.select("row", "twin", "id", "size", "nr", F.coalesce("set", "nr").alias("set"), F.coalesce("copies", F.lit(1)).alias("copies"), F.when(alone, F.col("id")).otherwise(F.col("least_id")).alias("least_id"))
    none = [F.lit(None).cast("long").alias("set"), F.lit(None).cast("long").alias("copies"), F.col("id").alias("least_id")]
    members = cut(full.unionByName(own.where("size = 0").select("row", "twin", "id", "size", "nr", *none)), f"{folder}/members")
    classes = members.where("nr = set").drop("nr", "id")

    copied, several = members.where("nr <> set").select("nr"), members.where("nr = set and copies > 1").select("nr", "copies")
    first_rows = described.where("size > 0").join(lean(copied), "nr", "left_anti").join(lean(several), "nr", "left")
    zipped = first_rows.select(F.col("nr").alias("set"), "size", F.least(F.coalesce("copies", F.lit(1)), F.lit(COPIES)).alias("copies"), F.posexplode("prefix").alias("place", "key"))
    order = F.shiftleft(COPIES - F.col("copies"), 52) + F.shiftleft(F.least(F.col("place").cast("long"), F.lit(PLACE)), 30) + F.least("size", F.lit(SIZE))
    met = zipped.groupBy("key").agg(F.count("*").alias("n")).where("n > 1").select("key")
    shared = cut(zipped.select("key", "set", order.alias("order")).join(met, "key", "left_semi"), f"{folder}/shared")
    remove(spark, f"{folder}/described")

    def segments(wanted: DataFrame) -> DataFrame:
        """The wanted sets, cut into fragments; their texts are read again."""
        source = cut(wanted.join(classes.select("set", "row", "twin"), "set"))
        texts = keyed(docs, id_col, text_col).join(lean(source), ["row", "twin"]).select("set", "text")

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            rarity = sketch.value
            for batch in batches:
                names = batch.column("set").to_numpy()
                for first, last, sets in _sets(batch, n, rarity):
                    parts = [(name, k, part) for name, keys in zip(names[first:last], sets, strict=True) for k, part in enumerate(np.split(keys, np.searchsorted(keys, cuts))) if len(part)]
                    yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in parts], pa.int64()), pa.array([x[1] for x in parts], pa.int32()), _lists([x[2] for x in parts])], ["set", "fragment", "keys"])

        return texts.mapInArrow(run, "set long, fragment int, keys array<long>").dropDuplicates(["set", "fragment"])

    def tested(pairs: DataFrame) -> DataFrame:
        parts = cut(segments(pairs.select(F.explode(F.array("a", "b")).alias("set")).distinct()))
        found = overlaps(pairs, parts)
        return cut(found.where(denominator * F.col("overlap") >= numerator * (F.col("sizes") - F.col("overlap"))).select("a", "b", "overlap"))

    def paired(rows: DataFrame, apart: Column | bool = True) -> DataFrame:
        """Pairs of rows that share a key and whose sizes and places let them link.

        Of two rows the larger (by size, then set) asks and the other answers. What they can share behind their common key
        bounds the partner's size from above as well, so rows meet by key and bin of sizes, and a row whose key lies too far
        behind answers to none. Rows that ask are dealt out where many answer.
        """
        size, left, both = _size(F.col("order")), _size(F.col("order")) - _place(F.col("order")), numerator + denominator
        most = F.least(size, F.floor(left * both / numerator).cast("long") + 1 - size)  # one more, against rounding
        bins = lambda x: F.floor(F.log(x.cast("double")) * BINS).cast("int")
        least = F.greatest(F.lit(1), F.floor(size * numerator / denominator).cast("long"))
        asking = rows.where(most >= least).withColumn("bin", F.explode(F.sequence(bins(least), bins(most))))
        answering = rows.where(left * both >= 2 * numerator * size).withColumn("bin", bins(size))
        crowds = lean(cut(answering.groupBy("key", "bin").count().where(F.col("count") > CROWD).select("key", "bin", F.ceil(F.col("count") / CROWD).cast("int").alias("deals"))))
        deals = F.coalesce("deals", F.lit(1))
        x = asking.join(crowds, ["key", "bin"], "left").withColumn("deal", F.pmod(F.xxhash64("set"), deals).cast("int")).alias("x")
        y = answering.join(crowds, ["key", "bin"], "left").withColumn("deal", F.explode(F.sequence(F.lit(0), deals - 1))).alias("y")
        asks = (_size(F.col("x.order")) > _size(F.col("y.order"))) | ((_size(F.col("x.order")) == _size(F.col("y.order"))) & (F.col("x.set") < F.col("y.set")))
        same = (F.col("x.key") == F.col("y.key")) & (F.col("x.bin") == F.col("y.bin")) & (F.col("x.deal") == F.col("y.deal"))
        met = x.join(y, same & asks & F.lit(apart) & _possible(F.col("x.order"), F.col("y.order"), numerator, denominator))
        a, b = F.col("x.set"), F.col("y.set")
        return met.select(F.least(a, b).alias("a"), F.greatest(a, b).alias("b"), (_size(F.col("x.order")) + _size(F.col("y.order"))).alias("sizes")).distinct()

    if whole:
        first = cut(paired(shared))
    else:
        # The leader is the class with the most copies: near copies gather around the text they came from.
        lead = cut(shared.groupBy("key").agg(F.min("order").alias("best"), F.min_by("set", "order").alias("lead"), F.count("*").alias("n")))
        # Keys of many classes are few, so their leaders go to the rows as a list; the others meet theirs by a shuffle.
        hot = lean(lead.where(F.col("n") > HOT).drop("n"))
        usual = shared.join(hot.select("key"), "key", "left_anti").join(lead.where(F.col("n") <= HOT).drop("n"), "key")
        led = shared.join(hot, "key").unionByName(usual).where((F.col("set") != F.col("lead")) & _possible(F.col("order"), F.col("best"), numerator, denominator))
        low, high = F.least("set", "lead"), F.greatest("set", "lead")
        first = cut(led.select(low.alias("a"), high.alias("b"), (_size(F.col("order")) + _size(F.col("best"))).alias("sizes")).distinct())
    links = tested(first)
    joined = cut(connected_components(links).withColumnRenamed("node", "set"))
    if not whole:
        placed = shared.join(lean(joined), "set", "left").withColumn("component", F.coalesce("component", "set"))
        open_keys = cut(placed.groupBy("key").agg(F.min("component").alias("low"), F.max("component").alias("high")).where("low <> high").select("key"))
        if not open_keys.isEmpty():
            rest = cut(placed.join(lean(open_keys), "key"))
            second = cut(paired(rest, F.col("x.component") != F.col("y.component")).join(lean(first.select("a", "b")), ["a", "b"], "left_anti"))
            more = second if second.isEmpty() else tested(second)
            if not more.isEmpty():
                links = cut(links.unionByName(more))
                joined = cut(connected_components(links).withColumnRenamed("node", "set"))
    remove(spark, f"{folder}/shared")
    linked = lean(joined)
    names = cut(classes.join(linked, "set").groupBy("component").agg(F.min("least_id").alias("name")))  # a class without a link has its own
    placed = classes.join(linked, "set", "left").join(lean(names), "component", "left")
    name = F.when(F.col("component").isNull(), F.col("least_id")).otherwise(F.col("name"))
    return members.drop("least_id"), cut(placed.select("set", "size", "copies", "least_id", F.coalesce("component", "set").alias("group"), name.alias("component"))), links


def labelled(members: DataFrame, classes: DataFrame) -> DataFrame:
    """members with the group and the component of their class; an empty set is a component of its own."""
    full = members.where("size > 0").join(classes.select("set", "group", "component"), "set")
    return full.unionByName(members.where("size = 0").withColumns({"group": F.lit(None).cast("long"), "component": F.col("id")}))


def first_of_each(docs: DataFrame, n: int = 5, numerator: int = 80, denominator: int = 100, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The input rows without near duplicates: of each component the document with the least id stays.

    Ids that are null come after all others, and of equal ids with different texts the one with the least hash stays.
    Rows with an empty set stay. Of rows equal in id and text one stays, whatever their other columns. All columns are
    kept, whatever their names.
    """
    members, classes, _ = jaccard_join(docs, n, numerator, denominator, id_col, text_col)
    rows = labelled(members, classes)
    first = F.min(F.struct(F.col("id").isNull().alias("unnamed"), "id", "row", "twin"))
    keepers = cut(rows.where("size > 0").groupBy("group").agg(first.alias("keep"), F.count("*").alias("n")).where("n > 1").drop("n"))
    gone = rows.where("size > 0").join(lean(keepers), "group").where((F.col("row") != F.col("keep.row")) | (F.col("twin") != F.col("keep.twin"))).select("row", "twin").distinct()
    again = members.groupBy("row", "twin").agg(F.count("*").alias("n")).where("n > 1").select("row", "twin")
    marks = ["row", "twin"]
    tagged = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("doc"), *_row_hashes(id_col, text_col))
    kept = tagged.join(lean(cut(gone)), marks, "left_anti")
    again = cut(again)
    if not again.isEmpty():
        kept = kept.join(lean(again), marks, "left_anti").unionByName(kept.join(lean(again), marks, "left_semi").dropDuplicates(marks))
    return kept.select("doc.*")


def op2_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    members, classes, _ = jaccard_join(table(spark, sf_dir, "documents"), n=3, numerator=90)
    return labelled(members, classes).select(F.col("id").alias("doc_id"), F.col("size").alias("n_shingles"), F.col("component").alias("component_id"))


QUERIES = {"op2_ngram_jaccard": op2_ngram_jaccard}
ORACLES: dict[str, str] = {}
