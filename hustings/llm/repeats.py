"""Operator 13: removal of repeated byte strings, by bucket-pointer refinement of suffixes.

Every byte that lies in a string of `length` bytes which also starts earlier (in a document before, or earlier in the
same one) is removed. All suffixes of a corpus don't fit through a shuffle, so their number is cut down first, without
losing one that matters:

1. Anchors. Each string of `length` bytes selects the smallest of its q-grams; what it selects depends on its own bytes
   alone, so equal strings select equal anchors at the same place. Only anchors are shuffled, one in some 30 bytes: the
   q-gram's bucket, and a hash of the whole surroundings in which a string that holds the anchor can lie. Of equal
   surroundings the first stays, the others are repeats as a whole; this is done in each Arrow batch before the shuffle,
   so that very common passages send a row a batch.
2. Buckets with different surroundings. The suffixes that start up to length - q bytes before these anchors are refined:
   their initial buckets are their q-grams; a bucket is sorted by the bucket identifiers of the suffixes `depth` bytes
   later, which doubles the depth, and the refined identifiers serve the next step, up to `length` bytes. A suffix alone
   in its bucket drops out. Of each bucket that is left the first suffix stays, the others are repeats.
3. Buckets with more than HOT members aren't gathered. Each of their strings of `length` bytes becomes a row of its own,
   hashed twice and grouped by a shuffle like the anchors.

Documents are ordered by id; rows with one id and different texts follow a hash of the text. The texts are read once for
the anchors and joined twice by id. Memory follows a batch and HOT, not the corpus.

Defined results: a null or empty text has no bytes; a null id comes before all others; rows equal in id and text are one
document and come back as often as they came; long texts are worked on in pieces with overlap; other columns are not
carried, so their names can't clash; an empty table gives an empty table.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hustings.llm.common import cut, lean, mix, table, texts_of
from hustings.llm.periodic import selected

LENGTH, GRAM = 100, 32
#: More members than this of one bucket are compared by a shuffle of their strings.
HOT = 20_000
PIECE = 1 << 20
#: So many anchors of a task are compared with each other before they are shuffled.
TOGETHER = 1 << 18
#: So many members of buckets are refined at a time.
CHUNK = 4096
_BASE = 0x9E3779B97F4A7C15
_ODD = np.uint64(0xD6E8FEB86659FD93)


class Rolling:
    """Hashes of all substrings of some bytes, from prefix sums of powers modulo 2**64."""

    _up = _down = np.ones(1, np.uint64)

    def __init__(self, raw: np.ndarray, seed: int = 0) -> None:
        if len(Rolling._up) <= len(raw):
            n = max(len(raw), PIECE)
            Rolling._up, Rolling._down = (np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(n, b, np.uint64)]), dtype=np.uint64) for b in (_BASE, pow(_BASE, -1, 1 << 64)))
        letters = mix(np.arange(1 + 256 * seed, 257 + 256 * seed, dtype=np.uint64) * np.uint64(_BASE)) | np.uint64(1)
        self.sums = np.zeros(len(raw) + 1, np.uint64)
        np.cumsum(letters[raw] * self._up[: len(raw)], dtype=np.uint64, out=self.sums[1:])

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self.sums[end] - self.sums[start]) * self._down[start])

    def grams(self, q: int) -> np.ndarray:
        return mix((self.sums[q:] - self.sums[:-q]) * self._down[: len(self.sums) - q])


def anchors(raw: np.ndarray, offsets: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, ...]:
    """(text, place in the text, bucket, surroundings, bytes from the place to the end of the surroundings) of all anchors."""
    reach = length - gram
    if len(raw) < length:
        return tuple(np.zeros(0, kind) for kind in (np.int64, np.int64, np.uint64, np.uint64, np.int64))
    with np.errstate(over="ignore"):
        rolling = Rolling(raw)
        grams = rolling.grams(gram)
        values = (grams >> np.uint64(33)).astype(np.uint32) | np.uint32(1)
        at = selected(values, reach + 1, starts_without(offsets, length, len(raw) - length + 1))
        text = np.searchsorted(offsets, at, "right") - 1
        low, high = np.maximum(at - reach, offsets[text]), np.minimum(at + length, offsets[text + 1])
        around = mix(rolling.of(low, high) + ((high - low) * 4096 + at - low).astype(np.uint64) * _ODD)
    return text, at - offsets[text], grams[at], around, high - at


def starts_without(offsets: np.ndarray, length: int, count: int) -> np.ndarray:
    """Which of the first `count` places don't start a string of this length inside one text."""
    out = np.zeros(count, bool)
    for low, high in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
        out[max(low, high - length + 1) : high] = True
    return out


def pieces(raw: np.ndarray, offsets: np.ndarray, length: int, gram: int) -> Iterator[tuple[np.ndarray, ...]]:
    """The anchors of a batch, by pieces of about PIECE bytes; (text, place, bucket, surroundings, right)."""
    reach, row, rows = length - gram, 0, len(offsets) - 1
    while row < rows:
        end = max(row + 1, int(np.searchsorted(offsets, offsets[row] + PIECE, "right")) - 1)
        part = raw[offsets[row] : offsets[end]]
        if len(part) <= 2 * PIECE:
            text, place, *rest = anchors(part, offsets[row : end + 1] - offsets[row], length, gram)
            yield text + row, place, *rest
        else:  # one long text, with as much overlap as an anchor's surroundings
            for low in range(0, len(part), PIECE):
                first, last = max(0, low - reach), min(len(part), low + PIECE + length)
                text, place, *rest = anchors(part[first:last], np.array([0, last - first]), length, gram)
                own = (place + first >= low) & (place + first < low + PIECE)
                yield text[own] + row, place[own] + first, *(x[own] for x in rest)
        row = end


def _columns(batch: pa.RecordBatch, *names: str) -> list[np.ndarray]:
    return [batch.column(x).to_numpy(zero_copy_only=False) for x in names]


def _changes(*columns: np.ndarray) -> np.ndarray:
    """Which rows differ from the one before; the first does."""
    out = np.ones(len(columns[0]), bool)
    out[1:] = np.any([x[1:] != x[:-1] for x in columns], axis=0)
    return out


def _batch(columns: list, names: list[str]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([x if isinstance(x, pa.Array) else pa.array(x) for x in columns], names)


_SENT = "bucket long, around long, id long, tie long, at long, right long"
_SENT_NAMES = ["bucket", "around", "id", "tie", "at", "right"]


def _send(bucket: np.ndarray, around: np.ndarray, ident: np.ndarray, tie: np.ndarray, at: np.ndarray, right: np.ndarray, reach: int) -> Iterator[pa.RecordBatch]:
    """Of equal buckets and surroundings the first; the others as removed stretches, joined where they meet.

    A removed stretch has no surroundings, and a bucket only to be dealt out by."""
    bucket, around = bucket.view(np.int64), around.view(np.int64)
    order = np.lexsort((at, tie, ident, around, bucket))
    bucket, around, ident, tie, at, right = (x[order] for x in (bucket, around, ident, tie, at, right))
    first = _changes(bucket, around)
    same = ~_changes(bucket, around, ident, tie, at)  # the same place, by a repeated row
    yield _batch([x[first] for x in (bucket, around, ident, tie, at, right)], _SENT_NAMES)
    gone = ~first & ~same
    low, high, ident, tie = np.maximum(at[gone] - reach, 0), (at + right)[gone], ident[gone], tie[gone]
    if len(low):
        order = np.lexsort((low, tie, ident))
        low, high, ident, tie = (x[order] for x in (low, high, ident, tie))
        other = _changes(ident, tie)
        # The end reached so far, which starts anew with each document: shift documents apart, take the running maximum.
        shift = np.cumsum(other) * (int(high.max()) + 1)
        reached = np.maximum.accumulate(high + shift)
        start = other.copy()
        start[1:] |= low[1:] + shift[1:] > reached[:-1]
        starts = np.flatnonzero(start)
        ends = np.append(starts[1:], len(low)) - 1
        low, high, ident, tie = low[starts], (reached - shift)[ends], ident[starts], tie[starts]
        with np.errstate(over="ignore"):
            spread = mix(ident.view(np.uint64) + low.view(np.uint64) * _ODD).view(np.int64)
        yield _batch([spread, pa.nulls(len(low), pa.int64()), ident, tie, low, high - low], _SENT_NAMES)


def _anchored(length: int, gram: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names = _columns(batch, "id", "tie")
            found: list[tuple[np.ndarray, ...]] = []

            def flush(found: list = found, names: list = names) -> Iterator[pa.RecordBatch]:
                text, at, bucket, around, right = (np.concatenate(x) for x in zip(*found, strict=True))
                found.clear()
                yield from _send(bucket, around, *(x[text] for x in names), at, right, length - gram)

            for piece in pieces(*texts_of(batch.column("text")), length, gram):
                found.append(piece)
                if sum(len(x[0]) for x in found) >= TOGETHER:
                    yield from flush()
            if found:
                yield from flush()

    return run


_FOUND = "id long, tie long, at long, right long, bucket long, nr long"
_FOUND_NAMES = ["id", "tie", "at", "right", "bucket", "nr"]


def _firsts(reach: int):
    """Goes once through rows sorted by bucket, surroundings and place. Repeated surroundings come out as stretches without
    a bucket; the first of each come out with their number in the bucket, if it has several."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros((6, 0), np.int64)  # the last row
        nr = 0  # of the last row's surroundings in its bucket
        waiting = False  # the last surroundings are the first of their bucket and not yet out
        lone = held
        for batch in batches:
            gone = batch.filter(batch.column("around").is_null())
            if gone.num_rows:
                yield _batch([*(gone.column(x) for x in _FOUND_NAMES[:4]), pa.nulls(gone.num_rows, pa.int64()), pa.nulls(gone.num_rows, pa.int64())], _FOUND_NAMES)
            rows = batch.filter(batch.column("around").is_valid())
            if not rows.num_rows:
                continue
            own = np.array(_columns(rows, *_SENT_NAMES))
            all_rows = np.concatenate([held, own], axis=1)
            begun = held.shape[1]
            held = own[:, -1:]
            bucket, around, ident, tie, at, right = all_rows
            new_bucket, new_around, new_place = _changes(bucket), _changes(bucket, around), _changes(bucket, around, ident, tie, at)
            fresh = np.arange(len(bucket)) >= begun  # not the row kept from before
            again = fresh & ~new_around & new_place
            if again.any():
                low = np.maximum(at[again] - reach, 0)
                yield _batch([ident[again], tie[again], low, (at + right)[again] - low, pa.nulls(len(low), pa.int64()), pa.nulls(len(low), pa.int64())], _FOUND_NAMES)
            first = np.flatnonzero(fresh & new_around)
            if not len(first):
                continue
            # Number of each first in its bucket: firsts since the bucket's own beginning, on top of those of batches before.
            count = np.arange(len(first))
            opens = new_bucket[first]
            since = np.maximum.accumulate(np.where(opens, count, -1))
            number = np.where(since >= 0, count - since, count + nr + 1)
            if waiting and not opens[0]:
                yield _batch([*(lone[[2, 3, 4, 5, 0]]), np.zeros(1, np.int64)], _FOUND_NAMES)
            several = number > 0
            several[:-1] |= ~opens[1:]
            picked = first[several]
            if len(picked):
                yield _batch([ident[picked], tie[picked], at[picked], right[picked], bucket[picked], number[several]], _FOUND_NAMES)
            nr, waiting, lone = int(number[-1]), not several[-1], all_rows[:, first[-1:]]

    return run


def refine(grams: np.ndarray, valid: np.ndarray, gram: int, length: int) -> np.ndarray:
    """Bucket pointers of suffixes at depth `length`; -1 for a suffix alone in its bucket, or too short.

    grams: (members, places) identifiers of q-grams; two are compared if equal. valid: where a whole q-gram lies."""
    members, places = grams.shape
    pointer = np.full((members, places), -1, np.int64)

    def sort(keys: np.ndarray, at: np.ndarray) -> None:
        """New buckets by key, for the suffixes at these flat places; the others have none."""
        _, bucket, size = np.unique(keys, return_inverse=True, return_counts=True)
        pointer.fill(-1)
        pointer.ravel()[at] = np.where(size[bucket] > 1, bucket, -1)

    at = np.flatnonzero(valid)
    sort(grams.ravel()[at], at)
    depth = gram
    while depth < length:
        step = min(depth, length - depth)
        later = np.full_like(pointer, -1)
        later[:, : places - step] = pointer[:, step:]
        at = np.flatnonzero((pointer >= 0) & (later >= 0))
        one, two = pointer.ravel()[at], later.ravel()[at]
        sort(one * (two.max(initial=0) + 1) + two, at)  # below 2**63: both are numbers of places in a chunk
        depth += step
    return pointer


def _refined(length: int, gram: int):
    """Goes once through members sorted by bucket and place, whole buckets at a time."""
    reach = length - gram
    width = reach + length

    def work(rows: pa.Table) -> pa.RecordBatch:
        bucket, ident, tie, at, left, right = (rows.column(x).to_numpy() for x in ("bucket", "id", "tie", "at", "left", "right"))
        raw, offsets = texts_of(rows.column("piece"))
        matrix = np.zeros((len(bucket), width), np.uint8)
        size = np.diff(offsets)
        owner = np.repeat(np.arange(len(bucket)), size)
        matrix[owner, np.arange(len(raw)) - offsets[owner] + reach - left[owner]] = raw
        group = np.cumsum(_changes(bucket))
        place = np.arange(width - gram + 1)
        with np.errstate(over="ignore"):
            flat = Rolling(matrix.ravel()).grams(gram)
            flat = np.concatenate([flat, np.zeros(gram - 1, np.uint64)]).reshape(matrix.shape)[:, : width - gram + 1]
            named = mix(flat + group[:, None].astype(np.uint64) * _ODD)
        valid = (place >= (reach - left)[:, None]) & (place + gram <= (reach + right)[:, None])
        pointer = refine(named, valid, gram, length)[:, : reach + 1]
        member, column = np.nonzero(pointer >= 0)
        kept = pointer[member, column]
        start = at[member] - reach + column
        order = np.lexsort((start, tie[member], ident[member], kept))
        member, kept, start = member[order], kept[order], start[order]
        first = _changes(kept)
        # The first of a bucket stays, and so do equal starts in the same document: they are the same place.
        lead = np.maximum.accumulate(np.where(first, np.arange(len(first)), 0))
        again = (start != start[lead]) | (ident[member] != ident[member[lead]]) | (tie[member] != tie[member[lead]])
        member, start = member[again], start[again]
        # A member's strings all hold its anchor, so they are one stretch.
        low, high = np.full(len(bucket), np.iinfo(np.int64).max), np.full(len(bucket), -1)
        np.minimum.at(low, member, start)
        np.maximum.at(high, member, start)
        hit = high >= 0
        return _batch([ident[hit], tie[hit], low[hit], (high - low)[hit] + length], _FOUND_NAMES[:4])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: list[pa.RecordBatch] = []
        rows = 0
        for batch in batches:
            parts.append(batch)
            rows += batch.num_rows
            if rows >= CHUNK:
                whole = pa.Table.from_batches(parts).combine_chunks()
                bucket = whole.column("bucket").to_numpy()
                done = int(np.searchsorted(bucket, bucket[-1]))  # the last bucket may go on
                if done:
                    yield work(whole.slice(0, done).combine_chunks())
                parts, rows = whole.slice(done).to_batches(), len(bucket) - done
        if rows:
            yield work(pa.Table.from_batches(parts).combine_chunks())

    return run


def _cut_out(length: int, gram: int):
    """The surroundings of the wanted anchors of each text."""
    reach = length - gram

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, offsets = texts_of(batch.column("text"))
            wanted = batch.column("wanted")
            text = np.repeat(np.arange(batch.num_rows), np.diff(wanted.offsets.to_numpy()))
            ident, tie = (x[text] for x in _columns(batch, "id", "tie"))
            at, right, bucket = (wanted.flatten().field(x).to_numpy(zero_copy_only=False) for x in ("at", "right", "bucket"))
            left = np.minimum(at, reach)
            for k in range(0, len(at), CHUNK):
                own = slice(k, k + CHUNK)
                low = offsets[text[own]] + at[own] - left[own]
                size = left[own] + right[own]
                ends = np.concatenate([[0], np.cumsum(size)])
                data = raw[np.repeat(low - ends[:-1], size) + np.arange(ends[-1])]
                piece = pa.Array.from_buffers(pa.binary(), len(size), [None, pa.py_buffer(ends.astype(np.int32)), pa.py_buffer(data.tobytes())])
                yield _batch([bucket[own], ident[own], tie[own], at[own], left[own], right[own], piece], ["bucket", "id", "tie", "at", "left", "right", "piece"])

    return run


def _strings(length: int, gram: int):
    """Every string of the given length in members' surroundings, hashed twice."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, CHUNK):
                part = batch.slice(k, CHUNK)
                raw, offsets = texts_of(part.column("piece"))
                ident, tie, at, left = _columns(part, "id", "tie", "at", "left")
                start = np.flatnonzero(~starts_without(offsets, length, max(0, len(raw) - length + 1)))
                member = np.searchsorted(offsets, start, "right") - 1
                with np.errstate(over="ignore"):
                    one, two = (Rolling(raw, seed).of(start, start + length) for seed in (1, 2))
                place = (at - left)[member] + start - offsets[member]
                yield from _send(one, two, ident[member], tie[member], place, np.full(len(start), length), 0)

    return run


def ordered(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, tie, text): tie is 0 but for ids that several rows have, where it is a hash of the text."""
    least = -(1 << 63)
    rows = docs.select(F.coalesce(F.col(f"`{id_col}`").cast("long"), F.lit(least)).alias("id"), F.col(f"`{text_col}`").alias("text"))
    several = cut(rows.groupBy("id").agg(F.count("*").alias("n")).where("n > 1").select("id", F.lit(True).alias("several")))
    if several.isEmpty():
        return rows.select("id", F.lit(0).cast("long").alias("tie"), "text")
    return rows.join(lean(several), "id", "left").select("id", F.when(F.col("several"), F.xxhash64("text")).otherwise(0).alias("tie"), "text")


def repeated_stretches(rows: DataFrame, length: int = LENGTH, gram: int = GRAM, hot: int = HOT) -> DataFrame:
    """(id, tie, at, right): stretches of bytes that are repeats, unmerged, for rows of (id, tie, text)."""
    sent = rows.where(F.octet_length("text") >= length).mapInArrow(_anchored(length, gram), _SENT)
    sort = ["bucket", "around", "id", "tie", "at"]
    found = cut(sent.repartition("bucket").sortWithinPartitions(*sort).mapInArrow(_firsts(length - gram), _FOUND), release=True)
    wanted = found.where("bucket is not null")
    large = cut(wanted.where(F.col("nr") == hot).select("bucket"))
    any_large = not large.isEmpty()

    def around(members: DataFrame) -> DataFrame:
        own = members.groupBy("id", "tie").agg(F.collect_list(F.struct("at", "right", "bucket")).alias("wanted"))  # of one text
        texts = rows.join(own, ["id", "tie"])
        return texts.select("id", "tie", "text", "wanted").mapInArrow(_cut_out(length, gram), "bucket long, id long, tie long, at long, left long, right long, piece binary")

    usual = wanted.join(lean(large), "bucket", "left_anti") if any_large else wanted
    members = around(usual).repartition("bucket").sortWithinPartitions("bucket", "id", "tie", "at")
    more = [cut(members.mapInArrow(_refined(length, gram), "id long, tie long, at long, right long"), release=True)]
    if any_large:
        strings = around(wanted.join(lean(large), "bucket", "left_semi")).mapInArrow(_strings(length, gram), _SENT)
        firsts = strings.repartition("bucket").sortWithinPartitions(*sort).mapInArrow(_firsts(0), _FOUND)
        more.append(cut(firsts.where("bucket is null").select("id", "tie", "at", "right"), release=True))
    out = found.where("bucket is null").select("id", "tie", "at", "right")
    for part in more:
        out = out.unionByName(part)
    return out


def without_repeats(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, id_col: str = "doc_id", text_col: str = "text", hot: int = HOT) -> DataFrame:
    """(id, n_bytes, spans, kept) of every row: the removed stretches, merged, and the bytes that remain."""
    rows = ordered(docs, id_col, text_col)
    stretches = repeated_stretches(rows, length, gram, hot).groupBy("id", "tie").agg(F.collect_list(F.struct("at", "right")).alias("gone"))  # of one text
    span_type = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, offsets = texts_of(batch.column("text"))
            gone = pa.ListArray.from_arrays(*_filled(batch.column("gone")))
            edges = gone.offsets.to_numpy()
            low = gone.values.field("at").to_numpy()
            high = low + gone.values.field("right").to_numpy()
            spans, kept, sizes = [], [], np.diff(offsets)
            for k in range(batch.num_rows):
                own = slice(edges[k], edges[k + 1])
                text = raw[offsets[k] : offsets[k + 1]]
                if edges[k] == edges[k + 1]:
                    spans.append([])
                    kept.append(text.tobytes())
                    continue
                order = np.argsort(low[own], kind="stable")
                a, b = low[own][order], np.maximum.accumulate(high[own][order])
                opens = np.flatnonzero(np.concatenate([[True], a[1:] > b[:-1]]))
                starts, ends = a[opens], b[np.append(opens[1:], len(a)) - 1]
                spans.append([{"start": int(x), "length": int(y - x)} for x, y in zip(starts, ends, strict=True)])
                between = zip(np.append(0, ends), np.append(starts, len(text)), strict=True)
                kept.append(b"".join(text[x:y].tobytes() for x, y in between))
            yield _batch([batch.column("id"), sizes.astype(np.int64), pa.array(spans, span_type), pa.array(kept, pa.binary())], ["id", "n_bytes", "spans", "kept"])

    joined = rows.join(stretches, ["id", "tie"], "left").select("id", "text", "gone")
    out = joined.mapInArrow(run, "id long, n_bytes long, spans array<struct<start: long, length: long>>, kept binary")
    return out.withColumn("id", F.when(F.col("id") != -(1 << 63), F.col("id")))


def _filled(lists: pa.ListArray) -> tuple[pa.Array, pa.Array]:
    """Offsets and values of a list column in which null is empty."""
    sizes = lists.value_lengths().fill_null(0).to_numpy()
    return pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)), lists.flatten()


def brute_force(docs: list[tuple[int, bytes]], length: int = LENGTH) -> dict[int, tuple[list[tuple[int, int]], bytes]]:
    """Spans and remaining bytes by id, with a set of all strings; for tests."""
    seen: set[bytes] = set()
    out = {}
    for name, text in sorted(docs):
        gone = np.zeros(len(text), bool)
        for k in range(len(text) - length + 1):
            part = text[k : k + length]
            if part in seen:
                gone[k : k + length] = True
            seen.add(part)
        edges = np.flatnonzero(np.diff(np.concatenate([[False], gone, [False]]).astype(np.int8)))
        out[name] = [(int(a), int(b - a)) for a, b in zip(edges[::2], edges[1::2], strict=True)], bytes(np.frombuffer(text, np.uint8)[~gone])
    return out


def op13_repeated_strings(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = without_repeats(table(spark, sf_dir, "documents"))
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["length"])
    return found.select(F.col("id").alias("doc_id"), "n_bytes", removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


def digest(kept: bytes) -> str:
    return hashlib.sha256(kept).hexdigest()


QUERIES = {"op13_repeated_strings": op13_repeated_strings}
ORACLES: dict[str, str] = {}
