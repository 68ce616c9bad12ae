"""Operator 1: byte-level BPE encoding by overlapping chunks, and decoding.

A text longer than one chunk is cut into chunks that overlap. Every chunk is pre-tokenised by itself, on any executor.
The pattern matches from left to right without looking back, so once two neighbouring chunks agree on one pre-token
boundary inside their overlap, they agree on all that follow: the text can be cut there, unless white space stands
before the boundary (the pattern looks ahead behind white space, and the piece's end would hide what follows). The
pieces between such boundaries are encoded independently and their ids concatenated. Neighbours without such a boundary
within the overlap (one pre-token longer than it) stay one piece; the scan goes on from the last sure boundary, so that
the next neighbours can agree again.

Defined results: a null text encodes like an empty one, to no ids; repeated rows give repeated rows; columns other than
the id and the text are not carried (their names cannot clash); an empty table gives an empty table.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
import tiktoken
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hustings.llm.common import table

CHUNK, OVERLAP = 16_384, 512
#: A match that ends this close to a chunk's end might differ if the chunk went on.
MARGIN = 4


@lru_cache(maxsize=4)
def encoding(path: str, pattern: str) -> tiktoken.Encoding:
    """The tokenizer of a rank file, without special tokens; built once in a worker."""
    with open(path, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def ids_of(own: tiktoken.Encoding, text: str) -> np.ndarray:
    return np.frombuffer(own._core_bpe.encode_to_tiktoken_buffer(text, set()), np.uint32) if text else np.zeros(0, np.uint32)


def boundaries(text: str, pattern: str, low: int, high: int, last: bool) -> tuple[list[int], list[int]]:
    """Sure starts of pre-tokens in text up to `low` and from `high` on."""
    head, tail, sure = [], [], len(text) if last else len(text) - MARGIN
    previous = 0
    for m in regex.compile(pattern).finditer(text):
        if m.start() != previous or m.end() > sure:
            break
        previous = m.end()
        if m.start() <= low:
            head.append(m.start())
        if previous >= high:
            tail.append(previous)
    return head, tail


def _ints(rows: list[np.ndarray]) -> pa.Array:
    offsets = np.zeros(len(rows) + 1, np.int32)
    np.cumsum([len(x) for x in rows], out=offsets[1:])
    flat = np.concatenate(rows).astype(np.int32) if rows else np.zeros(0, np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))


def chunks(docs: DataFrame, text_col: str, chunk: int, overlap: int) -> DataFrame:
    """(row, id, chunk_no, last, body) of the texts of (row, id, text)."""

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                text = batch.column(text_col)[k].as_py()
                starts = range(0, max(1, len(text) - overlap), chunk)
                bodies = [text[s : len(text) if s == starts[-1] else s + chunk + overlap] for s in starts]
                at = pa.array(np.zeros(len(bodies), np.int64))
                row = batch.slice(k, 1)
                last = [n == len(bodies) - 1 for n in range(len(bodies))]
                yield pa.RecordBatch.from_arrays([row.column("row").take(at), row.column("id").take(at), pa.array(range(len(bodies)), pa.int32()), pa.array(last), pa.array(bodies, pa.string())], ["row", "id", "chunk_no", "last", "body"])

    kind = docs.schema["id"].dataType.simpleString()
    return docs.mapInArrow(split, f"row long, id {kind}, chunk_no int, last boolean, body string")


def pieces(spread: DataFrame, pattern: str, chunk: int, overlap: int) -> DataFrame:
    """Chunks cut at the boundaries where neighbours resynchronise: (row, id, piece_no, body)."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            heads, tails = [], []
            for body, last in zip(batch.column("body").to_pylist(), batch.column("last").to_pylist(), strict=True):
                head, tail = boundaries(body, pattern, overlap, chunk, last)
                heads.append(head)
                tails.append(tail)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(heads, pa.list_(pa.int32())), pa.array(tails, pa.list_(pa.int32()))], [*batch.schema.names, "head", "tail"])

    kind = spread.schema["id"].dataType.simpleString()
    scanned = spread.mapInArrow(scan, f"row long, id {kind}, chunk_no int, last boolean, body string, head array<int>, tail array<int>")
    # A row's chunks meet again by its number; a group is one row, never more than the text it came from.
    return scanned.groupBy("row").applyInArrow(lambda group: _stitch(group, pattern, chunk), f"row long, id {kind}, piece_no int, body string")


def cuts_of(bodies: list[str], heads: list[list[int]], tails: list[list[int]], pattern: str, chunk: int) -> list[int]:
    """Places of the text at which neighbouring chunks agree and no white space precedes.

    A chunk's own boundaries count once its scan is tied to the text's start, through one that its neighbour agrees on.
    Where neighbours agree on none, the scan goes on from the last sure boundary through the next chunk.
    """
    found: list[int] = []
    sure, last, scanned = set(tails[0]), max(tails[0], default=0), 0
    for k in range(1, len(bodies)):
        base = k * chunk
        both = sorted(sure.intersection(base + x for x in heads[k]))
        if both:
            safe = next((x for x in both if not (bodies[k][x - base - 1] if x > base else bodies[k - 1][x - base + chunk - 1]).isspace()), None)
            if safe is not None:
                found.append(safe)
            sure, scanned = {base + x for x in tails[k]}, 0
            last = max(sure, default=both[-1])
            continue
        sure = set()
        end = base + len(bodies[k])
        if end - last >= 2 * scanned:  # one long pre-token is read again only after its length has doubled
            low = last // chunk
            text = "".join([*(x[:chunk] for x in bodies[low:k]), bodies[k]])[last - low * chunk :]
            head, tail = boundaries(text, pattern, -1, base + chunk - last, k == len(bodies) - 1)
            sure, scanned = {last + x for x in tail}, end - last
            if sure:
                last, scanned = max(sure), 0
    return found


def _stitch(group: pa.Table, pattern: str, chunk: int) -> pa.Table:
    group = group.sort_by("chunk_no")
    bodies, heads, tails = (group.column(c).to_pylist() for c in ("body", "head", "tail"))
    text = "".join([*(x[:chunk] for x in bodies[:-1]), bodies[-1]])
    edges = [0, *cuts_of(bodies, heads, tails, pattern, chunk), len(text)]
    out = [text[a:b] for a, b in zip(edges, edges[1:], strict=False)]
    n = len(out)
    same = pa.array(np.zeros(n, np.int64))
    return pa.table({"row": group.column("row").take(same), "id": group.column("id").take(same), "piece_no": pa.array(range(n), pa.int32()), "body": pa.array(out, pa.string())})


def encode(docs: DataFrame, path: str, pattern: str = public_tokenizers.PATTERN, id_col: str = "doc_id", text_col: str = "text", chunk: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """(id, ids array<int>) of every row's whole text."""
    kind = docs.schema[id_col].dataType.simpleString()
    base = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("body"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoding(path, pattern)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                names = [x for x in part.schema.names if x != "body"]
                yield pa.RecordBatch.from_arrays([*(part.column(x) for x in names), _ints([ids_of(own, x) for x in part.column("body").to_pylist()])], [*names, "ids"])

    short = base.where(F.length("body") <= chunk + overlap).mapInArrow(run, f"id {kind}, ids array<int>")
    # Every row has its number, so that repeated rows stay apart and no group holds more than one of them.
    long = base.where(F.length("body") > chunk + overlap).select(F.monotonically_increasing_id().alias("row"), "id", "body")
    spread = chunks(long, "body", chunk, overlap).repartition("row", "chunk_no")
    done = pieces(spread, pattern, chunk, overlap).repartition("row", "piece_no").mapInArrow(run, f"row long, id {kind}, piece_no int, ids array<int>")
    whole = done.groupBy("row").agg(F.first("id").alias("id"), F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("piece_no", "ids"))), lambda x: x["ids"])).alias("ids"))
    return short.unionByName(whole.drop("row")).select(F.col("id").alias(id_col), "ids")


def decode(encoded: DataFrame, path: str, pattern: str = public_tokenizers.PATTERN, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """(id, ids, raw binary): the tokens' bytes, concatenated."""
    kind = encoded.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoding(path, pattern)
        for batch in batches:
            raw = [own.decode_bytes(x.values.to_numpy().tolist()) if x.is_valid else b"" for x in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(raw, pa.binary())], [id_col, "ids", "raw"])

    return encoded.select(id_col, F.col(ids_col).alias("ids")).mapInArrow(run, f"`{id_col}` {kind}, ids array<int>, raw binary")


def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    done = decode(encode(table(spark, sf_dir, "documents"), path), path)
    return done.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(F.concat_ws(" ", F.col("ids").cast("array<string>")), 256).alias("ids_sha256"), F.sha2("raw", 256).alias("decoded_sha256"))


def brute(text: str | None, path: str) -> tuple[list[int], str, str]:
    """One text by the plain library, for tests."""
    own = encoding(path, public_tokenizers.PATTERN)
    ids = own.encode_ordinary(text or "")
    return ids, hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(own.decode_bytes(ids)).hexdigest()


QUERIES = {"op1_bpe": op1_bpe}
ORACLES: dict[str, str] = {}
