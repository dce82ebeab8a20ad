"""Token-id files in Simple-8b: varying counts of ids in 64-bit words, with escapes and block offsets.

A file is a Parquet part whose rows are frames of whole documents in ascending order; a frame's payload is
the packed form of its ids:

    "S8B1", ids u64, blocks u32, escapes u32          header, little-endian
    (word offset, ids, cap, escape offset) u32        per block of at most BLOCK ids
    words u64                                         selector in the top 4 bits, ids from the low bits up
    escapes u32                                       ids too wide for their block's cap, in order

A block's cap is a number of bits. An id of ``2**cap - 1`` or more is packed as that number and its value is
kept among the escapes, so that a few wide ids don't widen their neighbours. The offsets let every block be
decoded by itself, all words of one selector at a time.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from linkspark.llm.tokens import encoder, tokenizer_path
from linkspark.session import scratch_dir, shuffle_partitions

BLOCK, FRAME = 16_384, 131_072
# fixed values: ids in a word and bits of each, by selector
COUNTS = np.array([240, 120, 60, 30, 20, 15, 12, 10, 8, 7, 6, 5, 4, 3, 2, 1])
WIDTHS = np.array([0, 0, 1, 2, 3, 4, 5, 6, 7, 8, 10, 12, 15, 20, 30, 60])
_CAPS = (15, 20, 60)
_HEADER = struct.Struct("<4sQII")


def _cap(ids: np.ndarray) -> int:
    """The cap with the smallest estimate of words and escapes."""
    def cost(cap: int) -> float:
        return len(ids) * 8 / COUNTS[list(WIDTHS).index(cap)] + 4 * np.count_nonzero(ids >= (1 << cap) - 1)
    return min(_CAPS, key=cost)


def _needs(values: np.ndarray) -> np.ndarray:
    """The first selector whose width holds each value."""
    return np.searchsorted((1 << WIDTHS[1:].astype(np.uint64)) - 1, values).astype(np.int8) + np.int8(1) * (values > 0)


_NEEDS = _needs(np.arange(1 << 16, dtype=np.uint64))


def _words(values: np.ndarray) -> np.ndarray:
    """Greedy Simple-8b: each word takes the selector with the most ids that fit."""
    n = len(values)
    need = _NEEDS[np.minimum(values, np.uint64(65_535))]
    wide = values > 65_535
    if wide.any():
        need[wide] = _needs(values[wide])
    need = np.concatenate([need, np.zeros(COUNTS[0], np.int8)])  # a last word may be partly filled
    selector = np.full(n, len(COUNTS) - 1, np.int8)
    most, seen = need[:n].copy(), 1  # the widest need among the next ``seen`` ids
    for k in range(len(COUNTS) - 2, -1, -1):
        for ahead in range(seen, COUNTS[k]):
            np.maximum(most, need[ahead:ahead + n], out=most)
        seen = COUNTS[k]
        fits = most <= k
        if not fits[:max(1, n - seen)].any():
            break  # where k doesn't fit, no narrower width for more ids does
        selector[fits] = k
    place = np.arange(n)
    step = (place + COUNTS[selector]).tolist()
    starts, at = [], 0
    while at < n:
        starts.append(at)
        at = step[at]
    starts = np.array(starts, np.int64)
    chosen = selector[starts].astype(np.int64)
    words = chosen.astype(np.uint64) << np.uint64(60)
    padded = np.concatenate([values, np.zeros(COUNTS[0], np.uint64)])
    for k in np.unique(chosen).tolist():
        if WIDTHS[k]:
            own = np.flatnonzero(chosen == k)
            grid = padded[starts[own, None] + np.arange(COUNTS[k])]
            # ids beyond the end of a last, partly filled word are zero by the padding
            shifts = (np.arange(COUNTS[k]) * WIDTHS[k]).astype(np.uint64)
            words[own] |= np.bitwise_or.reduce(grid << shifts, axis=1)
    return words


def pack(ids: np.ndarray) -> bytes:
    """Packed form of ids below 2**32."""
    blocks, words, escapes, n_words, n_escapes = [], [], [], 0, 0
    for first in range(0, len(ids), BLOCK):
        part = ids[first:first + BLOCK].astype(np.uint64)
        cap = _cap(part)
        wide = part >= (1 << cap) - 1
        packed = _words(np.where(wide, np.uint64((1 << cap) - 1), part))
        blocks.append((n_words, len(part), cap, n_escapes))
        words.append(packed)
        escapes.append(part[wide].astype("<u4"))
        n_words, n_escapes = n_words + len(packed), n_escapes + len(escapes[-1])
    return b"".join([_HEADER.pack(b"S8B1", len(ids), len(blocks), n_escapes), np.array(blocks, "<u4").tobytes(),
                     *[w.astype("<u8").tobytes() for w in words], *[e.tobytes() for e in escapes]])


def unpack(data: bytes) -> np.ndarray:
    """The ids (uint32) of a packed form."""
    magic, n, n_blocks, n_escapes = _HEADER.unpack_from(data)
    if magic != b"S8B1":
        raise ValueError("not a packed frame")
    blocks = np.frombuffer(data, "<u4", n_blocks * 4, _HEADER.size).reshape(-1, 4).astype(np.int64)
    at = _HEADER.size + 16 * n_blocks
    words = np.frombuffer(data, "<u8", (len(data) - at - 4 * n_escapes) // 8, at)
    escapes = np.frombuffer(data, "<u4", n_escapes, len(data) - 4 * n_escapes)
    out = np.empty(n, np.uint32)
    done = 0
    for i, (first, count, cap, escape) in enumerate(blocks):
        last = blocks[i + 1][0] if i + 1 < n_blocks else len(words)
        values = _unpacked(words[first:last], int(count))
        wide = np.flatnonzero(values == (1 << int(cap)) - 1)
        values[wide] = escapes[escape:escape + len(wide)]
        out[done:done + count] = values
        done += count
    if done != n:
        raise ValueError("a frame doesn't hold the ids it declares")
    return out


def _unpacked(words: np.ndarray, count: int) -> np.ndarray:
    selector = (words >> np.uint64(60)).astype(np.int64)
    ends = np.cumsum(COUNTS[selector])
    starts = ends - COUNTS[selector]
    out = np.zeros(int(ends[-1]) if len(ends) else 0, np.uint64)
    for k in np.unique(selector).tolist():
        if WIDTHS[k]:
            own = np.flatnonzero(selector == k)
            shifts = (np.arange(COUNTS[k]) * WIDTHS[k]).astype(np.uint64)
            mask = np.uint64((1 << int(WIDTHS[k])) - 1)
            out[starts[own, None] + np.arange(COUNTS[k])] = (words[own, None] >> shifts) & mask
    return out[:count]


FRAMES = "part int, start bigint, n_ids bigint, doc_ids array<bigint>, n_tokens array<int>, payload binary"
_FRAMES = pa.schema([("part", pa.int32()), ("start", pa.int64()), ("n_ids", pa.int64()), ("doc_ids", pa.list_(pa.int64())),
                     ("n_tokens", pa.list_(pa.int32())), ("payload", pa.binary())])


def write_tokens(docs: DataFrame, path: str, tokenizer: str, end_id: int, key: str = "doc_id", text: str = "text") -> None:
    """Encode whole texts, append ``end_id`` to each and write them below ``path`` in ascending ``key`` order.

    A null or empty text is the end id alone; null keys come first; rows that tie in the key keep any order
    among themselves. Parts are ranges of the key, so no task holds more than its share.
    """
    end = np.array([end_id], np.uint32)

    def frames(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, part = encoder(tokenizer).encode, TaskContext.get().partitionId()
        keys, ids, start, held = [], [], 0, 0

        def frame() -> pa.RecordBatch:
            flat = np.concatenate(ids)
            return pa.RecordBatch.from_pylist([{
                "part": part, "start": start, "n_ids": len(flat), "doc_ids": keys, "n_tokens": [len(x) for x in ids],
                "payload": pack(flat)}], _FRAMES)

        for batch in batches:
            for k, own in zip(batch.column(0).to_pylist(), encode(batch.column(1))):
                keys.append(k)
                ids.append(np.concatenate([own, end]))
                held += len(ids[-1])
                if held >= FRAME:
                    yield frame()
                    keys, ids, start, held = [], [], start + held, 0
        if keys:
            yield frame()

    rows = docs.select(F.col(key).cast("bigint").alias("key"), F.col(text).alias("text"))
    laid = rows.repartitionByRange(shuffle_partitions(docs), "key").sortWithinPartitions("key")
    laid.mapInArrow(frames, FRAMES).write.option("compression", "zstd").parquet(path)


def read_frames(spark, path: str) -> DataFrame:
    """Frames with ``first``: the ids of all files before the frame's file, of which there are as many as ranges."""
    files = spark.read.schema(FRAMES).parquet(path)
    sizes = files.groupBy("part").agg(F.sum("n_ids").alias("n"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    bases = sizes.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    # one row per range that was written
    return files.join(F.broadcast(bases), "part").withColumn("first", F.col("base") + F.col("start")).drop("base")


def read_documents(spark, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document, from the files alone."""
    schema = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())])

    def documents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, keys, sizes, payload in zip(*(batch.column(c).to_pylist() for c in ("first", "doc_ids", "n_tokens", "payload"))):
                ids = unpack(payload).astype("<u4", copy=False)
                ends = np.cumsum(sizes)
                raw = memoryview(ids).cast("B")
                yield pa.RecordBatch.from_pydict({
                    "doc_id": keys, "start": (first + ends - sizes).tolist(), "n_tokens": sizes,
                    "ids_crc32": [zlib.crc32(raw[4 * (b - n):4 * b]) for b, n in zip(ends.tolist(), sizes)]}, schema)

    rows = read_frames(spark, path).select("first", "doc_ids", "n_tokens", "payload")
    return rows.mapInArrow(documents, "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint")


def through_files(docs: DataFrame, end_id: int = 2, tokenizer: str | None = None) -> DataFrame:
    spark = docs.sparkSession
    path = f"{scratch_dir(spark).rstrip('/')}/tokens/{uuid.uuid4().hex}"
    write_tokens(docs, path, tokenizer or tokenizer_path(), end_id)
    return read_documents(spark, path)
