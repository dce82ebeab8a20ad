"""Removal of repeated passages: windows of words that start in two places or more, with a count-min prefilter.

First pass: every task sketches its windows, a window raising one cell in each of ROWS rows of cells; the
partial sketches (sorted cells, difference-coded) are merged by segments of cells. The smallest of a window's
counts is never below its true count, so a window whose cells don't all reach two is surely unique.
Second pass: only windows estimated to repeat are grouped, by 96 bits of two fingerprints (64 and 32) that are
worked out from the words independently of each other; 32 bits more than the sketch has seen. What a task
knows to repeat from its own rows leaves it as runs, with one row for the window, so a passage found
everywhere costs a row per task. The sketch grows with the input up to MOST_CELLS; beyond that more windows
reach the second pass, and the result is the same.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linkspark.llm import wordhash as W
from linkspark.llm.rows import riding, unpacked
from linkspark.session import shuffle_partitions

WINDOW = 35
ROWS = 2
LEAST_CELLS, MOST_CELLS = 20, 29  # as powers of two, in a row; two rows of 2**29 bits are 128 MB
SEGMENT = 20  # cells of a segment, as a power of two
FLUSH = 2_000_000  # windows a task holds before it packs them
CHUNK = 1 << 19  # bytes of text that are looked at together
_ROW_MIX = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F], np.uint64)


def _zstd():
    import zstandard
    return zstandard


def _cells(keys: np.ndarray, row: int, cells: int) -> np.ndarray:
    return ((keys * _ROW_MIX[row]) >> np.uint64(64 - cells)).astype(np.uint32)


def _chunk_windows(data, offsets, size):
    """(window fingerprints, their text's index, their first word's place in the text, a function that returns
    the second fingerprints of some of them) of a chunk of texts."""
    starts, ends, prints, counts = W.words(data, offsets)
    keys = W.windows(prints, size)
    text = np.repeat(np.arange(len(offsets) - 1), np.diff(counts))
    place = np.arange(len(prints)) - counts[text]
    whole = text[:len(keys)] == text[size - 1:] if len(keys) else np.zeros(0, bool)

    def second(hit: np.ndarray) -> np.ndarray:
        return W.window_checks(W.checks(data, starts, ends), size)[whole][hit]
    return keys[whole], text[:len(keys)][whole], place[:len(keys)][whole], second


# --- first pass --------------------------------------------------------------------------------------

def _packed(cells: np.ndarray) -> bytes:
    """Sorted numbers as differences, low and high bytes apart."""
    gaps = np.diff(cells, prepend=np.uint32(0)).astype("<u4")
    width = 2 if gaps.max() < 65_536 else 4
    planes = np.ascontiguousarray(gaps.astype(f"<u{width}").view(np.uint8).reshape(-1, width).T)
    return bytes([width]) + _zstd().ZstdCompressor(level=1).compress(planes.tobytes())


def _unpacked(data: bytes) -> np.ndarray:
    width = data[0]
    planes = np.frombuffer(_zstd().ZstdDecompressor().decompress(data[1:]), np.uint8).reshape(width, -1)
    return np.cumsum(np.ascontiguousarray(planes.T).view(f"<u{width}").ravel(), dtype=np.int64)


_PARTIAL = pa.schema([("row", pa.int32()), ("segment", pa.int32()), ("cells", pa.binary())])


def _sketch(cells: int, size: int):
    def partials(keys: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        every = np.concatenate(keys)
        for row in range(ROWS):
            own = np.sort(_cells(every, row, cells))
            if len(own) > 2:  # a count beyond two says no more than two
                own = own[np.concatenate([[True, True], own[2:] != own[:-2]])]
            cuts = np.searchsorted(own, np.arange(0, 1 << cells, 1 << SEGMENT, dtype=np.int64))
            parts = [(s, own[a:b] - np.uint32(s << SEGMENT)) for s, (a, b) in
                     enumerate(zip(cuts.tolist(), [*cuts[1:].tolist(), len(own)])) if b > a]
            yield pa.RecordBatch.from_arrays([
                pa.array([row] * len(parts), pa.int32()), pa.array([s for s, _ in parts], pa.int32()),
                pa.array([_packed(x) for _, x in parts], pa.binary())], schema=_PARTIAL)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, held = [], 0
        for batch in batches:
            for _, _, data, offsets in W.chunks(batch.column(0), CHUNK):
                own, *_ = _chunk_windows(data, offsets, size)
                if len(own):
                    keys.append(own)
                    held += len(own)
                if held >= FLUSH:
                    yield from partials(keys)
                    keys, held = [], 0
        if keys:
            yield from partials(keys)
    return run


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts of one segment after another; partial sketches come in sorted by segment."""
    at, counts = None, None

    def full() -> pa.RecordBatch:
        bits = _zstd().ZstdCompressor(level=1).compress(np.packbits(counts >= 2, bitorder="little").tobytes())
        return pa.RecordBatch.from_pylist([{"row": at[0], "segment": at[1], "cells": bits}], _PARTIAL)

    for batch in batches:
        for key, cells in zip(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()), batch.column(2).to_pylist()):
            if key != at:
                if at is not None:
                    yield full()
                at, counts = key, np.zeros(1 << SEGMENT, np.uint8)
            own = _unpacked(cells)
            again = own[1:] == own[:-1]
            distinct = own[np.concatenate([[True], ~again])]
            counts[distinct] = np.minimum(counts[distinct] + 1, 2)
            counts[own[1:][again]] = 2
    if at is not None:
        yield full()


def _repeating_cells(docs: DataFrame, text: str, cells: int, size: int) -> DataFrame:
    partial = docs.select(text).mapInArrow(_sketch(cells, size), "row int, segment int, cells binary")
    laid = partial.repartition(shuffle_partitions(docs), "row", "segment").sortWithinPartitions("row", "segment")
    return laid.mapInArrow(_merge, "row int, segment int, cells binary")


def _unfolded(sketch, cells: int) -> list[np.ndarray]:
    """The rows of the sketch as bits; a task holds them while it runs, no longer."""
    rows = [np.zeros(1 << (cells - 3), np.uint8) for _ in range(ROWS)]
    for row, segment, bits in sketch.value:
        raw = np.frombuffer(_zstd().ZstdDecompressor().decompress(bits), np.uint8)
        rows[row][segment << (SEGMENT - 3):(segment + 1) << (SEGMENT - 3)] = raw
    return rows


def _estimated(rows: list[np.ndarray], cells: int, keys: np.ndarray) -> np.ndarray:
    """Whether the sketch allows each window a count of two."""
    out = np.ones(len(keys), bool)
    for row, bits in enumerate(rows):
        own = _cells(keys, row, cells)
        out &= (bits[own >> np.uint32(3)] >> (own & np.uint32(7)).astype(np.uint8) & 1).astype(bool)
    return out


# --- second pass -------------------------------------------------------------------------------------

_PROBE, _KNOWN, _RUN = 0, 1, 2  # a window to be grouped; one known to repeat; a stretch of known windows
# x holds the second fingerprint (of a stretch: its number of windows) in the upper half, then two bits of
# kind and 30 bits of place, so that a row is four numbers
_OCCURRENCES = pa.schema([("h1", pa.int64()), ("x", pa.int64()), ("id", pa.int64()), ("print", pa.int32())])
_FOUND = pa.schema([("id", pa.int64()), ("print", pa.int32()), ("span", pa.int64())])  # span: place and number of windows
_HALF, _PLACE = np.int64(32), np.int64((1 << 30) - 1)


def _runs(text: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First index and length of every stretch of consecutive places in one text."""
    fresh = np.concatenate([[True], (text[1:] != text[:-1]) | (place[1:] != place[:-1] + 1)])
    first = np.flatnonzero(fresh)
    return first, np.diff(np.append(first, len(text)))


def _occurrences(sketch, cells: int, size: int):
    def emit(held: list[tuple]) -> Iterator[pa.RecordBatch]:
        keys, row, place = (np.concatenate([h[i] for h in held]) for i in range(3))
        ids = pa.concat_arrays([h[3] for h in held])
        prints = np.concatenate([h[4] for h in held])
        second = np.concatenate([h[5] for h in held]).astype(np.int64)
        order = np.lexsort((second, keys))
        same = (keys[order][1:] == keys[order][:-1]) & (second[order][1:] == second[order][:-1])
        twice = np.zeros(len(keys), bool)
        twice[order] = np.concatenate([same, [False]]) | np.concatenate([[False], same])
        lead = order[np.concatenate([[True], ~same])]
        lead = lead[twice[lead]]  # one row for each window that repeats right here
        once = np.flatnonzero(~twice)
        known = np.flatnonzero(twice)
        first, length = _runs(row[known], place[known]) if len(known) else (known, known)
        start = known[first]
        pick = np.concatenate([once, lead, start])
        kind = np.repeat(np.array([_PROBE, _KNOWN, _RUN], np.int64), [len(once), len(lead), len(start)])
        upper = np.concatenate([second[once], second[lead], length])
        yield pa.RecordBatch.from_arrays([
            pa.array(keys[pick].view(np.int64)), pa.array(upper << _HALF | kind << np.int64(30) | place[pick]),
            ids.take(pa.array(row[pick])), pa.array(prints[row[pick]])], schema=_OCCURRENCES)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, rows, n, bits = [], 0, 0, _unfolded(sketch, cells)
        for batch in batches:
            for a, b, data, offsets in W.chunks(batch.column(0), CHUNK):
                keys, text, place, second = _chunk_windows(data, offsets, size)
                hit = _estimated(bits, cells, keys)
                if not hit.any():
                    continue
                held.append((keys[hit], text[hit] + rows, place[hit], batch.column(1)[a:b],
                             batch.column(2)[a:b].to_numpy(zero_copy_only=False).astype(np.int32), second(hit)))
                rows, n = rows + b - a, n + int(hit.sum())
                if n >= FLUSH // 4:
                    yield from emit(held)
                    held, rows, n = [], 0, 0
        if held:
            yield from emit(held)
    return run


def _exact(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Occurrences sorted by window: a probe repeats if the row before or after it is of the same window."""
    carry, carry_same = None, False

    def rows(batch: pa.RecordBatch, which: np.ndarray, n) -> pa.RecordBatch:
        at = np.flatnonzero(which)
        x = batch.column(1).to_numpy()[at]
        span = (x & _PLACE) << _HALF | (x >> _HALF if n is None else n)
        return pa.RecordBatch.from_arrays([batch.column(2).take(pa.array(at)), batch.column(3).take(pa.array(at)), pa.array(span)], schema=_FOUND)

    for batch in batches:
        kind = batch.column(1).to_numpy() >> np.int64(30) & np.int64(3)
        if (kind == _RUN).any():
            yield rows(batch, kind == _RUN, None)
            batch = batch.filter(pa.array(kind != _RUN))
        if carry is not None:
            batch = pa.Table.from_batches([carry, batch]).combine_chunks().to_batches()[0] if len(batch) else carry
        if not len(batch):
            continue
        h1, x = batch.column(0).to_numpy(), batch.column(1).to_numpy()
        same = (h1[1:] == h1[:-1]) & (x[1:] >> _HALF == x[:-1] >> _HALF)
        before = np.concatenate([[carry_same], same])
        ready = (x >> np.int64(30) & np.int64(3) == _PROBE) & (before | np.concatenate([same, [False]]))
        ready[-1] = False
        yield rows(batch, ready, 1)
        carry, carry_same = batch.slice(len(batch) - 1), bool(before[-1])
    if carry is not None and carry_same and carry.column(1)[0].as_py() >> 30 & 3 == _PROBE:
        yield rows(carry, np.array([True]), 1)


def repeated_spans(docs: DataFrame, size: int = WINDOW, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(_id, _print, spans): for each document the stretches of windows that start elsewhere too, each as the
    place of the first in the upper half of a number and how many there are in the lower."""
    spark = docs.sparkSession
    rows = docs.select(F.coalesce(text, F.lit("")).alias("text"), F.col(key).cast("bigint").alias("id"), F.hash(text).alias("print"))
    volume = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    cells = min(MOST_CELLS, max(LEAST_CELLS, int(np.ceil(np.log2(max(1, volume) * 0.7)))))  # some four cells a word
    segments = [tuple(r) for r in _repeating_cells(rows, "text", cells, size).collect()]  # at most ROWS * 2**29 bits
    sketch = spark.sparkContext.broadcast(segments)
    seen = rows.mapInArrow(_occurrences(sketch, cells, size), _ddl(_OCCURRENCES))
    laid = seen.repartition(shuffle_partitions(docs), "h1").sortWithinPartitions("h1", "x")
    found = laid.mapInArrow(_exact, _ddl(_FOUND))
    return found.groupBy(F.col("id").alias("_id"), F.col("print").alias("_print")).agg(
        F.collect_set("span").alias("spans"))


def _ddl(schema: pa.Schema) -> str:
    return ", ".join(f"{f.name} {'bigint' if f.type == pa.int64() else 'int'}" for f in schema)


def remove_repeats(docs: DataFrame, size: int = WINDOW, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` plus ``n_words``, ``n_removed`` and ``kept``, the words left, joined by one space.

    Words are runs other than ASCII white space. A word goes if any window of ``size`` words that covers it
    starts in another place too, in any document or the same; all windows are judged on the input. Null and
    empty texts have no words, texts of fewer than ``size`` words no window. Rows that repeat an id and its
    text are copies of each other. Columns of these names are replaced.
    """
    names, rest = riding(docs, text, replaced=("n_words", "n_removed", "kept"))
    spans = repeated_spans(docs, size, key, text)
    rows = docs.select(rest, F.col(text).alias("_body"), F.col(key).cast("bigint").alias("_key"), F.hash(text).alias("_hash"))
    joined = rows.join(spans, F.col("_key").eqNullSafe(F.col("_id")) & (F.col("_hash") == F.col("_print")), "left")
    joined = joined.select("_row", "_body", "spans")

    def cut_out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n_words, n_removed, left = [], [], []
            for body, spans in zip(batch.column(1).to_pylist(), batch.column(2)):
                own = (body or "").encode().split()
                n_words.append(len(own))
                if spans.is_valid:
                    span = spans.values.to_numpy()
                    edge = np.zeros(len(own) + 1, np.int64)
                    np.add.at(edge, span >> _HALF, 1)
                    np.add.at(edge, (span >> _HALF) + (span & np.int64((1 << 32) - 1)) + size - 1, -1)
                    gone = np.cumsum(edge[:-1]) > 0
                    own = [own[i] for i in np.flatnonzero(~gone).tolist()]
                n_removed.append(n_words[-1] - len(own))
                left.append(b" ".join(own).decode())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(n_words, pa.int64()),
                                              pa.array(n_removed, pa.int64()), pa.array(left, pa.string())],
                                             ["_row", "_body", "n_words", "n_removed", "kept"])

    done = joined.mapInArrow(cut_out, f"_row {joined.schema['_row'].dataType.simpleString()}, _body string, "
                             "n_words bigint, n_removed bigint, kept string")
    return done.select(*unpacked(names, **{text: "_body"}), "n_words", "n_removed", "kept")
