"""Phrase collocations per language: frequent phrases of 2 to ``LONGEST`` words, scored by their weakest cut.

Texts are cut into pieces at sentence marks and line ends, and pieces into words; a phrase lies within a piece.
Candidates come level by level. Each task counts the phrases of k words whose both parts of k - 1 words may be
frequent, by 64-bit hashes, and packs the counts by segments of hashes; segments are merged, and the hashes that
reach the threshold are set in a bit filter of bounded size. A phrase that isn't in it can't be frequent (Apriori),
one that is may be. Occurrences draw lots from their phrase and text, and where a phrase has its lowest it is named,
so that names don't leave every task; the distinct ones are laid into double-array tries of at most ``MOST`` phrases. The tries
are broadcast, one after the other; the states of all positions of a text advance together, one word at a time, the
accepting states are counted, and the counts of all tasks are added up by ranges of states. These counts are exact
and decide alone: the filters only say what is worth counting, so their size changes no result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from linkspark.llm import wordhash as W
from linkspark.llm.doublearray import Trie, build
from linkspark.session import cut

LEAST, LONGEST, TOP, UNKNOWN = 30, 4, 2000, "und"
MOST = 2_000_000  # phrases of one trie
CHUNK = 1 << 19  # bytes of text that are looked at together
FLUSH = 1 << 20  # keys a task holds before it packs them
SEGMENT = 1 << 20  # words of all texts for each segment of cells
LEAST_BITS, MOST_BITS = 20, 27  # of a level's filter, as powers of two
BLOCK = 16  # states whose counts are added up together, as a power of two
_BREAKS = list(b".,;:!?\n\x0b\x0c\r")
_BREAK = np.zeros(256, bool)
_BREAK[_BREAKS] = True
_SPACED = np.arange(256, dtype=np.uint8)
_SPACED[_BREAKS] = 32
_SPACED[65:91] += 32  # A-Z in lower case
_SECOND = np.uint32(0x9E3779B1)


def _zstd():
    import zstandard
    return zstandard


# --- words of many texts -----------------------------------------------------------------------------------

def _sections(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Offsets of texts, those longer than a chunk cut between pieces, and which text each section is of."""
    longer = np.flatnonzero(np.diff(offsets) > CHUNK)
    if not len(longer):
        return offsets, np.arange(len(offsets) - 1)
    more = []
    for t in longer.tolist():
        at, end = int(offsets[t]), int(offsets[t + 1])
        while end - at > CHUNK:
            look, step = at, CHUNK
            found = np.flatnonzero(_BREAK[data[at:at + step]])[-1:]
            while not len(found) and look + step < end:  # a piece is never cut
                look += step
                found = np.flatnonzero(_BREAK[data[look:look + step]])[:1]
            if not len(found):
                break
            at = look + int(found[0]) + 1
            more.append(at)
    every = np.sort(np.concatenate([offsets, np.array(more, np.int64)]), kind="stable")
    return every, np.searchsorted(offsets, every[:-1], "right") - 1


class _Words:
    """The words of a chunk of texts: fingerprints, pieces, texts, places."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray) -> None:
        self.data = _SPACED[data]
        self.starts, self.ends, self.prints, self.counts = W.words(self.data, offsets)
        self.text = np.repeat(np.arange(len(offsets) - 1), np.diff(self.counts))
        marks = np.cumsum(_BREAK[data])
        self.piece = marks[self.starts] + self.text if len(self.starts) else self.text

    def whole(self, size: int) -> np.ndarray:
        """Whether ``size`` words from each place on lie in one piece."""
        n = max(0, len(self.piece) - size + 1)
        return self.piece[:n] == self.piece[size - 1:]

    def keys(self, size: int, salt: np.ndarray) -> np.ndarray:
        """Hashes of the ``size`` words from each place on; ``salt`` is one number per text."""
        own = W.windows(self.prints, size)
        return W.mixed(own ^ salt[self.text[:len(own)]])


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[_Words, list[str], np.ndarray]]:
    """(words, languages, each text's language by number) of about a chunk of text at a time."""
    for batch in batches:
        data, offsets = W.buffers(batch.column(0))
        names = batch.column(1).dictionary_encode()
        langs, of = names.dictionary.to_pylist(), names.indices.to_numpy(zero_copy_only=False)
        offsets, text = _sections(data, offsets)
        first = 0
        while first < len(text):
            last = int(np.searchsorted(offsets, offsets[first] + CHUNK, "right")) - 1
            last = min(len(text), max(first + 1, last))
            part = data[offsets[first]:offsets[last]]
            if len(part):
                yield _Words(part, offsets[first:last + 1] - offsets[first]), langs, of[text[first:last]]
            first = last


def _salt(langs: list[str]) -> np.ndarray:
    return np.array([int.from_bytes(hashlib.blake2b(x.encode(), digest_size=8).digest(), "little") for x in langs], np.uint64)


# --- candidates: hashed counts, level by level ---------------------------------------------------------------

class Cells:
    """How keys fall into segments, by their top bits, and what is kept by the 32 bits that follow: two bits of the
    filter for each frequent key, and in slots the largest of their lowest lots."""

    def __init__(self, text_bytes: int) -> None:
        words = max(text_bytes // 6, 1)
        self.segments = min(14, max(4, (words // SEGMENT).bit_length()))
        bits = min(MOST_BITS, max(LEAST_BITS, (text_bytes // 16).bit_length()))
        self.bits = bits - self.segments  # of the filter, in a segment
        self.slots = self.bits - 4

    def empty(self) -> tuple[np.ndarray, np.ndarray]:
        return np.zeros(1 << (self.bits + self.segments - 3), np.uint8), np.zeros(1 << (self.slots + self.segments), "<u2")

    def of(self, keys: np.ndarray) -> np.ndarray:
        return keys >> np.uint64(32 - self.segments)

    def spots(self, low: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The two bits of cells within their segment."""
        shift = np.uint32(32 - self.bits)
        return low >> shift, (low * _SECOND) >> shift

    def named(self, most: np.ndarray, keys: np.ndarray, lots: np.ndarray) -> np.ndarray:
        """Whether occurrences with these lots name their phrases; the one with the lowest always does."""
        return lots <= most[keys >> np.uint64(64 - self.segments - self.slots)]

    def passed(self, filter_: np.ndarray, keys: np.ndarray) -> np.ndarray:
        cells = self.of(keys)
        begin = (cells >> np.uint64(32)) << np.uint64(self.bits)
        out = np.ones(len(keys), bool)
        for spot in self.spots(cells.astype(np.uint32)):
            bit = begin + spot
            out &= (filter_[bit >> np.uint64(3)] >> (bit & np.uint64(7)).astype(np.uint8)) & 1 == 1
        return out


def _packed(keys: np.ndarray, *others: np.ndarray) -> bytes:
    """Sorted numbers as differences, byte by byte, and what goes with them."""
    gaps = np.diff(keys, prepend=np.uint64(0)).astype("<u8")
    planes = np.ascontiguousarray(gaps.view(np.uint8).reshape(-1, 8).T)
    return _zstd().ZstdCompressor(level=1).compress(b"".join([planes.tobytes(), *(x.tobytes() for x in others)]))


def _unpacked(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Keys, counts and lots."""
    own = np.frombuffer(_zstd().ZstdDecompressor().decompress(data), np.uint8)
    n = len(own) // 11
    keys = np.cumsum(np.ascontiguousarray(own[:8 * n].reshape(8, n).T).view("<u8").ravel(), dtype=np.uint64)
    return keys, own[8 * n:9 * n], own[9 * n:].view("<u2")


def _lots(words: _Words, keys: np.ndarray, at: np.ndarray) -> np.ndarray:
    """A number for each occurrence of a phrase, drawn from the phrase and all words of its text."""
    totals = np.add.reduceat(np.append(words.prints, np.uint64(0)), np.minimum(words.counts[:-1], len(words.prints)))
    return (W.mixed(keys ^ W.mixed(totals)[words.text[at]]) >> np.uint64(48)).astype(np.uint16)


def _frequent(words: _Words, cells: Cells, filters: list[np.ndarray], salt: np.ndarray, size: int) -> np.ndarray:
    """Whether the ``size`` words from each place on may be frequent, by the filters of levels 1 to ``size``."""
    may, known = np.ones(len(words.prints), bool), words.whole(size)
    for level in range(1, size + 1):
        here = may & words.whole(level) if level == 1 else may[:-1] & may[1:] & words.whole(level)
        if level <= len(filters):
            on = np.flatnonzero(here)
            own = words.keys(level, salt)[on]
            here[on[~cells.passed(filters[level - 1], own)]] = False
        may = here
        if not len(may):
            break
    return may if len(may) == len(known) else np.zeros(len(known), bool)


def _counting(cells: Cells, held, size: int):
    """Packed counts of the phrases of ``size`` words whose parts may be frequent, up to ``LEAST``, by segments, and
    the lowest lot of each phrase."""
    def packs(keys: list[np.ndarray], lots: list[np.ndarray]) -> pa.RecordBatch:
        every, lots = np.concatenate(keys), np.concatenate(lots)
        by = np.argsort(every, kind="stable")
        every, lots = every[by], lots[by]
        starts = np.flatnonzero(np.concatenate([[True], every[1:] != every[:-1]]))
        own, lots = every[starts], np.minimum.reduceat(lots, starts).astype("<u2")
        # sums of counts up to the threshold reach it when those of the true ones do
        counts = np.minimum(np.diff(np.append(starts, len(every))), LEAST).astype(np.uint8)
        edges = np.arange(1, 1 << cells.segments, dtype=np.uint64) << np.uint64(64 - cells.segments)
        cuts = [0, *np.searchsorted(own, edges).tolist(), len(own)]
        parts = [(s, a, b) for s, (a, b) in enumerate(zip(cuts[:-1], cuts[1:])) if b > a]
        return pa.RecordBatch.from_arrays([pa.array([s for s, _, _ in parts], pa.int32()), pa.array(
            [_packed(own[a:b], counts[a:b], lots[a:b]) for _, a, b in parts], pa.binary())], ["segment", "cells"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        filters, keys, lots, n = [np.frombuffer(x, np.uint8) for x in held.value], [], [], 0
        for words, langs, of in _chunks(batches):
            salt = _salt(langs)[of]
            at = np.flatnonzero(_frequent(words, cells, filters, salt, size))
            if not len(at):
                continue
            own = words.keys(size, salt)[at]
            keys.append(own)
            lots.append(_lots(words, own, at))
            n += len(own)
            if n >= FLUSH:
                yield packs(keys, lots)
                keys, lots, n = [], [], 0
        if n:
            yield packs(keys, lots)
    return run


def _merging(cells: Cells):
    """(segment, filter, lots) of one segment after another; packed counts come in sorted by segment."""
    def merged(segment: int, parts: list[tuple[np.ndarray, ...]]) -> pa.RecordBatch:
        keys, counts, lots = (np.concatenate(x) for x in zip(*parts))
        by = np.argsort(keys, kind="stable")
        keys, counts, lots = keys[by], counts[by], lots[by]
        starts = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
        frequent = np.add.reduceat(counts.astype(np.int64), starts) >= LEAST
        low = cells.of(keys[starts[frequent]]).astype(np.uint32)
        bits, most = np.zeros(1 << cells.bits, bool), np.zeros(1 << cells.slots, "<u2")
        for spot in cells.spots(low):
            bits[spot] = True
        np.maximum.at(most, low >> np.uint32(32 - cells.slots), np.minimum.reduceat(lots, starts)[frequent])
        pack = _zstd().ZstdCompressor(level=1).compress
        return pa.RecordBatch.from_arrays([pa.array([segment], pa.int32()), pa.array(
            [pack(np.packbits(bits, bitorder="little").tobytes())], pa.binary()), pa.array([pack(most.tobytes())], pa.binary())],
            ["segment", "bits", "lots"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, parts = None, []
        for batch in batches:
            for segment, own in zip(batch.column(0).to_pylist(), batch.column(1)):
                if segment != at and parts:
                    yield merged(at, parts)
                    parts = []
                at = segment
                parts.append(_unpacked(own.as_py()))
        if parts:
            yield merged(at, parts)
    return run


def level_filter(texts: DataFrame, cells: Cells, held, size: int) -> tuple[bytes, bytes]:
    """The filter of phrases of ``size`` words that may be frequent, and the lots up to which they are named.

    Both have a fixed size, of ``MOST_BITS`` bits and an eighth as many numbers at most.
    """
    packed = texts.mapInArrow(_counting(cells, held, size), "segment int, cells binary")
    merged = packed.repartition("segment").sortWithinPartitions("segment").mapInArrow(
        _merging(cells), "segment int, bits binary, lots binary")
    bits, lots = cells.empty()
    unpack, table = _zstd().ZstdDecompressor(), merged.toArrow()
    for column, whole in ((1, bits), (2, lots)):
        width = len(whole) >> cells.segments
        for segment, own in zip(table.column(0).to_pylist(), table.column(column)):
            whole[segment * width:(segment + 1) * width] = np.frombuffer(unpack.decompress(own.as_py()), whole.dtype)
    return bits.tobytes(), lots.tobytes()


def _gathered(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> pa.Array:
    """Byte ranges as strings."""
    sizes = ends - starts
    offsets = np.concatenate([[0], np.cumsum(sizes)])
    at = np.repeat(starts - offsets[:-1], sizes) + np.arange(offsets[-1])
    return pa.Array.from_buffers(pa.large_string(), len(starts), [None, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(data[at])])


def _phrases(words: _Words, at: np.ndarray, size: int) -> pa.Array:
    """The phrases of ``size`` words from these places on, joined by single spaces."""
    whole = _gathered(words.data, words.starts[at], words.ends[at + size - 1])
    plain = np.ones(len(at), bool)
    for i in range(size - 1):
        gap = words.ends[at + i]
        plain &= (words.starts[at + i + 1] == gap + 1) & (words.data[gap] == 32)
    if plain.all():
        return whole.cast(pa.string())
    own = whole.to_pylist()
    for i in np.flatnonzero(~plain).tolist():
        own[i] = " ".join(x for x in own[i].replace("\t", " ").split(" ") if x)
    return pa.array(own, pa.string())


def _naming(cells: Cells, held):
    """(lang, phrase) of the phrases of two words and more that the filters let pass, mostly once: where the phrase
    occurs with its lowest lot."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        filters, most = [np.frombuffer(x, np.uint8) for x, _ in held.value], [np.frombuffer(x, "<u2") for _, x in held.value]
        seen = np.zeros(0, np.uint64)
        for words, langs, of in _chunks(batches):
            salt = _salt(langs)[of]
            for size in range(2, len(filters) + 1):
                at = np.flatnonzero(_frequent(words, cells, filters, salt, size))
                if not len(at):
                    continue
                keys = words.keys(size, salt)[at]
                names = cells.named(most[size - 1], keys, _lots(words, keys, at))
                at = at[names]
                keys, first = np.unique(keys[names], return_index=True)
                if len(seen):
                    place = np.minimum(np.searchsorted(seen, keys), len(seen) - 1)
                    new = seen[place] != keys
                    keys, first = keys[new], first[new]
                if not len(keys):
                    continue
                at = at[first]
                lang = pa.array(langs, pa.string()).take(pa.array(of[words.text[at]]))
                yield pa.RecordBatch.from_arrays([lang, _phrases(words, at, size)], ["lang", "phrase"])
                seen = np.sort(np.concatenate([seen, keys]))
                if len(seen) > FLUSH:
                    seen = np.zeros(0, np.uint64)
    return run


def candidates(texts: DataFrame, longest: int = LONGEST) -> DataFrame:
    """(lang, phrase): every frequent phrase of 1 to ``longest`` words that is a candidate or a part of one, and a few
    that aren't frequent. One pass over the texts per level, and one to name them."""
    context = texts.sparkSession.sparkContext
    cells = Cells(texts.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0])
    filters: list[tuple[bytes, bytes]] = []
    for size in range(1, longest + 1):
        held = context.broadcast([bits for bits, _ in filters])
        filters.append(level_filter(texts, cells, held, size))
        held.destroy()
    held = context.broadcast(filters)
    named = cut(texts.mapInArrow(_naming(cells, held), "lang string, phrase string").distinct())
    held.destroy()
    # cuts of a candidate of up to four words are words and candidates: by Apriori they have passed as well
    words = named.select("lang", F.explode(F.split("phrase", " ")).alias("phrase")).distinct()
    return cut(named.unionByName(words))


# --- exact counts: tries ---------------------------------------------------------------------------------------

def _laid_out(table: pa.Table) -> pa.Table:
    """One trie of a slice's phrases; the rows name its states, the first row holds it."""
    trie, states = build(table.column("lang").combine_chunks(), table.column("phrase").combine_chunks())
    n, groups = table.num_rows, trie.groups
    slice_ = table.column("slice")[0].as_py()

    def followed(column: str, more: list[str]) -> pa.Array:
        own = table.column(column).combine_chunks()
        return pa.concat_arrays([own, pa.array(more, own.type)])
    return pa.table({
        "slice": pa.array([slice_] * (n + len(groups)), pa.int32()),
        "trie": pa.array([trie.to_bytes(), *[None] * (n + len(groups) - 1)], pa.binary()),
        "state": pa.array(np.concatenate([states, np.arange(len(groups))]), pa.int64()),
        "lang": followed("lang", groups), "phrase": followed("phrase", [""] * len(groups))})


def tries(phrases: DataFrame, most: int = MOST) -> DataFrame:
    """(slice, trie, state, lang, phrase), written; the empty phrase stands for all words of its language."""
    slices = max(1, -(-phrases.count() // most))
    sliced = phrases.withColumn("slice", F.pmod(F.xxhash64("lang", "phrase"), F.lit(slices)).cast("int"))
    return cut(sliced.groupBy("slice").applyInArrow(_laid_out, "slice int, trie binary, state bigint, lang string, phrase string"))


def _walking(held, longest: int):
    """(block, states, counts) of the states that all positions of the texts reach."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie = Trie.from_bytes(held.value)
        total, reached, n = np.zeros(len(trie.base), np.int64), [], 0
        for words, langs, of in _chunks(batches):
            root = np.array([trie.roots.get(x, -1) for x in langs], np.int64)[of]
            here = root >= 0
            np.add.at(total, root[here], np.diff(words.counts)[here])
            codes = trie.codes(words.prints)
            live = np.flatnonzero(root[words.text] >= 0)
            states = root[words.text[live]]
            for level in range(longest):
                if level:
                    inside = live + level < len(codes)
                    live, states = live[inside], states[inside]
                    same = words.piece[live] == words.piece[live + level]
                    live, states = live[same], states[same]
                states = trie.step(states, codes[live + level])
                known = states >= 0
                live, states = live[known], states[known]
                reached.append(states)
                n += len(states)
            if n >= FLUSH:
                total += np.bincount(np.concatenate(reached), minlength=len(total))
                reached, n = [], 0
        if n:
            total += np.bincount(np.concatenate(reached), minlength=len(total))
        at = np.flatnonzero(total)
        cuts = np.searchsorted(at, np.arange(0, len(total) + (1 << BLOCK), 1 << BLOCK)).tolist()
        parts = [(b, x, y) for b, (x, y) in enumerate(zip(cuts[:-1], cuts[1:])) if y > x]
        pack = _zstd().ZstdCompressor(level=1).compress
        yield pa.RecordBatch.from_arrays([
            pa.array([b for b, _, _ in parts], pa.int32()),
            pa.array([pack((at[x:y] - (b << BLOCK)).astype("<u2").tobytes()) for b, x, y in parts], pa.binary()),
            pa.array([pack(total[at[x:y]].astype("<i8").tobytes()) for _, x, y in parts], pa.binary())], ["block", "states", "counts"])
    return run


def _summing(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(state, f): counts of all tasks added up, block after block."""
    unpack, at, sums = _zstd().ZstdDecompressor(), None, None

    def done() -> pa.RecordBatch:
        own = np.flatnonzero(sums)
        return pa.RecordBatch.from_arrays([pa.array(own + (at << BLOCK), pa.int64()), pa.array(sums[own], pa.int64())], ["state", "f"])

    for batch in batches:
        for block, states, counts in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2)):
            if block != at:
                if at is not None:
                    yield done()
                at, sums = block, np.zeros(1 << BLOCK, np.int64)
            own = np.frombuffer(unpack.decompress(states.as_py()), "<u2")
            sums[own] += np.frombuffer(unpack.decompress(counts.as_py()), "<i8")
    if at is not None:
        yield done()


def phrase_counts(texts: DataFrame, phrases: DataFrame, longest: int = LONGEST, most: int = MOST) -> DataFrame:
    """(lang, phrase, f): occurrences of each phrase within pieces, overlaps included; the empty phrase counts words."""
    context, laid = texts.sparkSession.sparkContext, tries(phrases, most)
    slices = sorted(r[0] for r in laid.filter(F.col("trie").isNotNull()).select("slice").collect())
    parts = []
    for number in slices:  # one trie of bounded size at a time, whatever their number
        own = laid.filter((F.col("slice") == number) & F.col("trie").isNotNull()).select("trie").first()[0]
        held = context.broadcast(bytes(own))
        walked = texts.mapInArrow(_walking(held, longest), "block int, states binary, counts binary")
        sums = walked.repartition("block").sortWithinPartitions("block").mapInArrow(_summing, "state bigint, f bigint")
        parts.append(cut(sums.withColumn("slice", F.lit(number))))
        held.destroy()
    if not parts:
        return laid.select("lang", "phrase", F.lit(0).cast("bigint").alias("f"))
    counted = laid.select("slice", "state", "lang", "phrase").join(reduce(DataFrame.unionByName, parts), ["slice", "state"])
    return counted.groupBy("lang", "phrase").agg(F.max("f").alias("f"))  # languages stand in several slices


# --- scores ------------------------------------------------------------------------------------------------------

def _whole(column: Column | str) -> Column:
    return (F.col(column) if isinstance(column, str) else column).cast("decimal(20,0)")


def _joined(words: str, first, size) -> Column:
    return F.array_join(F.slice(words, first, size), " ")


def scored(counts: DataFrame, least: int = LEAST) -> DataFrame:
    """(lang, phrase, a, l, r, n, score) of the candidates that lie in no longer one of nearly their count.

    The score is that of the weakest cut, of equal ones the first, in exact integer arithmetic.
    """
    counts = cut(counts)
    frequent = cut(counts.filter((F.col("f") >= least) & F.col("phrase").contains(" ")).select(
        "lang", "phrase", F.col("f").alias("a"), F.split("phrase", " ").alias("w")))
    cuts = frequent.select("*", F.explode(F.sequence(F.lit(1), F.size("w") - 1)).alias("k"))
    cuts = cuts.select("lang", "phrase", "a", "k", _joined("w", F.lit(1), F.col("k")).alias("head"),
                       _joined("w", F.col("k") + 1, F.size("w")).alias("tail"))
    heads = counts.select("lang", F.col("phrase").alias("head"), F.col("f").alias("l"))
    tails = counts.select("lang", F.col("phrase").alias("tail"), F.col("f").alias("r"))
    both = cuts.join(heads, ["lang", "head"]).join(tails, ["lang", "tail"])
    score = F.call_function("div", _whole("a") * F.lit(2_000_000).cast("decimal(10,0)"), _whole("l") + _whole("r"))
    weakest = both.groupBy("lang", "phrase").agg(F.first("a").alias("a"), F.min(F.struct(
        score.cast("bigint").alias("score"), "k", "l", "r")).alias("cut"))

    inner = frequent.filter(F.size("w") > 2).select("lang", "a", "w", F.explode(F.sequence(F.lit(2), F.size("w") - 1)).alias("size"))
    inner = inner.select("lang", "a", F.explode(F.transform(
        F.sequence(F.lit(1), F.size("w") - F.col("size") + 1), lambda i: F.array_join(F.slice("w", i, F.col("size")), " "))).alias("phrase"))
    around = inner.groupBy("lang", "phrase").agg(F.max("a").alias("longer"))
    kept = weakest.join(around, ["lang", "phrase"], "left").filter(
        F.col("longer").isNull() | (_whole("longer") * 100 < _whole("a") * 80))
    words = counts.filter(F.col("phrase") == "").select("lang", F.col("f").alias("n"))
    return kept.join(words, "lang").select("lang", "phrase", "a", "cut.l", "cut.r", "n", "cut.score")


def collocations(docs: DataFrame, text: str = "text", lang: str = "lang", least: int = LEAST, top: int = TOP,
                 longest: int = LONGEST, most: int = MOST) -> DataFrame:
    """Each language's first ``top`` phrases: lang, rank (from 1), phrase, a, l, r, n, score.

    A null language counts as ``und``, a null text as empty. All rows count, repeated ones each. Other columns are not
    read. No phrase is frequent in an empty table, which gives no rows. A text of any length is worked on by sections
    between pieces; a single piece is held whole.
    """
    if not 1 <= least <= LEAST:
        raise ValueError(f"counts are told apart up to {LEAST}")
    texts = docs.select(F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("text"), F.coalesce(F.col(f"`{lang}`"), F.lit(UNKNOWN)).alias("lang"))
    found = scored(phrase_counts(texts, candidates(texts, longest), longest, most), least)
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    ranked = found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top)
    return ranked.select("lang", F.col("rank").cast("bigint").alias("rank"), "phrase", "a", "l", "r", "n", "score")
