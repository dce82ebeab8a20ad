"""Fill-in-middle: a text is cut in three and its middle moved to the end, over seekable compressed frames.

A text is stored as independent zstandard frames of about ``FRAME`` bytes, never cutting a character, together with
the cumulative number of units (code points) at the end of each frame. A cut at unit u then needs the one frame that
holds u: it is found in the cumulative counts and decompressed; all others move to their place in the output as the
compressed bytes they are. The output is stored as frames of the same kind. Digests are taken frame by frame in
order, so no text is ever held whole once it is stored, however long it is. The restored digest is worked out from
the stored output and its form alone: one pass finds the marks, a second streams the parts in their first order.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, LongType, StringType, StructField, StructType

from linkspark.llm import wordhash as W
from linkspark.llm.rows import riding, unpacked
from linkspark.session import cut

FRAME = 1 << 16  # bytes of text in a frame
BATCH = 1 << 24  # compressed bytes that leave a task at once
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
ORDER = {"psm": (PREFIX, SUFFIX, MIDDLE), "spm": (SUFFIX, PREFIX, MIDDLE)}
PLAIN_FROM, SPM_BELOW = 90, 20  # percentages of the third and the fourth draw
SEED = "1"
RESULT = ("n", "form", "prefix_chars", "middle_chars", "frames", "ends", "output_sha256", "restored_sha256")
_STORED = StructType().add("frames", ArrayType(BinaryType())).add("ends", ArrayType(LongType()))
_ARROW = {BinaryType(): pa.binary(), LongType(): pa.int64(), StringType(): pa.string()}


def _zstd():
    import zstandard
    return zstandard


# --- frames ------------------------------------------------------------------------------------------------

def units_in(data: bytes | memoryview | np.ndarray) -> int:
    """Code points of UTF-8 bytes."""
    return int(np.count_nonzero((np.frombuffer(data, np.uint8) & 0xC0) != 0x80))


def byte_of(data: bytes, unit: int) -> int:
    """Where the unit-th code point starts; the length if there are no more."""
    starts = np.flatnonzero((np.frombuffer(data, np.uint8) & 0xC0) != 0x80)
    return int(starts[unit]) if unit < len(starts) else len(data)


class Frames:
    """Writes frames. Bytes gather until a frame is full; a large frame from elsewhere goes in as it is."""

    def __init__(self, size: int = FRAME) -> None:
        self.size, self.packer = size, _zstd().ZstdCompressor(level=3)
        self.start()

    def start(self) -> None:
        self.frames: list[bytes] = []
        self.ends: list[int] = []
        self.held: list[bytes] = []
        self.bytes = self.units = 0

    def _add(self, frame: bytes, units: int) -> None:
        self.frames.append(frame)
        self.ends.append((self.ends[-1] if self.ends else 0) + units)

    def flush(self) -> None:
        if self.bytes:
            data = self.held[0] if len(self.held) == 1 else b"".join(self.held)
            self._add(self.packer.compress(data), self.units)
            self.held, self.bytes, self.units = [], 0, 0

    def add(self, data: bytes) -> None:
        if len(data):
            self.held.append(data)
            self.bytes += len(data)
            self.units += units_in(data)
            if self.bytes >= self.size:
                self.flush()

    def move(self, frame: bytes, units: int, unpack) -> None:
        """A compressed frame of ``units`` code points; one that is small joins what is gathered."""
        if units < self.size // 8:
            self.add(unpack(frame))
        else:
            self.flush()
            self._add(frame, units)

    def done(self) -> tuple[list[bytes], list[int]]:
        self.flush()
        own = self.frames, self.ends
        self.start()
        return own


def cut_up(data: np.ndarray, size: int = FRAME) -> Iterator[bytes]:
    """Runs of about ``size`` bytes of UTF-8, cut between characters only."""
    first, n = 0, len(data)
    while first < n:
        last = min(n, first + size)
        while last < n and data[last] & 0xC0 == 0x80:
            last += 1
        yield data[first:last].tobytes()
        first = last


def between(frames: list[bytes], ends: list[int], low: int, high: int, unpack) -> Iterator[tuple[bytes, int]]:
    """Units ``low`` to ``high``: whole frames as (frame, units), parts of cut frames as (bytes, 0)."""
    at = int(np.searchsorted(ends, low, "right"))
    while low < high:
        begin = ends[at - 1] if at else 0
        if low == begin and ends[at] <= high:
            yield frames[at], ends[at] - begin
        else:
            data = unpack(frames[at])
            yield data[byte_of(data, low - begin):byte_of(data, min(high, ends[at]) - begin)], 0
        low, at = ends[at], at + 1


def arranged(frames: list[bytes], ends: list[int], form: str, a: int, b: int, writer: Frames, unpack) -> tuple[list[bytes], list[int]]:
    """The output of a text: itself, or its parts in the order of ``form`` behind their marks."""
    n = ends[-1] if ends else 0
    ranges = {PREFIX: (0, a), MIDDLE: (a, b), SUFFIX: (b, n)}
    if form not in ORDER:
        return frames, ends
    for mark in ORDER[form]:
        writer.add(mark.encode())
        for data, units in between(frames, ends, *ranges[mark], unpack):
            if units:
                writer.move(data, units, unpack)
            else:
                writer.add(data)
    return writer.done()


def _parts(frames: Iterable[bytes], form: str, digest, unpack) -> tuple[dict[str, tuple[int, int]], list[int]]:
    """One pass over an output: feeds ``digest``, finds the parts as byte ranges, and counts the frames' bytes.

    The text holds no mark, and a mark begins with what no other has inside, so the first of each in turn is it.
    """
    marks, places, tail, at, sizes = list(ORDER.get(form, ())), [], b"", 0, []
    for frame in frames:
        data = unpack(frame)
        digest.update(data)
        sizes.append(len(data))
        look, base, start = tail + data, at - len(tail), 0
        while len(places) < len(marks):
            found = look.find(marks[len(places)].encode(), start)
            if found < 0:
                break
            places.append(base + found)
            start = found + 3
        tail = look[max(start, len(look) - 2):]
        at += len(data)
    if len(places) < len(marks):
        raise ValueError("an output lacks a mark of its form")
    return {m: (p + 3, end) for m, p, end in zip(marks, places, [*places[1:], at])}, sizes


def digests(frames: list[bytes], form: str, unpack) -> tuple[str, str]:
    """sha256 of an output and of the text that it and its form give back."""
    whole = hashlib.sha256()
    parts, sizes = _parts(frames, form, whole, unpack)
    if not parts:
        return whole.hexdigest(), whole.hexdigest()
    back, starts = hashlib.sha256(), np.concatenate([[0], np.cumsum(sizes)])
    for mark in (PREFIX, MIDDLE, SUFFIX):
        low, high = parts[mark]
        at = int(np.searchsorted(starts, low, "right")) - 1
        while low < high:
            data = unpack(frames[at])
            back.update(data[low - int(starts[at]):high - int(starts[at])])
            at += 1
            low = int(starts[at])
    return whole.hexdigest(), back.hexdigest()


# --- jobs --------------------------------------------------------------------------------------------------

def _strings(*names: str) -> StructType:
    return StructType([StructField(n, StringType()) for n in names])


def _mapped(df: DataFrame, keep: list[str], added: StructType, work) -> DataFrame:
    """``keep`` and the columns that ``work`` makes of each row's others; ``work`` yields (tuple, bytes)."""
    kinds = [pa.list_(_ARROW[f.dataType.elementType]) if isinstance(f.dataType, ArrayType) else _ARROW[f.dataType] for f in added]
    names = [*keep, *added.names]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            first, made, size = 0, [], 0
            for i, (row, n) in enumerate(work(batch)):
                made.append(row)
                size += n
                if size >= BATCH or i + 1 == batch.num_rows:
                    own = [batch.column(c).slice(first, len(made)) for c in keep]
                    new = [pa.array(list(x), kind) for x, kind in zip(zip(*made), kinds)]
                    yield pa.RecordBatch.from_arrays([*own, *new], names)
                    first, made, size = i + 1, [], 0

    return df.mapInArrow(run, StructType([*(df.schema[c] for c in keep), *added]))


def draws(key: str | Column, seed: str = SEED) -> list[Column]:
    """Four numbers below 2**32 from the hex sha256 of ``seed:key``; a null key counts as an empty one."""
    text = F.coalesce((F.col(key) if isinstance(key, str) else key).cast("string"), F.lit(""))
    hexed = F.sha2(F.concat(F.lit(f"{seed}:"), text).cast("binary"), 256)
    return [F.conv(F.substring(hexed, 1 + 8 * i, 8), 16, 10).cast("bigint") for i in range(4)]


def store(rows: DataFrame, text: str, frame: int = FRAME) -> DataFrame:
    """``rows`` with ``text`` (null: empty) as ``frames`` and their cumulative units ``ends``.

    To be written where several jobs read it; one that cuts each text once takes the frames as they come.
    """
    def work(batch):
        writer = Frames(frame)
        data, offsets = W.buffers(batch.column(text))
        for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist()):
            for piece in cut_up(data[a:b], frame):
                writer.add(piece)
                writer.flush()
            own = writer.done()
            yield own, sum(map(len, own[0]))
    return _mapped(rows, [c for c in rows.columns if c != text], _STORED, work)


def outputs(stored: DataFrame, frame: int = FRAME) -> DataFrame:
    """``stored`` rows (with ``form``, ``a``, ``b``) with the frames of their outputs instead, written."""
    def work(batch):
        writer, unpack = Frames(frame), _zstd().ZstdDecompressor().decompress
        forms, first, second = (batch.column(c).to_pylist() for c in ("form", "a", "b"))
        for i in range(batch.num_rows):
            own = arranged(batch.column("frames")[i].as_py(), batch.column("ends")[i].as_py(), forms[i], first[i], second[i],
                           writer, unpack)
            yield own, sum(map(len, own[0]))
    return cut(_mapped(stored, [c for c in stored.columns if c not in ("frames", "ends")], _STORED, work))


def with_digests(written: DataFrame) -> DataFrame:
    """``written`` rows (with ``form``) plus ``output_sha256`` and ``restored_sha256``."""
    def work(batch):
        unpack, forms = _zstd().ZstdDecompressor().decompress, batch.column("form").to_pylist()
        frames = batch.column("frames")
        for i in range(batch.num_rows):
            yield digests(frames[i].as_py(), forms[i], unpack), 128
    return _mapped(written, [c for c in written.columns if c not in ("frames", "ends")],
                   _strings("output_sha256", "restored_sha256"), work)


def write_outputs(docs: DataFrame, key: str = "doc_id", text: str = "text", seed: str = SEED, plain_from: int = PLAIN_FROM,
                  spm_below: int = SPM_BELOW, frame: int = FRAME) -> tuple[list[str], DataFrame]:
    """Names of the columns that stay, and the stored outputs: ``_row``, ``n``, ``form``, ``a``, ``b``, frames."""
    names, rest = riding(docs, text, replaced=(*RESULT, text))
    body = F.coalesce(F.col(f"`{text}`").cast("string"), F.lit(""))
    marked = F.contains("_text", F.lit(PREFIX)) | F.contains("_text", F.lit(SUFFIX)) | F.contains("_text", F.lit(MIDDLE))
    h = draws(F.col(f"`{key}`"), seed)
    rows = docs.select(rest, body.alias("_text"), F.array(*h).alias("h")).select("_row", "_text", "h", marked.alias("marked"))
    stored = store(rows, "_text", frame)
    n = F.coalesce(F.try_element_at("ends", F.lit(-1)), F.lit(0).cast("bigint"))
    one, two = F.col("h")[0] % (F.col("n") + 1), F.col("h")[1] % (F.col("n") + 1)
    plain = (F.col("n") == 0) | F.col("marked") | (F.col("h")[2] % 100 >= plain_from)
    form = F.when(plain, "plain").when(F.col("h")[3] % 100 < spm_below, "spm").otherwise("psm")
    chosen = stored.withColumn("n", n).select("_row", "n", form.alias("form"), F.least(one, two).alias("a"),
                                              F.greatest(one, two).alias("b"), "frames", "ends")
    return names, outputs(chosen, frame)


def fill_in_middle(docs: DataFrame, key: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """``docs`` without the text, plus ``n`` (units), ``form``, ``prefix_chars``, ``middle_chars`` (null in plain
    form), ``output_sha256`` and ``restored_sha256``.

    Null and empty texts are plain. Where to cut follows from ``key`` alone (a null key counts as an empty one), so
    repeated rows are cut alike. Columns of these names are replaced.
    """
    names, written = write_outputs(docs, key, text, **options)
    told, cuts = with_digests(written), F.col("form") != "plain"
    return told.select(*unpacked(names), "n", "form", F.when(cuts, F.col("a")).alias("prefix_chars"),
                       F.when(cuts, F.col("b") - F.col("a")).alias("middle_chars"), "output_sha256", "restored_sha256")


def output_texts(docs: DataFrame, key: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """``docs`` with their outputs as ``text``, read back from the frames, and ``form``."""
    names, written = write_outputs(docs, key, text, **options)

    def work(batch):
        unpack = _zstd().ZstdDecompressor().decompress
        for frames in batch.column("frames"):
            whole = b"".join(map(unpack, frames.as_py())).decode()
            yield (whole,), len(whole)
    told = _mapped(written.select("_row", "form", "frames"), ["_row", "form"], _strings("body"), work)
    return told.select(*unpacked(names), F.col("body").alias(text), "form")
