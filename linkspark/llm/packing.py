"""Best-fit packing of token sequences in bulk-synchronous rounds.

Documents are tokenised once into pieces of at most CAPACITY tokens; only narrow rows (piece, length) are packed.
Pieces of over half the capacity open a sequence each. Then rounds follow: pieces and gaps are laid out
by ranges of size; every range is swept from large to small, each piece taking its successor, the smallest gap
still free that holds it; what a range leaves over is matched across ranges by rank, from two numbers per range;
gaps are updated. Short pieces travel in bundles, smaller from round to round, so the number of rounds does not
grow with the pieces that fit a sequence. When a round finds room for next to none, new sequences are opened,
half filled with the largest pieces left.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from linkspark.llm.tokens import encoder, tokenizer_path
from linkspark.operators.skew import Agg, running
from linkspark.session import cut, scratch_dir, shuffle_partitions

CAPACITY = 2_048
KNOWN = 1_000_000  # pieces of words that a worker process knows at most; others are worked out each time
PER_TASK = 50_000  # pieces for each task and file of a round
ENOUGH = 0.02  # share of the pieces left that a round has to place, or new sequences are opened
_GAP, _PIECE, _MATCH = 0, 1, 2


def pieces(docs: DataFrame, end_id: int = 0, tokenizer: str | None = None, capacity: int = CAPACITY,
           key: str = "doc_id", text: str = "text", keep: bool = True) -> DataFrame:
    """(pid, doc_id, piece, start, length, ids_crc32) of every document, stored.

    A document is the ids of its whole text and ``end_id`` (null: the end alone); only a longer one than
    ``capacity`` is cut, and what is over stands in its first piece. ``keep`` leaves the pieces of words that a
    worker process knows to its later tasks; without it a task gives them up when it ends.
    """
    path, end = tokenizer or tokenizer_path(), np.array([end_id], "<u4")
    schema = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())])

    def cut_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(path, KNOWN).encode
        for batch in batches:
            out: list[list] = [[], [], [], [], []]
            for k, own in zip(batch.column(0).to_pylist(), encode(batch.column(1))):
                ids = np.concatenate([own.astype("<u4", copy=False), end])
                raw, first = memoryview(ids).cast("B"), len(ids) % capacity
                cuts = [*([0] if first else []), *range(first, len(ids), capacity), len(ids)]
                for i, (a, b) in enumerate(zip(cuts, cuts[1:])):
                    for column, value in zip(out, (k, i, a, b - a, zlib.crc32(raw[4 * a:4 * b]))):
                        column.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(out, schema)], schema=schema)
        if not keep:
            encoder.cache_clear()

    rows = docs.select(F.col(key).cast("bigint").alias("doc_id"), F.col(text).alias("text")).mapInArrow(
        cut_up, "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint")
    return cut(rows.withColumn("pid", F.monotonically_increasing_id()))


_UNITS = ("kind int, size bigint, id bigint, members array<struct<pid:bigint,length:bigint>>")
_SWEPT = "part int, kind int, rank bigint, bin bigint, gap bigint, size bigint, members array<struct<pid:bigint,length:bigint>>"
_MEMBERS = pa.list_(pa.struct([("pid", pa.int64()), ("length", pa.int64())]))
_SWEPT_ARROW = pa.schema([("part", pa.int32()), ("kind", pa.int32()), ("rank", pa.int64()), ("bin", pa.int64()),
                          ("gap", pa.int64()), ("size", pa.int64()), ("members", _MEMBERS)])


def _bundles(width: int):
    """Neighbouring pieces whose running length starts in the same stretch of ``width`` tokens, as one unit."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not len(batch):
                continue
            pid, length = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            starts = np.cumsum(length) - length
            fresh = np.concatenate([[True], starts[1:] // width != starts[:-1] // width]) if width > 1 else np.ones(len(pid), bool)
            first = np.flatnonzero(fresh)
            members = pa.ListArray.from_arrays(
                pa.array(np.append(first, len(pid)), pa.int32()),
                pa.StructArray.from_arrays([pa.array(pid), pa.array(length)], ["pid", "length"]))
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(first), _PIECE), pa.int32()), pa.array(np.add.reduceat(length, first)),
                                              pa.array(pid[first]), members.cast(_MEMBERS)], ["kind", "size", "id", "members"])
    return run


def _sweep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One range, from large to small, gaps before pieces of their size: a piece takes the last gap still free."""
    part, free, missed = TaskContext.get().partitionId(), [], 0
    for batch in batches:
        out: list[tuple] = []
        for kind, size, own, members in zip(*(batch.column(i).to_pylist() for i in range(4))):
            if kind == _GAP:
                free.append((own, size))
            elif free:
                out.append((part, _MATCH, None, *free.pop(), size, members))
            else:
                out.append((part, _PIECE, missed, None, None, size, members))
                missed += 1
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), _SWEPT_ARROW)] if out else
                                         [pa.array([], f.type) for f in _SWEPT_ARROW], schema=_SWEPT_ARROW)
    for a in range(0, len(free), 10_000):
        rows = [(part, _GAP, a + i, own, size, None, None) for i, (own, size) in enumerate(free[a:a + 10_000])]
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), _SWEPT_ARROW)], schema=_SWEPT_ARROW)


def across(left: list[tuple[int, int, int]]) -> list[tuple[int, int, int, int, int, int]]:
    """Match what ranges leave over, from (range, pieces, gaps) in descending order of size.

    The pieces of a range come before its gaps. Result: (range of the pieces, first piece, range of the gaps,
    last gap, how many, matches before); pieces ascend while gaps descend.
    """
    free: list[list[int]] = []
    out, done = [], 0
    for part, n_pieces, n_gaps in left:
        taken = 0
        while taken < n_pieces and free:
            top = free[-1]
            n = min(n_pieces - taken, top[1])
            out.append((part, taken, top[0], top[1] - 1, n, done))
            taken, done = taken + n, done + n
            top[1] -= n
            if not top[1]:
                free.pop()
        if n_gaps:
            free.append([part, n_gaps])
    return out


_STATE = "kind int, pid bigint, bin bigint, size bigint, at bigint"  # gap: bin, size; piece: pid, size; placed: pid, bin, at


def _round(waiting: DataFrame, gaps: DataFrame, width: int, capacity: int, tasks: int) -> DataFrame:
    """One bulk step over pieces (pid, size) and gaps (bin, size): the new state, stored in ``tasks`` files."""
    spark = waiting.sparkSession
    bundles = waiting.select("pid", "size").mapInArrow(_bundles(width), _UNITS)
    empty = F.lit(None).cast("array<struct<pid:bigint,length:bigint>>").alias("members")
    units = bundles.unionByName(gaps.select(F.lit(_GAP).alias("kind"), "size", F.col("bin").alias("id"), empty))
    order = [F.desc("size"), F.asc("kind"), F.asc("id")]
    swept = cut(units.repartitionByRange(shuffle_partitions(waiting), *order).sortWithinPartitions(*order).mapInArrow(_sweep, _SWEPT))
    counts = swept.filter(F.col("kind") != _MATCH).groupBy("part").agg(
        F.sum((F.col("kind") == _PIECE).cast("int")).alias("pieces"), F.sum((F.col("kind") == _GAP).cast("int")).alias("gaps"))
    matched = across(sorted(tuple(r) for r in counts.collect()))  # two numbers per range

    both = swept.filter(F.col("kind") == _MATCH).select("bin", "gap", "size", "members")
    over = swept.filter(F.col("kind") != _MATCH)
    if matched:
        spans = [(p, _PIECE, first, first + n - 1, 1, before - first) for p, first, _, _, n, before in matched] + [
            (g, _GAP, last - n + 1, last, -1, before + last) for _, _, g, last, n, before in matched]
        table = spark.createDataFrame(spans, "_part int, _kind int, low bigint, high bigint, way int, base bigint")
        # two rows per range and boundary at most
        over = over.join(F.broadcast(table), (F.col("part") == F.col("_part")) & (F.col("kind") == F.col("_kind"))
                         & F.col("rank").between(F.col("low"), F.col("high")), "left")
        over = over.withColumn("match", F.col("base") + F.col("way") * F.col("rank"))
        met = over.filter("match is not null")
        pairs = met.filter(F.col("kind") == _PIECE).select("match", "size", "members").join(
            met.filter(F.col("kind") == _GAP).select("match", "bin", "gap"), "match")
        both = both.unionByName(pairs.select("bin", "gap", "size", "members"))
        over = over.filter("match is null")

    def line(kind: int, pid=None, own=None, size=None, at=None):
        values = zip(("pid", "bin", "size", "at"), (pid, own, size, at))
        return F.struct(F.lit(kind).alias("kind"), *[(F.lit(None).cast("bigint") if v is None else v).alias(n) for n, v in values])

    def before(i):
        return F.aggregate(F.slice("members", F.lit(1), i), F.lit(0).cast("bigint"), lambda n, m: n + m["length"])

    # all rows of the new state that come of one row at once: each input is gone through once
    placed = F.transform("members", lambda m, i: line(_MATCH, m["pid"], F.col("bin"), at=F.lit(capacity) - F.col("gap") + before(i)))
    smaller = F.array(line(_GAP, own=F.col("bin"), size=F.col("gap") - F.col("size")))
    kept = F.array(line(_GAP, own=F.col("bin"), size=F.col("gap")))
    still = F.transform("members", lambda m: line(_PIECE, m["pid"], size=m["length"]))
    new = both.select(F.inline(F.when(F.col("gap") > F.col("size"), F.concat(placed, smaller)).otherwise(placed))).unionByName(
        over.select(F.inline(F.when(F.col("kind") == _GAP, kept).otherwise(still))))
    return cut(new.select("kind", "pid", "bin", "size", "at").coalesce(tasks))


def _open(waiting: DataFrame, capacity: int, tasks: int) -> DataFrame:
    """New sequences, half filled: the largest pieces up to half of all that is left, in stretches of half a capacity."""
    half = capacity // 2
    lined = running(waiting.select("pid", "size", (-F.col("size")).alias("down")), [], ["down", "pid"],
                    [Agg("before", "sum", F.col("size"), exclusive=True)])
    lined = lined.withColumn("before", F.coalesce("before", F.lit(0)))  # nothing is before the first
    total = waiting.agg(F.sum("size")).first()[0]
    lined = lined.withColumn("group", F.floor(F.col("before") / half)).withColumn("taken", F.col("before") * 2 < total)
    whole = Window.partitionBy("group")  # half a capacity of pieces
    taken = lined.filter("taken").select(
        "pid", "size", F.min_by("pid", "before").over(whole).alias("bin"), (F.col("before") - F.min("before").over(whole)).alias("at"),
        F.sum("size").over(whole).alias("used"))
    null = F.lit(None).cast("bigint")
    placed = taken.select(F.lit(_MATCH).alias("kind"), "pid", "bin", null.alias("size"), "at")
    gaps = taken.filter((F.col("at") == 0) & (F.col("used") < capacity)).select(
        F.lit(_GAP).alias("kind"), null.alias("pid"), "bin", (F.lit(capacity) - F.col("used")).alias("size"), null.alias("at"))
    still = lined.filter("not taken").select(F.lit(_PIECE).alias("kind"), "pid", null.alias("bin"), "size", null.alias("at"))
    return cut(placed.unionByName(gaps).unionByName(still).coalesce(tasks))


def _part(state: DataFrame, kind: int, *columns: str) -> DataFrame:
    return state.filter(F.col("kind") == kind).select(*columns)


def pack(lengths: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """(pid, bin, at) for every row of ``lengths`` (pid, length): pieces of 1 to ``capacity`` tokens.

    ``bin`` is the pid that opened the sequence; places in a sequence are gapless from 0. What a round places is
    added to one folder and read once at the end, so neither a plan nor a list of files grows with the rounds.
    """
    folder = f"{scratch_dir(lengths.sparkSession).rstrip('/')}/linkspark/{uuid.uuid4().hex}"
    tasks = min(shuffle_partitions(lengths), 1 + lengths.count() // PER_TASK)

    def place(rows: DataFrame) -> None:
        rows.select("pid", "bin", "at").coalesce(tasks).write.mode("append").parquet(folder)
    small = lengths.select("pid", F.col("length").alias("size")).filter(F.col("size") * 2 <= capacity)
    large = lengths.filter(F.col("length") * 2 > capacity)
    place(large.select("pid", F.col("pid").alias("bin"), F.lit(0).cast("bigint").alias("at")))
    gaps = large.filter(F.col("length") < capacity).select(F.col("pid").alias("bin"), (F.lit(capacity) - F.col("length")).alias("size"))
    waiting = cut(small.repartitionByRange(shuffle_partitions(lengths), F.desc("size"), "pid").sortWithinPartitions(F.desc("size"), "pid"))
    left, width = waiting.count(), capacity // 4
    holes = gaps.limit(1).count()
    while left:
        if holes:
            state = _round(waiting, gaps, width, capacity, tasks)
            place(_part(state, _MATCH, "pid", "bin", "at"))
            waiting, gaps = _part(state, _PIECE, "pid", "size"), _part(state, _GAP, "bin", "size")
            after = waiting.count()
            worth = left - after > ENOUGH * left
            left, width = after, max(1, width // 2)
        if left and not (holes and worth):
            state = _open(waiting, capacity, tasks)
            place(_part(state, _MATCH, "pid", "bin", "at"))
            waiting, gaps = _part(state, _PIECE, "pid", "size"), gaps.unionByName(_part(state, _GAP, "bin", "size"))
            left, holes, width = waiting.count(), 1, capacity // 4
    return lengths.sparkSession.read.schema("pid bigint, bin bigint, at bigint").parquet(folder)


def pack_documents(docs: DataFrame, end_id: int = 0, tokenizer: str | None = None, capacity: int = CAPACITY,
                   key: str = "doc_id", text: str = "text", keep: bool = True) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, sequence_id, offset) for every piece of every document.

    A null or empty text is the end id alone. Repeated rows are documents of their own. An empty table gives no
    rows. Other columns are not read.
    """
    rows = pieces(docs, end_id, tokenizer, capacity, key, text, keep)
    columns = ["doc_id", "piece", "start", "length", "ids_crc32"]
    full = rows.filter(F.col("length") == capacity).select(*columns, F.col("pid").alias("sequence_id"), F.lit(0).cast("bigint").alias("offset"))
    part = rows.filter(F.col("length") < capacity)
    places = pack(part.select("pid", "length"), capacity)
    return full.unionByName(part.join(places, "pid").select(*columns, F.col("bin").alias("sequence_id"), F.col("at").alias("offset")))
