"""MinHash near-duplicates by an inverted join over signature coordinates.

Documents with equal shingle sets form a class, and only classes go on. Each is posted under its (coordinate,
value) pairs. Pairs of classes with a similarity of 0.75 agree in MATCHES of K coordinates but for odds of
about 10**-6, so:

- prefix: of a class's values that others have too, in order of frequency, all but the MATCHES - 1 most
  frequent are listed; two classes with enough matches meet in such a list, and a class with fewer shared
  values than MATCHES meets nobody;
- skip: the long lists left out are not merged; they are probed, by comparing the signatures of those that met.

What is asked for is who hangs together, so within a list not all pairs are formed. First everyone is compared
with the list's most central member, then, if still apart, with another one. Lists whose members are still in
different components are gone through in full across components, block by block, so no link that joins two is
lost; there a longer signature of those few documents weeds out pairs that are surely not similar enough, and
only what is left over is ever written. Every link is confirmed on the full shingle sets. Components come from alternating stars, in written rounds.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from linkspark.llm import wordhash as W
from linkspark.session import cut, shuffle_partitions

SHINGLE, PERCENT = 5, 75
K, MATCHES = 64, 31
LONG, LONG_MATCHES = 1024, 703  # one byte each; at a similarity of 0.75 fewer agree with odds of about 10**-6
BLOCK = 1_024  # members of a list that one task compares with each other or with another such block
PER_TASK = 20_000  # edges for each task and file of a step of ``components``
_RNG = np.random.default_rng(3)
_FLIP = _RNG.integers(1, 1 << 64, K, np.uint64)
_TURN = _RNG.integers(1, 1 << 64, K, np.uint64) | np.uint64(1)
_LONG_FLIP = _RNG.integers(1, 1 << 64, LONG, np.uint64)
_LONG_TURN = _RNG.integers(1, 1 << 64, LONG, np.uint64) | np.uint64(1)
_SALT = np.uint64(0x94D049BB133111EB)


def shingles(prints: np.ndarray) -> np.ndarray:
    """Sorted distinct shingles of one text's words; fewer than SHINGLE words make one, none make none."""
    return np.unique(W.windows(prints, min(SHINGLE, len(prints)))) if len(prints) else np.zeros(0, np.uint64)


def _signatures(sets: list[np.ndarray]) -> np.ndarray:
    """The K smallest values of each (non-empty) set under K hash functions."""
    flat, starts = np.concatenate(sets), np.cumsum([0, *[len(s) for s in sets[:-1]]])
    out = np.empty((len(sets), K), np.uint32)
    for k in range(K):
        out[:, k] = np.minimum.reduceat((((flat ^ _FLIP[k]) * _TURN[k]) >> np.uint64(32)).astype(np.uint32), starts)
    return out


def _profiles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The long signature of each text, a byte of every smallest value."""
    for batch in batches:
        for a, b, data, offsets in W.chunks(batch.column(1), 1 << 18):
            _, _, prints, counts = W.words(data, offsets, lower=True)
            sets = [shingles(prints[x:y]) for x, y in zip(counts.tolist(), counts[1:].tolist())]
            flat, starts = np.concatenate(sets), np.cumsum([0, *[len(s) for s in sets[:-1]]])
            out = np.empty((len(sets), LONG), np.uint8)
            for k in range(LONG):
                out[:, k] = np.minimum.reduceat((flat ^ _LONG_FLIP[k]) * _LONG_TURN[k], starts) >> np.uint64(20) & np.uint64(255)
            yield pa.RecordBatch.from_arrays([batch.column(0)[a:b], pa.array([x.tobytes() for x in out], pa.binary())], ["cid", "long"])


def _class_id(own: np.ndarray) -> int:
    """One number for a shingle set: 64 bits, the same for equal sets."""
    return int(W.mixed(np.array([W.mixed(own ^ _SALT).sum(dtype=np.uint64) + np.uint64(len(own))]))[0].astype(np.int64))


def _sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for a, b, data, offsets in W.chunks(batch.column(0), 1 << 20):
            _, _, prints, counts = W.words(data, offsets, lower=True)
            sets = [shingles(prints[x:y]) for x, y in zip(counts.tolist(), counts[1:].tolist())]
            full = [s for s in sets if len(s)]
            signs = iter(_signatures(full).astype(np.int64).tolist() if full else [])
            yield pa.RecordBatch.from_arrays([
                batch.column(1)[a:b], pa.array([len(s) for s in sets], pa.int64()),
                pa.array([_class_id(s) if len(s) else None for s in sets], pa.int64()),
                pa.array([next(signs) if len(s) else None for s in sets], pa.list_(pa.int64()))],
                ["row", "n_shingles", "cid", "sign"])


def _matching(a: str, b: str) -> Column:
    """Number of coordinates in which two signatures agree."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x == y).cast("int")), F.lit(0), lambda n, x: n + x)


def _compare(key: int, side: np.ndarray, cid: np.ndarray, comp: np.ndarray, mask: np.ndarray, sign: np.ndarray, long: np.ndarray):
    """Pairs across components within one block, or between two, that may be similar; each pair in one list only,
    the first by coordinate that both are listed in."""
    at = key >> 32
    listed = (mask[:, None] >> np.arange(K)) & 1 > 0
    one, other = (np.flatnonzero(side == side.min()), np.flatnonzero(side == side.max()))
    for a in range(0, len(one), 128):
        for b in range(0, len(other), 128):
            left, right = one[a:a + 128], other[b:b + 128]
            apart = comp[left][:, None] != comp[right][None]
            if side.min() == side.max():
                apart &= left[:, None] < right[None]
            if not apart.any():
                continue
            same = sign[left][:, None] == sign[right][None]
            x, y = np.nonzero(apart & (same.sum(axis=2) >= MATCHES))
            close = (long[left[x]] == long[right[y]]).sum(axis=1) >= LONG_MATCHES
            x, y = x[close], y[close]
            common = same[x, y] & listed[left[x]] & listed[right[y]]
            first = common.argmax(axis=1) == at
            p, q = cid[left[x[first]]], cid[right[y[first]]]
            yield np.minimum(p, q), np.maximum(p, q)


def _across(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by (key, low, high): the groups one after another, the last of a batch with the next batch."""
    carry: list[pa.RecordBatch] = []

    def pairs(table: pa.Table) -> Iterator[pa.RecordBatch]:
        key, low, high, side, cid, comp, mask = (table.column(i).to_numpy() for i in range(7))
        fresh = np.concatenate([[True], (key[1:] != key[:-1]) | (low[1:] != low[:-1]) | (high[1:] != high[:-1]), [True]])
        edges = np.flatnonzero(fresh)
        sign = np.frombuffer(b"".join(table.column(7).to_pylist()), "<u4").reshape(-1, K)
        long = np.frombuffer(b"".join(table.column(8).to_pylist()), np.uint8).reshape(-1, LONG)
        for a, b in zip(edges.tolist(), edges[1:].tolist()):
            for p, q in _compare(int(key[a]), side[a:b], cid[a:b], comp[a:b], mask[a:b], sign[a:b], long[a:b]):
                if len(p):
                    yield pa.RecordBatch.from_arrays([pa.array(p), pa.array(q)], ["a", "b"])

    for batch in batches:
        if not len(batch):
            continue
        whole = pa.Table.from_batches([*carry, batch])
        last = [whole.column(i)[-1].as_py() for i in range(3)]
        ends = np.ones(len(whole), bool)
        for i in range(3):
            ends &= whole.column(i).to_numpy() == last[i]
        done = int(np.argmax(ends))
        yield from pairs(whole.slice(0, done)) if done else ()
        carry = whole.slice(done).combine_chunks().to_batches()
    if carry:
        yield from pairs(pa.Table.from_batches(carry))


def _linked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs (a, b, text of a, text of b) whose full shingle sets are similar enough."""
    last: dict[str, tuple] = {}

    def of(side: str, cid: int, text: str) -> np.ndarray:
        if last.get(side, (None,))[0] != cid:
            raw = np.frombuffer((text or "").encode(), np.uint8)
            last[side] = cid, shingles(W.words(raw, np.array([0, len(raw)]), lower=True)[2])
        return last[side][1]

    for batch in batches:
        keep = []
        for a, b, ta, tb in zip(*(batch.column(i).to_pylist() for i in range(4))):
            one, other = of("a", a, ta), of("b", b, tb)
            both = len(np.intersect1d(one, other, assume_unique=True))
            keep.append(100 * both >= PERCENT * (len(one) + len(other) - both) > 0)
        yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))


def _confirmed(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """Stored links among ``pairs`` (a, b)."""
    one = pairs.join(texts.select(F.col("cid").alias("a"), F.col("text").alias("ta")), "a")
    both = one.join(texts.select(F.col("cid").alias("b"), F.col("text").alias("tb")), "b")
    return cut(both.select("a", "b", "ta", "tb").mapInArrow(_linked, "a bigint, b bigint"))


def _tasks(df: DataFrame, rows: int) -> int:
    """Tasks for a step over so many narrow rows: all cores at least, no more than shuffles have partitions."""
    return min(shuffle_partitions(df), max(df.sparkSession.sparkContext.defaultParallelism, 1 + rows // PER_TASK))


def components(edges: DataFrame) -> DataFrame:
    """(node, comp) for every node of ``edges`` (a, b): comp is the smallest node that can be reached.

    Alternating large and small stars; each step is written, in as many files as its rows are worth. Hubs cost
    nothing special: neighbours are never collected, only counted, and their smallest is kept. The rounds end as
    soon as all edges form stars around their smallest node, which the counts of the next round's first step tell.
    """
    tasks = _tasks(edges, edges.count())

    def few(df: DataFrame) -> DataFrame:
        return df if tasks == shuffle_partitions(df) else df.coalesce(tasks)

    def lowest(directed: DataFrame) -> DataFrame:
        return cut(few(directed.groupBy("u").agg(
            F.least(F.min("v"), F.col("u")).alias("m"), F.count_if(F.col("v") < F.col("u")).alias("below"),
            F.count_if(F.col("v") > F.col("u")).alias("above"))))

    def star(directed: DataFrame, low: DataFrame) -> DataFrame:
        return few(directed.join(low.select("u", "m"), "u"))

    ordered = edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    now = cut(few(ordered.distinct()))
    while True:
        down = now.select(F.col("a").alias("u"), F.col("b").alias("v"))
        ways = down.unionByName(now.select(F.col("b").alias("u"), F.col("a").alias("v")))
        low = lowest(ways)
        if not low.filter("below > 1 or below = 1 and above > 0").limit(1).count():
            break
        large = cut(few(star(ways, low).filter("v > u").select(F.col("v").alias("a"), F.col("m").alias("b")).distinct()))
        down = large.select(F.col("a").alias("u"), F.col("b").alias("v"))
        down = star(down, lowest(down))
        small = down.select(F.col("v").alias("a"), F.col("m").alias("b")).unionByName(down.select(F.col("u").alias("a"), F.col("m").alias("b")))
        now = cut(few(few(small.filter("a <> b")).distinct()))
    return low.select(F.col("u").alias("node"), F.col("m").alias("comp"))


def _links(classes: DataFrame, texts) -> DataFrame:
    """Edges (a, b) that hold every component of ``classes`` (cid, sign) together; ``texts`` fetches (cid, text)."""
    posts = classes.select("cid", F.posexplode("sign").alias("at", "value")).select(
        "cid", (F.col("at").cast("bigint") * F.lit(1 << 32) + F.col("value")).alias("key"))
    often = cut(posts.groupBy("key").agg(F.count("*").alias("f")).filter("f > 1"))
    shared = posts.join(often, "key").groupBy("cid").agg(
        F.array_sort(F.collect_list(F.struct("f", "key"))).alias("own"), F.sum("f").alias("weight"))  # K values at most
    # the values beyond the prefix are the most frequent ones: their long lists are skipped
    prefix = shared.filter(F.size("own") >= MATCHES).select(
        "cid", "weight", F.slice("own", F.lit(1), F.size("own") - (MATCHES - 1)).alias("own"))
    prefix = cut(prefix)
    some = texts(prefix.select("cid"))
    signs = cut(classes.join(prefix.select("cid"), "cid", "left_semi").select("cid", "sign"))
    lists = cut(prefix.select("cid", "weight", F.inline("own")).select("cid", "weight", "key"))
    comp = None

    for rank in (F.struct("weight", -F.col("cid")), F.struct(F.xxhash64("cid", F.lit("other")))):
        here = _with_components(lists, comp)
        pivots = here.groupBy("key").agg(
            F.max_by(F.struct("cid", "comp"), rank).alias("p"), F.min("comp").alias("low"), F.max("comp").alias("high"))
        pivots = cut(pivots.filter("low < high").select("key", F.col("p.cid").alias("b"), F.col("p.comp").alias("b_comp")))
        pairs = here.join(pivots, "key").filter("comp <> b_comp").select(F.col("cid").alias("a"), "b").distinct()
        pairs = pairs.join(signs.select(F.col("cid").alias("a"), F.col("sign").alias("sa")), "a").join(
            signs.select(F.col("cid").alias("b"), F.col("sign").alias("sb")), "b").filter(_matching("sa", "sb") >= MATCHES)
        links = _confirmed(pairs.select("a", "b"), some)
        comp = components(links if comp is None else _stars(comp).unionByName(links))

    # lists that still hold several components: every pair across two of them, one block against another
    here = _with_components(lists, comp)
    mixed = here.groupBy("key").agg(F.min("comp").alias("low"), F.max("comp").alias("high"), F.count("*").alias("n"))
    mixed = cut(mixed.filter("low < high").select("key", F.ceil(F.col("n") / BLOCK).cast("int").alias("blocks")))
    rest = cut(here.join(mixed, "key").select("key", "cid", "comp", "blocks"))
    left = rest.select("cid").distinct()
    coordinates = F.aggregate("own", F.lit(0).cast("bigint"), lambda m, x: m.bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("bigint"), F.call_function("shiftright", x["key"], F.lit(32)).cast("int"))))
    profile = cut(some.join(left, "cid", "left_semi").mapInArrow(_profiles, "cid bigint, long binary").join(
        prefix.select("cid", coordinates.alias("mask")), "cid").join(signs.select("cid", _packed("sign").alias("sign")), "cid"))
    placed = rest.withColumn("side", F.pmod(F.xxhash64("cid"), "blocks").cast("int")).withColumn(
        "with", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    rows = placed.join(profile, "cid").select("key", F.least("side", "with").alias("low"), F.greatest("side", "with").alias("high"),
                                              "side", "cid", "comp", "mask", "sign", "long")
    laid = rows.repartition(shuffle_partitions(rows), "key", "low", "high").sortWithinPartitions("key", "low", "high")
    last = _confirmed(cut(laid.mapInArrow(_across, "a bigint, b bigint")), some)
    return _stars(comp).unionByName(last)


def _stars(comp: DataFrame) -> DataFrame:
    """Known components (node, comp) as edges: what they were found from isn't gone through again."""
    return comp.select(F.col("node").alias("a"), F.col("comp").alias("b")).filter("a <> b")


def _packed(sign: str) -> Column:
    """Values below 2**32 as their bytes, little-endian."""
    return F.unhex(F.array_join(F.transform(sign, lambda v: F.concat(*[F.lpad(F.hex(F.call_function("shiftright", v, F.lit(8 * i)) % 256), 2, "0") for i in range(4)])), ""))


def _with_components(lists: DataFrame, comp: DataFrame | None) -> DataFrame:
    if comp is None:
        return lists.withColumn("comp", F.col("cid"))
    known = comp.withColumnRenamed("node", "cid").withColumnRenamed("comp", "_known")
    return lists.join(known, "cid", "left").withColumn("comp", F.coalesce("_known", "cid")).drop("_known")


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(``key``, _print, n_shingles, component, component_id, kept) for every row of ``docs``.

    Words are runs other than ASCII white space, A-Z in lower case; the set holds the distinct runs of SHINGLE
    words. Rows are linked if 100 * intersection >= PERCENT * union; a row without words is linked with nothing.
    ``component_id`` is the smallest id that can be reached (null only if all ids there are null), ``kept`` says
    that it is the row's own; ``component`` is a number of the group (null without words); ``_print`` hashes the
    text. Repeated rows are equal rows. Other columns are not read.
    """
    rows = docs.select(F.col(text).alias("text"), F.struct(F.col(key).alias("id"), F.xxhash64(text).alias("print")).alias("row"))
    kind = rows.schema["row"].dataType.simpleString()
    signed = cut(rows.mapInArrow(_sign, f"row {kind}, n_shingles bigint, cid bigint, sign array<bigint>"))
    classes = cut(signed.filter("cid is not null").groupBy("cid").agg(
        F.min("row.id").alias("low"), F.min("row").alias("first"), F.first("sign").alias("sign")))

    def texts(wanted: DataFrame) -> DataFrame:
        """One text of each wanted class: that of its first row."""
        firsts = classes.join(wanted, "cid", "left_semi").select("cid", F.col("first.id").alias("_id"), F.col("first.print").alias("_print"))
        source = docs.select(F.col(key).alias("id"), F.xxhash64(text).alias("print"), F.col(text).alias("text"))
        met = source.join(firsts, source["id"].eqNullSafe(firsts["_id"]) & (source["print"] == firsts["_print"]))
        return cut(met.dropDuplicates(["cid"]).select("cid", "text"))

    links = _links(classes.select("cid", "sign"), texts)
    comp = components(links)
    whole = classes.join(comp.withColumnRenamed("node", "cid"), "cid", "left").select(
        "cid", "low", F.coalesce("comp", "cid").alias("component"))
    lowest = cut(whole.groupBy("component").agg(F.min("low").alias("component_id")))
    member = cut(whole.join(lowest, "component").select("cid", "component", "component_id"))
    alone = signed.filter("cid is null").select(
        F.col("row.id").alias(key), F.col("row.print").alias("_print"), "n_shingles", F.lit(None).cast("bigint").alias("component"),
        F.col("row.id").alias("component_id"))
    joined = signed.filter("cid is not null").join(member, "cid").select(
        F.col("row.id").alias(key), F.col("row.print").alias("_print"), "n_shingles", "component", "component_id")
    return joined.unionByName(alone).withColumn("kept", F.coalesce(F.col(key) == F.col("component_id"), F.lit(False)))


def one_of_each(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with one row of each group of near-duplicates: the smallest (key, text hash), null keys last.

    Rows without words are groups of their own and all stay.
    """
    judged = cut(near_duplicates(docs, key, text))
    order = F.struct(F.col(key).isNull().alias("none"), F.col(key).alias("id"), F.col("_print").alias("print"))
    first = judged.filter("component is not null").groupBy("component").agg(F.min(order).alias("first"))
    stay = cut(first.select(F.col("first.id").alias("_id"), F.col("first.print").alias("_first"))
               .unionByName(judged.filter("component is null").select(F.col(key).alias("_id"), F.col("_print").alias("_first"))).distinct())
    rows = docs.withColumn("_print", F.xxhash64(text))
    kept = rows.join(stay, rows[key].eqNullSafe(stay["_id"]) & (rows["_print"] == stay["_first"]), "left_semi")
    twice = judged.filter("component is not null").groupBy(key, "_print").count().filter("count > 1").limit(1).count()
    if twice:  # rows that repeat both id and text: one of them
        worded = kept.filter(~F.coalesce(F.trim(F.translate(text, "\t\n\x0b\x0c\r", "     ")), F.lit("")).eqNullSafe(""))
        blank = kept.filter(F.coalesce(F.trim(F.translate(text, "\t\n\x0b\x0c\r", "     ")), F.lit("")).eqNullSafe(""))
        kept = worded.dropDuplicates([key, "_print"]).unionByName(blank)
    return kept.drop("_print")
