"""Nearest neighbours by inner product: a vantage-point tree per shard.

With one more coordinate, ``sqrt(M**2 - |x|**2)`` for a row and 0 for a query (M: the largest norm), the row
with the largest inner product is the nearest in Euclidean distance, so the triangle inequality holds. A node
keeps a vantage point and the ranges of its distances to the rows inside and outside its median. A side is left
out if its rows are surely farther than ``factor`` times the k-th best distance found; factor 1 leaves out
nothing that could be better and so restores exact search, smaller factors search less.

Rows are dealt to shards by a hash of their id, so no shard grows with a hot vector; equal vectors of a shard
are one entry of its tree with all their ids. Queries go in blocks, and each task searches one block in one shard.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from linkspark.session import cut, shuffle_partitions

NEIGHBOURS = 20
FACTOR = 1.0  # exact; below it recall hangs on the data: one tree of 20 000 rows, norms unlike, found 0.54 at 0.25, 0.94 at 0.6
LEAF = 256
SHARD_ROWS, LEAST_SHARD, BLOCK = 65_536, 2_048, 16_384
_SPARE = 8  # entries kept beyond k while searching: rounding of the fast products can't lose a neighbour


# --- one shard ---------------------------------------------------------------------------------------

def build(ids: np.ndarray, vectors: np.ndarray, largest: float, leaf: int = LEAF) -> dict:
    """Tree over the distinct rows of ``vectors`` (float32 or 64); ``largest`` is M."""
    points, which = np.unique(vectors, axis=0, return_inverse=True)
    order = np.lexsort((ids, which.ravel()))
    starts = np.searchsorted(which.ravel()[order], np.arange(len(points) + 1))
    wide = points.astype(np.float64)
    extra = np.sqrt(np.maximum(0.0, largest ** 2 - (wide ** 2).sum(axis=1)))
    full = np.concatenate([wide, extra[:, None]], axis=1)
    rng, nodes, place = np.random.default_rng(len(points)), [], []

    def grow(rows: np.ndarray) -> int:
        at = len(nodes)
        nodes.append(None)
        if len(rows) > leaf:
            point = full[rows[rng.integers(len(rows))]]
            far = np.sqrt(((full[rows] - point) ** 2).sum(axis=1))
            inside = far <= np.median(far)
            if inside.any() and not inside.all():
                ranges = [(float(far[side].min()), float(far[side].max())) for side in (inside, ~inside)]
                nodes[at] = (point, ranges, grow(rows[inside]), grow(rows[~inside]))
                return at
        first = sum(map(len, place))
        place.append(rows)
        nodes[at] = (first, first + len(rows))
        return at

    grow(np.arange(len(points)))
    laid = np.concatenate(place)
    return {"points": points[laid], "ids": ids[order], "starts": starts[:-1][laid], "ends": starts[1:][laid],
            "nodes": nodes, "largest": largest}


def search(tree: dict, queries: np.ndarray, k: int, factor: float) -> np.ndarray:
    """The best ``k`` + _SPARE entries found for each query; -1 where there are fewer.

    A first visit finds the k-th score, in steps of a 2**-40th of the largest; a second collects everything that comes
    as near to it and decides by exact scores, ties by the smallest id, so none is lost, however many there are.
    """
    points, nodes = tree["points"].astype(np.float64), tree["nodes"]
    q = queries.astype(np.float64)
    base = (q ** 2).sum(axis=1) + tree["largest"] ** 2
    keep, unit = k + _SPARE, max(tree["largest"] ** 2, 1e-300) * 2.0 ** -40
    least = np.append(tree["ids"][tree["starts"]], np.iinfo(np.int64).max)  # smallest id of each entry; none comes last
    best = np.full((len(q), keep), -np.inf)
    entry = np.full((len(q), keep), -1, np.int64)

    def reach(rows: np.ndarray) -> np.ndarray:
        """Distance of the k-th best found so far, and a little more for what rounding may have moved."""
        kth = best[rows, k - 1] - 2 * unit
        return np.sqrt(np.maximum(0.0, base[rows] - 2 * kth)) + 1e-7 * tree["largest"]

    def visit(at: int, rows: np.ndarray) -> None:
        node = nodes[at]
        if len(node) == 2:
            first, last = node
            new = np.round(q[rows] @ points[first:last].T / unit) * unit
            some = new.max(axis=1) >= best[rows, -1]  # a leaf that holds nothing as good as the last changes nothing
            rows, new = rows[some], new[some]
            scores = np.concatenate([best[rows], new], axis=1)
            names = np.concatenate([entry[rows], np.broadcast_to(np.arange(first, last), new.shape)], axis=1)
            top = np.lexsort((least[names], -scores), axis=1)[:, :keep]
            best[rows], entry[rows] = np.take_along_axis(scores, top, 1), np.take_along_axis(names, top, 1)
            return
        point, ranges, *sides = node
        far = np.sqrt(np.maximum(0.0, base[rows] - 2 * (q[rows] @ point[:-1]) - tree["largest"] ** 2 + (point ** 2).sum()))
        near = far <= (ranges[0][1] + ranges[1][0]) / 2
        for here, there in ((0, 1), (1, 0)):  # the nearer side first, then the other as far as it can matter
            own = near if here == 0 else ~near
            if own.any():
                visit(sides[here], rows[own])
                low, high = ranges[there]
                gap = np.maximum(low - far[own], far[own] - high)
                more = rows[own][gap <= factor * reach(rows[own])]
                if len(more):
                    visit(sides[there], more)

    def exact(pairs: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
        """The first ``keep`` entries of each query by their exact scores, of equal ones by the smallest id."""
        row, own = (np.concatenate(x) for x in zip(*pairs))
        scores = np.concatenate([(points[own[i:i + 65_536]] * q[row[i:i + 65_536]]).sum(axis=1) for i in range(0, len(own), 65_536)])
        by = np.lexsort((least[own], -scores, row))
        row, own = row[by], own[by]
        starts = np.flatnonzero(np.concatenate([[True], row[1:] != row[:-1]]))
        first = np.arange(len(row)) - np.repeat(starts, np.diff(np.append(starts, len(row)))) < keep
        return row[first], own[first]

    def collect(at: int, rows: np.ndarray, pairs: list) -> None:
        """All entries that are as good as the last that counts, or nearly: rounding must not decide between ties."""
        node = nodes[at]
        if len(node) == 2:
            new = q[rows] @ points[node[0]:node[1]].T
            r, own = np.nonzero(new >= (best[rows, k - 1] - 2 * unit)[:, None])
            if len(r):
                pairs.append((rows[r], own + node[0]))
            if sum(len(x) for x, _ in pairs[1:]) > 1 << 21:
                pairs[:] = [exact(pairs)]
            return
        point, ranges, *sides = node
        far = np.sqrt(np.maximum(0.0, base[rows] - 2 * (q[rows] @ point[:-1]) - tree["largest"] ** 2 + (point ** 2).sum()))
        for side, (low, high) in zip(sides, ranges):
            own = rows[np.maximum(low - far, far - high) <= factor * reach(rows)]
            if len(own):
                collect(side, own, pairs)

    if len(q) and len(points):
        for first in range(0, len(q), 1024):
            rows, pairs = np.arange(first, min(len(q), first + 1024)), []
            visit(0, rows)
            collect(0, rows, pairs)
            entry[rows] = -1
            if pairs:
                row, own = exact(pairs)
                starts = np.flatnonzero(np.concatenate([[True], row[1:] != row[:-1]]))
                entry[row, np.arange(len(row)) - np.repeat(starts, np.diff(np.append(starts, len(row))))] = own
    return entry


def nearest(tree: dict, query_ids: np.ndarray, queries: np.ndarray, k: int, factor: float):
    """(query id, id, score) of each query's ``k`` nearest in the shard; its own row is no candidate."""
    entries = search(tree, queries, k + 1, factor)  # its own row may be among them
    out_q, out_i, out_s = [], [], []
    for i, own in enumerate(query_ids.tolist()):
        found = entries[i][entries[i] >= 0]
        scores = (tree["points"][found].astype(np.float64) * queries[i].astype(np.float64)).sum(axis=1)
        ids = [tree["ids"][a:min(b, a + k + 1)] for a, b in zip(tree["starts"][found], tree["ends"][found])]
        score = np.repeat(scores, [len(x) for x in ids])
        ids = np.concatenate(ids) if len(ids) else np.zeros(0, np.int64)
        other = ids != own
        ids, score = ids[other], score[other]
        top = np.lexsort((ids, -score))[:k]
        out_q += [own] * len(top)
        out_i += ids[top].tolist()
        out_s += score[top].tolist()
    return out_q, out_i, out_s


# --- the cluster -------------------------------------------------------------------------------------

def usable(vector: str) -> Column:
    """Not null, not zero, every component a finite number."""
    v = F.col(vector)
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.coalesce(v.isNotNull() & ~bad & F.exists(v, lambda x: x != 0), F.lit(False))


def build_index(rows: DataFrame, shards: int, leaf: int = LEAF) -> DataFrame:
    """(dim, shard, tree) for ``rows`` (id, vector), stored; every row is in one tree."""
    wide = F.transform("vector", lambda x: x.cast("double"))
    sized = rows.withColumn("dim", F.size("vector"))
    norms = sized.groupBy("dim").agg(F.sqrt(F.max(F.aggregate(wide, F.lit(0.0), lambda n, x: n + x * x))).alias("largest"))
    largest = {r.dim: r.largest for r in norms.collect()}  # a number per dimension
    schema = pa.schema([("dim", pa.int32()), ("shard", pa.int32()), ("tree", pa.binary())])

    def plant(table: pa.Table) -> pa.Table:
        if not len(table):
            return schema.empty_table()
        ids = table["id"].to_numpy()
        dim = table["dim"][0].as_py()
        flat = table["vector"].combine_chunks().flatten().to_numpy(zero_copy_only=False)
        tree = build(ids, flat.reshape(len(ids), dim), largest[dim] * (1 + 1e-12), leaf)
        return pa.Table.from_pylist([{"dim": dim, "shard": table["shard"][0].as_py(), "tree": pickle.dumps(tree)}], schema)

    placed = sized.withColumn("shard", F.pmod(F.xxhash64("id"), F.lit(shards)).cast("int"))
    return cut(placed.groupBy("dim", "shard").applyInArrow(plant, "dim int, shard int, tree binary"))


def search_index(index: DataFrame, queries: DataFrame, shards: int, k: int = NEIGHBOURS, factor: float = FACTOR) -> DataFrame:
    """(query_id, rank, vec_id, score): the ``k`` nearest found in all shards, ties to the smaller id."""
    blocks = max(1, -(-queries.count() // BLOCK))
    asked = queries.withColumn("dim", F.size("vector")).withColumn("block", F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int"))
    asked = asked.withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1))))
    trees = index.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    schema = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.float64())])

    def look(left: pa.Table, right: pa.Table) -> pa.Table:
        if not len(left) or not len(right):
            return schema.empty_table()
        ids, dim = left["id"].to_numpy(), left["dim"][0].as_py()
        vectors = left["vector"].combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(len(ids), dim)
        tree = pickle.loads(right["tree"][0].as_py())
        return pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(nearest(tree, ids, vectors, k, factor), schema)], schema=schema)

    by = ["dim", "shard", "block"]
    found = asked.groupBy(*by).cogroup(trees.groupBy(*by)).applyInArrow(look, "query_id bigint, vec_id bigint, score double")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")  # k rows per shard at most
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def neighbours(rows: DataFrame, is_query: Column, k: int = NEIGHBOURS, factor: float = FACTOR, key: str = "vec_id",
               vector: str = "embedding") -> DataFrame:
    """The ``k`` nearest rows found for each row that ``is_query`` marks, its own row left out.

    Vectors that are null, zero, or hold a null or non-finite component take no part, neither do rows without
    an id; vectors of different lengths are not compared. Rows that repeat an id are candidates each, but none
    for a query of that id. Every row is indexed. An empty table gives no rows; other columns are not read.
    """
    good = cut(rows.filter(F.col(key).isNotNull() & usable(vector)).select(
        F.col(key).cast("bigint").alias("id"), F.col(vector).alias("vector"), F.coalesce(is_query, F.lit(False)).alias("asks")))
    n = good.count()
    shards = max(1, -(-n // SHARD_ROWS), min(shuffle_partitions(rows), -(-n // LEAST_SHARD)))
    index = build_index(good.select("id", "vector"), shards)
    return search_index(index, good.filter("asks").select("id", "vector"), shards, k, factor)
