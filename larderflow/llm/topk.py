"""Exact top-k search by Fagin's threshold algorithm."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import parts, small, written
from .vectors import cells_at_most, codebook, nearest, rows, unpack, width

#: Neighbours of a query; ids divisible by this are queries; vectors of a block, whose lists are sorted; queries of a group, on average; digits of a score.
K, EVERY, BLOCK, GROUP, DIGITS = 10, 100, 2048, 1024, 9
#: Shares of the lists that are read before the bound is checked again.
DEPTHS = (1 / 32, 1 / 8, 1 / 4, 3 / 8, 1 / 2, 3 / 4, 1.0)


class Lists:
    """A block's vectors and, for each dimension, its rows sorted by value."""

    def __init__(self, ids: np.ndarray, x: np.ndarray):
        self.ids, self.x = ids, x
        self.exact = x.astype(np.float64)
        self.order = np.argsort(x, axis=0, kind="stable")
        self.sorted = np.take_along_axis(x, self.order, 0).astype(np.float64)


def threshold_search(q: np.ndarray, lists: Lists, k: int, floor: np.ndarray, own: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Query, row and score of what may be among each query's k best with a score not under its floor, and the share of the block's rows that each query has seen.

    All queries read their lists in step, each list from the end that serves the sign of the query's coordinate. A row that is seen is scored in full. When no row that is still
    unseen can reach the kth score so far (or the floor), the query stops: such a row's score is at most the sum over the dimensions of the query's coordinate times the
    value at which its list stands. `own` is the row that is the query itself, left out.
    """
    m, d = lists.x.shape
    seen = np.zeros((len(q), m), dtype=bool)
    scores = np.full((len(q), m), -np.inf, dtype=np.float64)
    live = np.arange(len(q))
    kth = floor.astype(np.float64).copy()
    eps = 2e-6 * np.maximum(np.abs(q.astype(np.float64)).sum(1), 1e-12) * max(1e-12, float(np.abs(lists.x).max(initial=0)))
    read = 0
    for share in DEPTHS:
        depth = min(m, max(k + 1, int(np.ceil(share * m))))
        if depth <= read:
            continue
        new = np.zeros((len(live), m), dtype=bool)
        bound = np.zeros(len(live))
        up = q[live] > 0
        for c in range(d):
            high, low = lists.order[m - depth : m - read, c], lists.order[read:depth, c]
            u = np.flatnonzero(up[:, c])
            w = np.flatnonzero(q[live, c] < 0)
            new[u[:, None], high[None]] = True
            new[w[:, None], low[None]] = True
            bound[u] += q[live[u], c] * lists.sorted[m - depth, c]
            bound[w] += q[live[w], c] * lists.sorted[depth - 1, c]
        # a query of zeros scores all rows alike; it has no list to read
        still = (q[live] == 0).all(1)
        new[still] = True
        bound[still] = -np.inf
        new &= ~seen[live]
        cols = np.flatnonzero(new.any(0))
        if len(cols):
            s = (q[live] @ lists.x[cols].T).astype(np.float64)
            scores[live[:, None], cols[None]] = np.where(new[:, cols], s, scores[live[:, None], cols[None]])
        seen[live] |= new
        if own is not None:
            has = own[live] >= 0
            scores[live[has], own[live[has]]] = -np.inf
        if m > k:
            top = np.partition(scores[live], m - k, axis=1)[:, m - k]
            kth[live] = np.maximum(kth[live], top)
        live = live[bound + eps[live] >= kth[live] - 10.0**-DIGITS]
        read = depth
        if not len(live) or read == m:
            break
    r, c = np.nonzero(scores >= (kth - 2 * eps - 10.0**-DIGITS)[:, None])
    r, c = r[np.isfinite(scores[r, c])], c[np.isfinite(scores[r, c])]
    # candidates are scored again in double precision
    s = np.einsum("ij,ij->i", q[r].astype(np.float64), lists.exact[c]) if len(r) else np.zeros(0)
    return r, c, s, seen.mean(1) if m else np.zeros(len(q))


def _best(r: np.ndarray, ids: np.ndarray, s: np.ndarray, n: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Places of each query's k best by rounded score, then by id; and the kth score of each query."""
    s = np.round(s, DIGITS)
    order = np.lexsort((ids, -s, r))
    first = np.searchsorted(r[order], np.arange(n))
    rank = np.arange(len(order)) - first[r[order]]
    keep = order[rank < k]
    kth = np.full(n, -np.inf)
    last = order[rank == k - 1]
    kth[r[last]] = s[last]
    return keep, kth


def _blocks(dims: int, size: int):
    """Map: rows that follow each other, up to `size` of a cell, as one row (block, ids, data)."""

    def run(batches) -> Iterator[pa.RecordBatch]:
        cell, ids, data = None, [], []

        def out():
            return pa.RecordBatch.from_arrays([pa.array([int(np.array(ids[0]).astype(np.int64))]), pa.array([np.array(ids, dtype=np.int64).tobytes()], pa.binary()), pa.array([b"".join(data)], pa.binary())], names=["block", "ids", "data"])

        for batch in batches:
            for c, i, d in zip(*(batch.column(k).to_pylist() for k in range(3))):
                if ids and (c != cell or len(ids) >= size):
                    yield out()
                    ids, data = [], []
                cell = c
                ids.append(i)
                data.append(d)
        if ids:
            yield out()

    return run


ROW = "query bigint, id bigint, score double"


def _inside(dims: int, k: int, every: int):
    """Map: of each block that holds queries, these with their kth score in the block, and their best there: one row of each kind."""

    def run(batches):
        for batch in batches:
            for ids, data in zip(*(batch.column(c).to_pylist() for c in (1, 2))):
                ids, x = np.frombuffer(ids, dtype=np.int64), unpack([data], dims)
                own = np.flatnonzero(ids % every == 0)
                if not len(own):
                    continue
                r, c, s, _ = threshold_search(x[own], Lists(ids, x), k, np.full(len(own), -np.inf), own)
                keep, kth = _best(r, ids[c], s, len(own), k)
                yield pa.RecordBatch.from_arrays([pa.array(ids[own][r[keep]]), pa.array(ids[c[keep]]), pa.array(np.round(s[keep], DIGITS)), pa.nulls(len(keep), pa.binary()), pa.nulls(len(keep), pa.float64())], names=["query", "id", "score", "data", "kth"])
                none = pa.nulls(len(own), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(ids[own]), none, pa.nulls(len(own), pa.float64()), pa.array([v.tobytes() for v in x[own]], pa.binary()), pa.array(kth)], names=["query", "id", "score", "data", "kth"])

    return run


def _packed(table: pa.Table) -> pa.Table:
    """Of the queries of one group: their ids, vectors and floors as one row."""
    ids = table["query"].to_numpy()
    return pa.table({"qi": pa.array([ids.tobytes()], pa.binary()), "qx": pa.array([b"".join(table["data"].to_pylist())], pa.binary()), "kth": pa.array([table["kth"].to_numpy().astype(np.float64).tobytes()], pa.binary())})


def _across(dims: int, k: int):
    """Map: for a group of queries, what a block has that isn't under their kth score so far. Queries whose floor is over all that the block's extremes allow are left out, a block's lists
    are sorted once for the groups that follow each other, and a query's own block is left out, as it has been searched."""

    def run(batches):
        last, lists = None, None
        for batch in batches:
            for block, ids, data, qi, qx, kth in zip(*(batch.column(c).to_pylist() for c in range(6))):
                qi, q, kth = np.frombuffer(qi, dtype=np.int64), unpack([qx], dims), np.frombuffer(kth)
                if block != last:
                    last, at, x = block, np.frombuffer(ids, dtype=np.int64), unpack([data], dims)
                    high, low, lists = x.max(0).astype(np.float64), x.min(0).astype(np.float64), None
                e = q.astype(np.float64)
                most = np.where(e > 0, e * high, e * low).sum(1)
                go = np.flatnonzero((most + 2e-6 * np.abs(e).sum(1) * np.abs(x).max(initial=0) >= kth - 10.0**-DIGITS) & ~np.isin(qi, at))
                if not len(go):
                    continue
                lists = lists or Lists(at, x)
                r, c, s, _ = threshold_search(q[go], lists, k, kth[go])
                keep, _ = _best(r, at[c], s, len(go), k)
                yield pa.RecordBatch.from_arrays([pa.array(qi[go][r[keep]]), pa.array(at[c[keep]]), pa.array(np.round(s[keep], DIGITS))], names=["query", "id", "score"])

    return run


def search(embeddings: DataFrame, k: int = K, block: int = BLOCK, every: int = EVERY) -> DataFrame:
    """Rows (vec_id, rank, neighbour_id, score): for every embedding whose id is divisible by `every`, the k others of highest inner product among all embeddings; exact.

    Scores are rounded to DIGITS decimals; of equal scores the lower id comes first. Rows are put into blocks of like vectors (one k-means pass), each with a sorted list for
    every dimension. A block answers its own queries first, which gives them a floor; then groups of queries meet the blocks, and the threshold algorithm
    (see `threshold_search`) leaves a query's lists as soon as its bound is under its kth score. A block whose extremes can't reach a query's floor isn't searched for it.

    Null ids, null or non-finite vectors and vectors of another length than most are neither queries nor answers; a table of n rows has n - 1 neighbours at most. Of rows with
    the same vec_id one is taken (the first by its bytes). An empty table gives an empty result; other columns aren't read.
    """
    spark = embeddings.sparkSession
    dims = width(embeddings, "embedding")
    if not dims:
        return spark.createDataFrame([], "vec_id bigint, rank bigint, neighbour_id bigint, score double")
    v = rows(embeddings, "vec_id", "embedding", dims, False)
    v = written(v.groupBy("id").agg(F.min("data").alias("data")), "vectors")
    n = v.count()
    cells = max(1, min(cells_at_most(dims), n // block))
    centres = spark.sparkContext.broadcast(codebook(v, dims, slice(0, dims), cells, 3 if cells > 1 else 0))

    def place(batches):
        for batch in batches:
            x = unpack(batch.column(1).to_pylist(), dims)
            own = nearest(x, centres.value) if len(x) else np.zeros(0)
            yield pa.RecordBatch.from_arrays([pa.array(own.astype(np.int64)), batch.column(0), batch.column(1)], names=["cell", "id", "data"])

    placed = v.mapInArrow(place, "cell bigint, id bigint, data binary")
    placed = placed.repartitionByRange(max(1, min(parts(spark), n // block + 1)), "cell", "id").sortWithinPartitions("cell", "id")
    blocks = written(placed.mapInArrow(_blocks(dims, block), "block bigint, ids binary, data binary"), "blocks")
    inside = written(blocks.mapInArrow(_inside(dims, k, every), f"{ROW}, data binary, kth double"), "inside")
    asked = inside.where("kth is not null")
    groups = max(1, -(-asked.count() // GROUP))
    asked = asked.withColumn("g", F.pmod(F.xxhash64("query"), F.lit(groups))).groupBy("g").applyInArrow(_packed, "qi binary, qx binary, kth binary")
    asked = written(asked, "queries")
    # the stated query set against all rows, in blocks: each block meets each group of queries
    pairs = blocks.repartition(max(1, min(parts(spark), n // block + 1)), "block").crossJoin(small(asked, groups * GROUP)).select("block", "ids", "data", "qi", "qx", "kth")
    found = pairs.mapInArrow(_across(dims, k), ROW).union(inside.where("kth is null").select("query", "id", "score"))
    w = Window.partitionBy("query").orderBy(F.desc("score"), "id")
    best = found.withColumn("rank", F.row_number().over(w).cast("bigint")).where(F.col("rank") <= k)
    return best.select(F.col("query").alias("vec_id"), "rank", F.col("id").alias("neighbour_id"), "score")


SQL = f"""
WITH v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
p AS (SELECT a.vec_id, b.vec_id AS neighbour_id, round(list_inner_product(a.e, b.e), {DIGITS}) AS score FROM v a, v b WHERE a.vec_id % {EVERY} = 0 AND a.vec_id <> b.vec_id)
SELECT vec_id, row_number() OVER (PARTITION BY vec_id ORDER BY score DESC, neighbour_id) AS rank, neighbour_id, score FROM p
QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY score DESC, neighbour_id) <= {K}
"""
