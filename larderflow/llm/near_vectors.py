"""Near-duplicate embeddings by an inverted multi-index."""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import components, small, written
from .vectors import cells_at_most, codebook, rows, unpack, width

#: Least cosine of near duplicates; recall aimed at; vectors of a cell on average; Lloyd's rounds.
THRESHOLD, RECALL, PER_CELL, ROUNDS = 0.95, 0.99, 16, 5
#: Bytes of vectors that meet in a task, about.
GROUP_BYTES = 64_000_000


def reach(t: float, recall: float, dims: int) -> float:
    """How far, as a sum of squares over both halves, the traversal goes beyond a vector's own cell.

    A near duplicate is at most r = sqrt(2 - 2 t) away. It lies in another cell only if its displacement crosses the planes between the cells' centres, whose squared distances
    from the vector are the costs that are summed. A displacement of random direction has a share q or less of its square along two given directions with
    probability 1 - (1 - q)^(dims / 2 - 1); q is chosen for the recall (q = 1, at recall 1, is exact).
    """
    q = 1.0 if recall >= 1 or dims <= 2 else 1 - (1 - recall) ** (1 / (dims / 2 - 1))
    return (2 - 2 * t) * q


def costs(x: np.ndarray, centres: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Centres of each row by rising cost, and the costs: squared distance to the plane between its nearest centre and the other; 0 for the nearest."""
    d = np.maximum(((x[:, None] - centres[None]) ** 2).sum(2), 0) if len(x) * centres.size < 5e7 else np.maximum((x**2).sum(1)[:, None] + (centres**2).sum(1)[None] - 2 * x @ centres.T, 0)
    own = d.argmin(1)
    gap = ((centres[own][:, None] - centres[None]) ** 2).sum(2)
    h = (d - d[np.arange(len(x)), own][:, None]) ** 2 / np.maximum(4 * gap, 1e-30)
    h[np.arange(len(x)), own] = 0
    order = np.argsort(h, axis=1, kind="stable")
    return order, np.take_along_axis(h, order, 1)


def traverse(a: np.ndarray, b: np.ndarray, limit: float) -> list[tuple[int, int]]:
    """The multi-sequence algorithm: cells (i, j) of two sorted cost lists by rising a[i] + b[j], until the sum is over the limit."""
    out: list[tuple[int, int]] = []
    heap = [(float(a[0] + b[0]), 0, 0)]
    seen = {(0, 0)}
    while heap:
        c, i, j = heapq.heappop(heap)
        if c > limit:
            break
        out.append((i, j))
        for p, q in ((i + 1, j), (i, j + 1)):
            if p < len(a) and q < len(b) and (p, q) not in seen:
                seen.add((p, q))
                heapq.heappush(heap, (float(a[p] + b[q]), p, q))
    return out


def _visits(dims: int, books, limit: float, split: int):
    """Map: each vector once for every group of cells that it visits (those of one centre of the first book, in `split` parts), with these cells and its own one (home) if it is among them."""

    def run(batches):
        for batch in batches:
            data = batch.column(1).to_pylist()
            node = batch.column(0).to_pylist()
            c1, c2 = books.value
            for s in range(0, len(data), 500):
                x = unpack(data[s : s + 500], dims)
                h = dims // 2
                (o1, h1), (o2, h2) = costs(x[:, :h], c1), costs(x[:, h:], c2)
                group, cells, home, who = [], [], [], []
                for r in range(len(x)):
                    own = int(o1[r, 0]) * len(c2) + int(o2[r, 0])
                    by: dict[int, list[int]] = {}
                    for i, j in traverse(h1[r], h2[r], limit):
                        p, q = int(o1[r, i]), int(o2[r, j])
                        by.setdefault(p * split + q % split, []).append(p * len(c2) + q)
                    for g, c in by.items():
                        group.append(g)
                        cells.append(np.array(c, dtype=np.int64).tobytes())
                        home.append(own if own in c else -1)
                        who.append(s + r)
                yield pa.RecordBatch.from_arrays([pa.array(group, pa.int64()), pa.array(cells, pa.binary()), pa.array(home, pa.int64()), pa.array([node[w] for w in who], pa.int64()), pa.array([data[w] for w in who], pa.binary())], names=["task", "cells", "home", "node", "data"])

    return run


def _verify(dims: int, t: float):
    """Of a group of cells: pairs of a vector at home and another in its cell with cosine t at least, as many as join what belongs together; and for each vector at home
    the number (links, b null) of others there with that cosine."""

    def run(table: pa.Table) -> pa.Table:
        cells = [np.frombuffer(c, dtype=np.int64) for c in table["cells"].to_pylist()]
        who = np.repeat(np.arange(len(cells)), [len(c) for c in cells])
        cell, node = np.concatenate(cells), table["node"].to_numpy()
        home = cell == table["home"].to_numpy()[who]
        every = unpack(table["data"].to_pylist(), dims)
        order = np.lexsort((node[who], ~home, cell))
        cell, home, who = cell[order], home[order], who[order]
        start = np.flatnonzero(np.diff(cell, prepend=cell[:1] - 1))
        A, B, C, L = [], [], [], []
        for s, e in zip(start.tolist(), np.append(start[1:], len(cell)).tolist()):
            m = int(home[s:e].sum())
            if not m or e - s < 2:
                continue
            x, own = every[who[s:e]], node[who[s:e]]
            group = np.arange(e - s)
            step = max(1, 4_000_000 // (e - s))
            for i in range(0, m, step):
                near = x[i : min(i + step, m)] @ x.T >= t - 1e-6
                for k in np.flatnonzero(near.sum(1) > 1):
                    hit = np.flatnonzero(near[k])
                    # the float64 check decides at the edge
                    exact = x[hit].astype(np.float64) @ x[i + k].astype(np.float64) >= t
                    hit = hit[exact]
                    if len(hit) > 1:
                        C.append(own[i + k])
                        L.append(len(hit) - 1)
                    labels, first = np.unique(group[hit], return_index=True)
                    me = group[i + k]
                    if len(labels) > 1 or (len(labels) == 1 and labels[0] != me):
                        for q in hit[first].tolist():
                            if group[q] != me:
                                A.append(own[i + k])
                                B.append(own[q])
                        group[np.isin(group, np.append(labels, me))] = min(int(labels[0]), int(me))
        return pa.table({"a": pa.array(A + C, pa.int64()), "b": pa.array(B + [None] * len(C), pa.int64()), "links": pa.array([None] * len(A) + L, pa.int64())})

    return run


def groups(embeddings: DataFrame, t: float = THRESHOLD, recall: float = RECALL, per_cell: int = PER_CELL, rounds: int = ROUNDS) -> DataFrame:
    """Rows (vec_id, group_id, size, links) for each embedding in a group of near duplicates; group_id is the group's lowest vec_id. Groups are the connected
    components of pairs with cosine t at least; links is the number of other vectors, equal ones counted once, that have that cosine with it.

    Each half of the dimensions has its own codebook, trained on all rows; their product is a grid with about `per_cell` vectors a cell. Every vector is put into its cell and
    as a query visits further cells by the multi-sequence algorithm, as far as the target recall asks (see `reach`); what meets is verified by its cosine. Equal
    vectors are one vector until the end, and in a cell only so many pairs are kept as join its groups; a vector's links are counted in its own cell, which all that may be near it visit.

    Null ids, null, zero or non-finite vectors, and vectors of another length than most, are in no group. Rows of one vec_id are one (each of their vectors counts, and links are added up). An
    empty table gives an empty result; columns other than vec_id and embedding aren't read. Vectors need two dimensions at least.
    """
    spark = embeddings.sparkSession
    dims = width(embeddings, "embedding")
    if dims < 2:
        return spark.createDataFrame([], "vec_id bigint, group_id bigint, size bigint, links bigint")
    v = written(rows(embeddings, "vec_id", "embedding", dims, True).withColumn("node", F.xxhash64("data")), "vectors")
    distinct = v.groupBy("node").agg(F.first("data").alias("data")).select(F.col("node").alias("id"), "data")
    distinct = written(distinct, "distinct")
    n = distinct.count()
    if not n:
        return spark.createDataFrame([], "vec_id bigint, group_id bigint, size bigint, links bigint")
    k = max(1, min(cells_at_most(dims), int((n / per_cell) ** 0.5)))
    books = tuple(codebook(distinct, dims, p, k, rounds) for p in (slice(0, dims // 2), slice(dims // 2, dims)))
    # so many parts that a group's vectors, with visitors from some neighbouring centres, keep to GROUP_BYTES
    split = max(1, -(-n * 4 * dims * 9 // (k * GROUP_BYTES)))
    visits = distinct.mapInArrow(_visits(dims, spark.sparkContext.broadcast(books), reach(t, recall, dims), split), "task bigint, cells binary, home bigint, node bigint, data binary")
    found = written(visits.groupBy("task").applyInArrow(_verify(dims, t), "a bigint, b bigint, links bigint"), "found")
    root = components(found.where("b is not null"), "near")
    links = found.where("b is null").select(F.col("a").alias("_node"), F.col("links"))
    s = v.select("id", "node").distinct().join(small(root), v["node"] == root["node"], "left")
    s = s.select("id", v["node"], F.coalesce(root["root"], v["node"]).alias("root"))
    s = s.join(small(links), s["node"] == links["_node"], "left").select(F.col("id").alias("vec_id"), "root", F.coalesce("links", F.lit(0)).alias("links"))
    s = written(s, "linked")
    tied = s.groupBy("vec_id").agg(F.min("root").alias("m"), F.count(F.lit(1)).alias("c")).where("c > 1")
    if not tied.isEmpty():
        again = components(tied.join(s, "vec_id").select(F.col("root").alias("a"), F.col("m").alias("b")), "tied")
        s = s.join(small(again), s["root"] == again["node"], "left").select("vec_id", F.coalesce(again["root"], s["root"]).alias("root"), "links")
        s = s.groupBy("vec_id").agg(F.min("root").alias("root"), F.sum("links").alias("links"))
    g = s.groupBy("root").agg(F.min("vec_id").alias("group_id"), F.count(F.lit(1)).alias("size")).where("size > 1")
    return s.join(g, "root").select("vec_id", "group_id", "size", "links")


def with_copies(embeddings: DataFrame) -> DataFrame:
    """The embeddings and a near copy of each, its coordinates stretched by turns, under vec_id + 10^9: a table with pairs to find."""
    near = F.transform("embedding", lambda v, i: (v.cast("double") * (1 + (i % 3) * 0.1)).cast("float"))
    return embeddings.select("vec_id", "embedding").union(embeddings.select((F.col("vec_id") + 10**9).alias("vec_id"), near))


def _sql(table: str) -> str:
    """All pairs by brute force, then components."""
    return f"""
WITH RECURSIVE v AS ({table}),
p AS (SELECT a.vec_id AS a, b.vec_id AS b, a.e AS x, b.e AS y FROM v a, v b WHERE a.vec_id <> b.vec_id AND list_cosine_similarity(a.e, b.e) >= {THRESHOLD}),
r AS (SELECT DISTINCT a, a AS b FROM p UNION SELECT r.a, p.b FROM r JOIN p ON r.b = p.a),
g AS (SELECT a AS vec_id, min(b) AS group_id FROM r GROUP BY a),
l AS (SELECT a AS vec_id, count(DISTINCT y) FILTER (x <> y) AS links FROM p GROUP BY a)
SELECT vec_id, group_id, count(*) OVER (PARTITION BY group_id) AS size, links FROM g JOIN l USING (vec_id)
"""


SQL = _sql("SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings")
#: Of `with_copies`.
COPIES_SQL = _sql("""SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings UNION ALL
 SELECT vec_id + 1000000000, CAST(list_transform(range(1, len(embedding) + 1), lambda i: CAST(CAST(embedding[i] AS DOUBLE) * (1 + ((i - 1) % 3) * 0.1::DOUBLE) AS FLOAT)) AS DOUBLE[]) FROM embeddings""")
