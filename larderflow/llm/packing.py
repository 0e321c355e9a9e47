"""Packing related documents into windows along paths of a nearest-neighbour graph."""

from __future__ import annotations

import heapq
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import components, discard, mix, packed, parts, slices, small, span_hashes, trimmed, unpacked, utf8, word_spans, written
from .jaccard_join import signatures as set_numbers
from .vectors import cells_at_most

#: Tokens (words) of a window.
WINDOW = 2048
#: Buckets that words are hashed to, dimensions of the random projection of bucket weights, and dimensions of a text's vector.
BUCKETS, ROUGH, DIMS = 8192, 128, 16
#: Neighbours of a document in the graph.
NEIGHBOURS = 4
#: The index of vectors: vectors of a cell on average, cells that a vector is compared with, rows that the cells' centres are fitted on at most, and Lloyd's rounds.
CELL, VISITS, SAMPLE, ROUNDS = 2048, 12, 262_144, 5
#: Cells up to which so many visits keep the recall, and visits added for each time that they double beyond.
FEW_CELLS, MORE_VISITS = 128, 6
#: Levels of paths: those of documents, then those of paths.
LEVELS = 2
#: Tokens of a lane, the stretch whose windows are filled one after the other, on average; documents with the same words of which one lane takes so many.
LANE, COPIES = 4_000_000, 1000

_U = np.uint64
_signs: list[np.ndarray] = []


def word_weights(b: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of texts as bytes: words of each, a number for each one's words whatever their order, and text, bucket and count of each bucket of its words."""
    start, end, doc = word_spans(b, offsets)
    h = span_hashes(b, start, end)
    n = np.bincount(doc, minlength=len(offsets) - 1)
    node = set_numbers(h, np.concatenate([[0], np.cumsum(n)]))
    key, count = np.unique(doc * BUCKETS + (h % _U(BUCKETS)).astype(np.int64), return_counts=True)
    return n, node, key // BUCKETS, key % BUCKETS, count


def texts(docs: DataFrame) -> DataFrame:
    """Rows (doc_id, lang, source, n, node): words, and a number for them whatever their order (null for a text without words); and rows (bucket, df): texts of a task with a word of that bucket."""

    def run(batches):
        df = np.zeros(BUCKETS, dtype=np.int64)
        for batch in batches:
            b, offsets = utf8(pc.utf8_lower(batch.column(1).cast(pa.large_string())))
            n, node = np.zeros(batch.num_rows, dtype=np.int64), np.zeros(batch.num_rows, dtype=np.int64)
            for i, j in slices(offsets, 1_500_000):
                n[i:j], node[i:j], _, bucket, _ = word_weights(b[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
                df += np.bincount(bucket, minlength=BUCKETS)
            gone = pa.nulls(batch.num_rows, pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), batch.column(2), batch.column(3), pa.array(n), pa.array(node, mask=n == 0), gone, gone], names=names)
        has = np.flatnonzero(df)
        gone = pa.nulls(len(has), pa.int64())
        none = pa.nulls(len(has), pa.string())
        yield pa.RecordBatch.from_arrays([gone, none, none, gone, gone, pa.array(has), pa.array(df[has])], names=names)

    names = ["doc_id", "lang", "source", "n", "node", "bucket", "df"]
    source = F.col("source") if "source" in docs.columns else F.lit(None)
    return docs.select("doc_id", "text", "lang", source.cast("string").alias("source")).mapInArrow(trimmed(run), "doc_id bigint, lang string, source string, n bigint, node bigint, bucket bigint, df bigint")


def signs() -> np.ndarray:
    """The random projection: a fixed sign for each bucket and dimension."""
    if not _signs:
        _signs.append(np.where(mix(np.arange(1, BUCKETS * ROUGH + 1, dtype=_U)) >> _U(63), np.float32(1), np.float32(-1)).reshape(BUCKETS, ROUGH))
    return _signs[0]


def rough_vectors(doc: np.ndarray, bucket: np.ndarray, count: np.ndarray, n: int, idf: np.ndarray) -> np.ndarray:
    """Unit vectors of ROUGH dimensions: projected sums of bucket weights log(1 + count) idf of each of n texts (ascending); zero for a text without any."""
    out = np.zeros((n, ROUGH), dtype=np.float32)
    weight = np.log1p(count).astype(np.float32) * idf[bucket]
    head = np.flatnonzero(np.diff(doc, prepend=-1))
    # text by text: the rows of one text's buckets stay in the cache, where those of many would be written to memory and read again
    for k, i, j in zip(doc[head].tolist(), head.tolist(), [*head[1:].tolist(), len(doc)]):
        np.dot(weight[i:j], signs().take(bucket[i:j], axis=0), out=out[k])
    length = np.linalg.norm(out, axis=1, keepdims=True)
    return np.divide(out, length, out=out, where=length > 0)


def _rough(docs: DataFrame, idf) -> DataFrame:
    """Rows (node, v): rough vectors as 16-bit floats, once for each node of a batch."""

    def run(batches):
        for batch in batches:
            b, offsets = utf8(pc.utf8_lower(batch.column(0).cast(pa.large_string())))
            for i, j in slices(offsets, 1_500_000):
                n, node, *weights = word_weights(b[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
                x = rough_vectors(*weights, j - i, idf.value)
                first = np.unique(np.where(n > 0, node, 0), return_index=True)[1]
                first = first[n[first] > 0]
                yield pa.RecordBatch.from_arrays([pa.array(node[first]), pa.array([v.tobytes() for v in x[first].astype(np.float16)], pa.binary())], names=["node", "v"])

    return docs.select("text").where("text is not null").mapInArrow(trimmed(run), "node bigint, v binary")


def basis(rough: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Mean and the DIMS principal directions of all rough vectors. Tasks send sums of products, which Spark adds up entry by entry."""
    size = ROUGH + 1

    def run(batches):
        total = np.zeros((size, size))
        for batch in batches:
            x = np.frombuffer(b"".join(batch.column(0).to_pylist()), dtype=np.float16).reshape(-1, ROUGH).astype(np.float64)
            x = np.concatenate([x, np.ones((len(x), 1))], axis=1)
            total += x.T @ x
        at = np.flatnonzero(np.triu(np.ones((size, size))))
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total.reshape(-1)[at])], names=["at", "x"])

    got = rough.select("v").mapInArrow(run, "at bigint, x double").groupBy("at").agg(F.sum("x").alias("x")).toPandas()
    total = np.zeros(size * size)
    total[got["at"].to_numpy()] = got["x"].to_numpy()
    total = total.reshape(size, size)
    total = np.triu(total) + np.triu(total, 1).T
    n = max(total[-1, -1], 1)
    mean = total[-1, :-1] / n
    directions = np.linalg.eigh(np.round(total[:-1, :-1] / n - np.outer(mean, mean), 9))[1][:, ::-1][:, :DIMS]
    directions = directions * np.sign(directions[np.abs(directions).argmax(0), np.arange(DIMS)])
    return mean, directions


def _project(mean: np.ndarray, directions: np.ndarray):
    def run(batches):
        for batch in batches:
            x = np.frombuffer(b"".join(batch.column(1).to_pylist()), dtype=np.float16).reshape(-1, ROUGH)
            y = (x.astype(np.float64) - mean) @ directions
            length = np.linalg.norm(y, axis=1)
            ok = length > 1e-6
            y = (y[ok] / length[ok, None]).astype(np.float16)
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(pa.array(ok)), pa.array([v.tobytes() for v in y], pa.binary())], names=["node", "v"])

    return run


def vectors(docs: DataFrame, df: DataFrame, n: int) -> DataFrame:
    """Rows (node, v): a unit vector of DIMS 16-bit floats for each distinct bag of words. It is a latent semantic projection: words hashed to buckets, weighted by log(1 + count) and
    log((n + 1) / (df + 1)) over all n texts, projected at random and then on the principal directions of all texts."""
    got = df.groupBy("bucket").agg(F.sum("df").alias("df")).toPandas()
    idf = np.full(BUCKETS, np.log(n + 1), dtype=np.float32)
    idf[got["bucket"].to_numpy(dtype=np.int64)] = np.log((n + 1) / (got["df"].to_numpy(dtype=np.float64) + 1))
    rough = written(_rough(docs, docs.sparkSession.sparkContext.broadcast(np.maximum(idf, 1e-3))).groupBy("node").agg(F.min("v").alias("v")), "rough")
    out = written(rough.mapInArrow(_project(*basis(rough)), "node bigint, v binary"), "vectors")
    discard(rough)
    return out


def unit(v: np.ndarray) -> np.ndarray:
    """Rows at unit length again, which 16-bit floats have lost."""
    x = v.reshape(-1, DIMS).astype(np.float32)
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), np.float32(1e-9))


def matrix(blobs) -> np.ndarray:
    return unit(np.frombuffer(b"".join(blobs), dtype=np.float16))


def closeness(node: np.ndarray, x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """How near each row is to each centre (half the squared length of the row less half the squared distance). Centres that are equally near are told apart by chance of the row, so that
    a crowd of like rows is shared among the centres that stand in it."""
    chance = ((mix(node.astype(_U)) >> _U(40)).astype(np.float32)[:, None] * (np.arange(1, len(centres) + 1, dtype=np.float32) * np.float32(0.618034))[None]) % 1
    return x @ centres.T - (centres**2).sum(1) / 2 + np.float32(1e-3) * chance


def centres_of(vecs: DataFrame, cells: int, sample: int, rounds: int) -> np.ndarray:
    """Centres by Lloyd's rounds over a sample: the rows of lowest hash, 64 a cell and `sample` at most (a cell at least)."""
    if cells < 2:
        return np.zeros((1, DIMS), dtype=np.float32)
    got = vecs.orderBy(F.xxhash64("node"), "node").limit(max(cells, min(sample, 64 * cells))).toPandas()
    node, x = got["node"].to_numpy(dtype=np.int64), matrix(got["v"])
    centres = x[:cells].copy()
    for _ in range(rounds):
        own = np.concatenate([closeness(node[i : i + 4096], x[i : i + 4096], centres).argmax(1) for i in range(0, len(x), 4096)])
        n = np.bincount(own, minlength=len(centres))
        total = np.zeros(centres.shape)
        np.add.at(total, own, x)
        centres = np.where(n[:, None] > 0, total / np.maximum(n, 1)[:, None], centres).astype(np.float32)
    return centres


def _at_home(neighbours: int):
    """Of one cell: each vector's best neighbours in it as (a, b, sim), and the vector again with the least similarity (floor) that a better neighbour elsewhere must have."""

    def run(table: pa.Table) -> pa.Table:
        node, data = table["node"].to_numpy(), table["v"].to_pylist()
        order = np.argsort(node)
        node, data = node[order], [data[i] for i in order]
        x = matrix(data)
        m, r = len(x), min(neighbours, len(x) - 1)
        random = np.random.default_rng(int(node[0]) & 0xFFFFFFFF)
        A, B, S, floor = [], [], [], np.full(m, -2.0)
        for i in range(0, m if r else 0, step := max(1, 4_000_000 // m)):
            # equal similarities are told apart by chance, so that no node is everyone's neighbour
            s = x[i : i + step] @ x.T + random.random((min(step, m - i), m), dtype=np.float32) * np.float32(1e-6)
            s[np.arange(len(s)), i + np.arange(len(s))] = -3
            best = np.argpartition(-s, r - 1, axis=1)[:, :r]
            sim = np.take_along_axis(s, best, 1)
            A.append(np.repeat(node[i : i + step], r))
            B.append(node[best].reshape(-1))
            S.append(sim.reshape(-1))
            if r == neighbours:
                floor[i : i + step] = sim.min(1)
        cat = lambda z, t: np.concatenate(z).astype(t) if z else np.zeros(0, t)
        a = cat(A, np.int64)
        gone, none = pa.nulls(m, pa.int64()), pa.nulls(len(a), pa.binary())
        cell = pa.array(np.full(m + len(a), table["cell"][0].as_py()), pa.int32())
        return pa.table({"cell": cell, "a": pa.array(np.concatenate([a, node])), "b": pa.concat_arrays([pa.array(cat(B, np.int64)), gone]), "sim": pa.array(np.concatenate([cat(S, np.float64), floor])), "v": pa.concat_arrays([none, pa.array(data, pa.binary())])})

    return trimmed(run)


def _visits(centres, visits: int):
    """Map: vectors by cell, packed: to their own (home) and, as queries, to the nearest others that a better neighbour can be in: those whose border isn't farther than the neighbours known."""

    def blobs(cell, node, x, floor, home):
        order = np.argsort(cell, kind="stable")
        cell = cell[order]
        start = np.flatnonzero(np.diff(cell, prepend=-1))
        data = [packed(node[k], x[k].view(np.uint16).reshape(-1), floor[k], home[k]) for k in np.split(order, start[1:])] if len(order) else []
        return pa.RecordBatch.from_arrays([pa.array(cell[start], pa.int32()), pa.array(data, pa.binary())], names=["cell", "data"])

    def run(batches):
        c = centres.value
        held, rows = [], 0
        for batch in batches:
            own, node, floor = (batch.column(k).to_numpy() for k in (0, 1, 2))
            y = np.frombuffer(b"".join(batch.column(3).to_pylist()), dtype=np.float16).reshape(-1, DIMS)
            for i in range(0, len(node), step := max(1, 2_000_000 // len(c))):
                k = slice(i, i + step)
                x, o = unit(y[k]), own[k].astype(np.int64)
                held.append((o, node[k], y[k], floor[k].astype(np.float32), np.ones(len(o), np.uint8)))
                if len(c) > 1:
                    near = closeness(node[k], x, c)
                    mine = near[np.arange(len(o)), o]
                    near[np.arange(len(o)), o] = -np.inf
                    r = min(visits - 1, len(c) - 1)
                    best = np.argpartition(-near, r - 1, axis=1)[:, :r]
                    # distance to the plane between the two centres, against that of the last neighbour known
                    gap = np.linalg.norm(c[best] - c[o][:, None], axis=2)
                    border = (mine[:, None] - np.take_along_axis(near, best, 1) - 2e-3) / np.maximum(gap, 1e-9)
                    row, col = np.nonzero(border <= np.sqrt(np.maximum(2 - 2 * floor[k], 0))[:, None] + 1e-3)
                    held.append((best[row, col], node[k][row], y[k][row], floor[k][row].astype(np.float32), np.zeros(len(row), np.uint8)))
            rows += len(node)
            if rows > 30_000:
                yield blobs(*(np.concatenate(z) for z in zip(*held)))
                held, rows = [], 0
        if held:
            yield blobs(*(np.concatenate(z) for z in zip(*held)))

    return trimmed(run)


def _meet(neighbours: int):
    """Of one cell: for each visitor, its best neighbours there that are over its floor."""

    def run(table: pa.Table) -> pa.Table:
        N, V, L, H = [], [], [], []
        for data in table["data"]:
            node, v, floor, home = unpacked(data.as_py(), np.int64, np.float16, np.float32, np.uint8)
            N.append(node)
            V.append(unit(v))
            L.append(floor)
            H.append(home)
        node, v, floor, home = np.concatenate(N), np.concatenate(V), np.concatenate(L), np.concatenate(H) > 0
        ids, x = node[home], v[home]
        q, y, floor = node[~home], v[~home], floor[~home]
        A, B, S = [], [], []
        for i in range(0, len(q) if len(ids) else 0, step := max(1, 2_000_000 // max(len(ids), 1))):
            s = y[i : i + step] @ x.T
            row, col = np.nonzero(s > floor[i : i + step, None])
            s = s[row, col]
            order = np.lexsort((ids[col], -s, row))
            row, col, s = row[order], col[order], s[order]
            rank = np.arange(len(row)) - np.searchsorted(row, row)
            k = rank < neighbours
            A.append(q[i + row[k]])
            B.append(ids[col[k]])
            S.append(s[k])
        cat = lambda z, t: np.concatenate(z).astype(t) if z else np.zeros(0, t)
        return pa.table({"a": cat(A, np.int64), "b": cat(B, np.int64), "sim": cat(S, np.float64)})

    return trimmed(run)


def nearest(vecs: DataFrame, n: int, neighbours: int = NEIGHBOURS, cell: int = CELL, visits: int = VISITS, sample: int = SAMPLE) -> DataFrame:
    """Rows (a, b, sim, r) of the nearest-neighbour graph of n written vectors by cosine: r is 1 for a's nearest.

    An inverted file: every vector lies in the cell of its nearest centre (fitted on a bounded sample, see `centres_of`) and is compared with all of its own cell, then with all of
    the nearest cells, as far as a better neighbour can be there: `visits` in all, and MORE_VISITS for each doubling of the cells beyond FEW_CELLS. So work by vector grows with the
    logarithm of the table until the centres, which go to all tasks, are as many as may (`cells_at_most`). Recall against brute force is tested to be 0.9 at least.
    """
    spark = vecs.sparkSession
    cells = max(1, min(cells_at_most(DIMS), n // cell))
    visits += int(MORE_VISITS * max(0.0, np.log2(cells / FEW_CELLS)))
    centres = spark.sparkContext.broadcast(centres_of(vecs, cells, sample, ROUNDS))

    def place(batches):
        c = centres.value
        for batch in batches:
            node, x = batch.column(0).to_numpy(), matrix(batch.column(1).to_pylist())
            step = max(1, 2_000_000 // len(c))
            own = np.concatenate([np.zeros(0), *(closeness(node[i : i + step], x[i : i + step], c).argmax(1) for i in range(0, len(x), step))])
            yield pa.RecordBatch.from_arrays([pa.array(own.astype(np.int32)), batch.column(0), batch.column(1)], names=["cell", "node", "v"])

    home = vecs.mapInArrow(trimmed(place), "cell int, node bigint, v binary").groupBy("cell").applyInArrow(_at_home(neighbours), "cell int, a bigint, b bigint, sim double, v binary")
    home = written(home, "home")
    found = home.where("v is null").select("a", "b", "sim")
    if cells > 1:
        sent = home.where("v is not null").select("cell", "a", "sim", "v").mapInArrow(_visits(centres, visits), "cell int, data binary")
        found = found.union(sent.groupBy("cell").applyInArrow(_meet(neighbours), "a bigint, b bigint, sim double"))
    w = Window.partitionBy("a").orderBy(F.desc("sim"), F.xxhash64(F.least("a", "b"), F.greatest("a", "b")))
    out = written(found.withColumn("r", F.row_number().over(w)).where(F.col("r") <= neighbours), "nearest")
    discard(home)
    return out


def walk(edges: list[tuple[int, int, float]]) -> list[list[int]]:
    """Paths that cover the nodes of an undirected graph of (a, b, common): each begins at the unvisited node of lowest degree and goes on to the unvisited neighbour
    with most in common; ties go to the lower node. A degree counts unvisited neighbours."""
    near: dict[int, dict[int, int]] = {}
    for a, b, c in edges:
        near.setdefault(a, {})[b] = c
        near.setdefault(b, {})[a] = c
    degree = {x: len(y) for x, y in near.items()}
    heap = [(d, x) for x, d in degree.items()]
    heapq.heapify(heap)
    done: set[int] = set()
    paths = []

    def visit(x: int) -> None:
        done.add(x)
        for y in near[x]:
            if y not in done:
                degree[y] -= 1
                heapq.heappush(heap, (degree[y], y))

    while heap:
        d, x = heapq.heappop(heap)
        if x in done or d != degree[x]:
            continue
        path = [x]
        visit(x)
        while free := [(-c, y) for y, c in near[path[-1]].items() if y not in done]:
            path.append(min(free)[1])
            visit(path[-1])
        paths.append(path)
    return paths


def _paths(table: pa.Table) -> pa.Table:
    by: dict[int, list[tuple[int, int, float]]] = {}
    for root, a, b, c in zip(*(table[x].to_pylist() for x in ("root", "a", "b", "common"))):
        by.setdefault(root, []).append((a, b, c))
    rows = [(path[0], x, k) for edges in by.values() for path in walk(sorted(edges)) for k, x in enumerate(path)]
    cols = list(zip(*rows)) or [()] * 3
    return pa.table({n: pa.array(c, t) for n, c, t in zip(("path", "at", "step"), cols, (pa.int64(), pa.int64(), pa.int32()))})


def paths(edges: DataFrame, levels: int = LEVELS) -> DataFrame:
    """Rows (at, path, s1, ..., s<levels>) that put the nodes of a written undirected graph (a, b, common) into paths; nodes without an edge aren't in it.

    The trees that each node's best edge forms are the cells of a level; in a cell, paths are walked along all its edges (see `walk`). The edges that lead out of a path aren't lost: at the next
    level, paths are the nodes, linked by the best edge between them, and paths of paths are walked in the same way. s<k> is the place of a node's path of level k - 1 in its path of level k.
    """
    shards = parts(edges.sparkSession)
    out, hash_ = None, F.xxhash64(F.least("a", "b"), F.greatest("a", "b"))
    for k in range(1, levels + 1):
        both = edges.select("a", "b", "common").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"), "common"))
        best = both.groupBy("a").agg(F.max(F.struct("common", hash_.alias("h"), "b")).alias("m")).select("a", F.col("m.b").alias("b"))
        cells = components(best, "cells")
        cells = small(written(cells.union(cells.select("root", "root")).distinct(), "cells"))
        other = cells.select(F.col("node").alias("node2"), F.col("root").alias("root2"))
        inner = edges.join(cells, edges["a"] == cells["node"]).join(other, F.col("b") == F.col("node2")).where("root = root2").select("root", "a", "b", "common")
        inner = inner.withColumn("task", F.pmod(F.xxhash64("root"), F.lit(shards * 4)))
        step = written(inner.groupBy("task").applyInArrow(_paths, "path bigint, at bigint, step int"), "paths")
        if out is None:
            out = step.withColumnRenamed("step", "s1")
        else:
            up = small(step.select(F.col("path").alias("up"), F.col("at").alias("_at"), "step"))
            out = out.join(up, out["path"] == up["_at"], "left").withColumn("path", F.coalesce("up", "path")).withColumn(f"s{k}", F.coalesce("step", F.lit(0))).drop("up", "_at", "step")
        if k < levels:
            of = small(step.select("path", F.col("at").alias("_at")))
            to = of.select(F.col("path").alias("path2"), F.col("_at").alias("_at2"))
            lead = edges.join(of, edges["a"] == of["_at"]).join(to, F.col("b") == F.col("_at2")).where("path <> path2")
            edges = written(lead.groupBy(F.least("path", "path2").alias("a"), F.greatest("path", "path2").alias("b")).agg(F.max("common").alias("common")), "leads")
    return out


def pack(docs: DataFrame, window: int = WINDOW, neighbours: int = NEIGHBOURS, lane: int = LANE, cell: int = CELL, copies: int = COPIES, mixed: Callable[..., DataFrame] | None = None) -> DataFrame:
    """Rows (window_id, pos, doc_id, doc_from, n_tokens): n_tokens words of the document from its word doc_from on stand at `pos` of the window.

    Documents are nodes by their words (those with the same words stand together) and linked to the neighbours of highest cosine of their vectors (see `vectors` and `nearest`). Paths are
    walked greedily in the graph, and paths of paths (see `paths`); a path's documents, by language and number of the path, go into lanes of about `lane` tokens, and each lane's documents fill
    windows of `window` tokens without a gap; only a lane's last window may be short. Every word of every document is in one window; a document that crosses a window's end goes on in
    the next. Documents with the same words, if over `copies`, are spread over as many lanes as keep to that number.

    With `mixed`, a function like `mixing.mix`, each source's part of a path is put into the mixture as a whole, and lanes stand in the order of its slots, so windows by number follow the
    schedule document by document.

    Null and empty texts have no words and no rows. A very long text is one node and goes on through as many windows as it takes. Null doc_ids, repeated rows and rows of one doc_id with other
    texts are packed like any other. Ties in similarity are told apart by hashes. An empty table gives an empty result; columns other than doc_id, text and lang (with `mixed` source) aren't read.
    """
    every = written(texts(docs), "texts")
    d = every.where("n > 0").select("doc_id", "lang", "source", "n", "node")
    total, rows = d.agg(F.sum("n"), F.count(F.lit(1))).first()
    vecs = vectors(docs, every.where("bucket is not null"), rows)
    graph = nearest(vecs, vecs.count(), neighbours, cell)
    edges = written(graph.groupBy(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).agg(F.max("sim").alias("common")), "edges")
    p = written(paths(edges), "places")
    steps = [c for c in reversed(p.columns) if c not in ("at", "path")]
    lanes = max(1, (total or 0) // lane)
    p = small(p)
    d = d.join(p, d["node"] == p["at"], "left").withColumn("path", F.coalesce("path", "node"))
    crowd = small(written(d.groupBy(F.col("node").alias("_node")).agg(F.count(F.lit(1)).alias("_c")).where(F.col("_c") > copies), "crowds"))
    d = d.join(crowd, d["node"] == crowd["_node"], "left").withColumn("part", F.coalesce(F.pmod(F.xxhash64("doc_id"), F.expr(f"_c div {copies} + 1")), F.lit(0)))
    unit = ["path", "part"] + (["source"] if mixed else [])
    d = d.withColumn("lane", F.pmod(F.xxhash64(*unit), F.lit(lanes))).drop("at", "_node", "_c")
    if mixed:
        d = mixed(d, together=unit, order=[*steps, "node", "n"])
        order = [F.col("slot"), F.col("pos")]
    else:
        d = d.withColumn("tongue", F.min("lang").over(Window.partitionBy(*unit)))
        order = [F.col("tongue").asc_nulls_first(), F.col("path"), *map(F.col, steps), F.col("node")]
    w = Window.partitionBy("lane").orderBy(*order, F.col("doc_id").asc_nulls_first(), "n")
    d = d.withColumn("start", F.sum("n").over(w.rowsBetween(Window.unboundedPreceding, 0)) - F.col("n"))
    d = d.withColumn("k", F.explode(F.sequence(F.expr(f"start div {window}"), F.expr(f"(start + n - 1) div {window}"))))
    begin = F.greatest(F.col("start"), F.col("k") * window)
    stop = F.least(F.col("start") + F.col("n"), (F.col("k") + 1) * window)
    return d.select((F.col("k") * lanes + F.col("lane")).alias("window_id"), (begin - F.col("k") * window).alias("pos"), "doc_id", (begin - F.col("start")).alias("doc_from"), (stop - begin).alias("n_tokens"))
