"""Vectors as matrices, and codebooks by Lloyd's algorithm over all rows."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


#: Bytes of a codebook, which goes to all tasks; with more vectors than that serves, cells hold more.
BOOK_BYTES = 64_000_000


def cells_at_most(dims: int) -> int:
    return max(1, BOOK_BYTES // (4 * dims))


def width(df: DataFrame, column: str) -> int:
    """The most frequent length of the vectors (the greater of a tie); 0 if there are none."""
    r = df.where(F.col(column).isNotNull()).groupBy(F.size(column).alias("n")).count().orderBy(F.desc("count"), F.desc("n")).first()
    return r["n"] if r else 0


def rows(df: DataFrame, ident: str, column: str, dims: int, unit: bool) -> DataFrame:
    """Rows (id, data) of the vectors of that length without nulls, NaN or infinities, as 32-bit floats; with `unit` scaled to length 1, zero vectors left out."""

    def run(batches):
        for batch in batches:
            x = matrix(batch.column(1), dims)
            ok = np.isfinite(x).all(axis=1)
            if unit:
                n = np.linalg.norm(np.where(ok[:, None], x, 0), axis=1)
                ok &= n > 0
                x = x / np.where(n > 0, n, 1)[:, None]
            x = x[ok].astype(np.float32)
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()).filter(pa.array(ok)), pa.array([v.tobytes() for v in x], pa.binary())], names=["id", "data"])

    good = F.col(column).isNotNull() & (F.size(column) == dims) & F.forall(column, lambda v: v.isNotNull())
    return df.where(good & F.col(ident).isNotNull()).select(ident, F.col(column).cast("array<double>").alias(column)).mapInArrow(run, "id bigint, data binary")


def matrix(column: pa.Array, dims: int) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dims) if len(column) else np.zeros((0, dims))


def unpack(blobs, dims: int) -> np.ndarray:
    return np.frombuffer(b"".join(blobs), dtype=np.float32).reshape(-1, dims)


def nearest(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return np.argmin((centres**2).sum(1)[None] - 2 * (x @ centres.T), axis=1)


def codebook(vectors: DataFrame, dims: int, part: slice, k: int, rounds: int, seed: str = "codebook") -> np.ndarray:
    """k centres of a part of the dimensions: Lloyd's rounds over all rows, from the rows of lowest seeded md5. Tasks send sums by centre."""
    spark = vectors.sparkSession
    first = vectors.orderBy(F.md5(F.concat(F.lit(seed), F.col("id").cast("string"))), "id").limit(k).collect()
    centres = np.unique(unpack([bytes(r["data"]) for r in first], dims)[:, part], axis=0).astype(np.float32)
    for _ in range(rounds):
        b = spark.sparkContext.broadcast(centres)

        def sums(batches, b=b):
            c = b.value
            total, n = np.zeros(c.shape), np.zeros(len(c), dtype=np.int64)
            for batch in batches:
                x = unpack(batch.column(0).to_pylist(), dims)[:, part]
                if len(x):
                    own = nearest(x, c)
                    np.add.at(total, own, x)
                    n += np.bincount(own, minlength=len(c))
            has = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays([pa.array(has), pa.array(list(total[has]), pa.list_(pa.float64())), pa.array(n[has])], names=["c", "s", "n"])

        # by centre, so that no task takes the sums of all
        each = vectors.select("data").mapInArrow(sums, "c bigint, s array<double>, n bigint")
        means = each.groupBy("c").agg(*[F.sum(F.col("s")[d]).alias(f"s{d}") for d in range(centres.shape[1])], F.sum("n").alias("n")).toPandas()
        if not len(means):
            return centres
        centres = centres.copy()
        centres[means["c"].to_numpy()] = means[[f"s{d}" for d in range(centres.shape[1])]].to_numpy() / means[["n"]].to_numpy()
    return centres
