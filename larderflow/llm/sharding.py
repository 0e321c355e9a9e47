"""Proportional stratified interleaving of documents into shards."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import seeded, with_rank

SEED = 42
#: Documents a shard holds on average.
ROWS_PER_SHARD = 250


def shard(docs: DataFrame, rows_per_shard: int = ROWS_PER_SHARD, seed: int = SEED) -> DataFrame:
    """Rows (doc_id, source, shard, pos): every shard holds each source in its share of the whole, within one document.

    Documents of a source are shuffled by a seeded hash of doc_id and ranked r = 0..n-1; documents sorted by (r + 1/2) / n are cut
    into shards at equal fractions, and `pos` counts from 0 inside a shard. Ranks come from hash buckets and their offsets, so no task sorts a
    whole source; a shard is sorted by the task that holds it.

    Null sources are one source of their own, null doc_ids hash as empty text; repeated rows keep their count, and rows alike
    in doc_id and source are interchangeable. An empty table gives an empty result. Columns other than doc_id and source aren't read.
    """
    d = docs.select("doc_id", "source")
    total = d.count()
    shards = max(1, -(-total // rows_per_shard))
    r = with_rank(d.withColumn("_h", seeded(seed, "doc_id")), "source", "_h", ["doc_id"])
    # floor((r + 1/2) / n * shards) in whole numbers
    r = r.withColumn("shard", F.expr(f"(2 * _rank + 1) * {shards} div (2 * _n)")).withColumn("_f", (2 * F.col("_rank") + 1) / (2 * F.col("_n")))
    w = Window.partitionBy("shard").orderBy("_f", F.col("source").asc_nulls_first(), F.col("doc_id").asc_nulls_first())
    return r.select("doc_id", "source", "shard", (F.row_number().over(w) - 1).cast("bigint").alias("pos"))


SQL = f"""
WITH r AS (
  SELECT doc_id, source, count(*) OVER (PARTITION BY source) AS n,
    row_number() OVER (PARTITION BY source ORDER BY md5('{SEED}|' || coalesce(CAST(doc_id AS VARCHAR), '')), doc_id) - 1 AS rk,
    greatest(1, CAST(ceil(count(*) OVER () / {ROWS_PER_SHARD}.0) AS BIGINT)) AS shards
  FROM documents),
s AS (SELECT doc_id, source, CAST((2 * rk + 1) * shards // (2 * n) AS BIGINT) AS shard, CAST(2 * rk + 1 AS DOUBLE) / CAST(2 * n AS DOUBLE) AS f FROM r)
SELECT doc_id, source, shard,
  CAST(row_number() OVER (PARTITION BY shard ORDER BY f, source NULLS FIRST, doc_id NULLS FIRST) - 1 AS BIGINT) AS pos FROM s
"""
