"""The extraction as a stream: every stage maps rows, so batch and stream give the same."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from ..operators.extract import EXTRACTORS
from ..plans.importer import pages_to_recipes


def read_pages(spark: SparkSession, path: str, schema: StructType, files_per_trigger: int | None = None) -> DataFrame:
    """Pages of a folder's Parquet files as they come."""
    r = spark.readStream.schema(schema)
    return (r.option("maxFilesPerTrigger", files_per_trigger) if files_per_trigger else r).parquet(path)


def recipes(pages: DataFrame, extractors: tuple[str, ...] = EXTRACTORS, seen_within: str | None = None, event_time: str | None = None) -> DataFrame:
    """Recipes of a stream of pages; with `seen_within` and an event time column, a url that comes again within that delay is dropped."""
    if seen_within and event_time:
        pages = pages.withWatermark(event_time, seen_within).dropDuplicatesWithinWatermark(["url"])
    return pages_to_recipes(pages, extractors)


def write(df: DataFrame, path: str, checkpoint: str, once: bool = True) -> StreamingQuery:
    """Appends the stream to a Parquet folder, exactly once per row; with `once` until what is there now has been read."""
    w = df.writeStream.format("parquet").outputMode("append").option("checkpointLocation", checkpoint)
    return (w.trigger(availableNow=True) if once else w).start(path)
