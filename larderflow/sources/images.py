"""Images and what an OCR service reads in them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import base64_text, trim_space
from .transport import Transport

_OCR_HOST = "https://vision.googleapis.com"
OCR_URL = f"{_OCR_HOST}/v1/images:annotate"


def read_images(spark: SparkSession, paths: list[str]) -> DataFrame:
    """(record_id, pos, source, data): files as base64, in the order of the paths, as one record."""
    order = spark.createDataFrame([(k, p) for k, p in enumerate(paths)], "pos int, path string")
    files = spark.read.format("binaryFile").load(paths)
    name = F.regexp_replace("path", "^file:/*", "/")
    return files.select(name.alias("path"), base64_text("content").alias("data")).join(F.broadcast(order), "path").select(F.lit("0").alias("record_id"), "pos", F.col("path").alias("source"), "data")


def ocr_request(data: Column) -> Column:
    image, kind = F.struct(data.alias("content")), F.array(F.struct(F.lit("TEXT_DETECTION").alias("type")))
    return F.to_json(F.struct(F.array(F.struct(F.struct(image["content"].alias("content")).alias("image"), kind.alias("features"))).alias("requests")))


def ocr_text(body: Column) -> Column:
    """The text that was found; null where there is none or only white space."""
    t = F.get_json_object(body, "$.responses[0].fullTextAnnotation.text")
    return F.when(trim_space(t) != "", t)


def recognise(images: DataFrame, calls: Transport) -> DataFrame:
    """Adds `ocr_text` and `ocr_error`."""
    d = calls.post(images.withColumn("_b", ocr_request(F.col("data"))), OCR_URL, lambda key: {"x-goog-api-key": key or ""}, "google", "_b", "_r")
    good = F.col("_r.error").isNull() & F.col("_r.status").between(200, 299)
    text = F.when(good, ocr_text(F.col("_r.body")))
    return d.withColumns({"ocr_text": text, "ocr_error": F.when(text.isNull(), F.coalesce(F.col("_r.error"), F.when(~good, F.concat(F.lit("status "), F.col("_r.status"))), F.lit("no text found")))}).drop("_b", "_r")


def merge(pages: DataFrame) -> DataFrame:
    """(record_id, text, sources, error): texts of a record's images in order, with a blank line between; a record with a failed image has its first error instead."""
    g = pages.groupBy("record_id").agg(F.array_sort(F.collect_list(F.struct("pos", F.col("ocr_text").alias("t"), F.col("source").alias("s"), F.col("ocr_error").alias("e")))).alias("p"))
    bad = F.filter("p", lambda x: x["t"].isNull())
    error = F.when(F.size(bad) > 0, F.struct(F.lit("ocr").alias("kind"), F.coalesce(F.element_at(bad, 1)["e"], F.lit("no text found")).alias("message")))
    text = F.array_join(F.transform("p", lambda x: x["t"]), "\n\n")
    names = F.array_join(F.transform("p", lambda x: F.coalesce(x["s"], F.lit("base64-image"))), ", ")
    return g.select("record_id", F.when(error.isNull(), text).alias("text"), names.alias("sources"), error.alias("error"))


def raw_components(text: Column, sources: Column) -> Column:
    """Components of a text that no model has read."""
    return F.struct(text.alias("text"), F.concat(F.lit("source: "), sources).alias("metadata"), F.lit("").alias("name"))


