"""Row types of the engine."""

from __future__ import annotations

from pyspark.sql import types as T

ENTRY = T.StructType([T.StructField("k", T.StringType()), T.StructField("v", T.StringType())])

#: What an extractor reads from a page, before metadata are named and phrased.
FIELDS = T.StructType(
    [
        T.StructField("name", T.StringType()),
        T.StructField("description", T.StringType()),
        T.StructField("image", T.ArrayType(T.StringType())),
        T.StructField("ingredients", T.ArrayType(T.StringType())),
        T.StructField("instructions", T.StringType()),
        T.StructField("meta", T.ArrayType(ENTRY)),
        T.StructField("times", T.ArrayType(ENTRY)),
        T.StructField("diets", T.ArrayType(T.StringType())),
        T.StructField("nutrition", T.ArrayType(ENTRY)),
    ]
)

#: A recipe: ordered metadata entries stand for the map, so that output is deterministic.
RECIPE = T.StructType(FIELDS.fields[:5] + [T.StructField("metadata", T.ArrayType(ENTRY))])

COMPONENTS = T.StructType([T.StructField(n, T.StringType()) for n in ("text", "metadata", "name")])
USAGE = T.StructType([T.StructField("input_tokens", T.LongType()), T.StructField("output_tokens", T.LongType())])
CONVERSION = T.StructType([T.StructField("model_version", T.StringType()), T.StructField("tokens_used", USAGE), T.StructField("latency_ms", T.LongType())])
ERROR = T.StructType([T.StructField("kind", T.StringType()), T.StructField("message", T.StringType())])
#: Kinds of `error`.
ERROR_KINDS = ("fetch", "parse", "no_extractor", "extraction", "conversion", "ocr", "config", "builder", "invalid_text", "other")
