"""Functions for SQL texts."""

from __future__ import annotations

from pyspark.sql import SparkSession

from ..operators.extract import body_text, decode_html, heading, repair_json

_NATIVE = {
    "sanitize_name(x STRING)": r"trim(regexp_replace(x, '(?U)\\s+', ' '))",
    "clean_diet(x STRING)": r"trim(replace(regexp_replace(x, '^(https?://schema\\.org/)+', ''), 'Diet', ''))",
    "url_host(x STRING)": "coalesce(try_element_at(split(try_element_at(split(x, '//'), 2), '/'), 1), '')",
    "in_domain_list(host STRING, domains ARRAY<STRING>)": "exists(domains, d -> host = d OR endswith(host, concat('.', d)))",
}


def register(spark: SparkSession) -> list[str]:
    """Register the functions in the session and name them: SQL functions where an expression can say it, Arrow UDFs for what needs the HTML tree."""
    for head, body in _NATIVE.items():
        kind = "BOOLEAN" if head.startswith("in_") else "STRING"
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {head} RETURNS {kind} RETURN {body}")
    arrow = {"strip_html": decode_html, "body_text": body_text, "page_heading": heading, "sanitize_json": repair_json}
    for name, f in arrow.items():
        spark.udf.register(name, f)
    return [h.split("(")[0] for h in _NATIVE] + list(arrow)
