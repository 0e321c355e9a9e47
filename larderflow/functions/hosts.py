"""Hosts of URLs and domain lists."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def url_host(url: Column | str, strict: bool = False) -> Column:
    """What stands between the first // and the next /; '' without //. With `strict` the host proper, without port, user or query."""
    u = F.col(url) if isinstance(url, str) else url
    if strict:
        return F.coalesce(F.try_parse_url(u, F.lit("HOST")), F.lit(""))
    rest = F.try_element_at(F.split(u, "//"), F.lit(2))
    return F.coalesce(F.try_element_at(F.split(rest, "/"), F.lit(1)), F.lit(""))


def in_domains(host: Column, domains: list[str]) -> Column:
    """Whether the host is one of the domains or below one of them."""
    if not domains:
        return F.lit(False)
    d = F.array(*[F.lit(x) for x in domains])
    return F.exists(d, lambda x: (host == x) | F.endswith(host, F.concat(F.lit("."), x)))


def with_domain_flag(df: DataFrame, url: str, domains: DataFrame, flag: str = "listed") -> DataFrame:
    """The same for a long list, a DataFrame with the column `domain`: every suffix of the host is looked up by an equi-join."""
    parts = F.split(F.col("_h"), r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.concat_ws(".", F.slice(parts, i, F.size(parts))))
    hosts = df.select(url_host(url).alias("_h")).distinct()
    hit = hosts.select("_h", F.explode(suffixes).alias("domain")).join(domains.select("domain").distinct(), "domain", "left_semi").select("_h").distinct()
    out = df.withColumn("_h0", url_host(url)).join(hit.withColumn(flag, F.lit(True)), F.col("_h0") == F.col("_h"), "left")
    return out.withColumn(flag, F.coalesce(flag, F.lit(False))).drop("_h", "_h0")
