"""Pages by URL: routed, fetched, and fetched again by a browser service."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.hosts import in_domains, url_host
from .transport import Transport


def with_route(urls: DataFrame, domains: list[str], service: str | None) -> DataFrame:
    """Adds `route`: 'browser' for listed domains if there is a browser service, else 'request'."""
    listed = in_domains(url_host("url"), domains) if service else F.lit(False)
    return urls.withColumn("route", F.when(listed, "browser").otherwise("request"))


def _browser(df: DataFrame, service: str, calls: Transport, out: str) -> DataFrame:
    d = calls.post(df.withColumn("_b", F.to_json(F.struct("url"))), f"{service.rstrip('/')}/api/fetch-source", lambda _: {}, None, "_b", "_r")
    good = F.col("_r.error").isNull() & F.col("_r.status").between(200, 299)
    source = F.get_json_object("_r.body", "$.source")
    reply = F.struct(F.when(good, source).alias("html"), F.when(good & source.isNotNull(), None).otherwise(F.coalesce(F.col("_r.error"), F.concat(F.lit("status "), F.col("_r.status")), F.lit("no source"))).alias("error"))
    return d.withColumn(out, reply).drop("_b", "_r")


def fetch(urls: DataFrame, calls: Transport, domains: list[str] = (), service: str | None = None) -> DataFrame:
    """Adds `html` and `fetch_error`. Plain requests that fail are tried once more over the browser service, if there is one; if that fails too, the first error stays."""
    d = with_route(urls, list(domains), service)
    plain = calls.get(d.where("route = 'request'"), "url", "_p")
    plain = plain.withColumns({"html": F.when(F.col("_p.error").isNull(), F.col("_p.body")), "fetch_error": F.col("_p.error")}).drop("_p")
    if not service:
        return plain
    again = _browser(plain.withColumn("_u", F.col("url")).withColumn("url", F.when(F.col("fetch_error").isNotNull(), F.col("url"))), service, _Only(calls), "_a")
    plain = again.withColumns({"url": F.col("_u"), "html": F.coalesce("html", F.col("_a.html")), "fetch_error": F.when(F.col("_a.html").isNull(), F.col("fetch_error"))}).drop("_a", "_u")
    listed = _browser(d.where("route = 'browser'"), service, calls, "_a")
    listed = listed.withColumns({"html": F.col("_a.html"), "fetch_error": F.col("_a.error")}).drop("_a")
    return plain.unionByName(listed)


class _Only:
    """A transport that doesn't call for rows without a url."""

    def __init__(self, calls: Transport):
        self.calls = calls

    def post(self, df, url, headers, provider, body, out):
        return self.calls.post(df.withColumn(body, F.when(F.col("url").isNotNull(), F.col(body))), url, headers, provider, body, out)
