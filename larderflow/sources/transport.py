"""Transports: how pages, images and models are reached. Every one adds a struct column (status, body, error, latency_ms), row by row, without a shuffle."""

from __future__ import annotations

import os
import time
import urllib.error
import urllib.request
from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.model_calls import KEY_VARIABLES

REPLY = "status int, body string, error string, latency_ms bigint"
AGENT = "Mozilla/5.0 (X11; Linux x86_64) AppleWebKit/537.36 (KHTML, like Gecko) Chrome/124.0 Safari/537.36"

#: (method, url, headers, body, timeout) -> (status, body)
Call = Callable[[str, str, dict[str, str], str | None, float], tuple[int, str]]


def http(method: str, url: str, headers: dict[str, str], body: str | None, timeout: float) -> tuple[int, str]:
    req = urllib.request.Request(url, data=body.encode() if body is not None else None, headers=headers, method=method)
    try:
        with urllib.request.urlopen(req, timeout=timeout) as r:
            return r.status, r.read().decode(r.headers.get_content_charset() or "utf-8", "replace")
    except urllib.error.HTTPError as e:
        return e.code, e.read().decode("utf-8", "replace")


class Transport:
    """Calls over HTTP, or over any function of the same form; a stub makes runs offline and repeatable. A call that fails is tried `attempts` times in all, with a delay
    that doubles. Replies should be written out before they are used twice, as a call is made anew whenever its rows are computed."""

    def __init__(self, call: Call = http, timeout: float = 30.0, attempts: int = 1, delay_ms: int = 1000, batch: int = 64):
        self.call, self.timeout, self.attempts, self.delay_ms, self.batch = call, timeout, attempts, delay_ms, batch

    def _udf(self, method: str, url: str | None, headers: Callable[[str | None], dict[str, str]], provider: str | None):
        call, timeout, attempts, delay = self.call, self.timeout, self.attempts, self.delay_ms

        def one(u: str | None, body: str | None):
            if u is None or (method == "POST" and body is None):
                return None
            names = KEY_VARIABLES.get(provider or "", [])
            h = headers(os.environ.get(names[0]) if names else None)
            for k in range(max(1, attempts)):
                status, text, error, began = None, None, None, time.monotonic()
                try:
                    status, text = call(method, u, h, body, timeout)
                    if method == "GET" and not 200 <= status < 300:
                        error = f"status {status}"
                except Exception as e:  # noqa: BLE001 - any failure of a call is the row's own
                    error = f"{type(e).__name__}: {e}"
                took = time.monotonic() - began  # of the last call, without earlier ones and the waits between
                if error is None and (status or 0) < 500:
                    break
                if k + 1 < attempts:
                    time.sleep(delay * 2**k / 1000)
            return {"status": status, "body": text, "error": error, "latency_ms": int(took * 1000)}

        if method == "GET":

            @F.pandas_udf(REPLY)
            def get(urls: pd.Series) -> pd.DataFrame:
                return _frame([one(u, None) for u in urls])

            return get.asNondeterministic()

        @F.pandas_udf(REPLY)
        def post(bodies: pd.Series) -> pd.DataFrame:
            return _frame([one(url, b) for b in bodies])

        return post.asNondeterministic()

    def get(self, df: DataFrame, url: str, out: str, agent: str = AGENT) -> DataFrame:
        return df.withColumn(out, self._udf("GET", None, lambda _: {"User-Agent": agent}, None)(F.col(url)))

    def post(self, df: DataFrame, url: str, headers: Callable[[str | None], dict[str, str]], provider: str | None, body: str, out: str) -> DataFrame:
        every = lambda key: headers(key) | {"Content-Type": "application/json"}
        return df.withColumn(out, self._udf("POST", url, every, provider)(F.col(body)))


def _frame(rows: list) -> pd.DataFrame:
    return pd.DataFrame([r or {"status": None, "body": None, "error": None, "latency_ms": None} for r in rows], columns=["status", "body", "error", "latency_ms"]).astype({"status": "Int32", "latency_ms": "Int64"})
