"""The extractor chain over a DataFrame of pages."""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import cached_property

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from ..functions.duration import duration_phrase
from ..functions.text import clean_diet, components_text, metadata_yaml, sanitize_name
from ..schema import FIELDS, RECIPE
from . import dom, html_class, jsonld, microdata

EXTRACTORS = ("jsonld", "microdata", "html_class")
_ENTRIES = "array<struct<k:string,v:string>>"


class _Unreadable(Exception):
    """Neither the parser nor, for that, an extractor can do anything with the page."""


class _Page:
    """A page, and its tree once somebody asks for it."""

    def __init__(self, page: str):
        self.page = page

    @cached_property
    def root(self) -> dom.Node:
        try:
            return dom.parse(self.page)
        except Exception as e:  # noqa: BLE001
            raise _Unreadable(f"{type(e).__name__}: {e}") from e

    def jsonld(self, url: str, strict: bool) -> dict | None:
        """Most pages' scripts are found without a tree."""
        if "ld+json" not in self.page:
            return None
        try:
            return jsonld.of_scripts(dom.scripts(self.page, jsonld.SCRIPT), url, strict)
        except dom.Unclear:
            return jsonld.extract(self.root, url, strict)


def _run(page: str | None, url: str | None, names: tuple[str, ...], first_only: bool, strict: bool) -> dict:
    """What each extractor reads, and under `failure` why one couldn't: a page that can't be read is its own row's error, never the job's."""
    out: dict = {}
    if page is None:
        return out
    failure, p = None, _Page(page)
    for n in names:
        try:
            if n == "jsonld":
                got = p.jsonld(url or "", strict)
            elif n == "microdata":
                got = microdata.extract(p.root, url or "") if "itemscope" in page.lower() else None
            else:
                got = html_class.extract(p.root, url or "")
        except _Unreadable as e:
            return {"failure": str(e)}
        except Exception as e:  # noqa: BLE001
            got, failure = None, failure or f"{n}: {type(e).__name__}: {e}"
        out[n] = got
        if got is not None and first_only:
            return out
    return out | {"failure": failure}


def spread(rows: DataFrame, key: str) -> DataFrame:
    """Rows from which pages are made, by key over all tasks: a small file is read by a single task, however much work its rows are for the extractors. Costs a shuffle of these rows, so it comes before the pages are put together."""
    s = rows.sparkSession
    return rows.repartition(max(int(s.conf.get("spark.sql.shuffle.partitions")), s.sparkContext.defaultParallelism), key)


def fields(names: tuple[str, ...] = EXTRACTORS, first_only: bool = True, strict: bool = False):
    """An Arrow UDF (html, url) that reads a page once and gives what the extractors read, in order, up to the first that succeeds; `failure` if one broke and none succeeded."""
    schema = T.StructType([*(T.StructField(n, FIELDS) for n in names), T.StructField("failure", T.StringType())])
    kind = to_arrow_type(schema)

    @F.arrow_udf(schema)
    def read(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for pages, urls in batches:
            yield pa.array([_run(p, u, names, first_only, strict) for p, u in zip(pages.to_pylist(), urls.to_pylist())], kind)

    return read


def recipe(f: Column) -> Column:
    """A recipe from the fields that were read: metadata in their lasting order, durations phrased, diets cleaned, nutrition as a nested block."""
    entry = lambda k, v: F.struct(F.lit(k).alias("k"), v.alias("v"))
    times = F.transform(f["times"], lambda e: F.struct(e["k"].alias("k"), duration_phrase(e["v"]).alias("v")))
    times = F.filter(times, lambda e: e["v"] != "")
    none = F.array().cast(_ENTRIES)
    diets = F.when(f["diets"].isNotNull(), F.array(entry("diet", F.array_join(F.transform(f["diets"], clean_diet), ", ")))).otherwise(none)
    block = F.array_join(F.transform(f["nutrition"], lambda e: F.concat(F.lit("\n  "), e["k"], F.lit(": "), e["v"])), "")
    nutrition = F.when(F.size(f["nutrition"]) > 0, F.array(entry("nutrition", block))).otherwise(none)
    meta = F.concat(F.coalesce(f["meta"], none), F.coalesce(times, none), diets, nutrition)
    return F.when(f.isNotNull(), F.struct(*[f[c].alias(c) for c in RECIPE.fieldNames()[:5]], meta.alias("metadata")))


def with_recipes(pages: DataFrame, names: tuple[str, ...] = EXTRACTORS, strict: bool = False, html: str = "html", url: str = "url", failure: str | None = None) -> DataFrame:
    """The pages with `recipe` (null where no extractor succeeds) and `extractor`, the one that did; with `failure` a column of that name says why a page couldn't be read."""
    cheap = F.col(html).isNotNull()
    d = pages.withColumn("_f", F.when(cheap, fields(names, True, strict)(F.col(html), F.col(url))))
    got = [F.col("_f")[n] for n in names]
    label = F.coalesce(*[F.when(g.isNotNull(), n) for g, n in zip(got, names)])
    more = {failure: F.when(label.isNull(), F.col("_f")["failure"])} if failure else {}
    return d.withColumns({"extractor": label, "recipe": recipe(F.coalesce(*got)), **more}).drop("_f")


def extract_jsonld(pages: DataFrame, **how) -> DataFrame:
    return with_recipes(pages, ("jsonld",), **how)


def extract_microdata(pages: DataFrame, **how) -> DataFrame:
    return with_recipes(pages, ("microdata",), **how)


def extract_html_class(pages: DataFrame, **how) -> DataFrame:
    return with_recipes(pages, ("html_class",), **how)


def metadata_entries(r: Column) -> Column:
    """Description, first image, then the recipe's metadata."""
    none = F.array().cast(_ENTRIES)
    one = lambda k, v: F.when(v.isNotNull(), F.array(F.struct(F.lit(k).alias("k"), v.alias("v")))).otherwise(none)
    return F.concat(one("description", r["description"]), one("image", F.try_element_at(r["image"], F.lit(1))), r["metadata"])


def components(r: Column) -> Column:
    """struct(text, metadata, name) of a recipe; null for none."""
    return F.when(r.isNotNull(), F.struct(components_text(r["ingredients"], r["instructions"]).alias("text"), metadata_yaml(metadata_entries(r)).alias("metadata"), sanitize_name(F.coalesce(r["name"], F.lit(""))).alias("name")))


# --- single functions -----------------------------------------------------------------------------------------------


@F.pandas_udf(T.StringType())
def decode_html(s: pd.Series) -> pd.Series:
    """Entities decoded twice, tags stripped with line ends at blocks."""
    return s.map(dom.decode, na_action="ignore")


@F.pandas_udf(T.StringType())
def body_text(s: pd.Series) -> pd.Series:
    return s.map(lambda x: dom.body_text(dom.parse(x)), na_action="ignore")


#: Comments, scripts and styles as a whole, a tag with its attributes, or a heading whose text has neither tags nor entities.
_UP_TO_HEADING = re.compile(r"""<!--.*?-->|<(script|style)\b[^<>"']*>.*?</\1\s*>|<h([12])(?:\s[^<>"']*(?:"[^"]*"[^<>"']*|'[^']*'[^<>"']*)*)?>([^<&]*)(</h\2\s*>)?|<[!/a-z][^<>"']*(?:"[^"]*"[^<>"']*|'[^']*'[^<>"']*)*>""", re.S | re.I)
_RAW = re.compile(r"<(title|textarea|xmp|iframe|noscript|noembed|noframes|plaintext|template)\b", re.I)


def _plain_heading(page: str) -> str | None:
    """The heading of a page that needn't be parsed for it; None if it must be."""
    at = 0
    for m in _UP_TO_HEADING.finditer(page):
        if page.find("<", at, m.start()) >= 0:
            return None  # something between that isn't understood
        at = m.end()
        if m[2]:
            return m[3].strip() if m[4] else None
        if m[0][1:2] != "!" and _RAW.match(m[0]):
            end = page.find("<", at)
            if end < 0 or page[end : end + 2] != "</":
                return None
    return None


@F.pandas_udf(T.StringType())
def heading(s: pd.Series) -> pd.Series:
    """Text of the first h1 or h2, '' without one. Most pages are only scanned up to it; what the scan doesn't understand is parsed."""

    def one(x: str) -> str:
        if (plain := _plain_heading(x)) is not None:
            return plain
        n = dom.parse(x).first(dom.tag("h1", "h2"))
        return n.text() if n is not None else ""

    return s.map(one, na_action="ignore")


@F.pandas_udf(T.StringType())
def repair_json(s: pd.Series) -> pd.Series:
    from .json_repair import repair

    return s.map(repair, na_action="ignore")


def decoded(x: Column) -> Column:
    """`decode_html`, skipped where there is neither an entity nor a tag."""
    return F.when(F.contains(x, F.lit("&")) | F.contains(x, F.lit("<")), decode_html(F.when(F.contains(x, F.lit("&")) | F.contains(x, F.lit("<")), x))).otherwise(x)


def jsonld_scripts(html: Column) -> Column:
    """Texts of the page's JSON-LD scripts, natively."""
    return F.regexp_extract_all(html, F.lit(r"""(?is)<script\b[^>]*\btype\s*=\s*["']?application/ld\+json["']?[^>]*>(.*?)</script\s*>"""), F.lit(1))
