"""Plans that turn pages, texts and images into recipes: functions over DataFrames, and a fluent builder."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import assemble, text_components
from ..operators.extract import EXTRACTORS, body_text, components, with_recipes
from ..operators.model_calls import extraction_components, extraction_request, provider, to_markup
from ..sources import images as ocr
from ..sources.pages import fetch
from ..sources.transport import Transport
from .config import Settings, chain

_PARTS = "struct<text:string,metadata:string,name:string>"
_ERROR = "struct<kind:string,message:string>"


def _error(kind: str, message) -> F.Column:
    return F.struct(F.lit(kind).alias("kind"), message.alias("message"))


def pages_to_recipes(pages: DataFrame, extractors: tuple[str, ...] = EXTRACTORS, calls: Transport | None = None) -> DataFrame:
    """Adds `extractor`, `components` and `error` to pages (url, html, perhaps fetch_error). Where no extractor succeeds and there is a transport for a
    model, the model reads the page's text. A page that can't be read has an error of kind 'parse'; other rows go on."""
    d = with_recipes(pages, extractors, failure="_broken").withColumn("components", components(F.col("recipe"))).drop("recipe")
    why = F.col("fetch_error") if "fetch_error" in d.columns else F.lit(None).cast("string")
    d = d.withColumn("error", F.when(F.col("components").isNull(), F.when(why.isNotNull(), _error("fetch", why)).when(F.col("_broken").isNotNull(), _error("parse", F.col("_broken"))).otherwise(_error("no_extractor", F.lit("no recipe found"))))).drop("_broken")
    if calls is None:
        return d
    d = d.withColumn("_t", F.when(F.col("components").isNull() & F.col("html").isNotNull(), body_text(F.when(F.col("components").isNull(), F.col("html")))))
    return _read_by_model(d, "_t", F.col("url"), calls).withColumn("extractor", F.when(F.col("extractor").isNull() & F.col("components").isNotNull(), "model").otherwise(F.col("extractor"))).drop("_t")


def _read_by_model(d: DataFrame, text: str, source, calls: Transport) -> DataFrame:
    """Sets `components` and `error` where there are no components but a text."""
    p = provider("open_ai")
    d = d.withColumn("_q", F.when(F.col("components").isNull() & F.col(text).isNotNull(), extraction_request(F.col(text))))
    d = calls.post(d, p.url(), p.headers, p.name, "_q", "_r")
    got = extraction_components(F.get_json_object("_r.body", "$.choices[0].message.content"), source)
    asked = F.col("_q").isNotNull()
    failed = F.coalesce(F.when(F.col("_r.error").isNotNull(), _error("fetch", F.col("_r.error"))), got["error"])
    return d.withColumns({"components": F.coalesce("components", F.when(asked, got["components"])), "error": F.when(asked, F.when(got["components"].isNull(), failed)).otherwise(F.col("error"))}).drop("_q", "_r")


def urls_to_recipes(urls: DataFrame, calls: Transport, settings: Settings | None = None, by_model: bool = False) -> DataFrame:
    """Fetches and extracts (url); see `pages_to_recipes`."""
    s = settings or Settings()
    return pages_to_recipes(fetch(urls, calls, s.browser_domains, s.browser_url), s.extractors, calls if by_model else None)


def texts_to_recipes(texts: DataFrame, extract: bool = False, calls: Transport | None = None) -> DataFrame:
    """Adds `components` and `error` to (text): its front matter split off, or with `extract` read by a model."""
    if not extract:
        return texts.withColumns({"components": text_components(F.col("text")), "error": F.lit(None).cast(_ERROR)})
    if calls is None:
        raise ValueError("a model needs a transport")
    d = texts.withColumns({"components": F.lit(None).cast(_PARTS), "error": F.lit(None).cast(_ERROR)})
    return _read_by_model(d, "text", F.lit("direct-input"), calls)


def images_to_recipes(images: DataFrame, calls: Transport, by_model: bool = False) -> DataFrame:
    """(record_id, components, error) of images (record_id, pos, source, data): recognised, merged by record, and read by a model if asked."""
    d = ocr.merge(ocr.recognise(images, calls))
    raw = F.when(F.col("error").isNull(), ocr.raw_components(F.col("text"), F.col("sources")))
    if by_model:
        d = _read_by_model(d.withColumn("components", F.lit(None).cast(_PARTS)), "text", F.col("sources"), calls)
        return d.select("record_id", "components", "error")
    return d.select("record_id", raw.alias("components"), "error")


def recipes_to_markup(recipes: DataFrame, calls: Transport, settings: Settings | None = None, provider_name: str | None = None, model: str | None = None) -> DataFrame:
    """Adds `content` and `conversion` to rows with `components`; see `to_markup`. An error that a row already has stays."""
    had = recipes.withColumnRenamed("error", "_had") if "error" in recipes.columns else recipes.withColumn("_had", F.lit(None).cast(_ERROR))
    d = to_markup(had, calls, chain(settings or Settings(), provider_name, model))
    return d.withColumn("error", F.coalesce("_had", "error")).drop("_had")


def frontmatter(recipes: DataFrame, raw_title: bool = False) -> DataFrame:
    """Adds `content`: components put together as text, without a model."""
    c = F.col("components")
    return recipes.withColumn("content", assemble(c["text"], c["name"], c["metadata"], raw_title))


class ImportPlan:
    """A fluent way to the functions above, for one record or many: ImportPlan(spark).url(...).extract_only().build(calls)."""

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.kind: str | None = None
        self.value: list = []
        self.settings = Settings()
        self._extract_text = self._only = False
        self._provider: str | None = None
        self._model: str | None = None

    def _set(self, kind: str, value: list) -> ImportPlan:
        self.kind, self.value = kind, value
        return self

    def url(self, *urls: str) -> ImportPlan:
        return self._set("url", list(urls))

    def text(self, *texts: str) -> ImportPlan:
        self._extract_text = False
        return self._set("text", list(texts))

    def text_with_extraction(self, *texts: str) -> ImportPlan:
        self._extract_text = True
        return self._set("text", list(texts))

    def image_path(self, path: str) -> ImportPlan:
        return self._image(("path", path))

    def image_base64(self, data: str) -> ImportPlan:
        return self._image(("base64", data))

    def _image(self, one: tuple[str, str]) -> ImportPlan:
        return self._set("images", [*(self.value if self.kind == "images" else []), one])

    def images(self, images: list[tuple[str, str]]) -> ImportPlan:
        return self._set("images", list(images))

    def extract_only(self) -> ImportPlan:
        self._only = True
        return self

    def provider(self, name: str) -> ImportPlan:
        self._provider = name
        return self

    def model(self, name: str) -> ImportPlan:
        self._model = name
        return self

    def timeout(self, seconds: float) -> ImportPlan:
        self.settings.timeout = seconds
        return self

    def configured(self, settings: Settings) -> ImportPlan:
        self.settings = settings
        return self

    def build(self, calls: Transport | None = None, by_model: bool = False) -> DataFrame:
        """The lazy result: `components` and `error`, and without extract_only `content` and `conversion`."""
        if self.kind is None:
            raise ValueError("no source: give a url, a text or images")
        calls = calls or self.settings.transport()
        if self.kind == "url":
            d = urls_to_recipes(self.spark.createDataFrame([(u,) for u in self.value], "url string"), calls, self.settings, by_model)
        elif self.kind == "text":
            d = texts_to_recipes(self.spark.createDataFrame([(t,) for t in self.value], "text string"), self._extract_text, calls)
        else:
            given = [("0", k, v if kind == "path" else "base64-image", v if kind == "base64" else None) for k, (kind, v) in enumerate(self.value)]
            d = self.spark.createDataFrame(given, "record_id string, pos int, source string, data string")
            if paths := [v for kind, v in self.value if kind == "path"]:
                files = ocr.read_images(self.spark, sorted(set(paths))).select(F.col("source").alias("_s"), F.col("data").alias("_d"))
                d = d.join(files, d["source"] == files["_s"], "left").withColumn("data", F.coalesce("data", "_d")).drop("_s", "_d")
            d = images_to_recipes(d, calls, by_model)
        return d if self._only else recipes_to_markup(d, calls, self.settings, self._provider, self._model)


__all__ = ["ImportPlan", "frontmatter", "images_to_recipes", "pages_to_recipes", "recipes_to_markup", "texts_to_recipes", "urls_to_recipes"]
