"""One-record helpers over the plans."""

from __future__ import annotations

import os

from pyspark.sql import SparkSession

from .. import __version__
from ..operators.model_calls import available
from ..sources.transport import Transport
from .importer import ImportPlan


def _one(plan: ImportPlan, calls: Transport | None, by_model: bool = False) -> dict:
    row = plan.build(calls, by_model).first().asDict(recursive=True)
    if row.get("error"):
        raise RuntimeError(f"{row['error']['kind']}: {row['error']['message']}")
    return row


def import_from_url(spark: SparkSession, url: str, calls: Transport | None = None, provider: str | None = None) -> str:
    plan = ImportPlan(spark).url(url)
    return _one(plan.provider(provider) if provider else plan, calls)["content"]


def extract_recipe_from_url(spark: SparkSession, url: str, calls: Transport | None = None) -> dict:
    return _one(ImportPlan(spark).url(url).extract_only(), calls)["components"]


def convert_text(spark: SparkSession, text: str, calls: Transport | None = None, provider: str | None = None) -> str:
    plan = ImportPlan(spark).text(text)
    return _one(plan.provider(provider) if provider else plan, calls)["content"]


def convert_image(spark: SparkSession, images: list[tuple[str, str]], calls: Transport | None = None, provider: str | None = None) -> str:
    plan = ImportPlan(spark).images(images)
    return _one(plan.provider(provider) if provider else plan, calls)["content"]


def simple_import(spark: SparkSession, url: str, calls: Transport | None = None) -> str:
    return import_from_url(spark, url, calls)


def get_version() -> str:
    return __version__


def is_provider_available(name: str) -> bool:
    return available(name, dict(os.environ))
