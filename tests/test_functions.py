"""Native functions over small tables."""

import pytest
import yaml
from pyspark.sql import functions as F

from larderflow.functions import duration, hosts, text

PHRASES = {
    "PT30M": "30 minutes", "PT1M": "1 minute", "PT1H": "1 hour", "PT3H": "3 hours", "PT1H30M": "1 hour 30 minutes", "PT90M": "1 hour 30 minutes", "PT150M": "2 hours 30 minutes", "PT180M": "3 hours", "PT65M": "1 hour 5 minutes", "PT2H15M": "2 hours 15 minutes",
    "invalid": "invalid", "": "", "PT15-20M": "15-20 minutes", "PT1H15-20M": "1 hour 15-20 minutes", "PT5400S": "1 hour 30 minutes", "PT5400.0S": "1 hour 30 minutes", "PT300S": "5 minutes", "PT90S": "2 minutes", "P1DT2H": "P1DT2H", "PT1.5H": "0 hours", "PT0M": "0 minutes",
    "PT0H30M": "0 hours 30 minutes", "PT1H90M": "1 hour 1 hour 30 minutes", "PT1H30M30S": "1 minute", "PT0S": "0S", "PT": "", "PTxyz": "xyz", "PT30M1H": "PT30M1H", "PT99999999999M": "99999999999M", None: None,
}
CLEAN = {"PT1H90M": "2 hours 30 minutes", "PT1H30M30S": "1 hour 31 minutes", "PT1.5H": "1 hour 30 minutes", "PT0S": "0 minutes", "PT": "", "PT15-20M": "15-20 minutes", "later": "later"}


def apply(spark, fn, values):
    df = spark.createDataFrame([(k, v) for k, v in enumerate(values)], "i int, v string")
    return [r["o"] for r in df.select("i", fn(F.col("v")).alias("o")).orderBy("i").collect()]


def test_duration_phrases(spark):
    assert apply(spark, duration.duration_phrase, PHRASES) == list(PHRASES.values())
    assert apply(spark, duration.duration_clean, CLEAN) == list(CLEAN.values())


def test_hosts(spark):
    urls = ["https://a.example.com/x", "http://example.com:80/", "ftp//odd/x", "no url", "http://u@h?q", None]
    assert apply(spark, hosts.url_host, urls) == ["a.example.com", "example.com:80", "odd", "", "u@h?q", ""]
    listed = lambda c: hosts.in_domains(hosts.url_host(c), ["example.com", "b.org"])
    assert apply(spark, listed, ["https://example.com/", "https://x.example.com/", "https://notexample.com/", "b.org"]) == [True, True, False, False]
    assert apply(spark, lambda c: hosts.in_domains(c, []), ["x"]) == [False]
    df = spark.createDataFrame([("https://x.y.example.com/",), ("https://example.org/",), ("none",)], "url string")
    long = spark.createDataFrame([("example.com",), ("example.com",), ("z",)], "domain string")
    assert {r["url"]: r["listed"] for r in hosts.with_domain_flag(df, "url", long).collect()} == {"https://x.y.example.com/": True, "https://example.org/": False, "none": False}


def test_names_and_diets(spark):
    assert apply(spark, text.sanitize_name, [" a \n\t b ", "\u00a0x\u2003y", "", "one"]) == ["a b", "x y", "", "one"]
    assert apply(spark, text.clean_diet, ["https://schema.org/VeganDiet", "http://schema.org/LowFatDiet", "Diet DietDiet x", "plain"]) == ["Vegan", "LowFat", "x", "plain"]
    assert apply(spark, lambda c: text.base64_text(F.encode(c, "utf-8")), ["x" * 100])[0] == "eHh4" * 33 + "eA=="


VALUES = ["4", "a : b", "plain text", "yes", "1.5", "- x", "a#b", "a #b", "it's", "'q'", "http://example.com", "line1\nline2", "", ": x", "key:", "2020-01-01", "null", "  lead", "é", "1e5", "0x1f", "~", "@x", "a\n\nb\n", "x\n", "\ttab", "1:30", "{a}", "\x07bell", "-", "--- x", "a, b", "|"]


def test_yaml_values_read_back(spark):
    entry = lambda c: text.metadata_yaml(F.array(F.struct(F.lit("k").alias("k"), c.alias("v"))))
    for v, y in zip(VALUES, apply(spark, entry, VALUES)):
        assert y.endswith("\n") and yaml.safe_load(y) == {"k": v}, (v, y)
    assert apply(spark, entry, ["4"]) == ["k: '4'\n"]
    assert apply(spark, entry, ["\n  calories: 200 kcal\n  serving size: 451"]) == ["k:\n  calories: 200 kcal\n  serving size: 451\n"]
    odd = "\n  not: a: mapping"
    assert yaml.safe_load(apply(spark, entry, [odd])[0]) == {"k": odd}
    none = F.array().cast("array<struct<k:string,v:string>>")
    assert apply(spark, lambda c: text.metadata_yaml(none), ["x"]) == [""]


def test_frontmatter(spark):
    docs = ["---\ntitle: T\na: b: c\nzz\na: d\n---\n\nbody", "plain", "---\ntitle: x\nno end", "---\n\n---\nrest", ""]
    got = apply(spark, text.text_components, docs)
    assert [tuple(r) for r in got] == [("\nbody", "a: d", "T"), ("plain", "", ""), ("---\ntitle: x\nno end", "", ""), ("rest", "", ""), ("", "", "")]


@pytest.mark.parametrize(("name", "meta", "want"), [("", "", "c"), ("T", "", "---\ntitle: T\n---\n\nc"), ("", "a: b", "---\na: b\n---\n\nc"), ("4", "a: b\n", "---\ntitle: '4'\na: b\n---\n\nc")])
def test_assembly(spark, name, meta, want):
    assert apply(spark, lambda c: text.assemble(c, F.lit(name), F.lit(meta)), ["c"]) == [want]
    raw = apply(spark, lambda c: text.assemble(c, F.lit(name), F.lit(meta), True), ["c"])[0]
    assert raw == want.replace("'4'", "4")


def test_component_text(spark):
    df = spark.createDataFrame([(["a ", " b"], "\n\nstep"), ([], "step"), (["a"], ""), ([], "")], "i array<string>, s string")
    assert [r[0] for r in df.select(text.components_text(F.col("i"), F.col("s"))).collect()] == ["a\nb\n\nstep", "step", "a\n", ""]


def test_functions_in_sql(spark):
    from larderflow.functions.register import register

    assert "url_host" in register(spark)
    r = spark.sql("SELECT sanitize_name(' a \n b ') AS n, clean_diet('https://schema.org/VeganDiet') AS d, url_host('https://h:1/x') AS h, in_domain_list('a.b.c', array('b.c')) AS i, strip_html(s) AS t, page_heading(s) AS p, body_text(s) AS b FROM (SELECT '<h1>x</h1><p>y' AS s)").first()
    assert tuple(r) == ("a b", "Vegan", "h:1", True, "x\ny", "x", "x y")
