"""Sources, model calls and plans over stub transports; streaming; settings; the command line."""

import json

import pytest
from pyspark.sql import functions as F

from larderflow.operators import model_calls
from larderflow.plans import api, config
from larderflow.plans.importer import ImportPlan, images_to_recipes, pages_to_recipes, recipes_to_markup, texts_to_recipes, urls_to_recipes
from larderflow.sources import images
from larderflow.sources.pages import fetch
from larderflow.sources.transport import Transport
from larderflow.streaming import pages as stream

from .test_extract import CARD, ld, recipe


def stub(method, url, headers, body, timeout):
    if method == "GET":
        return (200, ld(recipe(recipeInstructions="Stir."))) if "good" in url else (403, "no")
    if "fetch-source" in url:
        return (200, json.dumps({"source": CARD})) if "card" in body else (500, "")
    if "images:annotate" in url:
        data = json.loads(body)["requests"][0]["image"]["content"]
        return 200, json.dumps({"responses": [{"fullTextAnnotation": {"text": f"read {data}"}} if data != "blank" else {}]})
    if "openai" in url:
        q = json.loads(body)
        if "response_format" in q:
            return 200, json.dumps({"choices": [dict(message={"content": json.dumps({"title": "Found", "servings": "2", "ingredients": ["a"], "instructions": ["Do.", "Go."], "error": "none here" if "nothing" in q["messages"][1]["content"] else None})})]})
        return 429, json.dumps({"error": {"message": "slow down"}})
    if "anthropic" in url:
        assert headers["anthropic-version"]
        return 200, json.dumps({"model": "c", "content": [{"text": "Mix @a{}."}], "usage": {"input_tokens": 3, "output_tokens": 4}})
    raise OSError("unreachable")


CALLS = Transport(stub)


def test_routes_and_refetch(spark):
    urls = spark.createDataFrame([("http://good.com/",), ("http://bad.com/card",), ("http://bad.com/",), ("http://x.listed.com/card",), ("http://listed.com/good",)], "url string")
    got = {r["url"]: (r["route"], r["html"] is not None, r["fetch_error"]) for r in fetch(urls, CALLS, ["listed.com"], "http://b/").collect()}
    assert got == {"http://good.com/": ("request", True, None), "http://bad.com/card": ("request", True, None), "http://bad.com/": ("request", False, "status 403"), "http://x.listed.com/card": ("browser", True, None), "http://listed.com/good": ("browser", False, "status 500")}
    plain = {r["url"]: r["route"] for r in fetch(urls, CALLS, ["listed.com"]).collect()}
    assert set(plain.values()) == {"request"}


def test_urls_to_markup_with_fallback(spark):
    s = config.Settings(fallback_enabled=True, fallback_order=["open_ai", "anthropic"])
    urls = spark.createDataFrame([("http://good.com/",), ("http://bad.com/",)], "url string")
    rows = {r["url"]: r for r in recipes_to_markup(urls_to_recipes(urls, CALLS, s), CALLS, s).collect()}
    good, bad = rows["http://good.com/"], rows["http://bad.com/"]
    assert good["content"] == "---\ntitle: Stew\nsource: http://good.com/\n---\n\nMix @a{}." and good["conversion"]["tokens_used"]["output_tokens"] == 4 and good["error"] is None
    assert bad["content"] is None and bad["error"]["kind"] == "fetch" and "403" in bad["error"]["message"]
    alone = recipes_to_markup(urls_to_recipes(urls.limit(1), CALLS), CALLS).first()
    assert alone["content"] is None and alone["error"]["message"] == "slow down"


def test_model_reads_pages_and_texts(spark):
    pages = spark.createDataFrame([("u", "<body>some words</body>", None), ("v", "<body>nothing</body>", None), ("w", None, "status 404")], "url string, html string, fetch_error string")
    got = {r["url"]: r for r in pages_to_recipes(pages, calls=CALLS).collect()}
    assert tuple(got["u"]["components"]) == ("a\n\nDo. Go.", "source: u\nservings: '2'\n", "Found") and got["u"]["extractor"] == "model" and got["u"]["error"] is None
    assert got["v"]["components"] is None and got["v"]["error"]["message"] == "none here"
    assert got["w"]["error"]["kind"] == "fetch"
    texts = spark.createDataFrame([("---\ntitle: T\n---\nx",), ("y",)], "text string")
    assert [r["components"]["name"] for r in texts_to_recipes(texts).collect()] == ["T", ""]
    assert texts_to_recipes(texts.where("text = 'y'"), True, CALLS).first()["components"]["name"] == "Found"
    with pytest.raises(ValueError):
        texts_to_recipes(texts, True)


def test_images(spark, tmp_path):
    (tmp_path / "b.png").write_bytes(b"x" * 100)
    (tmp_path / "a.png").write_bytes(b"y")
    paths = [str(tmp_path / "b.png"), str(tmp_path / "a.png")]
    read = images.read_images(spark, paths).orderBy("pos").collect()
    assert [r["source"] for r in read] == paths and "\r" not in read[0]["data"]
    d = spark.createDataFrame([("r", 1, None, "two"), ("r", 0, "f.png", "one"), ("s", 0, None, "blank"), ("s", 1, None, "x")], "record_id string, pos int, source string, data string")
    got = {r["record_id"]: r for r in images_to_recipes(d, CALLS).collect()}
    assert tuple(got["r"]["components"]) == ("read one\n\nread two", "source: f.png, base64-image", "")
    assert got["s"]["components"] is None and got["s"]["error"]["kind"] == "ocr"
    plan = ImportPlan(spark).image_path(paths[1]).image_base64("zz").extract_only().build(CALLS).first()
    assert plan["components"]["text"] == "read eQ==\n\nread zz"


def test_builder_and_helpers(spark):
    with pytest.raises(ValueError):
        ImportPlan(spark).build(CALLS)
    assert ImportPlan(spark).image_base64("a").image_base64("b").value == [("base64", "a"), ("base64", "b")]
    assert ImportPlan(spark).text("x").image_base64("a").value == [("base64", "a")]
    assert api.extract_recipe_from_url(spark, "http://good.com/", CALLS)["name"] == "Stew"
    assert api.convert_text(spark, "---\ntitle: T\n---\nx", CALLS, "anthropic") == "---\ntitle: T\n---\n\nMix @a{}."
    with pytest.raises(RuntimeError, match="slow down"):
        api.import_from_url(spark, "http://good.com/", CALLS)
    assert api.get_version()


def test_providers(spark):
    assert model_calls.provider("nobody") is None and model_calls.provider("azure_openai") is None
    p = model_calls.provider("azure_openai", options={"endpoint": "https://e/", "deployment_name": "d", "api_version": "v"})
    assert p.url() == "https://e/openai/deployments/d/chat/completions?api-version=v" and p.headers("k") == {"api-key": "k"}
    assert model_calls.available("ollama", {}) and not model_calls.available("azure_openai", {"AZURE_OPENAI_API_KEY": "x"})
    df = spark.createDataFrame([('say "hi"\n',)], "t string")
    body = json.loads(df.select(model_calls.provider("google", model="m").request(F.col("t"))).first()[0])
    assert body.keys() == {"contents", "generationConfig"} and body["generationConfig"] == {"temperature": 0.7, "maxOutputTokens": 4000}
    (content,) = body["contents"]
    assert content == {"parts": [dict(text='say "hi"\n')]}
    r = df.select(model_calls.provider("google", model="m").response(F.lit('{"candidates":[{"content":{"parts":[{"text":"x"}]}}]}'), F.lit(1)).alias("r")).first()["r"]
    assert r["conversion"]["model_version"] == "m" and r["conversion"]["tokens_used"] is None
    empty = df.select(model_calls.provider("open_ai").response(F.lit("{}"), F.lit(1)).alias("r")).first()["r"]
    assert empty["content"] is None and empty["error"]["kind"] == "conversion"


def test_transport_tries_again(spark):
    seen = []

    def flaky(method, url, headers, body, timeout):
        seen.append(1)
        return (503, "") if len(seen) < 3 else (200, "ok")

    got = Transport(flaky, attempts=3, delay_ms=1).get(spark.createDataFrame([("u",)], "url string"), "url", "r").first()["r"]
    assert (got["status"], got["body"], got["error"]) == (200, "ok", None)
    failed = Transport(stub, attempts=2, delay_ms=1).get(spark.createDataFrame([("bad",), (None,)], "url string").coalesce(1), "url", "r").collect()
    assert failed[0]["r"]["error"] == "status 403"


def test_settings(tmp_path):
    (tmp_path / "c.toml").write_text('default_provider = "google"\n[providers.google]\nenabled = true\nmodel = "g1"\ntemperature = 0.2\n[fallback]\nenabled = true\norder = ["ollama"]\n[browser]\ndomains = ["a.com"]\n')
    s = config.load(str(tmp_path / "c.toml"), {"LARDERFLOW__BROWSER__URL": "http://b", "LARDERFLOW__PROVIDERS__GOOGLE__MODEL": "g2", "LARDERFLOW__TIMEOUT": "5", "OTHER__X": "1"})
    assert (s.default_provider, s.browser_url, s.browser_domains, s.timeout) == ("google", "http://b", ["a.com"], 5)
    first, second = config.chain(s)
    assert (first.model, first.temperature, first.max_tokens, second.name) == ("g2", 0.2, 2000, "ollama")
    assert config.resolve(s, "anthropic", "m").max_tokens == 4000 and config.load(None, {}).default_provider == "open_ai"
    with pytest.raises(ValueError):
        config.resolve(s, "nobody")


def test_stream_equals_batch(spark, tmp_path):
    df = spark.createDataFrame([("u", ld(recipe())), ("v", CARD), ("w", "<p>x")], "url string, html string")
    df.repartition(2).write.parquet(f"{tmp_path}/in")
    q = stream.write(stream.recipes(stream.read_pages(spark, f"{tmp_path}/in", df.schema, 1)), f"{tmp_path}/out", f"{tmp_path}/cp")
    q.awaitTermination(120)
    key = lambda d: sorted(map(repr, d.select("url", "extractor", "components", "error").collect()))
    assert key(spark.read.parquet(f"{tmp_path}/out")) == key(pages_to_recipes(df))


def test_stream_drops_repeated_urls(spark, tmp_path):
    df = spark.sql("SELECT * FROM VALUES ('u', 'x', timestamp'2024-01-01 00:00:00'), ('u', 'x', timestamp'2024-01-01 00:01:00') AS t(url, html, ts)").coalesce(1)
    df.write.parquet(f"{tmp_path}/in")
    q = stream.write(stream.recipes(stream.read_pages(spark, f"{tmp_path}/in", df.schema), seen_within="1 hour", event_time="ts"), f"{tmp_path}/out", f"{tmp_path}/cp")
    q.awaitTermination(120)
    assert spark.read.parquet(f"{tmp_path}/out").count() == 1


def test_command_line(spark, tmp_path, monkeypatch, capsys):
    from larderflow import __main__ as cli

    monkeypatch.setattr(cli, "session", lambda master: spark)
    monkeypatch.setattr("larderflow.plans.config.Transport", lambda **k: CALLS)
    assert cli.main(["http://good.com/", "--extract-only"]) == 0
    assert capsys.readouterr().out == "---\ntitle: Stew\nsource: http://good.com/\n---\n\nStir.\n"
    (tmp_path / "t.txt").write_text("---\ntitle: T\n---\nx")
    assert cli.main(["--text", str(tmp_path / "t.txt"), "--provider", "anthropic"]) == 0
    assert "Mix @a{}." in capsys.readouterr().out
    assert cli.main(["http://bad.com/"]) == 1
    with pytest.raises(SystemExit):
        cli.main([])
