"""Extractors over small pages."""

import json

import pytest

from larderflow.operators import dom, html_class, json_repair, jsonld, microdata
from larderflow.plans.importer import pages_to_recipes


def ld(*scripts, body="<h1>Heading</h1>"):
    tags = "".join(f'<script type="application/ld+json">{s if isinstance(s, str) else json.dumps(s)}</script>' for s in scripts)
    return f"<html><head>{tags}</head><body>{body}</body></html>"


def recipe(**k):
    return {"name": "Stew", "@type": "Recipe"} | k


def read(spark, *pages):
    df = spark.createDataFrame([(i, f"http://h/{i}", p) for i, p in enumerate(pages)], "i int, url string, html string")
    rows = {r["i"]: r for r in pages_to_recipes(df).collect()}
    return [rows[i] for i in range(len(pages))]


def test_text_rules():
    assert dom.decode("<ul><li>one</li><li>two <b>bold</b>, x</li></ul>") == "one\ntwo bold, x"
    assert dom.decode("a &amp;lt;b&amp;gt; c") == "a c"
    assert dom.decode("plain &amp;amp; simple") == "plain & simple"
    assert dom.strip_tags("no tags  here ") == "no tags  here "
    assert dom.strip_tags("<p>a<br>b</p><p></p>c") == "a\nb\nc"
    assert dom.body_text(dom.parse("<body><p>a</p><p>b</p><script>c</script></body>")) == "a b c"


@pytest.mark.parametrize(("page", "want"), [("<p><b>a<br><p>b", "a b"), ("<ul><li>a<li>b</ul>c", "a b c"), ("<table><tr><td>a<td>b<tr><td>c</table>", "a b c"), ("<div>a</p>b</div>", "ab"), ("<i>a</b>c</i>", "ac"), ("", "")])
def test_tolerant_trees(page, want):
    assert " ".join(dom.parse(page).texts()) == want


def test_unclosed_elements_end_where_they_must():
    t = dom.parse("<ul><li>a<ul><li>b</ul><li>c</ul><p>d<div>e</div>")
    assert [n.text() for n in t.all(dom.tag("li"))] == ["a b", "b", "c"]
    assert t.first(dom.tag("p")).text() == "d"


def test_repair():
    assert json_repair.load('{"a":"x" "b":[1,2,],,"c":{"d":"e"} "f":"g",}') == {"a": "x", "b": [1, 2], "c": {"d": "e"}, "f": "g"}
    assert json_repair.load('[{"a":"b"},]') == [{"a": "b"}] and json_repair.load('{"a",:1}') == {"a": 1}
    assert json_repair.load('{"a":"b,,c"}') == {"a": "b,,c"}
    assert json_repair.load('{"a":"b,,c"}', strict_compat=True) == {"a": "b,c"}
    assert json_repair.load("{broken") is None and json_repair.load('{"a":NaN}') is None


def test_metadata(spark):
    full = recipe(author={"name": "Ann"}, recipeYield=4, recipeCategory=["Main", "Soup"], recipeCuisine="Thai", keywords="a, b", prepTime="PT10M", cookTime={"minValue": "PT5M", "maxValue": "PT20M"}, totalTime=7, suitableForDiet=["https://schema.org/VeganDiet", "GlutenFreeDiet"], nutrition={"calories": "240 kcal", "servingSize": "451"}, description="A <b>good</b> one", image=[{"url": "a.png"}, {"url": "b.png"}])
    c = read(spark, ld(full))[0]["components"]
    want = "description: A good one\nimage: a.png\nsource: http://h/0\nauthor: Ann\nservings: '4'\ncourse: Main, Soup\ncuisine: Thai\ntags: a, b\nprep time: 10 minutes\ncook time: 20 minutes\ndiet: Vegan, GlutenFree\nnutrition:\n  calories: 240 kcal\n  serving size: 451\n"
    assert (c["name"], c["metadata"], c["text"]) == ("Stew", want, "")
    bare = read(spark, ld(recipe(author=[{"@id": "#x"}], recipeYield="", suitableForDiet=[])))[0]["components"]["metadata"]
    assert bare == "source: http://h/0\ndiet: ''\n"


FIELDS = [
    ({"recipeYield": ["4", "4 bowls"]}, "servings", "4 bowls"), ({"recipeYield": ["4", "5"]}, "servings", "4"), ({"author": "Bo"}, "author", "Bo"), ({"author": [{"name": "A"}, {"@id": "x"}, {"name": "B"}]}, "author", "A, B"), ({"keywords": ["a", "b"]}, "tags", "a, b"),
]


@pytest.mark.parametrize(("fields", "key", "want"), FIELDS)
def test_polymorphic_metadata(fields, key, want):
    assert {e["k"]: e["v"] for e in jsonld.read(recipe(**fields), "u")["meta"]}[key] == want


def step(**k):
    return k | {"@type": "HowToStep"}


def section(name, *items):
    return {"name": name, "itemListElement": list(items), "@type": "HowToSection"}


STEPS = [
    ("Mix &amp; bake", "Mix & bake"), (["a", "b"], "a\n\nb"), ([{"text": "a", "name": "n"}, {"text": "b"}], "a\n\nb"), ([step(name="n", description="d")], "n\n\nd"), ([], ""), (None, ""),
    ([section("Süß:", {"text": "x"}, {"name": "y"}), step(text="z")], "\n## Süß\n\nx\n\ny\n\nz"), ([[section("S", {"text": "x"})]], "## S\n\nx"),
]


@pytest.mark.parametrize(("value", "want"), STEPS)
def test_instruction_shapes(value, want):
    assert jsonld.read(recipe(recipeInstructions=value), "u")["instructions"] == want


@pytest.mark.parametrize("fields", [{"recipeYield": ["4", 4]}, {"recipeYield": 1.5}, {"nutrition": {"calories": 3}}, {"recipeIngredient": ["a", 1]}, {"recipeInstructions": [{"@type": "Other"}]}, {"keywords": 3}, {"image": ["a", {"url": "b"}]}, {"name": 3}, {"recipeInstructions": [["x"]]}])
def test_one_wrong_type_refuses_all(fields):
    assert jsonld.read(recipe(**fields), "u") is None


def test_ingredients():
    assert jsonld.read(recipe(recipeIngredient=["1 &frac12; cup", " ", "<b>salt</b>"]), "u")["ingredients"] == ["1 ½ cup", "salt"]
    assert jsonld.read(recipe(recipeIngredient=[{"name": "flour", "amount": " 2 cups "}, {"name": "salt"}, {"name": " ", "amount": "1"}]), "u")["ingredients"] == ["2 cups flour", "salt"]


def test_node_selection(spark):
    r = recipe()
    pages = [
        ld({"@graph": [{"@type": "WebPage"}, r]}), ld([{"@type": "Thing"}, {"recipeInstructions": "x", "name": "untyped"}]), ld({**r, "@type": ["Thing", "RECIPE"]}), ld({"@type": "Thing"}), ld("{broken", {**r, "name": 5}, {**r, "name": "third"}),
        ld({"headline": "H", "@type": "recipe"}), ld({**r, "headline": "H"}), ld({"@graph": {"@type": "Recipe"}}), ld({"@type": "Recipe"}),
    ]
    got = [(x["extractor"], x["components"]["name"] if x["components"] else None) for x in read(spark, *pages)]
    assert got == [("jsonld", "Stew"), ("jsonld", "untyped"), ("jsonld", "Stew"), (None, None), ("jsonld", "third"), ("jsonld", "H"), ("jsonld", "Stew"), (None, None), ("jsonld", "")]


CARD = '<div itemtype="https://schema.org/Recipe" itemscope><h1 itemprop="name">Pie</h1><p itemprop="description">Nice.</p><img itemprop="image" src="i.png"><div itemprop="author" itemscope>by <b itemprop="name">Q</b></div><time itemprop="cookTime" datetime="PT1H">one hour</time><meta itemprop="recipeYield" content="4"><ul><li itemprop="ingredients">flour<li itemprop="ingredients"> <li itemprop="ingredients">egg</ul><p itemprop="recipeInstructions">Mix.<p itemprop="recipeInstructions">Bake.</div>'


def test_microdata(spark):
    r, empty_name, no_name, no_parts = read(spark, CARD, CARD.replace(">Pie<", "><"), CARD.replace('itemprop="name">Pie', ">Pie").replace('<b itemprop="name">', "<b>"), '<div itemtype="http://data-vocabulary.org/Recipe" itemscope><b itemprop="name">x</b></div>')
    assert r["extractor"] == "microdata"
    assert tuple(r["components"]) == ("flour\negg\n\nMix.\n\nBake.", "description: Nice.\nimage: i.png\nauthor: Q\ncook_time: one hour\nsource_url: http://h/0\n", "Pie")
    assert empty_name["extractor"] == "microdata" and empty_name["components"]["name"] == ""
    assert no_name["extractor"] is None and no_parts["extractor"] is None
    assert microdata.extract(dom.parse("<p>x"), "u") is None


def test_class_tables():
    n = {f: len(v) for f, v in html_class.EXACT.items()}
    assert n == {"title": 18, "description": 14, "ingredients": 19, "instructions": 21, "prep_time": 11, "cook_time": 11, "total_time": 11, "servings": 12, "notes": 11}
    assert html_class.EXACT["ingredients"][0].endswith("-container") and html_class.EXACT["ingredients"][1] == "wprm-recipe-ingredient"
    assert all(len(set(v)) == len(v) for v in html_class.EXACT.values())


def test_html_classes(spark):
    groups = '<h2 class="tasty-recipes-title">T</h2><div class="recipe-ingredients"><p>two cups of rice</p><p>tiny</p><p>two spoons</p></div><div class="recipe-instruction-group"><h4>Part one:</h4><ul><li>s1<li>s2</ul></div><div class="recipe-instruction-group"><h3></h3><b class="group-name">Two</b><ol><li>s3</ol></div><i class="prep-time">5 min</i><div class="recipe-tips">Rest it.</div>'
    fuzzy = '<b class="my-recipe-thing">Fuzzy name</b><h1>Other</h1><div class="recipe-directions"><li>go</li></div>'
    long = '<b class="x-title">' + "y" * 5000 + '</b><h1>Short</h1><div class="directions"><span>' + "z" * 499 + "</span><span>" + "é" * 250 + "</span></div>"
    a, b, c, none = read(spark, groups, fuzzy, long, "<h1>t</h1><p>text")
    assert tuple(a["components"]) == ("two cups of rice\ntwo spoons\n\n## Part one\n\ns1\n\ns2\n\n## Two\n\ns3", "prep_time: 5 min\nnotes: Rest it.\nsource_url: http://h/0\n", "T")
    assert b["components"]["name"].startswith("Fuzzy name") and b["extractor"] == "html_class"
    assert c["components"]["name"] == "Short" and c["components"]["text"] == "z" * 499
    assert none["extractor"] is None and none["error"]["kind"] == "no_extractor"


def test_chain_takes_the_first_that_succeeds(spark):
    card = '<h1 class="recipe-title">C</h1><div class="directions"><li>x</li></div>'
    got = read(spark, ld(recipe(), body=CARD + card), ld(recipe(recipeYield=1.5), body=CARD + card), card, None)
    assert [r["extractor"] for r in got] == ["jsonld", "microdata", "html_class", None]
