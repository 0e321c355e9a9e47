"""Queries over the test tables, each with the statement that gives the same rows in SQL.

The tables hold no recipes, so most queries build pages, payloads or texts from base columns, run the engine over them, and the SQL computes what must come
out straight from the base columns.
"""

from __future__ import annotations

import base64
import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions.duration import duration_clean, duration_phrase
from .functions.hosts import in_domains, url_host
from .functions.text import assemble, base64_text, clean_diet, components_text, entry_value, frontmatter_split, full_text, metadata_yaml, sanitize_name, text_components
from .operators.extract import body_text, decoded, heading, jsonld_scripts, spread, with_recipes
from .operators.model_calls import PROMPT, STOP_WORDS, UNKNOWN_LANGUAGE, detect_language, extraction_components, prompt, provider
from .plans.config import Settings, chain
from .plans.importer import frontmatter, images_to_recipes, pages_to_recipes, texts_to_recipes
from .schema import RECIPE
from .sources.images import merge, ocr_request, ocr_text, raw_components
from .sources.pages import with_route
from .sources.transport import Transport

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def q(s: str) -> str:
    """A text as an SQL literal."""
    return "'" + s.replace("'", "''") + "'"


_DOMAINS = ["example.net", "m.thther.example.org"]
_IN = " OR ".join(f"h = {q(d)} OR ends_with(h, {q('.' + d)})" for d in _DOMAINS)
_HOST = "coalesce(split_part(split_part(url, '//', 2), '/', 1), '')"


@query(f"WITH p AS (SELECT page_id, {_HOST} AS h FROM pages) SELECT page_id, h AS host, ({_IN}) AS listed, CASE WHEN {_IN} THEN 'browser' ELSE 'request' END AS route FROM p")
def host_route(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Host, domain list and transport of each page."""
    p = with_route(table(spark, sf_dir, "pages"), _DOMAINS, "http://browser.local")
    return p.select("page_id", url_host("url").alias("host"), in_domains(url_host("url"), _DOMAINS).alias("listed"), "route")


_PHRASE = "CASE WHEN h > 0 THEN h || ' hour' || CASE h WHEN 1 THEN '' ELSE 's' END ELSE '' END || CASE WHEN h > 0 AND m > 0 THEN ' ' ELSE '' END || CASE WHEN m > 0 THEN m || ' minute' || CASE m WHEN 1 THEN '' ELSE 's' END ELSE '' END"


@query(f"""WITH l AS (SELECT l_orderkey, l_linenumber, CAST(l_quantity AS BIGINT) AS n, l_linenumber % 5 AS form FROM lineitem),
t AS (SELECT *, CASE form WHEN 2 THEN n * 7 WHEN 3 THEN CAST(round(n * 97 / 60.0) AS BIGINT) ELSE n END AS total FROM l),
u AS (SELECT *, total // 60 AS h, total % 60 AS m FROM t)
SELECT l_orderkey, l_linenumber, CASE form WHEN 0 THEN n || ' hour' || CASE n WHEN 1 THEN '' ELSE 's' END
 WHEN 1 THEN n || '-' || (n + 5) || ' minutes' WHEN 4 THEN 'about ' || n ELSE {_PHRASE} END AS phrase,
 CASE form WHEN 0 THEN n || ' hour' || CASE n WHEN 1 THEN '' ELSE 's' END WHEN 1 THEN n || '-' || (n + 5) || ' minutes' WHEN 4 THEN 'about ' || n ELSE {_PHRASE} END AS clean FROM u""")
def duration_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Durations in hours, ranges, minutes, seconds and free text."""
    n = F.col("l_quantity").cast("bigint")
    form = F.col("l_linenumber") % 5
    text = (
        F.when(form == 0, F.concat(F.lit("PT"), n, F.lit("H"))).when(form == 1, F.concat(F.lit("PT"), n, F.lit("-"), n + 5, F.lit("M")))
        .when(form == 2, F.concat(F.lit("PT"), n * 7, F.lit("M"))).when(form == 3, F.concat(F.lit("PT"), n * 97, F.lit(".0S"))).otherwise(F.concat(F.lit("about "), n))
    )
    d = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", text.alias("t"))
    return d.select("l_orderkey", "l_linenumber", duration_phrase("t").alias("phrase"), duration_clean("t").alias("clean"))


@query("SELECT p_partkey, replace(p_type, ' ', '') AS diet FROM part")
def diet_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Schema.org diet names."""
    base = F.when(F.col("p_partkey") % 2 == 0, "https://schema.org/").otherwise("http://schema.org/")
    t = F.concat(base, F.replace("p_type", F.lit(" "), F.lit("")), F.lit("Diet"))
    return table(spark, sf_dir, "part").select("p_partkey", clean_diet(t).alias("diet"))


@query("SELECT doc_id, trim(regexp_replace(text, '\\s+', ' ', 'g')) AS name FROM documents")
def name_whitespace(spark: SparkSession, sf_dir: str) -> DataFrame:
    """T1 over whole texts."""
    return table(spark, sf_dir, "documents").select("doc_id", sanitize_name("text").alias("name"))


@query("SELECT o_orderkey, 'Order ' || o_orderkey AS name, 'status: ' || o_orderstatus || chr(10) || 'priority: ' || o_orderpriority AS metadata, chr(10) || 'total ' || o_custkey AS body, o_orderpriority AS priority, 'no marks ' || o_orderkey AS plain FROM orders")
def frontmatter_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts with front matter, and one without."""
    t = F.concat(F.lit("---\ntitle: Order "), "o_orderkey", F.lit("\nstatus: "), "o_orderstatus", F.lit("\nno entry\npriority: "), "o_orderpriority", F.lit("\n---\n\ntotal "), "o_custkey")
    d = table(spark, sf_dir, "orders").withColumn("t", t)
    d = d.withColumns({"c": text_components(F.col("t")), "s": frontmatter_split(F.col("t"))})
    c, s = F.col("c"), F.col("s")
    bare = text_components(F.concat(F.lit("no marks "), "o_orderkey"))
    return d.select("o_orderkey", c["name"].alias("name"), c["metadata"].alias("metadata"), c["text"].alias("body"), entry_value(s["entries"], "priority").alias("priority"), bare["text"].alias("plain"))


_NAMED = [("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", "\xa0"), ("&copy;", "©"), ("&eacute;", "é"), ("&uuml;", "ü"), ("&mdash;", "—"), ("&hellip;", "…"), ("&amp;", "&")]


def _unescape(x: str) -> str:
    for a, b in _NAMED:
        x = f"replace({x}, {q(a)}, {q(b)})"
    return x


@query(f"SELECT page_id, trim({_unescape('''regexp_extract(html, '<h1[^>]*>([^<]*)</h1>', 1)''')}) AS heading FROM pages")
def page_heading(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First heading of the driver's own pages."""
    return table(spark, sf_dir, "pages").select("page_id", heading("html").alias("heading"))


@query()
def page_body_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """H4: body texts; tested against a fixture."""
    return table(spark, sf_dir, "pages").select("page_id", body_text("html").alias("text"))


@query("SELECT p_partkey, p_name || chr(10) || 'size ' || p_size || ' & more' || chr(10) || p_brand || ', ' || p_type AS text, p_name AS plain FROM part")
def html_strip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """H5-H8: double entities, blocks, inline elements and punctuation."""
    t = F.concat(F.lit("<p>"), "p_name", F.lit("</p><ul><li> size <b>"), F.col("p_size").cast("string"), F.lit("</b> &amp;amp; more</li></ul><br><i>"), "p_brand", F.lit("</i>, "), "p_type")
    return spread(table(spark, sf_dir, "part"), "p_partkey").select("p_partkey", decoded(t).alias("text"), decoded(F.col("p_name")).alias("plain"))


def page(script: F.Column) -> F.Column:
    return F.concat(F.lit('<!DOCTYPE html><html><head><title>x</title><script id="r" type="application/ld+json">'), script, F.lit("</script></head><body><h1>Fallback</h1></body></html>"))


def _parts(d: DataFrame, key: str) -> DataFrame:
    r = pages_to_recipes(d)
    return r.select(key, "extractor", F.col("components.name").alias("name"), F.col("components.metadata").alias("metadata"), F.col("components.text").alias("text"))


@query("""WITH i AS (SELECT l_orderkey AS o, string_agg(CAST(l_quantity AS BIGINT) || ' x part ' || l_partkey || chr(10), '' ORDER BY l_linenumber, l_quantity, l_partkey, l_returnflag) AS lines,
 string_agg('Ship by ' || l_returnflag || '.', chr(10) || chr(10) ORDER BY l_linenumber, l_quantity, l_partkey, l_returnflag) AS steps FROM lineitem GROUP BY l_orderkey)
SELECT o_orderkey, 'jsonld' AS extractor, 'Order ' || o_orderkey AS name, 'source: http://orders.example/' || o_orderkey || chr(10) || 'author: Clerk ' || o_custkey || chr(10) || 'servings: ''' || (o_custkey % 12 + 1) || '''' || chr(10)
 || 'course: ' || o_orderpriority || chr(10) || 'prep time: ' || (o_custkey % 59 + 1) || ' minute' || CASE WHEN o_custkey % 59 = 0 THEN '' ELSE 's' END || chr(10) AS metadata, lines || chr(10) || steps AS text
FROM orders JOIN i ON o = o_orderkey""")
def jsonld_recipe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A page for each order, its line items as ingredients and steps."""
    w = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("l_linenumber", F.col("l_quantity").cast("bigint").alias("n"), "l_partkey", "l_returnflag"))).alias("i"))
    o = table(spark, sf_dir, "orders").join(w, F.col("l_orderkey") == F.col("o_orderkey"))
    things = F.transform("i", lambda x: F.concat(x["n"], F.lit(" x part "), x["l_partkey"]))
    steps = F.transform("i", lambda x: F.concat(F.lit("Ship by "), x["l_returnflag"], F.lit(".")))
    j = F.struct(
        F.lit("Recipe").alias("@type"), F.concat(F.lit("Order  "), "o_orderkey").alias("name"), F.struct(F.concat(F.lit("Clerk "), "o_custkey").alias("name")).alias("author"), (F.col("o_custkey") % 12 + 1).cast("int").alias("recipeYield"),
        F.array("o_orderpriority").alias("recipeCategory"), F.concat(F.lit("PT"), F.col("o_custkey") % 59 + 1, F.lit("M")).alias("prepTime"), things.alias("recipeIngredient"), steps.alias("recipeInstructions"),
    )
    d = o.select("o_orderkey", F.concat(F.lit("http://orders.example/"), "o_orderkey").alias("url"), page(F.to_json(j)).alias("html"))
    return _parts(d, "o_orderkey")


@query("""SELECT p_partkey, CASE WHEN p_partkey % 5 < 4 THEN 'jsonld' END AS extractor, CASE WHEN p_partkey % 5 < 4 THEN p_name END AS name FROM part""")
def jsonld_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An object, a root array, a graph, types in lists and other cases; other types give nothing."""
    k = F.col("p_partkey") % 5
    node = lambda t: F.to_json(F.struct(t.alias("@type"), F.col("p_name").alias("name")))
    other = F.lit('{"@type":"Thing","name":"other"}')
    s = (
        F.when(k == 0, node(F.lit("rEcIpE"))).when(k == 1, F.concat(F.lit("["), other, F.lit(","), node(F.lit("Recipe")), F.lit("]")))
        .when(k == 2, F.concat(F.lit('{"@graph":['), other, F.lit(","), node(F.lit("recipe")), F.lit("]}")))
        .when(k == 3, node(F.array(F.lit("NewsArticle"), F.lit("RECIPE")))).otherwise(node(F.lit("RecipeList")))
    )
    d = spread(table(spark, sf_dir, "part"), "p_partkey").select("p_partkey", F.lit("u").alias("url"), page(s).alias("html"))
    return _parts(d, "p_partkey").select("p_partkey", "extractor", "name")


@query("""SELECT p_partkey, CASE p_partkey % 6 WHEN 0 THEN p_name WHEN 1 THEN p_name || chr(10) || chr(10) || p_brand WHEN 2 THEN p_name || chr(10) || chr(10) || p_brand
 WHEN 3 THEN p_name || chr(10) || chr(10) || p_type WHEN 4 THEN '## ' || p_brand || chr(10) || chr(10) || p_name || chr(10) || chr(10) || p_type ELSE '## ' || p_brand || chr(10) || chr(10) || p_name END AS text FROM part""")
def jsonld_instructions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A string, strings, texts, steps, sections and nested sections."""
    k = F.col("p_partkey") % 6
    text, name, brand, kind = (lambda key, c: F.struct(F.col(c).alias(key))), "p_name", "p_brand", "p_type"
    step = F.struct(F.lit("HowToStep").alias("@type"), F.col(name).alias("name"), F.col(kind).alias("description"))
    section = F.struct(F.lit("HowToSection").alias("@type"), F.concat(brand, F.lit("::")).alias("name"), F.array(F.struct(F.col(name).alias("text"), F.col(kind).alias("description"))).alias("itemListElement"))
    nested = F.struct(F.lit("HowToSection").alias("@type"), F.concat(brand, F.lit(":")).alias("name"), F.array(text("text", name)).alias("itemListElement"))
    wrap = lambda v: F.to_json(F.struct(F.lit("Recipe").alias("@type"), v.alias("recipeInstructions")))
    s = (
        F.when(k == 0, wrap(F.col(name))).when(k == 1, wrap(F.array(name, brand))).when(k == 2, wrap(F.array(text("text", name), text("text", brand))))
        .when(k == 3, wrap(F.array(step))).when(k == 4, wrap(F.array(section))).otherwise(wrap(F.array(F.array(nested))))
    )
    d = spread(table(spark, sf_dir, "part"), "p_partkey").select("p_partkey", F.lit("u").alias("url"), page(s).alias("html"))
    return _parts(d, "p_partkey").select("p_partkey", "text")


@query("SELECT s_suppkey, s_suppkey % 4 = 0 AS found FROM supplier")
def jsonld_reject(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All or nothing: one field of a wrong type refuses the whole object."""
    k = F.col("s_suppkey") % 4
    bad = F.when(k == 0, '"recipeYield":[]').when(k == 1, '"recipeYield":["4",4]').when(k == 2, '"nutrition":{"calories":12}').otherwise('"recipeIngredient":["a",null]')
    s = F.concat(F.lit('{"@type":"Recipe","name":"'), "s_name", F.lit('",'), bad, F.lit("}"))
    d = spread(table(spark, sf_dir, "supplier"), "s_suppkey").select("s_suppkey", F.lit("u").alias("url"), page(s).alias("html"))
    return pages_to_recipes(d).select("s_suppkey", F.col("components").isNotNull().alias("found"))


@query("SELECT s_suppkey, s_name AS name, 'x ' || s_suppkey || chr(10) || 'y' || chr(10) AS text FROM supplier")
def jsonld_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Missing and superfluous commas; an unreadable script before the one that counts."""
    k = F.col("s_suppkey") % 3
    head = F.concat(F.lit('{"@type":"Recipe"'), F.when(k == 0, " ").when(k == 1, ",,").otherwise(", "), F.lit('"name":"'), "s_name", F.lit('"'))
    rest = F.concat(F.when(k == 0, "\n").otherwise(","), F.lit('"recipeIngredient":["x '), "s_suppkey", F.when(k == 0, '" "y"]').when(k == 1, '","y",]').otherwise('","y"]'), F.lit("}"))
    two = F.concat(F.lit('<script type="application/ld+json">{broken</script>'), page(F.concat(head, rest)))
    d = spread(table(spark, sf_dir, "supplier"), "s_suppkey").select("s_suppkey", F.lit("u").alias("url"), two.alias("html"))
    return _parts(d, "s_suppkey").select("s_suppkey", "name", "text")


@query("SELECT count(*) AS pages, sum(p_partkey % 3) AS scripts FROM part")
def jsonld_script_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """J1 natively: scripts of a page."""
    one = '<script type="application/ld+json">{}</script>'
    d = table(spark, sf_dir, "part").select(F.size(jsonld_scripts(F.repeat(F.lit(one), (F.col("p_partkey") % 3).cast("int")))).alias("n"))
    return d.agg(F.count(F.lit(1)).alias("pages"), F.sum("n").alias("scripts"))


@query("""SELECT p_partkey, 'source: u' || chr(10) || 'nutrition:' || chr(10) || '  calories: ' || p_size || ' kcal' || chr(10) || '  fat: ' || p_partkey || ' g' || chr(10) || CASE WHEN p_partkey % 2 = 0 THEN '  serving size: ' || p_size || chr(10) ELSE '' END AS metadata FROM part""")
def nutrition_yaml(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nested nutrition block."""
    n = F.struct(F.concat(F.col("p_size").cast("string"), F.lit(" kcal")).alias("calories"), F.concat(F.col("p_partkey").cast("string"), F.lit(" g")).alias("fatContent"), F.when(F.col("p_partkey") % 2 == 0, F.col("p_size").cast("string")).alias("servingSize"))
    s = F.to_json(F.struct(F.lit("Recipe").alias("@type"), F.lit("n").alias("name"), n.alias("nutrition")))
    d = spread(table(spark, sf_dir, "part"), "p_partkey").select("p_partkey", F.lit("u").alias("url"), page(s).alias("html"))
    return _parts(d, "p_partkey").select("p_partkey", "metadata")


@query("SELECT c_custkey, 'k: ' || CASE c_custkey % 4 WHEN 0 THEN c_name WHEN 1 THEN '''' || c_custkey || '''' WHEN 2 THEN '''' || c_mktsegment || ': ' || c_name || '''' ELSE '|-' || chr(10) || '  ' || c_name || chr(10) || '  ' || c_mktsegment END || chr(10) AS yaml FROM customer")
def yaml_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Plain, number-like, colon and several-line values; a repeated key takes its last value."""
    k = F.col("c_custkey") % 4
    v = F.when(k == 0, F.col("c_name")).when(k == 1, F.col("c_custkey").cast("string")).when(k == 2, F.concat("c_mktsegment", F.lit(": "), "c_name")).otherwise(F.concat("c_name", F.lit("\n"), "c_mktsegment"))
    e = lambda x: F.struct(F.lit("k").alias("k"), x.alias("v"))
    return table(spark, sf_dir, "customer").select("c_custkey", metadata_yaml(F.array(e(F.lit("first")), e(v))).alias("yaml"))


@query("""SELECT s_suppkey, 'microdata' AS extractor, s_name AS name, 'image: i' || s_suppkey || '.png' || chr(10) || 'author: nation ' || s_nationkey || chr(10) || 'prep_time: ' || (s_suppkey % 50) || ' min' || chr(10) || 'source_url: u' || chr(10) AS metadata,
 'salt ' || s_suppkey || chr(10) || 'water' || chr(10) || chr(10) || 'Boil.' || chr(10) || chr(10) || 'Serve ' || s_suppkey || '.' AS text FROM supplier""")
def microdata_recipe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Unclosed list items and paragraphs included."""
    h = F.concat(
        F.lit('<body><div itemtype="https://schema.org/Recipe" itemscope><h2 itemprop="name"> '), "s_name", F.lit(' </h2><img itemprop="image" src="i'), "s_suppkey", F.lit('.png"><p itemprop="author" itemscope><span itemprop="name">nation '),
        F.col("s_nationkey").cast("string"), F.lit('</span> and others<p><time itemprop="prepTime" datetime="PT5M">'), F.col("s_suppkey") % 50, F.lit(' min</time><ul><li itemprop="recipeIngredient">salt '), "s_suppkey",
        F.lit('<li itemprop="recipeIngredient">water</ul><p itemprop="recipeInstructions">Boil.<p itemprop="recipeInstructions">Serve '), "s_suppkey", F.lit(".</div></body>"),
    )
    return _parts(spread(table(spark, sf_dir, "supplier"), "s_suppkey").select("s_suppkey", F.lit("u").alias("url"), h.alias("html")), "s_suppkey")


@query("""SELECT c_custkey, 'html_class' AS extractor, c_name AS name, 'servings: ''' || (c_custkey % 9) || '''' || chr(10) || 'source_url: u' || chr(10) AS metadata, 'one of ' || c_mktsegment || chr(10) || 'two cups' || chr(10) || chr(10)
 || CASE WHEN c_custkey % 2 = 0 THEN '## Part ' || c_custkey || chr(10) || chr(10) ELSE '' END || 'Stir and wait.' AS text FROM customer""")
def html_class_recipe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Plug-in classes with groups, and generic ones whose items are paragraphs."""
    a = F.concat(F.lit('<h1 class="wprm-recipe-name x">'), "c_name", F.lit('</h1><span class="wprm-recipe-servings">'), F.col("c_custkey") % 9, F.lit('</span><section class="wprm-recipe-ingredients-container x"><ol><li>one of '), "c_mktsegment", F.lit('</li><li>two cups</li></ol></section><div class="wprm-recipe-instruction-group"><h4 class="wprm-recipe-group-name">Part '), "c_custkey", F.lit(":</h4><ul><li>Stir and wait.</li></ul></div>"))
    b = F.concat(F.lit('<h1 class="recipe-title">'), "c_name", F.lit('</h1><b class="recipe-servings">'), F.col("c_custkey") % 9, F.lit('</b><div class="recipe-ingredients"><p>one of '), "c_mktsegment", F.lit('</p><p>two cups</p><p>few</p></div><div class="directions"><span>Stir and wait.</span></div>'))
    h = F.when(F.col("c_custkey") % 2 == 0, a).otherwise(b)
    d = spread(table(spark, sf_dir, "customer"), "c_custkey").select("c_custkey", F.lit("u").alias("url"), h.alias("html"))
    # a paragraph of three letters is too short for an item
    return _parts(d, "c_custkey")


@query("""WITH k AS (SELECT CASE p_partkey % 3 WHEN 0 THEN 'jsonld' WHEN 1 THEN 'microdata' ELSE 'html_class' END AS extractor, count(*) AS n FROM part GROUP BY 1)
SELECT extractor, n FROM k UNION ALL SELECT 'none', count(*) FROM pages""")
def extractor_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Recipes per extractor over a mixture that also holds the driver's pages, which have none."""
    k = F.col("p_partkey") % 3
    ld = page(F.concat(F.lit('{"@type":"Recipe","name":"a"}</script><div itemtype="http://schema.org/Recipe" itemscope><script>')))
    md = F.lit('<div itemtype="http://data-vocabulary.org/Recipe" itemscope><b itemprop="name"></b><b itemprop="instructions">x</b></div><h1>t</h1>')
    hc = F.lit('<div itemtype="http://schema.org/Recipe" itemscope><b itemprop="name">no parts</b></div><h2>t</h2><div class="recipe-directions"><li>x</li></div>')
    made = spread(table(spark, sf_dir, "part"), "p_partkey").select(F.lit("u").alias("url"), F.when(k == 0, ld).when(k == 1, md).otherwise(hc).alias("html"))
    d = with_recipes(made.unionByName(table(spark, sf_dir, "pages").select("url", "html")))
    return d.groupBy(F.coalesce("extractor", F.lit("none")).alias("extractor")).agg(F.count(F.lit(1)).alias("n"))


_COUNTS = ", ".join(f"len(list_filter(w, lambda x: x IN ({', '.join(q(x) for x in s.split())})))" for s in STOP_WORDS.values())
_NAMES = ", ".join(q(x) for x in STOP_WORDS)


@query(f"""WITH t AS (SELECT doc_id, lang, regexp_split_to_array(lower(text), '[^\\p{{L}}]+') AS w FROM documents), c AS (SELECT doc_id, lang, [{_COUNTS}] AS n FROM t)
SELECT doc_id, lang, CASE WHEN list_max(n) > 0 THEN [{_NAMES}][list_position(n, list_max(n))] ELSE {q(UNKNOWN_LANGUAGE)} END AS language FROM c""")
def language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """T9 over whole texts."""
    return table(spark, sf_dir, "documents").select("doc_id", "lang", detect_language(F.col("text")).alias("language"))


@query(f"SELECT conv_id, turn, replace(replace({q(PROMPT)}, '{{{{RECIPE}}}}', text || ' {{{{LANGUAGE}}}}'), '{{{{LANGUAGE}}}}', 'Latin') AS prompt FROM conversations")
def prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language's mark is replaced in the recipe too."""
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", prompt(F.concat("text", F.lit(" {{LANGUAGE}}")), F.lit("Latin")).alias("prompt"))


_REQUESTS = {"open_ai": ("$.messages[0].content", "$.max_tokens", "$.model"), "anthropic": ("$.messages[0].content", "$.max_tokens", "$.model"), "google": ("$.contents[0].parts[0].text", "$.generationConfig.maxOutputTokens", None), "ollama": ("$.messages[0].content", "$.max_tokens", "$.model"), "azure_openai": ("$.messages[0].content", "$.max_tokens", "$.model")}


def _some(name: str):
    return provider(name, model="m-1", max_tokens=77, options={"endpoint": "https://e", "deployment_name": "d"})


@query(" UNION ALL ".join(f"SELECT conv_id, turn, {q(n)} AS provider, text AS content, 77 AS most, {q('m-1') if p[2] else 'NULL'} AS model FROM conversations" for n, p in _REQUESTS.items()))
def model_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Request bodies of all providers, read again."""
    d = table(spark, sf_dir, "conversations")
    out = None
    for n, (content, most, model) in _REQUESTS.items():
        r = _some(n).request(F.col("text"))
        one = d.select("conv_id", "turn", F.lit(n).alias("provider"), F.get_json_object(r, content).alias("content"), F.get_json_object(r, most).cast("int").alias("most"), (F.get_json_object(r, model) if model else F.lit(None).cast("string")).alias("model"))
        out = one if out is None else out.unionByName(one)
    return out


@query(" UNION ALL ".join(f"""SELECT conv_id, turn, {q(n)} AS provider, CASE WHEN turn % 3 < 2 THEN text END AS content, CASE WHEN turn % 3 < 2 THEN 'v' || conv_id END AS model, CASE WHEN turn % 3 = 0 THEN turn END AS input_tokens,
 CASE WHEN turn % 3 = 2 THEN {q(e)} END AS error FROM conversations""" for n, e in (("open_ai", "message"), ("anthropic", "kind: message"), ("google", "429: message"), ("ollama", "message"))))
def model_responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Responses with and without usage, and errors."""
    d = table(spark, sf_dir, "conversations").withColumns({"v": F.concat(F.lit("v"), "conv_id"), "k": F.col("turn") % 3})
    text, n = F.col("text"), F.when(F.col("k") == 0, F.col("turn"))
    usage = lambda a, b: F.when(n.isNotNull(), F.struct(n.alias(a), n.alias(b)))
    chat = F.to_json(F.struct(F.col("v").alias("model"), F.array(F.struct(F.struct(text.alias("content")).alias("message"))).alias("choices"), usage("prompt_tokens", "completion_tokens").alias("usage")))
    claude = F.to_json(F.struct(F.col("v").alias("model"), F.array(F.struct(text.alias("text"))).alias("content"), usage("input_tokens", "output_tokens").alias("usage")))
    gem = F.to_json(F.struct(F.col("v").alias("modelVersion"), F.array(F.struct(F.struct(F.array(F.struct(text.alias("text"))).alias("parts")).alias("content"))).alias("candidates"), usage("promptTokenCount", "candidatesTokenCount").alias("usageMetadata")))
    forms = {"open_ai": (chat, '{"error":{"message":"message"}}'), "anthropic": (claude, '{"error":{"type":"kind","message":"message"}}'), "google": (gem, '{"error":{"code":429,"message":"message"}}'), "ollama": (chat, '{"error":"message"}')}
    out = None
    for name, (good, bad) in forms.items():
        r = d.withColumn("r", _some(name).response(F.when(F.col("k") < 2, good).otherwise(bad), F.lit(5)))
        one = r.select("conv_id", "turn", F.lit(name).alias("provider"), "r.content", F.col("r.conversion.model_version").alias("model"), F.col("r.conversion.tokens_used.input_tokens").alias("input_tokens"), F.col("r.error.message").alias("error"))
        out = one if out is None else out.unionByName(one)
    return out


@query("""SELECT o_orderkey, CASE WHEN o_orderkey % 4 <> 3 THEN 'Dish ' || o_orderkey END AS name, CASE WHEN o_orderkey % 4 <> 3 THEN 'source: s' || chr(10) || CASE WHEN o_orderkey % 4 = 0 THEN 'servings: four' || chr(10) ELSE '' END || 'prep_time: ' || o_orderkey || ' min' || chr(10) END AS metadata,
 CASE WHEN o_orderkey % 4 <> 3 THEN 'a ' || o_custkey || chr(10) || 'b' || chr(10) || chr(10) || 'Do. Then do.' END AS text, CASE WHEN o_orderkey % 4 = 3 THEN 'none ' || o_orderkey END AS error FROM orders""")
def model_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Payloads with nulls, items that aren't strings, and errors."""
    k = F.col("o_orderkey") % 4
    j = F.concat(
        F.lit('{"title":"Dish '), "o_orderkey", F.lit('","servings":'), F.when(k == 0, '"four"').when(k == 1, "null").otherwise("4"), F.lit(',"prep_time":"'), "o_orderkey", F.lit(' min","cook_time":"","ingredients":["a '), "o_custkey",
        F.lit('",7,"b"],"instructions":["Do.","Then do."],"error":'), F.when(k == 3, F.concat(F.lit('"none '), "o_orderkey", F.lit('"'))).when(k == 1, '""').otherwise("null"), F.lit("}"),
    )
    d = table(spark, sf_dir, "orders").withColumn("r", extraction_components(j, F.lit("s")))
    return d.select("o_orderkey", "r.components.name", "r.components.metadata", "r.components.text", F.col("r.error.message").alias("error"))


@query("""SELECT c_custkey, CASE c_custkey % 3 WHEN 0 THEN 'Mix.' WHEN 1 THEN '---' || chr(10) || 'title: ''' || c_custkey || '''' || chr(10) || 'a: b' || chr(10) || '---' || chr(10) || chr(10) || 'Mix.' ELSE '---' || chr(10) || 'a: b' || chr(10) || '---' || chr(10) || chr(10) || 'Mix.' END AS content,
 CASE c_custkey % 3 WHEN 1 THEN '---' || chr(10) || 'title: ' || c_custkey || chr(10) || 'a: b' || chr(10) || '---' || chr(10) || chr(10) || 'Mix.' END AS raw FROM customer""")
def markup_assembly(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Titles that need quotes, missing titles, nothing at all; the raw title of the command line."""
    k = F.col("c_custkey") % 3
    c = F.struct(F.lit("Mix.").alias("text"), F.when(k == 0, "").when(k == 1, "a: b").otherwise("a: b\n").alias("metadata"), F.when(k == 1, F.col("c_custkey").cast("string")).otherwise("").alias("name"))
    d = table(spark, sf_dir, "customer").select("c_custkey", c.alias("components"))
    raw = frontmatter(d, raw_title=True).select(F.col("c_custkey").alias("i"), F.col("content").alias("raw"))
    d = d.select("c_custkey", assemble(F.col("components.text"), F.col("components.name"), F.col("components.metadata")).alias("content"))
    return d.join(raw, d["c_custkey"] == raw["i"]).select("c_custkey", "content", F.when(F.col("c_custkey") % 3 == 1, F.col("raw")).alias("raw"))


@query("""SELECT conv_id, string_agg(text, chr(10) || chr(10) ORDER BY turn) AS text, 'source: ' || string_agg(CASE WHEN turn % 2 = 0 THEN 'p' || turn || '.png' ELSE 'base64-image' END, ', ' ORDER BY turn) AS metadata FROM conversations GROUP BY conv_id""")
def ocr_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers of an OCR service for the pages of a record."""
    body = F.to_json(F.struct(F.array(F.struct(F.struct("text").alias("fullTextAnnotation"))).alias("responses")))
    d = table(spark, sf_dir, "conversations").select("conv_id", F.col("turn").alias("pos"), ocr_text(body).alias("ocr_text"), F.when(F.col("turn") % 2 == 0, F.concat(F.lit("p"), "turn", F.lit(".png"))).alias("source"), F.lit(None).cast("string").alias("ocr_error"))
    m = merge(d.withColumnRenamed("conv_id", "record_id")).withColumn("c", raw_components(F.col("text"), F.col("sources")))
    return m.select(F.col("record_id").alias("conv_id"), "c.text", "c.metadata")


@query("SELECT doc_id, to_base64(encode(text)) AS data, to_base64(encode(text)) AS sent FROM documents")
def image_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """base64 without line ends, and the request that carries it."""
    d = table(spark, sf_dir, "documents").select("doc_id", base64_text(F.encode("text", "utf-8")).alias("data"))
    return d.withColumn("sent", F.get_json_object(ocr_request(F.col("data")), "$.requests[0].image.content"))


@query("""SELECT s_suppkey, 'i' || s_suppkey || chr(10) || chr(10) || 'step ' || s_nationkey AS text, '---' || chr(10) || 'title: ' || s_name || chr(10) || 'k: v' || chr(10) || '---' || chr(10) || chr(10) || 'i' || s_suppkey || chr(10) || chr(10) || 'step ' || s_nationkey AS whole FROM supplier""")
def recipe_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A recipe's text with and without front matter."""
    none = F.lit(None).cast("string")
    r = F.struct(F.col("s_name").alias("name"), none.alias("description"), F.array().cast("array<string>").alias("image"), F.array(F.concat(F.lit("i"), "s_suppkey")).alias("ingredients"), F.concat(F.lit("step "), F.col("s_nationkey").cast("string")).alias("instructions"), F.array(F.struct(F.lit("k").alias("k"), F.lit("v").alias("v"))).alias("metadata"))
    d = table(spark, sf_dir, "supplier").select("s_suppkey", r.cast(RECIPE).alias("r"))
    return d.select("s_suppkey", components_text(F.col("r.ingredients"), F.col("r.instructions")).alias("text"), full_text(F.col("r")).alias("whole"))


_NL = "chr(10)"


@query(f"""SELECT p_partkey, p_name AS name, CASE p_partkey % 8 WHEN 0 THEN 'description: ' || p_brand || ' & more' || {_NL} || 'image: i.png' || {_NL} WHEN 1 THEN 'description: ' || p_type || {_NL} || 'image: u.png' || {_NL} WHEN 2 THEN 'image: a.png' || {_NL} WHEN 3 THEN 'image: c.png' || {_NL} ELSE '' END
 || 'source: u' || {_NL} || CASE p_partkey % 8 WHEN 2 THEN 'servings: ' || p_size || ' servings' || {_NL} WHEN 3 THEN 'author: ' || p_brand || ', B' || {_NL} WHEN 4 THEN 'prep time: 20 minutes' || {_NL} || 'cook time: 5 minutes' || {_NL} WHEN 6 THEN 'cuisine: It, Fr' || {_NL} || 'tags: x, y' || {_NL} ELSE '' END AS metadata,
 CASE p_partkey % 8 WHEN 5 THEN 'a ' || p_size || {_NL} WHEN 7 THEN p_size || ' g salt' || {_NL} ELSE '' END AS text FROM part""")
def jsonld_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Descriptions, images, authors, yields and times of all shapes; blank items and missing parts; a headline for a name."""
    k, lit = F.col("p_partkey") % 8, F.lit
    size = F.col("p_size").cast("string")
    more = (
        F.when(k == 0, F.concat(lit('"description":"<b>'), "p_brand", lit('</b> &amp;amp; more","image":"i.png"'))).when(k == 1, F.concat(lit('"description":{"text":"'), "p_type", lit('"},"image":{"url":"u.png"}')))
        .when(k == 2, F.concat(lit('"image":["a.png","b.png"],"recipeYield":["'), size, lit('","'), size, lit(' servings"]'))).when(k == 3, F.concat(lit('"image":[{"url":"c.png"}],"author":[{"name":"'), "p_brand", lit('"},{"@id":"#x"},{"name":"B"}]')))
        .when(k == 4, '"prepTime":{"minValue":"PT10M","maxValue":"PT20M"},"cookTime":{"minValue":"PT5M"}').when(k == 5, F.concat(lit('"recipeIngredient":["a '), size, lit('"," ",""],"recipeInstructions":[]')))
        .when(k == 6, '"keywords":"x, y","recipeCuisine":["It","Fr"],"recipeCategory":""').otherwise(F.concat(lit('"recipeIngredient":[{"name":"salt","amount":" '), size, lit(' g "},{"name":" "}]')))
    )
    s = F.concat(lit('{"@type":"Recipe",'), F.when(k == 7, '"headline":"').otherwise('"name":"'), "p_name", lit('",'), more, lit("}"))
    d = spread(table(spark, sf_dir, "part"), "p_partkey").select("p_partkey", lit("u").alias("url"), page(s).alias("html"))
    return _parts(d, "p_partkey").select("p_partkey", "name", "metadata", "text")


@query(f"SELECT p_partkey, '## ' || p_brand || {_NL} || {_NL} || p_name || {_NL} || {_NL} || p_type || {_NL} || {_NL} || {_NL} || '## Second' || {_NL} || {_NL} || 'Serve ' || p_size || '.' AS text FROM part")
def jsonld_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Several sections, each with its header and steps."""
    step = lambda c: F.struct(F.lit("HowToStep").alias("@type"), c.alias("text"))
    section = lambda name, *steps: F.struct(F.lit("HowToSection").alias("@type"), name.alias("name"), F.array(*map(step, steps)).alias("itemListElement"))
    both = F.array(section(F.concat("p_brand", F.lit(":")), F.col("p_name"), F.col("p_type")), section(F.lit("Second"), F.concat(F.lit("Serve "), F.col("p_size").cast("string"), F.lit("."))))
    s = F.to_json(F.struct(F.lit("Recipe").alias("@type"), both.alias("recipeInstructions")))
    d = spread(table(spark, sf_dir, "part"), "p_partkey").select("p_partkey", F.lit("u").alias("url"), page(s).alias("html"))
    return _parts(d, "p_partkey").select("p_partkey", "text")


@query(f"""SELECT c_custkey, 'html_class' AS extractor, CASE WHEN c_custkey % 3 = 2 THEN 'Dish' ELSE c_name END AS name, 'description: of ' || c_mktsegment || {_NL} || CASE WHEN c_custkey % 3 = 1 THEN 'prep_time: 5 min' || {_NL} ELSE '' END || 'source_url: u' || {_NL} AS metadata,
 'one of ' || c_custkey || {_NL} || {_NL} || 'Stir.' AS text FROM customer""")
def html_class_fuzzy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Titles and descriptions by parts of class names, too long a match for a title, and plug-ins of other families."""
    k = F.col("c_custkey") % 3
    title = F.when(k == 2, F.repeat("c_name", 400)).otherwise(F.col("c_name"))
    family = F.when(k == 1, "mv-create").otherwise("structured")
    h = F.concat(
        F.lit('<h2> Dish </h2><div class="page heading-big">'), title, F.lit('</div><p class="big-intro">of '), "c_mktsegment", F.lit("</p>"), F.when(k == 1, '<i class="mv-create-time-prep">5 min</i>').otherwise(""), F.lit('<div class="'), family,
        F.lit('-ingredients"><ul><li>one of '), F.col("c_custkey").cast("string"), F.lit('</li></ul></div><div class="'), family, F.lit('-instructions"><ol><li>Stir.</li></ol></div>'),
    )
    return _parts(spread(table(spark, sf_dir, "customer"), "c_custkey").select("c_custkey", F.lit("u").alias("url"), h.alias("html")), "c_custkey")


@query("SELECT s_suppkey, CASE WHEN s_suppkey % 4 > 0 THEN s_name END AS name, CASE s_suppkey % 4 WHEN 0 THEN 'no_extractor' END AS error FROM supplier")
def broken_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A lone surrogate, a text of 3,000 nested tags, unknown marked sections and an end in mid-tag are their own rows' affair."""
    k = F.col("s_suppkey") % 4
    name = F.concat(F.when(k == 1, F.repeat(F.lit("<b>"), 3000)).otherwise(""), F.col("s_name"), F.when(k == 0, "\\ud83d").otherwise(""))
    p = page(F.concat(F.lit('{"@type":"Recipe","name":"'), name, F.lit('"}')))
    h = F.when(k == 2, F.concat(F.lit("<![if x]><![foo[x]]>"), p)).when(k == 3, F.concat(p, F.lit('<!-- <![ <a b="'))).when(k == 0, F.regexp_replace(p, "<h1>.*</h1>", "")).otherwise(p)
    d = pages_to_recipes(spread(table(spark, sf_dir, "supplier"), "s_suppkey").select("s_suppkey", F.lit("u").alias("url"), h.alias("html")))
    return d.select("s_suppkey", F.col("components.name").alias("name"), F.col("error.kind").alias("error"))


@query("SELECT doc_id, text, '' AS metadata, '' AS name FROM documents")
def inline_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole texts without front matter."""
    return texts_to_recipes(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "components.*")


def _echo(method: str, url: str, headers: dict, body: str | None, timeout: float) -> tuple[int, str]:
    """Stands for the OCR service: the picture's bytes are its text."""
    image = json.loads(body)["requests"][0]["image"]["content"]
    return 200, json.dumps({"responses": [{"fullTextAnnotation": {"text": base64.b64decode(image).decode()}}]})


@query("""SELECT CAST(conv_id AS VARCHAR) AS record_id, string_agg(text, chr(10) || chr(10) ORDER BY turn) AS text, 'source: ' || string_agg('base64-image', ', ' ORDER BY turn) AS metadata FROM conversations GROUP BY conv_id""")
def inline_images(spark: SparkSession, sf_dir: str) -> DataFrame:
    """base64 images of a record through a stub of the service."""
    d = table(spark, sf_dir, "conversations").select(F.col("conv_id").cast("string").alias("record_id"), F.col("turn").alias("pos"), F.lit("base64-image").alias("source"), base64_text(F.encode("text", "utf-8")).alias("data"))
    return images_to_recipes(d, Transport(_echo)).select("record_id", "components.text", "components.metadata")


@query("""SELECT * FROM (VALUES (0, 0, 'anthropic', 'm-2', 2000), (0, 1, 'ollama', 'l', 2000), (1, 0, 'open_ai', 'given', 4000), (1, 1, 'anthropic', 'm-2', 2000), (1, 2, 'ollama', 'l', 2000), (2, 0, 'anthropic', 'given', 2000)) AS t(setting, place, provider, model, max_tokens)""")
def provider_settings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The caller before the settings before the defaults, and the order of fallbacks."""
    on = Settings(default_provider="anthropic", providers={"anthropic": {"model": "m-2"}, "ollama": {"model": "l"}}, fallback_enabled=True, fallback_order=["anthropic", "ollama"])
    off = Settings(default_provider="anthropic", providers=on.providers)
    chains = [chain(on), chain(on, "open_ai", "given"), chain(off, None, "given")]
    return spark.createDataFrame([(k, i, p.name, p.model, p.max_tokens) for k, c in enumerate(chains) for i, p in enumerate(c)], "setting int, place int, provider string, model string, max_tokens int")


@query("SELECT page_id, CAST(NULL AS VARCHAR) AS extractor, CAST(NULL AS VARCHAR) AS name, 'no_extractor' AS error FROM pages")
def page_recipes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole chain over the driver's pages."""
    d = pages_to_recipes(table(spark, sf_dir, "pages"))
    return d.select("page_id", "extractor", F.col("components.name").alias("name"), F.col("error.kind").alias("error"))
