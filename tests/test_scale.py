"""Work that must not grow faster than the input: where rows are spread, and what is done once for a page."""

import os
import random

import pytest
from pyspark.sql import functions as F

from larderflow import queries
from larderflow.functions import text
from larderflow.operators import dom, extract, html_class

SF = "/root/testdata/sf0.001"
#: Queries that make pages of a small table's rows, which is one file with one row group, so one task.
SPREAD = "html_class_recipe broken_pages html_class_fuzzy extractor_chain jsonld_nodes jsonld_reject jsonld_repair microdata_recipe jsonld_sections jsonld_fields html_strip nutrition_yaml jsonld_instructions"


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
@pytest.mark.parametrize("name", SPREAD.split())
def test_rows_are_spread(spark, name):
    plan = queries.QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "REPARTITION_BY_NUM" in plan
    assert plan.index("ArrowEvalPython") < plan.index("REPARTITION_BY_NUM")  # the narrow rows, not the pages


def test_spread_keeps_rows(spark):
    d = spark.range(0, 1000, 1, 1).union(spark.createDataFrame([(None,)], "id bigint"))
    s = extract.spread(d, "id")
    assert s.rdd.getNumPartitions() >= 4 and sorted(r[0] for r in s.where("id IS NOT NULL").collect()) == list(range(1000)) and s.count() == 1001


def test_classes_take_one_walk(monkeypatch):
    walks, nodes = [], dom.Node.nodes
    root = dom.parse('<body><h1>t</h1><div class="recipe-ingredients recipe-ingredients"><p>two cups</p></div></body>')
    monkeypatch.setattr(dom.Node, "nodes", lambda n: (walks.append(n), nodes(n))[1])
    assert html_class.extract(root, "u")["ingredients"] == ["two cups"]
    assert sum(n is root for n in walks) <= 2  # the classes, and the heading


def _tree(n: dom.Node):
    return n.tag, n.attrs, [_tree(c) if isinstance(c, dom.Node) else c for c in n.children]


def test_nested_tags_need_no_whole_parser(monkeypatch):
    def no(*_):
        raise AssertionError("the whole parser")

    monkeypatch.setattr(dom._Builder, "feed", no)
    assert dom.decode("<b>" * 3000 + "x") == "x"


PIECES = ["<p>", "</p>", "<DIV class=\"a b\">", "</div>", "<li>", "<ul>", "</ul>", "<td>", "<table>", "</table>", "<b>", "</b>", "x &amp;amp", " y ", "<br/>", "<script>", "</script>", '<script type="application/ld+json">', "</SCRIPT>", "</script >", "<style>", "</style>", "<title>", "</title>", "<textarea>", "<!-- a -->", "<!--", "-->", "<!DOCTYPE html>", "<![CDATA[", "<", '<a href="x&amp;y">', "<a b='c'>", '<a itemscope id="">', "<p/>", "<script/>", "</p a>", '<a b = "c">', "<svg>", "\x00", '<a b="c"d="e">']


def test_plain_pages_have_the_parsers_tree():
    r, plain = random.Random(5), 0
    for _ in range(6000):
        page = "".join(r.choice(PIECES) for _ in range(r.randint(1, 9)))
        whole = dom._whole_tree(page)
        own = ["".join(n.texts()) for n in whole.all(lambda n: n.tag == "script" and n.attrs.get("type") == "application/ld+json")]
        found = []
        try:
            found += dom.scripts(page, "application/ld+json")
            assert found == own
        except dom.Unclear:
            pass
        try:
            assert _tree(dom._plain_tree(page)) == _tree(whole)
            plain += 1
        except dom.Unclear:
            pass
    assert plain > 300


PAGE = '<!DOCTYPE html><html><head><title>x</title>%s</head><body><h1 class="a">t</h1></body></html>'
RECIPE = '<script type="application/ld+json">{"@type":"Recipe","name":"n"}</script>'


def test_jsonld_needs_no_tree(monkeypatch):
    monkeypatch.delattr(dom, "parse")
    assert extract._run(PAGE % RECIPE, "u", extract.EXTRACTORS, True, False)["jsonld"]["name"] == "n"


def test_scripts_that_need_a_tree():
    for before in ("<a b='c'>", "<textarea>" + RECIPE.replace("n\"}", "no\"}") + "</textarea>", "<script>{</script ><!-- -- -->"):
        whole = dom._whole_tree(PAGE % (before + RECIPE))
        from larderflow.operators import jsonld

        assert extract._run(PAGE % (before + RECIPE), "u", ("jsonld",), True, False)["jsonld"] == jsonld.extract(whole, "u")


def test_unreadable_page_is_a_failure(monkeypatch):
    def broken(_):
        raise ValueError("bad")

    monkeypatch.setattr(dom, "parse", broken)
    assert extract._run("<p>", "u", extract.EXTRACTORS, True, False) == {"failure": "ValueError: bad"}


def test_fields_are_made_in_arrow():
    from pyspark.util import PythonEvalType

    assert extract.fields().evalType == PythonEvalType.SQL_SCALAR_ARROW_ITER_UDF


def test_plain_scalars_take_one_look(spark):
    """What the short test lets through, none of the three long ones would have caught."""
    r = random.Random(3)
    signs = [*"abYN01 .,:/()-_#'\"\n\t\r\x85é&=~", "true", "null", ": ", " #", "http://"]
    rows = [("".join(r.choice(signs) for _ in range(r.randint(0, 9))),) for _ in range(5000)] + [(x,) for x in ("Order 12", "http://x.org/a b", "yes", "abcdef:", "abcdef ", "abcdef\n", "abcdef: x")]
    v, rlike = F.col("v"), lambda p: F.rlike("v", F.lit(p))
    d = spark.createDataFrame(rows, "v string").where(rlike(text._PLAIN))
    assert d.count() > 20 and {"Order 12", "http://x.org/a b"} <= {x[0] for x in d.collect()}
    assert d.where(rlike(text._CONTROL) | rlike(text._TYPED) | rlike(text._SPECIAL) | F.contains(v, F.lit("\n")) | (v == "")).count() == 0


def test_entity_cut_before_its_semicolon(spark):
    """As in headings of the driver's pages: an HTML reader knows it all the same."""
    d = spark.createDataFrame([("<h1>a&amp;&amp</h1>",), ("<h1>a&amp;b</h1>",)], "html string")
    assert [r[0] for r in d.select(extract.heading("html")).collect()] == ["a&&", "a&b"]
