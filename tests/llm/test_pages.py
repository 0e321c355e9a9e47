"""Consensus extraction of pages."""

import collections
import random
import re
import time
from html.parser import HTMLParser

from larderflow.llm import html_paths

BODY = "Words enough to make this paragraph the text that a reader came for, number {}."


def page(k, box="div class='post-{k} main'", noise=""):
    return f"<html><head><title>t</title><script>var x = '<p>no</p>';</script></head><body><nav><ul><li><a href='/'>Home</a><li><a>More</a></ul></nav>{noise}<{box.format(k=k)}><h1>T {k}</h1><p>{BODY.format(k)}<p>Second &amp; last<br>line</{box.split()[0]}><footer>Contact and imprint</footer></body></html>"


class Tree(HTMLParser):
    """An own scorer over the standard parser's events, for pages whose elements are all closed or end with their parent."""

    def __init__(self, html):
        super().__init__()
        self.open, self.scores = [], collections.defaultdict(float)
        self.feed(html)
        self.close()

    def handle_starttag(self, tag, attrs):
        if tag in ("br", "hr", "img"):
            return
        names = (dict(attrs).get("class") or "").split()
        self.open.append((tag, tag + (f".{re.sub(r'[0-9]+', '#', names[0].lower())}" if names else "")))

    def handle_endtag(self, tag):
        if any(t == tag for t, _ in self.open):
            while self.open.pop()[0] != tag:
                pass

    def handle_data(self, data):
        tags = [t for t, _ in self.open]
        if set(tags) & {"script", "style", "nav", "aside", "footer", "form", "head", "header", "button", "select"}:
            return
        v = len(" ".join(data.split())) * (-2 if "a" in tags else 1)
        for k in reversed([k for k, t in enumerate(tags) if t in ("body", "div", "article", "main", "section", "td")]):
            self.scores["/".join(name for _, name in self.open[: k + 1])] += v
            v /= 2
        self.scores["/"] += v

    def best(self):
        path = max(self.scores, key=self.scores.get, default=None)
        return (path, self.scores[path]) if path and self.scores[path] > 0 else (None, 0.0)


def brute(pages):
    """Votes counted in plain Python."""
    by = collections.defaultdict(lambda: collections.defaultdict(lambda: [0, 0.0]))
    for host, html in pages:
        path, score = Tree(html).best()
        if path:
            by[host][path][0] += 1
            by[host][path][1] += score
    return {h: min(p, key=lambda x: (-p[x][0], -p[x][1], x)) for h, p in by.items()}


def test_scores_are_those_of_another_parser():
    r = random.Random(5)

    def part(depth):
        if not depth or r.random() < 0.2:
            return "words " * r.randint(1, 9)
        tag = r.choice(["div", "section", "b", "a", "nav", "article class='x-%d y'" % r.randint(1, 9), "div class=K", "span"])
        return f"<{tag}>" + "".join(part(depth - 1) for _ in range(r.randint(1, 3))) + f"</{tag.split()[0]}>"

    for _ in range(60):
        html = f"<html><head><title>no</title></head><body>{part(5)}<!-- no --><script>no</script>{part(3)}</body></html>"
        path, score = html_paths.best(html)
        own = Tree(html)
        assert abs(score - own.best()[1]) < 1e-6 and (path is None) == (own.best()[0] is None)
        assert path is None or abs(own.scores[path] - score) < 1e-6


def test_long_odd_pages_take_time_in_proportion():
    deep = "<div class=x>" * 80_000 + "deep"
    open_quotes = '<a "x ' * 170_000
    ends = "<div>" * 40_000 + "</p></span>" * 40_000 + "<p><b>" * 60_000
    for page in (deep, open_quotes, ends, "<div>" + open_quotes + ">text", "<" * 1_000_000, "<!--" * 200_000, "</" * 300_000):
        began = time.monotonic()
        path, _ = html_paths.best(page)
        html_paths.scan(page, path or "/", every=True)
        assert time.monotonic() - began < 20
    assert html_paths.best(deep)[0].count("/") == 79_999 and html_paths.scan(deep, html_paths.best(deep)[0]) == "deep"


def test_pages_without_a_container_give_their_text():
    assert html_paths.best("<p>bare <b>text</b>")[0] == "/" and html_paths.scan("<p>bare <b>text</b><nav>no</nav><ul><li>x", "/") == "bare text\nx"
    assert html_paths.scan("<body><div><a>only</a> <a>links</a></div></body>", "/") == "only links"
    assert html_paths.scan('<div title="a > b">c</div>', "div") == "c" and html_paths.scan("<div class='w-1/2'><p>c</div>", "div.w-#/#") == "c"


def test_consensus_and_odd_pages(spark):
    rows = [(k, f"http://user@A.example:80/{k}", page(k)) for k in range(6)]
    # a page of the host whose advertisement is longer than its text: only the vote finds the text
    rows.append((6, "http://a.example/6", page(6, noise="<div class='ad'><p>" + "Buy now. " * 60 + "</p></div>")))
    rows += [(7, "http://b.example/", page(7, "article")), (7, "http://b.example/", page(7, "article")), (8, None, page(8)), (9, "http://c.example", None), (10, "http://c.example", ""), (None, "not a url", "<p>bare text"), (11, "http://d.example", "<div>" * 3000 + "deep"), (12, "http://e.example", "<div>" + "long " * 200_000)]
    df = spark.createDataFrame(rows, "page_id bigint, url string, html string").selectExpr("*", "1 as host", "'x' as path", "2 as _host", "3 as votes", "4 as text")
    got = html_paths.extract(df).collect()
    assert collections.Counter(r["page_id"] for r in got) == collections.Counter(r[0] for r in rows)
    by = {r["page_id"]: r for r in got}
    text = lambda k: f"T {k}\n{BODY.format(k)}\nSecond & last\nline"
    for k in range(8):
        assert by[k]["text"] == text(k) and by[k]["consensus"]
    assert by[6]["path"] == "html/body/div.post-#" and by[0]["host"] == "a.example"
    assert by[9]["text"] == by[10]["text"] == "" and by[9]["path"] is None
    assert by[11]["text"] == "deep" and by[12]["text"].startswith("long long") and len(by[12]["text"]) > 900_000
    assert by[None]["text"] == "bare text" and by[None]["path"] == "/"
    assert by[8]["host"] == "" and by[8]["text"] == text(8)
    want = brute([(r["host"], h) for r, h in ((by[i], h) for i, _, h in rows if i is not None and h)] )
    win = {r["_host"]: r["_path"] for r in html_paths.winners(html_paths.votes(df)).collect()}
    assert {h: p for h, p in win.items() if h in ("a.example", "b.example", "d.example", "e.example")} == {h: p for h, p in want.items() if h in ("a.example", "b.example", "d.example", "e.example")}
    assert html_paths.extract(df.where("page_id > 99")).collect() == []


def test_ties_go_to_the_score_then_the_path(spark):
    v = spark.createDataFrame([("h", "b", 2, 5.0), ("h", "a", 2, 5.0), ("h", "c", 2, 4.0), ("g", "z", 1, 1.0), ("g", "y", 1, 2.0)], "host string, path string, votes bigint, score double")
    assert {(r["_host"], r["_path"]) for r in html_paths.winners(v).collect()} == {("h", "a"), ("g", "y")}


def test_scan_follows_implied_ends():
    html = "<body><div><ul><li>one<li>two</ul><p>a<p>b<table><tr><td>c<td>d</table></div><div>z</div>"
    assert html_paths.scan(html, "body/div") == "one\ntwo\na\nb\nc\nd"
    assert html_paths.scan("<div>a<!-- x --><style>b</style>c</div>", "div") == "ac"
    assert html_paths.scan("<div>a</div>", "p") is None


def test_all_containers_of_the_winning_path_give_text(spark):
    part = lambda k: f"<div class='post-{k}'><h2>Part {k}</h2><p>{BODY.format(k)}</div>"
    row = lambda k: f"<tr><td class='c'>{BODY.format(k)}<td class='c'>{BODY.format(k + 10)}"
    pages = [("http://a.example/", "<body><nav>Home</nav>" + "<hr>".join(map(part, range(4))) + "<footer>end</footer></body>"), ("http://b.example/", f"<body><table>{row(0)}{row(1)}</table></body>")]
    got = {r["host"]: r for r in html_paths.extract(spark.createDataFrame([(k, *p) for k, p in enumerate(pages)], "page_id bigint, url string, html string")).collect()}
    assert got["a.example"]["path"] == "body/div.post-#" and got["a.example"]["consensus"]
    assert got["a.example"]["text"] == "\n".join(f"Part {k}\n{BODY.format(k)}" for k in range(4))
    assert got["b.example"]["text"] == "\n".join(BODY.format(k) for k in (0, 10, 1, 11))
