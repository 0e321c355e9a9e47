"""Main text of web pages by consensus of their host's container paths."""

from __future__ import annotations

import html as _html
import re

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import small, written

#: A comment, a declaration, or a tag with quoted attributes; and a tag as far as the next bracket, for pages in which a quote doesn't end.
_TOKEN = re.compile(r"<!--(?:.*?-->|.*)|<[!?][^>]*>|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?>[^>\"']+|\"[^\"]*\"|'[^']*')*+)>", re.S)
_LOOSE = re.compile(r"<!--(?:.*?-->|.*)|<[!?][^>]*>|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)([^<>]*)>", re.S)
_SPACE = re.compile(r"\s+")
_DIGITS = re.compile(r"\d+")
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_RAW = frozenset("script style noscript template textarea iframe svg".split())
_BLOCK = frozenset("p div br li ul ol h1 h2 h3 h4 h5 h6 tr table blockquote pre hr article section main header footer nav aside td th dl dt dd figure figcaption form body".split())
_CONTAINER = frozenset("body div article main section td".split())
_SKIP = frozenset("nav aside footer form head header button select".split())
#: What an opening tag closes, if it is the innermost open element.
_IMPLIED = {"li": {"li", "p"}, "td": {"td", "th", "p"}, "th": {"td", "th", "p"}, "tr": {"tr", "td", "th", "p"}, "dt": {"dt", "dd", "p"}, "dd": {"dt", "dd", "p"}, "option": {"option"}}
_NOT_IN_P = _BLOCK - {"br", "td", "th", "tr"}


def label(tag: str, attrs: str) -> str:
    """A tag with its first class, numbers generalised."""
    if attrs:
        m = re.search(r"""\bclass\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>"']+))""", attrs, re.I)
        if m:
            names = (m[1] or m[2] or m[3] or "").split()
            if names:
                return f"{tag}.{_DIGITS.sub('#', names[0].lower())}"
    return tag


#: The path of the whole page, a container outside all others.
ROOT = "/"
#: Containers further out get nothing more of a text, as its share has been halved so often.
_OUTWARD = 64


class _Paths:
    """Paths as numbers, so that deep nesting takes no more than one entry for each element."""

    def __init__(self):
        self.up, self.name, self.of = [-1], [ROOT], {}

    def child(self, at: int, label_: str) -> int:
        k = self.of.get((at, label_))
        if k is None:
            k = self.of[at, label_] = len(self.up)
            self.up.append(at)
            self.name.append(label_)
        return k

    def text(self, at: int) -> str:
        out = []
        while at > 0:
            out.append(self.name[at])
            at = self.up[at]
        return "/".join(reversed(out)) or ROOT


def _further(want: str, matched: int, label_: str) -> int:
    """How much of the wanted path is matched by one more element; -1 if it leaves it."""
    if matched < 0 or (matched and want[matched : matched + 1] != "/"):
        return -1
    start = matched + 1 if matched else 0
    return start + len(label_) if want.startswith(label_, start) else -1


def scan(page: str, want: str | None = None, every: bool = False):
    """Without `want`: scores of the page's containers by number of their path, and the paths. With it: the text of the first element with that path, or of `every` one, or None.

    A text counts for its nearest container as its length, less twice what stands in links, and half of that for each container further out, the page itself last. Texts in scripts, styles
    and navigation don't count. Unclosed paragraphs, list items and cells end where the next begins, other open elements where an outer one is closed. Where a quote in a
    tag doesn't end before the page does, tags end at the next bracket from there on. Time and memory grow in proportion to the page, whatever its nesting.
    """
    paths = _Paths()
    root = ("", 0, False, False, (0, None), 0)
    stack: list[tuple] = [root]  # (tag, path, skip, link, (container, outer ones), how much of `want` matches)
    opened: dict[str, int] = {}
    scores: dict[int, float] = {}
    out: list[str] = []
    whole = want == ROOT
    found, depth = whole, 0 if whole else -1  # depth: of the wanted element
    token, pos, n = _TOKEN, 0, len(page)

    def cut(k: int) -> None:
        for x in stack[k:]:
            opened[x[0]] -= 1
        del stack[k:]

    def text(t: str) -> None:
        _, _, skip, link, box, _ = stack[-1]
        if not t or skip:
            return
        if want is not None:
            if depth >= 0:
                out.append(t)
            return
        size = len(_SPACE.sub(" ", t).strip())
        v, k = -2.0 * size if link else float(size), 0
        while size and box is not None and k < _OUTWARD:
            scores[box[0]] = scores.get(box[0], 0.0) + v
            v, k, box = v / 2, k + 1, box[1]

    while pos < n:
        at = page.find("<", pos)
        m = token.match(page, at) if at >= 0 else None
        while at >= 0 and m is None:
            if token is _TOKEN and page[at + 1 : at + 2].isalpha() | page.startswith("</", at):
                token = _LOOSE  # a quote that doesn't end, or a bracket that is missing
                m = token.match(page, at)
                continue
            at = page.find("<", at + 1)
            m = token.match(page, at) if at >= 0 else None
        text(page[pos : at if at >= 0 else n])
        if m is None:
            break
        pos = m.end()
        tag = m[2]
        if not tag:
            continue
        tag = tag.lower()
        if m[1]:
            if not opened.get(tag):
                continue
            k = len(stack) - 1
            while stack[k][0] != tag:
                k -= 1
            if depth >= 0 and tag in _BLOCK:
                out.append("\n")
            if not whole and 0 <= depth and k <= depth:
                found, depth = True, -1
                if not every:
                    break
                out.append("\n")
            cut(k)
            continue
        if depth >= 0 and tag in _BLOCK:
            out.append("\n")
        if tag in _VOID:
            continue
        if tag in _RAW:
            e = re.compile(rf"</{tag}\s*>", re.I).search(page, pos)
            pos = e.end() if e else n
            continue
        ends = _IMPLIED.get(tag) or ({"p"} if tag in _NOT_IN_P else ())
        k = len(stack)
        while stack[k - 1][0] in ends:
            k -= 1
        # an unclosed inline element doesn't keep a paragraph open
        if "p" in ends:
            for i in range(k - 1, max(k - 4, 0), -1):
                if stack[i][0] == "p":
                    k = i
                    break
                if stack[i][0] in _BLOCK:
                    break
        if not whole and k <= depth:
            found, depth = True, -1
            if not every:
                break
            out.append("\n")
        cut(k)
        _, path, skip, link, box, matched = stack[-1]
        name = label(tag, m[3])
        skip, link = skip or tag in _SKIP, link or tag == "a"
        if want is None:
            path = paths.child(path, name)
            if tag in _CONTAINER:
                box = (path, box)
        elif not whole and (matched := _further(want, matched if len(stack) > 1 else 0, name)) == len(want) and depth < 0:
            depth, skip = len(stack), False
        stack.append((tag, path, skip, link, box, matched))
        opened[tag] = opened.get(tag, 0) + 1
    if want is None:
        return scores, paths
    if depth < 0 and not found:
        return None
    lines = (_SPACE.sub(" ", x).strip() for x in _html.unescape("".join(out)).split("\n"))
    return "\n".join(x for x in lines if x)


def best(page: str | None) -> tuple[str | None, float]:
    """Path and score of the page's best container; ties go to the path that comes first in the page; None where no score is over 0."""
    scores, paths = scan(page or "")
    if not scores:
        return None, 0.0
    path = max(scores, key=scores.get)
    return (paths.text(path), scores[path]) if scores[path] > 0 else (None, 0.0)


def host() -> F.Column:
    """Host of `url` in lower case, without user and port; '' where there is none."""
    return F.coalesce(F.lower(F.regexp_extract("url", r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1)), F.lit(""))


def votes(pages: DataFrame) -> DataFrame:
    """Rows (host, path, votes, score): each page votes for its best container."""

    def run(batches):
        for batch in batches:
            got = [best(x) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([p for p, _ in got], pa.string()), pa.array([s for _, s in got], pa.float64())], names=["host", "path", "score"])

    each = pages.select(host().alias("host"), "html").mapInArrow(run, "host string, path string, score double").where("path is not null")
    return each.groupBy("host", "path").agg(F.count(F.lit(1)).alias("votes"), F.sum("score").alias("score"))


def winners(v: DataFrame) -> DataFrame:
    """Each host's path with most votes; ties go to the higher score, then to the lower path."""
    w = Window.partitionBy("host").orderBy(F.desc("votes"), F.desc("score"), "path")
    return v.withColumn("_r", F.row_number().over(w)).where("_r = 1").select(F.col("host").alias("_host"), F.col("path").alias("_path"))


def extract(pages: DataFrame) -> DataFrame:
    """Rows (page_id, host, path, consensus, text): the text of the host's winning container, of each element where its path repeats; a page without it gives its own best
    container (consensus false), which is the whole page ('/') where no container has more text outside links than in them. A page without text gives a null path and an empty text.

    A very long or deeply nested page is read whole. Pages vote in one pass and are read again in the second; the winning paths are broadcast while they are few, else joined by a shuffle. A null or empty
    page has an empty text; null urls share the host ''; repeated rows each vote and stay; an empty table gives an empty result; other columns aren't read.
    """
    win = small(written(winners(votes(pages)), "paths"))

    def run(batches):
        for batch in batches:
            paths, same, texts = [], [], []
            for want, page in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist()):
                page = page or ""
                text = scan(page, want, every=True) if want else None
                same.append(bool(text))
                if not text:
                    want = best(page)[0] or ROOT
                    text = scan(page, want, every=True) or scan(page, want := ROOT)
                paths.append(want if text else None)
                texts.append(text or "")
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), batch.column(1), pa.array(paths, pa.string()), pa.array(same, pa.bool_()), pa.array(texts, pa.string())], names=["page_id", "host", "path", "consensus", "text"])

    p = pages.select("page_id", host().alias("host"), "html")
    p = p.join(win, p["host"] == win["_host"], "left").select("page_id", "host", "_path", "html")
    return p.mapInArrow(run, "page_id bigint, host string, path string, consensus boolean, text string")
