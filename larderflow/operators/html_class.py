"""Recipes from the class names that recipe plug-ins and themes use."""

from __future__ import annotations

from collections import defaultdict

from .dom import Node, has_class, tag

# One row for each family of names: its prefix, then place.field=suffix; a place is the order in which the field's names are tried.
_FAMILIES = """
wprm-recipe- 0.title=name 0.description=summary 0.ingredients=ingredients-container 1.ingredients=ingredient 0.instructions=instructions-container 1.instructions=instruction 0.prep_time=prep-time 0.cook_time=cook-time 0.total_time=total-time 0.servings=servings 0.notes=notes
tasty-recipes- 1.title=title 4.description=description 2.ingredients=ingredients 2.instructions=instructions 3.prep_time=prep-time 3.cook_time=cook-time 3.total_time=total-time 3.servings=yield 2.notes=notes
mv-create- 2.title=title 3.description=description 3.ingredients=ingredients 3.instructions=instructions 4.prep_time=time-prep 4.cook_time=time-active 4.total_time=time-total 4.servings=yield 3.notes=notes
wpzoom-recipe- 13.title=card-title 6.description=summary 7.ingredients=ingredients 7.instructions=instructions 6.prep_time=prep-time 6.cook_time=cook-time 6.total_time=total-time 6.servings=servings 5.notes=notes
wpupg-recipe- 15.title=name 12.description=summary 11.ingredients=ingredients 11.instructions=instructions 9.prep_time=prep-time 9.cook_time=cook-time 9.total_time=total-time 9.servings=servings 8.notes=notes
simple-recipe-pro- 11.title=recipe-title 10.description=recipe-description 9.ingredients=recipe-ingredients 9.instructions=recipe-instructions 8.prep_time=prep-time 8.cook_time=cook-time 8.total_time=total-time 8.servings=servings 7.notes=notes
recipe-card- 6.title=title 5.description=summary 13.description=description 6.ingredients=ingredients 12.ingredients=ingredient-list 6.instructions=instructions 12.instructions=instruction-list 5.prep_time=prep-time 5.cook_time=cook-time 5.total_time=total-time 5.servings=servings 10.servings=yield 4.notes=notes 9.notes=tips
recipe-callout- 12.title=title 11.description=summary 10.ingredients=ingredients 10.instructions=instructions
recipe-content- 10.title=title 17.ingredients=ingredients 17.instructions=instructions
recipess- 18.title=recipe-title 14.ingredients=ingredients-list 14.instructions=instructions-list
mpprecipe- 16.ingredients=ingredients 16.instructions=instructions
structured- 15.ingredients=ingredients 15.instructions=instructions
recipe_ 9.title=name 9.description=description 13.ingredients=ingredients 13.instructions=instructions
recipe- 3.title=name 4.title=title 7.title=header-title 14.title=card__title 17.title=title-name 1.description=summary 2.description=description 7.description=summary-text 8.description=intro 4.ingredients=ingredients 5.ingredients=ingredient-list 8.ingredients=ingredients-section 18.ingredients=ingredient-group 4.instructions=instructions 5.instructions=instruction-list 8.instructions=instructions-section 18.instructions=instruction-group 20.instructions=directions 1.prep_time=prep-time 7.prep_time=prep_time 10.prep_time=time-prep 1.cook_time=cook-time 7.cook_time=cook_time 10.cook_time=time-cook 1.total_time=total-time 7.total_time=total_time 10.total_time=time-total 1.servings=yield 2.servings=servings 7.servings=yield-value 1.notes=notes 6.notes=tips 10.notes=footnotes
recipecardname 5.title=
wprp-recipe-title 8.title=
directions 19.instructions=
prep-time 2.prep_time=
cook-time 2.cook_time=
total-time 2.total_time=
recipeyield 11.servings=
"""


def _tables() -> dict[str, list[str]]:
    out: dict[str, dict[int, str]] = defaultdict(dict)
    for row in _FAMILIES.strip().splitlines():
        prefix, *cells = row.split()
        for c in cells:
            where, suffix = c.split("=")
            place, field = where.split(".")
            out[field][int(place)] = prefix + suffix
    return {f: [x[k] for k in sorted(x)] for f, x in out.items()}


EXACT = _tables()
#: Parts of class names, tried after the names themselves.
FUZZY = {"title": "recipe title name heading".split(), "description": "summary description intro".split()}
#: Sizes in bytes beyond which a fuzzy match, an item or a header is taken for something else.
FUZZY_MOST, ITEM_LEAST, ITEM_MOST, HEADER_MOST = 5000, 5, 500, 100


def _size(s: str) -> int:
    return len(s.encode())


class Classes:
    """A page's elements by class name, and all that have a class, from one walk; each in document order."""

    def __init__(self, root: Node):
        self.by_name: dict[str, list[Node]] = defaultdict(list)
        self.all: list[Node] = []
        for n in root.nodes():
            if c := n.attrs.get("class"):
                self.all.append(n)
                for name in dict.fromkeys(c.split()):
                    self.by_name[name].append(n)

    def of(self, name: str) -> list[Node]:
        return self.by_name.get(name, [])

    def containing(self, part: str) -> list[Node]:
        return [n for n in self.all if part in n.attrs["class"]]


def _texts(nodes: list[Node]) -> str:
    return "\n".join(n.text() for n in nodes).strip()


def find(page: Classes, field: str) -> str | None:
    """Texts of all elements of the first class that has any."""
    for name in EXACT[field]:
        if t := _texts(page.of(name)):
            return t
    for part in FUZZY.get(field, ()):
        t = _texts(page.containing(part))
        if t and _size(t) < FUZZY_MOST:
            return t
    return None


def items(page: Classes, field: str) -> list[str]:
    """List items of the first class that has any, or else its div, p and span texts of a fitting size."""
    for name in EXACT[field]:
        got: list[str] = []
        for box in page.of(name):
            got += [t for n in box.all(tag("li")) if (t := n.text())]
            if not got:
                got += [t for kind in ("div", "p", "span") for n in box.all(tag(kind)) if ITEM_LEAST < _size(t := n.text()) < ITEM_MOST]
        if got:
            return got
    return []


def _header(box: Node, tests, most: int | None) -> str | None:
    for test in tests:
        n = box.first(test)
        t = n.text() if n is not None else ""
        if t and (most is None or _size(t) < most):
            return f"## {t.rstrip(':')}"
    return None


def instructions(page: Classes) -> list[str]:
    """Steps with the headers of their groups, where a plug-in groups them; else plain items."""
    own = [has_class("wprm-recipe-group-name")]
    other = [tag("h3"), tag("h4"), has_class("group-name"), has_class("section-name")]
    for name, tests, most in (("wprm-recipe-instruction-group", own, None), *((f"{p}-instruction-group", other, HEADER_MOST) for p in ("recipe", "tasty-recipes", "mv-create"))):
        got: list[str] = []
        for box in page.of(name):
            if h := _header(box, tests, most):
                got.append(h)
            got += [t for n in box.all(tag("li")) if (t := n.text())]
        if got:
            return got
    return items(page, "instructions")


def extract(root: Node, url: str) -> dict | None:
    """A recipe needs a title (or a first h1 or h2) and ingredients or instructions."""
    page = Classes(root)
    name = find(page, "title")
    if name is None:
        h = root.first(tag("h1", "h2"))
        name = h.text() if h is not None else ""
    ingredients, steps = items(page, "ingredients"), instructions(page)
    if not name or not (ingredients or steps):
        return None
    meta = [(k, v) for k in ("prep_time", "cook_time", "total_time", "servings", "notes") if (v := find(page, k))] + [("source_url", url)]
    return {"name": name, "description": find(page, "description"), "image": [], "ingredients": ingredients, "instructions": "\n\n".join(steps), "meta": [{"k": k, "v": v} for k, v in meta], "times": [], "diets": None, "nutrition": []}
