"""Recipes from JSON-LD scripts: node selection and the typed reading of a node."""

from __future__ import annotations

from collections.abc import Iterable
from typing import Any

from .dom import Node, decode
from .json_repair import load


class Rejected(Exception):
    """A field has a type that it can't have; the whole node is refused."""


_NUTRITION = (("calories", "calories"), ("fat", "fatContent"), ("saturated fat", "saturatedFatContent"), ("carbohydrates", "carbohydrateContent"), ("sugar", "sugarContent"), ("protein", "proteinContent"), ("fiber", "fiberContent"), ("sodium", "sodiumContent"), ("serving size", "servingSize"))
_TIMES = (("time required", "totalTime"), ("prep time", "prepTime"), ("cook time", "cookTime"))


def _strings(v: Any) -> bool:
    return isinstance(v, list) and all(isinstance(x, str) for x in v)


def _text(d: dict, key: str) -> str | None:
    v = d.get(key)
    if v is not None and not isinstance(v, str):
        raise Rejected(key)
    return v


def _list(d: dict, key: str) -> list[str] | None:
    """A string or several."""
    v = d.get(key)
    if v is None:
        return None
    if isinstance(v, str):
        return [v]
    if _strings(v):
        return v
    raise Rejected(key)


def is_recipe(node: Any) -> bool:
    t = node.get("@type") if isinstance(node, dict) else None
    return any(isinstance(x, str) and x.lower() == "recipe" for x in (t if isinstance(t, list) else [t]))


def select(root: Any) -> dict | None:
    """The recipe node: of an array the first that has instructions or is a recipe; the object itself; or the first recipe of its @graph."""
    if isinstance(root, list):
        return next((x for x in root if isinstance(x, dict) and ("recipeInstructions" in x or is_recipe(x))), None)
    if is_recipe(root):
        return root
    graph = root.get("@graph") if isinstance(root, dict) else None
    return next((x for x in graph if is_recipe(x)), None) if isinstance(graph, list) else None


def _description(d: dict) -> str | None:
    v = d.get("description")
    if isinstance(v, list) and len(v) == 1 and isinstance(v[0], str):
        v = v[0]
    if isinstance(v, dict) and isinstance(v.get("text"), str):
        v = v["text"]
    if v is not None and not isinstance(v, str):
        raise Rejected("description")
    return (decode(v) or None) if v else None


def _image(d: dict) -> list[str]:
    v = d.get("image")
    url = lambda x: isinstance(x, dict) and isinstance(x.get("url"), str)
    if v is None:
        return []
    if isinstance(v, str):
        return [decode(v)]
    if url(v):
        return [v["url"]]
    if _strings(v):
        return [decode(x) for x in v]
    if isinstance(v, list) and all(map(url, v)):
        return [x["url"] for x in v]
    raise Rejected("image")


def _ingredients(d: dict) -> list[str]:
    v = d.get("recipeIngredient")
    if v is None:
        return []
    if _strings(v):
        return [x for x in map(decode, v) if x.strip()]
    if not isinstance(v, list):
        raise Rejected("recipeIngredient")
    out = []
    for x in v:
        if not isinstance(x, dict) or not isinstance(x.get("name"), str):
            raise Rejected("recipeIngredient")
        amount, name = (_text(x, "amount") or "").strip(), decode(x["name"])
        if name.strip():
            out.append(f"{amount} {name}" if amount else name)
    return out


def _step(x: Any) -> list[str]:
    if not isinstance(x, dict):
        raise Rejected("step")
    text, name, more = (_text(x, k) for k in ("text", "name", "description"))
    first = text if text is not None else name
    return [decode(s) for s in (first, more) if s is not None]


def _how_to(items: list, break_before: str) -> list[str]:
    out = []
    for x in items:
        kind = x.get("@type") if isinstance(x, dict) else None
        if kind == "HowToStep":
            out += _step(x)
        elif kind == "HowToSection" and isinstance(x.get("itemListElement"), list):
            name = _text(x, "name")
            if name is not None:
                out.append(f"{break_before}## {decode(name).rstrip(':')}")
            for s in x["itemListElement"]:
                out += _step(s)
        else:
            raise Rejected("recipeInstructions")
    return out


def _instructions(d: dict) -> str:
    v = d.get("recipeInstructions")
    if v is None:
        return ""
    if isinstance(v, str):
        return decode(v)
    if not isinstance(v, list):
        raise Rejected("recipeInstructions")
    if _strings(v):
        return "\n\n".join(map(decode, v))
    if all(isinstance(x, dict) and isinstance(x.get("text"), str) for x in v):
        return "\n\n".join(decode(x["text"]) for x in v)
    if all(isinstance(x, list) for x in v):
        return "\n\n".join(t for x in v for t in _how_to(x, ""))
    return "\n\n".join(_how_to(v, "\n"))


def _servings(d: dict) -> str:
    v = d.get("recipeYield")
    if v is None:
        return ""
    if isinstance(v, str):
        return v
    if isinstance(v, int) and not isinstance(v, bool) and -(2**31) <= v < 2**31:
        return str(v)
    if _strings(v):
        return next((x for x in v if any(c.isalpha() for c in x)), v[0] if v else "")
    raise Rejected("recipeYield")


def _author(d: dict) -> str:
    v = d.get("author")
    if v is None:
        return ""
    if isinstance(v, str):
        return v
    if _strings(v):
        return ", ".join(v)
    people = v if isinstance(v, list) else [v]
    if not all(isinstance(x, dict) for x in people):
        raise Rejected("author")
    for x in people:
        _text(x, "@id")
    return ", ".join(n for x in people if (n := _text(x, "name")) is not None)


def _time(d: dict, key: str) -> str | None:
    v = d.get(key)
    if isinstance(v, dict):
        return next((v[k] for k in ("maxValue", "minValue") if isinstance(v.get(k), str)), None)
    return v if isinstance(v, str) else None


def read(d: dict, url: str) -> dict | None:
    """The node's fields, or None if one of them has a type that it can't have."""
    try:
        meta = [("source", url), ("author", _author(d)), ("servings", _servings(d))]
        for key, field in (("course", "recipeCategory"), ("cuisine", "recipeCuisine"), ("tags", "keywords")):
            meta.append((key, ", ".join(_list(d, field) or [])))
        n = d.get("nutrition")
        if n is not None and not isinstance(n, dict):
            raise Rejected("nutrition")
        name, headline = _text(d, "name"), _text(d, "headline")
        return {
            "name": decode(name if name is not None else headline or ""),
            "description": _description(d),
            "image": _image(d),
            "ingredients": _ingredients(d),
            "instructions": _instructions(d),
            "meta": [{"k": k, "v": v} for k, v in meta if v or k == "source"],
            "times": [{"k": k, "v": v} for k, f in _TIMES if (v := _time(d, f))],
            "diets": _list(d, "suitableForDiet"),
            "nutrition": [{"k": label, "v": v} for label, f in _NUTRITION if (v := _text(n or {}, f))],
        }
    except Rejected:
        return None


SCRIPT = "application/ld+json"


def extract(root: Node, url: str, strict_compat: bool = False) -> dict | None:
    """The first script of the page, in document order, that gives a recipe."""
    return of_scripts(("".join(n.texts()) for n in root.all(lambda x: x.tag == "script" and x.attrs.get("type") == SCRIPT)), url, strict_compat)


def of_scripts(texts: Iterable[str], url: str, strict_compat: bool = False) -> dict | None:
    for text in texts:
        value = load(text, strict_compat)
        node = select(value) if value is not None else None
        got = read(node, url) if node else None
        if got:
            return got
    return None
