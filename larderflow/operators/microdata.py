"""Recipes from schema.org microdata."""

from __future__ import annotations

from .dom import Node, attr

_TYPES = ("schema.org/Recipe", "data-vocabulary.org/Recipe")
_FIELDS = (("prep_time", "prepTime"), ("cook_time", "cookTime"), ("total_time", "totalTime"), ("servings", "recipeYield"), ("course", "recipeCategory"), ("cuisine", "recipeCuisine"), ("diet", "suitableForDiet"), ("tags", "keywords"))


def _all(box: Node, prop: str) -> list[str]:
    return [t for n in box.all(attr("itemprop", prop)) if (t := n.text())]


def extract(root: Node, url: str) -> dict | None:
    """The first container with a recipe type. It needs a name (which may be empty) and ingredients or instructions; only visible texts count, but for the image."""
    box = root.first(lambda n: "itemscope" in n.attrs and any(t in n.attrs.get("itemtype", "") for t in _TYPES))
    if box is None:
        return None

    def one(prop: str) -> str | None:
        n = box.first(attr("itemprop", prop))
        return None if n is None else n.text()

    name = one("name")
    ingredients = _all(box, "ingredients") or _all(box, "recipeIngredient")
    steps = _all(box, "recipeInstructions") or _all(box, "instructions")
    if name is None or not (ingredients or steps):
        return None
    meta = []
    picture = box.first(attr("itemprop", "image"))
    if picture is not None and (src := picture.attrs["src"] if "src" in picture.attrs else picture.text()):
        meta.append(("image", src))
    person = box.first(attr("itemprop", "author"))
    if person is not None:
        inner = person.first(attr("itemprop", "name"))
        meta.append(("author", (inner or person).text()))
    meta += [(k, one(f) or "") for k, f in _FIELDS]
    meta = [(k, v) for k, v in meta if v] + [("source_url", url)]
    return {"name": name, "description": one("description") or None, "image": [], "ingredients": ingredients, "instructions": "\n\n".join(steps), "meta": [{"k": k, "v": v} for k, v in meta], "times": [], "diets": None, "nutrition": []}
