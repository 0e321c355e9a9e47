"""Text and YAML front matter, in native expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

_NOT_BLANK = r"[\t-\r\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"
_SPACE = r"[\s\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"


def let(x: Column, then: Callable[[Column], Column]) -> Column:
    """x, computed once, passed on: without it each use would copy the whole expression of x into the plan."""
    return F.element_at(F.transform(F.array(x), then), 1)


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def trim_space(x: Column | str) -> Column:
    """Without white space at both ends, in Unicode's sense."""
    return F.regexp_replace(_c(x), f"^{_SPACE}+|{_SPACE}+$", "")


def trim_start(x: Column | str) -> Column:
    return F.regexp_replace(_c(x), f"^{_SPACE}+", "")


def sanitize_name(x: Column | str) -> Column:
    """Runs of white space as one space, none at the ends. Single spaces, most of all, aren't replaced."""
    return F.btrim(F.regexp_replace(_c(x), f"{_SPACE}{{2,}}|{_NOT_BLANK}", " "), F.lit(" "))


def clean_diet(x: Column | str) -> Column:
    """'https://schema.org/VeganDiet' as 'Vegan'."""
    x = F.regexp_replace(F.regexp_replace(_c(x), "^(https://schema\\.org/)+", ""), "^(http://schema\\.org/)+", "")
    return trim_space(F.replace(x, F.lit("Diet"), F.lit("")))


def base64_text(x: Column | str) -> Column:
    """Base64 without line ends."""
    return F.regexp_replace(F.base64(_c(x)), "\r\n", "")


def joined(items: Column, by: str) -> Column:
    return F.coalesce(F.array_join(items, by), F.lit(""))


def components_text(ingredients: Column, instructions: Column) -> Column:
    """A line for each ingredient, a blank line if both parts are there, and the instructions without leading white space."""
    lines = F.coalesce(F.array_join(F.transform(ingredients, lambda i: F.concat(trim_space(i), F.lit("\n"))), ""), F.lit(""))
    rest = trim_start(F.coalesce(instructions, F.lit("")))
    return F.concat(lines, F.when(F.exists(ingredients, lambda i: i.isNotNull()) & (F.coalesce(instructions, F.lit("")) != ""), "\n").otherwise(""), rest)


# --- YAML ----------------------------------------------------------------------------------------------------------

#: Plain scalars that another reader would take for something else than a string.
_TYPED = r"(?i)^(~|null|true|false|yes|no|on|off|y|n|[-+]?(0x[0-9a-f_]+|0o[0-7]+|[0-9][0-9_]*)|[-+]?(\.[0-9]+|[0-9][0-9_]*(\.[0-9_]*)?)(e[-+]?[0-9]+)?|[-+]?\.inf|\.nan|[0-9]{4}-[0-9]{1,2}-[0-9]{1,2}.*|[-+]?[0-9]+(:[0-5]?[0-9])+(\.[0-9]*)?|=|<<)$"
_SPECIAL = r"""^[-?:](\s|$)|^[,\[\]{}#&*!|>'"%@`]|^---|^\.\.\.|: |:$| #|^\s|\s$|\t"""
#: Most keys and values: begin with a letter, have six signs at least (so aren't `_TYPED`) and none that is special where it stands. One look instead of three.
_PLAIN = r"^(?=.{6})[A-Za-z][A-Za-z0-9_ .,/()-]*+(?::[A-Za-z0-9/][A-Za-z0-9_ .,/()-]*+)*+(?<=[A-Za-z0-9_./)])\z"
_CONTROL = r"[\x00-\x08\x0B-\x1F\x7F]"


def yaml_scalar(x: Column) -> Column:
    """A YAML string: plain where that is safe, else in single quotes; a literal block for several lines, double quotes for control signs."""
    quoted = F.concat(F.lit("'"), F.replace(x, F.lit("'"), F.lit("''")), F.lit("'"))
    strip = F.when(F.rlike(x, F.lit("\n\n$")), "+").when(F.endswith(x, F.lit("\n")), "").otherwise("-")
    indent = F.when(F.rlike(x, F.lit("^\n* ")), "2").otherwise("")
    body = F.regexp_replace(F.regexp_replace(F.regexp_replace(x, "\n$", ""), "(?m)^", "  "), "(?m)^  $", "")
    block = F.concat(F.lit("|"), indent, strip, F.lit("\n"), body)
    return (
        F.when(F.rlike(x, F.lit(_PLAIN)), x)
        .when(x == "", "''")
        .when(F.rlike(x, F.lit(_CONTROL)), F.to_json(F.array(x)).substr(F.lit(2), F.length(F.to_json(F.array(x))) - 2))
        .when(F.contains(x, F.lit("\n")), block)
        .when(F.rlike(x, F.lit(_TYPED)) | F.rlike(x, F.lit(_SPECIAL)), quoted)
        .otherwise(x)
    )


def last_by_key(entries: Column) -> Column:
    """A repeated key keeps its first place and takes its last value."""

    def of(all_: Column) -> Column:
        keys = F.transform(all_, lambda e: e["k"])
        last = F.transform(F.array_distinct(keys), lambda k: F.struct(k.alias("k"), F.element_at(F.filter(all_, lambda e: e["k"] == k), -1)["v"].alias("v")))
        return F.when(F.size(F.array_distinct(keys)) == F.size(all_), all_).otherwise(last)

    return let(entries, of)


_NESTED = r"""^(\n  [^\s:#'"\[\]{},&*!|>%@`-][^:#\n]*: [^\s:#'"\[\]{},&*!|>%@`-][^:#\n]*)+$"""


def metadata_yaml(entries: Column) -> Column:
    """Entries as block YAML, a line for each. Values are strings; one that begins with a line end is a nested block as it is, unless it doesn't read as one."""

    def line(e: Column) -> Column:
        nested = F.rlike(e["v"], F.lit(_NESTED))
        return F.concat(yaml_scalar(e["k"]), F.lit(":"), F.when(nested, e["v"]).otherwise(F.concat(F.lit(" "), yaml_scalar(e["v"]))), F.lit("\n"))

    good = F.filter(entries, lambda e: e["k"].isNotNull() & e["v"].isNotNull())
    return F.coalesce(F.array_join(F.transform(last_by_key(good), line), ""), F.lit(""))


def frontmatter_split(text: Column) -> Column:
    """struct(entries, body): lines 'key: value' between '---' marks, and what follows; without marks all is body."""
    end = F.when(F.startswith(text, F.lit("---\n")), F.locate("\n---\n", text, 5)).otherwise(0)
    lines = F.filter(F.split(F.substr(text, F.lit(5), end - 5), "\n", -1), lambda s: F.contains(s, F.lit(": ")))
    entry = lambda s: F.struct(F.substring_index(s, ": ", 1).alias("k"), F.substr(s, F.instr(s, ": ") + 2).alias("v"))
    none = F.array().cast("array<struct<k:string,v:string>>")
    return F.struct(F.when(end > 0, last_by_key(F.transform(lines, entry))).otherwise(none).alias("entries"), F.when(end > 0, F.substr(text, end + 5)).otherwise(text).alias("body"))


def entry_value(entries: Column, key: str) -> Column:
    return F.try_element_at(F.filter(entries, lambda e: e["k"] == key), F.lit(1))["v"]


def text_components(text: Column) -> Column:
    """A text with or without front matter as struct(text, metadata, name): the title is the name, other lines are the metadata."""

    def parts(s: Column) -> Column:
        rest = F.filter(s["entries"], lambda e: e["k"] != "title")
        lines = F.array_join(F.transform(rest, lambda e: F.concat(e["k"], F.lit(": "), e["v"])), "\n")
        return F.struct(s["body"].alias("text"), lines.alias("metadata"), F.coalesce(entry_value(s["entries"], "title"), F.lit("")).alias("name"))

    return let(frontmatter_split(text), parts)


def assemble(content: Column, name: Column, metadata: Column, raw_title: bool = False) -> Column:
    """Front matter from title and metadata, and the content; without either the content alone. `raw_title` doesn't escape the title."""
    title = F.when(name != "", F.concat(F.lit("title: "), name if raw_title else yaml_scalar(name), F.lit("\n"))).otherwise("")
    meta = F.when((metadata != "") & ~F.endswith(metadata, F.lit("\n")), F.concat(metadata, F.lit("\n"))).otherwise(metadata)
    return F.when((name == "") & (metadata == ""), content).otherwise(F.concat(F.lit("---\n"), title, meta, F.lit("---\n\n"), content))


def full_text(recipe: Column) -> Column:
    """A whole recipe as text: front matter with title, description, images and metadata, ingredient lines, a blank line, instructions."""
    none = F.array().cast("array<struct<k:string,v:string>>")
    pair = lambda k, v: F.struct(F.lit(k).alias("k"), v.alias("v"))
    head = F.filter(F.array(pair("title", recipe["name"]), pair("description", recipe["description"]), pair("__image__", F.array_join(recipe["image"], ", "))), lambda e: F.coalesce(e["v"], F.lit("")) != "")
    lines = F.transform(F.concat(head, F.coalesce(recipe["metadata"], none)), lambda e: F.concat(e["k"], F.lit(": "), e["v"]))
    front = F.when(F.size(lines) > 0, F.concat(F.lit("---\n"), F.array_join(lines, "\n"), F.lit("\n---\n\n"))).otherwise("")
    body = F.concat(F.when(F.size(recipe["ingredients"]) > 0, F.concat(F.array_join(recipe["ingredients"], "\n"), F.lit("\n"))).otherwise(""), F.lit("\n"), recipe["instructions"])
    return F.concat(front, body)
