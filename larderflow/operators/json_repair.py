"""Repair of JSON with missing or superfluous commas."""

from __future__ import annotations

import json
import re

_TOKEN = re.compile(r'"(?:[^"\\]|\\.)*"|[\[\]{},:]|[^\s\[\]{},:"]+', re.S)
_ESCAPED_SURROGATE = re.compile(r"\\u[dD][89a-fA-F]")
_CLEAN = ((",]", "]"), (",}", "}"), (",,", ","), (",:,", ":"), (":,", ":"), (",:", ":"))


def repair(text: str, strict_compat: bool = False) -> str:
    """White space outside strings goes; a comma is put between two values that lack one, repeated commas and those before ':' or a closing bracket go.

    `strict_compat` also applies the last clean-ups inside strings, as the established behaviour does."""
    out: list[str] = []
    for t in _TOKEN.findall(text):
        last = out[-1] if out else ""
        if t == ",":
            if last != ",":
                out.append(t)
            continue
        if t == ":" and last == ",":
            out.pop()
        elif (last[:1] == '"' and t[0] in '"[{') or (last in ("]", "}") and t[0] == '"'):
            out.append(",")
        elif t in ("]", "}") and last == ",":
            out.pop()
        out.append(t)
    s = "".join(x for k, x in enumerate(out) if not (x == "," and k and out[k - 1] in (":", "[", "{")))
    if strict_compat:
        for a, b in _CLEAN:
            s = s.replace(a, b)
    return s


def _refuse(x: str):
    raise ValueError(x)


_DECODER = json.JSONDecoder(parse_constant=_refuse)


def load(text: str, strict_compat: bool = False):
    """The value, or None: as it is if it can be read so, else repaired. Numbers that aren't JSON (NaN) and lone surrogates, which no text can hold, are refused."""
    for strict in ((True,) if strict_compat else (False, True)):
        try:
            s = repair(text, strict_compat) if strict else text
            if s.startswith("\ufeff"):
                continue
            value = _DECODER.decode(s)
            if _ESCAPED_SURROGATE.search(s):
                json.dumps(value, ensure_ascii=False).encode()  # a UnicodeEncodeError is a ValueError
            return value
        except (ValueError, RecursionError):
            continue
    return None
