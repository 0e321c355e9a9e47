"""python -m larderflow [URL] [--text FILE] [--image FILE ...] [--extract-only] [--provider NAME] [--timeout SECONDS] [--config FILE]"""

from __future__ import annotations

import argparse
import sys

from .plans.config import load
from .plans.importer import ImportPlan, frontmatter
from .session import session


def main(args: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="larderflow", description="Recipes from pages, texts and images.")
    p.add_argument("url", nargs="?")
    p.add_argument("--text", help="a file with a recipe's text, - for standard input")
    p.add_argument("--image", action="append", default=[])
    p.add_argument("--extract-only", "--download-only", action="store_true", dest="only")
    p.add_argument("--provider")
    p.add_argument("--timeout", type=float)
    p.add_argument("--config")
    a = p.parse_args(args)
    if sum(map(bool, (a.url, a.text, a.image))) != 1:
        p.error("give one of: a url, --text, --image")
    settings = load(a.config)
    if a.timeout:
        settings.timeout = a.timeout
    plan = ImportPlan(session("local[2]")).configured(settings)
    if a.url:
        plan.url(a.url)
    elif a.text:
        if a.text == "-":
            plan.text(sys.stdin.read())
        else:
            with open(a.text, encoding="utf-8") as f:
                plan.text(f.read())
    else:
        plan.images([("path", x) for x in a.image])
    if a.provider:
        plan.provider(a.provider)
    if a.only:
        plan.extract_only()
    df = plan.build(settings.transport())
    row = (frontmatter(df, raw_title=True) if a.only else df).first()
    if row["error"] is not None:
        print(f"{row['error']['kind']}: {row['error']['message']}", file=sys.stderr)
        return 1
    print(row["content"])
    if not a.only and row["conversion"] is not None:
        print(row["conversion"].asDict(recursive=True), file=sys.stderr)
    return 0


if __name__ == "__main__":
    sys.exit(main())
