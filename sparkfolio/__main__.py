"""python -m sparkfolio read|search|outline|list FOLDER [QUERY]: the tools from a shell."""

from __future__ import annotations

import argparse
import json
import sys

from sparkfolio import api
from sparkfolio.session import get_session
from sparkfolio.sources import detect


def main(args: list[str]) -> int:
    parser = argparse.ArgumentParser(prog="sparkfolio", description=__doc__)
    parser.add_argument("tool", choices=("read", "search", "outline", "list"))
    parser.add_argument("folder")
    parser.add_argument("query", nargs="?")
    parser.add_argument("--glob", default="*")
    parser.add_argument("--max-tokens", type=int)
    parser.add_argument("--pages")
    parser.add_argument("--cursor")
    parser.add_argument("--mode", default="auto")
    parser.add_argument("--limit", type=int, default=20)
    a = parser.parse_args(args)
    spark = get_session("sparkfolio")
    if a.tool == "list":
        found = detect.listing(detect.scan(spark, a.folder, a.glob))
    else:
        units = api.load(spark, a.folder, a.glob)
        if a.tool == "read":
            found = api.read(units, api.ReadOptions(a.max_tokens, a.pages, a.cursor)).orderBy("path", "number")
        elif a.tool == "outline":
            found = api.outline_of(units)
        elif a.query:
            found = api.find(units, a.query, a.mode, a.limit)
        else:
            parser.error("search needs a query")
    for row in found.toLocalIterator():
        print(json.dumps(row.asDict(recursive=True), ensure_ascii=False, default=str))
    return 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
