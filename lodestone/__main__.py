"""Ask about a working tree from the command line: python -m lodestone PATH WHAT [ARGUMENT]."""

from __future__ import annotations

import argparse
import json

from pyspark.sql import DataFrame

from .engine import Repository
from .session import get_session

TABLES = ("tree", "coupling", "dead_code", "entrypoints", "folders", "communities", "symbol_index")
REPORTS = ("status", "overview", "wiki", "snapshot")
QUESTIONS = ("search", "ask", "investigate", "codemap", "codemap_file")


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="lodestone", description=__doc__)
    parser.add_argument("path")
    parser.add_argument("what", choices=[*TABLES, *REPORTS, *QUESTIONS])
    parser.add_argument("argument", nargs="?")
    parser.add_argument("--master", default="local[*]")
    args = parser.parse_args(argv)
    if args.what in QUESTIONS and not args.argument:
        parser.error(f"{args.what} needs a question or a path")
    spark = get_session(args.master, **{"spark.ui.showConsoleProgress": "false"})
    repo = Repository.ingest(spark, args.path)
    found = getattr(repo, args.what)(*([args.argument] if args.argument else []))
    if isinstance(found, DataFrame):
        found.drop("repo_id").show(50, truncate=80)
    else:
        print(json.dumps(found, indent=2, default=str))
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
