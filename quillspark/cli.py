"""python -m quillspark.cli list | run QUERY SF_DIR [--out FOLDER] [--format parquet|csv|json] [--rows N]"""

from __future__ import annotations

import argparse
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from quillspark.plans import catalog


def main(argv: list[str] | None = None, queries: dict[str, Callable[[SparkSession, str], DataFrame]] | None = None) -> int:
    """Lists queries, or runs one over the tables of a folder: its rows go to files, or the first few to the screen."""
    queries = catalog.QUERIES if queries is None else queries
    parser = argparse.ArgumentParser(prog="quillspark", description=__doc__)
    commands = parser.add_subparsers(dest="command", required=True)
    commands.add_parser("list")
    run = commands.add_parser("run")
    run.add_argument("query", choices=sorted(queries), metavar="QUERY")
    run.add_argument("sf_dir")
    run.add_argument("--out")
    run.add_argument("--format", choices=("parquet", "csv", "json"), default="parquet")
    run.add_argument("--rows", type=int, default=20)
    args = parser.parse_args(argv)
    if args.command == "list":
        print("\n".join(sorted(queries)))
        return 0
    result = queries[args.query](SparkSession.builder.getOrCreate(), args.sf_dir)
    if args.out:
        result.write.format(args.format).save(args.out)
    else:
        result.show(args.rows, truncate=False)
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
