"""python -m quarry list | run NAME --data DIR [--rows N] [--out DIR]: the registered queries from a shell."""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession

from quarry.catalogue import ORACLES, QUERIES


def main(arguments: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="quarry", description=__doc__)
    commands = parser.add_subparsers(dest="command", required=True)
    commands.add_parser("list", help="names of all queries; a star marks those with a SQL statement")
    run = commands.add_parser("run", help="run one query")
    run.add_argument("name", choices=sorted(QUERIES))
    run.add_argument("--data", required=True, help="folder of the table files")
    run.add_argument("--rows", type=int, default=20, help="rows to show")
    run.add_argument("--out", help="folder to write the whole result to, as Parquet")
    given = parser.parse_args(arguments)
    if given.command == "list":
        print("\n".join(f"{name}{' *' if name in ORACLES else ''}" for name in sorted(QUERIES)))
        return 0
    spark = SparkSession.builder.appName(f"quarry {given.name}").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    result = QUERIES[given.name](spark, given.data.rstrip("/"))
    if given.out:
        result.write.mode("overwrite").parquet(given.out)
    else:
        result.show(given.rows, truncate=60)
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
