"""Command line: build tables from raw files, run SQL, run registered queries."""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import SparkSession

from lectorium.plans import registry
from lectorium.sources import readers


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="lectorium")
    sub = p.add_subparsers(dest="command", required=True)
    b = sub.add_parser("build", help="raw files to Parquet tables")
    b.add_argument("--books")
    b.add_argument("--interactions")
    b.add_argument("--ids", help="map of ids, with --interactions")
    b.add_argument("--out", required=True)
    b.add_argument("--limit", type=int)
    q = sub.add_parser("query", help="SQL over the Parquet tables of a folder, as tab-separated lines")
    q.add_argument("--tables", required=True)
    q.add_argument("sql")
    r = sub.add_parser("run", help="a registered query over a folder of tables, written as Parquet")
    r.add_argument("name")
    r.add_argument("--tables", required=True)
    r.add_argument("--out", required=True)
    return p


def main(argv: list[str] | None = None, spark: SparkSession | None = None, out=sys.stdout) -> int:
    a = parser().parse_args(argv)
    spark = spark or SparkSession.builder.appName("lectorium").getOrCreate()
    if a.command == "build":
        if a.books:
            for name, read in (("books", readers.books), ("book_shelves", readers.shelves)):
                readers.write_swapped(readers.first_rows(read(spark, a.books), a.limit), f"{a.out}/{name}.parquet")
        if a.interactions:
            readers.write_swapped(readers.first_rows(readers.interactions(spark, a.interactions, a.ids), a.limit), f"{a.out}/interactions.parquet")
    elif a.command == "query":
        readers.attach(spark, a.tables)
        for line in readers.query_tsv(spark, a.sql):
            print(line, file=out)
    else:
        if a.name not in registry.queries():
            print(f"no query {a.name}", file=sys.stderr)
            return 2
        readers.write_swapped(registry.queries()[a.name](spark, a.tables), a.out)
    return 0


if __name__ == "__main__":
    sys.exit(main())
