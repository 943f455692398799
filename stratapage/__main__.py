"""python -m stratapage ingest DOCUMENTS.parquet OUT | search DOCUMENTS.parquet QUERY"""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession

from stratapage.plans import engine
from stratapage.sources.units import lines


def main() -> None:
    parser = argparse.ArgumentParser(prog="stratapage")
    commands = parser.add_subparsers(dest="command", required=True)
    ingest = commands.add_parser("ingest", help="run the structured path and export its tables")
    ingest.add_argument("documents")
    ingest.add_argument("out")
    find = commands.add_parser("search", help="print the nearest lines")
    find.add_argument("documents")
    find.add_argument("query")
    find.add_argument("--top-k", type=int, default=10)
    find.add_argument("--document")
    args = parser.parse_args()
    spark = SparkSession.builder.appName("stratapage").getOrCreate()
    documents = spark.read.parquet(args.documents)
    if args.command == "ingest":
        tables = engine.run_collection(documents) if "source" in documents.columns else engine.run_documents(documents)
        print(*engine.export(tables, args.out), sep="\n")
    else:
        engine.search(lines(documents), args.query, args.top_k, document_id=args.document).show(args.top_k, truncate=False)


if __name__ == "__main__":
    main()
