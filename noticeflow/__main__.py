"""python -m noticeflow ingest|search|chat|distribution|repair|taxonomy ..."""

from __future__ import annotations

import argparse
import json
import time

from pyspark.sql import functions as F

from noticeflow.operators import audit, search, taxonomy
from noticeflow.operators.index import Index
from noticeflow.providers.local import LocalProvider
from noticeflow.session import session
from noticeflow.sources import readers
from noticeflow.streaming.ingest import run_file


def main(argv: list[str] | None = None) -> None:
    p = argparse.ArgumentParser(prog="noticeflow", description=__doc__)
    p.add_argument("--index", default="data/index")
    sub = p.add_subparsers(dest="command", required=True)
    a = sub.add_parser("ingest", help="clean, enrich and index a .csv or .xlsx file")
    a.add_argument("file")
    a.add_argument("--offset", type=int, default=0)
    a.add_argument("--limit", type=int, default=None, help="end offset: rows from offset up to it")
    a.add_argument("--taxonomy", default=None)
    a = sub.add_parser("search")
    a.add_argument("query")
    a.add_argument("--limit", type=int, default=100)
    a.add_argument("--without-corrigenda", action="store_true")
    a = sub.add_parser("chat")
    a.add_argument("id")
    a.add_argument("question")
    sub.add_parser("distribution")
    a = sub.add_parser("repair")
    a.add_argument("--write", action="store_true")
    a.add_argument("--audit", default="data/audit")
    a = sub.add_parser("taxonomy", help="turn a wide sheet into JSON")
    a.add_argument("file")
    a.add_argument("--out", default=None, help="write a JSON file there")
    args = p.parse_args(argv)
    spark = session()
    index, provider = Index(spark, args.index), LocalProvider()
    if args.command in ("ingest", "taxonomy") and not readers.exists(spark, args.file):
        raise SystemExit(f"Error: File {args.file} not found.")
    if args.command == "ingest":
        words = [r[0] for r in taxonomy.flat(readers.read_taxonomy(spark, args.taxonomy)).collect()] if args.taxonomy else []
        run_file(readers.read_table(spark, args.file), index, provider, taxonomy.as_array(words), args.offset, args.limit)
        print(f"{index.count()} records in the index")
    elif args.command == "search":
        began = time.time()
        hits = search.search(index.read(), args.query, provider, args.limit, not args.without_corrigenda)
        print(json.dumps(search.envelope(args.query, search.response(hits.orderBy("rank")), began), indent=2, ensure_ascii=False))
    elif args.command == "chat":
        print(search.chat(index.read(), args.id, args.question, provider))
    elif args.command == "distribution":
        audit.distribution(index.read()).show(truncate=False)
    elif args.command == "repair":
        audit.repair(index, args.audit, dry_run=not args.write).show(truncate=False)
    elif args.command == "taxonomy":
        sheet = readers.read_csv(spark, args.file, raw=False) if args.file.endswith(".csv") else readers.read_xlsx(spark, args.file)
        sectors = taxonomy.by_sector(taxonomy.from_wide(sheet.withColumn("_row", F.monotonically_increasing_id()), "_row"))
        if args.out:
            taxonomy.write_json(sectors, args.out)
        else:
            print(taxonomy.to_json(sectors).first()[0])


if __name__ == "__main__":
    main()
