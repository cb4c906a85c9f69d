"""Commands over local files: python -m hemiciclo.cli COMMAND ... (catalog, search, export, candidates, audit)."""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import functions as F

from hemiciclo.plans import domains, extraction, services
from hemiciclo.session import get_spark
from hemiciclo.sources import catalog, records, sinks

DOMAINS = {"deputies": (domains.deputies, "deputy_id"), "interests": (domains.interests, "interest_id"), "interventions": (domains.interventions, "intervention_id")}


def _raw(spark, path: str):
    rows = records.read_csv(spark, path) if path.endswith(".csv") else records.read_json(spark, path)
    return rows.select("record", F.sha2("path", 256).alias("source_sha256"), F.lit("1970-01-01").alias("snapshot_date"))


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="hemiciclo")
    commands = parser.add_subparsers(dest="command", required=True)
    c = commands.add_parser("catalog", help="select resources of a frozen catalogue")
    c.add_argument("path")
    c.add_argument("--family", action="append", default=[])
    c.add_argument("--format", action="append", default=[])
    c = commands.add_parser("search", help="matching records of a raw file, as JSON lines")
    c.add_argument("domain", choices=sorted(DOMAINS))
    c.add_argument("path")
    c.add_argument("--filter", action="append", default=[], metavar="NAME=TEXT")
    c.add_argument("--legislature", action="append", default=[])
    c.add_argument("--max-results", type=int, default=50_000)
    c = commands.add_parser("export", help="records of a raw file to a folder")
    c.add_argument("domain", choices=sorted(DOMAINS))
    c.add_argument("path")
    c.add_argument("output")
    c.add_argument("--format", default="parquet", choices=sinks.FORMATS)
    c = commands.add_parser("candidates", help="regular expression candidates of text files")
    c.add_argument("path")
    c.add_argument("pattern")
    a = parser.parse_args(argv)
    spark = get_spark()
    if a.command == "catalog":
        out = catalog.select_resources(catalog.read_catalog(spark, a.path), a.family, (), a.format)
    elif a.command == "candidates":
        texts = spark.read.text(a.path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))
        out = extraction.regex_candidates(texts, [extraction.Rule("pattern", a.pattern)], key="path")
    else:
        make, identity = DOMAINS[a.domain]
        rows = make(_raw(spark, a.path))
        if a.command == "export":
            sinks.export_records(rows, a.output, format_name=a.format)
            return 0
        query = services.Query(tuple(a.legislature), dict(f.split("=", 1) for f in a.filter), max_results=a.max_results)
        out = services.search(rows, query, identity=identity, service=a.domain)
    for line in out.select(sinks.json_line().alias("line")).toLocalIterator():
        sys.stdout.write(line["line"] + "\n")
    return 0


if __name__ == "__main__":
    sys.exit(main())
