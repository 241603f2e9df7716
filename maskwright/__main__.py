"""Command line.

``python -m maskwright NAME FOLDER [OUT]`` runs a named query: writes Parquet to OUT or shows twenty rows. Without a name, lists the queries.
``... parse FOLDER OUT`` reads files into documents, ``... validate FILE`` checks JSON lines, ``... report FIXTURES RAW OUT`` writes the report of a run (Parquet folders),
``... detectors`` lists detectors and what they lack.
"""

from __future__ import annotations

import sys

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from maskwright.operators import detect, records, report
from maskwright.plans.queries import QUERIES
from maskwright.session import local_session, ship_package
from maskwright.sources.documents import parse_many
from maskwright.sources.fixtures import load_run


def parse(spark: SparkSession, folder: str, out: str) -> int:
    docs, skipped = parse_many(spark, folder)
    docs.write.mode("overwrite").parquet(out)
    skipped.show(100, truncate=False)
    return 0


def validate(spark: SparkSession, path: str) -> int:
    lines = spark.read.text(path).select(F.monotonically_increasing_id().alias("line"), "value")
    bad = records.validate_jsonl(lines)
    bad.show(200, truncate=False)
    return 1 if bad.limit(1).count() else 0


def write(spark: SparkSession, fixtures: str, raw: str, out: str) -> int:
    rows, results = load_run(spark, fixtures, raw)
    report.write_report(out, report.run_report(rows, results, {}))
    return 0


COMMANDS = {"parse": (parse, 2), "validate": (validate, 1), "report": (write, 3)}


def main(args: list[str]) -> int:
    if args[:1] == ["detectors"]:
        print(*detect.describe(), sep="\n")
        return 0
    name, rest = (args[0], args[1:]) if args else ("", [])
    if name in COMMANDS and len(rest) == COMMANDS[name][1] or name in QUERIES and len(rest) in (1, 2):
        spark = SparkSession.getActiveSession() or local_session()
        ship_package(spark)
        if name in COMMANDS:
            return COMMANDS[name][0](spark, *rest)
        rows = QUERIES[name](spark, rest[0])
        if len(rest) == 2:
            rows.write.mode("overwrite").parquet(rest[1])
        else:
            rows.show(20, truncate=80)
        return 0
    print(__doc__, "\n", *sorted(QUERIES))
    return 2


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
