"""python -m codexmill.cli COMMAND: reports over snapshot files."""

from __future__ import annotations

import argparse
import json
import sys
from pathlib import Path

from pyspark.sql import SparkSession

import codexmill
from codexmill.operators.workspace import scope
from codexmill.plans import reports
from codexmill.plans.shipping import ship
from codexmill.sources import snapshot


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="codexmill", description="Audits of legal-text snapshots on Spark.")
    p.add_argument("--version", action="version", version=codexmill.__version__)
    sub = p.add_subparsers(dest="command", required=True)
    for name in [*reports.REPORTS, "manifest"]:
        s = sub.add_parser(name)
        s.add_argument("files", nargs="+", help="Parquet files or globs")
        s.add_argument("--snapshot", required=True)
        s.add_argument("--out", help="write here instead of to standard output")
    s = sub.add_parser("diff")
    s.add_argument("--old", nargs="+", required=True)
    s.add_argument("--new", nargs="+", required=True)
    s.add_argument("--out")
    for s in sub.choices.values():
        s.add_argument("--rows", type=int, default=reports.SHOWN, help="most rows of a table")
    return p


def main(args: list[str] | None = None) -> int:
    a = parser().parse_args(args)
    spark = SparkSession.builder.appName("codexmill").getOrCreate()
    ship(spark)
    reports.SHOWN = a.rows
    with scope(spark):
        text = _text(spark, a)
    if a.out:
        Path(a.out).write_text(text)
    else:
        sys.stdout.write(text)
    return 0


def _text(spark: SparkSession, a: argparse.Namespace) -> str:
    if a.command == "manifest":
        return json.dumps(snapshot.build_manifest(spark, a.files, a.snapshot), indent=2) + "\n"
    if a.command == "diff":
        return reports.difference_report(snapshot.scan_snapshot(spark, a.old, "old"), snapshot.scan_snapshot(spark, a.new, "new"))
    return reports.file_report(spark, a.command, a.files, a.snapshot)


if __name__ == "__main__":
    sys.exit(main())
