"""Command line: `python -m millrace.cli <command>`; declarations come from a Python module's attributes."""

from __future__ import annotations

import argparse
import importlib
import sys

from pyspark.sql import SparkSession

from millrace.dates import PartitionRange
from millrace.plans import planner, staging
from millrace.plans.join import compute_group_by, compute_join
from millrace.sources.tables import Catalog, export_table


def main(argv: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="millrace")
    sub = p.add_subparsers(dest="command", required=True)
    for name in ("group-by-backfill", "join", "staging-query-backfill", "plan"):
        c = sub.add_parser(name)
        c.add_argument("--conf", required=True, help="module:attribute of the declaration")
        if name != "plan":
            c.add_argument("--start", required=name != "staging-query-backfill")
            c.add_argument("--end", required=True)
            c.add_argument("--output")
    e = sub.add_parser("export")
    e.add_argument("--table", required=True)
    e.add_argument("--path", required=True)
    e.add_argument("--format", default="parquet")
    a = p.parse_args(argv)
    if a.command != "export":
        module, _, attribute = a.conf.partition(":")
        conf = getattr(importlib.import_module(module), attribute)
    if a.command == "plan":
        for n in planner.plan_join(conf) if hasattr(conf, "left") else planner.plan_group_by(conf):
            print(n.kind, n.output, n.hash, *n.inputs)
        return 0
    spark = SparkSession.builder.getOrCreate()
    catalog = Catalog(spark)
    if a.command == "export":
        export_table(catalog.read(a.table), a.path, a.format)
    elif a.command == "staging-query-backfill":
        staging.backfill(catalog, conf, a.end)
    else:
        days = PartitionRange(a.start, a.end)
        out = compute_join(catalog, conf, days) if a.command == "join" else compute_group_by(catalog, conf, days)
        catalog.insert(out, a.output or conf.name)
    return 0


if __name__ == "__main__":
    sys.exit(main())
