"""Command line: python -m slopewise.cli COMMAND.

sources   what the engine reads
queries   the names of all registered queries
run       one query over a folder of tables, shown or written
route     one trip between two neighbourhoods under each objective
validate  the checks, one line each
report    a markdown report of the comparisons
sweep     route means while one weight at a time changes
"""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from slopewise.config import Settings
from slopewise.operators import costs, paths
from slopewise.plans import catalogue, checks, layers, routing, sensitivity, streets
from slopewise.sources import files


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="slopewise", description=__doc__, formatter_class=argparse.RawDescriptionHelpFormatter)
    top.add_argument("--tables", default="/root/testdata/sf0.001", help="folder of the tables")
    commands = top.add_subparsers(dest="command", required=True)
    commands.add_parser("sources")
    commands.add_parser("queries")
    run = commands.add_parser("run")
    run.add_argument("query")
    run.add_argument("--to", help="write Parquet here rather than show rows")
    route = commands.add_parser("route")
    route.add_argument("--from", dest="origin", type=int, required=True)
    route.add_argument("--to", dest="destination", type=int, required=True)
    route.add_argument("--mode", choices=("walk", "bike"), default="walk")
    for name in ("validate", "report", "sweep"):
        commands.add_parser(name)
    maps = commands.add_parser("layers", help="map layers as GeoJSON")
    maps.add_argument("--to", required=True, help="folder for a folder of each layer")
    grid = commands.add_parser("sensitivity", help="the whole analysis again with one setting changed at a time")
    grid.add_argument("--to", required=True, help="folder for summary.json, sensitivity.csv and sensitivity.md")
    grid.add_argument("--runs", nargs="*", choices=sorted(sensitivity.RUNS), help="some of the runs; the first is compared with")
    grid.add_argument("--settings", help="a JSON object of settings for all runs")
    return top


def route(spark: SparkSession, tables: str, origin: int, destination: int, mode: str) -> DataFrame | None:
    """Each objective's route between two neighbourhoods; None if one of them is not known."""
    points = {r.hood: r.node for r in streets.access_points(spark, tables).collect()}
    if origin not in points or destination not in points:
        print("unknown neighbourhood; there are:", *sorted(points), file=sys.stderr)
        return None
    asked = spark.createDataFrame([(1, points[origin], points[destination])], "request long, source long, target long")
    steps = routing.trips(spark, tables, mode, requests=asked).withColumn("request", F.struct("objective", "request"))
    rows = paths.summary(steps, routing._measured(spark, tables)).select("request.objective", "request.request", "distance", "gain", "loss", "max_grade")
    return paths.comparisons(rows.withColumns({"mode": F.lit(mode), "origin": F.lit(origin), "destination": F.lit(destination)}))


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    args = parser().parse_args(argv)
    if args.command == "queries":
        print(*sorted(catalogue.QUERIES), sep="\n")
        return 0
    spark = spark or SparkSession.builder.getOrCreate()
    if args.command == "sources":
        files.datasets(spark).show(truncate=False)
    elif args.command == "run":
        if args.query not in catalogue.QUERIES:
            print("unknown query", args.query, file=sys.stderr)
            return 2
        rows = catalogue.QUERIES[args.query](spark, args.tables)
        rows.write.mode("overwrite").parquet(args.to) if args.to else rows.show(truncate=False)
    elif args.command == "route":
        rows = route(spark, args.tables, args.origin, args.destination, args.mode)
        if rows is None:
            return 2
        rows.show(truncate=False)
    elif args.command == "validate":
        found = checks.validate(spark, args.tables).collect()
        for r in found:
            print("ok  " if r.ok else "FAIL", r.check, r.detail)
        return int(not all(r.ok for r in found))
    elif args.command == "layers":
        print(*layers.write(spark, args.tables, args.to), sep="\n")
    elif args.command == "sensitivity":
        runs = {k: sensitivity.RUNS[k] for k in args.runs or sensitivity.RUNS}
        sensitivity.write(sensitivity.sweep(spark, args.tables, runs, Settings().overridden(args.settings)), args.to)
    elif args.command == "report":
        print(checks.report(spark, args.tables))
    else:
        checks.sweep(spark, args.tables, (costs.BALANCED, costs.GRADE_AVERSE)).show(truncate=False)
    return 0


if __name__ == "__main__":
    sys.exit(main())
