"""Invariants of the network and its routes, a report, and a sweep over weights."""

from __future__ import annotations

from dataclasses import replace
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from slopewise.operators import paths
from slopewise.operators.costs import OBJECTIVES, SHORTEST, Objective
from slopewise.plans import routing
from slopewise.plans.registry import query
from slopewise.sources import street_network as net


def _violations(name: str, rows: DataFrame, wrong) -> DataFrame:
    return rows.agg(F.count_if(wrong).alias("wrong"), F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("check"), (F.col("wrong") == 0).alias("ok"), F.concat("wrong", F.lit(" of "), "n").alias("detail"))


def validate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(check, ok, detail): one row an invariant."""
    arcs = net.arcs(spark, sf_dir)
    pairs = arcs.groupBy("edge_id").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("gain") - F.col("loss")).alias("net"), F.max("gain").alias("g"), F.max("loss").alias("l"))
    nested = reduce(lambda a, b: a | b, [F.col(f"d_above_{b}") > F.col(f"d_above_{a}") for a, b in zip(net.GRADES, net.GRADES[1:], strict=False)])
    compared = routing._compared(spark, sf_dir)
    means = compared.groupBy(F.lit(1).alias("one")).pivot("objective", [o.name for o in OBJECTIVES]).agg(F.avg("gain"))
    checks = [
        _violations("two arcs an edge", pairs, F.col("n") != 2),
        _violations("climb one way is descent the other", pairs, (F.col("net") != 0) | (F.col("g") != F.col("l"))),
        _violations("steeper stretches are within less steep ones", arcs, nested | (F.col("d_above_3") > F.col("len"))),
        _violations("no bicycle on steps", arcs, (F.col("cls") == "steps") & F.col("bike")),
        _violations("nothing is shorter than the shortest", compared, F.col("detour_ratio") < 0.999),
        _violations("a route's gain less its loss is its net", compared, F.col("gain") - F.col("loss") != F.col("net")),
        _violations("less climb under min_climb and balanced", means, ~((F.col("min_climb") <= F.col("balanced")) & (F.col("balanced") <= F.col("shortest")))),
    ]
    return reduce(DataFrame.unionByName, checks)


@query("validate", "SELECT * FROM (VALUES ('two arcs an edge'), ('climb one way is descent the other'), ('steeper stretches are within less steep ones'), ('no bicycle on steps'), ('nothing is shorter than the shortest'), ('a route''s gain less its loss is its net'), ('less climb under min_climb and balanced')) AS t(\"check\"), (VALUES (true)) AS o(ok)")
def validate_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return validate(spark, sf_dir).select("check", "ok")


def varied(objectives: tuple[Objective, ...]) -> tuple[Objective, ...]:
    """The shortest, the objectives, and each of them with every weight halved and doubled in turn."""
    tries = [SHORTEST, *objectives]
    for o in objectives:
        for weight in ("climb", "steep", "extreme"):
            tries += [replace(o, name=f"{o.name}_{weight}_{word}", **{weight: getattr(o, weight) * by}) for word, by in (("half", 0.5), ("double", 2.0))]
    return tuple(tries)


def sweep(spark: SparkSession, sf_dir: str, objectives: tuple[Objective, ...]) -> DataFrame:
    """(objective, distance, gain): route means with every weight halved and doubled in turn."""
    steps = routing.trips(spark, sf_dir, objectives=varied(objectives), requests=routing._requests(spark, sf_dir, only_first=True)).withColumn("request", F.struct("objective", "request"))
    rows = paths.summary(steps, routing._measured(spark, sf_dir)).select("request.objective", "distance", "gain")
    return rows.groupBy("objective").agg(F.round(F.avg("distance"), 3).alias("distance"), F.round(F.avg("gain"), 3).alias("gain")).orderBy("objective")


@query(
    "sensitivity",
    f"""WITH {routing.routes_sql(varied((OBJECTIVES[-1],)), only_first=True)}, s AS (SELECT objective, request, sum(len) AS distance, sum(gain) AS gain FROM step JOIN arc USING (arc_id) GROUP BY objective, request)
       SELECT objective, round(avg(distance), 3) AS distance, round(avg(gain), 3) AS gain FROM s GROUP BY objective""",
)
def sensitivity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sweep(spark, sf_dir, (OBJECTIVES[-1],))


def flat_route_verdicts(compared: DataFrame) -> DataFrame:
    """(request, choice, excess, ok): the flat option of a trip and whether it climbs at most half as much beyond need as the shortest.

    The option is that of min_climb and balanced with the least excess within
    1.35 times the shortest, else min_climb; excess is gain beyond the net rise.
    """
    rows = compared.withColumn("excess", F.greatest(F.lit(0), F.col("gain") - F.abs("net")))
    base = rows.where("objective = 'shortest'").select("request", F.col("excess").alias("base"))
    options = rows.where("objective in ('min_climb', 'balanced')").withColumn("far", F.col("detour_ratio") > 1.35)
    rank = F.struct(F.when(F.col("far"), 1).otherwise(0).alias("a"), F.when(F.col("far"), F.when(F.col("objective") == "min_climb", 0).otherwise(1)).otherwise(F.col("excess")).alias("b"), "objective", "excess")
    best = options.groupBy("request").agg(F.min(rank).alias("r"))
    return best.join(base, "request").select("request", F.col("r.objective").alias("choice"), F.col("r.excess").alias("excess"), (F.col("r.excess") * 2 <= F.col("base")).alias("ok"))


@query(
    "flat_route",
    f"""WITH {routing._COMPARED}, o AS (SELECT request, objective, detour_ratio > 1.35::DOUBLE AS far, greatest(0, gain - abs(net)) AS excess FROM compared WHERE objective IN ('min_climb', 'balanced')),
            b AS (SELECT request, greatest(0, gain - abs(net)) AS base FROM compared WHERE objective = 'shortest')
       SELECT o.request, o.objective AS choice, o.excess, o.excess * 2 <= base AS ok FROM o JOIN b USING (request)
       QUALIFY row_number() OVER (PARTITION BY o.request ORDER BY far, CASE WHEN far THEN CASE WHEN objective = 'min_climb' THEN 0 ELSE 1 END ELSE excess END, objective) = 1""",
)
def flat_route(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flat_route_verdicts(routing._compared(spark, sf_dir))


def _table(title: str, columns: dict[str, str], rows: list) -> list[str]:
    """Lines of a Markdown table; columns are headings and how to format a row for them."""
    out = ["", f"## {title}", "", "| " + " | ".join(columns) + " |", "| " + " | ".join("---" for _ in columns) + " |"]
    return out + ["| " + " | ".join(form.format(r=r) for form in columns.values()) + " |" for r in rows]


def report(spark: SparkSession, sf_dir: str, most: int = 10) -> str:
    """Markdown with the means of each objective, the trips that save most, corridors, passes, barriers, and the checks of streets and heights."""
    from slopewise.plans.catalogue import QUERIES

    rows = lambda name, *order: QUERIES[name](spark, sf_dir).orderBy(*order).limit(most).collect()
    lines = ["# Routes", "", "| objective | trips | detour | saved % | gain | distance |", "| --- | --- | --- | --- | --- | --- |"]
    for r in QUERIES["mean_by_profile"](spark, sf_dir).orderBy("objective").collect():
        lines.append(f"| {r.objective} | {r.n} | {r.detour_ratio:.3f} | {r.saved_pct:.1f} | {r.gain / 100:.1f} m | {r.distance / 100_000:.2f} km |")
    top = routing._compared(spark, sf_dir).where("objective = 'balanced'").withColumns({"saved_m": F.col("saved") / 100, "detour_m": F.col("detour") / 100}).orderBy(F.desc("saved"), "request").limit(most).collect()
    lines += _table("Trips that save most", {"from": "{r.origin}", "to": "{r.destination}", "saved": "{r.saved_m:.1f} m", "detour": "{r.detour_m:.0f} m"}, top)
    lines += _table("Corridors", {"rank": "{r.rank}", "streets": "{r.names}", "length in cm": "{r.length}", "trips": "{r.pairs}", "score": "{r.total_score:.1f}"}, rows("corridors", "rank"))
    lines += _table("Passes", {"edge": "{r.edge_id}", "pairs": "{r.pairs}", "height in cm": "{r.height:.0f}"}, rows("critical_passes", F.desc("pairs"), "edge_id"))
    lines += _table("Barriers", {"edge": "{r.edge_id}", "shortest": "{r.shortest}", "flat": "{r.flat:.2f}", "score": "{r.score:.2f}"}, rows("barriers", F.desc("score"), "edge_id"))
    lines += _table("Steep streets", {"street": "{r.name}", "steepest %": "{r.steepest:.1f}", "as published": "{r.ok}"}, rows("steep_streets", F.desc("steepest"), "name"))
    lines += _table("Flat streets", {"street": "{r.name}", "gain in m per km": "{r.gain_per_km:.1f}", "flat": "{r.flat}"}, rows("flat_streets", "gain_per_km", "name"))
    lines += _table("Flat options of trips", {"trip": "{r.request}", "choice": "{r.choice}", "needless climb in cm": "{r.excess}", "ok": "{r.ok}"}, rows("flat_route", F.desc("excess"), "request"))
    lines += _table("Heights against the other model", {"mean": "{r.mean:.2f}", "median": "{r.median:.2f}", "root mean square": "{r.rms:.2f}", "near": "{r.near:.2f}"}, rows("dem_agreement", "mean"))
    return "\n".join(lines) + "\n"
