"""Objectives of a route and the cost of an arc under each."""

from __future__ import annotations

from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from slopewise.sources.street_network import GRADES, choose

# Comfort by road class and mode.
WALK_COMFORT = {"steps": 1.6, "trunk": 1.15, "primary": 1.05}
BIKE_COMFORT = {"cycleway": 0.85, "living_street": 0.9, "residential": 0.95, "trunk": 1.9, "primary": 1.45, "secondary": 1.2, "footway": 1.5, "path": 1.1, "pedestrian": 1.4}
COMFORT = {"walk": WALK_COMFORT, "bike": BIKE_COMFORT}


@dataclass(frozen=True)
class Objective:
    """Weights of climbing, of steep stretches and of the steepest ones, against length."""

    name: str
    climb: float = 0.0
    steep: float = 0.0
    extreme: float = 0.0
    penalties: tuple[float, ...] = (0.0,) * len(GRADES)
    extra: float = 0.0
    comfort: bool = True

    def scaled(self, by: float) -> Objective:
        """All weights times by; nothing left of them, at 0, means length alone."""
        if by == 0:
            return replace(SHORTEST, name=f"{self.name}_x0")
        return replace(self, name=f"{self.name}_x{by:g}".replace(".", "_"), climb=self.climb * by, steep=self.steep * by, extreme=self.extreme * by)


SHORTEST = Objective("shortest", comfort=False)
MIN_CLIMB = Objective("min_climb", climb=120.0)
GRADE_AVERSE = Objective("grade_averse", 4.0, 12.0, 6.0, (0.25, 1.0, 3.0, 6.0, 15.0), 15.0)
BALANCED = Objective("balanced", 14.0, 2.0, 2.0, (0.25, 0.75, 2.0, 4.0, 10.0), 10.0)
OBJECTIVES = (SHORTEST, MIN_CLIMB, GRADE_AVERSE, BALANCED)
#: Scales of the sweep between the shortest and the flattest route.
SWEEP = (0.0, 0.1, 0.2, 0.35, 0.5, 0.75, 1.0, 1.5, 2.0, 3.0, 5.0, 8.0, 15.0)
FLOOR = 1e-6


def arc_cost(objective: Objective, mode: str) -> Column:
    """Terms with weight zero are left out, as no optimiser may drop 0 * x."""
    cost = F.col("len").cast("double")
    if objective.comfort:
        cost = cost * choose(F.col("cls"), COMFORT[mode], 1.0)
    if objective.climb:
        cost = cost + F.lit(objective.climb) * F.col("gain")
    if objective.steep:
        parts = [F.lit(p) * F.col(f"d_above_{k}") for k, p in zip(GRADES, objective.penalties, strict=True)]
        total = parts[0]
        for p in parts[1:]:
            total = total + p
        cost = cost + F.lit(objective.steep) * total
    if objective.extreme:
        cost = cost + F.lit(objective.extreme * objective.extra) * F.col(f"d_above_{GRADES[-1]}")
    return F.greatest(cost, F.lit(FLOOR))


def cost_sql(objective: Objective, mode: str) -> str:
    """The same cost as SQL text."""
    comfort = f"(CASE cls {' '.join(f"WHEN '{c}' THEN {v}::DOUBLE" for c, v in COMFORT[mode].items())} ELSE 1.0::DOUBLE END)" if objective.comfort else "1.0::DOUBLE"
    steep = " + ".join(f"{p}::DOUBLE * d_above_{k}" for k, p in zip(GRADES, objective.penalties, strict=True))
    return f"greatest(len * {comfort} + {objective.climb}::DOUBLE * gain + {objective.steep}::DOUBLE * ({steep}) + {objective.extreme * objective.extra}::DOUBLE * d_above_{GRADES[-1]}, {FLOOR}::DOUBLE)"


def costed(arcs: DataFrame, mode: str, objective: Objective) -> DataFrame:
    """The arcs that the mode may use, with their cost."""
    return arcs.where(F.col(mode)).withColumn("cost", arc_cost(objective, mode))


def best_parallel(costed: DataFrame) -> DataFrame:
    """One arc for each ordered pair of nodes: the cheapest, of equal ones that with the largest arc_id."""
    best = costed.groupBy("src", "dst").agg(F.max(F.struct((-F.col("cost")).alias("c"), "arc_id")).alias("b"))
    return best.select("src", "dst", F.col("b.arc_id").alias("arc_id"), (-F.col("b.c")).alias("cost"))
