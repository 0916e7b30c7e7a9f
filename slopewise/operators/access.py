"""Which road segments count, and who may use them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Classes and subclasses that no route uses, and those open to each mode.
NEVER_CLASSES = ("motorway", "motorway_link", "light_rail", "subway", "tram", "standard_gauge", "funicular", "rail")
NEVER_SUBCLASSES = ("sidewalk", "crosswalk", "driveway", "parking_aisle")
NEVER_FLAGS = ("is_abandoned", "is_under_construction", "is_proposed")
WALK_CLASSES = ("trunk", "primary", "secondary", "tertiary", "residential", "living_street", "unclassified", "service", "pedestrian", "footway", "path", "steps", "track", "cycleway", "bridleway", "unknown")
BIKE_CLASSES = tuple(c for c in WALK_CLASSES if c not in ("steps", "bridleway"))
PRIVATE = ("as_private", "as_employee", "as_student", "as_permitted")
VISITS = ("at_destination", "as_customer", "as_delivery")
MODES_NAMED = {"walk": ("foot", "pedestrian"), "bike": ("bicycle",)}
RULES = "array<struct<access_type: string, between: array<double>, when: struct<mode: array<string>, heading: string, during: string, recognized: array<string>, using: array<string>>>>"


def flags(road_flags: Column) -> Column:
    """All distinct values of the nested flag lists, none for null."""
    lists = F.transform(F.coalesce(road_flags, F.array().cast("array<struct<values: array<string>>>")), lambda f: F.coalesce(f["values"], F.array().cast("array<string>")))
    return F.array_distinct(F.flatten(lists))


def base_filter(segments: DataFrame) -> DataFrame:
    """Road segments that some route may use; a null class becomes `unknown`."""
    barred = F.array(*[F.lit(f) for f in NEVER_FLAGS])
    rows = segments.where(F.col("subtype") == "road").withColumn("class", F.coalesce("class", F.lit("unknown")))
    rows = rows.where(~F.col("class").isin(*NEVER_CLASSES) & ~F.coalesce(F.col("subclass").isin(*NEVER_SUBCLASSES), F.lit(False)))
    return rows.where(~F.arrays_overlap(flags(F.col("road_flags")), barred))


def _any_of(values: Column, names: tuple[str, ...]) -> Column:
    return F.coalesce(F.arrays_overlap(values, F.array(*[F.lit(n) for n in names])), F.lit(False))


def access(rules: Column, mode: str, default: bool = True) -> Column:
    """Struct (allowed, oneway, restricted, partial) after all rules that apply to the mode.

    Rules that name no mode come first, then those that do, each in document
    order. Rules for certain times say nothing; rules for a heading only tell
    one-way streets; permits and partial rules only restrict.
    """
    rules = F.coalesce(rules.cast(RULES), F.array().cast(RULES))
    names = lambda r: F.coalesce(r["when"]["mode"], F.array().cast("array<string>"))
    general = F.filter(rules, lambda r: F.size(names(r)) == 0)
    named = F.filter(rules, lambda r: _any_of(names(r), MODES_NAMED[mode]))
    state = lambda allowed, oneway, restricted, partial: F.struct(allowed.alias("allowed"), oneway.alias("oneway"), restricted.alias("restricted"), partial.alias("partial"))

    def apply(s: Column, r: Column) -> Column:
        when = r["when"]
        denied, permits = r["access_type"] == "denied", F.coalesce(r["access_type"].isin("allowed", "designated"), F.lit(False))
        heading, back = when["heading"].isNotNull(), F.coalesce(when["heading"] == "backward", F.lit(False))
        oneway = F.when(back & denied, True).when(back & permits, False).otherwise(s["oneway"])
        bound = _any_of(when["recognized"], PRIVATE) | _any_of(when["using"], VISITS)
        part = F.coalesce(F.size(r["between"]) > 0, F.lit(False))
        skip = when["during"].isNotNull()
        plain = F.when(
            bound,
            F.when(permits, state(s["allowed"] & part, s["oneway"], F.lit(True), s["partial"])).otherwise(s),
        ).when(part, state(s["allowed"], s["oneway"], s["restricted"], F.lit(True)))
        plain = plain.otherwise(state(permits, s["oneway"], s["restricted"] & ~(permits & (F.size(names(r)) > 0)), s["partial"]))
        return F.when(skip, s).when(heading, state(s["allowed"], oneway, s["restricted"], s["partial"])).otherwise(plain)

    start = state(F.lit(default), F.lit(False), F.lit(False), F.lit(False))
    return F.aggregate(F.concat(general, named), start, apply)


def class_open(cls: Column, mode: str) -> Column:
    return cls.isin(*(WALK_CLASSES if mode == "walk" else BIKE_CLASSES))


def bike_facility(cls: Column, bike_ok: Column) -> Column:
    return F.when(cls == "cycleway", "dedicated_cycleway").when(cls.isin("path", "footway") & bike_ok, "shared_path").when(cls == "living_street", "living_street").when(cls == "pedestrian", "car_free_street").otherwise("")


def low_stress(cls: Column, facility: Column) -> Column:
    return (facility != "") | cls.isin("residential", "living_street", "pedestrian")


# Comfort by class, by facility, and what a signed route does to a street.
CLASS_STRESS = {"cycleway": 0.8, "living_street": 0.9, "path": 1.0, "residential": 1.0, "unclassified": 1.0, "track": 1.1, "service": 1.1, "unknown": 1.1, "pedestrian": 1.2, "tertiary": 1.2, "footway": 1.3, "secondary": 1.4, "primary": 1.6, "trunk": 2.0}
FACILITY_STRESS = {"path": 0.8, "separated": 0.8, "buffered_lane": 0.9, "lane": 1.0, "neighborway": 0.9}
FACILITY_OF = {"TRAIL": "path", "BKF-OFFST": "path", "BKF-PBL": "separated", "BKF-BBL": "buffered_lane", "BKF-BL": "lane", "BKF-CLMB": "lane", "BKF-NGW": "neighborway", "BKF-SHW": "route"}
#: Facilities from the least to the most protected.
FACILITIES = ("", "route", "neighborway", "lane", "buffered_lane", "separated", "path")
UNLISTED, ROUTE_SHARE, ROUTE_MOST, ROUTE_LEAST = 1.1, 0.95, 1.2, 0.9


def bike_stress(cls: Column, facility: Column) -> Column:
    """Comfort multiplier: that of the class, or better where a facility is; signed routes soften a street a little."""
    from slopewise.sources.street_network import choose

    street = choose(cls, CLASS_STRESS, UNLISTED)
    on_route = F.greatest(F.lit(ROUTE_LEAST), F.least(street, F.lit(ROUTE_MOST)) * ROUTE_SHARE)
    return F.when(facility == "route", on_route).otherwise(F.least(street, choose(facility, FACILITY_STRESS, 1e9)))
