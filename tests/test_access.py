import pytest
from pyspark.sql import functions as F

from slopewise.operators import access

DENY, ALLOW = {"access_type": "denied"}, {"access_type": "allowed"}


def rule(kind, between=None, **when):
    return {"access_type": kind, "between": between, "when": when or None}


#: Rules, mode, and what they mean: allowed, oneway, restricted, partial.
CASES = [
    (None, "walk", (True, False, False, False)),
    ([], "bike", (True, False, False, False)),
    ([rule("denied")], "walk", (False, False, False, False)),
    ([rule("denied"), rule("allowed", mode=["foot"])], "walk", (True, False, False, False)),
    ([rule("denied"), rule("allowed", mode=["foot"])], "bike", (False, False, False, False)),
    ([rule("allowed", mode=["pedestrian"]), rule("denied")], "walk", (True, False, False, False)),
    ([rule("denied", mode=["car"])], "walk", (True, False, False, False)),
    ([rule("denied", heading="backward")], "bike", (True, True, False, False)),
    ([rule("denied", heading="backward"), rule("allowed", mode=["bicycle"], heading="backward")], "bike", (True, False, False, False)),
    ([rule("denied", heading="forward")], "bike", (True, False, False, False)),
    ([rule("denied", during="Mo-Fr 07:00-09:00")], "walk", (True, False, False, False)),
    ([rule("denied", between=[0.1, 0.3])], "walk", (True, False, False, True)),
    ([rule("allowed", recognized=["as_private"])], "walk", (False, False, True, False)),
    ([rule("allowed", between=[0.1, 0.3], using=["as_customer"])], "walk", (True, False, True, False)),
    ([rule("allowed", recognized=["as_private"]), rule("allowed", mode=["foot"])], "walk", (True, False, False, False)),
    ([rule("designated", mode=["bicycle"])], "bike", (True, False, False, False)),
    ([rule(None)], "walk", (False, False, False, False)),
]


@pytest.mark.parametrize("rules, mode, meaning", CASES)
def test_access_rules(spark, rules, mode, meaning):
    rows = [(None if rules is None else [(r["access_type"], r["between"], r["when"] and tuple(r["when"].get(k) for k in ("mode", "heading", "during", "recognized", "using"))) for r in rules],)]
    df = spark.createDataFrame(rows, f"rules {access.RULES}")
    assert tuple(df.select(access.access(F.col("rules"), mode).alias("a")).first().a) == meaning


def test_flags_and_base_filter(spark):
    flag = "array<struct<values: array<string>>>"
    rows = [
        (1, "road", "primary", None, None), (2, "rail", "primary", None, None), (3, "road", None, None, [(["is_bridge"],), (None,)]), (4, "road", "motorway", None, None),
        (5, "road", "footway", "sidewalk", None), (6, "road", "primary", None, [(["is_bridge", "is_abandoned"],)]), (7, "road", "footway", "other", [(["is_bridge"],), (["is_bridge"],)]),
    ]
    df = spark.createDataFrame(rows, f"id int, subtype string, class string, subclass string, road_flags {flag}")
    assert [(r.id, r["class"]) for r in access.base_filter(df).orderBy("id").collect()] == [(1, "primary"), (3, "unknown"), (7, "footway")]
    assert [r.f for r in df.orderBy("id").select(access.flags(F.col("road_flags")).alias("f")).collect()][-1] == ["is_bridge"]


@pytest.mark.parametrize("cls, facility, stress", [("residential", "", 1.0), ("trunk", "", 2.0), ("trunk", "separated", 0.8), ("cycleway", "lane", 0.8), ("primary", "route", 1.14), ("living_street", "route", 0.9), ("odd", "", 1.1), ("secondary", "neighborway", 0.9)])
def test_bike_stress(spark, cls, facility, stress):
    got = spark.createDataFrame([(cls, facility)], "c string, f string").select(access.bike_stress(F.col("c"), F.col("f")).alias("s")).first().s
    assert got == pytest.approx(stress)
