"""Stays made and persons' days judged where trips are together."""

import random

from airexposure.operators import activity, staypoints
from airexposure.plans import catalog

TRIP = "person_id string, orig_lon double, orig_lat double, dest_lon double, dest_lat double, home_lon double, home_lat double, start_s int, end_s int, declared_minutes double, purpose string, mode string"


def test_days_are_judged_before_stays_are_made(spark):
    rng = random.Random(3)
    rows = [(f"p{p}", 0.0, 0.0, 1.0, rng.random(), 0.0, 0.0, (a := 10_000 * k + 600 * rng.randint(0, 9)), (b := a + 600 * rng.randint(0, 5)), rng.choice([(b - a) / 60] * 9 + [None, 500.0]), rng.choice(["work", None]), "walking") for p in range(60) for k in range(rng.randint(1, 4))]
    rows += [("none", 0.0, 0.0, 1.0, 1.0, 0.0, 0.0, 0, 86_399, -1.0, "shop", None), ("nan", 0.0, 0.0, 1.0, 1.0, 0.0, 0.0, 100, 200, float("nan"), "shop", None)]
    trips = spark.createDataFrame(rows, TRIP)
    made = staypoints.stay_points(trips, activity.TOLERANCE)
    every = staypoints.stay_points(trips)
    want = activity.whole_days(every)
    key = lambda r: (r.person_id, r.seq)
    got = sorted(made.collect(), key=key)
    assert got == sorted(want.collect(), key=key) and 0 < len({r.person_id for r in got}) < 60
    assert {r.person_id for r in every.collect()} == {r[0] for r in rows} - {"none"} and all(r.duration_hours > 0 for r in got)
    assert made.schema == every.schema


def test_stays_of_a_query_are_sorted_once(spark):
    """By customer, by person for the origins, by person for the stays, and not again for the hours of the day."""
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        plan = catalog.stays(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
    assert plan.count("Sort [") == 3 and "lambda" not in plan
