import math

import pytest
from pyspark.sql import functions as F

from airexposure.operators import activity, exposure, field, staypoints, workoutdoor


def column(spark, f, values, kind="string"):
    return [r[0] for r in spark.createDataFrame([(v,) for v in values], f"v {kind}").select(f(F.col("v"))).collect()]


def test_soc_codes(spark):
    assert column(spark, workoutdoor.soc_code, ["11-1011.00", "11-1011", "11-0000", "not-a-soc", None]) == ["11-1011", "11-1011", "11-0000", None, None]


def test_industry_groups(spark):
    got = column(spark, workoutdoor.industry_group, ["naics62_health_care", "NAICS31_33_manufacturing", "not_working", None, "unknown industry"])
    assert [tuple(g) for g in got] == [("62", "ok"), ("31_33", "ok"), (None, "not_working"), (None, "missing"), (None, "unparsed")]


def test_outdoor_probability(spark):
    onet = spark.createDataFrame([("11-1011.00", "a", "CXP", 4, 40.0), ("11-1011.00", "a", "CXP", 5, 30.0), ("11-1011.00", "b", "CXP", 5, 40.0), ("13-1011.00", "a", "CXP", 4, 10.0), ("13-1011.00", "b", "CXP", 4, 20.0)], "soc string, element string, scale_id string, category int, value double")
    oews = spark.createDataFrame([("110000", "11-1011", "detailed", "100"), ("110000", "13-1011", "detailed", "300")], "naics string, soc string, o_group string, tot_emp string")
    sectors = workoutdoor.sector_probabilities(workoutdoor.sector_weights(oews), workoutdoor.soc_shares(onet, ["a", "b"]))
    people = spark.createDataFrame([("p1", "naics11_farm"), ("p2", "not_working")], "person_id string, industry string")
    got = {r.person_id: r for r in workoutdoor.assign(people, sectors).collect()}
    assert got["p1"].p_outdoor == pytest.approx((0.82 * 100 + 0.28 * 300) / 400)
    assert got["p2"].reason == "not_working"


def test_times_and_numbers(spark):
    assert column(spark, activity.seconds_of_day, ["9:05:00", "09:05:07", "24:00:00", "x", None]) == [32700, 32707, None, None, None]
    assert column(spark, activity.clean_number, [" 12.5 ", "1e3", "12d", "nan", "Out of Region", None]) == [12.5, 1000.0, None, None, None, None]


TRIP = "person_id string, orig_lon double, orig_lat double, dest_lon double, dest_lat double, home_lon double, home_lat double, start_s long, end_s long, declared_minutes long, purpose string, mode string"


def test_stay_points_of_a_day(spark):
    trips = spark.createDataFrame([("p", 0.0, 0.0, 1.0, 1.0, 0.0, 0.0, 28_800, 30_600, 30, "work", "walking"), ("p", 1.0, 1.0, 0.0, 0.0, 0.0, 0.0, 61_200, 63_000, 30, "home", "biking")], TRIP)
    rows = staypoints.with_microenvironment(staypoints.stay_points(trips)).orderBy("start_s", "seq").collect()
    assert [r.activity_type for r in rows] == ["pre_work", "travel_work", "stay_work", "travel_home", "post_home"]
    assert [r.microenv for r in rows] == ["home_indoor", "outdoor_near_road", "work_indoor", "outdoor_near_road", "home_indoor"]
    assert sum(r.duration_hours for r in rows) == pytest.approx(24, abs=0.01)
    pieces = staypoints.travel_halves(staypoints.split_intervals(staypoints.stay_points(trips)))
    assert pieces.agg(F.sum("duration_hours")).head()[0] == pytest.approx(86_399 / 3600)
    assert pieces.filter("location_type = 'travel' and half = 1").count() == 2


def test_nearest_equals_brute_force(spark):
    cells = [(i * 1.0, j * 1.0, 0, float(10 * i + j)) for i in range(4) for j in range(3)]
    points = [(x * 0.73 - 2, x * 0.31 + 0.1, 0) for x in range(12)]
    got = field.nearest_join(spark.createDataFrame(points, "lon double, lat double, slot int"), spark.createDataFrame(cells, "lon double, lat double, slot int, v double"), ["v"], 0.4).collect()
    assert len(got) == len(points)
    for r in got:
        d = min((math.hypot(r.lon - c[0], r.lat - c[1]), c[0], c[1], c[3]) for c in cells)
        assert (r.distance, r.v) == (pytest.approx(d[0]), d[3])


def test_slots_tie_to_the_earlier(spark):
    assert column(spark, lambda c: field.nearest_slot(c, [0, 30, 60]), [0, 15, 16, 1439, None], "int") == [0, 0, 30, 60, 0]


def test_curve_ends_at_total(spark):
    rows = spark.createDataFrame([("p", "origin", 0.0, 450.0, 2.0, None, 0.125), ("p", "travel", 450.0, 900.0, 3.0, 5.0, 0.125)], "person_id string, location_type string, start_s double, end_s double, concentration double, travel_exposure double, duration_hours double")
    got = exposure.curves(rows).orderBy("bin_index").collect()
    assert len(got) == 288 and got[-1].cumulative == pytest.approx(2 * 0.125 + 5 * 0.125)


def test_sampled_factors_repeat_and_vary(spark):
    people = spark.range(2000).select(F.col("id").cast("string").alias("person_id"), F.lit(0.3).alias("p_outdoor"))
    a, b = (exposure.sampled_factors(people, seed=3).orderBy("person_id").collect() for _ in range(2))
    assert a == b
    assert sum(r.work_outdoor for r in a) / 2000 == pytest.approx(0.3, abs=0.04)
    assert sum(math.log(r.home_pen) for r in a) / 2000 == pytest.approx(math.log(0.385), abs=0.05)
