"""Readers, sinks, and the operators beyond the registered queries, on hand-made tables."""

import json
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from airexposure.operators import activity, cohorts, diagnostics, distribution, exposure, field, holdout, staypoints, workoutdoor
from airexposure.sources import files


def test_percentiles_of_large_and_tied_groups(spark):
    rng = random.Random(1)
    rows = [("a", rng.gauss(0, 1)) for _ in range(3000)] + [("b", float(rng.randint(0, 3))) for _ in range(500)] + [("c", 7.0), (None, 1.0), (None, 2.0), ("a", float("nan")), ("a", float("inf")), ("d", None)]
    got = {r.g: r for r in distribution.percentiles(spark.createDataFrame(rows, "g string, v double"), ["g"], "v", {"lo": 0.05, "mid": 0.5, "hi": 0.975}).collect()}
    assert set(got) == {"a", "b", "c", None}
    for g in got:
        x = [v for k, v in rows if k == g and v is not None and math.isfinite(v)]
        assert [got[g].lo, got[g].mid, got[g].hi] == pytest.approx(list(np.quantile(x, [0.05, 0.5, 0.975])))
    stats = {r.g: r for r in distribution.describe(spark.createDataFrame(rows[:-1], "g string, v double").filter("g is not null"), ["g"], "v").collect()}
    assert stats["c"].std == 0.0 and stats["a"].n == 3000


def test_nearest_beyond_the_box_and_in_gaps(spark):
    rng = random.Random(2)
    cells = [(round(rng.uniform(0, 8), 3), round(rng.uniform(0, 8), 3), s, rng.random()) for s in (0, 30) for _ in range(60)]
    points = [(rng.uniform(-9, 17), rng.uniform(-9, 17), rng.choice([0, 30]), k) for k in range(150)] + [(None, 1.0, 0, 150), (1.0, 1.0, 60, 151)]
    rows = spark.createDataFrame(points, "lon double, lat double, slot int, k int")
    for cell in (0.3, 1.0, 40.0):
        got = field.nearest(rows, spark.createDataFrame(cells, "lon double, lat double, slot int, v double"), ["v"], cell).collect()
        assert len(got) == len(points)
        for r in got:
            here = [(math.hypot(r.lon - c[0], r.lat - c[1]), c[3]) for c in cells if c[2] == r.slot] if r.lon is not None else []
            assert (r.distance, r.v) == ((pytest.approx(min(here)[0]), min(here)[1]) if here else (None, None))


def test_static_field_where_the_dynamic_one_has_nothing(spark):
    rows = spark.createDataFrame([(0.1, 0.1, 0.0), (0.1, 0.1, 3600.0)], "lon double, lat double, start_s double")
    moving = spark.createDataFrame([(0.0, 0.0, 0, 3.0)], "lon double, lat double, slot int, mid double")
    raster = spark.createDataFrame([(0.0, 0.0, 5.0), (0.1, 0.1, 0.0), (0.1, 0.1, float("nan"))], "lon double, lat double, value double")
    got = field.lookup(rows, moving, [0, 60], ["mid"], 0.5, field.static_field(raster)).orderBy("start_s").collect()
    assert [(r.slot, r.mid) for r in got] == [(0, 3.0), (60, 5.0)]


def test_metrics(spark):
    assert [exposure.metric_name(x) for x in (" cumulative ", "TWAC", "", None, "x")] == ["cumulative", "twac", "cumulative", "cumulative", "cumulative"]
    assert exposure.home_fallback(10.0) == 240.0 and exposure.home_fallback(10.0, "twac") == 10.0
    total = spark.createDataFrame([("a", 48.0, 24.0), ("b", 5.0, 0.0)], "person_id string, total_exposure double, duration_hours double")
    assert [r.total_exposure for r in exposure.activity_metric(total, "twac").orderBy("person_id").collect()] == [2.0, 0.0]
    assert exposure.metric_units("twac") == "ug/m3"


def test_travel_bands_take_the_middle_values_neighbours(spark):
    rows = spark.createDataFrame([("p", 1, 0, 0, "origin", 2.0, 1.0, 1.0), ("p", 2, 0, 0, "travel", 9.0, 8.0, 1.0), ("p", 3, 0, 0, "origin", 4.0, 3.0, 1.0)], "person_id string, seq int, piece int, half int, location_type string, concentration double, concentration_low double, duration_hours double")
    out = exposure.with_exposure(rows, "origin_destination_mean", suffix="_low").filter("location_type = 'travel'").head()
    assert out.travel_exposure_low == 3.0


def test_missing_travel_values_fall_back(spark):
    rows = spark.createDataFrame([("p", "travel", None, 0.5), ("p", "origin", None, 1.0)], "person_id string, location_type string, concentration double, duration_hours double")
    assert exposure.totals(exposure.with_exposure(rows, "hardcoded", constant=4.0)).head().total_exposure == 2.0
    assert exposure.compare(spark.createDataFrame([("p", 10.0)], "person_id string, total_exposure double"), spark.createDataFrame([], "person_id string, home double"), 240.0).head().home == 240.0


def test_raw_trips_to_usable_ones(spark):
    raw = spark.createDataFrame(
        [("a", "8:00:00", "8:30:00", "1", "1", "2", "2", "1", "1", "30"), ("a", "99:00:00", "9:30:00", "1", "1", "2", "2", "1", "1", "n/a"), ("b", "8:00:00", "8:30:00", "1", "1", "Out of Region", "2", "1", "1", "30"), ("c", "8:00:00", "8:30:00", "1", "1", "500", "2", "1", "1", "30"), ("d", "x", "8:30:00", "1", "1", "2", "2", "1", "1", "30")],
        "person_id string, start_time string, end_time string, orig_lon string, orig_lat string, dest_lon string, dest_lat string, home_lon string, home_lat string, declared_minutes string",
    ).withColumns({"purpose": F.lit("work"), "mode": F.lit("walking")})
    clean = activity.cleaned(raw)
    assert [(r.person_id, r.start_s, r.declared_minutes) for r in activity.usable(clean).collect()] == [("a", 28800, 30.0)]
    counts = {r.reason: r.persons for r in activity.audit_counts(clean, (-180.0, 180.0, -90.0, 90.0)).collect()}
    assert counts == {"kept": 1, "nan_coords_or_non_numeric": 1, "outside_bbox": 1, "no_readable_times": 1}
    audit = activity.bbox_audit(clean, ["orig", "dest"], (0, 9, 0, 9), "start_s").filter("person_id = 'c'").head()
    assert audit.dest_outside and not audit.orig_outside and audit.first_dest_lon == 500.0 and audit.status == "kicked_out"
    people = spark.createDataFrame([("a", 3.0, "x"), ("a", 5.0, None)], "person_id string, age double, industry string")
    assert tuple(activity.person_attributes(people).head()) == ("a", 5.0, "x")
    assert activity.preview(activity.distinct_persons(raw), 2, "person_id").count() == 2


def test_outdoor_work_end_to_end(spark, tmp_path):
    (tmp_path / "onet.csv").write_text("﻿O*NET-SOC Code,Element Name,Scale ID,Category,Data Value,Other\n11-1011.00,a,CXP,4,40\n11-1011.00,a,CXP,5,30\n11-1011.00,b,CXP,5,40\n13-1011.00,a,CXP,4,10\n13-1011.00,b,CXP,4,20\nnot-a-soc,a,CXP,4,1\n", encoding="utf-8")
    (tmp_path / "oews.csv").write_text('﻿NAICS,OCC_CODE,O_GROUP,TOT_EMP\n110000,11-1011,detailed,100\n110000,13-1011,detailed,"300"\n110000,15-1011,detailed,**\n', encoding="utf-8")
    (tmp_path / "naics.csv").write_text("Sector,Name\n11,Farming\n31-33,Manufacturing\n")
    people = spark.createDataFrame([("p1", "naics11_farm"), ("p2", "not_working"), ("p3", None)], "person_id string, industry string")
    persons, sectors, missing = workoutdoor.work_outdoor(people, files.onet_csv(spark, str(tmp_path / "onet.csv")), files.oews_csv(spark, str(tmp_path / "oews.csv")), ["a", "b"])
    assert sectors.head().p_outdoor == pytest.approx(0.415)
    labels = files.sector_labels(spark, str(tmp_path / "naics.csv"), "Sector", "Name")
    got = {r.person_id: r for r in workoutdoor.with_label(persons, labels).collect()}
    assert got["p1"].p_outdoor == pytest.approx(0.415) and got["p1"].label == "Farming" and (got["p2"].reason, got["p3"].reason) == ("not_working", "missing")
    counts = {(r.step, r.metric): r.value for r in missing.collect()}
    assert counts[("onet", "bad_soc")] == 1 and counts[("oews", "no_employment")] == 1 and counts[("match", "matched")] == 2 and counts[("assign", "ok")] == 1
    assert {r.grp for r in labels.collect()} == {"11", "31_33"}
    mean = workoutdoor.soc_shares(files.onet_csv(spark, str(tmp_path / "onet.csv")), ["a", "b"], combine="mean")
    assert {r.soc: round(r.share, 9) for r in mean.collect()} == {"11-1011": 0.55, "13-1011": 0.15}


def test_outdoor_work_on_stays(spark):
    stays = spark.createDataFrame([("p", "work_indoor"), ("p", "home_indoor"), ("q", "work_indoor")], "person_id string, microenv string")
    got = {(r.person_id, r.microenv): r.p_outdoor_work for r in staypoints.with_outdoor_work(stays, spark.createDataFrame([("p", 0.3)], "person_id string, p_outdoor double")).collect()}
    assert got == {("p", "work_indoor"): 0.3, ("p", "home_indoor"): None, ("q", "work_indoor"): None}


def test_field_slots_are_utc_whatever_the_session(spark, tmp_path):
    (tmp_path / "f.csv").write_text("longitude,latitude,timestamp,pm25_q050,pm25_q005\n1,2,2024-01-01 12:00:00,5,4\n1,2,2024-01-01T13:30:00Z,6,5\n1,2,2024-01-01 12:00:00-05:00,7,6\n1,2,bad,6,5\n,2,2024-01-01 12:00:00,5,4\n")
    before = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    try:
        got = files.field_csv(spark, str(tmp_path / "f.csv"), "pm25_q050", "pm25_q005").orderBy("mid").collect()
    finally:
        spark.conf.set("spark.sql.session.timeZone", before)
    assert [(r.slot, r.mid, r.low) for r in got] == [(720, 5.0, 4.0), (810, 6.0, 5.0), (1020, 7.0, 6.0)]
    (tmp_path / "g.csv").write_text("lon,lat,pm25\n1,2,3\n")
    with pytest.raises(ValueError):
        files.field_csv(spark, str(tmp_path / "g.csv"))


def test_readers(spark, tmp_path):
    (tmp_path / "t.csv").write_text('trip_taker_person_id,x\n007,"a,b"\n')
    assert files.trips_csv(spark, str(tmp_path / "t.csv")).head().person_id == "007"
    (tmp_path / "u.csv").write_text("x\n1\n")
    with pytest.raises(ValueError):
        files.trips_csv(spark, str(tmp_path / "u.csv"))
    for folder, name, row in (("boston-ma_may", "cleaned_1.csv", 1), ("boston-ma_may", "cleaned_2.csv", 2), ("new_york_may", "cleaned_1.csv", 3)):
        (tmp_path / "r" / folder).mkdir(parents=True, exist_ok=True)
        (tmp_path / "r" / folder / name).write_text(f"sensor_index,time_stamp\n{row},0\n")
    rows = files.cleaned_readings(spark, str(tmp_path / "r"), latest=True)
    assert {(r.msa_slug, r.month, r.sensor_index) for r in rows.collect()} == {("boston-ma", "may", "2"), ("new_york", "may", "3")}
    assert "time_stamp" not in files.utc_from_epoch(rows).columns
    (tmp_path / "h.txt").write_text("5\n\n 12 \n")
    assert sorted(r[0] for r in files.holdout_list(spark, str(tmp_path / "h.txt")).collect()) == [5, 12]
    surface = spark.createDataFrame([("mean", 1.0), ("3", 2.0)], "k string, pm25_p05 double")
    assert files.surface_quantiles(surface, "3").head().pm25_p05 == 2.0 and files.surface_quantiles(surface.drop("k")).count() == 2
    assert spark.range(1).select(files.date_in_name(F.lit("grid_20230517_x.nc"))).head()[0].isoformat() == "2023-05-17"
    (tmp_path / "d.json").write_text(json.dumps({"rhat": {"tau": [1.01, 1.2], "b": [1.0]}, "n_draws": 50}))
    assert {(r.param, r.max_rhat, r.draws) for r in files.chain_diagnostics(spark, str(tmp_path / "d.json")).collect()} == {("tau", 1.2, 50), ("b", 1.0, 50)}
    (tmp_path / "line.geojson").write_text(json.dumps({"type": "Feature", "geometry": {"type": "LineString", "coordinates": [[0, 0], [1, 1]]}, "properties": {}}))
    with pytest.raises(Exception, match="no polygon"):
        files.polygon_vertices(spark, str(tmp_path / "line.geojson")).collect()
    with pytest.raises(ValueError):
        files.sensors_geojson(spark, str(tmp_path / "line.geojson"))


def test_sinks_read_back(spark, tmp_path):
    p = str(tmp_path)
    detail = spark.createDataFrame([("a", 5, 1.0), ("a", 1, 2.0), ("b", 0, 3.0)], "person_id string, start_s int, exposure double")
    files.exposure_parquet(detail, detail.groupBy("person_id").agg(F.sum("exposure").alias("total")), f"{p}/run")
    detail.withColumn("extra", F.lit(1)).write.parquet(f"{p}/more")
    both = files.parquet_set(spark, f"{p}/run/detailed", f"{p}/more").collect()
    assert [(r.person_id, r.start_s) for r in both] == [("a", 1), ("a", 1), ("a", 5), ("a", 5), ("b", 0), ("b", 0)] and {r.extra for r in both} == {None, 1}
    files.timeseries_parquet(detail.withColumnRenamed("start_s", "bin_index"), f"{p}/series")
    assert spark.read.parquet(f"{p}/series").count() == 3
    files.save_csv(detail, f"{p}/csv")
    assert spark.read.option("header", True).csv(f"{p}/csv").count() == 3
    point = files.point_feature(F.lit(1.5), F.lit(2.5), F.struct(F.col("person_id").alias("name")))
    files.feature_collection(detail.select(point.alias("value")), f"{p}/geo")
    whole = json.loads("".join(f.read_text() for f in sorted((tmp_path / "geo").glob("part-*"))))
    assert whole["type"] == "FeatureCollection" and len(whole["features"]) == 3 and whole["features"][0]["geometry"]["coordinates"] == [1.5, 2.5]
    stats = spark.createDataFrame([("c", g, m, 2, 1.0, 1.0, 0.0, 1.0, 1.0, 1.0, 1.0) for g in "xy" for m in ("activity", "home")], "cohort string, grp string, metric string, n long, mean double, median double, std double, min double, max double, p25 double, p75 double")
    files.save_json(cohorts.statistics_json(stats, "activity", "home"), f"{p}/stats")
    assert {r.activity.mean for r in spark.read.json(f"{p}/stats").collect()} == {1.0}
    flat = cohorts.wide(stats, ["activity", "home"])
    assert "activity.mean" in flat.columns and flat.count() == 2


def test_time_series_and_payload(spark):
    rows = spark.createDataFrame([("p", "origin", 0.0, 43200.0, 2.0, None, 12.0), ("q", "origin", 0.0, 86400.0, 1.0, None, 24.0)], "person_id string, location_type string, start_s double, end_s double, concentration double, travel_exposure double, duration_hours double")
    curve = exposure.curves(rows)
    home = exposure.home_line(spark.createDataFrame([("p", 24.0)], "person_id string, home double"))
    series = exposure.timeseries(curve, home, attributes=spark.createDataFrame([("p", "x")], "person_id string, industry string"))
    assert series.count() == 576
    end = {r.person_id: r for r in series.filter("bin_index = 287").collect()}
    assert (end["p"].activity_cumulative, end["p"].home_cumulative, end["p"].delta_cumulative, end["p"].industry) == (pytest.approx(24), pytest.approx(24), pytest.approx(0, abs=1e-9), "x")
    assert exposure.timeseries(curve, home, "twac").filter("person_id = 'q' and bin_index = 100").head().activity_cumulative == pytest.approx(1.0)
    back = exposure.increments(curve).join(curve.select("person_id", "bin_index", F.col("increment").alias("i")), ["person_id", "bin_index"])
    assert back.filter("abs(increment - i) > 1e-9").count() == 0
    groups = spark.createDataFrame([("p", "all", "all"), ("q", "all", "all")], "person_id string, cohort string, grp string")
    view = exposure.payload(series, groups, spark.createDataFrame([("q",)], "person_id string")).head()
    assert len(view.time_points) == len(view.mean_activity_cumulative) == 289 and view.mean_activity_cumulative[0] == 0 and view.mean_activity_cumulative[-1] == pytest.approx(24)
    assert view.metadata.persons == 2 and [c.person_id for c in view.sample_curves] == ["q"] and len(view.sample_curves[0].activity) == 288


def test_cohorts(spark):
    people = spark.createDataFrame([("a", 5), ("b", None)], "person_id string, age int")
    members = cohorts.with_everyone(cohorts.membership(people, cohorts.from_groups({"old": "age > 3", "": "true"})), people)
    assert {tuple(r) for r in members.collect()} == {("a", "custom_groups", "old"), ("a", "all", "all"), ("b", "all", "all")}
    assert [r[0] for r in cohorts.ids_of(members, "all", "all").collect()] == ["a", "b"]
    assert cohorts.of_persons(people, cohorts.ids_of(members, "custom_groups", "old")).count() == 1


def test_correlation_p_values():
    # t = r sqrt((n - 2) / (1 - r^2)); two degrees of freedom have the closed form 1 - t / sqrt(t^2 + 2)
    for r in (0.0, 0.3, -0.9):
        t = abs(r) * math.sqrt(2 / (1 - r * r))
        assert diagnostics.correlation_p_value(r, 4) == pytest.approx(1 - t / math.sqrt(t * t + 2))
    assert diagnostics.correlation_p_value(0.5, 30) == pytest.approx(0.00489, abs=2e-4)


def test_rhat_by_index(spark):
    draws = spark.createDataFrame([("tau", e, c, d, float(d % 5 + c * e)) for e in range(2) for c in range(2) for d in range(20)], "param string, element int, chain int, draw int, value double")
    got = diagnostics.rhat_by_index(draws, "tau").collect()
    assert [r.element for r in got] == [0, 1] and got[1].rhat > got[0].rhat


def test_held_out_predictions(spark):
    sites = [(k, 0.3 * k, 0.2 * (k % 3)) for k in range(7)]
    schema = "sensor_index int, lon double, lat double"
    train, held = spark.createDataFrame(sites[:5], schema), spark.createDataFrame(sites[5:], schema)
    centres = [(0.0, 0.0), (0.6, 0.2), (1.2, 0.0)]
    q = {(r.sensor_index, r.centre): r.q for r in holdout.orthonormal_basis(train, held, centres, 0.5).collect()}
    phi = np.array([[math.exp(-0.5 * ((x - a) ** 2 + (y - b) ** 2) / 0.25) for a, b in centres] for _, x, y in sites])
    r = np.linalg.qr(phi[:5])[1]
    want = phi @ np.linalg.inv(r) * np.sign(np.diag(r))
    assert np.array([[q[s, c] for c in range(3)] for s in range(7)]) == pytest.approx(want, abs=1e-8)
    temporal = holdout.circular_basis(4, 2, 1.0)
    w = {(d, c, j): 0.1 * (d + c - j) for d in range(2) for c in range(3) for j in range(2)}
    spatial = spark.createDataFrame([(s, c, float(v)) for (s, c), v in q.items()], "sensor_index int, centre int, q double")
    weights = spark.createDataFrame([(*k, v) for k, v in w.items()], "draw int, centre int, term int, w double")
    terms = spark.createDataFrame([(j, b, temporal[b][j]) for b in range(4) for j in range(2)], "term int, bin int, t double")
    mean = spark.createDataFrame([(d, b, 0.05 * b) for d in range(2) for b in range(4)], "draw int, bin int, mu double")
    got = {(x.sensor_index, x.draw, x.bin): x.log_s for x in holdout.predicted_shape(weights, spatial, terms, mean, train).collect()}
    for d in range(2):
        a = np.array([[sum(w[d, c, j] * q[s, c] for c in range(3)) for j in range(2)] for s in range(7)])
        z = a @ np.array(temporal).T
        z = z - z[:5].mean(0) + 0.05 * np.arange(4)
        log_s = z - np.log(np.exp(z).mean(1, keepdims=True))
        assert np.array([[got[s, d, b] for b in range(4)] for s in range(7)]) == pytest.approx(log_s)


def test_baselines_and_metric_tables(spark):
    grid = spark.createDataFrame([(1, 5.0)], "sensor_index int, grid double")
    near = spark.createDataFrame([(1, 9)], "sensor_index int, near int")
    levels = spark.createDataFrame([(9, 0, 7.0), (9, 1, 1.0)], "near int, draw long, level double")
    there = spark.createDataFrame([(9, 6.5)], "near int, grid_near double")
    basis = spark.createDataFrame([(1, 0, -9.0)], "sensor_index int, draw long, delta double")
    of = lambda mode: sorted(r.base for r in holdout.baseline(mode, grid, near, levels, there, basis).collect())
    assert [of(m) for m in holdout.BASELINES] == [[5.0], [1.0, 7.0], [1e-12, 5.5], [1e-12]]
    pairs = spark.createDataFrame([(s, float(b), float(b) + s, float(b) + 2 * s) for s in (1, 2) for b in range(3)], "sensor_index int, o double, p double, q double")
    each, whole = holdout.metric_tables(pairs, "p", "q", "o")
    assert {r.sensor_index: (r.rmse, r.rmse_no_bias) for r in each.collect()} == {1: (1.0, 2.0), 2: (2.0, 4.0)} and whole.head().mean_rmse == 1.5
    train, held = holdout.split(pairs, spark.createDataFrame([(2,)], "sensor_index int"))
    assert train.count() == held.count() == 3
    assert holdout.parameter_grid(low=1, high=4) == [1, 2, 3, 4] and holdout.parameter_grid(low=1.0, high=16.0, steps=3, geometric=True) == pytest.approx([1, 4, 16])
    assert holdout.within(pairs, "sensor_index", 2, 5).count() == 3
    days = spark.createDataFrame([(1, "d", 2.0), (1, "d", 4.0), (2, "d", 0.0)], "sensor_index int, day string, pm double")
    assert [r["shape"] for r in holdout.day_normalised(days).orderBy("sensor_index", "pm").collect()] == [pytest.approx(2 / 3), pytest.approx(4 / 3), None]
