"""Statistics of lists, counted in place, and windows, homes and factors taken from one pass over the rows."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from airexposure.operators import distribution, exposure, field, workoutdoor
from airexposure.plans import catalog


def test_lists_are_ranked_without_a_row_for_each_place(spark, monkeypatch):
    monkeypatch.setattr(distribution, "SMALL", 20)
    monkeypatch.setattr(distribution, "AT_ONCE", 64)
    rng = random.Random(5)
    draw = [lambda: rng.choice([-1, 1]) * 10.0 ** rng.randint(-12, 12), lambda: 1 + rng.randint(0, 40) * 2.0**-52, lambda: rng.choice([0.0, 0.0, 0.0, 5.0]), lambda: rng.randint(0, 9) * 5e-324, lambda: rng.choice([None, float("nan"), float("inf"), 2.0]), lambda: None]
    rows = [([d() for d in draw],) for _ in range(500)]
    quantiles = {"low": 0.025, "mid": 0.5, "high": 0.9}
    lists = spark.createDataFrame(rows, "a array<double>").repartition(3)
    out = distribution.summarise_lists(lists, ["a", "sum"], len(draw), quantiles, {"sum": "a"})
    got = {(r.column, r.bin_index): r for r in out.collect()}
    sums = [list(np.cumsum([math.nan if x is None else x for x in r])) for (r,) in rows]
    want = {(c, k): [x[k] for x in of if x[k] is not None and math.isfinite(x[k])] for c, of in (("a", [r for (r,) in rows]), ("sum", sums)) for k in range(len(draw))}
    assert set(got) == {key for key, x in want.items() if x}
    for key, r in got.items():
        assert [r[q] for q in quantiles] == pytest.approx(list(np.quantile(want[key], list(quantiles.values()))), rel=1e-9, abs=1e-300)
        assert (r.n, r.min, r.max) == (len(want[key]), min(want[key]), max(want[key])) and r["mean"] == pytest.approx(np.mean(want[key]), rel=1e-6, abs=1e-9)
    assert not distribution.summarise_lists(lists.limit(0), ["a"], len(draw), quantiles).count()


def test_windows_are_summed_from_rows_not_bins(spark):
    rows = spark.createDataFrame([("a", "origin", 0.0, 25_200.0, 3.0, None), ("a", "travel", 25_200.0, 25_500.0, 1.0, 12.0), ("b", "travel", 82_800.0, 90_000.0, 2.0, None), ("c", "origin", 43_200.0, 46_800.0, None, None)],
                                 "person_id string, location_type string, start_s double, end_s double, concentration double, travel_exposure double")
    got = {r.person_id: (r.night, r.morning) for r in exposure.in_windows(rows, {"night": (0, 6), "morning": (6, 9)}).collect()}
    assert got == {"a": (18.0, pytest.approx(3.0 + 1.0)), "b": (0.0, 0.0), "c": (0.0, 0.0)}
    assert exposure.in_windows(rows, {"late": (19, 24)}).filter("person_id = 'b'").head().late == 2.0


def test_only_rows_that_ask_look_up_their_lists(spark):
    points = spark.createDataFrame([(s, x / 10, y / 10, float(s + 10 * x + y)) for s in (0, 30) for x in range(4) for y in range(4)], "slot int, lon double, lat double, mid double")
    rng = random.Random(2)
    rows = spark.createDataFrame([(k, rng.choice([0, 30]), rng.uniform(0, 0.3), None if k % 9 == 0 else rng.uniform(0, 0.3)) for k in range(200)], "k int, slot int, lon double, lat double")
    box, asks = (0.0, 0.3, 0.0, 0.3), F.col("k") % 3 == 0
    every = {r.k: r.mid for r in field.nearest_within(rows, points, ["mid"], 0.1, box).collect()}
    some = {r.k: r.h_mid for r in field.nearest_within(rows, points, ["mid"], 0.1, box, prefix="h_", only=asks).collect()}
    assert some == {k: v if k % 3 == 0 else None for k, v in every.items()} and any(some.values())


def test_persons_and_two_lookups_make_code_that_is_compiled(spark):
    """A method of more than 8000 bytes is interpreted row by row."""
    persons = spark.range(50).select(F.col("id").cast("string").alias("person_id"), F.expr("CASE id % 3 WHEN 0 THEN 'NAICS31_33_mfg' WHEN 1 THEN concat('naics23', cast(id % 9 AS string)) END").alias("industry"))
    sectors = spark.createDataFrame([("31", 0.2, 10.0), ("32", 0.4, 30.0), ("23", 0.5, 1.0)], "sector string, p_outdoor double, total double")
    out = workoutdoor.assign(persons, sectors)
    assert [r.p_outdoor for r in out.orderBy(F.col("person_id").cast("int")).head(3)] == [pytest.approx(0.35), 0.5, None]
    for df in (out, catalog.QUERIES["travel_mode_f"](spark, "/root/testdata/sf0.001")):
        spark.conf.set("spark.sql.adaptive.enabled", "false")
        try:
            parts = df.select("*")._jdf.queryExecution().debug().codegenToSeq()
        finally:
            spark.conf.unset("spark.sql.adaptive.enabled")
        assert max(parts.apply(k)._3().maxMethodCodeSize() for k in range(parts.size())) <= 8000


def test_the_days_of_a_comparison_are_staged_by_person(spark, monkeypatch):
    written = []
    monkeypatch.setattr(catalog, "staged", lambda df, name: written.append((name, df.columns)) or df)
    out = catalog.compared(spark, "/root/testdata/sf0.001")
    assert [n for n, _ in written] == ["days"] and "seq" not in written[0][1]
    want = exposure.compare(exposure.totals(catalog.detailed(spark, "/root/testdata/sf0.001")), catalog.home_day(spark, "/root/testdata/sf0.001"), catalog.FALLBACK)
    a, b = ({r.person_id: (r.activity, r.home, r.delta, r.ratio) for r in df.collect()} for df in (out, want))
    assert a.keys() == b.keys() and all(a[k] == pytest.approx(b[k], rel=1e-12, abs=1e-9) for k in a)
