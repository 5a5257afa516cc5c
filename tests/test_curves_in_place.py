"""Curves of the day and of a day at home, made from each person's listed pieces."""

import pytest
from pyspark.sql import functions as F

from airexposure.operators import exposure

PIECE = "person_id string, location_type string, start_s double, end_s double, concentration double, travel_exposure double"


def test_curves_with_home_and_carried_columns_move_no_bins(spark):
    rows = spark.createDataFrame([("a", "origin", 0.0, 450.0, 12.0, None), ("a", "travel", 450.0, 600.0, 1.0, 24.0), ("b", "origin", 86_100.0, 86_399.0, 36.0, None), ("b", "origin", None, 10.0, 1.0, None)], PIECE)
    home = spark.createDataFrame([("a", [1.0, 3.0])], "person_id string, home array<double>")
    out = exposure.curves(rows, home=home, slots=[0, 720], carried=spark.createDataFrame([("b", "mfg")], "person_id string, industry string"))
    assert "bin_index" not in " ".join(x for x in out._jdf.queryExecution().executedPlan().toString().splitlines() if "Exchange" in x)
    got = {(r.person_id, r.bin_index): r for r in out.collect()}
    assert len(got) == 2 * 288
    assert [got["a", k].increment for k in (0, 1, 2)] == pytest.approx([1.0, 0.5 + 1.0, 0.0]) and got["a", 287].cumulative == pytest.approx(2.5)
    assert got["b", 287].increment == pytest.approx(36 * 299 / 3600) and got["b", 286].cumulative == 0.0
    # noon's slot begins at its nearer half, the earlier one at the same distance: minute 360 is bin 72
    assert [got["a", k].home_increment * 12 for k in (72, 73)] == pytest.approx([1.0, 3.0]) and got["a", 287].home_cumulative == pytest.approx((73 + 215 * 3) / 12)
    assert (got["b", 5].home_cumulative, got["b", 5].industry, got["a", 5].industry) == (0.0, "mfg", None)
    series = exposure.timeseries(out)
    assert series.columns[-1] == "industry" and series.filter("person_id = 'a' and bin_index = 0").head().delta_increment == pytest.approx(1 - 1 / 12)
