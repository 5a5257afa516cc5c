"""Hours at home follow from the trips; curves leave out persons whose day doesn't add up."""

from airexposure.operators import exposure
from airexposure.plans import extended


def test_no_stays_are_made_for_homes(spark, monkeypatch):
    def stop(*_):
        raise AssertionError("stays are made a second time")

    monkeypatch.setattr(extended.C, "stays", stop)
    assert extended.home_hours(spark, "/root/testdata/sf0.001").columns == ["person_id", "home"]


def test_curves_leave_out_homes_without_rows(spark):
    rows = spark.createDataFrame([("a", "origin", 0.0, 3600.0, 1.0, None)], "person_id string, location_type string, start_s double, end_s double, concentration double, travel_exposure double")
    home = spark.createDataFrame([("a", [1.0]), ("b", [2.0])], "person_id string, home array<double>")
    assert {r.person_id for r in exposure.curves(rows, home=home, slots=[0]).collect()} == {"a"}
