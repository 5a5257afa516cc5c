"""Cells parsed once for rows that are alike, factors looked up once a stay."""

import pytest

from airexposure.operators import staging, workoutdoor
from airexposure.plans import catalog


def test_cells_of_occupations_are_parsed_once_for_rows_that_are_alike(spark, monkeypatch):
    written = []
    monkeypatch.setattr(workoutdoor, "staged", lambda df, name: written.append(staging.staged(df, name)) or written[-1])
    rows = [("230000", "11-1000", "1,000", "detailed")] * 3 + [("230000", "11-1000.00", "5", "detailed"), ("230000", "11-1001", "5", "detailed"), ("230000", "11-1001", "**", "detailed"), ("230000", "11-1001", "7", "major")]
    out = workoutdoor.sector_weights(spark.createDataFrame(rows, "naics string, soc string, tot_emp string, o_group string"))
    assert {(r.sector, r.soc): (r.employment, r.total) for r in out.collect()} == {("23", "11-1000"): (3005.0, 3010.0), ("23", "11-1001"): (5.0, pytest.approx(3010.0))}
    assert [df.count() for df in written] == [4]


def test_factors_are_looked_up_by_stay_not_by_piece(spark):
    lines = catalog.detailed(spark, "/root/testdata/sf0.001", "mid-point-teleportation")._jdf.queryExecution().optimizedPlan().toString().splitlines()
    cut = min(k for k, x in enumerate(lines) if "Generate explode(sequence" in x)
    assert cut < min(k for k, x in enumerate(lines) if "Join LeftOuter" in x and "(person_id#" in x)
