"""The file of all persons' time series is as small as its columns allow."""

from pathlib import Path

import pytest
from pyarrow.parquet import ParquetFile

from airexposure.plans import filesets
from airexposure.sources import files


def test_series_are_packed_by_zstd(spark, tmp_path):
    files.timeseries_parquet(spark.range(1000).selectExpr("id person_id", "1 bin_index"), str(tmp_path / "series"))
    made = [ParquetFile(f).metadata for f in Path(tmp_path / "series").glob("*.parquet")]
    assert sum(m.num_rows for m in made) == 1000 and {m.row_group(0).column(0).compression for m in made if m.num_row_groups} == {"ZSTD"}


def test_the_file_has_the_columns_of_the_result(spark, monkeypatch):
    """Differences of the bands from the middle home value are neither in the reference's file nor in the result."""
    seen = []

    def stop(series, path, ordered=False):
        seen.extend(series.columns)
        raise InterruptedError

    monkeypatch.setattr(filesets.files, "timeseries_parquet", stop)
    with pytest.raises(InterruptedError):
        filesets.file_timeseries(spark, "/root/testdata/sf0.001")
    middle = [f"{w}_{k}" for w in ("activity", "home", "delta") for k in ("cumulative", "increment")]
    assert sorted(seen) == sorted(["person_id", "bin_index", "industry", *middle, *[f"activity_{k}_{s}" for k in ("cumulative", "increment") for s in ("low", "high")]])
