import json

import pytest
from pyspark.sql import functions as F

from airexposure.operators import holdout, randoms, spatial
from airexposure.sources import files


def test_clip_takes_the_inside_of_a_ring(spark):
    ring = spark.createDataFrame([("a", i, x, y) for i, (x, y) in enumerate([(0.0, 0.0), (4.0, 0.5), (4.0, 4.0), (2.0, 1.5), (0.0, 4.0)])], "ring string, pos int, lon double, lat double")
    points = spark.createDataFrame([(1, 1.0, 1.0), (2, 2.0, 3.0), (3, 3.5, 3.0), (4, 9.0, 1.0), (5, None, 1.0)], "id int, lon double, lat double")
    assert sorted(r.id for r in spatial.clip(points, spatial.edges(ring), 0.3).collect()) == [1, 3]


def test_city_words(spark):
    rows = spark.createDataFrame([("salt-lake-city-ut",), ("new-york-newark",), ("boston-ma",)], "s string").select(spatial.city_key(F.col("s")), spatial.city_folder(F.col("s"))).collect()
    assert [tuple(r) for r in rows] == [("salt_lake_city", "SaltLakeCity"), ("new_york", "NewYork"), ("boston", "Boston")]


def test_sensors_and_rings_from_geojson(spark, tmp_path):
    square = [[0, 0], [1, 0], [1, 1], [0, 0]]
    features = [
        {"type": "Feature", "geometry": {"type": "Point", "coordinates": [-71.5, 42.5]}, "properties": {"sensor_index": 7, "name": "x"}},
        {"type": "Feature", "geometry": {"type": "MultiPolygon", "coordinates": [[square], [square]]}, "properties": {}},
    ]
    (tmp_path / "boston-ma.geojson").write_text(json.dumps({"type": "FeatureCollection", "features": features}))
    row = files.sensors_geojson(spark, str(tmp_path)).collect()
    assert [tuple(r) for r in row] == [(7, 42.5, -71.5, "x", "boston-ma")]
    # rings are read from files of polygons; a point among them is an error
    with pytest.raises(Exception, match="no polygon"):
        files.polygon_vertices(spark, str(tmp_path)).collect()
    (tmp_path / "rings").mkdir()
    (tmp_path / "rings" / "x.geojson").write_text(json.dumps({"type": "FeatureCollection", "features": features[1:]}))
    rings = files.polygon_vertices(spark, str(tmp_path / "rings"))
    assert rings.groupBy("ring").count().count() == 2 and {r.msa_slug for r in rings.collect()} == {"x"}


def test_errors_and_shapes(spark):
    pairs = spark.createDataFrame([(1, 1.0, 2.0), (1, 3.0, 4.0), (2, 5.0, 5.0)], "s int, o double, p double")
    got = {r.s: r for r in holdout.errors(pairs, "o", "p", "s").collect()}
    assert (got[1].rmse, got[1].mae, got[1].r2, got[1].shape_rmse) == pytest.approx((1.0, 1.0, 0.0, 0.0))
    assert got[2].r2 is None
    z = spark.createDataFrame([(0, b, 700.0 + b) for b in range(4)], "k int, bin int, z double")
    assert holdout.log_shape(z, "k").agg(F.avg(F.exp("log_s"))).head()[0] == pytest.approx(1.0)


def test_sampling_repeats_and_keeps_one(spark):
    rows = spark.range(100)
    assert randoms.sample(rows, 5, "id", forced=F.col("id") == 42).collect() == randoms.sample(rows, 5, "id", forced=F.col("id") == 42).collect()
    assert 42 in [r.id for r in randoms.sample(rows, 5, "id", forced=F.col("id") == 42).collect()]
    assert randoms.thinned(rows, 0.0, "id").count() == 1
