"""The lookup that neither writes nor moves rows."""

import random

import pytest
from pyspark.sql import functions as F

from airexposure.operators import field, staging


def test_complete_lists_answer_every_place_of_the_extent(spark, monkeypatch):
    rng = random.Random(5)
    cells = [(round(rng.uniform(0, 4), 1), round(rng.uniform(0, 4), 1), s, rng.random()) for s in (0, 30) for _ in range(90)]
    points = [(rng.uniform(-1, 5), rng.uniform(-1, 5), rng.choice([0, 30]), k) for k in range(300)] + [(float(round(rng.uniform(0, 4))), 2.0, 0, 300 + k) for k in range(20)] + [(None, 1.0, 0, 400), (1.0, 1.0, 60, 401)]
    rows = spark.createDataFrame(points, "lon double, lat double, slot int, k int")
    of = spark.createDataFrame(cells, "lon double, lat double, slot int, v double")
    want = sorted((r.k, r.v) for r in field.nearest(rows, of, ["v"], 0.5).collect())
    for longest in (field.LONGEST, 0):  # lists, and where they would be too long the other way
        monkeypatch.setattr(field, "LONGEST", longest)
        got = field.nearest_within(rows, of, ["v"], 0.5, (-1.0, 5.0, -1.0, 5.0), prefix="at_")
        assert got.columns == [*rows.columns, "at_v"] and sorted((r.k, r.at_v) for r in got.collect()) == want


def test_a_place_outside_the_extent_is_an_error(spark):
    rows, of = spark.createDataFrame([(0.0, 0.0, 0), (3.0, 0.0, 0)], "lon double, lat double, slot int"), spark.createDataFrame([(0.0, 0.0, 0, 1.0)], "lon double, lat double, slot int, v double")
    with pytest.raises(Exception, match="outside the extent"):
        field.nearest_within(rows, of, ["v"], 1.0, (0.0, 1.0, 0.0, 1.0)).collect()


def test_rows_are_not_written_and_not_shuffled(spark, monkeypatch):
    rows = spark.range(1000).select(F.concat(F.lit("p"), F.col("id") % 9).alias("person_id"), ((F.col("id") % 7) / 7).alias("lon"), ((F.col("id") % 5) / 5).alias("lat"), F.lit(0.0).alias("start_s"))
    of = spark.createDataFrame([(x / 4, y / 4, 0, float(x * y)) for x in range(5) for y in range(5)], "lon double, lat double, slot int, v double")
    names = []
    monkeypatch.setattr(field, "staged", lambda df, name: names.append((name, df.columns)) or staging.staged(df, name))
    out = field.lookup(rows.repartition("person_id"), of, [0], ["v"], 0.25, extent=(0.0, 1.0, 0.0, 1.0)).groupBy("person_id").agg(F.sum("v"))
    assert names and not any("person_id" in columns for _, columns in names)
    assert out._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning(person_id") == 1
