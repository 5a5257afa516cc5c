"""Statistics of rows that count for several groups, and predicted shapes, without copies of rows for each."""

from airexposure.operators import distribution, holdout


def test_rows_with_a_list_of_groups_are_staged_once(spark, monkeypatch):
    rows = spark.createDataFrame([(float(x), ["a", "b"] if x % 2 else ["a"], x % 3) for x in range(60)], "v double, g array<string>, b int")
    rows = rows.selectExpr("v", "b", "transform(g, x -> named_struct('grp', x)) AS groups")
    seen, stage = {}, distribution.staged
    monkeypatch.setattr(distribution, "staged", lambda df, name: seen.setdefault(name, stage(df, name)) if name == "values" else stage(df, name))
    got = distribution.medians(rows, ["grp", "b"], ["v"], each="groups").collect()
    assert seen["values"].count() == 60 and "groups" in seen["values"].columns
    assert {(r.grp, r.b): r.median_v for r in got} == {("a", b): 28.5 + b for b in range(3)} | {("b", b): sorted(x for x in range(60) if x % 2 and x % 3 == b)[4] / 2 + sorted(x for x in range(60) if x % 2 and x % 3 == b)[5] / 2 for b in range(3)}


def test_shapes_of_the_asked_sensors_equal_those_of_all(spark):
    weights = spark.createDataFrame([(d, c, t, 0.1 * d + c - t) for d in (1, 2) for c in (0, 1) for t in (0, 1)], "draw long, centre int, term int, w double")
    spatial = spark.createDataFrame([(s, c, s * 0.3 + c) for s in range(6) for c in (0, 1)], "sensor_index long, centre int, q double")
    waves = spark.createDataFrame([(b, t, b - t + 0.5) for b in range(3) for t in (0, 1)], "bin int, term int, t double")
    mean = spark.createDataFrame([(d, b, 0.2 * b * d) for d in (1, 2) for b in range(3)], "draw long, bin int, mu double")
    training = spatial.filter("sensor_index > 1")
    every = {tuple(r)[:3]: round(r.log_s, 9) for r in holdout.predicted_shape(weights, spatial, waves, mean, training).collect()}
    few = holdout.predicted_shape(weights, spatial, waves, mean, training, spatial.filter("sensor_index < 2"))
    assert {tuple(r)[:3]: round(r.log_s, 9) for r in few.collect()} == {k: v for k, v in every.items() if k[0] < 2}
    assert few._jdf.queryExecution().executedPlan().toString().count("SortMergeJoin") <= 2  # the choice of sensors only
