"""Exact statistics from one staged evaluation, and random choices that other engines repeat."""

import hashlib
import math
import random

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from airexposure.operators import distribution, exposure, randoms, spatial


def check(spark, rows, groups, values, quantiles):
    schema = ", ".join([*[f"{g} string" for g in groups], *[f"{v} double" for v in values]])
    got = {(*[r[g] for g in groups], r["column"]): r for r in distribution.summarise(spark.createDataFrame(rows, schema), groups, values, quantiles).collect()}
    want = {}
    for r in rows:
        for v, x in zip(values, r[len(groups) :]):
            if x is not None and math.isfinite(x):
                want.setdefault((*r[: len(groups)], v), []).append(x)
    assert set(got) == set(want)
    for key, x in want.items():
        assert [got[key][q] for q in quantiles] == pytest.approx(list(np.quantile(x, list(quantiles.values()))), rel=1e-12, abs=1e-300)
        assert (got[key].n, got[key].min, got[key].max) == (len(x), min(x), max(x)) and (not abs(got[key].mean) < 1e300 or got[key].mean == pytest.approx(np.mean(x), rel=1e-9))


def test_brackets_narrow_down_to_the_ranks(spark, monkeypatch):
    monkeypatch.setattr(distribution, "SMALL", 20)
    monkeypatch.setattr(distribution, "CELLS", 256)
    rng = random.Random(3)
    rows = [("wide", rng.choice([-1, 1]) * 10.0 ** rng.randint(-12, 12), rng.gauss(0, 1)) for _ in range(300)]
    rows += [("narrow", 1 + rng.randint(0, 40) * 2.0**-52, rng.choice([0.0, 0.0, 0.0, 5.0])) for _ in range(300)]
    rows += [("tiny", rng.randint(0, 9) * 5e-324, None) for _ in range(60)] + [("huge", rng.choice([-1.7e308, 0.0, 1.7e308]), None) for _ in range(60)]
    rows += [(None, 1.0, 2.0), (None, float("nan"), float("-inf")), ("one", 7.0, None)]
    check(spark, rows, ["g"], ["a", "b"], {"low": 0.025, "mid": 0.5, "high": 0.9})


def test_statistics_of_everything_and_of_nothing(spark):
    check(spark, [(float(x), -float(x)) for x in range(5000)], [], ["a", "b"], {"p": 0.333})
    assert distribution.described(spark.createDataFrame([], "g string, a double"), ["g"], ["a"]).count() == 0
    with pytest.raises(ValueError):
        distribution.described(spark.createDataFrame([], "n string, a double"), ["n"], ["a"])


def test_the_input_is_evaluated_once(spark):
    seen = spark.sparkContext.accumulator(0)

    @F.udf("double")
    def counted(x):
        seen.add(1)
        return float(x)

    rows = spark.range(3000).select((F.col("id") % 2).alias("g"), counted("id").alias("a"))
    out = distribution.medians(rows, ["g"], ["a"])
    assert {(r.g, r.mean_a, r.median_a) for r in out.collect()} == {(0, 1499.0, 1499.0), (1, 1500.0, 1500.0)}
    assert seen.value == 3000


def test_numbers_follow_from_seed_key_and_counter(spark):
    rows = spark.createDataFrame([("a", 1), ("b", None), (None, 3)], "k string, j int")
    got = {(r.k, r.j): r.u for r in rows.select("k", "j", randoms.uniform(7, "k", "j", counter=2).alias("u")).collect()}
    for k, j in got:
        digest = hashlib.md5(f"7:{k or ''}:{'' if j is None else j}:2".encode()).hexdigest()
        assert got[k, j] == (int(digest[:13], 16) + 0.5) / 2**52
    sql = duckdb.sql(f"SELECT k, j, {randoms.sql_uniform(7, 'k', 'j', counter=2)} u, {randoms.sql_normal(7, 'k', counter=1)} z FROM (VALUES ('a', 1), ('b', NULL), (NULL, 3)) v(k, j)").fetchall()
    assert {(k, j): u for k, j, u, _ in sql} == got
    z = {r.k: r.z for r in rows.select("k", randoms.normal(7, "k", counter=1).alias("z")).collect()}
    assert {k: z_ for k, _, _, z_ in sql} == pytest.approx(z)


def test_law_of_the_draws(spark):
    people = spark.range(20000).select(F.col("id").cast("string").alias("person_id"), F.when(F.col("id") % 2 == 0, 0.2).otherwise(0.9).alias("p_outdoor"))
    rows = exposure.sampled_factors(people, seed=5, school_p=0.5).toPandas()
    even = rows.person_id.astype(int) % 2 == 0
    assert abs(rows.work_outdoor[even].mean() - 0.2) < 0.02 and abs(rows.work_outdoor[~even].mean() - 0.9) < 0.02
    inside, outside = np.log(rows.work_pen[~rows.work_outdoor]), np.log(rows.work_prox[rows.work_outdoor])
    for x, gm, gsd in ((inside, 0.385, 1.69), (outside, 1.803, 2.97), (np.log(rows.home_pen), 0.385, 1.69)):
        n = len(x)
        assert abs(x.mean() - math.log(gm)) < 4 * math.log(gsd) / n**0.5 and abs(x.std() / math.log(gsd) - 1) < 4 / n**0.5
        assert abs(((x - x.mean()) ** 3).mean() / x.std() ** 3) < 4 * (6 / n) ** 0.5
    # where the deviation is 1 there is nothing to draw
    assert set(rows.work_pen[rows.work_outdoor]) == {1.0} and set(rows.home_prox) == {1.0}
    # of one person, the numbers of different factors are unrelated
    assert abs(np.corrcoef(np.log(rows.home_pen), np.log(rows.school_pen).where(rows.school_pen != 1.0, 0.0))[0, 1]) < 0.03
    assert abs((rows.school_pen == 1.0).mean() - 0.5) < 0.02


def test_thinning_keeps_whole_draws(spark):
    rows = spark.range(60).select((F.col("id") % 3).alias("chain"), F.floor(F.col("id") / 3).alias("draw"), F.explode(F.array(F.lit(0), F.lit(1))).alias("element"))
    few = randoms.chosen_draws(rows, 7, "chain", "draw", seed=2).collect()
    assert len(few) == 14 and len({(r.chain, r.draw) for r in few}) == 7
    assert {(r.chain, r.draw) for r in randoms.chosen_draws(rows, 7, "chain", "draw", seed=2).collect()} == {(r.chain, r.draw) for r in few}
    assert {(r.chain, r.draw) for r in randoms.chosen_draws(rows, 7, "chain", "draw", seed=3).collect()} != {(r.chain, r.draw) for r in few}
    assert randoms.chosen_draws(rows, 100, "chain", "draw").count() == 120


def test_lines_are_ranked_over_ranges(spark):
    values = sorted({round(random.Random(9).random() * k, 6) for k in range(1, 300)})
    rows = spark.createDataFrame([(v,) for v in values + values[:50]] + [(None,)], "lon double").repartition(5)
    got = sorted(((r.lon, r._i, r._gap) for r in spatial.ranked_lines(rows, "lon").collect()), key=lambda x: x[1])
    assert [(v, i) for v, i, _ in got] == [(v, i) for i, v in enumerate(values)]
    assert got[0][2] is None and [g for _, _, g in got[1:]] == pytest.approx(np.diff(values).tolist())
    assert spatial.thin(spark.createDataFrame([(1.0, 2.0)], "lon double, lat double"), 500.0).count() == 1
