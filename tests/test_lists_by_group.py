"""Statistics of lists by group, and payloads made of them."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from airexposure.operators import distribution, exposure


def test_lists_count_for_all_their_groups(spark, monkeypatch):
    monkeypatch.setattr(distribution, "SMALL", 20)
    monkeypatch.setattr(distribution, "BRACKETS", 7)
    rng = random.Random(3)
    groups = [("a", "x"), ("a", None), ("b", "x")]
    rows = [([rng.random() * 10**k for k in range(4)], [g for g in groups if rng.random() < 0.5] or None) for _ in range(300)] + [([1.0, 2.0, 3.0, 4.0], [("b", "one")] * 2)]
    lists = spark.createDataFrame(rows, "v array<double>, groups array<struct<cohort: string, grp: string>>").repartition(3)
    got = {(r.cohort, r.grp, r.column, r.bin_index): r for r in distribution.summarise_lists(lists, ["v", "sum"], 4, {"median": 0.5, "p90": 0.9}, {"sum": "v"}, "groups").collect()}
    assert len(got) == 4 * 2 * 4
    for g in [*groups, ("b", "one")]:
        of = np.array([v for v, its in rows if its and g in its])
        for c, m in (("v", of), ("sum", np.cumsum(of, axis=1))):
            for k in range(4):
                r = got[*g, c, k]
                assert (r.n, r.min, r.max) == (len(m), m[:, k].min(), m[:, k].max())
                assert [r["mean"], r.median, r.p90] == pytest.approx([m[:, k].mean(), *np.quantile(m[:, k], [0.5, 0.9])], rel=1e-12)


@pytest.mark.parametrize("metric", [None, "twac"])
def test_payload_of_lists_equals_that_of_rows(spark, metric):
    rng = random.Random(4)
    people = spark.createDataFrame([(f"p{i}", [("all", "all")] + ([("c", "odd")] if i % 2 else [])) if i else ("p0", None) for i in range(9)], "person_id string, groups array<struct<cohort: string, grp: string>>")
    rows = spark.createDataFrame([(f"p{i}", "origin", 0.0, 3600.0 * rng.randint(1, 24), rng.random(), None) for i in range(9)], "person_id string, location_type string, start_s double, end_s double, concentration double, travel_exposure double")
    home = spark.createDataFrame([(f"p{i}", [rng.random(), rng.random()]) for i in range(8)], "person_id string, home array<double>")
    few = spark.createDataFrame([("p3",), ("p4",), ("p0",)], "person_id string")
    made = lambda **form: exposure.curves(rows, 12, home=home, slots=[0, 720], carried=people, **form)
    want = exposure.payload(exposure.timeseries(made(), metric=metric, n=12), None, few, metric, 12)
    curve = made(listed=True, kinds=("increment",))
    assert sorted(curve.columns) == ["groups", "home_increment", "increment", "person_id"]
    got = exposure.payload_of_lists(curve, few, metric, 12)
    flat = lambda df: {(r.cohort, r.grp): r.asDict(True) for r in df.select(*want.columns).orderBy("cohort", "grp").collect()}
    a, b = flat(got), flat(want)
    assert set(a) == set(b) == {("all", "all"), ("c", "odd")}
    for k in a:
        assert a[k]["metadata"] == b[k]["metadata"] and a[k]["time_points"] == b[k]["time_points"]
        assert [c["person_id"] for c in a[k]["sample_curves"]] == [c["person_id"] for c in b[k]["sample_curves"]]
        assert [c["home"] for c in a[k]["sample_curves"]] == [pytest.approx(c["home"]) for c in b[k]["sample_curves"]]
        assert [c["activity"] for c in a[k]["sample_curves"]] == [pytest.approx(c["activity"]) for c in b[k]["sample_curves"]]
        for c in want.columns[3:11]:
            assert a[k][c] == pytest.approx(b[k][c], rel=1e-12)
