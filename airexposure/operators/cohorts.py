"""Cohort membership from predicates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def membership(persons: DataFrame, cohorts: dict[str, dict[str, str]]) -> DataFrame:
    """(person_id, cohort, grp): a row for each group whose predicate holds; groups may overlap, null predicates are out."""
    groups = [F.when(F.expr(p), F.struct(F.lit(c).alias("cohort"), F.lit(g).alias("grp"))) for c, of in cohorts.items() for g, p in of.items()]
    return persons.select("person_id", F.explode(F.filter(F.array(*groups), lambda g: g.isNotNull())).alias("g")).select("person_id", "g.*")


def comparison(rows: DataFrame, metrics: list[str]) -> DataFrame:
    """A wide row for each group of the cohorts that have two or more: n, and of each metric its mean, deviation and 95 % error."""
    spread = {m: F.coalesce(F.stddev_samp(m), F.lit(0.0)) for m in metrics}
    each = [(F.avg(m).alias(f"{m}_mean"), s.alias(f"{m}_std"), (1.96 * s / F.sqrt(F.count(m))).alias(f"{m}_error")) for m, s in spread.items()]
    out = rows.groupBy("cohort", "grp").agg(F.count(metrics[0]).alias("n"), *[c for three in each for c in three])
    several = out.groupBy("cohort").agg(F.count(F.lit(1)).alias("_g")).filter("_g >= 2")
    return out.join(several, "cohort", "left_semi")


def with_everyone(members: DataFrame, persons: DataFrame) -> DataFrame:
    """members with all persons as cohort and group all."""
    return members.unionByName(persons.select("person_id", F.lit("all").alias("cohort"), F.lit("all").alias("grp")))


def listed(members: DataFrame) -> DataFrame:
    """(person_id, groups): each person's groups as one list of (cohort, grp)."""
    return members.groupBy("person_id").agg(F.collect_set(F.struct("cohort", "grp")).alias("groups"))


def from_groups(groups: dict[str, str]) -> dict[str, dict[str, str]]:
    """Flat groups as one cohort; those without a name or predicate are left out."""
    return {"custom_groups": {g: p for g, p in groups.items() if g and p}}


def ids_of(members: DataFrame, cohort: str, grp: str) -> DataFrame:
    """(person_id) of one group, in order."""
    return members.filter((F.col("cohort") == cohort) & (F.col("grp") == grp)).select("person_id").distinct().orderBy("person_id")


def of_persons(rows: DataFrame, ids: DataFrame) -> DataFrame:
    """rows of the persons among ids."""
    return rows.join(ids.select("person_id"), "person_id", "left_semi")


STATISTICS = ["n", "mean", "median", "std", "min", "max", "p25", "p75"]


def statistics_json(stats: DataFrame, *metrics: str) -> DataFrame:
    """stats (cohort, grp, metric, statistics) to one nested row for each group: population and a struct for each metric."""
    one = lambda m: F.first(F.when(F.col("metric") == m, F.struct(*STATISTICS)), ignorenulls=True)
    return stats.groupBy("cohort", "grp").agg(F.max("n").alias("population"), *[one(m).alias(m) for m in metrics])


def wide(stats: DataFrame, metrics: list[str]) -> DataFrame:
    """A row for each group of cohorts with two or more, a column metric.statistic for each."""
    values = stats.groupBy("cohort", "grp").pivot("metric", metrics).agg(*[F.first(c).alias(c) for c in STATISTICS])
    out = values.toDF(*[c.replace("_", ".", 1) if c not in ("cohort", "grp") and c.split("_")[0] in metrics else c for c in values.columns])
    several = out.groupBy("cohort").agg(F.count(F.lit(1)).alias("_g")).filter("_g >= 2")
    return out.join(several, "cohort", "left_semi")
