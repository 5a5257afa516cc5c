"""Exact statistics of groups of any size: no task gathers or sorts a whole group, and the input is evaluated once."""

from __future__ import annotations

import json
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .staging import staged

CELLS = 1024  # parts of a bracket that are counted
SMALL = 2048  # rows of a bracket whose values are counted one by one
LISTED = 256  # parts of a bracket of lists, which a task counts for all places at once
AT_ONCE = 1024  # rows with lists that are counted at once
BRACKETS = 16_384  # brackets of lists whose parts a task holds, some 100 MB


def _joined(left: DataFrame, right: DataFrame, keys: list[str], more: Column | None = None) -> DataFrame:
    """Inner join by keys in which nulls are equal; keys of the left side stay."""
    other = right.withColumnsRenamed({k: f"_o_{k}" for k in keys})
    match = F.lit(True) if more is None else more
    for k in keys:
        match = match & F.col(k).eqNullSafe(F.col(f"_o_{k}"))
    return left.join(other, match).drop(*[f"_o_{k}" for k in keys])


def summarise(df: DataFrame, groups: list[str], values: list[str], quantiles: dict[str, float], each: str | None = None, at_hand: bool = False) -> DataFrame:
    """groups, column, n, mean, std (0 of one row), min, max and one column for each quantile, linearly interpolated.

    One row for each group and each of the value columns that has finite numbers; null, NaN and infinite ones don't count.

    each: a column with a list of structs, of whose fields some of the groups are: a row counts once for each; it is staged as a list.
    The values are staged once, unless they are at hand, as a staged table is. The ranks that the quantiles ask for start in one bracket a group, from its least to its largest
    value. Each pass counts the rows of the open brackets by CELLS equal parts, or by value where a bracket has at most SMALL
    rows, before anything is shuffled; the parts that hold a wanted rank are the next brackets. A part whose least and largest
    values are equal is an answer. Both ends of a bracket fall into parts of their own, so every pass narrows all brackets; usually
    two do. No window sees more than the parts of one bracket.
    """
    for name in ("column", "_v", "n", "mean", "std", "min", "max"):
        if name in groups:
            raise ValueError(f"a group may not be called {name}")
    own = [g for g in groups if g in df.columns] if each else groups
    wide = df.select(*own, *([each] if each else []), *[F.col(v).cast("double").alias(f"_v{i}") for i, v in enumerate(values)])
    wide = wide if at_hand else staged(wide, "values")
    if each:
        wide = wide.withColumn("_one", F.explode(each)).select(*[g if g in own else f"_one.{g}" for g in groups], *[f"_v{i}" for i in range(len(values))])
    cells = F.explode(F.array(*[F.struct(F.lit(v).alias("column"), F.col(f"_v{i}").alias("_v")) for i, v in enumerate(values)]))
    rows = wide.select(*groups, cells.alias("_x")).select(*groups, "_x.column", "_x._v")
    rows = rows.filter(F.col("_v").isNotNull() & ~F.isnan("_v") & (F.abs("_v") < float("inf")))
    keys = [*groups, "column"]
    figures = [F.count(F.lit(1)).alias("n"), F.avg("_v").alias("mean"), F.coalesce(F.stddev_samp("_v"), F.lit(0.0)).alias("std"), F.min("_v").alias("min"), F.max("_v").alias("max")]
    moments = staged(rows.groupBy(*keys).agg(*figures), "moments")

    def counted(open_: DataFrame) -> DataFrame:
        inside = _joined(rows, open_.drop("_ranks", "_before"), keys, (F.col("_v") >= F.col("_lo")) & (F.col("_v") <= F.col("_hi")))
        # halves don't overflow; where the parts are too narrow to tell, the first value is set apart
        part = F.floor(F.try_divide(F.col("_v") / 2 - F.col("_lo") / 2, F.col("_hi") / 2 - F.col("_lo") / 2) * CELLS)
        part = F.when(F.col("_size") > SMALL, F.coalesce(part, F.when(F.col("_v") > F.col("_lo"), CELLS).otherwise(0)))
        value = F.when(F.col("_size") <= SMALL, F.col("_v"))
        parts = inside.groupBy(*keys, "_lo", part.alias("_part"), value.alias("_value")).agg(F.count(F.lit(1)).alias("_c"), F.min("_v").alias("_min"), F.max("_v").alias("_max"))
        return parts.drop("_part", "_value")

    out, ends = _ranked(moments, keys, quantiles, counted)
    return out.select(*keys, "n", "mean", "std", "min", "max", *ends)


def _ranked(moments: DataFrame, keys: list[str], quantiles: dict[str, float], counted: Callable[[DataFrame], DataFrame]) -> tuple[DataFrame, list[Column]]:
    """moments (keys, n, min, max, ...) with what the wanted ranks hold, and a column for each quantile.

    counted: the rows of open brackets (keys, _lo, _hi, _before, _size, _ranks) by parts, as (keys, _lo, _c, _min, _max): how many, the
    least and the largest value. Parts of a bracket don't overlap.
    """
    position = {name: (F.col("n") - 1) * F.lit(float(q)) for name, q in quantiles.items()}
    lower = {name: F.floor(p).cast("long") for name, p in position.items()}
    upper = {name: F.ceil(p).cast("long") for name, p in position.items()}
    ranks = F.array_distinct(F.array(*lower.values(), *upper.values()))
    open_ = moments.select(*keys, F.col("min").alias("_lo"), F.col("max").alias("_hi"), F.lit(0).cast("long").alias("_before"), F.col("n").alias("_size"), ranks.alias("_ranks"))
    found = None
    while True:
        order = Window.partitionBy(*keys, "_lo").orderBy("_min")  # at most CELLS + 1 or SMALL rows
        ended = counted(open_).withColumn("_end", F.sum("_c").over(order))
        met = _joined(ended, open_.drop("_hi", "_size"), [*keys, "_lo"])
        met = met.withColumns({"_first": F.col("_before") + F.col("_end") - F.col("_c"), "_after": F.col("_before") + F.col("_end")})
        met = met.withColumn("_here", F.filter("_ranks", lambda r: (r >= F.col("_first")) & (r < F.col("_after")))).filter(F.size("_here") > 0)
        hit = met.select(*keys, F.col("_min").alias("_lo"), F.col("_max").alias("_hi"), F.col("_first").alias("_before"), F.col("_c").alias("_size"), F.col("_here").alias("_ranks"))
        hit = staged(hit, "brackets")
        done = hit.filter("_lo = _hi").select(*keys, F.explode("_ranks").alias("_rank"), F.col("_lo").alias("_at"))
        found = done if found is None else found.unionByName(done)
        open_ = hit.filter("_lo < _hi")
        if open_.isEmpty():
            break
    answers = found.groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct("_rank", "_at"))).alias("_found"))  # two entries a quantile at most
    ends = {name: (F.element_at("_found", lower[name]), F.element_at("_found", upper[name]), position[name] - F.floor(position[name])) for name in quantiles}
    return _joined(moments, answers, keys), [((1 - w) * a + w * b).alias(name) for name, (a, b, w) in ends.items()]


def _matrices(columns: list[str], n: int, running: dict[str, str], wanted: set[tuple[int, str]] | None = None):
    """A function of Arrow batches to (group, column, matrix of rows x n) of the lists of each group's rows; numbers that are no finite ones
    are NaN. Rows count for the groups that their list ``_groups`` numbers, or all for group 0 where there is none. wanted: which to give."""
    import numpy as np

    def run(batches):
        for whole in batches:
            for k in range(0, whole.num_rows, AT_ONCE):
                batch = whole.slice(k, AT_ONCE)
                rows_of = {0: slice(None)}
                if "_groups" in batch.schema.names:
                    lists = batch.column("_groups")
                    group = lists.flatten().to_numpy(zero_copy_only=False)
                    whose = np.repeat(np.arange(batch.num_rows), np.diff(np.asarray(lists.offsets)))
                    rows_of = {int(g): whose[group == g] for g in np.unique(group)}
                for c in columns:
                    some = [g for g in rows_of if wanted is None or (g, c) in wanted]
                    if not some:
                        continue
                    flat = batch.column(running.get(c, c)).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, n)
                    flat = np.cumsum(flat, axis=1) if c in running else flat
                    flat = np.where(np.isfinite(flat), flat, np.nan)
                    for g in some:
                        yield g, c, flat[rows_of[g]]

    return run


def _moments(columns: list[str], n: int, running: dict[str, str]):
    import numpy as np
    import pyarrow as pa

    matrices = _matrices(columns, n, running)

    def run(batches):
        total: dict[tuple[int, str], list] = {}
        for g, c, m in matrices(batches):
            t = total.setdefault((g, c), [np.zeros(n, np.int64), np.zeros(n), np.full(n, np.inf), np.full(n, -np.inf)])
            t[0] += (~np.isnan(m)).sum(axis=0)
            t[1] += np.nansum(m, axis=0)
            t[2], t[3] = np.fmin(t[2], np.fmin.reduce(m, axis=0)), np.fmax(t[3], np.fmax.reduce(m, axis=0))
        for (g, c), t in total.items():
            some = t[0] > 0
            k = int(some.sum())
            yield pa.RecordBatch.from_arrays([pa.array(np.full(k, g, np.int32)), pa.array(np.arange(n, dtype=np.int32)[some]), pa.array([c] * k, pa.string()), *[pa.array(x[some]) for x in t]], names=["_group", "bin_index", "column", "n", "_sum", "min", "max"])

    return run


def _counts(columns: list[str], n: int, running: dict[str, str], brackets: list[tuple]):
    """Parts of the brackets (group, column, bin_index, lo, hi, size), counted over a task's rows."""
    import numpy as np
    import pyarrow as pa

    ordered = sorted(brackets)
    rounds: dict[tuple[int, str], list[dict[int, int]]] = {}  # of each group's column, brackets of different bins, dealt with at once
    for k, (g, c, b, *_) in enumerate(ordered):
        of = rounds.setdefault((g, c), [])
        at = next((r for r in of if b not in r), None)
        if at is None:
            of.append(at := {})
        at[b] = k
    matrices = _matrices(columns, n, running, set(rounds))
    names = ["_group", "bin_index", "column", "_lo", "_part", "_value", "_c", "_min", "_max"]
    lo, hi = np.array([b[3] for b in ordered]), np.array([b[4] for b in ordered])
    few = np.array([b[5] <= SMALL for b in ordered], bool)
    group, column, place = np.array([b[0] for b in ordered], np.int32), np.array([b[1] for b in ordered], object), np.array([b[2] for b in ordered], np.int32)

    def rows(k, part, value, c, least, most):
        return pa.RecordBatch.from_arrays([pa.array(group[k]), pa.array(place[k]), pa.array(column[k], pa.string()), pa.array(lo[k]), pa.array(part, pa.int64()), pa.array(value, pa.float64()), pa.array(c, pa.int64()), pa.array(least), pa.array(most)], names=names)

    def run(batches):
        size = len(ordered) * (LISTED + 1)
        count, least, most = np.zeros(size, np.int64), np.full(size, np.inf), np.full(size, -np.inf)
        for g, c, m in matrices(batches):
            for one in rounds[g, c]:
                bins = np.fromiter(one.keys(), np.int64)
                which = np.fromiter(one.values(), np.int64)
                some = m if len(bins) == n and (bins == np.arange(n)).all() else m[:, bins]
                width = hi[which] / 2 - lo[which] / 2
                inside = (some >= lo[which]) & (some <= hi[which])
                if inside.all() and not few[which].any() and (width > 0).all():  # as in the first pass
                    v, k = some, which
                else:
                    at = np.nonzero(inside)
                    v, k = some[at], which[at[1]]
                    exact = few[k]
                    if exact.any():
                        yield rows(k[exact], np.full(exact.sum(), -1), v[exact], np.ones(exact.sum(), np.int64), v[exact], v[exact])
                        v, k = v[~exact], k[~exact]
                    width = hi[k] / 2 - lo[k] / 2
                with np.errstate(divide="ignore", invalid="ignore"):
                    part = np.floor((v / 2 - lo[k] / 2) / width * LISTED)
                part = np.where(width > 0, part, np.where(v > lo[k], LISTED, 0)).astype(np.int64)
                cell, v = (k * (LISTED + 1) + part).ravel(), v.ravel()
                first, last = which.min() * (LISTED + 1), (which.max() + 1) * (LISTED + 1)  # a column's brackets are side by side
                count[first:last] += np.bincount(cell - first, minlength=last - first)
                less, more = v < least[cell], v > most[cell]
                np.minimum.at(least, cell[less], v[less])
                np.maximum.at(most, cell[more], v[more])
        held = np.nonzero(count)[0]
        for k in range(0, len(held), 65_536):
            h = held[k : k + 65_536]
            yield rows(h // (LISTED + 1), h % (LISTED + 1), np.full(len(h), 0.0), count[h], least[h], most[h])

    return run


def summarise_lists(df: DataFrame, values: list[str], n: int, quantiles: dict[str, float], running: dict[str, str] | None = None, each: str | None = None) -> DataFrame:
    """bin_index, column, n, mean, min, max and the quantiles as ``summarise`` gives them, of each place in lists of n numbers.

    df: one list a row and column; it should be staged, for every pass reads it. running: value columns that are the running sums of a list column.
    each: a column with a list of structs, the groups for which a row counts; their fields come first then. Groups should be few, as cohorts are:
    they are numbered, and the brackets, a few for each group, place and quantile whatever the rows are, go to the tasks, which count their
    own rows by numpy, BRACKETS at a time.
    """
    running = running or {}
    lists = df.select(*dict.fromkeys(running.get(v, v) for v in values), *([each] if each else []))
    if each:
        number = df.select(F.explode(F.array_distinct(each)).alias("g")).distinct().coalesce(1).withColumn("_group", F.monotonically_increasing_id().cast("int"))
        numbers = staged(number, "groups")
        of = F.map_from_entries(F.collect_list(F.struct(F.to_json("g", {"ignoreNullFields": "false"}), "_group")))
        table = numbers.agg(of.alias("t")).head()[0]  # a number for each group
        known = F.from_json(F.lit(json.dumps(table)), "map<string, int>")
        lists = lists.withColumn("_groups", F.transform(F.array_distinct(each), lambda g: F.element_at(known, F.to_json(g, {"ignoreNullFields": "false"})))).drop(each)
    keys = ["_group", "bin_index", "column"]
    types = "_group int, bin_index int, column string"
    per_task = lists.mapInArrow(_moments(values, n, running), f"{types}, n long, _sum double, min double, max double")
    moments = per_task.groupBy(*keys).agg(F.sum("n").alias("n"), (F.sum("_sum") / F.sum("n")).alias("mean"), F.min("min").alias("min"), F.max("max").alias("max"))
    moments = staged(moments, "moments")

    def counted(open_: DataFrame) -> DataFrame:
        brackets = sorted(tuple(r) for r in open_.select("_group", "column", "bin_index", "_lo", "_hi", "_size").collect())  # two a quantile, group and place at most
        parts = [lists.mapInArrow(_counts(values, n, running, brackets[k : k + BRACKETS]), f"{types}, _lo double, _part long, _value double, _c long, _min double, _max double") for k in range(0, max(1, len(brackets)), BRACKETS)]
        return reduce(DataFrame.unionByName, parts).groupBy(*keys, "_lo", "_part", "_value").agg(F.sum("_c").alias("_c"), F.min("_min").alias("_min"), F.max("_max").alias("_max")).drop("_part", "_value")

    out, ends = _ranked(moments, keys, quantiles, counted)
    if each:
        out = out.join(F.broadcast(numbers), "_group")
    return out.select(*(["g.*"] if each else []), "bin_index", "column", "n", "mean", "min", "max", *ends)


def percentiles(df: DataFrame, groups: list[str], value: str, quantiles: dict[str, float]) -> DataFrame:
    """groups and one column for each quantile, linearly interpolated, of the value's rows that are finite numbers."""
    return summarise(df, groups, [value], quantiles).select(*groups, *quantiles)


def describe(df: DataFrame, groups: list[str], value: str) -> DataFrame:
    """n, mean, median, std (0 of one row), min, max, p25, p75 of each group's values; null, NaN and infinite ones don't count."""
    return described(df, groups, [value]).drop("column")


def described(df: DataFrame, groups: list[str], values: list[str]) -> DataFrame:
    """``describe`` of several columns from one evaluation: groups, column and the figures."""
    out = summarise(df, groups, values, {"p25": 0.25, "median": 0.5, "p75": 0.75})
    return out.select(*groups, "column", "n", "mean", "median", "std", "min", "max", "p25", "p75")


def medians(df: DataFrame, groups: list[str], values: list[str], each: str | None = None, at_hand: bool = False) -> DataFrame:
    """groups with mean_<value> and median_<value> of several columns, from one evaluation; a group without any finite number is absent."""
    long = summarise(df, groups, values, {"median": 0.5}, each, at_hand)
    of = lambda figure, v: F.max(F.when(F.col("column") == v, F.col(figure))).alias(f"{figure}_{v}")
    return long.groupBy(*groups).agg(*[of(figure, v) for v in values for figure in ("mean", "median")])
