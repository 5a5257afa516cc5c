"""Factors, travel rules, exposure, home scenario and curves."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .cohorts import listed
from .distribution import medians, summarise_lists
from .randoms import normal, uniform
from .staging import staged

#: Fixed values: (penetration, proximity) geometric mean and deviation by microenvironment.
FACTORS = {
    "work_indoor": {"pen": (0.385, 1.69), "prox": (1.0, 1.0)},
    "work_outdoor_near_road": {"pen": (1.0, 1.0), "prox": (1.803, 2.97)},
    "school_indoor": {"pen": (0.385, 1.69), "prox": (1.0, 1.0)},
    "school_outdoor": {"pen": (1.0, 1.0), "prox": (1.0, 1.0)},
}
INDOOR = ("work", "school", "home")
#: Where the factors of work, school and home are taken from, outdoors and indoors.
PLACES = {"work": ("work_outdoor_near_road", "work_indoor"), "school": ("school_outdoor", "school_indoor"), "home": ("school_indoor", "school_indoor")}
TRAVEL_RULES = ("mid-point-teleportation", "mid-point-hapem", "centroid_ambient", "origin_destination_mean", "hardcoded", "home_exposure")


def _mixed(p: Column, outdoor: tuple, indoor: tuple) -> Column:
    return p * outdoor[0] + (1 - p) * indoor[0]


def person_factors(persons: DataFrame, school_p: float = 0.0, table: dict = FACTORS) -> DataFrame:
    """persons (person_id, p_outdoor) to expected-value factors work_pen ... home_prox and work_outdoor (p >= 0.5)."""
    p, s = F.coalesce(F.col("p_outdoor"), F.lit(0.0)), F.lit(float(school_p))
    out = persons.groupBy("person_id").agg(F.min("p_outdoor").alias("p_outdoor"))
    home = table.get("home_indoor") or table.get("school_indoor") or table["work_indoor"]
    return out.select(
        "person_id", (p >= 0.5).alias("work_outdoor"),
        *[_mixed(p, table["work_outdoor_near_road"][k], table["work_indoor"][k]).alias(f"work_{k}") for k in ("pen", "prox")],
        *[_mixed(s, table["school_outdoor"][k], table["school_indoor"][k]).alias(f"school_{k}") for k in ("pen", "prox")],
        *[F.lit(home[k][0]).alias(f"home_{k}") for k in ("pen", "prox")],
    )


def sampled_factors(persons: DataFrame, seed: int = 1, school_p: float = 0.0, table: dict = FACTORS) -> DataFrame:
    """Stochastic factors: outdoors with probability p_outdoor, each factor lognormal about its geometric mean; draws follow from (seed, person).

    Counters 0 and 1 decide on work and school outdoors; the six factors take the normal numbers 1 to 6.
    """
    rows = persons.groupBy("person_id").agg(F.coalesce(F.min("p_outdoor"), F.lit(0.0)).alias("p"))
    out = {"work": uniform(seed, "person_id", counter=0) < F.col("p"), "school": uniform(seed, "person_id", counter=1) < school_p, "home": F.lit(False)}
    rows = rows.withColumns({f"_{k}": v for k, v in out.items()})
    cols = []
    for k, (place, factor) in enumerate(((place, factor) for place in ("work", "school", "home") for factor in ("pen", "prox")), 1):
        outside, inside = PLACES[place]
        gm, gsd = (F.when(F.col(f"_{place}"), F.lit(table[outside][factor][i])).otherwise(F.lit(table[inside][factor][i])) for i in (0, 1))
        drawn = F.exp(F.log(gm) + F.log(gsd) * normal(seed, "person_id", counter=k))
        cols.append(F.when(gsd > 1, drawn).otherwise(gm).alias(f"{place}_{factor}"))
    return rows.select("person_id", F.col("_work").alias("work_outdoor"), *cols)


def with_factor(rows: DataFrame, factors: DataFrame, kept: tuple = ()) -> DataFrame:
    """rows with _factor: penetration times proximity of indoor microenvironments, 1 elsewhere and for persons without factors. kept: columns of factors that stay."""
    joined = rows.join(factors.hint("shuffle_hash"), "person_id", "left")  # rows that are together by person are neither moved nor sorted
    factor = F.lit(1.0)
    for place in INDOOR:
        factor = F.when(F.col("microenv") == f"{place}_indoor", F.coalesce(F.col(f"{place}_pen") * F.col(f"{place}_prox"), F.lit(1.0))).otherwise(factor)
    return joined.withColumn("_factor", factor).drop(*[c for c in ("work_outdoor", *[f"{p}_{f}" for p in INDOOR for f in ("pen", "prox")]) if c not in kept])


def apply_factors(rows: DataFrame, values: list[str]) -> DataFrame:
    """values times the rows' _factor, which goes."""
    return rows.withColumns({v: F.col(v) * F.col("_factor") for v in values}).drop("_factor")


def with_exposure(rows: DataFrame, rule: str, constant: float = 10.0, pen: float = 0.9, prox: float = 1.2, home: DataFrame | None = None, suffix: str = "") -> DataFrame:
    """rows (concentration) with travel_exposure by the rule and exposure = rate x hours, of the columns with the suffix.

    home: (person_id, slot, home_concentration) for home_exposure, where the rows don't have that column yet.
    """
    travel = F.col("location_type") == "travel"
    c = F.col(f"concentration{suffix}")
    if rule == "mid-point-teleportation":
        value = c * constant
    elif rule == "mid-point-hapem":
        value = c * pen * prox
    elif rule == "centroid_ambient":
        value = c
    elif rule == "origin_destination_mean":
        # low and high take the middle value's neighbours too
        w = Window.partitionBy("person_id").orderBy("seq", "piece", "half")
        a, b = F.lag("concentration").over(w), F.lead("concentration").over(w)
        value = F.coalesce((a + b) / 2, a, b, F.lit(constant))
    elif rule == "hardcoded":
        value = F.lit(constant)
    elif rule == "home_exposure":
        if home is not None:
            rows = rows.join(home, ["person_id", "slot"], "left")
        value = F.coalesce(F.col("home_concentration"), F.lit(constant))
    else:
        raise ValueError(f"unknown travel rule {rule}")
    out = rows.withColumn(f"travel_exposure{suffix}", F.when(travel, F.coalesce(value, c * constant)))
    return out.withColumn(f"exposure{suffix}", F.when(travel, F.col(f"travel_exposure{suffix}")).otherwise(c) * F.col("duration_hours"))


def totals(rows: DataFrame, suffixes: tuple = ("",), carried: tuple = ()) -> DataFrame:
    """(person_id, total_exposure of each suffix, duration_hours, carried columns, of which a person's rows all have the same value)."""
    sums = [F.coalesce(F.sum(f"exposure{s}"), F.lit(0.0)).alias(f"total_exposure{s}") for s in suffixes]
    return rows.groupBy("person_id").agg(*sums, F.sum("duration_hours").alias("duration_hours"), *[F.first(c).alias(c) for c in carried])


#: Metrics: units, and by what a travel concentration is multiplied for a day without a known home.
METRICS = {"cumulative": ("ug/m3*h", 24.0), "twac": ("ug/m3", 1.0)}


def metric_name(text: str | None) -> str:
    """twac or cumulative, which anything else stands for too."""
    name = (text or "").strip().lower()
    return name if name in METRICS else "cumulative"


def metric_units(metric: str | None) -> str:
    return METRICS[metric_name(metric)][0]


def home_fallback(travel_value: float, metric: str | None = None) -> float:
    """The home exposure of a person without a known home."""
    return travel_value * METRICS[metric_name(metric)][1]


def activity_metric(total: DataFrame, metric: str | None = None) -> DataFrame:
    """(person_id, total_exposure, duration_hours) with total_exposure as a time-weighted average for twac, 0 without hours."""
    if metric_name(metric) == "cumulative":
        return total
    return total.withColumn("total_exposure", F.when(F.col("duration_hours") > 0, F.col("total_exposure") / F.col("duration_hours")).otherwise(0.0))


def rate(rule: str = "travel_first", suffix: str = "") -> Column:
    """Exposure rate of a row: travel exposure of travel rows first, the same with 0 for travel rows without one, or concentration first."""
    c, t = F.col(f"concentration{suffix}"), F.col(f"travel_exposure{suffix}")
    if rule == "travel_or_zero":
        return F.when(F.col("location_type") == "travel", F.coalesce(t, F.lit(0.0))).otherwise(c)
    if rule == "travel_first":
        return F.when((F.col("location_type") == "travel") & t.isNotNull(), t).otherwise(c)
    return F.coalesce(c, t)


def in_windows(rows: DataFrame, windows: dict[str, tuple[float, float]], rule: str = "travel_first") -> DataFrame:
    """(person_id, a column for each window): rate x overlap hours with each window (first hour, last hour) of the day; rows stay one each."""
    known = F.coalesce(rate(rule), F.lit(0.0))
    overlap = {n: (F.least("end_s", F.lit(b * 3600.0)) - F.greatest("start_s", F.lit(a * 3600.0))) / 3600.0 for n, (a, b) in windows.items()}
    return rows.groupBy("person_id").agg(*[F.coalesce(F.sum(F.when(h > 0, known * h)), F.lit(0.0)).alias(n) for n, h in overlap.items()])


def binned(rows: DataFrame, minutes: int = 5, rule: str = "travel_first", suffixes: tuple = ("",)) -> DataFrame:
    """(person_id, bin_index, amount): rate x overlap hours in bins of the day."""
    step = minutes * 60.0
    bins = rows.withColumn("bin_index", F.explode(F.expr(f"sequence(cast(floor(start_s / {step}) as int), cast(greatest(ceil(end_s / {step}) - 1, floor(start_s / {step})) as int))")))
    overlap = (F.least(F.col("end_s"), (F.col("bin_index") + 1) * step) - F.greatest(F.col("start_s"), F.col("bin_index") * step)) / 3600.0
    sums = [F.sum(F.coalesce(rate(rule, s), F.lit(0.0)) * overlap).alias(f"amount{s}") for s in suffixes]
    return bins.groupBy("person_id", "bin_index").agg(*sums)


AT_ONCE = 256  # persons whose curves are made at once


def _cut(rate_of: list[str], n: int, slot_of: list[int] | None, names: list[str], listed: bool = False):
    """A function of Arrow batches (person_id, pieces, carried columns[, home]) to rows of n bins a person, in order, or lists of them."""
    import numpy as np
    import pyarrow as pa

    step = 86_400.0 / n

    def one(batch):
        persons, pieces = batch.num_rows, batch.column("_pieces")
        flat = pieces.flatten()
        whose = np.repeat(np.arange(persons), np.diff(np.asarray(pieces.offsets)))
        part = {c: flat.field(c).to_numpy(zero_copy_only=False) for c in ("start_s", "end_s", *rate_of)}
        first = np.floor(part["start_s"] / step).astype(np.int64)
        count = np.maximum(np.ceil(part["end_s"] / step).astype(np.int64) - 1, first) - first + 1
        piece = np.repeat(np.arange(len(first)), count)
        bins = first[piece] + np.arange(len(piece)) - np.repeat(np.cumsum(count) - count, count)
        hours = (np.minimum(part["end_s"][piece], (bins + 1) * step) - np.maximum(part["start_s"][piece], bins * step)) / 3600.0
        inside = (bins >= 0) & (bins < n)
        at = (whose[piece] * n + bins)[inside]
        out = {"bin_index": np.tile(np.arange(n, dtype=np.int32), persons)}
        for r in rate_of:
            amount = np.bincount(at, (part[r][piece] * hours)[inside], persons * n).reshape(persons, n)
            out[r.replace("_rate", "increment")] = amount.ravel()
            if r.replace("_rate", "cumulative") in names:
                out[r.replace("_rate", "cumulative")] = np.cumsum(amount, axis=1).ravel()
        if slot_of is not None:
            home = batch.column("_home").flatten().to_numpy(zero_copy_only=False).reshape(persons, -1)[:, slot_of] * (24.0 / n)
            out["home_increment"] = home.ravel()
            if "home_cumulative" in names:
                out["home_cumulative"] = np.cumsum(home, axis=1).ravel()
        if listed:
            ends = pa.array(np.arange(persons + 1, dtype=np.int32) * n)
            return pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(ends, pa.array(out[c])) if c in out else batch.column(c) for c in names], names=names)
        each = pa.array(np.repeat(np.arange(persons), n))
        return pa.RecordBatch.from_arrays([pa.array(out[c]) if c in out else batch.column(c).take(each) for c in names], names=names)

    def run(batches):
        for batch in batches:
            for k in range(0, batch.num_rows, AT_ONCE):
                yield one(pa.RecordBatch.from_arrays([pa.concat_arrays([c.slice(k, AT_ONCE)]) for c in batch.columns], names=batch.schema.names))

    return run


def curves(rows: DataFrame, n: int = 288, suffixes: tuple = ("",), rule: str = "travel_first", home: DataFrame | None = None, slots: list[int] | None = None, carried: DataFrame | None = None, listed: bool = False, kinds: tuple = ("increment", "cumulative")) -> DataFrame:
    """(person_id, bin_index, increment, cumulative of each suffix) of each person of rows and each of n bins, a person's rows together and in order.

    home: (person_id, home), the hourly exposure at home in each of the slots (minutes of the day, in order), gives home_increment and
    home_cumulative too, 0 for persons without; carried: (person_id, ...), columns that come along. A person's pieces (a day's, a few
    hundred at most) are listed and cut into bins by numpy, so what is dealt by person is the pieces, once, and never the bins.
    listed: one row a person, whose columns are lists of the n bins' values, without bin_index. kinds: which columns there are.
    """
    needed = rows.filter("start_s is not null and end_s is not null")
    piece = F.struct(F.col("start_s").cast("double").alias("start_s"), F.col("end_s").cast("double").alias("end_s"), *[F.coalesce(rate(rule, s), F.lit(0.0)).alias(f"_rate{s}") for s in suffixes])
    each = needed.groupBy("person_id").agg(F.collect_list(piece).alias("_pieces"))
    fields = [f"{c}{s} double" for s in suffixes for c in kinds]
    slot_of = None
    if home is not None:
        each = each.join(home.hint("shuffle_hash"), "person_id", "left").withColumnRenamed("home", "_home")
        each = each.withColumn("_home", F.coalesce("_home", F.array(*[F.lit(0.0)] * len(slots))))
        slot_of = [min(range(len(slots)), key=lambda i: abs(slots[i] - b * (1440 // n))) for b in range(n)]
        fields += [f"home_{c} double" for c in kinds]
    more = [] if carried is None else [f for f in carried.schema if f.name != "person_id"]
    if carried is not None:
        each = each.join(carried.hint("shuffle_hash"), "person_id", "left")
    kind = each.schema["person_id"].dataType.simpleString()
    if listed:
        fields = [f.replace(" double", " array<double>") for f in fields]
    own = [f"person_id {kind}", *([] if listed else ["bin_index int"]), *fields]
    out = ", ".join([*own, *[f"{f.name} {f.dataType.simpleString()}" for f in more]])
    names = [x.split()[0] for x in own] + [f.name for f in more]
    return each.mapInArrow(_cut([f"_rate{s}" for s in suffixes], n, slot_of, names, listed), out)


def increments(curve: DataFrame, value: str = "cumulative") -> DataFrame:
    """curve (person_id, bin_index, value) with increment: the difference to the bin before, from 0."""
    before = F.lag(value, 1, 0.0).over(Window.partitionBy("person_id").orderBy("bin_index"))
    return curve.withColumn("increment", F.col(value) - before)


def timeseries(activity: DataFrame, home: DataFrame | None = None, metric: str | None = None, n: int = 288, suffixes: tuple = ("",), attributes: DataFrame | None = None) -> DataFrame:
    """(person_id, bin_index, activity/home/delta _cumulative and _increment of each suffix[, attributes]) in n bins of a day.

    activity: as ``curves`` gives it; home: (person_id, bin_index, home_increment, home_cumulative), missing ones count as 0, or None where
    activity has its columns; other columns of activity stay then. For twac
    cumulative values are divided by the hours so far and increments by a bin's hours. attributes: (person_id, ...), e.g. the industry.
    """
    rows = activity if home is None else activity.join(home, ["person_id", "bin_index"], "left")
    hours = {"cumulative": (F.col("bin_index") + 1) * (24.0 / n), "increment": F.lit(24.0 / n)}
    out = ["person_id", "bin_index"]
    for s in suffixes:
        for kind in ("cumulative", "increment"):
            a, h = F.col(f"{kind}{s}"), F.coalesce(f"home_{kind}", F.lit(0.0))
            if metric_name(metric) == "twac":
                a, h = a / hours[kind], h / hours[kind]
            out += [a.alias(f"activity_{kind}{s}"), *([h.alias(f"home_{kind}")] if not s else []), (a - h).alias(f"delta_{kind}{s}")]
    used = {"person_id", "bin_index", "home_increment", "home_cumulative", *[f"{k}{s}" for s in suffixes for k in ("increment", "cumulative")]}
    wide = rows.select(*out, *[c for c in activity.columns if home is None and c not in used])
    return wide if attributes is None else wide.join(attributes, "person_id", "left")


def home_line(home: DataFrame, n: int = 288) -> DataFrame:
    """home (person_id, home) as a straight line over the day: (person_id, bin_index, home_increment, home_cumulative)."""
    bins = home.select("person_id", "home", F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("bin_index"))
    return bins.select("person_id", "bin_index", (F.col("home") / n).alias("home_increment"), (F.col("home") * (F.col("bin_index") + 1) / n).alias("home_cumulative"))


def home_total(day: DataFrame, metric: str | None = None) -> DataFrame:
    """(person_id, home) of a static day: the concentration at home, which is (person_id, concentration), times 24, or itself for twac."""
    return day.select("person_id", (F.col("concentration") * METRICS[metric_name(metric)][1]).alias("home"))


def payload(series: DataFrame, groups: DataFrame | None, sampled: DataFrame, metric: str | None = None, n: int = 288) -> DataFrame:
    """One row for each (cohort, grp) with what a viewer shows: means and medians over persons at n + 1 points, the first 0, the curves
    of the sampled persons, and metadata.

    series: as ``timeseries`` gives it; groups: (person_id, cohort, grp), or None where the series carries ``groups``, each
    person's list of (cohort, grp); sampled: (person_id), a bounded sample. The series is written once, however many groups there are.
    """
    kinds = list(KINDS)
    carried = series.filter("groups is not null") if groups is None else series.join(listed(groups), "person_id")
    keys = ["cohort", "grp"]
    once = staged(carried.select("person_id", "groups", "bin_index", *kinds), "series")
    rows = once.withColumn("_g", F.explode("groups")).select("person_id", "_g.cohort", "_g.grp", "bin_index", *kinds)
    bins = medians(once, [*keys, "bin_index"], kinds, each="groups", at_hand=True).join(rows.groupBy(*keys, "bin_index").agg(F.count(F.lit(1)).alias("_n")), [*keys, "bin_index"])
    few = rows.join(F.broadcast(sampled.select("person_id").distinct()), "person_id")
    return _viewed(bins, few, metric, n)


KINDS = tuple(f"{w}_{k}" for w in ("activity", "home") for k in ("cumulative", "increment"))


def payload_of_lists(curve: DataFrame, sampled: DataFrame, metric: str | None = None, n: int = 288) -> DataFrame:
    """``payload`` of curves (person_id, increment, home_increment, groups) with a list of n bins a person, as ``curves`` gives them when listed.

    Only the lists of increments are staged; tasks count the places of all bins for each group by numpy, so no row a bin is made or shuffled.
    """
    keys = ["cohort", "grp"]
    once = curve.filter("groups is not null").select("person_id", "groups", F.col("increment").alias("activity_increment"), "home_increment")
    once = staged(once, "curves")
    running = {f"{w}_cumulative": f"{w}_increment" for w in ("activity", "home")}
    long = summarise_lists(once, list(KINDS), n, {"median": 0.5}, running, "groups")
    hours = {"cumulative": (F.col("bin_index") + 1) * (24.0 / n), "increment": F.lit(24.0 / n)}
    per = {c: hours[c.split("_")[1]] if metric_name(metric) == "twac" else F.lit(1.0) for c in KINDS}
    bins = long.groupBy(*keys, "bin_index").agg(*[F.max(F.when(F.col("column") == c, F.col(f))).alias(f"{f}_{c}") for c in KINDS for f in ("mean", "median")])
    bins = bins.withColumns({f"{f}_{c}": F.col(f"{f}_{c}") / per[c] for c in KINDS for f in ("mean", "median")})
    persons = once.select(F.explode("groups").alias("_g")).groupBy("_g.cohort", "_g.grp").agg(F.count(F.lit(1)).alias("_n"))
    few = once.join(F.broadcast(sampled.select("person_id").distinct()), "person_id")
    few = few.select("person_id", "groups", F.posexplode(F.arrays_zip("activity_increment", "home_increment")).alias("bin_index", "_z"))
    so_far = Window.partitionBy("person_id").orderBy("bin_index").rowsBetween(Window.unboundedPreceding, 0)
    few = few.select("person_id", "groups", "bin_index", *[(F.sum(f"_z.{i}").over(so_far) / per[c]).alias(c) for c, i in running.items()])
    few = few.withColumn("_g", F.explode("groups")).select("person_id", "_g.cohort", "_g.grp", "bin_index", *running)
    return _viewed(bins.join(persons, keys), few, metric, n)


def _viewed(bins: DataFrame, few: DataFrame, metric: str | None, n: int) -> DataFrame:
    """The rows of ``payload`` of bins (cohort, grp, bin_index, means and medians, _n) and the sampled persons' rows (person_id, cohort, grp, bin_index, cumulatives)."""
    keys = ["cohort", "grp"]
    names = [f"{name}_{k}" for k in KINDS for name in ("mean", "median")]
    lists = bins.groupBy(*keys).agg(F.max("_n").alias("persons"), F.array_sort(F.collect_list(F.struct("bin_index", *names))).alias("_l"))
    points = [F.concat(F.array(F.lit(0.0)), F.col(f"_l.{c}")).alias(c) for c in names]
    curve = F.array_sort(F.collect_list(F.struct("bin_index", "activity_cumulative", "home_cumulative")))
    few = few.groupBy(*keys, "person_id").agg(curve.alias("_c"))
    few = few.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("person_id", F.col("_c.activity_cumulative").alias("activity"), F.col("_c.home_cumulative").alias("home")))).alias("sample_curves"))
    name = metric_name(metric)
    meta = F.struct(F.lit(name).alias("metric"), F.lit(metric_units(name)).alias("units"), F.col("persons"), F.lit(1440 // n).alias("bin_minutes"))
    every = lists.join(few, keys, "left")
    return every.select(*keys, F.transform(F.sequence(F.lit(0), F.lit(n)), lambda k: k * (24.0 / n)).alias("time_points"), *points, F.coalesce("sample_curves", F.array()).alias("sample_curves"), meta.alias("metadata"))


def first_origin(rows: DataFrame) -> DataFrame:
    """Each person's first origin row that has a place."""
    return rows.filter("location_type = 'origin' and lon is not null and lat is not null").groupBy("person_id").agg(F.min_by(F.struct("lon", "lat", "concentration"), F.struct("start_s", "seq")).alias("h")).select("person_id", "h.*")


def compare(total: DataFrame, home: DataFrame | None, fallback: float) -> DataFrame:
    """(person_id, activity, home, delta, ratio): home is (person_id, home), or None where total has it; persons without it get the fallback."""
    both = total if home is None else total.join(home.select("person_id", "home"), "person_id", "left")
    out = both.select("person_id", F.col("total_exposure").alias("activity"), F.coalesce("home", F.lit(fallback)).alias("home"))
    return out.withColumns({"delta": F.col("activity") - F.col("home"), "ratio": F.when(F.col("home") > 0, F.col("activity") / F.col("home"))})


def home_curves(homes: DataFrame, near: DataFrame, factors: DataFrame, slots: list[int], n: int = 288) -> DataFrame:
    """(person_id, bin_index, home_increment, home_cumulative): the field at home in n bins of the day times the home factor; nulls count as 0.

    homes: (person_id, lon, lat); near: (lon, lat, slot, mid) of each home and slot.
    """
    from .field import nearest_slot

    minutes, hours = 1440 // n, 24.0 / n
    bins = homes.withColumn("bin_index", F.explode(F.sequence(F.lit(0), F.lit(n - 1)))).withColumn("slot", nearest_slot(F.col("bin_index") * minutes, slots))
    rows = bins.join(near, ["lon", "lat", "slot"], "left").join(factors, "person_id", "left")
    rows = rows.withColumn("home_increment", F.coalesce(F.col("mid") * F.coalesce(F.col("home_pen") * F.col("home_prox"), F.lit(1.0)) * hours, F.lit(0.0)))
    w = Window.partitionBy("person_id").orderBy("bin_index").rowsBetween(Window.unboundedPreceding, 0)
    return rows.select("person_id", "bin_index", "home_increment", F.sum("home_increment").over(w).alias("home_cumulative"))
