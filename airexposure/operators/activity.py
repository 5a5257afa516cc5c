"""Cleaning of trip cells and person-complete rejection."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Phrases that stand for a missing place.
SENTINELS = ["Out of Region", "Does not have work/school location", "Visitor (no home location)"]
#: Cells read as null.
NULL_TOKENS = ["", "nan", "none", "null", "na", "n/a", "inf", "-inf"]
#: Hours by which a day may differ from 24.
TOLERANCE = 0.1


def clean_text(c: Column) -> Column:
    """Sentinel phrases inside the cell become nan."""
    return F.regexp_replace(c, "|".join(p.replace("(", r"\(").replace(")", r"\)") for p in SENTINELS), "nan")


def clean_number(c: Column) -> Column:
    """Trimmed cell as double; null tokens and text that is no number become null."""
    text = F.trim(clean_text(c))
    number = F.when(text.rlike(r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$"), text)
    return F.when(~F.lower(text).isin(NULL_TOKENS), number).try_cast("double")


def seconds_of_day(c: Column) -> Column:
    """H:MM:SS to seconds; anything else to null."""
    head = F.substring(c, 1, 8)
    part = lambda k: F.regexp_extract(head, r"^([0-9]{1,2}):([0-9]{1,2}):([0-9]{1,2})$", k).try_cast("int")
    h, m, s = part(1), part(2), part(3)
    return F.when((h < 24) & (m < 60) & (s < 60), h * 3600 + m * 60 + s)


def outside(lon: Column, lat: Column, box=(-180.0, 180.0, -90.0, 90.0)) -> Column:
    """Missing or not in the inclusive box."""
    return F.coalesce(~(lon.between(box[0], box[1]) & lat.between(box[2], box[3])), F.lit(True))


def bbox_audit(trips: DataFrame, places: list[str], box, order: str | None = None) -> DataFrame:
    """Per person: for each place whether any trip has it outside the box, with ``order`` its coordinates on the first trip, and the status."""
    flags = [F.bool_or(outside(F.col(f"{p}_lon"), F.col(f"{p}_lat"), box)).alias(f"{p}_outside") for p in places]
    seen = [F.min_by(c, order).alias(f"first_{c}") for p in places for c in (f"{p}_lon", f"{p}_lat")] if order else []
    out = trips.groupBy("person_id").agg(*flags, *seen)
    any_ = F.lit(False)
    for p in places:
        any_ = any_ | F.col(f"{p}_outside")
    return out.withColumn("status", F.when(any_, "kicked_out").otherwise("retained"))


def exclude_outside(trips: DataFrame, places: list[str], box) -> DataFrame:
    """Trips of persons none of whose places ever is outside."""
    kept = bbox_audit(trips, places, box).filter("status = 'retained'").select("person_id")
    return trips.join(kept, "person_id", "left_semi")


def with_day(stays: DataFrame) -> DataFrame:
    """stays with their person's total_hours and number of trips n. Partitioned by person as the stays are, this moves no rows."""
    w = Window.partitionBy("person_id")
    return stays.withColumns({"total_hours": F.sum("duration_hours").over(w), "n": F.count_if(F.col("location_type") == "travel").over(w)})


def whole_days(stays: DataFrame, tolerance: float = TOLERANCE) -> DataFrame:
    """Stays of persons whose durations add up to 24 hours."""
    return with_day(stays).filter(F.abs(F.col("total_hours") - 24) <= tolerance).drop("total_hours", "n")


def rejections(stays: DataFrame, missing: DataFrame, tolerance: float = TOLERANCE) -> DataFrame:
    """(person_id, reason, total_hours, n): persons with missing places, else with days that don't add up to 24 hours."""
    hours = stays.groupBy("person_id").agg(F.sum("duration_hours").alias("total_hours"), F.count_if(F.col("location_type") == "travel").alias("n"))
    late = hours.filter(F.abs(F.col("total_hours") - 24) > tolerance).withColumn("reason", F.lit("time_mismatch"))
    bad = missing.select("person_id", F.lit("nan_coords_or_non_numeric").alias("reason"), F.lit(None).cast("double").alias("total_hours"), F.lit(None).cast("long").alias("n")).distinct()
    return bad.unionByName(late.join(bad, "person_id", "left_anti").select("person_id", "reason", "total_hours", "n"))


#: The cells of a trip that are numbers.
NUMBERS = [f"{p}_{x}" for p in ("orig", "dest", "home", "work") for x in ("lon", "lat")] + ["declared_minutes", "distance_miles", "age", "individual_income", "household_income", "household_size"]
PLACES = ["orig", "dest", "home"]


def cleaned(raw: DataFrame) -> DataFrame:
    """Trips as delivered with numbers for their numeric cells, sentinels gone from all others, and start_s and end_s of the times.

    Columns that are not there are left out.
    """
    numbers = {c: clean_number(F.col(c)) for c in NUMBERS if c in raw.columns}
    texts = {c: clean_text(F.col(c)) for c, t in raw.dtypes if t == "string" and c not in numbers}
    times = {f"{p}_s": seconds_of_day(F.col(f"{p}_time")) for p in ("start", "end") if f"{p}_time" in raw.columns}
    return raw.withColumns({**texts, **numbers, **times})


def usable(trips: DataFrame, box=(-180.0, 180.0, -90.0, 90.0)) -> DataFrame:
    """Cleaned trips with readable times of persons all of whose places are known and inside the box, decided over all of a person's trips."""
    w = Window.partitionBy("person_id")
    bad = F.lit(False)
    for p in PLACES:
        bad = bad | outside(F.col(f"{p}_lon"), F.col(f"{p}_lat"), box)
    marked = trips.withColumn("_bad", F.bool_or(bad).over(w)).filter("not _bad").drop("_bad")
    return marked.filter("start_s is not null and end_s is not null")


def audit_counts(trips: DataFrame, box, tolerance: float = TOLERANCE) -> DataFrame:
    """(reason, persons): kept, and dropped for each reason, of cleaned trips; the first reason that applies counts."""
    from .staypoints import stay_points

    none, far = F.lit(False), F.lit(False)
    for p in PLACES:
        lon, lat = F.col(f"{p}_lon"), F.col(f"{p}_lat")
        none, far = none | lon.isNull() | lat.isNull(), far | outside(lon, lat, box)
    each = trips.groupBy("person_id").agg(F.bool_or(none).alias("none"), F.bool_or(far).alias("far"), F.count_if(F.col("start_s").isNotNull() & F.col("end_s").isNotNull()).alias("timed"))
    hours = stay_points(trips.filter("start_s is not null and end_s is not null")).groupBy("person_id").agg(F.sum("duration_hours").alias("hours"))
    late = F.coalesce(F.abs(F.col("hours") - 24) > tolerance, F.lit(True))
    reason = F.when(F.col("none"), "nan_coords_or_non_numeric").when(F.col("far"), "outside_bbox").when(F.col("timed") == 0, "no_readable_times").when(late, "time_mismatch").otherwise("kept")
    return each.join(hours, "person_id", "left").groupBy(reason.alias("reason")).agg(F.count(F.lit(1)).alias("persons"))


#: Attributes of a person that trips carry.
ATTRIBUTES = ["age", "individual_income", "household_income", "household_size", "race", "sex", "education", "industry", "household_id"]


def person_attributes(trips: DataFrame) -> DataFrame:
    """(person_id, attributes): the largest value of each attribute that the trips have."""
    return trips.groupBy("person_id").agg(*[F.max(c).alias(c) for c in ATTRIBUTES if c in trips.columns])


def distinct_persons(trips: DataFrame, *more: str) -> DataFrame:
    """Distinct persons, or persons with further columns, in order."""
    return trips.select("person_id", *more).distinct().orderBy("person_id", *more)


def ordered_trips(trips: DataFrame) -> DataFrame:
    """Trips by person and start."""
    return trips.orderBy("person_id", "start_s", "end_s")


def preview(rows: DataFrame, n: int, *keys: str) -> DataFrame:
    """The first n rows by the keys."""
    return rows.orderBy(*keys).limit(n)
