"""Trips to stay points, and splits of stay points in time."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

DAY_END = 86_399
#: Modes of transport by microenvironment.
VEHICLE = ["private_auto", "auto_passenger", "on_demand_auto"]
TRANSIT = ["public_transit"]
ROADSIDE = ["walking", "biking"]


def haversine_m(lon1: Column, lat1: Column, lon2: Column, lat2: Column) -> Column:
    """Great-circle distance in metres on a sphere of 6371 km."""
    a = F.sin(F.radians(lat2 - lat1) / 2) ** 2 + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.sin(F.radians(lon2 - lon1) / 2) ** 2
    return 2 * 6_371_000.0 * F.atan2(F.sqrt(a), F.sqrt(1 - a))


def stay_points(trips: DataFrame, tolerance: float | None = None) -> DataFrame:
    """The stays before, between and after each person's trips and the trips themselves; durations above zero only.

    trips: person_id, orig/dest/home lon and lat, start_s, end_s, declared_minutes, purpose, mode. One window a person.
    tolerance: only persons whose stays add up to 24 hours but for so many, summed over the trips, before stays are made of them.
    """
    w = Window.partitionBy("person_id").orderBy("start_s", "end_s", "orig_lon", "orig_lat", "dest_lon", "dest_lat")
    prev = {c: F.lag(c).over(w) for c in ("end_s", "dest_lon", "dest_lat", "purpose", "mode")}
    t = trips.select(
        "*", F.row_number().over(w).alias("_n"), F.lead("start_s").over(w).isNull().alias("_last"), *[v.alias(f"_p_{k}") for k, v in prev.items()],
        F.first("home_lon").over(w).alias("_home_lon"), F.first("home_lat").over(w).alias("_home_lat"),
    )
    none = F.lit(None).cast("double")
    c = F.col
    first = c("_n") == 1
    # what a trip gives: the stay before the first one or the gap before another, the ride, and the stay after the last one
    hours = [c("start_s") / 3600.0, (c("start_s") - c("_p_end_s")) / 3600.0, c("declared_minutes") / 60.0, (DAY_END - c("end_s")) / 3600.0]
    if tolerance is not None:
        some = [F.when(h > 0, h).otherwise(0.0) for h in (F.when(first, hours[0]).otherwise(hours[1]), hours[2], F.when(c("_last"), hours[3]))]
        day = F.sum(some[0] + some[1] + some[2]).over(Window.partitionBy("person_id"))  # rows are together already
        t = t.withColumn("_day", day).filter(F.abs(c("_day") - 24) <= tolerance)
    before = F.when(first, 0).otherwise(1)
    parts = t.withColumn("_part", F.explode(F.when(c("_last"), F.array(before, F.lit(2), F.lit(3))).otherwise(F.array(before, F.lit(2)))))

    def each(origin, gap, ride, after):
        return F.when(c("_part") == 0, origin).when(c("_part") == 1, gap).when(c("_part") == 2, ride).otherwise(after)

    ride_only = lambda v: F.when(c("_part") == 2, v).otherwise(none)
    values = {
        "seq": c("_n") * 4 + c("_part"), "location_type": each(*[F.lit(v) for v in ("origin", "origin", "travel", "destination")]),
        "lon": each(c("orig_lon"), c("_p_dest_lon"), (c("orig_lon") + c("dest_lon")) / 2, c("dest_lon")),
        "lat": each(c("orig_lat"), c("_p_dest_lat"), (c("orig_lat") + c("dest_lat")) / 2, c("dest_lat")),
        "start_s": each(F.lit(0).cast("long"), c("_p_end_s").cast("long"), c("start_s").cast("long"), c("end_s").cast("long")),
        "end_s": each(c("start_s").cast("long"), c("start_s").cast("long"), c("end_s").cast("long"), F.lit(DAY_END).cast("long")),
        "duration_hours": each(*hours),
        "activity_type": each(F.concat(F.lit("pre_"), "purpose"), F.concat(F.lit("stay_"), "_p_purpose"), F.concat(F.lit("travel_"), "purpose"), F.concat(F.lit("post_"), "purpose")),
        **{k: F.when(c("_part") == 1, c(f"_p_{k}")).otherwise(c(k)) for k in ("purpose", "mode")},
        "o_lon": ride_only(c("orig_lon")), "o_lat": ride_only(c("orig_lat")), "d_lon": ride_only(c("dest_lon")), "d_lat": ride_only(c("dest_lat")),
    }
    return parts.select("person_id", *[v.alias(k) for k, v in values.items()], c("_home_lon").alias("home_lon"), c("_home_lat").alias("home_lat")).filter("duration_hours > 0")


def with_microenvironment(stays: DataFrame, home_m: float = 100.0) -> DataFrame:
    """stays with dist_to_home_m, microenv and the rule that gave it."""
    mode, purpose = F.lower(F.trim("mode")), F.lower(F.trim("purpose"))
    travel = F.when(mode.isin(VEHICLE), "in_vehicle_on_road_private").when(mode.isin(TRANSIT), "in_vehicle_on_road_transit").when(mode.isin(ROADSIDE), "outdoor_near_road").otherwise("travel_unknown")
    away = F.when(F.col("location_type") != "travel", haversine_m(F.col("lon"), F.col("lat"), F.col("home_lon"), F.col("home_lat")))
    stay = F.when(away <= home_m, "home_indoor").when(purpose == "work", "work_indoor").when(purpose == "school", "school_indoor").otherwise("other_indoor")
    rule = F.when(F.col("location_type") == "travel", F.when(travel == "travel_unknown", "mode_unknown").otherwise("mode"))
    rule = F.coalesce(rule, F.when(away <= home_m, "home_distance").when(purpose.isin("work", "school"), "purpose").otherwise("default"))
    return stays.withColumns({"dist_to_home_m": away, "microenv": F.when(F.col("location_type") == "travel", travel).otherwise(stay), "microenv_rule": rule})


def with_outdoor_work(stays: DataFrame, persons: DataFrame) -> DataFrame:
    """stays (microenv) with p_outdoor_work: persons' (person_id, p_outdoor) on stays indoors at work, null elsewhere."""
    p = persons.groupBy("person_id").agg(F.min("p_outdoor").alias("_p"))
    return stays.join(p, "person_id", "left").withColumn("p_outdoor_work", F.when(F.col("microenv") == "work_indoor", F.col("_p"))).drop("_p")


def split_intervals(stays: DataFrame, minutes: int = 30) -> DataFrame:
    """Rows cut into pieces of ``minutes`` from their own start; duration follows from the piece; rows that don't end after they start go."""
    step = minutes * 60
    pieces = stays.filter("end_s > start_s").withColumn("piece", F.explode(F.expr(f"sequence(0L, cast(ceil((end_s - start_s) / {float(step)}D) as bigint) - 1)")))
    start = F.col("start_s") + F.col("piece") * step
    return pieces.withColumns({"start_s": start, "end_s": F.least(start + step, "end_s")}).withColumn("duration_hours", (F.col("end_s") - F.col("start_s")) / 3600.0)


def travel_halves(stays: DataFrame) -> DataFrame:
    """Travel rows become two: the first half at the origin, the second at the destination. Adds ``half`` (0, 1)."""
    middle = (F.col("start_s") + F.col("end_s")) / 2.0
    halves = F.when((F.col("location_type") == "travel") & (F.col("duration_hours") > 0), F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(None).cast("int")))
    out = stays.withColumn("half", F.explode(halves))
    split = F.col("half").isNotNull()
    return out.withColumns({
        "lon": F.when(F.col("half") == 0, F.col("o_lon")).when(F.col("half") == 1, F.col("d_lon")).otherwise(F.col("lon")),
        "lat": F.when(F.col("half") == 0, F.col("o_lat")).when(F.col("half") == 1, F.col("d_lat")).otherwise(F.col("lat")),
        "duration_hours": F.when(split, F.col("duration_hours") / 2).otherwise(F.col("duration_hours")),
        "start_s": F.when(F.col("half") == 1, middle).otherwise(F.col("start_s").cast("double")),
        "end_s": F.when(F.col("half") == 0, middle).otherwise(F.col("end_s").cast("double")),
        "half": F.coalesce("half", F.lit(0)),
    })
