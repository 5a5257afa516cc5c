"""Lookups of a pollution field in space and time."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .spatial import clip
from .staging import staged


def nearest_slot(minute: Column, slots: list[int]) -> Column:
    """The slot with the least distance from the minute of the day, the earlier one of two; a null minute counts as 0.

    slots: minutes of the day. The answers for all 1440 minutes are a constant array that rows look up.
    """
    ordered = sorted(set(slots))
    table = F.array(*[F.lit(min(ordered, key=lambda s: abs(s - m))) for m in range(1440)])
    return F.get(table, F.greatest(F.least(F.coalesce(minute, F.lit(0)), F.lit(1439)), F.lit(0)))


def _candidates(field: DataFrame, values: list[str], cell: float) -> DataFrame:
    """(_slot, _cx, _cy, _near, _sure): for each slot and cell, the field points in it and its eight neighbours.

    _sure: wherever in the cell one stands, some of them is within the cell's size, so none beyond can be nearer; that is so if
    each quarter of the cell has a point that is near enough to its farthest corner.
    """
    around = F.expr("flatten(transform(sequence(-1L, 1L), i -> transform(sequence(-1L, 1L), j -> named_struct('i', i, 'j', j))))")
    x, y = F.floor(F.col("lon") / cell), F.floor(F.col("lat") / cell)
    spread = field.select("slot", "lon", "lat", *values, F.explode(around).alias("_n"))
    point = F.struct(F.col("lon").alias("_x"), F.col("lat").alias("_y"), *values)
    lists = spread.groupBy(F.col("slot").alias("_slot"), (x + F.col("_n.i")).alias("_cx"), (y + F.col("_n.j")).alias("_cy")).agg(F.collect_list(point).alias("_near"))

    def covered(qx: float, qy: float) -> Column:
        middle_x, middle_y = (F.col("_cx") + qx) * cell, (F.col("_cy") + qy) * cell

        def close(p: Column) -> Column:
            dx, dy = F.abs(p["_x"] - middle_x) + cell / 4, F.abs(p["_y"] - middle_y) + cell / 4
            return dx * dx + dy * dy < cell * cell

        return F.exists("_near", close)

    sure = covered(0.25, 0.25) & covered(0.25, 0.75) & covered(0.75, 0.25) & covered(0.75, 0.75)
    return lists.withColumn("_sure", sure)


def nearest(rows: DataFrame, field: DataFrame, values: list[str], cell: float) -> DataFrame:
    """rows (lon, lat, slot, ...) with the values of the nearest field point of their slot and its distance; nulls where there is none.

    The field's points are dealt to their own and the eight neighbouring cells and listed by (slot, cell), so a row finds all
    candidates by one equi-join and picks the best in place. A row outside the field's box takes the cell nearest to it.
    That is exact where the best distance is at most the cell size (from where the row meets the box). The distinct
    places of all other rows meet lists of cells eight times as large, and what is left after that the whole field of their
    slot; where the cell suits the field's spacing both are empty. Ties go to the smaller lon, then lat.
    """
    box = field.agg(F.min("lon"), F.max("lon"), F.min("lat"), F.max("lat")).head()  # four numbers
    if box[0] is None:
        return rows.withColumns({**{v: F.lit(None).cast(field.schema[v].dataType) for v in values}, "distance": F.lit(None).cast("double")})
    inside_x = F.least(F.greatest(F.col("lon"), F.lit(box[0])), F.lit(box[1]))
    inside_y = F.least(F.greatest(F.col("lat"), F.lit(box[2])), F.lit(box[3]))
    beyond_x, beyond_y = F.col("lon") - inside_x, F.col("lat") - inside_y
    beyond = beyond_x * beyond_x + beyond_y * beyond_y

    def distance(x, y):
        return (F.col("lon") - x) * (F.col("lon") - x) + (F.col("lat") - y) * (F.col("lat") - y)

    def looked_up(some: DataFrame, size: float) -> DataFrame:
        at = (F.col("slot") == F.col("_slot")) & (F.floor(inside_x / size) == F.col("_cx")) & (F.floor(inside_y / size) == F.col("_cy"))
        best = F.array_min(F.transform("_near", lambda p: F.struct(distance(p["_x"], p["_y"]).alias("d2"), p["_x"].alias("_x"), p["_y"].alias("_y"), *[p[v].alias(v) for v in values])))
        out = some.join(_candidates(field, values, size), at, "left").withColumn("_b", best).drop("_slot", "_cx", "_cy", "_near")
        out = out.withColumn("_sure", F.coalesce(F.col("_sure") & (beyond == 0), F.lit(False)))
        return out.withColumn("_b", F.when(F.col("_sure") | (F.col("_b.d2") <= size**2 + beyond), F.col("_b")))

    place = ["lon", "lat", "slot"]
    first = staged(looked_up(rows, cell), "nearest")
    found = [*rows.columns, *[F.col(f"_b.{v}").alias(v) for v in values], F.sqrt("_b.d2").alias("distance")]
    open_ = first.filter("lon is not null and lat is not null and not _sure and _b is null").select(*place)
    if open_.isEmpty():
        return first.select(*found)
    rest = staged(looked_up(open_.distinct(), 8 * cell), "nearest")
    whole = rest.filter("_b is null").drop("_b").join(field.select(F.col("lon").alias("_x"), F.col("lat").alias("_y"), "slot", *values), "slot")
    last = whole.groupBy(*place).agg(F.min(F.struct(distance(F.col("_x"), F.col("_y")).alias("d2"), "_x", "_y", *values)).alias("_late"))
    late = rest.filter("_b is not null").select(*place, F.col("_b").alias("_late")).unionByName(last)
    b = F.coalesce("_b", "_late")
    return first.join(late, place, "left").withColumn("_b", b).select(*found)


MOST_LISTS = 400_000  # lists that are broadcast
LONGEST = 16  # points of a list


def _complete_lists(field: DataFrame, values: list[str], size: float, extent: tuple) -> tuple[DataFrame, int] | None:
    """(_slot, _ix, _iy, _near) of every slot and every cell that meets the extent, and how many points a list has at most; None
    where there would be too many or too long lists.

    A list holds all points that can be nearest to any place in its cell: with the point nearest to the middle at distance d and the
    cell's diagonal s, no other can be farther from the middle than d + s. Points are in order of x, then y, then values.
    """
    west, east, south, north = (math.floor(v / size) for v in extent)
    slots = field.select("slot").distinct()
    if (east - west + 1) * (north - south + 1) * slots.count() > MOST_LISTS:
        return None
    spark = field.sparkSession
    cells = slots.join(spark.range(west, east + 1).withColumnRenamed("id", "_ix")).join(spark.range(south, north + 1).withColumnRenamed("id", "_iy"))
    middles = cells.withColumns({"lon": (F.col("_ix") + 0.5) * size, "lat": (F.col("_iy") + 0.5) * size})
    middles = staged(nearest(middles, field, [], 2 * size).withColumn("_reach", (F.col("distance") + size * math.sqrt(2)) * (1 + 1e-6)), "middles")
    reach = middles.agg(F.max("_reach")).head()[0]
    around = F.expr("flatten(transform(sequence(-1L, 1L), i -> transform(sequence(-1L, 1L), j -> named_struct('i', i, 'j', j))))")
    points = field.select("slot", F.col("lon").alias("_x"), F.col("lat").alias("_y"), *values, F.explode(around).alias("_n"))
    points = points.select("slot", "_x", "_y", *values, (F.floor(F.col("_x") / reach) + F.col("_n.i")).alias("_bx"), (F.floor(F.col("_y") / reach) + F.col("_n.j")).alias("_by"))
    here = middles.withColumns({"_bx": F.floor(F.col("lon") / reach), "_by": F.floor(F.col("lat") / reach)})
    far = (F.col("lon") - F.col("_x")) * (F.col("lon") - F.col("_x")) + (F.col("lat") - F.col("_y")) * (F.col("lat") - F.col("_y"))
    met = here.join(points, ["slot", "_bx", "_by"]).filter(far <= F.col("_reach") * F.col("_reach"))
    lists = staged(met.groupBy("slot", "_ix", "_iy").agg(F.array_sort(F.collect_list(F.struct("_x", "_y", *values))).alias("_near")), "lists")
    longest = lists.agg(F.max(F.size("_near"))).head()[0]
    if longest > LONGEST:
        return None
    return lists.select(F.col("slot").alias("_slot"), "_ix", "_iy", "_near"), longest


def nearest_within(rows: DataFrame, field: DataFrame, values: list[str], cell: float, extent: tuple, at: tuple = ("lon", "lat"), prefix: str = "", only: Column | None = None) -> DataFrame:
    """``nearest`` without the distance for rows whose places all lie in the extent (west, east, south, north); others are an error.

    Since every cell of the extent has a complete list of points, one broadcast join answers all rows: they are neither written nor
    shuffled, and stay partitioned and together as they are. at: the columns of the place; prefix: of the values' new names.
    only: which rows, few of them, need an answer, others get nulls; their lists are searched as they are, since code with two lookups of
    single columns is too large to be compiled.
    """
    size = cell / 2
    made = _complete_lists(field, values, size, extent)
    lon, lat = F.col(at[0]), F.col(at[1])
    if made is None:
        moved = rows.withColumnsRenamed({"lon": "_lon", "lat": "_lat"}).withColumns({"lon": F.col({"lon": "_lon"}.get(at[0], at[0])), "lat": F.col({"lat": "_lat"}.get(at[1], at[1]))})
        found = nearest(moved, field, values, cell).drop("lon", "lat", "distance").withColumnsRenamed({v: f"{prefix}{v}" for v in values})
        if only is not None:
            found = found.withColumns({f"{prefix}{v}": F.when(only, F.col(f"{prefix}{v}")) for v in values})
        return found.withColumnsRenamed({"_lon": "lon", "_lat": "lat"}).select(*rows.columns, *[f"{prefix}{v}" for v in values])
    lists, n = made
    if only is None:
        lists = lists.select("_slot", "_ix", "_iy", *[F.get("_near", F.lit(i))[c].alias(f"{c}{i}") for i in range(n) for c in ("_x", "_y", *values)])
    inside = lon.between(extent[0], extent[1]) & lat.between(extent[2], extent[3])
    cx = F.floor(F.when(F.coalesce(inside, F.lit(True)), lon).otherwise(F.raise_error(F.lit("a place outside the extent")).cast("double")) / size)
    met = rows.join(F.broadcast(lists), (F.col("slot") == F.col("_slot")) & (cx == F.col("_ix")) & (F.floor(lat / size) == F.col("_iy")), "left")  # MOST_LISTS at most
    if only is not None:
        far = lambda p: (lon - p["_x"]) * (lon - p["_x"]) + (lat - p["_y"]) * (lat - p["_y"])
        nearest_of = F.array_min(F.transform("_near", lambda p: F.struct(far(p).alias("_d"), p["_x"].alias("_x"), p["_y"].alias("_y"), *[p[v].alias(v) for v in values])))
        met = met.withColumn("_b", F.when(only & lon.isNotNull() & lat.isNotNull(), nearest_of))
        return met.select(*[rows[c] for c in rows.columns], *[F.col(f"_b.{v}").alias(f"{prefix}{v}") for v in values])
    d2 = [(lon - F.col(f"_x{i}")) * (lon - F.col(f"_x{i}")) + (lat - F.col(f"_y{i}")) * (lat - F.col(f"_y{i}")) for i in range(n)]
    met = met.withColumns({f"_d{i}": d for i, d in enumerate(d2)})
    met = met.withColumn("_d", F.least(*[f"_d{i}" for i in range(n)]) if n > 1 else F.col("_d0"))

    def best(v: str) -> Column:
        out = F.when(F.col("_d0") == F.col("_d"), F.col(f"{v}0"))
        for i in range(1, n):
            out = out.when(F.col(f"_d{i}") == F.col("_d"), F.col(f"{v}{i}"))
        return out

    return met.select(*[rows[c] for c in rows.columns], *[best(v).alias(f"{prefix}{v}") for v in values])


def nearest_join(points: DataFrame, field: DataFrame, values: list[str], cell: float) -> DataFrame:
    """(lon, lat, slot, values, distance): each distinct point that has a place with the values of the nearest field point of its slot."""
    return nearest(points.select("lon", "lat", "slot").filter("lon is not null and lat is not null").distinct(), field, values, cell).filter("distance is not null")


def lookup(rows: DataFrame, field: DataFrame, slots: list[int], values: list[str], cell: float, static: DataFrame | None = None, extent: tuple | None = None) -> DataFrame:
    """rows (lon, lat, start_s) with slot and the field's values at their place and start time; places without one get the value of the
    static field (lon, lat, value) in all columns, else nulls. extent: (west, east, south, north) in which all places lie, if known."""
    timed = rows.withColumn("slot", nearest_slot(F.floor(F.col("start_s") / 60).cast("int"), slots))
    placed = nearest(timed, field, values, cell).drop("distance") if extent is None else nearest_within(timed, field, values, cell, extent)
    if static is None:
        return placed
    fixed = nearest(placed.withColumnRenamed("slot", "_own").withColumn("slot", F.lit(0)), static.select("lon", "lat", F.col("value").alias("_static"), F.lit(0).alias("slot")), ["_static"], cell)
    return fixed.withColumns({v: F.coalesce(v, "_static") for v in values}).drop("slot", "_static", "distance").withColumnRenamed("_own", "slot")


def static_field(raster: DataFrame, rings: DataFrame | None = None, band: float = 0.01) -> DataFrame:
    """(lon, lat, value) of the cells with a value above 0 inside any ring, of all such cells without rings."""
    cells = raster.filter(F.col("value").isNotNull() & ~F.isnan("value") & (F.col("value") > 0)).select("lon", "lat", "value")
    return cells if rings is None else clip(cells, rings, band)
