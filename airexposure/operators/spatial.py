"""Polygons, bounding boxes and thinning of grids."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .distribution import percentiles
from .staging import staged

METRES_PER_DEGREE = 111_320.0


def edges(vertices: DataFrame) -> DataFrame:
    """(ring, x1, y1, x2, y2) of vertices (ring, pos, lon, lat); the last vertex of a ring meets its first."""
    w = Window.partitionBy("ring").orderBy("pos")
    following = lambda c: F.coalesce(F.lead(c).over(w), F.first(c).over(w))
    return vertices.select("ring", F.col("lon").alias("x1"), F.col("lat").alias("y1"), following("lon").alias("x2"), following("lat").alias("y2"))


def bbox(points: DataFrame, *keys: str) -> DataFrame:
    """West, east, south and north of the points of each key."""
    return points.groupBy(*keys).agg(F.min("lon").alias("west"), F.max("lon").alias("east"), F.min("lat").alias("south"), F.max("lat").alias("north"))


def clip(points: DataFrame, rings: DataFrame, band: float) -> DataFrame:
    """The points inside any ring by the even-odd rule; holes are not cut out, points without a place go.

    rings: edges as ``edges`` gives them. Points and edges meet by an equi-join on latitude bands of ``band`` degrees, in
    which only edges that cross a point's latitude can count; only the four numbers of the bounding box reach the driver.
    """
    box = rings.agg(F.min(F.least("x1", "x2")), F.max(F.greatest("x1", "x2")), F.min(F.least("y1", "y2")), F.max(F.greatest("y1", "y2"))).head()
    if box[0] is None:
        return points.limit(0)
    near = points.filter(F.col("lon").between(box[0], box[1]) & F.col("lat").between(box[2], box[3]))
    floor = lambda c: F.floor(c / band).cast("long")
    at = near.select("lon", "lat").distinct().withColumn("_band", floor(F.col("lat")))
    spread = rings.filter("y1 <> y2").withColumn("_band", F.explode(F.sequence(floor(F.least("y1", "y2")), floor(F.greatest("y1", "y2")))))
    crosses = (F.col("y1") > F.col("lat")) != (F.col("y2") > F.col("lat"))
    left_of = F.col("lon") < (F.col("x2") - F.col("x1")) * (F.col("lat") - F.col("y1")) / (F.col("y2") - F.col("y1")) + F.col("x1")
    odd = at.join(spread, "_band").filter(crosses & left_of).groupBy("ring", "lon", "lat").agg(F.count(F.lit(1)).alias("_n")).filter("_n % 2 = 1")
    return near.join(odd.select("lon", "lat").distinct(), ["lon", "lat"], "left_semi")


def ranked_lines(points: DataFrame, axis: str) -> DataFrame:
    """(axis, _i, _gap): the distinct values of an axis, their ranks from 0 and their distances to the value before.

    Values are dealt into ranges and numbered within them; what comes before a range follows from the ranges' counts and last values.
    """
    values = points.select(axis).filter(F.col(axis).isNotNull()).distinct().repartitionByRange(axis).sortWithinPartitions(axis)
    # the number holds the range in its upper bits and the place within it in the lower 33
    rows = staged(values.withColumn("_m", F.monotonically_increasing_id()), "lines")
    rows = rows.select(axis, F.shiftright("_m", 33).alias("_part"), (F.col("_m") % (1 << 33)).alias("_nth"))
    parts = rows.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"), F.max(axis).alias("_end"))
    order = Window.orderBy("_part")  # of ranges, as many as there are shuffle partitions
    before = parts.select("_part", (F.sum("_n").over(order) - F.col("_n")).alias("_start"), F.lag("_end").over(order).alias("_last"))
    out = rows.join(F.broadcast(before), "_part")
    previous = F.coalesce(F.lag(axis).over(Window.partitionBy("_part").orderBy("_nth")), "_last")
    return out.select(axis, (F.col("_start") + F.col("_nth")).alias("_i"), (F.col(axis) - previous).alias("_gap"))


def thin(points: DataFrame, metres: float) -> DataFrame:
    """Every n-th grid line each way, n being the target spacing over the median spacing of lines, rounded, at least 1."""
    middle, grid = F.radians(F.lit(points.agg(F.avg("lat")).head()[0] or 0.0)), points
    for axis, scale in (("lon", F.cos(middle) * METRES_PER_DEGREE), ("lat", F.lit(METRES_PER_DEGREE))):
        lines = ranked_lines(grid, axis)
        middle_gap = percentiles(lines, [], "_gap", {"gap": 0.5}).agg(F.max("gap").alias("gap"))  # null where there is one line at most
        stride = middle_gap.select(F.greatest(F.lit(1), F.floor(F.coalesce(F.lit(metres) / (F.col("gap") * scale), F.lit(1.0)) + 0.5).cast("int")).alias("_stride"))
        kept = lines.join(F.broadcast(stride)).filter("_i % _stride = 0").select(axis)
        points = points.join(kept, axis, "left_semi")
    return points


def grid_values(grid: DataFrame, nodata: float = 65_535.0, positive: bool = False) -> DataFrame:
    """Rows of a grid (raw) with a finite value that is not the mark for none; ``positive`` drops those up to 0 too."""
    raw = F.col("raw").cast("double")
    ok = raw.isNotNull() & ~F.isnan(raw) & (F.abs(raw) < float("inf")) & (raw != nodata)
    return grid.filter(ok & (raw > 0) if positive else ok).withColumn("value", raw).drop("raw")


#: Cities whose names have more than one word.
CITIES = ["san francisco", "san jose", "san diego", "san antonio", "los angeles", "las vegas", "new york", "st louis", "salt lake city", "virginia beach", "grand rapids", "kansas city"]


def city_words(slug: Column) -> Column:
    """The city's words at the head of a slug of words joined by hyphens: two or three of a known city, else one."""
    words = F.split(slug, "-")
    head = lambda n: F.concat_ws(" ", F.slice(words, 1, n))
    return F.when(head(2).isin(CITIES), head(2)).when(head(3).isin(CITIES), head(3)).otherwise(head(1))


def city_key(slug: Column) -> Column:
    return F.translate(city_words(slug), " ", "_")


def city_folder(slug: Column) -> Column:
    return F.translate(F.initcap(city_words(slug)), " ", "")
