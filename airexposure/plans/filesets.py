"""Registered round trips: tables written in the domain's file formats, read back by the library's readers, and used."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..operators import activity, cohorts, diagnostics, distribution, exposure, field, holdout, randoms, workoutdoor
from ..operators.staging import staged, staging_folder
from ..sources import adapters as A
from ..sources import files
from . import catalog as C
from . import extended as X
from .catalog import _r, query, rounded


def _place(spark, name: str) -> str:
    """A new folder for files of a query."""
    return f"{staging_folder(spark)}/{name}-{uuid.uuid4().hex}"


_CELLS = ("orig_lon", "orig_lat", "dest_lon", "dest_lat", "home_lon", "home_lat", "declared_minutes")


@query(f"""SELECT person_id, CAST(rn AS VARCHAR) rn, {", ".join(C._NUMBER.format(c) for c in _CELLS)}, {C._SECONDS.format("start")}, {C._SECONDS.format("end")},
  purpose, CASE WHEN k % 211 = 0 THEN 'nan (far)' ELSE mode END mode FROM (SELECT r.*, t.k FROM ({A.RAW_TRIPS}) r JOIN ({A.TRIPS}) t USING (person_id, rn)) q""")
def file_trips(spark, d):
    """Trips as delivered, in CSV, with marks for missing places in cells of numbers and of text."""
    raw = A.frame(spark, d, A.RAW_TRIPS)
    mark = F.when(F.col("dest_lon") == activity.SENTINELS[0], F.concat(F.lit(activity.SENTINELS[1]), F.lit(" (far)"))).otherwise(F.col("mode"))
    path = _place(spark, "trips")
    files.save_trips(raw.withColumn("mode", mark), path)
    rows = activity.cleaned(files.trips_csv(spark, path))
    return rows.select("person_id", "rn", *_CELLS, "start_s", "end_s", "purpose", "mode")


_BAD = "CAST(floor(mid * 10) AS INTEGER) % 37 = 0"


@query(f"SELECT lon, lat, slot, mid, low, high FROM ({A.FIELD}) f WHERE NOT ({_BAD}) AND NOT (slot = 60 AND lon < -71.2e0)")
def file_field(spark, d):
    """A field with quantiles in CSV; rows with an unreadable time or without a value go."""
    path = _place(spark, "field")
    rows = A.frame(spark, d, A.FIELD)
    files.save_field(rows.withColumn("mid", F.when(~((F.col("slot") == 60) & (F.col("lon") < -71.2)), F.col("mid"))), f"{path}/good", {"mid": "pm25_p50", "low": "pm25_p05", "high": "pm25_p95"})
    text = spark.read.option("header", True).csv(f"{path}/good")
    mid = F.col("pm25_p50").cast("double")
    spoilt = text.withColumn("timestamp_utc", F.when(F.coalesce(F.floor(mid * 10) % 37 == 0, F.lit(False)), "no time").otherwise(F.col("timestamp_utc")))
    files.save_csv(spoilt.withColumnsRenamed({"lon": "longitude", "lat": "latitude", "timestamp_utc": "timestamp"}), f"{path}/used")
    return files.field_csv(spark, f"{path}/used", low="pm25_p05", high="pm25_p95").select("lon", "lat", "slot", "mid", "low", "high")


@query(f"{C.sql_detailed()} SELECT person_id, CAST(seq AS BIGINT) seq, CAST(piece AS BIGINT) piece, half, round(exposure, 9) exposure, CASE WHEN piece > 0 THEN round(c, 9) END concentration FROM detailed")
def file_parquet_runs(spark, d):
    """Detailed rows of two runs, one of which has a column more, and their persons' totals, as Parquet sets."""
    rows = staged(C.detailed(spark, d).select("person_id", "seq", "piece", "half", "start_s", "exposure", "concentration", "duration_hours"), "details")
    path = _place(spark, "runs")
    for name, some in (("a", rows.filter("piece = 0").drop("concentration")), ("b", rows.filter("piece > 0"))):
        files.exposure_parquet(some, exposure.totals(some), f"{path}/{name}")
    both = files.parquet_set(spark, f"{path}/a/detailed", f"{path}/b/detailed")
    return rounded(both.select("person_id", "seq", "piece", "half", "exposure", "concentration"))


_COUNTS = f"""WITH {C.SQL_ASSIGN}, c AS (
SELECT 'onet' step, 'rows' metric, count(*) n FROM onet UNION ALL SELECT 'onet', 'bad_soc', 0 UNION ALL SELECT 'onet', 'no_value', count(*) FILTER (WHERE value IS NULL) FROM onet
UNION ALL SELECT 'oews', 'rows', count(*) FROM oews UNION ALL SELECT 'oews', 'not_detailed', count(*) FILTER (WHERE o_group <> 'detailed') FROM oews
UNION ALL SELECT 'oews', 'no_employment', count(*) FILTER (WHERE tot_emp = '**') FROM oews UNION ALL SELECT 'shares', 'rows', count(*) FROM shares UNION ALL SELECT 'weights', 'rows', count(*) FROM emp
UNION ALL SELECT 'match', 'matched', count(*) FROM emp WHERE soc IN (SELECT soc FROM shares) UNION ALL SELECT 'match', 'unmatched', count(*) FROM emp WHERE soc NOT IN (SELECT soc FROM shares)
UNION ALL SELECT 'assign', reason, count(*) FROM assigned GROUP BY reason) SELECT step, metric, n AS value FROM c"""


def _outdoor(spark, d):
    """The outdoor-work model from its two CSV files, which begin with a byte-order mark."""
    path = _place(spark, "occupations")
    files.save_occupations(A.frame(spark, d, A.ONET), f"{path}/onet", files.ONET_COLUMNS)
    files.save_occupations(A.frame(spark, d, A.OEWS), f"{path}/oews", files.OEWS_COLUMNS)
    onet, oews = files.onet_csv(spark, f"{path}/onet"), files.oews_csv(spark, f"{path}/oews")
    return workoutdoor.work_outdoor(A.frame(spark, d, A.PERSONS), onet, oews, ["0", "1"])


@query(_COUNTS)
def file_outdoor_missingness(spark, d):
    return _outdoor(spark, d)[2]


_LABELS = [("11", "Farming"), ("23", "Construction"), ("31-33", "Manufacturing"), ("44-45", "Retail trade"), ("62", "Health care")]


@query(f"WITH {C.SQL_ASSIGN} SELECT person_id, a.grp, l.label, round(p_outdoor, 9) p_outdoor FROM assigned a LEFT JOIN (VALUES {', '.join(f"('{c.replace('-', '_')}', '{n}')" for c, n in _LABELS)}) l(grp, label) ON a.grp = l.grp")
def file_sector_labels(spark, d):
    """Persons with their probability to work outdoors and the label of their sector, all from files."""
    path = _place(spark, "sectors")
    files.save_csv(spark.createDataFrame(_LABELS, "Sector string, Name string"), path)
    return rounded(workoutdoor.with_label(_outdoor(spark, d)[0].select("person_id", "grp", "p_outdoor"), files.sector_labels(spark, path, "Sector", "Name")))


@query(f"WITH {C.SQL_STEP}, fe AS ({X.FEATURES}) SELECT CAST(sensor_index AS INTEGER) sensor_index, name, region msa_slug, round(lon, 9) longitude, round(lat, 9) latitude FROM fe WHERE (region, sensor_index) IN (SELECT region, sensor_index FROM r3)")
def file_sensors_geojson(spark, d):
    """Sensors with readings as one FeatureCollection in several parts."""
    path = _place(spark, "sensors")
    files.feature_collection(X.sensor_geojson(spark, d), path)
    return rounded(files.sensors_geojson(spark, path, by_line=True))


@query(f"WITH {C.SQL_READ} SELECT region msa_slug, strftime(datetime_utc, '%Y-%m') AS \"month\", count(*) n, count(DISTINCT sensor_index) sensors, CAST(floor(epoch(max(datetime_utc))) AS BIGINT) last_s FROM r1 GROUP BY 1, 2")
def file_readings(spark, d):
    """Cleaned readings in folders of regions and months, with times as seconds."""
    rows = C.sensors.in_range(A.frame(spark, d, A.READINGS))
    rows = rows.select(F.col("region").alias("msa_slug"), F.date_format("datetime_utc", "yyyy-MM").alias("month"), "sensor_index", "pm", F.expr("timestampdiff(SECOND, timestamp_ntz'1970-01-01 00:00:00', datetime_utc)").alias("time_stamp"))
    path = _place(spark, "readings")
    files.save_readings(rows, path)
    back = files.utc_from_epoch(files.cleaned_readings(spark, path, files="part-*"))
    return back.groupBy("msa_slug", "month").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("sensor_index").alias("sensors"), F.unix_seconds(F.max("datetime_utc")).alias("last_s"))


@query(f"WITH {C.SQL_READ}, h AS ({X._CHOSEN}) SELECT sensor_index, sensor_index IN (SELECT sensor_index FROM h) held, count(*) n, round(avg(pm), 9) mean_pm FROM r1 GROUP BY 1")
def file_holdout_list(spark, d):
    """The list of held-out sensors as a text file, and the readings that it parts."""
    path = _place(spark, "holdouts")
    X.holdout_choice(spark, d).select(F.col("sensor_index").cast("string")).write.text(path)
    train, held = holdout.split(C.sensors.in_range(A.frame(spark, d, A.READINGS)), files.holdout_list(spark, path))
    rows = train.withColumn("held", F.lit(False)).unionByName(held.withColumn("held", F.lit(True)))
    return rounded(rows.groupBy("sensor_index", "held").agg(F.count(F.lit(1)).alias("n"), F.avg("pm").alias("mean_pm")))


@query(f"WITH {C.SQL_SURFACES} SELECT round(lon, 9) lon, round(lat, 9) lat, round(a90 - b90, 9) d90, round(a50 - b50, 9) d50 FROM ww")
def file_surfaces(spark, d):
    """Quantile surfaces of several bins in one CSV set, of which two are compared."""
    path = _place(spark, "surfaces")
    a, b = C.surfaces(spark, d)
    files.save_csv(a.withColumn("k", F.lit("mean")).unionByName(b.withColumn("k", F.lit("3"))), path)
    rows = spark.read.option("header", True).csv(path)
    rows = rows.select("k", *[F.col(c).cast("double").alias(c) for c in rows.columns if c != "k"])
    mean, third = (files.surface_quantiles(rows, k).drop("k") for k in ("mean", "3"))
    both = mean.alias("a").join(third.alias("b"), "l_suppkey")  # several suppliers may share a place
    return rounded(both.select("a.lon", "a.lat", F.expr("(a.p95 - a.p05) - (b.p95 - b.p05) d90"), F.expr("(a.p75 - a.p25) - (b.p75 - b.p25) d50")))


_COMPARED = "round(activity, 9) activity, round(home, 9) home, round(delta, 7) delta, round(ratio, 9) ratio"


@query(f"{C.SQL_COMPARE}, sums AS (SELECT person_id, count(*) details, sum(exposure) s FROM detailed GROUP BY person_id) SELECT person_id, {_COMPARED}, details, round(s, 7) exposure FROM compared JOIN sums USING (person_id)")
def file_results(spark, d):
    """Comparison and detailed rows as CSV."""
    day = staged(C.stays(spark, d), "stays")
    rows = staged(C.detailed(spark, d, of=day).select("person_id", "start_s", "duration_hours", "exposure"), "details")
    path = _place(spark, "results")
    files.save_results(exposure.compare(exposure.totals(rows), C.home_day(spark, d, day), C.FALLBACK), rows, path)
    back = lambda name: spark.read.option("header", True).csv(f"{path}/{name}")
    number = lambda *names: [F.col(c).cast("double").alias(c) for c in names]
    sums = back("detailed").select("person_id", *number("exposure")).groupBy("person_id").agg(F.count(F.lit(1)).alias("details"), _r(F.sum("exposure"), 7).alias("exposure"))
    persons = back("comparison").select("person_id", *number("activity", "home", "delta", "ratio")).withColumn("delta", _r("delta", 7))
    return rounded(persons.join(sums, "person_id"))


@query(f"{C.SQL_COMPARE} SELECT person_id, round(activity, 9) activity, round(home, 9) home, round(coalesce(ratio, 0e0), 9) ratio, 'cumulative' metric, 'ug/m3*h' units FROM compared")
def file_person_json(spark, d):
    """Each person's comparison as a JSON line."""
    path = _place(spark, "persons")
    files.person_json(C.compared(spark, d)).select("person_id", F.col("value").alias("json")).write.json(path)
    schema = "summary struct<activity: double, home: double, ratio: double>, metadata struct<metric: string, units: string>"
    rows = spark.read.schema("person_id string, json string").json(path).select("person_id", F.from_json("json", schema).alias("j"))
    return rounded(rows.select("person_id", "j.summary.*", "j.metadata.*"))


_HOME = f"{C.SQL_HOME_DAY}, {X.SQL_HOME_CURVES.removeprefix(C.SQL_HOME_DAY + ', ')}"
_ONE = {b: f"SELECT person_id, bin_index, increment inc_{b}, cumulative cum_{b} FROM ({C.sql_detailed(band=b)}, {C.SQL_CURVES} SELECT * FROM curves) {b}_q" for b in ("mid", "low", "high")}


@query(f"""WITH base AS (SELECT * FROM ({C.sql_detailed()}, {C.SQL_CURVES}, {_HOME} SELECT c.person_id, c.bin_index, increment, cumulative, home_increment, home_cumulative FROM curves c JOIN home_curves USING (person_id, bin_index)) q),
lo AS ({_ONE['low']}), hi AS ({_ONE['high']}), pp AS ({A.PERSONS})
SELECT person_id, CAST(bin_index AS INTEGER) bin_index, industry, round(cumulative, 7) activity_cumulative, round(increment, 8) activity_increment, round(home_cumulative, 7) home_cumulative, round(home_increment, 8) home_increment,
  round(cumulative - home_cumulative, 7) + 0e0 delta_cumulative, round(increment - home_increment, 8) + 0e0 delta_increment, round(cum_low, 7) activity_cumulative_low, round(inc_low, 8) activity_increment_low, round(cum_high, 7) activity_cumulative_high, round(inc_high, 8) activity_increment_high
FROM base JOIN lo USING (person_id, bin_index) JOIN hi USING (person_id, bin_index) LEFT JOIN pp USING (person_id)""")
def file_timeseries(spark, d):
    """The full time series of each person, with bands and industry, as Parquet."""
    suffixes = ("", "_low", "_high")
    people = A.frame(spark, d, A.PERSONS).select("person_id", "industry")
    series = exposure.timeseries(X.both_curves(spark, d, suffixes, people), suffixes=suffixes)
    kept = [f"{w}_{k}{s}" for s in suffixes for w in (("activity", "home", "delta") if not s else ("activity",)) for k in ("cumulative", "increment")]
    path = _place(spark, "series")
    files.timeseries_parquet(series.select("person_id", "bin_index", "industry", *kept), path, ordered=True)
    rows = spark.read.parquet(path)
    return rows.select("person_id", "bin_index", "industry", *[(_r(c, 7 if "cumulative" in c else 8) + (0.0 if c.startswith("delta") else F.lit(0.0))).alias(c) for c in kept])


_STATS = ("n", "mean", "median", "std", "min", "max", "p25", "p75")
_FLAT = ", ".join(f"max(CASE WHEN metric = '{m}' THEN {'n' if s == 'n' else f'round({chr(34)}{s}{chr(34)}, 7)'} END) {m}_{s}" for m in ("activity", "home", "ratio") for s in _STATS)


@query(f"{C.SQL_COMPARE}, {C.SQL_COHORTS}, {C._LONG}, st AS ({C._sql_described('long', 'cohort, grp, metric', 'v', 12)}) SELECT cohort, grp, max(n) population, {_FLAT} FROM st GROUP BY cohort, grp")
def file_cohort_json(spark, d):
    """Statistics of each cohort as nested JSON."""
    rows = C.compared(spark, d).join(C.members(spark, d), "person_id")
    stats = distribution.described(rows, ["cohort", "grp"], ["activity", "home", "ratio"]).withColumnRenamed("column", "metric")
    path = _place(spark, "cohorts")
    files.save_json(cohorts.statistics_json(stats, "activity", "home", "ratio"), path)
    back = spark.read.json(path)
    return back.select("cohort", "grp", "population", *[(F.col(f"{m}.{s}") if s == "n" else _r(F.col(f"{m}.{s}").cast("double"), 7)).alias(f"{m}_{s}") for m in ("activity", "home", "ratio") for s in _STATS])


@query(C.ORACLES["audit_counts"].replace("count(*) persons", "CAST(count(*) AS VARCHAR) persons"))
def file_audits(spark, d):
    """Audits as CSV: places, rejections, missing attributes, of which the counts come back."""
    path = _place(spark, "audits")
    files.save_audits(path, persons=C.audit_counts(spark, d), places=C.bbox_audit(spark, d), missingness=C.outdoor_missingness(spark, d))
    return spark.read.option("header", True).csv(f"{path}/persons")


_POINT = "CAST(bin_index AS INTEGER) + 1 AS point"
_LINES = ", ".join(f"round({f}({w}), 7) {n}_{k}" for k, w in (("activity_cumulative", "cumulative"), ("activity_increment", "increment"), ("home_cumulative", "home_cumulative"), ("home_increment", "home_increment")) for n, f in (("mean", "avg"), ("median", "median")))


@query(f"{C.sql_detailed()}, {C.SQL_CURVES}, {_HOME}, {C.SQL_COHORTS}, every AS (SELECT * FROM members UNION ALL SELECT person_id, 'all', 'all' FROM people2) SELECT cohort, grp, {_POINT}, {_LINES} FROM curves JOIN home_curves USING (person_id, bin_index) JOIN every USING (person_id) GROUP BY cohort, grp, bin_index")
def file_payload(spark, d):
    """What a viewer shows of each cohort, and of all persons, as JSON in a folder a cohort; the points after the first."""
    people = A.frame(spark, d, A.PERSONS)
    groups = cohorts.with_everyone(C.members(spark, d), people)
    curve = X.both_curves(spark, d, carried=cohorts.listed(groups), listed=True, kinds=("increment",))
    few = randoms.sample(people.select("person_id"), 20, "person_id")
    path = _place(spark, "payload")
    files.save_groups(exposure.payload_of_lists(curve, few), path, "cohort", "grp")
    back = spark.read.option("basePath", path).json(f"{path}/*/*")
    names = [f"{n}_{w}_{k}" for w in ("activity", "home") for k in ("cumulative", "increment") for n in ("mean", "median")]
    points = back.select("cohort", "grp", F.posexplode(F.arrays_zip(*names)).alias("point", "x")).filter("point > 0")
    return points.select("cohort", "grp", "point", *[_r(F.col(f"x.{c}").cast("double"), 7).alias(c) for c in names])


@query(f"{C.sql_detailed()}, {C.SQL_CURVES}, {_HOME}, fp AS (SELECT person_id FROM ({A.PERSONS}) p WHERE age = 89) SELECT person_id, CAST(bin_index AS INTEGER) bin_index, round(cumulative, 7) activity, round(home_cumulative, 7) home FROM curves JOIN home_curves USING (person_id, bin_index) WHERE person_id IN (SELECT person_id FROM fp)")
def file_asked_persons(spark, d):
    """Curves of the persons that are asked for, in a JSON folder each."""
    asked = A.frame(spark, d, A.PERSONS).filter("age = 89").select("person_id")
    series = exposure.timeseries(exposure.curves(C.detailed(spark, d).join(asked.hint("shuffle_hash"), "person_id", "left_semi"), home=X.home_hours(spark, d), slots=C.SLOTS))
    one = series.groupBy("person_id").agg(F.array_sort(F.collect_list(F.struct("bin_index", "activity_cumulative", "home_cumulative"))).alias("curve"))
    path = _place(spark, "asked")
    files.save_groups(one, path, "person_id")
    back = spark.read.schema("curve array<struct<bin_index: int, activity_cumulative: double, home_cumulative: double>>, person_id string").json(path)
    return back.select("person_id", F.explode("curve").alias("c")).select("person_id", "c.bin_index", _r("c.activity_cumulative", 7).alias("activity"), _r("c.home_cumulative", 7).alias("home"))


@query(f"WITH pt AS ({X.POINTS}), g AS (SELECT id, lon, lat, amount FROM pt WHERE amount > 0) SELECT CAST(id AS VARCHAR) sensor_index, round(lat, 9) latitude, round(lon, 9) longitude, '' AS name, round(amount, 9) baseline FROM g")
def file_grid(spark, d):
    """Sensors and a baseline grid as CSV, without values up to 0."""
    points = A.frame(spark, d, X.POINTS)
    grid = X.spatial.grid_values(points.withColumn("raw", F.col("amount")), positive=True)
    path = _place(spark, "grid")
    files.save_sensors(grid.select(F.col("id").alias("sensor_index"), F.col("lat").alias("latitude"), F.col("lon").alias("longitude"), F.lit("").alias("name")), f"{path}/sensors")
    files.save_csv(grid.select(F.col("id").alias("sensor_index"), "lon", "lat", F.col("value").alias("baseline")), f"{path}/grid")
    sensors = spark.read.option("header", True).csv(f"{path}/sensors")
    values = spark.read.option("header", True).csv(f"{path}/grid")
    both = sensors.join(values, "sensor_index")  # several sensors may share a place
    return rounded(both.select("sensor_index", *[F.col(c).cast("double").alias(c) for c in ("latitude", "longitude", "baseline")], F.coalesce("name", F.lit("")).alias("name")))


@query(f"WITH {X.SQL_ERRORS} SELECT sensor_index, n, {', '.join(f'round({m}, 7) {m}' for m in X.METRICS)}, {', '.join(f'round((SELECT {f}({m}) FROM er), 7) {n}_{m}' for m in X.METRICS for n, f in (('mean', 'avg'), ('median', 'median')))} FROM er")
def file_metrics(spark, d):
    """Errors of held-out sensors as CSV, and their aggregate as one JSON object."""
    each = X.sensor_errors(spark, d)
    path = _place(spark, "metrics")
    files.save_metrics(each, holdout.summarise(each.withColumn("_all", F.lit(1)), "_all", X.METRICS).drop("_all"), path)
    rows, aggregate = files.read_metrics(spark, path)
    return rounded(rows.join(F.broadcast(aggregate.drop("n"))), 7)  # one row





@query(f"WITH {C.SQL_RHAT} SELECT param, round(max(rhat), 9) max_rhat, (SELECT max(draw) + 1 FROM draws) draws FROM rh GROUP BY param")
def file_diagnostics(spark, d):
    """R-hat of all parameters in a JSON file of lists, and its roll-up."""
    draws = C.draws(spark, d)
    each = diagnostics.rhat(draws).groupBy("param").agg(F.array_sort(F.collect_list("rhat")).alias("r"))  # a parameter's elements
    one = each.agg(F.map_from_entries(F.collect_list(F.struct("param", "r"))).alias("rhat")).join(F.broadcast(draws.agg((F.max("draw") + 1).alias("n_draws"))))  # one row
    path = _place(spark, "diagnostics")
    files.save_json(one, path)
    return rounded(files.chain_diagnostics(spark, path).select("param", "max_rhat", "draws"))




@query(C.A.duck(f"""WITH pt AS (SELECT lon, lat, avg(mid) AS value FROM ({A.FIELD}) f GROUP BY lon, lat), ed AS (SELECT * FROM (VALUES {X._EDGES}) v(ring, x1, y1, x2, y2)),
ins AS (SELECT DISTINCT lon, lat FROM (SELECT ring, lon, lat FROM pt JOIN ed ON (y1 > lat) <> (y2 > lat) AND lon < (x2 - x1) * (lat - y1) / (y2 - y1) + x1 GROUP BY ring, lon, lat HAVING count(*) % 2 = 1) o),
cells AS (SELECT pt.* FROM pt JOIN ins USING (lon, lat)), cu AS (SELECT c_custkey id, -71.3e0 + (c_custkey * 37 % 1000) * 0.0005e0 + 0.0002e0 x, 42.2e0 + (c_custkey * 53 % 800) * 0.0005e0 + 0.0001e0 y FROM customer)
SELECT id, round(arg_min(value, (x - lon) ** 2 + (y - lat) ** 2), 9) AS value FROM cu CROSS JOIN cells GROUP BY id"""))
def file_static_field(spark, d):
    """A static field clipped to polygons from a GeoJSON file, looked up at points."""
    path = _place(spark, "rings")
    text = [
        '{"type": "Feature", "properties": {"msa_slug": "%s"}, "geometry": {"type": "Polygon", "coordinates": [[%s]]}}' % (n, ", ".join(f"[{x}, {y}]" for x, y in [*ring, ring[0]]))
        for n, ring in X.RING_POINTS.items()
    ]
    spark.createDataFrame([('{"type": "FeatureCollection", "features": [%s]}' % ", ".join(text),)], "value string").coalesce(1).write.text(path)
    vertices = files.polygon_vertices(spark, path)
    raster = A.frame(spark, d, A.FIELD).groupBy("lon", "lat").agg(F.avg("mid").alias("value"))
    cells = staged(field.static_field(staged(raster, "raster"), X.spatial.edges(vertices)), "cells").withColumn("slot", F.lit(0))
    points = A.frame(spark, d, X.POINTS).select("id", "lon", "lat", F.lit(0).alias("slot"))
    return rounded(field.nearest(points, cells, ["value"], C.CELL).select("id", "value"))
