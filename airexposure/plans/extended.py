"""More registered queries: curve bands and exports, cohort comparison, regions and grids, held-out sensors, sampling."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import cohorts, distribution, exposure, field, holdout, randoms, sensors, spatial, staypoints
from ..operators.staging import staged
from ..sources import adapters as A
from ..sources import files
from . import catalog as C
from .catalog import _r, query, rounded

RING_POINTS = {"pentagon": [(-71.25, 42.25), (-71.0, 42.22), (-70.95, 42.4), (-71.1, 42.5), (-71.28, 42.41)], "triangle": [(-70.93, 42.3), (-70.84, 42.45), (-70.9, 42.55)]}
CENTRES = [(-71.2, 42.3), (-71.0, 42.4), (-70.9, 42.5)]
POINTS = "SELECT c_custkey id, c_nationkey nation_id, cast(c_acctbal AS double) amount, -71.3e0 + (c_custkey * 37 % 1000) * 0.0005e0 + 0.0002e0 lon, 42.2e0 + (c_custkey * 53 % 800) * 0.0005e0 + 0.0001e0 lat FROM customer"
SITES = "SELECT DISTINCT user_id sensor_index, -71.3e0 + (user_id * 37 % 1000) * 0.0005e0 + 0.0002e0 lon, 42.2e0 + (user_id * 53 % 800) * 0.0005e0 + 0.0002e0 lat FROM events"
BANDS = ("", "_low", "_high")


_BAND = " JOIN ".join(f"({C.sql_detailed(band=b)}, {C.SQL_CURVES} SELECT CAST(bin_index AS INTEGER) bin_index, round(avg(cumulative), 7) mean_{b} FROM curves GROUP BY bin_index) {b}_q" + (" USING (bin_index)" if k else "") for k, b in enumerate(("mid", "low", "high")))


@query(f"SELECT * FROM {_BAND}")
def curves_low_high(spark, d):
    means = [_r(F.avg(f"cumulative{s}"), 7).alias(f"mean_{s[1:] or 'mid'}") for s in BANDS]
    return C.curve_rows(spark, d, BANDS).groupBy("bin_index").agg(*means)


SQL_HOME_CURVES = f"{C.SQL_HOME_DAY}, home_inc AS (SELECT h.person_id, g.range bin_index, mid * 0.385e0 / 12e0 home_increment FROM homes h CROSS JOIN range(288) g JOIN home_near n ON n.home_lon = h.home_lon AND n.home_lat = h.home_lat AND n.slot = CAST(30 * least(greatest(ceil(g.range * 5 / 30e0 - 0.5e0), 0), 47) AS INTEGER)), home_curves AS (SELECT *, sum(home_increment) OVER (PARTITION BY person_id ORDER BY bin_index) home_cumulative FROM home_inc)"


def home_curve_rows(spark, d):
    """(person_id, bin_index, home_increment, home_cumulative) of a day at home in five-minute bins."""
    homes = C.stays(spark, d).select("person_id", F.col("home_lon").alias("lon"), F.col("home_lat").alias("lat")).distinct()
    slots = homes.select("lon", "lat").distinct().withColumn("slot", F.explode(F.array(*[F.lit(s) for s in C.SLOTS])))
    near = field.nearest_join(slots, A.frame(spark, d, A.FIELD), ["mid"], C.CELL).drop("distance")
    return exposure.home_curves(homes, near, exposure.person_factors(C.persons(spark, d)), C.SLOTS)


def home_hours(spark, d):
    """(person_id, home): the hourly exposure at home in each slot of the day, as a list, of all persons with trips, whether they count or not: no stays are made for it."""
    homes = C.trips(spark, d).select("person_id", F.col("home_lon").alias("lon"), F.col("home_lat").alias("lat")).distinct()
    slots = homes.select("lon", "lat").distinct().withColumn("slot", F.explode(F.array(*[F.lit(s) for s in C.SLOTS])))
    near = field.nearest_within(slots, A.frame(spark, d, A.FIELD), ["mid"], C.CELL, C.extent(spark, d))
    places = near.groupBy("lon", "lat").agg(F.array(*[F.coalesce(F.max(F.when(F.col("slot") == s, F.col("mid"))), F.lit(0.0)) for s in C.SLOTS]).alias("mids"))
    rows = homes.join(places, ["lon", "lat"]).join(exposure.person_factors(C.persons(spark, d)), "person_id", "left")
    factor = F.coalesce(F.col("home_pen") * F.col("home_prox"), F.lit(1.0))
    return rows.select("person_id", factor.alias("_f"), "mids").select("person_id", F.transform("mids", lambda m: m * F.col("_f")).alias("home"))


def both_curves(spark, d, suffixes=("",), carried=None, **form):
    """``curve_rows`` with the curves of a day at home beside them."""
    return C.curve_rows(spark, d, suffixes, home_hours(spark, d), carried, **form)


@query(f"WITH {C.SQL_STAYS}, field AS ({A.FIELD}), {SQL_HOME_CURVES} SELECT person_id, CAST(bin_index AS INTEGER) bin_index, round(home_increment, 8) home_increment, round(home_cumulative, 7) home_cumulative FROM home_curves")
def home_curves(spark, d):
    return home_curve_rows(spark, d).select("person_id", "bin_index", _r("home_increment", 8).alias("home_increment"), _r("home_cumulative", 7).alias("home_cumulative"))


@query(f"{C.sql_detailed()}, {C.SQL_CURVES}, {SQL_HOME_CURVES} SELECT person_id, CAST(bin_index AS INTEGER) bin_index, round(cumulative, 7) activity, round(home_cumulative, 7) home, round(cumulative - home_cumulative, 7) + 0e0 delta, round((cumulative - home_cumulative) / ((bin_index + 1) / 12e0) + 3.1416e-8, 7) + 0e0 delta_twac FROM curves JOIN home_curves USING (person_id, bin_index)")
def timeseries_export(spark, d):
    both = both_curves(spark, d)
    delta = F.col("cumulative") - F.col("home_cumulative")
    # quotients often end on a tie, which the last bits of a sum would settle: they are rounded a little beside the middle
    return both.select("person_id", "bin_index", _r("cumulative", 7).alias("activity"), _r("home_cumulative", 7).alias("home"), (_r(delta, 7) + 0.0).alias("delta"), (_r(delta / ((F.col("bin_index") + 1) / 12.0) + 3.1416e-8, 7) + 0.0).alias("delta_twac"))


@query(f"{C.sql_detailed()}, {C.SQL_CURVES}, {C.SQL_COHORTS} SELECT cohort, grp, CAST(bin_index AS INTEGER) + 1 AS point, round(avg(cumulative), 7) mean_cumulative, round(median(cumulative), 7) median_cumulative FROM curves JOIN members USING (person_id) GROUP BY cohort, grp, bin_index UNION ALL SELECT DISTINCT cohort, grp, 0, 0e0, 0e0 FROM members JOIN (SELECT DISTINCT person_id FROM detailed) q USING (person_id)")
def payload_means(spark, d):
    lists = C.curve_rows(spark, d, carried=cohorts.listed(C.members(spark, d)), listed=True, kinds=("increment",)).filter("groups is not null")
    each = distribution.summarise_lists(staged(lists.select("increment", "groups"), "increments"), ["cumulative"], 288, {"median": 0.5}, {"cumulative": "increment"}, "groups")
    each = each.select("cohort", "grp", (F.col("bin_index") + 1).alias("point"), *[_r(c, 7).alias(f"{c}_cumulative") for c in ("mean", "median")])
    zero = F.lit(0.0)
    return each.unionByName(each.filter("point = 1").select("cohort", "grp", F.lit(0).alias("point"), zero.alias("mean_cumulative"), zero.alias("median_cumulative")))


@query(f"{C.SQL_COMPARE}, s AS (SELECT avg(activity) ma, median(activity) da, avg(home) mh, median(home) dh FROM compared) SELECT CAST(g.range AS INTEGER) AS point, round(ma * g.range / 288, 7) mean_activity, round(da * g.range / 288, 7) median_activity, round(mh * g.range / 288, 7) mean_home, round(dh * g.range / 288, 7) median_home FROM s CROSS JOIN range(289) g")
def population_lines(spark, d):
    ends = distribution.medians(C.compared(spark, d), [], ["activity", "home"])
    names = ends.columns
    return ends.withColumn("point", F.explode(F.sequence(F.lit(0), F.lit(288)))).select("point", *[_r(F.col(c) * F.col("point") / 288, 7).alias(c) for c in names])


def _wide(metric: str) -> str:
    v = f"v) FILTER (WHERE metric = '{metric}')"
    return f"round(avg({v}, 7) {metric}_mean, round(coalesce(stddev_samp({v}, 0), 7) {metric}_std, round(1.96e0 * coalesce(stddev_samp({v}, 0) / sqrt(count({v}), 7) {metric}_error"


@query(f"{C.SQL_COMPARE}, {C.SQL_COHORTS}, {C._LONG} SELECT cohort, grp, count(*) FILTER (WHERE metric = 'activity') n, {', '.join(_wide(m) for m in ('activity', 'home', 'ratio'))} FROM long WHERE cohort IN (SELECT cohort FROM long GROUP BY cohort HAVING count(DISTINCT grp) >= 2) GROUP BY cohort, grp")
def cohort_comparison(spark, d):
    out = cohorts.comparison(C.compared(spark, d).join(C.members(spark, d), "person_id"), ["activity", "home", "ratio"])
    return out.select("cohort", "grp", "n", *[_r(c, 7).alias(c) for c in out.columns[3:]])


@query(f"SELECT person_id FROM ({A.PERSONS}) p WHERE income >= 120000 AND age < 40")
def persons_by_filter(spark, d):
    return A.frame(spark, d, A.PERSONS).where("income >= 120000 AND age < 40").select("person_id")


@query(f"WITH {C.SQL_STAYS}, {C.SQL_WHOLE} SELECT DISTINCT CAST(floor(start_s / 60) AS INTEGER) AS minute_of_day, {C.SQL_SLOT} slot FROM halves")
def nearest_slot(spark, d):
    minute = F.floor(F.col("start_s") / 60).cast("int")
    return staypoints.split_intervals(C.stays(spark, d)).select(minute.alias("minute_of_day"), field.nearest_slot(minute, C.SLOTS).alias("slot")).distinct()


@query(f"WITH {C.SQL_READ}, st AS (SELECT *, lag(pm) OVER (PARTITION BY sensor_index ORDER BY datetime_utc, event_id) b FROM r1) SELECT event_id, sensor_index, pm FROM st WHERE b IS NULL OR abs(pm - b) <= 150")
def sensor_step(spark, d):
    return sensors.step_filter(sensors.in_range(A.frame(spark, d, A.READINGS))).select("event_id", "sensor_index", "pm")


FEATURES = "SELECT c_custkey sensor_index, c_name name, lower(n_name) region, -71.3e0 + (c_custkey * 37 % 1000) * 0.0005e0 + 0.0002e0 lon, 42.2e0 + (c_custkey * 53 % 800) * 0.0005e0 + 0.0001e0 lat FROM customer JOIN nation ON n_nationkey = c_custkey % 25"


def features(spark, d):
    clean = sensors.step_filter(sensors.mad_filter(sensors.in_range(A.frame(spark, d, A.READINGS))))
    return sensors.with_readings(A.frame(spark, d, FEATURES), clean)


@query(f"WITH {C.SQL_STEP}, fe AS ({FEATURES}) SELECT sensor_index, name, region, round(lon, 9) lon, round(lat, 9) lat FROM fe WHERE (region, sensor_index) IN (SELECT region, sensor_index FROM r3)")
def sensor_features(spark, d):
    return rounded(features(spark, d).select("sensor_index", "name", "region", "lon", "lat"))


@query()
def sensor_geojson(spark, d):
    return features(spark, d).select("sensor_index", files.point_feature(F.col("lon"), F.col("lat"), F.struct("sensor_index", "name", F.col("region").alias("msa_slug"))).alias("value"))


@query()
def person_json(spark, d):
    return files.person_json(C.compared(spark, d))


SAMPLES = "SELECT lower(n_name) region, cast(count(*) AS double) persons, 100e0 * avg(CASE WHEN c_acctbal > 0 THEN 1e0 ELSE 0e0 END) pct_sampled FROM customer JOIN nation ON n_nationkey = c_nationkey WHERE c_nationkey % 5 <> 0 GROUP BY lower(n_name)"


@query(f"WITH {C.SQL_READ}, ct AS (SELECT region, strftime(datetime_utc, '%Y-%m') AS \"month\", count(DISTINCT sensor_index) n FROM r GROUP BY 1, 2), sm AS ({SAMPLES}) SELECT ct.region, \"month\", n, persons, round(pct_sampled, 9) pct_sampled FROM ct LEFT JOIN sm ON ct.region = sm.region")
def region_samples(spark, d):
    return rounded(C.sensors_per_region(spark, d).join(A.frame(spark, d, SAMPLES), "region", "left"))


SLUGS = "SELECT DISTINCT concat(CASE user_id % 5 WHEN 0 THEN 'san-diego-' WHEN 1 THEN 'salt-lake-city-' WHEN 2 THEN 'new-york-' ELSE '' END, replace(lower(n_name), ' ', '-')) slug FROM events JOIN nation ON n_nationkey = user_id % 25"
_KNOWN = ", ".join(f"'{c}'" for c in spatial.CITIES)


@query(f"WITH s AS (SELECT slug, string_split(slug, '-') w FROM ({SLUGS}) q), t AS (SELECT slug, CASE WHEN array_to_string(w[1:2], ' ') IN ({_KNOWN}) THEN w[1:2] WHEN array_to_string(w[1:3], ' ') IN ({_KNOWN}) THEN w[1:3] ELSE w[1:1] END w FROM s) SELECT slug, array_to_string(w, '_') city, concat(upper(w[1][1]), w[1][2:], coalesce(upper(w[2][1]) || w[2][2:], ''), coalesce(upper(w[3][1]) || w[3][2:], '')) folder FROM t")
def city_key(spark, d):
    slug = F.col("slug")
    return A.frame(spark, d, SLUGS).select(slug, spatial.city_key(slug).alias("city"), spatial.city_folder(slug).alias("folder"))


_EDGES = ", ".join(f"('{n}', {a[0]}e0, {a[1]}e0, {b[0]}e0, {b[1]}e0)" for n, ring in RING_POINTS.items() for a, b in zip(ring, ring[1:] + ring[:1]))


@query(f"WITH pt AS ({POINTS}), ed AS (SELECT * FROM (VALUES {_EDGES}) v(ring, x1, y1, x2, y2)), odd AS (SELECT DISTINCT id FROM (SELECT ring, id FROM pt JOIN ed ON (y1 > lat) <> (y2 > lat) AND lon < (x2 - x1) * (lat - y1) / (y2 - y1) + x1 GROUP BY ring, id HAVING count(*) % 2 = 1) o) SELECT id, round(lon, 9) lon, round(lat, 9) lat FROM pt WHERE id IN (SELECT id FROM odd)")
def grid_clip(spark, d):
    rows = [(n, i, x, y) for n, ring in RING_POINTS.items() for i, (x, y) in enumerate(ring)]
    edges = spatial.edges(spark.createDataFrame(rows, "ring string, pos int, lon double, lat double"))
    return rounded(spatial.clip(A.frame(spark, d, POINTS), edges, 0.01).select("id", "lon", "lat"))


@query(f"SELECT nation_id, round(min(lon), 9) west, round(max(lon), 9) east, round(min(lat), 9) south, round(max(lat), 9) north FROM ({POINTS}) p GROUP BY nation_id")
def grid_bbox(spark, d):
    return rounded(spatial.bbox(A.frame(spark, d, POINTS), "nation_id"))


def _sql_lines(axis: str, scale: str) -> str:
    return f"{axis}_l AS (SELECT {axis}, row_number() OVER (ORDER BY {axis}) - 1 i, {axis} - lag({axis}) OVER (ORDER BY {axis}) gap FROM (SELECT DISTINCT {axis} FROM pt) q), {axis}_k AS (SELECT {axis} FROM {axis}_l WHERE i % (SELECT greatest(1, CAST(floor(500e0 / (median(gap) * {scale}) + 0.5e0) AS INTEGER)) FROM {axis}_l) = 0)"


@query(f"WITH pt AS ({POINTS}), {_sql_lines('lon', 'cos(radians((SELECT avg(lat) FROM pt))) * 111320e0')}, {_sql_lines('lat', '111320e0')} SELECT id, round(lon, 9) lon, round(lat, 9) lat FROM pt WHERE lon IN (SELECT lon FROM lon_k) AND lat IN (SELECT lat FROM lat_k)")
def grid_stride(spark, d):
    return rounded(spatial.thin(A.frame(spark, d, POINTS), 500.0).select("id", "lon", "lat"))


GRID = "SELECT l_shipdate \"day\", l_orderkey id, CASE WHEN l_orderkey % 29 = 0 THEN 65535 ELSE l_partkey % 500 END raw FROM lineitem"


@query(f"SELECT \"day\", count(*) n, round(avg(CAST(raw AS DOUBLE)), 9) mean_value FROM ({GRID}) g WHERE raw <> 65535 AND raw > 0 GROUP BY \"day\"")
def grid_daily(spark, d):
    return rounded(spatial.grid_values(A.frame(spark, d, GRID), positive=True).groupBy("day").agg(F.count(F.lit(1)).alias("n"), F.avg("value").alias("mean_value")))


SQL_PROFILES = f"{C.SQL_READ}, lv AS (SELECT sensor_index, bin, median(pm) AS level FROM r1 GROUP BY 1, 2), pr AS (SELECT *, CASE WHEN m > 0 THEN level / m END shape, CASE WHEN level > 0 THEN ln(level) END log_level FROM (SELECT *, avg(level) OVER (PARTITION BY sensor_index) m FROM lv) q)"
SQL_ERRORS = f"{SQL_PROFILES}, pd AS (SELECT bin, avg(log_level) p FROM pr GROUP BY bin), ob AS (SELECT sensor_index, log_level o, p, log_level - avg(log_level) OVER w oc, p - avg(p) OVER w pc FROM pr JOIN pd USING (bin) WHERE log_level IS NOT NULL AND p IS NOT NULL WINDOW w AS (PARTITION BY sensor_index)), er AS (SELECT sensor_index, count(*) n, sqrt(avg((o - p) ** 2)) rmse, avg(abs(o - p)) mae, CASE WHEN sum(oc ** 2) > 1e-12 THEN 1 - sum((o - p) ** 2) / sum(oc ** 2) END r2, sqrt(avg((oc - pc) ** 2)) shape_rmse, avg(abs(oc - pc)) shape_mae, CASE WHEN sum(oc ** 2) > 1e-12 THEN 1 - sum((oc - pc) ** 2) / sum(oc ** 2) END shape_r2 FROM ob GROUP BY sensor_index)"
METRICS = ["rmse", "mae", "r2", "shape_rmse", "shape_mae", "shape_r2"]


def sensor_errors(spark, d):
    seen = holdout.profiles(sensors.in_range(A.frame(spark, d, A.READINGS)))
    predicted = seen.groupBy("bin").agg(F.avg("log_level").alias("predicted"))
    return holdout.errors(seen.join(predicted, "bin"), "log_level", "predicted", "sensor_index")


@query(f"WITH {SQL_PROFILES} SELECT sensor_index, bin, round(level, 8) AS level, round(shape, 8) shape, round(log_level, 8) log_level FROM pr")
def holdout_profiles(spark, d):
    return rounded(holdout.profiles(sensors.in_range(A.frame(spark, d, A.READINGS))), 8)


@query(f"WITH {SQL_ERRORS} SELECT sensor_index, n, {', '.join(f'round({m}, 7) {m}' for m in METRICS)} FROM er")
def holdout_metrics(spark, d):
    return rounded(sensor_errors(spark, d), 7)


@query(f"WITH {SQL_ERRORS} SELECT sensor_index % 5 param_value, count(*) n, {', '.join(f'round({f}({m}), 7) {n}_{m}' for m in METRICS for n, f in (('mean', 'avg'), ('median', 'median')))} FROM er GROUP BY 1")
def sweep_summary(spark, d):
    return rounded(holdout.summarise(sensor_errors(spark, d).withColumn("param_value", F.col("sensor_index") % 5), "param_value", METRICS), 7)


@query(f"SELECT sensor_index, c centre, round(exp(-0.5e0 * ((lon - x) ** 2 + (lat - y) ** 2) / 0.1e0 ** 2), 8) phi FROM ({SITES}) s CROSS JOIN (VALUES {', '.join(f'({i}, {x}e0, {y}e0)' for i, (x, y) in enumerate(CENTRES))}) v(c, x, y)")
def holdout_basis(spark, d):
    return rounded(holdout.radial_basis(A.frame(spark, d, SITES), CENTRES, 0.1), 8)


SQL_NEAR = "nt AS (SELECT sensor_index, nearest, distance FROM (SELECT h.sensor_index, t.sensor_index nearest, sqrt(d2) distance, row_number() OVER (PARTITION BY h.sensor_index ORDER BY d2, t.lon, t.lat) rn FROM (SELECT h.sensor_index, t.sensor_index ti, t.lon, t.lat, (h.lon - t.lon) * (h.lon - t.lon) + (h.lat - t.lat) * (h.lat - t.lat) d2 FROM held h CROSS JOIN train t) h JOIN train t ON t.sensor_index = h.ti) q WHERE rn = 1)"
_TENTH = f"s AS ({SITES}), held AS (SELECT * FROM s WHERE sensor_index % 10 = 0), train AS (SELECT * FROM s WHERE sensor_index % 10 <> 0)"


def near_training(held, train):
    """(sensor_index, nearest, distance): each held-out sensor's nearest training sensor."""
    here, there = held.withColumn("slot", F.lit(0)), train.withColumn("slot", F.lit(0)).withColumnRenamed("sensor_index", "nearest")
    return field.nearest(here, there, ["nearest"], C.CELL).select("sensor_index", "nearest", "distance")


@query(f"WITH {_TENTH}, {SQL_NEAR} SELECT sensor_index, nearest, round(distance, 9) distance FROM nt")
def nearest_training_sensor(spark, d):
    sites = A.frame(spark, d, SITES)
    return rounded(near_training(sites.filter("sensor_index % 10 = 0"), sites.filter("sensor_index % 10 <> 0")))


SQL_SHAPE = f"{C.SQL_DRAWS}, sh AS (SELECT chain, draw, element AS bin, value - m - ln(avg(exp(value - m)) OVER (PARTITION BY chain, draw)) log_s FROM (SELECT *, max(value) OVER (PARTITION BY chain, draw) m FROM draws WHERE param = 'mu_tilde') q)"


def shapes(spark, d):
    rows = C.draws(spark, d).filter("param = 'mu_tilde'").select("chain", "draw", F.col("element").alias("bin"), F.col("value").alias("z"))
    return holdout.log_shape(rows, "chain", "draw")


@query(f"WITH {SQL_SHAPE} SELECT chain, bin, round(avg(exp(log_s)), 8) mean, round(quantile_cont(exp(log_s), 0.025), 8) q0, round(quantile_cont(exp(log_s), 0.975), 8) q1 FROM sh GROUP BY chain, bin")
def holdout_shape(spark, d):
    return rounded(holdout.bands(shapes(spark, d).withColumn("shape", F.exp("log_s")), "shape", [0.025, 0.975], "chain", "bin"), 8)


@query(f"WITH {SQL_SHAPE}, bs AS (SELECT chain, draw, avg(value) FILTER (WHERE param = 'tau') base, avg(value) FILTER (WHERE param = 'b') bias FROM draws GROUP BY chain, draw), lp AS (SELECT chain, bin, ln(greatest(base, 1e-12)) + log_s + bias log_pm FROM sh JOIN bs USING (chain, draw)) SELECT chain, bin, round(avg(log_pm), 8) mean, round(quantile_cont(log_pm, 0.05), 8) q0, round(quantile_cont(log_pm, 0.95), 8) q1 FROM lp GROUP BY chain, bin")
def holdout_bands(spark, d):
    of = lambda p: F.avg(F.when(F.col("param") == p, F.col("value")))
    base = C.draws(spark, d).groupBy("chain", "draw").agg(of("tau").alias("base"), of("b").alias("bias"))
    return rounded(holdout.bands(holdout.level(shapes(spark, d), base, "chain", "draw"), "log_pm", [0.05, 0.95], "chain", "bin"), 8)


@query(f"SELECT person_id, income, age, race, industry FROM ({A.PERSONS}) p ORDER BY CASE WHEN age = 89 THEN 0 ELSE 1 END, {randoms.sql_uniform(1, 'person_id')}, person_id LIMIT 100")
def sampled_persons(spark, d):
    """A hundred persons, those asked for first."""
    people = A.frame(spark, d, A.PERSONS).select("person_id", "income", "age", "race", "industry")
    return randoms.sample(people, 100, "person_id", forced=F.col("age") == 89)


@query(f"WITH u AS (SELECT person_id, income, age, race, industry, {randoms.sql_uniform(1, 'person_id')} u FROM ({A.PERSONS}) p) SELECT person_id, income, age, race, industry FROM u WHERE u < 0.1e0 OR u = (SELECT min(u) FROM u)")
def thinned_persons(spark, d):
    return randoms.thinned(A.frame(spark, d, A.PERSONS).select("person_id", "income", "age", "race", "industry"), 0.1, "person_id")


@query(f"SELECT id, nation_id, amount, lon, lat FROM ({POINTS}) p ORDER BY {randoms.sql_uniform(1, 'id')}, id LIMIT 1000")
def capped_points(spark, d):
    """A map of at most a thousand points."""
    return randoms.sample(A.frame(spark, d, POINTS), 1000, "id")


_CHOSEN = f"SELECT sensor_index FROM (SELECT DISTINCT user_id sensor_index FROM events) q ORDER BY {randoms.sql_uniform(1, 'sensor_index')}, sensor_index LIMIT 10"


@query(_CHOSEN)
def holdout_choice(spark, d):
    return holdout.choose_holdouts(A.frame(spark, d, SITES), 10)


@query(f"WITH {C.SQL_DRAWS}, few AS (SELECT chain, draw FROM (SELECT DISTINCT chain, draw FROM draws) q ORDER BY {randoms.sql_uniform(1, 'chain', 'draw')}, chain, draw LIMIT 20) SELECT param, element, chain, draw, round(value, 9) AS value FROM draws WHERE (chain, draw) IN (SELECT chain, draw FROM few)")
def thinned_draws(spark, d):
    """Twenty of the posterior's draws, with all their parameters."""
    return rounded(randoms.chosen_draws(C.draws(spark, d), 20, "chain", "draw"))


# Held-out prediction: centres of the training sensors, their basis, thinned posterior draws, shapes, levels, errors.

CLUSTERS, STEPS, WIDTH, TERMS, BINS, KEPT_DRAWS = 3, 5, 0.1, 4, 16, 20


def _sql_kmeans() -> str:
    """Lloyd's steps as tables k0, a0, k1, ... of the training sensors."""
    first = f"k0 AS (SELECT row_number() OVER (ORDER BY sensor_index) - 1 i, lon x, lat y FROM (SELECT * FROM train ORDER BY {randoms.sql_uniform(1, 'sensor_index')}, sensor_index LIMIT {CLUSTERS}) q)"
    steps = [
        f"a{j} AS (SELECT sensor_index, lon, lat, arg_min(i, d) c FROM (SELECT t.*, k.i, (lon - x) * (lon - x) + (lat - y) * (lat - y) d FROM train t CROSS JOIN k{j} k) q GROUP BY sensor_index, lon, lat), k{j + 1} AS (SELECT k.i, coalesce(avg(lon), max(k.x)) x, coalesce(avg(lat), max(k.y)) y FROM k{j} k LEFT JOIN a{j} ON c = k.i GROUP BY k.i)"
        for j in range(STEPS)
    ]
    return ", ".join([first, *steps])


def _sql_basis() -> str:
    """Gram and Schmidt's steps over the training sensors: tables q0, q1, ... with one column more each, q{n} being the basis."""
    phi = ", ".join(f"max(CASE WHEN i = {c} THEN exp(-0.5e0 * ((lon - x) ** 2 + (lat - y) ** 2) / {WIDTH}e0 ** 2) END) p{c}" for c in range(CLUSTERS))
    out = [f"q0 AS (SELECT s.sensor_index, bool_or(s.sensor_index IN (SELECT sensor_index FROM train)) t, {phi} FROM s CROSS JOIN k{STEPS} GROUP BY s.sensor_index)"]
    for c in range(CLUSTERS):
        rest = f"p{c}" + "".join(f" - q{j} * (SELECT sum(q{j} * p{c}) FROM q{c} WHERE t)" for j in range(c))
        out.append(f"u{c} AS (SELECT *, {rest} v FROM q{c}), q{c + 1} AS (SELECT * EXCLUDE (v), v / (SELECT sqrt(sum(v * v)) FROM u{c} WHERE t) q{c} FROM u{c})")
    return ", ".join(out)


SQL_BASIS = f"s AS ({SITES}), hs AS ({_CHOSEN}), held AS (SELECT * FROM s WHERE sensor_index IN (SELECT sensor_index FROM hs)), train AS (SELECT * FROM s WHERE sensor_index NOT IN (SELECT sensor_index FROM hs)), {_sql_kmeans()}, {_sql_basis()}, sp AS ({' UNION ALL '.join(f'SELECT sensor_index, t, {c} centre, q{c} q FROM q{CLUSTERS}' for c in range(CLUSTERS))})"


def parted(spark, d):
    """(training sensors, held-out sensors)."""
    return holdout.split(A.frame(spark, d, SITES), holdout_choice(spark, d))


@query(f"WITH {SQL_BASIS} SELECT i AS centre, round(x, 9) lon, round(y, 9) lat FROM k{STEPS}")
def holdout_centres(spark, d):
    """Centres of the training sensors by k-means."""
    centres = holdout.kmeans(parted(spark, d)[0], CLUSTERS, iterations=STEPS)
    return rounded(spark.createDataFrame([(i, x, y) for i, (x, y) in enumerate(centres)], "centre long, lon double, lat double"))


def spatial_features(spark, d):
    train, held = parted(spark, d)
    return holdout.orthonormal_basis(train, held, holdout.kmeans(train, CLUSTERS, iterations=STEPS), WIDTH)


@query(f"WITH {SQL_BASIS} SELECT sensor_index, CAST(centre AS INTEGER) centre, round(q, 6) q FROM sp")
def holdout_features(spark, d):
    """Orthonormal spatial features of training sensors, and of held-out ones by the same factor."""
    return rounded(spatial_features(spark, d), 6)


_WAVES = ", ".join(f"({b}, {t}, {v!r}e0)" if "e" not in repr(v) else f"({b}, {t}, CAST('{v!r}' AS DOUBLE))" for b, row in enumerate(holdout.circular_basis(BINS, TERMS, 2.5)) for t, v in enumerate(row))
SQL_PREDICT = f"""{SQL_BASIS}, {SQL_NEAR},
few AS (SELECT vec_id, embedding e FROM embeddings ORDER BY {randoms.sql_uniform(1, 'vec_id')}, vec_id LIMIT {KEPT_DRAWS}),
waves AS (SELECT * FROM (VALUES {_WAVES}) v(bin, term, w)),
aa AS (SELECT sensor_index, t, vec_id, term, sum(CAST(e[{BINS + 1} + centre * {TERMS} + term] AS DOUBLE) * q) a FROM sp CROSS JOIN few CROSS JOIN range({TERMS}) g(term) GROUP BY 1, 2, 3, 4),
rr AS (SELECT sensor_index, t, vec_id, bin, sum(a * w) r FROM aa JOIN waves USING (term) GROUP BY 1, 2, 3, 4),
zz AS (SELECT sensor_index, vec_id, bin, CAST(e[bin + 1] AS DOUBLE) + r - m z FROM rr JOIN (SELECT vec_id, bin, avg(r) m FROM rr WHERE t GROUP BY 1, 2) c USING (vec_id, bin) JOIN few USING (vec_id)),
ls AS (SELECT sensor_index, vec_id, bin, z - m - ln(avg(exp(z - m)) OVER (PARTITION BY sensor_index, vec_id)) log_s FROM (SELECT *, max(z) OVER (PARTITION BY sensor_index, vec_id) m FROM zz) q),
fd AS (SELECT lon, lat, avg(mid) v FROM ({A.FIELD}) f GROUP BY lon, lat),
gr AS (SELECT s.sensor_index, arg_min(v, (s.lon - fd.lon) ** 2 + (s.lat - fd.lat) ** 2) g FROM s CROSS JOIN fd GROUP BY 1),
bs AS (SELECT nt.sensor_index, vec_id, ln(greatest(a.g + 8 + 2 * CAST(e[33 + nearest % 16] AS DOUBLE) - b.g, 1e-12)) base, CAST(e[49 + nearest % 16] AS DOUBLE) bias FROM nt CROSS JOIN few JOIN gr a ON a.sensor_index = nt.sensor_index JOIN gr b ON b.sensor_index = nearest),
pr AS (SELECT sensor_index, bin, avg(base + log_s + bias) with_bias, avg(base + log_s) without_bias, quantile_cont(base + log_s + bias, 0.05) low, quantile_cont(base + log_s + bias, 0.95) high FROM ls JOIN bs USING (sensor_index, vec_id) GROUP BY 1, 2),
{C.SQL_READ}, seen AS (SELECT sensor_index, CAST(floor(bin / 3) AS INTEGER) bin, ln(median(pm)) o FROM r1 GROUP BY 1, 2 HAVING median(pm) > 0),
both_ AS (SELECT sensor_index, pr.bin, o, with_bias, without_bias, low, high FROM pr JOIN seen USING (sensor_index, bin))"""


def _errors_sql(p: str, suffix: str) -> str:
    return f"sqrt(avg((o - {p}) ** 2)) rmse{suffix}, avg(abs(o - {p})) mae{suffix}, CASE WHEN sum((o - om) ** 2) > 1e-12 THEN 1 - sum((o - {p}) ** 2) / sum((o - om) ** 2) END r2{suffix}, sqrt(avg((o - om - ({p} - {p}_m)) ** 2)) shape_rmse{suffix}, avg(abs(o - om - ({p} - {p}_m))) shape_mae{suffix}, CASE WHEN sum((o - om) ** 2) > 1e-12 THEN 1 - sum((o - om - ({p} - {p}_m)) ** 2) / sum((o - om) ** 2) END shape_r2{suffix}"


SQL_HELD = f"{SQL_PREDICT}, em AS (SELECT *, avg(o) OVER w om, avg(with_bias) OVER w with_bias_m, avg(without_bias) OVER w without_bias_m FROM both_ WINDOW w AS (PARTITION BY sensor_index)), ee AS (SELECT sensor_index, count(*) n, {_errors_sql('with_bias', '')}, {_errors_sql('without_bias', '_no_bias')} FROM em GROUP BY sensor_index)"
HELD_METRICS = [*METRICS, *[f"{m}_no_bias" for m in METRICS]]


def predictions(spark, d):
    """(sensor_index, bin, o, with_bias, without_bias, low, high) of held-out sensors: logs of observed and predicted levels.

    Twenty draws, each with the mean of its shape, the weights of the bases, and levels and biases of the training sensors. The level
    is the grid's at the sensor, moved by what the nearest training sensor's level differs from the grid there.
    """
    train, held = parted(spark, d)
    few = randoms.sample(spark.read.parquet(f"{d}/embeddings.parquet"), KEPT_DRAWS, "vec_id").select(F.col("vec_id").alias("draw"), F.col("embedding").alias("e"))
    few = staged(few, "draws")
    value = lambda at: F.get("e", at).cast("double")
    cells = F.explode(F.sequence(F.lit(0), F.lit(CLUSTERS * TERMS - 1))).alias("i")
    weights = few.select("draw", "e", cells).select("draw", F.floor(F.col("i") / TERMS).cast("int").alias("centre"), (F.col("i") % TERMS).alias("term"), value(BINS + F.col("i")).alias("w"))
    mean = few.select("draw", "e", F.explode(F.sequence(F.lit(0), F.lit(BINS - 1))).alias("bin")).select("draw", "bin", value(F.col("bin")).alias("mu"))
    waves = [(b, t, v) for b, row in enumerate(holdout.circular_basis(BINS, TERMS, 2.5)) for t, v in enumerate(row)]
    temporal = spark.createDataFrame(waves, "bin int, term int, t double")
    shape = holdout.predicted_shape(weights, spatial_features(spark, d), temporal, mean, train, held)
    grid = A.frame(spark, d, A.FIELD).groupBy("lon", "lat").agg(F.avg("mid").alias("grid")).withColumn("slot", F.lit(0))
    at = staged(field.nearest(A.frame(spark, d, SITES).withColumn("slot", F.lit(0)), staged(grid, "grid"), ["grid"], C.CELL).select("sensor_index", "grid"), "grid")
    near = near_training(held, train).select("sensor_index", F.col("nearest").alias("near"))
    index = (F.col("near") % 16).cast("int")
    levels = near.select("near").distinct().join(F.broadcast(few)).select("near", "draw", (8 + 2 * value(2 * BINS + index)).alias("level"), value(3 * BINS + index).alias("bias"))  # twenty draws
    base = holdout.baseline("grid+nearest", at, near, levels.select("near", "draw", "level"), at.select(F.col("sensor_index").alias("near"), F.col("grid").alias("grid_near")))
    bias = near.join(levels.select("near", "draw", "bias"), "near").select("sensor_index", "draw", "bias")
    with_ = holdout.level(shape, base.join(bias, ["sensor_index", "draw"]), "sensor_index", "draw").withColumn("plain", F.col("log_pm") - F.col("bias"))
    of = with_.groupBy("sensor_index", "bin").agg(F.avg("log_pm").alias("with_bias"), F.avg("plain").alias("without_bias"), F.percentile("log_pm", [0.05, 0.95]).alias("q"))
    readings = sensors.in_range(A.frame(spark, d, A.READINGS)).select("sensor_index", F.floor(F.col("bin") / 3).cast("int").alias("bin"), "pm")
    seen = holdout.profiles(readings).select("sensor_index", "bin", F.col("log_level").alias("o")).filter("o is not null")
    return of.join(seen, ["sensor_index", "bin"]).select("sensor_index", "bin", "o", "with_bias", "without_bias", F.col("q")[0].alias("low"), F.col("q")[1].alias("high"))


@query(f"WITH {SQL_PREDICT} SELECT sensor_index, CAST(bin AS INTEGER) bin, {', '.join(f'round({c}, 6) {c}' for c in ('o', 'with_bias', 'without_bias', 'low', 'high'))} FROM both_")
def holdout_predictions(spark, d):
    """Predicted levels of held-out sensors, their bands, and what was observed."""
    return rounded(predictions(spark, d), 6)


@query(f"WITH {SQL_HELD} SELECT sensor_index, n, {', '.join(f'round({m}, 6) {m}' for m in HELD_METRICS)} FROM ee")
def holdout_prediction_errors(spark, d):
    """Errors of each held-out sensor, with and without the sensor bias."""
    return rounded(holdout.metric_tables(predictions(spark, d), "with_bias", "without_bias", "o")[0], 6)


@query(f"WITH {SQL_HELD} SELECT count(*) n, {', '.join(f'round({f}({m}), 6) {n}_{m}' for m in HELD_METRICS for n, f in (('mean', 'avg'), ('median', 'median')))} FROM ee")
def holdout_prediction_summary(spark, d):
    """Mean and median error over the held-out sensors."""
    return rounded(holdout.metric_tables(predictions(spark, d), "with_bias", "without_bias", "o")[1], 6)


# Other forms of the daily figures.


@query(f"WITH {C.SQL_STAYS} SELECT microenv, CASE WHEN location_type = 'travel' THEN CASE WHEN microenv = 'travel_unknown' THEN 'mode_unknown' ELSE 'mode' END WHEN dist_to_home_m <= 100 THEN 'home_distance' WHEN purpose IN ('work', 'school') THEN 'purpose' ELSE 'default' END microenv_rule, count(*) n FROM stays GROUP BY 1, 2")
def microenv_rules(spark, d):
    """Stays by microenvironment and the rule that gave it."""
    return C.stays(spark, d).groupBy("microenv", "microenv_rule").agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {C.SQL_ASSIGN}, {C.SQL_STAYS} SELECT s.person_id, CAST(seq AS BIGINT) seq, microenv, round(CASE WHEN microenv = 'work_indoor' THEN p_outdoor END, 9) p_outdoor_work FROM stays s LEFT JOIN assigned a ON a.person_id = s.person_id")
def outdoor_work_on_stays(spark, d):
    """Stays with the probability that work there is done outdoors."""
    return rounded(staypoints.with_outdoor_work(C.stays(spark, d), C.persons(spark, d)).select("person_id", "seq", "microenv", "p_outdoor_work"))


_TOTAL_OF = {b: f"SELECT person_id, sum(exposure) total_{b} FROM ({C.sql_detailed(band=b)} SELECT person_id, exposure FROM detailed) q GROUP BY person_id" for b in ("mid", "low", "high")}


@query(f"SELECT person_id, {', '.join(f'round(total_{b}, 8) total_{b}' for b in _TOTAL_OF)} FROM ({_TOTAL_OF['mid']}) m JOIN ({_TOTAL_OF['low']}) l USING (person_id) JOIN ({_TOTAL_OF['high']}) h USING (person_id)")
def daily_exposure_bands(spark, d):
    """Daily exposure from the middle, low and high values of the field."""
    out = exposure.totals(C.detailed(spark, d, bands=BANDS), BANDS)
    return rounded(out.select("person_id", *[F.col(f"total_exposure{s}").alias(f"total_{s[1:] or 'mid'}") for s in BANDS]), 8)


@query(f"{C.SQL_COMPARE}, tw AS (SELECT t.person_id, CASE WHEN duration_hours > 0 THEN total_exposure / duration_hours ELSE 0e0 END activity, coalesce(home / 24, {C.FALLBACK} / 24e0) home FROM totals t LEFT JOIN home_day h ON t.person_id = h.person_id) SELECT person_id, round(activity, 8) activity, round(home, 8) home, round(activity - home, 7) delta, round(CASE WHEN home > 0 THEN activity / home END, 8) ratio FROM tw")
def comparison_twac(spark, d):
    """Time-weighted averages of the day and of a day at home."""
    both = exposure.activity_metric(C.days(spark, d), "twac").withColumn("home", F.col("home") / 24)
    out = exposure.compare(both, None, exposure.home_fallback(C.FALLBACK / 24, "twac"))
    return rounded(out.withColumn("delta", _r("delta", 7)), 8)


def _static(metric: str, factor: str) -> None:
    activity = "total_exposure" if metric == "cumulative" else "CASE WHEN duration_hours > 0 THEN total_exposure / duration_hours ELSE 0e0 END"
    sql = f"{C.sql_detailed()}, {C.SQL_TOTALS}, {C.SQL_HOME}, cs AS (SELECT t.person_id, {activity} activity, coalesce(c * {factor}, 10e0 * {factor}) home FROM totals t LEFT JOIN first_origin o ON o.person_id = t.person_id) SELECT person_id, round(activity, 8) activity, round(home, 8) home, round(activity - home, 7) delta, round(CASE WHEN home > 0 THEN activity / home END, 8) ratio FROM cs"

    def run(spark, d):
        rows = staged(C.detailed(spark, d).select("person_id", "location_type", "lon", "lat", "start_s", "seq", "concentration", "exposure", "duration_hours"), "details")
        home = exposure.home_total(exposure.first_origin(rows), metric)
        out = exposure.compare(exposure.activity_metric(exposure.totals(rows), metric), home, exposure.home_fallback(10.0, metric))
        return rounded(out.withColumn("delta", _r("delta", 7)), 8)

    run.__name__ = f"comparison_static_{metric}"
    run.__doc__ = "The day against one spent at the place where it begins, at that place's concentration; persons without one get the fallback."
    query(sql)(run)


_static("cumulative", "24e0")
_static("twac", "1e0")


@query(f"{C.sql_detailed()} SELECT count(*) n, round(min(c), 8) min_concentration, round(max(c), 8) max_concentration, round(avg(c), 7) mean_concentration, round(min(exposure), 8) min_exposure, round(max(exposure), 8) max_exposure, round(avg(exposure), 7) mean_exposure FROM detailed")
def concentration_summary(spark, d):
    """Least, largest and mean concentration and exposure over all pieces of all days."""
    out = C.detailed(spark, d).agg(F.count(F.lit(1)).alias("n"), *[f(v).alias(f"{n}_{v}") for v in ("concentration", "exposure") for n, f in (("min", F.min), ("max", F.max), ("mean", F.avg))])
    return out.select("n", *[_r(c, 7 if c.startswith("mean") else 8).alias(c) for c in out.columns[1:]])


@query(f"{C.sql_detailed()}, {C.SQL_COHORTS}, peaks AS (SELECT cohort, grp, coalesce(p.v, 0e0) v FROM members LEFT JOIN (SELECT person_id, max(CASE WHEN location_type = 'travel' THEN coalesce(te, 0e0) ELSE c END) v FROM detailed GROUP BY person_id) p USING (person_id)) " + C._sql_described("peaks", "cohort, grp", "v"))
def cohort_peak_in_memory(spark, d):
    """Peaks by the rule that counts travel without a value as 0."""
    peak = C.detailed(spark, d).groupBy("person_id").agg(F.max(exposure.rate("travel_or_zero")).alias("v"))
    rows = C.members(spark, d).join(peak, "person_id", "left").fillna(0.0, ["v"])
    return C._described(distribution.describe(rows, ["cohort", "grp"], "v"), ["cohort", "grp"])
