"""Registered queries and the same computations as SQL for DuckDB."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import activity, cohorts, diagnostics, distribution, exposure, field, randoms, sensors, staypoints, workoutdoor
from ..operators.staging import staged
from ..sources import adapters as A

FLAGSHIP = "daily_exposure_by_person"
QUERIES: dict = {}
ORACLES: dict[str, str] = {}
BOX = (-71.3, -70.82, 42.2, 42.59)
SLOTS = [30 * k for k in range(48)]
CELL = 0.025
COHORTS = {"income": {"low": "income < 60000", "high": "income >= 120000"}, "race": {"a": "race = 'a'", "b": "race = 'b'"}, "work": {"all_workers": "industry is not null and industry <> 'not_working'"}}
WINDOWS = {"early_morning": (0, 6), "morning_commute": (6, 9), "midday": (11, 14), "evening_commute": (16, 19), "night": (19, 24)}
LEVELS = (35.0, 55.0, 75.0)
FALLBACK = 240.0


def query(oracle: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if oracle:
            ORACLES[f.__name__] = A.duck(oracle)
        return f

    return add


def _r(c, digits: int):
    return F.round(c, digits)


def rounded(df: DataFrame, digits: int = 9) -> DataFrame:
    """Doubles to nine decimals: engines differ in the last bits."""
    return df.select(*[_r(c, digits).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


def trips(spark: SparkSession, d: str) -> DataFrame:
    return A.frame(spark, d, A.TRIPS)


def persons(spark: SparkSession, d: str) -> DataFrame:
    """(person_id, p_outdoor): the probability to work outdoors, from industry and occupation tables."""
    return workoutdoor.assign(A.frame(spark, d, A.PERSONS), sector_table(spark, d)).select("person_id", "p_outdoor")


def stays(spark: SparkSession, d: str) -> DataFrame:
    """Stay points of persons whose day adds up, with microenvironments."""
    return staypoints.with_microenvironment(staypoints.stay_points(trips(spark, d), activity.TOLERANCE))


def extent(spark: SparkSession, d: str) -> tuple | None:
    """(west, east, south, north) of all trips' ends and homes: one pass over the trips as they are, four numbers."""
    ends = [(f(g(f"dest_{x}", f"home_{x}"))) for x in ("lon", "lat") for f, g in ((F.min, F.least), (F.max, F.greatest))]
    out = trips(spark, d).agg(*[e.alias(f"e{k}") for k, e in enumerate(ends)]).head()
    return (0.0, 0.0, 0.0, 0.0) if None in out else tuple(out)  # no trips


def detailed(spark: SparkSession, d: str, rule: str = "mid-point-hapem", bands: tuple = ("",), of: DataFrame | None = None, box: tuple | None = None, kept: tuple = ()) -> DataFrame:
    """Exposure of every piece of every stay; bands may add _low and _high; of: other stays than those of the clean trips; box: where their places lie; kept: factors that stay."""
    box = box or extent(spark, d)
    # factors belong to stays: pieces, some four a stay, carry them along
    pieces = staypoints.split_intervals(exposure.with_factor(stays(spark, d) if of is None else of, exposure.person_factors(persons(spark, d)), kept))
    pieces = staypoints.travel_halves(pieces) if rule.startswith("mid-point") else pieces.withColumn("half", F.lit(0))
    rows = field.lookup(pieces, A.frame(spark, d, A.FIELD), SLOTS, [s[1:] or "mid" for s in bands], CELL, extent=box).withColumnsRenamed({s[1:] or "mid": f"concentration{s}" for s in bands})
    if rule == "home_exposure":
        rows = field.nearest_within(rows, A.frame(spark, d, A.FIELD), ["mid"], CELL, box, ("home_lon", "home_lat"), "_home_", F.col("location_type") == "travel").withColumnRenamed("_home_mid", "home_concentration")
    rows = exposure.apply_factors(rows, [f"concentration{s}" for s in bands])
    for s in bands:
        rows = exposure.with_exposure(rows, rule, suffix=s)
    return rows


SQL_SOC = f"onet AS ({A.ONET}), each AS (SELECT soc, element, sum(CASE WHEN category >= 4 THEN value ELSE 0 END) / 100 p FROM onet WHERE scale_id = 'CXP' GROUP BY soc, element), shares AS (SELECT replace(soc, '.00', '') soc, 1 - (1 - max(CASE WHEN element = 0 THEN p END)) * (1 - max(CASE WHEN element = 1 THEN p END)) share FROM each GROUP BY soc HAVING count(*) = 2)"
SQL_SECTOR = f"{SQL_SOC}, oews AS ({A.OEWS}), emp AS (SELECT substr(naics, 1, 2) sector, soc, sum(CAST(tot_emp AS DOUBLE)) employment FROM oews WHERE o_group = 'detailed' AND tot_emp <> '**' GROUP BY 1, 2), tot AS (SELECT sector, sum(employment) total FROM emp GROUP BY sector), sectors AS (SELECT sector, sum(employment / total * share) p_outdoor, max(total) total FROM emp JOIN tot USING (sector) JOIN shares USING (soc) GROUP BY sector)"
_TEXT = "lower(trim(industry))"
SQL_ASSIGN = f"""{SQL_SECTOR}, people3 AS ({A.PERSONS}),
parsed AS (SELECT person_id, CASE WHEN {_TEXT} IS NULL OR {_TEXT} IN ('', 'nan', 'not_working') THEN NULL
             WHEN starts_with({_TEXT}, 'naics31_33') THEN '31_33' WHEN starts_with({_TEXT}, 'naics44_45') THEN '44_45' WHEN starts_with({_TEXT}, 'naics48_49') THEN '48_49'
             ELSE nullif(substr(regexp_extract({_TEXT}, '([0-9]{{2,6}})', 1), 1, 2), '') END grp, {_TEXT} t FROM people3),
grouped AS (SELECT person_id, grp, CASE WHEN t IS NULL OR t IN ('', 'nan') THEN 'missing' WHEN t = 'not_working' THEN 'not_working' WHEN grp IS NULL THEN 'unparsed' ELSE 'ok' END reason FROM parsed),
spans AS (SELECT grp, CAST(unnest(generate_series(CAST(split_part(grp, '_', 1) AS INTEGER), CAST(split_part(grp, '_', -1) AS INTEGER))) AS VARCHAR) sector FROM (SELECT DISTINCT grp FROM grouped WHERE grp IS NOT NULL) q),
probs AS (SELECT grp, sum(p_outdoor * total) / sum(total) p FROM spans JOIN sectors USING (sector) GROUP BY grp),
assigned AS (SELECT person_id, grouped.grp, CASE WHEN reason = 'ok' AND p IS NULL THEN CASE WHEN contains(grouped.grp, '_') THEN 'unmapped_combined_group' ELSE 'sector_not_covered' END ELSE reason END reason, p p_outdoor
             FROM grouped LEFT JOIN probs ON grouped.grp = probs.grp)"""


SQL_STAYS_OF = """t AS (SELECT *, row_number() OVER w n, lead(start_s) OVER w IS NULL l, lag(end_s) OVER w p_end, lag(dest_lon) OVER w p_lon, lag(dest_lat) OVER w p_lat, lag(purpose) OVER w p_purpose, lag(mode) OVER w p_mode
      FROM trips WINDOW w AS (PARTITION BY person_id ORDER BY start_s, end_s)),
all_stays AS (SELECT * FROM (
  SELECT person_id, n * 4 seq, 'origin' location_type, orig_lon lon, orig_lat lat, 0 start_s, start_s end_s, start_s / 3600e0 duration_hours, 'pre_' || purpose activity_type, purpose, mode, NULL o_lon, NULL o_lat, NULL d_lon, NULL d_lat, home_lon, home_lat FROM t WHERE n = 1
  UNION ALL SELECT person_id, n * 4 + 1, 'origin', p_lon, p_lat, p_end, start_s, (start_s - p_end) / 3600e0, 'stay_' || p_purpose, p_purpose, p_mode, NULL, NULL, NULL, NULL, home_lon, home_lat FROM t WHERE n > 1
  UNION ALL SELECT person_id, n * 4 + 2, 'travel', (orig_lon + dest_lon) / 2, (orig_lat + dest_lat) / 2, start_s, end_s, declared_minutes / 60e0, 'travel_' || purpose, purpose, mode, orig_lon, orig_lat, dest_lon, dest_lat, home_lon, home_lat FROM t
  UNION ALL SELECT person_id, n * 4 + 3, 'destination', dest_lon, dest_lat, end_s, 86399, (86399 - end_s) / 3600e0, 'post_' || purpose, purpose, mode, NULL, NULL, NULL, NULL, home_lon, home_lat FROM t WHERE l) u
  WHERE duration_hours > 0),
late AS (SELECT person_id, sum(duration_hours) total_hours, count(*) FILTER (WHERE location_type = 'travel') n FROM all_stays GROUP BY person_id HAVING abs(sum(duration_hours) - 24) > 0.1),
placed AS (SELECT *, CASE WHEN location_type <> 'travel' THEN 2 * 6371000e0 * atan2(sqrt(a), sqrt(1 - a)) END dist_to_home_m
           FROM (SELECT *, sin(radians(home_lat - lat) / 2) ** 2 + cos(radians(lat)) * cos(radians(home_lat)) * sin(radians(home_lon - lon) / 2) ** 2 a FROM all_stays WHERE person_id NOT IN (SELECT person_id FROM late)) q),
stays AS (SELECT * EXCLUDE (a), CASE WHEN location_type = 'travel' THEN CASE WHEN mode IN ('private_auto', 'auto_passenger', 'on_demand_auto') THEN 'in_vehicle_on_road_private' WHEN mode = 'public_transit' THEN 'in_vehicle_on_road_transit' WHEN mode IN ('walking', 'biking') THEN 'outdoor_near_road' ELSE 'travel_unknown' END
            WHEN dist_to_home_m <= 100 THEN 'home_indoor' WHEN purpose = 'work' THEN 'work_indoor' WHEN purpose = 'school' THEN 'school_indoor' ELSE 'other_indoor' END microenv FROM placed),
pieces AS (SELECT * EXCLUDE (start_s, end_s, duration_hours, p, e0), p piece, p0 start_s, least(p0 + 1800, e0) end_s, (least(p0 + 1800, e0) - p0) / 3600e0 duration_hours
           FROM (SELECT *, end_s e0, start_s + p * 1800 p0 FROM (SELECT *, unnest(generate_series(0, CAST(ceil((end_s - start_s) / 1800e0) AS BIGINT) - 1)) p FROM stays WHERE end_s > start_s) x) y)"""
SQL_STAYS = f"trips AS ({A.TRIPS}), {SQL_STAYS_OF}"

SQL_HALVES = """halves AS (
  SELECT person_id, seq, piece, 0 half, location_type, lon, lat, CAST(start_s AS DOUBLE) start_s, CAST(end_s AS DOUBLE) end_s, duration_hours, microenv, home_lon, home_lat FROM pieces WHERE location_type <> 'travel'
  UNION ALL SELECT person_id, seq, piece, 0, location_type, o_lon, o_lat, start_s, (start_s + end_s) / 2e0, duration_hours / 2, microenv, home_lon, home_lat FROM pieces WHERE location_type = 'travel'
  UNION ALL SELECT person_id, seq, piece, 1, location_type, d_lon, d_lat, (start_s + end_s) / 2e0, end_s, duration_hours / 2, microenv, home_lon, home_lat FROM pieces WHERE location_type = 'travel')"""
SQL_WHOLE = "halves AS (SELECT person_id, seq, piece, 0 half, location_type, lon, lat, CAST(start_s AS DOUBLE) start_s, CAST(end_s AS DOUBLE) end_s, duration_hours, microenv, home_lon, home_lat FROM pieces)"
SQL_SLOT = "CAST(30 * least(greatest(ceil(floor(start_s / 60) / 30e0 - 0.5e0), 0), 47) AS INTEGER)"


def sql_detailed(rule: str = "mid-point-hapem", band: str = "mid", stays: str | None = None) -> str:
    value = {
        "mid-point-teleportation": "c * 10", "mid-point-hapem": "c * 0.9e0 * 1.2e0", "centroid_ambient": "c", "hardcoded": "10e0", "home_exposure": "coalesce(hc, 10e0)",
        "origin_destination_mean": "coalesce((lag(c) OVER w + lead(c) OVER w) / 2, lag(c) OVER w, lead(c) OVER w, 10e0)",
    }[rule]
    split = SQL_HALVES if rule.startswith("mid-point") else SQL_WHOLE
    return f"""WITH {SQL_ASSIGN}, {stays or SQL_STAYS}, {split},
slotted AS (SELECT *, {SQL_SLOT} slot FROM halves), field AS ({A.FIELD}),
near AS (SELECT p.lon, p.lat, p.slot, arg_min({band}, (p.lon - f.lon) ** 2 + (p.lat - f.lat) ** 2) mid
         FROM (SELECT lon, lat, slot FROM slotted UNION SELECT home_lon, home_lat, slot FROM slotted) p JOIN field f ON p.slot = f.slot GROUP BY p.lon, p.lat, p.slot),
factored AS (SELECT s.*, n.mid * CASE s.microenv WHEN 'work_indoor' THEN (q * 1 + (1 - q) * 0.385e0) * (q * 1.803e0 + (1 - q) * 1) WHEN 'school_indoor' THEN 0.385e0 WHEN 'home_indoor' THEN 0.385e0 ELSE 1 END c, h.mid hc
             FROM slotted s JOIN near n ON s.lon = n.lon AND s.lat = n.lat AND s.slot = n.slot JOIN near h ON s.home_lon = h.lon AND s.home_lat = h.lat AND s.slot = h.slot
             LEFT JOIN (SELECT person_id, coalesce(p_outdoor, 0e0) q FROM assigned) f ON f.person_id = s.person_id),
detailed AS (SELECT *, coalesce(CASE WHEN location_type = 'travel' THEN te END, c) rate, coalesce(CASE WHEN location_type = 'travel' THEN te END, c) * duration_hours exposure
             FROM (SELECT *, {value} te FROM factored WINDOW w AS (PARTITION BY person_id ORDER BY seq, piece, half)) v)"""


SQL_TOTALS = "totals AS (SELECT person_id, sum(exposure) total_exposure, sum(duration_hours) duration_hours FROM detailed GROUP BY person_id)"
_TOTAL = "SELECT person_id, round(total_exposure, 9) total_exposure, round(duration_hours, 9) duration_hours FROM totals"


@query(f"{sql_detailed()}, {SQL_TOTALS} {_TOTAL}")
def daily_exposure_by_person(spark, d):
    return rounded(exposure.totals(detailed(spark, d)))


_NUMBER = "CASE WHEN regexp_matches(trim({0}), '^[+-]?([0-9]+\\.?[0-9]*|\\.[0-9]+)([eE][+-]?[0-9]+)?$') THEN CAST(trim({0}) AS DOUBLE) END {0}"
_SECONDS = """CASE WHEN regexp_matches({0}_time, '^[0-9]{{1,2}}:[0-9]{{2}}:[0-9]{{2}}$') AND CAST(split_part({0}_time, ':', 1) AS INTEGER) < 24
  THEN CAST(split_part({0}_time, ':', 1) AS INTEGER) * 3600 + CAST(split_part({0}_time, ':', 2) AS INTEGER) * 60 + CAST(split_part({0}_time, ':', 3) AS INTEGER) END {0}_s"""
_FAR = " OR ".join(f"coalesce(NOT ({p}_lon BETWEEN {BOX[0]}e0 AND {BOX[1]}e0 AND {p}_lat BETWEEN {BOX[2]}e0 AND {BOX[3]}e0), true)" for p in activity.PLACES)
_NONE = " OR ".join(f"{p}_lon IS NULL OR {p}_lat IS NULL" for p in activity.PLACES)
SQL_USABLE = f"""numbered_trips AS (SELECT person_id, purpose, mode, {", ".join(_NUMBER.format(c) for c in ("orig_lon", "orig_lat", "dest_lon", "dest_lat", "home_lon", "home_lat", "declared_minutes"))},
  {_SECONDS.format("start")}, {_SECONDS.format("end")} FROM ({A.RAW_TRIPS}) raw_trips),
trips AS (SELECT * FROM numbered_trips WHERE person_id NOT IN (SELECT person_id FROM numbered_trips WHERE {_FAR}) AND start_s IS NOT NULL AND end_s IS NOT NULL)"""


@query(f"{sql_detailed(stays=f'{SQL_USABLE}, {SQL_STAYS_OF}')}, {SQL_TOTALS} {_TOTAL}")
def exposure_from_raw(spark, d):
    """From trips as delivered: cells cleaned, persons with unknown or far places dropped, unreadable times dropped, then as the flagship."""
    usable = activity.usable(activity.cleaned(A.frame(spark, d, A.RAW_TRIPS)), BOX)
    day = staypoints.with_microenvironment(staypoints.stay_points(usable, activity.TOLERANCE))
    return rounded(exposure.totals(detailed(spark, d, of=day, box=BOX)))


_TIMED = "timed AS (SELECT * FROM numbered_trips WHERE start_s IS NOT NULL AND end_s IS NOT NULL)"
_ONLY_STAYS = SQL_STAYS_OF[: SQL_STAYS_OF.index("late AS (")].replace("FROM trips WINDOW", "FROM timed WINDOW").rstrip().rstrip(",")


@query(f"""WITH {SQL_USABLE}, {_TIMED}, {_ONLY_STAYS},
hours AS (SELECT person_id, sum(duration_hours) h FROM all_stays GROUP BY person_id),
flags AS (SELECT person_id, bool_or({_NONE}) no_place, bool_or({_FAR}) far, count(*) FILTER (WHERE start_s IS NOT NULL AND end_s IS NOT NULL) n FROM numbered_trips GROUP BY person_id)
SELECT CASE WHEN no_place THEN 'nan_coords_or_non_numeric' WHEN far THEN 'outside_bbox' WHEN n = 0 THEN 'no_readable_times'
            WHEN coalesce(abs(h - 24) > 0.1, true) THEN 'time_mismatch' ELSE 'kept' END reason, count(*) persons
FROM flags LEFT JOIN hours USING (person_id) GROUP BY 1""")
def audit_counts(spark, d):
    return activity.audit_counts(activity.cleaned(A.frame(spark, d, A.RAW_TRIPS)), BOX)


def _mode(rule: str, letter: str) -> None:
    def run(spark, d):
        return rounded(exposure.totals(detailed(spark, d, rule)))

    run.__name__ = f"travel_mode_{letter}"
    query(f"{sql_detailed(rule)}, {SQL_TOTALS} {_TOTAL}")(run)


for _rule, _letter in zip(exposure.TRAVEL_RULES, "abcdef"):
    _mode(_rule, _letter)


_CLEAN = "CASE WHEN regexp_matches(trim({0}), '^[+-]?([0-9]+\\.?[0-9]*|\\.[0-9]+)([eE][+-]?[0-9]+)?$') THEN CAST(trim({0}) AS DOUBLE) END {0}"
SQL_CLEAN = f"""WITH raw AS ({A.RAW_TRIPS}), clean AS (SELECT person_id, rn, {', '.join(_CLEAN.format(c) for c in ('dest_lon', 'dest_lat', 'home_lon', 'home_lat'))},
  CASE WHEN regexp_matches(start_time, '^[0-9]{{1,2}}:[0-9]{{2}}:[0-9]{{2}}$') AND CAST(split_part(start_time, ':', 1) AS INTEGER) < 24 THEN CAST(split_part(start_time, ':', 1) AS INTEGER) * 3600 + CAST(split_part(start_time, ':', 2) AS INTEGER) * 60 + CAST(split_part(start_time, ':', 3) AS INTEGER) END start_s FROM raw)"""


def cleaned(spark, d):
    raw = A.frame(spark, d, A.RAW_TRIPS)
    return raw.select("person_id", "rn", *[activity.clean_number(F.col(c)).alias(c) for c in ("dest_lon", "dest_lat", "home_lon", "home_lat")], activity.seconds_of_day(F.col("start_time")).alias("start_s"))


@query(f"{SQL_CLEAN} SELECT * FROM clean")
def clean_cast(spark, d):
    return cleaned(spark, d)


_OUT = "bool_or(coalesce(NOT ({0}_lon BETWEEN -71.3e0 AND -70.82e0 AND {0}_lat BETWEEN 42.2e0 AND 42.59e0), true)) {0}_outside"


@query(f"{SQL_CLEAN}, f AS (SELECT person_id, {_OUT.format('dest')}, {_OUT.format('home')} FROM clean GROUP BY person_id) SELECT *, CASE WHEN dest_outside OR home_outside THEN 'kicked_out' ELSE 'retained' END status FROM f")
def bbox_audit(spark, d):
    return activity.bbox_audit(cleaned(spark, d), ["dest", "home"], BOX)


@query(f"{SQL_CLEAN}, f AS (SELECT person_id, {_OUT.format('dest')}, {_OUT.format('home')} FROM clean GROUP BY person_id) SELECT clean.* FROM clean JOIN f USING (person_id) WHERE NOT dest_outside AND NOT home_outside")
def bbox_exclusion(spark, d):
    return activity.exclude_outside(cleaned(spark, d), ["dest", "home"], BOX)


@query(f"{SQL_CLEAN}, {SQL_STAYS}, bad AS (SELECT DISTINCT person_id FROM clean WHERE dest_lon IS NULL OR home_lon IS NULL) SELECT person_id, 'nan_coords_or_non_numeric' reason, CAST(NULL AS DOUBLE) total_hours, CAST(NULL AS BIGINT) n FROM bad UNION ALL SELECT person_id, 'time_mismatch', round(total_hours, 9), n FROM late WHERE person_id NOT IN (SELECT person_id FROM bad)")
def rejected_persons(spark, d):
    return rounded(activity.rejections(staypoints.stay_points(trips(spark, d)), cleaned(spark, d).filter("dest_lon is null or home_lon is null")))


_STAY = "person_id, seq, location_type, round(lon, 9) lon, round(lat, 9) lat, CAST(start_s AS BIGINT) start_s, CAST(end_s AS BIGINT) end_s, round(duration_hours, 9) duration_hours, activity_type, purpose, mode, round(dist_to_home_m, 5) dist_to_home_m, microenv"


@query(f"WITH {SQL_STAYS} SELECT {_STAY} FROM stays")
def stay_points(spark, d):
    out = stays(spark, d).select("person_id", "seq", "location_type", "lon", "lat", "start_s", "end_s", "duration_hours", "activity_type", "purpose", "mode", "dist_to_home_m", "microenv")
    return rounded(out.withColumn("dist_to_home_m", _r("dist_to_home_m", 5)))


@query(f"WITH {SQL_STAYS} SELECT microenv, purpose, count(*) n, round(sum(duration_hours), 6) AS hours FROM stays GROUP BY microenv, purpose")
def microenv_counts(spark, d):
    return rounded(stays(spark, d).groupBy("microenv", "purpose").agg(F.count(F.lit(1)).alias("n"), F.sum("duration_hours").alias("hours")), 6)


@query(f"WITH {SQL_STAYS} SELECT person_id, seq, CAST(piece AS BIGINT) piece, CAST(start_s AS BIGINT) start_s, CAST(end_s AS BIGINT) end_s, round(duration_hours, 9) duration_hours FROM pieces")
def split_segments(spark, d):
    return rounded(staypoints.split_intervals(stays(spark, d)).select("person_id", "seq", "piece", "start_s", "end_s", "duration_hours"))


@query(f"WITH {SQL_STAYS}, {SQL_HALVES} SELECT person_id, seq, CAST(piece AS BIGINT) piece, half, round(lon, 9) lon, round(lat, 9) lat, round(start_s, 3) start_s, round(end_s, 3) end_s, round(duration_hours, 9) duration_hours FROM halves")
def travel_halves(spark, d):
    return rounded(staypoints.travel_halves(staypoints.split_intervals(stays(spark, d))).select("person_id", "seq", "piece", "half", "lon", "lat", "start_s", "end_s", "duration_hours"))


@query(f"WITH {SQL_STAYS}, {SQL_WHOLE}, p AS (SELECT DISTINCT lon, lat, {SQL_SLOT} slot FROM halves), field AS ({A.FIELD}) SELECT round(p.lon, 9) lon, round(p.lat, 9) lat, p.slot, round(arg_min(mid, (p.lon - f.lon) ** 2 + (p.lat - f.lat) ** 2), 9) mid, round(min(sqrt((p.lon - f.lon) ** 2 + (p.lat - f.lat) ** 2)), 9) distance FROM p JOIN field f ON p.slot = f.slot GROUP BY p.lon, p.lat, p.slot")
def nearest_field(spark, d):
    at = staypoints.split_intervals(stays(spark, d)).withColumn("slot", field.nearest_slot(F.floor(F.col("start_s") / 60).cast("int"), SLOTS))
    return rounded(field.nearest_join(at, A.frame(spark, d, A.FIELD), ["mid"], CELL))


@query(f"WITH {SQL_ASSIGN}, f AS (SELECT person_id, coalesce(p_outdoor, 0e0) q FROM assigned) SELECT person_id, q >= 0.5 work_outdoor, round(q + (1 - q) * 0.385e0, 9) work_pen, round(q * 1.803e0 + 1 - q, 9) work_prox, 0.385e0 school_pen, 1e0 school_prox, 0.385e0 home_pen, 1e0 home_prox FROM f")
def person_factors(spark, d):
    return rounded(exposure.person_factors(persons(spark, d)))


def _sql_drawn(k: int, place: str, factor: str) -> str:
    outside, inside = (exposure.FACTORS[x][factor] for x in exposure.PLACES[place])
    one = lambda gm, gsd: f"{gm}e0" if gsd == 1 else f"exp(ln({gm}e0) + ln({gsd}e0) * {randoms.sql_normal(1, 'person_id', counter=k)})"
    flag = {"work": "work_outdoor", "school": "false", "home": "false"}[place]
    return f"round(CASE WHEN {flag} THEN {one(*outside)} ELSE {one(*inside)} END, 9) {place}_{factor}"


_DRAWN = ", ".join(_sql_drawn(k, place, factor) for k, (place, factor) in enumerate(((p, f) for p in ("work", "school", "home") for f in ("pen", "prox")), 1))


@query(f"WITH {SQL_ASSIGN}, f AS (SELECT person_id, {randoms.sql_uniform(1, 'person_id')} < coalesce(p_outdoor, 0e0) work_outdoor FROM assigned) SELECT person_id, work_outdoor, {_DRAWN} FROM f")
def stochastic_factors(spark, d):
    return rounded(exposure.sampled_factors(persons(spark, d), seed=1))


@query(f"""WITH {SQL_ASSIGN}, f AS (SELECT person_id, coalesce(p_outdoor, 0e0) q, {randoms.sql_uniform(1, 'person_id')} < coalesce(p_outdoor, 0e0) work_outdoor FROM assigned),
dr AS (SELECT person_id, q, work_outdoor, {_DRAWN} FROM f)
SELECT CAST(floor(q * 10) AS INTEGER) tenth, count(*) n, round(avg(q), 9) expected_share, round(avg(CASE WHEN work_outdoor THEN 1e0 ELSE 0e0 END), 9) outdoor_share, round(avg(work_pen), 7) mean_work_pen, round(avg(work_prox), 7) mean_work_prox, round(avg(ln(home_pen)), 7) mean_log_home_pen, round(stddev_samp(ln(home_pen)), 7) sd_log_home_pen FROM dr GROUP BY 1""")
def stochastic_factors_law(spark, d):
    """Drawn factors against what they are drawn from, by tenths of the probability to work outdoors."""
    drawn = rounded(exposure.sampled_factors(persons(spark, d), seed=1))
    p = persons(spark, d).groupBy("person_id").agg(F.coalesce(F.min("p_outdoor"), F.lit(0.0)).alias("q"))
    rows = drawn.join(p, "person_id").withColumn("l", F.log("home_pen"))
    share = F.avg(F.when(F.col("work_outdoor"), 1.0).otherwise(0.0))
    out = rows.groupBy(F.floor(F.col("q") * 10).cast("int").alias("tenth")).agg(F.count(F.lit(1)).alias("n"), _r(F.avg("q"), 9).alias("expected_share"), _r(share, 9).alias("outdoor_share"), F.avg("work_pen").alias("mean_work_pen"), F.avg("work_prox").alias("mean_work_prox"), F.avg("l").alias("mean_log_home_pen"), F.stddev_samp("l").alias("sd_log_home_pen"))
    return out.withColumns({c: _r(c, 7) for c in out.columns[4:]})


SQL_HOME = "first_origin AS (SELECT person_id, arg_min(c, start_s * 1000 + seq) c FROM detailed WHERE location_type = 'origin' GROUP BY person_id)"


@query(f"{sql_detailed()}, {SQL_HOME} SELECT person_id, round(c * 24, 9) home FROM first_origin")
def home_static(spark, d):
    return rounded(exposure.first_origin(detailed(spark, d)).select("person_id", (F.col("concentration") * 24).alias("home")))


SQL_HOME_DAY = f"homes AS (SELECT DISTINCT person_id, home_lon, home_lat FROM stays), home_near AS (SELECT h.home_lon, h.home_lat, f.slot, arg_min(mid, (h.home_lon - f.lon) ** 2 + (h.home_lat - f.lat) ** 2) mid FROM (SELECT DISTINCT home_lon, home_lat FROM homes) h CROSS JOIN field f GROUP BY h.home_lon, h.home_lat, f.slot), home_day AS (SELECT person_id, sum(mid * 0.385e0 * 0.5e0) home FROM homes JOIN home_near USING (home_lon, home_lat) GROUP BY person_id)"


def field_of_day(spark, d, places: DataFrame) -> DataFrame:
    """(lon, lat, mid): the field of all slots summed at each distinct place."""
    every = places.select("lon", "lat").distinct().withColumn("slot", F.explode(F.array(*[F.lit(s) for s in SLOTS])))
    return field.nearest_join(every, A.frame(spark, d, A.FIELD), ["mid"], CELL).groupBy("lon", "lat").agg(F.sum("mid").alias("mid"))


def home_day(spark, d, of: DataFrame | None = None):
    """Exposure of a day at home: the field at home in every slot, times the home factor; of: stays that are at hand."""
    homes = (stays(spark, d) if of is None else of).select("person_id", F.col("home_lon").alias("lon"), F.col("home_lat").alias("lat")).distinct()
    day = field_of_day(spark, d, homes)
    factors = exposure.person_factors(persons(spark, d))
    return homes.join(day, ["lon", "lat"]).join(factors, "person_id").select("person_id", (F.col("mid") * F.col("home_pen") * F.col("home_prox") * 0.5).alias("home"))


@query(f"WITH {SQL_STAYS}, field AS ({A.FIELD}), {SQL_HOME_DAY} SELECT person_id, round(home, 9) home FROM home_day")
def home_dynamic(spark, d):
    return rounded(home_day(spark, d))


SQL_COMPARE = f"{sql_detailed()}, {SQL_TOTALS}, {SQL_HOME_DAY}, compared AS (SELECT t.person_id, total_exposure activity, coalesce(home, {FALLBACK}) home, total_exposure - coalesce(home, {FALLBACK}) delta, total_exposure / coalesce(home, {FALLBACK}) ratio FROM totals t LEFT JOIN home_day h ON t.person_id = h.person_id)"


def days(spark, d):
    """(person_id, total_exposure, duration_hours, home): each person's day and the same day at home, from one pass over the rows.

    The sums of a person's rows take the home's place and factors along, so neither stays nor persons are made, written or dealt again for the home.
    """
    factors = ("home_pen", "home_prox")
    each = exposure.totals(detailed(spark, d, kept=factors), carried=("home_lon", "home_lat", *factors))
    each = staged(each.withColumnsRenamed({"home_lon": "lon", "home_lat": "lat"}), "days")
    home = F.col("mid") * F.col("home_pen") * F.col("home_prox") * 0.5
    return each.join(field_of_day(spark, d, each), ["lon", "lat"], "left").select("person_id", "total_exposure", "duration_hours", home.alias("home"))


def compared(spark, d):
    return exposure.compare(days(spark, d), None, FALLBACK)


@query(f"{SQL_COMPARE} SELECT person_id, round(activity, 9) activity, round(home, 9) home, round(delta, 7) delta, round(ratio, 9) ratio FROM compared")
def comparison(spark, d):
    # some differences end on ties at nine decimals, which the order of summation would settle
    return rounded(compared(spark, d).withColumn("delta", _r("delta", 7)))


@query(f"{SQL_COMPARE} SELECT count(*) n, round(min(activity), 6) min_activity, round(max(activity), 6) max_activity, round(avg(activity), 6) mean_activity, round(avg(activity) / avg(home), 9) ratio_of_means FROM compared")
def global_summary(spark, d):
    out = compared(spark, d).agg(F.count(F.lit(1)).alias("n"), F.min("activity").alias("min_activity"), F.max("activity").alias("max_activity"), F.avg("activity").alias("mean_activity"), (F.avg("activity") / F.avg("home")).alias("ratio_of_means"))
    return out.withColumns({c: _r(c, 9 if c == "ratio_of_means" else 6) for c in out.columns if c != "n"})


SQL_BINS = "bins AS (SELECT person_id, b bin_index, sum(rate * (least(end_s, (b + 1) * 300) - greatest(start_s, b * 300)) / 3600) amount FROM (SELECT *, unnest(generate_series(CAST(floor(start_s / 300) AS INTEGER), CAST(greatest(ceil(end_s / 300) - 1, floor(start_s / 300)) AS INTEGER))) b FROM detailed) x GROUP BY person_id, b)"
SQL_CURVES = f"{SQL_BINS}, curves AS (SELECT p.person_id, g.range bin_index, coalesce(amount, 0) increment, sum(coalesce(amount, 0)) OVER (PARTITION BY p.person_id ORDER BY g.range) cumulative FROM (SELECT DISTINCT person_id FROM detailed) p CROSS JOIN range(288) g LEFT JOIN bins ON bins.person_id = p.person_id AND bins.bin_index = g.range)"


def curve_rows(spark, d, suffixes=("",), home=None, carried=None, **form):
    return exposure.curves(detailed(spark, d, bands=suffixes), suffixes=suffixes, home=home, slots=SLOTS, carried=carried, **form)


def curve_statistics(spark, d, values, quantiles):
    """Statistics of each bin over all persons; only each person's list of increments is staged, cumulative curves follow from it."""
    lists = staged(curve_rows(spark, d, listed=True, kinds=("increment",)).select("increment"), "increments")
    return distribution.summarise_lists(lists, values, 288, quantiles, {"cumulative": "increment"})


@query(f"{sql_detailed()}, {SQL_CURVES} SELECT CAST(bin_index AS INTEGER) bin_index, round(avg(increment), 8) mean_increment, round(median(increment), 8) median_increment, round(avg(cumulative), 7) mean_cumulative, round(median(cumulative), 7) median_cumulative FROM curves GROUP BY bin_index")
def timeseries_agg(spark, d):
    of = ["increment", "cumulative"]
    long = curve_statistics(spark, d, of, {"median": 0.5})
    out = long.groupBy("bin_index").agg(*[F.max(F.when(F.col("column") == c, F.col(k))).alias(f"{k}_{c}") for c in of for k in ("mean", "median")])
    return out.select("bin_index", *[_r(f"{c}_{k}", 8 if k == "increment" else 7).alias(f"{c}_{k}") for k in of for c in ("mean", "median")])


BANDS_AT = {"p025": 0.025, "p05": 0.05, "p25": 0.25, "p50": 0.5, "p75": 0.75, "p95": 0.95, "p975": 0.975}
_BAND_SQL = ", ".join(f"round(quantile_cont(cumulative, {q}), 7) {n}" for n, q in BANDS_AT.items())


@query(f"{sql_detailed()}, {SQL_CURVES} SELECT CAST(bin_index AS INTEGER) bin_index, {_BAND_SQL} FROM curves GROUP BY bin_index")
def curve_bands(spark, d):
    return rounded(curve_statistics(spark, d, ["cumulative"], BANDS_AT).select("bin_index", *BANDS_AT), 7)


@query(f"{sql_detailed()}, {SQL_CURVES} SELECT person_id, CAST(bin_index AS INTEGER) bin_index, round(increment, 8) increment, round(cumulative, 6) cumulative FROM curves")
def timeseries_person(spark, d):
    return curve_rows(spark, d).select("person_id", "bin_index", _r("increment", 8).alias("increment"), _r("cumulative", 6).alias("cumulative"))


SQL_COHORTS = f"people2 AS ({A.PERSONS}), members AS (" + " UNION ALL ".join(f"SELECT person_id, '{c}' cohort, '{g}' grp FROM people2 WHERE {p}" for c, of in COHORTS.items() for g, p in of.items()) + ")"


def members(spark, d):
    return cohorts.membership(A.frame(spark, d, A.PERSONS), COHORTS)


@query(f"WITH {SQL_COHORTS} SELECT * FROM members")
def cohort_membership(spark, d):
    return members(spark, d)


def _described(df, keys, digits=7):
    return df.select(*keys, "n", *[_r(c, digits).alias(c) for c in ("mean", "median", "std", "min", "max", "p25", "p75")])


def _sql_described(table: str, keys: str, value: str, digits: int = 7) -> str:
    stats = {"mean": "avg({v})", "median": "median({v})", "std": "coalesce(stddev_samp({v}), 0)", "min": "min({v})", "max": "max({v})", "p25": "quantile_cont({v}, 0.25)", "p75": "quantile_cont({v}, 0.75)"}
    return f"SELECT {keys}, count(*) n, " + ", ".join(f'round({e.format(v=value)}, {digits}) "{n}"' for n, e in stats.items()) + f" FROM {table} WHERE {value} IS NOT NULL GROUP BY {keys}"


_LONG = "long AS (SELECT cohort, grp, 'activity' metric, activity v FROM compared JOIN members USING (person_id) UNION ALL SELECT cohort, grp, 'home', home FROM compared JOIN members USING (person_id) UNION ALL SELECT cohort, grp, 'ratio', ratio FROM compared JOIN members USING (person_id))"


@query(f"{SQL_COMPARE}, {SQL_COHORTS}, {_LONG} " + _sql_described("long", "cohort, grp, metric", "v"))
def cohort_daily(spark, d):
    rows = compared(spark, d).join(members(spark, d), "person_id")
    return _described(distribution.described(rows, ["cohort", "grp"], ["activity", "home", "ratio"]).withColumnRenamed("column", "metric"), ["cohort", "grp", "metric"])


_SUMS = ", ".join(f"sum(CASE WHEN bin_index >= {a * 12} AND bin_index < {b * 12} THEN amount ELSE 0 END) {n}" for n, (a, b) in WINDOWS.items())
_WLONG = "wlong AS (" + " UNION ALL ".join(f"SELECT cohort, grp, '{n}' win, coalesce({n}, 0) v FROM members LEFT JOIN wins USING (person_id)" for n in WINDOWS) + ")"


@query(f"{sql_detailed()}, {SQL_BINS}, {SQL_COHORTS}, wins AS (SELECT person_id, {_SUMS} FROM bins GROUP BY person_id), {_WLONG} " + _sql_described("wlong", "cohort, grp, win", "v"))
def cohort_windows(spark, d):
    sums = exposure.in_windows(detailed(spark, d), WINDOWS)  # windows begin and end with bins
    each = members(spark, d).join(sums, "person_id", "left").fillna(0.0, list(WINDOWS))
    return _described(distribution.described(each, ["cohort", "grp"], list(WINDOWS)).withColumnRenamed("column", "win"), ["cohort", "grp", "win"])


@query(f"{sql_detailed()}, {SQL_COHORTS}, peaks AS (SELECT cohort, grp, coalesce(p.v, 0e0) v FROM members LEFT JOIN (SELECT person_id, max(rate) v FROM detailed GROUP BY person_id) p USING (person_id)) " + _sql_described("peaks", "cohort, grp", "v"))
def cohort_peak(spark, d):
    peak = detailed(spark, d).groupBy("person_id").agg(F.max(exposure.rate()).alias("v"))
    return _described(distribution.describe(members(spark, d).join(peak, "person_id", "left").fillna(0.0, ["v"]), ["cohort", "grp"], "v"), ["cohort", "grp"])


_LEVEL_SUMS = ", ".join(f"60 * sum(CASE WHEN rate >= {x} THEN duration_hours ELSE 0 END) m{int(x)}" for x in LEVELS)


@query(f"{sql_detailed()}, {SQL_COHORTS}, lv AS (SELECT person_id, {_LEVEL_SUMS} FROM detailed GROUP BY person_id), ll AS (" + " UNION ALL ".join(f"SELECT cohort, grp, {int(x)} AS level, coalesce(m{int(x)}, 0e0) v FROM members LEFT JOIN lv USING (person_id)" for x in LEVELS) + ") " + _sql_described("ll", "cohort, grp, level", "v"))
def cohort_thresholds(spark, d):
    above = detailed(spark, d).groupBy("person_id").agg(*[(60 * F.sum(F.when(exposure.rate() >= x, F.col("duration_hours")).otherwise(0.0))).alias(f"m{int(x)}") for x in LEVELS])
    each = members(spark, d).join(above, "person_id", "left").fillna(0.0, [f"m{int(x)}" for x in LEVELS])
    out = distribution.described(each, ["cohort", "grp"], [f"m{int(x)}" for x in LEVELS])
    return _described(out.withColumn("level", F.substring("column", 2, 9).cast("int")), ["cohort", "grp", "level"])


def sector_table(spark, d):
    shares = workoutdoor.soc_shares(A.frame(spark, d, A.ONET), [0, 1])
    return workoutdoor.sector_probabilities(workoutdoor.sector_weights(A.frame(spark, d, A.OEWS)), shares)


@query(f"WITH {SQL_SOC} SELECT soc, round(share, 9) share FROM shares")
def outdoor_soc(spark, d):
    return rounded(workoutdoor.soc_shares(A.frame(spark, d, A.ONET), [0, 1]))


@query(f"WITH {SQL_SECTOR} SELECT sector, round(p_outdoor, 9) p_outdoor, total FROM sectors")
def outdoor_sector(spark, d):
    return rounded(sector_table(spark, d))


@query(f"WITH {SQL_ASSIGN} SELECT person_id, grp, reason, round(p_outdoor, 9) p_outdoor FROM assigned")
def outdoor_person(spark, d):
    return rounded(workoutdoor.assign(A.frame(spark, d, A.PERSONS), sector_table(spark, d)))


@query(f"WITH {SQL_ASSIGN} SELECT reason AS metric, count(*) AS value FROM assigned GROUP BY reason")
def outdoor_missingness(spark, d):
    return workoutdoor.assign(A.frame(spark, d, A.PERSONS), sector_table(spark, d)).groupBy(F.col("reason").alias("metric")).agg(F.count(F.lit(1)).alias("value"))


SQL_READ = f"r AS ({A.READINGS}), r1 AS (SELECT * FROM r WHERE pm BETWEEN 0 AND 500)"
SQL_MAD = f'{SQL_READ}, md AS (SELECT sensor_index, "day", median(pm) m FROM r1 GROUP BY 1, 2), dv AS (SELECT r1.*, abs(pm - m) dd FROM r1 JOIN md USING (sensor_index, "day")), sc AS (SELECT sensor_index, "day", 1.4826e0 * median(dd) s FROM dv GROUP BY 1, 2), r2 AS (SELECT dv.* FROM dv JOIN sc USING (sensor_index, "day") WHERE s IS NULL OR s = 0 OR dd / s <= 6)'
SQL_STEP = f"{SQL_MAD}, st AS (SELECT *, lag(pm) OVER (PARTITION BY sensor_index ORDER BY datetime_utc, event_id) b FROM r2), r3 AS (SELECT * FROM st WHERE b IS NULL OR abs(pm - b) <= 150)"


@query(f"WITH {SQL_READ} SELECT event_id, sensor_index, pm FROM r1")
def sensor_range(spark, d):
    return sensors.in_range(A.frame(spark, d, A.READINGS)).select("event_id", "sensor_index", "pm")


@query(f"WITH {SQL_MAD} SELECT event_id, sensor_index, pm FROM r2")
def sensor_mad(spark, d):
    return sensors.mad_filter(sensors.in_range(A.frame(spark, d, A.READINGS))).select("event_id", "sensor_index", "pm")


@query(f"WITH {SQL_STEP} SELECT event_id, sensor_index, pm FROM r3")
def sensor_clean(spark, d):
    return sensors.step_filter(sensors.mad_filter(sensors.in_range(A.frame(spark, d, A.READINGS)))).select("event_id", "sensor_index", "pm")


@query(f"WITH {SQL_READ} SELECT region, strftime(datetime_utc, '%Y-%m') AS \"month\", count(DISTINCT sensor_index) n FROM r GROUP BY 1, 2")
def sensors_per_region(spark, d):
    return A.frame(spark, d, A.READINGS).groupBy("region", F.date_format("datetime_utc", "yyyy-MM").alias("month")).agg(F.countDistinct("sensor_index").alias("n"))


@query(f"WITH {SQL_READ} SELECT sensor_index, bin, round(median(pm), 9) median_pm, count(*) n FROM r1 GROUP BY 1, 2")
def bin_profiles(spark, d):
    return rounded(sensors.in_range(A.frame(spark, d, A.READINGS)).groupBy("sensor_index", "bin").agg(F.median("pm").alias("median_pm"), F.count(F.lit(1)).alias("n")))


SQL_DRAWS = "draws AS (SELECT CASE CAST(floor(e / 16) AS INTEGER) WHEN 0 THEN 'mu_tilde' WHEN 1 THEN 'tau' WHEN 2 THEN 'r_sensor' ELSE 'b' END param, e AS element, vec_id % 4 chain, CAST(floor(vec_id / 4) AS BIGINT) draw, CAST(embedding[e + 1] AS DOUBLE) AS value FROM (SELECT vec_id, embedding, unnest(generate_series(0, len(embedding) - 1)) e FROM embeddings) x)"


def draws(spark, d):
    rows = spark.read.parquet(f"{d}/embeddings.parquet").select("vec_id", F.posexplode("embedding").alias("element", "value"))
    param = F.when(F.col("element") < 16, "mu_tilde").when(F.col("element") < 32, "tau").when(F.col("element") < 48, "r_sensor").otherwise("b")
    return rows.select(param.alias("param"), "element", (F.col("vec_id") % 4).alias("chain"), F.floor(F.col("vec_id") / 4).alias("draw"), F.col("value").cast("double").alias("value"))


SQL_RHAT = f"{SQL_DRAWS}, ch AS (SELECT param, element, chain, count(*) n, avg(value) m, var_samp(value) v FROM draws GROUP BY 1, 2, 3), el AS (SELECT param, element, avg(n) n, var_samp(m) b, avg(v) w FROM ch GROUP BY 1, 2), rh AS (SELECT param, element, sqrt(((n - 1) / n * w + b) / w) rhat FROM el)"


@query(f"WITH {SQL_RHAT} SELECT param, round(avg(rhat), 9) mean_rhat, round(max(rhat), 9) max_rhat, count(*) n FROM rh GROUP BY param")
def rhat(spark, d):
    return rounded(diagnostics.rhat(draws(spark, d)).groupBy("param").agg(F.avg("rhat").alias("mean_rhat"), F.max("rhat").alias("max_rhat"), F.count(F.lit(1)).alias("n")))


@query(f"WITH {SQL_DRAWS} SELECT param, chain, draw, round(avg(value), 9) AS value FROM draws GROUP BY param, chain, draw")
def trace_summary(spark, d):
    return rounded(diagnostics.trace(draws(spark, d)))


_Q = ", ".join(f"quantile_cont(l_extendedprice / 1000e0, {q / 100}) p{q:02d}" for q in (5, 25, 75, 95))
_SURFACE = "SELECT -71.3e0 + (l_suppkey * 37 % 1000) * 0.0005e0 + 0.0002e0 lon, 42.2e0 + (l_suppkey * 53 % 800) * 0.0005e0 + 0.0002e0 lat, l_suppkey, {} FROM lineitem WHERE l_linenumber {} GROUP BY l_suppkey"
SQL_SURFACES = f"sa AS ({_SURFACE.format(_Q, '<= 4')}), sb AS ({_SURFACE.format(_Q, '> 4')}), ww AS (SELECT sa.lon, sa.lat, sa.p95 - sa.p05 a90, sb.p95 - sb.p05 b90, sa.p75 - sa.p25 a50, sb.p75 - sb.p25 b50 FROM sa JOIN sb USING (l_suppkey))"


def surfaces(spark, d):
    rows = spark.read.parquet(f"{d}/lineitem.parquet")
    lon = -71.3 + (F.col("l_suppkey") * 37 % 1000) * 0.0005 + 0.0002
    lat = 42.2 + (F.col("l_suppkey") * 53 % 800) * 0.0005 + 0.0002

    def one(where):
        p = rows.filter(where).groupBy("l_suppkey").agg(F.percentile(F.col("l_extendedprice").cast("double") / 1000.0, [0.05, 0.25, 0.75, 0.95]).alias("p"))
        return p.select("l_suppkey", lon.alias("lon"), lat.alias("lat"), *[F.col("p")[i].alias(f"p{q:02d}") for i, q in enumerate((5, 25, 75, 95))])

    return one("l_linenumber <= 4"), one("l_linenumber > 4")


@query(f"WITH {SQL_SURFACES} SELECT count(*) n, round(corr(a90, b90), 8) r90, round(corr(a50, b50), 8) r50 FROM ww")
def width_corr(spark, d):
    out = diagnostics.width_correlation(*surfaces(spark, d), keys=("l_suppkey",))
    return out.select("n", _r("r90", 8).alias("r90"), _r("r50", 8).alias("r50"))


@query(f"WITH {SQL_SURFACES} SELECT round(lon, 9) lon, round(lat, 9) lat, round(a90 - b90, 9) d90, round(a50 - b50, 9) d50 FROM ww")
def width_diff(spark, d):
    a, b = surfaces(spark, d)
    both = a.alias("a").join(b.alias("b"), "l_suppkey")  # several suppliers may share a place
    return rounded(both.select("a.lon", "a.lat", F.expr("(a.p95 - a.p05) - (b.p95 - b.p05) d90"), F.expr("(a.p75 - a.p25) - (b.p75 - b.p25) d50")))
