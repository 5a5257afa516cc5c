"""Domain-shaped inputs derived from the supplied tables, as SQL that Spark and DuckDB read alike."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

#: Trips: every order is one; a customer's orders make days of eight trips, each the day of a person of its own.
NUMBERED = "SELECT o_custkey c, o_orderkey k, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 rn FROM orders"
PERSON = "concat(cast(c AS varchar(20)), '-', cast(cast(floor(rn / 8) AS int) AS varchar(20)))"
TRIPS = f"""
SELECT person_id, rn, k, home_lon, home_lat,
       coalesce(lag(dest_lon) OVER (PARTITION BY person_id ORDER BY rn), home_lon) orig_lon,
       coalesce(lag(dest_lat) OVER (PARTITION BY person_id ORDER BY rn), home_lat) orig_lat,
       dest_lon, dest_lat, start_s, start_s + mins * 60 end_s, mins + CASE WHEN k % 97 = 0 THEN 30 ELSE 0 END declared_minutes,
       CASE k % 5 WHEN 0 THEN 'work' WHEN 1 THEN 'school' WHEN 2 THEN 'shop' WHEN 3 THEN 'home' ELSE 'social' END purpose,
       CASE k % 6 WHEN 0 THEN 'private_auto' WHEN 1 THEN 'auto_passenger' WHEN 2 THEN 'public_transit' WHEN 3 THEN 'walking'
                  WHEN 4 THEN 'biking' ELSE 'other' END mode
FROM (SELECT person_id, k, rn, home_lon, home_lat,
             CASE WHEN k % 7 = 0 THEN home_lon ELSE -71.3e0 + (k * 41 % 1000) * 0.0005e0 + 0.0002e0 END dest_lon,
             CASE WHEN k % 7 = 0 THEN home_lat ELSE 42.2e0 + (k * 59 % 800) * 0.0005e0 + 0.0001e0 END dest_lat,
             (300 + 130 * rn + k % 50) * 60 start_s, 10 + k % 45 AS mins
      FROM (SELECT {PERSON} person_id, k, rn % 8 rn, -71.3e0 + (c * 37 % 1000) * 0.0005e0 + 0.0002e0 home_lon,
                   42.2e0 + (c * 53 % 800) * 0.0005e0 + 0.0001e0 home_lat
            FROM ({NUMBERED}) numbered) n) t
"""

#: Trips as delivered: text cells, some of them dirty.
RAW_TRIPS = f"""
SELECT person_id, rn, cast(round(orig_lon, 6) AS varchar(20)) orig_lon, cast(round(orig_lat, 6) AS varchar(20)) orig_lat,
       CASE WHEN k % 211 = 0 THEN 'Out of Region' ELSE cast(round(dest_lon, 6) AS varchar(20)) END dest_lon, cast(round(dest_lat, 6) AS varchar(20)) dest_lat,
       CASE WHEN k % 307 = 0 THEN ' ' ELSE cast(round(home_lon, 6) AS varchar(20)) END home_lon, cast(round(home_lat, 6) AS varchar(20)) home_lat,
       {{start}} start_time, {{end}} end_time, CASE WHEN k % 401 = 0 THEN 'n/a' ELSE cast(declared_minutes AS varchar(20)) END declared_minutes, purpose, mode
FROM ({TRIPS}) trips
"""
_CLOCK = "concat(cast(cast(floor({0} / 3600) AS int) AS varchar(20)), ':', lpad(cast(cast(floor({0} % 3600 / 60) AS int) AS varchar(20)), 2, '0'), ':', lpad(cast(k % 60 AS varchar(20)), 2, '0'))"
RAW_TRIPS = RAW_TRIPS.replace("{start}", f"CASE WHEN k % 223 = 0 THEN '99:99:99' ELSE {_CLOCK.format('start_s')} END").replace("{end}", _CLOCK.format("end_s"))

#: Persons with attributes, one for each day of a customer's trips.
PERSONS = f"""
SELECT concat(cast(c_custkey AS varchar(20)), '-', cast(coalesce(dy, 0) AS varchar(20))) person_id, cast(c_acctbal AS double) * 12 + 60000 income, c_custkey % 90 age,
       CASE c_nationkey % 3 WHEN 0 THEN 'a' WHEN 1 THEN 'b' ELSE 'c' END race,
       CASE WHEN c_custkey % 10 = 0 THEN NULL WHEN c_custkey % 97 = 0 THEN 'retired' WHEN c_mktsegment = 'MACHINERY' THEN 'NAICS31_33_mfg'
            WHEN c_mktsegment = 'BUILDING' THEN concat('naics23', cast(c_custkey % 9 AS varchar(20)), '_construction') WHEN c_mktsegment = 'AUTOMOBILE' THEN ' naics44_45_retail'
            WHEN c_mktsegment = 'HOUSEHOLD' THEN 'not_working' WHEN c_custkey % 4 = 0 THEN 'naics55' ELSE 'health 62' END industry
FROM customer LEFT JOIN (SELECT DISTINCT c, cast(floor(rn / 8) AS int) dy FROM ({NUMBERED}) numbered) days ON c = c_custkey
"""

#: Pollution field: 48 half-hour slots over a grid of 20 x 16 cells with gaps; values are no round numbers, so that sums don't end on ties.
FIELD = """
SELECT slot, lon, lat, mid, 0.6e0 * mid + (i * 3 + j + k) % 7 / 11e0 low, 1.3e0 * mid + (i + j * 5 + k) % 5 / 7e0 high
FROM (SELECT k * 30 slot, i, j, k, -71.3e0 + 0.025e0 * i lon, 42.2e0 + 0.025e0 * j lat, 5 + ((31 * i + 17 * j + 7 * k) % 200) / 10.7e0 mid
      FROM ({slots}) s CROSS JOIN ({xs}) x CROSS JOIN ({ys}) y) f
WHERE (7 * i + 3 * j + k) % 23 <> 0
"""

#: Sensor readings.
READINGS = """
SELECT user_id sensor_index, event_id, ts datetime_utc, cast(value AS double) * CASE WHEN event_id % 40 = 0 THEN 4 ELSE 1 END pm, hour(ts) * 2 + cast(floor(minute(ts) / 30) AS int) bin, cast(ts AS date) "day", lower(n_name) region
FROM events JOIN nation ON n_nationkey = user_id % 25
"""

#: Occupation tables.
ONET = """
SELECT soc, element, scale_id, category, 100e0 * value / sum(value) OVER (PARTITION BY soc, element) AS value
FROM (SELECT concat(cast(11 + cast(floor(q / 10) AS int) AS varchar(20)), '-', cast(1000 + q AS varchar(20)), '.00') soc, (cast(floor(p_partkey / 120) AS int)) % 2 element,
             CASE WHEN p_partkey % 11 = 0 THEN 'CX' ELSE 'CXP' END scale_id, p_size % 5 + 1 category, cast(p_size % 10 + 1 AS double) AS value
      FROM (SELECT p_partkey, p_size, p_partkey % 120 q FROM part) p) o
"""
OEWS = """
SELECT concat(CASE l_suppkey % 8 WHEN 0 THEN '11' WHEN 1 THEN '23' WHEN 2 THEN '31' WHEN 3 THEN '32' WHEN 4 THEN '33' WHEN 5 THEN '44' WHEN 6 THEN '45' ELSE '62' END, '0000') naics,
       concat(cast(11 + cast(floor(l_partkey % 130 / 10) AS int) AS varchar(20)), '-', cast(1000 + l_partkey % 130 AS varchar(20))) soc,
       CASE WHEN l_linenumber = 7 THEN 'major' ELSE 'detailed' END o_group, CASE WHEN l_partkey % 17 = 0 THEN '**' ELSE cast(cast(l_quantity AS int) AS varchar(20)) END tot_emp
FROM lineitem
"""


def duck(sql: str) -> str:
    """The SQL for DuckDB."""
    return sql.replace("{slots}", "SELECT range k FROM range(48)").replace("{xs}", "SELECT range i FROM range(20)").replace("{ys}", "SELECT range j FROM range(16)")


def frame(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    """The SQL as a DataFrame over the tables of sf_dir."""
    sql = sql.replace("{slots}", "SELECT id k FROM range(48)").replace("{xs}", "SELECT id i FROM range(20)").replace("{ys}", "SELECT id j FROM range(16)").replace('"day"', "day").replace('"month"', "month")
    named = {}
    for table in ("orders", "customer", "events", "nation", "part", "lineitem", "embeddings"):
        if f" {table}" in sql or f"\n{table}" in sql:
            named[table] = spark.read.parquet(f"{sf_dir}/{table}.parquet")
            for word in ("FROM ", "JOIN "):
                sql = sql.replace(f"{word}{table}", f"{word}{{{table}}}")
    return spark.sql(sql, **named)
