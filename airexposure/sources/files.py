"""Readers and writers of the domain's files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.staging import staged

ID_NAMES = ["trip_taker_person_id", "person_id"]
GEOMETRY = "struct<type: string, coordinates: string>"


def trips_csv(spark: SparkSession, path: str, person_column: str | None = None) -> DataFrame:
    """Trips with every column as text and the person's id as person_id; no id column is an error."""
    rows = spark.read.option("header", True).csv(path)
    found = [c for c in [person_column, *ID_NAMES] if c in rows.columns]
    if not found:
        raise ValueError("no person id column")
    return rows.withColumnRenamed(found[0], "person_id")


def field_csv(spark: SparkSession, path: str, value: str | None = None, low: str | None = None, high: str | None = None) -> DataFrame:
    """(lon, lat, slot, mid[, low, high]): slot is the minute of the day in UTC; rows without place, time or value go.

    The value is the named column, else pm25, pm25_p50 or the first whose name contains pm25.
    """
    rows = spark.read.option("header", True).csv(path)
    names = {"longitude": "lon", "latitude": "lat", "timestamp": "timestamp_utc"}
    rows = rows.withColumnsRenamed({a: b for a, b in names.items() if a in rows.columns and b not in rows.columns})
    if missing := [c for c in ("lon", "lat", "timestamp_utc") if c not in rows.columns]:
        raise ValueError(f"no column {missing[0]}")
    choice = [c for c in [value, "pm25", "pm25_p50", *[c for c in rows.columns if "pm25" in c]] if c in rows.columns]
    if not choice:
        raise ValueError("no value column")
    # seconds since 1970 don't depend on the session's time zone; text without a zone is UTC
    text = F.trim(F.regexp_replace(F.col("timestamp_utc").cast("string"), "T", " "))
    zoned = F.when(text.rlike(r"(Z|[+-][0-9]{2}:?[0-9]{2})$"), text).otherwise(F.concat(text, F.lit("+00:00")))
    at = F.unix_seconds(zoned.try_cast("timestamp"))
    number = lambda c: F.col(c).try_cast("double")
    ends = [number(c).alias(n) for n, c in (("low", low), ("high", high)) if c in rows.columns]
    out = rows.select(number("lon").alias("lon"), number("lat").alias("lat"), F.floor(F.pmod(at, F.lit(86_400)) / 60).cast("int").alias("slot"), number(choice[0]).alias("mid"), *ends)
    return out.dropna(subset=["lon", "lat", "slot", "mid"])


def _features(spark: SparkSession, path: str) -> DataFrame:
    schema = f"type string, features array<struct<geometry: {GEOMETRY}, properties: map<string, string>>>, geometry {GEOMETRY}, properties map<string, string>, coordinates string"
    whole = spark.read.option("wholetext", True).text(path).select(F.from_json("value", schema).alias("j"), F.col("_metadata.file_name").alias("file"))
    one = F.array(F.struct(F.coalesce("j.geometry", F.struct(F.col("j.type").alias("type"), F.col("j.coordinates").alias("coordinates"))).alias("geometry"), F.col("j.properties").alias("properties")))
    return whole.select("file", F.explode(F.coalesce("j.features", one)).alias("f")).select("file", "f.geometry", "f.properties")


def sensors_geojson(spark: SparkSession, path: str, by_line: bool = False) -> DataFrame:
    """(sensor_index, latitude, longitude, name, msa_slug) of the points of GeoJSON files; the slug is a property or the file's stem; none is an error.

    by_line: the files have a feature a line, else each is one JSON text.
    """
    point = F.from_json("geometry.coordinates", "array<double>")
    rows = (features_by_line if by_line else _features)(spark, path).filter("geometry.type = 'Point'").withColumn("c", point).filter(F.size("c") >= 2)
    p = lambda k: F.col("properties")[k]
    slug = F.coalesce(p("msa_slug"), F.regexp_replace("file", r"\.[^.]*$", ""))
    if rows.isEmpty():
        raise ValueError("no point features")
    return rows.select(p("sensor_index").try_cast("int").alias("sensor_index"), F.col("c")[1].alias("latitude"), F.col("c")[0].alias("longitude"), F.coalesce(p("name"), F.lit("")).alias("name"), slug.alias("msa_slug"))


def polygon_vertices(spark: SparkSession, path: str) -> DataFrame:
    """(ring, msa_slug, pos, lon, lat) of the outer rings of polygons and multipolygons; other geometries are an error."""
    rows = _features(spark, path)
    kinds = F.col("geometry.type").isin("Polygon", "MultiPolygon")
    rows = rows.filter(F.when(kinds, True).otherwise(F.raise_error(F.concat(F.lit("no polygon: "), F.coalesce("geometry.type", F.lit("null"))))))
    many = F.when(F.col("geometry.type") == "MultiPolygon", F.from_json("geometry.coordinates", "array<array<array<array<double>>>>")).otherwise(F.array(F.from_json("geometry.coordinates", "array<array<array<double>>>")))
    slug = F.coalesce(F.col("properties")["msa_slug"], F.regexp_replace("file", r"\.[^.]*$", ""))
    outer = rows.select("file", slug.alias("msa_slug"), "geometry", F.posexplode(F.transform(many, lambda polygon: polygon[0])).alias("part", "points"))
    ring = outer.select(F.concat_ws("/", "file", F.md5("geometry.coordinates"), F.col("part").cast("string")).alias("ring"), "msa_slug", F.posexplode("points").alias("pos", "c"))
    return ring.select("ring", "msa_slug", "pos", F.col("c")[0].alias("lon"), F.col("c")[1].alias("lat"))


def save_readings(readings: DataFrame, path: str) -> None:
    """readings (msa_slug, month, ...) as CSV in a folder <slug>_<month> for each region and month, many of them at a time."""
    rows = readings.withColumn("folder", F.concat_ws("_", "msa_slug", "month")).drop("msa_slug", "month")
    rows.repartition("folder").write.mode("overwrite").option("header", True).partitionBy("folder").csv(path)


def cleaned_readings(spark: SparkSession, folder: str, latest: bool = False, files: str = "cleaned_*.csv") -> DataFrame:
    """Rows of <slug>_<month>/cleaned_*.csv with msa_slug and month; ``latest`` keeps each folder's last file by name.

    files: their names, "part-*" for those that ``save_readings`` wrote.
    """
    rows = spark.read.option("header", True).csv(f"{folder}/*/{files}").withColumn("_path", F.col("_metadata.file_path"))
    rows = rows.withColumn("_folder", F.regexp_replace(F.element_at(F.split("_path", "/"), -2), "^folder=", ""))
    if latest:
        last = rows.groupBy("_folder").agg(F.max("_path").alias("_path"))
        rows = rows.join(last, ["_folder", "_path"], "left_semi")
    return rows.withColumns({"msa_slug": F.regexp_extract("_folder", "^(.*)_[^_]*$", 1), "month": F.substring_index("_folder", "_", -1)}).drop("_folder", "_path")


def holdout_list(spark: SparkSession, path: str) -> DataFrame:
    """(sensor_index): one id a line, blank lines skipped."""
    return spark.read.text(path).filter("trim(value) <> ''").select(F.trim("value").try_cast("int").alias("sensor_index"))


def surface_quantiles(surface: DataFrame, k: str = "mean") -> DataFrame:
    """The rows of one k of a surface, compared as text; a surface without k is taken whole."""
    return surface.filter(F.col("k").cast("string") == k) if "k" in surface.columns else surface


def date_in_name(name: Column) -> Column:
    """The first eight digits of a file name that start with 19 or 20, as a date."""
    return F.to_date(F.nullif(F.regexp_extract(name, "((?:19|20)[0-9]{6})", 1), F.lit("")), "yyyyMMdd")


def point_feature(lon: Column, lat: Column, properties: Column) -> Column:
    """A GeoJSON feature as text, for a file with one feature a line."""
    geometry = F.struct(F.lit("Point").alias("type"), F.array(lon, lat).alias("coordinates"))
    return F.to_json(F.struct(F.lit("Feature").alias("type"), geometry.alias("geometry"), properties.alias("properties")))


def person_json(compared: DataFrame, metric: str = "cumulative", units: str = "ug/m3*h") -> DataFrame:
    """(person_id, value): each person's comparison as a JSON line; a null ratio is written as 0."""
    summary = F.struct("activity", "home", F.coalesce("ratio", F.lit(0.0)).alias("ratio"))
    return compared.select("person_id", F.to_json(F.struct(summary.alias("summary"), F.struct(F.lit(metric).alias("metric"), F.lit(units).alias("units")).alias("metadata"))).alias("value"))


def save_csv(df: DataFrame, path: str) -> None:
    """A table as CSV with a header; cells keep their outer spaces."""
    df.write.mode("overwrite").options(header=True, ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False).csv(path)


def save_trips(trips: DataFrame, path: str, id_name: str = ID_NAMES[0]) -> None:
    """Trips as delivered, the person's id under the name that deliveries give it."""
    save_csv(trips.withColumnRenamed("person_id", id_name), path)


def save_field(field: DataFrame, path: str, names: dict[str, str], day: str = "1970-01-01") -> None:
    """A field (lon, lat, slot, values) with times of one day in UTC in place of slots; names: new names of the values."""
    clock = F.format_string("%02d:%02d:00", F.floor(F.col("slot") / 60), F.col("slot") % 60)
    save_csv(field.select("lon", "lat", F.concat(F.lit(f"{day}T"), clock, F.lit("Z")).alias("timestamp_utc"), *[F.col(c).alias(n) for c, n in names.items()]), path)


def save_results(comparison: DataFrame, details: DataFrame, path: str) -> None:
    """The comparison of persons and their detailed rows as two CSV sets, persons in order, a person's rows together."""
    save_csv(comparison.repartitionByRange("person_id").sortWithinPartitions("person_id"), f"{path}/comparison")
    save_csv(details.repartitionByRange("person_id").sortWithinPartitions("person_id", "start_s"), f"{path}/detailed")


def save_audits(path: str, **audits: DataFrame) -> None:
    """Audits (places, rejections, factor draws, missingness) as a CSV set each."""
    for name, rows in audits.items():
        save_csv(rows, f"{path}/{name}")


def save_sensors(sensors: DataFrame, path: str) -> None:
    """The four columns of a sensor list as CSV."""
    save_csv(sensors.select("sensor_index", "latitude", "longitude", "name"), path)


def save_metrics(each: DataFrame, aggregate: DataFrame, path: str) -> None:
    """Held-out errors: a CSV row for each sensor, and the aggregate of one row as one JSON object."""
    save_csv(each, f"{path}/per_sensor")
    save_json(aggregate.select(F.struct(*aggregate.columns).alias("aggregate")), f"{path}/summary")


def read_metrics(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(per sensor, aggregate) as ``save_metrics`` wrote them; numbers are typed by their columns' names."""
    each = spark.read.option("header", True).csv(f"{path}/per_sensor")
    each = each.select(*[F.col(c).cast("long" if c in ("sensor_index", "n") else "double").alias(c) for c in each.columns])
    return each, spark.read.json(f"{path}/summary").select("aggregate.*")


def exposure_parquet(detailed: DataFrame, summary: DataFrame, path: str) -> None:
    """Detailed rows and person totals as two Parquet sets, rows of a person together and in order."""
    detailed.repartition("person_id").sortWithinPartitions("person_id", "start_s").write.mode("overwrite").parquet(f"{path}/detailed")
    summary.write.mode("overwrite").parquet(f"{path}/summary")


def parquet_set(spark: SparkSession, *paths: str, order: tuple = ("person_id", "start_s")) -> DataFrame:
    """Parquet sets of different runs by column name, missing columns null; ordered by those of ``order`` that there are."""
    rows = spark.read.option("mergeSchema", True).parquet(*paths)
    keys = [c for c in order if c in rows.columns]
    return rows.orderBy(*keys) if keys else rows


def timeseries_parquet(series: DataFrame, path: str, ordered: bool = False) -> None:
    """A person's time series together and in order, Parquet with zstd; ordered: they are so already, as ``curves`` gives them."""
    rows = series if ordered else series.repartition("person_id").sortWithinPartitions("person_id", "bin_index")
    rows.write.mode("overwrite").option("compression", "zstd").parquet(path)


def save_json(df: DataFrame, path: str) -> None:
    """Nested rows (statistics, payloads, metrics) as JSON, a row a line."""
    df.write.mode("overwrite").json(path)


def save_groups(rows: DataFrame, path: str, *keys: str) -> None:
    """Nested rows as JSON in a folder for each group: viewers of cohorts, and of persons that were asked for."""
    rows.repartition(*keys).write.mode("overwrite").partitionBy(*keys).json(path)


_OPENING, _CLOSING = '{"type":"FeatureCollection","features":[', "]}"


def feature_collection(features: DataFrame, path: str) -> None:
    """features (value), as ``point_feature`` gives them, as one FeatureCollection in as many parts as there are tasks.

    The parts hold a feature a line; put together in the order of their names they are one JSON text, whose first and last lines open
    and close the list. An empty table gives an empty list.
    """
    spark = features.sparkSession
    rows = features.select("value").repartitionByRange("value").sortWithinPartitions("value").withColumn("_i", F.monotonically_increasing_id())
    rows = staged(rows, "features")
    first, last = rows.agg(F.min("_i"), F.max("_i")).head()
    if first is None:
        spark.createDataFrame([(_OPENING + _CLOSING,)], "value string").coalesce(1).write.mode("overwrite").text(path)
        return
    opening = F.when(F.col("_i") == first, F.lit(_OPENING + "\n")).otherwise(F.lit(""))
    closing = F.when(F.col("_i") == last, F.lit("\n" + _CLOSING)).otherwise(F.lit(","))
    ordered = rows.repartitionByRange("_i").sortWithinPartitions("_i")
    ordered.select(F.concat(opening, "value", closing).alias("value")).write.mode("overwrite").text(path)


def features_by_line(spark: SparkSession, path: str) -> DataFrame:
    """(file, geometry, properties) of files with a feature a line, as ``feature_collection`` writes them; read in parallel, whatever their size."""
    schema = f"geometry {GEOMETRY}, properties map<string, string>"
    lines = spark.read.text(path).select(F.regexp_replace(F.trim("value"), ",$", "").alias("value"), F.col("_metadata.file_name").alias("file"))
    whole = lines.filter((F.col("value") != _OPENING) & (F.col("value") != _CLOSING) & (F.col("value") != _OPENING + _CLOSING))
    return whole.select("file", F.from_json("value", schema).alias("f")).select("file", "f.geometry", "f.properties")


def occupation_csv(spark: SparkSession, path: str, columns: dict[str, str]) -> DataFrame:
    """The named columns of a CSV, all as text, under new names; a byte-order mark before the first header is dropped."""
    rows = spark.read.option("header", True).option("encoding", "UTF-8").csv(path)
    rows = rows.toDF(*[c.lstrip("\ufeff").strip() for c in rows.columns])
    if missing := [c for c in columns if c not in rows.columns]:
        raise ValueError(f"no column {missing[0]}")
    return rows.select(*[F.col(f"`{c}`").alias(n) for c, n in columns.items()])


#: Columns of the two occupation tables.
OEWS_COLUMNS = {"NAICS": "naics", "OCC_CODE": "soc", "O_GROUP": "o_group", "TOT_EMP": "tot_emp"}
ONET_COLUMNS = {"O*NET-SOC Code": "soc", "Element Name": "element", "Scale ID": "scale_id", "Category": "category", "Data Value": "value"}


def save_occupations(rows: DataFrame, path: str, columns: dict[str, str]) -> None:
    """A table of the outdoor-work model under the names of its source, with the byte-order mark that the source's files have."""
    named = rows.select(*[F.col(n).alias(("\ufeff" if k == 0 else "") + c) for k, (c, n) in enumerate(columns.items())])
    save_csv(named, path)


def oews_csv(spark: SparkSession, path: str) -> DataFrame:
    return occupation_csv(spark, path, OEWS_COLUMNS)


def onet_csv(spark: SparkSession, path: str) -> DataFrame:
    rows = occupation_csv(spark, path, ONET_COLUMNS)
    return rows.withColumns({"category": F.col("category").try_cast("int"), "value": F.col("value").try_cast("double")})


def sector_labels(spark: SparkSession, path: str, code: str, label: str) -> DataFrame:
    """(grp, label): sector labels with ranges written as the groups are, 31_33 for 31-33."""
    return occupation_csv(spark, path, {code: "grp", label: "label"}).withColumn("grp", F.replace(F.trim("grp"), F.lit("-"), F.lit("_")))


def utc_from_epoch(rows: DataFrame, column: str = "time_stamp") -> DataFrame:
    """datetime_utc in place of a column of seconds since 1970."""
    return rows.withColumn("datetime_utc", F.timestamp_seconds(F.col(column).cast("long"))).drop(column)


def chain_diagnostics(spark: SparkSession, path: str) -> DataFrame:
    """(file, param, max_rhat, draws) of JSON files with lists of R-hat by parameter; draws per chain under either name."""
    schema = "rhat map<string, array<double>>, draws_per_chain long, n_draws long"
    rows = spark.read.schema(schema).option("multiLine", True).json(path).select(F.col("_metadata.file_name").alias("file"), F.coalesce("draws_per_chain", "n_draws").alias("draws"), F.explode("rhat").alias("param", "r"))
    return rows.select("file", "param", F.array_max("r").alias("max_rhat"), "draws")
