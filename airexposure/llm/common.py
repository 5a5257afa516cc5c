"""Shared Spark helpers of this subpackage."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Bytes of texts that go to a Python worker at once (one longer text goes alone).
BATCH_BYTES = 8 << 20

_own: dict[str, str] = {}


def scratch_dir(spark: SparkSession) -> str:
    """The shared folder that the session names in spark.checkpoint.dir; an own one where none is set and all runs on one machine."""
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    app = spark.sparkContext.applicationId
    if app not in _own:
        _own[app] = tempfile.mkdtemp(prefix="spark-")
    return _own[app]


def bounded_batches(spark: SparkSession) -> None:
    """Texts differ in size by orders of magnitude, so the session's Arrow batches are bounded in bytes, not only in rows."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    if int("".join(c for c in spark.conf.get(name) if c.isdigit())) != BATCH_BYTES:
        spark.conf.set(name, str(BATCH_BYTES))


#: Rows of a row group where rows have megabytes; Parquet looks at a group's size first after a hundred rows.
GROUP_ROWS = 4


def materialize(df: DataFrame, tag: str, codec: str = "snappy", large_rows: bool = False) -> DataFrame:
    """df written as Parquet to the shared folder and read back: cuts the lineage, survives lost executors.

    A task holds a row group to write it, and to read it up to 4096 of its rows; large_rows bounds both by GROUP_ROWS.
    """
    spark = df.sparkSession
    bounded_batches(spark)
    path = f"{scratch_dir(spark)}/{tag}-{uuid.uuid4().hex}"
    writer = df.write.option("compression", codec)
    if large_rows:
        writer = writer.option("parquet.block.row.count.limit", GROUP_ROWS)
    writer.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    bounded_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def buckets_for(spark: SparkSession) -> int:
    """Buckets into which hot groups are split; follows the session's shuffle parallelism."""
    return max(16, int(spark.conf.get("spark.sql.shuffle.partitions", "200")))


def row_without(df: DataFrame, *names: str) -> Column:
    """A struct of df's columns but those named: what an operator hands through beside the columns that it adds."""
    kept = [F.col(f"`{c}`") for c in df.columns if c not in names]
    return F.struct(*kept) if kept else F.struct(F.lit(None).cast("int").alias("_none"))


def kind_of(df: DataFrame, column: str) -> str:
    """The column's type as in a schema string, whatever its fields are called."""

    def text(t) -> str:
        if t.typeName() == "struct":
            return "struct<" + ", ".join(f"`{f.name}`: {text(f.dataType)}" for f in t.fields) + ">"
        if t.typeName() == "array":
            return f"array<{text(t.elementType)}>"
        return t.simpleString()

    return text(df.schema[column].dataType)


def free_names(df: DataFrame, *names: str) -> list[str]:
    """The names, with underscores before them as far as df has such columns."""
    have, out = {c.lower() for c in df.columns}, []
    for n in names:
        while n.lower() in have:
            n = f"_{n}"
        out.append(n)
    return out


def gapless_rank(df: DataFrame, groups: list[str], order: list, name: str, buckets: int, by: list | None = None) -> DataFrame:
    """Adds ``name``: 0, 1, 2 ... within each group, without gaps.

    A group is split into ``buckets`` parts by a hash of ``by`` (default: ``order``), each part is numbered on its
    own and starts where the parts before it end, so no task holds a whole group. The order within a group is by
    (hash bucket, ``order``). Rows equal in every ordering column get consecutive numbers in any order.
    """
    if not groups:
        return gapless_rank(df.withColumn("_all", F.lit(0)), ["_all"], order, name, buckets, by).drop("_all")
    parts = df.withColumn("_part", F.pmod(F.xxhash64(F.lit(7), *(by or order)), F.lit(buckets)).cast("int"))
    sizes = parts.groupBy(*groups, "_part").agg(F.count(F.lit(1)).alias("_size"))
    before = Window.partitionBy(*groups).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select(*[F.col(g).alias(f"_g{i}") for i, g in enumerate(groups)], F.col("_part").alias("_p"), F.coalesce(F.sum("_size").over(before), F.lit(0)).alias("_start"))
    numbered = parts.withColumn("_nth", F.row_number().over(Window.partitionBy(*groups, "_part").orderBy(*order)))
    match = F.col("_part") == F.col("_p")
    for i, g in enumerate(groups):
        match = match & F.col(g).eqNullSafe(F.col(f"_g{i}"))
    out = numbered.join(starts, match)
    return out.withColumn(name, F.col("_start") + F.col("_nth") - 1).drop("_part", "_p", "_start", "_nth", *[f"_g{i}" for i in range(len(groups))])
