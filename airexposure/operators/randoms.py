"""Random choices that repeat: numbers follow from (seed, key, counter) by MD5, so any engine that has it draws the same."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

DIGITS = 13  # hexadecimal digits of the digest that make a number: 52 bits


def uniform(seed: int, *keys: str | Column, counter: int = 0) -> Column:
    """A number strictly between 0 and 1 for each row: the digest of seed, keys as text (null: nothing) and counter, joined by colons."""
    parts = [F.lit(str(seed)), *[F.coalesce((F.col(k) if isinstance(k, str) else k).cast("string"), F.lit("")) for k in keys], F.lit(str(counter))]
    digits = F.substring(F.md5(F.concat_ws(":", *parts)), 1, DIGITS)
    return (F.conv(digits, 16, 10).cast("long") + F.lit(0.5)) / float(1 << 4 * DIGITS)


def sql_uniform(seed: int, *keys: str, counter: int = 0) -> str:
    """``uniform`` as SQL for DuckDB."""
    parts = ", ".join([f"'{seed}'", *[f"coalesce(CAST({k} AS VARCHAR), '')" for k in keys], f"'{counter}'"])
    return f"((CAST('0x' || substr(md5(concat_ws(':', {parts})), 1, {DIGITS}) AS BIGINT) + 0.5e0) / {1 << 4 * DIGITS}e0)"


def normal(seed: int, *keys: str | Column, counter: int = 0) -> Column:
    """A standard normal number from the counters 2 * counter and 2 * counter + 1 (Box and Muller's transform)."""
    u, v = (uniform(seed, *keys, counter=2 * counter + i) for i in (0, 1))
    return F.sqrt(-2 * F.log(u)) * F.cos(F.lit(6.283185307179586) * v)


def sql_normal(seed: int, *keys: str, counter: int = 0) -> str:
    u, v = (sql_uniform(seed, *keys, counter=2 * counter + i) for i in (0, 1))
    return f"(sqrt(-2 * ln({u})) * cos(6.283185307179586e0 * {v}))"


def sample(rows: DataFrame, k: int, key: str, seed: int = 1, forced: Column | None = None) -> DataFrame:
    """k rows by the least numbers of their keys, those of ``forced`` before all others; without replacement."""
    first = [] if forced is None else [F.when(forced, 0).otherwise(1)]
    return rows.orderBy(*first, uniform(seed, key), key).limit(k)


def thinned(rows: DataFrame, p: float, *keys: str, seed: int = 1) -> DataFrame:
    """Rows kept with probability p by their keys' number; of none kept, those with the least one."""
    drawn = rows.withColumn("_u", uniform(seed, *keys))
    least = drawn.agg(F.min("_u").alias("_least"))
    return drawn.join(F.broadcast(least)).filter((F.col("_u") < p) | (F.col("_u") == F.col("_least")) & (F.col("_least") >= p)).drop("_u", "_least")  # one row


def chosen_draws(rows: DataFrame, n: int, *draw: str, seed: int = 1) -> DataFrame:
    """The rows of n of the distinct draws, chosen without replacement: posterior thinning. All rows of a draw stay together."""
    few = rows.select(*draw).distinct().orderBy(uniform(seed, *draw), *draw).limit(n)
    return rows.join(few, list(draw), "left_semi")
