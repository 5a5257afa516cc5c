"""Uniform shuffle into shards of exact sizes, by a hypergeometric communication matrix.

1. Each row gets a random key, written once with the row, so all decisions stay the same when a task is repeated.
   Rows fall into blocks by their keys; the blocks' row counts are known by one aggregation.
2. ``communication_matrix`` draws how many rows each block sends to each shard: a multivariate hypergeometric draw per
   block from the room that the shards have left, so that rows and columns sum exactly (blocks x shards numbers, on
   the driver, whatever the input's size). The draw is exact at any size.
3. Each block permutes its rows locally (rank by a seeded hash of the key), sends the first ones to shard 0, the next
   to shard 1 ...
4. Each shard permutes what it got: ``slot`` numbers its rows from 0 in the order of a second seeded hash.

The law is ``rows``: counts differ by at most one. Empty input gives no rows; nulls are values like any others; rows that
are equal in all columns have keys of their own and are spread like any others; input columns named shard or slot go.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import buckets_for, gapless_rank, materialize, read, row_without


def hypergeometric(rng: np.random.Generator, white: int, black: int, n: int) -> int:
    """White balls among n drawn without putting back, exactly distributed at any size.

    Each ball is taken by a coin of its own, which two binomial draws sum up; of the too many some are given back, of the
    too few some are drawn after, by the same law on a much smaller number.
    """
    if 2 * n > white + black:
        return white - hypergeometric(rng, white, black, white + black - n)
    if n <= 32:
        k = 0
        for drawn in range(n):
            k += int(rng.integers(white + black - drawn)) < white - k
        return k
    p = n / (white + black)
    a, b = int(rng.binomial(white, p)), int(rng.binomial(black, p))
    if a + b <= n:
        return a + hypergeometric(rng, white - a, black - b, n - a - b)
    return a - hypergeometric(rng, a, b, a + b - n)


def communication_matrix(counts: list[int], sizes: list[int], seed: int) -> np.ndarray:
    """Rows: blocks, columns: shards; row sums are counts, column sums are sizes."""
    if sum(counts) != sum(sizes):
        raise ValueError("blocks and shards must hold as many rows")
    rng, room, out = np.random.default_rng(seed), list(sizes), []
    for n in counts:
        sent, left = [], sum(room)
        for want in room:
            k = hypergeometric(rng, want, left - want, n)
            sent.append(k)
            n, left = n - k, left - want
        out.append(sent)
        room = [r - k for r, k in zip(room, sent)]
    return np.array(out, dtype=np.int64).reshape(len(counts), len(sizes))


def shard_rows(df: DataFrame, shards: int = 8, seed: int = 42) -> DataFrame:
    """df with shard (0 to shards - 1) and slot (gapless from 0 in each shard)."""
    spark = df.sparkSession
    blocks = buckets_for(spark)
    keyed = df.select(row_without(df, "shard", "slot").alias("_row"), F.monotonically_increasing_id().alias("_id"))
    rows = materialize(keyed.withColumn("_key", F.xxhash64(F.lit(seed), "_id")).withColumn("_block", F.pmod("_key", F.lit(blocks)).cast("int")), "rows")
    counts = {r[0]: r[1] for r in rows.groupBy("_block").count().collect()}  # at most ``blocks`` rows
    total = sum(counts.values())
    sizes = [total // shards + (s < total % shards) for s in range(shards)]
    order = sorted(counts)
    sent = np.cumsum(communication_matrix([counts[b] for b in order], sizes, seed), axis=1)
    table = spark.createDataFrame([(b, [int(x) for x in sent[i]]) for i, b in enumerate(order)], "_block int, _sent array<long>")
    first = gapless_rank(rows.withColumn("_one", F.xxhash64(F.lit(seed + 1), "_key")), ["_block"], ["_one", "_id"], "_rank", 4)
    there = first.join(F.broadcast(table), "_block")  # a row for each block
    shard = F.size(F.filter("_sent", lambda x: x <= F.col("_rank")))
    exchanged = there.withColumn("shard", shard.cast("int")).withColumn("_two", F.xxhash64(F.lit(seed + 2), "_key"))
    slots = gapless_rank(exchanged, ["shard"], ["_two", "_id"], "slot", blocks)
    return slots.select("_row.*", "shard", F.col("slot").cast("long"))


def op1_hypergeometric_sharding(spark, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", (F.coalesce(F.octet_length("text"), F.lit(0)) + 1).cast("long").alias("size"), F.crc32(F.coalesce("text", F.lit(""))).alias("text_crc32"))
    return shard_rows(docs, 8).select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
