"""Evaluation on held-out sensors: their choice, profiles, bases, predicted shapes, bands, errors."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .randoms import sample
from .staging import staged


def choose_holdouts(sensors: DataFrame, n: int, seed: int = 1, min_train: int = 3) -> DataFrame:
    """(sensor_index) of up to n sensors, so that min_train remain, at least one."""
    ids = sensors.select("sensor_index").distinct()
    return sample(ids, max(1, min(n, ids.count() - min_train)), "sensor_index", seed)


def profiles(readings: DataFrame, value: str = "pm") -> DataFrame:
    """(sensor_index, bin, level, shape, log_level): bin medians, those over the sensor's mean of bins, and their log."""
    each = readings.groupBy("sensor_index", "bin").agg(F.median(value).alias("level"))
    mean = F.avg("level").over(Window.partitionBy("sensor_index"))
    return each.withColumn("shape", F.when(mean > 0, F.col("level") / mean)).withColumn("log_level", F.when(F.col("level") > 0, F.log("level")))


def errors(pairs: DataFrame, observed: str, predicted: str, *keys: str) -> DataFrame:
    """n, rmse, mae and r2 of each key, and the same of profiles centred on their means (shape_...); r2 is null without spread."""
    rows = pairs.filter(F.col(observed).isNotNull() & F.col(predicted).isNotNull())
    w = Window.partitionBy(*keys)
    o, p = F.col(observed), F.col(predicted)
    rows = rows.withColumns({"_o": o - F.avg(o).over(w), "_p": p - F.avg(p).over(w)}).withColumns({"_e": o - p, "_s": F.col("_o") - F.col("_p")})

    def three(name: str, e: str) -> list[Column]:
        sst = F.sum(F.col("_o") ** 2)
        return [F.sqrt(F.avg(F.col(e) ** 2)).alias(f"{name}rmse"), F.avg(F.abs(e)).alias(f"{name}mae"), F.when(sst > 1e-12, 1 - F.sum(F.col(e) ** 2) / sst).alias(f"{name}r2")]

    return rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), *three("", "_e"), *three("shape_", "_s"))


def summarise(metrics: DataFrame, key: str, values: list[str]) -> DataFrame:
    """Mean and median of each metric by key; nulls don't count."""
    return metrics.groupBy(key).agg(F.count(F.lit(1)).alias("n"), *[f(v).alias(f"{n}_{v}") for v in values for n, f in (("mean", F.avg), ("median", F.median))])


def kmeans(points: DataFrame, k: int, key: str = "sensor_index", seed: int = 1, iterations: int = 20) -> list[tuple[float, float]]:
    """k centres of points (key, lon, lat) by Lloyd's steps, from k points chosen by their key's number, in the order of their keys.

    Spark assigns and averages; only k rows come back each step. A centre without points stays; equal distances go to the first
    centre; the steps end early when no centre moves. Fewer points than k give as many centres.
    """
    rows = staged(points.select(key, "lon", "lat").filter("lon is not null and lat is not null").distinct(), "points")
    centres = sorted((r[key], r["lon"], r["lat"]) for r in sample(rows, k, key, seed).collect())
    centres = [(x, y) for _, x, y in centres]
    lon, lat = F.col("lon"), F.col("lat")
    for _ in range(iterations if centres else 0):
        apart = [F.struct(((lon - x) * (lon - x) + (lat - y) * (lat - y)).alias("d"), F.lit(i).alias("i")) for i, (x, y) in enumerate(centres)]
        means = {r["i"]: (r["x"], r["y"]) for r in rows.groupBy(F.array_min(F.array(*apart))["i"].alias("i")).agg(F.avg("lon").alias("x"), F.avg("lat").alias("y")).collect()}
        moved = [means.get(i, c) for i, c in enumerate(centres)]
        if moved == centres:
            break
        centres = moved
    return centres


def radial_basis(sensors: DataFrame, centres: list[tuple[float, float]], width: float) -> DataFrame:
    """(sensor_index, centre, phi): Gaussian features of the distance in degrees; centres are a list given beforehand."""
    at = F.posexplode(F.array(*[F.struct(F.lit(x).alias("x"), F.lit(y).alias("y")) for x, y in centres])).alias("centre", "c")
    d2 = (F.col("lon") - F.col("c.x")) ** 2 + (F.col("lat") - F.col("c.y")) ** 2
    return sensors.select("sensor_index", "lon", "lat", at).select("sensor_index", "centre", F.exp(-0.5 * d2 / width**2).alias("phi"))


def circular_basis(n: int, centres: int, width: float) -> list[list[float]]:
    """Gaussian of the circular distance of n bins to evenly spaced centres; each column has norm 1."""
    gap = lambda a, b: min(abs(a - b), n - abs(a - b))
    rows = [[math.exp(-0.5 * (gap(k, j * n / centres) / width) ** 2) for j in range(centres)] for k in range(n)]
    norm = [math.sqrt(sum(r[j] ** 2 for r in rows)) for j in range(centres)]
    return [[v / s for v, s in zip(r, norm)] for r in rows]


def log_shape(z: DataFrame, *keys: str) -> DataFrame:
    """z (keys, bin, z) with log_s = z - log of the mean of exp(z) over the bins of each key, computed about the maximum."""
    w = Window.partitionBy(*keys)
    top = z.withColumn("_m", F.max("z").over(w))
    return top.withColumn("log_s", F.col("z") - F.col("_m") - F.log(F.avg(F.exp(F.col("z") - F.col("_m"))).over(w))).drop("_m")


def level(shape: DataFrame, baseline: DataFrame, *keys: str) -> DataFrame:
    """shape (keys, log_s) and baseline (keys, base, bias) to log_pm = log(base, 1e-12 at least) + log_s + bias."""
    base = F.log(F.greatest("base", F.lit(1e-12)))
    return shape.join(baseline, list(keys)).withColumn("log_pm", base + F.col("log_s") + F.coalesce("bias", F.lit(0.0)))


def bands(draws: DataFrame, value: str, quantiles: list[float], *keys: str) -> DataFrame:
    """Mean and quantiles (q0, q1, ...) of a value over the draws of each key."""
    each = draws.groupBy(*keys).agg(F.avg(value).alias("mean"), F.percentile(value, quantiles).alias("q"))
    return each.select(*keys, "mean", *[F.col("q")[i].alias(f"q{i}") for i in range(len(quantiles))])


def split(rows: DataFrame, held: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(training rows, held-out rows) by a list of sensors."""
    ids = held.select("sensor_index").distinct()
    return rows.join(ids, "sensor_index", "left_anti"), rows.join(ids, "sensor_index", "left_semi")


def orthonormal_basis(training: DataFrame, held: DataFrame, centres: list[tuple[float, float]], width: float) -> DataFrame:
    """(sensor_index, centre, q) of all sensors: features of the training sensors made orthonormal, those of others by the same factor.

    The training features' Gram matrix G = R'R (centres x centres numbers, summed by Spark) gives R, and rows times the inverse of R
    are orthonormal over the training sensors, as a QR factorisation's would be, up to signs.
    """
    import numpy as np

    k = len(centres)
    phi = radial_basis(training, centres, width)
    pair = phi.alias("a").join(phi.alias("b"), "sensor_index").groupBy(F.col("a.centre").alias("i"), F.col("b.centre").alias("j")).agg(F.sum(F.col("a.phi") * F.col("b.phi")).alias("g"))
    gram = np.zeros((k, k))
    for r in pair.collect():
        gram[r["i"], r["j"]] = r["g"]
    values, vectors = np.linalg.eigh(gram)
    keep = values > values.max(initial=0) * 1e-12  # a pseudo-inverse where centres coincide
    inverse = np.linalg.inv(np.linalg.cholesky(gram).T) if keep.all() else vectors[:, keep] / np.sqrt(values[keep])
    table = training.sparkSession.createDataFrame([(i, j, float(inverse[i, j])) for i in range(k) for j in range(inverse.shape[1])], "centre int, to int, f double")
    every = radial_basis(training.unionByName(held.select(*training.columns)), centres, width)
    return every.join(F.broadcast(table), "centre").groupBy("sensor_index", F.col("to").alias("centre")).agg(F.sum(F.col("phi") * F.col("f")).alias("q"))


def predicted_shape(weights: DataFrame, spatial: DataFrame, temporal: DataFrame, mean: DataFrame, training: DataFrame, wanted: DataFrame | None = None) -> DataFrame:
    """(sensor_index, draw, bin, log_s) from posterior weights (draw, centre, term, w), spatial (sensor_index, centre, q), temporal (term, bin, t),
    mean (draw, bin, mu) and training (sensor_index): z = mu + r, r centred over the training sensors, and log_s as ``log_shape``.

    wanted: (sensor_index) of which the shapes are asked, else all. r is linear in q, so its mean over the training sensors is that of their
    mean features. Weights, waves and means of the kept draws are few and go to where the sensors are.
    """
    waves = weights.join(F.broadcast(temporal), "term").groupBy("draw", "centre", "bin").agg(F.sum(F.col("w") * F.col("t")).alias("f"))  # draws x centres x bins
    middle = spatial.join(training.select("sensor_index").distinct(), "sensor_index", "left_semi").groupBy("centre").agg(F.avg("q").alias("m"))
    centred = waves.join(F.broadcast(middle), "centre").groupBy("draw", "bin").agg(F.sum(F.col("f") * F.col("m")).alias("m"))
    offset = mean.join(F.broadcast(centred), ["draw", "bin"]).select("draw", "bin", (F.col("mu") - F.col("m")).alias("offset"))
    asked = spatial if wanted is None else spatial.join(wanted.select("sensor_index").distinct(), "sensor_index", "left_semi")
    r = asked.join(F.broadcast(waves), "centre").groupBy("sensor_index", "draw", "bin").agg(F.sum(F.col("f") * F.col("q")).alias("r"))
    z = r.join(F.broadcast(offset), ["draw", "bin"]).select("sensor_index", "draw", "bin", (F.col("offset") + F.col("r")).alias("z"))
    return log_shape(z, "sensor_index", "draw").select("sensor_index", "draw", "bin", "log_s")


BASELINES = ("grid", "nearest", "grid+nearest", "grid+basis")


def baseline(mode: str, grid: DataFrame, nearest: DataFrame | None = None, levels: DataFrame | None = None, near_grid: DataFrame | None = None, basis: DataFrame | None = None) -> DataFrame:
    """(sensor_index, draw, base) of held-out sensors, at least 1e-12.

    grid: (sensor_index, grid) at the sensor; nearest: (sensor_index, near) its nearest training sensor; levels: (near, draw, level) posterior
    levels of training sensors; near_grid: (near, grid_near) the grid there; basis: (sensor_index, draw, delta) from the spatial basis.
    """
    if mode not in BASELINES:
        raise ValueError(f"unknown baseline {mode}")
    if mode == "grid":
        out = grid.select("sensor_index", F.lit(None).cast("long").alias("draw"), F.col("grid").alias("base"))
    elif mode == "grid+basis":
        out = grid.join(basis, "sensor_index").select("sensor_index", "draw", (F.col("grid") + F.col("delta")).alias("base"))
    else:
        rows = nearest.join(levels, "near")
        if mode == "nearest":
            out = rows.select("sensor_index", "draw", F.col("level").alias("base"))
        else:
            rows = rows.join(near_grid, "near").join(grid, "sensor_index")
            out = rows.select("sensor_index", "draw", (F.col("grid") + F.col("level") - F.col("grid_near")).alias("base"))
    return out.withColumn("base", F.greatest("base", F.lit(1e-12)))


def day_normalised(readings: DataFrame, value: str = "pm") -> DataFrame:
    """readings with ``shape``: the value over its sensor-day's mean, null where that is 0."""
    mean = F.avg(value).over(Window.partitionBy("sensor_index", "day"))
    return readings.withColumn("shape", F.when(mean != 0, F.col(value) / mean))


def metric_tables(pairs: DataFrame, with_bias: str, without_bias: str, observed: str) -> tuple[DataFrame, DataFrame]:
    """(per sensor, aggregate): errors of the prediction with and without the sensor bias, and their mean and median over sensors."""
    a = errors(pairs, observed, with_bias, "sensor_index")
    names = [c for c in a.columns if c not in ("sensor_index", "n")]
    b = errors(pairs, observed, without_bias, "sensor_index").select("sensor_index", *[F.col(c).alias(f"{c}_no_bias") for c in names])
    each = a.join(b, "sensor_index", "left")
    every = [*names, *[f"{c}_no_bias" for c in names]]
    return each, summarise(each.withColumn("_all", F.lit("all")), "_all", every).drop("_all")


def parameter_grid(values: list[float] | None = None, low: float | None = None, high: float | None = None, steps: int = 0, geometric: bool = False) -> list[float]:
    """A list, a geometric grid of ``steps`` values, or an inclusive range with step 1, sorted."""
    if values is not None:
        return sorted(set(values))
    if geometric:
        return [low * (high / low) ** (k / (steps - 1)) for k in range(steps)] if steps > 1 else [low]
    return [low + k for k in range(int(math.floor(high - low)) + 1)]


def within(metrics: DataFrame, key: str, low: float, high: float) -> DataFrame:
    """Rows whose parameter is in the range; others are skipped."""
    return metrics.filter(F.col(key).between(low, high))
