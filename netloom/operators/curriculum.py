"""Loss state, sampling and smoothing over ordered series."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


#: Cells of a sample's share of the draws that one array holds.
CELLS = 65_536


def ema(values: Column, decay: float = 0.9) -> Column:
    """Exponential mean of an ordered array; the first value initialises it."""
    rest = F.slice(values, 2, F.greatest(F.size(values) - 1, F.lit(0)))
    return F.when(F.size(values) > 0, F.aggregate(rest, F.element_at(values, 1), lambda acc, x: decay * acc + (1 - decay) * x))


def ramped_ema(values: Column, decay: float = 0.9999, tau: float = 2000.0) -> Column:
    """Exponential mean whose decay ``decay * (1 - exp(-n / tau))`` grows with the update number n."""
    start = F.struct(F.lit(0.0).alias("v"), F.lit(0).alias("n"))

    def step(acc, x):
        d = decay * (1 - F.exp(-(acc["n"] + 1) / tau))
        return F.struct((d * acc["v"] + (1 - d) * x).alias("v"), (acc["n"] + 1).alias("n"))

    return F.aggregate(values, start, step, lambda acc: acc["v"])


def loss_state(losses: DataFrame, decay: float = 0.9) -> DataFrame:
    """State of each sample after all its losses: EMA, times sampled, history."""
    ordered = losses.groupBy("sample_id").agg(F.array_sort(F.collect_list(F.struct("step", "loss"))).alias("h"))
    history = F.transform("h", lambda x: x["loss"])
    return ordered.select("sample_id", history.alias("history"), F.size("h").cast("long").alias("times"), ema(history, decay).alias("ema"))


def dynamic_difficulty(initial: Column, ema_loss: Column, times: Column) -> Column:
    """Blend of first difficulty and squashed EMA; the first difficulty where never sampled."""
    return F.when(times > 0, 0.3 * initial + 0.7 / (1 + F.exp(1 - ema_loss))).otherwise(initial)


def improving(history: Column) -> Column:
    """Mean of the last three losses under 0.9 times the mean of those before; needs two losses."""
    total = lambda x: F.aggregate(x, F.lit(0.0), lambda a, b: a + b)
    n = F.size(history)
    recent = total(F.slice(history, F.greatest(n - 2, F.lit(1)), F.lit(3))) / F.least(n, F.lit(3))
    older = total(F.slice(history, 1, F.greatest(n - 3, F.lit(0)))) / F.greatest(n - 3, F.lit(1))
    return (n >= 2) & (recent < older * 0.9)


def self_paced(samples: DataFrame, state: DataFrame, top_stage: int, epoch: int) -> DataFrame:
    """Ids of the stage-based choice and, from epoch 5, of improving samples whatever their stage or exclusion."""
    staged = samples.where((F.col("stage") <= top_stage) & ~F.col("excluded")).select("sample_id")
    if epoch < 5:
        return staged
    return staged.unionAll(state.where(improving(F.col("history"))).select("sample_id")).distinct()


def weighted_draws(weights: DataFrame, draws: int, seed: int = 0) -> DataFrame:
    """``draws`` ids with replacement in proportion to ``weight``, from hashed uniforms.

    Weights are summed by bucket of the id's hash first, so the running sum is
    over a bounded number of buckets, then inside each.  A sample's range of the
    whole is cut into the ``draws`` equal cells that it touches, so draws find
    it by an equi-join on their cell.  Weights are positive.
    """
    b = weights.withColumn("bucket", F.pmod(F.xxhash64("sample_id"), F.lit(1024)))
    sums = b.groupBy("bucket").agg(F.sum("weight").alias("w"))
    run = Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.withColumn("before", F.coalesce(F.sum("w").over(run), F.lit(0.0))).withColumn("all", F.sum("w").over(Window.partitionBy()))
    inside = Window.partitionBy("bucket").orderBy("sample_id").rowsBetween(Window.unboundedPreceding, 0)
    until = (F.col("before") + F.sum("weight").over(inside)) / F.col("all")
    spans = b.join(F.broadcast(sums), "bucket").select("sample_id", until.alias("until"), (F.col("weight") / F.col("all")).alias("share"))
    low, high = F.greatest(F.floor((F.col("until") - F.col("share")) * draws - 1e-6), F.lit(0)), F.least(F.floor(F.col("until") * draws + 1e-6), F.lit(draws - 1))
    # By blocks first: one array of all the cells of a heavy sample could be as long as all draws.
    block = spans.withColumns({"low": low, "high": F.greatest(low, high)}).withColumn("block", F.explode(F.sequence(F.floor(F.col("low") / CELLS), F.floor(F.col("high") / CELLS))))
    cells = block.withColumn("cell", F.explode(F.sequence(F.greatest("low", F.col("block") * CELLS), F.least("high", (F.col("block") + 1) * CELLS - 1))))
    uniform = F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(1 << 52)) / float(1 << 52)
    asked = weights.sparkSession.range(draws).select(F.col("id").alias("draw"), uniform.alias("u"))
    placed = asked.withColumn("cell", F.least(F.floor(F.col("u") * draws), F.lit(draws - 1))).join(cells, "cell")
    # The last sample's end may lie a rounding error below a draw.
    found = placed.where((F.col("u") < F.col("until")) | (F.col("until") > 1 - 1e-12))
    return found.groupBy("draw").agg(F.min_by("sample_id", "until").alias("sample_id"))


def box_smooth(series: DataFrame, half: int, key: str, order: str, value: str) -> DataFrame:
    """Moving mean of ``2 * half + 1`` values; the ends are padded with the end values."""
    w = Window.partitionBy(key).orderBy(order)
    whole = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    k, n = F.row_number().over(w), F.count("*").over(Window.partitionBy(key))
    low, high = F.greatest(half + 1 - k, F.lit(0)), F.greatest(k + half - n, F.lit(0))
    total = F.sum(value).over(w.rowsBetween(-half, half)) + low * F.first(value).over(whole) + high * F.last(value).over(whole)
    return series.withColumn("smooth", total / (2 * half + 1))


def interpolated(knots: DataFrame, key: str, x: str, y: str, points: int) -> DataFrame:
    """Values of a piecewise linear curve on an even grid over [0, 1]; constant outside its knots."""
    w = Window.partitionBy(key).orderBy(x)
    spans = knots.withColumn("x2", F.lead(x).over(w)).withColumn("y2", F.lead(y).over(w)).withColumn("k", F.row_number().over(w))
    low = F.when(F.col("k") == 1, F.lit(0)).otherwise(F.ceil(F.col(x) * (points - 1) - 1e-9))
    high = F.when(F.col("x2").isNull(), F.lit(points - 1)).otherwise(F.ceil(F.col("x2") * (points - 1) - 1e-9) - 1)
    grid = spans.where(high >= low).withColumn("g", F.explode(F.sequence(low.cast("int"), high.cast("int"))))
    at = F.col("g") / (points - 1)
    share = F.when(F.col("x2") > F.col(x), (at - F.col(x)) / (F.col("x2") - F.col(x))).otherwise(0.0)
    value = F.when(F.col("x2").isNull() | (at < F.col(x)), F.col(y)).otherwise(F.col(y) + (F.col("y2") - F.col(y)) * share)
    return grid.select(key, "g", value.alias("value"))


def normalized_weights(state: DataFrame) -> DataFrame:
    """``sample_id, weight``: 1 / (EMA loss + 0.1), 1 where never sampled, in shares of the sum of all."""
    raw = state.select("sample_id", F.when(F.col("times") > 0, 1 / (F.col("ema") + 0.1)).otherwise(1.0).alias("w"))
    return raw.crossJoin(F.broadcast(raw.agg(F.sum("w").alias("all")))).select("sample_id", (F.col("w") / F.col("all")).alias("weight"))


def smoothed_best(series: DataFrame, fraction: float, key: str, order: str, value: str) -> DataFrame:
    """The row of each series where its mean over ``fraction`` of its length is largest, ties to the first.

    The filter takes an odd number of values, ``round(n * fraction * 2) // 2 + 1``, made odd by its padding of half as many.
    """
    w, whole = Window.partitionBy(key).orderBy(order), Window.partitionBy(key)
    half = F.floor(F.floor(F.bround(F.count("*").over(whole) * fraction * 2) / 2) / 2)
    runs = series.withColumn("_half", half).withColumn("_k", F.row_number().over(w)).withColumn("_n", F.count("*").over(whole)).withColumn("_sum", F.sum(value).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    ends = runs.groupBy(key).agg(F.min_by(value, "_k").alias("_a"), F.max_by(value, "_k").alias("_z"))
    at = lambda shift, name: runs.select(F.col(key).alias("_key"), (F.col("_k") + shift).alias("_at"), F.col("_sum").alias(name))
    high = runs.withColumn("_high", F.least(F.col("_k") + F.col("_half"), F.col("_n"))).withColumn("_low", F.greatest(F.col("_k") - F.col("_half") - 1, F.lit(0)))
    upper, lower = at(0, "_s2"), at(0, "_s1").withColumnsRenamed({"_key": "_key1", "_at": "_at1"})
    joined = high.join(ends, key).join(upper, (F.col(key) == F.col("_key")) & (F.col("_high") == F.col("_at"))).join(lower, (F.col(key) == F.col("_key1")) & (F.col("_low") == F.col("_at1")), "left")
    padded = F.greatest(F.col("_half") + 1 - F.col("_k"), F.lit(0)) * F.col("_a") + F.greatest(F.col("_k") + F.col("_half") - F.col("_n"), F.lit(0)) * F.col("_z")
    smooth = (F.col("_s2") - F.coalesce("_s1", F.lit(0.0)) + padded) / (2 * F.col("_half") + 1)
    return joined.withColumn("smooth", smooth).groupBy(key).agg(F.min_by(order, F.struct(-F.round("smooth", 9), F.col("_k"))).alias("best"), F.max(F.round("smooth", 9)).alias("smooth"))


def gaussian_smooth(series: DataFrame, sigma: float, key: str, order: str, value: str) -> DataFrame:
    """Gaussian smoothing of each series, mirrored at its ends."""
    import numpy as np

    def smooth(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(order)
        reach = int(4 * sigma + 0.5)
        kernel = np.exp(-0.5 * (np.arange(-reach, reach + 1) / sigma) ** 2)
        padded = np.pad(frame[value].to_numpy(float), reach, mode="symmetric")
        return frame[[key, order]].assign(smooth=np.convolve(padded, kernel / kernel.sum(), "valid"))

    kinds = {f.name: f.dataType.simpleString() for f in series.schema.fields}
    return series.select(key, order, value).groupBy(key).applyInPandas(smooth, f"{key} {kinds[key]}, {order} {kinds[order]}, smooth double")
