"""Zero-phase Butterworth filtering of ordered series of any length."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from netloom.operators.ordering import placed
from netloom.plans.shared import materialize

#: Steps of a series that one task runs through at a time.
CHUNK = 4096
#: Steps of all series that one task holds at a time, or a chunk if that is more.
HELD = 1 << 17


def butterworth(order: int, cutoff: float) -> tuple[np.ndarray, np.ndarray]:
    """Coefficients ``b`` and ``a`` (``a[0]`` is 1) of a digital low-pass filter; ``cutoff`` in shares of half the sample rate.

    The poles of the analog filter lie evenly on the left half circle; the
    cutoff is bent beforehand, so that the bilinear transform puts it right.
    """
    if order < 1 or not 0 < cutoff < 1:
        raise ValueError(f"no low-pass filter of order {order} and cutoff {cutoff}")
    angles = np.pi * (2 * np.arange(order) + 1 + order) / (2 * order)
    analog = 2 * np.tan(np.pi * cutoff / 2) * np.exp(1j * angles)
    poles = (2 + analog) / (2 - analog)
    a = np.poly(poles).real
    b = np.poly(-np.ones(order))
    return b * a.sum() / b.sum(), a


def steady_state(b: np.ndarray, a: np.ndarray) -> np.ndarray:
    """State in which a filter rests under a constant input of 1."""
    gain = b.sum() / a.sum()
    return np.cumsum((b[1:] - a[1:] * gain)[::-1])[::-1]


def run_filter(b: np.ndarray, a: np.ndarray, x: np.ndarray, state: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Output over ``x`` and the state behind it; the state is what earlier input still adds to the next outputs."""
    out = np.empty(len(x))
    z, more, back = [*state.tolist(), 0.0], b[1:].tolist(), a[1:].tolist()
    first = float(b[0])
    for i, v in enumerate(x.tolist()):
        y = first * v + z[0]
        z = [f * v + n - r * y for f, n, r in zip(more, z[1:], back)] + [0.0]
        out[i] = y
    return out, np.array(z[:-1])


def run_filters(b: np.ndarray, a: np.ndarray, x: np.ndarray, starts: np.ndarray, sizes: np.ndarray, states: np.ndarray) -> np.ndarray:
    """Outputs of :func:`run_filter` over ``sizes`` values of ``x`` from each of ``starts`` on, a column of ``states`` each; all take a step at once."""
    out = np.full(len(x), np.nan)
    order = np.argsort(-sizes, kind="stable")
    at, z = starts[order], states[:, order]
    first, more, back = b[0], b[1:, None], a[1:, None]
    # How many still run at each step; the longest come first.
    running = len(sizes) - np.cumsum(np.bincount(sizes))[:-1]
    for step, n in enumerate(running.tolist()):
        now = at[:n] + step
        v = x[now]
        y = first * v + z[0, :n]
        left = more * v
        left[:-1] += z[1:, :n]
        z = left - back * y
        out[now] = y
    return out


def _one_way(rows: DataFrame, b: np.ndarray, a: np.ndarray, kind: str) -> DataFrame:
    """``key, k, y`` of ``key, k, x, n``: the filter run over k from 0 to n - 1, at rest under the first value before it.

    Chunks run at once without a past, which gives the state that each leaves;
    a state before a chunk adds the filter's free run from it.  So the states
    before all chunks follow from those few numbers, and chunks then run with them.
    """
    size, rest = len(a) - 1, steady_state(b, a)
    # The state after one step without input, as a matrix.
    step = np.zeros((size, size))
    step[:, 0] = -a[1:]
    step[:-1, 1:] += np.eye(size - 1)
    power = np.linalg.matrix_power(step, CHUNK)
    rows = rows.withColumn("chunk", F.floor(F.col("k") / CHUNK))
    # Only series of more than one chunk have states to hand on.
    long = rows.where((F.col("n") > CHUNK) & (F.col("chunk") < F.floor((F.col("n") - 1) / CHUNK)))

    def leaves(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("k")
        _, state = run_filter(b, a, frame["x"].to_numpy(), np.zeros(size))
        return pd.DataFrame({"key": frame["key"].iloc[:1], "chunk": frame["chunk"].iloc[:1], "first": frame["x"].iloc[:1], "state": [state.tolist()]})

    def handed_on(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("chunk")
        state, states = rest * frame["first"].iloc[0], []
        for left in frame["state"]:
            state = power @ state + np.asarray(left)
            states.append(state.tolist())
        return pd.DataFrame({"key": frame["key"], "chunk": frame["chunk"] + 1, "state": states})

    before = long.groupBy("key", "chunk").applyInPandas(leaves, f"key {kind}, chunk long, first double, state array<double>")
    before = materialize(before.groupBy("key").applyInPandas(handed_on, f"key {kind}, chunk long, state array<double>"), "filter-states")

    # A chunk's state comes as its first row.
    begun = before.select("key", "chunk", F.lit(-1).cast("long").alias("k"), F.lit(None).cast("double").alias("x"), "state")
    whole = rows.select("key", "chunk", "k", "x", F.lit(None).cast("array<double>").alias("state")).unionAll(begun)
    # The window asks for the rows of a chunk in one task, and tells where a chunk begins.
    whole = whole.withColumn("place", F.row_number().over(Window.partitionBy("key", "chunk").orderBy("k"))).sortWithinPartitions("key", "chunk", "k")

    def smoothed(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        k, x = table.column("k").to_numpy(), table.column("x").to_numpy().astype(float)
        starts = np.flatnonzero(table.column("place").to_numpy() == 1)
        told = k[starts] < 0
        first = starts + told
        states = np.outer(rest, x[np.minimum(first, len(x) - 1)])
        if told.any():
            states[:, told] = np.array(table.column("state").take(starts[told]).to_pylist()).T
        y = run_filters(b, a, x, first, np.diff(starts, append=len(x)) - told, states)
        kept = np.flatnonzero(k >= 0)
        return pa.table([table.column("key").take(kept), pa.array(k[kept]), pa.array(y[kept])], names=["key", "k", "y"])

    def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, count = [], 0
        for batch in batches:
            held.append(batch)
            count += batch.num_rows
            fresh = np.flatnonzero(batch.column(batch.num_columns - 1).to_numpy() == 1)
            # All chunks but the last one are complete.
            if count >= HELD and len(fresh):
                table = pa.Table.from_batches(held)
                cut = count - batch.num_rows + int(fresh[-1])
                if cut:
                    yield from smoothed(table.slice(0, cut)).to_batches(CHUNK)
                held, count = table.slice(cut).to_batches(), count - cut
        if count:
            yield from smoothed(pa.Table.from_batches(held)).to_batches(CHUNK)

    return whole.mapInArrow(runs, f"key {kind}, k long, y double")


def low_pass(series: DataFrame, cutoff: float, key: str, order: str, value: str, degree: int = 5) -> DataFrame:
    """Butterworth low-pass of ``degree`` run forward, then backward, so that it shifts nothing.

    ``cutoff`` is in cycles for each step, below one half.  Each series, the
    rows of a ``key`` in ``order``, is lengthened at both ends by ``3 * (degree + 1)``
    values turned about its end value (odd padding), or by all but one of its
    values if it is shorter, and the filter begins at rest under the first value.
    A series of one value stays as it is.  Rows with a null value take no part;
    null keys are one series; equal places in ``order`` go by value.  A
    series may be of any length: places come by ranges, and chunks of a series run
    apart (see :func:`_one_way`).  Returns ``key, order, smooth``.
    """
    b, a = butterworth(degree, 2 * cutoff)
    most = 3 * (degree + 1)
    kind, order_kind = (series.schema[c].dataType.simpleString() for c in (key, order))
    rows = series.where(F.col(value).isNotNull()).select(F.col(key).alias("key"), F.col(order).alias("at"), F.col(value).cast("double").alias("x"))
    rows = materialize(placed(rows, ["key"], ["at", "x"], "k", "n"), "filter-places")
    ends = rows.groupBy("key").agg(F.min_by("x", "k").alias("head"), F.max_by("x", "k").alias("tail"))
    ends = ends.select(F.col("key").alias("of"), "head", "tail")
    pad = F.least(F.lit(most), F.col("n") - 1)
    edge = rows.where((F.col("k") <= most) | (F.col("k") >= F.col("n") - 1 - most)).join(ends, F.col("key").eqNullSafe(F.col("of")))
    # The rows next to an end once more, on the other side of it.
    before = edge.where((F.col("k") > 0) & (F.col("k") <= pad)).select("key", (-F.col("k")).alias("k"), (2 * F.col("head") - F.col("x")).alias("x"), "n")
    behind = edge.where((F.col("k") < F.col("n") - 1) & (F.col("k") >= F.col("n") - 1 - pad)).select("key", (2 * (F.col("n") - 1) - F.col("k")).alias("k"), (2 * F.col("tail") - F.col("x")).alias("x"), "n")
    whole = rows.select("key", "k", "x", "n").unionAll(before).unionAll(behind)
    whole = whole.select("key", (F.col("k") + pad).alias("k"), "x", (F.col("n") + 2 * pad).alias("n"))
    sizes = rows.where("k = 0").select(F.col("key").alias("of"), F.col("n").alias("own"), (F.col("n") + 2 * pad).alias("n"))
    forward = materialize(_one_way(whole, b, a, kind), "filter-forward").join(sizes, F.col("key").eqNullSafe(F.col("of")))
    backward = _one_way(forward.select("key", (F.col("n") - 1 - F.col("k")).alias("k"), F.col("y").alias("x"), "n"), b, a, kind)
    backward = backward.join(sizes, F.col("key").eqNullSafe(F.col("of")))
    found = backward.select(F.col("key").alias("s_key"), (F.col("own") - 1 - (F.col("k") - (F.col("n") - F.col("own")) / 2).cast("long")).alias("s_k"), "y")
    out = rows.join(found, F.col("key").eqNullSafe(F.col("s_key")) & (F.col("k") == F.col("s_k")))
    return out.select(F.col("key").cast(kind).alias(key), F.col("at").cast(order_kind).alias(order), F.col("y").alias("smooth"))
