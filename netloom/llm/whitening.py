"""Whitening of embeddings by the eigenvectors of their covariance.

Components become integers, whose sums are exact, so rows are centred before
anything is multiplied and a large common offset costs no digits.  The Gramian of
the centred rows is summed by Spark's distributed row matrix; only matrices of
the size of one vector squared reach the driver.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.functions import array_to_vector
from pyspark.mllib.linalg.distributed import RowMatrix
from pyspark.mllib.util import MLUtils
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from netloom.llm.vectors import usable
from netloom.plans.shared import materialize

#: Scaled components stop at this size, so that sums of a batch stay exact; embeddings are far below.
LARGEST = 1 << 40
#: Eigenvalues under this share of the largest are rounding errors of zero.
NO_SPREAD = 1e-12


@dataclass
class Whitening:
    """What a fit over ``n`` vectors of one length has found; ``components`` has one column for each."""

    n: int
    sums: list[int]
    components: np.ndarray
    eigenvalues: np.ndarray
    explained: np.ndarray


def _exact_sums(rows: DataFrame, vector: str) -> dict[int, tuple[int, list[int]]]:
    """Count and exact sums by dimension for each length of vectors: one row for each task, length and dimension is shuffled."""

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, tuple[int, list[int]]] = {}
        for batch in batches:
            column = batch.column(0)
            sizes = np.diff(column.offsets.to_numpy())
            flat = column.flatten().to_numpy()
            for size in np.unique(sizes).tolist():
                found = flat[np.repeat(sizes == size, sizes)].reshape(-1, size)
                n, sums = held.get(size, (0, [0] * size))
                # A batch has under 2 ** 20 rows, so its sums fit into 64 bits; those of all rows need not.
                held[size] = n + len(found), [a + b for a, b in zip(sums, found.sum(0).tolist())]
        out = [(size, at, n, str(s)) for size, (n, sums) in held.items() for at, s in enumerate(sums)]
        names = ["size", "at", "n", "total"]
        yield pa.RecordBatch.from_arrays([pa.array([o[i] for o in out], k) for i, k in enumerate((pa.int32(), pa.int32(), pa.int64(), pa.string()))], names)

    parts = rows.select(vector).mapInArrow(partial, "size int, at int, n long, total string")
    found: dict[int, tuple[int, list[int]]] = {}
    # As many rows as the distinct lengths have dimensions.
    for r in parts.groupBy("size", "at").agg(F.sum("n").alias("n"), F.sum(F.col("total").cast("decimal(38,0)")).alias("total")).orderBy("size", "at").collect():
        found.setdefault(r["size"], (r["n"], []))[1].append(int(r["total"]))
    return found


def _gramian(rows: DataFrame, column: str) -> np.ndarray:
    """Sum of the outer products of the rows of an array column with themselves."""
    vectors = MLUtils.convertVectorColumnsFromML(rows.select(array_to_vector(F.col(column)).alias("v")), "v")
    return RowMatrix(vectors).computeGramianMatrix().toArray()


def _doubles(values: list[float] | list[int], kind: str):
    return F.lit(list(values)).cast(f"array<{kind}>")


def fit_whitening(rows: DataFrame, n: int, sums: list[int], most: int, vector: str = "x") -> Whitening:
    """Fit on ``rows``, whose column ``vector`` holds arrays of long of one length with the exact ``sums``.

    A row is centred as its distance from the floor of the mean, an exact
    integer, less the rest of the mean.  Components come by falling eigenvalue
    and have their largest entry positive.
    """
    whole, rest = _mean(n, sums)
    centred = F.transform(vector, lambda x, i: (x - F.element_at(_doubles(whole, "long"), i + 1)).cast("double") - F.element_at(_doubles(rest, "double"), i + 1))
    covariance = _gramian(rows.select(centred.alias("c")), "c") / n
    values, vectors = np.linalg.eigh((covariance + covariance.T) / 2)
    values, vectors = np.maximum(values[::-1], 0.0), vectors[:, ::-1]
    vectors = vectors * np.where(vectors[np.abs(vectors).argmax(0), np.arange(len(values))] < 0, -1.0, 1.0)
    trace = float(np.trace(covariance))
    explained = values / trace if trace > 0 else np.full(len(values), np.nan)
    return Whitening(n, list(sums), vectors[:, :most], values[:most], explained[:most])


def _mean(n: int, sums: list[int]) -> tuple[list[int], list[float]]:
    """Floor of the mean of each dimension, and what is left of it."""
    return [s // n for s in sums], [(s % n) / n for s in sums]


def apply_whitening(rows: DataFrame, fit: Whitening, id_col: str = "vec_id", vector: str = "x") -> DataFrame:
    """``id, deviation, whitened array<double>`` for each row, by a broadcast of the components.

    ``deviation`` is the exact sum of (n x - S)^2, null where it is no 64-bit
    integer.  A component without spread has null in ``whitened``.
    """
    whole, rest = _mean(fit.n, fit.sums)
    spread = _spread(fit)
    scaled = np.divide(fit.components, np.sqrt(fit.eigenvalues), out=np.full(fit.components.shape, np.nan), where=spread)
    sent = rows.sparkSession.sparkContext.broadcast((np.array(whole, np.int64), np.array(rest), scaled, spread, fit.n, fit.sums))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        floor, part, scale, sound, n, sums = sent.value
        # n x - S = n (x - floor) - S mod n
        left = np.array([s % n for s in sums], object)
        for frame in frames:
            off = np.stack(frame["x"].to_numpy()) - floor if len(frame) else np.zeros((0, len(floor)), np.int64)
            most = int(np.abs(off).max(initial=0)) * n + n
            if most * most * len(floor) < 1 << 63:
                far = off * n - left.astype(np.int64)
                deviation = (far * far).sum(1).tolist()
            else:
                far = off.astype(object) * n - left
                deviation = [d if d < 1 << 63 else None for d in (far * far).sum(1).tolist()]
            white = (off - part) @ scale
            told = [[v if ok else None for v, ok in zip(w, sound)] for w in white.tolist()] if not sound.all() else list(white)
            yield pd.DataFrame({"id": frame["id"], "deviation": pd.array(deviation, "Int64"), "whitened": told})

    kind = rows.schema[id_col].dataType.simpleString()
    return rows.select(F.col(id_col).alias("id"), F.col(vector).alias("x")).mapInPandas(run, f"id {kind}, deviation long, whitened array<double>")


def _spread(fit: Whitening) -> np.ndarray:
    return fit.eigenvalues > NO_SPREAD * max(fit.eigenvalues.max(initial=0.0), np.finfo(float).tiny)


def identity_error(white: DataFrame, fit: Whitening) -> float | None:
    """Largest entry by which the covariance of the whitened rows differs from the identity; None without a component of some spread."""
    sound = np.flatnonzero(_spread(fit)).tolist()
    if not sound:
        return None
    kept = white.select(F.array(*[F.element_at("whitened", i + 1) for i in sound]).alias("w"))
    mean = kept.agg(*[F.avg(F.element_at("w", i + 1)).alias(str(i)) for i in range(len(sound))]).first()
    centred = F.transform("w", lambda x, i: x - F.element_at(_doubles([float(m) for m in mean], "double"), i + 1))
    covariance = _gramian(kept.select(centred.alias("w")), "w") / fit.n
    return float(np.abs(covariance - np.eye(len(sound))).max())


def whitened_vectors(vectors: DataFrame, scale: int = 64, offset: int = 1_000_000, most: int = 32, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """Whitened coordinates of every usable vector, one row for each vector and component.

    Components of a vector become floor(scale * c) + offset as long.  All
    usable vectors are the fit list; the covariance has divisor n.  Rows with
    null and empty vectors and with null or non-finite components give nothing;
    repeated rows and ids each count in the fit and give rows, null ids stay
    null.  Vectors of different lengths are fitted apart, each length over its
    own n.  Scaled components stop at ``LARGEST``.  ``whitened`` is null for a
    component without spread, as with equal vectors or fewer vectors than
    dimensions; ``identity_error`` leaves such components out and is null if
    there is no other, ``explained`` is null if nothing has any.  An empty table
    gives an empty result.  The driver holds a few square matrices of a
    vector's length, never rows.
    """
    rows = vectors.select(F.col(id_col).alias("id"), F.col(vector_col).alias("v")).where(usable("v"))
    scaled = F.transform("v", lambda x: F.floor(F.greatest(F.least(x.cast("double") * scale, F.lit(float(LARGEST))), F.lit(-float(LARGEST)))).cast("long") + F.lit(offset).cast("long"))
    rows = rows.select("id", scaled.alias("x"))
    kind = rows.schema["id"].dataType.simpleString()
    parts = []
    for size, (n, sums) in _exact_sums(rows, "x").items():
        same = rows.where(F.size("x") == size)
        fit = fit_whitening(same, n, sums, most)
        # Written once: the check of the covariance and the result read the same numbers.
        white = materialize(apply_whitening(same, fit, "id"), "whitened")
        error = identity_error(white, fit)
        explained = F.lit([float(e) for e in fit.explained]).cast("array<double>")
        each = white.select("id", "deviation", F.posexplode("whitened").alias("at", "whitened"))
        parts.append(
            each.select(
                F.col("id").alias("vec_id"),
                (F.col("at") + 1).cast("int").alias("component"),
                F.lit(n).cast("long").alias("n"),
                "deviation",
                "whitened",
                F.nanvl(F.element_at(explained, F.col("at") + 1), F.lit(None).cast("double")).alias("explained"),
                F.lit(error).cast("double").alias("identity_error"),
            )
        )
    if not parts:
        return vectors.sparkSession.createDataFrame([], f"vec_id {kind}, component int, n long, deviation long, whitened double, explained double, identity_error double")
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out
