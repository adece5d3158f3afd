"""Anchor boxes: fit statistics, k-means start and hill climbing."""

from __future__ import annotations

import numpy as np
from pyspark.ml.clustering import KMeans
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def anchor_fitness(boxes: DataFrame, anchors: np.ndarray, threshold: float = 0.25) -> float:
    """Mean best ratio of boxes whose best ratio exceeds ``threshold``; one aggregation."""
    fits = [F.least(F.col("w") / float(w), float(w) / F.col("w"), F.col("h") / float(h), float(h) / F.col("h")) for w, h in anchors]
    best = F.greatest(*fits) if len(fits) > 1 else fits[0]
    return boxes.select(F.avg(F.when(best > threshold, best).otherwise(0.0)).alias("f")).first()["f"] or 0.0


def kmeans_anchors(boxes: DataFrame, n: int, seed: int = 0) -> np.ndarray:
    """``n`` anchors by k-means on widths and heights scaled to unit deviation, ordered by area."""
    able = boxes.where("w >= 2 or h >= 2")
    scale = able.select(F.stddev_pop("w").alias("w"), F.stddev_pop("h").alias("h")).first()
    sw, sh = scale["w"] or 1.0, scale["h"] or 1.0
    rows = VectorAssembler(inputCols=["a", "b"], outputCol="features").transform(able.select((F.col("w") / sw).alias("a"), (F.col("h") / sh).alias("b")))
    model = KMeans(k=n, seed=seed, maxIter=30).fit(rows)
    found = np.array([c * np.array([sw, sh]) for c in model.clusterCenters()])
    return found[np.argsort(found.prod(1))]


def size_histogram(boxes: DataFrame, step: float = 1.0) -> np.ndarray:
    """Rows ``w, h, n``: how many boxes have a size, in whole steps.

    A box is no larger than its image, so the rows are at most (side / step) ** 2,
    however many boxes there are.
    """
    cells = boxes.select(*[(F.round(F.col(c) / step) * step).alias(c) for c in ("w", "h")]).groupBy("w", "h").count()
    return np.array([(r["w"], r["h"], r["count"]) for r in cells.collect()], float).reshape(-1, 3)


def histogram_fitness(sizes: np.ndarray, anchors: np.ndarray, threshold: float = 0.25) -> float:
    """:func:`anchor_fitness` of a size histogram; 0 without boxes."""
    ratio = sizes[:, None, :2] / anchors[None]
    best = np.minimum(ratio, 1 / np.maximum(ratio, 1e-12)).min(2).max(1)
    return float((best * (best > threshold) * sizes[:, 2]).sum() / max(sizes[:, 2].sum(), 1))


def evolve_anchors(boxes: DataFrame, start: np.ndarray, generations: int = 1000, seed: int = 0, step: float = 1.0) -> np.ndarray:
    """Hill climbing over ``generations`` mutations, ordered by area.

    Nine of ten sides change, by a normal factor of deviation 0.1 times one
    uniform number for the generation, within 0.3 and 3; a side stays 2 at
    least.  Fitness comes from the size histogram, one aggregation for all
    generations.
    """
    rng = np.random.default_rng(seed)
    sizes = size_histogram(boxes, step)
    best, fitness = start, histogram_fitness(sizes, start)
    for _ in range(generations):
        factor = np.ones(best.shape)
        while (factor == 1).all():
            factor = ((rng.random(best.shape) < 0.9) * rng.random() * rng.normal(size=best.shape) * 0.1 + 1).clip(0.3, 3.0)
        tried = np.maximum(best * factor, 2.0)
        if (found := histogram_fitness(sizes, tried)) > fitness:
            best, fitness = tried, found
    return best[np.argsort(best.prod(1))]
