"""Labels of composed training images: mosaics of four images and pasted copies.  Pixels stay outside."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from netloom.operators.ordering import numbered, whole_groups
from netloom.plans.shared import materialize, partitions

#: Labels whose mosaics are tried together, and pairs of boxes compared together.
LABELS, PAIRS = 8192, 1 << 17
#: Corners of a box.
_BOX = ("x1", "y1", "x2", "y2")


def uniform(seed: int, *parts: Column | str) -> Column:
    """A number from 0 to below 1 from seed and parts by MD5, the same on every engine and in every run."""
    text = F.concat_ws(":", F.lit(str(seed)), *[F.col(p).cast("string") if isinstance(p, str) else p for p in parts])
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 8), 16, 10).cast("bigint") / float(1 << 32)


def mosaic_tiles(images: DataFrame, size: int, seed: int) -> DataFrame:
    """``mosaic_id, tile, image_id, pad_x, pad_y, width, height``: four images around a centre for each image.

    ``images`` has ``image_id, width, height`` of images no larger than ``size``.  Three
    partners are drawn with replacement from all images (one without an id is the last) and join by their number, so
    no image meets all others; the four stand in random order from the upper left to the
    lower right of a canvas of twice the size, whose centre lies in its middle half.
    """
    told = materialize(numbered(images.select("image_id", "width", "height"), [F.col("image_id").asc_nulls_last()], "nth"), "mosaic-images")
    count = told.count()
    drawn = F.array(*[F.floor(uniform(seed, "image_id", F.lit(f"p{k}")) * count) for k in range(3)])
    centre = lambda axis: F.floor(size / 2 + uniform(seed, "image_id", F.lit(axis)) * size)
    own = told.select(F.col("image_id").alias("mosaic_id"), centre("x").alias("xc"), centre("y").alias("yc"), F.concat(F.array("nth"), drawn).alias("members"), *[uniform(seed, "image_id", F.lit(f"t{k}")).alias(f"t{k}") for k in range(4)])
    order = F.array_sort(F.array(*[F.struct(F.col(f"t{k}").alias("u"), F.lit(k).alias("k")) for k in range(4)]))
    tiles = own.withColumn("order", order).select("mosaic_id", "xc", "yc", "members", F.posexplode("order").alias("tile", "o"))
    tiles = tiles.select("mosaic_id", "tile", "xc", "yc", F.element_at("members", F.col("o.k") + 1).alias("nth"))
    parts = partitions(images)
    # Draws are even, so no partition is large where they grow in number with the images.
    tiles = tiles.repartition(parts, "nth") if parts > int(images.sparkSession.conf.get("spark.sql.shuffle.partitions")) else tiles
    joined = tiles.join(told, "nth")
    pad_x = F.when(F.col("tile") % 2 == 0, F.col("xc") - F.col("width")).otherwise(F.col("xc"))
    pad_y = F.when(F.col("tile") < 2, F.col("yc") - F.col("height")).otherwise(F.col("yc"))
    return joined.select("mosaic_id", "tile", "image_id", pad_x.alias("pad_x"), pad_y.alias("pad_y"), "width", "height")


def mosaic_labels(tiles: DataFrame, labels: DataFrame, size: int, least_side: float = 2.0, least_share: float = 0.1, of: tuple[str, str] | None = None, deal: Callable[[DataFrame], DataFrame] = lambda rows: rows) -> DataFrame:
    """``mosaic_id, tile, image_id, det_id, cls`` and corners of the labels on each mosaic's canvas.

    ``labels`` has corners in shares of their image, or in pixels of an image whose width and height
    are the columns ``of``. Boxes are shifted with their tile
    and clipped to the canvas; a box goes unless both its sides are over ``least_side`` pixels
    and more than ``least_share`` of its area is left.  An image's labels
    come as often as mosaics hold it, four times on average; ``deal`` may exchange those that are left before they are
    shifted, while corners are small numbers.
    """
    share = {c: F.col(c).cast("double") / F.col(of[c[0] == "y"]).cast("double") if of else F.col(c) for c in _BOX}
    whole = {c: share[c] * F.col("width" if c[0] == "x" else "height") + F.col(f"pad_{c[0]}") for c in _BOX}
    clipped = {c: F.least(F.greatest(whole[c], F.lit(0.0)), F.lit(2.0 * size)) for c in _BOX}
    area = (whole["x2"] - whole["x1"]) * (whole["y2"] - whole["y1"])
    wide, high = clipped["x2"] - clipped["x1"], clipped["y2"] - clipped["y1"]
    kept = tiles.join(labels, "image_id").where((wide > least_side) & (high > least_side) & (wide * high > least_share * area))
    return deal(kept).select("mosaic_id", "tile", "image_id", "det_id", "cls", *[clipped[c].alias(c) for c in _BOX])


def packed_boxes(rows: DataFrame) -> DataFrame:
    """``rows`` with whole-numbered corners in one number, ``box``, where all are from 0 to below 2 ** 15, else as they are in ``wide``: an exchange takes half the bytes."""
    small = F.lit(True)
    for c in _BOX:
        small = small & F.col(c).between(0, (1 << 15) - 1)
    box = sum((F.shiftleft(F.col(c).cast("long"), 15 * i) for i, c in enumerate(_BOX)), F.lit(0).cast("long"))
    kept = [c for c in rows.columns if c not in _BOX]
    return rows.select(*kept, F.when(small, box).alias("box"), F.when(small, None).otherwise(F.struct(*_BOX)).alias("wide"))


def unpacked_boxes(rows: DataFrame) -> DataFrame:
    """Corners again from :func:`packed_boxes`."""
    part = lambda i: F.shiftright("box", 15 * i).bitwiseAND((1 << 15) - 1)
    return rows.select(*[c for c in rows.columns if c not in ("box", "wide")], *[F.when(F.col("box").isNull(), F.col(f"wide.{c}").cast("long")).otherwise(part(i)).alias(c) for i, c in enumerate(_BOX)])


def _obscured(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Share of each box of ``b`` that the box of ``a`` beside it covers; boxes are four rows of corners, and one without a corner has no share."""
    wide, high = (np.fmin(a[k + 2], b[k + 2]) - np.fmax(a[k], b[k]) for k in (0, 1))
    return np.fmax(wide, 0) * np.fmax(high, 0) / ((b[2] - b[0]) * (b[3] - b[1]) + 1e-7)


def _beside(first: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of each row and the ``count`` places from its ``first`` on."""
    row = np.repeat(np.arange(len(count)), count)
    return row, np.arange(len(row)) + np.repeat(first - (np.cumsum(count) - count), count)


def _unhidden(copies: np.ndarray, labels: np.ndarray, first: np.ndarray, count: np.ndarray, most: float) -> np.ndarray:
    """Which copies cover less than ``most`` of each of the ``count`` labels from ``first`` on; those that are out meet no further labels."""
    left, done = np.arange(copies.shape[1]), 0
    free = np.ones(len(left), bool)
    while len(left := left[free[left] & (count[left] > done)]):
        step = max(PAIRS // len(left), 1)
        row, label = _beside(first[left] + done, np.minimum(count[left] - done, step))
        free[left[row[_obscured(copies[:, left[row]], labels[:, label]) >= most]]] = False
        done += step
    return free


def _stay(copies: np.ndarray, mosaic: np.ndarray, most: float) -> np.ndarray:
    """Which copies cover less than ``most`` of those before them that stay; the first ones of all mosaics are tried together, then the second ones."""
    first = np.flatnonzero(np.diff(mosaic, prepend=-1))
    count = np.diff(np.append(first, len(mosaic)))
    stay = np.zeros(len(mosaic), bool)
    for k in range(int(count.max(initial=0))):
        start = first[count > k]
        row, before = _beside(start, np.full(len(start), k))
        kept = stay[before]
        row, before = row[kept], before[kept]
        stay[start + k] = True
        stay[(start + k)[row[_obscured(copies[:, (start + k)[row]], copies[:, before]) >= most]]] = False
    return stay


def pasted_copies(labels: DataFrame, size: int, seed: int, share: float = 0.5, most: float = 0.3) -> DataFrame:
    """Mirrored copies of a share of each mosaic's labels that hide nothing: ``mosaic_id, tile, image_id, det_id, cls`` and corners.

    Labels are drawn without replacement, ``round(share * n)`` of n, and tried one after
    the other; a copy stays if it covers less than ``most`` of every label and of every
    copy before it.  A task that has all labels of a mosaic does so by array operations, for many
    mosaics at once, so labels move only where they are not dealt by mosaic yet; the copies are written once.
    A task holds the labels of one mosaic, whatever their number, but never all pairs of them.
    """
    keys = ["mosaic_id", "tile", "image_id", "det_id"]
    # The window asks for rows by mosaic, and for an exchange or a sort only where they are not.
    dealt = labels.where(F.col("mosaic_id").isNotNull()).select(*keys, "cls", *_BOX, uniform(seed, *keys).alias("u"), F.count("*").over(Window.partitionBy("mosaic_id")).alias("n"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, mosaic in whole_groups(batches, LABELS):
            tile, det, u, n = (batch.column(batch.schema.get_field_index(c)) for c in ("tile", "det_id", "u", "n"))
            x1, y1, x2, y2 = (batch.column(batch.schema.get_field_index(c)).to_numpy(zero_copy_only=False).astype(float) for c in _BOX)
            first = np.flatnonzero(np.diff(mosaic, prepend=-1))
            count = n.to_numpy()
            drawn = pc.sort_indices(pa.table([pa.array(mosaic), u, tile, det], names=["mosaic", "u", "tile", "det"]), sort_keys=[(c, "ascending") for c in ("mosaic", "u", "tile", "det")], null_placement="at_start").to_numpy().astype(np.int64)
            # Mosaics lie at the same places before and after this sort.
            tried = drawn[np.arange(len(drawn)) - first[mosaic] < np.round(count * share)]
            turned = np.stack((2.0 * size - x2, y1, 2.0 * size - x1, y2))
            free = tried[_unhidden(turned[:, tried], np.stack((x1, y1, x2, y2)), first[mosaic[tried]], count[tried], most)]
            at = pa.array(free[_stay(turned[:, free], mosaic[free], most)])
            new = {"x1": pa.array(turned[0], from_pandas=True), "x2": pa.array(turned[2], from_pandas=True)}
            yield pa.RecordBatch.from_arrays([new.get(c, batch.column(i)).take(at) for i, c in enumerate(names)], names)

    names = [*keys, "cls", *_BOX]
    schema = StructType([StructField(c, DoubleType() if c in ("x1", "x2") else labels.schema[c].dataType) for c in names])
    return materialize(dealt.mapInArrow(run, schema), "pasted")
