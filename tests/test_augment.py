"""Mosaic labels and pasted copies against loops with the same draws."""

from __future__ import annotations

import hashlib
import math
import os
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from netloom.operators import augment

SIZE, SEED = 100, 3


def draw(*parts):
    return int(hashlib.md5(":".join(map(str, (SEED, *parts))).encode()).hexdigest()[:8], 16) / 2**32


def share(a, b):
    """Part of the box b that a covers."""
    w, h = min(a[2], b[2]) - max(a[0], b[0]), min(a[3], b[3]) - max(a[1], b[1])
    return max(w, 0) * max(h, 0) / ((b[2] - b[0]) * (b[3] - b[1]) + 1e-7)


@pytest.fixture(scope="module")
def drawn():
    """Images of which one holds a third of all labels and some hold none."""
    rng = random.Random(5)
    images = {10 + 3 * k: (rng.randrange(40, 101), rng.randrange(40, 101)) for k in range(25)}
    labels = []
    for n, image in enumerate([10] * 40 + [rng.choice(list(images)[:20]) for _ in range(80)]):
        x, y = rng.random() * 0.8, rng.random() * 0.8
        labels.append((image, n, n % 4, x, y, x + rng.random() * 0.2, y + rng.random() * 0.2))
    return images, labels


def mosaics(images, labels):
    ids, out = sorted(images), {}
    for own in ids:
        xc, yc = (math.floor(SIZE / 2 + draw(own, axis) * SIZE) for axis in "xy")
        members = [own] + [ids[math.floor(draw(own, f"p{k}") * len(ids))] for k in range(3)]
        order = sorted(range(4), key=lambda k: (draw(own, f"t{k}"), k))
        out[own] = []
        for tile, k in enumerate(order):
            w, h = images[members[k]]
            # Where the image's own corner comes to lie: beside the centre, on the tile's side of it.
            left, top = (xc - w, xc)[tile % 2], (yc - h, yc)[tile // 2]
            for image, det, cls, *box in labels:
                if image == members[k]:
                    moved = [v * (w, h)[i % 2] + (left, top)[i % 2] for i, v in enumerate(box)]
                    new = [min(max(v, 0.0), 2.0 * SIZE) for v in moved]
                    area = (moved[2] - moved[0]) * (moved[3] - moved[1])
                    if new[2] - new[0] > 2 and new[3] - new[1] > 2 and (new[2] - new[0]) * (new[3] - new[1]) > 0.1 * area:
                        out[own].append((tile, image, det, cls, *new))
    return out


def test_mosaics_and_copies(spark, drawn):
    images, labels = drawn
    table = spark.createDataFrame([(k, w, h, "x") for k, (w, h) in images.items()], "image_id long, width int, height int, tile string").repartition(3)
    boxes = spark.createDataFrame(labels, "image_id long, det_id long, cls int, x1 double, y1 double, x2 double, y2 double")
    tiles = augment.mosaic_tiles(table, SIZE, SEED)
    assert tiles.count() == 4 * len(images) and tiles.groupBy("mosaic_id").agg(F.count_distinct("tile").alias("n")).where("n <> 4").count() == 0
    found = augment.mosaic_labels(tiles, boxes, SIZE).cache()
    want = mosaics(images, labels)
    flat = lambda rows: sorted((r.mosaic_id, r.tile, r.image_id, r.det_id, r.cls, *(round(r[c], 6) for c in ("x1", "y1", "x2", "y2"))) for r in rows)
    assert flat(found.collect()) == sorted((m, *r[:4], *(round(v, 6) for v in r[4:])) for m, rows in want.items() for r in rows)
    pasted = []
    for m, rows in want.items():
        stand = [r[4:] for r in rows]
        for tile, image, det, cls, x1, y1, x2, y2 in sorted(rows, key=lambda r: (draw(m, r[0], r[1], r[2]), r[0], r[2]))[: round(len(rows) * 0.5)]:
            box = (2 * SIZE - x2, y1, 2 * SIZE - x1, y2)
            if all(share(box, b) < 0.3 for b in stand):
                stand.append(box)
                pasted.append((m, tile, image, det, cls, *(round(v, 6) for v in box)))
    assert flat(augment.pasted_copies(found, SIZE, SEED).collect()) == sorted(pasted) and len(pasted) > 30
    # The same again in another order of rows; nothing of nothing.
    again = augment.mosaic_labels(augment.mosaic_tiles(table.orderBy(F.desc("width")), SIZE, SEED), boxes.repartition(4), SIZE)
    assert flat(again.collect()) == flat(found.collect())
    assert augment.mosaic_tiles(table.limit(0), SIZE, SEED).count() == 0 and augment.pasted_copies(found.limit(0), SIZE, SEED).count() == 0


def test_pasted_copies_leave_no_ranges(spark):
    """The ranges that told which labels are tried are gone from the shared folder once those labels are written."""
    from netloom.plans.shared import shared_dir

    folder = f"{shared_dir(spark)}/netloom"
    held = set(os.listdir(folder)) if os.path.isdir(folder) else set()
    labels = spark.range(40).select((F.col("id") % 4).alias("mosaic_id"), F.lit(0).alias("tile"), F.col("id").alias("image_id"), F.col("id").alias("det_id"), F.lit(1).alias("cls"), *[(F.col("id") * 10.0 + k).alias(c) for c, k in (("x1", 0), ("y1", 0), ("x2", 5), ("y2", 5))])
    assert augment.pasted_copies(labels, 400, 3).count() > 0
    assert {n.split("-")[0] for n in set(os.listdir(folder)) - held} == {"pasted"}


def test_copies_and_labels_in_small_steps(monkeypatch):
    """Copies that labels hide, and copies in turn, against a loop; a step compares few pairs and drops a copy at its first label."""
    rng = random.Random(8)
    monkeypatch.setattr(augment, "PAIRS", 7)
    sizes = [1, 30, 0, 5, 12]
    mosaic = np.repeat(np.arange(5), sizes)
    low = np.array([[rng.random() * 60, rng.random() * 60] for _ in mosaic]).T
    labels = np.concatenate((low, low + np.array([[rng.random() * 20 + 1, rng.random() * 20 + 1] for _ in mosaic]).T))
    labels[2, 3] = np.nan
    copies = np.stack((80 - labels[2], labels[1], 80 - labels[0], labels[3]))
    first, count = (np.cumsum(sizes) - sizes)[mosaic], np.array(sizes)[mosaic]
    free = augment._unhidden(copies, labels, first, count, 0.3)
    want = [all(not share(copies[:, i], labels[:, j]) >= 0.3 for j in range(first[i], first[i] + count[i]) if j != 3) for i in range(len(mosaic))]
    assert [f for i, f in enumerate(free) if i != 3] == [w for i, w in enumerate(want) if i != 3] and 0 < free.sum() < len(free)
    at = np.array([i for i in range(len(mosaic)) if i != 3])
    stay, stand = augment._stay(labels[:, at], mosaic[at], 0.3), []
    for i, kept in zip(at, stay):
        assert kept == all(share(labels[:, i], labels[:, j]) < 0.3 for j in stand if mosaic[j] == mosaic[i])
        stand += [i] * bool(kept)
    assert 0 < stay.sum() < len(stay)


def test_copies_of_groups_across_batches(spark, drawn, monkeypatch):
    """Mosaics that go on in the next batches, and more of them than are tried together, give the same copies."""
    images, labels = drawn
    table = spark.createDataFrame([(k, w, h) for k, (w, h) in images.items()], "image_id long, width int, height int")
    boxes = spark.createDataFrame(labels, "image_id long, det_id long, cls int, x1 double, y1 double, x2 double, y2 double")
    found = augment.mosaic_labels(augment.mosaic_tiles(table, SIZE, SEED), boxes, SIZE).cache()
    want = sorted(map(str, augment.pasted_copies(found, SIZE, SEED).collect()))
    monkeypatch.setattr(augment, "LABELS", 5)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
    try:
        assert sorted(map(str, augment.pasted_copies(found, SIZE, SEED).collect())) == want
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_packed_boxes(spark):
    rows = [(1, 0, 1, 2, 3), (2, 0, 32767, 32767, 32767), (3, -1, 0, 0, 0), (4, 5, 6, 7, 32768), (5, 1, None, 2, 3), (6, 2**40, 1, 1, 1), (7, None, None, None, None)]
    table = spark.createDataFrame(rows, "k long, x1 long, y1 long, x2 long, y2 long")
    packed = augment.packed_boxes(table).cache()
    assert {r.k for r in packed.where("box is not null").collect()} == {1, 2}
    assert sorted(map(tuple, augment.unpacked_boxes(packed).select(*table.columns).collect())) == rows


def test_pasted_copies_write_no_labels(spark):
    """Labels of mosaics are exchanged once and written nowhere; what is written are the numbered images and the copies."""
    from netloom.plans import operator_queries
    from netloom.plans.shared import shared_dir

    folder = f"{shared_dir(spark)}/netloom"
    held = set(os.listdir(folder)) if os.path.isdir(folder) else set()
    assert operator_queries.QUERIES["pasted_copies"](spark, "/root/testdata/sf0.001").count() > 0
    assert {n.rsplit("-", 1)[0] for n in set(os.listdir(folder)) - held} == {"ranges", "mosaic-images", "pasted"}


def test_an_image_without_an_id_is_numbered_last(spark):
    """Draws go by the order of the SQL, in which nulls are last."""
    table = spark.createDataFrame([(None, 50, 40), *[(k, 50, 40) for k in range(5)]], "image_id long, width int, height int")
    got = {(r.mosaic_id, r.tile): r.image_id for r in augment.mosaic_tiles(table, SIZE, SEED).collect()}
    for own in range(5):
        members = [own] + [[0, 1, 2, 3, 4, None][math.floor(draw(own, f"p{k}") * 6)] for k in range(3)]
        assert [got[own, t] for t in range(4)] == [members[k] for k in sorted(range(4), key=lambda k: (draw(own, f"t{k}"), k))]
