"""Masks as runs against single pixels, and places inside groups."""

from __future__ import annotations

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from netloom.operators import masks, ordering

WIDTH, HEIGHT = 40, 30


def filled(corners):
    """Every pixel tested on its own: between crossings of its row, or nearest to an edge."""
    mask = np.zeros((HEIGHT, WIDTH), bool)
    edges = [sorted(((ay, ax), (by, bx))) for (ax, ay), (bx, by) in zip(corners, corners[1:] + corners[:1])]
    for y in range(HEIGHT):
        for x in range(WIDTH):
            crossings, on_edge = [], False
            for (ya, xa), (yb, xb) in edges:
                dx, dy = xb - xa, yb - ya
                if ya <= y < yb:
                    crossings.append(xa + (y - ya) * dx / dy)
                if dy == 0:
                    on_edge |= y == ya and xa <= x <= xb
                elif abs(dx) <= dy:
                    on_edge |= ya <= y <= yb and x == xa + (2 * (y - ya) * dx + dy) // (2 * dy)
                elif min(xa, xb) <= x <= max(xa, xb):
                    on_edge |= y == ya + math.floor((2 * (x - xa) * dy / dx + 1) / 2)
            mask[y, x] = on_edge or sum(c <= x for c in crossings) % 2 == 1 or x in crossings
    return mask.ravel()


@pytest.fixture(scope="module")
def polygons():
    rng = random.Random(4)
    rows, want = [], {}
    for i in range(120):
        corners = [(rng.randrange(-6, WIDTH + 6), rng.randrange(-6, HEIGHT + 6)) for _ in range(rng.choice([1, 2, 3, 4, 5, 7, 9]))]
        if i % 3 == 0:
            corners = [(min(max(x, 0), WIDTH - 1), min(max(y, 0), HEIGHT - 1)) for x, y in corners]
        # Half of the polygons lie in one image; some are repeated.
        corners = rows[-1][2] if i % 10 == 9 else corners
        rows.append((0 if i % 2 else i % 6, i, corners))
        want[i] = filled(corners)
    rows += [(0, 1000, []), (0, 1001, None), (5, 1002, [(None, 3)]), (None, 1003, [(1, 1)])]
    want |= {k: np.zeros(WIDTH * HEIGHT, bool) for k in (1000, 1001, 1002)}
    want[1003] = filled([(1, 1)])
    return rows, want


@pytest.fixture(scope="module")
def found(spark, polygons):
    rows = [(i, d, None if p is None else [{"x": x, "y": y} for x, y in p], "mine") for i, d, p in polygons[0]]
    return masks.polygon_masks(spark.createDataFrame(rows, "image_id int, det_id int, points array<struct<x:int,y:int>>, runs string"), WIDTH, HEIGHT).cache()


def test_filled_polygons(found, polygons):
    for r in found.collect():
        got = np.zeros(WIDTH * HEIGHT, bool)
        for a, b in zip(r.runs, r.runs[1:]):
            assert a.high < b.low
        for run in r.runs:
            got[run.low : run.high] = True
        assert (got == polygons[1][r.det_id]).all(), r
    assert found.select("det_id", masks.mask_area(F.col("runs")).alias("n")).where("n = 0").count() >= 3
    assert masks.polygon_masks(found.limit(0).withColumn("points", F.expr("array(named_struct('x', 1, 'y', 1))")), 4, 4).count() == 0


def test_fill_in_small_batches(spark, found, polygons, monkeypatch):
    corners = [(i, d, [{"x": x, "y": y} for x, y in p or [] if x is not None]) for i, d, p in polygons[0]]
    monkeypatch.setattr(masks, "FILLED", 3)
    again = masks.polygon_masks(spark.createDataFrame(corners, "image_id int, det_id int, points array<struct<x:int,y:int>>"), WIDTH, HEIGHT)
    assert sorted(map(str, again.collect())) == sorted(map(str, found.collect()))


def test_overlaps(found, polygons):
    rows, want = polygons
    pairs = masks.mask_iou(found, found.withColumnRenamed("det_id", "gt_id")).collect()
    images = [r[0] for r in rows if r[0] is not None]
    assert len(pairs) == sum(images.count(i) ** 2 for i in set(images))
    for r in pairs:
        a, b = want[r.det_id], want[r.gt_id]
        assert r.shared == (a & b).sum() and r.iou == pytest.approx((a & b).sum() / ((a | b).sum() + 1e-7))
    shifted = found.withColumn("det_id", F.col("det_id") + 1)
    for r in masks.paired_mask_iou(found, shifted, ["image_id", "det_id"]).collect():
        assert r.shared == (want[r.det_id] & want[r.det_id - 1]).sum()


def test_packed_overlaps(spark, found, polygons):
    # Runs as bytes give what runs as arrays give; a null mask has no overlap, one without runs an empty one.
    corners = [(i, d, None if p is None else [{"x": x, "y": y} for x, y in p]) for i, d, p in polygons[0]]
    packed = masks.polygon_masks(spark.createDataFrame(corners, "image_id int, det_id int, points array<struct<x:int,y:int>>"), WIDTH, HEIGHT, packed=True)
    told = lambda t: sorted(map(str, masks.mask_iou(t, t.withColumnRenamed("det_id", "gt_id")).collect()))
    assert told(packed) == told(found)
    runs = "image_id int, det_id int, runs array<struct<low: bigint, high: bigint>>"
    few = spark.createDataFrame([(1, 1, [(0, 4), (9, 12)]), (1, 2, []), (1, 3, None)], runs)
    got = {(r.det_id, r.gt_id): (r.shared, r.iou) for r in masks.mask_iou(few, few.withColumnRenamed("det_id", "gt_id")).collect()}
    assert got[1, 1] == (7, pytest.approx(1)) and got[1, 2] == got[2, 2] == (0, 0) and all(got[k, 3] == got[3, k] == (None, None) for k in (1, 2, 3))


def test_layers(found, polygons):
    rows, want = polygons
    ranks, layer = masks.layered_masks(found)
    ranks = {(r.image_id, r.rank): (r.det_id, r.area) for r in ranks.collect()}
    runs = layer.collect()
    for image in {r[0] for r in rows}:
        ids = sorted((r[1] for r in rows if r[0] == image), key=lambda i: (-want[i].sum(), i))
        assert [ranks[image, k + 1] for k in range(len(ids))] == [(i, want[i].sum()) for i in ids]
        top, got = np.zeros(WIDTH * HEIGHT, int), np.zeros(WIDTH * HEIGHT, int)
        for k, i in enumerate(ids):
            top[want[i]] = k + 1
        own = sorted((r.low, r.high, r["rank"]) for r in runs if r.image_id == image)
        for low, high, rank in own:
            assert (got[low:high] == 0).all()
            got[low:high] = rank
        assert (got == top).all()
        assert not any(a[1] == b[0] and a[2] == b[2] for a, b in zip(own, own[1:]))


def test_places(spark):
    """Numbers inside groups with a hot group, equal keys, null groups and columns that have names of the operator's own."""
    rng = random.Random(1)
    rows = [(rng.choice(["hot", "hot", "hot", "a", None]), rng.choice([1, 1, 1, 2, 3]), k, k, k) for k in range(400)]
    df = spark.createDataFrame(rows, "g string, v int, range_ int, nth int, _n int")
    got = ordering.placed(df, ["g"], ["v"], "nth", "all").collect()
    assert set(got[0].asDict()) == {"g", "v", "range_", "_n", "nth", "all"} and sorted(r._n for r in got) == list(range(400))
    for g in ("hot", "a", None):
        own = sorted((r.nth, r.v) for r in got if r.g == g)
        assert [n for n, _ in own] == list(range(len(own))) and [v for _, v in own] == sorted(v for _, v in own)
        assert {r.all for r in got if r.g == g} == {len(own)}
    again = ordering.numbered(df, ["v", "range_"]).collect()
    assert [r.range_ for r in sorted(again, key=lambda r: r.nth)] == [r[2] for r in sorted(rows, key=lambda r: (r[1], r[2]))]
    assert ordering.numbered(df.limit(0), ["v"]).count() == 0


def test_layers_of_long_runs(spark):
    """Layers cost their pieces, not their pixels, and images that go on in the next batches meet whole."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "2")
    try:
        wide = [(None if i == 3 else i, k, [(10 * k, 10**10 - 10 * k)] if k % 5 else []) for i in range(4) for k in range(9)]
        ranks, layer = masks.layered_masks(spark.createDataFrame(wide, "image_id int, det_id int, runs array<struct<low: bigint, high: bigint>>"))
        found, rank = layer.collect(), {(r.image_id, r.det_id): r["rank"] for r in ranks.collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    shown = [1, 2, 3, 4, 6, 7, 8]
    ends = [10 * k for k in shown] + [10**10 - 10 * k for k in reversed(shown)]
    for i in (0, 1, 2, None):
        own = sorted((r.low, r.high, r["rank"]) for r in found if r.image_id == i)
        assert [r[:2] for r in own] == list(zip(ends, ends[1:]))
        assert [r[2] for r in own] == [rank[i, k] for k in shown + shown[-2::-1]]


def test_places_move_rows_once(spark):
    """Ranges of a hot group go on with their numbers; rows are exchanged once, and only ranges are counted."""
    hot = spark.range(5000).select((F.col("id") % 7 == 0).alias("g"), F.when(F.col("id") % 2 == 0, 0.0).otherwise(-0.0).alias("z"), (-F.col("id")).alias("v"))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "64")
    try:
        found = ordering.placed(hot, ["g", "z"], ["v"])
        rows = found.collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    for g in (True, False):
        own = sorted((r.nth, r.v) for r in rows if r.g == g)
        assert [n for n, _ in own] == list(range(len(own))) and [v for _, v in own] == sorted(v for _, v in own)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Window") == 1 and "Join Inner" in plan and "rightHint=(strategy=broadcast)" in plan


@pytest.fixture(scope="module")
def outlines(spark, polygons):
    rows = [(i, d, None if p is None else [{"x": x, "y": y} for x, y in p]) for i, d, p in polygons[0]]
    return spark.createDataFrame(rows, "image_id int, det_id int, points array<struct<x:int,y:int>>")


@pytest.mark.parametrize("step", [2000, 7])
def test_layers_of_polygons(found, outlines, monkeypatch, step):
    """Polygons ranked and laid in tasks of whole images give the ranks and layers of their masks, also where an image takes many steps."""
    monkeypatch.setattr(masks, "FILLED", step)
    ranks, layer = masks.layered_masks(found)
    got = masks.layered_polygons(outlines, WIDTH, HEIGHT).collect()
    assert sorted(map(str, ((r.image_id, r.det_id, r.area, r["rank"]) for r in got))) == sorted(map(str, ((r.image_id, r.det_id, r.area, r["rank"]) for r in ranks.collect())))
    assert sorted(map(str, ((r.image_id, *run, r["rank"]) for r in got for run in r.runs))) == sorted(map(str, map(tuple, layer.collect())))
    assert all(a.high <= b.low for r in got for a, b in zip(r.runs, r.runs[1:]))
    assert masks.layered_polygons(outlines.limit(0), WIDTH, HEIGHT).count() == 0


def test_layers_of_boxes_move_boxes_once(spark, monkeypatch):
    """Boxes are exchanged by image; masks, ranks and layers are neither shuffled nor written."""
    from netloom.plans import operator_queries, shared

    monkeypatch.setattr(shared, "materialize", lambda *_: pytest.fail("written"))
    monkeypatch.setattr(masks, "placed", lambda *_, **__: pytest.fail("written"))
    plan = operator_queries.QUERIES["mask_layers"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange ") == 1 and "Join" not in plan


@pytest.mark.parametrize("filled, compared", [(2000, 2000), (7, 5)])
def test_overlaps_of_polygons(found, outlines, monkeypatch, filled, compared):
    """Pairs of polygons in tasks of whole images are those of their masks, whichever rows hold the sides."""
    monkeypatch.setattr(masks, "FILLED", filled)
    monkeypatch.setattr(masks, "COMPARED", compared)
    sides = ("det_id", "points"), ("gt_id", "true_points")
    kept = found.where("det_id % 5 <> 0")
    want = sorted(map(str, masks.mask_iou(found, kept.withColumnRenamed("det_id", "gt_id")).collect()))
    held = F.col("det_id") % 5 != 0
    beside = outlines.select("image_id", "det_id", "points", F.when(held, F.col("det_id")).alias("gt_id"), F.when(held, F.col("points")).alias("true_points"))
    apart = outlines.unionByName(outlines.where(held).select("image_id", F.col("det_id").alias("gt_id"), F.col("points").alias("true_points")), True)
    for rows in (beside, apart):
        assert sorted(map(str, masks.polygon_iou(rows, WIDTH, HEIGHT, *sides).collect())) == want
    one_sided = beside.where("gt_id is null")
    assert masks.polygon_iou(one_sided, WIDTH, HEIGHT, *sides).count() == 0


def test_overlaps_of_boxes_move_boxes_once(spark):
    from netloom.plans import operator_queries

    plan = operator_queries.QUERIES["mask_iou"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange ") == 1 and "Join" not in plan


@pytest.mark.parametrize("filled, compared", [(2000, 2000), (7, 5)])
def test_overlaps_in_a_row(found, outlines, monkeypatch, filled, compared):
    """Polygons beside each other are compared where they are; a row without one of them has no pair."""
    monkeypatch.setattr(masks, "FILLED", filled)
    monkeypatch.setattr(masks, "COMPARED", compared)
    other = outlines.where("det_id % 5 <> 0").select("image_id", F.col("det_id").alias("gt_id"), (F.col("det_id") + 1).alias("det_id"), F.col("points").alias("true_points"))
    beside = outlines.join(other, ["image_id", "det_id"], "left")
    got = masks.polygon_iou(beside, WIDTH, HEIGHT, ("det_id", "points"), ("gt_id", "true_points"), paired=True).drop("gt_id")
    want = masks.paired_mask_iou(found, found.where("det_id % 5 <> 0").withColumn("det_id", F.col("det_id") + 1), ["image_id", "det_id"])
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect())) and got.count() > 30


def test_overlaps_in_a_row_need_no_join(spark):
    from netloom.plans import operator_queries

    plan = operator_queries.QUERIES["mask_iou_paired"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange ") == 1 and "Join" not in plan
