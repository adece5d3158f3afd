"""Suppression, matching and quality of detections, one image at a time in plan but never in a task of its own."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from netloom.operators.curriculum import box_smooth
from netloom.operators.ordering import codes
from netloom.plans.shared import discard, materialize, partitions

#: Boxes of an image that enter suppression, and that leave it.
MOST_BOXES, MOST_KEPT = 30_000, 300
#: Rows of a range of running hits.
RANGE = 1 << 20


def _overlap(a, b) -> Column:
    width = F.greatest(F.lit(0), F.least(a["x2"], b["x2"]) - F.greatest(a["x1"], b["x1"]))
    height = F.greatest(F.lit(0), F.least(a["y2"], b["y2"]) - F.greatest(a["y1"], b["y1"]))
    return (width * height).cast("double")


def iou(a, b, eps: float = 1e-7) -> Column:
    """Intersection over union of two box structs or DataFrames with corner columns."""
    inter = _overlap(a, b)
    area = lambda x: (x["x2"] - x["x1"]) * (x["y2"] - x["y1"])
    return inter / (area(a) + area(b) - inter + F.lit(eps))


def iou_pairs(left: DataFrame, right: DataFrame, keys: list[str], least: float) -> DataFrame:
    """Pairs of boxes with equal keys whose IoU exceeds ``least``; an equi-join, never a cross join."""
    a, b = left.alias("a"), right.alias("b")
    on = [F.col(f"a.{k}") == F.col(f"b.{k}") for k in keys]
    boxes = [{c: F.col(f"{s}.{c}") for c in ("x1", "y1", "x2", "y2")} for s in "ab"]
    return a.join(b, on).withColumn("iou", iou(*boxes)).where(F.col("iou") > least)


def non_maximum_suppression(boxes: DataFrame, by_class: bool = True, confidence: float = 0.25, overlap: float = 0.45, most: int = MOST_BOXES, kept: int = MOST_KEPT) -> DataFrame:
    """Greedy suppression: per image (and class) the best box stays and drops those that overlap it.

    Filters and the cap of boxes come before the array is collected, so a group
    is bounded; suppression is one fold over it.  Ties go to the smaller id.
    The class offset of array implementations is the grouping key here.
    """
    keys = ["image_id", "cls"] if by_class else ["image_id"]
    best = Window.partitionBy("image_id").orderBy(F.desc("conf"), "det_id")
    able = boxes.where(F.col("conf") > confidence).withColumn("nth", F.row_number().over(best)).where(F.col("nth") <= most)
    row = F.struct((-F.col("conf")).alias("order"), "det_id", "cls", "conf", *[F.col(c).cast("double").alias(c) for c in ("x1", "y1", "x2", "y2")])
    sorted_rows = F.array_sort(F.collect_list(row))
    grouped = able.groupBy(*keys).agg(sorted_rows.alias("rows"))
    fold = F.aggregate("rows", F.slice("rows", 1, 0), lambda acc, x: F.when(F.exists(acc, lambda k: iou(k, x) > overlap), acc).otherwise(F.concat(acc, F.array(x))))
    out = grouped.select("image_id", F.explode(fold).alias("r")).select("image_id", "r.det_id", "r.cls", "r.conf")
    return out.withColumn("nth", F.row_number().over(best)).where(F.col("nth") <= kept).drop("nth")


def merged_boxes(boxes: DataFrame, survivors: DataFrame, overlap: float = 0.45) -> DataFrame:
    """Confidence-weighted mean of the boxes that each survivor stands for (merging suppression)."""
    chosen = survivors.select("image_id", "cls", "det_id").join(boxes.drop("cls", "conf"), ["image_id", "det_id"])
    pairs = iou_pairs(chosen, boxes, ["image_id", "cls"], overlap)
    total = F.sum("b.conf")
    means = [(F.sum(F.col(f"b.{c}") * F.col("b.conf")) / total).alias(c) for c in ("x1", "y1", "x2", "y2")]
    return pairs.groupBy(F.col("a.image_id").alias("image_id"), F.col("a.det_id").alias("det_id")).agg(*means)


def padded_suppression(boxes: DataFrame, per_class: int = 100, per_image: int = 100, by_class: bool = True, confidence: float = 0.25, overlap: float = 0.45) -> DataFrame:
    """Suppression with outputs of one length: ``per_image`` slots for each image, unused ones -1.

    With ``by_class``, each class keeps at most ``per_class`` survivors before
    the best of the image are taken; else classes suppress each other.  Images
    without any survivor have empty slots only.
    """
    survivors = non_maximum_suppression(boxes, by_class, confidence, overlap, kept=2**31 - 1)
    in_class = Window.partitionBy("image_id", "cls").orderBy(F.desc("conf"), "det_id")
    in_image = Window.partitionBy("image_id").orderBy(F.desc("conf"), "det_id")
    top = survivors.withColumn("nth", F.row_number().over(in_class)).where((F.col("nth") <= per_class) if by_class else F.lit(True))
    top = top.withColumn("slot", F.row_number().over(in_image)).where(F.col("slot") <= per_image).drop("nth")
    slots = boxes.select("image_id").distinct().select("image_id", F.explode(F.sequence(F.lit(1), F.lit(per_image))).alias("slot"))
    joined = slots.join(top, ["image_id", "slot"], "left")
    return joined.select("image_id", "slot", *[F.coalesce(c, F.lit(-1)).alias(c) for c in ("det_id", "cls")], F.coalesce("conf", F.lit(-1.0)).alias("conf"))


def match_labels(detections: DataFrame, labels: DataFrame, least: float = 0.45, confidence: float = 0.25) -> DataFrame:
    """One-to-one matches in two passes: the best label of each detection, then the best detection of each label."""
    pairs = iou_pairs(labels, detections.where(F.col("conf") > confidence), ["image_id"], least)
    pairs = pairs.select(F.col("a.image_id").alias("image_id"), F.col("a.gt_id").alias("gt_id"), F.col("b.det_id").alias("det_id"), F.col("a.cls").alias("gt_cls"), F.col("b.cls").alias("det_cls"), "iou")
    by_detection = Window.partitionBy("image_id", "det_id").orderBy(F.desc("iou"), F.desc("gt_id"))
    by_label = Window.partitionBy("image_id", "gt_id").orderBy(F.desc("iou"), F.desc("det_id"))
    one = pairs.withColumn("k", F.row_number().over(by_detection)).where("k = 1")
    return one.withColumn("k", F.row_number().over(by_label)).where("k = 1").drop("k")


def confusion_matrix(detections: DataFrame, labels: DataFrame, classes: int, least: float = 0.45, confidence: float = 0.25) -> DataFrame:
    """Counts by predicted and true class; class number ``classes`` is background.

    Missed labels count under the background row.  Spurious detections count
    under the background column only in images that have a match.  Matches are
    read four times, so they are written once.
    """
    matches = materialize(match_labels(detections, labels, least, confidence).select("image_id", "gt_id", "det_id", "gt_cls", "det_cls"), "matches")
    hit = matches.select(F.col("det_cls").alias("pred"), F.col("gt_cls").alias("true"))
    missed = labels.join(matches.select("image_id", "gt_id"), ["image_id", "gt_id"], "left_anti").select(F.lit(classes).alias("pred"), F.col("cls").alias("true"))
    able = detections.where(F.col("conf") > confidence).join(matches.select("image_id").distinct(), "image_id", "left_semi")
    spurious = able.join(matches.select("image_id", "det_id"), ["image_id", "det_id"], "left_anti").select(F.col("cls").alias("pred"), F.lit(classes).alias("true"))
    return hit.unionAll(missed).unionAll(spurious).groupBy("pred", "true").agg(F.count("*").alias("n"))


def normalized_matrix(matrix: DataFrame) -> DataFrame:
    """Column-normalised confusion matrix; shares under 0.005 are null."""
    share = F.col("n") / (F.sum("n").over(Window.partitionBy("true")) + 1e-9)
    return matrix.withColumn("share", F.when(share >= 0.005, share)).drop("n")


#: IoU levels at which a hit counts.
LEVELS = tuple(round(0.5 + 0.05 * j, 2) for j in range(10))


def mark_hits(detections: DataFrame, labels: DataFrame) -> DataFrame:
    """``detections`` with the ``iou`` of their one-to-one match of the same class; 0 without one.

    The best label of a detection and the best detection of a label do not
    depend on the level, so one matching at the lowest level serves all: a
    detection is a hit at each level that its IoU reaches.  Ids are unique in their image.
    One exchange serves both choices, as the two of a pair have one class; it lets adaptive
    execution split the join before it.
    """
    a, b = labels.select("image_id", "cls", F.col("gt_id").alias("gt_"), "x1", "y1", "x2", "y2").alias("a"), detections.alias("b")
    value = iou(*[{c: F.col(f"{s}.{c}") for c in ("x1", "y1", "x2", "y2")} for s in "ab"])
    # Only rows that lack a label come unmatched, so no second join brings them back.
    pairs = b.join(a, (F.col("a.image_id") == F.col("b.image_id")) & (F.col("a.cls") == F.col("b.cls")) & (value >= LEVELS[0]), "left")
    pairs = pairs.select("b.*", "gt_", value.alias("iou")).repartition(partitions(detections), "image_id", "cls")
    by_detection = Window.partitionBy("image_id", "cls", "det_id").orderBy(F.desc("iou"), F.desc("gt_"))
    by_label = Window.partitionBy("image_id", "cls", "gt_").orderBy(F.desc("iou"), F.desc("det_id"))
    one = pairs.withColumn("nth", F.row_number().over(by_detection)).where("nth = 1").withColumn("nth", F.row_number().over(by_label))
    return one.withColumn("iou", F.when((F.col("nth") == 1) & F.col("gt_").isNotNull(), F.col("iou")).otherwise(0.0)).drop("nth", "gt_")


def _counted(levels: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Add each row's number and the hits so far at each level, in its class and task; rows are sorted, the class is first, the levels reached are last."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, seen, last = np.zeros(levels + 1, np.int64), 0, None
        for batch in batches:
            if not batch.num_rows:
                continue
            n, cls = batch.num_rows, batch.column(0)
            fresh = np.diff(codes(cls if last is None else pa.concat_arrays([last, cls])), prepend=0)[-n:] != 0
            reached = batch.column(batch.num_columns - 1).to_numpy()
            ones = np.concatenate([np.ones((n, 1), np.int64), reached[:, None] > np.arange(levels)], 1)
            sums = np.cumsum(ones, 0) + held
            # What rows of classes before have added.
            starts = np.flatnonzero(fresh)
            gone = np.concatenate([np.zeros((1, levels + 1), np.int64), (sums - ones)[starts]])
            sums -= gone[np.cumsum(fresh)]
            held, last = sums[-1], cls.slice(n - 1)
            yield pa.RecordBatch.from_arrays([*batch.columns, *(pa.array(sums[:, j].astype(np.int32)) for j in range(levels + 1))], [*batch.schema.names, "row", *(f"hit{j}" for j in range(levels))])

    return count


def running_hits(marked: DataFrame, labels: DataFrame, levels: tuple[float, ...] = LEVELS) -> DataFrame:
    """Rank ``k`` and hits so far at each rising level, by class in order of falling confidence; ties by image and detection.

    Rows are cut into ranges of class, confidence and number, as many as their number asks for, counted
    in each range and written once, so neither a large class nor many equal confidences are one task's work.
    What the ranges of a class before add comes by range, whose number ``part`` stays; ``reached`` is the number of levels that a row is a hit at.
    ``labels`` of the class come with each row; classes without labels drop out.
    """
    names = [f"hit{j}" for j in range(len(levels))]
    by = [F.desc("conf"), F.col("image_id"), F.col("det_id")]
    counts = labels.groupBy("cls").agg(F.count("*").alias("labels"))
    reached = sum(((F.col("iou") >= t).cast("int") for t in levels), F.lit(0)).alias("reached")
    rows = materialize(marked.select("cls", "image_id", "det_id", "conf", reached).join(F.broadcast(counts.select("cls")), "cls"), "marked")
    parts = max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-rows.count() // RANGE))
    cut = rows.repartitionByRange(parts, F.col("cls"), *by).sortWithinPartitions("cls", *by)
    cut = cut.select("cls", "image_id", "det_id", "conf", F.spark_partition_id().alias("part"), "reached")
    counted = StructType([*cut.schema.fields, *(StructField(c, IntegerType()) for c in ("row", *names))])
    ranged = materialize(cut.mapInArrow(_counted(len(levels)), counted), "running")
    discard(rows)
    # One row for each range and each further class in it.
    above = Window.partitionBy("cls").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    sums = ranged.groupBy("cls", "part").agg(*[F.max(c).alias(c) for c in ("row", *names)]).join(F.broadcast(counts), "cls")
    sums = sums.select("cls", "part", "labels", *[F.coalesce(F.sum(c).over(above), F.lit(0)).alias(f"before_{c}") for c in ("row", *names)])
    joined = ranged.join(F.broadcast(materialize(sums, "range-sums")), ["cls", "part"])
    total = F.array(*[F.col(f"before_{h}") + F.col(h) for h in names])
    found = joined.select("cls", "image_id", "det_id", "conf", "labels", "part", (F.col("before_row") + F.col("row")).alias("k"), total.alias("hits"), "reached")
    found.netloom_parts = parts
    return found


def _enveloped(running: DataFrame, level: int) -> DataFrame:
    """``running`` with the ``envelope`` at one level; first over ranges, then inside each."""
    parts = getattr(running, "netloom_parts", partitions(running))
    rows = running.select("cls", "image_id", "det_id", "labels", "k", "part", (F.col("hits")[level] / F.col("k")).alias("precision"), (F.col("reached") > level).alias("is_hit"))
    later = Window.partitionBy("cls").orderBy(F.desc("part")).rowsBetween(Window.unboundedPreceding, -1)
    best = rows.groupBy("cls", "part").agg(F.max("precision").alias("best")).withColumn("after", F.coalesce(F.max("best").over(later), F.lit(0.0)))
    inside = Window.partitionBy("cls", "part").orderBy(F.desc("k")).rowsBetween(Window.unboundedPreceding, 0)
    joined = rows.repartition(parts, "cls", "part").join(F.broadcast(best.drop("best")), ["cls", "part"])
    return joined.withColumn("envelope", F.greatest("after", F.max("precision").over(inside)))


def precision_envelope(running: DataFrame, level: int = 0) -> DataFrame:
    """The largest precision at each row's rank or a later one, by class, at one level."""
    return _enveloped(running, level).select("cls", "image_id", "det_id", "envelope")


def average_precision(running: DataFrame, levels: int = len(LEVELS), points: int = 101) -> DataFrame:
    """``cls, level, ap``: area under the precision envelope on an even recall grid, by the trapezoid rule.

    Between grid points the curve matters only through the first and the last
    row of each cell of recall and the cell's largest precision, so rows are
    reduced to these by one aggregation of plain numbers, which is hashed and so needs
    no sort (ranks and hits rise together); all else runs on at most ``points``
    rows for each class and level.  The curve starts in (0, 1) and ends in
    (1, 0); rows of equal recall count by the last to their right.
    """
    last = points - 1
    rows = running.select("cls", "k", "labels", F.posexplode("hits").alias("level", "hit")).where(F.col("level") < levels)
    recall = F.col("hit") / (F.col("labels") + 1e-16)
    numbers = [f(c).alias(f"{n}_{c}") for n, f in (("first", F.min), ("last", F.max)) for c in ("hit", "k", "labels")]
    cells = rows.withColumn("cell", F.ceil(recall * last - 1e-9)).groupBy("cls", "level", "cell").agg(*numbers, F.max(F.col("hit") / F.col("k")).alias("best"))
    knot = lambda n: F.struct((F.col(f"{n}_hit") / (F.col(f"{n}_labels") + 1e-16)).alias("r"), (F.col(f"{n}_hit") / F.col(f"{n}_k")).alias("p")).alias(n)
    cells = materialize(cells.select("cls", "level", "cell", knot("first"), knot("last"), "best"), "recall-cells")
    # From the reduced rows: a class has a cell at every level.
    grid = cells.select("cls", "level").distinct().withColumn("cell", F.explode(F.sequence(F.lit(0), F.lit(last)).cast("array<bigint>")))
    on = ["cls", "level", "cell"]
    by = Window.partitionBy("cls", "level").orderBy("cell")
    to_here, behind = by.rowsBetween(Window.unboundedPreceding, 0), by.rowsBetween(1, Window.unboundedFollowing)
    start, end = (F.struct(F.lit(r).alias("r"), F.lit(p).alias("p")) for r, p in ((0.0, 1.0), (1.0, 0.0)))
    spans = grid.join(cells, on, "left").select(
        *on, F.coalesce(F.last("last", True).over(to_here), start).alias("a"), F.coalesce(F.first("first", True).over(behind), end).alias("b"), F.coalesce(F.max("best").over(behind), F.lit(0.0)).alias("right")
    )
    left, x = F.greatest(F.col("a.p"), F.col("right")), F.col("cell") / last
    value = F.when(F.col("cell") == last, 0.0).otherwise(left + (F.col("right") - left) * (x - F.col("a.r")) / (F.col("b.r") - F.col("a.r")))
    return spans.groupBy("cls", "level").agg((F.sum(value * F.when(F.col("cell") == 0, 0.5).otherwise(1.0)) / last).alias("ap"))


def continuous_precision(running: DataFrame, level: int = 0) -> DataFrame:
    """``cls, ap``: exact area under the envelope at one level, the sum over each step of recall."""
    # The envelope falls, so it is largest for a count of hits in the row of the last of them.
    steps = _enveloped(running, level).groupBy("cls").agg(F.sum(F.when(F.col("is_hit"), F.col("envelope"))).alias("area"), F.max("labels").alias("labels")).where("area is not null")
    return steps.select("cls", (F.col("area") / (F.col("labels") + 1e-16)).alias("ap"))


def confidence_curves(running: DataFrame, points: int = 1000) -> DataFrame:
    """``cls, g, p, r``: precision and recall at the lowest level on an even grid of confidences g / (points - 1).

    Interpolated between the last row at or above the confidence and the first
    below; before the first row recall is 0 and precision 1, after the last row
    both stay.  Rows are reduced to the first and last of each cell first.
    """
    last = points - 1
    cell = F.floor(F.col("conf") * last + 1e-9)
    # Ranks and hits rise while confidence falls.
    ends = (("first", F.min, F.max), ("last", F.max, F.min))
    numbers = [f(c).alias(f"{n}_{c}") for n, rising, falling in ends for f, c in ((falling, "conf"), (rising, "hit"), (rising, "k"), (rising, "labels"))]
    cells = running.withColumn("g", cell).withColumn("hit", F.col("hits")[0]).groupBy("cls", "g").agg(*numbers)
    knot = lambda n: F.struct(F.col(f"{n}_conf").alias("conf"), (F.col(f"{n}_hit") / (F.col(f"{n}_labels") + 1e-16)).alias("r"), (F.col(f"{n}_hit") / F.col(f"{n}_k")).alias("p")).alias(n)
    cells = cells.select("cls", "g", knot("first"), knot("last"))
    grid = cells.select("cls").distinct().withColumn("g", F.explode(F.sequence(F.lit(0), F.lit(last)).cast("array<bigint>")))
    falling = Window.partitionBy("cls").orderBy(F.desc("g"))
    start = F.struct(F.lit(2.0).alias("conf"), F.lit(0.0).alias("r"), F.lit(1.0).alias("p"))
    spans = grid.join(cells, ["cls", "g"], "left").select(
        "cls", "g", F.coalesce(F.last("last", True).over(falling.rowsBetween(Window.unboundedPreceding, 0)), start).alias("a"), F.first("first", True).over(falling.rowsBetween(1, Window.unboundedFollowing)).alias("b")
    )
    share = (F.col("a.conf") - F.col("g") / last) / (F.col("a.conf") - F.col("b.conf"))
    at = {c: F.when(F.col("b").isNull() | (F.col("a.conf") > 1), F.col(f"a.{c}")).otherwise(F.col(f"a.{c}") + (F.col(f"b.{c}") - F.col(f"a.{c}")) * F.greatest(share, F.lit(0.0))) for c in "pr"}
    return spans.select("cls", "g", at["p"].alias("p"), at["r"].alias("r"))


def smoothing_half(points: int, fraction: float) -> int:
    """Values on either side that a box filter over this fraction of a series takes; the filter's length is odd."""
    return round(points * fraction * 2) // 2 // 2


def best_f1(curves: DataFrame, points: int = 1000, fraction: float = 0.1, eps: float = 1e-16) -> DataFrame:
    """``cls, g, p, r, f1`` at the grid point where the smoothed mean F1 of all classes is largest, ties to the first."""
    f1 = curves.withColumn("f1", 2 * F.col("p") * F.col("r") / (F.col("p") + F.col("r") + eps))
    half = smoothing_half(points, fraction)
    mean = f1.groupBy("g").agg(F.avg("f1").alias("f1")).withColumn("all", F.lit(0))
    smooth = box_smooth(mean, half, "all", "g", "f1")
    # Rounded, so that the order of a sum does not choose between equal points.
    best = smooth.orderBy(F.desc(F.round("smooth", 12)), "g").limit(1).select("g")
    return f1.join(F.broadcast(best), "g")


def class_quality(running: DataFrame, labels: DataFrame) -> DataFrame:
    """``cls, labels, tp, fp, p, r, f1, ap50, ap`` of each class with labels and detections.

    Both curves read the written ranges of running hits; each curve
    is small behind its aggregation and written too, as the plans that follow read it again.
    """
    at = best_f1(materialize(confidence_curves(running), "curves"))
    ap = average_precision(running).groupBy("cls").agg(F.max(F.when(F.col("level") == 0, F.col("ap"))).alias("ap50"), F.avg("ap").alias("ap"))
    counts = labels.groupBy("cls").agg(F.count("*").alias("labels"))
    tp = F.bround(F.col("r") * F.col("labels"))
    joined = at.join(ap, "cls").join(counts, "cls").withColumn("tp", tp)
    return joined.select("cls", "labels", "tp", F.bround(F.col("tp") / (F.col("p") + 1e-16) - F.col("tp")).alias("fp"), "p", "r", "f1", "ap50", "ap")


def mean_quality(quality: DataFrame) -> DataFrame:
    """``mp, mr, map50, map, fitness`` over the classes; 0 without any."""
    zero = lambda c: F.coalesce(F.avg(c), F.lit(0.0))
    means = quality.agg(zero("p").alias("mp"), zero("r").alias("mr"), zero("ap50").alias("map50"), zero("ap").alias("map"))
    return means.withColumn("fitness", 0.1 * F.col("map50") + 0.9 * F.col("map"))


def class_maps(quality: DataFrame, classes: int) -> DataFrame:
    """``cls, map`` for each of ``classes`` numbers: the class's AP, or the mean of all where it has none."""
    spark = quality.sparkSession
    mean = quality.agg(F.coalesce(F.avg("ap"), F.lit(0.0)).alias("all"))
    numbers = spark.range(classes).select(F.col("id").cast("int").alias("cls")).crossJoin(F.broadcast(mean))
    return numbers.join(quality.select("cls", "ap"), "cls", "left").select("cls", F.coalesce("ap", "all").alias("map"))


def box_and_mask(boxes: DataFrame, masks: DataFrame, classes: int) -> tuple[DataFrame, DataFrame]:
    """Means of both qualities side by side with the fitness of all eight, and the sum of both maps by class."""
    means = mean_quality(boxes).crossJoin(F.broadcast(mean_quality(masks).select(*[F.col(c).alias(f"mask_{c}") for c in ("mp", "mr", "map50", "map", "fitness")])))
    means = means.withColumn("fitness", F.col("fitness") + F.col("mask_fitness")).drop("mask_fitness")
    sums = class_maps(boxes, classes).join(class_maps(masks, classes).withColumnRenamed("map", "mask"), "cls")
    return means, sums.select("cls", (F.col("map") + F.col("mask")).alias("map"))
