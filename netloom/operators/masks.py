"""Object masks as runs of pixels: filled polygons, areas, overlaps, one layer of all masks of an image.

A mask is one array of ``struct<low bigint, high bigint>`` for each object: the
half-open ranges of pixel numbers ``y * width + x`` that it covers, in order
and apart.  It grows with an object's outline, not with its area, and stays in
one row, so filling and comparing masks shuffle nothing by themselves.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, LongType, StructField, StructType

from netloom.operators.ordering import placed, whole_groups
from netloom.plans.shared import quoted

#: Pieces of a layer that one row holds on its way, and rows of a layer that leave a task together.
PIECES = 1 << 16
#: Polygons filled together, and pairs compared together.
FILLED, COMPARED = 2000, 2000
RUNS = ArrayType(StructType([StructField("low", LongType()), StructField("high", LongType())]))


def _fill(owner: np.ndarray, x: np.ndarray, y: np.ndarray, width: int, height: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs of many polygons as owner, low and high, in order; corners come polygon by polygon."""
    if not len(owner):
        return owner, owner, owner
    first = np.flatnonzero(np.diff(owner, prepend=-1))
    following = np.arange(1, len(owner) + 1)
    following[np.append(first[1:], len(owner)) - 1] = first
    # Each edge from its upper end, or its left one where it is level.
    turned = (y > y[following]) | ((y == y[following]) & (x > x[following]))
    a, b = np.where(turned, following, np.arange(len(owner))), np.where(turned, np.arange(len(owner)), following)
    top, bottom = np.maximum(y[a], 0), np.minimum(y[b], height - 1)
    tall = np.maximum(bottom - top + 1, 0)
    # Level edges, steep ones, and those that are wider than high.
    dx, dy = x[b] - x[a], y[b] - y[a]
    edge = np.repeat(np.arange(len(owner)), tall)
    row = top[edge] + np.arange(len(edge)) - np.repeat(np.cumsum(tall) - tall, tall)
    shape = np.where(dy == 0, 0, np.where(np.abs(dx) <= dy, 1, 2))[edge]
    low, high = np.empty(len(edge), np.int64), np.empty(len(edge), np.int64)
    # Crossings of a row's middle line: every other range between two of them is inside, ends included.
    cut = np.flatnonzero(row < y[b][edge])
    e, r = edge[cut], row[cut]
    at, line = x[a][e] + (r - y[a][e]) * dx[e] / dy[e], owner[e] * height + r
    order = np.argsort(line, kind="stable")
    at, line = at[order], line[order]
    more = np.flatnonzero(line[2::2] == line[:-2:2])
    if len(more):
        # Lines of four crossings and more; the two of all others need no sort.
        mixed = np.zeros(len(line) // 2, bool)
        mixed[more] = mixed[more + 1] = True
        several = np.flatnonzero(np.repeat(mixed, 2))
        at[several] = at[several][np.lexsort((at[several], line[several]))]
    inner_of, inner_row = np.divmod(line[::2], height)
    inner_low, inner_high = np.ceil(np.minimum(at[::2], at[1::2])).astype(np.int64), np.floor(np.maximum(at[::2], at[1::2])).astype(np.int64) + 1
    # Pixels on edges: along the longer side the nearest one, halves towards larger numbers.
    on = np.flatnonzero(shape == 0)
    e = edge[on]
    low[on], high[on] = x[a][e], x[b][e] + 1
    on = np.flatnonzero(shape == 1)
    e = edge[on]
    d = dy[e]
    low[on] = np.floor_divide(2 * x[a][e] * d + 2 * (row[on] - y[a][e]) * dx[e] + d, 2 * d)
    high[on] = low[on] + 1
    on = np.flatnonzero(shape == 2)
    e = edge[on]
    d, wide, right = 2 * dy[e], dx[e], dx[e] > 0
    middle = x[a][e] * d + 2 * (row[on] - y[a][e]) * wide
    # The lines half a row up and down, in the order of their crossings.
    left_end, right_end = middle - np.abs(wide), middle + np.abs(wide)
    low[on] = np.maximum(np.where(right, x[a][e], x[b][e]), np.where(right, -(-left_end // d), left_end // d + 1))
    high[on] = np.minimum(np.where(right, x[b][e], x[a][e]) + 1, np.where(right, -(-right_end // d), right_end // d + 1))
    of = owner[edge]
    of, row = np.concatenate((inner_of, of)), np.concatenate((inner_row, row))
    low, high = np.clip(np.concatenate((inner_low, low)), 0, width), np.clip(np.concatenate((inner_high, high)), 0, width)
    kept = low < high
    of, low, high = of[kept], (row * width + low)[kept], (row * width + high)[kept]
    # Ranges that overlap or touch become one run; polygons lie apart in one line of numbers.
    apart = of * (width * height + 1)
    order = np.argsort(low + apart, kind="stable")
    of, low, high, apart = of[order], low[order], high[order], apart[order]
    if not len(of):
        return of, of, of
    reach = np.maximum.accumulate(high + apart)
    fresh = np.flatnonzero(np.concatenate(([True], (low + apart)[1:] > reach[:-1])))
    last = np.append(fresh[1:], len(of)) - 1
    return of[fresh], low[fresh], reach[last] - apart[last]


def _part(name: str) -> Callable[[Column], Column]:
    return lambda point: point[name].cast("long")


def _sides(points: str) -> tuple[Column, Column]:
    """Both sides of the corners of a polygon as plain arrays; a corner with a null counts for nothing."""
    whole = F.filter(points, lambda p: p["x"].isNotNull() & p["y"].isNotNull())
    return F.transform(whole, _part("x")).alias("x"), F.transform(whole, _part("y")).alias("y")


def _filled(xs: pa.ListArray, ys: pa.ListArray, width: int, height: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs of the polygons of both lists of corners as row, low and high."""
    xs, ys = xs.fill_null([]), ys.fill_null([])
    owner = np.repeat(np.arange(len(xs)), np.diff(xs.offsets.to_numpy()))
    return _fill(owner, xs.flatten().to_numpy(), ys.flatten().to_numpy(), width, height)


def _by_image(rows: DataFrame, *columns: Column) -> DataFrame:
    """``columns`` of ``rows``, image first, in tasks that have all rows of an image beside each other."""
    # The window asks for rows by image, and for an exchange or a sort only where they are not.
    return rows.select(F.col("image_id"), *columns, F.count("*").over(Window.partitionBy("image_id")).alias("size"))


def _packed_runs(sizes: np.ndarray, low: np.ndarray, high: np.ndarray) -> pa.Array:
    """One value of bytes for each mask of as many runs as ``sizes`` tells."""
    offsets = np.concatenate(([0], np.cumsum(16 * sizes)))
    if offsets[-1] >= 1 << 31:
        raise OverflowError(f"{len(sizes)} masks of {len(low)} runs do not fit one batch")
    return pa.Array.from_buffers(pa.binary(), len(sizes), [None, pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(np.stack((low, high), 1).astype("<i8").tobytes())])


def _unpacked_runs(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs of each mask, their lows and their highs, from bytes; null has none."""
    column = column.fill_null(b"")
    offsets = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    runs = np.frombuffer(data, "<i8", (offsets[-1] - offsets[0]) // 8, offsets[0]).reshape(-1, 2) if len(column) and data else np.zeros((0, 2), np.int64)
    return np.diff(offsets) // 16, runs[:, 0], runs[:, 1]


def polygon_masks(polygons: DataFrame, width: int, height: int, points: str = "points", packed: bool = False) -> DataFrame:
    """Replace each polygon ``array<struct<x, y>>`` of whole-numbered corners by ``runs``, in images of ``width`` by ``height``.

    Filled is what lies between every other pair of edges on a pixel row,
    and the outline itself.  A polygon of one or two corners is its outline; what lies
    outside of the image goes; null and no corners give no runs, a corner
    with a null counts for nothing.  All polygons of a batch are filled
    together by array operations; nested array functions took 30 times as long.
    ``packed`` runs are bytes, low and high of each run as 64-bit numbers in little-endian
    order, which :func:`mask_iou` and :func:`paired_mask_iou` read too.
    """
    kept = [c for c in polygons.columns if c not in (points, "runs")]
    rows = polygons.select(*[F.col(quoted(c)).alias(f"c{i}") for i, c in enumerate(kept)], *_sides(points))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for start in range(0, whole.num_rows, FILLED):
                batch = whole.slice(start, FILLED)
                of, low, high = _filled(*batch.columns[len(kept) :], width, height)
                offsets = np.searchsorted(of, np.arange(batch.num_rows + 1)).astype(np.int32)
                if packed:
                    runs = _packed_runs(np.diff(offsets).astype(np.int64), low, high)
                else:
                    runs = pa.ListArray.from_arrays(pa.array(offsets), pa.StructArray.from_arrays([pa.array(low, pa.int64()), pa.array(high, pa.int64())], ["low", "high"]))
                yield pa.RecordBatch.from_arrays([*batch.columns[: len(kept)], runs], names)

    names = [*(f"c{i}" for i in range(len(kept))), "runs"]
    schema = StructType([*(StructField(f"c{i}", polygons.schema[c].dataType) for i, c in enumerate(kept)), StructField("runs", BinaryType() if packed else RUNS)])
    return rows.mapInArrow(run, schema).toDF(*kept, "runs")


def mask_area(runs: Column) -> Column:
    """Pixels of a mask."""
    return F.aggregate(runs, F.lit(0).cast("long"), lambda total, r: total + r["high"] - r["low"])


def _shared(a: tuple[np.ndarray, ...], b: tuple[np.ndarray, ...]) -> np.ndarray:
    """Pixels that the masks of each pair share; a side is the runs of each mask, their lows and their highs.

    Pairs lie apart in one line of numbers.  Of a run of ``b``, those pixels are shared that ``a`` covers
    below its end but not below its beginning.
    """
    (sizes, low, high), (other, from_, until) = a, b
    found = np.zeros(len(sizes) + 1, np.int64)
    if not len(low) or not len(from_):
        return found[1:]
    apart = int(max(high.max(), until.max())) + 1
    own, theirs = (np.repeat(np.arange(len(n)) * apart, n) for n in (sizes, other))
    first, length = low + own, high - low
    below = np.concatenate(([0], np.cumsum(length)))

    def covered(places: np.ndarray) -> np.ndarray:
        run = np.searchsorted(first, places, "right") - 1
        return np.where(run < 0, 0, below[run] + np.minimum(places - first[run], length[run]))

    both = np.concatenate(([0], np.cumsum(covered(until + theirs) - covered(from_ + theirs))))
    return np.diff(both[np.concatenate(([0], np.cumsum(other)))])


def _compared(kept: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``kept`` columns as they are, then shared pixels and union of two sides of packed runs; null without a mask."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for start in range(0, whole.num_rows, COMPARED):
                batch = whole.slice(start, COMPARED)
                a, b = (_unpacked_runs(batch.column(i)) for i in (kept, kept + 1))
                areas = sum(np.diff(np.concatenate(([0], np.cumsum(high - low)))[np.concatenate(([0], np.cumsum(n)))]) for n, low, high in (a, b))
                shared = _shared(a, b)
                missing = np.logical_or(*(np.asarray(batch.column(i).is_null()) for i in (kept, kept + 1)))
                yield pa.RecordBatch.from_arrays([*batch.columns[:kept], pa.array(shared, mask=missing), pa.array(areas - shared, mask=missing)], [*batch.schema.names[:kept], "shared", "union"])

    return run


def _with_iou(pairs: DataFrame, kept: dict[str, str], eps: float) -> DataFrame:
    """Shared pixels and IoU of the packed runs ``a`` and ``b``; pairs of a batch are compared together by array operations."""
    sent = pairs.select(*[F.col(quoted(c)).alias(f"c{i}") for i, c in enumerate(kept)], "a", "b")
    schema = StructType([*sent.schema.fields[: len(kept)], StructField("shared", LongType()), StructField("union", LongType())])
    found = sent.mapInArrow(_compared(len(kept)), schema)
    return found.select(*[F.col(f"c{i}").alias(name) for i, name in enumerate(kept.values())], "shared", (F.col("shared") / (F.col("union") + F.lit(eps))).alias("iou"))


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for start in range(0, whole.num_rows, FILLED):
            batch = whole.slice(start, FILLED)
            runs = batch.column(batch.num_columns - 1)
            sizes, flat = np.diff(runs.fill_null([]).offsets.to_numpy()).astype(np.int64), runs.flatten()
            packed = _packed_runs(sizes, flat.field("low").to_numpy(), flat.field("high").to_numpy())
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pc.if_else(runs.is_null(), None, packed)], batch.schema.names)


def _sided(masks: DataFrame, keys: list[str], name: str) -> DataFrame:
    """``keys`` and the packed runs as ``name``: bytes are copied through a join as they are, arrays element by element."""
    rows = masks.select(*keys, F.col("runs").alias(name))
    if isinstance(rows.schema[name].dataType, BinaryType):
        return rows
    return rows.mapInArrow(_pack, StructType([*rows.schema.fields[:-1], StructField(name, BinaryType())]))


def mask_iou(one: DataFrame, other: DataFrame, id_col: str = "det_id", other_id: str = "gt_id", eps: float = 1e-7) -> DataFrame:
    """Shared pixels and IoU of every mask of ``one`` with every mask of ``other`` in the same image.

    Both hold ``image_id``, an id and ``runs``.  The pairs of an image are the
    result itself; they come by an equi-join on the image that adaptive execution can
    split where one image holds many masks.  Without pixels on either side the IoU is 0.
    """
    a, b = _sided(one, ["image_id", id_col], "a").withColumnRenamed(id_col, "a_id"), _sided(other, ["image_id", other_id], "b").withColumnRenamed(other_id, "b_id")
    return _with_iou(a.join(b, "image_id"), {"image_id": "image_id", "a_id": id_col, "b_id": other_id}, eps)


def paired_mask_iou(one: DataFrame, other: DataFrame, keys: list[str], eps: float = 1e-7) -> DataFrame:
    """IoU of the masks of ``one`` and ``other`` with equal ``keys``, pair by pair."""
    a, b = (_sided(t, keys, n) for t, n in ((one, "a"), (other, "b")))
    return _with_iou(a.join(b, keys), {k: k for k in keys}, eps)


def _topmost(of: np.ndarray, low: np.ndarray, high: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Maximal runs of pixels with the same largest rank, from ranges of any overlap, as owner, low, high and rank.

    Each range is two overlapping blocks of a power of two of the places between ends;
    ranks go down from longer blocks to their halves, so ranges are never expanded.
    """
    if not len(of):
        return of, low, high, rank
    apart = int(high.max()) + 1
    ends, at = np.unique(np.concatenate((of * apart + low, of * apart + high)), return_inverse=True)
    first, last = at[: len(of)], at[len(of) :]
    level = np.frexp(last - first)[1] - 1
    top = np.zeros(len(ends), np.int64)
    for k in range(int(level.max()), -1, -1):
        mine, size = level == k, 1 << k
        np.maximum.at(top, first[mine], rank[mine])
        np.maximum.at(top, last[mine] - size, rank[mine])
        if k:
            longer, half = top, size >> 1
            top = longer.copy()
            top[half:] = np.maximum(top[half:], longer[:-half])
    fresh = np.flatnonzero(np.concatenate(([True], top[1:] != top[:-1])))
    until = ends[np.append(fresh[1:], len(ends) - 1)]
    kept = top[fresh] > 0
    owner = ends[fresh] // apart
    return owner[kept], (ends[fresh] - owner * apart)[kept], (until - owner * apart)[kept], top[fresh][kept]


class _Runs:
    """Runs of many masks, mask by mask."""

    def __init__(self, xs: pa.ListArray, ys: pa.ListArray, width: int, height: int, step: int) -> None:
        parts = [(of + start, low, high) for start in range(0, len(xs), step) for of, low, high in [_filled(xs.slice(start, step), ys.slice(start, step), width, height)]]
        of, self.low, self.high = (np.concatenate(p) for p in zip(*parts))
        self.size = np.bincount(of, minlength=len(xs))
        self.start = np.cumsum(self.size) - self.size
        self.area = np.diff(np.concatenate(([0], np.cumsum(self.high - self.low)))[np.append(self.start, len(of))])

    def taken(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Number of runs of the masks ``at`` these places, their lows and their highs."""
        size = self.size[at]
        run = np.repeat(self.start[at] - (np.cumsum(size) - size), size) + np.arange(size.sum())
        return size, self.low[run], self.high[run]


def polygon_iou(rows: DataFrame, width: int, height: int, one: tuple[str, str], other: tuple[str, str], paired: bool = False, eps: float = 1e-7) -> DataFrame:
    """:func:`mask_iou` of the filled polygons of ``rows`` that have ``image_id`` and, as id and points, a polygon of either side or of both.

    A side whose id is null has no polygon in that row.  ``paired`` compares the two polygons of one row only.  A task
    that has all rows of an image fills each polygon once and compares the pairs a few thousand at a time, so neither runs nor
    pairs are shuffled: polygons move only where they are not dealt by image yet.
    """
    sides = (one, other)
    sent = [c for i, (ident, points) in enumerate(sides) for c in (F.col(ident).alias(f"id{i}"), *(c.alias(f"{n}{i}") for n, c in zip("xy", _sides(points))))]
    known = rows.where(F.col("image_id").isNotNull())
    dealt = known.where(F.col(one[0]).isNotNull() & F.col(other[0]).isNotNull()).select("image_id", *sent) if paired else _by_image(known, *sent)
    filled, compared = FILLED, COMPARED

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = ((b.slice(s, filled), None) for b in batches for s in range(0, b.num_rows, filled)) if paired else whole_groups(batches, filled)
        for batch, image in parts:
            there = [np.flatnonzero(np.asarray(batch.column(1 + 3 * i).is_valid())) for i in (0, 1)]
            ids, masks = [], []
            for i, at in enumerate(there):
                own = pa.RecordBatch.from_arrays(batch.columns[1 + 3 * i : 4 + 3 * i], ["id", "x", "y"]).take(pa.array(at))
                ids.append(own.column(0))
                masks.append(_Runs(own.column(1), own.column(2), width, height, filled) if len(at) else None)
            if None in masks:
                continue
            if paired:
                first, many = np.arange(len(there[1])), np.ones(len(there[0]), np.int64)
            else:
                # The others of an image lie beside each other, behind those of the images before.
                count = np.bincount(image[there[1]], minlength=image[-1] + 1)
                first, many = (np.cumsum(count) - count)[image[there[0]]], count[image[there[0]]]
            ends = np.cumsum(many)
            for start in range(0, int(ends[-1]), compared):
                pair = np.arange(start, min(start + compared, ends[-1]))
                a = np.searchsorted(ends, pair, "right")
                b = first[a] + pair - (ends[a] - many[a])
                shared = _shared(masks[0].taken(a), masks[1].taken(b))
                union = masks[0].area[a] + masks[1].area[b] - shared
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(there[0][a])), ids[0].take(pa.array(a)), ids[1].take(pa.array(b)), pa.array(shared), pa.array(union)], names)

    names = ["image_id", "a_id", "b_id", "shared", "union"]
    schema = StructType([StructField(n, dealt.schema[c].dataType) for n, c in zip(names, ("image_id", "id0", "id1"))] + [StructField(n, LongType()) for n in names[3:]])
    found = dealt.mapInArrow(run, schema)
    return found.select("image_id", F.col("a_id").alias(one[0]), F.col("b_id").alias(other[0]), "shared", (F.col("shared") / (F.col("union") + F.lit(eps))).alias("iou"))


def layered_polygons(polygons: DataFrame, width: int, height: int, id_col: str = "det_id", points: str = "points") -> DataFrame:
    """:func:`layered_masks` of filled polygons, in one row for each: ``image_id, id, area, rank`` and the maximal ``runs`` in which it is topmost.

    A task that has all rows of an image fills, ranks and lays them, so neither runs nor layers are
    shuffled.  Images of few masks are laid together.  The masks of a larger one are filled a few thousand at a
    time, first for their areas, then from the topmost down onto what is covered, so a task holds the corners of
    one image and its layer, not its masks.
    """
    sent = _by_image(polygons, F.col(id_col).alias("id"), *_sides(points))
    filled = FILLED

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, image in whole_groups(batches, filled):
            rows, ids, xs, ys = batch.num_rows, *batch.columns[1:4]
            whole = _Runs(xs, ys, width, height, filled) if rows <= filled else None
            area = whole.area if whole else np.concatenate([_Runs(xs.slice(s, filled), ys.slice(s, filled), width, height, filled).area for s in range(0, rows, filled)])
            table = pa.table([pa.array(image), pa.array(-area), ids], names=["image", "area", "id"])
            order = pc.sort_indices(table, sort_keys=[(c, "ascending") for c in table.column_names], null_placement="at_start").to_numpy().astype(np.int64)
            begin = np.flatnonzero(np.diff(image[order], prepend=-1))
            rank = np.arange(rows) - np.repeat(begin, np.diff(np.append(begin, rows))) + 1
            covered = [np.zeros(0, np.int64)] * 2
            # From the topmost down; what is covered already has a rank beyond all others.
            for start in range((rows - 1) // filled * filled, -1, -filled):
                at, level = order[start : start + filled], rank[start : start + filled]
                size, low, high = whole.taken(at) if whole else _Runs(xs.take(pa.array(at)), ys.take(pa.array(at)), width, height, filled).taken(np.arange(len(at)))
                parts = (np.repeat(image[at], size), low, high, np.repeat(level, size))
                of, low, high, top = _topmost(*(np.concatenate(p) for p in zip((np.zeros(len(covered[0]), np.int64), *covered, np.full(len(covered[0]), rows + 1)), parts)))
                covered, seen = [low, high], top <= rows
                place = (begin[of] + top - 1 - start)[seen]
                by = np.argsort(place, kind="stable")
                offsets = np.searchsorted(place[by], np.arange(len(at) + 1)).astype(np.int32)
                runs = pa.ListArray.from_arrays(pa.array(offsets), pa.StructArray.from_arrays([pa.array(low[seen][by]), pa.array(high[seen][by])], ["low", "high"]))
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at)), ids.take(pa.array(at)), pa.array(area[at]), pa.array(level), runs], names)

    names = ["image_id", "id", "area", "rank", "runs"]
    kinds = [polygons.schema["image_id"].dataType, polygons.schema[id_col].dataType, LongType(), LongType(), RUNS]
    return sent.mapInArrow(run, StructType([StructField(n, k) for n, k in zip(names, kinds)])).withColumnRenamed("id", id_col)


_LAID = ("low", "high", "rank")


def _laid_out(column: pa.Array, of: np.ndarray, parts: tuple[np.ndarray, ...], places: np.ndarray) -> pa.RecordBatch:
    """Rows of an image and at most ``PIECES`` of its pieces; ``places`` has a row of each owner."""
    cuts = np.flatnonzero(np.diff(of, prepend=-1))
    cuts = np.concatenate([np.arange(a, b, PIECES) for a, b in zip(cuts, np.append(cuts[1:], len(of)))] or [cuts]).astype(np.int64)
    offsets = pa.array(np.append(cuts, len(of)).astype(np.int32))
    lists = [pa.ListArray.from_arrays(offsets, pa.array(p)) for p in parts]
    return pa.RecordBatch.from_arrays([column.take(pa.array(places[of[cuts]])), *lists], ["image_id", *_LAID])


def _owners(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Number of each row's image in its batch, and one row of each image."""
    coded = column.dictionary_encode(null_encoding="encode").indices.to_numpy()
    return coded, np.unique(coded, return_index=True)[1]


def _lay(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The layer of each image's masks of one batch."""
    for batch in batches:
        coded, places = _owners(batch.column(0))
        low, high = (batch.column(i).fill_null([]) for i in (2, 3))
        sizes = np.diff(low.offsets.to_numpy())
        found = _topmost(np.repeat(coded, sizes).astype(np.int64), low.flatten().to_numpy(), high.flatten().to_numpy(), np.repeat(batch.column(1).to_numpy(), sizes))
        yield _laid_out(batch.column(0), found[0], found[1:], places)


def _overlay(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One layer of the layers of each image, from rows in order of images; an image may go on in the next batch."""
    held: list[np.ndarray] = [np.zeros(0, np.int64)] * 3
    whose: pa.Array | None = None

    def pieces(column: pa.Array, of: np.ndarray, places: np.ndarray, parts: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        for start in range(0, len(of), PIECES):
            part = slice(start, start + PIECES)
            yield pa.RecordBatch.from_arrays([column.take(pa.array(places[of[part]])), *(pa.array(p[part]) for p in parts)], ["image_id", *_LAID])

    for batch in batches:
        if not batch.num_rows:
            continue
        column = batch.column(0) if whose is None else pa.concat_arrays([whose, batch.column(0)])
        coded, places = _owners(column)
        sizes = np.diff(batch.column(1).offsets.to_numpy())
        own = coded if whose is None else coded[1:]
        of = np.concatenate((np.full(len(held[0]), coded[0]), np.repeat(own, sizes))).astype(np.int64)
        found = _topmost(of, *(np.concatenate((h, batch.column(i + 1).flatten().to_numpy())) for i, h in enumerate(held)))
        done = found[0] != coded[-1]
        yield from pieces(column, found[0][done], places, [p[done] for p in found[1:]])
        whose, held = column.slice(len(column) - 1), [p[~done] for p in found[1:]]
    if whose is not None:
        yield from pieces(whose, np.zeros(len(held[0]), np.int64), np.zeros(1, np.int64), held)


def layered_masks(masks: DataFrame, id_col: str = "det_id") -> tuple[DataFrame, DataFrame]:
    """One layer for each image in which the smaller mask lies on top of the larger.

    Returns the rank of each mask in its image (1 for the largest, equal areas
    by id) as ``image_id, id, area, rank``, and the layer as maximal runs
    ``image_id, low, high, rank`` of pixels with the same topmost mask.  Ranks come
    by ranges, so an image may hold any number of masks.  Each task first lays
    the masks of a batch, so at most the visible pieces are shuffled, then
    the layers of an image one after the other; it holds no more than one image's layer.
    """
    area = mask_area(F.col("runs"))
    # Two plain arrays: an array of structs takes more than twice the bytes in an exchange.
    sides = [F.transform("runs", _part(c)).alias(c) for c in ("low", "high")]
    sized = masks.select("image_id", F.col(id_col), area.alias("area"), *sides)
    ranked = placed(sized, ["image_id"], [F.desc("area"), F.col(id_col).asc()], "rank").withColumn("rank", F.col("rank") + 1)
    image = masks.schema["image_id"]
    laid = StructType([image, *(StructField(c, ArrayType(LongType())) for c in _LAID)])
    layers = ranked.select("image_id", "rank", "low", "high").mapInArrow(_lay, laid)
    layer = layers.repartition("image_id").sortWithinPartitions("image_id").mapInArrow(_overlay, StructType([image, *(StructField(c, LongType()) for c in _LAID)]))
    return ranked.select("image_id", id_col, "area", "rank"), layer
