"""Terminals, nodes and segments of a schematic: nearest-neighbour maps and groups."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, IntegerType, StructField, StructType

#: Side of the cells of near segments, in radii.
SIDE = 4
#: Pairs of points that a task looks at together.
PAIRS = 1 << 19
#: Distance of what has none, behind all others.
FAR = np.finfo(float).max


def nearest_terminals(components: DataFrame, terminals: DataFrame, k: int = 2) -> DataFrame:
    """The ``k`` terminals nearest to each component's middle, ties to the smaller index."""
    pairs = components.join(terminals, "image_id").withColumn("dist", F.sqrt(F.pow(F.col("mx") - F.col("tx"), 2) + F.pow(F.col("my") - F.col("ty"), 2)))
    order = Window.partitionBy("image_id", "comp_id").orderBy("dist", "term_id")
    return pairs.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("image_id", "comp_id", "rank", "term_id", "tx", "ty")


def terminal_nodes(near: DataFrame, nodes: DataFrame) -> DataFrame:
    """Node of both terminals of each component.

    Each takes its nearest node.  If both want the same, the farther one takes
    its second nearest (its only one, where there is one); ties let the first stay.
    """
    pairs = near.join(nodes, "image_id").withColumn("dist", F.sqrt(F.pow(F.col("nx") - F.col("tx"), 2) + F.pow(F.col("ny") - F.col("ty"), 2)))
    order = Window.partitionBy("image_id", "comp_id", "rank").orderBy("dist", "node_id")
    ranked = pairs.withColumn("r", F.row_number().over(order)).where("r <= 2")
    pick = lambda t, r, c: F.max(F.when((F.col("rank") == t) & (F.col("r") == r), F.col(c)))
    wide = ranked.groupBy("image_id", "comp_id").agg(*[pick(t, r, c).alias(f"{c}_{t}{r}") for t in (1, 2) for r in (1, 2) for c in ("node_id", "dist")])
    same = F.col("node_id_11") == F.col("node_id_21")
    first_stays = F.col("dist_11") <= F.col("dist_21")
    one = F.when(same & ~first_stays, F.coalesce("node_id_12", "node_id_11")).otherwise(F.col("node_id_11"))
    two = F.when(same & first_stays, F.coalesce("node_id_22", "node_id_21")).otherwise(F.col("node_id_21"))
    return wide.select("image_id", "comp_id", one.alias("node1"), two.alias("node2"))


def _nearest(x: np.ndarray, y: np.ndarray, first: np.ndarray, size: np.ndarray, px: np.ndarray, py: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Places and distances of the ``k`` points nearest to each ``x, y`` among ``size`` points from ``first`` on; -1 where there are fewer.

    Ties go to the earlier point.  Points are paired in blocks of bounded size,
    so a large image takes time but no more memory.
    """
    at, gap = np.full((k, len(x)), -1), np.full((k, len(x)), np.nan)
    some = np.flatnonzero(size > 0)
    ends, begin = np.cumsum(size[some]), 0
    while begin < len(some):
        stop = max(begin + 1, int(np.searchsorted(ends, (ends[begin - 1] if begin else 0) + PAIRS, "right")))
        mine, n = some[begin:stop], size[some[begin:stop]]
        starts = np.cumsum(n) - n
        of = np.repeat(np.arange(len(mine)), n)
        point = np.arange(len(of)) - np.repeat(starts - first[mine], n)
        dist = np.sqrt((x[mine][of] - px[point]) ** 2 + (y[mine][of] - py[point]) ** 2)
        # Distances that are unknown come last, points that are taken not at all.
        order = np.where(dist < FAR, dist, FAR)
        for rank in range(k):
            least = np.minimum.reduceat(order, starts)
            hits = np.flatnonzero(order == least[of])
            hits = hits[np.diff(of[hits], prepend=-1) != 0]
            left = n > rank
            at[rank, mine[left]], gap[rank, mine[left]] = point[hits[left]], dist[hits[left]]
            order[hits] = np.inf
        begin = stop
    return at, gap


def point(ident: str, x: str, y: str, *others: str) -> Column:
    """A part of a circuit as :func:`image_circuits` reads it: id, place and what else is kept of it."""
    return F.struct(F.col(ident).alias("id"), F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y"), *others)


def circuit_parts(components: DataFrame, terminals: DataFrame, nodes: DataFrame) -> DataFrame:
    """Rows for :func:`image_circuits` from three tables, one part in each."""
    parts = [components.select("image_id", point("comp_id", "mx", "my").alias("component")), terminals.select("image_id", point("term_id", "tx", "ty").alias("terminal")), nodes.select("image_id", point("node_id", "nx", "ny").alias("node"))]
    return parts[0].unionByName(parts[1], True).unionByName(parts[2], True)


class _Points:
    """Parts of one kind in a run of images, by image and id."""

    def __init__(self, parts: pa.StructArray, image: np.ndarray, images: int) -> None:
        there = np.flatnonzero(parts.is_valid().to_numpy(zero_copy_only=False))
        rows = pa.table([pa.array(image[there]), pc.struct_field(parts, "id").take(pa.array(there))], names=["image", "id"])
        order = there[pc.sort_indices(rows, sort_keys=[("image", "ascending"), ("id", "ascending")]).to_numpy()]
        self.parts = parts.take(pa.array(order))
        self.image, self.ids = image[order], self.parts.field("id")
        self.x, self.y = (self.parts.field(c).to_numpy(zero_copy_only=False).astype(float) for c in "xy")
        self.count = np.bincount(self.image, minlength=images)
        self.start = np.cumsum(self.count) - self.count

    def taken(self, at: np.ndarray) -> pa.Array:
        """Ids at places, null at -1."""
        return self.ids.take(pa.array(at, mask=at < 0))

    def placed(self, at: np.ndarray, image: np.ndarray) -> pa.Array:
        """Places inside the image, null at -1."""
        return pa.array((at - self.start[image]).astype(np.int32), mask=at < 0)

    def kept(self) -> dict[str, pa.Array]:
        return {f.name: self.parts.field(f.name) for f in self.parts.type if f.name not in ("x", "y")}


def _differs(ids: pa.Array) -> np.ndarray:
    """Where a value is not the one before it, from the second on; two nulls are one value."""
    left, right = ids[:-1], ids[1:]
    return pc.fill_null(pc.not_equal(left, right), pc.xor(left.is_null(), right.is_null())).to_numpy(zero_copy_only=False)


def _mapped(components: _Points, terminals: _Points, nodes: _Points, known: np.ndarray) -> list[np.ndarray]:
    """Nodes of both terminals of each component, by the rule of :func:`terminal_nodes`; -1 where there is none."""
    mine = np.flatnonzero((known & (terminals.count > 0) & (nodes.count > 0))[components.image])
    of = components.image[mine]
    near, _ = _nearest(components.x[mine], components.y[mine], terminals.start[of], terminals.count[of], terminals.x, terminals.y, 2)
    # The second terminal is missing where an image has one only.
    node, dist = zip(*[_nearest(terminals.x[t], terminals.y[t], nodes.start[of], np.where(t < 0, 0, nodes.count[of]), nodes.x, nodes.y, 2) for t in near])
    same = node[0][0] == node[1][0]
    stays = dist[0][0] <= dist[1][0]
    other = lambda n: np.where(n[1] < 0, n[0], n[1])
    found = [np.full(len(components.image), -1) for _ in range(2)]
    found[0][mine], found[1][mine] = np.where(same & ~stays, other(node[0]), node[0][0]), np.where(same & stays, other(node[1]), node[1][0])
    return found


def _links(nodes: _Points, used: np.ndarray, known: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Links by the rule of :func:`hanging_links`, by node, and which of them come first of their pair; ``used`` are the nodes of terminals."""
    fresh = np.ones(len(nodes.image), bool)
    fresh[1:] = (nodes.image[1:] != nodes.image[:-1]) | pc.fill_null(pc.not_equal(nodes.ids[1:], nodes.ids[:-1]), True).to_numpy(zero_copy_only=False)
    run = np.cumsum(fresh) - 1
    uses = np.bincount(run[used[used >= 0]], minlength=len(run))[run]
    hanging = np.flatnonzero((uses < 2) & known[nodes.image])
    of, x, y = nodes.image[hanging], nodes.x[hanging], nodes.y[hanging]
    count = np.bincount(of, minlength=len(known))
    near, _ = _nearest(x, y, (np.cumsum(count) - count)[of], count[of], x, y, 3)
    wanted = [near[k] >= 0 for k in (1, 2)]
    wanted[1] &= uses[hanging] == 0
    start, end = np.concatenate([hanging[w] for w in wanted]), np.concatenate([hanging[near[k][w]] for k, w in zip((1, 2), wanted)])
    order = np.lexsort((end, start))
    start, end = start[order], end[order]
    first = np.zeros(len(start), bool)
    first[np.unique(np.minimum(start, end) * len(run) + np.maximum(start, end), return_index=True)[1]] = True
    return start, end, first


def image_circuits(rows: DataFrame) -> DataFrame:
    """One row for each image: ``components`` with the nodes of their terminals, ``nodes`` and ``links`` of hanging nodes, arrays by id.

    ``rows`` have ``image_id`` and structs ``component``, ``terminal`` and ``node`` (:func:`point`);
    a row may hold all three, or one (:func:`circuit_parts`).  Components get ``node1, node2`` and the
    places ``at1, at2`` of these nodes in their image, from 0; all are null in an image without terminals or
    nodes.  Links have ``node_id, to_node``, the places ``at, to`` and ``first`` of its pair.  Unknown distances come last.
    Points without an image are listed together, but neither mapped nor linked.
    """
    # The window asks for rows by image, and for an exchange or a sort only where they are not.
    rows = rows.select("image_id", "component", "terminal", "node", F.count("*").over(Window.partitionBy("image_id")).alias("size"))

    def found(table: pa.Table) -> pa.RecordBatch:
        table = table.combine_chunks()
        column = lambda name: pa.concat_arrays(table.column(name).chunks)
        ids = column("image_id")
        fresh = np.concatenate([[True], _differs(ids)])
        own = ids.take(pa.array(np.flatnonzero(fresh)))
        image, images, known = np.cumsum(fresh) - 1, len(own), own.is_valid().to_numpy(zero_copy_only=False)
        components, terminals, nodes = (_Points(column(name), image, images) for name in ("component", "terminal", "node"))
        picked = _mapped(components, terminals, nodes, known)
        start, end, first = _links(nodes, np.concatenate(picked), known)

        def listed(count: np.ndarray, fields: dict[str, pa.Array]) -> pa.Array:
            return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(count)]).astype(np.int32)), pa.StructArray.from_arrays(list(fields.values()), list(fields)))

        ends = {f"node{k}": nodes.taken(p) for k, p in enumerate(picked, 1)} | {f"at{k}": nodes.placed(p, components.image) for k, p in enumerate(picked, 1)}
        of = nodes.image[start]
        links = {"node_id": nodes.taken(start), "to_node": nodes.taken(end), "at": nodes.placed(start, of), "to": nodes.placed(end, of), "first": pa.array(first)}
        lists = [listed(components.count, components.kept() | ends), listed(nodes.count, nodes.kept()), listed(np.bincount(of, minlength=images), links)]
        return pa.RecordBatch.from_arrays([own, *lists], names=["image_id", "components", "nodes", "links"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            ids = batch.column(0)
            cuts = np.flatnonzero(_differs(ids)) + 1
            # All images but the last one are complete.
            cut = int(cuts[-1]) if len(cuts) else 0
            if held and (cut or _differs(pa.concat_arrays([held[-1].column(0)[-1:], ids[:1]]))[0]):
                yield found(pa.Table.from_batches([*held, batch.slice(0, cut)]))
                held = []
            elif cut:
                yield found(pa.Table.from_batches([batch.slice(0, cut)]))
            held.append(batch.slice(cut))
        if held:
            yield found(pa.Table.from_batches(held))

    kind = {c: rows.schema[c].dataType for c in ("component", "node")}
    kept = {c: [f for f in k.fields if f.name not in ("x", "y")] for c, k in kind.items()}
    a_node = lambda name: StructField(name, kind["node"]["id"].dataType)
    a_place = lambda name: StructField(name, IntegerType())
    lists = {
        "components": [*kept["component"], a_node("node1"), a_node("node2"), a_place("at1"), a_place("at2")],
        "nodes": kept["node"],
        "links": [a_node("node_id"), a_node("to_node"), a_place("at"), a_place("to"), StructField("first", BooleanType())],
    }
    return rows.mapInArrow(run, StructType([rows.schema["image_id"], *[StructField(name, ArrayType(StructType(fields))) for name, fields in lists.items()]]))


def terminals_mapped(found: DataFrame) -> DataFrame:
    """Rows of components and the nodes of both terminals from :func:`image_circuits`; those of an image without terminals or nodes are left out."""
    rows = found.select("image_id", F.explode("components").alias("c")).where("c.at1 is not null")
    return rows.select("image_id", F.col("c.id").alias("comp_id"), "c.node1", "c.node2")


def nodes_linked(found: DataFrame) -> DataFrame:
    """Rows of links from :func:`image_circuits`, as :func:`hanging_links` gives them."""
    return found.select("image_id", F.explode("links").alias("l")).select("image_id", "l.node_id", "l.to_node")


def terminal_map(components: DataFrame, terminals: DataFrame, nodes: DataFrame) -> DataFrame:
    """Node of both terminals of each component: :func:`terminal_nodes` of :func:`nearest_terminals`, without a sort of all pairs."""
    return terminals_mapped(image_circuits(circuit_parts(components, terminals, nodes)))


def hanging_links(mapped: DataFrame, nodes: DataFrame) -> DataFrame:
    """Nodes with fewer than two terminals, linked to as many of the nearest such nodes as they lack; unknown distances come last."""
    uses = mapped.select("image_id", F.explode(F.array("node1", "node2")).alias("node_id")).groupBy("image_id", "node_id").agg(F.count("*").alias("uses"))
    hanging = nodes.join(uses, ["image_id", "node_id"], "left").withColumn("uses", F.coalesce("uses", F.lit(0))).where("uses < 2")
    other = hanging.select("image_id", F.col("node_id").alias("to_node"), F.col("nx").alias("ox"), F.col("ny").alias("oy"))
    pairs = hanging.join(other, "image_id").withColumn("dist", F.sqrt(F.pow(F.col("nx") - F.col("ox"), 2) + F.pow(F.col("ny") - F.col("oy"), 2)))
    order = Window.partitionBy("image_id", "node_id").orderBy(F.col("dist").asc_nulls_last(), "to_node")
    return pairs.withColumn("r", F.row_number().over(order)).where((F.col("r") > 1) & (F.col("r") <= 3 - F.col("uses"))).select("image_id", "node_id", "to_node")


def near_segments(segments: DataFrame, radius: float) -> DataFrame:
    """Pairs of segments of an image with two end points within ``radius``.

    End points fall into square cells of ``SIDE`` radii; a point also goes to those cells
    around its own that lie within ``radius``, of each two cells to one only, so dense images do not
    pair everything and few points are sent more than once.
    """
    ends = segments.select("image_id", "seg_id", F.explode(F.array(F.struct(F.col("x1").alias("x"), F.col("y1").alias("y")), F.struct(F.col("x2").alias("x"), F.col("y2").alias("y")))).alias("p")).select("image_id", "seg_id", "p.x", "p.y")
    cell = lambda c: F.floor(c / (SIDE * radius))
    cx, cy = cell(F.col("x")), cell(F.col("y"))
    left = ends.select("image_id", F.col("seg_id").alias("a"), F.col("x").alias("ax"), F.col("y").alias("ay"), cx.alias("cx"), cy.alias("cy"))
    # Half of the cells around a cell: each two cells meet once, whichever of them is on the left.
    steps = F.array(*[F.struct(F.lit(dx).alias("dx"), F.lit(dy).alias("dy")) for dx, dy in ((0, 0), (0, 1), (1, -1), (1, 0), (1, 1))])
    # A little more than the radius, so that no rounding of a quotient loses a cell.
    reaches = lambda c, own, d: (d == 0) | ((d == 1) & (cell(c + radius * 1.001) > own)) | ((d == -1) & (cell(c - radius * 1.001) < own))
    right = ends.withColumn("d", F.explode(steps)).where(reaches(F.col("x"), cx, F.col("d.dx")) & reaches(F.col("y"), cy, F.col("d.dy")))
    right = right.select("image_id", F.col("seg_id").alias("b"), F.col("x").alias("bx"), F.col("y").alias("by"), (cx + F.col("d.dx")).alias("cx"), (cy + F.col("d.dy")).alias("cy"), ((F.col("d.dx") == 0) & (F.col("d.dy") == 0)).alias("same"))
    pairs = left.join(right, ["image_id", "cx", "cy"]).where(F.when(F.col("same"), F.col("a") < F.col("b")).otherwise(F.col("a") != F.col("b")))
    close = F.pow(F.col("ax") - F.col("bx"), 2) + F.pow(F.col("ay") - F.col("by"), 2) <= radius * radius
    return pairs.where(close).select("image_id", F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def greedy_groups(segments: DataFrame, radius: float = 40.0) -> DataFrame:
    """Order-dependent grouping of an image's segments in id order.

    The first free segment opens a group; one pass over the later free ones adds
    each that is near a member so far.  A segment that was passed over is not
    tested again, so this is no transitive closure.
    """

    kind = {f.name: f.dataType.simpleString() for f in segments.schema.fields}

    def labels(ends: np.ndarray) -> np.ndarray:
        """Group numbers of one image's segments; ``ends`` is (segments, 2 ends, 2 coordinates)."""
        label, count = np.zeros(len(ends), np.int64), 0
        while len(free := np.flatnonzero(label == 0)):
            count += 1
            rest, at = ends[free], 0
            near = np.zeros(len(free), bool)
            label[free[0]] = count
            while True:
                gap = rest[at + 1 :, :, None, :] - rest[at][None, None]
                near[at + 1 :] |= ((gap**2).sum(3) <= radius * radius).any((1, 2))
                later = np.flatnonzero(near[at + 1 :])
                if not len(later):
                    break
                at += 1 + int(later[0])
                label[free[at]] = count
        return label

    def group(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def out(table: pa.Table) -> pa.RecordBatch:
            image = table.column("image_id").to_numpy()
            ends = np.stack([table.column(c).to_numpy() for c in ("x1", "y1", "x2", "y2")], 1).astype(float).reshape(-1, 2, 2)
            cuts = [*(np.flatnonzero(image[1:] != image[:-1]) + 1).tolist(), len(image)] if len(image) else []
            found = [labels(ends[a:b]) for a, b in zip([0, *cuts], cuts)]
            return table.select(["image_id", "seg_id"]).append_column("label", pa.array(np.concatenate(found or [np.zeros(0, np.int64)]))).combine_chunks()

        for batch in batches:
            held.append(batch)
            image = batch.column(0).to_numpy()
            last = np.flatnonzero(image[1:] != image[:-1])
            # All images but the last one are complete.
            if len(last):
                table = pa.Table.from_batches(held)
                cut = table.num_rows - len(image) + int(last[-1]) + 1
                yield from out(table.slice(0, cut)).to_batches()
                held = table.slice(cut).to_batches()
        if held:
            yield from out(pa.Table.from_batches(held)).to_batches()

    rows = segments.select("image_id", "seg_id", "x1", "y1", "x2", "y2").repartition("image_id").sortWithinPartitions("image_id", "seg_id")
    return rows.mapInArrow(group, f"image_id {kind['image_id']}, seg_id {kind['seg_id']}, label long")


def segment_components(segments: DataFrame, radius: float) -> DataFrame:
    """Connected components of near segments, labelled by the smallest segment id of the image.

    A component never leaves its image, so labels spread inside (image, segment)
    pairs by the shared large-star and small-star steps.
    """
    from netloom.operators.components import connected_components

    key = lambda c: F.struct("image_id", F.col(c).alias("seg_id"))
    found = connected_components(near_segments(segments, radius).select(key("a").alias("a"), key("b").alias("b")), "a", "b")
    return segments.select("image_id", "seg_id", key("seg_id").alias("vertex")).join(found, "vertex", "left").select("image_id", "seg_id", F.coalesce("component.seg_id", "seg_id").alias("component"))


def cluster_centroids(labelled: DataFrame) -> DataFrame:
    """Mean of end points and of middles of each group."""
    mid = lambda a, b: F.floor((F.col(a) + F.col(b)) / 2)
    return labelled.groupBy("image_id", "label").agg(F.avg((F.col("x1") + F.col("x2")) / 2).alias("cx"), F.avg((F.col("y1") + F.col("y2")) / 2).alias("cy"), F.avg(mid("x1", "x2")).alias("mid_x"), F.count("*").alias("n"))


def resample_polygon(points: DataFrame, n: int) -> DataFrame:
    """``n`` points at even index steps along each closed polygon, linearly interpolated."""
    closed = points.groupBy("image_id").agg(F.array_sort(F.collect_list(F.struct("idx", "x", "y"))).alias("p"))
    ring = closed.withColumn("p", F.concat("p", F.slice("p", 1, 1))).withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    at = F.col("k") * (F.size("p") - 1) / F.lit(n - 1)
    low = F.least(F.floor(at), F.size("p") - 2).cast("int")
    take = lambda i, c: F.element_at("p", i + 1)[c]
    value = lambda c: take(low, c) + (take(low + 1, c) - take(low, c)) * (at - low)
    return ring.where(F.size("p") > 1).select("image_id", "k", value("x").alias("x"), value("y").alias("y"))


def build_targets(boxes: DataFrame, anchors: DataFrame, cells_x: int, cells_y: int, cell: int = 8, ratio: float = 4.0) -> DataFrame:
    """Anchor matches on a grid of ``cells_x`` by ``cells_y``, with at most two neighbour cells each.

    A middle in the near half of its cell also gives the cell before it, one in
    the far half that behind it, unless it lies in the grid's first or last
    cell; cells beyond the grid are moved to its border.  ``anchors`` has a
    handful of rows by definition of a detection head, so it is the broadcast
    side; a box matches where no side ratio reaches ``ratio``.
    """
    pairs = boxes.crossJoin(F.broadcast(anchors))
    rw, rh = F.col("w") / F.col("aw"), F.col("h") / F.col("ah")
    fits = F.greatest(rw, 1 / rw, rh, 1 / rh) < ratio
    gx, gy = F.col("cx") / cell, F.col("cy") / cell
    step = lambda dx, dy: F.struct(F.lit(dx).alias("dx"), F.lit(dy).alias("dy"))
    near = lambda g, dx, dy: F.when((F.pmod(g, F.lit(1.0)) < 0.5) & (g > 1), step(dx, dy))
    offsets = F.array_compact(F.array(step(0.0, 0.0), near(gx, -0.5, 0.0), near(gy, 0.0, -0.5), near(cells_x - gx, 0.5, 0.0), near(cells_y - gy, 0.0, 0.5)))
    hit = pairs.where(fits).withColumn("o", F.explode(offsets))
    # Towards zero, as a cast does.
    at = lambda g, d, n: F.least(F.greatest((g + F.col(f"o.{d}")).cast("long"), F.lit(0)), F.lit(n - 1)).cast("long")
    return hit.select("image_id", "det_id", "anchor_id", at(gx, "dx", cells_x).alias("gi"), at(gy, "dy", cells_y).alias("gj"))
