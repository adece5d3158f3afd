"""Sinks: label lines, manifests, graph and record JSON, logs."""

from __future__ import annotations

import functools
import hashlib

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def yolo_line(cls: Column, x: Column, y: Column, w: Column, h: Column) -> Column:
    """Label line with six decimals."""
    return F.format_string("%d %.6f %.6f %.6f %.6f", cls, x, y, w, h)


def label_files(boxes: DataFrame, width: int, height: int) -> DataFrame:
    """One label text for each image, lines in id order; ``x1 y1 x2 y2`` are pixels.

    Halves of the sixth decimal go to the even digit.
    """
    cx, cy = (F.col("x1") + F.col("x2")) / 2 / width, (F.col("y1") + F.col("y2")) / 2 / height
    line = yolo_line(F.col("cls"), *[F.bround(v, 6) for v in (cx, cy, (F.col("x2") - F.col("x1")) / width, (F.col("y2") - F.col("y1")) / height)])
    grouped = boxes.withColumn("line", line).groupBy("image_id").agg(F.array_sort(F.collect_list(F.struct("det_id", "line"))).alias("r"))
    return grouped.select("image_id", F.array_join(F.transform("r", lambda x: x["line"]), "\n").alias("labels"))


def multihead_lines(boxes: DataFrame, segments: DataFrame, nodes: DataFrame, terminals: DataFrame, tiers: DataFrame, width: int, height: int) -> DataFrame:
    """Lines of the component, wire, node and terminal heads as ``head, image_id, line``.

    Images that ``tiers`` (``image_id, quality_tier``) calls FAILED give none.
    Halves of the sixth decimal go to the even digit, as the reference's do.
    """
    x = lambda c: F.col(c) / width
    y = lambda c: F.col(c) / height
    six = lambda *v: [F.bround(c, 6) for c in v]
    box = yolo_line(F.col("cls"), *six((x("x1") + x("x2")) / 2, (y("y1") + y("y2")) / 2, x("x2") - x("x1"), y("y2") - y("y1")))
    wire = F.format_string("%d %.6f %.6f %.6f %.6f", F.lit(0), *six(x("x1"), y("y1"), x("x2"), y("y2")))
    node = F.format_string("%d %.6f %.6f 2", F.lit(0), *six(x("nx"), y("ny")))
    terminal = F.format_string("%d %.6f %.6f 2 %s %s", F.col("cls"), *six(x("tx"), y("ty")), F.col("component_id").cast("string"), F.col("terminal_name"))
    parts = [("components", boxes, box), ("wires", segments, wire), ("nodes", nodes, node), ("terminals", terminals, terminal)]
    rows = [d.select(F.lit(h).alias("head"), "image_id", line.alias("line")) for h, d, line in parts]
    failed = tiers.where("quality_tier = 'FAILED'").select("image_id").distinct()
    return rows[0].unionAll(rows[1]).unionAll(rows[2]).unionAll(rows[3]).join(failed, "image_id", "left_anti").select("head", "image_id", "line")


def dataset_yaml(classes: DataFrame, path: str) -> DataFrame:
    """Descriptor text of a dataset, classes by id."""
    names = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("cls", "name"))), lambda c: F.format_string("  %d: %s", c["cls"], c["name"])), "\n")
    return classes.agg(F.concat(F.lit(f"path: {path}\ntrain: train/images\nval: val/images\ntest: test/images\nnames:\n"), names).alias("yaml"))


def coco_document(images: DataFrame, annotations: DataFrame, classes: DataFrame) -> DataFrame:
    """The three parts of an annotation document as JSON rows, written as one file each."""
    part = lambda name, d: d.select(F.lit(name).alias("part"), F.to_json(F.struct(*d.columns)).alias("json"))
    return part("images", images).unionAll(part("annotations", annotations)).unionAll(part("categories", classes))


def graph_json(vertices: DataFrame, edges: DataFrame) -> DataFrame:
    """Node-link JSON of each image's graph."""
    v = vertices.groupBy("image_id").agg(F.array_sort(F.collect_list(F.struct("id"))).alias("nodes"))
    e = edges.groupBy("image_id").agg(F.array_sort(F.collect_list(F.struct("source", "target"))).alias("links"))
    return v.join(e, "image_id", "left").select("image_id", F.to_json(F.struct("nodes", F.coalesce("links", F.array()).alias("links"))).alias("graph"))


#: Lists of a detection document, and the part of a row that each is made of.
_LISTS = {"yolo_detections": "box", "hough_lines": "segment", "junction_candidates": "junction", "components": "component", "nodes": "node", "connections": "connection"}


def placed(pos: str, value: Column) -> Column:
    """A part of a detection document as :func:`detection_documents` reads it."""
    return F.struct(F.col(pos).alias("pos"), value.alias("value"))


def box_value() -> Column:
    """A box in a detection document."""
    return F.struct("det_id", "cls", "conf", "x1", "y1", "x2", "y2")


def point_value(x: str, y: str) -> Column:
    """A point in a detection document."""
    return F.struct(F.col(x).alias("x"), F.col(y).alias("y"))


def segment_value(x1: str, y1: str, x2: str, y2: str) -> Column:
    """A segment in a detection document, with both ends."""
    return F.struct(point_value(x1, y1).alias("start"), point_value(x2, y2).alias("end"))


def detection_documents(rows: DataFrame) -> DataFrame:
    """One JSON document with seven keys for each image that has a size, in one grouping.

    ``rows`` have ``image_id``, the struct ``size`` (``width, height``) and the parts ``box, segment, junction,
    component, node, connection`` (:func:`placed`); a struct that is null is not there, so one row may hold many parts
    or one (:func:`detection_json`).  Lists are in order of ``pos``; what an image lacks is an empty list.
    """
    lists = [F.sort_array(F.collect_list(part)).alias(part) for part in _LISTS.values()]
    found = rows.where("image_id is not null").groupBy("image_id").agg(F.max("size").alias("size"), *lists).where("size is not null")
    kept = {name: F.col(f"{part}.value") for name, part in _LISTS.items()}
    names = [*list(kept)[:3], "image_size", *list(kept)[3:]]
    return found.select("image_id", F.to_json(F.struct(*[(kept | {"image_size": F.col("size")})[n].alias(n) for n in names])).alias("json"))


def detection_json(boxes: DataFrame, segments: DataFrame, junctions: DataFrame, sizes: DataFrame, components: DataFrame, nodes: DataFrame, connections: DataFrame) -> DataFrame:
    """:func:`detection_documents` of seven tables, for each image of ``sizes`` (``image_id, width, height``).

    Boxes are in id order, segments with both ends, junctions as points; the
    others have ``image_id, pos, line``.
    """
    parts = {
        "size": (sizes, F.struct("width", "height")),
        "box": (boxes, placed("det_id", box_value())),
        "segment": (segments, placed("seg_id", segment_value("x1", "y1", "x2", "y2"))),
        "junction": (junctions, placed("node_id", point_value("nx", "ny"))),
        **{name: (rows, placed("pos", F.col("line"))) for name, rows in (("component", components), ("node", nodes), ("connection", connections))},
    }
    rows = [table.select("image_id", value.alias(name)) for name, (table, value) in parts.items()]
    return detection_documents(functools.reduce(lambda a, b: a.unionByName(b, True), rows))


def write_products(products: DataFrame, folder: str) -> None:
    """Write ``product, image_id, text`` rows, each product into a folder of its own."""
    products.select("product", "image_id", "text").repartition("product", F.pmod(F.xxhash64("image_id"), F.lit(64))).write.mode("append").partitionBy("product").json(folder)


def summary_strings(boxes: DataFrame) -> DataFrame:
    """``n Names`` phrases of each image, joined; names by class."""
    n = boxes.groupBy("image_id", "ctype").agg(F.count("*").alias("n"))
    phrase = F.concat(F.col("n").cast("string"), F.lit(" "), F.col("ctype"), F.when(F.col("n") > 1, "s").otherwise(""))
    grouped = n.withColumn("p", phrase).groupBy("image_id").agg(F.array_sort(F.collect_list(F.struct("ctype", "p"))).alias("r"))
    return grouped.select("image_id", F.array_join(F.transform("r", lambda x: x["p"]), ", ").alias("summary"))


def component_report(connections: DataFrame) -> DataFrame:
    """Text report lines: nodes 1-based in the list, 0-based in connections, as in the golden sample."""
    line = F.format_string("%s: %d - %d", F.col("label"), F.col("node1"), F.col("node2"))
    grouped = connections.withColumn("line", line).groupBy("image_id").agg(F.array_sort(F.collect_list(F.struct("comp_id", "line"))).alias("r"))
    return grouped.select("image_id", F.array_join(F.transform("r", lambda x: x["line"]), "\n").alias("report"))


def evolution_record(results: DataFrame, keys: list[str], path: str, fitness: Column) -> str:
    """Append ``generation`` and ``keys`` to the CSV log at ``path``; the best generation so far as YAML text.

    Of equal fitness the first generation is the best; an empty log gives an empty text.
    """
    columns = ["generation", *keys]
    results.select(*columns).write.mode("append").option("header", True).csv(path)
    log = results.sparkSession.read.csv(path, header=True, inferSchema=True).withColumn("_f", fitness)
    found = log.agg(F.min_by(F.struct(*columns), F.struct(-F.col("_f"), "generation")).alias("best"), F.max("generation").alias("last")).first()
    if found["best"] is None:
        return ""
    head = [f"# Best generation: {found['best']['generation']}", f"# Last generation: {found['last']}"]
    return "\n".join([*head, *(f"{k}: {found['best'][k]}" for k in keys)]) + "\n"


def split_manifests(rows: DataFrame, path: str) -> None:
    """One text manifest for each split."""
    rows.select("split", F.col("path").alias("value")).write.mode("overwrite").partitionBy("split").text(path)


def next_name(existing: DataFrame, base: str, most: int = 9998) -> str:
    """``base`` if it is free, else the first free of ``base2`` ... ``base9998``; an error if all are used."""
    number = F.substring("name", len(base) + 1, 10)
    taken = existing.where(F.col("name").startswith(F.lit(base)) & (number.rlike("^[1-9][0-9]{0,3}$") | (F.col("name") == base))).select(F.coalesce(number.try_cast("int"), F.lit(1)).alias("n"))
    # At most as many rows as there are names.
    used = {r["n"] for r in taken.distinct().collect()}
    if 1 not in used:
        return base
    for n in range(2, most + 1):
        if n not in used:
            return f"{base}{n}"
    raise FileExistsError(f"all names from {base} to {base}{most} are in use")


def fileset_hash(files: DataFrame) -> DataFrame:
    """SHA-256 of the total size and all paths in path order, as ``hash``.

    The digest is sequential by definition; paths come to the driver one
    partition after the other and are not held.
    """
    spark = files.sparkSession
    digest = hashlib.sha256(str(files.agg(F.coalesce(F.sum("size"), F.lit(0)).alias("n")).first()["n"]).encode())
    for row in files.select("path").where("path is not null").orderBy("path").toLocalIterator():
        digest.update(row["path"].encode())
    return spark.createDataFrame([(digest.hexdigest(),)], "hash string")
