"""Scans: image folders, label text, manifests, CSV and YAML descriptors."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Suffixes that the two folder scans take.
FOLDER_SUFFIXES = ("png", "jpg", "jpeg", "bmp", "gif")
BATCH_SUFFIXES = ("jpg", "jpeg", "png", "bmp", "tiff")


def suffix(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"\.([A-Za-z0-9]+)$", 1))


def image_files(spark: SparkSession, folder: str, suffixes: tuple[str, ...] = BATCH_SUFFIXES, recursive: bool = False) -> DataFrame:
    """Files of a folder by suffix, whatever its case; metadata only, content stays unread until selected."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower())
    return reader.load(folder).where(suffix(F.col("path")).isin(*suffixes))


def manifest_paths(spark: SparkSession, path: str) -> DataFrame:
    """Paths of a text manifest; ``./`` is rebased to the manifest's folder."""
    parent = path.rsplit("/", 1)[0]
    return spark.read.text(path).where(F.trim("value") != "").select(F.regexp_replace(F.trim("value"), r"^\./", parent + "/").alias("path"))


def media_order(paths: DataFrame, videos: tuple[str, ...] = ("mp4", "avi", "mov", "mkv")) -> DataFrame:
    """Images first, then videos, each in path order."""
    return paths.withColumn("is_video", suffix(F.col("path")).isin(*videos)).orderBy("is_video", "path")


def label_path(path: Column) -> Column:
    """Label file of an image: last ``/images/`` folder becomes ``/labels/``, suffix ``txt``."""
    return F.regexp_replace(F.regexp_replace(path, r"^(.*)/images/", "$1/labels/"), r"\.[^./]*$", ".txt")


def folder_label(path: Column) -> Column:
    """Name of the folder that holds a file, its class in folder-labelled sets."""
    return F.element_at(F.split(path, "/"), -2)


def parse_labels(lines: DataFrame) -> DataFrame:
    """``path, value`` lines to ``path, cls, x, y, w, h, status``.

    Rows of five numbers are boxes; longer ones are polygons, taken as their
    bounding boxes.  Negative values, coordinates over 1 and other row lengths
    are ``corrupt``.
    """
    numbers = F.transform(F.split(F.trim("value"), r"\s+"), lambda x: x.try_cast("double"))
    rows = lines.where(F.trim("value") != "").withColumn("v", numbers)
    xs = F.filter(F.slice("v", 2, F.size("v")), lambda x, i: i % 2 == 0)
    ys = F.filter(F.slice("v", 2, F.size("v")), lambda x, i: i % 2 == 1)
    polygon = F.size("v") > 6
    lo_x, hi_x, lo_y, hi_y = F.array_min(xs), F.array_max(xs), F.array_min(ys), F.array_max(ys)
    at = lambda i: F.get("v", F.lit(i))
    out = rows.select(
        "path", at(0).cast("int").alias("cls"),
        F.when(polygon, (lo_x + hi_x) / 2).otherwise(at(1)).alias("x"), F.when(polygon, (lo_y + hi_y) / 2).otherwise(at(2)).alias("y"),
        F.when(polygon, hi_x - lo_x).otherwise(at(3)).alias("w"), F.when(polygon, hi_y - lo_y).otherwise(at(4)).alias("h"),
        ((F.size("v") == 5) | polygon).alias("shaped"), F.exists("v", lambda x: x.isNull()).alias("broken"),
    )
    good = F.col("shaped") & ~F.col("broken") & (F.least("cls", "x", "y", "w", "h") >= 0) & (F.greatest("x", "y", "w", "h") <= 1)
    return out.withColumn("status", F.when(F.coalesce(good, F.lit(False)), "found").otherwise("corrupt")).drop("shaped", "broken")


def dataset_scan(images: DataFrame, lines: DataFrame) -> DataFrame:
    """``path, status, boxes`` of each image: its label file is missing, empty, corrupt or found.

    ``lines`` has ``path, value`` of the label files, an empty file as one null
    or empty line.  A file with a corrupt row is corrupt as a whole; equal rows
    of a file count once.
    """
    files = lines.groupBy("path").agg(F.count("*").alias("rows")).withColumnRenamed("path", "label")
    parsed = parse_labels(lines).distinct().groupBy(F.col("path").alias("label")).agg(F.count("*").alias("n"), F.max(F.col("status") == "corrupt").alias("bad"))
    joined = images.select("path", label_path(F.col("path")).alias("label")).join(files, "label", "left").join(parsed, "label", "left")
    status = F.when(F.col("rows").isNull(), "missing").when(F.col("n").isNull(), "empty").when(F.col("bad"), "corrupt").otherwise("found")
    return joined.select("path", status.alias("status"), F.when(status == "found", F.col("n")).otherwise(0).alias("boxes"))


def trimmed_csv(spark: SparkSession, path: str) -> DataFrame:
    """CSV with padded headers and values, as training logs write them."""
    table = spark.read.csv(path, header=True, ignoreLeadingWhiteSpace=True, ignoreTrailingWhiteSpace=True)
    return table.toDF(*[c.strip() for c in table.columns])


def numeric_columns(spark: SparkSession, path: str, use: list[int]) -> DataFrame:
    """Chosen columns of white-space separated numeric text."""
    parts = F.split(F.trim("value"), r"\s+")
    return spark.read.text(path).where(F.trim("value") != "").select(*[F.get(parts, F.lit(i)).try_cast("double").alias(f"c{i}") for i in use])


def sample_manifest(spark: SparkSession, path: str) -> DataFrame:
    """Difficulty manifest: one row for each sample, missing keys at their defaults."""
    schema = "samples array<struct<sample_id: string, overall_difficulty: double, curriculum_stage: bigint, ema_loss_component: double, ema_loss_wire: double, ema_loss_node: double, needs_review: boolean>>"
    rows = spark.read.schema(schema).json(path, multiLine=True).select(F.explode("samples").alias("s")).select("s.*")
    return rows.fillna({"overall_difficulty": 0.5, "curriculum_stage": 3, "ema_loss_component": 0.0, "ema_loss_wire": 0.0, "ema_loss_node": 0.0, "needs_review": False})


def page_annotations(spark: SparkSession, path: str) -> DataFrame:
    """Page annotations: a JSON object from page number to its images."""
    schema = "map<string, struct<page_size: array<bigint>, images: array<struct<file: string, coords: array<bigint>>>, num_images: bigint>>"
    text = spark.read.text(path, wholetext=True)
    return text.select(F.explode(F.from_json("value", schema)).alias("page", "v")).select(F.col("page").cast("long").alias("page"), "v.*")


def dataset_descriptor(lines: list[str], required: tuple[str, ...] = ("train", "val", "names")) -> dict:
    """Flat YAML descriptor (keys, block list or map of names); a missing required key is an error."""
    found: dict = {}
    key = None
    for line in lines:
        text = line.split(" #")[0].rstrip()
        if not text or text.lstrip().startswith("#"):
            continue
        if text[0] not in " -" and ":" in text:
            key, value = (p.strip() for p in text.split(":", 1))
            found[key] = value.strip("'\"") if value else {}
        elif key is not None and isinstance(found[key], dict):
            item = text.strip()
            if item.startswith("- "):
                found[key][len(found[key])] = item[2:].strip("'\" ")
            elif ":" in item:
                k, v = (p.strip() for p in item.split(":", 1))
                found[key][int(k)] = v.strip("'\"")
    if absent := [k for k in required if k not in found]:
        raise ValueError(f"descriptor lacks {absent}")
    return found


def one_match(paths: DataFrame, ending: str) -> str:
    """The one path that ends so; none or several are an error."""
    found = [r["path"] for r in paths.where(F.col("path").endswith(ending)).limit(2).collect()]
    if len(found) != 1:
        raise FileNotFoundError(f"{len(found) or 'no'} match for {ending}")
    return found[0]


def _found(spark: SparkSession, folders: list[str], pattern: str) -> DataFrame:
    """Files below folders whose name fits a pattern; folders that are not there hold none."""
    conf = spark._jsc.hadoopConfiguration()
    there = [f for f in folders if (p := spark._jvm.org.apache.hadoop.fs.Path(f)).getFileSystem(conf).exists(p)]
    if not there:
        return spark.createDataFrame([], "path string, modified timestamp")
    listed = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(there)
    return listed.select(F.regexp_replace("path", "^file:/+", "/").alias("path"), F.col("modificationTime").alias("modified"))


def find_config(spark: SparkSession, name: str, roots: list[str]) -> str:
    """Where a configuration is: ``name`` itself if it is empty, an address or a path that exists, else the one file of that name below the roots.

    No such file and several are errors.
    """
    if not name or re.match(r"(?i)https?://", name):
        return name
    place = spark._jvm.org.apache.hadoop.fs.Path(name)
    if place.getFileSystem(spark._jsc.hadoopConfiguration()).exists(place):
        return name
    ending = "/" + name.lstrip("/")
    # Characters that a pattern reads otherwise stand for themselves.
    plain = "".join(f"\\{c}" if c in "*?[]{}\\" else c for c in name.rsplit("/", 1)[-1])
    return one_match(_found(spark, roots, plain).where(F.col("path").endswith(ending)).distinct(), ending)


def newest_file(spark: SparkSession, folder: str, pattern: str = "last*.pt") -> str:
    """The file below a folder that changed last, of equal times that with the largest path; empty if none fits."""
    newest = _found(spark, [folder], pattern).agg(F.max(F.struct("modified", "path")).alias("f")).first()["f"]
    return newest["path"] if newest else ""
