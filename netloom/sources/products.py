"""Product trees: one whole file for each image and product, put in place only when all are written."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from netloom.plans.shared import materialize, new_path

# Folder and suffix of each product.
PRODUCTS = {
    "images": ".png", "spice": ".sp", "captions": ".txt", "descriptions": ".txt", "detection": ".json", "agents": ".json", "logs": ".log", "flows": ".md", "training": ".json",
}


def _system(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


def write_tree(products: DataFrame, folder: str, suffixes: dict[str, str] = PRODUCTS) -> DataFrame:
    """Write ``product, name, content`` rows as ``folder/product/name + suffix``; the paths written.

    Tasks write below a staging folder first, every attempt under a name of its own; which
    attempts count is told by the rows that they return.  Only when all tasks are done does a
    second job move the files to their places, each as a whole, and it may run
    again after a lost executor.  If a task fails for good, the staging
    folder goes and the tree is as before.  A file that is there already is
    replaced.  Names are taken as they are, ``/`` in them makes folders; two rows of one
    product and name are an error, as are a null or empty name, a product without
    a suffix and a name that leads out of the folder.  Null content gives an empty file.
    """
    spark = products.sparkSession
    target = folder.rstrip("/")
    # On the target's own file system, so that moving is renaming.
    staging = f"{target}/_staging-{uuid.uuid4().hex}"
    known = F.create_map(*[F.lit(x) for item in suffixes.items() for x in item])
    rows = products.select("product", "name", F.col("content").cast("binary").alias("content"), F.try_element_at(known, F.col("product")).alias("suffix"))
    bad = F.coalesce(F.col("suffix").isNull() | (F.trim("name") == "") | F.col("name").isNull() | F.col("name").rlike(r"(^|/)\.\.(/|$)|^/"), F.lit(True))
    wrong = rows.where(bad).select("product", "name").limit(1).collect()
    if wrong:
        raise ValueError(f"no place for product {wrong[0]['product']!r}, name {wrong[0]['name']!r}")
    twice = rows.groupBy("product", "name").count().where("count > 1").limit(1).collect()
    if twice:
        raise ValueError(f"two rows for {twice[0]['product']}/{twice[0]['name']}")

    def stage(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, root = _system(staging)
        attempt = uuid.uuid4().hex
        system.create_dir(f"{root}/{attempt}", recursive=True)
        count = 0
        for batch in batches:
            staged, finals = [], []
            for product, name, content, suffix in zip(*(c.to_pylist() for c in batch.columns)):
                staged.append(f"{attempt}/{count}")
                with system.open_output_stream(f"{root}/{staged[-1]}") as out:
                    out.write(content or b"")
                finals.append(f"{product}/{name}{suffix}")
                count += 1
            yield pa.RecordBatch.from_arrays([pa.array(staged, pa.string()), pa.array(finals, pa.string())], ["staged", "path"])

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        (system, root), (_, top) = _system(staging), _system(target)
        made = set()
        for batch in batches:
            for staged, path in zip(*(c.to_pylist() for c in batch.columns)):
                parent = f"{top}/{path}".rsplit("/", 1)[0]
                if parent not in made:
                    system.create_dir(parent, recursive=True)
                    made.add(parent)
                # A task that runs again finds what it has moved before in its place.
                if system.get_file_info(f"{root}/{staged}").type != fs.FileType.NotFound:
                    system.move(f"{root}/{staged}", f"{top}/{path}")
                elif system.get_file_info(f"{top}/{path}").type == fs.FileType.NotFound:
                    raise FileNotFoundError(f"{staged} for {path}")
            yield batch.select(["path"])

    try:
        written = materialize(rows.mapInArrow(stage, "staged string, path string"), "tree-staged")
        return materialize(written.mapInArrow(place, "path string"), "tree")
    finally:
        there = spark._jvm.org.apache.hadoop.fs.Path(staging)
        there.getFileSystem(spark._jsc.hadoopConfiguration()).delete(there, True)


def append_metrics(metrics: DataFrame, path: str, kind: str = "csv") -> None:
    """Append rows to the one file at ``path``: CSV with a header at its top only, or JSON lines.

    The file is written anew beside its place and renamed, so readers see the old or
    the new one.  Logs have a row for each epoch; appended rows come in the
    order of their columns.  Other columns than the file has are an error.
    """
    spark = metrics.sparkSession
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    place = jvm.org.apache.hadoop.fs.Path(path)
    system = place.getFileSystem(conf)
    columns = metrics.columns
    row = F.to_csv(F.struct(*columns)) if kind == "csv" else F.to_json(F.struct(*columns))
    at = F.monotonically_increasing_id().alias("at")
    ordered = metrics.orderBy(*columns).select(row.alias("value"), F.lit(1).alias("part"), at)
    head = ",".join(columns)
    if system.exists(place):
        old = spark.read.text(path)
        first = old.first()
        if kind == "csv" and first is not None and [c.strip() for c in first["value"].split(",")] != columns:
            raise ValueError(f"{path} has columns {first['value']}, not {head}")
    else:
        old = spark.createDataFrame([(head,)] if kind == "csv" else [], "value string")
    temporary = new_path(spark, "metrics")
    # One task writes a log, which is small: what is there, then what is new.
    lines = old.select("value", F.lit(0).alias("part"), at).unionAll(ordered)
    lines.repartition(1).sortWithinPartitions("part", "at").select("value").write.text(temporary)
    part = next(s.getPath() for s in system_of(spark, temporary).listStatus(jvm.org.apache.hadoop.fs.Path(temporary)) if s.getPath().getName().startswith("part-"))
    beside = jvm.org.apache.hadoop.fs.Path(f"{path}.{uuid.uuid4().hex}")
    if place.getParent() is not None:
        system.mkdirs(place.getParent())
    jvm.org.apache.hadoop.fs.FileUtil.copy(part.getFileSystem(conf), part, system, beside, True, conf)
    system.delete(place, False)
    system.rename(beside, place)


def system_of(spark, path: str):
    """Hadoop's file system of a path."""
    return spark._jvm.org.apache.hadoop.fs.Path(path).getFileSystem(spark._jsc.hadoopConfiguration())
