"""Scans that take a list, pattern, folder, file or manifest, and caches that notice changed files."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from netloom.plans.shared import discard, quoted
from netloom.sources.files import suffix

# Suffixes of images and of videos.
IMAGES = ("bmp", "dng", "jpeg", "jpg", "mpo", "png", "tif", "tiff", "webp", "pfm")
VIDEOS = ("asf", "avi", "gif", "m4v", "mkv", "mov", "mp4", "mpeg", "mpg", "ts", "wmv")
_FOUND = "path string, size bigint, modified timestamp"


def _status(spark: SparkSession, path: str):
    """Hadoop's status of the path, None where nothing is."""
    there = spark._jvm.org.apache.hadoop.fs.Path(path)
    system = there.getFileSystem(spark._jsc.hadoopConfiguration())
    return system.getFileStatus(there) if system.exists(there) else None


def _listed(spark: SparkSession, paths: list[str], recursive: bool) -> DataFrame:
    """Files of folders and patterns with sizes and times; many folders are listed by tasks, contents stay unread."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower())
    return reader.load(paths).select("path", F.col("length").alias("size"), F.col("modificationTime").alias("modified"))


def _lines(spark: SparkSession, manifest: str) -> DataFrame:
    """Lines of a manifest, ``./`` rebased to its folder."""
    parent = manifest.rsplit("/", 1)[0]
    return spark.read.text(manifest).select(F.regexp_replace(F.trim("value"), r"^\./", parent.replace("\\", "\\\\").replace("$", "\\$") + "/").alias("path")).where("path <> ''")


def scan_media(spark: SparkSession, sources: str | Sequence[str], images: tuple[str, ...] = IMAGES, videos: tuple[str, ...] = VIDEOS, recursive: bool = False) -> DataFrame:
    """``path, size, modified, kind`` of all media that the sources name, numbered by ``nth``: images first, then videos, each in path order.

    A source is a pattern (with ``*``, ``?`` or ``[``), a folder (its own files, with
    ``recursive`` all below), a file, or a ``.txt`` manifest with one such source on each line.
    Lines of a manifest that end like media are taken as files without
    a look, so a manifest may be of any length; only its lines for folders, patterns and further files
    come to the driver.  A source that is not there and sources without any
    media are errors.  A file that several sources name counts once; suffixes go
    by lower case; ``size`` and ``modified`` are null for lines of manifests.
    """
    media = (*images, *videos)
    parts: list[DataFrame] = []
    folders: list[str] = []
    pending = [sources] if isinstance(sources, str) else list(sources)
    for source in pending:
        if any(c in source for c in "*?["):
            # A pattern that matches nothing is an empty source, as in a shell.
            if spark._jvm.org.apache.hadoop.fs.Path(source).getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(spark._jvm.org.apache.hadoop.fs.Path(source)):
                folders.append(source)
            continue
        status = _status(spark, source)
        if status is None:
            raise FileNotFoundError(f"{source} does not exist")
        if status.isDirectory() or not source.lower().endswith(".txt"):
            folders.append(source)
            continue
        lines = _lines(spark, source)
        plain = ~F.col("path").rlike(r"[*?\[]") & suffix(F.col("path")).isin(*media)
        parts.append(lines.where(plain).select("path", F.lit(None).cast("bigint").alias("size"), F.lit(None).cast("timestamp").alias("modified")))
        pending.extend(r["path"] for r in lines.where(~plain).distinct().toLocalIterator() if r["path"] != source and r["path"] not in pending)
    if folders:
        parts.append(_listed(spark, folders, recursive))
    found = spark.createDataFrame([], _FOUND)
    for part in parts:
        found = found.unionAll(part)
    # Spark's listing names the file system, a manifest need not.
    found = found.withColumn("path", F.regexp_replace("path", r"^file:/+", "/"))
    kind = F.when(suffix(F.col("path")).isin(*images), "image").when(suffix(F.col("path")).isin(*videos), "video")
    found = found.withColumn("kind", kind).where("kind is not null").groupBy("path", "kind").agg(F.max("size").alias("size"), F.max("modified").alias("modified"))
    if found.isEmpty():
        raise FileNotFoundError(f"no images or videos in {sources}")
    from netloom.operators.ordering import numbered

    return numbered(found, ["kind", "path"])


def fileset_key(files: DataFrame, version: str = "") -> str:
    """Digest of a set of files by path, size and time, whatever their order, summed up in tasks; null values count too."""
    each = F.xxhash64(*[F.coalesce(F.col(quoted(c)).cast("string"), F.lit("-")) for c in files.columns])
    low = F.sum(F.pmod(each, F.lit(1 << 31)))
    found = files.agg(F.count("*").alias("n"), F.coalesce(F.bit_xor(each), F.lit(0)).alias("x"), F.coalesce(low, F.lit(0)).alias("s")).first()
    import hashlib

    return hashlib.sha256(f"{version}|{sorted(files.columns)}|{found['n']}|{found['x']}|{found['s']}".encode()).hexdigest()[:32]


def cached_by_content(files: DataFrame, folder: str, make: Callable[[], DataFrame], version: str = "") -> DataFrame:
    """The table that ``make`` gives for these files, written below ``folder`` once for each state of them.

    The key is :func:`fileset_key` of ``files`` (such as :func:`scan_media` gives) and
    the ``version`` of the code behind ``make``; tables of other keys are removed when a
    new one is whole.  A write that did not end leaves no table that counts.
    """
    spark = files.sparkSession
    path = f"{folder.rstrip('/')}/{fileset_key(files, version)}"
    if _status(spark, f"{path}/_SUCCESS") is None:
        make().write.mode("overwrite").parquet(path)
        there = spark._jvm.org.apache.hadoop.fs.Path(folder)
        system = there.getFileSystem(spark._jsc.hadoopConfiguration())
        for status in system.listStatus(there):
            if status.getPath().getName() != path.rsplit("/", 1)[1]:
                old = spark.range(0)
                old.netloom_path = status.getPath().toString()
                discard(old)
    return spark.read.parquet(path)
