"""Materialisation in the folder that the driver and all executors share.

``spark.checkpoint.dir`` names that folder on a cluster.  Where it is unset, as
in local tests, one temporary folder per session is made and registered.
Writing a table there cuts lineage: a lost executor costs a re-read, not a
recomputation, and nothing lives only on an executor's own disk.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """Return the shared folder, making one only where none is configured."""
    context = spark.sparkContext
    named = context.getConf().get("spark.checkpoint.dir") or context.getCheckpointDir()
    if not named:
        context.setCheckpointDir(tempfile.mkdtemp(prefix="netloom-"))
        named = context.getCheckpointDir()
    return named.rstrip("/")


def quoted(column: str) -> str:
    """A column's name as the DataFrame API reads it, whatever characters it has."""
    return f"`{column.replace('`', '``')}`"


def new_path(spark: SparkSession, name: str) -> str:
    """Return an unused path for an intermediate table."""
    return f"{shared_dir(spark)}/netloom/{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and return the table read back."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.parquet(path)
    table = spark.read.schema(df.schema).parquet(path)
    table.netloom_path = path
    return table


def discard(table: DataFrame) -> None:
    """Delete a table made by :func:`materialize` that nothing needs any more."""
    spark = table.sparkSession
    path = spark._jvm.org.apache.hadoop.fs.Path(table.netloom_path)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def steady(df: DataFrame, name: str) -> DataFrame:
    """``df`` itself where every reading gives the same rows in the same partitions, else a written copy.

    That holds for columns and filters over files.  Behind an exchange, a task
    that runs again after a lost executor may get its rows in another order.
    """
    nodes = df._jdf.queryExecution().optimizedPlan().toString().splitlines()
    plain = all(line.lstrip(" :+-").split(" ")[0] in ("Project", "Filter", "Relation") for line in nodes)
    return df if plain else materialize(df, name)


#: Estimates from here on say that the size is unknown.
UNKNOWN_BYTES = 1 << 53
#: Bytes of files, by the optimizer's estimate, for each partition of an exchange.
PART_BYTES = 16 << 20


def plan_bytes(df: DataFrame, column: str) -> int:
    """Size of ``df`` for choosing a number of partitions.

    The optimizer's estimate is free and grows with the files that are read;
    where it knows none, the bytes of ``column`` are summed.
    """
    known = int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    if known < UNKNOWN_BYTES:
        return known
    return df.agg(F.sum(F.octet_length(column)).alias("n")).first()["n"] or 0


def partitions(df: DataFrame) -> int:
    """Number of partitions for an exchange of ``df``: the session's, or more where its estimated size asks for more, so that tasks do not grow with the input."""
    least = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    known = int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    return max(least, known // PART_BYTES) if known < UNKNOWN_BYTES else least
