"""Row numbers in a total order without one task for all rows."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, FloatType, LongType, StructField, StructType

from netloom.plans.shared import materialize, quoted


def _free(rows: DataFrame, *names: str) -> list[str]:
    """``names`` with as many underscores before them as keep them apart from the columns of ``rows``."""
    held = {c.lower() for c in rows.columns}
    while held & set(names):
        names = tuple(f"_{n}" for n in names)
    return list(names)


def codes(column: pa.Array) -> np.ndarray:
    """Equal numbers for neighbours that are equal; nulls are equal to each other."""
    try:
        return column.dictionary_encode(null_encoding="encode").indices.to_numpy()
    except pa.ArrowNotImplementedError:
        values = column.to_pylist()
        return np.cumsum([0, *(a != b for a, b in zip(values, values[1:]))])[: len(values)]


def whole_groups(batches: Iterator[pa.RecordBatch], rows: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    """Whole groups of at most ``rows`` rows together, or one that has more, with the number of each row's group; rows come by group, which the first column tells."""

    def parted(parts: list[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
        whole = parts[0] if len(parts) == 1 else pa.RecordBatch.from_arrays([pa.concat_arrays([p.column(i) for p in parts]) for i in range(parts[0].num_columns)], parts[0].schema.names)
        group = np.cumsum(np.diff(codes(whole.column(0)), prepend=0) != 0)
        cuts, start = np.append(np.flatnonzero(np.diff(group, prepend=-1))[1:], whole.num_rows), 0
        while start < whole.num_rows:
            stop = int(cuts[max(np.searchsorted(cuts, start + rows, "right") - 1, np.searchsorted(cuts, start, "right"))])
            yield whole.slice(start, stop - start), group[start:stop] - group[start]
            start = stop

    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        # All groups but the last one are complete; that may have ended with the batch before.
        ids = pa.concat_arrays([held[-1].column(0)[-1:], batch.column(0)]) if held else batch.column(0)
        fresh = np.flatnonzero(np.diff(codes(ids))) + (0 if held else 1)
        if len(fresh):
            cut = int(fresh[-1])
            yield from parted([*held, batch.slice(0, cut)])
            held, batch = [], batch.slice(cut)
        held.append(batch)
    if held:
        yield from parted(held)


def _inside(keys: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Add each row's number in its group and in its task; rows are sorted and begin with ``keys`` group columns."""

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, begun, last = 0, 0, None
        for batch in batches:
            if not batch.num_rows:
                continue
            n, columns = batch.num_rows, batch.columns
            fresh = np.zeros(n, bool)
            for k in range(keys):
                fresh |= np.diff(codes(columns[k] if last is None else pa.concat_arrays([last[k], columns[k]])), prepend=0)[-n:] != 0
            places = seen + np.arange(n)
            starts = np.maximum.accumulate(np.where(fresh, places, begun))
            yield pa.RecordBatch.from_arrays([*columns[keys:], pa.array(places - starts), pa.array(places)], [*batch.schema.names[keys:], "row", "place"])
            seen, begun, last = seen + n, int(starts[-1]), [c.slice(n - 1) for c in columns[:keys]]

    return number


def placed(rows: DataFrame, groups: list[str], order: list[str | Column], name: str = "nth", size: str | None = None) -> DataFrame:
    """``rows`` with their number from 0 in ``order`` inside their group, and with the group's rows as ``size`` if asked for.

    Rows are cut into ranges of groups and order, sorted, numbered and written once.  A group
    goes on in the next range only as its first group, so one number for each range
    is added, and neither a large group nor many equal keys meet in one task.  Rows of equal order
    are numbered in the order in which they came; null groups are one group.
    A caller that has written what it needs may ``discard`` the result.
    """
    by = [F.col(quoted(c)).asc_nulls_first() for c in groups] + [F.col(quoted(c)) if isinstance(c, str) else c for c in order]
    tie, part, row, place, total, at = _free(rows, "tie_", "range_", "row_", "place_", "total_", "at_")
    parts = rows.sparkSession.conf.get("spark.sql.shuffle.partitions")
    told = rows.withColumn(tie, F.monotonically_increasing_id())
    cut = told.repartitionByRange(int(parts), *by, F.col(tie)).sortWithinPartitions(*by, F.col(tie)).withColumn(part, F.spark_partition_id())
    kept = [c for c in cut.columns if c != tie]
    # Negative zero is zero in groups.
    key = lambda c: F.col(quoted(c)) + F.lit(0.0).cast(rows.schema[c].dataType) if isinstance(rows.schema[c].dataType, (FloatType, DoubleType)) else F.col(quoted(c))
    sent = cut.select(*[key(c).alias(f"k{i}") for i, c in enumerate(groups)], *[F.col(quoted(c)).alias(f"c{i}") for i, c in enumerate(kept)])
    told_apart = StructType([*sent.schema.fields[len(groups) :], StructField("row", LongType()), StructField("place", LongType())])
    ranged = materialize(sent.mapInArrow(_inside(len(groups)), told_apart).toDF(*kept, row, place), "ranges")
    # The first and the last group of each range, and the rows of the last one there.
    group = F.struct(*[F.col(quoted(c)).alias(f"g{i}") for i, c in enumerate(groups)], F.lit(0).alias("g"))
    ends = ranged.groupBy(F.col(part).alias(at)).agg(F.min_by(group, place).alias("first"), F.max_by(group, place).alias("last"), F.max_by(F.col(row), place).alias("rows"))
    asked = ends.select(at, F.col("first").alias("g"), F.lit(0).cast("long").alias("rows"), F.lit(True).alias("asks"))
    both = asked.union(ends.select(at, F.col("last").alias("g"), F.col("rows") + 1, F.lit(False)))
    before = Window.partitionBy("g").orderBy(at).rangeBetween(Window.unboundedPreceding, -1)
    firsts = both.withColumn("rows", F.coalesce(F.sum("rows").over(before), F.lit(0))).where("asks").select(at, F.col("rows").alias(total))
    joined = ranged.join(F.broadcast(firsts), F.col(part) == F.col(at))
    nth = F.col(row) + F.when(F.col(row) == F.col(place), F.col(total)).otherwise(0)
    found = joined.select(*[F.col(quoted(c)) for c in rows.columns if c not in (name, size)], nth.alias(name))
    if not size:
        found.netloom_path = ranged.netloom_path
        return found
    keys = _free(found, *[f"group_{i}" for i in range(len(groups))])
    counts = ranged.groupBy(*[F.col(quoted(c)).alias(k) for c, k in zip(groups, keys)]).agg(F.count("*").alias(size))
    on = F.lit(True)
    for c, k in zip(groups, keys):
        on = on & F.col(quoted(c)).eqNullSafe(F.col(k))
    sized = found.join(counts, on).drop(*keys)
    sized.netloom_path = ranged.netloom_path
    return sized


def numbered(rows: DataFrame, order: list[str | Column], name: str = "nth") -> DataFrame:
    """``rows`` with their number from 0 in ``order``; a column of that name gives way to it."""
    return placed(rows, [], order, name)


def seeded(key: str, seed: int) -> Column:
    """A fixed shuffle of keys: the order of the MD5 of seed and key, the same on every engine and in every run."""
    return F.md5(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string")).cast("binary"))


def worker_seed(seed: int, worker: Column) -> Column:
    """Seed of one worker, under 2 ** 32, from the common one."""
    return F.pmod(F.lit(seed) + worker, F.lit(1 << 32))


def split_by_order(rows: DataFrame, order: list[str | Column], train: float = 0.8, val: float = 0.1) -> DataFrame:
    """Cut rows in order at floor(train * n), then floor(val * n) more, the rest is ``test``."""
    found = numbered(rows, order)
    n = rows.agg(F.count("*").alias("n"))
    placed = found.crossJoin(F.broadcast(n))
    first, second = F.floor(F.col("n") * train), F.floor(F.col("n") * val)
    return placed.withColumn("split", F.when(F.col("nth") < first, "train").when(F.col("nth") < first + second, "val").otherwise("test")).drop("n", "nth")


def rank_shards(rows: DataFrame, order: list[str | Column], world: int) -> DataFrame:
    """Deal rows in order to ``world`` shards in turn; the first rows come again until all are equally long."""
    found = numbered(rows, order).crossJoin(F.broadcast(rows.agg(F.count("*").alias("n"))))
    again = found.where(F.col("nth") < F.pmod(-F.col("n"), F.lit(world))).withColumn("nth", F.col("nth") + F.col("n"))
    return found.unionByName(again).withColumn("shard", F.col("nth") % world).drop("n", "nth")


def aspect_batches(images: DataFrame, size: int) -> DataFrame:
    """Batches of ``size`` images by aspect ratio ``ar`` = height / width, with the shape that each batch is padded to.

    Height is the largest ratio where all are under 1, width the inverse of the
    smallest where all are over 1, else 1.
    """
    batches = numbered(images, ["ar", "image_id"]).withColumn("batch", F.floor(F.col("nth") / size))
    low, high = F.min("ar"), F.max("ar")
    return batches.groupBy("batch").agg(F.when(high < 1, high).otherwise(1.0).alias("shape_h"), F.when(low > 1, 1 / low).otherwise(1.0).alias("shape_w"), F.count("*").alias("images"))
