"""Streams: frame files, latest frame by source, micro-batch statistics, keyed loss state."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from threading import Thread

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery, StreamingQueryListener
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from netloom.plans.shared import new_path


def frame_stream(spark: SparkSession, path: str, files_a_batch: int = 1) -> DataFrame:
    """Stream of a Parquet folder's files, or of one file, a bounded number of them in each micro-batch."""
    schema = spark.read.parquet(path).schema
    reader = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_a_batch)
    there = spark._jvm.org.apache.hadoop.fs.Path(path)
    if there.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(there).isDirectory():
        return reader.parquet(path)
    folder, name = path.rsplit("/", 1)
    return reader.option("pathGlobFilter", name).parquet(folder)


def run_to_end(stream: DataFrame, mode: str = "complete") -> DataFrame:
    """Run a stream over all that is there and return its final table from the shared folder."""
    spark = stream.sparkSession
    target, check = new_path(spark, "stream"), new_path(spark, "stream-check")
    if mode == "append":
        query = stream.writeStream.outputMode(mode).option("checkpointLocation", check).format("parquet").option("path", target).trigger(availableNow=True).start()
        query.awaitTermination()
        return spark.read.schema(stream.schema).parquet(target)

    def save(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(target)

    query: StreamingQuery = stream.writeStream.outputMode(mode).option("checkpointLocation", check).trigger(availableNow=True).foreachBatch(save).start()
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(target)


def latest_by_source(frames: DataFrame) -> DataFrame:
    """Newest value of each source; unread older frames are dropped."""
    newest = F.max_by(F.struct("ts", "event_id", "value"), F.struct("ts", "event_id"))
    return frames.groupBy("event_type").agg(newest.alias("f")).select("event_type", "f.ts", "f.event_id", "f.value")


def running_stats(frames: DataFrame) -> DataFrame:
    """Counters of a batch run, kept up as micro-batches arrive."""
    return frames.groupBy("event_type").agg(F.count("*").alias("n"), F.sum(F.when(F.col("value") >= 50, 1).otherwise(0)).cast("long").alias("passed"), F.round(F.sum("value"), 4).alias("total"))


#: Newest losses of a sample that its state holds one by one; what comes before the last of them weighs less than 1e-46.
NEWEST = 1024


def keyed_ema(losses: DataFrame, decay: float = 0.9) -> DataFrame:
    """Loss state of each sample as a stream: EMA, times and epoch survive restarts in the state store.

    Losses count in order of time and event, whatever order files and batches bring them
    in, nulls last: the state holds the newest ``keep`` in order, and those before them as one value.
    ``keep`` is ``NEWEST``, or more where ``decay`` is slower.  A loss that comes
    after newer ones were folded into that value counts as the newest of the folded; its place
    among them changes the EMA by at most its difference from them times ``decay ** keep``, under 1e-46.
    """
    keep = max(NEWEST, math.ceil(NEWEST * math.log(0.9) / math.log(decay))) if 0 < decay < 1 else NEWEST

    def update(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        value, folded, *held = state.get if state.exists else (0.0, 0, [], [], [])
        rows = sorted([*zip(*held), *(r for frame in frames for r in zip(frame["at"].tolist(), frame["event_id"].tolist(), frame["loss"].tolist()))], key=lambda r: r[:2])

        def on(value: float, times: int, part: list[tuple]) -> tuple[float, int]:
            for _, _, loss in part:
                value = decay * value + (1 - decay) * loss if times else loss
                times += 1
            return value, times

        old, rows = rows[: max(len(rows) - keep, 0)], rows[max(len(rows) - keep, 0) :]
        value, folded = on(value, folded, old)
        ema, times = on(value, folded, rows)
        state.update((value, folded, *([r[i] for r in rows] for i in range(3))))
        yield pd.DataFrame({"sample_id": [key[0]], "ema": [ema], "times": [times]})

    last = F.lit((1 << 63) - 1)
    told = losses.select("sample_id", F.coalesce(F.unix_micros(F.col("ts").cast("timestamp")), last).alias("at"), F.coalesce("event_id", last).alias("event_id"), "loss")
    held = "value double, folded long, at array<long>, event_id array<long>, loss array<double>"
    return told.groupBy("sample_id").applyInPandasWithState(update, "sample_id long, ema double, times long", held, "append", GroupStateTimeout.NoTimeout)


class Hooks:
    """Named hooks that a stream's micro-batches, or Spark's own reports of streams, run in order of registration."""

    # Names of the hooks.
    NAMES = (
        "on_pretrain_routine_start on_pretrain_routine_end on_train_start on_train_epoch_start on_train_batch_start optimizer_step on_before_zero_grad on_train_batch_end on_train_epoch_end "
        "on_val_start on_val_batch_start on_val_image_end on_val_batch_end on_val_end on_fit_epoch_end on_model_save on_train_end on_params_update teardown"
    ).split()

    def __init__(self):
        self.actions: dict[str, list[tuple[str, Callable]]] = {n: [] for n in self.NAMES}

    def register(self, hook: str, action: Callable, name: str = "") -> None:
        """Add an action; unknown hooks and things that cannot be called are errors."""
        if hook not in self.actions or not callable(action):
            raise ValueError(f"no hook {hook} for {action}")
        self.actions[hook].append((name, action))

    def registered(self, hook: str | None = None) -> dict[str, list[str]] | list[str]:
        """Names of the actions of one hook, or of all."""
        names = {h: [n for n, _ in found] for h, found in self.actions.items()}
        return names if hook is None else names[hook]

    def run(self, hook: str, *args, thread: bool = False, **kwargs) -> list[Thread]:
        """Run a hook's actions, each in a thread of its own if asked for; the threads."""
        if hook not in self.actions:
            raise ValueError(f"no hook {hook}")
        threads = []
        for _, action in self.actions[hook]:
            if thread:
                threads.append(Thread(target=action, args=args, kwargs=kwargs, daemon=True))
                threads[-1].start()
            else:
                action(*args, **kwargs)
        return threads

    def sink(self, hook: str = "on_train_batch_end") -> Callable[[DataFrame, int], None]:
        """A ``foreachBatch`` function that runs a hook with each micro-batch."""
        return lambda batch, number: self.run(hook, batch, number)

    def listener(self, thread: bool = False) -> StreamingQueryListener:
        """A listener for ``spark.streams.addListener``: start, each batch and end of every stream run their hooks.

        ``on_train_start`` gets the query's id, ``on_train_batch_end`` the number of the
        batch and its count of rows, ``on_train_end`` the query's id and its error if it
        has one, then ``teardown`` nothing.  Batches without rows are reported too.
        """
        hooks = self

        class Listener(StreamingQueryListener):
            def onQueryStarted(self, event) -> None:
                hooks.run("on_train_start", str(event.id), thread=thread)

            def onQueryProgress(self, event) -> None:
                hooks.run("on_train_batch_end", event.progress.batchId, event.progress.numInputRows, thread=thread)

            def onQueryIdle(self, event) -> None:
                pass

            def onQueryTerminated(self, event) -> None:
                hooks.run("on_train_end", str(event.id), event.exception, thread=thread)
                hooks.run("teardown", thread=thread)

        return Listener()
