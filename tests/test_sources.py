"""Media scans, caches, product trees, live sources, hooks and versions."""

from __future__ import annotations

import json
import os
import random
import sys
import time

import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F

from netloom.functions import text as T
from netloom.sources import media, products
from netloom.sources.files import trimmed_csv
from netloom.streaming import frames
from netloom.streaming.frames import Hooks
from netloom.streaming.live import LiveReader, live_source

# Workers do not import this file.
cloudpickle.register_pickle_by_value(sys.modules[__name__])


@pytest.fixture
def tree(tmp_path):
    for name in ("a/1.JPG", "a/2.png", "a/x.mp4", "a/notes.md", "a/deep/3.bmp", "b/4.jpeg", "b/5.Mov", "with $1/6.png"):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text(name)
    (tmp_path / "with $1/list.txt").write_text(f"./6.png\n\n  {tmp_path}/b  \n{tmp_path}/a/deep/*.bmp\n/gone/7.png\n{tmp_path}/with $1/list.txt\n")
    return tmp_path


def test_scan_of_all_forms(spark, tree):
    def found(sources, **more):
        rows = media.scan_media(spark, sources, **more).collect()
        assert [r.nth for r in sorted(rows, key=lambda r: r.nth)] == list(range(len(rows)))
        return [r.path.replace(str(tree), "") for r in sorted(rows, key=lambda r: r.nth)]

    assert found(f"{tree}/a") == ["/a/1.JPG", "/a/2.png", "/a/x.mp4"]
    assert found(f"{tree}/a", recursive=True) == ["/a/1.JPG", "/a/2.png", "/a/deep/3.bmp", "/a/x.mp4"]
    assert found(f"{tree}/*/*.png") == ["/a/2.png", "/with $1/6.png"]
    assert found(f"{tree}/b/4.jpeg") == ["/b/4.jpeg"]
    assert found(f"{tree}/with $1/list.txt") == ["/gone/7.png", "/a/deep/3.bmp", "/b/4.jpeg", "/with $1/6.png", "/b/5.Mov"]
    # A list; what two of its sources name counts once.
    assert found([f"{tree}/b", f"{tree}/a/*.png", f"{tree}/a/2.png"]) == ["/a/2.png", "/b/4.jpeg", "/b/5.Mov"]
    for wrong in (f"{tree}/none", f"{tree}/none/*.png", [f"{tree}/a/notes.md"], []):
        with pytest.raises(FileNotFoundError):
            media.scan_media(spark, wrong)
    sized = media.scan_media(spark, f"{tree}/a").where("size is not null and modified is not null")
    assert sized.count() == 3


def test_cache_follows_contents(spark, tree):
    calls = []

    def rows(version="1"):
        files = media.scan_media(spark, f"{tree}/a").select("path", "size", "modified")
        return media.cached_by_content(files, f"{tree}/cache", lambda: calls.append(1) or files.select("path", "size"), version)

    assert rows().count() == rows().count() == 3 and len(calls) == 1
    # A changed file, a new one, another version of the code, and a write that did not end.
    (tree / "a/2.png").write_text("longer than before")
    assert max(r.size for r in rows().collect()) == 18 and len(calls) == 2
    (tree / "a/8.png").write_text("new")
    assert rows().count() == 4 and len(calls) == 3
    assert rows("2").count() == 4 and len(calls) == 4
    (kept,) = (p for p in (tree / "cache").iterdir())
    os.remove(kept / "_SUCCESS")
    assert rows("2").count() == 4 and len(calls) == 5
    shuffled = spark.createDataFrame([(k, k) for k in range(50)], "a int, b int")
    assert media.fileset_key(shuffled) == media.fileset_key(shuffled.repartition(7).orderBy(F.desc("a"))) != media.fileset_key(shuffled.where("a > 0"))
    assert media.fileset_key(shuffled.limit(0)) == media.fileset_key(shuffled.where("a < 0"))


def files_below(folder):
    return {os.path.relpath(os.path.join(d, f), folder): open(os.path.join(d, f)).read() for d, _, names in os.walk(folder) for f in names if not f.endswith(".crc")}


def test_product_tree(spark, tmp_path):
    rows = [(p, f"{n}" if p != "agents" else f"stage{n % 2}/{n}", f"{p} {n}") for p in ("spice", "captions", "agents") for n in range(20)]
    schema = "product string, name string, content string"
    out = products.write_tree(spark.createDataFrame(rows, schema).repartition(5), f"{tmp_path}/tree")
    want = {f"{p}/{n}{products.PRODUCTS[p]}": c for p, n, c in rows}
    assert {r.path for r in out.collect()} == set(want) and files_below(tmp_path / "tree") == want
    # Written again: replaced as a whole; null is an empty file.
    products.write_tree(spark.createDataFrame([("spice", "3", "new"), ("logs", "3", None)], schema), f"{tmp_path}/tree")
    want |= {"spice/3.sp": "new", "logs/3.log": ""}
    assert files_below(tmp_path / "tree") == want and sorted(os.listdir(tmp_path / "tree")) == ["agents", "captions", "logs", "spice"]

    # A task that fails after others have written leaves the tree as it was.
    def breaks(batches):
        for batch in batches:
            yield batch
            if "bad" in batch.column(1).to_pylist():
                raise RuntimeError("task lost")

    many = spark.createDataFrame([("spice", f"x{n}" if n != 37 else "bad", "partial") for n in range(40)], schema).repartition(6)
    with pytest.raises(Exception, match="task lost"):
        products.write_tree(many.mapInArrow(breaks, schema), f"{tmp_path}/tree")
    assert files_below(tmp_path / "tree") == want and not [n for n in os.listdir(tmp_path / "tree") if n.startswith("_")]
    for wrong in ([("spice", "../up", "x")], [("nothing", "a", "x")], [("spice", None, "x")], [("spice", " ", "x")], [(None, "a", "x")], [("spice", "a", "x"), ("spice", "a", "y")]):
        with pytest.raises(ValueError):
            products.write_tree(spark.createDataFrame(wrong, schema), f"{tmp_path}/tree")
    assert products.write_tree(spark.createDataFrame([], schema), f"{tmp_path}/tree").count() == 0


def test_metrics_have_one_header(spark, tmp_path):
    epoch = lambda *rows: spark.createDataFrame(list(rows), "epoch int, map double, note string")
    path = f"{tmp_path}/run/results.csv"
    for rows in ([(1, 0.5, "a,b")], [(3, 0.7, None), (2, 0.6, "c")]):
        products.append_metrics(epoch(*rows), path)
        products.append_metrics(epoch(*rows), f"{tmp_path}/run/results.ndjson", "json")
    assert open(path).read().splitlines() == ["epoch,map,note", '1,0.5,"a,b"', "2,0.6,c", "3,0.7,"]
    assert trimmed_csv(spark, path).count() == 3
    assert [json.loads(x)["epoch"] for x in open(f"{tmp_path}/run/results.ndjson")] == [1, 2, 3]
    with pytest.raises(ValueError):
        products.append_metrics(epoch((4, 0.1, "x")).drop("note"), path)


class Recorded:
    """A source that lives in a folder: a file with the session's name, one with a frame on each line."""

    def __init__(self, folder):
        self.folder = folder
        self.place()

    def _lines(self):
        with open(f"{self.folder}/frames") as f:
            return f.read().splitlines()

    def place(self):
        with open(f"{self.folder}/session") as f:
            return f.read(), len(self._lines())

    def frames(self, session, low, high):
        assert self.place()[0] == session
        yield from ((n, float(n), line) for n, line in enumerate(self._lines()[low:high], low))


def write_source(folder, session, frames):
    os.makedirs(folder, exist_ok=True)
    for name, text in (("session", session), ("frames", "".join(f"{session}{n}\n" for n in range(frames)))):
        with open(f"{folder}/{name}", "w") as f:
            f.write(text)


def test_live_sources_that_go_and_come_back(spark, tmp_path):
    a, b, late = (str(tmp_path / n) for n in ("a", "b", "late"))
    write_source(a, "s", 3), write_source(b, "t", 2)
    spark.dataSource.register(live_source(Recorded))

    def run():
        stream = spark.readStream.format("live_frames").option("sources", json.dumps([a, b, late, a])).load()
        query = stream.writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/check").trigger(processingTime="200 milliseconds").start()
        return query

    def frames():
        if not os.path.exists(f"{tmp_path}/out/_spark_metadata"):
            return []
        return sorted((os.path.basename(r.source), r.content) for r in spark.read.schema("source string, session string, frame bigint, time double, content string").parquet(f"{tmp_path}/out").collect())

    def until(want):
        end = time.time() + 90
        while frames() != sorted(want) and time.time() < end:
            time.sleep(0.5)
        assert frames() == sorted(want)

    query = run()
    want = [("a", f"s{n}") for n in range(3)] + [("b", f"t{n}") for n in range(2)]
    until(want)
    # One source is lost while the other goes on, and comes back in the same session.
    os.rename(a, a + "-away")
    write_source(b, "t", 4)
    want += [("b", "t2"), ("b", "t3")]
    until(want)
    write_source(a + "-away", "s", 5)
    os.rename(a + "-away", a)
    want += [("a", "s3"), ("a", "s4")]
    until(want)
    # It restarts: a new session begins with its first frame.
    write_source(a, "u", 1)
    want.append(("a", "u0"))
    until(want)
    # The query itself ends and starts again; a source that was never there is joined where it is.
    query.stop()
    write_source(b, "t", 6), write_source(late, "v", 4)
    query = run()
    want += [("b", "t4"), ("b", "t5")]
    until(want)
    write_source(late, "v", 6)
    want += [("late", "v4"), ("late", "v5")]
    until(want)
    query.stop()


def test_live_offsets(tmp_path):
    a, b = str(tmp_path / "a"), str(tmp_path / "b")
    write_source(a, "s", 10)
    reader = LiveReader(Recorded, [a, b], newest_only=True, stride=3)
    assert reader.initialOffset() == {a: ["s", 0], b: None}
    end = reader.latestOffset()
    assert end == {a: ["s", 10], b: None}
    (part,) = reader.partitions({a: ["s", 0], b: None}, end)
    assert [r[2] for r in reader.read(part)] == [8]
    assert reader.partitions(end, end) == [] and reader.partitions({}, {}) == []
    os.remove(f"{a}/session")
    assert reader.latestOffset() == end
    every = LiveReader(Recorded, [a], False, 3)
    write_source(a, "s", 10)
    (part,) = every.partitions({a: ["s", 2]}, {a: ["s", 10]})
    assert [r[2] for r in every.read(part)] == [2, 5, 8]


def test_hooks_of_a_stream(spark, tmp_path):
    """Spark's reports of a stream run the hooks in order; threads run beside."""
    spark.range(30).repartition(3).write.parquet(f"{tmp_path}/in")
    hooks, seen = Hooks(), []
    for name in ("on_train_start", "on_train_batch_end", "on_train_end", "teardown"):
        hooks.register(name, lambda *a, name=name: seen.append((name, a)), f"note {name}")
    assert hooks.registered("teardown") == ["note teardown"] and hooks.registered()["on_val_end"] == []
    listener = hooks.listener()
    spark.streams.addListener(listener)
    try:
        stream = spark.readStream.schema("id long").option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
        query = stream.writeStream.format("noop").option("checkpointLocation", f"{tmp_path}/check").trigger(availableNow=True).start()
        query.awaitTermination()
        end = time.time() + 30
        while ("teardown", ()) not in seen and time.time() < end:
            time.sleep(0.2)
    finally:
        spark.streams.removeListener(listener)
    names = [n for n, _ in seen]
    assert names[0] == "on_train_start" and names[-2:] == ["on_train_end", "teardown"] and set(names[1:-2]) == {"on_train_batch_end"}
    assert sum(a[1] for n, a in seen if n == "on_train_batch_end") == 30 and seen[0][1] == (str(query.id),) == seen[-2][1][:1] and seen[-2][1][1] is None
    done = []
    hooks.register("on_val_end", lambda x: done.append(x))
    for thread in hooks.run("on_val_end", 5, thread=True):
        thread.join()
    assert done == [5]
    for wrong in (lambda: hooks.run("no_hook"), lambda: hooks.register("teardown", 3), lambda: hooks.register("no_hook", print)):
        with pytest.raises(ValueError):
            wrong()


# Versions from the oldest to the newest; equal ones together.
VERSIONS = [
    ["0.9"], ["1.0.dev1"], ["1.0a1.dev3"], ["1.0a1", "1.0.alpha1", "1.0-A.1"], ["1.0a2"], ["1.0b1", "1.0beta1"], ["1.0rc1", "1.0c1", "1.0preview1", "v1.0-pre1"], ["1.0rc2.dev4"], ["1.0rc2"], ["1.0rc2.post1"],
    ["1", "1.0", "1.0.0", " v1.0 ", "0!1"], ["1.0+abc"], ["1.0+abc.5"], ["1.0+abc.10"], ["1.0+5"], ["1.0.post0.dev2"], ["1.0.post0", "1.0post", "1.0-0", "1.0.r0"], ["1.0.post2", "1-2"], ["1.0.1"], ["1.2"], ["1.10"], ["2!0.1"],
]


def test_version_order(spark):
    flat = [(i, v) for i, same in enumerate(VERSIONS) for v in same]
    random.Random(2).shuffle(flat)
    got = spark.createDataFrame(flat, "place int, version string").withColumn("key", T.version_key(F.col("version"))).orderBy("key").collect()
    assert [r.place for r in got] == sorted(p for p, _ in flat)
    assert len({str(r.key) for r in got}) == len(VERSIONS)
    wrong = spark.createDataFrame([("x",), ("1..2",), ("",), (None,)], "v string")
    assert [r.k for r in wrong.select(T.version_key(F.col("v")).alias("k")).collect()] == [None] * 4
    pairs = spark.createDataFrame([("3.8.1", "3.8.0"), ("3.7", "3.8.0"), ("3.8", "3.8.0"), ("x", "1")], "a string, b string")
    assert [tuple(r) for r in pairs.select(T.meets_version(F.col("a"), F.col("b")), T.meets_version(F.col("a"), F.col("b"), True)).collect()] == [(True, False), (False, False), (True, True), (None, None)]


def test_text_checks(spark):
    rows = spark.createDataFrame([("plain",), ("naïve",), ("人",), ("",), ("a/b.PT",), ("a.x/b",), ("w.zip",), (".pt",)], "t string")
    got = rows.select(T.is_ascii(F.col("t")), T.has_chinese(F.col("t")), T.has_suffix(F.col("t"), (".pt",))).collect()
    assert [tuple(r) for r in got] == [(True, False, True), (False, False, True), (False, True, True), (True, False, True), (True, False, True), (True, False, True), (True, False, False), (True, False, True)]


def test_keyed_ema_in_order_of_time(spark, tmp_path):
    """Files that bring a sample's losses out of order, in several Arrow batches, and beyond what a state holds one by one."""
    many = [(k * 7919 % 1500, k % 3) for k in range(1500)]
    for n in range(3):
        rows = [(e, 1_000_000 * (e // 2), 5, float(e % 97)) for e, part in many if part == n]
        df = spark.createDataFrame(rows, "event_id long, at long, sample_id long, loss double")
        df.select("event_id", F.timestamp_micros("at").alias("ts"), "sample_id", "loss").coalesce(1).write.mode("append").parquet(str(tmp_path / "losses"))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "100")
    try:
        done = frames.run_to_end(frames.keyed_ema(frames.frame_stream(spark, str(tmp_path / "losses"))), "append")
        got = done.orderBy(F.desc("times")).first()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    want = 0.0
    for e in range(1500):
        want = 0.9 * want + 0.1 * (e % 97) if e else float(e % 97)
    assert got.times == 1500 and got.ema == pytest.approx(want, rel=1e-12)
