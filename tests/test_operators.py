"""Operators against hand-made rows, and queries against DuckDB."""

from __future__ import annotations

import hashlib
import json
import os
import random
from decimal import Decimal

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from netloom.functions import text as T
from netloom.operators import anchors, circuits, curriculum, detection, filters, ordering, replies
from netloom.operators.components import connected_components
from netloom.plans import registry
from netloom.plans.fixtures import BASE, with_views
from netloom.sources import files, sinks
from netloom.streaming.frames import Hooks

SF = "/root/testdata/sf0.001"
COMPARED = (
    "box_xywh terminals iou_pairs capacitor_rule seg_intersections anchor_fit status_rollup best_iteration difficulty image_weights weighted_score agent1_metrics agent2_metrics agent3_metrics required_keys shape_intersection "
    "nms nms_agnostic nms_padded nms_agnostic_padded match_labels confusion_matrix running_precision_recall pr_envelope average_precision continuous_precision class_prf map_summary box_mask_means box_mask_maps "
    "component_terminal_map hanging_nodes component_report components seg_adjacency polygon_resample agent_rounds agent_records judge_rounds anchor_targets mosaic_labels pasted_copies mask_iou mask_iou_paired mask_layers rect_batches calibration_items ordered_split rank_shards seeded_order coco_annotations collate_index "
    "ema_state self_paced sample_weights smoothed_best low_pass version_order text_checks fenced_code reply_json netlist_nodes minimal_netlist spice_fallback normalized_issues coordinates run_stamps elapsed_seconds message_digests data_urls "
    "captions netlist_text circuit_report component_nodes connectivity_prompt netlist_prompt multihead_lines yolo_lines graph_json detection_json_values dataset_scan fileset_hash latest_per_source stateful_ema curve_grid"
).split()


def rows(found):
    """Rows in one order, numbers to five decimals whatever their type."""

    def plain(x):
        if x is None or x != x:
            return "null"
        if isinstance(x, bool):
            return str(x)
        if isinstance(x, (int, float, Decimal)):
            return str(round(float(x), 5) + 0.0)
        return str(x)

    return sorted(tuple(map(plain, r)) for r in found)


@pytest.fixture(scope="module")
def base():
    connection = duckdb.connect()
    for table in BASE:
        connection.execute(f"create view {table} as select * from '{SF}/{table}.parquet'")
    return connection


@pytest.mark.parametrize("name", COMPARED)
def test_query_equals_sql(spark, base, name):
    got = registry.queries()[name](spark, SF)
    want = base.execute(registry.oracle_sql()[name])
    names = [c[0] for c in want.description]
    assert sorted(got.columns) == sorted(names)
    assert rows(got.select(*sorted(names)).collect()) == rows([tuple(r[names.index(c)] for c in sorted(names)) for r in want.fetchall()])


def test_multihead_lines_have_four_heads_and_no_failed_image(spark):
    base = duckdb.connect()
    for table in BASE:
        base.execute(f"create view {table} as select * from '{SF}/{table}.parquet'")
    heads = with_views("select image_id, cls, det_id, x1, y1, x2, y2 from detections", ["detections"], "duckdb")
    failed = {i for (i,) in base.execute(with_views("select sample_id from samples where quality_tier = 'FAILED'", ["samples"], "duckdb")).fetchall()}
    boxes = [r for r in base.execute(heads).fetchall() if r[0] not in failed]
    got = [tuple(r) for r in registry.queries()["multihead_lines"](spark, SF).collect()]
    of = lambda head: sorted(r[1:] for r in got if r[0] == head)
    assert failed and {r[0] for r in got} == {"components", "wires", "nodes", "terminals"} and len(got) == 4 * len(boxes)
    assert of("terminals") == sorted((i, f"{c} {x1 / 512:.6f} {y1 / 512:.6f} 2 {d} t1") for i, c, d, x1, y1, x2, y2 in boxes)
    assert of("components") == sorted((i, f"{c} {(x1 / 512 + x2 / 512) / 2:.6f} {(y1 / 512 + y2 / 512) / 2:.6f} {x2 / 512 - x1 / 512:.6f} {y2 / 512 - y1 / 512:.6f}") for i, c, d, x1, y1, x2, y2 in boxes)


def test_message_list_holds_the_messages(spark):
    turns = duckdb.execute(f"select conv_id, role, text from '{SF}/conversations.parquet' order by conv_id, turn").fetchall()
    want = {}
    for key, role, text in turns:
        want.setdefault(key, [{"role": "system", "text": "You read schematics."}]).append({"role": role, "text": text})
    got = {r.conv_id: (json.loads(r.messages), r.n_messages) for r in registry.queries()["message_list"](spark, SF).collect()}
    assert got == {k: (v, len(v)) for k, v in want.items()}


def test_names_agree():
    assert set(registry.oracle_sql()) <= set(registry.queries())


def test_suppression_leaves_no_overlap(spark):
    boxes = spark.createDataFrame([(1, 1, 0, 0.9, 0, 0, 10, 10), (1, 2, 0, 0.8, 1, 1, 11, 11), (1, 3, 0, 0.7, 20, 20, 30, 30), (1, 4, 1, 0.6, 0, 0, 10, 10), (1, 5, 0, 0.1, 0, 0, 5, 5)], "image_id long, det_id long, cls int, conf double, x1 long, y1 long, x2 long, y2 long")
    assert sorted(r.det_id for r in detection.non_maximum_suppression(boxes, True).collect()) == [1, 3, 4]
    assert sorted(r.det_id for r in detection.non_maximum_suppression(boxes, False).collect()) == [1, 3]


def test_greedy_groups_do_not_close(spark):
    # 3 reaches 2 only after it was passed over for the group of 1 and 2 is added later.
    lines = spark.createDataFrame([(1, 1, 0, 0, 10, 0), (1, 2, 100, 0, 110, 0), (1, 3, 45, 0, 62, 0), (1, 4, 500, 0, 501, 0)], "image_id long, seg_id long, x1 long, y1 long, x2 long, y2 long")
    got = {r.seg_id: r.label for r in circuits.greedy_groups(lines).collect()}
    assert got == {1: 1, 3: 1, 2: 2, 4: 3}


def test_components_of_edges(spark):
    edges = spark.createDataFrame([(1, 2), (2, 3), (9, 8), (5, 5), (None, 1), (3, 1), (7, 8)], "a long, b long")
    got = {r.vertex: r.component for r in connected_components(edges, "a", "b").collect()}
    assert got == {1: 1, 2: 1, 3: 1, 7: 7, 8: 7, 9: 7}
    assert connected_components(edges.limit(0), "a", "b").count() == 0


def test_long_chain(spark):
    edges = spark.range(300).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b"))
    assert {r.component for r in connected_components(edges, "a", "b").collect()} == {0}


def test_components_of_large_segment_ids(spark):
    # Packed as image * 1,000,000 + segment, 1,000,001 of image 1 would be 1 of image 2.
    lines = spark.createDataFrame([(1, 1_000_001, 0, 0, 9, 0), (1, 1_000_002, 9, 0, 18, 0), (2, 1, 0, 0, 9, 0), (2, 5, 9, 0, 18, 0), (2, 7, 900, 0, 990, 0)], "image_id long, seg_id long, x1 long, y1 long, x2 long, y2 long")
    got = {(r.image_id, r.seg_id): r.component for r in circuits.segment_components(lines, 40.0).collect()}
    assert got == {(1, 1_000_001): 1_000_001, (1, 1_000_002): 1_000_001, (2, 1): 1, (2, 5): 1, (2, 7): 7}


def test_series(spark):
    losses = spark.createDataFrame([(1, k, float(v)) for k, v in enumerate([4, 4, 4, 1, 1, 1])] + [(2, 0, 3.0)], "sample_id long, step long, loss double")
    state = {r.sample_id: r for r in curriculum.loss_state(losses).withColumn("up", curriculum.improving(F.col("history"))).collect()}
    value = 4.0
    for v in (4, 4, 1, 1, 1):
        value = 0.9 * value + 0.1 * v
    assert state[1].ema == pytest.approx(value) and state[1].up and not state[2].up and state[2].ema == 3.0
    drawn = curriculum.weighted_draws(spark.createDataFrame([(1, 9.0), (2, 1.0)], "sample_id long, weight double"), 2000)
    counts = {r["sample_id"]: r["count"] for r in drawn.groupBy("sample_id").count().collect()}
    assert sum(counts.values()) == 2000 and 1700 < counts[1] < 1900
    smooth = curriculum.gaussian_smooth(losses, 1.0, "sample_id", "step", "loss").where("sample_id = 2").first()
    assert smooth.smooth == pytest.approx(3.0)


def test_netlist_text(spark):
    code = "* t\nR1 n1 0 10k\nM1 vdd n2 out 0 NMOS\n.END"
    row = spark.createDataFrame([(code,), ("",)], "c string").select(T.component_count(F.col("c")).alias("n"), T.netlist_nodes(F.col("c")).alias("nodes"), T.syntax_score(F.col("c")).alias("s")).collect()
    assert row[0].n == 2 and row[0].nodes == ["10k", "n1", "n2", "out", "vdd"] and row[0].s == pytest.approx(1.0)
    assert row[1].n == 0 and row[1].nodes == [] and row[1].s == 0


def test_golden_report(spark):
    found = spark.createDataFrame([(516, 1, "91", 0, 1), (516, 2, "101", 0, 1), (516, 3, "102", 1, 2)], "image_id long, comp_id long, label string, node1 long, node2 long")
    assert sinks.component_report(found).first().report == "91: 0 - 1\n101: 0 - 1\n102: 1 - 2"


def test_label_files(spark, tmp_path):
    (tmp_path / "a.txt").write_text("0 0.5 0.5 0.2 0.2\n1 0.1 0.1 0.3 0.1 0.3 0.4\n2 1.5 0.5 0.1 0.1\nx y\n")
    lines = spark.read.text(str(tmp_path / "a.txt")).withColumn("path", F.lit("a"))
    got = {r.cls: r for r in files.parse_labels(lines).collect()}
    assert got[0].status == "found" and got[1].status == "found" and got[1].w == pytest.approx(0.2) and got[2].status == "corrupt"
    (tmp_path / "m.csv").write_text("  epoch,  mAP \n 1, 0.5\n")
    assert files.trimmed_csv(spark, str(tmp_path / "m.csv")).columns == ["epoch", "mAP"]
    found = files.dataset_descriptor(["path: x", "train: a", "val: b", "names:", "  0: R", "  1: C"])
    assert found["names"] == {0: "R", 1: "C"}
    with pytest.raises(ValueError):
        files.dataset_descriptor(["train: a"])
    names = spark.createDataFrame([("exp",), ("exp2",), ("exp7",), ("a.b",), ("axb2",), ("exp02",)], "name string")
    assert sinks.next_name(names, "exp") == "exp3" and sinks.next_name(names, "new") == "new" and sinks.next_name(names, "a.b") == "a.b2"
    with pytest.raises(FileExistsError):
        sinks.next_name(spark.createDataFrame([("r",), ("r2",), ("r3",)], "name string"), "r", 3)
    assert files.one_match(spark.createDataFrame([("a/b.yaml",)], "path string"), "b.yaml") == "a/b.yaml"
    (tmp_path / "data/deep").mkdir(parents=True)
    (tmp_path / "models").mkdir()
    for n, name in enumerate(("data/deep/coco.yaml", "models/x.yaml", "models/last-10.pt", "models/last-2.pt", "data/x.yaml")):
        (tmp_path / name).write_text("x")
        os.utime(tmp_path / name, (1_000_000 + n, 1_000_000 + n))
    roots = [f"{tmp_path}/models", f"{tmp_path}/data", f"{tmp_path}/none"]
    assert files.find_config(spark, "coco.yaml", roots) == f"{tmp_path}/data/deep/coco.yaml" == files.find_config(spark, f"{tmp_path}/data/deep/coco.yaml", roots)
    assert files.find_config(spark, "", roots) == "" and files.find_config(spark, "https://x.org/a.yaml", roots) == "https://x.org/a.yaml"
    for wrong in ("x.yaml", "y.yaml", "oco.yaml"):
        with pytest.raises(FileNotFoundError):
            files.find_config(spark, wrong, roots)
    assert files.newest_file(spark, str(tmp_path), "last*.pt") == f"{tmp_path}/models/last-2.pt" and files.newest_file(spark, str(tmp_path), "best*.pt") == ""


def test_hooks():
    hooks, seen = Hooks(), []
    hooks.register("on_val_end", lambda x: seen.append(x))
    hooks.run("on_val_end", 3)
    assert seen == [3] and len(hooks.actions) == 19
    with pytest.raises(ValueError):
        hooks.register("nothing", print)


def test_prompts(spark):
    parts = spark.createDataFrame([(1, 1, "Resistor", 0.9), (1, 2, "Diode", 0.2)], "image_id long, det_id long, ctype string, conf double")
    assert replies.component_prompts(parts).first().prompt == "DETECTIONS:\n[1] Resistor (HIGH)\n[2] Diode (LOW)"


def test_entry_imports_alone():
    import __spark_entry__

    assert set(registry.queries()) <= set(__spark_entry__.queries())
    assert os.path.isfile(os.path.join(__spark_entry__.ROOT, "__spark_entry__.py"))


def naive_quality(detections, labels, levels):
    """Matching, running counts, AP and best F1 in plain loops and array interpolation."""
    iou = lambda a, b: (w := max(0, min(a[2], b[2]) - max(a[0], b[0]))) * (h := max(0, min(a[3], b[3]) - max(a[1], b[1]))) / ((a[2] - a[0]) * (a[3] - a[1]) + (b[2] - b[0]) * (b[3] - b[1]) - w * h + 1e-7)
    hit = {}
    wanted: dict = {}
    for image, det, cls, _, *box in detections:
        pairs = [(iou(g, box), gt) for i, gt, c, *g in labels if i == image and c == cls]
        if pairs and max(pairs)[0] >= levels[0]:
            best = max(pairs)
            wanted.setdefault((image, best[1]), []).append((best[0], det))
    for (image, _), found in wanted.items():
        hit[image, max(found)[1]] = max(found)[0]
    out = {}
    for cls in {d[2] for d in detections} & {g[2] for g in labels}:
        own = sorted((d for d in detections if d[2] == cls), key=lambda d: (-d[3], d[0], d[1]))
        n = sum(g[2] == cls for g in labels)
        conf, aps, curves = np.array([d[3] for d in own]), [], None
        for t in levels:
            tpc = np.cumsum([hit.get((d[0], d[1]), 0) >= t for d in own])
            recall, precision = tpc / (n + 1e-16), tpc / np.arange(1, len(own) + 1)
            if curves is None:
                grid = np.linspace(0, 1, 1000)
                curves = np.interp(-grid, -conf, precision, left=1), np.interp(-grid, -conf, recall, left=0)
            r, p = np.concatenate(([0.0], recall, [1.0])), np.concatenate(([1.0], precision, [0.0]))
            p = np.maximum.accumulate(p[::-1])[::-1]
            x = np.linspace(0, 1, 101)
            y = np.interp(x, r, p)
            aps.append(((y[1:] + y[:-1]) / 2 * np.diff(x)).sum())
        out[cls] = (n, aps, *curves)
    f1 = np.mean([2 * p * r / (p + r + 1e-16) for _, _, p, r in out.values()], axis=0)
    half = (round(len(f1) * 0.1 * 2) // 2 + 1) // 2
    smooth = np.convolve(np.concatenate((np.full(half, f1[0]), f1, np.full(half, f1[-1]))), np.ones(2 * half + 1) / (2 * half + 1), "valid")
    best = int(np.round(smooth, 12).argmax())
    return {c: (n, p[best], r[best], aps[0], np.mean(aps)) for c, (n, aps, p, r) in out.items()}


def test_quality_is_that_of_loops(spark):
    rng = np.random.default_rng(3)
    labels, found = [], []
    for image in range(30):
        for k in range(rng.integers(0, 6)):
            x, y, w, h = (int(v) for v in (rng.integers(0, 200), rng.integers(0, 200), rng.integers(20, 60), rng.integers(20, 60)))
            labels.append((image, k, int(rng.integers(0, 3)), x, y, x + w, y + h))
            for j in range(rng.integers(0, 3)):
                d = [int(v) for v in rng.integers(-8, 9, 4)]
                found.append((image, 10 * k + j, labels[-1][2] if rng.random() < 0.8 else 1, float(np.round(rng.random(), 4)), x + d[0], y + d[1], x + w + d[2], y + h + d[3]))
    d = spark.createDataFrame(found, "image_id long, det_id long, cls int, conf double, x1 long, y1 long, x2 long, y2 long")
    g = spark.createDataFrame(labels, "image_id long, gt_id long, cls int, x1 long, y1 long, x2 long, y2 long")
    got = {r.cls: (r.labels, r.p, r.r, r.ap50, r.ap) for r in detection.class_quality(detection.running_hits(detection.mark_hits(d, g), g), g).collect()}
    want = naive_quality(found, labels, detection.LEVELS)
    assert set(got) == set(want)
    for cls, row in want.items():
        assert got[cls] == pytest.approx(row, abs=1e-6)
    assert detection.mean_quality(detection.class_quality(detection.running_hits(detection.mark_hits(d.limit(0), g), g), g)).first().map == 0.0


def test_numbers_in_order(spark):
    rows = spark.range(1000).select((F.col("id") * 7919 % 1000).alias("v"), F.lit(None).cast("int").alias("x"))
    assert [(r.nth, r.v) for r in sorted(ordering.numbered(rows, ["v"]).collect(), key=lambda r: r.nth)] == [(k, k) for k in range(1000)]
    assert ordering.numbered(rows.limit(0), ["v"]).count() == 0
    assert sorted(r.shard for r in ordering.rank_shards(rows.where("v < 5"), ["v"], 4).collect()) == [0, 0, 1, 1, 2, 2, 3, 3]


def test_groups_of_large_images(spark):
    """Against plain loops, with images that go over several batches."""
    rng = np.random.default_rng(1)
    lines = [(image, k, *(int(v) for v in rng.integers(0, 900, 4))) for image, n in ((1, 60), (2, 1), (3, 25)) for k in range(n)]
    want = {}
    for image in (1, 2, 3):
        own = [r for r in lines if r[0] == image]
        near = lambda a, b: any((p[0] - q[0]) ** 2 + (p[1] - q[1]) ** 2 <= 1600 for p in (a[2:4], a[4:6]) for q in (b[2:4], b[4:6]))
        count = 0
        for i, a in enumerate(own):
            if (image, a[1]) in want:
                continue
            count += 1
            want[image, a[1]], members = count, [a]
            for b in own[i + 1 :]:
                if (image, b[1]) not in want and any(near(m, b) for m in members):
                    want[image, b[1]] = count
                    members.append(b)
    frame = spark.createDataFrame(lines, "image_id long, seg_id long, x1 long, y1 long, x2 long, y2 long")
    assert {(r.image_id, r.seg_id): r.label for r in circuits.greedy_groups(frame).collect()} == want
    assert circuits.greedy_groups(frame.limit(0)).count() == 0


def test_anchor_search(spark):
    boxes = spark.createDataFrame([(float(10 + k % 7), float(40 + k % 5)) for k in range(300)] + [(100.0, 20.0)] * 50, "w double, h double")
    start = anchors.kmeans_anchors(boxes, 2)
    found = anchors.evolve_anchors(boxes, start, 300)
    sizes = anchors.size_histogram(boxes)
    assert sizes[:, 2].sum() == 350 and anchors.histogram_fitness(sizes, start) == pytest.approx(anchors.anchor_fitness(boxes, start))
    assert anchors.anchor_fitness(boxes, found) >= anchors.anchor_fitness(boxes, start)
    assert anchors.histogram_fitness(anchors.size_histogram(boxes.limit(0)), start) == 0.0


def test_more_series(spark):
    losses = spark.createDataFrame([(1, k, float(v)) for k, v in enumerate([5, 3, 8, 1, 1, 9, 2])], "sample_id long, step long, loss double")
    value = 0.0
    for n, v in enumerate([5, 3, 8, 1, 1, 9, 2], 1):
        d = 0.9999 * (1 - np.exp(-n / 2000))
        value = d * value + (1 - d) * v
    assert curriculum.loss_state(losses).select(curriculum.ramped_ema(F.col("history")).alias("e")).first().e == pytest.approx(value)
    drawn = curriculum.weighted_draws(spark.createDataFrame([(k, float(k % 5 + 1)) for k in range(50)], "sample_id long, weight double"), 20_000)
    counts = {r["sample_id"]: r["count"] for r in drawn.groupBy("sample_id").count().collect()}
    assert sum(counts.values()) == 20_000 and all(abs(counts[k] / 20_000 - (k % 5 + 1) / 150) < 0.004 for k in range(50))


def filtered(x, b, a):
    """Forward and backward over the padded series by the difference equation, the past at the first value."""

    def one_way(x):
        n, past = len(a), [x[0]] * len(a)
        out = list(past)
        for i, v in enumerate(x):
            taps = ([*past, *x[: i + 1]])[::-1][:n]
            out.append(sum(f * t for f, t in zip(b, taps)) - sum(r * t for r, t in zip(a[1:], out[::-1][: n - 1])))
        return out[n:]

    pad = min(3 * len(a), len(x) - 1)
    longer = [2 * x[0] - v for v in x[1 : pad + 1]][::-1] + x + [2 * x[-1] - v for v in x[len(x) - 1 - pad : -1]][::-1]
    return one_way(one_way(longer)[::-1])[::-1][pad : pad + len(x)]


def test_butterworth(spark, monkeypatch):
    # Published coefficients of the filters of degree 2 and 5 at half of the highest frequency.
    b, a = filters.butterworth(2, 0.5)
    assert b == pytest.approx([0.29289322, 0.58578644, 0.29289322]) and a == pytest.approx([1, 0, 0.17157288], abs=1e-8)
    b, a = filters.butterworth(5, 0.5)
    assert b == pytest.approx([0.0527864, 0.26393202, 0.52786405, 0.52786405, 0.26393202, 0.0527864]) and a == pytest.approx([1, 0, 0.63343685, 0, 0.05572809, 0], abs=1e-8)
    b, a = filters.butterworth(5, 0.2)
    gain = lambda w: abs(np.polyval(b[::-1], np.exp(-1j * np.pi * w)) / np.polyval(a[::-1], np.exp(-1j * np.pi * w)))
    # No loss at rest, half of the power at the cutoff, none passed at the highest frequency.
    assert [gain(0), gain(0.2), gain(1)] == pytest.approx([1, np.sqrt(0.5), 0])
    with pytest.raises(ValueError):
        filters.butterworth(5, 1.0)
    rng = np.random.default_rng(3)
    series = {"long": np.cumsum(rng.normal(size=700)).tolist(), "one": [4.0], "two": [1.0, 5.0], "short": [5.0, 3, 8, 1, 1, 9, 2], None: rng.normal(size=40).tolist(), "flat": [2.0] * 30}
    rows = [(k, i, v, "x") for k, x in series.items() for i, v in enumerate(x)] + [("short", 99, None, "x"), ("void", 1, None, "x")]
    rng.shuffle(rows)
    df = spark.createDataFrame([(None if k is None else str(k), int(i), None if v is None else float(v), c) for k, i, v, c in rows], "name string, at int, v double, k string")
    # Chunks of 16 steps: states are handed on through 46 chunks of the long series.
    for chunk in (16, 4096):
        monkeypatch.setattr(filters, "CHUNK", chunk)
        got = filters.low_pass(df, 0.1, "name", "at", "v").collect()
        assert sorted({r.name or "" for r in got}) == sorted(k or "" for k in series)
        for k, x in series.items():
            own = sorted((r["at"], r.smooth) for r in got if r.name == k)
            assert [i for i, _ in own] == list(range(len(x))) and [v for _, v in own] == pytest.approx(filtered(x, b.tolist(), a.tolist()), abs=1e-8)
    assert filters.low_pass(df.limit(0), 0.1, "name", "at", "v").count() == 0


def test_cluster_centroids(spark):
    """Means of the four end points' coordinates of each group of segments."""
    rows = [(1, k, x, y, x + 4, y) for k, (x, y) in enumerate([(0, 0), (5, 1), (200, 100)])] + [(2, 0, 0, 0, 4, 0)]
    segments = spark.createDataFrame(rows, "image_id long, seg_id long, x1 long, y1 long, x2 long, y2 long")
    grouped = segments.join(circuits.greedy_groups(segments), ["image_id", "seg_id"])
    got = [r.asDict() for r in circuits.cluster_centroids(grouped).collect()]
    groups = {}
    for r in grouped.collect():
        groups.setdefault((r.image_id, r.label), []).append(r)
    want = {g: (np.mean([v for r in rs for v in (r.x1, r.x2)]), np.mean([v for r in rs for v in (r.y1, r.y2)])) for g, rs in groups.items()}
    assert len(got) == len(want) == 3 and {(r["image_id"], r["label"]): (r["cx"], r["cy"]) for r in got} == want


def test_draws_of_one_heavy_sample(spark, monkeypatch):
    monkeypatch.setattr(curriculum, "CELLS", 64)
    drawn = curriculum.weighted_draws(spark.createDataFrame([(1, 8.0), (2, 1.0), (3, 1.0)], "sample_id long, weight double"), 5_000)
    counts = {r["sample_id"]: r["count"] for r in drawn.groupBy("sample_id").count().collect()}
    assert sum(counts.values()) == 5_000 and abs(counts[1] / 5_000 - 0.8) < 0.03


def test_file_sources_and_sinks(spark, tmp_path):
    write = lambda name, text: (tmp_path / name).write_text(text)
    write("list.txt", "./images/b.jpg\n\n/x/a.MP4\n./images/a.png\n")
    paths = files.manifest_paths(spark, f"{tmp_path}/list.txt")
    assert [r.path for r in files.media_order(paths).collect()] == [f"{tmp_path}/images/a.png", f"{tmp_path}/images/b.jpg", "/x/a.MP4"]
    write("n.txt", "1 2.5 x\n\n 3  4 5\n")
    assert sorted(tuple(r) for r in files.numeric_columns(spark, f"{tmp_path}/n.txt", [0, 2]).collect()) == [(1.0, None), (3.0, 5.0)]
    write("s.json", json.dumps({"samples": [{"sample_id": "a", "overall_difficulty": 0.9}, {"sample_id": "b", "needs_review": True}]}))
    got = {r.sample_id: r for r in files.sample_manifest(spark, f"{tmp_path}/s.json").collect()}
    assert (got["a"].overall_difficulty, got["a"].curriculum_stage, got["b"].overall_difficulty, got["b"].needs_review) == (0.9, 3, 0.5, True)
    write("p.json", json.dumps({"7": {"page_size": [10, 20], "images": [{"file": "f", "coords": [1, 2, 3, 4]}], "num_images": 1}, "8": {"page_size": [1, 2], "images": [], "num_images": 0}}))
    pages = {r.page: r for r in files.page_annotations(spark, f"{tmp_path}/p.json").collect()}
    assert pages[7].images[0].coords == [1, 2, 3, 4] and pages[8].num_images == 0
    for name in ("a.PNG", "b.jpeg", "c.txt"):
        write(name, "x")
    assert sorted(os.path.basename(r.path) for r in files.image_files(spark, str(tmp_path)).select("path").collect()) == ["a.PNG", "b.jpeg"]
    sinks.split_manifests(spark.createDataFrame([("train", "a"), ("val", "b"), ("train", "c")], "split string, path string"), f"{tmp_path}/splits")
    assert sorted(r.value for r in spark.read.text(f"{tmp_path}/splits/split=train").collect()) == ["a", "c"]
    one = spark.createDataFrame([(1, "r")], "id int, name string")
    assert [(r.part, json.loads(r.json)) for r in sinks.coco_document(one, one, one).collect()] == [(p, {"id": 1, "name": "r"}) for p in ("images", "annotations", "categories")]
    sized = spark.createDataFrame([("b", 3), ("a", 4)], "path string, size long")
    assert sinks.fileset_hash(sized).first().hash == hashlib.sha256(b"7ab").hexdigest()
    images = spark.createDataFrame([(f"d/images/{n}.png",) for n in "abcd"], "path string")
    lines = spark.createDataFrame([("d/labels/a.txt", "0 0.5 0.5 0.1 0.1"), ("d/labels/a.txt", "0 0.5 0.5 0.1 0.1"), ("d/labels/b.txt", ""), ("d/labels/c.txt", "0 2 0.5 0.1 0.1")], "path string, value string")
    scan = sorted(tuple(r) for r in files.dataset_scan(images, lines).collect())
    assert scan == [("d/images/a.png", "found", 1), ("d/images/b.png", "empty", 0), ("d/images/c.png", "corrupt", 0), ("d/images/d.png", "missing", 0)]


def test_records_products_and_caches(spark, tmp_path):
    fitness = 0.1 * F.col("map50") + 0.9 * F.col("map")
    log = lambda *rows: sinks.evolution_record(spark.createDataFrame(rows, "generation int, map50 double, map double"), ["map50", "map"], f"{tmp_path}/evolve", fitness)
    assert log((0, 0.5, 0.2)) == "# Best generation: 0\n# Last generation: 0\nmap50: 0.5\nmap: 0.2\n"
    assert log((1, 0.5, 0.4), (2, 0.5, 0.4)).startswith("# Best generation: 1\n# Last generation: 2\n")
    sinks.write_products(spark.createDataFrame([("spice", 1, "x"), ("captions", 1, "y"), ("spice", 2, "z")], "product string, image_id long, text string"), f"{tmp_path}/out")
    assert sorted(r.text for r in spark.read.json(f"{tmp_path}/out/product=spice").collect()) == ["x", "z"]


def test_running_hits_over_many_ranges(spark, monkeypatch):
    # More ranges than partitions, classes that end inside a range, equal confidences, a class without labels.
    rows = [(i % 3, i // 7, i, (i * 37 % 11) / 10, (i * 13 % 10) / 9) for i in range(400)]
    marked = spark.createDataFrame(rows, "cls int, image_id long, det_id long, conf double, iou double")
    labels = spark.createDataFrame([(0,), (0,), (1,)], "cls int")
    monkeypatch.setattr(detection, "RANGE", 23)
    running = detection.running_hits(marked, labels)
    assert running.select("part").distinct().count() > 4
    got = {(r.cls, r.det_id): (r.k, r.labels, r.hits) for r in running.collect()}
    for cls, n in ((0, 2), (1, 1)):
        own = sorted((r for r in rows if r[0] == cls), key=lambda r: (-r[3], r[1], r[2]))
        for k, r in enumerate(own, 1):
            assert got.pop((cls, r[2])) == (k, n, [sum(o[4] >= t for o in own[:k]) for t in detection.LEVELS])
        hits, envelope = [sum(o[4] >= 0.5 for o in own[: k + 1]) for k in range(len(own))], {r.det_id: r.envelope for r in detection.precision_envelope(running).where(f"cls = {cls}").collect()}
        best = [max(h / k for k, h in enumerate(hits[j:], j + 1)) for j in range(len(own))]
        assert [envelope[r[2]] for r in own] == best
        area = detection.continuous_precision(running).where(f"cls = {cls}").first().ap
        assert area == pytest.approx(sum(b for b, r in zip(best, own) if r[4] >= 0.5) / n)
    assert not got
    plan = detection.average_precision(running)._jdf.queryExecution().executedPlan().toString()
    assert "SortAggregate" not in plan


def test_near_segments_over_cell_borders(spark, monkeypatch):
    # End points on borders of cells, at exactly the radius, beyond zero and in fractions; cells of any side give the same pairs.
    rng = random.Random(8)
    place = lambda: rng.choice([rng.uniform(-90, 90), float(rng.randrange(-9, 10) * 10)])
    rows = [(i % 2, i, place(), place(), place(), place()) for i in range(160)]
    segments = spark.createDataFrame(rows, "image_id int, seg_id long, x1 double, y1 double, x2 double, y2 double")
    ends = lambda r: ((r[2], r[3]), (r[4], r[5]))
    near = lambda a, b: any((p[0] - q[0]) ** 2 + (p[1] - q[1]) ** 2 <= 100 for p in ends(a) for q in ends(b))
    want = {(a[0], a[1], b[1]) for a in rows for b in rows if a[0] == b[0] and a[1] < b[1] and near(a, b)}
    for side in (1, circuits.SIDE, 9):
        monkeypatch.setattr(circuits, "SIDE", side)
        got = [tuple(r) for r in circuits.near_segments(segments, 10.0).collect()]
        assert len(want) > 50 and len(got) == len(set(got)) and set(got) == want


def test_partitions_grow_with_the_input(spark, monkeypatch):
    from netloom.plans import shared

    table, least = spark.read.parquet(f"{SF}/lineitem.parquet"), int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert shared.partitions(table) == least
    monkeypatch.setattr(shared, "PART_BYTES", 1 << 10)
    assert shared.partitions(table) > least and shared.partitions(table.crossJoin(table)) >= least


def test_views_of_boxes_share_one_exchange_by_image_that_grows_with_the_files(spark, tmp_path, monkeypatch):
    from netloom.plans import fixtures

    lines = spark.read.parquet(f"{SF}/lineitem.parquet")
    monkeypatch.setattr(fixtures, "BOX_BYTES", 4096)
    assert fixtures.by_image(lines).rdd.getNumPartitions() == fixtures.plan_bytes(lines, "l_orderkey") // 4096 > 8
    plan = registry.queries()["adjacency"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == plan.count("REPARTITION_BY_NUM") == 2


def test_terminal_map_is_the_map_of_nearest_terminals(spark, monkeypatch):
    monkeypatch.setattr(circuits, "PAIRS", 7)
    draw = random.Random(5)
    point = lambda: (draw.randrange(6) / 2, draw.randrange(6) / 2)
    # Images of all sizes, some without components, terminals or nodes.
    of = lambda most: [(i, k, *point()) for i in range(80) for k in range(draw.randrange(most))]
    components = spark.createDataFrame(of(6), "image_id long, comp_id long, mx double, my double")
    terminals = spark.createDataFrame(of(4), "image_id long, term_id long, tx double, ty double")
    nodes = spark.createDataFrame(of(4), "image_id long, node_id long, nx double, ny double")
    want = circuits.terminal_nodes(circuits.nearest_terminals(components, terminals), nodes)
    got = circuits.terminal_map(components, terminals, nodes)
    assert rows(got.collect()) == rows(want.collect()) and got.count() > 100
    assert circuits.terminal_map(components.limit(0), terminals, nodes).count() == circuits.terminal_map(components, terminals, nodes.limit(0)).count() == 0


def test_circuits_of_images_are_those_of_maps_and_links(spark, monkeypatch):
    # Images cross the batches of a task; ids are texts, some places are unknown, several points lie in one place.
    monkeypatch.setattr(circuits, "PAIRS", 5)
    draw = random.Random(11)
    place = lambda: None if draw.random() < 0.04 else draw.randrange(5) / 2
    of = lambda most: [(f"i{i}" if i else None, f"k{k}", place(), place()) for i in range(60) for k in range(draw.randrange(most))]
    kinds = [(of(9), "comp_id string, mx double, my double"), (of(4), "term_id string, tx double, ty double"), (of(8), "node_id string, nx double, ny double")]
    components, terminals, nodes = (spark.createDataFrame(r, f"image_id string, {kind}") for r, kind in kinds)
    placed = [components.where("mx + my is not null"), terminals.where("tx + ty is not null"), nodes.where("nx + ny is not null")]
    known = circuits.image_circuits(circuits.circuit_parts(*placed))
    want = circuits.terminal_nodes(circuits.nearest_terminals(*placed[:2]), placed[2])
    batch = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
    try:
        assert rows(circuits.terminals_mapped(known).collect()) == rows(want.collect())
        whole = circuits.image_circuits(circuits.circuit_parts(components, terminals, nodes))
        links = circuits.hanging_links(circuits.terminals_mapped(whole), nodes)
        assert rows(circuits.nodes_linked(whole).collect()) == rows(links.collect()) and links.count() > 50
        for r in whole.collect():
            ids = [n.id for n in r.nodes]
            assert r.image_id or not r.links and not any(c.node1 for c in r.components)
            assert ids == sorted(ids) and [c.id for c in r.components] == sorted(c.id for c in r.components)
            assert all((c.node1, c.node2) == tuple(None if a is None else ids[a] for a in (c.at1, c.at2)) for c in r.components)
            told = [(ids[l["at"]], ids[l["to"]]) for l in r.links]  # noqa: E741
            assert told == [(l.node_id, l.to_node) for l in r.links] == sorted(told)  # noqa: E741
            assert [l["first"] for l in r.links] == [{*t} not in [{*u} for u in told[:k]] for k, t in enumerate(told)]  # noqa: E741
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)


@pytest.mark.parametrize("name", "circuit_report netlist_prompt hanging_nodes component_terminal_map detection_json_values".split())
def test_circuits_of_boxes_without_an_image_are_those_of_sql(spark, tmp_path, name):
    base = duckdb.connect()
    base.execute(f"copy (select * replace (case when l_orderkey % 50 = 1 then null else l_orderkey end as l_orderkey) from '{SF}/lineitem.parquet' where l_orderkey < 400) to '{tmp_path}/lineitem.parquet'")
    base.execute(f"create view lineitem as select * from '{tmp_path}/lineitem.parquet'")
    want = base.execute(registry.oracle_sql()[name]).fetchall()
    assert rows(registry.queries()[name](spark, str(tmp_path)).collect()) == rows(want) and len(want) > 50


@pytest.mark.parametrize("name", "circuit_report hanging_nodes component_terminal_map detection_json_values".split())
def test_circuits_need_one_reading_and_one_exchange_of_boxes(spark, name):
    plan = registry.queries()[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == plan.count("FileScan") == 1 and plan.count("SortMergeJoin") == 0


def test_prompts_of_netlists_send_boxes_and_prompts_once(spark):
    plan = registry.queries()["netlist_prompt"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    # Boxes for circuits, those of every third image for the netlists before, and the prompts unless one side is broadcast.
    assert plan.count("Exchange hashpartitioning") <= 3 and plan.count("FileScan") == 2


def test_detection_documents_of_tables_list_what_each_image_has(spark):
    df = spark.createDataFrame
    boxes = df([(1, 2, 3, 0.5, 0, 0, 4, 4), (1, 1, 5, 0.25, 1, 1, 2, 2), (9, 1, 5, 0.25, 1, 1, 2, 2)], "image_id long, det_id long, cls int, conf double, x1 long, y1 long, x2 long, y2 long")
    segments = df([(1, 7, 0, 0, 4, 1)], "image_id long, seg_id long, x1 long, y1 long, x2 long, y2 long")
    junctions = df([(2, 2, 1.5, 2.0), (2, 1, 0.0, 0.5)], "image_id long, node_id long, nx double, ny double")
    lines = lambda *r: df(list(r), "image_id long, pos long, line string")
    sizes = df([(1, 64, 48), (2, 32, 24), (3, 8, 8), (None, 1, 1)], "image_id long, width int, height int")
    found = sinks.detection_json(boxes, segments, junctions, sizes, lines((1, 2, "b"), (1, 1, "a"), (1, 3, None)), lines((2, 1, "n")), lines((None, 1, "x"), (1, 1, "c")))
    got = {r.image_id: json.loads(r.json) for r in found.collect()}
    empty = {"yolo_detections": [], "hough_lines": [], "junction_candidates": [], "components": [], "nodes": [], "connections": []}
    point = lambda x, y: {"x": x, "y": y}
    box = lambda *v: dict(zip(("det_id", "cls", "conf", "x1", "y1", "x2", "y2"), v))
    assert got == {
        1: empty | {"yolo_detections": [box(1, 5, 0.25, 1, 1, 2, 2), box(2, 3, 0.5, 0, 0, 4, 4)], "hough_lines": [{"start": point(0, 0), "end": point(4, 1)}], "image_size": {"width": 64, "height": 48}, "components": ["a", "b", None], "connections": ["c"]},
        2: empty | {"junction_candidates": [point(0.0, 0.5), point(1.5, 2.0)], "image_size": {"width": 32, "height": 24}, "nodes": ["n"]},
        3: empty | {"image_size": {"width": 8, "height": 8}},
    }


def test_series_of_all_lengths_are_filtered_together(spark, monkeypatch):
    b, a = filters.butterworth(5, 0.1)
    draw = np.random.default_rng(3)
    sizes = np.array([1, 40, 3, 17, 40, 2])
    starts = np.cumsum(sizes) - sizes
    x, states = draw.normal(size=sizes.sum()), draw.normal(size=(5, len(sizes)))
    want = np.concatenate([filters.run_filter(b, a, x[s : s + n], states[:, i])[0] for i, (s, n) in enumerate(zip(starts, sizes))])
    assert (filters.run_filters(b, a, x, starts, sizes, states) == want).all()
    # Series that are cut into chunks and held apart, one of them without a key, are the same as uncut ones.
    df = spark.createDataFrame([(None if k == 2 else k, t, float((t * t + k) % 17)) for k in range(5) for t in range(5 + 30 * k)], "name long, at long, v double")
    whole = rows(filters.low_pass(df, 0.05, "name", "at", "v").collect())
    monkeypatch.setattr(filters, "CHUNK", 16)
    monkeypatch.setattr(filters, "HELD", 32)
    assert rows(filters.low_pass(df, 0.05, "name", "at", "v").collect()) == whole and len(whole) == df.count()
