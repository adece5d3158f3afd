"""Derived views that give detection and run schemas realistic rows.

Each view is SQL that Spark and DuckDB read alike, except where two forms are
given.  ``with_views`` puts the views that a query needs before it, so that
plans stay lazy and both engines see the same rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from netloom.plans.shared import plan_bytes

#: Bytes of files for each partition of boxes: sorts and aggregates of some 110,000 boxes meet in one task.
BOX_BYTES = 2 << 20
#: Partitions below which adaptive execution chooses their number.
FEW_PARTS = 8
BASE = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()

_ORDER = "l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_quantity, l_discount, l_tax, l_shipdate"
#: Far end of the segment of a box: nearly level or nearly upright.
_END = ("case when det_id % 2 = 0 then x2 else x1 + det_id % 3 end", "case when det_id % 2 = 0 then y1 + det_id % 3 else y2 end")
#: Corners of a polygon with a notch, in a box of cells of 8 pixels.
_CORNERS = ["gx", "gy + 1", "gx + w", "gy + id % 3", "gx + w - cls % 4", "gy + h", "gx + cast(floor(w / 2e0) as bigint)", "gy + cast(floor(h / 2e0) as bigint)", "gx + cls % 3", "gy + h"]
_POLYGON = """
select {kept}, {list}{point}, {point}, {point}, {point}, {point}{end} as points
from (select {kept}, {id} as id, cast(floor(x1 / 8e0) as bigint) as gx, cast(floor(y1 / 8e0) as bigint) as gy, cast(floor((x2 - x1) / 8e0) as bigint) as w, cast(floor((y2 - y1) / 8e0) as bigint) as h from {boxes}) b"""
#: The class and the shift of the corners in the ground truth of a box.
_TRUE_CLS, _DX, _DY = "case when det_id % 7 = 0 then (cls + 1) % 12 else cls end", "(det_id % 3) * 4", "(det_id % 2) * 4"
_TRUTH = f"case when det_id % 5 <> 0 then det_id end as gt_id, {_TRUE_CLS} as true_cls, x1 + {_DX} as tx1, y1 + {_DY} as ty1, x2 + {_DX} as tx2, y2 + {_DY} as ty2"
_TRUE = "gt_id, true_cls, tx1, ty1, tx2, ty2"
_BESIDE = "(select image_id, det_id, points, gt_id, true_cls as cls, tx1 as x1, ty1 as y1, tx2 as x2, ty2 as y2 from ({}) p)"


def _polygon(kept: str, boxes: str, start: str = "array(", end: str = ")", name: str = "points") -> str:
    """Spark SQL for the polygons of ``boxes`` beside ``kept`` columns, which hold ``cls``."""
    point = "named_struct('x', {}, 'y', {})"
    return _POLYGON.replace("as points", f"as {name}").format(kept=kept, boxes=boxes, id="det_id", list=start, end=end, point=point).format(*_CORNERS)


VIEWS: dict[str, tuple[list[str], str | dict[str, str]]] = {
    "detections": ([], f"""
select image_id, cast(row_number() over (partition by image_id order by {_ORDER}) as bigint) as det_id, cls, conf, x1, y1, x1 + w as x2, y1 + h as y2
from (select l_orderkey as image_id, {_ORDER}, cast(l_partkey % 12 as int) as cls, cast(cast(round(l_extendedprice * 100) as bigint) % 1001 as double) / 1000 as conf,
 l_partkey * 37 % 320 as x1, l_suppkey * 53 % 240 as y1, cast(40 + l_quantity * 4 as bigint) as w, cast(30 + (l_quantity * 7) % 160 as bigint) as h from lineitem) s"""),
    "ground_truth": (["detections"], f"""
select image_id, det_id as gt_id, {_TRUE_CLS} as cls,
 x1 + {_DX} as x1, y1 + {_DY} as y1, x2 + {_DX} as x2, y2 + {_DY} as y2 from detections where det_id % 5 <> 0"""),
    "segments": (["detections"], f"""
select image_id, det_id as seg_id, x1, y1, {_END[0]} as x2, {_END[1]} as y2 from detections"""),
    # Each box beside its segment, for queries that need both in one reading.
    "drawn": (["detections"], f"select *, det_id as seg_id, x1 as sx1, y1 as sy1, {_END[0]} as sx2, {_END[1]} as sy2 from detections"),
    "stage_results": ([], """
select image_id, stage, cast(row_number() over (partition by image_id, stage order by ts, event_id) as bigint) as iteration, score, tokens
from (select user_id * 100 + day(ts) as image_id, event_type as stage, ts, event_id, cast(least(value, 100.0) as double) / 100 as score, cast(round(value * 10) as bigint) as tokens from events) s"""),
    "samples": ([], """
select d.doc_id as sample_id, concat('data/images/', d.source, '/', cast(d.doc_id as varchar(20)), '.jpg') as image_path,
 case when l.quality = 1 and l.toxic = 0 then 'VERIFIED' when l.quality = 1 then 'CONFIDENT' when l.quality = 0 and l.toxic = 0 then 'LOW_CONFIDENCE' when l.quality = 0 then 'FAILED' else 'pending' end as quality_tier,
 coalesce(l.toxic, 1) = 1 as needs_review, d.n_chars % 60 as component_count, d.n_chars % 80 as wire_count, d.n_chars % 25 as junction_count, d.doc_id % 7 as crossing_count,
 d.doc_id % 11 as multi_terminal_components, cast(d.n_chars % 101 as double) / 100 as yolo_avg_confidence, cast(d.doc_id % 13 as double) / 50 as yolo_miss_rate, cast(d.doc_id % 17 as double) / 60 as yolo_fp_rate,
 cast(d.n_chars % 41 as double) / 100 as line_noise_ratio, d.n_chars % 9 as wires_filtered, d.doc_id % 5 as floating_terminals_before, cast(d.n_chars % 37 as double) / 10 as avg_node_degree, d.n_chars % 8 as max_node_degree,
 1 + d.doc_id % 3 as agent1_iterations, 1 + d.n_chars % 3 as agent2_iterations, 1 + (d.doc_id + d.n_chars) % 3 as agent3_iterations from documents d left join labels l on d.doc_id = l.doc_id"""),
    "polygons": (["detections"], {
        "spark": _POLYGON.format(kept="image_id, det_id, cls", boxes="detections", id="det_id", list="array(", end=")", point="named_struct('x', {}, 'y', {})").format(*_CORNERS),
        "duckdb": _POLYGON.format(kept="image_id, det_id, cls", boxes="detections", id="det_id", list="[", end="]", point="{{'x': {}, 'y': {}}}").format(*_CORNERS),
    }),
    "true_polygons": (["ground_truth"], {
        "spark": _POLYGON.format(kept="image_id, gt_id, cls", boxes="ground_truth", id="gt_id", list="array(", end=")", point="named_struct('x', {}, 'y', {})").format(*_CORNERS),
        "duckdb": _POLYGON.format(kept="image_id, gt_id, cls", boxes="ground_truth", id="gt_id", list="[", end="]", point="{{'x': {}, 'y': {}}}").format(*_CORNERS),
    }),
    # Each polygon beside that of its ground truth, for queries that need both in one reading.
    "outlined": (["detections"], {"spark": _polygon("image_id, det_id, points, gt_id, cls", _BESIDE.format(_polygon(f"image_id, det_id, cls, {_TRUE}", f"(select *, {_TRUTH} from detections)")), "case when gt_id is not null then array(", ") end", "true_points")}),
    "netlist_lines": (["detections"], """
select image_id, det_id, cls, concat(case cls when 0 then 'V' when 1 then 'Q' when 2 then 'V' when 3 then 'C' when 4 then 'I' when 5 then 'VSUP_' when 6 then 'D' when 7 then '* GND' when 8 then 'L' when 9 then 'M' when 10 then 'R' else 'V' end, cast(det_id as varchar(9)), ' n', cast(x1 % 5 as varchar(9)), case when y1 % 3 = 0 then ' 0' when y1 % 3 = 1 then ' vdd' else concat(' n', cast(y1 % 4 as varchar(9))) end, case when cls = 9 then ' out 0 NMOS W=1u L=180n' else ' 10k' end) as line from detections"""),
    "netlists": (["netlist_lines"], {
        "spark": "select image_id, concat('* Circuit ', cast(image_id as varchar(12)), chr(10), array_join(transform(array_sort(collect_list(struct(det_id, line))), x -> x.line), chr(10)), chr(10), case when image_id % 4 <> 0 then '.END' else '' end) as spice_code from netlist_lines group by image_id",
        "duckdb": "select image_id, concat('* Circuit ', cast(image_id as varchar(12)), chr(10), string_agg(line, chr(10) order by det_id), chr(10), case when image_id % 4 <> 0 then '.END' else '' end) as spice_code from netlist_lines group by image_id",
    }),
    "replies": ([], """
select conv_id, turn, concat('Sure.', chr(10), '```', case when turn % 2 = 0 then 'json' else '' end, chr(10), '{"decisions": [{"idx": ', cast(turn as varchar(9)), ', "keep": ', case when conv_id % 3 = 0 then 'false' else 'true' end, '}]}', chr(10), '```', chr(10), 'Done.') as reply from conversations where role = 'assistant'"""),
    "classes": ([], "select * from (values (0,'Voltage_Source'),(1,'NPN'),(2,'Voltage_Source'),(3,'Capacitor'),(4,'Current_Source'),(5,'Supply'),(6,'Diode'),(7,'Ground'),(8,'Inductor'),(9,'MOSFET'),(10,'Resistor'),(11,'Other')) as t(cls, name)"),
    "losses": ([], """
select user_id as sample_id, cast(row_number() over (partition by user_id order by ts, event_id) as bigint) as step, cast(value as double) / 50 as loss from events"""),
}


def with_views(query: str, views: list[str], engine: str) -> str:
    """``query`` with the views that it names, and those that they need, before it."""
    needed: list[str] = []

    def add(name: str) -> None:
        for parent in VIEWS[name][0]:
            add(parent)
        if name not in needed:
            needed.append(name)

    for v in views:
        add(v)
    if not needed:
        return query
    texts = [VIEWS[v][1] if isinstance(VIEWS[v][1], str) else VIEWS[v][1][engine] for v in needed]
    head = ", ".join(f"{v} as ({t.strip()})" for v, t in zip(needed, texts))
    body = query.strip()
    if body.startswith("with "):
        return f"with {head}, {body[5:]}"
    return f"with {head} {body}"


def dealt(rows: DataFrame, lines: DataFrame, column: str) -> DataFrame:
    """``rows`` dealt by ``column``, in partitions that grow in number with the files of ``lines``."""
    parts, least = plan_bytes(lines, "l_orderkey") // BOX_BYTES, int(lines.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # Without a number, adaptive execution merges small partitions.
    return rows.repartition(max(parts, least), column) if parts >= FEW_PARTS else rows.repartition(column)


def by_image(lines: DataFrame) -> DataFrame:
    """Rows of ``lineitem`` dealt by order, the image of all views of boxes.

    Every reading of the table shuffles the same plain columns, so that one exchange
    serves all views of a query and what they group and join by image needs no other. Its
    number of partitions grows with the files, so that tasks do not.
    """
    return dealt(lines, lines, "l_orderkey")


def tables(spark: SparkSession, sf_dir: str, images: tuple[str, ...] = ()) -> None:
    """Name the base tables of a folder for SQL, those in ``images`` dealt by image; plans made before keep theirs."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    for name in BASE:
        try:
            table = spark.read.parquet(f"{sf_dir}/{name}.parquet")
            (by_image(table) if name in images else table).createOrReplaceTempView(name)
        except Exception as missing:  # noqa: BLE001
            if "PATH_NOT_FOUND" not in str(missing):
                raise


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A derived view as a lazy DataFrame."""
    tables(spark, sf_dir, ("lineitem",))
    return spark.sql(with_views(f"select * from {name}", [name], "spark"))


def view_over(parent: DataFrame, parent_name: str, name: str) -> DataFrame:
    """A derived view whose only parent is at hand, as when that one is written once for several readers."""
    if VIEWS[name][0] != [parent_name]:
        raise ValueError(f"{name} does not read {parent_name} alone")
    return parent.sparkSession.sql(with_views(f"select * from {name}", [name], "spark").replace(f"with {with_views('', [parent_name], 'spark').strip().removeprefix('with ')}", f"with {parent_name} as (select * from {{parent}})"), parent=parent)
