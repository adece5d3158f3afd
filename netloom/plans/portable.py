"""Queries that are one SQL text for Spark and DuckDB, by operator family.

They are pure projections, filters, joins, aggregations and windows, which
Catalyst plans as they stand; operators with parameters or iteration are
functions in ``netloom.operators``.
"""

from __future__ import annotations

R = "round({}, 6)"
#: Truncation towards zero, as a cast does in Spark but not in DuckDB.
TRUNC = "cast(case when ({0}) >= 0 then floor({0}) else ceil({0}) end as bigint)"
RANK = {"FAILED": 0, "LOW_CONFIDENCE": 1, "CONFIDENT": 2, "VERIFIED": 3}
TIER = "case quality_tier when 'VERIFIED' then 3 when 'CONFIDENT' then 2 when 'LOW_CONFIDENCE' then 1 else 0 end"
SIGMOID = "1e0 / (1e0 + exp(-({0}) / 20e0 * 4e0 + 2e0))"
_COMPONENT = SIGMOID.format("component_count * 0.3e0 + yolo_miss_rate * 30e0 + yolo_fp_rate * 20e0 + (1e0 - yolo_avg_confidence) * 10e0 + multi_terminal_components * 0.5e0")
_WIRE = SIGMOID.format("wire_count * 0.1e0 + line_noise_ratio * 30e0 + crossing_count * 2e0 + wires_filtered * 0.2e0")
_NODE = SIGMOID.format("junction_count * 0.3e0 + crossing_count * 1.5e0 + floating_terminals_before * 2e0 + avg_node_degree * 0.5e0")
_TOPOLOGY = SIGMOID.format("component_count * 0.2e0 + avg_node_degree * 1e0 + max_node_degree * 0.3e0 + crossing_count * 1e0 + (agent1_iterations + agent2_iterations) * 0.3e0")
_OVERALL = f"least(1e0, {_COMPONENT} * 0.3e0 + {_WIRE} * 0.25e0 + {_NODE} * 0.2e0 + {_TOPOLOGY} * 0.25e0 + (agent1_iterations + agent2_iterations + agent3_iterations) / 9e0 * 0.15e0)"
DIFFICULTY = f"""select sample_id, quality_tier, needs_review, {_COMPONENT} as component_difficulty, {_WIRE} as wire_difficulty, {_NODE} as node_difficulty, {_TOPOLOGY} as topology_difficulty,
 {_OVERALL} as overall, cast(case when {_OVERALL} <= 0.2e0 then 1 when {_OVERALL} <= 0.4e0 then 2 when {_OVERALL} <= 0.6e0 then 3 when {_OVERALL} <= 0.8e0 then 4 else 5 end as bigint) as stage from samples"""
TYPED = "select d.*, c.name as ctype from detections d join classes c on d.cls = c.cls"
PATH = "select image_id, det_id, {0} as px, {1} as py, lag({0}) over (partition by image_id order by det_id) as qx, lag({1}) over (partition by image_id order by det_id) as qy, lag({0}, 2) over (partition by image_id order by det_id) as ox, lag({1}, 2) over (partition by image_id order by det_id) as oy from detections".format(
    "cast(floor((x1 + x2) / 2e0) as bigint)", "cast(floor((y1 + y2) / 2e0) as bigint)"
)

#: name -> (operators, views, SQL)
PORTABLE: dict[str, tuple[str, list[str], str]] = {
    # Projections
    "box_xywh": ("P01 P02", ["detections"], "select image_id, det_id, (x1 + x2) / 2e0 as cx, (y1 + y2) / 2e0 as cy, x2 - x1 as w, y2 - y1 as h, (x1 + x2) / 2e0 - (x2 - x1) / 2e0 as back_x1, (y1 + y2) / 2e0 + (y2 - y1) / 2e0 as back_y2 from detections"),
    "box_norm_clip": ("P03 P04 P06", ["detections"], """with c as (select image_id, det_id, least(greatest(x1, 0), 480 - 0.001e0) as x1, least(greatest(y1, 0), 320 - 0.001e0) as y1, least(greatest(x2, 0), 480 - 0.001e0) as x2, least(greatest(y2, 0), 320 - 0.001e0) as y2 from detections)
 select image_id, det_id, round((x1 + x2) / 2e0 / 480, 9) as cx, round((y1 + y2) / 2e0 / 320, 9) as cy, round((x2 - x1) / 480e0, 9) as w, round((y2 - y1) / 320e0, 9) as h, round(480 * ((x1 + x2) / 2e0 / 480 - (x2 - x1) / 480e0 / 2) + 8, 9) as pixel_x1, round(320 * ((y1 + y2) / 2e0 / 320 + (y2 - y1) / 320e0 / 2) + 4, 9) as pixel_y2 from c"""),
    "box_unletterbox": ("P07 P08", ["detections"], """with g as (select image_id, det_id, x1, y1, x2, y2, least(640e0 / 480, 640e0 / 320) as gain from detections), p as (select *, (640 - 480 * gain) / 2 as pad_x, (640 - 320 * gain) / 2 as pad_y from g)
 select image_id, det_id, round(gain, 6) as gain, round(pad_x, 6) as pad_x, round(pad_y, 6) as pad_y, round(least(greatest((x1 - pad_x) / gain, 0e0), 480e0), 6) as ux1, round(least(greatest((y1 - pad_y) / gain, 0e0), 320e0), 6) as uy1, round(least(greatest((x2 - pad_x) / gain, 0e0), 480e0), 6) as ux2, round(least(greatest((y2 - pad_y) / gain, 0e0), 320e0), 6) as uy2 from p"""),
    "box_props": ("P12 P13 P30 P31", ["detections", "classes"], f"with t as ({TYPED}) select image_id, det_id, ctype, x2 - x1 as width, y2 - y1 as height, (x2 - x1) * (y2 - y1) as area, cast(floor((x1 + x2) / 2e0) as bigint) as center_x, cast(floor((y1 + y2) / 2e0) as bigint) as center_y, case when y2 - y1 > x2 - x1 then 'vertical' else 'horizontal' end as orientation, round((x1 + x2) / 2e0 / 640, 9) as yolo_x, round((y2 - y1) / 480e0, 9) as yolo_h from t"),
    "box_shrink_expand": ("P21 P22", ["detections"], f"""select image_id, det_id, {TRUNC.format('x1 + (x2 - x1) * (1 - 0.85e0) / 2')} as in_x1, {TRUNC.format('y1 + (y2 - y1) * (1 - 0.85e0) / 2')} as in_y1, {TRUNC.format('x2 - (x2 - x1) * (1 - 0.85e0) / 2')} as in_x2, {TRUNC.format('y2 - (y2 - y1) * (1 - 0.85e0) / 2')} as in_y2,
 round(greatest((x1 + x2) / 2e0 - ((x2 - x1) * 1.02e0 + 10) / 2, 0e0), 6) as out_x1, round(least((x1 + x2) / 2e0 + ((x2 - x1) * 1.02e0 + 10) / 2, 640e0), 6) as out_x2, round(greatest((y1 + y2) / 2e0 - (greatest(x2 - x1, y2 - y1) * 1.3e0 + 30) / 2, 0e0), 6) as square_y1 from detections"""),
    "box_to_page": ("P23 P24", ["detections"], f"select image_id, det_id, {TRUNC.format('x1 / 0.75e0')} as page_x1, {TRUNC.format('y1 / 0.75e0')} as page_y1, {TRUNC.format('x2 / 0.75e0')} as page_x2, {TRUNC.format('y2 / 0.75e0')} as page_y2, {TRUNC.format('conf * 100 / 100 * 600 - 30')} as point_x1, {TRUNC.format('conf * 100 / 100 * 400 + 30')} as point_y2 from detections"),
    "box_perspective": ("P25", ["detections"], """with c as (select image_id, det_id, 0.9e0 * x1 + 0.1e0 * y1 + 5 as a, -0.1e0 * x1 + 0.9e0 * y1 + 3 as b, 0.9e0 * x2 + 0.1e0 * y2 + 5 as c, -0.1e0 * x2 + 0.9e0 * y2 + 3 as d, 0.9e0 * x1 + 0.1e0 * y2 + 5 as e, -0.1e0 * x1 + 0.9e0 * y2 + 3 as f, 0.9e0 * x2 + 0.1e0 * y1 + 5 as g, -0.1e0 * x2 + 0.9e0 * y1 + 3 as h from detections)
 select image_id, det_id, round(least(greatest(least(a, c, e, g), 0e0), 640e0), 6) as px1, round(least(greatest(least(b, d, f, h), 0e0), 480e0), 6) as py1, round(least(greatest(greatest(a, c, e, g), 0e0), 640e0), 6) as px2, round(least(greatest(greatest(b, d, f, h), 0e0), 480e0), 6) as py2 from c"""),
    "box_flips": ("P26", ["detections"], "select image_id, det_id, round(1 - (x1 + x2) / 2e0 / 640, 9) as flip_x, round(1 - (y1 + y2) / 2e0 / 480, 9) as flip_y, round(640 - x1 / 0.83e0, 9) as tta_x from detections"),
    "head_decode": ("P27", ["detections"], "select image_id, det_id, round((2 / (1 + exp(-(x1 / 160e0 - 1))) - 0.5e0 + det_id) * 8, 6) as bx, round((2 / (1 + exp(-(y1 / 120e0 - 1))) - 0.5e0 + det_id) * 8, 6) as by_, round(power(2 / (1 + exp(-conf)), 2) * 10, 6) as bw, round(power(2 / (1 + exp(-conf)), 2) * 13, 6) as bh from detections"),
    "terminals": ("P28", ["detections", "classes"], f"""with t as (select image_id, det_id, ctype, x1, y1, x2, y2, cast(floor((x1 + x2) / 2e0) as bigint) as cx, cast(floor((y1 + y2) / 2e0) as bigint) as cy from ({TYPED}) s),
 k as (select *, case when ctype in ('NMOS', 'PMOS', 'MOSFET') then 3 when ctype in ('Ground', 'GND', 'Current_Source', 'Voltage_Source') then 1 else 2 end as pins from t)
 select image_id, det_id, n.i as pin, case pins when 3 then case n.i when 1 then 'drain' when 2 then 'gate' else 'source' end when 1 then 'terminal' else concat('pin', cast(n.i as varchar(2))) end as name,
 case when pins = 3 then case n.i when 2 then x1 else cx end when pins = 1 then cx when y2 - y1 > x2 - x1 then cx when n.i = 1 then x1 else x2 end as x,
 case when pins = 3 then case n.i when 1 then y1 when 2 then cy else y2 end when pins = 1 then y1 when y2 - y1 > x2 - x1 then case n.i when 1 then y1 else y2 end else cy end as y from k join (values (1), (2), (3)) as n(i) on n.i <= k.pins"""),
    "component_ids": ("P29 W10", ["detections", "classes"], f"with t as ({TYPED}) select image_id, det_id, concat(case ctype when 'Resistor' then 'R' when 'Capacitor' then 'C' when 'NMOS' then 'M' when 'PMOS' then 'M' when 'MOSFET' then 'M' when 'Ground' then 'GND' when 'Current_Source' then 'I' when 'Voltage_Source' then 'V' else 'X' end, cast(row_number() over (partition by image_id order by det_id) as varchar(9))) as component_id from t where conf >= 0.25e0"),
    "exif_size": ("P32", [], "select doc_id, case when doc_id % 9 in (6, 8) then 480 + n_chars % 7 else 640 end as width, case when doc_id % 9 in (6, 8) then 640 else 480 + n_chars % 7 end as height from documents"),
    "class_remap": ("P33", ["detections"], "select image_id, det_id, cls, cast(cls + 1 + case when cls >= 11 then 1 else 0 end as bigint) as remapped from detections"),
    "auto_scale_boxes": ("P34", ["detections"], "with m as (select *, case when image_id % 2 = 0 then x1 / 640e0 else x1 * 1e0 end as vx, case when image_id % 2 = 0 then y1 / 480e0 else y1 * 1e0 end as vy from detections) select image_id, det_id, round(case when max(greatest(vx, vy)) over (partition by image_id) <= 1.01e0 then vx * 640 else vx end + 640 * (image_id % 4 - image_id % 2) / 2, 6) as sx, round(case when max(greatest(vx, vy)) over (partition by image_id) <= 1.01e0 then vy * 480 else vy end + 480 * (image_id % 2), 6) as sy from m"),
    "seg_geometry": ("P14 P15 P16 P20 M14", ["segments"], """with g as (select *, sqrt(cast((x2 - x1) * (x2 - x1) + (y2 - y1) * (y2 - y1) as double)) as length, degrees(atan2(cast(y2 - y1 as double), cast(x2 - x1 as double))) as angle from segments)
 select image_id, seg_id, round(length, 9) as length, round(angle, 9) as angle, cast(floor((x1 + x2) / 2e0) as bigint) as mid_x, cast(floor((y1 + y2) / 2e0) as bigint) as mid_y, abs(angle) < 10 or abs(angle) > 170 as horizontal, abs(angle) between 80 and 100 as vertical, abs(angle) > 45 and abs(angle) < 135 as splits_vertical, round(x1 / 640e0, 9) as nx1, round(y2 / 480e0, 9) as ny2 from g"""),
    "wire_paths": ("P17 P18 P19", ["detections"], f"""with p as ({PATH}), s as (select *, sqrt(cast((px - qx) * (px - qx) + (py - qy) * (py - qy) as double)) as step, abs(degrees(atan2(cast(py - qy as double), cast(px - qx as double))) - degrees(atan2(cast(qy - oy as double), cast(qx - ox as double)))) as turn from p)
 select image_id, round(sum(coalesce(step, 0e0)), 4) as total_length, cast(sum(case when case when turn > 180 then 360 - turn else turn end > 20 then 1 else 0 end) as bigint) as bends, min(px) as x_min, min(py) as y_min, max(px) as x_max, max(py) as y_max, cast(floor(avg(px)) as bigint) as centroid_x, cast(floor(avg(py)) as bigint) as centroid_y, max(case when abs(py - qy) > 5 then 1 else 0 end) = 0 as horizontal, max(case when abs(px - qx) > 5 then 1 else 0 end) = 0 as vertical from s group by image_id"""),
    "polygon_boxes": ("P05 P09 P10", ["detections"], "with p as (select image_id, (x1 / 320e0) * 480 as x, (y1 / 240e0) * 320 as y from detections) select image_id, round(min(x), 6) as x_min, round(min(y), 6) as y_min, round(max(x), 6) as x_max, round(max(y), 6) as y_max, round(coalesce(min(case when x >= 0 and y >= 0 and x <= 400 and y <= 300 then x end), 0e0), 6) as inside_x_min, round(coalesce(max(case when x >= 0 and y >= 0 and x <= 400 and y <= 300 then y end), 0e0), 6) as inside_y_max from p group by image_id"),
    # Filters
    "confidence_filter": ("F01 F02 F13", ["detections"], "select image_id, det_id, conf, case when conf >= 0.8e0 then 'high' when conf >= 0.5e0 then 'medium' else 'low' end as band, conf < 0.7e0 as low_confidence from detections where conf > 0.25e0 and cls in (3, 8, 9, 10)"),
    "point_in_box": ("F04 F22", ["detections"], "select image_id, det_id, 160 between x1 and x2 and 120 between y1 and y2 as contains_point, 160 >= x1 and 160 < x2 and 120 >= y1 and 120 < y2 as in_mask from detections"),
    "box_candidates": ("F05 F06", ["detections"], "select image_id, det_id from (select *, (x2 - x1) * conf as w2, (y2 - y1) * conf as h2 from detections) s where w2 > 2 and h2 > 2 and w2 * h2 / ((x2 - x1) * (y2 - y1) + 1e-16) > 0.1e0 and greatest(w2 / (h2 + 1e-16), h2 / (w2 + 1e-16)) < 100"),
    "small_labels": ("F06", ["detections"], "select count(*) as labels, cast(sum(case when (x2 - x1) * conf < 3 or (y2 - y1) * conf < 3 then 1 else 0 end) as bigint) as tiny, cast(sum(case when (x2 - x1) * conf >= 2 or (y2 - y1) * conf >= 2 then 1 else 0 end) as bigint) as kept from detections"),
    "min_items": ("F07", ["detections"], "select d.image_id, det_id from detections d join (select image_id from detections group by image_id having count(*) >= 4) k on d.image_id = k.image_id"),
    "include_class": ("F08", ["detections"], "select image_id, det_id, 0 as cls from detections where cls in (0, 2, 4)"),
    "label_validity": ("F09 A08", ["detections"], "with s as (select image_id, case when conf < 0.02e0 then 'missing' when conf < 0.05e0 then 'empty' when x2 > 420 or y2 > 420 then 'corrupt' else 'found' end as status from detections) select status, count(*) as n from s group by status"),
    "tier_filter": ("F10 F11", ["samples"], f"select sample_id, quality_tier, quality_tier <> 'FAILED' as multihead from samples where {TIER} >= 1"),
    "stage_filter": ("F12 R06 R08", ["samples"], f"with d as ({DIFFICULTY}), e as (select stage, case when stage = 1 then 0 when stage = 2 then 5 when stage = 3 then 10 when stage = 4 then 15 else 20 end as from_epoch from (values (1), (2), (3), (4), (5)) as t(stage)), m as (select max(stage) as top from e where from_epoch <= 12) select sample_id, stage, stage <= top as staged, stage >= top as anti from d cross join m where not needs_review"),
    "scaffolding": ("F14 T09", ["netlist_lines"], "with t as (select image_id, det_id, split_part(line, ' ', 1) as token from netlist_lines where substr(line, 1, 1) not in ('*', '.', ';', '#') and line <> '') select image_id, det_id, token, upper(token) in ('VDD', 'VSS', 'VCC', 'VEE', 'AVDD', 'DVDD') or substr(upper(token), 1, 5) in ('VSUP_', 'ISUP_') or substr(upper(token), 1, 3) = 'VB_' or substr(upper(token), 1, 6) in ('VTEST_', 'IBIAS_', 'ITEST_') or substr(upper(token), 1, 7) in ('RSHUNT_', 'RPROBE_') or substr(upper(token), 1, 1) in ('B', 'G', 'E', 'F', 'D', 'H') as is_scaffolding from t"),
    "line_kinds": ("F15 F16", ["netlist_lines"], "select image_id, det_id, line = '' or substr(line, 1, 1) in ('*', '.', ';', '#') or substr(line, 1, 2) = '//' as judge_skips, line = '' or substr(line, 1, 1) in ('*', '.') as agent_skips, upper(substr(line, 1, 1)) in ('R', 'C', 'L', 'M', 'Q', 'V', 'I', 'D', '*', '.') as looks_spice from netlist_lines"),
    "feedback_retry": ("F17", [], "with f as (select conv_id, turn, lower(text) as t from conversations) select conv_id, turn, t <> '' and not (t like '%all correct%' or t like '%all good%' or t like '%no issues%' or t like '%correctly identified%' or t like '%looks correct%' or t like '%no changes needed%' or t like '%nothing to change%' or t like '%well identified%' or t like '%accurate%' or t like '%no corrections needed%') as retry from f"),
    "decision_bounds": ("F18 J12", ["detections"], "with d as (select image_id, det_id - 2 as idx, det_id % 4 <> 0 as keep_it from detections), n as (select image_id, count(*) as n from detections group by image_id) select d.image_id, t.det_id, t.cls, d.keep_it from d join n on d.image_id = n.image_id join detections t on t.image_id = d.image_id and t.det_id = d.idx + 1 where d.idx between 0 and n.n - 1"),
    "mapping_issues": ("F19", ["detections"], "with s as (select image_id, det_id, case cls % 5 when 0 then 'MATCH' when 1 then 'IMPLICIT' when 2 then 'MISSING' when 3 then 'WRONG' else 'OK' end as status from detections) select image_id, det_id, status, status not in ('MATCH', 'OK') as node_issue from s where status not in ('MATCH', 'IMPLICIT', 'OK')"),
    "url_file": ("T16 F20", [], "with u as (select page_id, url, split_part(split_part(url, '?', 1), '#', 1) as clean from pages), f as (select page_id, url, regexp_replace(clean, '^.*/', '') as file from u) select page_id, file, substr(url, 1, 5) in ('https', 'http:') as is_url, split_part(file, '.', 1) as stem from f"),
    "annotated_pages": ("F21", ["detections"], "select image_id, count(*) as num_images from detections where conf > 0.5e0 group by image_id having count(*) > 0"),
    "image_log_gate": ("F23", ["stage_results"], "with g as (select image_id, stage, iteration, row_number() over (partition by stage, iteration order by image_id) as nth from stage_results where iteration % 1 = 0) select image_id, stage, iteration from g where nth <= 16"),
    # Joins
    "iou_pairs": ("J01", ["detections"], """with p as (select a.image_id, a.det_id as a_id, b.det_id as b_id, greatest(0, least(a.x2, b.x2) - greatest(a.x1, b.x1)) * greatest(0, least(a.y2, b.y2) - greatest(a.y1, b.y1)) as inter, (a.x2 - a.x1) * (a.y2 - a.y1) + (b.x2 - b.x1) * (b.y2 - b.y1) as areas from detections a join detections b on a.image_id = b.image_id and a.det_id < b.det_id)
 select image_id, a_id, b_id, round(inter / (areas - inter + 1e-7), 6) as iou, round(case when inter <= 0 then 0e0 else cast(inter as double) / (areas - inter) end, 6) as iou_strict from p where inter / (areas - inter + 1e-7) > 0.1e0"""),
    "giou_ciou": ("J02", ["detections"], """with p as (select a.image_id, a.det_id as a_id, b.det_id as b_id, cast(a.x2 - a.x1 as double) as w1, a.y2 - a.y1 + 1e-7 as h1, cast(b.x2 - b.x1 as double) as w2, b.y2 - b.y1 + 1e-7 as h2, greatest(0, least(a.x2, b.x2) - greatest(a.x1, b.x1)) * greatest(0, least(a.y2, b.y2) - greatest(a.y1, b.y1)) as inter,
 cast(greatest(a.x2, b.x2) - least(a.x1, b.x1) as double) as cw, cast(greatest(a.y2, b.y2) - least(a.y1, b.y1) as double) as ch, (power(cast(b.x1 + b.x2 - a.x1 - a.x2 as double), 2) + power(cast(b.y1 + b.y2 - a.y1 - a.y2 as double), 2)) / 4 as rho2 from detections a join detections b on a.image_id = b.image_id and a.det_id < b.det_id),
 q as (select *, w1 * h1 + w2 * h2 - inter + 1e-7 as uni, power(cw, 2) + power(ch, 2) + 1e-7 as c2, 4 / power(pi(), 2) * power(atan(w2 / h2) - atan(w1 / h1), 2) as v from p), r as (select *, inter / uni as iou from q)
 select image_id, a_id, b_id, round(iou - (cw * ch + 1e-7 - uni) / (cw * ch + 1e-7), 6) as giou, round(iou - rho2 / c2, 6) as diou, round(iou - (rho2 / c2 + v * (v / (v - iou + 1 + 1e-7))), 6) as ciou from r"""),
    "ioa": ("J03 J21", ["detections"], "with p as (select a.image_id, a.det_id as a_id, b.det_id as b_id, greatest(0, least(a.x2, b.x2) - greatest(a.x1, b.x1)) * greatest(0, least(a.y2, b.y2) - greatest(a.y1, b.y1)) / ((b.x2 - b.x1) * (b.y2 - b.y1) + 1e-7) as ioa from detections a join detections b on a.image_id = b.image_id and a.det_id <> b.det_id), m as (select image_id, a_id, max(ioa) as most from p group by image_id, a_id) select image_id, a_id, round(most, 6) as most_ioa, most < 0.3e0 as may_paste, most < 0.6e0 as survives_cutout from m"),
    "capacitor_rule": ("F03 J05", ["detections"], """select d.image_id, d.det_id, d.cls from detections d where not (d.cls = 3 and d.conf < 0.7e0) and not (d.cls = 3 and exists (select 1 from detections m where m.image_id = d.image_id and m.cls = 9 and greatest(0, least(d.x2, m.x2) - greatest(d.x1, m.x1)) * greatest(0, least(d.y2, m.y2) - greatest(d.y1, m.y1))
 > 0.3e0 * ((d.x2 - d.x1) * (d.y2 - d.y1) + (m.x2 - m.x1) * (m.y2 - m.y1) - greatest(0, least(d.x2, m.x2) - greatest(d.x1, m.x1)) * greatest(0, least(d.y2, m.y2) - greatest(d.y1, m.y1)))))"""),
    "seg_intersections": ("J13", ["segments"], """with p as (select h.image_id, h.seg_id as h_id, v.seg_id as v_id, h.x1, h.y1, h.x2, h.y2, v.x1 as x3, v.y1 as y3, v.x2 as x4, v.y2 as y4 from segments h join segments v on h.image_id = v.image_id and h.seg_id % 2 = 0 and v.seg_id % 2 = 1),
 e as (select *, (y2 - y1) as a1, (x1 - x2) as b1, (y4 - y3) as a2, (x3 - x4) as b2 from p), c as (select *, a1 * x1 + b1 * y1 as c1, a2 * x3 + b2 * y3 as c2, a1 * b2 - a2 * b1 as det from e), s as (select *, cast(b2 * c1 - b1 * c2 as double) / det as x0, cast(a1 * c2 - a2 * c1 as double) / det as y0 from c where det <> 0)
 select image_id, h_id, v_id, round(x0, 6) as x0, round(y0, 6) as y0 from s where x0 >= least(x1, x2) and x0 <= greatest(x1, x2) and y0 >= least(y1, y2) and y0 <= greatest(y1, y2) and x0 >= least(x3, x4) and x0 <= greatest(x3, x4) and y0 >= least(y3, y4) and y0 <= greatest(y3, y4)"""),
    "endpoint_on_segment": ("J15", ["segments"], """with p as (select a.image_id, a.seg_id as a_id, b.seg_id as b_id, a.x1 as px, a.y1 as py, b.x1, b.y1, b.x2, b.y2 from segments a join segments b on a.image_id = b.image_id and a.seg_id <> b.seg_id)
 select image_id, a_id, b_id from p where abs((py - y1) * (x2 - x1) - (px - x1) * (y2 - y1)) <= 0.1e0 and (px - x1) * (x2 - x1) + (py - y1) * (y2 - y1) between 0 and (x2 - x1) * (x2 - x1) + (y2 - y1) * (y2 - y1)"""),
    "anchor_fit": ("J04 J17 A22", ["detections"], """with a as (select * from (values (1, 60e0, 50e0), (2, 120e0, 90e0), (3, 200e0, 160e0)) as t(anchor_id, aw, ah)), r as (select image_id, det_id, anchor_id, least(least((x2 - x1) / aw, aw / (x2 - x1)), least((y2 - y1) / ah, ah / (y2 - y1))) as fit, least(x2 - x1, aw) * least(y2 - y1, ah) / ((x2 - x1) * (y2 - y1) + aw * ah - least(x2 - x1, aw) * least(y2 - y1, ah)) as wh_iou from detections cross join a),
 b as (select image_id, det_id, max(fit) as best, max(wh_iou) as best_iou, sum(case when fit > 0.25e0 then 1 else 0 end) as above from r group by image_id, det_id) select round(avg(case when best > 0.25e0 then 1e0 else 0e0 end), 6) as bpr, round(avg(cast(above as double)), 6) as aat, round(avg(best * case when best > 0.25e0 then 1 else 0 end), 6) as fitness, round(avg(best_iou), 6) as mean_iou from b"""),
    "label_pairing": ("J09", [], "with i as (select page_id, regexp_replace(regexp_replace(concat('data/images/', cast(page_id as varchar(9)), '.jpg'), '/images/', '/labels/'), '[.]jpg$', '.txt') as label_path from pages), l as (select concat('data/labels/', cast(doc_id as varchar(9)), '.txt') as path, quality from labels) select i.page_id, i.label_path, case when l.path is null then 'missing' when l.quality = 0 then 'empty' else 'found' end as status from i left join l on i.label_path = l.path"),
    "resume_pages": ("J10 S11", [], "select p.page_id from pages p where not exists (select 1 from labels l where l.doc_id = p.page_id)"),
    "class_agreement": ("J18 J19", ["detections", "ground_truth"], "select d.image_id, d.det_id from detections d where exists (select 1 from ground_truth g where g.image_id = d.image_id and g.cls = d.cls and greatest(0, least(d.x2, g.x2) - greatest(d.x1, g.x1)) * greatest(0, least(d.y2, g.y2) - greatest(d.y1, g.y1)) > 0.5e0 * (d.x2 - d.x1) * (d.y2 - d.y1))"),
    "named_edges": ("J20 G01", ["detections"], "with n as (select image_id, concat('N', cast(cls as varchar(3))) as name, min(det_id) as id from detections group by image_id, cls), e as (select image_id, concat('N', cast(cls as varchar(3))) as a, concat('N', cast((cls + 1) % 12 as varchar(3))) as b from detections) select e.image_id, x.id as src, y.id as dst, count(*) as times from e join n x on e.image_id = x.image_id and e.a = x.name join n y on e.image_id = y.image_id and e.b = y.name group by e.image_id, x.id, y.id"),
    # Aggregations
    "class_histogram": ("A01", ["detections", "classes"], f"with t as ({TYPED}) select image_id, ctype, count(*) as n from t group by image_id, ctype"),
    "instance_stats": ("A02 N03", ["detections", "classes"], "select c.cls, count(d.det_id) as instances from classes c left join detections d on d.cls = c.cls and d.conf > 0.5e0 group by c.cls"),
    "image_stats": ("A03", ["detections"], "select count(distinct image_id) as total, count(distinct image_id) - count(distinct case when conf > 0.5e0 then image_id end) as unlabelled, count(distinct case when cls = 3 then image_id end) as with_capacitor from detections"),
    "class_weights": ("A04", ["detections", "classes"], "with n as (select c.cls, count(d.det_id) as n from classes c left join detections d on d.cls = c.cls group by c.cls), w as (select cls, 1e0 / greatest(n, 1) as w from n) select cls, round(w / sum(w) over (), 9) as weight from w"),
    "image_weights": ("A05 A32", ["detections"], "with n as (select cls, count(*) as n from detections group by cls), w as (select cls, 1e0 / n / sum(1e0 / n) over () as w from n), c as (select image_id, cls, count(*) as k from detections group by image_id, cls) select image_id, round(sum(k * w), 6) as weight from c join w on c.cls = w.cls group by image_id"),
    "batch_stats": ("A06 A07 D24", ["stage_results"], "with i as (select image_id, avg(score) as conf, sum(tokens) as tokens, count(*) as calls from stage_results group by image_id), s as (select *, case when conf >= 0.8e0 then 'SUCCESS' when conf >= 0.5e0 then 'PARTIAL' when conf >= 0.1e0 then 'FAILED' else 'ERROR' end as status from i) select count(*) as total, cast(sum(case when status = 'SUCCESS' then 1 else 0 end) as bigint) as success, cast(sum(case when status = 'PARTIAL' then 1 else 0 end) as bigint) as partial_, cast(sum(case when status = 'FAILED' then 1 else 0 end) as bigint) as failed, cast(sum(case when status = 'ERROR' then 1 else 0 end) as bigint) as errors, cast(sum(tokens) as bigint) as tokens, cast(sum(calls) as bigint) as calls, round(sum(conf) / greatest(count(*), 1), 6) as mean_confidence from s"),
    "export_stats": ("A09", ["samples"], f"with d as ({DIFFICULTY}) select stage, count(*) as samples, cast(sum(case when needs_review then 1 else 0 end) as bigint) as needing_review, cast(sum(case when quality_tier <> 'FAILED' then 1 else 0 end) as bigint) as exported from d group by stage"),
    "refinement_counts": ("A10", [], "with c as (select user_id, case event_type when 'click' then 'component' when 'view' then 'wire' when 'purchase' then 'node' else 'terminal' end as target, case event_id % 3 when 0 then 'add' when 1 then 'remove' else 'modify' end as action from events) select user_id, cast(sum(case when target = 'component' and action = 'add' then 1 else 0 end) as bigint) as components_added, cast(sum(case when target = 'component' and action = 'remove' then 1 else 0 end) as bigint) as components_removed, cast(sum(case when target = 'wire' and action = 'add' then 1 else 0 end) as bigint) as wires_added, cast(sum(case when target = 'wire' and action = 'modify' then 1 else 0 end) as bigint) as wires_modified from c group by user_id"),
    "weighted_score": ("A18", ["stage_results"], "with m as (select image_id, stage, max(score) as value from stage_results group by image_id, stage), w as (select * from (values ('click', 25), ('view', 30), ('purchase', 25)) as t(stage, weight)) select image_id, cast(sum(cast(round(value * 1000000) as bigint) * coalesce(weight, 100)) as double) / (cast(sum(coalesce(weight, 100)) as double) * 1000000) as score from m left join w on m.stage = w.stage group by image_id"),
    "status_rollup": ("A19 A20 A21", ["stage_results"], "with b as (select image_id, stage, max(score) as best from stage_results group by image_id, stage), r as (select image_id, min(case when best >= 0.5e0 then 1 else 0 end) as all_passed, max(case when best >= 0.5e0 then 1 else 0 end) as any_passed, avg(best) as confidence, cast(sum(case when best < 0.5e0 then 1 else 0 end) as bigint) as reasons from b group by image_id) select image_id, case when all_passed = 1 then 'SUCCESS' when any_passed = 1 then 'PARTIAL' else 'FAILED' end as status, case when all_passed = 1 and confidence >= 0.9e0 then 'VERIFIED' when all_passed = 1 and confidence >= 0.8e0 then 'CONFIDENT' when any_passed = 1 then 'LOW_CONFIDENCE' else 'FAILED' end as tier, all_passed = 0 or reasons > 0 as needs_review, reasons from r"),
    "fitness": ("A17 L06 L13", [], "with e as (select event_type, event_id % 30 as epoch, avg(cast(value as double)) / 100 as map50, avg(cast(value as double)) / 150 as map from events group by event_type, event_id % 30), f as (select *, 0.1e0 * map50 + 0.9e0 * map as fitness from e), r as (select *, row_number() over (partition by event_type order by fitness desc, epoch) as nth from f) select event_type, epoch, round(fitness, 6) as fitness from r where nth = 1"),
    "label_moments": ("A25 A24", ["detections"], "select cls, round(avg(cast(x2 - x1 as double)), 6) as mean_w, round(stddev_pop(cast(x2 - x1 as double)), 6) as std_w, count(case when x1 < 160 then 1 end) as left_bin, round(ln(count(*) + 1e0), 6) as log_n from detections group by cls"),
    "type_presence": ("A27", ["detections", "classes"], f"with t as ({TYPED}) select image_id, max(case when ctype in ('NMOS', 'PMOS', 'MOSFET', 'NPN', 'PNP', 'OpAmp') then 1 else 0 end) = 1 as has_active, max(case when ctype in ('Resistor', 'Capacitor', 'Inductor') then 1 else 0 end) = 1 as has_passive, max(case when ctype in ('Ground', 'VDD', 'Voltage_Source', 'Current_Source') then 1 else 0 end) = 1 as has_reference, case when max(case when ctype in ('Ground', 'VDD', 'Voltage_Source', 'Current_Source') then 1 else 0 end) = 1 then 1e0 else 0.5e0 end as completeness from t group by image_id"),
    "memory_fit": ("A29", ["detections"], "with b as (select cls + 1 as batch, avg(cast(x2 - x1 as double)) / 100 as gb from detections group by cls) select round(regr_slope(gb, batch), 9) as slope, round(regr_intercept(gb, batch), 6) as intercept from b"),
    # Windows and top-k
    "best_iteration": ("W05", ["stage_results"], "with r as (select *, row_number() over (partition by image_id, stage order by score desc, iteration) as nth from stage_results where score > 0) select image_id, stage, iteration, score from r where nth = 1"),
    "first_pass": ("W06 I01", ["stage_results"], "with p as (select *, coalesce(max(case when score >= 0.8e0 then 1 else 0 end) over (partition by image_id, stage order by iteration rows between unbounded preceding and 1 preceding), 0) as done from stage_results) select image_id, stage, iteration, score from p where done = 0 and iteration <= 3"),
    "early_stop": ("W09", ["losses"], "with b as (select sample_id, step, loss, max(loss) over (partition by sample_id order by step rows between unbounded preceding and current row) as best from losses), l as (select sample_id, step, max(case when loss >= best then step end) over (partition by sample_id order by step rows between unbounded preceding and current row) as best_step from b) select sample_id, min(case when step - best_step >= 10 then step end) as stops_at from l group by sample_id"),
    "cosine_ramp": ("W12", ["losses"], "select sample_id, step, round(((1 - cos(step * pi() / 100)) / 2) * (0.1e0 - 1) + 1, 6) as lr from losses"),
    "frame_stride": ("W13", ["losses"], "select sample_id, step from losses where step % 4 = 0"),
    "series_rebase": ("W15", [], "with r as (select user_id, event_id, cast(floor(epoch(ts)) as bigint) as t, row_number() over (partition by user_id order by ts, event_id) as k, count(*) over (partition by user_id) as n from events) select user_id, event_id, t - min(t) over (partition by user_id) as t0 from r where k > 5 and k <= n - 3"),
    "class_running_index": ("W16 W10", ["detections"], "select image_id, det_id, concat(cast(cls as varchar(3)), cast(row_number() over (partition by image_id, cls order by det_id) as varchar(9))) as label from detections"),
    "topk_detections": ("L04 L05", ["detections"], "with r as (select *, row_number() over (partition by image_id order by conf desc, det_id) as nth from detections) select image_id, det_id, conf from r where nth <= 3"),
    "newest_run": ("L07 L14", ["stage_results"], "with r as (select *, row_number() over (partition by stage order by iteration desc, image_id) as newest, row_number() over (partition by stage order by iteration, image_id) as lowest from stage_results) select stage, max(case when newest = 1 then image_id end) as newest_image, max(case when lowest = 1 then image_id end) as lowest_image from r group by stage"),
    "smallest_half": ("L08 L09", ["detections"], "with r as (select image_id, det_id, (x2 - x1) * (y2 - y1) as area, row_number() over (partition by image_id order by (x2 - x1) * (y2 - y1), det_id) as nth, count(*) over (partition by image_id) as n from detections) select image_id, det_id, area from r where nth <= case when n % 4 = 3 then (n + 1) / 2e0 when n % 4 = 1 then (n - 1) / 2e0 else n / 2e0 end"),
    "largest_contour": ("L10", ["detections"], "with r as (select image_id, det_id, row_number() over (partition by image_id order by (x2 - x1) * (y2 - y1) desc, det_id) as nth from detections) select image_id, det_id from r where nth = 1"),
    "text_limits": ("L11", [], "select doc_id, substr(text, 1, 800) as head, length(substr(text, 1, 2000)) as logged from documents"),
    # Set operations
    "engagement": ("U01", ["detections"], "with f as (select image_id, det_id, conf < 0.7e0 as low, det_id % 3 = 0 as corrected, det_id % 5 = 0 as rejected from detections), a as (select image_id, sum(case when low then 1 else 0 end) as n_low, sum(case when low and (corrected or rejected) then 1 else 0 end) as acted, max(case when corrected or rejected then 1 else 0 end) as any_change from f group by image_id) select image_id, case when n_low = 0 then 1e0 when acted > 0 then round(acted * 1e0 / n_low, 6) when any_change = 1 then 0.5e0 else 0e0 end as smart_corrections from a"),
    "label_dedup": ("U02", ["detections"], "select distinct image_id, cls, x1 - x1 % 40 as gx, y1 - y1 % 40 as gy from detections"),
    "edge_dedup": ("U03", ["detections"], "with e as (select image_id, det_id, cls as a, (cls * 5 + det_id) % 12 as b from detections), k as (select *, row_number() over (partition by image_id, least(a, b), greatest(a, b) order by det_id) as nth from e) select image_id, a, b from k where nth = 1"),
    "union_splits": ("U04 U06", ["detections"], "select image_id, det_id, 'image' as kind from detections where image_id % 3 = 0 union all select image_id, det_id, 'video' as kind from detections where image_id % 3 = 1"),
    "shape_intersection": ("U05", ["detections", "ground_truth"], "select a.image_id, a.det_id from detections a join ground_truth b on a.image_id = b.image_id and a.det_id = b.gt_id and a.cls = b.cls and a.x2 - a.x1 = b.x2 - b.x1 and a.y2 - a.y1 = b.y2 - b.y1 where a.cls not in (3, 7)"),
    "power_nodes": ("U07 M05", ["netlist_lines"], "with n as (select image_id, lower(split_part(line, ' ', 3)) as node from netlist_lines where substr(line, 1, 1) <> '*') select image_id, max(case when node in ('vdd', 'vcc', 'vss', 'vee', 'avdd', 'dvdd', 'v+', 'v-') then 1 else 0 end) = 1 as has_power, max(case when node = '0' then 1 else 0 end) = 1 as has_ground, case when max(case when node in ('vdd', 'vcc', 'vss', 'vee', 'avdd', 'dvdd', 'v+', 'v-') then 1 else 0 end) = 1 then 0.7e0 else 0.3e0 end as literal_match, case max(case when node in ('vdd', 'vcc', 'vss', 'vee', 'avdd', 'dvdd', 'v+', 'v-') then 1 else 0 end) + max(case when node = '0' then 1 else 0 end) when 2 then 1e0 when 1 then 0.7e0 else 0.3e0 end as intended_match from n group by image_id"),
    "component_diff": ("U08", ["detections", "ground_truth"], "with e as (select distinct image_id, cls from ground_truth), f as (select image_id, cls, count(*) as n from detections group by image_id, cls) select coalesce(e.image_id, f.image_id) as image_id, coalesce(e.cls, f.cls) as cls, case when f.cls is null then 'missing' when e.cls is null then 'extra' when f.n > 1 then 'duplicate' else 'match' end as status from e full outer join f on e.image_id = f.image_id and e.cls = f.cls"),
    "required_keys": ("U10", ["detections"], "with k as (select distinct image_id, case cls % 7 when 0 then 'train' when 1 then 'test' when 2 then 'val' when 3 then 'nc' when 4 then 'names' else 'path' end as name from detections), r as (select name from (values ('train'), ('test'), ('val'), ('nc'), ('names')) as t(name)) select k.image_id, cast(count(r.name) as bigint) as found, count(r.name) = (select count(*) from r) as complete from k left join r on k.name = r.name group by k.image_id"),
    "connected_nodes": ("U09", ["detections"], "select image_id, cls, count(distinct case when det_id % 4 <> 0 then x1 % 5 end) as nodes from detections group by image_id, cls"),
    # Text
    "clean_str": ("T15", [], "select page_id, regexp_replace(url, '[|@#!¡·$€%&()=?¿^*;:,¨´><+/]', '_', 'g') as clean from pages"),
    "log_diagnosis": ("T11 T12", ["detections"], "with l as (select image_id, det_id, case cls % 6 when 0 then 'Error: unknown parameter' when 1 then 'Fatal: singular matrix' when 2 then 'warning: node is floating' when 3 then 'Error: undefined node n1' when 4 then 'no DC path to ground' else 'ok' end as log from detections) select image_id, det_id, lower(log) like '%unknown parameter%' or lower(log) like '%unknown device%' as bad_model, lower(log) like '%node is floating%' or lower(log) like '%floating node%' as floating, lower(log) like '%singular matrix%' as singular, lower(log) like '%undefined node%' as undefined, lower(log) like '%no dc path%' as no_path, case when lower(log) like '%error%' or lower(log) like '%fatal%' then concat('ngspice: ', log) end as error_line from l"),
    "caption": ("T19 K20", ["detections", "classes"], f"with t as (select image_id, ctype, count(*) as n from ({TYPED}) s group by image_id, ctype) select image_id, ctype, concat(cast(n as varchar(9)), ' ', ctype, case when n > 1 then 's' else '' end) as phrase from t"),
    "issue_list": ("T21 T22", ["detections"], "with s as (select image_id, det_id, concat('train/', cast(cls as varchar(3)), '_batch', cast(det_id as varchar(9)), '.jpg') as k from detections) select image_id, det_id, split_part(k, '/', 1) as title, split_part(k, '/', 2) as series, cast(split_part(split_part(k, 'batch', 2), '.', 1) as bigint) as batch from s"),
    "project_name": ("T25", [], "select doc_id, case when source is null then source when substr(source, 1, 4) = 'src1' then concat(source, '-Classify') when source like '%9' then concat(source, '-Segment') else source end as project from documents"),
    # Scoring
    "difficulty": ("M01", ["samples"], f"with d as ({DIFFICULTY}) select sample_id, round(component_difficulty, 6) as component_difficulty, round(wire_difficulty, 6) as wire_difficulty, round(node_difficulty, 6) as node_difficulty, round(topology_difficulty, 6) as topology_difficulty, round(overall, 6) as overall, stage from d"),
    "agent1_metrics": ("M03", ["detections", "classes"], f"with t as ({TYPED}), f as (select image_id, ctype, conf < 0.7e0 as low, det_id % 3 = 0 as corrected, det_id % 4 = 0 as rejected, det_id % 4 <> 0 and det_id % 7 <> 0 as kept from t), a as (select image_id, count(*) as n, sum(case when rejected then 1 else 0 end) as n_rejected, sum(case when kept then 1 else 0 end) as n_kept, sum(case when low then 1 else 0 end) as n_low, sum(case when low and (corrected or rejected) then 1 else 0 end) as acted, max(case when corrected or rejected then 1 else 0 end) as any_change, max(case when kept and ctype in ('Ground', 'VDD', 'Voltage_Source', 'Current_Source') then 1 else 0 end) as has_reference from f group by image_id) select image_id, round((n_kept + n_rejected) * 1e0 / greatest(n, 1), 6) as coverage, case when n_low = 0 then 1e0 when acted > 0 then round(acted * 1e0 / n_low, 6) when any_change = 1 then 0.5e0 else 0e0 end as smart_corrections, case when 1e0 * n_rejected / greatest(n, 1) <= 0.5e0 then 1e0 else round(greatest(0e0, 1 - (1e0 * n_rejected / n - 0.5e0) * 2), 6) end as rejection_sanity, case when has_reference = 1 then 1e0 else 0.5e0 end as type_completeness from a"),
    "agent2_metrics": ("M04", ["segments"], "with c as (select image_id, count(*) as lines, sum(case when seg_id % 3 <> 0 then 1 else 0 end) as wires, sum(case when seg_id % 5 = 0 then 1 else 0 end) as rejected, sum(case when seg_id % 2 = 0 then 1 else 0 end) as parts, max(case when x1 % 8 = 0 then 1 else 0 end) as has_ground, max(case when y1 % 8 in (1, 2) then 1 else 0 end) as has_power from segments group by image_id), r as (select *, case when parts > 0 then 1e0 * wires / parts end as ratio from c) select image_id, round((wires + rejected) * 1e0 / greatest(lines, 1), 6) as coverage, round(case when ratio is null then 0.5e0 when ratio between 0.5e0 and 5 then 1e0 when ratio < 0.5e0 then ratio * 2 else greatest(0.5e0, 1 - (ratio - 5) / 10) end, 6) as wire_ratio, round(0.6e0 * has_ground + 0.4e0 * has_power, 6) as essential_nodes, case when lines = 0 then 0.5e0 when 1e0 * rejected / lines between 0.05e0 and 0.8e0 then 1e0 when 1e0 * rejected / lines < 0.05e0 then 0.8e0 else greatest(0.3e0, 1 - 1e0 * rejected / lines) end as filter_sanity from r"),
    "judge_verdict": ("M06 M07", ["detections"], "with c as (select image_id, max(case when cls = 7 then 1 else 0 end) as c1, min(case when conf < 0.01e0 then 0 else 1 end) as c2, max(case when cls = 3 then 1 else 0 end) as c3, max(case when cls = 9 then 1 else 0 end) as c4, max(case when cls = 10 then 1 else 0 end) as c5 from detections group by image_id), s as (select *, case c3 + c4 + c5 when 3 then 1e0 when 2 then 0.8e0 when 1 then 0.5e0 else 0.2e0 end as confidence from c) select image_id, confidence, case when c1 = 0 or c2 = 0 then 'FAIL' when confidence >= 0.8e0 then 'PASS' else 'FAIL' end as verdict, c1 = 1 and c2 = 1 and confidence >= 0.96e0 as passes_gate from s"),
    "review_reasons": ("M08 M09", ["stage_results"], "with b as (select image_id, stage, max(score) as best from stage_results group by image_id, stage) select image_id, stage, case when best < 0.5e0 then 'below minimum viable' when best < 0.9e0 then 'below pass threshold' end as reason, best >= 0.7e0 as on_target from b"),
    "divisible": ("M10", ["detections"], "select image_id, det_id, cast(ceil((x2 - x1) / 32e0) * 32 as bigint) as w32, greatest(cast(ceil((y2 - y1) / 32e0) * 32 as bigint), 64) as h32 from detections"),
    "losses_on_logits": ("M12", ["detections"], "with z as (select image_id, det_id, conf * 4 - 2 as x, case when cls % 2 = 0 then 0.95e0 else 0.05e0 end as t from detections), p as (select *, 1 / (1 + exp(-x)) as p, greatest(x, 0e0) - x * t + ln(1 + exp(-abs(x))) as bce from z) select image_id, det_id, round(bce, 6) as bce, round(bce * (t * 0.25e0 + (1 - t) * 0.75e0) * power(1 - (t * p + (1 - t) * (1 - p)), 1.5e0), 6) as focal, round(bce * power(abs(t - p), 1.5e0), 6) as q_focal from p"),
    "image_hash": ("M15", [], "select doc_id, substr(md5(text), 1, 16) as image_hash from documents"),
    "dataset_rank": ("D24", ["samples"], f"select quality_tier, cast({TIER} as bigint) as rank, count(*) as n from samples group by quality_tier"),
    # Time
    "run_times": ("Y03", [], "select user_id, count(*) as n, cast(max(floor(epoch(ts))) - min(floor(epoch(ts))) as bigint) as elapsed_s, cast(floor((max(floor(epoch(ts))) - min(floor(epoch(ts)))) / 86400) as bigint) as age_days from events group by user_id"),
    # Splits
    "autosplit": ("R02 K17", [], "with h as (select doc_id, cast(doc_id * 2654435761 % 4294967296 as double) / 4294967296 as u from documents) select doc_id, case when u < 0.9e0 then 'train' when u < 1.0e0 then 'val' else 'test' end as split from h"),
    "repeat_epochs": ("R04", ["samples"], "select sample_id, e.epoch from samples cross join (values (0), (1), (2)) as e(epoch)"),
    # Graph
    "degrees": ("G02", ["segments"], "with e as (select image_id, x1 % 8 as a, y1 % 8 as b from segments), v as (select image_id, a as n from e union all select image_id, b as n from e), d as (select image_id, n, count(*) as degree from v group by image_id, n) select image_id, max(degree) as max_degree, round(avg(cast(degree as double)), 6) as avg_degree, cast(sum(case when degree < 2 then 1 else 0 end) as bigint) as hanging from d group by image_id"),
    "adjacency": ("G03", ["segments"], "with e as (select distinct image_id, x1 % 8 as a, y1 % 8 as b from segments), v as (select image_id, a, b from e union select image_id, b as a, a as b from e) select image_id, a, count(*) as neighbours, min(b) as first_neighbour, max(b) as last_neighbour from v group by image_id, a"),
    # Sinks as rows
    "yolo_values": ("K08 K12", ["detections"], "select image_id, det_id, cls, round((x1 + x2) / 2e0 / 640, 9) as x, round((y1 + y2) / 2e0 / 480, 9) as y, round((x2 - x1) / 640e0, 9) as w, round((y2 - y1) / 480e0, 9) as h from detections"),
    "difficulty_manifest": ("K10", ["samples"], f"with d as ({DIFFICULTY}), s as (select * from (values (1, 'easiest', 0.2e0), (2, 'easy', 0.4e0), (3, 'medium', 0.6e0), (4, 'hard', 0.8e0), (5, 'hardest', 1e0)) as t(stage, name, threshold)) select s.stage, s.name, s.threshold, count(d.sample_id) as samples, min(d.sample_id) as first_sample from s left join d on s.stage = d.stage group by s.stage, s.name, s.threshold"),
    "detection_views": ("K19", ["detections"], "select image_id, det_id, x1 as xmin, y1 as ymin, (x1 + x2) / 2e0 as xcenter, (y1 + y2) / 2e0 as ycenter, round(x1 / 640e0, 9) as xminn, round((x1 + x2) / 2e0 / 640, 9) as xcentern, conf as confidence, cls as class_ from detections"),
    "crop_boxes": ("K21", ["detections"], f"select image_id, det_id, {TRUNC.format('(x1 + x2) / 2e0 - ((x2 - x1) * 1.2e0 + 3) / 2')} as cx1, {TRUNC.format('(y1 + y2) / 2e0 + ((y2 - y1) * 1.2e0 + 3) / 2')} as cy2, concat(cast(cls as varchar(3)), '/', cast(image_id as varchar(12)), '_', cast(det_id as varchar(9)), '.jpg') as path from detections"),
    "flatten_files": ("K23", [], "with f as (select doc_id, concat(cast(doc_id % 50 as varchar(9)), '.jpg') as file from documents), r as (select *, row_number() over (partition by file order by doc_id desc) as nth from f) select file, doc_id from r where nth = 1"),
    "description_lines": ("K03 K07", ["detections", "classes"], f"with t as ({TYPED}) select image_id, det_id, concat('- ', ctype, ' ', cast(det_id as varchar(9)), ': (', cast(x1 as varchar(9)), ', ', cast(y1 as varchar(9)), ') to (', cast(x2 as varchar(9)), ', ', cast(y2 as varchar(9)), ')') as line from t"),
    "output_paths": ("K04", ["detections"], "select i.image_id, p.product, concat('out/', p.product, '/', cast(i.image_id as varchar(12)), p.ending) as path from (select distinct image_id from detections) i cross join (values ('images', '.png'), ('spice', '.sp'), ('captions', '.txt'), ('detection', '.json'), ('agents', '.json')) as p(product, ending)"),
    "flow_log": ("K07", ["stage_results"], "select image_id, stage, concat('## ', stage, ': ', cast(count(*) as varchar(9)), ' iterations, ', cast(cast(sum(tokens) as bigint) as varchar(12)), ' tokens') as line from stage_results group by image_id, stage"),
    "batch_summary": ("K06", ["stage_results"], "select stage, count(*) as n, count(distinct image_id) as images, cast(sum(tokens) as bigint) as tokens, round(avg(score), 6) as mean_score, max(score) as best_score from stage_results group by stage"),
    "evolution_best": ("K15", [], "with r as (select user_id, event_id, value, row_number() over (partition by user_id order by value desc, event_id) as nth from events) select user_id, event_id from r where nth = 1"),
    "dataset_stats": ("K16", ["detections"], "select case image_id % 3 when 0 then 'train' when 1 then 'val' else 'test' end as split, cls, count(*) as instances, count(distinct image_id) as images from detections group by case image_id % 3 when 0 then 'train' when 1 then 'val' else 'test' end, cls"),
    "label_histogram": ("K25 A24", ["detections"], "select cast(floor(x1 / 40e0) as bigint) as bx, cast(floor(y1 / 40e0) as bigint) as by_, count(*) as n from detections group by cast(floor(x1 / 40e0) as bigint), cast(floor(y1 / 40e0) as bigint)"),
    "judge_retry": ("I02", ["stage_results"], "with a as (select *, score >= 0.96e0 as passes from stage_results where iteration <= 3), r as (select *, row_number() over (partition by image_id, stage order by case when passes then 0 else 1 end, case when passes then iteration end, score desc, iteration) as nth from a) select image_id, stage, iteration, score, passes from r where nth = 1"),
    "class_ids": ("N02", [], "select p_type as name, cast(dense_rank() over (order by p_type) - 1 as int) as cls from (select distinct p_type from part) t"),
    "netlist_sections": ("T06", ["netlist_lines"], "select image_id, det_id, case when substr(line, 1, 1) = '*' then 'comment' when substr(line, 1, 1) in ('V', 'I') then 'sources' when substr(line, 1, 1) in ('M', 'Q', 'D') then 'devices' else 'passives' end as section, line from netlist_lines"),
    "class_statistics": ("K02", ["detections", "classes"], f"with t as ({TYPED}) select image_id, ctype, count(*) as n, count(distinct x1 % 5) as nets from t group by image_id, ctype"),
}


def sql_for(name: str, engine: str) -> tuple[list[str], str]:
    """Views and text of a query; only back-references, flags and epochs differ by engine."""
    _, views, text = PORTABLE[name]
    if engine == "spark":
        return views, text.replace("'{1}'", "'$1'").replace("'_', 'g')", "'_')").replace("epoch(ts)", "unix_timestamp(ts)")
    return views, text.replace("'{1}'", "'\\1'")
