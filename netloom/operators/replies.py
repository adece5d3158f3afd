"""Netlists, prompts and message lists built from rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from netloom.functions.text import component_count, netlist_nodes, spice_fallback, syntax_score

# Names of power nodes.
POWER_NODES = ("vdd", "vcc", "vss", "vee", "avdd", "dvdd", "v+", "v-")
# Closing lines of a generated netlist.
TAIL = ["*", "* Power supply", "VDD vdd 0 1.8", "*", "* Models", ".model NMOS NMOS (VTH0=0.4)", ".model PMOS PMOS (VTH0=-0.4)", "*", ".OP", ".END"]
HEAD = ["* Auto-generated minimal netlist", "*", "* Components"]


def minimal_netlists(components: DataFrame) -> DataFrame:
    """One netlist for each image from ``image_id, det_id, ctype``, with a running node number.

    Types take one or two nodes, sources none; others give no line but keep
    their place in the numbering of devices.
    """
    kind = F.col("ctype")
    step = F.when(kind.isin("Resistor", "R", "NMOS", "MOSFET", "PMOS"), 2).when(kind.isin("Capacitor", "C", "CurrentSource", "I", "Current_Source"), 1).otherwise(0)
    order = Window.partitionBy("image_id").orderBy("det_id")
    rows = components.withColumn("i", F.row_number().over(order)).withColumn("n", 1 + F.coalesce(F.sum(step).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    i, n, m = F.col("i").cast("string"), F.concat(F.lit("n"), F.col("n").cast("string")), F.concat(F.lit("n"), (F.col("n") + 1).cast("string"))
    line = (
        F.when(kind.isin("Resistor", "R"), F.concat(F.lit("R"), i, F.lit(" "), n, F.lit(" "), m, F.lit(" 10k")))
        .when(kind.isin("Capacitor", "C"), F.concat(F.lit("C"), i, F.lit(" "), n, F.lit(" 0 1u")))
        .when(kind.isin("NMOS", "MOSFET"), F.concat(F.lit("M"), i, F.lit(" "), n, F.lit(" "), m, F.lit(" 0 0 NMOS W=1u L=180n")))
        .when(kind == "PMOS", F.concat(F.lit("M"), i, F.lit(" "), n, F.lit(" "), m, F.lit(" vdd vdd PMOS W=1u L=180n")))
        .when(kind.isin("VoltageSource", "V", "Voltage_Source"), F.concat(F.lit("V"), i, F.lit(" vdd 0 1.8")))
        .when(kind.isin("CurrentSource", "I", "Current_Source"), F.concat(F.lit("I"), i, F.lit(" vdd "), n, F.lit(" 10u")))
    )
    grouped = rows.withColumn("line", line).groupBy("image_id").agg(F.array_sort(F.collect_list(F.struct("i", "line"))).alias("rows"))
    body = F.array_compact(F.transform("rows", lambda r: r["line"]))
    text = F.array_join(F.concat(F.array(*map(F.lit, HEAD)), body, F.array(*map(F.lit, TAIL))), "\n")
    return grouped.select("image_id", text.alias("spice_code"))


def message_lists(turns: DataFrame, system: str) -> DataFrame:
    """System message and ordered turns of each conversation as one JSON array."""
    ordered = turns.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))).alias("t"))
    first = F.array(F.struct(F.lit("system").alias("role"), F.lit(system).alias("text")))
    rest = F.transform("t", lambda x: F.struct(x["role"].alias("role"), x["text"].alias("text")))
    return ordered.select("conv_id", F.to_json(F.concat(first, rest)).alias("messages"), (F.size("t") + 1).cast("long").alias("n_messages"))


def component_prompts(components: DataFrame) -> DataFrame:
    """Prompt text listing each image's components with confidence bands."""
    band = F.when(F.col("conf") >= 0.8, "HIGH").when(F.col("conf") >= 0.5, "MEDIUM").otherwise("LOW")
    line = F.format_string("[%d] %s (%s)", F.col("det_id"), F.col("ctype"), band)
    grouped = components.withColumn("line", line).groupBy("image_id").agg(F.array_sort(F.collect_list(F.struct("det_id", "line"))).alias("r"))
    return grouped.select("image_id", F.concat(F.lit("DETECTIONS:\n"), F.array_join(F.transform("r", lambda x: x["line"]), "\n")).alias("prompt"))


def first_answers(attempts: DataFrame) -> DataFrame:
    """First non-empty answer by attempt (retry loop as a table)."""
    return attempts.where(F.trim("response") != "").groupBy("request_id").agg(F.min_by("response", "attempt").alias("response"), F.min("attempt").alias("attempt"))


def netlists_of_replies(replies: DataFrame, components: DataFrame) -> DataFrame:
    """``image_id, spice_code`` of ``image_id, reply``: what the reply holds of a netlist, else one generated from the image's components."""
    generated = minimal_netlists(components).withColumnRenamed("spice_code", "generated")
    found = replies.select("image_id", spice_fallback(F.col("reply")).alias("spice_code"))
    return found.join(generated, "image_id", "left").select("image_id", F.coalesce("spice_code", "generated", F.lit("\n".join([*HEAD, *TAIL]))).alias("spice_code"))


def netlist_metrics(netlists: DataFrame, components: DataFrame, simulations: DataFrame) -> DataFrame:
    """Syntax, simulation, topology and node scores of each image's netlist.

    Topology is the share of components other than ground that the netlist has,
    0.5 where there are none; ground and a power node score 1 for both, 0.7 for
    one, 0.3 for none.  ``simulations`` has ``image_id, success``; without a row
    the run did not succeed.
    """
    expected = components.where("ctype <> 'Ground'").groupBy("image_id").agg(F.count("*").alias("expected"))
    code = F.col("spice_code")
    nodes = F.transform(netlist_nodes(code), F.lower)
    ground = F.array_contains(netlist_nodes(code), "0").cast("int")
    power = F.exists(nodes, lambda n: n.isin(*POWER_NODES)).cast("int")
    share = F.least(component_count(code), F.col("expected")) / F.col("expected")
    joined = netlists.join(expected, "image_id", "left").join(simulations.select("image_id", "success"), "image_id", "left")
    return joined.select(
        "image_id", syntax_score(code).alias("syntax_valid"), F.when(F.coalesce("success", F.lit(False)), 1.0).otherwise(0.0).alias("simulation_runs"),
        F.coalesce(share, F.lit(0.5)).alias("topology_preserved"), F.element_at(F.array(F.lit(0.3), F.lit(0.7), F.lit(1.0)), ground + power + 1).alias("node_match"),
    )
