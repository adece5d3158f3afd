"""Texts of a circuit: report, caption, netlist sections and prompts, one for each image."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Sections of a structured netlist, in order, and their headings.
SECTIONS = {"components": "* Components", "sources": "* Sources", "models": "* Models", "simulation": "* Simulation"}
# Headings of the text report.
REPORT = ("Components in the circuit are: ", "Junctions in the circuit are: ", "Connections in the circuit are: ")
# Wording of the prompts.
NETLIST_HEAD = ("Generate a SPICE netlist from this circuit topology.", "", "COMPONENTS:")
NETLIST_MIDDLE, NETLIST_TAIL = ("", "ELECTRICAL NODES:"), ("", "Generate a complete, valid SPICE netlist that will simulate successfully.")
MOST_PREVIOUS = 1000


def lines_of(rows: DataFrame, order: list[str], line: Column, name: str) -> DataFrame:
    """``image_id`` and an array ``name`` of each image's lines in order."""
    row = F.struct(*order, line.alias("_line"))
    return rows.groupBy("image_id").agg(F.transform(F.array_sort(F.collect_list(row)), lambda r: r["_line"]).alias(name))


def _none() -> Column:
    return F.array().cast("array<string>")


def captions(components: DataFrame) -> DataFrame:
    """Caption that counts each image's types, in order of their first component."""
    counts = components.groupBy("image_id", "ctype").agg(F.count("*").alias("n"), F.min("det_id").alias("first"))
    phrase = F.concat(F.col("n").cast("string"), F.lit(" "), F.col("ctype"), F.when(F.col("n") > 1, "s").otherwise(""))
    found = lines_of(counts, ["first"], phrase, "p")
    return found.select("image_id", F.concat(F.lit("Analog circuit with "), F.array_join("p", ", ")).alias("caption"))


def netlist_text(entries: DataFrame, titles: DataFrame) -> DataFrame:
    """Text of structured netlists: rows ``image_id, section, pos, line`` under the headings of all sections.

    An image of ``titles`` without a title gets "Circuit Netlist", one without
    entries headings only; lines that are null are empty.
    """
    parts = entries.groupBy("image_id").pivot("section", list(SECTIONS)).agg(F.array_sort(F.collect_list(F.struct("pos", F.coalesce("line", F.lit("")).alias("line")))))
    own = lambda s: F.coalesce(F.transform(F.col(s), lambda r: r["line"]), _none())
    head = F.array(F.concat(F.lit("* "), F.coalesce("title", F.lit("Circuit Netlist"))))
    body = [F.concat(F.array(F.lit("*"), F.lit(heading)), own(s)) for s, heading in SECTIONS.items()]
    return titles.join(parts, "image_id", "left").select("image_id", F.array_join(F.concat(head, *body), "\n").alias("spice_code"))


def marked(components: DataFrame) -> DataFrame:
    """Components with their ``mark``: the class and the number within it, from 1, in id order."""
    of_class = Window.partitionBy("image_id", "cls").orderBy("comp_id")
    return components.withColumn("mark", F.concat(F.col("cls").cast("string"), F.row_number().over(of_class).cast("string")))


def circuit_report(found: DataFrame) -> DataFrame:
    """Report of components, junctions and connections of :func:`circuits.image_circuits`, whose components have ``ctype`` and ``mark``.

    Junctions are numbered from 1, nodes of connections from 0.  A pair of nodes is told at
    most once in either order.  Components without a type are left out, as are images without any other.
    """
    node = lambda at: F.concat(F.lit("Node"), at.cast("string"))
    parts = F.transform("components", lambda c: F.concat(c["ctype"], F.lit(" "), c["mark"]))
    junctions = F.transform("nodes", lambda _, at: F.concat(F.lit("Node N"), (at + 1).cast("string")))
    between = F.transform("components", lambda c: F.when(c["ctype"].isNotNull(), F.concat(c["mark"], F.lit(" is between "), node(c["at1"]), F.lit(" and "), node(c["at2"]))))
    linked = F.transform("links", lambda l: F.when(l["first"], F.concat(node(l["at"]), F.lit(" and "), node(l["to"]), F.lit(" are connected"))))  # noqa: E741
    # Lines that are null are not joined.
    text = F.concat(*[F.concat(F.array(F.lit(h)), *own) for h, own in zip(REPORT, ([parts], [junctions], [between, linked]))])
    return found.where(F.exists("components", lambda c: c["ctype"].isNotNull())).select("image_id", F.array_join(text, "\n").alias("report"))


def connected_nodes(mapped: DataFrame) -> DataFrame:
    """Distinct nodes of each component, null ones left out."""
    nodes = F.array_sort(F.array_distinct(F.array_compact(F.array("node1", "node2"))))
    return mapped.select("image_id", "comp_id", nodes.alias("nodes"))


def connectivity_prompts(components: DataFrame, segments: DataFrame) -> DataFrame:
    """Prompt that lists an image's components and its line segments, numbered from 0."""
    c = lines_of(components, ["det_id"], F.concat(F.lit("  "), F.col("det_id").cast("string"), F.lit(": "), "ctype"), "c")
    k = F.row_number().over(Window.partitionBy("image_id").orderBy("seg_id")) - 1
    s = lines_of(segments.withColumn("k", k), ["k"], F.format_string("[%d] (%d,%d) → (%d,%d)", "k", "x1", "y1", "x2", "y2"), "s")
    both = s.join(c, "image_id", "left").withColumn("c", F.coalesce("c", _none()))
    head = F.array(F.format_string("Validate %d Hough lines.", F.size("s")), F.lit(""), F.format_string("Components: %d", F.size("c")))
    return both.select("image_id", F.concat(F.array_join(F.concat(head, "c", F.array(F.lit(""), F.lit("Hough lines:")), "s"), "\n"), F.lit("\n")).alias("prompt"))


def netlist_prompts(found: DataFrame) -> DataFrame:
    """Prompt with each component's terminals and the kind of each node of :func:`circuits.image_circuits`, whose components have ``ctype`` and nodes ``kind``.

    Components without a type are left out, as are images without any other and points without an image.
    """
    node = lambda n: F.coalesce(n.cast("string"), F.lit("unknown"))
    c = F.transform("components", lambda c: F.concat(F.lit("  "), c["id"].cast("string"), F.lit(" ("), c["ctype"], F.lit("): t1→"), node(c["node1"]), F.lit(", t2→"), node(c["node2"])))
    n = F.transform("nodes", lambda n: F.concat(F.lit("  "), n["id"].cast("string"), F.lit(" ("), n["kind"], F.lit(")")))
    fixed = lambda x: F.array(*map(F.lit, x))
    text = F.array_join(F.concat(fixed(NETLIST_HEAD), c, fixed(NETLIST_MIDDLE), n, fixed(NETLIST_TAIL)), "\n")
    told = F.col("image_id").isNotNull() & F.exists("components", lambda c: c["ctype"].isNotNull())
    return found.where(told).select("image_id", text.alias("prompt"))


def retry_prompts(prompts: DataFrame, issues: DataFrame) -> DataFrame:
    """Prompts with the errors of the last attempt and its netlist's first thousand characters.

    ``issues`` has ``image_id, errors, feedback, previous``; images without a
    row keep their prompt, blank errors are left out.
    """
    kept = F.transform(F.filter("errors", lambda e: F.trim(e) != ""), lambda e: F.concat(F.lit("  • "), e))
    part = F.concat(F.lit("\n\nERRORS FOUND:\n"), F.array_join(kept, "\n"), F.lit("\n\nFEEDBACK:\n"), F.coalesce("feedback", F.lit("")), F.lit("\n\nPREVIOUS NETLIST (FAILED):\n"), F.substring(F.coalesce("previous", F.lit("N/A")), 1, MOST_PREVIOUS))
    return prompts.join(issues, "image_id", "left").select("image_id", F.concat("prompt", F.when(F.col("errors").isNotNull(), part).otherwise("")).alias("prompt"))
