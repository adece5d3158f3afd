"""Column functions over model replies and netlists; all stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

FENCE = chr(96) * 3
DECISIONS = "struct<decisions: array<struct<idx: bigint, keep: boolean, type: string, corrected: boolean, reason: string>>>"


def fenced_block(text: Column) -> Column:
    """First fenced block, trimmed, language tag included; null where there is none."""
    return F.nullif(F.trim(F.regexp_extract(text, f"(?s){FENCE}(.*?){FENCE}", 1), F.lit(" \n\r\t")), F.lit(""))


def reply_json(text: Column) -> Column:
    """Body of a fenced json block, else the outermost braces, else null."""
    fenced = F.regexp_extract(text, f"(?s){FENCE}(?:json)?\\s*(\\{{.*?\\}})\\s*{FENCE}", 1)
    braces = F.regexp_extract(text, r"(?s)(\{.*\})", 1)
    return F.coalesce(F.nullif(fenced, F.lit("")), F.nullif(braces, F.lit("")))


def decisions(text: Column) -> Column:
    """Decisions of a reply: from an object, else from a bare array, else null (keep all)."""
    array_kind = DECISIONS[DECISIONS.index("array") : -1]
    bare = F.from_json(F.regexp_extract(text, r"(?s)(\[.*\])", 1), array_kind)
    return F.coalesce(F.from_json(reply_json(text), DECISIONS)["decisions"], bare)


def _lines(code: Column) -> Column:
    return F.transform(F.split(code, "\n"), lambda x: F.trim(x))


def component_lines(code: Column) -> Column:
    """Lines that a simulator reads as components."""
    return F.filter(_lines(code), lambda x: (x != "") & ~x.startswith("*") & ~x.startswith("."))


def component_count(code: Column) -> Column:
    """Component lines whose first letter names a device."""
    return F.size(F.filter(component_lines(code), lambda x: x.rlike("^[RCLMQVIDrclmqvid]"))).cast("long")


def netlist_nodes(code: Column) -> Column:
    """Distinct node tokens: places 1 to 4 of lines with three or more tokens.

    Tokens of hexadecimal letters and signs count unless they are plain
    numbers, others only if alphanumeric; the token ``0`` is therefore no node.
    """
    tokens = F.transform(component_lines(code), lambda x: F.split(x, r"\s+"))
    long = F.filter(tokens, lambda t: F.size(t) >= 3)
    places = F.flatten(F.transform(long, lambda t: F.slice(t, 2, 4)))
    hexish = lambda p: ~p.rlike("[g-wyzG-WYZ]")
    number = lambda p: F.translate(p, ".-+", "").rlike("^[0-9]+$")
    return F.array_sort(F.array_distinct(F.filter(places, lambda p: (hexish(p) & ~number(p)) | (~hexish(p) & p.rlike("^[A-Za-z0-9]+$")))))


def syntax_score(code: Column) -> Column:
    """0.3 for an end line, 0.3 for ground, 0.4 for a component line."""
    ground = code.contains(" 0 ") | code.contains("\t0\t")
    lines = F.exists(F.split(code, "\n"), lambda x: (F.trim(x) != "") & ~x.startswith("*") & ~x.startswith("."))
    part = lambda c, v: F.when(c, v).otherwise(0.0)
    return part(F.lower(code).contains(".end"), 0.3) + part(ground, 0.3) + part(lines, 0.4)


def spice_fallback(text: Column) -> Column:
    """Netlist of a reply: a fenced block, else the lines that look like one, else null."""
    fenced = F.regexp_extract(text, f"(?is){FENCE}(?:spice|ngspice|netlist)?\\s*(.*?)\\s*{FENCE}", 1)
    looks = F.array_join(F.filter(_lines(text), lambda x: x.rlike(r"^[RCLMQVIDrclmqvid*.]")), "\n")
    return F.coalesce(F.nullif(fenced, F.lit("")), F.nullif(looks, F.lit("")))


def issue_list(value: Column) -> Column:
    """Issues of a reply as strings: a JSON list without its empty entries, a string as the only one, else none.

    Empty are null, "", 0, false, [] and {}; entries that are no strings keep their JSON text.
    """
    entries = F.filter(F.from_json(value, "array<string>"), lambda x: x.isNotNull() & ~x.isin("", "0", "0.0", "false", "[]", "{}"))
    text = F.from_json(F.concat(F.lit('{"v": '), value, F.lit("}")), "v string")["v"]
    none = F.array().cast("array<string>")
    return F.when(F.trim(value).startswith("["), F.coalesce(entries, none)).when(F.trim(value).startswith('"') & (text != ""), F.array(text)).otherwise(none)


def coordinates(text: Column) -> Column:
    """All ``(x, y)`` pairs of whole numbers in a text, in order, as an array of structs."""
    places = r"\((\d+),\s*(\d+)\)"
    x, y = (F.regexp_extract_all(text, F.lit(places), F.lit(i)) for i in (1, 2))
    return F.zip_with(x, y, lambda a, b: F.struct(a.cast("long").alias("x"), b.cast("long").alias("y")))


def run_stamp(ts: Column) -> Column:
    """Second of a time as the suffix of a run's name."""
    return F.date_format(ts, "yyyyMMdd_HHmmss")


def iso_second(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss")


def plain_date(ts: Column) -> Column:
    """Year, month and day without leading zeros."""
    return F.concat_ws("-", F.year(ts), F.month(ts), F.day(ts))


def data_url(binary: Column, kind: str = "image/png") -> Column:
    """Binary content as a data URL; the line breaks that Spark puts after 76 characters are taken out."""
    return F.concat(F.lit(f"data:{kind};base64,"), F.replace(F.base64(binary), F.lit("\r\n"), F.lit("")))


# Spellings of pre-releases, in their order.
PRE_RELEASES = {"a": 0, "alpha": 0, "b": 1, "beta": 1, "c": 2, "rc": 2, "pre": 2, "preview": 2}
_VERSION = r"(?i)^\s*v?(?:([0-9]+)!)?([0-9]+(?:\.[0-9]+)*)(?:[-_.]?(alpha|beta|preview|pre|rc|a|b|c)[-_.]?([0-9]*))?(?:-([0-9]+)|[-_.]?(post|rev|r)[-_.]?([0-9]*))?(?:[-_.]?(dev)[-_.]?([0-9]*))?(?:\+([a-z0-9]+(?:[-_.][a-z0-9]+)*))?\s*$"


def version_key(version: Column) -> Column:
    """A struct that sorts version texts: epoch, release, pre-, post- and development release, local label.

    Zeros at a release's end count for nothing, a development release comes before
    its pre-releases, these before the release, post-releases behind it; numbers
    in local labels come behind words.  Null for what is no version.
    """
    part = lambda i: F.regexp_extract(version, _VERSION, i)
    number = lambda text, absent: F.when(text == "", F.lit(absent)).otherwise(text.try_cast("bigint"))
    release = F.transform(F.split(F.regexp_replace(part(2), r"(\.0+)+$", ""), r"\."), lambda x: x.try_cast("bigint"))
    kinds = F.create_map(*[F.lit(x) for item in PRE_RELEASES.items() for x in item])
    has_post, has_dev = (part(5) != "") | (part(6) != ""), part(8) != ""
    pre = F.when(part(3) != "", F.try_element_at(kinds, F.lower(part(3)))).when(~has_post & has_dev, -1).otherwise(len(PRE_RELEASES))
    post = F.when(part(5) != "", part(5).try_cast("bigint")).when(part(6) != "", number(part(7), 0)).otherwise(-1)
    dev = F.when(has_dev, number(part(9), 0)).otherwise((1 << 63) - 1)
    labels = F.when(part(10) == "", F.array().cast("array<string>")).otherwise(F.split(F.lower(part(10)), "[-_.]"))
    local = F.transform(labels, lambda x: F.struct(F.coalesce(x.try_cast("bigint"), F.lit(-1)).alias("n"), F.when(x.rlike("^[0-9]+$"), "").otherwise(x).alias("word")))
    key = F.struct(number(part(1), 0).alias("epoch"), release.alias("release"), pre.alias("pre"), number(part(4), 0).alias("pre_n"), post.alias("post"), dev.alias("dev"), local.alias("local"))
    return F.when(version.rlike(_VERSION), key)


def meets_version(current: Column, minimum: Column, pinned: bool = False) -> Column:
    """Whether a version is at least the minimum, or with ``pinned`` the same; null where one is no version."""
    a, b = version_key(current), version_key(minimum)
    return a == b if pinned else a >= b


def has_suffix(path: Column, suffixes: tuple[str, ...]) -> Column:
    """Whether a path ends in one of the suffixes, with their dot and in lower case, or in none at all."""
    found = F.lower(F.regexp_extract(path, r"[^./][^/]*?(\.[^./]+)$", 1))
    return (found == "") | found.isin(*suffixes)


def is_ascii(text: Column) -> Column:
    """Whether all characters are ASCII."""
    return F.octet_length(text) == F.length(text)


def has_chinese(text: Column) -> Column:
    """Whether a text holds a character from U+4E00 to U+9FFF."""
    return text.rlike("[一-鿿]")
