"""Mix sources to target weights with nested hash-threshold histograms.

Nothing is sorted.  A document's place is a 60-bit hash of its key.  A first
histogram of words by source and leading hash bits shows in which bucket each
source's budget ends; only documents of that bucket are counted again by the
next bits, until the bucket is one hash value; then one filter decides.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from netloom.plans.shared import materialize, quoted

#: Bits of the hash, and bits that one histogram resolves.
HASH_BITS, STEP_BITS = 60, 12
WEIGHTS = (5, 2, 1)
MOST_REPEATS = 3
_WHITE = "\\x20\\x09-\\x0D"


def word_count(text: Column) -> Column:
    """Number of runs of characters that are not ASCII white space; null gives 0."""
    parts = F.split(text, f"[{_WHITE}]+")
    ends = F.when(F.element_at(parts, 1) == "", 1).otherwise(0) + F.when((F.size(parts) > 1) & (F.element_at(parts, -1) == ""), 1).otherwise(0)
    return F.when(text.isNull(), F.lit(0)).otherwise(F.size(parts) - ends).cast("long")


def place(key: Column) -> Column:
    """60-bit hash of a key's text: the leading 15 hexadecimal digits of its MD5."""
    digits = F.substring(F.md5(F.coalesce(key.cast("string"), F.lit("null")).cast("binary")), 1, 15)
    return F.conv(digits, 16, 10).cast("long")


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST_REPEATS) -> DataFrame:
    """Water-filled targets from ``source, source_size``; one row for each source.

    Sources by code point, null last, take the weights in turn.  Targets that
    exceed ``most`` times their source stop there and the rest is shared again.
    With total T the level L solves sum(min(w*L, most*s)) = T; sources saturate
    in the order of most*s/w, so one ordered pass over the sources finds it.
    """
    order = Window.orderBy(F.col("source").isNull(), "source")
    w = F.element_at(F.array(*map(F.lit, weights)), (F.pmod(F.row_number().over(order) - 1, F.lit(len(weights))) + 1).cast("int")).cast("double")
    ranked = sizes.withColumn("weight", w).withColumn("cap", F.col("source_size").cast("double") * most)
    by_level = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").isNull(), "source")
    before, all_rows = by_level.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy()
    rest = (
        ranked.withColumn("total", F.sum("source_size").over(all_rows).cast("double"))
        .withColumn("full", F.coalesce(F.sum("cap").over(before), F.lit(0.0)))
        .withColumn("open", F.sum("weight").over(by_level.rowsBetween(0, Window.unboundedFollowing)))
        .withColumn("level", (F.col("total") - F.col("full")) / F.col("open"))
        .withColumn("stops", F.col("level") * F.col("weight") > F.col("cap"))
    )
    final = rest.withColumn("share", F.max(F.when(~F.col("stops"), F.col("level"))).over(all_rows))
    return final.select("source", "source_size", F.when(F.col("stops"), F.col("cap")).otherwise(F.least("cap", F.col("share") * F.col("weight"))).alias("target"))


def _digest(docs: DataFrame, id_col: str, text_col: str, source_col: str) -> DataFrame:
    key, text, source = (F.col(quoted(c)) for c in (id_col, text_col, source_col))
    return docs.select(key.alias("doc_id"), source.alias("source"), word_count(text).alias("size"), place(key).alias("place"))


def mixing_rules(digest: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST_REPEATS) -> DataFrame:
    """One row for each source: ``s, source_size, target, whole, last``.

    Every document of the source is taken ``whole`` times, and once more if its
    place is at most ``last``.
    """
    sizes = digest.groupBy("source").agg(F.sum("size").alias("source_size"))
    targets = source_targets(sizes, weights, most)
    targets = targets.withColumn("whole", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long")).withColumn(
        "budget", F.col("target") - F.col("whole") * F.col("source_size")
    )
    # prefix: leading bits of the boundary bucket; words: what lies below it.
    bound = materialize(targets.withColumns({"prefix": F.lit(0).cast("long"), "words": F.lit(0).cast("long"), "inside": F.lit(0).cast("long")}), "mix-bound")
    for shift in range(HASH_BITS - STEP_BITS, -1, -STEP_BITS):
        edge = bound.select(F.col("source").alias("s"), "prefix", "words", "budget")
        inside = digest.join(edge, digest["source"].eqNullSafe(edge["s"]) & (F.expr(f"shiftright(place, {shift + STEP_BITS})") == F.col("prefix")))
        histogram = inside.groupBy("s", F.expr(f"shiftright(place, {shift})").alias("bucket")).agg(
            F.sum("size").alias("size"), F.min("place").alias("low"), F.max("place").alias("high"), F.first("words").alias("words"), F.first("budget").alias("budget")
        )
        run = Window.partitionBy("s").orderBy("bucket")
        reached = histogram.withColumn("until", F.col("words") + F.sum("size").over(run))
        crossing = (
            reached.where(F.col("until") > F.col("budget"))
            .groupBy("s")
            .agg(F.min_by(F.struct("bucket", (F.col("until") - F.col("size")).alias("words"), F.col("size").alias("inside"), (F.col("low") == F.col("high")).alias("single"), "low"), F.col("bucket")).alias("c"))
        )
        following = materialize(
            bound.drop("prefix", "words", "inside", "single", "low")
            .join(crossing, bound["source"].eqNullSafe(crossing["s"]))
            .select(*[c for c in bound.columns if c not in ("prefix", "words", "inside", "single", "low")], F.col("c.bucket").alias("prefix"), F.col("c.words").alias("words"), F.col("c.inside").alias("inside"), F.col("c.single").alias("single"), F.col("c.low").alias("low")),
            "mix-bound",
        )
        bound = following
        if not bound.where(~F.col("single")).limit(1).count():
            break
    threshold = F.when(F.col("words") + F.col("inside") - F.col("budget") < F.col("budget") - F.col("words"), F.col("low")).otherwise(F.col("low") - 1)
    last = bound.select("source", threshold.alias("last"))
    return targets.alias("t").join(last.alias("b"), F.col("t.source").eqNullSafe(F.col("b.source")), "left").select(F.col("t.source").alias("s"), "source_size", "target", "whole", "last")


def copies_of() -> Column:
    """How often the mix takes a document, from the rules' columns and its place."""
    # Without a threshold the source is taken whole times only.
    return F.col("whole") + F.when(F.col("last").isNotNull() & (F.col("place") <= F.col("last")), 1).otherwise(0)


def mix_sources(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[int, ...] = WEIGHTS, most: int = MOST_REPEATS) -> DataFrame:
    """Return ``doc_id, size, source_size, target, taken, copies`` for every row of ``docs``.

    A source with target r times its size takes every document floor(r) times,
    and once more those whose hash lies below the threshold at which the words
    come nearest to the target.  The rows at the threshold's own hash value go
    in if that brings the sum nearer.  Rows with the same key share their place
    and fate.  Null texts have size 0, null sources are a source of their own,
    and an empty table gives an empty result.
    """
    digest = materialize(_digest(docs, id_col, text_col, source_col), "mix")
    rules = materialize(mixing_rules(digest, weights, most), "mix-rules")
    joined = digest.join(rules, digest["source"].eqNullSafe(rules["s"]))
    return joined.select("doc_id", "size", "source_size", "target", (F.col("size") * copies_of()).alias("taken"), copies_of().alias("copies"))


def mixed_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[int, ...] = WEIGHTS, most: int = MOST_REPEATS) -> DataFrame:
    """The mix itself: rows of ``docs`` as often as they are taken, rows without words left out.

    Columns pass through whatever their names are.
    """
    digest = materialize(_digest(docs, id_col, text_col, source_col), "mix")
    rules = materialize(mixing_rules(digest, weights, most), "mix-rules")
    whole = F.struct(*[F.col(quoted(c)) for c in docs.columns]).alias("row")
    has_words = F.col(quoted(text_col)).rlike(f"[^{_WHITE}]")
    placed = docs.where(has_words).select(whole, F.col(quoted(source_col)).alias("source"), place(F.col(quoted(id_col))).alias("place"))
    joined = placed.join(rules, placed["source"].eqNullSafe(rules["s"]))
    taken = joined.select("row", copies_of().cast("int").alias("copies")).where("copies > 0")
    return taken.select("row", F.explode(F.sequence(F.lit(1), F.col("copies")))).select("row.*")


def mixing_sql(docs: str, levels: int = 0) -> str:
    """DuckDB SQL for the rows of :func:`mix_sources` over the table ``docs``."""
    rounds = "\n".join(
        f"""lv{i + 1} as (select sum(case when stops then 0e0 else weight end) as open_w, sum(case when stops then cap else 0e0 end) as full_c from st{i}),
        st{i + 1} as (select s.* exclude (stops), s.stops or (s.weight * ((select total from tot) - l.full_c) / nullif(l.open_w, 0) > s.cap) as stops from st{i} s, lv{i + 1} l),"""
        for i in range(levels or 12)
    )
    n = levels or 12
    return f"""
    with d as (select doc_id, source, case when text is null then 0 else length(regexp_replace(regexp_replace(text, '[^\\x20\\x09-\\x0D]+', 'x', 'g'), '[\\x20\\x09-\\x0D]+', '', 'g')) end as size,
        cast('0x' || substr(md5(coalesce(cast(doc_id as varchar), 'null')), 1, 15) as bigint) as place from {docs}),
    ss as (select source, cast(sum(size) as bigint) as source_size from d group by source),
    tot as (select cast(sum(source_size) as double) as total from ss),
    st0 as (select source, source_size, cast(source_size as double) * 3 as cap, [5e0, 2e0, 1e0][cast((row_number() over (order by source is null, source) - 1) % 3 + 1 as int)] as weight, false as stops from ss),
    {rounds}
    lv as (select sum(case when stops then 0e0 else weight end) as open_w, sum(case when stops then cap else 0e0 end) as full_c from st{n}),
    tg as (select s.source, s.source_size, case when s.stops then s.cap else least(s.cap, s.weight * (((select total from tot) - l.full_c) / l.open_w)) end as target from st{n} s, lv l),
    tb as (select *, case when source_size > 0 then cast(floor(target / source_size) as bigint) else 0 end as whole from tg),
    tw as (select *, target - whole * source_size as budget from tb),
    pl as (select source, place, sum(size) as size from d group by source, place),
    cu as (select p.source, p.place, p.size, sum(p.size) over (partition by p.source order by p.place) as until, t.budget from pl p join tw t on p.source is not distinct from t.source),
    cr as (select source, min(place) as low, min_by(until, place) as until, min_by(size, place) as inside, min_by(budget, place) as budget from cu where until > budget group by source),
    la as (select source, case when until - budget < budget - (until - inside) then low else low - 1 end as last from cr)
    select d.doc_id, cast(d.size as bigint) as size, t.source_size, t.target, cast(d.size * (t.whole + case when la.last is not null and d.place <= la.last then 1 else 0 end) as bigint) as taken, cast(t.whole + case when la.last is not null and d.place <= la.last then 1 else 0 end as bigint) as copies
    from d join tw t on d.source is not distinct from t.source left join la on d.source is not distinct from la.source"""
