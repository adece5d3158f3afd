"""A corpus pipeline of five stages over ``documents``.

Every stage takes ``(spark, docs, sf_dir)``; its result is written as Parquet
and read again as the next one's ``docs``.  Columns that a stage does not need
pass through unchanged.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from netloom.llm.language import UNDETERMINED, held_out, identify_language, train_prototypes
from netloom.llm.mixing import mixed_documents
from netloom.llm.packing import best_fit_packing
from netloom.llm.shingle_join import jaccard_components
from netloom.llm.suffix_dedup import remove_repeats
from netloom.plans.shared import materialize, quoted


def _unused(docs: DataFrame, *names: str) -> tuple[str, ...]:
    """``names`` with as many underscores before them as keep them apart from the columns of ``docs``."""
    while set(names) & set(docs.columns):
        names = tuple(f"_{n}" for n in names)
    return names


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep documents whose language can be told; null texts and those without letters go.

    A document without a language gets the one predicted.
    """
    prototypes = train_prototypes(docs.where(~held_out()).where("doc_id is not null"))
    names = _unused(docs, "lang_pred", "score")
    known = identify_language(docs, prototypes, names=names)
    told = known.where(F.col(names[0]) != UNDETERMINED).withColumn("lang", F.coalesce("lang", names[0]))
    return told.select(*[F.col(quoted(c)) for c in docs.columns])


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each component of near-duplicates, that with the smallest id.

    Every row is a document of its own.  Where ids are null or repeated, rows are
    numbered in a written copy first; null ids then come last, equal ones by number.
    """
    if not docs.groupBy("doc_id").count().where("count > 1 or doc_id is null").limit(1).count():
        found = materialize(jaccard_components(docs), "near-duplicates")
        gone = found.where("doc_id <> component_id").select(F.col("doc_id").alias("_id"))
        return docs.join(gone, docs["doc_id"] == gone["_id"], "left_anti")
    (row,) = _unused(docs, "row")
    numbered = materialize(docs.withColumn(row, F.monotonically_increasing_id()), "numbered")
    found = jaccard_components(numbered, row).withColumnRenamed("doc_id", row)
    placed = materialize(found.join(numbered.select(row, "doc_id"), row).withColumn("order", F.struct(F.col("doc_id").isNull(), "doc_id", row)), "near-duplicates")
    first = placed.groupBy("component_id").agg(F.min("order").alias("first"))
    gone = placed.join(first, "component_id").where(F.col("order") != F.col("first")).select(row)
    return numbered.join(gone, row, "left_anti").drop(row)


def repeat_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Remove repeated 100-byte strings; a text that was null stays null, ``n_chars`` follows the text."""
    prefix = "repeats_"
    while any(c.startswith(prefix) for c in docs.columns):
        prefix = f"_{prefix}"
    cut = remove_repeats(docs, keep=docs.columns, prefix=prefix)
    cut = cut.withColumn("text", F.when(F.col("text").isNotNull(), F.col(f"{prefix}kept_text")))
    if "n_chars" in docs.columns:
        cut = cut.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return cut.select(*[F.col(quoted(c)) for c in docs.columns])


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Take every document as often as the mix takes it."""
    return mixed_documents(docs)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pack all documents of the mix into sequences of 1024 tokens."""
    return best_fit_packing(docs, public_tokenizers.path("byte_bpe_50k.json"), 2, 1024)


STAGES = [
    ("language_id", language_stage),
    ("ngram_jaccard_join", near_duplicate_stage),
    ("suffix_array_dedup", repeat_stage),
    ("source_mixing", mixing_stage),
    ("best_fit_packing", packing_stage),
]
#: SQL expresses neither profiles nor tokenizers; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply all stages to ``documents``; the rows of the last."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
