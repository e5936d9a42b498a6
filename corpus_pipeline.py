"""Cleaning a corpus in five stages, each over all that the one before it kept."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomgraph.llm import line_dedup as lines
from loomgraph.llm import mixing, ngram_join, packing, toxicity
from loomgraph.llm.common import materialize, table
from loomgraph.llm.q_packing import tokenizer_path

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: A document is rejected from this score on.
TOXIC = 0.7


def stage_toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents with a toxicity score of 0.7 or more; the grammar's weights are learned from the labelled originals."""
    model = toxicity.fit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return toxicity.score_toxicity(docs, model).filter(F.col("tox_score") < TOXIC).select(*COLUMNS)


def stage_line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Deletes later copies of repeated runs of lines. Documents stay, also emptied ones; n_chars follows the text."""
    out = lines.line_dedup(docs)
    return out.withColumn("n_chars", F.when(F.col("lines_deleted") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))).select(*COLUMNS)


def stage_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps of each group of near duplicates the document with the smallest id; documents without words stay.

    Rows that repeat that smallest id all stay: a row is dropped only for a smaller id.
    """
    gone = ngram_join.near_duplicates(docs).filter("component_id < doc_id").select("doc_id").distinct()
    return docs.join(materialize(gone), "doc_id", "left_anti").select(*COLUMNS)


def stage_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Takes documents as often as their source's target says, in training order: that of the rows of the table."""
    return mixing.mix(docs).select(*COLUMNS)


def in_table_order(docs: DataFrame) -> DataFrame:
    """docs, read from a table that was written range-sorted, with `order`: the number of each row in that table."""
    rows = docs.select(*docs.columns, F.col("_metadata.file_name").alias("file"), F.col("_metadata.row_index").alias("row"))
    number = F.regexp_extract("file", r"^part-(\d+)", 1).try_cast("long")
    earlier = Window.orderBy(number, "file").rowsBetween(Window.unboundedPreceding, -1)
    files = rows.groupBy("file").agg((F.max("row") + 1).alias("n"))  # one row per file: the window is small
    files = files.select("file", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"))
    return rows.join(F.broadcast(files), "file").withColumn("order", F.col("before") + F.col("row")).drop("file", "row", "before")


def stage_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs what is left, in the training order, into sequences of at most 2048 tokens; one row per piece."""
    return packing.pack(in_table_order(docs), tokenizer_path(), order="order")


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", stage_toxicity),
    ("line_dedup", stage_line_dedup),
    ("near_duplicates", stage_near_duplicates),
    ("mixing", stage_mixing),
    ("packing", stage_packing),
]

#: Learned scores and dynamic programming are beyond SQL; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over documents; each but the last is written as Parquet and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
