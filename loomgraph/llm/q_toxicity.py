"""Toxicity scores of all documents, learned on two folds of three."""

from pyspark.sql import functions as F

from loomgraph.llm.common import table
from loomgraph.llm.toxicity import fit, score_toxicity

NAME = "op1_toxicity"
THRESHOLD = 0.7


def query(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    model = fit(docs, table(spark, sf_dir, "labels"))
    held_out = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(3)) == 1
    return score_toxicity(docs.select("doc_id", "text"), model).select(
        "doc_id",
        held_out.alias("held_out"),
        F.col("tox_score").alias("score"),
        (F.col("tox_score") >= THRESHOLD).cast("int").alias("predicted"),
        F.col("tox_clauses").alias("clauses"),
    )
