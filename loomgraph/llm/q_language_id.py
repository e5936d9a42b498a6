"""Languages of all documents, learned on four folds of five."""

from pyspark.sql import functions as F

from loomgraph.llm.common import crc_mod, table
from loomgraph.llm.language_id import fit, identify

NAME = "op9_language_id"


def query(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    model = fit(docs.filter(crc_mod("doc_id", 5) != 0).select("doc_id", "text", "lang"))
    return identify(docs.select("doc_id", "text"), model).select(
        "doc_id",
        (crc_mod("doc_id", 5) == 0).alias("held_out"),
        F.coalesce("language", F.lit("und")).alias("lang_pred"),
        F.col("language_score").alias("score"),
        F.col("language_rejected").alias("rejected"),
    )
