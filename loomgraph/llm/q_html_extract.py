"""Main texts of all pages."""

from pyspark.sql import functions as F

from loomgraph.llm.common import table
from loomgraph.llm.html_extract import extract

NAME = "op5_html_extract"


def query(spark, sf_dir):
    out = extract(table(spark, sf_dir, "pages").select("page_id", "url", "html"))
    return out.select("page_id", "url", F.col("main_text").alias("text"), F.length("main_text").cast("long").alias("n_chars"))
