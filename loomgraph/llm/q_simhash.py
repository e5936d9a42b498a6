"""Fingerprints of all documents and of their edited texts."""

from loomgraph.llm.common import table
from loomgraph.llm.simhash import fingerprint_report

NAME = "op8_simhash"


def query(spark, sf_dir):
    return fingerprint_report(table(spark, sf_dir, "documents"))
