"""The whitened components of all embeddings. An eigendecomposition is beyond SQL; numpy's is the test."""

from loomgraph.llm.common import table
from loomgraph.llm.whitening import whiten

NAME = "op13_whitening"


def query(spark, sf_dir):
    return whiten(table(spark, sf_dir, "embeddings"), keep=("vec_id",))
