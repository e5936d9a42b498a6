"""All documents packed into sequences."""

from loomgraph.llm.common import table
from loomgraph.llm.packing import pack

NAME = "op2_packing"


def tokenizer_path():
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def query(spark, sf_dir):
    return pack(table(spark, sf_dir, "documents"), tokenizer_path())
