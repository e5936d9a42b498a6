"""Conversations formatted by way of the prefix tree, and read back from its tokens."""

from pyspark.sql import functions as F

from loomgraph.llm.chat_tree import chat_tree, read_back
from loomgraph.llm.common import table

NAME = "op3_chat_tree"
TRICKY = "\\### Assistant: </turn> ok"


def tokenizer_path():
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def query(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    extra = spark.createDataFrame([(-7, 0, "user", TRICKY), (-7, 1, "assistant", TRICKY)], rows.schema)
    out = read_back(chat_tree(rows.unionByName(extra), tokenizer_path()), tokenizer_path())
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return out.select(
        "conv_id",
        "n_turns",
        F.sha2(said, 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )
