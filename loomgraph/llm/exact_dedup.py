"""Exact deduplication: group by a 128-bit content hash, keep the smallest id, compare bytes inside groups."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomgraph.llm.common import SPACES, materialize, text_or_empty


def normalized(text: str | Column = "text") -> Column:
    """Each run of ASCII white space becomes one space; null counts as empty."""
    return F.regexp_replace(text_or_empty(text), SPACES, " ")


def md5_128(text: Column) -> Column:
    return F.unhex(F.md5(text))


def exact_dedup(docs: DataFrame, content_hash: Callable[[Column], Column] = md5_128) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when their normalised bytes are. The grouping key is (hash, normalised text), so bytes are compared
    within every hash group and colliding texts part; partial aggregation collapses hot groups of copies before the
    shuffle. Only groups of two or more travel on, without their text. Rows without doc_id form groups too; keep_id is
    then the smallest id of the group that is not null, or null. Of rows that repeat both id and text one is kept. Empty
    and null texts are one group. Columns besides doc_id and text are not read.
    """
    rows = docs.select("doc_id", normalized().alias("t"))
    hashed = rows.select("doc_id", content_hash(F.col("t")).alias("h"), F.sha2("t", 256).alias("text_sha256"))
    ids = materialize(hashed.groupBy("doc_id", "h", "text_sha256").agg(F.count(F.lit(1)).alias("n_rows")))
    groups = materialize(
        rows.groupBy(content_hash(F.col("t")).alias("h"), "t")
        .agg(F.min("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
        .filter("group_size > 1")
        .select("h", F.sha2("t", 256).alias("text_sha256"), "keep_id", "group_size")
    )
    # Both sides are tables, so the join's exchanges can be split where one group holds many rows.
    joined = ids.join(groups, ["h", "text_sha256"], "left")
    keep = F.when(F.col("group_size").isNull(), F.col("doc_id")).otherwise(F.col("keep_id"))
    return joined.select(
        "doc_id",
        keep.alias("keep_id"),
        F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"),
        F.explode(F.sequence(F.lit(1).cast("long"), "n_rows")).alias("copy_no"),
        "text_sha256",
    ).select(
        "doc_id",
        "keep_id",
        "group_size",
        (F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("copy_no") == 1)).alias("kept"),
        "text_sha256",
    )
