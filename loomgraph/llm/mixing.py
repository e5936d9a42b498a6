"""Mixing sources to target weights by a time-varying curriculum, in DataFrame operations only.

A source's weight is a function of training time t in [0, 1]; its integral is the source's share. Targets are the
shares of all words, held to `max_repeats` times a source's size. Inside a source documents stand in the order of a
hash; the words before a document, over all passes, are the cumulative demand at which it is due, and the inverse of
the integrated schedule turns that demand into a training position.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomgraph.llm.common import WORDS, boxed, id_text, text_or_empty, unboxed

#: Weight at the start and at the end of training, linear between; sources take them in turn. Their means are 1, 2, 3.
SCHEDULES = ((1.5, 0.5), (2.0, 2.0), (1.5, 4.5))
MAX_REPEATS = 3
#: Hash ranges per source: the running sums of a source of any size are taken range by range.
RANGE_DIGITS = 3
ADDED = ["size", "source_size", "target", "taken", "repeats", "first_position"]


def source_key(column: str = "source") -> Column:
    """Null stays apart from every text, and both can be join keys."""
    return F.coalesce(F.concat(F.lit("="), F.col(column)), F.lit(""))


def word_count(text: str = "text") -> Column:
    return F.regexp_count(text_or_empty(text), F.lit(WORDS)).cast("long")


def targets(sizes: DataFrame, schedules: Sequence = SCHEDULES, max_repeats: int = MAX_REPEATS) -> DataFrame:
    """One row per source of sizes(source, size): k, source_size, w0, w1, target.

    Sources by code point, null last, take the schedules in turn. The shares of the total are min(cap, weight * level)
    at the one level where they use up the total; that is where resharing an excess by weight, again and again, ends.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    n = F.lit(len(schedules))
    pick = lambda i: F.element_at(F.array(*[F.lit(float(s[i])) for s in schedules]), (F.pmod(F.row_number().over(by_name) - 1, n) + 1).cast("int"))
    base = sizes.groupBy("source").agg(F.sum("size").alias("source_size")).withColumns({"w0": pick(0), "w1": pick(1)})
    base = base.withColumn("weight", (F.col("w0") + F.col("w1")) / 2).withColumn("cap", F.col("source_size") * max_repeats)
    rising = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    before, after = rising.rowsBetween(Window.unboundedPreceding, -1), rising.rowsBetween(0, Window.unboundedFollowing)
    everything = Window.partitionBy(F.lit(1))
    filled = base.withColumn(
        "level",
        (F.sum("source_size").over(everything) - F.coalesce(F.sum("cap").over(before), F.lit(0))).cast("double") / F.sum("weight").over(after),
    )
    level = F.min(F.when(F.col("cap") >= F.col("weight") * F.col("level"), F.struct(F.col("cap") / F.col("weight"), "level")))
    filled = filled.withColumn("level", level.over(everything)["level"])
    return filled.select(
        source_key().alias("k"),
        "source_size",
        "w0",
        "w1",
        F.least(F.col("cap").cast("double"), F.col("weight") * F.col("level")).alias("target"),
    )


def position_at(share: Column, w0: Column, w1: Column) -> Column:
    """The time by which a source has had `share` of its words: the inverse of w0 t + (w1 - w0) t^2 / 2, over (w0 + w1) / 2."""
    area, slope = share * (w0 + w1) / 2, w1 - w0
    return F.when(F.abs(slope) < 1e-12, share).otherwise((F.sqrt(F.greatest(w0 * w0 + 2 * slope * area, F.lit(0.0))) - w0) / slope)


def _plan(docs: DataFrame, added: list[str], schedules: Sequence, max_repeats: int) -> DataFrame:
    """row (the columns of docs that stay), doc_id, ADDED, start (words before it in its source), w0, w1."""
    rows = boxed(docs, added, doc_id=F.col("doc_id"), source=F.col("source"), k=source_key(), h=F.md5(id_text().cast("binary")), size=word_count())
    rows = rows.withColumn("r", F.substring("h", 1, RANGE_DIGITS))
    narrow = rows.select("source", "size", "k", "r")
    ranges = narrow.groupBy("k", "r").agg(F.sum("size").alias("n"))
    earlier = Window.partitionBy("k").orderBy("r").rowsBetween(Window.unboundedPreceding, -1)
    ranges = ranges.select("k", "r", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"))
    plan = ranges.join(targets(narrow.select("source", "size"), schedules, max_repeats), "k")
    inside = Window.partitionBy("k", "r").orderBy("h", "size").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("inside", F.coalesce(F.sum("size").over(inside), F.lit(0))).join(plan, ["k", "r"])
    passes = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0))
    rows = rows.withColumns({"start": F.col("before") + F.col("inside"), "passes": passes})
    rest = F.col("target") - F.col("passes") * F.col("source_size")
    more = F.when((F.col("size") > 0) & (2 * F.col("start") + F.col("size") <= 2 * rest), 1).otherwise(0)
    rows = rows.withColumn("repeats", F.when(F.col("size") > 0, F.col("passes") + more).otherwise(0).cast("long"))
    first = F.when(F.col("repeats") > 0, position_at(F.col("start") / F.col("target"), F.col("w0"), F.col("w1")))
    rows = rows.withColumns({"taken": F.col("size") * F.col("repeats"), "first_position": first})
    return rows.select("row", "doc_id", *ADDED, "start", "w0", "w1")


def plan_mix(docs: DataFrame, schedules: Sequence = SCHEDULES, max_repeats: int = MAX_REPEATS, keep: tuple[str, ...] | None = None) -> DataFrame:
    """docs with size, source_size, target (its source's), taken (words), repeats, first_position (null: not taken).

    Documents of a source are taken in the order of a hash of doc_id: as many whole passes as fit its target, then those
    whose middle lies before what remains. Null texts have size 0 and are never taken; a null source is a source; rows
    that repeat an id are documents of their own; columns named like the added ones are replaced. `keep` names the columns
    of docs that the result has beside these (all, if it is None): what it leaves out, as the texts, is never shuffled.
    """
    left = [*ADDED, *[c for c in docs.columns if keep is not None and c not in keep]]
    return _plan(docs, left, schedules, max_repeats).select(*unboxed(docs, left), *ADDED)


def mix(docs: DataFrame, schedules: Sequence = SCHEDULES, max_repeats: int = MAX_REPEATS) -> DataFrame:
    """One row per taken copy of a document: its columns and `position`, range-sorted by position (then id).

    Columns of docs named like the added ones of plan_mix(), or position, are replaced or left out.
    """
    added = [*ADDED, "position"]
    plan = _plan(docs, added, schedules, max_repeats).filter("repeats > 0")
    copies = plan.withColumn("pass", F.explode(F.sequence(F.lit(0).cast("long"), F.col("repeats") - 1)))
    share = F.least((F.col("start") + F.col("pass") * F.col("source_size")) / F.col("target"), F.lit(1.0))
    out = copies.withColumn("position", position_at(share, F.col("w0"), F.col("w1")))
    return out.orderBy("position", "doc_id").select(*unboxed(docs, added), "position")
