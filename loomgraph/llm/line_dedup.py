"""Line deduplication by a suffix array over line ids, built by distributed prefix doubling, in DataFrame operations only.

A document is the sequence of its lines that hold a word. Suffixes of all documents are ranked by their first line,
then by 2, 4, 8 ... lines: the rank at a level is that of the pair (rank here, rank half a window further on). A rank
shared by several suffixes is an interval of the suffix array whose longest common prefix is at least the window; a
suffix that shares its rank with none leaves the array. A run of m lines is named by two overlapping windows, so the
intervals of common prefix m are groups of equal names, and all but the first occurrence in each are later copies.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomgraph.llm.common import SPACES, WORDS, boxed, id_text, kept_columns, materialize, text_or_empty

#: A run of lines counts as repeated if it has at least so many words.
MIN_WORDS = 10
ADDED = ["lines_in", "lines_deleted"]


def document_key(doc_id: str = "doc_id", text: str = "text") -> Column:
    """128 bits from id and text: rows that repeat both are one document with one result."""
    return F.unhex(F.md5(F.concat_ws("\n", id_text(doc_id), text_or_empty(text)).cast("binary")))


def trimmed(line: Column) -> Column:
    return F.regexp_replace(line, rf"^{SPACES}|{SPACES}$", "")


def line_table(docs: DataFrame) -> DataFrame:
    """(doc_id, d, i, p, id, w): id and words of the i-th line with a word, the p-th of all; lines are equal when their trimmed texts are."""
    lines = F.transform(F.split(text_or_empty(), "\n"), lambda x, p: F.struct(p.alias("p"), trimmed(x).alias("line")))
    rows = docs.select("doc_id", document_key().alias("d"), F.posexplode(F.filter(lines, lambda x: x["line"] != "")).alias("i", "x"))
    rows = rows.select("doc_id", "d", "i", "x.p", "x.line")
    return rows.select("doc_id", "d", "i", "p", F.unhex(F.md5(F.col("line").cast("binary"))).alias("id"), F.regexp_count("line", F.lit(WORDS)).alias("w"))


def ranked(names: DataFrame, keys: list[str], rank: str) -> DataFrame:
    """The names that several suffixes have, numbered in their sort order (as many rows as repeated windows)."""
    repeated = names.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    return repeated.orderBy(*keys).select(*keys, F.monotonically_increasing_id().alias(rank))


def doubled(suffixes: DataFrame, level: int) -> DataFrame:
    """(d, i, r): ranks of windows of 2^(level + 1) lines from those (d, i, r) of 2^level; suffixes without an equal go."""
    ahead = Window.partitionBy("d").orderBy("i").rangeBetween(1 << level, 1 << level)
    pairs = suffixes.select("d", "i", F.col("r").alias("r1"), F.first("r").over(ahead).alias("r2")).filter("r2 IS NOT NULL")
    ranks = materialize(ranked(pairs, ["r1", "r2"], "r"))
    return pairs.join(ranks, ["r1", "r2"]).select("d", "i", "r")


def shortest_runs(rows: DataFrame, min_words: int) -> DataFrame:
    """(doc_id, d, s, m): at each repeated line the shortest run from it, and the shortest up to it, with min_words words.

    Runs stay inside stretches of repeated lines; each has at most min_words lines, as every line has a word.
    """
    stretch = F.col("i") - F.row_number().over(Window.partitionBy("d").orderBy("i"))
    rows = rows.withColumn("g", stretch)
    g = Window.partitionBy("d", "g")
    rows = rows.withColumns({"upto": F.sum("w").over(g.orderBy("i")), "total": F.sum("w").over(g), "last": F.max("i").over(g)})
    rows = rows.withColumn("before", F.col("upto") - F.col("w"))
    # The nearest line below at which min_words are left behind, and above from which they have been passed.
    enough = F.min("i").over(g.orderBy(F.col("before").desc()).rangeBetween(Window.unboundedPreceding, -min_words))
    left = F.max("i").over(g.orderBy("upto").rangeBetween(Window.unboundedPreceding, -min_words))
    rows = rows.withColumns({"enough": enough, "left": left, "head": F.min("i").over(g)})
    end = F.when(F.col("enough").isNotNull(), F.col("enough")).when(F.col("total") - F.col("before") >= min_words, F.col("last") + 1)
    start = F.when(F.col("upto") >= min_words, F.coalesce(F.col("left") + 1, F.col("head")))
    from_here = F.struct(F.col("i").alias("s"), (end - F.col("i")).alias("m"))
    to_here = F.struct(start.alias("s"), (F.col("i") + 1 - start).alias("m"))
    return rows.select("doc_id", "d", F.inline(F.array_distinct(F.array(from_here, to_here)))).filter("s IS NOT NULL AND m IS NOT NULL")


def later_copies(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """(d, deleted): for each document with later copies the numbers, among all its lines, of those inside them."""
    lines = materialize(line_table(docs).dropDuplicates(["d", "i"]))
    first = materialize(ranked(lines, ["id"], "r"))
    known = materialize(lines.join(first, "id").select("doc_id", "d", "i", "p", "w", "r"))
    level = known.select("d", "i", "r")
    array = level.select("d", "i", F.lit(0).alias("k"), "r")
    k = 0
    while 1 << (k + 1) <= min_words:
        level = materialize(doubled(level, k))
        k += 1
        array = array.unionByName(level.select("d", "i", F.lit(k).alias("k"), "r"))
    runs = shortest_runs(known, min_words).withColumn("k", F.floor(F.log2("m") + 1e-9).cast("int")).dropDuplicates(["d", "s", "m"])
    runs = runs.withColumn("s2", F.col("s") + F.col("m") - F.expr("shiftleft(1, k)"))
    named = runs.join(array.select("d", F.col("i").alias("s"), "k", F.col("r").alias("a")), ["d", "s", "k"])
    named = named.join(array.select("d", F.col("i").alias("s2"), "k", F.col("r").alias("b")), ["d", "s2", "k"])
    named = materialize(named.select("doc_id", "d", "s", "m", "a", "b"))
    place = F.struct(F.col("doc_id"), F.col("d"), F.col("s"))
    # A table of their own: both sides of the join are then plain shuffles, and Spark splits a run that very many lines begin.
    intervals = materialize(named.groupBy("m", "a", "b").agg(F.min(place).alias("first"), F.count(F.lit(1)).alias("n")).filter("n > 1"))
    later = named.join(intervals, ["m", "a", "b"]).filter((F.col("d") != F.col("first.d")) | (F.col("s") != F.col("first.s")))
    inside = later.select("d", F.explode(F.sequence(F.col("s"), F.col("s") + F.col("m") - 1)).alias("i")).distinct()
    return inside.join(known, ["d", "i"]).groupBy("d").agg(F.collect_list("p").alias("deleted"))


def line_dedup(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """docs with text without later copies, and lines_in, lines_deleted (lines that hold a word).

    The first occurrence of a run, by doc_id (null first) and place, stays. A text without later copies stays as it is,
    null too; others keep their remaining lines, blank ones included, joined by line feeds. Rows that repeat id and text
    count as one document and get the same result.
    """
    rows = boxed(docs, [*ADDED, "text"], d=document_key(), t=F.col("text"))  # the text travels once
    gone = materialize(later_copies(docs, min_words))
    # Only texts that lose lines meet the table of deletions; the others keep theirs and need no second look.
    joined = rows.join(gone, "d", "left")
    lines = F.split(text_or_empty("t"), "\n")
    # Sets of whole numbers are hashed: the work is linear in the lines.
    kept = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), "deleted")
    changed = F.col("deleted").isNotNull()
    out = joined.withColumn("lines", lines)
    out = out.withColumns({
        "lines_in": F.size(F.filter("lines", lambda x: x.rlike(WORDS))).cast("long"),
        "lines_deleted": F.when(changed, F.size("deleted")).otherwise(0).cast("long"),
        "text": F.when(changed, F.array_join(F.transform(kept, lambda p: F.get("lines", p)), "\n")).otherwise(F.col("t")),
    })
    columns = [F.col("text").alias(c) if c.lower() == "text" else F.col("row").getField(c).alias(c) for c in kept_columns(docs, ADDED)]
    return out.select(*columns, *ADDED)
