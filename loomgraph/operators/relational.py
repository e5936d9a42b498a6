"""Relational kernels over parameterised columns."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def keep_first(df: DataFrame, keys: list[str], order: list[str | Column]) -> DataFrame:
    """One row per key, the first in order."""
    n = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("__n", n).filter("__n = 1").drop("__n")


def top_k(df: DataFrame, keys: list[str], order: list[str | Column], k: int) -> DataFrame:
    n = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("rank", n.cast("long")).filter(F.col("rank") <= k)


def first_match_join(left: DataFrame, right: DataFrame, on: list[str], order: list[str | Column]) -> DataFrame:
    """Left join with the first match only."""
    return left.join(keep_first(right, on, order), on, "left")


def sole_candidates(df: DataFrame, keys: list[str], id_column: str, prefix: str) -> DataFrame:
    """Per key the number of candidates and the smallest id: what the test for exactly one needs."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias(f"{prefix}_n"), F.min(id_column).alias(f"{prefix}_id"))


def longest_prefix_join(raws: DataFrame, raw: str, aliases: DataFrame, alias: str, value: str, least: int = 5) -> DataFrame:
    """raws with `value` of the longest alias (of `least` characters or more) that the raw text begins with, and the alias.

    The prefixes of each different raw text meet the aliases in an equi-join, so nothing is compared pair by pair.
    """
    different = raws.select(raw).distinct()
    lengths = F.when(F.length(raw) >= least, F.sequence(F.lit(least), F.length(raw))).otherwise(F.array().cast("array<int>"))
    prefixes = different.select(raw, F.explode(lengths).alias("n")).select(raw, F.substring(F.col(raw), F.lit(1), F.col("n")).alias(alias))
    best = prefixes.join(aliases, alias).groupBy(raw).agg(F.max(F.struct(F.length(alias).alias("n"), F.col(alias), F.col(value))).alias("m"))
    return raws.join(best.select(raw, f"m.{alias}", f"m.{value}"), raw, "left")


def smallest_around(points: DataFrame, point: str, spans: DataFrame, value: str) -> DataFrame:
    """points with the smallest `value` of spans(value, lo, hi) with lo <= point <= hi; null where there is none.

    A span is the union of few aligned ranges of 2^k numbers, at most two of each k. Of spans with the same range the
    smallest value stays, and a point looks up its one range of each k, so neither long nor many spans multiply rows.
    """
    levels = F.explode(F.sequence(F.lit(0), F.lit(62))).alias("__k")
    one = F.lit(1).cast("long")
    rows = spans.filter("lo <= hi").select(value, F.col("lo").cast("long").alias("lo"), (F.col("hi").cast("long") + 1).alias("end"), levels)
    # What is left of a span at level k is [a, b) in units of 2^k; an odd a, or an odd b, leaves no larger range to its unit.
    rows = rows.withColumns({"a": -F.expr("shiftright(-lo, __k)"), "b": F.expr("shiftright(end, __k)")}).filter("a < b")
    ends = F.array(F.when(F.col("a").bitwiseAND(one) == 1, F.col("a")), F.when(F.col("b").bitwiseAND(one) == 1, F.col("b") - 1))
    ranges = rows.select(value, "__k", F.explode(F.array_compact(ends)).alias("__cell"))
    ranges = ranges.groupBy("__k", "__cell").agg(F.min(value).alias(value))
    used = F.broadcast(ranges.select("__k").distinct())
    looked = points.select(point).distinct().crossJoin(used).withColumn("__cell", F.expr(f"shiftright(CAST(`{point}` AS BIGINT), __k)"))
    best = looked.join(ranges, ["__k", "__cell"]).groupBy(point).agg(F.min(value).alias(value))
    return points.join(best, point, "left")


def running_budget(df: DataFrame, keys: list[str], order: list[str | Column], text: str, most_chars: int, most_units: int) -> DataFrame:
    """Units in order while fewer than most_chars are used, most_units at most; the last is cut. Adds unit and used.

    keys bound the window: a budget runs inside each group. Without keys the units are first cut to most_units in order.
    """
    # Ranks alone are cut in each task before anything travels, so a large group sends most_units texts a task at most.
    rows = top_k(df, keys, order, most_units).drop("rank") if keys else df.orderBy(*order).limit(most_units)
    w = Window.partitionBy(*keys).orderBy(*order) if keys else Window.orderBy(*order)
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumns({"unit": F.row_number().over(w).cast("long"), "used": F.coalesce(F.sum(F.length(text)).over(before), F.lit(0)).cast("long")})
    rows = rows.filter((F.col("used") < most_chars) & (F.col("unit") <= most_units))
    return rows.withColumn(text, F.substring(F.col(text), F.lit(1), (F.lit(most_chars) - F.col("used")).cast("int")))


def catalog_diff(disk: DataFrame, stored: DataFrame, key: str, stat: list[str], checksum: str) -> DataFrame:
    """key and state: added, updated, unchanged or removed. The checksum counts only where a stat differs."""
    a = disk.select(key, *[F.col(c).alias(f"d_{c}") for c in [*stat, checksum]], F.lit(True).alias("on_disk"))
    b = stored.select(key, *[F.col(c).alias(f"s_{c}") for c in [*stat, checksum]], F.lit(True).alias("in_table"))
    same_stat = reduce(lambda x, y: x & y, [F.col(f"d_{c}").eqNullSafe(F.col(f"s_{c}")) for c in stat])
    state = (
        F.when(F.col("in_table").isNull(), "added")
        .when(F.col("on_disk").isNull(), "removed")
        .when(same_stat | F.col(f"d_{checksum}").eqNullSafe(F.col(f"s_{checksum}")), "unchanged")
        .otherwise("updated")
    )
    return a.join(b, key, "full_outer").select(key, state.alias("state"))


def replace_files(facts: DataFrame, new: DataFrame, file_key: str) -> DataFrame:
    """Facts of the files in `new` are replaced by it, all others stay."""
    return facts.join(new.select(file_key).distinct(), file_key, "left_anti").unionByName(new)


def reject_repeats(df: DataFrame, unique: list[str], file_key: str, order: list[str | Column]) -> DataFrame:
    """df with rejected: whether a row repeats a unique key that an earlier row has; a file with one such row is out as a whole."""
    n = F.row_number().over(Window.partitionBy(*unique).orderBy(*order))
    marked = df.withColumn("__again", (n > 1).cast("int"))
    return marked.withColumn("rejected", F.max("__again").over(Window.partitionBy(file_key)) == 1).drop("__again")


def first_rows(df: DataFrame, order: list[str | Column], limit: int | None) -> DataFrame:
    """The first rows in order; all of them, in order, without a limit."""
    return df.orderBy(*order) if limit is None else df.orderBy(*order).limit(limit)


def staged_union(stages: list[DataFrame], order: list[str], limit: int | None) -> DataFrame:
    """Rows of the stages, earlier stages first, `limit` in all (None: every row)."""
    tagged = [s.withColumn("stage", F.lit(i).cast("long")) for i, s in enumerate(stages)]
    return first_rows(reduce(DataFrame.unionByName, tagged), ["stage", *order], limit)


def count_where(df: DataFrame, **tests: Column) -> DataFrame:
    """Many filtered counts in one pass."""
    return df.agg(*[F.count_if(t).alias(k) for k, t in tests.items()])


def nested_regions(lines: DataFrame, keys: list[str], order: str, opens: Column, closes: Column, region: str | Column) -> DataFrame:
    """lines with depth and region: how many regions are open at a line, and `region` of the line that opened the innermost.

    A line that opens is already inside, one that closes already outside; closers without an opener are ignored. The depth
    is a running sum, less its running minimum where that is negative, so no stack and no loop is needed: the innermost
    open region at depth k was opened by the last line that reached depth k by opening.
    """
    w = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    step = F.when(opens, 1).when(closes, -1).otherwise(0)
    region = F.col(region) if isinstance(region, str) else region
    rows = lines.withColumns({"__sum": F.sum(step).over(w), "__opened": F.when(opens, F.struct(region.alias("r")))})
    rows = rows.withColumn("depth", (F.col("__sum") - F.least(F.lit(0), F.min("__sum").over(w))).cast("long"))
    level = Window.partitionBy(*keys, "depth").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    innermost = F.when(F.col("depth") > 0, F.last("__opened", ignorenulls=True).over(level)["r"])
    return rows.withColumn("region", innermost).drop("__sum", "__opened")
