"""Bounded traversals: level by level, by semi and anti joins, with each frontier written to the shared folder."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.sources.store import cut


def walk(edges: DataFrame, seeds: DataFrame, source: list[str], target: list[str], depth: int, more: Callable[[DataFrame], DataFrame] = lambda met: met) -> DataFrame:
    """The edges met within `depth` levels from seeds, with the level (1 first). Nodes are expanded once, at their first level.

    source and target name the columns of a node on the side walked from and to; seeds has the columns of source. A null
    in the target's columns ends the walk there. `more` may add rows to the edges that leave a frontier.
    """
    frontier = cut(seeds.select(*source).distinct())
    visited, out = frontier, None
    for level in range(1, depth + 1):
        met = cut(more(edges.join(frontier, source, "left_semi")).withColumn("depth", F.lit(level).cast("long")))
        out = met if out is None else out.unionByName(met)
        if level == depth:
            break
        reached = met.select(*[F.col(t).alias(s) for s, t in zip(source, target)]).dropna().distinct()
        frontier = cut(reached.join(visited, source, "left_anti"))
        if frontier.isEmpty():
            break
        visited = visited.unionByName(frontier)
    return out


def calls(edges: DataFrame, seeds: DataFrame, direction: str, depth: int, more: Callable[[DataFrame], DataFrame] = lambda met: met) -> DataFrame:
    """Call chains over edges(caller, callee) from seeds(node): incoming, outgoing, or both with frontiers of their own.

    `more` may add rows to the calls that leave a frontier on the way out.
    """
    parts = []
    if direction in ("outgoing", "both"):
        parts.append(walk(edges, seeds.select(F.col("node").alias("caller")), ["caller"], ["callee"], depth, more).withColumn("direction", F.lit("outgoing")))
    if direction in ("incoming", "both"):
        parts.append(walk(edges, seeds.select(F.col("node").alias("callee")), ["callee"], ["caller"], depth).withColumn("direction", F.lit("incoming")))
    return parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])


def impact(edges: DataFrame, seeds: DataFrame, depth: int) -> DataFrame:
    """Reverse traversal over edges(source_kind, source_id, target_kind, target_id, ...) from seeds(kind, id)."""
    start = seeds.select(F.col("kind").alias("target_kind"), F.col("id").alias("target_id"))
    return walk(edges, start, ["target_kind", "target_id"], ["source_kind", "source_id"], depth)
