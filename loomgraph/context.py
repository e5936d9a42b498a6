"""Documents for people and models: the bounded context of a term, and the snapshot of a whole project."""

from __future__ import annotations

import json
from datetime import UTC, datetime
from functools import reduce
from pathlib import Path

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from loomgraph.operators.extract import decode, merged_profile
from loomgraph.operators.relational import first_rows, running_budget, top_k
from loomgraph.project import Project
from loomgraph.sources.store import cut

SCHEMA = "context-package-v1"
#: Most rows of each list in a package; what is collected is bounded by these and by the caller's units and characters.
MOST = {"matches": 20, "calls": 300, "impact": 300, "queries": 100, "unresolved": 200}
#: Lines of source shown before and after a method.
MARGIN = 3


@F.pandas_udf(StringType())
def _text(content: pd.Series) -> pd.Series:
    return content.map(decode)


def rows(df: DataFrame) -> list[dict]:
    """The rows of a bounded result, in its order, nulls kept."""
    return [json.loads(r.j) for r in df.select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("j")).collect()]


def source_units(project: Project, chosen: DataFrame, max_chars: int, max_units: int) -> DataFrame:
    """Source of the symbols in chosen(node, priority), smallest priority first, within a budget of units and characters.

    Of one priority, symbols of the asked project come before those of the included ones, each with its own project's file.
    Only the files of the symbols that can enter are decoded. The last unit is cut at the budget; without symbols the
    result is empty.
    """
    order = ["priority", "place", "path", "line_start", "symbol_id"]
    owner = project.facts.modules.select("module_id", F.col("full_name").alias("owner"))
    first = project.facts.symbols.join(chosen.withColumnRenamed("node", "symbol_id"), "symbol_id").join(owner, "module_id").withColumn("place", project.place()).orderBy(*order).limit(max_units)
    found = first.join(project.sources, ["project", "path"]).withColumn("lines", F.split(_text("content"), "\r\n|\r|\n"))
    last = F.size("lines") - F.when(F.element_at("lines", -1) == "", 1).otherwise(0)
    found = found.withColumns({"line_from": F.greatest(F.lit(1), F.col("line_start") - MARGIN), "line_to": F.least(last, F.col("line_end") + MARGIN)})
    found = found.withColumn("source", F.array_join(F.expr("slice(lines, line_from, greatest(line_to - line_from + 1, 0))"), "\n"))
    units = running_budget(found, [], order, "source", max_chars, max_units)
    return units.orderBy("unit").select("unit", "symbol_id", "project", F.concat_ws(".", "owner", "name").alias("symbol"), "kind", F.col("is_export").alias("export"), "directive", "region", "signature", "parameters", F.col("path").alias("file"), F.col("line_from").alias("line_start"), F.col("line_to").alias("line_end"), "source")


def outgoing(project: Project, found: DataFrame, selected: DataFrame, limit: int | None) -> DataFrame:
    """Edges one step on from the entities found and the symbols selected(symbol_id)."""
    seeds = found.select(F.col("kind").alias("source_kind"), F.col("id").alias("source_id"))
    seeds = seeds.unionByName(selected.select(F.lit("symbol").alias("source_kind"), F.col("symbol_id").alias("source_id"))).distinct()
    met = project.edges.join(seeds, ["source_kind", "source_id"], "left_semi").withColumn("depth", F.lit(1).cast("long"))
    return first_rows(met, [project.place(), "source_kind", "source_id", "relation", "target_name"], limit)


def queries_near(project: Project, selected: DataFrame) -> DataFrame:
    """Queries embedded in the symbols selected(symbol_id), so many of each project."""
    near = project.facts.queries.join(selected.withColumnRenamed("symbol_id", "caller_id"), "caller_id", "left_semi")
    near = top_k(near, ["project"], ["path", "line_start", "query_id"], MOST["queries"])
    return near.orderBy(project.place(), "path", "line_start", "query_id").select("project", F.col("path").alias("file"), "line_start", "line_end", "kind", "tables", "text")


def unresolved_near(project: Project, selected: DataFrame) -> DataFrame:
    """Calls of the symbols selected(symbol_id) that stay open, but for built-in and platform ones, so many of each project."""
    near = project.calls_table.filter("resolved_id IS NULL AND resolution NOT IN ('built_in', 'platform_api')").join(selected.withColumnRenamed("symbol_id", "caller_id"), "caller_id", "left_semi")
    near = top_k(near, ["project"], ["path", "line", "column", "call_id"], MOST["unresolved"])
    return near.orderBy(project.place(), "path", "line", "column", "call_id").select("project", F.concat_ws(".", "qualifier", "name").alias("call"), "resolution", F.col("path").alias("file"), "line")


def _named(project: Project, df: DataFrame, pairs: list[tuple[str, str, str]]) -> DataFrame:
    """df with the full names of entities; each pair is (kind column or literal kind, id column, name column to add)."""
    for kind, key, out in pairs:
        names = project.entities().select(F.col("kind").alias("__k"), F.col("id").alias(key), F.col("full_name").alias(out))
        kinds = F.col(kind) if kind in df.columns else F.lit(kind)
        df = df.withColumn("__k", kinds).join(names, ["__k", key], "left").drop("__k")
    return df


def build_context(project: Project, term: str, depth: int = 1, max_chars: int = 60_000, max_units: int = 30) -> dict:
    """Matches, source, calls, impact, queries and open calls around a term. Lists have the bounds of MOST."""
    found = cut(project.find(term, MOST["matches"]))
    traces = cut(project.calls(term, "both", depth, MOST["calls"]))
    hit = cut(project.impact(term, depth, MOST["impact"]))
    seeds = project.symbols_of(found).withColumn("priority", F.lit(0))
    around = traces.select(F.col("caller").alias("node")).unionByName(traces.select(F.col("callee").alias("node"))).unionByName(hit.filter("source_kind = 'symbol'").select(F.col("source_id").alias("node")))
    chosen = seeds.unionByName(around.dropna().withColumn("priority", F.lit(1))).groupBy("node").agg(F.min("priority").alias("priority"))
    units = cut(source_units(project, chosen, max_chars, max_units))
    selected = units.select("symbol_id").distinct()
    extra = outgoing(project, found, selected, MOST["impact"])
    edge = [c for c in hit.columns if c != "depth"]
    both = hit.withColumn("__part", F.lit(0)).unionByName(extra.withColumn("__part", F.lit(1)))
    once = both.groupBy(*edge).agg(F.min(F.struct("__part", "depth")).alias("p")).select(*edge, "p.*")
    impact = once.orderBy("__part", "depth", project.place(), "path", "line", "relation", "target_name").limit(MOST["impact"])
    source = rows(units.orderBy("unit").drop("unit"))
    return {
        "schema": SCHEMA,
        "generated_at": datetime.now(UTC).isoformat(),
        "request": {"term": term, "depth": depth, "max_chars": max_chars},
        "projects": [{"name": p.name, "source_path": p.root} for p in (project, *project.included)],
        "matches": rows(found.drop("stage")),
        "source_units": source,
        "calls": rows(_named(project, traces, [("symbol", "caller", "caller_name"), ("symbol", "callee", "callee_name")]).orderBy("depth", "direction", project.place(), "path", "line", "column", "name")),
        "impact": rows(_named(project, impact, [("source_kind", "source_id", "source_name")]).orderBy("__part", "depth", project.place(), "path", "line", "relation", "target_name").drop("__part")),
        "queries": rows(queries_near(project, selected)),
        "unresolved_near_context": rows(unresolved_near(project, selected)),
        "limits": {"source_units": max_units, "source_characters": max_chars, "actual_source_characters": sum(len(u["source"]) for u in source)},
    }


def write_json(payload: dict, output: Path) -> Path:
    output = Path(output).expanduser().resolve()
    output.parent.mkdir(parents=True, exist_ok=True)
    output.write_text(json.dumps(payload, ensure_ascii=False, indent=2, sort_keys=True), encoding="utf-8")
    return output


def write_context(project: Project, term: str, output: Path, **bounds: int) -> Path:
    """The context package of a term as a JSON file."""
    return write_json(build_context(project, term, **bounds), output)


#: Sections of a snapshot, in order, and the order of the rows in each.
SECTIONS = {
    "project": ["name"], "summary": ["calls"], "profile": ["key"], "metadata": ["full_name"], "modules": ["full_name"],
    "symbols": ["owner", "module_id", "line_start", "ordinal"], "queries": ["path", "line_start", "query_id"], "dependencies": ["source_name", "relation", "target_name", "path", "line", "source_id", "target_id"],
}


def write_snapshot(project: Project, folder: str) -> DataFrame:
    """The project itself, without included ones, as one ordered document of JSON lines; returns it as section, ordinal, row.

    Sections follow each other as in SECTIONS, and each row carries its number in its section. One range sort over section
    and sort key places all rows, so two runs over the same project write the same bytes in the same order, whatever the
    number of tasks; numbers come from the counts of the sorted table's files, not from a window over all rows.
    """
    f, spark = project.own_facts, project.spark
    owner = f.modules.select("module_id", F.col("full_name").alias("owner"))
    profile = merged_profile(f).select(F.explode("profile").alias("key", "value"))
    head = spark.createDataFrame([(project.name, project.root)], "name string, source_path string")
    named = _named(project, project.own_edges, [("source_kind", "source_id", "source_name")])
    tables = dict(zip(SECTIONS, [head, project.summary(), profile, f.objects, f.modules, f.symbols.join(owner, "module_id"), f.queries, named]))
    parts = []
    for i, (section, df) in enumerate(tables.items()):
        # Sort keys as text that sorts like the values: numbers with a leading count of their digits.
        keys = [F.coalesce(_sortable(df, c), F.lit("")) for c in SECTIONS[section]]
        line = F.to_json(F.struct(*sorted(df.columns)), {"ignoreNullFields": "false"})
        parts.append(df.select(F.lit(i).alias("part"), F.lit(section).alias("section"), F.concat_ws("\0", *keys).alias("key"), line.alias("row")))
    rows = reduce(DataFrame.unionByName, parts)
    placed = cut(rows.repartitionByRange("part", "key", "row").sortWithinPartitions("part", "key", "row"))
    at = placed.select("*", F.regexp_extract("_metadata.file_name", r"^part-(\d+)", 1).cast("long").alias("file"), F.col("_metadata.row_index").alias("index"))
    counts = at.groupBy("section", "file").agg(F.count(F.lit(1)).alias("n"), F.min("index").alias("first"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("section").orderBy("file").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = counts.select("section", "file", "first", before.alias("before"))  # a row for a section and file
    numbered = at.join(starts, ["section", "file"]).select("part", "section", (F.col("before") + F.col("index") - F.col("first") + 1).alias("ordinal"), "row")
    document = numbered.repartitionByRange("part", "ordinal").sortWithinPartitions("part", "ordinal").select("section", "ordinal", "row")
    document.write.mode("overwrite").json(folder)
    return spark.read.schema(document.schema).json(folder)


def _sortable(df: DataFrame, column: str) -> Column:
    kind = df.schema[column].dataType.typeName()
    if kind == "string":
        return F.col(column)
    return F.lpad((F.col(column).cast("decimal(20,0)") + F.lit(str(2**63)).cast("decimal(20,0)")).cast("string"), 21, "0")
