"""A source export as a queryable knowledge graph."""

from __future__ import annotations

import os
from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.functions.textfn import holds_lowered, like_ascii, normalize
from loomgraph.operators import graph
from loomgraph.operators.extract import Facts, extract, together
from loomgraph.operators.relational import count_where, first_rows, staged_union, top_k
from loomgraph.operators.resolve import cross_project_candidates, edges, resolve_calls
from loomgraph.sources.export import scan
from loomgraph.sources.store import cut


@dataclass
class Stored:
    """A project's own tables: facts, resolved calls, edges, the files of its catalogue, and sources(project, path, content)."""

    facts: Facts
    calls: DataFrame
    edges: DataFrame
    files: DataFrame
    sources: DataFrame


class Project:
    """Facts, resolved calls and edges of one export; every answer is a DataFrame, of all rows where the limit is None."""

    def __init__(self, spark: SparkSession, root: str = "", name: str = "", include: Sequence[Project] = (), stored: Stored | None = None):
        """An export under root, or the tables that a workspace keeps of one. Included projects answer beside this one, after it.

        A project's name, that of its folder if none is given, tells its rows from those of others, so names must differ;
        a project that is included twice counts once.
        """
        self.spark, self.root, self.name = spark, root, name or os.path.basename(os.path.normpath(root))
        self.included = list(dict.fromkeys(include))
        names = [self.name, *[p.name for p in self.included]]
        if len(set(names)) < len(names):
            raise ValueError(f"projects of one name: {', '.join(names)}")
        self.order = names
        theirs = together([p.own_facts for p in self.included]) if self.included else None
        if stored is None:
            files = cut(scan(spark, root))
            own = extract(files, self.name)
            calls = cut(resolve_calls(own, theirs))
            sources = files.select(F.lit(self.name).alias("project"), F.col("relative_path").alias("path"), "content")
            stored = Stored(own, calls, cut(edges(own, calls, theirs)), files.drop("content"), sources)
        self.own_facts, self.own_calls, self.own_edges, self.files, self.own_sources = stored.facts, stored.calls, stored.edges, stored.files, stored.sources
        all_of = lambda tables: reduce(DataFrame.unionByName, tables)
        self.facts = together([self.own_facts, *[p.own_facts for p in self.included]]) if self.included else self.own_facts
        self.calls_table = all_of([self.own_calls, *[p.own_calls for p in self.included]])
        self.edges = all_of([self.own_edges, *[p.own_edges for p in self.included]])
        self.sources = all_of([self.own_sources, *[p.own_sources for p in self.included]])

    def place(self, project: str = "project") -> Column:
        """0 for rows of this project, 1 for those of the first included one, and so on."""
        return F.array_position(F.array(*map(F.lit, self.order)), F.col(project)) - 1

    def entities(self) -> DataFrame:
        """kind, id, name, full_name, exported, synonym, details, project of metadata, modules and symbols."""
        f, none = self.facts, F.lit(None).cast("string")
        what = lambda first, label, value: F.concat(F.lit("kind="), first, F.lit(f"; {label}="), F.coalesce(value, F.lit("-"))).alias("details")
        objects = f.objects.select(F.lit("metadata").alias("kind"), F.col("object_id").alias("id"), "name", "full_name", F.lit(False).alias("exported"), "synonym", what(F.col("kind"), "synonym", F.col("synonym")), "project")
        modules = f.modules.select(F.lit("module").alias("kind"), F.col("module_id").alias("id"), "name", "full_name", F.lit(False).alias("exported"), none.alias("synonym"), what(F.col("module_kind"), "owner", F.col("owner_name")), "project")
        owner = f.modules.select("module_id", F.col("full_name").alias("owner"))
        symbols = f.symbols.join(owner, "module_id").select(F.lit("symbol").alias("kind"), F.col("symbol_id").alias("id"), "name", F.concat_ws(".", "owner", "name").alias("full_name"), F.col("is_export").alias("exported"), none.alias("synonym"), what(F.col("kind"), "directive", F.col("directive")), "project")
        return objects.unionByName(modules).unionByName(symbols)

    def find(self, term: str, limit: int | None = 100) -> DataFrame:
        """Of this project, then of each included one: symbols by exact name, then objects and modules by exact name.

        Whatever contains the term comes in only for projects in which nothing has it as its name.
        """
        last = normalize(F.lit(term.rpartition(".")[2]))
        e = self.entities().withColumn("place", self.place())
        symbol = (F.col("kind") == "symbol") & (normalize("name") == last) & normalize("full_name").contains(normalize(F.lit(term)))
        exact = (F.col("kind") != "symbol") & ((F.col("name") == term) | (F.col("full_name") == term))
        near = like_ascii("name", term) | like_ascii("full_name", term) | F.coalesce(like_ascii("synonym", term), F.lit(False))
        met = cut(e.withColumn("stage", F.when(symbol, 0).when(exact, 1).when(near, 2).cast("long")).filter("stage IS NOT NULL"))
        named = met.filter("stage < 2").select("project").distinct()
        met = met.filter("stage < 2").unionByName(met.filter("stage = 2").join(named, "project", "left_anti").select(*met.columns))
        return first_rows(met, ["place", "stage", "full_name", "id"], limit).drop("place")

    def symbols_for_entities(self, found: DataFrame, per_entity: int = 20) -> DataFrame:
        """Symbols found, and at most per_entity of each module or object: those with a directive first, then exported ones."""
        asked = found.select(F.col("kind").alias("asked_kind"), F.col("id").alias("asked_id"))
        own = asked.filter("asked_kind = 'module'").withColumn("module_id", F.col("asked_id"))
        holds = self.edges.filter("relation = 'contains_module'").select(F.col("source_id").alias("asked_id"), F.col("target_id").alias("module_id"))
        modules = own.unionByName(asked.filter("asked_kind = 'metadata'").join(holds, "asked_id").select(*own.columns))
        order = [F.col("directive").isNull(), F.col("is_export").desc(), "line_start", "symbol_id"]
        held = top_k(self.facts.symbols.join(modules, "module_id"), ["asked_kind", "asked_id"], order, per_entity).select(F.col("symbol_id").alias("id"))
        ids = held.unionByName(found.filter("kind = 'symbol'").select("id")).distinct()
        return self.entities().filter("kind = 'symbol'").join(ids, "id", "left_semi")

    def symbols_of(self, found: DataFrame) -> DataFrame:
        """node: the symbols found, and those of the modules and objects found."""
        direct = found.filter("kind = 'symbol'").select(F.col("id").alias("node"))
        modules = found.filter("kind = 'module'").select(F.col("id").alias("module_id"))
        held = self.edges.filter("relation = 'contains_module'").select(F.col("source_id").alias("id"), F.col("target_id").alias("module_id"))
        modules = modules.unionByName(held.join(found.filter("kind = 'metadata'"), "id", "left_semi").select("module_id")).distinct()
        return direct.unionByName(self.facts.symbols.join(modules, "module_id", "left_semi").select(F.col("symbol_id").alias("node"))).distinct()

    def calls(self, term: str, direction: str = "both", depth: int = 1, limit: int | None = 200) -> DataFrame:
        """caller, callee, name, resolution, project, path, line, column, depth, direction.

        Unresolved calls show up on the way out, and once more with the only symbol of all projects that they may mean.
        """
        if depth < 1:
            raise ValueError("depth must be at least 1")
        links = self.calls_table.withColumns({"caller": F.col("caller_id"), "callee": F.col("resolved_id")})

        def candidates(met: DataFrame) -> DataFrame:
            """The open calls of a frontier once more, where exactly one exported symbol of all projects fits."""
            return met.unionByName(cross_project_candidates(met, self.facts).withColumn("callee", F.col("resolved_id")))

        rows = graph.calls(links, self.symbols_of(self.find(term, 50)), direction, depth, candidates if self.included else lambda met: met)
        rows = rows.select("caller", "callee", "name", "resolution", "project", "path", "line", "column", "depth", "direction")
        return first_rows(rows, ["depth", "direction", self.place(), "path", "line", "column", "name", F.col("callee").isNotNull()], limit)

    def impact(self, term: str, depth: int = 2, limit: int | None = 500) -> DataFrame:
        """What depends on the term's entities, level by level."""
        if depth < 1:
            raise ValueError("depth must be at least 1")
        rows = graph.impact(self.edges, self.find(term, 50).select("kind", "id"), depth)
        return first_rows(rows, ["depth", self.place(), "path", "line", "relation", "target_name"], limit)

    def audit(self, group_by: str = "reason", limit: int | None = 50) -> DataFrame:
        """value, n: the project's own calls by resolution, or unresolved ones by name or qualifier."""
        rows = self.own_calls
        if group_by not in ("reason", "name", "qualifier"):
            raise ValueError(group_by)
        value = {"reason": F.col("resolution"), "name": F.concat_ws(".", "qualifier", "name"), "qualifier": F.coalesce("qualifier", F.lit("<without qualifier>"))}[group_by]
        rows = rows if group_by == "reason" else rows.filter(F.col("resolution").startswith("unresolved"))
        return first_rows(rows.groupBy(value.alias("value")).agg(F.count(F.lit(1)).alias("n")), [F.col("n").desc(), "value"], limit)

    def audit_counters(self) -> DataFrame:
        """One row: the project's own calls by how they were resolved, and its dependencies without a target."""
        r = F.col("resolution")
        calls = count_where(
            self.own_calls, calls=F.lit(True), resolved=F.col("resolved_id").isNotNull(), ambiguous=r.startswith("ambiguous"), built_in=r == "built_in", platform=r == "platform_api",
            dynamic=r == "dynamic_qualified", unresolved=r.startswith("unresolved"),
        )
        return calls.crossJoin(count_where(self.own_edges, unresolved_dependencies=F.col("target_id").isNull()))  # one-row frames

    def summary(self) -> DataFrame:
        """One row of sixteen counts of the project itself, without the included ones."""
        f = self.own_facts
        parts = [self.audit_counters(), count_where(self.own_edges, dependencies=F.lit(True)), count_where(f.symbols, symbols=F.lit(True), exported=F.col("is_export"))]
        parts += [count_where(t, **{k: F.lit(True)}) for k, t in (("files", self.files), ("metadata", f.objects), ("modules", f.modules), ("queries", f.queries), ("errors", f.errors))]
        return reduce(DataFrame.crossJoin, parts)  # one-row frames

    def query_usage(self, term: str | None = None) -> DataFrame:
        """project, path, line, symbol, query_kind, table, operation, resolved: tables that embedded queries name.

        A table is resolved if an edge of the same project, place and operation, whose target's name begins like it or the other
        way round, has a target.
        """
        q = self.facts.queries.select("query_id", "caller_id", "project", "path", F.col("line_start").alias("line"), F.col("kind").alias("query_kind"), F.posexplode("tables").alias("place", "t"))
        q = q.select("*", F.col("t.name").alias("table"), F.col("t.operation").alias("operation"), normalize("t.name").alias("key"))
        if term:
            q = q.filter(F.col("key").contains(normalize(F.lit(term))))
        named = self.edges.filter(F.col("relation").startswith("query_")).select("project", "path", "line", F.col("relation").substr(7, 10).alias("operation"), normalize("target_name").alias("target"), F.col("target_id").isNotNull().alias("hit"))
        met = q.join(named, ["project", "path", "line", "operation"], "left").filter(F.col("target").isNull() | F.col("target").startswith(F.col("key")) | F.col("key").startswith(F.col("target")))
        resolved = met.groupBy("query_id", "place").agg(F.coalesce(F.max("hit"), F.lit(False)).alias("resolved"))
        symbols = self.facts.symbols.select(F.col("symbol_id").alias("caller_id"), F.col("name").alias("symbol"))
        rows = q.join(resolved, ["query_id", "place"], "left").join(symbols, "caller_id", "left")
        rows = rows.select("project", "path", "line", "symbol", "query_kind", "table", "operation", F.coalesce("resolved", F.lit(False)).alias("resolved"), "place")
        return rows.orderBy(self.place(), "path", "line", "place").drop("place")

    def _direct_calls(self, term: str, side: str) -> DataFrame:
        names = self.entities().filter("kind = 'symbol'").select("id", "full_name")
        callers = names.select(F.col("id").alias("caller_id"), F.col("full_name").alias("a"))
        callees = names.select(F.col("id").alias("resolved_id"), F.col("full_name").alias("b"))
        rows = self.calls_table.join(callers, "caller_id", "left").join(callees, "resolved_id", "left")
        caller, callee = F.coalesce("a", F.lit("<module>")), F.coalesce("b", F.concat_ws(".", "qualifier", "name"))
        rows = rows.select(caller.alias("caller"), callee.alias("callee"), "resolution", "path", "line")
        return rows.filter(normalize(side).contains(normalize(F.lit(term)))).orderBy("path", "line", "caller", "callee")

    def callers(self, term: str) -> DataFrame:
        """caller, callee, resolution, path, line of the calls whose target's name holds the term."""
        return self._direct_calls(term, "callee")

    def callees(self, term: str) -> DataFrame:
        """The same for calls out of symbols whose name holds the term."""
        return self._direct_calls(term, "caller")

    def dependencies(self, term: str, incoming: bool = True, limit: int | None = 200) -> DataFrame:
        """source_name, relation, target_name, resolved, path, line of edges whose target (incoming) or source name holds the term."""
        names = self.entities().select(F.col("kind").alias("k"), F.col("id").alias("i"), "full_name")
        of = lambda side: names.select(F.col("k").alias(f"{side}_kind"), F.col("i").alias(f"{side}_id"), F.col("full_name").alias(f"{side}_full"))
        rows = self.edges.join(of("source"), ["source_kind", "source_id"], "left").join(of("target"), ["target_kind", "target_id"], "left")
        rows = rows.select(
            F.coalesce("source_full", F.concat(F.lit("<"), "source_kind", F.lit(">"))).alias("source_name"), "relation", F.coalesce("target_full", "target_name").alias("target_name"),
            F.col("target_id").isNotNull().alias("resolved"), "path", "line",
        )
        return first_rows(rows.filter(holds_lowered("target_name" if incoming else "source_name", term)), ["source_name", "relation", "target_name", "path", "line"], limit)

    def search(self, term: str, limit: int | None = 100) -> DataFrame:
        """kind, name, place, details: objects whose name, full name or synonym holds the term, then symbols whose name does."""
        f = self.facts
        any_name = holds_lowered("name", term) | holds_lowered("full_name", term) | holds_lowered(F.coalesce("synonym", F.lit("")), term)
        objects = f.objects.filter(any_name).select(F.concat(F.lit("metadata:"), "kind").alias("kind"), F.col("full_name").alias("name"), F.col("path").alias("place"), F.coalesce("synonym", F.lit("")).alias("details"), F.col("full_name").alias("o"))
        owner = f.modules.select("module_id", F.col("full_name").alias("owner"))
        flag = F.concat(F.lit("export="), F.when(F.col("is_export"), "True").otherwise("False"), F.lit("; directive="), F.coalesce("directive", F.lit("-")), F.lit("; region="), F.coalesce("region", F.lit("-")))
        symbols = f.symbols.filter(holds_lowered("name", term)).join(owner, "module_id")
        symbols = symbols.select(F.concat(F.lit("symbol:"), "kind").alias("kind"), F.concat_ws(".", "owner", "name").alias("name"), F.concat("path", F.lit(":"), F.col("line_start").cast("string")).alias("place"), flag.alias("details"), F.col("name").alias("o"))
        return staged_union([objects, symbols], ["o", "place"], limit).drop("o", "stage")
