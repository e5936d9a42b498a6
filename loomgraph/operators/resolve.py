"""From facts to a graph: calls to symbols by a cascade of candidates, names to metadata by the longest alias."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomgraph.functions import vocab
from loomgraph.functions.textfn import first_segment, normalize
from loomgraph.operators.extract import Facts
from loomgraph.operators.relational import first_match_join, longest_prefix_join, sole_candidates
from loomgraph.sources.store import cut


def _candidates(facts: Facts) -> tuple[DataFrame, DataFrame, DataFrame]:
    """symbols(symbol_id, module_id, n, is_export), modules by their names, and both joined."""
    symbols = facts.symbols.select("symbol_id", "module_id", normalize("name").alias("n"), "is_export")
    modules = facts.modules.select("module_id", normalize("name").alias("module"), normalize("owner_name").alias("owner"), "owner_kind")
    return symbols, modules, symbols.join(modules, "module_id")


def _counted(sides: dict[str, Column]) -> list[Column]:
    """Per side the number of symbols (null where there is none) and the smallest of them."""
    its = {name: F.when(test, F.col("symbol_id")) for name, test in sides.items()}
    number = lambda x: F.nullif(F.count(x), F.lit(0).cast("long"))
    return [c for name, x in its.items() for c in (number(x).alias(f"{name}_n"), F.min(x).alias(f"{name}_id"))]


def call_keys(calls: DataFrame) -> DataFrame:
    """calls with the normalised name n and the first segment of the qualifier q."""
    return calls.withColumns({"n": normalize("name"), "q": normalize(first_segment("qualifier"))})


def candidate_keys(facts: Facts, exported_only: bool = False) -> DataFrame:
    """key and candidate: what the facts' symbols and modules add to the tables of candidates that calls are met by.

    A call is resolved by the candidates of its own keys (`call_lookups`), so where the rows of two states of the facts
    differ, just the calls with one of the differing keys can come out differently.
    """
    symbols, modules, owned = _candidates(facts)
    names = F.explode(F.array_distinct(F.filter(F.array("module", "owner"), lambda x: x.isNotNull())))
    key = lambda *parts: F.concat_ws("\0", *parts).alias("key")
    own_id = lambda c: F.col(c).cast("string").alias("candidate")
    seen = owned.filter("is_export") if exported_only else owned
    by_name = owned.filter("is_export").select(key(F.lit("name"), "n"), F.concat_ws("\0", "symbol_id", (F.coalesce("owner_kind", F.lit("")) == "common_module").cast("string")).alias("candidate"))
    by_module = seen.select("symbol_id", "n", names.alias("q")).select(key(F.lit("module"), "q", "n"), own_id("symbol_id"))
    known = modules.filter("module IS NOT NULL").select(key(F.lit("known"), "module"), F.lit("").alias("candidate"))
    out = by_name.unionByName(by_module).unionByName(known)
    if not exported_only:
        out = out.unionByName(symbols.select(key(F.lit("local"), F.col("module_id").cast("string"), "n"), own_id("symbol_id")))
    return out.distinct()


def call_lookups(calls: DataFrame) -> DataFrame:
    """call_id and key: all keys under which a call looks for candidates."""
    local = F.when(F.col("caller_id").isNotNull(), F.concat_ws("\0", F.lit("local"), F.col("module_id").cast("string"), "n"))
    by_name = F.when(F.col("q").isNull() & F.col("caller_id").isNotNull(), F.concat_ws("\0", F.lit("name"), "n"))
    by_module, known = (F.when(F.col("q").isNotNull(), F.concat_ws("\0", *k)) for k in ((F.lit("module"), "q", "n"), (F.lit("known"), "q")))
    return call_keys(calls).select("call_id", F.explode(F.array_compact(F.array(local, by_name, by_module, known))).alias("key"))


def resolve_calls(facts: Facts, included: Facts | None = None, built_ins: frozenset[str] = vocab.BUILT_INS, platform: frozenset[str] = vocab.PLATFORM_GLOBALS) -> DataFrame:
    """calls with resolution and resolved_id. built_ins and platform hold normalised names.

    A call that the project itself has no candidate for may be met by exported symbols of the `included` projects. Rows of
    names that are no calls are left out.
    """
    symbols, modules, owned = _candidates(facts)
    own_names = F.explode(F.array_distinct(F.filter(F.array("module", "owner"), lambda x: x.isNotNull())))
    _, more, others = _candidates(included) if included else (None, modules.limit(0), owned.limit(0))
    others = others.filter("is_export")
    local = sole_candidates(symbols, ["module_id", "n"], "symbol_id", "local")
    # One table for each kind of key, own and included candidates side by side. A name, or a module, may have a third of all
    # calls; the tables are stored because Spark splits such a key only in a join of plain exchanges, not of aggregates.
    is_common = F.col("owner_kind") == "common_module"
    both = owned.filter("is_export").withColumn("theirs", F.lit(False)).unionByName(others.withColumn("theirs", F.lit(True)))
    sides = {"common": ~F.col("theirs") & is_common, "export": ~F.col("theirs"), "included_common": F.col("theirs") & is_common, "included_export": F.col("theirs")}
    by_name = cut(both.groupBy("n").agg(*_counted(sides)))
    named = owned.withColumn("theirs", F.lit(False)).unionByName(others.withColumn("theirs", F.lit(True))).select("symbol_id", "n", "theirs", own_names.alias("q"))
    by_module = cut(named.groupBy("q", "n").agg(*_counted({"qualified": ~F.col("theirs"), "included": F.col("theirs")})))
    known = cut(modules.unionByName(more).select(F.col("module").alias("q")).filter("q IS NOT NULL").distinct().withColumn("is_module", F.lit(True)))
    calls = call_keys(facts.calls).filter(~F.col("n").isin(*vocab.NOISE_NAMES))
    # Calls without a qualifier would all meet in one task; a key of their own that no module has spreads them.
    spread = F.coalesce("q", F.concat(F.lit("\0"), F.col("call_id").cast("string")))
    rows = calls.withColumn("__q", spread).join(local, ["module_id", "n"], "left").join(by_name, "n", "left")
    rows = rows.join(by_module.withColumnRenamed("q", "__q"), ["__q", "n"], "left").join(known.withColumnRenamed("q", "__q"), "__q", "left")
    has_q, in_symbol = F.col("q").isNotNull(), F.col("caller_id").isNotNull()
    itself = has_q & in_symbol & F.col("q").isin(*vocab.SELF_QUALIFIERS) & F.col("local_n").isNotNull()
    outside = F.col("q").isin(*vocab.PLATFORM_QUALIFIERS) | F.col("q").isin(*vocab.MANAGER_KINDS)
    sole = lambda p: F.col(f"{p}_n") == 1
    bare = ~has_q & in_symbol
    free = bare & F.col("local_n").isNull() & F.col("export_n").isNull()
    by_name = F.when(F.col("n").isin(*built_ins), "built_in").when(F.col("n").isin(*platform), "platform_api")
    resolution = (
        F.when(itself, F.when(sole("local"), "same_module_object").otherwise("ambiguous_qualified"))
        .when(has_q & F.col("qualified_n").isNotNull(), F.when(sole("qualified"), "qualified_module").otherwise("ambiguous_qualified"))
        .when(has_q & F.col("included_n").isNotNull(), F.when(sole("included"), "included_qualified_module").otherwise("ambiguous_included_qualified"))
        .when(has_q & outside, "platform_api")
        .when(has_q, F.when(F.col("is_module"), "unresolved_qualified").otherwise("dynamic_qualified"))
        .when(bare & sole("local"), "same_module")
        .when(bare & F.col("local_n").isNull() & sole("common"), "global_common_module")
        .when(bare & F.col("local_n").isNull() & sole("export"), "unique_export")
        .when(free & sole("included_common"), "included_global_common_module")
        .when(free & F.col("included_common_n").isNull() & sole("included_export"), "included_unique_export")
        .when(by_name.isNotNull(), by_name)
        .when(bare & F.col("local_n").isNotNull(), "ambiguous_local")
        .when(bare & F.col("export_n").isNotNull(), "ambiguous_export")
        .when(free & F.col("included_common_n").isNotNull(), "ambiguous_included_common_module")
        .when(free & F.col("included_export_n").isNotNull(), "ambiguous_included_export")
        .otherwise("unresolved_unqualified")
    )
    rows = rows.withColumn("resolution", resolution)
    r = F.col("resolution")
    target = F.when(r.isin("same_module_object", "same_module"), F.col("local_id")).when(r == "qualified_module", F.col("qualified_id"))
    target = target.when(r == "global_common_module", F.col("common_id")).when(r == "unique_export", F.col("export_id"))
    for name, candidate in (("included_qualified_module", "included"), ("included_global_common_module", "included_common"), ("included_unique_export", "included_export")):
        target = target.when(r == name, F.col(f"{candidate}_id"))
    return rows.select(*facts.calls.columns, F.col("n").alias("normalized_name"), "resolution", target.alias("resolved_id"))


def cross_project_candidates(calls: DataFrame, facts: Facts) -> DataFrame:
    """calls without a target for which, of all projects' exported symbols, exactly one has the name: with resolved_id.

    Where the call is qualified, that symbol's module must have the name of the first part of the qualifier. Candidates are
    counted first, so a name that many symbols have meets each of its calls once.
    """
    _, _, owned = _candidates(facts)
    exported = owned.filter("is_export").select("n", F.col("module").alias("q"), "symbol_id")
    by_name, by_module = sole_candidates(exported, ["n"], "symbol_id", "a"), sole_candidates(exported.filter("q IS NOT NULL"), ["n", "q"], "symbol_id", "b")
    open_calls = calls.filter("resolved_id IS NULL AND caller_id IS NOT NULL").withColumns({"n": F.col("normalized_name"), "q": normalize(first_segment("qualifier"))})
    met = open_calls.join(by_name.filter("a_n = 1"), "n", "left").join(by_module.filter("b_n = 1"), ["n", "q"], "left")
    found = met.withColumn("x", F.when(F.col("q").isNull(), F.col("a_id")).otherwise(F.col("b_id"))).filter("x IS NOT NULL")
    return found.withColumns({"resolved_id": F.col("x"), "resolution": F.lit("cross_project_candidate")}).select(*calls.columns)


def edges(facts: Facts, calls: DataFrame, included: Facts | None = None) -> DataFrame:
    """project, source_kind, source_id, target_kind, target_id, target_name, relation, path, line: what depends on what.

    Names that the project's own objects don't explain may mean objects of the `included` projects.
    """
    cols = ["project", "source_kind", "source_id", "target_kind", "target_id", "target_name", "relation", "path", "line"]
    named = facts.objects.withColumn("theirs", F.lit(0))
    if included:
        named = named.unionByName(included.objects.withColumn("theirs", F.lit(1)))
    aliases = named.select("theirs", F.explode(F.array(normalize("full_name"), normalize(F.concat_ws(".", "kind", "name")))).alias("alias"), "object_id", "full_name")
    # A table of its own: joins with it are then plain shuffles, and Spark splits a beginning that very many names share.
    aliases = cut(aliases.groupBy("alias").agg(F.min(F.struct("theirs", "full_name", "object_id")).alias("o")).select("alias", F.col("o.object_id").alias("object_id")))

    def to_objects(rows: DataFrame, more: Sequence[str] = ()) -> DataFrame:
        rows = rows.withColumn("raw", normalize("target_name"))
        exact = aliases.select(F.col("alias").alias("raw"), F.col("object_id").alias("exact"))
        near = longest_prefix_join(rows.join(exact, "raw", "left"), "raw", aliases, "alias", "object_id")
        return near.withColumns({"target_id": F.coalesce("exact", "object_id"), "target_kind": F.lit("metadata")}).select(*cols, *more)

    here = F.when(F.col("caller_id").isNotNull(), "symbol").otherwise("module")
    called = calls.filter("resolved_id IS NOT NULL").select("project", here.alias("source_kind"), F.col("caller_id").alias("source_id"), F.lit("symbol").alias("target_kind"), F.col("resolved_id").alias("target_id"), F.col("name").alias("target_name"), F.lit("calls").alias("relation"), "path", "line")
    kind = F.when(F.col("relation") == "metadata_type_reference", "metadata").otherwise(here)
    referred = to_objects(facts.references.select("project", kind.alias("source_kind"), F.col("caller_id").alias("source_id"), F.col("target").alias("target_name"), "relation", "path", "line"))
    tables = facts.queries.select("project", "caller_id", "query_id", "path", F.col("line_start").alias("line"), F.explode("tables").alias("t"))
    source = F.when(F.col("caller_id").isNotNull(), "symbol").otherwise("query")
    asked = to_objects(tables.select("project", source.alias("source_kind"), F.coalesce("caller_id", "query_id").alias("source_id"), F.col("t.name").alias("target_name"), F.concat(F.lit("query_"), F.col("t.operation")).alias("relation"), "path", "line"))
    # An object of the project itself owns a module rather than one of an included project.
    owner = named.select(F.col("kind").alias("owner_kind"), normalize("name").alias("o"), "object_id", "theirs", F.col("full_name").alias("owner_full"))
    owned = first_match_join(facts.modules.withColumn("o", normalize("owner_name")), owner, ["owner_kind", "o"], ["theirs", "owner_full", "object_id"]).filter("object_id IS NOT NULL")
    no_line = F.lit(None).cast("int").alias("line")
    holds = owned.select("project", F.lit("metadata").alias("source_kind"), F.col("object_id").alias("source_id"), F.lit("module").alias("target_kind"), F.col("module_id").alias("target_id"), F.col("name").alias("target_name"), F.lit("contains_module").alias("relation"), "path", no_line)
    # A child's parent is looked up like any other name: it may stand in another file, or be spelled as kind.name.
    children = facts.objects.filter("parent IS NOT NULL").select("project", F.lit("metadata").alias("source_kind"), F.lit(None).cast("long").alias("source_id"), F.col("parent").alias("target_name"), F.lit("contains").alias("relation"), "path", no_line, F.col("object_id").alias("child"), F.col("full_name").alias("child_name"))
    inside = to_objects(children, ["child", "child_name"]).filter("target_id IS NOT NULL AND target_id <> child")
    inside = inside.withColumns({"source_id": F.col("target_id"), "target_id": F.col("child"), "target_name": F.col("child_name")}).select(*cols)
    return called.unionByName(referred).unionByName(asked).unionByName(holds).unionByName(inside)
