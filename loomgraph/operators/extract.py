"""One pass over the files of an export that turns them into fact tables."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, fields
from functools import reduce

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.functions.metadata_parser import parse_metadata
from loomgraph.functions.module_parser import parse_module
from loomgraph.functions.vocab import module_identity
from loomgraph.sources.export import analyzable
from loomgraph.sources.store import cut

SYMBOL = "struct<name:string, kind:string, is_export:boolean, directive:string, region:string, line_start:int, line_end:int, signature:string, parameters:array<struct<name:string, by_value:boolean, default:string>>, body_hash:string>"
CALL = "struct<name:string, qualifier:string, line:int, column:int, caller:int>"
QUERY = "struct<kind:string, text:string, tables:array<struct<name:string, operation:string>>, line_start:int, line_end:int, caller:int>"
REFERENCE = "struct<source:string, target:string, relation:string, line:int, caller:int>"
OBJECT = "struct<kind:string, name:string, full_name:string, parent:string, synonym:string, uuid:string, properties:map<string,string>>"
IDENTITY = "struct<name:string, full_name:string, module_kind:string, owner_kind:string, owner_name:string>"
FACTS = f"path string, checksum string, content binary, error string, module {IDENTITY}, symbols array<{SYMBOL}>, calls array<{CALL}>, queries array<{QUERY}>, refs array<{REFERENCE}>, objects array<{OBJECT}>, directives array<struct<name:string, line:int>>, profile map<string,string>"
ENCODINGS = ("utf-8-sig", "cp1251", "utf-16")


def decode(content: bytes) -> str:
    for encoding in ENCODINGS:
        try:
            return content.decode(encoding)
        except UnicodeDecodeError:
            continue
    raise UnicodeError("not decodable")


def _facts(path: str, language: str, content: bytes, checksum: str) -> dict:
    empty = {"path": path, "checksum": checksum, "content": content, "error": None, "module": None, "symbols": [], "calls": [], "queries": [], "refs": [], "objects": [], "directives": [], "profile": {}}
    try:
        text = decode(content)
        if language == "bsl":
            found = parse_module(text)
            return {**empty, "module": module_identity(path), "symbols": found["symbols"], "calls": found["calls"], "queries": found["queries"], "refs": [{"source": None, **r} for r in found["references"]], "directives": found["directives"]}
        found = parse_metadata(text, path)
        return {**empty, "objects": found["objects"], "profile": found["profile"], "refs": [{**r, "line": None, "caller": None} for r in found["references"]]}
    except Exception as error:  # a file that can't be parsed is reported with its path and doesn't stop the others
        return {**empty, "error": f"{path}: {type(error).__name__}: {error}"}


@dataclass
class Facts:
    """modules(module_id, path, name, ...), symbols(symbol_id, module_id, ...), calls, queries, references, objects(object_id, ..., properties), errors(path, error), directives(path, name, line), profiles(path, profile); each with its project."""

    modules: DataFrame
    symbols: DataFrame
    calls: DataFrame
    queries: DataFrame
    references: DataFrame
    objects: DataFrame
    errors: DataFrame
    directives: DataFrame
    profiles: DataFrame


def parse(files: DataFrame) -> DataFrame:
    """One row of nested facts for each analyzable file of files(relative_path, language, content, checksum), its content beside them."""

    def parsed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame([_facts(*row) for row in zip(b["relative_path"], b["language"], b["content"], b["checksum"])])

    chosen = files.filter(analyzable(F.col("relative_path"), F.col("language"))).select("relative_path", "language", "content", "checksum")
    return chosen.mapInPandas(parsed, FACTS)


def claims(raw: DataFrame) -> DataFrame:
    """path and full_name of the objects in parse()'s rows."""
    return raw.select("path", F.explode("objects.full_name").alias("full_name"))


def settle(new: DataFrame, old: DataFrame, taken: DataFrame) -> DataFrame:
    """path of the files that may not have the full names that they claim, as if files were stored one after another by path.

    new(path, full_name) are claims of files to be stored, old(path, full_name) what those files (and others that can't be
    replaced) have so far, taken(full_name) the names of all other files. A file is rejected as a whole, and then keeps its
    old names, if another file has one of its names at its turn: a stored one, an earlier one by its claim or, if rejected,
    by what it keeps, or a later one by what it still has. Only names that several files claim are looked at.
    """
    stored = old.withColumn("is_new", F.lit(False)).unionByName(taken.select(F.lit(None).cast("string").alias("path"), "full_name", F.lit(False).alias("is_new")))
    every = cut(new.withColumn("is_new", F.lit(True)).unionByName(stored).distinct())
    several = every.groupBy("full_name").agg(F.count_distinct(F.coalesce("path", F.lit(""))).alias("n")).filter("n > 1").select("full_name")
    met = every.join(several, "full_name", "left_semi")
    others = met.select("full_name", F.col("path").alias("other"), F.col("is_new").alias("other_new"))
    pairs = met.filter("is_new").select("path", "full_name").join(others, "full_name").filter("other IS NULL OR other <> path").drop("full_name").distinct()
    claimers = every.filter("is_new").select(F.col("path").alias("other"), F.lit(True).alias("claims")).distinct()
    pairs = cut(pairs.join(claimers, "other", "left"))
    rejected = cut(pairs.filter("other IS NULL OR (other > path AND NOT other_new) OR (other < path AND claims IS NULL)").select("path").distinct())
    pairs = cut(pairs.filter("other < path AND claims").join(rejected, "path", "left_anti"))
    left = cut(pairs.select("path").distinct())
    while not left.isEmpty():  # what an earlier file holds follows from its own verdict
        flag = lambda paths, name: paths.select(F.col("path").alias("other"), F.lit(True).alias(name))
        seen = pairs.join(left, "path", "left_semi").join(flag(left, "open"), "other", "left").join(flag(rejected, "refused"), "other", "left")
        holds = F.col("open").isNull() & (F.col("other_new") != F.col("refused").isNotNull())
        decided = cut(seen.groupBy("path").agg(F.max(holds).alias("bad"), F.max(F.col("open").isNotNull()).alias("waits")).filter("bad OR NOT waits"))
        rejected = cut(rejected.unionByName(decided.filter("bad").select("path")))
        left = cut(left.join(decided, "path", "left_anti"))
    return rejected


def without(raw: DataFrame, rejected: DataFrame) -> DataFrame:
    """parse()'s rows, of which the rejected(path) ones hold an error instead of facts."""
    bad = rejected.distinct().withColumn("bad", F.lit(True))
    rows = raw.join(bad, "path", "left")
    out = {"error": F.when(F.col("bad"), F.concat("path", F.lit(": a full name is taken"))).otherwise(F.col("error"))}
    out |= {c: F.when(F.col("bad").isNull(), F.col(c)) for c in ("module", "symbols", "calls", "queries", "refs", "objects", "directives", "profile")}
    return rows.withColumns(out).select(*raw.columns)


def extract(files: DataFrame, project: str = "") -> Facts:
    raw = cut(parse(files))
    names = claims(raw)
    return facts_of(cut(without(raw, settle(names, names.limit(0), names.limit(0)))), project)


def facts_of(raw: DataFrame, project: str = "") -> Facts:
    """The fact tables of parse()'s rows. Ids are hashes of project, path and place, so they last over runs."""
    key = lambda kind, *place: F.xxhash64(F.lit(project), "path", F.lit(kind), *place)
    module_id = key("module")
    symbol = lambda n: F.when(F.col(n).isNotNull(), key("symbol", F.col(n)))
    modules = raw.filter("module IS NOT NULL").select(module_id.alias("module_id"), "path", "module.*")
    symbols = raw.select("path", F.posexplode("symbols").alias("ordinal", "s")).select(symbol("ordinal").alias("symbol_id"), module_id.alias("module_id"), "path", "ordinal", "s.*")
    part = lambda c: raw.select("path", F.posexplode(c).alias("ordinal", "x"))
    calls = part("calls").withColumn("caller", F.col("x.caller")).select(key("call", "ordinal").alias("call_id"), module_id.alias("module_id"), "path", symbol("caller").alias("caller_id"), "x.name", "x.qualifier", "x.line", "x.column")
    queries = part("queries").withColumn("caller", F.col("x.caller")).select(key("query", "ordinal").alias("query_id"), "path", symbol("caller").alias("caller_id"), "x.kind", "x.text", "x.tables", "x.line_start", "x.line_end")
    references = part("refs").withColumn("caller", F.col("x.caller")).select("path", module_id.alias("module_id"), symbol("caller").alias("caller_id"), "x.source", "x.target", "x.relation", "x.line")
    objects = part("objects").select(key("object", "ordinal").alias("object_id"), "path", "x.*")
    errors = raw.filter("error IS NOT NULL").select("path", "error")
    directives = raw.select("path", F.inline("directives"))
    profiles = raw.filter(F.size("profile") > 0).select("path", "profile")
    tables = (modules, symbols, calls, queries, references, objects, errors, directives, profiles)
    return Facts(*[t.withColumn("project", F.lit(project)) for t in tables])


def merged_profile(facts: Facts) -> DataFrame:
    """project and profile, one map of all documents' profiles: of several values of a key that of the last path stays."""
    values = facts.profiles.select("project", "path", F.explode("profile").alias("key", "value"))
    last = values.groupBy("project", "key").agg(F.max_by("value", "path").alias("value"))
    return last.groupBy("project").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("key", "value")))).alias("profile"))


def together(parts: list[Facts]) -> Facts:
    """The facts of several projects in one."""
    return Facts(*[reduce(DataFrame.unionByName, [getattr(p, f.name) for p in parts]) for f in fields(Facts)])
