"""A folder of projects whose files, facts, calls and edges outlast the session and follow the sources step by step.

Every table is Parquet, partitioned by project, version and bucket (a hash of the file's path). A step writes only the
buckets that it changes, under a new version, and then puts one manifest in place, which says for each project and table
which version of each bucket counts. Manifests are numbered; one is written beside its name and then renamed, which fails
if another step took the number, so readers see all of a step or nothing and two steps can't both win.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Sequence
from dataclasses import asdict, dataclass, field
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from loomgraph.operators.extract import FACTS, Facts, claims, facts_of, parse, settle, together
from loomgraph.operators.resolve import call_keys, call_lookups, candidate_keys, edges, resolve_calls
from loomgraph.project import Project, Stored
from loomgraph.sources.export import analyzable, contents, directory, listing
from loomgraph.sources.store import cut

FILES = "relative_path string, size_bytes long, modified_ns long, language string, checksum string, analyzed_checksum string, analysis_error string"
CALLS = "call_id long, module_id long, path string, caller_id long, name string, qualifier string, line int, column int, project string, normalized_name string, resolution string, resolved_id long"
EDGES = "project string, source_kind string, source_id long, target_kind string, target_id long, target_name string, relation string, path string, line int"
SCHEMAS = {"files": FILES, "facts": FACTS, "calls": CALLS, "edges": EDGES}
PATH_OF = {"files": "relative_path", "facts": "path", "calls": "path", "edges": "path"}
#: Parts into which a project's tables are cut, unless add() says otherwise: a step rewrites the parts it touches.
BUCKETS = 64


class CatalogError(ValueError):
    """A workspace can't do what it was asked for."""


class ProjectNotFound(CatalogError):
    pass


class ProjectExists(CatalogError):
    pass


class Conflict(CatalogError):
    """Another step changed the workspace meanwhile."""


@dataclass(frozen=True)
class ScanResult:
    added: int
    updated: int
    unchanged: int
    removed: int
    #: Files whose content was read, as their size or time had changed.
    opened: int = 0

    @property
    def total(self) -> int:
        return self.added + self.updated + self.unchanged


@dataclass(frozen=True)
class AnalysisResult:
    scan: ScanResult | None
    analyzed: int
    skipped: int
    rebuilt: bool
    #: Calls that were resolved again.
    calls_resolved: int
    errors: list[str] = field(default_factory=list)


class Workspace:
    def __init__(self, spark: SparkSession, folder: str):
        """folder is one that the driver and all executors see; it is created with the first project."""
        self.spark, self.folder = spark, folder.rstrip("/")
        self._jvm = spark._jvm
        self._fs = self._path("").getFileSystem(spark._jsc.hadoopConfiguration())

    # --- manifests

    def _path(self, below: str):
        return self._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{below}" if below else self.folder)

    def _names(self, below: str) -> list[str]:
        path = self._path(below)
        return [s.getPath().getName() for s in self._fs.listStatus(path)] if self._fs.exists(path) else []

    def _numbers(self) -> list[int]:
        return sorted(int(n.removesuffix(".json")) for n in self._names("manifests") if n.endswith(".json") and not n.startswith("."))

    def _manifest(self) -> tuple[int, dict]:
        """The last number and what it says: projects by name."""
        numbers = self._numbers()
        if not numbers:
            return 0, {}
        stream = self._fs.open(self._path(f"manifests/{numbers[-1]:09d}.json"))
        try:
            text = bytes(self._jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode()
        finally:
            stream.close()
        return numbers[-1], json.loads(text)

    def _commit(self, number: int, projects: dict) -> None:
        """Puts the manifest after `number` in place, or raises Conflict if there is one."""
        written = self._path(f"manifests/.{uuid.uuid4().hex}")
        stream = self._fs.create(written, True)
        stream.write(bytearray(json.dumps(projects, ensure_ascii=False, sort_keys=True, indent=1).encode()))
        stream.close()
        context = self._jvm.org.apache.hadoop.fs.FileContext.getFileContext(written.toUri(), self.spark._jsc.hadoopConfiguration())
        none = self.spark.sparkContext._gateway.new_array(self._jvm.org.apache.hadoop.fs.Options.Rename, 0)
        try:
            context.rename(self._fs.makeQualified(written), self._fs.makeQualified(self._path(f"manifests/{number + 1:09d}.json")), none)
        except Exception as error:
            self._fs.delete(written, False)
            raise Conflict("the workspace was changed meanwhile; run the step again") from error

    # --- projects

    def _entry(self, projects: dict, name: str) -> dict:
        if name not in projects:
            raise ProjectNotFound(f"no project {name}")
        return projects[name]

    def add(self, name: str, root: str, buckets: int = BUCKETS) -> None:
        """A project of the sources under root; its name and its folder must be new."""
        number, projects = self._manifest()
        full = directory(root)
        if not name.strip():
            raise CatalogError("a project needs a name")
        if name in projects or any(p["root"] == full for p in projects.values()):
            raise ProjectExists(f"there is a project {name}, or one of {full}")
        projects[name] = {"id": uuid.uuid4().hex, "root": full, "buckets": buckets, "tables": {t: {} for t in SCHEMAS}, "resolved": None}
        self._commit(number, projects)

    def projects(self) -> list[dict]:
        """name and root of all projects, by name."""
        return [{"name": n, "root": p["root"]} for n, p in sorted(self._manifest()[1].items())]

    def files(self, name: str) -> DataFrame:
        """The catalogue of a project's files, by path."""
        return self._table(self._entry(self._manifest()[1], name), "files").orderBy("relative_path")

    def remove(self, name: str) -> None:
        """Takes a project out of the workspace, and drops its partitions; no other project's files are touched."""
        number, projects = self._manifest()
        gone = self._entry(projects, name)
        del projects[name]
        self._commit(number, projects)
        for table in SCHEMAS:
            self._fs.delete(self._path(f"{table}/project={gone['id']}"), True)

    def clean(self, keep: int = 2) -> int:
        """Deletes manifests but for the last `keep`, and versions that none of these names; returns how many versions."""
        numbers = self._numbers()[-max(1, keep) :]
        used = set()
        for n in numbers:
            for p in json.loads("".join(r.value for r in self.spark.read.text(f"{self.folder}/manifests/{n:09d}.json", wholetext=True).collect())).values():
                used |= {(p["id"], v) for t in p["tables"].values() for v in t.values()}
                used |= {(q, v) for q, state in (p["resolved"] or {}).items() for v in state.values()}
        dropped = 0
        for n in self._numbers():
            if n not in numbers:
                self._fs.delete(self._path(f"manifests/{n:09d}.json"), False)
        for table in SCHEMAS:
            for project in self._names(table):
                for version in self._names(f"{table}/{project}") if project.startswith("project=") else []:
                    if (project.removeprefix("project="), int(version.removeprefix("version="))) not in used:
                        self._fs.delete(self._path(f"{table}/{project}/{version}"), True)
                        dropped += 1
        return dropped

    # --- tables

    def _read(self, entry: dict, table: str, versions: dict[str, int]) -> DataFrame:
        """The rows of these versions of buckets; nothing else is listed or read."""
        schema = StructType.fromDDL(SCHEMAS[table])
        parts: dict[int, list[int]] = {}
        for bucket, version in versions.items():
            parts.setdefault(version, []).append(int(bucket))
        if not parts:
            return self.spark.createDataFrame([], schema)
        base = f"{self.folder}/{table}"
        paths = [f"{base}/project={entry['id']}/version={version}" for version in parts]
        # The rows' own column `project` is stored under another name, as the partition has this one.
        stored = StructType([StructField("own_project", f.dataType) if f.name == "project" else f for f in schema])
        stored = stored.add("project", "string").add("version", "long").add("bucket", "long")
        rows = self.spark.read.schema(stored).option("basePath", base).parquet(*paths)
        wanted = reduce(lambda a, b: a | b, [(F.col("version") == v) & F.col("bucket").isin(b) for v, b in parts.items()])
        rows = rows.filter((F.col("project") == entry["id"]) & wanted).drop("project", "version", "bucket").withColumnRenamed("own_project", "project")
        return rows.select(*schema.names)

    def _table(self, entry: dict, table: str) -> DataFrame:
        return self._read(entry, table, entry["tables"][table])

    def _bucket(self, entry: dict, path: str):
        return F.pmod(F.xxhash64(path), F.lit(entry["buckets"]))

    def _replace(self, entry: dict, table: str, version: int, rows: DataFrame, stale: DataFrame, key: str) -> None:
        """In the buckets of rows and of stale(path, key), the rows with a stale key go and `rows` come.

        stale has the table's path column and the key column (which may be the same). Only these buckets are read and
        written; entry then names their new version.
        """
        path = PATH_OF[table]
        rows = cut(rows.withColumn("bucket", self._bucket(entry, path)))
        stale = cut(stale.select(path, *([key] if key != path else [])).distinct().withColumn("bucket", self._bucket(entry, path)))
        touched = {str(r.bucket) for r in rows.select("bucket").union(stale.select("bucket")).distinct().collect()}
        if not touched:
            return
        versions = entry["tables"][table]
        old = self._read(entry, table, {b: v for b, v in versions.items() if b in touched})
        kept = old.join(stale.select(key).distinct(), key, "left_anti").select(*old.columns).withColumn("bucket", self._bucket(entry, path))
        out = kept.unionByName(rows.select(*kept.columns))
        if "project" in out.columns:
            out = out.withColumnRenamed("project", "own_project")
        out = out.withColumns({"project": F.lit(entry["id"]), "version": F.lit(version)}).hint("rebalance", "bucket")
        # Dynamic overwrite: what a step that died has left of this version goes, other partitions stay.
        out.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("project", "version", "bucket").parquet(f"{self.folder}/{table}")
        written = {n.removeprefix("bucket=") for n in self._names(f"{table}/project={entry['id']}/version={version}") if n.startswith("bucket=")}
        entry["tables"][table] = {b: v for b, v in versions.items() if b not in touched} | dict.fromkeys(sorted(written & touched), version)

    # --- scan

    def scan(self, name: str) -> ScanResult:
        """Brings the catalogue in line with the folder. Only files whose size or time differ are opened and hashed."""
        number, projects = self._manifest()
        result = self._scan(self._entry(projects, name), number + 1)
        if result != ScanResult(0, 0, result.unchanged, 0):
            self._commit(number, projects)
        return result

    def _scan(self, entry: dict, version: int) -> ScanResult:
        stored = self._table(entry, "files")
        disk = listing(self.spark, entry["root"])
        before = stored.select("relative_path", F.col("size_bytes").alias("old_size"), F.col("modified_ns").alias("old_ns"), F.col("checksum").alias("old_checksum"), "analyzed_checksum", "analysis_error", F.lit(True).alias("known"))
        both = cut(disk.withColumn("on_disk", F.lit(True)).join(before, "relative_path", "full_outer"))
        same = F.col("on_disk") & F.col("known") & (F.col("size_bytes") == F.col("old_size")) & (F.col("modified_ns") == F.col("old_ns"))
        differ = both.filter(F.col("on_disk") & ~F.coalesce(same, F.lit(False)))
        opened = cut(contents(differ.select("relative_path", "size_bytes", "modified_ns", "language", "old_checksum", "analyzed_checksum", "analysis_error", "known"), entry["root"]).drop("content"))
        gone = both.filter("on_disk IS NULL").select("relative_path")
        kept = F.col("known") & (F.col("checksum") == F.col("old_checksum"))
        counts = opened.agg(F.count_if(F.col("known").isNull()).alias("added"), F.count_if(F.col("known") & ~kept).alias("updated"), F.count_if(kept).alias("same"), F.count(F.lit(1)).alias("n")).first()
        n_same, n_gone = both.agg(F.count_if(same), F.count_if(F.col("on_disk").isNull())).first()
        rows = opened.select("relative_path", "size_bytes", "modified_ns", "language", "checksum", "analyzed_checksum", "analysis_error")
        if counts.n or n_gone:
            self._replace(entry, "files", version, rows, rows.select("relative_path").union(gone), "relative_path")
        if n_gone:
            self._replace(entry, "facts", version, self.spark.createDataFrame([], FACTS), gone.withColumnRenamed("relative_path", "path"), "path")
        return ScanResult(counts.added, counts.updated, n_same + counts.same, n_gone, counts.n)

    # --- analysis

    def analyze(self, name: str, force: bool = False, scan: bool = True, include: Sequence[str] = ()) -> AnalysisResult:
        """Parses the files that changed or failed, replaces their facts, and resolves the calls that this may change.

        A file that can't be parsed, or claims a name that another has, keeps its former facts and is tried again. An
        unchanged project is left as it is, unless force or include say otherwise.
        """
        number, projects = self._manifest()
        entry, version = self._entry(projects, name), number + 1
        scanned = self._scan(entry, version) if scan else None
        able = self._table(entry, "files").filter(analyzable(F.col("relative_path"), F.col("language")))
        up_to_date = F.col("analyzed_checksum").eqNullSafe(F.col("checksum")) & F.col("analysis_error").isNull()
        work = cut(able if force else able.filter(~up_to_date))
        n_able, n_work = able.count(), work.count()
        errors: list[str] = []
        if n_work:
            errors = self._parse(entry, version, work)
        changed = bool(force or n_work > len(errors) or (scanned and scanned.removed) or include)
        resolved = self._resolve(name, projects, version, include, force) if changed else 0
        if changed or n_work or (scanned and scanned.opened):
            self._commit(number, projects)
        return AnalysisResult(scanned, n_work - len(errors), n_able - n_work, changed, resolved, sorted(errors))

    def _parse(self, entry: dict, version: int, work: DataFrame) -> list[str]:
        """Facts of the files of work take the place of the former ones, but for those that fail. Returns the errors."""
        raw = cut(parse(contents(work.select("relative_path", "language"), entry["root"])))
        paths = work.select(F.col("relative_path").alias("path"))
        held = claims(self._table(entry, "facts").select("path", "objects"))
        bad = settle(claims(raw.filter("error IS NULL")), held.join(paths, "path", "left_semi"), held.join(paths, "path", "left_anti").select("full_name"))
        bad = cut(bad.select("path", F.concat("path", F.lit(": a full name is taken")).alias("taken")))
        good = cut(raw.filter("error IS NULL").join(bad, "path", "left_anti").select(*raw.columns))
        self._replace(entry, "facts", version, good, good.select("path"), "path")
        state = raw.select("path", F.col("checksum").alias("parsed"), "error").join(bad, "path", "left").withColumnRenamed("path", "relative_path")
        state = work.join(state, "relative_path", "left")
        error = F.when(F.col("parsed").isNull(), F.concat("relative_path", F.lit(": can't be read"))).otherwise(F.coalesce("error", "taken"))
        rows = state.withColumn("analysis_error", error).withColumn("analyzed_checksum", F.when(F.col("analysis_error").isNull(), F.col("parsed"))).select(*work.columns)
        rows = cut(rows)
        self._replace(entry, "files", version, rows, rows.select("relative_path"), "relative_path")
        return [r.analysis_error for r in rows.filter("analysis_error IS NOT NULL").select("analysis_error").collect()]

    # --- resolution

    def resolve(self, name: str, include: Sequence[str] = (), force: bool = False) -> int:
        """Resolves a project's calls against the named projects too; returns how many were resolved again."""
        number, projects = self._manifest()
        n = self._resolve(name, projects, number + 1, include, force)
        self._commit(number, projects)
        return n

    def _facts(self, entry: dict, name: str) -> Facts:
        return facts_of(self._table(entry, "facts"), name)

    def _moved(self, entry: dict, name: str, then: dict[str, int], exported_only: bool) -> tuple[DataFrame, DataFrame]:
        """The candidate keys that differ between two states of a project's facts, and the paths of the files that do.

        Only buckets with different versions are read, and of these only files with different content.
        """
        now = entry["tables"]["facts"]
        old = self._read(entry, "facts", {b: v for b, v in then.items() if now.get(b) != v})
        new = self._read(entry, "facts", {b: v for b, v in now.items() if then.get(b) != v})
        stamp = lambda df: df.select("path", "checksum")
        paths = cut(stamp(old).exceptAll(stamp(new)).union(stamp(new).exceptAll(stamp(old))).select("path").distinct())
        keys = [candidate_keys(facts_of(df.join(paths, "path", "left_semi").select(*df.columns), name), exported_only) for df in (old, new)]
        return cut(keys[0].subtract(keys[1]).union(keys[1].subtract(keys[0])).select("key").distinct()), paths

    def _resolve(self, name: str, projects: dict, version: int, include: Sequence[str], force: bool) -> int:
        entry = self._entry(projects, name)
        others = [(n, self._entry(projects, n)) for n in dict.fromkeys(include) if n != name]
        state = {e["id"]: dict(e["tables"]["facts"]) for _, e in [(name, entry), *others]}
        if not force and entry["resolved"] == state:
            return 0  # no version of a bucket differs
        facts = self._facts(entry, name)
        theirs = together([self._facts(e, n) for n, e in others]) if others else None
        then = {} if force else entry["resolved"] or {}
        keys, changed = self._moved(entry, name, then.get(entry["id"], {}), False)
        by_id = {e["id"]: (n, e) for n, e in projects.items()}
        for other in sorted({*then, *(e["id"] for _, e in others)} - {entry["id"]}):
            # A project that is no longer included gave candidates then, and gives none now.
            if other in by_id:
                n, e = by_id[other]
                still = any(other == x["id"] for _, x in others)
                keys = keys.union(self._moved(e if still else {**e, "tables": {**e["tables"], "facts": {}}}, n, then.get(other, {}), True)[0])
            elif then:
                return self._resolve(name, projects, version, include, True)  # its tables are gone, so all is resolved anew
        stored = self._table(entry, "calls")
        stays = stored.join(changed, "path", "left_anti")
        if force:
            again = facts.calls
        else:
            hit = call_lookups(stays).join(keys.distinct(), "key", "left_semi").select("call_id").distinct()
            again = facts.calls.join(cut(hit), "call_id", "left_semi").select(*facts.calls.columns).unionByName(facts.calls.join(changed, "path", "left_semi").select(*facts.calls.columns))
        again = cut(again)
        n_again = again.count()
        names = cut(call_keys(again).select("n").distinct())
        some = lambda f: None if f is None else Facts(**{**vars(f), "symbols": _named(f.symbols, names)})
        resolved = resolve_calls(Facts(**{**vars(some(facts)), "calls": again}), some(theirs)).select(*StructType.fromDDL(CALLS).names)
        stale = stored.select("path", "call_id") if force else stored.join(changed, "path", "left_semi").select("path", "call_id").union(again.select("path", "call_id"))
        self._replace(entry, "calls", version, resolved, stale, "call_id")
        entry["resolved"] = state
        entry["include"] = [n for n, _ in others]
        built = edges(facts, self._table(entry, "calls"), theirs).select(*StructType.fromDDL(EDGES).names)
        self._replace(entry, "edges", version, built, self._table(entry, "edges").select("path"), "path")
        return n_again

    # --- answers

    def open(self, name: str, include: Sequence[str] | None = None) -> Project:
        """The stored project, without parsing or resolving. It answers with the projects that it was resolved with, or `include`."""
        _, projects = self._manifest()
        entry = self._entry(projects, name)
        names = entry.get("include", []) if include is None else include
        return self._open(projects, name, [self._open(projects, n, []) for n in dict.fromkeys(names) if n != name])

    def _open(self, projects: dict, name: str, include: list[Project]) -> Project:
        entry = self._entry(projects, name)
        files = self._table(entry, "files")
        facts = self._facts(entry, name)
        facts.errors = files.filter("analysis_error IS NOT NULL").select(F.col("relative_path").alias("path"), F.col("analysis_error").alias("error"), F.lit(name).alias("project"))
        sources = self._table(entry, "facts").select(F.lit(name).alias("project"), "path", "content")
        return Project(self.spark, entry["root"], name, include, Stored(facts, self._table(entry, "calls"), self._table(entry, "edges"), files, sources))

    def status(self, name: str) -> dict:
        """What a project's tables hold, as plain numbers, and where its sources are."""
        entry = self._entry(self._manifest()[1], name)
        counts = self.open(name).summary().first().asDict()
        return {"name": name, "root": entry["root"], "include": entry.get("include", []), **counts}


def _named(symbols: DataFrame, names: DataFrame) -> DataFrame:
    """The symbols that have one of the normalised names n."""
    keyed = call_keys(symbols.withColumn("qualifier", F.lit(None).cast("string")))
    return keyed.join(names, "n", "left_semi").select(*symbols.columns)


def as_dict(result: ScanResult | AnalysisResult) -> dict:
    return asdict(result)
