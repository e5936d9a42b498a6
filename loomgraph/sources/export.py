"""Exported source trees as tables: names and stat first, contents only of the files that are asked for."""

from __future__ import annotations

import os
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.functions.vocab import IGNORED_DIRECTORIES, LANGUAGES
from loomgraph.sources.store import cut

ENTRY = "relative_path string, is_folder boolean, size_bytes long, modified_ns long"
#: Folders that one task lists, and files that one task reads, at a time.
PER_TASK = 200


def directory(root: str) -> str:
    """The full path of a folder that must exist."""
    full = os.path.realpath(os.path.expanduser(root))
    if not os.path.isdir(full):
        raise NotADirectoryError(root)
    return full


def listing(spark: SparkSession, root: str) -> DataFrame:
    """relative_path, size_bytes, modified_ns, language of each file under root, without opening one.

    root is a folder that the driver and all executors see. Each task lists its folders and what lies below them until it
    has listed PER_TASK; what it has found but not listed is a table for the next round, so the driver holds no list of
    names and a small tree takes one round. Files whose name begins with a dot and everything below an ignored folder are
    passed over; links to folders are not followed.
    """
    full = directory(root)

    def below(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out, left, listed = [], list(b["relative_path"]), 0
            while left and listed < PER_TASK:
                folder, listed = left.pop(), listed + 1
                try:
                    entries = list(os.scandir(os.path.join(full, folder)))
                except OSError:
                    continue
                for e in entries:
                    path = f"{folder}/{e.name}" if folder else e.name
                    try:
                        if e.is_dir(follow_symlinks=False):
                            left += [path] if e.name not in IGNORED_DIRECTORIES else []
                        elif e.is_file() and not e.name.startswith("."):
                            out.append((path, False, (stat := e.stat()).st_size, stat.st_mtime_ns))
                    except OSError:
                        continue
            out += [(folder, True, 0, 0) for folder in left]
            yield pd.DataFrame(out, columns=["relative_path", "is_folder", "size_bytes", "modified_ns"])

    folders, levels, n = spark.createDataFrame([("",)], "relative_path string"), [], 1
    while n:
        level = cut(_dealt(folders, n).mapInPandas(below, ENTRY))
        levels.append(level.filter("NOT is_folder"))
        folders = level.filter("is_folder").select("relative_path")
        n = folders.count()
    files = levels[0]
    for level in levels[1:]:
        files = files.unionByName(level)
    return files.select("relative_path", "size_bytes", "modified_ns", language(F.col("relative_path")).alias("language"))


def _dealt(rows: DataFrame, n: int) -> DataFrame:
    """n rows in tasks of about PER_TASK."""
    return rows.repartition(max(1, -(-n // PER_TASK)), "relative_path")


def contents(files: DataFrame, root: str) -> DataFrame:
    """files(relative_path, ...) with content and checksum, for those that can be read now."""
    full = directory(root)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in files.schema) + ", content binary"

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for start in range(0, len(b), PER_TASK):
                part, found = b.iloc[start : start + PER_TASK], []
                for path in part["relative_path"]:
                    try:
                        with open(os.path.join(full, path), "rb") as file:
                            found.append(file.read())
                    except OSError:
                        found.append(None)
                yield part.assign(content=found)

    rows = _dealt(files, files.count()).mapInPandas(read, schema)
    return rows.filter("content IS NOT NULL").withColumn("checksum", F.sha2("content", 256))


def scan(spark: SparkSession, root: str) -> DataFrame:
    """relative_path, size_bytes, modified_ns, language, content, checksum of each file under root."""
    return contents(listing(spark, root), root)


def language(path: Column) -> Column:
    suffix = F.lower(F.regexp_extract(path, r"\.([^./]+)$", 1))
    known = F.create_map(*[F.lit(x) for pair in LANGUAGES.items() for x in pair])
    return F.coalesce(F.try_element_at(known, suffix), F.lit("unknown"))


def analyzable(path: Column, kind: Column) -> Column:
    """Modules and mdo documents always; XML only as Configuration.xml or two folders deep."""
    shallow = (F.size(F.split(path, "/")) == 2) | (F.lower(F.element_at(F.split(path, "/"), -1)) == "configuration.xml")
    return kind.isin("bsl", "mdo") | ((kind == "xml") & shallow)
