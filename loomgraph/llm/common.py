"""Helpers shared by the corpus operators: table access, words, and shared scratch tables."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Runs of the six ASCII white-space characters, and runs of anything else.
SPACES = r"[\x20\x09-\x0D]+"
WORDS = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_or_empty(column: str | Column = "text") -> Column:
    return F.coalesce(F.col(column) if isinstance(column, str) else column, F.lit(""))


def shared_folder(spark: SparkSession) -> str:
    """The cluster's spark.checkpoint.dir; only where it is unset and Spark runs on one machine a folder of our own."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = tempfile.mkdtemp(prefix="spark-ckpt-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def materialize(df: DataFrame) -> DataFrame:
    """Write df as a table in the shared folder and read it again: the lineage ends there, lost executors cost nothing."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/tables/{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def discard(*tables: DataFrame) -> None:
    """Delete tables that materialize() wrote and that nothing reads any more."""
    for df in tables:
        jvm = df.sparkSession._jvm
        for name in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
            path = jvm.org.apache.hadoop.fs.Path(name)
            path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def id_text(column: str = "doc_id") -> Column:
    """The id as text; null as the empty string."""
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def crc_mod(column: str, n: int) -> Column:
    """The remainder of crc32 of the id's text, which deals rows to folds."""
    return F.pmod(F.crc32(id_text(column).cast("binary")), F.lit(n))


def kept_columns(docs: DataFrame, added: list[str]) -> list[str]:
    """The columns of docs that an operator leaves: those that it adds are replaced, whatever their case."""
    names = {a.lower() for a in added}
    return [c for c in docs.columns if c.lower() not in names]


def named(column: str) -> Column:
    """The column of this very name, dots and back-ticks included."""
    return F.col("`" + column.replace("`", "``") + "`")


def boxed(docs: DataFrame, added: list[str], **needed: Column) -> DataFrame:
    """`row`, a struct of the columns that stay, beside the columns that an operator works with: no names can clash."""
    return docs.select(F.struct(*[named(c) for c in kept_columns(docs, added)] or [F.lit(None).alias("none")]).alias("row"), *[c.alias(k) for k, c in needed.items()])


def unboxed(docs: DataFrame, added: list[str], row: str = "row") -> list[Column]:
    """The columns that boxed() put away."""
    return [F.col(row).getField(c).alias(c) for c in kept_columns(docs, added)]
