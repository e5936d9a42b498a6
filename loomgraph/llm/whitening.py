"""Whitening of embeddings by hierarchical merging of singular value decompositions.

Each task decomposes the vectors that it reads, and keeps their number, sums, singular values and all right vectors: a
matrix of at most d rows. Two such summaries merge by a decomposition of both matrices, one under the other, with one more
row that corrects for the different means. Nothing is truncated, so the merged one is that of all vectors, at every level
of the tree; what travels is at most d x d numbers a task, and the last merge leaves one matrix.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomgraph.llm.common import boxed, materialize, named, unboxed

#: An entry c becomes floor(SCALE * c) + OFFSET. Components kept; summaries merged in one task.
SCALE = 64
OFFSET = 1_000_000
COMPONENTS = 16
FAN_IN = 16
#: Most dimensions: a summary is a square matrix of them, and the last one comes to the driver.
MOST_DIMENSIONS = 4096
#: Entries of which SCALE * c is larger have no whole number that the sums can hold.
LARGEST = float(1 << 40)
#: Variances below this share of the largest are rounding errors of a dimension that does not vary.
NO_VARIANCE = 1e-13
ADDED = ["component", "n", "deviation", "whitened", "explained", "identity_error"]
SUMMARY = "leaf long, n long, total array<long>, basis array<double>"


@dataclass
class Whitening:
    """n, sums of the whole-number entries without OFFSET, eigenvalues and eigenvectors (one a row), and the error of the identity."""

    n: int
    total: np.ndarray
    values: np.ndarray
    vectors: np.ndarray
    trace: float
    identity_error: float


def whole(vector: Column) -> Column:
    """floor(SCALE * c) of each entry (OFFSET cancels wherever it is centred); null if an entry or the vector has none."""
    good = F.forall(vector, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c.cast("double")) * SCALE <= LARGEST))
    return F.when(good & (F.size(vector) > 0), F.transform(vector, lambda c: F.floor(c.cast("double") * SCALE).cast("long")))


def _rows(values: pd.Series, dimensions: int) -> np.ndarray:
    return np.stack(values.to_numpy()).astype(np.int64) if len(values) else np.zeros((0, dimensions), dtype=np.int64)


def decompose(rows: np.ndarray) -> np.ndarray:
    """Singular values times right vectors of rows: as many rows as dimensions at most, with the same products."""
    if len(rows) > rows.shape[1]:
        rows = np.linalg.qr(rows, mode="r")
    _, s, v = np.linalg.svd(rows, full_matrices=False)
    return s[:, None] * v


def summary(rows: np.ndarray) -> tuple[int, np.ndarray, np.ndarray]:
    """Number, exact sums, and basis about the mean of whole-number vectors."""
    total = rows.sum(axis=0)
    return len(rows), total, decompose(rows - total / max(len(rows), 1))


def merged(a: tuple[int, np.ndarray, np.ndarray], b: tuple[int, np.ndarray, np.ndarray]) -> tuple[int, np.ndarray, np.ndarray]:
    if not a[0] or not b[0]:
        return a if a[0] else b
    correction = np.sqrt(a[0] * b[0] / (a[0] + b[0])) * (a[1] / a[0] - b[1] / b[0])
    return a[0] + b[0], a[1] + b[1], decompose(np.vstack([a[2], b[2], correction[None, :]]))


def _as_row(leaf: int, s: tuple[int, np.ndarray, np.ndarray]) -> pd.DataFrame:
    return pd.DataFrame({"leaf": [leaf], "n": [s[0]], "total": [s[1].tolist()], "basis": [s[2].ravel().tolist()]})


def summaries(vectors: DataFrame, pivot: np.ndarray) -> DataFrame:
    """One summary for each task over the column x of vectors, relative to the pivot; empty tasks have none."""

    def leaves(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        so_far = (0, np.zeros(len(pivot), dtype=np.int64), np.zeros((0, len(pivot))))
        for b in batches:
            so_far = merged(so_far, summary(_rows(b["x"], len(pivot)) - pivot))
        if so_far[0]:
            yield _as_row(TaskContext.get().partitionId(), so_far)

    return vectors.select("x").mapInPandas(leaves, SUMMARY)


def merge_all(leaves: DataFrame, dimensions: int) -> tuple[int, np.ndarray, np.ndarray]:
    """The summaries of all tasks, merged level by level, FAN_IN of them in one task."""

    def merge(rows: pd.DataFrame) -> pd.DataFrame:
        so_far = (0, np.zeros(dimensions, dtype=np.int64), np.zeros((0, dimensions)))
        for r in rows.sort_values("leaf").itertuples():
            so_far = merged(so_far, (r.n, np.asarray(r.total, dtype=np.int64), np.asarray(r.basis).reshape(-1, dimensions)))
        return _as_row(int(rows["leaf"].min()) // FAN_IN, so_far)

    leaves = materialize(leaves)
    most = leaves.agg(F.max("leaf")).first()[0]
    while most is not None and most > 0:
        leaves = leaves.groupBy(F.floor(F.col("leaf") / FAN_IN)).applyInPandas(merge, SUMMARY)
        most //= FAN_IN
    found = leaves.first()
    if found is None:
        return 0, np.zeros(dimensions, dtype=np.int64), np.zeros((0, dimensions))
    return found.n, np.array(found.total, dtype=np.int64), np.array(found.basis).reshape(-1, dimensions)


def _projection(model: Whitening, components: int) -> np.ndarray:
    """What turns a centred vector into its whitened components; those without variance are NaN."""
    e = model.values[:components]
    varies = e > NO_VARIANCE * max(model.values.max(initial=0.0), 1e-300)
    return model.vectors[:components] / np.sqrt(np.where(varies, e, np.nan))[:, None]


def _identity_error(vectors: DataFrame, model: Whitening, components: int) -> float:
    """The largest entry of the whitened vectors' covariance minus the identity, over all vectors once more."""
    w = _projection(model, components)
    w = w[~np.isnan(w[:, 0])]
    k, n, mean = len(w), model.n, model.total / max(model.n, 1)

    def products(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums, squares = np.zeros(k), np.zeros((k, k))
        for b in batches:
            y = (_rows(b["x"], len(mean)) - mean) @ w.T
            sums, squares = sums + y.sum(axis=0), squares + y.T @ y
        yield pd.DataFrame({"at": np.arange(k + k * k), "v": np.concatenate([sums, squares.ravel()])})

    if not k:
        return 0.0
    v = np.zeros(k + k * k)
    for r in vectors.select("x").mapInPandas(products, "at long, v double").groupBy("at").agg(F.sum("v").alias("v")).collect():
        v[r["at"]] = r["v"]
    covariance = v[k:].reshape(k, k) / n - np.outer(v[:k], v[:k]) / n**2
    return float(np.abs(covariance - np.eye(k)).max())


def fit(vectors: DataFrame, dimensions: int, components: int = COMPONENTS) -> Whitening:
    """The principal axes of vectors(x), whole-number vectors of this many dimensions. Only d x d numbers come to the driver.

    vectors is read three times and should be a stored table: for the sums, for the decomposition about the whole-number
    mean (so that a common offset costs no digit), and for the error of the result.
    """
    if dimensions > MOST_DIMENSIONS:
        raise ValueError(f"more than {MOST_DIMENSIONS} dimensions")
    sums = vectors.select(F.posexplode("x").alias("k", "v")).groupBy("k").agg(F.sum("v").alias("s"), F.count(F.lit(1)).alias("n")).collect()
    n, total = max((r.n for r in sums), default=0), np.zeros(dimensions, dtype=np.int64)
    for r in sums:
        total[r.k] = r.s
    pivot = total // max(n, 1)
    _, _, basis = merge_all(summaries(vectors, pivot), dimensions)
    s, axes = np.zeros(dimensions), np.eye(dimensions)
    if len(basis):
        _, found, axes = np.linalg.svd(basis, full_matrices=True)
        s[: len(found)] = found
    axes = axes * np.where(axes[np.arange(dimensions), np.abs(axes).argmax(axis=1)] < 0, -1.0, 1.0)[:, None]
    values = s**2 / max(n, 1)
    model = Whitening(n, total, values, axes, float(values.sum()), 0.0)
    model.identity_error = _identity_error(vectors, model, components)
    return model


def whiten(rows: DataFrame, vector: str = "embedding", components: int = COMPONENTS, keep: tuple[str, ...] | None = None) -> DataFrame:
    """A row for each row of rows and component: component (from 1), n, deviation, whitened, explained, identity_error.

    Rows whose vector is null, empty, or has a null, non-finite or too large (LARGEST) entry are dropped, and so are
    vectors of another length than most have (of equally frequent lengths, the greater). The axes are fitted to each
    different vector once, so copies, however many, change nothing; their rows stay. A component that does not vary
    has no whitened value (null) and explains 0; a deviation beyond the range of long is null. `keep` names the columns
    of rows that the result has beside the added ones (all, if it is None). An empty table stays empty.
    """
    left = [*ADDED, *[c for c in rows.columns if keep is not None and c not in keep]]
    docs = boxed(rows, left, x=whole(named(vector))).filter("x IS NOT NULL")
    lengths = docs.groupBy(F.size("x").alias("d")).agg(F.count(F.lit(1)).alias("n"))
    usual = lengths.orderBy(F.col("n").desc(), F.col("d").desc()).first()
    dimensions = usual.d if usual else 1
    docs = docs.filter(F.size("x") == dimensions)
    model = fit(materialize(docs.select("x").distinct()), dimensions, components)
    w, n, total = _projection(model, components), model.n, model.total
    mean, k = total / max(n, 1), min(components, dimensions)

    @F.pandas_udf("deviation long, whitened array<double>")
    def apply(x: pd.Series) -> pd.DataFrame:
        v = _rows(x, dimensions)
        centred = v - mean
        far = n * n * (centred**2).sum(axis=1) >= 2.0**63 * (1 - 1e-9)
        deviation = pd.Series(((n * v - total) ** 2).sum(axis=1), dtype="Int64").mask(far)
        return pd.DataFrame({"deviation": deviation, "whitened": list(centred @ w.T)})

    share = model.values / model.trace if model.trace else np.zeros(dimensions)
    explained = F.array(*[F.lit(float(s)) for s in share[:k]])
    out = docs.withColumn("a", apply("x")).select("row", "a.deviation", F.posexplode("a.whitened").alias("c", "w"))
    whitened = F.when(~F.isnan("w"), F.col("w"))
    return out.select(
        *unboxed(rows, left), (F.col("c") + 1).cast("int").alias("component"), F.lit(n).cast("long").alias("n"), "deviation",
        whitened.alias("whitened"), F.element_at(explained, F.col("c") + 1).alias("explained"), F.lit(model.identity_error).alias("identity_error"),
    )
