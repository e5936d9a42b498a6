"""Language identification: nearest centroid of normalised TF-IDF character n-gram vectors, with distance-based rejection.

Each language has several centroids, found by clustering a bounded sample of its documents; a text takes the language
of the centroid with the greatest cosine, and is rejected if that cosine is lower than the centroid's own documents reach.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomgraph.llm.common import boxed, unboxed

#: Hashed n-gram dimensions; orders of n-grams.
DIMENSIONS = 1 << 13
ORDERS = (1, 2, 3)
#: Bound on the sample that fit() reads: documents of a language, whole texts.
MAX_PER_LANGUAGE = 400
CENTROIDS = 4
#: Parts of a language in which the sample is looked for first.
SALTS = 16
#: Standard deviations below a centroid's mean cosine at which a text is rejected.
REJECT_AT = 4.0
ADDED = ["language", "language_score", "language_rejected"]

_LETTERS: list[np.ndarray] = []
_MULTIPLIERS = np.array([0x9E3779B1, 0x85EBCA6B, 0xC2B2AE35], dtype=np.uint32)


def letters() -> np.ndarray:
    """For each code point whether it is a letter."""
    if not _LETTERS:
        _LETTERS.append(np.fromiter((chr(i).isalpha() for i in range(0x110000)), dtype=bool, count=0x110000))
    return _LETTERS[0]


def ngram_counts(text: str | None) -> np.ndarray | None:
    """Hashed n-gram counts of the lower-case letters, runs of anything else as one space; None without a letter."""
    points = np.frombuffer((text or "").lower().encode("utf-32-le", "surrogatepass"), dtype="<u4")
    is_letter = letters()[points] if len(points) else np.zeros(0, bool)
    if not is_letter.any():
        return None
    keep = is_letter.copy()
    keep[1:] |= is_letter[:-1]  # the first of each run of others
    points = np.concatenate([[32], np.where(is_letter, points, 32)[keep], [32]]).astype(np.uint32)
    out = np.zeros(DIMENSIONS, dtype=np.float32)
    for n in ORDERS:
        if len(points) >= n:
            h = np.full(len(points) - n + 1, n * 7919, dtype=np.uint32)
            for k in range(n):
                h = (h ^ points[k : len(points) - n + 1 + k]) * _MULTIPLIERS[k]
                h ^= h >> np.uint32(15)
            out += np.bincount(h & np.uint32(DIMENSIONS - 1), minlength=DIMENSIONS)
    return out


def weighted(counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    """Unit vectors of sublinear term frequency times inverse document frequency."""
    v = np.log1p(counts) * idf
    return v / np.maximum(np.linalg.norm(v, axis=-1, keepdims=True), 1e-12)


@dataclass
class Model:
    idf: np.ndarray
    languages: list[str]
    centroids: np.ndarray
    least: np.ndarray

    def predict(self, text: str | None) -> tuple[str | None, float, bool]:
        counts = ngram_counts(text)
        if counts is None or not self.languages:
            return None, 0.0, True
        cosines = self.centroids @ weighted(counts, self.idf)
        best = int(np.argmax(cosines))
        return self.languages[best], float(np.clip(cosines[best], 0, 1)), bool(cosines[best] < self.least[best])


def cluster(vectors: np.ndarray, k: int, rounds: int = 10) -> tuple[np.ndarray, np.ndarray]:
    """Spherical k-means from farthest-first seeds: unit centroids, and the cosine at which each rejects."""
    seeds = [0]
    while len(seeds) < min(k, len(vectors)):
        seeds.append(int(np.argmin((vectors @ vectors[seeds].T).max(axis=1))))
    centroids = vectors[seeds]
    for _ in range(rounds):
        owner = np.argmax(vectors @ centroids.T, axis=1)
        means = np.stack([vectors[owner == i].mean(axis=0) if (owner == i).any() else centroids[i] for i in range(len(centroids))])
        centroids = means / np.maximum(np.linalg.norm(means, axis=1, keepdims=True), 1e-12)
    cosines = vectors @ centroids.T
    owner = np.argmax(cosines, axis=1)
    own = [cosines[owner == i, i] for i in range(len(centroids))]
    return centroids, np.array([c.mean() - REJECT_AT * max(c.std(), 0.02) if len(c) else 0.0 for c in own])


def fit(docs: DataFrame, per_language: int = MAX_PER_LANGUAGE, centroids: int = CENTROIDS) -> Model:
    """Learn from docs(doc_id, text, lang); null languages and texts without a letter teach nothing.

    At most `per_language` documents of each language, chosen by a hash of the id, are read; the model's size depends on
    the number of languages alone. Without a usable row the model knows no language.
    """
    known = docs.filter(F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}"))
    ids = known.select("doc_id", "lang", F.xxhash64("doc_id").alias("h")).withColumn("salt", F.pmod("h", F.lit(SALTS)))
    for keys in (["lang", "salt"], ["lang"]):  # a language of any size is cut in parts first
        order = Window.partitionBy(*keys).orderBy("h", "doc_id")
        ids = ids.withColumn("n", F.row_number().over(order)).filter(F.col("n") <= per_language).drop("n")
    # At most per_language rows of two columns for each language.
    sample = known.select("doc_id", "text", "lang").join(F.broadcast(ids.select("doc_id", "lang")), ["doc_id", "lang"])

    def document_frequencies(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen, n = np.zeros(DIMENSIONS, dtype=np.int64), 0
        for batch in batches:
            for text in batch["text"]:
                counts = ngram_counts(text)
                if counts is not None:
                    seen, n = seen + (counts > 0), n + 1
        yield pd.DataFrame({"n": [n], "seen": [seen.tolist()]})

    parts = sample.select("text").coalesce(4).mapInPandas(document_frequencies, "n long, seen array<long>").collect()
    n, seen = sum(r.n for r in parts), np.sum([r.seen for r in parts], axis=0) if parts else np.zeros(DIMENSIONS)
    idf = np.log((1 + n) / (1 + seen)).astype(np.float32) + 1

    def centroids_of(group: pd.DataFrame) -> pd.DataFrame:
        counts = [c for c in map(ngram_counts, group.sort_values("doc_id")["text"]) if c is not None]
        found, least = cluster(weighted(np.stack(counts), idf), centroids) if counts else (np.zeros((0, DIMENSIONS)), np.zeros(0))
        return pd.DataFrame({"lang": [group["lang"].iloc[0]] * len(found), "v": list(found.astype(np.float32)), "least": least})

    rows = sample.groupBy("lang").applyInPandas(centroids_of, "lang string, v array<float>, least double").collect()
    rows.sort(key=lambda r: (r.lang, list(r.v)))
    return Model(idf, [r.lang for r in rows], np.array([r.v for r in rows], dtype=np.float32), np.array([r.least for r in rows]))


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """docs with language, language_score (cosine, 0 to 1), language_rejected; columns of those names are replaced.

    The nearest language is named even when it is rejected. Texts that are null or have no letter have language null,
    score 0, and are rejected. No column but text is read.
    """

    @F.pandas_udf("language string, score double, rejected boolean")
    def nearest(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for batch in texts:
            yield pd.DataFrame([model.predict(t) for t in batch], columns=["language", "score", "rejected"])

    rows = boxed(docs, ADDED, found=nearest("text"))
    return rows.select(*unboxed(docs, ADDED), *[F.col("found")[b].alias(a) for a, b in zip(ADDED, ("language", "score", "rejected"))])
