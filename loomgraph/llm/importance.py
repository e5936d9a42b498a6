"""Importance resampling towards a target distribution over hashed n-grams, with checksums that are combined.

Each word's CRC is computed once. That of a longer n-gram follows from its words' by CRC algebra: appending m bytes to a
text multiplies its CRC by a 32 x 32 matrix over GF(2), so crc(a + b) = M^len(b) crc(a) xor crc(b). M's powers of two are
kept as look-up tables, and no n-gram is ever put together as a string.

A bucket's gain says how much likelier it is in the target than in the corpus; a document's weight is the mean gain of its
features, to which Gumbel noise from its id is added. The highest sums are a draw without replacement.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomgraph.llm.common import boxed, id_text, materialize, unboxed

#: Buckets of features, words in the longest feature, words that a document needs to be drawn, percentage drawn, seed.
BUCKETS = 10_000
ORDERS = 1
LEAST_WORDS = 20
PERCENT = 10
SEED = 2024
#: Most buckets: each task holds the counts and the gains of all of them.
MOST_BUCKETS = 1 << 24
#: Longer words are rare and get their CRC one by one.
LONG_WORD = 48
#: About as many characters are worked on at a time.
PIECE = 1 << 20
ADDED = ["n_features", "n_words", "weight", "score", "rank"]

#: Each byte of a UTF-8 text: itself, A-Z in lower case, or 0 where it is part of no word.
_BYTES = np.array([b + 32 if 0x41 <= b <= 0x5A else b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else 0 for b in range(256)], dtype=np.uint8)
#: What a byte changes in the CRC's register, which is linear in the byte.
_CRC = np.array([zlib.crc32(bytes([b])) ^ zlib.crc32(b"\0") for b in range(256)], dtype=np.uint32)
_SPACE = np.uint32(zlib.crc32(b" "))


def _tables(column: np.ndarray) -> np.ndarray:
    """A GF(2) matrix, given by what it makes of each bit, as look-up tables of four bytes."""
    values = np.arange(256, dtype=np.uint32)
    out = np.zeros((4, 256), dtype=np.uint32)
    for byte in range(4):
        for bit in range(8):
            out[byte] ^= np.where(values >> np.uint32(bit) & np.uint32(1), column[8 * byte + bit], np.uint32(0))
    return out


def _times(tables: np.ndarray, crc: np.ndarray) -> np.ndarray:
    return tables[0][crc & 0xFF] ^ tables[1][crc >> np.uint32(8) & 0xFF] ^ tables[2][crc >> np.uint32(16) & 0xFF] ^ tables[3][crc >> np.uint32(24)]


def _powers() -> list[np.ndarray]:
    """Tables of M, M^2, M^4 ..., M being the matrix of one byte appended."""
    bits = np.uint32(1) << np.arange(32, dtype=np.uint32)
    out = [_tables(bits >> np.uint32(8) ^ _CRC[bits & 0xFF])]
    while len(out) < 40:
        out.append(_tables(_times(out[-1], _times(out[-1], bits))))
    return out


_SHIFT = _powers()


def shifted(crc: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Each CRC times M to the power of its length."""
    crc, lengths, k = crc.copy(), lengths.astype(np.int64), 0
    while lengths.any():
        odd = (lengths & 1).astype(bool)
        crc[odd] = _times(_SHIFT[k], crc[odd])
        lengths, k = lengths >> 1, k + 1
    return crc


def word_crcs(text: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """CRC, length in bytes and first byte of each word of UTF-8 text."""
    data = _BYTES[np.frombuffer(text, dtype=np.uint8)]
    inside = np.concatenate([[0], (data != 0).astype(np.int8), [0]])
    step = np.diff(inside)
    start, end = np.flatnonzero(step == 1), np.flatnonzero(step == -1)
    length = end - start
    register = np.full(len(start), 0xFFFFFFFF, dtype=np.uint32)
    order = np.argsort(-length, kind="stable")
    ordered = length[order]
    short = int(np.searchsorted(-ordered, -LONG_WORD))  # the first word that is not longer
    for k in range(int(ordered[short]) if short < len(order) else 0):
        now = order[short : int(np.searchsorted(-ordered, -k))]  # words with a byte at place k
        register[now] = register[now] >> np.uint32(8) ^ _CRC[(register[now] ^ data[start[now] + k]) & 0xFF]
    for i in order[:short]:
        register[i] = zlib.crc32(data[start[i] : end[i]].tobytes()) ^ 0xFFFFFFFF
    return register ^ np.uint32(0xFFFFFFFF), length, start


def words_of(text: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """word_crcs() of a text of any length, cut between words into pieces of about PIECE bytes."""
    found, at = [], 0
    while at < len(text) or not found:
        end = min(at + PIECE, len(text))
        while end < len(text) and _BYTES[text[end]]:
            end += 1
        crc, length, start = word_crcs(text[at:end])
        found.append((crc, length, start + at))
        at = end
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def few(texts: list[str | None]) -> Iterator[slice]:
    """Runs of neighbouring texts of about PIECE characters together."""
    begin = size = 0
    for i, t in enumerate(texts):
        if size and size + len(t or "") > PIECE:
            yield slice(begin, i)
            begin, size = i, 0
        size += len(t or "")
    yield slice(begin, len(texts))


def features(texts: list[str | None], orders: int, buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The buckets of all features of the texts, the text that each is of, and the number of words of each text."""
    parts = [(t or "").encode("utf-8", "replace") for t in texts]
    crc, length, start = words_of(b"\0".join(parts))
    text = np.searchsorted(np.cumsum([len(p) + 1 for p in parts]), start, side="right")
    words = np.bincount(text, minlength=len(parts))
    found, of, so_far = [crc % np.uint32(buckets)], [text], crc
    for n in range(1, orders):
        # so_far[i] is the CRC of the words i to i + n - 1; a space and the next word are appended.
        so_far = shifted(so_far[:-1], length[n:] + 1) ^ shifted(np.full(max(len(crc) - n, 0), _SPACE), length[n:]) ^ crc[n:]
        same = text[n:] == text[: len(text) - n]
        found.append(so_far[same] % np.uint32(buckets))
        of.append(text[n:][same])
    return np.concatenate(found).astype(np.int64), np.concatenate(of), words


def bucket_counts(texts: DataFrame, orders: int, buckets: int) -> DataFrame:
    """bucket and n over the column `text` of all rows. Each task counts first, so it sends a row for a bucket at most."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros(buckets, dtype=np.int64)
        for texts in (list(b["text"]) for b in batches):
            for some in few(texts):
                total += np.bincount(features(texts[some], orders, buckets)[0], minlength=buckets)
        used = np.flatnonzero(total)
        yield pd.DataFrame({"bucket": used, "n": total[used]})

    return texts.select("text").mapInPandas(count, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))


@dataclass
class Importance:
    """The gain of each bucket; features of this many words at most."""

    gains: np.ndarray
    orders: int


def fit(docs: DataFrame, target: DataFrame, orders: int = ORDERS, buckets: int = BUCKETS) -> Importance:
    """Counts the features of all texts of docs and of target. What comes to the driver is one number for a bucket.

    A null text has no features; so has an empty table, and then every count of it is 0.
    """
    if not 1 <= buckets <= MOST_BUCKETS or orders < 1:
        raise ValueError(f"1 to {MOST_BUCKETS} buckets and features of one word or more")
    both = bucket_counts(docs, orders, buckets).withColumn("t", F.lit(0)).unionByName(bucket_counts(target, orders, buckets).withColumn("t", F.lit(1)))
    counts = np.zeros((2, buckets), dtype=np.int64)
    for r in both.toPandas().itertuples():
        counts[r.t, r.bucket] = r.n
    s, t = counts.astype(float)
    return Importance(np.floor(1000 * np.log((t + 1) * (s.sum() + buckets) / ((s + 1) * (t.sum() + buckets)))).astype(np.int64), orders)


def weigh(docs: DataFrame, model: Importance) -> DataFrame:
    """docs with n_features, n_words and weight, the floored mean gain of a document's features (0 if it has none)."""
    gains, orders = model.gains, model.orders

    @F.pandas_udf("n_features long, n_words long, weight long")
    def mean(text: pd.Series) -> pd.DataFrame:
        texts, out = list(text), []
        for some in few(texts):
            bucket, of, words = features(texts[some], orders, len(gains))
            n, total = np.bincount(of, minlength=len(words)), np.zeros(len(words), dtype=np.int64)
            np.add.at(total, of, gains[bucket])
            out.append(pd.DataFrame({"n_features": n, "n_words": words, "weight": total // np.maximum(n, 1)}))
        return pd.concat(out, ignore_index=True)

    rows = boxed(docs, ADDED[:3], t=F.col("text")).withColumn("m", mean("t"))
    return rows.select(*unboxed(docs, ADDED[:3]), "m.*")


def gumbel(doc_id: str, seed: int) -> Column:
    """Noise in thousandths, from the id alone; a null id counts as empty text."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), id_text(doc_id)), 256), 1, 8), 16, 10).cast("double")
    return F.floor(F.lit(-1000) * F.log(-F.log((h + F.lit(0.5)) / F.lit(4294967296.0)))).cast("long")


def resample(
    docs: DataFrame, target: DataFrame, percent: int = PERCENT, least_words: int = LEAST_WORDS, orders: int = ORDERS, buckets: int = BUCKETS, seed: int = SEED, keep: tuple[str, ...] | None = None
) -> DataFrame:
    """docs with n_features, n_words, weight, score and rank: 1, 2, 3 ... of the documents drawn, null of the others.

    Of the documents with least_words words or more, floor(percent of them) with the highest scores are drawn; ties go to
    the smaller doc_id, null first, and rows of one id to the place of the row in the table of the weights. target needs a
    column `text`. `keep` names the columns of docs that the result needs beside the added ones (all, if it is None): what
    they leave out is never stored. Null texts have no words; columns of docs with one of the added names are replaced.

    No window holds more than the rows of one score in one file. The scores are whole numbers from a range that does not
    grow with the corpus, so counts by score come to the driver and give the rank at which each score begins.
    """
    model = fit(docs, target, orders, buckets)
    left = [*ADDED, *[c for c in docs.columns if keep is not None and c not in keep]]
    rows = weigh(boxed(docs, left, i=F.col("doc_id"), text=F.col("text")), model)
    rows = materialize(rows.drop("text").withColumn("score", F.col("weight") + gumbel("i", seed)))
    rows = rows.select("*", F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("at"))
    able = rows.filter(F.col("n_words") >= least_words)
    by_score = sorted(((r.score, r.n) for r in able.groupBy("score").agg(F.count(F.lit(1)).alias("n")).collect()), reverse=True)
    drawn = percent * sum(n for _, n in by_score) // 100
    begins, above = [], 0
    for score, n in by_score:
        if above >= drawn:
            break
        begins.append((score, above))
        above += n
    out = [*unboxed(docs, left), *ADDED[:4]]
    least = begins[-1][0] if begins else None
    high = (F.col("n_words") >= least_words) & (F.col("score") >= least) if begins else F.lit(False)
    rest = rows.filter(~high).select(*out, F.lit(None).cast("long").alias("rank"))
    if not begins:
        return rest
    near = rows.filter(high)
    # Rows of one score, id and file are numbered together, such groups by id and file: no id can fill a task.
    place = ["score", "i", "file"]
    groups = near.groupBy(*place).agg(F.count(F.lit(1)).alias("n"))
    earlier = Window.partitionBy("score").orderBy("i", "file").rowsBetween(Window.unboundedPreceding, -1)
    starts = F.broadcast(docs.sparkSession.createDataFrame(begins, "score long, above long"))
    groups = groups.withColumn("before", F.coalesce(F.sum("n").over(earlier), F.lit(0))).join(starts, "score")
    groups = groups.select(*[F.col(c).alias(f"g_{c}") for c in place], (F.col("above") + F.col("before")).alias("first"))
    same = (F.col("score") == F.col("g_score")) & F.col("i").eqNullSafe(F.col("g_i")) & (F.col("file") == F.col("g_file"))
    number = F.row_number().over(Window.partitionBy(*place).orderBy("at"))
    ranked = near.withColumn("number", number).join(groups, same).withColumn("rank", (F.col("first") + F.col("number")).cast("long"))
    return rest.unionByName(ranked.select(*out, F.when(F.col("rank") <= drawn, F.col("rank")).alias("rank")))
