"""The documents drawn towards the distribution of the benchmark."""

from loomgraph.llm.common import table
from loomgraph.llm.importance import BUCKETS, LEAST_WORDS, PERCENT, SEED, resample

NAME = "op11_importance"

#: The CRC of each different word is computed byte by byte.
ORACLE = rf"""
WITH crc_of_byte AS (
  SELECT list_transform(range(256), lambda b: list_reduce([b, 0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[], lambda c, i: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384::BIGINT) ELSE c >> 1 END)) AS t
), words AS (
  SELECT row_number() OVER () AS k, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
), target_words AS (
  SELECT unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS w FROM benchmark
), by_doc AS (
  SELECT k, w, count(*) AS n FROM (SELECT k, unnest(w) AS w FROM words) GROUP BY ALL
), different AS (
  SELECT w, regexp_extract_all(hex(encode(w)), '..') AS h FROM (SELECT w FROM by_doc UNION SELECT w FROM target_words)
), buckets AS (
  SELECT w, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(h, lambda x: ('0x' || x)::BIGINT)), lambda c, b: xor(c >> 8, t[1 + (xor(c, b) & 255)])), 4294967295::BIGINT) % {BUCKETS} AS b
  FROM different, crc_of_byte
), s AS (
  SELECT b, sum(n) AS s FROM by_doc JOIN buckets USING (w) GROUP BY b
), t AS (
  SELECT b, count(*) AS t FROM target_words JOIN buckets USING (w) GROUP BY b
), gains AS (
  SELECT b, floor(1000 * ln((coalesce(t, 0)::DOUBLE + 1) * (coalesce((SELECT sum(s) FROM s), 0)::DOUBLE + {BUCKETS}) / ((coalesce(s, 0)::DOUBLE + 1) * (coalesce((SELECT sum(t) FROM t), 0)::DOUBLE + {BUCKETS}))))::BIGINT AS gain
  FROM s FULL JOIN t USING (b)
), weights AS (
  SELECT k, floor(sum(n * gain)::DOUBLE / sum(n))::BIGINT AS weight FROM by_doc JOIN buckets USING (w) JOIN gains USING (b) GROUP BY k
), scored AS (
  SELECT doc_id, len(w)::BIGINT AS n_features, coalesce(weight, 0) AS weight,
    coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || substr(sha256('{SEED}:' || coalesce(doc_id::VARCHAR, '')), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296::DOUBLE)))::BIGINT AS score
  FROM words LEFT JOIN weights USING (k)
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY n_features >= {LEAST_WORDS} ORDER BY score DESC, doc_id) AS r, count(*) OVER (PARTITION BY n_features >= {LEAST_WORDS}) AS n FROM scored
)
SELECT doc_id, n_features, weight, score, CASE WHEN n_features >= {LEAST_WORDS} AND r <= {PERCENT} * n // 100 THEN r END AS rank FROM ranked
"""


def query(spark, sf_dir):
    out = resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), keep=("doc_id",))
    return out.select("doc_id", "n_features", "weight", "score", "rank")
