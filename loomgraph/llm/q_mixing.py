"""The mix of all documents, in the order in which training meets them first."""

from loomgraph.llm.common import table
from loomgraph.llm.mixing import plan_mix

NAME = "op4_mixing"

ORACLE = r"""
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size, md5(coalesce(doc_id::VARCHAR, '')) AS h FROM documents
), s0 AS (
  SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source
), s1 AS (
  SELECT *, [1.5, 2.0, 1.5][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT]::DOUBLE AS w0,
    [0.5, 2.0, 4.5][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT]::DOUBLE AS w1, source_size * 3 AS cap FROM s0
), s2 AS (
  SELECT *, (w0 + w1) / 2 AS w FROM s1
), s3 AS (
  SELECT *, (sum(source_size) OVER () - coalesce(sum(cap) OVER (ORDER BY cap / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::DOUBLE
    / sum(w) OVER (ORDER BY cap / w, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS lv FROM s2
), s4 AS (
  SELECT *, least(cap::DOUBLE, w * (SELECT lv FROM s3 WHERE cap >= w * lv ORDER BY cap / w LIMIT 1)) AS target FROM s3
), e AS (
  SELECT d.doc_id, d.size, s4.source_size, s4.target, w0, w1,
    coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY h, d.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start,
    CASE WHEN s4.source_size > 0 THEN floor(s4.target / s4.source_size) ELSE 0 END AS passes
  FROM d JOIN s4 ON d.source IS NOT DISTINCT FROM s4.source
), f AS (
  SELECT *, (CASE WHEN size > 0 THEN passes + CASE WHEN 2 * start + size <= 2 * (target - passes * source_size) THEN 1 ELSE 0 END ELSE 0 END)::BIGINT AS repeats FROM e
)
SELECT doc_id, size, source_size, target, size * repeats AS taken, repeats,
  CASE WHEN repeats = 0 THEN NULL WHEN abs(w1 - w0) < 1e-12 THEN start / target
    ELSE (sqrt(greatest(w0 * w0 + 2 * (w1 - w0) * (start / target * (w0 + w1) / 2), 0.0)) - w0) / (w1 - w0) END AS first_position
FROM f
"""


def query(spark, sf_dir):
    return plan_mix(table(spark, sf_dir, "documents"), keep=("doc_id",)).orderBy("first_position", "doc_id").select("doc_id", "size", "source_size", "target", "taken", "repeats", "first_position")
