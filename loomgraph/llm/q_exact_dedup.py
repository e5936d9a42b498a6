"""Exact duplicates of all documents."""

from loomgraph.llm.common import table
from loomgraph.llm.exact_dedup import exact_dedup

NAME = "op7_exact_dedup"

ORACLE = r"""
WITH d AS (
  SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS t FROM documents
), g AS (
  SELECT t, min(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY t
)
SELECT d.doc_id, g.keep_id, g.group_size, d.doc_id = g.keep_id AS kept, sha256(d.t) AS text_sha256
FROM d JOIN g USING (t)
"""


def query(spark, sf_dir):
    return exact_dedup(table(spark, sf_dir, "documents"))
