"""All documents without later copies of repeated runs of lines."""

from pyspark.sql import functions as F

from loomgraph.llm.common import table, text_or_empty
from loomgraph.llm.line_dedup import line_dedup

NAME = "op6_line_dedup"

#: Every window of neighbouring lines is spelled out and grouped by its text; :documents is the table read.
CLEANED = r"""
WITH RECURSIVE l0 AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS raw, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS p FROM :documents
), l1 AS (
  SELECT *, regexp_replace(raw, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g') AS line FROM l0
), l2 AS (
  SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY p) - 1 AS i, len(regexp_extract_all(line, '[^\x20\x09-\x0D]+')) AS w FROM l1 WHERE line <> ''
), l AS (
  SELECT *, sum(w) OVER (PARTITION BY doc_id ORDER BY i) AS upto FROM l2
), runs AS (
  SELECT a.doc_id, a.i AS s, min(b.i) AS e FROM l a JOIN l b ON a.doc_id = b.doc_id AND b.i BETWEEN a.i AND a.i + 9 AND b.upto - a.upto + a.w >= 10 GROUP BY ALL
  UNION
  SELECT b.doc_id, max(a.i) AS s, b.i AS e FROM l a JOIN l b ON a.doc_id = b.doc_id AND a.i BETWEEN b.i - 9 AND b.i AND b.upto - a.upto + a.w >= 10 GROUP BY ALL
), named AS (
  SELECT r.doc_id, s, e, string_agg(line, chr(10) ORDER BY i) AS name FROM runs r JOIN l ON l.doc_id = r.doc_id AND l.i BETWEEN s AND e GROUP BY ALL
), later AS (
  SELECT *, row_number() OVER (PARTITION BY name ORDER BY doc_id, s) AS n FROM named
), gone AS (
  SELECT DISTINCT l.doc_id, l.p FROM l JOIN later ON l.doc_id = later.doc_id AND l.i BETWEEN s AND e AND n > 1
), counts AS (
  SELECT doc_id, count(*) AS lines_deleted FROM gone GROUP BY doc_id
), lines_in AS (
  SELECT doc_id, count(*) AS lines_in FROM l GROUP BY doc_id
), kept AS (
  SELECT doc_id, string_agg(raw, chr(10) ORDER BY p) AS text FROM l1 ANTI JOIN gone USING (doc_id, p) GROUP BY doc_id
), cleaned AS (
  SELECT d.* REPLACE (CASE WHEN c.lines_deleted IS NULL THEN d.text ELSE coalesce(k.text, '') END AS text), coalesce(n.lines_in, 0) AS lines_in, coalesce(c.lines_deleted, 0) AS lines_deleted
  FROM :documents d LEFT JOIN counts c USING (doc_id) LEFT JOIN kept k USING (doc_id) LEFT JOIN lines_in n USING (doc_id)
)
"""
ORACLE = CLEANED.replace(":documents", "documents") + "SELECT doc_id, lines_in::BIGINT AS lines_in, lines_deleted::BIGINT AS lines_deleted, length(coalesce(text, ''))::BIGINT AS chars_kept, sha256(coalesce(text, '')) AS text_sha256 FROM cleaned"


def query(spark, sf_dir):
    out = line_dedup(table(spark, sf_dir, "documents"))
    text = text_or_empty()
    return out.select("doc_id", "lines_in", "lines_deleted", F.length(text).cast("long").alias("chars_kept"), F.sha2(text, 256).alias("text_sha256"))
