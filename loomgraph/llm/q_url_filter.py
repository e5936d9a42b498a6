"""Verdicts on the URLs of all pages."""

from pyspark.sql import functions as F

from loomgraph.llm.common import table
from loomgraph.llm.url_filter import LEAST_SOFT, REJECT_AT, VOCABULARY, Rule, filter_urls

NAME = "op12_url_filter"

RULES = [
    Rule("org", "/", "allow"),
    Rule("example.org", "/es/", "block"),
    Rule("example.org", "/en/1", "block"),
    Rule("com", "/fr/", "allow"),
    Rule("com", "/de/", "block"),
]

#: Each term as a pattern of its own, between characters that are no letters.
ORACLE = rf"""
WITH rules(host, path, verdict) AS (VALUES {", ".join(f"('{r.host}', '{r.path}', '{r.verdict}')" for r in RULES)}
), u AS (
  SELECT page_id, translate(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 2), '') AS path FROM pages
), different AS (
  SELECT DISTINCT host, path, lower(url_decode(host || path)) AS t FROM u
), met AS (
  SELECT host, path, unnest([{", ".join(f"CASE WHEN regexp_matches(t, '(^|[^\\pL]){t}($|[^\\pL])') THEN {{'term': '{t}', 'weight': {w}}} END" for t, w in VOCABULARY.items())}], recursive := true) FROM different
), hits AS (
  SELECT host, path, string_agg(term, ',' ORDER BY term) AS hits, sum(weight) AS weight,
    count(*) FILTER (weight >= {REJECT_AT}) > 0 OR (count(*) FILTER (weight < {REJECT_AT}) >= {LEAST_SOFT} AND sum(weight) FILTER (weight < {REJECT_AT}) >= {REJECT_AT}) AS bad
  FROM met WHERE term IS NOT NULL GROUP BY host, path
), ruled AS (
  SELECT d.host, d.path, arg_max(r.host || r.path, length(r.host || r.path)) AS rule, arg_max(r.verdict, length(r.host || r.path)) AS verdict
  FROM different d JOIN rules r ON (d.host = r.host OR ends_with(d.host, '.' || r.host)) AND starts_with(d.path, r.path) GROUP BY d.host, d.path
)
SELECT u.page_id, u.host, u.path, r.rule, coalesce(r.verdict, CASE WHEN h.bad THEN 'block' ELSE 'allow' END) AS verdict, coalesce(h.hits, '') AS hits, coalesce(h.weight, 0)::BIGINT AS weight
FROM u LEFT JOIN hits h USING (host, path) LEFT JOIN ruled r USING (host, path)
"""


def query(spark, sf_dir):
    out = filter_urls(table(spark, sf_dir, "pages").select("page_id", "url"), RULES)
    return out.select("page_id", *[F.col(f"url_{c}").alias(c) for c in ("host", "path", "rule", "verdict", "hits", "weight")])
