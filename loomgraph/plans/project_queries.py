"""The answers of a project themselves, over facts that Spark derives from the driver tables.

Beside the modules, symbols and calls of the resolution, nations and customers are objects, orders are their children, every
part embeds a query, and orders refer to customers. Objects of odd nations belong to an included project, a library: its
calls and queries are not asked for.
"""

from pyspark.sql import functions as F

from loomgraph.context import outgoing, unresolved_near
from loomgraph.functions.textfn import normalize
from loomgraph.operators.extract import Facts, merged_profile
from loomgraph.operators.resolve import edges, resolve_calls
from loomgraph.plans.catalogue import query
from loomgraph.plans.resolution_queries import BUILT_INS, PLATFORM, SQL, _facts
from loomgraph.plans.text_queries import N1
from loomgraph.project import Project, Stored
from loomgraph.sources.store import cut, table

OBJECT = ["object_id", "kind", "name", "full_name", "parent", "synonym", "path", "project"]


def _objects(spark, d):
    """Objects of both projects, and beside them the customers with their orders."""
    home = lambda odd: F.when(odd, "included").otherwise("own").alias("project")
    none = F.lit(None).cast("string")
    kind = F.when(F.col("n_nationkey") % 3 == 0, "common_module").otherwise("catalog")
    nations = table(spark, d, "nation").select(
        (F.col("n_nationkey").cast("long") * 3 + 2).alias("object_id"), kind.alias("kind"), F.concat(F.lit("Owner "), F.col("n_nationkey").cast("string")).alias("name"),
        F.concat(F.lit("Region"), F.col("n_regionkey").cast("string"), F.lit(".Owner "), F.col("n_nationkey").cast("string")).alias("full_name"), none.alias("parent"), F.col("n_name").alias("synonym"),
        F.concat("n_name", F.lit(".xml")).alias("path"), home(F.col("n_nationkey") % 8 == 4),
    )
    customer = table(spark, d, "customer").select("c_custkey", "c_name", "c_mktsegment", home(F.col("c_nationkey") % 2 == 1))
    full = F.concat(F.lit("Catalog."), "c_name")
    path = F.concat("c_name", F.lit(".xml")).alias("path")
    customers = customer.select((F.col("c_custkey") * 3).alias("object_id"), F.lit("catalog").alias("kind"), F.col("c_name").alias("name"), full.alias("full_name"), none.alias("parent"), F.col("c_mktsegment").alias("synonym"), path, "project")
    placed = table(spark, d, "orders").select("o_orderkey", F.col("o_custkey").alias("c_custkey")).join(customer, "c_custkey")
    name, turn = F.concat(F.lit("Order "), F.col("o_orderkey").cast("string")), F.col("o_orderkey") % 3
    # A parent is spelled by its full name, as kind.name, or with more behind it.
    parent = F.when(turn == 0, full).when(turn == 1, F.concat(F.lit("catalog."), "c_name")).otherwise(F.concat(full, F.lit(".Goods")))
    orders = placed.select((F.col("o_orderkey") * 3 + 1).alias("object_id"), F.lit("attribute").alias("kind"), name.alias("name"), F.concat_ws(".", full, name).alias("full_name"), parent.alias("parent"), none.alias("synonym"), path, "project")
    return nations.unionByName(customers).unionByName(orders), placed


def _project(spark, d, keep: bool = False) -> Project:
    """The asked project with its library; `keep` stores calls and edges for answers that read them more than once."""
    held = cut if keep else lambda rows: rows
    own, included = _facts(spark, d)
    objects, placed = _objects(spark, d)
    objects = cut(objects)
    here = lambda rows, project: rows.filter(F.col("project") == project)
    type_of = F.when(F.col("o_orderkey") % 2 == 0, "metadata_type_reference").otherwise("manager_reference")
    references = placed.select(
        "project", F.lit(None).cast("long").alias("caller_id"), F.concat(F.lit("Catalog."), "c_name", F.lit(".Ref")).alias("target"), type_of.alias("relation"),
        F.concat("c_name", F.lit(".xml")).alias("path"), (F.col("o_orderkey") % 50).cast("int").alias("line"),
    )
    asked = F.concat(F.lit("Catalog.Customer#"), F.lpad((F.col("symbol_id") % 400).cast("string"), 9, "0"), F.lit(".Balance"))
    read, written = F.struct(asked.alias("name"), F.lit("read").alias("operation")), F.struct(F.concat(F.lit("Temp"), F.col("line_start").cast("string")).alias("name"), F.lit("write").alias("operation"))
    queries = own.symbols.select(
        F.col("symbol_id").alias("query_id"), F.when(F.col("symbol_id") % 5 != 0, F.col("symbol_id")).alias("caller_id"), "path", "line_start", F.col("line_start").alias("line_end"),
        F.lit("query").alias("kind"), F.col("name").alias("text"), F.array(read, written).alias("tables"), "project",
    )
    suppliers = table(spark, d, "supplier").select("s_name", "s_acctbal", "s_nationkey", F.when(F.col("s_nationkey") % 2 == 1, "included").otherwise("own").alias("project"))
    path = F.concat("s_name", F.lit(".bsl")).alias("path")
    errors = suppliers.filter("s_acctbal < 0").select(path, F.lit("odd").alias("error"), "project")
    directives = own.symbols.unionByName(included.symbols).filter("directive IS NOT NULL").select("path", F.col("directive").alias("name"), F.col("line_start").alias("line"), "project")
    profile = F.create_map(F.lit("last"), "s_name", F.concat(F.lit("nation "), F.col("s_nationkey").cast("string")), F.col("s_name"))
    profiles = suppliers.select(path, profile.alias("profile"), "project")
    files = lambda p: here(suppliers, p).select(path).unionByName(here(objects, p).select("path").distinct())
    sources = lambda p: here(suppliers, p).select("project", path, F.encode("s_name", "utf-8").alias("content"))

    def facts(of: Facts, p: str) -> Facts:
        rest = [here(t, p) for t in (queries, references, objects.withColumn("properties", F.create_map(F.lit("Synonym"), "synonym")), errors, directives, profiles)]
        modules = of.modules.withColumn("module_kind", F.lit("object_module"))
        return Facts(modules, of.symbols, of.calls, *rest)

    a, b = facts(own, "own"), facts(included, "included")
    resolved = held(resolve_calls(a, b, BUILT_INS, PLATFORM))
    b.calls, b.references, b.queries, none = b.calls.filter("false"), b.references.filter("false"), b.queries.filter("false"), resolved.filter("false")
    library = Project(spark, name="included", stored=Stored(b, none, held(edges(b, none)), files("included"), sources("included")))
    return Project(spark, name="own", include=[library], stored=Stored(a, resolved, held(edges(a, resolved, b)), files("own"), sources("own")))


#: The twin spells out objects, aliases and edges by plain joins.
BASE = (
    SQL
    + f""", mods2 AS (SELECT s_suppkey AS id, s_name AS name, 'M.' || s_name AS full_name, s_nationkey % 2 AS inc, CASE WHEN s_suppkey % 3 = 0 THEN 'common_module' ELSE 'catalog' END AS ok, CASE WHEN s_suppkey % 4 = 0 THEN 'Owner ' || (s_suppkey % 40) END AS owner, s_name || '.bsl' AS path FROM supplier
), ord AS (SELECT o_orderkey, c_name, c_nationkey % 2 AS inc FROM orders JOIN customer ON o_custkey = c_custkey
), obj AS (SELECT n_nationkey::BIGINT * 3 + 2 AS id, CASE WHEN n_nationkey % 3 = 0 THEN 'common_module' ELSE 'catalog' END AS kind, 'Owner ' || n_nationkey AS name, 'Region' || n_regionkey || '.Owner ' || n_nationkey AS full_name, NULL AS parent, n_name AS synonym, n_name || '.xml' AS path, CASE WHEN n_nationkey % 8 = 4 THEN 1 ELSE 0 END AS inc FROM nation
  UNION ALL SELECT c_custkey * 3, 'catalog', c_name, 'Catalog.' || c_name, NULL, c_mktsegment, c_name || '.xml', c_nationkey % 2 FROM customer
  UNION ALL SELECT o_orderkey * 3 + 1, 'attribute', 'Order ' || o_orderkey, 'Catalog.' || c_name || '.Order ' || o_orderkey, CASE o_orderkey % 3 WHEN 0 THEN 'Catalog.' || c_name WHEN 1 THEN 'catalog.' || c_name ELSE 'Catalog.' || c_name || '.Goods' END, NULL, c_name || '.xml', inc FROM ord
), names AS (SELECT id, inc, full_name, unnest([{N1.format("full_name")}, {N1.format("kind || '.' || name")}]) AS alias FROM obj
), alias AS (SELECT 0 AS side, alias, first(id ORDER BY inc, full_name, id) AS id FROM names GROUP BY alias UNION ALL SELECT 1, alias, first(id ORDER BY full_name, id) FROM names WHERE inc = 1 GROUP BY alias
), qry AS (SELECT id AS query_id, CASE WHEN id % 5 <> 0 THEN id END AS caller_id, s_name || '.bsl' AS path, split_part(name, ' ', -1)::INT AS line, unnest([{{'place': 0, 't': 'Catalog.Customer#' || lpad((id % 400)::VARCHAR, 9, '0') || '.Balance', 'op': 'read'}}, {{'place': 1, 't': 'Temp' || split_part(name, ' ', -1), 'op': 'write'}}]) AS x FROM sym WHERE NOT inc
), ask AS (SELECT 0 AS side, CASE WHEN o_orderkey % 2 = 0 THEN 'metadata' ELSE 'module' END AS source_kind, NULL::BIGINT AS source_id, 'Catalog.' || c_name || '.Ref' AS target_name, CASE WHEN o_orderkey % 2 = 0 THEN 'metadata_type_reference' ELSE 'manager_reference' END AS relation, c_name || '.xml' AS path, (o_orderkey % 50)::INT AS line, NULL::BIGINT AS child, NULL AS child_name FROM ord WHERE inc = 0
  UNION ALL SELECT 0, CASE WHEN caller_id IS NOT NULL THEN 'symbol' ELSE 'query' END, coalesce(caller_id, query_id), x.t, 'query_' || x.op, path, line, NULL, NULL FROM qry
  UNION ALL SELECT inc, 'metadata', NULL, parent, 'contains', path, NULL, id, full_name FROM obj WHERE parent IS NOT NULL
), raw AS (SELECT *, {N1.format("target_name")} AS raw FROM ask
), pre AS (SELECT side, raw, unnest(range(5, length(raw) + 1)) AS n FROM (SELECT DISTINCT side, raw FROM raw)
), best AS (SELECT pre.side, raw, arg_max(id, n) AS id FROM pre JOIN alias ON alias.side = pre.side AND alias = substr(raw, 1, n) GROUP BY ALL
), met2 AS (SELECT raw.*, best.id AS target_id FROM raw LEFT JOIN best USING (side, raw)
), own2 AS (SELECT 0 AS side, * FROM obj UNION ALL SELECT 1, * FROM obj WHERE inc = 1
), owners AS (SELECT side, kind, {N1.format("name")} AS o, first(id ORDER BY inc, full_name, id) AS id FROM own2 GROUP BY ALL
), edge AS (SELECT 'own' AS project, CASE WHEN in_symbol THEN 'symbol' ELSE 'module' END AS source_kind, CASE WHEN in_symbol THEN part_id END AS source_id, 'symbol' AS target_kind, resolved_id AS target_id, call_name AS target_name, 'calls' AS relation, caller_name || '.bsl' AS path, l_linenumber::INT AS line FROM out WHERE resolved_id IS NOT NULL
  UNION ALL SELECT 'own', source_kind, source_id, 'metadata', target_id, target_name, relation, path, line FROM met2 WHERE relation <> 'contains'
  UNION ALL SELECT CASE side WHEN 0 THEN 'own' ELSE 'included' END, 'metadata', target_id, 'metadata', child, child_name, relation, path, NULL FROM met2 WHERE relation = 'contains' AND target_id IS NOT NULL AND target_id <> child
  UNION ALL SELECT CASE m.inc WHEN 0 THEN 'own' ELSE 'included' END, 'metadata', w.id, 'module', m.id, m.name, 'contains_module', path, NULL FROM mods2 m JOIN owners w ON w.side = m.inc AND w.kind = ok AND w.o = {N1.format("owner")}
), ent AS (SELECT 'metadata' AS kind, id, name, full_name, false AS exported, synonym, 'kind=' || kind || '; synonym=' || coalesce(synonym, '-') AS details, inc FROM obj
  UNION ALL SELECT 'module', id, name, full_name, false, NULL, 'kind=object_module; owner=' || coalesce(owner, '-'), inc FROM mods2
  UNION ALL SELECT 'symbol', id, name, 'M.' || s_name || '.' || name, ex, NULL, 'kind=' || CASE WHEN split_part(name, ' ', -1)::INT % 2 = 0 THEN 'function' ELSE 'procedure' END || '; directive=' || CASE WHEN split_part(name, ' ', -1)::INT % 5 = 0 THEN 'AtServer' ELSE '-' END, inc::INT FROM sym
) """
)
EDGE = ["project", "source_kind", "source_id", "target_kind", "target_id", "target_name", "relation", "path", "line"]
TERMS = ("cold widget 24", "Customer#00000000", "Region1.Owner 2", "Catalog.Customer#000000007")


def _find_sql(term: str, most: int | None = None) -> str:
    n = "".join(c for c in term.lower() if c.isalnum())
    last = "".join(c for c in term.rpartition(".")[2].lower() if c.isalnum())
    return f"""(WITH f AS (SELECT *, CASE WHEN kind = 'symbol' AND {N1.format("name")} = '{last}' AND contains({N1.format("full_name")}, '{n}') THEN 0 WHEN kind <> 'symbol' AND (name = '{term}' OR full_name = '{term}') THEN 1
  WHEN contains(lower(name), '{term.lower()}') OR contains(lower(full_name), '{term.lower()}') OR contains(lower(coalesce(synonym, '')), '{term.lower()}') THEN 2 END::BIGINT AS stage FROM ent)
SELECT * FROM f WHERE stage < 2 OR stage = 2 AND inc NOT IN (SELECT inc FROM f WHERE stage < 2) ORDER BY inc, stage, full_name, id{f' LIMIT {most}' if most else ''})"""


PROJECT = "CASE inc WHEN 0 THEN 'own' ELSE 'included' END AS project"
OWN_EDGE = "edge WHERE project = 'own'"


@query(BASE + f"SELECT {', '.join(EDGE)} FROM edge")
def q_project_edges(spark, d):
    return _project(spark, d).edges.select(*EDGE)


@query(BASE + " UNION ALL ".join(f"SELECT '{t}' AS term, kind, id, name, full_name, exported, synonym, details, {PROJECT}, stage FROM {_find_sql(t)}" for t in TERMS))
def q_project_find(spark, d):
    p = _project(spark, d)
    found = [p.find(t, None).select(F.lit(t).alias("term"), "kind", "id", "name", "full_name", "exported", "synonym", "details", "project", "stage") for t in TERMS]
    return found[0].unionByName(found[1]).unionByName(found[2]).unionByName(found[3])


@query(BASE + f""", seed AS (SELECT kind, id FROM {_find_sql(TERMS[3], 50)}
), one AS (SELECT * FROM edge WHERE (target_kind, target_id) IN (SELECT (kind, id) FROM seed)
), two AS (SELECT DISTINCT source_kind AS kind, source_id AS id FROM one WHERE source_id IS NOT NULL AND (source_kind, source_id) NOT IN (SELECT (kind, id) FROM seed))
SELECT {', '.join(EDGE)}, 1::BIGINT AS depth FROM one UNION ALL SELECT {', '.join(EDGE)}, 2 FROM edge WHERE (target_kind, target_id) IN (SELECT (kind, id) FROM two)""")
def q_project_impact(spark, d):
    return _project(spark, d, keep=True).impact(TERMS[3], 2, None).select(*EDGE, "depth")


@query(BASE + f"""SELECT count(*) AS calls, count(resolved_id) AS resolved, count(*) FILTER (resolution LIKE 'ambiguous%') AS ambiguous, count(*) FILTER (resolution = 'built_in') AS built_in, count(*) FILTER (resolution = 'platform_api') AS platform,
  count(*) FILTER (resolution = 'dynamic_qualified') AS dynamic, count(*) FILTER (resolution LIKE 'unresolved%') AS unresolved, (SELECT count(*) FROM {OWN_EDGE} AND target_id IS NULL) AS unresolved_dependencies, (SELECT count(*) FROM {OWN_EDGE}) AS dependencies,
  (SELECT count(*) FROM sym WHERE NOT inc) AS symbols, (SELECT count(*) FROM sym WHERE NOT inc AND ex) AS exported, (SELECT count(*) FROM mods2 WHERE inc = 0) + (SELECT count(DISTINCT path) FROM obj WHERE inc = 0) AS files,
  (SELECT count(*) FROM obj WHERE inc = 0) AS metadata, (SELECT count(*) FROM mods2 WHERE inc = 0) AS modules, (SELECT count(*) FROM sym WHERE NOT inc) AS queries, (SELECT count(*) FROM supplier WHERE s_nationkey % 2 = 0 AND s_acctbal < 0) AS errors FROM out""")
def q_project_summary(spark, d):
    return _project(spark, d, keep=True).summary()


@query(BASE + """SELECT 'reason' AS by, resolution AS value, count(*) AS n FROM out GROUP BY ALL UNION ALL SELECT 'name', concat_ws('.', qualifier, call_name), count(*) FROM out WHERE resolution LIKE 'unresolved%' GROUP BY ALL
  UNION ALL SELECT 'qualifier', coalesce(qualifier, '<without qualifier>'), count(*) FROM out WHERE resolution LIKE 'unresolved%' GROUP BY ALL""")
def q_project_audit(spark, d):
    p = _project(spark, d, keep=True)
    a, b, c = (p.audit(by, None).select(F.lit(by).alias("by"), "value", "n") for by in ("reason", "name", "qualifier"))
    return a.unionByName(b).unionByName(c)


@query(BASE + f"""SELECT 'own' AS project, q.path, q.line, sym.name AS symbol, 'query' AS query_kind, x.t AS "table", x.op AS operation, EXISTS (SELECT 1 FROM {OWN_EDGE} AND edge.path = q.path AND edge.line = q.line AND relation = 'query_' || x.op AND target_id IS NOT NULL
  AND (starts_with({N1.format("target_name")}, {N1.format("x.t")}) OR starts_with({N1.format("x.t")}, {N1.format("target_name")}))) AS resolved FROM qry q LEFT JOIN sym ON sym.id = caller_id""")
def q_project_query_usage(spark, d):
    return _project(spark, d).query_usage()


@query(BASE + f"""SELECT coalesce(a.full_name, '<module>') AS caller, coalesce(b.full_name, concat_ws('.', qualifier, call_name)) AS callee, resolution, caller_name || '.bsl' AS path, l_linenumber::INT AS line
  FROM out LEFT JOIN ent a ON a.kind = 'symbol' AND in_symbol AND a.id = part_id LEFT JOIN ent b ON b.kind = 'symbol' AND b.id = resolved_id WHERE contains({N1.format("coalesce(b.full_name, concat_ws('.', qualifier, call_name))")}, 'widget1')""")
def q_project_callers(spark, d):
    return _project(spark, d).callers("widget 1")


@query(BASE + """SELECT coalesce(s.full_name, '<' || source_kind || '>') AS source_name, relation, coalesce(t.full_name, target_name) AS target_name, target_id IS NOT NULL AS resolved, path, line
  FROM edge LEFT JOIN ent s ON s.kind = source_kind AND s.id = source_id LEFT JOIN ent t ON t.kind = target_kind AND t.id = target_id WHERE contains(lower(coalesce(t.full_name, target_name)), 'customer#00000001')""")
def q_project_dependencies(spark, d):
    return _project(spark, d).dependencies("Customer#00000001", limit=None)


@query(BASE + """SELECT 'metadata:' || kind AS kind, full_name AS name, path AS place, coalesce(synonym, '') AS details FROM obj WHERE contains(lower(name || '|' || full_name || '|' || coalesce(synonym, '')), 'er 1')
  UNION ALL SELECT 'symbol:' || CASE WHEN z % 2 = 0 THEN 'function' ELSE 'procedure' END, 'M.' || s_name || '.' || name, s_name || '.bsl:' || z, 'export=' || CASE WHEN ex THEN 'True' ELSE 'False' END || '; directive=' || CASE WHEN z % 5 = 0 THEN 'AtServer' ELSE '-' END || '; region=' || CASE WHEN z % 3 = 0 THEN p_name ELSE '-' END
  FROM (SELECT *, split_part(name, ' ', -1)::INT AS z FROM sym) WHERE contains(lower(name), 'er 1')""")
def q_project_search(spark, d):
    return _project(spark, d).search("ER 1", None)


@query("""SELECT project, key, arg_max(s_name, s_name || '.bsl') AS value FROM (SELECT CASE s_nationkey % 2 WHEN 0 THEN 'own' ELSE 'included' END AS project, s_name, unnest(['last', 'nation ' || s_nationkey]) AS key FROM supplier) GROUP BY ALL""")
def q_project_profile(spark, d):
    return merged_profile(_project(spark, d).facts).select("project", F.explode("profile").alias("key", "value"))


@query(BASE + f""", found AS (SELECT kind, id FROM {_find_sql("Supplier#00000000")} UNION ALL SELECT kind, id FROM {_find_sql("Owner 8")}
), held AS (SELECT DISTINCT f.kind, f.id, coalesce(e.target_id, f.id) AS m FROM found f LEFT JOIN edge e ON f.kind = 'metadata' AND relation = 'contains_module' AND e.source_id = f.id WHERE f.kind = 'module' OR e.target_id IS NOT NULL
), ranked AS (SELECT sym.id, row_number() OVER (PARTITION BY h.kind, h.id ORDER BY (split_part(name, ' ', -1)::INT % 5 <> 0), ex DESC, split_part(name, ' ', -1)::INT, sym.id) AS r FROM held h JOIN sym ON sym.m = h.m)
SELECT id, full_name, exported, details, {PROJECT} FROM ent WHERE kind = 'symbol' AND id IN (SELECT id FROM ranked WHERE r <= 20)""")
def q_project_symbols_of_entities(spark, d):
    p = _project(spark, d, keep=True)
    found = p.find("Supplier#00000000", None).unionByName(p.find("Owner 8", None))
    return p.symbols_for_entities(found.filter("kind <> 'symbol'")).select("id", "full_name", "exported", "details", "project")


@query(BASE + f""", found AS (SELECT kind, id FROM {_find_sql(TERMS[1])}), picked AS (SELECT id FROM sym WHERE contains({N1.format("name")}, 'widget2'))
SELECT {', '.join(EDGE)}, 1::BIGINT AS depth FROM edge WHERE (source_kind, source_id) IN (SELECT (kind, id) FROM found UNION SELECT ('symbol', id) FROM picked)""")
def q_project_outgoing(spark, d):
    p = _project(spark, d)
    picked = p.facts.symbols.filter(normalize("name").contains("widget2")).select("symbol_id")
    return outgoing(p, p.find(TERMS[1], None), picked, None).select(*EDGE, "depth")


@query(BASE + f"""SELECT 'own' AS project, concat_ws('.', qualifier, call_name) AS call, resolution, caller_name || '.bsl' AS file, l_linenumber::INT AS line FROM out
  WHERE resolved_id IS NULL AND resolution NOT IN ('built_in', 'platform_api') AND in_symbol AND contains({N1.format("call_name")}, 'widget2') ORDER BY file, line, call_id LIMIT 200""")
def q_project_open_calls(spark, d):
    p = _project(spark, d)
    picked = p.facts.symbols.filter(normalize("name").contains("widget2")).select("symbol_id")
    return unresolved_near(p, picked)
