"""The resolution of calls and names itself, over facts that Spark derives from the driver tables.

A supplier is a module, a part a symbol of the smallest supplier that delivers it, a line item a call from the module of its
supplier to a part by name. Modules of nations with an odd key belong to an included project.
"""

from pyspark.sql import functions as F

from loomgraph.operators.extract import Facts
from loomgraph.operators.resolve import cross_project_candidates, resolve_calls
from loomgraph.plans.catalogue import query
from loomgraph.plans.text_queries import N1
from loomgraph.sources.store import cut, table

BUILT_INS, PLATFORM = frozenset(["smallring3", "redwidget5", "bluebolt9"]), frozenset(["smallring4", "redbolt7"])
QUALIFIER = "CASE WHEN l_linenumber = 6 THEN 'ThisObject' WHEN l_linenumber = 5 THEN concat('x', l_suppkey % 9) WHEN l_linenumber = 4 THEN concat('Object.', p_name) WHEN l_linenumber = 3 AND l_suppkey % 2 = 0 THEN caller_name WHEN l_linenumber IN (2, 3) THEN concat(s_name, '.x') END"


def _facts(spark, d) -> tuple[Facts, Facts]:
    """Facts of the asked project and of the included one."""
    supplier, part, line = (table(spark, d, t) for t in ("supplier", "part", "lineitem"))
    own = lambda project, name: F.when(F.col(project) % 2 == 0, "own").otherwise("included").alias(name)
    owner = F.when(F.col("s_suppkey") % 4 == 0, F.concat(F.lit("Owner "), (F.col("s_suppkey") % 40).cast("string")))
    modules = supplier.select(
        F.col("s_suppkey").cast("long").alias("module_id"), F.concat("s_name", F.lit(".bsl")).alias("path"), F.col("s_name").alias("name"), F.concat(F.lit("M."), "s_name").alias("full_name"),
        F.when(F.col("s_suppkey") % 3 == 0, "common_module").otherwise("catalog").alias("owner_kind"), owner.alias("owner_name"), own("s_nationkey", "project"),
    )
    home = line.groupBy(F.col("l_partkey").alias("p_partkey")).agg(F.min("l_suppkey").alias("s_suppkey"))
    parts = part.join(home, "p_partkey").join(supplier.select("s_suppkey", "s_name", "s_nationkey"), "s_suppkey")
    parts = cut(parts.select("p_partkey", "p_name", "p_size", "s_suppkey", "s_name", own("s_nationkey", "project")))
    name = F.concat_ws(" ", "p_name", F.col("p_size").cast("string"))
    symbols = parts.select(
        F.col("p_partkey").cast("long").alias("symbol_id"), F.col("s_suppkey").cast("long").alias("module_id"), name.alias("name"), (F.col("p_partkey") % 3 == 0).alias("is_export"), "project",
        F.concat("s_name", F.lit(".bsl")).alias("path"), F.when(F.col("p_size") % 2 == 0, "function").otherwise("procedure").alias("kind"), F.when(F.col("p_size") % 5 == 0, "AtServer").alias("directive"),
        F.when(F.col("p_size") % 3 == 0, F.col("p_name")).alias("region"), F.col("p_size").cast("int").alias("line_start"),
    )
    callers = supplier.select(F.col("s_suppkey").alias("l_suppkey"), F.col("s_name").alias("caller_name"), own("s_nationkey", "caller_project"))
    met = line.select("l_orderkey", "l_linenumber", "l_suppkey", F.col("l_partkey").alias("p_partkey")).join(parts, "p_partkey").join(callers, "l_suppkey")
    calls = met.select(
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).cast("long").alias("call_id"), F.col("l_suppkey").cast("long").alias("module_id"), F.concat("caller_name", F.lit(".bsl")).alias("path"),
        F.when(F.col("l_linenumber") != 7, F.col("p_partkey").cast("long")).alias("caller_id"), name.alias("name"), F.expr(QUALIFIER).alias("qualifier"),
        F.col("l_linenumber").cast("int").alias("line"), F.col("l_linenumber").cast("int").alias("column"), F.col("caller_project").alias("project"),
    )

    def facts(project: str) -> Facts:
        here = lambda t: t.filter(F.col("project") == project)
        return Facts(here(modules), here(symbols), here(calls), None, None, None, None, None, None)

    return facts("own"), facts("included")


#: The twin's candidates are counted by joins over single symbols, without the operator's tables by kind of key.
SQL = f"""WITH home AS (SELECT l_partkey AS p_partkey, min(l_suppkey) AS s_suppkey FROM lineitem GROUP BY 1
), sym AS (SELECT p_partkey AS id, s_suppkey AS m, p_partkey % 3 = 0 AS ex, p_name, s_name, p_name || ' ' || p_size AS name, {N1.format("p_name || ' ' || p_size")} AS n, s_nationkey % 2 = 1 AS inc,
  s_suppkey % 3 = 0 AS common, {N1.format('s_name')} AS q1, CASE WHEN s_suppkey % 4 = 0 THEN 'owner' || (s_suppkey % 40) END AS q2 FROM part JOIN home USING (p_partkey) JOIN supplier USING (s_suppkey)
), call0 AS (SELECT l_orderkey * 10 + l_linenumber AS call_id, l_suppkey, l_linenumber, sym.p_name, sym.n, sym.s_name, sym.id AS part_id, sym.name AS call_name, l_linenumber <> 7 AS in_symbol, c.s_name AS caller_name
  FROM lineitem JOIN sym ON l_partkey = sym.id JOIN supplier c ON c.s_suppkey = l_suppkey WHERE c.s_nationkey % 2 = 0
), call AS (SELECT *, {N1.format("split_part(" + QUALIFIER + ", '.', 1)")} AS q FROM call0
), loc AS (SELECT m, n, count(*) AS c, min(id) AS id FROM sym WHERE NOT inc GROUP BY ALL
), nam AS (SELECT DISTINCT id, n, inc, ex, unnest([q1, q2]) AS q FROM sym
), qual AS (SELECT q, n, count(*) AS c, min(id) AS id FROM nam WHERE NOT inc AND q IS NOT NULL GROUP BY ALL
), iqual AS (SELECT q, n, count(*) AS c, min(id) AS id FROM nam WHERE inc AND ex AND q IS NOT NULL GROUP BY ALL
), com AS (SELECT n, count(*) AS c, min(id) AS id FROM sym WHERE NOT inc AND ex AND common GROUP BY ALL
), exp AS (SELECT n, count(*) AS c, min(id) AS id FROM sym WHERE NOT inc AND ex GROUP BY ALL
), icom AS (SELECT n, count(*) AS c, min(id) AS id FROM sym WHERE inc AND ex AND common GROUP BY ALL
), iexp AS (SELECT n, count(*) AS c, min(id) AS id FROM sym WHERE inc AND ex GROUP BY ALL
), mods AS (SELECT DISTINCT {N1.format('s_name')} AS q FROM supplier
), res AS (SELECT call.*, CASE
  WHEN call.q = 'thisobject' AND in_symbol AND loc.c IS NOT NULL THEN CASE WHEN loc.c = 1 THEN 'same_module_object' ELSE 'ambiguous_qualified' END
  WHEN call.q IS NOT NULL AND qual.c IS NOT NULL THEN CASE WHEN qual.c = 1 THEN 'qualified_module' ELSE 'ambiguous_qualified' END
  WHEN call.q IS NOT NULL AND iqual.c IS NOT NULL THEN CASE WHEN iqual.c = 1 THEN 'included_qualified_module' ELSE 'ambiguous_included_qualified' END
  WHEN call.q IN ('object', 'thisobject') THEN 'platform_api' WHEN call.q IS NOT NULL THEN CASE WHEN mods.q IS NOT NULL THEN 'unresolved_qualified' ELSE 'dynamic_qualified' END
  WHEN in_symbol AND loc.c = 1 THEN 'same_module'
  WHEN in_symbol AND loc.c IS NULL AND com.c = 1 THEN 'global_common_module'
  WHEN in_symbol AND loc.c IS NULL AND exp.c = 1 THEN 'unique_export'
  WHEN in_symbol AND loc.c IS NULL AND exp.c IS NULL AND icom.c = 1 THEN 'included_global_common_module'
  WHEN in_symbol AND loc.c IS NULL AND exp.c IS NULL AND icom.c IS NULL AND iexp.c = 1 THEN 'included_unique_export'
  WHEN call.n IN {tuple(sorted(BUILT_INS))} THEN 'built_in' WHEN call.n IN {tuple(sorted(PLATFORM))} THEN 'platform_api'
  WHEN in_symbol AND loc.c IS NOT NULL THEN 'ambiguous_local' WHEN in_symbol AND exp.c IS NOT NULL THEN 'ambiguous_export'
  WHEN in_symbol AND icom.c IS NOT NULL THEN 'ambiguous_included_common_module' WHEN in_symbol AND iexp.c IS NOT NULL THEN 'ambiguous_included_export' ELSE 'unresolved_unqualified' END AS resolution,
  loc.id AS loc_id, qual.id AS qual_id, iqual.id AS iqual_id, com.id AS com_id, exp.id AS exp_id, icom.id AS icom_id, iexp.id AS iexp_id
  FROM call LEFT JOIN loc ON loc.m = l_suppkey AND loc.n = call.n LEFT JOIN qual ON qual.q = call.q AND qual.n = call.n LEFT JOIN iqual ON iqual.q = call.q AND iqual.n = call.n
  LEFT JOIN com ON com.n = call.n LEFT JOIN exp ON exp.n = call.n LEFT JOIN icom ON icom.n = call.n LEFT JOIN iexp ON iexp.n = call.n LEFT JOIN mods ON mods.q = call.q
), out AS (SELECT call_id, n, q, in_symbol, resolution, part_id, call_name, caller_name, l_linenumber, {QUALIFIER} AS qualifier, CASE resolution WHEN 'same_module_object' THEN loc_id WHEN 'same_module' THEN loc_id WHEN 'qualified_module' THEN qual_id WHEN 'included_qualified_module' THEN iqual_id
  WHEN 'global_common_module' THEN com_id WHEN 'unique_export' THEN exp_id WHEN 'included_global_common_module' THEN icom_id WHEN 'included_unique_export' THEN iexp_id END AS resolved_id FROM res) """


def _resolved(spark, d):
    own, included = _facts(spark, d)
    return resolve_calls(own, included, BUILT_INS, PLATFORM), _together(own, included)


def _together(own: Facts, included: Facts) -> Facts:
    both = lambda t: getattr(own, t).unionByName(getattr(included, t))
    return Facts(both("modules"), both("symbols"), both("calls"), None, None, None, None, None, None)


@query(SQL + "SELECT call_id, resolution, resolved_id FROM out")
def q_graph_resolution(spark, d):
    return _resolved(spark, d)[0].select("call_id", "resolution", "resolved_id")


@query(SQL + """, cand AS (SELECT n, q1 AS q, id FROM sym WHERE ex
), met AS (SELECT o.n, o.q, min(c.id) AS id FROM (SELECT DISTINCT n, q FROM out WHERE resolved_id IS NULL AND in_symbol) o JOIN cand c ON c.n = o.n AND (o.q IS NULL OR c.q = o.q) GROUP BY ALL HAVING count(*) = 1)
SELECT call_id, resolution, resolved_id FROM out WHERE resolved_id IS NULL AND in_symbol
UNION ALL SELECT call_id, 'cross_project_candidate', met.id FROM out o JOIN met ON met.n = o.n AND met.q IS NOT DISTINCT FROM o.q WHERE o.resolved_id IS NULL AND o.in_symbol""")
def q_graph_candidates(spark, d):
    """Open calls, and beside each the symbol of all projects that alone fits."""
    calls, every = _resolved(spark, d)
    calls = cut(calls)
    open_calls = calls.filter("resolved_id IS NULL AND caller_id IS NOT NULL")
    return open_calls.unionByName(cross_project_candidates(calls, every)).select("call_id", "resolution", "resolved_id")
