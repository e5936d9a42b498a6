"""Traversals: call chains over a cyclic graph of events, impact over the containment tree."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from loomgraph.operators import graph
from loomgraph.plans.catalogue import query
from loomgraph.sources.store import table

EDGES = """WITH RECURSIVE e AS (
  SELECT DISTINCT caller, callee FROM (SELECT user_id AS caller, lead(user_id) OVER (PARTITION BY event_type ORDER BY ts, event_id) AS callee FROM events) WHERE callee IS NOT NULL AND caller <> callee
), """


def _walk_sql(a: str, b: str, depth: int) -> str:
    return f"""r AS (SELECT DISTINCT user_id AS node, 0 AS k FROM events WHERE user_id % 50 = 7 UNION SELECT e.{b}, k + 1 FROM r JOIN e ON e.{a} = r.node WHERE k < {depth - 1}),
    m AS (SELECT node, min(k) AS k FROM r GROUP BY node) SELECT caller, callee, (k + 1)::BIGINT AS depth FROM e JOIN m ON e.{a} = m.node"""


OUT, IN = EDGES + _walk_sql("caller", "callee", 2), EDGES + _walk_sql("callee", "caller", 2)


def _edges(spark, d):
    """Distinct pairs of users of neighbouring events of a type.

    Events are dealt to hours, so a type of any size is many tasks; an hour's last event is followed by the first one of
    the next hour that has any, and only these first events, one row an hour, are put in order by type.
    """
    events = table(spark, d, "events").select("event_type", "ts", "event_id", "user_id", F.date_trunc("hour", "ts").alias("hour"))
    firsts = events.groupBy("event_type", "hour").agg(F.min_by("user_id", F.struct("ts", "event_id")).alias("first"))
    over = F.lead("first").over(Window.partitionBy("event_type").orderBy("hour"))
    inside = F.lead("user_id").over(Window.partitionBy("event_type", "hour").orderBy("ts", "event_id"))
    rows = events.withColumn("inside", inside).join(firsts.select("event_type", "hour", over.alias("over")), ["event_type", "hour"])
    edges = rows.select(F.col("user_id").alias("caller"), F.coalesce("inside", "over").alias("callee"))
    return edges.filter("callee IS NOT NULL AND caller <> callee").distinct()


def _seeds(spark, d):
    return table(spark, d, "events").filter("user_id % 50 = 7").select(F.col("user_id").alias("node")).distinct()


@query(OUT)
def q_calls_outgoing(spark, d):
    return graph.calls(_edges(spark, d), _seeds(spark, d), "outgoing", 2).select("caller", "callee", "depth")


@query(IN)
def q_calls_incoming(spark, d):
    return graph.calls(_edges(spark, d), _seeds(spark, d), "incoming", 2).select("caller", "callee", "depth")


@query(f"SELECT *, 'outgoing' AS direction FROM ({OUT}) UNION ALL SELECT *, 'incoming' FROM ({IN})")
def q_calls_both(spark, d):
    return graph.calls(_edges(spark, d), _seeds(spark, d), "both", 2).select("caller", "callee", "depth", "direction")


CONTAINS = """SELECT 'region' AS source_kind, r_regionkey::BIGINT AS source_id, 'nation' AS target_kind, n_nationkey::BIGINT AS target_id FROM nation JOIN region ON n_regionkey = r_regionkey
  UNION ALL SELECT 'nation', c_nationkey::BIGINT, 'customer', c_custkey FROM customer UNION ALL SELECT 'customer', o_custkey, 'order', o_orderkey FROM orders"""


def _contains(spark, d):
    """Typed containment edges parent -> child."""
    edge = lambda a, x, b, y: [F.lit(a).alias("source_kind"), F.col(x).cast("long").alias("source_id"), F.lit(b).alias("target_kind"), F.col(y).cast("long").alias("target_id")]
    nation = table(spark, d, "nation").select(*edge("region", "n_regionkey", "nation", "n_nationkey"))
    customer = table(spark, d, "customer").select(*edge("nation", "c_nationkey", "customer", "c_custkey"))
    return nation.unionByName(customer).unionByName(table(spark, d, "orders").select(*edge("customer", "o_custkey", "order", "o_orderkey")))


@query(CONTAINS)
def q_contains_edges(spark, d):
    return _contains(spark, d)


@query(f"""WITH RECURSIVE e AS ({CONTAINS}), r AS (SELECT 'region' AS kind, 2::BIGINT AS id, 0 AS k UNION ALL SELECT e.target_kind, e.target_id, k + 1 FROM r JOIN e ON e.source_kind = r.kind AND e.source_id = r.id WHERE k < 2)
SELECT e.source_kind AS dependent_kind, e.source_id AS dependent_id, e.target_kind AS kind, e.target_id AS id, (k + 1)::BIGINT AS depth FROM r JOIN e ON e.source_kind = r.kind AND e.source_id = r.id""")
def q_impact_bfs(spark, d):
    """Which nations, customers and orders hang on one region: dependents point at what they depend on, and the walk goes against that."""
    e = _contains(spark, d)
    depends = e.select(F.col("target_kind").alias("source_kind"), F.col("target_id").alias("source_id"), F.col("source_kind").alias("target_kind"), F.col("source_id").alias("target_id"))
    seeds = spark.range(2, 3).select(F.lit("region").alias("kind"), "id")
    met = graph.impact(depends, seeds, 3)
    return met.select(F.col("target_kind").alias("dependent_kind"), F.col("target_id").alias("dependent_id"), F.col("source_kind").alias("kind"), F.col("source_id").alias("id"), "depth")


@query(f"""SELECT source_kind, source_id, target_kind, target_id, 1::BIGINT AS depth FROM ({CONTAINS}) WHERE source_kind = 'region' AND source_id IN (1, 3) OR source_kind = 'customer' AND source_id IN (SELECT c_custkey FROM customer WHERE c_acctbal < -900)""")
def q_outgoing_edges(spark, d):
    poor = table(spark, d, "customer").filter("c_acctbal < -900").select(F.lit("customer").alias("source_kind"), F.col("c_custkey").alias("source_id"))
    regions = table(spark, d, "region").filter("r_regionkey IN (1, 3)").select(F.lit("region").alias("source_kind"), F.col("r_regionkey").cast("long").alias("source_id"))
    met = graph.walk(_contains(spark, d), poor.unionByName(regions), ["source_kind", "source_id"], ["target_kind", "target_id"], 1)
    return met.select("source_kind", "source_id", "target_kind", "target_id", "depth")


@query(EDGES + "s AS (SELECT 1) SELECT caller, callee, 'module.' || caller AS caller_name, 'module.' || callee AS callee_name FROM e WHERE contains('module.' || callee, 'e.12') ORDER BY caller, callee LIMIT 200")
def q_callers_direct(spark, d):
    rows = _edges(spark, d).select("caller", "callee", textname("caller").alias("caller_name"), textname("callee").alias("callee_name"))
    return rows.filter(F.col("callee_name").contains("e.12")).orderBy("caller", "callee").limit(200)


def textname(column: str):
    return F.concat(F.lit("module."), F.col(column).cast("string"))
