"""Joins, aggregations, searches, and incremental operators."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from loomgraph.functions import textfn
from loomgraph.operators import relational as R
from loomgraph.plans.catalogue import query
from loomgraph.plans.text_queries import N1
from loomgraph.sources.store import cut, table


def _n(x):
    return N1.format(x)


@query(f"""WITH e AS (
  SELECT 0 AS stage, p_partkey, p_name, p_brand FROM part WHERE {_n('p_name')} = (SELECT {_n('p_name')} FROM part WHERE p_partkey = 7) AND p_size > 10
  UNION ALL SELECT 1, p_partkey, p_name, p_brand FROM part WHERE p_brand = (SELECT p_brand FROM part WHERE p_partkey = 7)
) SELECT stage::BIGINT AS stage, p_partkey, p_name FROM e ORDER BY stage, p_name, p_partkey LIMIT 50""")
def q_find_exact(spark, d):
    part = table(spark, d, "part").withColumn("n", textfn.normalize("p_name"))
    term = part.filter("p_partkey = 7").select(F.col("n").alias("tn"), F.col("p_brand").alias("tb"))
    exact = part.filter("p_size > 10").join(F.broadcast(term), F.col("n") == F.col("tn"), "left_semi")
    brand = part.join(F.broadcast(term), F.col("p_brand") == F.col("tb"), "left_semi")
    cols = ["p_partkey", "p_name"]
    return R.staged_union([exact.select(*cols), brand.select(*cols)], ["p_name", "p_partkey"], 50).select("stage", *cols)


@query("""WITH e AS (
  SELECT 0 AS stage, p_partkey AS id, p_name AS name FROM part WHERE lower(p_name) LIKE '%01%' OR lower(p_brand) LIKE '%01%'
  UNION ALL SELECT 1, c_custkey, c_name FROM customer WHERE lower(c_name) LIKE '%01%'
  UNION ALL SELECT 2, s_suppkey, s_name FROM supplier WHERE lower(s_name) LIKE '%01%'
) SELECT stage::BIGINT AS stage, id, name FROM e ORDER BY stage, name, id LIMIT 100""")
def q_find_contains(spark, d):
    has = lambda c: textfn.like_ascii(c, "01")
    part = table(spark, d, "part").filter(has("p_name") | has("p_brand")).select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name"))
    customer = table(spark, d, "customer").filter(has("c_name")).select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"))
    supplier = table(spark, d, "supplier").filter(has("s_name")).select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"))
    return R.staged_union([part, customer, supplier], ["name", "id"], 100).select("stage", "id", "name")


@query("SELECT p_brand, rank::BIGINT AS rank, p_partkey FROM (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY p_type NULLS LAST, p_size DESC, p_partkey) AS rank FROM part) WHERE rank <= 20")
def q_find_symbols_topk(spark, d):
    order = [F.col("p_type").asc_nulls_last(), F.col("p_size").desc(), "p_partkey"]
    return R.top_k(table(spark, d, "part"), ["p_brand"], order, 20).select("p_brand", "rank", "p_partkey")


@query("""SELECT o_orderkey FROM orders WHERE o_orderstatus = 'O' AND o_orderpriority NOT IN ('1-URGENT', '2-HIGH') AND o_custkey IN (SELECT c_custkey FROM customer WHERE c_acctbal < 0)
  AND starts_with(o_orderpriority, '3') AND o_orderdate IS NOT NULL""")
def q_filters_mix(spark, d):
    o = table(spark, d, "orders").filter((F.col("o_orderstatus") == "O") & ~F.col("o_orderpriority").isin("1-URGENT", "2-HIGH") & F.col("o_orderpriority").startswith("3") & F.col("o_orderdate").isNotNull())
    poor = table(spark, d, "customer").filter("c_acctbal < 0").select(F.col("c_custkey").alias("o_custkey"))
    return o.join(poor, "o_custkey", "left_semi").select("o_orderkey")


@query("SELECT p_brand, p_type, count(*) AS calls, count(DISTINCT l_orderkey) AS callers FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY ALL")
def q_module_join(spark, d):
    line = table(spark, d, "lineitem").select("l_orderkey", F.col("l_partkey").alias("p_partkey"))
    rows = line.join(table(spark, d, "part").select("p_partkey", "p_brand", "p_type"), "p_partkey")
    return rows.groupBy("p_brand", "p_type").agg(F.count(F.lit(1)).alias("calls"), F.countDistinct("l_orderkey").alias("callers"))


@query("SELECT o_orderkey, coalesce(c_name, '-') AS path FROM orders LEFT JOIN (SELECT * FROM customer WHERE c_custkey % 3 > 0) ON o_custkey = c_custkey")
def q_file_left_default(spark, d):
    c = table(spark, d, "customer").filter("c_custkey % 3 > 0").select(F.col("c_custkey").alias("o_custkey"), "c_name")
    return table(spark, d, "orders").join(c, "o_custkey", "left").select("o_orderkey", F.coalesce("c_name", F.lit("-")).alias("path"))


@query("""SELECT p.p_partkey, f.owner FROM part p LEFT JOIN (
  SELECT p_brand, p_type, min(p_partkey) AS owner FROM part WHERE p_size < 10 GROUP BY ALL) f ON p.p_brand = f.p_brand AND p.p_type = f.p_type""")
def q_owner_first_match(spark, d):
    part = table(spark, d, "part")
    owners = part.filter("p_size < 10").select("p_brand", "p_type", F.col("p_partkey").alias("owner"))
    return R.first_match_join(part, owners, ["p_brand", "p_type"], ["owner"]).select("p_partkey", "owner")


# A call is a line item: its name and qualifier are those of a part two keys further on; the candidates are other parts.
CASCADE = """WITH call AS (
  SELECT l_orderkey, l_linenumber, p_name AS n, CASE WHEN l_linenumber % 2 = 0 THEN p_brand END AS q, p_brand AS own, p_size AS size, p_type AS kind FROM lineitem JOIN part ON l_partkey = p_partkey
), loc AS (
  SELECT p_brand AS own, p_name AS n, p_size AS size, count(*) AS cnt, min(p_partkey) AS id FROM part WHERE p_partkey % 3 > 0 GROUP BY ALL
), qual AS (
  SELECT p_brand AS q, p_name AS n, p_size AS size, count(*) AS cnt, min(p_partkey) AS id FROM part WHERE p_partkey % 5 > 0 GROUP BY ALL
), exp AS (
  SELECT p_name AS n, p_size AS size, count(*) AS cnt, min(p_partkey) AS id FROM part WHERE p_partkey % 7 = 0 GROUP BY ALL
), res AS (
  SELECT call.*, CASE
    WHEN call.q IS NOT NULL AND qual.cnt = 1 THEN 'qualified_module' WHEN call.q IS NOT NULL AND qual.cnt > 1 THEN 'ambiguous_qualified'
    WHEN call.q IS NOT NULL AND kind LIKE 'S%' THEN 'platform_api' WHEN call.q IS NOT NULL THEN 'dynamic_qualified'
    WHEN loc.cnt = 1 THEN 'same_module' WHEN loc.cnt > 1 THEN 'ambiguous_local' WHEN exp.cnt = 1 THEN 'unique_export' WHEN exp.cnt > 1 THEN 'ambiguous_export'
    ELSE 'unresolved_unqualified' END AS resolution,
    CASE WHEN call.q IS NOT NULL THEN CASE WHEN qual.cnt = 1 THEN qual.id END WHEN loc.cnt IS NOT NULL THEN CASE WHEN loc.cnt = 1 THEN loc.id END WHEN exp.cnt = 1 THEN exp.id END AS target
  FROM call LEFT JOIN loc ON call.own = loc.own AND call.n = loc.n AND call.size = loc.size LEFT JOIN qual ON call.q = qual.q AND call.n = qual.n AND call.size = qual.size LEFT JOIN exp ON call.n = exp.n AND call.size = exp.size
) """


def _resolved(spark, d):
    part = table(spark, d, "part").select("p_partkey", F.col("p_name").alias("n"), F.col("p_brand").alias("own"), F.col("p_size").alias("size"), F.col("p_type").alias("kind"))
    line = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_partkey").alias("p_partkey"))
    call = line.join(part, "p_partkey").drop("p_partkey").withColumn("q", F.when(F.col("l_linenumber") % 2 == 0, F.col("own")))
    local = R.sole_candidates(part.filter("p_partkey % 3 > 0"), ["own", "n", "size"], "p_partkey", "loc")
    qualified = R.sole_candidates(part.filter("p_partkey % 5 > 0").withColumnRenamed("own", "q"), ["q", "n", "size"], "p_partkey", "qual")
    exported = R.sole_candidates(part.filter("p_partkey % 7 = 0"), ["n", "size"], "p_partkey", "exp")
    rows = call.join(local, ["own", "n", "size"], "left").join(qualified, ["q", "n", "size"], "left").join(exported, ["n", "size"], "left")
    one = lambda p: F.when(F.col(f"{p}_n") == 1, F.col(f"{p}_id"))
    has_q = F.col("q").isNotNull()
    resolution = (
        F.when(has_q & (F.col("qual_n") == 1), "qualified_module")
        .when(has_q & (F.col("qual_n") > 1), "ambiguous_qualified")
        .when(has_q & F.col("kind").startswith("S"), "platform_api")
        .when(has_q, "dynamic_qualified")
        .when(F.col("loc_n") == 1, "same_module")
        .when(F.col("loc_n") > 1, "ambiguous_local")
        .when(F.col("exp_n") == 1, "unique_export")
        .when(F.col("exp_n") > 1, "ambiguous_export")
        .otherwise("unresolved_unqualified")
    )
    target = F.when(has_q, one("qual")).when(F.col("loc_n").isNotNull(), one("loc")).otherwise(one("exp"))
    return rows.withColumns({"resolution": resolution, "target": target})


@query(CASCADE + "SELECT l_orderkey, l_linenumber, resolution, target FROM res")
def q_resolution_cascade(spark, d):
    return _resolved(spark, d).select("l_orderkey", "l_linenumber", "resolution", "target")


@query(CASCADE + "SELECT count(*) AS calls, count(target) AS resolved, count(*) FILTER (resolution LIKE 'ambiguous%') AS ambiguous, count(*) FILTER (resolution LIKE 'unresolved%') AS unresolved, count(*) FILTER (resolution = 'platform_api') AS platform FROM res")
def q_resolution_counts(spark, d):
    r = F.col("resolution")
    return R.count_where(
        _resolved(spark, d), calls=F.lit(True), resolved=F.col("target").isNotNull(), ambiguous=r.startswith("ambiguous"), unresolved=r.startswith("unresolved"), platform=r == "platform_api"
    )


@query("""WITH raw AS (SELECT page_id, regexp_replace(url, '^https?://', '') AS raw FROM pages), alias AS (
  SELECT a, min(id) AS id FROM (SELECT substr(regexp_replace(url, '^https?://', ''), 1, 22 + (page_id % 9)::INT) AS a, page_id AS id FROM pages) GROUP BY a)
SELECT page_id, arg_max(a, length(a)) AS alias, arg_max(id, length(a)) AS target FROM raw LEFT JOIN alias ON starts_with(raw, a) AND length(a) > 4 GROUP BY page_id""")
def q_longest_prefix(spark, d):
    pages = table(spark, d, "pages").select("page_id", F.regexp_replace("url", "^https?://", "").alias("raw"))
    part = F.substring(F.col("raw"), F.lit(1), (22 + F.col("page_id") % 9).cast("int"))
    aliases = pages.groupBy(part.alias("alias")).agg(F.min("page_id").alias("target"))
    return R.longest_prefix_join(pages, "raw", aliases, "alias", "target").select("page_id", "alias", "target")


@query("""WITH s AS (SELECT user_id, min(event_id) AS lo, max(event_id) AS hi FROM events GROUP BY 1)
SELECT event_id, (SELECT min(user_id) FROM s WHERE events.event_id BETWEEN lo AND hi) AS symbol FROM events""")
def q_line_in_symbol(spark, d):
    events = table(spark, d, "events")
    spans = events.groupBy(F.col("user_id").alias("symbol")).agg(F.min("event_id").alias("lo"), F.max("event_id").alias("hi"))
    return R.smallest_around(events.select("event_id"), "event_id", spans, "symbol")


@query("SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM orders WHERE o_orderpriority = '1-URGENT')")
def q_frontier_semi(spark, d):
    urgent = table(spark, d, "orders").filter("o_orderpriority = '1-URGENT'").select(F.col("o_orderkey").alias("l_orderkey"))
    return table(spark, d, "lineitem").join(urgent, "l_orderkey", "left_semi").select("l_orderkey", "l_linenumber")


@query("SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderpriority = '1-URGENT' AND o_orderstatus = 'F')")
def q_visited_anti(spark, d):
    seen = table(spark, d, "orders").filter("o_orderpriority = '1-URGENT' AND o_orderstatus = 'F'").select(F.col("o_custkey").alias("c_custkey"))
    return table(spark, d, "customer").join(seen, "c_custkey", "left_anti").select("c_custkey")


# Candidates are counted per name and brand, so a group of many parts makes no pairs.
@query("""WITH c AS (SELECT l_orderkey, l_linenumber, t.p_partkey AS id, count(*) OVER (PARTITION BY l_orderkey, l_linenumber) AS n
  FROM lineitem JOIN part s ON l_partkey = s.p_partkey JOIN part t ON t.p_name = s.p_name AND t.p_size = s.p_size AND t.p_brand <> s.p_brand)
SELECT l_orderkey, l_linenumber, id, 'cross_project_candidate' AS resolution FROM c WHERE n = 1""")
def q_unique_candidate(spark, d):
    part = table(spark, d, "part").filter("p_brand IS NOT NULL")
    brands = part.groupBy("p_name", "p_size", "p_brand").agg(F.count(F.lit(1)).alias("own"), F.min("p_partkey").alias("id"))
    brand = F.struct("p_brand", "id")
    names = brands.groupBy("p_name", "p_size").agg(F.sum("own").alias("all"), F.min(brand).alias("a"), F.max(brand).alias("b"))
    # With one candidate there are two brands, and the other one has one part.
    other = F.when(F.col("a.p_brand") == F.col("p_brand"), F.col("b.id")).otherwise(F.col("a.id"))
    sole = brands.join(names, ["p_name", "p_size"]).select("p_name", "p_size", "p_brand", (F.col("all") - F.col("own")).alias("others"), other.alias("id"))
    calls = part.select("p_partkey", "p_name", "p_size", "p_brand").join(sole.filter("others > 0"), ["p_name", "p_size", "p_brand"])
    lines = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_partkey").alias("p_partkey")).join(calls, "p_partkey")
    met = lines.groupBy("l_orderkey", "l_linenumber").agg(F.sum("others").alias("n"), F.min("id").alias("id")).filter("n = 1")
    return met.select("l_orderkey", "l_linenumber", "id", F.lit("cross_project_candidate").alias("resolution"))


# A first word has no blank, so a name begins with it if the name's own first word does: each different word of a brand and
# type meets its prefixes, of the lengths that words have, once. Spark sizes tables by the bytes of their files, which can
# hold far more rows than the driver can broadcast: hence the merge joins, of plain exchanges that Spark can split.
@query("""SELECT p.p_partkey, (SELECT min(e.p_partkey) FROM part e WHERE e.p_brand = p.p_brand AND e.p_type = p.p_type AND (starts_with(e.p_name, split_part(p.p_name, ' ', 1)) OR starts_with(p.p_name, split_part(e.p_name, ' ', 1)))) AS edge FROM part p""")
def q_bidirectional_prefix(spark, d):
    part = table(spark, d, "part").select("p_partkey", "p_brand", "p_type", textfn.first_segment("p_name", " ").alias("first"))
    keys = ["p_brand", "p_type", "first"]
    words = cut(part.groupBy(*keys).agg(F.min("p_partkey").alias("id")))
    lengths = F.broadcast(words.select(F.length("first").alias("n")).distinct())
    prefixes = words.withColumnsRenamed({"first": "word", "id": "longer"}).join(lengths, F.length("word") >= F.col("n"))
    prefixes = prefixes.withColumn("first", F.substring(F.col("word"), F.lit(1), F.col("n")))
    pairs = prefixes.join(words.hint("merge"), keys)
    both = F.array(F.struct("first", F.col("longer").alias("edge")), F.struct(F.col("word").alias("first"), F.col("id").alias("edge")))
    edges = cut(pairs.select("p_brand", "p_type", F.inline(both)).groupBy(*keys).agg(F.min("edge").alias("edge")))
    return part.join(edges.hint("merge"), keys, "left").select("p_partkey", "edge")


@query("""WITH o AS (SELECT n_name, o_orderkey, row_number() OVER (PARTITION BY n_name ORDER BY o_totalprice DESC, o_orderkey) AS r
  FROM region JOIN nation ON n_regionkey = r_regionkey JOIN customer ON c_nationkey = n_nationkey JOIN orders ON o_custkey = c_custkey WHERE r_name = 'ASIA')
SELECT n_name, o_orderkey, r::BIGINT AS rank FROM o WHERE r <= 24""")
def q_seed_expand(spark, d):
    asia = table(spark, d, "region").filter("r_name = 'ASIA'").select(F.col("r_regionkey").alias("n_regionkey"))
    nation = table(spark, d, "nation").join(asia, "n_regionkey").select(F.col("n_nationkey").alias("c_nationkey"), "n_name")
    customer = table(spark, d, "customer").join(nation, "c_nationkey").select(F.col("c_custkey").alias("o_custkey"), "n_name")
    orders = table(spark, d, "orders").join(customer, "o_custkey")
    return R.top_k(orders, ["n_name"], [F.col("o_totalprice").desc(), "o_orderkey"], 24).select("n_name", "o_orderkey", "rank")


@query("""SELECT coalesce(a.o_orderkey, b.o_orderkey) AS o_orderkey, CASE WHEN b.o_orderkey IS NULL THEN 'added' WHEN a.o_orderkey IS NULL THEN 'removed'
  WHEN a.size = b.size OR a.sum = b.sum THEN 'unchanged' ELSE 'updated' END AS state
FROM (SELECT o_orderkey, o_custkey AS size, md5(o_orderpriority) AS sum FROM orders WHERE o_orderkey % 5 <> 1) a
FULL JOIN (SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN o_custkey + 1 ELSE o_custkey END AS size, md5(CASE WHEN o_orderkey % 2 = 0 THEN 'x' ELSE o_orderpriority END) AS sum FROM orders WHERE o_orderkey % 7 <> 2) b ON a.o_orderkey = b.o_orderkey""")
def q_catalog_diff(spark, d):
    o = table(spark, d, "orders")
    disk = o.filter("o_orderkey % 5 <> 1").select("o_orderkey", F.col("o_custkey").alias("size"), F.md5("o_orderpriority").alias("sum"))
    size = F.when(F.col("o_orderkey") % 3 == 0, F.col("o_custkey") + 1).otherwise(F.col("o_custkey"))
    text = F.when(F.col("o_orderkey") % 2 == 0, F.lit("x")).otherwise(F.col("o_orderpriority"))
    stored = o.filter("o_orderkey % 7 <> 2").select("o_orderkey", size.alias("size"), F.md5(text).alias("sum"))
    return R.catalog_diff(disk, stored, "o_orderkey", ["size"], "sum")


@query("""SELECT o_custkey, o_orderkey, 'old' AS version FROM orders WHERE o_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderkey % 10 = 0)
UNION ALL SELECT o_custkey, o_orderkey, 'new' FROM orders WHERE o_orderkey % 10 = 0""")
def q_file_replace(spark, d):
    o = table(spark, d, "orders").select("o_custkey", "o_orderkey")
    return R.replace_files(o.withColumn("version", F.lit("old")), o.filter("o_orderkey % 10 = 0").withColumn("version", F.lit("new")), "o_custkey")


@query("""WITH n AS (SELECT *, row_number() OVER (PARTITION BY p_name, p_size ORDER BY p_partkey) AS r FROM part), b AS (SELECT DISTINCT p_retailprice FROM n WHERE r > 1)
SELECT p_partkey, p_retailprice IN (SELECT p_retailprice FROM b) AS rejected FROM part""")
def q_unique_reject(spark, d):
    return R.reject_repeats(table(spark, d, "part"), ["p_name", "p_size"], "p_retailprice", ["p_partkey"]).select("p_partkey", "rejected")


@query("""SELECT (SELECT count(*) FROM orders) AS files, (SELECT count(*) FROM orders WHERE o_orderstatus = 'F') AS analyzed, (SELECT count(*) FROM lineitem) AS calls,
  (SELECT count(*) FROM lineitem WHERE l_returnflag = 'R') AS unresolved, (SELECT count(*) FROM customer) AS modules, (SELECT count(*) FROM customer WHERE c_acctbal < 0) AS ambiguous""")
def q_summary(spark, d):
    o = R.count_where(table(spark, d, "orders"), files=F.lit(True), analyzed=F.col("o_orderstatus") == "F")
    li = R.count_where(table(spark, d, "lineitem"), calls=F.lit(True), unresolved=F.col("l_returnflag") == "R")
    c = R.count_where(table(spark, d, "customer"), modules=F.lit(True), ambiguous=F.col("c_acctbal") < 0)
    return o.crossJoin(li).crossJoin(c)  # three one-row frames


def _audit(spark, d, value, limit=50):
    rows = table(spark, d, "events").groupBy(value.alias("value")).agg(F.count(F.lit(1)).alias("n"))
    return rows.orderBy(F.col("n").desc(), "value").limit(limit)


@query("SELECT event_type AS value, count(*) AS n FROM events GROUP BY 1 ORDER BY n DESC, value LIMIT 50")
def q_audit_reason(spark, d):
    return _audit(spark, d, F.col("event_type"))


@query("SELECT event_type || '.' || user_id AS value, count(*) AS n FROM events GROUP BY 1 ORDER BY n DESC, value LIMIT 50")
def q_audit_name(spark, d):
    return _audit(spark, d, F.concat_ws(".", "event_type", F.col("user_id").cast("string")))


@query("SELECT coalesce(CASE WHEN user_id % 3 > 0 THEN user_id::VARCHAR END, '<without qualifier>') AS value, count(*) AS n FROM events GROUP BY 1 ORDER BY n DESC, value LIMIT 50")
def q_audit_qualifier(spark, d):
    return _audit(spark, d, F.coalesce(F.when(F.col("user_id") % 3 > 0, F.col("user_id").cast("string")), F.lit("<without qualifier>")))


@query("SELECT user_id, event_type, min(event_id) AS event_id FROM events GROUP BY ALL")
def q_dedupe_impact(spark, d):
    return R.keep_first(table(spark, d, "events"), ["user_id", "event_type"], ["event_id"]).select("user_id", "event_type", "event_id")


@query("""WITH t AS (SELECT unnest(['green', 'steel', 'small', 'brass']) AS term), m AS (
  SELECT p_partkey, p_name, max(8 + least(12, length(term)) + CASE WHEN lower(p_name) = term THEN 150 WHEN contains(lower(p_name), term) THEN 35 ELSE 0 END) AS score, count(*) AS terms
  FROM part JOIN t ON contains(lower(p_name || ' ' || p_type), term) GROUP BY ALL)
SELECT p_partkey, (score + CASE WHEN terms > 1 THEN 80 ELSE 0 END)::BIGINT AS score FROM m ORDER BY score DESC, p_partkey LIMIT 12""")
def q_score_rank(spark, d):
    rows = table(spark, d, "part").select("p_partkey", F.lower("p_name").alias("name"), F.lower(F.concat_ws(" ", "p_name", "p_type")).alias("text"))
    terms = F.array(*map(F.lit, ("green", "steel", "small", "brass")))
    met = rows.withColumn("term", F.explode(F.filter(terms, lambda t: F.col("text").contains(t))))
    score = 8 + F.least(F.lit(12), F.length("term")) + F.when(F.col("name") == F.col("term"), 150).when(F.col("name").contains(F.col("term")), 35).otherwise(0)
    best = met.groupBy("p_partkey").agg(F.max(score).alias("s"), F.count(F.lit(1)).alias("n"))
    return best.select("p_partkey", (F.col("s") + F.when(F.col("n") > 1, 80).otherwise(0)).cast("long").alias("score")).orderBy(F.col("score").desc(), "p_partkey").limit(12)


@query("SELECT 'region' AS section, r_regionkey::BIGINT AS id, r_name AS name, NULL AS parent FROM region UNION ALL SELECT 'nation', n_nationkey, n_name, r_name FROM nation JOIN region ON n_regionkey = r_regionkey")
def q_snapshot_sections(spark, d):
    region = table(spark, d, "region")
    top = region.select(F.lit("region").alias("section"), F.col("r_regionkey").cast("long").alias("id"), F.col("r_name").alias("name"), F.lit(None).cast("string").alias("parent"))
    nation = table(spark, d, "nation").join(region, F.col("n_regionkey") == F.col("r_regionkey"))
    return top.unionByName(nation.select(F.lit("nation").alias("section"), F.col("n_nationkey").cast("long").alias("id"), F.col("n_name").alias("name"), F.col("r_name").alias("parent")))
