"""Scans, scalar functions and text operators."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from loomgraph.functions import textfn
from loomgraph.operators import relational as R
from loomgraph.plans.catalogue import query
from loomgraph.sources.store import table

N1 = "regexp_replace(replace(lower({0}), 'ß', 'ss'), '[^0-9a-zа-яё_]+', '', 'g')"
SUFFIXES = ["ation", "ing", "ion", "ed", "er", "es", "ly", "s"]
STOP = ["the", "and", "for", "that", "was", "are", "with", "this", "les", "des", "der", "die", "und", "que", "los", "las"]


@query("SELECT CASE lang WHEN 'en' THEN 'english' WHEN 'fr' THEN 'french' WHEN 'de' THEN 'german' ELSE 'unknown' END AS language, count(*) AS files FROM documents GROUP BY 1")
def q_scan_by_language(spark, d):
    names = F.create_map(*[F.lit(x) for x in ("en", "english", "fr", "french", "de", "german")])
    language = F.coalesce(F.try_element_at(names, F.lower("lang")), F.lit("unknown"))
    return table(spark, d, "documents").groupBy(language.alias("language")).agg(F.count(F.lit(1)).alias("files"))


@query("SELECT doc_id, sha256(text) AS checksum, strlen(text)::BIGINT AS size_bytes FROM documents")
def q_checksum(spark, d):
    return table(spark, d, "documents").select("doc_id", F.sha2("text", 256).alias("checksum"), F.octet_length("text").cast("long").alias("size_bytes"))


@query(f"SELECT doc_id, sha256({N1.format('text')}) AS normalized FROM documents")
def q_normalize(spark, d):
    return table(spark, d, "documents").select("doc_id", F.sha2(textfn.normalize("text"), 256).alias("normalized"))


@query("SELECT page_id, string_split(url, '/')[-1] AS name, concat_ws('.', string_split(url, '/')[3], CASE WHEN string_split(url, '/')[-1] = '' THEN '<module>' ELSE string_split(url, '/')[-1] END) AS display FROM pages")
def q_last_segment(spark, d):
    name = textfn.last_segment("url", "/")
    host = F.element_at(F.split("url", "/"), 3)
    return table(spark, d, "pages").select("page_id", name.alias("name"), textfn.display_name(host, F.when(name != "", name)).alias("display"))


@query("""SELECT page_id, p[4] AS kind, regexp_replace(p[5], '[.?#].*', '') AS name,
  CASE WHEN p[5] IS NULL OR p[5] = '' THEN p[4] ELSE concat_ws('.', upper(p[4]), regexp_replace(p[5], '[.?#].*', '')) END AS full_name
FROM (SELECT page_id, string_split(url, '/') AS p FROM pages)""")
def q_path_identity(spark, d):
    p = F.split("url", "/")
    kind, part = F.get(p, F.lit(3)), F.get(p, F.lit(4))
    name = F.regexp_replace(part, "[.?#].*", "")
    full = F.when(part.isNull() | (part == ""), kind).otherwise(F.concat_ws(".", F.upper(kind), name))
    return table(spark, d, "pages").select("page_id", kind.alias("kind"), name.alias("name"), full.alias("full_name"))


@query("""SELECT doc_id, CASE WHEN s = '' THEN 'question' ELSE s END AS slug FROM (
  SELECT doc_id, substr(array_to_string(regexp_extract_all(lower(text), '[0-9a-zа-яё_]+')[1:7], '-'), 1, 80) AS s FROM documents)""")
def q_slug(spark, d):
    return table(spark, d, "documents").select("doc_id", textfn.slug("text").alias("slug"))


# Word boundaries are spelled out as classes of characters, on which all engines agree.
@query(r"""SELECT conv_id, turn, CASE regexp_extract(lower(text), '(?:^|[^\p{L}\p{M}\p{Nd}\p{Pc}])(of|un|der|los|the)(?:$|[^\p{L}\p{M}\p{Nd}\p{Pc}])', 1) WHEN 'of' THEN 'select' WHEN 'the' THEN 'select' WHEN 'un' THEN 'update' WHEN 'der' THEN 'delete' WHEN 'los' THEN 'insert' END AS kind
FROM conversations""")
def q_query_kind(spark, d):
    markers = {"of": "select", "un": "update", "der": "delete", "los": "insert", "the": "select"}
    return table(spark, d, "conversations").select("conv_id", "turn", textfn.first_marker("text", markers).alias("kind"))


@query(f"""SELECT DISTINCT doc_id, {N1.format('x')} AS table_name, 'read' AS operation FROM (
  SELECT doc_id, unnest(regexp_extract_all(text, '(?:^| )of ([a-z]+)', 1)) AS x FROM documents)""")
def q_table_extract(spark, d):
    found = F.explode(F.regexp_extract_all("text", F.lit("(?:^| )of ([a-z]+)"), 1))
    rows = table(spark, d, "documents").select("doc_id", found.alias("x"))
    return rows.select("doc_id", textfn.normalize("x").alias("table_name"), F.lit("read").alias("operation")).distinct()


@query(r"""SELECT item_id, pos, w, regexp_replace(w, '^(.{4,}?)(?:ation|ing|ion|ed|er|es|ly|s)$', '\1') AS stem FROM (
  SELECT item_id, generate_subscripts(ws, 1)::BIGINT AS pos, unnest(ws) AS w FROM (SELECT item_id, regexp_extract_all(lower(text), '[0-9a-zа-яё_]+') AS ws FROM benchmark))""")
def q_stem(spark, d):
    rows = table(spark, d, "benchmark").select("item_id", F.posexplode(textfn.words("text")).alias("p", "w"))
    return rows.select("item_id", (F.col("p") + 1).cast("long").alias("pos"), "w", textfn.stem("w", SUFFIXES).alias("stem"))


@query("""SELECT item_id, n, i::BIGINT AS pos, array_to_string(ws[i:i + n - 1], ' ') AS phrase FROM (
  SELECT item_id, ws, n, unnest(range(1, len(ws) - n + 2)) AS i FROM (
    SELECT item_id, regexp_extract_all(lower(text), '[0-9a-zа-яё_]+') AS ws, unnest([4, 3, 2])::BIGINT AS n FROM benchmark))""")
def q_ngrams(spark, d):
    w = textfn.words("text")
    rows = [table(spark, d, "benchmark").select("item_id", F.lit(n).cast("long").alias("n"), F.posexplode(textfn.ngrams(w, n)).alias("p", "phrase")) for n in (4, 3, 2)]
    out = rows[0].unionByName(rows[1]).unionByName(rows[2])
    return out.select("item_id", "n", (F.col("p") + 1).cast("long").alias("pos"), "phrase")


_STOP = ", ".join(f"'{w}'" for w in STOP)


@query(f"""WITH w AS (
  SELECT conv_id, turn, generate_subscripts(ws, 1) AS pos, unnest(ws) AS term FROM (SELECT conv_id, turn, regexp_extract_all(lower(text), '[0-9a-zа-яё_]+') AS ws FROM conversations)
), f AS (
  SELECT conv_id, turn, term, min(pos) AS pos FROM w WHERE length(term) >= 3 AND term NOT IN ({_STOP}) AND NOT regexp_full_match(term, '[0-9]+') GROUP BY ALL
)
SELECT conv_id, turn, rank::BIGINT AS rank, term FROM (SELECT *, row_number() OVER (PARTITION BY conv_id, turn ORDER BY pos) AS rank FROM f) WHERE rank <= 14""")
def q_search_terms(spark, d):
    rows = table(spark, d, "conversations").select("conv_id", "turn", F.posexplode(textfn.words("text")).alias("pos", "term"))
    rows = rows.filter((F.length("term") >= 3) & ~F.col("term").isin(STOP) & ~F.col("term").rlike("^[0-9]+$"))
    first = rows.groupBy("conv_id", "turn", "term").agg(F.min("pos").alias("pos"))
    return R.top_k(first, ["conv_id", "turn"], ["pos"], 14).select("conv_id", "turn", "rank", "term")


@query("SELECT event_id, TRY_CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events")
def q_json_field(spark, d):
    return table(spark, d, "events").select("event_id", F.get_json_object("props", "$.k").try_cast("long").alias("k"))


@query("SELECT c_custkey, c_name FROM customer WHERE translate(c_name, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') LIKE '%er%1_0%'")
def q_like_ascii_ci(spark, d):
    return table(spark, d, "customer").filter(textfn.like_ascii("c_name", "ER%1_0")).select("c_custkey", "c_name")


@query(f"""SELECT conv_id, turn, (len(list_intersect(regexp_extract_all(lower(text), '[0-9a-zа-яё_]+'), ['that', 'module', 'für', 'les'])) > 0
  OR contains({N1.format('text')}, 'tionth') OR contains({N1.format('text')}, 'queaux')) AS prefers_code FROM conversations""")
def q_code_intent(spark, d):
    n = textfn.normalize("text")
    intent = F.arrays_overlap(textfn.words("text"), F.array(*map(F.lit, ("that", "module", "für", "les"))))
    return table(spark, d, "conversations").select("conv_id", "turn", (intent | n.contains("tionth") | n.contains("queaux")).alias("prefers_code"))


@query("""WITH s AS (
  SELECT conv_id, turn, role = 'user' AS o, sum(CASE WHEN role = 'user' THEN 1 WHEN role = 'assistant' AND length(text) % 2 = 0 THEN -1 ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY turn) AS s FROM conversations
), d AS (
  SELECT conv_id, turn, o, s - least(0, min(s) OVER (PARTITION BY conv_id ORDER BY turn)) AS depth FROM s
) SELECT conv_id, turn, depth::BIGINT AS depth, (
  SELECT max(a.turn) FROM d a WHERE a.conv_id = b.conv_id AND a.o AND a.turn <= b.turn AND NOT EXISTS (SELECT 1 FROM d c WHERE c.conv_id = a.conv_id AND c.turn BETWEEN a.turn AND b.turn AND c.depth < a.depth)
) AS region FROM d b""")
def q_region_stack(spark, d):
    closes = (F.col("role") == "assistant") & (F.length("text") % 2 == 0)
    rows = R.nested_regions(table(spark, d, "conversations"), ["conv_id"], "turn", F.col("role") == "user", closes, "turn")
    return rows.select("conv_id", "turn", "depth", "region")


@query("""WITH o AS (
  SELECT source, doc_id, text, row_number() OVER w AS unit, coalesce(sum(length(text)) OVER (PARTITION BY source ORDER BY n_chars DESC, doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS used
  FROM documents WINDOW w AS (PARTITION BY source ORDER BY n_chars DESC, doc_id)
) SELECT source, doc_id, unit::BIGINT AS unit, used::BIGINT AS used, length(substr(text, 1, (60000 - used)::BIGINT))::BIGINT AS chars FROM o WHERE used < 60000 AND unit <= 30""")
def q_source_budget(spark, d):
    rows = table(spark, d, "documents").select("source", "doc_id", "text", "n_chars")
    units = R.running_budget(rows, ["source"], [F.col("n_chars").desc(), "doc_id"], "text", 60_000, 30)
    return units.select("source", "doc_id", "unit", "used", F.length("text").cast("long").alias("chars"))


@query("""WITH u AS (
  SELECT doc_id, row_number() OVER (PARTITION BY lang ORDER BY doc_id) AS unit, lang, text FROM documents
), c AS (
  SELECT lang, count(*) AS turns, count(*) FILTER (role = 'user') AS users FROM conversations JOIN (SELECT DISTINCT lang FROM documents) ON true GROUP BY lang
)
SELECT u.lang, count(*)::BIGINT AS units, sum(length(text))::BIGINT AS source_chars, min(doc_id) AS first_unit, any_value(turns)::BIGINT AS turns, any_value(users)::BIGINT AS users FROM u JOIN c ON u.lang = c.lang WHERE unit <= 30 GROUP BY u.lang""")
def q_context_package(spark, d):
    units = R.top_k(table(spark, d, "documents").select("lang", "doc_id", F.length("text").alias("n")), ["lang"], ["doc_id"], 30)
    counts = R.count_where(table(spark, d, "conversations"), turns=F.lit(True), users=F.col("role") == "user")
    sums = units.groupBy("lang").agg(F.count(F.lit(1)).alias("units"), F.sum("n").alias("source_chars"), F.min("doc_id").alias("first_unit"))
    return sums.crossJoin(F.broadcast(counts))  # one row of counts


@query("""SELECT doc_id, length(text)::BIGINT AS body, greatest(800, CASE WHEN length(text) > 2000 THEN floor(length(text) * 8 / 10) ELSE length(text) END)::BIGINT AS shortened,
  CASE WHEN n_chars >= 80 THEN n_chars // 2 ELSE n_chars END AS halved FROM documents""")
def q_prompt_trim(spark, d):
    n = F.length("text")
    short = F.greatest(F.lit(800), F.when(n > 2000, F.floor(n * 8 / 10)).otherwise(n))
    halved = F.when(F.col("n_chars") >= 80, F.floor(F.col("n_chars") / 2)).otherwise(F.col("n_chars"))
    return table(spark, d, "documents").select("doc_id", n.cast("long").alias("body"), short.cast("long").alias("shortened"), halved.cast("long").alias("halved"))
