"""Kernels on small cases with nulls, ties and empty inputs."""

import random

from loomgraph.functions import textfn
from loomgraph.operators import graph
from loomgraph.operators import relational as R


def test_normalize_is_idempotent_and_drops_dots(spark):
    rows = spark.createDataFrame([("Straße.Ёлка_1",), ("A b-C",), (None,)], "x string")
    out = [r.n for r in rows.select(textfn.normalize("x").alias("n")).collect()]
    assert out == ["strasseёлка_1", "abc", None]
    assert [r.n for r in spark.createDataFrame([(o,) for o in out], "x string").select(textfn.normalize("x").alias("n")).collect()] == out


def test_walk_visits_each_node_once_and_stops_at_null(spark):
    rng = random.Random(2)
    edges = [(rng.randrange(30), rng.randrange(30)) for _ in range(60)] + [(3, None)]
    df = spark.createDataFrame(edges, "caller long, callee long")
    got = sorted((r.caller, r.callee if r.callee is not None else -1, r.depth) for r in graph.walk(df, spark.createDataFrame([(3,), (4,)], "caller long"), ["caller"], ["callee"], 3).collect())
    level, seen, want = {3, 4}, {3, 4}, []
    for depth in (1, 2, 3):
        met = [(a, b) for a, b in edges if a in level]
        want += [(a, b if b is not None else -1, depth) for a, b in met]
        level = {b for _, b in met if b is not None} - seen
        seen |= level
    assert got == sorted(want)


def test_longest_prefix(spark):
    raws = spark.createDataFrame([("catalogitems",), ("catal",), ("cat",), (None,)], "raw string")
    aliases = spark.createDataFrame([("catal", 1), ("catalogi", 2), ("cat", 3)], "alias string, id long")
    got = {r.raw: (r.alias, r.id) for r in R.longest_prefix_join(raws, "raw", aliases, "alias", "id").collect()}
    assert got == {"catalogitems": ("catalogi", 2), "catal": ("catal", 1), "cat": (None, None), None: (None, None)}


def test_running_budget_against_a_loop(spark):
    texts = ["a" * n for n in (5, 3, 8, 1, 9, 2)]
    df = spark.createDataFrame([(1, i, t) for i, t in enumerate(texts)], "g long, i long, text string")
    for keys in (["g"], []):
        got = [(r.i, r.text) for r in R.running_budget(df, keys, ["i"], "text", 18, 5).orderBy("i").collect()]
        used, want = 0, []
        for i, t in enumerate(texts[:5]):
            if used >= 18:
                break
            want.append((i, t[: 18 - used]))
            used += len(t)
        assert got == want


def test_catalog_diff_and_rejects(spark):
    disk = spark.createDataFrame([("a", 1, "x"), ("b", 2, "y"), ("c", 3, "z")], "path string, size long, sum string")
    stored = spark.createDataFrame([("b", 9, "y"), ("c", 9, "w"), ("d", 1, "q")], "path string, size long, sum string")
    assert {r.path: r.state for r in R.catalog_diff(disk, stored, "path", ["size"], "sum").collect()} == {"a": "added", "b": "unchanged", "c": "updated", "d": "removed"}
    rows = spark.createDataFrame([("A", 1), ("B", 1), ("A", 2), ("C", 2), ("D", 3)], "name string, file long")
    assert {(r.name, r.file): r.rejected for r in R.reject_repeats(rows, ["name"], "file", ["file"]).collect()} == {("A", 1): False, ("B", 1): False, ("A", 2): True, ("C", 2): True, ("D", 3): False}
    assert R.catalog_diff(disk.limit(0), stored.limit(0), "path", ["size"], "sum").count() == 0


def test_smallest_around_against_brute_force(spark):
    rng = random.Random(11)
    spans = [(v, lo := rng.randrange(-40, 5000), lo + rng.choice([-1, 0, 1, 7, 300, 2000])) for v in range(60)]
    points = [*range(-60, 200), *range(1900, 7100, 7), 2000, None]
    frame = R.smallest_around(spark.createDataFrame([(p,) for p in points], "p long"), "p", spark.createDataFrame(spans, "v long, lo long, hi long"), "v")
    want = [(p, None if p is None else min((v for v, lo, hi in spans if lo <= p <= hi), default=None)) for p in points]
    assert sorted(map(repr, ((r.p, r.v) for r in frame.collect()))) == sorted(map(repr, want))


def test_every_line_is_looked_up_in_every_symbol(spark, tmp_path):
    from loomgraph.plans import catalogue

    rows = [(i, i // 50 + 1) for i in range(3000)]
    spark.createDataFrame(rows, "event_id long, user_id long").write.parquet(f"{tmp_path}/events.parquet")
    got = {r.event_id: r.symbol for r in catalogue.QUERIES["q_line_in_symbol"](spark, str(tmp_path)).collect()}
    assert got == dict(rows)


def test_query_kind_of_rows_beyond_ascii(spark, tmp_path):
    from loomgraph.plans import catalogue

    texts = {"à un ami": "update", "für der Weg": "delete", "él, los niños": "insert", "éun unä": None, "«the»": "select", "the end": "select", "été": None, None: None}
    rows = [(i, 0, t) for i, t in enumerate(texts)]
    spark.createDataFrame(rows, "conv_id long, turn long, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    got = {r.conv_id: r.kind for r in catalogue.QUERIES["q_query_kind"](spark, str(tmp_path)).collect()}
    assert got == dict(enumerate(texts.values()))


def test_joins_over_all_rows_against_brute_force(spark, tmp_path):
    from loomgraph.plans import catalogue

    rng = random.Random(12)
    parts = [(i, rng.choice(["red", "red pin", "re pin", " x", "blue nut", "pin"]), rng.choice(["A", "B", "C", None]), rng.choice(["T", "U"]), rng.randrange(1, 6)) for i in range(40)]
    lines = [(i, 1 + i % 4, rng.randrange(40)) for i in range(120)]
    pages = [(i, "https://" + "abcdefgh.example/" + "x" * rng.randrange(20)) for i in range(30)]
    for name, rows, schema in [
        ("part", parts, "p_partkey long, p_name string, p_brand string, p_type string, p_size int"),
        ("lineitem", lines, "l_orderkey long, l_linenumber int, l_partkey long"),
        ("pages", pages, "page_id long, url string"),
    ]:
        spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/{name}.parquet")
    run = lambda q: catalogue.QUERIES[q](spark, str(tmp_path)).collect()

    want = {}
    for order, line, key in lines:
        _, name, brand, _, size = parts[key]
        met = [p[0] for p in parts if p[1] == name and p[4] == size and brand and p[2] and p[2] != brand]
        if len(met) == 1:
            want[order, line] = met[0]
    assert {(r.l_orderkey, r.l_linenumber): r.id for r in run("q_unique_candidate")} == want
    assert {line for _, line in want} == {1, 2, 3, 4}

    either = lambda p, e: e[1].startswith(p[1].split(" ")[0]) or p[1].startswith(e[1].split(" ")[0])
    want = {p[0]: min((e[0] for e in parts if p[2] and p[2:4] == e[2:4] and either(p, e)), default=None) for p in parts}
    assert {r.p_partkey: r.edge for r in run("q_bidirectional_prefix")} == want

    raw = {i: url[8:] for i, url in pages}
    aliases = {}
    for i, r in raw.items():
        aliases.setdefault(r[: 22 + i % 9], i)
    want = {i: max(((len(a), a, t) for a, t in aliases.items() if r.startswith(a)), default=(0, None, None))[1:] for i, r in raw.items()}
    assert {r.page_id: (r.alias, r.target) for r in run("q_longest_prefix")} == want


def test_prefixes_both_ways_broadcast_little_and_answer_per_row(spark, tmp_path):
    from loomgraph.plans import catalogue

    rng = random.Random(15)
    words = ["", "a", "ab", "abc", "abé", "é", "b"]
    # Keys repeat with other words, and names end at the word or go on.
    odd = [(i % 40, rng.choice([None, *words]) and rng.choice(words) + rng.choice(["", " ", " a", " abc"]), rng.choice(["A", "B", None]), "T") for i in range(80)]
    many = [(i, f"word{i % 9} of a long name", f"B{i % 20}", "U") for i in range(100, 6000)]
    alike = [(i, f"word{i}", "C", "U") for i in range(6000, 9000)]
    parts = [*odd, (None, "ab", "A", "T"), *many, *alike]
    spark.createDataFrame(parts, "p_partkey long, p_name string, p_brand string, p_type string").write.parquet(f"{tmp_path}/part.parquet")
    limit = "spark.sql.maxBroadcastTableSize"
    before = spark.conf.get(limit)
    spark.conf.set(limit, "32k")
    try:
        got = [(r.p_partkey, r.edge) for r in catalogue.QUERIES["q_bidirectional_prefix"](spark, str(tmp_path)).collect()]
    finally:
        spark.conf.set(limit, before)

    either = lambda p, e: e.startswith(p.split(" ")[0]) or p.startswith(e.split(" ")[0])
    least = {}
    for key, name, brand, kind in parts:
        if name is not None and brand and key is not None:
            word = (brand, kind, name.split(" ")[0])
            least[word] = min(key, least.get(word, key))
    groups = {}
    for (brand, kind, word), key in least.items():
        groups.setdefault((brand, kind), []).append((word, key))
    near = lambda n, b, k: min((key for word, key in groups.get((b, k), []) if either(n, word)), default=None)
    want = [(key, near(name, brand, kind) if name is not None and brand else None) for key, name, brand, kind in parts]
    assert sorted(map(repr, got)) == sorted(map(repr, want))


def test_nested_regions_against_the_parsers_stack(spark):
    from pyspark.sql import functions as F

    from loomgraph.functions.module_parser import _regions

    rng = random.Random(14)
    files = {f: [rng.choice(["#Область A%d" % rng.randrange(9), "#КонецОбласти", "#КонецОбласти", "x", "#Region B"]) for _ in range(rng.randrange(1, 40))] for f in range(25)}
    rows = spark.createDataFrame([(f, n, line) for f, lines in files.items() for n, line in enumerate(lines)], "file long, line long, text string")
    name = F.regexp_extract("text", "^#(?:Область|Region) (.+)$", 1)
    out = R.nested_regions(rows, ["file"], "line", name != "", F.col("text") == "#КонецОбласти", name).collect()
    got = {(r.file, r.line): r.region for r in out}
    assert got == {(f, n): region for f, lines in files.items() for n, region in enumerate(_regions(lines))}
    assert max(r.depth for r in out) > 2 and R.nested_regions(rows.limit(0), ["file"], "line", name != "", name == "", name).count() == 0
