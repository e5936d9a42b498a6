"""The corpus operators against brute force, round trips and edge cases."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest

from loomgraph.llm import chat_tree as ct
from loomgraph.llm import components, exact_dedup, html_extract, language_id, line_dedup, mixing, ngram_join, packing, simhash, toxicity

TOKENIZERS = pytest.importorskip("public_tokenizers")
DOCS = "doc_id long, text string, lang string, source string, n_chars long"
ODD = [(1, None), (2, ""), (3, " \n\t"), (4, "Same line of ten words that is long enough to count twice"), (5, "Same line of ten words that is long enough to count twice"), (None, "lone"), (6, "x " * 30_000), (6, "x " * 30_000)]


def docs(spark, pairs, **more):
    return spark.createDataFrame([(i, t, more.get("lang", "en"), more.get("source", "s"), len(t or "")) for i, t in pairs], DOCS)


def test_exact_dedup_separates_collisions_and_keeps_the_smallest_id(spark):
    from pyspark.sql import functions as F

    rows = docs(spark, [(3, "a  b"), (1, "a b"), (2, "c"), (5, None), (4, ""), (6, "a\nb")])
    got = {r.doc_id: (r.keep_id, r.group_size, r.kept) for r in exact_dedup.exact_dedup(rows, lambda t: F.lit(b"x")).collect()}
    assert got == {1: (1, 3, True), 3: (1, 3, False), 6: (1, 3, False), 2: (2, 1, True), 4: (4, 2, True), 5: (4, 2, False)}


def test_mixing_targets_and_limits(spark):
    rng = random.Random(1)
    rows = [(i, " ".join(["w"] * rng.randrange(1, 40)), None, s, 0) for i, s in enumerate(rng.choices(["a", "b", "c", None], [60, 20, 5, 15], k=1500))]
    plan = mixing.plan_mix(spark.createDataFrame(rows, DOCS)).collect()
    by = {}
    for r in plan:
        assert r.taken <= 3 * r.size
        t = by.setdefault(r.source, [r.source_size, r.target, 0])
        t[2] += r.taken
    total = sum(t[0] for t in by.values())
    assert abs(sum(t[1] for t in by.values()) - total) < 1e-6
    for size, target, taken in by.values():
        assert target <= 3 * size + 1e-9 and abs(taken - target) <= 40
    assert abs(by["c"][1] - 3 * by["c"][0]) < 1e-9  # weight 3 of the smallest source: held to three passes


def test_mix_is_range_sorted_and_follows_the_schedule(spark):
    rows = docs(spark, [(i, "w w w") for i in range(300)])
    out = mixing.mix(rows, schedules=((0.0, 2.0),)).collect()
    at = [r.position for r in out]
    assert at == sorted(at) and len(out) == 300
    assert sum(p < 0.5 for p in at) == pytest.approx(75, abs=2)  # a rising weight: a quarter in the first half


def test_line_dedup_against_brute_force(spark):
    rng = random.Random(3)
    line = lambda: " ".join(rng.choice("abcdefgh") for _ in range(rng.choice([1, 3, 4, 6, 12])))
    pool = [line() for _ in range(12)]
    rows = [(i, "\n".join(rng.choice(pool) if rng.random() < 0.7 else line() for _ in range(rng.randrange(0, 14)))) for i in range(60)]
    got = {r.doc_id: r.text for r in line_dedup.line_dedup(docs(spark, rows)).collect()}
    seen, gone = {}, set()
    seqs = {i: [(p, x.strip()) for p, x in enumerate(t.split("\n")) if x.strip()] for i, t in rows}
    for i, s in seqs.items():
        for a in range(len(s)):
            for b in range(a + 1, len(s) + 1):
                if sum(len(x.split()) for _, x in s[a:b]) >= 10:
                    first = seen.setdefault(tuple(x for _, x in s[a:b]), (i, a))
                    if first != (i, a):
                        gone |= {(i, p) for p, _ in s[a:b]}
    for i, t in rows:
        assert got[i] == "\n".join(x for p, x in enumerate(t.split("\n")) if (i, p) not in gone) if any(g[0] == i for g in gone) else got[i] == t


def test_simhash_near_pairs_against_brute_force(spark):
    rng = random.Random(4)
    base = [(rng.getrandbits(63), rng.getrandbits(63)) for _ in range(20)]
    prints = base + [(a ^ (1 << rng.randrange(63)), b ^ (1 << rng.randrange(63))) for a, b in base] + base[:3]
    got = {(r.a0, r.a1, r.b0, r.b1): r.distance for r in simhash.near_fingerprints(spark.createDataFrame(prints, "fp0 long, fp1 long"), 3).collect()}
    distinct = sorted(set(prints))
    want = {(*x, *y): d for x in distinct for y in distinct if x < y and (d := (x[0] ^ y[0]).bit_count() + (x[1] ^ y[1]).bit_count()) <= 3}
    assert got == want and want


def test_simhash_report(spark):
    rng = random.Random(5)
    rows = [(i * 700, " ".join(rng.choices([f"w{k}" for k in range(500)], k=200))) for i in range(30)] + [(-5, None), (99_999_999, "short")]
    got = {r.doc_id: r for r in simhash.fingerprint_report(docs(spark, rows)).collect()}
    order = sorted((i, t or "") for i, t in rows)
    for k, (i, t) in enumerate(order):
        cut = len(t) // 4
        edited = t[: len(t) - cut] + order[(k + 1) % len(order)][1][:cut]
        assert got[i].edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
    assert np.mean([got[i * 700].near_edited for i in range(30)]) > np.mean([got[i * 700].near_next for i in range(29)]) + 0.15


def test_ngram_join_against_brute_force(spark):
    rng = random.Random(6)
    vocabulary, rows = [f"w{i}" for i in range(300)], []
    for _ in range(2):
        base = rng.choices(vocabulary, k=120)
        for _ in range(60):
            w = list(base)
            for _ in range(rng.randrange(5)):
                p = rng.randrange(len(w))
                w[p : p + 1] = [] if rng.random() < 0.5 else [rng.choice(vocabulary[:5])]
            rows.append((len(rows), " ".join(w)))
    hot = " ".join(rng.choices(vocabulary, k=12))
    rows += [(1000 + i, hot + " " + " ".join(rng.choices(vocabulary, k=rng.randrange(12)))) for i in range(60)]
    rows += [(2000, None), (2001, ""), (2002, "A b"), (2003, "a B"), (2004, "a")]
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.near_duplicates(docs(spark, rows), frequent=4).collect()}
    sets = {i: set(ngram_join.shingle_set(t).tolist()) for i, t in rows}
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in sets:
        for b in sets:
            o = len(sets[a] & sets[b])
            if a < b and o and 100 * o >= 80 * (len(sets[a]) + len(sets[b]) - o):
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    assert got == {i: (len(s), find(i)) for i, s in sets.items()}


def test_ngram_join_links_members_where_one_is_larger_than_the_leader(spark):
    words = lambda c, n: [f"{c}{i}" for i in range(n)]
    leader, z = words("a", 1004), words("z", 52)  # z: 48 shingles
    y, x = leader + z + words("y", 48), leader[:854] + z + words("x", 18)
    rows = [(1 + i, " ".join(leader + words(f"c{i}_", 1))) for i in range(5)] + [(10, " ".join(leader)), (20, " ".join(y)), (30, " ".join(x))]
    sets = {i: set(ngram_join.shingle_set(t).tolist()) for i, t in rows}
    share = lambda a, b: len(sets[a] & sets[b]) / len(sets[a] | sets[b])
    assert [len(sets[i]) for i in (10, 20, 30)] == [1000, 1100, 920]
    assert share(20, 30) >= 0.8 and max(share(30, i) for i in sets if i not in (20, 30)) < 0.8
    got = {r.doc_id: r.component_id for r in ngram_join.near_duplicates(docs(spark, rows)).collect()}
    assert got == {i: 1 for i in sets}


def test_shingles_of_neighbouring_texts_are_those_of_each_alone():
    rng, texts = random.Random(8), [None, "", " ", "A b", "a\nB", "x " * 70_000]
    for _ in range(1500):
        letters = rng.choice(["ab \n", "AbC\x0b\t\r\x0c \x1c\x85\0", "Длинные \u00a0Слова", "y "])
        long = f" {'q' * rng.randrange(24, 41)} {'z' * rng.randrange(70)}"
        texts.append("".join(rng.choices(letters, k=rng.choice([0, 1, 3, 10, 50, 400]))) + rng.choice(["", " ", long]))
    words = [re.findall(rb"[^\x20\x09-\x0D]+", (t or "").encode().lower()) for t in texts]
    plain = [{tuple(w[i : i + 5]) for i in range(max(len(w) - 4, 1))} if w else set() for w in words]
    got = [s.tolist() for s in ngram_join.shingle_sets([None if t is None else t.encode() for t in texts])]
    assert [len(s) for s in got] == [len(p) for p in plain] and all(s == sorted(set(s)) for s in got)
    assert len(set().union(*got)) == len(set().union(*plain))
    assert [len(set(a) & set(b)) for a, b in zip(got, got[7:])] == [len(a & b) for a, b in zip(plain, plain[7:])]
    assert all(ngram_join.shingle_set(t).tolist() == s for t, s in zip(texts, got))


def test_ngram_join_indexes_nothing_of_families_that_have_too_little_in_common(spark, monkeypatch):
    """Tokens that one family holds alone are in no link with another: neither ranked nor indexed."""
    passage = [f"p{i}" for i in range(20)]
    rows = [(10 * g + k, " ".join([f"g{g}w{i}" for i in range(60)] + passage + [f"own{g}_{k}"])) for g in range(3) for k in range(4)]
    ranked, index = [], ngram_join._index
    monkeypatch.setattr(ngram_join, "_index", lambda tokens, frequent: ranked.append(tokens.count()) or index(tokens, frequent))
    got = {r.doc_id: r.component_id for r in ngram_join.near_duplicates(docs(spark, rows)).collect()}
    assert got == {i: i // 10 * 10 for i, _ in rows}
    assert ranked == [0]


def test_components_of_chains_stars_and_nothing(spark):
    edges = [(i, i + 1) for i in range(20)] + [(100, 200 + i) for i in range(30)] + [(7, 7), (None, 3)]
    got = {r.node: r.component for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(21)}, 100: 100, **{200 + i: 100 for i in range(30)}}
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_packing_covers_every_id_once(spark):
    from tokenizers import Tokenizer

    path = TOKENIZERS.path("word_bpe_49k.json")
    odd = "É é ΟΔΟΣ. İx <|endoftext|> J̌ don't can't. a b　c... _., x_. 12,5"
    rng = random.Random(7)
    rows = [(i, " ".join(rng.choices(["Word", "and,", "end.", "naïve"], k=rng.randrange(900)))) for i in range(40)] + [(50, None), (51, ""), (52, odd), (None, "lone")]
    got = packing.pack(docs(spark, rows), path).toPandas()
    tokenizer = Tokenizer.from_file(path)
    for i, text in rows:
        ids = np.array(tokenizer.encode(text or "", add_special_tokens=False).ids + [1], "<u4")
        mine = got[got.doc_id.isna() if i is None else got.doc_id == i].sort_values("start")
        assert (mine.doc_tokens == len(ids)).all() and mine.length.sum() == len(ids)
        for r in mine.itertuples():
            assert r.ids_crc32 == zlib.crc32(ids[r.start : r.start + r.length].tobytes())
    for _, g in got.groupby("sequence_id"):
        g = g.sort_values("offset")
        assert g.offset.tolist() == (g.length.cumsum() - g.length).tolist() and g.length.sum() <= 2048


def test_packing_cuts_cost_least():
    rng = random.Random(8)
    for _ in range(30):
        places = sorted({0, *rng.sample(range(1, 90), 25)})
        while max(b - a for a, b in zip(places, places[1:])) > 16:
            places = sorted({*places, *range(0, 90, 8)})
        penalties = [rng.choice([0, 2, 5]) for _ in places]
        cost = [0.0] + [float("inf")] * (len(places) - 1)
        for i in range(1, len(places)):
            cost[i] = penalties[i] + min(cost[j] + 16 - (places[i] - places[j]) for j in range(i) if places[i] - places[j] <= 16)
        cuts = packing.best_cuts(places, penalties, 16)
        assert sum(16 - (b - a) + penalties[places.index(b)] for a, b in zip(cuts, cuts[1:])) == cost[-1]


def test_chat_tree_round_trip_and_sharing(spark):
    path = TOKENIZERS.path("byte_bpe_50k.json")
    tricky = "\\### Assistant: </turn> ok \\\\h ##\\h ####"
    talks = {1: [("user", "hi"), ("assistant", "yes")], 2: [("user", "hi"), ("assistant", "no")], 3: [("user", "hi"), ("assistant", "yes"), ("user", tricky), ("assistant", tricky)], 4: [(None, None)], 5: [("a:b\n", "é\n</turn>\n")]}
    rows = [(c, k, r, t) for c, turns in talks.items() for k, (r, t) in enumerate(turns)]
    tree = ct.chat_tree(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"), path)
    nodes = {r.node: r for r in tree.nodes.collect()}
    assert len(nodes) == 7  # hi, yes, no, two tricky ones, and the two lone ones
    spans = sorted((n.start, n.start + len(n.ids)) for n in nodes.values())
    assert spans[0][0] == 0 and all(a[1] == b[0] for a, b in zip(spans, spans[1:]))
    for n in nodes.values():
        above, p = [], nodes.get(n.parent)
        while p is not None:
            above.append((p.start, p.start + len(p.ids)))
            p = nodes.get(p.parent)
        covered = sorted(x for a, b in above for x in range(a, b))
        assert n.position == len(covered) and covered == sorted(x for s in n.ancestors for x in range(s["from"], s["to"]))
    got = {r.conv_id: r for r in ct.read_back(tree, path).collect()}
    for c, turns in talks.items():
        assert [(t["role"], t["text"]) for t in got[c].turns] == [(r or "", t or "") for r, t in turns]
        assert got[c].loss == "".join(t for r, t in turns if r == "assistant")


def test_html_extraction():
    page = """<html><head><title>T</title></head><body><nav><a href=x>Home page</a></nav><div class="cookie-notice">We use cookies, ok?</div>
    <main><article><h1>Head &amp; more</h1><p>First   paragraph, with <a href=y>a link</a> and <b>bold</b> text.<p>Second one; it is long enough, surely.</p>
    <script>var a = "</p>";</script><p>Ok.</p></article><section id="comments"><p>Great article, thanks a lot, really!</p></section></main><aside>More.</aside><footer>&copy; x</footer>"""
    assert html_extract.main_text(page) == "Head & more\nFirst paragraph, with a link and bold text.\nSecond one; it is long enough, surely.\nOk."
    assert html_extract.main_text(None) == html_extract.main_text("") == html_extract.main_text("<p") == ""
    assert html_extract.main_text("plain < text") == "plain < text"


DOMINANT = {
    **{t: f"<{t}>" + "".join(f"<li>Item {i} of the list, which goes on, and on, for a while.</li>" for i in range(60)) + f"</{t}>" for t in ("ul", "ol")},
    "table": "<table>" + "".join(f"<tr><td>Cell {i}, with words, and more of them.</td></tr>" for i in range(60)) + "</table>",
    **{t: f"<{t}>" + "Words, and more words, and so on. " * 60 + f"</{t}>" for t in ("pre", "blockquote", "section", "div")},
}


@pytest.mark.parametrize("tag", sorted(DOMINANT))
@pytest.mark.parametrize("around", ["article", "main", "div"])
def test_html_extraction_keeps_what_stands_beside_a_dominant_element(tag, around):
    page = f"<html><body><nav><a href=x>Home page</a></nav><{around}><h1>The title</h1><p>An introduction, long enough to count, of this page.</p>{DOMINANT[tag]}<p>An ending, long enough to count, of this page.</p></{around}><footer>&copy; x</footer></body></html>"
    lines = html_extract.main_text(page).split("\n")
    assert lines[:2] == ["The title", "An introduction, long enough to count, of this page."] and lines[-1] == "An ending, long enough to count, of this page."


@pytest.mark.parametrize("html_class, body, main, article", [("no-sidebar", "", "", ""), ("", "no-sidebar", "", ""), ("", "", "has-nav", ""), ("", "", "", "has-comments")])
def test_html_extraction_of_pages_with_classes_about_their_layout(html_class, body, main, article):
    page = f"<html class='{html_class}'><body class='{body}'><main id='{main}'><article class='{article}'><h1>Head</h1><p>Some text, which is long enough.</p><div class='comments'><p>Great article, thanks!</p></div></article></main></body></html>"
    assert html_extract.main_text(page) == "Head\nSome text, which is long enough."
    assert html_extract.main_text(page.replace("<article", "<article hidden")) == ""


def test_language_centroids(spark):
    rng = random.Random(9)
    words = {"en": "the of and that with".split(), "de": "der die und nicht für".split(), "fr": "les des une être où".split()}
    rows = [(i, " ".join(rng.choices(words[lang], k=30)), lang) for i, lang in enumerate(list(words) * 30)]
    train = spark.createDataFrame(rows + [(900, None, "en"), (901, "12 34", "de"), (902, "x", None)], "doc_id long, text string, lang string")
    model = language_id.fit(train, per_language=20, centroids=3)
    test = spark.createDataFrame([(1, "die und nicht der"), (2, None), (3, " 12 "), (4, "où les une")], "doc_id long, text string")
    got = {r.doc_id: (r.language, r.language_rejected) for r in language_id.identify(test, model).collect()}
    assert got[1][0] == "de" and got[4][0] == "fr" and got[2] == (None, True) and got[3] == (None, True)


def test_toxicity_grammar():
    scorer = toxicity.Scorer(toxicity.Model(-2.0, {"idiot": 4.0, "scum": 4.0}))
    plain, negated, said, aimed = (scorer.score(t)[0] for t in ("Some idiot here.", "He is not an idiot.", "She said idiot.", "You are an idiot."))
    assert aimed > plain > negated > said
    assert scorer.score(None) == scorer.score("") and scorer.score("kill the lights")[0] < 0.2 < scorer.score("I will kill you, idiot")[0]


def test_pipeline_packs_in_training_order(spark):
    import corpus_pipeline as p
    from loomgraph.llm.common import materialize

    rng = random.Random(10)
    rows = [(i, " ".join(["word"] * rng.randrange(1, 30)), "en", s, 0) for i, s in enumerate(rng.choices("abc", [70, 25, 5], k=1500))]
    d = spark.createDataFrame(rows, DOCS)
    want = [r.doc_id for r in sorted(mixing.mix(d).collect(), key=lambda r: (r.position, r.doc_id))]
    pieces = p.stage_packing(spark, materialize(p.stage_mixing(spark, d, "")), "").collect()
    got = [r.doc_id for r in sorted(pieces, key=lambda r: (r.sequence_id, r.offset)) if r.start == 0]
    assert got == want and len(want) > len(set(want)) and want != sorted(want)


@pytest.mark.parametrize("rows", [ODD, []])
def test_odd_rows_and_extra_columns(spark, rows):
    from pyspark.sql import functions as F

    extra = ["size", "language", "lines_in", "tox_score", "main_text", "key", "t", "n", "rep", "part"]
    d = docs(spark, rows).withColumns({c: F.lit("x") for c in extra})
    n = len(rows)
    model = toxicity.Model(-2.0, {"idiot": 4.0})
    assert exact_dedup.exact_dedup(d).count() == n
    assert mixing.plan_mix(d).count() == n and mixing.mix(d).count() >= 0
    assert line_dedup.line_dedup(d).count() == n
    assert simhash.fingerprint_report(d).count() == n
    assert ngram_join.near_duplicates(d).count() == n
    assert toxicity.score_toxicity(d, model).count() == n
    assert language_id.identify(d, language_id.fit(d)).count() == n
    assert packing.pack(d, TOKENIZERS.path("word_bpe_49k.json")).count() >= n
    assert html_extract.extract(d, "text").count() == n
    turns = d.select(F.col("doc_id").alias("conv_id"), F.lit(None).cast("long").alias("turn"), F.lit("user").alias("role"), "text")
    assert ct.read_back(ct.chat_tree(turns, TOKENIZERS.path("byte_bpe_50k.json")), TOKENIZERS.path("byte_bpe_50k.json")).count() == len({i for i, _ in rows})


def test_pipeline_keeps_columns_and_clean_documents(spark, tmp_path):
    import corpus_pipeline as p

    text = lambda i: f"Clean document number {i} says {i * 7} things about {i * 13}, and ends here{i}."
    rows = [(i, text(i)) for i in range(40)] + [(40, "You idiot, you idiot, you idiot. You are scum, idiot. Idiot!")] + [(41 + i, f"idiot scum you {i}") for i in range(9)]
    d = docs(spark, rows)
    for name, table in {"documents": d, "labels": spark.createDataFrame([(i, 1, int(i >= 40)) for i in range(50)], "doc_id long, quality int, toxic int")}.items():
        table.write.parquet(f"{tmp_path}/{name}.parquet")
    now = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for k, (name, stage) in enumerate(p.STAGES[:-1]):
        now = stage(spark, now, str(tmp_path))
        assert now.columns == p.COLUMNS
        kept = {r.doc_id for r in now.select("doc_id").collect()}
        assert kept == set(range(40)), name
    assert p.run(spark, str(tmp_path)).select("doc_id").distinct().count() == 40


LONG = "A sentence of the article, which is long enough, goes on here. " * 3


@pytest.mark.parametrize(
    "inside, want",
    [
        ("<h2 id='navigation'>Navigation</h2><p>{}</p>", ["Navigation", LONG]),
        ("<h2 class='related' id='related'>Related</h2><p id='comment'>{}</p>", ["Related", LONG]),
        ("<section id='advertising'><h2>Advertising</h2><p>{}</p></section>", ["Advertising", LONG]),
        ("<div id='cookie-notice'><h3 class=x>Cookie &amp; notice</h3><p>{}</p></div>", []),
        ("<section id='comments'><h2>Comments</h2><p>{}</p></section>", []),
        ("<div class='social'><p>{}</p></div>", []),
        ("<div>Advertisement</div><p>{}</p>", [LONG]),
        ("<p>Advertisement</p><p>{}</p>", ["Advertisement", LONG]),
        ("<p><a href=x>Only a link</a></p><p>{}</p>", ["Only a link", LONG]),
        ("<ul><li><a href=x>Home</a></li><li><a href=y>Next</a></li></ul><p>{}</p>", [LONG]),
    ],
)
def test_html_marks_inside_an_article(inside, want):
    page = f"<html><body><nav><a href=x>Home</a></nav><article><h1>Head</h1><p>{LONG}</p><p>{LONG}</p>{inside.format(LONG)}</article><footer>x</footer></body></html>"
    assert html_extract.main_text(page).split("\n") == ["Head", LONG.strip(), LONG.strip(), *[w.strip() for w in want]]


def test_html_the_only_article_is_the_root():
    page = f"<html><body><article><h1>Head</h1><p>{LONG}</p></article><div class='discussion'><p>{LONG}</p><p>{LONG}</p></div><div>menu</div></body></html>"
    assert html_extract.main_text(page) == f"Head\n{LONG.strip()}"
    # Of several articles none is, and a teaser beside the text is not.
    page = f"<html><body><article><p>{LONG}</p></article><article><p>{LONG}</p></article></body></html>"
    assert html_extract.main_text(page) == f"{LONG.strip()}\n{LONG.strip()}"
    page = f"<html><body><div><p>{LONG * 4}</p><p>{LONG * 4}</p></div><article><p>Short, but said.</p></article></body></html>"
    assert LONG.strip() in html_extract.main_text(page)
