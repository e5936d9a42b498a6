"""Importance resampling, URL filter and whitening against plain re-statements, with odd rows."""

import hashlib
import math
import random
import re
import zlib

import numpy as np
import pytest

from loomgraph.llm import importance, url_filter, whitening
from loomgraph.llm.q_url_filter import RULES

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
TEXTS = [None, "", " \n", "Ünï ÇÀ z9-Z8 don't", "a " * 3000 + "b", "x" * 70_000 + " y", "日本 語\U0001f600x", "one two three " * 9, "one two three " * 9]


def words(text):
    return re.findall(WORD, re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def plain_features(text, orders):
    w = words(text)
    return [zlib.crc32(" ".join(w[i : i + n]).encode()) for n in range(1, orders + 1) for i in range(len(w) - n + 1)]


@pytest.mark.parametrize("orders", [1, 2, 4])
def test_features_without_their_strings(orders):
    rng = random.Random(orders)
    texts = TEXTS + ["".join(rng.choice("aBcé Ж9-\n _") for _ in range(rng.randrange(300))) for _ in range(60)]
    bucket, of, n_words = importance.features(texts, orders, 10_007)
    want = [(i, c % 10_007) for i, t in enumerate(texts) for c in plain_features(t, orders)]
    assert sorted(zip(of.tolist(), bucket.tolist())) == sorted(want)
    assert n_words.tolist() == [len(words(t)) for t in texts]


def test_texts_are_worked_on_in_pieces(monkeypatch):
    whole = importance.features(TEXTS, 3, 997)
    monkeypatch.setattr(importance, "PIECE", 50)
    for a, b in zip(whole, importance.features(TEXTS, 3, 997), strict=True):
        assert a.tolist() == b.tolist()
    runs = list(importance.few(TEXTS))
    assert [i for r in runs for i in range(r.start, r.stop)] == list(range(len(TEXTS))) and len(runs) > 3


def test_crcs_combine():
    rng = random.Random(5)
    parts = [(rng.randbytes(rng.randrange(40)), rng.randbytes(rng.choice([0, 1, 7, 64, 5000]))) for _ in range(50)]
    a, b, n = (np.array(x) for x in ([zlib.crc32(p) for p, _ in parts], [zlib.crc32(q) for _, q in parts], [len(q) for _, q in parts]))
    got = importance.shifted(a.astype(np.uint32), n) ^ b.astype(np.uint32)
    assert got.tolist() == [zlib.crc32(p + q) for p, q in parts]


def plain_draw(docs, target, orders, buckets, percent, least, seed):
    s, t = [0] * buckets, [0] * buckets
    for counts, texts in ((s, [x for _, x in docs]), (t, target)):
        for text in texts:
            for c in plain_features(text, orders):
                counts[c % buckets] += 1
    gain = [math.floor(1000 * math.log((float(t[b] + 1) * float(sum(s) + buckets)) / (float(s[b] + 1) * float(sum(t) + buckets)))) for b in range(buckets)]
    out = []
    for i, text in docs:
        f = [gain[c % buckets] for c in plain_features(text, orders)]
        h = int(hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        weight = sum(f) // len(f) if f else 0
        out.append((i, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), len(words(text))))
    able = sorted((r for r in out if r[4] >= least), key=lambda r: (-r[3], r[0] is not None, r[0] or 0))
    return out, able[: percent * len(able) // 100]


@pytest.mark.parametrize("orders,least,percent", [(1, 3, 40), (3, 3, 100), (1, 20, 0), (2, 10**6, 50)])
def test_draw_against_a_plain_one(spark, orders, least, percent):
    rng = random.Random(7)
    rows = [(i % 150, " ".join(rng.choices(["red", "blue", "Green", "é", "x1"], k=rng.randrange(12)))) for i in range(170)]
    rows += [(None, "same words here")] * 30 + [(-5, "same words here")] * 9 + list(enumerate(TEXTS, 1000))
    target = ["red red blue", None, "x1 é Green"]
    got = importance.resample(spark.createDataFrame([(*r, "keep") for r in rows], "doc_id long, text string, RANK string"), spark.createDataFrame([(t,) for t in target], "text string"), percent, least, orders, 97, 11).collect()
    want, drawn = plain_draw(rows, target, orders, 97, percent, least, 11)
    key = lambda r: tuple((x is not None, x) for x in r)
    assert sorted([(r.doc_id, r.n_features, r.weight, r.score, r.n_words) for r in got], key=key) == sorted(want, key=key)
    ranked = sorted((r for r in got if r["rank"] is not None), key=lambda r: r["rank"])
    assert [r["rank"] for r in ranked] == list(range(1, len(drawn) + 1))
    assert [(r.doc_id, r.score) for r in ranked] == [(r[0], r[3]) for r in drawn]
    assert got[0].__fields__ == ["doc_id", "text", "n_features", "n_words", "weight", "score", "rank"]  # RANK is replaced


def test_draw_of_empty_tables(spark):
    docs = spark.createDataFrame([(1, "a b c")], "doc_id long, text string")
    assert importance.resample(docs.limit(0), docs, least_words=1).count() == 0
    assert [r.weight for r in importance.resample(docs, docs.limit(0), least_words=1, percent=100).collect()] == [math.floor(1000 * math.log(10_003 / 20_000))]


def verdicts(spark, urls, **more):
    rows = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    return [(r.url_host, r.url_path, r.url_rule, r.url_verdict) for r in url_filter.filter_urls(rows, **more).orderBy("page_id").collect()]


def test_urls_are_cut_and_ruled(spark):
    urls = ["http://A.Example.ORG/es/1?q=/en/", "https://example.org/en/17", "https://notexample.org/en/17", "http://x.com/fr/porn", "x.com/fr/", None, "", "http://com/de/", "ftp://y.com", "://org/#a", "a\nb://U@h.org:80/p\nq?x", "http://org"]
    assert verdicts(spark, urls, rules=RULES) == [
        ("a.example.org", "/es/1", "example.org/es/", "block"), ("example.org", "/en/17", "example.org/en/1", "block"), ("notexample.org", "/en/17", "org/", "allow"),
        ("x.com", "/fr/porn", "com/fr/", "allow"), ("", "", None, "allow"), ("", "", None, "allow"), ("", "", None, "allow"), ("com", "/de/", "com/de/", "block"),
        ("y.com", "", None, "allow"), ("org", "/", "org/", "allow"), ("u@h.org:80", "/p\nq", None, "allow"), ("org", "", None, "allow"),
    ]


def test_url_terms_need_boundaries_and_company(spark):
    bad = ["http://casino-win.example.net/en/1", "http://a.net/CASINO777", "http://free-bets.net/", "http://a.net/%63asino", "http://adult.net/free/", "http://x.net/hot/sexy.html"]
    good = ["http://casinoship.net/", "http://a.net/essex", "http://free.net/free/free", "http://bets.net/bets/bets", "http://farm-track.net/free", "http://a.net/?casino", "http://a.net/#xxx", "http://pharmacy.net/en/9"]
    assert [v[3] for v in verdicts(spark, bad + good)] == ["block"] * len(bad) + ["allow"] * len(good)


def test_url_hits_against_patterns(spark):
    rng = random.Random(3)
    terms = {"ab": 3, "b": 3, "abc": 10, "c-a": 7, "é": 7}
    urls = ["h://" + "".join(rng.choice("abcABCé-/. 1") for _ in range(rng.randrange(1, 14))) for _ in range(400)]
    rows = spark.createDataFrame(list(enumerate(urls)), "url_weight long, url string")
    for r in url_filter.filter_urls(rows, vocabulary=terms).collect():
        text = (r.url_host + r.url_path).lower()
        hits = {t: w for t, w in terms.items() if re.search(rf"(?<![a-zé]){t}(?![a-zé])", text)}
        assert r.url_hits == ",".join(sorted(hits)) and r.url_weight == sum(hits.values())
        soft = [w for w in hits.values() if w < 10]
        assert (r.url_verdict == "block") == ("abc" in hits or (len(soft) > 1 and sum(soft) >= 10))


def test_url_filter_of_odd_input(spark):
    rows = spark.createDataFrame([("http://a.net/" + "é" * 200_000 + "/porn", 1), ("http://b.net", 2)] * 2, "url string, `URL_HITS` int")
    out = url_filter.filter_urls(rows, vocabulary={})
    assert {r.url_verdict for r in out.collect()} == {"allow"} and out.count() == 4
    assert {r.url_verdict for r in url_filter.filter_urls(rows).filter("url_host = 'a.net'").collect()} == {"block"}
    assert url_filter.filter_urls(rows.limit(0)).count() == 0
    with pytest.raises(ValueError, match="not a rule"):
        url_filter.filter_urls(rows, [url_filter.Rule("a", "/", "maybe")])


def plain_whitening(vectors, components):
    x = np.array([[math.floor(64.0 * float(np.float32(c))) + 1_000_000 for c in v] for v in vectors])
    fitted = np.unique(x, axis=0)
    n, s = len(fitted), fitted.sum(axis=0)
    centred = fitted - s / n
    e, v = np.linalg.eigh(centred.T @ centred / n)
    e, v = e[::-1], v[:, ::-1].T
    deviation = [sum((n * int(a) - int(b)) ** 2 for a, b in zip(row, s)) for row in x]
    return n, deviation, (x - s / n) @ v[:components].T / np.sqrt(e[:components]), e / e.sum()


@pytest.mark.parametrize("offset", [0.0, 50_000.0])
def test_whitening_against_an_eigendecomposition(spark, offset):
    rng = np.random.default_rng(4)
    base = rng.normal(size=(300, 12)) * np.linspace(3, 0.4, 12) + offset
    vectors = [[float(c) for c in v] for v in np.vstack([base, base[:40], np.repeat(base[:1], 100, axis=0)]).astype(np.float32)]
    rows = spark.createDataFrame(list(enumerate(vectors)), "vec_id long, embedding array<float>").repartition(37)
    got = whitening.whiten(rows, components=5).collect()
    n, deviation, white, explained = plain_whitening(vectors, 5)
    assert len(got) == 5 * len(vectors)
    sign = {}
    for r in got:
        assert (r.n, r.deviation) == (n, deviation[r.vec_id]) and r.identity_error < 1e-9
        assert r.explained == pytest.approx(explained[r.component - 1], rel=1e-9)
        want = white[r.vec_id, r.component - 1]
        assert abs(r.whitened) == pytest.approx(abs(want), abs=1e-6)
        if abs(want) > 1e-3:
            assert sign.setdefault(r.component, r.whitened * want > 0) == (r.whitened * want > 0)


def test_merged_summaries_lose_nothing():
    rng = np.random.default_rng(9)
    rows = rng.integers(-1000, 1000, size=(200, 7))
    cuts = [rows[:0], rows[:3], rows[3:4], rows[4:150], rows[150:]]
    so_far = whitening.summary(cuts[0])
    for part in cuts[1:]:
        so_far = whitening.merged(so_far, whitening.summary(part))
    n, total, basis = so_far
    centred = rows - rows.mean(axis=0)
    assert n == 200 and (total == rows.sum(axis=0)).all() and basis.shape == (7, 7)
    assert np.allclose(basis.T @ basis, centred.T @ centred, rtol=1e-12, atol=1e-6)


def test_whitening_of_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    odd = [None, [], [1.0, None], [nan, 1.0], [inf, 1.0], [1e30, 0.0], [1.0, 2.0, 3.0]]
    good = [[0.0, 5.0], [1.0, 5.0], [1.0, 5.0], [-1.0, 5.0], [3.0, 5.0]]
    rows = spark.createDataFrame([(i, v, "kept", 9) for i, v in enumerate(odd + good + good)], "vec_id long, embedding array<double>, note string, COMPONENT int")
    got = whitening.whiten(rows).orderBy("vec_id", "component").collect()
    assert [r.vec_id for r in got] == [i for i in range(7, 17) for _ in range(2)] and {r.note for r in got} == {"kept"}
    assert {r.n for r in got} == {4} and {r.component for r in got} == {1, 2}
    assert all((r.whitened is None and r.explained == 0) == (r.component == 2) for r in got)  # the second dimension is the same in all
    assert max(r.identity_error for r in got) < 1e-12
    assert whitening.whiten(rows.limit(0)).count() == 0
    lone = whitening.whiten(rows.filter("vec_id = 7")).collect()
    assert [(r.n, r.deviation, r.whitened) for r in lone] == [(1, 0, None)] * 2
    far = whitening.whiten(spark.createDataFrame([(1, [1e9]), (2, [-1e9])], "vec_id long, embedding array<double>")).collect()
    assert {(r.deviation, abs(round(r.whitened, 9))) for r in far} == {(None, 1.0)}


def test_the_mix_shuffles_no_text_and_line_dedup_each_once(spark):
    from loomgraph.llm import line_dedup, q_mixing

    plan = q_mixing.query(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    joins = [line for line in plan.splitlines() if "row#" in line and "struct" in line]
    assert joins and not any("text" in line.split("AS row#")[0] for line in joins)
    docs = spark.createDataFrame([(1, "a b", "x")], "doc_id long, text string, note string")
    plan = line_dedup.line_dedup(docs)._jdf.queryExecution().optimizedPlan().toString()
    assert "AS row#" in plan and not any("text" in line.split("AS row#")[0].split("struct(")[-1] for line in plan.splitlines() if "AS row#" in line)
