"""Operators against plain re-statements, held-out rows and whole small tables; clashing names, sparse ids, empty tables."""

import html
import math
import random
import re
import struct
import time

import pytest

from loomgraph.llm.common import materialize
from loomgraph.llm import exact_dedup, html_extract, language_id, line_dedup, mixing, ngram_join, packing, simhash, toxicity

TOKENIZERS = pytest.importorskip("public_tokenizers")
SMALL = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string"
ROWS = [
    (1, "You idiot.\nA line of ten words that stands here twice in all, surely.", "en", "a"),
    (2, "A line of ten words that stands here twice in all, surely.\nEnd.", "en", "b"),
    (2, "A line of ten words that stands here twice in all, surely.\nEnd.", "en", "b"),
    (None, None, None, None),
    (2**62, "", "de", "a"),
]
CLASHING = ["row", "w0", "w1", "k", "h", "r", "d", "t", "s", "n", "found", "before", "__before", "inside", "start", "pass", "passes", "__d", "deleted", "key", "kind", "SIZE", "Lines_In", "a.b", "order", "lines"]


def plain(rows):
    return sorted(map(repr, rows))


def test_columns_of_any_name_stay_and_change_nothing(spark):
    from pyspark.sql import functions as F

    d = spark.createDataFrame(ROWS, SCHEMA)
    more = d.select("*", *[F.lit(f"my {c}").alias(c) for c in CLASHING])
    model = toxicity.Model(-2.0, {"idiot": 4.0})
    for op, added in (
        (mixing.plan_mix, mixing.ADDED), (mixing.mix, [*mixing.ADDED, "position"]), (line_dedup.line_dedup, line_dedup.ADDED), (lambda x: toxicity.score_toxicity(x, model), toxicity.ADDED),
        (lambda x: html_extract.extract(x, "text"), ["main_text"]),
    ):
        want, got = op(d), op(more).collect()
        assert plain(tuple(r[c] for c in want.columns) for r in got) == plain(map(tuple, want.collect()))
        for name in CLASHING:
            if name.lower() not in {a.lower() for a in added}:
                assert {r[name] for r in got} <= {f"my {name}"}
    for op in (exact_dedup.exact_dedup, simhash.fingerprint_report):
        assert plain(op(more).collect()) == plain(op(d).collect())


def test_packing_ids_of_any_text():
    rng, tokenizer = random.Random(1), packing.ChunkTokenizer(TOKENIZERS.path("word_bpe_49k.json"))
    parts = [*"abXYéßÉİıſςσΣ .,;:!?'’-_()012½²\n\t\r ́̇̈ЖжёЙ한글가字K🙂", "é", "İ", "<|endoftext|>", "<|EndOfText|>", "'s", "n't", " ́"]
    texts = ["".join(rng.choices(parts, k=rng.randrange(20))) for _ in range(20_000)]
    want = tokenizer.tokenizer.encode_batch(texts, add_special_tokens=False)
    assert [t for t, w in zip(texts, want) if tokenizer.encode(t)[0].tolist() != w.ids] == []


class Counted:
    """A tokenizer that counts its calls and the texts of each."""

    def __init__(self, tokenizer):
        self.tokenizer, self.calls = tokenizer, []

    def encode_batch_fast(self, texts, **options):
        self.calls.append(len(texts))
        return self.tokenizer.encode_batch_fast(texts, **options)


def test_packing_encodes_new_words_of_many_texts_together():
    rng, tokenizer = random.Random(3), packing.ChunkTokenizer(TOKENIZERS.path("word_bpe_49k.json"))
    texts = [" ".join("".join(rng.choices("abcdefgéжñ", k=9)) + rng.choice(["", ".", ", x"]) for _ in range(30)) for _ in range(500)] + ["", "a  b.\n\nC", "", "İx."]
    want = [w.ids for w in tokenizer.tokenizer.encode_batch(texts, add_special_tokens=False)]
    tokenizer.tokenizer = counted = Counted(tokenizer.tokenizer)
    assert [ids.tolist() for ids, _ in tokenizer.encode_all(texts)] == want
    # Before: a call for each text, and each of the 15,000 new words a text of its own.
    assert len(counted.calls) <= 2 and sum(counted.calls) < 15_000 / 40


@pytest.mark.parametrize("told", [True, False])
def test_packing_in_small_parts(monkeypatch, told):
    rng, tokenizer = random.Random(4), packing.ChunkTokenizer(TOKENIZERS.path("word_bpe_49k.json"), most=50)
    for name, size in {"TEXTS": 300, "IDS": 20, "JOINED": 3}.items():
        monkeypatch.setattr(packing, name, size)
    if not told:  # a vocabulary that doesn't tell where words end
        tokenizer.last[:] = False
    parts = ["word", "two. ", "Three!", "É", "é?", " ", "\n", "…", "12", "жук.", "don't", ".", "", "İ"]
    texts = ["".join(rng.choices(parts, k=rng.choice([0, 1, 5, 80]))) for _ in range(600)]
    got = list(tokenizer.encode_all(texts))
    assert [ids.tolist() for ids, _ in got] == [w.ids for w in tokenizer.tokenizer.encode_batch(texts, add_special_tokens=False)]
    for text, (ids, ends) in zip(texts, got):
        chunks = re.sub(r"([0-9a-zéж-я])([.,;:!?]+)(?=[ \n]|$)", r"\1 \2", text.lower() if "İ" not in text else text).replace("\n", " ").split(" ")
        after, want = 0, []
        for c in chunks:
            after += len(tokenizer.tokenizer.encode(c, add_special_tokens=False).ids)
            want += [after] if c.endswith(packing.SENTENCE_END) else []
        assert after == len(ids) and ends.tolist() == sorted(set(want))


def test_packing_places_of_cuts():
    import numpy as np

    rng = random.Random(5)
    for _ in range(200):
        sizes = [rng.choice([1, 5, 64, 65, 128, 129, 300]) for _ in range(rng.randrange(6))]
        ends = [np.array(sorted({rng.randrange(1, n + 1) for _ in range(rng.randrange(4))}), np.int64) for n in sizes]
        want, base = {0: 0}, 0
        for n, e in zip(sizes, ends):
            for k in [*e.tolist(), n]:
                want[base + k] = 0 if k == n else packing.AT_SENTENCE
            base += n
        for a, b in zip(list(want), list(want)[1:]):
            want |= {k: packing.IN_SENTENCE for k in range(a + packing.STRETCH, b, packing.STRETCH)}
        assert packing.candidate_cuts(sizes, ends) == (sorted(want), [want[k] for k in sorted(want)])


@pytest.mark.parametrize("step", [1, 1000, 2**44])
def test_packing_of_sparse_and_large_ids(spark, step):
    rows = [(i * step + 2**48, f"Some words, number {i}. " * (5 + i % 40), "en", "a") for i in range(1200)] + [(2**62 + 1, "last", "en", "a"), (None, "first", "en", "a")]
    got = packing.pack(spark.createDataFrame(rows, SCHEMA), TOKENIZERS.path("word_bpe_49k.json")).collect()
    assert {r.doc_id for r in got} == {i for i, *_ in rows}
    filled = {}
    for r in got:
        filled[r.sequence_id] = filled.get(r.sequence_id, 0) + r.length
    # No more than one sequence over the least possible number: all padding is less than a sequence or two, at any ids.
    assert max(filled.values()) <= 2048 and len(filled) <= math.ceil(sum(filled.values()) / 2048) + 1


def test_a_stream_is_cut_like_one_piece():
    import numpy as np

    rng = random.Random(2)
    docs = [(i, np.arange(n := rng.randrange(1, 60), dtype=np.uint32), np.unique([rng.randrange(1, n + 1) for _ in range(3)])) for i in range(400)] + [(400, np.arange(5000, dtype=np.uint32), np.array([], int))]
    stream, out = packing.Stream(7, 64), []
    for d in docs:
        stream.add(*d)
        if stream.full():
            out.append(stream.cut(False))
    out.append(stream.cut(True))
    rows = [r for part in out for r in part.itertuples()]
    lengths = {}
    for r in rows:
        assert r.offset == lengths.get(r.sequence_id, 0)
        lengths[r.sequence_id] = r.offset + r.length
    assert max(lengths.values()) <= 64 and sorted(lengths) == list(range(7, 7 + len(lengths))) and sum(lengths.values()) == sum(len(d[1]) for d in docs)
    for i, ids, _ in docs:
        mine = [r for r in rows if r.doc_id == i]
        assert [r.start for r in mine] == [sum(x.length for x in mine[:k]) for k in range(len(mine))] and sum(r.length for r in mine) == len(ids) == mine[0].doc_tokens


def fingerprint(text):
    """The votes, one word pair at a time."""
    import xxhash

    words = [w for w in re.split(r"[\x20\x09-\x0D]+", text or "") if w]
    votes, total = [0] * 128, 0
    for a, b in zip(words, words[1:] or [""]):
        weight = min(len(a) + len(b), 16)
        total += weight
        hashes = []
        for parts in ((a.encode(), b.encode()), (b.encode(), a.encode(), struct.pack("<i", 7))):
            h = 42
            for x in parts:
                h = xxhash.xxh64_intdigest(x, seed=h)
            hashes.append(h)
        for i in range(128):
            votes[i] += weight * (hashes[i // 64] >> i % 64 & 1)
    bits = [int(2 * v > total) for v in votes]
    return tuple(sum(b << i for i, b in enumerate(bits[k : k + 64])) for k in (0, 64))


def test_simhash_bits_and_all_near_fingerprints_of_the_documents(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    prints = simhash.fingerprints(docs, ["doc_id"], "text")
    got = {r.doc_id: (r.fp0 % 2**64, r.fp1 % 2**64) for r in prints.collect()}
    want = {r.doc_id: fingerprint(r.text) for r in docs.collect()}
    assert got == want
    assert simhash.fingerprints(spark.createDataFrame([(1, None), (2, " ")], "doc_id long, text string"), ["doc_id"], "text").filter("fp0 <> 0 OR fp1 <> 0").count() == 0
    distinct = sorted(set(want.values()))
    distance = lambda x, y: (x[0] ^ y[0]).bit_count() + (x[1] ^ y[1]).bit_count()
    pairs = {frozenset((x, y)) for i, x in enumerate(distinct) for y in distinct[i + 1 :] if distance(x, y) <= 3}
    found = {frozenset(((r.a0 % 2**64, r.a1 % 2**64), (r.b0 % 2**64, r.b1 % 2**64))) for r in simhash.near_fingerprints(materialize(prints), 3).collect()}
    assert found == pairs


def test_toxicity_weights(spark):
    from statistics import NormalDist

    rng = random.Random(3)
    words = [f"w{chr(97 + i)}" for i in range(26)]
    labelled = [(i, " ".join(rng.choices(words, k=12)) + (" villains" if i % 5 == 0 else ""), int(i % 5 == 0)) for i in range(400)]
    docs = spark.createDataFrame([(i, t) for i, t, _ in labelled] + [(999, None)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, y) for i, _, y in labelled] + [(None, 1), (5, None), (12345, 1)], "doc_id long, toxic int")
    import zlib

    seen = [(t, y) for i, t, y in labelled if zlib.crc32(str(i).encode()) % 3 != 1]
    toxic, clean = sum(y for _, y in seen), sum(1 - y for _, y in seen)
    counts = {}
    for t, y in seen:
        for term in toxicity.terms_of(t):
            counts.setdefault(term, [0, 0])[y] += 1
    tried = {k: v for k, v in counts.items() if v[1] >= toxicity.LEAST_TOXIC}
    z = NormalDist().inv_cdf(1 - min(0.05, toxicity.BY_CHANCE / len(tried)))

    def bound(k, n, side):
        p = k / n
        return (p + z * z / (2 * n) + side * z * math.sqrt(p * (1 - p) / n + z * z / (4 * n * n))) / (1 + z * z / n)

    want = {k: w for k, (c, t) in tried.items() if (w := math.log(bound(t, toxic, -1) / bound(c, clean, 1))) >= toxicity.LEAST_WEIGHT}
    model = toxicity.fit(docs, labels)
    assert model.weights == pytest.approx(want) and set(want) == {"villains", "vill*", "villa*", "villai*"}
    empty = toxicity.fit(docs, labels.filter("toxic = 0"))
    assert empty.weights == {} and toxicity.Scorer(empty).score("villains")[0] < 0.5


def test_toxicity_transducers_rewrite_each_others_tape():
    machine = toxicity.grammar()

    def run(symbols):
        state, out = machine.start, []
        for s in symbols:
            state, written, weight = machine.step(state, s)
            out.append((written, weight))
        return out, state[-1] == toxicity.Acceptor.final

    assert run("YI") == ([("Y", 1.0), ("I", 1.5)], True)
    assert run("IOY") == ([("I", 1.0), ("O", 1.0), ("Z", 1.0)], True)
    assert run("RIY") == ([("R", 1.0), ("i", 0.4), ("Y", 1.0)], True)  # a reported insult is aimed at nobody
    assert run("RNI") == ([("R", 1.0), ("N", 1.0), ("i", 0.2)], True)
    assert [run(x)[1] for x in ("T", "TOY", "YOT", "OOY", "")] == [False, True, True, False, False]


def test_toxicity_and_language_on_held_out_documents(spark):
    from pyspark.sql import functions as F

    folder = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/labels.parquet")
    fold = lambda n: F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(n))
    scored = toxicity.score_toxicity(docs, toxicity.fit(docs, labels)).join(labels, "doc_id").filter(fold(3) == 1)
    rows = [(r.toxic, r.tox_score >= 0.7) for r in scored.filter("toxic IS NOT NULL").collect()]
    hits, flagged, toxic = sum(y and f for y, f in rows), sum(f for _, f in rows), sum(y for y, _ in rows)
    assert hits >= 0.9 * flagged and hits >= 0.5 * toxic > 0
    model = language_id.fit(docs.filter(fold(5) != 0))
    named = language_id.identify(docs.filter(fold(5) == 0), model).filter("lang IS NOT NULL AND language IS NOT NULL").collect()
    assert sum(r.lang == r.language for r in named) >= 0.98 * len(named) > 100


def article_of(page):
    """The article of a given page, which holds headings, paragraphs, bold text and line breaks only."""
    inside = re.sub(r"</?b>", "", re.search(r"<article>(.*)</article>", page, re.S)[1])
    return "\n".join(x for x in (" ".join(html.unescape(z).split()) for z in re.split(r"</?(?:h1|p|br)[^>]*>", inside)) if x)


def test_html_extraction_of_all_pages(spark):
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    assert [r.url for r in html_extract.extract(pages).collect() if r.main_text != article_of(r.html)] == []


TEXT = "Some text, which is long enough; it says this and that. " * 3


@pytest.mark.parametrize("open_tag, close_tag", [("<body class='post has-sidebar'>", "</body>"), ("<article class='post ad-free'>", "</article>"), ("<div class='social-science'>", "</div>"), ("<main id='menu-recipes'>", "</main>")])
def test_html_marks_are_weights(open_tag, close_tag):
    page = f"<html>{open_tag}<p>{TEXT}</p><p>{TEXT}</p><div class='comments'><p>{TEXT}</p></div>{close_tag}<footer>{TEXT}</footer></html>"
    assert html_extract.main_text(page) == "\n".join([TEXT.strip()] * 2)


def test_html_extraction_keeps_short_blocks_and_the_articles_own_header():
    page = f"<body><header><h1>Site</h1></header><article><header><h1>Title</h1></header><p>{TEXT}</p><ul><li>a<li>b</ul><table><tr><td>1<td>2</table><p>{TEXT}</p></article></body>"
    assert html_extract.main_text(page) == "\n".join(["Title", TEXT.strip(), "a", "b", "1", "2", TEXT.strip()])


@pytest.mark.parametrize("page", ["<div>x " * 8000, "<ul><li>" + "<ul><div>" * 8000 + "<li>x</li>" * 8000 + "<p>y</div>" * 8000, "<p>" + "</div>" * 50_000, "a" * 2_000_000])
def test_html_extraction_is_linear(page):
    began = time.time()
    html_extract.main_text(page)
    assert time.time() - began < 5


def components_of(sets):
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
    return {i: find(i) for i in sets}


def test_ngram_join_of_dense_groups(spark):
    """Groups of texts that nearly link: words changed in many places, and words of their own that nobody else has."""
    rng, rows = random.Random(5), []
    for g, (edits, own, length) in enumerate([(2, 0, 60), (3, 12, 110), (5, 4, 140), (1, 2, 25)] * 2):
        base = [f"g{g}w{i}" for i in range(length)]
        for _ in range(30):
            w = list(base)
            for _ in range(rng.randrange(edits + 1)):
                w[rng.randrange(len(w))] = rng.choice(["x", f"u{len(rows)}", f"v{rng.randrange(6)}"])
            w += [f"own{len(rows)}_{i}" for i in range(rng.randrange(own + 1))]
            rows.append((len(rows), " ".join(w)))
    sets = {i: set(ngram_join.shingle_set(t).tolist()) for i, t in rows}
    got = {r.doc_id: r.component_id for r in ngram_join.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), frequent=4).collect()}
    assert got == components_of(sets)


def test_pipeline_of_odd_rows(spark, tmp_path):
    import corpus_pipeline

    same = "One and the same text of quite a few words, more than ten of them in all."
    rows = [(1, same), (2, same), (2, same), (None, same), (None, None), (3, ""), (4, "Other words, as they come."), (4, "Other words, as they come.")]
    docs = spark.createDataFrame([(i, t, "en", None if i == 4 else "a", len(t or "")) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    pieces = corpus_pipeline.run(spark, str(tmp_path)).collect()
    # Null ids come first, so theirs is the copy of the line that stays; texts without words are not mixed in.
    assert {r.doc_id for r in pieces} == {None, 4}


def test_empty_tables(spark):
    import corpus_pipeline

    none = spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
    for stage in (corpus_pipeline.stage_line_dedup, corpus_pipeline.stage_mixing):
        assert stage(spark, none, "").count() == 0
    assert packing.pack(none, TOKENIZERS.path("word_bpe_49k.json")).count() == 0
    labels = spark.createDataFrame([], "doc_id long, toxic int")
    assert toxicity.score_toxicity(none, toxicity.fit(none, labels)).count() == 0
    assert language_id.identify(none, language_id.fit(none)).count() == 0
