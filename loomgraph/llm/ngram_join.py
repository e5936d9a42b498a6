"""N-gram Jaccard join with token-combination prefixes.

A document is its set of distinct five-word shingles; equal sets are one class. Two sets link when their overlap is at
least 80 % of their union.

1. Prefixes by hash order. If x and y link, one of their extended prefixes shares several tokens with the other's, so a
   class whose prefix holds fewer tokens that occur anywhere else links with nothing and leaves.
2. Among the classes that stay all tokens are counted. A token that no other class has is a known mismatch; a class
   with too many leaves, and the mismatches bound the sizes of its partners.
3. Contraction. Each token ties its holders to its most central one; the number of tokens that tie a pair is a lower
   bound of its overlap, and where that is enough, the link is proven without looking at the sets. Large groups of near
   copies collapse here, from as many pairs as members. Who leads half of a class's tokens or more is its family.
4. Inside families, between components: members that don't link with their leader are compared by their changes to it.
5. Between families: only tokens that several of them hold count from here on, and only classes that have enough of
   these. They are indexed by prefixes by rarity: rare tokens one by one. Where they don't fill a prefix, it is extended
   into the frequent tokens, which are indexed by pairs inside hashed classes. Candidates are verified.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomgraph.llm.common import materialize
from loomgraph.llm.components import components

WIDTH = 5
#: A token that more families than this hold is frequent.
FREQUENT = 32
#: The share of its tokens that a class's leader must lead, round by round.
FAMILY_SHARES = (0.5, 0.25)
#: Tables of up to so many classes (an id and one or two numbers each) are broadcast to pick texts and tokens; beyond it they are joined by shuffle.
BROADCAST_IDS = 2_000_000
#: Longer words are rare and get their hash one by one.
LONG_WORD = 32
#: About as many bytes of text are worked on at a time.
PIECE = 1 << 16
_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)
_SPACES = np.isin(np.arange(256), np.frombuffer(b" \t\n\v\f\r", np.uint8))
#: The first 0 to 8 bytes of a little-endian integer.
_FIRST = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)


def _mixed(h: np.ndarray) -> np.ndarray:
    """The finalizer of MurmurHash3: one to one, each bit changes all others."""
    for factor in (np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53)):
        h = h ^ (h >> np.uint64(33))
        h *= factor
    return h ^ (h >> np.uint64(33))


def _word_hashes(text: bytes) -> tuple[np.ndarray, np.ndarray]:
    """The 64-bit hash of each word, taken eight bytes at a time, and its first byte. Words are split at ASCII white space."""
    import xxhash

    padded = b" " + text + b" " * 16
    edge = np.diff(_SPACES[np.frombuffer(padded, np.uint8)]).nonzero()[0] + 1
    start, length = edge[::2], edge[1::2] - edge[::2]
    eight = np.ndarray(len(padded) - 7, "<u8", padded, strides=(1,))
    h = length.astype(np.uint64) * _MULTIPLIER
    now = np.arange(len(start))
    for k in range(0, LONG_WORD, 8):
        now = now[length[now] > k] if k else now
        h[now] = _mixed(h[now] ^ (eight[np.minimum(start[now] + k, len(eight) - 1)] & _FIRST[np.minimum(length[now] - k, 8)]))
    for i in (length > LONG_WORD).nonzero()[0].tolist():
        h[i] = xxhash.xxh64_intdigest(padded[start[i] : start[i] + length[i]])
    return h, start - 1


def _runs(h: np.ndarray, width: int) -> np.ndarray:
    """One hash for each run of `width` words."""
    out = np.full(len(h) - width + 1, width, np.uint64)
    for k in range(width):
        out ^= h[k : len(h) - width + 1 + k]
        out *= _MULTIPLIER
        out ^= out >> np.uint64(29)
    return out


def _distinct(hashes: np.ndarray) -> np.ndarray:
    hashes = np.sort(hashes)
    return hashes[np.concatenate([[True], hashes[1:] != hashes[:-1]])] if len(hashes) else hashes


def shingle_sets(texts: list[bytes | None]) -> Iterator[np.ndarray]:
    """Of each UTF-8 text the sorted distinct 64-bit hashes of the runs of five words; of a shorter text, one for all its
    words; empty without words.

    Words are split at ASCII white space, and only A-Z are lowered. Neighbouring texts are worked on together.
    """
    begin = 0
    while begin < len(texts):
        parts, size = [], 0
        while begin + len(parts) < len(texts) and (not parts or size + len(texts[begin + len(parts)] or b"") < PIECE):
            parts.append(texts[begin + len(parts)] or b"")
            size += len(parts[-1]) + 1
        begin += len(parts)
        h, start = _word_hashes(b" ".join(parts).lower())
        ends = np.searchsorted(start, np.cumsum([len(p) + 1 for p in parts])).tolist()
        runs = _runs(h, WIDTH) if len(h) >= WIDTH else h[:0]
        for a, b in zip([0, *ends], ends):
            yield _distinct(runs[a : b - WIDTH + 1]) if b - a >= WIDTH else _runs(h[a:b], b - a) if b > a else h[:0]


def shingle_set(text: str | None) -> np.ndarray:
    """shingle_sets() of one text."""
    return next(shingle_sets([(text or "").encode("utf-8", "surrogatepass")]))


def prefix_length(n: int) -> int:
    """Mismatches that a linked set of n can have, one more, and an extension that later must be shared as well."""
    return min(n, n - (4 * n + 4) // 5 + 1 + 2 + 3 * n // 100)


def _floor_share(n: Column) -> Column:
    """The smallest overlap, and the smallest size, of a set that links with one of n."""
    return F.floor((4 * n + 4) / 5)


def _must_share(n: Column) -> Column:
    least = _floor_share(n)
    return F.least(1 + 2 + F.floor(3 * least / 100), _floor_share(least))


def _lists(arrays: list[np.ndarray]) -> pa.Array:
    ends = np.cumsum([0, *map(len, arrays)])
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate([np.zeros(0, np.uint64), *arrays]).view(np.int64)))


def _summaries(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    import xxhash

    for batch in batches:
        n, keys, bases = [], [], []
        for s in shingle_sets(batch.cast(pa.large_binary()).to_pylist()):
            n.append(len(s))
            keys.append(xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None)
            bases.append(s[: prefix_length(len(s))].copy())
        yield pa.StructArray.from_arrays([pa.array(n, pa.int64()), pa.array(keys, pa.binary()), _lists(bases)], ["n", "key", "base"])


def _shingles(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    for batch in batches:
        yield _lists(list(shingle_sets(batch.cast(pa.large_binary()).to_pylist())))


def _over(column: str) -> Window:
    return Window.partitionBy(column)


def _small(df: DataFrame, most: int) -> DataFrame:
    """A stored table, to be broadcast if it has `most` rows or fewer."""
    return F.broadcast(df) if df.count() <= most else df


def _shared(tokens: DataFrame, *keys: str) -> DataFrame:
    """The tokens(t, ...) that several classes hold (per keys), with f, their number.

    Counts are summed before they travel, and joined back, so that the holders of a very common token can be split.
    """
    held = tokens.groupBy(*keys, "t").agg(F.count(F.lit(1)).alias("f")).filter("f > 1")
    return tokens.join(held, [*keys, "t"])


def _bounded(shared: DataFrame) -> DataFrame:
    """Classes that can still link: rep, cap (its tokens that others hold), most (the largest partner's size).

    A pair needs an overlap of 4/9 of both sizes, and none is greater than cap.
    """
    caps = shared.groupBy("rep", "n").agg(F.count(F.lit(1)).alias("cap"))
    caps = caps.withColumn("most", F.floor(9 * F.col("cap") / 4) - F.col("n"))
    return caps.filter(F.col("most") >= _floor_share(F.col("n"))).select("rep", "cap", "most")


def _linked(overlap: Column, n: Column, m: Column) -> Column:
    return 100 * overlap >= 80 * (n + m - overlap)


def _ties(shared: DataFrame, broadcast_ids: int) -> DataFrame:
    """(lead, rep, s, n, m, fit): s tokens of rep, of n in all, have lead, of m, as their most central holder (itself too).

    A class is fit to lead if other classes hold 8/9 of its tokens; those come first.
    """
    central = shared.groupBy("rep").agg((F.sum(F.floor(16 * F.log2("f"))) / F.first("n")).alias("c"), (9 * F.first("cap") >= 8 * F.first("n")).alias("fit"))
    leaders = shared.join(_small(materialize(central), broadcast_ids), "rep").groupBy("t").agg(F.max(F.struct("fit", "c", (-F.col("rep")).alias("r"), "n")).alias("l"))
    ties = shared.select("rep", "n", "t").join(leaders, "t").select("rep", "n", (-F.col("l.r")).alias("lead"), F.col("l.n").alias("m"), "l.fit")
    return ties.groupBy("lead", "rep").agg(F.count(F.lit(1)).alias("s"), F.first("n").alias("n"), F.first("m").alias("m"), F.first("fit").alias("fit"))


def _families(ties: DataFrame, share: float) -> DataFrame:
    """(rep, lead, m): the fit class that leads most of rep's tokens, and `share` of them at least; else rep itself."""
    best = ties.groupBy("rep").agg(F.max(F.struct("fit", "s", (-F.col("lead")).alias("l"), "m")).alias("x"), F.first("n").alias("n"))
    own = ~F.col("x.fit") | (F.col("x.s") < share * F.col("n"))
    return best.select("rep", F.when(own, F.col("rep")).otherwise(-F.col("x.l")).alias("lead"), F.when(own, F.col("n")).otherwise(F.col("x.m")).alias("m"))


def _within_families(shared: DataFrame, families: DataFrame, near: DataFrame) -> DataFrame:
    """Links (a, b) of different components inside a family, by what its members change in their leader.

    A member's changes are its tokens that the leader lacks, and the leader's tokens that it lacks; of the leader's m
    tokens the u that no other class holds are left out, as everybody lacks them. x and y link if their changes differ
    in at most (n_x + n_y) / 9 tokens. If x doesn't link with the leader, it has more than (n_x + m) / 9 - u changes, so
    of y's changes fewer than (changed + (n_y - m) / 9 + u) / 2 are not among x's: so many of y's rarest, and one more,
    meet all of x's. As u is m / 9 at most, two that don't link with the leader have a change in common. Pairs that both
    link with the leader are one component already.
    """
    comp = lambda c: near.select(F.col("node").alias(c), F.col("component").alias(f"comp_{c}"))
    known = shared.groupBy("rep").agg(F.first("n").alias("n"), F.first("cap").alias("cap"))
    named = families.join(comp("rep"), "rep", "left").join(comp("lead"), "lead", "left")
    named = named.withColumns({"comp": F.coalesce("comp_rep", "rep"), "comp_lead": F.coalesce("comp_lead", "lead")}).drop("comp_rep")
    mixed = named.filter("rep <> lead").groupBy("lead").agg(F.max(F.col("comp") != F.col("comp_lead")).alias("x")).filter("x").select("lead")
    mixed = mixed.join(known.select(F.col("rep").alias("lead"), F.col("cap").alias("held")), "lead")
    members = materialize(named.join(mixed, "lead").join(known.select("rep", "n"), "rep"))
    own = shared.select("rep", "t").join(members.select("lead", "rep"), "rep").select("lead", "rep", "t", F.lit(1).alias("side"))
    led = shared.select(F.col("rep").alias("lead"), "t").join(mixed.select("lead"), "lead")
    theirs = members.select("lead", "rep").join(led, "lead").select("lead", "rep", "t", F.lit(2).alias("side"))
    sides = materialize(own.unionByName(theirs).groupBy("lead", "rep", "t").agg(F.sum("side").alias("side")))
    same = sides.groupBy("rep").agg(F.sum(F.when(F.col("side") == 3, 1).otherwise(0)).alias("same"))
    members = materialize(members.join(same, "rep").withColumn("changed", F.col("n") + F.col("held") - 2 * F.col("same")))
    changes = sides.filter("side < 3").drop("side")
    held = changes.groupBy("lead", "t").agg(F.count(F.lit(1)).alias("f")).filter("f > 1")
    changes = materialize(changes.join(held, ["lead", "t"], "left").withColumn("f", F.coalesce("f", F.lit(1))).join(members.drop("lead"), "rep"))
    # Rarest first; changes that are not in the table are nobody else's and stand before all.
    place = F.col("changed") - F.count(F.lit(1)).over(_over("rep")) + F.row_number().over(Window.partitionBy("rep").orderBy("f", "t"))
    # Ninths are kept whole, so that no rounding shortens what is indexed.
    most = F.floor((9 * F.col("changed") + F.greatest(F.col("n") - F.col("m") + 9 * (F.col("m") - F.col("held")), F.lit(0))) / 18) + 1
    placed = changes.withColumns({"place": place, "indexed": most}).filter("f > 1")
    side = lambda df, k: df.select("lead", "t", F.col("rep").alias(k), *[F.col(c).alias(f"{a}{k}") for c, a in (("n", "n"), ("changed", "e"), ("comp", "c"), ("place", "p"))])
    ys, xs = side(placed.filter("place <= indexed"), "y"), side(placed.filter("comp <> comp_lead"), "x")
    # The first change that a linked pair shares leaves room for all that it has to share.
    needed = "(ex + ey - (nx + ny) / 9) / 2"
    fits = f"cx <> cy AND 5 * least(nx, ny) >= 4 * greatest(nx, ny) AND px <= ex - {needed} + 1.000001 AND py <= ey - {needed} + 1.000001"
    met = materialize(ys.join(xs, ["lead", "t"]).filter(fits).select("x", "y", "nx", "ny", "ex", "ey").distinct())
    ends = met.select(F.col("x").alias("rep")).unionByName(met.select(F.col("y").alias("rep"))).distinct()
    sets = changes.join(ends, "rep").groupBy("rep").agg(F.collect_list("t").alias("e"))
    both = met.join(sets.select(F.col("rep").alias("x"), F.col("e").alias("sx")), "x").join(sets.select(F.col("rep").alias("y"), F.col("e").alias("sy")), "y")
    overlap = (F.col("nx") + F.col("ny") - F.col("ex") - F.col("ey") + 2 * F.size(F.array_intersect("sx", "sy"))) / 2
    linked = both.filter(_linked(overlap, F.col("nx"), F.col("ny"))).select(F.col("x").alias("a"), F.col("y").alias("b"))
    # The leader's own links are not among these pairs when it belongs to another family.
    to_lead = members.filter("rep <> lead").filter(_linked(F.col("same"), F.col("n"), F.col("m")))
    return linked.unionByName(to_lead.select(F.col("rep").alias("a"), F.col("lead").alias("b")))


def _size_family(n: Column) -> Column:
    return F.floor(F.log(n.cast("double")) / F.log(F.lit(1.25)))


def _crossing(placed: DataFrame, broadcast_ids: int) -> DataFrame:
    """Tokens of placed(rep, n, t, f, comp) that several families (comp) hold, of the classes that can link with another family's.

    All tokens that such a pair has in common are among these, so cap, comps (the families of a token) and the index need no others.
    """
    wide = placed.groupBy("t").agg(F.min("comp").alias("low"), F.max("comp").alias("high")).filter("low < high").select("t")
    found = materialize(placed.select("rep", "n", "t", "f", "comp").join(wide, "t"))
    found = materialize(found.join(_small(materialize(_bounded(found).select("rep", "cap")), broadcast_ids), "rep"))
    spread = found.select("t", "comp").distinct().groupBy("t").agg(F.count(F.lit(1)).alias("comps"))
    return materialize(found.join(spread, "t"))


def _index(tokens: DataFrame, frequent: int) -> DataFrame:
    """Signatures (x, y, family) of tokens(rep, n, cap, comp, t, f, comps): single rare tokens, pairs of frequent ones.

    Tokens stand rarest first, the same way in all sets. At most n - o tokens of a set of n are missing from a partner
    with an overlap of o, so the first shared token is among the first n - o + 1, and the first e + 1 shared ones are
    among the first n - o + e + 1. Dealt to e classes, two of those e + 1 fall into one. `room` bounds the overlap of
    partners that meet at a signature: what stands behind it, and the tokens that others hold at all.
    """
    n = F.col("n")
    allowed = n - _floor_share(n) + 1  # the length of a prefix
    order = Window.partitionBy("rep").orderBy("heavy", "f", "t")
    rows = tokens.withColumn("heavy", F.col("comps") > frequent)
    rows = rows.withColumns({"place": n - F.col("cap") + F.row_number().over(order), "rare": n - F.col("cap") + F.sum(F.when(~F.col("heavy"), 1).otherwise(0)).over(_over("rep"))})
    full = F.col("rare") >= allowed
    singles = rows.filter(~F.col("heavy") & (F.col("comps") > 1) & (F.col("place") <= allowed))
    room = F.least("cap", n - F.col("place") + 1)
    singles = singles.select("rep", "n", "comp", F.col("t").alias("x"), F.lit(0).cast("long").alias("y"), F.lit(-1).cast("long").alias("family"), room.alias("room"))
    # A set of n is indexed for its own size family and the next, so linked sets meet in one and agree on e there.
    family = F.explode(F.array(_size_family(n), _size_family(n) + 1))
    extended = rows.filter(F.col("heavy") & ~full).select("rep", "n", "comp", "cap", "t", "place", family.alias("family"))
    extended = extended.withColumn("e", F.greatest(F.floor(F.pow(F.lit(1.25), F.col("family")) / 5), F.lit(1)))
    extended = extended.filter(F.col("place") <= allowed + F.col("e")).withColumn("class", F.pmod(F.xxhash64("t"), F.col("e")))
    extended = materialize(extended)
    other = extended.select("rep", "family", "class", F.col("t").alias("y"), F.col("place").alias("place_y"))
    pairs = extended.join(other, ["rep", "family", "class"]).filter("t < y")
    room = F.least("cap", n - F.greatest("place", "place_y") + F.col("e") + 1)
    return singles.unionByName(pairs.select("rep", "n", "comp", F.col("t").alias("x"), "y", "family", room.alias("room")))


def _candidates(index: DataFrame) -> DataFrame:
    """Pairs (a, b) of classes of different families (comp) with a signature in common, and sizes and room for a link."""
    sig = ["x", "y", "family"]
    groups = index.groupBy(*sig, "comp").agg(F.min("n").alias("low"), F.max("room").alias("most"))
    left = groups.select(*sig, F.col("comp").alias("c1"), F.col("low").alias("low1"), F.col("most").alias("most1"))
    right = groups.select(*sig, F.col("comp").alias("c2"), F.col("low").alias("low2"), F.col("most").alias("most2"))
    meet = left.join(right, sig).filter("c1 < c2 AND 9 * least(most1, most2) >= 4 * (low1 + low2)").select(*sig, "c1", "c2")
    one = index.select(*sig, F.col("comp").alias("c1"), F.col("rep").alias("a"), F.col("n").alias("na"), F.col("room").alias("ra"))
    two = index.select(*sig, F.col("comp").alias("c2"), F.col("rep").alias("b"), F.col("n").alias("nb"), F.col("room").alias("rb"))
    found = meet.join(one, [*sig, "c1"]).join(two, [*sig, "c2"])
    fits = "9 * least(ra, rb) >= 4 * (na + nb) AND 5 * least(na, nb) >= 4 * greatest(na, nb)"
    return found.filter(fits).select("a", "b", "na", "nb").distinct()


def _verified(pairs: DataFrame, shared: DataFrame) -> DataFrame:
    """The pairs that link; tokens that only one class holds are in no overlap."""
    pairs = materialize(pairs)
    needed = pairs.select(F.col("a").alias("rep")).unionByName(pairs.select(F.col("b").alias("rep"))).distinct()
    sets = shared.join(needed, "rep").groupBy("rep").agg(F.collect_list("t").alias("s"))
    both = pairs.join(sets.select(F.col("rep").alias("a"), F.col("s").alias("sa")), "a").join(sets.select(F.col("rep").alias("b"), F.col("s").alias("sb")), "b")
    return both.filter(_linked(F.size(F.array_intersect("sa", "sb")), F.col("na"), F.col("nb"))).select("a", "b")


def near_duplicates(docs: DataFrame, frequent: int = FREQUENT, broadcast_ids: int = BROADCAST_IDS) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id (the smallest doc_id that links reach).

    Null and empty texts have no shingles and link with nothing. Documents with equal sets link. Rows that repeat an id
    are one document for linking. Without ids no links are sought, only equal sets. Other columns are not read.
    """
    read = materialize(docs.select("doc_id", F.arrow_udf(_summaries, "n long, key binary, base array<long>")("text").alias("x")).select("doc_id", "x.*"))
    classes = read.filter("n > 0").groupBy("key").agg(F.min("doc_id").alias("rep"), F.first("n").alias("n"), F.first("base").alias("base"))
    prefixes = classes.filter("rep IS NOT NULL").select("rep", "n", F.explode("base").alias("t"))
    counts = _shared(prefixes).groupBy("rep", "n").agg(F.count(F.lit(1)).alias("s"))
    staying = materialize(counts.filter(F.col("s") >= _must_share(F.col("n"))).select("rep", "n"))

    ids = staying.select(F.col("rep").alias("doc_id"), "n")
    texts = docs.select("doc_id", "text").join(_small(ids, broadcast_ids), "doc_id")
    whole = texts.select(F.col("doc_id").alias("rep"), "n", F.explode(F.arrow_udf(_shingles, "array<long>")("text")).alias("t"))
    shared = materialize(_shared(whole).select("rep", "n", "t"))
    bounds = _small(materialize(_bounded(shared)), broadcast_ids)
    shared = materialize(_shared(shared.join(bounds, "rep").select("rep", "n", "t")))
    bounds = _small(materialize(_bounded(shared)), broadcast_ids)
    shared = materialize(shared.join(bounds, "rep").select("rep", "n", "cap", "t", "f"))

    families, proven, left = None, None, shared
    for share in FAMILY_SHARES:
        if families is not None:
            # Classes that lead only themselves look for a leader again, among each other.
            alone = found.groupBy("lead").agg(F.count(F.lit(1)).alias("k"), F.first("rep").alias("rep")).filter("k = 1 AND rep = lead").select("rep")
            left = materialize(_shared(shared.join(alone, "rep").select("rep", "n", "cap", "t")))
        ties = materialize(_ties(left, broadcast_ids))
        linked = (F.col("rep") != F.col("lead")) & _linked(F.col("s"), F.col("n"), F.col("m"))
        tied = ties.filter(linked).select(F.col("rep").alias("a"), F.col("lead").alias("b"))
        found = materialize(_families(ties, share))
        families = found if families is None else families.join(found, "rep", "left_anti").unionByName(found)
        proven = tied if proven is None else proven.unionByName(tied)
    families, proven = materialize(families), materialize(proven)
    near = materialize(components(proven))
    inside = _within_families(shared, families, near)
    placed = shared.join(_small(families.select("rep", F.col("lead").alias("comp")), broadcast_ids), "rep")
    crossing = _crossing(placed, broadcast_ids)
    index = materialize(_index(crossing, frequent))
    links = _verified(_candidates(index), crossing).unionByName(inside)
    found = materialize(components(proven.unionByName(links)))

    labels = classes.select("key", "rep").join(found.withColumnRenamed("node", "rep"), "rep", "left")
    # A table of their own: both sides of the join are then plain shuffles, and Spark splits a text with very many copies.
    labels = materialize(labels.select("key", F.coalesce("component", "rep").alias("component_id")))
    out = read.select("doc_id", "n", "key").join(labels, "key", "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"))
