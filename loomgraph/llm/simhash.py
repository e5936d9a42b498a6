"""SimHash fingerprints and a Hamming search over permuted block tables, in DataFrame operations only."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomgraph.llm.common import SPACES, materialize, text_or_empty

#: Bits of a fingerprint; two 64-bit hashes of each term vote.
BITS = 128
LANES = 32
LANE_MASK = 0x0000000100000001
def terms(text: Column) -> Column:
    """Pairs of neighbouring words as structs (a, b); of a text of one word that word and an empty one."""
    words = F.filter(F.split(text, SPACES), lambda w: w != "")
    pairs = F.greatest(F.size(words) - 1, F.lit(1))
    return F.arrays_zip(F.slice(words, 1, pairs).alias("a"), F.slice(F.concat(words, F.array(F.lit(""))), 2, pairs).alias("b"))


def vote_sums(a: Column, b: Column) -> dict[str, Column]:
    """Weighted votes for 1 on each bit, two bits to a sum (32 each), and the votes in all. A term weighs its length, 16 at most."""
    weight = F.when(a.isNotNull(), F.least(F.length(a) + F.length(b), F.lit(16))).cast("long")
    out = {"votes": F.sum(weight)}
    for word, hashed in enumerate((F.xxhash64(a, b), F.xxhash64(b, a, F.lit(7)))):
        for i in range(LANES):
            out[f"s{word}_{i}"] = F.sum(F.shiftrightunsigned(hashed, i).bitwiseAND(F.lit(LANE_MASK)) * weight)
    return out


def signed_bits(word: int) -> Column:
    """The 64 bits that have more than half of the votes."""
    out = F.lit(0).cast("long")
    for i in range(LANES):
        both = F.col(f"s{word}_{i}")
        low, high = both.bitwiseAND(F.lit(0xFFFFFFFF)), F.shiftrightunsigned(both, 32)
        out = out.bitwiseOR(F.when(2 * low > F.col("votes"), F.lit(1 << i)).otherwise(F.lit(0)).cast("long"))
        out = out.bitwiseOR(F.when(2 * high > F.col("votes"), F.shiftleft(F.lit(1).cast("long"), i + 32)).otherwise(F.lit(0).cast("long")))
    return out


def fingerprints(rows: DataFrame, keys: list[str], text: str) -> DataFrame:
    """keys and fp0, fp1 (long) for each row; the keys must tell rows apart. Texts without words have all bits 0.

    Null counts as empty. If rows are already dealt out by a subset of the keys, nothing is shuffled.
    """
    each = rows.select(*keys, F.inline_outer(terms(text_or_empty(text))).alias("a", "b"))
    sums = each.groupBy(*keys).agg(*[F.coalesce(c, F.lit(0).cast("long")).alias(k) for k, c in vote_sums(F.col("a"), F.col("b")).items()])
    return sums.select(*keys, signed_bits(0).alias("fp0"), signed_bits(1).alias("fp1"))


def as_hex(fp0: str, fp1: str) -> Column:
    return F.lower(F.concat(F.lpad(F.hex(fp0), 16, "0"), F.lpad(F.hex(fp1), 16, "0")))


def distance(a0: Column, a1: Column, b0: Column, b1: Column) -> Column:
    return F.bit_count(a0.bitwiseXOR(b0)) + F.bit_count(a1.bitwiseXOR(b1))


def likeness(a0: str, a1: str, b0: str, b1: str) -> Column:
    return (F.lit(1.0) - distance(*map(F.col, (a0, a1, b0, b1))) / F.lit(float(BITS))).cast("double")


def in_order(docs: DataFrame) -> DataFrame:
    """(doc_id, h, copies, n, next_id, next_h): the distinct documents, and the next one by doc_id, after the last the first.

    Null ids stand before all, ties by a hash of the text, h; rows that repeat both are one entry. The sort is over
    ranges of the narrow table, and only its partitions' first entries, one row each, are looked at together.
    """
    narrow = docs.groupBy("doc_id", F.xxhash64(text_or_empty()).alias("h")).agg(F.count(F.lit(1)).alias("copies"), F.first(F.length(text_or_empty())).alias("n"))
    ordered = materialize(narrow.orderBy(F.col("doc_id").asc_nulls_first(), "h").withColumn("o", F.monotonically_increasing_id()))
    ordered = ordered.withColumn("range", F.shiftright("o", 33))
    key = F.struct("doc_id", "h")
    firsts = ordered.groupBy("range").agg(F.min_by(key, "o").alias("first"))
    along = Window.orderBy("range")
    first_of_all = F.min_by("first", "range").over(Window.partitionBy(F.lit(1)))
    firsts = firsts.select("range", F.coalesce(F.lead("first").over(along), first_of_all).alias("over"))
    inside = Window.partitionBy("range").orderBy("o")
    linked = ordered.withColumn("next", F.lead(key).over(inside)).join(F.broadcast(firsts), "range")
    linked = linked.withColumn("next", F.coalesce("next", "over"))
    return linked.select("doc_id", "h", "copies", "n", F.col("next.doc_id").alias("next_id"), F.col("next.h").alias("next_h"))


def fingerprint_report(docs: DataFrame) -> DataFrame:
    """Per document: doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next.

    The edited text has its last quarter of code points replaced by the first as many (or all) of the next document.
    Empty and null texts have fingerprint 0. A lone document is its own next one; of rows that repeat id and text each
    but the last is followed by its like. An empty table has no rows; other columns are not read.
    """
    # Null ids are keys like others. One exchange by the key serves the grouping, both joins and the votes.
    keyed = lambda i: [F.col(i).isNull().alias("none"), F.coalesce(i, F.lit(0)).alias("id")]
    key, next_key = ["none", "id", "h"], ["next_none", "next_id", "next_h"]
    texts = docs.select(*keyed("doc_id"), F.xxhash64(text_or_empty()).alias("h"), text_or_empty().alias("text")).groupBy(*key).agg(F.first("text").alias("text"))
    order = in_order(docs).select(*keyed("doc_id"), "h", "copies", "n", F.floor(F.col("n") / 4).cast("int").alias("cut"), F.struct(*keyed("next_id"), F.col("next_h").alias("h")).alias("x"))
    order = materialize(order.select(*key, "copies", "n", "cut", *[F.col(f"x.{a}").alias(b) for a, b in zip(key, next_key)]))
    # A document gives the one before it so many code points, which is all of it that travels again.
    wanted = order.select(*[F.col(b).alias(a) for a, b in zip(key, next_key)], *[F.col(a).alias(f"to_{a}") for a in key], "cut")
    given = texts.join(wanted, key).select(*[F.col(f"to_{a}").alias(a) for a in key], F.substring(F.col("text"), F.lit(1), F.col("cut")).alias("tail"))
    rows = texts.join(order, key).join(given, key)
    head = F.substring(F.col("text"), F.lit(1), F.col("n") - F.col("cut"))
    variants = [("own", F.col("text")), ("edited", F.concat(head, "tail"))]
    # Followed by its like a document is edited with its own beginning.
    variants.append(("again", F.when(F.col("copies") > 1, F.concat(head, F.substring(F.col("text"), F.lit(1), F.col("cut"))))))
    made = F.filter(F.array(*[F.struct(F.lit(k).alias("kind"), t.alias("t")) for k, t in variants]), lambda x: x["t"].isNotNull())
    each = rows.select(*key, F.inline(made)).withColumn("sha", F.unhex(F.when(F.col("kind") != "own", F.sha2("t", 256))))
    prints = fingerprints(each, [*key, "kind", "sha"], "t")
    of = lambda kind: F.max(F.when(F.col("kind") == kind, F.struct("fp0", "fp1", "sha"))).alias(kind)
    wide = materialize(prints.groupBy(*key).agg(of("own"), of("edited"), of("again")))
    following = wide.select(*[F.col(a).alias(b) for a, b in zip(key, next_key)], F.col("own").alias("following"))
    found = wide.join(order.drop("cut"), key).join(following, next_key)
    repeated = F.struct(F.col("again").alias("e"), F.col("own").alias("f"), (F.col("copies") - 1).alias("times"))
    last = F.struct(F.col("edited").alias("e"), F.col("following").alias("f"), F.lit(1).cast("long").alias("times"))
    found = found.select("none", "id", "n", "own", F.inline(F.filter(F.array(last, repeated), lambda x: x["times"] > 0)))
    found = found.select("*", F.explode(F.sequence(F.lit(1).cast("long"), "times")))
    return found.select(
        F.when(~F.col("none"), F.col("id")).alias("doc_id"),
        F.col("n").cast("long").alias("n_chars"),
        F.lower(F.hex("e.sha")).alias("edited_sha256"),
        as_hex("own.fp0", "own.fp1").alias("fingerprint"),
        as_hex("e.fp0", "e.fp1").alias("edited_fingerprint"),
        likeness("own.fp0", "own.fp1", "e.fp0", "e.fp1").alias("near_edited"),
        likeness("own.fp0", "own.fp1", "f.fp0", "f.fp1").alias("near_next"),
    )


def near_fingerprints(prints: DataFrame, radius: int = 3) -> DataFrame:
    """All pairs (a0, a1, b0, b1, distance) of different fingerprints fp0, fp1 at most `radius` bits apart, each once.

    The bits are cut into radius + 2 blocks, of which at least two agree for such a pair, so each table has two blocks
    permuted to the front as its key. Equal fingerprints are one entry. A pair is emitted by its first agreeing table.
    """
    blocks = radius + 2
    width = 64 * 2 // blocks
    bits = F.concat(F.lpad(F.conv(F.hex("fp0"), 16, 2), 64, "0"), F.lpad(F.conv(F.hex("fp1"), 16, 2), 64, "0"))
    block = lambda i: F.substring(bits, 1 + i * width, width if i < blocks - 1 else BITS - i * width)
    keys = F.array(*[F.concat_ws(",", F.lit(f"{i}-{j}"), block(i), block(j)) for i, j in combinations(range(blocks), 2)])
    entries = prints.select("fp0", "fp1").filter("fp0 IS NOT NULL AND fp1 IS NOT NULL").distinct().withColumn("keys", keys)
    table = entries.select("fp0", "fp1", "keys", F.explode("keys").alias("key"))
    left = table.select("key", F.col("fp0").alias("a0"), F.col("fp1").alias("a1"), F.col("keys").alias("ka"))
    right = table.select("key", F.col("fp0").alias("b0"), F.col("fp1").alias("b1"), F.col("keys").alias("kb"))
    d = distance(F.col("a0"), F.col("a1"), F.col("b0"), F.col("b1"))
    near = left.join(right, "key").filter((F.struct("a0", "a1") < F.struct("b0", "b1")) & (d <= radius))
    first = F.filter(F.arrays_zip("ka", "kb"), lambda z: z["ka"] == z["kb"])[0]["ka"]
    return near.filter(F.col("key") == first).select("a0", "a1", "b0", "b1", d.alias("distance"))
