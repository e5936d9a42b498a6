"""Toxicity by a weighted finite-state pattern grammar.

A lexicon maps words (or word beginnings, written ``lowe*``) to symbols with weights. Five weighted transducers are
composed, each reading the tape that the one before it writes: reported speech and negation rewrite insults and threats
to weak ones, a target before or after strengthens strong ones, and an acceptor lets a clause count if it holds an
insult, or a threat and a target. The composed machine runs over each clause, not over isolated words; the document's
score is the posterior of label 1 given the sum over its clauses.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from statistics import NormalDist

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomgraph.llm.common import boxed, materialize, unboxed

#: Bound on the labelled rows that fit() reads.
MAX_LABELLED = 12_000
#: Lengths of word beginnings that may stand for a family of inflected words.
STEMS = (4, 5, 6)
#: Terms that weigh less are no insults.
LEAST_WEIGHT = math.log(4)
#: Toxic documents that a term must be in; terms without any relation to the label that may pass the test by chance.
LEAST_TOXIC, BY_CHANCE = 3, 10

#: Closed classes of the grammar, in four languages. Threats and targets are seeds; insults are learned.
SEEDS = {
    "threat": ["kill", "murder", "destroy", "strangle", "stab", "shoot", "beat", "hurt", "burn", "töten", "umbringen", "erschießen", "schlagen", "tuer", "frapper", "brûler", "détruire", "matar", "golpear", "quemar", "destruir"],
    "target": [
        "you", "your", "yours", "yourself", "u", "ur", "they", "them", "their", "du", "dich", "dir", "dein", "deine", "ihr", "euch", "euer", "sie", "tu", "te", "toi", "ton",
        "ta", "vous", "votre", "ils", "elles", "usted", "ustedes", "tú", "ti", "vosotros", "ellos", "ellas",
    ],
    "negation": ["not", "never", "no", "none", "neither", "nor", "without", "isn", "aren", "wasn", "weren", "don", "doesn", "didn", "nicht", "kein", "keine", "keiner", "nie", "niemals", "ne", "pas", "jamais", "aucun", "aucune", "nunca", "jamás", "ningún", "ninguna"],
    "report": [
        "said", "says", "say", "wrote", "writes", "quoted", "claimed", "called", "reported", "told", "alleged", "sagte", "sagt", "sagten", "schrieb", "behauptete", "nannte", "zitierte", "dit", "écrit",
        "affirmé", "prétendu", "dijo", "dice", "dijeron", "escribió", "afirmó", "llamó",
    ],
}
THREAT_WEIGHT = 1.0
#: Symbols: O other, I insult, T threat, Y target, N negation, R reporting verb; small i and t: weak hits.
SYMBOL = {"threat": "T", "target": "Y", "negation": "N", "report": "R"}
STRONG, HITS = "IT", "ITit"
ADDED = ["tox_score", "tox_clauses"]
CLAUSE = re.compile(r"[.!?;\n]+")
WORD = re.compile(r"[^\W\d_]+")


class Weakened:
    """Transducer: for `reach` symbols after `opener` (None: to the clause's end), hits are written weak, times `factor`."""

    def __init__(self, opener: str, factor: float, reach: int | None):
        self.opener, self.factor, self.reach, self.start = opener, factor, reach, 0

    def step(self, state: int, symbol: str) -> tuple[int, str, float]:
        if symbol == self.opener:
            return (self.reach or 1), symbol, 1.0
        after = max(0, state - 1) if self.reach else state
        return (after, symbol.lower(), self.factor) if state and symbol in HITS else (after, symbol, 1.0)


class Aimed:
    """Transducer: for `reach` symbols after a target, strong hits count `factor` times."""

    def __init__(self, factor: float, reach: int):
        self.factor, self.reach, self.start = factor, reach, 0

    def step(self, state: int, symbol: str) -> tuple[int, str, float]:
        if symbol == "Y":
            return self.reach, symbol, 1.0
        return max(0, state - 1), symbol, self.factor if state and symbol in STRONG else 1.0


class AimedAfter:
    """Transducer: a target within `reach` symbols after a strong hit is written as Z, which strengthens that hit."""

    def __init__(self, reach: int):
        self.reach, self.start = reach, 0

    def step(self, state: int, symbol: str) -> tuple[int, str, float]:
        if symbol in STRONG:
            return self.reach, symbol, 1.0
        return (0, "Z", 1.0) if symbol == "Y" and state else (max(0, state - 1), symbol, 1.0)


class Acceptor:
    """Accepts a clause with an insult, or with a threat and a target: a threat word alone threatens nobody."""

    start, final = "", "I"
    moves = {("", "T"): "T", ("", "Y"): "Y", ("T", "Y"): "I", ("Y", "T"): "I"}

    def step(self, state: str, symbol: str) -> tuple[str, str, float]:
        kind = "Y" if symbol == "Z" else symbol.upper()
        return self.final if kind == "I" else self.moves.get((state, kind), state), symbol, 1.0


class Composed:
    """The composition of transducers: each reads what the one before it writes, and the weights of their arcs multiply.

    It is determinised as its arcs are met, so a long text takes one look-up a word.
    """

    def __init__(self, *parts):
        self.parts, self.start, self.arcs = parts, tuple(p.start for p in parts), {}

    def step(self, state: tuple, symbol: str) -> tuple[tuple, str, float]:
        arc = self.arcs.get((state, symbol))
        if arc is None:
            states, tape, weight = [], symbol, 1.0
            for part, s in zip(self.parts, state):
                s, tape, w = part.step(s, tape)
                states.append(s)
                weight *= w
            arc = self.arcs[state, symbol] = (tuple(states), tape, weight)
        return arc


def grammar() -> Composed:
    return Composed(Weakened("R", 0.4, None), Weakened("N", 0.5, 2), Aimed(1.5, 4), AimedAfter(3), Acceptor())


@dataclass
class Model:
    prior: float
    weights: dict[str, float]
    seeds: dict[str, str] = field(default_factory=lambda: {w: k for k, ws in SEEDS.items() for w in ws})


class Scorer:
    def __init__(self, model: Model):
        self.model, self.machine, self.memo = model, grammar(), {}

    def symbol(self, word: str) -> tuple[str, float]:
        """The symbol and weight of a word; the heaviest of itself and its beginnings counts."""
        got = self.memo.get(word)
        if got is None:
            known = self.model.weights
            weight = max([known.get(word, 0.0), *(known.get(word[:n] + "*", 0.0) for n in STEMS if len(word) > n)])
            kind = self.model.seeds.get(word)
            if weight > 0:
                got = ("T" if kind == "threat" else "I", weight)
            else:
                got = (SYMBOL[kind], THREAT_WEIGHT if kind == "threat" else 0.0) if kind else ("O", 0.0)
            if len(self.memo) > 200_000:
                self.memo.clear()
            self.memo[word] = got
        return got

    def clause(self, words: list[str]) -> float:
        state, total, last = self.machine.start, 0.0, 0.0
        for word in words:
            symbol, weight = self.symbol(word)
            state, written, factor = self.machine.step(state, symbol)
            if written in HITS:
                last = factor * weight
                total += last
            elif written == "Z":
                total += 0.5 * last
        return total if state[-1] == Acceptor.final else 0.0

    def score(self, text: str | None) -> tuple[float, int]:
        """Posterior of label 1, and the number of clauses that matched."""
        low, symbol = (text or "").lower(), self.symbol
        total, matched = self.model.prior, 0
        if any(symbol(w)[0] in "IT" for w in set(WORD.findall(low))):
            for part in CLAUSE.split(low):
                words = WORD.findall(part)
                if any(symbol(w)[0] in "IT" for w in words) and (s := self.clause(words)):
                    total, matched = total + s, matched + 1
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, total)))), matched


def wilson(hits: Column, n: float, z: float, upper: bool) -> Column:
    """Wilson's bound of the rate hits / n."""
    p, side = hits / F.lit(float(n)), 1 if upper else -1
    half = z * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n))
    return (p + z * z / (2 * n) + side * half) / (1 + z * z / n)


def terms_of(text: str | None) -> list[str]:
    """The distinct words of a text as the scorer sees them, and the beginnings of the longer ones."""
    words = set(WORD.findall((text or "").lower()))
    return list(words | {w[:n] + "*" for n in STEMS for w in words if len(w) > n})


def learn_labels(labels: DataFrame, max_labelled: int = MAX_LABELLED) -> DataFrame:
    """At most max_labelled (doc_id, toxic) of the learning fold, chosen by a hash of the id; of several labels the highest."""
    fold = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(3))
    return (
        labels.filter(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull() & (fold != 1))
        .groupBy("doc_id")
        .agg(F.max("toxic").alias("toxic"))
        .orderBy(F.xxhash64("doc_id"), "doc_id")
        .limit(max_labelled)
    )


def fit(documents: DataFrame, labels: DataFrame, max_labelled: int = MAX_LABELLED, by_chance: float = BY_CHANCE) -> Model:
    """Learn the insult lexicon from a bounded sample of labelled rows.

    A term's weight is the log of a lower bound of its rate in toxic documents over an upper bound of its rate in the
    others, so rare terms get none. Both bounds are Wilson's at the level at which, of all terms that are tried,
    `by_chance` at most are expected to be out of theirs; every term of weight LEAST_WEIGHT or more is kept. Without
    labels of both kinds the lexicon is empty and every score is the prior. Null texts are empty, labels whose document
    is missing teach nothing, and a row that repeats counts again.
    """

    @F.pandas_udf("array<string>")
    def terms(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield batch.map(terms_of)

    sample = learn_labels(labels, max_labelled)
    # The sample has at most max_labelled rows of two numbers, whatever the tables' size.
    rows = documents.select("doc_id", "text").join(F.broadcast(sample), "doc_id")
    total, toxic = rows.agg(F.count(F.lit(1)), F.coalesce(F.sum("toxic"), F.lit(0))).first()
    prior = math.log((toxic + 1) / (total - toxic + 2))
    if not toxic or toxic == total:
        return Model(min(prior, 0.0), {})
    counts = rows.select("toxic", F.explode(terms("text")).alias("term")).groupBy("term").agg(F.sum("toxic").alias("a"), F.count(F.lit(1)).alias("n"))
    counts = materialize(counts.filter(F.col("a") >= LEAST_TOXIC))
    z = NormalDist().inv_cdf(1 - min(0.05, by_chance / max(counts.count(), 1)))
    weight = F.log(wilson(F.col("a"), toxic, z, False) / wilson(F.col("n") - F.col("a"), total - toxic, z, True))
    # Terms of a bounded sample, of which each has so many occurrences: their number is bounded as well.
    found = counts.select("term", weight.alias("weight")).filter(F.col("weight") >= LEAST_WEIGHT).collect()
    return Model(prior, {r.term: r.weight for r in found})


def score_toxicity(docs: DataFrame, model: Model) -> DataFrame:
    """docs with the columns tox_score double (0 to 1) and tox_clauses long; null and empty texts get the prior.

    Columns of those names in docs are replaced. No column but text is an input of the score.
    """
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        scorer = Scorer(model)
        for batch in batches:
            yield pd.DataFrame([scorer.score(t) for t in batch["text"]], columns=["s", "n"])

    @F.pandas_udf("s double, n long")
    def scored(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        yield from run(pd.DataFrame({"text": t}) for t in texts)

    out = boxed(docs, ADDED, found=scored("text"))
    return out.select(*unboxed(docs, ADDED), F.col("found.s").alias("tox_score"), F.col("found.n").alias("tox_clauses"))
