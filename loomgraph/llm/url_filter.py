"""URL filter: host and path rules first, then a weighted vocabulary counted by an Aho-Corasick automaton.

The automaton runs once over `host/path` and finds every term of the vocabulary. A hit counts only between boundaries: the
characters beside it, if any, are no letters. One strict term rejects a URL; soft terms reject it if two or more different
ones weigh enough together, so no single soft word, however often it stands there, does.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from typing import NamedTuple
from urllib.parse import unquote

import ahocorasick
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomgraph.llm.common import boxed, named, unboxed

#: Weight from which on a URL is rejected, and the different soft terms that this takes.
REJECT_AT = 10
LEAST_SOFT = 2
#: A strict term weighs enough alone; a strong soft one needs any other beside it, weak ones four.
STRICT = ("bestiality", "casino", "casinos", "cialis", "escorts", "gangbang", "hentai", "keygen", "milf", "porn", "porno", "viagra", "warez", "xnxx", "xvideos", "xxx")
STRONG = (
    "ads", "adult", "backlink", "backlinks", "bet", "bets", "betting", "doorway", "escort", "gambling", "hookup", "jackpot", "loan", "loans", "nude", "nudes",
    "payday", "pharmacy", "pill", "pills", "poker", "replica", "roulette", "sex", "sexy", "slots", "spam", "torrent", "torrents",
)
WEAK = ("18", "bonus", "buy", "cam", "cams", "cash", "cheap", "click", "crack", "dating", "discount", "farm", "free", "girls", "hot", "live", "lucky", "online", "seo", "track", "tracker", "tracking", "win", "x")
VOCABULARY: dict[str, int] = dict.fromkeys(STRICT, 10) | dict.fromkeys(STRONG, 7) | dict.fromkeys(WEAK, 3)
#: Most rules and terms: each task holds them all.
MOST_RULES = 1_000_000
ADDED = ["url_host", "url_path", "url_rule", "url_verdict", "url_hits", "url_weight"]

_PARTS = "(?s)^.*?://([^/?#]*)([^?#]*)"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


class Rule(NamedTuple):
    """What URLs of this host and its subdomains get whose path begins like this."""

    host: str
    path: str
    verdict: str


def host(url: Column) -> Column:
    """What stands after the first `://`, up to `/`, `?`, `#` or the end, A-Z in lower case; empty without `://`."""
    return F.translate(F.coalesce(F.regexp_extract(url, _PARTS, 1), F.lit("")), _UPPER, _LOWER)


def path(url: Column) -> Column:
    """What follows the host, up to `?`, `#` or the end."""
    return F.coalesce(F.regexp_extract(url, _PARTS, 2), F.lit(""))


def automaton(vocabulary: Mapping[str, int]) -> ahocorasick.Automaton:
    machine = ahocorasick.Automaton()
    for term, weight in vocabulary.items():
        machine.add_word(term, (term, weight))
    if vocabulary:
        machine.make_automaton()
    return machine


def term_hits(machine: ahocorasick.Automaton, text: str) -> dict[str, int]:
    """The different terms that stand in the text between boundaries, and their weights."""
    found = {}
    if len(machine):
        for end, (term, weight) in machine.iter(text):
            before, after = end - len(term), end + 1
            if not (before >= 0 and text[before].isalpha()) and not (after < len(text) and text[after].isalpha()):
                found[term] = weight
    return found


def rejected(hits: Mapping[str, int], reject_at: int, least_soft: int) -> bool:
    soft = [w for w in hits.values() if w < reject_at]
    return len(soft) < len(hits) or (len(soft) >= least_soft and sum(soft) >= reject_at)


def longest_rule(by_host: Mapping[str, list[Rule]], url_host: str, url_path: str) -> Rule | None:
    """Of the rules that fit, the longest; of equally long ones that of the longer host."""
    best, name = None, url_host
    while True:
        fits = next((r for r in by_host.get(name, ()) if url_path.startswith(r.path)), None)
        if fits and (best is None or len(fits.host + fits.path) > len(best.host + best.path)):
            best = fits
        if "." not in name:
            return best
        name = name.partition(".")[2]


def filter_urls(docs: DataFrame, rules: Sequence[Rule] = (), vocabulary: Mapping[str, int] = VOCABULARY, url: str = "url", reject_at: int = REJECT_AT, least_soft: int = LEAST_SOFT) -> DataFrame:
    """docs with url_host, url_path, url_rule, url_verdict (allow or block), url_hits and url_weight.

    The longest rule that fits decides; without one, the vocabulary does. url_hits are the different terms found, in
    order; url_weight is the sum of their weights. Terms are looked for in host and path, in lower case and with %-escapes
    decoded; what follows `?` or `#` is not read, as it holds searches and campaigns of others. One pass without a shuffle;
    a row's result depends on its URL alone, so nulls, repeated rows and empty tables need nothing special: a null URL, or
    one without `://`, has empty parts and is allowed. Columns of docs with one of the added names are replaced.
    """
    if len(rules) > MOST_RULES or len(vocabulary) > MOST_RULES:
        raise ValueError(f"more than {MOST_RULES} rules or terms")
    if bad := [r for r in rules if r.verdict not in ("allow", "block")] or [t for t in vocabulary if not t or t != t.lower()]:
        raise ValueError(f"not a rule or a lower-case term: {bad[0]}")
    by_host: dict[str, list[Rule]] = {}
    for rule in sorted(rules, key=lambda r: (-len(r.path), r.path, r.verdict)):
        by_host.setdefault(rule.host, []).append(rule)
    terms = dict(vocabulary)

    @F.pandas_udf("rule string, verdict string, hits string, weight long")
    def judge(hosts: pd.Series, paths: pd.Series) -> pd.DataFrame:
        machine, out = automaton(terms), []
        for h, p in zip(hosts, paths, strict=True):
            hits = term_hits(machine, unquote(h + p).lower())
            rule = longest_rule(by_host, h, p) if h else None
            verdict = rule.verdict if rule else "block" if rejected(hits, reject_at, least_soft) else "allow"
            out.append((rule and rule.host + rule.path, verdict, ",".join(sorted(hits)), sum(hits.values())))
        return pd.DataFrame(out, columns=["rule", "verdict", "hits", "weight"])

    rows = boxed(docs, ADDED, h=host(named(url)), p=path(named(url))).withColumn("j", judge("h", "p"))
    return rows.select(*unboxed(docs, ADDED), F.col("h").alias("url_host"), F.col("p").alias("url_path"), *[F.col(f"j.{a.removeprefix('url_')}").alias(a) for a in ADDED[2:]])
