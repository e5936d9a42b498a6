"""Main text of web pages by tag-path ratios.

Every text node belongs to the path of block elements (and links) from the root to it. Per path, characters outside
links and punctuation marks per node are aggregated, smoothed over neighbouring nodes in page order and fused into one
score. Tags, roles and class or id words that name boilerplate are no verdicts but weights on a path, shared by all that
stands below them, and scores are held against the best of the page: a mark around everything changes nothing. The
smallest element with nearly all text of the paths above the threshold leads to the content root; a page's only article
or main element is the root if it holds a good part of that text. Below the root a path's score is fused with the root's,
so that short blocks of an article stay and marked ones go, and held against a second threshold; paths whose text is mostly
links go as well. An id marks no element of running text and no section named like its heading: those are link targets.
"""

from __future__ import annotations

import html
import math
import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.llm.common import kept_columns, named

#: Elements whose content is no text of the page; their content is not parsed.
RAW = frozenset("script style title textarea noscript template iframe svg math object xmp noembed noframes".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements that end a block of text before and after them.
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "head header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul option select button".split()
)
#: Elements, roles and class or id words that mark boilerplate, and the weight of a mark.
BOILERPLATE = frozenset("nav header footer aside form button select menu dialog head fieldset".split())
ROLES = frozenset("navigation banner contentinfo complementary search dialog alert form menu menubar toolbar".split())
MARKS = frozenset(
    "ad ads advert adverts advertisement advertising adsense banner sponsor sponsored promo promotion comment comments disqus reply replies respond cookie cookies "
    "consent gdpr notice notices alert popup modal overlay sidebar aside widget menu nav navbar navigation breadcrumb breadcrumbs pagination pager share sharing "
    "social related recommended recommendations newsletter subscribe subscription signup login footer header masthead toolbar copyright disclaimer tags".split()
)
MARKED = 0.002
#: Words of a name that say nothing of what it holds, and words before a mark that deny it.
GENERIC = frozenset("list item items box container wrapper wrap area block section inner outer bar links link icons buttons media left right top bottom group row col column slot unit panel main site page global text content body".split())
DENIED = frozenset("no has have with without hide show is not".split())
#: A start tag ends the innermost open element of these kinds in its scope; any other block ends a paragraph.
CLOSES = {
    "li": frozenset(["li"]), "dt": frozenset(["dt", "dd"]), "dd": frozenset(["dt", "dd"]), "tr": frozenset(["tr"]),
    "td": frozenset(["td", "th"]), "th": frozenset(["td", "th"]), "option": frozenset(["option"]),
}
PARAGRAPH = frozenset(["p"])
CLOSABLE = frozenset("li dt dd tr td th option p".split())
#: Elements that begin a scope, and the kinds that a start tag inside no longer sees.
SCOPES = {tag: frozenset(kinds.split()) for tags, kinds in (
    ("ul ol menu dir", "li"), ("dl", "dt dd"), ("table thead tbody tfoot", "tr td th p"), ("tr", "td th p"), ("select", "option"), ("td th button object", "p"),
) for tag in tags.split()}
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Elements that hold a page's content: words of their class or id say what is on the page, not what they are.
CONTENT = frozenset("html body main article".split())
#: Elements that are parts of a text, and so are div elements without class and id.
PARTS = HEADINGS | frozenset("p li td th dd dt tr ul ol dl dir table thead tbody tfoot caption pre blockquote section figure figcaption details summary address center hgroup".split())
#: Elements of running text, whose ids are link targets.
TEXT = HEADINGS | frozenset("p li td th dd dt tr caption pre blockquote".split())
#: Names of reader comments, which are marks even where the section has a heading of that name.
READERS = frozenset("comment comments disqus reply replies respond".split())
#: A block of one of these texts alone, in no element of running text, is the label of an advert.
AD_LABELS = frozenset("advertisement advertisements advertising ad ads sponsored anzeige werbung publicité publicidad anuncio".split())
#: Smoothing weights of a node's neighbours; the accepted share of the best path's score; the root's share of accepted text.
SMOOTH = (0.25, 0.5, 0.25)
ACCEPT = 0.1
ROOT_SHARE = 0.9
#: The share of accepted text from which a page's only article or main element is the root.
ONLY_SHARE = 0.2
#: Below the root: the share of a path's own score in the fused one, and the threshold for that.
OWN, KEEP = 1 / 8, 0.25

TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:\"[^\"]*\"|'[^']*'|[^'\">])*)(>|\Z)", re.S)
ATTRIBUTE = re.compile(r"(?:^|\s)(class|id|role|hidden|aria-hidden|style)(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'>]+))?", re.I)
HEADED = re.compile(r"\s{0,200}<h[1-6][^>]{0,400}>([^<]{1,400})<", re.I)
PUNCTUATION = re.compile(r"[.,;:!?…。、，；：！？¿¡]")


@dataclass
class Element:
    tag: str
    parent: "Element | None"
    number: int
    depth: int
    weight: float
    path: int
    #: Tags of CLOSES and p that are open in the element's scope: only for those is it worth to look upwards.
    closable: frozenset[str] = frozenset()
    hidden: bool = False
    named: bool = False


@dataclass
class Block:
    path: int
    element: Element
    pieces: list[str] = field(default_factory=list)
    linked: int = 0
    text: str = ""


def names_boilerplate(name: str) -> bool:
    """Whether a class or id name is that of boilerplate: its last telling word is a mark that no word before it denies."""
    words = [w for w in re.split(r"[\s_\-:]+", name) if w and not w.isdigit()]
    telling = [w for w in words if w not in GENERIC]
    return bool(telling) and telling[-1] in MARKS and not DENIED & set(telling[:-1])


def is_target(name: str, tag: str, heading: str) -> bool:
    """Whether an id is that of a part of a text: of running text, or of a section whose heading has the same words."""
    words = lambda text: re.findall(r"[^\W_]+", text.lower())
    return tag in TEXT or tag == "section" and name not in READERS and bool(words(name)) and words(name) == words(heading)


def marks_of(attributes: str, tag: str, heading: str = "") -> tuple[bool, bool, bool]:
    """Whether an element is marked as boilerplate, is hidden, and has a class or id. heading: the one that it begins with."""
    marked = hidden = named = False
    for name, value in ATTRIBUTE.findall(attributes):
        name, value = name.lower(), html.unescape(value.strip("\"'")).lower()
        if name in ("class", "id"):
            named = True
            if name == "id" and is_target(value, tag, heading) or tag in HEADINGS:
                continue
            # A name on an element that holds content marks it only if the mark is all there is to it.
            marked |= any(v in MARKS if tag in CONTENT else names_boilerplate(v) for v in value.split())
        elif name == "role":
            marked |= value in ROLES
        elif name == "style":
            hidden |= bool(re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value))
        elif name == "hidden" or value == "true":
            hidden = True
    return marked, hidden, named


def blocks_of(page: str) -> tuple[list[Block], list[Element]]:
    """Blocks of text in page order, white space folded; and the elements, parents first. Linear in the page."""
    root = Element("", None, 0, 0, 1.0, 0)
    elements, paths = [root], {}
    here, out, links, at = root, [], 0, 0
    current: Block | None = None
    opened: Counter[str] = Counter()

    def path(parent: int, label: str) -> int:
        return paths.setdefault((parent, label), len(paths) + 1)

    def add(text: str) -> None:
        nonlocal current
        if current is None:
            if not text or text.isspace():
                return
            current = Block(path(here.path, "a") if links else here.path, here)
            out.append(current)
        current.pieces.append(text)
        if links:
            current.linked += len(text)

    def close(tags: frozenset[str]) -> None:
        """Ends the innermost open element of these tags, and all inside it."""
        nonlocal here
        while here.tag not in tags:
            opened[here.tag] -= 1
            here = here.parent
        opened[here.tag] -= 1
        here = here.parent

    def start(tag: str, attributes: str) -> Element:
        heading = HEADED.match(page, at) if tag == "section" else None
        marked, hidden, named = marks_of(attributes, tag, html.unescape(heading[1]) if heading else "")
        boilerplate = tag in BOILERPLATE and not (tag == "header" and (opened["article"] or opened["main"]))
        closable = here.closable
        if tag in SCOPES:
            closable -= SCOPES[tag]
        if tag in CLOSABLE:
            closable |= {tag}
        weight = here.weight * (MARKED if marked or boilerplate else 1.0)
        element = Element(tag, here, len(elements), here.depth + 1, weight, path(here.path, tag + "!" * marked), closable, here.hidden or hidden, named)
        elements.append(element)
        opened[tag] += 1
        return element

    end = len(page)
    while at < end:
        m = TOKEN.search(page, at)
        if m is None:
            add(html.unescape(page[at:]))
            break
        if m.start() > at:
            add(html.unescape(page[at : m.start()]))
        at = m.end()
        tag = (m[2] or "").lower()
        if not tag or not m[4]:  # a comment, a declaration, or a tag that the page's end cuts off
            continue
        if m[1]:  # an end tag
            if tag == "a":
                links = max(0, links - 1)
            if tag in BLOCK:
                current = None
                if opened[tag] > 0:
                    close(frozenset([tag]))
            continue
        if tag in RAW:
            if not m[3].endswith("/"):
                stop = re.compile(rf"</{re.escape(tag)}(?=[\s/>])[^>]*>?", re.I).search(page, at)
                at = stop.end() if stop else end
            continue
        if tag == "br":
            current = None
        if tag == "a":
            links = 1
        if tag in BLOCK:
            current = None
            ended = CLOSES.get(tag, PARAGRAPH if tag != "option" else frozenset()) & here.closable
            if ended:
                close(ended)
            if tag not in VOID:
                here = start(tag, m[3])
    for b in out:
        b.text = " ".join("".join(b.pieces).split())
    return [b for b in out if b.text and not b.element.hidden], elements


def path_scores(blocks: list[Block]) -> dict[int, float]:
    """Smoothed and fused ratios: characters outside links and punctuation marks per node of each path, times its weight."""
    nodes, chars, marks = defaultdict(int), defaultdict(int), defaultdict(int)
    for b in blocks:
        nodes[b.path] += 1
        chars[b.path] += max(0, len(b.text) - b.linked)
        marks[b.path] += len(PUNCTUATION.findall(b.text))
    ratios = [(chars[b.path] / nodes[b.path], marks[b.path] / nodes[b.path]) for b in blocks]
    sums: dict[int, float] = defaultdict(float)
    for i, b in enumerate(blocks):
        near = [ratios[max(0, i - 1)], ratios[i], ratios[min(len(blocks) - 1, i + 1)]]
        length, punctuation = (sum(w * r[k] for w, r in zip(SMOOTH, near)) for k in (0, 1))
        sums[b.path] += math.sqrt(length * (punctuation + 0.5)) * b.element.weight
    return {p: s / nodes[p] for p, s in sums.items()}


def content_root(blocks: list[Block], elements: list[Element], accepted: set[int]) -> Element:
    """The article or main element around nearly all accepted text, or else, around a part of a text, the element with all of it."""
    inside = [0] * len(elements)
    for b in blocks:
        if b.path in accepted:
            inside[b.element.number] += len(b.text)
    for e in reversed(elements[1:]):
        inside[e.parent.number] += inside[e.number]
    total = inside[0]
    root = max((e for e in elements if inside[e.number] >= ROOT_SHARE * total), key=lambda e: e.depth)
    e = root
    while e is not None and e.tag not in ("article", "main"):
        e = e.parent
    if e is not None:
        return e
    held = [False] * len(elements)  # whether an article or main element is around it
    for e in elements[1:]:
        held[e.number] = held[e.parent.number] or e.parent.tag in ("article", "main")
    outer = [e for e in elements if e.tag in ("article", "main") and not held[e.number] and inside[e.number]]
    if len(outer) == 1 and inside[outer[0].number] >= ONLY_SHARE * total:
        return outer[0]
    if root.tag in PARTS or root.tag == "div" and not root.named:
        while root.parent is not None and (inside[root.number] < total or root.tag in PARTS):
            root = root.parent
    return root


def main_text(page: str | None) -> str:
    """The main text; empty for a null or empty page, and for one without text outside hidden elements."""
    blocks, elements = blocks_of(page or "")
    if not blocks:
        return ""
    scores = path_scores(blocks)
    best = max(scores.values())
    accepted = {p for p, s in scores.items() if s >= ACCEPT * best}
    root = content_root(blocks, elements, accepted)
    whole = root.tag in ("", "html", "body")
    under = [False] * len(elements)
    for e in elements:
        under[e.number] = e is root or e.parent is not None and under[e.parent.number]
    chars, linked = Counter(), Counter()  # by path of elements, below the root
    for b in blocks:
        if under[b.element.number]:
            chars[b.element.path] += len(b.text)
            linked[b.element.path] += b.linked
    of_links = 2 * linked.total() >= chars.total()  # the content itself is a list of links

    def kept(b: Block) -> bool:
        if not under[b.element.number] or b.element.tag not in TEXT and b.text.lower().strip(".:") in AD_LABELS:
            return False
        weight = b.element.weight / root.weight
        if whole:  # nothing holds the text together: a path stands for itself
            return b.path in accepted or b.element.tag in HEADINGS and weight == 1
        fused = (scores[b.path] / best) ** OWN * weight ** (1 - OWN) if best else 0.0
        path = b.element.path
        return fused >= KEEP and (of_links or b.element.tag in HEADINGS or linked[path] < 0.5 * chars[path])

    return "\n".join(b.text for b in blocks if kept(b))


def extract(pages: DataFrame, column: str = "html") -> DataFrame:
    """pages with main_text (never null); a column of that name is replaced. Each row is worked on by itself."""

    @F.pandas_udf("string")
    def extracted(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield batch.map(main_text)

    return pages.select(*map(named, kept_columns(pages, ["main_text"])), extracted(F.coalesce(named(column), F.lit(""))).alias("main_text"))
