"""Facts of one source module: symbols, calls, embedded queries, references to objects, directives."""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_right
from itertools import takewhile

from loomgraph.functions.vocab import MANAGER_KINDS, NO_CALLS, TYPE_PREFIXES, full_name, normalize

NAME = r"[A-Za-zА-Яа-яЁё_][A-Za-zА-Яа-яЁё0-9_]*"
TOKEN = re.compile(rf'(?P<comment>//[^\r\n]*)|(?P<string>"(?:[^"]|"")*(?:"|\Z))|(?P<name>{NAME})|(?P<line>\r\n|\r|\n)|(?P<mark>[^\s])')
#: Words of declarations, in both languages of the source, and what ends them.
OPENS = {"процедура": "procedure", "procedure": "procedure", "функция": "function", "function": "function"}
CLOSES = {"procedure": {"конецпроцедуры", "endprocedure"}, "function": {"конецфункции", "endfunction"}}
EXPORT, BY_VALUE = {"экспорт", "export"}, {"знач", "val"}
REGION = re.compile(r"^\s*#(?:(Область|Region)\s+(.+?)|(КонецОбласти|EndRegion)\b.*)\s*$", re.I)
DIRECTIVE = re.compile(r"^\s*&([A-Za-zА-Яа-яЁё0-9_]+)")
QUERY_KINDS = {"выбрать": "select", "select": "select", "удалить": "delete", "delete": "delete", "обновить": "update", "update": "update", "вставить": "insert", "insert": "insert"}
MARKER = re.compile(r"\b(" + "|".join(QUERY_KINDS) + r")\b", re.I)
READS = r"из|from|соединение|join"
WRITES = r"update|изменить|insert\s+into|вставить\s+в|delete\s+from|удалить\s+из"
TABLE = re.compile(rf"\b(?:({WRITES})|({READS}))\s+({NAME}(?:\.{NAME}){{0,4}})", re.I)


def query_facts(text: str) -> dict | None:
    """Kind, text and tables of a string that holds a query word; None for others."""
    body = "\n".join(re.sub(r"^[ \t]*\|?", "", line).rstrip() for line in text.split("\n")).strip()
    marker = MARKER.search(body)
    if not marker:
        return None
    tables = {}
    for writes, _, name in TABLE.findall(body):
        operation = "write" if writes else "read"
        tables.setdefault((normalize(name), operation), {"name": name, "operation": operation})
    return {"kind": QUERY_KINDS[marker[1].lower()], "text": body, "tables": list(tables.values())}


def _regions(lines: list[str]) -> list[str | None]:
    """The innermost open region at each line."""
    out, stack = [], []
    for line in lines:
        m = REGION.match(line)
        if m and m[1]:
            stack.append(m[2])
        elif m and stack:
            stack.pop()
        out.append(stack[-1] if stack else None)
    return out


def _directive_above(lines: list[str], line: int) -> str | None:
    above = next((x for x in reversed(lines[: line - 1]) if x.strip()), "")
    m = DIRECTIVE.match(above)
    return m[1] if m else None


def _parameters(tokens: list[tuple]) -> list[dict]:
    """Parameters between parentheses: name, by_value, default (its raw text)."""
    out, depth, current = [], 0, []
    for t in [*tokens, ("mark", ",", 0, 0, "")]:
        if t[0] == "mark" and t[1] == "," and depth == 0:
            names = [x for x in current if x[0] == "name"]
            by_value = bool(names) and names[0][1].lower() in BY_VALUE
            names = names[by_value:]
            if names:
                at = next((i for i, x in enumerate(current) if x[0] == "mark" and x[1] == "="), None)
                default = "".join(x[4] for x in current[at + 1 :]) if at is not None else ""
                out.append({"name": names[0][1], "by_value": by_value, "default": default or None})
            current = []
            continue
        if t[0] == "mark":
            depth += (t[1] in "([{") - (t[1] in ")]}")
        if t[0] != "line":
            current.append(t)
    return out


def parse_module(text: str) -> dict:
    """symbols, calls, queries, references, directives of a module; lines count from 1, at CR, LF and CRLF alike."""
    lines = re.split(r"\r\n|\r|\n", text)
    tokens, line, start = [], 1, 0
    for m in TOKEN.finditer(text):
        kind = m.lastgroup
        if kind != "comment":
            value = m[0][1:-1].replace('""', '"') if kind == "string" else m[0]
            tokens.append((kind, value, line, m.start() - start + 1, m[0]))
        breaks = list(re.finditer(r"\r\n|\r|\n", m[0]))
        if breaks:
            line, start = line + len(breaks), m.start() + breaks[-1].end()
    regions, symbols, after = _regions(lines), [], 0
    low = [t[1].lower() if t[0] == "name" else "" for t in tokens]
    mark = lambda i, c: i < len(tokens) and tokens[i][0] == "mark" and tokens[i][1] == c
    while after < len(tokens):
        i = after
        after += 1
        if low[i] not in OPENS or i + 1 >= len(tokens) or tokens[i + 1][0] != "name":
            continue
        opened = next((j for j in range(i + 2, len(tokens)) if mark(j, "(")), None)
        if opened is None:
            break
        depth, closed = 0, opened
        for closed in range(opened, len(tokens)):
            depth += mark(closed, "(") - mark(closed, ")")
            if depth == 0:
                break
        kind, last = OPENS[low[i]], tokens[closed][2]
        ends = next((j for j in range(closed, len(tokens)) if low[j] in CLOSES[kind]), None)
        first, final = tokens[i][2], tokens[ends][2] if ends is not None else len(lines)
        export = any(low[j] in EXPORT for j in takewhile(lambda j: tokens[j][2] == last, range(closed, len(tokens))))
        symbols.append({
            "name": tokens[i + 1][1], "kind": kind, "is_export": export, "directive": _directive_above(lines, first), "region": regions[first - 1],
            "line_start": first, "line_end": final, "signature": "\n".join(lines[first - 1 : last]), "parameters": _parameters(tokens[opened + 1 : closed]),
            "body_hash": hashlib.sha256("\n".join(lines[first - 1 : final]).encode()).hexdigest(),
        })
        if ends is None:
            break
        after = ends + 1

    begins, ends_at = [s["line_start"] for s in symbols], [s["line_end"] for s in symbols]

    def caller(n: int) -> int | None:
        """The first symbol whose lines hold n. Symbols follow each other and share a line at most, so both ends ascend."""
        k = bisect_right(ends_at, n - 1)
        return k if k < len(symbols) and begins[k] <= n else None

    calls, queries, references, i = [], [], {}, 0
    while i < len(tokens):
        kind, value, at, column, _ = tokens[i]
        if kind == "string" and (found := query_facts(value)):
            queries.append({**found, "line_start": at, "line_end": at + value.count("\n"), "caller": caller(at)})
        if kind == "name" and not (i and mark(i - 1, ".")):
            chain, j = [value], i + 1
            while mark(j, ".") and j + 1 < len(tokens) and tokens[j + 1][0] == "name":
                chain.append(tokens[j + 1][1])
                j += 2
            declared = i and (low[i - 1] in OPENS or mark(i - 1, "&"))
            if mark(j, "(") and value.lower() not in NO_CALLS and not declared:
                calls.append({"name": chain[-1], "qualifier": ".".join(chain[:-1]) or None, "line": at, "column": column, "caller": caller(at)})
            for left, right in zip(chain, chain[1:]):  # each pair of neighbours may name an object
                known, relation = MANAGER_KINDS.get(normalize(left)), "manager_access"
                if known is None:
                    known, relation = TYPE_PREFIXES.get(normalize(left)), "type_reference"
                if known:
                    target = full_name(known, right)
                    references.setdefault((at, normalize(target), relation), {"target": target, "relation": relation, "line": at, "caller": caller(at)})
            i = j
            continue
        if kind == "name" and mark(i + 1, "("):  # a call on a call's result: its name alone
            calls.append({"name": value, "qualifier": None, "line": at, "column": column, "caller": caller(at)})
        i += 1
    directives = [{"name": m[1], "line": n} for n, line in enumerate(lines, 1) if (m := DIRECTIVE.match(line))]
    return {"symbols": symbols, "calls": calls, "queries": queries, "references": list(references.values()), "directives": directives}
