"""Facts of one metadata document: the object, its children, and the types that it refers to."""

from __future__ import annotations

import re
from xml.etree import ElementTree

from loomgraph.functions.vocab import CHILD_TAGS, DIRECTORY_KINDS, OBJECT_PROPERTIES, PROFILE_PROPERTIES, TYPE_KINDS, full_name, snake, tag_kind

_TYPES = {name.casefold(): kind for name, kind in TYPE_KINDS.items()}
REFERENCE = re.compile(r"(?:cfg:|v8:)?\b(" + "|".join(TYPE_KINDS) + r")\.([A-Za-zА-Яа-яЁё_][A-Za-zА-Яа-яЁё0-9_]*)", re.I)
#: Roots that wrap an object.
WRAPPERS = ("MetaDataObject", "MetaDataObjectCollection")
#: Characters of a property's text that are kept.
MOST_PROPERTY = 4096


def local(tag: str) -> str:
    return tag.rpartition("}")[2].rpartition(":")[2]


def _properties_of(element: ElementTree.Element) -> ElementTree.Element | None:
    return next((c for c in element if local(c.tag) == "Properties"), None)


def _text(element: ElementTree.Element) -> str:
    """All text below an element, white space between pieces as one space."""
    return " ".join(filter(None, (t.strip() for t in element.itertext())))


def _own(element: ElementTree.Element, tag: str) -> str | None:
    """The first text of an element of this tag, in document order."""
    return next((e.text.strip() for e in element.iter() if local(e.tag).casefold() == tag and e.text and e.text.strip()), None)


def _name(element: ElementTree.Element) -> str | None:
    holder = _properties_of(element)
    return _own(element if holder is None else holder, "name")


def _synonym(element: ElementTree.Element) -> str | None:
    return next(filter(None, (_own(e, "content") for e in element.iter() if local(e.tag) == "Synonym")), None)


def _properties(element: ElementTree.Element) -> dict[str, str]:
    holder = _properties_of(element)
    found = {} if holder is None else {local(e.tag): _text(e) for e in holder if local(e.tag) in OBJECT_PROPERTIES}
    return {k: v[:MOST_PROPERTY] for k, v in sorted(found.items()) if v}


def _references(element: ElementTree.Element) -> list[dict]:
    found: dict[tuple[str, str], str] = {}
    for text in element.itertext():
        for prefix, name in REFERENCE.findall(text):
            found.setdefault((_TYPES[prefix.casefold()], name.casefold()), name)
    return [{"target": full_name(kind, name), "relation": "metadata_type_reference"} for (kind, _), name in found.items()]


def path_identity(path: str) -> tuple[str, str]:
    """Kind and name that a document's path says: its first folder, as a known one or by its own name, and what follows."""
    first, _, rest = path.partition("/")
    stem = lambda part: part.rpartition(".")[0] or part
    if rest:
        return DIRECTORY_KINDS.get(first) or generic_kind(first), stem(rest.partition("/")[0])
    return ("configuration", "Configuration") if path.casefold() == "configuration.xml" else ("metadata", stem(path))


def generic_kind(name: str) -> str:
    return re.sub(r"[^0-9A-Za-zА-Яа-яЁё_]+", "_", name).strip("_").casefold() or "metadata"


def parse_metadata(text: str, path: str) -> dict:
    """objects (kind, name, full_name, parent, synonym, uuid, properties), references (source, target, relation), profile."""
    root = ElementTree.fromstring(text)
    lone = root[0] if local(root.tag) in WRAPPERS and len(root) == 1 else root
    main = root if tag_kind(local(root.tag)) else next((c for c in root if tag_kind(local(c.tag))), lone)
    tag = local(main.tag)
    path_kind, path_name = path_identity(path)
    kind = tag_kind(tag) or (path_kind if tag in WRAPPERS else generic_kind(tag))
    name = _name(main) or path_name or tag
    top = full_name(kind, name)

    def item(element: ElementTree.Element, kind: str, name: str, full: str, parent: str | None) -> dict:
        return {"kind": kind, "name": name, "full_name": full, "parent": parent, "synonym": _synonym(element), "uuid": element.get("uuid") or element.get("UUID"), "properties": _properties(element)}

    objects = [item(main, kind, name, top, None)]
    references = [{"source": top, **r} for r in _references(main)]
    seen = set()
    for child in main.iter():
        if child is not main and local(child.tag) in CHILD_TAGS and (own := _name(child)):
            full = f"{top}.{local(child.tag)}.{own}"
            if full.casefold() not in seen:
                seen.add(full.casefold())
                objects.append(item(child, snake(local(child.tag)), own, full, top))
                references += [{"source": full, **r} for r in _references(child)]
    profile = {local(e.tag): v for e in main.iter() if local(e.tag) in PROFILE_PROPERTIES and (v := _text(e))}
    return {"objects": objects, "references": references, "profile": profile}
