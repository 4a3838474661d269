"""Validation rules over one document, in a fixed order."""

from __future__ import annotations

from ..sources.document import Document
from ..sources.objects import Name, Ref, Stream, SyntaxProblem, operations, references
from .structure import as_dict, whole
from .text import name_at

NAME_TREES, MAX_NAME_DEPTH = ("EmbeddedFiles", "Dests", "JavaScript", "AP"), 50
NEED_BASE_FONT = ("Type1", "TrueType", "Type0", "CIDFontType0", "CIDFontType2")


def issues(doc: Document) -> list[dict]:
    """rule_ord, level and message of every finding."""
    rules = (encryption, broken_references, unreachable, required_keys, lengths, page_count, content_syntax, font_entries, parent_cycles, name_trees, generations)
    return [{"rule_ord": i, "rule": rule.__name__, "level": level, "message": message} for i, rule in enumerate(rules) for level, message in rule(doc)]


def _xref(value) -> bool:
    return isinstance(value, Stream) and value.dict.get("Type") == "XRef"


def encryption(doc: Document):
    if doc.encrypted and not doc.decrypted:
        yield "warn", "Document is encrypted and was not decrypted; object/page/stream counts and structural checks are incomplete (supply --password)."


def broken_references(doc: Document):
    for ref, value in doc.objects.items():
        if not _xref(value):
            for _, to in references(value):
                if to not in doc.objects:
                    yield "error", f"Object {ref.num} {ref.gen}: references non-existent object {to.num} {to.gen}"


def unreachable(doc: Document):
    reached = doc.reachable()
    for ref, value in doc.objects.items():
        if ref not in reached and not _xref(value):
            yield "warn", f"Object {ref.num} {ref.gen} is unreachable from trailer"


def required_keys(doc: Document):
    root = doc.trailer.get("Root")
    if not isinstance(root, Ref):
        yield "error", "Trailer missing /Root reference"
    elif isinstance(doc.objects.get(root), dict) and "Pages" not in doc.objects[root]:
        yield "error", "Catalog missing required /Pages key"
    for i, page in enumerate(doc.pages(), 1):
        if doc.inherited(page, "MediaBox") is None and not _has(doc, page, "MediaBox"):
            yield "error", f"Page {i} (object {page.num}): missing /MediaBox (not found in page or parent chain)"


def _has(doc: Document, page: Ref, key: str) -> bool:
    """Whether a page or a node above it has the key, even with null."""
    seen, at = set(), page
    while isinstance(at, Ref) and at not in seen:
        seen.add(at)
        node = as_dict(doc.objects.get(at))
        if node is None:
            return False
        if key in node:
            return True
        at = node.get("Parent")
    return False


def lengths(doc: Document):
    for ref, value in doc.objects.items():
        declared = whole(value.dict.get("Length")) if isinstance(value, Stream) else None
        if declared is not None and declared != len(value.raw):
            yield "warn", f"Object {ref.num} {ref.gen}: /Length is {declared} but stream content is {len(value.raw)} bytes"


def page_count(doc: Document):
    node, n = doc.objects.get(doc.catalog.get("Pages")), len(doc.pages())
    declared = whole(node.get("Count")) if isinstance(node, dict) else None
    if declared is not None and declared != n:
        yield "error", f"/Pages /Count is {declared} but document has {n} pages"


def content_syntax(doc: Document):
    for i, page in enumerate(doc.pages(), 1):
        contents = doc.objects[page].get("Contents")
        for ref in contents if isinstance(contents, list) else [contents]:
            stream = doc.objects.get(ref) if isinstance(ref, Ref) else None
            if isinstance(stream, Stream):
                try:
                    operations(doc.decode(stream)[0])
                except SyntaxProblem:
                    yield "warn", f"Page {i}: content stream {ref.num} {ref.gen} has invalid syntax"


def font_entries(doc: Document):
    for ref, value in doc.objects.items():
        font = as_dict(value)
        if font is None or not isinstance(font.get("Type"), Name) or font["Type"] != "Font":
            continue
        where = f"Font object {ref.num} {ref.gen}"
        if name_at(font, "Subtype") in NEED_BASE_FONT and "BaseFont" not in font:
            yield "warn", f"{where}: missing /BaseFont"
        there = [k for k in ("FirstChar", "LastChar") if k in font]
        if len(there) == 1:
            yield "warn", f"{where}: has /{there[0]} but not /{'LastChar' if there[0] == 'FirstChar' else 'FirstChar'}"
        first, last, widths = whole(font.get("FirstChar")), whole(font.get("LastChar")), font.get("Widths")
        if first is not None and last is not None and isinstance(widths, list) and len(widths) != max(0, last - first + 1):
            yield "warn", f"{where}: /Widths has {len(widths)} entries but /FirstChar..=/LastChar expects {max(0, last - first + 1)}"


def parent_cycles(doc: Document):
    for i, page in enumerate(doc.pages(), 1):
        seen, node = {page}, doc.objects[page]
        while isinstance(node, dict) and isinstance(up := node.get("Parent"), Ref):
            if up in seen:
                yield "error", f"Page {i}: cycle detected in /Parent chain (object {up.num} {up.gen} seen twice)"
                break
            seen.add(up)
            node = doc.objects.get(up)


def name_trees(doc: Document):
    names = doc.dict_of(doc.catalog.get("Names")) or {}
    for key in NAME_TREES:
        top = doc.dict_of(names.get(key))
        stack, seen = [(top, 0)] if top is not None else [], set()
        while stack:
            node, depth = stack.pop()
            if isinstance(node, Ref):
                if node in seen:
                    yield "error", f"Name tree '{key}': cycle detected at object {node.num} {node.gen}"
                    continue
                seen.add(node)
                node = doc.objects.get(node)
                if not isinstance(node, dict):
                    continue
            if depth > MAX_NAME_DEPTH:
                yield "warn", f"Name tree '{key}': exceeded maximum depth (50)"
                continue
            if "Names" not in node and "Kids" not in node:
                yield "warn", f"Name tree '{key}': node has neither /Names nor /Kids"
                continue
            pairs, kids = node.get("Names"), node.get("Kids")
            if isinstance(pairs, list) and len(pairs) % 2:
                yield "warn", f"Name tree '{key}': /Names array has odd length ({len(pairs)})"
            stack += [(k, depth + 1) for k in reversed(kids if isinstance(kids, list) else []) if isinstance(k, Ref)]


def generations(doc: Document):
    found: dict[int, list[int]] = {}
    for ref in doc.objects:
        found.setdefault(ref.num, []).append(ref.gen)
    for num, gens in found.items():
        if len(gens) > 1:
            yield "info", f"Object {num}: multiple generations present ({gens})"
