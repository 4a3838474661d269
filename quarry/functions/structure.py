"""What a document is made of beside its text. Trees are walked in order, without recursion, and cycles end."""

from __future__ import annotations

from ..sources.document import Document
from ..sources.objects import Name, Ref, Stream, Text, kind_of, lossy, references, shown
from .text import name_at

FONT_FILES = ("FontFile", "FontFile2", "FontFile3")
FONT_SUBTYPES = ("Type1", "TrueType", "Type0", "CIDFontType0", "CIDFontType2", "MMType1", "Type3")


def said(value, default: str | None = None) -> str | None:
    """The text of a string or name."""
    return lossy(value) if isinstance(value, Text) else str(value) if isinstance(value, Name) else default


def whole(value) -> int | None:
    return value if isinstance(value, int) and not isinstance(value, (bool, Ref)) else None


def as_dict(value) -> dict | None:
    return value.dict if isinstance(value, Stream) else value if isinstance(value, dict) else None


def page_numbers(doc: Document) -> dict[Ref, int]:
    return {ref: i for i, ref in enumerate(doc.pages(), 1)}


def color_space(doc: Document, value) -> str:
    value = doc.get(value)
    if isinstance(value, Name):
        return str(value)
    return "[" + " ".join(str(v) if isinstance(v, Name) else shown(v) for v in value) + "]" if isinstance(value, list) else "-"


def filter_text(value) -> str:
    if isinstance(value, Name):
        return str(value)
    return ", ".join(str(v) if isinstance(v, Name) else "?" for v in value) if isinstance(value, list) else "-"


def fonts(doc: Document) -> list[dict]:
    out = []
    for ref, value in doc.objects.items():
        font = as_dict(value)
        if font is None or not (font.get("Type") == "Font" or name_at(font, "Subtype") in FONT_SUBTYPES):
            continue
        encoding, to_unicode, widths = font.get("Encoding"), font.get("ToUnicode"), doc.list_of(font.get("Widths"))
        file = font_file(doc, font)
        out.append({
            "obj_num": ref.num, "gen": ref.gen, "base_font": name_at(font, "BaseFont", "-"), "subtype": name_at(font, "Subtype", "-"),
            "encoding": str(encoding) if isinstance(encoding, Name) else shown(encoding) if isinstance(encoding, Ref) else "-",
            "embedded": file.num if file else None, "to_unicode": to_unicode.num if isinstance(to_unicode, Ref) else None,
            "first_char": whole(font.get("FirstChar")), "last_char": whole(font.get("LastChar")), "widths_count": None if widths is None else len(widths),
            "differences": differences_text(doc, font), "cid_system_info": cid_system(doc, font),
        })
    return out


def font_file(doc: Document, font: dict) -> Ref | None:
    held = font.get("FontDescriptor")
    descriptor = doc.dict_of(held) if isinstance(held, Ref) else None
    found = (descriptor.get(k) for k in FONT_FILES) if descriptor else ()
    return next((r for r in found if isinstance(r, Ref)), None)


def differences_text(doc: Document, font: dict, most: int = 5) -> str | None:
    encoding = doc.dict_of(font.get("Encoding"))
    items = doc.list_of(encoding.get("Differences")) if encoding else None
    parts, code, total = [], None, 0
    for item in items or []:
        if isinstance(item, Name):
            total += 1
            parts.append(f"/{item}" if code is None else f"{code}=/{item}")
            code = None if code is None else code + 1
        elif whole(item) is not None:
            code = item
    if not total:
        return None
    return ", ".join(parts[:most]) + (f", ... ({total} total)" if total > most else "")


def cid_system(doc: Document, font: dict) -> str | None:
    below = doc.list_of(font.get("DescendantFonts"))
    info = doc.dict_of((doc.dict_of(below[0]) or {}).get("CIDSystemInfo")) if below else None
    if info is None:
        return None
    supplement = whole(info.get("Supplement"))
    return f"{said(info.get('Registry'), '?')}-{said(info.get('Ordering'), '?')}-{'?' if supplement is None else supplement}"


def images(doc: Document) -> list[dict]:
    return [
        {"obj_num": r.num, "gen": r.gen, "width": whole(s.dict.get("Width")) or 0, "height": whole(s.dict.get("Height")) or 0, "color_space": color_space(doc, s.dict.get("ColorSpace")),
         "bits": whole(s.dict.get("BitsPerComponent")) or 0, "filter": filter_text(s.dict.get("Filter")), "size": len(s.raw)}
        for r, s in doc.objects.items() if isinstance(s, Stream) and s.dict.get("Subtype") == "Image"
    ]


def forms(doc: Document) -> list[dict]:
    """Fields in order. A node with kids that have names isn't a field itself."""
    form = doc.dict_of(doc.catalog.get("AcroForm"))
    if form is None:
        return []
    page_of = {}
    for i, ref in enumerate(doc.pages(), 1):
        annots = doc.objects[ref].get("Annots")
        page_of |= {a: i for a in (annots if isinstance(annots, list) else []) if isinstance(a, Ref)}
    appearances, out, seen = form.get("NeedAppearances") is True, [], set()
    stack = [(r, "") for r in reversed(doc.list_of(form.get("Fields")) or []) if isinstance(r, Ref)]
    while stack:
        ref, above = stack.pop()
        field = as_dict(doc.objects.get(ref))
        if field is None or ref in seen:
            continue
        seen.add(ref)
        own = lossy(field["T"]) if isinstance(field.get("T"), Text) else ""
        full = ".".join(x for x in (above, own) if x)
        kids = [k for k in field.get("Kids", []) if isinstance(k, Ref)] if isinstance(field.get("Kids"), list) else []
        if any("T" in (as_dict(doc.objects.get(k)) or {}) for k in kids):
            stack.extend((k, full) for k in reversed(kids))
            continue
        v = field.get("V")
        if isinstance(v, Text):
            value = f'"{lossy(v)}"'
        elif isinstance(v, list):
            value = "[array]"
        else:
            value = shown(v) if isinstance(v, (Name, bool)) or whole(v) is not None else "(empty)"
        out.append({"obj_num": ref.num, "gen": ref.gen, "name": full, "field_type": name_at(field, "FT", "-"), "value": value, "flags": (whole(field.get("Ff")) or 0) & 0xFFFFFFFF,
                    "page_number": page_of.get(ref), "need_appearances": appearances})
    return out


def destination(doc: Document, value) -> str:
    """A destination as text."""
    value = doc.get(value) if isinstance(value, Ref) and value in doc.objects else value
    if isinstance(value, list):
        return "[" + " ".join(shown(v) if v is None or isinstance(v, (Ref, Name, int, float)) and not isinstance(v, bool) else "?" for v in value) + "]"
    return f"({lossy(value)})" if isinstance(value, Text) else shown(value) if isinstance(value, (Name, Ref)) else "-"


def outline_target(doc: Document, item: dict) -> str:
    if "Dest" in item:
        return destination(doc, item["Dest"])
    held = item.get("A")
    action = doc.get(held)
    if not isinstance(action, dict):
        return f"Action({shown(held)})" if isinstance(held, Ref) else "-"
    kind = name_at(action, "S", "?")
    if kind == "GoTo":
        return f"GoTo({destination(doc, action['D']) if 'D' in action else '?'})"
    if kind == "URI":
        return f"URI({lossy(action['URI']) if isinstance(action.get('URI'), Text) else '?'})"
    return f"Action({kind})"


def link(doc: Document, annot: dict) -> tuple[str, str]:
    """Kind and target of a link."""
    if "Dest" in annot:
        return "GoTo", destination(doc, annot["Dest"])
    held = annot.get("A")
    action = doc.get(held)
    if not isinstance(action, dict):
        return "Unknown", shown(held) if isinstance(held, Ref) else "-"
    kind = name_at(action, "S", "Unknown")
    to = destination(doc, action["D"]) if "D" in action else None
    if kind == "GoTo":
        return kind, to or "?"
    if kind == "GoToR":
        return kind, f"{said(action.get('F'), '?')} {to or ''}".strip()
    key = {"URI": "URI", "Named": "N", "Launch": "F"}.get(kind)
    return kind, said(action.get(key), "?") if key else "-"


def bookmarks(doc: Document) -> list[dict]:
    """The outline in order; node_id counts from 1, parent_id is 0 at the top."""
    outlines = doc.dict_of(doc.catalog.get("Outlines"))
    out, seen, stack = [], set(), [(outlines.get("First"), 0, 0)] if outlines else []
    while stack:
        ref, parent, depth = stack.pop()
        item = doc.objects.get(ref) if isinstance(ref, Ref) and ref not in seen else None
        if not isinstance(item, dict):
            continue
        seen.add(ref)
        title = item.get("Title")
        node = len(out) + 1
        out.append({"node_id": node, "parent_id": parent, "depth": depth, "obj_num": ref.num, "gen": ref.gen, "title": lossy(title) if isinstance(title, Text) else "(untitled)", "destination": outline_target(doc, item)})
        stack += [(item.get("Next"), parent, depth), (item.get("First"), node, depth + 1)]
    return out


def annotations(doc: Document) -> list[dict]:
    out = []
    for page, ref in enumerate(doc.pages(), 1):
        for held in doc.list_of(doc.objects[ref].get("Annots")) or []:
            annot = doc.objects.get(held) if isinstance(held, Ref) else None
            if not isinstance(annot, dict):
                continue
            subtype, contents = name_at(annot, "Subtype", "-"), annot.get("Contents")
            kind, target = link(doc, annot) if subtype == "Link" else (None, None)
            out.append({"page_number": page, "obj_num": held.num, "gen": held.gen, "subtype": subtype, "rect": shown(annot["Rect"]) if "Rect" in annot else "-",
                        "contents": lossy(contents) if isinstance(contents, Text) else "-" if "Contents" in annot else "", "link_type": kind, "target": target})
    return out


def marked_content(node: dict) -> int | None:
    k = node.get("K")
    for item in k if isinstance(k, list) else [k]:
        found = whole(item.get("MCID")) if isinstance(item, dict) else whole(item)
        if found is not None:
            return found
    return None


def tags(doc: Document) -> list[dict]:
    """The structure tree in order; elements written in place have neither page nor children."""
    root = doc.dict_of(doc.catalog.get("StructTreeRoot"))
    page_of, out, seen = page_numbers(doc), [], set()

    def kids(node: dict, parent: int, depth: int):
        k = node.get("K")
        return [(x, parent, depth) for x in reversed(k if isinstance(k, list) else [k])]

    stack = kids(root, 0, 0) if root else []
    while stack:
        item, parent, depth = stack.pop()
        if isinstance(item, Ref):
            if item in seen:
                continue
            seen.add(item)
        node = doc.objects.get(item) if isinstance(item, Ref) else item
        if not isinstance(node, dict) or "S" not in node:
            continue
        own = isinstance(item, Ref)
        i = len(out) + 1
        out.append({"node_id": i, "parent_id": parent, "depth": depth, "obj_num": item.num if own else None, "role": name_at(node, "S", "-"), "page_number": page_of.get(node.get("Pg")) if own and isinstance(node.get("Pg"), Ref) else None,
                    "mcid": marked_content(node), "title": said(node.get("T")) if own else None, "alt": said(node.get("Alt")) if own else None})
        if own:
            stack += kids(node, i, depth + 1)
    return out


def roman(n: int) -> str:
    out = ""
    for value, letters in zip((1000, 900, 500, 400, 100, 90, 50, 40, 10, 9, 5, 4, 1), "m cm d cd c xc l xl x ix v iv i".split(), strict=True):
        out, n = out + letters * (n // value), n % value
    return out


def alpha(n: int) -> str:
    """As spreadsheets count columns: a to z, then aa."""
    out = ""
    while n > 0:
        n, k = divmod(n - 1, 26)
        out = chr(97 + k) + out
    return out


def label(style: str, prefix: str, n: int) -> str:
    if style == "D" or n <= 0 and style in ("r", "R", "a", "A"):
        return f"{prefix}{n}"
    made = roman(n) if style in ("r", "R") else alpha(n) if style in ("a", "A") else ""
    return prefix + (made.upper() if style in ("R", "A") else made)


def label_ranges(doc: Document) -> list[dict]:
    """Ranges of page labels by first page (from 0)."""
    if doc.dict_of(doc.catalog.get("PageLabels")) is None:
        return []
    out = []
    for key, value in doc.name_tree(doc.catalog["PageLabels"], "Nums", int):
        d = doc.dict_of(value)
        start = whole(d.get("St")) if d else None
        out.append({"first_page": key, "style": name_at(d, "S", "-") if d is not None else "D", "prefix": said(d.get("P"), "") if d else "", "start": 1 if start is None else start})
    return sorted(out, key=lambda r: r["first_page"])


def layers(doc: Document) -> list[dict]:
    held = doc.dict_of(doc.catalog.get("OCProperties"))
    groups = doc.list_of(held.get("OCGs")) if held else None
    if groups is None:
        return []
    default = doc.dict_of(held.get("D")) or {}
    on, off = ({x for x in default[k] if isinstance(x, Ref)} if isinstance(default.get(k), list) else set() for k in ("ON", "OFF"))
    base, on_pages = name_at(default, "BaseState", "ON"), {}
    for ref, page in sorted(page_numbers(doc).items()):
        node = doc.objects[ref]
        resources = doc.dict_of(node.get("Resources"))
        if resources is None:
            resources = doc.dict_of((doc.dict_of(node.get("Parent")) or {}).get("Resources"))
        for x in (doc.dict_of(resources.get("Properties")) or {}).values() if resources else ():
            group = doc.objects.get(x) if isinstance(x, Ref) else None
            if isinstance(group, dict) and group.get("Type") == "OCG":
                on_pages.setdefault(x, []).append(page)
    out = []
    for i, x in enumerate(groups):
        group = doc.objects.get(x) if isinstance(x, Ref) else None
        if isinstance(group, dict):
            out.append({"ord": i, "obj_num": x.num, "gen": x.gen, "name": said(group.get("Name"), "(unnamed)"), "state": "OFF" if x in off else "ON" if x in on else base, "pages": on_pages.pop(x, [])})
    return out


def embedded(doc: Document) -> list[dict]:
    names = doc.dict_of(doc.catalog.get("Names"))
    if names is None or doc.dict_of(names.get("EmbeddedFiles")) is None:
        return []
    out = []
    for key, held in doc.name_tree(names["EmbeddedFiles"]):
        spec = doc.objects.get(held) if isinstance(held, Ref) else None
        files = doc.dict_of(spec.get("EF")) if isinstance(spec, dict) else None
        ref = next((files[k] for k in ("F", "UF") if k in files), None) if files else None
        if not isinstance(ref, Ref):
            continue
        stream = doc.objects.get(ref)
        entries = stream.dict if isinstance(stream, Stream) else {}
        size = whole((doc.dict_of(entries.get("Params")) or {}).get("Size"))
        name = lossy(key)
        out.append({"name": name, "filename": said(next((spec[k] for k in ("UF", "F") if k in spec), None), name), "mime": name_at(entries, "Subtype", "-"), "size": size, "obj_num": ref.num, "filespec": held.num})
    return out


def resources(doc: Document) -> list[dict]:
    """What pages name in their resources: fonts, XObjects, graphics states and colour spaces."""
    out = []

    def detail(kind: str, value) -> str | None:
        d = doc.dict_of(value)
        if kind == "Font":
            return f"{name_at(d, 'BaseFont', '-')}, {name_at(d, 'Subtype', '-')}" if isinstance(value, Ref) and d else "-" if isinstance(value, Ref) else "inline"
        if kind == "ColorSpace":
            v = doc.get(value)
            if isinstance(v, Name):
                return str(v)
            if isinstance(v, list):
                return str(v[0]) if v and isinstance(v[0], Name) else f"[{len(v)} items]"
            return f"obj {value.num}" if isinstance(value, Ref) and v is not None else shown(value) if isinstance(value, Ref) else "?"
        if not isinstance(value, Ref):
            return None
        if kind == "ExtGState":
            return f"{len(d or {})} keys"
        sub = name_at(d or {}, "Subtype", "-")
        return f"Image, {whole(d.get('Width')) or 0}x{whole(d.get('Height')) or 0}" if sub == "Image" else sub

    for page, ref in enumerate(doc.pages(), 1):
        held = doc.dict_of(doc.inherited(ref, "Resources")) or {}
        for kind in ("Font", "XObject", "ExtGState", "ColorSpace"):
            for key, value in sorted((doc.dict_of(held.get(kind)) or {}).items()):
                text = detail(kind, value)
                if text is not None:
                    out.append({"page_number": page, "kind": kind, "name": f"/{key}", "obj_num": value.num if isinstance(value, Ref) else None, "detail": text})
    return out


def node_label(value) -> str:
    """What the object tree says of an object: its type if it has one, else its kind and size or value."""
    kind, d = kind_of(value), as_dict(value)
    if d is not None:
        named = str(d["Type"]) if isinstance(d.get("Type"), Name) else kind
        if isinstance(value, Stream):
            return f"{named}, {len(value.raw)} bytes"
        return named if named != kind else f"{kind}, {len(value)} keys"
    if isinstance(value, list):
        return f"{kind}, {len(value)} items"
    if value is None:
        return kind
    return f"{kind}({value.num} {value.gen})" if isinstance(value, Ref) else f"{kind}({said(value, shown(value))})"


def summary(value) -> str:
    """One line on what a reference points at."""
    d = as_dict(value)
    if d is None:
        return f"[{len(value)} items]" if isinstance(value, list) else shown(value)
    parts = [f"/Type /{d['Type']}"] if isinstance(d.get("Type"), Name) else []
    if isinstance(value, Stream):
        parts += [f"stream, {len(value.raw)} bytes", *([str(d["Filter"])] if isinstance(d.get("Filter"), Name) else [])]
        return f"<< {', '.join(parts)} >>"
    parts += [f"/{k}={shown(d[k])}" for k in ("BaseFont", "Subtype", "Count", "MediaBox") if k in d]
    return f"<< {', '.join([*parts, f'{len(d)} keys'])} >>"


def dump(value, indent: int = 0) -> str:
    """An object over several lines; hexadecimal strings stay hexadecimal."""
    pad = "  " * (indent + 1)
    if isinstance(value, Text) and value.hex:
        return f"<{bytes(value).hex()}>"
    if isinstance(value, list):
        return "[\n" + "".join(f"{pad}{dump(v, indent + 1)}\n" for v in value) + "  " * indent + "]"
    d = as_dict(value)
    if d is not None:
        body = "<<\n" + "".join(f"{pad}/{k} {dump(v, indent + 1)}\n" for k, v in d.items()) + "  " * indent + ">>"
        return body + " stream" * isinstance(value, Stream)
    return shown(value)


def object_dump(ref: Ref, value) -> str:
    """An object with its heading."""
    kind = name_at(as_dict(value) or {}, "Type")
    return f"Object {ref.num} {ref.gen} ({kind_of(value)}{f', /{kind}' if kind else ''}):\n{dump(value, 1)}"


def tree(doc: Document, max_depth: int | None = None) -> list[dict]:
    """Objects as they are first met from the trailer, and where they are met again."""
    out, seen = [], set()
    stack = [(r, p, 0, 1) for p, r in reversed(list(references(doc.trailer)))]
    while stack:
        ref, path, parent, depth = stack.pop()
        node = len(out) + 1
        status = "missing" if ref not in doc.objects else "visited" if ref in seen else "depth limit reached" if max_depth is not None and depth > max_depth else None
        out.append({"node_id": node, "parent_id": parent, "depth": depth, "key": path, "obj_num": ref.num, "gen": ref.gen, "label": node_label(doc.objects.get(ref)), "status": status})
        if status is None:
            seen.add(ref)
            stack.extend((r, p, node, depth + 1) for p, r in reversed(list(references(doc.objects[ref]))))
    return out


def nested_tree(doc: Document, max_depth: int | None = None) -> dict:
    """The tree as nested nodes: key, object, label, and status or children where there are any."""
    top: dict = {"key": "trailer", "label": "Trailer"}
    made = {0: top}
    for n in tree(doc, max_depth):
        node = made[n["node_id"]] = {"key": n["key"], "object": f"{n['obj_num']} {n['gen']}", "label": n["label"]}
        if n["status"]:
            node["status"] = n["status"]
        made[n["parent_id"]].setdefault("children", []).append(node)
    return top


def dot(doc: Document, max_depth: int | None = None) -> list[str]:
    """The tree for GraphViz."""
    lines, named = ["digraph pdf {", "  rankdir=LR;", '  trailer [label="Trailer"];'], set()
    nodes = tree(doc, max_depth)
    of = {n["node_id"]: f"obj_{n['obj_num']}_{n['gen']}" for n in nodes} | {0: "trailer"}
    for n in nodes:
        me = of[n["node_id"]]
        if me not in named:
            named.add(me)
            said_label = f"{n['obj_num']} {n['gen']}: {n['label']}".replace("\\", "\\\\").replace('"', '\\"')
            lines.append(f'  {me} [label="{said_label}"{", style=dashed" if n["status"] == "missing" else ""}];')
        key = n["key"].replace("\\", "\\\\").replace('"', '\\"')
        lines.append(f'  {of[n["parent_id"]]} -> {me} [label="{key}"];')
    return [*lines, "}"]


# Role and description by /Type for types that have no details of their own.
PLAIN_ROLES = {"XRef": ("XRef Stream", "is a cross-reference stream."), "ObjStm": ("Object Stream", "is an object stream.")}


def classify(doc: Document, ref: Ref, page_of: dict[Ref, int]) -> tuple[str, str, list[tuple[str, str]]]:
    """An object's role, a sentence on it, and details by name."""
    value = doc.objects.get(ref)
    role, sentence, details = _role(doc, ref, value, page_of)
    return role, f"Object {ref.num} {sentence}", [(k, str(v)) for k, v in details if v is not None]


def _role(doc: Document, ref: Ref, value, page_of: dict[Ref, int]):
    d = as_dict(value)
    if d is None:
        n, text = len(value) if isinstance(value, list) else 0, shown(value)
        said_of = {
            "Integer": f"is an integer: {text}.", "Real": f"is a real number: {text}.", "Boolean": f"is a boolean: {text}.", "String": f"is a string: {text}.", "Name": f"is a name: {text}.",
            "Array": f"is an array with {n} items.", "Null": "is null.", "Reference": f"is a reference to {text}.",
        }
        return kind_of(value), said_of[kind_of(value)], []
    kind, sub = name_at(d, "Type"), name_at(d, "Subtype")

    def form(key: str) -> str | None:
        return shown(d[key]) if key in d else None

    if kind in PLAIN_ROLES:
        return *PLAIN_ROLES[kind], []
    if kind == "Catalog":
        tree = doc.objects.get(d.get("Pages")) if isinstance(d.get("Pages"), Ref) else None
        return "Catalog", "is the document catalog (root object).", [("Pages", whole(tree.get("Count")) if isinstance(tree, dict) else None)]
    if kind == "Pages":
        return "Page Tree", "is a page tree node.", [("Count", whole(d.get("Count")))]
    if kind == "Page":
        n = page_of.get(ref)
        return "Page", f"is page {n}." if n else "is a page.", [("Page Number", n), ("MediaBox", form("MediaBox"))]
    if kind == "Annot":
        return "Annotation", f"is a {sub or 'unknown'} annotation.", [("Subtype", sub or "unknown"), ("Rect", form("Rect"))]
    if kind == "Action":
        action = name_at(d, "S", "unknown")
        return "Action", f"is a {action} action.", [("Action Type", action)]
    if kind == "FontDescriptor":
        font = name_at(d, "FontName", "-")
        return "Font Descriptor", f"is a font descriptor for {font}.", [("FontName", font), *(("Embedded", f"{form(k)} ({k})") for k in FONT_FILES if k in d)]
    if kind == "Encoding":
        base = name_at(d, "BaseEncoding", "-")
        return "Encoding", f"is a font encoding ({base}).", [("BaseEncoding", base), ("Differences", "yes" if "Differences" in d else None)]
    if kind == "ExtGState":
        return "Graphics State", "is an extended graphics state.", [("Keys", ", ".join(f"/{k}" for k in d))]
    if kind == "Font" or sub in FONT_SUBTYPES:
        return "Font", f"is a {sub or '-'} font ({name_at(d, 'BaseFont', '-')}).", _font_details(doc, d)
    size = f"{len(value.raw)} bytes" if isinstance(value, Stream) else None
    if sub == "Image":
        width, height, space = whole(d.get("Width")), whole(d.get("Height")), color_space(doc, d["ColorSpace"]) if "ColorSpace" in d else None
        dims = f" ({width}x{height})" if width is not None and height is not None else ""
        return "Image", f"is an image{dims}{f', {space}' if space else ''}.", [
            ("Width", width), ("Height", height), ("ColorSpace", space), ("BitsPerComponent", whole(d.get("BitsPerComponent"))), ("Filter", filter_text(d["Filter"]) if "Filter" in d else None), ("Stream Size", size),
        ]
    if sub == "Form":
        return "Form XObject", "is a form XObject.", [("BBox", form("BBox"))]
    return "Generic", f"is a {'stream' if size else 'dictionary'} with {len(d)} keys.", [("Type", kind or None), ("Subtype", sub or None), ("Keys", len(d)), ("Stream Size", size)]


def _font_details(doc: Document, font: dict) -> list:
    held = font.get("FontDescriptor")
    if held is None:
        descriptor = "no FontDescriptor"
    elif isinstance(held, Ref):
        there = as_dict(doc.objects.get(held))
        file = next((k for k in FONT_FILES if there and k in there), None)
        descriptor = f"embedded ({file})" if file else "not embedded" if there is not None else f"FontDescriptor at {shown(held)}" + " (unresolvable)" * (held not in doc.objects)
    else:
        descriptor = "has FontDescriptor" + " (inline)" * isinstance(held, dict)
    encoding = font.get("Encoding")
    return [
        ("BaseFont", name_at(font, "BaseFont", "-")), ("Subtype", name_at(font, "Subtype", "-")), ("Encoding", "-" if encoding is None else str(encoding) if isinstance(encoding, Name) else shown(encoding)),
        ("FontDescriptor", descriptor), ("ToUnicode", "yes" if "ToUnicode" in font else "no"), ("FirstChar", whole(font.get("FirstChar"))), ("LastChar", whole(font.get("LastChar"))),
    ]


def information(doc: Document) -> tuple[dict[str, str], dict[str, str]]:
    """The information dictionary's strings, and the catalog's settings."""
    info = doc.dict_of(doc.trailer.get("Info")) or {}
    keys = ("Title", "Author", "Subject", "Keywords", "Creator", "Producer", "CreationDate", "ModDate")
    settings = {k: said(doc.catalog.get(k)) for k in ("PageLayout", "PageMode", "Lang")}
    return {k: lossy(info[k]) for k in keys if isinstance(info.get(k), Text)}, {k: v for k, v in settings.items() if v is not None}


