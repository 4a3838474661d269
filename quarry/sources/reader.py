"""PDF files as tables.

A file is parsed once in a Python worker, and each part asked for comes out as an array of rows in the document's row;
``part`` turns one into a flat table. All parts of a document are made where its bytes are, without a shuffle. A file never
fails the job: one that can't be loaded gives a row with ``load_error`` and empty parts; where a part can't be made, that
one is empty and ``part_errors`` names it; a number beyond its column's range is null.
"""

from __future__ import annotations

import json
from collections import Counter
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import ArrayType, MapType, StringType, StructType

from ..functions import structure, text, validate
from ..functions.codecs import is_binary
from .batches import array_of, bounded, sliced
from .crypt import algorithm, permissions
from .document import Document, LoadError, load
from .objects import Name, Ref, Stream, Text, kind_of, lossy, references, shown, tagged


def _documents(doc: Document) -> list[dict]:
    info, settings = structure.information(doc)
    # Where the trailer doesn't name it, a cross-reference stream may.
    xrefs = (v.dict["Encrypt"] for v in doc.objects.values() if isinstance(v, Stream) and v.dict.get("Type") == "XRef" and "Encrypt" in v.dict)
    held = doc.trailer["Encrypt"] if "Encrypt" in doc.trailer else next(xrefs, None)
    encrypt = doc.get(held)

    v, length, p = ((encrypt.get(k, d) if isinstance(encrypt, dict) else 0) for k, d in (("V", 0), ("Length", 0), ("P", 0)))
    security = {"algorithm": algorithm(v, length), "version": v, "revision": encrypt.get("R", 0), "key_length": length, "p": p, "permissions": permissions(p), "encrypt_object": held.num if isinstance(held, Ref) else None} if isinstance(encrypt, dict) else None
    recovery = [{"object": r.object, "generation": r.generation, "file_offset": r.file_offset, "declared_length": r.declared_length, "actual_length": r.actual_length} for r in doc.recovery]
    mark = doc.dict_of(doc.catalog.get("MarkInfo")) or {}
    return [{
        "version": doc.version, "object_count": len(doc.objects), "page_count": len(doc.pages()), "encrypted": doc.encrypted, "decrypted": doc.decrypted, "security": security,
        "info": info, "settings": settings, "recovery": recovery, "tagged": mark.get("Marked") is True, "has_page_labels": "PageLabels" in doc.catalog,
    }]


def _detail(value) -> str:
    if isinstance(value, Stream):
        f = value.dict.get("Filter")
        return f"{len(value.raw)} bytes" + (f", {f}" if isinstance(f, Name) else "")
    if isinstance(value, dict):
        some = [f"{k}={shown(v)}" for k, v in value.items() if k in ("BaseFont", "Subtype", "MediaBox")]
        return ", ".join(some[:3]) if some else f"{len(value)} keys"
    return ""


def _objects(doc: Document) -> list[dict]:
    out = []
    for ref, value in doc.objects.items():
        d, stream = structure.as_dict(value), value if isinstance(value, Stream) else None
        out.append({
            "obj_num": ref.num, "gen": ref.gen, "kind": kind_of(value), "type_label": text.name_at(d or {}, "Type", "-"), "subtype": text.name_at(d or {}, "Subtype") or None, "n_keys": len(d) if d is not None else None,
            "detail": _detail(value), "label": structure.node_label(value), "summary": structure.summary(value), "filters": Document.filters(stream) if stream else None, "raw_len": len(stream.raw) if stream else None,
            "declared_length": structure.whole(stream.dict.get("Length")) if stream else None,
        })
    return out


def _generations(doc: Document) -> list[dict]:
    """Object numbers with several generations."""
    found: dict[int, list[int]] = {}
    for ref in doc.objects:
        found.setdefault(ref.num, []).append(ref.gen)
    return [{"obj_num": num, "gens": sorted(gens)} for num, gens in found.items() if len(gens) > 1]


def _values(doc: Document, only: int | None = None) -> list[dict]:
    """Objects as JSON; only: those of one number."""
    return [{"obj_num": r.num, "gen": r.gen, "kind": kind_of(v), "value": json.dumps(tagged(v), ensure_ascii=False, sort_keys=True)} for r, v in doc.objects.items() if only is None or r.num == only]


def _streams(doc: Document, held: bool = True) -> list[dict]:
    """Streams with their bytes, raw and decoded; without them if they aren't to be held."""
    out = []
    for r, v in doc.objects.items():
        if isinstance(v, Stream):
            data, warning = doc.decode(v)
            out.append({"obj_num": r.num, "gen": r.gen, "raw": v.raw if held else None, "data": data if held else None, "warning": warning, "is_binary": is_binary(data)})
    return out


def _stream_matches(doc: Document, sought: tuple[str, ...] = ()) -> list[dict]:
    """Streams whose decoded bytes hold a text, without regard to the case of ASCII letters; at is the text's place among those sought."""
    wanted, out = [x.encode().lower() for x in sought], []
    for r, v in doc.objects.items():
        if isinstance(v, Stream):
            low = doc.decode(v)[0].lower()
            out += [{"obj_num": r.num, "gen": r.gen, "at": i} for i, x in enumerate(wanted) if x in low]
    return out


def _entries(doc: Document) -> list[dict]:
    return [
        {"obj_num": r.num, "gen": r.gen, "ord": i, "key": str(k), "vkind": kind_of(v), "vtext": lossy(v) if isinstance(v, Text) else str(v) if isinstance(v, Name) else shown(v)}
        for r, value in doc.objects.items() for i, (k, v) in enumerate((structure.as_dict(value) or {}).items())
    ]


def _refs(doc: Document, only: int | None = None) -> list[dict]:
    """Every reference; those in the trailer have no source. only: those from or to objects of one number."""
    out = [{"src_num": None, "src_gen": None, "ord": i, "path": p, "dst_num": to.num, "dst_gen": to.gen, "from_xref": False, "missing": to not in doc.objects} for i, (p, to) in enumerate(references(doc.trailer)) if only is None or to.num == only]
    for r, value in doc.objects.items():
        xref = isinstance(value, Stream) and value.dict.get("Type") == "XRef"
        out += [{"src_num": r.num, "src_gen": r.gen, "ord": i, "path": p, "dst_num": to.num, "dst_gen": to.gen, "from_xref": xref, "missing": to not in doc.objects} for i, (p, to) in enumerate(references(value)) if only is None or only in (r.num, to.num)]
    return out


def _referrers(doc: Document) -> list[dict]:
    """What points at each object, with its paths in order; the trailer aside."""
    found: dict[tuple[Ref, Ref], list[str]] = {}
    for r, value in doc.objects.items():
        for path, to in references(value):
            found.setdefault((to, r), []).append(path)
    return [{"dst_num": to.num, "dst_gen": to.gen, "src_num": r.num, "src_gen": r.gen, "paths": found[to, r]} for to, r in sorted(found)]


def _pages(doc: Document) -> list[dict]:
    out = []
    for i, ref in enumerate(doc.pages(), 1):
        node = doc.objects[ref]
        contents = node.get("Contents")
        parts = [c for c in (contents if isinstance(contents, list) else [contents]) if isinstance(c, tuple)]
        streams = [doc.objects.get(c) for c in parts]
        rotate = structure.whole(node.get("Rotate"))
        out.append({"page_number": i, "obj_num": ref.num, "gen": ref.gen, "media_box": shown(node["MediaBox"]) if "MediaBox" in node else "-", "crop_box": shown(node["CropBox"]) if "CropBox" in node else None,
                    "rotate": rotate, "content_streams": len(parts), "content_bytes": sum(len(s.raw) for s in streams if isinstance(s, Stream))})
    return out


def _operations(doc: Document) -> list[dict]:
    out = []
    for i, ref in enumerate(doc.pages(), 1):
        found, warnings = doc.operations(ref)
        out.append({"page_number": i, "operations": [{"operator": o, "operands": [shown(v) if not isinstance(v, Stream) else "<<...>>" for v in x]} for o, x in found], "warnings": warnings})
    return out


def _page_text(doc: Document) -> list[dict]:
    """The text of pages, interpreted once for all parts that need it."""
    if doc.page_text is not None:
        return doc.page_text
    read, out = text.Interpreter(doc), []
    for i, ref in enumerate(doc.pages(), 1):
        p = read.page(ref)
        out.append({"page_number": i, "text": p.text, "warnings": p.warnings, "total_codes": p.total, "unmapped_codes": p.unmapped, "fonts": [vars(f) for f in p.fonts], "garbled": text.garbled(p.text, p.warnings)})
    doc.page_text = out
    return out


def _matches(doc: Document, pattern: str = "") -> list[dict]:
    found = [(p["page_number"], text.snippets(p["text"], pattern)) for p in _page_text(doc)] if pattern else []
    return [{"page_number": n, "snippets": some} for n, some in found if some]


def _reliability(doc: Document) -> list[dict]:
    read = text.Interpreter(doc)
    pages = [read.page(r) for r in doc.pages()]
    fonts, total, unmapped = {}, sum(p.total for p in pages), sum(p.unmapped for p in pages)
    for f in (f for p in pages for f in p.fonts):
        fonts.setdefault((f.name, f.base_font, f.subtype), f)  # the first of a key counts
    return [{"verdict": text.verdict([*fonts.values()], total, unmapped), "total_codes": total, "unmapped_codes": unmapped, "unmapped_ratio": round(unmapped / total, 3) if total else 0.0, "fonts": [vars(f) for f in fonts.values()]}]


def _roles(doc: Document, only: int | None = None) -> list[dict]:
    """What each object is; only: those of one number."""
    page_of = structure.page_numbers(doc)
    return [
        {"obj_num": r.num, "gen": r.gen, "role": role, "description": said, "details": [{"name": k, "value": v} for k, v in details]}
        for r in doc.objects if only is None or r.num == only for role, said, details in (structure.classify(doc, r, page_of),)
    ]


def _reached(doc: Document) -> list[dict]:
    return [{"obj_num": r.num, "gen": r.gen} for r in sorted(doc.reachable())]


def _unreachable(doc: Document) -> list[dict]:
    reached, out = doc.reachable(), []
    for r, value in doc.objects.items():
        kind = text.name_at(structure.as_dict(value) or {}, "Type", "-")
        if r not in reached and not (isinstance(value, Stream) and kind == "XRef"):
            out.append({"obj_num": r.num, "gen": r.gen, "kind": kind_of(value), "type_label": kind})
    return out


def _page_objects(doc: Document) -> list[dict]:
    """What each page refers to at any depth of its dictionary, and what its resources do where they are an object."""
    out = []
    for i, ref in enumerate(doc.pages(), 1):
        found = {to for _, to in references(doc.objects[ref])}
        shared = doc.objects[ref].get("Resources")
        if isinstance(shared, Ref) and shared in doc.objects:
            found |= {to for _, to in references(doc.objects[shared])}
        out += [{"obj_num": n, "page_number": i} for n in sorted({to.num for to in found})]
    return out


def _page_info(doc: Document) -> list[dict]:
    """Pages with counts of what is on them, and the beginning of their text."""
    named: dict[int, list[dict]] = {}
    for r in structure.resources(doc):
        named.setdefault(r["page_number"], []).append(r)
    notes: dict[int, Counter] = {}
    for a in structure.annotations(doc):
        notes.setdefault(a["page_number"], Counter())[a["subtype"]] += 1
    out = []
    for page, shown in zip(_pages(doc), _page_text(doc), strict=True):
        own, subtypes = named.get(page["page_number"], []), notes.get(page["page_number"], Counter())
        preview = shown["text"][:200].strip() + "..." if len(shown["text"].encode()) > 200 else shown["text"].strip()
        out.append({
            **page, "text_extractable": not shown["garbled"], "text_preview": "(text not extractable — fonts lack Unicode mappings)" if shown["garbled"] else preview,
            "n_images": sum(r["kind"] == "XObject" and r["detail"].startswith("Image") for r in own), "n_graphics_states": sum(r["kind"] == "ExtGState" for r in own),
            "fonts": sorted(r["detail"].split(",")[0].strip() for r in own if r["kind"] == "Font"),
            "n_annotations": subtypes.total(), "annotation_subtypes": [{"subtype": k, "n": subtypes[k]} for k in sorted(subtypes)],
        })
    return out


_ID = "obj_num int, gen int"
_PAGE = f"page_number int, {_ID}, media_box string, crop_box string, rotate int, content_streams int, content_bytes bigint"
_FONT = "array<struct<name string, base_font string, subtype string, classification string, has_to_unicode boolean, reason string>>"
#: Part: the columns of its rows, and what makes them from a document.
PARTS: dict[str, tuple[str, Callable[[Document], list[dict]]]] = {
    "documents": (
        "version string, object_count int, page_count int, encrypted boolean, decrypted boolean, "
        "security struct<algorithm string, version int, revision int, key_length int, p bigint, permissions map<string, boolean>, encrypt_object int>, info map<string, string>, settings map<string, string>, "
        "recovery array<struct<object int, generation int, file_offset bigint, declared_length bigint, actual_length bigint>>, tagged boolean, has_page_labels boolean", _documents),
    "objects": (f"{_ID}, kind string, type_label string, subtype string, n_keys int, detail string, label string, summary string, filters array<string>, raw_len bigint, declared_length bigint", _objects),
    "generations": ("obj_num int, gens array<int>", _generations),
    "values": (f"{_ID}, kind string, value string", _values),
    "dumps": (f"{_ID}, text string", lambda doc: [{"obj_num": r.num, "gen": r.gen, "text": structure.object_dump(r, v)} for r, v in doc.objects.items()]),
    "streams": (f"{_ID}, raw binary, data binary, warning string, is_binary boolean", _streams),
    "stream_matches": (f"{_ID}, at int", _stream_matches),
    "entries": (f"{_ID}, ord int, key string, vkind string, vtext string", _entries),
    "refs": ("src_num int, src_gen int, ord int, path string, dst_num int, dst_gen int, from_xref boolean, missing boolean", _refs),
    "referrers": ("dst_num int, dst_gen int, src_num int, src_gen int, paths array<string>", _referrers),
    "pages": (_PAGE, _pages),
    "page_info": (
        f"{_PAGE}, text_extractable boolean, text_preview string, n_images int, n_graphics_states int, fonts array<string>, n_annotations int, annotation_subtypes array<struct<subtype string, n int>>", _page_info),
    "page_objects": ("obj_num int, page_number int", _page_objects),
    "operations": ("page_number int, operations array<struct<operator string, operands array<string>>>, warnings array<string>", _operations),
    "page_text": (f"page_number int, text string, warnings array<string>, total_codes bigint, unmapped_codes bigint, fonts {_FONT}, garbled boolean", _page_text),
    "matches": ("page_number int, snippets array<string>", _matches),
    "reliability": (f"verdict string, total_codes bigint, unmapped_codes bigint, unmapped_ratio double, fonts {_FONT}", _reliability),
    "roles": (f"{_ID}, role string, description string, details array<struct<name string, value string>>", _roles),
    "reached": (_ID, _reached),
    "unreachable": (f"{_ID}, kind string, type_label string", _unreachable),
    "fonts": (f"{_ID}, base_font string, subtype string, encoding string, embedded int, to_unicode int, first_char bigint, last_char bigint, widths_count int, differences string, cid_system_info string", structure.fonts),
    "images": (f"{_ID}, width bigint, height bigint, color_space string, bits bigint, filter string, size bigint", structure.images),
    "forms": (f"{_ID}, name string, field_type string, value string, flags bigint, page_number int, need_appearances boolean", structure.forms),
    "bookmarks": (f"node_id int, parent_id int, depth int, {_ID}, title string, destination string", structure.bookmarks),
    "annotations": (f"page_number int, {_ID}, subtype string, rect string, contents string, link_type string, target string", structure.annotations),
    "tags": ("node_id int, parent_id int, depth int, obj_num int, role string, page_number int, mcid bigint, title string, alt string", structure.tags),
    "label_ranges": ("first_page bigint, style string, prefix string, start bigint", structure.label_ranges),
    "layers": (f"ord int, {_ID}, name string, state string, pages array<int>", structure.layers),
    "embedded": ("name string, filename string, mime string, size bigint, obj_num int, filespec int", structure.embedded),
    "resources": ("page_number int, kind string, name string, obj_num int, detail string", structure.resources),
    "tree": (f"node_id int, parent_id int, depth int, key string, {_ID}, label string, status string", structure.tree),
    "tree_json": ("json string", lambda doc: [{"json": json.dumps(structure.nested_tree(doc), ensure_ascii=False, sort_keys=True)}]),
    "dot": ("line string", lambda doc: [{"line": x} for x in structure.dot(doc)]),
    "issues": ("rule_ord int, rule string, level string, message string", validate.issues),
}


def files(spark: SparkSession, path: str, glob: str = "*.pdf") -> DataFrame:
    """doc_key and content of the PDF files below a folder."""
    found = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", "true").load(path)
    return found.select(F.col("path").alias("doc_key"), "content")


def parse(found: DataFrame, parts: list[str], password: str | None = None, recovery: str = "lenient", options: dict | None = None) -> DataFrame:
    """doc_key, load_error, part_errors, and an array of rows for each part, of files with doc_key and content."""
    bounded(found.sparkSession)
    makers = {p: PARTS[p][1] for p in parts}
    rows = {p: StructType.fromDDL(PARTS[p][0]) for p in parts}
    kinds = {p: to_arrow_type(ArrayType(s)) for p, s in rows.items()}
    for name, given in (options or {}).items():
        makers[name] = lambda doc, make=makers[name], given=given: make(doc, **given)
    secret = None if password is None else password.encode()
    errors_kind = pa.map_(pa.string(), pa.string())

    def parsed(content: bytes | None) -> tuple[str | None, dict, dict]:
        """load_error, part_errors and parts of one file, whatever is in it."""
        try:
            doc = load(content or b"", secret, recovery)
        except LoadError as e:
            return str(e), {}, {}
        except Exception as e:  # noqa: BLE001
            return f"{type(e).__name__}: {e}", {}, {}
        failed, out = {}, {}
        for p, make in makers.items():
            try:
                out[p] = make(doc)
            except Exception as e:  # noqa: BLE001
                failed[p] = f"{type(e).__name__}: {e}"
        return None, failed, out

    def run(batches):
        for b in sliced(batches):
            made = [parsed(content) for content in b.column(1).to_pylist()]
            columns = [array_of([[*failed.items()] for _, failed, _ in made], errors_kind), *(array_of([out.get(p, []) for _, _, out in made], kinds[p]) for p in parts)]
            yield pa.RecordBatch.from_arrays([b.column(0), array_of([e for e, _, _ in made], pa.string()), *columns], ["doc_key", "load_error", "part_errors", *parts])

    schema = StructType().add("doc_key", "string").add("load_error", "string").add("part_errors", MapType(StringType(), StringType()))
    for p in parts:
        schema = schema.add(p, ArrayType(rows[p]))
    return found.select(F.col("doc_key").cast("string").alias("doc_key"), "content").mapInArrow(run, schema)


def part(parsed: DataFrame, name: str) -> DataFrame:
    """A flat table of one part: doc_key and the part's columns."""
    return parsed.select("doc_key", F.inline(name))


def table(found: DataFrame, name: str, **options) -> DataFrame:
    """One part of files, parsed for it alone."""
    return part(parse(found, [name], **options), name)
