"""Queries over files that hold one case each, with the SQL that states their results from the tables alone."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..api import Corpus
from ..operators import graph, objects, sinks, structure, summary, text
from ..sources import cases, corpora, reader
from .queries import _ID, _N_PAGES, _PAGES, _documents, _faulty, _filtered, _fonts, _plain, _table, query


def _of(spark, sf_dir, table: str, key: str, make, *more: str):
    """A file of each row of a table, made from its key and further columns."""
    return corpora.built(_table(spark, sf_dir, table).select(key, *more), make, key)


def _id(key: str):
    return F.col("doc_key").cast("bigint").alias(key)


# Validation.


@query(
    """SELECT c_custkey, rule, level, message FROM customer JOIN (VALUES (0, 'required_keys', 'error', 'Catalog missing required /Pages key'),
(1, 'required_keys', 'error', 'Page 1 (object 5): missing /MediaBox (not found in page or parent chain)'), (2, 'content_syntax', 'warn', 'Page 1: content stream 4 0 has invalid syntax'),
(3, 'font_entries', 'warn', 'Font object 1 0: missing /BaseFont'), (4, 'font_entries', 'warn', 'Font object 1 0: has /FirstChar but not /LastChar'),
(5, 'font_entries', 'warn', 'Font object 1 0: /Widths has 2 entries but /FirstChar..=/LastChar expects 3'), (6, 'parent_cycles', 'error', 'Page 1: cycle detected in /Parent chain (object 2 0 seen twice)'),
(7, 'name_trees', 'warn', 'Name tree ''Dests'': /Names array has odd length (1)'), (8, 'name_trees', 'warn', 'Name tree ''JavaScript'': node has neither /Names nor /Kids'),
(9, 'name_trees', 'error', 'Name tree ''AP'': cycle detected at object 7 0'),
(10, 'encryption', 'warn', 'Document is encrypted and was not decrypted; object/page/stream counts and structural checks are incomplete (supply --password).'),
(11, 'required_keys', 'error', 'Trailer missing /Root reference')) AS f(k, rule, level, message) ON c_custkey % 13 = k"""
)
def validation_rules(spark, sf_dir):
    """Every rule by a fault of its own (H0, H3, H4, H7 to H10). What a fault leaves unreachable, and what locked content looks
    like, are other rules' findings."""
    found = _of(spark, sf_dir, "customer", "c_custkey", lambda r: cases.fault_file(r["c_custkey"]))
    return reader.table(found, "issues").filter("rule <> 'unreachable' and (cast(doc_key as bigint) % 13 <> 10 or rule = 'encryption')").select(_id("c_custkey"), "rule", "level", "message")


# Text.


@query("SELECT doc_id, text FROM documents")
def split_content_text(spark, sf_dir):
    """Text whose content is cut into streams, with resources from the page tree."""
    found = corpora.built(_documents(spark, sf_dir), cases.split_file, "doc_id")
    return text.document_text(reader.parse(found, ["page_text"])).select(F.expr(_ID), "text")


@query("SELECT doc_id, text FROM documents")
def form_text(spark, sf_dir):
    """Text in forms within forms, with resources of their own or their caller's."""
    found = corpora.built(_documents(spark, sf_dir), cases.form_file, "doc_id")
    return text.document_text(reader.parse(found, ["page_text"])).select(F.expr(_ID), "text")


@query("""SELECT s_suppkey, s_name || chr(10) || 'a (b) (nested (twice)) cd' || chr(10) || 'Hello to gether' AS text, 6 AS object_count, '1.3' AS version, 0 AS n_issues FROM supplier""")
def handwritten_text(spark, sf_dir):
    """Files spelled out byte by byte, with an update."""
    parsed = reader.parse(_of(spark, sf_dir, "supplier", "s_suppkey", lambda r: cases.handwritten_file(r["s_name"]), "s_name"), ["page_text", "documents", "issues"])
    d = F.get("documents", F.lit(0))
    return parsed.select(_id("s_suppkey"), F.get("page_text", F.lit(0)).text.alias("text"), d.object_count.alias("object_count"), d.version.alias("version"), F.size("issues").alias("n_issues"))


_GLYPHS = "".join(t for t, name in zip(cases.GLYPH_TEXTS, cases.GLYPHS, strict=True) if len(t) == 1)
_CODES = "".join(chr(65 + i) for i, t in enumerate(cases.GLYPH_TEXTS) if len(t) == 1)


@query(
    f"""SELECT c_custkey, replace(translate(s, '{_CODES}', '{_GLYPHS}'), 'L', 'fi') AS text, CAST(length(replace(s, ' ', '')) AS BIGINT) AS total_codes, CAST(length(s) - length(replace(s, 'V', '')) AS BIGINT) AS unmapped_codes
FROM (SELECT c_custkey, upper(c_name || ' ' || c_mktsegment || ' vexed quick jobs flown why zip') AS s FROM customer)"""
)
def glyph_text(spark, sf_dir):
    """Codes that stand for glyphs by name: numbered, Greek, by Unicode's names, ligatures, and one unknown."""
    found = _of(spark, sf_dir, "customer", "c_custkey", lambda r: cases.glyph_file(f"{r['c_name']} {r['c_mktsegment']} vexed quick jobs flown why zip".upper()), "c_name", "c_mktsegment")
    return reader.table(found, "page_text").select(_id("c_custkey"), "text", "total_codes", "unmapped_codes")


@query(
    """SELECT c_custkey, CASE c_custkey % 4 WHEN 0 THEN 'Font /F1 (Own) has no explicit encoding or ToUnicode map. Text may be inaccurate.|Font /F2 (Own) has no explicit encoding or ToUnicode map. Text may be inaccurate.'
WHEN 1 THEN 'Font /F1 (Wide) uses CID encoding without ToUnicode map. Text may be inaccurate.|Font /F2 (Wide) uses CID encoding without ToUnicode map. Text may be inaccurate.' ELSE '' END AS warnings,
CASE WHEN c_custkey % 4 <> 1 THEN c_name || chr(10) || c_name END AS text, CAST(CASE c_custkey % 4 WHEN 1 THEN 4 ELSE 2 END * length(c_name) AS BIGINT) AS total_codes,
['degraded', 'unreliable', 'reliable', 'degraded'][c_custkey % 4 + 1] AS verdict, 2 AS n_fonts, c_custkey % 4 < 2 AS garbled FROM customer"""
)
def font_warnings(spark, sf_dir):
    """Fonts that nothing explains: warnings, verdict, and a record for each name of a font."""
    found = reader.parse(_of(spark, sf_dir, "customer", "c_custkey", lambda r: cases.warned_file(r["c_custkey"], r["c_name"]), "c_name"), ["page_text", "reliability"])
    page, said = F.get("page_text", F.lit(0)), F.get("reliability", F.lit(0))
    return found.select(
        _id("c_custkey"), F.array_join(page.warnings, "|").alias("warnings"), F.when(F.expr("cast(doc_key as bigint) % 4 <> 1"), page.text).alias("text"), page.total_codes.alias("total_codes"),
        said.verdict.alias("verdict"), F.size(said.fonts).alias("n_fonts"), page.garbled.alias("garbled"),
    )


@query(_PAGES + """, n AS (SELECT *, len(string_split(text, chr(10))) AS n FROM pages)
SELECT doc_id, page_number, seq, operator, operands FROM (SELECT doc_id, page_number, unnest([0, 1, 2, 3, 3 + 2 * n]) AS seq, unnest(['BT', 'Tf', 'TL', 'Td', 'ET']) AS operator, unnest(['', '/F1 12', '14', '50 742', '']) AS operands FROM n)""")
def operator_operands(spark, sf_dir):
    """Operators with their places and operands (F1, C9); the text shown aside."""
    rows = text.operator_list(reader.table(_plain(spark, sf_dir), "operations")).filter("operator not in ('Tj', 'T*')")
    return rows.select(F.expr(_ID), "page_number", "seq", "operator", F.array_join("operands", " ").alias("operands"))


# Objects.


@query(
    "SELECT doc_id, detail, CAST(n AS BIGINT) AS n FROM (SELECT doc_id, unnest(['Subtype=/Type1, BaseFont=/Helvetica', '1 keys', '2 keys', '3 keys', 'MediaBox=[0 0 612 792]', 'N bytes' || CASE doc_id % 6 WHEN 0 THEN '' "
    f"WHEN 1 THEN ', FlateDecode' WHEN 2 THEN ', ASCII85Decode' WHEN 3 THEN ', ASCIIHexDecode' WHEN 4 THEN ', LZWDecode' ELSE ', RunLengthDecode' END]) AS detail, unnest([1, 1, 1, 1, p, p]) AS n FROM (SELECT doc_id, {_N_PAGES} AS p FROM (SELECT doc_id, coalesce(text, '') AS text FROM documents)))"
)
def object_details(spark, sf_dir):
    """What a listing says of each object, sizes aside."""
    rows = objects.listing(reader.table(_filtered(spark, sf_dir), "objects")).withColumn("detail", F.regexp_replace("detail", r"^\d+ bytes", "N bytes"))
    return rows.groupBy("doc_key", "detail").agg(F.count("*").alias("n")).select(F.expr(_ID), "detail", "n")


@query(
    """SELECT doc_id, '{"objects": [{"generation": 0, "object": {"entries": {"BaseFont": {"type": "name", "value": "Helvetica"}, "Encoding": {"type": "name", "value": "WinAnsiEncoding"}, "Subtype": {"type": "name", "value": "Type1"}, '
|| '"Type": {"type": "name", "value": "Font"}}, "type": "dictionary"}, "object_number": 1}, {"error": "not found", "generation": 0, "object_number": 900000}]}' AS json FROM documents"""
)
def objects_json(spark, sf_dir):
    """Several objects as one JSON object, with an error for those that aren't there."""
    return objects.lookup_json(reader.parse(_plain(spark, sf_dir), ["values"]), "1,900000").select(F.expr(_ID), "json")


@query("""SELECT item_id, CAST(octet_length(encode(text)) + 1 AS INTEGER) AS size, TRUE AS is_binary, octet_length(encode(text)) + 1 > 10 AS truncated, '00' || hex(encode(text))[1:18] AS head,
'00000000  00 ' || rtrim(regexp_replace(lower(hex(encode(text)))[1:14], '(..)', '\\1 ', 'g')) || '  ' || rtrim(regexp_replace(lower(hex(encode(text)))[15:18], '(..)', '\\1 ', 'g')) AS dump FROM benchmark""")
def binary_contents(spark, sf_dir):
    """Binary contents, cut after ten bytes, as bytes and as a dump."""
    found = _of(spark, sf_dir, "benchmark", "item_id", lambda r: cases.binary_file(b"\0" + r["text"].encode()), "text")
    shown = objects.content(reader.table(found, "streams").filter("obj_num = 1"), truncate=10, as_hex=True)
    return shown.select(_id("item_id"), "size", "is_binary", "truncated", F.hex("content_bytes").alias("head"), F.rtrim(F.substring("content_hex", 1, 40)).alias("dump"))


_TREE = (
    '{"children": [{"children": [{"children": [{"children": [{"key": "/Parent", "label": "Pages", "object": "1 0", "status": "visited"}, {"key": "/Contents", "label": "Stream, N bytes", "object": "3 0"}, '
    '{"key": "/Resources", "label": "Dictionary, 0 keys", "object": "2 0"}], "key": "/Kids[0]", "label": "Page", "object": "4 0"}], "key": "/Pages", "label": "Pages", "object": "1 0"}], "key": "/Root", "label": "Catalog", "object": "5 0"}], '
    '"key": "trailer", "label": "Trailer"}'
)


@query(f"""SELECT item_id, replace('{_TREE}', 'N bytes', octet_length(encode(text)) || ' bytes') AS json FROM benchmark""")
def tree_json(spark, sf_dir):
    """The object tree as nested nodes with labels."""
    found = _of(spark, sf_dir, "benchmark", "item_id", lambda r: cases.content_file(r["text"].encode()), "text")
    return structure.nested(reader.parse(found, ["tree_json"])).select(_id("item_id"), "json")


_DOT = """digraph pdf {
  rankdir=LR;
  trailer [label="Trailer"];
  obj_5_0 [label="5 0: Catalog"];
  trailer -> obj_5_0 [label="/Root"];
  obj_1_0 [label="1 0: Pages"];
  obj_5_0 -> obj_1_0 [label="/Pages"];
  obj_4_0 [label="4 0: Page"];
  obj_1_0 -> obj_4_0 [label="/Kids[0]"];
  obj_4_0 -> obj_1_0 [label="/Parent"];
  obj_3_0 [label="3 0: Stream, N bytes"];
  obj_4_0 -> obj_3_0 [label="/Contents"];
  obj_2_0 [label="2 0: Dictionary, 0 keys"];
  obj_4_0 -> obj_2_0 [label="/Resources"];
}"""


@query(f"""SELECT item_id, replace('{_DOT}', 'N bytes', octet_length(encode(text)) || ' bytes') AS dot FROM benchmark""")
def dot_text(spark, sf_dir):
    """The object tree as GraphViz text."""
    found = _of(spark, sf_dir, "benchmark", "item_id", lambda r: cases.content_file(r["text"].encode()), "text")
    return reader.parse(found, ["dot"]).select(_id("item_id"), F.array_join("dot.line", "\n").alias("dot"))


@query("""SELECT doc_id, CASE WHEN doc_id % 11 = 0 THEN 1 ELSE 0 END AS n_repaired, doc_id % 11 = 0 AS repaired, FALSE AS strict, CASE WHEN doc_id % 3 = 0 THEN 1 ELSE 0 END AS n_issues FROM documents""")
def recovery_json(spark, sf_dir):
    """The recovery record at the root of a document's JSON, beside its findings."""
    parsed = reader.parse(_faulty(spark, sf_dir), ["documents", "issues"])
    root = F.to_json(F.struct(F.filter("issues", lambda i: i.rule == "page_count").alias("issues")))
    said = parsed.select(F.expr(_ID), sinks.recovery_in_json(root).alias("json"))
    at = lambda path: F.get_json_object("json", path)
    return said.select(
        "doc_id", F.coalesce(at("$.recovery.count").cast("int"), F.lit(0)).alias("n_repaired"), F.coalesce(at("$.recovery.repaired") == "true", F.lit(False)).alias("repaired"),
        F.coalesce(at("$.recovery.strict") == "true", F.lit(False)).alias("strict"), F.json_array_length(at("$.issues")).alias("n_issues"),
    )


@query(
    """SELECT s_suppkey, s_name AS text, s_name AS title, ['RC4, 40-bit', 'RC4, 128-bit', 'AES-128', 'AES-256'][s_suppkey % 4 + 1] AS algorithm, [1, 2, 4, 5][s_suppkey % 4 + 1] AS v, [2, 3, 4, 5][s_suppkey % 4 + 1] AS r,
CAST([0, 128, 128, 256][s_suppkey % 4 + 1] AS INTEGER) AS key_length, 8 AS encrypt_object FROM supplier"""
)
def encryption_methods(spark, sf_dir):
    """Files opened by every method of the standard handler, and what security says of them."""
    found = _of(spark, sf_dir, "supplier", "s_suppkey", lambda r: cases.locked_file(r["s_suppkey"], r["s_name"]), "s_name")
    parsed = reader.parse(found, ["page_text", "documents"], password="open sesame")
    d = F.get("documents", F.lit(0))
    return parsed.select(
        _id("s_suppkey"), F.get("page_text", F.lit(0)).text.alias("text"), d.info["Title"].alias("title"), d.security.algorithm.alias("algorithm"), d.security.version.alias("v"), d.security.revision.alias("r"),
        d.security.key_length.alias("key_length"), d.security.encrypt_object.alias("encrypt_object"),
    )


# Structure.


@query(
    """SELECT page_id, kind AS link_type, CASE k WHEN 0 THEN '(chapter)' WHEN 1 THEN '[4 0 R /XYZ 0 792 null]' WHEN 2 THEN '-' WHEN 3 THEN '[4 0 R /XYZ 0 792 null]' WHEN 4 THEN url || ' /there' WHEN 5 THEN url WHEN 6 THEN 'NextPage' WHEN 7 THEN url ELSE '-' END AS target,
url AS contents FROM (SELECT page_id, page_id % 9 AS k, coalesce(url, '') AS url, ['GoTo', 'GoTo', 'Unknown', 'GoTo', 'GoToR', 'URI', 'Named', 'Launch', 'Hide'][page_id % 9 + 1] AS kind FROM pages)"""
)
def link_kinds(spark, sf_dir):
    """Links of every kind, by destination or action, in place or by reference."""
    found = _of(spark, sf_dir, "pages", "page_id", lambda r: cases.link_file(r["page_id"], r["url"] or ""), "url")
    return reader.table(found, "annotations").filter("subtype = 'Link'").select(_id("page_id"), "link_type", "target", "contents")


@query(
    """SELECT c_custkey, CAST(c_custkey % 4 AS INTEGER) AS n_bookmarks, CAST(c_custkey % 5 AS INTEGER) AS n_fields, CAST(c_custkey % 6 AS INTEGER) AS n_layers, CAST(c_custkey % 7 AS INTEGER) AS n_embedded,
c_custkey % 2 = 1 AS has_page_labels, c_custkey % 3 = 0 AS tagged, CAST(0 AS INTEGER) AS error_count, CAST(0 AS INTEGER) AS status FROM customer"""
)
def feature_counts(spark, sf_dir):
    """Outline entries, fields, layers, attachments, labels and tags."""
    parsed = reader.parse(_of(spark, sf_dir, "customer", "c_custkey", lambda r: cases.rich_file(r["c_custkey"])), ["documents", "objects", "issues", "bookmarks", "forms", "layers", "embedded"])
    return summary.overview(parsed).select(_id("c_custkey"), "n_bookmarks", "n_fields", "n_layers", "n_embedded", "has_page_labels", "tagged", "error_count", "status")


@query(
    """SELECT s_suppkey, CASE WHEN s_suppkey % 4 > 0 THEN 3 END AS embedded, ['not embedded', 'embedded (FontFile)', 'embedded (FontFile2)', 'embedded (FontFile3)'][s_suppkey % 4 + 1] AS descriptor,
CAST(32 + s_suppkey % 3 AS BIGINT) AS last_char, CAST(1 + s_suppkey % 3 AS INTEGER) AS widths_count FROM supplier"""
)
def font_files(spark, sf_dir):
    """Files that fonts are embedded in, by their descriptors."""
    parsed = reader.parse(_of(spark, sf_dir, "supplier", "s_suppkey", lambda r: cases.font_file(r["s_suppkey"])), ["fonts", "roles"])
    font, role = F.get("fonts", F.lit(0)), F.get(F.filter("roles", lambda r: r.role == "Font"), F.lit(0))
    descriptor = F.get(F.filter(role.details, lambda d: d["name"] == "FontDescriptor"), F.lit(0)).value
    return parsed.select(_id("s_suppkey"), font.embedded.alias("embedded"), descriptor.alias("descriptor"), font.last_char.alias("last_char"), font.widths_count.alias("widths_count"))


@query(
    """SELECT p_partkey, ['-', 'DCTDecode', 'FlateDecode, DCTDecode', 'FlateDecode, ?'][p_partkey % 4 + 1] AS filter, ['DeviceRGB', '[ICCBased 9 0 R]', '[Indexed DeviceCMYK 1 (ab)]', '-'][p_partkey // 4 % 4 + 1] AS color_space,
CAST([1, 2, 4, 8][p_partkey % 4 + 1] AS BIGINT) AS bits, CAST(p_partkey AS BIGINT) AS width FROM part"""
)
def image_filters(spark, sf_dir):
    """Images by filters and colour spaces."""
    found = _of(spark, sf_dir, "part", "p_partkey", lambda r: cases.image_file(r["p_partkey"]))
    return reader.table(found, "images").select(_id("p_partkey"), "filter", "color_space", "bits", "width")


@query(
    """SELECT c_custkey, 'bookmarks,labels,layers,embedded' AS keys, CAST(c_custkey % 4 AS INTEGER) AS n_bookmarks, CAST(c_custkey % 2 AS INTEGER) AS n_labels, CASE WHEN c_custkey % 2 = 1 THEN '1' END AS first_label,
CAST(c_custkey % 6 AS INTEGER) AS n_layers, CAST(c_custkey % 7 AS INTEGER) AS n_embedded FROM customer"""
)
def combined_modes(spark, sf_dir):
    """Several modes as one JSON object, a key for each in their fixed order, from one parse."""
    found = _of(spark, sf_dir, "customer", "c_custkey", lambda r: cases.rich_file(r["c_custkey"]))
    said = Corpus(spark, found).combined_json("embedded", "layers", "labels", "bookmarks")
    n = lambda mode: F.json_array_length(F.get_json_object("json", f"$.{mode}"))
    return said.select(
        _id("c_custkey"), F.array_join(F.json_object_keys("json"), ",").alias("keys"), n("bookmarks").alias("n_bookmarks"), n("labels").alias("n_labels"), F.get_json_object("json", "$.labels[0].label").alias("first_label"),
        n("layers").alias("n_layers"), n("embedded").alias("n_embedded"),
    )


@query(_PAGES + """SELECT doc_id, CAST(CASE WHEN len > 1 THEN 1 ELSE 0 END AS INTEGER) AS n_pages, 'Annotations,Text,Matches' AS titles, CASE WHEN len > 1 AND contains(lower(second), 'an') THEN 1 ELSE 0 END AS n_matches
FROM (SELECT doc_id, max(page_number) AS len, coalesce(max(CASE WHEN page_number = 2 THEN text END), '') AS second FROM pages GROUP BY doc_id)""")
def mode_sections(spark, sf_dir):
    """Sections of several modes, with a page filter and a search, from one parse."""
    rows = Corpus(spark, _plain(spark, sf_dir)).sections("find_text", "text", "annotations", pattern="AN", pages="2")
    n = F.json_array_length("json")
    out = rows.groupBy("doc_key").agg(F.max(F.when(F.col("ord") == 1, n)).alias("n_pages"), F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("ord", "title"))), lambda t: t.title), ",").alias("titles"), F.max(F.when(F.col("ord") == 2, n)).alias("n_matches"))
    return out.select(F.expr(_ID), "n_pages", "titles", "n_matches")


# Text through tables and maps.


def _spelled(codec: str, more: dict[int, str]) -> str:
    """A list for SQL: the text of codes 0x20 to 0xFF, by Python's codec and what differs from it; codes without a text are lost ones."""
    texts = [more.get(c, bytes([c]).decode(codec, "replace") if codec else chr(c) if c < 0x7F else "\ufffd") for c in range(0x20, 0x100)]
    return "[" + ", ".join("'" + t.replace("'", "''") + "'" for t in texts) + "]"


# What the public specification's encodings have beside Python's codecs.
_LOST = "\ufffd"
_WIN = _spelled("cp1252", {0x7F: _LOST})
_MAC = _spelled("mac_roman", {0x7F: _LOST, 0xCA: " ", 0xDE: "fi", 0xDF: "fl"})
_STANDARD = _spelled("", {
    0x27: "\u2019", 0x60: "\u2018", **dict(zip(range(0xA1, 0xB0), "\u00a1\u00a2\u00a3\u2044\u00a5\u0192\u00a7\u00a4'\u201c\u00ab\u2039\u203a", strict=False)), 0xAE: "fi", 0xAF: "fl", 0xB1: "\u2013", 0xB2: "\u2020", 0xB3: "\u2021", 0xB4: "\u00b7",
    0xB6: "\u00b6", 0xB7: "\u2022", 0xB8: "\u201a", 0xB9: "\u201e", 0xBA: "\u201d", 0xBB: "\u00bb", 0xBC: "\u2026", 0xBD: "\u2030", 0xBF: "\u00bf", 0xC1: "`", 0xC2: "\u00b4", 0xC3: "\u02c6", 0xC4: "\u02dc", 0xC5: "\u00af", 0xC6: "\u02d8",
    0xC7: "\u02d9", 0xC8: "\u00a8", 0xCA: "\u02da", 0xCB: "\u00b8", 0xCD: "\u02dd", 0xCE: "\u02db", 0xCF: "\u02c7", 0xD0: "\u2014", 0xE1: "\u00c6", 0xE3: "\u00aa", 0xE8: "\u0141", 0xE9: "\u00d8", 0xEA: "\u0152", 0xEB: "\u00ba", 0xF1: "\u00e6",
    0xF5: "\u0131", 0xF8: "\u0142", 0xF9: "\u00f8", 0xFA: "\u0153", 0xFB: "\u00df",
})


_STANDARD_LOST = "".join(chr(c) for c, t in zip(range(0x20, 0x100), _STANDARD.strip("[]'").split("', '"), strict=True) if t == _LOST and c > 0x9F)


@query(
    f"""SELECT doc_id, CASE WHEN doc_id % 4 = 3 THEN 'unreliable' WHEN doc_id % 4 = 1 AND 5 * lost > total THEN 'degraded' ELSE 'reliable' END AS verdict, CAST(CASE WHEN doc_id % 4 = 1 THEN lost ELSE 0 END AS BIGINT) AS unmapped_codes
FROM (SELECT doc_id, length(replace(text, chr(10), '')) AS total, length(regexp_replace(text, '[^{_STANDARD_LOST}]', '', 'g')) AS lost FROM documents)"""
)
def reliability(spark, sf_dir):
    """The verdict by font: single bytes in two encodings, composite with a map, composite without."""
    rows = reader.table(_fonts(spark, sf_dir), "reliability")
    return rows.select(F.expr(_ID), "verdict", F.when(F.expr("cast(doc_key as bigint) % 4 = 1"), F.col("unmapped_codes")).otherwise(F.lit(0).cast("bigint")).alias("unmapped_codes"))


@query(
    f"""SELECT p_partkey, list_aggregate(t[k * 8 + 1:k * 8 + 8], 'string_agg', '') AS text, CAST(8 AS BIGINT) AS total_codes, CAST(len(list_filter(t[k * 8 + 1:k * 8 + 8], lambda x: x = '{_LOST}')) AS BIGINT) AS unmapped_codes
FROM (SELECT p_partkey, p_partkey // 3 % 28 AS k, CASE p_partkey % 3 WHEN 0 THEN {_WIN} WHEN 1 THEN {_MAC} ELSE {_STANDARD} END AS t FROM part)"""
)
def base_encodings(spark, sf_dir):
    """Every code of three base encodings."""
    found = _of(spark, sf_dir, "part", "p_partkey", lambda r: cases.encoded_file(r["p_partkey"]))
    return reader.table(found, "page_text").select(_id("p_partkey"), "text", "total_codes", "unmapped_codes")


_LETTERS = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
_MAPPED = "".join(chr(0x410 + i) for i in range(26)) + "".join(chr(0x3B1 + i) for i in range(26)) + "".join(chr(0x660 + i) for i in range(10))


@query(f"""SELECT c_custkey, replace(translate(c_name || ' ' || c_mktsegment, '{_LETTERS}', '{_MAPPED}'), '#', 'ffi') || '\U0001f600ABé\ufffd' AS text, CAST(length(c_name || ' ' || c_mktsegment) + 4 AS BIGINT) AS total_codes, CAST(1 AS BIGINT) AS unmapped_codes FROM customer""")
def mapped_codes_text(spark, sf_dir):
    """Codes of one and two bytes through single entries, ranges and a list of a map to Unicode."""
    found = _of(spark, sf_dir, "customer", "c_custkey", lambda r: cases.mapped_file(f"{r['c_name']} {r['c_mktsegment']}"), "c_name", "c_mktsegment")
    return reader.table(found, "page_text").select(_id("c_custkey"), "text", "total_codes", "unmapped_codes")


@query(
    """SELECT c_custkey, c_name AS title, c_mktsegment AS author, CAST(c_custkey AS VARCHAR) AS subject, CAST(c_nationkey AS VARCHAR) AS keywords, c_name AS creator, c_mktsegment AS producer,
'D:2024' || lpad(CAST(c_custkey AS VARCHAR), 6, '0') AS created, 'D:2025' || lpad(CAST(c_custkey AS VARCHAR), 6, '0') AS modified, 'TwoColumnLeft' AS layout, 'UseOutlines' AS mode, c_mktsegment AS lang, 8 AS n_info FROM customer"""
)
def all_metadata(spark, sf_dir):
    """Every key of information and settings."""
    found = _of(spark, sf_dir, "customer", "c_custkey", cases.described_file, "c_name", "c_mktsegment", "c_nationkey")
    d = F.get("documents", F.lit(0))
    keys = {"title": "Title", "author": "Author", "subject": "Subject", "keywords": "Keywords", "creator": "Creator", "producer": "Producer", "created": "CreationDate", "modified": "ModDate"}
    settings = {"layout": "PageLayout", "mode": "PageMode", "lang": "Lang"}
    return reader.parse(found, ["documents"]).select(
        _id("c_custkey"), *(d.info[k].alias(name) for name, k in keys.items()), *(d.settings[k].alias(name) for name, k in settings.items()), F.size(F.map_keys(d.info)).alias("n_info")
    )


_REFERENCES = f"""SELECT doc_id, CAST(unnest([NULL, 4 + 2 * p, 3]) AS INTEGER) AS src_num, unnest(['/Root', '/Pages', '/Font/F1']) AS path, CAST(unnest([4 + 2 * p, 2, 1]) AS INTEGER) AS dst_num FROM n
UNION ALL SELECT doc_id, CAST(unnest([2, 5 + 2 * i, 5 + 2 * i, 5 + 2 * i]) AS INTEGER), unnest(['/Kids[' || i || ']', '/Parent', '/Contents', '/Resources']), CAST(unnest([5 + 2 * i, 2, 4 + 2 * i, 3]) AS INTEGER) FROM (SELECT doc_id, unnest(range(0, CAST(p AS BIGINT))) AS i FROM n)"""
_N = f"WITH n AS (SELECT doc_id, {_N_PAGES} AS p FROM (SELECT doc_id, coalesce(text, '') AS text FROM documents)) "


@query(_N + _REFERENCES)
def reference_paths(spark, sf_dir):
    """Every reference with its path."""
    return reader.table(_plain(spark, sf_dir), "refs").select(F.expr(_ID), "src_num", "path", "dst_num")


@query(_N + f", r AS ({_REFERENCES}) SELECT doc_id, dst_num, src_num, string_agg(path, '|') AS paths FROM r WHERE src_num IS NOT NULL GROUP BY ALL")
def reverse_paths(spark, sf_dir):
    """What points at each object, and by which paths."""
    return graph.reverse(reader.parse(_plain(spark, sf_dir), ["referrers"])).select(F.expr(_ID), "dst_num", "src_num", F.array_join("paths", "|").alias("paths"))


@query(
    """SELECT n_nationkey, CAST(num AS INTEGER) AS obj_num, role, replace(said, 'N', CAST(n_nationkey AS VARCHAR)) AS description FROM nation, (VALUES (1, 'Annotation', 'Object 1 is a Text annotation.'), (2, 'Action', 'Object 2 is a GoTo action.'),
(3, 'Font Descriptor', 'Object 3 is a font descriptor for Own.'), (4, 'Encoding', 'Object 4 is a font encoding (WinAnsiEncoding).'), (5, 'Graphics State', 'Object 5 is an extended graphics state.'),
(6, 'Font', 'Object 6 is a TrueType font (Own).'), (7, 'Font', 'Object 7 is a CIDFontType2 font (Wide).'), (8, 'Image', 'Object 8 is an image (Nx2), DeviceGray.'), (9, 'Form XObject', 'Object 9 is a form XObject.'),
(10, 'Generic', 'Object 10 is a stream with 2 keys.'), (11, 'Array', 'Object 11 is an array with 3 items.'), (12, 'Integer', 'Object 12 is an integer: N.'), (13, 'Real', 'Object 13 is a real number: 0.5.'),
(14, 'Boolean', 'Object 14 is a boolean: true.'), (15, 'String', 'Object 15 is a string: (said).'), (16, 'Name', 'Object 16 is a name: /Called.'), (17, 'Null', 'Object 17 is null.'), (18, 'Generic', 'Object 18 is a dictionary with 1 keys.'),
(19, 'Page Tree', 'Object 19 is a page tree node.'), (20, 'Generic', 'Object 20 is a dictionary with 1 keys.'), (21, 'Generic', 'Object 21 is a stream with 1 keys.'), (22, 'Page', 'Object 22 is page 1.'), (23, 'Catalog', 'Object 23 is the document catalog (root object).')) AS v(num, role, said)"""
)
def all_roles(spark, sf_dir):
    """An object of every role, and what is said of it."""
    found = _of(spark, sf_dir, "nation", "n_nationkey", lambda r: cases.roles_file(r["n_nationkey"]))
    return reader.table(found, "roles").select(_id("n_nationkey"), "obj_num", "role", "description")
