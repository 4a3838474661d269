"""Named queries over PDF files made from the sample tables, each with the SQL that states its result from the tables alone."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import graph, objects, sinks, structure, summary, text
from ..sources import corpora, reader

_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a query under its function's name."""

    def add(f):
        _QUERIES[f.__name__] = f
        if sql is not None:
            _SQL[f.__name__] = sql
        return f

    return add


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _documents(spark: SparkSession, sf_dir: str, *more: str) -> DataFrame:
    return _table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"), *more)


def _plain(spark: SparkSession, sf_dir: str, **options) -> DataFrame:
    return corpora.documents(_table(spark, sf_dir, "documents"), **options)


def _filtered(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpora.built(_documents(spark, sf_dir), lambda r: corpora.text_file(r, filters=corpora.FILTERS[r["doc_id"] % 6]), "doc_id")


def _faulty(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _plain(spark, sf_dir, faults=True)


def _described(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpora.built(_documents(spark, sf_dir, "lang", "source"), corpora.text_file, "doc_id")


def _counted(parsed: DataFrame, part: str, column: str) -> DataFrame:
    """A part's rows by one of its columns, in the document's row."""
    values = F.transform(part, lambda r: F.coalesce(r[column], F.lit("-")))
    rows = parsed.select(F.expr(_ID), values.alias("v")).select("doc_id", "v", F.explode(F.array_distinct("v")).alias(column))
    return rows.select("doc_id", column, F.size(F.filter("v", lambda x: x == F.col(column))).cast("bigint").alias("n"))


_KINDS = ("win", "standard", "mapped", "unmapped")


def _fonts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpora.built(_documents(spark, sf_dir), lambda r: corpora.text_file(r, kind=_KINDS[r["doc_id"] % 4]), "doc_id")


_ID = "CAST(doc_key AS BIGINT) AS doc_id"
#: Pages of a text: its lines in groups of eight.
_N_PAGES = "CAST((len(string_split(text, chr(10))) + 7) // 8 AS INTEGER)"
_PAGES = """WITH lines AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS i FROM documents),
pages AS (SELECT doc_id, CAST((i - 1) // 8 + 1 AS INTEGER) AS page_number, string_agg(line, chr(10) ORDER BY i) AS text FROM lines GROUP BY ALL) """


# Text.


@query("SELECT doc_id, text FROM documents")
def document_text(spark, sf_dir):
    """All text of every file (F2, F16)."""
    return text.document_text(reader.parse(_plain(spark, sf_dir), ["page_text"])).select(F.expr(_ID), "text")


@query(_PAGES + "SELECT doc_id, page_number, text FROM pages")
def page_text(spark, sf_dir):
    """Text by page (F16)."""
    return text.page_text(reader.table(_plain(spark, sf_dir), "page_text")).select(F.expr(_ID), "page_number", "text")


@query(_PAGES + "SELECT doc_id, page_number, text FROM pages WHERE page_number BETWEEN 2 AND 3")
def page_text_range(spark, sf_dir):
    """Text of pages 2 to 3."""
    return text.page_text(reader.table(_plain(spark, sf_dir), "page_text"), "2-3").select(F.expr(_ID), "page_number", "text")


@query("SELECT doc_id, text FROM documents")
def filtered_text(spark, sf_dir):
    """Text through each stream filter."""
    return text.document_text(reader.parse(_filtered(spark, sf_dir), ["page_text"])).select(F.expr(_ID), "text")


@query("SELECT doc_id, text FROM documents")
def chained_filters_text(spark, sf_dir):
    """Text through two filters, one over the other (B2)."""
    found = corpora.built(_documents(spark, sf_dir), lambda r: corpora.text_file(r, filters=("ASCIIHexDecode", "FlateDecode")), "doc_id")
    return text.document_text(reader.parse(found, ["page_text"])).select(F.expr(_ID), "text")


@query("SELECT doc_id, text FROM documents")
def packed_file_text(spark, sf_dir):
    """Text of files with object streams and cross-reference streams (A1)."""
    return text.document_text(reader.parse(_plain(spark, sf_dir, packed=True), ["page_text"])).select(F.expr(_ID), "text")


@query("SELECT doc_id, text FROM documents")
def encrypted_text(spark, sf_dir):
    """Text of files opened with a password (A2)."""
    found = corpora.built(_documents(spark, sf_dir), lambda r: corpora.text_file(r, password=b"open sesame"), "doc_id")
    return text.document_text(reader.parse(found, ["page_text"], password="open sesame")).select(F.expr(_ID), "text")


@query("SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 3 WHEN doc_id % 3 = 1 THEN 0 ELSE 1 END AS status FROM documents")
def encryption_status(spark, sf_dir):
    """Files locked without a password (3), open (0), and with a wrong password (1)."""
    rows = _documents(spark, sf_dir)
    made = corpora.built(rows, lambda r: corpora.text_file(r, password=None if r["doc_id"] % 3 == 1 else b"secret"), "doc_id")
    locked = reader.parse(made.filter("cast(doc_key as bigint) % 3 < 2"), ["documents"])
    wrong = reader.parse(made.filter("cast(doc_key as bigint) % 3 = 2"), ["documents"], password="guess")
    d = F.get("documents", F.lit(0))
    return locked.union(wrong).select(F.expr(_ID), F.when(F.col("load_error").isNotNull(), 1).when(d.encrypted & ~d.decrypted, 3).otherwise(0).alias("status"))


@query(_PAGES + "SELECT doc_id, page_number, CAST((length(lower(text)) - length(replace(lower(text), 'an', ''))) // 2 AS BIGINT) AS n_matches FROM pages WHERE contains(lower(text), 'an')")
def find_text_counts(spark, sf_dir):
    """Matches by page."""
    return text.count_text(reader.table(_plain(spark, sf_dir), "page_text"), "An").select(F.expr(_ID), "page_number", "n_matches")


@query(_PAGES + ", n AS (SELECT doc_id, CAST((length(lower(text)) - length(replace(lower(text), 'tion', ''))) // 4 AS BIGINT) AS n FROM pages WHERE contains(lower(text), 'tion')) SELECT doc_id, CAST(sum(n) AS BIGINT) AS n_matches, count(*) AS n_pages FROM n GROUP BY doc_id")
def find_text_totals(spark, sf_dir):
    """Matches and pages with matches by document."""
    return text.find_totals(text.count_text(reader.table(_plain(spark, sf_dir), "page_text"), "tion")).select(F.expr(_ID), "n_matches", "n_pages")


@query(
    _PAGES + """, parts AS (SELECT doc_id, page_number, text, string_split(lower(text), 'the') AS parts FROM pages WHERE contains(lower(text), 'the')),
p AS (SELECT doc_id, page_number, text, i AS seq, CAST(length(array_to_string(parts[1:i], 'the')) AS BIGINT) AS pos FROM (SELECT *, unnest(range(1, len(parts))) AS i FROM parts)),
c AS (SELECT *, pos - coalesce(list_min(list_filter(range(0, 41), lambda m: m <= pos AND octet_length(encode(text[pos - m + 1:pos])) >= 40)), pos) AS a,
coalesce(list_min(list_filter(range(0, 41), lambda m: octet_length(encode(text[pos + 4:pos + 3 + m])) >= 40)), length(text) - pos - 3) + pos + 3 AS b FROM p)
SELECT doc_id, page_number, seq, (CASE WHEN a > 0 THEN '...' ELSE '' END) || trim(replace(text[a + 1:b], chr(10), ' ')) || (CASE WHEN b < length(text) THEN '...' ELSE '' END) AS snippet FROM c"""
)
def find_text_snippets(spark, sf_dir):
    """Every match with its context, to whole characters."""
    matches = reader.table(_plain(spark, sf_dir), "matches", options={"matches": {"pattern": "the"}})
    found = matches.select(F.expr(_ID), "page_number", F.posexplode("snippets").alias("at", "snippet"))
    return found.select("doc_id", "page_number", (F.col("at") + 1).alias("seq"), "snippet")


@query("SELECT doc_id, text FROM documents WHERE doc_id % 4 = 2")
def mapped_font_text(spark, sf_dir):
    """Text of composite fonts through their maps to Unicode."""
    found = _fonts(spark, sf_dir).filter("cast(doc_key as bigint) % 4 = 2")
    return text.document_text(reader.parse(found, ["page_text"])).select(F.expr(_ID), "text")


@query("SELECT doc_id, CAST(sum(length(replace(text, chr(10), ''))) AS BIGINT) AS total_codes, CAST(0 AS BIGINT) AS unmapped_codes FROM documents GROUP BY doc_id")
def coverage(spark, sf_dir):
    """Codes shown, and those without a character."""
    total = lambda c: F.aggregate("page_text", F.lit(0).cast("bigint"), lambda a, p: a + p[c]).alias(c)
    return reader.parse(_plain(spark, sf_dir), ["page_text"]).select(F.expr(_ID), total("total_codes"), total("unmapped_codes"))


@query(_PAGES + "SELECT operator, CAST(sum(n) AS BIGINT) AS n FROM (SELECT unnest(['BT', 'Tf', 'TL', 'Td', 'Tj', 'T*', 'ET']) AS operator, unnest([1, 1, 1, 1, len(string_split(text, chr(10))), len(string_split(text, chr(10))) - 1, 1]) AS n FROM pages) GROUP BY operator")
def operator_counts(spark, sf_dir):
    """Content operators of all pages (F1)."""
    return text.operator_list(reader.table(_plain(spark, sf_dir), "operations")).groupBy("operator").agg(F.count("*").alias("n"))


@query(_PAGES + "SELECT doc_id, page_number, 2 * length(regexp_replace(text, '[ -~\\s]', '', 'g')) > length(regexp_replace(text, '\\s', '', 'g')) AND length(regexp_replace(text, '\\s', '', 'g')) > 0 AS garbled FROM pages")
def garbled_pages(spark, sf_dir):
    """Pages whose text is mostly outside ASCII."""
    return reader.table(_plain(spark, sf_dir), "page_text").select(F.expr(_ID), "page_number", "garbled")


# Objects and counts.


@query(f"SELECT doc_id, {_N_PAGES} AS page_count, {_N_PAGES} * 2 + 4 AS object_count, '1.5' AS version FROM (SELECT doc_id, coalesce(text, '') AS text FROM documents)")
def document_overview(spark, sf_dir):
    """Version, objects and pages."""
    d = F.get("documents", F.lit(0))
    return reader.parse(_plain(spark, sf_dir), ["documents"]).select(F.expr(_ID), d.page_count.alias("page_count"), d.object_count.alias("object_count"), d.version.alias("version"))


@query(f"SELECT doc_id, {_N_PAGES} AS page_count, {_N_PAGES} * 2 + 4 AS object_count, {_N_PAGES} AS n_streams, CAST(0 AS INTEGER) AS error_count, CAST(0 AS INTEGER) AS n_bookmarks, CAST(0 AS INTEGER) AS status FROM (SELECT doc_id, coalesce(text, '') AS text FROM documents)")
def full_overview(spark, sf_dir):
    """Counts of every kind in one pass."""
    parsed = reader.parse(_plain(spark, sf_dir), ["documents", "objects", "issues", "bookmarks", "forms", "layers", "embedded"])
    return summary.overview(parsed).select(F.expr(_ID), "page_count", "object_count", "n_streams", "error_count", "n_bookmarks", "status")


@query(f"SELECT kind, type_label, CAST(sum(n) AS BIGINT) AS n FROM (SELECT unnest(['Dictionary', 'Dictionary', 'Dictionary', 'Dictionary', 'Dictionary', 'Stream']) AS kind, unnest(['Font', 'Pages', '-', 'Catalog', 'Page', '-']) AS type_label, unnest([1, 1, 1, 1, {_N_PAGES}, {_N_PAGES}]) AS n FROM (SELECT coalesce(text, '') AS text FROM documents)) GROUP BY ALL")
def object_listing(spark, sf_dir):
    """Objects by kind and type."""
    return objects.listing(reader.table(_plain(spark, sf_dir), "objects")).groupBy("kind", "type_label").agg(F.count("*").alias("n"))


@query(f"SELECT doc_id, unnest(['Dictionary', 'Stream']) AS kind, CAST(unnest([4 + {_N_PAGES}, {_N_PAGES}]) AS BIGINT) AS n FROM (SELECT doc_id, coalesce(text, '') AS text FROM documents)")
def object_type_counts(spark, sf_dir):
    """Objects by kind in each document."""
    return summary.type_counts(reader.parse(_plain(spark, sf_dir), ["objects"])).select(F.expr(_ID), "kind", "n")


_RAW = _PAGES + """, raw AS (SELECT doc_id, page_number, CAST(octet_length(encode(replace(replace(replace(text, '\\', '\\\\'), '(', '\\('), ')', '\\)'))) - length(regexp_replace(text, '[ -~\\n]', '', 'g'))
 - (len(string_split(text, chr(10))) - 1) + len(string_split(text, chr(10))) * 9 + 28 AS BIGINT) AS n FROM pages) """


@query(_RAW + "SELECT doc_id, count(*) AS n_streams, CAST(sum(n) AS BIGINT) AS raw_bytes, CAST(sum(n) AS BIGINT) AS decoded_bytes FROM raw GROUP BY doc_id")
def stream_totals(spark, sf_dir):
    """Streams and their bytes, raw and decoded."""
    found = reader.parse(_plain(spark, sf_dir), ["objects", "streams"])
    return summary.stream_totals(found).select(F.expr(_ID), "n_streams", "raw_bytes", "decoded_bytes")


@query(_RAW + "SELECT doc_id, CAST(rank AS INTEGER) AS rank, n AS raw_len FROM (SELECT doc_id, n, row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, page_number) AS rank FROM raw) WHERE rank <= 3")
def largest_streams(spark, sf_dir):
    """The three largest streams of each document."""
    return summary.largest_streams(reader.parse(_plain(spark, sf_dir), ["objects"])).select(F.expr(_ID), "rank", "raw_len")


@query("SELECT CASE doc_id % 6 WHEN 1 THEN 'FlateDecode' WHEN 2 THEN 'ASCII85Decode' WHEN 3 THEN 'ASCIIHexDecode' WHEN 4 THEN 'LZWDecode' ELSE 'RunLengthDecode' END AS filter, CAST(sum((len(string_split(coalesce(text, ''), chr(10))) + 7) // 8) AS BIGINT) AS n FROM documents WHERE doc_id % 6 > 0 GROUP BY 1")
def filter_counts(spark, sf_dir):
    """Filters by how often they are used."""
    return summary.filter_counts(reader.table(_filtered(spark, sf_dir), "objects"), by=[])


@query("SELECT doc_id, lang, source, 'Document ' || doc_id AS title FROM documents")
def metadata(spark, sf_dir):
    """Information and settings."""
    d = F.get("documents", F.lit(0))
    return reader.parse(_described(spark, sf_dir), ["documents"]).select(F.expr(_ID), d.settings["Lang"].alias("lang"), d.info["Author"].alias("source"), d.info["Title"].alias("title"))


@query("SELECT doc_id FROM documents WHERE lang = 'de'")
def search_key_value(spark, sf_dir):
    """Lang=DE finds catalogs by a key and its value, without regard to case."""
    found = reader.parse(_described(spark, sf_dir), ["objects", "entries"])
    return objects.search(found, "Type=Catalog,Lang=DE").select(F.expr(_ID))


@query("SELECT doc_id FROM documents WHERE contains(lower(source), 'src1')")
def search_value(spark, sf_dir):
    """key=Author,value=SRC1 finds information by part of a value."""
    found = reader.parse(_described(spark, sf_dir), ["objects", "entries"])
    return objects.search(found, "key=Author,value=SRC1").select(F.expr(_ID))


@query("SELECT doc_id FROM documents WHERE regexp_matches(source, '^src1[0-9]$')")
def search_regex(spark, sf_dir):
    """regex= over entries and streams (C17)."""
    found = reader.parse(_described(spark, sf_dir), ["objects", "entries", "streams"])
    return objects.search(found, "key=Author,regex=^src1[0-9]$").select(F.expr(_ID))


@query(_PAGES + "SELECT doc_id, count(*) AS n_streams FROM pages WHERE contains(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), 'license') GROUP BY doc_id")
def search_streams(spark, sf_dir):
    """stream=LICENSE finds content streams by their decoded bytes."""
    found = objects.search_files(_filtered(spark, sf_dir), "stream=LICENSE")
    return found.groupBy("doc_key").agg(F.count("*").alias("n_streams")).select(F.expr(_ID), "n_streams")


@query(f"SELECT doc_id, CAST(unnest([1, 3, 900000]) AS INTEGER) AS obj_num, unnest(['Dictionary', 'Dictionary', NULL]) AS kind, unnest([NULL, NULL, 'not found']) AS error FROM documents")
def object_lookup(spark, sf_dir):
    """Objects 1, 3 and 900000."""
    return objects.lookup(reader.parse(_plain(spark, sf_dir), ["values"]), "1,3,900000").select(F.expr(_ID), "obj_num", "kind", "error")


@query(_PAGES + "SELECT doc_id, page_number, '[0 0 612 792]' AS media_box, 1 AS content_streams FROM pages")
def page_list(spark, sf_dir):
    """Pages and their boxes."""
    return reader.table(_plain(spark, sf_dir), "pages").select(F.expr(_ID), "page_number", "media_box", "content_streams")


@query(f"SELECT doc_id, page_number, CASE WHEN page_number > n THEN 'page not found: ' || page_number END AS error FROM (SELECT doc_id, CAST(unnest([1, 2, 3]) AS INTEGER) AS page_number, (len(string_split(coalesce(text, ''), chr(10))) + 7) // 8 AS n FROM documents)")
def page_spec_errors(spark, sf_dir):
    """Pages 1 to 3, with errors for those a document lacks (C20)."""
    return objects.page_list(reader.parse(_plain(spark, sf_dir), ["pages"]), "1-3").select(F.expr(_ID), "page_number", "error")


@query("SELECT doc_id, 'Object 1 0 (Dictionary, /Font):' || chr(10) || '<<' || chr(10) || '    /Type /Font' || chr(10) || '    /Subtype /Type1' || chr(10) || '    /BaseFont /Helvetica' || chr(10) || '    /Encoding /WinAnsiEncoding' || chr(10) || '  >>' AS text FROM documents")
def object_dump(spark, sf_dir):
    """Object 1 as text."""
    return reader.table(_plain(spark, sf_dir), "dumps").filter("obj_num = 1").select(F.expr(_ID), "text")


@query(
    f"""SELECT doc_id, path, summary, CAST(n AS BIGINT) AS n FROM (SELECT doc_id, unnest(['/Root', '/Pages', '/Font/F1', '/Kids[i]', '/Parent', '/Contents', '/Resources']) AS path, unnest(['<< /Type /Catalog, 2 keys >>', '<< /Type /Pages, /Count=' || p || ', 3 keys >>',
'<< /Type /Font, /BaseFont=/Helvetica, /Subtype=/Type1, 4 keys >>', '<< /Type /Page, /MediaBox=[0 0 612 792], 5 keys >>', '<< /Type /Pages, /Count=' || p || ', 3 keys >>', '<< stream, N bytes >>', '<< 1 keys >>']) AS summary,
unnest([1, 1, 1, p, p, p, p]) AS n FROM (SELECT doc_id, {_N_PAGES} AS p FROM (SELECT doc_id, coalesce(text, '') AS text FROM documents)))"""
)
def dereferenced(spark, sf_dir):
    """References with what they point at, sizes aside."""
    found = objects.dereferenced(reader.parse(_plain(spark, sf_dir), ["refs", "objects"]))
    shown = found.select("doc_key", F.regexp_replace("path", r"\[\d+\]", "[i]").alias("path"), F.regexp_replace("summary", r"\d+ bytes", "N bytes").alias("summary"))
    return shown.groupBy("doc_key", "path", "summary").agg(F.count("*").alias("n")).select(F.expr(_ID), "path", "summary", "n")


@query(_PAGES + "SELECT doc_id, count(*) AS n_streams, CAST(sum(CASE WHEN regexp_matches(text, '[^\\x00-\\x7F]') THEN 1 ELSE 0 END) AS BIGINT) AS n_binary FROM pages GROUP BY doc_id")
def binary_streams(spark, sf_dir):
    """Streams whose decoded bytes are more than ASCII text."""
    return reader.table(_filtered(spark, sf_dir), "streams", options={"streams": {"held": False}}).groupBy("doc_key").agg(F.count("*").alias("n_streams"), F.sum(F.col("is_binary").cast("bigint")).alias("n_binary")).select(F.expr(_ID), "n_streams", "n_binary")


@query(
    """WITH d AS (SELECT item_id, lower(hex(encode(text))) AS h FROM benchmark), lines AS (SELECT item_id, i, h[i * 32 + 1:i * 32 + 32] AS x FROM (SELECT item_id, h, unnest(range(0, CAST((length(h) + 31) // 32 AS BIGINT))) AS i FROM d)),
shown AS (SELECT item_id, i, lower(lpad(to_base(i * 16, 16), 8, '0')) || '  ' || rpad(rtrim(regexp_replace(x[1:16], '(..)', '\\1 ', 'g')), 23, ' ') || '  ' || rpad(rtrim(regexp_replace(x[17:32], '(..)', '\\1 ', 'g')), 23, ' ') || '  |'
|| list_aggregate(list_transform(range(0, length(x) // 2), lambda k: CASE WHEN x[2 * k + 1:2 * k + 2] BETWEEN '20' AND '7e' THEN chr(CAST('0x' || x[2 * k + 1:2 * k + 2] AS INTEGER)) ELSE '.' END), 'string_agg', '') || '|' AS line FROM lines)
SELECT item_id, string_agg(line, chr(10) ORDER BY i) AS dump FROM shown GROUP BY item_id"""
)
def hex_dumps(spark, sf_dir):
    """Attachments as whole hex dumps."""
    found = corpora.built(_table(spark, sf_dir, "benchmark"), corpora.attachment_file, "item_id")
    return objects.hex_dumps(reader.table(found, "streams").filter("obj_num = 1")).select(F.col("doc_key").cast("bigint").alias("item_id"), F.rtrim("dump", F.lit("\n")).alias("dump"))


_FONT_JSON = '{"entries": {"BaseFont": {"type": "name", "value": "Helvetica"}, "Encoding": {"type": "name", "value": "WinAnsiEncoding"}, "Subtype": {"type": "name", "value": "Type1"}, "Type": {"type": "name", "value": "Font"}}, "type": "dictionary"}'


@query(f"SELECT doc_id, '{_FONT_JSON}' AS value FROM documents")
def object_json(spark, sf_dir):
    """Object 1 as JSON."""
    return objects.lookup(reader.parse(_plain(spark, sf_dir), ["values"]), "1").select(F.expr(_ID), "value")


@query(_PAGES + """SELECT doc_id, '{"crop_box":null,"page_number":' || page_number || '}' AS json FROM pages""")
def page_json(spark, sf_dir):
    """Rows as JSON, keys in order."""
    rows = reader.table(_plain(spark, sf_dir), "pages").select("doc_key", "page_number", F.lit(None).cast("string").alias("crop_box"))
    return sinks.as_json(rows).select(F.expr(_ID), F.col("json"))


@query("SELECT doc_id, CASE WHEN doc_id % 4 = 3 OR doc_id % 7 = 0 OR doc_id % 3 = 0 THEN 3 ELSE 0 END AS status FROM documents")
def exit_statuses(spark, sf_dir):
    """The status that each document leads to: errors or unreliable text."""
    made = corpora.built(_documents(spark, sf_dir), lambda r: corpora.text_file(r, kind="unmapped" if r["doc_id"] % 4 == 3 else "win", faults=True), "doc_id")
    return sinks.statuses(reader.parse(made, ["documents", "issues", "reliability"])).select(F.expr(_ID), "status")


# References.


@query(f"SELECT doc_id, CAST({_N_PAGES} AS BIGINT) * 4 + 3 AS n_references FROM (SELECT doc_id, coalesce(text, '') AS text FROM documents)")
def references(spark, sf_dir):
    """References of each document: kids, parents, contents, resources, font, tree and root."""
    return reader.parse(_plain(spark, sf_dir), ["refs"]).select(F.expr(_ID), F.size("refs").cast("bigint").alias("n_references"))


@query(_PAGES + "SELECT doc_id, count(*) AS n_sources FROM pages GROUP BY doc_id")
def reverse_references(spark, sf_dir):
    """Pages that refer to their shared resources, object 3."""
    found = reader.parse(_plain(spark, sf_dir), ["referrers"])
    return graph.reverse(found, 3).filter(F.array_contains("paths", "/Resources")).groupBy("doc_key").agg(F.count("*").alias("n_sources")).select(F.expr(_ID), "n_sources")


@query("SELECT doc_id, 999999 AS dst_num, '/Dangling' AS path FROM documents WHERE doc_id % 7 = 0")
def broken_references(spark, sf_dir):
    """References to objects that aren't there (D3, H1)."""
    found = reader.parse(_faulty(spark, sf_dir), ["refs"])
    return graph.broken(found).select(F.expr(_ID), "dst_num", "path")


@query("SELECT doc_id, CAST((doc_id % 5 = 0)::INT + (doc_id % 13 = 0)::INT AS BIGINT) AS n FROM documents WHERE doc_id % 5 = 0 OR doc_id % 13 = 0")
def unreachable_objects(spark, sf_dir):
    """Objects that the trailer doesn't lead to."""
    found = reader.parse(_faulty(spark, sf_dir), ["unreachable"])
    return graph.unreachable(found).groupBy("doc_key").agg(F.count("*").alias("n")).select(F.expr(_ID), "n")


@query(_PAGES + "SELECT doc_id, page_number FROM pages")
def font_pages(spark, sf_dir):
    """Pages that the font, object 1, is associated with."""
    found = reader.parse(_plain(spark, sf_dir), ["page_objects"])
    return graph.on_pages(found).filter("obj_num = 1").select(F.expr(_ID), "page_number")


@query(f"SELECT doc_id, coalesce(status, '-') AS status, CAST(n AS BIGINT) AS n FROM (SELECT doc_id, unnest(['visited', NULL]) AS status, unnest([2 * p - 1, 2 * p + 4]) AS n FROM (SELECT doc_id, {_N_PAGES} AS p FROM (SELECT doc_id, coalesce(text, '') AS text FROM documents)))")
def object_tree(spark, sf_dir):
    """The tree from the trailer: objects met first, and met again."""
    return _counted(reader.parse(_plain(spark, sf_dir), ["tree"]), "tree", "status")


@query(f"SELECT doc_id, role, CAST(n AS BIGINT) AS n FROM (SELECT doc_id, unnest(['Font', 'Page Tree', 'Generic', 'Catalog', 'Page']) AS role, unnest([1, 1, 1 + {_N_PAGES}, 1, {_N_PAGES}]) AS n FROM (SELECT doc_id, coalesce(text, '') AS text FROM documents))")
def object_roles(spark, sf_dir):
    """What each object is."""
    return _counted(reader.parse(_plain(spark, sf_dir), ["roles"]), "roles", "role")


@query(f"""SELECT doc_id, 'Page Tree' AS role, 'Object 2 is a page tree node.' AS description, p AS n_references, '/Kids[0] 5' AS first_reference, (4 + 2 * p) || ' /Pages|' || (SELECT string_agg((5 + 2 * i) || ' /Parent', '|' ORDER BY i) FROM (SELECT unnest(range(0, CAST(p AS BIGINT))) AS i)) AS referenced_by
FROM (SELECT doc_id, {_N_PAGES} AS p FROM (SELECT doc_id, coalesce(text, '') AS text FROM documents))""")
def inspect_object(spark, sf_dir):
    """Object 2 of each document, the page tree, what it refers to and what refers to it."""
    out = objects.inspect(_plain(spark, sf_dir), 2)
    into = F.array_sort("referenced_by", lambda a, b: F.when(a.path != b.path, F.when(a.path < b.path, -1).otherwise(1)).otherwise(a.src_num - b.src_num))
    first = F.get("references", F.lit(0))
    return out.select(
        F.expr(_ID), "role", "description", F.size("references").alias("n_references"), F.concat_ws(" ", first.path, first.dst_num).alias("first_reference"),
        F.array_join(F.transform(into, lambda r: F.concat_ws(" ", r.src_num, r.path)), "|").alias("referenced_by"),
    )


@query(f"SELECT doc_id, CAST({_N_PAGES} * 4 + 3 + 2 * {_N_PAGES} + 4 + 4 AS BIGINT) AS n_lines FROM (SELECT doc_id, coalesce(text, '') AS text FROM documents)")
def dot_lines(spark, sf_dir):
    """Lines of the GraphViz text: its frame, a line for each object and each reference."""
    return reader.parse(_plain(spark, sf_dir), ["dot"]).select(F.expr(_ID), F.size("dot").cast("bigint").alias("n_lines"))


# Validation and recovery.


@query(
    """SELECT doc_id, rule, level FROM (
SELECT doc_id, 'broken_references' AS rule, 'error' AS level FROM documents WHERE doc_id % 7 = 0
UNION ALL SELECT doc_id, 'unreachable', 'warn' FROM documents WHERE doc_id % 5 = 0
UNION ALL SELECT doc_id, 'unreachable', 'warn' FROM documents WHERE doc_id % 13 = 0
UNION ALL SELECT doc_id, 'page_count', 'error' FROM documents WHERE doc_id % 3 = 0
UNION ALL SELECT doc_id, 'generations', 'info' FROM documents WHERE doc_id % 13 = 0)"""
)
def validation_issues(spark, sf_dir):
    """Findings in damaged files."""
    return reader.table(_faulty(spark, sf_dir), "issues").select(F.expr(_ID), "rule", "level")


@query(
    """SELECT doc_id, CAST((doc_id % 7 = 0)::INT + (doc_id % 3 = 0)::INT AS BIGINT) AS error_count, CAST((doc_id % 5 = 0)::INT + (doc_id % 13 = 0)::INT AS BIGINT) AS warning_count,
CAST((doc_id % 13 = 0)::INT AS BIGINT) AS info_count, CASE WHEN doc_id % 7 = 0 OR doc_id % 3 = 0 THEN 3 ELSE 0 END AS status FROM documents WHERE doc_id % 7 = 0 OR doc_id % 3 = 0 OR doc_id % 5 = 0 OR doc_id % 13 = 0"""
)
def validation_counts(spark, sf_dir):
    """Findings by level, and the status they lead to."""
    return summary.severities(reader.table(_faulty(spark, sf_dir), "issues")).select(F.expr(_ID), "error_count", "warning_count", "info_count", "status")


@query("SELECT doc_id, 1 AS obj_num, '0,1' AS gens FROM documents WHERE doc_id % 13 = 0")
def duplicate_generations(spark, sf_dir):
    """Object numbers with several generations."""
    return summary.duplicate_generations(reader.parse(_faulty(spark, sf_dir), ["generations"])).select(F.expr(_ID), "obj_num", F.array_join(F.transform("gens", lambda g: g.cast("string")), ",").alias("gens"))


@query(_RAW + "SELECT doc_id, n + 7 AS declared_length, n AS actual_length FROM raw WHERE doc_id % 11 = 0 AND page_number = 1")
def recovered_streams(spark, sf_dir):
    """Streams whose length was wrong."""
    return structure.recovered(reader.table(_faulty(spark, sf_dir), "documents")).select(F.expr(_ID), "declared_length", "actual_length")


@query("SELECT doc_id, text FROM documents")
def recovered_text(spark, sf_dir):
    """Text of files with repaired streams."""
    found = _faulty(spark, sf_dir)
    return text.document_text(reader.parse(found, ["page_text"])).select(F.expr(_ID), "text")


@query(_PAGES + "SELECT doc_id, page_number, CASE WHEN doc_id % 11 = 0 AND page_number = 1 THEN '' ELSE text END AS text FROM pages")
def strict_text(spark, sf_dir):
    """Text without repair: the damaged page is empty."""
    return reader.table(_faulty(spark, sf_dir), "page_text", recovery="strict").select(F.expr(_ID), "page_number", "text")


@query("SELECT doc_id, 'no PDF header' AS load_error FROM documents")
def load_errors(spark, sf_dir):
    """Files that aren't PDF files keep their row, with an error (A1)."""
    rows = _documents(spark, sf_dir).select(F.col("doc_id").cast("string").alias("doc_key"), F.encode(F.concat(F.lit("x"), F.col("text")), "UTF-8").alias("content"))
    return reader.parse(rows, ["documents"]).select(F.expr(_ID), "load_error")


# Structure.


@query("SELECT p_partkey, CAST(p_size AS BIGINT) AS width, CAST(2 * p_size AS BIGINT) AS height, 'DeviceGray' AS color_space, CAST(p_size AS BIGINT) AS size FROM part")
def images(spark, sf_dir):
    """Images (G3)."""
    found = corpora.built(_table(spark, sf_dir, "part").select("p_partkey", "p_size"), corpora.part_file, "p_partkey")
    return reader.table(found, "images").select(F.col("doc_key").cast("bigint").alias("p_partkey"), "width", "height", "color_space", "size")


@query("SELECT p_partkey, '/Im1' AS name, 'Image, ' || p_size || 'x' || 2 * p_size AS detail FROM part")
def page_resources(spark, sf_dir):
    """What pages name in their resources."""
    found = corpora.built(_table(spark, sf_dir, "part").select("p_partkey", "p_size"), corpora.part_file, "p_partkey")
    return reader.table(found, "resources").select(F.col("doc_key").cast("bigint").alias("p_partkey"), "name", "detail")


@query("""SELECT c_custkey, 'c.' || c_custkey AS name, 'Tx' AS field_type, '"' || c_name || '"' AS value, CAST(2 AS BIGINT) AS flags, 1 AS page_number FROM customer""")
def form_fields(spark, sf_dir):
    """Form fields."""
    found = corpora.built(_table(spark, sf_dir, "customer").select("c_custkey", "c_name"), corpora.customer_file, "c_custkey")
    return reader.table(found, "forms").select(F.col("doc_key").cast("bigint").alias("c_custkey"), "name", "field_type", "value", "flags", "page_number")


@query("SELECT page_id, 'URI' AS link_type, url AS target, '[10 20 110 40]' AS rect FROM pages")
def link_annotations(spark, sf_dir):
    """Links and where they lead."""
    found = corpora.built(_table(spark, sf_dir, "pages").select("page_id", "url"), corpora.link_file, "page_id")
    return reader.table(found, "annotations").select(F.col("doc_key").cast("bigint").alias("page_id"), "link_type", "target", "rect")


@query("SELECT page_id, 1 AS page_number, 'Link' AS subtype, CAST(1 AS BIGINT) AS n FROM pages")
def annotation_counts(spark, sf_dir):
    """Annotations by page and subtype."""
    found = corpora.built(_table(spark, sf_dir, "pages").select("page_id", "url"), corpora.link_file, "page_id")
    return text.annotation_counts(reader.table(found, "annotations")).select(F.col("doc_key").cast("bigint").alias("page_id"), "page_number", "subtype", "n")


@query(
    """SELECT conv_id, turn, unnest([0, 1, 2]) AS depth, unnest(['Document', role, 'Span']) AS role, CAST(unnest([NULL, turn, 7]) AS BIGINT) AS mcid, unnest([NULL, 'turn ' || turn, NULL]) AS title, unnest([NULL, NULL, CAST(length(coalesce(text, '')) AS VARCHAR)]) AS alt,
CAST(unnest([NULL, 1, NULL]) AS INTEGER) AS page_number FROM conversations"""
)
def structure_tags(spark, sf_dir):
    """Tags of the structure tree: a file for each turn."""
    turns = _table(spark, sf_dir, "conversations").select(F.concat_ws("-", "conv_id", "turn").alias("key"), "turn", "role", F.length(F.coalesce("text", F.lit(""))).alias("n_chars"))
    found = reader.table(corpora.built(turns, corpora.turn_file, "key"), "tags")
    key = F.split("doc_key", "-")
    return found.select(key[0].cast("bigint").alias("conv_id"), key[1].cast("bigint").alias("turn"), "depth", "role", "mcid", "title", "alt", "page_number")


@query(
    """SELECT doc_id, CAST(p AS INTEGER) AS page_number, CASE WHEN p <= 3 THEN ['i', 'ii', 'iii'][p] WHEN p <= 6 THEN 'p-' || (CASE WHEN doc_id % 30 + p - 3 > 26 THEN 'A' || chr(CAST(64 + doc_id % 30 + p - 3 - 26 AS INTEGER)) ELSE chr(CAST(64 + doc_id % 30 + p - 3 AS INTEGER)) END)
ELSE CAST(doc_id + p - 7 AS VARCHAR) END AS label FROM documents, (SELECT unnest([1, 2, 3, 4, 5, 6, 7, 8, 9, 10]) AS p)"""
)
def page_labels(spark, sf_dir):
    """Labels of pages by an as-of join with label ranges."""
    found = corpora.built(_table(spark, sf_dir, "documents").select("doc_id"), corpora.label_file, "doc_id")
    parsed = reader.parse(found, ["pages", "label_ranges"])
    return structure.page_labels(parsed).select(F.expr(_ID), "page_number", "label")


@query("SELECT doc_id, name, CASE WHEN v = 1 THEN 'ON' ELSE 'OFF' END AS state FROM (SELECT doc_id, unnest(['quality', 'toxic']) AS name, unnest([quality, toxic]) AS v FROM labels)")
def layers(spark, sf_dir):
    """Layers and whether they are on."""
    found = corpora.built(_table(spark, sf_dir, "labels"), corpora.layer_file, "doc_id")
    return reader.table(found, "layers").select(F.expr(_ID), "name", "state")


@query("SELECT item_id, 'item-' || item_id || '.txt' AS filename, 'text/plain' AS mime, CAST(octet_length(encode(text)) AS BIGINT) AS size FROM benchmark")
def embedded_files(spark, sf_dir):
    """Attachments."""
    found = corpora.built(_table(spark, sf_dir, "benchmark"), corpora.attachment_file, "item_id")
    return reader.table(found, "embedded").select(F.col("doc_key").cast("bigint").alias("item_id"), "filename", "mime", "size")


@query("SELECT item_id, text FROM benchmark")
def extracted_attachments(spark, sf_dir):
    """Bytes of attachments."""
    found = reader.parse(corpora.built(_table(spark, sf_dir, "benchmark"), corpora.attachment_file, "item_id"), ["streams"])
    return objects.extract(reader.part(found, "streams"), 1).select(F.col("doc_key").cast("bigint").alias("item_id"), F.decode("data", "UTF-8").alias("text"))


@query(
    """SELECT c_custkey, unnest([1, 2, 3, 4]) AS node_id, unnest([0, 1, 2, 0]) AS parent_id, unnest([0, 1, 2, 0]) AS depth, unnest([r_name, n_name, c_name, c_mktsegment]) AS title
FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey"""
)
def bookmarks(spark, sf_dir):
    """The outline of a file for each customer: region, nation below it, customer below that, then the segment."""
    nations = _table(spark, sf_dir, "nation").join(_table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    rows = _table(spark, sf_dir, "customer").join(nations, F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey", "c_name", "c_mktsegment", "n_name", "r_name")
    found = reader.table(corpora.built(rows, corpora.outline_file, "c_custkey"), "bookmarks")
    return found.select(F.col("doc_key").cast("bigint").alias("c_custkey"), "node_id", "parent_id", "depth", "title")


@query("""SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN 'Helvetica' WHEN 1 THEN 'Times-Roman' ELSE 'Sample' END AS base_font, CASE WHEN doc_id % 4 < 2 THEN 'Type1' ELSE 'Type0' END AS subtype,
CASE doc_id % 4 WHEN 0 THEN 'WinAnsiEncoding' WHEN 1 THEN '-' ELSE 'Identity-H' END AS encoding, doc_id % 4 = 2 AS has_map, CASE WHEN doc_id % 4 > 1 THEN 'Adobe-Identity-0' END AS cid_system_info FROM documents""")
def fonts(spark, sf_dir):
    """Fonts (G1, G2)."""
    found = reader.table(_fonts(spark, sf_dir), "fonts").filter("subtype <> 'CIDFontType2'")
    return found.select(F.expr(_ID), "base_font", "subtype", "encoding", F.col("to_unicode").isNotNull().alias("has_map"), "cid_system_info")


@query("""SELECT doc_id, name, (p >> bit) & 1 = 1 AS allowed FROM (SELECT doc_id, CAST(4294967296 - (doc_id * 2654435 % 4000 + 1) AS BIGINT) AS p, unnest(['Print', 'Modify', 'Copy/extract text', 'Annotate', 'Fill forms', 'Accessibility extract', 'Assemble', 'Print high quality']) AS name, unnest([2, 3, 4, 5, 8, 9, 10, 11]) AS bit FROM documents)""")
def permissions(spark, sf_dir):
    """Permission bits of a negative 32-bit number."""
    p = -(F.col("doc_id") * 2654435 % 4000 + 1)
    return _table(spark, sf_dir, "documents").select("doc_id", F.explode(structure.permissions(p)).alias("name", "allowed"))


@query("SELECT doc_id, 'RC4, 40-bit' AS algorithm, CAST(1 AS INTEGER) AS v, CAST(2 AS INTEGER) AS r FROM documents")
def security(spark, sf_dir):
    """How files are encrypted."""
    found = corpora.built(_documents(spark, sf_dir), lambda r: corpora.text_file(r, password=b""), "doc_id")
    s = F.get("documents", F.lit(0)).security
    return reader.parse(found, ["documents"]).select(F.expr(_ID), s.algorithm.alias("algorithm"), s.version.alias("v"), s.revision.alias("r"))


@query(
    _PAGES + """, g AS (SELECT *, 2 * length(regexp_replace(text, '[ -~\\s]', '', 'g')) > length(regexp_replace(text, '\\s', '', 'g')) AS garbled FROM pages)
SELECT doc_id, page_number, '[0 0 612 792]' AS media_box, NOT garbled AS text_extractable, CASE WHEN garbled THEN '(text not extractable \u2014 fonts lack Unicode mappings)' WHEN octet_length(encode(text)) > 200 THEN trim(substring(text, 1, 200), ' ' || chr(9) || chr(10) || chr(13) || chr(160)) || '...' ELSE trim(text, ' ' || chr(9) || chr(10) || chr(13) || chr(160)) END AS text_preview,
'Helvetica' AS fonts, 0 AS n_annotations, 0 AS n_images FROM g"""
)
def page_info(spark, sf_dir):
    """A page's boxes, counts, fonts and the beginning of its text."""
    out = text.page_info(reader.parse(_plain(spark, sf_dir), ["page_info"]))
    return out.select(F.expr(_ID), "page_number", "media_box", "text_extractable", "text_preview", F.array_join("fonts", ",").alias("fonts"), "n_annotations", "n_images")


from . import cases  # noqa: E402, F401  registers its queries
