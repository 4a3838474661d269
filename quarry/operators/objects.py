"""Objects: listing, lookup by number, search, dumps."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from ..functions import codecs
from ..sources import reader

#: Letters that a search folds: ASCII only.
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


class SpecError(ValueError):
    pass


def parse_object_spec(spec: str) -> list[int]:
    """Numbers and closed ranges between commas, sorted, each once."""
    out: set[int] = set()
    for piece in spec.split(","):
        m = re.fullmatch(r"\s*(\d+)\s*(?:-\s*(\d+)\s*)?", piece)
        if not m:
            raise SpecError(f"not an object number or range: {piece!r}")
        first, last = int(m[1]), int(m[2] or m[1])
        if first > last:
            raise SpecError(f"the range {piece.strip()} runs backwards")
        out.update(range(first, last + 1))
    return sorted(out)


def parse_page_spec(spec: str) -> tuple[int, int | None]:
    """N, N-M or N- as first and last page; None for an open end."""
    m = re.fullmatch(r"\s*(\d+)\s*(-\s*(\d+)?\s*)?", spec)
    if not m:
        raise SpecError(f"not a page or range: {spec!r}")
    first = int(m[1])
    last = first if m[2] is None else int(m[3]) if m[3] else None
    if first < 1 or last is not None and last < first:
        raise SpecError(f"pages count from 1 and ranges run forwards: {spec!r}")
    return first, last


def in_pages(spec: str | None, column: str = "page_number") -> Column:
    """The condition that a page is in the spec; all pages without one."""
    if spec is None:
        return F.lit(True)
    first, last = parse_page_spec(spec)
    return F.col(column) >= first if last is None else F.col(column).between(first, last)


def page_list(parsed: DataFrame, spec: str) -> DataFrame:
    """doc_key, page_number, obj_num, and an error for each page of a closed spec that a document lacks, or for a document
    with no page of an open one. From part pages."""
    first, last = parse_page_spec(spec)
    if last is None:
        wanted = parsed.select("doc_key", F.explode_outer(F.filter("pages", lambda p: p.page_number >= first)).alias("p")).select("doc_key", "p.page_number", "p.obj_num")
        return wanted.withColumn("error", F.when(F.col("obj_num").isNull(), F.lit(f"no pages from {first} on")))
    wanted = parsed.select("doc_key", "pages", F.explode(F.sequence(F.lit(first), F.lit(last))).alias("page_number"))
    found = F.get(F.filter("pages", lambda p: p.page_number == F.col("page_number")), F.lit(0))
    out = wanted.select("doc_key", "page_number", found.obj_num.alias("obj_num"))
    return out.withColumn("error", F.when(F.col("obj_num").isNull(), F.concat(F.lit("page not found: "), F.col("page_number").cast("string"))))


def listing(objects: DataFrame) -> DataFrame:
    return objects.select("doc_key", "obj_num", "gen", "kind", F.coalesce("type_label", F.lit("-")).alias("type_label"), "detail")


def lookup(parsed: DataFrame, spec: str) -> DataFrame:
    """The objects of a spec (generation 0) as JSON; error where a document has none of that number. From part values."""
    numbers = F.array(*[F.lit(n) for n in parse_object_spec(spec)])
    # One row for each document and number of the spec is the result.
    wanted = parsed.select("doc_key", "values", F.explode(numbers).alias("obj_num"))
    v = F.get(F.filter("values", lambda v: (v.obj_num == F.col("obj_num")) & (v.gen == 0)), F.lit(0))
    out = wanted.select("doc_key", "obj_num", v.kind.alias("kind"), v.value.alias("value"))
    return out.withColumn("error", F.when(F.col("value").isNull(), F.lit("not found")))


def lookup_json(parsed: DataFrame, spec: str) -> DataFrame:
    """doc_key, json: the object of a spec of one number as one JSON object; of several as {"objects": [...]}, with an error in
    place of those that a document lacks. From part values."""
    numbers = parse_object_spec(spec)

    def found(n: int, lost: str) -> Column:
        v = F.get(F.filter("values", lambda v: (v.obj_num == n) & (v.gen == 0)), F.lit(0)).value
        return F.when(v.isNotNull(), F.concat(F.lit('{"generation": 0, "object": '), v, F.lit(f', "object_number": {n}}}'))).otherwise(F.lit(lost))

    if len(numbers) == 1:
        return parsed.select("doc_key", found(numbers[0], f'{{"error": "Object {numbers[0]} not found."}}').alias("json"))
    items = [found(n, f'{{"error": "not found", "generation": 0, "object_number": {n}}}') for n in numbers]
    return parsed.select("doc_key", F.concat(F.lit('{"objects": ['), F.concat_ws(", ", *items), F.lit("]}")).alias("json"))


def dereferenced(parsed: DataFrame) -> DataFrame:
    """Each reference with one line on what it points at, from parts refs and objects: a look-up in the document's row."""
    def key(num, gen):
        return num.cast("bigint") * 65536 + gen

    known = F.map_from_arrays(F.transform("objects", lambda o: key(o.obj_num, o.gen)), F.transform("objects", lambda o: o.summary))
    flat = parsed.select("doc_key", known.alias("known"), F.explode("refs").alias("r"))
    said = F.try_element_at("known", key(F.col("r.dst_num"), F.col("r.dst_gen")))
    return flat.select("doc_key", "r.src_num", "r.src_gen", "r.ord", "r.path", "r.dst_num", "r.dst_gen", said.alias("summary"))


def content(streams: DataFrame, raw: bool = False, as_hex: bool = False, truncate: int | None = None) -> DataFrame:
    """Stream contents as text, as a hex dump, or cut: only binary data is cut or dumped."""
    data = F.col("raw" if raw else "data")
    dump = F.udf(lambda b: codecs.hex_dump(bytes(b)), StringType(), useArrow=True)
    # Whether the bytes shown are binary; raw bytes are judged anew.
    binary = F.udf(lambda b: codecs.is_binary(bytes(b)), "boolean", useArrow=True)(data) if raw else F.col("is_binary")
    cut = data if truncate is None else F.substring(data, 1, truncate)
    shown = F.when(~F.col("binary"), data.cast("string"))
    out = streams.withColumn("binary", binary).select(
        "doc_key", "obj_num", "gen", F.col("binary").alias("is_binary"), "warning", F.length(data).alias("size"), shown.alias("content"),
        F.when(F.col("binary"), dump(cut) if as_hex else F.lit(None).cast("string")).alias("content_hex"), F.when(F.col("binary"), cut).alias("content_bytes"),
        (F.col("binary") & (F.length(data) > F.lit(truncate if truncate is not None else 1 << 40))).alias("truncated"),
    )
    return out


def hex_dumps(streams: DataFrame) -> DataFrame:
    """Each stream's decoded bytes, sixteen to a line."""
    dump = F.udf(lambda b: codecs.hex_dump(bytes(b)), StringType(), useArrow=True)
    return streams.select("doc_key", "obj_num", "gen", dump("data").alias("dump"))


def _folded(c: Column) -> Column:
    return F.translate(c, _UPPER, _LOWER)


def parse_search(expression: str) -> list[tuple[str, str, str]]:
    """Conditions between commas, all of which must hold: (kind, key, value)."""
    out = []
    for piece in expression.split(","):
        left, eq, right = piece.strip().partition("=")
        if not eq or not left or not right:
            raise SpecError(f"not a condition: {piece!r}")
        kind = left.lower()
        out.append((kind, "", right) if kind in ("key", "value", "stream", "regex") else ("equals", left, right))
    return out


def search_parts(expression: str) -> list[str]:
    """The parts that search() needs for an expression: streams only for conditions on their content."""
    kinds = {k for k, _, _ in parse_search(expression)}
    return ["objects", "entries", *(["streams"] if kinds & {"stream", "regex"} else [])]


def search_files(found: DataFrame, expression: str, **options) -> DataFrame:
    """search() of files, parsed for it: what streams hold is asked where they are decoded, and their bytes stay there."""
    conditions = parse_search(expression)
    sought = tuple(v for k, _, v in conditions if k == "stream")
    kinds = {k for k, _, _ in conditions}
    parts = ["objects", *(["entries"] if kinds - {"stream"} else []), *(["stream_matches"] if sought else []), *(["streams"] if "regex" in kinds else [])]
    return search(reader.parse(found, parts, options={"stream_matches": {"sought": sought}} if sought else None, **options), expression, matched=True)


def search(parsed: DataFrame, expression: str, matched: bool = False) -> DataFrame:
    """The dictionaries and streams that meet every condition, as listing() shows them.

    Each condition gives the numbers of a document's objects that meet it, and those of all conditions are intersected in
    the document's row: nothing is shuffled. matched: part stream_matches, made for this expression, stands for the streams' bytes.
    """

    def named(e):
        return e.vkind.isin("Name", "String")

    def met(kind: str, name: str, value: str) -> Column:
        low = F.lit(value.translate(str.maketrans(_UPPER, _LOWER)))
        if kind == "equals":
            rows = F.filter("entries", lambda e: (e.key == name) & named(e) & (_folded(e.vtext) == low))
        elif kind == "key":
            rows = F.filter("entries", lambda e: e.key == value)
        elif kind == "value":
            rows = F.filter("entries", lambda e: named(e) & F.contains(_folded(e.vtext), low))
        elif kind == "stream" and matched:
            at = [v for k, _, v in conditions if k == "stream"].index(value)
            rows = F.filter("stream_matches", lambda s: s["at"] == at)
        elif kind == "stream":
            raw = F.lit(value.encode().decode("latin-1").translate(str.maketrans(_UPPER, _LOWER)))
            rows = F.filter("streams", lambda s: F.contains(_folded(F.decode(s.data, "ISO-8859-1")), raw))
        else:
            own = F.filter("entries", lambda e: named(e) & e.vtext.rlike(value))
            held = F.filter("streams", lambda s: F.is_valid_utf8(s.data.cast("string")) & s.data.cast("string").rlike(value))
            return F.array_union(_ids(own), _ids(held))
        return F.array_distinct(_ids(rows))

    conditions = parse_search(expression)
    found = met(*conditions[0])
    for c in conditions[1:]:
        found = F.array_intersect(found, met(*c))
    # Numbers first: rows of objects are made only for documents with some.
    hits = parsed.select("doc_key", "objects", found.alias("hits")).filter(F.size("hits") > 0)
    kept = F.filter("objects", lambda o: o.kind.isin("Dictionary", "Stream") & F.array_contains("hits", F.struct(o.obj_num.alias("num"), o.gen.alias("gen"))))
    return listing(hits.select("doc_key", F.inline(kept)))


def _ids(rows) -> Column:
    return F.transform(rows, lambda o: F.struct(o.obj_num.alias("num"), o.gen.alias("gen")))


def extract(streams: DataFrame, obj_num: int) -> DataFrame:
    """Decoded bytes of one object's stream in each document, for a binary sink."""
    return streams.filter((F.col("obj_num") == obj_num) & (F.col("gen") == 0)).select("doc_key", "obj_num", "data", "warning")


def inspect(found: DataFrame, obj_num: int) -> DataFrame:
    """One object of each document: its role, value, references both ways, and pages it belongs to."""
    parsed = reader.parse(found, ["values", "roles", "refs"], options={p: {"only": obj_num} for p in ("values", "roles", "refs")})
    held = parsed.select(
        "doc_key", F.get(F.filter("values", lambda v: (v.obj_num == obj_num) & (v.gen == 0)), F.lit(0)).alias("v"), F.get(F.filter("roles", lambda v: (v.obj_num == obj_num) & (v.gen == 0)), F.lit(0)).alias("r"),
        F.filter("refs", lambda r: (r.src_num == obj_num) & (r.src_gen == 0)).alias("out"), F.filter("refs", lambda r: (r.dst_num == obj_num) & r.src_num.isNotNull()).alias("into"),
    )
    return held.select(
        "doc_key", F.lit(obj_num).alias("obj_num"), F.col("r.role").alias("role"), F.col("r.description").alias("description"), F.col("r.details").alias("details"), F.col("v.value").alias("value"),
        F.transform("out", lambda r: F.struct(r.path.alias("path"), r.dst_num.alias("dst_num"))).alias("references"),
        F.transform("into", lambda r: F.struct(r.src_num.alias("src_num"), r.path.alias("path"))).alias("referenced_by"), F.when(F.col("v.value").isNull(), F.lit("not found")).alias("error"),
    )
