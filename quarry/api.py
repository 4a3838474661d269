"""A corpus of PDF files: every mode of inspection as a method that returns a DataFrame, and as a view for SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators import graph, objects, sinks, structure, summary, text
from .sources import reader

#: Modes that can be asked for together, in the order in which they come out, and their titles.
DOCUMENT_MODES = {
    "list": "Objects", "validate": "Validation", "fonts": "Fonts", "images": "Images", "forms": "Form fields", "bookmarks": "Bookmarks", "annotations": "Annotations", "text": "Text",
    "operators": "Content operators", "tags": "Structure", "tree": "Object tree", "find_text": "Matches", "labels": "Page labels", "layers": "Layers", "embedded": "Embedded files", "security": "Security",
}
#: The parts whose rows a mode shows, where they aren't called as it is; the first are those that come out.
MODE_PARTS = {"list": ("objects",), "validate": ("issues",), "text": ("page_text",), "operators": ("operations",), "find_text": ("matches",), "labels": ("label_ranges", "pages"), "security": ("documents",)}
#: Modes that a page filter narrows.
PAGE_MODES = ("annotations", "text", "operators", "find_text", "labels")
STANDALONE_MODES = ("object", "inspect", "search", "extract")


class Corpus:
    """Files of a folder, or a DataFrame with doc_key and content.

    Each method parses what it needs. ``saved`` parses all parts once and writes them; later methods read columns of that.
    """

    def __init__(self, spark: SparkSession, source: str | DataFrame, password: str | None = None, recovery: str = "lenient"):
        self.spark, self.options = spark, {"password": password, "recovery": recovery}
        self.files = reader.files(spark, source) if isinstance(source, str) else source
        self.held: DataFrame | None = None

    def saved(self, path: str, parts: list[str] | None = None) -> Corpus:
        reader.parse(self.files, parts or list(reader.PARTS), **self.options).write.mode("overwrite").parquet(path)
        self.held = self.spark.read.parquet(path)
        return self

    def parsed(self, *parts: str) -> DataFrame:
        if self.held is not None and set(parts) <= set(self.held.columns):
            return self.held.select("doc_key", "load_error", *parts)
        return reader.parse(self.files, list(parts), **self.options)

    def table(self, name: str) -> DataFrame:
        return reader.part(self.parsed(name), name)

    def tables(self, *names: str) -> list[DataFrame]:
        found = self.parsed(*names)
        return [reader.part(found, n) for n in names]

    def register_views(self, prefix: str = "pdf_") -> None:
        """A temporary view for each part, for plain SQL."""
        for name in reader.PARTS:
            self.table(name).createOrReplaceTempView(prefix + name)

    # Modes.

    def overview(self) -> DataFrame:
        return summary.overview(self.parsed("documents", "objects", "issues", "bookmarks", "forms", "layers", "embedded"))

    def listing(self) -> DataFrame:
        return objects.listing(self.table("objects"))

    def object(self, spec: str) -> DataFrame:
        return objects.lookup(self.parsed("values"), spec)

    def content(self, **options) -> DataFrame:
        return objects.content(self.table("streams"), **options)

    def inspect(self, obj_num: int) -> DataFrame:
        return objects.inspect(self.files, obj_num)

    def search(self, expression: str) -> DataFrame:
        if self.held is None:
            return objects.search_files(self.files, expression, **self.options)
        return objects.search(self.parsed(*objects.search_parts(expression)), expression)

    def extract(self, obj_num: int) -> DataFrame:
        return objects.extract(self.table("streams"), obj_num)

    def text(self, pages: str | None = None) -> DataFrame:
        return text.page_text(self.table("page_text"), pages)

    def find_text(self, pattern: str, pages: str | None = None) -> DataFrame:
        return text.find_text(self.table("page_text"), pattern, pages)

    def operators(self, pages: str | None = None) -> DataFrame:
        return text.operator_list(self.table("operations"), pages)

    def page_info(self, pages: str | None = None) -> DataFrame:
        return text.page_info(self.parsed("page_info")).filter(objects.in_pages(pages))

    def reliability(self) -> DataFrame:
        return self.table("reliability")

    def validate(self) -> DataFrame:
        return self.table("issues")

    def references(self, obj_num: int | None = None) -> DataFrame:
        refs = self.table("refs")
        return refs if obj_num is None else graph.forward(refs, obj_num)

    def reverse_references(self, obj_num: int | None = None) -> DataFrame:
        return graph.reverse(self.parsed("referrers"), obj_num)

    def tree(self, max_depth: int | None = None) -> DataFrame:
        if max_depth is None:
            return self.table("tree")
        return reader.table(self.files, "tree", options={"tree": {"max_depth": max_depth}}, **self.options)

    def page_labels(self) -> DataFrame:
        return structure.page_labels(self.parsed("pages", "label_ranges"))

    def broken_references(self) -> DataFrame:
        return graph.broken(self.parsed("refs"))

    def unreachable(self) -> DataFrame:
        return graph.unreachable(self.parsed("unreachable"))

    def document_text(self) -> DataFrame:
        return text.document_text(self.parsed("page_text"))

    def combined(self, *modes: str, pattern: str | None = None) -> dict[str, DataFrame]:
        """Several modes at once, in the fixed order of DOCUMENT_MODES whatever the order asked for."""
        if alone := [m for m in modes if m in STANDALONE_MODES]:
            raise ValueError(f"{alone[0]} stands alone")
        if unknown := set(modes) - set(DOCUMENT_MODES):
            raise ValueError(f"no such mode: {sorted(unknown)[0]}")
        own = {
            "list": self.listing, "validate": self.validate, "text": self.text, "operators": self.operators, "tree": self.tree, "labels": self.page_labels,
            "find_text": lambda: self.find_text(pattern or ""), "security": lambda: self.table("documents").select("doc_key", "security.*"),
        }
        return {m: own[m]() if m in own else self.table(m) for m in DOCUMENT_MODES if m in modes}

    def _mode_columns(self, modes: tuple[str, ...], pattern: str | None, pages: str | None) -> tuple[DataFrame, dict[str, Column]]:
        """One parse with all that modes need, and each mode's rows as a column of it."""
        if alone := [m for m in modes if m in STANDALONE_MODES]:
            raise ValueError(f"{alone[0]} stands alone")
        if unknown := set(modes) - set(DOCUMENT_MODES):
            raise ValueError(f"no such mode: {sorted(unknown)[0]}")
        parts = {m: MODE_PARTS.get(m, (m,)) for m in DOCUMENT_MODES if m in modes}
        needed = list(dict.fromkeys(["documents", *(p for ps in parts.values() for p in ps)]))
        options = {"matches": {"pattern": pattern or ""}} if "find_text" in modes else {}
        found = self.parsed(*needed) if not options else reader.parse(self.files, needed, options=options, **self.options)
        columns = {}
        for m, ps in parts.items():
            rows = F.col(ps[0])
            if m == "labels":
                rows = F.when(F.size("label_ranges") > 0, F.transform("pages", lambda p: structure.label_of(p.page_number.cast("bigint"), structure.range_of(p.page_number, F.col("label_ranges"))))).otherwise(F.array())
            if m == "security":
                rows = F.get("documents", F.lit(0)).security
            elif pages is not None and m in PAGE_MODES:
                first, last = objects.parse_page_spec(pages)
                rows = F.filter(rows, lambda r: (r.page_number >= first) & (F.lit(last is None) | (r.page_number <= (last or 0))))
            columns[m] = rows
        return found, columns

    def combined_json(self, *modes: str, pattern: str | None = None, pages: str | None = None) -> DataFrame:
        """doc_key, json: what several modes say of each document as one JSON object, a key for each mode in the order of
        DOCUMENT_MODES (of one mode its rows alone), with the document's recovery record. All from one parse."""
        found, columns = self._mode_columns(modes, pattern, pages)
        options = {"ignoreNullFields": "false"}
        if len(columns) == 1:
            root = F.to_json(next(iter(columns.values())), options)
        else:
            root = F.to_json(F.struct(*(c.alias(m) for m, c in columns.items())), options)
        return found.select("doc_key", "load_error", sinks.recovery_in_json(root, self.options["recovery"] == "strict").alias("json"))

    def sections(self, *modes: str, pattern: str | None = None, pages: str | None = None) -> DataFrame:
        """doc_key, ord, title, json: a section for each mode of each document, in order. All from one parse."""
        found, columns = self._mode_columns(modes, pattern, pages)
        rows = F.array(*(F.struct(F.lit(i).alias("ord"), F.lit(DOCUMENT_MODES[m]).alias("title"), F.to_json(c, {"ignoreNullFields": "false"}).alias("json")) for i, (m, c) in enumerate(columns.items())))
        return found.select("doc_key", F.inline(rows))
