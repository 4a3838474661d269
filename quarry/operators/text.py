"""Text of pages and searches in it."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as functions
from ..sources.batches import array_of, bounded, sliced
from .objects import in_pages


def page_text(pages: DataFrame, spec: str | None = None) -> DataFrame:
    return pages.filter(in_pages(spec)).select("doc_key", "page_number", "text", "warnings")


def document_text(parsed: DataFrame) -> DataFrame:
    """A document's pages in order, joined by a new line, from part page_text."""
    return parsed.select("doc_key", F.array_join(F.transform("page_text", lambda x: x.text), "\n").alias("text"))


def find_text(pages: DataFrame, pattern: str, spec: str | None = None) -> DataFrame:
    """doc_key, page_number, snippets of each page with matches, of text that is held. Where files are parsed for it, part matches has
    them without a further worker."""

    def snippets(batches):
        for b in sliced(batches):
            made = array_of([functions.snippets(t or "", pattern) for t in b.column(2).to_pylist()], pa.list_(pa.string()))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), made], ["doc_key", "page_number", "snippets"])

    bounded(pages.sparkSession)
    hits = pages.filter(in_pages(spec)).filter(F.contains(F.lower("text"), F.lower(F.lit(pattern)))) if pattern else pages.filter(F.lit(False))
    # A function of columns would be called twice, for the condition too, each in a worker of its own.
    return hits.select("doc_key", "page_number", "text").mapInArrow(snippets, "doc_key string, page_number int, snippets array<string>").filter(F.size("snippets") > 0)


def count_text(pages: DataFrame, pattern: str, spec: str | None = None) -> DataFrame:
    """doc_key, page_number, n_matches without snippets: no Python after the text is there."""
    low, sought = F.lower("text"), pattern.lower()
    n = ((F.length(low) - F.length(F.replace(low, F.lit(sought), F.lit("")))) / len(sought)).cast("bigint") if sought else F.lit(0).cast("bigint")
    return pages.filter(in_pages(spec)).select("doc_key", "page_number", n.alias("n_matches")).filter("n_matches > 0")


def find_totals(counts: DataFrame) -> DataFrame:
    return counts.groupBy("doc_key").agg(F.sum("n_matches").alias("n_matches"), F.count("*").alias("n_pages"))


def operator_list(pages: DataFrame, spec: str | None = None) -> DataFrame:
    """doc_key, page_number, seq, operator, operands of each operation."""
    flat = pages.filter(in_pages(spec)).select("doc_key", "page_number", F.posexplode("operations").alias("seq", "o"))
    return flat.select("doc_key", "page_number", "seq", F.col("o.operator").alias("operator"), F.col("o.operands").alias("operands"))


def page_info(parsed: DataFrame) -> DataFrame:
    """One row a page: boxes, contents, counts of resources and annotations, and the beginning of the text. From part page_info."""
    return parsed.select("doc_key", F.inline("page_info"))


def annotation_counts(notes: DataFrame) -> DataFrame:
    return notes.groupBy("doc_key", "page_number", "subtype").agg(F.count("*").alias("n"))
