"""References between objects. A document's row holds both sides, so they are answered in the row."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def forward(refs: DataFrame, obj_num: int) -> DataFrame:
    return refs.filter((F.col("src_num") == obj_num) & (F.col("src_gen") == 0)).select("doc_key", "path", "dst_num", "dst_gen")


def reverse(parsed: DataFrame, obj_num: int | None = None) -> DataFrame:
    """Objects that point at each object (or at one of generation 0), with their paths in order. From part referrers."""
    rows = F.col("referrers") if obj_num is None else F.filter("referrers", lambda r: (r.dst_num == obj_num) & (r.dst_gen == 0))
    return parsed.select("doc_key", F.inline(rows))


def broken(parsed: DataFrame) -> DataFrame:
    """References to objects that aren't there, each time they are made; the trailer's and cross-reference streams' aside.
    From part refs, in the document's row."""
    rows = parsed.select("doc_key", F.inline(F.filter("refs", lambda r: r.src_num.isNotNull() & ~r.from_xref & r.missing)))
    return rows.select("doc_key", "src_num", "src_gen", "path", "dst_num", "dst_gen")


def unreachable(parsed: DataFrame) -> DataFrame:
    """Objects that no chain of references from the trailer meets; cross-reference streams aside. From part unreachable."""
    return parsed.select("doc_key", F.inline("unreachable"))


def on_pages(parsed: DataFrame) -> DataFrame:
    """doc_key, obj_num, page_number: objects that a page refers to at any depth of its dictionary, or that its
    resources, where they are an object of their own, refer to. From part page_objects."""
    return parsed.select("doc_key", F.inline("page_objects"))
