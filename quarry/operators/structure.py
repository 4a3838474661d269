"""Page labels, permissions and recovery as columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.crypt import PERMISSIONS


def roman(n: Column) -> Column:
    """Roman numerals in lower case, by digits; thousands are repeated."""
    out = F.repeat(F.lit("m"), F.floor(n / 1000).cast("int"))
    for unit, (one, five, ten) in ((100, "cdm"), (10, "xlc"), (1, "ivx")):
        digits = ["", one, one * 2, one * 3, one + five, five, five + one, five + one * 2, five + one * 3, one + ten]
        out = F.concat(out, F.element_at(F.array(*map(F.lit, digits)), F.pmod(F.floor(n / unit), F.lit(10)).cast("int") + 1))
    return out


def alpha(n: Column, letters: int = 14) -> Column:
    """Letters as spreadsheets count columns; 14 are enough for any long."""

    def step(held, _):
        letter = F.substring(F.lit("abcdefghijklmnopqrstuvwxyz"), F.pmod(held.rest - 1, F.lit(26)).cast("int") + 1, F.lit(1))
        more = held.rest > 0
        return F.struct(F.when(more, F.concat(letter, held.out)).otherwise(held.out).alias("out"), F.when(more, F.floor((held.rest - 1) / 26)).otherwise(F.lit(0)).cast("bigint").alias("rest"))

    return F.aggregate(F.array_repeat(F.lit(0), letters), F.struct(F.lit("").alias("out"), n.cast("bigint").alias("rest")), step, lambda held: held.out)


def range_of(number: Column, ranges: Column) -> Column:
    """The last of a document's ranges that begins at or before a page."""
    return F.try_element_at(F.filter(ranges, lambda r: (r.first_page >= 0) & (r.first_page < number)), F.lit(-1))


def label_of(number: Column, r: Column) -> Column:
    """A page's label, style, prefix and start, from its range."""
    style, prefix = F.coalesce(r.style, F.lit("D")), F.coalesce(r.prefix, F.lit(""))
    start = F.coalesce(r.start, F.lit(1)).cast("bigint")
    n = start + number - 1 - F.coalesce(r.first_page, F.lit(0))
    plain = n.cast("string")
    spelled = F.when(style.isin("r", "R"), roman(n)).when(style.isin("a", "A"), alpha(n))
    shown = F.when(style == "D", plain).when(~style.isin("r", "R", "a", "A"), F.lit("")).when(n <= 0, plain).otherwise(F.when(style.isin("R", "A"), F.upper(spelled)).otherwise(spelled))
    return F.struct(number.cast("int").alias("page_number"), F.concat(prefix, shown).alias("label"), style.alias("style"), prefix.alias("prefix"), start.alias("start"))


def page_labels(parsed: DataFrame) -> DataFrame:
    """Each page's label, from the last range that begins at or before it: an as-of join within the document's row, from
    parts pages and label_ranges (which are in order). Documents without ranges have no labels."""
    pages = parsed.filter(F.size("label_ranges") > 0).select("doc_key", "label_ranges", F.explode("pages").alias("page"))
    number = F.col("page.page_number").cast("bigint")
    held = pages.select("doc_key", number.alias("number"), range_of(number, F.col("label_ranges")).alias("r"))
    return held.select("doc_key", label_of(F.col("number"), F.col("r")).alias("said")).select("doc_key", "said.*")


def permissions(p: Column) -> Column:
    """The permissions in /P by name."""
    bits = [x for name, bit in PERMISSIONS.items() for x in (F.lit(name), F.shiftrightunsigned(p.cast("bigint").bitwiseAND(F.lit(0xFFFFFFFF)), bit).bitwiseAND(F.lit(1)) == 1)]
    return F.create_map(*bits)


def recovered(documents: DataFrame) -> DataFrame:
    """One row for each stream whose length was wrong."""
    return documents.select("doc_key", F.inline("recovery"))


def nested(parsed: DataFrame) -> DataFrame:
    """Each document's object tree as one JSON object of nested nodes. From part tree_json."""
    return parsed.select("doc_key", F.inline("tree_json"))
