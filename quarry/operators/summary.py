"""Counts and totals by document."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def _streams(objects="objects"):
    return F.filter(objects, lambda o: o.kind == "Stream")


def type_counts(parsed: DataFrame) -> DataFrame:
    """doc_key, kind, n; from part objects, in the document's row."""
    kinds = F.array_sort(F.array_distinct("objects.kind"))
    return parsed.select("doc_key", F.inline(F.transform(kinds, lambda k: F.struct(k.alias("kind"), F.size(F.filter("objects", lambda o: o.kind == k)).cast("bigint").alias("n")))))


def stream_totals(parsed: DataFrame, decoded: bool = True) -> DataFrame:
    """Streams of each document that has any: how many, their bytes, and their decoded bytes if those are asked for. From part
    objects, and streams for decoded bytes, in the document's row."""
    raw = F.aggregate(_streams(), F.lit(0).cast("bigint"), lambda a, o: a + o.raw_len)
    data = F.aggregate("streams", F.lit(0).cast("bigint"), lambda a, s: a + F.length(s["data"])) if decoded else F.lit(None).cast("bigint")
    return parsed.select("doc_key", F.size(_streams()).cast("bigint").alias("n_streams"), raw.alias("raw_bytes"), data.alias("decoded_bytes")).filter("n_streams > 0")


def filter_counts(objects: DataFrame, by: list[str] | None = None) -> DataFrame:
    """How often each filter is named, most often first by sort_order."""
    keys = ["doc_key"] if by is None else by
    out = objects.select(*keys, F.explode("filters").alias("filter")).groupBy(*keys, "filter").agg(F.count("*").alias("n"))
    w = Window.partitionBy(*keys).orderBy(F.desc("n"), "filter") if keys else None
    return out.withColumn("sort_order", F.row_number().over(w)) if w is not None else out


def largest_streams(parsed: DataFrame, k: int = 3) -> DataFrame:
    """The k largest streams of each document; of equals the first object. From part objects, in the document's row."""

    def before(a, b):
        return F.when(a.raw_len != b.raw_len, F.when(a.raw_len > b.raw_len, -1).otherwise(1)).when(a.obj_num != b.obj_num, F.when(a.obj_num < b.obj_num, -1).otherwise(1)).otherwise(F.when(a.gen < b.gen, -1).otherwise(1))

    top = parsed.select("doc_key", F.posexplode(F.slice(F.array_sort(_streams(), before), 1, k)).alias("at", "o"))
    return top.select("doc_key", (F.col("at") + 1).alias("rank"), "o.obj_num", "o.raw_len")


def duplicate_generations(parsed: DataFrame) -> DataFrame:
    """Object numbers of each document that have several generations, with those in order. From part generations, in the document's row."""
    return parsed.select("doc_key", F.inline("generations"))


def severities(issues: DataFrame) -> DataFrame:
    """Errors, warnings and notes by document; status 3 where there are errors."""
    n = {level: F.count_if(F.col("level") == level) for level in ("error", "warn", "info")}
    out = issues.groupBy("doc_key").agg(n["error"].alias("error_count"), n["warn"].alias("warning_count"), n["info"].alias("info_count"))
    return out.withColumn("status", F.when(F.col("error_count") > 0, 3).otherwise(0))


def overview(parsed: DataFrame) -> DataFrame:
    """One row a document, from parts documents, objects, issues, bookmarks, forms, layers and embedded: no shuffle."""
    d = F.get("documents", F.lit(0))
    kinds = F.map_from_entries(F.transform(F.array_distinct("objects.kind"), lambda k: F.struct(k, F.size(F.filter("objects", lambda o: o.kind == k)))))
    streams = _streams()

    def at(level):
        return F.size(F.filter("issues", lambda i: i.level == level))

    return parsed.select(
        "doc_key", "load_error", d.version.alias("version"), d.object_count.alias("object_count"), d.page_count.alias("page_count"), d.encrypted.alias("encrypted"), d.info.alias("info"), d.settings.alias("settings"),
        kinds.alias("type_counts"), F.size(streams).alias("n_streams"), F.aggregate(streams, F.lit(0).cast("bigint"), lambda a, o: a + o.raw_len).alias("raw_bytes"),
        at("error").alias("error_count"), at("warn").alias("warning_count"), at("info").alias("info_count"), F.size("bookmarks").alias("n_bookmarks"), F.size("forms").alias("n_fields"),
        F.size("layers").alias("n_layers"), F.size("embedded").alias("n_embedded"), d.has_page_labels.alias("has_page_labels"), d.tagged.alias("tagged"),
        F.when(F.col("load_error").isNotNull(), 1).when(at("error") > 0, 3).when(d.encrypted & ~d.decrypted, 3).otherwise(0).alias("status"),
    )
