"""Where results go: JSON lines, text lines, and bytes of streams."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def as_json(rows: DataFrame) -> DataFrame:
    """doc_key and each row as JSON, with keys in alphabetical order as the other outputs have them."""
    cols = sorted(c for c in rows.columns if c != "doc_key")
    return rows.select("doc_key", F.to_json(F.struct(*cols), {"ignoreNullFields": "false"}).alias("json"))


def write_json(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").json(path)


def write_lines(lines: DataFrame, path: str, column: str = "line") -> None:
    """One column of text, a line each."""
    lines.select(F.col(column).cast("string").alias("value")).write.mode("overwrite").text(path)


def write_streams(streams: DataFrame, path: str) -> None:
    """doc_key, obj_num and decoded bytes, as Parquet. Warnings stay beside the bytes they belong to."""
    streams.select("doc_key", "obj_num", "data", "warning").write.mode("overwrite").parquet(path)


def with_recovery(rows: DataFrame, documents: DataFrame) -> DataFrame:
    """Rows (one a document) with what was repaired in their document; documents is part documents."""
    held = documents.select("doc_key", F.struct(F.size("recovery").alias("count"), F.col("recovery").alias("streams")).alias("recovery"))
    return rows.join(held, "doc_key", "left")


def recovery_in_json(root: Column, strict: bool = False) -> Column:
    """A JSON root with the recovery record of its document (a column of part documents in the same row) merged into it: as a
    key of an object, or beside any other root as {"data", "recovery"}. Roots of documents without damage stay."""
    found = F.get("documents", F.lit(0)).recovery
    record = F.to_json(F.struct(F.size(found).alias("count"), F.lit(not strict).alias("repaired"), found.alias("streams"), F.lit(strict).alias("strict")))
    inside = F.rtrim(F.substring(F.trim(root), F.lit(2), F.length(F.trim(root)) - 2))
    merged = F.concat(F.lit("{"), inside, F.when(F.trim(inside) == "", "").otherwise(","), F.lit('"recovery":'), record, F.lit("}"))
    beside = F.concat(F.lit('{"data":'), root, F.lit(',"recovery":'), record, F.lit("}"))
    return F.when(F.coalesce(F.size(found), F.lit(0)) == 0, root).when(F.startswith(F.trim(root), F.lit("{")), merged).otherwise(beside)


def statuses(parsed: DataFrame, strict: bool = False) -> DataFrame:
    """doc_key, status: 1 a file that can't be read, 3 one with problems (locked, repaired streams in strict reading, errors,
    unreliable text), 0 otherwise. From parts documents, issues and reliability; strict for files parsed with recovery="strict"."""
    d = F.get("documents", F.lit(0))
    damaged = F.coalesce(F.size(d.recovery) > 0, F.lit(False)) if strict else F.lit(False)
    bad = damaged | (d.encrypted & ~d.decrypted) | F.exists("issues", lambda i: i.level == "error") | F.coalesce(F.get("reliability", F.lit(0)).verdict == "unreliable", F.lit(False))
    return parsed.select("doc_key", F.when(F.col("load_error").isNotNull(), 1).when(bad, 3).otherwise(0).alias("status"))
