"""New files as they arrive: each is parsed once and appended, with its own errors."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..sources import reader


def arriving(spark: SparkSession, folder: str, glob: str = "*.pdf", files_a_batch: int = 1000) -> DataFrame:
    """A stream of doc_key and content."""
    schema = "path string, modificationTime timestamp, length bigint, content binary"
    found = spark.readStream.format("binaryFile").schema(schema).option("pathGlobFilter", glob).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", files_a_batch).load(folder)
    return found.select(F.col("path").alias("doc_key"), "content")


def ingest(spark: SparkSession, folder: str, target: str, checkpoint: str, parts: list[str] | None = None, once: bool = True, **options) -> StreamingQuery:
    """Parse arriving files into Parquet at target. The checkpoint holds which files are done, so a restart repeats none."""
    parsed = reader.parse(arriving(spark, folder), parts or ["documents", "objects", "refs", "pages", "page_text", "issues"], **options)
    writer = parsed.writeStream.format("parquet").option("path", target).option("checkpointLocation", checkpoint).outputMode("append")
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime="1 minute")).start()
