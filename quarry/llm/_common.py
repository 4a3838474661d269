"""Pieces that several corpus operators share."""

from __future__ import annotations

import os
import re
import tempfile
import threading
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType


def char_class(ranges: str) -> str:
    """The inside of a regular expression's class, from ranges of code points in hexadecimal."""
    return "".join(f"{chr(int(a, 16))}-{chr(int(z, 16))}" for a, z in (r.split("-") for r in ranges.split()))


# Code points of scripts without spaces between words (Thai, Lao, Burmese, Khmer, kana, Han).
UNSPACED = re.compile(f"[{char_class('e00-eff 1000-109f 1780-17ff 3005-3007 3041-309f 30a1-30fa 30fc-30ff 3400-4dbf 4e00-9fff f900-faff 20000-3ffff')}]")

#: Bytes in one Arrow batch handed to Python. Texts can be long, so bytes, not rows, bound what a worker holds at once.
BATCH_BYTES = 1 << 20


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or, where driver and executors are one process,
    a folder of our own if that is unset."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="quarry-shared-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found


#: Folders made in this process, by session and thread, in order: queries that run at once don't delete one another's.
_MADE: dict[tuple[str, int], list[str]] = {}


def _made(spark: SparkSession) -> list[str]:
    return _MADE.setdefault((spark.sparkContext.applicationId, threading.get_ident()), [])


def new_path(spark: SparkSession, tag: str) -> str:
    made = _made(spark)
    made.append(os.path.join(shared_dir(spark), f"quarry-{tag}-{uuid.uuid4().hex}"))
    return made[-1]


def n_written(spark: SparkSession) -> int:
    """How many folders this application has made in this thread."""
    return len(_made(spark))


def drop_written(spark: SparkSession, since: int = 0, keep_last: int = 0) -> None:
    """Delete what operators have written to the shared folder for this application since n_written() was this, but for the
    last so many tables. Results that read those folders can't be read after it."""
    made = _made(spark)
    rest = made[max(since, len(made) - keep_last) :]
    for name in made[since : len(made) - len(rest)]:
        path = spark._jvm.org.apache.hadoop.fs.Path(name)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
    made[since:] = rest


def written(df: DataFrame, tag: str) -> DataFrame:
    """Write a table to the shared folder and read it back: lineage is cut, and no executor's loss can take it."""
    path = new_path(df.sparkSession, tag)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def bounded_batches(spark: SparkSession) -> None:
    """Bound what a Python worker holds at once. Plans are lazy, so the bound stays; it is never made looser, and no other
    setting changes."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if int(re.sub(r"\D", "", spark.conf.get(key, None) or "") or 1 << 31) > BATCH_BYTES:
        spark.conf.set(key, str(BATCH_BYTES))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def in_fold(doc_id: str, modulus: int, remainder: int) -> Column:
    """Whether crc32(doc_id as text) leaves this remainder; false for a null id."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % modulus == remainder, F.lit(False))


def free_names(columns: list[str], *wanted: str) -> list[str]:
    """Names for columns of our own that no column has."""
    taken, out = {c.lower() for c in columns}, []
    for name in wanted:
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        out.append(name)
    return out


def map_batches(df: DataFrame, run, *more: StructField) -> DataFrame:
    """df.mapInArrow(run) to df's own columns and further ones, whatever df's columns are called; run sees them by place."""
    own = df.toDF(*[f"c{i}" for i in range(len(df.columns))])
    out = own.mapInArrow(run, StructType([*own.schema.fields, *(StructField(f"m{i}", f.dataType) for i, f in enumerate(more))]))
    return out.toDF(*df.columns, *(f.name for f in more))
