"""Helpers shared by the training-data operators."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The characters that separate words, as a Java/Python character class body.
SPACE = r"\x20\x09-\x0D"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"

_local: str | None = None


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share.

    It is what ``spark.checkpoint.dir`` names. Only where that is unset and all
    tasks run in this process a temporary folder of this machine is taken; on a
    cluster an unset folder is an error.
    """
    global _local
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    if _local is None:
        _local = "file://" + tempfile.mkdtemp(prefix="ohmgrid-")
    return _local


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder."""
    return f"{shared_dir(spark)}/ohmgrid/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """Cut the lineage: write ``df`` as Parquet into the shared folder and read it."""
    spark = df.sparkSession
    path = scratch(spark, name)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._scratch_path = path
    return out


def using(df: DataFrame, *frames: DataFrame) -> DataFrame:
    """``df``, which reads ``frames``: ``forget(df)`` forgets them as well."""
    df._scratch_frames = frames
    return df


def forget(*frames: DataFrame) -> None:
    """Delete the files behind frames that ``written`` made, or that frames use, and nothing reads any more."""
    for df in frames:
        path = getattr(df, "_scratch_path", None)
        if path:
            remove(df.sparkSession, path)
        forget(*getattr(df, "_scratch_frames", ()))


def filesystem(spark: SparkSession, path: str):
    """Hadoop's file system and path object for ``path``."""
    jvm = spark._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def remove(spark: SparkSession, path: str) -> None:
    fs, p = filesystem(spark, path)
    fs.delete(p, True)


def slices(batches: Iterator[pa.RecordBatch], text: int, most: int = 2 << 20) -> Iterator[pa.RecordBatch]:
    """The rows of the batches in order, cut so that column ``text`` has about ``most`` bytes in each part.

    A batch is cut by its rows' bytes, so what a task holds at once does not grow
    with the number of rows of a batch; a longer text is a part of its own.
    """
    for batch in batches:
        ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False))
        at = 0
        while at < batch.num_rows:
            stop = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + most, "right")))
            yield batch.slice(at, stop - at)
            at = stop


def text_or_empty(column: str = "text") -> Column:
    return F.coalesce(F.col(column), F.lit(""))


def once(c: Column) -> Column:
    """``c``, evaluated once a row.

    The optimizer copies a column's expression to where it is used, also into a
    lambda, where it would be evaluated for every element, and into filters that
    it infers. It leaves a nondeterministic expression where it is; the value
    here does not depend on the row number.
    """
    return F.when(F.monotonically_increasing_id() >= 0, c)


def word_array(text: Column) -> Column:
    """Words ``[^\\x20\\x09-\\x0D]+`` of a non-null text, as an array column."""
    bare = F.btrim(text, F.lit(" \t\n\x0b\x0c\r"))
    return F.when(bare == "", F.array().cast("array<string>")).otherwise(F.split(bare, f"[{SPACE}]+", -1))


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
